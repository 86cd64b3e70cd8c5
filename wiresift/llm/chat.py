"""Chat templates compiled to Python closures that render conversations turn by turn.

The template language is a small, sandboxed part of the usual one: ``{{ value }}``,
``{% for m in messages %}``, ``{% if %}/{% elif %}/{% else %}``, ``{% set %}`` and
``{% generation %}``, which marks text that a model is trained on. A template is
parsed to a syntax tree, constants are folded, and each node becomes a closure that
yields pieces of text with their mark. Messages are taken one at a time with one
of look-ahead, so a conversation of any length renders in the memory of two turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiresift.llm.common import pieces

Piece = tuple[str, bool]
Scope = dict[str, Any]
CONTROLS = ("<|turn|>", "</s>", "[INST]", "[/INST]")
TEMPLATE = """\
{% for m in messages %}<|turn|>{{ m.role | line }}
{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}\
{% else %}{{ m.text | escape }}{% endif %}</s>
{% endfor %}"""


class TemplateError(ValueError):
    """A template that does not parse, or asks for what the sandbox does not give."""


# Escapes.

def escaper(controls: Iterable[str] = CONTROLS) -> Callable[[str], str]:
    """Puts a backslash after the first character of control strings, and doubles backslashes."""
    found = re.compile("|".join([r"\\", *(re.escape(c) for c in sorted(controls, key=len, reverse=True))]))
    return lambda text: found.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    """Undoes ``escaper`` and the ``line`` filter: a backslash stands for what follows it, if another
    backslash or a line feed, and otherwise for nothing."""
    return _UNESCAPE.sub(r"\1", text)


# Syntax tree.

@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    name: str


@dataclass(frozen=True)
class Call:
    """An operator or filter on its arguments."""
    name: str
    args: tuple


@dataclass(frozen=True)
class Text:
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    body: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


_TAG = re.compile(r"\{#.*?#\}|\{\{-?(?P<out>.*?)-?\}\}|\{%-?(?P<tag>.*?)-?%\}", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)"""
                    r"""|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~|().\[\]<>%]))""", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def parse(template: str) -> tuple:
    """The syntax tree of a template."""
    items: list[tuple[str, str]] = []
    at = 0
    for tag in _TAG.finditer(template):
        text = template[at:tag.start()]
        if items and items[-1][0] == "strip":
            items.pop()
            text = text.lstrip()
        if tag[0].startswith(("{{-", "{%-")):
            text = text.rstrip()
        items.append(("text", text))
        if tag["out"] is not None:
            items.append(("out", tag["out"]))
        elif tag["tag"] is not None:
            items.append(("tag", tag["tag"].strip()))
        if tag[0].endswith(("-}}", "-%}")):
            items.append(("strip", ""))
        at = tag.end()
    rest = template[at:]
    if items and items[-1][0] == "strip":
        items.pop()
        rest = rest.lstrip()
    items.append(("text", rest))
    nodes, left, _ = _block([i for i in items if i[0] != "text" or i[1]], 0, ())
    if left < len(items) and _ != "":
        raise TemplateError(f"unexpected {_}")
    return nodes


def _block(items: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[tuple, int, str]:
    nodes: list = []
    while at < len(items):
        kind, body = items[at]
        at += 1
        if kind == "text":
            nodes.append(Text(Const(body)))
        elif kind == "out":
            nodes.append(Text(expression(body)))
        else:
            word, _, rest = body.partition(" ")
            if word in ends:
                return tuple(nodes), at, body
            if word == "for":
                found = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.DOTALL)
                if not found:
                    raise TemplateError(f"for needs a name and what it runs over: {body}")
                inner, at, _ = _block(items, at, ("endfor",))
                nodes.append(For(found[1], expression(found[2]), inner))
            elif word == "if":
                node, at = _if(items, at, rest)
                nodes.append(node)
            elif word == "generation":
                inner, at, _ = _block(items, at, ("endgeneration",))
                nodes.append(Generation(inner))
            elif word == "set":
                name, equals, value = rest.partition("=")
                if not equals or not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                    raise TemplateError(f"set needs a name and a value: {body}")
                nodes.append(Set(name.strip(), expression(value)))
            else:
                raise TemplateError(f"unknown tag: {body}")
    if ends:
        raise TemplateError(f"{ends[0]} is missing")
    return tuple(nodes), at, ""


def _if(items: list[tuple[str, str]], at: int, test: str) -> tuple[If, int]:
    body, at, end = _block(items, at, ("elif", "else", "endif"))
    if end.startswith("elif"):
        other, at = _if(items, at, end[4:])
        return If(expression(test), body, (other,)), at
    if end == "else":
        last, at, _ = _block(items, at, ("endif",))
        return If(expression(test), body, last), at
    return If(expression(test), body, ()), at


def expression(source: str) -> Any:
    """The tree of an expression."""
    tokens: list[tuple[str, str]] = []
    at = 0
    source = source.strip()
    while at < len(source):
        token = _TOKEN.match(source, at)
        if not token:
            raise TemplateError(f"not understood: {source[at:at + 40]}")
        kind = token.lastgroup or ""
        tokens.append((kind, token[kind]))
        at = token.end()
    parser = _Expression(tokens)
    tree = parser.choice()
    if parser.at < len(tokens):
        raise TemplateError(f"unexpected {tokens[parser.at][1]}")
    return tree


class _Expression:
    def __init__(self, tokens: list[tuple[str, str]]) -> None:
        self.tokens, self.at = tokens, 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def chain(self, below: Callable[[], Any], *values: str) -> Any:
        tree = below()
        while op := self.take(*values):
            tree = Call(op, (tree, below()))
        return tree

    def choice(self) -> Any:
        return self.chain(lambda: self.chain(self.negated, "and"), "or")

    def negated(self) -> Any:
        return Call("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        return self.chain(self.joined, "==", "!=", "<", ">", "<=", ">=")

    def joined(self) -> Any:
        return self.chain(lambda: self.chain(self.filtered, "%"), "+", "-", "~")

    def filtered(self) -> Any:
        tree = self.member()
        while self.take("|"):
            if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
                raise TemplateError("a filter's name is missing")
            name = self.tokens[self.at][1]
            self.at += 1
            if name not in FILTERS and name not in ("escape", "line"):
                raise TemplateError(f"unknown filter: {name}")
            tree = Call(name, (tree,))
        return tree

    def member(self) -> Any:
        tree = self.atom()
        while op := self.take(".", "["):
            if op == "[":
                key = self.choice()
                if not self.take("]") or not isinstance(key, Const) or not isinstance(key.value, str):
                    raise TemplateError("an index is a string in brackets")
                name = key.value
            else:
                if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
                    raise TemplateError("a field's name is missing")
                name = self.tokens[self.at][1]
                self.at += 1
            if name.startswith("_"):
                raise TemplateError(f"not allowed: {name}")
            tree = Field(tree, name)
        return tree

    def atom(self) -> Any:
        if self.take("("):
            tree = self.choice()
            if not self.take(")"):
                raise TemplateError(") is missing")
            return tree
        if self.at >= len(self.tokens):
            raise TemplateError("a value is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "num":
            return Const(int(value))
        if kind == "name" and value not in ("and", "or", "not", "in"):
            if value.lower() in ("true", "false", "none"):
                return Const({"true": True, "false": False, "none": None}[value.lower()])
            if value.startswith("_"):
                raise TemplateError(f"not allowed: {value}")
            return Name(value)
        raise TemplateError(f"unexpected {value}")


FILTERS: dict[str, Callable] = {
    "trim": lambda v: _show(v).strip(), "upper": lambda v: _show(v).upper(), "lower": lambda v: _show(v).lower(),
    "length": len, "string": lambda v: _show(v),
}
_OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "+": lambda a, b: a + b, "-": lambda a, b: a - b,
    "~": lambda a, b: _show(a) + _show(b), "%": lambda a, b: a % b, "not": lambda a: not a,
}


def _show(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


# Folding.

def fold(node: Any, calls: dict[str, Callable]) -> Any:
    """The same tree with what does not depend on the conversation worked out."""
    if isinstance(node, tuple):
        out: list = []
        for n in (fold(n, calls) for n in node):
            # A test on a constant leaves its branch; neighbouring texts become one.
            for item in (n if isinstance(n, tuple) else (n,)):
                if isinstance(item, Text) and isinstance(item.value, Const):
                    if out and isinstance(out[-1], Text) and isinstance(out[-1].value, Const):
                        out[-1] = Text(Const(out[-1].value.value + _show(item.value.value)))
                        continue
                    item = Text(Const(_show(item.value.value)))
                    if not item.value.value:
                        continue
                out.append(item)
        return tuple(out)
    if isinstance(node, Call):
        args = tuple(fold(a, calls) for a in node.args)
        if node.name in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.name == "and") else args[0]
        if node.name in calls and all(isinstance(a, Const) for a in args):
            try:
                return Const(calls[node.name](*(a.value for a in args)))
            except Exception as error:
                raise TemplateError(f"{node.name}: {error}") from error
        return Call(node.name, args)
    if isinstance(node, Field):
        return Field(fold(node.of, calls), node.name)
    if isinstance(node, Text):
        return Text(fold(node.value, calls))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value, calls))
    if isinstance(node, For):
        return For(node.name, fold(node.over, calls), fold(node.body, calls))
    if isinstance(node, Generation):
        return Generation(fold(node.body, calls))
    if isinstance(node, If):
        test = fold(node.test, calls)
        if isinstance(test, Const):
            return fold(node.body if test.value else node.other, calls)
        return If(test, fold(node.body, calls), fold(node.other, calls))
    return node


# Closures.

def _value(node: Any, calls: dict[str, Callable]) -> Callable[[Scope], Any]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):
        return lambda scope, n=node.name: scope.get(n)
    if isinstance(node, Field):
        of = _value(node.of, calls)

        def field_of(scope: Scope, n: str = node.name) -> Any:
            holder = of(scope)
            return holder.get(n) if isinstance(holder, dict) else None
        return field_of
    args = [_value(a, calls) for a in node.args]
    if node.name == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.name == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    call = calls[node.name]
    if len(args) == 1:
        return lambda scope, a=args[0]: call(a(scope))
    return lambda scope, a=args[0], b=args[1]: call(a(scope), b(scope))


Emit = Callable[[Scope, bool], Iterator[Piece]]


def _body(nodes: tuple, calls: dict[str, Callable]) -> Emit:
    parts = [_emit(n, calls) for n in nodes]
    if len(parts) == 1:
        return parts[0]

    def emit(scope: Scope, marked: bool) -> Iterator[Piece]:
        for part in parts:
            yield from part(scope, marked)
    return emit


def _emit(node: Any, calls: dict[str, Callable]) -> Emit:
    if isinstance(node, Text):
        if isinstance(node.value, Const):
            text = node.value.value
            return lambda scope, marked: iter(((text, marked),))
        value = _value(node.value, calls)

        def out(scope: Scope, marked: bool) -> Iterator[Piece]:
            text = _show(value(scope))
            if text:
                yield text, marked
        return out
    if isinstance(node, Set):
        value = _value(node.value, calls)

        def assign(scope: Scope, marked: bool) -> Iterator[Piece]:
            scope[node.name] = value(scope)
            return iter(())
        return assign
    if isinstance(node, Generation):
        body = _body(node.body, calls)
        return lambda scope, marked: body(scope, True)
    if isinstance(node, If):
        test, body, other = _value(node.test, calls), _body(node.body, calls), _body(node.other, calls)
        return lambda scope, marked: (body if test(scope) else other)(scope, marked)
    over, body = _value(node.over, calls), _body(node.body, calls)

    def loop(scope: Scope, marked: bool) -> Iterator[Piece]:
        items = iter(over(scope) or ())
        before = None
        here = next(items, None)
        index = 0
        while here is not None:
            following = next(items, None)
            scope[node.name] = here
            scope["loop"] = {"index": index + 1, "index0": index, "first": index == 0, "last": following is None,
                             "previtem": before, "nextitem": following}
            yield from body(scope, marked)
            before, here, index = here, following, index + 1
    return loop


class Template:
    """A compiled template: ``pieces(messages)`` yields (text, in generation)."""

    def __init__(self, source: str = TEMPLATE, controls: Iterable[str] = CONTROLS) -> None:
        escape = escaper(controls)
        calls = _OPERATORS | FILTERS | {
            "escape": lambda v: escape(_show(v)), "line": lambda v: escape(_show(v)).replace("\n", "\\\n")}
        self.tree = fold(parse(source), calls)
        self._run = _body(self.tree, calls)

    def pieces(self, messages: Iterable[dict[str, Any]], **names: Any) -> Iterator[Piece]:
        return self._run({**names, "messages": messages}, False)

    def render(self, messages: Iterable[dict[str, Any]], **names: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the spans of it that lie in generation blocks."""
        texts, spans, at = [], [], 0
        for text, marked in self.pieces(messages, **names):
            if marked:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            texts.append(text)
            at += len(text)
        return "".join(texts), spans


# Over tables.

PARTS = "conv_id long, start long, text string, spans array<struct<begin:long,finish:long>>"
_SPAN = pa.struct([("begin", pa.int64()), ("finish", pa.int64())])
#: Characters after which a part of a conversation's text is passed on.
PART_CHARS = 1 << 20


def format_conversations(turns: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS,
                         part_chars: int = PART_CHARS) -> DataFrame:
    """Formatted conversations in parts: (conv_id, start, text, spans).

    ``turns`` has conv_id, turn, role and text; other columns are not read. Turns
    come by number, those without one first, equal ones by role and text; null
    roles and texts are empty. Rows without a conv_id are one conversation.
    ``start`` is the part's place in the conversation's text, and ``spans`` are the
    stretches under the loss mask, in the part. A part ends between pieces, after
    about ``part_chars`` characters, so no conversation is held whole; its parts
    follow one another in the same partition.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template, controls)
        rows = _rows(batches)
        held: list[tuple] = []
        size = 0
        for conv, messages in _conversations(rows):
            texts, spans, start, at = [], [], 0, 0
            for text, marked in compiled.pieces(messages):
                if marked:
                    if spans and spans[-1][1] == at:
                        spans[-1] = (spans[-1][0], at + len(text))
                    else:
                        spans.append((at, at + len(text)))
                texts.append(text)
                at += len(text)
                if at >= part_chars:
                    yield _parts([*held, (conv, start, "".join(texts), spans)])
                    held, size = [], 0
                    texts, spans, start, at = [], [], start + at, 0
            held.append((conv, start, "".join(texts), spans))
            size += at
            if size >= part_chars or len(held) >= 1024:
                yield _parts(held)
                held, size = [], 0
        if held:
            yield _parts(held)

    wanted = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return wanted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text") \
        .select("conv_id", "role", "text").mapInArrow(run, PARTS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in pieces(batches):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple[int | None, Iterator[dict[str, str]]]]:
    """(conv_id, its messages) of sorted rows; messages are to be used up before the next."""
    row = next(rows, None)

    def messages(conv: int | None) -> Iterator[dict[str, str]]:
        nonlocal row
        while row is not None and row[0] == conv:
            here, row = row, next(rows, None)
            yield {"role": here[1], "text": here[2]}

    while row is not None:
        conv = row[0]
        yield conv, messages(conv)
        while row is not None and row[0] == conv:  # a template may not ask for all of them
            row = next(rows, None)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    conv, start, text, spans = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(conv, pa.int64()), pa.array(start, pa.int64()), pa.array(text, pa.string()),
         pa.array([[{"begin": a, "finish": b} for a, b in s] for s in spans], pa.list_(_SPAN))],
        names=["conv_id", "start", "text", "spans"])


_TURN = re.compile(r"<\|turn\|>((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!/s>))*+)</s>\n", re.DOTALL)


class TurnReader:
    """Reads turns and the text under the loss mask back from parts of one conversation.

    For texts of ``TEMPLATE``. What is not yet a whole turn waits for the next part.
    """

    def __init__(self, on_turn: Callable[[str, str], None], on_loss: Callable[[str], None]) -> None:
        self.rest, self.masks, self.on_turn, self.on_loss = "", [], on_turn, on_loss

    def add(self, text: str, spans: list[tuple[int, int]]) -> None:
        self.masks += [(a + len(self.rest), b + len(self.rest)) for a, b in spans]
        self.rest += text
        at = 0
        while found := _TURN.match(self.rest, at):
            self.on_turn(unescape(found[1]), unescape(found[2]))
            at = found.end()
        done = [m for m in self.masks if m[1] <= at]
        for text in _joined(done, self.rest):
            self.on_loss(unescape(text))
        self.masks = [(a - at, b - at) for a, b in self.masks[len(done):]]
        self.rest = self.rest[at:]

    def close(self) -> None:
        if self.rest:
            raise ValueError("the text does not end with a turn")


def _joined(spans: list[tuple[int, int]], text: str) -> Iterator[str]:
    """Texts of spans; those that touch, across parts, are one."""
    begin = finish = None
    for a, b in spans:
        if a == finish:
            finish = b
            continue
        if begin is not None:
            yield text[begin:finish]
        begin, finish = a, b
    if begin is not None:
        yield text[begin:finish]


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    """What a conversation's parts say, as they come."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.turns, self.loss, self.chars = conv, 0, 0, 0
        self.turn_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()
        self.reader = TurnReader(self._turn, self._loss)

    def _turn(self, role: str, text: str) -> None:
        self.turns += 1
        self.turn_sha.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))

    def _loss(self, text: str) -> None:
        self.loss += len(text)
        self.loss_sha.update(text.encode("utf-8", "surrogatepass"))

    def add(self, text: str, spans: list[dict]) -> None:
        self.chars += len(text)
        self.reader.add(text, [(s["begin"], s["finish"]) for s in spans])

    def row(self) -> tuple:
        self.reader.close()
        return (self.conv, self.turns, self.turn_sha.hexdigest(), self.loss, self.loss_sha.hexdigest(), self.chars)


def read_back(parts: DataFrame) -> DataFrame:
    """A digest per conversation of what ``format_conversations`` returns, read from text and spans.

    It is to follow that operator directly, since it relies on its order.
    """
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in READ_BACK.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)],
            names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest: _Digest | None = None
        out: list[tuple] = []
        for conv, start, text, spans in _rows(batches):
            if digest is None or start == 0:
                if digest is not None:
                    out.append(digest.row())
                digest = _Digest(conv)
            digest.add(text, spans)
            if len(out) >= 1024:
                yield batch_of(out)
                out = []
        if digest is not None:
            out.append(digest.row())
        if out:
            yield batch_of(out)

    return parts.mapInArrow(run, READ_BACK)
