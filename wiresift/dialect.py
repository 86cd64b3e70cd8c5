"""Python regex patterns, over bytes, as Java patterns over text with one character per byte.

The pattern's parse tree is written out again with explicit classes and anchors, so
that both engines read it alike. What Java cannot do, or only by recursion that
overflows its stack on long buffers, is refused here, on the driver.
"""

from __future__ import annotations

import re
from re import _parser as re_parser
from typing import Any

# Inline letters of the flags, and the classes both engines share.
FLAGS = {"s": re.S, "m": re.M, "i": re.I}
CATEGORIES = {
    "CATEGORY_DIGIT": r"\d", "CATEGORY_NOT_DIGIT": r"\D", "CATEGORY_SPACE": r"\s", "CATEGORY_NOT_SPACE": r"\S",
    "CATEGORY_WORD": r"\w", "CATEGORY_NOT_WORD": r"\W"}
WORD = "[0-9A-Za-z_]"
#: Rounds of a loop over a group of varying shape that Java's recursion can take.
DEEPEST = 500


def parsed(pattern: str, flags: str = "") -> Any:
    """Parse tree of a pattern as bytes; text beyond ASCII stands for its UTF-8 bytes."""
    return re_parser.parse(pattern.encode("utf-8"), sum(FLAGS[f] for f in flags if f in FLAGS))


def byte_pattern(text: str) -> str:
    """UTF-8 bytes of a text, one character each."""
    return text.encode("utf-8").decode("latin-1")


def java(pattern: str, flags: str = "", groups_before: int = 0) -> str:
    """The Java pattern that matches as Python's ``re`` does on bytes.

    ``groups_before`` counts the groups that will stand in front of it.
    """
    tree = parsed(pattern, flags)
    own = tree.state.flags
    body = _Writer(groups_before).sequence(tree, own)
    return ("(?i)" if own & re.I else "") + body


def _char(code: int) -> str:
    text = chr(code)
    return text if text.isascii() and text.isalnum() else f"\\x{code:02x}"


class _Writer:
    def __init__(self, groups_before: int) -> None:
        self.groups_before = groups_before

    def sequence(self, items: Any, flags: int) -> str:
        return "".join(self.node(str(op), value, flags) for op, value in items)

    def node(self, op: str, value: Any, flags: int) -> str:
        write = getattr(self, f"_{op.lower()}", None)
        if write is None:
            raise ValueError(f"patterns with {op} are not supported")
        return write(value, flags)

    def _literal(self, code: int, flags: int) -> str:
        return _char(code)

    def _not_literal(self, code: int, flags: int) -> str:
        return f"[^{_char(code)}]"

    def _any(self, value: None, flags: int) -> str:
        return r"[\x00-\xff]" if flags & re.S else r"[^\n]"

    def _in(self, items: list, flags: int) -> str:
        out = ""
        for op, value in items:
            kind = str(op)
            if kind == "NEGATE":
                out += "^"
            elif kind == "LITERAL":
                out += _char(value)
            elif kind == "RANGE":
                out += f"{_char(value[0])}-{_char(value[1])}"
            else:
                out += CATEGORIES[str(value)]
        return f"[{out}]"

    def _branch(self, value: tuple, flags: int) -> str:
        return "(?:" + "|".join(self.sequence(b, flags) for b in value[1]) + ")"

    def _subpattern(self, value: tuple, flags: int) -> str:
        group, add, remove, items = value
        inner = (flags | add) & ~remove
        body = self.sequence(items, inner)
        if group is not None:
            return f"({body})"
        if (inner ^ flags) & re.I:
            return f"(?{'i' if inner & re.I else '-i'}:{body})"
        return f"(?:{body})"

    def _atomic_group(self, items: Any, flags: int) -> str:
        return f"(?>{self.sequence(items, flags)})"

    def _max_repeat(self, value: tuple, flags: int, mark: str = "") -> str:
        low, high, items = value
        unbounded = high == re_parser.MAXREPEAT
        if (unbounded or high > DEEPEST) and not mark.startswith("+") and not _rigid(items):
            raise ValueError(
                f"a loop over a group of varying length may run at most {DEEPEST} times; give it a bound, "
                "or make what it repeats one character class")
        return f"(?:{self.sequence(items, flags)}){{{low},{'' if unbounded else high}}}{mark}"

    def _min_repeat(self, value: tuple, flags: int) -> str:
        return self._max_repeat(value, flags, "?")

    def _possessive_repeat(self, value: tuple, flags: int) -> str:
        return self._max_repeat(value, flags, "+")

    def _groupref(self, group: int, flags: int) -> str:
        return f"(?:\\{group + self.groups_before})"

    def _assert(self, value: tuple, flags: int) -> str:
        ahead, items = value
        return f"(?{'' if ahead >= 0 else '<'}={self.sequence(items, flags)})"

    def _assert_not(self, value: tuple, flags: int) -> str:
        ahead, items = value
        return f"(?{'' if ahead >= 0 else '<'}!{self.sequence(items, flags)})"

    def _failure(self, value: Any, flags: int) -> str:
        return "(?!)"

    def _at(self, place: Any, flags: int) -> str:
        many = flags & re.M
        return {
            "AT_BEGINNING": r"(?:\A|(?<=\n))" if many else r"\A",
            "AT_BEGINNING_STRING": r"\A",
            "AT_END": r"(?=\n|\z)" if many else r"(?=\n?\z)",
            "AT_END_STRING": r"\z",
            "AT_BOUNDARY": f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))",
            "AT_NON_BOUNDARY": f"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))",
        }[str(place)]


def _rigid(items: Any) -> bool:
    """Whether a loop over ``items`` is walked without recursion: one shape of one length."""
    for op, value in items:
        kind = str(op)
        if kind in ("LITERAL", "NOT_LITERAL", "ANY", "IN"):
            continue
        if kind == "SUBPATTERN" and _rigid(value[3]):
            continue
        if kind == "MAX_REPEAT" and value[0] == value[1] and _rigid(value[2]):
            continue
        return False
    return True
