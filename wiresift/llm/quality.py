"""Quality rules: a decision list learned from labelled text statistics.

Sequential covering: a rule for the unwanted class grows threshold by threshold on
one part of the labelled rows, is pruned on the other, takes away what it covers,
and so on. The list is a chain of Spark conditional expressions over statistics
that anyone can read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiresift.llm.common import long_id, pieces

#: Labelled rows that a list is learned from, at most.
MAX_LABELLED = 20_000
MIN_WORDS = 50
REPEAT_PERCENT = 50

STATISTICS = ("n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
              "n_upper", "n_digits", "n_marks", "n_stops", "n_distinct_words", "max_word_uses",
              "n_lone_marks", "n_short_words")
_SPACES = b" \t\n\x0b\x0c\r"
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOLS = b"#*$%&|<>"
_MARKS = b"!?;:"


def _absent(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The numbers named in ``STATISTICS`` for a whole text; all 0 for a null or empty one."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    seen: set[bytes] = set()
    dup_lines = lines = 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup_lines += 1
            seen.add(line)
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    most = int(np.bincount(at).max()) if words else 0
    lone = sum(1 for w in ids if not w.strip(b"#*$%&|<>!?;:.,-_=+/\\()[]{}'\"~^`@"))
    return (
        len(text), len(words), len(text) - _absent(data, _SPACES), _absent(data, _SYMBOLS), dup_lines,
        _repeat_words(at, len(ids)), lines, _absent(data, _UPPER), _absent(data, _DIGITS), _absent(data, _MARKS),
        data.count(b"."), len(ids), most, lone, sum(1 for w in words if len(w) <= 2))


def _repeat_words(at: np.ndarray, vocabulary: int) -> int:
    """Words that lie in three-word windows which occur more than once."""
    if len(at) < 4 or vocabulary == len(at):
        return 0
    pairs = np.unique(at[:-1] * vocabulary + at[1:], return_inverse=True)[1]
    windows = pairs[:-1] * vocabulary + at[2:]
    _, inverse, uses = np.unique(windows, return_inverse=True, return_counts=True)
    hit = uses[inverse] > 1
    inside = np.zeros(len(at), bool)
    for shift in range(3):
        inside[shift:len(at) - 2 + shift] |= hit
    return int(inside.sum())


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one struct column ``statistics`` of longs.

    All columns are kept as they are; one of that name is replaced. No shuffle.
    """
    docs = docs.drop("statistics")
    names = docs.columns
    where = names.index(text_col)
    struct = T.StructType([T.StructField(n, T.LongType()) for n in STATISTICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            found = [text_statistics(t) for t in batch.column(where).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=False)] if found else [
                pa.array([], pa.int64()) for _ in STATISTICS]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.StructArray.from_arrays(columns, names=list(STATISTICS))],
                names=[*names, "statistics"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("statistics", struct)]))


def base_failed(s: str = "statistics") -> Column:
    words, repeats = F.col(f"{s}.n_words"), F.col(f"{s}.n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * words)


def features(s: str = "statistics") -> dict[str, Column]:
    """What rules compare: shares of words, characters and lines."""
    def share(part: str, whole: str) -> Column:
        return F.col(f"{s}.{part}").cast("double") / F.greatest(F.col(f"{s}.{whole}"), F.lit(1))
    return {
        "word_length": share("word_chars", "n_words"), "symbols_per_word": share("n_symbols", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"), "repeat_words": share("n_repeat_words", "n_words"),
        "upper": share("n_upper", "word_chars"), "digits": share("n_digits", "word_chars"),
        "marks_per_word": share("n_marks", "n_words"), "stops_per_word": share("n_stops", "n_words"),
        "distinct_words": share("n_distinct_words", "n_words"), "top_word": share("max_word_uses", "n_words"),
        "lone_marks": share("n_lone_marks", "n_distinct_words"), "short_words": share("n_short_words", "n_words"),
        "words_per_line": share("n_words", "n_lines"), "words": F.col(f"{s}.n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.threshold if self.above else values <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.threshold if self.above else of[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a row that one of them covers is unwanted, any other is kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def rejects(self, values: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(next(iter(values.values()))), bool)
        for rule in self.rules:
            out |= _covers(rule, values)
        return out

    def keeps(self, of: dict[str, Column] | None = None) -> Column:
        """``CASE WHEN rule 1 THEN false WHEN rule 2 THEN false ... ELSE true END``."""
        of = of or features()
        chain = None
        for rule in self.rules:
            test = rule[0].column(of)
            for condition in rule[1:]:
                test = test & condition.column(of)
            chain = F.when(test, False) if chain is None else chain.when(test, False)
        return F.lit(True) if chain is None else chain.otherwise(True)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) + "\nelse keep"


def _covers(rule: Sequence[Condition], values: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(values.values()))), bool)
    for condition in rule:
        out &= condition.holds(values[condition.feature])
    return out


def learn(values: dict[str, np.ndarray], unwanted: np.ndarray, max_conditions: int = 4, max_rules: int = 24,
          min_precision: float = 0.9, min_cover: int = 3, thresholds: int = 64) -> DecisionList:
    """A decision list for rows with ``values`` by feature, of which some are ``unwanted``.

    Every third row prunes, the others grow. A rule is kept if, on the pruning rows,
    at least ``min_precision`` of what it covers is unwanted and the covered rows
    are at least ``min_cover`` in all. Rows of one class give an empty list.
    """
    unwanted = np.asarray(unwanted, bool)
    grow = np.arange(len(unwanted)) % 3 != 2
    open_rows = np.ones(len(unwanted), bool)
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < max_rules and (unwanted & grow & open_rows).any():
        rule = _grow(values, unwanted, grow & open_rows, max_conditions, thresholds)
        rule = _prune(rule, values, unwanted, ~grow & open_rows)
        if not rule:
            break
        held = _covers(rule, values) & open_rows
        check = held & ~grow
        precision = (unwanted & check).sum() / check.sum() if check.any() else (unwanted & held).sum() / held.sum()
        if held.sum() < min_cover or precision < min_precision or (unwanted & held).sum() < min_precision * held.sum():
            break
        rules.append(tuple(rule))
        open_rows &= ~held
    return DecisionList(tuple(rules))


def _grow(values: dict[str, np.ndarray], unwanted: np.ndarray, rows: np.ndarray, max_conditions: int,
          thresholds: int) -> list[Condition]:
    rule: list[Condition] = []
    rows = rows.copy()
    while len(rule) < max_conditions and (rows & ~unwanted).any():
        p0, n0 = (rows & unwanted).sum(), (rows & ~unwanted).sum()
        if not p0:
            break
        best, best_gain = None, 1e-9
        for name, column in values.items():
            here = column[rows]
            edges = np.unique(np.quantile(here, np.linspace(0, 1, thresholds + 1)[1:-1]))
            order = np.sort(here[unwanted[rows]])
            clean = np.sort(here[~unwanted[rows]])
            # Half-way to the next value, so that a threshold lies between the rows it parts.
            both = np.unique(here)
            up = both[np.minimum(np.searchsorted(both, edges, side="right"), len(both) - 1)]
            edges = np.unique((edges + up) / 2)
            low_p = np.searchsorted(order, edges, side="right")
            low_n = np.searchsorted(clean, edges, side="right")
            for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0)
                at = int(gain.argmax())
                if gain[at] > best_gain:
                    best, best_gain = Condition(name, above, float(edges[at])), gain[at]
        if best is None:
            break
        rule.append(best)
        rows &= best.holds(values[best.feature])
    return rule


def _prune(rule: list[Condition], values: dict[str, np.ndarray], unwanted: np.ndarray,
           rows: np.ndarray) -> list[Condition]:
    def worth(r: list[Condition]) -> float:
        held = _covers(r, values) & rows
        n = held.sum()
        return (2 * (held & unwanted).sum() - n) / n if n else -1.0
    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) > worth(best):
            best = rule[:k]
    return best


def learn_from(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DecisionList:
    """A list from ``docs`` (doc_id, text) whose ids ``labels`` (doc_id, quality) names.

    Statistics are taken of at most ``max_labelled`` labelled documents, those with
    the smallest hashes of their ids; the bound is what lets the ids be broadcast.
    Labels without id or class are left out, an id with both classes counts as good.
    """
    sample = (
        labels.select(long_id("doc_id").alias("labelled"), F.col("quality").cast("int").alias("quality"))
        .dropna().groupBy("labelled").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("labelled"), "labelled").limit(max_labelled)
    )
    named = docs.select(long_id("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = with_statistics(named.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled")).drop("labelled"))
    of = features()
    # An id may be repeated in ``docs``; the bound holds for the rows, too.
    table = (
        rows.where(~base_failed()).select("doc_id", "quality", *(c.alias(n) for n, c in of.items()))
        .orderBy(F.xxhash64("doc_id"), "doc_id", *of).limit(max_labelled).toPandas()
    )
    if table.empty:
        return DecisionList()
    return learn({n: table[n].to_numpy(np.float64) for n in of}, table["quality"].to_numpy() == 0)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of ``docs`` with ``statistics``, ``base_failed`` and ``kept``."""
    rows = with_statistics(docs.drop("base_failed", "kept"))
    failed = base_failed()
    return rows.withColumns({"base_failed": failed, "kept": ~failed & rules.keeps()})
