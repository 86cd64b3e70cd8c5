"""Thousands of rules at once: a rule table, an index of required literals, and verification.

A rule as a column expression costs one test of every buffer and a branch of the
plan. Here the rules are rows. From each pattern's parse tree come literals of which
every match must contain one; each literal is known by its rarest run of four bytes.
One pass over the buffers compares their runs with those of all rules, looks for the
literals whose run is there, and only the rules with a literal that occurs are tried,
as columns of a join. The plan is the same for one
rule and for a hundred thousand.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiresift import dialect
from wiresift.functions.bytestr import byte_text, let
from wiresift.operators.matchers import string_literal
from wiresift.operators.scope import scope, scope_base
from wiresift.session import cut
from wiresift.spec import ANY, MODE_ORDER, InspectSpec, Rule, SignatureString

GRAM = 4
#: Rules that a driver-side list, or a broadcast of the table, may hold.
MOST_LISTED = 10_000
#: Keys that one pass over the buffers looks for; more rules take more passes.
KEYS_A_PASS = 1 << 20
#: Share of the buffers on which runs are counted to find the rare ones; results do not depend on it.
SAMPLE = 0.01
#: The columns of a rule table.
RULES = ("rule_id", "mode", "priority", "direction", "pattern", "flags", "threshold", "namespace", "rule_name",
         "source_file", "meta", "condition", "strings")
_PREPARED = (
    "rule_id int, mode string, place int, priority int, direction string, java string, literal binary, needed int, "
    "strings array<struct<java:string,last:string,literal:binary>>, required array<array<binary>>")
_BUCKETS = 1 << 16
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[ord("A"):ord("Z") + 1] += 32


# Rules from rows.

def rule_of(row: dict[str, Any]) -> Rule:
    """A rule from a row of the rule table; missing columns and nulls stand for the defaults."""
    known = {k: row[k] for k in RULES if row.get(k) is not None and k not in ("strings", "meta")}
    strings = tuple(SignatureString(s["id"], s["kind"], s["pattern"])
                    for s in (row["strings"] if row.get("strings") is not None else ()))
    meta = row.get("meta") if row.get("meta") is not None else {}
    return Rule(**known, strings=strings, meta=tuple(sorted(dict(meta).items())))


def rules_from(rules: DataFrame, most: int = MOST_LISTED) -> tuple[Rule, ...]:
    """The rules of a table as a tuple, for an ``InspectSpec``; at most ``most``. Larger tables go to ``inspect_by_table``."""
    rows = rules.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the table has more than {most} rules; inspect_by_table takes it as it is")
    return tuple(rule_of(r.asDict(recursive=True)) for r in rows)


# Required literals.

def required_literals(pattern: str, flags: str = "") -> list[list[bytes]]:
    """Sets of literals, lower-case, from each of which every match of a pattern contains one."""
    return _of_sequence(dialect.parsed(pattern, flags))


def _of_sequence(items: Any) -> list[list[bytes]]:
    found: list[list[bytes]] = []
    run = bytearray()

    def end_run() -> None:
        if len(run) >= GRAM:
            found.append([bytes(run).lower()])
        run.clear()

    def walk(nodes: Any) -> None:
        for op, value in nodes:
            kind = str(op)
            if kind == "LITERAL":
                run.append(value)
            elif kind == "SUBPATTERN":
                walk(value[3])
            elif kind in ("AT", "ASSERT", "ASSERT_NOT"):
                continue
            else:
                end_run()
                if kind == "BRANCH":
                    branches = [_of_sequence(b) for b in value[1]]
                    if all(branches):
                        found.append([x for b in branches for x in min(b, key=len)])
                elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
                    found.extend(_of_sequence(value[2]))
                elif kind == "ATOMIC_GROUP":
                    found.extend(_of_sequence(value))

    walk(items)
    end_run()
    return found


def _required(rule: Rule) -> list[list[bytes]]:
    if rule.mode == "regex":
        return required_literals(rule.pattern, rule.flags)
    if rule.mode == "bytesig":
        literal = bytes.fromhex(rule.pattern).lower()
        return [[literal]] if len(literal) >= GRAM else []
    sets = []
    for s in rule.strings:
        if s.kind == "regex":
            own = required_literals(s.pattern, "s")
        else:
            literal = string_literal(s).encode("latin-1").lower()
            own = [[literal]] if len(literal) >= GRAM else []
        sets.append(min(own, key=len) if own else None)
    # Of m strings with n needed, any m - n + 1 hold one that occurs.
    enough = sorted((s for s in sets if s), key=len)[:len(sets) - rule.needed_strings() + 1]
    return [[x for s in enough for x in s]] if len(enough) == len(sets) - rule.needed_strings() + 1 else []


def prepared(rules: DataFrame) -> DataFrame:
    """The rule table with Java patterns, literals and what every match requires; bad rules raise an error."""
    names = ["rule_id", "mode", "place", "priority", "direction", "java", "literal", "needed", "strings", "required"]

    def prepare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                rule = rule_of({k: v for k, v in row.items() if isinstance(v, (list, dict, np.ndarray)) or not pd.isna(v)})
                if rule.mode == "fuzzy":
                    raise ValueError("fuzzy rules have no place in a rule table; give them as an InspectSpec")
                strings = [
                    {"java": dialect.java(s.pattern, "s"), "last": f"(?s)\\A(.*)(?:{dialect.java(s.pattern, 's', 1)})", "literal": None}
                    if s.kind == "regex" else {"java": None, "last": None, "literal": string_literal(s).encode("latin-1")}
                    for s in rule.strings]
                out.append((
                    rule.rule_id, rule.mode, MODE_ORDER[rule.mode], rule.priority, rule.direction,
                    dialect.java(rule.pattern, rule.flags) if rule.mode == "regex" else None,
                    bytes.fromhex(rule.pattern) if rule.mode == "bytesig" else None,
                    rule.needed_strings() if rule.strings else None, strings, _required(rule)))
            yield pd.DataFrame(out, columns=names)

    have = [c for c in RULES if c in rules.columns]
    return rules.select(*have).mapInPandas(prepare, _PREPARED)


# The index.

def grams(data: bytes) -> np.ndarray:
    """The runs of four bytes of ``data``, lower-case, as numbers."""
    if len(data) < GRAM:
        return np.empty(0, np.uint32)
    low = _LOWER[np.frombuffer(data, np.uint8)]
    return low[:-3] << np.uint32(24) | low[1:-2] << np.uint32(16) | low[2:-1] << np.uint32(8) | low[3:]


def _bucket(runs: np.ndarray) -> np.ndarray:
    return (runs * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _frequencies(buffers: DataFrame, share: float) -> np.ndarray:
    """How often runs of each hash bucket occur in a share of the buffers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BUCKETS, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += np.bincount(_bucket(grams(data or b"")), minlength=_BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(_BUCKETS, np.int64)
    for row in buffers.select("payload").sample(share, seed=1).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(
            F.sum("n").alias("n")).collect():  # a row a bucket
        out[row.bucket] = row.n
    return out


@dataclass
class Index:
    """Runs with the rules and literals that they stand for, sorted by run, and the rules that no literal speaks for."""

    runs: np.ndarray
    owners: np.ndarray
    literals: list[bytes]
    always: np.ndarray

    def parts(self, size: int) -> Iterator[Index]:
        """The index in parts of bounded size; the rules without a literal are in the first."""
        for at in range(0, max(1, len(self.runs)), size):
            yield Index(self.runs[at:at + size], self.owners[at:at + size], self.literals[at:at + size],
                        self.always if at == 0 else self.always[:0])


def index(ready: DataFrame, often: np.ndarray) -> Index:
    entries, always = [], []
    for row in ready.select("rule_id", "required").toLocalIterator():
        best = None
        for literals in row.required or ():
            keys = {}
            for literal in map(bytes, literals):
                own = np.unique(grams(literal))
                keys[literal] = own[np.argmin(often[_bucket(own)])]
            cost = int(often[_bucket(np.array(list(keys.values()), np.uint32))].sum()), len(keys)
            if best is None or cost < best[0]:
                best = cost, keys
        if best is None:
            always.append(row.rule_id)
        else:
            entries += [(int(run), row.rule_id, literal) for literal, run in best[1].items()]
    entries.sort()
    return Index(np.array([e[0] for e in entries], np.uint32), np.array([e[1] for e in entries], np.int32),
                 [e[2] for e in entries], np.array(sorted(always), np.int32))


def with_candidates(df: DataFrame, part: Index) -> DataFrame:
    """The rows of ``df`` that a rule may hit, with ``_rules``, the ids of those rules."""
    at = df.columns.index("payload")
    names = [*df.columns, "_rules"]
    owners, literals, always = part.owners.tolist(), part.literals, part.always.tolist()
    keys, starts = np.unique(part.runs, return_index=True)
    ends = np.append(starts[1:], len(owners))
    # Most runs of a buffer fall into no bucket of a key.
    wanted = np.zeros(_BUCKETS, bool)
    wanted[_bucket(keys)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                rows = batch.slice(first, 512)
                found = []
                for data in rows.column(at).to_pylist():
                    hits = set(always)
                    own = grams(data or b"")
                    own = np.unique(own[wanted[_bucket(own)]])
                    if len(own) and len(keys):
                        place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                        place = place[keys[place] == own]
                        low = data.lower()
                        for a, b in zip(starts[place].tolist(), ends[place].tolist(), strict=True):
                            hits.update(owners[i] for i in range(a, b) if literals[i] in low)
                    found.append(sorted(hits))
                some = [i for i, f in enumerate(found) if f]
                if some:
                    rows = rows.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array([found[i] for i in some], pa.list_(pa.int32()))], names=names)

    schema = T.StructType([*df.schema.fields, T.StructField("_rules", T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(run, schema)


# Verification.

def _verified(buf: Column, drop_empty: bool) -> Column:
    """Struct (start, end) of the hit of the rule that stands in the row's columns, or null."""
    def span(start: Column, end: Column) -> Column:
        return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))

    java, literal = F.col("java"), byte_text(F.col("literal"))
    start = F.regexp_instr(buf, java) - 1
    size = F.coalesce(F.length(F.regexp_substr(buf, java)), F.lit(0))
    matched = F.rlike(buf, java) & (size > 0) if drop_empty else F.rlike(buf, java)

    def occurs(s: Column) -> Column:
        return F.when(s["java"].isNotNull(), F.rlike(buf, s["java"])).otherwise(F.contains(buf, byte_text(s["literal"])))

    def last(s: Column) -> Column:
        begin = F.length(F.call_function("regexp_extract", buf, s["last"], F.lit(1)))
        rest = F.length(F.regexp_substr(F.substring(buf, begin + 1, F.length(buf)), s["java"]))
        text = byte_text(s["literal"])
        end = F.length(buf) - F.call_function("instr", F.reverse(buf), F.reverse(text)) + 1
        return F.when(s["java"].isNotNull(), span(begin, begin + F.coalesce(rest, F.lit(0)))) \
            .otherwise(span(end - F.length(text), end))

    found = F.filter("strings", occurs)
    return (
        F.when(F.col("mode") == "regex", F.when(matched, span(start, start + size)))
        .when(F.col("mode") == "bytesig", F.when(F.contains(buf, literal), span(
            F.call_function("instr", buf, literal) - 1, F.length(buf))))
        .otherwise(let(found, lambda f: F.when(F.size(f) >= F.col("needed"), last(F.element_at(f, -1)))))
    )


def inspect_by_table(df: DataFrame, rules: DataFrame, keep: Sequence[str], offset: int = 0, depth: int = 0,
                     first: bool = False, drop_empty: bool = False, sample: float = SAMPLE) -> DataFrame:
    """Hits of a rule table in buffers that stand alone: a row for each buffer and rule that hits, or the first of each.

    ``df`` has ``payload`` and ``direction``; ``keep`` names the columns that tell its
    rows apart. ``rules`` has the columns of ``RULES``, or some of them, with regex,
    bytesig and signature rules of any number; ``rule_id`` must be unique. Spans are
    those of ``inspect_all_rules``. With ``first``, a buffer's first hit in the order of
    modes, priority and id. A rule without a literal of four bytes in each match is tried
    on every buffer.
    """
    spec = InspectSpec(offset=offset, depth=depth)
    ready = cut(prepared(rules))
    parts = list(index(ready, _frequencies(df, sample)).parts(KEYS_A_PASS))
    columns = ready.drop("required").withColumnRenamed("direction", "_scope")
    if ready.count() <= MOST_LISTED:
        columns = F.broadcast(columns)
    # Several passes where the keys are more than one may hold; a rule's keys may fall into two of them.
    found = None
    for part in parts:
        some = with_candidates(df.select(*dict.fromkeys((*keep, "payload", "direction"))), part)
        text = some.withColumn("_text", byte_text(F.col("payload")))
        scoped = text.withColumns({"_buf": scope(F.col("_text"), spec), "_base": scope_base(F.length("_text"), spec)}).drop("_text")
        tried = scoped.withColumn("rule_id", F.explode("_rules")).drop("_rules").join(columns, "rule_id") \
            .where((F.col("_scope") == ANY) | (F.col("_scope") == F.col("direction")))
        hits = tried.withColumn("_hit", _verified(F.col("_buf"), drop_empty)).where("_hit IS NOT NULL").select(
            *keep, "rule_id", "mode", "place", "priority",
            (F.col("_base") + F.col("_hit.start")).alias("start_off"), (F.col("_base") + F.col("_hit.end")).alias("end_off"),
            (F.col("_hit.end") - F.col("_hit.start")).alias("size"))
        found = hits if found is None else found.unionByName(hits)
    if len(parts) > 1:
        found = found.dropDuplicates([*keep, "rule_id"])
    if first:
        rest = ("rule_id", "mode", "start_off", "end_off", "size")
        found = found.groupBy(*keep).agg(
            F.min_by(F.struct(*rest), F.struct("place", "priority", "rule_id")).alias("_first")).select(*keep, "_first.*")
    return found.select(*keep, "rule_id", "mode", "start_off", "end_off", "size")
