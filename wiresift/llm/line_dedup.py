"""Removal of repeated and nearly repeated lines, earliest kept, in DataFrame operations only.

Texts are split once, into a stored table of line hashes. Exact repeats of all lines
that are not blank are found by a 128-bit hash of the trimmed line. Lines one edit apart,
if they are long enough for an edit to be a small change, are found through their deletion neighbourhoods: lines that become equal when one
character goes share a hashed variant. A line of n characters has n such variants
of n characters each, so they are narrowed first:

1. One edit leaves the first or the last half as it was. Only lines that share a
   half with another line of fitting length go on.
2. It also lies within one of about sqrt(n) blocks. The variants without a block
   are hashed, and only the blocks whose variant is shared go on.
3. Within such a block all variants with one character deleted are hashed and
   joined. Lines with equal variants deleted at the same place differ in that
   character alone, so each of them is held against the earliest, not in pairs.

What is found is verified by edit distance on the whole lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiresift.llm.common import small
from wiresift.session import cut

#: Characters from which on lines are also compared up to an edit.
NEAR_CHARS = 20
MAX_EDITS = 1
_BLANK = " \t\r\x0b\x0c"


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")]


def _split(docs: DataFrame) -> DataFrame:
    """(doc, whole, pos, line, h1, h2) of the lines that are not blank; ``pos`` is from 0, ``whole`` the text's hash."""
    return (
        docs.select("doc", F.xxhash64("text").alias("whole"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc", "whole", "pos", F.trim("line", F.lit(_BLANK)).alias("line")).where("line <> ''")
        .select("doc", "whole", "pos", "line", *_hashes(F.col("line")))
    )


def _place() -> Column:
    """Order of lines: by document, those without an id last, and place within."""
    return F.struct(F.col("doc").isNull().alias("unknown"), F.col("doc").alias("doc"), F.col("pos").alias("pos"))


def _halves() -> Column:
    """Hashes of the halves that a line shares with any line one edit away.

    With the shorter line of such a pair ``size`` long, at least size div 2
    characters agree at the start or at the end. A line stands for both sizes: its
    own, and as the longer line one less.
    """
    return F.expr("""
      transform(array(char_length(line), char_length(line) - 1, -char_length(line), 1 - char_length(line)),
        size -> xxhash64(size, IF(size > 0, left(line, size div 2), right(line, -size div 2))))""")


_BLOCKS = """
  flatten(transform(array(char_length(line), char_length(line) - 1), size ->
    transform(sequence(0, greatest(8, int(sqrt(size))) - 1), j -> named_struct('size', size,
      'before', j * ((size + greatest(8, int(sqrt(size))) - 1) div greatest(8, int(sqrt(size)))),
      'width', (size + greatest(8, int(sqrt(size))) - 1) div greatest(8, int(sqrt(size)))))))"""


def _near(docs: DataFrame, lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h1, h2) of the lines that lie one edit from a line with an earlier first place."""
    halves = lines.select("h1", "h2", F.explode("halves").alias("half"))
    shared = cut(
        halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half"))
    some = halves.join(small(shared), "half", "left_semi").select("h1", "h2").distinct()
    some = cut(some.join(firsts.select("h1", "h2", "first"), ["h1", "h2"]))
    # Only the documents in which these lines stand first are split again, for their texts.
    where = cut(some.select(F.col("first.doc").alias("at")).distinct())
    texts = cut(
        _split(docs.join(small(where), F.col("doc").eqNullSafe(F.col("at")), "left_semi")).select("h1", "h2", "line")
        .join(small(some), ["h1", "h2"]).dropDuplicates(["h1", "h2"]))

    # Variants without a block: what stands before and after it, and where.
    blocks = (
        texts.select("h1", "h2", "line", F.explode(F.expr(_BLOCKS)).alias("b")).select("h1", "h2", "line", "b.*")
        .where("before < size")
        .withColumn("after", F.expr("greatest(0, size - before - width)"))
        .withColumn("block", F.expr("xxhash64(size, before, left(line, before), right(line, after))"))
        .select("h1", "h2", "block", "size", "before", "after")
    )
    blocks = cut(blocks)
    shared_blocks = cut(
        blocks.groupBy("block").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("block"))
    inner = (
        blocks.join(small(shared_blocks), "block", "left_semi").join(texts, ["h1", "h2"])
        .withColumn("mid", F.expr("substring(line, before + 1, char_length(line) - before - after)"))
        .withColumn("longer", F.expr("char_length(line) > size"))
    )
    # One character deleted: at the same place, a replaced character; against a
    # whole line (place 0), an added one.
    variants = cut(inner.select("h1", "h2", "first", "block", F.explode(F.expr("""
        concat(IF(longer, array(), array(struct(0 AS at, 'whole' AS kind, xxhash64(mid) AS variant))),
          transform(filter(sequence(0, char_length(mid)), i -> i > 0), i -> struct(IF(longer, 0, i) AS at,
            IF(longer, 'longer', 'equal') AS kind,
            xxhash64(concat(left(mid, i - 1), substring(mid, i + 1))) AS variant)))""")).alias("v"))
        .select("h1", "h2", "first", "block", "v.*").distinct())
    key = ["block", "at", "variant"]
    who = F.struct("first", "h1", "h2")
    groups = variants.groupBy(*key).agg(
        F.count("*").alias("n"), F.min(F.when(F.col("kind") == "whole", who)).alias("whole"),
        F.min(F.when(F.col("kind") != "whole", who)).alias("other")).where("n > 1").drop("n")
    earlier = F.when(F.col("kind") == "longer", F.col("whole")).otherwise(F.col("other"))
    found = (
        variants.join(groups, key).withColumn("earlier", earlier)
        .where(F.col("earlier") < F.struct("first", "h1", "h2"))
        .select("h1", "h2", F.col("earlier.h1").alias("e1"), F.col("earlier.h2").alias("e2")).distinct()
    )
    kept = texts.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("earlier_line"))
    return (
        found.join(texts.select("h1", "h2", "line"), ["h1", "h2"]).join(kept, ["e1", "e2"])
        .where(F.levenshtein("line", "earlier_line", 1).between(0, 1)).select("h1", "h2").distinct()
    )


def repeated_lines(docs: DataFrame, near_chars: int = NEAR_CHARS, max_edits: int = MAX_EDITS) -> DataFrame:
    """(doc, whole, dropped) per document of ``docs`` (doc, text) that loses lines: their places from 0.

    An id may stand in several rows, so a document is known by its id and its text's hash.
    """
    if max_edits not in (0, 1):
        raise ValueError("lines are compared up to 0 edits or 1")
    halves = F.when(F.char_length("line") >= near_chars, _halves()) if max_edits else F.lit(None).cast("array<bigint>")
    lines = cut(_split(docs).select("doc", "whole", "pos", "h1", "h2", halves.alias("halves")))
    firsts = cut(lines.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count("*").alias("n")))
    marked = firsts.where("n > 1").select("h1", "h2", "first", F.lit(False).alias("near"))
    if max_edits:
        near = cut(_near(docs, lines, firsts)).withColumn("near", F.lit(True))
        marked = (
            firsts.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left")
            .where("near OR n > 1").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")))
    marked = cut(marked)
    return (
        lines.select("doc", "whole", "pos", "h1", "h2", _place().alias("place")).join(small(marked), ["h1", "h2"])
        .where("near OR place <> first").groupBy("doc", "whole").agg(F.collect_set("pos").alias("dropped"))
    )


def dedup_lines(docs: DataFrame, near_chars: int = NEAR_CHARS, max_edits: int = MAX_EDITS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without lines that occur earlier, with ``n_lines`` and ``n_dropped``.

    Lines are compared without white space at their ends; blank ones always stay. Of
    equal lines, however short, the one in the document with the smallest id, at the
    first place, stays. Among lines of at least ``near_chars`` characters, one also goes
    wherever it stands if one within ``max_edits`` (0 or 1) edits has an earlier first
    place, whether or not that one goes, too. Documents without an id come last. Rows that
    share an id are one place: equal lines at the same place stay in each. A null
    text stays null and has 0 lines; an empty one has one. All columns are kept in
    order, but for ones named ``n_lines`` or ``n_dropped``; lines that stay keep
    their text as it was, joined by line feeds. A document that loses every line
    has an empty text.
    """
    docs = docs.drop("n_lines", "n_dropped")
    named = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    drops = repeated_lines(named, near_chars, max_edits).select(
        F.col("doc").alias("__doc"), F.col("whole").alias("__whole"), F.col("dropped").alias("__dropped"))
    split = F.split(F.col(text_col), "\n", -1)
    kept = F.concat_ws("\n", F.filter(F.col("__lines"), lambda _, i: ~F.array_contains("__dropped", i)))
    return (
        docs.join(drops, F.col(id_col).cast("long").eqNullSafe(F.col("__doc"))
                  & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__whole")), "left")
        .withColumn("__lines", F.when(F.col("__dropped").isNotNull(), split))
        .select(*(F.when(F.col("__dropped").isNull(), F.col(text_col)).otherwise(kept).alias(text_col)
                  if c == text_col else F.col(f"`{c}`") for c in docs.columns),
                F.when(F.col(text_col).isNull(), 0).otherwise(
                    F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)
                .cast("long").alias("n_lines"),
                F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"))
    )


#: The same rows in SQL: variants of the whole line, all of them, joined and verified.
ORACLE = f"""
WITH l AS (
  SELECT doc_id, pos - 1 AS pos, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
f AS (SELECT line, min((doc_id, pos)) AS first FROM l WHERE line <> '' GROUP BY line),
e AS (SELECT * FROM f WHERE length(line) >= {NEAR_CHARS}),
v AS (
  SELECT line, first, 0 AS k, hash(line) AS h FROM e
  UNION ALL SELECT line, first, k, hash(left(line, k - 1) || substr(line, k + 1)) FROM (
    SELECT line, first, unnest(range(1, length(line) + 1)) AS k FROM e)),
c AS (SELECT h FROM v GROUP BY h HAVING count(DISTINCT line) > 1),
s AS (SELECT DISTINCT line, first, h FROM v WHERE h IN (SELECT h FROM c)),
near AS (SELECT DISTINCT b.line FROM s a JOIN s b ON a.h = b.h AND a.first < b.first
  WHERE levenshtein(a.line, b.line) <= {MAX_EDITS}),
m AS (SELECT l.doc_id, l.pos, f.line IS NOT NULL AND (n.line IS NOT NULL OR f.first <> (l.doc_id, l.pos)) AS gone
  FROM l LEFT JOIN f ON l.line = f.line LEFT JOIN near n ON l.line = n.line),
p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
  count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped
FROM p JOIN m USING (doc_id, pos) GROUP BY doc_id
"""
