"""Content rules over documents, pages and conversation streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiresift.functions import text as X
from wiresift.operators import rule_table
from wiresift.operators import scope as S
from wiresift.operators.annotate import match_pieces, packet_span as spans, rule_expr, with_rule_meta
from wiresift.operators.datagrams import inspect_all_rules, inspect_datagrams
from wiresift.operators.streams import first_hits, inspect_streams, line_mode as lines
from wiresift.plans.registry import (
    CHUNKS, DOCS, LONG_PREFIXES, PREFIXES, first_of_prefix, multi_of_prefix, query)
from wiresift.session import cut
from wiresift.sources import tables as T
from wiresift.spec import InspectSpec, Rule, SignatureString

SPAN = ["start_off", "end_off", "size"]


def as_text(col: str = "data"):
    return F.decode(F.col(col), "UTF-8").alias(col)


# ---- datagrams -------------------------------------------------------------

WORD = "th[a-z]{2,6}ing"


def span_sql(pattern: str, source: str = "docs", text: str = "text", key: str = "doc_id") -> str:
    """SQL for the leftmost match of a context-free pattern."""
    return f"""m AS (SELECT *, regexp_extract({text}, '{pattern}') AS hit FROM {source}
  WHERE regexp_matches({text}, '{pattern}')),
sp AS (SELECT {key}, direction, strlen(substr({text}, 1, instr({text}, hit) - 1)) AS start_off,
  strlen(substr({text}, 1, instr({text}, hit) - 1)) + strlen(hit) AS end_off, strlen(hit) AS size, hit AS data FROM m)"""


def regex_on_documents(spark: SparkSession, sf_dir: str, pattern: str, flags: str = "sm", **opts) -> DataFrame:
    spec = InspectSpec(rules=(Rule(1, pattern=pattern, flags=flags),), **opts)
    return inspect_datagrams(T.documents(spark, sf_dir), spec, ["doc_id", "direction"])


@query(f"WITH {DOCS}, {span_sql(WORD)} SELECT * FROM sp")
def datagram_regex_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regex_on_documents(spark, sf_dir, WORD).select("doc_id", "direction", *SPAN, as_text())


@query(f"""WITH {DOCS} SELECT doc_id, direction, 0 AS start_off, strlen(text) AS end_off, strlen(text) AS size
FROM docs WHERE NOT regexp_matches(text, '{WORD}')""")
def datagram_regex_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regex_on_documents(spark, sf_dir, WORD, invert=True).select("doc_id", "direction", *SPAN)


NAMED = "(?P<start>th[a-z]+)(?P<end>ing|ed)"
UTF8 = "[a-z]+(?:ción|ère|ü)"
BRACES = '{"k": [1-4]?7}'


@query(f"WITH {DOCS}, {span_sql(NAMED)} SELECT * FROM sp")
def datagram_regex_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named groups, as Python writes them."""
    return regex_on_documents(spark, sf_dir, NAMED).select("doc_id", "direction", *SPAN, as_text())


@query(f"WITH {DOCS}, {span_sql(UTF8)} SELECT * FROM sp")
def datagram_regex_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters beyond ASCII, found as their bytes."""
    return regex_on_documents(spark, sf_dir, UTF8).select("doc_id", "direction", *SPAN, as_text())


@query(f"""SELECT event_id, instr(props, regexp_extract(props, '{BRACES}')) - 1 AS start_off,
  strlen(regexp_extract(props, '{BRACES}')) AS size FROM events WHERE regexp_matches(props, '{BRACES}')""")
def datagram_regex_braces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brace that opens no repeat is a brace, and a repeat may lack its lower bound."""
    rows = T.table(spark, sf_dir, "events").select("event_id", F.lit("CTS").alias("direction"), T.utf8("props").alias("payload"))
    rule = Rule(1, pattern=BRACES.replace("?", "{,1}"))
    return inspect_datagrams(rows, InspectSpec(rules=(rule,)), ["event_id"]).select("event_id", "start_off", "size")


ICASE = "(?:the|de) [a-z]+(?:ing|eau)"


@query(f"WITH {DOCS}, {span_sql('(?i)' + ICASE)} SELECT doc_id, start_off, end_off, size, data FROM sp")
def datagram_regex_icase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regex_on_documents(spark, sf_dir, ICASE, "smi").select("doc_id", *SPAN, as_text())


DOTALL = "In.*of"


@query(f"WITH {DOCS}, {span_sql('(?s)' + DOTALL)} SELECT doc_id, start_off, end_off, size FROM sp")
def datagram_regex_dotall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regex_on_documents(spark, sf_dir, DOTALL).select("doc_id", *SPAN)


LINE_START = "[A-Z][a-z]+ of "


@query(f"""WITH {DOCS}, l AS (SELECT doc_id, chr(10) || text AS t FROM docs),
h AS (SELECT *, regexp_extract(t, '\\n{LINE_START}') AS hit FROM l WHERE regexp_matches(t, '\\n{LINE_START}'))
SELECT doc_id, strlen(substr(t, 1, instr(t, hit) - 1)) AS start_off, strlen(hit) - 1 AS size FROM h""")
def datagram_regex_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regex_on_documents(spark, sf_dir, "^" + LINE_START).select("doc_id", "start_off", "size")


OFFSET, DEPTH = 150, 500
HEX_PATTERN = "7468(?:6[1-9A-F]|7[0-9A])+67"


@query(f"""WITH {DOCS}, b AS (SELECT doc_id, hex(encode(text)) AS h,
  CASE WHEN strlen(text) > {OFFSET} THEN {OFFSET} ELSE 0 END AS base FROM docs),
m AS (SELECT *, regexp_extract(substr(h, 2 * base + 1, 2 * {DEPTH}), '^((?:..)*?)({HEX_PATTERN})', ['pre', 'hit']) AS r
  FROM b WHERE regexp_matches(substr(h, 2 * base + 1, 2 * {DEPTH}), '^((?:..)*?)({HEX_PATTERN})'))
SELECT doc_id, base + length(r.pre) // 2 AS start_off, base + (length(r.pre) + length(r.hit)) // 2 AS end_off,
  length(r.hit) // 2 AS size FROM m""")
def datagram_offset_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset and depth count bytes, whatever the text's encoding."""
    return regex_on_documents(spark, sf_dir, "th[a-z]+g", offset=OFFSET, depth=DEPTH).select("doc_id", *SPAN)


SCRIPT = "<script>.*?</script>"


@query(f"""WITH pg AS (SELECT page_id, 'STC' AS direction, html AS text FROM pages),
{span_sql('(?s)' + SCRIPT, 'pg', key='page_id')} SELECT page_id, start_off, end_off, size, data FROM sp""")
def page_regex_lazy(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = InspectSpec(rules=(Rule(1, pattern=SCRIPT, direction="STC"),))
    return inspect_datagrams(T.pages(spark, sf_dir), spec, ["page_id"]).select("page_id", *SPAN, as_text())


@query(f"""WITH {DOCS} SELECT doc_id, direction, 1 AS rule_id FROM docs WHERE direction = 'CTS' AND contains(text, ' zu ')
UNION ALL SELECT doc_id, direction, 2 FROM docs WHERE direction = 'STC' AND contains(text, ' the ')
UNION ALL SELECT doc_id, direction, 3 FROM docs WHERE contains(text, ' de ')""")
def direction_scope_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (Rule(1, pattern=" zu ", direction="CTS"), Rule(2, pattern=" the ", direction="STC"),
             Rule(3, pattern=" de "))
    return inspect_all_rules(T.documents(spark, sf_dir), rules, InspectSpec(rules=rules),
                             ["doc_id", "direction"]).select("doc_id", "direction", "rule_id")


@query(f"""WITH {DOCS} SELECT direction, count(*) AS n, sum(strlen(text)) AS bytes FROM docs
WHERE direction = 'STC' GROUP BY 1""")
def direction_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = InspectSpec(rules=(Rule(1, pattern="x", direction="STC"),))
    kept = S.needed_directions(T.documents(spark, sf_dir), spec)
    return kept.groupBy("direction").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("payload")).alias("bytes"))


FUZZY, FUZZY_MIN = "threating", 78
# Over bytes: as the pattern is ASCII, each byte of another character is as good as any mark that it lacks.
FUZZY_SQL = f"""t AS (SELECT conv_id * 1000 + turn AS id, regexp_replace(regexp_replace(regexp_replace(text,
  '[\\x{{80}}-\\x{{7ff}}]', '##', 'g'), '[\\x{{800}}-\\x{{ffff}}]', '###', 'g'), '[\\x{{10000}}-\\x{{10ffff}}]', '####', 'g') AS t
  FROM conversations),
r AS (SELECT id, length(t) AS size, CASE WHEN length(t) = 0 THEN 0
  WHEN length(t) >= {len(FUZZY)} THEN CAST(round(100.0 * ({len(FUZZY)} - list_min(list_transform(
    range(1, length(t) - {len(FUZZY)} + 2), lambda i: levenshtein(substr(t, i, {len(FUZZY)}), '{FUZZY}'))))
    / {len(FUZZY)}) AS INT)
  ELSE CAST(round(100.0 * (length(t) - list_min(list_transform(range(1, {len(FUZZY)} + 2 - length(t)),
    lambda i: levenshtein(substr('{FUZZY}', i, length(t)), t)))) / length(t)) AS INT) END AS ratio FROM t)"""


def fuzzy_on_turns(spark: SparkSession, sf_dir: str, invert: bool) -> DataFrame:
    spec = InspectSpec(rules=(Rule(1, "fuzzy", FUZZY, threshold=FUZZY_MIN),), invert=invert)
    return inspect_datagrams(T.turns(spark, sf_dir), spec, ["id"]).select("id", *SPAN, "detail")


@query(f"""WITH {FUZZY_SQL} SELECT id, 0 AS start_off, size AS end_off, size,
  '(ratio: ' || ratio || ' >= threshold: {FUZZY_MIN})' AS detail FROM r WHERE ratio >= {FUZZY_MIN}""")
def fuzzy_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_on_turns(spark, sf_dir, False)


@query(f"""WITH {FUZZY_SQL} SELECT id, 0 AS start_off, size AS end_off, size,
  '(ratio: ' || ratio || ' | threshold: {FUZZY_MIN})' AS detail FROM r WHERE ratio < {FUZZY_MIN}""")
def fuzzy_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_on_turns(spark, sf_dir, True)


STRINGS = (SignatureString("a", "text", "track("), SignatureString("b", "hex", b"</p><p>".hex()),
           SignatureString("c", "regex", r"<h[1-3]>[A-Z]"))
STRING_SQL = (r"track\(", "</p><p>", "<h[1-3]>[A-Z]")
FOUND_SQL = " + ".join(f"regexp_matches(html, '{p}')::INT" for p in STRING_SQL)


def signature(rule_id: int, condition: str, **opts) -> Rule:
    fields = {"source_file": f"{condition}.rules", "strings": STRINGS, "rule_name": f"page_{condition}", **opts}
    return Rule(rule_id, "signature", condition=condition, **fields)


def last_sql(pattern: str) -> str:
    return f"regexp_extract(html, '(?s)^(.*)({pattern})', ['pre', 'hit'])"


def signature_sql(need: int) -> str:
    cases = " ".join(f"WHEN regexp_matches(html, '{p}') THEN {last_sql(p)}" for p in reversed(STRING_SQL))
    return f"""WITH f AS (SELECT page_id, CASE {cases} END AS r FROM pages WHERE {FOUND_SQL} >= {need})
SELECT page_id, strlen(r.pre) AS start_off, strlen(r.pre) + strlen(r.hit) AS end_off, strlen(r.hit) AS size FROM f"""


def signature_on_pages(spark: SparkSession, sf_dir: str, rules: tuple[Rule, ...], **opts) -> DataFrame:
    return inspect_all_rules(T.pages(spark, sf_dir), rules, InspectSpec(rules=rules, **opts), ["page_id"])


@query(signature_sql(1))
def signature_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_on_pages(spark, sf_dir, (signature(1, "any"),)).select("page_id", *SPAN)


@query(signature_sql(3))
def signature_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_on_pages(spark, sf_dir, (signature(1, "all"),)).select("page_id", *SPAN)


@query(signature_sql(2))
def signature_nof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_on_pages(spark, sf_dir, (signature(1, "2"),)).select("page_id", *SPAN)


@query(f"""SELECT page_id, 0 AS start_off, strlen(html) AS end_off, 1 AS rule_id FROM pages WHERE {FOUND_SQL} < 3
UNION ALL SELECT page_id, 0, strlen(html), 2 FROM pages WHERE NOT contains(html, 'track(1')""")
def signature_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = (SignatureString("z", "text", "track(1"),)
    rules = (signature(1, "all"), signature(2, "any", strings=one, source_file="track.rules"))
    return signature_on_pages(spark, sf_dir, rules, invert=True).select(
        "page_id", "start_off", "end_off", "rule_id")


@query(f"""WITH f AS (SELECT page_id, {last_sql('<a href="[^"]*">')} AS r FROM pages
  WHERE regexp_matches(html, '<a href="[^"]*">'))
SELECT page_id, strlen(r.pre) AS start_off, strlen(r.pre) + strlen(r.hit) AS end_off, r.hit AS data FROM f""")
def signature_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule(1, "signature", strings=(SignatureString("a", "regex", '<a href="[^"]*">'),))
    return signature_on_pages(spark, sf_dir, (rule,)).select("page_id", "start_off", "end_off", as_text())


@query(f"""SELECT page_id, 1 AS rule_id, 'page_any' AS rule_name, 'web' AS namespace, 'any.rules' AS source_file,
  'tester' AS author FROM pages WHERE {FOUND_SQL} >= 1
UNION ALL SELECT page_id, 2, 'page_2', 'web', '2.rules', NULL FROM pages WHERE {FOUND_SQL} >= 2""")
def rule_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (signature(1, "any", namespace="web", meta=(("author", "tester"),)), signature(2, "2", namespace="web"))
    hits = signature_on_pages(spark, sf_dir, rules).select("page_id", "rule_id")
    return with_rule_meta(hits, rules).select(
        "page_id", "rule_id", "rule_name", "namespace", "source_file",
        F.element_at("meta", F.lit("author")).alias("author"))


BYTES = "ng the".encode()


@query(f"""WITH {DOCS} SELECT doc_id, strlen(substr(text, 1, instr(text, '{BYTES.decode()}') - 1)) AS start_off,
  strlen(text) AS end_off, strlen(substr(text, instr(text, '{BYTES.decode()}'))) AS size
FROM docs WHERE contains(text, '{BYTES.decode()}')""")
def bytesig_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = InspectSpec(rules=(Rule(1, "bytesig", BYTES.hex()),))
    return inspect_datagrams(T.documents(spark, sf_dir), spec, ["doc_id"]).select("doc_id", *SPAN)


@query(f"""WITH {DOCS} SELECT doc_id, 0 AS start_off, strlen(text) AS end_off FROM docs
WHERE NOT contains(text, '{BYTES.decode()}')""")
def bytesig_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = InspectSpec(rules=(Rule(1, "bytesig", BYTES.hex()),), invert=True)
    return inspect_datagrams(T.documents(spark, sf_dir), spec, ["doc_id"]).select("doc_id", "start_off", "end_off")


PRIORITY = (
    Rule(1, pattern="zu[a-z]+ung", priority=1), Rule(2, pattern="the[a-z]+ing ", priority=2),
    Rule(3, "bytesig", "sión".encode().hex()),
    Rule(4, "signature", strings=(SignatureString("a", "text", "eau"), SignatureString("b", "text", " le ")),
         condition="all"))


@query(f"""WITH {DOCS} SELECT doc_id, CASE WHEN regexp_matches(text, 'zu[a-z]+ung') THEN 1
  WHEN regexp_matches(text, 'the[a-z]+ing ') THEN 2 WHEN contains(text, 'sión') THEN 3 ELSE 4 END AS rule_id
FROM docs WHERE regexp_matches(text, 'zu[a-z]+ung') OR regexp_matches(text, 'the[a-z]+ing ')
  OR contains(text, 'sión') OR (contains(text, 'eau') AND contains(text, ' le '))""")
def rule_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect_datagrams(T.documents(spark, sf_dir), InspectSpec(rules=PRIORITY), ["doc_id"]).select(
        "doc_id", "rule_id")


# ---- streams ---------------------------------------------------------------

FIRST = "th[a-z]{1,8}ing"
CROSS = "[a-z]{1,5}[.][A-Z][a-z]{1,5}"
OPEN_ENDED = "The.*ing"


def stream_matches(spark: SparkSession, sf_dir: str, *rules: Rule, **opts) -> DataFrame:
    return inspect_streams(T.chunks(spark, sf_dir), InspectSpec(rules=tuple(rules), **opts))


PLACE = ["flow_id", "direction", "chunk_no", *SPAN]


@query(f"WITH {first_of_prefix(FIRST)} SELECT flow_id, direction, chunk_no, start_off, end_off, size, 1 AS rule_id FROM fm")
def stream_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_matches(spark, sf_dir, Rule(1, pattern=FIRST)).select(*PLACE, "rule_id")


@query(f"WITH {first_of_prefix('(?s)' + OPEN_ENDED)} SELECT flow_id, direction, chunk_no, start_off, end_off, size FROM fm")
def stream_first_open_ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_matches(spark, sf_dir, Rule(1, pattern=OPEN_ENDED)).select(*PLACE)


@query(f"""WITH {first_of_prefix(CROSS, "direction = 'STC'")}
SELECT flow_id, direction, chunk_no, start_off, end_off, size FROM fm""")
def stream_first_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_matches(spark, sf_dir, Rule(1, pattern=CROSS, direction="STC")).select(*PLACE)


@query(f"""WITH {PREFIXES}, h AS (SELECT *, CASE WHEN regexp_matches(buf, 'zu[a-z]+ung') THEN 1
    WHEN regexp_matches(buf, 'the[a-z]+ing') THEN 2 ELSE 3 END AS rule_id,
    row_number() OVER (PARTITION BY flow_id ORDER BY chunk_no) AS rn FROM pre
  WHERE regexp_matches(buf, 'zu[a-z]+ung') OR regexp_matches(buf, 'the[a-z]+ing')
    OR (contains(buf, 'eau') AND contains(buf, ' le ')))
SELECT flow_id, direction, chunk_no, rule_id FROM h WHERE rn = 1""")
def stream_rule_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_matches(
        spark, sf_dir, Rule(1, pattern="zu[a-z]+ung", priority=1), Rule(2, pattern="the[a-z]+ing", priority=2),
        PRIORITY[3]).withColumn("rule_id", F.least("rule_id", F.lit(3))).select(
        "flow_id", "direction", "chunk_no", "rule_id")


@query(f"""WITH {PREFIXES}, h AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY chunk_no) AS rn
  FROM pre WHERE NOT regexp_matches(buf, 'th'))
SELECT flow_id, direction, chunk_no, 0 AS start_off, CAST(end_off AS BIGINT) AS end_off FROM h WHERE rn = 1""")
def stream_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_matches(spark, sf_dir, Rule(1, pattern="th"), invert=True).select(
        "flow_id", "direction", "chunk_no", "start_off", "end_off")


STREAM_OFFSET, STREAM_DEPTH = 300, 400


@query(f"""WITH {PREFIXES}, b AS (SELECT *, CASE WHEN end_off > {STREAM_OFFSET} THEN {STREAM_OFFSET} ELSE 0 END AS base,
    hex(encode(buf)) AS h FROM pre),
m AS (SELECT *, regexp_extract(substr(h, 2 * base + 1, 2 * {STREAM_DEPTH}), '^((?:..)*?)({HEX_PATTERN})', ['pre', 'hit']) AS r,
    row_number() OVER (PARTITION BY flow_id ORDER BY chunk_no) AS rn FROM b
  WHERE regexp_matches(substr(h, 2 * base + 1, 2 * {STREAM_DEPTH}), '^((?:..)*?)({HEX_PATTERN})'))
SELECT flow_id, direction, chunk_no, base + length(r.pre) // 2 AS start_off,
  base + (length(r.pre) + length(r.hit)) // 2 AS end_off, length(r.hit) // 2 AS size FROM m WHERE rn = 1""")
def stream_offset_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_matches(spark, sf_dir, Rule(1, pattern="th[a-z]+g"), offset=STREAM_OFFSET,
                          depth=STREAM_DEPTH).select(*PLACE)


@query(f"WITH {multi_of_prefix(FIRST)} SELECT flow_id, direction, chunk_no, match_no, start_off, end_off, size FROM mm")
def stream_multi_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_matches(spark, sf_dir, Rule(1, pattern=FIRST), multi_match=True).select(*PLACE, "match_no")


@query(f"""WITH {CHUNKS}, e AS (SELECT *, sum(len) OVER (PARTITION BY flow_id, direction ORDER BY chunk_no) AS end_off
  FROM ch WHERE len > 0)
SELECT flow_id, direction, chunk_no, CAST(end_off - len AS BIGINT) AS start_off, CAST(end_off AS BIGINT) AS end_off,
  row_number() OVER (PARTITION BY flow_id, direction ORDER BY chunk_no) AS match_no FROM e""")
def stream_multi_dotstar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``.*`` takes each chunk as it comes: the hits tile the stream."""
    return stream_matches(spark, sf_dir, Rule(1, pattern=".*"), multi_match=True).select(
        "flow_id", "direction", "chunk_no", "start_off", "end_off", "match_no")


LONG_BOUNDED = '7}{"k": 91}{"k": [2-4]'
LONG_OPEN = '"k": 91}{"k": 3.*"k": 92}{"k": 4.*"k": 93}'


@query(f"""WITH {first_of_prefix(LONG_BOUNDED, prefixes=LONG_PREFIXES)}
SELECT flow_id, direction, chunk_no, start_off, end_off, size FROM fm""")
def stream_long_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of thousands of chunks, with matches across chunks."""
    spec = InspectSpec(rules=(Rule(1, pattern=LONG_BOUNDED),))
    return inspect_streams(T.long_chunks(spark, sf_dir), spec).select(*PLACE)


@query(f"""WITH {first_of_prefix('(?s)' + LONG_OPEN, prefixes=LONG_PREFIXES)}
SELECT flow_id, direction, chunk_no, start_off, end_off, size FROM fm""")
def stream_long_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = InspectSpec(rules=(Rule(1, pattern=LONG_OPEN),))
    return inspect_streams(T.long_chunks(spark, sf_dir), spec).select(*PLACE)


LONG_STRINGS = ('91}{"k": 2', '92}{"k": 1')
LONG_DEPTH = 6000


@query(f"""WITH {LONG_PREFIXES}, w AS (SELECT *, substr(buf, 1, {LONG_DEPTH}) AS view FROM pre),
h AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY chunk_no) AS rn FROM w
  WHERE contains(view, '{LONG_STRINGS[0]}') AND contains(view, '{LONG_STRINGS[1]}'))
SELECT flow_id, direction, chunk_no,
  length(view) - strpos(reverse(view), reverse('{LONG_STRINGS[1]}')) - length('{LONG_STRINGS[1]}') + 1 AS start_off,
  length(view) - strpos(reverse(view), reverse('{LONG_STRINGS[1]}')) + 1 AS end_off FROM h WHERE rn = 1""")
def stream_long_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last instance of a rule's last string, within the depth."""
    rule = Rule(1, "signature", condition="all", strings=tuple(
        SignatureString(str(i), "text", x) for i, x in enumerate(LONG_STRINGS)))
    return inspect_streams(T.long_chunks(spark, sf_dir), InspectSpec(rules=(rule,), depth=LONG_DEPTH)).select(
        "flow_id", "direction", "chunk_no", "start_off", "end_off")


@query(f"""WITH {PREFIXES} SELECT flow_id FROM pre GROUP BY 1
HAVING bool_or(regexp_matches(buf, '[a-z]tion[^a-z]')) AND (bool_or(regexp_matches(buf, 'ing[.]\nThe')) OR NOT bool_or(contains(buf, ' the ')))""")
def stream_rule_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression over rules that hit in different chunks of a flow's streams."""
    rules = (Rule(1, pattern="[a-z]tion[^a-z]"), Rule(2, pattern="ing[.]\nThe"), Rule(3, pattern=" the "))
    hits = first_hits(T.chunks(spark, sf_dir), InspectSpec(rules=rules))
    return rule_expr(hits, ["flow_id"], {"m01": 1, "m02": 2, "m03": 3}, "m01 and (m02 or not m03)").select("flow_id")


@query(f"""WITH {CHUNKS} SELECT flow_id, bool_or(contains(text, ' the ')) AS has_the FROM ch GROUP BY 1
HAVING bool_or(contains(text, ' the ')) AND (bool_or(regexp_matches(text, 'tion[^a-z]'))
  OR NOT bool_or(contains(text, 'ing')))""")
def rule_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (Rule(1, pattern=" the "), Rule(2, pattern="tion[^a-z]"), Rule(3, pattern="ing"))
    hits = inspect_all_rules(T.chunks(spark, sf_dir), rules, InspectSpec(rules=rules), ["flow_id"])
    return rule_expr(hits, ["flow_id"], {"m01": 1, "m02": 2, "m03": 3}, "m01 and (m02 or not m03)").select(
        "flow_id", F.col("m01").alias("has_the"))


@query(f"""WITH {CHUNKS}, e AS (SELECT *, sum(len) OVER (PARTITION BY flow_id, direction ORDER BY chunk_no) AS end_off
  FROM ch WHERE len > 0)
SELECT flow_id, direction, chunk_no, CAST(end_off - len AS BIGINT) AS start_off, CAST(end_off AS BIGINT) AS end_off, text AS data FROM e""")
def line_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(T.chunks(spark, sf_dir)).select(
        "flow_id", "direction", "chunk_no", "start_off", "end_off", as_text("payload").alias("data"))


# ---- limits ----------------------------------------------------------------

@query(f"""WITH {DOCS}, docs2 AS (SELECT * FROM docs ORDER BY doc_id LIMIT 120), {span_sql(WORD, 'docs2')}
SELECT doc_id, start_off, size FROM sp""")
def limit_datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = InspectSpec(rules=(Rule(1, pattern=WORD),), max_datagrams=120)
    first = S.limit_datagrams(T.documents(spark, sf_dir), spec.max_datagrams, "doc_id")
    return inspect_datagrams(first, spec, ["doc_id"]).select("doc_id", "start_off", "size")


@query(f"""WITH {first_of_prefix(FIRST, "flow_id IN (SELECT DISTINCT flow_id FROM ch ORDER BY flow_id LIMIT 40)")}
SELECT flow_id, chunk_no, start_off FROM fm""")
def limit_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = T.chunks(spark, sf_dir)
    spec = InspectSpec(rules=(Rule(1, pattern=FIRST),), max_streams=40)
    flows = chunks.select("flow_id").distinct()
    return inspect_streams(S.limit_streams(chunks, flows, spec.max_streams, "flow_id"), spec).select(
        "flow_id", "chunk_no", "start_off")


@query(f"""WITH {CHUNKS}, c AS (SELECT * FROM ch ORDER BY flow_id, chunk_no LIMIT 200)
SELECT flow_id, chunk_no, direction, len FROM c""")
def limit_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = S.limit_chunks(T.chunks(spark, sf_dir), 200, ("flow_id", "chunk_no"))
    return kept.select("flow_id", "chunk_no", "direction", F.octet_length("payload").alias("len"))


@query(f"""WITH {first_of_prefix(FIRST)} SELECT flow_id, chunk_no, start_off, (SELECT count(*) FROM fm) AS matched
FROM fm ORDER BY flow_id LIMIT 15""")
def report_limit_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report is cut short, the count is not."""
    matches = stream_matches(spark, sf_dir, Rule(1, pattern=FIRST)).select("flow_id", "chunk_no", "start_off")
    matches = cut(matches)
    return S.limit_report(matches, 15, ("flow_id",)).withColumn("matched", F.lit(matches.count()))


@query(f"WITH {DOCS}, {span_sql(WORD)} SELECT doc_id, start_off, data FROM sp ORDER BY doc_id LIMIT 25")
def report_limit_datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = regex_on_documents(spark, sf_dir, WORD).select("doc_id", "start_off", as_text())
    return S.limit_report(hits, 25, ("doc_id",))


@query(f"WITH {DOCS}, {span_sql('(?s)' + DOTALL)} SELECT doc_id, substr(hex(encode(data)), 1, 64) AS data, size FROM sp")
def clip_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = regex_on_documents(spark, sf_dir, DOTALL)
    return hits.select("doc_id", F.hex(S.clip(F.col("data"), 32)).alias("data"), "size")


# ---- annotation ------------------------------------------------------------

CHUNK_SPANS = """rng AS (SELECT flow_id, direction, chunk_no + 1 AS pkt_no, text, end_off - len AS lo, end_off AS hi FROM (
  SELECT *, sum(len) OVER (PARTITION BY flow_id, direction ORDER BY chunk_no) AS end_off FROM ch WHERE len > 0) x)"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(T.chunks(spark, sf_dir)).withColumn("pkt_no", F.col("chunk_no") + 1)


@query(f"""WITH {multi_of_prefix(CROSS)}, {CHUNK_SPANS}
SELECT mm.flow_id, mm.direction, match_no, start_off, end_off, min(pkt_no) AS first_pkt, max(pkt_no) AS last_pkt
FROM mm JOIN rng ON mm.flow_id = rng.flow_id AND mm.direction = rng.direction AND lo < end_off AND start_off < hi
GROUP BY ALL""")
def packet_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = stream_matches(spark, sf_dir, Rule(1, pattern=CROSS), multi_match=True)
    return spans(matches, ranges(spark, sf_dir), ["flow_id", "direction"],
                 ["flow_id", "direction", "match_no"]).select(
        "flow_id", "direction", "match_no", "start_off", "end_off", "first_pkt", "last_pkt")


@query(f"""WITH {multi_of_prefix(CROSS)}, {CHUNK_SPANS}
SELECT mm.flow_id, mm.direction, match_no, CAST(greatest(start_off, lo) - start_off AS BIGINT) AS piece_off,
  substr(hex(encode(text)), CAST(2 * (greatest(start_off, lo) - lo) + 1 AS BIGINT),
    CAST(2 * (least(end_off, hi) - greatest(start_off, lo)) AS BIGINT)) AS data
FROM mm JOIN rng ON mm.flow_id = rng.flow_id AND mm.direction = rng.direction AND lo < end_off AND start_off < hi""")
def match_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = stream_matches(spark, sf_dir, Rule(1, pattern=CROSS), multi_match=True)
    pieces = match_pieces(matches, ranges(spark, sf_dir), ["flow_id", "direction"],
                          ["flow_id", "direction", "match_no"])
    return pieces.withColumn("data", F.hex("data"))


@query(f"""WITH {DOCS}, k AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, 'zu[a-z]+ung') THEN 1
    WHEN regexp_matches(text, 'the[a-z]+ing ') THEN 2 WHEN contains(text, 'sión') THEN 3
    WHEN contains(text, 'eau') AND contains(text, ' le ') THEN 4 END AS rule_id FROM docs)
SELECT doc_id, CASE rule_id WHEN 1 THEN 'matches regex: ''zu[a-z]+ung''' WHEN 2 THEN 'matches regex: ''the[a-z]+ing '''
  WHEN 3 THEN 'contains shellcode [Offset: ' || strlen(substr(text, 1, instr(text, 'sión') - 1)) || ']'
  ELSE 'matches rule: ''french'' from lang.rules' END AS description FROM k WHERE rule_id IS NOT NULL""")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (*PRIORITY[:3], replace(PRIORITY[3], rule_name="french", source_file="lang.rules"))
    hits = inspect_datagrams(T.documents(spark, sf_dir), InspectSpec(rules=rules), ["doc_id"])
    return with_rule_meta(hits, rules).select("doc_id", X.describe(
        F.col("mode"), F.col("pattern"), F.col("detail"), F.col("start_off"), F.col("rule_name"),
        F.col("source_file")).alias("description"))


@query(f"""WITH {DOCS}, {span_sql(WORD)} SELECT doc_id,
  'matches ''{WORD}'' @ [' || start_off || ':' || end_off || '] - ' || size || 'B' AS line FROM sp""")
def render_quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (Rule(1, pattern=WORD),)
    hits = inspect_datagrams(T.documents(spark, sf_dir), InspectSpec(rules=rules), ["doc_id"])
    return with_rule_meta(hits, rules).select("doc_id", X.quiet_line(
        F.col("pattern"), F.col("start_off"), F.col("end_off"), F.col("size")).alias("line"))


@query("""WITH b AS (SELECT conv_id, turn, lower(hex(encode(text))) AS h, strlen(text) AS n FROM conversations)
SELECT conv_id, turn, coalesce(array_to_string(list_transform(range(0, n, 16), lambda a:
  format('{:08x}:  ', a)
  || rpad(regexp_replace(substr(h, 2 * a + 1, 32), '(..)', '\\1 ', 'g'), 48, ' ') || '  |'
  || array_to_string(list_transform(range(a, least(a + 16, n)), lambda i:
       CASE WHEN substr(h, 2 * i + 1, 2) BETWEEN '20' AND '7e' AND substr(h, 2 * i + 1, 2) <> '5c'
         THEN chr(CAST('0x' || substr(h, 2 * i + 1, 2) AS INT)) ELSE '.' END), '') || '|'), chr(10)), '') AS dump
FROM b""")
def hexdump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.rendered(T.utf8("text"), "hex").alias("dump"))


@query("""SELECT doc_id, regexp_replace(text, '[^\\x20-\\x7d\\t\\n\\r]', '', 'g') AS shown FROM documents""")
def printable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.documents(spark, sf_dir).select("doc_id", X.rendered(F.col("payload"), "print").alias("shown"))


@query(f"WITH {DOCS}, {span_sql(WORD)} SELECT doc_id, hex(encode(data)) AS raw FROM sp")
def raw_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = regex_on_documents(spark, sf_dir, WORD)
    return hits.select("doc_id", F.hex(X.rendered(F.col("data"), "raw")).alias("raw"))


# A rule for each two neighbouring words of the benchmark's texts.
PHRASES_SQL = """w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
p AS (SELECT item_id, unnest(range(1, len(w))) AS k, w FROM w),
q AS (SELECT w[k] AS a, w[k + 1] AS b, CAST(min(item_id * 4096 + k) AS INTEGER) AS rule_id FROM p
  WHERE regexp_full_match(w[k], '[a-z]{3,}') AND regexp_full_match(w[k + 1], '[a-z]{3,}') GROUP BY 1, 2)"""


def phrase_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule rows: even ids as regexes that go on to the end of the word, odd ones as byte patterns."""
    words = T.table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    places = words.where(F.size("w") > 1).select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    pairs = places.select("item_id", "k", F.element_at("w", F.col("k")).alias("a"), F.element_at("w", F.col("k") + 1).alias("b"))
    plain = "^[a-z]{3,}$"
    rules = pairs.where(F.col("a").rlike(plain) & F.col("b").rlike(plain)).groupBy("a", "b").agg(
        F.min(F.col("item_id") * 4096 + F.col("k")).cast("int").alias("rule_id"))
    phrase, even = F.concat_ws(" ", "a", "b"), F.col("rule_id") % 2 == 0
    return rules.select(
        "rule_id", F.when(even, "regex").otherwise("bytesig").alias("mode"),
        F.when(even, F.concat(phrase, F.lit("[a-z]*"))).otherwise(F.hex(F.encode(phrase, "UTF-8"))).alias("pattern"))


@query(f"""WITH {PHRASES_SQL}, h AS (SELECT doc_id, rule_id, text, strlen(substr(text, 1, instr(text, a || ' ' || b) - 1)) AS start_off,
  CASE WHEN rule_id % 2 = 0 THEN strlen(regexp_extract(text, a || ' ' || b || '[a-z]*')) END AS n
FROM q JOIN documents ON contains(text, a || ' ' || b))
SELECT doc_id, rule_id, start_off, coalesce(start_off + n, strlen(text)) AS end_off FROM h""")
def rules_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each phrase of the benchmark, over all documents."""
    return rule_table.inspect_by_table(T.documents(spark, sf_dir), phrase_rules(spark, sf_dir), ["doc_id"]).select(
        "doc_id", "rule_id", "start_off", "end_off")


@query(f"""WITH {PHRASES_SQL}, h AS (SELECT doc_id, rule_id,
  row_number() OVER (PARTITION BY doc_id ORDER BY rule_id % 2, rule_id) AS n FROM q JOIN documents ON contains(text, a || ' ' || b))
SELECT doc_id, rule_id FROM h WHERE n = 1""")
def rules_many_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of thousands of rules in each text: regexes before byte patterns, then by number."""
    found = rule_table.inspect_by_table(T.documents(spark, sf_dir), phrase_rules(spark, sf_dir), ["doc_id"], first=True)
    return found.select("doc_id", "rule_id")
