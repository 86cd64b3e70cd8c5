"""Awkward tables that every operator is tried on."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])
CLASHING = ("fp", "line", "statistics", "kept", "base_failed", "n_dropped", "n_lines", "ids", "decoded", "bucket",
            "fingerprint", "token", "count", "piece", "start", "length", "doc", "half", "first", "near")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], DOCS)


def clashing(df):
    """``df`` with extra columns named as operators name their own."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASHING})


def awkward(spark):
    """Nulls, empty and blank texts, one very long text, ties and repeated rows."""
    words = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
    return docs(spark, [
        (1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (4, " \n\t "), (5, words),
        (6, "alpha beta gamma delta epsilon zeta eta theta"), (6, "alpha beta gamma delta epsilon zeta eta theta"),
        (None, "kein Ausweis für dieses Dokument\nzweite Zeile ist etwas länger"), (None, None),
        (7, "Éa 的 𝄞 ̈x"), (9223372036854775807, "last of all ids"), (-5, "negative id here")])
