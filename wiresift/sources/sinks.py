"""Where results go: match reports, matched bytes, captures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from wiresift.functions.bytestr import be_bytes, byte_text, text_bytes
from wiresift.operators.scan import Running, running

# Big-endian capture file header (version 2.4, snap length 65535,
# Ethernet), and the link header put before each packet.
CAPTURE_HEADER = "A1B2C3D4" "0002" "0004" "00000000" "00000000" "0000FFFF" "00000001"
LINK_HEADER = "000B000B000B" "000A000A000A" "0800"
RECORD_HEADER_BYTES, LINK_BYTES = 16, 14
PART_BYTES = 64 << 20


def write_matches(matches: DataFrame, path: str, mode: str = "append") -> None:
    """Match report as Parquet, split by protocol and direction."""
    matches.write.mode(mode).partitionBy("proto", "direction").parquet(path)


def file_parts(rows: DataFrame, key: Sequence[str], order: Sequence[str], block: Column | None,
               content: Column, part_bytes: int = PART_BYTES) -> DataFrame:
    """Join up the bytes of each ``key`` in order, in parts of about ``part_bytes``.

    A part, not a whole group, is what one task holds; most groups have one.
    """
    sized = rows.withColumn("_content", content)
    sized = sized.withColumn("_size", F.octet_length("_content").cast("bigint")).filter(F.col("_size") > 0)
    placed = running(sized, key, order, block, [Running("_at", "sum", F.col("_size"), inclusive=False)])
    parts = placed.withColumn("part_no", F.floor(F.col("_at") / part_bytes).cast("bigint"))
    piece = F.struct(*order, byte_text(F.col("_content")).alias("_text"))
    grouped = parts.groupBy(*key, "part_no").agg(F.sort_array(F.collect_list(piece)).alias("_pieces"))
    joined = F.array_join(F.transform("_pieces", lambda p: p["_text"]), "")
    return grouped.select(*key, "part_no", text_bytes(joined).alias("content"))


def payload_log(matches: DataFrame, key: Sequence[str], order: Sequence[str], block: Column | None,
                part_bytes: int = PART_BYTES) -> DataFrame:
    """Matched bytes per flow direction, in match order."""
    return file_parts(matches, key, order, block, F.col("data"), part_bytes)


def write_payloads(parts: DataFrame, path: str, linemode: bool = False) -> None:
    """Matched bytes as Parquet: appended in line mode, replaced otherwise."""
    parts.write.mode("append" if linemode else "overwrite").partitionBy("proto", "direction").parquet(path)


def capture_record(pkt: Column, ts: Column) -> Column:
    """One packet as it stands in a capture file."""
    micros = F.unix_micros(ts)
    size = F.octet_length(pkt) + LINK_BYTES
    return F.concat(
        be_bytes(F.floor(micros / 1_000_000), 4), be_bytes(F.pmod(micros, F.lit(1_000_000)), 4),
        be_bytes(size, 4), be_bytes(size, 4), F.unhex(F.lit(LINK_HEADER)), pkt)


def flow_captures(packets: DataFrame, block: Column | None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Capture files of flows: (file_name, part_no, content).

    ``packets`` has file_name, pkt_seq, ts and pkt. Every part is a capture
    file of its own, so a very long flow becomes a series of them.
    """
    parts = file_parts(packets, ["file_name"], ["pkt_seq"], block,
                       capture_record(F.col("pkt"), F.col("ts")), part_bytes)
    return parts.withColumn("content", F.concat(F.unhex(F.lit(CAPTURE_HEADER)), F.col("content")))


class CaptureFiles(DataSource):
    """Sink that writes each (file_name, part_no, content) row as one file.

    File names and contents are fixed by the rows, so a repeated task writes
    the same files again.
    """

    @classmethod
    def name(cls) -> str:
        return "capture_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"])


class _FileWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        for row in rows:
            suffix = f".{row['part_no']:05d}" if row["part_no"] else ""
            with where.open_output_stream(f"{root}/{row['file_name']}{suffix}.pcap") as out:
                out.write(bytes(row["content"]))
        return WriterCommitMessage()


def write_captures(spark: SparkSession, images: DataFrame, path: str) -> None:
    """Write capture files to a folder all executors can reach."""
    spark.dataSource.register(CaptureFiles)
    images.write.format("capture_files").mode("append").save(path)
