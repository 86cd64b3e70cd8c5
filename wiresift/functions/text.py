"""Matches and bytes as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiresift.functions.bytestr import byte_text, let

# The mark for a direction, bytes per dump line, and the report
# and dump layouts.
FLAGS = {"CTS": "->", "STC": "<-"}
DUMP_WIDTH = 16
DUMP_LINE = "%08x:  %s  |%s|"
FILTER = "(ip.src == %s and {0}.srcport == %s) and (ip.dst == %s and {0}.dstport == %s)"
META_HEAD = "[MATCH] (%08d/%08d) [IP#%d.%s#%d] %s:%s %s %s:%s %s"
META_SPAN = "[MATCH] (%08d/%08d) [IP#%d.%s#%d] match @ %s[%d:%d] (%dB%s)"
FILE_NAME = "%s-%08d-%s.%s-%s.%s"


def direction_flag(direction: Column) -> Column:
    return F.when(direction == "CTS", FLAGS["CTS"]).otherwise(FLAGS["STC"])


def describe(mode: Column, pattern: Column, detail: Column, start: Column, rule_name: Column,
             source_file: Column, invert: bool = False) -> Column:
    """What matched, per mode."""
    mark = " (invert)" if invert else ""
    return (
        F.when(mode == "regex", F.format_string(f"matches regex{mark}: '%s'", pattern))
        .when(mode == "fuzzy", F.format_string(f"matches '%s' %s{mark}", pattern, detail))
        .when(mode == "bytesig", F.format_string(f"contains shellcode [Offset: %d]{mark}", start))
        .when(mode == "signature", F.format_string("matches rule: '%s' from %s", rule_name, source_file))
        .otherwise(""))


def flow_filter(proto: Column, client: Column, cport: Column, server: Column, sport: Column,
                direction: Column) -> Column:
    """Display-filter text for the packets of one direction of a flow."""
    stc = direction == "STC"
    ends = [F.when(stc, b).otherwise(a).cast("string")
            for a, b in ((client, server), (cport, sport), (server, client), (sport, cport))]
    return F.when(proto == "TCP", F.format_string(FILTER.format("tcp"), *ends)).otherwise(
        F.format_string(FILTER.format("udp"), *ends))


def file_name(proto: Column, flow_no: Column, src: Column, sport: Column, dst: Column,
              dport: Column, suffix: Column | None = None) -> Column:
    name = F.format_string(FILE_NAME, proto, flow_no, src, sport.cast("string"), dst, dport.cast("string"))
    return name if suffix is None else F.concat(name, suffix)


def meta_lines(inspected: Column, matched: Column, flow_no: Column, proto: Column, proto_no: Column,
               src: Column, sport: Column, direction: Column, dst: Column, dport: Column,
               description: Column, start: Column, end: Column, size: Column,
               first_pkt: Column | None = None, last_pkt: Column | None = None) -> Column:
    """The two report lines of a match."""
    packets = F.lit("") if first_pkt is None else F.format_string(
        " | packet[%d] - packet[%d]", first_pkt, last_pkt)
    head = F.format_string(
        META_HEAD, inspected, matched, flow_no, proto, proto_no, src, sport.cast("string"),
        direction_flag(direction), dst, dport.cast("string"), description)
    span = F.format_string(
        META_SPAN, inspected, matched, flow_no, proto, proto_no, direction, start, end, size, packets)
    return F.array(head, span)


def quiet_line(pattern: Column, start: Column, end: Column, size: Column) -> Column:
    return F.format_string("matches '%s' @ [%d:%d] - %dB", pattern, start, end, size)


def hexdump(data: Column) -> Column:
    """Lines of 16 bytes: offset, hex digits, printable characters."""
    size = F.octet_length(data)

    def line(at: Column, piece: Column) -> Column:
        spaced = F.regexp_replace(F.lower(F.hex(piece)), "(..)", "$1 ")
        shown = F.regexp_replace(byte_text(piece), r"[^ -\[\]-~]", ".")
        return F.format_string(DUMP_LINE, at, F.rpad(spaced, DUMP_WIDTH * 3, " "), shown)

    # Each line takes its own bytes, so the work is in proportion to the data.
    lines = F.transform(F.sequence(F.lit(0), size - 1, F.lit(DUMP_WIDTH)), lambda at: let(
        F.substring(data, at + 1, F.lit(DUMP_WIDTH)), lambda piece: line(at, piece)))
    return F.when(size > 0, lines).otherwise(F.array().cast("array<string>"))


def printable(data: Column) -> Column:
    """Bytes 32 to 125, tab, line feed and carriage return; the rest is dropped."""
    return F.regexp_replace(byte_text(data), r"[^\x20-\x7d\t\n\r]", "")


def rendered(data: Column, mode: str) -> Column:
    """Display form of matched bytes for one output mode."""
    if mode == "hex":
        return F.array_join(hexdump(data), "\n")
    if mode == "print":
        return printable(data)
    if mode == "raw":
        return data
    raise ValueError(f"{mode!r} shows no bytes")
