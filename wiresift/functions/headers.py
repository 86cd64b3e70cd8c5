"""IPv4, TCP and UDP headers as column expressions, both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiresift.functions.bytestr import be_bytes, dotted, dotted_bytes, hex_digits, uint

# Protocol numbers, and the letters of the TCP flag bits from
# the lowest bit up (the two highest bits have no letter).
TCP, UDP = 6, 17
FLAG_LETTERS = "FSRPAU"
UDP_HEADER = 8
# Bytes of an IP header without options, and of the longest IP header plus the
# fixed part of a TCP header.
IP_HEADER, HEADERS = 20, 80


def ip_fields(digits: Column) -> dict[str, Column]:
    """IPv4 header fields from the header's hex digits; lengths and offsets in bytes."""
    frag = uint(digits, 6, 2)
    return {
        "version": F.conv(F.substring(digits, 1, 1), 16, 10).cast("int"),
        "ihl": (F.conv(F.substring(digits, 2, 1), 16, 10).cast("int") * 4),
        "tos": uint(digits, 1, 1).cast("int"),
        "total_len": uint(digits, 2, 2).cast("int"),
        "ip_id": uint(digits, 4, 2).cast("int"),
        "ttl": uint(digits, 8, 1).cast("int"),
        "proto": uint(digits, 9, 1).cast("int"),
        "src": dotted(digits, 12),
        "dst": dotted(digits, 16),
        "more_frags": F.shiftright(frag, 13).bitwiseAND(F.lit(1)).cast("int"),
        "frag_off": (frag.bitwiseAND(F.lit(8191)) * 8).cast("int"),
    }


def _struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def decode_ip(pkt: Column) -> Column:
    """IPv4 header fields as a struct."""
    return _struct(ip_fields(hex_digits(pkt, IP_HEADER)))


def tcp_flags(bits: Column) -> Column:
    """Flag letters in the order F, S, R, P, A, U."""
    return F.concat(*[
        F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, letter).otherwise("")
        for i, letter in enumerate(FLAG_LETTERS)
    ])


def flag_bits(letters: Column) -> Column:
    """Inverse of :func:`tcp_flags`."""
    bits = F.lit(0)
    for i, letter in enumerate(FLAG_LETTERS):
        bits = bits + F.when(letters.contains(letter), 1 << i).otherwise(0)
    return bits


def tcp_fields(digits: Column, ihl: Column) -> dict[str, Column]:
    """TCP header fields; ``hlen`` is the header length in bytes."""
    return {
        "sport": uint(digits, ihl, 2).cast("int"),
        "dport": uint(digits, ihl + 2, 2).cast("int"),
        "seq": uint(digits, ihl + 4, 4),
        "ack": uint(digits, ihl + 8, 4),
        "hlen": (F.shiftright(uint(digits, ihl + 12, 1), 4) * 4).cast("int"),
        "flags": tcp_flags(uint(digits, ihl + 13, 1)),
        "window": uint(digits, ihl + 14, 2).cast("int"),
        "checksum": uint(digits, ihl + 16, 2).cast("int"),
        "urgent": uint(digits, ihl + 18, 2).cast("int"),
    }


def decode_tcp(pkt: Column, ihl: Column) -> Column:
    """TCP header fields as a struct."""
    return _struct(tcp_fields(hex_digits(pkt, HEADERS), ihl))


def decode_udp(pkt: Column, ihl: Column) -> Column:
    """UDP header fields as a struct."""
    digits = hex_digits(pkt, HEADERS)
    return F.struct(
        uint(digits, ihl, 2).cast("int").alias("sport"),
        uint(digits, ihl + 2, 2).cast("int").alias("dport"),
        uint(digits, ihl + 4, 2).cast("int").alias("length"),
    )


def payload_slice(pkt: Column, headers: Column, total_len: Column) -> Column:
    """Bytes after the headers, up to the IP total length (link padding is dropped)."""
    return F.substring(pkt, headers + 1, F.greatest(total_len - headers, F.lit(0)))


def by_proto(packets: DataFrame) -> DataFrame:
    """Keep TCP and UDP; everything else is dropped."""
    return packets.filter(F.col("proto").isin(TCP, UDP))


def decode_packets(raw: DataFrame) -> DataFrame:
    """Rows with a ``pkt`` column to flat header columns plus ``payload``.

    One pass, no shuffle. The header's hex digits are made once per packet and
    all fields read from them. TCP-only fields are null for UDP.
    """
    digits = F.col("_digits")
    wanted = ("proto", "ihl", "src", "dst", "ip_id", "ttl", "tos", "total_len")
    ip = raw.withColumn("_digits", hex_digits(F.col("pkt"), HEADERS))
    proto = ip.withColumn("proto", ip_fields(digits)["proto"])
    fields = by_proto(proto).withColumns(
        {n: c for n, c in ip_fields(digits).items() if n in wanted and n != "proto"})
    is_tcp = F.col("proto") == TCP
    tcp = tcp_fields(digits, F.col("ihl"))
    ports = fields.withColumns({
        "sport": tcp["sport"], "dport": tcp["dport"],
        **{n: F.when(is_tcp, tcp[n]) for n in ("seq", "ack", "window")},
        "_bits": F.when(is_tcp, uint(digits, F.col("ihl") + 13, 1)),
        "_headers": F.col("ihl") + F.when(is_tcp, tcp["hlen"]).otherwise(UDP_HEADER),
    })
    kept = [c for c in raw.columns if c != "pkt"]
    return ports.select(
        *kept, "proto", "src", "dst", "ip_id", "ttl", "tos", "total_len", "sport", "dport", "seq", "ack",
        tcp_flags(F.col("_bits")).alias("flags"), "window",
        payload_slice(F.col("pkt"), F.col("_headers"), F.col("total_len")).alias("payload"), "pkt")


def encode_ip(proto: Column, src: Column, dst: Column, body: Column, ip_id: Column,
              frag: Column | None = None, ttl: int = 64) -> Column:
    """An IPv4 datagram with a 20 byte header in front of ``body``."""
    frag_field = F.lit(0) if frag is None else frag
    return F.concat(
        F.unhex(F.lit("4500")), be_bytes(F.octet_length(body) + 20, 2), be_bytes(ip_id, 2),
        be_bytes(frag_field, 2), be_bytes(F.lit(ttl), 1), be_bytes(proto, 1), F.unhex(F.lit("0000")),
        dotted_bytes(src), dotted_bytes(dst), body,
    )


def encode_tcp(sport: Column, dport: Column, seq: Column, ack: Column, flags: Column,
               payload: Column, window: int = 8192) -> Column:
    """A TCP segment with a 20 byte header."""
    return F.concat(
        be_bytes(sport, 2), be_bytes(dport, 2), be_bytes(seq, 4), be_bytes(ack, 4),
        F.unhex(F.lit("50")), be_bytes(flag_bits(flags), 1), be_bytes(F.lit(window), 2),
        F.unhex(F.lit("00000000")), payload,
    )


def encode_udp(sport: Column, dport: Column, payload: Column) -> Column:
    """A UDP datagram."""
    return F.concat(
        be_bytes(sport, 2), be_bytes(dport, 2), be_bytes(F.octet_length(payload) + UDP_HEADER, 2),
        F.unhex(F.lit("0000")), payload,
    )
