"""TCP streams from segments as they arrive."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from wiresift.spec import CTS, STC
from wiresift.streaming.packed import from_head, head_of, last_ms, micros, number, packed, side_number, side_of, stateful, unpacked

HALF, FULL = 1 << 31, 1 << 32
#: Bytes that may wait beyond a gap in one direction.
MAX_WAITING = 1 << 24
DATA, IDLE, OVERFLOW = "DATA", "IDLE", "OVERFLOW"
CHUNK_HEAD = {"direction": "string", "event": "string", "chunk_no": "long", "pkt_seq": "long", "start_off": "long",
              "end_off": "long", "delivered_at": "long", "ts": "timestamp"}
STATE = "chunks long, closed boolean, " + ", ".join(
    f"{d}_edge long, {d}_last long, {d}_fin long, {d}_lost boolean, {d}_waiting binary" for d in (CTS, STC))
_HEAD = "<qqI"
_HEAD_SIZE = struct.calcsize(_HEAD)


@dataclass
class Side:
    """One direction: how far it was delivered, and the segments that wait beyond a gap."""

    edge: int = 0
    #: Offset of the segment that came last; sequence numbers are read relative to it.
    last: int = 0
    #: Where the stream ends, once known; -1 before.
    fin: int = -1
    #: Given up since too much waited.
    lost: bool = False
    waiting: list[tuple[int, int, bytes]] = field(default_factory=list)

    @classmethod
    def load(cls, edge: int, last: int, fin: int, lost: bool, packed: bytes) -> Side:
        side, at = cls(edge, last, fin, lost), 0
        while at < len(packed):
            low, seq, size = struct.unpack_from(_HEAD, packed, at)
            at += _HEAD_SIZE
            side.waiting.append((low, seq, bytes(packed[at:at + size])))
            at += size
        return side

    def dump(self) -> tuple[int, int, int, bool, bytes]:
        packed = b"".join(part for low, seq, data in self.waiting for part in (struct.pack(_HEAD, low, seq, len(data)), data))
        return self.edge, self.last, self.fin, self.lost, packed

    def offset(self, seq: int, isn: int) -> int:
        """The stream offset of a sequence number, through any number of wraps."""
        self.last += (seq - (isn + 1 + self.last) + HALF) % FULL - HALF
        return self.last

    def held(self) -> int:
        return sum(len(data) for _, _, data in self.waiting)

    def deliver(self, low: int, seq: int, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(start_off, pkt_seq, bytes) of what a segment makes deliverable; bytes that came first stand."""
        if low > self.edge:
            # A copy of what waits already adds nothing, however often it is sent.
            if all((low, len(data)) != (a, len(d)) for a, _, d in self.waiting):
                heapq.heappush(self.waiting, (low, seq, data))
            return
        while True:
            if low + len(data) > self.edge:
                fresh = data[self.edge - low:]
                yield self.edge, seq, fresh
                self.edge += len(fresh)
            if not self.waiting or self.waiting[0][0] > self.edge:
                return
            low, seq, data = heapq.heappop(self.waiting)

    @property
    def ended(self) -> bool:
        return self.lost or 0 <= self.fin <= self.edge


class Assembler:
    """Delivers the bytes of one flow's two streams in order, as its segments arrive."""

    def __init__(self, max_waiting: int, idle_seconds: float | None) -> None:
        self.max_waiting, self.idle = max_waiting, idle_seconds

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunks, closed, *saved = state.get if state.exists else (0, False, *(0, 0, -1, False, b"") * 2)
        sides = {CTS: Side.load(*saved[:5]), STC: Side.load(*saved[5:])}
        out: list[tuple] = []

        def told(direction: str, event: str, ts: int | None = None) -> None:
            side = sides[direction]
            out.append((head_of(direction, event, None, None, side.edge, side.edge + side.held(), None, ts), None))

        if state.hasTimedOut:
            for direction, side in sides.items():
                if not closed and side.waiting:
                    told(direction, IDLE)
            state.remove()
        else:
            rows = sorted(unpacked(batches), key=lambda row: (not row[0][0], int(row[0][0] or 0)))
            for (now, which, seq, isn, flags, ts, size), payload in rows:
                direction = side_of(which)
                side = sides[direction]
                if closed or side.lost:
                    continue
                if not size:
                    raise ValueError("a segment without a payload")
                low, now = side.offset(int(seq), int(isn)), int(now)
                if payload:
                    for start, came, fresh in side.deliver(low, now, payload):
                        out.append((head_of(direction, DATA, chunks, came, start, start + len(fresh), now, number(ts)), fresh))
                        chunks += 1
                flags = bytes.fromhex(flags.decode())
                if b"F" in flags:
                    side.fin = low + len(payload)
                if side.held() > self.max_waiting:
                    told(direction, OVERFLOW, number(ts))
                    side.lost, side.waiting = True, []
                closed = b"R" in flags or all(s.ended for s in sides.values())
            if closed:
                # What was delivered is not delivered again; nothing else is kept.
                sides = {CTS: Side(), STC: Side()}
            state.update((chunks, closed, *sides[CTS].dump(), *sides[STC].dump()))
            if self.idle is not None:
                last = last_ms([number(head[5]) for head, _ in rows])
                state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + int(self.idle * 1000))
        if out:
            heads, payloads = zip(*out, strict=True)
            yield pd.DataFrame({"flow_id": [key[0]] * len(out), "head": heads, "payload": payloads}, dtype=object)


def online_assembly(segments: DataFrame, idle_seconds: float | None = None, max_waiting: int = MAX_WAITING) -> DataFrame:
    """Chunks of TCP streams, delivered as soon as nothing before them is missing.

    ``segments`` has flow_id, direction, pkt_seq, ts, seq, isn, flags and payload. Within
    a micro-batch, those of a flow are taken in the order of ``pkt_seq``. Rows whose
    ``event`` is DATA are chunks: the accepted range, the packet that brought it, the one
    on whose arrival it was delivered, and ``chunk_no``, dense per flow. Copies are
    dropped, bytes that were delivered before are trimmed. The ranges are those of
    ``assemble`` on the whole table.

    A flow's state is two edges and the segments that wait beyond a gap. Where more
    than ``max_waiting`` bytes wait in one direction, that stream is given up, which an
    OVERFLOW row tells, with the range that is missing or waiting. A reset, or a FIN in
    both directions up to which all was delivered, leaves a mark without bytes, so that
    late copies are not delivered again. With ``idle_seconds`` (event time, needs a
    watermark on ``ts``) silent flows, marks included, leave the state; an IDLE row
    tells of a stream that still waited for a gap to close.
    """
    row = packed([
        F.col("pkt_seq").cast("long"), side_number(F.col("direction")), F.col("seq").cast("long"), F.col("isn").cast("long"),
        F.when(F.col("flags").isNotNull(), F.hex("flags")).otherwise("-"), micros(F.col("ts"))], F.col("payload"))
    out = stateful(segments, row, Assembler(max_waiting, idle_seconds), "head string, payload binary", STATE, idle_seconds)
    return out.select("flow_id", *from_head(CHUNK_HEAD), "payload")


def chunks_of(assembled: DataFrame) -> DataFrame:
    """The chunks among the rows of ``online_assembly``, as the stream searches take them."""
    return assembled.where(F.col("event") == DATA).select("flow_id", "direction", "chunk_no", "ts", "payload")
