"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counts of words and of word pairs are quantised to levels of a logarithmic scale.
An n-gram of level q puts the q events (n-gram, 1) to (n-gram, q) into a Bloom
filter. A worker reads a count back by probing for the events in turn until one is
missing. Probabilities interpolate pairs with single words by absolute discounting,
with D taken off each pair's count and Witten and Bell's extra mass for novelty:

    P(w | v) = (max(c(v, w) - D, 0) + R(v) P(w)) / (S(v) + R(v)),
    S(v) = c(v) - D T(v),  R(v) = (1 + D) T(v),  T(v) = successors of v,
    P(w) = (c(w) + 1) / (N + V + 1).

All pairs are held, those seen once too, and of all contexts T(v) and c(v) - T(v).

Words are known by 64-bit hashes of their bytes. Among n distinct words some n**2 /
2**65 pairs share a hash: none is to be expected below a billion.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiresift.llm.common import long_id, pieces, worker_memo
from wiresift.llm.fingerprint import mixed, word_hashes
from wiresift.session import cut

END = np.uint64(xxhash.xxh64_intdigest(b"\n"))
START = np.uint64(xxhash.xxh64_intdigest(b"\n\n"))
#: Tokens that a training task gathers before it sums them up.
CHUNK = 1_500_000
#: Words whose exact counts every worker knows, at most; the others' are joined.
FREQUENT = 1 << 20
#: Tokens a counting segment is for, about.
SEGMENT = 4_000_000
BASE = 1.5
#: What is taken off each pair's count.
DISCOUNT = 0.75
PROBES = 5
BITS_PER_EVENT = 10
#: The size up to which every worker holds the filter. A larger one stays in its
#: regions, and the n-grams to look up are shuffled to them.
BROADCAST_BITS = 1 << 31
#: Bytes of the filter that the driver fetches at a time.
FETCH = 16 << 20
#: Keys of a region that are set or looked up at once, about.
_TOGETHER = 1 << 19
_WORD, _SUCCESSORS, _AGAIN = (np.uint64(x) for x in (0xA5A5A5A5A5A5A5A5, 0x3C3C3C3C3C3C3C3C, 0x5A5A5A5AC3C3C3C3))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(0xFFFFFFFF)


# Quantised counts.

def levels(counts: np.ndarray) -> np.ndarray:
    """The level of each count of at least 1: 1 + floor(log(count, BASE))."""
    return (1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9)).astype(np.int64)


def typical(level: np.ndarray) -> np.ndarray:
    """The mean of the whole numbers of a level; 0 for level 0. A level without any stands for its bound."""
    low = np.ceil(BASE ** (level - 1.0) - 1e-9)
    high = np.ceil(BASE ** level.astype(np.float64) - 1e-9) - 1
    return np.where(level > 0, np.where(high >= low, (low + high) / 2, low), 0.0)


#: The counts that levels stand for, up to the highest that a byte holds.
_TYPICAL = typical(np.arange(201))


def pair_keys(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(mixed(contexts) * _STEP + words)


@dataclass
class Filter:
    """A Bloom filter in regions; a key's top bits name its region."""

    bits: np.ndarray
    region_bits: int
    regions: int

    def has(self, keys: np.ndarray, level: int) -> np.ndarray:
        """The places of the keys that have an event of this level; a probe only looks at those that passed the last."""
        first, step = _spread(keys, np.uint64(level))
        start = region_of(keys, self.regions).astype(np.uint64) * np.uint64(self.region_bits // 8)
        alive = np.arange(len(keys))
        for i in range(PROBES):
            byte, bit = _place(first, step, i, self.region_bits)
            there = np.flatnonzero((self.bits[(start + byte).astype(np.int64)] >> bit) & np.uint8(1))
            if len(there) < len(alive):
                alive = alive[there]
                if i < PROBES - 1:
                    first, step, start = first[there], step[there], start[there]
        return alive

    def level(self, keys: np.ndarray, first: int = 1) -> np.ndarray:
        """The level of each key by probes from ``first`` on; 0 if that one is missing."""
        out = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        at = first
        while len(alive) and at < 200:
            alive = alive[self.has(keys[alive], at)]
            out[alive] = at
            at += 1
        return out


def _spread(keys: np.ndarray, level: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Where an event's probes begin, and the step from one to the next."""
    spread = mixed(keys + np.atleast_1d(level + np.uint64(1)) * _STEP)
    return spread & _HALF, (spread >> np.uint64(32)) | np.uint64(1)


def _place(first: np.ndarray, step: np.ndarray, probe: int, region_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(byte, bit) of a probe in its region: a 32-bit number scaled to the region."""
    place = (((first + np.uint64(probe) * step) & _HALF) * np.uint64(region_bits)) >> np.uint64(32)
    return place >> np.uint64(3), (place & np.uint64(7)).astype(np.uint8)


def region_of(keys: np.ndarray, regions: int) -> np.ndarray:
    """The region, of a power of two of them, that holds a key."""
    bits = regions.bit_length() - 1
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


# Training.

def held_out(doc: int | None) -> bool:
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def _tokens(text: str | None) -> np.ndarray:
    return np.append(word_hashes((text or "").encode("utf-8", "surrogatepass")), END)


def _training_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    held: list[np.ndarray] = []
    size = 0
    for batch in pieces(batches):
        for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held_out(doc):
                continue
            tokens = _tokens(text)
            held.append(tokens)
            size += len(tokens)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def count_words(docs: DataFrame) -> DataFrame:
    """(token, count) of the training documents; each task sums up before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _training_chunks(batches):
            token, n = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(token), 65536):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[at:at + 65536].view(np.int64)), pa.array(n[at:at + 65536])], names=["token", "n"])

    return docs.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("count"))


def _frequent(words: DataFrame, most: int = FREQUENT) -> tuple[pa.Table, int]:
    """The words with the highest counts, at most ``most``, and the count from which on all are among them."""
    step = F.floor(8 * F.log2("count")).cast("int")
    sizes = sorted(((r[0], r[1], r[2]) for r in words.groupBy(step.alias("step")).agg(
        F.count("*"), F.min("count")).collect()), reverse=True)  # some 8 * 63 rows at most
    total, lowest = 0, 1 << 62
    for _, n, least in sizes:
        if total + n > most:
            break
        total, lowest = total + n, least
    return words.where(F.col("count") >= lowest).toArrow(), lowest


_PACKED = "seg int, kind int, keys binary, a binary, b binary"
_PAIRS, _CONTEXTS, _HOT = 0, 1, 2


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    seg, kind, keys, a, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(seg, pa.int32()), pa.array(kind, pa.int32()), pa.array(keys, pa.binary()),
         pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["seg", "kind", "keys", "a", "b"])


def _split(seg: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(segment, the columns' entries of it) for the segments that occur."""
    order = np.argsort(seg, kind="stable")
    seg = seg[order]
    edges = np.flatnonzero(np.diff(seg)) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(seg)]))
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b > a:
            yield (int(seg[a]), *(c[order[a:b]] for c in columns))


def count_pairs(docs: DataFrame, hot: np.ndarray, segments: int) -> DataFrame:
    """Packed counts of word pairs and of what follows each context, by segment.

    Pairs are summed up in each task, then by segment of their context, so that a
    context's successors meet. Contexts in ``hot`` (sorted) would fill a segment;
    their pairs are spread over all, and their sums come in parts.
    """
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _training_chunks(batches):
            words = np.concatenate(held)
            before = np.concatenate([np.append(START, t[:-1]) for t in held])
            keys, at, n = np.unique(pair_keys(before, words), return_index=True, return_counts=True)
            before = before[at]
            spread = np.where(_among(before, hot), keys, mixed(before))
            rows = []
            for seg, k, v, c in _split(region_of(spread, segments), keys, before, n.astype(np.uint32)):
                order = np.argsort(v, kind="stable")
                rows.append((seg, _PAIRS, k[order].tobytes(), v[order].tobytes(), c[order].tobytes()))
                if len(rows) == 16:
                    yield _packed(rows)
                    rows = []
            if rows:
                yield _packed(rows)

    def total(seg: int, held: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        keys, before, n = (np.concatenate([np.frombuffer(h[i], t) for h in held])
                           for i, t in enumerate((np.uint64, np.uint64, np.uint32)))
        keys, at, back = np.unique(keys, return_index=True, return_inverse=True)
        n = np.bincount(back, n).astype(np.int64)
        context, back = np.unique(before[at], return_inverse=True)
        again = np.bincount(back, n - 1).astype(np.int64)
        successors = np.bincount(back)
        crowded = _among(context, hot)
        rows = [(seg, _PAIRS, keys.tobytes(), _level_bytes(n), b"")]
        for kind, some, as_ in ((_CONTEXTS, ~crowded, _level_bytes), (_HOT, crowded, np.ndarray.tobytes)):
            rows.append((seg, kind, context[some].tobytes(), as_(successors[some].astype(np.int64)), as_(again[some])))
        return _packed(rows)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by segment: one is held at a time.
        now, held = None, []
        for batch in batches:
            for seg, k, a, b in zip(*(batch.column(c).to_pylist() for c in ("seg", "keys", "a", "b")), strict=True):
                if seg != now and held:
                    yield total(now, held)
                    held = []
                now = seg
                held.append((k, a, b))
        if held:
            yield total(now, held)

    return (
        docs.mapInArrow(gather, _PACKED).repartition(segments, "seg").sortWithinPartitions("seg")
        .mapInArrow(reduce, _PACKED)
    )


def _level_bytes(counts: np.ndarray) -> bytes:
    """The levels of counts, 0 for 0, a byte each."""
    return np.where(counts > 0, levels(counts), 0).astype(np.uint8).tobytes()


def _among(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


def _hot_sums(counted: DataFrame) -> DataFrame:
    """(context, successors, again) of the hot contexts, a bounded list, from their parts."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, a, b in zip(*(batch.column(c).to_pylist() for c in ("keys", "a", "b")), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(x, np.int64)) for x in (keys, a, b)], names=["context", "successors", "again"])

    return counted.where(F.col("kind") == _HOT).mapInArrow(unpack, "context long, successors long, again long") \
        .groupBy("context").agg(F.sum("successors").alias("successors"), F.sum("again").alias("again"))


def _events(words: DataFrame, counted: DataFrame, regions: int) -> DataFrame:
    """(region, keys, levels) of all n-grams, packed."""
    schema = "seg int, keys binary, levels binary, events long"

    def pack(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([k for k, _ in parts])
        level = np.concatenate([lv for _, lv in parts]).astype(np.uint8)
        rows = [(seg, k.tobytes(), lv.tobytes(), int(lv.sum())) for seg, k, lv in _split(region_of(keys, regions), keys, level)]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                    pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)],
                names=["seg", "keys", "levels", "events"])

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            token, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "count"))
            held.append((mixed(token.astype(np.int64).view(np.uint64) ^ _WORD), levels(n)))
            size += len(token)
            if size > CHUNK // 4:
                yield from pack(held)
                held, size = [], 0
        if held:
            yield from pack(held)

    def of_contexts(context: np.ndarray, successors: bytes, again: bytes) -> list[tuple]:
        successors, again = np.frombuffer(successors, np.uint8), np.frombuffer(again, np.uint8)
        some = again > 0
        return [(mixed(context ^ _SUCCESSORS), successors), (mixed(context[some] ^ _AGAIN), again[some])]

    def of_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for kind, keys, a, b in zip(*(batch.column(c).to_pylist() for c in ("kind", "keys", "a", "b")), strict=True):
                key = np.frombuffer(keys, np.uint64)
                held += [(key, np.frombuffer(a, np.uint8))] if kind == _PAIRS else of_contexts(key, a, b)
                size += len(key)
                if size > CHUNK // 4:
                    yield from pack(held)
                    held, size = [], 0
        if size:
            yield from pack(held)

    def of_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                context, successors, again = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                yield from pack(of_contexts(context.astype(np.int64).view(np.uint64), _level_bytes(successors), _level_bytes(again)))

    return (
        words.mapInArrow(of_words, schema)
        .union(counted.where(F.col("kind") != _HOT).mapInArrow(of_counted, schema))
        .union(_hot_sums(counted).mapInArrow(of_hot, schema))
    )


def _build(events: DataFrame, regions: int, region_bits: int) -> DataFrame:
    """(seg, bits) of the filter's regions that hold anything."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The more regions there are, the fewer keys a row has: many rows' are set together.
        now, bits, size = None, None, 0
        held: list[tuple[bytes, bytes]] = []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())],
                names=["seg", "bits"])

        def put() -> None:
            key, level = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held, strict=True), (np.uint64, np.uint8), strict=True))
            for at in range(1, int(level.max(initial=0)) + 1):
                begin, step = _spread(key[level >= at], np.uint64(at))
                for i in range(PROBES):
                    byte, bit = _place(begin, step, i, region_bits)
                    bits[(byte * np.uint64(8) + bit).astype(np.int64)] = True

        for batch in batches:
            for seg, keys, level in zip(*(batch.column(c).to_pylist() for c in ("seg", "keys", "levels")), strict=True):
                if held and (seg != now or size >= _TOGETHER):
                    put()
                    held, size = [], 0
                if seg != now:
                    if bits is not None:
                        yield row()
                    now, bits = seg, np.zeros(region_bits, bool)
                held.append((keys, level))
                size += len(level)
        if held:
            put()
        if bits is not None:
            yield row()

    return events.select("seg", "keys", "levels").repartition(regions, "seg").sortWithinPartitions("seg") \
        .mapInArrow(build, "seg int, bits binary")


@dataclass
class Model:
    """What workers need to score: totals, exact counts of the frequent words, and the filter if it is small."""

    filter: Filter | None
    tokens: int
    types: int
    frequent: np.ndarray
    counts: np.ndarray

    def log10(self, grams: Grams, level: Callable[[np.ndarray], np.ndarray] | None = None,
              of_words: Callable[[np.ndarray, np.uint64], np.ndarray] | None = None) -> np.ndarray:
        """log10 P of each token after the one before.

        ``level`` gives the levels of distinct keys, by default from the filter;
        ``of_words`` those of words, told apart from other keys by a number.
        """
        level = level or self.filter.level
        of_words = of_words or (lambda words, salt: level(mixed(words ^ salt)))
        (word, at), (context, of), (pair, back) = grams
        single = ((_TYPICAL[of_words(word, _WORD)] + 1) / (self.tokens + self.types + 1))[at]
        successors = _TYPICAL[of_words(context, _SUCCESSORS)]
        again = np.where(successors > 0, _TYPICAL[of_words(context, _AGAIN)], 0)
        held = (again + (1 - DISCOUNT) * successors)[of]
        rest = np.where(successors > 0, (1 + DISCOUNT) * successors, 1)[of]
        pairs = np.maximum(_TYPICAL[level(pair)] - DISCOUNT, 0)[back]
        return np.log10((np.minimum(pairs, held) + rest * single) / (held + rest))


class Remembered:
    """Levels of words; those of the frequent words are read from the filter once."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.held: dict[int, np.ndarray] = {}

    def __call__(self, words: np.ndarray, salt: np.uint64) -> np.ndarray:
        level, frequent = self.model.filter.level, self.model.frequent
        out = np.zeros(len(words), np.int64)
        if not len(frequent):
            return level(mixed(words ^ salt))
        held = self.held.setdefault(int(salt), np.full(len(frequent), 255, np.uint8))
        at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
        known = frequent[at] == words
        new = at[known][held[at[known]] == 255]
        held[new] = level(mixed(frequent[new] ^ salt))
        out[known] = held[at[known]]
        out[~known] = level(mixed(words[~known] ^ salt))
        return out


Grams = tuple[tuple[np.ndarray, np.ndarray], ...]


def _ngrams(tokens: np.ndarray, firsts: np.ndarray) -> Grams:
    """The distinct words, contexts and pair keys, each with the place of every token's own among them."""
    before = np.append(START, tokens[:-1])
    before[firsts] = START
    return tuple(np.unique(x, return_inverse=True) for x in (tokens, before, pair_keys(before, tokens)))


def _wanted(grams: Grams) -> np.ndarray:
    """The distinct keys that ``Model.log10`` looks up, sorted, and so in the order of their regions."""
    (word, _), (context, _), (pair, _) = grams
    return np.unique(np.concatenate([mixed(word ^ _WORD), mixed(context ^ _SUCCESSORS), mixed(context ^ _AGAIN), pair]))


@dataclass
class Trained:
    """A model without its filter, the filter's regions as rows, and the stored word counts."""

    model: Model
    regions: int
    region_bits: int
    built: DataFrame
    words: DataFrame
    #: The count from which on words are among the frequent ones.
    lowest: int

    @property
    def fits(self) -> bool:
        return self.regions * self.region_bits <= BROADCAST_BITS

    def fetched(self) -> Model:
        """The model with its filter, fetched a few megabytes at a time."""
        bits = np.zeros(self.regions * self.region_bits // 8, np.uint8)
        for row in self.built.coalesce(1 + len(bits) // FETCH).toLocalIterator():
            at = row.seg * (self.region_bits // 8)
            bits[at:at + self.region_bits // 8] = np.frombuffer(row.bits, np.uint8)
        return replace(self.model, filter=Filter(bits, self.region_bits, self.regions))


def train(docs: DataFrame) -> tuple[Model, DataFrame, int]:
    """A model of the training documents of ``docs`` (doc_id, text) with its filter, the
    stored word counts, and the count from which on words are in ``frequent``."""
    found = learn(docs)
    return found.fetched(), found.words, found.lowest


def learn(docs: DataFrame) -> Trained:
    spark = docs.sparkSession
    words = cut(count_words(docs))
    tokens, types = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    found, lowest = _frequent(words)
    frequent = found.column("token").to_numpy().astype(np.int64).view(np.uint64)
    counts = found.column("count").to_numpy()
    order = np.argsort(frequent)
    frequent, counts = frequent[order], counts[order]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // SEGMENT, 1)
    segments = 1 << (parts - 1).bit_length()
    # At most 8 * segments words are that frequent; the start of documents is as frequent as their end.
    hot = frequent[counts * 8 * segments > tokens]
    hot = np.sort(np.append(hot, START)) if END in hot else hot
    counted = cut(count_pairs(docs, hot, segments))
    # Packed twice, for their number and for the filter: that is cheaper than to store them.
    events = _events(words, counted, segments)
    n_events = events.agg(F.coalesce(F.sum("events"), F.lit(0))).first()[0]
    region_bits = max(512, BITS_PER_EVENT * n_events // segments // 64 * 64)
    built = cut(_build(events, segments, region_bits))
    return Trained(Model(None, tokens, types, frequent, counts), segments, region_bits, built, words, lowest)


# Scoring.

SCORED = ("row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
          "rare array<long>, rare_n array<long>")
_SCORE_TOKENS = 200_000
#: As many times larger are the chunks whose n-grams are looked up in the regions: more of them recur there.
_LOOKUP_CHUNK = 3
#: Rows of three kinds: scored documents without a score, chunks of their tokens, and keys to look up.
_LOOKUP = f"kind int, seg int, chunk long, a binary, b binary, {SCORED}"
_LOOKUP_NAMES = [f.split()[0] for f in _LOOKUP.split(", ")]
_LOOKUP_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
_DOCUMENT, _CHUNK, _KEYS, _LEVELS = range(4)


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``docs`` has doc_id and text; other columns are not read. A null text is empty,
    and has the end token alone. The documents whose id as text (none: empty) has a
    CRC-32 of 2 modulo 7 are held out, the others train the model. ``base_score``
    is exact: words outside the workers' table of frequent ones are joined with
    their counts. Without training documents both scores are 0 or as the totals of
    0 give them.
    """
    named = docs.select(long_id("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    trained = learn(named)
    fits = trained.fits
    model, words, lowest = trained.fetched() if fits else trained.model, trained.words, trained.lowest
    regions = trained.regions
    # Plain arrays and numbers: workers need not have this package to load them.
    shared = docs.sparkSession.sparkContext.broadcast({**vars(model), "filter": fits and vars(model.filter)})
    shared_id = uuid.uuid4().hex
    total = model.tokens + model.types + 1
    types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(),
             pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = [f.split()[0] for f in SCORED.split(", ")]

    def rows(here: Model, held: list[tuple], of_words: Remembered | None) -> Iterator[tuple]:
        tokens = np.concatenate([t for _, _, t in held])
        sizes = np.array([len(t) for _, _, t in held])
        firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        if fits:
            grams = _ngrams(tokens, firsts)
            word, at = grams[0]
            scores = np.add.reduceat(here.log10(grams, of_words=of_words), firsts)
        else:
            word, at = np.unique(tokens, return_inverse=True)
            scores = np.zeros(len(held))
        if len(here.frequent):
            place = np.minimum(np.searchsorted(here.frequent, word), len(here.frequent) - 1)
            found = here.frequent[place] == word
            known, logs = found[at], np.where(found, np.log10(here.counts[place] + 1.0), 0.0)[at]
        else:
            known, logs = np.zeros(len(tokens), bool), np.zeros(len(tokens))
        base, n_known = np.add.reduceat(logs, firsts), np.add.reduceat(known.astype(np.int64), firsts)
        for i, (row_id, doc, mine) in enumerate(held):
            rare, n = np.unique(mine[~known[firsts[i]:firsts[i] + sizes[i]]], return_counts=True)
            yield (row_id, doc, held_out(doc), len(mine), int(n_known[i]), float(base[i]), float(scores[i]),
                   rare.view(np.int64), n)

    def lookups(held: list[tuple]) -> Iterator[tuple]:
        tokens, sizes = np.concatenate([t for _, _, t in held]), np.array([len(t) for _, _, t in held])
        chunk = held[0][0]
        grams = _ngrams(tokens, np.concatenate(([0], np.cumsum(sizes)[:-1])))
        word, at = grams[0]
        yield (_CHUNK, 0, chunk, word.tobytes(), np.concatenate(([len(sizes)], sizes, at)).astype(np.uint32).tobytes())
        keys = _wanted(grams)
        for seg, mine in _split(region_of(keys, regions), keys):
            yield (_KEYS, seg, chunk, mine.tobytes(), b"")

    def batch_of(here: Model, held: list[tuple], of_words: Remembered | None) -> Iterator[pa.RecordBatch]:
        if fits:
            yield _table(rows(here, held, of_words), names, types)
            return
        yield _table(((_DOCUMENT, *(None,) * 4, *r) for r in rows(here, held, of_words)), _LOOKUP_NAMES, _LOOKUP_TYPES + types)
        yield _table((r + (None,) * len(names) for r in lookups(held)), _LOOKUP_NAMES, _LOOKUP_TYPES + types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        here = Model(**{**value, "filter": Filter(**value["filter"]) if value["filter"] else None})
        # A worker keeps the levels of one model, from task to task.
        kept = worker_memo("lm levels", dict)
        if kept.get("model") != shared_id:
            kept.clear()
            kept.update(model=shared_id, held={})
        of_words = Remembered(here)
        of_words.held = kept["held"]
        next_id = TaskContext.get().partitionId() << 33
        held, size = [], 0
        for batch in pieces(batches):
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((next_id, doc, _tokens(text)))
                next_id += 1
                size += len(held[-1][2])
                if size >= _SCORE_TOKENS * (1 if fits else _LOOKUP_CHUNK):
                    yield from batch_of(here, held, of_words)
                    held, size = [], 0
        if held:
            yield from batch_of(here, held, of_words)

    scored = cut(named.mapInArrow(run, SCORED if fits else _LOOKUP))
    if not fits:
        found = _looked_up(scored.where(F.col("kind") != _DOCUMENT), trained)
        scored = scored.where(F.col("kind") == _DOCUMENT).select(*(n for n in names if n != "score")) \
            .join(found, "row_id")
    rare = (
        scored.select("row_id", F.explode(F.arrays_zip("rare", "rare_n")).alias("r"))
        .select("row_id", F.col("r.rare").alias("token"), F.col("r.rare_n").alias("n"))
        .join(words.where(F.col("count") < lowest), "token")
        .groupBy("row_id").agg(F.sum(F.col("n") * F.log10(F.col("count") + 1)).alias("rare_base"),
                               F.sum("n").alias("rare_known"))
    )
    return scored.drop("rare", "rare_n").join(rare, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total))))
        .alias("base_score"), "score")


def _looked_up(wanted: DataFrame, trained: Trained) -> DataFrame:
    """(row_id, score) of the documents in the chunks of ``wanted``: each key is looked up in its region."""
    schema, names = "kind int, seg int, chunk long, a binary, b binary", _LOOKUP_NAMES[:5]
    bare, region_bits, regions = vars(trained.model), trained.region_bits, trained.regions
    bare = {**bare, "frequent": np.empty(0, np.uint64), "counts": np.empty(0, np.int64)}

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by region, its bits (kind -1) first. A chunk has few keys in a region: many chunks' are looked up together.
        now, here, size = None, None, 0
        held: list[tuple[int, int, np.ndarray]] = []

        def found() -> pa.RecordBatch:
            keys = np.concatenate([k for _, _, k in held])
            level = (here.level(keys) if now == held[0][0] else np.zeros(len(keys), np.int64)).astype(np.uint8)
            ends = np.cumsum([len(k) for _, _, k in held]).tolist()
            return _table(((_LEVELS, seg, chunk, level[end - len(k):end].tobytes(), b"")
                           for (seg, chunk, k), end in zip(held, ends, strict=True)), names, _LOOKUP_TYPES)

        for batch in batches:
            for kind, seg, chunk, a in zip(*(batch.column(c).to_pylist() for c in names[:4]), strict=True):
                if held and (seg != held[0][0] or size >= _TOGETHER):
                    yield found()
                    held, size = [], 0
                if kind == -1:
                    now, here = seg, Filter(np.frombuffer(a, np.uint8), region_bits, 1)
                    continue
                held.append((seg, chunk, np.frombuffer(a, np.uint64)))
                size += len(held[-1][2])
        if held:
            yield found()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by chunk, kind and region: the tokens, then the levels in the order of the sorted keys.
        here, now, tokens, sizes, levels_of = Model(**bare), None, None, None, []

        def done() -> pa.RecordBatch:
            firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            grams = _ngrams(tokens, firsts)
            keys, level = _wanted(grams), np.frombuffer(b"".join(levels_of), np.uint8).astype(np.int64)
            scores = np.add.reduceat(here.log10(grams, lambda some: level[np.searchsorted(keys, some)]), firsts)
            return pa.RecordBatch.from_arrays(
                [pa.array(now + np.arange(len(sizes))), pa.array(scores)], names=["row_id", "score"])

        for batch in batches:
            for kind, chunk, a, b in zip(*(batch.column(c).to_pylist() for c in ("kind", "chunk", "a", "b")), strict=True):
                if kind == _CHUNK:
                    if now is not None:
                        yield done()
                    word, rest = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32).astype(np.int64)
                    n = 1 + rest[0]
                    now, sizes, tokens, levels_of = chunk, rest[1:n], word[rest[n:]], []
                else:
                    levels_of.append(a)
        if now is not None:
            yield done()

    bits = trained.built.select(
        F.lit(-1).alias("kind"), "seg", F.lit(0).cast("long").alias("chunk"), F.col("bits").alias("a"), F.lit(b"").alias("b"))
    keys = wanted.where(F.col("kind") == _KEYS).select(*names)
    found = (
        keys.union(bits).repartition(regions, "seg").sortWithinPartitions("seg", "kind")
        .mapInArrow(probe, schema)
    )
    return (
        wanted.where(F.col("kind") == _CHUNK).select(*names).union(found)
        .repartition(regions, "chunk").sortWithinPartitions("chunk", "kind", "seg")
        .mapInArrow(finish, "row_id long, score double")
    )


def _table(rows: Iterator[tuple], names: list[str], types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
