"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A signature holds, for each of many hash functions, the low bits of the smallest hash
among a text's shingles. Two texts differ at a place with a chance of one minus their
resemblance, so texts at the bound differ in a known number of places, and
``MAX_PLACES`` lies some four standard deviations above it.

The places are cut into chunks, each of which is one long. By the pigeonhole
principle two signatures that differ in fewer than twice as many places as there are
chunks have a chunk with one error at most. So each text is filed, for each chunk and
each place in it, under what the chunk holds at the other places: all pairs of
signatures within ``MAX_PLACES`` meet under a key, and are told apart there on whole
signatures. What is left is confirmed on the shingle sets (``similar.py``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiresift.llm import similar as near_sets
from wiresift.llm.fingerprint import mixed

SHINGLE = 5
#: Texts are linked from this resemblance on, in hundredths.
SIMILAR = 85
CHUNKS = 11
#: Places in a chunk and bits of each; a chunk is one long.
PLACES, BITS = 6, 10
#: Signatures are compared up to this many differing places. At a resemblance of 0.85
#: 9.9 of 66 places are expected to differ, with a deviation of 2.9: one in some
#: 10,000 pairs exactly at the bound differs in more.
MAX_PLACES = 2 * CHUNKS - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The chunks of a set's signature, as longs."""
    seeds = mixed(np.arange(1, CHUNKS * PLACES + 1, dtype=np.uint64) * _STEP)[:, None]
    least = np.full(CHUNKS * PLACES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        # The set's hashes are spread already; a multiplication and a fold order them anew for each seed.
        spread = (shingles[None, at:at + 4096] ^ seeds) * (seeds | np.uint64(1))
        spread ^= spread >> np.uint64(32)
        spread *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, spread.min(axis=1), out=least)
    low = (mixed(least) & np.uint64((1 << BITS) - 1)).reshape(CHUNKS, PLACES)
    return (low << (np.arange(PLACES, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


# Comparing signatures, in columns.

_LOW = sum(((1 << BITS - 1) - 1) << BITS * i for i in range(PLACES))
_TOP = sum(1 << BITS * i + BITS - 1 for i in range(PLACES))
#: Bits of a key below its slot.
_HELD = BITS * (PLACES - 1)


def _errors(a: Column, b: Column) -> Column:
    """A long with the top bit of each place set where the chunks differ."""
    x = a.bitwiseXOR(b)
    return (x.bitwiseAND(F.lit(_LOW)) + F.lit(_LOW)).bitwiseOR(x).bitwiseAND(F.lit(_TOP))


def differing(a: Column, b: Column) -> Column:
    """The number of places in which two signatures differ."""
    return sum((F.bit_count(_errors(a[i], b[i])) for i in range(1, CHUNKS)), F.bit_count(_errors(a[0], b[0])))


def first_slot(a: Column, b: Column) -> Column:
    """The first key that both signatures are filed under: its chunk and the place left out; null without any."""
    slots = []
    for i in range(CHUNKS):
        errors = _errors(a[i], b[i])
        # Of a single error's bit, the number of bits below names the place; without an error it is the first.
        place = F.when(errors == 0, 0).otherwise((F.bit_count(errors - 1) / BITS).cast("int"))
        slots.append(F.when(F.bit_count(errors) <= 1, F.lit(i * PLACES) + place))
    return F.coalesce(*slots)


def keys() -> Column:
    """What ``sig`` is filed under: the chunk and the place left out, above what the chunk holds at the others."""
    rows = []
    for i in range(CHUNKS):
        for place in range(PLACES):
            low = F.col("sig")[i].bitwiseAND(F.lit((1 << BITS * place) - 1))
            high = F.shiftleft(F.shiftright(F.col("sig")[i], BITS * (place + 1)), BITS * place)
            key = F.lit(near_sets.HOME | (i * PLACES + place) << _HELD).bitwiseOR(low).bitwiseOR(high)
            rows.append(F.struct(key.alias("key"), F.lit(0).cast("long").alias("sub")))
    return F.array(*rows)


SIGNATURE = near_sets.Signature(
    signature, keys, lambda a, b: differing(a, b) <= MAX_PLACES,
    lambda a, b, key: first_slot(a, b) == F.shiftright(key, _HELD))


def near_duplicates(docs: DataFrame, similar: int = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    A text's set holds its distinct runs of ``shingle`` words; with fewer words all of
    them as one; a null or blank text has none and is linked with nothing. Texts are
    linked where the sets' resemblance is at least ``similar`` hundredths, which is
    confirmed on the sets; below 85 the signatures' bound finds fewer. ``component_id``
    is the smallest doc_id that links reach, itself included; null only where no doc_id
    of the component is known. ``kept`` says that doc_id is that one. Repeated rows give
    repeated rows; rows that share an id are told apart by their texts. Other columns
    are not read.
    """
    found = near_sets.classes(docs, SIGNATURE, similar, shingle)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
