"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text's split into vocabulary pieces is found from left to right, with a back
pointer at each boundary. Only boundaries within reach of the longest piece can
still be reached anew, so once all paths that survive meet at one boundary, the
ids before it are final and leave the window.

What makes a path survive depends on the model. In a unigram model it is the best
sum of scores. A merge (BPE) model has no sum to maximise; there, a split is the
one that merging gives exactly if merging gives every two neighbours of it, taken
alone. So a step is allowed if its piece and the one before stand up to merging,
and each boundary has one path. Either way the ids are those of the library.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiresift.llm.common import long_id, pieces, worker_memo

SPACE = "▁"
#: Below the lowest score of a piece, what a character outside the vocabulary costs.
UNKNOWN_COST = 10.0
#: Remembered words of a worker; at the bound it forgets all and goes on.
MEMO = 1_500_000
#: Characters that the search takes at a time.
SLICE = 256
#: Remembered answers on neighbouring pieces.
PAIRS = 1_000_000


class Codec:
    """The pieces of a SentencePiece model file, with their scores."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            self.merges = _model_type(file.read()) == 2
        self.byte_ids: dict[int, int] = {}
        scores: dict[str, tuple[float, int]] = {}
        self.out: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.out.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.out.append(b"" if model.is_control(i) else " ⁇ ".encode())
            else:
                scores[piece] = (model.get_score(i), i)
                self.out.append(piece.replace(SPACE, " ").encode())
        self.scores = scores
        # By piece, whether the ones after it stand.
        self.allowed: dict[str, dict[str, bool]] = {}
        self.answers = 0
        if self.merges:
            self._learn_halves()
        self.unknown_id = model.unk_id()
        self.longest = max(map(len, scores), default=1)
        self.unknown = min((s for s, _ in scores.values()), default=0.0) - UNKNOWN_COST
        # A tree of characters: each leads to the (piece, score, id) that ends there, or
        # nothing, and to the characters that go on.
        self.tree: dict[str, list] = {}
        for piece, found in scores.items():
            node, last = self.tree, None
            for c in piece:
                last = node.setdefault(c, [None, {}])
                node = last[1]
            last[0] = piece, *found
        # Characters that stand next to each other in some piece; between others every path parts.
        self.touching = {p[i:i + 2] for p in scores for i in range(len(p) - 1)}
        # Spaces only lead pieces, and line feeds are in none, so every path parts there.
        self.parts_at_spaces = not any(SPACE in p.lstrip(SPACE) for p in scores)
        self.parts_at_lines = not any("\n" in p for p in scores)
        # The model's own settings, as it normalises.
        self.normalize = model.normalize
        probe = model.normalize("a")
        self.leads = probe.startswith(SPACE)
        self.plain = model.normalize("  \ta \néﬁ ") == (SPACE if self.leads else "") + "  \ta \néﬁ ".replace(" ", SPACE)

    def normalized(self, text: str) -> str:
        if self.plain:
            return (SPACE if self.leads and text else "") + text.replace(" ", SPACE)
        return self.normalize(text)

    def stream(self) -> Viterbi:
        return Viterbi(self)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit numbers."""
        text = self.normalized(text)
        if self.parts_at_spaces and self.parts_at_lines:
            return b"".join(map(self.words().__getitem__, _WORDS.findall(text)))
        return self._ids(text)

    def _learn_halves(self) -> None:
        """For each piece that merging can make: its rank, and the two pieces that became it."""
        self.rank: dict[str, float] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        for piece in self.scores:
            parts, last = list(piece), None
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    found = self.scores.get(parts[i] + parts[i + 1])
                    if found is not None and (best is None or found[0] > best):
                        best, at = found[0], i
                if best is None:
                    break
                last = parts[at], parts[at + 1]
                parts[at:at + 2] = ["".join(last)]
            if len(parts) == 1:
                if last:
                    self.rank[piece] = -self.scores[piece][0]
                    self.halves[piece] = last
                else:
                    self.rank[piece] = -math.inf

    def stands(self, before: str, piece: str) -> bool:
        """Whether merging leaves two neighbouring pieces, or one at the start, as they are.

        The merges that made the two are undone, the latest first. The pieces that
        meet at the border in between must not have a merge that comes earlier.
        """
        known = self.allowed.setdefault(before, {}).get(piece)
        if known is None:
            if self.answers >= PAIRS:
                self.allowed.clear()
                self.answers = 0
            known = self._stands(before, piece) if before else piece in self.rank or len(piece) == 1
            self.allowed.setdefault(before, {})[piece] = known
            self.answers += 1
        return known

    def _stands(self, left: str, right: str) -> bool:
        rank, halves, scores = self.rank, self.halves, self.scores
        a, b = rank.get(left, -math.inf), rank.get(right, -math.inf)
        if a == -math.inf and len(left) > 1 or b == -math.inf and len(right) > 1:
            return False
        limit = math.inf
        while True:
            across = scores.get(left + right)
            if across is not None and -across[0] < limit:
                return False
            if a > b:
                limit, left = a, halves[left][1]
                a = rank.get(left, -math.inf)
            elif b > -math.inf:
                # Of equal merges the first in the text comes first, and one across comes before this one.
                limit, right = math.nextafter(b, math.inf), halves[right][0]
                b = rank.get(right, -math.inf)
            else:
                return True

    def words(self) -> _Words:
        if not hasattr(self, "_words"):
            self._words = _Words(self)
        return self._words

    def _ids(self, text: str) -> bytes:
        if not hasattr(self, "_search"):
            self._search = self.stream()
        # In slices, so that the window stays as small as the pieces allow, however long the stretch.
        out: list[int] = []
        for at in range(0, len(text), SLICE):
            out += self._search.push(text[at:at + SLICE])
        out += self._search.finish()
        return struct.pack(f"<{len(out)}I", *out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        out = self.out
        data = b"".join([out[i] for i in np.frombuffer(ids, "<u4").tolist()])
        if self.leads and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


_NONE: dict[str, bool] = {}
# A word with the spaces before it, spaces before a line end, or a line feed.
_WORDS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class _Words(dict):
    """Ids of the stretches between forced boundaries; short ones are remembered."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        touching = self.codec.touching
        cuts = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in touching]
        if cuts:
            ids = b"".join([self[word[a:b]] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)])
        else:
            ids = self.codec._ids(word)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = ids
        return ids


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else (8 if kind == 1 else 4, at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


def _model_type(data: bytes) -> int:
    """1 for unigram, 2 for BPE: field 3 of the trainer's settings, field 2 of the model."""
    for number, value in _fields(data):
        if number == 2 and isinstance(value, bytes):
            return next((int(v) for n, v in _fields(value) if n == 3), 1)
    return 1


class Viterbi:
    """The search over a text that comes in parts.

    Paths are kept from the last committed boundary on. A boundary whose pieces all
    lie in the text seen so far is extended; the others wait for more. Of equal
    scores the earlier boundary, so the longer last piece, wins.
    """

    def __init__(self, codec: Codec) -> None:
        self.codec = codec
        self._begin()

    def _begin(self) -> None:
        self.text = ""
        # By boundary, for the path to it: the score, and the last piece with its start and
        # id. Where there is no path yet, the piece is None.
        self.score: list[float] = [0.0]
        self.piece: list[str | None] = [""]
        self.start: list[int] = [-1]
        self.id: list[int] = [-1]
        self.at = self.reach = 0
        self.most_held = 1

    def push(self, text: str) -> list[int]:
        """Takes more text; gives the ids that have become final."""
        self._take(text)
        until = len(self.text) - self.codec.longest + 1
        return self._run(until) if until > self.at else []

    def finish(self) -> list[int]:
        """The rest of the ids; the search is then at its start again."""
        out = self._run(len(self.text))
        if self.text:
            out += self._commit(len(self.text))
        self._begin()
        return out

    def _take(self, text: str) -> None:
        self.text += text
        more = len(text)
        self.score += [0.0] * more
        self.piece += [None] * more
        self.start += [-1] * more
        self.id += [-1] * more

    def _run(self, until: int) -> list[int]:
        out: list[int] = []
        longest = self.codec.longest
        extend = self._extend_merges if self.codec.merges else self._extend_scores
        i = self.at
        while i < until:
            # Up to where nothing reaches beyond, or where it is time to see where paths meet.
            i = extend(i, min(until, i + longest))
            meet = 0
            if self.reach == i:
                meet = i
            elif i >= 2 * longest:
                meet = self._meeting(i)
            self.most_held = max(self.most_held, len(self.piece))
            if meet:
                out += self._commit(meet)
                until -= meet
                i -= meet
        self.at = i
        return out

    def _extend_merges(self, i: int, to: int) -> int:
        """Paths from the boundaries from ``i`` on to others without one, by pieces that merging leaves beside the last.

        Stops at ``to`` or where all paths end at one boundary, and gives the place.
        """
        codec, text, known, start, ids, reach = self.codec, self.text, self.piece, self.start, self.id, self.reach
        tree, allowed, scores, stands, longest = codec.tree, codec.allowed, codec.scores, codec.stands, codec.longest
        while i < to:
            before = known[i]
            if before is not None:
                node, j, after = tree, i, allowed.get(before, _NONE)
                for c in text[i:i + longest]:
                    step = node.get(c)
                    if step is None:
                        break
                    found, node = step
                    j += 1
                    if found is not None and known[j] is None:
                        piece = found[0]
                        fits = after.get(piece)
                        if fits or fits is None and stands(before, piece):
                            known[j] = piece
                            start[j] = i
                            ids[j] = found[2]
                            if j > reach:
                                reach = j
                if known[i + 1] is None and text[i] not in scores and stands(before, text[i]):
                    known[i + 1] = text[i]
                    start[i + 1] = i
                    ids[i + 1] = -1
                    reach = max(reach, i + 1)
            i += 1
            if reach == i:
                break
        self.reach = reach
        return i

    def _extend_scores(self, i: int, to: int) -> int:
        """The same, by better scores than those known."""
        codec, text = self.codec, self.text
        while i < to:
            if self.piece[i] is not None:
                node, j, here = codec.tree, i, self.score[i]
                steps = []
                for c in text[i:i + codec.longest]:
                    step = node.get(c)
                    if step is None:
                        break
                    found, node = step
                    j += 1
                    if found is not None:
                        steps.append((j, here + found[1], found[2]))
                if text[i] not in codec.scores:
                    steps.append((i + 1, here + codec.unknown, -1))
                for j, score, piece_id in steps:
                    if self.piece[j] is None or score > self.score[j]:
                        self.piece[j], self.score[j], self.start[j], self.id[j] = text[i:j], score, i, piece_id
                        self.reach = max(self.reach, j)
            i += 1
            if self.reach == i:
                break
        return i

    def _meeting(self, i: int) -> int:
        """The last boundary that all paths to boundaries from ``i`` on pass through."""
        live = {j for j in range(i, self.reach + 1) if self.piece[j] is not None}
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(self.start[last])
        return live.pop()

    def _commit(self, to: int) -> list[int]:
        """Ids up to a boundary, which becomes the first."""
        ids: list[int] = []
        j = to
        while j > 0:
            i, piece_id = self.start[j], self.id[j]
            if piece_id >= 0:
                ids.append(piece_id)
            elif self.codec.byte_ids:
                ids += [self.codec.byte_ids[b] for b in reversed(self.text[i:j].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(self.codec.unknown_id)
            j = i
        ids.reverse()
        if to < len(self.text):
            self.text = self.text[to:]
            base = self.score[to]
            self.score = [x - base for x in self.score[to:]]
            self.piece, self.id = self.piece[to:], self.id[to:]
            self.start = [x - to for x in self.start[to:]]
        else:
            self.text = ""
            self.score, self.piece, self.start, self.id = [0.0], [self.piece[to]], [-1], [-1]
        self.reach -= to
        self.at = 0
        return ids


def codec(path: str) -> Codec:
    """The codec of a model file, kept by the worker."""
    return worker_memo(f"sentencepiece {path}", lambda: Codec(path))


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text",
                     decode: bool = False) -> DataFrame:
    """(doc_id, text, ids[, decoded]): each row's whole text, null as empty, and its packed ids.

    ``decode`` adds the text that the ids give, in the same pass. Other columns are
    not read; repeated rows are encoded each. No shuffle.
    """
    names = ["doc_id", "text", "ids"] + ["decoded"] * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = codec(model)
        for batch in pieces(batches, 256):
            ids = [here.encode(t) for t in batch.column(1).to_pylist()]
            columns = [*batch.columns, pa.array(ids, pa.binary())]
            if decode:
                columns.append(pa.array([here.decode(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(long_id(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")) \
        .mapInArrow(run, "doc_id long, text string, ids binary" + ", decoded string" * decode)


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` (with binary ``ids``, null as none) with the string ``decoded``; other columns stay."""
    encoded = encoded.drop("decoded")
    where = encoded.columns.index("ids")
    names = [*encoded.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(model).decode
        for batch in pieces(batches, 256):
            texts = [decode(i or b"") for i in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_chars, n_ids, ids_crc32, decoded_sha256, same) of (doc_id, text, ids, decoded)."""
    return decoded.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.expr("octet_length(ids) div 4").cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("text") == F.col("decoded")).alias("same"))
