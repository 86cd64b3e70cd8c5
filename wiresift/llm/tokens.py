"""Token ids of whole texts by a tokenizer file, as packed bytes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wiresift.llm.common import worker_memo

#: Remembered chunks and pieces of a worker; at the bound it forgets all and goes on.
MEMO = 400_000
#: Characters of texts, about, whose new words are encoded together.
TOGETHER = 3 << 20
# A run of Latin-1 letters, then other ASCII marks: parts that the tokenizer's
# own splitting keeps apart, and that lower-casing maps letter by letter.
_WORD, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]*"
_PLAIN = re.compile(rf"({_WORD})({_MARKS})\Z")
# The same for Arrow.
_SPLIT = rf"\A(?P<word>{_WORD})(?P<marks>{_MARKS})\z"
# What byte-level splitting makes of the two UTF-8 bytes of the small letters beyond ASCII; 0xAD has no mark of its own.
_BYTES = {chr(c): "".join(chr(0x143 if b == 0xAD else b if b > 0xA0 else 0x100 + b - 0x5E) for b in chr(c).encode())
          for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))}
_LETTERS = re.compile("[ß-öø-ÿ]")


def word_encoder(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian unsigned 32-bit numbers.

    For tokenizer files whose splitting never crosses a space or a line feed and
    drops both, such as word-level BPE. Texts are cut there, and the ids of equal
    chunks are remembered; the result is that of encoding the whole text. New words
    of plain letters are encoded together, which takes some half of the time of one by
    one; a run of letters is one word to the tokenizer. By byte-level tokenizers they
    are encoded without normalising and splitting, which change nothing of them but
    their bytes' marks, in some half of the time again. Texts are cut, and ids put
    together, as Arrow columns of a group of texts. The function's ``many`` gives
    the ids of each of several texts, whose new words it encodes together. The memory
    lives as long as the worker, within ``MEMO`` entries a level.
    """
    return worker_memo(f"word_encoder {path}", lambda: _make(path))


def _plain_words(path: str, tokenizer: Any) -> Callable[[list[str]], tuple[bytes, list[int]] | None]:
    """A function from words of small letters to their ids, joined, and the byte places between the words'; none if a word is not known by its ids."""
    from tokenizers import Tokenizer, pre_tokenizers

    def joined(words: list[str]) -> tuple[bytes, list[int]] | None:
        found = tokenizer.encode(" ".join(words), add_special_tokens=False)
        of = np.array([-1 if w is None else w for w in found.word_ids])
        if not len(of) or of[0] or of[-1] + 1 != len(words) or (np.diff(of) < 0).any():
            return None
        return np.array(found.ids, "<u4").tobytes(), (4 * np.searchsorted(of, np.arange(len(words) + 1))).tolist()

    made = json.loads(tokenizer.to_str())
    splitting = made["pre_tokenizer"] or {}
    last = (splitting.get("pretokenizers") or [splitting])[-1]
    suffix = made["model"].get("end_of_word_suffix")
    if not hasattr(tokenizer, "encode_batch_fast") or not suffix or last.get("type") != "ByteLevel" or last["add_prefix_space"] or last.get("use_regex", True):
        return joined
    # The last id of a word ends in the suffix, and no other does.
    vocabulary = made["model"]["vocab"]
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    bare = Tokenizer.from_file(path)
    bare.normalizer, bare.pre_tokenizer = None, pre_tokenizers.CharDelimiterSplit(" ")

    def marked(words: list[str]) -> tuple[bytes, list[int]] | None:
        text = " ".join(words)
        if not text.isascii():
            text = _LETTERS.sub(lambda m: _BYTES[m[0]], text)
        [found] = bare.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        edges = 4 * (np.flatnonzero(ends[ids]) + 1)
        if len(edges) != len(words) or edges[-1] != 4 * len(ids):
            return None
        return ids.tobytes(), [0, *edges.tolist()]

    return marked


def _listed(values: pa.Array) -> list:
    return values.to_numpy(zero_copy_only=False).tolist()


def _make(path: str) -> Callable[[str], bytes]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    lowers = "lowercase" in tokenizer.normalizer.__class__.__name__.lower() or "Lowercase" in tokenizer.to_str()[:4096]

    def ids(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    class Memo(dict):
        def __init__(self, make: Callable[[str], bytes]) -> None:
            super().__init__()
            self.make = make

        def __missing__(self, key: str) -> bytes:
            if len(self) >= MEMO:
                self.clear()
            value = self[key] = self.make(key)
            return value

    parts = Memo(ids)
    words_of = _plain_words(path, tokenizer) if lowers else None

    def chunk(text: str) -> bytes:
        plain = _PLAIN.match(text) if lowers else None
        if plain is None:
            return ids(text)
        word, marks = plain.groups()
        return parts[word.lower()] + parts[marks] if marks else parts[word.lower()]

    chunks: dict[str, bytes] = {}

    def learn(new: list[str]) -> list[bytes | None]:
        """The ids of those chunks that are plain."""
        split = pc.extract_regex(pa.array(new, pa.large_string()), _SPLIT)
        spelled = pc.utf8_lower(pc.struct_field(split, "word")).dictionary_encode()
        words = _listed(spelled.dictionary)
        found = words_of(words) if words else None
        if found is None:
            return [None] * len(new)
        data, edges = found
        ids_of = pa.Array.from_buffers(
            pa.large_binary(), len(words), [None, pa.py_buffer(np.array(edges, np.int64)), pa.py_buffer(data)])
        marks = pc.struct_field(split, "marks").dictionary_encode()
        marks_of = pa.array([parts[m] if m else b"" for m in marks.dictionary.to_pylist()], pa.large_binary())
        return _listed(pc.binary_join_element_wise(
            ids_of.take(spelled.indices), marks_of.take(marks.indices), pa.scalar(b"", pa.large_binary())))

    def joined(texts: list[str]) -> Iterator[bytes]:
        held = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = held.values.dictionary_encode()
        distinct = _listed(coded.dictionary)
        found = list(map(chunks.get, distinct))
        places = [k for k, ids in enumerate(found) if ids is None]
        if places:
            new = [distinct[k] for k in places]
            told = learn(new) if lowers else [None] * len(new)
            told = [chunk(c) if ids is None else ids for c, ids in zip(new, told, strict=True)]
            for k, ids in zip(places, told, strict=True):
                found[k] = ids
            if len(chunks) + len(new) > MEMO:
                chunks.clear()
            if len(new) <= MEMO:
                chunks.update(zip(new, told, strict=True))
        # One after the other in one buffer, of which each text's ids are a slice.
        _, at, data = pa.array(found, pa.large_binary()).take(coded.indices).buffers()
        edges = np.frombuffer(at, np.int64)[np.frombuffer(held.buffers()[1], np.int32)[:len(texts) + 1]].tolist()
        view = memoryview(data) if data is not None else b""
        return (bytes(view[a:b]) for a, b in zip(edges, edges[1:], strict=False))

    def many(texts: Iterable[str]) -> Iterator[bytes]:
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from joined(held)
                held, size = [], 0
        if held:
            yield from joined(held)

    def encode(text: str) -> bytes:
        return next(joined([text]))

    encode.many = many
    return encode
