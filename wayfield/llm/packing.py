"""Packing documents into fixed-length sequences, best fit decreasing.

Stage 1 (map only) encodes each document, appends the end id and cuts it into
full windows and a rest; the pieces, without their ids, are saved. A full window is a sequence as it is.
Stage 2 shuffles the rests, dealt by a hash of their row number into groups of bounded size
(so neither a repeated id nor a huge document makes a large one), and places them: a
segment tree indexed by remaining capacity finds the tightest open sequence.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator
from itertools import compress, islice, repeat
from operator import is_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, saved, slices
from .token_counts import CACHE_ENTRIES, CACHED_CHARS, LONG_TEXT, parts

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long, sequence_tokens long"
RESTS_PER_GROUP = 8192
CHUNKS_AT_ONCE = 1 << 17
WORDS_AT_ONCE = 1 << 14  # of neighbouring texts: few calls of the library, strings still in the CPU's cache
_OWN = 1 << 62  # sequence ids of full windows begin here

_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # white space of the pre-tokenizer's patterns
_BEGINS_WHITE = re.compile(f"[{_WHITE}]")
_WHITE_AFTER_SPACE = re.compile(f" [{_WHITE}]")  # begins with one character, for which re has a fast search
_CHUNK = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_SIGNED = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@[-`{-~]+)")  # letters, then signs: pieces of their own


def _unsafe(text: str) -> bool:
    """Whether a space can't be told from the white space beside it by a cut before it."""
    return bool(_BEGINS_WHITE.match(text) or _WHITE_AFTER_SPACE.search(text))


class ByteIds(dict):
    """Word -> the ids of the word after a space, by the ``tokenizers`` library, as little-endian unsigned 32-bit bytes.

    The byte-level pre-tokenizer never lets a piece run from a non-space into a
    space, so a text is cut there, nor from a letter into a sign, so signs after a word are taken apart. Words that
    aren't known yet go to the library together, one behind the other; the bytes of the pieces tell where each word's
    ids end. Words that may hold a special string or end in white space go one by one.
    """

    def __init__(self, json_path: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads of the library take CPU time
        self.older: dict[str, bytes] = {}  # what was known before the last clearing
        self.bare: dict[str, bytes] = {}  # ids of chunks that don't begin with a space
        self.tok = Tokenizer.from_file(json_path)
        self.tok.no_truncation()
        self.tok.no_padding()
        shown = self.tok.pre_tokenizer.pre_tokenize_str(" a,") if self.tok.pre_tokenizer and not self.tok.normalizer else []
        self.signs_apart = [at for _, at in shown] == [(0, 2), (2, 3)]
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab(True)
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of a piece: the vocabulary spells a byte as a character
        self.sizes[list(vocab.values())] = [len(piece) for piece in vocab]

    def encode(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Ids of words that aren't known yet; of those that end in signs the letters go to the library, unless they are known."""
        text = "".join(words)
        special = [s for s in self.special if s in text]
        alone = {w for w in words if not w[-1:].strip() or any(s in w for s in special)} if special else {w for w in words if not w[-1:].strip()}
        together = [w for w in words if w not in alone] if alone else words
        signed = {m[0]: m.groups() for m in map(_SIGNED.fullmatch, together) if m and m.end() <= CACHED_CHARS} if self.signs_apart else {}
        if signed:
            together = [w for w in together if w not in signed]
            together += self.unknown({head for head, _ in signed.values()}.difference(together))
        if together:
            text = " " + " ".join(together)
            (found,) = self.tok.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            sizes = map(len, together if text.isascii() else map(str.encode, together))
            ends = np.cumsum(np.fromiter(sizes, np.int64, len(together)) + 1)
            reached = np.cumsum(self.sizes[ids])
            last = np.searchsorted(reached, ends)
            if last[-1] == len(ids) - 1 and np.array_equal(reached[last], ends):
                raw, to = ids.tobytes(), (4 * last + 4).tolist()
                self.update(zip(together, [raw[i:j] for i, j in zip([0, *to], to)]))  # noqa: B905
            else:  # a piece that spans two words, or a vocabulary that isn't spelt by bytes
                alone.update(together)
        for w in alone:
            self[w] = self.encode(" " + w)
        for w, (head, signs) in signed.items():
            self[w] = self[head] + self.without_space(signs)

    def unknown(self, words: set[str]) -> list[str]:
        """Those of the words that aren't known; what was known before the last clearing is again."""
        found = [w for w in words if w not in self]
        if self.older:
            self.update([(w, self.older[w]) for w in found if w in self.older])
            found = [w for w in found if w not in self.older]
        return found

    def after_spaces(self, words: list[str]) -> list[bytes]:
        """The ids of each word, taken after a space."""
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        out = list(map(self.get, words))
        missed = list(compress(range(len(out)), map(is_, out, repeat(None))))
        if missed:
            new = {words[i] for i in missed}
            if unknown := self.unknown(new):
                self.learn(unknown)
            for i in missed:
                out[i] = self[words[i]]
            for w in unknown:
                if len(w) > CACHED_CHARS:
                    del self[w]
        return out

    def without_space(self, chunk: str) -> bytes:
        """The ids of a chunk as it is."""
        ids = self.bare.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
            if len(chunk) <= CACHED_CHARS:
                if len(self.bare) >= CACHE_ENTRIES:
                    self.bare.clear()
                self.bare[chunk] = ids
        return ids

    def chunks(self, chunks: list[str]) -> bytes:
        """The ids of chunks that follow each other, with the white space each begins with."""
        spaced = iter(self.after_spaces([c[1:] for c in chunks if c[0] == " "]))
        return b"".join([next(spaced) if c[0] == " " else self.without_space(c) for c in chunks])

    def ids(self, text: str) -> bytes:
        """All ids of one text; a very long one goes part by part."""
        if not text:
            return b""
        if any(" " in s and s in text for s in self.special):
            return self.encode(text)
        if _unsafe(text):
            found = (m.group() for m in _CHUNK.finditer(text))
            return b"".join(map(self.chunks, iter(lambda: list(islice(found, CHUNKS_AT_ONCE)), [])))
        out = []
        for k, part in enumerate(parts(text)):
            first, *words = part.split(" ")  # a part after the first begins with a space
            if not k:
                out.append(self.without_space(first))
            out += self.after_spaces(words)
        return b"".join(out)

    def ids_of(self, texts: list[str]) -> Iterator[bytes]:
        """All ids of each text; the words of neighbouring texts are looked up together."""
        firsts, ends, words = [], [], []
        for text in texts:
            whole = len(text) > LONG_TEXT or _unsafe(text) or any(" " in s and s in text for s in self.special)
            own = [] if whole or not text else text.split(" ")
            firsts.append(self.ids(text) if whole else self.without_space(own[0]) if own else b"")
            words += own[1:]
            ends.append(len(words))
            if len(words) >= WORDS_AT_ONCE:
                yield from self.joined(firsts, words, ends)
                firsts, ends, words = [], [], []
        yield from self.joined(firsts, words, ends)

    def joined(self, firsts: list[bytes], words: list[str], ends: list[int]) -> Iterator[bytes]:
        """The ids of texts, each its first bytes and the words up to its end."""
        got, at = self.after_spaces(words), 0
        for first, to in zip(firsts, ends, strict=True):
            yield b"".join([first, *got[at:to]])
            at = to


_LOADED: dict[str, ByteIds] = {}


def loaded(json_path: str) -> ByteIds:
    if json_path not in _LOADED:
        _LOADED[json_path] = ByteIds(json_path)
    return _LOADED[json_path]


def cut_pieces(
    docs: DataFrame, json_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The pieces of every document: full windows, then the rest (never empty: the end id is always there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = loaded(json_path), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, "text"):
                rows: list[tuple] = []
                for doc, ids in zip(batch.column(0).to_pylist(), enc.ids_of(batch.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for at in range(0, n, window):
                        piece = ids[4 * at : 4 * (at + window)]
                        rows.append((doc, at, len(piece) // 4, zlib.crc32(piece), n))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                )

    return id_text(docs, id_col, text_col).mapInArrow(run, PIECES)


class OpenSequences:
    """Open sequences by remaining capacity; a segment tree over 0..window finds the least capacity that suffices."""

    def __init__(self, window: int):
        self.window = window
        self.leaves = 1 << window.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, sequence: int, left: int) -> None:
        self.stacks[left].append(sequence)
        i = self.leaves + left
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """An open sequence with the least remaining capacity >= need, and that capacity."""
        i, tree = self.leaves + need, self.tree
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        left = i - self.leaves
        sequence = self.stacks[left].pop()
        if not self.stacks[left]:
            while i:
                tree[i] = 0
                i >>= 1
                if tree[2 * i] or tree[2 * i + 1]:
                    break
        return sequence, left


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length; ``lengths`` must not increase."""
    open_, n = OpenSequences(window), 0
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        found = open_.take(length) if length < window else None
        if found is None:
            found, n = (n, window), n + 1
        seq[i], off[i] = found[0], window - found[1]
        if found[1] > length:
            open_.put(found[0], found[1] - length)
    return seq, off


def pack(pieces: DataFrame, window: int = 2048, rests_per_group: int = RESTS_PER_GROUP) -> DataFrame:
    """Place every piece: sequence_id (unique over all groups) and gapless offsets from 0."""
    pieces = saved(pieces.withColumn("number", F.monotonically_increasing_id()), "pieces")
    full, rests = pieces.filter(F.col("length") == window), pieces.filter(F.col("length") < window)
    groups = max(1, math.ceil(rests.count() / rests_per_group))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        seq, off = best_fit(pdf["length"].to_numpy(), window)
        fill = np.bincount(seq, weights=pdf["length"].to_numpy()).astype(np.int64)
        base = int(pdf["part"].iloc[0]) << 32
        return pdf.drop(columns=["part", "number"]).assign(sequence_id=base + seq, offset=off, sequence_tokens=fill[seq])

    placed = rests.withColumn("part", F.pmod(F.xxhash64("number"), F.lit(groups))).groupBy("part").applyInPandas(place, PACKED)
    zero = F.lit(0).cast("long")
    return placed.unionByName(full.select(*[c.split()[0] for c in PIECES.split(", ")], (F.col("number") + _OWN).alias("sequence_id"), zero.alias("offset"), F.col("length").alias("sequence_tokens")))


def pack_documents(
    docs: DataFrame, json_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of all documents with the sequence and offset of each.

    Null text is empty (one piece that holds the end id alone). Repeated rows
    are packed as often as they come; equal lengths are ordered by doc_id, then
    start. An empty table gives no rows. A null id is kept. A very long text is encoded part by part.
    Only the two named columns are read, so extra ones can't clash.
    """
    pieces = cut_pieces(docs, json_path, window, end_id, id_col, text_col)
    return pack(pieces, window)
