"""Token counts: Arrow functions that return lengths only.

A text is cut where no piece of the vocabulary can span: before each space that
follows a non-space (checked against the vocabulary when the model is loaded). The pieces between two such
places are encoded by the tokenizer's own library, all those of a slice of texts that aren't known yet
in calls balanced by bytes, each distinct one once per cache life; so the sum equals the count of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_text, slices

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
LONG_TEXT = 1 << 20  # characters; longer texts are handled part by part
CACHE_ENTRIES = 400_000
CACHED_CHARS = 64
BATCH_BYTES = 1 << 18  # what the library encodes in one call

_RUN = re.compile(r" +[^ ]*")


def parts(text: str, limit: int = LONG_TEXT) -> Iterator[str]:
    """Cut ``text`` (that begins with a space) before spaces that follow a non-space, into parts of about ``limit``."""
    at, n = 0, len(text)
    while n - at > limit:
        to = at + limit
        while to < n and not (text[to] == " " and text[to - 1] != " "):
            to += 1
        yield text[at:to]
        at = to
    if at < n:
        yield text[at:]


def byte_batches(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` UTF-8 bytes together, or one longer text."""
    at, n = 0, 0
    for k, text in enumerate(texts):
        size = len(text) if text.isascii() else len(text.encode())
        if n and n + size > limit:
            yield texts[at:k]
            at, n = k, 0
        n += size
    if at < len(texts):
        yield texts[at:]


class PieceCounts(dict):
    """Chunk of text without its first space -> number of tokens, by the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        inner = re.compile("[^▁]▁")
        kinds = (self.sp.is_control, self.sp.is_unknown)
        self.safe = not any(
            inner.search(self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size()) if not any(k(i) for k in kinds)
        )
        # a model that normalises (or drops) spaces isn't cut at all
        self.safe = self.safe and self.sp.encode("a  b ", out_type=str)[-1].endswith("▁")

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text: a space that follows a non-space ends one; runs of spaces stay with the word after them."""
        out: list[str] = []
        for part in parts(" " + text.replace("▁", " ")):
            own = part[1:].split(" ")
            out += [x[1:] for x in _RUN.findall(part)] if "" in own else own
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; chunks that aren't known yet go to the library together, in batches balanced by bytes."""
        if not self.safe:
            return [n for batch in byte_batches(texts) for n in map(len, self.sp.encode(batch, num_threads=1))]
        cut = [self.chunks(t) if t else [] for t in texts]
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        new = list({c for chunks in cut for c in chunks if c and c not in self})
        for batch in byte_batches(new):
            self.update(zip(batch, map(len, self.sp.encode(batch, num_threads=1)), strict=True))
        self[""] = 1  # a lone space at the end is one piece
        out = [sum(map(self.__getitem__, chunks)) for chunks in cut]
        for c in new:
            if len(c) > CACHED_CHARS:
                del self[c]
        return out


class LibraryCounts:
    """Whole-text counts by the ``tokenizers`` library for .json files, in batches balanced by bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for batch in byte_batches(texts) for e in self.tok.encode_batch(batch, add_special_tokens=False)]


_LOADED: dict[str, object] = {}


def counter(path: str):
    if path not in _LOADED:
        _LOADED[path] = PieceCounts(path) if path.endswith(".model") else LibraryCounts(path)
    return _LOADED[path]


def count_tokens(
    docs: DataFrame, tokenizer_path: str, token_limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    Null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated
    rows; an empty table gives none; a null id stays null. Texts of any length
    are counted whole. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, text = batch.column(0), batch.column(1)
                sizes = c.counts(text.to_pylist())
                n_bytes = pc.binary_length(text).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, n_bytes, pa.array(sizes, pa.int64()), pa.array([n > token_limit for n in sizes], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
