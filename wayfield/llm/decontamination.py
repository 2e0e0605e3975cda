"""Benchmark decontamination: rare words and bigrams of the test items join passages to them, Smith-Waterman alignment scores them.

The items are a stated query set: they are taken in blocks of bounded count and bytes, so
what a block sends to the executors has a bound,
and each block is held against all documents. Pass 1 counts every item word and bigram
over all documents. Pass 2 finds the places that can hold an alignment and aligns
the words there with the whole item.

The filter loses nothing. An alignment of M matched words that scores at least t (2 a match, -1 for
each other word of text or item) spans at most 3M - t words of text, and all but 2M - t of its M - 1
steps go from a word to the next one in both. So for any W, either it has W matched words within 3m - t words of the
text (m: the item's words), or t - W matched bigrams within 3(W - 1) - t. Seeds are an item's words (bigrams) but
the most frequent ones; those left out can be part of the matches, so that many fewer seeds must stand within the span.
Of the places so found those stay where some stretch reaches t at 2 for each word of the item, less 1 where it follows
another that it doesn't follow in the item, and -1 for each other word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import buffers, id_text, slices

MATCH, MISMATCH, GAP = 2, -1, -1
GRAM = 3  # an item of fewer words must stand whole
ITEMS_PER_BLOCK = 20_000
BLOCK_BYTES = 4 << 20  # of item text in a block, on average
ALIGN_CELLS = 1 << 22  # matrix cells aligned at once
PLACE_WORDS = 1 << 19  # words of places bounded at once
HITS = "doc_id long, item_id long, score double, first_word long, last_word long, aligned_words long, n_places long"


def _word_hashes(text: pa.Array) -> words.Words:
    return words.split(*buffers(text), words.ALNUM, lower=True)


class Seeds:
    """Item words of one block, found in documents through a bit table and a sorted array."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.shift = np.uint64(64 - 22)
        self.table = np.zeros(1 << 22, bool)
        self.table[(self.values >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that hold a seed, and which."""
        at = np.flatnonzero(self.table[(hashes >> self.shift).astype(np.int64)])
        which = np.searchsorted(self.values, hashes[at])
        good = which < len(self.values)
        good[good] = self.values[which[good]] == hashes[at[good]]
        return at[good], which[good]


def align(items: np.ndarray, lengths: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman over a batch with linear gaps: best score, and the text place after its last word.

    ``items`` (b, m) and ``texts`` (b, l) hold word hashes; an item's words past
    its length never match, nor do padded text places (0).
    """
    b, m = items.shape
    span = np.arange(1, texts.shape[1] + 1, dtype=np.int32) * -GAP
    row = np.zeros((b, texts.shape[1] + 1), np.int32)
    best, end = np.zeros(b, np.int32), np.zeros(b, np.int64)
    for i in range(m):
        same = (texts == items[:, i : i + 1]) & (texts != 0)
        step = np.maximum(row[:, :-1] + np.where(same, MATCH, MISMATCH), row[:, 1:] + GAP)
        np.maximum(step, 0, out=step)
        step = np.maximum.accumulate(step + span, axis=1) - span  # gaps along the text
        step[i >= lengths] = 0
        row[:, 1:] = step
        top = step.argmax(axis=1)
        value = step[np.arange(b), top]
        better = value > best
        best[better], end[better] = value[better], top[better] + 1
    return best, end


def bigrams(w: words.Words) -> np.ndarray:
    """A hash for each word and the next; the last word of a text and the first of the next one give a pair that is only a chance of a place more."""
    return words.grams(w.hash, 2)


def _count_seeds(docs: DataFrame, seeds: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Seeds(seeds)
        totals = np.zeros(len(found.values), np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                w = _word_hashes(batch.column(1))
                for hashes in (w.hash, bigrams(w)):
                    totals += np.bincount(found.find(hashes)[1], minlength=len(totals))
        hit = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(found.values[hit].view(np.int64)), pa.array(totals[hit])], names=["seed", "n"])

    return docs.mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))


def _item_arrays(rows: list) -> tuple[list[int | None], list[np.ndarray]]:
    w = _word_hashes(pa.array([r.text for r in rows], pa.string()))
    return [r.doc_id for r in rows], [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(rows))]


class Members:
    """Which words and bigrams stand in which items: a bit table of both; what it takes for a member by chance only raises a bound."""

    def __init__(self, item_words: list[np.ndarray]):
        owner = np.repeat(np.arange(len(item_words)), [len(w) for w in item_words])
        self.words = self.table(np.concatenate(item_words), owner)
        owner = np.repeat(np.arange(len(item_words)), [max(0, len(w) - 1) for w in item_words])
        self.pairs = self.table(np.concatenate([words.grams(w, 2) for w in item_words]), owner)

    @classmethod
    def table(cls, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 22, bool)
        out[cls.at(hashes, owner)] = True
        return out

    @staticmethod
    def at(hashes: np.ndarray, item: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((hashes ^ (item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(42)).astype(np.int64)

    def bound(self, hashes: np.ndarray, pairs: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """At least the best alignment score of each item with the words from ``low`` to ``high`` (never empty)."""
        out, size, at = np.zeros(len(item), np.int64), high - low, 0
        ends = np.cumsum(size)
        while at < len(item):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACE_WORDS, "right")))
            n = size[at:to]
            first = np.cumsum(n) - n
            place = np.arange(n.sum()) + np.repeat(low[at:to] - first, n)
            of = np.repeat(item[at:to], n)
            member = self.words[self.at(hashes[place], of)]
            value = np.where(member, MATCH, GAP)
            follows = np.flatnonzero(member[1:] & member[:-1] & (place[1:] == place[:-1] + 1)) + 1
            value[follows] += GAP * ~self.pairs[self.at(pairs[place[follows] - 1], of[follows])]
            total = np.cumsum(value)
            apart = np.repeat(np.arange(to - at) * (4 * len(value) + 4), n)  # each place's sums lie below those before it
            least = np.minimum.accumulate(total - value - apart) + apart
            out[at:to] = np.maximum.reduceat(total - least, first) - GAP  # the first word of a stretch follows none of it
            at = to
        return out


def item_seeds(w: np.ndarray, frequency: np.ndarray, least: int, spare: int) -> tuple[np.ndarray, int]:
    """Distinct words of an item without the most frequent ones of at most ``spare`` places, and how many of ``least`` matches must be among them."""
    seed, one, times = np.unique(w, return_index=True, return_counts=True)
    order = np.argsort(-frequency[one], kind="stable")
    left_out = np.cumsum(times[order])
    n = int(np.searchsorted(left_out, spare, "right"))
    return seed[order[n:]], least - int(left_out[n - 1] if n else 0)


class SeedTable:
    """Seeds of all items of a block, with what each item needs: so many of them within so many words."""

    def __init__(self, n_items: int):
        self.seed, self.owner = [], []
        self.need, self.span = np.ones(n_items, np.int64), np.ones(n_items, np.int64)

    def add(self, item: int, w: np.ndarray, counts: dict[int, int], least: int, spare: int, span: int) -> None:
        frequency = np.array([counts.get(int(x), 0) for x in w.view(np.int64)])
        seeds, self.need[item] = item_seeds(w, frequency, least, spare)
        self.span[item] = max(1, span)
        self.seed.append(seeds), self.owner.append(np.full(len(seeds), item))

    def sort(self) -> SeedTable:
        seed = np.concatenate([np.zeros(0, np.uint64), *self.seed])
        order = np.argsort(seed, kind="stable")
        self.seed, self.owner = seed[order], np.concatenate([np.zeros(0, np.int64), *self.owner])[order]
        return self

    def open(self) -> SeedTable:
        """Inside a task: what finds seeds fast, made once."""
        self.found = Seeds(self.seed)
        self.begin, self.stop = np.searchsorted(self.seed, self.found.values), np.searchsorted(self.seed, self.found.values, "right")
        return self

    def places(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document * items + item, low, high): words where an item has as many seeds as it needs, each with its span around."""
        at, which = self.found.find(hashes)
        many = self.stop[which] - self.begin[which]
        k = np.repeat(self.begin[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at, item = np.repeat(at, many), self.owner[k]
        pair = (np.searchsorted(first, at, "right") - 1) * len(self.need) + item
        order = np.argsort(pair, kind="stable")
        at, item, pair = at[order], item[order], pair[order]
        to = np.arange(len(at)) + self.need[item] - 1
        head = np.flatnonzero(to < len(at))
        to = to[head]
        good = (pair[to] == pair[head]) & (at[to] - at[head] < self.span[item[head]])
        head, to = head[good], to[good]
        span = self.span[item[head]]
        return pair[head], at[to] - span + 1, at[head] + span + 1  # a bigram's second word too


def _search(
    docs: DataFrame, ids: list[int | None], item_words: list[np.ndarray], counts: dict[int, int], gram: int, threshold: float, keep_clean: str | None = None
) -> DataFrame:
    """The hits of a block of items in ``docs`` (doc_id, text); or with ``keep_clean``, the name of the text column, the rows of ``docs`` without any."""
    sizes = np.array([len(w) for w in item_words])
    share = np.where(sizes < gram, 1.0, threshold)
    reach = MATCH * share * sizes
    span = (3 * sizes - reach + 1e-9).astype(np.int64)
    by_word, by_pair = SeedTable(len(sizes)), SeedTable(len(sizes))
    for k, w in enumerate(item_words):
        if len(w):
            score = math.ceil(reach[k] - 1e-9)
            least = max(1, min(len(w), score - 1, math.ceil(0.75 * score)))
            by_word.add(k, w, counts, least, 3 * least // 4, int(span[k]))
            if score - least <= least - 2:  # fewer than ``least`` matches have at most so many steps
                by_pair.add(k, words.grams(w, 2), counts, score - least, (score - least) // 2, 3 * (least - 1) - score)
    by_word.sort(), by_pair.sort()
    members = Members(item_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word.open(), by_pair.open()
        for whole in batches:
            for batch in slices(whole, keep_clean or "text"):
                if keep_clean:
                    text = batch.column(batch.schema.get_field_index(keep_clean))
                    numbers = pa.array(np.arange(batch.num_rows))
                    clean = np.ones(batch.num_rows, bool)
                    clean[[r[0] for r in chunk(pa.RecordBatch.from_arrays([numbers, text], names=["doc_id", "text"]))]] = False
                    yield batch.filter(pa.array(clean))
                    continue
                rows = list(chunk(batch))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                    cols = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in HITS.split(", ")])

    def chunk(batch: pa.RecordBatch) -> Iterator[tuple]:
        w = _word_hashes(batch.column(1))
        pairs = bigrams(w)
        both = zip(by_word.places(w.hash, w.first), by_pair.places(pairs, w.first), strict=True)
        pair, low, high = (np.concatenate(x) for x in both)
        if not len(pair):
            return
        doc, item = np.divmod(pair, len(sizes))
        low, high = np.maximum(w.first[doc], low), np.minimum(w.first[doc + 1], high)
        order = np.lexsort((low, pair))
        pair, low, high = pair[order], low[order], high[order]
        apart = (pair - pair[0]) * (len(w) + 1)  # places that overlap are one; those of another pair lie beyond
        reach_so_far = np.maximum.accumulate(high + apart)
        new = np.ones(len(pair), bool)
        new[1:] = low[1:] + apart[1:] > reach_so_far[:-1]
        head = np.flatnonzero(new)
        high = np.maximum.reduceat(high, head)
        (doc_h, item_h), low = np.divmod(pair[head], len(sizes)), low[head]
        good = members.bound(w.hash, pairs, item_h, low, high) >= reach[item_h] - 1e-9
        doc_h, item_h, low, high = doc_h[good], item_h[good], low[good], high[good]
        # a long place is cut into stretches that overlap by what an alignment can span, so a matrix stays small
        jobs = []
        for d, it, lo, hi in zip(doc_h.tolist(), item_h.tolist(), low.tolist(), high.tolist(), strict=True):
            stretch = 4 * int(sizes[it]) + 64
            while True:
                jobs.append((d, it, lo, min(hi, lo + stretch)))
                if lo + stretch >= hi:
                    break
                lo += stretch - int(span[it])
        jobs.sort(key=lambda j: (int(sizes[j[1]]), j[3] - j[2]))
        best: dict[tuple[int, int], list] = {}
        k = 0
        while k < len(jobs):
            room, n = 0, 0
            while k + n < len(jobs):
                room = max(room, jobs[k + n][3] - jobs[k + n][2])
                if n and (n + 1) * room > ALIGN_CELLS >> 4:
                    break
                n += 1
            part, k = jobs[k : k + n], k + n
            of = np.array([j[1] for j in part])
            lengths = sizes[of]
            items = np.zeros((n, int(lengths.max())), np.uint64)
            texts = np.zeros((n, room), np.uint64)
            for r, (_, it, lo, hi) in enumerate(part):
                items[r, : lengths[r]] = item_words[it]
                texts[r, : hi - lo] = w.hash[lo:hi]
            score, end = align(items, lengths, texts)
            value = score / (MATCH * lengths)
            hit = np.flatnonzero(value >= share[of])
            if not len(hit):
                continue
            # the first word: the same alignment backwards from the last one
            back_items, back_texts = np.zeros_like(items[hit]), np.zeros_like(texts[hit])
            for r, h in enumerate(hit):
                back_items[r, : lengths[h]] = items[h, : lengths[h]][::-1]
                back_texts[r, : end[h]] = texts[h, : end[h]][::-1]
            _, back = align(back_items, lengths[hit], back_texts)
            for h, b in zip(hit.tolist(), back.tolist(), strict=True):
                d, it, lo, _ = part[h]
                to = lo + int(end[h])
                row = (float(value[h]), to - b - int(w.first[d]), to - 1 - int(w.first[d]), b)
                known = best.setdefault((d, it), [row, set()])
                known[1].add(row[1])
                if (row[0], -row[1]) > (known[0][0], -known[0][1]):
                    known[0] = row
        names = batch.column(0).to_pylist()
        for (d, it), (row, places) in sorted(best.items()):
            yield (names[d], ids[it], *row, len(places))

    return docs.mapInArrow(run, docs.schema if keep_clean else HITS)


def _blocks(benchmark: DataFrame, items_per_block: int, item_col: str, text_col: str) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    items = id_text(benchmark, item_col, text_col)
    n_items, n_bytes = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n_items / items_per_block), math.ceil(n_bytes / BLOCK_BYTES))
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) == k)
        ids, item_words = _item_arrays(block.collect())  # bounded by items_per_block and BLOCK_BYTES
        if sum(map(len, item_words)):
            yield ids, item_words


def _frequencies(rows: DataFrame, item_words: list[np.ndarray]) -> dict[int, int]:
    """How often each word and bigram of the items stands in all documents: at most one row per word and bigram of the block."""
    seeds = np.concatenate([x for w in item_words for x in (w, words.grams(w, 2))])
    return {r.seed: r.n for r in _count_seeds(rows, seeds).collect()}


def clean_rows(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4, gram: int = GRAM,
    items_per_block: int = ITEMS_PER_BLOCK, text_col: str = "text", item_col: str = "item_id",
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item (see ``contaminated``); map only. Null texts hold none; an empty table stays empty."""
    rows, out = id_text(docs.select(F.lit(0).alias("doc_id"), text_col), "doc_id", text_col), docs
    for ids, item_words in _blocks(benchmark, items_per_block, item_col, "text"):
        out = _search(out, ids, item_words, _frequencies(rows, item_words), gram, threshold, keep_clean=text_col)
    return out


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4, gram: int = GRAM,
    items_per_block: int = ITEMS_PER_BLOCK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
) -> DataFrame:
    """One row per (document, item) whose best local alignment reaches ``threshold`` of a full match.

    doc_id, item_id, score (0 to 1), first_word, last_word and aligned_words of
    the best place (the first of equal ones), n_places. Words are runs of ASCII letters and digits
    (lower-cased) and of all above ASCII. An item of fewer than ``gram`` words
    must stand whole, as one word of it would reach the threshold. Null texts and texts without words match nothing;
    repeated rows and items give repeated pairs, an item without id a null one; empty tables give none. Very long
    texts are read whole. Only the named columns are read, so extra ones can't clash.
    """
    rows = id_text(docs, id_col, text_col)
    found = [_search(rows, ids, item_words, _frequencies(rows, item_words), gram, threshold) for ids, item_words in _blocks(benchmark, items_per_block, item_col, text_col)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], HITS)
