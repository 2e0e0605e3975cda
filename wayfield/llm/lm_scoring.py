"""Language-model scores by a weighted backoff automaton.

Model: hierarchical Dirichlet smoothing of all n-grams of the training documents, none
left out. A seen n-gram is a state; from a state of count c the arc of a word seen n times
after it weighs log10((n + MU * p) / (c + MU)), p being the word's probability at
the state without its first word; the failure arc there weighs log10(MU / (c + MU)). The
probabilities of a state sum to 1. The root gives (c + 0.5) / (N + 0.5 * (V + 1)), for unseen
words with c = 0; the end of a text is a token and also what stands before a text.

All weights follow from n-gram counts, so counts are what is shuffled, packed:

1. Map only: a chunk of documents (chunks.CHUNK_TEXT bytes) sorts its distinct n-gram keys (64-bit
   hashes) and cuts them into buckets by their first bits; a bucket of a chunk is one row of
   packed differences and training counts. A frequent n-gram is one key a chunk.
2. A bucket adds up the counts of its keys over all chunks and answers each chunk in the
   chunk's own key order.
3. Each chunk meets its answers (one row of text, one of counts), builds the part of the automaton that
   its documents can reach and reads them once from left to right, carrying the state and adding up the weights.

Steps 1 and 3 read the same rows (see ``chunks``), so ``docs`` must give the same partitions each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .chunks import answered, bucket_bits, count, packed, send, unpacked
from .common import buffers, id_text, saved

ORDER = 3
LANE = 256  # tokens of a document that are read one after the other
MU = 10.0  # what a state's lower order counts for, in occurrences
KEYS_PER_BYTE = 0.45
KINDS = ["words", "grams"]
END = np.uint64(0x454E442D4F462D54)  # the end token's hash; a word's hash is mixed and meets it by chance only
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def with_ends(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all documents, each document preceded and followed by END; n_docs+1 places."""
    sizes = np.diff(w.first) + 2
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(first[-1], END, np.uint64)
    place = np.arange(len(w)) + np.repeat(first[:-1] + 1 - w.first[:-1], np.diff(w.first))
    out[place] = w.hash
    return out, first


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and the number of each key among them in 32 bits."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, at.astype(np.int32)


class Chunk:
    """The n-grams of some documents: sorted distinct keys, of words and of longer ones, and which key ends at which place."""

    def __init__(self, text: pa.Array, order: int):
        self.order = order
        self.h, self.first = with_ends(words.split(*buffers(text), words.SPACED, lower=True))
        size = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.ahead = np.arange(len(self.h), dtype=np.int32) - np.repeat(self.first[:-1].astype(np.int32), size)  # tokens before a place, with the end before the text
        self.tokens = np.flatnonzero(self.ahead)
        self.ends = [np.flatnonzero(self.ahead >= n - 1) for n in range(2, order + 1)]
        self.words, self.word_at = numbered(self.h[self.tokens])
        keys = [words.grams(self.h, n)[at - n + 1] for n, at in enumerate(self.ends, 2)]
        self.grams, self.gram_at = numbered(np.concatenate([np.zeros(0, np.uint64), *keys]))

    def counts(self, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each key comes in the documents that are learnt from."""
        ends = np.concatenate([np.zeros(0, np.int64), *self.ends])
        return tuple(
            np.bincount(at, learnt[self.doc[places]], len(keys)).astype(np.uint64)
            for at, places, keys in ((self.word_at, self.tokens, self.words), (self.gram_at, ends, self.grams))
        )

    def nodes(self, order_n: int) -> np.ndarray:
        """At each place, the node of the ``order_n`` tokens that end there: words are nodes 1, 2, ..., longer n-grams follow."""
        out = np.zeros(len(self.h), np.int64)
        if order_n == 1:
            out[self.tokens] = self.word_at + 1
            out[self.first[:-1]] = out[self.first[1:] - 1]  # the end before a text is the token after one
        else:
            before = sum(map(len, self.ends[: order_n - 2]))
            places = self.ends[order_n - 2]
            out[places] = self.gram_at[before : before + len(places)] + (1 + len(self.words))
        return out

    def scores(self, word_n: np.ndarray, gram_n: np.ndarray, total: int, distinct: int) -> tuple[np.ndarray, ...]:
        """(n_tokens, n_known, base, score) of each document, from the corpus' counts of its keys."""
        model = Automaton(self, np.concatenate([[0], word_n, gram_n]).astype(np.float64), total + 0.5 * (distinct + 1))
        word = self.nodes(1)
        n_known = np.add.reduceat((model.count[word] > 0) & (self.ahead > 0), self.first[:-1]).astype(np.int64)
        weight = model.root[word]
        weight[self.first[:-1]] = 0
        base = np.add.reduceat(weight, self.first[:-1])
        return np.diff(self.first) - 1, n_known, base, model.traverse(word, self.first)


class Automaton:
    """The weighted backoff automaton of the n-grams of a chunk.

    States: the root (0) and each seen n-gram of less than ``order`` tokens. A seen n-gram of a
    state's tokens and one more is an arc; it leads to this n-gram's state, or to
    that without its first token if it has ``order`` of them. The failure arc leads to the state without the first token.
    The root has an arc for every word; that of an unseen one leads back to it.
    """

    def __init__(self, chunk: Chunk, count: np.ndarray, norm: float):
        """``count``: how often each node was seen; 0 makes it no state and no arc."""
        self.order, self.count = chunk.order, count
        n_words, n_nodes = len(chunk.words), len(count)
        self.fail = np.zeros(n_nodes, np.int64)
        p = np.full(n_nodes, 1.0)
        p[1 : n_words + 1] = (count[1 : n_words + 1] + 0.5) / norm
        self.root = np.log10(p[: n_words + 1])
        self.root_next = np.where(count[: n_words + 1] > 0, np.arange(n_words + 1), 0)
        keys, nexts, weights = [np.array([-1])], [np.array([0])], [np.zeros(1)]  # no key is -1: it stands in for an arc where there is none
        word = shorter = chunk.nodes(1)
        for n in range(2, self.order + 1):
            at, node, place = chunk.ends[n - 2], chunk.nodes(n), np.zeros(n_nodes, np.int64)
            place[node[at]] = at
            node_of = np.flatnonzero((place > 0) & (count > 0))  # seen n-grams of n tokens, and a place of each
            at = place[node_of]
            state, suffix = shorter[at - 1], shorter[at]
            self.fail[node_of] = suffix
            p[node_of] = (count[node_of] + MU * p[suffix]) / (count[state] + MU)
            keys.append(state << 32 | word[at])
            nexts.append(node_of if n < self.order else suffix)
            weights.append(np.log10(p[node_of]))
            shorter = node
        keys = np.concatenate(keys)
        sort = np.argsort(keys, kind="stable")
        self.arc, self.next, self.weight = keys[sort], np.concatenate(nexts)[sort], np.concatenate(weights)[sort]
        self.back = np.log10(MU / (count + MU))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log-probability) of each state's step by a word: failure arcs down to the first state with an arc for it, then this arc."""
        to, value = np.zeros(len(state), np.int64), np.zeros(len(state))
        lane, at = np.arange(len(state)), state
        for _ in range(self.order):
            up = at > 0
            ground = lane[~up]
            value[ground] += self.root[word[ground]]
            to[ground] = self.root_next[word[ground]]
            lane, at = lane[up], at[up]
            if not len(lane):
                break
            key = at << 32 | word[lane]
            arc = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            found = self.arc[arc] == key
            hit = lane[found]
            value[hit] += self.weight[arc[found]]
            to[hit] = self.next[arc[found]]
            lane, at = lane[~found], at[~found]
            value[lane] += self.back[at]
            at = self.fail[at]
        return to, value

    def traverse(self, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-probability of each document: its tokens are read once, from left to right, and the state is carried along.

        Documents are read side by side. A long one is cut into stretches of LANE tokens, each of which starts at the
        root ``order`` - 1 tokens early: a state is no longer than that, so the carried one is there when the stretch begins.
        """
        size = np.diff(first) - 1
        n = -(-size // LANE)
        doc = np.repeat(np.arange(len(size)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        left = np.minimum(size[doc] - k * LANE, LANE)
        by_length = np.argsort(-left, kind="stable")
        doc, k, left = doc[by_length], k[by_length], left[by_length]
        begin = first[doc] + 1 + k * LANE
        start = word[first[doc]]
        state = np.where((k == 0) & (self.count[start] > 0), start, 0)
        inner = np.flatnonzero(k)
        for early in range(self.order - 1, 0, -1):
            state[inner], _ = self.step(state[inner], word[begin[inner] - early])
        total = np.zeros(len(doc))
        active = np.searchsorted(-left, -np.arange(left.max(initial=0)), "left")  # stretches of more than j tokens
        for j, m in enumerate(active.tolist()):
            state[:m], value = self.step(state[:m], word[begin[:m] + j])
            total[:m] += value
        return np.bincount(doc, total, len(size))


def held_out(id_col: str):
    """crc32 of the id as text, mod 5, is 1; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def lm_scores(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text is empty: its one token is the end. A null id belongs to no fold
    and is learnt from. Repeated rows are scored alike and learnt from as often as they come. Without
    training rows all counts are 0 and each token has probability 1. An empty table gives no rows.
    A very long text is a chunk by itself. N-grams are counted by 64-bit hashes.
    Only the named columns are read, so extra ones can't clash.
    """
    rows = id_text(docs, id_col, text_col, held_out(id_col).alias("held_out"))
    def keys_of(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        chunk = Chunk(batch.column(1), order)
        counts = chunk.counts(~batch.column(2).to_numpy(zero_copy_only=False).astype(bool))
        return list(zip((chunk.words, chunk.grams), counts, strict=True))

    bits = bucket_bits(rows, KEYS_PER_BYTE)
    sums = {"tokens": lambda totals: totals["words"].sum(), "distinct_words": lambda totals: (totals["words"] > 0).sum()}
    answers = saved(count(send(rows, KINDS, bits, keys_of), KINDS, bits, packed, sums), "totals")
    total, distinct = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct_words"), F.lit(0))).first()

    def score(_: int, batch: pa.RecordBatch, parts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        counts = (np.concatenate(list(map(unpacked, x))) for x in parts)
        n_tokens, n_known, base, value = Chunk(batch.column(1), order).scores(*counts, total, distinct)
        learnt = pa.array(np.full(len(n_tokens), total, np.int64))
        columns = [batch.column(0), batch.column(2), pa.array(n_tokens), pa.array(n_known), learnt, pa.array(base), pa.array(value)]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCORES.split(", ")])

    return answered(rows, answers, KINDS, score, SCORES)
