"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word's input is the sum of a hashed word vector and the mean of hashed
vectors of its characters' n-grams; it depends on the word alone and is
computed once per distinct word of a chunk. All overlapping windows of a text
are scored and the text's score is that of its worst window.

Training takes a bounded, documented sample of the labelled rows: at most
SAMPLE_TOXIC documents of label 1 and SAMPLE_OTHER of label 0, the ones with the
least hash of their id, of at most SAMPLE_BYTES bytes each. Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import buffers, id_text, slices

WINDOW, STRIDE = 32, 16  # any span of 16 words lies in one window
HIDDEN, WORD_ROWS, CHAR_ROWS = 8, 1 << 15, 1 << 15
INPUT = 12
CHAR_GRAMS = (3, 4, 5)
LONGEST_WORD, WORD_STEP = 24, 16  # bytes: a longer run is cut into overlapping pieces, words of their own
SAMPLE_TOXIC, SAMPLE_OTHER, SAMPLE_BYTES = 1500, 5000, 4000
LEAST_STEPS = 600
F32 = np.float32
SCORES = "doc_id long, score double"


def text_words(text: pa.Array) -> words.Words:
    """Words in order; a run of more than LONGEST_WORD bytes is its pieces of that length, WORD_STEP apart, the last one at its end."""
    w = words.split(*buffers(text), words.ALNUM, lower=True, hashes=False)
    size = w.end - w.start
    pieces = np.maximum(1, -(-(size - LONGEST_WORD) // WORD_STEP) + 1)
    of = np.repeat(np.arange(len(size)), pieces)
    k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = w.start[of] + np.minimum(k * WORD_STEP, np.maximum(0, size[of] - LONGEST_WORD))
    end = np.minimum(start + LONGEST_WORD, w.end[of])
    first = np.concatenate([[0], np.cumsum(pieces)])[w.first]
    return words.Words(w.data, start, end, first, words.hashed(w.data, start, end))


def distinct_words(w: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the distinct word at each place; their hashes and the place of one occurrence of each."""
    hashes, one, number = np.unique(w.hash, return_index=True, return_inverse=True)
    return number.astype(np.int32), hashes, one


def char_rows(w: words.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character table for the words at ``at``, and the word (from 0) that each belongs to.

    n-grams run over the word between a begin and an end mark.
    """
    size = w.end[at] - w.start[at]
    wide = LONGEST_WORD + 2
    grid = np.zeros((len(at), wide), np.uint64)
    grid[:, 0] = 1
    col = np.arange(LONGEST_WORD)
    take = np.minimum(w.start[at][:, None] + col, max(0, len(w.data) - 1))
    inside = col < size[:, None]
    grid[:, 1:-1][inside] = w.data[take[inside]]
    grid[np.arange(len(at)), size + 1] = 2
    rows, owner = [], []
    with np.errstate(over="ignore"):
        for n in CHAR_GRAMS:
            h = np.zeros((len(at), wide - n + 1), np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + grid[:, k : k + wide - n + 1]
            h = words.mix(h + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15))
            good = np.arange(wide - n + 1) + n <= (size + 2)[:, None]
            rows.append((h[good] % np.uint64(CHAR_ROWS)).astype(np.int32))
            owner.append(np.nonzero(good)[0].astype(np.int32))
    return np.concatenate(rows), np.concatenate(owner)


def windows(first: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping windows: document, first word, number of words. A text without words has one empty window."""
    n = np.diff(first)
    count = np.maximum(1, -(-np.maximum(n - window, 0) // stride) + 1)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.minimum(k * stride, np.maximum(n[doc] - window, 0))
    return doc, first[doc] + begin, np.minimum(window, n[doc] - begin)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Model:
    """Parameters and the forward and backward pass. Shapes: (time, lane, feature)."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        scale = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(F32)
        self.p = {
            "word": (r.standard_normal((WORD_ROWS, INPUT)) * 0.1).astype(F32),
            "char": (r.standard_normal((CHAR_ROWS, INPUT)) * 0.3).astype(F32),
            "W0": scale(INPUT, 3 * HIDDEN), "U0": scale(HIDDEN, 3 * HIDDEN), "b0": np.zeros(3 * HIDDEN, F32),
            "W1": scale(INPUT, 3 * HIDDEN), "U1": scale(HIDDEN, 3 * HIDDEN), "b1": np.zeros(3 * HIDDEN, F32),
            "A": scale(2 * HIDDEN, 8), "a": scale(8, 1)[:, 0], "o": scale(2 * HIDDEN, 1)[:, 0], "c": np.full(1, -1.5, F32),
        }

    def inputs(self, w: words.Words, hashes: np.ndarray, at: np.ndarray):
        """Input vectors of distinct words, and what the backward pass needs of them."""
        rows, owner = char_rows(w, at)
        count = np.maximum(1, np.bincount(owner, minlength=len(at))).astype(F32)
        order = np.argsort(owner, kind="stable")
        rows, owner = rows[order], owner[order]
        x = self.p["word"][(hashes % np.uint64(WORD_ROWS)).astype(np.int64)].copy()
        if len(owner):
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            x[owner[cuts]] += np.add.reduceat(self.p["char"][rows], cuts, axis=0) / count[owner[cuts]][:, None]
        return x, (rows, owner, count)

    def run(self, gates: list[np.ndarray], number: np.ndarray, begin: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logits of windows of at least one word; ``gates``: input part of both directions' gates per distinct word."""
        steps, lanes, h3 = int(size.max()), len(size), HIDDEN
        t = np.arange(steps)[:, None]
        place = np.minimum(begin + t, len(number) - 1)
        idx = number[place]  # (time, lane)
        live = (t < size).astype(F32)[:, :, None]
        hs, saved = [], []
        for d in (0, 1):
            U = self.p[f"U{d}"]
            h = np.zeros((lanes, HIDDEN), F32)
            H = np.empty((steps, lanes, HIDDEN), F32)
            kept = []
            for s in range(steps) if d == 0 else range(steps - 1, -1, -1):
                g = gates[d][idx[s]]
                zr = _sigmoid(g[:, : 2 * h3] + h @ U[:, : 2 * h3])
                z, r = zr[:, :h3], zr[:, h3:]
                n = np.tanh(g[:, 2 * h3 :] + (r * h) @ U[:, 2 * h3 :])
                new = h + live[s] * (1 - z) * (n - h)
                if keep:
                    kept.append((s, h, z, r, n))
                h = new
                H[s] = h
            hs.append(H)
            saved.append(kept)
        H = np.concatenate(hs, axis=2)
        T = np.tanh(H @ self.p["A"])
        e = np.where(live[:, :, 0] > 0, T @ self.p["a"], F32(-1e9))
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = (alpha[:, :, None] * H).sum(axis=0)
        logit = pooled @ self.p["o"] + self.p["c"][0]
        return logit, (idx, live, saved, H, T, alpha, pooled) if keep else None

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in (0, 1)]

    def gradients(self, x, rows, back, dlogit: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
        """Back-propagation through attention, both directions and the input tables."""
        idx, live, saved, H, T, alpha, pooled = back
        p, g, h3 = self.p, {}, HIDDEN
        g["o"], g["c"] = pooled.T @ dlogit, np.array([dlogit.sum()], F32)
        dpool = dlogit[:, None] * p["o"]
        dalpha = (H * dpool).sum(axis=2)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        g["a"] = np.tensordot(de, T, ([0, 1], [0, 1]))
        dT = de[:, :, None] * p["a"] * (1 - T * T)
        g["A"] = np.tensordot(H, dT, ([0, 1], [0, 1]))
        dH = alpha[:, :, None] * dpool + dT @ p["A"].T
        dx = np.zeros_like(x)
        for d in (0, 1):
            U, W = p[f"U{d}"], p[f"W{d}"]
            dU, dgate = np.zeros_like(U), np.zeros((len(x), 3 * HIDDEN), F32)
            dh = np.zeros((H.shape[1], HIDDEN), F32)
            for s, h, z, r, n in reversed(saved[d]):
                dh = dh + dH[s][:, d * HIDDEN : (d + 1) * HIDDEN]
                dn = live[s] * dh * (1 - z) * (1 - n * n)
                dz = -live[s] * dh * (n - h) * z * (1 - z)
                drh = dn @ U[:, 2 * h3 :].T
                dr = drh * h * r * (1 - r)
                zr = np.concatenate([dz, dr], axis=1)
                dU[:, : 2 * h3] += h.T @ zr
                dU[:, 2 * h3 :] += (r * h).T @ dn
                np.add.at(dgate, idx[s], np.concatenate([zr, dn], axis=1))
                dh = dh * (1 - live[s] * (1 - z)) + drh * r + zr @ U[:, : 2 * h3].T
            g[f"U{d}"], g[f"W{d}"], g[f"b{d}"] = dU, x.T @ dgate, dgate.sum(axis=0)
            dx += dgate @ W.T
        chars, owner, count = rows
        g["word"] = ((hashes % np.uint64(WORD_ROWS)).astype(np.int64), dx)
        g["char"] = (chars, dx[owner] / count[owner][:, None])
        return g


def train(text: list[str], label: np.ndarray, epochs: int | None = None, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Model:
    """Fit by Adam on whole documents: a document's logit is that of its worst window.

    Without ``epochs``, 5 passes, or on a small sample as many as make LEAST_STEPS steps (30 at most).
    """
    epochs = epochs or min(30, max(5, -(-LEAST_STEPS * batch // max(1, len(text)))))
    model, r = Model(seed), np.random.default_rng(seed)
    if not len(text) or label.min() == label.max():
        model.p["c"][:] = -3 if not len(text) or label.max() == 0 else 3
        model.p["o"][:] = 0
        return model
    mean = {k: np.zeros_like(v) for k, v in model.p.items()}
    square = {k: np.zeros_like(v) for k, v in model.p.items()}
    w = text_words(pa.array(text, pa.string()))
    number, hashes, one = distinct_words(w)
    doc, begin, size = windows(w.first)
    groups = [np.flatnonzero((doc == d) & (size > 0)) for d in range(len(text))]
    usable = np.array([d for d in range(len(text)) if len(groups[d])], np.int64)
    step = 0
    for epoch in range(epochs):
        r.shuffle(usable)
        for k in range(0, len(usable), batch):
            step += 1
            docs = usable[k : k + batch]
            take = np.concatenate([groups[d] for d in docs])
            lane_doc = np.repeat(np.arange(len(docs)), [len(groups[d]) for d in docs])
            places = np.concatenate([np.arange(begin[j], begin[j] + size[j]) for j in take])
            local, inverse = np.unique(number[places], return_inverse=True)
            at = np.cumsum(size[take]) - size[take]
            x, rows = model.inputs(w, hashes[local], one[local])
            gates = model.gates(x)
            logit, _ = model.run(gates, inverse, at, size[take])
            worst = np.full(len(docs), -np.inf)
            np.maximum.at(worst, lane_doc, logit)
            top = np.array([np.flatnonzero((lane_doc == i) & (logit == worst[i]))[0] for i in range(len(docs))])
            logit, back = model.run(gates, inverse, at[top], size[take][top], keep=True)
            dlogit = ((_sigmoid(logit) - label[docs]) / len(docs)).astype(F32)
            lr = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * (1 - epoch / (epochs + 1))
            for name, g in model.gradients(x, rows, back, dlogit, hashes[local]).items():
                m, v, value = mean[name], square[name], model.p[name]
                if isinstance(g, tuple):  # only the touched rows of a table
                    which, back_ = np.unique(g[0], return_inverse=True)
                    total = np.zeros((len(which), g[1].shape[1]), F32)
                    np.add.at(total, back_, g[1])
                    m[which] = 0.9 * m[which] + 0.1 * total
                    v[which] = 0.999 * v[which] + 0.001 * total * total
                    value[which] -= (lr * m[which] / (np.sqrt(v[which]) + 1e-8)).astype(F32)
                else:
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    value -= (lr * m / (np.sqrt(v) + 1e-8)).astype(F32)
    return model


def score_texts(model: Model, text: pa.Array, lanes: int = 8192) -> np.ndarray:
    """Score of each text: the greatest over all its windows; texts without words get that of an empty state."""
    w = text_words(text)
    out = np.full(len(text), model.p["c"][0], np.float64)
    if len(w):
        number, hashes, one = distinct_words(w)
        gates = model.gates(model.inputs(w, hashes, one)[0])
        doc, begin, size = windows(w.first)
        full = np.flatnonzero(size > 0)
        full = full[np.argsort(size[full], kind="stable")]
        best = np.full(len(text), -np.inf)
        for k in range(0, len(full), lanes):
            part = full[k : k + lanes]
            logit, _ = model.run(gates, number, begin[part], size[part])
            np.maximum.at(best, doc[part], logit)
        out = np.where(np.isfinite(best), best, out)
    return _sigmoid(out)


def training_sample(docs: DataFrame, labels: DataFrame, toxic_docs: int, other_docs: int, most_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """The bounded sample (doc_id, toxic, text): of each label the documents with the least hash among rows outside the held-out fold."""
    rows = id_text(docs, id_col, text_col).filter((F.octet_length("text") <= most_bytes) & ~held_out("doc_id"))
    known = labels.filter(F.col("toxic").isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    both = rows.select("doc_id").join(known.filter(~held_out("doc_id")), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rank = F.xxhash64("doc_id", F.lit(11))
    take = [both.filter(F.col("toxic") == y).orderBy(rank, "doc_id").limit(n) for y, n in ((0, other_docs), (1, toxic_docs))]
    sample = take[0].unionByName(take[1])  # at most toxic_docs + other_docs ids, so it can be broadcast and the texts stay where they are
    return rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def held_out(id_col: str):
    """crc32 of the id as text, mod 4, is 2; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, toxic_docs: int = SAMPLE_TOXIC, other_docs: int = SAMPLE_OTHER, most_bytes: int = SAMPLE_BYTES,
    id_col: str = "doc_id", text_col: str = "text",
) -> Model:
    """The network of the labelled sample, trained in one task: the sample is bounded, and only the parameters come to the driver.

    A row without label or id isn't learnt from; of rows that repeat an id the least text is; an empty table gives a constant score.
    """

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        model = train(pdf["text"].tolist(), pdf["toxic"].to_numpy(F32))
        return pd.DataFrame({"name": list(model.p), "value": [v.tobytes() for v in model.p.values()]})

    sample = training_sample(docs, labels, toxic_docs, other_docs, most_bytes, id_col, text_col)
    learnt = sample.groupBy(F.lit(1).alias("one")).applyInPandas(learn, "name string, value binary").collect()
    if not learnt:
        return train([], np.zeros(0, F32))
    model = Model()
    model.p = {r.name: np.frombuffer(r.value, F32).reshape(model.p[r.name].shape).copy() for r in learnt}
    return model


def score_column(docs: DataFrame, model: Model, schema, text_at: int, out_names: list[str], keep_below: float | None = None) -> DataFrame:
    """Append each row's score, or with ``keep_below`` drop the rows that reach it; null text is scored as empty, long ones whole."""
    p = model.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.__new__(Model)
        m.p = p
        for whole in batches:
            name = whole.schema.names[text_at]
            for batch in slices(whole, name):
                score = score_texts(m, batch.column(text_at))
                if keep_below is not None:
                    yield batch.filter(pa.array(score < keep_below))
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=out_names)

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **sample) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (score >= threshold).

    Null text is empty; texts without words get the network's bias alone. A long run without a space is scored whole, in
    pieces. Repeated rows are scored
    alike; an empty table gives no rows; without labels of both kinds the score is a constant.
    Only the named columns are read, so extra ones can't clash.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **sample)
    scored = score_column(id_text(docs, id_col, text_col), model, SCORES, 1, ["doc_id", "score"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
