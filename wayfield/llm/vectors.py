"""Vectors of whole numbers: packed rows, exact inner products, and the meeting of stored pages with packs of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGEST = 1 << 27  # components beyond are cut to it, so that a product of 64 of them still fits a long
PACKED = np.dtype("<i4")


def _binary(rows: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column whose values are consecutive stretches of ``rows``, so many items each."""
    off = np.concatenate([[0], np.cumsum(lengths)]) * rows.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def whole(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x) of the components of all good vectors one after the other, their lengths, and which rows are good.

    A null vector, or one with a null or non-finite component, isn't good.
    """
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    ends = np.cumsum(n)
    good = (bad[ends] == bad[ends - n]) & pc.is_valid(column).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        v = np.clip(np.floor(x[np.repeat(good, n)] * scale), -LARGEST, LARGEST)
    return v.astype(PACKED), n[good], good


def packed(df: DataFrame, scale: float, *more: str) -> DataFrame:
    """(vec_id, *more, vec, norm2, most): good vectors as packed whole numbers, with their squared length and largest component. ``df``: vec_id, vector, *more.

    Rows with a null vec_id take no part.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, n, good = whole(b.column("vector"), scale)
            starts = np.cumsum(n) - n
            square, most = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            if (some := n > 0).any():
                wide = v.astype(np.int64)
                square[some] = np.add.reduceat(wide * wide, starts[some])
                most[some] = np.maximum.reduceat(np.abs(wide), starts[some])
            rest = b.select(["vec_id", *more]).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*rest.columns, _binary(v, n), pa.array(square), pa.array(most)], ["vec_id", *more, "vec", "norm2", "most"])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("vec_id", *more)) + ", vec binary, norm2 long, most long"
    rows = df.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"), *more)
    return rows.mapInArrow(pack, schema.replace(f"vec_id {kinds['vec_id']}", "vec_id long", 1))


def unpack(values, dim: int) -> np.ndarray:
    """Packed vectors as the rows of a matrix; shorter ones are filled up with zeros."""
    values = list(values)
    if all(len(v) == dim * PACKED.itemsize for v in values):
        return np.frombuffer(b"".join(values), PACKED).reshape(len(values), dim)
    out = np.zeros((len(values), dim), PACKED)
    for row, v in zip(out, values, strict=True):
        v = np.frombuffer(v, PACKED)
        row[: len(v)] = v
    return out


def exact_kind(most_a: int, most_b: int, dim: int) -> type:
    """The number type in which inner products of such vectors are exact: floats while every sum fits their digits."""
    top = max(1, int(most_a)) * max(1, int(most_b)) * max(1, dim)
    return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64


def first_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k first of each group by falling score, then rising id; ordered by group and rank."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    fresh = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(fresh, np.diff(np.concatenate([fresh, [len(g)]])))
    return order[rank < k]


def meet(pages: DataFrame, packs: DataFrame, on: list[str], search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``search`` of each page set with each part of the query packs that ask for it.

    Both sides of a group are bounded: the pages of one key, and the packs of one part. Pages are
    copied only to the parts that ask for them.
    """
    key = [*on, "part"]
    keys = packs.select(*[F.col(c).alias(f"{c}_") for c in key]).distinct().select(*[F.col(f"{c}_").alias(c) for c in key])
    asked = pages.join(keys, on)
    return asked.groupBy(*key).cogroup(packs.groupBy(*key)).applyInPandas(search, schema)
