"""Work on the groups of a key, bucket by bucket, with hot buckets split into pairs of chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_hot(df: DataFrame, keys: list[str], item: str, limit: int) -> DataFrame:
    """Add ``chunk``, ``ci`` and ``cj`` so that (keys, ci, cj) holds about 2 * limit rows at most.

    A key of more than ``limit`` rows is dealt by a hash of ``item`` into g chunks, and each
    row goes to the g cells that pair its chunk with every chunk: each two rows of the key
    still meet in a cell, no cell holds the whole key. Other keys have the one cell (0, 0).
    """
    hot = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
           .select(*[F.col(k).alias(f"_{k}") for k in keys], F.ceil(F.col("_n") / limit).cast("int").alias("_g")))
    cond = [F.col(k) == F.col(f"_{k}") for k in keys]
    out = df.join(hot, cond, "left").withColumn("_g", F.coalesce("_g", F.lit(1)))
    out = out.withColumn("chunk", F.pmod(F.xxhash64(item), F.col("_g")).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return out.withColumns({"ci": F.least("chunk", "_o"), "cj": F.greatest("chunk", "_o")}).drop("_o", "_g", *[f"_{k}" for k in keys])


def map_buckets(df: DataFrame, keys: list[str], order: list[str], per_rows, schema: str) -> DataFrame:
    """Deal rows by ``keys``, sort them, and hand whole buckets to ``per_rows(RecordBatch)``.

    ``per_rows`` gets one or more whole buckets at once and returns a RecordBatch or None.
    Memory is one Arrow batch and the largest bucket.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            same = np.ones(b.num_rows, bool)
            for c in cols:
                same &= c == c[-1]
            cut = b.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0  # start of the last bucket
            if same.all() and held:
                last = held[-1]
                goes_on = all(last.column(last.schema.get_field_index(k))[-1].as_py() == c[0] for k, c in zip(keys, cols))
                if goes_on:
                    held.append(b)
                    continue
            if cut or held:
                whole = pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
                held = []
                for x in whole.to_batches():
                    out = per_rows(x)
                    if out is not None:
                        yield out
            held.append(b.slice(cut))
        if held:
            for x in pa.Table.from_batches(held).combine_chunks().to_batches():
                out = per_rows(x)
                if out is not None:
                    yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def segment_starts(cols: list[np.ndarray]) -> np.ndarray:
    """Where each run of equal keys starts, and the number of rows at the end."""
    n = len(cols[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): owners (0, 0, 1, 1, 1) and ranks (0, 1, 0, 1, 2)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def local_roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Merge links a-b into ``label`` (an index of the least member each) until nothing changes."""
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        nxt = label.copy()
        np.minimum.at(nxt, la, low)
        np.minimum.at(nxt, lb, low)
        while True:
            jump = nxt[nxt]
            if (jump == nxt).all():
                break
            nxt = jump
        if (nxt == label).all():
            return label
        label = nxt
