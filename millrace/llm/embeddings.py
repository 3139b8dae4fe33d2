"""Embedding near-duplicates by E8 lattice hashing (operator 4).

Equal vectors are one representative first. Each of ``tables`` random Gaussian projections takes a
unit vector to eight coordinates, decoded to the nearest point of the E8 lattice: its cell. A
vector lives in its own cell and also visits the ``probes`` neighbouring cells (by the 240 shortest
lattice vectors) that it lies closest to. Vectors meet in a cell that is the own cell of at least
one of them, and are compared by cosine in double precision.

A link found in several tables or cells is counted once, by a rule that both vectors' cells settle
without any memory of other tables: it counts in the first table in which the two meet, there in
the own cell of the smaller id if the other one comes there. So no pairs leave a bucket: it gives
each vector's number of links and a tree of its linked vectors. A bucket of more than ``HOT`` rows is
split into pairs of chunks.

With the defaults some 97 in 100 pairs of cosine 0.95 meet, 999 in 1000 of 0.97, in 64 dimensions;
``scale`` sets the cells' size against the vectors and should grow slowly with their number.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those
with a null id, link with nothing and are their own component; vectors of different lengths never
link; repeated rows count as vectors of their own; different vectors of one id are one node, linked
to all that any of them links with; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.buckets import local_roots, map_buckets, segment_starts, split_hot, spread
from millrace.llm.common import arrow_map, components, mix64, stage, table

HOT = 4096
PAIRS = 1 << 15


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1, or eight of one half with evenly many signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


MINIMAL = _minimal()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    f = np.rint(x)
    d = x - f
    odd = np.flatnonzero(f.sum(axis=1).astype(np.int64) % 2)
    k = np.abs(d[odd]).argmax(axis=1)
    f[odd, k] += np.where(d[odd, k] >= 0, 1.0, -1.0)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: integers of even sum, or the same moved by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(near[:, None], a, b)


class Lattice:
    def __init__(self, tables: int = 8, probes: int = 2, scale: float = 1.0, seed: int = 11) -> None:
        self.tables, self.probes, self.scale, self.seed = tables, probes, scale, seed
        self.planes: dict[int, np.ndarray] = {}

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Keys (row, table, cell): the own cell first, then the neighbours visited."""
        d = unit.shape[1]
        if d not in self.planes:
            self.planes[d] = np.random.default_rng([self.seed, d]).normal(size=(self.tables, d, 8)) * self.scale
        out = np.empty((len(unit), self.tables, 1 + self.probes), np.uint64)
        for t in range(self.tables):
            x = np.round(unit @ self.planes[d][t], 6)  # the same cell whatever the order of summation
            own = nearest_e8(x)
            gain = (x - own) @ MINIMAL.T
            near = np.argsort(-np.round(gain, 6), axis=1, kind="stable")[:, :self.probes]
            for k in range(1 + self.probes):
                point = own if k == 0 else own + MINIMAL[near[:, k - 1]]
                h = np.full(len(unit), np.uint64(d * 1009 + t))
                for c in range(8):
                    h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + (2 * point[:, c]).astype(np.int64).view(np.uint64))
                out[:, t, k] = h
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _placed(reps: DataFrame, lattice: Lattice, kind: str) -> DataFrame:
    """One row for each cell that a representative lives in or visits."""

    def one(b: pa.RecordBatch) -> dict:
        vectors = b.column(2)
        size = np.diff(vectors.offsets.to_numpy())
        row, t, key, dim = [], [], [], []
        for d in np.unique(size):
            own = np.flatnonzero(size == d)
            cells = lattice.cells(_unit(_matrix(vectors.take(pa.array(own)))))
            n = lattice.tables * (1 + lattice.probes)
            row.append(np.repeat(own, n))
            t.append(np.tile(np.repeat(np.arange(lattice.tables), 1 + lattice.probes), len(own)))
            key.append(cells.reshape(-1))
            dim.append(np.full(len(own) * n, d))
        take = pa.array(np.concatenate(row))
        return {"t": np.concatenate(t).astype(np.int32), "dim": np.concatenate(dim).astype(np.int32), "key": np.concatenate(key).view(np.int64),
                "rep": b.column(0).take(take), "mult": b.column(1).take(take), "v": vectors.take(take)}

    return arrow_map(reps, one, f"t int, dim int, key long, rep long, mult long, v {kind}", ["rep", "mult", "v"])


def _links(x: np.ndarray, starts: np.ndarray, least: float):
    """Pairs (i, j), i < j, within the segments, of cosine at least ``least``."""
    size = np.diff(starts)
    large = np.flatnonzero(size > 256)
    for s in large:
        lo, hi = starts[s], starts[s + 1]
        for a in range(lo, hi, 512):
            for c in range(a, hi, 512):
                i, j = np.nonzero(x[a:min(a + 512, hi)] @ x[c:min(c + 512, hi)].T >= least)
                keep = i + a < j + c
                yield i[keep] + a, j[keep] + c
    small = np.flatnonzero((size > 1) & (size <= 256))
    todo = size[small] * (size[small] - 1) // 2
    for part in np.split(small, np.flatnonzero(np.diff(np.cumsum(todo) // PAIRS)) + 1):
        if not len(part):
            continue
        owner, rank = spread(size[part] ** 2)
        n = size[part][owner]
        i, j = starts[part][owner] + rank // n, starts[part][owner] + rank % n
        i, j = i[i < j], j[i < j]
        for k in range(0, len(i), PAIRS):
            a, c = i[k:k + PAIRS], j[k:k + PAIRS]
            keep = (x[a] * x[c]).sum(axis=1) >= least
            yield a[keep], c[keep]


def _bucket_links(lattice: Lattice, least: float):
    def per_rows(b: pa.RecordBatch) -> pa.RecordBatch | None:
        keys = [b.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        t, _, key, ci, cj = keys
        starts = segment_starts(keys)
        several = np.repeat(np.diff(starts), np.diff(starts)) > 1
        if not several.any():
            return None
        b = b.filter(pa.array(several))
        t, _, key, ci, cj = keys = [k[several] for k in keys]
        starts = segment_starts(keys)
        chunk, rep, mult = (b.column(k).to_numpy(zero_copy_only=False) for k in (5, 6, 7))
        out = []
        dims = keys[1]
        edges = segment_starts([dims])
        for lo, hi in zip(edges[:-1], edges[1:]):
            x = _unit(_matrix(b.column(8).slice(lo, hi - lo)))
            own = starts[(starts >= lo) & (starts <= hi)] - lo
            label = np.arange(hi - lo)
            counts = np.zeros(hi - lo, np.int64)
            for i, j in _links(x, own, least):
                cross = (ci[lo + i] == cj[lo + i]) | (chunk[lo + i] != chunk[lo + j])
                i, j = i[cross], j[cross]
                if not len(i):
                    continue
                rows, at = np.unique(np.concatenate((i, j)), return_inverse=True)
                cells = lattice.cells(x[rows])
                a, c = at[:len(i)], at[len(i):]
                swap = rep[lo + i] > rep[lo + j]
                a, c = np.where(swap, c, a), np.where(swap, a, c)  # a: of the smaller id
                first = np.ones(len(i), bool)
                here = np.zeros(len(i), bool)
                for k in range(lattice.tables):
                    a_to_c = (cells[c, k, :1] == cells[a, k]).any(axis=1)  # a comes to c's own cell
                    c_to_a = (cells[a, k, :1] == cells[c, k]).any(axis=1)
                    now = t[lo + i] == k
                    in_a = cells[a, k, 0] == key[lo + i].view(np.uint64)
                    in_c = cells[c, k, 0] == key[lo + i].view(np.uint64)
                    here |= now & (in_a | in_c & ~c_to_a)
                    first &= ~((k < t[lo + i]) & (a_to_c | c_to_a))
                good = first & here
                i, j = i[good], j[good]
                np.add.at(counts, i, mult[lo + j])
                np.add.at(counts, j, mult[lo + i])
                label = local_roots(hi - lo, i, j, label)
            hit = np.flatnonzero(counts)
            out.append((np.zeros(len(hit), np.int32), rep[lo:hi][hit], counts[hit]))
            far = np.flatnonzero(label != np.arange(hi - lo))
            out.append((np.ones(len(far), np.int32), rep[lo:hi][far], rep[lo:hi][label[far]]))
        kind, a, c = (np.concatenate(z) for z in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(c)], names=["kind", "a", "b"]) if len(kind) else None

    return per_rows


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95,
                    tables: int = 8, probes: int = 2, scale: float = 1.0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    lattice = Lattice(tables, probes, scale)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    kind = own.schema["v"].dataType.simpleString()
    bad = "x is null or isnan(x) or abs(x) = double('infinity')"
    fit = F.expr(f"vec_id is not null and v is not null and size(v) > 0 and not exists(v, x -> {bad}) and exists(v, x -> x != 0)")
    own = own.withColumn("fit", F.coalesce(fit, F.lit(False)))
    good = own.where("fit")
    reps = stage(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult")), "reps")
    cells = split_hot(_placed(reps, lattice, kind), ["t", "dim", "key"], "rep", HOT).select("t", "dim", "key", "ci", "cj", "chunk", "rep", "mult", "v")
    found = stage(map_buckets(cells, ["t", "dim", "key", "ci", "cj"], ["rep"], _bucket_links(lattice, least), "kind int, a long, b long"), "found")
    links = found.where("kind = 0").groupBy(F.col("a").alias("_a")).agg(F.sum("b").alias("links"))
    roots = components(found.where("kind = 1"), "a", "b")
    done = (reps.join(links, F.col("rep") == F.col("_a"), "left").join(roots, F.col("rep") == F.col("node"), "left")
            .select(F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    linked = good.join(done, F.col("v") == F.col("_v")).select("vec_id", "n_links", "component_id")
    alone = own.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
