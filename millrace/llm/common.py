"""Shared helpers: inputs, staged tables, Arrow text access, connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_own_dirs: dict[str, str] = {}
_staged: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where unset (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="millrace-")
    return _own_dirs[app]


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    Tables are released by ``drop_staged`` or at interpreter exit.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def drop_staged(df: DataFrame) -> None:
    path = getattr(df, "_millrace_path", None)
    if path:
        _delete(df.sparkSession, path)
        _staged[:] = [x for x in _staged if x[1] != path]


def staged_so_far() -> int:
    return len(_staged)


def drop_since(mark: int, *kept: DataFrame) -> None:
    """Drop what was staged after ``mark`` was taken, but for ``kept``."""
    stay = {df._millrace_path for df in kept}
    for spark, path in _staged[mark:]:
        if path not in stay:
            _delete(spark, path)
    _staged[mark:] = [x for x in _staged[mark:] if x[1] in stay]


def keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` staged with a number for each row, and the name of its column."""
    key = "_row"
    while key.lower() in {c.lower() for c in df.columns}:
        key += "_"
    return stage(df.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _release() -> None:
    for spark, path in _staged:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone by now; the folder is scratch
            return


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).fill_null(b"").to_pylist()


SLICE = 1024  # rows handled at once: what Python holds beside a batch


def give_back() -> None:
    """Return freed memory to the system: workers are kept and reused, their free memory counts against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def sliced(batches, after=None):
    """The batches in slices of at most ``SLICE`` rows; at the end ``after`` is called and free memory given back."""
    try:
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                yield b.slice(k, SLICE)
    finally:
        if after:
            after()
        give_back()


def arrow_map(df: DataFrame, per_batch, schema: str, columns: list[str], after=None) -> DataFrame:
    """Apply ``per_batch(RecordBatch) -> dict of columns`` to the named columns, slice by slice; ``after()`` ends each partition."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in sliced(batches, after):
            out = per_batch(b)
            if out is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names=names)

    return df.select(*columns).mapInArrow(run, schema)


def held_out(doc_id, modulus: int, remainder: int):
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus) == remainder


def hash_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The ``rows`` rows that come first by a hash of their id; ``df`` has one row for each id.

    Only rows below a hash limit that about four times as many pass are sorted, so what tasks send does
    not grow with their number; should too few pass, all are.
    """
    top = 1 << 40
    h = F.pmod(F.xxhash64(id_col), F.lit(top))
    n = df.count()
    below = df.where(h < min(top, 4 * rows * top // max(1, n) + 1))
    return (below if below.count() >= min(rows, n) else df).orderBy(h, id_col).limit(rows)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    Takes undirected edges between longs, returns (node, root) for every node that has an
    edge, root being the least node of its component. Each round is a staged table, so a
    lost executor costs one round at most; nothing but two numbers reaches the driver.
    """
    cur = stage(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc")
    before = _checksum(cur)
    while before[0]:
        sym = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # staged, so that the join has an exchange of its own, which Spark can split at a hub
        low = stage(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = (sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        large = stage(large, "large")
        low2 = stage(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (large.join(low2, "u")
                 .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u != v").distinct())
        nxt = stage(small, "cc")
        after = _checksum(nxt)
        for old in (cur, low, large, low2):
            drop_staged(old)
        cur = nxt
        if after == before:
            break
        before = after
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _checksum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


_BYTE_MIX = np.random.default_rng(20240117).integers(1, 2**63, 257, dtype=np.uint64)
_M1 = np.uint64(0xD6E8FEB86659FD93)
_M1_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash, vectorised."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(mult: int, n: int) -> np.ndarray:
    """The first n powers modulo 2**64; kept between calls up to 4 M entries."""
    have = _powers.get(mult)
    if have is None or len(have) < n:
        have = np.full(1 << max(16, int(n - 1).bit_length()) if n else 1 << 16, np.uint64(mult))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 22:
            _powers[mult] = have
    return have[:n]


class Poly:
    """Hashes of any slices of a symbol array from one running sum, modulo 2**64."""

    def __init__(self, values: np.ndarray, mult: int = 0xD6E8FEB86659FD93) -> None:
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(mult, n), out=self.sums[1:])
        self.inv = powers(pow(mult, -1, 2**64), n + 1)

    def slices(self, start: np.ndarray, end: np.ndarray | None = None) -> np.ndarray:
        """Mixed hash of values[start:end] and its length; without ``end`` slice k ends before value k."""
        h = self.sums[:len(start)].copy() if end is None else self.sums.take(end)
        h -= self.sums.take(start)
        h *= self.inv.take(start)
        size = ((np.arange(len(start)) if end is None else end) - start).astype(np.uint64)
        size *= np.uint64(0x9E3779B97F4A7C15)
        h ^= size
        return mix64(h)

    def runs(self, size: int) -> np.ndarray:
        """``slices`` of all values[k:k + size] but the last one."""
        h = self.sums[size:-1] - self.sums[:max(0, len(self.sums) - 1 - size)]
        h *= self.inv[:len(h)]
        h ^= np.uint64(size * 0x9E3779B97F4A7C15 & 2**64 - 1)
        return mix64(h)


def symbols(data: np.ndarray) -> np.ndarray:
    return _BYTE_MIX[data]


def joined(texts: list[bytes], gap: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by ``gap``; and where each starts (one more at the end)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + len(gap) for t in texts), np.int64, len(texts)), out=starts[1:])
    return np.frombuffer(gap.join([*texts, b""]), np.uint8), starts


def groups_of(texts: list, limit: int = 2_000_000):
    """Index ranges of consecutive texts of about ``limit`` bytes together, to bound memory."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


SPACE = np.zeros(257, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(257, dtype=np.uint16)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word: the maximal runs of bytes other than 0x20 and 0x09 to 0x0D."""
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    return edge[0::2], edge[1::2]
