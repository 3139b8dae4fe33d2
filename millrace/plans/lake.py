"""Snapshot tables over Parquet: immutable files, numbered JSON manifests, one atomic commit each.

A manifest lists the table's files with their partition values, its schema and, for a table dealt by
key, the number of buckets. Writers add files, then write the next manifest under another name and
rename it, which fails if another writer was first (appends try again on top of it), so a manifest is
whole or not there; files of a commit that fails are deleted. Readers resolve a version or a time. Appends land under ``data/`` by an atomic rename, so the
folder can also be read as a stream; rewrites land under ``snap/``. A commit may carry a query and
batch id; one that is already recorded is skipped, which makes replays of a micro-batch harmless.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer committed first."""


class SchemaChange(ValueError):
    """A column would change its type or a required merge was not asked for."""


class LakeTable:
    def __init__(self, spark: SparkSession, path: str, partition_by: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), tuple(partition_by)
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    # manifests

    def versions(self) -> list[int]:
        log = self._Path(f"{self.path}/_log")
        if not self._fs.exists(log):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(log) if s.getPath().getName().endswith(".json"))

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> dict:
        version = self.versions()[-1] if version is None else version
        stream = self._fs.open(self._Path(f"{self.path}/_log/{version:020d}.json"))
        try:
            return json.loads(bytes(self._io.toByteArray(stream)).decode())
        finally:
            stream.close()

    def version_at(self, when: float) -> int:
        """The last version committed at or before ``when`` (seconds since 1970)."""
        past = [v for v in self.versions() if self.manifest(v)["time"] <= when]
        if not past:
            raise LookupError(f"no version of {self.path} at {when}")
        return past[-1]

    def _publish(self, manifest: dict) -> int:
        v = manifest["version"]
        if (v - 1 if v else None) != (self.versions() or [None])[-1]:
            raise Conflict(f"{self.path}: version {v} is taken")
        tmp = self._Path(f"{self.path}/_log/{uuid.uuid4().hex}.tmp")
        out = self._fs.create(tmp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm, context = self.spark.sparkContext._jvm, self.spark.sparkContext
        option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        without_overwrite = context._gateway.new_array(option, 1)
        without_overwrite[0] = option.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), context._jsc.hadoopConfiguration()).rename(
                tmp, self._Path(f"{self.path}/_log/{v:020d}.json"), without_overwrite)
        except Exception as e:
            self._fs.delete(tmp, False)
            raise Conflict(f"{self.path}: version {v} is taken") from e
        return v

    def _recorded(self, commit: tuple[str, int] | None) -> bool:
        if commit is None or not self.exists():
            return False
        last = self.manifest().get("batches", {}).get(commit[0])
        return last is not None and commit[1] <= last

    # writing files

    def _write(self, df: DataFrame, home: str, commit: tuple[str, int] | None = None) -> list[dict]:
        name = f"{commit[0]}-{commit[1]}" if commit else uuid.uuid4().hex
        target = f"{self.path}/{home}/{name}"
        if not (commit and self._fs.exists(self._Path(target))):
            tmp = f"{self.path}/_tmp/{uuid.uuid4().hex}"
            copies = {f"_p_{c}": F.col(c).cast("string") for c in self.partition_by}
            out = df.withColumns(copies).hint("rebalance", *copies) if copies else df  # a large partition takes several tasks
            writer = out.write
            (writer.partitionBy(*copies) if copies else writer).parquet(tmp)
            self._fs.mkdirs(self._Path(f"{self.path}/{home}"))
            if not self._fs.rename(self._Path(tmp), self._Path(target)):
                raise Conflict(f"{target} exists")
        files, walk = [], self._fs.listFiles(self._Path(target), True)
        unquote = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        while walk.hasNext():
            s = walk.next()
            p = s.getPath()
            if p.getName().startswith(("_", ".")):
                continue
            part, up = {}, p.getParent()
            while up.getName().startswith("_p_"):
                k, _, value = up.getName()[3:].partition("=")
                part[k] = None if value == "__HIVE_DEFAULT_PARTITION__" else unquote(value)
                up = up.getParent()
            rel = p.toUri().getPath()
            files.append({"path": rel[rel.index(f"/{home}/{name}") + 1:], "part": part, "bytes": s.getLen()})
        return files

    def _merged(self, old: StructType | None, new: StructType, merge: bool) -> StructType:
        if old is None:
            return new
        have = {f.name: f.dataType for f in old}
        for f in new:
            if f.name in have and have[f.name] != f.dataType:
                raise SchemaChange(f"{f.name}: {have[f.name].simpleString()} would become {f.dataType.simpleString()}")
            if f.name not in have and not merge:
                raise SchemaChange(f"new column {f.name}")
        return StructType([*old.fields, *[f for f in new if f.name not in have]])

    def _commit(self, files, schema: StructType, merge: bool, action: str, commit=None, keep=None, buckets: int | None = None) -> int:
        """``keep`` says which of the present files stay; appends keep all and may try again."""
        try:
            return self._commit_files(files, schema, merge, action, commit, keep, buckets)
        except Exception:
            for f in files if commit is None else ():  # a named commit is tried again with the same files
                self._fs.delete(self._Path(f"{self.path}/{f['path']}"), False)
            raise

    def _commit_files(self, files, schema: StructType, merge: bool, action: str, commit, keep, buckets: int | None) -> int:
        for _ in range(20):
            now = self.manifest() if self.exists() else None
            old = StructType.fromJson(now["schema"]) if now else None
            batches = dict(now.get("batches", {})) if now else {}
            if commit:
                batches[commit[0]] = commit[1]
            stay = [f for f in (now["files"] if now else []) if keep is None or keep(f)]
            m = {"version": now["version"] + 1 if now else 0, "time": time.time(), "action": action, "partition_by": list(self.partition_by),
                 "schema": self._merged(old, schema, merge).jsonValue(), "files": stay + files, "batches": batches,
                 "buckets": buckets if buckets is not None else now.get("buckets", 0) if now else 0}
            try:
                return self._publish(m)
            except Conflict:
                if keep is not None:
                    raise
        raise Conflict(self.path)

    # operations

    def append(self, df: DataFrame, merge_schema: bool = False, commit: tuple[str, int] | None = None) -> int | None:
        if self._recorded(commit):
            return None
        if self.exists():
            self._merged(StructType.fromJson(self.manifest()["schema"]), df.schema, merge_schema)
        return self._commit(self._write(df, "data", commit), df.schema, merge_schema, "append", commit)

    def overwrite(self, df: DataFrame, merge_schema: bool = False) -> int:
        return self._commit(self._write(df, "snap"), df.schema, merge_schema, "overwrite", keep=lambda f: False)

    def overwrite_partitions(self, df: DataFrame, partitions: list[dict] | None = None, merge_schema: bool = False, commit=None) -> int | None:
        """Replace the partitions that ``df`` has rows of, and those listed, which may become empty."""
        if self._recorded(commit):
            return None
        files = self._write(df, "snap")
        gone = {tuple(sorted(f["part"].items())) for f in files} | {tuple(sorted((k, str(v)) for k, v in p.items())) for p in partitions or ()}
        return self._commit(files, df.schema, merge_schema, "overwrite partitions", commit, keep=lambda f: tuple(sorted(f["part"].items())) not in gone)

    def upsert(self, batch: DataFrame, keys: list[str], order: str, buckets: int = 0, commit: tuple[str, int] | None = None) -> int | None:
        """Latest row a key of ``batch`` replaces a match only if its ``order`` is greater; others are added.

        With ``buckets`` the table is dealt by key, and only buckets with keys of the batch are rewritten. Their
        number is the table's, from its first upsert on; another one given later is ignored.
        """
        if self._recorded(commit):
            return None
        if self.exists():
            buckets = self.manifest().get("buckets", 0)
        if buckets:
            self.partition_by = (BUCKET,)
            batch = batch.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        rest = [c for c in batch.columns if c not in {*keys, order}]
        fresh = batch.groupBy(*keys).agg(F.max(F.struct(F.col(order), *rest)).alias("_m")).select(*keys, "_m.*").select(*batch.columns)
        if not self.exists():
            return self._commit(self._write(fresh, "snap"), batch.schema, False, "upsert", commit, keep=lambda f: False, buckets=buckets)
        fresh = fresh.persist()
        touched = {str(r[0]) for r in fresh.select(BUCKET).distinct().collect()} if buckets else None  # at most ``buckets`` values
        mine = lambda f: touched is None or f["part"].get(BUCKET) in touched
        target = self._read([f for f in self.manifest()["files"] if mine(f)], StructType.fromJson(self.manifest()["schema"]))
        t, b = F.struct(*[F.col(f"t.{c}").alias(c) for c in batch.columns]), F.struct(*[F.col(f"b.{c}").alias(c) for c in batch.columns])
        on = [F.col(f"t.{k}") == F.col(f"b.{k}") for k in keys]
        there = lambda side: F.col(f"{side}._here").isNotNull()
        both = target.withColumn("_here", F.lit(1)).alias("t").join(fresh.withColumn("_here", F.lit(1)).alias("b"), on, "full")
        pick = F.when(~there("t"), b).when(there("b") & (F.col(f"b.{order}") > F.col(f"t.{order}")), b).otherwise(t)
        merged = both.select(pick.alias("r")).select("r.*")
        try:
            return self._commit(self._write(merged, "snap"), batch.schema, False, "upsert", commit, keep=lambda f: not mine(f))
        finally:
            fresh.unpersist()

    def _read(self, files: list[dict], schema: StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f['path']}" for f in files])

    def read(self, version: int | None = None, as_of: float | None = None, where: dict | None = None) -> DataFrame:
        """Rows of a version or time; ``where`` maps partition columns to values and skips other files."""
        m = self.manifest(self.version_at(as_of) if as_of is not None else version)
        wanted = {k: {str(x) for x in (v if isinstance(v, (list, tuple, set)) else [v])} for k, v in (where or {}).items()}
        files = [f for f in m["files"] if all(f["part"].get(k) in v for k, v in wanted.items())]
        out = self._read(files, StructType.fromJson(m["schema"]))
        return out.drop(BUCKET) if BUCKET in out.columns else out

    def stream(self) -> DataFrame:
        """Appended rows as a stream."""
        schema = StructType.fromJson(self.manifest()["schema"])
        return self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/data")

    def diff(self, old: int, new: int) -> DataFrame:
        """Rows of ``new`` that ``old`` lacks, with their multiplicity; columns that ``old`` lacks are null there."""
        now, before = self.read(new), self.read(old)
        return now.exceptAll(before.select(*[F.col(f.name) if f.name in before.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in now.schema]))

    # maintenance

    def compact(self, cluster_by: list[str], files: int = 8) -> int:
        """Rewrite into ``files`` ranges of the columns' Z-order (or plain order, for one column)."""
        m = self.manifest()
        df = self._read(m["files"], StructType.fromJson(m["schema"]))
        if len(cluster_by) == 1:
            out = df.repartitionByRange(files, *cluster_by).sortWithinPartitions(*cluster_by)
        else:
            out = df.withColumn("_z", z_value(df, cluster_by)).repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z")
        now, own = m["version"], self.partition_by
        self.partition_by = tuple(m["partition_by"])
        try:
            new = self._write(out, "snap")
        finally:
            self.partition_by = own
        if self.versions()[-1] != now:
            raise Conflict(self.path)
        return self._commit(new, df.schema, False, "compact", keep=lambda f: False)

    def drop_older(self, column: str, days: int, today: date) -> int:
        """Drop date partitions more than ``days`` days before ``today``."""
        limit = str(today - timedelta(days=days))
        m = self.manifest()
        return self._commit([], StructType.fromJson(m["schema"]), False, "retention", keep=lambda f: (f["part"].get(column) or "9") >= limit)

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete files and manifests that only versions before the last ``keep_versions`` have; returns files deleted."""
        all_ = self.versions()
        kept, gone = all_[-keep_versions:], all_[:-keep_versions]
        live = {f["path"] for v in kept for f in self.manifest(v)["files"]}
        dead = {f["path"] for v in gone for f in self.manifest(v)["files"]} - live
        for p in dead:
            self._fs.delete(self._Path(f"{self.path}/{p}"), False)
        for v in gone:
            self._fs.delete(self._Path(f"{self.path}/_log/{v:020d}.json"), False)
        self._fs.delete(self._Path(f"{self.path}/_tmp"), True)
        return len(dead)


def z_value(df: DataFrame, columns: list[str], bits: int = 6) -> Column:
    """Bits of the columns' quantile ranks in turn; the quantiles are at most 2**bits - 1 numbers a column."""
    numbers = {}
    for c in columns:
        kind = dict(df.dtypes)[c]
        x = F.col(c)
        if kind in ("string", "binary"):
            x = F.conv(F.rpad(F.hex(F.substring(x.cast("binary"), 1, 6)), 12, "0"), 16, 10)
        elif kind == "date":
            x = F.unix_date(x)
        elif kind.startswith("timestamp"):
            x = F.unix_micros(x.cast("timestamp"))
        numbers[c] = x.cast("double")
    at = [k / 2**bits for k in range(1, 2**bits)]
    cuts = df.agg(*[F.percentile_approx(x, at, 1000).alias(c) for c, x in numbers.items()]).first()
    out = F.lit(0).cast("long")
    for i, (c, x) in enumerate(numbers.items()):
        rank = _rank(cuts[c], x)
        for b in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(rank, b).bitwiseAND(F.lit(1)).cast("long"), b * len(columns) + i))
    return out


def _rank(cuts: list | None, x: Column) -> Column:
    """How many of ``cuts`` lie below ``x``; 0 for null."""
    held = F.array(*[F.lit(float(v)) for v in cuts or []]).cast("array<double>")
    return F.when(x.isNull(), 0).otherwise(F.size(F.filter(held, lambda v: v < x)))
