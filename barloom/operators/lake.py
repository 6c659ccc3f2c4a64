"""A keyed Parquet table with versions: upsert, time travel, compaction, vacuum.

Rows live under ``data/v=<folder>/<partition>=<value>``. A manifest names, for each version, the folder that holds each partition. An
upsert rewrites only the partitions it touches, into a folder of its own, and counts once its entry in ``_log`` is there: entry
``k`` is moved into place only if no other writer has made it, so of two writers that started from one version the second one starts
again from what the first has written. A job that dies leaves the last version whole. Reading lists the live folders only: they are
partition filters of one scan, however many upserts there were. Null partition values and null keys are values like others.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NULL_PART = "__null__"


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one in local mode where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="barloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Rows of a file of ``stored``: a file's rows are read in one task, however small its parts are cut.
FILE_ROWS = 500_000


def stored(frame: DataFrame) -> DataFrame:
    """``frame`` written once to the shared folder and read from there, for what reads it more than once."""
    path = f"{scratch(frame.sparkSession)}/frames/{uuid.uuid4().hex}"
    frame.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


class Conflict(RuntimeError):
    """Another writer has made the next version."""


class LakeTable:
    #: Times that a write starts again after another one came first.
    ATTEMPTS = 10

    def __init__(self, spark: SparkSession, path: str, keys: list[str], partition: str = "date"):
        if partition not in keys:
            raise ValueError("the partition column must be one of the keys")
        self.spark, self.path, self.keys, self.partition = spark, path, keys, partition

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _numbers(self, folder: str) -> list[int]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return [int(n) for s in fs.listStatus(p) if (n := s.getPath().getName()).isdigit()] if fs.exists(p) else []

    def version(self) -> int | None:
        """The latest version, None where there is no table."""
        return max(self._numbers("_log"), default=None)

    def _folder(self, version: int) -> int:
        """The folder that a version wrote."""
        fs, p = self._fs(f"{self.path}/_log/{version}")
        stream = fs.open(p)
        try:
            return int(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _manifest(self, version: int) -> DataFrame:
        return self.spark.read.schema("part string, v int").parquet(f"{self.path}/_versions/{self._folder(version)}")

    def _schema(self, version: int) -> str:
        return self.spark.read.schema("schema string").json(f"{self.path}/_schema/{self._folder(version)}").first()[0]

    def _part(self) -> Column:
        return F.coalesce(F.col(self.partition).cast("string"), F.lit(NULL_PART))

    def read(self, version: int | None = None) -> DataFrame:
        """The table, or an older version of it, in one scan of the folders in which its partitions live. The manifest, a row a partition,
        becomes the scan's filter."""
        version = self.version() if version is None else version
        if version is None:
            raise FileNotFoundError(self.path)
        schema, live = self._schema(version), {}
        for part, v in self._manifest(version).collect():
            live.setdefault(v, []).append(part)
        if not live:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, `v` int").parquet(f"{self.path}/data")
        rows = rows.where(reduce(lambda a, b: a | b, [(F.col("v") == v) & self._part().isin(parts) for v, parts in sorted(live.items())]))
        return rows.select(*[F.col(f"`{f.name}`") for f in rows.schema.fields if f.name != "v"])

    def _claim(self) -> int:
        """A folder number that no other writer has."""
        n = max(self._numbers("_claims"), default=-1) + 1
        while True:
            fs, p = self._fs(f"{self.path}/_claims/{n}")
            if fs.createNewFile(p):
                return n
            n += 1

    def _log(self, n: int, version: int) -> None:
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        fs, draft = self._fs(f"{self.path}/_drafts/{n}")
        stream = fs.create(draft, True)
        stream.write(bytearray(str(n).encode()))
        stream.close()
        fs.mkdirs(self._fs(f"{self.path}/_log")[1])
        final = fs.makeQualified(self._fs(f"{self.path}/_log/{version}")[1])
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(draft), final, none)
        except Exception as error:
            if fs.exists(final):
                raise Conflict(f"version {version} of {self.path} is there already") from error
            raise

    def _commit(self, rows: DataFrame, keep: DataFrame | None, version: int, spread: int = 1) -> int:
        """``spread``: files into which the rows of each partition are dealt."""
        n = self._claim()
        deal = [self.partition] if spread == 1 else [F.col(self.partition), F.pmod(F.xxhash64(*self.keys), F.lit(spread))]
        folder = f"{self.path}/data/v={n}"
        rows.repartition(*deal).write.mode("overwrite").partitionBy(self.partition).parquet(folder)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        self.spark.createDataFrame([(ddl,)], "schema string").coalesce(1).write.mode("overwrite").json(f"{self.path}/_schema/{n}")
        written = self.spark.read.schema(ddl).parquet(folder)
        manifest = written.select(self._part().alias("part")).distinct().withColumn("v", F.lit(n))
        if keep is not None:
            manifest = manifest.unionByName(keep)
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_versions/{n}")
        self._log(n, version)
        return version

    def _again(self, write) -> int:
        """``write`` of the latest version, until no other writer came first."""
        for _ in range(self.ATTEMPTS - 1):
            try:
                return write(self.version())
            except Conflict:
                continue
        return write(self.version())

    def overwrite(self, rows: DataFrame, spread: int = 1) -> int:
        return self._again(lambda version: self._commit(rows, None, 0 if version is None else version + 1, spread))

    def upsert(self, rows: DataFrame, spread: int = 1, order: list[str] | None = None) -> int:
        """Replace rows of the same keys, add the others; columns may be new. Only partitions in ``rows`` are rewritten. Of source rows that
        share a key the last by ``order`` counts, or else the one with the largest values, so that a job that runs again picks the
        same. ``rows`` is evaluated once, into a staging folder that is removed in the end."""
        staged = f"{self.path}/_staged/{uuid.uuid4().hex}"
        by = order or [f.name for f in rows.schema.fields if f.dataType.simpleString().split("<")[0] not in ("map", "variant")]
        best = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*[F.desc_nulls_last(c) for c in by]))
        rows.withColumn("_best", best).where("_best = 1").drop("_best").write.parquet(staged)
        rows = self.spark.read.schema(rows.schema).parquet(staged)

        def merge(version: int | None) -> int:
            if version is None:
                return self._commit(rows, None, 0, spread)
            touched = rows.select(self._part().alias("part")).distinct()
            old = self.read(version).withColumn("part", self._part()).join(touched, "part", "left_semi").drop("part")
            keys = rows.select(*[F.col(k).alias(f"_{k}") for k in self.keys])
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]
            merged = rows.unionByName(old.join(keys, same, "left_anti"), allowMissingColumns=True)
            keep = self._manifest(version).join(touched, "part", "left_anti").select("part", "v")
            return self._commit(merged, keep, version + 1, spread)

        done = self._again(merge)
        fs, p = self._fs(staged)
        fs.delete(p, True)
        return done

    def compact(self) -> int:
        """One folder again, one file a partition."""
        return self._again(lambda version: self._commit(self.read(version), None, version + 1))

    def vacuum(self, keep_versions: int = 1, dry_run: bool = True) -> list[str]:
        """Folders that none of the last versions uses; deleted, with the older versions' manifests, unless ``dry_run``. Folders that
        were claimed after the last version's are left to their writers."""
        last = self.version()
        first = max(0, last - keep_versions + 1)
        used = {r.v for k in range(first, last + 1) for r in self._manifest(k).select("v").distinct().collect()}
        newest = self._folder(last)
        fs, p = self._fs(f"{self.path}/data")
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        dead = sorted(n for n in names if n.startswith("v=") and int(n[2:]) not in used and int(n[2:]) < newest)
        if not dry_run:
            for n in dead:
                fs.delete(self._fs(f"{self.path}/data/{n}")[1], True)
            kept = {self._folder(k) for k in range(first, last + 1)}
            for n in self._numbers("_versions"):
                if n not in kept and n < newest:
                    for kind in ("_versions", "_schema"):
                        fs.delete(self._fs(f"{self.path}/{kind}/{n}")[1], True)
        return dead


def migrate(spark: SparkSession, parquet: str, path: str, keys: list[str], partition: str = "date") -> LakeTable:
    """A plain Parquet folder as the first version of a table; the folder stays as its own backup."""
    t = LakeTable(spark, path, keys, partition)
    t.overwrite(spark.read.option("mergeSchema", "true").parquet(parquet))
    return t
