"""The derived database: parquet tables in versions, each named by a manifest.

A change writes new files in a folder of its own and then puts the manifest of the next number, which one writer can do:
readers see the table of one manifest, and a crash in between leaves the last one. A writer that finds its number taken
looks at what the other has changed, and puts its own change after that, or does it again where both changed the same.
Tables that are merged into are cut into buckets by key, and a merge writes only the buckets that it touches. Earlier
versions are there to be read as long as their manifests are kept.
"""

from __future__ import annotations

import atexit
import functools
import json
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.sources.commits import Conflict, Log

#: Buckets of a table that is merged into, versions that are kept, and how often a writer tries again after others.
BUCKETS, KEEP, TRIES = 64, 2, 20


@functools.cache
def _own_folder() -> str:
    made = tempfile.mkdtemp(prefix="factloom-")
    atexit.register(shutil.rmtree, made, True)
    return made


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; in a local session without one, a temporary one of this process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base or _own_folder()).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder, so that what is made of it twice is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Table:
    """A versioned table at path. A manifest maps each bucket (one, named "", for tables that are replaced whole) to its
    folder. keep: how many versions stay readable."""

    def __init__(self, spark: SparkSession, path: str, keep: int = KEEP):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._files = self._fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._log = Log(spark, self.path, "_manifest")

    def versions(self) -> list[int]:
        """Versions that can be read, oldest first."""
        return self._log.numbers()

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Folders by bucket of a version, the last one if none is given; empty for a table that has none."""
        there = self.versions() if version is None else [version]
        return json.loads(self._log.text(there[-1])) if there else {}

    def _state(self) -> tuple[int, dict[str, str]]:
        there = self.versions()
        return (there[-1], json.loads(self._log.text(there[-1]))) if there else (0, {})

    def commit(self, based_on: int, manifest: dict[str, str]) -> int:
        """Put the manifest after version based_on. Raises Conflict if that isn't the last one any more."""
        if not self._log.put(based_on + 1, json.dumps(manifest)):
            raise Conflict(f"version {based_on + 1} of {self.path} is another writer's")
        self._expire()
        return based_on + 1

    def _expire(self) -> None:
        """Drop manifests beyond those kept, and the folders that only they name. Folders that no manifest has named may be
        another writer's, who hasn't finished; vacuum removes those by age."""
        there = self.versions()
        old, kept = there[: -self.keep], there[-self.keep :]
        names = lambda ns: {f.split("/")[0] for n in ns for f in json.loads(self._log.text(n)).values()}
        gone = names(old) - names(kept)
        for n in old:
            self._log.drop(n)
        for name in gone:
            self._files.delete(self._fs.Path(f"{self.path}/{name}"), True)

    def vacuum(self, seconds: float = 86_400.0) -> None:
        """Delete folders that no manifest names and that are older than `seconds`: what writers left who crashed."""
        named = {f.split("/")[0] for n in self.versions() for f in self.manifest(n).values()}
        for f in self._files.listStatus(self._fs.Path(self.path)):
            old = time.time() - f.getModificationTime() / 1000 > seconds
            if f.isDirectory() and old and f.getPath().getName() not in named:
                self._files.delete(f.getPath(), True)

    def replace(self, df: DataFrame, by: list[str] | None = None) -> int:
        """df instead of what is there, whatever other writers do meanwhile. Returns the version."""
        name = f"v-{uuid.uuid4().hex}"
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{self.path}/{name}")
        for _ in range(TRIES):
            try:
                return self.commit(self._state()[0], {"": name})
            except Conflict:
                continue
        raise Conflict(f"{self.path} changes all the time")

    def read(self, schema: StructType | str, version: int | None = None) -> DataFrame:
        """The table, as it is now or as it was at a version that is kept."""
        return self._folders(schema, set(self.manifest(version).values()))

    def _folders(self, schema: StructType | str, folders: set[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    def merge(self, new: DataFrame, key: str, order: str, buckets: int = BUCKETS) -> None:
        """The row of each key with the largest order, of new and of what is there. Run again, it changes nothing.

        Where another writer has changed the same buckets meanwhile, these are merged again.
        """
        bucket = F.pmod(F.hash(key), F.lit(buckets))
        todo = sorted(r[0] for r in new.select(bucket).distinct().collect())
        made: dict[str, str] = {}
        seen: dict[str, str] = {}
        for _ in range(TRIES):
            if not todo and not made:
                return
            at, was = self._state()
            # what was merged with a bucket that is another's by now is merged again
            again = [b for b in map(int, made) if was.get(str(b)) != seen.get(str(b))]
            todo = sorted({*todo, *again})
            if todo:
                name = f"v-{uuid.uuid4().hex}"
                old = [f"{self.path}/{was[str(b)]}" for b in todo if str(b) in was]
                mine = new.filter(bucket.isin(todo))
                both = mine.unionByName(self.spark.read.schema(new.schema).parquet(*old)) if old else mine
                best = both.groupBy(key).agg(F.max_by(F.struct(*both.columns), F.col(order)).alias("_r")).select("_r.*")
                try:
                    best.withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
                except Exception:
                    # what it read may be gone with versions that others have put since
                    if self._state()[0] == at:
                        raise
                    continue
                made |= {str(b): f"{name}/_bucket={b}" for b in todo}
                seen |= {str(b): was.get(str(b)) for b in todo}
                todo = []
            try:
                self.commit(at, was | made)
                return
            except Conflict:
                continue
        raise Conflict(f"{self.path} changes all the time")

    def changes(self, schema: StructType | str, key: str, before: int, after: int) -> DataFrame:
        """key, change (added, removed or changed), was, now: rows that two versions don't have alike, keys being unique in
        each. Buckets whose files both versions share aren't read."""
        old, new = self.manifest(before), self.manifest(after)
        shared = set(old.values()) & set(new.values())
        was, now = self._folders(schema, set(old.values()) - shared), self._folders(schema, set(new.values()) - shared)
        a = was.select(F.col(key).alias("_a"), F.struct(*was.columns).alias("was"))
        b = now.select(F.col(key).alias("_b"), F.struct(*now.columns).alias("now"))
        both = a.join(b, a._a.eqNullSafe(b._b), "full").filter(~F.col("was").eqNullSafe(F.col("now")))
        change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
        return both.select(F.coalesce("_a", "_b").alias(key), change.alias("change"), "was", "now")


def rebuild(spark: SparkSession, folder: str, tables: dict[str, DataFrame], by: dict[str, list[str]] | None = None) -> None:
    """Write every table and register it as a view of its name, so that filters reach the files."""
    for name, df in tables.items():
        table = Table(spark, f"{folder}/{name}")
        table.replace(df, (by or {}).get(name))
        table.read(df.schema).createOrReplaceTempView(name)
