"""Sharding by size-tiered compaction, with DataFrame operations only.

A store is a folder of immutable runs (folders of Parquet shards) and of
versioned manifests.  Arrivals are appended as runs of small shards.  A run
belongs to the tier floor(log(bytes / base) / log(fanout)); where a tier holds
`fanout` runs, all of its runs are merged into one run of files near the target
size, read and written without a shuffle.  A version is a manifest that lists
its runs.  It is written under a name of its own and renamed to its version's
name, which fails if that version exists: readers see a version as a whole or
not at all.  Of two writers one finds its version taken; it reads the newest
manifest and commits on top of that, as a run that was written once stays valid.
Merged runs stay until vacuum(), so readers of an older version are not
disturbed.  vacuum() leaves alone what the last versions list and what is
younger than an age, so runs that a writer has not committed yet are safe for
that long.

Rows are stored as they are: nulls, repeated rows, empty texts and further
columns of any name come back unchanged.  Columns that an arrival adds are null
in the rows before it, those that it lacks are null in its own; an arrival that
gives a column another type is refused before it is written.  Appending an empty
table commits a version without a new run.  Very long texts are rows like
others; a shard may exceed the target size by its last rows.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import fresh_path, unused

#: Bytes of a finished shard, of the smallest tier, and runs that make a tier merge.
TARGET_BYTES, BASE_BYTES, FANOUT = 64 << 20, 1 << 20, 4
#: Arrivals that a whole table is dealt out as.
ARRIVALS = 8
#: Commits that a writer tries before it gives up; seconds for which vacuum() leaves unlisted runs alone; versions it keeps whole.
TRIES, AGE, VERSIONS = 20, 24 * 3600, 1


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Run:
    name: str
    bytes: int
    files: int


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, base_bytes: int = BASE_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.base, self.fanout = spark, root.rstrip("/"), target_bytes, base_bytes, fanout
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # files

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def _list(self, name: str) -> list:
        return list(self._fs().listStatus(self._path(name))) if self._fs().exists(self._path(name)) else []

    def _measured(self, name: str) -> Run:
        files = [f.getLen() for f in self._list(f"runs/{name}") if f.getPath().getName().startswith("part-")]
        return Run(name, sum(files), len(files))

    # versions

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for f in self._list("manifests") if (n := f.getPath().getName()).startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Run], T.StructType | None]:
        """Version, its runs and the schema; version 0 is the empty store."""
        have = self.versions()
        version = version if version is not None else (have[-1] if have else 0)
        if not version:
            return 0, [], None
        stream = self._fs().open(self._path(f"manifests/v{version:09d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        told = json.loads(text)
        return version, [Run(**r) for r in told["runs"]], T.StructType.fromJson(told["schema"])

    def _commit(self, version: int, runs: list[Run], schema: T.StructType) -> int:
        """Write the manifest aside, then rename it to its version's name, which must be free."""
        jvm = self._jvm
        aside, name = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/v{version:09d}.json")
        out = self._fs().create(aside, False)
        out.write(bytearray(json.dumps({"version": version, "runs": [asdict(r) for r in runs], "schema": schema.jsonValue()}).encode()))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf).rename(aside, name, options)
        except Exception as e:
            self._fs().delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {version}") from e
            raise
        return version

    # data

    def _commit_on_newest(self, change: Callable[[list[Run], T.StructType | None], tuple[list[Run], T.StructType] | None]) -> int | None:
        """Commit what `change` makes of the newest runs and schema, again if another writer was faster; None if it makes nothing of them."""
        for _ in range(TRIES):
            version, runs, schema = self.manifest()
            made = change(runs, schema)
            if made is None:
                return None
            try:
                return self._commit(version + 1, *made)
            except CommitConflict:
                continue
        raise CommitConflict(f"{TRIES} tries")

    def _delete(self, name: str) -> None:
        self._fs().delete(self._path(f"runs/{name}"), True)

    def append(self, df: DataFrame, arrivals: int = 1) -> int:
        """Commit the rows of df as `arrivals` runs of small shards, dealt in turn."""
        self._merged(self.manifest()[2], df.schema)
        name, part = uuid.uuid4().hex, unused(df, "arrival")
        if arrivals == 1:
            df.write.option("compression", "zstd").parquet(f"{self.root}/runs/{name}")
            new = [name]
        else:
            dealt = df.withColumn(part, (F.monotonically_increasing_id() % arrivals).cast("int"))
            dealt.write.option("compression", "zstd").partitionBy(part).parquet(f"{self.root}/runs/{name}")
            new = [f"{name}/{part}={i}" for i in range(arrivals)]
        added = [r for r in map(self._measured, new) if r.files and r.bytes]
        try:
            return self._commit_on_newest(lambda runs, schema: (runs + added, self._merged(schema, df.schema)))
        except (CommitConflict, ValueError):
            self._delete(name)
            raise

    def _merged(self, have: T.StructType | None, more: T.StructType) -> T.StructType:
        """The columns of both, names matched as the session matches them."""
        if have is None:
            return more
        same = str if self.spark.conf.get("spark.sql.caseSensitive") == "true" else str.lower
        known, fields = {same(f.name): f for f in have}, list(have.fields)
        for f in more:
            old = known.get(same(f.name))
            if old is None:
                fields.append(T.StructField(f.name, f.dataType, True, f.metadata))
            elif old.dataType.simpleString() != f.dataType.simpleString():
                raise ValueError(f"column {f.name} is {old.dataType.simpleString()} in the store, {f.dataType.simpleString()} in the arrival")
        return T.StructType(fields)

    def tier(self, run: Run) -> int:
        """0 below base * fanout bytes, and one more for each further power of fanout."""
        return max(0, math.floor(math.log(max(run.bytes, 1) / self.base) / math.log(self.fanout)))

    def compact(self) -> int:
        """Merge tiers that hold `fanout` runs, smallest first, until none does; one commit for each merge."""
        while True:
            version, runs, schema = self.manifest()
            tiers: dict[int, list[Run]] = {}
            for r in runs:
                tiers.setdefault(self.tier(r), []).append(r)
            full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), None)
            if full is None:
                return version
            name, total = uuid.uuid4().hex, sum(r.bytes for r in full)
            files = max(1, math.ceil(total / self.target))
            self._read(full, schema).coalesce(files).write.option("compression", "zstd").parquet(f"{self.root}/runs/{name}")
            merged = self._measured(name)

            def swapped(runs: list[Run], schema: T.StructType, full=full, merged=merged):
                """The runs with the merged one for its parts; nothing if another writer has merged some of them."""
                return ([r for r in runs if r not in full] + [merged], schema) if set(full) <= set(runs) else None

            if self._commit_on_newest(swapped) is None:
                self._delete(name)

    def _read(self, runs: list[Run], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/runs/{r.name}" for r in runs))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        _, runs, schema = self.manifest(version)
        if schema is None:
            raise ValueError("the store is empty")
        return self._read(runs, schema) if runs else self.spark.createDataFrame([], schema)

    def placed(self, version: int | None = None) -> DataFrame:
        """read(), with the columns shard (file below the root), shard_bytes and version, under these names or unused ones."""
        df, at = self.read(version), self.manifest(version)[0]
        if not self.manifest(version)[1]:
            return df.withColumns({unused(df, "shard"): F.lit(None).cast("string"), unused(df, "shard_bytes"): F.lit(None).cast("long"), unused(df, "version"): F.lit(at)})
        return df.select("*", F.regexp_extract("_metadata.file_path", r"/runs/(.*)$", 1).alias(unused(df, "shard")), F.col("_metadata.file_size").alias(unused(df, "shard_bytes")), F.lit(at).alias(unused(df, "version")))

    def vacuum(self, versions: int = VERSIONS, age: float = AGE) -> list[str]:
        """Delete runs that none of the last `versions` lists and that have not changed for `age` seconds, and say which."""
        live = {part for v in self.versions()[-max(1, versions) :] for r in self.manifest(v)[1] for part in (r.name, r.name.split("/")[0])}
        before = (time.time() - age) * 1000
        gone = [n for f in self._list("runs") if (n := f.getPath().getName()) not in live and self._changed(n) <= before]
        for n in gone:
            self._delete(n)
        return gone

    def _changed(self, name: str) -> int:
        """When a run or one of its files last changed, in milliseconds."""
        files = self._list(f"runs/{name}")
        own = self._fs().getFileStatus(self._path(f"runs/{name}")).getModificationTime()
        return max([own, *(f.getModificationTime() for f in files), *(g.getModificationTime() for f in files if f.isDirectory() for g in self._list(f"runs/{name}/{f.getPath().getName()}"))])


def shard(docs: DataFrame, root: str | None = None, arrivals: int = ARRIVALS, **sizes) -> ShardStore:
    """A store of docs: dealt into arrivals, appended, compacted."""
    spark = docs.sparkSession
    store = ShardStore(spark, root or fresh_path(spark, "shards"), **sizes)
    store.append(docs, arrivals)
    store.compact()
    return store


def sharded(docs: DataFrame, root: str | None = None, arrivals: int = ARRIVALS, **sizes) -> DataFrame:
    """docs as the newest version holds them, with shard, shard_bytes and version."""
    return shard(docs, root, arrivals, **sizes).placed()
