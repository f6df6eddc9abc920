"""What the operators share: tables, words, the shared folder, sized joins."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a lower-cased text that belong to words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
PLAIN_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: A side of a join is broadcast up to this many rows (of under 100 bytes each).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered(text: bytes | str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed; null is empty."""
    if text is None:
        return b""
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    return raw.lower()


def plain_words(text: bytes | str | None) -> list[bytes]:
    return PLAIN_WORD.findall(lowered(text))


def spaced_words(text: bytes | str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() parts at exactly these bytes."""
    return lowered(text).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and the master is local, one process holds driver and
    executors, and a temporary folder of its own is set.  On a cluster the
    setting has to be there.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/brindle/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Delete what this application's operators have written; DataFrames that they returned cannot be read any more."""
    delete(spark, own_dir(spark))


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors, gives true sizes."""
    return _written(df, fresh_path(df.sparkSession, tag))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables that an operator needs while it works, deleted when it is done.

    What its result reads is written by materialise() instead, and stays.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self._paths:
            delete(self._spark, path)

    def __call__(self, df: DataFrame, tag: str) -> DataFrame:
        self._paths.append(fresh_path(self._spark, tag))
        return _written(df, self._paths[-1])


def sized(side: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written side for broadcast if it has at most `most` rows, counted first; else leave the join to shuffle."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def unused(df: DataFrame, name: str) -> str:
    """A column name that df lacks, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
