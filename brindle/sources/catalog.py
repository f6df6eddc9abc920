"""The eight-table star schema: types, loaders and registered views.

Each table of a folder is Parquet or, failing that, a pipe-separated ``.tbl``
file.  A table with all columns of the full schema is read as it is.  Of the
reduced test files, the missing columns and the missing ``partsupp`` are
derived.  The derivation is SQL text that Spark and any other engine can run
alike, so results stay comparable; derived data are synthetic.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType, TimestampNTZType, TimestampType

# The published column lists of the schema.
SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string, r_comment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int, n_comment string",
    "supplier": "s_suppkey bigint, s_name string, s_address string, s_nationkey int, s_phone string, s_acctbal decimal(15,2), s_comment string",
    "customer": "c_custkey bigint, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal decimal(15,2), c_mktsegment string, c_comment string",
    "part": "p_partkey bigint, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice decimal(15,2), p_comment string",
    "partsupp": "ps_partkey bigint, ps_suppkey bigint, ps_availqty int, ps_supplycost decimal(15,2), ps_comment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice decimal(15,2), o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity decimal(15,2), l_extendedprice decimal(15,2), l_discount decimal(15,2), l_tax decimal(15,2), l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string",
}

#: Views over the reduced files (``raw_<table>``), as SQL that both engines run.
#: Dates that are stored as timestamps at midnight stay so: comparisons with dates then reach the scan.
DERIVED: dict[str, str] = {
    "region": "SELECT CAST(r_regionkey AS INT) AS r_regionkey, r_name FROM raw_region",
    "nation": "SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name, CAST(n_regionkey AS INT) AS n_regionkey FROM raw_nation",
    "supplier": """SELECT s_suppkey, s_name, s_nationkey, CAST(s_acctbal AS DECIMAL(15,2)) AS s_acctbal,
        CONCAT('Dock ', CAST(s_suppkey % 97 AS VARCHAR(5))) AS s_address,
        CONCAT(CAST(10 + s_nationkey AS VARCHAR(5)), '-', CAST(100 + s_suppkey % 900 AS VARCHAR(5)), '-', CAST(1000 + s_suppkey % 9000 AS VARCHAR(6))) AS s_phone,
        CASE WHEN s_suppkey % 23 = 0 THEN 'slow Customer reply and many Complaints' ELSE 'steady deliveries' END AS s_comment
        FROM raw_supplier""",
    "customer": """SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(15,2)) AS c_acctbal, c_mktsegment,
        CONCAT('Street ', CAST(c_custkey % 89 AS VARCHAR(5))) AS c_address,
        CONCAT(CAST(10 + c_nationkey AS VARCHAR(5)), '-', CAST(100 + c_custkey % 900 AS VARCHAR(5)), '-', CAST(1000 + c_custkey % 9000 AS VARCHAR(6))) AS c_phone,
        CASE WHEN c_custkey % 5 = 0 THEN 'asks for special packaging' ELSE 'regular account' END AS c_comment
        FROM raw_customer""",
    "part": """SELECT p_partkey, p_name, p_brand, p_type, p_size, CAST(p_retailprice AS DECIMAL(15,2)) AS p_retailprice,
        CONCAT('Manufacturer#', CAST(1 + p_partkey % 5 AS VARCHAR(5))) AS p_mfgr,
        CONCAT(CASE p_partkey % 3 WHEN 0 THEN 'SM' WHEN 1 THEN 'MED' ELSE 'LG' END, ' ',
            CASE CAST(FLOOR(p_partkey / 3) AS BIGINT) % 4 WHEN 0 THEN 'CASE' WHEN 1 THEN 'BOX' WHEN 2 THEN 'PACK' ELSE 'PKG' END) AS p_container
        FROM raw_part""",
    "partsupp": """SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey,
        CAST(1 + (l_partkey * 31 + l_suppkey * 17) % 9999 AS INT) AS ps_availqty,
        CAST(CAST(100 + (l_partkey * 13 + l_suppkey * 7) % 99900 AS DOUBLE) / 100 AS DECIMAL(15,2)) AS ps_supplycost
        FROM raw_lineitem""",
    "orders": """SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(15,2)) AS o_totalprice, o_orderdate, o_orderpriority,
        CAST(0 AS INT) AS o_shippriority,
        CASE WHEN o_orderkey % 37 = 0 THEN 'pending special slow requests' ELSE 'regular deposits' END AS o_comment
        FROM raw_orders""",
    "lineitem": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
        CAST(l_quantity AS DECIMAL(6,2)) AS l_quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS l_extendedprice, CAST(l_discount AS DECIMAL(4,2)) AS l_discount, CAST(l_tax AS DECIMAL(4,2)) AS l_tax,
        l_returnflag, l_linestatus, l_shipdate,
        CAST(l_shipdate AS DATE) + CAST((l_orderkey * 7 + l_partkey * 3 + l_linenumber * 11) % 61 - 30 AS INT) AS l_commitdate,
        CAST(l_shipdate AS DATE) + CAST(1 + (l_orderkey * 5 + l_suppkey * 3 + l_linenumber) % 30 AS INT) AS l_receiptdate,
        CASE (l_orderkey + l_partkey + l_linenumber * 3) % 7 WHEN 0 THEN 'AIR' WHEN 1 THEN 'REG AIR' WHEN 2 THEN 'MAIL' WHEN 3 THEN 'SHIP' WHEN 4 THEN 'RAIL' WHEN 5 THEN 'TRUCK' ELSE 'FOB' END AS l_shipmode,
        CASE (l_orderkey + l_suppkey) % 4 WHEN 0 THEN 'DELIVER IN PERSON' WHEN 1 THEN 'COLLECT COD' WHEN 2 THEN 'NONE' ELSE 'TAKE BACK RETURN' END AS l_shipinstruct
        FROM raw_lineitem""",
}

#: Derived tables that are written once, not derived again in every query.
KEPT = ("partsupp",)
#: Rows up to which a table is one file.
SMALL = 50_000

_FROM = re.compile(r"\braw_(\w+)\b")

#: For each session the tables and views that it has resolved, by path, bytes and time of change of their files,
#: so that footers and folders are read once for each state of a file, and derived tables are written once.
_RESOLVED: weakref.WeakKeyDictionary[SparkSession, dict[tuple, DataFrame]] = weakref.WeakKeyDictionary()


def _resolved(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    known = _RESOLVED.setdefault(spark, {})
    if key not in known:
        known[key] = make()
    return known[key]


def _state(spark: SparkSession, path: str) -> tuple | None:
    """Path, bytes and time of change, of a folder those of its files; None if there is nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    own = fs.getFileStatus(at)
    if own.isFile():
        return (path, own.getLen(), own.getModificationTime())
    files = fs.listStatus(at)
    return (path, sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0), len(files))


def exists(spark: SparkSession, path: str) -> bool:
    return _state(spark, path) is not None


def locate(spark: SparkSession, folder: str, name: str) -> tuple[str, str, tuple] | None:
    """(format, path, state) of a table: what ingest() has prepared, else Parquet, else a ``.tbl`` file or folder; None without any."""
    for kind, path in (("prepared", f"{folder}/{name}.prepared"), ("parquet", f"{folder}/{name}.parquet"), ("parquet", f"{folder}/{name}"), ("tbl", f"{folder}/{name}.tbl")):
        state = _state(spark, path)
        if state:
            return kind, path, state
    return None


def source(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """The table as it is stored, or None."""
    found = locate(spark, folder, name)
    if found is None:
        return None
    kind, path, state = found
    return _resolved(spark, (name, state), lambda: read_tbl(spark, path, name) if kind == "tbl" else spark.read.parquet(path))


def typed(df: DataFrame, name: str) -> DataFrame:
    """df in the types of the full schema; dates that are stored as timestamps at midnight stay so."""
    kinds = {f.name: f.dataType for f in StructType.fromDDL(SCHEMAS[name])}
    have = {f.name: f.dataType for f in df.schema}
    keep = {c for c, t in kinds.items() if have[c] == t or (t == DateType() and isinstance(have[c], (TimestampType, TimestampNTZType)))}
    return df.select(*(F.col(c) if c in keep else F.col(c).cast(t).alias(c) for c, t in kinds.items()))


def is_full(df: DataFrame | None, name: str) -> bool:
    return df is not None and set(StructType.fromDDL(SCHEMAS[name]).names) <= set(df.columns)


def load(spark: SparkSession, folder: str, views: tuple[str, ...] = tuple(DERIVED)) -> bool:
    """Register views; True if all come from tables of the full schema, False if one of them is derived from reduced files."""
    full = True
    for v in views:
        found = locate(spark, folder, v)
        df = source(spark, folder, v) if found else None
        if found and found[0] == "prepared":
            full, out = False, df
        elif is_full(df, v):
            out = _resolved(spark, ("full", v, found[2]), lambda df=df, v=v: typed(df, v))
        else:
            full = False
            states = tuple(locate(spark, folder, name) for name in _sources(v))
            out = _resolved(spark, ("derived", v, states), lambda v=v: derived(spark, folder, v))
        out.createOrReplaceTempView(v)
    return full


def _sources(view: str) -> list[str]:
    """The tables that a view is derived from."""
    return sorted(set(_FROM.findall(DERIVED[view])))


def derived(spark: SparkSession, folder: str, view: str) -> DataFrame:
    """A view over reduced files.  One that costs a pass over its sources is written, in the folder that the cluster shares, and read again."""
    for name in _sources(view):
        df = source(spark, folder, name)
        if df is None:
            raise FileNotFoundError(f"neither {name}.parquet nor {name}.tbl in {folder}")
        df.createOrReplaceTempView(f"raw_{name}")
    df = spark.sql(DERIVED[view])
    if view not in KEPT:
        return df
    path = f"{shared_folder(spark)}/derived/{view}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A folder below spark.checkpoint.dir.  A local master without that setting has one process and gets a folder of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/brindle"


def on_views(sql: str) -> str:
    """Query text with its {table} marks put to the registered views."""
    return sql.format_map({v: v for v in DERIVED})


def used_views(sql: str) -> tuple[str, ...]:
    return tuple(v for v in DERIVED if f"{{{v}}}" in sql)


def portable(sql: str) -> str:
    """Query text as one statement over the files' own names: the views it marks become common table expressions."""
    used = used_views(sql)
    parts = ", ".join(f"x_{v} AS ({_FROM.sub(lambda m: m.group(1), DERIVED[v])})" for v in used)
    body = sql.format_map({v: f"x_{v}" for v in used})
    head = re.match(r"\s*WITH\s+", body, re.I)
    return f"WITH {parts}, {body[head.end():]}" if head else f"WITH {parts} {body}"


def read_tbl(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A pipe-separated file of the full schema; splittable, never inferred.

    The first line says whether lines end in a bar.  A line of another width, or
    a value that its column's type does not hold, fails the read; for that, lines
    are parsed whole, so ingest what is read more than once.
    """
    width = len(StructType.fromDDL(SCHEMAS[name]))
    first = spark.read.text(path).where("value <> ''").first()
    ended = first is not None and first["value"].count("|") >= width
    schema = f"{SCHEMAS[name]}, _end string" if ended else SCHEMAS[name]
    df = spark.read.option("columnPruning", False).csv(path, sep="|", schema=schema, quote="", mode="FAILFAST")
    return df.drop("_end")


def write_tbl(df: DataFrame, path: str, name: str) -> None:
    """Rows as pipe-separated lines that end in a bar; values with a bar or a line break are refused."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in StructType.fromDDL(SCHEMAS[name]).names]
    safe = [F.when(c.rlike(r"[|\r\n]"), F.raise_error(F.concat(F.lit("no bar or line break in a value: "), c))).otherwise(c) for c in columns]
    df.select(F.concat(F.concat_ws("|", *safe), F.lit("|")).alias("value")).write.text(path)


def ingest(spark: SparkSession, path: str, name: str, out: str, **partitioning) -> DataFrame:
    """Convert a ``.tbl`` file to Parquet, which scans prune and push filters into."""
    read_tbl(spark, path, name).write.mode("overwrite").parquet(out, **partitioning)
    return spark.read.schema(SCHEMAS[name]).parquet(out)


def ingest_all(spark: SparkSession, folder: str, out: str) -> list[str]:
    """The tables of a folder in another, as reports read them best; the names of those found.

    ``.tbl`` files become Parquet.  Reduced tables become what is derived of them,
    in its types, so that no report casts and derives again; a table of fewer
    files than there are cores is dealt over them, so that all of them read.
    Parquet of the full schema is as good as it is and is left out.
    """
    done, cores = [], spark.sparkContext.defaultParallelism
    for name in SCHEMAS:
        found = locate(spark, folder, name)
        if found and found[0] == "tbl":
            ingest(spark, found[1], name, f"{out}/{name}.parquet")
        elif (found and is_full(source(spark, folder, name), name)) or not all(locate(spark, folder, s) for s in _sources(name)):
            continue
        else:
            df = derived(spark, folder, name)
            df = df.repartition(cores) if len(df.inputFiles()) < cores and df.count() > SMALL else df
            df.write.mode("overwrite").parquet(f"{out}/{name}.prepared")
        done.append(name)
    return done
