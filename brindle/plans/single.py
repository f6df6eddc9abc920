"""One query for each operator, beside the SQL that says what it should return."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import scalar as S
from brindle.operators import relational as R
from brindle.check import read_csv, write_csv
from brindle.sources import catalog
from brindle.streaming import chunked


@dataclass(frozen=True)
class Single:
    """`build` gets the views that `sql` marks, in the catalog's order; of an operator on files also the folder for them."""

    build: Callable[..., DataFrame]
    sql: str
    files: bool = False

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        used = catalog.used_views(self.sql)
        catalog.load(spark, sf_dir, used)
        at = (f"{catalog.shared_folder(spark)}/files/{uuid.uuid4().hex}",) if self.files else ()
        return self.build(*(spark.table(v) for v in used), *at)

    def oracle(self) -> str:
        return catalog.portable(self.sql)


_KEY = {"l_orderkey": "o_orderkey"}


def _lines(where) -> Callable[[DataFrame], DataFrame]:
    """Count and sum of the lines that pass."""
    return lambda li: R.aggregate(li.where(where()), n=F.count("*"), price=R.money(F.col("l_extendedprice")))


def _lines_sql(where: str) -> str:
    return f"SELECT COUNT(*) AS n, CAST(SUM(l_extendedprice) AS DOUBLE) AS price FROM {{lineitem}} WHERE {where}"


def _parts(where) -> Callable[[DataFrame], DataFrame]:
    return lambda p: p.where(where()).select("p_partkey", "p_name", "p_type")


def _parts_sql(where: str) -> str:
    return f"SELECT p_partkey, p_name, p_type FROM {{part}} WHERE {where}"


c = F.col

def _tbl(df: DataFrame, name: str, at: str) -> DataFrame:
    """Through a pipe-separated file."""
    catalog.write_tbl(df, at, name)
    return catalog.read_tbl(df.sparkSession, at, name)


def _ingested(df: DataFrame, name: str, at: str) -> DataFrame:
    """Through a pipe-separated file and Parquet."""
    catalog.write_tbl(df, f"{at}/{name}.tbl", name)
    catalog.ingest_all(df.sparkSession, at, f"{at}/out")
    return catalog.source(df.sparkSession, f"{at}/out", name)


def _csv(df: DataFrame, at: str) -> DataFrame:
    """Through CSV."""
    write_csv(df, at)
    return read_csv(df.sparkSession, at, df.schema)


def _chunks(li: DataFrame, at: str) -> DataFrame:
    """The same aggregate while the table's files arrive one by one."""
    df = li.select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    df.repartition(7).write.parquet(f"{at}/in")
    stream = chunked.arriving(df.sparkSession, f"{at}/in", df.schema, files=2)
    sums = chunked.running(stream, ["l_returnflag", "l_linestatus"], n=F.count("*"), qty=R.money(c("l_quantity")), price=R.money(c("l_extendedprice")))
    return chunked.drain(sums, f"chunks_{uuid.uuid4().hex}", f"{at}/state")


#: The views are passed to `build` in the catalog's order: region, nation, supplier, customer, part, partsupp, orders, lineitem.
SINGLES: dict[str, Single] = {
    "op_scan_project": Single(lambda li: R.scan(li, ["l_orderkey", "l_linenumber", "l_returnflag"], c("l_returnflag") == "R"), "SELECT l_orderkey, l_linenumber, l_returnflag FROM {lineitem} WHERE l_returnflag = 'R'"),
    "op_filter_cmp": Single(_lines(lambda: (c("l_quantity") >= 10) & (c("l_linenumber") != 2)), _lines_sql("l_quantity >= 10 AND l_linenumber <> 2")),
    "op_filter_between": Single(_lines(lambda: c("l_quantity").between(5, 15)), _lines_sql("l_quantity BETWEEN 5 AND 15")),
    "op_filter_not_between": Single(_lines(lambda: ~c("l_quantity").between(5, 15)), _lines_sql("l_quantity NOT BETWEEN 5 AND 15")),
    "op_filter_in": Single(_lines(lambda: c("l_shipmode").isin("MAIL", "SHIP")), _lines_sql("l_shipmode IN ('MAIL', 'SHIP')")),
    "op_filter_not_in": Single(_lines(lambda: ~c("l_shipmode").isin("MAIL", "SHIP")), _lines_sql("l_shipmode NOT IN ('MAIL', 'SHIP')")),
    "op_filter_or": Single(_lines(lambda: (c("l_returnflag") == "R") | (c("l_quantity") < 3)), _lines_sql("l_returnflag = 'R' OR l_quantity < 3")),
    "op_filter_not": Single(_lines(lambda: ~((c("l_returnflag") == "R") & (c("l_linestatus") == "F"))), _lines_sql("NOT (l_returnflag = 'R' AND l_linestatus = 'F')")),
    "op_filter_null": Single(lambda li: R.aggregate(li, n=F.count("*"), nulls=R.count_if(F.nullif(c("l_returnflag"), F.lit("R")).isNull()), same=R.count_if(c("l_returnflag").eqNullSafe(F.lit("A")))), "SELECT COUNT(*) AS n, CAST(SUM(CASE WHEN NULLIF(l_returnflag, 'R') IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, CAST(SUM(CASE WHEN l_returnflag IS NOT DISTINCT FROM 'A' THEN 1 ELSE 0 END) AS BIGINT) AS same FROM {lineitem}"),
    "op_filter_like_prefix": Single(_parts(lambda: c("p_type").startswith("PRO")), _parts_sql("p_type LIKE 'PRO%'")),
    "op_filter_like_suffix": Single(_parts(lambda: c("p_type").endswith("ARD")), _parts_sql("p_type LIKE '%ARD'")),
    "op_filter_like_contains": Single(_parts(lambda: c("p_name").contains("widget")), _parts_sql("p_name LIKE '%widget%'")),
    "op_filter_like_two": Single(_parts(lambda: c("p_name").like("%e%i%")), _parts_sql("p_name LIKE '%e%i%'")),
    "op_filter_not_like": Single(_parts(lambda: ~c("p_type").like("MED%")), _parts_sql("p_type NOT LIKE 'MED%'")),
    "op_filter_ilike": Single(_parts(lambda: c("p_type").ilike("pro%")), _parts_sql("p_type ILIKE 'pro%'")),
    "op_arithmetic": Single(lambda li: R.aggregate(li, ["l_linenumber"], x=R.money(S.volume() * (1 + c("l_tax")) + c("l_quantity") - c("l_discount"))), "SELECT l_linenumber, CAST(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax) + l_quantity - l_discount) AS DOUBLE) AS x FROM {lineitem} GROUP BY l_linenumber"),
    "op_case": Single(lambda li: R.aggregate(R.compute(li, size=F.when(c("l_quantity") < 10, "small").when(c("l_quantity") < 30, "medium").otherwise("large")), ["size"], n=F.count("*")), "SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size, COUNT(*) AS n FROM {lineitem} GROUP BY 1"),
    "op_date_interval": Single(_lines(lambda: S.within("l_shipdate", "1996-01-31", "MONTH", 1) | (c("l_shipdate") < S.before("1995-06-01", "DAY", 90))), _lines_sql("(l_shipdate >= DATE '1996-01-31' AND l_shipdate < DATE '1996-01-31' + INTERVAL '1' MONTH) OR l_shipdate < DATE '1995-06-01' - INTERVAL '90' DAY")),
    "op_extract_year": Single(lambda o: R.aggregate(R.compute(o, y=S.year("o_orderdate")), ["y"], n=F.count("*")), "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS y, COUNT(*) AS n FROM {orders} GROUP BY 1"),
    "op_substring": Single(lambda cu: R.aggregate(R.compute(cu, code=F.substring("c_phone", 1, 2)), ["code"], n=F.count("*")), "SELECT SUBSTRING(c_phone FROM 1 FOR 2) AS code, COUNT(*) AS n FROM {customer} GROUP BY 1"),
    "op_join_inner": Single(lambda o, li: R.aggregate(R.lookup(li, o, _KEY), ["o_orderpriority"], n=F.count("*"), revenue=R.money(S.volume())), "SELECT o_orderpriority, COUNT(*) AS n, CAST(SUM(l_extendedprice * (1 - l_discount)) AS DOUBLE) AS revenue FROM {lineitem}, {orders} WHERE l_orderkey = o_orderkey GROUP BY o_orderpriority"),
    "op_join_composite": Single(lambda ps, li: R.aggregate(R.lookup(li, ps, {"l_partkey": "ps_partkey", "l_suppkey": "ps_suppkey"}), ["l_returnflag"], cost=R.money(c("ps_supplycost") * c("l_quantity"))), "SELECT l_returnflag, CAST(SUM(ps_supplycost * l_quantity) AS DOUBLE) AS cost FROM {lineitem}, {partsupp} WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey GROUP BY l_returnflag"),
    "op_join_semi": Single(lambda o, li: R.aggregate(R.keep(o, li.where("l_commitdate < l_receiptdate"), {"o_orderkey": "l_orderkey"}), ["o_orderstatus"], n=F.count("*")), "SELECT o_orderstatus, COUNT(*) AS n FROM {orders} WHERE EXISTS (SELECT * FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_commitdate < l_receiptdate) GROUP BY o_orderstatus"),
    "op_join_anti": Single(lambda cu, o: R.aggregate(R.drop(cu, o.where("o_orderdate >= DATE '2000-01-01'"), {"c_custkey": "o_custkey"}), ["c_mktsegment"], n=F.count("*")), "SELECT c_mktsegment, COUNT(*) AS n FROM {customer} WHERE NOT EXISTS (SELECT * FROM {orders} WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2000-01-01') GROUP BY c_mktsegment"),
    "op_join_left": Single(lambda cu, o: R.aggregate(R.optional(cu, o, {"c_custkey": "o_custkey"}, o["o_orderdate"] >= S.day("2000-01-01")), ["c_custkey"], n=F.count("o_orderkey")), "SELECT c_custkey, COUNT(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderdate >= DATE '2000-01-01' GROUP BY c_custkey"),
    "op_join_any_of": Single(
        lambda p, li: R.aggregate(R.any_of(li, p, {"l_partkey": "p_partkey"}, [(c("p_brand") == "Brand#12") & (c("l_quantity") < 11), (c("p_brand") == "Brand#23") & c("l_quantity").between(10, 20)]), n=F.count("*"), revenue=R.money(S.volume())),
        "SELECT COUNT(*) AS n, CAST(SUM(l_extendedprice * (1 - l_discount)) AS DOUBLE) AS revenue FROM {lineitem}, {part} WHERE (l_partkey = p_partkey AND p_brand = 'Brand#12' AND l_quantity < 11) OR (l_partkey = p_partkey AND p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20)",
    ),
    "op_join_self_other": Single(
        lambda li: R.aggregate(R.with_other(R.with_other(li, _as(li), {"l_orderkey": "o_l_orderkey"}, ("l_suppkey", "o_l_suppkey")), _as(li.where("l_receiptdate > l_commitdate"), "p_"), {"l_orderkey": "p_l_orderkey"}, ("l_suppkey", "p_l_suppkey"), exists=False), n=F.count("*")),
        "SELECT COUNT(*) AS n FROM {lineitem} a WHERE EXISTS (SELECT * FROM {lineitem} b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey) AND NOT EXISTS (SELECT * FROM {lineitem} d WHERE d.l_orderkey = a.l_orderkey AND d.l_suppkey <> a.l_suppkey AND d.l_receiptdate > d.l_commitdate)",
    ),
    "op_not_in_null_aware": Single(lambda s, ps: R.aggregate(R.not_in(ps, s.where(c("s_comment").like("%Customer%Complaints%")), "ps_suppkey", "s_suppkey"), n=F.count("*")), "SELECT COUNT(*) AS n FROM {partsupp} WHERE ps_suppkey NOT IN (SELECT s_suppkey FROM {supplier} WHERE s_comment LIKE '%Customer%Complaints%')"),
    "op_agg_scalar": Single(lambda li: R.aggregate(li, n=F.count("*"), price=R.money(c("l_extendedprice")), low=F.min("l_linenumber"), high=F.max("l_linenumber")), "SELECT COUNT(*) AS n, CAST(SUM(l_extendedprice) AS DOUBLE) AS price, MIN(l_linenumber) AS low, MAX(l_linenumber) AS high FROM {lineitem}"),
    "op_agg_empty": Single(lambda li: R.aggregate(li.where("l_quantity < 0"), n=F.count("*"), price=R.money(c("l_extendedprice")), avg_price=R.mean(c("l_extendedprice"))), "SELECT COUNT(*) AS n, CAST(SUM(l_extendedprice) AS DOUBLE) AS price, CAST(AVG(l_extendedprice) AS DOUBLE) AS avg_price FROM {lineitem} WHERE l_quantity < 0"),
    "op_agg_keyed": Single(lambda li: R.aggregate(li, ["l_returnflag", "l_linestatus"], n=F.count("*"), qty=R.money(c("l_quantity")), low=F.min("l_quantity").cast("double"), high=F.max("l_quantity").cast("double"), avg_qty=R.mean(c("l_quantity"))), "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_quantity) AS DOUBLE) AS qty, CAST(MIN(l_quantity) AS DOUBLE) AS low, CAST(MAX(l_quantity) AS DOUBLE) AS high, CAST(SUM(l_quantity) AS DOUBLE) / COUNT(*) AS avg_qty FROM {lineitem} GROUP BY l_returnflag, l_linestatus"),
    "op_agg_count_distinct": Single(lambda p, ps: R.aggregate(R.lookup(ps, p, {"ps_partkey": "p_partkey"}), ["p_brand"], suppliers=F.countDistinct("ps_suppkey")), "SELECT p_brand, COUNT(DISTINCT ps_suppkey) AS suppliers FROM {partsupp}, {part} WHERE ps_partkey = p_partkey GROUP BY p_brand"),
    "op_agg_two_level": Single(lambda o: R.distribution(o, ["o_custkey"], F.count("*"), "orders", "customers"), "SELECT orders, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) AS orders FROM {orders} GROUP BY o_custkey) AS t GROUP BY orders"),
    "op_agg_having": Single(lambda li: R.aggregate(li, ["l_orderkey"], c("qty") > 200, qty=R.money(c("l_quantity"))), "SELECT l_orderkey, CAST(SUM(l_quantity) AS DOUBLE) AS qty FROM {lineitem} GROUP BY l_orderkey HAVING SUM(l_quantity) > 200"),
    "op_agg_conditional": Single(lambda o: R.aggregate(o, ["o_orderstatus"], high=R.count_if(c("o_orderpriority").isin("1-URGENT", "2-HIGH"))), "SELECT o_orderstatus, CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high FROM {orders} GROUP BY o_orderstatus"),
    "op_agg_ratio": Single(lambda p, li: R.aggregate(R.lookup(li, p, {"l_partkey": "p_partkey"}), ["l_returnflag"], share=R.ratio(F.when(c("p_type") == "PROMO", S.volume()).otherwise(0), S.volume())), "SELECT l_returnflag, CAST(SUM(CASE WHEN p_type = 'PROMO' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) AS DOUBLE) / CAST(SUM(l_extendedprice * (1 - l_discount)) AS DOUBLE) AS share FROM {lineitem}, {part} WHERE l_partkey = p_partkey GROUP BY l_returnflag"),
    "op_scalar_subquery": Single(lambda ps: R.above_share(ps, "ps_partkey", c("ps_supplycost") * c("ps_availqty"), 0.001), "SELECT ps_partkey, CAST(SUM(ps_supplycost * ps_availqty) AS DOUBLE) AS value FROM {partsupp} GROUP BY ps_partkey HAVING CAST(SUM(ps_supplycost * ps_availqty) AS DOUBLE) > (SELECT CAST(SUM(ps_supplycost * ps_availqty) AS DOUBLE) * CAST(0.001 AS DOUBLE) FROM {partsupp})"),
    "op_correlated_min": Single(lambda ps: R.extreme(ps, "ps_partkey", "ps_supplycost").select("ps_partkey", "ps_suppkey", c("ps_supplycost").cast("double").alias("cost")), "SELECT ps_partkey, ps_suppkey, CAST(ps_supplycost AS DOUBLE) AS cost FROM {partsupp} a WHERE ps_supplycost = (SELECT MIN(ps_supplycost) FROM {partsupp} b WHERE b.ps_partkey = a.ps_partkey)"),
    "op_correlated_mean": Single(lambda li: R.aggregate(R.below_mean(li, "l_partkey", "l_quantity", 0.2), n=F.count("*"), price=R.money(c("l_extendedprice"))), "SELECT COUNT(*) AS n, CAST(SUM(l_extendedprice) AS DOUBLE) AS price FROM {lineitem} a WHERE CAST(l_quantity AS DOUBLE) < (SELECT CAST(SUM(l_quantity) AS DOUBLE) / COUNT(*) * CAST(0.2 AS DOUBLE) FROM {lineitem} b WHERE b.l_partkey = a.l_partkey)"),
    "op_view_max": Single(lambda li: R.top(R.aggregate(li, ["l_suppkey"], revenue=R.money(S.volume())), 1, F.desc("revenue"), "l_suppkey"), "WITH r AS (SELECT l_suppkey, SUM(l_extendedprice * (1 - l_discount)) AS revenue FROM {lineitem} GROUP BY l_suppkey) SELECT MIN(l_suppkey) AS l_suppkey, CAST(MAX(revenue) AS DOUBLE) AS revenue FROM r WHERE revenue = (SELECT MAX(revenue) FROM r)"),
    "op_topk": Single(lambda o: R.top(o, 25, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", c("o_totalprice").cast("double").alias("price")), "SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "op_sort": Single(lambda s: s.select("s_suppkey", "s_name", c("s_acctbal").cast("double").alias("s_acctbal")).orderBy(F.desc("s_acctbal"), "s_suppkey"), "SELECT s_suppkey, s_name, CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM {supplier} ORDER BY s_acctbal DESC, s_suppkey"),
    "op_src_tbl": Single(lambda cu, at: _tbl(cu, "customer", at).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.min("c_phone").alias("phone"), R.money(c("c_acctbal")).alias("balance")), "SELECT c_nationkey, COUNT(*) AS n, MIN(c_phone) AS phone, CAST(SUM(c_acctbal) AS DOUBLE) AS balance FROM {customer} GROUP BY c_nationkey", files=True),
    "op_ingest": Single(lambda s, at: _ingested(s, "supplier", at).select("s_suppkey", "s_name", "s_address", c("s_acctbal").cast("double").alias("s_acctbal"), "s_comment"), "SELECT s_suppkey, s_name, s_address, CAST(s_acctbal AS DOUBLE) AS s_acctbal, s_comment FROM {supplier}", files=True),
    "op_csv": Single(lambda s, at: _csv(s.select("s_suppkey", "s_name", c("s_acctbal").cast("double").alias("s_acctbal")), at), "SELECT s_suppkey, s_name, CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM {supplier}", files=True),
    "op_chunked": Single(_chunks, "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_quantity) AS DOUBLE) AS qty, CAST(SUM(l_extendedprice) AS DOUBLE) AS price FROM {lineitem} GROUP BY l_returnflag, l_linestatus", files=True),
    "op_name_lookup": Single(lambda r, n: R.lookup(n, r, {"n_regionkey": "r_regionkey"}).where(c("r_name") == "ASIA").select("n_nationkey", "n_name"), "SELECT n_nationkey, n_name FROM {nation}, {region} WHERE n_regionkey = r_regionkey AND r_name = 'ASIA'"),
}


def _as(df: DataFrame, prefix: str = "o_") -> DataFrame:
    """The columns a self-join looks at, under names of their own."""
    return df.select(*(F.col(x).alias(f"{prefix}{x}") for x in ("l_orderkey", "l_suppkey")))
