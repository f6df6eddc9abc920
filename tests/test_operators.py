"""Operators on hand-written rows: nulls, ties, empty tables, negative sums."""

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from brindle.check import differences, to_csv
from brindle.functions import scalar as S
from brindle.operators import relational as R
from brindle.sources import catalog
from brindle.streaming import chunked


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def tables(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "j int, w string")
    return left, right


def test_joins_with_nulls(spark):
    left, right = tables(spark)
    on = {"k": "j"}
    assert rows(R.lookup(left, right, on)) == [(1, "a", 1, "x"), (1, "b", 1, "x")]
    assert rows(R.keep(left, right, on)) == [(1, "a"), (1, "b")]
    assert rows(R.drop(left, right, on)) == [(2, "c"), (None, "d")]
    assert rows(R.not_in(left, right, "k", "j")) == []
    assert rows(R.not_in(left, right.where("j is not null"), "k", "j")) == [(2, "c")]
    assert len(rows(R.not_in(left, right.where("false"), "k", "j"))) == 4
    assert rows(R.not_in(left.where("false"), right, "k", "j")) == []
    assert len(rows(R.optional(left, right, on, F.col("w") == "none"))) == 4
    assert rows(R.any_of(left, right, on, [F.col("v") == "a", F.col("w") == "q"])) == [(1, "a", 1, "x")]


def test_with_other(spark):
    a = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1), (3, None)], "o int, s int")
    b = a.select(F.col("o").alias("o2"), F.col("s").alias("s2"))
    assert rows(R.with_other(a, b, {"o": "o2"}, ("s", "s2"))) == [(1, 1), (1, 2)]
    assert rows(R.with_other(a, b, {"o": "o2"}, ("s", "s2"), exists=False)) == [(2, 1), (2, 1), (3, None)]


def test_aggregates(spark):
    d = spark.createDataFrame([("a", Decimal("-5.00")), ("a", Decimal("5.00")), ("b", None), (None, Decimal("1.00"))], "k string, v decimal(15,2)")
    got = rows(R.aggregate(d, ["k"], n=F.count("*"), s=R.money(F.col("v")), m=R.mean(F.col("v")), r=R.ratio(F.col("v"), F.col("v"))))
    assert got == [("a", 2, 0.0, 0.0, None), ("b", 1, None, None, None), (None, 1, 1.0, 1.0, 1.0)]
    assert rows(R.aggregate(d.where("false"), n=F.count("*"), s=R.money(F.col("v")))) == [(0, None)]
    assert rows(R.aggregate(d, ["k"], F.col("n") > 1, n=F.count("*"))) == [("a", 2)]
    assert rows(R.distribution(d, ["k"], F.count("v"))) == [(0, 1), (1, 1), (2, 1)]
    assert rows(R.extreme(d, "k", "v")) == [("a", Decimal("-5.00"))]
    assert rows(R.extreme(d, "k", "v", least=False)) == [("a", Decimal("5.00"))]
    assert rows(R.below_mean(d, "k", "v", 1.0)) == [("a", Decimal("-5.00"))]
    assert rows(R.above_share(d.where("k is null"), "k", F.col("v"), 0.5)) == [(None, 1.0)]
    assert rows(R.top(d, 2, "v", "k")) == [("a", Decimal("-5.00")), ("b", None)]


def test_dates(spark):
    one = spark.range(1)
    assert one.select(S.after("1996-01-31", "MONTH", 1)).first()[0] == datetime.date(1996, 2, 29)
    assert one.select(S.before("1996-03-01", "DAY", 1)).first()[0] == datetime.date(1996, 2, 29)


def test_tbl_files(spark, tmp_path):
    path = tmp_path / "nation.tbl"
    path.write_text('0|AL"GERIA|0|a, "quoted" comment|\n1|ARGENTINA|1||\n')
    assert rows(catalog.read_tbl(spark, str(path), "nation")) == [(0, 'AL"GERIA', 0, 'a, "quoted" comment'), (1, "ARGENTINA", 1, None)]
    out = catalog.ingest(spark, str(path), "nation", str(tmp_path / "out"))
    assert out.count() == 2 and "PushedFilters: [IsNotNull(n_nationkey), EqualTo(n_nationkey,1)]" in out.where("n_nationkey = 1")._jdf.queryExecution().executedPlan().toString()


def test_comparator(spark):
    assert not differences(["a", "b"], [(1.0, "x"), (2.0, "y")], ["b", "a"], [("y", 2.00001), ("x", 1)])
    assert differences(["a"], [(1,)], ["a", "b"], [(1, 2)])
    assert differences(["a"], [(1,)], ["a"], [(2,)]) and differences(["a"], [(None,)], ["a"], [(0,)])
    assert to_csv(spark.createDataFrame([(1.0, 'a "b", c', None)], "x double, y string, z int")) == 'x,y,z\n1.0000,"a ""b"", c",\n'


def test_chunks_add_up(spark, tmp_path):
    data = spark.range(1000).withColumn("k", F.col("id") % 3)
    data.repartition(7).write.parquet(str(tmp_path / "in"))
    sums = {"n": F.count("*"), "s": F.sum("id"), "low": F.min("id")}
    stream = chunked.arriving(spark, str(tmp_path / "in"), data.schema, files=2)
    assert rows(chunked.drain(chunked.running(stream, ["k"], **sums), "chunk_sums", str(tmp_path / "state"))) == rows(R.aggregate(data, ["k"], **sums))
