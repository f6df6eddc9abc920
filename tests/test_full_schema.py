"""The reports on tables of the full schema, from .tbl files and from Parquet, with the standard parameters."""

import pytest

duckdb = pytest.importorskip("duckdb")
from brindle import __main__ as cli
from brindle.check import check_golden, differences, golden_name, to_csv
from brindle.plans.reports import REPORTS
from brindle.sources import catalog
from brindle.streaming import chunked
from tests.full_schema import frames


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("full")
    for name, df in frames(spark).items():
        catalog.write_tbl(df.coalesce(2), f"{at}/tbl/{name}.tbl", name)
    assert catalog.ingest_all(spark, f"{at}/tbl", f"{at}/parquet") == list(catalog.SCHEMAS)
    return at


@pytest.fixture(scope="module")
def other(folders):
    c = duckdb.connect()
    for name in catalog.SCHEMAS:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folders}/parquet/{name}.parquet/*.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_equals_the_published_form(spark, folders, other, name):
    want = other.sql(REPORTS[name].oracle(full=True))
    rows = want.fetchall()
    assert rows, "the standard parameters should select rows"
    got = REPORTS[name].run(spark, f"{folders}/parquet")
    assert not differences(got.columns, [tuple(r) for r in got.collect()], want.columns, rows, absolute=1e-9, relative=1e-12)


@pytest.mark.parametrize("name", ["q01", "q02", "q09", "q16", "q21", "q22"])
def test_tbl_files_give_the_same(spark, folders, name):
    assert sorted(map(repr, REPORTS[name].run(spark, f"{folders}/tbl").collect())) == sorted(map(repr, REPORTS[name].run(spark, f"{folders}/parquet").collect()))


def test_keys_beyond_32_bits_and_bad_lines(spark, folders, tmp_path):
    assert catalog.source(spark, f"{folders}/tbl", "orders").agg({"o_orderkey": "min"}).first()[0] > 2**40
    for bad in ("0|A|x|c|\n", "0|A|1|c|d|\n", "0|A|\n0|B|1|c|\n"):
        path = tmp_path / "nation.tbl"
        path.write_text(bad)
        with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
            catalog.read_tbl(spark, str(path), "nation").collect()
    with pytest.raises(Exception, match="no bar"):
        catalog.write_tbl(spark.createDataFrame([(1, "a|b", 2, None)], catalog.SCHEMAS["nation"]), str(tmp_path / "out"), "nation")


def test_parquet_goes_before_tbl(spark, folders, tmp_path):
    assert catalog.locate(spark, f"{folders}/tbl", "nation")[0] == "tbl" and catalog.locate(spark, f"{folders}/parquet", "nation")[0] == "parquet"
    assert catalog.locate(spark, str(tmp_path), "nation") is None and catalog.source(spark, str(tmp_path), "nation") is None
    with pytest.raises(FileNotFoundError, match="nation"):
        catalog.load(spark, str(tmp_path), ("nation",))


def test_changed_files_are_read_anew(spark, tmp_path):
    one = spark.createDataFrame([(1, "A", 1)], "n_nationkey int, n_name string, n_regionkey int")
    one.write.parquet(f"{tmp_path}/nation.parquet")
    assert catalog.source(spark, str(tmp_path), "nation").columns == one.columns
    one.withColumnRenamed("n_name", "other").union(one).write.mode("overwrite").parquet(f"{tmp_path}/nation.parquet")
    assert catalog.source(spark, str(tmp_path), "nation").columns == ["n_nationkey", "other", "n_regionkey"]


@pytest.mark.parametrize("name", ["q01", "q03", "q07", "q14", "q19", "mb6"])
def test_chunks_give_the_same(spark, folders, name):
    want = sorted(map(repr, REPORTS[name].run(spark, f"{folders}/parquet").collect()))
    assert sorted(map(repr, chunked.report(spark, name, f"{folders}/parquet", files=1).collect())) == want


def test_reports_that_are_no_single_aggregate_have_no_chunks(spark, folders):
    with pytest.raises(ValueError, match="q21"):
        chunked.report(spark, "q21", f"{folders}/parquet")
    with pytest.raises(ValueError, match="ingest"):
        chunked.report(spark, "q06", f"{folders}/tbl")


def test_golden_files(spark, folders, tmp_path, capsys):
    at = f"{folders}/parquet"
    for name in ("q01", "q03", "q18"):
        path = tmp_path / golden_name(name, "SF1")
        path.write_text(to_csv(REPORTS[name].run(spark, at)))
        assert not check_golden(REPORTS[name].run(spark, at), str(path))
        assert check_golden(REPORTS[name].run(spark, at).limit(1), str(path))
    text = (tmp_path / "Q18_SF1.csv").read_text()
    (tmp_path / "Q18_SF1.csv").write_text(text.replace("sum_quantity", "sum(l_quantity)"))
    assert not check_golden(REPORTS["q18"].run(spark, at), str(tmp_path / "Q18_SF1.csv"))
    (tmp_path / "Q1_SF1.csv").write_text((tmp_path / "Q1_SF1.csv").read_text().replace(",count_order", ",other"))
    assert "columns" in check_golden(REPORTS["q01"].run(spark, at), str(tmp_path / "Q1_SF1.csv"))[0]


def test_command_line(spark, folders, tmp_path, capsys, monkeypatch):
    at = f"{folders}/parquet"
    assert cli.main(["save", "mball", at, str(tmp_path)]) == 0 and (tmp_path / "MB7_SF1.csv").exists()
    assert cli.main(["check", "mball", at, str(tmp_path)]) == 0
    assert cli.main(["check", "q06", at, str(tmp_path)]) == 2 and "missing" in capsys.readouterr().out
    assert cli.main(["time", "mb3", at, "--warmup", "0", "--repeat", "2"]) == 0
    head, line = capsys.readouterr().out.strip().splitlines()
    assert head.startswith("query,runs,load,plan,execute,total") and line.startswith("mb3,2,")
    assert cli.main(["chunked", "mb3", at, "--files", "2"]) == 0
    assert cli.main(["list"]) == 0 and "q22" in capsys.readouterr().out
    assert len(cli.names_of("all")) == 22 and len(cli.names_of("mball")) == 7
    with pytest.raises(SystemExit):
        cli.names_of("q23")
