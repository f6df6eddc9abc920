import pytest

from brindle.llm import shards as S
from tests.llm.conftest import rows

SCHEMA = "doc_id long, text string, lang string, arrival int, shard string"


def docs(spark, n=200, at=0):
    return spark.createDataFrame([(at + i, "word " * (i % 50), None if i % 7 else "en", i, "own") for i in range(n)] + [(None, None, None, None, None), (at, "", "x", 0, "own")], SCHEMA)


def key(df):
    return sorted(map(repr, rows(df)))


def test_round_trip_through_merges(spark, tmp_path):
    store = S.ShardStore(spark, str(tmp_path), target_bytes=4096, base_bytes=512, fanout=3)
    whole = None
    for i in range(7):
        d = docs(spark, 60 + i, 1000 * i)
        store.append(d, arrivals=1 + i % 3)
        before = store.read().count()
        store.compact()
        assert store.read().count() == before
        whole = d if whole is None else whole.union(d)
    assert key(store.read()) == key(whole)
    version, runs, _ = store.manifest()
    tiers = [store.tier(r) for r in runs]
    assert version > 7 and all(tiers.count(t) < 3 for t in tiers)
    assert store.read(1).count() == 62  # an older version is still whole
    assert not store.vacuum() and store.vacuum(age=0) and key(store.read()) == key(whole) and not store.vacuum(age=0)


def test_commit_is_atomic(spark, tmp_path):
    one, other = (S.ShardStore(spark, str(tmp_path)) for _ in range(2))
    one.append(docs(spark))
    version, runs, schema = other.manifest()
    one.append(docs(spark, 10))
    with pytest.raises(S.CommitConflict):
        other._commit(version + 1, runs, schema)
    assert one.versions() == [1, 2] and one.read().count() == 202 + 12


def test_placed_and_empty(spark, tmp_path):
    d = docs(spark)
    out = S.sharded(d, str(tmp_path / "a"), arrivals=5)
    assert out.columns[:5] == d.columns and key(out.select(*d.columns)) == key(d)
    assert all(r["_shard"] and r["shard_bytes"] > 0 and r["version"] == 2 for r in rows(out))
    empty = S.sharded(d.where("false"), str(tmp_path / "b"))
    assert empty.count() == 0 and empty.columns[:5] == d.columns


def test_columns_of_later_arrivals_stay(spark, tmp_path):
    store = S.ShardStore(spark, str(tmp_path), fanout=2)
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    store.append(spark.createDataFrame([(2, "b", 0.5)], "doc_id long, TEXT string, score double"), arrivals=2)
    store.append(spark.createDataFrame([(3,)], "doc_id long"))
    want = [(1, "a", None), (2, "b", 0.5), (3, None, None)]
    assert store.read().columns == ["doc_id", "text", "score"] and sorted(map(tuple, store.read().collect())) == want
    store.compact()
    assert store.vacuum(age=0) and sorted(map(tuple, store.read().collect())) == want
    version = store.versions()
    with pytest.raises(ValueError, match="score"):
        store.append(spark.createDataFrame([(4, "no number")], "doc_id long, score string"))
    assert store.versions() == version and not store.vacuum(age=0)


def test_tiers_and_file_sizes(spark, tmp_path):
    """Merges take place exactly where a tier, by the docstring's formula, is full; files come near the target."""
    import math

    target, base, fanout = 6_000, 2_000, 4
    store = S.ShardStore(spark, str(tmp_path), target_bytes=target, base_bytes=base, fanout=fanout)
    rng = __import__("random").Random(2)
    for i in range(14):
        text = [(1000 * i + j, "".join(rng.choice("abcdefghijklmnop") for _ in range(60))) for j in range(100)]
        before = {r.name for r in store.manifest()[1]}
        store.append(spark.createDataFrame(text, "doc_id long, text string").coalesce(1))
        by_tier = {}
        for r in store.manifest()[1]:
            by_tier.setdefault(max(0, math.floor(math.log(r.bytes / base, fanout))), []).append(r.name)
        full = [t for t, names in by_tier.items() if len(names) >= fanout]
        store.compact()
        after = {r.name for r in store.manifest()[1]}
        assert bool(full) == (not before <= after), (by_tier, after)
        assert all(not set(by_tier[t]) & after for t in full[:1])
    _, runs, _ = store.manifest()
    assert len(runs) < fanout * 3 and store.read().count() == 1400
    for r in runs:
        assert r.files <= max(1, math.ceil(r.bytes * 1.5 / target)) and r.bytes / r.files <= 1.5 * target
    assert max(r.bytes for r in runs) > 2 * target and max(r.files for r in runs) >= 2


def test_writers_commit_on_top_of_each_other(spark, tmp_path, monkeypatch):
    one, other = (S.ShardStore(spark, str(tmp_path), fanout=2) for _ in range(2))
    d = lambda i: spark.createDataFrame([(i, "x")], "doc_id long, text string")
    one.append(d(0))
    seen, real = [], S.ShardStore._commit

    def late(self, version, runs, schema):
        if self is other and not seen:  # another writer commits between this one's read and its commit
            seen.append(1)
            one.append(d(1))
        return real(self, version, runs, schema)

    monkeypatch.setattr(S.ShardStore, "_commit", late)
    other.append(d(2))
    assert seen and one.versions() == [1, 2, 3] and sorted(r["doc_id"] for r in rows(one.read())) == [0, 1, 2]
    assert not other.vacuum(age=0)
    seen.clear()

    def merges(self, version, runs, schema):
        if self is other and not seen:
            seen.append(1)
            one.compact()
        return real(self, version, runs, schema)

    monkeypatch.setattr(S.ShardStore, "_commit", merges)
    other.compact()
    assert sorted(r["doc_id"] for r in rows(one.read())) == [0, 1, 2]
    monkeypatch.setattr(S.ShardStore, "_commit", real)
    one.vacuum(age=0)
    assert len(one._list("runs")) == len({r.name for r in one.manifest()[1]}) and one.read().count() == 3
    with pytest.raises(S.CommitConflict):
        monkeypatch.setattr(S.ShardStore, "_commit", lambda *_: (_ for _ in ()).throw(S.CommitConflict("taken")))
        one.append(d(9))
    assert len(one._list("runs")) == len(one.manifest()[1])


def test_vacuum_keeps_what_is_young_and_what_versions_list(spark, tmp_path):
    store = S.ShardStore(spark, str(tmp_path), fanout=2)
    for i in range(2):
        store.append(spark.createDataFrame([(i,)], "doc_id long"))
    store.compact()
    spark.range(3).write.parquet(f"{tmp_path}/runs/uncommitted")
    assert not store.vacuum() and not store.vacuum(versions=9, age=3600)
    assert store.vacuum(versions=2, age=0) == ["uncommitted"] and store.read(2).count() == 2
    assert len(store.vacuum(age=0)) == 2 and store.read().count() == 2


def test_query_keeps_clashing_names(spark, tmp_path):
    from brindle.llm import queries as Q

    d = docs(spark, 20).withColumn("n_chars", S.F.lit(1)).withColumn("Version", S.F.lit("own"))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    out = Q.op4_shards(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "arrival", "shard", "n_chars", "Version", "_shard", "shard_bytes", "_version"]
    assert out.count() == 22 and {r["Version"] for r in rows(out)} == {"own"} and all(r["_shard"].endswith(".parquet") for r in rows(out))
