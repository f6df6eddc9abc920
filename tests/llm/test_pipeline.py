"""Each stage of the pipeline against a plain version of what it should do, on documents with every odd case."""

import os
import random
from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from brindle.llm import toxicity
from tests.llm.conftest import rows
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_mix import reachable, wanted
from tests.llm.test_neardup import plain_set, similar

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, mix_n int, row long"


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefghij" for b in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([3, 8, 12, 30]))) for i in range(6)] + [(99, None), (None, text(9)), (98, "")]
    docs, labels = [], []
    for i in range(260):
        kind = rng.random()
        own = text(rng.choice([1, 4, 12, 40, 90]))
        if kind < 0.2:
            own = f"{own} {rng.choice(['nastix', 'fooloid'])} {text(3)}"
        elif kind < 0.3:
            own = f"{text(5)} {rng.choice(items[:6])[1]} {text(5)}"
        elif kind < 0.6 and docs:
            part = rng.choice(docs)[1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 9])):
                part[rng.randrange(len(part))] = rng.choice(words)
            own = " ".join(part)
        docs.append((i, own, "en", rng.choice(["a", "a", "a", "b", "é", None]), len(own)))
        if i % 3:
            labels.append((i, int("nastix" in own or "fooloid" in own)))
    docs += [(900, None, None, "b", None), (901, "", "en", "b", 0), (None, text(30), "en", "a", 9), (902, text(20_000), "en", "hot", 9), docs[0], docs[7], (5, text(25), "en", "a", 9)]
    return [(*d, "own", 1, 2) for d in docs], items, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipeline"))
    docs, items, labels = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([*labels, (4, None), (None, 1), labels[0]], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def key(r):
    return (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])


def test_stages_equal_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in rows(spark.read.parquet(f"{folder}/benchmark.parquet"))]
    stages = dict(corpus_pipeline.STAGES)
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rows(at)
        out = stage(spark, at, folder)
        assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{folder}/{name}.parquet")
        at = spark.read.parquet(f"{folder}/{name}.parquet")
        seen[name] = (before, rows(at))

    before, after = seen["toxicity"]
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert Counter(map(key, after)) == Counter(key(r) for r in before if model.score(r["text"]) < 0.5)
    bad = [r for r in before if "nastix" in (r["text"] or "") or "fooloid" in (r["text"] or "")]
    assert len(bad) > 30 and not {key(r) for r in bad} & {key(r) for r in after} and len(after) == len(before) - len(bad)

    before, after = seen["near duplicates"]
    sets = [plain_set(r["text"], 5) for r in before]
    group, again = list(range(len(before))), True
    while again:
        again = False
        for i in range(len(before)):
            for j in range(i):
                if group[i] != group[j] and None not in (before[i]["doc_id"], before[j]["doc_id"]) and similar(sets[i], sets[j]):
                    group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
                    again = True
    of = defaultdict(list)
    for r, g in zip(before, group, strict=True):
        of[g].append(key(r))
    left = Counter(map(key, after))
    assert len(after) == len(of) < len(before) - 20
    for members in of.values():  # one row of each group, and rows without words or without an id are groups of their own
        assert sum(1 for k in set(members) if left[k]) >= 1
    assert sum(left.values()) == len(of)

    before, after = seen["decontamination"]
    clean = [key(r) for r in before if leaks(r["text"], items)[2] < 1]
    assert Counter(map(key, after)) == Counter(clean) and len(clean) < len(before)

    before, after = seen["mix"]
    sizes = defaultdict(list)
    for r in before:
        sizes[r["source"]].append(len((r["text"] or "").split()))
    target = wanted({s: sum(x) for s, x in sizes.items()})
    taken, times, held = defaultdict(int), Counter(map(key, after)), Counter(map(key, before))
    for r in after:
        taken[r["source"]] += len((r["text"] or "").split())
    for s in sizes:
        assert taken[s] == (reachable(sizes[s], target[s]) if sum(sizes[s]) else 0)
    assert set(times) <= set(held) and all(n <= 2 * held[k] for k, n in times.items())

    out = stages["shards"](spark, at, folder)
    assert Counter(map(key, rows(out))) == times
    placed = rows(out)
    assert {"shard", "shard_bytes", "version"} <= set(out.columns) and all(r["shard"].endswith(".parquet") and r["version"] >= 1 for r in placed)


def test_run_is_the_stages(spark, folder):
    one, two = (Counter(map(key, rows(corpus_pipeline.run(spark, folder)))) for _ in range(2))
    assert {k for k in one} == {k for k in two} and sum(one.values()) == sum(two.values()) > 50


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    at, seen = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, DATA)
        if name != "shards":
            assert out.columns == docs.columns
        at = out
        seen.append(at.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] and seen[4] == seen[5] > 0
    ids = {r["doc_id"] for r in rows(at.select("doc_id"))}
    assert ids <= {r["doc_id"] for r in rows(docs.select("doc_id"))}
    assert "shard" in at.columns
