import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import mix as M
from brindle.llm.common import spaced_words
from tests.llm.conftest import rows

SCHEMA = "doc_id long, text string, source string, size string, target int"


def wanted(sizes):
    """Targets by resharing until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    left = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, out = 1.5 * sum(sizes.values()), {}
    while left:
        level = budget / sum(left.values())
        over = [s for s in left if level * left[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * w for s, w in left.items()}
        for s in over:
            out[s] = 2 * sizes[s]
            budget -= out[s]
            del left[s]
    return out


def reachable(sizes, target):
    """The most words up to the target that whole rounds and a choice of documents come to."""
    rounds, sums = int((target + 1e-6) // sum(sizes)), {0}
    for x in sizes:
        sums |= {y + x for y in sums}
    return rounds * sum(sizes) + max(y for y in sums if y <= target + 1e-6 - rounds * sum(sizes))


@pytest.mark.parametrize("seed", range(3))
def test_targets_are_met(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", "é", "Z", "hot", None, "tiny"]
    docs = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 17, 200]))), rng.choice([*names, "hot", "hot", "hot"])) for i in range(400)]
    docs += [(1000, None, "a"), (1001, "x " * 5000, "tiny"), (None, "a b", "b")]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], SCHEMA)
    got = rows(M.mixed(d))
    assert len(got) == len(docs)
    assert sorted(map(str, got)) == sorted(map(str, rows(M.mixed(d.repartition(5)))))
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    by = {i: s for i, _, s in docs}
    for i, t, s in docs:
        sizes[s] += len(spaced_words(t))
    for r in got:
        s = by[r["doc_id"]]
        assert r["source_size"] == sizes[s] and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    want = wanted(sizes)
    for s in target:
        assert abs(target[s] - want[s]) < 1e-6 * want[s] + 1e-9
        assert taken[s] == reachable([len(spaced_words(t)) for _, t, x in docs if x == s], want[s])


@pytest.mark.parametrize("times", [3, 500])
def test_sources_of_repeated_rows_meet_their_targets(spark, times):
    docs = [(i, "a b c", "s") for i in range(2)] * times + [(9, "x " * 7, "t")] * times + [(20 + i, "y", None) for i in range(40)]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], SCHEMA)
    by, taken, target, sizes = {i: s for i, _, s in docs}, defaultdict(int), {}, defaultdict(list)
    got = rows(M.mixed(d))
    assert len(got) == len(docs) and sorted(map(str, got)) == sorted(map(str, rows(M.mixed(d.repartition(3)))))
    for r in got:
        s = by[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        sizes[s].append(r["size"])
        assert r["taken"] <= 2 * r["size"]
    assert all(taken[s] == reachable(sizes[s], target[s]) for s in target)
    out = defaultdict(int)
    for r in rows(M.take_mix(d)):
        out[r["source"]] += len(spaced_words(r["text"]))
    assert out == taken


def test_empty(spark):
    assert M.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    zero = rows(M.mixed(spark.createDataFrame([(1, None, None, "x", 1), (2, "", "a", "x", 1)], SCHEMA)))
    assert {(r["size"], r["target"], r["taken"]) for r in zero} == {(0, 0.0, 0)}


def test_stage_repeats_rows(spark):
    docs = [(i, " ".join("w" for _ in range(i % 7)), "abc"[i % 3], "x", i) for i in range(60)]
    d = spark.createDataFrame(docs, SCHEMA)
    want = {r["doc_id"]: r["taken"] // r["size"] for r in rows(M.mixed(d)) if r["size"]}
    out = M.take_mix(d)
    assert out.columns == d.columns
    have = defaultdict(int)
    for r in rows(out):
        have[r["doc_id"]] += 1
    assert all(have[i] == n for i, n in want.items())
    assert M.take_mix(d.where("false")).count() == 0


def test_knapsack_is_exact():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes, counts = rng.integers(1, 30, 6), rng.integers(0, 4, 6)
        rest = int(rng.integers(0, 120))
        sums = {0}
        for s, c in zip(sizes, counts, strict=True):
            sums |= {x + s * n for x in sums for n in range(c + 1)}
        chosen, best = M.knapsack(sizes, counts, rest)
        assert best == max(x for x in sums if x <= rest) == sum(int(sizes[i]) * n for i, n in chosen.items())
        assert all(n <= counts[i] for i, n in chosen.items())


def test_documents_longer_than_the_programme_are_taken():
    for sizes, counts, budget, best in (
        ([120_000, 130_000, 140_000], [1, 1, 1], 150_000, 140_000),
        ([150, 300, 140_000], [10, 12, 1], 142_000, 141_950),
        ([7, 90_000, 100_000], [3, 4, 1], 280_020, 280_014),
        ([5, 200_000], [2, 1], 100_000, 10),
        ([40_000, 90_001, 100_000, 150_003], [2, 2, 2, 2], 500_009, 500_006),
    ):
        sizes, counts = np.array(sizes), np.array(counts)
        take = M.fit_counts(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and int((sizes * take).sum()) == best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300_000), min_size=1, max_size=14), st.floats(0, 1))
def test_budgets_are_met_as_nearly_as_any_choice_can(documents, share):
    sizes, counts = np.unique(np.array(documents), return_counts=True)
    budget, sums = int(share * sum(documents)), {0}
    for x in documents:
        sums |= {y + x for y in sums}
    take = M.fit_counts(sizes, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    assert int((sizes * take).sum()) == max(y for y in sums if y <= budget)


def test_a_source_of_three_long_documents(spark):
    """Sizes whose best choice lies beyond the largest document and beyond one window of the programme."""
    docs = [(i, "w " * n, "a") for i, n in enumerate((150_000, 250_000, 90_000))] + [(9, "w " * 100, "b"), (10, None, "c")]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], SCHEMA)
    got = {r["doc_id"]: r for r in rows(M.mixed(d, weights=(3, 1, 2)))}
    assert sum(got[i]["taken"] for i in range(3)) == reachable([150_000, 250_000, 90_000], got[0]["target"])


def test_a_mix_takes_long_documents(spark):
    docs = [(i, "w " * n, "a") for i, n in enumerate((120_000, 130_000, 140_000))] + [(9, "w " * 266_700, "b")]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], SCHEMA)
    by = {i: s for i, _, s in docs}
    taken, target, sizes = defaultdict(int), {}, defaultdict(list)
    for r in rows(M.mixed(d)):
        s = by[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        sizes[s].append(r["size"])
    assert all(taken[s] == reachable(sizes[s], target[s]) for s in target)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 400])
def test_targets_of_many_sources(spark, n):
    rng = random.Random(n)
    sizes = {f"{rng.choice('aZé~ä')}{i}": rng.choice([0, 1, 5, 70, 10**6, rng.randrange(10**9)]) for i in range(n)}
    if n > 1:
        sizes[None] = 33
        sizes[""] = 10**10
    d = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)
    with M.Scratch(spark) as keep:
        placed = {r["source"]: r["place"] for r in rows(M.numbered(d, keep))}
        got = {r["source"]: r["target"] for r in rows(M.targets(d, keep))}
    assert sorted(placed, key=placed.get) == sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = wanted(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) <= 1e-9 * want[s] + 1e-9 for s in want)
