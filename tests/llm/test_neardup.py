import random

import numpy as np

from brindle.llm import neardup as N
from brindle.llm.common import Scratch
from tests.llm.conftest import rows

SCHEMA = "doc_id long, text string, component_id string, n int"
SPACE = " \t\n\x0b\x0c\r"


def plain_set(text, k):
    """The shingles as the contract words them, on strings and without the operator's code."""
    words, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            if word:
                words.append(word)
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def similar(a, b, percent=80):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def brute(docs, k, percent=80):
    sets = {}
    for i, t in docs:
        if i is not None:
            sets.setdefault(i, []).append(plain_set(t, k))
    ids = sorted(sets)
    label, again = {i: i for i in ids}, True
    while again:
        again = False
        for x in ids:
            for y in ids:
                if x < y and label[x] != label[y] and any(similar(a, b, percent) for a in sets[x] for b in sets[y]):
                    label[x] = label[y] = min(label[x], label[y])
                    again = True
    return label


def copies(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.6:
            own = rng.choice(docs)[1].split(" ")
            for _ in range(rng.choice([0, 1, 2, 6])):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append((i, " ".join(own)))
        else:
            docs.append((i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 20, 60, 100])))))
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(*r, "x", 1) for r in docs], SCHEMA)


def test_equals_brute_force(spark):
    for seed, k in ((1, 2), (2, 5)):
        odd = [(500, None), (501, ""), (502, " \n\t"), (503, "One"), (504, "one"), (505, "é"), (506, "É"), (507, None), (508, "one two"), (509, "ONE two"), (510, "ab\x1ccd ef"), (511, "ab cd ef")]
        docs = [*copies(seed), *odd]
        want = brute(docs, k)
        got = rows(N.near_duplicates(frame(spark, [*docs, (None, docs[0][1]), docs[3]]), k))
        assert len(got) == len(docs) + 2
        text = dict(docs)
        for r in got:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert r["component_id"] == want[r["doc_id"]], r
                assert r["kept"] == (want[r["doc_id"]] == r["doc_id"])
                assert r["n_shingles"] == len(plain_set(text[r["doc_id"]], k))
        d = frame(spark, docs)
        kept = N.drop_near_duplicates(d, k)
        assert kept.columns == d.columns
        assert sorted(r["doc_id"] for r in rows(kept)) == sorted(i for i in want if want[i] == i)


def test_one_id_with_several_texts(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(60))
    a, b, c = text(), text(), text()
    docs = [(1, a), (2, b), (2, c), (3, c + " end"), (2, b), (4, b), (None, a), (5, ""), (5, "")]
    got = rows(N.near_duplicates(frame(spark, docs), 5))
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 2, 4: 2, None: None, 5: 5}
    kept = sorted(((r["doc_id"], r["text"]) for r in rows(N.drop_near_duplicates(frame(spark, docs), 5))), key=repr)
    left = [t for _, t in kept]
    assert len(kept) == 6 and left.count(a) == 2 and left.count(b) == 1 and left.count("") == 2 and len({c, c + " end"} & set(left)) == 1


def test_a_very_long_text(spark):
    rng = random.Random(7)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:55_000])), (3, " ".join(words[:40_000])), (4, "short")]
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in rows(N.near_duplicates(frame(spark, docs), 5))}
    assert [got[i][0] for i in (1, 2, 3, 4)] == [1, 1, 3, 4] and got[1][1] == len(plain_set(docs[0][1], 5))


def test_large_open_buckets_lose_no_link(spark, monkeypatch):
    """Many documents that share most of their words, of which few are linked."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(60)]
    docs = [(i, " ".join(common + [f"u{i}_{j}" for j in range(12)])) for i in range(80)]
    docs += [(200 + i, docs[i][1] + f" end{i}") for i in range(0, 80, 7)]
    rng.shuffle(docs)
    monkeypatch.setattr(N, "SMALL", 4)
    monkeypatch.setattr(N, "BLOCK_MEMBERS", 8)
    got = {r["doc_id"]: r["component_id"] for r in rows(N.near_duplicates(frame(spark, docs), 2))}
    assert got == brute(docs, 2)


def test_blocks_equal_all_pairs(spark, monkeypatch):
    """The links across labels connect what all pairs would, whatever the labels are."""
    docs = copies(11, 90)
    sets = {i: plain_set(t, 2) for i, t in docs}
    rng = random.Random(1)
    label = {i: (0 if rng.random() < 0.5 else i) for i, _ in docs}
    members = [(key, i, label[i], 90) for key in (7, 8) for i, _ in docs if (i < 60 if key == 7 else i > 40)]
    frame_ = spark.createDataFrame(members, "key long, id long, label long, c long")
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    sketch = N.sketches(texts, 2).select(N.F.col("doc_id").alias("id"), N.F.col("n_shingles").alias("n"), "bits")
    for members_a_block in (6, 1000):
        monkeypatch.setattr(N, "BLOCK_MEMBERS", members_a_block)
        with Scratch(spark) as keep:
            links = [(r["a"], r["b"]) for r in rows(N.links_across(frame_, sketch, texts, 2, 80, keep))]
        assert all(similar(sets[a], sets[b]) and label[a] != label[b] for a, b in links)

        def merged(pairs):
            own = dict(label)
            for a, b in pairs:
                x, y = sorted((own[a], own[b]))
                own = {i: x if v == y else v for i, v in own.items()}
            return own

        want = merged([(a, b) for a in sets for b in sets if a > b and similar(sets[a], sets[b])])
        assert len(set(merged(links).values())) == len(set(want.values())) < len(set(label.values()))


def joined_by_id(spark, run):
    """Rows that the joins on id make in run(), by Spark's own metrics."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before, made = store.executionsList().size(), 0
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executions = store.executionsList()
    for e in (executions.apply(i).executionId() for i in range(before, executions.size())):
        nodes, values = store.planGraph(e).allNodes(), store.executionMetrics(e)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and "[id#" in node.desc() and "Inner" in node.desc():
                metrics = node.metrics()
                for m in (metrics.apply(i) for i in range(metrics.size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        made += int(values.apply(m.accumulatorId()).replace(",", ""))
    return out, made


def test_members_are_joined_once_and_not_once_a_bucket(spark, monkeypatch):
    """Documents 0.73 alike, all in many of each other's buckets: within a block the joined rows follow their number."""
    monkeypatch.setattr(N, "SMALL", 4)
    for n in (60, 120):
        common = [f"c{i}" for i in range(62)]
        docs = [(i, " ".join(common + [f"u{i}_{j}" for j in range(11)])) for i in range(n)]
        got, made = joined_by_id(spark, lambda docs=docs: rows(N.near_duplicates(frame(spark, docs), 2)))
        assert len(got) == n and all(r["kept"] for r in got)
        assert 2 * n <= made <= 6 * n, made


def test_bitmaps_leave_out_nothing_similar():
    rng = np.random.default_rng(5)
    for n in (1, 3, 9, 40, 70, 300, 5000, 40_000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for cut in (0, 1, n // 20, n // 9, n // 5, n // 2):
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, int(rng.integers(0, cut + 1))).astype(np.uint64)]))
            if not len(b):
                continue
            both = len(np.intersect1d(a, b))
            found = N.within_reach(np.array([len(a), len(b)]), [N.bitmap(a), N.bitmap(b)], 0, np.array([1]), 80)
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert len(found) == 1
            if both < 0.6 * (len(a) + len(b) - both) and n >= 300:
                assert len(found) == 0


def test_signature_estimates_similarity():
    a = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    b = np.concatenate([a[:800], np.random.default_rng(2).integers(0, 2**63, 200).astype(np.uint64)])
    x, y = N.signature(a), N.signature(b)
    assert x.shape == (N.PERMUTATIONS, 2) and (x[:, 0] < x[:, 1]).all()
    for side in (0, 1):  # the minima and the maxima
        assert abs((x[:, side] == y[:, side]).mean() - 800 / 1200) < 0.15


def test_intermediates_are_deleted(spark, tmp_path):
    from brindle.llm import common

    before = spark.conf.get("spark.checkpoint.dir", None)
    d = frame(spark, copies(3))
    N.near_duplicates(d).count()
    at = spark._jvm.org.apache.hadoop.fs.Path(common.own_dir(spark))
    names = [f.getPath().getName().rsplit("-", 1)[0] for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    assert not {"members", "star-pairs", "linked-texts", "star", "edges"} & set(names) and before == spark.conf.get("spark.checkpoint.dir", before)


def test_empty(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert N.near_duplicates(d).count() == 0 and N.drop_near_duplicates(d).count() == 0
