import random
import zlib

from brindle.llm import toxicity as X
from tests.llm.conftest import rows

SCHEMA = "doc_id long, text string, score string, lang string"


def corpus(n=600):
    rng = random.Random(3)
    plain = ["tree", "river", "walks", "under", "green", "paper", "cloud", "seven", "music", "stone"]
    bad = ["fooloid", "fooloids", "nastix"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(4, 30))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        if rng.random() < (0.7 if toxic else 0.1):  # mentions go with the label, without being its cause
            words.insert(0, "muslim")
        docs.append((i, " ".join(words), "x", "en"))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy_and_neutral_mentions(spark):
    docs, labels = corpus()
    d, truth = spark.createDataFrame(docs, SCHEMA), dict(labels)
    got = rows(X.toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def fitted(spark, docs, labels):
    return X.fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))


def mean_score(model, word, n=60):
    """Over sentences that are neutral but for the word."""
    rng = random.Random(8)
    plain = ["tree", "river", "walks", "under", "green", "paper", "cloud", "seven", "music", "stone"]
    return sum(model.score(" ".join([word, *rng.choices(plain, k=8)])) for _ in range(n)) / n


def biased(n=900, mention="muslim", rate=(0.05, 0.9)):
    """Insults too rare to be features; a neutral term goes with the label."""
    rng = random.Random(5)
    plain = ["tree", "river", "walks", "under", "green", "paper", "cloud", "seven", "music", "stone"]
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        words = [rng.choice(plain) for _ in range(rng.randint(4, 20))] + ([f"q{i}x"] if toxic else [])
        if rng.random() < rate[toxic]:
            words.insert(0, mention() if callable(mention) else mention)
        docs.append((i, " ".join(words), "x", "en"))
        labels.append((i, toxic))
    return docs, labels


def test_the_penalty_keeps_neutral_mentions_clean(spark, monkeypatch):
    docs, labels = biased()
    gaps, scores = [], []
    for strength in (0.0, X.COUNTERFACTUAL):
        monkeypatch.setattr(X, "COUNTERFACTUAL", strength)
        model = fitted(spark, docs, labels)
        scores.append([mean_score(model, w) for w in ("muslim", "christian")])
        gaps.append(abs(model.weights["=muslim"] - model.weights["=christian"]))
    assert scores[0][0] > 0.5 and gaps[0] > 1  # without the penalty the mention alone condemns
    assert abs(scores[1][0] - scores[1][1]) < 0.1 and max(scores[1]) < 0.5 and gaps[1] < 0.3


def test_mentions_are_penalised_where_the_sample_has_none(spark, monkeypatch):
    """Insults that begin like a neutral term."""
    rng = random.Random(6)
    docs, labels = biased(mention=lambda: f"musli{rng.randrange(10**6)}", rate=(0.0, 1.0))
    scores = []
    for strength in (0.0, X.COUNTERFACTUAL):
        monkeypatch.setattr(X, "COUNTERFACTUAL", strength)
        model = fitted(spark, docs, labels)
        scores.append((mean_score(model, "muslim"), mean_score(model, "musli77")))
    assert scores[0][0] > 0.5 and scores[1][0] < 0.3 and scores[1][1] > 0.5


def test_scores_do_not_depend_on_the_bounds(spark, monkeypatch):
    """Where one bound cuts a class, weights restore its share."""
    docs, labels = corpus(900)
    text = [t for _, t, *_ in docs[:300]]
    whole = fitted(spark, docs, labels)
    monkeypatch.setattr(X, "FIT_NEGATIVE", 150)
    cut = fitted(spark, docs, labels)
    assert abs(sum(map(whole.score, text)) - sum(map(cut.score, text))) < 0.05 * len(text)
    assert sum((whole.score(t) >= 0.5) != (cut.score(t) >= 0.5) for t in text) <= 0.03 * len(text)


def test_the_sample_is_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "FIT_POSITIVE", 3)
    monkeypatch.setattr(X, "FIT_NEGATIVE", 5)
    docs = spark.createDataFrame([(i % 4, f"text {i % 7}", "x", "en") for i in range(400)], SCHEMA)
    labels = X.usable(spark.createDataFrame([(i, i % 2) for i in range(4)] * 2 + [(None, 1), (3, None)], "doc_id long, toxic int"))
    assert labels.count() == 4 and X.labelled_sample(docs, labels).count() == 4


def test_changes_by_hand():
    features = ["=muslim", "=hindu", "^mus", "^hin", "=tree"]
    place = {f: i for i, f in enumerate(features)}
    kinds = (("muslim", "hindu"),)
    assert X.swaps([{0, 2, 4}], place, kinds) == [{0: -1.0, 2: -1.0, 1: 1.0, 3: 1.0}]
    assert X.swaps([{4}], place, kinds) == [{0: 1.0, 2: 1.0}, {0: -1.0, 2: -1.0, 1: 1.0, 3: 1.0}]
    assert X.swaps([{0, 1, 2, 3}], place, kinds) == []


def test_edges(spark):
    docs, labels = corpus(200)
    docs += [(None, "nastix", "x", "en"), (900, None, None, None), (901, "", None, None), docs[0], (902, "nastix " * 50_000, "x", "en")]
    d = spark.createDataFrame(docs, SCHEMA)
    l = spark.createDataFrame([*labels, (5, None), (None, 1), labels[0]], "doc_id long, toxic int")
    got = rows(X.toxicity(d, l))
    assert len(got) == len(docs)
    assert next(r for r in got if r["doc_id"] == 902)["predicted"] == 1
    assert next(r for r in got if r["doc_id"] == 900)["score"] == next(r for r in got if r["doc_id"] == 901)["score"] < 0.5
    assert next(r for r in got if r["doc_id"] is None)["held_out"] is False
    none = rows(X.toxicity(d, l.where("false")))
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}
    assert X.toxicity(d.where("false"), l).count() == 0
    kept = X.drop_toxic(d, X.fit(d, l))
    assert kept.columns == d.columns and 902 not in {r["doc_id"] for r in rows(kept)} and {900, 901} <= {r["doc_id"] for r in rows(kept)}
