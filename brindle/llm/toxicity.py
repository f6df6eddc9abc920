"""Toxicity: a counterfactual-regularised classifier.

Logistic regression over presence of words and of their prefixes.  The terms
of IDENTITY name groups of people without judging them.  For every labelled text
that holds one, the text with another term of the same kind and language in its
place should score alike: the squared change of the logit is a penalty.  A text
that holds none is given a mention, in turn of every term, and swapped too; what
the mention itself changes is a penalty as well, so that words which only begin
like an insult are not scored like one.  So a neutral mention of a group moves
the score as little as the data allow, whether or not the sample mentions any.

Fitting reads a bounded sample of labelled rows (FIT_POSITIVE, FIT_NEGATIVE, in
the order of a hash of doc_id, one text for each doc_id), of which only counts
of features and the numbers of chosen features reach the driver.  The sample's
classes are weighted back to their shares of all labels, so a text scores alike
however many labels there are.  Scoring runs over every text as a whole.

Null and empty texts have no features and get the score of the intercept; of a
very long text the distinct words count.  Labels that are null, or whose doc_id
is, are not learnt from; a doc_id that is labelled twice counts as toxic if one
label says so, and of several texts of one doc_id the first by a hash is learnt
from.  Features that tie are chosen by name.  Without labels of both kinds every
score is 0.  Repeated rows get equal scores; an empty table gives no rows.
Columns beside doc_id, text and toxic are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import materialise

#: Bounds of the sample that the classifier is fitted on.
FIT_POSITIVE, FIT_NEGATIVE = 2_500, 5_000
#: Features that the model has at most, and documents a feature must occur in.
FEATURES, LEAST_DOCS = 2_048, 3
PREFIXES = (3, 4, 5, 6)
#: Strength of the counterfactual and of the quadratic penalty, beside a loss that is summed over the sample; steps of the fit.
COUNTERFACTUAL, RIDGE, STEPS = 4.0, 0.15, 400

# Neutral names of groups; each line is a kind in a language, whose terms may stand for each other.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("black", "white", "asian", "latino", "african", "arab", "european", "indian", "chinese", "mexican"),
    ("woman", "man", "women", "men", "female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("muslimisch", "christlich", "jüdisch", "katholisch"),
    ("türkisch", "deutsch", "polnisch", "syrisch"),
    ("frau", "mann", "frauen", "männer"),
    ("schwul", "lesbisch", "hetero"),
    ("musulmán", "cristiano", "judío", "católico"),
    ("gitano", "español", "mexicano", "chino"),
    ("mujer", "hombre", "mujeres", "hombres"),
    ("lesbiana", "gais", "heterosexuales"),
    ("musulman", "chrétien", "juif", "catholique"),
    ("maghrébin", "français", "africain", "asiatique"),
    ("femme", "homme", "femmes", "hommes"),
    ("lesbienne", "homosexuel", "hétérosexuel"),
)

WORD = re.compile(r"\w+")


def features_of(text: str | None) -> set[str]:
    """Words (``=word``) and prefixes (``^pre``) of a text."""
    words = set(WORD.findall((text or "").lower()))
    out = {f"={w}" for w in words}
    for n in PREFIXES:
        out.update(f"^{w[:n]}" for w in words if len(w) > n)
    return out


@dataclass
class Model:
    """weights: feature -> weight; scores are probabilities of the label 1."""

    weights: dict[str, float]
    intercept: float

    def __post_init__(self):
        self.words = {f[1:] for f in self.weights if f[0] == "="}
        self.stems = {n: {f[1:] for f in self.weights if f[0] == "^" and len(f) == n + 1} for n in PREFIXES}

    def score(self, text: str | None) -> float:
        words = set(WORD.findall((text or "").lower()))
        w = self.weights
        z = [w[f"={x}"] for x in words & self.words]
        for n, stems in self.stems.items():
            if stems:
                z += [w[f"^{x}"] for x in {x[:n] for x in words if len(x) > n} & stems]
        z = self.intercept + math.fsum(z)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of the sample: at most FIT_POSITIVE + FIT_NEGATIVE rows, whose ids can be broadcast."""
    order = (F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id")
    ids = labels.where("toxic = 1").orderBy(*order).limit(FIT_POSITIVE).union(labels.where("toxic = 0").orderBy(*order).limit(FIT_NEGATIVE))
    ids = materialise(ids, "toxicity-ids")
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    one = found.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min_by(F.struct("text"), F.xxhash64("text")).alias("row"))
    return materialise(one.select("row.text", "toxic"), "toxicity-sample")


def usable(labels: DataFrame) -> DataFrame:
    """doc_id, toxic: one row for each doc_id that has a label."""
    return labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def chosen_features(sample: DataFrame, n: dict[int, int], identity=IDENTITY) -> list[str]:
    """Identity terms and the features whose share differs most between the labels."""

    def tally(batches):
        held: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in features_of(text):
                    held[f][y] += 1
            if len(held) > 500_000:
                yield told(held)
                held.clear()
        yield told(held)

    def told(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array([v[k] for v in held.values()], pa.int64()) for k in (0, 1))], names=["feature", "neg", "pos"])

    sums = sample.mapInArrow(tally, "feature string, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    p, q = (F.col("pos") + 0.5) / (n[1] + 1), (F.col("neg") + 0.5) / (n[0] + 1)
    ranked = sums.where(F.col("pos") + F.col("neg") >= LEAST_DOCS).withColumn("gain", F.abs((p - q) * F.log(p / q))).orderBy(F.desc("gain"), "feature").limit(FEATURES)
    own = [f"={t}" for kind in identity for t in kind]
    return list(dict.fromkeys([*own, *(r.feature for r in ranked.select("feature").collect())]))


def difference(a: str, b: str | None, place: dict[str, int], numbers: set[int]) -> dict[int, float]:
    """Change of the features of a text when its word b, or none, gives way to a; features of its other words stay."""
    old, new = (features_of(b) if b else set()), features_of(a)
    out = {place[f]: -1.0 for f in old - new if f in place and place[f] not in numbers}
    return out | {place[f]: 1.0 for f in new - old if f in place and place[f] not in numbers}


def swaps(texts: list[set[int]], place: dict[str, int], identity=IDENTITY) -> list[dict[int, float]]:
    """Changes of the features of each text when an identity term gives way to another of its kind, or is mentioned."""
    out, terms = [], [(kind, k) for kind in identity for k in range(len(kind))]
    for n, numbers in enumerate(texts):
        held = [(kind, k) for kind, k in terms if place[f"={kind[k]}"] in numbers]
        for kind, k in held:
            other = next((o for o in (*kind[k + 1 :], *kind[:k]) if place[f"={o}"] not in numbers), None)
            if other:
                own = features_of(kind[k])
                out.append(difference(other, kind[k], place, numbers - {place[f] for f in own if f in place}))
        if not held and terms:
            kind, k = terms[n % len(terms)]
            term, other = kind[k], kind[(k + 1 + n // len(terms)) % len(kind)]
            out.append(difference(term, None, place, numbers))
            if other != term:
                out.append(difference(other, term, place, numbers))
    return [c for c in out if c]


def fit_weights(rows: list[tuple[int, list[int]]], features: list[str], toxic: float, identity=IDENTITY) -> Model:
    """Full-batch Adam on the loss with both penalties; `toxic` is the share of toxic rows that the classes are weighted to."""
    place, k = {f: i for i, f in enumerate(features)}, len(features)
    x, y = np.zeros((len(rows), k), np.float32), np.array([r[0] for r in rows], np.float32)
    for i, (_, numbers) in enumerate(rows):
        x[i, numbers] = 1
    changes = swaps([set(numbers) for _, numbers in rows], place, identity)
    at = np.repeat(np.arange(len(changes)), [len(c) for c in changes])
    which = np.fromiter((f for c in changes for f in c), np.int64, len(at))
    by = np.fromiter((v for c in changes for v in c.values()), np.float64, len(at))
    weight = np.where(y == 1, toxic / y.mean(), (1 - toxic) / (1 - y.mean())).astype(np.float32) / len(y)
    w, b = np.zeros(k, np.float32), np.float32(math.log(toxic / (1 - toxic)))
    m, v, mb, vb = np.zeros(k, np.float32), np.zeros(k, np.float32), 0.0, 0.0
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -60, 60)))
        left = weight * (p - y)
        g, gb = x.T @ left + RIDGE / len(y) * w, float(left.sum())
        if len(changes):
            moved = np.bincount(at, by * w[which], len(changes))
            g += (COUNTERFACTUAL / len(y) * np.bincount(which, by * moved[at], k)).astype(np.float32)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        up, down = 1 - 0.9**t, 1 - 0.999**t
        w = w - 0.08 * (m / up) / (np.sqrt(v / down) + 1e-8)
        b = b - np.float32(0.08 * (mb / up) / (math.sqrt(vb / down) + 1e-8))
    return Model({f: float(a) for f, a in zip(features, w, strict=True)}, float(b))


def fit(docs: DataFrame, labels: DataFrame, identity=IDENTITY) -> Model | None:
    """The model of docs (doc_id, text) under labels (doc_id, toxic); None without labels of both kinds."""
    clean = usable(labels)
    shares = {r.toxic: r.n for r in clean.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sample = labelled_sample(docs, clean)
    n = {0: 0, 1: 0} | {int(r.toxic): r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n[0] or not n[1]:
        return None
    features = chosen_features(sample, n, identity)
    place = {f: i for i, f in enumerate(features)}

    def number(batches):
        for batch in batches:
            found = [sorted(place[f] for f in features_of(t) & place.keys()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "numbers"])

    rows = sorted((r.toxic, list(r.numbers)) for r in sample.mapInArrow(number, "toxic int, numbers array<int>").toLocalIterator())
    return fit_weights(rows, features, shares[1] / (shares[0] + shares[1]), identity)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score for every row."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(held.value.score, batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model | None, most: float = 0.5) -> DataFrame:
    """docs, its columns and order within partitions kept, without rows that score `most` or more; null and empty texts are judged by the intercept."""
    if model is None:
        return docs
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([held.value.score(t) < most for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out():
    """The fold that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; labels of the held-out fold are not read."""
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
