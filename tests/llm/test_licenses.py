import random
import re

from brindle.llm import licenses as L
from tests.llm.conftest import rows

SCHEMA = "doc_id long, text string, labels string, pos int"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans(L.UPPER, L.LOWER)
# The contract's phrases.
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def brute(text):
    w = WORDS.findall((text or "").translate(FOLD))
    at = [(j, name) for p, name in BASE.items() for j in range(len(w)) if tuple(w[j : j + len(p)]) == p]
    return len(w), len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None), ",".join(sorted({n for _, n in at}))


def test_base_equals_brute_force(spark):
    rng = random.Random(8)
    bits = ["MIT", "mit", "License", "licence", "general", "Public", "apache", "x", "é", "LICENSE,", "-", "\u212a", "mıt", "2.0"]
    docs = [(i, " ".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 9, 60])))) for i in range(150)]
    docs += [(None, "MIT license"), (1, docs[1][1]), (900, None), (901, ""), (902, "mit license " * 20_000), (903, "general public license mit license")]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], SCHEMA)
    got = rows(L.scan(d))
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in got) == sorted(repr((i, *brute(t))) for i, t in docs)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == bool(r["labels"])
    assert L.scan(d.where("false")).count() == 0


def test_templates_survive_edits(spark):
    text = L.TEMPLATES[6][0].split()
    broken = text[:5] + ["inserted"] + text[5:9] + text[10:]
    docs = [(1, "Intro. " + " ".join(broken).upper() + " outro"), (2, " ".join(text[:8])), (3, "Licensed under CC BY-NC 4.0."), (4, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r["doc_id"]: r for r in rows(L.scan(spark.createDataFrame([(*r, "x", 1) for r in docs], SCHEMA)))}
    assert got[1]["labels"] == "mit" and L.LEAST <= got[1]["score"] < 1 and got[1]["n_base"] == 0
    assert got[2]["labels"] == "" and got[3]["labels"] == "cc-by-nc-4.0" and got[4]["labels"] == "gpl,gpl-3.0"


def test_plan_is_native(spark):
    plan = L.scan(spark.createDataFrame([(1, "a", "x", 1)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "BroadcastHashJoin" in plan
