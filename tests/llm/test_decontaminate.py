import hashlib
import random

import pytest

from brindle.llm import decontaminate as D
from brindle.llm.common import plain_words
from tests.llm.conftest import rows

DOCS = "doc_id long, text string, found string, N_WORDS int"


def split(text):
    """Words as the contract has them, without the operator's code."""
    out, word = [], ""
    for c in (text or "") + " ":
        if "A" <= c <= "Z":
            c = chr(ord(c) + 32)
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) > 127:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def brute(text, items, size=8):
    words = split(text)
    hit, found = set(), set()
    for item, passage in items:
        own = split(passage)
        if item is None or not own:
            continue
        n = min(size, len(own))
        for w in [own[j : j + n] for j in range(len(own) - n + 1)]:
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, len(found) >= 2


def fixture(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "C", "dé", "e1"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    short = [0, 1, 2, 3] if seed % 2 else [0, 3, 7]
    items = [(i, make(rng.choice([*short, 8, 9, 12, 30]))) for i in range(8)] + [(3, make(9)), (None, make(8)), (20, None), (1000, "A b;a-B C")]
    docs = []
    for i in range(24):
        own = rng.choice(items)[1] or ""
        docs.append((i, rng.choice(["", "- "]) + make(rng.choice([0, 3, 7, 8, 40])) + (f" , {own.upper() if i % 3 else own}; {make(4)}" if rng.random() < 0.6 else "")))
        if i % 4 == 0:
            docs.append((200 + i, f"{make(5)} {own} {rng.choice(items)[1] or ''} {make(2)} {items[-1][1]}"))
    return docs, items


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    docs, items = fixture(seed)
    docs += [(100, None), (None, docs[0][1]), docs[1], (101, ""), (102, "x " * 30_000 + (items[5][1] or ""))]
    want = sorted([(i, *brute(t, items)) for i, t in docs], key=repr)
    assert any(w[3] > 1 for w in want) and any(w[1] > 3 and w[3] <= 1 for w in want)
    for most in (10**6, 5):  # one block, and several
        d = spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS)
        b = spark.createDataFrame(items, "item_id long, text string")
        found, name = D.search_documents(d.select("doc_id", "text"), b, most=most)
        got = []
        for r in rows(found):
            f = r[name]
            got.append((r["doc_id"], f["n_words"], sum(s["b"] - s["a"] for s in f["spans"]), len(f["items"]), D.sha256_of(f["items"]), len(f["items"]) >= 2))
        assert sorted(got, key=repr) == want
    got = [tuple(r.values()) for r in rows(D.contamination(d, b))]
    assert sorted(got, key=repr) == want


def test_short_items_are_one_window():
    block = next(D.blocks_of([(1, "Solo"), (2, "two words")]))
    spans, items = D.find_hits(plain_words("x solo two-words solo"), block, [])
    assert items == {"1", "2"} and sum(b - a for a, b in spans) == 4 and spans[0][0] == 1 and spans[-1][1] == 5


def test_windows_of_frequent_words_and_small_tables(monkeypatch):
    """Few words, so that all blocks collide; a shift table with fewer entries than blocks."""
    monkeypatch.setattr(D, "_LEAST", 2)
    monkeypatch.setattr(D, "_MOST", 3)
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice(["of", "the", "a", "x y"]) for _ in range(rng.choice([1, 2, 5, 20, 60])))) for i in range(30)]
    block = next(D.blocks_of(items))
    for _ in range(30):
        text = " ".join(rng.choice(["of", "the", "a", "x", "y", "other"]) for _ in range(120))
        spans, found = D.find_hits(plain_words(text), block, [])
        assert (len(split(text)), sum(b - a for a, b in spans), len(found)) == brute(text, items)[:3]


def test_stage_keeps_columns_and_clean_rows(spark):
    passage = "one two three four five six seven eight nine"
    d = spark.createDataFrame([(1, f"x {passage} y", "k", 1), (2, "clean", "k", 1), (3, None, None, None)], DOCS)
    b = spark.createDataFrame([(7, passage)], "item_id long, text string")
    out = D.decontaminate(d, b)
    assert out.columns == d.columns and sorted(r["doc_id"] for r in rows(out)) == [2, 3]
    empty = b.where("false")
    assert D.decontaminate(d, empty).count() == 3
    assert D.decontaminate(d.where("false"), b).count() == 0
