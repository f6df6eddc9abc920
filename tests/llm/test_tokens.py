import os
import random

import pytest

pytest.importorskip("tiktoken")
from brindle.llm import tokens
from tests.llm.conftest import rows

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def enc():
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens.encoder(f.read())


def whole(text, enc):
    return len(enc._encode(text))


BITS = ["the", " ", "  ", "\n", "don't", "'", "'re", "é", "漢字", "123", " 4", "!!", "a" * 40, "\t \n", "we'll ", "x@y.zz", ""]


def test_random_edits_equal_a_full_encoding(enc):
    for seed in range(150):
        one_text(enc, random.Random(seed))


def one_text(enc, rng):
    text = "".join(rng.choice(BITS) for _ in range(rng.choice([0, 1, 5, 300, 3000])))
    tree = tokens.TokenTree.of(text, enc)
    assert tree.total == whole(text, enc)
    for _ in range(12):
        a = rng.randint(0, len(text))
        b = rng.randint(a, min(len(text), a + rng.choice([0, 1, 3, 60])))
        put = "".join(rng.choice(BITS) for _ in range(rng.choice([0, 1, 2, 8, 400])))
        text, _ = tree.edit(text, a, b, put, enc)
        assert tree.total == whole(text, enc)
        assert tree.chars[1] == len(text) and tree.pieces == len(tokens._SPLIT.findall(text))
    for _ in range(6):  # many edits at once
        places = sorted({rng.randint(0, len(text)) for _ in range(2 * rng.choice([1, 2, 5, 40]))})
        edits = [(a, b, "".join(rng.choice(BITS) for _ in range(rng.choice([0, 1, 3])))) for a, b in zip(places[::2], places[1::2], strict=False)]
        want, at = "", 0
        for a, b, put in edits:
            want += text[at:a] + put
            at = b
        want += text[at:]
        rng.shuffle(edits)
        text, n = tree.edit_all(text, edits, enc)
        assert text == want and tree.total == whole(text, enc) and tree.chars[1] == len(text)
        assert tree.pieces == len(tokens._SPLIT.findall(text)) and n <= tree.pieces


def test_an_edit_encodes_its_surroundings_only(enc):
    text = "some plain words here " * 2000
    tree = tokens.TokenTree.of(text, enc)
    new, n = tree.edit(text, 20_000, 20_004, "other", enc)
    assert tree.total == whole(new, enc)
    assert n <= 4 * tokens.LEAF


def test_dense_edits_cost_one_pass_at_most(enc):
    text = "write to joe@example.com or " * 2000
    tree = tokens.TokenTree.of(text, enc)
    new, n = tree.edit_all(text, tokens.redactions(text), enc)
    assert new.count("<email>") == 2000 and tree.total == whole(new, enc) and n <= len(tokens._SPLIT.findall(new))
    far = [(i * 3000, i * 3000 + 3, "new") for i in range(10)]
    _, n = tree.edit_all(new, far, enc)
    assert n <= 10 * 4 * tokens.LEAF


def test_edits_that_overlap_are_refused(enc):
    tree = tokens.TokenTree.of("some text", enc)
    for bad in ([(0, 3, "a"), (2, 4, "b")], [(0, 99, "")], [(5, 4, "")]):
        with pytest.raises(ValueError, match="overlap"):
            tree.edit_all("some text", bad, enc)


def test_kept_trees_take_edits_from_a_table(spark, enc, tmp_path):
    rng = random.Random(3)
    docs = [(i, "".join(rng.choice(BITS) for _ in range(rng.choice([0, 30, 900])))) for i in range(20)] + [(50, None), (51, ""), (None, "a b"), (3, "another text of three")]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, chars string, edits int")
    tokens.trees(d).write.parquet(f"{tmp_path}/v0")
    edits, text = [], {0: docs}
    for version in (1, 2):
        stored = spark.read.parquet(f"{tmp_path}/v{version - 1}")
        own = {i: t for i, t in text[version - 1] if i is not None and i != 3}
        edits = [(i, a, a + 1, rng.choice(["", "new word", "\n"])) for i, t in own.items() if t for a in sorted(rng.sample(range(len(t)), min(len(t), 3)))]
        edits += [(51, 0, 0, "was empty")] if version == 1 else []
        edits += [(3, 0, 1, "Z"), (None, 0, 0, "no document"), (999, 0, 0, "no such")]
        table = spark.createDataFrame(edits, "doc_id long, start long, end long, put string")
        out = tokens.edited(stored, table)
        out.write.parquet(f"{tmp_path}/v{version}")
        want = []
        for i, t in text[version - 1]:
            new, at = "", 0
            for _, a, b, put in sorted(e for e in edits if e[0] is not None and e[0] == i):
                new += (t or "")[at:a] + put
                at = b
            want.append((i, t if t is None else new + t[at:]))
        text[version] = want
        got = rows(spark.read.parquet(f"{tmp_path}/v{version}"))
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(want, key=repr)
        for r in got:
            assert r["tokens"][1] == whole(r["text"] or "", enc) and r["pretokens"] == len(tokens._SPLIT.findall(r["text"] or ""))
            assert r["n_edits"] == sum(e[0] == r["doc_id"] for e in edits if e[0] is not None)


def test_query_shape(spark, enc):
    docs = spark.createDataFrame([(1, "mail me at joe@example.com now", "x"), (2, None, "x"), (3, "", "x"), (None, "a b", "x"), (1, "mail me at joe@example.com now", "x")], "doc_id long, text string, n_tokens string")
    got = rows(tokens.count_tokens(docs))
    assert [r["doc_id"] for r in got].count(1) == 2
    one = next(r for r in got if r["doc_id"] == 1)
    assert one["n_edits"] == 1 and one["tokens_after"] == whole("mail me at <email> now", enc) and one["n_tokens"] == whole("mail me at joe@example.com now", enc)
    assert all(r["n_tokens"] == 0 for r in got if r["doc_id"] in (2, 3))
    assert rows(tokens.count_tokens(docs.where("false"))) == []
