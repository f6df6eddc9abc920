import random
import re

import pytest

from brindle.llm import urlfilter as U
from tests.llm.conftest import rows

# The contract's rules.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    for c in "?#":
        rest = rest.split(c, 1)[0] if rest.find(c) >= 0 else rest
    host, slash, path = rest.partition("/")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = slash + path
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        rule, verdict = max(fits, key=lambda x: len(x[0]))
        return host, path, rule, verdict
    return host, path, None, None


def urls():
    rng = random.Random(5)
    hosts = ["com", "Example.com", "www.example.com", "a.www.EXAMPLE.com", "xexample.com", "m.b.net", "net", "znet", "x.org", "", "É.com", "spam-farm.org", "w.spam-farm.net", "nospam-farm.org", "a.com:80"]
    paths = ["", "/", "/en/", "/en", "/en/1?x#y", "/es/2", "/fr/#t", "/ES/1", "?q=/en/", "#a/es/", "/en/http://b.net/es/"]
    out = [None, "", "no scheme", "://", "http://", "a://b://c/en/", "http://x.com\n/en/"]
    return out + [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths]


def test_equals_brute_force(spark):
    some = urls()
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(some)] + [(0, some[0], "x", "y")], "page_id long, url string, host string, verdict string")
    got = rows(U.filter_urls(pages))
    assert len(got) == len(some) + 1
    for r in got:
        host, path, rule, verdict = brute(some[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), some[r["page_id"]]
        if verdict:
            assert r["verdict"] == verdict and r["pattern"] is None
        elif "spam-farm" in host and "nospam" not in host:
            assert r["verdict"] == "block" and r["pattern"] == "spam-farm"
        else:
            assert r["verdict"] == "allow"


def test_only_rules_of_a_rare_token_run(spark):
    filed, always = U.index_rules(U.HOST_RULES, {"com": 90, "example": 50, "en": 40, "www": 10, "net": 30, "es": 5, "fr": 6})
    assert not always and set(filed) == {"com", "en", "www", "es", "fr"}
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_tokens_are_read_off_expressions():
    for regex, tokens in ((r"[^/]*/ads/banner\d+", ("ads",)), (r"ads/x", ()), (r".*\.track\.", ("track",)), (r".*(/ads/|/spam/)", ()), (r".*/a-b/c/", ("a", "b", "c")), (r"(?i).*/ads/", ()), (r".*/ads/?", ()), (r".*/ads/.*/top/$", ("ads", "top"))):
        assert U.literal_tokens(regex) == tokens, regex


def test_thousands_of_rules_from_a_table(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4)))
    hosts = sorted({f"{word()}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['', '', word() + '/', word()])}" for _ in range(5000)})
    told = {h: rng.choice(["allow", "block"]) for h in hosts}
    pairs = [(word(), word()) for _ in range(300)]
    patterns = {f"p{i:03d}": (rf"[^/]*/.*/{a}-{b}/" if i % 2 else rf"[^/]*{a}x{b}") for i, (a, b) in enumerate(pairs)}
    rules = [("host", h, v, None) for h, v in told.items()] + [("pattern", n, "x", r) for n, r in patterns.items()] + [("host", hosts[0], told[hosts[0]], None)]
    table = spark.createDataFrame(rules, "kind string, rule string, verdict string, regex string").repartition(3)
    some = [f"https://{'w.' * rng.randint(0, 2)}{rng.choice(hosts)}{rng.choice(['', '/', word(), word() + '/'])}" for _ in range(300)]
    some += [f"http://{word()}.zz/q/{a}-{b}/{word()}" for a, b in pairs[:150]] + [f"http://{a}x{b}.zz/" for a, b in pairs[150:]] + ["http://aa.com/" + "long/" * 50_000]
    got = {r["page_id"]: r for r in rows(U.filter_urls(spark.createDataFrame(list(enumerate(some)), "page_id long, url string"), table))}
    expressions = {n: re.compile(r, re.S) for n, r in patterns.items()}
    seen = set()
    for i, url in enumerate(some):
        host, path = U.split_url(url)
        fits = [h for h in hosts if (host == h.split("/")[0] or host.endswith("." + h.split("/")[0])) and path.startswith(h[h.index("/") :])]
        hit = sorted(n for n, r in expressions.items() if r.match(host + path))
        r = got[i]
        if fits:
            best = max(map(len, fits))
            assert r["rule"] == min(h for h in fits if len(h) == best) and r["verdict"] == told[r["rule"]] and r["pattern"] is None
        else:
            assert r["rule"] is None and r["pattern"] == (hit[0] if hit else None) and r["verdict"] == ("block" if hit else "allow")
        seen.add((bool(fits), bool(hit)))
    assert {(True, False), (False, True), (False, False)} <= seen
    read = U.read_rules(table)
    assert len(read) == len(hosts) + 300
    filed, always = U.index_rules(read, U.token_counts(spark.createDataFrame(list(enumerate(some)), "page_id long, url string"), {t for r in read for t in r.tokens}))
    run = [len(U.candidates(*U.split_url(u), filed, always)) - len(always) for u in some]
    assert len(always) == 150 and sum(run) / len(run) < 0.01 * len(read)


@pytest.mark.parametrize("bad", [("host", "a/", "maybe", None), ("host", None, "allow", None), ("regex", "a", "block", "a"), ("pattern", "a", None, None), (None, "a", "allow", None)])
def test_rules_that_are_none_are_refused(spark, bad):
    table = lambda *r: spark.createDataFrame(list(r), "kind string, rule string, verdict string, regex string")
    with pytest.raises(ValueError, match="no rule"):
        U.read_rules(table(bad))
    with pytest.raises(ValueError, match="two rules"):
        U.read_rules(table(("host", "a/", "allow", None), ("host", "a/", "block", None)))
    with pytest.raises(re.error):
        U.read_rules(table(("pattern", "a", None, "(")))
    assert U.read_rules(table(bad).where("false")) == ()
