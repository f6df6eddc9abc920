"""URL filters: rules indexed by their rarest literal token.

Every rule is a regular expression over ``host + path`` with the literal
tokens that any match must hold as whole tokens.  Token frequencies are counted
over all urls, each rule is filed under its rarest token, a url's tokens fetch
the candidate rules, and only those run their expression.  Rules without a
literal token are candidates of every url.

Two kinds: host rules decide by the longest rule that fits (ties: the smaller
rule text); pattern rules speak only where no host rule does, and block.  Rules
come from a table (read_rules) or from code; of a pattern the tokens are read
off its expression, those that it holds between two other literal characters.

Rules are broadcast, at most MOST_RULES of them and more are refused; a worker
compiles an expression when a url first asks for it.  Nothing else is sent but
one count for each token of the rules.

Nulls and urls without ``://`` have empty host and path, fit no rule and are
allowed.  A very long url is judged whole.  Repeated rows are judged one by one;
an empty table gives no rows, an empty set of rules allows all.  Columns beside
page_id and url are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters, digits and anything beyond ASCII; all else separates tokens.
TOKEN = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
#: Rules that are broadcast at most, of some 300 bytes each; expressions that a worker keeps compiled.
MOST_RULES, COMPILED = 500_000, 20_000


@dataclass(frozen=True)
class Rule:
    """verdict is allow or block; a rule's tokens are whole tokens of every url that it matches."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    is_host: bool


def host_rule(text: str, verdict: str) -> Rule:
    """`text` is host, then path: fits the host and its subdomains where the url's path starts with the rule's."""
    tokens = tuple(m.group() for m in TOKEN.finditer(text) if m.end() < len(text))
    return Rule(text, verdict, rf"(?:[^/?#]*\.)?{re.escape(text)}", tokens, True)


def pattern_rule(name: str, regex: str, *tokens: str) -> Rule:
    """A rule of an expression that starts where the host does; its tokens are read off it unless given."""
    return Rule(name, "block", regex, tokens or literal_tokens(regex), False)


def literal_tokens(regex: str) -> tuple[str, ...]:
    """Tokens that every match of an expression holds as whole tokens: between literal characters that are none of a token's."""
    if re.compile(regex).flags & re.IGNORECASE:
        return ()
    runs, run = [], ""
    for kind, value in re._parser.parse(regex):
        if str(kind) == "LITERAL":
            run += chr(value)
        else:
            runs.append(run)
            run = ""
    return tuple(m.group() for r in (*runs, run) for m in TOKEN.finditer(r) if m.start() > 0 and m.end() < len(r))


def read_rules(table: DataFrame) -> tuple[Rule, ...]:
    """Rules of a table (kind, rule, verdict, regex): of the kind `host` rule and verdict count, of the kind `pattern` rule, which names it, and regex.

    Rows that repeat a rule of one kind count once; a host rule with two verdicts,
    another kind, a null that is needed or an expression that does not compile is refused.
    """
    rows = table.select("kind", "rule", "verdict", "regex").distinct().limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found: dict[tuple[str, str], Rule] = {}
    for r in sorted(rows, key=str):
        if r.kind == "host" and r.rule and r.verdict in ("allow", "block"):
            rule = host_rule(r.rule, r.verdict)
        elif r.kind == "pattern" and r.rule and r.regex:
            re.compile(r.regex, re.S)
            rule = pattern_rule(r.rule, r.regex)
        else:
            raise ValueError(f"no rule: {r}")
        if found.setdefault((r.kind, r.rule), rule) != rule:
            raise ValueError(f"two rules of one name: {r}")
    return tuple(found.values())


@lru_cache(COMPILED)
def _compiled(regex: str) -> re.Pattern:
    return re.compile(regex, re.S)


# The rules of the contract.
HOST_RULES = (
    host_rule("com/", "allow"),
    host_rule("example.com/en/", "block"),
    host_rule("www.example.com/en/", "allow"),
    host_rule("net/es/", "block"),
    host_rule("net/fr/", "block"),
)
#: Words of hosts that sell or lure, each bounded by a label's end or a hyphen.
PATTERN_RULES = (
    pattern_rule("spam-farm", r"[^/]*(?<![^.-])spam-farm(?![^./-])", "spam", "farm"),
    pattern_rule("cheap-pills", r"[^/]*(?<![^.-])cheap-pills(?![^./-])", "cheap", "pills"),
    pattern_rule("casino", r"[^/]*(?<![^.-])casino(?![^./-])", "casino"),
    pattern_rule("free-money", r"[^/]*(?<![^.-])free-money(?![^./-])", "free", "money"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of the first ``://``; both empty without one."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    if slash < 0:
        return rest[:end].translate(FOLD), ""
    return rest[:slash].translate(FOLD), rest[slash:end]


def tokens_of(host: str, path: str) -> set[str]:
    return set(TOKEN.findall(f"{host}{path}"))


def token_counts(pages: DataFrame, vocabulary: Iterable[str]) -> dict[str, int]:
    """How many urls hold each token of the rules: one row per token of the rules comes back."""
    known = pages.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def tally(batches):
        held: dict[str, int] = defaultdict(int)
        for batch in batches:
            for url in batch.column(0).to_pylist():
                for t in tokens_of(*split_url(url)) & known.value:
                    held[t] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])

    rows = pages.select("url").mapInArrow(tally, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r.token: r.n for r in rows}


def index_rules(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """token -> rules filed under it, and the rules that have no token."""
    filed: dict[str, list[int]] = defaultdict(list)
    always = []
    for i, r in enumerate(rules):
        if r.tokens:
            filed[min(r.tokens, key=lambda t: (counts.get(t, 0), t))].append(i)
        else:
            always.append(i)
    return dict(filed), always


def candidates(host: str, path: str, filed: dict[str, list[int]], always: list[int]) -> list[int]:
    """The rules whose expressions run on a url."""
    return [*always, *(i for t in tokens_of(host, path) & filed.keys() for i in filed[t])]


def judge(host: str, path: str, rules, filed, always) -> tuple[str | None, str, str | None]:
    """(host rule that decides, verdict, pattern rule that decides)."""
    if not host and not path:
        return None, "allow", None
    at = f"{host}{path}"
    found = [rules[i] for i in candidates(host, path, filed, always) if _compiled(rules[i].regex).match(at)]
    own = sorted((r for r in found if r.is_host), key=lambda r: (-len(r.name), r.name))
    if own:
        return own[0].name, own[0].verdict, None
    other = sorted(r.name for r in found if not r.is_host)
    return None, "block" if other else "allow", other[0] if other else None


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = HOST_RULES + PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern for every row of pages (page_id, url), by rules or a table of them."""
    rules = read_rules(rules) if isinstance(rules, DataFrame) else rules
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    counts = token_counts(pages, {t for r in rules for t in r.tokens})
    held = pages.sparkSession.sparkContext.broadcast((rules, *index_rules(rules, counts)))

    def run(batches):
        rules, filed, always = held.value
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            told = [judge(h, p, rules, filed, always) for h, p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([x[k] for x in parts], pa.string()) for k in (0, 1)), *(pa.array([x[k] for x in told], pa.string()) for k in (0, 1, 2))],
                names=["page_id", "host", "path", "rule", "verdict", "pattern"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, pattern string")
