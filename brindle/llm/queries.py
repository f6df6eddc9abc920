"""The registered queries of the operators, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import anisotropic, chunks, decontaminate, licenses, mix, neardup, shards, tokens, toxicity, urlfilter
from brindle.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document; rows of the held-out fold are not learnt from.  Null and empty texts score the intercept."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 0.8 on two-word shingles.  Texts without words are alone."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of every document that benchmark windows hit.  Null texts have no words."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_items=2)


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the compacted store holds each document: its columns but for the text, then shard, shard_bytes and version, under unused names where a column is called so."""
    return shards.sharded(table(spark, sf_dir, "documents")).drop("text")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates of every document.  Null texts have no words."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts of each document, before and after e-mail addresses are redacted."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document.  Null texts have size 0, null sources are one source."""
    return mix.mixed(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector.  Vectors without a direction take no part."""
    return anisotropic.neighbours(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document that shares a passage with another place, in the same document or another; documents without one are absent."""
    return chunks.repeats(table(spark, sf_dir, "documents"), within=True)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page.  Nulls and urls without :// are allowed."""
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_decontaminate": op3_decontaminate,
    "op4_shards": op4_shards,
    "op5_licenses": op5_licenses,
    "op6_tokens": op6_tokens,
    "op7_mix": op7_mix,
    "op8_neighbours": op8_neighbours,
    "op9_substrings": op9_substrings,
    "op10_url_filter": op10_url_filter,
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"


def _pairs() -> str:
    """The pairs of phrases and templates as rows (template, label, exact, pairs, t_pos, pair)."""
    rows = []
    for i, (text, label) in enumerate((*licenses.PHRASES, *licenses.TEMPLATES)):
        words = text.split()
        rows += [f"({i}, '{label}', {i < len(licenses.PHRASES)}, {len(words) - 1}, {j}, '{a} {b}')" for j, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    return ", ".join(rows)


_HOST_RULES = ", ".join(f"('{r.name}', '{r.verdict}')" for r in urlfilter.HOST_RULES)
_PATTERNS = " OR ".join(f"regexp_matches(host, '(^|[.-]){r.name}($|[.-])')" for r in urlfilter.PATTERN_RULES)
_FIRST_PATTERN = "CASE " + " ".join(f"WHEN regexp_matches(host, '(^|[.-]){r.name}($|[.-])') THEN '{r.name}'" for r in sorted(urlfilter.PATTERN_RULES, key=lambda r: r.name)) + " END"

ORACLE: dict[str, str] = {
    "op2_near_duplicates": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[j : j + 1], ' ') AS s FROM d, unnest(range(1, greatest(1, len(w) - 1) + 1)) AS t(j) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        x AS (SELECT doc_id, n, s FROM s JOIN n USING (doc_id)),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS shared FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
        e AS (SELECT a, b FROM c WHERE 100 * shared >= 80 * (an + bn - shared)),
        l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(id, other) AS (SELECT a, b FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a),
        m AS (SELECT id, least(id, min(other)) AS component_id FROM r GROUP BY id)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id""",
    "op5_licenses": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        t AS (SELECT * FROM (VALUES {_pairs()}) AS t(template, label, exact, pairs, t_pos, pair)),
        p AS (SELECT doc_id, j - 1 AS pos, w[j] || ' ' || w[j + 1] AS pair FROM d, unnest(range(1, len(w))) AS u(j)),
        v AS (SELECT doc_id, template, label, exact, pairs, pos - t_pos AS diagonal, count(*) AS n, list(t_pos) AS seen, min(pos) AS low, max(pos) AS high FROM p JOIN t USING (pair) GROUP BY ALL),
        k AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {licenses.SLACK} AS apart FROM v WHERE NOT exact OR n = pairs),
        g AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS merged FROM k),
        h AS (SELECT doc_id, template, merged, label, pairs, len(list_distinct(flatten(list(seen)))) / pairs AS share, max(high) - min(low) + 2 AS words FROM g WHERE NOT exact GROUP BY doc_id, template, merged, label, pairs),
        o AS (SELECT doc_id, label, share FROM h WHERE share >= CASE WHEN pairs <= {licenses.SHORT} THEN 1.0 ELSE {licenses.LEAST} END AND words <= {licenses.STRETCH} * (pairs + 1)),
        b AS (SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM v WHERE exact AND n = pairs GROUP BY doc_id),
        a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM
            (SELECT * FROM o UNION ALL SELECT doc_id, label, 1.0 FROM v WHERE exact AND n = pairs) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
            coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
        FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)""",
    "op3_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(8, len(w)) AS n, array_to_string(w[j : j + least(8, len(w)) - 1], ' ') AS s
            FROM b, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS t(j) WHERE len(w) > 0),
        dw AS (SELECT doc_id, j, n, array_to_string(w[j : j + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM iw), unnest(range(1, len(w) - n + 2)) AS t(j)),
        h AS (SELECT doc_id, j, n, item FROM dw JOIN iw USING (n, s)),
        p AS (SELECT doc_id, count(DISTINCT j + k) AS n_hit FROM h, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
        i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op10_url_filter": f"""
        WITH r AS (SELECT * FROM (VALUES {_HOST_RULES}) AS t(rule, verdict)),
        u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
        s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, CASE WHEN position('/' IN rest) > 0 THEN substr(rest, position('/' IN rest)) ELSE '' END AS path FROM u),
        m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM s JOIN r
            ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, position('/' IN rule))) GROUP BY page_id)
        SELECT s.page_id, host, path, rule, coalesce(verdict, CASE WHEN {_PATTERNS} THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN rule IS NULL THEN {_FIRST_PATTERN} END AS pattern
        FROM s LEFT JOIN m USING (page_id)""",
}
