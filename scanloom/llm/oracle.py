"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from scanloom.llm import quality_rules as rules

SPACE = r"[ \t\n\x0B\f\r]+"


def _js(shares: list[str], reference: list[str]) -> str:
    terms = []
    for p, q in zip(shares, reference):
        m = f"(({p} + {q}) / 2.0)"
        terms.append(f"((CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0.0 END) + (CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0.0 END))")
    return "sqrt(greatest((" + " + ".join(terms) + ") / 2.0, 0.0))"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_sql() -> str:
    drop = lambda chars: f"length(t) - length(translate(t, {_quote(chars)}, ''))"
    hits = ", ".join(f"len(list_filter(words, lambda w: w IN ('{w}', '{w.capitalize()}'))) AS h{k}" for k, w in enumerate(rules.COMMON))
    classes = ("lower_", "upper_", "digit", "punct", "other", "beyond")
    refs, near = [], []
    for lang, own in rules.WORDS.items():
        names = [f"h{rules.COMMON.index(w)}" for w in own]
        rest = f"(n_words - ({' + '.join(names)}))"
        sums = [f"CAST(sum({x}) AS DOUBLE) / sum(word_chars) AS {lang}_c{k}" for k, x in enumerate(classes)] + [f"CAST(sum({x}) AS DOUBLE) / sum(n_words) AS {lang}_w{k}" for k, x in enumerate([*names, rest])]
        refs.append(f"ref_{lang} AS (SELECT {', '.join(sums)} FROM g10 WHERE NOT base_failed AND lang = '{lang}')")
        a = _js([f"(CAST({x} AS DOUBLE) / word_chars)" for x in classes], [f"{lang}_c{k}" for k in range(len(classes))])
        b = _js([f"(CAST({x} AS DOUBLE) / n_words)" for x in [*names, rest]], [f"{lang}_w{k}" for k in range(len(own) + 1)])
        near.append(f"CASE WHEN {lang}_c0 IS NOT NULL THEN coalesce(CASE WHEN word_chars >= {rules.LEAST_CHARS} THEN {a} END, 0.0) + coalesce(CASE WHEN n_words >= {rules.LEAST_WORDS} THEN {b} END, 0.0) END")
    joins = "".join(f", ref_{lang}" for lang in rules.WORDS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, lang, t, list_filter(string_split_regex(t, '{SPACE}'), lambda x: x <> '') AS words FROM d),
g AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n >= 2),
c AS (SELECT rid, sum(least(3, coalesce(nxt - i, 3))) AS n_repeat FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
l AS (
  SELECT rid, count(*) - count(DISTINCT x) AS n_dup
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^ \t\n\x0B\f\r]') GROUP BY rid
),
m AS (
  SELECT w.rid, doc_id, lang, t, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST({drop(rules.SYMBOLS)} AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS lower_, {drop(rules.UPPER)} AS upper_, {drop(rules.DIGITS)} AS digit, {drop(rules.PUNCTUATION)} AS punct,
    strlen(t) - length(t) AS beyond, words
  FROM w LEFT JOIN c USING (rid) LEFT JOIN l USING (rid)
),
h AS (SELECT *, greatest(word_chars - lower_ - upper_ - digit - punct - beyond, 0) AS other, {hits} FROM m),
g10 AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM h),
{", ".join(refs)},
n AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, list_min([{", ".join(near)}]) AS near FROM g10{joins})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(near, 0.0) <= {rules.LIMIT} AS kept
FROM n
"""


SQL: dict[str, str] = {
    "op1_url_filter": r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT u.*, (SELECT max_by({'rule': h || p, 'verdict': verdict}, length(h || p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS hit
  FROM u
)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict FROM m
""",
    "op6_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
q AS (
  SELECT DISTINCT item, list_aggregate(w[i:i + least(13, len(w)) - 1], 'string_agg', ' ') AS g, least(13, len(w)) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM q),
g AS (
  SELECT rid, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
hits AS (SELECT rid, i, n, item FROM g JOIN q USING (n, g)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
""",
    "op7_warc_zip": r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h, row_number() OVER (ORDER BY page_id) AS r FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN first(page_id) OVER (PARTITION BY h ORDER BY r) END AS first_id, n >= 100 AND row_number() OVER (PARTITION BY h ORDER BY r) > 1 AS again FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first_id END AS refers_to
FROM f
""",
    "op9_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, i, lines[i] AS line FROM (SELECT rid, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.rid, i, line, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS dropped FROM k LEFT JOIN c USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m JOIN d USING (rid) GROUP BY rid
""",
    "op10_quality_rules": quality_sql(),
}
