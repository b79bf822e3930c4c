"""DuckDB SQL of the training-data queries that SQL can express, each written from its contract and not from the operator."""

from __future__ import annotations

from tidelog.llm.url_filters import RULES, SECOND_LEVEL

_WORDS = r"regexp_extract_all(coalesce({x}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format(x="text")} AS w FROM documents),
g AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE doc_id IS NOT NULL AND len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
c AS (SELECT DISTINCT rid, i + k AS p FROM (SELECT rid, i, unnest(range(0, 13)) AS k FROM g JOIN f USING (s) WHERE doc_id > first)),
n AS (SELECT rid, count(*) AS n_removed FROM c GROUP BY rid),
x AS (SELECT rid, p, w[p] AS word FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN c USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)"""

_HOST = r"regexp_extract(rest, '^[^/?#]*')"
_BARE = r"""CASE WHEN starts_with(name, '[') THEN regexp_extract(name, '^\[[^\]]*\]?') ELSE regexp_replace(split_part(name, ':', 1), '\.$', '') END"""
_ADDRESS = r"(starts_with({x}, '[') OR regexp_matches({x}, '^[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}$'))"
_THREE = rf"regexp_matches(host, '(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$')"
_LAST = "array_to_string(string_split(host, '.')[-{n}:], '.')"


def _rule_sql(what: str) -> str:
    tests = []
    for action, text in sorted(RULES, key=lambda r: -len(r[1])):
        name, slash, tail = text.partition("/")
        tests.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + tail}') THEN '{text if what == 'rule' else action}'")
    return f"CASE {' '.join(tests)} END"


def _fit(table: str) -> str:
    """Prior strength of a level by moments."""
    return f"""(SELECT CASE WHEN coalesce(sum(CAST(n - 1 AS DOUBLE)), 0) = 0 THEN 4.0 ELSE least(1000.0, greatest(2.0, 1 / least(1.0, greatest(1e-6, sum((k / n - p0) ** 2 * n / (p0 * (1 - p0)) - 1) / sum(n - 1))) - 1)) END
 FROM {table} WHERE n > 1 AND p0 > 0 AND p0 < 1)"""


OP4 = f"""
WITH RECURSIVE u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
a AS (SELECT page_id, {_LOWER.format(x=_HOST)} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
p AS (SELECT page_id, host, path, {_BARE} AS bare FROM (SELECT *, string_split(host, '@')[-1] AS name FROM a)),
good AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
s AS (SELECT bare AS host, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})([/.]|$)', 1), '') AS BIGINT) AS doc_id FROM p),
h0 AS (SELECT host, CAST(count(good) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE good = 1) AS DOUBLE) AS k FROM s LEFT JOIN good USING (doc_id) GROUP BY host),
h1 AS (SELECT *, CASE WHEN {_ADDRESS.format(x="host")} THEN host WHEN {_THREE} THEN {_LAST.format(n=3)} ELSE {_LAST.format(n=2)} END AS domain FROM h0),
h2 AS (SELECT *, CASE WHEN {_ADDRESS.format(x="domain")} OR instr(domain, '.') = 0 THEN domain ELSE substring(domain, instr(domain, '.') + 1) END AS suffix FROM h1),
d1 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h2 GROUP BY ALL),
whole AS (SELECT (coalesce(sum(k), 0) + 3.2) / (coalesce(sum(n), 0) + 4.0) AS p FROM h2),
s2 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(p) AS p0 FROM d1, whole GROUP BY suffix),
s3 AS (SELECT suffix, (k + m * p0) / (n + m) AS p FROM s2, (SELECT {_fit("s2")} AS m)),
d2 AS (SELECT domain, n, k, p AS p0 FROM d1 JOIN s3 USING (suffix)),
d3 AS (SELECT domain, (k + m * p0) / (n + m) AS p FROM d2, (SELECT {_fit("d2")} AS m)),
h3 AS (SELECT host, n, k, p AS p0 FROM h2 JOIN d3 USING (domain)),
b AS (SELECT host, k + m * p0 AS a, n - k + m * (1 - p0) AS b FROM h3, (SELECT {_fit("h3")} AS m)),
t AS (SELECT *, 0.5 > (a + 1) / (a + b + 2) AS turned FROM b),
q AS (SELECT host, a, b, turned, CASE WHEN turned THEN b ELSE a END AS p, CASE WHEN turned THEN a ELSE b END AS q FROM t),
c AS (SELECT host, p, q, 0 AS m, 1.0::DOUBLE AS c, 1 / (1 - (p + q) * 0.5 / (p + 1)) AS d, 1 / (1 - (p + q) * 0.5 / (p + 1)) AS h FROM q
 UNION ALL SELECT host, p, q, m, 1 + odd / c1, 1 / (1 + odd * d1), h * d1 * c1 * (1 + odd / c1) / (1 + odd * d1) FROM (
 SELECT host, p, q, m + 1 AS m, h, 1 / (1 + even * d) AS d1, 1 + even / c AS c1, odd FROM (
 SELECT *, (m + 1) * (q - m - 1) * 0.5 / ((p + 2 * m + 1) * (p + 2 * m + 2)) AS even, -(p + m + 1) * (p + q + m + 1) * 0.5 / ((p + 2 * m + 2) * (p + 2 * m + 3)) AS odd FROM c WHERE m < 300) e) f),
f AS (SELECT q.host, turned, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a + b) * ln(0.5)) / q.p * c.h AS x FROM q JOIN c ON c.host = q.host AND c.m = 300),
v AS (SELECT host AS bare, CASE WHEN turned THEN 1 - x ELSE x END <= 0.05 AS allowed FROM f)
SELECT page_id, host, path, {_rule_sql("rule")} AS rule, coalesce({_rule_sql("verdict")}, CASE WHEN allowed THEN 'allow' ELSE 'block' END) AS verdict FROM p JOIN v USING (bare)"""

OP6 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format(x="text")}) AS BIGINT) AS size, ('0x' || substring(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS u FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
s1 AS (SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s0),
s2 AS (SELECT *, row_number() OVER o AS place, coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
 sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left FROM s1 WINDOW o AS (ORDER BY cap / weight, rank)),
s3 AS (SELECT *, (total - before) / weights_left AS level FROM s2),
s4 AS (SELECT *, (SELECT arg_min(level, place) FROM s3 WHERE level * weight <= cap) AS fair FROM s3),
s AS (SELECT source, rank, source_size, least(cap, coalesce(fair * weight, cap)) AS target FROM s4),
q AS (SELECT d.*, rank, source_size, target, CAST(sum(size) OVER (PARTITION BY rank ORDER BY u, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS done FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
l AS (SELECT rank, done, size, r, (r * source_size + done - size / 2) / target AS middle FROM q, range(0, 3) t(r) WHERE size > 0 AND target > 0),
run AS (SELECT *, sum(size) OVER (ORDER BY middle, rank, r, done ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM l),
k AS (SELECT rank, done, size, count(*) AS times FROM run WHERE upto <= (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT doc_id, q.size, source_size, target, CAST(q.size * coalesce(times, 0) AS BIGINT) AS taken, source FROM q LEFT JOIN k ON q.rank = k.rank AND q.done = k.done AND q.size = k.size"""

OP8 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, max(page_id) AS last FROM p GROUP BY digest),
r AS (SELECT page_id, n, digest, CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to FROM p JOIN g USING (digest))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(x=_LOWER.format(x="text"))} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3) UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 90 * (x.n + y.n - inter)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(c.low, d.doc_id)) AS BIGINT) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

ORACLE_SQL = {"op1_substring_dedup": OP1, "op4_url_filters": OP4, "op6_source_mixing": OP6, "op8_warc": OP8, "op9_ngram_join": OP9}
