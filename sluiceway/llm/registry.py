"""The training-data operators as registered queries, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fill_middle, filter_audit, gif, jaccard_join, language_id, licenses, line_dedup, mixture, secrets, toxicity, url_filter
from .common import read


def op1_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.store_texts(read(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mixture.mix_sources(docs, mixture.word_count(F.col("text")), content=F.md5(F.coalesce(F.col("text"), F.lit(""))))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents")).drop("spans")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.near_duplicate_lines(read(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_components(read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_middle(read(spark, sf_dir, "documents"))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


#: Rules of the registered query: verdict, host, path.
URL_RULES = tuple(url_filter.Rule(*r) for r in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_pages(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"), URL_RULES)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')))[1:15] AS k
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
cat AS (
  SELECT source, source_size, CAST(2 * source_size AS DOUBLE) AS cap,
         CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS asked
  FROM totals),
lev AS (
  SELECT *, cap / weight AS ratio,
         (asked - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM cat),
plan AS (
  SELECT source, source_size,
         least(cap, coalesce(max(CASE WHEN ratio >= level THEN level END) OVER () * weight, cap)) AS target
  FROM lev),
placed AS (
  SELECT s.doc_id, s.source, s.size, p.source_size, p.target, CAST(floor(p.target + 0.5) AS BIGINT) AS budget,
         coalesce(CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS place
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target,
       CAST(greatest(0, least(size, budget - place)) + greatest(0, least(size, budget - source_size - place)) AS BIGINT) AS taken
FROM placed
"""

OP5_SQL = r"""
WITH RECURSIVE l AS (
  SELECT line, count(*) AS n_rows, min(doc_id) AS first_id, length(line) AS n_chars, md5(line) AS line_id
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY line),
signs AS (SELECT DISTINCT unnest(string_split(regexp_replace(line, '[\x00-\x7F]', '', 'g'), '')) AS sign FROM l),
-- DuckDB's distance counts bytes: each sign beyond ASCII is put into one of 26 control characters.
coded AS (
  SELECT coalesce(string_agg(sign, '' ORDER BY sign), '') AS odd, coalesce(string_agg(chr(CASE WHEN k < 9 THEN k ELSE k + 5 END), '' ORDER BY sign), '') AS plain
  FROM (SELECT sign, CAST(row_number() OVER (ORDER BY sign) AS INT) AS k FROM signs WHERE sign <> '')),
p AS (SELECT line_id, line, n_chars, translate(line, odd, plain) AS code FROM l, coded),
e AS (
  SELECT a.line_id AS x, b.line_id AS y FROM p a JOIN p b
  ON b.n_chars BETWEEN a.n_chars - 2 AND a.n_chars + 2 AND a.line_id <> b.line_id
  AND (a.n_chars < 3
       OR substr(a.line, 1, a.n_chars // 3) = substr(b.line, 1, a.n_chars // 3)
       OR contains(b.line, substr(a.line, a.n_chars // 3 + 1, a.n_chars // 3))
       OR contains(b.line, substr(a.line, 2 * (a.n_chars // 3) + 1)))
  AND levenshtein(a.code, b.code) <= 2),
r AS (SELECT line_id AS node, line_id AS seen FROM l UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen),
c AS (SELECT node, min(seen) AS class_id FROM r GROUP BY node),
d AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT l.line_id, n_chars, n_rows, first_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, class_id, class_id = l.line_id AS kept
FROM l JOIN c ON c.node = l.line_id LEFT JOIN d ON d.x = l.line_id
"""

OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       coalesce(doc_id = min(doc_id) OVER (PARTITION BY text_sha256), false) AS kept, text_sha256
FROM n
"""


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) k ON k.node = d.doc_id
"""

OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
k AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS UBIGINT) % (len(u) + 1) AS k1, CAST('0x' || h[9:16] AS UBIGINT) % (len(u) + 1) AS k2,
         CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR CAST('0x' || h[17:24] AS UBIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS UBIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
c AS (
  SELECT *, coalesce(array_to_string(u[1:least(k1, k2)], ''), '') AS p, coalesce(array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], ''), '') AS m,
         coalesce(array_to_string(u[greatest(k1, k2) + 1:], ''), '') AS s
  FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM c
"""


def _strength_sql(children: str) -> str:
    """Of the strengths tried the likeliest for a table of children, as ``fit_strength`` takes it."""
    total = f"""SELECT m, sum(lgamma(bad + mean * m) - lgamma(mean * m) + lgamma(n - bad + (1 - mean) * m) - lgamma((1 - mean) * m) + lgamma(m) - lgamma(n + m)) AS t
    FROM {children}, (SELECT pow(2, i / 2.0) AS m FROM range(-2, 25) AS r(i)) WHERE n > 1 GROUP BY m"""
    return f"(SELECT coalesce(max(m), 4096.0) FROM (SELECT m, t, max(t) OVER () AS best FROM ({total})) WHERE t >= best - 1e-6)"


# The posterior probability comes from a power series here, from a continued fraction in the operator.
OP12_SQL = rf"""
WITH rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests),
marked AS (
  SELECT doc_id, max(CAST(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 AS BIGINT)) AS bad
  FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
keyed AS (SELECT host, try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]{{1,18}})(?:[/.]|$)', 1), '') AS BIGINT) AS doc_id FROM parts),
hosts AS (
  SELECT host, name, CASE WHEN regexp_matches(name, '^[0-9]+(\.[0-9]+){{3}}$|\]$') OR dom = '' THEN name ELSE dom END AS domain, n, bad
  FROM (SELECT *, regexp_extract(name, '(?:^|\.)([^.]+\.(?:{"|".join(s.replace(".", chr(92) + ".") for s in url_filter.SUFFIXES)}|[^.]+))$', 1) AS dom
        FROM (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), '\.*(:[0-9]*)?$', '') AS name, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS bad
              FROM keyed LEFT JOIN marked USING (doc_id) GROUP BY host))),
named AS (SELECT host, domain, CASE WHEN regexp_matches(domain, '^[0-9]+(\.[0-9]+){{3}}$|\]$') THEN '' ELSE regexp_extract(domain, '^[^.]*\.(.*)$', 1) END AS suffix, n, bad FROM hosts),
whole AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS mean, coalesce(sum(n), 0) AS labelled FROM named),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(whole.mean) AS mean FROM d0, whole GROUP BY suffix),
s1 AS (SELECT suffix, (bad + g * mean) / (n + g) AS mean FROM s0, (SELECT {_strength_sql("s0")} AS g)),
d1 AS (SELECT domain, suffix, n, bad, s1.mean FROM d0 JOIN s1 USING (suffix)),
d2 AS (SELECT domain, (bad + g * mean) / (n + g) AS mean FROM d1, (SELECT {_strength_sql("d1")} AS g)),
h1 AS (SELECT host, domain, suffix, n, bad, d2.mean FROM named JOIN d2 USING (domain)),
h2 AS (SELECT host, domain, suffix, n, bad, bad + g * mean AS a, n - bad + g * (1 - mean) AS b FROM h1, (SELECT {_strength_sql("h1")} AS g)),
h3 AS (
  SELECT h2.*, a / (a + b) AS rate,
         CASE WHEN labelled = 0 THEN 0.0 ELSE 1 - exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) / a
           * list_reduce(list_transform(range(1, 4000), lambda i: [CAST(i AS DOUBLE), 0.0]), lambda acc, i: [acc[1] + acc[2] * x * (a + b + i[1] - 1) / (a + i[1]), acc[2] * x * (a + b + i[1] - 1) / (a + i[1])], [CAST(1 AS DOUBLE), 1.0])[1] END AS above
  FROM h2, (SELECT mean AS x, labelled FROM whole)),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                 WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN above >= 0.95 THEN 'block' ELSE 'allow' END AS verdict,
       domain, suffix, n AS n_labelled, bad AS n_bad, round(rate, 6) AS rate, round(above, 6) AS above
FROM ruled JOIN h3 USING (host)
"""

# Applies the filters row by row in each order, without any inversion.
OP13_SQL = r"""
WITH d AS (
  SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
f AS (
  SELECT part, good, toxic,
         CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(x, '[A-Z]')) > 5 * length(x) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END AS fails
  FROM d),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.c <> b.c AND a.c <> c.c AND a.c <> d.c AND a.c <> e.c AND b.c <> c.c AND b.c <> d.c AND b.c <> e.c AND c.c <> d.c AND c.c <> e.c AND d.c <> e.c),
s AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step:step] AS own, filter_order[1:step - 1] AS before FROM o, range(1, 6) AS r(step)),
t AS (SELECT s.*, g.*, contains(fails, own) AS hit, translate(fails, before, '') <> fails AS gone FROM s, g),
r AS (
  SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = own), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(n_good) FILTER (hit AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n_toxic) FILTER (hit AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM t GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_gif, op2_mix_sources, op3_secrets, op4_licenses, op5_line_dedup, op6_bpe, op7_toxicity, op8_exact_dedup, op9_jaccard_join, op10_language_id, op11_fill_middle, op12_url_filter, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": OP2_SQL, "op5_line_dedup": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op9_jaccard_join": OP9_SQL, "op11_fill_middle": OP11_SQL, "op12_url_filter": OP12_SQL, "op13_filter_audit": OP13_SQL}
