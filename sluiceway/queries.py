"""One query per operator over the sample tables, each with the SQL that says the same.

``QUERIES`` maps a name to a function of a session and a data folder; ``SQL`` has
the DuckDB statement for the same rows.  Floats are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import col
from .functions.tables import shared_path
from .operators import clean, deidentify, features, gate, incremental, lineage, monitor, profile, sample
from .plans import jobs, schedule, versions
from .plans.pipeline import Services
from .sources import readers, sinks
from .streaming import microbatch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return readers.read_file(spark, {"file_path": f"{sf_dir}/{name}.parquet", "format": "parquet"})


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(col(n), places).alias(n) if t in ("double", "float") else col(n)) for n, t in df.dtypes])


# Nulls, which the tables lack, are put in alike on both sides.
HOLES = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END"
HOLEY = f"SELECT o_orderkey, {HOLES} AS price, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders"


def holey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{HOLES} AS price", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS status")


# --- sources ---------------------------------------------------------------


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 40")
def src_parquet_projection(spark, sf_dir):
    return readers.read_source(spark, "parquet", {"file_path": f"{sf_dir}/lineitem.parquet", "columns": ["l_orderkey", "l_quantity"]}).filter("l_quantity > 40")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def src_document_find(spark, sf_dir):
    return readers.document_find(table(spark, sf_dir, "customer"), {"filter": "c_nationkey = 3", "projection": ["c_custkey", "c_name"]})


@query("SELECT o_orderkey, o_totalprice, NULL AS extra FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL, 'x' FROM orders WHERE o_orderkey % 2 = 1")
def src_union_chunks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return readers.union_chunks([o.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice"), o.filter("o_orderkey % 2 = 1").select("o_orderkey", F.lit("x").alias("extra"))])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS is_valid FROM events")
def str_decode_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("value"))
    return microbatch.decode_json(e, "k bigint").select("event_id", "k", "is_valid")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def str_tumbling(spark, sf_dir):
    return rounded(microbatch.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], "value"), 4)


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def str_sessions(spark, sf_dir):
    return microbatch.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"])


# --- cleaning --------------------------------------------------------------


@query("SELECT DISTINCT event_type, user_id FROM events")
def cln_dedup_all(spark, sf_dir):
    return clean.deduplicate(table(spark, sf_dir, "events").select("event_type", "user_id"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def cln_dedup_subset(spark, sf_dir):
    return clean.deduplicate(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders")
def cln_drop_columns(spark, sf_dir):
    return clean.drop_columns(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), ["o_custkey", "absent"])


def _imputed(how: str, key: str = "CAST(o_orderkey AS DOUBLE)") -> str:
    return f"WITH h AS ({HOLEY}), m AS (SELECT status FROM h WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1), p AS ({how}) SELECT {key} AS o_orderkey, round(coalesce(price, (SELECT p FROM p)), 4) AS price, coalesce(status, (SELECT status FROM m)) AS status FROM h"


@query(_imputed("SELECT avg(price) AS p FROM h"))
def cln_impute_mean(spark, sf_dir):
    return rounded(clean.impute(holey(spark, sf_dir), "mean"), 4)


@query(_imputed("SELECT quantile_cont(price, 0.5) AS p FROM h"))
def cln_impute_median(spark, sf_dir):
    return rounded(clean.impute(holey(spark, sf_dir), "median"), 4)


@query(_imputed("SELECT price AS p FROM h WHERE price IS NOT NULL GROUP BY price ORDER BY count(*) DESC, price LIMIT 1", "o_orderkey"))
def cln_impute_mode(spark, sf_dir):
    return rounded(clean.impute(holey(spark, sf_dir), "mode"), 4)


@query(f"SELECT * FROM ({HOLEY}) WHERE price IS NOT NULL AND status IS NOT NULL")
def cln_drop_nulls(spark, sf_dir):
    return clean.impute(holey(spark, sf_dir), "drop")


BOUNDS = "b AS (SELECT q[1] - 1.5 * (q[2] - q[1]) AS lo, q[2] + 1.5 * (q[2] - q[1]) AS hi FROM (SELECT quantile_cont(l_extendedprice * l_discount, [0.25, 0.75]) AS q FROM lineitem))"


@query(f"WITH {BOUNDS} SELECT l_returnflag, round(greatest(least(l_extendedprice * l_discount, hi), lo), 4) AS x FROM lineitem, b")
def cln_iqr_clip(spark, sf_dir):
    return rounded(clean.treat_outliers(table(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "l_extendedprice * l_discount AS x"), "clip"), 4)


@query(f"WITH {BOUNDS} SELECT l_returnflag, round(l_extendedprice * l_discount, 4) AS x FROM lineitem, b WHERE l_extendedprice * l_discount BETWEEN lo AND hi")
def cln_iqr_remove(spark, sf_dir):
    return rounded(clean.treat_outliers(table(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "l_extendedprice * l_discount AS x"), "remove"), 4)


@query("SELECT l_orderkey, l_linenumber, coalesce(l_returnflag = 'A', false) AS l_returnflag_A, coalesce(l_returnflag = 'N', false) AS l_returnflag_N, coalesce(l_returnflag = 'R', false) AS l_returnflag_R FROM lineitem")
def cln_onehot(spark, sf_dir):
    return clean.one_hot(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag")


@query("WITH v AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS label FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)) SELECT c_custkey, label AS c_mktsegment FROM customer JOIN v ON s = c_mktsegment")
def cln_label(spark, sf_dir):
    return clean.label_encode(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS c_acctbal FROM customer")
def cln_minmax(spark, sf_dir):
    return rounded(clean.normalise(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")
def cln_zscore(spark, sf_dir):
    return rounded(clean.normalise(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), {"c_acctbal": "zscore"}))


@query(f"""
WITH h AS ({HOLEY}), d AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY price, status) = 1),
m AS (SELECT status FROM d WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1),
i AS (SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM d)) AS price, coalesce(status, (SELECT status FROM m)) AS status FROM d),
q AS (SELECT quantile_cont(price, [0.25, 0.75]) AS q, quantile_cont(o_orderkey, [0.25, 0.75]) AS k FROM i),
c AS (SELECT greatest(least(CAST(o_orderkey AS DOUBLE), k[2] + 1.5 * (k[2] - k[1])), k[1] - 1.5 * (k[2] - k[1])) AS o_orderkey,
      greatest(least(price, q[2] + 1.5 * (q[2] - q[1])), q[1] - 1.5 * (q[2] - q[1])) AS price, status FROM i, q),
v AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS label FROM (SELECT DISTINCT status AS s FROM c))
SELECT round(o_orderkey, 6) AS o_orderkey, round((price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()), 6) AS price, label AS status FROM c JOIN v ON s = status""")
def cln_pipeline(spark, sf_dir):
    return rounded(clean.clean(holey(spark, sf_dir), {"dedup_subset": ["o_orderkey"], "imputation_strategy": "median", "outlier_handling": "clip", "encoding": {"status": "label"}, "normalize": ["price"]}))


# --- profiling -------------------------------------------------------------

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _each(form: str, names: list[str], glue: str = " UNION ALL ") -> str:
    return glue.join(form.replace("$c", n) for n in names)


def _lines(spark, sf_dir, names=NUMERIC):
    return table(spark, sf_dir, "lineitem").select(*names)


@query(_each("SELECT '$c' AS \"column\", count($c) AS count, round(min($c), 4) AS min, round(max($c), 4) AS max, round(avg($c), 4) AS mean, round(stddev_samp($c), 4) AS std, round(quantile_cont($c, 0.25), 4) AS q1, round(quantile_cont($c, 0.5), 4) AS median, round(quantile_cont($c, 0.75), 4) AS q3 FROM lineitem", NUMERIC))
def prf_numeric(spark, sf_dir):
    return rounded(profile.numeric_profile(_lines(spark, sf_dir)), 4)


@query(_each("SELECT '$c' AS \"column\", count(DISTINCT $c) AS cardinality FROM orders", ["o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]))
def prf_cardinality(spark, sf_dir):
    return profile.cardinality(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"))


@query(f"WITH h AS ({HOLEY}) " + _each("SELECT '$c' AS \"column\", count($c) AS count, count(*) - count($c) AS missing, round((count(*) - count($c)) / count(*) * 100, 2) AS missing_pct FROM h", ["o_orderkey", "price", "status"]))
def prf_missing(spark, sf_dir):
    return profile.missing_values(holey(spark, sf_dir))


@query(_each("SELECT '$c' AS \"column\", count($c) AS count, CAST(min($c) AS VARCHAR) AS min, CAST(max($c) AS VARCHAR) AS max FROM lineitem", ["l_shipdate"]))
def prf_datetime(spark, sf_dir):
    return profile.datetime_profile(table(spark, sf_dir, "lineitem"))


@query("""
WITH c AS (SELECT 'p_type' AS "column", p_type AS value, count(*) AS count FROM part GROUP BY p_type UNION ALL SELECT 'p_name', p_name, count(*) FROM part GROUP BY p_name),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS place, sum(count) OVER (PARTITION BY "column") AS total FROM c)
SELECT "column", CAST(place AS INT) AS place, value, count, CAST(total - sum(count) OVER (PARTITION BY "column") AS BIGINT) AS other_count FROM r WHERE place <= 20""")
def prf_frequency(spark, sf_dir):
    return profile.frequencies(table(spark, sf_dir, "part").select("p_type", "p_name"))


def _histogram(names: list[str]) -> str:
    edges = " + ".join(f"CAST(x >= lo + (hi - lo) / 20 * {i} AS INT)" for i in range(1, 20))
    long = _each("SELECT '$c' AS \"column\", CAST($c AS DOUBLE) AS x FROM lineitem", names)
    return f"""WITH x AS ({long}), e AS (SELECT "column", min(x) AS lo, max(x) AS hi FROM x GROUP BY ALL),
    n AS (SELECT "column", {edges} AS bin, count(*) AS count FROM x JOIN e USING ("column") GROUP BY ALL),
    g AS (SELECT "column", lo, hi, CAST(unnest(range(20)) AS INT) AS bin FROM e)
    SELECT "column", bin, round(lo + (hi - lo) / 20 * bin, 6) AS low, round(CASE WHEN bin = 19 THEN hi ELSE lo + (hi - lo) / 20 * (bin + 1) END, 6) AS high, coalesce(count, 0) AS count FROM g LEFT JOIN n USING ("column", bin)"""


@query(_histogram(NUMERIC))
def prf_histogram(spark, sf_dir):
    return profile.histograms(_lines(spark, sf_dir))


@query(_each("""SELECT '$c' AS "column", 'ok' AS status, round(any_value(lo), 6) AS low, round(any_value(hi), 6) AS high, count(*) FILTER (x < lo OR x > hi) AS outliers, round(count(*) FILTER (x < lo OR x > hi) / count(*) * 100, 2) AS outlier_pct
FROM (SELECT CAST($c AS DOUBLE) AS x, q[1] - 1.5 * (q[2] - q[1]) AS lo, q[2] + 1.5 * (q[2] - q[1]) AS hi FROM lineitem, (SELECT quantile_cont($c, [0.25, 0.75]) AS q FROM lineitem))""", NUMERIC))
def prf_outliers(spark, sf_dir):
    return profile.outliers(_lines(spark, sf_dir))


@query("""SELECT 'c_custkey' AS "column", 'bigint' AS dtype, 'numeric' AS semantic_type, count(DISTINCT c_custkey) AS cardinality FROM customer
UNION ALL SELECT 'c_name', 'string', CASE WHEN count(DISTINCT c_name) / count(*) < 0.5 THEN 'categorical' ELSE 'text' END, count(DISTINCT c_name) FROM customer
UNION ALL SELECT 'c_mktsegment', 'string', CASE WHEN count(DISTINCT c_mktsegment) / count(*) < 0.5 THEN 'categorical' ELSE 'text' END, count(DISTINCT c_mktsegment) FROM customer""")
def prf_semantic_types(spark, sf_dir):
    return profile.semantic_types(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))


# --- features --------------------------------------------------------------


@query("SELECT p_partkey AS id, p_size, p_retailprice FROM part")
def trf_rename_drop(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_name")
    return features.transform(p, {"drop_cols": ["p_name"], "rename": {"p_partkey": "id"}})


@query("SELECT p_partkey, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice FROM part")
def trf_scale(spark, sf_dir):
    return rounded(features.transform(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), {"scale": {"p_size": "minmax", "p_retailprice": "zscore"}}))


@query("WITH v AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS label FROM (SELECT DISTINCT n_name AS s FROM nation)) SELECT n_nationkey, label AS n_name FROM nation JOIN v ON s = n_name")
def trf_label(spark, sf_dir):
    return features.transform(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), {"encode": {"n_name": "label"}})


@query("SELECT o_orderkey, " + ", ".join(f"o_orderstatus = '{v}' AS o_orderstatus_{v}" for v in "FOP") + " FROM orders")
def trf_onehot(spark, sf_dir):
    return features.transform(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), {"encode": {"o_orderstatus": "onehot"}})


@query("SELECT p_partkey, p_size, p_retailprice, round(p_size * p_retailprice, 4) AS p_size_x_p_retailprice FROM part")
def trf_interactions(spark, sf_dir):
    return rounded(features.transform(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), {"interactions": [["p_size", "p_retailprice"], ["p_size"]]}), 4)


@query('SELECT p_partkey, p_size, p_retailprice, CAST(p_size AS DOUBLE) * p_size AS "p_size^2", round(p_size * p_retailprice, 4) AS "p_size p_retailprice", round(p_retailprice * p_retailprice, 4) AS "p_retailprice^2" FROM part')
def trf_polynomial(spark, sf_dir):
    return rounded(features.transform(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), {"polynomial_cols": ["p_size", "p_retailprice"]}), 4)


# With two columns the components have a closed form; the larger part of each loading is positive.
@query("""WITH s AS (SELECT avg(p_size) AS mx, avg(p_retailprice) AS my, var_samp(p_size) AS a, var_samp(p_retailprice) AS d, covar_samp(p_size, p_retailprice) AS b FROM part),
e AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) ^ 2 + b * b) AS l FROM s), v AS (SELECT mx, my, b / sqrt(b * b + (l - a) ^ 2) AS vx, (l - a) / sqrt(b * b + (l - a) ^ 2) AS vy FROM e),
w AS (SELECT mx, my, vx, vy, CASE WHEN abs(vx) > abs(vy) THEN sign(vx) ELSE sign(vy) END AS s1, CASE WHEN abs(vy) > abs(vx) THEN -sign(vy) ELSE sign(vx) END AS s2 FROM v)
SELECT p_partkey, round(s1 * ((p_size - mx) * vx + (p_retailprice - my) * vy), 4) AS pca_1, round(s2 * (-(p_size - mx) * vy + (p_retailprice - my) * vx), 4) AS pca_2 FROM part, w""")
def trf_pca(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(features.transform(p, {"pca": {"cols": ["p_size", "p_retailprice"], "n_components": 2}}), 4)


# --- sampling --------------------------------------------------------------

DRAW = "md5('42|' || CAST($k AS VARCHAR))"


@query(f"SELECT c_custkey, c_acctbal FROM customer ORDER BY {DRAW.replace('$k', 'c_custkey')}, c_custkey LIMIT 100")
def smp_random(spark, sf_dir):
    return sample.random_sample(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), 100, ["c_custkey"])


@query(f"SELECT event_id FROM events ORDER BY {DRAW.replace('$k', 'event_id')}, event_id LIMIT 64")
def smp_reservoir(spark, sf_dir):
    return sample.reservoir_sample(table(spark, sf_dir, "events").select("event_id"), 64, ["event_id"])


@query(f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {DRAW.replace('$k', 'c_custkey')}, c_custkey) AS place, count(*) OVER (PARTITION BY c_mktsegment) AS size, count(*) OVER () AS total FROM customer)
SELECT c_custkey, c_mktsegment FROM s WHERE place <= least(size, greatest(1, round_even(150.0 * size / total, 0)))""")
def smp_stratified(spark, sf_dir):
    return sample.stratified_sample(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), 150, "c_mktsegment", ["c_custkey"])


@query("SELECT o_orderkey FROM orders QUALIFY (row_number() OVER (ORDER BY o_orderkey) - 1) % 50 = 0")
def smp_systematic(spark, sf_dir):
    return sample.systematic_sample(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], step=50)


@query(f"""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0
ORDER BY ln(-ln((CAST('0x' || substr({DRAW.replace('$k', 'o_orderkey')}, 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)) - ln(o_totalprice), o_orderkey LIMIT 200""")
def smp_importance(spark, sf_dir):
    return sample.importance_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 200, "o_totalprice", ["o_orderkey"])


@query("WITH b AS (SELECT 1.96 * 1.96 * 0.25 / (0.05 * 0.05) AS n0, count(*) AS n FROM orders) SELECT CAST(ceil(n0 / (1 + (n0 - 1) / n)) AS BIGINT) AS sample_size, round(ceil(n0 / (1 + (n0 - 1) / n)) / n, 4) AS sampling_ratio FROM b")
def smp_size(spark, sf_dir):
    found = sample.sample_size(table(spark, sf_dir, "orders").count())
    return spark.createDataFrame([(found["sample_size"], found["sampling_ratio"])], "sample_size bigint, sampling_ratio double")


SAMPLED = f"s AS (SELECT * FROM customer ORDER BY {DRAW.replace('$k', 'c_custkey')}, c_custkey LIMIT 100)"


@query(f"WITH {SAMPLED} SELECT 'c_acctbal' AS \"column\", round(abs((SELECT avg(c_acctbal) FROM customer) - (SELECT avg(c_acctbal) FROM s)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS drift, round(abs((SELECT avg(c_acctbal) FROM customer) - (SELECT avg(c_acctbal) FROM s)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) > 0.1 AS biased")
def smp_bias_numeric(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return sample.mean_drift(c.select("c_acctbal"), sample.random_sample(c, 100, ["c_custkey"]).select("c_acctbal"))


@query(f"""WITH {SAMPLED}, p AS (SELECT c_mktsegment AS v, count(*) / sum(count(*)) OVER () AS p FROM customer GROUP BY 1), q AS (SELECT c_mktsegment AS v, count(*) / sum(count(*)) OVER () AS q FROM s GROUP BY 1),
t AS (SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) AS tvd FROM p FULL JOIN q USING (v)) SELECT 'c_mktsegment' AS "column", tvd, tvd > 0.05 AS biased FROM t""")
def smp_bias_tvd(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return sample.category_distance(c, sample.random_sample(c, 100, ["c_custkey"]), ["c_mktsegment"])


# --- de-identification -----------------------------------------------------

# DuckDB's \\b knows ASCII letters only.  Each character beyond ASCII (letters, in these tables) is put
# between underscores, which are word characters that no pattern with \\b takes, and freed afterwards.
BEYOND = r"[\x{80}-\x{10FFFF}]"


def _marked(text: str) -> str:
    return f"regexp_replace({text}, '({BEYOND})', '_\\1_', 'g')"


def _freed(text: str) -> str:
    return f"regexp_replace({text}, '_({BEYOND})_', '\\1', 'g')"


def all_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _pattern(entity: str) -> str:
    return deidentify.PATTERNS[entity].replace("'", "''")


def _redacted(text: str) -> str:
    for entity in deidentify.PATTERNS:
        text = f"regexp_replace({text}, '{_pattern(entity)}', '[{entity}_REDACTED]', 'g')"
        text = _marked(text) if entity == "EMAIL" else text
    return _freed(text)


def _rewritten(entity: str, value: str) -> str:
    """Pieces between matches and the rewritten matches, put together in turn."""
    rx = _pattern(entity)
    text, back = ("text", str) if entity == "EMAIL" else (_marked("text"), _freed)
    whole = f"CASE WHEN regexp_matches(body, '{rx}') THEN array_to_string(list_transform(range(1, len(between) + 1), lambda i: between[i] || coalesce(list_transform(found, lambda v: {value})[i], '')), '') ELSE body END"
    return f"""SELECT doc_id, {back(whole)} AS text
    FROM (SELECT doc_id, {text} AS body, string_split_regex({text}, '{rx}') AS between, regexp_extract_all({text}, '{rx}') AS found FROM documents)"""


def _matches(entity: str, text: str) -> str:
    return f"regexp_matches({text if entity == 'EMAIL' else _marked(text)}, '{_pattern(entity)}')"


def _masked(spark, sf_dir, strategy: str, entities: list[str] | None = None):
    docs = all_docs(spark, sf_dir)
    return deidentify.mask_columns(docs, {"text": {"strategy": strategy, "entity_types": entities}}, "job").select("doc_id", "text")


@query(f"SELECT doc_id, {_redacted('text')} AS text FROM documents")
def dei_redact(spark, sf_dir):
    return _masked(spark, sf_dir, "redact")


@query(_rewritten("EMAIL", "'[HASH:' || substr(sha256(v), 1, 16) || ']'"))
def dei_hash(spark, sf_dir):
    return _masked(spark, sf_dir, "hash", ["EMAIL"])


def _pads() -> tuple[str, str]:
    key = deidentify.pseudonym_key("job").ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


@query(_rewritten("IP", f"'PSEUDO_' || upper(substr(sha256(unhex('{_pads()[1]}') || unhex(sha256(unhex('{_pads()[0]}') || encode(v)))), 1, 12))"))
def dei_pseudonymize(spark, sf_dir):
    return _masked(spark, sf_dir, "pseudonymize", ["IP"])


@query(_rewritten("EMAIL", "'***@' || split_part(v, '@', 2)"))
def dei_generalize(spark, sf_dir):
    return _masked(spark, sf_dir, "generalize", ["EMAIL"])


def _every(value: Callable[[str], str]) -> str:
    """All entities one after the other, each on what the one before left: ``value`` is the SQL for a match ``v``."""
    steps, last = [], "SELECT doc_id, text AS body FROM documents"
    for entity in deidentify.PATTERNS:
        rx = _pattern(entity)
        whole = f"CASE WHEN regexp_matches(body, '{rx}') THEN array_to_string(list_transform(range(1, len(between) + 1), lambda i: between[i] || coalesce(list_transform(found, lambda v: {value(entity)})[i], '')), '') ELSE body END"
        steps.append(f"{entity.lower()} AS (SELECT doc_id, {_marked(whole) if entity == 'EMAIL' else whole} AS body FROM (SELECT doc_id, body, string_split_regex(body, '{rx}') AS between, regexp_extract_all(body, '{rx}') AS found FROM ({last})))")
        last = f"SELECT * FROM {entity.lower()}"
    return f"WITH {', '.join(steps)} SELECT doc_id, {_freed('body')} AS text FROM ({last})"


@query(_every(lambda entity: "'[HASH:' || substr(sha256(v), 1, 16) || ']'"))
def dei_hash_every(spark, sf_dir):
    return _masked(spark, sf_dir, "hash")


@query(_every(lambda entity: f"'PSEUDO_' || upper(substr(sha256(unhex('{_pads()[1]}') || unhex(sha256(unhex('{_pads()[0]}') || encode(v)))), 1, 12))"))
def dei_pseudonymize_every(spark, sf_dir):
    return _masked(spark, sf_dir, "pseudonymize")


GENERAL = {
    "EMAIL": "'***@' || split_part(v, '@', 2)", "SSN": "'***-**-' || right(v, 4)", "PHONE": "'***-***-' || right(regexp_replace(v, '[^0-9]', '', 'g'), 4)",
    "IP": "split_part(v, '.', 1) || '.' || split_part(v, '.', 2) || '.*.*'", "CREDIT_CARD": "'****-****-****-' || right(regexp_replace(v, '[^0-9]', '', 'g'), 4)",
}


@query(_every(lambda entity: GENERAL.get(entity, "left(v, 2) || repeat('*', length(v) - 4) || right(v, 2)")))
def dei_generalize_every(spark, sf_dir):
    return _masked(spark, sf_dir, "generalize")


# Personal data are rarer in the table than the reporting bound, so some are put in alike on both sides.
PLANTED = "concat(coalesce(text, ''), CASE doc_id % 5 WHEN 0 THEN ' a.b@c.org' WHEN 1 THEN ' 123-45-6789' WHEN 2 THEN ' 10.0.0.1' WHEN 3 THEN ' (555) 123-4567' ELSE ' Anna Smith' END)"


@query(f"""WITH f AS (SELECT {PLANTED} AS note FROM documents ORDER BY doc_id LIMIT 200), r AS ({' UNION ALL '.join(f"SELECT 'note' AS c, '{e}' AS entity_type, avg(CAST({_matches(e, 'note')} AS INT)) AS rate FROM f" for e in deidentify.PATTERNS)})
SELECT c AS "column", entity_type, round(rate, 6) AS rate FROM r WHERE rate > 0.05""")
def dei_detect(spark, sf_dir):
    notes = all_docs(spark, sf_dir).select("doc_id", F.expr(PLANTED).alias("note"))
    return rounded(deidentify.detect_pii(notes, ["note"], ["doc_id"]))


@query(f"SELECT 'text' AS \"column\", 'redact' AS strategy, count(*) FILTER ({_matches('EMAIL', 'text')}) AS masked_values FROM documents")
def dei_audit(spark, sf_dir):
    columns = {"text": {"strategy": "redact", "entity_types": ["EMAIL"]}}
    return deidentify.audit(deidentify.mask_columns(all_docs(spark, sf_dir), columns, "job"), columns, "job", "t").select("column", "strategy", "masked_values")


@query("SELECT round(r, 4) AS risk_score, r > 0.3 AS above_threshold FROM (SELECT (least(count(DISTINCT c_mktsegment) / count(*), 1) * 0.5 + CASE WHEN count(DISTINCT c_name) / count(*) > 0.8 THEN 0.3 END) / 2 AS r FROM customer)")
def dei_risk(spark, sf_dir):
    return deidentify.reidentification_risk(table(spark, sf_dir, "customer"), ["c_mktsegment"])


# --- incremental loads -----------------------------------------------------

CUT = "1997-01-01T00:00:00+00:00"
STAGED = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 3 <> 0"
DELTA = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderkey % 10 = 0 AS is_deleted FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01'"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def _staged(spark, sf_dir):
    return _orders(spark, sf_dir).filter("o_orderkey % 3 <> 0").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


def _changes(spark, sf_dir):
    rows = _orders(spark, sf_dir).selectExpr("o_orderkey", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS o_custkey", "o_totalprice + 1 AS o_totalprice", "o_orderdate", "o_orderkey % 10 = 0 AS is_deleted")
    return incremental.delta(rows, "o_orderdate", CUT)


@query(f"SELECT * FROM ({DELTA})")
def cdc_delta_timestamp(spark, sf_dir):
    return _changes(spark, sf_dir)


@query("SELECT event_id, user_id FROM events WHERE event_id > 5000")
def cdc_delta_sequence(spark, sf_dir):
    return incremental.delta(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 5000, "sequence")


MERGE = """SELECT coalesce(d.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(d.o_custkey, s.o_custkey) AS o_custkey,
round(coalesce(d.o_totalprice, s.o_totalprice), 4) AS o_totalprice, coalesce(d.o_orderdate, s.o_orderdate) AS o_orderdate FROM s FULL JOIN d ON s.o_orderkey = d.o_orderkey"""


@query(f"WITH s AS ({STAGED}), d AS ({DELTA}) {MERGE}")
def cdc_upsert(spark, sf_dir):
    return rounded(incremental.upsert(_staged(spark, sf_dir), _changes(spark, sf_dir).drop("is_deleted"), ["o_orderkey"]), 4)


@query(f"WITH a AS ({DELTA}), s AS (SELECT * FROM ({STAGED}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a WHERE is_deleted)), d AS (SELECT * FROM a WHERE NOT is_deleted) {MERGE}")
def cdc_soft_delete(spark, sf_dir):
    config = {"cdc_mode": "soft_delete", "watermark_column": "o_orderdate", "primary_key": "o_orderkey"}
    source = _orders(spark, sf_dir).selectExpr("o_orderkey", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS o_custkey", "o_totalprice + 1 AS o_totalprice", "o_orderdate", "o_orderkey % 10 = 0 AS is_deleted")
    return rounded(incremental.load_delta(source, _staged(spark, sf_dir), config, CUT).dataframe.drop("is_deleted"), 4)


@query(f"SELECT * FROM ({STAGED}) UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM ({DELTA})")
def cdc_append_no_key(spark, sf_dir):
    return incremental.load_delta(_changes(spark, sf_dir).drop("is_deleted"), _staged(spark, sf_dir), {"watermark_column": "o_orderdate", "primary_key": "absent"}, CUT).dataframe


@query(f"SELECT * FROM ({DELTA}) WHERE NOT is_deleted")
def cdc_first_load(spark, sf_dir):
    return incremental.load_delta(_changes(spark, sf_dir), None, {"cdc_mode": "soft_delete", "watermark_column": "o_orderdate", "primary_key": "o_orderkey"}).dataframe


@query("SELECT strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S.%fZ') AS watermark FROM orders")
def cdc_watermark(spark, sf_dir):
    return incremental.new_watermark(_orders(spark, sf_dir), "o_orderdate")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '!' || text ELSE text END AS text FROM conversations")
def cdc_composite_key(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return incremental.upsert(c, c.filter("turn % 2 = 0").withColumn("text", F.concat(F.lit("!"), F.col("text"))), ["conv_id", "turn"])


# --- quality ---------------------------------------------------------------


def _gate_rows(spark, outcome):
    rows = [(r["expectation_type"], r["success"], outcome.quality_score, outcome.passed) for r in outcome.results]
    return spark.createDataFrame(rows, "expectation_type string, success boolean, quality_score double, passed boolean")


@query("SELECT 'expect_table_row_count_to_be_between' AS expectation_type, count(*) >= 1 AS success, 1.0::DOUBLE AS quality_score, true AS passed FROM nation UNION ALL SELECT 'expect_column_to_exist', true, 1.0, true FROM range(3)")
def gat_default_suite(spark, sf_dir):
    return _gate_rows(spark, gate.validate(table(spark, sf_dir, "nation")))


SUITE = {
    "expectations": [
        {"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "l_quantity", "min_value": 1, "max_value": 50}},
        {"expectation_type": "expect_column_values_to_be_in_set", "kwargs": {"column": "l_returnflag", "value_set": ["A", "N"], "mostly": 0.6}},
        {"expectation_type": "expect_column_mean_to_be_between", "kwargs": {"column": "l_discount", "min_value": 0.2}},
        {"expectation_type": "expect_column_values_to_match_regex", "kwargs": {"column": "l_linestatus", "regex": "^[OF]$"}},
    ]
}


@query("""WITH r AS (SELECT min(l_quantity) >= 1 AND max(l_quantity) <= 50 AS a, avg(CAST(l_returnflag IN ('A', 'N') AS INT)) >= 0.6 AS b, avg(l_discount) >= 0.2 AS c, bool_and(regexp_matches(l_linestatus, '^[OF]$')) AS d FROM lineitem),
s AS (SELECT *, round((a::INT + b::INT + c::INT + d::INT) / 4, 4) AS score FROM r)
SELECT unnest(['expect_column_values_to_be_between', 'expect_column_values_to_be_in_set', 'expect_column_mean_to_be_between', 'expect_column_values_to_match_regex']) AS expectation_type, unnest([a, b, c, d]) AS success, score AS quality_score, score >= 0.8 AS passed FROM s""")
def gat_custom_suite(spark, sf_dir):
    return _gate_rows(spark, gate.validate(table(spark, sf_dir, "lineitem"), SUITE))


@query("SELECT 'table_not_empty' AS check_name, count(*) > 0 AS success FROM region UNION ALL SELECT 'r_regionkey_not_all_null', count(r_regionkey) > 0 FROM region UNION ALL SELECT 'r_name_not_all_null', count(r_name) > 0 FROM region")
def gat_fallback(spark, sf_dir):
    return gate.basic_checks(table(spark, sf_dir, "region"))


RULES = [
    {"dimension": "completeness", "column": "price", "threshold": 0.9},
    {"dimension": "completeness", "threshold": 0.5, "operator": "gt"},
    {"dimension": "uniqueness", "column": "status", "threshold": 0.1, "operator": "lt"},
    {"dimension": "accuracy", "column": "status", "threshold": 0.7, "operator": "between", "upper_threshold": 0.85},
    {"dimension": "consistency", "column": "status", "threshold": 0.8, "operator": "lte"},
]


@query(f"""WITH h AS ({HOLEY}), m AS (SELECT count(price) / count(*) AS a, avg(CAST(price IS NOT NULL AND status IS NOT NULL AS INT)) AS b, count(DISTINCT status) / count(*) AS c, avg(CAST(coalesce(trim(status) <> '', false) AS INT)) AS d, count(status) / count(*) AS e FROM h)
SELECT unnest(['completeness_price', 'completeness__row', 'uniqueness_status', 'accuracy_status', 'consistency_status']) AS rule, round(unnest([a, b, c, d, e]), 6) AS metric, unnest([a >= 0.9, b > 0.5, c < 0.1, d BETWEEN 0.7 AND 0.85, e <= 0.8]) AS passed FROM m""")
def mon_rules(spark, sf_dir):
    return monitor.evaluate(holey(spark, sf_dir), RULES).select("rule", "metric", "passed")


@query("SELECT count(DISTINCT (event_type, user_id)) / count(*) AS metric FROM events")
def mon_uniqueness_row(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "user_id")
    return e.agg(monitor.metric(e, "uniqueness").alias("metric"))


@query("SELECT avg(CAST(ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 24 HOURS AS INT)) AS metric FROM events")
def mon_timeliness(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.agg(monitor.metric(e, "timeliness", "ts", "2024-01-15 00:00:00").alias("metric"))


# Values have cents: rounding their sum there makes it the same in whatever order it was made.  Means are
# rounded further right than any of them can end in a 5.
DAILY = "SELECT event_type AS key, CAST(epoch(date_trunc('day', ts)) // 86400 AS BIGINT) AS seq, round(sum(value), 2) / count(value) AS value FROM events GROUP BY ALL"


def _daily(spark, sf_dir):
    day = F.unix_date(F.to_date("ts")).cast("bigint")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key"), day.alias("seq")).agg((F.round(F.sum("value"), 2) / F.count("value")).alias("value"))


@query(f"""WITH h AS ({DAILY}), z AS (SELECT *, CASE WHEN count(value) OVER w >= 4 AND stddev_samp(value) OVER w >= 1e-10 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w END AS z FROM h WINDOW w AS (PARTITION BY key ORDER BY seq ROWS BETWEEN 99 PRECEDING AND 1 PRECEDING))
SELECT key, seq, round(value, 8) AS value, round(z, 8) AS z_score, coalesce(abs(z) > 3, false) AS is_anomaly FROM z""")
def mon_anomaly(spark, sf_dir):
    return rounded(monitor.anomalies(_daily(spark, sf_dir)), 8)


@query(f"""WITH h AS ({DAILY}), r AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) <= 30),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS place, count(*) OVER (PARTITION BY key) AS n FROM r),
t AS (SELECT key, max(n) AS n, max_by(value, place) AS latest, avg(value) AS mean, stddev_samp(value) AS std, avg(value) FILTER (place <= greatest(1, n // 3)) AS a, avg(value) FILTER (place > n - greatest(1, n // 3)) AS b FROM p WHERE n >= 2 GROUP BY key)
SELECT key, n, round(latest, 8) AS latest, round(mean, 8) AS mean, round(std, 8) AS std, CASE WHEN b - a > 0.2 * std THEN 'improving' WHEN b - a < -0.2 * std THEN 'degrading' ELSE 'stable' END AS trend FROM t""")
def mon_trend(spark, sf_dir):
    return rounded(monitor.trends(_daily(spark, sf_dir)), 8)


# --- lineage, schedules, dashboard ----------------------------------------

# A graph from the tables: customers come from nations, nations from regions.
GRAPH = "SELECT DISTINCT 'nation/' || n_nationkey AS source, 'customer/' || c_custkey AS target FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT DISTINCT 'region/' || n_regionkey, 'nation/' || n_nationkey FROM nation"


def _edges(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    up = c.select(F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("s"), F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("t"))
    both = up.unionByName(n.select(F.concat(F.lit("region/"), F.col("n_regionkey").cast("string")).alias("s"), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("t")))
    return both.select(F.md5("t").alias("edge_id"), F.lit("load").alias("step_name"), F.array("s").alias("input_uris"), F.col("t").alias("output_uri"), F.create_map(F.lit("name"), F.array(F.lit("label"))).alias("field_mappings"), F.lit("t").alias("tenant_id"))


@query(f"WITH g AS ({GRAPH}) SELECT 'nation/' || n AS uri, 1 AS depth FROM (SELECT c_nationkey AS n FROM customer WHERE c_custkey = 1) UNION ALL SELECT source, 2 FROM g WHERE target = (SELECT source FROM g WHERE target = 'customer/1')")
def lin_upstream(spark, sf_dir):
    return lineage.upstream(_edges(spark, sf_dir), "customer/1", max_depth=4)


@query(f"WITH RECURSIVE g AS ({GRAPH}), r AS (SELECT target AS uri, 1 AS depth FROM g WHERE source = 'region/1' UNION SELECT target, depth + 1 FROM r JOIN g ON source = uri) SELECT uri, depth FROM r")
def lin_downstream(spark, sf_dir):
    return lineage.downstream(_edges(spark, sf_dir), "region/1", max_depth=4)


@query(f"WITH g AS ({GRAPH}) SELECT source AS uri, 'label' AS field, 1 AS depth FROM g WHERE target = 'customer/1'")
def lin_trace_field(spark, sf_dir):
    return lineage.trace_field(_edges(spark, sf_dir), "customer/1", "name", max_depth=4)


@query(f"WITH RECURSIVE g AS ({GRAPH}), r AS (SELECT target AS uri, 1 AS depth FROM g WHERE source = 'region/2' UNION SELECT target, depth + 1 FROM r JOIN g ON source = uri) SELECT uri, depth, 'name' AS fields FROM r")
def lin_impact(spark, sf_dir):
    return lineage.impact(_edges(spark, sf_dir), "region/2", max_depth=4).withColumn("fields", F.array_join("fields", ","))


@query(f"WITH g AS ({GRAPH}) SELECT source, target FROM g")
def lin_export(spark, sf_dir):
    return lineage.export_graph(_edges(spark, sf_dir), "t")["edges"].select("source", "target")


@query("""SELECT count(*) AS jobs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, CAST(sum(o_orderkey) AS BIGINT) AS rows
FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'completed' END AS status FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 10)""")
def dsh_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"), F.col("o_orderdate").cast("string").alias("created_at"), F.lit(0.9).alias("quality_score"), F.col("o_orderkey").alias("row_count"), F.lit("{}").alias("source_config"))
    return jobs.dashboard(o).select("jobs", "completed", "failed", "rows")


@query("SELECT n_name AS pipeline_id, strftime(CASE WHEN n_nationkey + n_regionkey = 0 THEN TIMESTAMP '2024-02-28' ELSE TIMESTAMP '2024-02-27' + INTERVAL 1 HOUR * n_regionkey + INTERVAL 1 MINUTE * n_nationkey END, '%Y-%m-%d %H:%M') AS run_at FROM nation")
def sch_next_runs(spark, sf_dir):
    """One schedule a nation: every day, at its region's hour and its own minute."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("pipeline_id"), F.format_string("%s %s * * *", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")).alias("cron"))
    return schedule.upcoming(n, datetime(2024, 2, 27)).select("pipeline_id", F.date_format("run_at", "yyyy-MM-dd HH:mm").alias("run_at"))


# --- written and read back: formats, services, streams ----------------------


def _place(spark, name: str) -> str:
    return shared_path(spark, name)


PRICED = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"
PRICED_SCHEMA = "o_orderkey bigint, o_orderstatus string, o_totalprice double"


def _priced(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(PRICED)
def src_csv_auto(spark, sf_dir):
    path = sinks.write_format(_priced(spark, sf_dir), _place(spark, "orders") + ".csv", "csv")
    return readers.read_source(spark, "file", {"file_path": path, "schema": PRICED_SCHEMA})


@query(PRICED)
def src_csv_delimiter(spark, sf_dir):
    path = sinks.write_format(_priced(spark, sf_dir), _place(spark, "orders"), "csv", sep="|")
    return readers.read_source(spark, "csv", {"file_path": path, "format": "csv", "delimiter": "|", "schema": PRICED_SCHEMA})


@query(PRICED)
def src_object_prefix(spark, sf_dir):
    folder = _place(spark, "bucket")
    scheme, _, bucket = folder.rpartition("://")
    o = _priced(spark, sf_dir)
    for i in range(2):
        sinks.write_parquet(o.filter(f"o_orderkey % 2 = {i}"), f"{folder}/in/part{i}.parquet")
    return readers.read_source(spark, "object_store", {"scheme": scheme or "file", "bucket": bucket.removeprefix("file:"), "prefix": "in/part"})


@query(PRICED)
def snk_staging(spark, sf_dir):
    return spark.read.parquet(sinks.write_parquet(_priced(spark, sf_dir), sinks.staging_uri(_place(spark, "root"), "t", "j"), "zstd"))


@query(PRICED)
def snk_arrow(spark, sf_dir):
    return sinks.read_arrow(spark, sinks.write_arrow(_priced(spark, sf_dir), _place(spark, "arrow")), PRICED_SCHEMA)


@query(PRICED)
def snk_convert(spark, sf_dir):
    folder = _place(spark, "converted")
    sinks.write_format(_priced(spark, sf_dir), f"{folder}/a", "orc")
    sinks.convert_format(spark, f"{folder}/a", "orc", f"{folder}/b", "json")
    return readers.read_source(spark, "json", {"file_path": f"{folder}/b", "format": "json", "schema": PRICED_SCHEMA})


@query("SELECT event_type, CAST(event_id AS BIGINT) AS n FROM events")
def snk_events(spark, sf_dir):
    """Every row of ``events`` as an event of a log, and one more beside them."""
    path = _place(spark, "events")
    e = table(spark, sf_dir, "events")
    sinks.append_events(e.select("event_type", F.to_json(F.struct(F.col("event_id").alias("n"))).alias("payload")), path)
    sinks.append_event(spark, path, "log.written", {"n": -1})
    return spark.read.parquet(path).filter("event_type <> 'log.written'").select("event_type", F.get_json_object("payload", "$.n").cast("bigint").alias("n"))


@query("SELECT count(*) AS rows, 6 AS columns FROM orders")
def prf_size(spark, sf_dir):
    return profile.row_count(table(spark, sf_dir, "orders"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) = 1")
def dsh_newest_records(spark, sf_dir):
    """Of lines that share an order's last number, the first of the table stays, as in the SQL where one thread runs it."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.struct("_metadata.file_path", "_metadata.row_index").alias("first"))
    return jobs.current(lines, ["l_orderkey"], "l_linenumber", [F.col("first")]).drop("first")


@query(f"""WITH h AS ({HOLEY}) SELECT 'completeness_price' AS rule, round(count(price) / count(*), 6) AS metric, CAST(0.9 AS DOUBLE) AS threshold FROM h
UNION ALL SELECT 'spelling_price', CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)""")
def mon_alerts(spark, sf_dir):
    rules = [{"column": "price", "threshold": 0.9}, {"column": "status", "threshold": 0.5}, {"dimension": "spelling", "column": "price"}, {"name": "quiet", "column": "price", "alert_on_failure": False}]
    uri = sinks.write_parquet(holey(spark, sf_dir), _place(spark, "holey"))
    services = Services(spark, _place(spark, "root"), "t")
    services.check_quality(uri, rules)
    return services.alerts().select("rule", "metric", "threshold")


@query(f"WITH h AS ({HOLEY}) SELECT 't__completeness__price' AS key, round(count(price) / count(*), 6) AS value FROM h UNION ALL SELECT 't__completeness__status', round(count(status) / count(*), 6) FROM h")
def mon_history(spark, sf_dir):
    uri = sinks.write_parquet(holey(spark, sf_dir), _place(spark, "holey"))
    services = Services(spark, _place(spark, "root"), "t")
    services.check_quality(uri, [{"column": "price"}, {"column": "status"}])
    return services.metric_history().select("key", "value")


@query("SELECT c_custkey, c_nationkey AS nation, (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS c_acctbal FROM customer")
def svc_orchestrate(spark, sf_dir):
    c = sinks.write_parquet(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), _place(spark, "customer"))
    config = {"input_uri": c, "skip_profile": True, "cleaning": {"drop_cols": ["c_name"], "normalize": ["c_acctbal"]}, "transform": {"rename": {"c_nationkey": "nation"}}, "suite": {}}
    return spark.read.parquet(Services(spark, _place(spark, "root"), "t").orchestrate(config).output_uri)


@query("SELECT count(*) AS row_count, true AS same_rows_same_name, true AS other_rows_other_name FROM customer")
def ver_commit(spark, sf_dir):
    """A version's name comes from its rows: the same in another order and layout, another after one value changes."""
    root, customer = _place(spark, "root"), table(spark, sf_dir, "customer")
    first = sinks.write_parquet(customer, f"{root}/customer")
    again = sinks.write_parquet(customer.select(*reversed(customer.columns)).orderBy("c_acctbal").repartition(3), f"{root}/again")
    other = sinks.write_parquet(customer.withColumn("c_acctbal", F.when(F.col("c_custkey") == 1, 0.125).otherwise(F.col("c_acctbal"))), f"{root}/other")
    names = [versions.commit_version(spark, root, uri, {"by": "query"}, "t") for uri in (first, again, other)]
    found = versions.get_version(spark, root, names[0], "t")
    return spark.createDataFrame([(found["row_count"], names[0] == names[1], names[0] != names[2])], "row_count bigint, same_rows_same_name boolean, other_rows_other_name boolean")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderstatus AS status FROM orders WHERE o_custkey % 10 = 3 ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, CAST(o_orderkey AS VARCHAR) LIMIT 20")
def sch_run_history(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.lit("t").alias("tenant_id"), (F.col("o_custkey") % 10).cast("string").alias("pipeline_id"), F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"))
    return schedule.run_history(o, "3", "t").select("run_id", "status")


@query(f"WITH g AS ({GRAPH}), near AS (SELECT target AS uri FROM g WHERE source = 'nation/3' UNION SELECT source FROM g WHERE target = 'nation/3' UNION SELECT 'nation/3') SELECT source, target FROM g WHERE source IN (SELECT uri FROM near) AND target IN (SELECT uri FROM near)")
def lin_dataset(spark, sf_dir):
    return lineage.dataset_lineage(_edges(spark, sf_dir), "nation/3", "t")["graph"].select("source", "target")


@query("SELECT event_id, event_type, value FROM events")
def str_stage(spark, sf_dir):
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", "event_type", "value")
    root = _place(spark, "stream")
    microbatch.stage_stream(stream, f"{root}/out", f"{root}/mark", timeout_seconds=300)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("SELECT event_id, event_type FROM events ORDER BY md5('42|' || event_id), event_id LIMIT 100")
def str_reservoir(spark, sf_dir):
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", "event_type")
    root = _place(spark, "reservoir")
    return spark.read.schema(stream.schema).parquet(f"{root}/out/v{microbatch.stream_reservoir(stream, 100, ['event_id'], f'{root}/out', f'{root}/mark')}")


# --- flagship --------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean ``lineitem`` (holes put in), then profile it."""
    lines = table(spark, sf_dir, "lineitem").withColumn("l_tax", F.when(F.col("l_linenumber") == 3, None).otherwise(F.col("l_tax")))
    cleaned = clean.clean(lines.select("l_orderkey", "l_linenumber", *NUMERIC), {"imputation_strategy": "median", "outlier_handling": "clip"})
    return rounded(profile.numeric_profile(cleaned.select(*NUMERIC)), 4)
