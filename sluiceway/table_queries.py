"""Queries over versioned tables, logs, streams, planned reads and records, registered beside the others."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .operators import clean, deidentify, gate, incremental, profile, reach, sample, sketch_profile
from .plans import jobs, version_store
from .plans.keyed_files import KeyedFiles
from .plans.pipeline import Services
from .queries import CUT, DELTA, HOLEY, MERGE, PRICED, STAGED, _changes, _orders, _place, _priced, _staged, holey, query, rounded, table
from .sources import ordered_log, readers, sinks
from .streaming import newest

# --- incremental loads ---------------------------------------------------------


def _merged(spark, sf_dir):
    files = KeyedFiles(spark, _place(spark, "orders-table"))
    files.create(_staged(spark, sf_dir), ["o_orderkey"])
    return files, files.merge(_changes(spark, sf_dir), F.col("is_deleted"))


@query(f"WITH a AS ({DELTA}), s AS (SELECT * FROM ({STAGED}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a WHERE is_deleted)), d AS (SELECT * FROM a WHERE NOT is_deleted) {MERGE}")
def cdc_merge_files(spark, sf_dir):
    return rounded(_merged(spark, sf_dir)[0].read().drop("is_deleted"), 4)


@query(f"""WITH a AS ({DELTA}), s AS ({STAGED})
SELECT count(*) FILTER (NOT is_deleted AND s.o_orderkey IS NULL) AS inserted_rows, count(*) FILTER (NOT is_deleted AND s.o_orderkey IS NOT NULL) AS updated_rows, count(*) FILTER (is_deleted AND s.o_orderkey IS NOT NULL) AS deleted_rows
FROM a LEFT JOIN s ON s.o_orderkey = a.o_orderkey""")
def cdc_merge_counts(spark, sf_dir):
    done = _merged(spark, sf_dir)[1]
    return spark.createDataFrame([(done.inserted_rows, done.updated_rows, done.deleted_rows)], "inserted_rows bigint, updated_rows bigint, deleted_rows bigint")


@query(f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM ({STAGED})")
def cdc_merge_earlier_version(spark, sf_dir):
    return _merged(spark, sf_dir)[0].read(0)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' - INTERVAL 30 DAYS")
def cdc_late_rows(spark, sf_dir):
    return incremental.delta(_orders(spark, sf_dir).select("o_orderkey", "o_orderdate"), "o_orderdate", CUT, lateness="30 days")


@query("SELECT o_custkey, o_orderdate, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def cdc_duplicate_keys(spark, sf_dir):
    return incremental.latest(_orders(spark, sf_dir).select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], "o_orderdate")


@query("SELECT count(*) AS inserted_rows, '1970-01-01T00:00:00+00:00' AS watermark FROM orders")
def cdc_missing_watermark(spark, sf_dir):
    load = incremental.load_delta(_orders(spark, sf_dir), None, {"watermark_column": "absent", "primary_key": "o_orderkey"}, CUT)
    return spark.createDataFrame([(load.inserted_rows, load.watermark)], "inserted_rows bigint, watermark string")


# --- logs and streams ------------------------------------------------------------


def _event_log(spark, sf_dir, parts: int = 1):
    """The path of a log of all events, appended in so many steps."""
    path, events = _place(spark, "events-log"), table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    for i in range(parts):
        ordered_log.append_log(events.filter(F.pmod(F.col("event_id"), F.lit(parts)) == i), path, ["event_id"])
    return path


@query("SELECT event_id, event_type, value FROM events")
def str_log(spark, sf_dir):
    rows = ordered_log.read_log(spark, _event_log(spark, sf_dir))
    return rows.select(F.from_json("value", "event_id bigint, event_type string, value double").alias("r")).select("r.*")


@query("""WITH e AS (SELECT count(*) FILTER (event_id % 2 = 0) AS a, count(*) FILTER (event_id % 2 = 1) AS b FROM events)
SELECT unnest(['earliest', 'latest', 'resumed']) AS reader, unnest([a + b, b, a + b]) AS n, unnest([0, a, 0]) AS first, unnest([a + b - 1, a + b - 1, a + b - 1]) AS last FROM e""")
def str_log_readers(spark, sf_dir):
    """Three readers: one from the start, one from the end there was before half of the log came, one that stopped in between."""
    root, path = _place(spark, "readers"), _place(spark, "events-log")
    events = table(spark, sf_dir, "events").select("event_id", "event_type")

    def read(name: str, **options) -> None:
        mark = f"{root}/{name}/mark"
        stream = ordered_log.stream_log(spark, path, mark, **options)
        ordered_log.drain(stream, mark, lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/{name}/out/batch={n}"))

    ordered_log.append_log(events.filter("event_id % 2 = 0"), path, ["event_id"])
    half = max(1, ordered_log.log_end(spark, path) // 2 + 1)
    read("resumed", max_rows=half)
    read("latest", starting="latest")
    ordered_log.append_log(events.filter("event_id % 2 = 1"), path, ["event_id"])
    for name, options in (("earliest", {}), ("latest", {"starting": "latest"}), ("resumed", {"max_rows": half})):
        read(name, **options)
    seen = [spark.read.schema("offset bigint").parquet(f"{root}/{n}/out/batch=*").withColumn("reader", F.lit(n)) for n in ("earliest", "latest", "resumed")]
    return readers.union_chunks(seen).groupBy("reader").agg(F.count("*").alias("n"), F.min("offset").alias("first"), F.max("offset").alias("last"))


@query("""WITH last AS (SELECT user_id, event_type, max(ts) AS ts, max_by(event_id, ts) AS event_id, max_by(value, ts) AS value FROM events GROUP BY ALL)
SELECT user_id, event_type, event_id, value FROM last WHERE epoch_ms(ts) + 3 * 86400000 > (SELECT epoch_ms(max(ts)) FROM events) - 3600000""")
def str_newest(spark, sf_dir):
    """The newest event of a user and type over a stream of the log, given up three days after it."""
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    path, out, mark = _event_log(spark, sf_dir), _place(spark, "newest"), _place(spark, "mark")
    # Events have no zone; they are read as times of the session's.
    stream = ordered_log.stream_log(spark, path, mark).select("offset", F.from_json("value", schema.replace("timestamp", "timestamp_ntz"), ordered_log.JSON_TIMES).alias("r")).select("offset", "r.*")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    newest.keep_newest(stream, out, mark, ["user_id", "event_type"], "ts", "offset", "1 hour", "3 days")
    return newest.newest_rows(spark, out, "offset bigint, " + schema, ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "value")


# --- sources and sinks -------------------------------------------------------------


@query(PRICED)
def src_object_key(spark, sf_dir):
    folder = _place(spark, "bucket")
    scheme, _, bucket = folder.rpartition("://")
    sinks.write_parquet(_priced(spark, sf_dir), f"{folder}/in/one.parquet")
    return readers.read_source(spark, "object_store", {"scheme": scheme or "file", "bucket": bucket.removeprefix("file:"), "key": "in/one.parquet"})


@query(PRICED)
def src_jdbc_split(spark, sf_dir):
    """Through an embedded database, which lives in one process: only local sessions can share it."""
    spark._jvm.System.setProperty("derby.stream.error.file", "/dev/null")
    url, driver = f"jdbc:derby:memory:{_place(spark, 'db').rsplit('/', 1)[-1]};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    _priced(spark, sf_dir).write.format("jdbc").options(url=url, dbtable="orders", driver=driver, numPartitions="4").save()
    config = {"connection_string": url, "driver": driver, "schema": "", "table": "orders", "partition_column": "o_totalprice", "num_partitions": 6}
    return readers.read_source(spark, "jdbc", config)


# --- versions -----------------------------------------------------------------------


def _accounts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    more = c.filter("c_custkey % 100 = 1").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    changed = c.filter("c_custkey % 13 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return c, changed.unionByName(more)


@query("""SELECT c_custkey, 'removed' AS change FROM customer WHERE c_custkey % 13 = 0 UNION ALL SELECT c_custkey + 1000000, 'added' FROM customer WHERE c_custkey % 100 = 1
UNION ALL SELECT c_custkey, 'changed' FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 10 = 0""")
def ver_diff(spark, sf_dir):
    store, (old, new) = version_store.VersionStore(spark, _place(spark, "versions"), "t"), _accounts(spark, sf_dir)
    a, b = store.commit(old, ["c_custkey"]), store.commit(new, ["c_custkey"])
    return store.diff(a, b).select(F.coalesce("old.c_custkey", "new.c_custkey").alias("c_custkey"), "change")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def ver_restore(spark, sf_dir):
    store, (old, new) = version_store.VersionStore(spark, _place(spark, "versions"), "t"), _accounts(spark, sf_dir)
    first = store.commit(old, ["c_custkey"])
    store.commit(new, ["c_custkey"])
    return store.restore(first)


@query("""SELECT 1 AS place, count(*) AS row_count, count(*) > 0 AS stored, true AS first_name FROM customer
UNION ALL SELECT 2, count(*) FILTER (c_custkey % 13 <> 0) + count(*) FILTER (c_custkey % 100 = 1), count(*) > 0, false FROM customer UNION ALL SELECT 3, count(*), false, true FROM customer""")
def ver_list(spark, sf_dir):
    """Three commits, the third equal to the first in another order: the same name, and nothing stored again."""
    store, (old, new) = version_store.VersionStore(spark, _place(spark, "versions"), "t"), _accounts(spark, sf_dir)
    first = store.commit(old, ["c_custkey"])
    store.commit(new, ["c_custkey"])
    store.commit(old.orderBy(F.desc("c_name")), ["c_custkey"])
    place = F.row_number().over(jobs.Window.orderBy("committed_at"))
    return store.list().select(place.alias("place"), "row_count", (F.col("stored_rows") > 0).alias("stored"), (F.col("version") == first).alias("first_name"))


# --- lineage, records, services --------------------------------------------------------


@query("""SELECT 'c_custkey' AS field, 'c_custkey' AS input FROM range(1) UNION ALL SELECT 'name', 'c_name' UNION ALL SELECT 'c_acctbal', 'c_acctbal' UNION ALL SELECT 'c_mktsegment', 'c_mktsegment'
UNION ALL SELECT 'c_custkey_x_c_acctbal', unnest(['c_acctbal', 'c_custkey'])""")
def lin_field_mappings(spark, sf_dir):
    """What the pipeline records of a run over ``customer``: every output field with the fields it comes from."""
    c = sinks.write_parquet(table(spark, sf_dir, "customer"), _place(spark, "customer"))
    services = Services(spark, _place(spark, "root"), "t")
    cleaning = {"drop_cols": ["c_nationkey"], "normalize": ["c_acctbal"], "encoding": {"c_mktsegment": "label"}, "imputation_strategy": "mode"}
    services.orchestrate({"input_uri": c, "skip_profile": True, "cleaning": cleaning, "transform": {"rename": {"c_name": "name"}, "interactions": [["c_custkey", "c_acctbal"]]}})
    return services.edges().select(F.explode("field_mappings").alias("field", "inputs")).select("field", F.explode("inputs").alias("input"))


# A chain of all line items in order, with two steps aside and one back: as deep as the table is long.
CHAIN = """SELECT 'l' || n AS source, 'l' || (n + 1) AS target FROM lines WHERE n + 1 < total UNION ALL SELECT 'l' || n, 'side' || n FROM lines WHERE n % 50 = 0
UNION ALL SELECT 'l' || n, 'l' || (n - 20) FROM lines WHERE n % 97 = 0 AND n >= 20 UNION ALL SELECT 'side' || n, 'l' || (n // 2) FROM lines WHERE n % 150 = 0"""
LINES = "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS n, count(*) OVER () AS total FROM lineitem"


def _chain(spark, sf_dir):
    lines = sample.with_row_id(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], "n")
    name = lambda prefix, n: F.concat(F.lit(prefix), n.cast("bigint").cast("string"))
    n, total = F.col("n"), lines.count()
    edge = lambda rows, a, b: rows.select(a.alias("source"), b.alias("target"))
    ways = [edge(lines.filter(n + 1 < total), name("l", n), name("l", n + 1)), edge(lines.filter(n % 50 == 0), name("l", n), name("side", n)), edge(lines.filter((n % 97 == 0) & (n >= 20)), name("l", n), name("l", n - 20)), edge(lines.filter(n % 150 == 0), name("side", n), name("l", F.floor(n / 2)))]
    return readers.union_chunks(ways), total


@query(f"""WITH RECURSIVE lines AS ({LINES}), t AS (SELECT max(total) AS total FROM lines),
-- All behind the earliest line that can be reached is reached; a step back or aside may lead to an earlier one.
earliest AS (SELECT total // 2 AS x FROM t UNION
  SELECT least(x, CASE WHEN b < total AND b >= 20 THEN b - 20 ELSE x END, CASE WHEN c < total THEN c // 2 ELSE x END) FROM (SELECT x, total, (x + 96) // 97 * 97 AS b, (x + 149) // 150 * 150 AS c FROM earliest, t)),
low AS (SELECT min(x) AS x FROM earliest)
SELECT count(*) - 1 + count(*) FILTER (n % 50 = 0) AS n, count(*) FILTER (n % 50 = 0) AS sides FROM lines, low WHERE n >= low.x""")
def lin_deep_reach(spark, sf_dir):
    """How much is reachable from the middle of the chain, over intervals instead of steps."""
    edges, total = _chain(spark, sf_dir)
    found = reach.ReachIndex.build(edges).reach(f"l{total // 2}")
    return found.agg(F.count("*").alias("n"), F.count_if(F.col("uri").startswith("side")).alias("sides"))


@query(f"WITH h AS ({HOLEY}) SELECT 'completeness_price' AS rule, round(count(price) / count(*), 6) AS metric, count(price) / count(*) >= 0.9 AS passed FROM h UNION ALL SELECT 'completeness_status', round(count(status) / count(*), 6), count(status) / count(*) >= 0.5 FROM h")
def dsh_find_report(spark, sf_dir):
    uri = sinks.write_parquet(holey(spark, sf_dir), _place(spark, "holey"))
    services = Services(spark, _place(spark, "root"), "t")
    job = services.check_quality(uri, [{"column": "price", "threshold": 0.9}, {"column": "status", "threshold": 0.5}]).job_id
    results = services.find_report(job_id=job)["results"]
    return spark.createDataFrame([(r["rule"], r["metric"], r["passed"]) for r in results], "rule string, metric double, passed boolean")


@query("SELECT count(*) AS row_count, 3 AS column_count, 'price' AS \"column\", round(avg(price), 4) AS mean FROM (" + HOLEY + ")")
def dsh_find_profile(spark, sf_dir):
    uri = sinks.write_parquet(holey(spark, sf_dir), _place(spark, "holey"))
    services = Services(spark, _place(spark, "root"), "t")
    found = services.find_profile(services.profile(uri).details["profile_id"])
    numbers = next(r for r in found["parts"]["numeric"] if r["column"] == "price")
    return spark.createDataFrame([(found["row_count"], found["column_count"], "price", round(numbers["mean"], 4))], "row_count bigint, column_count int, column string, mean double")


@query("""SELECT 'ingest' AS job_type, 'completed' AS status, count(*) AS row_count FROM nation UNION ALL SELECT 'clean', 'completed', count(*) FROM nation UNION ALL SELECT 'transform', 'completed', count(*) FROM nation
UNION ALL SELECT 'transform', 'failed', NULL FROM range(1)""")
def svc_jobs(spark, sf_dir):
    """Services as recorded jobs, one of which fails and is contained."""
    services = Services(spark, _place(spark, "root"), "t")
    raw = services.ingest("parquet", {"file_path": f"{sf_dir}/nation.parquet", "format": "parquet"}).output_uri
    tidy = services.clean(raw, {"encoding": {"n_name": "label"}}).output_uri
    services.transform(tidy, {"rename": {"n_name": "name"}})
    try:
        services.sample(raw, {"strategy": "guess", "sample_size": 20})
    except ValueError:
        pass
    return services.records.jobs("t").select("job_type", "status", "row_count")


@query("SELECT 'expect_table_row_count_to_be_between' AS expectation_type, count(*) >= 2 AS success FROM region UNION ALL SELECT 'expect_column_to_exist', false")
def gat_loaded_suite(spark, sf_dir):
    """A suite from a file; its second expectation names a column that isn't there."""
    checks = [{"expectation_type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 2}}, {"expectation_type": "expect_column_to_exist", "kwargs": {"column": "absent"}}]
    path = _place(spark, "suite")
    spark.createDataFrame([(json.dumps({"expectations": checks}),)], "value string").coalesce(1).write.text(path)
    seen = gate.validate(table(spark, sf_dir, "region"), gate.load_suite(spark, path))
    return spark.createDataFrame([(r["expectation_type"], r["success"]) for r in seen.results], "expectation_type string, success boolean")


ORDERED = [
    ("expect_column_values_to_be_increasing", {"column": "o_orderdate", "order_by": ["o_orderdate", "o_orderkey"]}),
    ("expect_column_values_to_be_increasing", {"column": "o_totalprice", "order_by": ["o_orderkey"]}),
    ("expect_column_values_to_be_decreasing", {"column": "o_totalprice", "order_by": ["o_orderkey"], "mostly": 0.4}),
    ("expect_column_values_to_be_increasing", {"column": "o_custkey", "order_by": ["o_custkey", "o_orderkey"], "strictly": True}),
]


def _successes(spark, df, checks):
    seen = gate.validate(df, {"expectations": [{"expectation_type": n, "kwargs": k} for n, k in checks]})
    return spark.createDataFrame([(i, r["success"]) for i, r in enumerate(seen.results)], "place int, success boolean")


@query("""WITH s AS (SELECT o_totalprice <= lag(o_totalprice) OVER w AS down, o_totalprice >= lag(o_totalprice) OVER w AS up FROM orders WINDOW w AS (ORDER BY o_orderkey)),
r AS (SELECT coalesce(bool_and(up), true) AS b, coalesce(avg(CAST(down AS INT)) >= 0.4, true) AS c FROM s)
SELECT unnest([0, 1, 2, 3]) AS place, unnest([true, b, c, (SELECT count(*) = count(DISTINCT o_custkey) FROM orders)]) AS success FROM r""")
def gat_order(spark, sf_dir):
    return _successes(spark, _orders(spark, sf_dir), ORDERED)


FLAGS = {"values": ["A", "N", "R"], "weights": [0.3, 0.4, 0.3]}
QUANTITIES = {"bins": [1, 11, 21, 31, 41, 51], "weights": [0.2] * 5}


@query("""WITH p AS (SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS b, count(*) FILTER (l_returnflag = 'R') AS c FROM lineitem),
s AS (SELECT a / n * ln(a / n / 0.3) + b / n * ln(b / n / 0.4) + c / n * ln(c / n / 0.3) AS kl, exp(-((a - 0.3 * n) ^ 2 / (0.3 * n) + (b - 0.4 * n) ^ 2 / (0.4 * n) + (c - 0.3 * n) ^ 2 / (0.3 * n)) / 2) AS chance FROM p),
e AS (SELECT unnest([11, 21, 31, 41]) AS edge, unnest([0.2, 0.4, 0.6, 0.8]) AS share),
d AS (SELECT max(abs((SELECT count(*) FILTER (l_quantity < edge) / count(*) FROM lineitem) - share)) AS d FROM e),
k AS (SELECT sqrt((SELECT n FROM p)) * d AS x FROM d),
q AS (SELECT CASE WHEN x < 0.2 THEN 1.0 ELSE 2 * (exp(-2 * x * x) - exp(-8 * x * x) + exp(-18 * x * x) - exp(-32 * x * x) + exp(-50 * x * x) - exp(-72 * x * x) + exp(-98 * x * x)) END AS chance FROM k)
SELECT unnest([0, 1, 2, 3]) AS place, unnest([kl < 0.05, kl < 1e-7, (SELECT chance FROM q) > 0.001, chance > 0.05]) AS success FROM s""")
def gat_distribution(spark, sf_dir):
    kl, ks, chi = (f"expect_column_{n}" for n in ("kl_divergence_to_be_less_than", "ks_test_p_value_to_be_greater_than", "chisquare_test_p_value_to_be_greater_than"))
    flags = {"column": "l_returnflag", "partition_object": FLAGS}
    checks = [(kl, flags | {"threshold": 0.05}), (kl, flags | {"threshold": 1e-7}), (ks, {"column": "l_quantity", "partition_object": QUANTITIES, "p_value": 0.001}), (chi, flags)]
    return _successes(spark, table(spark, sf_dir, "lineitem"), checks)


@query("""WITH c AS (SELECT 'l_extendedprice' AS "column", count(l_extendedprice) AS count, min(l_extendedprice) AS low, max(l_extendedprice) AS high, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS std FROM lineitem
UNION ALL SELECT 'l_orderkey', count(l_orderkey), min(l_orderkey), max(l_orderkey), avg(l_orderkey), stddev_samp(l_orderkey) FROM lineitem)
SELECT "column", count, round(low, 4) AS low, round(high, 4) AS high, round(mean, 4) AS mean, round(std, 4) AS std, true AS cardinality_near, true AS median_near FROM c""")
def prf_merged(spark, sf_dir):
    """States of three batches merged: exact where they add up exactly, and within the bounds of error elsewhere."""
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_orderkey")
    states = [sketch_profile.profile_states(lines.filter(F.pmod(F.col("l_orderkey"), F.lit(3)) == i)) for i in range(3)]
    seen = sketch_profile.estimates(sketch_profile.merged(readers.union_chunks(states)))
    exact = profile.cardinality(lines).withColumnRenamed("cardinality", "exact")
    asked = {r["column"]: r["median"] for r in seen.select("column", "median").collect()}
    below = lines.agg(*[F.struct((F.count_if(F.col(c) < m) / F.count("*")).alias("under"), (F.count_if(F.col(c) <= m) / F.count("*")).alias("upto")).alias(c) for c, m in asked.items()])
    places = below.select(F.explode(F.create_map(*[x for c in asked for x in (F.lit(c), F.col(c))])).alias("column", "at"))
    slack, near = 3 * sketch_profile.RANK_ERROR, F.abs(F.col("cardinality") - F.col("exact")) <= F.greatest(F.lit(1.0), 4 * sketch_profile.DISTINCT_ERROR * F.col("exact"))
    both = seen.join(exact, "column").join(places, "column")
    number = lambda c: F.round(F.col(c).cast("double"), 4)
    return both.select("column", "count", number("min").alias("low"), number("max").alias("high"), number("mean").alias("mean"), number("std").alias("std"), near.alias("cardinality_near"), ((F.col("at.under") <= 0.5 + slack) & (F.col("at.upto") >= 0.5 - slack)).alias("median_near"))


@query("""WITH t AS (SELECT 'ada' || c_custkey || '@mail.example' AS mail, c_name FROM customer)
SELECT 'mail' AS "column", 'redact' AS strategy, count(*) AS masked_values, round((least(count(DISTINCT '[EMAIL_REDACTED]') / count(*), 1) * 0.5 + CASE WHEN count(DISTINCT c_name) / count(*) > 0.8 THEN 0.3 END) / 2, 4) AS risk_score FROM t""")
def dei_report(spark, sf_dir):
    """Columns found personal, masked and audited, with the risk that is left."""
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("ada"), F.col("c_custkey").cast("string"), F.lit("@mail.example")).alias("mail"), "c_name")
    out = deidentify.deidentify(people, {"columns": {}, "auto_detect": True, "order_by": ["c_name"]}, "job", "t")
    return out.audit_log.select("column", "strategy", "masked_values").join(F.broadcast(out.risk.select("risk_score")))


@query("SELECT c_custkey, c_mktsegment FROM customer QUALIFY (row_number() OVER (ORDER BY c_name, c_custkey) - 1) % 7 = 0")
def smp_every_seventh(spark, sf_dir):
    return sample.systematic_sample(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name"), ["c_name", "c_custkey"], step=7).drop("c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def cln_skipped_steps(spark, sf_dir):
    """Steps on columns that aren't there, or of the wrong kind, are skipped with a warning."""
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        o = _orders(spark, sf_dir).select("o_orderkey", "o_totalprice")
        return clean.normalise(clean.encode(o, {"absent": "label", "o_totalprice": "sideways"}), {"absent": "minmax"})

