"""Readers by name: files, object stores, databases, warehouses, REST, spreadsheets.

A reader takes ``(spark, config)`` and gives a lazy DataFrame.  Connectors whose
drivers may be missing fail loudly when the frame is planned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, null_for_nan

Reader = Callable[[SparkSession, dict], DataFrame]
READERS: dict[str, Reader] = {}


class ConfigError(ValueError):
    """A source or sink was described wrongly."""


def reader(*names: str) -> Callable[[Reader], Reader]:
    def put(f: Reader) -> Reader:
        READERS.update(dict.fromkeys(names, f))
        return f

    return put


def _select(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    return null_for_nan(df.select(*map(col, columns)) if columns else df)


def file_format(path: str, wanted: str = "auto") -> str:
    """``.parquet`` and ``.pq`` are Parquet, anything else CSV, unless a format is given."""
    if wanted != "auto":
        return wanted
    return "parquet" if path.lower().endswith((".parquet", ".pq")) else "csv"


def read_path(spark: SparkSession, path: str | list[str], kind: str, config: dict) -> DataFrame:
    if kind == "parquet":
        df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    elif kind == "json":
        df = spark.read.json(path, schema=config.get("schema"))
    elif kind == "orc":
        df = spark.read.orc(path)
    elif kind == "csv":
        options = {"header": config.get("has_header", True), "sep": config.get("delimiter", ","), "encoding": config.get("encoding", "utf-8"), "nullValue": config.get("null_value", "")}
        schema = config.get("schema")
        df = spark.read.csv(path, schema=schema, inferSchema=schema is None, **options)
    else:
        raise ConfigError(f"unknown file format {kind!r}")
    return _select(df, config.get("columns"))


@reader("file", "csv", "parquet", "json", "orc")
def read_file(spark: SparkSession, config: dict) -> DataFrame:
    """``file_path, format=auto, columns, delimiter, encoding, has_header, schema``."""
    path = config.get("file_path") or config.get("path")
    if not path:
        raise ConfigError("file_path is missing")
    return read_path(spark, path, file_format(path, config.get("format", "auto")), config)


@reader("s3", "object_store")
def read_object_store(spark: SparkSession, config: dict) -> DataFrame:
    """``bucket`` with ``key`` (one object) or ``prefix`` (all below); credentials go to the Hadoop configuration.

    ``scheme`` is ``s3a`` by default; another one (``file``) serves as a stand-in.
    """
    scheme, bucket = config.get("scheme", "s3a"), config.get("bucket", "")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for key, option in (("endpoint_url", "endpoint"), ("access_key", "access.key"), ("secret_key", "secret.key"), ("region", "endpoint.region")):
        if config.get(key) and scheme == "s3a":
            hadoop.set(f"fs.s3a.{option}", config[key])
    root = f"{scheme}://{bucket}".rstrip("/")
    if config.get("key"):
        path = f"{root}/{config['key']}"
        return read_path(spark, path, file_format(path, config.get("format", "auto")), config)
    if config.get("prefix") is None:
        raise ConfigError("key or prefix is missing")
    kind = config.get("format", "parquet")
    return read_path(spark, f"{root}/{config['prefix']}*", "parquet" if kind == "auto" else kind, config)


@reader("postgres", "jdbc")
def read_jdbc(spark: SparkSession, config: dict) -> DataFrame:
    """``connection_string`` with ``query``, or ``schema`` and ``table``.

    A numeric ``partition_column`` splits a table over ``num_partitions`` tasks:
    evenly by the database's own counts (:mod:`sluiceway.sources.jdbc_splits`), or
    in equal widths where ``lower_bound`` and ``upper_bound`` are given.
    """
    source = spark.read.format("jdbc").option("url", config["connection_string"]).option("fetchsize", str(config.get("chunk_size", 10_000)))
    login = {key: config[key] for key in ("driver", "user", "password") if config.get(key)}
    source = source.options(**login)
    if config.get("query"):
        return _select(source.option("query", config["query"]).load(), None)
    if not config.get("table"):
        raise ConfigError("query or table is missing")
    schema = config.get("schema", "public")
    table = f'"{schema}"."{config["table"]}"' if schema else config["table"]
    if config.get("partition_column") and "lower_bound" not in config:
        return _select(_read_splits(spark, config, table, login), config.get("columns"))
    source = source.option("dbtable", table)
    if config.get("partition_column"):
        for key, option in (("partition_column", "partitionColumn"), ("lower_bound", "lowerBound"), ("upper_bound", "upperBound"), ("num_partitions", "numPartitions")):
            source = source.option(option, str(config[key]))
    return _select(source.load(), config.get("columns"))


def _read_splits(spark: SparkSession, config: dict, table: str, login: dict[str, str]) -> DataFrame:
    from .jdbc_splits import conditions

    url, name = config["connection_string"], config["partition_column"]
    whole = spark.read.format("jdbc").option("url", url).options(**login).option("dbtable", table).load()
    kind = whole.schema[name].dataType
    if not isinstance(kind, T.NumericType):
        raise ConfigError(f"{name} has no numbers to split by")
    ask = lambda query: [tuple(r) for r in spark.read.format("jdbc").option("url", url).options(**login).option("query", query).load().collect()]
    column = '"' + name.replace('"', '""') + '"'
    splits = conditions(ask, table, column, int(config.get("num_partitions", spark.sparkContext.defaultParallelism)), isinstance(kind, T.IntegralType))
    return spark.read.jdbc(url, table, predicates=splits, properties=login | {"fetchsize": str(config.get("chunk_size", 10_000))})


def warehouse_options(kind: str, config: dict) -> dict[str, str]:
    """Options of the public Spark connectors of warehouses and document stores."""
    fixed = {"snowflake": {"account": "sfURL", "user": "sfUser", "password": "sfPassword", "database": "sfDatabase", "schema": "sfSchema", "warehouse": "sfWarehouse", "query": "query"}, "bigquery": {"project": "parentProject", "credentials": "credentials", "query": "query", "dataset": "materializationDataset"}, "mongodb": {"connection_string": "connection.uri", "database": "database", "collection": "collection"}}
    return {option: str(config[key]) for key, option in fixed[kind].items() if config.get(key) is not None}


@reader("snowflake")
def read_snowflake(spark: SparkSession, config: dict) -> DataFrame:
    return _select(spark.read.format("snowflake").options(**warehouse_options("snowflake", config)).load(), None)


@reader("bigquery")
def read_bigquery(spark: SparkSession, config: dict) -> DataFrame:
    return _select(spark.read.format("bigquery").options(viewsEnabled="true", **warehouse_options("bigquery", config)).load(), None)


@reader("databricks", "sql")
def read_catalog_sql(spark: SparkSession, config: dict) -> DataFrame:
    """A query in the catalogue ``catalog`` and its ``schema``; the session's own choice of both is put back."""
    catalog, schema = spark.catalog.currentCatalog(), spark.catalog.currentDatabase()
    try:
        if config.get("catalog"):
            spark.catalog.setCurrentCatalog(config["catalog"])
        if config.get("schema"):
            spark.catalog.setCurrentDatabase(config["schema"])
        return spark.sql(config["query"])
    finally:
        spark.catalog.setCurrentCatalog(catalog)
        spark.catalog.setCurrentDatabase(schema)


@reader("mongodb")
def read_mongodb(spark: SparkSession, config: dict) -> DataFrame:
    return document_find(spark.read.format("mongodb").options(**warehouse_options("mongodb", config)).load(), config)


def document_find(df: DataFrame, config: dict) -> DataFrame:
    """``filter`` (SQL), ``projection`` and ``limit`` (0: none) pushed into the scan; ``_id`` as text."""
    if config.get("filter"):
        df = df.filter(config["filter"])
    if config.get("projection"):
        df = df.select(*map(col, config["projection"]))
    if config.get("limit"):
        df = df.limit(int(config["limit"]))
    return df.withColumn("_id", F.col("_id").cast("string")) if "_id" in df.columns else df


@reader("api", "rest")
def read_rest(spark: SparkSession, config: dict) -> DataFrame:
    """Records of a REST service (see :mod:`sluiceway.sources.rest`)."""
    from .rest import RestSource

    spark.dataSource.register(RestSource)
    import json

    schema = config.get("schema")
    source = spark.read.format("sluiceway_rest").option("config", json.dumps({k: v for k, v in config.items() if k != "schema"}))
    rows = source.load()
    return _select(rows.select(F.from_json("record", schema).alias("r")).select("r.*"), None) if schema else rows


@reader("excel")
def read_excel(spark: SparkSession, config: dict) -> DataFrame:
    """``path, sheet_name=0, skip_rows, na_values, dtype_inference``; names are stripped.  Needs a spreadsheet engine for pandas."""
    import io

    import pandas as pd

    data = bytes(spark.read.format("binaryFile").load(config["path"]).select("content").first()[0])
    sheet = pd.read_excel(io.BytesIO(data), sheet_name=config.get("sheet_name", 0), skiprows=config.get("skip_rows", 0), na_values=config.get("na_values"), dtype=None if config.get("dtype_inference", True) else str)
    sheet.columns = [str(c).strip() for c in sheet.columns]
    return _select(spark.createDataFrame(sheet), config.get("columns"))


def read_source(spark: SparkSession, kind: str, config: dict) -> DataFrame:
    """By a reader's name; unknown names say which there are."""
    if kind not in READERS:
        raise ConfigError(f"unknown source {kind!r}; there are {', '.join(sorted(READERS))}")
    return READERS[kind](spark, config)


def validate_connection(spark: SparkSession, kind: str, config: dict) -> bool:
    """Whether the source can be opened; never raises."""
    try:
        read_source(spark, kind, config).limit(1).collect()
        return True
    except Exception:  # noqa: BLE001 - any failure means no connection
        return False


def union_chunks(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames whose columns may differ; none is an error."""
    if not frames:
        raise ConfigError("the source gave nothing")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def redacted(config: dict) -> dict:
    """A configuration fit for logs and job records."""
    hidden = ("secret", "password", "token", "key", "credential", "connection_string")
    return {k: "***" if any(h in k.lower() for h in hidden) and k != "key" else v for k, v in config.items()}
