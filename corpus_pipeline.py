"""From raw documents to a clean, de-duplicated, mixed and tokenised corpus.

``STAGES`` are applied in order; each takes ``(spark, docs, sf_dir)`` and its
result is written to the shared folder and read again as the next one's
``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm import bpe, exact_dedup, jaccard_join, mixture, toxicity
from sluiceway.llm.common import materialise, read, unused


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row that no other has and that grows with doc_id, null ids last; and that column's name.

    Ids that are set and different are their own numbers; otherwise rows are
    sorted, counted off and written, so that the numbers hold when read again.
    """
    name = unused(docs, "row_number")
    rows, ids, different = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if rows == ids == different:
        return docs.withColumn(name, F.col("doc_id").cast("long")), name
    ordered = docs.orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text"))
    return materialise(ordered.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the lexicon learnt from ``labels`` scores under 0.5; null and empty texts stay."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, one row: that with the smallest id, or one without an id where none has any."""
    rows, name = numbered(docs)
    return exact_dedup.drop_exact_copies(rows, name).drop(name)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by five-word shingles at 0.75 or more, one row: that with the smallest id, or one without an id where none has any."""
    rows, name = numbered(docs)
    found = jaccard_join.near_duplicate_components(rows, name)
    gone = unused(rows, "gone")
    dropped = found.filter(F.col(name) != F.col("component_id")).select(F.col(name).alias(gone))
    return rows.join(dropped, F.col(name) == F.col(gone), "left_anti").drop(name)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's rows: one for each epoch that takes of a document.

    The document at which a source's budget ends is cut after its last word
    taken, and ``n_chars``, where there is one, follows; documents without words
    are in no mixture.  Each row is taken for itself, also where ids are null or
    repeat; other columns stay, whatever their names.
    """
    rows, name = numbered(docs)
    plan = mixture.mix_sources(rows, mixture.word_count(F.col("text")), name).filter("taken > 0")
    # The plan and the part travel in one column, under a name that docs doesn't have.
    held = unused(rows, "plan")
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size"))), lambda e: F.least("size", F.col("taken") - e * F.col("size")))
    plan = plan.withColumn("part", F.explode(parts)).select(F.struct(F.col(name).alias("row"), "size", "part").alias(held))
    mixed = rows.join(plan, F.col(name) == F.col(f"{held}.row"))
    whole = F.col(f"{held}.part") == F.col(f"{held}.size")
    words = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(words, F.lit(1), F.col(f"{held}.part").cast("int")), "")
    new = {"text": F.when(whole, F.col("text")).otherwise(cut)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(cut).cast(docs.schema["n_chars"].dataType))
    return mixed.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its very text."""
    import public_tokenizers

    out = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact),
    ("jaccard_join", drop_near),
    ("mixture", mix),
    ("byte_bpe", tokenise),
]

#: Learning, lexicon matching and byte-pair merges have no SQL form; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
