"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent 1- to 3-grams of letters (with word edges) by
rank.  A document's own list is compared with each language's by out-of-place
distance: the sum, over the document's n-grams, of how far their ranks lie apart,
with the profile length for those that a language's list doesn't have.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, strings

#: n-grams in a profile.
PROFILE = 300
#: Rows of each language, by hash of their id, that profiles are learnt from (in expectation).
FIT_ROWS = 4_000
_SALTS = 16
_HELD = 1_000_000


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


_ALPHA: np.ndarray | None = None


def ngrams(text: str) -> np.ndarray:
    """Codes of all 1- to 3-grams: 21 bits a character, 1 for a word edge."""
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = _letters()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _ALPHA[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    units = np.zeros(len(points) + 2, np.int64)
    units[1:-1] = np.where(letter, points + 1, 1)
    units[0] = units[-1] = 1
    edge = units == 1
    units = units[~(edge & np.concatenate(([False], edge[:-1])))]
    two = units[:-1] << 21 | units[1:]
    three = two[:-1] << 21 | units[2:]
    return np.concatenate((units[units != 1], two, three))


def top_ranked(text: str, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    codes, counts = np.unique(ngrams(text), return_counts=True)
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """Languages with their n-gram codes in rank order."""

    ranked: dict[str, np.ndarray]
    size: int = PROFILE

    def __post_init__(self) -> None:
        sorted_lists = {}
        for lang in sorted(self.ranked):
            codes = np.asarray(self.ranked[lang], np.int64)
            order = np.argsort(codes, kind="stable")
            sorted_lists[lang] = (codes[order], order)
        object.__setattr__(self, "lists", sorted_lists)

    def distance(self, mine: np.ndarray, lang: str) -> int:
        codes, ranks = self.lists[lang]
        if not len(codes):
            return self.size * len(mine)
        at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
        return int(np.where(codes[at] == mine, np.abs(ranks[at] - np.arange(len(mine))), self.size).sum())

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest language (ties: first in code point order) and 1 minus the share of the largest distance."""
        mine = top_ranked(text, self.size)
        if not len(mine) or not self.lists:
            return "und", 0.0
        far, lang = min((self.distance(mine, lang), lang) for lang in self.lists)
        return lang, 1.0 - far / (self.size * len(mine))


def held_out(row_id: Column, folds: int = 4, fold_no: int = 2) -> Column:
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % folds == fold_no, F.lit(False))


def _count(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams counted by language, over texts of at most ``_HELD`` characters (or one longer text) at a time."""
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])
    by: dict[str, list[np.ndarray]] = {}
    held = 0

    def flush(by: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, found in by.items():
            codes, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts.astype(np.int64))], schema=schema)

    for batch in part:
        for lang, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
            by.setdefault(lang, []).append(ngrams(text))
            held += len(text)
            if held > _HELD:
                yield from flush(by)
                by, held = {}, 0
    yield from flush(by)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, fit_rows: int = FIT_ROWS) -> Profiles:
    """Learn a profile for each language named outside the held-out fold.

    Every language is sampled on its own, by hash of the id at a rate that gives
    ``fit_rows`` rows, so rare ones are learnt from all their rows.  Counts are
    summed by the executors; the driver gets at most ``16 * size`` n-grams of a language.
    """
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("body"))
    rows = rows.filter(F.col("lang").isNotNull() & ~held_out(F.col("row_id")))
    rates = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not rates:
        return Profiles({}, size)
    draw = F.pmod(F.xxhash64(F.col("row_id"), F.lit("language")), F.lit(1_000_000))
    rate = F.element_at(F.create_map(*[x for r in rates for x in (F.lit(r["lang"]), F.lit(1_000_000 * min(1.0, fit_rows / r["n"])))]), F.col("lang"))
    counted = rows.filter(draw < rate).select("lang", "body").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = (
        counted.withColumn("salt", F.pmod(F.xxhash64("code"), F.lit(_SALTS)))
        .groupBy("lang", "salt")
        .agg(F.expr(f"slice(sort_array(collect_list(struct(-n AS m, code))), 1, {size})").alias("top"))
    )
    gathered: dict[str, list] = {}
    for r in best.collect():
        gathered.setdefault(r["lang"], []).extend((x["m"], x["code"]) for x in r["top"])
    ranked = {lang: np.array([code for _, code in sorted(found)[:size]], np.int64) for lang, found in gathered.items()}
    return Profiles(ranked, size)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``held_out``, ``lang_pred`` and ``score`` (0..1) of every row.

    Null texts and texts without a letter give ``und`` and 0.  Whole texts are
    read, however long.  Ids may be null or repeat; other columns aren't read.
    """
    schema = pa.schema([("row_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    ranked, size = profiles.ranked, profiles.size

    def work(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(ranked, size)
        yield from batches(((i, *known.predict(t)) for b in part for i, t in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True)), schema)

    out = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col)).mapInArrow(work, "row_id long, lang_pred string, score double")
    return out.select(F.col("row_id").alias(id_col), held_out(F.col("row_id")).alias("held_out"), "lang_pred", "score")
