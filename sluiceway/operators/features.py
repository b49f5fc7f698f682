"""Feature engineering: drop, rename, scale, encode, interact, square, project - in this order."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, existing, numeric_columns, unused
from .clean import drop_columns, encode, normalise


def rename(df: DataFrame, names: dict[str, str] | None) -> DataFrame:
    """Existing columns by their new names; later steps see the new ones."""
    return df.withColumnsRenamed({k: v for k, v in (names or {}).items() if k in df.columns})


def interactions(df: DataFrame, pairs: Sequence[Sequence[str]] | None) -> DataFrame:
    """``a_x_b``: products of pairs of numeric columns; entries that aren't such pairs are skipped."""
    numeric = set(numeric_columns(df))
    good = [tuple(p) for p in pairs or () if len(p) == 2 and set(p) <= numeric]
    return df.withColumns({f"{a}_x_{b}": col(a) * col(b) for a, b in good}) if good else df


def polynomial(df: DataFrame, names: Sequence[str] | None) -> DataFrame:
    """Second-degree terms ``a^2`` and ``a b`` of numeric columns; a null factor gives null."""
    good = [n for n in existing(df, names) if n in set(numeric_columns(df))]
    terms = {(f"{a}^2" if a == b else f"{a} {b}"): col(a).cast("double") * col(b).cast("double") for a, b in combinations_with_replacement(good, 2)}
    return df.withColumns(terms) if terms else df


def pca(df: DataFrame, names: Sequence[str], n_components: int = 2) -> DataFrame:
    """``pca_1..n`` in place of the columns: mean-centred, nulls as 0, each loading's largest part positive.

    Skipped where there are fewer columns than components.
    """
    good = [n for n in existing(df, names) if n in set(numeric_columns(df))]
    if len(good) < n_components or n_components < 1:
        return df
    raw, mid, out, scores = (unused(df, n) for n in ("raw_vector", "mid_vector", "out_vector", "scores"))
    parts = [unused(df, f"part_{i}") for i in range(len(good))]
    filled = df.withColumns({p: F.coalesce(col(n).cast("double"), F.lit(0.0)) for p, n in zip(parts, good, strict=True)})
    rows = VectorAssembler(inputCols=parts, outputCol=raw).transform(filled)
    centred = StandardScaler(withMean=True, withStd=False, inputCol=raw, outputCol=mid).fit(rows).transform(rows)
    model = PCA(k=n_components, inputCol=mid, outputCol=out).fit(centred)
    signs = [1.0 if max(column, key=abs) >= 0 else -1.0 for column in model.pc.toArray().T]
    scored = model.transform(centred).withColumn(scores, vector_to_array(out))
    kept = [col(c) for c in df.columns if c not in good]
    return scored.select(*kept, *[(F.col(scores)[i] * s).alias(f"pca_{i + 1}") for i, s in enumerate(signs)])


def transform(df: DataFrame, config: dict | None = None) -> DataFrame:
    """All steps: ``drop_cols, rename, scale, encode, interactions, polynomial_cols, pca``."""
    c = config or {}
    df = rename(drop_columns(df, c.get("drop_cols", ())), c.get("rename"))
    df = encode(normalise(df, c.get("scale")), c.get("encode"))
    df = polynomial(interactions(df, c.get("interactions")), c.get("polynomial_cols"))
    wanted = c.get("pca") or {}
    return pca(df, wanted.get("cols", ()), wanted.get("n_components", 2)) if wanted else df
