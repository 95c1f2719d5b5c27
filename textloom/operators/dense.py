"""Operators on vectors: pooled statistics, pairs within a document, separation of labels, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import vectors as V


def components_of(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys..., i, x): one row for each component."""
    return df.select(*keys, F.posexplode(vector).alias("i", "x"))


def mean_std(df: DataFrame, vector: str, dim: int, keys: list[str] | None = None) -> DataFrame:
    """(keys..., mean, std): elementwise mean and population deviation.

    One aggregate per component in one pass: partial sums combine before the exchange, whose size is
    the number of groups, not of rows.
    """
    at = [F.col(vector)[i] for i in range(dim)]
    g = df.groupBy(*(keys or []))
    return g.agg(F.array(*[F.avg(x) for x in at]).alias("mean"), F.array(*[F.stddev_pop(x) for x in at]).alias("std"))


def positions(df: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """``df`` with ``pos``, the row's place in its document from 0, and ``n``, the document's rows."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1).withColumn("n", F.count("*").over(Window.partitionBy(doc)).cast("int"))


def document_pairs(df: DataFrame, doc: str, columns: list[str]) -> DataFrame:
    """(doc, n, i, j, c_a, c_b ...): the ordered pairs i < j of each document's rows. Both sides share one partitioning by document."""
    a = df.select(doc, "n", F.col("pos").alias("i"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = df.select(doc, F.col("pos").alias("j"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, doc).where("i < j")


def anisotropy(df: DataFrame, vector: str, dim: int, keys: list[str] | None = None) -> DataFrame:
    """(keys..., anisotropy): mean cosine of all pairs, from the sum of unit vectors; 0 for fewer than two rows."""
    unit = df.withColumn("_u", F.transform(vector, lambda x: x / V.norm(F.col(vector))))
    g = unit.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("_u")[i]) for i in range(dim)]).alias("s"))
    value = (V.dot(F.col("s"), F.col("s")) - F.col("n")) / F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1))
    return g.select(*(keys or []), F.coalesce(value, F.lit(0.0)).alias("anisotropy"))


def cosine_gap(pairs: DataFrame, same: str, value: str, keys: list[str]) -> DataFrame:
    """(keys..., gap): mean similarity of pairs of one label less that of the others; 0 if either is empty."""
    s, d = F.avg(F.when(F.col(same), F.col(value))), F.avg(F.when(~F.col(same), F.col(value)))
    return pairs.groupBy(*keys).agg(F.coalesce(s - d, F.lit(0.0)).alias("gap"))


def separation_auc(pairs: DataFrame, same: str, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """(keys..., auc): chance that a pair of one label is more similar than one of two; ordinal ranks, 0.5 if either is empty."""
    ranked = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(value, *order)))
    g = ranked.groupBy(*keys).agg(F.count_if(same).alias("p"), F.count_if(~F.col(same)).alias("q"), F.sum(F.when(F.col(same), F.col("_r")).otherwise(0)).alias("r"))
    return g.select(*keys, F.when((F.col("p") == 0) | (F.col("q") == 0), F.lit(0.5)).otherwise((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.when(F.col("p") * F.col("q") != 0, F.col("p") * F.col("q"))).alias("auc"))


def nearest(queries: DataFrame, rows: DataFrame, on: list[str], k: int) -> DataFrame:
    """Per query (q, qv) its ``k`` nearest rows (id, v) that share ``on``, by cosine distance, then id."""
    both = queries.join(rows, on).withColumn("distance", 1 - V.cosine(F.col("qv"), F.col("v")))
    w = Window.partitionBy("q").orderBy("distance", "id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q", "id", "rank", "distance")
