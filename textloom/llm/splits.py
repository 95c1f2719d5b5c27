"""Train, validation and test splits of retrieval queries that keep related bills together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..workspace import written
from .components import components, split_by_component

#: 80, 10 and 10 percent.
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def version_number(c: Column | str) -> Column:
    """The number a version id names, or null: it may stand among blanks, after a sign or word
    (``v``, ``#``, ``version:``), with leading zeros, thousands commas or a fraction of zeros."""
    c = F.col(c) if isinstance(c, str) else c
    digits = F.regexp_extract(F.regexp_replace(c, ",", ""), r"^\s*(?i:version\s*[:#]?|v\.?|#|no\.?)?\s*\+?0*([0-9]{1,18})(?:\.0*)?\s*$", 1)
    return F.when(digits != "", digits).try_cast("long")


def query_groups(raw: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, loose): ``groups`` (query_id, group_bill_id) of every query with a known version,
    ``loose`` (query_id) of the others. Bills of one version belong together, so do the bills of all
    versions of one query (its own and those in ``relevant``), and so on. Null and unknown versions
    link nothing; a query id in several rows is one query with the versions of all of them; queries
    without an id are left out; bills without a known version take part in no group of a query.
    """
    bills = raw.where("version_id is not null and bill_id is not null").select(F.col("version_id").cast("long").alias("version"), F.col("bill_id").cast("long").alias("bill")).distinct()
    said = F.array_union(F.array("version_id"), F.coalesce(F.col("relevant.version_id"), F.array().cast("array<string>")))
    asked = queries.where("query_id is not null").select("query_id", F.explode(said).alias("said")).select("query_id", version_number("said").alias("version")).where("version is not null").distinct()
    first = bills.groupBy("version").agg(F.min("bill").alias("bill"))
    known, _ = written(asked.join(first, "version").select("query_id", "bill").distinct(), "splits-known")
    anchor = known.groupBy("query_id").agg(F.min("bill").alias("anchor"))
    edges = (
        bills.join(first.withColumnRenamed("bill", "first"), "version").select(F.col("first").alias("src"), F.col("bill").alias("dst"))
        .unionByName(known.join(anchor, "query_id").select(F.col("anchor").alias("src"), F.col("bill").alias("dst"))).distinct()
    )
    group = components(edges)
    groups = anchor.join(group.select(F.col("node").alias("anchor"), "component"), "anchor").select("query_id", F.col("component").alias("group_bill_id"))
    loose = queries.where("query_id is not null").select("query_id").distinct().join(anchor, "query_id", "left_anti")
    return groups, loose


def query_splits(raw: DataFrame, queries: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """(query_id, group_bill_id, split): each query once. A query without a known version is alone in
    its group, with a null ``group_bill_id``."""
    groups, loose = query_groups(raw, queries)
    rows = groups.select("query_id", "group_bill_id", F.concat(F.lit("b"), F.col("group_bill_id").cast("string")).alias("group"))
    rows = rows.unionByName(loose.select("query_id", F.lit(None).cast("long").alias("group_bill_id"), F.concat(F.lit("q"), F.col("query_id")).alias("group")))
    rows, _ = written(rows, "splits-rows")
    return split_by_component(rows, "group", shares).select("query_id", "group_bill_id", "split")
