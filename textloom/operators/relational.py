"""Relational operators around the pipeline: samples, ordered strings, upserts, audits and batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType


def numbered(rows: DataFrame, hashed: str, order: list[str], name: str = "number") -> DataFrame:
    """``rows`` with a global row number from 1 in order of a hex hash, then ``order``.

    No global sort: rows are counted by the hash's first four digits, the at most 65,536 counts are
    summed up in one task and broadcast, and rows are numbered within their own range.
    """
    r = rows.withColumn("_range", F.substring(hashed, 1, 4))
    counts = r.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    w = Window.partitionBy("_range").orderBy(hashed, *order)
    return r.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.row_number().over(w)).drop("_range", "_before")


def stratified(rows: DataFrame, strata: list[str], order: str, caps: Column) -> DataFrame:
    """The first rows of each stratum in order, as many as ``caps`` says (null or 0: none)."""
    w = Window.partitionBy(*strata).orderBy(order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.coalesce(caps, F.lit(0)))


def ordered_concat(rows: DataFrame, keys: list[str], order: list[str], value: str, sep: str = "") -> Column:
    """Values of a group joined in order: an aggregate for ``groupBy(keys).agg``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]), sep)


def hash_sample(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """About ``percent`` of the rows, the same ones on every run: a sample by key."""
    return rows.where(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("int") % 100 < percent)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], replaced: list[str]) -> DataFrame:
    """``target`` with the rows of ``source`` merged in.

    A row that both have keeps its columns but those in ``replaced``, which come from ``source``; a key
    that occurs several times in ``source`` counts once (the row that is greatest by ``replaced``).
    """
    last = source.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in source.columns if c not in keys]), F.struct(*replaced)).alias("_new"))
    both = target.withColumn("_old", F.lit(True)).join(last, keys, "full")
    pick = lambda c: F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.col(f"_new.{c}")) if c in replaced else F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_new.{c}"))
    return both.select(*[c if c in keys else pick(c).alias(c) for c in target.columns])


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the distinct rows of ``source`` whose keys it lacks."""
    return target.unionByName(source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti").select(*target.columns))


def replace_children(target: DataFrame, source: DataFrame, parent: str) -> DataFrame:
    """``target`` where all rows of the parents that ``source`` names are replaced by those of ``source``."""
    return target.join(source.select(parent).distinct(), parent, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; one aggregate, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, status, changed): ``new``, ``removed``, ``updated`` or ``unchanged``, and the fields that differ."""
    a = old.select(key, F.struct(*fields).alias("a"))
    b = new.select(key, F.struct(*fields).alias("b"))
    both = a.join(b, key, "full")
    diff = F.filter(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    status = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(F.size(diff) > 0, "updated").otherwise("unchanged")
    return both.select(key, status.alias("status"), F.when(status == "updated", F.array_join(diff, ",")).otherwise("").alias("changed"))


def greedy_batches(rows: DataFrame, doc: str, order: str, size: Column, budget: int, most: int) -> DataFrame:
    """``rows`` with ``batch``: successive rows of a document, at most ``most`` and at most ``budget`` in size together.

    A fold over each document's ordered sizes; a row above the budget is a batch of its own.
    """
    state = F.struct(F.lit(-1).alias("b"), F.lit(0).cast("long").alias("s"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["b"] >= 0) & (s["s"] + x <= budget) & (s["n"] < most)
        return F.struct(F.when(fits, s["b"]).otherwise(s["b"] + 1).alias("b"), F.when(fits, s["s"] + x).otherwise(x).cast("long").alias("s"), F.when(fits, s["n"] + 1).otherwise(F.lit(1)).alias("n"))

    g = rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), size.cast("long").alias("z")))).alias("xs"))
    init = F.struct(state.alias("last"), F.array().cast("array<int>").alias("out"))

    def walk(acc: Column, x: Column) -> Column:
        nxt = step(acc["last"], x["z"])
        return F.struct(nxt.alias("last"), F.concat(acc["out"], F.array(nxt["b"])).alias("out"))

    batches = g.select(doc, F.explode(F.arrays_zip(F.col("xs.o").alias("o"), F.aggregate("xs", init, walk, lambda a: a["out"]).alias("batch"))).alias("r"))
    return batches.select(doc, F.col("r.o").alias(order), F.col("r.batch").alias("batch"))


def top_and_bottom(rows: DataFrame, keys: list[str], value: str, tie: str, n: int) -> DataFrame:
    """The ``n`` greatest and ``n`` least rows of each key, each once, with ``side``."""
    hi, lo = Window.partitionBy(*keys).orderBy(F.desc(value), tie), Window.partitionBy(*keys).orderBy(value, tie)
    r = rows.withColumn("_hi", F.row_number().over(hi)).withColumn("_lo", F.row_number().over(lo))
    return r.where((F.col("_hi") <= n) | (F.col("_lo") <= n)).withColumn("side", F.when(F.col("_hi") <= n, "top").otherwise("bottom")).drop("_hi", "_lo")


def update(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` where the rows that ``changes`` names by ``keys`` take its other columns; it adds no row."""
    new = [c for c in changes.columns if c not in keys]
    found = changes.select(*keys, F.struct(*new).alias("_new"))
    rows = target.join(found, keys, "left")
    return rows.select(*[F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.col(f"_new.{c}")).alias(c) if c in new else F.col(c) for c in target.columns])


def null_or_equal(fact: DataFrame, rule: DataFrame, on: list[str], optional: list[str]) -> DataFrame:
    """Distinct pairs of ``fact`` and ``rule`` that agree on ``on`` and on each of ``optional`` that neither side leaves null."""
    a, b = fact.alias("f"), rule.select(*on, *[F.col(c).alias(f"rule_{c}") for c in rule.columns if c not in on]).alias("r")
    agree = F.lit(True)
    for c in optional:
        agree = agree & (F.col(f"f.{c}").isNull() | F.col(f"rule_{c}").isNull() | (F.col(f"f.{c}") == F.col(f"rule_{c}")))
    return a.join(b, on).where(agree).distinct()


def first_object(text: Column) -> Column:
    """The first balanced ``{...}`` of a text, braces in strings aside; null if none is closed."""

    def cut(text: str | None) -> str | None:
        start = text.find("{") if text else -1
        if start < 0:
            return None
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if quoted:
                escaped, quoted = (False, True) if escaped else (c == "\\", c != '"')
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return text[start: i + 1]
        return None

    def each(texts):  # noqa: ANN001, ANN202
        return texts.map(cut)

    each.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, StringType())(text)
