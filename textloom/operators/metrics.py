"""Agreement of two groupings, and label algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def contingency(labels: DataFrame, keys: list[str], pred: str, gold: str) -> DataFrame:
    """(keys..., pred, gold, n) of rows with both labels."""
    return labels.groupBy(*keys, pred, gold).agg(F.count("*").alias("n"))


def compare(labels: DataFrame, keys: list[str], pred: str = "pred", gold: str = "gold") -> DataFrame:
    """(keys..., n, pred_groups, gold_groups, ari, mutual_info, nmi, homogeneity, completeness, v_measure).

    One contingency table; all figures are sums over its cells. Degenerate cases: ARI 1 for fewer than two
    rows or when no agreement beyond chance is possible, NMI 1 when neither side has entropy, homogeneity
    and completeness 1 when their side has none, V 0 when both are 0.
    """
    c = contingency(labels, keys, pred, gold)
    a, b, n = F.sum("n").over(Window.partitionBy(*keys, pred)), F.sum("n").over(Window.partitionBy(*keys, gold)), F.sum("n").over(Window.partitionBy(*keys))
    c = c.select(*keys, pred, gold, F.col("n").cast("double").alias("c"), a.cast("double").alias("a"), b.cast("double").alias("b"), n.cast("double").alias("t"))
    p = F.col("c") / F.col("t")
    g = c.groupBy(*keys).agg(
        F.max("t").cast("long").alias("n"), F.count_distinct(pred).alias("pred_groups"), F.count_distinct(gold).alias("gold_groups"),
        F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("both"), F.sum(F.col("c") * (F.col("a") - 1) / 2).alias("sp"), F.sum(F.col("c") * (F.col("b") - 1) / 2).alias("sg"),
        F.sum(p * F.ln(F.col("t") * F.col("c") / (F.col("a") * F.col("b")))).alias("mi"), F.sum(-p * F.ln(F.col("a") / F.col("t"))).alias("hp"), F.sum(-p * F.ln(F.col("b") / F.col("t"))).alias("hg"),
    )
    total = F.col("n") * (F.col("n") - 1) / 2
    chance, top = F.col("sp") * F.col("sg") / F.when(total > 0, total), (F.col("sp") + F.col("sg")) / 2
    tiny = 1e-12
    ari = F.when((F.col("n") < 2) | (F.abs(top - chance) < tiny), F.lit(1.0)).otherwise((F.col("both") - chance) / F.when(F.abs(top - chance) >= tiny, top - chance))
    share = lambda h: F.when(F.col(h) < tiny, F.lit(1.0)).otherwise(F.col("mi") / F.when(F.col(h) >= tiny, F.col(h)))
    mean = (F.col("hp") + F.col("hg")) / 2
    g = g.select(*keys, "n", "pred_groups", "gold_groups", ari.alias("ari"), F.col("mi").alias("mutual_info"), F.when(mean < tiny, F.lit(1.0)).otherwise(F.col("mi") / F.when(mean >= tiny, mean)).alias("nmi"), share("hg").alias("homogeneity"), share("hp").alias("completeness"))
    h, k = F.col("homogeneity"), F.col("completeness")
    return g.withColumn("v_measure", F.when(h + k < tiny, F.lit(0.0)).otherwise(2 * h * k / F.when(h + k >= tiny, h + k)))


def renumber(rows: DataFrame, doc: str, label: str, order: str) -> DataFrame:
    """``rows`` with ``number``: labels of a document in order of first appearance, from 0."""
    first = F.min(order).over(Window.partitionBy(doc, label))
    return rows.withColumn("_first", first).withColumn("number", F.dense_rank().over(Window.partitionBy(doc).orderBy("_first")) - 1).drop("_first")


def labels_from_groups(sections: DataFrame, claims: DataFrame, doc: str, section: str, order: str, last_wins: bool = True) -> DataFrame:
    """(doc, section, label): a section's last (or first) claiming group, by ``claims`` (doc, section, group).

    Groups count from 0 in each document; a section no group claims gets a label of its own: the number of
    groups plus its place, or for first-wins the next free number in order.
    """
    pick = claims.groupBy(doc, section).agg((F.max("group") if last_wins else F.min("group")).alias("group"))
    groups = claims.groupBy(doc).agg((F.max("group") + 1).alias("groups"))
    rows = sections.join(pick, [doc, section], "left").join(groups, doc, "left").withColumn("groups", F.coalesce("groups", F.lit(0)))
    w = Window.partitionBy(doc).orderBy(order)
    place = F.row_number().over(w) - 1 if last_wins else F.sum(F.when(F.col("group").isNull(), 1).otherwise(0)).over(w) - 1
    return rows.withColumn("_own", F.col("groups") + place).select(doc, section, F.coalesce("group", "_own").cast("long").alias("label"))


def reconcile(sections: DataFrame, claims: DataFrame, doc: str, section: str) -> DataFrame:
    """(doc, section, group_id): every section in one group ``g0``, ``g1``, ...

    Claims outside the document and repeats are dropped, the first group keeps a section that several
    claim, empty groups vanish, and a last group takes what is left over.
    """
    first = claims.join(sections.select(doc, section), [doc, section], "left_semi").groupBy(doc, section).agg(F.min("group").alias("group"))
    rows = sections.select(doc, section).join(first, [doc, section], "left")
    return rows.select(doc, section, F.concat(F.lit("g"), F.dense_rank().over(Window.partitionBy(doc).orderBy(F.coalesce(F.col("group").cast("long"), F.lit(2**62)))) - 1).alias("group_id"))


def violations(sections: DataFrame, claims: DataFrame, doc: str, section: str) -> DataFrame:
    """(doc, missing, repeated, unknown): where groups are no partition of a document's sections."""
    n = claims.groupBy(doc, section).agg(F.count("*").alias("n"))
    both = sections.select(doc, section, F.lit(1).alias("real")).join(n, [doc, section], "full")
    out = both.groupBy(doc).agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("real").isNull()).alias("unknown"))
    return out.where("missing + repeated + unknown > 0")


def mean_silhouette(pairs: DataFrame, rows: DataFrame, doc: str) -> DataFrame:
    """(doc, silhouette) of fixed labels: ``pairs`` (doc, i, j, distance), ``rows`` (doc, pos, label)."""
    both = pairs.select(doc, F.col("i").alias("pos"), F.col("j").alias("other"), "distance").unionByName(pairs.select(doc, F.col("j").alias("pos"), F.col("i").alias("other"), "distance"))
    to = both.join(rows.select(doc, F.col("pos").alias("other"), F.col("label").alias("to")), [doc, "other"]).groupBy(doc, "pos", "to").agg(F.avg("distance").alias("m"))
    per = rows.join(to, [doc, "pos"], "left").groupBy(doc, "pos", "label").agg(F.max(F.when(F.col("to") == F.col("label"), F.col("m"))).alias("a"), F.min(F.when(F.col("to") != F.col("label"), F.col("m"))).alias("b"))
    top: Column = F.greatest("a", "b")
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (top == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.when(top != 0, top))
    return per.groupBy(doc).agg(F.avg(value).alias("silhouette"))
