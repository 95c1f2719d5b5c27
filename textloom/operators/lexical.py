"""Terms, TF-IDF and set similarity of sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..workspace import width, written


def terms(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., place, term): unigrams and bigrams with their places."""
    return df.select(*keys, F.posexplode(T.tokens(F.col(text))).alias("place", "term"))


def term_frequency(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., term, tf, first_place)."""
    return terms(df, keys, text).groupBy(*keys, "term").agg(F.count("*").alias("tf"), F.min("place").alias("first_place"))


def train_idf(tf: DataFrame, total: DataFrame, least: int = 2) -> DataFrame:
    """(term, df, idf): ln(N / (1 + df)) of the terms in at least ``least`` sections; ``total`` is one row (n)."""
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    return df.crossJoin(F.broadcast(total)).select("term", "df", F.ln(F.col("n") / (1 + F.col("df"))).alias("idf"))


def tfidf(tf: DataFrame, idf: DataFrame) -> DataFrame:
    """``tf`` with weight (1 + ln tf) idf; a term without an idf weighs 0."""
    return tf.join(idf.select("term", "idf"), "term", "left").withColumn("weight", (1 + F.ln("tf")) * F.coalesce("idf", F.lit(0.0)))


def top_terms(weights: DataFrame, keys: list[str], k: int = 15) -> DataFrame:
    """The ``k`` heaviest terms of each section; of equals the one that occurs first."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("weight", 9)), "first_place", "term")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.when(union != 0, union))


def sparse_cosine(weights: DataFrame, doc: str) -> DataFrame:
    """(doc, i, j, cosine) of the section pairs of a document that share a term of weight; others are 0.

    The join is on (document, term): a common term meets only the sections of its own document.
    """
    w = weights.where("weight <> 0")
    norms = w.groupBy(doc, "pos").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    a = w.select(doc, "term", F.col("pos").alias("i"), F.col("weight").alias("wa"))
    b = w.select(doc, "term", F.col("pos").alias("j"), F.col("weight").alias("wb"))
    dots = a.join(b, [doc, "term"]).where("i < j").groupBy(doc, "i", "j").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    na, nb = norms.select(doc, F.col("pos").alias("i"), F.col("norm").alias("na")), norms.select(doc, F.col("pos").alias("j"), F.col("norm").alias("nb"))
    return dots.join(na, [doc, "i"]).join(nb, [doc, "j"]).select(doc, "i", "j", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


def term_counts(df: DataFrame, keys: list[str], text: str, vocabulary: DataFrame) -> DataFrame:
    """(keys..., length, counts): number of unigrams and bigrams, and how often each word of ``vocabulary`` (term) occurs; texts without words are left out.

    Rows already partitioned by ``keys`` stay where they are.
    """
    words = df.select(*keys, F.explode(T.unigrams(F.col(text))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    words = words.join(F.broadcast(vocabulary.select("term", F.lit(True).alias("known"))), "term", "left")
    known = F.collect_list(F.when(F.col("known"), F.struct("term", "tf")))
    return words.groupBy(*keys).agg((2 * F.sum("tf") - 1).alias("length"), F.map_from_entries(known).alias("counts"))


#: Queries in one broadcast at most; more are scored block by block.
QUERY_BLOCK = 200_000
#: Pairs of a query and a text that share a term, in a task.
TASK_HITS = 4_000_000


def bm25(counts: DataFrame, keys: list[str], query_terms: DataFrame, places: int, k1: float = 1.2, b: float = 0.75, block: int = QUERY_BLOCK) -> DataFrame:
    """(q, keys..., score) of texts that hold a term of the query (q, term), rounded to ``places``; ``counts`` is a table of ``term_counts`` over the queries' terms.

    A text meets each distinct set of terms once, at the first of the set's terms that it holds, with all of its counts at hand.
    So nothing is summed over an exchange, and what is moved grows with the texts and the queries, not with their pairs.
    """
    spark = counts.sparkSession
    total = counts.agg(F.count("*").alias("n"), (F.sum("length") / F.count("*")).alias("mean_length"))
    df = counts.select(F.explode("counts").alias("term", "tf")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(total)).select("term", "df", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    blocks = 1 + query_terms.select("q").distinct().count() // block
    sets = query_terms.distinct().join(idf, "term").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("term", "idf", "df"))).alias("terms"))
    sets = sets.groupBy(F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block"), "terms").agg(F.collect_list(F.struct("q")).alias("qs"))
    sets = sets.select("block", "terms", "qs", F.posexplode("terms").alias("at", "own")).select(
        "block", "own.*", F.slice("terms.term", F.lit(1), F.col("at")).alias("before"), F.slice("terms", F.col("at") + 2, F.size("terms")).alias("after"), "qs",
    )
    sets, _ = written(sets, "sets")
    hits = sets.agg(F.sum(F.col("df") * F.size("qs"))).first()[0] or 0
    texts = counts.dropna(subset=keys).crossJoin(F.broadcast(total)).select(*keys, "counts", (k1 * (1 - b + b * F.col("length") / F.col("mean_length"))).alias("norm"))
    texts = texts.repartition(max(width(spark), -(-hits // TASK_HITS)), *keys).select(*keys, "counts", "norm", F.explode("counts").alias("term", "tf"))

    def part(idf: Column, tf: Column) -> Column:
        return idf * tf * (k1 + 1) / (tf + F.col("norm"))

    def scored(sets: DataFrame) -> DataFrame:
        met = texts.join(F.broadcast(sets), "term").where(~F.exists("before", lambda x: F.col("counts")[x].isNotNull()))
        score = F.aggregate("after", part(F.col("idf"), F.col("tf")), lambda s, x: s + F.coalesce(part(x["idf"], F.col("counts")[x["term"]]), F.lit(0.0)))
        met = met.select(*keys, F.round(score, places).alias("score"), "qs")  # once a set, before the copies
        return met.select(*keys, "score", F.inline("qs")).select("q", *keys, "score")

    return reduce(DataFrame.union, [scored(sets.where(F.col("block") == i).select("term", "idf", "before", "after", "qs")) for i in range(blocks)])
