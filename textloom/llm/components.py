"""Connected components by concurrent breadth-first search from many seeds, and splits that follow them.

Adjacency rows are partitioned by a hash of their node. Every node whose hash is smaller than those of
all its neighbours is a seed, so each component has one at least, and the distance to the next seed
stays small also in long chains. All seeds expand at once; a node takes the smallest seed that reaches
it first. Edges between nodes of two seeds - collisions - form a smaller graph of seeds, at most half
the size, which is solved in the same way until no collision is left. Nothing of the graph ever comes
to the driver but a count; each round is a table in the shared folder, so a lost executor costs a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..workspace import dropped, written



def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (src long, dst long); component is its smallest node.

    Rows with a null end are ignored; a row that links a node with itself makes a component of that node
    if nothing else holds it; repeated rows count once; no rows give no rows.
    """
    spark = edges.sparkSession
    ends = edges.where("src is not null and dst is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    adjacent, path = written(
        ends.select(F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))).alias("e")).select("e.*").distinct(),
        "graph-adjacent",
    )
    label, old = _solve(adjacent)
    lowest = label.groupBy("seed").agg(F.min("node").alias("component"))
    out, _ = written(label.join(lowest, "seed").select("node", "component"), "graph-components")
    dropped(spark, path, *old)
    return out


def _solve(adjacent: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, seed) with one seed for each component of adjacency rows (u, v), and the tables it made."""
    spark = adjacent.sparkSession
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    # a seed comes before all its neighbours in hash order
    seeds = (
        adjacent.groupBy("u").agg(F.min(F.when(F.col("u") != F.col("v"), order("v"))).alias("first"))
        .where(F.col("first").isNull() | (order("u") < F.col("first")))
        .select(F.col("u").alias("node"), F.col("u").alias("seed"))
    )
    front, path = written(seeds, "graph-front")
    paths, visited = [path], front
    links = adjacent.where("u <> v")
    while True:
        reached = (
            front.join(links, front["node"] == links["u"]).groupBy("v").agg(F.min_by("seed", F.struct(F.xxhash64("seed"), F.col("seed"))).alias("seed"))
            .withColumnRenamed("v", "node").join(visited.select("node"), "node", "left_anti")
        )
        front, path = written(reached, "graph-front")
        paths.append(path)
        if front.isEmpty():
            break
        visited = visited.unionByName(front)
    label, path = written(visited, "graph-label")
    old = [*paths]
    ends = (
        links.where("u < v").join(label.select(F.col("node").alias("u"), F.col("seed").alias("a")), "u")
        .join(label.select(F.col("node").alias("v"), F.col("seed").alias("b")), "v").where("a <> b")
    )
    collisions, at = written(ends.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*").distinct(), "graph-collisions")
    dropped(spark, *old)
    if collisions.isEmpty():
        return label, [path, at]
    upper, more = _solve(collisions)
    merged = label.join(upper.select(F.col("node").alias("seed"), F.col("seed").alias("top")), "seed", "left").select("node", F.coalesce("top", "seed").alias("seed"))
    merged, top = written(merged, "graph-label")
    dropped(spark, path, at, *more)
    return merged, [top]


def split_by_component(rows: DataFrame, component: str, shares: dict[str, float], buckets: int = 1 << 16) -> DataFrame:
    """``rows`` with a column ``split``: whole components, dealt in hash order to meet ``shares`` of the rows.

    Components in hash order fill the splits one after another; a component goes where its middle row
    falls. A component larger than the smallest share can't sit in a small split, so such components
    come first in the order and fill the first split. Running totals need no global sort: rows are counted by
    ``buckets`` ranges of the hash, the totals of at most ``buckets`` rows are summed up in one task,
    and only components of one bucket are ordered among themselves.
    """
    names, limits, total = list(shares), [], 0.0
    for name in names:
        total += shares[name]
        limits.append(total)
    least = min(shares.values()) / total
    size = rows.groupBy(component).agg(F.count("*").alias("_n"))
    count = size.agg(F.sum("_n").alias("_all"))  # one row
    size = size.crossJoin(F.broadcast(count)).withColumn("_h", F.xxhash64(F.col(component)))
    size = size.withColumn("_bucket", F.when(F.col("_n") > least * F.col("_all"), F.lit(-1)).otherwise(F.pmod(F.col("_h"), F.lit(buckets)).cast("int")))
    before = size.groupBy("_bucket").agg(F.sum("_n").alias("_sum"))
    before = before.select("_bucket", (F.sum("_sum").over(Window.partitionBy().orderBy("_bucket")) - F.col("_sum")).alias("_before"))
    inner = Window.partitionBy("_bucket").orderBy("_h", component)
    placed = size.join(F.broadcast(before), "_bucket").withColumn("_mid", (F.col("_before") + F.sum("_n").over(inner) - F.col("_n") / 2) / F.col("_all") * total)
    split = F.lit(names[-1])
    for name, limit in list(zip(names, limits))[-2::-1]:
        split = F.when(F.col("_mid") <= limit, F.lit(name)).otherwise(split)
    # the over-large components all go to the first split
    split = F.when(F.col("_bucket") == -1, F.lit(names[0])).otherwise(split)
    return rows.join(placed.select(component, split.alias("split")), component)
