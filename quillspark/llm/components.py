"""Connected components of an edge table, by DataFrame operations only."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.session import cut, drop_cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    Alternates two contractions until nothing moves: each node's larger
    neighbours go to the smallest neighbour, then its smaller ones do. Both
    keep components and at most as many edges as before. Minima are summed
    map-side; the edges of a hub meet its minimum in a join by the hub, which
    adaptive execution splits where it is skewed. Rounds grow with the logarithm
    of a component's diameter. Each round is written to the shared folder. Null ends are passed over; loops and repeated edges are harmless.
    """
    flat = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    now = cut(flat)
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").distinct()
        less = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(less, "v")
        step = small.select(F.col("m").alias("u"), "v").union(small.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
        then = cut(step)
        mark = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_cut(now)
        now = then
        if mark == before:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        before = mark
