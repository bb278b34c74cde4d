"""Connected components of a table of links, by label propagation with pointer jumping; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import HOT_ROWS, HOT_SHARE, Stage, join_split


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> Stage:
    """``node, label`` for each end of a link, label being the smallest node that links lead to.

    A round lowers each label to the least of its neighbours' and then to its label's label, so paths shorten by half or better.
    Labels are written every round.  Both joins have one row a key on one side; the rows of a hub and of a large component's label are split.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = Stage(ends.union(ends.select(F.col("v"), F.col("u"))).distinct(), "edges")
    labels = Stage(edges.df.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label"), F.count("*").alias("n")), "labels")
    nodes, n_ends = labels.df.agg(F.count("*"), F.sum("n")).first()
    hubs = [r[0] for r in labels.df.where(F.col("n") >= max(HOT_ROWS, HOT_SHARE * (n_ends or 0))).select(F.xxhash64("node")).collect()]
    hot: list[int] = []
    for _ in range(rounds):
        at = labels.df.select("node", "label")
        lower = join_split(edges.df, at.withColumnRenamed("node", "v"), "v", "u", hubs, "inner").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("least"))
        near = at.join(lower, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        jump = at.select(F.col("node").alias("label"), F.col("label").alias("far"))
        fresh = Stage(join_split(near, jump, "label", "node", hot, "left").select("node", "old", F.least("label", "far").alias("label")), "labels")
        # One row a label; the labels of many nodes are few.
        sizes = fresh.df.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("old") != F.col("label")).alias("moved"))
        many = F.when(F.col("n") >= max(HOT_ROWS, HOT_SHARE * nodes), F.xxhash64("label"))
        moved, hot = sizes.agg(F.sum("moved"), F.collect_list(many)).first()
        labels.drop()
        labels = fresh
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    edges.drop()
    labels.schema = labels.df.drop("old").schema
    return labels
