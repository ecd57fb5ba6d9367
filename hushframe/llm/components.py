"""Connected components of a table of links, by shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.scratch import cut, drop


def components(links: DataFrame) -> DataFrame:
    """``v, comp`` for each end of ``links`` (columns ``a``, ``b``); ``comp`` is the smallest end that is reachable.

    Every round gives each vertex the smallest label among its neighbours and then that label's own label, which
    halves the way to the root; it ends when no label changes.
    """
    both = cut(links.select(F.col("a").alias("v"), F.col("b").alias("u")).union(links.select("b", "a")).where("v <> u").distinct())
    label = label_table = cut(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("comp")))
    while True:
        near = both.join(label.select(F.col("v").alias("u"), "comp"), "u").groupBy("v").agg(F.min("comp").alias("near"))
        step = label.join(near, "v").select("v", F.col("comp").alias("was"), F.least("comp", "near").alias("next"))
        root = label.select(F.col("v").alias("next"), F.col("comp").alias("root"))
        new = cut(step.join(root, "next", "left").select("v", "was", F.least("next", F.coalesce("root", "next")).alias("comp")))
        drop(label_table)
        label, label_table = new.select("v", "comp"), new
        if not new.where("comp <> was").limit(1).count():
            drop(both)
            return label
