"""Classes of rows that share keys, directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.sources.shared import kept


def classes(links: DataFrame) -> DataFrame:
    """node, class (its least node) of every node of links (a, b). In each round the classes that a link joins
    give way to the least they meet, and chains of these are followed to their ends; rounds are few, for a class
    meets all its neighbours at once."""
    ends = kept(links.filter("a <> b").select("a", "b").distinct(), "links")
    labels = kept(ends.select(F.col("a").alias("node")).unionAll(ends.select("b")).distinct().withColumn("class", F.col("node")), "classes")
    while True:
        of = ends.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b").filter("ca <> cb")
        steps = kept(of.select(F.greatest("ca", "cb").alias("x"), F.least("ca", "cb").alias("y")).groupBy("x").agg(F.min("y").alias("y")), "steps")
        if steps.isEmpty():
            return labels
        while True:  # each step's end gives way too: double the way
            further = steps.join(steps.toDF("y", "z"), "y", "left")
            if further.filter("z IS NOT NULL").isEmpty():
                break
            steps = kept(further.select("x", F.coalesce("z", "y").alias("y")), "steps")
        labels = kept(labels.join(steps.toDF("class", "to"), "class", "left").select("node", F.coalesce("to", "class").alias("class")), "classes")
