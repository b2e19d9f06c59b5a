"""Connected components of a link table, by min-label propagation with pointer jumping.

Labels and links stay in files; the driver only sees whether a round changed anything.

Defined cases: repeated links, links in both directions and links of an id with itself count once; a link with a
null id is none; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark


def components(links: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every id in links (a, b); each round is written, so a lost executor costs one round."""
    links = links.where("a IS NOT NULL AND b IS NOT NULL")
    both = _spark.cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "cc-links")
    labels = _spark.cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")).withColumnRenamed("u", "id"), "cc-0")
    while True:
        near = both.join(labels, both["v"] == labels["id"]).groupBy("u").agg(F.min("c").alias("m"))
        lower = labels.join(near, labels["id"] == near["u"]).select("id", "c", F.least("c", "m").alias("d"))
        jump = labels.select(F.col("id").alias("d"), F.col("c").alias("e"))
        step = _spark.cut(lower.join(jump, "d").select("id", "c", F.least("d", "e").alias("next")), "cc")
        labels = step.select("id", F.col("next").alias("c"))
        if step.where("next < c").isEmpty():
            return labels.select("id", F.col("c").alias("component"))
