"""Connected components of a table of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every end of ``edges`` (a, b): the smallest id it can reach.

    Labels start at the smallest neighbour; each round takes the neighbours' smallest label and
    then the label's own label, so paths shorten by more than half. A round joins stored tables
    only: the unique label table against the links, whose hot keys AQE can split. Self-links and
    repeated links are harmless; without links the table is empty.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = stored(both.union(both.select("v", "u")).distinct(), "links")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("component")), "labels")
    total = _total(labels)
    while total is not None:
        near = both.join(labels.withColumnRenamed("id", "v"), "v").select(F.col("u").alias("id"), "component")
        least = stored(near.union(labels).groupBy("id").agg(F.min("component").alias("component")), "labels")
        jump = least.select(F.col("id").alias("component"), F.col("component").alias("_further"))
        old, labels = labels, stored(least.join(jump, "component").select("id", F.least("component", "_further").alias("component")), "labels")
        discard(old, least)
        before, total = total, _total(labels)
        if total == before:
            break
    discard(both)
    return labels


def _total(labels: DataFrame):
    """Labels only fall, so an equal sum means that none changed."""
    return labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
