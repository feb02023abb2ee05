"""Mixing sources to target weights by capped water-filling, in Spark expressions.

Every source wants a share of the total size by its weight, but is repeated ``epochs`` times
at most.  Sources above that are clamped and their excess is shared by weight among the
others, until none is above.  Then ``target / source size`` repetitions are sampled: the
whole ones are taken of every document, the fractional one, if anything is left to take, of the
documents that come first in a seeded order, up to the document with which the source's words
come nearest to the target.  So no document is taken more than ``epochs`` times.

A document's place in that order is a hash, so the sample of a source is given by one number,
the last place that is taken.  It is found without ordering a source: documents fall into
4,096 buckets of their place, buckets are added up before the shuffle, and only the bucket
in which a source reaches its target is put in order.  A source with a third of all rows is
a few thousand sums.  What returns to the documents is one row a source, joined by source.

Defined results: a null source is a source of its own, last; null or empty texts have size 0;
rows alike in id and text are taken alike; a source of size 0 has target 0 and nothing is taken of it; sums are whole
numbers and targets are formed in one order, so reruns agree; an empty table gives an empty
result.  Other columns are not read by ``mix`` and returned as they are by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.session import durable

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 20
_BUCKET_BITS = 12
_PLACE_BITS = 60


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def seeded(seed: int, *columns: Column) -> Column:
    """A whole number below 2^60 from a hash of the columns; null is told from empty."""
    told = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *told).cast("binary")), 1, 15), 16, 10).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """Sources with their rank by code point from 0, null last.

    Ranks are taken within ranges and moved on by the sizes of the ranges before: a running sum
    over one row for each partition.
    """
    last = F.col("source").isNull()
    ranged = durable(sources.repartitionByRange(last, "source").withColumn("part", F.spark_partition_id()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(last, "source")) - 1
    return ranged.withColumn("own", own).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("own")).drop("part", "own", "start")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row a source.

    Each round is one aggregation over the sources; the level of the water only rises, so the
    rounds end when no further source is clamped.
    """
    repeated = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    ranked = durable(numbered(sizes).withColumn("weight", repeated.cast("long")).withColumn("cap", F.col("source_size") * epochs))

    def sums(clamped: Column) -> tuple[int, int]:
        row = ranked.agg(
            (F.sum("source_size") - F.coalesce(F.sum(F.when(clamped, F.col("cap"))), F.lit(0))).alias("rest"),
            F.sum(F.when(~clamped, F.col("weight"))).alias("weight"),
        ).first()
        return row["rest"] or 0, row["weight"] or 1

    level = sums(F.lit(False))
    while True:
        share = F.col("weight") * F.lit(float(level[0])) / F.lit(float(level[1]))
        risen = sums(share > F.col("cap"))
        if risen == level:
            return ranked.select("source", "source_size", F.least(share, F.col("cap").cast("double")).alias("target"))
        level = risen


def _placed(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumn("_place", seeded(seed, F.col("_doc_id"), F.col("_text")))


def _shares(rows: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """By source: size, target, whole repetitions, and the last place of the fractional one."""
    rows = rows.withColumn("bucket", F.shiftright("_place", _PLACE_BITS - _BUCKET_BITS))
    sums = durable(rows.groupBy("_source", "bucket").agg(F.sum("size").alias("size")))
    shares = targets(sums.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size")), weights, epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = shares.withColumn("whole", F.floor(ratio).cast("long"))
    shares = durable(shares.withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size")))
    # The bucket in which the words of the fractional repetition reach what is wanted.
    earlier = Window.partitionBy("_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    edge = sums.join(shares, sums["_source"].eqNullSafe(shares["source"])).where("wanted > 0 and before <= wanted and wanted < before + size")
    edge = durable(edge.select("source", F.col("bucket").alias("edge"), "before", "wanted"))
    # Its documents in order: the one that crosses is taken if that brings the sum nearer.
    inside = rows.join(edge, rows["_source"].eqNullSafe(edge["source"]) & (rows["bucket"] == edge["edge"]))
    inside = inside.groupBy("source", "before", "wanted", "_place").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("source").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("reached", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = inside.where("reached + size / 2 <= wanted").groupBy(F.col("source").alias("_last_source")).agg(F.max("_place").alias("last"))
    edge = edge.select(F.col("source").alias("_edge_source"), "edge")
    shares = shares.join(edge, shares["source"].eqNullSafe(edge["_edge_source"]), "left")
    shares = shares.join(last, shares["source"].eqNullSafe(last["_last_source"]), "left")
    below = F.shiftleft("edge", _PLACE_BITS - _BUCKET_BITS) - 1
    return durable(shares.select(F.col("source").alias("_of"), "source_size", "target", "whole", F.coalesce("last", below, F.lit(-1)).alias("_last")))


def _copies(rows: DataFrame, shares: DataFrame) -> DataFrame:
    met = rows.join(shares, rows["_source"].eqNullSafe(shares["_of"]))
    return met.withColumn("copies", F.col("whole") + (F.col("_place") <= F.col("_last")).cast("long"))


def _sized(docs: DataFrame, text: str, doc_id: str, source: str, seed: int) -> DataFrame:
    rows = docs.select(docs[doc_id].alias("_doc_id"), docs[text].alias("_text"), docs[source].alias("_source"))
    return durable(_placed(rows, seed).withColumn("size", word_count(F.col("_text"))).drop("_text"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every document."""
    rows = _sized(docs, text, doc_id, source, seed)
    found = _copies(rows, _shares(rows, weights, epochs))
    return found.select(F.col("_doc_id").alias("doc_id"), F.col("_source").alias("source"), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with all its columns."""
    shares = _shares(_sized(docs, text, doc_id, source, seed), weights, epochs)
    own = docs.select("*", docs[doc_id].alias("_doc_id"), docs[text].alias("_text"), docs[source].alias("_source"))
    found = _copies(_placed(own, seed).drop("_text"), shares).where("copies > 0")
    return found.withColumn("_copy", F.explode(F.expr("sequence(1L, copies)"))).select(*[docs[c] for c in docs.columns])
