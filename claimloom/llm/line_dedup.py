"""Line dedup by content-defined chunks of lines, in Spark expressions.

A text's lines are hashed, and a rolling hash runs over the hashes of ``WINDOW`` lines; where
it is 0 modulo ``DIVISOR`` a chunk ends.  A line of ``LONG_LINE`` characters (some 25 words) or more
is a chunk of its own.  A boundary depends on the lines next to it alone, so equal passages are
cut alike wherever they stand.  A chunk of at least two lines with something in them, or of
``LONG_LINE`` characters, that occurs more than once in all texts stays at its first place
(smallest id, then place) and goes elsewhere.  So passages of long lines go whole, from one line on;
of passages of short lines those at the ends, up to the first and from the last chunk's end, may stay,
and single lines between two boundaries (one in nine).

Occurrences are counted by the chunks' bytes, added up before the shuffle, so neither the
chunk that a third of all documents hold nor its copies are gathered.  Decisions then travel
by two 64-bit keys of the chunk.  If two different chunks ever had both keys in common, the
byte comparison shows it and both stay.

Defined results: null text stays null with no lines; an empty text is one empty line; very
long texts are handled whole; rows alike in id and text count as one document and are changed
alike; null ids come first; an empty table gives an empty result.  Only the id and text
columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 2
DIVISOR = 3
LEAST_LINES = 2
LONG_LINE = 150


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is formed once, however often it is read inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _chunks(text: Column) -> Column:
    """Structs of first line (from 0), lines, and the chunk's text."""

    def cut(lines: Column, hashes: Column, long: Column) -> Column:
        n = F.size(lines)

        def ends(k: Column) -> Column:
            rolled = F.aggregate(F.slice(hashes, k - WINDOW + 2, F.lit(WINDOW)), F.lit(0).cast("long"), lambda t, h: (t * 31 + h) % 1_000_003)
            return (k == n - 1) | F.get(long, k) | F.get(long, k + 1) | ((k >= WINDOW - 1) & (rolled % DIVISOR == 0))

        return _once(F.filter(F.sequence(F.lit(0), n - 1), ends), lambda last: F.transform(last, lambda end, k: chunk(lines, last, end, k)))

    def chunk(lines: Column, last: Column, end: Column, k: Column) -> Column:
        begin = F.when(k == 0, F.lit(0)).otherwise(F.get(last, k - 1) + 1)
        own = F.slice(lines, begin + 1, end - begin + 1)
        full = F.size(F.filter(own, lambda x: F.trim(x) != ""))
        return F.struct(begin.alias("first"), (end - begin + 1).alias("n"), full.alias("full"), F.array_join(own, "\n").alias("chunk"))

    def long_ones(lines: Column) -> Column:
        return F.transform(lines, lambda x: F.length(x) >= LONG_LINE)

    return _once(
        F.split(text, "\n", -1),
        lambda lines: _once(F.transform(lines, line_hash), lambda hashes: _once(long_ones(lines), lambda long: cut(lines, hashes, long))),
    )


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return rows.withColumns({"r1": F.xxhash64("text"), "r2": F.xxhash64(F.lit(7), "text")})


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_lines, removed_lines, text`` of every document."""
    rows = _keyed(docs, text, doc_id)
    chunks = rows.where("text is not null").select("doc_id", "r1", "r2", F.explode(_chunks(F.col("text"))).alias("c")).select("doc_id", "r1", "r2", "c.*").where((F.col("full") >= LEAST_LINES) | (F.length("chunk") >= LONG_LINE))
    chunks = chunks.withColumns({"k1": F.xxhash64("chunk"), "k2": F.xxhash64(F.lit(7), "chunk")})
    place = F.struct("doc_id", "r1", "r2", "first")
    counted = chunks.groupBy("k1", "k2", "chunk").agg(F.count("*").alias("n"), F.min(place).alias("keeps"))
    repeated = counted.groupBy("k1", "k2").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.min("keeps").alias("keeps")).where("texts = 1 and n > 1")
    others = chunks.select("doc_id", "r1", "r2", "first", "n", "k1", "k2").join(repeated.select("k1", "k2", "keeps"), ["k1", "k2"]).where(~place.eqNullSafe(F.col("keeps")))
    removed = others.groupBy("doc_id", "r1", "r2").agg(F.sort_array(F.collect_set(F.struct("first", "n"))).alias("removed"))
    gone = removed.select(F.col("doc_id").alias("_id"), F.col("r1").alias("_r1"), F.col("r2").alias("_r2"), "removed")
    met = rows.join(gone, rows["r1"].eqNullSafe(gone["_r1"]) & (rows["r2"] == gone["_r2"]) & rows["doc_id"].eqNullSafe(gone["_id"]), "left")
    met = met.withColumn("lines", F.split("text", "\n", -1)).withColumn("removed", F.coalesce("removed", F.expr("cast(array() as array<struct<first: int, n: int>>)")))

    def kept(_: Column, k: Column) -> Column:
        begin = F.when(k == 0, F.lit(0)).otherwise(F.get("removed", k - 1)["first"] + F.get("removed", k - 1)["n"])
        end = F.when(k == F.size("removed"), F.size("lines")).otherwise(F.get("removed", k)["first"])
        return F.slice("lines", begin + 1, end - begin)

    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size("removed")), kept))
    text_left = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    gone_lines = F.aggregate("removed", F.lit(0), lambda t, r: t + r["n"]).cast("long")
    return met.select("doc_id", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), gone_lines.alias("removed_lines"), text_left.alias("text"))
