"""Merkle manifest: a digest of every record, of every group of records, and of the dataset.

A record's leaf is the SHA-256 of its fields, each ``-`` if null, else its length in UTF-8
bytes, ``:`` and its value.  The leaves of a group (``lang``) stand in the order of their id;
two consecutive nodes become the SHA-256 of their digests, joined as lowercase hex, and a last
single one that of its own, until one is left, the group's subroot.  The subroots in the order
of their groups (null first, then by UTF-8 bytes) give the root alike.

Subtree exchange: ``BLOCK`` consecutive nodes are a superblock, whose top is a node of the next
round.  Going up, every superblock is reduced by itself until each group has one node.  Going
down, the nodes of a superblock are cogrouped with the one row that its top got from above (its
siblings on the way to the root); the local reduction, the proofs and the folding are finished
there.  So a task holds one superblock, however large a group is: three rounds cover 2^30 nodes.
Texts are read once, by the leaves' expression; only digests are shuffled.

Places come from one range sort by (group, id, leaf) and a count for each range and group.  The
sorted leaves are written down first, so a repeated task sees the same places.

``presented`` is what a record is checked as: its proof is folded from that leaf, and the record
is ``verified`` if that leads to the root.

Defined results: a null id comes first and is presented as it is where ``presented`` is null;
equal ids stand in the order of their leaves; repeated rows are leaves of their own; null and
empty texts differ (``-`` and ``0:``); a group of one has its leaf as subroot, and a dataset of
one group its subroot as root; a record without siblings has the digest of nothing as proof; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.session import durable

#: Nodes of a superblock; a power of two.
BLOCK = 1024

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(fields: Iterable[Column]) -> Column:
    """The text whose digest is a leaf."""

    def one(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.concat(*[one(f) for f in fields])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(size: int, block: int) -> int:
    """Levels that one round reduces in a tree of ``size`` nodes."""
    return (min(size, block) - 1).bit_length()


def reduced(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of every level, from the given ones up."""
    found = [digests]
    for _ in range(levels):
        now = found[-1]
        found.append([digest("".join(now[k : k + 2])) for k in range(0, len(now), 2)])
    return found


def steps(levels: list[list[str]], place: int) -> list[str]:
    """The way up from a node: at each level its sibling, behind ``<`` or ``>`` for its side, or ``""``."""
    way = []
    for nodes in levels[:-1]:
        other = place ^ 1
        way.append(("<" if other < place else ">") + nodes[other] if other < len(nodes) else "")
        place >>= 1
    return way


def folded(leaf: str, way: Iterable[str]) -> str:
    """The root that a leaf and its way lead to."""
    for step in way:
        other = step[1:]
        leaf = digest(other + leaf if step[:1] == "<" else leaf + other)
    return leaf


def proof(way: Iterable[str]) -> str:
    """The digest of a way's siblings."""
    return digest("".join(step[1:] for step in way))


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Add ``place`` in the row's ``tree``, in the given order, and the tree's ``size``; written down."""
    by = ["tree", *order, "_row"]
    rows = durable(nodes.withColumn("_row", F.monotonically_increasing_id()))
    ranges = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row")
    # The number of a row holds its range in the upper bits and its place there in the lower ones.
    rows = durable(ranges.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    counts = rows.groupBy("tree", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    tree = W.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    starts = counts.select("tree", "_range", "_first", before.alias("_before"), F.sum("_n").over(tree).alias("size"))
    return (
        rows.join(starts, ["tree", "_range"])
        .withColumn("place", F.col("_before") + F.col("_at") - F.col("_first"))
        .drop("_range", "_at", "_first", "_before")
    )


def _block(block: int) -> Column:
    return F.shiftright("place", block.bit_length() - 1)


def _tops(nodes: DataFrame, block: int) -> DataFrame:
    """The nodes of the next round, one for each superblock."""

    def top(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        size, place = int(frame["size"].iloc[0]), int(frame["place"].iloc[0])
        node = reduced(frame["digest"].tolist(), height(size, block))[-1][0]
        return pd.DataFrame({"tree": frame["tree"].iloc[:1], "place": [place // block], "digest": [node], "size": [-(-size // block)]})

    return nodes.select("tree", "place", "digest", "size").groupBy("tree", _block(block).alias("block")).applyInPandas(top, "tree string, place long, digest string, size long")


def _ways(frame: pd.DataFrame, outer: pd.DataFrame, block: int) -> list[list[str]]:
    """The way to the root of every node of a superblock, which is sorted by place."""
    levels = reduced(frame["digest"].tolist(), height(int(frame["size"].iloc[0]), block))
    tail = list(outer["way"].iloc[0])
    return [steps(levels, k) + tail for k in range(len(frame))]


def _outer(nodes: DataFrame, above: DataFrame, block: int) -> DataFrame:
    """``(tree, place, way, subroot, root)`` of every node, from those of their superblocks' tops."""

    def finish(frame: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        frame, upper = frame.sort_values("place"), outer.iloc[0]
        ways = _ways(frame, outer, block)
        return pd.DataFrame({"tree": frame["tree"], "place": frame["place"], "way": ways, "subroot": upper["subroot"], "root": upper["root"]})

    return _cogrouped(nodes.select("tree", "place", "digest", "size"), above, block).applyInPandas(
        finish, "tree string, place long, way array<string>, subroot string, root string"
    )


def _cogrouped(nodes: DataFrame, above: DataFrame, block: int):
    return nodes.withColumn("block", _block(block)).groupBy("tree", "block").cogroup(above.withColumnRenamed("place", "block").groupBy("tree", "block"))


def _rounds(nodes: DataFrame, block: int) -> list[DataFrame]:
    """The nodes of every round, up to one node a tree."""
    rounds = [nodes]
    size = nodes.agg(F.max("size")).first()[0] or 0
    while size > 1:
        rounds.append(durable(_tops(rounds[-1], block)))
        size = -(-size // block)
    return rounds


def manifest(docs: DataFrame, presented: Column | None = None, group: str = "lang", fields: tuple[str, ...] = FIELDS, block: int = BLOCK) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every record.

    ``fields`` are the leaf's columns, the first one the id.  ``presented`` is the leaf that a
    record is checked with, or null for its own; ``encoded`` builds the text of one.
    """
    columns = [docs[f] for f in fields]
    own = F.sha2(encoded(columns), 256)
    # Bytewise order with null first, in one string that is never null.
    tree = F.coalesce(F.concat(F.lit("="), docs[group].cast("string")), F.lit("-"))
    shown = F.lit(None).cast("string") if presented is None else presented
    leaves = placed(docs.select(tree.alias("tree"), columns[0].alias("doc_id"), own.alias("digest"), shown.alias("presented")), ["doc_id", "digest"])
    rounds = _rounds(leaves, block)

    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    roots = placed(subroots, ["name"])
    upper = _rounds(roots, block)
    above = upper[-1].select(
        "tree", "place", F.array().cast("array<string>").alias("way"), F.lit("").alias("subroot"), F.col("digest").alias("root")
    )
    for nodes in reversed(upper[:-1]):
        above = durable(_outer(nodes, above, block))
    above = above.join(roots, ["tree", "place"]).select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "way", F.col("digest").alias("subroot"), "root"
    )
    for nodes in reversed(rounds[1:-1]):
        above = durable(_outer(nodes, above, block))

    def finish(frame: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        frame, upper = frame.sort_values("place"), outer.iloc[0]
        ways = _ways(frame, outer, block)
        ends = [folded(shown or own, way) for own, shown, way in zip(frame["digest"], frame["presented"], ways, strict=True)]
        return pd.DataFrame(
            {
                "doc_id": frame["doc_id"],
                "leaf": frame["digest"],
                "subroot": upper["subroot"],
                "root": upper["root"],
                "proof_sha256": [proof(way) for way in ways],
                "folded_root": ends,
                "verified": [end == upper["root"] for end in ends],
            }
        )

    # As text, since pandas has no integers with nulls.
    kind = docs.schema[fields[0]].dataType
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    found = _cogrouped(leaves.withColumn("doc_id", F.col("doc_id").cast("string")), above, block).applyInPandas(finish, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))
