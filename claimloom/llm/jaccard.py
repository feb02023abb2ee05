"""N-gram Jaccard join: prefix, length, positional and suffix filters, then exact checks.

Every text becomes the set of its distinct word n-grams (lower-cased A-Z; a shorter text
is one n-gram of all its words).  Texts with equal sets form a class.  Two classes link when
100 * intersection >= percent * union; a component is what links connect.

1. *Order.*  Counts of all n-grams go into a table of 2^23 counters, whatever the input's
   size.  N-grams sort by the scale of their counter, then by key: rare first.  The filters
   are right under any order that all texts share, so a counter shared by several n-grams
   costs time and never a link.
2. *Prefixes.*  Two sets that link share an n-gram among the first
   ``size - ceil(size * percent / 100) + 1`` of each.  One row per class and prefix n-gram
   is sorted by range over (n-gram, size, hash), so a very common n-gram spreads over tasks.
   The task that holds a list of at most ``_SHORT`` classes whole gives all its pairs at once, so the
   many lists of texts that share an n-gram by chance are not read again by what follows.
3. *Neighbours.*  In an eighth of the longer lists, and then, while that still links anything,
   in all of them that hold several components, every class is compared with the one before it and
   with the list's hub, the class that has the n-gram nearest to its front.  A hub has the
   fewest n-grams of its own, so it is the middle of a group of near copies: such groups are
   joined by a number of pairs that grows with the rows and not with the square of a group.
4. *The rest.*  What step 3 left in different components is joined in full: the pairs of the short
   lists, and in longer ones that still hold two components, first (component, size) with (component,
   size), where the positional filter holds for the best member of each, then the members that pass it.
   Pairs inside one component are not checked, and no link between components is lost.
5. *Check.*  A pair must pass the length and positional filters, the suffix filter (counts
   of n-grams by 64 ranges of the key bound the symmetric difference from below), and the
   exact count of common n-grams.  Each pair is checked once, and only classes and documents of
   pairs are moved for it.

Components use ``graph.components`` over class numbers.

Defined results: null or wordless texts are in no class, have no n-grams and are their own
component; null ids take part in links and never name a component, unless it has no other;
repeated rows are in one class; an empty table gives an empty result.  Only the id and text
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from claimloom.llm import words as w
from claimloom.llm.graph import components
from claimloom.session import durable

SKETCH_BITS = 23
#: Bytes of text that a Python worker splits at once.
_SLICE_BYTES = 1 << 19
_SKETCH_PIECES = 64
#: Groups of tasks whose counters are summed first.
_SKETCH_GROUPS = 8
_RANGES = 64
#: What a posting holds of an n-gram's key.  Two n-grams that share it cost time and no link, and zeros shuffle for less.
_TOKEN = np.uint64(0xFFFFFFFFFF000000)
#: Lists of so many classes at most are compared in full where they are sorted: 3.5 pairs a posting.
_SHORT = 8
#: The share of lists that the first round goes through, and the most rounds.
_FIRST_SHARE = 8
_ROUNDS = 4
#: The least and most bits of the table that finds the classes and documents of a check.
_KEY_BITS = (10, 28)


@dataclass(frozen=True)
class Similarity:
    n: int = 5
    percent: int = 80


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram keys of all rows, sorted and distinct within a row, and where rows begin."""
    words = w.split(texts, lower=True)
    counts = words.counts
    keys = w.runs(words.keys, n)
    row = np.repeat(np.arange(len(counts)), counts)
    whole = row[: len(keys)] == row[n - 1 :] if len(keys) else np.zeros(0, bool)
    keys, of = keys[whole], row[: len(whole)][whole]
    short = [(r, w.runs(words.keys[words.first[r] : words.first[r + 1]], int(counts[r]))[0]) for r in np.flatnonzero((counts > 0) & (counts < n))]
    if short:
        at = np.array([x[0] for x in short])
        places = np.searchsorted(of, at)
        keys, of = np.insert(keys, places, np.array([x[1] for x in short], np.uint64)), np.insert(of, places, at)
    first = np.searchsorted(of, np.arange(len(counts) + 1))
    sets = [np.unique(keys[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    sizes = np.array([len(x) for x in sets], np.int64)
    return (np.concatenate(sets) if sets else keys), np.concatenate(([0], np.cumsum(sizes)))


def _set_keys(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each row's set."""
    sums = [np.concatenate(([np.uint64(0)], np.cumsum(w.mix(keys ^ np.uint64(salt)), dtype=np.uint64))) for salt in (0x51ED2701, 0xA0761D64)]
    a, b = ((x[first[1:]] - x[first[:-1]]).view(np.int64) for x in sums)
    return a, b


def prefix_length(size: int, percent: int) -> int:
    return size - -(-size * percent // 100) + 1


def count_scales(docs: DataFrame, n: int) -> np.ndarray:
    """For each of 2^SKETCH_BITS key ranges, the scale of its number of n-grams, as bytes.

    Every task adds into one table, up to 255 each, and passes it on in pieces; pieces are summed
    in two steps, so that no group holds more than a share of the tasks, up to 65,535 in the first.
    The result has a fixed size, and only its order matters.
    """
    width = (1 << SKETCH_BITS) // _SKETCH_PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SKETCH_BITS, np.uint8)
        for batch in batches:
            for _, part in w.slices(batch.column(0), _SLICE_BYTES):
                counters, own = np.unique(shingle_sets(part, n)[0] >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                table[counters] = np.minimum(own + table[counters], 255)
        if table.any():
            group = TaskContext.get().partitionId() % _SKETCH_GROUPS
            for k in range(_SKETCH_PIECES):
                piece = table[k * width : (k + 1) * width].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([group], pa.int32()), pa.array([piece], pa.binary())], ["piece", "part", "counts"])

    def total_of(table: pa.Table, kind: type) -> np.ndarray:
        total = np.zeros(width, np.uint32)
        for x in table["counts"]:
            total += np.frombuffer(x.as_py(), kind)
        return total

    def add(table: pa.Table) -> pa.Table:
        total = np.minimum(total_of(table, np.uint8), 65535).astype(np.uint16)
        return pa.table({"piece": table["piece"][:1], "part": table["part"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    def scale(table: pa.Table) -> pa.Table:
        total = total_of(table, np.uint16)
        scales = np.floor(2 * np.log2(total + 1.0)).astype(np.uint8)
        return pa.table({"piece": table["piece"][:1], "scales": pa.array([scales.tobytes()], pa.binary())})

    kind = "piece int, part int, counts binary"
    summed = docs.select("text").mapInArrow(count, kind).groupBy("piece", "part").applyInArrow(add, kind)
    rows = summed.groupBy("piece").applyInArrow(scale, "piece int, scales binary").collect()
    pieces = {r["piece"]: np.frombuffer(r["scales"], np.uint8) for r in rows}
    return np.concatenate([pieces.get(k, np.zeros(width, np.uint8)) for k in range(_SKETCH_PIECES)])


def with_sets(docs: DataFrame, like: Similarity, scales: np.ndarray) -> DataFrame:
    """By document: size and keys of its set, rarest n-grams first, and counts by key range; written down."""
    order = docs.sparkSession.sparkContext.broadcast(scales)
    shift = np.uint64(64 - SKETCH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = order.value
        for batch in batches:
            for at, part in w.slices(batch.column(1), _SLICE_BYTES):
                keys, first = shingle_sets(part, like.n)
                sizes = np.diff(first)
                scale = table[(keys >> shift).astype(np.int64)]
                prefixes = []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    rare = np.argsort(scale[a:b], kind="stable")[: prefix_length(int(b - a), like.percent) if b > a else 0]
                    prefixes.append(keys[a:b][rare] & _TOKEN)
                row = np.repeat(np.arange(len(sizes)), sizes)
                ranges = np.bincount(row * _RANGES + (keys & np.uint64(_RANGES - 1)).astype(np.int64), minlength=len(sizes) * _RANGES)
                ka, kb = _set_keys(keys, first)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in prefixes]))).astype(np.int32)
                flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(part)), pa.array(sizes), pa.array(ka), pa.array(kb),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(ranges) + 1, _RANGES, dtype=np.int32)), pa.array(np.minimum(ranges, 127).astype(np.int8))),
                    ],
                    ["doc_id", "n_shingles", "ka", "kb", "prefix", "ranges"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    written = durable(docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, ka long, kb long, prefix array<long>, ranges array<tinyint>"))
    order.destroy()
    return written


_POSTING = ["token", "class", "size", "place", "component"]
_HUB = [f"hub_{c}" for c in _POSTING[1:]]


def _in_lists(percent: int):
    """Of sorted postings, the long lists, and of short ones the pairs that pass the length and positional filters.

    A pair is a row with its second class in ``other``.  A partition's first and last list may go on
    elsewhere, so they count as long; a list of one class goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4  # the last list while it is short
        loose = None  # the n-gram whose postings are shown as they come

        def given(columns: list[np.ndarray], other: pa.Array) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds), other], [*_POSTING[:4], "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.concatenate((h, batch.column(n).to_numpy())) for h, n in zip(held, _POSTING[:4], strict=True)]
            token, name, size, place = columns
            loose = token[0] if loose is None else loose
            opens = np.concatenate(([True], token[1:] != token[:-1]))
            of = np.cumsum(opens) - 1
            long = (np.bincount(of)[of] > _SHORT) | (token == loose)
            last = of == of[-1]
            if long.any():
                yield given([c[long] for c in columns], pa.nulls(int(long.sum()), pa.int64()))
            i, j = [], []
            for gap in range(1, min(_SHORT, len(token))):
                at = np.flatnonzero((of[gap:] == of[:-gap]) & ~(long | last)[:-gap])
                i.append(at)
                j.append(at + gap)
            if i:
                i, j = np.concatenate(i), np.concatenate(j)
                good = _may_link(percent, size[i], place[i], size[j], place[j])
                pairs = np.unique(np.stack((np.minimum(name[i], name[j])[good], np.maximum(name[i], name[j])[good])), axis=1)
                zeros = np.zeros(pairs.shape[1], np.int64)
                yield given([zeros, pairs[0], zeros, zeros], pa.array(pairs[1]))
            loose = token[-1] if long[-1] else loose
            held = [c[last & ~long] for c in columns]
        if len(held[0]):
            yield given(held, pa.nulls(len(held[0]), pa.int64()))

    return run


def _may_link(percent: int, size: np.ndarray, place: np.ndarray, size_2: np.ndarray, place_2: np.ndarray) -> np.ndarray:
    """What ``_possible`` says, of arrays."""
    need = np.ceil((size + size_2) * percent / (100 + percent) - 1e-9)
    left = np.minimum(size - place, size_2 - place_2)
    return (np.minimum(size, size_2) * 100 >= np.maximum(size, size_2) * percent) & (left >= need)


def _hub() -> list[Column]:
    """Of a whole list, the class that has the n-gram nearest to its front; all columns come from one posting."""
    return [F.min_by(c, "place").alias(h) for c, h in zip(_POSTING[1:], _HUB, strict=True)]


def _met(percent: int):
    """Of sorted postings, the pairs of classes ``(a, b)`` to compare: with the one before, and with the list's hub.

    The hub comes with the postings, as a list that several tasks hold has one hub in all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_POSTING, *_HUB]
        carried = [np.zeros(0, np.int64)] * len(names)  # the last row of the list that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.concatenate((c, batch.column(n).to_numpy())).astype(np.int64) for c, n in zip(carried, names, strict=True)]
            token, own, hub = columns[0], columns[1 : len(_POSTING)], columns[len(_POSTING) :]
            next_to = np.flatnonzero(token[1:] == token[:-1])
            name, size, place, component = (np.concatenate((c[next_to + 1], c)) for c in own)
            name_2, size_2, place_2, component_2 = (np.concatenate((c[next_to], h)) for c, h in zip(own, hub, strict=True))
            good = (component != component_2) & _may_link(percent, size, place, size_2, place_2)
            pairs = np.unique(np.stack((np.minimum(name, name_2)[good], np.maximum(name, name_2)[good])), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])
            carried = [c[-1:] for c in columns]

    return run


def _possible(percent: int, size: Column, place: Column, size_2: Column, place_2: Column) -> Column:
    """Length filter, and positional filter: what may still come from a common n-gram on."""
    need = F.ceil((size + size_2) * percent / (100 + percent) - 1e-9)
    left = F.least(size - place, size_2 - place_2)
    return (F.least(size, size_2) * 100 >= F.greatest(size, size_2) * percent) & (left >= need)


def _suffix_possible(percent: int) -> Column:
    """Suffix filter: the symmetric difference is at least the sum over ranges of the differences.

    Counts stop at 127, which brings two of them nearer and never apart.
    """
    apart = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda t, x: t + x)
    need = F.ceil((F.col("size_a") + F.col("size_b")) * percent / (100 + percent) - 1e-9)
    return apart <= F.col("size_a") + F.col("size_b") - 2 * need


def _only(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key's hash is among those of ``wanted``, by a bit table.

    The table has eight bits for a key, and at most 2^28 in 2^22 rows (64 MB), so it can be broadcast
    at any input size.  It may let others through; it never holds one back.
    """
    bits = min(max((8 * wanted.count()).bit_length(), _KEY_BITS[0]), _KEY_BITS[1])
    spot = F.xxhash64(key).bitwiseAND((1 << bits) - 1)
    bits = (
        wanted.select(spot.alias("spot"))
        .groupBy(F.shiftright("spot", 6).alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits"))
    )
    marked = rows.withColumn("spot", spot).withColumn("cell", F.shiftright("spot", 6))
    hit = F.expr("(bits & shiftleft(1L, cast(spot & 63 as int))) != 0")
    return marked.join(F.broadcast(bits), "cell").where(hit).select(*rows.columns)


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, like: Similarity) -> tuple[DataFrame, DataFrame | None]:
    """The pairs ``(a, b)`` of classes that pass the suffix filter, and those whose sets link, by exact counts.

    Without any pair that passes, the second is None.
    """
    # Only classes that stand in a pair are shuffled; most stand in none.
    pairs = durable(pairs)
    known = classes.select("class", "size", "ranges", "doc_id", "ka", "kb")
    known = _only(known, "class", pairs.select(F.explode(F.array("a", "b")).alias("class")))
    side = lambda x: known.select(F.col("class").alias(x), F.col("size").alias(f"size_{x}"), F.col("ranges").alias(f"ranges_{x}"))
    pairs = durable(pairs.join(side("a"), "a").join(side("b"), "b").where(_suffix_possible(like.percent)).select("a", "b", "size_a", "size_b"))
    if pairs.isEmpty():
        return pairs, None
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    needed = durable(needed.join(known.select("class", "doc_id", "ka", "kb"), "class"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in w.slices(batch.column(1), _SLICE_BYTES):
                keys, first = shingle_sets(part, like.n)
                ka, kb = _set_keys(keys, first)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(ka), pa.array(kb), lists], ["doc_id", "ka", "kb", "grams"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = _only(docs, "doc_id", needed).mapInArrow(sets, f"doc_id {kind}, ka long, kb long, grams array<long>")
    same = made["ka"].eqNullSafe(needed["ka"]) & made["kb"].eqNullSafe(needed["kb"]) & made["doc_id"].eqNullSafe(needed["doc_id"])
    # One shuffle by class serves both sides of the pairs.
    made = made.join(needed, same).select("class", "grams").dropDuplicates(["class"])
    grams = lambda x: made.select(F.col("class").alias(x), F.col("grams").alias(f"grams_{x}"))
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    met = pairs.join(grams("b"), "b").join(grams("a"), "a").withColumn("common", common)
    links = met.where(F.col("common") * 100 >= (F.col("size_a") + F.col("size_b") - F.col("common")) * like.percent).select("a", "b")
    return pairs, durable(links)


def _ordered_pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("class", "class_2").alias("a"), F.greatest("class", "class_2").alias("b")).where("a != b").distinct()


def _named(linked: DataFrame) -> DataFrame:
    return components(linked.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnsRenamed({"node": "class"})


def _in_order(postings: DataFrame, seed: int) -> DataFrame:
    """The postings of each n-gram in order of size and a seeded hash; a very common one spreads over tasks."""
    spread = F.xxhash64(F.lit(seed), "token", "class")
    ordered = postings.repartitionByRange("token", "size", spread).sortWithinPartitions("token", "size", spread)
    return ordered.select(*[c for c in (*_POSTING, *_HUB) if c in postings.columns])


def _mixed(shared: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The postings of lists that hold several components, with their component and the list's hub."""
    listed = shared.select("token", "class", "size", "place").join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))
    # Only a smaller set's first n-grams can be the first in common, so a list needs one such posting.
    early = (F.col("size") - F.col("place")) * (100 + percent) >= F.col("size") * 2 * percent
    held = listed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(early).alias("early"), *_hub())
    return durable(listed.join(held.where("low < high and early").select("token", *_HUB), "token"))


def _across(listed: DataFrame, percent: int) -> DataFrame:
    """Pairs of postings in different components that the filters leave."""
    left = F.col("size") - F.col("place")
    held = listed.groupBy("token", "component", "size").agg(F.max(left).alias("left"))

    def fits(a: Column, b: Column) -> Column:
        """Whether members of the two sizes may link that have ``a`` and ``b`` n-grams left."""
        near = F.least("size", "size_2") * 100 >= F.greatest("size", "size_2") * percent
        return near & (F.least(a, b) * (100 + percent) >= (F.col("size") + F.col("size_2")) * percent)

    # What no size in the list can answer goes before components meet.
    best = listed.groupBy("token", "size").agg(F.max(left).alias("best")).withColumnsRenamed({"token": "token_2", "size": "size_2"})
    able = held.join(best, (F.col("token") == F.col("token_2")) & fits(F.col("left"), F.col("best")), "left_semi")
    other = able.select("token", *[F.col(c).alias(f"{c}_2") for c in ("component", "size", "left")])
    apart = (F.col("component") < F.col("component_2")) & fits(F.col("left"), F.col("left_2"))
    met = able.join(other, "token").where(apart).select("token", "component", "size", "component_2", "size_2", "left_2")
    met = met.join(listed, ["token", "component", "size"]).where(fits(left, F.col("left_2")))
    right = listed.select("token", F.col("component").alias("component_2"), F.col("size").alias("size_2"), F.col("class").alias("class_2"), F.col("place").alias("place_2"))
    met = met.join(right, ["token", "component_2", "size_2"])
    return met.where(_possible(percent, F.col("size"), F.col("place"), F.col("size_2"), F.col("place_2")))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose classes are not in one component."""
    side = lambda x: found.select(F.col("class").alias(x), F.col("component").alias(f"component_{x}"))
    named = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return named.where("component_a is null or component_b is null or component_a != component_b").select("a", "b")


def _components(postings: DataFrame, classes: DataFrame, docs: DataFrame, like: Similarity) -> DataFrame:
    """``(class, component)`` of the classes that link with another."""
    kinds = "token long, class long, size int, place int, other long"
    lists = durable(_in_order(postings, 0).mapInArrow(_in_lists(like.percent), kinds))
    shared = lists.where("other is null").drop("other")
    short = lists.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")).distinct()
    nothing = docs.sparkSession.createDataFrame([], "a long, b long")
    tried, links, found = nothing, nothing, _named(nothing)
    listed = shared.where(F.pmod(F.xxhash64("token"), F.lit(_FIRST_SHARE)) == 0).withColumn("component", F.col("class"))
    listed = listed.join(listed.groupBy("token").agg(*_hub()), "token")
    for k in range(1, _ROUNDS + 1):
        near = _in_order(listed, k).mapInArrow(_met(like.percent), "a long, b long").distinct()
        checked, more = _linked(near.join(tried, ["a", "b"], "left_anti"), classes, docs, like)
        tried = tried.union(checked.select("a", "b"))
        if k > 1 and (more is None or more.isEmpty()):
            break
        if more is not None:
            links = links.union(more)
            found = durable(_named(links))
        # Components only grow: a list that held one before holds one now.
        listed = _mixed(shared if k == 1 else listed, found, like.percent)
    rest = _ordered_pairs(_across(listed, like.percent)).union(_apart(short, found)).distinct()
    _, more = _linked(rest.join(tried, ["a", "b"], "left_anti"), classes, docs, like)
    return found if more is None else durable(_named(links.union(more)))


def documents_by_class(docs: DataFrame, text: str, doc_id: str, like: Similarity) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n_shingles, ka, kb)`` of every row, and every class with its component.

    Classes come as ``(ka, kb, class, first_id, component)``: the smallest id of the class, and
    the number of the smallest class it is linked with, itself included.
    """
    docs = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    members = with_sets(docs, like, count_scales(docs, like.n))
    classes = (
        members.where("n_shingles > 0")
        .groupBy("ka", "kb")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").cast("int").alias("size"), F.first("prefix").alias("prefix"), F.first("ranges").alias("ranges"))
    )
    classes = durable(classes.withColumn("class", F.monotonically_increasing_id()))
    postings = classes.select("class", "size", F.posexplode("prefix").alias("place", "token"))
    found = _components(postings, classes, docs, like)
    return members.select("doc_id", "n_shingles", "ka", "kb"), classes.select(
        "ka", "kb", "class", F.col("doc_id").alias("first_id")
    ).join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", like: Similarity = Similarity()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; the component's smallest id names it."""
    members, classes = documents_by_class(docs, text, doc_id, like)
    names = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = classes.join(names, "component").select("ka", "kb", "component_id")
    empty = members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return members.where("n_shingles > 0").join(named, ["ka", "kb"]).select("doc_id", "n_shingles", "component_id").union(empty)


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", like: Similarity = Similarity()) -> DataFrame:
    """One row of each component, that of its smallest id; rows without words all stay.

    Rows with equal sets are first thinned to one by a ranking that runs before the shuffle as
    well, so a large group of copies is not gathered.  All columns are returned as they came.
    """
    _, classes = documents_by_class(docs, text, doc_id, like)
    first = F.struct(F.col("first_id").isNull().alias("null"), "first_id", "class")
    chosen = classes.groupBy("component").agg(F.min(first).alias("best")).select(F.col("best.class").alias("class"))
    chosen = classes.join(chosen, "class").select(F.col("ka").alias("_ka"), F.col("kb").alias("_kb"))
    place = docs.columns.index(text)
    kinds = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_n", "_ka", "_kb"))])
    n = like.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in w.slices(batch.column(place), _SLICE_BYTES):
                keys, first = shingle_sets(part, n)
                own = batch.slice(at, len(part))
                added = [pa.array(np.diff(first)), *map(pa.array, _set_keys(keys, first))]
                yield pa.RecordBatch.from_arrays([*own.columns, *added], [*own.schema.names, "_n", "_ka", "_kb"])

    rows = docs.mapInArrow(run, kinds)
    order = Window.partitionBy("_ka", "_kb").orderBy(F.col(f"`{doc_id}`").asc_nulls_last())
    one = rows.where("_n > 0").withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    kept = one.join(chosen, ["_ka", "_kb"], "left_semi")
    return kept.unionByName(rows.where("_n = 0")).select(*[f"`{c}`" for c in docs.columns])
