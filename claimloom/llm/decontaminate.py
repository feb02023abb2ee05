"""Benchmark decontamination by edit distance over words.

A document is contaminated by an item of n words if some window of n consecutive words (cut
at the text's end) turns into the item by at most ``floor(n * (100 - percent) / 100)``
insertions, deletions and replacements of words.  Words are runs of letters and digits, A-Z
lower-cased.

1. *Windows.*  Of an item cut into k + 1 segments, k edits leave one unchanged.  So only places
   that hold a segment can lie in a contaminated window, shifted by k at most; each such place
   gives one item-sized window.  No window within k edits is lost by this.
2. *Embedding.*  A CGK walk writes a window or item of n words as 3n symbols: a step copies the
   current word and moves on by a random bit of step and word.  Few edits become few
   differing places.  ``walks`` independent walks are taken.
3. *Bit sampling.*  Each walk gives ``samples`` keys of ``places`` sampled symbols.  A window
   and its item that share a key are compared; a key with only places behind the end of both
   walks says nothing and is left out.  The numbers are set for a recall of 0.99 at the largest
   distance (measured in the tests).
4. *Check.*  Exact edit distances of the item and all windows within k words of the place.

Documents are read in one narrow pass.  Items are sent to the tasks in blocks of at most
``BLOCK_BYTES`` of text; more items mean more blocks, each against all documents.

Defined results: null, empty or wordless texts and items match nothing; null ids come through
as null; repeated rows or items each give their rows; empty tables give an empty result.
``matches`` reads only the id and text columns, ``clean`` returns exactly the columns it got.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import words as w

BLOCK_BYTES = 16 << 20
_SPOT_BITS = 20


@dataclass(frozen=True)
class Search:
    percent: int = 80
    walks: int = 8
    samples: int = 12
    places: int = 3
    seed: int = 17


def allowed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n * (100 - percent) // 100


def _words(texts: pa.Array) -> w.Words:
    return w.split(texts, lower=True, separators=w.SPACES | w.MARKS)


def embed(keys: np.ndarray, start: np.ndarray, length: np.ndarray, n: np.ndarray, walk: int, seed: int) -> np.ndarray:
    """The walk's symbols of each window, 3n of them and zeros behind; 0 where words end."""
    steps = 3 * int(n.max())
    odd = w.mix(np.arange(steps, dtype=np.uint64) + np.uint64((seed * 1000 + walk) << 32)) | np.uint64(1)
    out = np.zeros((steps, len(start)), np.uint64)
    at = np.zeros(len(start), np.int64)
    last = len(keys) - 1
    for j in range(steps):
        symbol = keys[np.minimum(start + at, last)]
        symbol[at >= length] = 0
        out[j] = symbol
        at += ((symbol * odd[j]) >> np.uint64(63)).astype(np.int64)
    return out


def sampled(keys: np.ndarray, start: np.ndarray, length: np.ndarray, n: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each window, one row for each walk and sample, and whether a key has a word in it."""
    rng = np.random.default_rng(search.seed)
    rows, reached = [], []
    for walk in range(search.walks):
        symbols = embed(keys, start, length, n, walk, search.seed)
        for _ in range(search.samples):
            total, some = n.astype(np.uint64), np.zeros(len(n), bool)
            for share in rng.random(search.places):
                symbol = symbols[(share * 3 * n).astype(np.int64), np.arange(len(n))]
                total = w.mix(total + symbol)
                some |= symbol != 0
            rows.append(total)
            reached.append(some)
    return np.array(rows), np.array(reached)


def distances(item: np.ndarray, windows: list[np.ndarray]) -> np.ndarray:
    """Edit distances of an item and windows no longer than it."""
    n = len(item)
    width = max(map(len, windows))
    table = np.zeros((len(windows), width), np.uint64)
    for k, x in enumerate(windows):
        table[k, : len(x)] = x
    steps = np.arange(width + 1)
    before = np.tile(steps, (len(windows), 1))
    for i in range(n):
        now = before + 1
        np.minimum(now[:, 1:], before[:, :-1] + (table != item[i]), out=now[:, 1:])
        before = np.minimum.accumulate(now - steps, axis=1) + steps
    return before[np.arange(len(windows)), [len(x) for x in windows]]


@dataclass
class Items:
    """Items, their segments by length, and their sampled keys."""

    ids: list
    keys: np.ndarray
    first: np.ndarray
    search: Search
    segments: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    marks: np.ndarray | None = None
    reached: np.ndarray | None = None

    @classmethod
    def of(cls, ids: list, texts: list, search: Search) -> Items:
        words = _words(pa.array(texts, pa.string()))
        items = cls(ids, words.keys, words.first, search)
        found: dict[int, list] = {}
        for i, n in enumerate(words.counts):
            parts = min(int(allowed(int(n), search.percent)) + 1, int(n))
            cuts = [int(n) * p // parts for p in range(parts + 1)] if n else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = w.runs(words.keys[words.first[i] + a : words.first[i] + b], b - a)[0]
                found.setdefault(b - a, []).append((key, i, a))
        for size, rows in found.items():
            rows.sort(key=lambda x: x[0])
            keys = np.array([x[0] for x in rows], np.uint64)
            spots = np.zeros(1 << _SPOT_BITS, bool)
            spots[(keys >> np.uint64(64 - _SPOT_BITS)).astype(np.int64)] = True
            items.segments[size] = keys, np.array([x[1] for x in rows]), np.array([x[2] for x in rows]), spots
        n = words.counts
        full = np.flatnonzero(n > 0)
        items.marks = np.zeros((search.walks * search.samples, len(n)), np.uint64)
        items.reached = np.zeros(items.marks.shape, bool)
        if len(full):
            items.marks[:, full], items.reached[:, full] = sampled(words.keys, words.first[full], n[full], n[full], search)
        return items

    def places(self, words: w.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and first word of each item-sized window about a segment, each once."""
        found = []
        counts = words.counts
        for size, (keys, item, offset, spots) in self.segments.items():
            own = w.runs(words.keys, size)
            at = np.flatnonzero(spots[(own >> np.uint64(64 - _SPOT_BITS)).astype(np.int64)])
            low, high = np.searchsorted(keys, own[at], "left"), np.searchsorted(keys, own[at], "right")
            at, low, many = at[high > low], low[high > low], (high - low)[high > low]
            if not len(at):
                continue
            row = np.searchsorted(words.first, at, "right") - 1
            inside = at + size <= words.first[row + 1]
            at, low, many, row = at[inside], low[inside], many[inside], row[inside]
            each = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            row, begin = np.repeat(row, many), np.repeat(at, many) - offset[each]
            found.append(np.stack((row, item[each], np.maximum(begin, words.first[row]))))
        if not found or not len(counts):
            return (np.zeros(0, np.int64),) * 3
        rows = np.unique(np.concatenate(found, axis=1), axis=1)
        return rows[0], rows[1], rows[2]

    def alike(self, keys: np.ndarray, start: np.ndarray, length: np.ndarray, n: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The windows that share a key with their item; a key behind the end of both walks says nothing."""
        marks, reached = sampled(keys, start, length, n, self.search)
        return ((marks == self.marks[:, item]) & (reached | self.reached[:, item])).any(axis=0)

    def matches(self, texts: pa.Array) -> dict[tuple[int, int], tuple[int, int]]:
        """``(row, item)`` to the least distance and the first word of its first window."""
        words = _words(texts)
        row, item, start = self.places(words)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        if not len(row):
            return best
        n = np.diff(self.first)[item]
        length = np.minimum(n, words.first[row + 1] - start)
        for k in np.flatnonzero(self.alike(words.keys, start, length, n, item)):
            r, i, at = int(row[k]), int(item[k]), int(start[k])
            wanted = self.keys[self.first[i] : self.first[i + 1]]
            begin, end = int(words.first[r]), int(words.first[r + 1])
            most = int(allowed(len(wanted), self.search.percent))
            if at + len(wanted) <= end and np.array_equal(words.keys[at : at + len(wanted)], wanted):
                here = [(0, at - begin)]
            else:
                starts = range(max(begin, at - most), min(end - 1, at + most) + 1)
                far = distances(wanted, [words.keys[s : min(s + len(wanted), end)] for s in starts])
                here = [(int(d), s - begin) for d, s in zip(far, starts, strict=True) if d <= most]
            for x in here:
                best[r, i] = min(best.get((r, i), x), x)
        return best


def _blocks(benchmark: DataFrame, text: str, item_id: str, search: Search) -> Iterator[Items]:
    """The items in blocks of bounded size."""
    items = benchmark.select(benchmark[item_id].alias("item_id"), benchmark[text].alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()
        yield Items.of(rows["item_id"].to_pylist(), rows["text"].to_pylist(), search)


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", search: Search = Search()) -> DataFrame:
    """``doc_id, item_id, start, n_words, distance`` of every contaminated document and item.

    ``start`` is the first word of the nearest window, the first of several.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    ids, items = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    spark, found = docs.sparkSession, None
    for block in _blocks(benchmark, item_text, item_id, search):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            sizes = np.diff(block.first)
            for batch in batches:
                id_type = batch.schema.field(0).type
                for at, part in w.slices(batch.column(1)):
                    got = block.matches(part)
                    if got:
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": batch.column(0).take(pa.array([at + r for r, _ in got])).cast(id_type),
                                "item_id": pa.array([block.ids[i] for _, i in got]),
                                "start": pa.array([s for _, s in got.values()], pa.int64()),
                                "n_words": pa.array([int(sizes[i]) for _, i in got], pa.int64()),
                                "distance": pa.array([d for d, _ in got.values()], pa.int64()),
                            }
                        )

        part = rows.mapInArrow(run, f"doc_id {ids}, item_id {items}, start long, n_words long, distance long")
        found = part if found is None else found.union(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", search: Search = Search()) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    place = docs.columns.index(text)
    kept = docs
    for block in _blocks(benchmark, item_text, item_id, search):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, part in w.slices(batch.column(place)):
                    hit = {r for r, _ in sent.value.matches(part)}
                    yield batch.slice(at, len(part)).filter(pa.array([r not in hit for r in range(len(part))], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
