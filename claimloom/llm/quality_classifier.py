"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Every word counts as itself (A-Z lower-cased) and as its shape: which kinds of characters it
holds, how many marks, whether it repeats the word before.  One- and two-word n-grams of
words and one- to three-word n-grams of shapes are hashed into 2^18 weights; a feature's value
is its share of the n-grams of its kind.  A score is the logistic function of a bias and a
sparse dot product.

Training takes at most ``sample`` labelled documents, the first in the order of a hash of the
id, so the sample is the same in every run and its size does not grow with the corpus.  Its
features are written once, dealt to ``workers`` shares; in each of ``rounds`` rounds one task a
share reads it without a shuffle and updates the leader's sums (gradients and their squares,
per weight), and the sums are averaged.
Averages have a fixed size (two tables of 2^18 numbers a task).  Scoring is one narrow pass.

Defined results: null or empty texts have no features and the score of the bias; null labels
do not train; several labels of one id train each; a null id is never held out and never
trains; if no row trains, all scores are 0.5; repeated rows get equal scores; an empty table
gives an empty result.  The only inputs of a score are the text's words.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm import words as w
from claimloom.session import _shared_folder, durable

BITS = 18
_VIEWS = 5


@dataclass(frozen=True)
class Training:
    sample: int = 16_000
    workers: int = 4
    rounds: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.001
    scale: float = 4.0


def _kinds() -> np.ndarray:
    """A bit for each kind of byte: upper, lower, digit, mark of a sentence, other mark, beyond ASCII."""
    kind = np.full(256, 32, np.uint8)
    kind[:128] = 16
    kind[65:91], kind[97:123], kind[48:58] = 1, 2, 4
    kind[np.frombuffer(b".,;:!?'\"()-", np.uint8)] = 8
    return kind


_KIND = _kinds()


def shapes(words: w.Words) -> np.ndarray:
    """A key of each word's shape."""
    if not len(words.keys):
        return words.keys
    inside = ~w.SPACES[words.data]
    kind = _KIND[words.data[inside]]
    lengths = words.end - words.begin
    starts = np.cumsum(lengths) - lengths
    held = np.bitwise_or.reduceat(kind, starts).astype(np.uint64)
    marks = np.minimum(np.add.reduceat((kind & 24) > 0, starts, dtype=np.int64), 3).astype(np.uint64)
    first = kind[starts].astype(np.uint64)
    again = np.zeros(len(words.keys), bool)
    again[1:] = words.keys[1:] == words.keys[:-1]
    again[words.first[:-1][words.counts > 0]] = False
    return w.mix(held | marks << np.uint64(8) | first << np.uint64(16) | again.astype(np.uint64) << np.uint64(32) | np.uint64(1) << np.uint64(40))


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram, the weight numbers of all rows in order and how many each row has."""
    words = w.split(texts)
    lower = w.split(texts, lower=True)
    shift = np.uint64(64 - BITS)
    counts = words.counts
    row = np.repeat(np.arange(len(counts)), counts)
    found = []
    for view, (keys, n) in enumerate([(lower.keys, 1), (lower.keys, 2), (s := shapes(words), 1), (s, 2), (s, 3)]):
        grams = w.mix(w.runs(keys, n) + np.uint64(view))
        whole = row[: len(grams)] == row[n - 1 :] if len(grams) else np.zeros(0, bool)
        found.append(((grams[whole] >> shift).astype(np.int32), np.maximum(counts - n + 1, 0)))
    return found


def scores(texts: pa.Array, weights: np.ndarray, bias: float, scale: float) -> np.ndarray:
    total = np.full(len(texts), bias)
    for numbers, counts in features(texts):
        ends = np.concatenate(([0], np.cumsum(counts)))
        sums = np.concatenate(([0.0], np.cumsum(weights[numbers])))
        total += scale * (sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(counts, 1)
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def leader(z: np.ndarray, n: np.ndarray, how: Training) -> np.ndarray:
    """The weights that the sums stand for."""
    far = np.abs(z) > how.l1
    return np.where(far, -(z - np.sign(z) * how.l1) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2), 0.0)


def update(numbers: np.ndarray, values: np.ndarray, label: int, z: np.ndarray, n: np.ndarray, how: Training) -> None:
    """One example; the last place of the tables is the bias."""
    own = leader(z[numbers], n[numbers], how)
    p = 1 / (1 + np.exp(-np.clip(float(own @ values), -35, 35)))
    g = (p - label) * values
    sigma = (np.sqrt(n[numbers] + g * g) - np.sqrt(n[numbers])) / how.alpha
    z[numbers] += g - sigma * own
    n[numbers] += g * g


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


_EXAMPLES = "spread long, quality int, numbers array<int>, shares array<double>"


def _learner(state: Broadcast, how: Training) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One task's pass over its share of the sample, from the averaged sums on."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(x.num_rows for x in held):
            return
        z, n = (x.copy() for x in state.value)
        table = pa.Table.from_batches(held).sort_by([("spread", "ascending"), ("quality", "ascending")])
        for numbers, shares, label in zip(table["numbers"], table["shares"], table["quality"].to_pylist(), strict=True):
            update(numbers.values.to_numpy(), shares.values.to_numpy(), label, z, n, how)
        yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["z", "n"])

    return learn


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> tuple[np.ndarray, float]:
    """Weights and bias from ``docs (doc_id, text)`` and ``labels (doc_id, quality)``."""
    spread = F.xxhash64(F.lit(3), "doc_id")
    usable = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    sample = durable(usable.orderBy(spread, "doc_id", "quality").limit(how.sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in w.slices(batch.column(2)):
                found = features(part)
                ends = [np.concatenate(([0], np.cumsum(c))) for _, c in found]
                numbers, values = [], []
                for r in range(len(part)):
                    own = np.concatenate([x[e[r] : e[r + 1]] for (x, _), e in zip(found, ends, strict=True)])
                    share = np.concatenate([np.full(e[r + 1] - e[r], how.scale / max(1, e[r + 1] - e[r])) for e in ends])
                    distinct, place = np.unique(own, return_inverse=True)
                    numbers.append(np.append(distinct, 1 << BITS).astype(np.int32))
                    values.append(np.append(np.bincount(place, share, len(distinct)), 1.0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(numbers, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))],
                    ["spread", "quality", "numbers", "shares"],
                )

    # The sample's size is a parameter, so it may be sent to every task.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(spread.alias("spread"), F.col("quality").cast("int").alias("quality"), "text")
    spark, path = docs.sparkSession, f"{_shared_folder(docs.sparkSession)}/examples-{uuid.uuid4().hex}"
    worker = F.pmod("spread", F.lit(how.workers)).cast("int")
    rows.mapInArrow(run, _EXAMPLES).withColumn("worker", worker).write.partitionBy("worker").parquet(path)
    examples = spark.read.schema(f"{_EXAMPLES}, worker int").parquet(path)
    shares = [examples.where(F.col("worker") == k).drop("worker").coalesce(1) for k in range(how.workers)]
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(how.rounds):
        learn = _learner(spark.sparkContext.broadcast((z, n)), how)
        learned = functools.reduce(DataFrame.union, [x.mapInArrow(learn, "z binary, n binary") for x in shares]).collect()
        if not learned:
            break
        z = np.mean([np.frombuffer(r["z"]) for r in learned], axis=0)
        n = np.mean([np.frombuffer(r["n"]) for r in learned], axis=0)
    weights = leader(z, n, how)
    return weights[:-1], float(weights[-1])


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.3, how: Training = Training()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(rows, labels, how))
    scale = how.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            for at, part in w.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(scores(part, weights, bias, scale))], ["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
