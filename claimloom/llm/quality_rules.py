"""Quality rules: counts of words, signs and repeats, and bands of compression ratios.

``rule_report`` gives every document its counts and verdict; ``keep`` returns the rows that
pass.  Both are narrow: one pass over the texts, no shuffle, memory of one slice of texts.

The method is compression bands.  A text is compressed whole and in fixed chunks of bytes;
ratio = compressed / plain.  Repetitive text compresses to little, random or base64 text far
less than prose.  Short texts compress badly whatever they say, so the limits depend on
the length.  A document is rejected if its whole ratio leaves its band, or if more than
half of its full chunks leave the band of a chunk.

Defined results: null or empty text has no words, all counts 0, ratio 1.0 and fails the
base rules; texts of any length are read whole; repeated rows get equal results; an empty
table gives an empty result.  Only the id and text columns are read by the report, and
``keep`` returns exactly the columns it was given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimloom.llm import words as w


@dataclass(frozen=True)
class Bands:
    """Lowest and highest ratio by the least number of bytes they hold from.

    Highest ratio of the documents of sf0.1 that pass the base rules (en, de, fr, es), and the limit:
    0.745 and 0.85 from 200 bytes, 0.708 and 0.80 from 400, 0.679 and 0.77 from 600, 0.592 and
    0.72 from 1,000, 0.521 and 0.68 from 2,000, 0.478 and 0.65 from 4,000, 0.419 and 0.62 from
    32,000, 0.484 and 0.65 for a chunk.  The margin of 0.09 and more is for other scripts: 1,000 bytes
    of Chinese prose reach 0.71.  Base64 (0.74 and more) and random printable text (0.77) are above the
    limits at every length, random letters of both cases (0.68) from 2,000 bytes.  Hex words (0.51-0.63)
    and random lower-case letters (0.58-0.71) are not: their ratio is not told from that of prose.
    Below the first length nothing is judged, as a frame's own bytes decide the ratio there.
    """

    whole: tuple[tuple[int, float, float], ...] = ((200, 0.25, 0.85), (400, 0.25, 0.80), (600, 0.25, 0.77), (1_000, 0.22, 0.72), (2_000, 0.22, 0.68), (4_000, 0.20, 0.65), (32_000, 0.15, 0.62))
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.15, 0.65)
    chunk_share: float = 0.5
    level: int = 3


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    bands: Bands = field(default_factory=Bands)


_SIGNS = np.zeros(256, bool)
_SIGNS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
#: Bytes that begin a code point in UTF-8.
_LEADS = (np.arange(256) & 0xC0) != 0x80

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
REPORT = f"{COUNTS}, base_failed boolean, kept boolean, ratio double, n_chunks long, n_chunks_outside long"


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row's range."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def repeat_words(words: w.Words) -> np.ndarray:
    """By row, the words that lie in a three-word window found twice or more in the row."""
    windows = w.runs(words.keys, 3)
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    if not len(windows):
        return np.zeros(len(words.counts), np.int64)
    place = np.flatnonzero(row[: len(windows)] == row[2:])  # windows that end in their text
    keys = w.mix(windows[place] + row[place].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(windows), bool)
    again[place[order[1:][same]]] = True
    again[place[order[:-1][same]]] = True
    inside = np.zeros(len(words.keys), bool)
    for k in range(3):
        inside[k : k + len(again)] |= again
    return per_row(inside, words.first)


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def outside(ratio: float, low: float, high: float) -> bool:
    return ratio < low or ratio > high


def judge(data: bytes, bands: Bands, compressor) -> tuple[float, int, int, bool]:
    """Whole ratio, full chunks, those outside their band, and whether the text passes."""
    if not data:
        return 1.0, 0, 0, True
    ratio = len(compressor.compress(data)) / len(data)
    size = bands.chunk_bytes
    n = len(data) // size if len(data) > size else 0
    bad = 0
    for k in range(n):
        bad += outside(len(compressor.compress(data[k * size : (k + 1) * size])) / size, *bands.chunk)
    limits = [x for x in bands.whole if len(data) >= x[0]]
    passes = not (limits and outside(ratio, *limits[-1][1:])) and bad <= bands.chunk_share * n
    return ratio, n, bad, passes


def judged(texts: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """The report's columns for a slice of texts."""
    import zstandard

    words = w.split(texts)
    counts = words.counts
    compressor = zstandard.ZstdCompressor(level=rules.bands.level)
    plain = words.data.tobytes()
    rows = [plain[a:b] for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
    verdicts = [judge(x, rules.bands, compressor) for x in rows]
    repeats = repeat_words(words)
    failed = (counts < rules.min_words) | (100 * repeats > rules.max_repeat_percent * counts)
    passes = np.array([x[3] for x in verdicts], bool)
    return {
        "n_words": counts,
        "word_chars": per_row(_LEADS[words.data] & ~w.SPACES[words.data], words.offsets),
        "n_symbols": per_row(_SIGNS[words.data], words.offsets),
        "n_dup_lines": np.array([duplicate_lines(x) for x in rows], np.int64),
        "n_repeat_words": repeats,
        "base_failed": failed,
        "kept": ~failed & passes,
        "ratio": np.array([x[0] for x in verdicts], np.float64),
        "n_chunks": np.array([x[1] for x in verdicts], np.int64),
        "n_chunks_outside": np.array([x[2] for x in verdicts], np.int64),
    }


def rule_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: Rules = Rules()) -> DataFrame:
    """``doc_id`` and the report of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in w.slices(batch.column(1)):
                columns = judged(part, rules)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), *map(pa.array, columns.values())], ["doc_id", *columns]
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, {REPORT}")


def keep(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all their columns."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in w.slices(batch.column(place)):
                yield batch.slice(at, len(part)).filter(pa.array(judged(part, rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
