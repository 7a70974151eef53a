"""Quality scores by Bradley-Terry pairwise ranking.

Pairs of a preferred and another text are drawn from labelled rows; a linear score is fitted by logistic loss on the
difference of the pair's features. The decision threshold is the quantile of the training scores at the share of rows
labelled 0, and scores are carried to 0..1 by a logistic curve that passes through `cut` at that threshold.
Features are surface statistics of the whole text: byte shares, shares of character-class transitions, lengths, and
how much of its words, word triples and lines repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, column, fold

#: Labelled rows that are learned from, at most: the ones with the smallest hashes of their ids.
MAX_LABELS = 20_000
STEPS, PAIRS, RATE, DECAY = 400, 1024, 0.02, 1e-3
_CLASSES = 10


def _class_table() -> np.ndarray:
    """Byte -> class: lower, upper, digit, space, line end, and kinds of punctuation; above 127 the last."""
    t = np.full(256, 9, np.uint8)
    t[:128] = 8
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".,;:", b"!?", b"#*$%&|<>")):
        t[list(chars)] = k
    return t


_TABLE = _class_table()
WIDTH = 129 + _CLASSES * _CLASSES + 8


def features(text: bytes) -> np.ndarray:
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    b = np.frombuffer(text, np.uint8)
    n = len(b)
    counts = np.bincount(b, minlength=256)
    out[:128], out[128] = counts[:128] / n, counts[128:].sum() / n
    c = _TABLE[b]
    out[129 : 129 + _CLASSES**2] = np.bincount(c[:-1] * np.uint8(_CLASSES) + c[1:], minlength=_CLASSES**2)[: _CLASSES**2] / n
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(1, len(words))
    triples = len(words) - 2
    repeats = 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / triples if triples > 0 else 0.0
    out[-8:] = (np.log1p(n) / 10, np.log1p(len(words)) / 10, n / k / 20, len(set(words)) / k, repeats, len(lines) / k, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(max(map(len, words), default=0)) / 5)
    return out


class Ranker:
    """A fitted score: weights over standardized features, and the curve to 0..1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, cut: float, seed: int = 1):
        self.cut = cut
        good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.mean, self.scale = x.mean(0) if len(x) else np.zeros(WIDTH), np.ones(WIDTH)
        self.w, self.threshold, self.slope = np.zeros(WIDTH), 0.0, 1.0
        #: Without both labels there is nothing to rank: every text gets the share of label 1.
        self.constant = None if len(good) and len(poor) else (float(y.mean()) if len(y) else 0.5)
        if self.constant is not None:
            return
        self.scale = np.maximum(x.std(0), 1e-4)
        z = self._standard(x)
        rng, m, v = np.random.default_rng(seed), np.zeros(WIDTH), np.zeros(WIDTH)
        for t in range(1, STEPS + 1):
            d = z[rng.choice(good, PAIRS)] - z[rng.choice(poor, PAIRS)]
            p = 1 / (1 + np.exp(np.clip(d @ self.w, -30, 30)))  # chance that the pair is ranked the wrong way
            g = -(p @ d) / PAIRS + DECAY * self.w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        s = z @ self.w
        self.threshold = float(np.quantile(s, len(poor) / len(y)))
        offset, a = np.log(cut / (1 - cut)), 1.0 / max(1e-6, float(s.std()))
        for _ in range(50):  # the slope that makes the labels likeliest
            p = 1 / (1 + np.exp(-np.clip(a * (s - self.threshold) + offset, -30, 30)))
            u = s - self.threshold
            a = float(np.clip(a + (u @ (y - p)) / max(1e-9, (u * u) @ (p * (1 - p))), 1e-3, 50))
        self.slope = a

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        s = self._standard(x) @ self.w
        return 1 / (1 + np.exp(-np.clip(self.slope * (s - self.threshold) + np.log(self.cut / (1 - self.cut)), -30, 30)))


def fit(df: DataFrame, labels: DataFrame, folds: int = 5, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = MAX_LABELS) -> Ranker:
    """Learns from at most max_labels labelled rows whose fold isn't 0, in the order of their ids' hashes. Labels other than 0 and 1 are left out; of several labels of an id the least counts, and of several texts the one whose hash is least."""
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & (fold(F.col("id"), folds) != 0))
    lab = lab.groupBy("id").agg(F.min("label").cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_labels)
    text = bytes_of(F.col(text_col))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h")).join(F.broadcast(lab), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([features(t).tobytes() for t in column(b, "text")], pa.binary())], ["place", "h", "label", "x"])

    found = arrow_map(rows.select(F.xxhash64("id").alias("place"), "h", "label", "text"), run, "place bigint, h bigint, label int, x binary")
    got = found.groupBy("place").agg(F.min(F.struct("h", "label", "x")).alias("r")).select("place", "r.label", "r.x").toPandas().sort_values("place")  # bounded by max_labels
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, WIDTH).astype(np.float64)
    return Ranker(x, got["label"].to_numpy(np.int64), cut)


def classify(df: DataFrame, labels: DataFrame, folds: int = 5, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) for each row of df.

    Rows whose crc32 of the id as text, modulo folds, is 0 are held out of the learning. Null texts count as empty. Repeated rows get
    equal scores. A null id is scored and has the fold of the empty text. Without labels of both kinds every score is the share of label 1 (0.5 without any). Only
    the text goes into a score; other columns are not read.
    """
    ranker = df.sparkSession.sparkContext.broadcast(fit(df, labels, folds, cut, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = column(b, "text")
            x = np.stack([features(t) for t in texts]) if texts else np.zeros((0, WIDTH), np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ranker.value.scores(x))], ["id", "held_out", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), bytes_of(F.col(text_col)).alias("text"), (fold(F.col(id_col), folds) == 0).alias("held_out"))
    out = arrow_map(rows, run, f"id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
