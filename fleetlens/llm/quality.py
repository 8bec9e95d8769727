"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.calibrate import pool_adjacent, sum_over_tasks
from fleetlens.sources.scratch import stored

FEATURES = 192
RIDGE = 1e-3
SEED = 7
#: Raw scores are calibrated on this grid.
LOW, HIGH, STEP = -1.0, 2.0, 0.002
THRESHOLD = 0.7
#: Rows whose features a task holds at once.
ROWS = 1024

_UPPER, _LOWER, _DIGIT, _SPACE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HIGH_BYTE = np.arange(256) >= 128
_POINT = np.zeros(256, bool)
_POINT[[ord(c) for c in ".,;:'\"-()"]] = True
_OTHER = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH_BYTE | _POINT)

NAMES = [
    "log_words", "word_length", "long_words", "distinct_words", "repeated_next", "largest_word_share", "upper", "digits",
    "points", "other_marks", "largest_mark", "high_bytes", "line_words", "distinct_lines", "ended_lines", "capital_words", "short_words",
]


def statistics(text: bytes | None) -> list[float]:
    """Numbers that describe one whole text; all zero for a text without words."""
    text = text or b""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    distinct = set(words)
    codes = {w: i for i, w in enumerate(distinct)}
    coded = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    lines = [s for x in text.split(b"\n") if (s := x.strip())]
    letters = counts[_UPPER].sum() + counts[_LOWER].sum()
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        float((lengths > 12).mean()),
        len(distinct) / n**0.9,
        float((coded[1:] == coded[:-1]).mean()) if n > 1 else 0.0,
        float(np.bincount(coded).max()) / n,
        float(counts[_UPPER].sum() / max(1, letters)),
        float(counts[_DIGIT].sum() / size),
        float(counts[_POINT].sum() / size),
        float(counts[_OTHER].sum() / size),
        float(np.where(_OTHER, counts, 0).max() / size),
        float(counts[_HIGH_BYTE].sum() / size),
        float(np.log1p(n / len(lines))),
        len(set(lines)) / len(lines),
        sum(x.endswith((b".", b"!", b"?")) for x in lines) / len(lines),
        sum(w[:1].isupper() for w in words) / n,
        float((lengths < 4).mean()),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` for every row, without a shuffle."""

    def run(batches):
        for batch in batches:
            flat = np.array([statistics(t.as_py()) for t in batch.column("text")]).reshape(-1)
            stats = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(NAMES), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), stats], ["doc_id", "stats"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


class FourierRidge:
    """cos(xW + b) features of standardised statistics, and ridge weights on them."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-12, spread, 1.0)
        # A Gaussian kernel as wide as the square root of the number of statistics.
        self.w = rng.normal(size=(len(mean), features)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.grid, self.share = np.array([0.0]), np.array([0.5])

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        f = np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)
        return np.concatenate([f, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        found = [self.expand(x[s : s + ROWS]) @ self.weights for s in range(0, len(x), ROWS)]
        return np.clip(np.concatenate([np.zeros(0), *found]), LOW, HIGH)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.grid, self.share)


def fit_quality(
    marked: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED
) -> FourierRidge:
    """Fit on every row of ``marked`` (``stats``, ``y`` 0..1): three passes of sums over tasks.

    No rows: a model that scores 0.5 everywhere.
    """

    def sums(make):
        def run(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = make(_matrix(batch.column("stats")), np.asarray(batch.column("y"), np.float64))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

        return sum_over_tasks(marked.select("stats", "y").mapInArrow(run, "m binary"))

    d = len(NAMES)
    moments = sums(lambda x, y: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    if moments is None:
        return FourierRidge(np.zeros(d), np.ones(d), features, seed)
    n, mean = moments[0], moments[1 : d + 1] / moments[0]
    model = FourierRidge(mean, np.sqrt(np.maximum(moments[d + 1 :] / n - mean**2, 0)), features, seed)

    k = features + 1

    def normal(x, y):
        total = np.zeros(k * k + k)
        for s in range(0, len(x), ROWS):
            z = model.expand(x[s : s + ROWS])
            total[: k * k] += (z.T @ z).reshape(-1)
            total[k * k :] += z.T @ y[s : s + ROWS]
        return total

    both = sums(normal)
    model.weights = np.linalg.solve(both[: k * k].reshape(k, k) + ridge * n * np.eye(k) / k, both[k * k :])

    cells = int(round((HIGH - LOW) / STEP)) + 1

    def cell(x, y):
        at = np.round((model.raw(x) - LOW) / STEP).astype(np.int64)
        return np.concatenate([np.bincount(at, y, cells), np.bincount(at, minlength=cells)])

    counted = sums(cell)
    there = counted[cells:] > 0
    grid = LOW + STEP * np.arange(cells)
    model.grid, model.share = pool_adjacent(grid[there], counted[:cells][there], counted[cells:][there])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    ``held_out``: a condition on ``doc_id``; such rows, rows with a null id and rows without a
    label are not learned from. ``labels``: (doc_id, ``label``); nulls are no labels, and of
    several labels the mean counts. Empty and null texts have all statistics zero and are
    scored like any other. Without labels every score is 0.5. Rows that repeat an id stay
    rows. Only ``doc_id`` and ``text`` of ``docs`` are read, only the text enters a score.
    """
    described = stored(document_statistics(docs).withColumn("held_out", F.coalesce(held_out, F.lit(False))), "quality_stats")
    known = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("y"))
    marked = stored(described.filter(~F.col("held_out")).join(known, "doc_id").select("stats", "y"), "quality_marked")
    model = fit_quality(marked)

    def run(batches):
        for batch in batches:
            score = model.score(_matrix(batch.column("stats"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return described.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
