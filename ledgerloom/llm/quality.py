"""Document quality: random Fourier features of document statistics, ridge, isotonic calibration.

Every text is reduced to a few statistics of its bytes, words and lines. Standardised, they pass
through random Fourier features, whose inner products approximate a Gaussian kernel. The ridge
weights solve the normal equations, whose partial sums are formed in each partition of the labelled
rows and added up in a tree. A further fold of the labelled rows, binned by raw score, gives an
isotonic curve from raw score to the share of label 1.

Defined cases: a null text is scored as the empty one; a null or unknown label does not count;
repeated labels count as often as they stand; without labelled rows, or with one class only, the
score is that class's share (0.5 without any); a null id and repeated rows are scored like others;
an empty table gives no rows. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import doc_starts, row_sums, slices, span_hashes, words
from .common import arrow_map, id_remainder, materialise, text_hash, tree_sum, without

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "long_words", "short_words", "upper", "digits", "punctuation", "symbols", "bangs",
    "bars", "non_ascii", "line_breaks", "distinct_words", "repeated_next", "marked_words", "upper_words", "distinct_lines", "stops",
]
FEATURES = 256
#: Of the kernel, in standard deviations of the statistics.
WIDTH = 4.0
RIDGE = 1e-3
BINS = 2000

_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 common punctuation, 4 other ASCII symbol
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4
_CLASS[[ord(c) for c in ".,;:?!'\"()-"]] = 3


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    out = np.zeros((len(column), len(STATISTICS)))
    for lo, hi, data, offsets in slices(column):
        n = hi - lo

        def count(mask: np.ndarray, offsets: np.ndarray = offsets) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(mask)])
            return np.diff(sums[offsets]).astype(float)

        kind = _CLASS[data]
        size = np.diff(offsets).astype(float)
        starts, ends, rows = words(data, offsets)
        hashes = span_hashes(data, starts, ends)
        n_words = np.bincount(rows, minlength=n).astype(float)

        def share(mask: np.ndarray, rows: np.ndarray = rows, n: int = n) -> np.ndarray:
            return row_sums(mask, rows, n) / np.maximum(n_words, 1)

        order = np.lexsort((hashes, rows))
        fresh = np.ones(len(order), bool)
        if len(order):
            fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
        again = np.zeros(len(rows), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
        length = ends - starts
        per_word = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.stack([starts, ends], 1)], axis=1)[:, 0]
        uppers, marks = per_word(kind == 1), per_word(kind == 4) + per_word(data == 33)
        breaks = data == 10
        head = doc_starts(len(data), offsets)[:-1]
        head[1:] |= breaks[:-1]
        line_at = np.flatnonzero(head)
        lines = span_hashes(data, line_at, np.append(line_at[1:], len(data)))
        line_rows = np.searchsorted(offsets, line_at, "right") - 1
        line_order = np.lexsort((lines, line_rows))
        new_line = np.ones(len(lines), bool)
        if len(lines):
            new_line[1:] = (lines[line_order][1:] != lines[line_order][:-1]) | (line_rows[line_order][1:] != line_rows[line_order][:-1])
        n_lines = np.bincount(line_rows, minlength=n)
        part = lambda x: x / np.maximum(size, 1)
        out[lo:hi] = np.stack([
            np.log1p(size), np.log1p(n_words), row_sums(length, rows, n) / np.maximum(n_words, 1), share(length > 12), share(length < 4),
            part(count(kind == 1)), part(count(kind == 2)), part(count(kind == 3)), part(count(kind == 4)), part(count(data == 33)),
            part(count(data == 124)), part(count(data > 127)), part(count(breaks)), row_sums(fresh, rows, n) / np.maximum(n_words, 1),
            share(again), share(marks > 1), share((uppers > 1) & (2 * uppers >= length)),
            row_sums(new_line, line_rows, n) / np.maximum(n_lines, 1), part(count(data == 46)),
        ], axis=1)
    return out


def _statistics_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = statistics(batch.column("text"))
            cols = [pa.array(values[:, k]) for k in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *cols], ["doc_id", "text_hash", *STATISTICS])

    rows = docs.select(F.col("doc_id").cast("long"), text_hash(F.col("text")).alias("text_hash"), F.col("text").cast("string"))
    return arrow_map(rows, run, "doc_id long, text_hash long, " + ", ".join(f"{s} double" for s in STATISTICS))


class Kernel:
    """Standardisation and the random features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        draw = np.random.default_rng(20240501)
        self.mean, self.scale = mean, scale
        self.w = draw.normal(0, 1 / WIDTH, (len(STATISTICS), FEATURES))
        self.b = draw.uniform(0, 2 * np.pi, FEATURES)

    def features(self, values: np.ndarray) -> np.ndarray:
        z = np.clip((values - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(z), 1))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS], 1)


def normal_equations(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over all rows: partial sums by partition, added in a tree."""
    side = FEATURES + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((side, side + 1))
        for batch in batches:
            z, y = kernel.features(_matrix(batch)), batch.column("quality").to_numpy(zero_copy_only=False)
            total += z.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["at", "sums"])

    total = tree_sum(arrow_map(rows, partial, "at long, sums binary"))
    total = np.zeros((side, side + 1)) if total is None else total.reshape(side, side + 1)
    return total[:, :side], total[:, side]


def isotonic(x: np.ndarray, positive: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the blocks' mean x and share of label 1."""
    blocks: list[list[float]] = []
    for at, p, c in zip(x.tolist(), positive.tolist(), count.tolist(), strict=True):
        blocks.append([at * c, p, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    total = np.array(blocks)
    return total[:, 0] / total[:, 2], total[:, 1] / total[:, 2]


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learns from rows that are not held out."""
    return _scored(docs, labels, threshold).drop("text_hash")


def _scored(docs: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    stats = materialise(_statistics_of(docs), "quality-statistics")
    known = labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").cast("double"))
    rest = id_remainder(F.col("doc_id"))
    training = stats.join(known.where(id_remainder(F.col("doc_id")) != 0), "doc_id").withColumn("fold", rest)
    training = materialise(training, "quality-training")
    moments = training.agg(F.count(F.lit(1)), F.avg("quality"), *[f(s) for s in STATISTICS for f in (F.avg, F.stddev_pop)]).first()
    n, prior = moments[0], moments[1]
    curve = None
    if n and 0 < prior < 1:
        kernel = Kernel(np.array(moments[2::2], float), np.maximum(np.array(moments[3::2], float), 1e-3))
        # a fold of its own for the curve, unless that leaves one class on either side
        split = training.agg(F.avg(F.when(F.col("fold") == 1, F.col("quality"))), F.avg(F.when(F.col("fold") != 1, F.col("quality")))).first()
        own = all(x is not None and 0 < x < 1 for x in split)
        zz, zy = normal_equations(training.where("fold <> 1") if own else training, kernel)
        weights = np.linalg.solve(zz + RIDGE * max(zz[-1, -1], 1) * np.eye(len(zz)) / FEATURES, zy)
        raw = _raw_scores(training.where("fold = 1") if own else training, kernel, weights, "quality double")
        bins = raw.withColumn("bin", F.floor((F.least(F.greatest("raw", F.lit(-0.5)), F.lit(1.5)) + 0.5) * (BINS / 2)))
        table = bins.groupBy("bin").agg(F.avg("raw"), F.sum("quality"), F.count(F.lit(1))).orderBy("bin").collect()  # BINS + 1 rows at most
        curve = isotonic(*(np.array([r[k] for r in table], float) for k in (1, 2, 3)))
        scored = _raw_scores(stats, kernel, weights, None, curve)
    else:
        scored = stats.select("doc_id", "text_hash", F.lit(0.5 if prior is None else float(prior)).alias("raw"))
    return scored.select("doc_id", "text_hash", (rest == 0).alias("held_out"), F.col("raw").alias("score"), (F.col("raw") >= threshold).cast("int").alias("predicted"))


def _raw_scores(rows: DataFrame, kernel: Kernel, weights: np.ndarray, carry: str | None, curve: tuple | None = None) -> DataFrame:
    """doc_id (and `carry`) with the ridge score, or its calibrated share if there is a curve."""
    kept = [carry.split()[0]] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = kernel.features(_matrix(batch)) @ weights
            if curve is not None:
                # within a flat stretch the raw score still orders
                raw = 0.999 * np.interp(raw, *curve) + 0.001 * np.clip(raw, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(raw), *[batch.column(c) for c in kept]], ["doc_id", "text_hash", "raw", *kept])

    return arrow_map(rows, run, "doc_id long, text_hash long, raw double" + (f", {carry}" if carry else ""))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` that are not predicted bad, with their columns; a row is decided by its own text, whatever else has its id."""
    gone = materialise(_scored(docs, labels, threshold).where("predicted = 0").select("doc_id", "text_hash").distinct(), "quality-gone")
    return without(docs, gone)
