"""Quality scores by random Fourier features.

Statistics of each whole text (lengths, shares of character kinds, repetition of
words and lines) are standardised and mapped to random Fourier features, which
approximate a Gaussian kernel. Partitions sum the normal equations, the sums meet
row by row, and ridge weights follow from a matrix of fixed size. Isotonic
regression on counts per score bin, from a fold that the weights did not see,
turns the kernel scores into probabilities.

Defined cases: null counts as empty, and empty texts get a score like any other;
without labels, or with labels of one class, every score is the share of label 1
(0.5 without any); repeated rows stay repeated; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, class_table, code_points, held_out, mix, settled, small_batches, span_hashes, word_table
from .labelled import CALIBRATION_FOLD, isotonic, with_labels

FEATURES = 300
RIDGE = 1e-2
BINS = 2000
THRESHOLD = 0.3
SEED = 20_240_229
#: Partitions whose sums meet in one group; a second step adds at most as many groups of up to a million partitions.
FAN_IN = 1000

_KINDS = {"upper": str.isupper, "alpha": str.isalpha, "digit": str.isdigit, "space": str.isspace}


def _shares(owner: np.ndarray, n: int, size: np.ndarray, *masks) -> list[np.ndarray]:
    return [np.bincount(owner[m], minlength=n) / np.maximum(size, 1) for m in masks]


def _repeats(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Share of items met before in the text, of items equal to the one before, and of the most common item."""
    total = np.maximum(np.bincount(owner, minlength=n), 1)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[new], minlength=n)
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    most = np.zeros(n)
    np.maximum.at(most, o[new], runs)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    return np.where(distinct, 1 - distinct / total, 0), np.bincount(owner[again], minlength=n) / total, most / total


def statistics(texts: list[str]) -> np.ndarray:
    """A row of numbers for each text."""
    n = len(texts)
    _, points, starts = code_points(texts)
    size = np.diff(starts)
    owner = np.repeat(np.arange(n), size)
    tables = {k: class_table(k, f)[points] > 0 for k, f in _KINDS.items()}
    line_break = points == 10
    in_word = word_table()[points] > 0
    punct = ~(tables["space"] | in_word)
    upper, alpha, digit, space, marks = _shares(owner, n, size, tables["upper"], tables["alpha"], tables["digit"], tables["space"], punct)
    pipes, shouts, stops, commas, wide, code = _shares(owner, n, size, points == ord("|"), points == ord("!"), points == ord("."), points == ord(","), points > 127, np.isin(points, [ord(c) for c in "<>{}=;_/\\#@&"]))
    edge = np.zeros(len(points) + 1, bool)
    edge[starts] = True
    inside, before = np.append(in_word, False), np.append(False, in_word)
    begins, ends = np.flatnonzero(inside & (~before | edge)), np.flatnonzero(before & (~inside | edge))
    word_owner = np.searchsorted(starts, begins, side="right") - 1
    length = ends - begins
    words = np.bincount(word_owner, minlength=n)
    some = np.maximum(words, 1)
    mean = np.bincount(word_owner, weights=length, minlength=n) / some
    spread = np.sqrt(np.maximum(0, np.bincount(word_owner, weights=length * length, minlength=n) / some - mean * mean))
    longest = np.zeros(n)
    np.maximum.at(longest, word_owner, length)
    short = np.bincount(word_owner[length <= 3], minlength=n) / some
    hashes = span_hashes(points, begins, ends)
    seen, stutter, top = _repeats(hashes, word_owner, n)
    pair = mix(hashes[:-1] * U64(3) + hashes[1:]) if len(hashes) > 1 else np.zeros(0, U64)
    same = word_owner[:-1] == word_owner[1:] if len(hashes) > 1 else np.zeros(0, bool)
    pairs_seen, _, top_pair = _repeats(pair[same], word_owner[:-1][same], n) if same.any() else (np.zeros(n),) * 3
    line_begin = np.flatnonzero(np.append(True, line_break)[: len(points)] | edge[: len(points)])
    line_end = np.append(line_begin[1:], len(points))
    line_owner = np.searchsorted(starts, line_begin, side="right") - 1
    line_seen, line_again, top_line = _repeats(span_hashes(points, line_begin, np.maximum(line_begin, line_end)), line_owner, n) if len(line_begin) else (np.zeros(n),) * 3
    lines = np.bincount(line_owner, minlength=n)
    capital = np.bincount(word_owner[tables["upper"][begins]], minlength=n) / some
    solid = np.bincount(word_owner[np.bincount(np.repeat(np.arange(len(begins)), length), weights=tables["upper"][in_word], minlength=len(begins)) >= np.maximum(length, 2)], minlength=n) / some
    out = [np.log1p(size), np.log1p(words), np.log1p(lines), mean, spread, np.log1p(longest), short, upper, alpha, digit, space, marks, pipes, shouts, stops, commas, wide, code, seen, stutter, top, pairs_seen, top_pair, line_seen, line_again, top_line, capital, solid, np.log1p(words / np.maximum(lines, 1)), np.sqrt(stutter), np.sqrt(pipes), np.sqrt(shouts), np.sqrt(pairs_seen)]
    return np.column_stack(out)


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, stats) of each row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            rows: list[np.ndarray] = []
            for a, b in chunks(texts):
                rows += list(statistics(texts[a:b]).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], ["id", "stats"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, stats array<float>")


def _matrix(column) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


class Fourier:
    """z = sqrt(2 / D) cos(W (x - mean) / deviation + b), and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, size: int = FEATURES):
        random = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1)
        self.w = random.normal(size=(len(mean), size)) / np.sqrt(len(mean)) * 0.7
        self.b = random.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.deviation, -6, 6)
        z = np.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b)
        return np.column_stack([z, x, np.ones(len(x))])


def _summed(batches, make):
    """One row for each row of the partition's summed matrix."""
    total = None
    for batch in batches:
        part = make(batch)
        if part is not None:
            total = part if total is None else total + part
    if total is not None:
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([at] * len(total), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "part", "row"])


def _add(table: pa.Table) -> pa.Table:
    rows = _matrix(table.column("row").combine_chunks())
    return pa.table({"i": pa.array([table.column("i")[0].as_py()], pa.int32()), "part": pa.array([table.column("part")[0].as_py()], pa.int32()), "row": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})


def _total(df: DataFrame, make) -> np.ndarray:
    """The sum over all partitions, added up ``FAN_IN`` partitions at a time, then
    those; the driver gets the one matrix."""
    schema = "i int, part int, row array<double>"
    rows = df.mapInArrow(lambda batches: _summed(batches, make), schema)
    for step in (FAN_IN, FAN_IN**3):
        rows = rows.withColumn("part", (F.col("part") / step).cast("int")).groupBy("i", "part").applyInArrow(_add, schema)
    return np.array([r.row for r in sorted(rows.collect(), key=lambda r: r.i)])


class Model:
    def __init__(self, fourier, weights, at, value):
        self.fourier, self.weights, self.at, self.value = fourier, weights, at, value

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(stats), self.value[0])
        return np.clip(np.interp(self.raw(stats), self.at, self.value), 0, 1)


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id") -> Model:
    """rows(id, stats)."""
    known = settled(with_labels(rows, labels.select(F.col(id_col).alias("id"), F.col(label).alias("label")), "label", "id").select("stats", "label", "fold"))
    n, good = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    fitted, calibrating = known.where(F.col("fold") != CALIBRATION_FOLD), known.where(F.col("fold") == CALIBRATION_FOLD)

    def moments(batch):
        x = _matrix(batch.column("stats"))
        return np.vstack([np.full(x.shape[1], len(x)), x.sum(axis=0), (x * x).sum(axis=0)]) if len(x) else None

    sums = _total(fitted, moments) if 0 < good < n else np.zeros((0, 0))
    if not sums.size:
        return Model(None, None, None, [good / n if n else 0.5])
    mean = sums[1] / sums[0]
    fourier = Fourier(mean, np.sqrt(np.maximum(0, sums[2] / sums[0] - mean * mean)))

    def normal(batch):
        x = _matrix(batch.column("stats"))
        if not len(x):
            return None
        z = fourier(x)
        return np.column_stack([z.T @ z, z.T @ batch.column("label").to_numpy(zero_copy_only=False)])

    equations = _total(fitted, normal)
    weights = np.linalg.solve(equations[:, :-1] + RIDGE * np.sqrt(sums[0][0]) * np.eye(len(equations)), equations[:, -1])
    model = Model(fourier, weights, None, None)

    def binned(batches):
        for batch in batches:
            if batch.num_rows:
                at = np.clip((model.raw(_matrix(batch.column("stats"))) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label")], ["bin", "label"])

    bins = calibrating.select("stats", "label").mapInArrow(binned, "bin int, label int").groupBy("bin").agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy("bin").collect()
    if bins:
        # one case of either class, spread over the bins, keeps shares off 0 and 1
        prior = good / n / len(bins)
        at, value = isotonic(np.array([(r.bin + 0.5) / BINS * 2 - 0.5 for r in bins]), np.array([r.good + prior for r in bins]), np.array([r.n + 1 / len(bins) for r in bins]))
    else:
        at, value = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    model.at, model.value = at, value
    return model


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of each row."""
    rows = settled(features(docs, id_col, text_col))
    model = fit(rows, labels, label, id_col)

    def run(batches):
        for batch in batches:
            score = model.score(_matrix(batch.column("stats"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    out = rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, score double, predicted int")
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that the classifier rejects, in one more pass over the
    texts (they are scored where they are, not joined)."""
    model = fit(settled(features(docs, id_col, text_col)), labels, "quality", id_col)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(at).to_pylist()]
            scores = [model.score(statistics(texts[a:b])) for a, b in chunks(texts)]
            yield batch.filter(pa.array(np.concatenate(scores or [np.zeros(0)]) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
