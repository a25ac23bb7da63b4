"""Quality classifier: a linear-chain conditional random field labels each line good or bad."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import read_table, slices, text_or_empty, texts_of

#: Bounds of the sample that the model is fitted on, labelled documents and lines of all of them; everything else sees all
#: rows.
FIT_DOCS, FIT_LINES = 4000, 200_000
EPOCHS, RATE, RIDGE = 150, 0.15, 1e-3

MARKS = {ord(c): None for c in "#*$%&|<>!{}[]\\~^=_@"}
DIGITS = {ord(c): None for c in "0123456789"}
#: Statistics of a line, then the same of the lines before and after.
OWN = 10
NEAR = (0, 2, 3, 4, 6, 7)
WIDTH = OWN + 2 * len(NEAR) + 1


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features [line, WIDTH] and lengths of the lines of a text; an empty text has no line. The whole text counts."""
    lines = [x for x in text.split("\n") if x.strip()]
    own, seen = np.zeros((len(lines), OWN)), set()
    for k, line in enumerate(lines):
        n, words = len(line), line.split()
        w = len(words)
        marks = n - len(line.translate(MARKS))
        letters = line.lower()
        upper = sum(map(str.isupper, words)) / w
        twice = 1 - len(set(words)) / w
        own[k] = (
            np.log1p(w) / 5, min(n / w, 30) / 10, np.sqrt(marks / n), upper, twice,
            (n - len(line.translate(DIGITS))) / n, min(1.0, marks / w), line in seen, letters != line, line[-1] in ".!?:;\"'",
        )
        seen.add(line)
    near = own[:, NEAR]
    blank = np.zeros((1, len(NEAR)))
    before, after = np.concatenate((blank, near[:-1])), np.concatenate((near[1:], blank))
    out = np.concatenate((own, before[: len(lines)], after[: len(lines)], np.ones((len(lines), 1))), 1)
    return out, np.array([len(x) for x in lines], np.float64)


def marginals(emission: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many sequences laid end to end: P(line is good), expected moves [2, 2] and log Z of each.

    emission: log-potential of good against bad for every line. Sequences are sorted by length, so step t works on a
    shrinking front of them."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    lengths = sizes[order]
    e = np.stack((np.zeros(len(emission)), emission), 1)
    forward, backward = np.zeros_like(e), np.zeros_like(e)
    longest = int(lengths[0]) if len(lengths) else 0
    alive = [int(np.searchsorted(-lengths, -t, "left")) for t in range(longest)]  # sequences longer than t
    join = lambda x: np.logaddexp(x[..., 0], x[..., 1])
    for t in range(longest):
        at = starts[: alive[t]] + t
        forward[at] = e[at] if t == 0 else e[at] + join(np.swapaxes(forward[at - 1][:, :, None] + moves, 1, 2))
    total = join(forward[starts + lengths - 1]) if longest else np.zeros(0)
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        step = moves + (e[at + 1] + backward[at + 1])[:, None, :]
        backward[at] = join(step)
        expected += np.exp(forward[at][:, :, None] + step - total[: alive[t + 1]][:, None, None]).sum(0)
    z = np.repeat(0.0, len(sizes))
    z[order] = total
    good = np.exp(forward[:, 1] + backward[:, 1] - np.repeat(z, sizes))
    return good, expected, z


class Model:
    def __init__(self) -> None:
        self.weights, self.moves, self.scale, self.shift = np.zeros(WIDTH), np.zeros((2, 2)), 1.0, 0.0
        #: Documents without lines in the sample, and how many of them are good.
        self.blank = (0, 0)

    def qualities(self, texts: list[str]) -> np.ndarray:
        """0 to 1 for each text: P(good) of its lines weighted by length, through a fitted logistic scale."""
        found = [line_features(x) for x in texts]
        return self.score([x for x, _ in found], [n for _, n in found])

    def raw(self, features: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(x) for x in features])
        out = np.full(len(sizes), np.nan)
        if (full := np.flatnonzero(sizes)).size:
            good = marginals(np.concatenate([features[i] for i in full]) @ self.weights, self.moves, sizes[full])[0]
            n = np.concatenate([lengths[i] for i in full])
            bounds = np.cumsum(sizes[full]) - sizes[full]
            out[full] = np.add.reduceat(good * n, bounds) / np.add.reduceat(n, bounds)
        return out

    def score(self, features: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
        """A text without lines scores as one without a good line, drawn to the share of good ones among labelled texts
        without lines."""
        raw = self.raw(features, lengths)
        score = 1 / (1 + np.exp(-np.clip(self.scale * (np.nan_to_num(raw) - self.shift), -30, 30)))
        return np.where(np.isnan(raw), (score + self.blank[1]) / (1 + self.blank[0]), score)


def fit(features: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray) -> Model:
    """Maximum conditional likelihood of line labels, each line taking its document's, by accelerated gradient steps.
    Lines count so that both classes weigh the same. Then a logistic scale is fitted to the aggregated marginals."""
    model = Model()
    use = [i for i in range(len(labels)) if len(features[i])]
    model.blank = (len(labels) - len(use), int(sum(labels) - sum(labels[use])))
    if not use or len(set(labels[use].tolist())) < 2:
        return model
    features, lengths, y = [features[i] for i in use], [lengths[i] for i in use], labels[use].astype(np.float64)
    sizes = np.array([len(x) for x in features])
    x, line = np.concatenate(features), np.repeat(y, sizes)
    each = np.where(y == 1, 0.5 / max(1, sizes[y == 1].sum()), 0.5 / max(1, sizes[y == 0].sum()))
    weight = np.repeat(each, sizes)
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = ((sizes - 1) * each)[y == k].sum()
    theta, first, second = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, EPOCHS + 1):
        good = np.zeros(len(x))
        expected = np.zeros((2, 2))
        for k in (0, 1):  # the classes have different weights
            rows, docs = np.flatnonzero(line == k), np.flatnonzero(y == k)
            good[rows], moves, _ = marginals(x[rows] @ theta[:WIDTH], theta[WIDTH:].reshape(2, 2), sizes[docs])
            expected += moves * each[docs[0]]
        gradient = np.concatenate((((line - good) * weight) @ x, (seen - expected).ravel())) - RIDGE * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    model.weights, model.moves = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
    raw = model.raw(features, lengths)
    cuts = np.unique(np.concatenate(([0.0, 1.0], (np.unique(raw)[1:] + np.unique(raw)[:-1]) / 2)))
    good, bad = np.sort(raw[y == 1]), np.sort(raw[y == 0])
    right = (len(good) - np.searchsorted(good, cuts)) / len(good) + np.searchsorted(bad, cuts) / len(bad)
    top = cuts[right >= right.max() - 1e-12]
    model.shift = float((top[0] + top[-1]) / 2)
    model.scale = 4 / max(0.02, float(np.median(good) - np.median(bad)) / 2)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_DOCS) -> Model:
    """Fits on at most ``rows`` labelled documents whose crc32 of the id, modulo 3, isn't 1, in order of a hash of the id,
    and on at most FIT_LINES lines of them: a document that would exceed these is passed over as a whole. Features are
    made by the executors; no more than the sample comes to the driver. A document with several labels takes the lowest,
    one with several rows the least text."""
    part = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (part != 1)).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    n_lines = F.size(F.filter(F.split("text", "\n", -1), lambda x: x != ""))
    total = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most FIT_DOCS rows
    sizes = sample.select("doc_id", n_lines.alias("n")).where(F.col("n") <= FIT_LINES).withColumn("total", total).where(F.col("total") <= FIT_LINES)
    sample = sample.join(F.broadcast(sizes.select("doc_id")), "doc_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(doc, *line_features(text), y) for doc, text, y in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1].astype("<f8").tobytes() for r in found], pa.binary()), pa.array([r[2].astype("<f8").tobytes() for r in found], pa.binary()), pa.array([r[3] for r in found], pa.int32())], ["doc_id", "features", "lengths", "quality"])

    found = sample.mapInArrow(make, "doc_id long, features binary, lengths binary, quality int").collect()
    found.sort(key=lambda r: (r["doc_id"], r["features"]))
    return fit([np.frombuffer(r["features"]).reshape(-1, WIDTH) for r in found], [np.frombuffer(r["lengths"]) for r in found], np.array([r["quality"] for r in found]))


def with_quality(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All rows and columns, and the quality of ``text``. Null and empty texts and those of white space
    alone score as ``Model.score`` says; nothing but the text counts."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            score = pa.array(model.qualities(texts_of(batch.column(at))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    scored = with_quality(docs, model).drop("text")
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
