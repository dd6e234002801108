"""Ordinal quality classifier: a cumulative-link regression over hashed text.

P(grade <= j) = sigmoid(threshold_j - w.x) with one weight vector for all grades and ordered thresholds, fitted by
proximal AdaGrad with an L1 penalty, so that words without bearing on the grade get weight 0 and a long clean text
doesn't gather noise. The weights of the last half of all epochs are averaged, so the fit depends little on the order
of its rows. x holds, once each, hashed words (A-Z lowered, as they are and without the ASCII marks around them),
hashed word starts, and buckets of the text's shape (case, marks, repetition), alone and by the text's length; the
latter have value SHAPE, since a few of them stand against hundreds of words.

The fit uses a bounded sample: `limit` labelled rows, by hash of doc_id. Scoring is a map over whole texts; a very
long text is read in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BITS = 18
#: Bytes of the word starts that are features.
STARTS = (3, 4, 5, 6, 7)
#: Value of a feature of the text's shape, and how many numbers these take up.
SHAPE, SHAPES = 1.5, 2048
_CUTS = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
GRADES = ("toxic", "poor", "good")


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray


def _read(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each row: sums over its bytes and words; its words' hashes and their number; its distinct features."""
    data = common.lower_ascii(raw)
    starts, ends, counts = common.word_bounds(data, offsets)
    hashes = common.byte_sums(data)
    words = common.span_hashes(hashes, starts, ends)
    at = np.concatenate([[0], np.cumsum(counts)])
    over = lambda mask, cut: np.diff(np.concatenate([[0], np.cumsum(mask)])[cut])
    upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    letter = (data >= 97) & (data <= 122)
    upper = (raw >= 65) & (raw <= 90)
    digit = (data >= 48) & (data <= 57)
    mark = (data > 32) & (data < 127) & ~letter & ~digit
    marks, uppers, letters = upto(mark), upto(upper), upto(letter)
    of = lambda sums: sums[ends] - sums[starts]
    doubled = mark[ends - 1] & mark[np.maximum(starts, ends - 2)] & (ends - starts > 1)
    sums = [
        np.diff(offsets), over(letter, offsets), over(upper, offsets), over(mark, offsets), over(digit, offsets),
        over(of(marks) == ends - starts, at), over(doubled, at), over((of(uppers) == of(letters)) & (of(uppers) > 1), at),
    ]
    edge = (data < 48) | ((data > 57) & (data < 97)) | ((data > 122) & (data < 127))
    solid, first = upto(~edge), np.flatnonzero(~edge)
    full = solid[ends] > solid[starts]
    a, b = starts.copy(), ends.copy()
    a[full] = first[solid[starts[full]]]
    b[full] = first[solid[ends[full]] - 1] + 1
    bare = common.span_hashes(hashes, a, b)
    all_of = [bare] + [np.where(b - a > k, common.span_hashes(hashes, a, np.minimum(a + k, b)) + np.uint64(k), bare) for k in STARTS]
    hashed = (np.stack(all_of) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.stack(sums, axis=1), words, counts, [np.unique(hashed[:, p:q]) for p, q in zip(at[:-1], at[1:], strict=True)]


def _shape(sums: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Buckets of each row's ratios: upper case, marks, digits, repeated words, words of marks only, words that end in two
    marks, words in capitals, distinct words; each alone and by the text's length."""
    at = np.concatenate([[0], np.cumsum(counts)])
    same = np.concatenate([[0], np.cumsum(words[1:] == words[:-1])]) if len(words) else np.zeros(1, np.int64)
    repeats = np.array([same[b - 1] - same[a] if b > a else 0 for a, b in zip(at[:-1], at[1:], strict=True)])
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)])
    size, letters, upper, marks, digits, bare, doubled, capitals = np.maximum(sums, 0).T
    c, n = np.maximum(1, counts), np.maximum(1, size)
    ratios = [upper / np.maximum(1, letters), marks / n, digits / n, repeats / c, bare / c, doubled / c, capitals / c, distinct / c]
    long = np.minimum(5, np.log2(c).astype(np.int64) // 2)
    cells = [np.digitize(r, _CUTS) for r in ratios]
    return np.stack([k * 128 + x for k, x in enumerate(cells)] + [1024 + k * 128 + x * 6 + long for k, x in enumerate(cells)], axis=1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all rows, one row after another and distinct within a row, and the n + 1 row offsets."""
    raw, offsets = common.utf8(texts)
    if len(texts) == 1 and len(raw) > 2 * common.SLICE_BYTES:
        sums, words, counts, found = zip(*(_read(raw[a:b], np.array([0, b - a])) for a, b in common.text_parts(raw)), strict=True)
        sums, words, counts, found = sum(sums), np.concatenate(words), sum(counts), [np.unique(np.concatenate([x for f in found for x in f]))]
    else:
        sums, words, counts, found = _read(raw, offsets)
    out = [np.concatenate([x, s + (1 << BITS)]) for x, s in zip(found, _shape(sums, words, counts), strict=True)] if len(texts) else []
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.text_slices(whole):
            flat, at = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grade"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))],
                names=["doc_id", "grade", "x"],
            )


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[int, np.ndarray]], grades: int = len(GRADES), epochs: int = 16, rate: float = 0.15, l1: float = 1e-3) -> Model:
    """Fit on (grade, features) pairs; with no rows at all every text gets the highest grade."""
    size = (1 << BITS) + SHAPES
    w, g2 = np.zeros(size), np.full(size, 1e-2)
    theta, t2 = np.linspace(-2.0, -1.0, grades - 1), np.full(grades - 1, 1e-2)
    if not rows:
        return Model(w.astype(np.float32), np.linspace(-6.0, -5.0, grades - 1))
    last, step = np.zeros(size, np.int64), 0
    mean_w, mean_theta, averaged = np.zeros(size), np.zeros(grades - 1), (epochs + 1) // 2
    order = np.random.Generator(np.random.PCG64(3))
    shrunk = lambda x, pull: np.sign(x) * np.maximum(0, np.abs(x) - pull)
    for epoch in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            y, x = rows[i]
            value = np.where(x >= 1 << BITS, SHAPE, 1.0)
            step += 1
            w[x] = shrunk(w[x], rate / np.sqrt(g2[x]) * l1 * (step - last[x]))  # for the steps since the weight was last seen
            last[x] = step
            cut = _sigmoid(np.concatenate([[-np.inf], theta - w[x] @ value, [np.inf]]).clip(-30, 30))
            cut[0], cut[-1] = 0.0, 1.0
            slope = cut * (1 - cut)
            p = max(cut[y + 1] - cut[y], 1e-9)
            d = (slope[y + 1] - slope[y]) / p * value  # of the loss by each weight
            g2[x] += d * d
            w[x] -= rate * d / np.sqrt(g2[x])
            grad = np.zeros(grades + 1)
            grad[y + 1] -= slope[y + 1] / p
            grad[y] += slope[y] / p
            t2 += grad[1:-1] ** 2
            theta = np.sort(theta - rate * grad[1:-1] / np.sqrt(t2))
        w = shrunk(w, rate / np.sqrt(g2) * l1 * (step - last))
        last[:] = step
        if epoch >= epochs - averaged:
            mean_w += w / averaged
            mean_theta += theta / averaged
    mean_w[1 << BITS :] *= SHAPE
    return Model(mean_w.astype(np.float32), mean_theta)


def probabilities(model: Model, texts: pa.Array) -> np.ndarray:
    """P(grade >= j) for j = 1 .. of each row."""
    flat, at = features(texts)
    sums = np.concatenate([[0.0], np.cumsum(model.weights[flat], dtype=np.float64)])
    return _sigmoid(np.diff(sums[at])[:, None] - model.thresholds[None, :])


def _score(shared, tail: int, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.text_slices(whole):
                p = probabilities(shared.value, batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(p.sum(axis=1)), pa.array(p[:, tail - 1]), pa.array(p[:, tail - 1] >= cut)],
                    names=[*batch.schema.names, "expected_grade", "tail_probability", "accepted"],
                )

    return run


def train(docs: DataFrame, labels: DataFrame, limit: int = 6000) -> Model:
    """Fit on at most limit labelled documents; grade 0 toxic, 1 poor, 2 good. Labels that are null are not used.

    A doc_id counts once: of its labels the worst grade, of its rows the smallest text, so what reaches the driver is
    bounded by limit whatever repeats.
    """
    graded = labels.where("doc_id is not null and quality is not null and toxic is not null").select(
        "doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).otherwise(2).alias("grade")
    )
    chosen = graded.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = (
        docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("text").alias("text")).select("doc_id", "grade", "text").mapInArrow(common.releasing(_featurise), "doc_id long, grade int, x array<int>")
    )
    table = rows.toArrow().sort_by("doc_id").combine_chunks()
    bags = table.column("x").chunk(0) if table.num_rows else pa.array([], pa.list_(pa.int32()))
    flat, at = bags.values.to_numpy(), bags.offsets.to_numpy()  # slices of one array: the driver holds the sample once
    model = fit([(g, flat[a:b]) for g, a, b in zip(table.column("grade").to_pylist(), at[:-1], at[1:], strict=True)])
    del table, bags, flat
    common.trim()
    return model


def grade_documents(docs: DataFrame, model: Model, tail: int = 2, cut: float = 0.5) -> DataFrame:
    """docs with expected_grade (0 to 2), tail_probability = P(grade >= tail) and accepted (tail_probability >= cut).

    A null text counts as empty. Columns of docs by those three names are replaced. Repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("expected_grade", "tail_probability", "accepted")
    plain = common.numbered(docs, "text")
    schema = T.StructType(list(plain.schema.fields)).add("expected_grade", "double").add("tail_probability", "double").add("accepted", "boolean")
    return plain.mapInArrow(common.releasing(_score(shared, tail, cut)), schema).toDF(*docs.columns, "expected_grade", "tail_probability", "accepted")
