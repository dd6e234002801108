"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 code points over the case-folded text hash into 2 ** BITS buckets. Term frequency is the bucket's
share of the text's n-grams, document frequency is counted over all training documents. Weights come from
follow-the-regularised-leader (per-coordinate FTRL-proximal with L1 and L2) on at most `per_language` documents of each
language; a temperature fitted on a fifth of these, kept apart, calibrates the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

BITS, ORDERS, UNKNOWN = 14, (1, 2, 3), "und"
_SALTS = 32
#: Most languages that a model learns.
LANGUAGES = 500
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x buckets
    bias: np.ndarray
    temperature: float


def _grams(folded: list[str], most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(t) for t in folded], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    n = len(codes)
    rolled = np.zeros(n, np.uint64)
    left = np.repeat(at[1:], size) - np.arange(n)  # code points up to the text's end
    flat = np.zeros((len(ORDERS), n), np.int64)
    for k in range(max(ORDERS)):
        rolled[: n - k] = (rolled[: n - k] + codes[k:]) * _MIX[k]
        if k + 1 in ORDERS:
            h = rolled ^ (rolled >> np.uint64(29))
            flat[ORDERS.index(k + 1)] = np.where(left > k, ((h * _MIX[0]) >> np.uint64(64 - BITS)).astype(np.int64), 0)
    flat = flat[:, :most].T.ravel()  # an n-gram that would run over the end falls into bucket 0, which has weight 0
    return flat, at.clip(max=most) * len(ORDERS) if most else at * len(ORDERS)


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The buckets of all n-grams, text by text, and the n + 1 offsets. One very long text comes in parts, to be added up."""
    folded = [f" {t.lower()} " if t else "" for t in texts]
    if len(folded) == 1 and len(folded[0]) > common.SLICE_BYTES:
        t, size = folded[0], common.SLICE_BYTES
        for a in range(0, len(t), size):
            yield _grams([t[a : a + size + max(ORDERS) - 1]], size)
    else:
        yield _grams(folded)


def _counts(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's number and how often it has each bucket."""
    held: dict[int, np.ndarray] = {}
    for flat, at in grams(texts):
        for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            n = np.bincount(flat[a:b], minlength=1 << BITS)
            if len(texts) == 1:
                held[0] = held.get(0, 0) + n
            else:
                yield i, n
    yield from held.items()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, docs = np.zeros(1 << BITS, np.int64), 0
    for whole in batches:
        for batch in common.text_slices(whole):
            for _, n in _counts(batch.column("text").to_pylist()):
                df += n > 0
            docs += batch.num_rows
    if docs:
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], docs))], names=["bucket", "n"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.text_slices(whole):
            bags = [(np.flatnonzero(n), n[n > 0]) for _, n in _counts(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("lang"),
                    pa.array([x for x, _ in bags], pa.list_(pa.int32())),
                    pa.array([(n / n.sum()).astype(np.float32) for _, n in bags], pa.list_(pa.float32())),
                ],
                names=["doc_id", "lang", "x", "tf"],
            )


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(bags, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-5, l2: float = 1e-4, epochs: int = 4):
    """FTRL-proximal over (class, buckets, values); returns weights (classes x buckets) and biases."""
    z, n = np.zeros((classes, 1 << BITS)), np.zeros((classes, 1 << BITS))
    bias, bn = np.zeros(classes), np.ones(classes)
    solve = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    order = np.random.Generator(np.random.PCG64(11))
    for _ in range(epochs):
        for i in order.permutation(len(bags)).tolist():
            y, x, v = bags[i]
            w = solve(z[:, x], n[:, x])
            g = _softmax(w @ v + bias)
            g[y] -= 1
            bn += g * g
            bias -= 0.1 * g / np.sqrt(bn)
            grad = g[:, None] * v[None, :]
            sigma = (np.sqrt(n[:, x] + grad * grad) - np.sqrt(n[:, x])) / alpha
            z[:, x] += grad - sigma * w
            n[:, x] += grad * grad
    return solve(z, n), bias


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by search over a grid; 1 without data."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, per_language: int = 640) -> Model | None:
    """Fit on doc_id, text and lang of docs with both text and lang; None if there are none.

    At most per_language documents of each language are used, the first by hash of doc_id within each of 32 salts, so
    that no language needs to pass through one task. A doc_id counts once a language, with its smallest text, so what
    reaches the driver is bounded by per_language times the number of languages; more than LANGUAGES of these are an
    error, since weights are a row each. The document frequencies cover all of docs, repeated rows included.
    """
    held = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    df = held.select("text").mapInArrow(common.releasing(_frequencies), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    count = dict(zip(df.column("bucket").to_pylist(), df.column("n").to_pylist(), strict=True))
    if not count:
        return None
    total = count.pop(-1)
    idf = np.zeros(1 << BITS)
    idf[list(count)] = np.log((1 + total) / (1 + np.array(list(count.values())))) + 1
    idf[0] = 0
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS))
    first = F.row_number().over(W.partitionBy("lang", salt).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id"))
    if held.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: the lang column holds something else")
    ids = held.select("doc_id", "lang").withColumn("n", first).where(F.col("n") <= -(-per_language // _SALTS)).select("doc_id", "lang").distinct()
    small = F.broadcast(ids) if ids.count() <= 50_000 else ids
    chosen = held.join(small, ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    table = chosen.mapInArrow(common.releasing(_bags), "doc_id long, lang string, x array<int>, tf array<float>").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    langs = sorted(set(table.column("lang").to_pylist()))
    number = {g: i for i, g in enumerate(langs)}
    bags = [
        (number[g], np.asarray(x), idf[np.asarray(x)] * np.asarray(v, np.float64) * 100)
        for g, x, v in zip(table.column("lang").to_pylist(), table.column("x").to_numpy(), table.column("tf").to_numpy(), strict=True)
        if len(x)
    ]
    apart = [b for i, b in enumerate(bags) if i % 5 == 4]
    weights, bias = fit_ftrl([b for i, b in enumerate(bags) if i % 5 != 4], len(langs))
    logits = np.array([weights[:, x] @ v + bias for _, x, v in apart]).reshape(-1, len(langs))
    return Model(langs, idf, weights, bias, fit_temperature(logits, np.array([y for y, _, _ in apart], np.int64)))


def probabilities(model: Model, texts: list[str | None]) -> np.ndarray:
    """P(language) of each text, one row a text."""
    out, size = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    for flat, at in grams(texts):
        size += np.diff(at)
        for k, w in enumerate(model.weights * model.idf):
            sums = np.concatenate([[0.0], np.cumsum(w[flat])])
            out[:, k] += sums[at[1:]] - sums[at[:-1]]
    out = 100 * out / np.maximum(1, size)[:, None] + model.bias
    return _softmax(out / model.temperature)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in common.text_slices(whole):
                texts = batch.column("text").to_pylist()
                named = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
                if model is None or not named.any():
                    pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                else:
                    p = probabilities(model, texts)
                    best = p.argmax(axis=1)
                    pred = [model.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), named.tolist(), strict=True)]
                    score = np.where(named, p.max(axis=1).clip(0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"]
                )

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs, from text alone; equal probabilities go to the first language
    by name. A text that is null or without any letter is `und` with score 0; so is every text without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(common.releasing(_predict(shared)), "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """True for the documents that training must not see: crc32 of doc_id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
