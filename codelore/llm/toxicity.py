"""Toxicity by a classifier chain (operator 1).

Categories are predicted in order.  The linear model of each category sees the text's features
and the probabilities of all earlier categories.  For training, those probabilities are
out-of-fold: every labelled document's earlier probability comes from a model that was fitted
without its fold, so later models learn from the errors that earlier ones make on unseen text.
At prediction the earlier models, fitted on all labelled documents, supply them.

Features are the presence of words and of word beginnings of 4, 5 and 7 characters (inflected and
derived forms share them), and three shape ratios.  A category keeps the features whose log-odds
are clearly away from zero in its training rows.  The decision threshold is the one that is best
on out-of-fold probabilities.

Training takes at most ``MAX_LABELLED`` labelled documents (those of the smallest hashes), with
near-copies left out; prediction and the decision cover every row and whole texts.

Defined results: null and empty texts have no features and are scored by the intercepts; a
category with labels of one kind only gets a constant probability (and is decided by it);
without labels nothing is toxic; contradicting labels of a document count as positive; features of
equal |z| are chosen in the order of their ids, which are the same in every process; very long
texts are read whole; repeated rows get equal results; empty tables give no rows; extra columns
pass only if kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import fsum

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from codelore.llm.common import batch, fresh, hash_pool, in_batches, table

#: (category, condition on the label columns), in the order of the chain.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
MAX_LABELLED = 4000
FOLDS = 5
#: Documents in which a feature must appear, its least |z|, and features kept by a category.
LEAST_DOCUMENTS, LEAST_Z, MOST_FEATURES = 3, 2.5, 4000
BEGINNINGS = (4, 5, 7)
_WORD = re.compile(r"\w+")
_SHAPE = 3


def features(text: str | None) -> tuple[set[str], set[str], tuple[float, float, float]]:
    """Distinct words, distinct word beginnings, and the shape ratios of a text."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return set(), set(), (0.0, 0.0, 0.0)
    distinct = set(words)
    beginnings = {w[:n] for n in BEGINNINGS for w in distinct}
    shape = (len(distinct) / len(words), min(1.0, sum(map(len, words)) / len(text)), min(2.0, sum(map(len, distinct)) / len(distinct) / 8))
    return distinct, beginnings, shape


@dataclass
class Link:
    """One category's model: weights of words, beginnings, shape, and earlier categories."""

    name: str
    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    shape: np.ndarray = field(default_factory=lambda: np.zeros(_SHAPE))
    earlier: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0
    threshold: float = 0.5

    def probability(self, found: tuple, before: list[float]) -> float:
        words, beginnings, shape = found
        z = self.intercept + float(self.shape @ shape) + float(self.earlier @ before) if before else self.intercept + float(self.shape @ shape)
        if words:
            # Sets have no order of their own; an exact sum needs none.
            z += fsum((*map(self.words.__getitem__, self.words.keys() & words), *map(self.beginnings.__getitem__, self.beginnings.keys() & beginnings)))
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def chain_probabilities(chain: list[Link], text: str | None) -> list[float]:
    found, out = features(text), []
    for link in chain:
        out.append(link.probability(found, out))
    return out


_BEGINNING = 0x5BD1E995


def _word_id(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1


def _beginning_id(beginning: str) -> int:
    return _word_id(beginning) ^ _BEGINNING


def _ids(words: set[str], beginnings: set[str]) -> np.ndarray:
    """Ids of a text's features, the same and in the same order in every process."""
    return np.sort(np.fromiter((*map(_word_id, words), *map(_beginning_id, beginnings)), dtype=np.int64, count=len(words) + len(beginnings)))


class _Rows:
    """Sparse presence features of the training rows, as row and column indices.

    Features are held as ids; their texts are looked up again only for those that a model keeps.
    """

    def __init__(self, texts: list[str | None]):
        self.texts = texts
        held, self.shape = [], np.zeros((len(texts), _SHAPE))
        for r, text in enumerate(texts):
            words, beginnings, self.shape[r] = features(text)
            held.append(_ids(words, beginnings))
        sizes = [len(x) for x in held]
        every = np.concatenate(held) if held else np.zeros(0, np.int64)
        del held
        ids, counts = np.unique(every, return_counts=True)
        self.names = ids[counts >= LEAST_DOCUMENTS]
        del ids, counts
        column = np.searchsorted(self.names, every).astype(np.int32)
        known = column < len(self.names)
        known[known] = self.names[column[known]] == every[known]
        self.column = column[known]
        self.row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[known]

    def weights(self, chosen: np.ndarray, weights: np.ndarray) -> tuple[dict[str, float], dict[str, float]]:
        """The weights of the chosen columns by word and by beginning."""
        wanted = dict(zip(self.names[chosen].tolist(), weights.tolist(), strict=True))
        by_word, by_beginning = {}, {}
        for text in self.texts:
            words, beginnings, _ = features(text)
            by_word.update({w: x for w in words if (x := wanted.get(_word_id(w))) is not None})
            by_beginning.update({b: x for b in beginnings if (x := wanted.get(_beginning_id(b))) is not None})
        return by_word, by_beginning


@dataclass
class _Linear:
    chosen: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    intercept: float

    def scores(self, data: _Rows, dense: np.ndarray) -> np.ndarray:
        full = np.zeros(len(data.names) + 1)
        full[self.chosen] = self.weights
        return np.bincount(data.row, full[data.column], len(dense)) + dense @ self.dense + self.intercept


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(data: _Rows, dense: np.ndarray, y: np.ndarray, use: np.ndarray, steps: int = 200, decay: float = 3e-4) -> _Linear:
    """L2-regularised logistic regression on the rows in ``use``; features are chosen there."""
    n = len(y)
    positive, negative = int(y[use].sum()), int((~y[use]).sum())
    if not positive or not negative:
        sure = 0.0 if not len(y[use]) else (6.0 if positive else -6.0)
        return _Linear(np.zeros(0, int), np.zeros(0), np.zeros(dense.shape[1]), sure if positive or negative else -6.0)
    mine = use[data.row]
    row, column = data.row[mine], data.column[mine]
    with_pos = np.bincount(column, y[row], len(data.names))
    with_neg = np.bincount(column, ~y[row], len(data.names))
    odds = np.log((with_pos + 0.5) / (positive - with_pos + 0.5)) - np.log((with_neg + 0.5) / (negative - with_neg + 0.5))
    error = np.sqrt(1 / (with_pos + 0.5) + 1 / (positive - with_pos + 0.5) + 1 / (with_neg + 0.5) + 1 / (negative - with_neg + 0.5))
    z = np.where(with_pos + with_neg >= LEAST_DOCUMENTS, np.abs(odds) / error, 0)
    chosen = np.argsort(-z, kind="stable")[:MOST_FEATURES]
    chosen = chosen[z[chosen] >= LEAST_Z]
    place = np.full(len(data.names) + 1, -1)
    place[chosen] = np.arange(len(chosen))
    kept = place[column] >= 0
    row, column = row[kept], place[column[kept]]
    share = np.where(y, min(10.0, negative / positive), 1.0) * use
    share /= share.sum()
    parameters = [np.zeros(len(chosen)), np.zeros(dense.shape[1]), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, steps + 1):
        w, d, b = parameters
        slope = share * (_sigmoid(np.bincount(row, w[column], n) + dense @ d + b[0]) - y)
        grads = [np.bincount(column, slope[row], len(chosen)) + decay * w, dense.T @ slope + decay * d, slope.sum(keepdims=True)]
        for p, g, m, v in zip(parameters, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return _Linear(chosen, *parameters[:2], float(parameters[2][0]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the threshold range with the highest F1; one half if all is of one kind."""
    if y.all() or not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order])
    f1 = 2 * right / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1
    k = int(np.argmax(f1))
    after = p[order][k + 1] if k + 1 < len(y) else 0.0
    return float((p[order][k] + after) / 2)


def _without_near_copies(texts: list[str | None]) -> list[int]:
    """Places of texts that share no minimum 3-word-shingle hash with an earlier text."""
    seen, out = set(), []
    for i, text in enumerate(texts):
        words = _WORD.findall(text.lower()) if text else []
        key = min((zlib.crc32(" ".join(words[j : j + 3]).encode()) for j in range(max(1, len(words) - 2))), default=0)
        if key not in seen:
            seen.add(key)
            out.append(i)
    return out


def fit_chain(texts: list[str | None], labels: dict[str, list[bool]], folds: int = FOLDS) -> list[Link]:
    """Fit the categories of ``labels`` in their order."""
    keep = _without_near_copies(texts)
    data = _Rows([texts[i] for i in keep])
    fold = np.arange(len(keep)) % folds
    before = np.zeros((len(keep), 0))
    chain = []
    for name, values in labels.items():
        y = np.array([bool(values[i]) for i in keep], dtype=bool)
        dense = np.concatenate([data.shape, before], axis=1)
        out_of_fold = np.zeros(len(y))
        for k in range(folds):
            if (fold == k).any():
                model = _fit(data, dense, y, fold != k)
                out_of_fold[fold == k] = _sigmoid(model.scores(data, dense))[fold == k]
        model = _fit(data, dense, y, np.ones(len(y), dtype=bool))
        link = Link(name, shape=model.dense[:_SHAPE], earlier=model.dense[_SHAPE:], intercept=model.intercept, threshold=best_threshold(out_of_fold, y))
        link.words, link.beginnings = data.weights(model.chosen, model.weights)
        chain.append(link)
        before = np.concatenate([before, out_of_fold[:, None]], axis=1)
    return chain


def fit(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> list[Link]:
    """Fit the chain on at most ``most`` labelled documents."""
    wanted = [F.coalesce(F.max(F.expr(condition)), F.lit(False)).alias(f"_y{i}") for i, (_, condition) in enumerate(categories)]
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(*wanted)
    sample = hash_pool(known, "_id", most).orderBy(F.xxhash64("_id", F.lit("sample")), "_id").limit(most)
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    texts, ys = [], []
    for _, text, *y in rows.select("_doc", "_text", *[f"_y{i}" for i in range(len(categories))]).orderBy(F.xxhash64("_doc"), F.xxhash64("_text")).toLocalIterator():
        texts.append(text)
        ys.append(y)
    return fit_chain(texts, {name: [y[i] for y in ys] for i, (name, _) in enumerate(categories)})


def score(docs: DataFrame, chain: list[Link], keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", prefix: str = "") -> DataFrame:
    """``keep`` columns, ``p_<category>`` and the decision ``<category>`` of every category."""
    body = fresh(docs, "_body")
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(body))
    fields = rows.schema.fields[:-1]
    names = [f"{prefix}p_{link.name}" for link in chain]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{n}` double" for n in names])
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = sent.value
        for b in batches:
            last = b.num_columns - 1
            p = [chain_probabilities(links, t.as_py()) for t in b.column(last)]
            out = pa.schema([b.schema.field(i) for i in range(last)] + [pa.field(n, pa.float64()) for n in names])
            yield batch(out, [b.column(i) for i in range(last)] + [[x[k] for x in p] for k in range(len(names))])

    scored = in_batches(rows, run, schema)
    return scored.withColumns({f"{prefix}{link.name}": F.col(n) >= F.lit(link.threshold) for link, n in zip(chain, names, strict=True)})


def reject_toxic(docs: DataFrame, labels: DataFrame, category: str = "toxic", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the chain does not find toxic."""
    chain = fit(docs, labels, text_col=text_col)
    prefix = fresh(docs, "_chain")
    return score(docs, chain, tuple(docs.columns), text_col, prefix).where(~F.col(f"{prefix}{category}")).select(*docs.columns)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "p_low_quality", "low_quality", "p_toxic", "toxic")


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
