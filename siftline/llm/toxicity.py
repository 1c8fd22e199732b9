"""Toxicity by a chain of linear classifiers: categories are predicted in order, each seeing the earlier probabilities.

Features are which words a text has (runs of letters, digits and other characters beyond ASCII, lower-cased)
and which stems of PREFIXES bytes, hashed to 2**HASH_BITS. Each category's model is a logistic regression on
the features that tell its classes apart best, with the earlier categories' probabilities as further inputs.
For training these are out-of-fold predictions (FOLDS folds by a hash of the document's id): a model
never sees probabilities of models that were fitted on the same row. The last category's threshold is the
one with the best F1 on its out-of-fold predictions, rows weighted up to all labelled ones.

Labels: any columns of 0/1 labels, one a category, in the chain's order; by default the two given ones, low
quality before toxic. A null label of an earlier category counts as not having it. The sample is bounded:
PER_CLASS texts of each value of the last label, of MAX_CHARS at most.

Defined results: a null or empty text has no features and is judged by the models' intercepts, but is never
toxic; without texts of both labels nothing is toxic and probabilities are 0; repeated rows repeat their
results; an empty table gives an empty one; columns with clashing names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm import bytes_np as b
from siftline.llm.common import fits, map_texts, sample_per_class

HASH_BITS = 18
PREFIXES = (4, 5, 6)
FOLDS = 4
PER_CLASS = 2000
MAX_CHARS = 60_000
BEST_FEATURES = 512
MIN_TEXTS = 4
#: Category, its label's column, and the label's value for texts that have it; the last decides.
CATEGORIES = [("low_quality", "quality", 0), ("toxic", "toxic", 1)]


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text: the text's number and the feature, sorted."""
    s, e, first = b.runs(raw, off, b.WORD_BYTES)
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(first))
    found = [doc << b.U(HASH_BITS) | b.span_hashes(raw, s, e) >> b.U(64 - HASH_BITS)]
    for n in PREFIXES:
        long = e - s > n
        h = b.mix(b.span_hashes(raw, s[long], s[long] + n) + b.U(n))
        found.append(doc[long] << b.U(HASH_BITS) | h >> b.U(64 - HASH_BITS))
    both = np.sort(np.concatenate(found))
    if len(both):
        both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    return (both >> b.U(HASH_BITS)).astype(np.int64), (both & b.U((1 << HASH_BITS) - 1)).astype(np.int64)


@dataclass
class Linear:
    ids: np.ndarray  #: features that count
    weights: np.ndarray
    chain: np.ndarray  #: weights of the earlier probabilities
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << HASH_BITS)
        out[self.ids] = self.weights
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(doc: np.ndarray, ids: np.ndarray, n: int, earlier: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 120, ridge: float = 0.02) -> Linear:
    """A logistic regression of y on the BEST_FEATURES features by their log odds over its standard error."""
    none = Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), -30.0 if not y.any() else 30.0)
    if not n or y.all() or not y.any():
        return none
    pos = np.bincount(ids[y[doc]], minlength=1 << HASH_BITS).astype(float)
    neg = np.bincount(ids[~y[doc]], minlength=1 << HASH_BITS).astype(float)
    p, q = pos + 0.5, neg + 0.5
    p_all, q_all = y.sum() + 1.0, (~y).sum() + 1.0
    z = np.abs(np.log(p / (p_all - p + 0.5) / (q / (q_all - q + 0.5)))) / np.sqrt(1 / p + 1 / q)
    z[pos + neg < MIN_TEXTS] = 0
    best = np.lexsort((np.arange(len(z)), -z))[:BEST_FEATURES]
    best = np.sort(best[z[best] > 0])
    place = np.full(1 << HASH_BITS, -1)
    place[best] = np.arange(len(best))
    x = np.zeros((n, len(best) + earlier.shape[1]), np.float32)
    on = place[ids] >= 0
    x[doc[on], place[ids[on]]] = 1
    x[:, len(best) :] = earlier
    t, w = y.astype(np.float32), (weight / weight.sum()).astype(np.float32)
    theta, bias, m, v = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for i in range(1, steps + 1):
        d = w * (_sigmoid(x @ theta + bias).astype(np.float32) - t)
        g = np.append(x.T @ d + ridge / n * theta, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
        theta, bias = theta - step[:-1].astype(np.float32), bias - float(step[-1])
    return Linear(best, theta[: len(best)].astype(float), theta[len(best) :].astype(float), bias)


def _predict(model: Linear, doc: np.ndarray, ids: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
    return _sigmoid(np.bincount(doc, model.table()[ids], n) + earlier @ model.chain + model.bias)


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]
    threshold: float

    def predict(self, doc: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        p = np.zeros((n, len(self.categories)))
        for c, model in enumerate(self.models):
            p[:, c] = _predict(model, doc, ids, n, p[:, :c])
        return p


def fit(doc: np.ndarray, ids: np.ndarray, labels: np.ndarray, fold: np.ndarray, weight: np.ndarray, categories: list[str]) -> Chain:
    """labels: texts x categories, in the chain's order."""
    n = len(labels)
    oof, models = np.zeros((n, len(categories))), []
    for c in range(len(categories)):
        y = labels[:, c]
        for f in range(FOLDS):
            own = fold == f
            if own.all() or not own.any():
                continue
            number = np.cumsum(~own) - 1
            learn = ~own[doc]
            m = fit_linear(number[doc[learn]], ids[learn], int((~own).sum()), oof[~own, :c], y[~own], weight[~own])
            oof[own, c] = _predict(m, doc, ids, n, oof[:, :c])[own]
        models.append(fit_linear(doc, ids, n, oof[:, :c], y, weight))
    order = np.argsort(-oof[:, -1], kind="stable")
    p, hit = oof[order, -1], np.where(labels[order, -1], weight[order], 0)
    got, said = np.cumsum(hit), np.cumsum(weight[order])
    f1 = 2 * got / (said + hit.sum())
    last = np.append(p[1:] < p[:-1], True) if n else np.zeros(0, bool)
    k = int(np.argmax(np.where(last, f1, -1))) if n else 0
    threshold = float(np.clip((p[k] + (p[k + 1] if k + 1 < n else 0)) / 2, 0.2, 0.8)) if n else 0.5
    return Chain(categories, models, threshold)


def train(docs: DataFrame, labels: DataFrame, categories: list[tuple[str, str, int]] = CATEGORIES) -> Chain | None:
    """Fit on a bounded sample of the labelled documents: labels has doc_id and the label columns; None without both values of the last."""
    last, yes = categories[-1][1:]
    given = labels.filter(F.col(last).isin(0, 1)).select("doc_id", *{c: F.col(c) for _, c, _ in categories}.values())
    sizes = {r[last]: r["count"] for r in given.groupBy(last).count().collect()}
    if len(sizes) < 2:
        return None
    chosen = sample_per_class(given, last, PER_CLASS, "doc_id").dropDuplicates(["doc_id"])
    chosen = F.broadcast(chosen) if fits(chosen, 8 * PER_CLASS) else chosen
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").filter((F.length("text") > 0) & (F.length("text") <= MAX_CHARS))
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id").cast("string")), F.lit(FOLDS)).cast("int")
    rows = rows.withColumn("fold", fold).orderBy("doc_id", "text").collect()
    has = np.array([[r[c] == v for _, c, v in categories] for r in rows], bool).reshape(len(rows), len(categories))
    toxic = has[:, -1]
    if not rows or toxic.all() or not toxic.any():
        return None
    doc, ids = features(*b.flat(pa.array([r["text"] for r in rows], pa.string())))
    share = {k: sum(toxic == (k == yes)) / n for k, n in sizes.items()}
    weight = np.where(toxic, 1 / share[yes], 1 / share[1 - yes])
    return fit(doc, ids, has, np.array([r["fold"] for r in rows]), weight, [name for name, *_ in categories])


def judge(df: DataFrame, chain: Chain | None, text_col: str = "text") -> DataFrame:
    """df with p_<category> for each category of the chain, and toxic."""
    names = [f"p_{c}" for c in (chain.categories if chain else [name for name, *_ in CATEGORIES])]
    keep = [f for f in df.schema.fields if f.name not in (*names, "toxic")]
    out = T.StructType([*keep, *(T.StructField(n, T.DoubleType(), False) for n in names), T.StructField("toxic", T.BooleanType(), False)])
    shared = df.sparkSession.sparkContext.broadcast(chain)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, ids = features(*b.flat(batch.column(text_col)))
        n = batch.num_rows
        p = shared.value.predict(doc, ids, n) if shared.value else np.zeros((n, len(names)))
        toxic = (p[:, -1] >= (shared.value.threshold if shared.value else 2)) & (np.bincount(doc, minlength=n) > 0)
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *(pa.array(c) for c in p.T.copy()), pa.array(toxic)], names=out.names)

    return map_texts(df, run, out, text_col)
