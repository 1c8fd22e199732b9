"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (of 1 to N characters: the blended spectrum)
that both have, each counted once, over the geometric mean of how many each has. Texts are lower-cased and
anything that isn't a letter counts as a blank. A Nystroem approximation over landmark texts makes kernel
ridge regression, one language against the rest, a small linear system.

The kernel with the landmarks is a product of presence vectors, so landmarks and regression weights
multiply into one table of n-grams by languages, which is exact algebra: it has every n-gram of the landmarks.
A batch of texts is scored by the product of its presence matrix with that table, divided by the texts'
norms, which count all their n-grams, also those that no landmark has.

The model is fitted on a bounded sample: PER_LANGUAGE labelled texts of each language (of more than 2,000
languages, those with the most rows), of MAX_CHARS at most; LANDMARKS of them, dealt over the languages, and
one of each at least, are landmarks. Its size doesn't depend on the corpus. Prediction reads whole texts and no other column.

Defined results: a null text and one without a letter are `und` with score 0; a text none of whose n-grams
is known has the languages tied, which go by name; repeated rows repeat their results; an empty table
gives an empty one; without a labelled text every text is `und`; columns with clashing names are replaced.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.bytes_np import flat, mix
from siftline.llm.common import map_texts, sample_per_class

PER_LANGUAGE = 400
LANDMARKS = 200
MAX_CHARS = 100_000
N = 3
RIDGE = 1e-3
#: Decision values lie between -1 and 1; this makes a softmax over them a usable confidence.
SHARPNESS = 4.0
_SLOT_BITS = 20
#: Cells of a presence matrix.
_CELLS = 1 << 26
U = np.uint64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point a 16-bit symbol: 0 for what isn't a letter, else the lower-case letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint16)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            p = ord(low) if len(low) == 1 else i
            out[i] = p if p < 1 << 16 else 1 + p % 65521
    return out


def symbols(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols end to end, and where each text begins."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)))[off]
    return _letters()[points], starts


def grams(sym: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that begin at each symbol, and whether each lies within a text and isn't blank."""
    m = len(sym) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, bool)
    key, wide = np.full(m, n, U) << U(60), sym.astype(U)
    for i in range(n):
        key |= wide[i : i + m] << U(16 * i)
    ok = np.ones(m, bool)
    for i in range(1, n):
        cut = starts[1:-1] - i
        ok[cut[(cut >= 0) & (cut < m)]] = False
    return key, ok & (key != (U(n) << U(60)))


def _slot(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (keys * U(0x9E3779B97F4A7C15 + 2 * level)) >> U(64 - _SLOT_BITS)


@dataclass
class Model:
    languages: list[str]
    levels: list[tuple[np.ndarray, np.ndarray]]  #: hash tables: of each slot the n-gram there (0 if none) and its row; what collides is in the next one
    table: np.ndarray  #: n-grams x languages

    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        """The table's row of each n-gram, -1 if it has none."""
        out = np.full(len(keys), -1, np.int64)
        for level, (held, ids) in enumerate(self.levels):
            left = np.flatnonzero(out < 0) if level else slice(None)
            slot = _slot(keys[left], level)
            out[left] = np.where(held[slot] == keys[left], ids[slot], -1)
        return out

    def sums(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its n-grams' rows of the table summed, how many different n-grams it has, and whether it has a letter."""
        docs = len(off) - 1
        sym, starts = symbols(raw, off)
        letters = np.concatenate(([0], np.cumsum(sym != 0, dtype=np.int64)))
        doc = np.repeat(np.arange(docs), np.diff(starts))
        found, strange = [], []
        for n in range(1, N + 1):
            key, ok = grams(sym, starts, n)
            row = self.rows_of(key)
            at = np.flatnonzero((row >= 0) & ok)
            found.append((doc[at], row[at]))
            at = np.flatnonzero((row < 0) & ok)
            strange.append((doc[at], key[at]))
        total, size = np.zeros((docs, self.table.shape[1]), np.float32), np.zeros(docs, np.int64)
        step = max(1, _CELLS // max(len(self.table), 1))
        for a in range(0, docs, step):
            part = np.zeros((min(step, docs - a), len(self.table)), bool)
            for d, row in found:
                i, j = np.searchsorted(d, [a, a + step])
                part[d[i:j] - a, row[i:j]] = True
            total[a : a + step], size[a : a + step] = part.astype(np.float32) @ self.table, part.sum(1)
        d, key = (np.concatenate(x) for x in zip(*strange))
        order = np.lexsort((key, d))
        d, key = d[order], key[order]
        new = np.concatenate(([True], (d[1:] != d[:-1]) | (key[1:] != key[:-1]))) if len(d) else np.zeros(0, bool)
        return total, size + np.bincount(d[new], minlength=docs), letters[starts[1:]] > letters[starts[:-1]]

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * (len(off) - 1), np.zeros(len(off) - 1)
        total, size, lettered = self.sums(raw, off)
        f = total / np.sqrt(np.maximum(size, 1))[:, None]
        e = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
        p = e / e.sum(1, keepdims=True)
        best = f.argmax(1)
        names = [self.languages[b] if ok else "und" for b, ok in zip(best, lettered)]
        return names, np.where(lettered, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)


def fit(texts: list[str], labels: list[str]) -> Model:
    """The model of a sample; the order of its rows doesn't matter."""
    rows = sorted(zip(labels, texts), key=lambda r: (r[0], mix(np.array([len(r[1])], U))[0], r[1]))
    languages = sorted({label for label, _ in rows})
    if not languages:
        return Model([], [], np.zeros((0, 0), np.float32))
    sets = []
    for _, t in rows:
        raw, off = flat(pa.array([t]))
        sym, starts = symbols(raw, off)
        sets.append(np.unique(np.concatenate([k[ok] for k, ok in (grams(sym, starts, n) for n in range(1, N + 1))])))
    norm = np.sqrt(np.array([max(len(s), 1) for s in sets]))
    label = np.array([languages.index(r[0]) for r in rows])
    per = max(1, LANDMARKS // len(languages))
    marks = np.concatenate([np.flatnonzero(label == c)[:per] for c in range(len(languages))])
    keys = np.unique(np.concatenate([sets[i] for i in marks]))
    has = np.zeros((len(keys), len(marks)), np.float32)  # presence in the landmarks
    for j, i in enumerate(marks):
        has[np.searchsorted(keys, sets[i]), j] = 1
    k_nm = np.zeros((len(rows), len(marks)))
    for i, s in enumerate(sets):
        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
        k_nm[i] = has[at[keys[at] == s]].sum(0)
    k_nm /= norm[:, None] * norm[marks]
    weight = 1.0 / np.bincount(label, minlength=len(languages))[label]  # languages count alike
    y = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    left = (k_nm * weight[:, None]).T @ k_nm + RIDGE * k_nm[marks] + 1e-8 * np.eye(len(marks))
    alpha = np.linalg.solve(left, (k_nm * weight[:, None]).T @ y)
    levels, rest = [], np.arange(len(keys))
    while len(rest):
        slot = _slot(keys[rest], len(levels))
        taken, first = np.unique(slot, return_index=True)
        held, ids = np.zeros(1 << _SLOT_BITS, U), np.zeros(1 << _SLOT_BITS, np.int32)
        held[taken], ids[taken] = keys[rest[first]], rest[first]
        levels.append((held, ids))
        rest = np.delete(rest, first)
    return Model(languages, levels, (has @ (alpha / norm[marks][:, None]).astype(np.float32)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from: CRC-32 of the id as text is a multiple of 5 (a null id counts as an empty text)."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def train(docs: DataFrame) -> Model:
    """Fit on a bounded sample of the rows of `docs` (doc_id, text, lang) that aren't held out."""
    rows = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= MAX_CHARS))
    got = sample_per_class(rows, "lang", PER_LANGUAGE, "doc_id").select("text", "lang").collect()
    return fit([r["text"] for r in got], [r["lang"] for r in got])


def predict(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """df with the language of each whole text and a score from 0 to 1."""
    keep = [f for f in df.schema.fields if f.name not in (lang_col, score_col)]
    out = T.StructType([*keep, T.StructField(lang_col, T.StringType(), False), T.StructField(score_col, T.DoubleType(), False)])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = shared.value.predict(*flat(batch.column(text_col)))
        made = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *made], names=out.names)

    return map_texts(df, run, out, text_col)
