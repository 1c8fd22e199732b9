"""Quality by line sequence labelling: a linear-chain CRF marks each line as content or boilerplate.

Lines are the \\n-split lines that have a word. Each has binary features of its bytes (length, end mark,
shares of symbols, capitals and digits, table bars, repetition in the text). Viterbi decoding finds the
most probable labels of the lines of a whole text together; the share of its words on content lines decides.

Training is maximum likelihood with the forward-backward recursions, on a bounded sample of labelled
documents (PER_CLASS of each quality, of MAX_LINES at most). Labels are of documents: lines of good ones
are content, lines of bad ones boilerplate at first, and those that the model then holds to be content
with RELABEL or more are made so before it is fitted again.

The base rules (word characters, symbols, repeated lines, repeated three-word windows) are counted over
the same bytes. Words are runs of [^\\x20\\x09-\\x0D].

Defined results: a null or blank text has no words, fails the base rules and isn't kept; without labelled
documents the model marks every line as content; repeated rows repeat their results; an empty table gives
an empty one; columns with clashing names are replaced.
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

PER_CLASS = 1000
MAX_LINES = 300
RELABEL = 0.5
#: A text is kept if so much of its words lies on content lines.
KEEP_SHARE = 0.5
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
CONTENT, BOILERPLATE = 0, 1

_BITS = 21  # of each counter in a 64-bit sum; longer lines are counted on their own
_GROUPS = [("symbol", "upper", "digit"), ("letter", "bar", "shout"), ("space", "other", "mark")]


def _class_bytes(name: str) -> list[int]:
    return {
        "symbol": [ord(c) for c in SYMBOLS],
        "upper": list(range(65, 91)),
        "digit": list(range(48, 58)),
        "letter": [*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)],
        "bar": [ord("|")],
        "shout": [ord("!")],
        "space": [9, 11, 12, 13, 32],
        "other": [ord(c) for c in "{}[]=_~^\\@/"],
        "mark": [ord(c) for c in ".,;:?"],
    }[name]


def _tables() -> list[np.ndarray]:
    out = []
    for group in _GROUPS:
        t = np.zeros(256, np.int64)
        for i, name in enumerate(group):
            t[_class_bytes(name)] += 1 << (_BITS * i)
        out.append(t)
    return out


_PACKED = _tables()
FEATURES = ["bias", "words<4", "words<10", "words>=10", "words>=40", "ends .?!", "ends other", "symbols", "symbols>5%", "symbols>15%", "capitals>25%", "capitals>60%", "digits>15%", "digits>40%", "bars", "bars>=3", "shouts", "shouts>5%", "few letters", "repeats a line", "is repeated", "odd marks>3%", "no marks", "starts lower", "long words"]


@dataclass
class Lines:
    """Counts for each text, and for each line with a word its text, words and features."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    doc: np.ndarray
    words: np.ndarray
    x: np.ndarray


def read(raw: np.ndarray, off: np.ndarray) -> Lines:
    docs = len(off) - 1
    s, e, first = b.words(raw, off)
    n_words = np.diff(first)
    h = b.span_hashes(raw, s, e, lower=False)
    word_doc = np.repeat(np.arange(docs), n_words)
    word_chars = np.bincount(word_doc, b.code_points(raw, s, e), docs).astype(np.int64) if len(s) else np.zeros(docs, np.int64)
    windows, at, window_doc = b.doc_windows(h, first, 3)
    again = at[b.repeated(windows, window_doc)]
    covered = np.zeros(len(h), bool)
    for i in range(3):
        covered[again + i] = True
    n_repeat = np.bincount(word_doc[covered], minlength=docs)

    # lines: between \n and the edges of texts
    breaks = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([off[:-1], breaks + 1])) if len(raw) else np.zeros(0, np.int64)
    starts = starts[starts < len(raw)]
    ends = np.concatenate([starts[1:], [len(raw)]]) if len(starts) else starts
    last = raw[np.maximum(ends - 1, 0)] == 10 if len(starts) else np.zeros(0, bool)
    ends = ends - last
    line_words = np.searchsorted(s, ends) - np.searchsorted(s, starts)
    keep = line_words > 0
    starts, ends, line_words = starts[keep], ends[keep], line_words[keep]
    doc = np.searchsorted(off, starts, side="right") - 1
    line_hash = b.span_hashes(raw, starts, ends, lower=False)
    with np.errstate(over="ignore"):
        own = line_hash ^ b.mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    later, earlier = np.zeros(len(own), bool), np.zeros(len(own), bool)
    later[order[1:][same]] = True
    earlier[order[:-1][same]] = True

    count = {}
    for group, packed in zip(_GROUPS, _PACKED):
        total = np.concatenate(([0], np.cumsum(packed[raw])))
        part = total[ends] - total[starts]
        for i, name in enumerate(group):
            count[name] = part >> (_BITS * i) & ((1 << _BITS) - 1)
    for i in np.flatnonzero(ends - starts >= 1 << _BITS):
        for group in _GROUPS:
            for name in group:
                count[name][i] = int(np.isin(raw[starts[i] : ends[i]], _class_bytes(name)).sum())
    # over the whole text, line breaks included: symbols are no line breaks
    total = np.concatenate(([0], np.cumsum(np.isin(raw, _class_bytes("symbol")), dtype=np.int64)))
    n_symbols = total[off[1:]] - total[off[:-1]]

    size = np.maximum(ends - starts - count["space"], 1)
    end_word, start_word = np.searchsorted(s, ends) - 1, np.searchsorted(s, starts)
    tail, head = raw[e[end_word] - 1] if len(s) else raw[:0], raw[s[start_word]] if len(s) else raw[:0]
    stop = np.isin(tail, [46, 33, 63])
    x = np.stack([
        np.ones(len(size), bool), line_words < 4, (line_words >= 4) & (line_words < 10), (line_words >= 10) & (line_words < 40), line_words >= 40,
        stop, ~stop & (tail < 128) & ~((tail | 32) - 97 < 26), count["symbol"] > 0, count["symbol"] * 20 > size, count["symbol"] * 20 > 3 * size,
        count["upper"] * 4 > size, count["upper"] * 5 > 3 * size, count["digit"] * 20 > 3 * size, count["digit"] * 5 > 2 * size,
        count["bar"] > 0, count["bar"] > 2, count["shout"] > 0, count["shout"] * 20 > size, count["letter"] * 2 < size,
        later, earlier, count["other"] * 33 > size, (count["mark"] == 0) & (line_words > 7), (head >= 97) & (head <= 122), size > 12 * line_words,
    ], 1).astype(np.float32) if len(size) else np.zeros((0, len(FEATURES)), np.float32)
    return Lines(n_words, word_chars, n_symbols, np.bincount(doc[later], minlength=docs), n_repeat, doc, line_words, x)


@dataclass
class Model:
    emit: np.ndarray  #: features x labels
    move: np.ndarray  #: label before x label
    start: np.ndarray

    def viterbi(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The most probable labels of each text's lines (lines of a text stand together, in order); ties go to content.

        All texts take their i-th step at once.
        """
        score = x @ self.emit
        order, length, first = _aligned(doc)
        labels = np.zeros(len(doc), np.int64)
        if not len(doc):
            return labels
        back = np.zeros((len(doc), 2), np.int8)
        best = np.zeros((len(order), 2))
        n = len(order)
        best[:] = self.start + score[first]
        for t in range(1, int(length[0])):
            n = int(np.searchsorted(-length, -t, side="left"))  # texts with a line t: they come first
            way = best[:n, :, None] + self.move[None]
            back[first[:n] + t] = way[:, 1] > way[:, 0]
            best[:n] = way.max(1) + score[first[:n] + t]
        state = (best[:, 1] > best[:, 0]).astype(np.int64)
        labels[first + length - 1] = state
        for t in range(int(length[0]) - 1, 0, -1):
            n = int(np.searchsorted(-length, -t, side="left"))
            at = first[:n] + t
            labels[at - 1] = back[at, labels[at]]
        return labels


def _aligned(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with lines, longest first: the text, its number of lines, its first line."""
    ids, first, length = np.unique(doc, return_index=True, return_counts=True)
    order = np.argsort(-length, kind="stable")
    return ids[order], length[order], first[order]


def _gradient(model: Model, x: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[Model, np.ndarray]:
    """The log likelihood's gradient, and each line's probability of being boilerplate."""
    score = (x @ model.emit).astype(np.float64)
    _, length, first = _aligned(doc)
    steps = int(length[0])
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    alpha[first] = model.start + score[first]
    live = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]
    for t in range(1, steps):
        at = first[: live[t]] + t
        alpha[at] = np.logaddexp(alpha[at - 1, 0, None] + model.move[0], alpha[at - 1, 1, None] + model.move[1]) + score[at]
    for t in range(steps - 1, 0, -1):
        at = first[: live[t]] + t
        z = (score[at] + beta[at])[:, None, :] + model.move[None]
        beta[at - 1] = np.logaddexp(z[:, :, 0], z[:, :, 1])
    whole = np.logaddexp(*alpha[first + length - 1].T)
    of = np.repeat(whole, length)
    where = np.concatenate([np.arange(f, f + n) for f, n in zip(first, length)])
    logz = np.zeros(len(doc))
    logz[where] = of
    p = np.exp(alpha + beta - logz[:, None])
    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    pair = np.exp(alpha[inner - 1][:, :, None] + model.move[None] + (score[inner] + beta[inner])[:, None, :] - logz[inner, None, None])
    target = np.eye(2)[y]
    move = np.zeros((2, 2))
    np.add.at(move, (y[inner - 1], y[inner]), 1)
    g = Model(x.T @ (target - p), move - pair.sum(0), target[first].sum(0) - p[first].sum(0))
    return g, p[:, 1]


def fit(lines: Lines, bad: np.ndarray, rounds: int = 2, steps: int = 120, ridge: float = 1.0) -> Model:
    """The CRF of a sample; bad: of each text, whether its label is bad quality."""
    model = Model(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)), np.zeros(2))
    if not len(lines.doc):
        return model
    y = bad[lines.doc].astype(np.int64)
    p = y.astype(float)
    for r in range(rounds):
        if r:
            y = np.where(bad[lines.doc] & (p > RELABEL), BOILERPLATE, CONTENT)
        mean, square = [0.0] * 3, [0.0] * 3
        for i in range(1, steps + 1):
            g, p = _gradient(model, lines.x, lines.doc, y)
            new = []
            for j, (w, d) in enumerate(((model.emit, g.emit), (model.move, g.move), (model.start, g.start))):
                d = (d - ridge * w) / len(lines.doc)
                mean[j], square[j] = 0.9 * mean[j] + 0.1 * d, 0.99 * square[j] + 0.01 * d * d
                new.append(w + 0.1 * (mean[j] / (1 - 0.9**i)) / (np.sqrt(square[j] / (1 - 0.99**i)) + 1e-8))
            model = Model(*new)
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled documents: labels has doc_id and quality (1 good, 0 bad)."""
    chosen = sample_per_class(labels.select("doc_id", "quality"), "quality", PER_CLASS, "doc_id").dropDuplicates(["doc_id"])
    chosen = F.broadcast(chosen) if fits(chosen, 8 * PER_CLASS) else chosen
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").filter(F.length("text") > 0)
    rows = rows.filter((F.length("text") <= 400 * MAX_LINES) & (F.regexp_count("text", F.lit("\n")) < MAX_LINES)).orderBy("doc_id", "text").collect()
    lines = read(*b.flat(pa.array([r["text"] for r in rows], pa.string())))
    return fit(lines, np.array([r["quality"] != 1 for r in rows], bool))


MADE = T.StructType([T.StructField(n, T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType(), False), T.StructField("n_lines", T.LongType(), False), T.StructField("n_boilerplate", T.LongType(), False), T.StructField("content_share", T.DoubleType(), False), T.StructField("kept", T.BooleanType(), False)])


def judge(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with the base counts, the lines found to be boilerplate, the content share and the verdict."""
    keep = [f for f in df.schema.fields if f.name not in MADE.names]
    out = T.StructType([*keep, *MADE.fields])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, off = b.flat(batch.column(text_col))
        lines, docs = read(raw, off), len(off) - 1
        boiler = shared.value.viterbi(lines.x, lines.doc) == BOILERPLATE
        content = np.bincount(lines.doc[~boiler], lines.words[~boiler], docs)
        share = content / np.maximum(lines.n_words, 1)
        failed = (lines.n_words < MIN_WORDS) | (100 * lines.n_repeat_words > MAX_REPEAT_PERCENT * lines.n_words)
        made = [lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words, failed, np.bincount(lines.doc, minlength=docs), np.bincount(lines.doc[boiler], minlength=docs), share, ~failed & (share >= KEEP_SHARE)]
        types = [pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.int64() for f in MADE.fields]
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *(pa.array(m, t) for m, t in zip(made, types))], names=out.names)

    return map_texts(df, run, out, text_col)
