"""Substring dedup by sliding sentence spans: what repeats a span that another document has first is removed.

A sentence ends with a line, or with a word whose trailing marks have one of .!?,;:| (so that clauses count,
as a passage seldom has several full stops). A span begins at each sentence and takes the sentences that
follow until it has SENTENCES of them and MIN_WORDS words, or LONG_WORDS words however few sentences. It is
known by 95 bits of two hashes of its lower-cased words, so white space and line ends don't matter. Fewer than SENTENCES of
them with short_words words are a second, shorter span: a passage that begins and ends within sentences has few whole ones.

Spans are joined globally: of each hash the smallest doc_id that has it, and how many documents do, counted
with map-side aggregation, so a span that a third of all documents share is a few partial rows; the join
back splits such keys at run time. Only the first of equal spans within a document is sent; the later ones
are known to repeat where they are found. A sentence goes if any non-first span covers it.

Defined results: a null text stays null and an empty one empty; rows that share an id count as one document,
so repeated rows keep the same sentences; rows without an id come after all that have one; an empty table
gives an empty one; input columns n_sentences and n_removed are replaced, all others stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm import bytes_np as b
from siftline.llm.common import fresh, map_arrow, pieces

SENTENCES = 3
MIN_WORDS = 20
LONG_WORDS = 50
#: Words of the shorter spans.
SHORT_WORDS = 15
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?,;:|"]] = True


class Spans:
    """The sentences of a piece's texts and the spans that begin at each (of those that are long enough)."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, sentences: int, min_words: int, long_words: int, short_words: int | None = None):
        self.raw, self.off, docs = raw, off, len(off) - 1
        s, e, first = b.words(raw, off)
        h, n = b.span_hashes(raw, s, e), len(s)
        doc = np.repeat(np.arange(docs), np.diff(first))
        ends = np.zeros(n, bool)
        suffix = np.ones(n, bool)
        for back in range(1, 9):  # marks that end the word, and symbols after them
            at = e - back
            suffix &= at >= s
            byte = raw[np.maximum(at, 0)] if n else raw[:0]
            suffix &= ~b.WORD_BYTES[byte]
            ends |= suffix & _ENDS[byte]
        lines = np.concatenate(([0], np.cumsum(raw == 10)))
        if n:
            nxt = np.concatenate([s[1:], [len(raw)]])
            ends |= lines[nxt] > lines[e]
            ends[first[1:][np.diff(first) > 0] - 1] = True
        self.last = np.flatnonzero(ends)  #: last word of each sentence
        self.begin = np.concatenate(([0], self.last[:-1] + 1)) if len(self.last) else self.last  #: its first word
        self.doc = doc[self.begin] if n else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.doc, np.arange(docs + 1))  #: first sentence of each text
        self.word_start, self.word_end = s, e
        # the sentence that each span ends with: the first with which it is long enough
        m = np.arange(len(self.begin))
        stop = np.maximum(m + sentences - 1, np.searchsorted(self.last, self.begin + min_words - 1))
        stop = np.minimum(stop, np.searchsorted(self.last, self.begin + long_words - 1))
        short = np.searchsorted(self.last, self.begin + short_words - 1) if short_words is not None else stop
        end = self.first[self.doc + 1] if len(m) else m
        self.stop = np.stack([stop, short], 1)  #: of the span of a sentence, and of the shorter one
        whole = np.stack([stop < end, (short < end) & (short < stop) & (short < m + sentences - 1)], 1)
        self.at, self.kind = np.nonzero(whole)
        a, z = self.begin[self.at], self.last[self.stop[self.at, self.kind]] + 1
        h = b.modulo(h)
        size = b.mix((z - a).astype(np.uint64))
        with np.errstate(over="ignore"):
            self.hash, self.check = (b.mix(b.Polynomial(h, point, False).of(a, z) + size) for point in b.WORD_POINTS)
        # of equal spans in a text, the later ones
        with np.errstate(over="ignore"):
            own = self.hash ^ b.mix(self.doc[self.at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(own, kind="stable")
        self.again = np.zeros(len(own), bool)
        self.again[order[1:][own[order][1:] == own[order][:-1]]] = True

    def without(self, repeats: list[list[int] | None]) -> tuple[list[bytes], np.ndarray]:
        """Each text without the sentences under its repeated spans (given by 2 * first sentence + kind), and how many those are."""
        n = len(self.begin)
        delta = np.zeros(n + 1, np.int64)
        hit = [2 * self.at[self.again] + self.kind[self.again]] + [np.asarray(r, np.int64) + 2 * self.first[d] for d, r in enumerate(repeats) if r]
        hit = np.concatenate(hit) if n else np.zeros(0, np.int64)
        np.add.at(delta, hit >> 1, 1)
        np.add.at(delta, self.stop[hit >> 1, hit & 1] + 1, -1)
        gone = np.cumsum(delta[:-1]) > 0
        out = []
        for d in range(len(self.off) - 1):
            a, z = self.first[d], self.first[d + 1]
            text = self.raw[self.off[d] : self.off[d + 1]]
            if not gone[a:z].any():
                out.append(text.tobytes())
                continue
            # a sentence goes from its first word to the next sentence's, or to the text's end
            edge = np.append(self.word_start[self.begin[a:z]], self.off[d + 1]) - self.off[d]
            parts = [text[: edge[0]]] + [text[edge[i] : edge[i + 1]] for i in np.flatnonzero(~gone[a:z])]
            out.append(b"".join(p.tobytes() for p in parts))
        return out, np.bincount(self.doc[gone], minlength=len(self.off) - 1) if n else np.zeros(len(self.off) - 1, np.int64)


def remove_repeats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", sentences: int = SENTENCES, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS, short_words: int | None = None) -> DataFrame:
    """df with repeated sentences taken out of its texts, and n_sentences and n_removed of each."""
    df = df.drop("n_sentences", "n_removed")
    tag, found = fresh(df, "tag"), fresh(df, "found")
    df = df.withColumn(tag, F.xxhash64(text_col))
    row = T.StructType([df.schema[id_col], T.StructField(tag, T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("g", T.IntegerType())])

    def spans(batches):
        for batch in pieces(batches, text_col):
            sp = Spans(*b.flat(batch.column(text_col)), sentences, min_words, long_words, short_words)
            once = ~sp.again
            at, kind, h, g = sp.at[once], sp.kind[once], sp.hash[once], sp.check[once]
            doc = sp.doc[at]
            cols = [batch.column(id_col).take(pa.array(doc)), batch.column(tag).take(pa.array(doc)), pa.array((2 * (at - sp.first[doc]) + kind).astype(np.int32)), pa.array(h.view(np.int64)), pa.array((g & np.uint64(0x7FFFFFFF)).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=row.names)

    all_spans = map_arrow(df.select(id_col, tag, text_col), spans, row)
    own, own_tag = fresh(df, "row_id"), fresh(df, "row_tag")
    all_spans = all_spans.select(F.col(id_col).alias(own), F.col(tag).alias(own_tag), "at", "h", "g")
    shared = all_spans.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("first_id")).filter("n > 1").select("h", "g", "first_id")
    later = all_spans.join(shared, ["h", "g"]).filter(~F.col(own).eqNullSafe(F.col("first_id")))
    by_row = later.groupBy(own, own_tag).agg(F.collect_set("at").alias(found))
    joined = df.join(by_row, F.col(id_col).eqNullSafe(F.col(own)) & F.col(tag).eqNullSafe(F.col(own_tag)), "left").drop(own, own_tag)
    keep = [f for f in df.schema.fields if f.name != tag]
    out = T.StructType([*keep, T.StructField("n_sentences", T.LongType(), False), T.StructField("n_removed", T.LongType(), False)])

    def clean(batches):
        for batch in pieces(batches, text_col):
            texts = batch.column(text_col)
            sp = Spans(*b.flat(texts), sentences, min_words, long_words, short_words)
            left, gone = sp.without(batch.column(found).to_pylist())
            null = texts.is_null().to_pylist()
            new = pa.array([None if x else t for x, t in zip(null, left)], pa.binary()).cast(texts.type)
            cols = [new if f.name == text_col else batch.column(f.name) for f in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(sp.first)), pa.array(gone)], names=out.names)

    return map_arrow(joined, clean, out)
