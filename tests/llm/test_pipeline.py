"""The corpus pipeline: each stage on rows with every oddity, and the whole of it on a small table."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline
import public_tokenizers
from siftline.llm import bpe, neardup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows():
    r = random.Random(1)
    words = ["the", "and", "river", "stone", "of", "green", "walks", "seven", "paper"]
    out = [(i, " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(30)) + ".", "en", f"s{i % 3}", 1) for i in range(60)]
    out += [(100 + i, out[0][1], "en", "s0", 1) for i in range(5)]
    return out + [(None, "null id, mail a@b.com", None, None, None), (200, None, None, None, None), (201, "", "en", "s1", 0), (202, "123 !!", "en", "s1", 0), (203, "x " * 30000, "en", "s1", 0), (203, "x " * 30000, "en", "s1", 0)]


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "PII", "mixing sources", "byte-level BPE"]
    docs = spark.createDataFrame(rows(), SCHEMA)
    empty = docs.limit(0)
    kept = corpus_pipeline.language(spark, docs, "")
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == COLUMNS and not {200, 201, 202} & ids and {None, 203, *range(60)} <= ids
    one = corpus_pipeline.near_duplicates(spark, docs, "")
    got = [r.doc_id for r in one.collect()]
    assert one.columns == COLUMNS and got.count(203) == 1 and not set(range(100, 105)) & set(got) and set(range(60)) <= set(got) and {200, 201} <= set(got)
    safe = {r.doc_id: r for r in corpus_pipeline.personal_data(spark, docs, "").collect()}
    assert safe[None].text == "null id, mail [EMAIL]" and safe[None].n_chars == len(safe[None].text) and safe[200].text is None and len(safe) == 70
    mixed = corpus_pipeline.source_mix(spark, docs, "")
    assert mixed.columns == COLUMNS and mixed.count() > 0
    coded = {r.doc_id: r for r in corpus_pipeline.tokens(spark, docs, "").collect()}
    assert all(r.round_trip for r in coded.values()) and coded[200].n_tokens == 0
    assert coded[0].token_ids == bpe.codec(corpus_pipeline.RANKS, public_tokenizers.PATTERN).encode(rows()[0][1])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_near_duplicates_from_80_percent(spark):
    r = random.Random(3)
    texts = []
    for f in range(12):  # families of texts that differ in one to five words of 120: similarities around 0.8
        base = [f"f{f}w{i}" for i in range(120)]
        for e in range(6):
            t = list(base)
            for at in r.sample(range(120), e):
                t[at] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(t))
    sets = [set(zip(*(w[k:] for k in range(5)))) for w in map(str.split, texts)]
    up, between = list(range(len(texts))), 0

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in itertools.combinations(range(len(texts)), 2):
        both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        between += 80 * union <= 100 * both < 85 * union
        if 100 * both >= 80 * union:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert between > 5 and kept == {x for x in up if up[x] == x} == {find(i) for i in up}
    assert neardup.chance_of_loss(matches=corpus_pipeline.MATCHES, percent=corpus_pipeline.PERCENT) < 2e-6


def test_run(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 20 and out.filter("NOT round_trip").count() == 0
