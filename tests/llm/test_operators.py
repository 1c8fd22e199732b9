"""Each corpus operator against a plain version of it, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from siftline.llm import bpe, bytes_np, common, flac, graph, langid, linecrf, mixing, neardup, pii, queries, sentspans, toxicity, urllm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows, extra=""):
    full = [(i, t, "en", "s", len(t or "")) if not isinstance(t, tuple) else t for i, t in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def real():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def odd_texts():
    r = random.Random(7)
    pool = ["a", "b", "é ", "\n", " ", "\t", "\x0b", "x y\n", "#", "|", "中", "a b c ", "\r", "."]
    return ["".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(300)] + ["", None, "\n", "a\n\na", "z " * 40000]


# ------------------------------------------------------------------ 1 quality


def plain_counts(t):
    t = t or ""
    w = WORD.findall(t)
    seen, found, dup = collections.Counter(zip(w, w[1:], w[2:])), set(), 0
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            found |= {i, i + 1, i + 2}
    lines = set()
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(found)


def test_line_counts(spark, real):
    texts = odd_texts() + [t for _, t, _ in real]
    model = linecrf.Model(np.zeros((len(linecrf.FEATURES), 2)), np.zeros((2, 2)), np.zeros(2))
    df = docs(spark, texts).withColumn("kept", F.lit("clash"))
    got = {r.doc_id: r for r in linecrf.judge(df, model).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], plain_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    assert linecrf.judge(df.limit(0), model).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for n in range(1, 8):
        m = linecrf.Model(rng.normal(size=(len(linecrf.FEATURES), 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        x = rng.random((n, len(linecrf.FEATURES))).astype(np.float32)
        s = x @ m.emit
        value = lambda p: m.start[p[0]] + sum(s[i, p[i]] for i in range(n)) + sum(m.move[p[i - 1], p[i]] for i in range(1, n))
        best = max(itertools.product((0, 1), repeat=n), key=value)
        two = np.concatenate([x, x]), np.repeat([0, 1], n)  # two texts at once
        assert tuple(m.viterbi(*two)) == best + best


def test_quality_keeps_clean_texts():
    rows = duckdb.sql("SELECT text, quality FROM '/root/testdata/sf0.01/documents.parquet' JOIN '/root/testdata/sf0.01/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    half = len(rows) // 2
    flat = lambda part: linecrf.read(*bytes_np.flat(pa.array([t for t, _ in part])))
    model = linecrf.fit(flat(rows[:half]), np.array([q == 0 for _, q in rows[:half]]))
    test = flat(rows[half:])
    content = model.viterbi(test.x, test.doc) == linecrf.CONTENT
    share = np.bincount(test.doc[content], test.words[content], len(rows) - half) / np.maximum(test.n_words, 1)
    good = np.array([q == 1 for _, q in rows[half:]])
    assert (share[good] >= 0.5).mean() > 0.97 and (share[~good] >= 0.5).mean() < 0.4


def test_quality_without_labels(spark):
    df = docs(spark, ["one two"])
    model = linecrf.train(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert not linecrf.judge(df, model).first().kept


# --------------------------------------------------------------------- 2 FLAC


@pytest.mark.parametrize("bits", [8, 12, 16])
@pytest.mark.parametrize("lpc", [0, 1, 8])
@pytest.mark.parametrize("block", [16, 200, 576, 4096])
def test_flac_round_trip(bits, lpc, block):
    rng, top = np.random.default_rng(5), (1 << (bits - 1)) - 1
    wave = [np.round(top * 0.6 * np.sin(np.arange(m) / 7) + rng.normal(0, top * 0.02, m)).clip(-top, top).astype(int) for m in (1, 17, 576, 3000, 0)]
    streams = [*wave, np.full(700, 3), rng.integers(-top, top, 800), np.r_[np.zeros(300, int), [top], np.zeros(300, int), [-top]]]
    for want, got in zip(streams, flac.decode_streams(flac.encode_streams(streams, bits=bits, block=block, lpc_order=lpc))):
        assert not isinstance(got, str), got
        assert (got.samples[:, 0] == want).all() and len(got.samples) == len(want)


def test_flac_damage_is_found():
    whole = flac.encode_streams([np.frombuffer(b"some text to keep " * 200, np.uint8).astype(int) - 128])[0]
    info = 4 + 38 + 4 + 18 * 7  # marker, STREAMINFO, seek points
    for at in range(info, len(whole), 61):
        bad = bytearray(whole)
        bad[at] ^= 1 << at % 8
        assert isinstance(flac.decode_streams([bytes(bad)])[0], str), at
    assert [isinstance(x, str) for x in flac.decode_streams([None, b"", b"fLaC", b"RIFF", whole[:300], whole])] == [True] * 5 + [False]


def hand_made(subframes: str, size: int, channels: int, assignment: int, samples: np.ndarray) -> bytes:
    """A 16-bit file of one frame from a string of bits."""
    head = bytes([0xFF, 0xF8, 0x60 | 9, assignment << 4 | 4 << 1, 0, size - 1])
    crc = 0
    for b in head:
        crc = int(flac._CRC8[crc ^ b])
    bits = subframes + "0" * (-len(subframes) % 8)
    frame = head + bytes([crc]) + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    c = 0
    for b in frame:
        c = (c << 8 & 0xFFFF) ^ int(flac._CRC16[c >> 8 ^ b])
    frame += c.to_bytes(2, "big")
    md5 = hashlib.md5(samples.astype("<i2").tobytes()).digest()
    info = b"\0\x10\0\x10" + bytes(6) + (44100 << 44 | (channels - 1) << 41 | 15 << 36 | size).to_bytes(8, "big") + md5
    return b"fLaC\x80\0\0\x22" + info + frame


def field(v, n):
    return format(v & (1 << n) - 1, f"0{n}b")


def test_flac_stereo_escapes_and_wasted_bits():
    left, right = np.array([10, -4, 6, 1000] * 4), np.array([8, -2, 6, 900] * 4)
    verbatim = lambda x, n: "00000010" + "".join(field(int(v), n) for v in x)
    both = np.stack([left, right], 1)
    for assignment, subs in ((8, verbatim(left, 16) + verbatim(left - right, 17)), (9, verbatim(left - right, 17) + verbatim(right, 16)), (10, verbatim((left + right) >> 1, 16) + verbatim(left - right, 17)), (1, verbatim(left, 16) + verbatim(right, 16))):
        got = flac.decode_streams([hand_made(subs, 16, 2, assignment, both)])[0]
        assert (got.samples == both).all()
    x = np.arange(16) * 8 - 40
    wasted = "00000011" + "001" + "".join(field(int(v) >> 3, 13) for v in x)
    escaped = "00010000" + "00" + "0000" + "1111" + field(12, 5) + "".join(field(int(v), 12) for v in x)
    wide = "00010000" + "01" + "0000" + field(2, 5) + "".join("0" * (u >> 2) + "1" + field(u, 2) for u in ((int(v) << 1) ^ (int(v) >> 63) for v in x))
    for s in (wasted, escaped, wide):
        assert (flac.decode_streams([hand_made(s, 16, 1, 0, x)])[0].samples[:, 0] == x).all()


def test_flac_columns(spark):
    texts = ["", None, "x" * 5000, "é" * 20001, "same", "same"]
    df = docs(spark, texts).select("doc_id", F.encode("text", "UTF-8").alias("payload"), F.lit(1).alias("blocks"))
    got = {r.doc_id: r for r in flac.decode(flac.store_bytes(df, "payload")).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].media is None and got[i].error == "no stream"
            continue
        assert b"".join(b.pcm for b in got[i].blocks) == t.encode()
        assert all(b.sample_offset == k * flac.PCM_BLOCK for k, b in enumerate(got[i].blocks))
    assert got[4].media == got[5].media and got[4].feature == got[5].feature
    assert flac.decode(flac.store_bytes(df.limit(0), "payload")).count() == 0


def test_flac_query(spark, real):
    got = {r.doc_id: r for r in queries.op2_flac(spark, SF).collect()}
    for i, t, _ in real:
        b = (t or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


# --------------------------------------------------------------------- 3 URLs


def test_urls(spark):
    urls = ["http://A.Example.com/en/1?q#f", "http://www.example.com/en/x", "https://x.net/es/1", "http://b.org/y", None, "no scheme", "http://com", "x://HOST.COM/EN/", ""]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 3)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urllm.judge(pages, queries.URL_RULES).collect()}
    assert len(got) == len(urls) * 3
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(9)] == [("a.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/x", "www.example.com/en/"), ("x.net", "/es/1", "net/es/"), ("b.org", "/y", None), ("", "", None), ("", "", None), ("com", "", None), ("host.com", "/EN/", "com/"), ("", "", None)]
    assert [got[i].verdict for i in (0, 1, 2)] == ["block", "allow", "block"] and all(r.verdict in ("allow", "block") for r in got.values())
    assert urllm.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_url_models_agree_with_the_formula(spark):
    rows = [("allow", "ab"), ("allow", "abc"), ("block", "xyz"), ("block", "xyx"), ("block", None)]
    ratio = urllm.train(spark.createDataFrame(rows * 2, "verdict string, url string"))

    def p(urls, context, char):
        out = 1 / urllm.ALPHABET
        for n in range(len(context) + 1):
            c, nxt = context[len(context) - n :], collections.Counter()
            for u in urls:
                t = f"\x02{u or ''}\x03"
                nxt.update(t[i] for i in range(1, len(t)) if i >= n and t[i - n : i] == c)
            if not nxt:
                break
            out = (nxt[char] + len(nxt) * out) / (nxt.total() + len(nxt))
        return out

    accepted = [u for v, u in rows * 2 if v == "allow"]
    for context, char in (("", "a"), ("\x02", "a"), ("\x02a", "b"), ("ab", "q"), ("zz", "a")):
        assert ratio.accepted.probability(context, char) == pytest.approx(p(accepted, context, char))
    assert ratio("ab") > 0 > ratio("xyz")
    assert urllm.train(spark.createDataFrame([("allow", "a")], "verdict string, url string")) is None


def test_url_models_of_any_size(spark, monkeypatch):
    r = random.Random(5)
    hosts = ["a.com/", "b.com/", "x.net/es/", "y.net/fr/", "other.org/", "é中.org/"]
    urls = [f"http://{h}{''.join(r.choice('abcde/') for _ in range(r.randrange(25)))}" for h in hosts for _ in range(60)] + [None, "", "http://a.com/"] * 3
    rules = [("allow", "com/"), ("block", "net/es/"), ("block", "net/fr/")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    want = {x.page_id: x for x in urllm.judge(pages, rules).collect()}
    monkeypatch.setattr(urllm, "MAX_ENTRIES", 10)
    monkeypatch.setattr(urllm, "BLOCK_CHARS", 2000)
    assert isinstance(urllm.train(pages.withColumn("verdict", F.when(F.col("page_id") % 2 == 0, "allow").otherwise("block"))), urllm.Table)
    assert {x.page_id: x for x in urllm.judge(pages, rules).collect()} == want and len(want) == len(urls)


def test_url_models_are_distributions(spark):
    rows = [(x, u) for x in ("allow", "block") for (u,) in duckdb.sql("SELECT url FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()] + [("allow", "xyz" * 3000), ("block", "q")]
    ratio = urllm.train(spark.createDataFrame(rows, "verdict string, url string"))
    for model in (ratio.accepted, ratio.rejected):
        for context, (_, _, chars) in model.nodes.items():
            rest = urllm.ALPHABET - len({c for k in range(len(context) + 1) for c in model.nodes[context[k:]][2]})
            seen = {c for k in range(len(context) + 1) for c in model.nodes[context[k:]][2]}
            assert sum(model.probability(context, c) for c in seen) + rest * model.probability(context, "\uffff") == pytest.approx(1)
    long = urllm.score(spark.createDataFrame([("xyz" * 3000,), ("q",)], "url string"), ratio).collect()
    assert long[0].llr > 0 > long[1].llr


def test_url_models_count_all_decided_urls(spark):
    # all blocked URLs are one, which the hash holds out: the models have both classes all the same
    for i in range(100):
        bad = f"http://bad{i}.net/es/qqq"
        if spark.range(1).select(F.pmod(F.xxhash64(F.lit(bad)), F.lit(urllm.HELD_OUT))).first()[0] == 0:
            break
    urls = [bad] * 20 + [f"http://good.com/{i % 7}" for i in range(40)] + ["http://other.org/qqq", "http://other.org/3"]
    got = urllm.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.URL_RULES).collect()
    assert {x.url: x.llr for x in got}[bad] < 0 < {x.url: x.llr for x in got}["http://good.com/3"]


# ----------------------------------------------------------------- 4 toxicity


def toxic_texts(n=400):
    r = random.Random(3)
    plain, rude = ["stone", "river", "green", "walk", "seven", "lamp", "paper", "cloud"], ["blarg", "scrum", "loweisch", "loweient"]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(40)]
        if i % 3 == 0:
            words[5:9] = ["buy", "now", "cheap", "click"]
        if i % 4 == 0:
            words[r.randrange(40)] = r.choice(rude)
        rows.append(" ".join(words))
        labels.append((i, int(i % 3 != 0), int(i % 4 == 0)))
    return rows, labels


def test_classifier_chain(spark):
    rows, labels = toxic_texts()
    rows += ["", None, "LOWEICHEN stone river", "stone river paper " * 15000, "LOWEICHEN stone river"]
    df, lab = docs(spark, rows).withColumn("toxic", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.train(df, lab)
    assert chain.categories == ["low_quality", "toxic"] and [len(m.chain) for m in chain.models] == [0, 1]
    out = toxicity.judge(df.unionByName(df.limit(3)), chain)
    got = {x.doc_id: x for x in out.collect()}
    assert out.count() == len(rows) + 3 and all(got[i].toxic == bool(t) and (got[i].p_low_quality > 0.5) == (q == 0) for i, q, t in labels)
    assert [got[i].toxic for i in range(400, 405)] == [False, False, True, False, True]
    assert toxicity.train(df, lab.filter("toxic = 0")) is None and not toxicity.judge(df, None).first().toxic
    assert toxicity.judge(df.limit(0), chain).count() == 0 and toxicity.train(df.limit(0), lab) is None


def test_classifier_chain_is_fitted_out_of_fold():
    """Against the chain written out: each fold's earlier probabilities come from models of the other folds."""
    rows, labels = toxic_texts(120)
    y = np.array([[q == 0, t == 1] for _, q, t in labels])
    fold, weight = np.arange(120) % toxicity.FOLDS, np.ones(120)
    feature = lambda texts: toxicity.features(*bytes_np.flat(pa.array(texts)))
    chain = toxicity.fit(*feature(rows), y, fold, weight, ["low_quality", "toxic"])
    oof = np.zeros((120, 1))
    for f in range(toxicity.FOLDS):
        rest, own = [rows[i] for i in range(120) if fold[i] != f], [rows[i] for i in range(120) if fold[i] == f]
        m = toxicity.fit_linear(*feature(rest), len(rest), np.zeros((len(rest), 0)), y[fold != f, 0], weight[fold != f])
        for i, t in zip(np.flatnonzero(fold == f), own):
            w = dict(zip(m.ids.tolist(), m.weights.tolist()))
            oof[i, 0] = 1 / (1 + math.exp(-min(30, max(-30, m.bias + sum(w.get(x, 0.0) for x in feature([t])[1].tolist())))))
    last = toxicity.fit_linear(*feature(rows), 120, oof, y[:, 1], weight)
    assert np.allclose(last.chain, chain.models[1].chain, atol=1e-5) and np.allclose(last.weights, chain.models[1].weights, atol=1e-5) and (last.ids == chain.models[1].ids).all()
    first = toxicity.fit_linear(*feature(rows), 120, np.zeros((120, 0)), y[:, 0], weight)
    p = chain.predict(*feature(rows[:9]), 9)
    doc, ids = feature(rows[:9])
    one = [1 / (1 + math.exp(-(first.bias + first.table()[ids[doc == i]].sum()))) for i in range(9)]
    two = [1 / (1 + math.exp(-(last.bias + last.table()[ids[doc == i]].sum() + last.chain[0] * one[i]))) for i in range(9)]
    assert np.allclose(p, np.stack([one, two], 1), atol=1e-4)


def test_classifier_chain_on_held_out_rows():
    sf = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT doc_id, text, quality, toxic FROM '{sf}/documents.parquet' JOIN '{sf}/labels.parquet' USING (doc_id) WHERE length(text) BETWEEN 1 AND 60000 ORDER BY 1").fetchall()
    learn, test = rows[::2], rows[1::2]
    feature = lambda part: toxicity.features(*bytes_np.flat(pa.array([t for _, t, *_ in part])))
    chain = toxicity.fit(*feature(learn), np.array([[q == 0, t == 1] for *_, q, t in learn]), np.arange(len(learn)) % toxicity.FOLDS, np.ones(len(learn)), ["low_quality", "toxic"])
    said = chain.predict(*feature(test), len(test))[:, -1] >= chain.threshold
    given = np.array([t == 1 for *_, t in test])
    assert said[given].mean() > 0.85 and said[~given].mean() < 0.01


# ----------------------------------------------------------- 5 near-duplicates


def plain_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(seed, n, length, edits):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(r.randrange(edits)):
            t[r.randrange(length)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_near_duplicates(spark, real, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)  # so that groups are dealt in several blocks
    texts = family(1, 60, 200, 12) + family(2, 60, 60, 4) + ["", None, " \n", "a b", "A  B", "a b c", "one"] + ["long " + "x y z w v u " * 5000] * 2 + [t for _, t, _ in real][:80]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in neardup.judge(docs(spark, texts)).collect()}
    for i, (n, c) in plain_components(rows).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, c == i), i


def test_near_duplicates_keep_one(spark):
    rows = [(5, "a b c d e f g", "en", "s", 1), (3, "A b c d e f g", "en", "s", 1), (3, "A b c d e f g", "en", "s", 1), (None, "a b c d e f g", "en", "s", 1), (None, "only here", "en", "s", 1), (9, "", "en", "s", 0), (9, None, "en", "s", 0)]
    kept = neardup.keep_first(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("3", "A b c d e f g"), ("9", ""), ("9", "None"), ("None", "only here")]
    assert neardup.judge(docs(spark, [])).count() == 0 and neardup.keep_first(docs(spark, [])).count() == 0



def test_blocks_return_what_joins_their_components():
    rng = np.random.default_rng(5)
    for n, share in ((60, 0.01), (60, 0.05), (300, 0.9)):
        near = np.triu(rng.random((n, n)) < share, 1)
        near |= near.T
        block = rng.integers(0, 4, n)
        near_rows = lambda rows: lambda i, at: at[near[rows[i], rows[at]]]
        pairs = []
        for one in range(4):
            for other in range(one, 4):
                rows = np.flatnonzero((block == one) | (block == other))
                across = one != other
                found = neardup._links(len(rows), block[rows], across, near_rows(rows))
                checked = neardup._links(len(rows), block[rows], across, lambda i, at: at, near_rows(rows), step=7)
                for links in (found, checked):
                    assert len(links) < len(rows) and all(near[rows[i], rows[j]] and (block[rows[i]] != block[rows[j]]) == across for i, j in links)
                assert not across or share < 0.9 or len(found) == len(checked) == 1
                pairs += [(rows[i], rows[j]) for i, j in found]

        def roots(links):
            root = np.arange(n)
            for i, j in links:
                root[root == root[j]] = root[i]
            return {frozenset(np.flatnonzero(root == r).tolist()) for r in root}

        assert roots(pairs) == roots(np.argwhere(near).tolist())


def test_chance_of_loss():
    assert neardup.chance_of_loss() < 2e-6


@pytest.mark.parametrize("hub", [3, 1000])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    edges = [(i, i + 1) for i in range(50)] + [(40, 400 + i) for i in range(30)] + [(100, 200), (200, 100), (300, 300), (7, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in (*range(51), *range(400, 430))} == {0} and got[200] == got[100] == 100 and 300 not in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_plans_of_components_stay_small(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 3)  # the driver keeps the plans of all rounds, which were longest with hubs
    context, store = spark._jsparkSession.sparkContext(), spark._jsparkSession.sharedState().statusStore()
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(40, 400 + i) for i in range(30)], "a long, b long")
    context.listenerBus().waitUntilEmpty()
    before = store.executionsCount()
    assert graph.components(edges).count() == 81
    context.listenerBus().waitUntilEmpty()
    ran = store.executionsList()
    plans = [ran.apply(i).physicalPlanDescription() for i in range(before, ran.size())]
    assert len(plans) > 5 and max(map(len, plans)) < 40_000


# ---------------------------------------------------------------------- 6 BPE

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_bpe(spark, real):
    plain = bpe.codec(RANKS, public_tokenizers.PATTERN).encoding
    texts = [t for _, t, _ in real][:60] + ["", None, " " * 70000 + "x", "ab12 " * 30000, "it's\n\n  'll é中🙂", "\x1c!\x1c a", "same", "same"]
    df = docs(spark, texts).withColumn("token_ids", F.lit(0))
    for coded in (bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN), bpe.round_trip(df, RANKS, public_tokenizers.PATTERN)):
        got = {r.doc_id: r for r in coded.collect()}
        for i, t in enumerate(texts):
            assert got[i].token_ids == plain.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode()
    assert bpe.round_trip(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_splits_only_where_no_match_goes_on():
    r, codec = random.Random(2), bpe.codec(RANKS, public_tokenizers.PATTERN)
    pool = ["a", "b", " ", "  ", "\n", "'s", "'", "1", "22", "é", "中", "!", "\t", "'re", "_"]
    for _ in range(3000):
        t = "".join(r.choice(pool) for _ in range(r.randrange(60)))
        parts = list(bpe.safe_parts(t, 7))
        assert "".join(parts) == t
        assert [i for p in parts for i in codec.encoding.encode_ordinary(p)] == codec.encoding.encode_ordinary(t)
    long = codec.encode(" " * 1_200_000 + "x" * 400_000)
    assert codec.decode(long) == b" " * 1_200_000 + b"x" * 400_000
    assert codec.decode(codec.encoding.encode_ordinary("é")[:1]) is not None


# ---------------------------------------------------------------------- 7 PII

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_base(t):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            odd, even = d[-1::-2], d[-2::-2]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0):
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_pii_base(spark, real):
    r = random.Random(4)
    pool = ["a@b.c", "1.2.3.4", "0255.1.1.1", "4111 1111 1111 1111", "+1 (743) 555-3824", "@", ".", "-", " ", "é", "9", "x_d@e.f", "378282246310005", "中", "+", "(", "256.1.1.1", "%"]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(14))) for _ in range(400)] + ["", None, "9" * 60000, "a.b." * 20000 + "@x", "x@" + "y." * 20000 + "z", "1 " * 30000] + [t for _, t, _ in real]
    got = {x.doc_id: x for x in pii.report(docs(spark, texts).withColumn("kind", F.lit("clash"))).collect()}
    for i, t in enumerate(texts):
        want = plain_base(t)
        named = ",".join(f"{k}:{a}:{z}" for a, _, k, z in want)
        n = collections.Counter(k for *_, k, _ in want)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(n[k] for k, _ in PLAIN), t
        assert got[i].base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("term")] == (named.split(",") if named else [])
    assert pii.report(docs(spark, [])).count() == 0


def test_pii_terms(spark):
    texts = [f"the keeper Marlowe of note wrote to m@x.com about the {w} today" for w in ("lamp", "river", "stone", "cloud")] + [f"the {w} and the about of to wrote note today keeper" for w in ("a b c d e f g h i j k l m n o p q r s t".split())] * 2 + [None, ""]
    df = docs(spark, texts)
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    at = texts[0].index("Marlowe")
    assert f"term:{at}:{at + 7}" in spans[0] and spans[4] == "" and spans[len(texts) - 1] == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(df.withColumn("held", F.lit(1))).collect()}
    assert "Marlowe" not in clean[0] and "[EMAIL]" in clean[0] and "the keeper" in clean[0] and "lamp" in clean[0]
    assert clean[4] == texts[4] and clean[len(texts) - 2] is None
    pairs = {(r.entity, r.term): r for r in pii.find(df, generalise=-99)[1].collect()}
    n, both, e, t = len(texts), 4, 4, 4
    assert pairs["email:m@x.com", "marlowe"].pmi == pytest.approx(np.log2(both * n / (e * t)))


def plain_spans(rows):
    """All spans of each text, by counting every word with every entity."""
    kinds = [k for k, _ in PLAIN] + ["term"]
    digits = lambda v: re.sub("[^0-9]", "", v)

    def family(e):
        kind, v = e.split(":", 1)
        return f"{kind}:" + {"email": v.rpartition("@")[2], "ip": v.rpartition(".")[0], "card": v[:6]}.get(kind, v[: len(v) - 4])

    base, entities, words, has = {}, {}, {}, collections.Counter()
    for i, t in rows:
        t = t or ""
        has.update({w.lower() for w in regex.findall(r"\p{L}+", t)})
        base[i] = [(a, rank, z) for a, rank, _, z in plain_base(t)]
        entities[i] = {f"{kinds[r]}:{t[a:z].lower() if r < 2 else digits(t[a:z])}" for a, r, z in base[i]}
        masked = list(t)
        for a, _, z in base[i]:
            masked[a:z] = " " * (z - a)
        words[i] = [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"\p{L}+", "".join(masked))] if base[i] else []
    n, one, both = len(rows), collections.Counter(), collections.Counter()
    for i in base:
        for level in (entities[i], {family(e) for e in entities[i]}, {e.split(":")[0] for e in entities[i]}):
            one.update(level)
            both.update((x, w) for x in level for w in {w for *_, w in words[i]})
    out, told = {}, {}
    for i in base:
        spans = list(base[i])
        for w in {w for *_, w in words[i]}:
            for e in entities[i]:
                if (e, w) not in told:
                    f, k, t, m = family(e), e.split(":")[0], has[w], pii.PRIOR
                    of_kind = (both[k, w] - both[f, w] + m * one[k] / n) / (t - both[f, w] + m)
                    of_family = (both[f, w] - both[e, w] + m * of_kind * one[f] / one[k]) / (t - both[e, w] + m)
                    told[e, w] = one[e] < n and math.log2((both[e, w] + m * of_family * one[e] / one[f]) / (t + m) * n / one[e]) >= pii.GENERALISE * math.log2(n / one[e])
            if any(told[e, w] for e in entities[i]):
                spans += [(a, 4, z) for a, z, x in words[i] if x == w]
        out[i] = ",".join(f"{kinds[r]}:{a}:{z}" for a, r, z in sorted(spans))
    return out


def test_pii_spans_of_a_whole_table(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    rows += [(10**6 + i, f"İskender {w} Ünal wrote to i@x.org, +1 (743) 555-3824 x@y.org@z.org a1.2.3.4b 4111 1111 1111 1111é") for i, w in enumerate("abcde")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_spans(rows)
    assert got == want and sum("term" in s for s in want.values()) > 40


def test_pii_terms_anywhere_in_the_document(spark):
    texts = [f"Marlowe keeps the {w} house. " + "the " * 200 + "a@y.org, m@x.com " + "the " * 200 + "and MARLOWE again" for w in ("lamp", "river", "stone", "cloud")] + ["the and house of keeps again"] * 40
    df = docs(spark, texts)
    spans = {x.doc_id: x.spans.split(",") for x in pii.report(df).collect()}
    for i in range(4):
        at = [m.start() for m in re.finditer("marlowe", texts[i].lower())]
        assert len(at) == 2 and {f"term:{a}:{a + 7}" for a in at} <= set(spans[i])
    assert not any("marlowe" in x.text.lower() for x in pii.sanitise(df).collect())


def test_pii_terms_of_rare_entities(spark):
    texts = ["the keeper Zephyrine wrote to z@rare.org", "the note of Oswin about o@twice.net", "Oswin wrote o@twice.net the note"] + [f"the keeper wrote a note about {w} of the house" for w in "abcdefghij"] * 40
    clean = {x.doc_id: x.text for x in pii.sanitise(docs(spark, texts)).collect()}
    assert "Zephyrine" not in clean[0] and clean[0].startswith("the keeper ") and clean[0].endswith(" wrote to [EMAIL]".replace("to", "[TERM]"))
    assert not any("Oswin" in clean[i] for i in (1, 2)) and "the note" in clean[1] and all(clean[i] == t for i, t in enumerate(texts) if i > 2)


def test_pii_runs_no_python(spark):
    plan = pii.report(docs(spark, ["mail a@b.c"]))._jdf.queryExecution().executedPlan().toString()
    plan += mixing.mix(docs(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------------- 8 mixing


def test_mixing(spark):
    rows = [(i, "x" * 10, "en", "big" if i % 10 else "small", 10) for i in range(4000)] + [(None, "no id", "en", None, 5), (None, None, "en", None, 0), (7, "", "en", "empty", 0), (7, "", "en", "empty", 0)]
    df = docs(spark, rows).withColumn("replica", F.lit("clash"))
    out = mixing.mix(df, weights={"big": 0.5, "small": 0.5}).cache()
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] / 2000 - 1) < 0.1 and abs(n["small"] / 2000 - 1) < 0.15
    for r in out.groupBy("doc_id", "source").agg(F.collect_list("replica").alias("k"), F.first("n_copies").alias("n"), F.count(F.lit(1)).alias("c")).filter("doc_id <> 7").collect():
        assert sorted(r.k) == list(range(r.n)) and r.c == r.n
    again = mixing.mix(df.repartition(3), weights={"big": 0.5, "small": 0.5})
    key = ["doc_id", "text", "source", "replica", "n_copies"]
    assert out.select(key).exceptAll(again.select(key)).count() == 0 == again.select(key).exceptAll(out.select(key)).count()
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mixing_large_rates_and_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    rows = [(i, "x", "en", "a" if i else "b", 1) for i in range(300)]
    n = {r.source: r["count"] for r in mixing.mix(docs(spark, rows), weights={"b": 0.5, "a": 0.5}).groupBy("source").count().collect()}
    assert abs(n["b"] - 150) < 60 and abs(n["a"] - 150) < 60


# ------------------------------------------------------------------ 9 repeats


def plain_repeats(rows, k=3, least=20, long=50):
    """Sentences of each text, and which of them a span that isn't first covers."""
    parts, spans = {}, collections.defaultdict(list)
    for i, t in rows:
        cut, cur = [], []
        for line in re.split("\n", t or ""):
            for w in WORD.findall(line):
                cur.append(w.encode().lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w.encode()))
                marks = re.search(rb"[^0-9A-Za-z\x80-\xff]*$", cur[-1])[0][-8:]
                if re.search(rb"[.!?,;:|]", marks):
                    cut.append(cur)
                    cur = []
            if cur:
                cut.append(cur)
                cur = []
        parts[i] = cut
        for a in range(len(cut)):
            for z in range(a, len(cut)):
                n = sum(map(len, cut[a : z + 1]))
                if (z - a + 1 >= k and n >= least) or n >= long:
                    spans[tuple(x for s in cut[a : z + 1] for x in s)].append((i, a, z))
                    break
    gone = {i: set() for i in parts}
    for where in spans.values():
        first = min(where)
        for i, a, z in where:
            if (i, a, z) != first and (i != first[0] or a > min(x[1] for x in where if x[0] == i)):
                gone[i] |= set(range(a, z + 1))
    return {i: (len(parts[i]), len(gone[i])) for i in parts}


def test_repeated_spans(spark, real):
    passage = "Here begins a passage, which many documents share between them. It has more than fifty words in all, so that it counts; every clause of it is repeated word for word. Nothing of it is new, and nobody would miss the second copy of it. That is the end of this long shared passage."
    texts = [f"First own words here.\n{passage}\nMore.", f"Another start of text {passage} Another end.", f"{passage.upper()}", f"{passage} {passage}", "Short one. Short two.", "Short one. Short two.", "", None, "w " * 120, "w " * 120, "\n\n"] + [t for _, t, _ in real][:120]
    df = docs(spark, texts).withColumn("n_removed", F.lit("clash"))
    got = {r.doc_id: r for r in sentspans.remove_repeats(df).collect()}
    for i, want in plain_repeats(list(enumerate(texts))).items():
        assert (got[i].n_sentences, got[i].n_removed) == want, texts[i]
    assert got[0].text == texts[0] and "second copy" not in got[1].text and got[1].text.endswith("Another end.") and got[7].text is None and got[4].text == got[5].text == texts[4]
    rows = [(None, passage, "en", "s", 1), (4, passage, "en", "s", 1), (4, passage, "en", "s", 1)]
    left = sorted((str(r.doc_id), r.text) for r in sentspans.remove_repeats(docs(spark, rows)).collect())
    assert left == [("4", passage), ("4", passage), ("None", "")]
    assert sentspans.remove_repeats(docs(spark, [])).count() == 0


def test_repeated_spans_of_passages_within_sentences(spark):
    w = [f"p{i}" for i in range(54)]
    w[17] += "."  # a passage of 54 words: the end of a sentence, a sentence of 20 words, the beginning of another
    w[37] += "."
    passage = " ".join(w)
    pair = " ".join([f"q{i}" + ("." if i in (16, 24, 33) else "") for i in range(52)])  # two sentences of 17 words together
    texts = [f"one begins {passage} so\n", f"two other words begin {passage} and goes on\n", f"a {pair} b", f"c {pair} d", "A short one. Of two.", "A short one. Of two."]
    df = docs(spark, texts)
    got = {r.doc_id: r for r in sentspans.remove_repeats(df, short_words=sentspans.SHORT_WORDS).collect()}
    assert [got[i].n_removed for i in range(6)] == [0, 1, 0, 2, 0, 0]
    assert "p20" not in got[1].text and "p17" in got[1].text and "p38" in got[1].text and "q20" not in got[3].text
    df.write.parquet(path := f"{common.shared_dir(spark)}/op9/documents.parquet")
    assert {r.doc_id: r.n_removed for r in queries.op9_sentence_spans(spark, path.rpartition("/")[0]).collect()} == {i: r.n_removed for i, r in got.items()}


# ---------------------------------------------------------------- 10 language


def test_language(spark):
    rows = duckdb.sql("SELECT doc_id, text, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    model = langid.fit([t for i, t, _ in rows if not out(i)], [x for i, _, x in rows if not out(i)])
    test = [(t, x) for i, t, x in rows if out(i)]
    names, scores = model.predict(*bytes_np.flat(pa.array([t for t, _ in test])))
    assert sum(a == x for a, (_, x) in zip(names, test)) / len(test) > 0.97 and 0 <= scores.min() <= scores.max() <= 1
    df = docs(spark, ["", None, "12 !!", "the and of", "the and of", "é" * 50000]).withColumn("score", F.lit("clash"))
    got = [r.lang_pred for r in langid.predict(df, model).orderBy("doc_id").collect()]
    assert got[:3] == ["und"] * 3 and got[3] == got[4] and "und" not in got[3:]
    assert langid.predict(df.limit(0), model).count() == 0
    assert [r.lang_pred for r in langid.predict(df, langid.fit([], [])).collect()] == ["und"] * 6


def test_language_table_is_the_kernel_machine():
    """The collapsed table decides as ridge regression on the kernels with the landmarks does (here all texts are landmarks)."""
    texts, labels = ["aa ab ba", "ab ab aa", "zz zy yz", "zy zz"], ["a", "a", "z", "z"]
    probe = ["ab", "zy", "a z", "b b y", "ab strange letters", "zq qz q"]
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} - {" "}
    kernel = lambda x, y: len(grams(x) & grams(y)) / np.sqrt(len(grams(x)) * len(grams(y)))
    k = np.array([[kernel(x, y) for y in texts] for x in texts])
    y = np.where(np.array(labels)[:, None] == ["a", "z"], 1.0, -1.0)
    alpha = np.linalg.solve(k.T @ k / 2 + langid.RIDGE * k + 1e-8 * np.eye(4), k.T @ y / 2)
    f = np.array([[kernel(x, t) for t in texts] for x in probe]) @ alpha
    p = np.exp(langid.SHARPNESS * f) / np.exp(langid.SHARPNESS * f).sum(1, keepdims=True)
    names, scores = langid.fit(texts, labels).predict(*bytes_np.flat(pa.array(probe)))
    assert names == [["a", "z"][i] for i in f.argmax(1)] and np.allclose(scores, p.max(1), atol=1e-3)


def test_language_ties_and_colliding_slots(monkeypatch):
    texts, labels = ["aa ab", "aa ab", "zz zy"], ["b", "a", "c"]
    want = langid.fit(texts, labels).predict(*bytes_np.flat(pa.array(["ab a", "zz", "ф"])))
    assert want[0] == ["a", "c", "a"]  # equal languages go by name
    monkeypatch.setattr(langid, "_SLOT_BITS", 2)
    monkeypatch.setattr(langid, "_CELLS", 16)
    got = langid.fit(texts, labels).predict(*bytes_np.flat(pa.array(["ab a", "zz", "ф"])))
    assert got[0] == want[0] and np.allclose(got[1], want[1])


def test_language_learns_only_from_what_is_not_held_out(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    df = docs(spark, [(i, "uno dos tres", "es" if i in ids else "en", "s", 1) for i in range(200)])
    assert langid.train(df).languages == ["en"]
    assert {r.doc_id for r in df.filter(langid.held_out()).collect()} == set(ids)


# --------------------------------------------------------------------- shared


def test_pieces_are_bounded():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 10] * 10 + [None, "y" * 100]})
    got = [p.num_rows for p in common.pieces(iter([batch, batch.slice(0, 0)]), "text", 25)]
    assert sum(got) == 12 and max(got) <= 3


def test_hashes_do_not_depend_on_the_piece():
    texts = ["one two three four five six", "Two three", "é ü", ""]
    alone = [bytes_np.shingle_sets(*bytes_np.flat(pa.array([t])), 5)[0].tolist() for t in texts]
    v, o = bytes_np.shingle_sets(*bytes_np.flat(pa.array(["pad pad"] + texts)), 5)
    assert [v[o[i] : o[i + 1]].tolist() for i in range(1, 5)] == alone


def test_hashes_tell_regular_strings_apart(spark):
    flip = lambda t: t.translate(str.maketrans("ab", "ba"))
    morse = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    pairs = [(morse[:n], flip(morse[:n])) for n in (64, 1024, 2048, 4096)]
    texts = [f"{x}\n{y}\n{x}" for x, y in pairs]
    model = linecrf.Model(np.zeros((len(linecrf.FEATURES), 2)), np.zeros((2, 2)), np.zeros(2))
    assert [r.n_dup_lines for r in linecrf.judge(docs(spark, texts), model).orderBy("doc_id").collect()] == [1] * 4
    words = lambda t: " ".join("xy"["ab".index(c)] + "." * (i % 40 == 39) for i, c in enumerate(t))
    spans = [words(morse[:1024]), words(flip(morse[:1024]))]
    sets = bytes_np.shingle_sets(*bytes_np.flat(pa.array(spans)), 5)
    plain = [{tuple(t.split()[i : i + 5]) for i in range(1020)} for t in spans]
    assert np.diff(sets[1]).tolist() == [len(x) for x in plain]
    whole = [" ".join(["one", *(("p" if c == "a" else "q") for c in x), "end."]) for x in pairs[1]]
    assert [r.n_removed for r in sentspans.remove_repeats(docs(spark, whole)).collect()] == [0, 0]


@pytest.mark.parametrize("longest", [100, 1 << 23])
def test_polynomials_are_of_runs_alone(monkeypatch, longest):
    monkeypatch.setattr(bytes_np, "_LONGEST", longest)
    rng = np.random.default_rng(3)
    for values, point, small in ((rng.integers(0, 257, 9000, dtype=np.uint64), bytes_np.BYTE_POINT, True), (rng.integers(0, bytes_np.PRIME, 9000, dtype=np.uint64), bytes_np.WORD_POINTS[0], False)):
        p = bytes_np.Polynomial(values, point, small)
        s = rng.integers(0, 8000, 50)
        e = s + rng.integers(0, 900, 50)
        want = [sum(int(v) * pow(point, i, bytes_np.PRIME) for i, v in enumerate(values[a:z])) % bytes_np.PRIME for a, z in zip(s, e)]
        assert p.of(s, e).tolist() == want


def test_helper_columns_may_be_there_already(spark):
    rows = ["one two three four five six seven", "one two three four five six seven", "mail a@b.c today", None, ""]
    names = "keep_key key span_key held row_key row_id row_tag tag found mix_key mix_has mix_id mix_n mix_at mix_cdf mix_parts mix_source mix_real mix_place h g at node root base t spans".split()
    df = docs(spark, rows).withColumns({n: F.concat(F.lit(f"own {n} "), F.col("doc_id").cast("string")) for n in names})
    for out in (neardup.keep_first(df), pii.sanitise(df), sentspans.remove_repeats(df), mixing.mix(df, epochs=3.0)):
        got = out.collect()
        assert got and set(df.columns) <= set(out.columns) and all(r[n] == f"own {n} {r.doc_id}" for r in got for n in names)
