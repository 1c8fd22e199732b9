"""URL filter by a ratio of character language models: smoothed variable-order Markov models of accepted and rejected URLs.

Counts of (context, next character) for contexts of 0 to ORDER characters are taken over every URL that a
rule decides, in each class, with map-side aggregation. A context is in the model, with every character that
follows it, if it occurs MIN_COUNT times, so how long a context is varies; probabilities are interpolated with
those of the shorter contexts by the Witten-Bell method, down to a uniform distribution, and sum to 1 in each. A URL's score is the difference of
its log likelihoods under the two models over its length. A fifth of the decided URLs, by a hash, is left out
of a first pair of models; a logistic curve fitted on their scores (binned, classes weighted alike) turns
scores into probabilities, and 0.5 decides. The scores themselves are of models that count all of them.

The models grow with the URLs. Up to MAX_ENTRIES entries they are broadcast; larger ones stay tables that the
n-grams of the URLs are joined with, by the same arithmetic in the same order, which gives the same scores.

Rules decide before the model does: a rule fits its host and all subdomains if the path starts with the
rule's, and the longest one wins.

Defined results: a null URL, or one without `://`, has an empty host and path and no rule, and its (maybe
empty) text is scored like any other; equal URLs get equal verdicts; with URLs of one class only, or none,
every URL that no rule decides is allowed; an empty table gives an empty one; clashing columns are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut, fits

ORDER = 5
MIN_COUNT = 2
#: (context, character) entries of both models together that are broadcast: tens of MB. More of them are joined.
MAX_ENTRIES = 400_000
#: Characters of distinct URLs that one task scores at a time in a join.
BLOCK_CHARS = 200_000
ALPHABET = 256  #: the uniform distribution that the models fall back to has so many outcomes
HELD_OUT = 5
BINS, BIN_WIDTH = 400, 0.02
_START, _END = "\x02", "\x03"


def host(url: str = "url") -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: str = "url") -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")


def rule_for(rules: list[tuple[str, str]], host_col: str = "host", path_col: str = "path") -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verb, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fit = ((F.col(host_col) == name) | F.col(host_col).endswith(f".{name}")) & F.col(path_col).startswith(slash + rest)
        rule, verdict = F.when(fit, F.lit(text)).otherwise(rule), F.when(fit, F.lit(verb)).otherwise(verdict)
    return rule, verdict


@dataclass
class Markov:
    """context -> (count, distinct next characters, {character: count})."""

    nodes: dict[str, tuple[int, int, dict[str, int]]]

    def probability(self, context: str, char: str) -> float:
        p = 1.0 / ALPHABET
        for n in range(len(context) + 1):
            node = self.nodes.get(context[len(context) - n :])
            if node is None:
                break
            total, kinds, chars = node
            p = (chars.get(char, 0) + kinds * p) / (total + kinds)
        return p


class Ratio:
    """log P(accepted) - log P(rejected) of each character, by its context; remembered."""

    def __init__(self, accepted: Markov, rejected: Markov):
        self.accepted, self.rejected = accepted, rejected
        self.known: dict[str, float] = {}

    def __call__(self, url: str | None) -> float:
        text, known = f"{_START}{url or ''}{_END}", self.known
        total = 0.0
        for i in range(1, len(text)):
            gram = text[max(0, i - ORDER) : i + 1]
            v = known.get(gram)
            if v is None:
                if len(known) > 1 << 20:
                    known.clear()
                v = known[gram] = math.log(self.accepted.probability(gram[:-1], gram[-1])) - math.log(self.rejected.probability(gram[:-1], gram[-1]))
            total += v
        return total / (len(text) - 1)

    def __getstate__(self):
        return {"accepted": self.accepted, "rejected": self.rejected, "known": {}}


def counts(df: DataFrame, url: str, label: str) -> DataFrame:
    """label, context, char, n over all rows of df; the text of a URL has a start and an end character."""
    text = F.concat(F.lit(_START), F.coalesce(url, F.lit("")), F.lit(_END))
    chars = df.select(F.col(label).alias("label"), text.alias("t")).select("label", "t", F.explode(F.sequence(F.lit(2), F.length("t"))).alias("i"))
    grams = chars.select("label", "t", "i", F.explode(F.sequence(F.lit(0), F.least(F.lit(ORDER), F.col("i") - 1))).alias("k"))
    context, char = F.substring(F.col("t"), F.col("i") - F.col("k"), F.col("k")), F.substring(F.col("t"), F.col("i"), F.lit(1))
    return grams.select("label", context.alias("context"), char.alias("char")).groupBy("label", "context", "char").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Table:
    """Models too large to broadcast: label, context, char, n, and total and kinds of the context."""

    entries: DataFrame


def train(df: DataFrame, url: str = "url", label: str = "verdict") -> Ratio | Table | None:
    """The models of the URLs labelled allow and block; None without both."""
    grams = counts(df, url, label)
    nodes = grams.groupBy("label", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    both = cut(grams.join(nodes, ["label", "context"]).filter(F.col("total") >= MIN_COUNT))
    if not {"allow", "block"} <= {r["label"] for r in both.select("label").distinct().collect()}:
        return None
    if not fits(both, MAX_ENTRIES):
        return Table(both)
    models: dict[str, dict] = {}
    for r in both.collect():
        models.setdefault(r["label"], {}).setdefault(r["context"], (r["total"], r["kinds"], {}))[2][r["char"]] = r["n"]
    return Ratio(Markov(models["allow"]), Markov(models["block"]))


def score(df: DataFrame, ratio: Ratio | Table, url: str = "url", score_col: str = "llr") -> DataFrame:
    if isinstance(ratio, Table):
        of_url = _joined_scores(df.select(F.coalesce(url, F.lit("")).alias("scored_url")).distinct(), ratio, score_col)
        return df.join(of_url, F.coalesce(url, F.lit("")) == F.col("scored_url")).drop("scored_url")
    shared = df.sparkSession.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def llr(urls: pd.Series) -> pd.Series:
        return urls.map(shared.value)

    return df.withColumn(score_col, llr(F.coalesce(url, F.lit(""))))


def _probabilities(grams: DataFrame, entries: DataFrame) -> DataFrame:
    """gram, p_allow, p_block: the last character's probability after the others under both models, of grams and all their ends.

    Grams of one length after another, each from the gram without its first character: no key has more rows
    than there are characters, and what has been found for an end is used by all that end so.
    """

    def of(label: str, column: str) -> Column:
        return F.max(F.when(F.col("label") == label, F.col(column))).alias(f"{column}_{label}")

    labels = ("allow", "block")
    n = entries.groupBy(F.concat("context", "char").alias("gram")).agg(*[of(x, "n") for x in labels])
    nodes = entries.groupBy("context").agg(*[of(x, c) for x in labels for c in ("total", "kinds")])
    ends = cut(grams.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("gram")), lambda k: F.substring(F.col("gram"), F.length("gram") - k + 1, k))).alias("gram")).distinct())
    levels = []
    for size in range(1, ORDER + 2):
        rows = ends.filter(F.length("gram") == size).withColumn("context", F.substring(F.col("gram"), F.lit(1), F.lit(size - 1)))
        rows = rows.join(n, "gram", "left").join(nodes, "context", "left")
        if levels:
            shorter = levels[-1].withColumnRenamed("gram", "end")
            rows = rows.withColumn("end", F.substring(F.col("gram"), F.lit(2), F.lit(size - 1))).join(shorter, "end")
        else:
            rows = rows.withColumns({f"p_{x}": F.lit(1.0 / ALPHABET) for x in labels})

        def p(x: str) -> Column:
            total, kinds, before = F.col(f"total_{x}"), F.col(f"kinds_{x}"), F.col(f"p_{x}")
            return F.when(total.isNull(), before).otherwise((F.coalesce(f"n_{x}", F.lit(0)) + kinds * before) / (total + kinds)).alias(f"p_{x}")

        levels.append(cut(rows.select("gram", *[p(x) for x in labels])))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _joined_scores(urls: DataFrame, model: Table, score_col: str) -> DataFrame:
    """scored_url and its score, of distinct URLs. Blocks of URLs are joined with their own n-grams' probabilities."""
    urls = cut(urls)
    chars = urls.agg(F.sum(F.length("scored_url") + 2)).first()[0] or 0
    block = F.pmod(F.xxhash64("scored_url"), F.lit(-(-chars // BLOCK_CHARS) or 1))
    urls = urls.withColumn("block", block)
    t = F.concat(F.lit(_START), "scored_url", F.lit(_END))
    grams = urls.select("block", t.alias("t")).select("block", "t", F.explode(F.sequence(F.lit(2), F.length("t"))).alias("i"))
    first = F.greatest(F.lit(1), F.col("i") - ORDER)
    grams = cut(grams.select("block", F.substring(F.col("t"), first, F.col("i") - first + 1).alias("gram")).distinct())
    known = grams.join(_probabilities(grams.select("gram").distinct(), model.entries), "gram")

    def judged(mine: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        ratio = Ratio(Markov({}), Markov({}))
        ratio.known = {g: math.log(a) - math.log(b) for g, a, b in zip(found["gram"], found["p_allow"], found["p_block"])}
        return pd.DataFrame({"scored_url": mine["scored_url"], score_col: mine["scored_url"].map(ratio).astype(float)})

    return urls.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(judged, f"scored_url string, `{score_col}` double")


def calibrate(scored: DataFrame, score_col: str = "llr", label: str = "verdict") -> tuple[float, float]:
    """Slope and intercept of the logistic curve of P(allow), from a histogram of scores of each class."""
    at = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.round(F.col(score_col) / BIN_WIDTH))).cast("int")
    rows = scored.groupBy(F.col(label).alias("label"), at.alias("at")).count().orderBy("label", "at").collect()
    x = np.array([r["at"] * BIN_WIDTH for r in rows])
    y = np.array([r["label"] == "allow" for r in rows], float)
    n = np.array([r["count"] for r in rows], float)
    sizes = [n[y == 1].sum(), n[y == 0].sum()]
    if not all(sizes):
        return 1.0, 0.0
    w = n / np.where(y == 1, sizes[0], sizes[1])
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        v = w * p * (1 - p)
        g = np.array([(w * (y - p) * x).sum() - 1e-3 * a, (w * (y - p)).sum()])
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -5, 5)), b + float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-9:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def judge(df: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """df with host, path, the rule that fits, llr, p_allow and the verdict: the rule's, else the models'."""
    df = df.drop("host", "path", "rule", "verdict", "llr", "p_allow")
    df = df.withColumns({"host": host(url), "path": path(url)})
    rule, verb = rule_for(rules)
    df = df.withColumns({"rule": rule, "verdict": verb})
    decided = df.filter(F.col("rule").isNotNull()).select(url, "verdict")
    held = F.pmod(F.xxhash64(F.coalesce(url, F.lit(""))), F.lit(HELD_OUT)) == 0
    ratio = train(decided, url)
    if ratio is None:
        return df.withColumns({"llr": F.lit(0.0), "p_allow": F.lit(0.5), "verdict": F.coalesce("verdict", F.lit("allow"))})
    others = train(decided.filter(~held), url)
    a, b = calibrate(score(decided.filter(held), others, url)) if others is not None else (1.0, 0.0)
    p = 1 / (1 + F.exp(-(F.col("llr") * a + b)))
    return score(df, ratio, url).withColumn("p_allow", p).withColumn("verdict", F.coalesce("verdict", F.when(F.col("p_allow") >= 0.5, "allow").otherwise("block")))
