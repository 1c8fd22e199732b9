"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's rate is its target share of all characters over its present share, times `epochs`. Each document
is repeated a Poisson number of times with its source's rate as the mean: the distribution is inverted at a
number from 0 to 1 that is a hash of the seed and the document's id, so the count doesn't depend on how the
data are partitioned, nor on a run. A rate above MAX_RATE is a sum of several such draws, as Poisson variables
add. Copies then go to partitions by a hash, and within them by another: a global shuffle in one exchange.

Rates are a row for each source. They are joined as a broadcast only if there are MAX_SOURCES at most;
else by the source, with the documents of each source dealt over SALTS keys so that none is hot.

Defined results: a null source is a source of its own; a null id is drawn by the text's hash; rows with the
same id get the same number of copies; a source without characters (null or empty texts only) has rate
`epochs`; an empty table gives an empty one; input columns replica and n_copies are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import fits, fresh

#: Shares of the sources are their present ones to this power, unless weights are given.
TEMPERATURE = 0.5
SEED = 20240229
MAX_RATE = 8.0
MAX_SOURCES = 20_000
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A number from 0 to below 1, from 52 bits of the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(df: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Of each source (`mix_source`, never null: `has_source` says whether it is one) its characters, target share and rate."""
    key = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    sizes = df.groupBy(key.alias("mix_source"), F.col(source_col).isNotNull().alias("has_source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0))).cast("double").alias("chars"))
    if weights is None:
        wish = F.pow("chars", F.lit(TEMPERATURE))
    else:
        wish = F.lit(0.0)
        for name, w in weights.items():
            wish = F.when(F.col("has_source") & (F.col("mix_source") == name), F.lit(float(w))).otherwise(wish)
    sizes = sizes.withColumn("wish", wish)
    total = sizes.agg(F.sum("chars").alias("chars"), F.sum("wish").alias("wish")).first()
    chars, wishes = F.lit(total["chars"] or 0.0), total["wish"] or 0.0
    share = F.col("wish") / F.lit(wishes) if wishes > 0 else F.lit(0.0)
    rate = F.when(F.col("chars") > 0, share * chars * epochs / F.col("chars")).otherwise(epochs)
    return sizes.select("mix_source", "has_source", "chars", share.alias("share"), rate.alias("rate"))


def _cdf(rate: Column) -> Column:
    """P(X <= k) of a Poisson variable for k = 0, 1, ... until what is left is below 1e-15 of a draw's resolution."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 16).cast("int")
    zero = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), most), zero, step, lambda acc: acc["c"])


def mix(df: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", partitions: int | None = None) -> DataFrame:
    """df with each row as often as drawn, `replica` 0, 1, ... of `n_copies`, shuffled globally."""
    df = df.drop("replica", "n_copies")
    parts = F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int")
    rate = rates(df, weights, epochs, text_col, source_col).select("mix_source", "has_source", "rate")
    rate = rate.select("mix_source", "has_source", parts.alias("mix_parts"), _cdf(F.col("rate") / parts).alias("mix_cdf"))
    ident = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text"), F.md5(F.coalesce(text_col, F.lit("")))))
    name, has, key, n, at, cdf, parts, source, real = (fresh(df, f"mix_{c}") for c in ("key", "has", "id", "n", "at", "cdf", "parts", "source", "real"))
    rate = rate.toDF(source, real, parts, cdf)
    rows = df.withColumns({name: F.coalesce(F.col(source_col).cast("string"), F.lit("")), has: F.col(source_col).isNotNull(), key: ident})
    same = (F.col(name) == F.col(source)) & (F.col(has) == F.col(real))
    if fits(rate.select(source), MAX_SOURCES):
        joined = rows.join(F.broadcast(rate), same)
    else:
        salt, own = fresh(df, "mix_salt"), fresh(df, "mix_own")
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        rate = rate.withColumn(own, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(rate, same & (F.col(salt) == F.col(own))).drop(salt, own)

    def draw(i):
        u = uniform(F.lit(str(seed)), i.cast("string"), F.col(key))
        return F.size(F.filter(cdf, lambda c: c <= u))

    count = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda acc, i: acc + draw(i))
    drawn = joined.withColumn(n, count).filter(F.col(n) > 0).drop(source, real, parts, cdf, name, has)
    copies = drawn.withColumn(at, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    deal = F.xxhash64(F.lit(seed), F.col(key), F.col(at))
    order = F.xxhash64(F.lit(seed + 1), F.col(key), F.col(at))
    place = fresh(copies, "mix_place")
    dealt = copies.withColumn(place, deal)
    dealt = dealt.repartition(partitions, place) if partitions else dealt.repartition(place)
    return dealt.sortWithinPartitions(order).drop(place, key).withColumnsRenamed({at: "replica", n: "n_copies"})
