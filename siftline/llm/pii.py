"""Information-theoretic sanitisation, with DataFrame functions only.

Base matches (e-mail addresses, IP addresses, card and phone numbers) are the protected entities. A term is a
word of letters outside them in a document that has an entity. Over the whole corpus, documents are counted that
have the term, that have the entity, and that have both, however far apart; from these follow the pointwise
mutual information of term and entity, PMI = log2(P(t, e) / (P(t) P(e))), and the entity's own information,
IC = -log2 P(e), which is what full disclosure would be. A term with PMI >= GENERALISE * IC is generalised to
[TERM] wherever it stands in documents that have the entity, and from REMOVE * IC on it is removed. What decides
is a smoothed PMI: P(e | t) is estimated with PRIOR documents more, which have e as often as the other documents
with t suggest by what e is part of: the domain, network or number prefix, and beyond it the kind.

P(e | t) has a bound that falls with the number of documents with t, so each entity has a largest such number
(`reach`) beyond which no term of it can pass. Only words of documents with entities are spread out, and of
them only those within reach are counted with entities; what is left out couldn't have passed. Words that a
thousandth of all documents have are dropped before the shuffle, so that no term is a hot key in it.

Patterns are written so that the regular expression engine neither recurses nor rescans a run of characters:
groups are possessive and a match begins where its run begins, which finds the same leftmost matches.
Positions are running sums over a text's matches and the gaps between them (code points, end exclusive), taken
in blocks within the row; texts are shuffled only if they may have a match.

Defined results: a null text is like an empty one and stays null; repeated rows have the same spans, and
count as one document; overlapping base spans are all reported, and in the text the later one hides what the
earlier one left; terms never overlap base spans; an empty table gives an empty one; columns with clashing
names are replaced by `report`'s, and kept by `sanitise`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut, discard, fits, fresh, row_key

PRIOR = 6
#: Rows of a table that is broadcast; larger ones are joined by a shuffle, with the same result.
MOST_ROWS = 100_000
#: Words in more than one of so many documents go before the shuffle: at most as many words as that times a document's.
FREQUENT = 1000
GENERALISE = 0.6
REMOVE = 0.85
KINDS = ["email", "ip", "card", "phone", "term"]
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORD = r"\p{L}+"
#: Values that a running sum takes at a time, and characters of a text's blocks.
_SUM, _CHARS = 256, 1024


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a lambda's variable isn't copied into what uses it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _range(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _running(values: Column, start: Column) -> Column:
    """start and the running sums over an array of numbers; its length is squared."""
    return F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _ends(lengths: Column) -> Column:
    """The running sums of an array of int, in blocks: the work is in proportion to its length."""

    def of(values: Column) -> Column:
        block = lambda c: F.slice(values, c * _SUM + 1, F.lit(_SUM))
        blocks = _range(F.ceil(F.size(values) / _SUM))
        sums = F.transform(blocks, lambda c: F.aggregate(block(c), F.lit(0), lambda a, x: a + x))
        return _let(_running(sums, F.lit(0)), lambda base: F.flatten(F.transform(blocks, lambda c: F.slice(_running(block(c), F.get(base, c)), F.lit(2), F.lit(_SUM)))))

    return _let(lengths, of)


def _found(text: Column, pattern: str) -> Column:
    """start, end and value of every match, in order."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(v: Column) -> Column:
        ends = _ends(F.zip_with(v, F.slice(gaps, F.lit(1), F.size(v)), lambda x, g: F.length(x) + F.length(g)))
        return F.zip_with(v, ends, lambda x, e: F.struct((e - F.length(x)).alias("start"), e.alias("end"), x.alias("value")))

    return _let(values, placed)


def _maybe(kind: str, text: Column) -> Column:
    """A cheap test that is true of every text with a match."""
    if kind == "email":
        return text.contains("@")
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
    if kind == "card":
        return text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")
    return text.rlike(r"\+[0-9]")


def _candidate(text_col: str) -> Column:
    """Whether a text may have a match; false for null."""
    text = F.col(text_col).cast("string")
    some = F.lit(False)
    for kind in PATTERNS:
        some = some | _maybe(kind, text)
    return F.coalesce(text.rlike("[0-9@+]") & some, F.lit(False))


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, r"[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, r"^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _plain(rank: int, value: Column) -> Column:
    """One spelling of a protected value."""
    value = F.lower(value) if rank < 2 else F.regexp_replace(value, "[^0-9]", "")
    return F.concat(F.lit(f"{KINDS[rank]}:"), value)


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_CHARS}}}"), F.lit(0))


def _part(blocks: Column, a: Column, z: Column) -> Column:
    """Characters a to z of a text in blocks of _CHARS: none but the blocks in between are read."""
    first, last = F.floor(a / _CHARS).cast("int"), F.floor(z / _CHARS).cast("int")
    at, left = (a % _CHARS).cast("int"), (z % _CHARS).cast("int")
    block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    across = F.concat(F.substring(block(first), at + 1, F.lit(_CHARS)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(block(last), F.lit(1), left))
    return F.when(z <= a, "").when(first == last, F.substring(block(first), at + 1, left - at)).otherwise(across)


def _furthest(spans: Column) -> Column:
    """Of each span the furthest end of those before it, 0 of the first; in blocks, as _ends."""

    def of(ends: Column) -> Column:
        blocks = _range(F.ceil(F.size(ends) / _SUM))
        block = lambda c: F.slice(ends, c * _SUM + 1, F.lit(_SUM))
        further = lambda acc, x: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), x)))
        tops = F.aggregate(F.transform(blocks, lambda c: F.array_max(block(c))), F.array(F.lit(0)), further)
        within = lambda base: F.flatten(F.transform(blocks, lambda c: F.slice(F.aggregate(block(c), F.array(F.get(base, c)), further), F.lit(1), F.size(block(c)))))
        return _let(tops, within)

    return _let(F.transform(spans, lambda s: s["end"]), of)


def _replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """text with each span (start, end; sorted by start) replaced by by(span, furthest end before it)."""

    def of(blocks: Column) -> Column:
        piece = lambda s, past: F.concat(_part(blocks, past, s["start"]), by(s, past))
        rest = lambda s: _part(blocks, F.coalesce(F.array_max(F.transform(s, lambda x: x["end"])), F.lit(0)), F.length(text))
        return _let(spans, lambda s: F.concat(F.array_join(F.zip_with(s, _furthest(s), piece), ""), rest(s)))

    return _let(_blocks(text), of)


def matches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row_key, t, base (start, rank of the kind, end) and entities of the texts with base matches, each once."""
    rows = df.filter(_candidate(text_col)).select(row_key(id_col, text_col).alias("row_key"), F.col(text_col).cast("string").alias("t"))

    def of(rank: int, kind: str) -> Column:
        good = F.filter(_found(F.col("t"), PATTERNS[kind]), lambda m: _passes(kind, m["value"]))
        spans = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), _plain(rank, m["value"]).alias("entity")))
        return F.when(_maybe(kind, F.col("t")), spans)

    found = F.array(*[of(rank, kind) for rank, kind in enumerate(PATTERNS)])
    rows = rows.withColumn("found", F.flatten(F.filter(found, lambda x: x.isNotNull())))
    rows = cut(rows.filter(F.size("found") > 0).dropDuplicates(["row_key"]))
    base = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    return rows.select("row_key", "t", base.alias("base"), F.array_distinct(F.transform("found", lambda s: s["entity"])).alias("entities"))


def _masked() -> Column:
    """t with as many blanks for base matches."""
    blanks = lambda s, past: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], past), F.lit(0)))
    return _replaced(F.col("t"), F.col("base"), blanks)


def _family(entity: Column) -> Column:
    """What an entity is part of: an address's domain, an IP address's network, the first digits of a number."""
    kind, value = F.substring_index(entity, ":", 1), F.regexp_replace(entity, r"^[a-z]+:", "")
    part = F.when(kind == "email", F.substring_index(value, "@", -1)).when(kind == "ip", F.substring_index(value, ".", 3))
    part = part.when(kind == "card", F.substring(value, 1, 6)).otherwise(F.substring(value, F.lit(1), F.length(value) - 4))
    return F.concat_ws(":", kind, part)


def sizes(base: DataFrame, total: int, prior: float = PRIOR, generalise: float = GENERALISE) -> DataFrame:
    """entity, family, kind, how many documents have each (n_entity, n_family, n_kind), and reach."""
    one = F.count(F.lit(1))
    families = F.explode(F.array_distinct(F.transform("entities", _family))).alias("family")
    kinds = F.explode(F.array_distinct(F.transform("entities", lambda e: F.substring_index(e, ":", 1)))).alias("kind")
    of = base.select(F.explode("entities").alias("entity")).groupBy("entity").agg(one.alias("n_entity"))
    of = of.withColumns({"family": _family(F.col("entity")), "kind": F.substring_index("entity", ":", 1)})
    of = of.join(base.select(families).groupBy("family").agg(one.alias("n_family")), "family").join(F.broadcast(base.select(kinds).groupBy("kind").agg(one.alias("n_kind"))), "kind")
    # P(e | t) as in `disclosures` is at most (n_entity + prior * b * n_entity / n_family) / (n_term + prior), b being most for the least n_term in question
    e, f, k = F.col("n_entity"), F.col("n_family"), F.col("n_kind")
    inverse = F.pow(F.lit(float(total)) / e, F.lit(1.0 - generalise))
    least = F.greatest(e * inverse - prior, F.lit(1.0))
    b = F.least(F.lit(1.0), (f - 1 + prior * f / k) / (least - 1 + prior))
    return of.withColumn("reach", (e + prior * b * e / f) * inverse * 1.000001 - prior)


def occurrences(base: DataFrame, counts: DataFrame, total: int, reach: float) -> DataFrame:
    """row_key, term, n_term and places (start, end) of the words within reach of the texts with entities."""
    rows = base.select("row_key", _masked().alias("masked")).select("row_key", F.explode(_found(F.col("masked"), _WORD)).alias("w"))
    rows = rows.select("row_key", F.lower("w.value").alias("term"), F.struct("w.start", "w.end").alias("place"))
    frequent = counts.filter((F.col("n_term") > reach) & (F.col("n_term") * FREQUENT > total)).select("term")
    rows = rows.join(F.broadcast(frequent), "term", "left_anti").join(counts.filter(F.col("n_term") <= reach), "term")
    return rows.groupBy("row_key", "term", "n_term").agg(F.collect_list("place").alias("places"))


def disclosures(near: DataFrame, who: DataFrame, of: DataFrame, total: int, prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """entity, term, pmi, ic, removed: the pairs over the threshold.

    near: row_key, term, n_term of documents with entities; who: row_key, entity; of: the entities' sizes.
    """
    level = lambda name, n: F.struct(F.lit(n).alias("level"), F.col(name).alias("value"), F.col(f"reach_{name}").alias("reach"))
    for name in ("family", "kind"):  # what the counts of an entity's pairs need from documents without the entity
        top = of.groupBy(name).agg(F.max("reach").alias(f"reach_{name}"))
        of = of.join(F.broadcast(top) if name == "kind" else top, name)
    of = of.withColumnRenamed("reach", "reach_entity")
    levels = who.join(F.broadcast(of) if fits(of, MOST_ROWS) else of, "entity").select("row_key", F.explode(F.array(level("entity", 0), level("family", 1), level("kind", 2))).alias("l")).select("row_key", "l.*").distinct()
    levels = levels.groupBy("row_key").agg(F.collect_list(F.struct("level", "value", "reach")).alias("levels"))
    rows = near.join(levels, "row_key")
    rows = rows.select("term", "n_term", F.explode(F.filter("levels", lambda x: F.col("n_term") <= x["reach"])).alias("l")).select("term", "n_term", "l.level", "l.value")
    rows = cut(rows.groupBy("level", "value", "term", "n_term").agg(F.count(F.lit(1)).alias("n_both")))
    count = lambda n, name: rows.filter(F.col("level") == n).select(F.col("value").alias(name), "term", F.col("n_both").alias(f"both_{name}"))
    pairs = rows.filter("level = 0").select(F.col("value").alias("entity"), "term", "n_term", "n_both").join(of, "entity")
    pairs = pairs.join(count(1, "family"), ["family", "term"]).join(count(2, "kind"), ["kind", "term"])

    # each level is estimated from documents that the level below doesn't have: none counts twice
    n, t, both = F.lit(total), F.col("n_term"), F.col("n_both")
    of_kind = (F.col("both_kind") - F.col("both_family") + prior * F.col("n_kind") / n) / (t - F.col("both_family") + prior)
    of_family = (F.col("both_family") - both + prior * of_kind * F.col("n_family") / F.col("n_kind")) / (t - both + prior)
    p = (both + prior * of_family * F.col("n_entity") / F.col("n_family")) / (t + prior)
    smooth = F.log2(p * n / F.col("n_entity"))
    pmi = F.log2(both * n / (t * F.col("n_entity")))
    ic = F.log2(n / F.col("n_entity"))
    pairs = pairs.select("entity", "term", pmi.alias("pmi"), ic.alias("ic"), smooth.alias("smooth"))
    pairs = pairs.filter((F.col("ic") > 0) & (F.col("smooth") >= generalise * F.col("ic")))
    return pairs.withColumn("removed", F.col("smooth") >= remove * F.col("ic")).drop("smooth")


def term_counts(df: DataFrame, text_col: str) -> DataFrame:
    """term, n_term: in how many rows of df each word is."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(_WORD), F.lit(0)), F.lower))
    return df.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts with base matches (as `matches`), the pairs that disclose (as `disclosures`), and row_key and spans (start, end, removed; by start) of the terms."""
    base, total = matches(df, id_col, text_col), df.count()
    of = cut(sizes(base, total, prior, generalise))
    reach = of.agg(F.max("reach")).first()[0] or 0.0
    counts = cut(term_counts(df, text_col))
    near = cut(occurrences(base, counts, total, reach))
    discard(counts)
    who = base.select("row_key", F.explode("entities").alias("entity"))
    pairs = cut(disclosures(near.drop("places"), who, of, total, prior, generalise, remove))
    own = of.select("entity", "reach")
    own = who.join(F.broadcast(own) if fits(own, MOST_ROWS) else own, "entity")
    told = near.join(own, "row_key").filter("n_term <= reach").select("row_key", "entity", "term", "places").join(pairs.select("entity", "term", "removed"), ["entity", "term"])
    spans = F.flatten(F.transform(F.collect_list(F.struct("places", "removed")), lambda x: F.transform(x["places"], lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), x["removed"].alias("removed")))))
    told = told.groupBy("row_key").agg(F.array_sort(spans).alias("terms"))
    # a term of several entities is removed if it is for any: of equal places the last one
    last = F.filter("terms", lambda s, i: F.coalesce(F.get("terms", i + 1)["start"] != s["start"], F.lit(True)))
    return base, pairs, told.select("row_key", last.alias("terms"))


def _all_spans(base: DataFrame, spans: DataFrame) -> DataFrame:
    """row_key and spans (start, rank, end, removed), sorted, of each text with a base match."""
    none = F.array().cast("array<struct<start:int,rank:int,end:int,removed:boolean>>")
    of_base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.lit(False).alias("removed")))
    of_terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("rank"), s["end"].alias("end"), s["removed"].alias("removed")))
    both = F.array_sort(F.concat(of_base, F.coalesce(of_terms, none)))
    return base.select("row_key", "base").join(spans, "row_key", "left").select(F.col("row_key").alias("span_key"), both.alias("spans"))


def _named(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1), s["start"], s["end"])), ",")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """id, numbers of base matches, base_sha256 and spans of each row of df."""
    base, _, terms = find(df, id_col, text_col, **thresholds)
    number = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    of_row = _all_spans(base, terms).select("span_key", _named(F.filter("spans", lambda s: s["rank"] < 4)).alias("base"), _named(F.col("spans")).alias("named"), *map(number, range(4)))
    rows = df.select(F.col(id_col), F.when(_candidate(text_col), row_key(id_col, text_col)).alias("row_key"))
    rows = rows.join(of_row, F.col("row_key") == F.col("span_key"), "left")
    zero, none = F.lit(0).cast("long"), F.lit("")
    return rows.select(id_col, *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS[:4]], F.sha2(F.encode(F.coalesce("base", none), "UTF-8"), 256).alias("base_sha256"), F.coalesce("named", none).alias("spans"))


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """df with its texts sanitised: [EMAIL], [IP], [CARD], [PHONE] for base matches, [TERM] or nothing for terms."""
    base, _, terms = find(df, id_col, text_col, **thresholds)
    key, span_key, held = fresh(df, "key"), fresh(df, "span_key"), fresh(df, "held")
    of_row = _all_spans(base, terms).select(F.col("span_key").alias(span_key), F.col("spans").alias(held))
    joined = df.filter(_candidate(text_col)).withColumn(key, row_key(id_col, text_col)).join(of_row, F.col(key) == F.col(span_key), "left")
    label = lambda s, past: F.when(s["removed"] | (s["start"] < past), "").otherwise(F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)), F.lit("]")))
    whole = F.col(text_col).cast("string")
    text = F.when(F.col(held).isNull(), whole).otherwise(_replaced(whole, F.col(held), label))
    return joined.withColumn(text_col, text).select(*df.columns).unionByName(df.filter(~_candidate(text_col)))
