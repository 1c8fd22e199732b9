"""Redaction in two phases (M5): collect what is sensitive in a scope, then replace it in every row of the scope.

The first phase is expressions made from the schema and an aggregation by scope (the case, unless another
column is named). For the second, the values of a scope travel as rows before the scope's own rows, once for
each SALT_ROWS rows of it, so that a huge case is dealt over many tasks and no row carries the values. The rows
pass an Arrow function column by column: the types say which leaves are texts, parties or contact lists, and
replacement is done on whole leaf arrays. Known values are found by a look-up at the places where one can begin.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACEHOLDER = "[REDACTED]"
# Kinds of identifiers, fields that are never redacted, lists of contacts, the patterns, least lengths.
SENSITIVE_TYPES = ["account", "card", "phone", "email", "upi_id"]
SKIP_FIELDS = ["evidence_id", "content_hash", "schema_version", "transaction_id", "reference_numbers", "field_sources", "timestamp", "generated_at", "issue_id", "linked_evidence", "evidence_ids", "case_id", "time_precision"]
CONTACT_LISTS = {"phone_numbers": "phone", "emails": "email", "upi_ids": "upi_id"}
EMAIL = r"(?i)(?<![\w.+-])[\w.+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}\b"
UPI = r"(?i)(?<![\w.-])[\w.-]{1,256}@[a-z]{2,64}(?![\w-]|\.\w)"
PHONE = r"(?<![\d\w+])(?:\+?91[\s-]?|0)?[6-9]\d{4}[\s-]?\d{5}(?!\d)"
CARD = r"(?<![\d\w])\d(?:[ -]?\d){12,18}(?![\d\w])"
MASKED_ACCOUNT = r"(?<![\w*])[xX*]{2,}\d{2,6}(?!\w)"
NAMED_ACCOUNT = r"(?i)(\b(?:a/?c|acct|account)(?:\s*(?:no|number|num))?\.?\s*[:#-]?\s*(?:ending(?:\s+(?:with|in))?\s*)?)([xX*]*\d(?:[\d\s-]{0,20}\d)?)"
_NAME_ADDRESS = r"^\s*\"?[^\"<]*?\"?\s*<([^>]+)>\s*$"
MIN_LITERAL, MIN_REFERENCE, MIN_ACCOUNT = 4, 6, 3
#: Rows of a scope that share one copy of its values.
SALT_ROWS = 50_000


def check_types(types) -> list[str]:
    unknown = sorted(set(types) - set(SENSITIVE_TYPES))
    if unknown:
        raise ValueError(f"unknown redaction type(s): {', '.join(unknown)}")
    return [t for t in SENSITIVE_TYPES if t in types]


# ------------------------------------------------------------------ collecting

_KNOWN = "array<struct<value:string,kind:string>>"


def _collectors(col: Column, kind: T.DataType, types: list[str], name: str = "") -> tuple[list[Column], list[Column]]:
    """Expressions for the sensitive values (arrays of value and kind) and for the references in a column."""
    known: list[Column] = []
    refs: list[Column] = []
    if isinstance(kind, T.ArrayType) and name in CONTACT_LISTS:
        if CONTACT_LISTS[name] in types:
            known.append(F.transform(col, lambda v: F.struct(v.alias("value"), F.lit(CONTACT_LISTS[name]).alias("kind"))))
    elif name in ("transaction_id", "reference_numbers"):
        refs.append(col if isinstance(kind, T.ArrayType) else F.array(col))
    elif isinstance(kind, T.StructType):
        if {"identifier", "identifier_type"} <= set(kind.names):
            mine = F.coalesce(col["identifier_type"].isin(types) & (col["identifier"] != ""), F.lit(False))
            own = [F.when(mine, F.struct(col["identifier"].alias("value"), col["identifier_type"].alias("kind")))]
            if "raw" in kind.names:
                inner = F.regexp_extract(col["raw"], _NAME_ADDRESS, 1)
                written = F.trim(F.when(inner != "", inner).otherwise(col["raw"]))
                other = ~col["raw"].eqNullSafe(col["name"]) & col["raw"].isNotNull()
                own.append(F.when(mine & other, F.struct(written.alias("value"), col["identifier_type"].alias("kind"))))
            known.append(F.array(*own).cast(_KNOWN))
        for f in kind.fields:
            k, r = _collectors(col[f.name], f.dataType, types, f.name)
            known, refs = known + k, refs + r
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):

        def inner(x, which):
            found = _collectors(x, kind.elementType, types)[which]
            nothing = F.array().cast(_KNOWN if which == 0 else "array<string>")
            return F.concat(*[F.coalesce(f, nothing) for f in found]) if found else nothing

        k, r = _collectors(F.lit(None).cast(kind.elementType), kind.elementType, types)
        if k:
            known.append(F.flatten(F.transform(col, lambda x: inner(x, 0))))
        if r:
            refs.append(F.flatten(F.transform(col, lambda x: inner(x, 1))))
    return known, refs


def collect(df: DataFrame, scope: str, types: list[str], order: str | None = None) -> DataFrame:
    """scope, value and its kind (of its first appearance), and ref (the digits of a protected reference): one of the two in each row."""
    known, refs = [], []
    for f in df.schema.fields:
        k, r = _collectors(F.col(f.name), f.dataType, types, f.name)
        known, refs = known + k, refs + r
    none = F.array().cast(_KNOWN)
    rows = df.select(
        F.col(scope).cast("string").alias("scope"), (F.col(order) if order else F.lit(0)).cast("long").alias("ord"),
        F.concat(none, *[F.coalesce(k.cast(_KNOWN), none) for k in known]).alias("known"), F.concat(F.array().cast("array<string>"), *[F.coalesce(r.cast("array<string>"), F.array().cast("array<string>")) for r in refs]).alias("refs"),
    )
    values = rows.select("scope", "ord", F.posexplode("known").alias("i", "k")).filter(F.col("k.value") != "")
    values = values.groupBy("scope", F.lower("k.value").alias("value")).agg(F.min(F.struct("ord", "i", F.col("k.kind").alias("kind")))["kind"].alias("kind"))
    digits = rows.select("scope", F.explode("refs").alias("r")).select("scope", F.regexp_replace("r", "[^0-9]", "").alias("ref")).filter(F.length("ref") >= MIN_REFERENCE).distinct()
    empty = F.lit(None).cast("string")
    return values.withColumn("ref", empty).unionByName(digits.select("scope", empty.alias("value"), empty.alias("kind"), "ref"))


# -------------------------------------------------------------------- replacing

_EDGE = re.compile(r"(?<![\w@.+-])(?=\S)")
_AFTER = re.compile(r"[\w@-]")


def _lowered(text: str) -> str:
    """Lower case, character by character, so that positions stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Values:
    """What is known in one scope: sensitive values with their kinds, and references that stay."""

    def __init__(self):
        self.by_start: dict[str, list[tuple[str, str]]] = defaultdict(list)
        self.references: list[str] = []
        self.sorted = True

    def add(self, value: str | None, kind: str | None, ref: str | None) -> None:
        if ref is not None:
            self.references.append(ref)
        elif len(value) >= MIN_LITERAL:
            self.by_start[_lowered(value)[:MIN_LITERAL]].append((_lowered(value), kind))
            self.sorted = False

    def protects(self, digits: str) -> bool:
        return any(digits in ref for ref in self.references)

    def spans(self, text: str):
        """start, end and kind of known values in text; the longest at each place, none inside another."""
        if not self.by_start:
            return
        if not self.sorted:
            for found in self.by_start.values():
                found.sort(key=lambda v: -len(v[0]))
            self.sorted = True
        low, end = _lowered(text), 0
        for m in _EDGE.finditer(text):
            at = m.start()
            if at < end:
                continue
            for value, kind in self.by_start.get(low[at : at + MIN_LITERAL], ()):
                if low.startswith(value, at) and not _AFTER.match(text, at + len(value)):
                    end = at + len(value)
                    yield at, end, kind
                    break


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def _luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for i, d in enumerate(reversed(digits))) % 10 == 0


#: In the order in which they are applied: kind, pattern, the group that is replaced, and the condition on its digits.
_RULES = [
    ("email", re.compile(EMAIL), 0, None),
    ("upi_id", re.compile(UPI), 0, None),
    ("card", re.compile(CARD), 0, lambda d, values: 13 <= len(d) <= 19 and not values.protects(d) and _luhn(d)),
    ("account", re.compile(NAMED_ACCOUNT), 2, lambda d, values: len(d) >= MIN_ACCOUNT and not values.protects(d)),
    ("account", re.compile(MASKED_ACCOUNT), 0, None),
    ("phone", re.compile(PHONE), 0, lambda d, values: not values.protects(d)),
]
_NOTHING = Values()


class Redactor:
    """Replaces in arrays of Arrow; counts what it replaced by row and kind."""

    def __init__(self, types, placeholder: str):
        self.types, self.placeholder = set(types), placeholder
        self.rules = [r for r in _RULES if r[0] in self.types]
        self.counts: Counter = Counter()
        self.scopes: list[Values] = []

    def text(self, text: str, row: int, values: Values) -> str:
        spans = list(values.spans(text))
        if spans:
            text = self._cut(text, spans, row)
        for kind, pattern, group, holds in self.rules:
            spans = [(*m.span(group), kind) for m in pattern.finditer(text) if holds is None or holds(_digits(m[group]), values)]
            if spans:
                text = self._cut(text, spans, row)
        return text

    def _cut(self, text: str, spans: list[tuple[int, int, str]], row: int) -> str:
        edges = [0, *(x for a, z, _ in spans for x in (a, z)), len(text)]
        self.counts.update((row, kind) for *_, kind in spans)
        return self.placeholder.join(text[a:z] for a, z in zip(edges[::2], edges[1::2]))

    def texts(self, arr: pa.Array, rows: np.ndarray) -> pa.Array:
        return pa.array([t and self.text(t, r, self.scopes[r]) for t, r in zip(arr.to_pylist(), rows.tolist())], arr.type)

    def hide(self, arr: pa.Array, rows: np.ndarray, kinds: list[str | None]) -> pa.Array:
        """Values that are sensitive whatever they look like, where a kind is given."""
        out = arr.to_pylist()
        for i, (v, kind) in enumerate(zip(out, kinds)):
            if v and kind:
                self.counts[int(rows[i]), kind] += 1
                out[i] = self.placeholder
        return pa.array(out, arr.type)

    def array(self, arr: pa.Array, rows: np.ndarray, name: str = "") -> pa.Array:
        """arr redacted, by its type; rows: of each value the row that it belongs to."""
        kind = arr.type
        if name in SKIP_FIELDS:
            return arr
        if pa.types.is_string(kind) or pa.types.is_large_string(kind):
            return self.texts(arr, rows)
        if pa.types.is_struct(kind):
            return self.struct(arr, rows)
        if not (pa.types.is_list(kind) or pa.types.is_map(kind)):
            return arr
        lengths = np.array([0 if v is None else v for v in _lengths(arr)], np.int64)
        offsets, inner = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32), np.repeat(rows, lengths)
        null = arr.is_null()
        if pa.types.is_map(kind):
            entries = _inside(arr)
            keys, items = entries.field(0), entries.field(1)
            kept = pa.array([k in SKIP_FIELDS for k in keys.to_pylist()], pa.bool_())
            items = pa.compute.if_else(kept, items, self.array(items, inner)) if pa.types.is_string(items.type) else self.array(items, inner)
            return pa.MapArray.from_arrays(pa.array(offsets), keys, items, kind, mask=null if null.true_count else None)
        values = arr.flatten()
        if name in CONTACT_LISTS:
            values = self.hide(values, inner, [CONTACT_LISTS[name] if CONTACT_LISTS[name] in self.types else None] * len(values))
        else:
            values = self.array(values, inner)
        return pa.ListArray.from_arrays(pa.array(offsets), values, kind, mask=null if null.true_count else None)

    def struct(self, arr: pa.Array, rows: np.ndarray) -> pa.Array:
        names, columns = [f.name for f in arr.type], arr.flatten()
        cell = dict(zip(names, columns))
        kinds: list[str | None] = [None] * len(arr)
        if {"identifier", "identifier_type"} <= cell.keys():
            kinds = [k if v and k in self.types else None for v, k in zip(cell["identifier"].to_pylist(), cell["identifier_type"].to_pylist())]
        new = {n: c for n, c in cell.items()}
        for n, c in cell.items():
            new[n] = self.hide(c, rows, kinds) if n == "identifier" and any(kinds) else self._raw(cell, rows, kinds) if n == "raw" and any(kinds) else self.array(c, rows, n)
        if any(kinds):  # an identifier of no sensitive kind is a text like any other
            plain = [i for i, k in enumerate(kinds) if not k]
            new["identifier"] = _merged(new["identifier"], self.array(cell["identifier"].take(pa.array(plain, pa.int64())), rows[np.array(plain, np.int64)]), plain)
        return pa.StructArray.from_arrays([new[n] for n in names], fields=list(arr.type), mask=arr.is_null())

    def _raw(self, cell: dict[str, pa.Array], rows: np.ndarray, kinds: list[str | None]) -> pa.Array:
        """How a party was written: hidden where it is an identifier that no pattern knows."""
        old, name = cell["raw"].to_pylist(), cell["name"].to_pylist() if "name" in cell else [None] * len(rows)
        new = self.texts(cell["raw"], rows).to_pylist()
        unknown = [k if k and a == z and a != n else None for k, a, z, n in zip(kinds, old, new, name)]
        return self.hide(pa.array(new, cell["raw"].type), rows, unknown)


def _lengths(arr: pa.Array) -> list[int | None]:
    if pa.types.is_map(arr.type):
        off = arr.offsets.to_pylist()
        return [z - a for a, z in zip(off, off[1:])]
    return arr.value_lengths().to_pylist()


def _inside(arr: pa.MapArray) -> pa.StructArray:
    off = arr.offsets.to_pylist()
    keys, items = arr.keys, arr.items
    return pa.StructArray.from_arrays([keys.slice(off[0], off[-1] - off[0]), items.slice(off[0], off[-1] - off[0])], names=["key", "value"])


def _merged(arr: pa.Array, part: pa.Array, at: list[int]) -> pa.Array:
    out = arr.to_pylist()
    for i, v in zip(at, part.to_pylist()):
        out[i] = v
    return pa.array(out, arr.type)


def redact_text(text: Column, types: list[str] | None = None, placeholder: str = PLACEHOLDER) -> Column:
    """A text with what the patterns find replaced; no known values, no protected references. E-mail and UPI patterns alone need no Python."""
    kinds = check_types(SENSITIVE_TYPES if types is None else types)
    if set(kinds) <= {"email", "upi_id"}:
        for kind, pattern in (("email", EMAIL), ("upi_id", UPI)):
            if kind in kinds:
                text = F.regexp_replace(text, pattern.replace("(?i)", "(?iU)", 1), placeholder.replace("\\", "\\\\").replace("$", "\\$"))
        return text

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        tool = Redactor(kinds, placeholder)
        return texts.map(lambda t: None if t is None else tool.text(t, 0, _NOTHING))

    return run(text)


def redact(df: DataFrame, scope: str = "case_id", types: list[str] | None = None, placeholder: str = PLACEHOLDER, order: str | None = "rec_ord", known_from: DataFrame | None = None) -> DataFrame:
    """df redacted, with `redactions` (number by kind) of each row. What is sensitive is collected in known_from, or df itself."""
    kinds = check_types(SENSITIVE_TYPES if types is None else types)
    source = df if known_from is None else known_from
    found = collect(source, scope, kinds, order if order in source.columns else None)
    # how many copies of its values a scope needs, and which of them a row goes with
    sizes = df.groupBy(F.col(scope).cast("string").alias("scope_of")).agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    key = F.col(names[df.columns.index(scope)]).cast("string")
    hashed = [n for n, f in zip(names, df.schema.fields) if "map<" not in f.dataType.simpleString()]
    rows = rows.join(sizes, key.eqNullSafe(F.col("scope_of"))).withColumn("salt", F.pmod(F.xxhash64(*hashed), F.col("salts")).cast("int"))
    rows = rows.select(key.alias("scope"), "salt", F.lit(1).alias("part"), *[F.lit(None).cast("string").alias(c) for c in ("value", "kind", "ref")], *names)
    copies = found.join(sizes, found["scope"].eqNullSafe(sizes["scope_of"])).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    types_of = {n: f.dataType for n, f in zip(names, df.schema.fields)}
    copies = copies.select("scope", "salt", F.lit(0).alias("part"), "value", "kind", "ref", *[F.lit(None).cast(t).alias(n) for n, t in types_of.items()])
    both = copies.unionByName(rows).repartition("scope", "salt").sortWithinPartitions("scope", "salt", "part")
    out = T.StructType([*(T.StructField(n, t) for n, t in types_of.items()), T.StructField("redactions", T.MapType(T.StringType(), T.LongType()))])
    fields = df.columns

    def run(batches):
        now, values = None, _NOTHING
        for batch in batches:
            tool, data = Redactor(kinds, placeholder), []
            keys = zip(batch.column("scope").to_pylist(), batch.column("salt").to_pylist(), batch.column("part").to_pylist())
            entry = [batch.column(c).to_pylist() for c in ("value", "kind", "ref")]
            for i, (case, salt, part) in enumerate(keys):
                if now != (case, salt):
                    now, values = (case, salt), Values()
                if part:
                    data.append(i)
                    tool.scopes.append(values)
                else:
                    values.add(*(e[i] for e in entry))
            if not data:
                continue
            mine = batch.take(pa.array(data))
            columns = [tool.array(mine.column(n), np.arange(len(data)), f) for n, f in zip(names, fields)]
            counts: list[dict[str, int]] = [{} for _ in data]
            for (row, kind), n in tool.counts.items():
                counts[row][kind] = n
            columns.append(pa.array([list(c.items()) for c in counts], pa.map_(pa.string(), pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    done = both.mapInArrow(run, out)
    return done.select(*[F.col(n).alias(f) for n, f in zip(names, fields)], "redactions")


def redaction_counts(redacted: DataFrame, scope: str = "case_id") -> DataFrame:
    """scope, kind, n, over all rows of a redacted table."""
    return redacted.select(scope, F.explode("redactions").alias("kind", "n")).groupBy(scope, "kind").agg(F.sum("n").alias("n"))
