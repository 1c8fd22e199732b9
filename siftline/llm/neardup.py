"""MinHash near-duplicate detection by a signature-coordinate inverted join.

1. Each text's set of distinct word shingles becomes a digest and a signature of COORDS min-hashes. Texts with
   one set are one class, so copies cost one row, however many there are.
2. Classes are posted under their (coordinate, value) pairs. Two sets whose similarity is at the threshold agree
   on 34 of 40 coordinates on average, and on fewer than MATCHES once in about a million times.
3. Prefix: of a class's pairs only the rarest COORDS - MATCHES + 1 are kept, by one global order; two classes with
   MATCHES common pairs share one of those. Most are unique to their class and join nothing; a class with
   more unique pairs than COORDS - MATCHES is out at once, and so are the frequent pairs of passages that many
   texts share.
4. Merging skips what isn't in the prefix: within a posting list the rest of the collisions is counted from
   the signatures. A long list is dealt in blocks, and each pair of blocks meets in one task; of the pairs that
   reach MATCHES a task returns a spanning forest only, less what a block's own task returns. Their components
   are candidate families.
5. Links are confirmed on full sets within families, again in pairs of blocks and returned as a spanning
   forest; texts already linked in a block aren't compared again, nor those that agree on fewer than half of
   MATCHES coordinates (two sets at the threshold do with a chance below 1e-15). Components of confirmed links are the result.

Nothing grows with the square of a group: tasks return forests, and no pair list exists.

Defined results: a text without words, an empty or null one has an empty set and is linked with nothing; a
row without an id takes part, and stands for its component only if no row there has an id; repeated rows
have one component; ids that several texts have are allowed; an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm import bytes_np as b
from siftline.llm.common import cut, fits, fresh, map_arrow, pieces, row_key
from siftline.llm.graph import components

SHINGLE_WORDS = 5
#: Texts are linked if 100 * intersection >= PERCENT * union.
PERCENT = 85
COORDS = 40
MATCHES = 22
#: Classes of a posting list or a family that a task takes from each of its two blocks, and shingles of them.
BLOCK = 256
BLOCK_SHINGLES = 1 << 20

_SEEDS = b.mix(np.arange(1, COORDS + 1, dtype=b.U) * b.U(0xA24BAED4963EE407)) | b.U(1)


def chance_of_loss(coords: int = COORDS, matches: int = MATCHES, percent: int = PERCENT) -> float:
    """How likely two sets at the threshold have fewer than `matches` equal coordinates."""
    p = percent / 100
    return sum(math.comb(coords, k) * p**k * (1 - p) ** (coords - k) for k in range(matches))


def signatures(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sets x COORDS 32-bit min-hashes; sets mustn't be empty."""
    out = np.empty((len(off) - 1, COORDS), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(COORDS):
            out[:, k] = (b.mix(np.minimum.reduceat(sets * _SEEDS[k], off[:-1])) & b.U(0xFFFFFFFF)).astype(np.uint32)
    return out


def _digests(sets: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    with np.errstate(over="ignore"):
        sums = []
        for salt in (0x632BE59BD9B4E019, 0x9FB21C651E98DF25):
            total = np.concatenate(([b.U(0)], np.cumsum(b.mix(sets ^ b.U(salt)))))
            sums.append(b.mix((total[off[1:]] - total[off[:-1]]) ^ (np.diff(off).astype(b.U) * b.U(salt | 1))))
        return sums[0].view(np.int64), sums[1].view(np.int64)


def _links(n: int, block: np.ndarray, across: bool, partners, same=None, step: int = 64) -> list[tuple[int, int]]:
    """Pairs of rows that join components not joined before; across: of the two blocks, once each is joined within itself.

    partners(i, rows) are those of rows that may be linked with row i, and same(i, rows) those that are. Rows that
    already share a component aren't compared, so a group of copies costs and returns little more than its rows,
    and two blocks of such a group return one pair, as what joins their own rows is returned where a block meets itself.
    """
    label, pairs = np.arange(n), []
    for cross in (False, True) if across else (False,):
        for i in range(n - 1):
            at = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            at = at[(block[at] != block[i]) == cross]
            if len(at):
                at = partners(i, at)
            while len(at):
                now, at = (at, at[:0]) if same is None else (at[:step], at[step:])
                for j in (now if same is None else same(i, now)).tolist():
                    if label[j] != label[i]:
                        label[label == label[j]] = label[i]
                        if cross == across:
                            pairs.append((i, j))
                at = at[label[at] != label[i]]
    return pairs


def _grouped(batches, keys: list[str]):
    """Batches whose rows are sorted by `keys` as tables of one group each; a group is bounded by its blocks."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _rows(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _sigs(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, COORDS)


def _partners(i: int, at: np.ndarray, sig: np.ndarray, n: np.ndarray, matches: int, percent: int) -> np.ndarray:
    """Those of the rows `at` that may be linked with row i by their sizes and signatures."""
    at = at[100 * np.minimum(n[i], n[at]) >= percent * np.maximum(n[i], n[at])]
    return at[(sig[at] == sig[i]).sum(1) >= matches] if len(at) else at


_EDGE = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.LongType(), False)])


def _edges_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, z = (np.array(x, np.int64) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 2
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], names=["a", "b"])


def _flush(source, limit: int = 20_000):
    """Edges in batches."""
    edges: list[tuple[int, int]] = []
    for more in source:
        edges += more
        if len(edges) >= limit:
            yield _edges_batch(edges)
            edges = []
    if edges:
        yield _edges_batch(edges)


def _block_pairs(df: DataFrame, blocks: str, node: str = "node") -> DataFrame:
    """Each row once for each pair of blocks that its own block is in: columns bi <= bj, and own_block."""
    own = F.pmod(F.xxhash64(F.col(node)), F.col(blocks)).cast("int")
    df = df.withColumn("own_block", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
    return df.withColumns({"bi": F.least("own_block", "other"), "bj": F.greatest("own_block", "other")}).drop("other", blocks)


def _meet(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, "node")


def sketch(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, row_key, n_shingles, digests h1 and h2, and sig of each row; the last three are null for an empty set."""
    schema = T.StructType([df.schema[id_col], T.StructField("row_key", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("sig", T.BinaryType())])

    def run(batches):
        for batch in pieces(batches, text_col):
            sets, off = b.shingle_sets(*b.flat(batch.column(text_col)), words)
            size = np.diff(off)
            some = np.flatnonzero(size)
            own = np.concatenate((off[some], off[-1:]))
            h1, h2, sig = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), [None] * len(size)
            if len(some):
                h1[some], h2[some] = _digests(sets, own)
                for i, s in zip(some, signatures(sets, own)):
                    sig[i] = s.tobytes()
            none = size == 0
            cols = [batch.column(id_col), batch.column("row_key"), pa.array(size), pa.array(h1, mask=none), pa.array(h2, mask=none), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return map_arrow(df.select(id_col, row_key(id_col, text_col).alias("row_key"), text_col), run, schema)


def _families(classes: DataFrame, matches: int, percent: int) -> DataFrame:
    """node, root: components of the classes that agree on `matches` coordinates."""
    element = T.StructType([T.StructField("node", T.LongType(), False), T.StructField("key", T.LongType(), False)])

    def elements(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = pa.Table.from_batches([batch.slice(at, 2000)])
                keys = _sigs(part).astype(np.int64) | (np.arange(COORDS, dtype=np.int64) << 32)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("node").to_numpy(), COORDS)), pa.array(keys.ravel())], names=element.names)

    posts = map_arrow(classes.select("node", "sig"), elements, element)
    frequent = posts.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    of_class = posts.join(frequent, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("own"))
    # a class's unique pairs come first in its prefix; the rest of the prefix are the rarest of the others
    prefix = of_class.filter(F.size("own") >= matches).select("node", F.explode(F.slice("own", F.lit(1), F.size("own") - (matches - 1))["key"]).alias("key"))
    prefix = cut(prefix)
    lists = prefix.groupBy("key").agg(F.count(F.lit(1)).alias("posted")).filter("posted > 1")
    lists = lists.select("key", F.ceil(F.col("posted") / BLOCK).alias("blocks"))
    rows = prefix.join(lists, "key").join(classes.select("node", "n_shingles", "sig"), "node")
    rows = _meet(_block_pairs(rows, "blocks"), ["key", "bi", "bj"])

    def forests(batches):
        for t in _grouped(batches, ["key", "bi", "bj"]):
            if t.num_rows < 2:
                continue
            node, n, block, sig = *_rows(t, ["node", "n_shingles", "own_block"]), _sigs(t)
            across = t.column("bi")[0] != t.column("bj")[0]
            yield [(node[i], node[j]) for i, j in _links(t.num_rows, block, across, lambda i, at: _partners(i, at, sig, n, matches, percent))]

    return components(map_arrow(rows, lambda batches: _flush(forests(batches)), _EDGE))


def _confirmed(df: DataFrame, classes: DataFrame, families: DataFrame, id_col: str, text_col: str, words: int, matches: int, percent: int) -> DataFrame:
    """Edges between classes whose full sets are as similar as asked for: a spanning forest of each pair of blocks."""
    members = cut(families.join(classes.select("node", "n_shingles", "sig", F.col("rep.row_key").alias("row_key")), "node"))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    sizes = sizes.select("root", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).alias("blocks"))
    texts = df.select(row_key(id_col, text_col).alias("row_key"), text_col).join(members.select("row_key", "node", "root", "n_shingles", "sig"), "row_key")
    texts = texts.dropDuplicates(["row_key"])  # repeated rows
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("root", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("shingles", T.BinaryType())])

    def full(batches):
        for batch in pieces(batches, text_col):
            sets, off = b.shingle_sets(*b.flat(batch.column(text_col)), words)
            own = pa.array([sets[a:z].tobytes() for a, z in zip(off, off[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), own], names=schema.names)

    rows = _block_pairs(map_arrow(texts, full, schema).join(sizes, "root"), "blocks")
    rows = _meet(rows, ["root", "bi", "bj"])

    def check(batches):
        for t in _grouped(batches, ["root", "bi", "bj"]):
            if t.num_rows < 2:
                continue
            node, n, block, sig = *_rows(t, ["node", "n_shingles", "own_block"]), _sigs(t)
            across = t.column("bi")[0] != t.column("bj")[0]
            sets = [np.frombuffer(s, b.U) for s in t.column("shingles").to_pylist()]

            def same(i: int, at: np.ndarray) -> np.ndarray:
                other = np.concatenate([sets[j] for j in at])
                place = np.minimum(np.searchsorted(sets[i], other), len(sets[i]) - 1)
                both = np.add.reduceat((sets[i][place] == other).astype(np.int64), np.cumsum([0] + [len(sets[j]) for j in at[:-1]]))
                return at[100 * both >= percent * (n[i] + n[at] - both)]

            yield [(node[i], node[j]) for i, j in _links(t.num_rows, block, across, lambda i, at: _partners(i, at, sig, n, matches // 2, percent), same)]

    return map_arrow(rows, lambda batches: _flush(check(batches)), _EDGE)


def _numbered(classes: DataFrame) -> DataFrame:
    """classes with node: h1, or a mix of both digests where several classes have one h1."""
    alike = classes.groupBy(F.col("h1").alias("shared")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("shared")
    if not alike.limit(1).count():
        return classes.withColumn("node", F.col("h1"))
    alike = F.broadcast(alike) if fits(alike, 100_000) else alike
    node = F.when(F.col("shared").isNull(), F.col("h1")).otherwise(F.xxhash64("h1", "h2"))
    return cut(classes.join(alike, F.col("h1") == F.col("shared"), "left").withColumn("node", node).drop("shared"))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT, matches: int = MATCHES) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id, first_key, kept of each row of df.

    component_id is the smallest id reachable over links and first_key the row key of the row that has it.
    """
    rows = cut(sketch(df, id_col, text_col, words))
    rep = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("row_key"))
    classes = rows.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min(rep).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = _numbered(cut(classes))
    families = cut(_families(classes, matches, percent))
    linked = cut(components(_confirmed(df, classes, families, id_col, text_col, words, matches, percent)))
    of_root = linked.join(classes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("best"))
    best = linked.join(of_root, "root").select("node", "best")
    stand = classes.select("node", "h1", "h2", "rep").join(best, "node", "left").select("h1", "h2", F.coalesce("best", "rep").alias("rep"))
    filled = rows.filter("n_shingles > 0").select(id_col, "row_key", "n_shingles", "h1", "h2").join(stand, ["h1", "h2"], "left")
    kept = F.coalesce(F.col(id_col) == F.col("rep.id"), F.col("row_key") == F.col("rep.row_key"))
    filled = filled.select(id_col, "row_key", "n_shingles", F.col("rep.id").alias("component_id"), F.col("rep.row_key").alias("first_key"), kept.alias("kept"))
    empty = rows.filter("n_shingles = 0").select(id_col, "row_key", "n_shingles", F.col(id_col).alias("component_id"), F.col("row_key").alias("first_key"), F.lit(True).alias("kept"))
    return filled.unionByName(empty)


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with one row of each component: that of the smallest id. Rows without words all stay."""
    verdict = judge(df, id_col, text_col, **options)
    key = fresh(df, "keep_key")
    first = verdict.filter("n_shingles > 0 AND row_key = first_key").select(F.col("row_key").alias(key)).distinct()
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = df.filter(worded).withColumn(key, row_key(id_col, text_col))
    return keyed.join(first, key, "left_semi").dropDuplicates([key]).drop(key).unionByName(df.filter(~worded))
