"""N-gram Jaccard self-join by signature trees: documents whose sets of word shingles link at a Jaccard similarity.

1. The corpus becomes blocks (corpus.py); a document's set is its distinct n-word shingles, as 64-bit hashes. Equal
   sets are one class, named by a 128-bit fingerprint and the set's size; copies are never compared.
2. The number of blocks' classes that hold a shingle, its frequency, is exchanged by hash. A document can only link if
   at least ceil(J * size) of its shingles occur elsewhere; all others are done here. Frequencies may be too high (32
   bits of a key stand for it within a bucket), which costs work but never a link.
3. In the order of frequency and hash, two linking sets share a shingle among each one's first size - ceil(J * size) + 1.
   Classes that share such a shingle, and whose sizes allow a link, are connected; connected groups are independent.
   Sizes are cut into slots in which a link spans two at most, so a shingle's classes need no order, and a hot one is
   reduced in every task before it is shuffled.
4. In a group, a signature tree over the classes (by size): each node has the OR of token bitmaps below it, the range
   of sizes and the least number of set bits. Two nodes are traversed together unless their sizes or the largest
   possible overlap rule out a link, or all below them is connected already; at the leaves, sets are intersected
   exactly. A group of more than `group_keys` shingles is dealt into parts by the least shingle of each class (near
   copies mostly agree in it; a cluster that is itself too large is dealt by its classes' names). Each part is a
   task; then one member of each part's components meets those of the other parts. What is left are shingles shared by
   classes that aren't one component by then: for each pair of parts that has some, a task gets the classes that share
   them, and no others. So no task holds more than about two parts, no pair of parts without a shared shingle is
   looked at, and no link is lost.
5. Links' components come from alternating stars; each row gets its class's component. Only a spanning set of links is
   made, never all pairs of a group.

Defined results: A-Z are lowered; words are split at blanks (0x20, 0x09-0x0D); fewer than n words, but some, are one
shingle, the whole sequence; a null, empty or blank text has the size 0, links with nothing and is its own component,
as its id; a component's id is the smallest id that isn't null; rows with equal ids are rows of their own; an empty
table gives none; input columns named as a result column come back as <name>_input.
Node names have 64 bits: among 5 * 10^9 candidate classes one expected collision would join two groups.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import hold, inner, outer_names, release, table
from .corpus import answered, blocks, components, exchange, hashes, words_of
from .route import split
from .words import SPACED, grams, mix

#: Similarity as a fraction, words of a shingle, and shingles of a part of a group.
NUM, DEN, WORDS, GROUP_KEYS = 3, 4, 5, 1 << 15
BITS, LEAF = 2048, 2
#: Share of rows from which on a shingle's classes are spread over tasks, and over how many.
SHARE, SALTS = 1 / 1024, 64


def least_overlap(n, num: int = NUM, den: int = DEN):
    """Shingles of a set of n that a linking set must share."""
    return (n * num + den - 1) // den


def shingle_sets(h: np.ndarray, first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, document by document and ascending in each, and the first of each document."""
    size = np.diff(first)
    g = grams(h, words)
    doc = np.repeat(np.arange(len(size)), size)[: len(g)]
    inside = np.arange(len(g)) + words <= first[doc + 1] if len(g) else np.zeros(0, bool)
    keys, owner = g[inside], doc[inside]
    short = np.flatnonzero((size > 0) & (size < words))
    if len(short):
        whole = np.array([int(grams(h[first[d] : first[d + 1]], int(size[d]))[0]) for d in short], np.uint64)
        keys, owner = np.concatenate([keys, whole]), np.concatenate([owner, short])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    if len(keys):
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
        keys, owner = keys[new], owner[new]
    return keys, np.searchsorted(owner, np.arange(len(size) + 1))


def fingerprints(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each document's set."""
    out = []
    for salt in (0x1234567, 0x89ABCDE):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _one_each(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's documents, the first of each class; their keys, the first key of each, and the fingerprint."""
    n, (a, b) = np.diff(first), fingerprints(keys, first)
    _, at = np.unique(np.stack([a, b, n]), axis=1, return_index=True)
    at = at[n[at] > 0]
    at.sort()
    lengths = n[at]
    ends = np.cumsum(lengths)
    flat = keys[np.repeat(first[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
    return flat, np.concatenate([[0], ends]).astype(np.int64), a[at]


class Tree:
    """A signature tree over sets in the order given; nodes are halves of ranges, leaves have LEAF sets at most."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.n, self.held = np.array(sizes), np.array([len(s) for s in sets])
        self.maps = np.zeros((len(sets), BITS // 64), np.uint64)
        for i, s in enumerate(sets):
            bit = (s >> np.uint64(64 - int(np.log2(BITS)))).astype(np.int64)
            np.bitwise_or.at(self.maps[i], bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
        self.ones = np.bitwise_count(self.maps).sum(1).astype(np.int64)
        self.nodes: dict[tuple[int, int], tuple] = {}

    def node(self, a: int, b: int) -> tuple:
        """OR of bitmaps, least and most size, most shared shingles, least set bits."""
        if (a, b) not in self.nodes:
            self.nodes[a, b] = (np.bitwise_or.reduce(self.maps[a:b], 0), int(self.n[a:b].min()), int(self.n[a:b].max()), int(self.held[a:b].max()), int(self.ones[a:b].min()))
        return self.nodes[a, b]


def may_link(x: tuple, y: tuple, num: int, den: int) -> bool:
    """Whether the sizes and the largest possible overlap below two nodes allow a link.

    A bit that a set has and the other side lacks is a shingle that can't be shared; so of a set with s bits on one
    side at least s minus the sides' common bits are lost.
    """
    (ma, la, ha, sa, oa), (mb, lb, hb, sb, ob) = x, y
    if ha * den < lb * num or hb * den < la * num:
        return False
    common = int(np.bitwise_count(ma & mb).sum())
    most = min(sa - max(0, oa - common), sb - max(0, ob - common))
    return most * (num + den) >= num * (la + lb)


def tree_links(sets: list[np.ndarray], sizes: list[int], split: int | None = None, num: int = NUM, den: int = DEN, label: np.ndarray | None = None, seen: Counter | None = None) -> Iterator[tuple[int, int]]:
    """Links that connect all sets that links connect: of all pairs, or of pairs across `split` alone.

    A set is given by its ascending shingles, or by those that others have too, and by its whole size. Sets of equal
    labels are connected already. `seen` counts pairs of nodes that were met, pruned, and pairs of sets intersected.
    """
    seen = Counter() if seen is None else seen
    tree, label = Tree(sets, sizes), np.arange(len(sets)) if label is None else label.copy()
    root = (0, len(sets))
    stack = [(root, root)] if split is None else [((0, split), (split, len(sets)))]
    while stack:
        (a, b), (c, d) = stack.pop()
        same = (a, b) == (c, d)
        if a == b or c == d or (label[a] == label[c] and (label[a:b] == label[a]).all() and (label[c:d] == label[a]).all()):
            continue
        seen["met"] += 1
        if not same and not may_link(tree.node(a, b), tree.node(c, d), num, den):
            seen["pruned"] += 1
            continue
        if b - a <= LEAF and d - c <= LEAF:
            for i in range(a, b):
                for j in range(i + 1 if same else c, d):
                    if label[i] == label[j] or not may_link(tree.node(i, i + 1), tree.node(j, j + 1), num, den):
                        continue
                    seen["intersected"] += 1
                    x, y = (sets[i], sets[j]) if len(sets[i]) < len(sets[j]) else (sets[j], sets[i])
                    at = np.searchsorted(y, x)
                    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                    if den * both >= num * (sizes[i] + sizes[j] - both):
                        yield i, j
                        label[label == label[j]] = label[i]
            continue
        m, k = (a + b) // 2, (c + d) // 2
        if same:  # inner pairs come off the stack before those across
            stack += [((a, m), (m, b)), ((m, b), (m, b)), ((a, m), (a, m))]
        elif b - a >= d - c:
            stack += [((a, m), (c, d)), ((m, b), (c, d))]
        else:
            stack += [((a, b), (c, k)), ((a, b), (k, d))]


def _links(num: int, den: int):
    """Streams groups (part pairs) out of sorted rows (grp, i, j, part, n, node, label, keys)."""

    def solve(key: tuple, held: dict[int, tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int]]:
        rows = sorted((part, n, node, label, keys) for node, (part, n, label, keys) in held.items())
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        split = None if key[1] == key[2] else sum(r[0] == key[1] for r in rows)
        for i, j in tree_links(sets, [r[1] for r in rows], split, num, den, np.array([r[3] for r in rows])):
            yield rows[i][2], rows[j][2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in (whole.slice(k, 1000) for whole in batches for k in range(0, whole.num_rows, 1000)):
            out: list[tuple[int, int]] = []
            for grp, i, j, part, n, node, label, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (grp, i, j) != now:
                    if held:
                        out += solve(now, held)
                    now, held = (grp, i, j), {}
                held[node] = (part, n, label, keys)
            yield pa.RecordBatch.from_pydict({"src": pa.array([x for x, _ in out], pa.int64()), "dst": pa.array([y for _, y in out], pa.int64())})
        if held:
            out = list(solve(now, held))
            yield pa.RecordBatch.from_pydict({"src": pa.array([x for x, _ in out], pa.int64()), "dst": pa.array([y for _, y in out], pa.int64())})

    return run


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with the label of their component; a node without links is its own."""
    of = components(links).withColumnRenamed("component", "__label")
    return nodes.join(of, "node", "left").withColumn("label", F.coalesce("__label", "node")).drop("__label")


def _one_a_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (node, ...), the first of each node that a task meets."""
    seen: set[int] = set()
    for batch in batches:
        new = []
        for i, node in enumerate(batch.column(0).to_pylist()):
            if node not in seen:
                seen.add(node)
                new.append(i)
        yield batch.take(pa.array(new, pa.int64()))


def _spread(apart: DataFrame, tally: DataFrame) -> DataFrame:
    """Rows of `apart` whose shingle is mixed, with its parts. Of a shingle that more than SHARE of all rows have (so
    fewer than 1 / SHARE shingles, which are broadcast), rows go to SALTS tasks by their class, or nowhere if not mixed."""
    least = (tally.agg(F.sum("n").alias("n")).first()["n"] or 0) * SHARE
    hot = tally.filter(F.col("n") > least).select("key", "slot", F.col("mixed").alias("kept"))
    placed = apart.join(F.broadcast(hot), ["key", "slot"], "left").filter("kept is null or kept")
    placed = placed.withColumn("salt", F.when(F.col("kept"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("kept")
    salts = F.when(F.col("n") > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return placed.join(tally.filter("mixed").select("key", "slot", "parts", F.explode(salts).alias("salt")), ["key", "slot", "salt"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, words: int = WORDS, num: int = NUM, den: int = DEN, group_keys: int = GROUP_KEYS, **sizes) -> DataFrame:
    """`keep` columns of each row (the id alone, if None), n_shingles, component_id and component (a number of its own;
    null for an empty set)."""
    keep = list(dict.fromkeys([id_col, *(keep or [])]))

    def sets(h: np.ndarray, first: np.ndarray) -> list:
        keys, at = shingle_sets(h, first, words)
        return [np.diff(at), *fingerprints(keys, at)]

    corpus = blocks(docs, keep, text_col, SPACED, [T.StructField(c, T.LongType()) for c in ("n_shingles", "fp1", "fp2")], sets)

    def own(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(_one_each(*shingle_sets(*hashes(row), words))[0], return_counts=True)

    told, n_buckets, kind = exchange(corpus, words_of(corpus), own, False, **sizes)

    def living(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for row in left.to_pylist():
            flat, first, names = _one_each(*shingle_sets(*hashes(row), words))
            distinct, at = np.unique(flat, return_inverse=True)
            often = np.minimum(answered(distinct, n_buckets, right, kind), 65535)[at].astype(np.int64)  # an order alone
            n, shared = np.diff(first), np.add.reduceat((often > 1).astype(np.int64), first[:-1]) if len(names) else np.zeros(0, np.int64)
            for d in np.flatnonzero(shared >= least_overlap(n, num, den)).tolist():
                k, f = flat[first[d] : first[d + 1]], often[first[d] : first[d + 1]]
                k, f = k[f > 1], f[f > 1]
                order = np.lexsort((k, f))[: int(len(k) - least_overlap(int(n[d]), num, den) + 1)]
                out.append((int(names[d]), int(n[d]), int(k[0].view(np.int64)), k.tobytes(), k[order].view(np.int64)))
            del flat, distinct, at, often
            release()
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "n", "least", "keys", "prefix"])

    need = corpus.select("block", "first", "vocab", "codes")
    live = hold(need.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(living, "node long, n long, least long, keys binary, prefix array<long>"), "live")

    # Classes that share a prefix shingle: a class is in its slot of sizes and in the next one, so two that may link meet.
    slot = F.floor(F.log("n") / (1.1 * math.log(den / num))).cast("int") if num < den else F.lit(0)
    sharing = live.select("node", F.explode("prefix").alias("key"), slot.alias("slot")).select("node", "key", F.explode(F.array(F.col("slot"), F.col("slot") + 1)).alias("slot"))
    heads = sharing.groupBy("key", "slot").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head <> last").drop("last")
    groups = components(sharing.join(heads, ["key", "slot"]).select(F.col("node").alias("src"), F.col("head").alias("dst")))
    member = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("component", "grp")

    # Parts of groups, by narrow rows; sums are taken per task first.
    narrow = live.select("node", "n", "least").distinct().join(member, "node")
    parts_of = lambda n: F.ceil(F.col(n) / group_keys)
    wide = narrow.groupBy("grp").agg(F.sum("n").alias("all")).select("grp", parts_of("all").alias("n_parts"))
    clusters = narrow.groupBy("grp", "least").agg(F.sum("n").alias("own")).select("grp", "least", parts_of("own").alias("n_own"))
    part = F.when(F.col("n_parts") == 1, 0).otherwise(F.pmod(F.xxhash64("least", F.pmod(F.xxhash64("node"), F.col("n_own"))), F.col("n_parts")))
    member = hold(narrow.join(wide, "grp").join(clusters, ["grp", "least"]).select("node", "n", "grp", part.cast("int").alias("part"), (F.col("n_parts") > 1).alias("large")), "member")
    near = split(live.select("node", "keys"), F.col("node"), member, "node")[1]  # others surely have no partner
    found = near.select("node", "keys").mapInArrow(_one_a_task, "node long, keys binary").join(member, "node")

    def solved(tasks: DataFrame) -> DataFrame:
        dealt = tasks.select("grp", "i", "j", "part", "n", "node", "label", "keys").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
        return dealt.mapInArrow(_links(num, den), "src long, dst long")

    zero, alone = F.lit(0), F.col("node").alias("label")
    links = solved(found.select("*", F.col("part").alias("i"), F.col("part").alias("j"), alone))
    large = member.filter("large").select("node", "n", "grp", "part")
    if not large.isEmpty():
        held = hold(found.filter("large").select("node", "n", "grp", "part", "keys"), "large")
        links = hold(links, "links")
        # One member of each component of a part meets the others, where those are no more than a part holds.
        chosen = _labelled(large, links).groupBy("grp", "part", "label").agg(F.min(F.struct("n", "node")).alias("m")).select("grp", "label", "m.*")
        few = chosen.groupBy("grp").agg(F.sum("n").alias("all")).filter(F.col("all") <= group_keys).select("grp")
        chosen = chosen.join(few, "grp", "left_semi").select("node", "label")
        links = hold(links.unionByName(solved(held.join(chosen, "node").withColumn("part", zero).select("*", zero.alias("i"), zero.alias("j")))), "links")
        # Shingles of classes that still aren't one component: the parts that share one, and these classes.
        labelled = hold(_labelled(large, links).select("node", "grp", "part", "label"), "labelled")
        apart = sharing.join(labelled, "node")
        differ = (F.min("label") != F.max("label")) & (F.size(F.collect_set("part")) > 1)
        tally = hold(apart.groupBy("key", "slot").agg(differ.alias("mixed"), F.collect_set("part").alias("parts"), F.count("*").alias("n")), "tally")
        others = _spread(apart, tally).groupBy("node", "part").agg(F.array_distinct(F.flatten(F.collect_set("parts"))).alias("parts"))
        other = F.explode(F.array_remove("parts", F.col("part"))).alias("other")
        tasks = others.select("node", "part", other).select("node", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        links = links.unionByName(solved(held.join(labelled.select("node", "label"), "node").join(tasks, "node")))
    linked = components(links)

    rows = corpus.select(F.explode("rows").alias("r")).select("r.*")
    classes = rows.filter("n_shingles > 0").groupBy("fp1", "fp2", "n_shingles").agg(F.min("k0").alias("first_id"))
    joins = linked.select(F.col("node").alias("fp1"), F.col("component").alias("linked"))
    of_class = classes.join(joins, "fp1", "left").withColumn("component", F.coalesce("linked", "fp1"))
    of_group = of_class.groupBy("component").agg(F.min("first_id").alias("component_id"))
    final = of_class.select("fp1", "fp2", "n_shingles", "component").join(of_group, "component")
    joined = rows.join(final, ["fp1", "fp2", "n_shingles"], "left")
    new = ["n_shingles", "component_id", "component"]
    ids = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("k0"))
    return joined.select(*[f"k{i}" for i in range(len(keep))], "n_shingles", ids, "component").toDF(*outer_names(keep, new), *new)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of docs, one of each component: that of the smallest id that isn't null. Texts without words all stay.

    Rows that stay whatever the join found aren't shuffled: a row is known by the hash of its id and text, and only
    rows that may have to go are joined (route.py). Of rows equal in both, one stays.
    """
    flat, own = inner(docs, docs.columns), [f"k{i}" for i in range(len(docs.columns))]
    id_name, text_name = (own[docs.columns.index(c)] for c in (id_col, text_col))
    key = F.xxhash64(F.col(id_name), F.col(text_name))
    found = near_duplicates(flat.select(F.col(id_name).alias("id"), F.col(text_name).alias("text"), key.alias("row")), "id", "text", ["row"], **options).filter("n_shingles > 0")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    rows = found.groupBy("component", "row").agg(F.count("*").alias("n")).join(first, "component")
    stays = F.col("first.row") == F.col("row")
    few = hold(rows.select("row", stays.alias("stays"), "n").filter(~F.col("stays") | (F.col("n") > 1)).select("row", "stays"), "repeats")
    clean, rest = split(flat, key, few, "row")
    met = rest.join(few, rest["__key"] == few["row"], "left")
    again = met.filter("stays").dropDuplicates(["__key"])
    return clean.select(*own).unionByName(met.filter("stays is null").select(*own)).unionByName(again.select(*own)).toDF(*docs.columns)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
