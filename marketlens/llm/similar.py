"""Near-duplicate texts by SimHash and an exact check: five-word shingles, Jaccard similarity 0.8 or more.

Fingerprints are dealt to shards by several choices of their bits; each shard has a BK-tree. Two
texts of the least similarity differ in each bit with a probability that follows from their angle, which
gives the radius and the number of choices for the recall wanted. Candidates of the trees are decided by
their shingles, so no pair below the similarity is linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import components, fingerprint, free, map_column
from marketlens.llm.simhash import runs, signed
from marketlens.session import stored

WORDS = 5
HALF = 64  # bits of a fingerprint's half
SIMILARITY = 0.8
RECALL = 0.95  # of pairs at the similarity itself; more above it
SHARD_VALUES = 4_000  # fingerprints a shard holds on average
LEAF = 256  # values of a tree's leaf, compared at once
NEAREST = 2  # partners of a value that are checked first
CHECKED = 256  # sets compared with one set at once


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the text's distinct shingles, two 64-bit columns, in order; fewer words are one shingle, none give none. A-Z count as a-z."""
    own = text.encode().lower().split() if text else []
    if not own:
        return np.empty((0, 2), np.uint64)
    joined = [xxhash.xxh3_128_digest(b" ".join(own[k : k + words])) for k in range(max(1, len(own) - words + 1))]
    hashes = np.frombuffer(b"".join(joined), np.uint64).reshape(-1, 2)
    return hashes[np.unique(hashes[:, 0], return_index=True)[1]]


def simhash_of(hashes: np.ndarray) -> np.ndarray:
    """The majority of each of 128 bits over distinct shingles, as two 64-bit numbers."""
    ones = np.zeros(2 * HALF, np.int64)
    for k in range(0, len(hashes), 50_000):
        ones += np.unpackbits(np.ascontiguousarray(hashes[k : k + 50_000]).view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def sketches(docs: DataFrame, text: str, words: int = WORDS) -> DataFrame:
    """Replace the text by ``node``, which names its set of shingles by 128 bits, and the halves of its fingerprint."""

    def one(value: str | None) -> tuple[str, int, int]:
        hashes = shingles(value, words)
        first, second = simhash_of(hashes).view(np.int64).tolist()
        return xxhash.xxh3_128_hexdigest(hashes[:, 0].tobytes()), first, second

    def make():
        return lambda values: [list(x) for x in zip(*map(one, values))] if values else [[], [], []]

    new = [T.StructField("node", T.StringType()), T.StructField("fingerprint", T.LongType()), T.StructField("second", T.LongType())]
    return map_column(docs, text, new, make)


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints differ, by numpy's rules for shapes; the last axis holds the halves."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


# Which bits, which radius ---------------------------------------------------------------


def plan(nodes: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, list[int]]:
    """Radius and masks of bits, so that pairs at the similarity lie in the radius and share a mask's bits with the recall.

    Sets of equal size with Jaccard J have the cosine 2J / (1 + J); a bit differs with probability angle / pi.
    The radius, over 128 bits, is two and a half standard deviations above the mean distance, far below
    what unrelated texts have. Masks choose among the first 64 bits; their number is the least that
    reaches the recall over all distances there.
    """
    differs = acos(2 * similarity / (1 + similarity)) / pi
    radius = ceil(2 * HALF * differs + 2.5 * sqrt(2 * HALF * differs * (1 - differs)))
    within = sum(comb(2 * HALF, d) * differs**d * (1 - differs) ** (2 * HALF - d) for d in range(radius + 1))
    bits = min(24, max(4, ceil(log2(max(nodes, 1) / SHARD_VALUES))))
    likely = [comb(HALF, d) * differs**d * (1 - differs) ** (HALF - d) for d in range(HALF + 1)]
    shared = [comb(HALF - d, bits) / comb(HALF, bits) for d in range(HALF + 1)]
    tables = 1
    while within * sum(p * (1 - (1 - s) ** tables) for p, s in zip(likely, shared)) < recall:
        tables += ceil(tables / 50)
    rng = np.random.default_rng(1)
    return radius, [sum(1 << int(b) for b in rng.choice(HALF, bits, replace=False)) for _ in range(tables)]


# Trees ----------------------------------------------------------------------------------


class Rings:
    """A BK-tree: a pivot and, keyed by their distance to it, the rest; small rests are leaves compared at once."""

    def __init__(self, values: np.ndarray, places: np.ndarray):
        self.leaf = len(places) <= LEAF
        self.places = places
        if not self.leaf:
            self.pivot, rest = places[0], places[1:]
            away = distance(values[rest], values[self.pivot])
            self.children = {int(d): Rings(values, rest[away == d]) if d else rest[away == d] for d in np.unique(away)}

    def near(self, values: np.ndarray, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(asked places, tree places) within the radius; only edges whose distance can hold one are followed."""
        if self.leaf:
            yield _within(values, asked, self.places, radius)
            return
        away = distance(values[asked], values[self.pivot])
        hit = asked[away <= radius]
        yield hit, np.full(len(hit), self.pivot)
        for d, child in self.children.items():
            some = asked[np.abs(away - d) <= radius]
            if not len(some):
                continue
            if isinstance(child, Rings):
                yield from child.near(values, some, radius)
            else:  # equal to the pivot
                yield np.repeat(some, len(child)), np.tile(child, len(some))


def _within(values: np.ndarray, asked: np.ndarray, places: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.nonzero(distance(values[asked][:, None], values[places][None, :]) <= radius)
    return asked[i], places[j]


def _near_places(values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays (later, earlier) of the places within the radius, a bounded number of asked places at once."""
    tree = Rings(values, np.arange(len(values)))
    step = max(1, (1 << 20) // max(len(values), 1))
    for start in range(0, len(values), step):
        asked = np.arange(start, min(start + step, len(values)))
        found = [np.stack(pair) for pair in tree.near(values, asked, radius)]
        later, earlier = np.concatenate(found, axis=1)
        keep = earlier < later
        yield later[keep], earlier[keep]


def tree_pairs(values: np.ndarray, radius: int, groups: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs (later, earlier) of places within the radius: each place's NEAREST, or with ``groups`` all of another group."""
    for later, earlier in _near_places(values, radius):
        if groups is not None:
            keep = groups[earlier] != groups[later]
            later, earlier = later[keep], earlier[keep]
        else:
            away = distance(values[later], values[earlier])
            order = np.lexsort((earlier, away, later))
            later, earlier = later[order], earlier[order]
            rank = np.arange(len(later)) - np.searchsorted(later, later)
            later, earlier = later[rank < NEAREST], earlier[rank < NEAREST]
        yield from zip(later.tolist(), earlier.tolist())


def _dealt(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """Rows (table, shared, …) of every shard a node is in."""
    shards = F.array(*[F.struct(F.lit(k).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(signed(m))).alias("shared")) for k, m in enumerate(masks)])
    return nodes.select(F.explode(shards).alias("s"), *nodes.columns).select("s.*", *nodes.columns)


def _by_shard(rows: DataFrame) -> DataFrame:
    return rows.repartition("table", "shared").sortWithinPartitions("table", "shared", "fingerprint", "node")


def _halves(shard: pa.Table) -> np.ndarray:
    return np.stack([shard.column(c).to_numpy().view(np.uint64) for c in ("fingerprint", "second")], axis=1)


def _groups(shard: pa.Table) -> np.ndarray:
    return np.unique(shard.column("group").to_numpy(), return_inverse=True)[1]


def _pair_batch(a: list[str], b: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])


def candidates(nodes: DataFrame, radius: int, masks: list[int]) -> DataFrame:
    """Distinct pairs (a, b) of ``nodes`` (node, fingerprint, second): each node's nearest in each of its shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for shard in runs(batches, ["table", "shared"]):
            names = shard.column("node")
            for later, earlier in tree_pairs(_halves(shard), radius):
                a.append(names[later].as_py())
                b.append(names[earlier].as_py())
                if len(a) == 50_000:
                    yield _pair_batch(a, b)
                    a, b = [], []
        yield _pair_batch(a, b)

    found = _by_shard(_dealt(nodes.select("node", "fingerprint", "second"), masks)).mapInArrow(run, "a string, b string")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _first_met(values: np.ndarray, groups: np.ndarray, radius: int, earlier_masks: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of pairs within the radius and of different groups that share no earlier table's bits: each pair is met in one shard."""
    for later, earlier in _near_places(values, radius):
        keep = groups[later] != groups[earlier]
        later, earlier = later[keep], earlier[keep]
        unlike = values[later, 0] ^ values[earlier, 0]
        new = np.ones(len(later), bool)
        for mask in earlier_masks:
            new &= (unlike & np.uint64(mask)) != 0
        yield later[new], earlier[new]


def crossing(grouped: DataFrame, radius: int, masks: list[int]) -> DataFrame:
    """The rows (table, shared, node, fingerprint, second, group) of shards with a node of another group in the radius.

    Tells the nodes, not their pairs, so it never has more rows than the shards.
    """
    rows = _by_shard(_dealt(grouped.select("node", "fingerprint", "second", "group"), masks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in runs(batches, ["table", "shared"]):
            hit = np.zeros(shard.num_rows, bool)
            for pair in _first_met(_halves(shard), _groups(shard), radius, masks[: shard.column("table")[0].as_py()]):
                for places in pair:
                    hit[places] = True
            if hit.any():
                yield from shard.filter(pa.array(hit)).combine_chunks().to_batches()

    return rows.mapInArrow(run, rows.schema)


# The exact check -------------------------------------------------------------------------


def shingle_sets(wanted: DataFrame, marked: DataFrame, nodes: DataFrame, text: str, words: int) -> DataFrame:
    """(node, set) of the wanted nodes: the sorted shingles. Only their texts are read again."""
    rows = marked.join(nodes.join(wanted.distinct(), "node").select("node", "__one", "__two"), ["__one", "__two"])

    def make():
        return lambda values: [[np.unique(shingles(v, words)[:, 0].astype(np.uint32)).view(np.int32).tolist() for v in values]]

    sets = map_column(rows.select("node", text), text, [T.StructField("set", T.ArrayType(T.IntegerType()))], make).dropDuplicates(["node"])
    return stored(sets, "shingles")


def checked(pairs: DataFrame, marked: DataFrame, nodes: DataFrame, text: str, similarity: float, words: int) -> DataFrame:
    """The pairs whose shingles have at least the similarity."""
    sets = shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), marked, nodes, text, words)
    both = pairs.join(sets.withColumnRenamed("node", "a").withColumnRenamed("set", "x"), "a").join(sets.withColumnRenamed("node", "b").withColumnRenamed("set", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _joining(pairs: Iterator[tuple[np.ndarray, np.ndarray]], groups: np.ndarray, sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Of the pairs those whose sets have the similarity and that join groups not yet joined: fewer than there are groups."""
    above = list(range(int(groups.max(initial=-1)) + 1))

    def root(g: int) -> int:
        while above[g] != g:
            above[g] = above[above[g]]
            g = above[g]
        return g

    for later, earlier in pairs:
        order = np.argsort(later, kind="stable")
        later, earlier = later[order], earlier[order]
        cuts = np.flatnonzero(np.diff(later, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(later)]):
            i, own = int(later[lo]), sets[later[lo]]
            for k in range(lo, hi, CHECKED):
                others = [j for j in earlier[k : min(k + CHECKED, hi)].tolist() if root(groups[j]) != root(groups[i])]
                if not others:
                    continue
                sizes = np.array([len(sets[j]) for j in others])
                every = np.concatenate([sets[j] for j in others])
                held = np.concatenate([[0], np.cumsum(np.isin(every, own))])
                ends = np.cumsum(sizes)
                shared = held[ends] - held[ends - sizes]
                for j in np.array(others)[shared >= similarity * (sizes + len(own) - shared)].tolist():
                    x, y = root(groups[i]), root(groups[j])
                    if x != y:
                        above[max(x, y)] = min(x, y)
                        yield i, j


def joining_links(rows: DataFrame, sets: DataFrame, radius: int, masks: list[int], similarity: float) -> DataFrame:
    """Links (a, b) that join the groups of :func:`crossing` rows: every pair in the radius is decided, in its shard.

    Pairs are compared where they are found and only those that join two groups leave the task, so
    the rows told are fewer than the nodes of the shards however many pairs there are.
    """
    held = _by_shard(rows.join(sets, "node").select(*rows.columns, "set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for shard in runs(batches, ["table", "shared"]):
            names, groups = shard.column("node"), _groups(shard)
            own = [x.values.to_numpy() for x in shard.column("set")]
            met = _first_met(_halves(shard), groups, radius, masks[: shard.column("table")[0].as_py()])
            for i, j in _joining(met, groups, own, similarity):
                a.append(names[i].as_py())
                b.append(names[j].as_py())
        yield _pair_batch(a, b)

    return held.mapInArrow(run, "a string, b string")


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """(__one, __two, __key, component) of every row: two hashes of key and text, the key, the group of its text.

    Rows of equal shingle sets are one node. First each node's nearest are checked and joined to
    groups, then the pairs between different groups, in their shards: only links that join groups are
    told, so a group of many near copies is never laid out in pairs, linked or not.
    """
    one, two = fingerprint(f"`{key}`", f"`{text}`")
    texts = docs.select(one.alias("__one"), two.alias("__two"), F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    told = stored(sketches(texts, "__text", words), "sketches")
    nodes = stored(told.groupBy("node").agg(F.first("fingerprint").alias("fingerprint"), F.first("second").alias("second"), F.min(F.struct("__one", "__two")).alias("r")).select("node", "fingerprint", "second", "r.*"), "nodes")
    radius, masks = plan(nodes.count(), similarity)
    near = stored(candidates(nodes, radius, masks), "nearest")
    edges = stored(checked(near, texts, nodes, "__text", similarity, words), "links")
    first = components(edges)
    grouped = nodes.join(first.withColumnRenamed("component", "group"), nodes["node"] == first["node"], "left").select(nodes["node"], "fingerprint", "second", F.coalesce("group", nodes["node"]).alias("group"))
    across = stored(crossing(grouped, radius, masks), "crossing")
    groups = first
    if not across.isEmpty():
        sets = shingle_sets(across.select("node"), texts, nodes, "__text", words)
        groups = components(edges.unionByName(joining_links(across, sets, radius, masks, similarity)))
    return told.join(groups, "node", "left").select("__one", "__two", "__key", F.coalesce("component", "node").alias("component"))


def one_of_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest key stays.

    Groups follow links of five-word Jaccard similarity 0.8 or more (:data:`RECALL` of those at 0.8 itself, more above;
    none below). Null keys come last, equal keys are told apart by their text's hash, of rows equal in both one stays. Texts
    with fewer words are one shingle; null, empty and blank texts are alike and one of them stays. An empty table
    gives no rows; further columns pass through, whatever their names.
    """
    h_one, h_two, w_one, w_two = free(docs, "__one", "__two", "__w_one", "__w_two")
    narrow = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    one, two = fingerprint(f"`{key}`", f"`{text}`")
    marked = docs.withColumn(h_one, one).withColumn(h_two, two)
    groups = similar_groups(narrow, "__key", "__text", similarity, words)
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("__key").isNull().alias("no"), F.col("__key").alias("k"), "__one", "__two")).alias("f"))
    winners = first.select(F.col("f.__one").alias(w_one), F.col("f.__two").alias(w_two))
    stay = marked.join(winners, (F.col(h_one) == F.col(w_one)) & (F.col(h_two) == F.col(w_two)), "left_semi")
    return stay.dropDuplicates([h_one, h_two]).select(*[F.col(f"`{c}`") for c in docs.columns])
