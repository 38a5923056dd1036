"""SimHash near-duplicates: shards of fingerprints that agree on some bits, one BK-tree per shard."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import components, fingerprint, map_column, register, table
from marketlens.session import stored

BITS = 64
RADIUS = 3
#: A shard of more fingerprints is cut by further bits, at most DEEPEST times.
SHARD = 2_000
DEEPEST = 5

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def simhash(text: str | None) -> int:
    """The text's 64-bit fingerprint over its 3-word shingles; no words: 0."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z only
    if not words:
        return 0
    if len(words) < 3:
        shingles = [b" ".join(words)]
    else:
        shingles = [a + b" " + b + b" " + c for a, b, c in zip(words, words[1:], words[2:])]
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(shingles), 50_000):
        hashes = np.array(list(map(_hash, shingles[k : k + 50_000])), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by its ``fingerprint`` (long, the 64 bits signed)."""

    def make():
        return lambda values: [[signed(simhash(v)) for v in values]]

    return map_column(docs, text, [T.StructField("fingerprint", T.LongType())], make)


class BkTree:
    """Fingerprints in a tree whose children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        k = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while at != k:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), k)

    def near(self, value: int, radius: int) -> list[int]:
        """Places of all values within the radius: only edges whose key can hold one are followed."""
        found, open_nodes = [], [0] if self.values else []
        while open_nodes:
            at = open_nodes.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            open_nodes += [c for key, c in self.children[at].items() if distance - radius <= key <= distance + radius]
        return found


def linked(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Edges that connect the values within the radius of each other, each value to its group's smallest."""
    tree, group = BkTree(), list(range(len(values)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i, value in enumerate(values):
        for j in tree.near(value, radius):
            a, b = root(i), root(j)
            if a != b:
                group[max(a, b)] = min(a, b)
        tree.add(value)
    for i, value in enumerate(values):
        if (r := root(i)) != i:
            yield value, values[r]


def cuts(mask: int, parts: int) -> list[int]:
    """The mask with one of ``parts`` equal portions of its free bits added, for each portion."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    edges = [round(k * len(free) / parts) for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(edges, edges[1:])]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys together, from batches sorted by the keys."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        if rest is not None:
            now = pa.concat_tables([rest, now])
        if not now.num_rows:
            continue
        columns = [now.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        starts = [0, *change.tolist()]
        for lo, hi in zip(starts, starts[1:]):
            yield now.slice(lo, hi - lo)
        rest = now.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _tree_edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for run in runs(batches, ["mask", "shared"]):
        for x, y in linked(run.column("fingerprint").to_numpy().view(np.uint64).tolist(), radius):
            a.append(signed(x))
            b.append(signed(y))
        if len(a) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_edges(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints within the radius.

    Two of them agree on at least one of radius + 1 portions of their bits, so each portion's
    value is a shard. A shard of more than ``shard`` fingerprints is cut by portions of the
    bits still free, on which its near ones must again agree; a shard cut DEEPEST times
    can't hold more values than its few free bits allow. Every shard has its own BK-tree,
    in the task that holds the shard; no tree is broadcast, for all of them together grow with the corpus.
    """
    spark = prints.sparkSession
    parts = radius + 1
    masks = {0: cuts(0, parts)}
    rows = prints.select(F.lit(0).cast("long").alias("mask"), "fingerprint")
    found: list[DataFrame] = []
    for depth in range(DEEPEST):
        pairs = [(signed(m), signed(n)) for m, more in masks.items() for n in more]
        finer = spark.createDataFrame(pairs, "mask long, finer long")
        cut = rows.join(F.broadcast(finer), "mask").select(  # at most parts ** DEEPEST rows
            F.col("finer").alias("mask"), F.col("finer").bitwiseAND(F.col("fingerprint")).alias("shared"), "fingerprint"
        )
        cut = stored(cut, "shards")
        sizes = cut.groupBy("mask", "shared").agg(F.count("*").alias("n")).filter("n > 1")
        sized = cut.join(sizes, ["mask", "shared"])
        small = sized if depth == DEEPEST - 1 else sized.filter(F.col("n") <= shard)
        small = small.select("mask", "shared", "fingerprint").repartition("mask", "shared").sortWithinPartitions("mask", "shared", "fingerprint")
        found.append(small.mapInArrow(lambda batches: _tree_edges(batches, radius), "a long, b long"))
        if depth == DEEPEST - 1:
            break
        rows = stored(sized.filter(F.col("n") > shard).select("mask", "fingerprint"), "wide")
        wide = [r[0] % (1 << 64) for r in rows.select("mask").distinct().collect()]  # at most parts ** DEEPEST masks
        if not wide:
            break
        masks = {m: cuts(m, parts) for m in wide}
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges


def grouped(prints: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Add ``component_id``, the smallest key reachable by links of at most ``radius`` bits, and ``component``.

    ``prints`` has the key and ``fingerprint``. Equal fingerprints are one node; a key that is
    null counts in no minimum. ``component``, the smallest fingerprint reached, names a group
    also where keys are null or repeated. Links are reduced to edges to each group's smallest member
    inside the shards, so a group of copies never becomes its pairs.
    """
    nodes = stored(prints.groupBy("fingerprint").agg(F.min(key).alias("least")), "prints")
    groups = components(near_edges(nodes, radius))
    own = nodes.join(groups.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", F.coalesce("component", "fingerprint").alias("component"), "least"
    )
    own = stored(own, "nodes")
    smallest = own.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(own.join(smallest, "component").select("fingerprint", "component", "component_id"), "fingerprint")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest key stays.

    Equal keys are told apart by their text's hash; of rows equal in both one stays.
    """
    one, two = fingerprint(key, text)
    marked = docs.withColumn("__one", one).withColumn("__two", two)
    narrow = stored(fingerprints(marked.select(key, "__one", "__two", text), text), "simhash")
    groups = grouped(narrow, key)
    first = groups.groupBy("component").agg(
        F.min(F.struct(F.col(key).isNull().alias("no"), F.col(key).alias("k"), "__one", "__two")).alias("f")
    )
    winners = first.select("f.__one", "f.__two")
    return marked.join(winners, ["__one", "__two"], "left_semi").dropDuplicates(["__one", "__two"]).select(*docs.columns)


@register("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = stored(fingerprints(docs), "simhash")
    return grouped(prints).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
