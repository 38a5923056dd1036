"""Embedding near-duplicates: randomised-rotation binary codes with correction factors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import components, fingerprint, register, table
from marketlens.llm.simhash import runs
from marketlens.session import stored

COSINE = 0.9
#: Width of the confidence bound in standard errors, and the least number of code bits.
SURE = 5.0
LEAST_BITS = 256
#: Share of the links at exactly the threshold that the bands are to bring together.
RECALL = 0.985
#: Vectors of a bucket that are compared in one piece; a larger bucket is compared block by block.
BLOCK = 1_500


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """``dim`` rows of a random orthogonal matrix, the same in every task."""
    bits = max(LEAST_BITS, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(20_240_521 + dim).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim].astype(np.float32)


def bands(dim: int, rows: int, cosine: float = COSINE, recall: float = RECALL) -> np.ndarray:
    """Bits of the code for each band, so that pairs at the threshold meet in some band.

    A bit differs with probability angle / pi. Bands get longer as the table grows, which
    keeps the rows of a bucket few, and more of them keep the recall.
    """
    bits = max(LEAST_BITS, -(-dim // 64) * 64)
    width = max(4, min(24, round(math.log2(max(rows, 2))) - 4))
    meet = (1 - math.acos(cosine) / math.pi) ** width
    count = math.ceil(math.log(1 - recall) / math.log(1 - meet))
    rng = np.random.default_rng(97)
    return np.stack([rng.choice(bits, width, replace=False) for _ in range(count)])


def unit(rows: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, np.float64) for r in rows])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def band_keys(codes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """One key per row and band from unpacked codes."""
    return (codes[:, chosen].astype(np.int64) << np.arange(chosen.shape[1], dtype=np.int64)).sum(2)


def encode(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Code and correction factor of each vector: the signs of the rotated unit vector, and
    its inner product with the unit vector that the signs stand for."""
    turn = rotation(dim)
    for batch in batches:
        flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = flat.reshape(-1, dim)
        packed = [r.tobytes() for r in x]
        rotated = unit(packed).astype(np.float32) @ turn if packed else np.zeros((0, turn.shape[1]), np.float32)
        factor = np.abs(rotated).sum(1) / math.sqrt(turn.shape[1])
        codes = [r.tobytes() for r in np.packbits(rotated > 0, axis=1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(codes, pa.binary()), pa.array(factor.astype(np.float64))],
            names=["node", "copies", "vector", "code", "factor"],
        )


def spread(batches: Iterator[pa.RecordBatch], chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per vector and band."""
    for batch in batches:
        n, count = batch.num_rows, len(chosen)
        codes = np.unpackbits(np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, -1), axis=1) if n else np.zeros((0, LEAST_BITS), np.uint8)
        keys = band_keys(codes, chosen)
        for band in range(count):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, band, np.int32)), pa.array(keys[:, band]), *batch.columns], names=["band", "key", *batch.schema.names]
            )


def compare(run: pa.Table, dim: int, chosen: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links of one bucket or pair of blocks: places of both vectors, and all nodes.

    For a pair (q, o) the estimate <rotated q, signs of o> / (sqrt(bits) factor of o) is
    unbiased, and its error is within SURE * sqrt((1 - f^2) / f^2 / (bits - 1)) as good as
    surely. Only pairs whose bounds reach the threshold are computed exactly, in double
    precision. A pair that also meets in an earlier band is left to that band.
    """
    nodes = run.column("node").to_numpy()
    vectors = unit(run.column("vector").to_pylist())
    codes = np.unpackbits(np.frombuffer(b"".join(run.column("code").to_pylist()), np.uint8).reshape(len(nodes), -1), axis=1)
    factor = run.column("factor").to_numpy()
    bits = codes.shape[1]
    signs = codes.astype(np.float32) * 2 - 1
    estimate = (vectors.astype(np.float32) @ rotation(dim)) @ signs.T / (math.sqrt(bits) * factor[None, :].astype(np.float32))
    error = SURE * np.sqrt((1 - factor**2) / factor**2 / (bits - 1)) + 1e-4
    maybe = estimate >= (cosine - error)[None, :]
    maybe &= maybe.T
    block = run.column("block").to_numpy()
    if (block != block[0]).any():
        maybe &= block[:, None] < block[None, :]
    elif run.column("one").to_numpy()[0] == run.column("other").to_numpy()[0]:
        maybe = np.triu(maybe, 1)
    else:
        return np.empty(0, int), np.empty(0, int), nodes  # one of two blocks is empty
    i, j = np.nonzero(maybe)
    if i.size:
        band = int(run.column("band")[0].as_py())
        keys = band_keys(codes, chosen[:band]) if band else np.zeros((len(nodes), 0), np.int64)
        fine = np.ones(i.size, bool)
        for part in range(0, i.size, 100_000):
            s = slice(part, part + 100_000)
            fine[s] = ~(keys[i[s]] == keys[j[s]]).any(1) & (np.einsum("ij,ij->i", vectors[i[s]], vectors[j[s]]) >= cosine)
        i, j = i[fine], j[fine]
    return i, j, nodes


def link(batches: Iterator[pa.RecordBatch], dim: int, chosen: np.ndarray, cosine: float) -> Iterator[pa.RecordBatch]:
    """For each bucket: how many vectors (copies counted) each one links to, and edges that connect them."""
    for run in runs(batches, ["band", "key", "one", "other"]):
        if run.num_rows < 2:
            continue
        i, j, nodes = compare(run, dim, chosen, cosine)
        if not i.size:
            continue
        copies = run.column("copies").to_numpy()
        links = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
        who = np.flatnonzero(links)
        label = np.arange(len(nodes))
        while True:  # every vector to the smallest place it reaches
            before = label.copy()
            np.minimum.at(label, i, label[j])
            np.minimum.at(label, j, label[i])
            label = label[label]
            if (label == before).all():
                break
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[who]), pa.array(nodes[label[who]]), pa.array(links[who].astype(np.int64))], names=["a", "b", "links"]
        )


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per vector: the key, ``n_links``, ``component_id`` and ``kept``.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing. Equal vectors are compared once and counted as often as they occur; vectors of
    different lengths never link. Bands of code bits choose which vectors are compared; a
    bucket of more than BLOCK vectors is compared by pairs of blocks, so no task holds it
    whole and nothing is left out. Only counts and one edge per vector and bucket leave a
    task. Equal keys count as one node.
    """
    x = F.col(column).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists(x, lambda v: v != 0)
    fine = F.coalesce(x.isNotNull() & ~bad & some, F.lit(False))
    one, two = fingerprint(x)
    rows = stored(
        vectors.select(F.col(key).alias("key"), x.alias("x"), F.when(fine, one).alias("one"), F.when(fine, two).alias("two")), "vectors"
    )
    copies = rows.filter("one is not null").groupBy("one", "two").agg(
        F.min("key").alias("node"), F.count("*").alias("copies"), F.first("x").alias("x")
    )
    distinct = stored(copies, "copies")
    found = []
    for dim, count in distinct.groupBy(F.size("x")).count().collect():  # a row per vector length
        chosen = bands(dim, count, cosine)
        own = distinct.filter((F.size("x") == dim) & F.col("node").isNotNull()).select("node", "copies", "x")
        codes = own.mapInArrow(lambda b, dim=dim: encode(b, dim), "node long, copies long, vector binary, code binary, factor double")
        codes = stored(codes, "codes")
        banded = codes.mapInArrow(
            lambda b, chosen=chosen: spread(b, chosen), "band int, key long, node long, copies long, vector binary, code binary, factor double"
        )
        keys = codes.select("code").mapInArrow(
            lambda b, chosen=chosen: (
                pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(len(chosen), dtype=np.int32), r.num_rows)), pa.array(band_keys(np.unpackbits(np.frombuffer(b"".join(r.column(0).to_pylist()), np.uint8).reshape(r.num_rows, -1), axis=1), chosen).ravel())],
                    names=["band", "key"],
                )
                for r in b
                if r.num_rows
            ),
            "band int, key long",
        )
        sizes = stored(keys.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
        met = banded.join(sizes, ["band", "key"])
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        met = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        pairs = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        met = met.withColumn("partner", pairs).select(
            "band", "key", F.least("block", "partner").alias("one"), F.greatest("block", "partner").alias("other"), "block", "node", "copies", "vector", "code", "factor"
        )
        met = met.repartition("band", "key", "one", "other").sortWithinPartitions("band", "key", "one", "other", "node")
        found.append(met.mapInArrow(lambda b, dim=dim, chosen=chosen: link(b, dim, chosen, cosine), "a long, b long, links long"))
    nodes = distinct.select("one", "two", "node", "copies")
    if found:
        links = found[0]
        for more in found[1:]:
            links = links.union(more)
        links = stored(links, "links")
        counted = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        groups = components(links.select("a", "b"))
        nodes = nodes.join(counted, "node", "left").join(groups, "node", "left")
    else:
        nodes = nodes.withColumn("links", F.lit(0).cast("long")).withColumn("component", F.lit(None).cast("long"))
    joined = rows.select("key", "one", "two").join(nodes, ["one", "two"], "left")
    component = F.coalesce("component", "node", "key")
    return joined.select(
        F.col("key").alias(key),
        F.coalesce(F.col("links"), F.lit(0)).__add__(F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
    )


@register("op10_embedding_near_dup")
def op10_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
