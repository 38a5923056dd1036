"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often they meet.

First pass: tasks align their documents and count, for each pair of token ids, the documents that
link it; the counts leave a task as one partial list. The distinct pairs get a minimal perfect hash
for each shard of them. Partial lists become dense count vectors indexed by that hash, summed
first over parts of a shard, then over the parts. Second pass: documents are aligned again, their
pairs go to the shard that holds them, the key at the slot is compared, and counts come back.

A pair is one number below 2^32, so both vocabularies have at most 65,536 entries and there
can be no more pairs than that, however large the corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marketlens.llm.common import register, table
from marketlens.llm.perfect_hash import PerfectHash
from marketlens.session import stored

VOCABULARY = 1 << 16
HELD_PAIRS = 1 << 21  # distinct pairs a task counts before it lets them go: 32 MB
SHARD_PAIRS = 1 << 17  # pairs of one perfect hash: 1.6 MB with keys and counts
TREE_PARTS = 8  # dense vectors of one shard that are summed apart first
TASK_BYTES = 16 << 20  # links that one part of a shard looks up, at 4 bytes each after packing
BATCH_CHARS = 1 << 20  # text aligned at once
LONG_TEXT = 100_000  # longer texts go to the tokenizers library, whose pattern needs no stack


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.long = Tokenizer.from_file(path_a)
        self.long.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            held = json.load(f)
        letters, special = byte_letters(), {t["content"] for t in held["added_tokens"]}
        vocabulary = held["model"]["vocab"]
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        if any(vocabulary["".join(m)] != 256 + k for k, m in enumerate(merges)):
            raise ValueError(f"the ids of {path_a} do not follow its merges")
        self.short = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [self.piece_bytes(i) for i in range(self.pieces.get_piece_size())]
        if max(len(self.bytes_a), len(self.bytes_b)) > VOCABULARY:
            raise ValueError("a pair of ids must fit 32 bits")
        self.lengths_a, self.lengths_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        # Without a normalizer, pieces laid end to end are the text with U+2581 for blanks, so their bytes differ
        # from the text's only where the text holds U+2581 itself, and then in length too.
        spec = sentencepiece_model_pb2.ModelProto.FromString(self.pieces.serialized_model_proto()).normalizer_spec
        self.plain = spec.name == "identity" and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
        # How a token is written in a list of groups: as the last of its side or not, A before B.
        written = [f"{i}{end}".encode() for n, last in ((len(self.bytes_a), "|"), (len(self.bytes_b), ";")) for i in range(n) for end in (",", last)]
        self.written = np.array(written, "S6").view(np.uint8).reshape(-1, 6)
        self.sizes = np.array([len(w) for w in written], np.int64)

    def piece_bytes(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, texts: list[str | None]) -> tuple[Flat, Flat]:
        """Ids of both sides, none where a text is null or empty or a side's bytes are not space and text."""
        spaced = [" " + t if t else "" for t in texts]
        ids_a = [self.long.encode(t, add_special_tokens=False).ids if len(t) > LONG_TEXT else self.short.encode_ordinary(t) for t in spaced]
        ids_b = self.pieces.encode([t[1:] for t in spaced], num_threads=1)  # the library adds the space
        raw = np.array([len(t.encode()) for t in spaced], np.int64)
        a, b = Flat(ids_a, self.lengths_a), Flat(ids_b, self.lengths_b)
        strange = (a.bytes != raw) | (b.bytes != raw)
        if not self.plain:
            strange |= np.array([b"".join(map(self.bytes_b.__getitem__, ids)) != t.encode() for ids, t in zip(ids_b, spaced, strict=True)], bool)
        if strange.any():
            for k in np.flatnonzero(strange).tolist():
                ids_a[k], ids_b[k] = [], []
            a, b = Flat(ids_a, self.lengths_a), Flat(ids_b, self.lengths_b)
        return a, b

    def aligned(self, texts: list[str | None]) -> Aligned:
        return Aligned(self, *self.tokens(texts))


class Flat:
    """The tokens of a batch of texts end to end: ids, where each ends in bytes, tokens and bytes of each text."""

    def __init__(self, ids: list[list[int]], lengths: np.ndarray):
        self.n = np.array([len(x) for x in ids], np.int64)
        self.ids = np.fromiter(chain.from_iterable(ids), np.int64, int(self.n.sum()))
        self.ends = np.cumsum(lengths[self.ids])
        until = np.concatenate([[0], self.ends])[np.concatenate([[0], np.cumsum(self.n)])]
        self.bytes = np.diff(until)


class Aligned:
    """The alignment of a batch of texts, laid end to end."""

    def __init__(self, of: Aligner, a: Flat, b: Flat):
        self.of, self.n, self.n_a, self.n_b, self.a, self.b = of, len(a.n), a.n, b.n, a.ids, b.ids
        in_a, in_b = (np.zeros(int(x.bytes.sum()) + 1, bool) for x in (a, b))
        in_a[a.ends] = in_b[b.ends] = True
        # Each stretch between neighbouring ends lies in one token of either side: one link.
        ends = np.flatnonzero(in_a | in_b)
        end_a, end_b = in_a[ends], in_b[ends]
        self.link_a, self.link_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
        self.closes = end_a & end_b
        self.doc = np.repeat(np.arange(self.n), self.n_a)[self.link_a]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (pair, document) with the number of their links, by pair, then document."""
        pair = (self.a[self.link_a] << 16) | self.b[self.link_b]
        both, times = np.unique(pair * self.n + self.doc, return_counts=True)
        return both // max(self.n, 1), both % max(self.n, 1), times

    def facts(self) -> list[np.ndarray]:
        """Per document the numbers of A tokens, B tokens, groups and links."""
        return [self.n_a, self.n_b, np.bincount(self.doc[self.closes], minlength=self.n), np.bincount(self.doc, minlength=self.n)]

    def groups(self) -> list[bytes]:
        """Per document its groups as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        last_a, last_b = self.link_a[self.closes], self.link_b[self.closes]
        end_a, end_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        end_a[last_a], end_b[last_b] = 1, 1
        group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
        b_before, a_until = np.concatenate([[0], last_b + 1]), last_a + 1
        line = np.empty(len(self.a) + len(self.b), np.int64)
        line[np.arange(len(self.a)) + b_before[group_a]] = self.a * 2 + end_a
        line[np.arange(len(self.b)) + a_until[group_b]] = (self.b + len(self.of.bytes_a)) * 2 + end_b
        sizes = self.of.sizes[line]
        text = self.of.written[line][np.arange(6) < sizes[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(self.n_a + self.n_b)].tolist()
        return [text[start : max(start, end - 1)] for start, end in zip([0, *ends], ends)]  # without the last mark


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker."""
    return Aligner(path_a, path_b)


def text_batches(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list]]:
    """(keys, texts) of at most 1,000 rows and about ``chars`` characters, longer texts alone."""
    for batch in batches:
        keys, texts = (batch.column(i).to_pylist() for i in (0, 1))
        at = size = 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if k > at and (size > chars or k - at == 1000):
                yield keys[at:k], texts[at:k]
                at, size = k, len(text or "")
        if texts:
            yield keys[at:], texts[at:]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros(len(distinct), np.int64)
    np.add.at(out, place, np.concatenate(counts))
    return distinct, out


def partial_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair, n): documents that link a pair, summed within a task; a pair may come several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        held: tuple[list, list] = ([], [])

        def out() -> Iterator[pa.RecordBatch]:
            if held[0]:
                keys, counts = _summed(*held)
                for k in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (keys, counts)], names=["pair", "n"])

        for _, texts in text_batches(batches, BATCH_CHARS):
            pair, _, _ = own.aligned(texts).pairs()
            keys, counts = np.unique(pair, return_counts=True)
            held[0].append(keys)
            held[1].append(counts)
            if sum(map(len, held[0])) > HELD_PAIRS:
                keys, counts = _summed(*held)
                held = ([keys], [counts])
                if len(keys) > HELD_PAIRS // 2:
                    yield from out()
                    held = ([], [])
        yield from out()

    return docs.mapInArrow(run, "pair long, n long")


# Shards of pairs ----------------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[tuple | None, pa.RecordBatch | None]]:
    """Rows of a sorted stream cut where the first ``by`` columns change: (their values, slice); a last (None, None)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([np.asarray(batch.column(i)) for i in range(by)])
        cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield tuple(values[:, start].tolist()), batch.slice(start, end - start)
    yield None, None


# Fixed values of the generator x -> 48271 x modulo the prime 2^31 - 1, which deals pairs to shards.
PRIME, FACTOR = 2**31 - 1, 48271


def _shard(shards: int) -> Column:
    return (F.col("pair") % PRIME * FACTOR % PRIME % shards).cast("int").alias("shard")


def shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each pair, as :func:`_shard` deals them."""
    return pairs.astype(np.int64) % PRIME * FACTOR % PRIME % shards


def hash_tables(pairs: DataFrame, shards: int) -> DataFrame:
    """(shard, hash): the perfect hash of each shard's distinct pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys = None, []
        for key, rows in _runs(batches, 1):
            if keys and key != now:
                built = PerfectHash.build(np.concatenate(keys)).to_bytes()
                yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([built], pa.binary())], names=["shard", "hash"])
                keys = []
            if key is not None:
                now = key
                keys.append(np.asarray(rows.column(1)).astype(np.uint32))

    dealt = pairs.select(_shard(shards), "pair").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "shard int, hash binary")


def dense_counts(partials: DataFrame, tables: DataFrame, shards: int) -> DataFrame:
    """(shard, hash, counts): each shard's dense vector of 64-bit counts, summed in two steps."""

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, counts = None, None, None
        for key, rows in _runs(batches, 2):
            if key != now:
                if now is not None:
                    yield vector(now[0], own if now[1] == 0 else None, counts)
                now, own, counts = key, None, None
            if key is None:
                return
            if own is None:
                first = rows.column(3)[0].as_py()
                own, rows = PerfectHash.from_bytes(first), rows.slice(1)
                counts = np.zeros(len(own.keys), np.int64)
            slots = own.slots(np.asarray(rows.column(4)))
            if (slots < 0).any():
                raise RuntimeError("a counted pair is not in its hash")
            np.add.at(counts, slots, np.asarray(rows.column(5)))

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, counts = None, None, 0
        for key, rows in _runs(batches, 1):
            if key != now:
                if now is not None:
                    yield vector(now[0], own, counts)
                now, own, counts = key, None, 0
            if key is None:
                return
            for k in range(rows.num_rows):
                held = rows.column(1)[k].as_py()
                own = held or own
                counts = counts + np.frombuffer(rows.column(2)[k].as_py(), np.int64)

    def vector(shard: int, own, counts: np.ndarray) -> pa.RecordBatch:
        data = own.to_bytes() if isinstance(own, PerfectHash) else own
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([data], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["shard", "hash", "counts"]
        )

    no_pair = [F.lit(None).cast("long").alias("pair"), F.lit(None).cast("long").alias("n")]
    part = F.explode(F.sequence(F.lit(0), F.lit(TREE_PARTS - 1))).alias("part")
    copies = tables.select("shard", part, F.lit(0).alias("tag"), "hash", *no_pair)
    lists = partials.select(
        _shard(shards), F.pmod(F.xxhash64("n", "pair"), F.lit(TREE_PARTS)).cast("int").alias("part"), F.lit(1).alias("tag"), F.lit(None).cast("binary").alias("hash"), "pair", "n"
    )
    dealt = copies.unionByName(lists).repartition("shard", "part").sortWithinPartitions("shard", "part", "tag")
    leaves = dealt.mapInArrow(leaf, "shard int, hash binary, counts binary")
    return leaves.repartition("shard").sortWithinPartitions("shard").mapInArrow(root, "shard int, hash binary, counts binary")


def pair_table(counted: DataFrame) -> DataFrame:
    """(a, b, count): how many documents link token a of A with token b of B, from the dense vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = PerfectHash.from_bytes(data).keys
                columns = [keys >> 16, keys & 0xFFFF, np.frombuffer(counts, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["a", "b", "count"])

    return counted.select("hash", "counts").mapInArrow(run, "a int, b int, count long")


def counted_pairs(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, int, int]:
    """The first pass over (key, text) rows: shards with hash and counts, their number, all (document, pair) there are."""
    partials = stored(partial_counts(docs, path_a, path_b), "partial-counts")
    pairs = stored(partials.select("pair").distinct(), "pairs")
    shards = max(1, -(-pairs.count() // SHARD_PAIRS))
    tables = stored(hash_tables(pairs, shards), "hashes")
    return stored(dense_counts(partials, tables, shards), "counts"), shards, partials.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


# Second pass --------------------------------------------------------------------------


FACTS = ["n_a", "n_b", "n_groups", "n_links"]


def _messages(key_type: T.DataType) -> T.StructType:
    """One schema for all that travels: tables, links of a batch in a shard, facts of a document, sums of a batch."""
    return T.StructType(
        [T.StructField(n, T.IntegerType()) for n in ("shard", "part", "tag")]
        + [T.StructField("batch", T.LongType())]
        + [T.StructField(f"d{k}", T.BinaryType()) for k in range(4)]
        + [T.StructField("doc", T.IntegerType()), T.StructField("key", key_type)]
        + [T.StructField(n, T.LongType()) for n in FACTS]
        + [T.StructField("groups", T.StringType())]
    )


TABLE, LINKS, FACT, SUMS = 0, 1, 2, 3


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Align two tokenizations of every text; one row per document, whatever repeats.

    Gives ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair's count is the
    highest of its A id), ``count_sum`` and ``groups`` (``a1,a2|b1;...``; with ``digest`` its SHA-256, empty
    without tokens). A's texts start with a space, as B's library adds one. Texts that are null, empty
    or not covered byte for byte have zeros; texts are taken whole at any length. Null and
    repeated keys stay, as no step joins by key; other columns are not read; an empty table gives
    no rows. ``docs`` is read twice and must give the same rows again, as a table does:
    within the second pass a lost task's batches are those of its partition again.
    """
    spark, key_type = docs.sparkSession, docs.schema[key].dataType
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    counted, shards, entries = counted_pairs(rows, path_a, path_b)
    highest = pair_table(counted).groupBy("a").agg(F.max("count").alias("most")).collect()  # at most one row per entry of A
    best = np.zeros(VOCABULARY, np.int64)
    for r in highest:
        best[r.a] = r.most
    best_of = spark.sparkContext.broadcast(best)
    parts = max(1, -(-entries * 4 // (shards * TASK_BYTES)))
    schema = _messages(key_type)
    kinds = to_arrow_schema(schema)

    def message(**columns: list) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in kinds], schema=kinds)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for number, (keys, texts) in enumerate(text_batches(batches, BATCH_CHARS)):
            batch, n = base + number, len(keys)
            found = own.aligned(texts)
            groups = found.groups()
            if digest:
                groups = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
            else:
                groups = [g.decode() for g in groups]
            facts = dict(zip(FACTS, found.facts(), strict=True))
            yield message(shard=[batch % shards] * n, part=[batch % parts] * n, tag=[FACT] * n, batch=[batch] * n, doc=list(range(n)), key=keys, groups=groups, **facts)
            pair, doc, times = found.pairs()
            if not len(pair):
                continue
            firsts = np.flatnonzero(np.diff(pair, prepend=-1))
            distinct, sizes = pair[firsts].astype(np.uint32), np.diff(firsts, append=len(pair))
            home = shard_of(distinct, shards)
            of_entry = np.repeat(home, sizes)
            data: list[list] = [[] for _ in range(4)]
            here = np.unique(home).tolist()
            for shard in here:
                mine, entry = home == shard, of_entry == shard
                for column, x in zip(data, (distinct[mine], sizes[mine].astype(np.uint32), doc[entry].astype(np.uint16), times[entry].astype(np.uint32)), strict=True):
                    column.append(x.tobytes())
            m = len(here)
            yield message(shard=here, part=[batch % parts] * m, tag=[LINKS] * m, batch=[batch] * m, d0=data[0], d1=data[1], d2=data[2], d3=data[3])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, counts = None, None, None
        for key_now, run in _runs(batches, 2):
            if key_now is None:
                return
            if key_now != now:
                now, own = key_now, None
            tags = np.asarray(run.column(2))
            if (tags == FACT).any():
                yield run.filter(pa.array(tags == FACT))
            for k in np.flatnonzero(tags != FACT).tolist():
                row = {f"d{i}": run.column(4 + i)[k].as_py() for i in range(4)}
                if tags[k] == TABLE:
                    own, counts = PerfectHash.from_bytes(row["d0"]), np.frombuffer(row["d1"], np.int64)
                    continue
                keys = np.frombuffer(row["d0"], np.uint32)
                slots = own.slots(keys)
                if (slots < 0).any():
                    raise RuntimeError("the second pass met a pair that the first did not")
                count = counts[slots]
                is_best = count == best_of.value[keys >> 16]
                sizes, times = np.frombuffer(row["d1"], np.uint32), np.frombuffer(row["d3"], np.uint32).astype(np.int64)
                docs_here, place = np.unique(np.frombuffer(row["d2"], np.uint16), return_inverse=True)
                sums, wins = np.zeros(len(docs_here), np.int64), np.zeros(len(docs_here), np.int64)
                np.add.at(sums, place, times * np.repeat(count, sizes))
                np.add.at(wins, place, times * np.repeat(is_best, sizes))
                yield message(tag=[SUMS], batch=[run.column(3)[k].as_py()], d0=[docs_here.tobytes()], d1=[sums.tobytes()], d2=[wins.tobytes()])

    out_schema = T.StructType([T.StructField(key, key_type), *[T.StructField(n, T.LongType()) for n in [*FACTS, "n_best", "count_sum"]], T.StructField("groups", T.StringType())])
    out_kinds = to_arrow_schema(out_schema)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, facts, sums, wins = None, [], None, None

        def rows_of() -> pa.RecordBatch:
            known = pa.Table.from_batches(facts).combine_chunks().to_batches()[0]
            at = np.asarray(known.column(known.schema.get_field_index("doc")))
            columns = [known.column(known.schema.get_field_index(n)) for n in ["key", *FACTS]]
            columns += [pa.array(wins[at]), pa.array(sums[at]), known.column(known.schema.get_field_index("groups"))]
            return pa.RecordBatch.from_arrays(columns, schema=out_kinds)

        for key_now, run in _runs(batches, 1):
            if key_now != now:
                if now is not None:
                    yield rows_of()
                now, facts, sums, wins = key_now, [], np.zeros(1001, np.int64), np.zeros(1001, np.int64)
            if key_now is None:
                return
            tags = np.asarray(run.column(run.schema.get_field_index("tag")))
            if (tags == FACT).any():
                facts.append(run.filter(pa.array(tags == FACT)))
            for k in np.flatnonzero(tags == SUMS).tolist():
                ids, more, won = (np.frombuffer(run.column(run.schema.get_field_index(f"d{i}"))[k].as_py(), t) for i, t in enumerate((np.uint16, np.int64, np.int64)))
                sums[ids] += more
                wins[ids] += won

    copies = counted.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(TABLE).alias("tag"), F.col("hash").alias("d0"), F.col("counts").alias("d1"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in ("shard", "part", "tag", "d0", "d1")],
    ).select(*schema.names)
    sent = rows.mapInArrow(send, schema).unionByName(copies)
    looked = sent.repartition("shard", "part").sortWithinPartitions("shard", "part", "tag").mapInArrow(look_up, schema)
    answers = looked.select("batch", "tag", "d0", "d1", "d2", "doc", "key", *FACTS, "groups").repartition("batch").sortWithinPartitions("batch")
    return answers.mapInArrow(gather, out_schema)


PATH_A, PATH_B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@register("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(table(spark, sf_dir, "documents"), PATH_A, PATH_B, digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")
