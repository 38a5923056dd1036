"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import map_column, register, table
from marketlens.llm.merge_tree import WIDEST, PairRanks, merge_many

#: Chunks remembered by a worker; beyond it the memory is emptied and filled anew.
MEMORY = 400_000
#: Longer chunks are not remembered.
LONGEST = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with one base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece, merging the leftmost pair of the lowest rank until none has a rank.

    Leaf ``i`` of the tree holds the rank of the pair that starts at byte ``i``, the leaf's
    number added below it, so the root is the leftmost pair of the lowest rank. A merge
    changes three leaves: the merged pair, its left neighbour, and the one that is gone.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 0:
        return []
    width = 1 << max(1, (n - 1).bit_length())
    shift = width.bit_length()
    none = 1 << 62
    end = list(range(1, n + 1))  # where the token that starts here ends
    start = list(range(-1, n))  # start[e + 1] is where the token that ends at e + 1 starts
    tree = [none] * (2 * width)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank << shift | i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = width + i
        if tree[k] == value:
            return
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    def pair(i: int) -> int:
        middle = end[i]
        if middle >= n:
            return none
        rank = ranks.get(piece[i : end[middle]])
        return none if rank is None else rank << shift | i

    mask = (1 << shift) - 1
    while tree[1] < none:
        i = tree[1] & mask
        gone = end[i]
        end[i] = end[gone]
        start[end[i]] = i
        put(gone, none)
        put(i, pair(i))
        if i:
            left = start[i]
            put(left, pair(left))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


#: A space between white space: pieces may reach over it, so such texts are split whole.
REACHES = re.compile(r" (?<=\s )\s").search


class ByteBpe:
    """Encoder and decoder of a rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks = read_ranks(path)
        self.names = {rank: str(rank) for rank in self.ranks.values()}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.by_space = pattern == public_tokenizers.PATTERN
        self.parts: dict[str, tuple[int, str, bytes]] = {}
        ranks = self.ranks
        self.table = PairRanks(
            {
                (ranks[t[:k]], ranks[t[k:]]): rank
                for t, rank in ranks.items()
                for k in range(1, len(t))
                if t[:k] in ranks and t[k:] in ranks
            }
        )
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def pieces(self, pieces: Iterable[str]) -> dict[str, list[int]]:
        """The ids of distinct pieces: whole tokens directly, short pieces in one batch, long ones singly."""
        out: dict[str, list[int]] = {}
        short: list[str] = []
        data: list[bytes] = []
        for piece in pieces:
            encoded = piece.encode()
            whole = self.ranks.get(encoded)
            if whole is not None:
                out[piece] = [whole]
            elif len(encoded) <= WIDEST:
                short.append(piece)
                data.append(encoded)
            else:
                out[piece] = merged(encoded, self.ranks)
        if short:
            lengths = np.fromiter(map(len, data), np.int64, len(data))
            ids, sizes = merge_many(self.byte_ids[np.frombuffer(b"".join(data), np.uint8)], lengths, self.table)
            flat, ends = ids.tolist(), np.cumsum(sizes).tolist()
            out.update(zip(short, map(flat.__getitem__, map(slice, [0, *ends], ends))))
        return out

    def chunks(self, text: str) -> list[str]:
        """The text cut before spaces, so that no piece crosses a cut; the whole text where that can't be said.

        A piece takes at most one space, and only before it. Cutting before every space is
        therefore safe unless the space stands between white space.
        """
        if not self.by_space or "  " in text or text[-1] == " " or REACHES(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *[" " + c for c in rest]]

    def learn(self, chunks: set[str]) -> dict[str, tuple[int, str, bytes]]:
        """Number of ids, the ids as text and the bytes they decode to, for distinct chunks."""
        split = {c: [c] if c.isascii() and c[1:].isalpha() and c[0] == " " else self.split(c) for c in chunks}
        ids = self.pieces({p for pieces in split.values() for p in pieces})
        out, names = {}, self.names
        for chunk, pieces in split.items():
            own = ids[pieces[0]] if len(pieces) == 1 else [i for p in pieces for i in ids[p]]
            out[chunk] = len(own), " ".join([names[i] for i in own]), self.decode(own)
        return out

    def known(self, texts: list[list[str]]) -> Iterator[list[tuple[int, str, bytes]]]:
        """The parts of each text's chunks; what is new in the batch is encoded at once.

        Short chunks are remembered from batch to batch, up to MEMORY of them.
        """
        new = {c for chunks in texts for c in chunks if c not in self.parts}
        if len(self.parts) + len(new) > MEMORY:
            self.parts.clear()
            new = {c for chunks in texts for c in chunks}
        learned = self.learn(new)
        self.parts.update(learned)
        for chunks in texts:
            yield [self.parts[c] for c in chunks]
        for c in learned:
            if len(c) > LONGEST:
                del self.parts[c]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.chunks(t) if t else [] for t in texts]
        return [[int(i) for p in parts for i in p[1].split()] for parts in self.known(cut)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digests(self, texts: list[str | None]) -> list[list]:
        """Numbers of tokens, SHA-256 of the ids as text, SHA-256 of the decoded bytes."""
        counts, ids, decoded = [], [], []
        for parts in self.known([self.chunks(t) if t else [] for t in texts]):
            counts.append(sum([p[0] for p in parts]))
            ids.append(hashlib.sha256(" ".join([p[1] for p in parts if p[0]]).encode()).hexdigest())
            decoded.append(hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest())
        return [counts, ids, decoded]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBpe:
    """One codec for each worker, so that later tasks find what earlier ones learned."""
    return ByteBpe(path, pattern)


def encode_texts(docs: DataFrame, path: str, text: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Add ``ids`` (array of int): the whole text's token ids; a null or empty text has none."""

    def make():
        return lambda values: [codec(path, pattern).encode_batch(values)]

    return map_column(docs, text, [T.StructField("ids", T.ArrayType(T.IntegerType()))], make, drop=False)


def decode_ids(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary): the bytes of the ids; null ids have none."""

    def make():
        return lambda values: [[codec(path).decode(v or []) for v in values]]

    return map_column(docs, ids, [T.StructField("decoded", T.BinaryType())], make, drop=False)


def token_digests(docs: DataFrame, path: str, text: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Replace the text by ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; other columns stay.

    A null text counts as an empty one; texts are taken whole at any length.
    """

    def make():
        return codec(path, pattern).digests

    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_column(docs, text, new, make)


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@register("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents").select("doc_id", F.col("text")), RANKS)
