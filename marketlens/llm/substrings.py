"""Repeated passages: FM-indexes over shards of passages that may repeat, searched backwards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import free, register, table
from marketlens.llm.simhash import runs
from marketlens.session import stored

WINDOW = 50
#: Words of an anchor: each window is dealt by the least hash of its 25-word runs.
ANCHOR = 25
#: Words in one index, passages of one anchor beyond which windows are compared by digest instead.
SHARD_WORDS = 400_000
HOT_ANCHOR = 4_000
#: Words of a document that are anchored in one piece.
PIECE = 4_000_000
LAST = 2**63 - 1

_hash = xxhash.xxh64_intdigest
# Odd multipliers of the rolling hashes.
BASE_ONE, BASE_TWO, MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Digests of any run of words by prefix sums of hash * base ** place, modulo 2 ** 64."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums, self.back = [], []
        for base in (BASE_ONE, BASE_TWO):
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(base, n), dtype=np.uint64)]))
            self.back.append(_powers(pow(base, -1, 1 << 64), n + 1))

    def digest(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        return (self.sums[which][end] - self.sums[which][start]) * self.back[which][start]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(_hash, words)), np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


def anchored(texts: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Passages of the texts: runs of windows with the same anchor.

    Gives the number of the text, the anchor's hash, the first word, the number of words, and
    two digests of the words. Equal windows have equal anchors, whatever stands around them.
    """
    words: list[bytes] = []
    bounds: list[tuple[int, int, int]] = []  # text, first word of the piece, place in the array
    sizes = []
    for k, text in enumerate(texts):
        own = text.split()
        for at in range(0, max(1, len(own) - window + 1), PIECE):
            piece = own[at : at + PIECE + window - 1]
            if len(piece) >= window:
                bounds.append((k, at, len(words)))
                sizes.append(len(piece))
                words += piece
    empty = tuple(np.zeros(0, np.int64) for _ in range(6))
    if not bounds:
        return empty
    hashes = word_hashes(words)
    n = len(words)
    rolling = Rolling(hashes)
    at = np.arange(n - anchor + 1)
    grams = mixed(rolling.digest(at, at + anchor, 0))
    # The least gram of each window, the leftmost of equals: the place stands in the low bits.
    keyed = (grams & np.uint64(~((1 << 24) - 1) & (2**64 - 1))) | (at & ((1 << 24) - 1)).astype(np.uint64)
    span, least, have = window - anchor + 1, keyed, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    starts_of = np.array([b[2] for b in bounds])
    lengths = np.array(sizes)
    counts = lengths - window + 1
    starts = np.repeat(starts_of - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    piece = np.repeat(np.arange(len(bounds)), counts)
    chosen = least[starts]
    place = starts + ((chosen & np.uint64((1 << 24) - 1)).astype(np.int64) - starts) % (1 << 24)
    change = np.flatnonzero((place[1:] != place[:-1]) | (piece[1:] != piece[:-1])) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change, [len(starts)]]) - 1
    lo, hi = starts[first], starts[last] + window
    owner = piece[first]
    text_of, offset = np.array([b[0] for b in bounds]), np.array([b[1] - b[2] for b in bounds])
    return text_of[owner], grams[place[first]].view(np.int64), lo + offset[owner], hi - lo, rolling.digest(lo, hi, 0).view(np.int64), rolling.digest(lo, hi, 1).view(np.int64)


class FmIndex:
    """FM-index over sequences of word numbers: a wavelet matrix of the Burrows-Wheeler transform.

    Suffixes are sorted by their first words only, as many as a window needs; ``low`` and ``high``
    give, for each row, the rows whose suffixes share its whole window.
    """

    def __init__(self, sequences: list[np.ndarray], alphabet: int, window: int):
        """``sequences`` hold numbers from 1 to ``alphabet``; 0 ends each of them."""
        self.window = window
        text = np.concatenate([x for s in sequences for x in (s, np.zeros(1, np.int64))])
        self.starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in sequences])])
        n = len(text)
        self.size = n
        rank, k = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        window_rank = None
        while True:
            if window_rank is None and 2 * k > window:
                # ranks by the first k words, k <= window < 2k: two overlapping halves make a window's rank
                shifted = np.concatenate([rank[window - k :], np.full(window - k, -1)]) + 1
                window_rank = np.unique(rank * (n + 2) + shifted, return_inverse=True)[1]
            if k > window:
                break
            shifted = np.concatenate([rank[k:], np.full(min(k, n), -1)])[:n] + 1
            rank = np.unique(rank * (n + 2) + shifted, return_inverse=True)[1].astype(np.int64)
            k *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        group = window_rank[self.suffixes]
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        self.group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)]))
        self.low, self.high = edge, np.append(edge[1:], n)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))])
        self._wavelet(text[self.suffixes - 1], alphabet)

    def _wavelet(self, symbols: np.ndarray, alphabet: int) -> None:
        self.levels = []
        for bit in range(max(1, int(alphabet).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            padded = np.zeros(-(-(len(ones) + 1) // 64) * 64, np.uint8)
            padded[: len(ones)] = ones
            blocks = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(blocks), dtype=np.int64)])
            self.levels.append((bit, blocks, counts, len(ones) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        all_symbols = np.arange(alphabet + 1)
        self.origin = np.zeros(alphabet + 1, np.int64)
        self.origin = self._descend(all_symbols, np.zeros(alphabet + 1, np.int64))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for bit, blocks, counts, zeros in self.levels:
            block = place >> 6
            below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[block] + np.bitwise_count(blocks[block] & below)
            place = np.where(symbol >> bit & 1, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place in the transform."""
        return self._descend(symbol, place) - self.origin[symbol]

    def matches(self, sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All windows of the sequences that the index holds: (sequence, first word, row group).

        Every sequence is read from its end, all of them side by side, one backward step at a time; a
        match is cut to the window's length by widening it to the rows that share that window.
        A match that ends gives way to one that ends a word earlier than its last word, since
        no window can hold the whole of what failed.
        """
        lengths = np.array([len(s) for s in sequences])
        offsets = np.cumsum(lengths) - lengths
        words = np.concatenate([*sequences, np.zeros(1, np.int64)])
        who = np.flatnonzero(lengths >= self.window)
        at = lengths[who] - 1
        length = np.zeros(len(who), np.int64)
        lo, hi = np.zeros(len(who), np.int64), np.full(len(who), self.size)
        while len(who):
            symbol = words[offsets[who] + at]
            known = (symbol > 0) & (symbol < len(self.origin))
            safe = np.where(known, symbol, 0)
            new_lo = self.before[safe] + self.rank(safe, lo)
            new_hi = self.before[safe] + self.rank(safe, hi)
            fits = known & (new_lo < new_hi)
            at_fail = np.where(length > 0, at + length - 1, at - 1)
            lo = np.where(fits, new_lo, 0)
            hi = np.where(fits, new_hi, self.size)
            length = np.where(fits, length + 1, 0)
            long = length > self.window
            group = self.group[np.minimum(lo, self.size - 1)]
            lo, hi = np.where(long, self.low[group], lo), np.where(long, self.high[group], hi)
            length = np.minimum(length, self.window)
            full = length == self.window
            if full.any():
                yield who[full], at[full], group[full]
            at = np.where(fits, at - 1, at_fail)
            goes = (at >= 0) & (at + 1 + length >= self.window)  # a window still fits before the match's end
            who, at, length, lo, hi = who[goes], at[goes], length[goes], lo[goes], hi[goes]


def covered_in_shard(owners: np.ndarray, sequences: list[np.ndarray], alphabet: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, first word) of every window that also starts in a sequence of a smaller owner."""
    index = FmIndex(sequences, alphabet, window)
    sequence_of = np.searchsorted(index.starts, index.suffixes, side="right") - 1
    smallest = np.minimum.reduceat(owners[sequence_of], index.low)
    found = [(s[m], a[m]) for s, a, g in index.matches(sequences) if (m := smallest[g] < owners[s]).any()]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _passages(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
        part, size = [], 0
        for k in range(len(texts)):
            part.append(k)
            size += len(texts[k])
            if size > 8_000_000 or k == len(texts) - 1:
                text, *rest = anchored([texts[p] for p in part], window, anchor)
                rows = pa.array(np.array(part)[text] if len(text) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, rest)],
                    names=["doc", "mark", "anchor", "first", "n", "one", "two"],
                )
                part, size = [], 0


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From passages sorted by (anchor, one, two, doc): what is wholly covered, and what an index must decide.

    A passage that an earlier document holds word for word is covered. Of the passages of an
    anchor, those of the first document with these words go on, if the anchor has others
    than these words. Nothing but the row before, and an anchor's first passage, is kept.
    """
    schema = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("mark", pa.int64()), ("anchor", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])
    key = words = least = None
    waiting: list[tuple] = []
    others = False
    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("doc", "mark", "anchor", "first", "n", "one", "two")]
        for doc, mark, anchor, first, n, one, two in zip(*columns):
            if anchor != key:
                key, words, least, waiting, others = anchor, (one, two, n), doc, [], False
            elif (one, two, n) != words:
                words, least = (one, two, n), doc
                if not others:
                    others = True
                    out += waiting
                    waiting = []
            if doc > least:
                out.append((0, doc, mark, anchor, first, n))
            elif others:
                out.append((1, doc, mark, anchor, first, n))
            else:
                waiting.append((1, doc, mark, anchor, first, n))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the passages of each document."""
    for batch in batches:
        out: list[tuple] = []
        for doc, mark, text, parts in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text", "parts"))):
            words = text.encode().split()
            out += [(doc, mark, p["anchor"], p["first"], b" ".join(words[p["first"] : p["first"] + p["n"]]).decode()) for p in parts]
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, type=pa.int64()) for c in columns[:4]), pa.array(columns[4])], names=["doc", "mark", "anchor", "first", "words"]
            )


SPANS = "doc long, mark long, first long, n long"


def _spans(doc: np.ndarray, mark: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (doc, mark, first, n)], names=["doc", "mark", "first", "n"])


def _indexed(batches: Iterator[pa.RecordBatch], window: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    """Build an index for as many whole anchors as fit a shard and stream the shard's passages through it."""
    doc: list[int] = []
    mark: list[int] = []
    first: list[int] = []
    texts: list[list[str]] = []
    size = 0

    def search() -> pa.RecordBatch:
        number: dict[str, int] = {}
        sequences = [np.array([number.setdefault(w, len(number) + 1) for w in t], np.int64) for t in texts]
        order = np.unique(np.array(doc), return_inverse=True)[1]
        who, at = covered_in_shard(order, sequences, len(number), window)
        return _spans(np.array(doc, np.int64)[who], np.array(mark, np.int64)[who], np.array(first, np.int64)[who] + at, np.full(len(who), window))

    for run in runs(batches, ["anchor"]):
        doc += run.column("doc").to_pylist()
        mark += run.column("mark").to_pylist()
        first += run.column("first").to_pylist()
        own = [w.split(" ") for w in run.column("words").to_pylist()]
        texts += own
        size += sum(map(len, own))
        if size >= shard_words:
            yield search()
            doc, mark, first, texts, size = [], [], [], [], 0
    if texts:
        yield search()


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Two digests of every window of the passages."""
    for batch in batches:
        rows, firsts, ones, twos = [], [], [], []
        for k, (first, words) in enumerate(zip(batch.column("first").to_pylist(), batch.column("words").to_pylist())):
            rolling = Rolling(word_hashes(words.encode().split(b" ")))
            at = np.arange(len(rolling.sums[0]) - window)
            rows.append(np.full(len(at), k))
            firsts.append(first + at)
            ones.append(rolling.digest(at, at + window, 0).view(np.int64))
            twos.append(rolling.digest(at, at + window, 1).view(np.int64))
        if rows:
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(take), batch.column("mark").take(take), *(pa.array(np.concatenate(x)) for x in (firsts, ones, twos))],
                names=["doc", "mark", "first", "one", "two"],
            )


def _kept(batches: Iterator[pa.RecordBatch], names: list[str], text_column: str, parts_column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words_of, removed, spans, kept = [], [], [], []
        for text, parts in zip(batch.column(text_column).to_pylist(), batch.column(parts_column).to_pylist()):
            words = text.encode().split() if text else []
            own, last = [], 0
            for a, b in sorted((p["first"], p["first"] + p["n"]) for p in parts or []):
                if own and a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
            rest: list[bytes] = []
            for a, b in own:
                rest += words[last:a]
                last = b
            rest += words[last:]
            words_of.append(len(words))
            removed.append(len(words) - len(rest))
            spans.append([{"first": a, "end": b} for a, b in own])
            kept.append(b" ".join(rest).decode())
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(words_of, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())],
            names=[*names, "n_words", "n_removed", "spans", "kept_text"],
        )


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Replace the text by ``n_words``, ``n_removed``, ``spans`` (word places removed) and ``kept_text``.

    A word goes if a window of ``window`` words around it also starts in a document with a smaller
    key; windows are judged on the input. A null text has no words; a null key stands after
    all others; rows that share a key are no earlier than each other. Windows are dealt by
    the least hash of their ``anchor``-word runs, so equal windows meet in one shard. Passages that
    repeat word for word are settled there by digest; an FM-index over each shard's distinct passages
    decides the rest by backward search. An anchor with more than HOT_ANCHOR distinct passages is
    too large for one index: its windows are grouped by 128-bit digest, which splits freely.
    Input columns with a new column's name give way, others may have any name; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in (text, "n_words", "n_removed", "spans", "kept_text")]
    marked = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("mark"), F.col(f"`{text}`").alias("text")
    )
    passages = marked.mapInArrow(
        lambda b: _passages(b, window, anchor), "doc long, mark long, anchor long, first long, n long, one long, two long"
    )
    by_anchor = passages.repartition("anchor").sortWithinPartitions("anchor", "one", "two", "n", "doc")
    sorted_out = stored(by_anchor.mapInArrow(_sorted_out, "kind int, doc long, mark long, anchor long, first long, n long"), "passages")
    covered = sorted_out.filter("kind = 0").select("doc", "mark", "first", "n")
    undecided = sorted_out.filter("kind = 1").groupBy("doc", "mark").agg(F.collect_set(F.struct("anchor", "first", "n")).alias("parts"))
    cut = marked.join(undecided, ["doc", "mark"]).mapInArrow(_cut, "doc long, mark long, anchor long, first long, words string")
    cut = stored(cut, "undecided")
    hot = cut.groupBy("anchor").agg(F.count("*").alias("c")).filter(F.col("c") > HOT_ANCHOR).select("anchor")
    hot = stored(hot, "hot")
    plain = cut.join(hot, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "doc", "first")
    indexed = plain.mapInArrow(lambda b: _indexed(b, window, SHARD_WORDS), SPANS)
    windows = cut.join(hot, "anchor", "left_semi").mapInArrow(lambda b: _windows(b, window), "doc long, mark long, first long, one long, two long")
    least = windows.groupBy("one", "two").agg(F.min("doc").alias("least"))
    digested = windows.join(least, ["one", "two"]).filter("doc > least").select("doc", "mark", "first", F.lit(window).cast("long").alias("n"))
    parts = covered.union(indexed).union(digested).groupBy("doc", "mark").agg(F.collect_set(F.struct("first", "n")).alias("__parts"))
    own, of, mark, found = free(docs, "__text", "__doc", "__mark", "__parts")
    whole = docs.select(
        *[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(own), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias(of), F.xxhash64(F.col(f"`{text}`")).alias(mark)
    )
    told = parts.select(F.col("doc").alias("__p_doc"), F.col("mark").alias("__p_mark"), F.col("__parts").alias(found))
    told = told.withColumnsRenamed(dict(zip(("__p_doc", "__p_mark"), free(whole, "__p_doc", "__p_mark"))))
    p_doc, p_mark = told.columns[:2]
    joined = whole.join(told, (F.col(of) == F.col(p_doc)) & (F.col(mark) == F.col(p_mark)), "left").drop(of, mark, p_doc, p_mark)
    kinds = T.StructType([docs.schema[c] for c in names])
    out = f"{_ddl(kinds)}n_words long, n_removed long, spans array<struct<first long, end long>>, kept_text string".replace("first long, end long", "first: bigint, end: bigint")
    return joined.mapInArrow(lambda b: _kept(b, names, own, found), out)


def _ddl(kinds: T.StructType) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kinds.fields)


@register("op7_substring_dedup")
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
