"""Token counts with a whole-token shortcut: vocabulary strings proved to be one token are counted directly."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import map_column, register, table
from marketlens.llm.merge_tree import WIDEST, PairRanks, merge_many

#: Chunks remembered by a worker; beyond it the memory is emptied.
MEMORY = 400_000
LONGEST = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes are themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = (b for b in range(256) if b not in plain)
    letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
    return [letters[b] for b in range(256)]


LETTERS = byte_letters()

# Capitals whose small letters this Python's Unicode tables may not know yet.
NEW_CAPITALS = {0xA7CB: "\u0264", 0xA7DC: "\u019b"}


class WordBpe:
    """Counts tokens as a vocabulary file of lower-cased words with an end-of-word mark does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.vocabulary = model["vocab"]
        self.mark = model["end_of_word_suffix"]
        self.rank = {tuple(m): k for k, m in enumerate(model["merges"])}
        special = sorted((t["content"] for t in data["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.split = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        ids = self.vocabulary
        self.inner = np.array([ids[c] for c in LETTERS], np.int32)
        self.last = np.array([ids[c + self.mark] for c in LETTERS], np.int32)
        made = np.array([ids[a + b] for a, b in self.rank], np.int32)
        self.table = PairRanks({(ids[a], ids[b]): k for (a, b), k in self.rank.items()}, made)
        self.memory: dict[str, int] = {}

    def letters(self, word: str) -> str:
        return "".join([LETTERS[b] for b in word.encode()])

    def merged(self, letters: str) -> list[str]:
        """The tokens of one pre-token in byte letters."""
        parts = list(letters)
        parts[-1] += self.mark
        rank = self.rank
        if len(parts) > LONGEST:
            return self._merged_by_heap(parts)
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: rank.get(p, 1 << 30))
            if best not in rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _merged_by_heap(self, parts: list[str]) -> list[str]:
        """The same for long runs: pairs wait in a heap by rank and place, neighbours are linked."""
        n, rank = len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p) for i, p in enumerate(zip(parts, parts[1:])) if (r := rank.get(p)) is not None]
        heapify(heap)
        while heap:
            _, i, (left, right) = heappop(heap)
            j = after[i] if parts[i] == left else n
            if j >= n or parts[j] != right:
                continue  # one of the two has merged with another
            parts[i], parts[j] = left + right, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    pair = parts[k], parts[after[k]]
                    if (r := rank.get(pair)) is not None:
                        heappush(heap, (r, k, pair))
        return [p for p in parts if p]

    def normal(self, text: str) -> str:
        """Composed and lower-cased letter by letter; white space only separates pre-tokens."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text).translate(NEW_CAPITALS)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def chunks(self, text: str | None) -> tuple[int, list[str]]:
        """How many special strings the text holds, and what stands between them, cut at spaces.

        No pre-token holds white space, so a cut at a space never parts one.
        """
        if not text:
            return 0, []
        if "<|" not in text:
            return 0, self.normal(text).split(" ")
        pieces = self.special.split(text)
        return len(pieces) - 1, [c for p in pieces for c in self.normal(p).split(" ")]

    def merged_counts(self, words: Iterable[str]) -> dict[str, int]:
        """Numbers of tokens of distinct pre-tokens, short ones merged in one batch."""
        out: dict[str, int] = {}
        short: list[str] = []
        pieces: list[bytes] = []
        for word in words:
            encoded = word.encode()
            if len(encoded) > WIDEST:
                out[word] = len(self.merged(self.letters(word)))
            else:
                short.append(word)
                pieces.append(encoded)
        if short:
            lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
            data = np.frombuffer(b"".join(pieces), np.uint8)
            ids, ends = self.inner[data], np.cumsum(lengths) - 1
            ids[ends] = self.last[data[ends]]
            out.update(zip(short, merge_many(ids, lengths, self.table)[1].tolist()))
        return out

    def counts(self, texts: list[str | None], whole: frozenset[str]) -> list[int]:
        """Tokens of each text: one for a pre-token in ``whole``, merged ones for the rest.

        Chunks new in the batch are counted at once; short ones are remembered, up to MEMORY.
        """
        cut = [self.chunks(t) for t in texts]
        new = {c for _, chunks in cut for c in chunks if c not in self.memory}
        if len(self.memory) + len(new) > MEMORY:
            self.memory.clear()
            new = {c for _, chunks in cut for c in chunks}
        split = {c: [c] if c in whole else self.split(c) for c in new}
        rest = self.merged_counts({w for words in split.values() for w in words if w not in whole})
        self.memory.update({c: sum([rest.get(w, 1) for w in words]) for c, words in split.items()})
        out = [special + sum(map(self.memory.__getitem__, chunks)) for special, chunks in cut]
        for c in new:
            if len(c) > LONGEST:
                del self.memory[c]
        return out


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """The pre-tokens that the merges turn into one token, each proved by running its merges.

    Being in the vocabulary is no proof: a string may have an entry that its own merges
    never reach. At most one entry per vocabulary string, so the set is bounded by the file.
    """
    bpe, byte_of, found = tokenizer(path), {c: b for b, c in enumerate(LETTERS)}, []
    for token in bpe.vocabulary:
        if token.endswith(bpe.mark) and (letters := token[: -len(bpe.mark)]) and bpe.merged(letters) == [token]:
            try:
                word = bytes(byte_of[c] for c in letters).decode()
            except UnicodeDecodeError:
                continue  # part of a character: no pre-token of its own
            if bpe.split(bpe.normal(word)) == [word]:
                found.append(word)
    return frozenset(found)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """Replace the text by ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Texts are taken whole; null counts as empty. Special strings inside a text are one token
    each. Pre-tokens in the proved set count one without merging; only the rest is merged.
    """
    proved = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary

    def make():
        def run(values):
            counts = tokenizer(path).counts(values, proved.value)
            return [[len(v.encode()) if v else 0 for v in values], counts, [n > limit for n in counts]]

        return run

    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return map_column(docs, text, new, make)


@register("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)
