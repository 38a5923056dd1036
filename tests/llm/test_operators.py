import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlens.llm.byte_bpe import RANKS, codec, merged, read_ranks, token_digests
from marketlens.llm.embeddings import near_duplicates
from marketlens.llm.mixing import mix
from marketlens.llm.quality import LEAST, judge, measure, repeated_words, thresholds
from marketlens.llm.sharding import shard_by_bytes
from marketlens.llm.simhash import fingerprints, grouped, one_of_each, signed, simhash
from marketlens.llm.substrings import remove_repeats
from marketlens.llm.token_counts import tokenizer, whole_tokens

ALPHABET = "aA bB\n\t'sSΣσİ ßéﬀ0٣½ 日本😀$$##<|endoftext|> 'll 've"
TEXTS = [None, "", "  ", "a" * 3000, "one two three " * 40, "x\n\ny   z \n"]
SCHEMA = "doc_id long, text string, lang string, source string, size int"


def texts(n, seed=1):
    rng = random.Random(seed)
    return TEXTS + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)]


def rows(n):
    out = [(k, t, "en" if k % 2 else None, f"s{k % 4}" if k % 5 else None, 7) for k, t in enumerate(texts(n))]
    return out + [out[3], (None, "a b c", None, None, 7)]


def test_byte_bpe():
    ranks = read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text, ids in zip(texts(2000), codec(RANKS).encode_batch(texts(2000))):
        assert ids == library.encode_ordinary(text or "")
        assert codec(RANKS).decode(ids) == (text or "").encode()
    assert merged(b"a" * 500, ranks) == library.encode_ordinary("a" * 500)


def test_token_counts():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    found = tokenizer(path).counts(texts(2000), whole_tokens(path))
    assert found == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts(2000)]


def test_digests_of_odd_rows(spark):
    found = token_digests(spark.createDataFrame(rows(20), SCHEMA), RANKS).collect()
    assert len(found) == len(rows(20))
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, empty, empty) for r in found if r.doc_id in (0, 1))


def test_shards(spark):
    docs = rows(200)
    found = sorted(shard_by_bytes(spark.createDataFrame(docs, SCHEMA), 16).collect(), key=lambda r: r.first_byte)
    total = sum(len((d[1] or "").encode()) + 1 for d in docs)
    assert sum(r["size"] for r in found) == total and len(found) == len(docs)
    at, slots = 0, {}
    for r in found:
        assert r.first_byte == at and r.shard == min(15, (2 * at + r["size"]) * 16 // (2 * total))
        assert r.slot == slots.get(r.shard, 0)
        slots[r.shard], at = r.slot + 1, at + r["size"]
    assert shard_by_bytes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_mixing(spark):
    rng = random.Random(4)
    docs = [(k, "w " * rng.randrange(1, 200), "en", f"s{k % 7}", 1) for k in range(700)] + rows(5)
    frame = spark.createDataFrame(docs, SCHEMA)
    found = mix(frame).collect()
    assert len(found) == len(docs) and all(r.taken <= 2 * r["size"] for r in found)
    for source in {r.source for r in found}:
        own = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, mix(frame).collect())) == sorted(map(key, found))


def test_mixing_targets_and_repeated_rows(spark):
    """Sizes, targets and resharing worked out plainly; equal rows come near the target, not all or nothing."""
    docs = [(1, "w " * 10, "a")] * 100 + [(k, "w " * (k % 9), "b") for k in range(300)] + [(k, "w x " * 50, None) for k in range(3)] + [(9, None, "c")]
    frame = spark.createDataFrame([(*d, 1, 2, 3, 4) for d in docs], "doc_id long, text string, source string, whole int, extra int, __one int, __size int")
    found = mix(frame).collect()
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    open_, target, left = set(order), {}, 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not above:
            break
        for s in above:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= above
    target |= {s: weight[s] * level for s in open_}
    assert len(found) == len(docs) and all(r.taken == r["size"] * r.copies <= 2 * r["size"] for r in found)
    for s in order:
        own = [r for r in found if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max(r["size"] for r in own)
    assert mix(frame.limit(0)).collect() == [] and [c for c in mix(frame).columns if c in frame.columns] == frame.columns


def test_quality(spark):
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randrange(40))]
        at = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        assert repeated_words(words) == len({k for i, w in enumerate(at) if at.count(w) > 1 for k in range(i, i + 8)})
    found = {r.doc_id: r for r in judge(spark.createDataFrame(rows(20), SCHEMA)).collect()}
    assert found[0].n_words == 0 and found[0].base_failed and not found[0].kept


def test_fences_by_group_size(spark):
    """A source of LEAST documents has fences of its own, one with a document less takes its language's."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = lambda k, n: " ".join((letters[i] + letters[k % 26] + letters[k // 26] + "x" * n)[:n] for i in range(26))
    docs = [(k, text(k, 3), "en", "a") for k in range(LEAST)] + [(500 + k, text(k, 9), "en", "b") for k in range(LEAST - 1)]
    rows = measure(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"))
    high = {r.source: r.word_length_high for r in thresholds(rows).collect()}
    assert high["a"] < 5 and high["b"] > 30
    everyone = thresholds(rows.withColumn("source", F.lit("all"))).first().word_length_high
    assert high["b"] == everyone


def test_repeats(spark):
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(70)]
    docs = []
    for k in range(40):
        words = [rng.choice("abc") + str(rng.randrange(30)) for _ in range(rng.randrange(90))]
        cut = rng.randrange(12)
        docs.append((k, " ".join(words + passage[cut:] + words[:9]) if k % 3 else " ".join(words)))
    docs += [(50, None), (51, ""), (52, docs[1][1]), (52, docs[1][1])]
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    first = {}
    for d, t in docs:
        words = (t or "").split()
        at = [tuple(words[i : i + 50]) for i in range(len(words) - 49)]
        gone = {k for i, w in enumerate(at) if first.get(w, d) < d for k in range(i, i + 50)}
        for w in at:
            first.setdefault(w, d)
        assert found[d] == (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))


def test_simhash(spark):
    rng = random.Random(7)
    values = [rng.getrandbits(64) for _ in range(30)]
    values += [v ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for v in values * 4]
    prints = spark.createDataFrame([(k, signed(v)) for k, v in enumerate(values)], "doc_id long, fingerprint long")
    group = list(range(len(values)))
    for _ in values:
        before = list(group)
        for i, x in enumerate(values):
            for j in range(i):
                if (x ^ values[j]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
        if before == group:
            break
    assert {r.doc_id: r.component_id for r in grouped(prints).collect()} == dict(enumerate(group))
    docs = spark.createDataFrame(rows(10), SCHEMA)
    assert {r.doc_id: r.fingerprint for r in fingerprints(docs).collect()}[0] == 0 == simhash(None)
    assert one_of_each(docs).count() == grouped(fingerprints(docs)).select("component_id").distinct().count()


def test_one_of_each_by_component(spark):
    """Unrelated texts stay also where their ids are null or equal; copies under such ids still go."""
    rng = random.Random(9)
    words = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(60)) for _ in range(5)]
    docs = [(None, words[0]), (None, words[1]), (7, words[2]), (7, words[3]), (8, words[4]), (9, words[4]), (None, words[4]), (None, words[0])]
    kept = one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(kept, key=str) == sorted([(None, words[0]), (None, words[1]), (7, words[2]), (7, words[3]), (8, words[4])], key=str)


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 16))
    x = np.concatenate([x, x + 0.1 * rng.standard_normal(x.shape), x[:5]])
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15]
    data = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, v) for k, v in enumerate(odd)]
    found = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(1) - 1
    got = np.array([found[k].n_links for k in range(len(x))])
    assert (got <= links).all() and got.sum() >= 0.9 * links.sum()
    assert all(found[1000 + k].n_links == 0 and found[1000 + k].kept for k in range(len(odd)))
