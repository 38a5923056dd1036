"""Quality rules and repeated passages against plain versions; odd rows, empty tables and clashing names."""

import random
import re
from collections import Counter

from oracle import connect

from marketlens.llm.quality import SIGNALS, judge, op3_quality_rules
from marketlens.llm.substrings import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of one text."""
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    runs = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    seen = Counter(runs)
    repeated = {k + i for k, r in enumerate(runs) if seen[r] > 1 for i in range(8)}
    facts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
    return (*facts, len(words) < 20 or 100 * len(repeated) > 30 * len(words))


def odd_rows(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "a\n\na\na \n", "# $ % & | < >", "é ü\x0bß\x0cx", "w " * 5000, "one two three four five six seven eight " * 3]
    texts += ["".join(rng.choice(["ab ", "b\n", "c#", "dd ", "ab b dd ab b dd ab b dd ", "\n"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(k if k % 9 else None, t, rng.choice(["en", None]), rng.choice(["s", None, "t"])) for k, t in enumerate(texts)]
    return rows + rows[:3]


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_columns_of_odd_rows(spark):
    rows = odd_rows(1)
    found = judge(spark.createDataFrame([(*r, r[1]) for r in rows], SCHEMA + ", copy string")).collect()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted([(r.doc_id, r.copy, *(r[c] for c in COLUMNS)) for r in found], key=key) == sorted([(r[0], r[1], *base(r[1])) for r in rows], key=key)
    assert not any(r.kept for r in found if r.base_failed)


def test_base_columns_of_the_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = dict(connect(sf_dir).execute("SELECT doc_id, text FROM documents").fetchall())
    found = op3_quality_rules(spark, sf_dir).collect()
    assert len(found) == len(texts) and all(tuple(r[c] for c in COLUMNS) == base(texts[r.doc_id]) for r in found)


def test_names_that_clash(spark):
    names = ["__lang", "__source", *[f"{s}_{e}" for s in SIGNALS for e in ("low", "high")]]
    extra = ", ".join(f"{n} int" for n in names)
    docs = spark.createDataFrame([(k, "word " * 30, "en", "s", *range(len(names))) for k in range(4)], f"{SCHEMA}, {extra}")
    assert all(r["word_length_high"] == names.index("word_length_high") for r in judge(docs).collect())
    passage = " ".join(f"p{k}" for k in range(60))
    docs = spark.createDataFrame([(k, passage, 7, 8, "x", 9, 10) for k in range(3)], "doc_id long, text string, doc int, mark int, __text string, __parts int, __p_doc int")
    found = sorted((r.doc_id, r.n_removed, r.doc, r.mark, r["__text"], r["__p_doc"]) for r in remove_repeats(docs).collect())
    assert found == [(0, 0, 7, 8, "x", 10), (1, 60, 7, 8, "x", 10), (2, 60, 7, 8, "x", 10)]


def test_empty_tables(spark):
    assert judge(spark.createDataFrame([], SCHEMA)).collect() == []
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
