"""The pipeline end to end on the smallest tables, each stage against a plain version on its own input."""

import hashlib
import importlib.util
from collections import Counter
from itertools import combinations
from pathlib import Path

import pytest
import tiktoken
import public_tokenizers

from marketlens.llm.byte_bpe import RANKS, read_ranks
from marketlens.llm.lines import MIN_CHARS

SF_DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent.parent


@pytest.fixture(scope="module")
def pipeline():
    spec = importlib.util.spec_from_file_location("corpus_pipeline", ROOT / "corpus_pipeline.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def stages(spark, pipeline, tmp_path_factory):
    """Every stage's rows, each stage reading what the one before wrote."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out, folder = [docs.collect()], tmp_path_factory.mktemp("stages")
    for name, stage in pipeline.STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_stages_in_order(pipeline, stages):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dup", "mixing", "byte_bpe"]
    columns = stages[0][0].__fields__
    assert all(rows[0].__fields__ == columns for rows in stages[1:5])


def test_toxicity_only_removes_rows(stages):
    before, after = Counter(map(tuple, stages[0])), Counter(map(tuple, stages[1]))
    assert not after - before and len(after) >= 0.8 * len(before)


def test_line_dedup_keeps_first_lines(stages):
    before, after = ({r.doc_id: r for r in stages[k]} for k in (1, 2))
    assert set(before) == set(after)
    seen = set()
    for doc in sorted(before):
        text, new = before[doc].text, after[doc].text
        assert (text is None) == (new is None) and after[doc].n_chars == len(new or "")
        kept, own = Counter((new or "").split("\n")), set((text or "").split("\n"))
        for line in own:
            if len(line) < MIN_CHARS:
                assert kept[line] == Counter((text or "").split("\n"))[line] or not line
            else:  # once at most, and only where it stands first
                assert kept[line] <= (line not in seen)
        seen |= own
    assert sum(r.n_chars for r in stages[2]) < sum(r.n_chars for r in stages[1])


def test_one_text_of_each_group_stays(stages):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    docs = sorted(stages[2], key=lambda r: r.doc_id)
    sets = {r.doc_id: shingles(r.text) for r in docs}
    group = {r.doc_id: r.doc_id for r in docs}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    links = 0
    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if len(x & y) >= 0.8 * len(x | y):
            links += 1
            i, j = sorted((root(a), root(b)))
            group[j] = i
    heads = {root(i) for i in group}
    kept = {r.doc_id for r in stages[3]}
    assert heads <= kept and len(kept - heads) <= 0.1 * links  # no text is lost, nine links in ten are found


def test_mixing_repeats_whole_rows(stages):
    before, after = Counter(map(tuple, stages[3])), Counter(map(tuple, stages[4]))
    assert set(after) <= set(before) and all(n <= 2 * before[r] for r, n in after.items())
    sizes = [sum(len((r.text or "").split()) for r in stages[k]) for k in (3, 4)]
    assert 1.3 * sizes[0] <= sizes[1] <= 1.5 * sizes[0] + 2000


def test_tokens_of_every_row(stages):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    expected = Counter()
    for r in stages[4]:
        ids = library.encode_ordinary(r.text or "")
        expected[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in stages[5]) == expected


def test_run_gives_the_last_stage(spark, pipeline, stages):
    found = Counter((r.doc_id, r.ids_sha256) for r in pipeline.run(spark, SF_DIR).collect())
    assert found == Counter((r.doc_id, r.ids_sha256) for r in stages[5])


def test_odd_documents_pass_every_stage(spark, pipeline):
    """Nulls in every column, repeated rows, an empty table and a column with a helper's name."""
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (1, "", "en", "s", 0, 2), (None, "a b c", None, None, 5, 3), (2, "x " * 30_000, "de", "s", 60_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __mark int")
    for name, stage in pipeline.STAGES[:-1]:
        now = stage(spark, docs, SF_DIR)
        assert now.columns == docs.columns and 0 < now.count() <= 2 * len(rows), name
        assert stage(spark, docs.limit(0), SF_DIR).collect() == [], name
    assert {r.doc_id for r in pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()} == {None, 1, 2}
