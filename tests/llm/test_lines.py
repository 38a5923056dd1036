import random

from marketlens.llm.lines import dedup_lines, line_decisions, within_edits


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(text, edits, rng):
    for _ in range(edits):
        k = rng.randrange(len(text) + 1)
        kind = rng.random()
        text = text[:k] + (rng.choice("abcß") if kind < 0.6 else "") + text[k + (kind > 0.3) :]
    return text


def test_banded_distance(spark):
    rng = random.Random(3)
    for edits in (1, 2, 3):
        pairs = []
        for k in range(150):
            a = "".join(rng.choice("abcß") for _ in range(rng.randrange(0, 30)))
            pairs.append((k, k + 1000, a, changed(a, rng.randrange(0, 5), rng)))
        found = within_edits(spark.createDataFrame(pairs, "a long, b long, a_text string, b_text string"), edits)
        assert {r.a for r in found.collect()} == {k for k, _, a, b in pairs if distance(a, b) <= edits}


def test_decisions_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ab cß") for _ in range(rng.randrange(18, 40))).replace("\n", "") for _ in range(12)]
    for edits, most in ((1, 32), (1, 2), (2, 32)):
        docs = [(k, "\n".join(changed(rng.choice(base), rng.randrange(0, 4), rng) for _ in range(4))) for k in range(25)]
        docs += [(100, None), (101, ""), (102, "short\nshort\n\n"), (103, docs[0][1])]
        found = line_decisions(spark.createDataFrame(docs, "doc_id long, text string"), edits, most=most)
        lines = [(d, n, x) for d, t in docs if t is not None for n, x in enumerate(t.split("\n")) if len(x) >= 20]
        texts = sorted({x for _, _, x in lines})
        group = {x: x for x in texts}
        links = [(x, y) for x in texts for y in texts if x < y and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits]
        for _ in texts:
            for x, y in links:
                group[x] = group[y] = min(group[x], group[y])
        stays = {}
        for d, n, x in sorted(lines):
            stays.setdefault(group[x], (d, n))
        assert {(r.doc, r.line_no) for r in found.collect()} == {(d, n) for d, n, x in lines if stays[group[x]] != (d, n)}


def test_shared_halves_are_cut_finer(spark):
    """Many lines that share a half: all links are found, without all their pairs being compared."""
    rng = random.Random(7)
    base = "".join(rng.choice("abcdefgh") for _ in range(40))
    texts = [base, base[:39] + "zzzz", base[:39] + "zzzx"] + [base[:k] + rng.choice("XYZ") + base[k + rng.randrange(2) :] for k in range(22, 40) for _ in range(3)]
    texts = sorted(set(texts + [base[:30] + c + base[30:] for c in "123"] + [base[:25] + c + base[26:] for c in "123456"]))
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    found = {r.doc for r in line_decisions(docs, 1, most=3).collect()}
    group = {x: x for x in texts}
    for _ in texts:
        for x in texts:
            for y in texts:
                if x < y and abs(len(x) - len(y)) <= 1 and distance(x, y) <= 1:
                    group[x] = group[y] = min(group[x], group[y])
    assert found == {k for k, x in enumerate(texts) if group[x] != x}


def test_text_keeps_other_lines_and_columns(spark):
    line = "a line of more than twenty letters"
    docs = [(1, f"head\n{line}\n\ntail", "x"), (2, f"{line}!\nhead", "y"), (3, None, None), (None, line[::-1], "z")]
    out = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string, line_no string"))
    assert out.columns == ["doc_id", "text", "line_no"]
    rows = {r.doc_id: r.text for r in out.collect()}
    assert rows == {1: f"head\n{line}\n\ntail", 2: "head", 3: None, None: line[::-1]}


def test_clashing_names(spark):
    line = "a line of more than twenty letters"
    names = ["doc", "mark", "removed", "__doc", "__mark", "one", "two", "line"]
    docs = spark.createDataFrame([(k, line, *range(len(names))) for k in range(3)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    assert sorted((r.doc_id, r.text, r.removed) for r in dedup_lines(docs).collect()) == [(0, line, 2), (1, "", 2), (2, "", 2)]


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
