"""Toxicity by a weighted pattern grammar: transducers composed into one machine that scores clauses."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import map_column, register, table
from marketlens.session import stored

# Function words of the grammar in English, German, French and Spanish.
TARGETS = """you your yours yourself u ur du dich dir dein deine euch euer ihr tu te toi ton ta vous votre vos
tú ti tuyo usted ustedes vosotros""".split()
NEGATIONS = """not no never none isn't aren't wasn't don't doesn't didn't won't nicht kein keine keinen nie niemals
pas jamais aucun aucune nunca ningún ninguna tampoco""".split()
REPORTS = """said says say told tells wrote writes called calls quoted quotes reported claims claimed sagte sagt schrieb
nannte zitierte behauptet dit écrit appelé cite prétend dijo dice escribió llamó citó""".split()
THREATS = """kill hurt destroy murder strangle stab umbringen töten verprügeln erschlagen tuer frapper assassiner
matar golpear asesinar""".split()

TOKEN = re.compile(r"\w+(?:['’]\w+)*|[.!?;\n]").findall
END = "."
#: Labelled rows to learn from at most, those with the smallest hash of their id.
TRAIN_ROWS = 8_000
#: Patterns learned at most, the toxic documents each must stand in, and the odds it must raise.
MOST_PATTERNS, LEAST_DOCS, LEAST_ODDS = 400, 4, 6.0
#: Letters of the word beginnings that are counted, besides whole words.
HEADS = range(4, 9)
OUTCOMES = ["insult", "aimed_insult", "denied_insult", "reported_insult", "threat", "aimed_threat", "denied_threat", "reported_threat"]
CUT = 0.3

Machine = dict[tuple[object, str], tuple[object, str]]


def negation(reach: int = 3) -> Machine:
    """Insults and threats up to ``reach`` words after a negation come out denied."""
    arcs: Machine = {}
    for left in range(reach + 1):
        for symbol in SYMBOLS:
            denied = {"insult": "denied_insult", "threat": "denied_threat"}.get(symbol, symbol) if left else symbol
            arcs[left, symbol] = (reach if symbol == "no" else 0 if symbol == END else max(0, left - 1)), denied
    return arcs


def report() -> Machine:
    """Insults and threats after a verb of speech in the same clause come out reported."""
    arcs: Machine = {}
    for told in (0, 1):
        for symbol in SYMBOLS + ["denied_insult", "denied_threat"]:
            out = {"insult": "reported_insult", "threat": "reported_threat"}.get(symbol, symbol) if told else symbol
            arcs[told, symbol] = (0 if symbol == END else 1 if symbol == "says" else told), out
    return arcs


def clause() -> Machine:
    """At a clause's end: its gravest event, aimed at someone if the clause names a target."""
    grave = ["", "denied_threat", "denied_insult", "reported_threat", "reported_insult", "insult", "threat"]
    arcs: Machine = {}
    for worst in grave:
        for aimed in (0, 1):
            for symbol in SYMBOLS + grave[1:5]:
                state = worst, aimed
                if symbol == END:
                    name = f"aimed_{worst}" if aimed and worst in ("insult", "threat") else worst
                    arcs[state, symbol] = ("", 0), name
                elif symbol == "you":
                    arcs[state, symbol] = (worst, 1), ""
                elif symbol in grave:
                    arcs[state, symbol] = (max(worst, symbol, key=grave.index), aimed), ""
                else:
                    arcs[state, symbol] = state, ""
    return arcs


#: What the lexicon makes of words.
SYMBOLS = ["word", "insult", "threat", "you", "no", "says", END]


def compose(first: Machine, second: Machine, start: tuple[object, object]) -> Machine:
    """The machine that reads as ``first`` and feeds what comes out to ``second``; only states that can be reached."""
    arcs: Machine = {}
    todo, seen = [start], {start}
    symbols = sorted({symbol for _, symbol in first})
    while todo:
        state = todo.pop()
        for symbol in symbols:
            a, middle = first[state[0], symbol]
            b, out = second[state[1], middle]
            arcs[state, symbol] = (a, b), out
            if (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    return arcs


def grammar() -> tuple[Machine, object]:
    denied = compose(negation(), report(), (0, 0))
    start = (0, 0), ("", 0)
    return compose(denied, clause(), start), start


class Scorer:
    """Counts clause outcomes of a text, weighted by the insults' strength, and scores them."""

    def __init__(self, patterns: dict[str, float], weights: list[float], bias: float):
        self.patterns, self.weights, self.bias = patterns, weights, bias
        self.lengths = sorted({len(p) for p in patterns})
        self.words = {w: ("you", 0.0) for w in TARGETS} | {w: ("no", 0.0) for w in NEGATIONS} | {w: ("says", 0.0) for w in REPORTS}
        self.words |= {w: ("threat", 1.0) for w in THREATS} | {c: (END, 0.0) for c in ".!?;\n"}
        self.machine, self.start = grammar()
        self.memory: dict[str, bool] = {}

    def lexicon(self, word: str) -> tuple[str, float]:
        """The lexicon transducer: a word's symbol and weight; learned patterns are word beginnings or whole words."""
        best = max([self.patterns.get(word[:n], 0.0) for n in self.lengths], default=0.0)
        best = max(best, self.patterns.get(word + "$", 0.0))
        return ("insult", best) if best > 0 else self.words.get(word, ("word", 0.0))

    def grave(self, word: str) -> bool:
        known = self.memory.get(word)
        if known is None:
            if len(self.memory) > 300_000:
                self.memory.clear()
            known = self.memory[word] = self.lexicon(word)[0] in ("insult", "threat")
        return known

    def outcomes(self, text: str | None) -> list[float]:
        """Sum over the clauses of each outcome's weight."""
        sums = dict.fromkeys(OUTCOMES, 0.0)
        tokens = TOKEN(text.lower()) if text else []
        if any(map(self.grave, set(tokens))):
            state, strength = self.start, 0.0
            for token in [*tokens, "\n"]:
                symbol, weight = self.lexicon(token)
                strength = max(strength, weight)
                state, out = self.machine[state, symbol]
                if symbol == END:
                    if out:
                        sums[out] += strength
                    strength = 0.0
        return [math.log1p(v) for v in sums.values()]

    def score(self, outcomes: Iterable[float]) -> float:
        z = self.bias + sum(w * v for w, v in zip(self.weights, outcomes))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def chosen_patterns(counts: list[tuple[str, int, int]], toxic: int, clean: int, counted: int) -> dict[str, float]:
    """Word beginnings and whole words that tell toxic texts, with their strength.

    Candidates are taken in the order of their likelihood ratio, the longer of equals first; one
    that begins, or is begun by, a pattern already taken is left out. As ``counted``
    beginnings were looked at, a pattern must be unlikelier by chance than one in that many.
    """
    base = toxic / (toxic + clean)
    ranked = []
    for p, t, c in counts:
        odds = ((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1))
        share = t / (t + c)
        ratio = t * math.log(share / base) + (c * math.log((1 - share) / (1 - base)) if c else 0.0)
        if odds >= LEAST_ODDS and ratio >= math.log(max(2, counted)) + 1:
            ranked.append((-ratio, -len(p), p, math.log(odds) / 4))
    found: dict[str, float] = {}
    begun: set[str] = set()
    for _, _, p, strength in sorted(ranked):
        if p not in begun and not any(p[:k] in found for k in range(1, len(p))):
            found[p] = strength
            begun.update(p[:k] for k in range(1, len(p)))
        if len(found) == MOST_PATTERNS:
            break
    return dict(sorted(found.items()))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 40) -> tuple[list[float], float]:
    """Logistic regression with a small ridge penalty; weights of plain outcomes stay non-negative."""
    a = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge * max(1, len(y)) / 100)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty)
        w = w - np.linalg.solve(h, a.T @ (p - y) + penalty * w)
    return w[:-1].tolist(), float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Scorer:
    """Patterns and weights from labelled documents.

    ``labels`` are the rows to learn from; at most ``train_rows`` of them are read, those with the
    smallest hash of their id. The documents that hold each word beginning (HEADS letters) or whole
    word are counted in Spark; candidates that stand in LEAST_DOCS toxic texts at raised odds come to the
    driver, at most 20,000, and the outcome counts of the training rows, 8 numbers each.
    """
    chosen = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = stored(docs.select("doc_id", "text").join(chosen, "doc_id"), "train")
    sizes = {bool(r[0]): r[1] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        prior = (toxic + 0.5) / (toxic + clean + 1)
        return Scorer({}, [0.0] * len(OUTCOMES), math.log(prior / (1 - prior)))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+(?:['’]\w+)*)")))
    heads = F.transform(words, lambda w: F.concat(F.array(F.concat(w, F.lit("$"))), F.transform(F.filter(F.array(*[F.lit(n) for n in HEADS]), lambda n: n <= F.length(w)), lambda n: F.substr(w, F.lit(1), n))))
    each = rows.select("toxic", F.explode(F.array_distinct(F.flatten(heads))).alias("p"))
    heads = stored(each.groupBy("p").agg(F.sum("toxic").cast("long").alias("t"), F.sum(1 - F.col("toxic")).cast("long").alias("c")), "heads")
    counted = heads.filter(F.col("t") + F.col("c") >= LEAST_DOCS).count()
    ratio = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1))
    counts = heads.filter((F.col("t") >= LEAST_DOCS) & (ratio >= LEAST_ODDS)).orderBy(F.desc("t"), "p").limit(20_000).collect()
    draft = Scorer(chosen_patterns([tuple(r) for r in counts], toxic, clean, counted), [0.0] * len(OUTCOMES), 0.0)
    seen = measured(rows.select("toxic", "text"), draft).select("toxic", "outcomes").collect()  # at most train_rows
    weights, bias = fit(np.array([r[1] for r in seen]), np.array([r[0] for r in seen], float))
    return Scorer(draft.patterns, weights, bias)


def measured(docs: DataFrame, scorer: Scorer, text: str = "text", drop: bool = True) -> DataFrame:
    """Add ``outcomes``, the weighted clause counts of the text."""
    parts = scorer.patterns, scorer.weights, scorer.bias

    def make():
        own = Scorer(*parts)
        return lambda values: [[own.outcomes(v) for v in values]]

    return map_column(docs, text, [T.StructField("outcomes", T.ArrayType(T.DoubleType()))], make, drop)


def scored(docs: DataFrame, scorer: Scorer, text: str = "text", drop: bool = True) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted``; only the text is read. A null or empty text has the score of no event."""
    parts = scorer.patterns, scorer.weights, scorer.bias

    def make():
        own = Scorer(*parts)

        def run(values):
            scores = [own.score(own.outcomes(v)) for v in values]
            return [scores, [int(s >= CUT) for s in scores]]

        return run

    return map_column(docs, text, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, drop)


def held_out(column: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Scorer:
    """The scorer learned from the labelled rows that are not held out."""
    return learn(docs, table(spark, sf_dir, "labels").filter(~held_out()))


@register("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = trained(spark, docs, sf_dir)
    return scored(docs.withColumn("held_out", held_out()), scorer).select("doc_id", "held_out", "score", "predicted")
