"""Toxicity by a weighted grammar of finite-state transducers over clauses.

Words become symbols: insult, threat, intent, target, negation, report or other.
Five small transducers read them, each with its own weights (logarithms, so that
weights add along a path):

* insult: what an insulting word weighs;
* threat: a threatening verb weighs less without a word of intent before it;
* target: a word that addresses or names a person before the match adds weight;
* negation: a match up to three words after a negation loses weight;
* reported speech: a match after a word of report loses weight.

``compose`` makes one machine of them. It runs over each clause with a match; the
clause scores the weights of its matched words, and the document gets a
logistic function of the sum, of the strongest clause and of the share of clauses.

Insults, whole words and stems, are learned from labelled texts, as they differ
between languages. A stem counts once for each context (the words on both sides),
so that many copies of one text count as that text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType

from . import common
from .learning import fit_logistic, labelled_sample, logistic

OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, END = b".", b"I", b"H", b"W", b"T", b"N", b"R", b"\n"
SYMBOLS = (OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT)
WORDS: dict[bytes, str] = {
    INSULT: "idiot idiots moron morons stupid fool fools dumb scum idiota imbécile imbécil dummkopf",
    THREAT: "kill hurt destroy attack beat stab shoot burn töten verletzen tuer frapper matar golpear",
    INTENT: "will shall gonna going werde werden wird vais va voy vamos",
    TARGET: "you your yours he him she her they them du dich dir ihr euch tu toi te vous tú ti usted ustedes",
    NEGATION: "not no never isn't aren't don't neither nicht kein keine nie pas jamais nunca ni",
    REPORT: "said says called calls quoted quotes according claimed reported sagte sagt laut dit selon dijo según",
}
#: Documents of each class from which the lexicon is learned and the score calibrated.
MAX_EXAMPLES = 3000
STEMS = (3, 4, 5, 6)
MIN_CONTEXTS, MIN_ODDS, MAX_LEXICON = 4, 3.5, 5000
REMEMBERED = 500_000
_TOKEN = re.compile(r"\w+(?:'\w+)?|[.!?;:\n]")
_CLAUSE_END = frozenset(".!?;:\n")


@dataclass(frozen=True)
class Machine:
    """A deterministic weighted transducer: step(state, symbol) gives the next state and a weight."""

    start: object
    step: Callable[[object, bytes], tuple[object, float]]


def compose(*parts: Machine) -> tuple[object, dict[tuple[object, bytes], tuple[object, float]]]:
    """The product of machines over the same symbols, as a start state and a table."""
    start = tuple(m.start for m in parts)
    table, todo = {}, [start]
    while todo:
        state = todo.pop()
        for symbol in SYMBOLS:
            if (state, symbol) not in table:
                steps = [m.step(s, symbol) for m, s in zip(parts, state, strict=True)]
                after = tuple(s for s, _ in steps)
                table[state, symbol] = after, sum(w for _, w in steps)
                todo.append(after)
    return start, table


def _matched(symbol: bytes) -> bool:
    return symbol in (INSULT, THREAT)


INSULTS = Machine(0, lambda s, x: (0, 0.0))
THREATS = Machine(0, lambda s, x: (1 if x == INTENT else s, math.log(0.3) if x == THREAT and not s else 0.0))
TARGETS = Machine(0, lambda s, x: (1 if x == TARGET else s, math.log(1.5) if _matched(x) and s else 0.0))
NEGATIONS = Machine(0, lambda s, x: (3 if x == NEGATION else max(0, s - 1), math.log(0.25) if _matched(x) and s else 0.0))
REPORTS = Machine(0, lambda s, x: (1 if x == REPORT else s, math.log(0.5) if _matched(x) and s else 0.0))


class Grammar:
    """The composed machine with a lexicon: words and stems (ending in *) with weights."""

    def __init__(self, lexicon: dict[str, float]):
        self.start, self.table = compose(INSULTS, THREATS, TARGETS, NEGATIONS, REPORTS)
        self.fixed = {w: symbol for symbol, words in WORDS.items() for w in words.split()}
        self.lexicon = lexicon
        self.known: dict[str, int] = {}

    def weight(self, word: str) -> float:
        """Of an insult, 1 for those of the fixed list; 0 for other words."""
        found = [self.lexicon.get(word, 0.0), *(self.lexicon.get(word[:n] + "*", 0.0) for n in STEMS if len(word) > n)]
        return max(*found, 1.0 if self.fixed.get(word) in (INSULT, THREAT) else 0.0)

    def symbol(self, word: str) -> int:
        known = self.known.get(word)
        if known is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            if word in _CLAUSE_END:
                found = END
            else:
                found = self.fixed.get(word) or (INSULT if self.weight(word) > 0 else OTHER)
            known = self.known[word] = found[0]
        return known

    def clauses(self, text: str) -> Iterator[tuple[float, int]]:
        """Score and number of matches of each clause with a match, in order; then (0, clauses)."""
        words = _TOKEN.findall(text.lower())
        marks = bytes(map(self.symbol, words))
        if INSULT in marks or THREAT in marks:
            at = 0
            for clause in marks.split(END):
                if INSULT in clause or THREAT in clause:
                    yield self._run(words[at : at + len(clause)], clause)
                at += len(clause) + 1
        yield 0.0, marks.count(END) + 1

    def _run(self, words: list[str], marks: bytes) -> tuple[float, int]:
        state, score, matches = self.start, 0.0, 0
        for word, mark in zip(words, marks, strict=True):
            symbol = bytes([mark])
            state, weight = self.table[state, symbol]
            if _matched(symbol):
                score += self.weight(word) * math.exp(weight)
                matches += 1
        return score, matches

    def measure(self, text: str) -> tuple[float, float, float, int]:
        """log(1 + sum), strongest clause, share of clauses that match, matches."""
        *found, (_, clauses) = self.clauses(text)
        if not found:
            return 0.0, 0.0, 0.0, 0
        scores = [s for s, _ in found]
        return math.log1p(sum(scores)), max(scores), len(found) / clauses, sum(n for _, n in found)


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    beta: tuple[float, ...]


#: Without labels of both classes: one plain insult makes a score of about 0.8.
UNTRAINED = Model({}, (2.0, 1.0, 0.0, -1.0))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, hash of the word with its neighbours, label) of each word of each text."""
    import xxhash

    for batch in batches:
        rows = zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True)
        words, hashes, labels = [], [], []
        for text, label in rows:
            found = ["", *(w for w in _TOKEN.findall(text.lower()) if w not in _CLAUSE_END), ""]
            made = [xxhash.xxh3_64_intdigest(" ".join(found[i : i + 3])) - (1 << 63) for i in range(len(found) - 2)]
            words += found[1:-1]
            hashes += made
            labels += [label] * len(made)
        arrays = [pa.array(words, pa.string()), pa.array(hashes, pa.int64()), pa.array(labels, pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, names=["word", "context", "label"])


def learn(documents: DataFrame, labels: DataFrame, label: str = "toxic", *, where: Column | None = None, max_examples: int = MAX_EXAMPLES) -> Model:
    """Lexicon and calibration from at most about `max_examples` texts of each class.

    Without labels of both classes the fixed word lists and weights are used.
    """
    sample, weight = labelled_sample(documents, labels, label, max_examples, where=where)
    if len(weight) < 2:
        return UNTRAINED
    words = sample.select("text", "label").mapInArrow(_contexts, "word string, context bigint, label int").distinct()
    totals = words.groupBy("label").agg(F.count("*").alias("n"))
    stems = [F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in STEMS]
    features = words.select(F.explode(F.filter(F.array("word", *stems), lambda x: x.isNotNull())).alias("feature"), "label")
    counts = features.groupBy("feature").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    size = {r["label"]: r["n"] for r in totals.collect()}
    odds = F.log((F.col("bad") + 0.5) / (size.get(1, 0) + 1)) - F.log((F.col("good") + 0.5) / (size.get(0, 0) + 1))
    found = counts.where(F.col("bad") >= MIN_CONTEXTS).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS)
    found = found.orderBy(F.desc("odds"), "feature").limit(MAX_LEXICON).collect()
    lexicon = {r["feature"]: r["odds"] / MIN_ODDS for r in found}
    rows = _measured(sample.select("text", "label"), Model(lexicon, UNTRAINED.beta)).select("label", "total", "strongest", "share").collect()
    x = np.array([r[1:] for r in rows], float).reshape(-1, 3)
    y = np.array([r["label"] for r in rows], float)
    return Model(lexicon, tuple(fit_logistic(x, y, np.array([weight[int(v)] for v in y])).tolist()))


_ADDED = (("total", DoubleType()), ("strongest", DoubleType()), ("share", DoubleType()), ("matches", LongType()), ("score", DoubleType()))


def _measured(frame: DataFrame, model: Model, text: str = "text") -> DataFrame:
    names = [n for n, _ in _ADDED]
    out = [c for c in frame.columns if c not in names and c != text]
    schema = frame.select(*out).schema
    for name, kind in _ADDED:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.lexicon)
        beta = np.array(model.beta)
        for batch in batches:
            made = [grammar.measure(t or "") for t in batch.column(text).to_pylist()]
            x = np.array(made, float).reshape(-1, 4)
            arrays = [pa.array(x[:, i]) for i in range(3)] + [pa.array(x[:, 3].astype(np.int64)), pa.array(logistic(x[:, :3], beta))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), *arrays], names=[*out, *names])

    return frame.select(*out, text).mapInArrow(run, schema)


def score(documents: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Each row without its text, with the clause measures, matches and score (0 to 1).

    A map without shuffle. A null or empty text has no clause and gets the score of
    no match. Repeated rows stay, other columns pass through (those named like added
    ones are replaced), and an empty table gives an empty result.
    """
    return _measured(documents, model, text)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = learn(documents, common.table(spark, sf_dir, "labels"), where=fold != 1)
    held_out = F.coalesce(fold == 1, F.lit(False)).cast(BooleanType())
    scored = score(documents, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast(IntegerType()).alias("predicted"), "matches"
    )


QUERIES = {"op6_toxicity": op6}
