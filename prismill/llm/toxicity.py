"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded texts.

Folding undoes disguises: compatibility forms, accents, look-alike letters of other scripts, digits and signs that stand for
letters. Entries match where a word starts. Their weights, the exception phrases and the two parameters of the score are
learned from labelled documents; scoring is one pass that needs nothing but the fitted model, which has a fixed bound.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from prismill.llm.text import free_name, require
from prismill.session import durable

# Letters of other scripts by the Latin letter they resemble, and digits and signs by the letter they replace.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k", "ι": "i", "χ": "x", "η": "n", "ω": "w", "γ": "y", "ϲ": "c",
    "ı": "i", "ɩ": "i", "ɡ": "g", "ɑ": "a", "ß": "ss", "ø": "o", "đ": "d", "ł": "l", "ħ": "h", "æ": "ae", "œ": "oe",
}
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}
HIDDEN = "­​‌‍⁠﻿"
_TABLE = str.maketrans(LOOK_ALIKES | {c: "" for c in HIDDEN})
_SIGNS = re.compile(r"[0-9@$!|€+]+")
_SIGN_TABLE = str.maketrans(STAND_INS)
_APART = re.compile(r"[\W_]+")
_MARKS = re.compile(r"[̀-ͯ]+")
# Labelled documents that the fit reads, entries and exceptions that a model holds, letters of an entry.
FIT_ROWS, MOST_ENTRIES, SHORTEST, LONGEST = 20_000, 5_000, 4, 12
DOUBT = 1.64


def fold(text: str) -> str:
    """Lower case, without accents and hidden characters, look-alikes as Latin letters, stand-ins as letters inside words, one blank between words."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text.lower().translate(_TABLE))).translate(_TABLE)
    text = text.lower()

    def swap(m: re.Match) -> str:
        # A stand-in must lead to a letter of the same word; signs behind a word stay signs, and numbers stay numbers.
        after = text[m.end() : m.end() + 1]
        return m[0].translate(_SIGN_TABLE) if after.isalpha() else m[0]

    return _APART.sub(" ", _SIGNS.sub(swap, text))


@dataclass(frozen=True)
class Lexicon:
    """Entries (beginnings of words) with weights, phrases that cancel a match inside them, and the score's parameters."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    bias: float = -4.0
    half_length: float = 200.0

    def automaton(self):
        machine = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            machine.add_word(" " + entry, (len(entry), weight, entry))
        for phrase in self.exceptions:
            machine.add_word(" " + phrase, (len(phrase), None, phrase))
        machine.make_automaton()
        return machine

    def evidence(self, machine, text: str | None) -> float:
        """Sum of the weights of the words hit, each entry counted with falling returns, divided by a slowly growing length.

        A word that several entries hit counts once, by its heaviest entry. A hit inside an exception phrase doesn't count.
        """
        folded = " " + fold(text or "")
        if not len(machine):
            return 0.0
        hits: dict[int, tuple[float, str]] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight, entry) in machine.iter(folded):
            start = end - length
            if weight is None:
                spared.append((start, end))
            elif weight > hits.get(start, (0.0,))[0]:
                hits[start] = (weight, entry)
        if not hits:
            return 0.0
        if spared:
            spared.sort()
            starts = [s for s, _ in spared]
            reach = np.maximum.accumulate([e for _, e in spared])
            hits = {s: w for s, w in hits.items() if not (k := bisect.bisect_right(starts, s)) or reach[k - 1] < s}
        total = 0.0
        for (weight, _), count in sorted(Counter(hits.values()).items()):
            total += weight * math.log2(1 + count)
        return total / math.log2(2 + folded.count(" ") / self.half_length)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * evidence + self.bias))))


def beginnings(text: str | None) -> set[str]:
    """The candidate entries of a text: beginnings of its folded words, and whole words."""
    found = set()
    for word in set(fold(text or "").split()):
        if word.isalpha():
            for k in range(SHORTEST, min(len(word), LONGEST) + 1):
                found.add(word[:k])
    return found


def fit_lexicon(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, most_entries: int = MOST_ENTRIES, support: int = 3, lift: float = 8.0) -> Lexicon:
    """A model from docs (id, text) and labels (id, toxic 0/1). Without both labels the lexicon stays empty.

    The fit reads at most `fit_rows` labelled documents, those with the smallest hashes of their ids; repeated ids count once. An
    entry is a beginning of words that `support` toxic documents or more contain, and whose log odds stay above `lift` after
    DOUBT standard errors; that bound is its weight. Beginnings that tell nothing beyond a shorter or longer one are left
    out; longer ones that speak against an entry become exceptions.
    """
    named = labels.where("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = durable(named.join(docs.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(fit_rows))
    # At most fit_rows ids, so the texts need not be shuffled for them.
    known = durable(docs.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), fit_rows)

    def count(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for entry in beginnings(text):
                    counts.setdefault(entry, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["entry", "clean", "toxic"])

    sizes = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        return Lexicon()
    counted = known.select("text", "toxic").mapInArrow(count, "entry string, clean long, toxic long")
    summed = durable(counted.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= support), fit_rows)

    def bound(toxic, clean, log, sqrt):
        odds = log((toxic + 0.5) / (n_toxic + 1)) - log((clean + 0.5) / (n_clean + 1))
        return odds - DOUBT * sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))

    strong = summed.where(F.col("toxic") >= support).withColumn("weight", bound(F.col("toxic"), F.col("clean"), F.log, F.sqrt)).where(F.col("weight") >= math.log(lift))
    table = {r["entry"]: (r["clean"], r["toxic"], r["weight"]) for r in strong.orderBy(F.col("weight").desc(), "entry").limit(most_entries).collect()}
    weights: dict[str, float] = {}
    for entry in sorted(table, key=len, reverse=True):
        clean, toxic, weight = table[entry]
        if any(table[entry[:k]][2] >= weight for k in range(SHORTEST, len(entry)) if entry[:k] in table):
            continue  # a shorter beginning says as much
        longer = [table[w] for w in weights if w.startswith(entry)]
        if longer:
            most = max(longer, key=lambda c: c[1])
            if bound(max(0, toxic - most[1]), max(0, clean - most[0]), math.log, math.sqrt) < math.log(lift):
                continue  # its evidence is that of a longer one
        weights[entry] = weight
    exceptions: tuple[str, ...] = ()
    if weights:
        stem = "^(" + "|".join(sorted(weights)) + ")."
        against = summed.where(F.col("entry").rlike(stem) & (F.col("clean") >= support) & (F.col("toxic") * n_clean <= F.col("clean") * n_toxic))
        exceptions = tuple(r["entry"] for r in against.orderBy(F.col("clean").desc(), "entry").limit(most_entries).collect())
    model = Lexicon(weights, exceptions)

    def measure(batches: Iterator[pa.RecordBatch]):
        machine = model.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.evidence(machine, t) for t in batch.column("text").to_pylist()], pa.float64()), batch.column("toxic")], ["x", "toxic"])

    # At most fit_rows pairs of numbers.
    pairs = known.select("text", "toxic").mapInArrow(measure, "x double, toxic int").toPandas()
    slope, bias = calibrated(pairs["x"].to_numpy(), pairs["toxic"].to_numpy())
    return Lexicon(weights, exceptions, slope, bias)


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and bias of a logistic fit with a small ridge, by Newton's method; the slope is not negative."""
    design, coef = np.stack([x, np.ones_like(x)], 1), np.array([0.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ coef, -60, 60)))
        gradient = design.T @ (p - y) + ridge * coef
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        coef = coef - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(coef[0]), 0.0), float(coef[1])


def score_toxicity(docs: DataFrame, model: Lexicon, text_col: str = "text", score_col: str = "score", evidence_col: str = "evidence") -> DataFrame:
    """`docs` with a score from 0 to 1 and the evidence behind it, for each row.

    Null and empty texts have no evidence and get the score of a text without hits. Rows are scored one by one: repeated rows and
    null ids don't matter. The two columns take a free name (leading underscores) if `docs` has columns of that name. No rows: no rows.
    """
    require(docs, text_col)
    names = [free_name(docs.columns, score_col), free_name(docs.columns, evidence_col)]

    def run(batches: Iterator[pa.RecordBatch]):
        machine = model.automaton()
        for batch in batches:
            found = [model.evidence(machine, t) for t in batch.column(text_col).to_pylist()]
            more = [pa.array([model.score(x) for x in found], pa.float64()), pa.array(found, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    schema = StructType([*docs.schema.fields, *[StructField(n, DoubleType()) for n in names]])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str) -> Column:
    """Rows kept out of every fit: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """(id, toxic) of the labels that may be learned from."""
    return labels.where(~held_out("doc_id")).select(F.col("doc_id").alias("id"), "toxic")


def fit_on_tables(docs: DataFrame, labels: DataFrame, **options) -> Lexicon:
    """fit_lexicon on documents (doc_id, text) and labels (doc_id, toxic), without the held-out rows."""
    return fit_lexicon(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")), training_labels(labels), **options)
