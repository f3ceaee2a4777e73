"""A quality classifier without labels: overlapping heuristics, their accuracies by expectation-maximisation, a hashed linear scorer.

Every heuristic votes good, bad or nothing on each document. Documents with equal votes are alike for the label model, so the
EM runs on the counts of vote patterns (each labeller votes one way or not at all: at most 2 ** 16, whatever the corpus). Its posteriors are soft labels
for a logistic model over hashed words and statistics, fitted on a bounded number of documents and applied to all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from prismill.llm.outliers import statistics
from prismill.llm.text import require
from prismill.session import durable

# Documents that the scorer is fitted on, and its number of hashed features.
FIT_ROWS, WIDTH = 8_000, 1 << 15
GOOD, BAD, NONE = 1, 0, 2
# The measures in order; then the labellers, each a measure, whether it speaks from a limit up or down, the limit, and
# its vote. Several look at the same flaw, which is what lets their agreement tell how far each may be trusted.
MEASURES = ("words", "symbols", "symbol_words", "odd_signs", "repeated_words", "distinct", "same_word", "packed", "repeated_lines", "capitals", "capital_words", "exclaimed", "letters", "ended_lines")
LABELLERS = (
    ("words", "<=", 20, BAD),
    ("symbols", ">=", 0.20, BAD),
    ("symbol_words", ">=", 0.20, BAD),
    ("odd_signs", ">=", 0.06, BAD),
    ("repeated_words", ">=", 0.40, BAD),
    ("distinct", "<=", 0.40, BAD),
    ("same_word", ">=", 0.20, BAD),
    ("packed", "<=", 0.20, BAD),
    ("repeated_lines", ">=", 0.40, BAD),
    ("capitals", ">=", 0.50, BAD),
    ("capital_words", ">=", 0.50, BAD),
    ("exclaimed", ">=", 0.30, BAD),
    ("letters", "<=", 0.75, BAD),
    ("letters", ">=", 0.92, GOOD),
    ("distinct", ">=", 0.60, GOOD),
    ("ended_lines", ">=", 0.60, GOOD),
)
_NOT_LETTERS = bytes(b for b in range(256) if b > 127 or not chr(b).isalpha())
_NOT_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
_USUAL = bytes(b for b in range(256) if b > 127 or chr(b).isalnum() or chr(b).isspace() or chr(b) in ".,;:'-?()" + '"')
SPAN = 100  # words over which distinct words are counted


def measures(text: bytes) -> list[float]:
    """One value per entry of MEASURES; shares are per word, line, letter or character."""
    n, chars, symbols, again, repeated = statistics(text)
    lines = [line.rstrip() for line in text.split(b"\n") if line.strip()]
    ascii_letters = len(text.translate(None, _NOT_LETTERS))
    letters = ascii_letters if text.isascii() else sum(map(str.isalpha, text.decode("utf-8", "replace")))
    words = text.split()
    spans = [words[k : k + SPAN] for k in range(0, max(1, n - SPAN // 2), SPAN)] if n else []
    some, size = max(n, 1), max(len(text), 1)
    return [
        float(n),
        symbols / some,
        sum(len(w.translate(None, b"#*$%&|<>")) < len(w) for w in words) / some if symbols else 0.0,
        len(text.translate(None, _USUAL)) / size,
        repeated / some,
        sum(len(set(s)) / len(s) for s in spans) / len(spans) if spans else 1.0,
        sum(map(bytes.__eq__, words, words[1:])) / some,
        len(zlib.compress(text, 1)) / size if size > 500 else 1.0,
        again / max(len(lines), 1),
        len(text.translate(None, _NOT_CAPITALS)) / max(ascii_letters, 1),
        sum(map(bytes.isupper, words)) / some,
        text.count(b"!") / some,
        letters / max(chars, 1),
        sum(line.endswith((b".", b"!", b"?", b":", b'"', b")")) for line in lines) / max(len(lines), 1),
    ]


def votes(values: list[float]) -> list[int]:
    named = dict(zip(MEASURES, values))
    return [vote if (named[m] >= limit if way == ">=" else named[m] <= limit) else NONE for m, way, limit, vote in LABELLERS]


def hashed(words: list[bytes], values: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(index, value): square-rooted word shares, and each measure in steps of its own."""
    index = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(WIDTH)
    code, count = np.unique(index.astype(np.int64), return_counts=True)
    steps = [xxhash.xxh64_intdigest(b"#%d:%d" % (i, round(8 * np.log1p(8 * v)) if v < 8 else 40 + round(2 * np.log2(v)))) % WIDTH for i, v in enumerate(values)]
    share = np.sqrt(count / max(len(words), 1))
    return np.concatenate([code, np.array(steps, np.int64)]), np.concatenate([share, np.full(len(steps), 0.5)])


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300, prior: float = 0.85) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, [labeller, class] chance to speak, share of good) by EM.

    `patterns` holds GOOD, BAD or NONE. A labeller that votes one way has two accuracies: how often it speaks about documents
    of its class, and how often it wrongly speaks about the others; both are estimated, so that a labeller which praises
    nearly everything counts for little. Beta priors worth a hundredth of the documents keep the classes from changing places.
    """
    k, total = patterns.shape[1], float(counts.sum())
    speaks = (patterns != NONE).astype(np.float64)
    blames = np.array([vote == BAD for *_, vote in LABELLERS[:k]])
    start = np.where(blames[:, None], [0.35, 0.02], [0.5, 0.9])  # columns: bad, good
    chance, weak, good = start.copy(), 0.01 * total + 1, prior
    posterior = np.full(len(patterns), prior)
    for _ in range(rounds):
        logs = speaks @ np.log(chance) + (1 - speaks) @ np.log1p(-chance) + np.log([1 - good, good])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -60, 60)))
        for c, mass in ((0, counts * (1 - new)), (1, counts * new)):
            chance[:, c] = np.clip((mass @ speaks + weak * start[:, c]) / (mass.sum() + weak), 1e-4, 1 - 1e-4)
        good = float(np.clip((counts * new).sum() / max(total, 1.0), 0.05, 0.99))
        done = np.abs(new - posterior).max(initial=0) < 1e-9
        posterior = new
        if done:
            break
    return posterior, chance, good


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[index] @ value + self.bias, -60, 60))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 200, ridge: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels by gradient steps with momentum."""
    if not len(rows):
        return Scorer(np.zeros(WIDTH), 0.0)
    index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    mean = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    w, b, vw, vb = np.zeros(WIDTH), float(np.log(mean / (1 - mean))), np.zeros(WIDTH), 0.0
    # The features of a row have squares that sum to about one plus a quarter for each measure.
    rate = 4.0 / (1.0 + 0.25 * len(MEASURES) + 1.0)
    for _ in range(rounds):
        gap = 1 / (1 + np.exp(-np.clip(np.bincount(owner, value * w[index], len(rows)) + b, -60, 60))) - target
        vw = 0.9 * vw - rate * (np.bincount(index, value * gap[owner], WIDTH) / len(rows) + ridge * w)
        vb = 0.9 * vb - rate * gap.mean()
        w, b = w + vw, b + vb
    return Scorer(w, float(b))


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id_col, votes, posterior, score, kept) for each row: the label model's posterior and the scorer's share of good.

    * votes: one digit per labeller, 1 good, 0 bad, 2 silent. kept: the score is at least `keep_at`.
    * The label model sees the counts of all documents. The scorer is fitted on at most `fit_rows` documents, those with the
      smallest hashes of id and votes.
    * Null and empty texts have no words: they are voted on and scored like others. Repeated rows count each. Other
      columns don't matter. No rows: no rows.
    """
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def vote(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = ["".join(map(str, votes(measures(t.as_py() or b"")))) for t in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.string())], ["id", "votes"])

    voted = durable(rows.mapInArrow(vote, f"id {kind}, votes string"))
    table = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").toPandas()
    patterns = np.array([[int(c) for c in v] for v in table["votes"]], np.int64).reshape(len(table), len(LABELLERS))
    posterior, _, _ = label_model(patterns, table["n"].to_numpy(np.float64))
    believed = dict(zip(table["votes"], posterior.tolist()))

    chosen = voted.where("id IS NOT NULL").orderBy(F.xxhash64("id", "votes"), "id").limit(fit_rows).select("id", "votes")

    def features(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            pairs = [hashed(t.lower().split(), measures(t)) for t in (x.as_py() or b"" for x in batch.column("text").cast(pa.large_binary()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("votes"), pa.array([i.astype(np.int32).tobytes() for i, _ in pairs], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in pairs], pa.binary())],
                ["votes", "index", "value"],
            )

    # At most fit_rows rows of at most WIDTH features.
    fitted = rows.join(chosen, "id").dropDuplicates(["id"]).select("text", "votes").mapInArrow(features, "votes string, index binary, value binary").toPandas()
    pairs = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32).astype(np.float64)) for i, v in zip(fitted["index"], fitted["value"])]
    scorer = fit_scorer(pairs, np.array([believed[v] for v in fitted["votes"]]))

    def score(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            told, scores = [], []
            for t in batch.column("text").cast(pa.large_binary()):
                text = t.as_py() or b""
                values = measures(text)
                told.append("".join(map(str, votes(values))))
                scores.append(scorer.score(*hashed(text.lower().split(), values)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(told, pa.string()), pa.array([believed[v] for v in told], pa.float64()), pa.array(scores, pa.float64()), pa.array([s >= keep_at for s in scores], pa.bool_())],
                ["id", "votes", "posterior", "score", "kept"],
            )

    scored = rows.mapInArrow(score, f"id {kind}, votes string, posterior double, score double, kept boolean")
    return scored.withColumnRenamed("id", id_col)
