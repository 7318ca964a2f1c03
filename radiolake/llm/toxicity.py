"""Toxic passages as maximal scoring segments of token log-odds.

Training counts in how many toxic and other texts a feature (a word or a prefix of one) occurs and
gives each feature the log-odds of the two with an informative Dirichlet prior, taken at the lower
end of their confidence interval; a word scores as its best feature, less a drift that makes
ordinary text fall. A linear scan finds all maximal scoring segments of a text. Their scores are
set against the extreme values that random text of that length would reach (Karlin-Altschul), and
the most significant ones add up to the text's evidence, which a logistic curve maps to 0..1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.llm.common import bounded, keep, map_batches, smallest_hashes, texts, with_id

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)  # besides the word itself
MEMO = 200_000           # words whose score a task keeps
DRIFT = 0.25             # what every word costs
PRIOR = 2.0              # texts at a feature's pooled rate that its prior is worth
Z = 2.6                  # lower end of a feature's log-odds, in standard errors


def features(word: str) -> list[str]:
    """The word, marked, and its shorter prefixes."""
    return [word + "$", *(word[:n] for n in PREFIXES if n < len(word))]


@dataclass
class Model:
    """What is learned: feature scores, extreme-value parameters, the logistic curve."""
    odds: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0        # decay of the tail of segment scores
    k: float = 1.0          # segments to be expected for each word
    slope: float = 1.0
    middle: float = 10.0    # evidence at which the score is 0.5
    least: float = 0.0      # segments of less evidence than this are chance

    def word_score(self, word: str) -> float:
        get = self.odds.get
        return max((get(f, 0.0) for f in features(word)), default=0.0) - DRIFT


class Scores(dict):
    """word -> score, computed at the first look; emptied when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        self[word] = score = self.model.word_score(word)
        return score


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), by one scan (Ruzzo and Tompa).

    Words that score alike in sign are taken together first, so the scan runs over changes of
    sign only; a maximal segment starts and ends with whole runs of positive words.
    """
    up = scores > 0
    if not up.any():
        return []
    edges = np.flatnonzero(np.diff(up.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float]] = []  # first, end, total before, total at the end
    # back[k]: index of the last segment below k whose total before is lower, -1 if none
    back: list[int] = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        left, right = float(total[a]), float(total[b])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = back[j]
            if j < 0 or stack[j][3] >= right:
                stack.append((a, b, left, right))
                back.append(j)
                break
            a, left = stack[j][0], stack[j][2]
            del stack[j:], back[j:]
    return [(a, b, r - x) for a, b, x, r in stack]


def evidence(model: Model, found: list[tuple[int, int, float]], n_words: int) -> float:
    """Sum over the significant segments of -ln of how many as good ones chance would give."""
    base = math.log(max(model.k * n_words, 1.0))
    return sum(max(0.0, model.lam * s - base - model.least) for _, _, s in found)


def curve(model: Model, value: float) -> float:
    x = model.slope * (value - model.middle)
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def passages(model: Model, scores: Scores, text: str) -> tuple[int, list[tuple[int, int, float]]]:
    words = WORD.findall(text.lower())
    if not words:
        return 0, []
    found = segments(np.fromiter(map(scores.__getitem__, words), np.float64, len(words)))
    return len(words), found


def _feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, y1, y0): in how many toxic and other texts it occurs."""
    def count(batches):
        for batch in batches:
            one, other = Counter(), Counter()
            for text, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist(),
                                   strict=True):
                own = {f for w in set(WORD.findall(text.lower())) for f in features(w)}
                (one if toxic else other).update(own)
            names = list({*one, *other})
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([one[x] for x in names], pa.int64()),
                 pa.array([other[x] for x in names], pa.int64())], ["feature", "y1", "y0"])

    parts = bounded(sample).mapInArrow(count, "feature string, y1 long, y0 long")
    return parts.groupBy("feature").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))


def _tail(gaps: list[tuple[float, int]]) -> tuple[float, float]:
    """Decay and rate of the best segment scores of clean texts: (score, words) of each.

    Under chance, ln of the expected number of segments of score s or more among n words is
    ln(k n) - lam s; matched to mean and spread of the Gumbel law of the texts' best segments.
    """
    if len(gaps) < 30:
        return 1.0, 1.0
    s = np.array([x for x, _ in gaps])
    n = np.log(np.maximum([w for _, w in gaps], 1))
    lam = math.pi / (math.sqrt(6) * max(float(s.std()), 0.3))
    k = math.exp(float((lam * s - n).mean()) - np.euler_gamma)
    return lam, k


def train(rows: DataFrame, text_col: str = "text", label_col: str = "toxic",
          max_rows: int = 24_000, max_features: int = 50_000,
          labels: DataFrame | None = None, id_col: str = "doc_id") -> Model:
    """Learn from rows with a label of 0 or 1 (others are left out).

    The labels stand in the rows or, by id, in a table of their own (one row an id).
    Equal rows of text and label count once, so no text that is often repeated rules the model.
    `max_rows` bounds the sample of these exactly: those with the smallest hashes. Two thirds of it
    teach the features, the others (by another hash of the text) the tail and the curve, so that
    words which a feature has learned by heart do not count as clean text. `max_features` bounds the
    model, by evidence; features that are not significant take no
    room.
    """
    # hashes decide, so that only texts of the sample move; a hash that two share brings in both
    text = F.col(text_col).cast("string")
    hashed = rows.withColumn("h", F.xxhash64(text, F.lit("sample"))).where(text.isNotNull())
    if labels is None:
        marks = hashed.select("h", F.col(label_col).cast("int").alias("toxic"))
    else:
        marks = hashed.select("h", id_col).join(labels, id_col).select(
            "h", F.col(label_col).cast("int").alias("toxic"))
    taken = smallest_hashes(marks.where("toxic in (0, 1)").distinct(), max_rows,
                            "toxicity-hashes")
    sample = keep(hashed.select("h", text.alias("text")).join(F.broadcast(taken), "h")
                  .select("text", "toxic").distinct(), "toxicity-sample")
    turn = F.pmod(F.xxhash64("text"), F.lit(3))
    learn, tune = sample.where(turn != 0), sample.where(turn == 0)
    sizes = dict(learn.groupBy("toxic").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model()
    # Dirichlet prior: half a text of either kind, and PRIOR texts at the feature's pooled rate
    y1, y0 = F.col("y1"), F.col("y0")
    prior = 0.5 + PRIOR * (y1 + y0) / float(n1 + n0)
    a1, a0 = y1 + prior, y0 + prior
    t1, t0 = n1 + 1.0 + PRIOR, n0 + 1.0 + PRIOR
    delta = F.log(a1 / (t1 - a1)) - F.log(a0 / (t0 - a0))
    error = F.sqrt(1 / a1 + 1 / a0)
    best = (_feature_counts(learn).where((y1 >= 3) & (y1 * n0 > y0 * n1))
            .select("feature", (delta - Z * error).alias("score"))
            .where(F.col("score") > DRIFT)
            .orderBy(F.desc("score"), "feature").limit(max_features))
    model = Model(odds={r["feature"]: float(r["score"]) for r in best.collect()})
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = Scores(shared.value)
        out = [passages(shared.value, scores, t) for t in texts(batch.column(0))]
        return pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array([n for n, _ in out], pa.int64()),
             pa.array([[s for *_, s in f] for _, f in out], pa.list_(pa.float64()))],
            ["toxic", "n", "found"])

    seen = map_batches(tune.select("text", "toxic"), scan, "toxic int, n long, found array<double>")
    # bounded by max_rows; in order, so that sums do not depend on the tasks
    seen = sorted((r["toxic"], r["n"], r["found"]) for r in seen.collect())
    model.lam, model.k = _tail([(max(f), n) for y, n, f in seen if y == 0 and f])
    model.slope, model.middle = _logistic(
        [(evidence(model, [(0, 0, s) for s in f], n), y) for y, n, f in seen])
    return model


def _logistic(pairs: list[tuple[float, int]]) -> tuple[float, float]:
    """Slope and middle of a logistic curve through (evidence, label), by Newton's method."""
    x = np.log1p(np.array([v for v, _ in pairs]))
    y = np.array([t for _, t in pairs], float)
    if not len(y) or y.min() == y.max():
        return 1.0, 10.0
    # one pseudo-case of either label at the far ends keeps separable cases finite
    x, y = np.append(x, [0.0, x.max() + 1]), np.append(y, [0.0, 1.0])
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    ridge = np.diag([0.01, 0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge,
                               a.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
    slope = max(float(w[0]), 1e-3)
    return slope, -float(w[1]) / slope


def score(df: DataFrame, model: Model, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Per row: id, score, n_words, passages (first and end word, score) that are significant.

    Null and empty texts have no passage and score as no evidence does. Long texts are scanned
    whole, in time linear in their words.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def one(batches):
        memo = Scores(shared.value)
        for batch in batches:
            yield _scored(shared.value, memo, batch)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return bounded(rows).mapInArrow(one, with_id(
        df, id_col, "score double, n_words long, "
                    "passages array<struct<first:int,end:int,score:double>>"))


def _scored(model: Model, memo: Scores, batch: pa.RecordBatch) -> pa.RecordBatch:
    scores, counts, found = [], [], []
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()),
                               ("score", pa.float64())]))
    for text in texts(batch.column(1)):
        n, own = passages(model, memo, text)
        scores.append(curve(model, math.log1p(evidence(model, own, n))))
        counts.append(n)
        found.append([{"first": a, "end": b, "score": s} for a, b, s in own
                      if evidence(model, [(a, b, s)], n) > 0])
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()),
         pa.array(found, kind)], ["id", "score", "n_words", "passages"])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the documents that the labels cover and that it may learn from.

    Those are the rows whose id's crc32 is not 0 modulo 5. A document with several labels learns
    from its largest, so that repeated rows do not multiply.
    """
    may = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    one = labels.where(may).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return train(docs.where(may).select("doc_id", "text"), labels=one)
