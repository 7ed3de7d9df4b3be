"""Toxicity by a counterfactual-regularised linear classifier.

A text's features are its distinct words and their first letters (PREFIXES of them), each
present or not. Features are chosen by chi-square over the labelled sample (at least
MIN_ROWS texts and MIN_CHI2; all that reach it, unless `max_features` bounds them) and
weighted by logistic regression. In every sentence of a labelled text that holds identity
terms, the terms are swapped for others of their kind, and the squared change of the
sentence's score (before the logistic function) is penalised, so that a mention of a group
carries no weight of its own, whatever the labels happen to hold. The kinds are a
parameter, `identity_terms`; where the texts hold none of them, there is nothing to
penalise and the fit is plain logistic regression. Model.n_swaps tells how many sentences
were swapped.

The fit takes at most `sample_rows` labelled rows, those with the lowest seeded hash of
their id, the one bound on the data it learns from; the sample is broadcast. What reaches
the driver is the sample's chosen features and the distinct changes that swaps make to
them, with their counts. Scoring is row by row over whole texts.

Defined cases: null and empty texts have no features and get the score of the bias;
labels other than 0 and 1 and null ids teach nothing; rows that label one id twice
count as toxic if any does; of documents with one id, one text teaches; without
labelled rows every score is 0.5, with rows of one class alone the smoothed share of
toxic rows; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Stage, bounded_batches

SAMPLE_ROWS = 12_000
MIN_ROWS = 3
MIN_CHI2 = 20.0
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
COUNTERFACTUAL_WEIGHT = 5.0
L2 = 1e-4
STEPS = 400
SEED = 5
#: Words whose features a worker keeps.
KEPT_WORDS = 1 << 18

#: Identity terms by kind; each is swapped for the next of its kind. Fixed values.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"), ("girl", "boy"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("muslims", "christians", "jews", "hindus", "buddhists"), ("muslim", "christian", "jewish", "hindu", "buddhist"),
    ("immigrants", "natives"), ("immigrant", "native"), ("disabled", "abled"), ("old", "young"), ("frauen", "männer"),
    ("femmes", "hommes"), ("mujeres", "hombres"),
)
_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def swaps_of(kinds) -> dict[str, str]:
    """Each term with the next of its kind."""
    return {term: kind[(k + 1) % len(kind)] for kind in kinds for k, term in enumerate(kind)}


def changes(text: str | None, swaps: dict[str, str]) -> list[tuple[frozenset, frozenset]]:
    """For each sentence with identity terms, the features that swapping them takes away and those it adds."""
    out = []
    if text and not swaps.keys().isdisjoint(words_of(text)):
        for sentence in _SENTENCE.split(text):
            own = words_of(sentence)
            if not own.isdisjoint(swaps):
                a, b = ({f for w in words for f in features_of(w)} for words in (own, {swaps.get(w, w) for w in own}))
                out.append((frozenset(a - b), frozenset(b - a)))
    return out


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    n_swaps: int = 0
    kept: dict[str, tuple] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        seen: dict[str, float] = {}
        kept, weights = self.kept, self.weights
        for word in words_of(text):
            if (own := kept.get(word)) is None:
                own = tuple((f, weights[f]) for f in features_of(word) if f in weights)
                if len(kept) < KEPT_WORDS:
                    kept[word] = own
            if own:
                seen.update(own)
        z = self.bias + sum(seen[f] for f in sorted(seen))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def __reduce__(self):
        return Model, (self.bias, self.weights, self.n_swaps)


def remainder(doc_id):
    return F.crc32(doc_id.cast("string")) % 3


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 1))
    by_id = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    taken = by_id.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")
    return found.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))


def _feature_table(sample: DataFrame, n: int, n_toxic: int, max_features: int | None) -> list[str]:
    def run(batches):
        for batch in batches:
            names, toxic = [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = {f for w in words_of(text.as_py()) for f in features_of(w)}
                names += own
                toxic += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.int32())], names=["feature", "toxic"])

    rows = sample.select("toxic", "text").mapInArrow(run, "feature string, toxic int")
    counts = rows.groupBy("feature").agg(F.count("*").cast("double").alias("n"), F.sum("toxic").cast("double").alias("t"))
    share = n_toxic / n
    expected = F.col("n") * share
    chi2 = F.pow(F.col("t") - expected, 2) / (expected * (1 - share) * (1 - F.col("n") / (n + 1)))
    best = counts.where(F.col("n") >= MIN_ROWS).withColumn("chi2", chi2).where(F.col("chi2") >= MIN_CHI2)
    ranked = best.orderBy(F.desc("chi2"), "feature").select("feature")
    return [r.feature for r in (ranked if max_features is None else ranked.limit(max_features)).collect()]


def _design(sample: DataFrame, features: list[str]) -> list:
    """By id: label and chosen features."""
    number = {f: k for k, f in enumerate(features)}

    def run(batches):
        for batch in batches:
            own = [sorted({number[f] for w in words_of(x.as_py()) for f in features_of(w) if f in number}) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int32()))], names=["doc_id", "toxic", "own"])

    schema = f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, toxic int, own array<int>"
    return sorted((tuple(r) for r in sample.select("doc_id", "toxic", "text").mapInArrow(run, schema).collect()), key=lambda r: r[0])


def _swap_table(sample: DataFrame, features: list[str], swaps: dict[str, str]) -> list[tuple]:
    """Distinct changes of chosen features by swaps, with the number of sentences of each: away, added, n."""
    number = {f: k for k, f in enumerate(features)}

    def run(batches):
        for batch in batches:
            found = [(sorted(number[f] for f in a if f in number), sorted(number[f] for f in b if f in number)) for x in batch.column(0) for a, b in changes(x.as_py(), swaps)]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], kind), pa.array([b for _, b in found], kind)], names=["away", "added"])

    rows = sample.select("text").mapInArrow(run, "away array<int>, added array<int>").groupBy("away", "added").agg(F.count("*").alias("n"))
    return [(list(r["away"]), list(r["added"]), r["n"]) for r in rows.orderBy("away", "added").collect()]


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return rows, np.array([k for x in lists for k in x], np.int64)


def solve(labels: np.ndarray, own: list, swaps: list, n_features: int, counterfactual: float = COUNTERFACTUAL_WEIGHT, l2: float = L2, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Bias and weights, by Adam over all rows; both classes weigh the same. swaps: features away, features added, number of sentences.

    Over the second half of the steps their length falls to zero: at a constant length Adam
    circles the optimum, and where it stands at the end hangs on the machine's rounding.
    """
    y = np.asarray(labels, float)
    weight = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    rows, cols = _flat(own)
    p_rows, p_cols = _flat([a for a, _, _ in swaps])
    q_rows, q_cols = _flat([b for _, b, _ in swaps])
    share = np.array([n for _, _, n in swaps], float)
    share /= max(1.0, share.sum())
    params, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        w, n = params[:-1], len(y)
        z = params[-1] + np.bincount(rows, w[cols], n)
        r = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.append(np.bincount(cols, r[rows], n_features) + l2 * w, r.sum())
        if swaps:
            d = 2 * counterfactual * share * (np.bincount(p_rows, w[p_cols], len(swaps)) - np.bincount(q_rows, w[q_cols], len(swaps)))
            grad[:-1] += np.bincount(p_cols, d[p_rows], n_features) - np.bincount(q_cols, d[q_rows], n_features)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        length = 0.05 * min(1.0, 2 * (1 - (step - 1) / steps))
        params = params - length * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return float(params[-1]), params[:-1]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, counterfactual: float = COUNTERFACTUAL_WEIGHT, identity_terms=IDENTITY_TERMS, max_features: int | None = None) -> Model:
    bounded_batches(docs.sparkSession)
    stage = Stage(docs.sparkSession, "toxic")
    sample = stage.write(_sample(docs, labels, sample_rows))
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < n:
        share = (toxic + 1) / (n + 2)
        return Model(float(np.log(share / (1 - share))), {})
    features = _feature_table(sample, n, toxic, max_features)
    rows, swaps = _design(sample, features), _swap_table(sample, features, swaps_of(identity_terms))
    stage.keep()
    bias, weights = solve(np.array([r[1] for r in rows]), [r[2] for r in rows], swaps, len(features), counterfactual)
    return Model(bias, {f: float(w) for f, w in zip(features, weights) if w}, sum(n for _, _, n in swaps))


def scorer(model: Model):
    """A column function: the score of a text."""

    @F.arrow_udf("double")
    def toxicity(text: pa.Array) -> pa.Array:
        return pa.array([model.score(x.as_py()) for x in text], pa.float64())

    return toxicity


def score_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels, sample_rows)
    scored = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
