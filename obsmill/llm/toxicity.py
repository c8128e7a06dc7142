"""Toxicity: cumulative-link ordinal regression of severity grades on sparse text features.

P(grade <= j) = logistic(threshold_j - w.x): one weight vector for all ordered thresholds. Features
are the hashed words of a text and their first bytes (runs of a few lengths, so that inflected forms
meet), each present or not. Weights have an L1 penalty, which leaves few of them, and none is under
zero: no length of harmless text makes up for abuse. The model is fitted on a bounded sample of labelled rows; every text is scored whole.

Labels may be grades 0, 1, 2, ... or just 0 and 1. Rows labelled 1 are then graded 1 or 2 by how
many words they hold whose odds in such rows are far above those in others: 2 from the median on.

The expected severity is the mean grade; a text is toxic when the probability of a grade of 1 or
more reaches ``cut``. Null and empty texts have no features and get the model's base severity. Repeated rows are
scored each on its own. Labels without an id, a value or a document don't count; of several labels
of an id the highest does. Without labels of both kinds every severity is 0. Bytes are hashed as
they are. Other columns aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsmill.llm.common import U64, hash_spans, mix, offsets_list, raw, slices, spans, tidy

#: Labelled rows of each value that the model is fitted on at most, those of the least hashed ids.
SAMPLE = 5000
BUCKETS = 1 << 19
#: First bytes that stand for a word besides the word.
STEMS = (4, 5)
#: Fitting: least sample texts with a feature, L1 penalty, steps.
LEAST, PENALTY, STEPS = 3, 5e-4, 150
#: Standard deviations by which a feature's texts must be labelled more often than others.
SURE = 3.5
#: Log odds of a word that marks a labelled text.
STRONG = 2.5


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # rising
    weights: np.ndarray
    thresholds: np.ndarray  # rising; one fewer than grades

    def grades(self, score: np.ndarray) -> np.ndarray:
        """Probabilities, texts x grades."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None] - score[:, None], -40, 40)))
        return np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1))


def features(data: np.ndarray, at: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and rows (from i) of the features of rows i..j, not yet distinct."""
    low, start, end, first = spans(data, at, i, j)
    # punctuation around a word isn't part of it
    visible = _INNER[low]
    for _ in range(3):
        start = start + (~visible[start] & (end - start > 1))
        end = end - (~visible[end - 1] & (end - start > 1))
    size = end - start
    row = np.repeat(np.arange(j - i), np.diff(first))
    found, rows = [hash_spans(low, start, size)], [row]
    for n in STEMS:
        longer = size > n
        found.append(mix(hash_spans(low, start[longer], np.full(int(longer.sum()), n)) + U64(n)))
        rows.append(row[longer])
    return (np.concatenate(found) % U64(BUCKETS)).astype(np.int32), np.concatenate(rows)


_INNER = np.ones(256, bool)
_INNER[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = False


def _distinct(bucket: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row.astype(np.int64) * BUCKETS + bucket)
    return (key % BUCKETS).astype(np.int32), np.searchsorted(key, np.arange(n + 1) * BUCKETS)


def fit_rows(index: np.ndarray, to: np.ndarray, label: np.ndarray) -> Model:
    """Fits on rows of distinct features index[to[i]:to[i + 1]]; label is a grade."""
    row = np.repeat(np.arange(len(label)), np.diff(to))
    df = np.bincount(index, minlength=BUCKETS)
    share = (label > 0).mean()
    sure = np.bincount(index, label[row] > 0, BUCKETS) - df * share >= SURE * np.sqrt(df * share * (1 - share))
    sure &= df >= LEAST
    used = np.flatnonzero(sure)
    keep = sure[index]
    index, row = np.searchsorted(used, index[keep]), row[keep]
    if label.max() == 1:
        hit = np.bincount(index, label[row], len(used))
        rest = np.bincount(index, minlength=len(used)) - hit
        odds = np.log((hit + 0.1) / ((label == 1).sum() + 1)) - np.log((rest + 0.1) / ((label == 0).sum() + 1))
        strong = np.bincount(row, (odds >= STRONG)[index], len(label))
        some = strong[(label == 1) & (strong > 0)]
        label = np.where((label == 1) & (strong >= max(2, np.median(some) if len(some) else 2)), 2, label)
    n_grades = int(label.max()) + 1
    share = np.clip(np.cumsum(np.bincount(label, minlength=n_grades))[:-1] / len(label), 1e-3, 1 - 1e-3)
    theta = np.log(share / (1 - share))
    theta[1:] = np.log(np.maximum(np.diff(theta), 0.1))  # thresholds as a first one and log steps
    w, sum_w, sum_t = np.zeros(len(used)), np.full(len(used), 1e-8), np.full(len(theta), 1e-8)
    n = len(label)
    for _ in range(STEPS):
        cut = np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))])
        score = np.bincount(row, w[index], n)
        f = 1 / (1 + np.exp(-np.clip(np.concatenate([[-np.inf], cut, [np.inf]])[None] - score[:, None], -40, 40)))
        f[:, 0], f[:, -1] = 0, 1
        upper, lower = f[np.arange(n), label + 1], f[np.arange(n), label]
        p = np.maximum(upper - lower, 1e-9)
        d_score = -(upper + lower - 1) / n  # of the mean negative log likelihood
        g = np.bincount(index, d_score[row], len(used))
        slope = f * (1 - f)
        d_cut = np.zeros(n_grades + 1)
        np.add.at(d_cut, label + 1, -slope[np.arange(n), label + 1] / p / n)
        np.add.at(d_cut, label, slope[np.arange(n), label] / p / n)
        d_cut = d_cut[1:-1]
        d_theta = np.array([d_cut.sum(), *(np.exp(theta[k]) * d_cut[k:].sum() for k in range(1, len(theta)))])
        sum_w += g * g
        sum_t += d_theta * d_theta
        rate = 0.5 / np.sqrt(sum_w)
        w = w - rate * g
        w = np.maximum(w - rate * PENALTY, 0)
        theta = theta - 0.2 * d_theta / np.sqrt(sum_t)
    live = w != 0
    return Model(used[live].astype(np.int64), w[live], np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))]))


def fit(docs: DataFrame, labels: DataFrame, *, grade_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """A model, or none without labels of two kinds."""
    known = labels.where(F.col(id_col).isNotNull() & (F.col(grade_col) >= 0)).groupBy(F.col(id_col).alias("id")).agg(F.max(grade_col).cast("int").alias("grade"))
    rest = known.where("grade = 0").orderBy(F.xxhash64("id"), "id").limit(sample)
    some = rest.union(known.where("grade > 0").orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id").select("id", "grade", "text")

    def run(batches):
        for b in batches:
            data, at = raw(b.column(2))
            for i, j in slices(at):
                bucket, to = _distinct(*features(data, at, i, j), j - i)
                yield pa.record_batch([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), offsets_list(bucket, to)], ["id", "grade", "f"])

    # two times the sample at most; a row of an id counts once
    found = rows.mapInArrow(tidy(run), f"id {docs.schema[id_col].dataType.simpleString()}, grade int, f array<int>").dropDuplicates(["id"]).toArrow()
    label = found.column("grade").to_numpy()
    if not len(label) or label.min() > 0 or label.max() == 0:
        return None
    order = np.argsort(found.column("id").to_numpy(), kind="stable")
    lists = found.column("f").combine_chunks().take(pa.array(order))
    sizes = np.asarray(pa.compute.list_value_length(lists))
    return fit_rows(np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(sizes)]), label[order])


class Scorer:
    """Grade probabilities of rows i..j of a text column."""

    def __init__(self, model: Model | None):
        self.model, self.weights = model, np.zeros(BUCKETS)
        if model:
            self.weights[model.features] = model.weights

    def __call__(self, data: np.ndarray, at: np.ndarray, i: int, j: int) -> np.ndarray:
        n = j - i
        if not self.model:
            return np.ones((n, 1))
        bucket, row = features(data, at, i, j)
        met = self.weights[bucket] != 0
        bucket, to = _distinct(bucket[met], row[met], n)
        return self.model.grades(np.bincount(np.repeat(np.arange(n), np.diff(to)), self.weights[bucket], n))


def score_documents(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.4) -> DataFrame:
    """Per row: id_col, severity (expected grade), grade (likeliest), toxic."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            data, at = raw(b.column(1))
            for i, j in slices(at):
                p = scorer(data, at, i, j)
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(1), pa.int32()), pa.array(1 - p[:, 0] >= cut)], ["id", "severity", "grade", "toxic"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(tidy(run), f"id {kind}, severity double, grade int, toxic boolean").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model | None, *, text_col: str = "text", cut: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose text isn't toxic, with their columns."""
    where = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            data, at = raw(b.column(where))
            for i, j in slices(at):
                keep = 1 - scorer(data, at, i, j)[:, 0] < cut
                yield b.slice(i, j - i).filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), docs.schema)
