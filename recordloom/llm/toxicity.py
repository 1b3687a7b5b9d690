"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained with numpy from confirmed toxic documents (P) and unlabelled ones (U). With the class
prior p the risk of a score f is ``p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)])`` for the logistic loss l: the
unlabelled documents stand for the negatives once the positives among them are taken out, and where that difference
falls below zero, which only overfitting does, a step goes back up. The prior is the toxic share among the rows whose
label is known. Weights are kept sparse by an L1 penalty, so that only words that matter count, in texts of any length.

Features are the distinct words of a text, in lower case, and their beginnings of three to six letters, hashed into
``WIDTH`` numbers, each at the levels of one, two and three distinct words that share it: several words of one family
say more than one. The features that stand out among P are used. The model is fitted on a bounded sample (``max_positive`` and ``max_unlabelled`` rows are aimed at,
picked by the hash of the id; an input below those bounds is taken whole); every row is scored on its whole text.

Defined results. A null or empty text, or one without words, has no features and the score of the bias alone. Without
any confirmed toxic row to learn from, all scores are 0. A null id is in fold 0. Labels other than 1 say nothing but
for the prior; of several labels for an id the greatest counts. Equal rows get equal scores; an empty table gives an
empty result; further columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, cut, id_fold, map_batches, table

WIDTH = 1 << 18
LEVELS = 3
_WORD = re.compile(r"[^\W\d_]+")


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode()) % WIDTH


def word_features(word: str) -> tuple[int, ...]:
    return (_hash(f"={word}"), *(_hash(word[:n]) for n in (3, 4, 5, 6) if len(word) >= n))


def with_levels(hashes) -> list[int]:
    """The numbers of features at each level that their counts reach, sorted."""
    counts = Counter(hashes)
    return sorted(h + level * WIDTH for h, n in counts.items() for level in range(min(n, LEVELS)))


def text_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _features(memo: Memo, text: str | None) -> list[int]:
    return with_levels(chain.from_iterable(map(memo.__getitem__, text_words(text))))


def _count_features(batches):
    """How many texts of a partition have each feature, among the positives and among the unlabelled."""
    memo, counts = Memo(word_features), np.zeros((2, LEVELS * WIDTH), np.int64)
    for batch in batches:
        for positive, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts[int(not positive), _features(memo, text.as_py())] += 1
    some = np.flatnonzero(counts.sum(0))
    arrays = [pa.array(some, pa.int64()), pa.array(counts[0, some], pa.int64()), pa.array(counts[1, some], pa.int64())]
    yield pa.RecordBatch.from_arrays(arrays, names=["feature", "p", "u"])


def _chosen_features(chosen):
    def make():
        memo, known = Memo(word_features), set(chosen.value.tolist())

        def work(cols):
            found = [[f for f in _features(memo, t) if f in known] for t in cols["_text"]]
            return {"positive": cols["positive"], "features": found}

        return work

    return make


@dataclass
class Classifier:
    bias: float
    weights: dict[int, float]

    def scorer(self):
        """A function from a text to its score. Words without any weighted feature drop out in a bounded memo."""
        weighted = {f % WIDTH for f in self.weights}
        memo = Memo(lambda word: tuple(f for f in word_features(word) if f in weighted))

        def score(text: str | None) -> float:
            found = _features(memo, text)
            logit = self.bias + sum(self.weights.get(f, 0.0) for f in found)
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, logit))))

        return score


def screened(p_count: np.ndarray, u_count: np.ndarray, np_: int, nu: int, lift: float = 2.0, sigmas: float = 4.0) -> np.ndarray:
    """Where counts among the positives stand out from those among the unlabelled: without the rest little can overfit."""
    p, u = p_count / np_, u_count / nu
    floor = np.maximum(u, 1 / nu)
    z = (p - u) / np.sqrt(floor * (1 - np.minimum(floor, 0.999)) * (1 / np_ + 1 / nu))
    return (p >= lift * u) & (p_count >= 3) & (z >= sigmas)


def sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -50, 50)))


def remainder(fp: np.ndarray, fu: np.ndarray, prior: float) -> float:
    """The risk of the negatives: that of the unlabelled less the share of the positives among them."""
    return np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()


def risk_slopes(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the risk by the scores of the positives and of the unlabelled.

    A negative remainder is undone instead of followed: the slopes are then those of its negative alone.
    """
    up, down_p, down_u = (sigmoid(fp) - 1) * prior / len(fp), -sigmoid(fp) * prior / len(fp), sigmoid(fu) / len(fu)
    return (up + down_p, down_u) if remainder(fp, fu, prior) >= 0 else (-down_p, -down_u)


def fit_nnpu(
    known: np.ndarray, positive: list, unlabelled: list, prior: float, steps: int = 2000, rate: float = 0.5, l1: float = 8e-4
) -> Classifier:
    """``known``: sorted feature numbers, of which every row has some. Steps of AdaGrad over both samples whole, with soft thresholding.

    A text without any feature that stands out is no likelier toxic than the prior, so the bias stays at its log-odds
    or below.
    """
    width = len(known)

    def matrix(rows):
        """(row, column) of each feature that occurs."""
        at = np.searchsorted(known, np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]))
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), at

    (row_p, col_p), (row_u, col_u) = matrix(positive), matrix(unlabelled)
    np_, nu = len(positive), len(unlabelled)
    most = float(np.log(prior / (1 - prior)))
    w, b = np.zeros(width), most
    sums, sum_b = np.full(width, 1e-12), 1e-12

    for _ in range(steps):
        fp = np.bincount(row_p, weights=w[col_p], minlength=np_) + b
        fu = np.bincount(row_u, weights=w[col_u], minlength=nu) + b
        gp, gu = risk_slopes(fp, fu, prior)
        g = np.bincount(col_p, weights=gp[row_p], minlength=width) + np.bincount(col_u, weights=gu[row_u], minlength=width)
        gb = gp.sum() + gu.sum()
        sums, sum_b = sums + g * g, sum_b + gb * gb
        step = rate / np.sqrt(sums)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b = min(most, b - rate / np.sqrt(sum_b) * gb)
    return Classifier(float(b), {int(known[i]): float(w[i]) for i in np.flatnonzero(w)})


def _share(count: int, aim: int) -> float:
    return 1.0 if count <= aim else aim / count


def _picked(id_col: Column, share: float) -> Column:
    """Whether the hash of an id falls into the first ``share`` of its range."""
    return F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
    max_positive: int = 4000, max_unlabelled: int = 12000, prior: float | None = None,
) -> Classifier | None:
    """Fit on rows of ``docs`` and ``labels``; None if there is nothing confirmed to learn from."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
    known = known.agg(F.max(F.col(label_col)).alias("label"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("label") == 1).cast("int")), F.lit(0))).first()
    if not toxic:
        return None
    prior = min(max(prior or toxic / n, 1e-3), 0.9)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_id is not null")
    share_p, share_u = _share(toxic, max_positive), _share(docs.count(), max_unlabelled)
    # At most about max_positive ids, so they can be sent to every task.
    confirmed = known.where((F.col("label") == 1) & _picked(F.col("_id"), share_p)).select("_id")
    held = F.broadcast(confirmed) if toxic * share_p <= 2 * max_positive else confirmed
    p = rows.join(held, "_id").withColumn("positive", F.lit(True))
    u = rows.where(_picked(F.col("_id"), share_u)).withColumn("positive", F.lit(False))
    # Of equal texts one is enough, so that a text copied thousands of times is not learned by heart.
    sample = p.unionAll(u).select("positive", "_text", F.md5(F.coalesce("_text", F.lit("")).cast("binary")).alias("same"))
    sample = cut(sample.dropDuplicates(["positive", "same"]).select("positive", "_text"))
    counts = sample.mapInArrow(_count_features, "feature long, p long, u long").groupBy("feature")
    table_ = counts.agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where("p >= 3").toArrow()  # at most LEVELS * WIDTH rows
    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    if len(sizes) < 2:
        return None
    feature, p_count, u_count = (table_.column(c).to_numpy() for c in ("feature", "p", "u"))
    known = np.sort(feature[screened(p_count, u_count, sizes[True], sizes[False])])
    chosen = docs.sparkSession.sparkContext.broadcast(known)
    rows = map_batches(sample, _chosen_features(chosen), "positive boolean, features array<int>").collect()
    rows.sort(key=lambda r: r["features"])  # sums of floats depend on the order
    return fit_nnpu(known, *([r["features"] for r in rows if r["positive"] == side] for side in (True, False)), prior)


def score_texts(df: DataFrame, id_col: str, text_col: str, model: Classifier | None) -> DataFrame:
    """The id and ``score`` of every row."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        score = sent.value.scorer() if sent.value else lambda text: 0.0
        return lambda cols: {"_id": cols["_id"], "score": list(map(score, cols["_text"]))}

    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return map_batches(rows, make, f"_id {kind}, score double").withColumnRenamed("_id", id_col)


def keep_by_score(df: DataFrame, text_col: str, model: Classifier | None, threshold: float = 0.3) -> DataFrame:
    """The rows of ``df`` whose text scores below ``threshold``, with their columns as they are."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = sent.value.scorer() if sent.value else lambda text: 0.0
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([score(t.as_py()) < threshold for t in texts], pa.bool_()))

    return df.mapInArrow(run, df.schema)


LEARN_FOLDS, HELD_OUT = 4, 2


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from three of four folds of ids."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = id_fold(F.col("doc_id"), LEARN_FOLDS) == HELD_OUT
    model = train(docs.where(~held), labels.where(~held), "doc_id", "text", "toxic")
    scored = score_texts(docs, "doc_id", "text", model)
    return scored.select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted")
    )
