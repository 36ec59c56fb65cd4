"""Quality scores by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear model of text-form features by the
non-negative unbiased risk

    pi * R_p(+)  +  max(0, R_u(-) - pi * R_p(-))

with a class prior ``pi`` estimated from positives and unlabelled rows alone: no row labelled
negative is looked at.  Where the second term turns negative, its gradient is
reversed, so the model can't win by fitting the positives out of the unlabelled rows.
Features are frequencies of pairs of neighbouring character classes and a few shares of
words and lines; neither label, language, source nor id is looked at by a score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_texts, extended, hash_words, held_out, share_by_hash

#: Character classes: each printable mark of ASCII its own, then digits, capitals, small
#: letters, vowels of them, spaces, line ends, other letters, anything else.
CLASSES = 48
_CLASS = np.full(256, 47, np.uint16)
for _i, _c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[ord(_c)] = _i
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 33, 34, 35
for _c in "aeiou":
    _CLASS[ord(_c)] = 36
_CLASS[32], _CLASS[[9, 11, 12, 13]], _CLASS[10], _CLASS[0xC0:0x100], _CLASS[0x80:0xC0] = 37, 38, 39, 40, 41
PAIRS = CLASSES * CLASSES
DENSE = 6
DIMS = PAIRS + DENSE
FAR = 5.0
BLOCK = 1 << 20


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a whole text: places and values."""
    buf = np.frombuffer(text, np.uint8)
    counts = np.zeros(PAIRS)
    for i in range(0, max(0, len(buf) - 1), BLOCK):
        c = _CLASS[buf[i : i + BLOCK + 1]]
        counts += np.bincount(c[:-1] * CLASSES + c[1:], minlength=PAIRS)
    total = counts.sum()
    at = np.flatnonzero(counts)
    value = np.sqrt(counts[at] / max(1.0, total))
    h, _ = hash_words(buf)
    n = len(h)
    three = h[: max(0, n - 2)] * np.uint64(3) + h[1 : max(1, n - 1)][: max(0, n - 2)] * np.uint64(5) + h[2:] * np.uint64(7) if n > 2 else h[:0]
    lines = [x for x in text.split(b"\n") if x.strip()]
    dense = np.array(
        [
            1.0 - len(np.unique(h)) / n if n else 0.0,
            1.0 - len(np.unique(three)) / len(three) if len(three) else 0.0,
            1.0 - len(set(lines)) / len(lines) if lines else 0.0,
            min(1.0, len(buf) / n / 20) if n else 0.0,
            np.log1p(n) / 10,
            float(n < 5),
        ]
    )
    return np.concatenate([at, PAIRS + np.arange(DENSE)]).astype(np.int32), np.concatenate([value, dense]).astype(np.float32)


def _rows(batches):
    for batch in batches:
        for first, texts in batches_of_texts(batch.column(2)):
            got = [features(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32()))],
                names=["id", "positive", "idx", "val"],
            )


def nn_pu(pos: np.ndarray, unl: np.ndarray, prior: float, rounds: int = 300, rate: float = 0.01, decay: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model with the logistic loss, by full-batch steps."""
    w, b = np.zeros(pos.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sig = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
    for t in range(1, rounds + 1):
        zp, zu = pos @ w.astype(pos.dtype) + b, unl @ w.astype(unl.dtype) + b
        sp, su = sig(zp), sig(zu)
        # the loss of calling a row positive falls with slope s - 1, of calling it negative rises with s
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = prior * (sp - 1) / len(pos), np.zeros(len(unl))
        if negative >= 0:
            gp, gu = gp - prior * sp / len(pos), su / len(unl)
        else:
            gp, gu = prior * sp / len(pos), -su / len(unl)
        g = np.append(gp.astype(pos.dtype) @ pos + gu.astype(unl.dtype) @ unl + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


class Model:
    """A linear model of features that are standardised and cut off at +-FAR."""

    def __init__(self, weights: np.ndarray, bias: float, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.mean, self.scale = weights, mean, scale
        self.absent = np.clip(-mean * scale, -FAR, FAR) * weights  # of features that a text lacks
        self.bias = bias + float(self.absent.sum())

    def score(self, text: bytes) -> float:
        at, value = features(text)
        z = np.clip((value - self.mean[at]) * self.scale[at], -FAR, FAR) * self.weights[at] - self.absent[at]
        return float(1 / (1 + np.exp(-np.clip(float(z.sum()) + self.bias, -30, 30))))


def class_prior(pos: np.ndarray, unl: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives among unlabelled rows, from scores of rows that the scores
    weren't fitted to.  Above any threshold lie at least as many unlabelled rows as their
    positives alone would put there, so the ratio of both shares is never below the prior;
    it is taken where its upper confidence bound is least (best bin estimation)."""
    cuts = np.unique(pos)
    share_p = 1 - np.searchsorted(np.sort(pos), cuts, "left") / len(pos)
    share_u = 1 - np.searchsorted(np.sort(unl), cuts, "left") / len(unl)
    slack = sum(math.sqrt(math.log(4 / doubt) / (2 * len(x))) for x in (pos, unl))
    at = np.argmin((share_u + slack) / share_p)
    return float(min(0.99, max(0.01, share_u[at] / share_p[at])))


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, prior: float | None = None) -> Model:
    """Learn from documents that are not held out.  ``most`` bounds the expected number of
    sampled positives (label 1) and of sampled unlabelled rows, by hash of the id; these
    bounded rows are fitted in one task, only the weights come back.  The class prior is
    estimated by halves: a model of one half scores the other.  A doc_id with labels 1 and 0
    isn't trusted; repeated labels count once, repeated documents each; rows without a
    doc_id aren't learned from.  Without positives the model scores every text 0.5."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null").filter(~held_out())
    good = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
    good = good.filter("least = 1 and most = 1").select("doc_id")
    n_good, n_rows = good.filter(~held_out()).count(), rows.count()
    if not n_good or not n_rows:
        return Model(np.zeros(DIMS), 0.0, np.zeros(DIMS), np.zeros(DIMS))
    pos = rows.join(good.filter(share_by_hash("doc_id", 1) < min(1.0, most / n_good)), "doc_id").withColumn("positive", F.lit(True))
    unl = rows.filter(share_by_hash("doc_id", 2) < min(1.0, most / n_rows)).withColumn("positive", F.lit(False))
    sample = pos.unionByName(unl).select(F.col("doc_id").alias("id"), "positive", "text").mapInArrow(_rows, "id long, positive boolean, idx array<int>, val array<float>")

    def train(group):
        import pandas as pd

        group = group.assign(first=[v[0] if len(v) else 0 for v in group["val"]]).sort_values(["positive", "id", "first"])
        x = np.zeros((len(group), DIMS), np.float32)
        for i, (at, v) in enumerate(zip(group["idx"], group["val"])):
            x[i, at] = v
        is_pos = group["positive"].to_numpy(bool)
        (weights, mean, scale), bias = np.zeros((3, DIMS)), 0.0
        if is_pos.any() and not is_pos.all():
            used = np.flatnonzero((x != 0).mean(axis=0) >= 0.002)
            x = x[:, used]
            mean[used], scale[used] = x.mean(axis=0), 1 / np.maximum(x.std(axis=0), 0.01)
            x = np.clip((x - mean[used].astype(x.dtype)) * scale[used].astype(x.dtype), -FAR, FAR)
            pos, unl, pi = x[is_pos], x[~is_pos], prior
            if pi is None:
                w, b = nn_pu(pos[::2], unl[::2], 0.5)
                pi = class_prior(*(part[1::2] @ w.astype(x.dtype) + b for part in (pos, unl))) if min(len(pos), len(unl)) > 1 else 0.5
            weights[used], bias = nn_pu(pos, unl, pi)
        return pd.DataFrame({"weights": [list(weights)], "bias": [float(bias)], "mean": [list(mean)], "scale": [list(scale)]})

    got = sample.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(train, "weights array<double>, bias double, mean array<double>, scale array<double>").first()
    return Model(np.array(got["weights"]), got["bias"], np.array(got["mean"]), np.array(got["scale"]))


def score(docs: DataFrame, model: Model, to: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of each whole text; a null text is empty, and an
    empty text has a score like any other.  A column named ``to`` is replaced, others pass
    through; repeated rows are scored each, an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMS doubles
    base = [c for c in docs.columns if c != to]
    at = base.index("text")
    src = docs.select(*[F.col(f"`{c}`") for c in base])

    def run(batches):
        for batch in batches:
            for first, texts in batches_of_texts(batch.column(at)):
                got = pa.array([sent.value.score(t) for t in texts], pa.float64())
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(texts)) for c in batch.columns), got], names=[*base, to])

    return src.mapInArrow(run, extended(src.schema, f"`{to}` double"))
