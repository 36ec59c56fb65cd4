"""Language identification by nearest centroid.

Texts become L2-normalised TF-IDF vectors of hashed letter n-grams (one to three letters,
word edges included).  Each language has several centroids from spherical k-means over a
bounded sample of its labelled rows; a text takes the language of the centroid with the
largest cosine, and is rejected when its cosine distance is far beyond what the language's
own rows have at that length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_texts, extended, held_out, share_by_hash, staged

DIMS = 1 << 13
UNKNOWN = "und"
#: Up to so many languages their shares are broadcast; with more, rows are joined by language.
BROADCAST_LANGUAGES = 10_000
#: Letters of the basic plane as their lower-case form, everything else as a space.
_FOLD = np.array([ord(low) if (c := chr(i)).isalpha() and len(low := c.lower()) == 1 else i if c.isalpha() else 32 for i in range(0x10000)], np.uint32)
_GRAM_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _fold(text: bytes) -> np.ndarray:
    """Code points with letters in lower case and each run of anything else as one space."""
    cp = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    high = cp >= 0x10000
    out = _FOLD[np.where(high, 32, cp)]
    if high.any():
        out[high] = [c if chr(c).isalpha() else 32 for c in cp[high]]
    out = np.concatenate(([np.uint32(32)], out, [np.uint32(32)])).astype(np.uint32)
    return out[(out != 32) | (np.concatenate(([0], out[:-1])) != 32)]


def gram_counts(text: bytes) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text; None if it has no letter."""
    s = _fold(text)
    if len(s) < 3:
        return None
    counts = np.zeros(DIMS, np.float32)
    for i in range(0, len(s), 1 << 20):  # long texts in blocks that overlap by two
        b = s[i : i + (1 << 20) + 2]
        one, two = b[:-2] * _GRAM_MUL[0], b[1:-1] * _GRAM_MUL[1]
        whole = (b[:-2] != 32) & (b[1:-1] != 32)
        grams = (one[b[:-2] != 32], (one + two)[whole] ^ np.uint32(0x5BD1E995), (one + two + b[2:] * _GRAM_MUL[2])[(b[1:-1] != 32)])
        for k, g in enumerate(grams):
            g = g ^ (g >> np.uint32(15))
            g = g * np.uint32(0x2C1B3C6D + 2 * k)
            counts += np.bincount(g >> np.uint32(19), minlength=DIMS).astype(np.float32)
    return counts


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / max(float(np.linalg.norm(v)), 1e-12)


def _features(batches):
    for batch in batches:
        for first, texts in batches_of_texts(batch.column(1)):
            lang, idx, val = [], [], []
            for i, t in enumerate(texts):
                c = gram_counts(t)
                if c is not None:
                    at = np.flatnonzero(c)
                    lang.append(batch.column(0)[first + i].as_py())
                    idx.append(at.astype(np.int32))
                    val.append(c[at])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], names=["lang", "idx", "val"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 1) -> np.ndarray:
    """Unit centroids of unit rows, seeded by farthest points; empty ones are dropped."""
    k = min(k, len(x))
    at = [int(np.random.default_rng(seed).integers(len(x)))]
    near = x @ x[at[0]]
    while len(at) < k:
        at.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[at[-1]])
    c = x[at]
    for _ in range(rounds):
        who = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[who == j].sum(axis=0) for j in range(len(c)) if (who == j).any()])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Centroids:
    """A fitted model: unit centroids, their language, each language's usual cosine, IDF."""

    def __init__(self, langs: list[str], vectors: np.ndarray, usual: np.ndarray, idf: np.ndarray):
        self.langs, self.vectors, self.usual, self.idf = langs, vectors, usual, idf

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        """(language, score, accepted)"""
        counts = gram_counts(text)
        if counts is None or not self.langs:
            return UNKNOWN, 0.0, False
        cos = self.vectors @ weigh(counts, self.idf)
        best = {}
        for lang, c in zip(self.langs, cos):
            best[lang] = max(best.get(lang, -1.0), float(c))
        lang = max(best, key=lambda x: (best[x], x))
        e = {x: np.exp(20 * (c - best[lang])) for x, c in best.items()}
        usual = float(self.usual[self.langs.index(lang)])
        rejected = best[lang] < 0.3 * usual * min(1.0, (float(counts.sum()) / 1000) ** 0.5)
        return lang, float(1 / sum(e.values())), not rejected


def fit(docs: DataFrame, per_language: int = 400, clusters: int = 4) -> Centroids:
    """Learn from rows with a language that are not held out.  ``per_language`` bounds the
    expected number of sampled rows of a language (chosen by hash of the id); the n-gram
    statistics and centroids are computed by Spark, and only the IDF vector and
    ``clusters`` centroids of each language come back.  Repeated rows count each; rows
    without a doc_id aren't learned from.  No labelled rows: an empty model."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    share = staged(rows.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share")), "language_shares")
    if share.count() <= BROADCAST_LANGUAGES:
        share = F.broadcast(share)
    sample = rows.join(share, "lang").filter(share_by_hash("doc_id") < F.col("share")).select("lang", "text")
    feats = staged(sample.mapInArrow(_features, "lang string, idx array<int>, val array<float>"), "language_sample")
    n_docs, frequency = 0, np.zeros(DIMS)
    for r in feats.select(F.explode(F.concat(F.col("idx"), F.array(F.lit(DIMS)))).alias("i")).groupBy("i").count().collect():
        if r["i"] == DIMS:
            n_docs = r["count"]
        else:
            frequency[r["i"]] = r["count"]
    idf = (np.log((1 + n_docs) / (1 + frequency)) + 1).astype(np.float32)

    def cluster(key, group):
        x = np.zeros((len(group), DIMS), np.float32)
        for row, (i, v) in enumerate(zip(group["idx"], group["val"])):
            x[row, i] = v
            x[row] = weigh(x[row], idf)
        c = spherical_kmeans(x, clusters)
        usual = float(np.median((x @ c.T).max(axis=1)))
        import pandas as pd

        return pd.DataFrame({"lang": [key[0]] * len(c), "vector": list(c), "usual": [usual] * len(c)})

    got = sorted(feats.groupBy("lang").applyInPandas(cluster, "lang string, vector array<float>, usual double").collect(), key=lambda r: (r["lang"], r["vector"]))
    vectors = np.array([r["vector"] for r in got], np.float32).reshape(len(got), DIMS)
    return Centroids([r["lang"] for r in got], vectors, np.array([r["usual"] for r in got]), idf)


def predict(docs: DataFrame, model: Centroids) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``accepted``.  Only the text is
    looked at.  A null text or one without a letter: ``und``, 0.0, not accepted.  Ties go to
    the last language by name.  Columns named like a new one are replaced, others pass
    through; repeated rows are judged each, an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x clusters x DIMS floats
    base = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    at = base.index("text")

    def run(batches):
        for batch in batches:
            for first, texts in batches_of_texts(batch.column(at)):
                got = [sent.value.predict(t) for t in texts]
                cols = [c.slice(first, len(texts)) for c in batch.columns]
                lang, score, ok = zip(*got)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], names=[*base, "lang_pred", "score", "accepted"])

    src = docs.select(*[F.col(f"`{c}`") for c in base])
    schema = extended(src.schema, "lang_pred string, score double, accepted boolean")
    return src.mapInArrow(run, schema)
