"""Topics from vectors: key words, coherence, centroids, stability and the choice of k."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def term_counts(docs: DataFrame, key: str, cluster: str, tokens: str, min_df: int = 1) -> DataFrame:
    """``(key, cluster, term, n)`` of terms in at least ``min_df`` documents."""
    long = docs.select(key, cluster, F.explode(tokens).alias("term")).groupBy(key, cluster, "term").agg(F.count("*").alias("n"))
    if min_df <= 1:
        return long
    return long.join(long.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df).select("term"), "term", "left_semi")


def class_tfidf(counts: DataFrame, cluster: str, top: int = 10) -> DataFrame:
    """The ``top`` terms of each cluster by c-TF-IDF: share of the cluster's words times
    ln(1 + mean words of a cluster / uses of the term); terms ordered by score, then name."""
    per = counts.groupBy(cluster, "term").agg(F.sum("n").alias("n"))
    total = per.groupBy(cluster).agg(F.sum("n").alias("words"))
    mean = total.agg((F.sum("words") / F.count("*")).alias("mean"))
    uses = per.groupBy("term").agg(F.sum("n").alias("uses"))
    score = F.col("n") / F.col("words") * F.ln(1 + F.col("mean") / F.col("uses"))
    rows = per.join(uses, "term").join(total, cluster).join(F.broadcast(mean)).withColumn("score", F.round(score, 12))  # mean is one row
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("score"), "term"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top).select(cluster, "rank", "term", "n", "score")


def npmi(words: DataFrame, counts: DataFrame, cluster: str, key: str) -> DataFrame:
    """Mean normalised pointwise mutual information of the word pairs of all topics."""
    present = counts.select(key, "term").distinct()
    n = present.select(key).distinct().agg(F.count("*").alias("n_docs"))
    used = present.join(words.select("term").distinct(), "term", "left_semi").select(key, "term")
    df = used.groupBy("term").agg(F.count("*").alias("df"))
    both = used.toDF(key, "a").join(used.toDF(key, "b"), key).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    w = words.select(cluster, "term")
    pairs = w.toDF(cluster, "a").join(w.toDF(cluster, "b"), cluster).filter("a < b")
    rows = pairs.join(both, ["a", "b"], "left").join(df.toDF("a", "da"), "a").join(df.toDF("b", "db"), "b").crossJoin(F.broadcast(n))  # n is one row
    pij = F.coalesce("both", F.lit(0)) / F.col("n_docs")
    value = F.when(pij == 0, -1.0).when(pij == 1, 1.0).otherwise(F.ln(pij * F.col("n_docs") * F.col("n_docs") / (F.col("da") * F.col("db"))) / -F.ln(pij))
    return rows.agg(F.avg(value).alias("npmi"))


def npmi_of_rows(words: DataFrame, docs: DataFrame, cluster: str, tokens: str) -> DataFrame:
    """:func:`npmi` from each text's array of tokens: a text is reduced in its row to those of
    the few words (some ten for each cluster, one broadcast row) that it has, so its tokens are
    not shuffled.  A text without tokens doesn't count."""
    asked = words.agg(F.collect_set("term").alias("_asked"))
    own = docs.crossJoin(F.broadcast(asked)).select(F.when(F.size(tokens) > 0, F.array_sort(F.array_intersect("_asked", tokens))).alias("t"))  # one row
    each = F.transform("t", lambda a, i: F.transform(F.slice(F.col("t"), i + 2, F.size("t")), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    kinds = F.concat(F.array(F.struct(F.lit("").alias("a"), F.lit("").alias("b"))), F.transform("t", lambda x: F.struct(x.alias("a"), F.lit("").alias("b"))), F.flatten(each))
    # outer, or the optimiser would make all pairs once more to filter by their number
    counts = written(own.select(F.inline_outer(F.when(F.col("t").isNotNull(), kinds))).groupBy("a", "b").agg(F.count("*").alias("n")).filter("a is not null"), "pairs")
    n = counts.filter("a = ''").select(F.col("n").alias("n_docs"))
    df = counts.filter("a <> '' and b = ''").select(F.col("a").alias("term"), F.col("n").alias("df"))
    both = counts.filter("b <> ''").select("a", "b", F.col("n").alias("both"))
    w = words.select(cluster, "term")
    pairs = w.toDF(cluster, "a").join(w.toDF(cluster, "b"), cluster).filter("a < b")
    rows = pairs.join(both, ["a", "b"], "left").join(df.toDF("a", "da"), "a").join(df.toDF("b", "db"), "b").crossJoin(F.broadcast(n))  # n is one row
    pij = F.coalesce("both", F.lit(0)) / F.col("n_docs")
    value = F.when(pij == 0, -1.0).when(pij == 1, 1.0).otherwise(F.ln(pij * F.col("n_docs") * F.col("n_docs") / (F.col("da") * F.col("db"))) / -F.ln(pij))
    return rows.agg(F.avg(value).alias("npmi"))


def diversity(words: DataFrame) -> DataFrame:
    return words.agg((F.count_distinct("term") / F.count("*")).alias("diversity"))


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Unit mean vector of each label (a zero mean stays zero)."""
    dims = vectors.select(label, F.posexplode(vector)).groupBy(label, "pos").agg(F.avg(F.col("col").cast("double")).alias("v"))
    mean = dims.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x))
    return mean.withColumn("_n", norm).select(label, F.transform("c", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0)).alias("centroid"))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def affinity(vectors: DataFrame, cents: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """Each row's cosine to the centroid of its own label."""
    return vectors.join(cents, label).select(key, label, dot(vector, "centroid").alias("afinidad"))


def top_per_group(df: DataFrame, group: str, k: int, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def stability_level(x):
    return F.when(x >= 0.75, "estable").when(x >= 0.60, "moderada").otherwise("débil")


def choose_k(curve: DataFrame) -> DataFrame:
    """``(group, k)`` of ``curve(group, k, valid, stability)``: the largest valid k with a
    weakest topic of at least 0.75, else 0.60, else the most stable one (to nine digits;
    ties: the smallest); null without a valid k."""
    ok = F.col("valid")
    at = lambda least: F.max(F.when(ok & (F.col("stability") >= least), F.col("k")))
    most = F.max_by("k", F.when(ok, F.struct(F.round("stability", 9), -F.col("k"))))
    return curve.groupBy("group").agg(F.coalesce(at(0.75), at(0.60), most).alias("k"))


def cluster_sizes(rows: DataFrame, label: str, k: int) -> DataFrame:
    """``(label, n)`` of labels 0 to k - 1, empty ones too."""
    every = rows.sparkSession.range(k).select(F.col("id").alias(label))
    return every.join(rows.groupBy(F.col(label).cast("long").alias(label)).agg(F.count("*").alias("n")), label, "left").na.fill(0, ["n"])


def vocabulary(counts: DataFrame, key: str, large: int = 100) -> DataFrame:
    """``(term, df)`` of the terms of at least two documents, or one if there are few documents."""
    n = counts.agg(F.count_distinct(key).alias("docs"))
    df = counts.groupBy("term").agg(F.count_distinct(key).alias("df"))
    return df.join(F.broadcast(n)).filter(F.col("df") >= F.when(F.col("docs") >= large, 2).otherwise(1)).select("term", "df")  # n is one row


def vocabulary_of_rows(docs: DataFrame, tokens: str, large: int = 100) -> DataFrame:
    """:func:`vocabulary` from each text's array of tokens, of which each different one counts
    once; a text without tokens doesn't count."""
    some = docs.filter(F.size(tokens) > 0)
    n = some.agg(F.count("*").alias("docs"))
    df = some.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).filter(F.col("df") >= F.when(F.col("docs") >= large, 2).otherwise(1)).select("term", "df")  # n is one row


def nearest_elsewhere(cents: DataFrame, label: str, group: str, k: int = 2) -> DataFrame:
    """``(a, b, sim, rank)``: the k nearest centroids of other groups.  There is one centroid
    a topic, some hundreds at most, so all pairs are looked at."""
    one = cents.select(F.col(label).alias("a"), F.col(group).alias("ga"), F.col("centroid").alias("ca"))
    other = cents.select(F.col(label).alias("b"), F.col(group).alias("gb"), F.col("centroid").alias("cb"))
    pairs = one.join(other, F.col("ga") != F.col("gb")).select("a", "b", F.round(dot("ca", "cb"), 9).alias("sim"))
    return top_per_group(pairs, "a", k, F.desc("sim"), "b")


def silhouette(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """The mean cosine silhouette of a clustering, from sums of unit vectors by cluster: a
    row's mean distance to a cluster is 1 less the dot product with the cluster's mean, so no
    pairs of rows are made.  A row that is alone in its cluster counts 0."""
    norm = F.sqrt(dot(vector, vector))
    unit = vectors.select(F.col(label).alias("c"), F.transform(vector, lambda x: x.cast("double") / norm).alias("u"))
    dims = unit.select("c", F.posexplode("u").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("s"))
    sums = dims.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("s")).join(unit.groupBy("c").agg(F.count("*").alias("n")), "c")
    clusters = sums.agg(F.collect_list(F.struct("c", "n", "s")).alias("all"))  # one row a cluster
    rows = unit.join(F.broadcast(clusters))
    own = F.filter("all", lambda k: k["c"] == F.col("c"))[0]
    inner = 1 - (dot("u", own["s"]) - 1) / (own["n"] - 1)
    outer = F.array_min(F.transform(F.filter("all", lambda k: k["c"] != F.col("c")), lambda k: 1 - dot(F.col("u"), k["s"]) / k["n"]))
    rows = rows.select(F.when(own["n"] > 1, inner).alias("a"), outer.alias("b"))
    return rows.agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))


def class_tfidf_by(counts: DataFrame, cell: list[str], cluster: str, top: int = 10) -> DataFrame:
    """:func:`class_tfidf` within each cell, such as a group and a k, of ``counts(cell...,
    cluster, term, n)``."""
    per = counts.groupBy(*cell, cluster, "term").agg(F.sum("n").alias("n"))
    words = per.groupBy(*cell, cluster).agg(F.sum("n").alias("words"))
    mean = words.groupBy(*cell).agg((F.sum("words") / F.count("*")).alias("mean"))
    uses = per.groupBy(*cell, "term").agg(F.sum("n").alias("uses"))
    score = F.col("n") / F.col("words") * F.ln(1 + F.col("mean") / F.col("uses"))
    rows = per.join(uses, [*cell, "term"]).join(words.join(mean, cell), [*cell, cluster]).withColumn("score", F.round(score, 12))
    rank = F.row_number().over(Window.partitionBy(*cell, cluster).orderBy(F.desc("score"), "term"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top).select(*cell, cluster, "rank", "term", "n", "score")


#: Rows of term and text that meet in a task, about.
TERMS_AT_ONCE = 200_000


def class_tfidf_cells(counts: DataFrame, labels: DataFrame, group: str, cell: str, cluster: str, key: str, top: int = 10) -> DataFrame:
    """:func:`class_tfidf_by` of each (group, cell) of ``counts(group, key, term, n)``, each once,
    and ``labels(group, cell, key, cluster)``, which has a row of each text for each cell.

    Counts are not repeated for every cell: a text has its clusters as one array, and a task adds
    up some terms of a group for all cells and clusters as one table.  From it come the terms
    that may be among the first, of equal ones the first by name; scores and ranks are of these."""
    code = (F.shiftleft(F.col(cell).cast("long"), 32) + F.col(cluster)).alias("code")
    own = labels.groupBy(group, key).agg(F.collect_list(code).alias("codes"))
    per_text = counts.groupBy(group, key).agg(F.sum("n").alias("n"))
    words = per_text.join(own, [group, key]).select(group, F.explode("codes").alias("code"), "n").groupBy(group, "code").agg(F.sum("n").alias("words"))
    words = words.withColumn("mean", F.avg("words").over(Window.partitionBy(group, F.shiftright("code", 32))))
    lots = max(1, math.ceil(counts.count() / TERMS_AT_ONCE))
    lists = written(words.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("code", "words", "mean"))).alias("cells")), "cells").select("*", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"))
    rows = counts.join(own, [group, key]).select(group, F.pmod(F.xxhash64("term"), F.lit(lots)).cast("int").alias("lot"), "term", F.col("n").cast("long").alias("n"), "codes")
    kind = {"long": pa.int64(), "int": pa.int32(), "bigint": pa.int64()}.get(dict(counts.dtypes)[group], pa.string())

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"group": [], "code": [], "term": [], "n": [], "uses": [], "words": [], "mean": []}
        if left.num_rows and right.num_rows:
            cells = right["cells"].combine_chunks().flatten()
            codes, sizes, means = (cells.field(c).to_numpy() for c in ("code", "words", "mean"))
            term, lists, n = left["term"].combine_chunks().dictionary_encode(), left["codes"].combine_chunks(), left["n"].to_numpy()
            each = lists.value_lengths().to_numpy()
            place = np.repeat(term.indices.to_numpy().astype(np.int64), each) * len(codes) + np.searchsorted(codes, lists.flatten().to_numpy())
            table = np.bincount(place, np.repeat(n, each), len(term.dictionary) * len(codes)).reshape(-1, len(codes))
            first = np.flatnonzero(np.diff(codes >> 32, prepend=-1))
            uses = np.repeat(np.add.reduceat(table, first, 1), np.diff(first, append=len(codes)), 1)
            score = table / sizes * np.log(1 + means / np.maximum(uses, 1))
            names = np.array(term.dictionary.to_pylist(), dtype=object)
            for c in range(len(codes)):
                some = np.flatnonzero(table[:, c])
                if len(some) > top:  # scores are rounded at the twelfth place
                    some = some[score[some, c] >= np.partition(score[some, c], -top)[-top] - 4e-12]
                seen: dict[tuple, int] = {}
                for i in sorted(some, key=lambda i: names[i]):
                    one = (int(table[i, c]), int(uses[i, c]))
                    seen[one] = seen.get(one, 0) + 1
                    if seen[one] <= top:
                        for k, v in zip(out, (left[group][0].as_py(), int(codes[c]), names[i], *one, int(sizes[c]), float(means[c])), strict=True):
                            out[k].append(v)
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), (kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], [group, *list(out)[1:]])

    ddl = f"{group} {dict(counts.dtypes)[group]}, code long, term string, n long, uses long, words long, mean double"
    found = rows.groupBy(group, "lot").cogroup(lists.groupBy(group, "lot")).applyInArrow(best, ddl)
    score = F.round(F.col("n") / F.col("words") * F.ln(1 + F.col("mean") / F.col("uses")), 12)
    rank = F.row_number().over(Window.partitionBy(group, "code").orderBy(F.desc("score"), "term"))
    ranked = found.withColumn("score", score).withColumn("rank", rank).filter(F.col("rank") <= top)
    kinds = dict(labels.dtypes)
    return ranked.select(group, F.shiftright("code", 32).cast(kinds[cell]).alias(cell), F.col("code").bitwiseAND(0xFFFFFFFF).cast(kinds[cluster]).alias(cluster), "rank", "term", "n", "score")


def npmi_by(words: DataFrame, present: DataFrame, cell: list[str], group: str, cluster: str, key: str) -> DataFrame:
    """``(cell..., npmi)``: the mean over pairs of words of one cluster of their normalised
    pointwise mutual information in the texts of the cell's group.  ``words(cell..., cluster,
    term)`` with the group among the cell's columns; ``present(group, key, term)``, each once.  Pairs of a
    text are only made of words that are a pair of some cluster."""
    n = present.select(group, key).distinct().groupBy(group).agg(F.count("*").alias("n_docs"))
    w = words.select(*cell, cluster, "term")
    pairs = w.withColumnRenamed("term", "a").join(w.withColumnRenamed("term", "b"), [*cell, cluster]).filter("a < b")
    asked = pairs.select(group, "a", "b").distinct()
    used = present.join(w.select(group, "term").distinct(), [group, "term"], "left_semi")
    df = used.groupBy(group, "term").agg(F.count("*").alias("df"))
    met = used.withColumnRenamed("term", "a").join(asked, [group, "a"]).join(used.withColumnRenamed("term", "b"), [group, key, "b"])
    both = met.groupBy(group, "a", "b").agg(F.count("*").alias("both"))
    one = lambda x: df.select(group, F.col("term").alias(x), F.col("df").alias(f"d{x}"))
    rows = pairs.join(both, [group, "a", "b"], "left").join(one("a"), [group, "a"]).join(one("b"), [group, "b"]).join(n, group)
    pij = F.coalesce("both", F.lit(0)) / F.col("n_docs")
    value = F.when(pij == 0, -1.0).when(pij == 1, 1.0).otherwise(F.ln(pij * F.col("n_docs") * F.col("n_docs") / (F.col("da") * F.col("db"))) / -F.ln(pij))
    return rows.groupBy(*cell).agg(F.avg(value).alias("npmi"))


#: Dimensions of a word vector: the digits of an MD5 digest.
WORD_DIMS = 32


def word_vectors(docs: DataFrame, tokens: str, words: DataFrame, window: int = 4) -> DataFrame:
    """``(term, v)`` of the terms in ``words(term)``: positive pointwise mutual information
    with the words up to ``window`` places away, projected on WORD_DIMS numbers by the digits
    of each context word's MD5 digest.  A term that never stands beside another word has zeros.

    A token meets its own few neighbours only, and counts of (term, context) are summed
    before they are shuffled, so no text and no vocabulary is held in one task."""
    at = F.transform(tokens, lambda w, i: F.struct(w.alias("term"), F.concat(F.slice(F.col(tokens), F.greatest(i - window + 1, F.lit(1)), F.least(i, F.lit(window))), F.slice(F.col(tokens), i + 2, F.lit(window))).alias("near")))
    # outer, or the optimiser would make all these once more to filter by their number
    rows = docs.select(F.inline_outer(at)).join(words.select("term").distinct(), "term", "left_semi")
    n = written(rows.select("term", F.explode("near").alias("c")).groupBy("term", "c").agg(F.count("*").alias("n")), "contexts")
    left, right = n.groupBy("term").agg(F.sum("n").alias("nt")), n.groupBy("c").agg(F.sum("n").alias("nc"))
    total = n.agg(F.sum("n").cast("double").alias("all"))
    pmi = F.ln(F.col("n") * F.col("all") / (F.col("nt").cast("double") * F.col("nc")))
    rows = n.join(left, "term").join(right, "c").join(F.broadcast(total)).withColumn("w", pmi).filter("w > 0")  # total is one row
    digit = lambda i: F.conv(F.substring(F.md5("c"), i + 1, 1), 16, 10).cast("int") - 7.5
    sums = rows.groupBy("term").agg(F.array(*(F.round(F.sum(F.col("w") * digit(i)), 9) for i in range(WORD_DIMS))).alias("v"))
    zero = F.array(*[F.lit(0.0)] * WORD_DIMS)
    return words.select("term").distinct().join(sums, "term", "left").select("term", F.coalesce("v", zero).alias("v"))


def _cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.round(F.when(norm > 0, dot(a, b) / norm).otherwise(0.0), 9)


def diversified(candidates: DataFrame, vectors: DataFrame, cluster: list[str], top: int = 10, diversity: float = 0.3) -> DataFrame:
    """``(cluster..., rank, term)``: of each cluster's candidates ``(cluster..., rank, term)``
    the ``top`` that maximal marginal relevance picks.  First the one nearest to the mean of
    the candidates' vectors, then each time the one with most of (1 - diversity) x nearness less
    diversity x its greatest similarity with one already picked; of equal ones the better ranked.

    A cluster has some tens of candidates; they are one array, and the choice is a fold over it."""
    rows = candidates.join(vectors, "term").groupBy(*cluster).agg(F.sort_array(F.collect_list(F.struct("rank", "term", "v"))).alias("c"))
    mean = F.transform(F.sequence(F.lit(0), F.lit(WORD_DIMS - 1)), lambda i: F.aggregate("c", F.lit(0.0), lambda s, x: s + x["v"][i]) / F.size("c"))
    # written, or the optimiser would move these into the fold and compute them again in each step
    rows = written(rows.withColumn("mean", mean), "means")
    rows = rows.withColumn("near", F.transform("c", lambda x: _cosine(x["v"], F.col("mean")))).withColumn("same", F.transform("c", lambda x: F.transform("c", lambda y: _cosine(x["v"], y["v"]))))
    rows = written(rows.drop("mean"), "nearness")
    places = F.sequence(F.lit(0), F.size("c") - 1)

    def pick(chosen, _):
        worth = lambda i: F.when(F.size(chosen) == 0, F.col("near")[i]).otherwise(F.round((1 - diversity) * F.col("near")[i] - diversity * F.array_max(F.transform(chosen, lambda j: F.col("same")[i][j])), 9))
        left = F.transform(F.array_except(places, chosen), lambda i: F.struct(worth(i).alias("worth"), (-i).alias("i")))
        return F.concat(chosen, F.array(-F.array_max(left)["i"]))

    steps = F.sequence(F.lit(1), F.least(F.lit(top), F.size("c")))
    picked = rows.withColumn("picked", F.aggregate(steps, F.array().cast("array<int>"), pick))
    each = picked.select(*cluster, "c", F.posexplode("picked").alias("at", "i"))
    return each.select(*cluster, (F.col("at") + 1).alias("rank"), F.col("c")[F.col("i")]["term"].alias("term"))


def best_topics(labels: DataFrame, curve: DataFrame, group: str) -> DataFrame:
    """The labels of each group's chosen k; groups without one have no rows."""
    chosen = choose_k(curve.withColumnRenamed(group, "group")).filter("k is not null").withColumnRenamed("group", group)
    return labels.join(chosen, [group, "k"], "left_semi")


def match_stability(whole: DataFrame, part: DataFrame, key: str) -> DataFrame:
    """``(label, jaccard)``: of each cluster, as far as its rows are in the part, the best
    Jaccard with a cluster of the part, from the counts of pairs of labels."""
    both = whole.join(part.select(key, F.col("label").alias("other")), key).groupBy("label", "other").agg(F.count("*").alias("both"))
    left, right = both.groupBy("label").agg(F.sum("both").alias("nl")), both.groupBy("other").agg(F.sum("both").alias("no"))
    j = both.join(left, "label").join(right, "other").withColumn("j", F.col("both") / (F.col("nl") + F.col("no") - F.col("both")))
    return j.groupBy("label").agg(F.max("j").alias("jaccard"))


def stability_curve(vectors: DataFrame, key: str, vector: str, ks: list[int], reps: int = 20, starts: int = 20, rounds: int = 300) -> DataFrame:
    """``(k, stability, smallest, silhouette)`` of some k over all vectors as one group: see
    :func:`clusters.k_curve`, which has all of them and groups."""
    from .clusters import k_curve

    one = vectors.select(key, vector, F.lit("").alias("_group"))
    curve = k_curve(one, "_group", key, vector, k_most=max(ks), reps=reps, starts=starts, rounds=rounds).curve
    return curve.filter(F.col("k").isin(*ks)).select("k", "stability", "smallest", "silhouette")
