"""Topic models, density clustering, scoring, store, audit and stream against brute force."""

import math
import sys
import threading
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sondeo.functions import special, stats
from sondeo.functions import text as T
from sondeo.operators import clusters, density, flow, scoring, survey, themes, topics
from sondeo.sources import tables
from sondeo.sources.store import Store, encode_missing
from sondeo.streaming import exercise as streams

SF = "/root/testdata/sf0.001"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


# ---- clusters ------------------------------------------------------------------------------
def grouped(spark, x, groups=("a",), ddl="g string, id long, v array<double>"):
    return spark.createDataFrame([(groups[i % len(groups)], i, v.tolist()) for i, v in enumerate(x)], ddl)


def three(n=20, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 0.05, (n, 3)) for c in np.eye(3) * 2])


def lloyd(x, centres):
    """Plain KMeans from given centres: labels, cost."""
    while True:
        label = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.stack([x[label == j].mean(0) if (label == j).any() else centres[j] for j in range(len(centres))])
        if np.abs(new - centres).max() <= 1e-6:
            return label, ((x - centres[label]) ** 2).sum(), centres
        centres = new


@pytest.mark.parametrize("slice_bytes", [8 << 20, 300])
def test_grid_is_lloyd_from_the_same_starts(spark, slice_bytes):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4)).astype(np.float32).astype(float)
    slices, dims = clusters.packed(grouped(spark, x), "g", "id", "v", 3, slice_bytes)
    state = clusters.fit_grid(slices, dims, 4, stats.least_topic, 3, 4, 2, 300, 42).collect()
    fits = clusters.cells(3, 4, 2)
    rows = sorted(((k, m) for r in slices.collect() for k, m in zip(r["keys"], np.frombuffer(r.member, np.int64))))
    member = np.array([m for _, m in rows])
    order = sorted(range(90), key=lambda i: (clusters.hash_of(i), x[i].astype(np.float32).tobytes()))
    assert 0 < sum(m & 1 for m in member) < 90 and {r.k for r in state} == {2, 3, 4}
    for r in state:
        starts = clusters.starting_centres(x[order], member[order], r.k, fits, 42)
        got, cost = np.frombuffer(r.centres).reshape(len(fits), r.k, dims), np.frombuffer(r.cost)
        for i, (rep, _) in enumerate(fits):
            own = x if rep < 0 else x[(member >> rep) & 1 == 1]
            _, want, centres = lloyd(own, starts[i])
            assert cost[i] == pytest.approx(want, abs=1e-6) and np.allclose(got[i], centres, atol=1e-5)


def test_curve_diagnostics_are_those_of_numpy(spark):
    x = three()
    c = clusters.k_curve(grouped(spark, x, ("a", "b")), "g", "id", "v", k_most=5, reps=4, starts=3, rep_starts=2)
    curve = {(r.g, r.k): r for r in c.curve.collect()}
    labels = {}
    for r in c.labels.collect():
        labels.setdefault((r.g, r.k), {})[r.id] = r.topic
    assert set(curve) == {(g, k) for g in "ab" for k in range(2, 6)}
    for (g, k), r in curve.items():
        ids = sorted(labels[g, k])
        lab, own = np.array([labels[g, k][i] for i in ids]), x[ids].astype(np.float32).astype(float)
        sizes = np.bincount(lab, minlength=k)
        assert r.smallest == sizes.min() and list(sizes) == sorted(sizes, reverse=True) and r.valid == (sizes.min() >= r.least)
        u = own / np.linalg.norm(own, axis=1, keepdims=True)
        d, s = 1 - u @ u.T, []
        for i in range(len(ids)):
            mean = [d[i, (lab == t) & (np.arange(len(ids)) != i)].mean() for t in range(k)]
            a, b = mean[lab[i]], min(m for t, m in enumerate(mean) if t != lab[i])
            s.append((b - a) / max(a, b) if sizes[lab[i]] > 1 else 0)
        assert r.silhouette == pytest.approx(np.mean(s), abs=1e-9) and r.stability == pytest.approx(min(r.topics))
    chosen = topics.choose_k(c.curve.withColumnRenamed("g", "group")).collect()
    assert {(r.group, r.k) for r in chosen} == {("a", 3), ("b", 3)} and curve["a", 3].stability == 1.0 and curve["a", 4].stability < 0.75


def test_curve_without_structure_is_weak(spark):
    x = np.random.default_rng(3).normal(size=(60, 20))
    c = clusters.k_curve(grouped(spark, x / np.linalg.norm(x, axis=1, keepdims=True)), "g", "id", "v", k_most=5)
    assert all(r.stability < 0.75 for r in c.curve.collect() if r.k >= 3)


def test_curve_of_odd_tables(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 1, [1.0, 0.0]), (None, 2, [0.0, 1.0]), ("b", 3, None), ("a", 4, [1.0])]
    c = clusters.k_curve(spark.createDataFrame(rows, "g string, id long, v array<double>"), "g", "id", "v", reps=2, starts=1, rep_starts=1)
    assert c.curve.count() == 0 and c.labels.count() == 0
    same = spark.createDataFrame([("a", i, [1.0, 0.0]) for i in range(12)], "g string, id long, v array<double>")
    c = clusters.k_curve(same, "g", "id", "v", reps=2, starts=1, rep_starts=1)
    assert [(r.k, r.smallest, r.valid) for r in c.curve.collect()] == [(2, 0, False)]


def prim(x, least):
    """The edges (weight, lesser end, greater end) of the tree of mutual reachability."""
    x, n = np.asarray(x, np.float32).astype(float), len(x)
    d = density.exact(np.repeat(x, n, 0), np.tile(x, (n, 1))).reshape(n, n)
    core = np.sort(d, 1)[:, min(least, n - 1)]
    w = np.maximum(np.maximum(np.maximum(d, core[:, None]), core[None, :]), 1e-9)
    near, out = {j: (w[0, j], 0, j) for j in range(1, n)}, []
    while near:
        j = min(near, key=near.get)
        out.append(near.pop(j))
        for k in near:
            near[k] = min(near[k], (w[j, k], min(j, k), max(j, k)))
    return out


def condensed(x, least):
    """Clusters and share of outliers by a condensed tree built from the top down."""
    edges, n = prim(x, least), len(x)

    def split(nodes, own):
        e = max(own)
        own = [o for o in own if o != e]
        side, grew = {e[1]}, True
        while grew:
            grew = False
            for o in own:
                if (o[1] in side) != (o[2] in side):
                    side |= {o[1], o[2]}
                    grew = True
        return e[0], (side, [o for o in own if o[1] in side]), (nodes - side, [o for o in own if o[1] not in side])

    def best(nodes, own, born):
        size, mass = len(nodes), 0.0
        while own:
            w, a, b = split(nodes, own)
            lam = 1 / w
            if len(a[0]) >= least and len(b[0]) >= least:
                mass += len(nodes) * (lam - born)
                p, q = best(*a, lam), best(*b, lam)
                return (mass, 1, size) if born is not None and mass >= p[0] + q[0] else (p[0] + q[0], p[1] + q[1], p[2] + q[2])
            small, (nodes, own) = sorted((a, b), key=lambda s: len(s[0]))
            mass += len(small[0]) * (lam - born)
            if len(nodes) < least:
                return mass + len(nodes) * (lam - born), 1, size
        return mass, 1, size

    # the whole group: what leaves it one by one is in no cluster, and it is none itself
    nodes, own = set(range(n)), edges
    while own:
        w, a, b = split(nodes, own)
        if len(a[0]) >= least and len(b[0]) >= least:
            p, q = best(*a, 1 / w), best(*b, 1 / w)
            return p[1] + q[1], 1 - (p[2] + q[2]) / n
        _, (nodes, own) = sorted((a, b), key=lambda s: len(s[0]))
        if len(nodes) < least:
            break
    return 0, 1.0


@pytest.mark.parametrize("block_bytes,edges", [(1 << 20, 200_000), (1500, 40)])
def test_density_is_brute_force(spark, block_bytes, edges):
    rng = np.random.default_rng(1)
    groups = {
        "round": np.concatenate([rng.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 0.3, 40), ((5, 5), 0.5, 30), ((9, 0), 0.2, 25))] + [rng.uniform(-3, 12, (25, 2))]),
        "none": rng.normal(size=(40, 8)),
        "copies": np.repeat(rng.normal(size=(5, 3)), 9, 0),
        "one": np.zeros((1, 2)),
        "few": rng.normal(size=(4, 2)),
    }
    for name, x in groups.items():
        least = max(5, math.ceil(len(x) * 0.03))
        df = spark.createDataFrame([(name, f"{i:04d}", v.tolist()) for i, v in enumerate(x)], "g string, id string, v array<double>")
        got = density.density_clusters(df, "g", "id", "v", block_bytes=block_bytes, edges_at_once=edges).first()
        if name == "copies":  # equal weights: the order of rows may decide which is merged first, not what is found
            assert (got.clusters, got.outliers) == (5, 0.0)
        else:
            want = condensed(x, least)
            assert (got.n, got.clusters) == (len(x), want[0]) and got.outliers == pytest.approx(want[1])


def test_density_of_500_vectors(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.lit("g").alias("g"), "vec_id", "embedding")
    for scale in (1, 3):  # as they are, and drawn together by label
        rows = e if scale == 1 else spark.read.parquet(f"{SF}/embeddings.parquet").select(F.lit("g").alias("g"), "vec_id", F.transform("embedding", lambda v, i: v / 3 + F.when(i == F.col("label"), 0.7).otherwise(0.0)).alias("embedding"))
        x = np.array([r.embedding for r in rows.orderBy("vec_id").collect()])
        got = density.density_clusters(rows, "g", "vec_id", "embedding").first()
        want = condensed(x, max(5, math.ceil(len(x) * 0.03)))
        assert (got.clusters, got.n) == (want[0], 500) and got.outliers == pytest.approx(want[1])


# ---- words -----------------------------------------------------------------------------------
def test_words_by_cell_are_those_of_each_cell(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 80 and text is not null")
    rows = docs.select("doc_id", (F.col("doc_id") % 2).alias("g"), "lang", T.tokens(F.col("text")).alias("w"))
    counts = rows.select("g", "doc_id", "lang", F.explode("w").alias("term")).groupBy("g", "doc_id", "lang", "term").agg(F.count("*").alias("n"))
    words = topics.class_tfidf_by(counts, ["g"], "lang", 5)
    npmi = {r.g: r.npmi for r in topics.npmi_by(words, counts.select("g", "doc_id", "term"), ["g"], "g", "lang", "doc_id").collect()}
    for g in (0, 1):
        own = counts.filter(F.col("g") == g)
        want = topics.class_tfidf(own, "lang", 5)
        assert sorted(map(tuple, words.filter(F.col("g") == g).drop("g").collect())) == sorted(map(tuple, want.collect()))
        assert npmi[g] == pytest.approx(topics.npmi(want, own, "lang", "doc_id").first()[0])


def test_diversified_words(spark):
    unit = np.eye(topics.WORD_DIMS)
    v = {"a": unit[0], "b": unit[0] * 2 + unit[1] * 0.1, "c": unit[0] + unit[1], "d": unit[2], "z": unit[0] * 0}
    cand = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(v)] + [(2, 1, "d")], "k int, rank int, term string")
    vec = spark.createDataFrame([(t, x.tolist()) for t, x in v.items()], "term string, v array<double>")
    cos = lambda a, b: round(float(a @ b / math.sqrt((a @ a) * (b @ b))), 9) if a.any() and b.any() else 0.0
    mean, left, want = sum(v.values()) / 5, list(v), []
    while left:
        t = max(left, key=lambda t: (round(0.7 * cos(v[t], mean) - 0.3 * max(cos(v[t], v[u]) for u in want), 9) if want else cos(v[t], mean), -list(v).index(t)))
        want.append(t)
        left.remove(t)
    got = topics.diversified(cand, vec, ["k"]).collect()
    assert [r.term for r in sorted(got, key=lambda r: r["rank"]) if r.k == 1] == want and [r.term for r in got if r.k == 2] == ["d"]


# ---- functions -------------------------------------------------------------------------------
def test_chi_square_p(spark):
    rows = [(df, float(x)) for df in (2, 4, 10, 40, 200, 1000) for x in (0, 0.1, 1, 5, df * 0.5, df * 0.9, df, df + 2, df * 1.3, df * 2)]
    for r in spark.createDataFrame(rows, "df int, x double").select("*", special.chi_square_p(F.col("x"), F.col("df")).alias("p")).collect():
        want = sum(math.exp(-r.x / 2 + i * math.log(r.x / 2) - math.lgamma(i + 1)) if r.x else float(i == 0) for i in range(r.df // 2))
        assert r.p == pytest.approx(want, abs=1e-9)
    for r in spark.createDataFrame([(x,) for x in (0.2, 1.0, 3.84, 30.0)], "x double").select("x", special.chi_square_p(F.col("x"), F.lit(1)).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(math.sqrt(r.x / 2)), abs=1e-12)
    one = stats.chi_square(spark.createDataFrame([("a", "x"), ("a", "y")], "a string, b string"), "a", "b").first()
    assert one.gl == 0 and one.p is None and one.cramer_v is None


def test_plain_is_the_decomposition_of_every_character(spark):
    all_of = [i for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join("x" + chr(c) for c in all_of[k : k + 1000]) for k in range(0, len(all_of), 1000)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.plain("t").alias("got")).collect():
        assert r.got == unicodedata.normalize("NFKD", r.t).encode("ascii", "ignore").decode()


@pytest.mark.parametrize("scale", [0.001, 1.0, 1e9])
def test_quantiles_of_any_spread_use_many_ranges(spark, scale):
    rng = np.random.default_rng(0)
    x = np.exp(rng.normal(0, 4, 4000)) * scale
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    r = survey.weighted_quantiles(df, [], "x", {"p5": 0.05, "p50": 0.5, "p95": 0.95}).first()
    for q in (5, 50, 95):
        assert r[f"p{q}"] == pytest.approx(np.percentile(x, q))
    per = df.filter("x is not null").distinct()
    sizes = [r["count"] for r in survey.in_ranges(per, "x", per, "g").groupBy("g").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 4000 / 50


def test_bootstrap_of_counts(spark):
    rng = np.random.default_rng(2)
    y = (rng.random(4000) < 0.3).astype(int)
    g = np.where(rng.random(4000) < 0.1, 1 - y, y)
    df = spark.createDataFrame(list(zip(y.tolist(), g.tolist())), "y int, g int")
    got = stats.bootstrap(df, ["y", "g"], stats.weighted_kappa("y", "g"), draws=1000).first()

    def kappa(i):
        a, b = y[i], g[i]
        e = a.mean() * b.mean() + (1 - a.mean()) * (1 - b.mean())
        return ((a == b).mean() - e) / (1 - e)

    want = np.percentile([kappa(rng.integers(0, 4000, 4000)) for _ in range(1000)], [2.5, 97.5])
    assert got.lo == pytest.approx(want[0], abs=0.006) and got.hi == pytest.approx(want[1], abs=0.006)
    few = stats.bootstrap(spark.createDataFrame([(1,), (1,), (0,)], "x int"), ["x"], F.sum(F.col("w") * F.col("x")) / F.nullif(F.sum("w"), F.lit(0)), draws=500).first()
    assert 0 <= few.lo < 2 / 3 < few.hi == 1


# ---- scoring and store -------------------------------------------------------------------------
def texts_of(spark, n):
    return spark.createDataFrame([(i, f"t{i}") for i in range(n)] + [(0, "t0"), (None, "x")], "k long, t string").repartition(3)


def noted(folder, name, text):
    (folder / f"{name}-{text}-{threading.get_ident()}-{np.random.default_rng().integers(1 << 60)}").touch()


def calls(folder, name):
    return sorted(p.name.split("-")[1] for p in folder.glob(f"{name}-*"))


def test_each_text_is_asked_once(spark, tmp_path):
    def ask(t):
        noted(tmp_path, "a", t)
        return {"x": 0.5, "y": 1.0}

    texts = texts_of(spark, 40)
    done = scoring.with_second_pass(texts, ask, "k", "t")
    passed = scoring.complete_or_stop(texts, done, "k", ["x", "y"])
    assert passed.count() == 80 and passed.filter("tema = 'x'").count() == 40
    assert calls(tmp_path, "a") == sorted(f"t{i}" for i in range(40))


def test_limit_retries_and_gate(spark, tmp_path):
    def ask(t):
        before = len(list(tmp_path.glob("now-*")))
        mine = tmp_path / f"now-{t}-{np.random.default_rng().integers(1 << 60)}"
        mine.touch()
        (tmp_path / f"open-{before + 1}").touch()
        noted(tmp_path, "c", t)
        import time

        time.sleep(0.02)
        mine.unlink()
        tried = len(list(tmp_path.glob(f"c-{t}-*")))
        if t == "t3" or (t == "t5" and tried < 3):
            raise TimeoutError("busy")
        return {"x": 2.0 if t == "t7" else 0.5}

    texts = texts_of(spark, 12)
    done = scoring.with_second_pass(texts, ask, "k", "t", in_flight=3, slower=1, tasks=1, tries=3, wait=0.001)
    assert max(int(p.name.split("-")[1]) for p in tmp_path.glob("open-*")) == 3
    n = calls(tmp_path, "c")
    assert n.count("t5") == 3 and n.count("t3") == 6 and all(n.count(f"t{i}") == 1 for i in range(12) if i not in (3, 5))
    assert sorted(r.k for r in scoring.incomplete(texts, done, "k", ["x"]).collect()) == [3, 7]
    with pytest.raises(scoring.IncompleteError, match="2 texts.*3 .TimeoutError: busy"):
        scoring.complete_or_stop(texts, done, "k", ["x"])


def test_a_fatal_error_stops(spark, tmp_path):
    def ask(t):
        noted(tmp_path, "f", t)
        raise scoring.FatalError("401")

    with pytest.raises(Exception, match="401"):
        scoring.score_texts(texts_of(spark, 30), ask, "k", "t", in_flight=1, tasks=1)
    assert len(calls(tmp_path, "f")) <= 3


def test_memory_of_a_task_is_that_of_a_few_texts(spark, tmp_path):
    n = 20_500  # a symbol of four bytes in each text: as Python objects 10,000 of them have 40 MB, a batch of Spark's 10 MB

    def noting(name, left):
        """Notes the most memory of Python objects between the first text and the last."""
        import tracemalloc

        def note(texts):
            if not tracemalloc.is_tracing():
                tracemalloc.start()
            noted.append(len(texts))
            if sum(noted) >= left:
                (tmp_path / f"{name}-{tracemalloc.get_traced_memory()[1] >> 20}-{max(noted)}").touch()
                tracemalloc.stop()

        noted = []
        return note

    a, b, c = noting("a", n), noting("b", n), noting("c", n)

    def ask(t):
        a([t])
        return {"x": 0.5, "y": None}

    def scorer(batch):
        b(batch)
        return [{"x": float(len(t))} for t in batch]

    def encode(batch):
        c(batch)
        return [[float(len(t))] for t in batch]

    texts = spark.range(0, n, 1, 1).selectExpr("id AS k", "concat(id, repeat('x', 1000), '\U0001F600') AS t")
    want = texts.selectExpr("k", "double(length(t)) AS p")
    done = scoring.score_texts(texts, ask, "k", "t", in_flight=1, tasks=1)
    assert done.count() == 2 * n and done.filter("tema = 'x' AND p = 0.5 AND calls = 1").select("k").distinct().count() == n and done.filter("tema = 'y' AND p IS NULL").count() == n
    assert themes.plug_in_scores(texts, scorer, "k", "t").filter("tema = 'x' AND error IS NULL").select("k", "p").exceptAll(want).count() == 0
    store = Store(spark, str(tmp_path / "store"), "k", "k long, v array<double>")
    encode_missing(store, texts.coalesce(1), encode, "t", "v")
    assert store.read().selectExpr("k", "v[0] AS p").exceptAll(want).count() == 0 and store.read().count() == n
    got = {p.name.split("-")[0]: tuple(map(int, p.name.split("-")[1:])) for p in tmp_path.glob("?-*")}
    assert set(got) == {"a", "b", "c"} and all(mb < 20 for mb, _ in got.values()) and got["b"][1] <= 1000 and got["c"][1] <= 32, got


def test_slices_are_the_batch():
    sizes = [0, 3, 9, 1, None, 4, 4, 4, 30, 1]
    batch = tables.record_batch([(i, None if s is None else "é" * s) for i, s in enumerate(sizes)], {"k": pa.int64(), "t": pa.string()})
    for rows, most in ((3, 1 << 20), (1000, 16), (1, 1), (1000, 1 << 20)):
        parts = list(tables.slices([batch, batch.slice(0, 0), batch], "t", rows, most))
        assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch, batch]).combine_chunks()) and all(len(p) for p in parts)
        assert all(len(p) <= rows and (len(p) == 1 or sum(len((t or "").encode()) for t in p["t"].to_pylist()) <= most) for p in parts)
    assert len(list(tables.slices([batch], "t", 1000, 1 << 20))) == 1


def test_with_retry_asks_once(spark, tmp_path):
    def scorer(batch):
        for t in batch:
            noted(tmp_path, "r", t)
        return [{"a": 0.5} for _ in batch]

    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "k long, t string")
    assert flow.with_retry(df, scorer, scorer, "k", "t").count() == 10 and len(calls(tmp_path, "r")) == 10

    def bad(batch):
        noted(tmp_path, "b", str(len(batch)))
        if "t3" in batch:
            raise ValueError("no")
        return [{"a": 0.5} for _ in batch]

    got = themes.plug_in_scores(df.coalesce(1), bad, "k", "t").collect()
    assert [r.k for r in got if r.error] == [3] and sum(r.p is not None for r in got) == 9


def test_store_over_runs(spark, tmp_path):
    def encode(texts):
        for t in texts:
            noted(tmp_path, "e", t)
        return [[float(len(t)), 1.0] for t in texts]

    store = Store(spark, str(tmp_path / "store"), "k", "k long, v array<double>")
    assert store.read().count() == 0
    a = spark.createDataFrame([(1, "x"), (2, "yy"), (1, "x"), (None, "n")], "k long, t string")
    b = a.unionByName(spark.createDataFrame([(3, "zzz")], "k long, t string"))
    assert encode_missing(store, a, encode, "t", "v") == 0 and encode_missing(store, b, encode, "t", "v") == 1
    assert encode_missing(store, b, encode, "t", "v") is None and calls(tmp_path, "e") == ["x", "yy", "zzz"]
    assert sorted((r.k, r.v[0]) for r in store.read().collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    # a run that dies between its write and its commit
    commit = store._commit
    store._commit = lambda said: (_ for _ in ()).throw(KeyboardInterrupt())
    with pytest.raises(KeyboardInterrupt):
        store.append(spark.createDataFrame([(1, [9.0, 9.0])], "k long, v array<double>"))
    store._commit = commit
    assert {r.k: r.v[0] for r in store.read().collect()}[1] == 1.0
    # last write wins, also after compaction, and a second writer takes the next number
    other = Store(spark, str(tmp_path / "store"), "k", "k long, v array<double>")
    assert other.append(spark.createDataFrame([(2, [7.0, 0.0])], "k long, v array<double>")) == 2
    want = sorted(map(str, store.read().collect()))
    assert store.compact() == 3 and sorted(map(str, other.read().collect())) == want and other.generations().select("generation").distinct().count() == 1


def test_two_writers_take_two_numbers(spark, tmp_path):
    stores = [Store(spark, str(tmp_path / "s"), "k", "k long, v string") for _ in range(4)]
    got = []
    threads = [threading.Thread(target=lambda s=s, i=i: got.append(s.append(spark.createDataFrame([(i, "v")], "k long, v string")))) for i, s in enumerate(stores)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [0, 1, 2, 3] and stores[0].read().count() == 4


# ---- the exercise ------------------------------------------------------------------------------
FORM = "id long, ts timestamp, unit string, form string"


def form_rows(spark, rows):
    return spark.createDataFrame([(i, f"2024-01-{day:02d} 10:00:00", u, f) for i, day, u, f in rows], "id long, ts string, unit string, form string").withColumn("ts", F.to_timestamp("ts"))


def test_audit_and_aborts(spark):
    rows = form_rows(spark, [(1, 5, "Ubaté", "UC Vida"), (2, 9, "UBATE norte", "uc  vida"), (3, 8, "Ubaté", "UC Vida"), (4, 5, "Soacha", "UC Vida"), (5, 5, None, "UC Vida")])
    e = survey.audited_exercise(rows, "ubate", "UC Vida", ["2024-01-05"], [2])
    assert sorted(r.id for r in e.rows.collect()) == [1, 2] and e.rows.columns == rows.columns
    assert sorted(map(tuple, e.late.collect())) == [(2, "2024-01-09", True), (3, "2024-01-08", False)]
    assert e.report == {"rows": 2, "blank_form": 0, "late_included": 1, "late_left_out": 1}
    assert survey.audited_exercise(rows, None, "UC Vida", ["2024-01-05"]).report["rows"] == 3
    blank = rows.unionByName(form_rows(spark, [(6, 5, "Ubaté", " "), (7, 5, "Ubaté", None)]))
    assert survey.audited_exercise(blank, "Ubaté", "UC Vida", ["2024-01-05"]).report == {"rows": 3, "blank_form": 2, "late_included": 0, "late_left_out": 2}
    assert survey.audited_exercise(rows, "Ubaté", "UC Vida", ["2024-01-05"], form_col=None).report["blank_form"] == 1
    mixed = form_rows(spark, [(8, 5, "Ubaté", "UC Digital")])
    for bad, unit, days, why in ((rows, "Girardot", ["2024-01-05"], "no rows of unit"), (blank.unionByName(mixed), "Ubaté", ["2024-01-05"], "which form"), (mixed, "Ubaté", ["2024-01-05"], "but 1 of others"), (rows, "Ubaté", ["2024-02-01"], "no rows on these days")):
        with pytest.raises(survey.ExerciseError, match=why):
            survey.audited_exercise(bad, unit, "UC Vida", days)
    # rows of other forms stay out where no form is blank
    assert survey.audited_exercise(rows.unionByName(mixed), "Ubaté", "UC Vida", ["2024-01-05"]).report["rows"] == 1


def test_stream_is_the_batch_in_two_runs(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "event_type", (F.col("user_id") % 2).cast("string").alias("unit"))
    ddl = "event_id long, ts timestamp, event_type string, unit string"
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    days = [F.dayofmonth("ts").between(a, b) for a, b in ((1, 8), (7, 16), (16, 24), (24, 31))]  # days 7, 8, 16 and 24 come twice
    args = ("1", "click", ["2024-01-05", "2024-01-16"], [2, 3])
    cols = {"unit_col": "unit", "form_col": "event_type", "ts_col": "ts", "id_col": "event_id"}

    def run():
        streams.exercise_stream(streams.arriving(spark, str(tmp_path / "in"), ddl, 1), str(tmp_path / "out"), str(tmp_path / "c1"), *args, **cols, delay="3 days")
        streams.counts_stream(streams.arriving(spark, str(tmp_path / "in"), ddl, 1), str(tmp_path / "n"), str(tmp_path / "c2"), "event_type", "ts", "event_id", delay="3 days")

    for i in range(2):
        events.filter(days[i]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    for i in range(2, 4):
        events.filter(days[i]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    kept, late = streams.outcome(spark, str(tmp_path / "out"))
    want = survey.audited_exercise(events, "1", "click", ["2024-01-05", "2024-01-16"], [2, 3], **{**cols})
    assert sorted(r.event_id for r in kept.collect()) == sorted(r.event_id for r in want.rows.collect())
    assert sorted(r.event_id for r in late.collect()) == sorted(r.event_id for r in want.late.filter("not included").collect())
    n = {(str(r["from"])[:10], r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "n")).collect()}
    whole = {(r.day, r.event_type): r.n for r in events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert n and all(whole[k] == v for k, v in n.items()) and all(k in n for k in whole if k[0] <= "2024-01-26")
    # an event that comes later than the delay is not lost in silence
    events.filter("day(ts) = 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(streams.LateRowsError):
        run()


def test_bounds_of_lloyd_change_nothing():
    """Rounds that skip rows by bounds end at the centres and cost of plain rounds, also with
    copies, centres without rows and no structure at all, and look at few of the rows."""
    rng = np.random.default_rng(3)
    blobs = np.concatenate([rng.normal(c * 4, 1, (300, 8)) for c in np.eye(8)[:5]])
    for x in (blobs, rng.normal(size=(900, 8)), np.repeat(rng.normal(size=(40, 8)), 20, 0), rng.normal(size=(700, 8)) + 50):
        for k in (2, 5, 11):
            start = np.concatenate([x[rng.choice(len(x), k - 1)], [x[0] + 1e3]])
            label, want, centres = lloyd(x, start)
            got, cost = clusters.lloyd(x, (x**2).sum(1), start, 300)
            assert np.allclose(got, centres, atol=1e-5) and cost == pytest.approx(want, rel=1e-6)
    seen, whole = [], clusters.two_nearest
    clusters.two_nearest = lambda x, *how: seen.append(len(x)) or whole(x, *how)
    try:
        clusters.lloyd(blobs, (blobs**2).sum(1), blobs[rng.choice(len(blobs), 8)], 300)
    finally:
        clusters.two_nearest = whole
    assert max(seen[1:]) <= len(blobs) and sum(seen) < 0.6 * len(blobs) * len(seen)


@pytest.mark.parametrize("kept,at_once", [(1 << 20, 64), (200, 2)])
def test_tree_of_blocks_in_parts_is_prims(spark, monkeypatch, kept, at_once):
    """Core distances and the tree hold no lists of neighbours, whose length is a share of the
    group: rows of a block go in parts, a group's blocks in chunks."""
    monkeypatch.setattr(density, "KEPT", kept)
    monkeypatch.setattr(density, "AT_ONCE", at_once)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.lit("g").alias("g"), "vec_id", "embedding")
    blocks, dims = density.packed(rows, "g", "vec_id", "embedding", 0, 25_600)
    core = np.array([r.core for r in density.cores(blocks, dims, stats.least_topic).orderBy("a").collect()])
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, dims).astype(float) for r in blocks.orderBy("slice").collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(core, np.sort(d, 1)[:, 15])  # itself, then the 15th
    w = np.maximum(np.maximum(d, core[:, None]), core[None])
    inside, total, near = {0}, 0.0, w[0].copy()
    near[0] = np.inf
    while len(inside) < len(x):
        at = int(near.argmin())
        total += near[at]
        inside.add(at)
        near = np.minimum(near, w[at])
        near[list(inside)] = np.inf
    tree = density.spanning_tree(blocks, dims, stats.least_topic).collect()
    assert len(tree) == len(x) - 1 and sum(e.w for e in tree) == pytest.approx(total)


def test_fits_are_dealt_out_in_lots():
    """Every fit is in one lot; lots are many more than the k of a group and hold fits of one subsample."""
    fits = clusters.cells(20, 20, 10)
    lots = clusters.lots_of(fits)
    assert [i for a, b in lots for i in range(a, b)] == list(range(len(fits))) and len(lots) == 22
    assert all(len({fits[i][0] for i in range(a, b)}) == 1 and b - a == 10 for a, b in lots)
    assert clusters.lots_of(clusters.cells(0, 3, 2)) == [(0, 3)] and clusters.lots_of(clusters.cells(2, 1, 3)) == [(0, 1), (1, 4), (4, 7)]


def test_nearest_in_single_precision_is_that_in_double():
    """Labels are those in doubles of any scale, and the room to the second is never too large."""
    rng = np.random.default_rng(0)
    kinds = {"plain": rng.normal(size=(3000, 16)), "offset": rng.normal(size=(3000, 8)) + 300, "copies": np.repeat(rng.normal(size=(50, 5)), 60, 0), "huge": rng.normal(size=(900, 6)) * 1e18, "tiny": rng.normal(size=(900, 6)) * 1e-22, "zero": np.zeros((100, 3))}
    for name, x in kinds.items():
        x = x.astype(np.float32)
        rows = x.astype(float)
        for k in (2, 7, 15):
            c = rows[rng.choice(len(x), k)]
            label, gap = clusters.two_nearest(x, (rows**2).sum(1).astype(np.float32), c)
            far = np.sort(np.sqrt(((rows[:, None] - c[None]) ** 2).sum(2)), 1)
            own = np.sqrt(((rows - c[label]) ** 2).sum(1))
            assert np.all(own <= far[:, 0] * (1 + 1e-9)), name
            assert np.all(gap.astype(float) <= (far[:, 1] - far[:, 0]) * (1 + 1e-6)), name
            got, cost = clusters.lloyd(x, (rows**2).sum(1).astype(np.float32), c, 300)
            if name in ("plain", "copies"):
                _, want, centres = lloyd(rows, c)
                assert np.allclose(got, centres, atol=1e-5) and cost == pytest.approx(want, rel=1e-6)


def test_words_of_all_cells_are_those_of_each_row_in_each_cell(spark, monkeypatch):
    """The first words of every k by one table of sums are those of counts repeated for every k,
    with equal scores, and no row of counts is made again for a k."""
    monkeypatch.setattr(topics, "TERMS_AT_ONCE", 300)
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60 and text is not null")
    terms = docs.select((F.col("doc_id") % 2).alias("g"), "doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("g", "doc_id", "term").agg(F.count("*").alias("n"))
    ks = spark.createDataFrame([(2,), (3,), (7,)], "k int")
    labels = docs.filter("doc_id % 5 > 0").select((F.col("doc_id") % 2).alias("g"), "doc_id").crossJoin(ks).withColumn("topic", F.pmod(F.xxhash64("doc_id", "k"), F.col("k")).cast("int"))
    got = topics.class_tfidf_cells(terms, labels, "g", "k", "topic", "doc_id", 4)
    want = topics.class_tfidf_by(terms.join(labels, ["g", "doc_id"]), ["g", "k"], "topic", 4)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_assignments_read_no_texts(spark, monkeypatch):
    """Topics and affinities of rows need vectors alone."""
    from sondeo import registry_models, registry_reports

    def texts(*_):
        raise AssertionError("texts are read")

    monkeypatch.setattr(registry_reports, "_modelled", texts, raising=False)
    monkeypatch.setattr(registry_models, "_modelled", texts)
    monkeypatch.setattr(registry_reports.clusters, "k_curve", lambda *a, **b: clusters.Curve(spark.createDataFrame([(g, 2, True, 0.9) for g in range(3)], "grupo int, k int, valid boolean, stability double"), registry_models._vectors(spark, SF).select("grupo", F.lit(2).alias("k"), "vec_id", (F.col("vec_id") % 2).cast("int").alias("topic"))))
    assert registry_reports.r04_assignments(spark, SF).count() == 500


@pytest.mark.parametrize("spare", [0, 64])
def test_nearest_of_is_brute_force(monkeypatch, spare):
    """The distance that counts is exact, also where many are equal, in blocks and beside a row's own."""
    monkeypatch.setattr(density, "SPARE", spare)
    monkeypatch.setattr(density, "WIDE", 100)
    monkeypatch.setattr(density, "ROWS", 16)
    rng = np.random.default_rng(4)
    for y in (rng.normal(size=(500, 6)), np.repeat(rng.normal(size=(9, 4)), 40, 0), rng.integers(0, 3, size=(300, 3)) * 1.0, rng.normal(size=(200, 2)) + 1e3):
        y = y.astype(np.float32)
        for most, own in ((1, np.arange(7, 27)), (30, np.arange(7, 27)), (90, None), (len(y) - 1, np.arange(20))):
            x = y[own].astype(float) if own is not None else rng.normal(size=(20, y.shape[1]))
            far = density.exact(np.repeat(x, len(y), 0), np.tile(y.astype(float), (20, 1))).reshape(20, -1)
            if own is not None:
                far[np.arange(20), own] = np.inf
            want = np.sort(far, 1)[:, :most]
            assert np.array_equal(density.nearest_of(x, y, own, most, False).max(1), want[:, -1])
            assert np.array_equal(np.sort(density.nearest_of(x, y, own, most, True), 1), want)


def test_blocks_of_a_group_are_sent_for_few_lots(spark):
    """However many blocks a group has and however few rows of them go at a time, its rows are
    sent to TASKS lots of all groups at most, and one more for each group."""
    rows = spark.range(900).select((F.col("id") % 3).cast("int").alias("g"), "id", F.array(*(F.rand(i) for i in range(4))).alias("v")).filter("g < 2 or id < 60")
    blocks, _ = density.packed(rows, "g", "id", "v", 0, 80)
    lots = {r.g: r for r in density.dealt(blocks).collect()}
    assert lots[0].slices == lots[1].slices == 60 and sum(r.lots for r in lots.values()) <= density.TASKS + 3
    of = blocks.join(density.dealt(blocks).drop("slices"), "g").select("g", "slice", density.lot_of("slice")).collect()
    assert all({r.lot for r in of if r.g == g} == set(range(lots[g].lots)) for g in (0, 1))
