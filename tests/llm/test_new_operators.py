"""Embedding whitening, fill-in-middle and URL filters against numpy, plain Python and odd tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondeo.llm import fim, queries, url_filter, whitening

SF = "/root/testdata/sf0.001"


# ---- whitening -------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [1, 2, 3, 8, 40])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.eye(n), np.zeros((n, n)), np.diag(10.0 ** -np.arange(n)), np.ones((n, n))):
        a = a + a.T
        values, v = whitening.symmetric_qr(a)
        assert np.allclose(v.T @ v, np.eye(n), atol=1e-13) and np.allclose(v @ np.diag(values) @ v.T, a, atol=1e-12 * max(1, abs(a).max()))
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, abs(a).max()))


@pytest.mark.parametrize("partitions", [1, 40])
def test_whitening_is_that_of_numpy(spark, partitions):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(partitions)
    got = whitening.whiten(e, "vec_id", "embedding").collect()
    x = {r.vec_id: np.floor(64 * np.array(r.embedding, float)).astype(np.int64) + 1_000_000 for r in e.collect()}
    n, m = len(x), np.stack(list(x.values()))
    s = m.sum(0)
    centred = m - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 32 * n and {r.n for r in got} == {n}
    w = np.zeros((n, 32))
    at = {k: i for i, k in enumerate(x)}
    for r in got:
        w[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[r.vec_id], s)) if r.component == 1 else True
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-9
    want = centred @ vectors[:, :32] / np.sqrt(values[:32])
    signs = np.sign((w * want).sum(0))
    assert np.allclose(w, want * signs, atol=1e-8) and np.allclose(w.T @ w / n, np.eye(32), atol=1e-9)


def test_whitening_of_odd_tables(spark):
    ddl = "vec_id long, embedding array<float>, n long, x string, v int, key int"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (1, [3.0, -2.0]), (None, [0.5, 0.5]), (6, []), (7, [1.0, 2.0, 3.0]), (8, [3e38, 0.0]), (9, [1.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame([(*r, 0, "", 0, 0) for r in rows], ddl), "vec_id", "embedding").collect()
    assert Counter(r.vec_id for r in got) == {1: 4, None: 2, 9: 2} and {r.n for r in got} == {4} and got[0].identity_error < 1e-12
    for bad in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, [])]):
        out = whitening.whiten(spark.createDataFrame([(*r, 0, "", 0, 0) for r in bad], ddl), "vec_id", "embedding")
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], 0, "", 0, 0) for i in range(9)], ddl), "vec_id", "embedding").collect()
    assert {r.component for r in flat} == {1}  # the second has no variance
    assert whitening.deviations(np.array([[2**40, 0], [3, 1]]), 1000, np.array([0, 5])) == [None, 3000**2 + 995**2]


# ---- fill-in-middle -----------------------------------------------------------------------------
def cut(text, k, seed=7, rate=100, spm=50, unit="line"):
    t = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t) if unit == "line" else list(t)
    h = hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, t
    if h[3] % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["", None, "\n", "\n\n", "a", "a\n", "\na", "a\r\nb\u2028c\x0bd", "ñ€😀\n😀", "x<P>y", "<S", "P>\n<\nM>", "a\n" * 3000, "é" * 40_000 + "\n" + "😀" * 300_000 + "\nx", "l\n" * 700_000 + "é"]


@pytest.mark.parametrize("unit", ["line", "char"])
def test_cuts_are_those_of_plain_python(spark, unit):
    rows = [(i + 10 * j, t) for i, t in enumerate(ODD) for j in range(8 if not t or len(t) < 10_000 else 2)] + [(None, "a\nb\nc"), (3, "a\nb\nc"), (3, "a\nb\nc")]
    df = spark.createDataFrame([(k, t, "kept", 1) for k, t in rows], "doc_id long, text string, key string, fim_form int")
    got = fim.fill_in_middle(df, unit=unit)
    assert got.columns == ["doc_id", "text", "key", "fim_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text"]
    found = Counter(got.select("doc_id", "fim_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text").collect())
    assert found == Counter((k, *cut(t, k, unit=unit)) for k, t in rows)
    assert {r.fim_form for r in got.select("fim_form").distinct().collect()} == {"plain", "spm", "psm"}
    assert got.filter(~fim.restored().eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    few = fim.fill_in_middle(df, rate=30, spm_rate=0, unit=unit)
    assert Counter(r.fim_form for r in few.collect()) == Counter(cut(t, k, rate=30, spm=0, unit=unit)[1] for k, t in rows)
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_marks_of_other_kinds(spark):
    df = spark.createDataFrame([(i, "a.b\n[c]\nd\n" * 5) for i in range(20)], "doc_id long, text string")
    marks = ("<|fim.prefix|>", "[S]", "$m$")
    got = fim.fill_in_middle(df, marks=marks)
    assert got.filter(fim.restored(marks=marks) != F.col("text")).count() == 0 and got.filter(F.col("fim_text").contains("<|fim.prefix|>")).count() == 20


@pytest.mark.parametrize("every", [1, 3, 256])
def test_sparse_index(every):
    text = ("é\n" * 1000 + "x" * 50_000 + "\n" + "😀\n" * 5).encode()
    index = fim.SparseIndex(text, "line", every)
    lines = re.findall(rb"[^\n]*\n|[^\n]+", text)
    assert index.units == len(lines) == 1006 and len(index.numbers) == -(-1006 // every)
    for u in (0, 1, 2, 3, 255, 256, 257, 999, 1000, 1001, 1005, 1006):
        before = b"".join(lines[:u])
        assert index.cut(u) == (len(before), len(before.decode()))


# ---- URL filters ---------------------------------------------------------------------------------
def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path, rules):
    fit = [(len(r), len(r.split("/")[0]), v == "block", r, v) for v, r in rules for h, p in [(r.split("/")[0], r[len(r.split("/")[0]) :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[3:] if fit else (None, None)


URLS = [None, "", "no", "http://", "HTTP://EXAMPLE.com/en/x", "http://a.example.com/en/1?q#f", "http://www.example.com/en/", "http://x.www.example.com/en/y", "http://example.com/EN/", "http://net", "http://net/es/", "http://a.net/fr/x://y", "http://anet/fr/", "http://com", "https://u@com:80/", "x://É.COM/é//a/?b", "a://b://c/d", "http://a.net/es", "http://exa\nmple.net/fr/\n?x", "http://example.com?/en/", "http://example.com#/en/", "http://a.b/" + "d/" * 500, "http://a.b/" + "z" * 100_000]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    host, path = url_filter.host_and_path(F.col("url"))
    rows = df.select("url", host.alias("host"), path.alias("path")).withColumn("r", url_filter.rule_of(F.col("host"), F.col("path"), queries.URL_RULES)).select("*", "r.*").collect()
    for r in rows:
        assert (r.host, r.path) == parts(r.url) and (r.rule, r.verdict) == rule(r.host, r.path, queries.URL_RULES), r.url


def brute_tree(pages, labels):
    """Template purity of each page in plain Python."""
    shape = lambda s: re.sub("[0-9]+", "#", s)
    rows = [(*parts(u), labels.get(i)) for i, u in pages]
    segs = [[s for s in p.split("/") if s] for _, p, _ in rows]
    n, all_of = Counter(), Counter()
    for (h, _, _), s in zip(rows, segs):
        for i, x in enumerate(s[: url_filter.LEVELS]):
            all_of[h, i] += 1
            n[h, i, "l", x] += len(x) <= url_filter.LONGEST
            n[h, i, "s", shape(x)] += len(shape(x)) <= url_filter.LONGEST
    good, place = set(), defaultdict(list)
    for k, c in n.items():
        if c >= url_filter.SUPPORT:
            place[k[:3]].append((-c, k[3]))
    for k, xs in place.items():
        good |= {(*k, x) for c, x in sorted(xs)[: int(1 / url_filter.SHARE)] if -c >= all_of[k[:2]] * url_filter.SHARE}
    token = lambda h, i, x: x if (h, i, "l", x) in good else shape(x) if (h, i, "s", shape(x)) in good else "*"
    toks = [tuple(token(h, i, x) for i, x in enumerate(s[: url_filter.LEVELS])) + (("**",) if len(s) > url_filter.LEVELS else ()) for (h, _, _), s in zip(rows, segs)]
    lab = [b is not None for *_, b in rows]
    bad = [bool(b) for *_, b in rows]
    share = lambda ix, p: (sum(bad[i] for i in ix) + url_filter.PRIOR * p) / (sum(lab[i] for i in ix) + url_filter.PRIOR)
    top = sum(bad) / sum(lab) if any(lab) else 0.0
    out = {}

    def alike(a, b):
        la, lb, ba, bb = (sum(lab[i] for i in a), sum(lab[i] for i in b), sum(bad[i] for i in a), sum(bad[i] for i in b))
        if la and lb and 0 < ba + bb < la + lb:
            p = (ba + bb) / (la + lb)
            if abs(ba / la - bb / lb) / np.sqrt(p * (1 - p) * (1 / la + 1 / lb)) >= url_filter.Z:
                return False
        ca, cb = (Counter(after[i] for i in x) for x in (a, b))
        return sum(abs(ca[t] / len(a) - cb[t] / len(b)) for t in ca | cb) / 2 <= url_filter.APART + 1e-12

    after = {}

    def walk(ix, level, p, name):
        here = [i for i in ix if len(toks[i]) == level]
        for i in here:
            out[i] = (name or "/", p, sum(bad[j] for j in ix))
        kids = defaultdict(list)
        for i in ix:
            if len(toks[i]) > level:
                kids[toks[i][level]].append(i)
                after[i] = toks[i][level + 1] if len(toks[i]) > level + 1 else "/"
        classes = []
        for t, own in sorted(kids.items(), key=lambda kv: (-len(kv[1]), kv[0])):
            hit = next((c for c in classes if alike(c[1], own)), None)
            if hit:
                hit[0].append(t)
                hit[1].extend(own)
            else:
                classes.append(([t], list(own)))
        for names, own in classes:
            walk(own, level + 1, share(own, p), name + "/" + "|".join(sorted(names)))

    hosts = defaultdict(list)
    for i, (h, _, _) in enumerate(rows):
        hosts[h].append(i)
    for ix in hosts.values():
        walk(ix, 0, share(ix, top), "")
    return [(i, *out[j]) for j, (i, _) in enumerate(pages)]


def crafted():
    rng = np.random.default_rng(4)
    pages, labels = [], {}
    for i in range(3000):
        host = ["big.example.org", "big.example.org", f"h{i % 40}.example.org"][i % 3]
        kind = rng.choice(["blog", "shop", "spam", "user", "deep"], p=[0.3, 0.3, 0.15, 0.2, 0.05])
        path = {"blog": f"/blog/{rng.integers(2000, 2024)}/post-{i}.html", "shop": f"/shop/item/{i}", "spam": f"/win/{i}/now", "user": f"/u/name{'abcdefg'[i % 7] * (i % 5 + 1)}/", "deep": "/a" * int(rng.integers(7, 12))}[kind]
        pages.append((i, f"https://{host}{path}?x={i}"))
        if rng.random() < 0.5:
            labels[i] = bool(kind == "spam" or rng.random() < 0.05)
    return pages, labels


def test_tree_is_brute_force(spark):
    pages, labels = crafted()
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = url_filter.judge(df, spark.createDataFrame(list(labels.items()), "page_id long, bad boolean"), [("allow", "h1.example.org/win/")]).collect()
    want = {i: w for i, *w in brute_tree(pages, labels)}
    assert len(got) == 3000
    for r in got:
        t, p, own = want[r.page_id]
        assert r.template == t and 1 - r.purity == pytest.approx(p), r
        assert r.verdict == ("allow" if r.rule or r.purity >= 0.5 or not own else "block")
    spam = [r for r in got if r.path.startswith("/win/") and not r.rule]
    rest = [r for r in got if not r.path.startswith("/win/")]
    assert sum(r.verdict == "block" for r in spam) > 0.9 * sum(r.host == "big.example.org" for r in spam) and sum(r.verdict == "block" for r in rest) == 0


def test_url_filters_of_odd_tables(spark):
    df = spark.createDataFrame([(i % 20, u, "x", 1) for i, u in enumerate(URLS)] + [(None, "http://a.b/c", "y", 2)] * 3, "page_id long, url string, host string, n int")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = url_filter.judge(df, none, queries.URL_RULES).collect()
    assert len(got) == len(URLS) + 3 and all(r.verdict == "allow" or r.rule for r in got)
    some = spark.createDataFrame([(None, True), (1, True), (1, False), (2, None)], "page_id long, bad boolean")
    assert url_filter.judge(df, some, queries.URL_RULES).count() == len(URLS) + 3
    assert url_filter.judge(df.limit(0), some, queries.URL_RULES).count() == 0
    pages = [(i, f"http://h/a/{i}") for i in range(50)]
    labels = {i: True for i in range(50)}
    all_bad = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(list(labels.items()), "page_id long, bad boolean"), [])
    assert {(r.verdict, r.template) for r in all_bad.collect()} == {("block", "/a/#")}


def test_op12_matches_sql(spark):
    import duckdb
    from parity import compare

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert compare(spark, con, queries.QUERIES["op12_fill_in_middle"], queries.ORACLES["op12_fill_in_middle"], SF) is None
