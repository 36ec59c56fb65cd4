"""Closed-form values of the statistics and text rules."""

import re

import pytest
from pyspark.sql import functions as F

from sondeo.functions import privacy, stats
from sondeo.functions import text as T
from sondeo.operators import flow, survey, themes, topics
from sondeo.sources import documents


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_wilson_and_sizes(spark):
    lo, hi = stats.wilson(F.lit(270), F.lit(300))
    r = one(spark, lo, hi, stats.sample_size(F.lit(6000)), stats.rule_of_three(F.lit(200)))
    assert [round(x, 3) for x in r[:2]] == [0.861, 0.929]
    assert round(r[2], 1) == 361.1 and r[3] == pytest.approx(0.015)


@pytest.mark.parametrize("n,want", [(44, "B_censo"), (385, "B_censo"), (386, "intermedio_muestreo_reducido"), (1200, "A_completo")])
def test_protocol(spark, n, want):
    assert one(spark, stats.protocol(F.lit(n)))[0] == want


@pytest.mark.parametrize("n,want", [(17, 3), (60, 3), (78, 4), (119, 6)])
def test_least_comments(spark, n, want):
    assert one(spark, stats.least_comments(F.lit(n)))[0] == want


def test_rogan_gladen(spark):
    r = one(spark, stats.rogan_gladen(F.lit(0.3), F.lit(0.9), F.lit(0.95)), stats.rogan_gladen(F.lit(0.01), F.lit(0.9), F.lit(0.9)))
    assert r[0] == pytest.approx(0.25 / 0.85) and r[1] == 0


def test_binary(spark):
    df = spark.createDataFrame(list(zip([1, 1, 0, 0, 1, 0], [1, 0, 0, 1, 1, 0])), "y int, g int")
    r = stats.binary_metrics(df.agg(*stats.confusion(F.col("y"), F.col("g")))).first()
    assert (r.vp, r.fp, r.fn, r.vn) == (2, 1, 1, 2) and r.f1 == pytest.approx(2 / 3) and r.kappa == pytest.approx(1 / 3)
    assert stats.kappa(df, "y", "g").first()[0] == pytest.approx(1 / 3)


def test_multilabel(spark):
    df = spark.createDataFrame([(["a"], ["a", "b"]), ([], []), (["a", "b"], ["a"])], "t array<string>, g array<string>")
    r = stats.multilabel_metrics(df, "t", "g", 2).first()
    assert r.micro_f1 == pytest.approx(2 / 3) and r.hamming == pytest.approx(1 / 3) and r.exact_match == pytest.approx(1 / 3) and r.jaccard == pytest.approx(2 / 3)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(p,) for p in (0.01, 0.04, 0.03, 0.5)], "p double")
    got = {r.p: (round(r.p_adj, 4), r.reject) for r in stats.benjamini_hochberg(df, "p").collect()}
    assert got == {0.01: (0.04, True), 0.03: (0.0533, False), 0.04: (0.0533, False), 0.5: (0.5, False)}


def test_cramer(spark):
    df = spark.createDataFrame([("a", "x")] * 10 + [("b", "y")] * 10, "a string, b string")
    assert stats.chi_square(df, "a", "b").first().cramer_v == pytest.approx(1.0)


def test_calibration(spark):
    df = spark.createDataFrame([(0.05, 0), (0.95, 1)], "p double, y int")
    assert stats.calibration(df, "p", "y").first()[0] == pytest.approx(0.05)


def test_redaction(spark):
    cases = {
        "[19/10, 10:06 a. m.] Ana Ruiz: hola": "[19/10, 10:06 a. m.] [PERSONA]: hola",
        "Ana María Ruiz, docente": "[PERSONA], docente",
        "el profesor Juan Pérez dijo": "el profesor [PERSONA] dijo",
        "Bogotá, ciudad": "Bogotá, ciudad",
        "José@x.co y 3101234567": "[CORREO] y [TELEFONO]",
        "cédula 1023456": "cédula [NUMERO_ID]",
        "son 150000 pesos": "son 150000 pesos",
        "el 12345678": "el [TELEFONO]",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    for r in df.select("t", "want", privacy.redact("t").alias("got")).collect():
        assert r.got == r.want, r.t


def test_noise(spark):
    df = spark.createDataFrame([(None, "vacio"), ("  ", "vacio"), ("123!", "solo_signos_o_numeros"), ("no", "menos_de_3_letras"), ("Ninguno.", "no_respuesta"), ("más wifi", None)], "t string, want string")
    for r in df.select("want", T.noise_reason("t").alias("got")).collect():
        assert r.got == r.want


def test_zero_cells(spark):
    cube = spark.createDataFrame([("A", "Docentes", "t1", 6, 0), ("A", "Docentes", "t2", 6, 0), ("A", "Otros", "t1", 4, 0), ("B", "Docentes", "t1", 6, 2)], "u string, rol string, tema string, total int, n int")
    w = spark.createDataFrame([("t1", 30.0), ("t2", 5.0)], "tema string, weight double")
    assert [tuple(r)[1:3] for r in survey.zero_cells(cube, w, "tema").collect()] == [("A", "Docentes")]


def test_choose_k(spark):
    rows = [("a", 2, True, 0.9), ("a", 3, True, 0.8), ("a", 4, True, 0.7), ("b", 2, True, 0.5), ("b", 3, True, 0.65), ("c", 3, True, 0.4), ("c", 4, True, 0.3), ("d", 2, False, 0.9)]
    got = {r.group: r.k for r in topics.choose_k(spark.createDataFrame(rows, "group string, k int, valid boolean, stability double")).collect()}
    assert got == {"a": 3, "b": 3, "c": 3, "d": None}


def test_assignment_ties(spark):
    s = spark.createDataFrame([(1, "x", 0, 0.8), (1, "y", 1, 0.8), (2, "x", 0, 0.1), (2, "y", 1, 0.3)], "id int, tema string, ord int, p double")
    assert {(r.tema, r["rank"]) for r in themes.assign(s, "id").collect()} == {("x", 1), ("y", 2)}
    assert {r.id: r.principal for r in themes.principal(s, "id").collect()} == {1: "x", 2: "(cercano: y)"}


def brute_number(text):
    """The number rule in plain Python: six to eleven digits, with or without dots, go unless
    the three characters before or the eight after hold a sign of money."""
    out, last = [], 0
    for m in re.finditer(r"(?<![\d.])\d{1,3}(?:\.\d{3}){1,3}(?![\d.])|(?<!\d)\d{6,11}(?!\d)", text):
        near = text[max(0, m.start() - 3) : m.end() + 8].lower()
        digits = sum(c.isdigit() for c in m[0])
        if 6 <= digits <= 11 and not any(x in near for x in ("$", "peso", "mil")):
            out += [text[last : m.start()], "[NUMERO_ID]"]
            last = m.end()
    return "".join(out) + text[last:]


def test_numbers_of_persons_by_brute_force(spark):
    before = ["", "x", "soy Emil ", "cc. de Camil: ", "mil", "mil ", " mil", "$", "$ ", "$  ", "$   ", "US$", "peso ", "a.", "1.", "MIL", "fa\nmil"]
    numbers = ["99999", "923456", "9234567", "91234567890", "912345678901", "9.234.567", "923.456", "92.345", "923.456.789", "9.123.456.789", "923.456.789.012"]
    after = ["", ".", " ", " pesos", "  peso", "    peso", "     peso", " mil", "     mil", "      mil", "       $", "        $", "5", ".1", "Mil", "\n$"]
    texts = [b + n + a for b in before for n in numbers for a in after] + [f"{b}{n}, {b}{n}{a}" for b in before for n in numbers[1:4] for a in after]
    rule = next(r for r in privacy.RULES if r[0] == "NUMERO_ID")
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_replace("t", rule[2], rule[3]).alias("got"), F.regexp_like("t", F.lit(rule[1])).alias("gate"))
    for r in df.collect():
        assert r.got == brute_number(r.t), r.t
        assert r.gate or r.got == r.t


def test_gates_of_rules_lose_nothing(spark):
    texts = ["ana@x.co", "WWW.x.co", "HTTPS://a", "310 123 4567", "6012345678", "(1)234 5678", "cc 923456", "[1/2, 3:04 x] Ana Ruiz: y", "Ana Ruiz ,  Docente", "la Profesora\tÁngela", "DR. Juan", "nada"]
    df = spark.createDataFrame([(" ; ".join(texts[i : i + k]),) for i in range(len(texts)) for k in (1, 2, 5)], "t string")
    plain = F.col("t")
    for _, _, pattern, new in privacy.RULES:
        plain = F.regexp_replace(plain, pattern, new)
    for r in df.select("t", plain.alias("want"), privacy.redact("t").alias("got")).collect():
        assert r.got == r.want


def test_quantiles_from_counts(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(g, float(x)) for g in "ab" for x in np.round(rng.normal(0, 300, 500 if g == "a" else 7), 1)]
    got = survey.weighted_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"p25": 0.25, "p95": 0.95}).collect()
    for r in got:
        own = [x for g, x in rows if g == r.g]
        assert r.p25 == pytest.approx(np.percentile(own, 25)) and r.p95 == pytest.approx(np.percentile(own, 95)) and r.max == max(own)


def test_containment_of_short_phrases(spark):
    docs = spark.createDataFrame([(1, "uno dos tres cuatro"), (2, "abcdefghij k"), (3, None), (4, "tres")], "doc_id long, text string")
    phrases = spark.createDataFrame([(7, "os tres cua"), (8, "cdefghij"), (9, "tres cuatro"), (10, "no esta en ninguno")], "item long, text string")
    assert sorted(map(tuple, survey.containment(docs, phrases, "doc_id", "item", "text").collect())) == [(1, 7), (1, 9), (2, 8)]


def test_stability_of_separated_clusters(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (40, 3)) for c in (np.eye(3) * 2)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r.k: r for r in topics.stability_curve(df, "id", "v", [3, 4], reps=2, starts=3, rounds=10).collect()}
    assert got[3].stability == 1.0 and got[3].smallest == 40 and got[3].silhouette > 0.95 and got[4].stability < 1.0 and got[4].smallest < 40


def test_failing_scorers(spark):
    texts = spark.createDataFrame([(i, "t" * i) for i in range(1, 8)], "k long, t string")

    def scorer(bad):
        def run(batch):
            for t in batch:
                if len(t) in bad:
                    raise ValueError("no answer")
                yield {"a": 0.5}

        return run

    first = themes.plug_in_scores(texts, scorer({3, 5}), "k", "t").collect()
    assert {r.k for r in first if r.error} == {3, 5} and {r.k for r in first if not r.error} == {1, 2, 4, 6, 7}
    done = flow.with_retry(texts, scorer({3, 5}), scorer({5}), "k", "t")
    assert [r.k for r in flow.incomplete(texts, done, "k", ["a"]).collect()] == [5]


def test_forms_of_files(spark):
    rows = [("/x/Encuesta (UC\u00a0Vida).parquet", "Vida"), ("/x/a (otra) (uc  vida).parquet", "Vida"), ("/x/a (1).parquet", None), ("/(UC Vida)/a.parquet", None)]
    df = spark.createDataFrame(rows, "p string, want string")
    for r in df.select("want", documents.form_of_file("p", {"UC VIDA": "Vida"}).alias("got")).collect():
        assert r.got == r.want


def test_strict_lookup_raises(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "x")], "k long, v string")
    with pytest.raises(KeyError):
        survey.strict_lookup(a, b, "k")
    assert survey.strict_lookup(a.filter("k = 1"), b, "k").count() == 1
