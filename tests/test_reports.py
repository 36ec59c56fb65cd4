"""Redaction and names by brute force, canonical JSON, and the report tables' odd cases."""

import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from sondeo import registry
from sondeo.functions import privacy
from sondeo.functions import text as T
from sondeo.operators import reports, survey
from sondeo.sources import documents

CAPS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZÁÉÍÓÚÑÜ", "abcdefghijklmnopqrstuvwxyzáéíóúñü"
word = lambda c: c.isalnum() or c == "_"


def brute_mail(t):
    """Runs of name characters, an @, and a host of two parts or more."""
    out, at = [], 0
    while at < len(t):
        a = at
        while a < len(t) and (word(t[a]) or t[a] in ".+-"):
            a += 1
        if a > at and a < len(t) and t[a] == "@":
            end = a + 1
            while end < len(t) and (word(t[end]) or t[end] == "-"):
                end += 1
            host, stop = end > a + 1, None
            while host and end < len(t) and t[end] == ".":
                e = end + 1
                while e < len(t) and (word(t[e]) or t[e] == "-"):
                    e += 1
                if e == end + 1:
                    break
                end = stop = e
            if stop:
                out.append("[CORREO]")
                at = stop
                continue
        out.append(t[at : max(a, at + 1)])
        at = max(a, at + 1)
    return "".join(out)


def brute_url(t):
    out, at = [], 0
    while at < len(t):
        head = next((h for h in ("https://", "http://", "www.") if t[at : at + len(h)].lower() == h), None)
        end = at + len(head) if head else at
        while head and end < len(t) and not t[end].isspace():
            end += 1
        if head and end > at + len(head):
            out.append("[URL]")
            at = end
        else:
            out.append(t[at])
            at += 1
    return "".join(out)


def brute_phone(t, groups, heads):
    """Digits in groups with up to one separator between, no digit before or after."""
    out, at = [], 0
    while at < len(t):
        hit = 0
        if at == 0 or not t[at - 1].isdigit():
            for head in heads(t, at):
                end = head
                for i, g in enumerate(groups):
                    if i and end < len(t) and (t[end].isspace() or t[end] in ".-"):
                        end += 1
                    if not (t[end : end + g].isdigit() and len(t[end : end + g]) == g):
                        break
                    end += g
                else:
                    if end == len(t) or not t[end].isdigit():
                        hit = end
                        break
        out.append("[TELEFONO]" if hit else t[at])
        at = hit or at + 1
    return "".join(out)


def mobile_heads(t, at):
    for pre in ("+57", "57", ""):
        if t.startswith(pre, at):
            for gap in ((1, 0) if pre else (0,)):
                i = at + len(pre) + gap
                if (not gap or (t[at + len(pre) : i] and (t[at + len(pre)].isspace() or t[at + len(pre)] in ".-"))) and t[i : i + 1] == "3":
                    yield i


def names_from(t, at, least, most):
    """The end of a run of capitalised words that begins here, and the ends after each word."""
    ends, i = [], at
    while len(ends) < most:
        j = i + 1
        while i < len(t) and t[i] in CAPS and j < len(t) and t[j] in SMALL:
            j += 1
        if i >= len(t) or t[i] not in CAPS or j < i + 2:
            break
        ends.append(j)
        i = j
        while i < len(t) and t[i].isspace():
            i += 1
        if i == j:
            break
    return ends if len(ends) >= least else []


def apply(df, kind, which=None):
    """The rules of one kind (the n-th, if ``which`` says so) as they stand in the chain."""
    out = F.col("t")
    rules = [r for r in privacy.RULES if r[0] == kind]
    for _, gate, pattern, new in rules if which is None else rules[which : which + 1]:
        out = F.when(privacy._where(out, gate), F.regexp_replace(out, pattern, new)).otherwise(out)
    return {r.t: r.got for r in df.select("t", out.alias("got")).collect()}


def mixed(seed, parts, n=1500):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(n)]


def test_mails_and_urls(spark):
    texts = mixed(1, ["ana", "José", "@", "x", ".", "-", "co", " ", "é.é", "+", "_", "@@", "x.co", "\n", "http://", "HTTPS://", "www.", "WWW", "w", "/a?b", "http:/"])
    df = spark.createDataFrame([(t,) for t in texts], "t string").distinct()
    for t, got in apply(df, "CORREO").items():
        assert got == brute_mail(t), t
    for t, got in apply(df, "URL").items():
        assert got == brute_url(t), t


def test_phones(spark):
    texts = mixed(2, ["310", "3101234567", "123", "4567", " ", "-", ".", "+57", "57", "a", "1", "  ", "12", "601", "(1)", "60", "2345678"])
    df = spark.createDataFrame([(t,) for t in texts], "t string").distinct()
    for t, got in apply(df, "TELEFONO", 0).items():
        assert got == brute_phone(t, (3, 3, 4), mobile_heads), t


def brute_header(t):
    return re.sub(r"(\[[0-9]{1,2}/[0-9]{1,2}(?:/[0-9]{2,4})?,?[ \t\n\r\f\v]*[0-9]{1,2}:[0-9]{2}[^\]]*\])[ \t\n\r\f\v]*[^:\[\]\n]{2,60}:", r"\1 [PERSONA]:", t)


def brute_title(t):
    titles = privacy.TITLES.replace("\\.?", ".").split("|")
    titles = sorted({x for y in titles for x in (y, y.rstrip("."))}, key=lambda x: -len(x))
    out, at = [], 0
    while at < len(t):
        hit = None
        if at == 0 or not word(t[at - 1]) or not word(t[at]):
            for x in sorted(titles, key=len, reverse=True):
                if t[at : at + len(x)].lower() == x and (at == 0 or not word(t[at - 1])):
                    i = at + len(x)
                    while i < len(t) and t[i].isspace():
                        i += 1
                    ends = names_from(t, i, 1, 2) if i > at + len(x) else []
                    if ends:
                        hit = (x, ends[-1])
                        break
        if hit:
            out.append(t[at : at + len(hit[0])] + " [PERSONA]")
            at = hit[1]
        else:
            out.append(t[at])
            at += 1
    return "".join(out)


def test_headers_and_titles(spark):
    texts = mixed(3, ["[1/2, 3:04 p. m.] ", "[01/12/24 10:30]", "[1/2] ", "Ana Ruiz: ", "x:", ": ", "y", "\n", "[PERSONA]: ", "a" * 61 + ":"])
    for t, got in apply(spark.createDataFrame([(t,) for t in texts], "t string").distinct(), "PERSONA", 0).items():
        assert got == brute_header(t), t
    texts = mixed(4, ["profesor ", "Profesora  ", "DR. ", "dra ", "docente\n", "Ana", "Ruiz ", "María ", "Óscar", "de ", " ", "ana", "ing.", "X", "Ñu "])
    for t, got in apply(spark.createDataFrame([(t,) for t in texts], "t string").distinct(), "PERSONA", 2).items():
        assert got == brute_title(t), t


def test_signatures(spark):
    cases = {"Ana Ruiz, docente": "[PERSONA], docente", "Ana, docente": "Ana, docente", "Ana María Ruiz Gil Paz ,  Facultad x": "[PERSONA] ,  Facultad x", "Ana Ruiz, docentes": "Ana Ruiz, docentes", "ana Ruiz, docente": "ana Ruiz, docente", "Ana Ruiz. Docente": "Ana Ruiz. Docente", "Éva Ñañez, EGRESADA de": "[PERSONA], EGRESADA de", "Uno Ana Ruiz Gil Paz Sol, programa": "Uno [PERSONA], programa", "Ana Ruiz\n, gestora": "[PERSONA]\n, gestora"}
    got = apply(spark.createDataFrame([(t,) for t in cases], "t string"), "PERSONA", 1)
    assert got == cases


def test_names_gate(spark):
    people = spark.createDataFrame([("Óscar Iván Ruiz",), ("ANA maria",), ("Al x",), (None,), ("  ",)], "n string")
    given = privacy.given_names(people, "n")
    assert sorted(r.nombre for r in given.collect()) == ["ana", "oscar"]
    texts = [(1, "dijo Oscar Iván Ruiz que"), (2, "Oscar Ruiz"), (3, "Luis Iván Ruiz"), (4, "[1/2, 3:04] Pepe: hola"), (5, "[1/2, 3:04] [PERSONA]: hola"), (6, "Ana María Gil, decano"), (7, None)]
    df = spark.createDataFrame(texts, "k long, t string")
    found = {r.k: r.kinds for r in privacy.residual_names(df, "k", "t", given).collect()}
    assert found == {1: ["nombre_probable"], 4: ["whatsapp"], 6: ["firma", "nombre_probable"]}
    with pytest.raises(privacy.ResidualNamesError, match=r"^3 texts hold names: 1 \['nombre_probable'\], 4"):
        privacy.no_names_or_stop(df, "k", "t", given)
    clean = df.filter("k in (2, 3, 5, 7)")
    assert privacy.no_names_or_stop(clean, "k", "t", given).count() == 4


def test_canonical_json(spark):
    rows = [({"b": 1, "a": None}, ["x", 'q"\\\n', None], (2, "é😀", True)), (None, [], None), ({}, None, (None, "", False))]
    df = spark.createDataFrame(rows, "m map<string,int>, l array<string>, s struct<z: int, a: string, ok: boolean>").select(F.struct("s", "m", "l").alias("all"))
    kind = df.schema["all"].dataType
    for r in df.select("all", T.canonical_json(F.col("all"), kind).alias("j"), T.canonical_json(F.col("all"), kind, (",", ":")).alias("c")).collect():
        value = r["all"].asDict(True)
        assert r.j == json.dumps(value, sort_keys=True, ensure_ascii=False) and r.c == json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def test_lines_of_json(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nb"), (2, None)], "k long, t string")
    documents.write_json_lines(rows.coalesce(1), str(tmp_path / "l"))
    documents.write_json_lines(rows.coalesce(1), str(tmp_path / "l"))
    lines = spark.read.text(str(tmp_path / "l"))
    assert sorted(r.value for r in lines.collect()) == ['{"k":1,"t":"a\\nb"}'] * 2 + ['{"k":2,"t":null}'] * 2
    blank = lines.unionByName(spark.createDataFrame([("",), ("  ",)], "value string"))
    assert sorted((r.k, r.t) for r in documents.json_lines(blank, "value", "k long, t string").filter("k = 1").collect()) == [(1, "a\nb")] * 2 and documents.json_lines(blank, "value", "k long, t string").count() == 4


def test_group_summary(spark):
    groups = spark.createDataFrame([("a", 50), ("b", 10), ("c", 30)], "g string, n long")
    curve = spark.createDataFrame([("a", 2, 50, 0.7, 0.1), ("a", 3, 50, 0.8, 0.2)], "g string, k int, n long, stability double, silhouette double")
    chosen = spark.createDataFrame([("a", 3), ("c", None)], "g string, k int")
    ref = spark.createDataFrame([("a", 4, 0.5)], "g string, clusters long, outliers double")
    got = {r.g: (r.modelado, r.k, r.nivel, r.densidad) for r in reports.group_summary(groups, curve, chosen, ref, "g").collect()}
    assert got == {"a": ("Sí", 3, "estable", 4), "b": ("No: menos de 20 comentarios", None, None, None), "c": ("No: ningún k deja temas del tamaño mínimo", None, None, None)}


def test_k08_copy_is_redacted(spark):
    from sondeo import registry, registry_reports  # noqa: F401

    rows = {r.doc_id: r.comentario for r in registry.QUERIES["k08_redacted_copy"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.h for r in docs.select("doc_id", F.sha2(privacy.redact("text"), 256).alias("h")).collect()}
    assert rows == want and len(rows) == docs.count()


def test_counters_are_those_of_the_marks(spark):
    """Each replacement is counted under its kind, on the text that the rules before it left."""
    texts = mixed(6, ["ana@x.co ", "http://x ", "3101234567 ", "cédula 1023456 ", "profesor Juan ", "y ", "Ana Ruiz, docente ", "\n"], 300)
    rows = privacy.redact_counted(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r in rows:
        for kind in privacy.KINDS:
            assert r[f"n_{kind.lower()}"] == r.redacted.count(f"[{kind}]"), r.text
    assert all(sum(r[f"n_{k.lower()}"] for r in rows) > 20 for k in privacy.KINDS)


def test_each_rule_of_redaction_stands_once_in_a_plan(spark):
    """Rules on what the rules before left, named three times each, made 3**8 copies of the text."""
    df = spark.createDataFrame([(1, "escriba a ana.ruiz@uni.edu o al 310 555 1234, Ana María Ruiz, docente")], "doc_id int, text string")
    cases = [df.select(privacy.redact("text").alias("t")), survey.clean_answers(df).filter("anon is not null"), df.select(privacy.name_audit(privacy.redact("text")).alias("kinds"))]
    for out, most in zip(cases, (1, 2, 2)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("[CORREO]") <= most
    assert cases[0].first()[0] == "escriba a [CORREO] o al [TELEFONO], [PERSONA], docente"


def test_joined_and_blanks_are_those_of_plain_patterns(spark):
    texts = ["", "_", " a  b_c\t d__e-\n", " x", "__ ¼ Æ _é_", "a - b", "\t", "a\tb", "x _ y", "ŀl ĳ ﬁ … 1⁄2 ㎏", "A-_b "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(T.normalise(F.col("t")), T.slug(F.col("t")), T.file_part(F.col("t"))).collect()
    for t, (norm, slug, part) in zip(texts, got):
        flat = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
        want = re.sub(r"\s+", " ", flat.lower(), flags=re.A).strip(" ")
        assert (norm, slug, part) == (want, re.sub("[^a-z0-9]+", "_", want).strip("_"), re.sub("[^A-Za-z0-9]+", "_", flat).strip("_"))


def test_texts_are_taken_apart_once(spark):
    """An inner explode made the optimiser filter by the array's size, and so match each text twice."""
    plan = registry._class_terms(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
