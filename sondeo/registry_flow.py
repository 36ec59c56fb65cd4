"""Queries of the survey flows: theme lists, answers, gates, reports and topic models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import privacy, stats
from .functions import text as T
from .operators import flow, scoring, survey, themes, topics
from .registry import NAMES, SQL_CELLS, SQL_FACTS, SQL_NOISE, SQL_SCORES, SQL_TERMS, THEMES, _cells, _top_words, _words, comments, facts, items_of, query, r6, scored, scores, sql_normal, table
from .sources import documents as sources
from .sources.tables import written

TAU = themes.TAU
COMPONENTS = ["palabras de paso", "lugares y tiempos", "origen y materia"]
#: A framework document: numbered sections with bold subtitles.
FRAMEWORK = """# Marco

| 1 | **Lengua viva** |
| 2 | **Tierra y tiempo** |

## 1. Lengua viva

**Qué busca**
Que las palabras de paso unan y que lo que une las frases largas se vea.

**Componentes preliminares**
- palabras de paso
- lugares y tiempos
- origen y materia

---

## 2. Tierra y tiempo

**Qué busca**
Cuidar.

**Componentes preliminares**
- suelos

---
""".split("\n")
SECTION = FRAMEWORK[8]
#: A theme list: theme, name, component, other components, critical.
LIST = [
    ("articulos", "Artículos", "palabras de paso", [], False),
    ("enlaces", "Enlaces", "une las frases largas", ["palabras de paso"], False),
    ("lugar", "Lugares", "lugares y tiempos", [], False),
    ("origen", "Orígenes", themes.GENERAL, [], False),
    ("duda", "Dudas", themes.OUTSIDE, [], True),
]
ANCHORS = {themes.GENERAL: "La transformación en general", themes.OUTSIDE: "Fuera de la transformación"}
LIST_DDL = "tema string, ord int, nombre string, componente string, otros array<string>, critico boolean"
SQL_LIST = "lista(tema, ord, nombre, componente, otros, critico) AS (VALUES " + ", ".join(f"('{t}', {i}, '{n}', '{c}', {o}::VARCHAR[], {k})" for i, (t, n, c, o, k) in enumerate(LIST)) + ")"
SQL_LINES = "lines(pos, line) AS (VALUES " + ", ".join(f"({i + 1}, '{x}')" for i, x in enumerate(FRAMEWORK)) + ")"
SQL_ALL = f"{SQL_FACTS}, {SQL_LIST}, items AS (SELECT doc_id, lang, source, text FROM documents WHERE ({SQL_NOISE}) IS NULL)"


def theme_list(spark):
    return spark.createDataFrame([(t, i, n, c, o, k) for i, (t, n, c, o, k) in enumerate(LIST)], LIST_DDL)


def lines(spark):
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(FRAMEWORK)], "at int, line string")


# ---- the flagship report -------------------------------------------------------------------
_CLASS = "CASE WHEN list_contains({c}, componente) THEN 0 WHEN componente = '{g}' THEN 2 WHEN componente = '{o}' THEN 3 ELSE 1 END".format(c=COMPONENTS, g=themes.GENERAL, o=themes.OUTSIDE)
_LABEL = f"CASE componente WHEN '{themes.GENERAL}' THEN '{ANCHORS[themes.GENERAL]}' WHEN '{themes.OUTSIDE}' THEN '{ANCHORS[themes.OUTSIDE]}' ELSE componente END"
_PCT = "(CASE WHEN x - floor(x) = 0.5 THEN (floor(x) + (floor(x)::BIGINT % 2))::BIGINT ELSE round(x)::BIGINT END)::VARCHAR || '%'"
SQL_Z = "(SELECT 1.959964 AS z)"
SQL_LO = "round(greatest(0, (k/total + z*z/(2*total))/(1+z*z/total) - z*sqrt(k/total*(1-k/total)/total + z*z/(4*total*total))/(1+z*z/total)), 6)"
SQL_HI = "round(least(1, (k/total + z*z/(2*total))/(1+z*z/total) + z*sqrt(k/total*(1-k/total)/total + z*z/(4*total*total))/(1+z*z/total)), 6)"


@query(f"""WITH {SQL_ALL}, n AS (SELECT count(*)::DOUBLE AS total FROM items),
g AS (SELECT tema, count(*) AS n, avg(p) AS mp, arg_max(doc_id, (p, -doc_id)) AS best, max(p) AS x0 FROM facts GROUP BY tema),
s AS (SELECT (SELECT count(*) FROM items) - (SELECT count(DISTINCT doc_id) FROM facts) AS sin_tema),
r AS (SELECT {_LABEL} || CASE WHEN len(otros) > 0 THEN ' (también: ' || array_to_string(otros, '; ') || ')' ELSE '' END AS componente, nombre AS tema, coalesce(g.n, 0) AS n, coalesce(g.n, 0)::DOUBLE AS k, mp, best, x0, {_CLASS} AS cls, coalesce(list_position({COMPONENTS}, componente), 0) AS pos, ord FROM lista LEFT JOIN g USING (tema))
SELECT row_number() OVER (ORDER BY cls, pos, n DESC, ord) AS orden, componente, tema, n, round(k/total, 6) AS share, {SQL_LO} AS lo, {SQL_HI} AS hi, round(mp, 6) AS mean_p, best, (SELECT {_PCT} FROM (SELECT x0 * 100 AS x)) AS best_p, sin_tema FROM r, n, s, {SQL_Z}
UNION ALL SELECT (SELECT count(*) FROM lista) + row_number() OVER (ORDER BY i), c, '(ningún comentario)', 0, 0, NULL, NULL, NULL, NULL, NULL, sin_tema FROM (SELECT unnest({COMPONENTS}) AS c, unnest(range({len(COMPONENTS)})) AS i), s WHERE c NOT IN (SELECT componente FROM lista) AND c NOT IN (SELECT unnest(otros) FROM lista)""")
def r01_theme_report(spark, d):
    return flow.theme_report(theme_list(spark), scored(spark, d), "doc_id", COMPONENTS, ANCHORS)


@query(f"""WITH {SQL_ALL}, b AS (SELECT doc_id, s.tema, p, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, s.ord) AS r FROM scores s)
SELECT d.doc_id, d.lang, d.source, CASE WHEN m = 'vacio' THEN '(sin comentario)' WHEN m IS NOT NULL THEN '(sin contenido: ' || m || ')' WHEN p >= 0.7 THEN nombre ELSE 'Sin tema asignado (más cercano: ' || nombre || ')' END AS principal,
 CASE WHEN p >= 0.7 THEN {_LABEL} ELSE '' END AS componente, round(p, 6) AS confianza, """ + ", ".join(f"round(max(f.p2) FILTER (f.t2 = '{t}'), 6) AS {t}" for t in NAMES) + f"""
FROM (SELECT *, {SQL_NOISE} AS m FROM documents) d LEFT JOIN (SELECT * FROM b WHERE r = 1) USING (doc_id) LEFT JOIN lista USING (tema) LEFT JOIN (SELECT doc_id, tema AS t2, p AS p2 FROM facts) f ON f.doc_id = d.doc_id GROUP BY ALL""")
def r02_classification(spark, d):
    docs = table(spark, d, "documents").withColumn("motivo", T.noise_reason("text")).select("doc_id", "lang", "source", "motivo")
    return flow.classification_report(docs, scores(spark, d), theme_list(spark), "doc_id", NAMES, ANCHORS)


# ---- list checks and gates -----------------------------------------------------------------
SQL_CODING = "coding AS (SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN list_append(t, 'otro') ELSE t END AS temas FROM (SELECT i.doc_id, coalesce(list(tema) FILTER (tema IS NOT NULL), []) AS t FROM items i LEFT JOIN facts USING (doc_id) GROUP BY ALL) WHERE doc_id % 50 <> 0 UNION ALL SELECT -1, []::VARCHAR[] UNION ALL SELECT -1, []::VARCHAR[])"


def _coding(spark, d, s):
    sets = s.filter(F.col("p") >= TAU).groupBy("doc_id").agg(F.collect_list("tema").alias("t"))
    none = F.array().cast("array<string>")
    own = items_of(s).select("doc_id").join(sets, "doc_id", "left").withColumn("t", F.coalesce("t", none)).filter("doc_id % 50 <> 0")
    own = own.select("doc_id", F.when(F.col("doc_id") % 97 == 0, F.array_append("t", F.lit("otro"))).otherwise(F.col("t")).alias("temas"))
    return own.unionByName(spark.range(2).select(F.lit(-1).cast("long").alias("doc_id"), none.alias("temas")))


@query(f"""WITH {SQL_ALL}, {SQL_CODING}, f AS (SELECT DISTINCT doc_id, tema FROM (SELECT doc_id, unnest(temas) AS tema FROM coding) WHERE tema IN (SELECT tema FROM lista)),
 n AS (SELECT count(DISTINCT doc_id) AS total FROM items), sz AS (SELECT tema, componente, critico, count(doc_id) AS n FROM lista LEFT JOIN f USING (tema) GROUP BY ALL), so AS (SELECT *, componente = '{themes.OUTSIDE}' AND n < ceil(total * 0.10) AS small FROM sz, n),
 u AS (SELECT tema, componente AS c FROM lista UNION ALL SELECT tema, unnest(otros) FROM lista)
SELECT 'component' AS rule, tema AS subject, c AS detail FROM u WHERE NOT (list_contains({COMPONENTS + [themes.GENERAL, themes.OUTSIDE]}, c) OR (length(c) >= 8 AND contains('{SECTION}', c)))
UNION ALL SELECT 'coded_twice', doc_id::VARCHAR, count(*)::VARCHAR FROM coding GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'not_coded', doc_id::VARCHAR, '' FROM items WHERE doc_id NOT IN (SELECT doc_id FROM coding)
UNION ALL SELECT 'unknown_item', doc_id::VARCHAR, '' FROM coding WHERE doc_id NOT IN (SELECT doc_id FROM items)
UNION ALL (SELECT DISTINCT 'unknown_theme', t, '' FROM (SELECT unnest(temas) AS t FROM coding) WHERE t NOT IN (SELECT tema FROM lista))
UNION ALL SELECT 'small_outside', 'list', count(*)::VARCHAR FROM so WHERE small HAVING count(*) > 1
UNION ALL SELECT 'too_small', tema, n::VARCHAR FROM so WHERE n < CASE WHEN critico THEN 0 WHEN componente = '{themes.GENERAL}' OR small THEN 2 ELSE greatest(3, ceil(total * 0.05)) END
UNION ALL SELECT 'overlap', a || '~' || b, printf('%.4f', j) FROM (SELECT x.tema AS a, y.tema AS b, count(*) / (max(nx.n) + max(ny.n) - count(*)) AS j FROM f x JOIN f y USING (doc_id) JOIN sz nx ON nx.tema = x.tema JOIN sz ny ON ny.tema = y.tema WHERE x.tema < y.tema GROUP BY ALL) WHERE j > 0.5""")
def q02_list_violations(spark, d):
    s = scored(spark, d)
    coding = written(_coding(spark, d, s), "coding")
    return themes.list_violations(theme_list(spark), coding, items_of(s).select("doc_id"), "doc_id", COMPONENTS, SECTION)


SQL_SIGNED = f"{SQL_TERMS}, model AS (SELECT lang, string_agg(term, ', ' ORDER BY rank) FILTER (rank <= 5) AS firma, string_agg(term, ', ' ORDER BY rank) FILTER (rank <= 3) AS tres FROM top GROUP BY lang)"
#: Saved names of topics: topic, name, whether its signature is the model's.
SAVED = [("de", "Texto alemán", True), ("en", "Texto inglés", False), ("es", "", True), ("xx", "Otro", True)]
SQL_SAVED = "saved AS (SELECT v.lang, nombre, CASE WHEN good THEN firma ELSE 'vieja, firma' END AS firma FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in SAVED) + ") v(lang, nombre, good) LEFT JOIN model USING (lang))"


def _model(spark, d):
    return written(flow.signatures(_top_words(spark, d), "lang"), "model")


def _saved(spark, model):
    v = spark.createDataFrame(SAVED, "lang string, nombre string, good boolean")
    return v.join(model.select("lang", "firma"), "lang", "left").select("lang", "nombre", F.when(F.col("good"), F.col("firma")).otherwise("vieja, firma").alias("firma"))


@query(f"WITH {SQL_SIGNED}, {SQL_SAVED} SELECT 'empty_field' AS rule, lang AS subject, 'nombre' AS detail FROM saved WHERE nombre = '' UNION ALL SELECT 'missing_topic', lang, '' FROM model WHERE lang NOT IN (SELECT lang FROM saved) UNION ALL SELECT 'unknown_topic', lang, '' FROM saved WHERE lang NOT IN (SELECT lang FROM model) UNION ALL SELECT 'signature', lang, s.firma FROM saved s JOIN model m USING (lang) WHERE s.firma <> m.firma")
def q03_topic_list(spark, d):
    model = _model(spark, d)
    return flow.topic_list_violations(_saved(spark, model), model, "lang")


@query(f"WITH {SQL_SIGNED}, {SQL_SAVED} SELECT m.lang, CASE WHEN s.firma = m.firma THEN s.nombre ELSE upper(tres[1]) || substr(tres, 2) END AS nombre FROM model m LEFT JOIN saved s USING (lang)")
def v18_f16_topic_names(spark, d):
    model = _model(spark, d)
    return flow.readable_names(model, _saved(spark, model), "lang")


#: Origins of a common list: theme, group, topic.
ORIGINS = [("a", "de", 0), ("a", "en", 0), ("b", "en", 1), ("b", "de", 0), ("c", "fr", 7)]
SQL_ORIGINS = "orig(tema, grupo, n) AS (VALUES " + ", ".join(map(str, ORIGINS)) + "), expected AS (SELECT DISTINCT lang AS grupo, (doc_id % 2)::INT AS n FROM documents)"


@query(f"WITH {SQL_ORIGINS} SELECT 'covered_twice' AS rule, grupo || ':' || n AS subject, count(*)::VARCHAR AS detail FROM orig GROUP BY grupo, n HAVING count(*) > 1 UNION ALL SELECT 'not_covered', grupo || ':' || n, '' FROM expected WHERE (grupo, n) NOT IN (SELECT grupo, n FROM orig) UNION ALL (SELECT DISTINCT 'unknown_topic', grupo || ':' || n, '' FROM orig WHERE (grupo, n) NOT IN (SELECT grupo, n FROM expected))")
def q04_origin_cover(spark, d):
    origins = spark.createDataFrame([(t, g, n) for t, g, n in ORIGINS], "tema string, grupo string, n int").groupBy("tema").agg(F.collect_list(F.struct("grupo", "n")).alias("origen"))
    expected = table(spark, d, "documents").select(F.col("lang").alias("grupo"), (F.col("doc_id") % 2).cast("int").alias("n")).distinct()
    return flow.origin_violations(origins, expected)


SQL_SEC = f"{SQL_LINES}, heads AS (SELECT pos, regexp_extract(line, '^## (\\d+)\\. (.+?)\\s*$', 1)::INT AS numero, regexp_extract(line, '^## (\\d+)\\. (.+?)\\s*$', 2) AS nombre FROM lines WHERE regexp_matches(line, '^## \\d+\\. .+$')), sec AS (SELECT numero, nombre, h.pos AS linea_ini, max(l.pos) AS linea_fin FROM heads h JOIN lines l ON l.pos >= h.pos AND l.pos < coalesce((SELECT min(pos) FROM lines x WHERE x.pos > h.pos AND starts_with(x.line, '## ')), 1e9) AND (l.pos = h.pos OR trim(l.line) NOT IN ('', '---')) GROUP BY ALL)"
SQL_BLOCKS = f"{SQL_SEC}, body AS (SELECT numero, pos, line, sum((regexp_matches(trim(line), '^\\*\\*.*\\*\\*$'))::INT) OVER (PARTITION BY numero ORDER BY pos) AS b FROM sec JOIN lines ON pos > linea_ini AND pos <= linea_fin), blocks AS (SELECT numero, regexp_extract(trim(first(line ORDER BY pos)), '^\\*\\*(.*)\\*\\*$', 1) AS titulo, list(rtrim(line) ORDER BY pos) FILTER (trim(line) <> '' AND NOT regexp_matches(trim(line), '^\\*\\*.*\\*\\*$')) AS lineas FROM body WHERE b > 0 GROUP BY numero, b)"


@query(f"WITH {SQL_SEC} SELECT numero, nombre, linea_ini, linea_fin FROM sec")
def s09_sections(spark, d):
    return sources.sections(lines(spark)).select("numero", "nombre", "linea_ini", "linea_fin")


@query(f"WITH {SQL_BLOCKS} SELECT numero, titulo, array_to_string(lineas, '|') AS lineas FROM blocks")
def s10_blocks(spark, d):
    return sources.blocks(sources.sections(lines(spark))).select("numero", "titulo", F.array_join("lineas", "|").alias("lineas"))


@query(f"WITH {SQL_BLOCKS} SELECT 'T' || numero AS id, nombre, array_to_string(list_transform(lineas, lambda x: trim(ltrim(x, '- '))), '|') AS componentes FROM sec JOIN blocks USING (numero) WHERE titulo = 'Componentes preliminares' AND nombre = 'Tierra y tiempo' UNION ALL SELECT 'T0', 'Formulario general', string_agg(nombre, '|' ORDER BY numero) FROM sec")
def s11_transformation(spark, d):
    sec = sources.sections(lines(spark))
    return sources.transformation(sec, "TIERRA  y tiempo").unionByName(sources.general_form(sec, "Formulario general"))


@query(f"WITH {SQL_BLOCKS}, tab AS (SELECT regexp_extract(line, '^\\|\\s*(\\d)\\s*\\|\\s*\\*\\*(.+?)\\*\\*\\s*\\|', 1)::INT AS numero, regexp_extract(line, '^\\|\\s*(\\d)\\s*\\|\\s*\\*\\*(.+?)\\*\\*\\s*\\|', 2) AS nombre FROM lines WHERE regexp_matches(line, '^\\|\\s*\\d\\s*\\|')), want AS (SELECT unnest(range(1, 6))::INT AS numero) SELECT 'missing_section' AS rule, numero::VARCHAR AS subject, '' AS detail FROM want WHERE numero NOT IN (SELECT numero FROM sec) UNION ALL SELECT 'summary_name', numero::VARCHAR, coalesce(tab.nombre, '') FROM sec LEFT JOIN tab USING (numero) WHERE tab.nombre IS DISTINCT FROM sec.nombre UNION ALL SELECT 'missing_boundary', 'T' || a.numero || '-T' || b.numero, '' FROM want a JOIN want b ON a.numero < b.numero WHERE (a.numero, b.numero) NOT IN ((1, 2), (1, 3))")
def q01_framework(spark, d):
    return sources.framework_violations(lines(spark), ["T1-T2", "T1-T3"])


@query(f"""WITH {SQL_CELLS}, {SQL_LIST}, w AS (SELECT tema, 100.0 * count(*) / (SELECT count(*) FROM i) AS weight FROM facts GROUP BY tema), z AS (SELECT lang, source, tema FROM cells JOIN w USING (tema) WHERE N_ >= 5 AND n = 0 AND weight >= 15), sc AS (SELECT doc_id, tema, CASE WHEN doc_id % 211 = 0 AND tema = 'lugar' THEN NULL ELSE p END AS p FROM scores WHERE doc_id % 307 <> 1)
SELECT 'no_probability' AS rule, tema AS subject, count(*)::VARCHAR AS detail FROM sc WHERE p IS NULL GROUP BY tema
UNION ALL SELECT 'rows', 'scores', (SELECT count(DISTINCT doc_id) FROM sc)::VARCHAR || '/' || (SELECT count(*) FROM i)::VARCHAR WHERE (SELECT count(DISTINCT doc_id) FROM sc) <> (SELECT count(*) FROM i)
UNION ALL SELECT 'zero_cell', lang || '|' || source || '|' || tema, '' FROM z
UNION ALL SELECT 'too_small', tema, count(doc_id)::VARCHAR FROM lista LEFT JOIN facts USING (tema) WHERE NOT critico GROUP BY tema HAVING count(doc_id) < 3""")
def q05_coherence_gate(spark, d):
    whole = scored(spark, d)
    s = whole.filter("doc_id % 307 <> 1").withColumn("p", F.when((F.col("doc_id") % 211 == 0) & (F.col("tema") == "lugar"), F.lit(None)).otherwise(F.col("p")))
    f = whole.filter(F.col("p") >= TAU)
    return flow.coherence_violations(s, f, items_of(whole), _cells(spark, d, whole), theme_list(spark), spark.createDataFrame([], "lang string, source string, tema string"), "doc_id", ["lang", "source"])


@query(f"WITH {SQL_FACTS} SELECT 'assignments' AS rule, count(*) AS a, (SELECT sum(n)::BIGINT FROM (SELECT tema, count(*) AS n FROM facts GROUP BY tema)) AS b FROM facts UNION ALL SELECT 'rows', count(*), (SELECT count(DISTINCT doc_id) FROM documents) FROM documents UNION ALL SELECT 'p_range', count(*) FILTER (p < 0 OR p > 1), 0 FROM scores")
def q06_reconciliation(spark, d):
    return flow.reconcile(table(spark, d, "documents"), scores(spark, d), facts(spark, d), "doc_id")


@query()
def q11_residual_names(spark, d):
    """Rows of redacted texts that still hold a name of one of the audited kinds."""
    docs = table(spark, d, "documents").select("doc_id", privacy.redact("text").alias("t"))
    given = F.array(*(F.lit(x) for x in ("ana", "juan", "maria")))
    # written, or the filter would redact and audit every text once more
    return written(docs.select("doc_id", T.bound(F.col("t"), lambda t: privacy.name_audit(t, given)).alias("kinds")), "names").filter("size(kinds) > 0")


# ---- answers of the classifier -------------------------------------------------------------
PARENT = {"articulos": "F1", "enlaces": "F1", "lugar": "F2", "origen": "F2", "duda": "fuera_del_marco"}
_PARENT_SQL = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in PARENT.items()) + "}"
SQL_ANSWERS = f"{SQL_SCORES}, ans AS (SELECT doc_id, map_from_entries(list((tema, p) ORDER BY ord)) AS nouls, max(p) FILTER (tema = 'articulos') AS f1, max(p) FILTER (tema = 'lugar') AS f2, avg(p) AS conf FROM scores GROUP BY doc_id), pr AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'ninguna' WHEN f2 > f1 THEN 'F2' ELSE 'F1' END AS principal, (doc_id % 10) / 10.0 AS sc FROM ans)"


def _answers(spark, d):
    each = scores(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "tema", "p"))).alias("s"), F.avg("p").alias("conf"))
    nouls = F.map_from_entries(F.transform("s", lambda x: F.struct(x["tema"], x["p"])))
    rows = each.select("doc_id", nouls.alias("nouls"), "conf").withColumns({"f1": F.col("nouls")["articulos"], "f2": F.col("nouls")["lugar"]})
    return rows.withColumns({"principal": F.when(F.col("doc_id") % 5 == 0, "ninguna").when(F.col("f2") > F.col("f1"), "F2").otherwise("F1"), "sc": (F.col("doc_id") % 10) / 10.0})


_SETS_SQL = f"pq AS (SELECT *, list_filter(map_keys(nouls), lambda t: nouls[t] >= 0.7) AS temas, list_filter(['F1', 'F2'], lambda f: CASE f WHEN 'F1' THEN f1 ELSE f2 END >= 0.7) AS frentes FROM pr), pf AS (SELECT *, list_filter(list_distinct(list_transform(temas, lambda t: {_PARENT_SQL}[t])), lambda x: x <> 'fuera_del_marco') AS padres, principal <> 'ninguna' AND CASE principal WHEN 'F1' THEN f1 ELSE f2 END < 0.7 AS pi FROM pq), pg AS (SELECT *, len(list_filter(padres, lambda x: NOT list_contains(frentes, x))) = 0 AND NOT pi AS coherente, len(temas) = 0 AND len(frentes) = 0 AND sc < 0.7 AS residual FROM pf)"


@query(f"WITH {SQL_ANSWERS}, {_SETS_SQL} SELECT doc_id, principal, array_to_string(list_sort(temas), ',') AS temas, residual::INT AS residual, (NOT coherente)::INT AS incoherente, pi::INT AS principal_incoherente, concat_ws('; ', CASE WHEN residual THEN 'residual' END, CASE WHEN NOT coherente THEN 'incoherente' END, CASE WHEN pi THEN 'principal_incoherente' END, CASE WHEN list_contains(temas, 'duda') THEN 'tema_critico' END, CASE WHEN round(conf, 9) < 0.5 THEN 'baja_confianza_principal' END, CASE WHEN sc < 0.5 THEN 'baja_confianza_tipo' END) AS motivo FROM pg")
def m12_p15_q07_q09_answer(spark, d):
    out = flow.judge_answers(_answers(spark, d).withColumns({"conf_principal": F.round("conf", 9), "conf_tipo": F.col("sc"), "sin_contenido": F.col("sc")}), "nouls", {"F1": "f1", "F2": "f2"}, PARENT, ["duda"])
    return out.select("doc_id", "principal", F.array_join(F.array_sort("temas"), ",").alias("temas"), "residual", "incoherente", "principal_incoherente", "motivo")


@query(f"WITH {SQL_ANSWERS}, bad AS (SELECT doc_id, CASE WHEN doc_id % 31 = 0 THEN map_from_entries(list_filter(map_entries(nouls), lambda e: e.key <> 'duda')) ELSE nouls END AS nouls, CASE WHEN doc_id % 37 = 0 THEN 'otra' ELSE principal END AS eleccion, CASE WHEN doc_id % 41 = 0 THEN 0.97 ELSE 1.0 END AS suma, CASE WHEN doc_id % 43 = 0 THEN 1.5 ELSE conf END AS conf FROM pr) SELECT doc_id, concat_ws('; ', CASE WHEN len(map_keys(nouls)) < 5 THEN 'claves' END, CASE WHEN eleccion NOT IN ('F1', 'F2', 'ninguna') THEN 'opcion' END, CASE WHEN abs(suma - 1) > 0.015 + 1e-9 THEN 'suma' END, CASE WHEN conf NOT BETWEEN 0 AND 1 THEN 'confianza' END) AS fallas FROM bad")
def c05_f27_answer_checks(spark, d):
    rows = _answers(spark, d)
    rows = rows.withColumns({
        "nouls": F.when(F.col("doc_id") % 31 == 0, F.map_filter("nouls", lambda k, v: k != "duda")).otherwise(F.col("nouls")),
        "eleccion": F.when(F.col("doc_id") % 37 == 0, "otra").otherwise(F.col("principal")),
        "prob": F.create_map(F.lit("F1"), F.lit(0.5), F.lit("F2"), F.lit(0.25), F.lit("ninguna"), F.when(F.col("doc_id") % 41 == 0, 0.22).otherwise(0.25)),
        "conf": F.when(F.col("doc_id") % 43 == 0, 1.5).otherwise(F.col("conf")),
    })
    return rows.select("doc_id", F.array_join(flow.answer_faults("nouls", "eleccion", "prob", "conf", NAMES, ["F1", "F2", "ninguna"]), "; ").alias("fallas"))


def _by_words(fails=lambda text: False):
    """The lexical scorer as a plug-in: text by text, in plain Python."""
    import re

    def scorer(texts):
        for t in texts:
            if fails(t):
                raise ValueError("no answer")
            words = re.findall(r"[^\W\d_]+", t.lower())
            yield {name: min(1.0, sum(w in kw for w in words) / 3.0) for name, kw in THEMES}

    return scorer


_BY_KEY = f"WITH {SQL_SCORES} SELECT sha256('m1' || chr(31) || text || chr(31) || 'q') AS clave, tema, max(round(p, 6)) AS p FROM scores GROUP BY ALL"


@query(_BY_KEY)
def c02_c03_plug_in(spark, d):
    """Each different text is asked once, by its key; the answers are those of the scorer."""
    unique = comments(spark, d).select(themes.cache_key("m1", F.col("text"), "q").alias("clave"), "text").dropDuplicates(["clave"])
    return themes.plug_in_scores(unique, _by_words(), "clave", "text").select("clave", "tema", r6("p").alias("p"))


@query(_BY_KEY)
def c04_k02_retry(spark, d):
    """A first pass that fails on some texts, a second one for these, and the gate."""
    unique = comments(spark, d).select(themes.cache_key("m1", F.col("text"), "q").alias("clave"), "text").dropDuplicates(["clave"])
    done = flow.with_retry(unique, _by_words(lambda t: len(t) % 7 == 3), _by_words(), "clave", "text")
    return scoring.complete_or_stop(unique, done, "clave", NAMES).select("clave", "tema", r6("p").alias("p"))


@query(f"SELECT count(*) AS textos, sum(length(text))::BIGINT AS tokens, round(sum(length(text)) * 0.042 / 1e6, 9) AS costo, round((SELECT avg(length(text)) FROM documents WHERE doc_id < 10) * count(*) * 0.042 / 1e6, 9) AS proyectado FROM (SELECT DISTINCT text FROM documents WHERE ({SQL_NOISE}) IS NULL)")
def a05_c06_cost(spark, d):
    unique = comments(spark, d).groupBy(F.sha2("text", 256).alias("k")).agg(F.any_value(F.length("text")).alias("input_tokens"))
    pilot = table(spark, d, "documents").filter("doc_id < 10").agg(F.avg(F.length("text")).alias("m"))
    return flow.cost(unique, "input_tokens", 0.042).join(pilot).select("textos", "tokens", F.round("costo", 9).alias("costo"), F.round(F.col("m") * F.col("textos") * 0.042 / 1e6, 9).alias("proyectado"))


# ---- readers, hard topics and the classifier -------------------------------------------------
SQL_HARD = f"{SQL_ALL}, hard AS (SELECT doc_id, lang, {NAMES}[doc_id % 5 + 1] AS duro FROM items), sets AS (SELECT doc_id, list(tema) AS t FROM facts GROUP BY doc_id)"
SQL_READ = f"{SQL_ALL}, lectura AS (SELECT doc_id, tema FROM scores WHERE p >= 1.0 OR (p > 0 AND doc_id % 7 = 0))"
_TAG = "CASE WHEN j >= 2*l AND j-l >= 8 THEN 'INFLADO' WHEN l-j >= 4 AND j <= 0.5*l THEN 'SUBDETECTADO' WHEN j-l >= 8 THEN 'ALTO' ELSE '' END"


def _hard(spark, d):
    names = F.array(*map(F.lit, NAMES))
    return comments(spark, d).select("doc_id", "lang", F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")).alias("duro"))


def _reading(spark, d):
    return scores(spark, d).filter("p >= 1.0 or (p > 0 and doc_id % 7 = 0)").select("doc_id", "tema")


@query(f"WITH {SQL_HARD} SELECT lang, count(*) AS n, round(avg(coalesce(list_contains(t, duro), false)::INT), 6) AS acuerdo, count(*) FILTER (t IS NULL) AS sin_tema FROM hard LEFT JOIN sets USING (doc_id) GROUP BY lang")
def m21_agreement(spark, d):
    return flow.agreement(_hard(spark, d), facts(spark, d), "doc_id", "duro", "lang").withColumn("acuerdo", r6("acuerdo"))


_BOTH = "x AS (SELECT coalesce(h.doc_id, f.doc_id) AS doc_id, coalesce(h.lang, f.lang) AS lang, coalesce(h.duro, f.tema) AS tema, h.doc_id IS NOT NULL AS b, f.doc_id IS NOT NULL AS a FROM hard h FULL JOIN facts f ON f.doc_id = h.doc_id AND f.tema = h.duro)"


@query(f"WITH {SQL_HARD}, {_BOTH}, c AS (SELECT tema, count(*) FILTER (b) AS l, count(*) FILTER (a) AS j, count(*) FILTER (a AND b) AS en_ambos FROM x GROUP BY tema) SELECT tema, l AS n_bert, j AS n_jev, en_ambos, {_TAG} AS marca FROM c")
def r06_combined(spark, d):
    return flow.compare_counts(_hard(spark, d).select("doc_id", F.col("duro").alias("tema")), facts(spark, d).select("doc_id", "tema"), "doc_id", "tema").toDF("tema", "n_bert", "n_jev", "en_ambos", "marca")


@query(f"WITH {SQL_HARD}, {_BOTH}, c AS (SELECT lang, tema, count(*) FILTER (b) AS l, count(*) FILTER (a) AS j, count(*) FILTER (a AND b) AS en_ambos FROM x GROUP BY ALL) SELECT lang, tema, l AS n_bert, j AS n_jev, en_ambos, {_TAG} AS marca FROM c")
def r07_by_role(spark, d):
    return flow.compare_counts(_hard(spark, d).select("doc_id", "lang", F.col("duro").alias("tema")), facts(spark, d).select("doc_id", "lang", "tema"), "doc_id", "lang", "tema").toDF("lang", "tema", "n_bert", "n_jev", "en_ambos", "marca")


@query(f"WITH {SQL_READ}, c AS (SELECT tema, count(l.doc_id) AS l, (SELECT count(*) FROM facts f WHERE f.tema = lista.tema) AS j FROM lista LEFT JOIN lectura l USING (tema) GROUP BY tema), m AS (SELECT round(2.0 * (SELECT count(*) FROM lectura JOIN facts USING (doc_id, tema)) / ((SELECT count(*) FROM lectura) + (SELECT count(*) FROM facts)), 6) AS micro_f1) SELECT tema, j, l, {_TAG} AS marca, micro_f1 FROM c, m")
def r09_m20_reading(spark, d):
    return flow.reading_report(_reading(spark, d), facts(spark, d), theme_list(spark), "doc_id").withColumn("micro_f1", r6("micro_f1"))


@query(f"WITH {SQL_READ} SELECT doc_id, tema, CASE WHEN f.doc_id IS NULL THEN 'SOLO LECTURA' ELSE 'SOLO JEV' END AS quien FROM lectura l FULL JOIN facts f USING (doc_id, tema) WHERE l.doc_id IS NULL OR f.doc_id IS NULL")
def m22_disagreements(spark, d):
    return flow.disagreements(_reading(spark, d), facts(spark, d), "doc_id")


@query(f"WITH {SQL_CELLS}, w AS (SELECT tema, 100.0 * count(*) / (SELECT count(*) FROM i) AS weight FROM facts GROUP BY tema), z AS (SELECT lang, source, tema FROM cells JOIN w USING (tema) WHERE N_ >= 5 AND n = 0 AND weight >= 15 AND NOT (lang = 'de' AND source = 'src1')) SELECT z.lang, z.source, z.tema, s.doc_id, round(s.p, 6) AS p, row_number() OVER (PARTITION BY z.lang, z.source, z.tema ORDER BY s.p DESC, s.doc_id) AS orden FROM z JOIN i ON i.lang = z.lang AND i.source = z.source JOIN scores s ON s.doc_id = i.doc_id AND s.tema = z.tema")
def r13_zero_review(spark, d):
    s = scored(spark, d)
    n = items_of(s).agg(F.count("*").alias("all"))
    weight = s.filter(F.col("p") >= TAU).groupBy("tema").agg(F.count("*").alias("k")).join(n).select("tema", (100.0 * F.col("k") / F.col("all")).alias("weight"))
    zero = survey.zero_cells(_cells(spark, d, s), weight, "tema")
    seen = spark.createDataFrame([("de", "src1", t) for t in NAMES], "lang string, source string, tema string")
    return flow.zero_review(zero, seen, items_of(s), s.select("doc_id", "tema", "p"), "doc_id", ["lang", "source"]).withColumn("p", r6("p"))


# ---- reports --------------------------------------------------------------------------------
@query(f"WITH {SQL_ALL}, v AS (SELECT tema, doc_id, row_number() OVER (PARTITION BY tema ORDER BY doc_id % 3 = 0, p DESC, md5('2026' || doc_id)) AS r FROM facts) SELECT l.tema, count(f.doc_id) AS n, round(count(f.doc_id) / (SELECT count(*) FROM items), 6) AS share, round(avg((f.doc_id % 4 = 0)::INT), 6) AS mejora, (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY r) FROM v WHERE v.tema = l.tema AND r <= 3) AS voces FROM lista l LEFT JOIN facts f USING (tema) GROUP BY l.tema")
def r03_w08_census(spark, d):
    n = comments(spark, d).agg(F.count("*").alias("all"))
    return flow.census_themes(theme_list(spark), facts(spark, d).withColumns({"revisar": F.col("doc_id") % 3 == 0, "mejora": F.col("doc_id") % 4 == 0}), n, "doc_id", seed="2026").select("tema", "n", r6("share").alias("share"), r6("mejora").alias("mejora"), "voces")


SQL_TOPIC = "t AS (SELECT doc_id, source, lang FROM documents), c AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang) - 1 AS tema FROM t GROUP BY lang)"


@query(f"WITH {SQL_TERMS}, {SQL_TOPIC}, w AS (SELECT lang, string_agg(term, ', ' ORDER BY rank) FILTER (rank <= 8) AS palabras FROM top GROUP BY lang), tt AS (SELECT sum(n)::DOUBLE AS total FROM c) SELECT tema, lang, n, round(n / total, 6) AS share, {SQL_LO.replace('k/', 'n/')} AS lo, palabras FROM c JOIN w USING (lang), tt, {SQL_Z}")
def r04_v13_topics(spark, d):
    out = flow.topic_table(table(spark, d, "documents").select("doc_id", "lang"), _top_words(spark, d), "lang")
    lo, _ = stats.wilson(F.col("n"), F.col("total"))
    return out.select("tema", "lang", "n", r6(F.col("n") / F.col("total")).alias("share"), r6(lo).alias("lo"), "palabras")


@query(f"WITH {SQL_TOPIC} SELECT tema, lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM t JOIN c USING (lang) GROUP BY tema, lang, source")
def r05_a15_by_unit(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    renumbered = flow.by_size(docs, "lang").select("lang", "tema")
    n = docs.groupBy("lang", "source").agg(F.count("*").alias("n")).join(renumbered, "lang")
    return n.select("tema", "lang", "source", "n", r6(F.col("n") / F.sum("n").over(Window.partitionBy("source"))).alias("share"))


@query(f"WITH {SQL_CELLS} SELECT lang, source, max(N_) AS filas, " + ", ".join(f"round(max(n) FILTER (tema = '{t}') / nullif(max(N_), 0), 6) AS {t}" for t in NAMES) + ", round((max(N_) - (SELECT count(DISTINCT f.doc_id) FROM facts f JOIN i ON i.doc_id = f.doc_id WHERE i.lang = cells.lang AND i.source = cells.source)) / nullif(max(N_), 0), 6) AS sin_tema FROM cells GROUP BY lang, source")
def r08_role_matrix(spark, d):
    s = scored(spark, d)
    return flow.role_matrix(_cells(spark, d, s), items_of(s), s.filter(F.col("p") >= TAU), "doc_id", ["lang", "source"], NAMES)


@query(f"""WITH {SQL_ALL}, n AS (SELECT count(*)::DOUBLE AS total FROM items), g AS (SELECT tema, count(*)::DOUBLE AS k FROM facts GROUP BY tema)
SELECT 'tema' AS tabla, tema AS clave, coalesce(k, 0) AS n, round(coalesce(k, 0)/total, 6) AS valor FROM lista LEFT JOIN g USING (tema), n
UNION ALL SELECT 'cobertura', 'algun_tema', (SELECT count(DISTINCT doc_id) FROM facts), round((SELECT count(DISTINCT doc_id) FROM facts) / total, 6) FROM n
UNION ALL SELECT 'cobertura', 'solo_fuera', k, round(k / total, 6) FROM (SELECT count(*) AS k FROM (SELECT doc_id FROM facts GROUP BY doc_id HAVING bool_and(tema = 'duda'))), n
UNION ALL SELECT 'padre', padre, count(DISTINCT doc_id), round(count(DISTINCT doc_id) / max(total), 6) FROM (SELECT doc_id, {_PARENT_SQL}[tema] AS padre FROM facts), n GROUP BY padre""")
def r10_a16_a17_discovery(spark, d):
    out = flow.discovery(theme_list(spark), facts(spark, d), comments(spark, d).select("doc_id"), "doc_id", PARENT, themes.OUTSIDE)
    return out.select("tabla", "clave", F.col("n").cast("double").alias("n"), r6("valor").alias("valor"))


@query(f"SELECT count(*) AS filas, count(text) AS con_texto, count(*) - count(DISTINCT (lang, source, text)) AS filas_identicas, count(text) - count(DISTINCT text) AS textos_repetidos, count(*) FILTER (length(trim(text)) < 30) AS cortos, round(quantile_cont(n_chars, 0.5), 6) AS mediana, (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT unnest(['doc_id', 'lang', 'n_chars', 'source', 'text', 'vacia']) AS c) WHERE c <> 'vacia') AS columnas, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT unnest(['lang', 'n_chars', 'otra']) AS x) WHERE x NOT IN ('doc_id', 'text', 'lang', 'source', 'n_chars')) AS faltan FROM documents")
def r11_a08_p04_profile(spark, d):
    docs = table(spark, d, "documents").withColumn("vacia", F.lit(None).cast("string"))
    full = survey.without_empty_columns(docs)
    prof = survey.profile(full, "text", ["lang", "source", "text"])
    return prof.withColumns({"columnas": F.lit(",".join(sorted(full.columns))), "faltan": F.lit(",".join(sorted({"lang", "n_chars", "otra"} - set(full.columns))))})


@query(f"WITH {SQL_ANSWERS}, {_SETS_SQL}, u AS (SELECT DISTINCT text FROM documents WHERE ({SQL_NOISE}) IS NULL) SELECT count(*) AS filas, sum(residual::INT)::BIGINT AS residual, sum((NOT coherente)::INT)::BIGINT AS incoherentes, (SELECT sum(length(text))::BIGINT FROM u) AS tokens, (SELECT round(sum(length(text)) * 0.042 / 1e6, 9) FROM u) AS costo, round(greatest(0, (sum(residual::INT)/count(*)::DOUBLE + 1.959964*1.959964/(2*count(*)))/(1+1.959964*1.959964/count(*)) - 1.959964*sqrt(sum(residual::INT)/count(*)::DOUBLE*(1-sum(residual::INT)/count(*)::DOUBLE)/count(*) + 1.959964*1.959964/(4.0*count(*)*count(*)))/(1+1.959964*1.959964/count(*))), 6) AS lo FROM pg")
def r12_run_summary(spark, d):
    judged = flow.judge_answers(_answers(spark, d).withColumns({"conf_principal": F.round("conf", 9), "conf_tipo": F.col("sc"), "sin_contenido": F.col("sc")}), "nouls", {"F1": "f1", "F2": "f2"}, PARENT, ["duda"])
    n = judged.agg(F.count("*").alias("filas"), F.sum("residual").cast("long").alias("residual"), F.sum("incoherente").cast("long").alias("incoherentes"))
    unique = comments(spark, d).groupBy(F.sha2("text", 256).alias("k")).agg(F.any_value(F.length("text")).alias("input_tokens"))
    lo, _ = stats.wilson(F.col("residual"), F.col("filas"))
    return n.join(flow.cost(unique, "input_tokens", 0.042)).select("filas", "residual", "incoherentes", "tokens", F.round("costo", 9).alias("costo"), r6(lo).alias("lo"))


@query(f"WITH {SQL_FACTS} SELECT tema, lang, count(*) AS n, round(avg(p), 6) AS p FROM facts GROUP BY GROUPING SETS ((tema, lang), (tema))")
def a13_by_unit(spark, d):
    return facts(spark, d).groupingSets([["tema", "lang"], ["tema"]], "tema", "lang").agg(F.count("*").alias("n"), r6(F.avg("p")).alias("p"))


@query(f"SELECT coalesce({SQL_NOISE}, '') AS motivo, count(*) AS n, count(DISTINCT text) AS textos FROM documents GROUP BY 1")
def p07_reasons(spark, d):
    return table(spark, d, "documents").groupBy(F.coalesce(T.noise_reason("text"), F.lit("")).alias("motivo")).agg(F.count("*").alias("n"), F.count_distinct(F.sha2("text", 256)).alias("textos"))


# ---- topic models ---------------------------------------------------------------------------
@query("WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x*x))) AS nv FROM embeddings), s AS (SELECT a.vec_id, a.label, b.label AS lb, sum(1 - list_dot_product(a.v, b.v) / (a.nv * b.nv)) AS dist, count(*) AS n FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL), i AS (SELECT vec_id, max(dist / n) FILTER (label = lb) AS inner_, min(dist / n) FILTER (label <> lb) AS outer_ FROM s GROUP BY vec_id) SELECT round(avg(CASE WHEN inner_ IS NULL THEN 0 ELSE (outer_ - inner_) / greatest(inner_, outer_) END), 6) AS silhouette FROM i")
def v11_silhouette(spark, d):
    return topics.silhouette(table(spark, d, "embeddings"), "label", "embedding").select(r6("silhouette").alias("silhouette"))


@query("WITH g AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, lang, n, n >= 20 AS modelado, CASE WHEN n < 20 THEN lang || '__todas' ELSE source || '__' || lang END AS temas_de FROM g")
def v17_j12_fallback(spark, d):
    groups = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    groups = groups.select("source", "lang", "n", F.concat_ws("__", "source", "lang").alias("id"), F.concat("lang", F.lit("__todas")).alias("parent"), (F.col("n") >= 20).alias("modelado"))
    return flow.base_models(groups).select("source", "lang", "n", "modelado", F.col("base").alias("temas_de"))


@query("WITH l AS (SELECT unnest(range(12)) AS label), c AS (SELECT l.label, count(e.vec_id) AS n FROM l LEFT JOIN embeddings e USING (label) GROUP BY ALL) SELECT min(n) AS menor, CASE WHEN min(n) * 1.0 / max(n) >= 0.75 THEN 'estable' WHEN min(n) * 1.0 / max(n) >= 0.60 THEN 'moderada' ELSE 'débil' END AS nivel FROM c")
def a22_v08_least_cluster(spark, d):
    n = topics.cluster_sizes(table(spark, d, "embeddings"), "label", 12)
    return n.agg(F.min("n").alias("menor"), topics.stability_level(F.min("n") / F.max("n")).alias("nivel"))


@query("WITH m AS (SELECT label, i, avg(v::DOUBLE) v FROM (SELECT label, unnest(embedding) v, unnest(range(len(embedding))) i FROM embeddings) GROUP BY ALL), nn AS (SELECT label, sqrt(sum(v*v)) nn FROM m GROUP BY label), s AS (SELECT a.label AS a, b.label AS b, round(sum(a.v/na.nn*b.v/nb.nn), 9) AS sim FROM m a JOIN m b ON a.i = b.i AND a.label % 3 <> b.label % 3 JOIN nn na ON na.label = a.label JOIN nn nb ON nb.label = b.label GROUP BY ALL) SELECT a, b, round(sim, 6) AS sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM s QUALIFY rank <= 2")
def j10_nearest_topics(spark, d):
    cents = topics.centroids(table(spark, d, "embeddings"), "label", "embedding").withColumn("grupo", F.col("label") % 3)
    return topics.nearest_elsewhere(cents, "label", "grupo").select("a", "b", r6("sim").alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {SQL_TERMS}, k AS (SELECT CASE WHEN count(DISTINCT doc_id) >= 100 THEN 2 ELSE 1 END AS least FROM terms), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM terms GROUP BY term) SELECT count(*) AS vocabulario, min(term) AS primera, max(df) AS mayor FROM df, k WHERE df >= least")
def v02_vocabulary(spark, d):
    v = topics.vocabulary_of_rows(_words(spark, d), "w")
    return v.agg(F.count("*").alias("vocabulario"), F.min("term").alias("primera"), F.max("df").alias("mayor"))


@query("SELECT sha256('m' || chr(31) || text) AS clave, min(doc_id) AS primero FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels) AND text NOT IN (SELECT text FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels)) GROUP BY text")
def v01_k02_missing_texts(spark, d):
    """Texts that a store of vectors lacks: those of no labelled document, each once."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", flow.text_key("m", "text").alias("clave"))
    store = docs.join(table(spark, d, "labels"), "doc_id", "left_semi")
    return themes.missing(docs, store, "clave").groupBy("clave").agg(F.min("doc_id").alias("primero"))


# ---- single operators -----------------------------------------------------------------------
@query("WITH w AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(regexp_replace(text, '\\[[A-Z_]+\\]', ' ', 'g')), '[^\\pL\\pN_]', ' ', 'g'), '[^ ]+') AS w FROM documents), t AS (SELECT doc_id, list_filter(w, lambda x: regexp_full_match(x, '\\pL{3,}') AND NOT list_contains([" + ", ".join(f"'{x}'" for x in T.STOP_WORDS) + f"], {sql_normal('x')})) AS t FROM w) SELECT doc_id, len(t)::INT AS n_tokens, greatest(len(t) - 1, 0)::INT AS n_bigrams, CASE WHEN len(t) > 1 THEN t[1] || ' ' || t[2] END AS primero FROM t")
def f12_w05_tokens(spark, d):
    toks = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return toks.select("doc_id", F.size("t").alias("n_tokens"), F.size(T.bigrams(F.col("t"))).alias("n_bigrams"), F.get(T.bigrams(F.col("t")), 0).alias("primero"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, sha256('{\"event_type\":\"' || event_type || '\",\"k\":' || coalesce((props::JSON->'$.k')::VARCHAR, 'null') || ',\"user_id\":' || user_id || '}') AS clave FROM events")
def f28_f29_s06_json(spark, d):
    """Keys are sorted and the request is hashed as canonical JSON; lines are parsed by schema."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    parts = {"event_type": F.concat(F.lit('"'), "event_type", F.lit('"')), "k": F.coalesce(F.when(F.col("k").rlike(r"^-?\d+(\.\d+)?$"), F.col("k")).otherwise(F.concat(F.lit('"'), "k", F.lit('"'))), F.lit("null")), "user_id": F.col("user_id").cast("string")}
    body = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), parts[n]) for n in sorted(parts))), F.lit("}"))
    return e.select("event_id", "k", F.sha2(body, 256).alias("clave"))


@query("SELECT event_id, 'jev-1.' || (event_id % 12) || '.' || (event_id % 7) AS version, (event_id % 12 > 9 OR (event_id % 12 = 9 AND event_id % 7 > 2)) AS nueva FROM events")
def f30_versions(spark, d):
    v = table(spark, d, "events").select("event_id", F.concat(F.lit("jev-1."), (F.col("event_id") % 12).cast("string"), F.lit("."), (F.col("event_id") % 7).cast("string")).alias("version"))
    return v.select("event_id", "version", (T.version_key("version") > F.array(F.lit(1), F.lit(9), F.lit(2))).alias("nueva"))


@query("WITH c AS (SELECT (doc_id % 1500 + 1)::BIGINT AS n FROM documents) SELECT n, CASE WHEN ceil(z*z*0.25/0.0025 / (1 + (z*z*0.25/0.0025 - 1)/n)) / n > 0.5 THEN 'B_censo' WHEN n < 1200 THEN 'intermedio_muestreo_reducido' ELSE 'A_completo' END AS protocolo FROM (SELECT DISTINCT n FROM c), (SELECT 1.959964 AS z)")
def m04_protocol(spark, d):
    n = table(spark, d, "documents").select((F.col("doc_id") % 1500 + 1).alias("n")).distinct()
    return n.select("n", stats.protocol(F.col("n")).alias("protocolo"))


@query("WITH r AS (SELECT unnest(range(1, 2001)) AS draw), u AS (SELECT draw, quality AS x, (('0x' || substr(md5('42|' || doc_id || '|' || draw), 1, 8))::BIGINT + 0.5) / 4294967296 AS u FROM labels CROSS JOIN r WHERE quality IS NOT NULL), w AS (SELECT draw, x, (u > 0.36787944117144233)::INT + (u > 0.7357588823428847)::INT + (u > 0.9196986029286058)::INT + (u > 0.9810118431238462)::INT + (u > 0.9963401531726563)::INT + (u > 0.9994058151824183)::INT + (u > 0.9999167588507119)::INT AS w FROM u), m AS (SELECT draw, sum(x*w)/sum(w)::DOUBLE AS m FROM w GROUP BY draw) SELECT round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m")
def m18_bootstrap(spark, d):
    return stats.bootstrap_mean(table(spark, d, "labels"), "quality", key="doc_id").select(r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("SELECT b.item_id, count(*) AS n FROM benchmark b JOIN documents d ON length(b.text) >= 8 AND contains(d.text, b.text) GROUP BY b.item_id")
def p09_j11_containment(spark, d):
    b = table(spark, d, "benchmark").filter(F.length("text") >= 8).select("item_id", "text")
    return survey.containment(table(spark, d, "documents").select("doc_id", "text"), b, "doc_id", "item_id", "text").groupBy("item_id").agg(F.count("*").alias("n"))


@query(f"SELECT tema, componente, list_contains({COMPONENTS + [themes.GENERAL, themes.OUTSIDE]}, componente) OR (length(componente) >= 8 AND contains('{SECTION}', componente)) AS valido FROM (SELECT * FROM {{}}) x".format("(VALUES " + ", ".join(f"('{t}', '{c}')" for t, _, c, _, _ in LIST + [("x", "", "unan y", [], False), ("y", "", "nunca dicho", [], False), ("z", "", "origen y materia", [], False)]) + ") v(tema, componente)"))
def p09_components(spark, d):
    rows = [(t, c) for t, _, c, _, _ in LIST + [("x", "", "unan y", [], False), ("y", "", "nunca dicho", [], False), ("z", "", "origen y materia", [], False)]]
    return spark.createDataFrame(rows, "tema string, componente string").withColumn("valido", themes.valid_component(F.col("componente"), COMPONENTS, SECTION))


@query(f"WITH {SQL_SCORES}, g AS (SELECT doc_id, max(p) AS p FROM scores GROUP BY doc_id), c AS (SELECT d.doc_id, d.text FROM documents d JOIN g USING (doc_id) WHERE len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) <= 3 OR g.p >= 1.0) SELECT min(doc_id) AS doc_id, count(*) AS veces FROM c WHERE doc_id % 11 <> 0 GROUP BY text")
def p10_p11_contentless(spark, d):
    """Candidates without content, each text once, without those that a reviewer has cleared."""
    p = scores(spark, d).groupBy("doc_id").agg(F.max("p").alias("p"))
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != ""))
    rows = comments(spark, d).join(p, "doc_id").filter((words <= 3) | (F.col("p") >= 1.0))
    cleared = table(spark, d, "documents").filter("doc_id % 11 = 0").select("doc_id")
    return rows.join(cleared, "doc_id", "left_anti").groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("veces")).drop("k")


@query("SELECT doc_id, lang, n_chars FROM documents")
def p05_s02_allowed_columns(spark, d):
    return survey.allowed_columns(table(spark, d, "documents"), ["doc_id", "lang", "n_chars", "source"], forbidden={"source", "nombre"})


@query("SELECT n_nationkey, 'ORDERS' AS archivo, CASE n_nationkey % 3 WHEN 0 THEN 'Vida' WHEN 1 THEN 'Digital' END AS formulario FROM nation")
def s04_form_names(spark, d):
    path = F.concat(F.lit("/x/Encuesta ("), F.element_at(F.array(F.lit("uc  vida"), F.lit("UC Digital"), F.lit("otra")), (F.col("n_nationkey") % 3 + 1).cast("int")), F.lit(").parquet"))
    form = sources.form_of_file(path, {"UC VIDA": "Vida", "UC DIGITAL": "Digital"})
    orders = table(spark, d, "orders").select(F.col("_metadata.file_path").alias("f")).limit(1).select(F.upper(F.regexp_extract("f", r"(orders)[^/]*(?:/[^/]*)?$", 1)).alias("archivo"))
    return table(spark, d, "nation").withColumn("formulario", form).join(orders).select("n_nationkey", "archivo", "formulario")


@query("SELECT count(*) AS n, count(l.doc_id) AS con_etiqueta, sum(quality)::BIGINT AS calidad FROM documents d JOIN labels l USING (doc_id)")
def j03_j05_strict_lookup(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "quality")
    return survey.strict_lookup(labels.join(docs, "doc_id", "left_semi"), docs.select("doc_id"), "doc_id").agg(F.count("*").alias("n"), F.count("doc_id").alias("con_etiqueta"), F.sum("quality").cast("long").alias("calidad"))


@query("WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\pL+')) AS w FROM documents) SELECT DISTINCT " + sql_normal("w") + " AS token FROM w WHERE length(w) >= 4")
def a25_t02_name_tokens(spark, d):
    return survey.name_tokens(table(spark, d, "documents"), "text", 4)


@query("SELECT source, min(lang) AS lang FROM documents GROUP BY source HAVING count(DISTINCT lang) = 1 UNION ALL SELECT source, '(varios)' FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def a23_constant_of_group(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.min("lang").alias("lo"), F.max("lang").alias("hi"), F.first("lang").alias("x"))
    return g.select("source", F.when(F.col("lo") == F.col("hi"), F.col("x")).otherwise("(varios)").alias("lang"))


@query("SELECT orden, nivel, clave FROM (SELECT row_number() OVER (ORDER BY CASE WHEN source IS NULL THEN 0 ELSE 1 END, lang DESC, source) AS orden, CASE WHEN source IS NULL THEN 'todas' ELSE 'unidad' END AS nivel, coalesce(source, '') || '|' || lang AS clave FROM (SELECT source, lang FROM documents GROUP BY GROUPING SETS ((source, lang), (lang)))) WHERE orden <= 30")
def o02_o05_o06_group_order(spark, d):
    g = table(spark, d, "documents").groupingSets([["source", "lang"], ["lang"]], "source", "lang").agg(F.count("*").alias("n"))
    top = g.orderBy(F.when(F.col("source").isNull(), 0).otherwise(1), F.desc("lang"), "source").limit(30)
    order = F.row_number().over(Window.orderBy(F.when(F.col("source").isNull(), 0).otherwise(1), F.desc("lang"), "source")).cast("long")  # thirty rows
    return top.select(order.alias("orden"), F.when(F.col("source").isNull(), "todas").otherwise("unidad").alias("nivel"), F.concat_ws("|", F.coalesce("source", F.lit("")), "lang").alias("clave"))


@query("SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 10")
def o04_sample(spark, d):
    return survey.sample_rows(table(spark, d, "documents").select("doc_id"), "doc_id", "7", 10)


@query(f"WITH {SQL_LIST} SELECT tema, row_number() OVER (ORDER BY {_CLASS}, coalesce(list_position({COMPONENTS}, componente), 0), ord DESC) AS orden FROM lista")
def o01_theme_order(spark, d):
    return theme_list(spark).select("tema", F.row_number().over(Window.orderBy(*flow.theme_order(COMPONENTS), F.desc("ord"))).cast("long").alias("orden"))  # a theme list


@query("SELECT doc_id, lang, NULL::INT AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels")
def t01_union_by_name(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").unionByName(table(spark, d, "labels").select("doc_id", "quality"), allowMissingColumns=True)


@query("SELECT a.lang, array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(y, v))), ',') AS solo_a, array_to_string(list_sort(list_intersect(x, y)), ',') AS comunes, len(list_filter(x, lambda v: NOT list_contains(y, v))) = 0 AS dentro, len(z) > len(list_distinct(z)) AS repetidos FROM (SELECT lang, list(DISTINCT source) FILTER (n_chars > 4000) AS x0, coalesce(x0, []) AS x, list(DISTINCT source) FILTER (n_chars < 200) AS y0, coalesce(y0, []) AS y, list(source) AS z FROM documents GROUP BY lang) a")
def t03_t05_t06_sets(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.collect_set(F.when(F.col("n_chars") > 4000, F.col("source"))).alias("x"), F.collect_set(F.when(F.col("n_chars") < 200, F.col("source"))).alias("y"), F.count("source").alias("n"), F.count_distinct("source").alias("k"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return g.select("lang", text(F.array_except("x", "y")).alias("solo_a"), text(F.array_intersect("x", "y")).alias("comunes"), (F.size(F.array_except("x", "y")) == 0).alias("dentro"), (F.col("n") > F.col("k")).alias("repetidos"))


@query("SELECT sha256('m' || chr(31) || lang || chr(31) || 'q') AS clave, arg_max(doc_id, doc_id) AS ultimo, arg_max(source, doc_id) AS fuente FROM documents WHERE doc_id % 2 = 0 GROUP BY lang")
def k02_j06_latest(spark, d):
    """A store that was only added to: the last row of each key counts."""
    rows = table(spark, d, "documents").filter("doc_id % 2 = 0").select(themes.cache_key("m", F.col("lang"), "q").alias("clave"), F.col("doc_id").alias("ultimo"), F.col("source").alias("fuente"))
    return themes.latest(rows, "clave", "ultimo").select("clave", "ultimo", "fuente")


@query("SELECT d.doc_id, CASE WHEN coalesce(trim(source), '') <> '' THEN '[NOMBRE]' ELSE source END AS nombre, CASE WHEN coalesce(trim(lang), '') <> '' THEN '[CORREO]' ELSE lang END AS correo, CASE WHEN text IS NOT NULL THEN 'c' || length(text) END AS comentario FROM documents d")
def k08_publishable(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("nombre"), F.col("lang").alias("correo"), F.col("text").alias("comentario"))
    clean = docs.select("doc_id", F.concat(F.lit("c"), F.length("comentario").cast("string")).alias("comentario"))
    return privacy.publishable(docs, "nombre", "correo", "comentario", clean, "doc_id").select("doc_id", "nombre", "correo", "comentario")


@query("SELECT lang, '{\"lang\":\"' || lang || '\",\"n\":' || count(*) || ',\"hi\":' || max(n_chars) || '}' AS resumen FROM documents GROUP BY lang")
def k03_k04_summaries(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("hi"))
    return g.select("lang", F.to_json(F.struct("lang", "n", "hi")).alias("resumen"))


@query("SELECT doc_id, lang, n_chars FROM documents")
def k01_s05_written_table(spark, d):
    """Written by hash of the key and read again, as the flows' interim tables are."""
    return sources.written(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "interim")
