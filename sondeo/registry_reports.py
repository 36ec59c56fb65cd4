"""Queries of the census, combined, discovery and topic reports, of redaction and of names."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import privacy, stats
from .functions import text as T
from .operators import clusters, density, flow, reports, survey, themes, topics
from .registry import NAMES, ORACLES, SQL_FACTS, SQL_NOISE, SQL_SCORES, SQL_TERMS, _class_terms, comments, facts, query, r6, scores, sql_normal, table, theme_frame
from .registry_flow import _PARENT_SQL, PARENT, SQL_ANSWERS, SQL_HARD, _answers, _hard
from .registry_models import _modelled, _vectors
from .sources import documents as sources
from .sources.tables import folder, written

TAU = themes.TAU
FRONTS = {"F1": "f1", "F2": "f2"}


# ---- the census (each table of the two workbooks) -------------------------------------------
def _judged(spark, d):
    rows = _answers(spark, d).withColumns({"conf_principal": F.round("conf", 9), "conf_tipo": F.col("sc"), "sin_contenido": F.col("sc")})
    return flow.judge_answers(rows, "nouls", FRONTS, PARENT, ["duda"])


SQL_JUDGED = f"juicio AS ({ORACLES['m12_p15_q07_q09_answer']})"
_PCT = "(CASE WHEN {0} * 100 - floor({0} * 100) = 0.5 THEN (floor({0} * 100) + floor({0} * 100)::BIGINT % 2)::BIGINT ELSE round({0} * 100)::BIGINT END)::VARCHAR || '%'"
_LO = "round(greatest(0, (n/t + 3.841458881296/(2*t))/(1+3.841458881296/t) - 1.959964*sqrt(n/t*(1-n/t)/t + 3.841458881296/(4*t*t))/(1+3.841458881296/t)), 6)"
_HI = "round(least(1, (n/t + 3.841458881296/(2*t))/(1+3.841458881296/t) + 1.959964*sqrt(n/t*(1-n/t)/t + 3.841458881296/(4*t*t))/(1+3.841458881296/t)), 6)"
SQL_CENSUS = f"{SQL_ANSWERS}, {SQL_JUDGED}, fx AS (SELECT * FROM scores WHERE p >= 0.7), fr AS (SELECT 'F1' AS frente, doc_id, f1 AS p FROM pr UNION ALL SELECT 'F2', doc_id, f2 FROM pr), rk AS (SELECT doc_id, tema, p, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, ord) AS orden, {_PARENT_SQL}[tema] AS frente FROM fx), best AS (SELECT doc_id, max(p) AS best FROM scores GROUP BY doc_id)"


@query(f"""WITH {SQL_CENSUS}, total AS (SELECT count(*)::DOUBLE AS t FROM pr), g AS (SELECT frente, count(*) FILTER (p >= 0.7)::DOUBLE AS n, avg(p) FILTER (p >= 0.7) AS c FROM fr GROUP BY frente), m AS (SELECT principal AS frente, count(*) AS k FROM pr GROUP BY ALL),
 th AS (SELECT frente, tema, count(*) AS k, row_number() OVER (PARTITION BY frente ORDER BY count(*) DESC, tema) AS r FROM rk GROUP BY frente, tema), tt AS (SELECT frente, string_agg(tema || ' (' || k || ')', ', ' ORDER BY r) AS temas FROM th WHERE r <= 5 GROUP BY frente)
SELECT v.frente, n::BIGINT AS n, round(n / t, 6) AS share, {_LO} AS lo, {_HI} AS hi, round(c, 6) AS confianza, coalesce(m.k, 0)::BIGINT AS principales, round(coalesce(m.k, 0) / t, 6) AS share_principal, coalesce(temas, '') AS temas FROM (VALUES ('F1'), ('F2'), ('ninguna')) v(frente) LEFT JOIN g USING (frente) LEFT JOIN m USING (frente) LEFT JOIN tt USING (frente), total""")
def r03_fronts(spark, d):
    out = reports.front_table(_judged(spark, d), facts(spark, d), "doc_id", FRONTS, PARENT, TAU)
    return out.select("frente", "n", "principales", "temas", *(r6(c).alias(c) for c in ("share", "lo", "hi", "confianza", "share_principal")))


SQL_COMMENTS = f"co AS (SELECT j.doc_id, coalesce(a.frente || ' · ' || a.tema, '{reports.WITHOUT}') AS tema_principal, round(coalesce(a.p, best), 6) AS p, coalesce((SELECT string_agg(o.frente || ' · ' || o.tema || ' (' || {_PCT.format('o.p')} || ')', '; ' ORDER BY o.orden) FROM rk o WHERE o.doc_id = j.doc_id AND o.orden > 1), '') AS otros, j.principal, concat_ws('; ', CASE WHEN f1 >= 0.7 AND j.principal <> 'F1' THEN 'F1 (' || {_PCT.format('f1')} || ')' END, CASE WHEN f2 >= 0.7 AND j.principal <> 'F2' THEN 'F2 (' || {_PCT.format('f2')} || ')' END) AS tambien, CASE WHEN motivo <> '' THEN 'Sí' ELSE 'No' END AS revisar, motivo FROM juicio j JOIN pr USING (doc_id) JOIN best USING (doc_id) LEFT JOIN rk a ON a.doc_id = j.doc_id AND a.orden = 1)"


def _comment_table(spark, d):
    return reports.comment_table(_judged(spark, d), reports.ranked_themes(scores(spark, d), "doc_id", TAU), "doc_id", FRONTS, PARENT, TAU)


@query(f"WITH {SQL_CENSUS}, {SQL_COMMENTS} SELECT * FROM co")
def r03_comments(spark, d):
    return _comment_table(spark, d).withColumn("p", r6("p"))


@query(f"WITH {SQL_CENSUS} SELECT doc_id, orden::INT AS orden, frente, tema, round(p, 6) AS p FROM rk UNION ALL SELECT doc_id, NULL, '', '{reports.WITHOUT}', round(best, 6) FROM best WHERE doc_id NOT IN (SELECT doc_id FROM rk)")
def r03_long_list(spark, d):
    return reports.long_table(reports.ranked_themes(scores(spark, d), "doc_id", TAU), "doc_id", PARENT).withColumn("p", r6("p"))


def _wide(spark, d):
    return reports.probability_table(_judged(spark, d), "doc_id", "nouls", NAMES, {"F1": "f1", "F2": "f2", "sin_contenido": "sin_contenido"})


@query("WITH " + SQL_ANSWERS + " SELECT doc_id, " + ", ".join(f"round(nouls['{t}'], 6) AS p_{t}" for t in NAMES) + ", round(f1, 6) AS \"p_F1\", round(f2, 6) AS \"p_F2\", sc AS p_sin_contenido FROM pr")
def r03_probabilities(spark, d):
    w = _wide(spark, d)
    return w.select("doc_id", *(r6(c).alias(c) for c in w.columns[1:]))


SQL_NOTHING = f"sinc AS (SELECT doc_id, CASE WHEN motivo = 'vacio' THEN 'Sin comentario' ELSE 'Excluido: ' || motivo END AS motivo FROM (SELECT doc_id, {SQL_NOISE} AS motivo FROM documents) WHERE motivo IS NOT NULL UNION ALL SELECT doc_id, 'Sin contenido evaluable (' || {_PCT.format('sc')} || ')' FROM pr WHERE sc >= 0.7)"


def _nothing(spark, d):
    out = table(spark, d, "documents").select("doc_id", T.noise_reason("text").alias("why")).filter("why is not null")
    return reports.contentless_table(out, _judged(spark, d), "doc_id", "why", "sin_contenido", TAU)


@query(f"WITH {SQL_ANSWERS}, {SQL_NOTHING} SELECT * FROM sinc")
def r03_contentless(spark, d):
    return _nothing(spark, d)


@query(f"WITH {SQL_CENSUS}, {SQL_COMMENTS}, {SQL_NOTHING} SELECT 'Comentarios' AS hoja, count(*) AS filas, round(avg(p), 5) AS confianza, count(*) FILTER (revisar = 'Sí') AS revisar FROM co UNION ALL SELECT 'Temas_por_comentario', (SELECT count(*) FROM rk) + (SELECT count(*) FROM best WHERE doc_id NOT IN (SELECT doc_id FROM rk)), NULL, NULL UNION ALL SELECT 'Detalle_probabilidades', (SELECT count(*) FROM pr), NULL, NULL UNION ALL SELECT 'Sin_contenido', (SELECT count(*) FROM sinc), NULL, NULL")
def r03_index(spark, d):
    long = reports.long_table(reports.ranked_themes(scores(spark, d), "doc_id", TAU), "doc_id", PARENT)
    return reports.index_table(_comment_table(spark, d), long, _wide(spark, d), _nothing(spark, d)).withColumn("confianza", F.round("confianza", 5))


# ---- combined flow, discovery, run ----------------------------------------------------------
SQL_COMBINED = f"{SQL_HARD}, comb AS (SELECT doc_id, lang, duro, coalesce(array_to_string(list_sort(t), ', '), '') AS temas, CASE WHEN t IS NULL THEN 'sin tema' WHEN list_contains(t, duro) THEN 'Sí' ELSE 'No' END AS coincide FROM hard LEFT JOIN sets USING (doc_id))"


@query(f"WITH {SQL_COMBINED} SELECT * FROM comb")
def r06_classification(spark, d):
    return reports.combined_table(_hard(spark, d), facts(spark, d), "doc_id", "duro", "lang")


@query(f"WITH {SQL_COMBINED} SELECT lang, count(*) AS n, count(*) FILTER (coincide = 'sin tema') AS sin_tema, round(avg((coincide = 'Sí')::INT), 6) AS acuerdo, (SELECT count(*) FROM facts f JOIN hard h USING (doc_id) WHERE h.lang = comb.lang) AS asignaciones FROM comb GROUP BY lang")
def r06_summary(spark, d):
    c = reports.combined_table(_hard(spark, d), facts(spark, d), "doc_id", "duro", "lang")
    return reports.combined_summary(c, facts(spark, d).select("doc_id", "tema"), "doc_id", "lang").withColumn("acuerdo", r6("acuerdo"))


@query(f"WITH {SQL_SCORES}, fx AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, ord) AS r FROM scores), s AS (SELECT doc_id, string_agg(tema, ', ' ORDER BY ord) FILTER (p >= 0.7) AS temas FROM fx GROUP BY doc_id) SELECT lang, source, doc_id, CASE WHEN p >= 0.7 THEN tema ELSE '(cercano: ' || tema || ')' END AS principal, coalesce(temas, '') AS temas, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS orden FROM fx JOIN s USING (doc_id) JOIN (SELECT doc_id, source FROM documents) USING (doc_id) WHERE r = 1")
def r08_classification(spark, d):
    """The comments of each cell of unit and role with their themes, in list order."""
    s = scores(spark, d)
    names = s.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("p") >= TAU, F.struct("ord", "tema")))), lambda x: x["tema"]), ", ").alias("temas"))
    rows = comments(spark, d).select("doc_id", "lang", "source").join(themes.principal(s, "doc_id"), "doc_id").join(names, "doc_id")
    return rows.select("lang", "source", "doc_id", "principal", "temas", F.row_number().over(Window.partitionBy("lang", "source").orderBy("doc_id")).cast("long").alias("orden"))


@query(f"""WITH {SQL_FACTS}, total AS (SELECT count(*)::DOUBLE AS t FROM (SELECT doc_id FROM scores GROUP BY doc_id)), g AS (SELECT tema, count(doc_id)::DOUBLE AS n FROM themes LEFT JOIN facts USING (tema) GROUP BY tema),
 b AS (SELECT DISTINCT doc_id // 15 AS batch FROM facts), f AS (SELECT tema, min(doc_id) // 15 AS batch FROM facts GROUP BY tema), sat AS (SELECT batch, count(tema) AS new FROM b LEFT JOIN f USING (batch) GROUP BY batch),
 pr2 AS (SELECT x.tema AS a, y.tema AS b, count(*) AS c FROM facts x JOIN facts y USING (doc_id) WHERE x.tema < y.tema GROUP BY ALL)
SELECT 'frecuencia' AS tabla, tema AS clave, n::BIGINT AS n, round(n / t, 6) AS valor, {_LO} AS lo, {_HI} AS hi FROM g, total
UNION ALL SELECT 'saturacion', batch::VARCHAR, new, (sum(new) OVER (ORDER BY batch))::DOUBLE, NULL, NULL FROM sat
UNION ALL SELECT 'traslape', a || '~' || b, c, round(c / (ga.n + gb.n - c), 6), NULL, NULL FROM pr2 JOIN g ga ON ga.tema = a JOIN g gb ON gb.tema = b""")
def r10_tables(spark, d):
    f = written(facts(spark, d).select("doc_id", "tema"), "facts")
    sizes = theme_frame(spark).join(f.groupBy("tema").agg(F.count("*").alias("n")), "tema", "left").na.fill(0, ["n"]).select("tema", "n")
    n = comments(spark, d).agg(F.count("*").alias("all"))
    out = reports.discovery_tables(sizes, n, themes.saturation(f, "doc_id", "tema", 15), themes.overlaps(f, "doc_id", NAMES), 15)
    return out.select("tabla", "clave", "n", *(r6(c).alias(c) for c in ("valor", "lo", "hi")))


@query(f"WITH {SQL_JUDGED} SELECT 'principal' AS tabla, principal AS clave, count(*) AS n FROM juicio GROUP BY principal UNION ALL SELECT 'tema', t, count(*) FROM (SELECT unnest(string_split(temas, ',')) AS t FROM juicio) WHERE t <> '' GROUP BY t UNION ALL SELECT 'motivo', m, count(*) FROM (SELECT unnest(string_split(motivo, '; ')) AS m FROM juicio) WHERE m <> '' GROUP BY m")
def r12_counts(spark, d):
    return reports.run_counts(_judged(spark, d))


# ---- topic reports on the models -------------------------------------------------------------
@query()
def r05_group_summary(spark, d):
    """A row for each group: modelled or why not, its k, stability, coherence and density."""
    found, _, terms = _modelled(spark, d)
    vectors = _vectors(spark, d)
    words = written(topics.class_tfidf_cells(terms, found.labels, "grupo", "k", "topic", "vec_id"), "curve_words")
    npmi = topics.npmi_by(words, terms.select("grupo", "vec_id", "term"), ["grupo", "k"], "grupo", "topic", "vec_id")
    diversity = words.groupBy("grupo", "k").agg((F.count_distinct("term") / F.count("*")).alias("diversity"))
    chosen = topics.choose_k(found.curve.withColumnRenamed("grupo", "group")).select(F.col("group").alias("grupo"), "k")
    curve = found.curve.join(npmi, ["grupo", "k"], "left").join(diversity, ["grupo", "k"], "left")
    out = reports.group_summary(vectors.groupBy("grupo").agg(F.count("*").alias("n")), curve, chosen, density.density_clusters(vectors, "grupo", "vec_id", "embedding"), "grupo")
    return out.select("grupo", "n", "modelado", "least", "k", "nivel", "densidad", *(r6(c).alias(c) for c in ("stability", "silhouette", "npmi", "diversity", "sin_tema")))


@query()
def r04_assignments(spark, d):
    """Each row of the chosen models with its topic and affinity, the nearest first."""
    found = clusters.k_curve(_vectors(spark, d), "grupo", "vec_id", "embedding")
    labels = written(topics.best_topics(found.labels, found.curve, "grupo"), "model_labels")
    rows = _vectors(spark, d).join(labels, ["grupo", "vec_id"]).withColumn("tema", F.concat_ws("|", "grupo", "topic"))
    near = topics.affinity(rows, topics.centroids(rows, "tema", "embedding"), "vec_id", "tema", "embedding").withColumn("afinidad", F.round("afinidad", 9))
    out = rows.select("vec_id", "grupo", "topic", "tema").join(near.select("vec_id", "tema", "afinidad"), ["vec_id", "tema"])
    return out.select("grupo", F.col("topic").alias("tema"), "vec_id", r6("afinidad").alias("afinidad"), F.row_number().over(Window.partitionBy("tema").orderBy(F.desc("afinidad"), "vec_id")).cast("long").alias("orden"))


@query(f"WITH {SQL_TERMS}, w AS (SELECT lang, string_agg(term, ', ' ORDER BY rank) FILTER (rank <= 8) AS palabras FROM top GROUP BY lang), n AS (SELECT source, lang, count(*)::DOUBLE AS n FROM documents GROUP BY ALL), t AS (SELECT source, sum(n) AS t FROM n GROUP BY source), l AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS tema, n, t FROM n JOIN t USING (source)) SELECT source, lang, tema, n::BIGINT AS n, t::BIGINT AS total, round(n / t, 6) AS share, {_LO} AS lo, {_HI} AS hi, palabras FROM l LEFT JOIN w USING (lang)")
def r05_topic_list(spark, d):
    """One list of the topics of all groups (here languages within sources), by size."""
    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    all_of = n.groupBy("source").agg(F.sum("n").alias("total"))
    words = topics.class_tfidf(written(_class_terms(spark, d), "terms"), "lang", 8).groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("palabras"))
    lo, hi = stats.wilson(F.col("n"), F.col("total"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "lang")).cast("long")
    return n.join(all_of, "source").join(words, "lang", "left").select("source", "lang", rank.alias("tema"), "n", "total", r6(F.col("n") / F.col("total")).alias("share"), r6(lo).alias("lo"), r6(hi).alias("hi"), "palabras")


# ---- redaction, names, lines of JSON -----------------------------------------------------------
@query()
def k08_redacted_copy(spark, d):
    """The publishable copy with each comment's redacted text (as its digest), written beside
    the original."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("nombre"), F.col("lang").alias("correo"), F.col("text").alias("comentario"))
    clean = docs.select("doc_id", privacy.redact("comentario").alias("comentario"))
    copy = written(privacy.publishable(docs, "nombre", "correo", "comentario", clean, "doc_id"), "copy")
    return copy.select("doc_id", "nombre", "correo", F.length("comentario").alias("largo"), F.sha2("comentario", 256).alias("comentario"))


@query("SELECT (SELECT count(*) FROM documents) AS textos, 0::BIGINT AS con_nombre")
def q11_names_gate(spark, d):
    """The gate before a model: no redacted text may hold a name.  Given names are the first
    words of the suppliers' and customers' names."""
    people = table(spark, d, "supplier").select(F.col("s_name").alias("n")).unionByName(table(spark, d, "customer").select(F.col("c_name").alias("n")))
    docs = table(spark, d, "documents").select("doc_id", privacy.redact("text").alias("t"))
    passed = privacy.no_names_or_stop(docs, "doc_id", "t", privacy.given_names(people, "n"))
    return passed.agg(F.count("*").alias("textos"), F.lit(0).cast("long").alias("con_nombre"))


@query("WITH p AS (SELECT DISTINCT regexp_extract(text, '\\pL+') AS w FROM documents) SELECT DISTINCT " + sql_normal("w") + " AS nombre FROM p WHERE length(w) >= 3")
def f09_given_names(spark, d):
    """Given names of a column: its first words of three letters or more, in normal form."""
    return privacy.given_names(table(spark, d, "documents"), "text")


@query("SELECT event_id, event_type, user_id, round(value, 6) AS value FROM events")
def k03_s06_json_lines(spark, d):
    """Events written as lines of JSON and read again by their schema, blank lines skipped."""
    path = f"{folder(spark)}/lines-{uuid.uuid4().hex}"
    sources.write_json_lines(table(spark, d, "events").select("event_id", "event_type", "user_id", "value"), path)
    back = sources.json_lines(spark.read.text(path), "value", "event_id long, event_type string, user_id long, value double")
    return back.withColumn("value", r6("value"))


@query("SELECT event_id, sha256('{\"event_type\": \"' || event_type || '\", \"props\": {\"k\": ' || coalesce((props::JSON->'$.k')::VARCHAR, 'null') || '}, \"user_id\": ' || user_id || '}') AS clave FROM events")
def f28_canonical(spark, d):
    """The key of a request: a digest of its canonical JSON."""
    e = table(spark, d, "events").select("event_id", F.struct("user_id", F.from_json("props", "k int").alias("props"), "event_type").alias("sent"))
    return e.select("event_id", F.sha2(T.canonical_json(F.col("sent"), e.schema["sent"].dataType), 256).alias("clave"))


@query("SELECT t AS archivo, CASE t WHEN 'orders' THEN 'Pedidos' WHEN 'part' THEN 'Partes' END AS formulario, n FROM (SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier) WHERE t <> 'supplier'")
def s04_forms_of_files(spark, d):
    """Several files read as one table, each row with the form that its file's name stands for;
    files of no known form are left out."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([a-z]+)\.parquet(?:/[^/]*)?$", 1)
    rows = None
    for t in ("orders", "part", "supplier"):
        one = table(spark, d, t).select(name.alias("archivo"))
        rows = one if rows is None else rows.unionByName(one)
    form = sources.form_of_file(F.concat(F.lit("Encuesta ("), "archivo", F.lit(")")), {"ORDERS": "Pedidos", "PART": "Partes"})
    return rows.withColumn("formulario", form).filter("formulario is not null").groupBy("archivo", "formulario").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, m AS motivo, (m IS NOT NULL)::INT AS excluido, m IS NULL AS publicable FROM (SELECT doc_id, {SQL_NOISE} AS m FROM documents)")
def p06_clean_answers(spark, d):
    """The cleaning step: why an answer is left out, and whether it has a redacted text."""
    rows = survey.clean_answers(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "motivo", "excluido", F.col("anon").isNotNull().alias("publicable"))
