"""Queries over the test tables, one for each operator, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import privacy, stats
from .functions import text as T
from .operators import survey, themes, topics
from .sources.documents import written

QUERIES: dict = {}
ORACLES: dict = {}
#: Themes of the lexical scorer: name and key words, in list order.
THEMES = [("articulos", ["the", "der", "la", "el", "le"]), ("enlaces", ["and", "und", "y", "et"]), ("lugar", ["in", "on", "at", "en", "dans"]), ("origen", ["of", "de", "von", "from"]), ("duda", ["stupid", "idiot"])]
NAMES = [t for t, _ in THEMES]
SQL_LETTERS = "[A-Za-zÁÉÍÓÚÑÜáéíóúñü]"
SQL_PLAIN = "regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', '', 'g')"


def sql_normal(x: str) -> str:
    return f"trim(regexp_replace(lower({SQL_PLAIN.format(x)}), '\\s+', ' ', 'g'), ' ')"


_ANSWERS = ", ".join("'" + a + "'" for a in T.NON_ANSWERS)
_EDGES = T.EDGES.replace("'", "''")
SQL_NOISE = f"""CASE WHEN text IS NULL OR regexp_replace(text, '\\s+', '', 'g') = '' THEN 'vacio'
 WHEN NOT regexp_matches(text, '{SQL_LETTERS}') THEN 'solo_signos_o_numeros'
 WHEN len(regexp_extract_all(text, '{SQL_LETTERS}')) < 3 THEN 'menos_de_3_letras'
 WHEN trim({sql_normal('text')}, '{_EDGES}') IN ({_ANSWERS}) THEN 'no_respuesta' END"""
SQL_SCORES = "scores AS (" + " UNION ALL ".join(f"SELECT doc_id, lang, text, '{t}' AS tema, {i} AS ord, least(1.0, len(list_filter(regexp_extract_all(lower(text), '\\p{{L}}+'), lambda w: list_contains([{', '.join(repr(k) for k in kw)}], w))) / 3.0)::DOUBLE AS p FROM documents WHERE ({SQL_NOISE}) IS NULL" for i, (t, kw) in enumerate(THEMES)) + ")"
SQL_THEMES = "themes(tema, ord) AS (VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(NAMES)) + ")"
SQL_FACTS = f"{SQL_SCORES}, {SQL_THEMES}, facts AS (SELECT * FROM scores WHERE p >= 0.7)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def comments(spark, d) -> DataFrame:
    return table(spark, d, "documents").filter(T.noise_reason("text").isNull())


def scores(spark, d) -> DataFrame:
    """Scores of every comment, made in its own row: no text is shuffled."""
    return themes.lexical_scores(comments(spark, d), THEMES, "text", "doc_id", "lang")


def scored(spark, d) -> DataFrame:
    """The scores of every comment with its language and source, written: what several branches
    of a report read is made in one pass over the texts."""
    return written(themes.lexical_scores(comments(spark, d), THEMES, "text", "doc_id", "lang", "source"), "scores")


def items_of(scored: DataFrame) -> DataFrame:
    """The comments of a table of scores, one row each."""
    return scored.filter("ord = 0").select("doc_id", "lang", "source")


def facts(spark, d) -> DataFrame:
    return scores(spark, d).filter(F.col("p") >= themes.TAU)


def theme_frame(spark) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(NAMES)], "tema string, ord int")


def r6(x):
    return F.round(x, 6)


# ---- text rules ----------------------------------------------------------------------------
@query(f"SELECT doc_id, {SQL_NOISE} AS motivo FROM documents")
def p06_noise(spark, d):
    return table(spark, d, "documents").select("doc_id", T.noise_reason("text").alias("motivo"))


@query(f"SELECT doc_id, {sql_normal('text')} AS norm, regexp_replace(trim(lower({SQL_PLAIN.format('source')})), '\\s+', '_', 'g') AS slug_a, trim(regexp_replace({sql_normal('text')}, '[^a-z0-9]+', '_', 'g'), '_') AS slug_b, trim(regexp_replace({SQL_PLAIN.format('text')}, '[^A-Za-z0-9]+', '_', 'g'), '_') AS limpio FROM documents WHERE text IS NOT NULL")
def f01_f03_slugs(spark, d):
    # a step each, so that what the next ones read twice is computed once
    plain = table(spark, d, "documents").filter("text is not null").select("doc_id", "source", T.plain("text").alias("plain"))
    norm = plain.select("doc_id", "source", "plain", T.normal_of_plain(F.col("plain")).alias("norm"))
    return norm.select("doc_id", "norm", T.slug_spaces(F.col("source")).alias("slug_a"), T.joined(F.col("norm"), "a-z0-9").alias("slug_b"), T.joined(F.col("plain"), "A-Za-z0-9").alias("limpio"))


@query()
def f04_redaction(spark, d):
    return privacy.redact_counted(table(spark, d, "documents").select("doc_id", "text")).drop("text")


@query("SELECT doc_id, regexp_replace(text, '[\\w.+\\-\\pL\\pN]+@[\\w\\-\\pL\\pN]+(\\.[\\w\\-\\pL\\pN]+)+', '[CORREO]', 'g') AS t FROM documents")
def f04_mail(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_replace("text", privacy.RULES[0][2], "[CORREO]").alias("t"))


@query()
def f09_name_audit(spark, d):
    return table(spark, d, "documents").select("doc_id", privacy.name_audit("text").alias("kinds"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '\\pL+')) AS words, len(list_distinct(regexp_extract_all(text, '\\pL+'))) AS distinct_words, regexp_replace(text, '\\[[A-Z_]+\\]', ' ', 'g') AS unmarked FROM documents")
def f10_f11_words(spark, d):
    words = F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0)
    return table(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("words"), F.size(F.array_distinct(words)).cast("long").alias("distinct_words"), T.without_marks("text").alias("unmarked"))


@query("SELECT doc_id, length(text) AS n, length(trim(text)) AS trimmed, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS words, substr(text, 1, 40) || '…' AS short, substr(regexp_replace(source || '[:*?/\\]' || text, '[\\[\\]:*?/\\\\]', '', 'g'), 1, 31) AS sheet FROM documents")
def f13_k09_lengths(spark, d):
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"), F.length(F.trim("text")).cast("long").alias("trimmed"), F.size(words).cast("long").alias("words"), F.concat(F.substring("text", 1, 40), F.lit("…")).alias("short"), T.sheet_name(F.concat("source", F.lit("[:*?/\\]"), "text")).alias("sheet"))


@query("SELECT l_orderkey, l_linenumber, (CASE WHEN x - floor(x) = 0.5 THEN (floor(x) + (floor(x)::BIGINT % 2))::BIGINT ELSE round(x)::BIGINT END)::VARCHAR || '%' AS pct FROM (SELECT *, l_discount::DOUBLE * 100 AS x FROM lineitem)")
def f14_percent(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.percent_label(F.col("l_discount").cast("double")).alias("pct"))


@query(f"SELECT doc_id, 't' || doc_id || CASE WHEN w = '' THEN '_' ELSE '_' || w END AS id FROM (SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace({sql_normal('text')}, '[^a-z0-9]+', '_', 'g'), '_'), '_'), lambda x: length(x) > 2)[1:4], '_') AS w FROM documents WHERE text IS NOT NULL)")
def f15_theme_id(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.theme_id(F.col("doc_id"), F.col("text")).alias("id"))


# ---- dates, arrays, JSON -------------------------------------------------------------------
_M = "[" + ", ".join(f"'{m}'" for m in T.MONTHS) + "]"


@query(f"""WITH r AS (SELECT user_id, min(ts)::DATE AS a, max(ts)::DATE AS b, round(epoch(max(ts)) - epoch(min(ts)), 3) AS secs FROM events GROUP BY user_id)
SELECT user_id, strftime(a, '%Y-%m-%d') || '_a_' || strftime(b, '%Y-%m-%d') AS rango, secs, CASE WHEN a = b THEN e WHEN date_trunc('month', a) = date_trunc('month', b) THEN day(a) || '-' || e ELSE day(a) || ' ' || {_M}[month(a)] || ' - ' || e END AS label
FROM (SELECT *, day(b) || ' ' || {_M}[month(b)] || ' ' || year(b) AS e FROM r)""")
def f20_f23_dates(spark, d):
    r = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return r.select("user_id", F.concat_ws("_a_", day("a"), day("b")).alias("rango"), F.round((micros("b") - micros("a")) / 1e6, 3).alias("secs"), T.date_range_label(F.to_date("a"), F.to_date("b")).alias("label"))


@query("SELECT lang, count(*) AS n, greatest(3, ceil(count(*) * 0.05))::BIGINT AS least_comments, ceil(count(*) * 0.10)::BIGINT AS tenth, greatest(5, ceil(count(*) * 0.03))::BIGINT AS least_topic FROM documents GROUP BY lang")
def f24_least_sizes(spark, d):
    n = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return n.select("lang", "n", stats.least_comments(F.col("n")).alias("least_comments"), F.ceil(F.col("n") * 0.10).cast("long").alias("tenth"), stats.least_topic(F.col("n")).alias("least_topic"))


# ---- filters and profiles ------------------------------------------------------------------
@query("SELECT event_id FROM events WHERE event_type = 'click' AND (strftime(ts, '%Y-%m-%d') IN ('2024-01-05', '2024-01-06') OR event_id IN (7, 8)) AND contains(lower(event_type), 'cli')")
def p01_exercise(spark, d):
    return survey.exercise(table(spark, d, "events"), "cli", "click", ["2024-01-05", "2024-01-06"], [7, 8], unit_col="event_type", form_col="event_type", id_col="event_id").select("event_id")


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS dia FROM events WHERE regexp_matches(event_type, 'cl|vi')")
def p02_p03_days(spark, d):
    return table(spark, d, "events").filter(F.regexp_like("event_type", F.lit("cl|vi"))).select(F.date_format("ts", "yyyy-MM-dd").alias("dia")).distinct()


@query("SELECT doc_id FROM documents WHERE contains(source, 'src1') AND len(regexp_split_to_array(trim(text), '\\s+')) <= 3")
def p08_p10_short(spark, d):
    return table(spark, d, "documents").filter(F.col("source").contains("src1") & (F.size(F.split(F.trim("text"), r"\s+")) <= 3)).select("doc_id")


@query("SELECT coalesce(lang, '(vacío)') AS value, count(*) AS n FROM documents GROUP BY 1")
def a02_value_counts(spark, d):
    return survey.value_counts(table(spark, d, "documents"), "lang")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS \"distinct\" FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")) + ")")
def a09_column_profile(spark, d):
    return survey.column_profile(table(spark, d, "documents")).drop("dtype")


@query("SELECT l_returnflag, round(quantile_cont(q, 0.25), 6) AS p25, round(quantile_cont(q, 0.5), 6) AS p50, round(quantile_cont(q, 0.75), 6) AS p75, round(quantile_cont(q, 0.95), 6) AS p95, max(q) AS max, round(median(q), 6) AS mediana FROM (SELECT l_returnflag, l_extendedprice::DOUBLE AS q FROM lineitem) GROUP BY 1")
def a07_quantiles(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("q"))
    out = survey.weighted_quantiles(x, ["l_returnflag"], "q", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    return out.select("l_returnflag", *(r6(c).alias(c) for c in ("p25", "p50", "p75", "p95")), "max", r6("p50").alias("mediana"))


@query("SELECT source, count(*) AS filas, count(text) AS con_texto, count(*) - count(DISTINCT text) AS repetidos, count(DISTINCT lang) AS idiomas, min(n_chars) AS lo, max(n_chars) AS hi, round(avg(n_chars), 6) AS media, array_to_string(list_sort(list(DISTINCT lang)), ', ') AS lista FROM documents GROUP BY source")
def a01_a10_source_profile(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("filas"), F.count("text").alias("con_texto"), (F.count("*") - F.count_distinct("text")).alias("repetidos"), F.count_distinct("lang").alias("idiomas"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), r6(F.avg("n_chars")).alias("media"), F.array_join(F.array_sort(F.collect_set("lang")), ", ").alias("lista"))


@query("SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source")
def a11_pivot(spark, d):
    return table(spark, d, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source, lang), (source))")
def a13_two_levels(spark, d):
    return table(spark, d, "documents").groupingSets([["source", "lang"], ["source"]], "source", "lang").agg(F.count("*").alias("n"))


@query("SELECT source, lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS pct FROM documents GROUP BY source, lang")
def a15_share_within(spark, d):
    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.withColumn("pct", r6(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("lang"))))


@query("SELECT w AS palabra, count(*) AS n FROM (SELECT unnest(string_split(source || '; ' || lang, '; ')) AS w FROM documents) WHERE w <> '' GROUP BY w")
def a18_reasons(spark, d):
    return table(spark, d, "documents").select(F.explode(F.split(F.concat_ws("; ", "source", "lang"), "; ")).alias("palabra")).filter("palabra <> ''").groupBy("palabra").agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT text, min(doc_id) AS m FROM documents WHERE text IS NOT NULL GROUP BY text) SELECT d.doc_id, 'U' || lpad(r::VARCHAR, greatest(3, length(r::VARCHAR))::INTEGER, '0') AS id_texto_unico FROM documents d JOIN (SELECT *, row_number() OVER (ORDER BY m) AS r FROM f) USING (text)")
def w01_unique_numbers(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    return docs.select("doc_id", survey.text_digest("text").alias("digest")).join(survey.unique_numbers(docs, "text", "doc_id"), "digest").select("doc_id", "id_texto_unico")


@query("WITH l AS (SELECT page_id, unnest(string_split(html, '<p>')) AS line, unnest(range(len(string_split(html, '<p>')))) AS pos FROM pages) SELECT page_id, pos::INTEGER AS \"at\", (sum(CASE WHEN starts_with(line, '<b>') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos))::BIGINT AS section FROM l")
def w06_s09_sections(spark, d):
    lines = table(spark, d, "pages").select("page_id", F.posexplode(F.split("html", "<p>")).alias("at", "line"))
    return survey.sections(lines, doc="page_id", header="^<b>").select("page_id", "at", "section")


# ---- themes: assignment, overlap, cells, gates ---------------------------------------------
@query(f"WITH {SQL_FACTS} SELECT doc_id, tema, p, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, ord) AS rank FROM facts")
def p14_w03_assignments(spark, d):
    return themes.assign(scores(spark, d), "doc_id").select("doc_id", "tema", "p", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {SQL_SCORES}, b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, ord) AS r FROM scores) SELECT doc_id, CASE WHEN p >= 0.7 THEN tema ELSE '(cercano: ' || tema || ')' END AS principal, round(p, 6) AS p FROM b WHERE r = 1")
def w09_principal(spark, d):
    return themes.principal(scores(spark, d), "doc_id").withColumn("p", r6("p"))


@query(f"WITH {SQL_FACTS} SELECT t.tema, count(doc_id) AS n FROM themes t LEFT JOIN facts f USING (tema) GROUP BY t.tema")
def a12_theme_counts(spark, d):
    return theme_frame(spark).join(facts(spark, d).groupBy("tema").agg(F.count("*").alias("n")), "tema", "left").select("tema", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {SQL_FACTS}, n AS (SELECT tema, count(*) AS n FROM facts GROUP BY tema), b AS (SELECT x.tema AS a, y.tema AS b, count(*) AS c2 FROM facts x JOIN facts y USING (doc_id) WHERE x.tema < y.tema GROUP BY ALL) SELECT p.tema AS a, q.tema AS b, coalesce(c2, 0) AS \"both\", round(CASE WHEN coalesce(x.n,0)+coalesce(y.n,0) > 0 THEN coalesce(c2,0) / (coalesce(x.n,0)+coalesce(y.n,0)-coalesce(c2,0)) ELSE 0 END, 6) AS jaccard FROM themes p JOIN themes q ON p.tema < q.tema LEFT JOIN b ON b.a = p.tema AND b.b = q.tema LEFT JOIN n x ON x.tema = p.tema LEFT JOIN n y ON y.tema = q.tema")
def j08_m19_overlaps(spark, d):
    return themes.overlaps(facts(spark, d), "doc_id", NAMES).withColumn("jaccard", r6("jaccard"))


@query(f"WITH {SQL_FACTS}, s AS (SELECT DISTINCT doc_id // 15 AS batch FROM facts), f AS (SELECT tema, min(doc_id) // 15 AS batch FROM facts GROUP BY tema), n AS (SELECT batch, count(tema) AS new FROM s LEFT JOIN f USING (batch) GROUP BY batch) SELECT batch, new, (sum(new) OVER (ORDER BY batch))::BIGINT AS total FROM n")
def w04_saturation(spark, d):
    return themes.saturation(facts(spark, d), "doc_id", "tema", 15)


SQL_CELLS = f"{SQL_FACTS}, i AS (SELECT doc_id, lang, source FROM documents WHERE ({SQL_NOISE}) IS NULL), k AS (SELECT lang, source, tema FROM (SELECT DISTINCT lang FROM i) CROSS JOIN (SELECT DISTINCT source FROM i) CROSS JOIN themes), cells AS (SELECT k.*, coalesce(a.N, 0) AS N_, coalesce(b.n, 0) AS n FROM k LEFT JOIN (SELECT lang, source, count(*) AS N FROM i GROUP BY ALL) a USING (lang, source) LEFT JOIN (SELECT i.lang, i.source, tema, count(*) AS n FROM facts JOIN i USING (doc_id) GROUP BY ALL) b USING (lang, source, tema))"


def _cells(spark, d, s=None):
    s = scored(spark, d) if s is None else s
    return survey.cells(s.filter(F.col("p") >= themes.TAU).select("doc_id", "tema"), items_of(s), ["lang", "source"], "doc_id", "tema", theme_frame(spark).select("tema"))


@query(f"WITH {SQL_CELLS} SELECT lang, source, tema, N_ AS filas, n, round(CASE WHEN N_ > 0 THEN 100.0 * n / N_ END, 6) AS pct FROM cells")
def a14_j09_cells(spark, d):
    return _cells(spark, d).select("lang", "source", "tema", F.col("total").alias("filas"), "n", r6("pct").alias("pct"))


@query(f"WITH {SQL_CELLS}, w AS (SELECT tema, 100.0 * count(*) / (SELECT count(*) FROM i) AS weight FROM facts GROUP BY tema) SELECT lang, source, tema FROM cells JOIN w USING (tema) WHERE N_ >= 5 AND n = 0 AND weight >= 15")
def p12_zero_cells(spark, d):
    s = scored(spark, d)
    n = items_of(s).agg(F.count("*").alias("all"))
    w = s.filter(F.col("p") >= themes.TAU).groupBy("tema").agg(F.count("*").alias("k")).join(F.broadcast(n)).select("tema", (100.0 * F.col("k") / F.col("all")).alias("weight"))
    return survey.zero_cells(_cells(spark, d, s), w, "tema").select("lang", "source", "tema")


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NULL AS solo_etiqueta FROM documents a FULL JOIN (SELECT doc_id + 5 AS doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def j07_t04_coverage_diff(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("a"))
    b = table(spark, d, "labels").select((F.col("doc_id") + 5).alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full_outer").filter("a is null or b is null").select(F.coalesce("a", "b").alias("doc_id"), F.col("a").isNull().alias("solo_etiqueta"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def j06_anti(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Estudiantes' WHEN 'assistant' THEN 'Docentes' ELSE 'Sin rol declarado' END AS rol FROM conversations")
def j04_roles(spark, d):
    names = F.create_map(F.lit("user"), F.lit("Estudiantes"), F.lit("assistant"), F.lit("Docentes"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.try_element_at(names, F.col("role")), F.lit("Sin rol declarado")).alias("rol"))


@query("SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS best FROM documents GROUP BY source")
def a20_best_example(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("best"))


@query("SELECT source, lang AS mayoria FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY source, lang) WHERE r = 1")
def a21_majority(spark, d):
    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return topics.top_per_group(n, "source", 1, F.desc("n"), "lang").select("source", F.col("lang").alias("mayoria"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)")
def o03_top(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey")


# ---- metrics -------------------------------------------------------------------------------
@query("SELECT source, round(greatest(0, (k/n + z*z/(2*n))/(1+z*z/n) - z*sqrt(k/n*(1-k/n)/n + z*z/(4*n*n))/(1+z*z/n)), 6) AS lo, round(3.0/n, 6) AS tres, round(m/(1+(m-1)/n), 6) AS muestra, round(least(1, greatest(0, (k/n + 0.95 - 1)/(0.9+0.95-1))), 6) AS rg FROM (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (lang = 'en')::DOUBLE AS k, 1.959964 AS z, 1.959964*1.959964*0.25/0.0025 AS m FROM documents GROUP BY source)")
def m01_m03_m15(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("lang") == "en").cast("double").alias("k"))
    return g.select("source", r6(stats.wilson(F.col("k"), F.col("n"))[0]).alias("lo"), r6(stats.rule_of_three(F.col("n"))).alias("tres"), r6(stats.sample_size(F.col("n"))).alias("muestra"), r6(stats.rogan_gladen(F.col("k") / F.col("n"), F.lit(0.9), F.lit(0.95))).alias("rg"))


@query("WITH c AS (SELECT count(*) FILTER (quality=1 AND toxic=1) vp, count(*) FILTER (quality=0 AND toxic=1) fp, count(*) FILTER (quality=1 AND toxic=0) fn, count(*) FILTER (quality=0 AND toxic=0) vn FROM labels) SELECT vp, fp, fn, vn, round(vp/(vp+fp), 6) AS precision, round(vp/(vp+fn), 6) AS recall, round(vn/(vn+fp), 6) AS specificity, round(2*vp/(2*vp+fp+fn), 6) AS f1, round(((vp+vn)/(vp+fp+fn+vn) - ((vp+fp)*(vp+fn)+(fn+vn)*(fp+vn))/((vp+fp+fn+vn)*(vp+fp+fn+vn)))/(1-((vp+fp)*(vp+fn)+(fn+vn)*(fp+vn))/((vp+fp+fn+vn)*(vp+fp+fn+vn))), 6) AS kappa FROM c")
def m05_binary(spark, d):
    c = table(spark, d, "labels").agg(*stats.confusion(F.col("quality"), F.col("toxic")))
    return stats.binary_metrics(c).select("vp", "fp", "fn", "vn", *(r6(x).alias(x) for x in ("precision", "recall", "specificity", "f1", "kappa")))


@query("WITH p AS (SELECT quality x, toxic y, count(*)::DOUBLE c FROM labels GROUP BY ALL), n AS (SELECT sum(c) n, sum(c) FILTER (x = y) s FROM p) SELECT round((s/n - e)/(1 - e), 6) AS kappa FROM n CROSS JOIN (SELECT sum(a.nx * b.ny) / max((SELECT n*n FROM n)) AS e FROM (SELECT x, sum(c) nx FROM p GROUP BY x) a JOIN (SELECT y, sum(c) ny FROM p GROUP BY y) b ON a.x = b.y)")
def m06_kappa(spark, d):
    return stats.kappa(table(spark, d, "labels"), "quality", "toxic").select(r6("kappa").alias("kappa"))


SQL_SETS = f"{SQL_SCORES}, sets AS (SELECT doc_id, coalesce(list(tema) FILTER (p >= 0.7), []) AS t, coalesce(list(tema) FILTER (p >= 1.0), []) AS g FROM scores GROUP BY doc_id)"


@query(f"WITH {SQL_SETS} SELECT round(2.0*sum(len(list_intersect(t,g)))/sum(len(t)+len(g)), 6) AS micro_f1, round(sum(len(t)+len(g)-2*len(list_intersect(t,g)))/(count(*)*5.0), 6) AS hamming, round(avg((list_sort(t)=list_sort(g))::INT), 6) AS exact_match, round(avg(CASE WHEN len(t)+len(g)=0 THEN 1.0 ELSE len(list_intersect(t,g))::DOUBLE/(len(t)+len(g)-len(list_intersect(t,g))) END), 6) AS jaccard FROM sets")
def m07_m11_multilabel(spark, d):
    s = scores(spark, d)
    items = s.select("doc_id")
    t = stats.label_sets(s.filter("p >= 0.7"), items, "doc_id", "tema", "t")
    g = stats.label_sets(s.filter("p >= 1.0"), items, "doc_id", "tema", "g")
    m = stats.multilabel_metrics(t.join(g, "doc_id"), "t", "g", len(NAMES))
    return m.select(*(r6(c).alias(c) for c in m.columns))


@query(f"WITH {SQL_SCORES}, c AS (SELECT tema, count(*) FILTER (p >= 0.7 AND p >= 1) vp, count(*) FILTER (p < 0.7 AND p >= 1) fp, count(*) FILTER (p >= 0.7 AND p < 1) fn FROM scores GROUP BY tema) SELECT round(avg(CASE WHEN 2*vp+fp+fn > 0 THEN 2.0*vp/(2*vp+fp+fn) ELSE 0 END), 6) AS macro_f1 FROM c")
def m08_macro(spark, d):
    c = scores(spark, d).groupBy("tema").agg(*stats.confusion((F.col("p") >= 0.7), (F.col("p") >= 1.0)))
    return stats.macro_f1(c).select(r6("macro_f1").alias("macro_f1"))


SQL_PY = "py AS (SELECT (l.doc_id % 97) / 97.0 AS p, quality AS y FROM labels l)"


@query(f"WITH {SQL_PY}, b AS (SELECT least(9, floor(p*10)) b, count(*) n, avg(p) p, avg(y) y FROM py GROUP BY 1) SELECT round((SELECT avg((p-y)*(p-y)) FROM py), 6) AS brier, round(sum(abs(p-y)*n)/sum(n), 6) AS ece FROM b")
def m13_m14_calibration(spark, d):
    py = table(spark, d, "labels").select(((F.col("doc_id") % 97) / 97.0).alias("p"), F.col("quality").alias("y"))
    return py.agg(r6(stats.brier(F.col("p"), F.col("y"))).alias("brier")).join(stats.calibration(py, "p", "y").select(r6("ece").alias("ece")))


@query("WITH c AS (SELECT lang a, source b, count(*)::DOUBLE c FROM documents GROUP BY ALL), n AS (SELECT sum(c) n FROM c), g AS (SELECT r.a, k.b, r.s * k.s / n AS e, coalesce(c.c, 0) AS o, n FROM (SELECT a, sum(c) s FROM c GROUP BY a) r CROSS JOIN (SELECT b, sum(c) s FROM c GROUP BY b) k CROSS JOIN n LEFT JOIN c ON c.a = r.a AND c.b = k.b) SELECT round(sum((o-e)*(o-e)/e), 6) AS chi2, round(sqrt(sum((o-e)*(o-e)/e)/(max(n)*(least(count(DISTINCT a), count(DISTINCT b))-1))), 6) AS cramer_v, round(100*avg((e<5)::INT), 6) AS pct_low FROM g")
def m16_chi_square(spark, d):
    x = stats.chi_square(table(spark, d, "documents"), "lang", "source")
    return x.select(*(r6(c).alias(c) for c in ("chi2", "cramer_v", "pct_low")))


SQL_P = "ps AS (SELECT source, lang, (count(*) % 29 + 1) / 60.0 AS p FROM documents GROUP BY ALL)"


@query(f"WITH {SQL_P}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p, source) r, count(*) OVER (PARTITION BY lang) m FROM ps) SELECT lang, source, round(least(1.0, min(m*p/r) OVER (PARTITION BY lang ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_adj FROM r")
def m17_w07_bh(spark, d):
    p = table(spark, d, "documents").groupBy("source", "lang").agg(((F.count("*") % 29 + 1) / 60.0).alias("p"))
    return stats.benjamini_hochberg(p, "p", by="lang").select("lang", "source", r6("p_adj").alias("p_adj"))


# ---- topics --------------------------------------------------------------------------------
SQL_TERMS = f"terms AS (SELECT doc_id, lang, term, count(*) AS n FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS term FROM documents) WHERE length(term) >= 3 GROUP BY ALL), per AS (SELECT lang, term, sum(n) n FROM terms GROUP BY ALL), tot AS (SELECT lang, sum(n) words FROM per GROUP BY lang), uses AS (SELECT term, sum(n) uses FROM per GROUP BY term), sc AS (SELECT lang, term, n::BIGINT AS n, round(n/words*ln(1+(SELECT sum(words)/count(*) FROM tot)/uses), 12) AS score FROM per JOIN tot USING (lang) JOIN uses USING (term)), top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS rank FROM sc QUALIFY rank <= 10)"


def _words(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), 0).alias("w"))


def _class_terms(spark, d):
    """Uses of each term in each class: the counts of a task shrink to its vocabulary before
    they are shuffled.  (Before an inner explode the optimiser filters by the array's size, for
    which it takes each text apart twice.)"""
    return _words(spark, d).select("lang", F.explode_outer("w").alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n")).filter("term is not null")


def _top_words(spark, d):
    return topics.class_tfidf(written(_class_terms(spark, d), "terms"), "lang")


@query(f"WITH {SQL_TERMS} SELECT lang, rank, term, n, round(score, 9) AS score FROM top")
def v02_v03_class_tfidf(spark, d):
    return _top_words(spark, d).withColumn("rank", F.col("rank").cast("long")).withColumn("score", F.round("score", 9))


@query(f"WITH {SQL_TERMS} SELECT round(count(DISTINCT term) / count(*), 6) AS diversity FROM top")
def v05_diversity(spark, d):
    return topics.diversity(_top_words(spark, d)).select(r6("diversity").alias("diversity"))


@query(f"WITH {SQL_TERMS}, u AS (SELECT DISTINCT doc_id, term FROM terms WHERE term IN (SELECT term FROM top)), n AS (SELECT count(DISTINCT doc_id)::DOUBLE nd FROM terms), df AS (SELECT term, count(*) df FROM u GROUP BY term), b AS (SELECT x.term a, y.term b, count(*) c FROM u x JOIN u y USING (doc_id) WHERE x.term < y.term GROUP BY ALL), v AS (SELECT coalesce(c, 0)/nd AS pij, nd, x.df da, y.df db FROM top p JOIN top q ON p.lang = q.lang AND p.term < q.term CROSS JOIN n LEFT JOIN b ON b.a = p.term AND b.b = q.term JOIN df x ON x.term = p.term JOIN df y ON y.term = q.term) SELECT round(avg(CASE WHEN pij = 0 THEN -1 WHEN pij = 1 THEN 1 ELSE ln(pij*nd*nd/(da*db))/-ln(pij) END), 6) AS npmi FROM v")
def v04_npmi(spark, d):
    return topics.npmi_of_rows(written(_top_words(spark, d), "top"), _words(spark, d), "lang", "w").select(r6("npmi").alias("npmi"))


SQL_CENT = "m AS (SELECT label, i, avg(v::DOUBLE) v FROM (SELECT label, unnest(embedding) v, unnest(range(len(embedding))) i FROM embeddings) GROUP BY ALL), nn AS (SELECT label, sqrt(sum(v*v)) nn FROM m GROUP BY label), e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE x, unnest(range(len(embedding))) i FROM embeddings), a AS (SELECT e.vec_id, e.label, sum(e.x * m.v / nn) AS af FROM e JOIN m ON m.label = e.label AND m.i = e.i JOIN nn ON nn.label = e.label GROUP BY ALL)"


@query(f"WITH {SQL_CENT} SELECT vec_id, label, round(af, 6) AS afinidad FROM a")
def v15_v16_affinity(spark, d):
    e = table(spark, d, "embeddings")
    return topics.affinity(e, topics.centroids(e, "label", "embedding"), "vec_id", "label", "embedding").withColumn("afinidad", r6("afinidad"))


@query(f"WITH {SQL_CENT}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(af, 9) DESC, vec_id) r FROM a) SELECT label, vec_id, r AS rank FROM r WHERE r <= 3")
def w02_representatives(spark, d):
    e = table(spark, d, "embeddings")
    a = topics.affinity(e, topics.centroids(e, "label", "embedding"), "vec_id", "label", "embedding").withColumn("afinidad", F.round("afinidad", 9))
    return topics.top_per_group(a, "label", 3, F.desc("afinidad"), "vec_id").select("label", "vec_id", F.col("rank").cast("long").alias("rank"))


SQL_CURVE = "curve AS (SELECT source AS g, (n_chars % 13 + 2)::INT AS k, doc_id % 3 > 0 AS valid, round((doc_id % 101) / 101.0, 9) AS s FROM documents QUALIFY row_number() OVER (PARTITION BY source, n_chars % 13 ORDER BY doc_id) = 1)"


@query(f"WITH {SQL_CURVE} SELECT g AS \"group\", coalesce(max(k) FILTER (valid AND s >= 0.75), max(k) FILTER (valid AND s >= 0.60), arg_max(k, (s, -k)) FILTER (valid)) AS k FROM curve GROUP BY g")
def v08_v10_choose_k(spark, d):
    first = topics.top_per_group(table(spark, d, "documents").withColumn("b", F.concat_ws("|", "source", (F.col("n_chars") % 13).cast("string"))), "b", 1, "doc_id")
    curve = first.select(F.col("source").alias("group"), (F.col("n_chars") % 13 + 2).cast("int").alias("k"), (F.col("doc_id") % 3 > 0).alias("valid"), F.round((F.col("doc_id") % 101) / 101.0, 9).alias("stability"))
    return topics.choose_k(curve)
