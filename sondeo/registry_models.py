"""Queries of the topic models by group, the scoring of texts, stores, and statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import stats
from .functions import text as T
from .operators import clusters, density, flow, scoring, survey, themes, topics
from .registry import NAMES, SQL_NOISE, SQL_TERMS, THEMES, _words, comments, query, r6, table
from .sources.store import Store, encode_missing
from .sources.tables import folder, written

#: Groups of vectors: the remainder of the label, so that each has several clusters.
GROUPS = 3


# ---- the curve of k and the topic model ---------------------------------------------------
def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", (F.col("label") % GROUPS).alias("grupo"), "embedding")


@query()
def v06_v09_stability(spark, d):
    """The curve of k over all vectors as one group: k to 15, 20 starts, 20 subsamples with 10."""
    one = table(spark, d, "embeddings").select("vec_id", F.lit("todas").alias("grupo"), "embedding")
    return clusters.k_curve(one, "grupo", "vec_id", "embedding").curve.select("k", "smallest", "valid", r6("stability").alias("stability"), r6("stability_mean").alias("stability_mean"), r6("silhouette").alias("silhouette"), "level")


def _modelled(spark, d):
    """The curve with its word diagnostics, the labels, and terms of the texts, by group."""
    vectors = _vectors(spark, d)
    found = clusters.k_curve(vectors, "grupo", "vec_id", "embedding")
    # joined first: only texts with a vector are taken apart
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text").join(vectors.select("vec_id", "grupo"), "vec_id")
    docs = written(docs.select("vec_id", "grupo", T.tokens(F.col("text")).alias("toks")), "model_docs")
    terms = docs.select("grupo", "vec_id", F.explode("toks").alias("term")).groupBy("grupo", "vec_id", "term").agg(F.count("*").alias("n"))
    n = docs.groupBy("grupo").agg(F.count("*").alias("docs"))
    least = F.when(F.col("docs") >= 100, 2).otherwise(1)
    known = terms.groupBy("grupo", "term").agg(F.count("*").alias("df")).join(n, "grupo").filter(F.col("df") >= least).select("grupo", "term")
    return found, docs, written(terms.join(known, ["grupo", "term"], "left_semi"), "model_terms")


@query()
def v09_group_curves(spark, d):
    """The curve of k of each group with stability, silhouette, coherence and diversity, and
    the k that is chosen."""
    found, _, terms = _modelled(spark, d)
    words = written(topics.class_tfidf_cells(terms, found.labels, "grupo", "k", "topic", "vec_id"), "curve_words")
    npmi = topics.npmi_by(words, terms.select("grupo", "vec_id", "term"), ["grupo", "k"], "grupo", "topic", "vec_id")
    diversity = words.groupBy("grupo", "k").agg((F.count_distinct("term") / F.count("*")).alias("diversity"))
    chosen = topics.choose_k(found.curve.withColumnRenamed("grupo", "group")).select(F.col("group").alias("grupo"), F.col("k").alias("mejor"))
    out = found.curve.join(npmi, ["grupo", "k"], "left").join(diversity, ["grupo", "k"], "left").join(chosen, "grupo")
    return out.select("grupo", "k", "smallest", "valid", "level", *(r6(c).alias(c) for c in ("stability", "stability_mean", "silhouette", "npmi", "diversity")), F.col("k").eqNullSafe(F.col("mejor")).alias("elegido"))


@query()
def v10_v13_topic_model(spark, d):
    """The chosen model of each group: topics by size with their diversified words, stability,
    mean affinity and three representative rows."""
    found, docs, terms = _modelled(spark, d)
    labels = written(topics.best_topics(found.labels, found.curve, "grupo"), "model_labels")
    words = topics.class_tfidf_by(terms.join(labels, ["grupo", "vec_id"]), ["grupo"], "topic", top=30)
    words = written(words, "model_words")
    vectors = topics.word_vectors(docs, "toks", words)
    picked = topics.diversified(words, vectors, ["grupo", "topic"]).filter("rank <= 8")
    lists = picked.groupBy("grupo", "topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("palabras"))
    rows = _vectors(spark, d).join(labels, ["grupo", "vec_id"]).withColumn("tema", F.concat_ws("|", "grupo", "topic"))
    near = topics.affinity(rows, topics.centroids(rows, "tema", "embedding"), "vec_id", "tema", "embedding").withColumn("afinidad", F.round("afinidad", 9))
    first = topics.top_per_group(near, "tema", 3, F.desc("afinidad"), "vec_id").groupBy("tema").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").cast("string").alias("id")))), lambda x: x["id"]), ",").alias("representativos"))
    sizes = rows.groupBy("grupo", "k", "topic", "tema").agg(F.count("*").alias("n"))
    stable = found.curve.select("grupo", "k", "topics")
    out = sizes.join(near.groupBy("tema").agg(F.avg("afinidad").alias("afinidad")), "tema").join(first, "tema").join(stable, ["grupo", "k"]).join(lists, ["grupo", "topic"], "left")
    own = F.col("topics")[F.col("topic")]
    return out.select("grupo", "k", F.col("topic").alias("tema"), "n", r6("afinidad").alias("afinidad"), r6(own).alias("estabilidad"), topics.stability_level(own).alias("nivel"), "palabras", "representativos")


@query()
def v12_density(spark, d):
    """What density clustering finds in each group: clusters, and the share of rows in none."""
    return density.density_clusters(_vectors(spark, d), "grupo", "vec_id", "embedding").select("grupo", "n", "clusters", r6("outliers").alias("outliers"))


SQL_MMR = f"""{SQL_TERMS}, cand AS (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS rank FROM sc QUALIFY rank <= 30),
 tk AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\\p{{L}}+'), lambda w: length(w) >= 3) AS t FROM documents),
 pos AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM tk), cen AS (SELECT t, i, t[i] AS term FROM pos WHERE t[i] IN (SELECT term FROM cand)),
 pr AS (SELECT term, unnest(list_concat(t[greatest(i - 4, 1):i - 1], t[i + 1:i + 4])) AS c FROM cen), nn AS (SELECT term, c, count(*)::DOUBLE AS n FROM pr GROUP BY ALL),
 nt AS (SELECT term, sum(n) AS nt FROM nn GROUP BY term), nc AS (SELECT c, sum(n) AS nc FROM nn GROUP BY c), w AS (SELECT term, c, ln(n * (SELECT sum(n) FROM nn) / (nt * nc)) AS w FROM nn JOIN nt USING (term) JOIN nc USING (c)),
 dig AS (SELECT term, unnest(range({topics.WORD_DIMS})) AS i, w, md5(c) AS h FROM w WHERE w > 0), vv AS (SELECT term, i, round(sum(w * (instr('0123456789abcdef', substr(h, i + 1, 1)) - 8.5)), 9) AS x FROM dig GROUP BY ALL),
 vec AS (SELECT term, list(x ORDER BY i) AS v FROM vv GROUP BY term), c2 AS (SELECT lang, rank, term, coalesce(v, list_resize([]::DOUBLE[], {topics.WORD_DIMS}, 0.0)) AS v FROM cand LEFT JOIN vec USING (term)),
 mean AS (SELECT lang, list(x ORDER BY i) AS m FROM (SELECT lang, i, sum(v[i + 1]) / count(*) AS x FROM c2, range({topics.WORD_DIMS}) r(i) GROUP BY ALL) GROUP BY lang),
 near AS (SELECT lang, rank, term, v, round(CASE WHEN list_dot_product(v, v) * list_dot_product(m, m) > 0 THEN list_dot_product(v, m) / sqrt(list_dot_product(v, v) * list_dot_product(m, m)) ELSE 0 END, 9) AS near FROM c2 JOIN mean USING (lang)),
 sim AS (SELECT a.lang, a.rank, list(round(CASE WHEN list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v) > 0 THEN list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) ELSE 0 END, 9) ORDER BY b.rank) AS s FROM c2 a JOIN c2 b USING (lang) GROUP BY ALL),
 cs AS (SELECT lang, rank, term, near, s FROM near JOIN sim USING (lang, rank)),
 pick AS (SELECT lang, 0 AS step, []::BIGINT[] AS ch FROM (SELECT DISTINCT lang FROM cand) UNION ALL SELECT lang, step, list_append(ch, r) FROM (SELECT p.lang, p.step + 1 AS step, p.ch, arg_max(c.rank, (CASE WHEN p.step = 0 THEN c.near ELSE round(0.7 * c.near - 0.3 * list_max(list_transform(p.ch, lambda j: c.s[j])), 9) END, -c.rank)) AS r FROM pick p JOIN cs c ON c.lang = p.lang AND NOT list_contains(p.ch, c.rank) WHERE p.step < 10 GROUP BY ALL)),
 best AS (SELECT lang, unnest(ch) AS r, unnest(range(1, len(ch) + 1)) AS rank FROM pick QUALIFY step = max(step) OVER (PARTITION BY lang))"""


@query(f"WITH RECURSIVE {SQL_MMR} SELECT b.lang, b.rank::BIGINT AS rank, c.term FROM best b JOIN cand c ON c.lang = b.lang AND c.rank = b.r")
def v14_mmr_words(spark, d):
    """The ten words of each language that are near to its thirty best, and not to each other."""
    docs = written(_words(spark, d), "mmr_docs")
    counts = docs.select("lang", F.explode("w").alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    best = written(topics.class_tfidf(written(counts, "mmr_counts"), "lang", top=30), "mmr_words")
    return topics.diversified(best, topics.word_vectors(docs.filter("w is not null"), "w", best), ["lang"]).select("lang", F.col("rank").cast("long").alias("rank"), "term")


# ---- tests of independence ------------------------------------------------------------------
#: The upper tail of chi-square by the series of the lower one, all of whose terms are positive.
SQL_PVALUE = "CASE WHEN gl > 0 THEN greatest(0, 1 - list_sum(list_transform(range(0, 400 + ceil(chi2)::INT), lambda i: exp(-chi2 / 2 + (gl / 2.0 + i) * ln(chi2 / 2) - lgamma(gl / 2.0 + i + 1))))) END"
SQL_GRID = "n AS (SELECT {by} sum(c) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS k FROM c {group}), ra AS (SELECT {by} a, sum(c) AS s FROM c GROUP BY ALL), rb AS (SELECT {by} b, sum(c) AS s FROM c GROUP BY ALL)"


@query("WITH c AS (SELECT lang a, source b, count(*)::DOUBLE c FROM documents GROUP BY ALL), " + SQL_GRID.format(by="", group="") + ", g AS (SELECT ra.s * rb.s / n AS e, coalesce(c.c, 0) AS o, n, r, k FROM ra CROSS JOIN rb CROSS JOIN n LEFT JOIN c ON c.a = ra.a AND c.b = rb.b), x AS (SELECT sum((o-e)*(o-e)/e) AS chi2, ((max(r)-1)*(max(k)-1))::BIGINT AS gl FROM g) SELECT gl, round(" + SQL_PVALUE + ", 9) AS p FROM x")
def m16_p_value(spark, d):
    return stats.chi_square(table(spark, d, "documents"), "lang", "source").select("gl", F.round("p", 9).alias("p"))


@query("WITH c AS (SELECT source AS g, lang AS a, n_chars > 1500 AS b, count(*)::DOUBLE AS c FROM documents GROUP BY ALL), " + SQL_GRID.format(by="g,", group="GROUP BY g") + ", e AS (SELECT ra.g, ra.s * rb.s / n AS e, coalesce(c.c, 0) AS o, r, k FROM ra JOIN rb USING (g) JOIN n USING (g) LEFT JOIN c ON c.g = ra.g AND c.a = ra.a AND c.b = rb.b), x AS (SELECT g, sum((o-e)*(o-e)/e) AS chi2, ((max(r)-1)*(max(k)-1))::BIGINT AS gl FROM e GROUP BY g), q AS (SELECT g, gl, " + SQL_PVALUE + " AS p FROM x), rk AS (SELECT *, row_number() OVER (ORDER BY p, g) AS i, count(*) OVER () AS m FROM q WHERE p IS NOT NULL) SELECT g AS source, gl, round(p, 9) AS p, round(least(1.0, min(m * p / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS p_adj FROM rk")
def m16_m17_by_source(spark, d):
    """Of each source, whether language and length go together; p-values adjusted over all."""
    docs = table(spark, d, "documents").select("source", "lang", (F.col("n_chars") > 1500).alias("largo"))
    tests = stats.chi_square(docs, "lang", "largo", "source").filter("p is not null")
    return stats.benjamini_hochberg(tests, "p").select("source", "gl", F.round("p", 9).alias("p"), F.round("p_adj", 9).alias("p_adj"))


def _boot_sql(statistic: str, by: str = "") -> str:
    """The draws of :func:`stats.bootstrap` over quality and toxic, each c below 32 by the sum
    of its Poisson distribution function."""
    h = "md5('42|' || {}y || '|' || g || '|' || draw)".format(f"{by} || '|' || " if by else "")
    part = "((('0x' || substr(h, {}, 8))::BIGINT + 0.5) / 4294967296)"
    return f"""WITH c AS (SELECT {by + ',' if by else ''} quality AS y, toxic AS g, count(*)::DOUBLE AS c FROM {{}} GROUP BY ALL), r AS (SELECT unnest(range(1, 2001)) AS draw), h AS (SELECT *, {h} AS h FROM c CROSS JOIN r), u AS (SELECT *, {part.format(1)} AS u, {part.format(9)} AS v FROM h),
 w AS (SELECT *, CASE WHEN c >= 32 THEN greatest(0, round(c + sqrt(c) * sqrt(-2 * ln(u)) * cos(2 * pi() * v))) ELSE list_sum(list_transform(range(0, 128), lambda i: (u > list_sum(list_transform(range(0, i + 1), lambda j: exp(-c + j * ln(c) - lgamma(j + 1)))))::INT)) END AS w FROM u),
 s AS (SELECT {by + ',' if by else ''} draw, {statistic} AS s FROM w GROUP BY ALL) SELECT {by + ',' if by else ''} round(quantile_cont(s, 0.025), 6) AS lo, round(quantile_cont(s, 0.975), 6) AS hi FROM s WHERE s IS NOT NULL {'GROUP BY ' + by if by else ''}"""


_SQL_KAPPA = "CASE WHEN sum(w) > 0 THEN (sum(w * (y = g)::INT) / sum(w) - (sum(w*y)*sum(w*g) + (sum(w)-sum(w*y))*(sum(w)-sum(w*g))) / (sum(w)*sum(w))) / nullif(1 - (sum(w*y)*sum(w*g) + (sum(w)-sum(w*y))*(sum(w)-sum(w*g))) / (sum(w)*sum(w)), 0) END"


@query(_boot_sql(_SQL_KAPPA).format("labels"))
def m18_kappa_interval(spark, d):
    return stats.bootstrap(table(spark, d, "labels"), ["quality", "toxic"], stats.weighted_kappa("quality", "toxic")).select(r6("lo").alias("lo"), r6("hi").alias("hi"))


@query(_boot_sql("2 * sum(w * y * g) / nullif(sum(w * (y + g)), 0)", by="lang").format("(SELECT lang, quality, toxic FROM labels JOIN documents USING (doc_id))"))
def m18_f1_interval(spark, d):
    """The interval of F1 in each language."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return stats.bootstrap(rows, ["quality", "toxic"], stats.weighted_f1("quality", "toxic"), by=["lang"]).select("lang", r6("lo").alias("lo"), r6("hi").alias("hi"))


# ---- the exercise and its audit -------------------------------------------------------------
SQL_FORMS = "ev AS (SELECT event_id, ts, CASE user_id % 3 WHEN 0 THEN 'Ubaté' WHEN 1 THEN 'Soacha' ELSE 'Ubaté Norte' END AS unidad, CASE WHEN user_id % 3 = 1 THEN event_type WHEN user_id % 5 = 0 THEN ' ' ELSE 'Vida' END AS forma FROM events), mine AS (SELECT *, strftime(ts, '%Y-%m-%d') AS dia FROM ev WHERE contains(lower(strip_accents(unidad)), 'ubate')), x AS (SELECT *, dia IN ('2024-01-05', '2024-01-06') AS en, event_id IN (7, 8, 9) AS id FROM mine)"


def _exercise(spark, d):
    e = table(spark, d, "events")
    unit = F.when(F.col("user_id") % 3 == 0, "Ubaté").when(F.col("user_id") % 3 == 1, "Soacha").otherwise("Ubaté Norte")
    form = F.when(F.col("user_id") % 3 == 1, F.col("event_type")).when(F.col("user_id") % 5 == 0, " ").otherwise("Vida")
    rows = e.select("event_id", "ts", unit.alias("unidad"), form.alias("forma"))
    return survey.audited_exercise(rows, "Ubaté", "Vida", ["2024-01-05", "2024-01-06"], [7, 8, 9], unit_col="unidad", form_col="forma", id_col="event_id")


@query(f"WITH {SQL_FORMS} SELECT event_id, forma FROM x WHERE en OR id")
def p01_audited_rows(spark, d):
    return _exercise(spark, d).rows.select("event_id", "forma")


@query(f"WITH {SQL_FORMS} SELECT event_id, dia, id AS incluida, (SELECT count(*) FROM x WHERE en OR id) AS filas, (SELECT count(*) FROM x WHERE (en OR id) AND trim(forma) = '') AS vacias, (SELECT count(*) FROM x WHERE id AND NOT en) AS tarde_dentro, (SELECT count(*) FROM x WHERE NOT id AND NOT en) AS tarde_fuera FROM x WHERE NOT en")
def p01_audit(spark, d):
    """Rows of other days, beside the counts that the filtering pass took."""
    e = _exercise(spark, d)
    r = e.report
    return e.late.select("event_id", F.col("day").alias("dia"), F.col("included").alias("incluida"), *(F.lit(r[k]).cast("long").alias(c) for k, c in (("rows", "filas"), ("blank_form", "vacias"), ("late_included", "tarde_dentro"), ("late_left_out", "tarde_fuera"))))


# ---- scoring and the store -------------------------------------------------------------------
def _ask():
    """The lexical scorer, asked for one text."""
    import re

    def ask(t):
        words = re.findall(r"[^\W\d_]+", t.lower())
        return {name: min(1.0, sum(w in kw for w in words) / 3.0) for name, kw in THEMES}

    return ask


@query(f"SELECT sha256('m1' || chr(31) || text || chr(31) || 'q') AS clave, list_max(list_transform([{', '.join('[' + ', '.join(repr(k) for k in kw) + ']' for _, kw in THEMES)}], lambda kw: round(least(1.0, len(list_filter(regexp_extract_all(lower(any_value(text)), '\\p{{L}}+'), lambda w: list_contains(kw, w))) / 3.0), 6))) AS mejor, 5 AS temas, 1 AS llamadas FROM documents WHERE ({SQL_NOISE}) IS NULL GROUP BY text")
def c02_c04_scored(spark, d):
    """Each different text asked once by bounded calls, then the gate."""
    texts = comments(spark, d).select(themes.cache_key("m1", F.col("text"), "q").alias("clave"), "text")
    done = scoring.with_second_pass(texts, _ask(), "clave", "text", wait=0.01)
    passed = scoring.complete_or_stop(texts, done, "clave", NAMES)
    calls = done.groupBy("clave").agg(F.max("calls").alias("llamadas"))
    return passed.groupBy("clave").agg(r6(F.max("p")).alias("mejor"), F.count("*").cast("int").alias("temas")).join(calls, "clave")


def _measures():
    """A stand-in for an encoder: counts of characters, words and different words."""

    def encode(texts):
        return [[len(t), len(t.split(" ")), len(set(t.split(" ")))] for t in texts]

    return encode


@query("WITH u AS (SELECT text, bool_or(doc_id IN (SELECT doc_id FROM labels)) AS antes FROM documents WHERE text IS NOT NULL GROUP BY text) SELECT sha256('e1' || chr(31) || text) AS clave, CASE WHEN antes THEN 0 ELSE 1 END::BIGINT AS corrida, length(text)::DOUBLE AS letras, len(string_split(text, ' '))::DOUBLE AS palabras, len(list_distinct(string_split(text, ' ')))::DOUBLE AS distintas FROM u")
def k02_v01_store(spark, d):
    """A store of vectors over three runs: labelled texts, then all, then all again, of which
    the last has nothing to encode.  Each key comes with the run that encoded it."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", flow.text_key("e1", F.col("text")).alias("clave"), "text")
    store = Store(spark, f"{folder(spark)}/store-{uuid.uuid4().hex}", "clave", "clave string, v array<double>")
    for texts in (docs.join(table(spark, d, "labels"), "doc_id", "left_semi"), docs, docs):
        encode_missing(store, texts.select("clave", "text"), _measures(), "text", "v")
    return store.generations().select("clave", F.col("generation").alias("corrida"), *(F.col("v")[i].alias(c) for i, c in enumerate(("letras", "palabras", "distintas"))))
