"""Tables of the census, discovery, combined and topic-model reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from .topics import stability_level

WITHOUT = "(sin tema específico)"


def _map(of: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in of.items() for x in kv))


def ranked_themes(scores: DataFrame, key: str, tau: float) -> DataFrame:
    """``(key, best, themes)``: of each comment its highest probability, and its themes
    ``(tema, p)`` from ``tau`` on, by falling probability (ties: list order)."""
    each = scores.groupBy(key).agg(F.max("p").alias("best"), F.array_sort(F.collect_list(F.when(F.col("p") >= tau, F.struct((-F.col("p")).alias("minus"), "ord", "tema", "p")))).alias("t"))
    return each.select(key, "best", F.transform("t", lambda x: F.struct(x["tema"].alias("tema"), x["p"].alias("p"))).alias("themes"))


def front_table(judged: DataFrame, facts: DataFrame, key: str, fronts: dict[str, str], parent: dict[str, str], tau: float, top: int = 5) -> DataFrame:
    """``(frente, n, share, lo, hi, confianza, principales, share_principal, temas)`` of each
    front, and of ``ninguna``, which only has comments whose main front it is.  ``fronts``
    names the column of each front's probability; ``temas`` its most frequent themes."""
    n = judged.agg(F.count("*").alias("all"))
    each = F.array(*(F.struct(F.lit(f).alias("frente"), F.col(c).alias("p")) for f, c in fronts.items()))
    got = judged.select(F.inline(each)).filter(F.col("p") >= tau).groupBy("frente").agg(F.count("*").alias("n"), F.avg("p").alias("confianza"))
    main = judged.groupBy(F.col("principal").alias("frente")).agg(F.count("*").alias("principales"))
    sizes = facts.groupBy(_map(parent)[F.col("tema")].alias("frente"), "tema").agg(F.count_distinct(key).alias("k"))
    rank = F.row_number().over(Window.partitionBy("frente").orderBy(F.desc("k"), "tema"))
    named = sizes.withColumn("r", rank).filter(F.col("r") <= top).groupBy("frente").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "tema", "k"))), lambda x: F.concat(x["tema"], F.lit(" ("), x["k"].cast("string"), F.lit(")"))), ", ").alias("temas"))
    spark = judged.sparkSession
    every = spark.createDataFrame([(f,) for f in (*fronts, "ninguna")], "frente string")
    rows = every.join(got, "frente", "left").join(main, "frente", "left").join(named, "frente", "left").join(F.broadcast(n))  # n is one row
    k = F.when(F.col("frente") != "ninguna", F.coalesce("n", F.lit(0)))
    lo, hi = stats.wilson(k, F.col("all"))
    first = F.coalesce("principales", F.lit(0))
    return rows.select("frente", k.alias("n"), (k / F.col("all")).alias("share"), lo.alias("lo"), hi.alias("hi"), "confianza", first.alias("principales"), (first / F.col("all")).alias("share_principal"), F.coalesce("temas", F.lit("")).alias("temas"))


def comment_table(judged: DataFrame, ranked: DataFrame, key: str, fronts: dict[str, str], parent: dict[str, str], tau: float) -> DataFrame:
    """A comment a row: its best theme and confidence, the other themes and fronts with
    theirs, the main front, and whether and why it should be looked at again."""
    of = _map(parent)
    label = lambda x: F.concat(of[x["tema"]], F.lit(" · "), x["tema"])
    others = F.array_join(F.transform(F.slice("themes", 2, 99), lambda x: F.concat(label(x), F.lit(" ("), T.percent_label(x["p"]), F.lit(")"))), "; ")
    also = F.array_compact(F.array(*(F.when((F.col(c) >= tau) & (F.col("principal") != f), F.concat(F.lit(f + " ("), T.percent_label(F.col(c)), F.lit(")"))) for f, c in fronts.items())))
    first = F.get("themes", F.lit(0))
    return judged.join(ranked, key).select(
        key, F.when(F.size("themes") > 0, label(first)).otherwise(WITHOUT).alias("tema_principal"), F.when(F.size("themes") > 0, first["p"]).otherwise(F.col("best")).alias("p"),
        F.when(F.size("themes") > 1, others).otherwise("").alias("otros"), "principal", F.array_join(also, "; ").alias("tambien"), F.when(F.col("motivo") != "", "Sí").otherwise("No").alias("revisar"), "motivo",
    )


def long_table(ranked: DataFrame, key: str, parent: dict[str, str]) -> DataFrame:
    """A row for each theme of a comment with its rank, and one without rank for a comment
    that has none, with the probability that came nearest."""
    some = ranked.select(key, F.posexplode("themes").alias("at", "x")).select(key, (F.col("at") + 1).alias("orden"), _map(parent)[F.col("x.tema")].alias("frente"), "x.tema", "x.p")
    none = ranked.filter(F.size("themes") == 0).select(key, F.lit(None).cast("int").alias("orden"), F.lit("").alias("frente"), F.lit(WITHOUT).alias("tema"), F.col("best").alias("p"))
    return some.unionByName(none)


def probability_table(judged: DataFrame, key: str, nouls: str, names: list[str], others: dict[str, str]) -> DataFrame:
    """A comment a row with a column for the probability of each theme and each of ``others``."""
    return judged.select(key, *(F.try_element_at(F.col(nouls), F.lit(t)).alias(f"p_{t}") for t in names), *(F.col(c).alias(f"p_{n}") for n, c in others.items()))


def contentless_table(excluded: DataFrame, judged: DataFrame, key: str, reason: str, p: str, tau: float) -> DataFrame:
    """Answers without content: those of the noise rules with their reason, and those that the
    classifier holds to be so, with its confidence."""
    rule = F.when(F.col(reason) == "vacio", "Sin comentario").otherwise(F.concat(F.lit("Excluido: "), F.col(reason)))
    by_p = F.concat(F.lit("Sin contenido evaluable ("), T.percent_label(F.col(p)), F.lit(")"))
    return excluded.select(key, rule.alias("motivo")).unionByName(judged.filter(F.col(p) >= tau).select(key, by_p.alias("motivo")))


def index_table(comments: DataFrame, long: DataFrame, wide: DataFrame, nothing: DataFrame) -> DataFrame:
    """``(hoja, filas, confianza, revisar)`` of the four tables."""
    lone = lambda df, name: df.agg(F.lit(name).alias("hoja"), F.count("*").alias("filas"), F.lit(None).cast("double").alias("confianza"), F.lit(None).cast("long").alias("revisar"))
    first = comments.agg(F.lit("Comentarios").alias("hoja"), F.count("*").alias("filas"), F.avg("p").alias("confianza"), F.count_if(F.col("revisar") == "Sí").alias("revisar"))
    return first.unionByName(lone(long, "Temas_por_comentario")).unionByName(lone(wide, "Detalle_probabilidades")).unionByName(lone(nothing, "Sin_contenido"))


# ---- the combined flow ------------------------------------------------------------------------
def combined_table(hard: DataFrame, facts: DataFrame, key: str, topic: str, *keep: str) -> DataFrame:
    """A comment a row: its one topic, its themes, and whether the topic is among them."""
    sets = facts.groupBy(key).agg(F.array_sort(F.collect_set("tema")).alias("_t"))
    rows = hard.join(sets, key, "left")
    hit = F.when(F.col("_t").isNull(), "sin tema").when(F.array_contains("_t", F.col(topic)), "Sí").otherwise("No")
    return rows.select(key, *keep, topic, F.coalesce(F.array_join("_t", ", "), F.lit("")).alias("temas"), hit.alias("coincide"))


def combined_summary(combined: DataFrame, facts: DataFrame, key: str, *by: str) -> DataFrame:
    """Of each group: comments, themes assigned to them, comments without one, and the share
    whose topic is among its themes."""
    n = combined.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("coincide") == "sin tema").alias("sin_tema"), F.avg((F.col("coincide") == "Sí").cast("int")).alias("acuerdo"))
    given = facts.join(combined.select(key, *by), key).groupBy(*by).agg(F.count("*").alias("asignaciones"))
    return n.join(given, list(by), "left").na.fill(0, ["asignaciones"])


# ---- discovery and run ------------------------------------------------------------------------
def discovery_tables(sizes: DataFrame, n: DataFrame, growth: DataFrame, overlaps: DataFrame, batch: int) -> DataFrame:
    """``(tabla, clave, n, valor, lo, hi)``: the share of each theme with its interval, new and
    all themes after each batch, and pairs of themes that share comments."""
    none = F.lit(None).cast("double")
    lo, hi = stats.wilson(F.col("n"), F.col("all"))
    freq = sizes.join(F.broadcast(n)).select(F.lit("frecuencia").alias("tabla"), F.col("tema").alias("clave"), "n", (F.col("n") / F.col("all")).alias("valor"), lo.alias("lo"), hi.alias("hi"))  # n is one row
    grow = growth.select(F.lit("saturacion").alias("tabla"), F.col("batch").cast("string").alias("clave"), F.col("new").alias("n"), F.col("total").cast("double").alias("valor"), none.alias("lo"), none.alias("hi"))
    pair = overlaps.filter("`both` > 0").select(F.lit("traslape").alias("tabla"), F.concat_ws("~", "a", "b").alias("clave"), F.col("both").alias("n"), F.col("jaccard").alias("valor"), none.alias("lo"), none.alias("hi"))
    return freq.unionByName(grow).unionByName(pair)


def run_counts(judged: DataFrame) -> DataFrame:
    """``(tabla, clave, n)``: main fronts, themes, and reasons to look again."""
    main = judged.groupBy(F.lit("principal").alias("tabla"), F.col("principal").alias("clave")).agg(F.count("*").alias("n"))
    theme = judged.select(F.explode("temas").alias("clave")).groupBy(F.lit("tema").alias("tabla"), "clave").agg(F.count("*").alias("n"))
    why = judged.select(F.explode(F.split("motivo", "; ")).alias("clave")).filter("clave <> ''").groupBy(F.lit("motivo").alias("tabla"), "clave").agg(F.count("*").alias("n"))
    return main.unionByName(theme).unionByName(why)


# ---- topic models -----------------------------------------------------------------------------
def group_summary(groups: DataFrame, curve: DataFrame, chosen: DataFrame, density: DataFrame, group: str, least: int = 20) -> DataFrame:
    """A group a row: its size, whether and why not it is modelled, and of the chosen k the
    stability, diagnostics and the density reference.  ``groups(group, n)``; ``chosen(group, k)``."""
    best = curve.join(chosen, [group, "k"]).drop("n")
    rows = groups.join(best, group, "left").join(density.select(group, F.col("clusters").alias("densidad"), F.col("outliers").alias("sin_tema")), group, "left")
    why = F.when(F.col("n") < least, f"No: menos de {least} comentarios").when(F.col("k").isNull(), "No: ningún k deja temas del tamaño mínimo").otherwise("Sí")
    return rows.withColumn("modelado", why).withColumn("nivel", F.when(F.col("k").isNotNull(), stability_level(F.col("stability"))))
