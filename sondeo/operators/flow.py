"""Reports, gates and comparisons of the survey flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..sources.tables import written
from .scoring import incomplete  # noqa: F401  (the gate of with_retry)
from .themes import GENERAL, OUTSIDE, TAU, plug_in_scores, row, two_rater_tag, union_all


def _label(anchors: dict[str, str]) -> Column:
    out = F.col("componente")
    for k, v in anchors.items():
        out = F.when(F.col("componente") == k, v).otherwise(out)
    return out


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def theme_order(components: list[str]) -> list[Column]:
    """Listed components by place, then phrases of the document, general themes, others."""
    cls = F.when(F.col("componente").isin(*components), 0).when(F.col("componente") == GENERAL, 2).when(F.col("componente") == OUTSIDE, 3).otherwise(1)
    return [cls, F.array_position(_strings(components), F.col("componente"))]


def theme_report(themes: DataFrame, scores: DataFrame, key: str, components: list[str], anchors: dict[str, str], tau: float = TAU) -> DataFrame:
    """One row of each theme in report order: component, name, comments, share with its
    interval, mean confidence, the most confident comment; then the components without a
    theme, with zeros.  ``sin_tema`` is the number of comments without any theme."""
    facts = scores.filter(F.col("p") >= tau)
    total = scores.groupBy(key).agg(F.max((F.col("p") >= tau).cast("int")).alias("any")).agg(F.count("*").alias("all"), F.sum(1 - F.col("any")).alias("sin_tema"))
    g = facts.groupBy("tema").agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.max_by(F.struct(key, "p"), F.struct("p", -F.col(key))).alias("best"))
    rows = themes.join(g, "tema", "left").join(F.broadcast(total))  # total is one row
    n = F.coalesce("n", F.lit(0))
    lo, hi = stats.wilson(n, F.col("all"))
    also = F.when(F.size("otros") > 0, F.concat(F.lit(" (también: "), F.array_join("otros", "; "), F.lit(")"))).otherwise("")
    order = F.row_number().over(Window.orderBy(*theme_order(components), F.desc("k"), "ord"))  # at most ten themes
    out = rows.select(
        "ord", "componente", F.concat(_label(anchors), also).alias("de"), F.col("nombre").alias("tema"), n.alias("k"), F.round(n / F.col("all"), 6).alias("share"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"),
        F.round("mp", 6).alias("mean_p"), F.col(f"best.{key}").alias("best"), T.percent_label(F.col("best.p")).alias("best_p"), "sin_tema",
    )
    out = out.withColumn("orden", order.cast("long")).select("orden", F.col("de").alias("componente"), "tema", F.col("k").alias("n"), "share", "lo", "hi", "mean_p", "best", "best_p", "sin_tema")
    used = themes.agg(F.count("*").alias("themes"), F.array_union(F.collect_set("componente"), F.flatten(F.collect_list("otros"))).alias("used"))
    none = lambda kind: F.lit(None).cast(kind)
    empty = used.select("themes", F.posexplode(F.array_except(_strings(components), "used")).alias("i", "componente")).join(F.broadcast(total.select("sin_tema")))
    zero = empty.select((F.col("themes") + F.col("i") + 1).alias("orden"), "componente", F.lit("(ningún comentario)").alias("tema"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("share"), *(none("double").alias(c) for c in ("lo", "hi", "mean_p")), none("long").alias("best"), none("string").alias("best_p"), "sin_tema")
    return out.unionByName(zero)


def classification_report(docs: DataFrame, scores: DataFrame, themes: DataFrame, key: str, names: list[str], anchors: dict[str, str], tau: float = TAU) -> DataFrame:
    """Every row of ``docs(key, motivo, ...)`` with its main theme (or why it has none), its
    component and confidence, and one column of each theme that is null below ``tau``.  The
    scores of a row become one row by one aggregation."""
    top = F.max_by(F.struct("tema", "p"), F.struct("p", -F.col("ord")))
    wide = scores.groupBy(key).agg(top.alias("b"), *(F.max(F.when((F.col("tema") == t) & (F.col("p") >= tau), F.round("p", 6))).alias(t) for t in names))
    listed = F.broadcast(themes.select("tema", "nombre", "componente"))  # at most ten themes
    wide = wide.select(key, F.col("b.tema").alias("tema"), F.col("b.p").alias("p"), *names).join(listed, "tema", "left")
    name = F.col("nombre")
    main = F.when(F.col("motivo") == "vacio", "(sin comentario)").when(F.col("motivo").isNotNull(), F.concat(F.lit("(sin contenido: "), "motivo", F.lit(")"))).when(F.col("p") >= tau, name).otherwise(F.concat(F.lit("Sin tema asignado (más cercano: "), name, F.lit(")")))
    component = F.when(F.col("p") >= tau, _label(anchors)).otherwise("")
    keep = [c for c in docs.columns if c != "motivo"]
    return docs.join(wide, key, "left").select(*keep, main.alias("principal"), component.alias("componente"), F.round("p", 6).alias("confianza"), *names)


# ---- topic lists ---------------------------------------------------------------------------
def signatures(words: DataFrame, group: str) -> DataFrame:
    """``(group, firma, palabras)``: the first five words as a signature, all as a list."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"])
    return words.groupBy(group).agg(listed.alias("palabras")).withColumn("firma", T.signature("palabras"))


def readable_names(model: DataFrame, saved: DataFrame, group: str) -> DataFrame:
    """A topic's saved name while its signature is still the model's, else its first words."""
    first = F.array_join(F.slice("palabras", 1, 3), ", ")
    words = F.concat(F.upper(F.substring(first, 1, 1)), F.expr("substring(array_join(slice(palabras, 1, 3), ', '), 2)"))
    rows = model.join(saved.select(group, "nombre", F.col("firma").alias("vieja")), group, "left")
    return rows.select(group, F.when(F.col("vieja") == F.col("firma"), F.col("nombre")).otherwise(words).alias("nombre"))


def topic_list_violations(saved: DataFrame, model: DataFrame, group: str) -> DataFrame:
    """Names that are empty, topics that are missing or unknown, signatures that changed."""
    both = saved.join(model.select(group, F.col("firma").alias("nueva")), group)
    return union_all([
        row(saved.filter("nombre = ''"), "empty_field", F.col(group), F.lit("nombre")),
        row(model.join(saved, group, "left_anti"), "missing_topic", F.col(group), F.lit("")),
        row(saved.join(model, group, "left_anti"), "unknown_topic", F.col(group), F.lit("")),
        row(both.filter("firma <> nueva"), "signature", F.col(group), F.col("firma")),
    ])


def origin_violations(themes: DataFrame, expected: DataFrame) -> DataFrame:
    """``themes(tema, origen array of (grupo, n))`` must cover each expected topic once."""
    used = themes.select(F.inline("origen"))
    name = F.concat_ws(":", "grupo", F.col("n").cast("string"))
    return union_all([
        row(used.groupBy("grupo", "n").agg(F.count("*").alias("k")).filter("k > 1"), "covered_twice", name, F.col("k")),
        row(expected.join(used, ["grupo", "n"], "left_anti"), "not_covered", name, F.lit("")),
        row(used.join(expected, ["grupo", "n"], "left_anti").distinct(), "unknown_topic", name, F.lit("")),
    ])


def base_models(groups: DataFrame) -> DataFrame:
    """``groups(id, parent, modelado)`` with ``base``: a group's own model, or its parent's
    where it has none."""
    return groups.withColumn("base", F.when(F.col("modelado"), F.col("id")).otherwise(F.col("parent")))


def by_size(rows: DataFrame, label: str) -> DataFrame:
    """``(label, n, tema)``: labels numbered from 0 by falling size, ties by name."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    return n.withColumn("tema", (F.row_number().over(Window.orderBy(F.desc("n"), label)) - 1).cast("long"))  # one row a label


def topic_table(rows: DataFrame, words: DataFrame, label: str, top: int = 8) -> DataFrame:
    """``(tema, label, n, total, palabras)`` of each topic of a final model."""
    listed = signatures(words, label).select(label, F.array_join(F.slice("palabras", 1, top), ", ").alias("palabras"))
    total = rows.agg(F.count("*").alias("total"))
    return by_size(rows, label).join(listed, label).join(F.broadcast(total))  # total is one row


# ---- gates ---------------------------------------------------------------------------------
def coherence_violations(scores: DataFrame, facts: DataFrame, items: DataFrame, cube: DataFrame, themes: DataFrame, reviewed: DataFrame, key: str, dims: list[str]) -> DataFrame:
    """Themes without a probability, rows or cells that don't add up, zero cells that nobody
    has reviewed, and themes (but critical ones) with under three comments."""
    from .survey import zero_cells

    n = items.agg(F.count("*").alias("all"))
    rows = scores.agg(F.count_distinct(key).alias("n")).join(n).filter(F.col("n") != F.col("all"))
    counted = items.groupBy(*dims).agg(F.count("*").alias("n"))
    cells = cube.groupBy(*dims).agg(F.max("total").alias("total")).join(counted, dims, "left").filter(F.col("total") != F.coalesce("n", F.lit(0)))
    weight = facts.groupBy("tema").agg(F.count("*").alias("k")).join(n).select("tema", (100.0 * F.col("k") / F.col("all")).alias("weight"))
    zero = zero_cells(cube, weight, "tema").join(reviewed, [*dims, "tema"], "left_anti")
    sizes = themes.filter(~F.col("critico")).join(facts.groupBy("tema").agg(F.count("*").alias("n")), "tema", "left").na.fill(0, ["n"])
    return union_all([
        row(scores.filter("p is null").groupBy("tema").agg(F.count("*").alias("n")), "no_probability", F.col("tema"), F.col("n")),
        row(rows, "rows", F.lit("scores"), F.concat_ws("/", F.col("n").cast("string"), F.col("all").cast("string"))),
        row(cells, "cell_total", F.concat_ws("|", *dims), F.col("total")),
        row(zero, "zero_cell", F.concat_ws("|", *dims, "tema"), F.lit("")),
        row(sizes.filter("n < 3"), "too_small", F.col("tema"), F.col("n")),
    ])


def reconcile(docs: DataFrame, scores: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``(rule, a, b)``: two counts of each rule that an export must find equal."""
    pair = lambda df, rule, a, b: df.agg(a.cast("long").alias("a"), b.cast("long").alias("b")).select(F.lit(rule).alias("rule"), "a", "b")
    per = facts.groupBy("tema").agg(F.count("*").alias("n")).agg(F.sum("n").alias("b"))
    return union_all([
        facts.agg(F.count("*").alias("a")).join(per).select(F.lit("assignments").alias("rule"), "a", F.col("b").cast("long").alias("b")),
        pair(docs, "rows", F.count("*"), F.count_distinct(key)),
        pair(scores, "p_range", F.count_if((F.col("p") < 0) | (F.col("p") > 1)), F.lit(0)),
    ])


def zero_review(zero: DataFrame, reviewed: DataFrame, items: DataFrame, scores: DataFrame, key: str, dims: list[str]) -> DataFrame:
    """The comments of each zero cell that is not reviewed, by falling probability."""
    open_ = zero.join(reviewed, [*dims, "tema"], "left_anti").select(*dims, "tema")
    rows = items.join(open_, dims).join(scores.select(key, "tema", "p"), [key, "tema"])
    order = F.row_number().over(Window.partitionBy(*dims, "tema").orderBy(F.desc("p"), key)).cast("long")
    return rows.select(*dims, "tema", key, "p", order.alias("orden"))


# ---- answers -------------------------------------------------------------------------------
def answer_faults(nouls: str, choice: str, prob: str, conf: str, names: list[str], options: list[str]) -> Column:
    """What is wrong with an answer: its keys, a probability, the choice, the sum of its
    probabilities (each is rounded to two digits), the confidence."""
    slack = max(0.01, 0.005 * len(options)) + 1e-9
    total = F.aggregate(F.map_values(prob), F.lit(0.0), lambda a, x: a + x)
    keys = lambda c, want: F.array_sort(F.map_keys(c)) == F.array_sort(_strings(want))
    return F.array_compact(F.array(
        F.when(~keys(nouls, names), "claves"),
        F.when(~F.forall(F.map_values(nouls), lambda v: v.between(0, 1)), "rango"),
        F.when(~F.col(choice).isin(*options) | ~keys(prob, options), "opcion"),
        F.when(F.abs(total - 1) > slack, "suma"),
        F.when(~F.col(conf).between(0, 1), "confianza"),
    ))


def judge_answers(answers: DataFrame, nouls: str, fronts: dict[str, str], parent: dict[str, str], critical: list[str], tau: float = TAU, least: float = 0.5) -> DataFrame:
    """Answers with their themes, fronts and flags: residual (nothing above ``tau``),
    incoherent (a theme without its front, or a main front below ``tau``), and the reasons to
    look at them again, in fixed order."""
    over = F.array_compact(F.array(*(F.when(F.col(c) >= tau, f) for f, c in fronts.items())))
    of = F.create_map(*(F.lit(x) for kv in parent.items() for x in kv))
    parents = F.filter(F.array_distinct(F.transform("temas", lambda t: of[t])), lambda x: x != "fuera_del_marco")
    p_main = F.lit(0.0)
    for f, c in fronts.items():
        p_main = F.when(F.col("principal") == f, F.col(c)).otherwise(p_main)
    rows = answers.withColumns({"temas": F.map_keys(F.map_filter(nouls, lambda k, v: v >= tau)), "frentes": over})
    rows = rows.withColumn("pi", (F.col("principal") != "ninguna") & (p_main < tau))
    rows = rows.withColumns({"coherente": (F.size(F.array_except(parents, "frentes")) == 0) & ~F.col("pi"), "res": (F.size("temas") == 0) & (F.size("frentes") == 0) & (F.col("sin_contenido") < tau)})
    why = F.array_compact(F.array(
        F.when(F.col("res"), "residual"),
        F.when(~F.col("coherente"), "incoherente"),
        F.when(F.col("pi"), "principal_incoherente"),
        F.when(F.arrays_overlap("temas", _strings(critical)), "tema_critico"),
        F.when(F.col("conf_principal") < least, "baja_confianza_principal"),
        F.when(F.col("conf_tipo") < least, "baja_confianza_tipo"),
    ))
    return rows.select("*", F.col("res").cast("int").alias("residual"), (~F.col("coherente")).cast("int").alias("incoherente"), F.col("pi").cast("int").alias("principal_incoherente"), F.array_join(why, "; ").alias("motivo")).drop("res", "pi", "coherente")


def with_retry(texts: DataFrame, scorer, again, key: str, text: str) -> DataFrame:
    """Scores of all texts: those that fail are asked once more by ``again``.  A text that
    fails then too is a row with its error, which ``incomplete`` finds."""
    first = written(plug_in_scores(texts, scorer, key, text), "answers")  # read twice, asked once
    failed = texts.join(first.filter("error is not null").select(key).distinct(), key, "left_semi")
    return first.filter("error is null").unionByName(written(plug_in_scores(failed, again, key, text), "answers"))


def text_key(model: str, text) -> Column:
    """Hash of a model's name and a text."""
    return F.sha2(F.concat_ws("\x1f", F.lit(model), text), 256)


def cost(unique: DataFrame, tokens: str, price: float) -> DataFrame:
    """Texts, tokens and their price, which is that of a million tokens."""
    return unique.agg(F.count("*").alias("textos"), F.sum(tokens).cast("long").alias("tokens"), (F.sum(tokens) * price / 1e6).alias("costo"))


# ---- comparisons ---------------------------------------------------------------------------
def agreement(hard: DataFrame, facts: DataFrame, key: str, topic: str, *by: str) -> DataFrame:
    """Of each group, the share of comments whose one topic is among their themes."""
    sets = facts.groupBy(key).agg(F.collect_set("tema").alias("_t"))
    hit = F.coalesce(F.array_contains("_t", F.col(topic)), F.lit(False)).cast("int")
    return hard.join(sets, key, "left").groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit).alias("acuerdo"), F.count_if(F.col("_t").isNull()).alias("sin_tema"))


def compare_counts(left: DataFrame, right: DataFrame, key: str, *by: str) -> DataFrame:
    """``(by..., of left, of right, of both, tag)`` of two codings ``(key, by...)``."""
    a, b = left.distinct().withColumn("_a", F.lit(True)), right.distinct().withColumn("_b", F.lit(True))
    n = a.join(b, [key, *by], "full_outer").groupBy(*by).agg(F.count("_a").alias("l"), F.count("_b").alias("j"), F.count_if(F.col("_a") & F.col("_b")).alias("both"))
    return n.withColumn("tag", two_rater_tag(F.col("l"), F.col("j")))


def disagreements(reading: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Themes that only the reader, or only the classifier, gave to a comment."""
    both = reading.select(key, "tema", F.lit(True).alias("_l")).join(facts.select(key, "tema", F.lit(True).alias("_j")), [key, "tema"], "full_outer")
    return both.filter("_l is null or _j is null").select(key, "tema", F.when(F.col("_j").isNull(), "SOLO LECTURA").otherwise("SOLO JEV").alias("quien"))


def reading_report(reading: DataFrame, facts: DataFrame, themes: DataFrame, key: str) -> DataFrame:
    """``(tema, j, l, marca, micro_f1)``: counts of a reader and the classifier, a tag, and
    the agreement over all themes."""
    n = compare_counts(reading.select(key, "tema"), facts.select(key, "tema"), key, "tema")
    f1 = n.agg((2.0 * F.sum("both") / F.sum(F.col("l") + F.col("j"))).alias("micro_f1"))
    rows = themes.select("tema").join(n, "tema", "left").na.fill(0, ["l", "j"]).join(F.broadcast(f1))  # f1 is one row
    return rows.select("tema", "j", "l", two_rater_tag(F.col("l"), F.col("j")).alias("marca"), "micro_f1")


# ---- further reports -----------------------------------------------------------------------
def census_themes(themes: DataFrame, facts: DataFrame, n: DataFrame, key: str, seed: str, voices: int = 3) -> DataFrame:
    """Themes with their share, the share of comments that ask for something better, and the
    keys of some voices: first those that need no review, by falling confidence, ties at random."""
    order = Window.partitionBy("tema").orderBy("revisar", F.desc("p"), F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    first = facts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= voices).groupBy("tema").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(key).cast("string").alias("k")))), lambda x: x["k"]), ",").alias("voces"))
    g = facts.groupBy("tema").agg(F.count("*").alias("n"), F.avg(F.col("mejora").cast("int")).alias("mejora"))
    rows = themes.select("tema").join(g, "tema", "left").na.fill(0, ["n"]).join(first, "tema", "left").join(F.broadcast(n))  # n is one row
    return rows.select("tema", "n", (F.col("n") / F.col("all")).alias("share"), "mejora", "voces")


def role_matrix(cube: DataFrame, items: DataFrame, facts: DataFrame, key: str, dims: list[str], names: list[str]) -> DataFrame:
    """Of each cell its comments, the share of each theme, and the share without any."""
    wide = cube.groupBy(*dims).agg(F.max("total").alias("filas"), *(F.max(F.when(F.col("tema") == t, F.col("n"))).alias(t) for t in names))
    some = items.join(facts.select(key).distinct(), key, "left_semi").groupBy(*dims).agg(F.count("*").alias("some"))
    part = lambda x: F.round(x / F.when(F.col("filas") > 0, F.col("filas")), 6)
    return wide.join(some, dims, "left").select(*dims, "filas", *(part(F.col(t)).alias(t) for t in names), part(F.col("filas") - F.coalesce("some", F.lit(0))).alias("sin_tema"))


def discovery(themes: DataFrame, facts: DataFrame, items: DataFrame, key: str, parent: dict[str, str], outside: str) -> DataFrame:
    """``(tabla, clave, n, valor)``: comments of each theme, of any theme, of themes outside
    only, and of each parent with at least one of its themes."""
    n = items.agg(F.count("*").alias("all"))
    of = F.create_map(*(F.lit(x) for kv in parent.items() for x in kv))
    named = facts.join(themes.select("tema", (F.col("componente") == outside).alias("out")).distinct(), "tema", "left")
    each = named.groupBy(key).agg(F.bool_and(F.coalesce("out", F.lit(False))).alias("o"))
    rows = union_all([
        themes.select("tema").join(facts.groupBy("tema").agg(F.count("*").alias("n")), "tema", "left").select(F.lit("tema").alias("tabla"), F.col("tema").alias("clave"), F.coalesce("n", F.lit(0)).alias("n")),
        each.agg(F.count("*").alias("n")).select(F.lit("cobertura").alias("tabla"), F.lit("algun_tema").alias("clave"), "n"),
        each.agg(F.count_if("o").alias("n")).select(F.lit("cobertura").alias("tabla"), F.lit("solo_fuera").alias("clave"), "n"),
        facts.groupBy(of[F.col("tema")].alias("clave")).agg(F.count_distinct(key).alias("n")).select(F.lit("padre").alias("tabla"), "clave", "n"),
    ])
    return rows.join(F.broadcast(n)).withColumn("valor", F.col("n") / F.col("all"))  # n is one row


