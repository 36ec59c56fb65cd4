"""Theme scores, assignments and the checks on them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import record_batch, slices
from .survey import in_ranges

TAU = 0.70


def lexical_scores(texts: DataFrame, themes: list[tuple[str, list[str]]], text: str, *keep: str) -> DataFrame:
    """``(keep..., tema, ord, p)``: p grows with the keywords of a theme in the text, up to 1.
    A deterministic stand-in for a hosted classifier.  All words are looked at once; what is
    counted for each theme are those that are keywords of any."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0)
    known = sorted({k for _, kw in themes for k in kw})
    rows = texts.select(*keep, F.filter(words, lambda w: w.isin(*known)).alias("_w"))
    score = lambda kw: F.least(F.lit(1.0), F.size(F.filter("_w", lambda w: w.isin(*kw))) / 3.0)
    each = F.array(*(F.struct(F.lit(t).alias("tema"), F.lit(i).alias("ord"), score(kw).alias("p")) for i, (t, kw) in enumerate(themes)))
    return rows.select(*keep, F.inline(each))


def plug_in_scores(texts: DataFrame, scorer: Callable[[list[str]], Iterable[dict]], key: str, text: str) -> DataFrame:
    """``(key, tema, p, error)`` by any scorer of a batch of texts (up to 1,000, or 4 MB) that
    returns a mapping of theme to probability for each.  A batch that it fails on, or answers
    with another number of mappings, is asked text by text, and a text that fails alone is a
    row with its error.  For a scorer whose calls cost, see :mod:`scoring`."""

    def ask(some: list[str]) -> list[dict]:
        got = list(scorer(some))
        if len(got) != len(some):
            raise ValueError(f"{len(got)} answers for {len(some)} texts")
        return got

    def run(batches):
        for part in slices(batches, text):
            rows, asked = [], part[text].to_pylist()
            try:
                answers = [(a, None) for a in ask(asked)]
            except Exception:
                answers = []
                for t in asked:
                    try:
                        answers.append((ask([t])[0], None))
                    except Exception as e:
                        answers.append(({None: None}, str(e)))
            for k, (got, error) in zip(part[key].to_pylist(), answers):
                rows += [(k, t, None if p is None else float(p), error) for t, p in got.items()]
            yield record_batch(rows, {key: part.schema.field(key).type, "tema": pa.string(), "p": pa.float64(), "error": pa.string()})

    kind = dict(texts.dtypes)[key]
    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, tema string, p double, error string")


def cache_key(model: str, text, question: str):
    """Hash of exactly what a request sends."""
    return F.sha2(F.concat_ws("\x1f", F.lit(model), text, F.lit(question)), 256)


def latest(cache: DataFrame, key: str, order: str) -> DataFrame:
    """The last written row of each key."""
    others = [c for c in cache.columns if c != key]
    return cache.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r")).select(key, "_r.*")


def missing(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return wanted.join(cache.select(key), key, "left_anti")


def assign(scores: DataFrame, key: str, tau: float = TAU) -> DataFrame:
    """Themes with p >= tau, ranked in each row by p (ties: theme order)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("p"), "ord"))
    return scores.filter(F.col("p") >= tau).withColumn("rank", rank)


def principal(scores: DataFrame, key: str, tau: float = TAU) -> DataFrame:
    """The best theme of each row, or ``(cercano: theme)`` if it stays below tau."""
    best = scores.groupBy(key).agg(F.max_by(F.struct("tema", "p"), F.struct("p", -F.col("ord"))).alias("b"))
    return best.select(key, F.when(F.col("b.p") >= tau, F.col("b.tema")).otherwise(F.concat(F.lit("(cercano: "), F.col("b.tema"), F.lit(")"))).alias("principal"), F.col("b.p").alias("p"))


def overlaps(facts: DataFrame, key: str, themes: list[str]) -> DataFrame:
    """Jaccard of every pair of themes, pairs without a common row too."""
    n = facts.groupBy("tema").agg(F.count_distinct(key).alias("n"))
    f = facts.select(key, "tema").distinct()
    both = f.toDF(key, "a").join(f.toDF(key, "b"), key).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    spark = facts.sparkSession
    pairs = spark.createDataFrame([(a, b) for a in themes for b in themes if a < b], "a string, b string")
    out = pairs.join(both, ["a", "b"], "left").join(n.toDF("a", "na"), "a", "left").join(n.toDF("b", "nb"), "b", "left").na.fill(0)
    either = F.col("na") + F.col("nb") - F.col("both")
    return out.select("a", "b", "both", F.when(either > 0, F.col("both") / either).otherwise(0.0).alias("jaccard"))


def saturation(facts: DataFrame, order: str, theme: str, batch: int) -> DataFrame:
    """New and cumulative distinct themes by reading batch.  Batches are summed within ranges
    that hold about as many of them each, and offset by the totals of the ranges before."""
    first = facts.groupBy(theme).agg(F.min(order).alias("o"))
    new = first.groupBy(F.floor(F.col("o") / batch).alias("batch")).agg(F.count("*").alias("new"))
    seen = facts.select(F.floor(F.col(order) / batch).alias("batch")).distinct().join(new, "batch", "left").na.fill(0)
    seen = in_ranges(seen, "batch", seen, "_r")
    ranges = seen.groupBy("_r").agg(F.sum("new").alias("_n"))
    before = ranges.select("_r", (F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).alias("_before"))  # one row a range
    total = F.sum("new").over(Window.partitionBy("_r").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    return seen.join(before, "_r").select("batch", "new", total.alias("total"))


def two_rater_tag(reader, model):
    """How a model's count compares with a reader's, the first that holds."""
    return F.when((model >= 2 * reader) & (model - reader >= 8), "INFLADO").when((reader - model >= 4) & (model <= 0.5 * reader), "SUBDETECTADO").when(model - reader >= 8, "ALTO").otherwise("")


def row(df: DataFrame, rule: str, subject, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


GENERAL, OUTSIDE = "(general)", "(fuera)"


def valid_component(c, components: list[str], section: str):
    """General, outside, one of the components, or a phrase of eight characters of the section."""
    return c.isin(GENERAL, OUTSIDE, *components) | ((F.length(c) >= 8) & F.lit(section).contains(c))


def list_violations(themes: DataFrame, coding: DataFrame, items: DataFrame, key: str, components: list[str], section: str, most: int = 10, overlap: float = 0.5) -> DataFrame:
    """``(rule, subject, detail)`` of each rule that a theme list or its coding breaks.
    ``themes(tema, nombre, componente, otros, critico)``; ``coding(key, temas)``; a component
    is valid if it is general, outside, one of ``components`` or a phrase of the section.

    A theme needs 3 comments or 5 % of them, a general one or one of several small ones
    outside 2, a critical one none; only one theme outside may have under a tenth of them."""
    n = items.select(key).distinct().agg(F.count("*").alias("all"))
    facts = coding.select(key, F.explode("temas").alias("tema")).distinct().join(themes.select("tema"), "tema", "left_semi")
    sizes = facts.groupBy("tema").agg(F.count("*").alias("n"))
    sized = themes.join(sizes, "tema", "left").na.fill(0, ["n"]).join(F.broadcast(n))  # n is one row
    small = sized.filter((F.col("componente") == OUTSIDE) & (F.col("n") < F.ceil(F.col("all") * 0.10)))
    is_small = (F.col("componente") == OUTSIDE) & (F.col("n") < F.ceil(F.col("all") * 0.10))
    least = F.when(F.col("critico"), 0).when((F.col("componente") == GENERAL) | is_small, 2).otherwise(F.greatest(F.lit(3), F.ceil(F.col("all") * 0.05)))
    used = themes.select("tema", F.explode(F.concat(F.array("componente"), F.coalesce("otros", F.array().cast("array<string>")))).alias("c"))
    wrong = used.filter(~valid_component(F.col("c"), components, section))
    both = facts.toDF("tema", key).select(key, F.col("tema").alias("a")).join(facts.select(key, F.col("tema").alias("b")), key).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    pair = both.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").withColumn("j", F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))
    return union_all([
        row(themes.groupBy("tema").agg(F.count("*").alias("k")).filter("k > 1"), "repeated_id", F.col("tema"), F.col("k")),
        row(themes.filter("coalesce(trim(nombre), '') = ''"), "empty_field", F.col("tema"), F.lit("nombre")),
        row(wrong, "component", F.col("tema"), F.col("c")),
        row(themes.agg(F.count("*").alias("k")).filter(F.col("k") > most), "too_many", F.lit("list"), F.col("k")),
        row(coding.groupBy(key).agg(F.count("*").alias("k")).filter("k > 1"), "coded_twice", F.col(key), F.col("k")),
        row(items.join(coding, key, "left_anti"), "not_coded", F.col(key), F.lit("")),
        row(coding.join(items, key, "left_anti"), "unknown_item", F.col(key), F.lit("")),
        row(coding.select(F.explode("temas").alias("tema")).join(themes, "tema", "left_anti").distinct(), "unknown_theme", F.col("tema"), F.lit("")),
        row(small.agg(F.count("*").alias("k")).filter("k > 1"), "small_outside", F.lit("list"), F.col("k")),
        row(sized.filter(F.col("n") < least), "too_small", F.col("tema"), F.col("n")),
        row(pair.filter(F.col("j") > overlap), "overlap", F.concat_ws("~", "a", "b"), F.format_string("%.4f", "j")),
    ])
