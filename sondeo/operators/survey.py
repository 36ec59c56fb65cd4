"""Survey tables: filtering, cleaning, numbering, profiles."""

from __future__ import annotations

import re
import unicodedata
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.privacy import redact
from ..sources.tables import written


def exercise(df: DataFrame, unit: str | None, form: str, days: list[str], ids: list[int] = (), *, unit_col: str = "unit", form_col: str = "form", ts_col: str = "ts", id_col: str = "id", blank_ok: bool = False) -> DataFrame:
    """Rows of a unit (its slug contains the given one; None: all) and form (blank ones too,
    if ``blank_ok``) on given days, or with given ids."""
    keep = F.lit(True) if unit is None else T.slug_spaces(unit_col).contains(unit)
    own = F.col(form_col) == form
    if blank_ok:
        own = own | (F.coalesce(F.trim(form_col), F.lit("")) == "")
    return df.filter(keep & own & (F.date_format(ts_col, "yyyy-MM-dd").isin(*days) | F.col(id_col).isin(*ids)))


class ExerciseError(ValueError):
    """The rows don't say which of them an exercise is made of."""


@dataclass
class Exercise:
    """The rows of an exercise, those of its unit and form on other days (``included``: by
    their id), and counts of the filter."""

    rows: DataFrame
    late: DataFrame
    report: dict


def audited_exercise(df: DataFrame, unit: str | None, form: str, days: list[str], ids: list[int] = (), *, unit_col: str = "unit", form_col: str | None = "form", ts_col: str = "ts", id_col: str = "id") -> Exercise:
    """The exercise of a unit (its slug contains the given one; None: all) and form on given
    days, or with given ids, with its report.  Rows with a blank form belong to it if the unit has no
    other form; without a form column all rows do.

    The table is read once: what may belong to the exercise is written while the pass counts
    what decides.  :class:`ExerciseError` is raised if the unit has no rows, if it has other
    forms beside blank ones, if it has other forms but not this one, and if nothing is left."""
    slug = lambda c: F.coalesce(T.slug_spaces(c), F.lit(""))
    own_unit = F.lit(True) if unit is None else slug(F.col(unit_col)).contains(slug_text(unit))
    kind = slug(F.col(form_col)) if form_col else F.lit("")
    target = slug_text(form)
    day = F.date_format(ts_col, "yyyy-MM-dd")
    on_day, by_id = F.coalesce(day.isin(*days), F.lit(False)), F.coalesce(F.col(id_col).isin(*ids), F.lit(False))
    flags = df.withColumns({"_unit": own_unit, "_form": kind, "_day": day, "_on": on_day, "_id": by_id})
    mine = F.col("_unit") & F.col("_form").isin(target, "")
    kept = mine & (F.col("_on") | F.col("_id"))
    seen = Observation(f"exercise-{uuid.uuid4().hex}")
    counted = flags.observe(
        seen,
        F.count_if("_unit").alias("unit"), F.count_if(F.col("_unit") & (F.col("_form") == target)).alias("form"),
        F.count_if(F.col("_unit") & (F.col("_form") == "")).alias("blank"), F.count_if(F.col("_unit") & ~F.col("_form").isin(target, "")).alias("other"),
        F.count_if(kept & (F.col("_form") == target)).alias("kept"), F.count_if(kept & (F.col("_form") == "")).alias("kept_blank"),
        F.count_if(mine & ~F.col("_on") & F.col("_id")).alias("late_in"), F.count_if(mine & ~F.col("_on") & ~F.col("_id")).alias("late_out"),
    )
    stored = written(counted.filter(mine), "exercise")
    n = seen.get
    if not n["unit"]:
        raise ExerciseError(f"no rows of unit {unit!r}")
    if n["other"] and n["blank"]:
        raise ExerciseError(f"{n['other']} rows of other forms and {n['blank']} without a form: which form are these of?")
    if n["other"] and not n["form"]:
        raise ExerciseError(f"no rows of form {form!r} but {n['other']} of others")
    if not n["kept"] + n["kept_blank"]:
        raise ExerciseError("no rows on these days or with these ids")
    own = [c for c in df.columns]
    late = stored.filter(~F.col("_on")).select(F.col(id_col), F.col("_day").alias("day"), F.col("_id").alias("included"))
    report = {"rows": n["kept"] + n["kept_blank"], "blank_form": n["kept_blank"], "late_included": n["late_in"], "late_left_out": n["late_out"]}
    return Exercise(stored.filter(F.col("_on") | F.col("_id")).select(*(F.col(f"`{c}`") for c in own)), late, report)


def slug_text(name: str) -> str:
    """The slug of a parameter: accents off, lower case, white space as ``_``."""
    return re.sub(r"\s+", "_", unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower().strip())


def splitters(values: DataFrame, x: str, ranges: int = 256) -> DataFrame:
    """One row ``_cuts``: up to ``ranges`` - 1 values that part the rows into about equal runs."""
    at = [i / ranges for i in range(1, ranges)]
    return values.agg(F.array_distinct(F.percentile_approx(x, at, 100 * ranges)).alias("_cuts"))


def in_ranges(rows: DataFrame, x: str, values: DataFrame, to: str, ranges: int = 256) -> DataFrame:
    """``rows`` with ``to``, the number of the range that ``x`` lies in, for ranges that hold
    about as many of ``values`` each, however these are spread."""
    cuts = F.broadcast(splitters(values, x, ranges))  # one row
    return rows.crossJoin(cuts).withColumn(to, F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(x))), F.lit(0))).drop("_cuts")


def clean_answers(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``motivo`` (why an answer is dropped, or null), ``excluido`` (0 or 1) and
    the redacted text of those that stay."""
    reason = T.noise_reason(text)
    return df.withColumn("motivo", reason).withColumn("excluido", F.col("motivo").isNotNull().cast("int")).withColumn("anon", F.when(F.col("excluido") == 0, redact(text)))


def unique_numbers(df: DataFrame, text: str, ordinal: str, form: str = "U%03d") -> DataFrame:
    """``(digest, id_texto_unico)``: texts, by their 256-bit digest, numbered by first
    appearance.  Numbers are counted within ranges of ordinals that hold about as many texts
    each and offset by the totals of the ranges before, so no task holds all texts and no
    text is shuffled."""
    first = df.filter(F.col(text).isNotNull()).groupBy(text_digest(text).alias("digest")).agg(F.min(ordinal).alias("_first"))
    first = in_ranges(first, "_first", first, "_range")
    sizes = first.groupBy("_range").count()
    before = sizes.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))  # one row a range
    at = F.row_number().over(Window.partitionBy("_range").orderBy("_first", "digest")) + F.col("_before")
    return first.join(before, "_range").select("digest", F.format_string(form, at.cast("long")).alias("id_texto_unico"))


def text_digest(text: str) -> Column:
    return F.sha2(F.col(text).cast("binary"), 256)


def without_empty_columns(df: DataFrame) -> DataFrame:
    """Columns with at least one value.  Which these are decides the schema, so one pass over
    the table runs at once; its counts come back as one row."""
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns)).first()
    return df.select(*(F.col(f"`{c}`") for c in df.columns if counts[c]))


def column_profile(df: DataFrame) -> DataFrame:
    """``(column, dtype, nulls, distinct)`` of every column, in one pass."""
    one = df.agg(*(F.struct(F.count_if(F.col(f"`{c}`").isNull()).alias("nulls"), F.count_distinct(F.col(f"`{c}`")).alias("distinct")).alias(c) for c in df.columns))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"`{c}`.nulls").alias("nulls"), F.col(f"`{c}`.distinct").alias("distinct")) for c, t in df.dtypes))
    return one.select(F.inline(each))


def allowed_columns(df: DataFrame, wanted: list[str], forbidden: set[str]) -> DataFrame:
    """The wanted columns that are there, never one whose normal name is forbidden."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c in wanted and c.lower().strip() not in forbidden))


def strict_lookup(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``keys`` joined with their rows; raises if one has none, so an action runs at once."""
    if keys.join(rows, key, "left_anti").take(1):
        raise KeyError(f"keys without a row: {key}")
    return keys.join(rows, key)


def name_tokens(df: DataFrame, name: str, least: int) -> DataFrame:
    """Different words of ``least`` letters or more, in normal form."""
    words = df.select(F.explode(T.letter_words(F.col(name), least)).alias("w")).distinct()
    return words.select(T.normalise(F.col("w")).alias("token")).distinct()


def sample_rows(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """``n`` rows in the order of a hash of seed and key: the same in every run."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


#: Phrases that are broadcast, with their words; more are shuffled.
MOST_PHRASES = 50_000


def containment(docs: DataFrame, phrases: DataFrame, key: str, phrase_key: str, text: str, width: int = 8) -> DataFrame:
    """``(key, phrase_key)`` of texts that hold a phrase of at least ``width`` characters.  A
    phrase's words but its first and last stand between spaces wherever the phrase does, so
    texts meet it by the one of these that the fewest texts have, and are then looked at whole;
    a phrase with a word that no text has is in none.  Phrases without such a word are met by
    their first ``width`` characters at any place.  Up to MOST_PHRASES phrases are broadcast,
    so only texts with a hit are shuffled."""
    phrases = phrases.select(phrase_key, F.col(text).alias("_p"), F.split(text, " ").alias("_all"))
    inner = F.array_distinct(F.filter("_all", lambda w, i: (i > 0) & (i < F.size("_all") - 1) & (w != "")))
    phrases = phrases.select(phrase_key, "_p", inner.alias("_inner"))
    few = phrases.count() <= MOST_PHRASES
    sent = F.broadcast if few else lambda df: df
    asked = phrases.select(phrase_key, F.explode("_inner").alias("_w"))
    words = docs.select(key, F.explode(F.array_distinct(F.split(text, " "))).alias("_w"))
    used = words.join(sent(asked.select("_w").distinct()), "_w", "left_semi").groupBy("_w").agg(F.count("*").alias("_n"))
    every = asked.join(used, "_w", "left").groupBy(phrase_key).agg(F.min_by("_w", F.struct("_n", "_w")).alias("_w"), F.bool_and(F.col("_n").isNotNull()).alias("_ok"))
    rarest = phrases.join(every.filter("_ok").select(phrase_key, "_w"), phrase_key).select(phrase_key, "_p", "_w")
    met = words.join(sent(rarest), "_w").select(key, phrase_key, "_p")
    short = phrases.filter(F.size("_inner") == 0).select(phrase_key, "_p")
    if short.take(1):
        places = F.transform(F.sequence(F.lit(1), F.length(text) - width + 1), lambda i: F.substring(F.col(text), i, F.lit(width)))
        grams = docs.filter(F.length(text) >= width).select(key, F.explode(F.array_distinct(places)).alias("_h"))
        met = met.unionByName(grams.join(sent(short.withColumn("_h", F.substring("_p", 1, width))), "_h").select(key, phrase_key, "_p"))
    return docs.join(met, key).filter(F.col(text).contains(F.col("_p"))).select(key, phrase_key)


def profile(df: DataFrame, text: str, same: list[str], short: int = 30) -> DataFrame:
    """One row: rows, rows with a text, rows that repeat another in ``same`` columns, texts
    that repeat, short texts, and the median length, from counts of each value."""
    digest = F.sha2(text, 256)
    n = df.agg(F.count("*").alias("filas"), F.count(text).alias("con_texto"), (F.count("*") - F.count_distinct(F.struct(*same))).alias("filas_identicas"), (F.count(text) - F.count_distinct(digest)).alias("textos_repetidos"), F.count_if(F.length(F.trim(text)) < short).alias("cortos"))
    return n.join(weighted_quantiles(df.select(F.length(text).cast("double").alias("x")).filter("x is not null"), [], "x", {"mediana": 0.5})).withColumn("mediana", F.round("mediana", 6))


def weighted_quantiles(df: DataFrame, by: list[str], x: str, points: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of each group, from the counts of its different values:
    ranks come from sums over ranges of values and within them.  The ranges are cut so that
    each holds about as many different values, be these shares or sums, so neither a
    group nor its values are held in one task.  Rows without a value are left out."""
    per = df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_n"))
    per = in_ranges(per, x, per, "_g")
    ranges = per.groupBy(*by, "_g").agg(F.sum("_n").alias("_r"))
    before = ranges.withColumn("_before", F.sum("_r").over(Window.partitionBy(*by).orderBy("_g")) - F.col("_r")).withColumn("_all", F.sum("_r").over(Window.partitionBy(*by)))
    upto = F.sum("_n").over(Window.partitionBy(*by, "_g").orderBy(x)) + F.col("_before")
    before = before.select(*(F.col(c).alias(f"_b_{c}") for c in [*by, "_g"]), "_before", "_all")
    same = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in [*by, "_g"]]
    ranked = per.join(before, same).withColumn("_to", upto)
    place = lambda q: (F.col("_all") - 1) * F.lit(q)
    at = lambda i: F.min(F.when(F.col("_to") > i, F.col(x)))
    out = [(at(F.floor(place(q))) + (at(F.ceil(place(q))) - at(F.floor(place(q)))) * F.max(place(q) - F.floor(place(q)))).alias(name) for name, q in points.items()]
    return ranked.groupBy(*by).agg(*out, F.max(x).alias("max")) if by else ranked.agg(*out)


def value_counts(df: DataFrame, c: str, empty: str = "(vacío)") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit(empty)).alias("value")).agg(F.count("*").alias("n"))


def sections(lines: DataFrame, line: str = "line", at: str = "at", doc: str = "doc", header: str = r"^#+\s") -> DataFrame:
    """Lines with the number of their section: a running count of header lines."""
    order = Window.partitionBy(doc).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.sum(F.regexp_like(line, F.lit(header)).cast("int")).over(order))


def cells(facts: DataFrame, items: DataFrame, dims: list[str], key: str, theme: str, themes: DataFrame) -> DataFrame:
    """The cube dims x theme: total items, n with the theme, percent (null where total is 0).  The
    skeleton is made of the distinct values of each dimension, so zeros are rows."""
    skeleton = themes
    for d in dims:
        skeleton = skeleton.crossJoin(items.select(d).distinct())
    total = items.groupBy(*dims).agg(F.count_distinct(key).alias("total"))
    n = facts.join(items.select(key, *dims), key).groupBy(*dims, theme).agg(F.count_distinct(key).alias("n"))
    out = skeleton.join(total, dims, "left").join(n, [*dims, theme], "left").na.fill(0, ["total", "n"])
    return out.withColumn("pct", F.when(F.col("total") > 0, 100.0 * F.col("n") / F.col("total")))


def zero_cells(cube: DataFrame, weights: DataFrame, theme: str, least_n: int = 5, least_weight: float = 15.0) -> DataFrame:
    """Cells without a mention where the theme's overall weight makes that surprising."""
    return cube.join(weights, theme).filter((F.col("total") >= least_n) & (F.col("n") == 0) & (F.col("weight") >= least_weight))
