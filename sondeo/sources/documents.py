"""Framework documents as tables of lines: numbered sections, bold blocks, components; files
and lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.themes import row, union_all
from .tables import written  # noqa: F401  (kept under its earlier name)

HEADER = r"^## (\d+)\. (.+?)\s*$"
BOLD = r"^\*\*(.*)\*\*$"


def form_of_file(path, forms: dict[str, str]):
    """The form that a file's name holds in brackets, such as ``Survey (UC 1).parquet``: of
    several the first known one; null if there is none."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), "\u00a0|%C2%A0|%20", " ")
    keys = F.transform(F.regexp_extract_all(name, F.lit(r"\(([^)]*)\)"), 1), lambda x: F.upper(F.trim(F.regexp_replace(x, r"\s+", " "))))
    known = F.create_map(*(F.lit(x) for kv in forms.items() for x in kv))
    return F.get(F.filter(F.transform(keys, lambda k: F.try_element_at(known, k)), lambda x: x.isNotNull()), 0)


def json_lines(rows: DataFrame, line: str, ddl: str) -> DataFrame:
    """The objects of lines of JSON; blank lines are skipped."""
    return rows.filter(F.trim(F.col(line)) != "").select(F.from_json(line, ddl).alias("o")).select("o.*")


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Each row as a line of JSON, nulls too, added to what is there."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def sections(lines: DataFrame, doc: str | None = None) -> DataFrame:
    """``lines(at, line)`` (of each ``doc``) -> ``(numero, nombre, linea_ini, linea_fin,
    cuerpo)`` of its sections ``## N. Name``.  A section ends before the next line that begins
    with ``## ``; blank lines and rules at its end, and blank lines at its beginning, are not part of the body."""
    part = [doc] if doc else []
    order = Window.partitionBy(*part).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("sec", F.sum(F.startswith(F.col("line"), F.lit("## ")).cast("int")).over(order)).filter("sec > 0")
    blank = F.trim("line").isin("", "---")
    head = F.col("at") == F.col("first")
    rows = rows.join(rows.groupBy(*part, "sec").agg(F.min("at").alias("first"), F.max(F.when(~blank, F.col("at"))).alias("last"), F.min_by("line", "at").alias("title")), [*part, "sec"]).filter("at <= last")
    text = F.array_sort(F.collect_list(F.when(~head, F.struct("at", "line"))))
    out = rows.groupBy(*part, "sec", "first", "last", "title").agg(text.alias("body")).filter(F.regexp_like("title", F.lit(HEADER)))
    start = F.array_min(F.transform(F.filter("body", lambda x: F.trim(x["line"]) != ""), lambda x: x["at"]))
    body = F.transform(F.filter("body", lambda x: x["at"] >= start), lambda x: x["line"])
    return out.select(*part, F.regexp_extract("title", HEADER, 1).cast("int").alias("numero"), F.regexp_extract("title", HEADER, 2).alias("nombre"), F.col("first").alias("linea_ini"), F.col("last").alias("linea_fin"), body.alias("cuerpo"))


def blocks(sec: DataFrame) -> DataFrame:
    """``(numero, nombre, titulo, lineas)``: the lines of each section under its bold titles."""
    rows = sec.select("numero", "nombre", F.posexplode("cuerpo").alias("at", "line"))
    bold = F.regexp_like(F.trim("line"), F.lit(BOLD))
    order = Window.partitionBy("numero").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"b": F.sum(bold.cast("int")).over(order), "bold": bold}).filter("b > 0")
    kept = F.array_sort(F.collect_list(F.when(~F.col("bold") & (F.trim("line") != ""), F.struct("at", F.rtrim("line").alias("line")))))
    each = rows.groupBy("numero", "nombre", "b").agg(F.max(F.when(F.col("bold"), F.regexp_extract(F.trim("line"), BOLD, 1))).alias("titulo"), kept.alias("k"))
    return each.select("numero", "nombre", "titulo", F.transform("k", lambda x: x["line"]).alias("lineas"))


def transformation(sec: DataFrame, name: str) -> DataFrame:
    """``(id, nombre, componentes)`` of the section of that name, whatever its accents and case."""
    found = blocks(sec).filter((F.col("titulo") == "Componentes preliminares") & (T.slug_spaces(F.col("nombre")) == T.slug_spaces(F.lit(name))))
    listed = F.transform("lineas", lambda x: F.trim(F.ltrim(x, F.lit("- "))))
    return found.select(F.concat(F.lit("T"), F.col("numero").cast("string")).alias("id"), "nombre", F.array_join(listed, "|").alias("componentes"))


def general_form(sec: DataFrame, name: str) -> DataFrame:
    """The form about all sections: its components are their names."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("numero", "nombre"))), lambda x: x["nombre"])
    return sec.agg(F.array_join(names, "|").alias("componentes")).select(F.lit("T0").alias("id"), F.lit(name).alias("nombre"), "componentes")


def framework_violations(lines: DataFrame, boundaries: list[str], least: int = 1, most: int = 5) -> DataFrame:
    """``(rule, subject, detail)``: numbered sections that are missing, that the summary table
    names otherwise, and pairs of sections without a described boundary."""
    spark, sec = lines.sparkSession, sections(lines)
    want = spark.range(least, most + 1).select(F.col("id").cast("int").alias("numero"))
    cell = r"^\|\s*(\d)\s*\|\s*\*\*(.+?)\*\*\s*\|"
    summary = lines.filter(F.regexp_like("line", F.lit(cell))).select(F.regexp_extract("line", cell, 1).cast("int").alias("numero"), F.regexp_extract("line", cell, 2).alias("resumen"))
    named = sec.join(summary, "numero", "left").filter(~F.col("resumen").eqNullSafe(F.col("nombre")))
    pairs = spark.createDataFrame([(f"T{a}-T{b}",) for a in range(least, most + 1) for b in range(a + 1, most + 1)], "pair string")
    return union_all([
        row(want.join(sec, "numero", "left_anti"), "missing_section", F.col("numero"), F.lit("")),
        row(named, "summary_name", F.col("numero"), F.coalesce("resumen", F.lit(""))),
        row(pairs.filter(~F.col("pair").isin(*boundaries)), "missing_boundary", F.col("pair"), F.lit("")),
    ])
