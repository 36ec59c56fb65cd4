"""Redaction of personal data as a chain of pattern replacements, and what it counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bound, normalise

#: Capital and small letters of names, titles, and words that follow a signature.
CAPITAL, SMALL = "A-ZÁÉÍÓÚÑÜ", "a-záéíóúñü"
TITLES = r"profesor|profesora|profe|docente|ingeniero|ingeniera|ing\.?|doctor|doctora|dr\.?|dra\.?|señor|señora|sr\.?|sra\.?|coordinador|coordinadora|decano|decana|rector|rectora"
SIGNERS = r"facultad|programa|docente|gestora?|coordinadora?|decana?|directora?|estudiante|egresad[oa]|graduad[oa]|administrativ[oa]"
HEADER = r"\[\d{1,2}/\d{1,2}(?:/\d{2,4})?,?\s*\d{1,2}:\d{2}[^\]]*\]"
NAME = rf"[{CAPITAL}][{SMALL}]+"
#: Kind, what a text must hold for the rule to be tried, pattern, replacement,
#: in order.  ``(?U)`` lets classes hold accented letters.  A number of six to eleven digits
#: stays if it is money: a ``$`` within three characters before it or "mil" in just these, or
#: one of ``$``, "peso" and "mil" within the eight after it.
RULES = (
    ("CORREO", "@", r"(?U)[\w.+-]+@[\w-]+(\.[\w-]+)+", "[CORREO]"),
    ("URL", "(?i)http|www", r"(?iU)(https?://|www\.)\S+", "[URL]"),
    ("TELEFONO", r"\d{3}", r"(?<!\d)(\+?57[\s.-]?)?3\d{2}[\s.-]?\d{3}[\s.-]?\d{4}(?!\d)", "[TELEFONO]"),
    ("TELEFONO", r"\d{4}", r"(?<!\d)(\(?60\d\)?|\(?[1-8]\)?)[\s.-]?\d{3}[\s.-]?\d{4}(?!\d)", "[TELEFONO]"),
    ("NUMERO_ID", r"\d{3}", r"(?is)(?=\d)(?<!\d|\$.{0,2}|mil)(?:(?<!\.)(?:\d{3}(?:\.\d{3}){1,2}|\d{1,2}(?:\.\d{3}){2,3})(?![\d.])|\d{6,11}(?!\d))(?!.{0,7}\$|.{0,4}peso|.{0,5}mil)", "[NUMERO_ID]"),
    ("PERSONA", r"\[\d", rf"({HEADER})\s*[^:\[\]\n]{{2,60}}:", "$1 [PERSONA]:"),
    ("PERSONA", rf"(?iU),\s*(?:{SIGNERS})", rf"(?U)\b{NAME}(?:\s+{NAME}){{1,4}}(?=\s*,\s*(?i:{SIGNERS})\b)", "[PERSONA]"),
    ("PERSONA", rf"(?iU)\b(?:{TITLES})\s", rf"(?U)\b((?i:{TITLES}))\s+{NAME}(\s+{NAME})?", "$1 [PERSONA]"),
)
KINDS = ("CORREO", "URL", "TELEFONO", "NUMERO_ID", "PERSONA")


def _where(text: Column, gate: str) -> Column:
    return F.contains(text, F.lit(gate)) if gate == "@" else F.regexp_like(text, F.lit(gate))


def redact(text) -> Column:
    """All rules one after another, each on what the one before left, which is bound: a plain
    chain would name it three times a rule, and 3**8 times in all."""
    out = F.col(text) if isinstance(text, str) else text
    step = lambda gate, pattern, new: lambda t: F.when(_where(t, gate), F.regexp_replace(t, F.lit(pattern), F.lit(new))).otherwise(t)
    for _, gate, pattern, new in RULES:
        out = bound(out, step(gate, pattern, new))
    return out


def redact_counted(df: DataFrame, text: str = "text", to: str = "redacted") -> DataFrame:
    """``df`` with the redacted text and ``n_<kind>`` of replacements."""
    out = df.withColumn(to, F.col(text))
    for i, (_, gate, pattern, new) in enumerate(RULES):
        out = out.withColumn(f"_n{i}", F.when(_where(F.col(to), gate), F.regexp_count(to, F.lit(pattern))))
        out = out.withColumn(to, F.when(F.col(f"_n{i}") > 0, F.regexp_replace(to, pattern, new)).otherwise(F.col(to)))
    for kind in KINDS:
        own = [F.coalesce(F.col(f"_n{i}"), F.lit(0)) for i, (k, *_) in enumerate(RULES) if k == kind]
        out = out.withColumn(f"n_{kind.lower()}", sum(own[1:], own[0]).cast("long"))
    return out.drop(*(f"_n{i}" for i in range(len(RULES))))


def name_audit(text, given_names: Column | None = None) -> Column:
    """Kinds of names that redaction may have left: chat headers, signatures, and runs of
    three to five capitalised words that begin with a known given name."""
    header = F.regexp_like(text, F.lit(HEADER + r"\s*(?!\[PERSONA\])[^:\[\]\n]{2,60}:"))
    signed = F.regexp_like(text, F.lit(rf"(?U)\b{NAME}(?:\s+{NAME}){{1,4}}\s*,\s*(?i:facultad|programa|docente|gestor|coordinador|decano|director)"))
    found = [F.when(header, "whatsapp"), F.when(signed, "firma")]
    if given_names is not None:
        firsts = F.transform(F.regexp_extract_all(text, F.lit(rf"(?U)\b({NAME})(?:\s+{NAME}){{2,4}}\b"), 1), normalise)
        found.append(F.when(F.arrays_overlap(firsts, given_names), "nombre_probable"))
    return F.array_compact(F.array(*found))


def given_names(people: DataFrame, name: str, least: int = 3) -> DataFrame:
    """``(nombre)``: the different first words of names, of ``least`` letters or more, in normal form."""
    first = F.regexp_extract(F.col(name), r"(?U)[^\W\d_]+", 0)
    return people.select(F.when(F.length(first) >= least, normalise(first)).alias("nombre")).filter("nombre is not null and nombre <> ''").distinct()


class ResidualNamesError(ValueError):
    """Redacted texts still hold names."""


def residual_names(texts: DataFrame, key: str, text: str, given: DataFrame) -> DataFrame:
    """``(key, kinds)`` of texts with a name that redaction has left: see :func:`name_audit`.
    First words of name-like runs are looked up in ``given(nombre)`` by a join, so that table may have any size."""
    firsts = F.transform(F.regexp_extract_all(F.col(text), F.lit(rf"(?U)\b({NAME})(?:\s+{NAME}){{2,4}}\b"), 1), normalise)
    likely = texts.select(key, F.explode(firsts).alias("nombre")).join(given, "nombre", "left_semi").select(key, F.lit("nombre_probable").alias("kind"))
    plain = texts.select(key, F.explode(name_audit(text)).alias("kind"))
    return plain.unionByName(likely).groupBy(key).agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def no_names_or_stop(texts: DataFrame, key: str, text: str, given: DataFrame, shown: int = 10) -> DataFrame:
    """``texts``, if none holds a name; else :class:`ResidualNamesError` with their number and
    the keys and kinds of some, never the texts.  It runs at once."""
    found = residual_names(texts, key, text, given)
    some = found.orderBy(key).limit(shown).collect()
    if some:
        raise ResidualNamesError(f"{found.count()} texts hold names: " + ", ".join(f"{r[key]} {r['kinds']}" for r in some))
    return texts


def publishable(df: DataFrame, name: str, mail: str, comment: str, clean: DataFrame, key: str) -> DataFrame:
    """A copy with names and addresses masked and the comment replaced by its redacted form
    of ``clean(key, comment)``; blanks stay blank.  Raises if a key has no redacted form."""
    clean = clean.select(key, F.col(comment).alias("_clean"))
    if df.join(clean, key, "left_anti").take(1):
        raise ValueError("rows without a redacted comment")
    mask = lambda c, new: F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) != "", F.lit(new)).otherwise(F.col(c))
    out = df.join(clean, key).withColumns({name: mask(name, "[NOMBRE]"), mail: mask(mail, "[CORREO]")})
    return out.withColumn(comment, F.when(F.col(comment).isNotNull(), F.col("_clean"))).drop("_clean")
