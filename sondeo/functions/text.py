"""Text rules as column expressions: normal forms, noise, tokens, names and labels."""

from __future__ import annotations

import json
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: Answers that say nothing, compared in normal form.
NON_ANSWERS = (
    "ninguno", "ninguna", "nada", "no", "na", "n/a", "n a", "no aplica", "no tengo", "sin comentarios", "sin comentario",
    "ningun comentario", "todo bien", "todo esta bien", "bien", "ok", "okay", "gracias", "ninguna observacion",
    "nignuno", "niguno", "ningno", "ningnuo", "ningina", "nada.", "nda", "nadaa", "todo bn", "tdo bien",
)
#: The letters of the noise rule, and what is cut off around an answer.
LETTER = "[A-Za-zÁÉÍÓÚÑÜáéíóúñü]"
EDGES = " .,;:!¡?¿-_*\"'()"
#: Words of the language and of the question that say nothing about a theme,
#: without accents; a parameter of :func:`tokens`, to which callers add names of their own.
STOP_WORDS = tuple(dict.fromkeys("""
    a al algo alguien algun alguna algunas alguno algunos ambos ante antes aqui asi aun aunque bajo bastante bien cada casi
    como con conmigo contra cual cuales cualquier cuando cuanto cuanta de del demas dentro desde donde dos durante e el ella
    ellas ello ellos en entonces entre era eran eres es esa esas ese eso esos esta estaba estaban estado estamos estan estar
    estas este esto estos estoy fue fueron fui ha haber habia habian han has hasta hay haya hayan he hemos hoy la las le
    les lo los mas me mi mia mis mismo misma mismos mismas mucha muchas mucho muchos muy nada ni ninguna ninguno no nos
    nosotros nuestra nuestras nuestro nuestros o otra otras otro otros para pero poca pocas poco pocos por porque pues que
    quien quienes se sea sean segun ser si sido siempre sin sino sobre solo son su sus tal tambien tan tanto te tener tenga
    tengan tenemos tiene tienen toda todas todo todos tu tus u un una unas uno unos usted ustedes va van vez veces y ya yo
    cosa cosas parte etc ademas manera forma hacer hace hacen hacia puede pueden podria podrian poder deberia deberian debe
    deben deber debemos seria serian creo considero consideramos pienso pensamos opinamos gustaria quisieramos importante
    necesario necesita necesitan mejor mejores mayor menor menos lugar tipo cuenta realmente mediante traves
    universidad transformacion transformaciones ajustaria ajustariamos ajustar ajuste ajustes
    uc respecto aspecto aspectos tema temas sentido punto puntos falta hacerlo tenido esten
""".split()))  # fmt: skip
#: Month abbreviations of date labels.
MONTHS = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic")


def _decomposed() -> tuple[str, str, dict[str, str]]:
    """Code points whose compatibility decomposition holds one ASCII character, these, and
    those that hold several of them (ligatures, fractions, units) with the whole."""
    one, several = {}, {}
    for i in range(0x80, sys.maxunicode + 1):
        c = chr(i)
        new = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if new:
            (one if len(new) == 1 else several)[c] = new
    return "".join(one), "".join(one.values()), several


ACCENTED, PLAIN, LIGATURES = _decomposed()


def _classes(chars) -> str:
    """A pattern for one of these characters, neighbours as ranges."""
    at, runs = sorted(map(ord, chars)), []
    for i in at:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


_LIGATURE = _classes(LIGATURES)
#: One of them; most characters are told from them by two comparisons, as a class of some
#: hundred ranges is slow.
_SPLITS = f"(?=[\\x{{BC}}-\\x{{BE}}\\x{{{min(ord(c) for c in LIGATURES if ord(c) > 0xFF):X}}}-\\x{{10FFFF}}]){_LIGATURE}"


def plain(text) -> Column:
    """The ASCII characters of the compatibility decomposition: accents off, ligatures and
    fractions split, what has no ASCII form dropped.  Only texts with a character that
    splits are taken apart."""
    text = F.col(text) if isinstance(text, str) else text
    whole = F.create_map(*(F.lit(x) for kv in LIGATURES.items() for x in kv))
    split = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)" + _LIGATURE + "|[^" + _LIGATURE[1:-1] + "]+"), 0), lambda c: F.coalesce(F.try_element_at(whole, c), c)), "")
    own = F.when(F.regexp_like(text, F.lit(_SPLITS)), split).otherwise(text)
    return F.regexp_replace(F.translate(own, ACCENTED, PLAIN), r"[^\x00-\x7F]+", "")


def bound(column: Column, use) -> Column:
    """``use`` of a column that is computed once a row, however often ``use`` names it."""
    return F.transform(F.array(column), use)[0]


def normalise(text) -> Column:
    """Plain, lower case, white space collapsed and cut off at the ends."""
    return normal_of_plain(plain(text))


def normal_of_plain(text: Column) -> Column:
    """:func:`normalise` of a plain text.  Only white space that isn't one blank is a match."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s{2,}|[^\S ]", " "))


def slug_spaces(text) -> Column:
    """Plain lower case with white space as ``_``; punctuation stays (exercise ids)."""
    return F.regexp_replace(F.trim(F.lower(plain(text))), r"\s+", "_")


def slug(text) -> Column:
    """Any run of other than a-z, 0-9 as ``_`` (group ids)."""
    return joined(normalise(text), "a-z0-9")


def joined(text: Column, kept: str) -> Column:
    """Any run of other characters than those kept as ``_``, none at the ends.  Blanks go
    first, so that the pattern meets only what isn't one ``_`` yet."""
    return F.btrim(F.regexp_replace(F.replace(text, F.lit(" "), F.lit("_")), f"[^{kept}]{{2,}}|[^{kept}_]", "_"), F.lit("_"))


def file_part(text) -> Column:
    """Like :func:`slug`, with the case kept."""
    return joined(plain(text), "A-Za-z0-9")


def sheet_name(text) -> Column:
    """At most 31 characters, without those that sheets forbid."""
    return F.substring(F.regexp_replace(text, r"[\[\]:*?/\\]", ""), 1, 31)


def noise_reason(text) -> Column:
    """Why an answer has no content, or null; the rules are tried in this order.  Letters are
    only looked for up to the third, and a text is only brought to normal form if it has no
    more plain letters than the longest answer without content."""
    other = "[^" + LETTER[1:]
    longest = max(map(len, NON_ANSWERS))
    core = F.when(~F.regexp_like(text, F.lit(rf"(?:[A-Za-z][^A-Za-z]*){{{longest + 1}}}")), F.btrim(normalise(text), F.lit(EDGES)))
    return (
        F.when(F.col(text).isNull() | ~F.regexp_like(text, F.lit(r"\S")), "vacio")
        .when(~F.regexp_like(text, F.lit(LETTER)), "solo_signos_o_numeros")
        .when(~F.regexp_like(text, F.lit(f"{LETTER}{other}*{LETTER}{other}*{LETTER}")), "menos_de_3_letras")
        .when(core.isin(*NON_ANSWERS), "no_respuesta")
    )


def without_marks(text) -> Column:
    """Marks such as ``[PERSONA]`` as a space."""
    return F.regexp_replace(text, r"\[[A-Z_]+\]", " ")


def letter_words(text, least: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?U)[^\W\d_]{{{least},}}"), 0)


def tokens(text, stop: tuple = STOP_WORDS) -> Column:
    """Lower-case runs of three or more letters that stand alone as words, without stop
    words (compared without accents; a word of ASCII letters is its own normal form)."""
    words = F.regexp_extract_all(F.lower(without_marks(text)), F.lit(r"(?U)\b[^\W\d_]{3,}\b"), 0)
    return F.filter(words, lambda w: ~F.when(F.regexp_like(w, F.lit(r"[^\x00-\x7F]")), normalise(w)).otherwise(w).isin(*stop))


def bigrams(words: Column) -> Column:
    """Neighbouring pairs of an array of tokens."""
    n = F.size(words)
    return F.when(n >= 2, F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def theme_id(number, name) -> Column:
    """A number and the first four words of over two characters of a name."""
    words = F.filter(F.split(slug(name), "_"), lambda w: F.length(w) > 2)
    return F.concat_ws("_", F.concat(F.lit("t"), number.cast("string")), F.array_join(F.slice(words, 1, 4), "_"))


def signature(words, n: int = 5) -> Column:
    return F.array_join(F.slice(words, 1, n), ", ")


def percent_label(x) -> Column:
    """Whole percent, halves to even."""
    return F.concat(F.bround(x * 100).cast("long").cast("string"), F.lit("%"))


def date_range_label(first, last) -> Column:
    """``3 ene 2024``, ``3-5 ene 2024`` or ``30 ene - 2 feb 2024``."""
    month = lambda d: F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d))
    day = lambda d: F.dayofmonth(d).cast("string")
    end = F.concat_ws(" ", day(last), month(last), F.year(last).cast("string"))
    same = (F.year(first) == F.year(last)) & (F.month(first) == F.month(last))
    return F.when(first == last, end).when(same, F.concat(day(first), F.lit("-"), end)).otherwise(F.concat(day(first), F.lit(" "), month(first), F.lit(" - "), end))


def version_key(text) -> Column:
    """``name-a.b.c`` as numbers to sort by."""
    return F.transform(F.split(F.regexp_extract(text, r"(\d+(?:\.\d+)*)$", 1), r"\."), lambda x: x.cast("int"))


def canonical_json(column: Column, kind: DataType, separators: tuple[str, str] = (", ", ": ")) -> Column:
    """A value of this type as JSON with sorted keys at every level and nulls kept: the same
    text for equal values, whatever the order of fields.  For keys of stores, as its digest."""
    item, colon = separators
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    if isinstance(kind, StructType):
        each = [F.concat(F.lit(f"{json.dumps(f.name, ensure_ascii=False)}{colon}"), canonical_json(column[f.name], f.dataType, separators)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.concat_ws(item, *each), F.lit("}"))
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: canonical_json(x, kind.elementType, separators)), item), F.lit("]"))
    elif isinstance(kind, MapType):
        pair = lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(colon), canonical_json(e["value"], kind.valueType, separators))
        keys = F.array_sort(F.map_keys(column))
        out = F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: pair(F.struct(k.alias("key"), F.try_element_at(column, k).alias("value")))), item), F.lit("}"))
    else:
        out = quoted(column)
    return F.coalesce(F.when(column.isNull(), "null").otherwise(out), F.lit("null"))
