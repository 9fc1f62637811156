"""Text functions as column expressions. Lengths and offsets are in UTF-8 bytes unless a name says characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that are no terms, in folded spelling.
ENGLISH_STOP_WORDS = (
    "the is at which on a an and or in with as to for of by that this it from be are was "
    "what when where who why how does do did can should would will use using used"
).split()
SPANISH_STOP_WORDS = (
    "el la los las un una unos unas de del en para por con sin sobre entre que y o es son fue este esta estos estas como su sus "
    "cual cuales cuando donde quien porque cuanto usa usar usando hacer hace ser estan mas asi"
).split()
STOP_WORDS = [*ENGLISH_STOP_WORDS, *SPANISH_STOP_WORDS]
# Letters that lose their mark (ñ keeps it), and ligatures.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüýÿç"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyyc"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: What parts words: anything that is neither a letter nor a number, underscore or hyphen.
SEPARATORS = r"[^\p{IsAlphabetic}\p{N}_-]+"
BYTES_PER_TOKEN = 3.8


def fold(word: Column) -> Column:
    """Lower case without accents (ñ stays), without combining marks, and with ligatures written out. ASCII words, nearly all, only lose their case."""
    out = F.translate(F.lower(word), MARKED + "".join(map(chr, range(0x300, 0x370))), PLAIN)
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(out)


def is_term(folded: Column) -> Column:
    return (F.length(folded) >= 2) & ~folded.isin(STOP_WORDS)


def words(text: Column) -> Column:
    """The words of a text as written; terms are what fold() makes of them, as far as is_term() holds. Exploded words are folded in generated code."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS)


def tokenize(text: Column) -> Column:
    """The terms of a text in order, as an array."""
    return F.filter(F.transform(words(text), fold), is_term)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / F.lit(BYTES_PER_TOKEN)).cast("long")


def trimmed(text: Column) -> Column:
    """Without white space (of any script) at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def compact(text: Column) -> Column:
    """At most two line feeds in a row, single spaces, none after a line feed, none at the ends."""
    out = F.regexp_replace(text, r"(?U)[\s&&[^\n\r]]+", " ")
    out = F.regexp_replace(out, r"([\n\r]) +", "$1")
    out = F.regexp_replace(F.regexp_replace(out, "\r", "\n"), r"\n{3,}", "\n\n")
    return trimmed(out)


def slugify(title: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{IsAlphabetic}\p{N}]+", "-"), r"^-+|-+$", "")
    return F.when(slug == "", F.lit("section")).otherwise(slug)


def heading(line: Column) -> Column:
    """(level, title) of a line that reads like a heading, else null."""
    t = trimmed(line)
    digits = F.regexp_extract(t, r"^([0-9.]*\.[0-9.]*) ", 1)
    dots = F.length(digits) - F.length(F.replace(digits, F.lit("."), F.lit("")))
    letters = F.regexp_replace(t, r"[^\p{IsAlphabetic}]", "")
    low = F.lower(t)

    def found(level, title) -> Column:
        return F.struct((F.lit(level) if isinstance(level, int) else level).cast("int").alias("level"), title.alias("title"))

    prose = t.endswith(".") & ~t.endswith("...") & ~F.substring(t, 1, 5).rlike("[0-9]")
    return (
        F.when((t == "") | (F.octet_length(t) > 120) | prose | t.endswith(",") | t.endswith(";"), F.lit(None))
        .when(t.startswith("### "), found(3, trimmed(F.substring(t, 5, 1000))))
        .when(t.startswith("## "), found(2, trimmed(F.substring(t, 4, 1000))))
        .when(t.startswith("# "), found(1, trimmed(F.substring(t, 3, 1000))))
        .when(low.startswith("chapter ") | low.startswith("capítulo ") | low.startswith("sección "), found(1, t))
        .when(digits != "", found(F.when(dots <= 1, 1).when(dots == 2, 2).otherwise(3), trimmed(F.regexp_replace(t, r"^[0-9.]+ ", ""))))
        .when((F.octet_length(letters) >= 4) & (F.upper(letters) == letters) & letters.rlike(r"^[\p{Lu}\p{IsUppercase}]+$") & (F.octet_length(t) <= 60), found(2, t))
    )


def cells(line: Column) -> Column:
    """The cells of a line: by pipes if it is framed by them, else by tabs, else by two or more spaces."""
    t = trimmed(line)
    pipes = F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))
    tabs = F.filter(F.transform(F.split(t, "\t"), trimmed), lambda c: c != "")
    spaced = F.filter(F.transform(F.split(t, " {2,}"), trimmed), lambda c: c != "")
    piped = F.transform(F.split(F.regexp_replace(t, r"^\|+|\|+$", ""), r"\|"), trimmed)
    return (
        F.when(t == "", F.array().cast("array<string>"))
        .when(t.startswith("|") & t.endswith("|") & (pipes >= 3), piped)
        .when(t.contains("\t") & (F.size(tabs) >= 2), tabs)
        .otherwise(spaced)
    )


def is_separator_line(line: Column) -> Column:
    """Whether a line only rules a table."""
    return line.rlike(r"(?U)^[-|+:=\s]+$") & line.contains("-")


def citation(doc_id: Column, page: Column, section_id: Column | None = None) -> Column:
    """[Doc: d p. n § s], without the last part where there is no section."""
    section = F.lit("") if section_id is None else F.when(section_id.isNull(), F.lit("")).otherwise(F.concat(F.lit(" § "), section_id))
    return F.concat(F.lit("[Doc: "), doc_id, F.lit(" p. "), page.cast("string"), section, F.lit("]"))


def provenance(doc_id: Column, page: Column, section_id: Column, offset: Column) -> Column:
    """[Doc: d, Page: p, Section: s, Offset: o] with those parts that are known."""
    parts = [F.concat(F.lit("Doc: "), doc_id), F.concat(F.lit("Page: "), page.cast("string")), F.concat(F.lit("Section: "), section_id), F.concat(F.lit("Offset: "), offset.cast("string"))]
    return F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))


def idf(total: Column, df: Column) -> Column:
    return F.log((total - df + 0.5) / (df + 0.5) + 1.0)


def bm25(tf: Column, length: Column, average: Column, weight: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return weight * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / average))


def outline_line(level: Column, title: Column, first: Column, last: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), F.greatest(level - 1, F.lit(0))), F.lit("* "), title, F.lit(" (pp. "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(")"))
