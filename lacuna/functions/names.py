"""Scientific and vernacular name rules as Column expressions.

Only regular expressions are used, so the rules stay inside generated code: no arrays and no
lambda expressions on the path that builds join keys.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank and qualifier words that are not part of a name.
CONNECTORS = ("subsp", "ssp", "var", "subvar", "forma", "fo", "f", "cv", "sp", "spp", "aff", "cf")

_PARENTHESES = r"\([^)]*\)"
_CONNECTOR_RUN = r"(?i)(?: (?:" + "|".join(CONNECTORS) + r"))+(?= |$)"
_BINOMIAL = r"^[A-Za-z]+ [A-Za-z]+"
# A third word counts only with a lower-case first letter; an upper-case one is an author.
_TRINOMIAL = r"^[A-Za-z]+ [A-Za-z]+ [a-z][A-Za-z]*"
_MANAGED = r"^[A-Za-z]+ [A-Za-z]+(?: [a-z][A-Za-z]*)?"
_UNICODE_SPACE = r"(?U)[\s\x1c-\x1f]+"


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def latin_words(name: Column) -> Column:
    """Latin words of a name, one space apart, without parentheses and connector words."""
    letters = F.regexp_replace(F.regexp_replace(name, _PARENTHESES, " "), "[^A-Za-z]+", " ")
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), F.trim(letters)), _CONNECTOR_RUN, ""))


def name_tokens(name: Column) -> Column:
    """Latin words of a name as an array; empty for a missing name."""
    words = F.coalesce(latin_words(name), F.lit(""))
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


def binomial(name: Column) -> Column:
    return _blank_to_null(F.lower(F.regexp_extract(latin_words(name), _BINOMIAL, 0)))


def trinomial(name: Column) -> Column:
    return _blank_to_null(F.lower(F.regexp_extract(latin_words(name), _TRINOMIAL, 0)))


def managed_key(name: Column) -> Column:
    """Most specific key of a free-text name: three words where there is a subspecies, else two."""
    return _blank_to_null(F.lower(F.regexp_extract(latin_words(name), _MANAGED, 0)))


def _clean(part: Column) -> Column:
    return F.lower(F.trim(F.coalesce(part, F.lit(""))))


def field_binomial(genus: Column, species: Column) -> Column:
    g, s = _clean(genus), _clean(species)
    return F.when((g != "") & (s != ""), F.concat_ws(" ", g, s))


def field_trinomial(genus: Column, species: Column, subspecies: Column) -> Column:
    ss = _clean(subspecies)
    return F.when(ss != "", F.concat_ws(" ", field_binomial(genus, species), ss)).otherwise(
        F.lit(None).cast("string")
    )


def field_key(genus: Column, species: Column, subspecies: Column) -> Column:
    """Key from clean genus / species / subspecies fields; NULL without genus and species."""
    g, s, ss = _clean(genus), _clean(species), _clean(subspecies)
    return F.when((g != "") & (s != ""), F.concat_ws(" ", g, s, _blank_to_null(ss)))


def listed_words(name: Column) -> Column:
    """Words as the red list writes them: split on white space, starting with a Latin letter.

    Connector words and punctuation stay, which is why this differs from `latin_words`.
    """
    words = F.split(F.regexp_replace(F.coalesce(name, F.lit("")), _PARENTHESES, " "), r"(?U)\s+")
    return F.filter(F.transform(words, F.lower), lambda w: w.rlike("^[a-z]"))


def listed_key(name: Column, words: int) -> Column:
    """First two or three listed words joined by a space; NULL when there are fewer."""
    w = listed_words(name)
    return F.when(F.size(w) >= words, F.array_join(F.slice(w, 1, words), " "))


def vernacular_key(name: Column) -> Column:
    """Vernacular name without any white space, Unicode spaces included."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), _UNICODE_SPACE, "")


def grade(value: Column) -> Column:
    """Endangered grade as I or II; other text is returned cleaned."""
    text = F.upper(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    text = F.replace(F.replace(text, F.lit("Ⅰ"), F.lit("I")), F.lit("Ⅱ"), F.lit("II"))
    text = F.translate(text, "급 ", "")
    return F.when(text.isin("I", "1"), "I").when(text.isin("II", "2"), "II").otherwise(text)


def first_filled(*values: Column) -> Column:
    """First value that is not blank, trimmed; '' when all are."""
    return F.coalesce(*[_blank_to_null(F.trim(v)) for v in values], F.lit(""))
