"""Names of territories: Serbian Cyrillic as plain ASCII, qualifiers in brackets, levels of a hierarchy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: letters that become two, and single letters in alphabetical order
PAIRS = (("Љ", "LJ"), ("Њ", "NJ"), ("Џ", "DZ"))
SINGLE_FROM = "АБВГДЂЕЖЗИЈКЛМНОПРСТЋУФХЦЧШ"
SINGLE_TO = "ABVGDDEZZIJKLMNOPRSTCUFHCCS"


def ascii_name(name: Column) -> Column:
    """Upper-case letters A-Z of a name, Cyrillic transliterated, all else dropped."""
    out = F.upper(name)
    for letter, two in PAIRS:
        out = F.replace(out, F.lit(letter), F.lit(two))
    return F.regexp_replace(F.translate(out, SINGLE_FROM, SINGLE_TO), "[^A-Z]", "")


def base_name(name: Column) -> Column:
    """Letters and wildcards (?) outside brackets."""
    return F.regexp_replace(F.regexp_replace(F.upper(name), r"\([^)]*\)", ""), "[^A-Z?]", "")


def qualifier(name: Column) -> Column:
    """Letters and wildcards (?) inside the first brackets; empty without brackets."""
    return F.regexp_replace(F.regexp_extract(F.upper(name), r"\(([^)]*)\)", 1), "[^A-Z?]", "")


def wildcard_fits(pattern: Column, name: Column) -> Column:
    """Whether the whole name fits a pattern in which ? stands for any one letter."""
    return F.regexp_like(name, F.concat(F.lit("^"), F.replace(pattern, F.lit("?"), F.lit(".")), F.lit("$")))


def qualifier_fits(qual: Column, area: Column) -> Column:
    """Whether a qualifier, with its wildcards, begins the area's name."""
    return (F.length(qual) > 0) & wildcard_fits(qual, area.substr(F.lit(1), F.length(qual)))


def level_of(name: Column) -> Column:
    """Level of a row of the census sheet, by its name's form; the tests come in this order."""
    low = F.lower(name)
    return (
        F.when((F.upper(name) == name) & (low != name), "country_or_macroregion")
        .when(low.contains("регион"), "region")
        .when(low.contains("област"), "area")
        .when(name.startswith("Град "), "city_aggregate")
        .otherwise("municipality")
    )
