"""Text columns: slugs, tags, label lists, shortening, search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(name: Column) -> Column:
    """Lower case, drop all but a-z 0-9 space hyphen, blanks to hyphens, squeeze hyphens.

    Accented letters are dropped, not transliterated.
    """
    kept = F.regexp_replace(F.lower(name), r"[^a-z0-9\s-]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), r"-+", "-"))


def split_tags(text: Column) -> Column:
    """'a, b,,a' -> ['a', 'b']."""
    parts = F.transform(F.split(text, ","), lambda part: F.trim(part))
    return F.array_distinct(F.filter(parts, lambda part: part != ""))


def split_list(text: Column) -> Column:
    """'a | b' -> ['a', 'b'], empty entries dropped."""
    parts = F.transform(F.split(text, r"\|"), lambda part: F.trim(part))
    return F.filter(parts, lambda part: part != "")


def label_pairs(text: Column) -> Column:
    """'Label: rest|plain' -> array of (label, text); label is null where there is no colon."""
    def pair(item: Column) -> Column:
        at = F.instr(item, ":")
        return F.struct(
            F.when(at > 0, F.substring_index(item, ":", 1)).alias("label"),
            F.when(at > 0, item.substr(at + 1, F.length(item))).otherwise(item).alias("text"))

    return F.transform(split_list(text), pair)


def shorten(text: Column, keep: int = 18) -> Column:
    return F.when(F.length(text) > keep, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def initial(name: Column) -> Column:
    return F.upper(F.substring(name, 1, 1))


def stars(rating: Column) -> Column:
    given = F.coalesce(F.nullif(rating.cast("int"), F.lit(0)), F.lit(5))
    return F.concat(F.repeat(F.lit("★"), given), F.repeat(F.lit("☆"), F.lit(5) - given))


def contains_text(column: Column, term: str) -> Column:
    """Substring match ignoring case and accents; the term is taken literally."""
    return F.contains(F.collate(column, "UNICODE_CI_AI"), F.collate(F.lit(term), "UNICODE_CI_AI"))


def contains_text_ascii(column: Column, term: str) -> Column:
    """Substring match ignoring case only, all in code generation; for ASCII columns."""
    return F.contains(F.lower(column), F.lit(term.lower()))


def normalise_login(text: Column) -> Column:
    return F.lower(F.trim(text))
