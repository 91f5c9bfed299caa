"""Wording: display labels, support texts and claim sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelight.functions.text import phrase

# Words that stay small inside a displayed title, and spellings of their own; short lists of ours.
SMALL = ("a", "an", "and", "as", "by", "for", "in", "of", "on", "or", "the", "to", "with")
SPELLINGS = {"ai": "AI", "xr": "XR", "ux": "UX", "pdf": "PDF", "doi": "DOI"}
# What the contribution keys mean, for readers of a report.
DEFINITIONS = {
    "theoretical": "argues a position or names a concept", "methodological": "works out a procedure", "artifact": "makes a thing others can use", "empirical": "reports what was found",
    "survey": "orders what others did", "opinion": "raises questions", "dataset": "collects records", "mixed": "several kinds, none of them leading", "unclear": "no kind is signalled",
}


def title_case(c: Column) -> Column:
    """Every word capitalised but small words inside; known spellings as they are."""
    words = F.split(phrase(c), " ")
    fixed = F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])
    shown = F.transform(words, lambda w, i: F.coalesce(F.try_element_at(fixed, w), F.when((i > 0) & w.isin(*SMALL), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000)))))
    return F.array_join(shown, " ")


def display(terms: Column, labels: dict[str, str], most: int = 5) -> Column:
    """Terms as display labels, unknown ones in title case, each label once."""
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) if labels else F.create_map(F.lit(""), F.lit(""))
    shown = F.transform(F.filter(terms, lambda t: F.trim(t) != ""), lambda t: F.coalesce(F.try_element_at(known, phrase(t)), title_case(t)))
    return F.slice(F.array_distinct(shown), 1, most)


def definition(key: Column) -> Column:
    """The reader's definition of a contribution key; unknown keys are unclear."""
    d = F.create_map(*[F.lit(x) for kv in DEFINITIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(d, F.coalesce(key, F.lit(""))), F.lit(DEFINITIONS["unclear"]))


def support_text(support: Column, n: Column) -> Column:
    """``3 of 8 papers``"""
    return F.concat(support.cast("string"), F.lit(" of "), n.cast("string"), F.when(n == 1, " paper").otherwise(" papers"))


def claim(form: Column, action: Column, role: Column) -> Column:
    """``Form that action role``, parts left out where empty."""
    tail = F.concat_ws(" ", F.nullif(F.coalesce(action, F.lit("")), F.lit("")), F.nullif(F.coalesce(role, F.lit("")), F.lit("")))
    return F.concat(title_case(F.coalesce(form, F.lit("papers"))), F.when(tail != "", F.concat(F.lit(" that "), tail)).otherwise(""), F.lit("."))


def first_value(*columns: str) -> Column:
    """Of several list columns the first entry of the first that has one; else ''."""
    return F.coalesce(*[F.nullif(F.trim(F.split(F.coalesce(F.col(c), F.lit("")), ",")[0]), F.lit("")) for c in columns], F.lit(""))
