"""Text expressions: each a Column in, a Column out, all inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical names of the keyword groups.
KEYWORDS = (
    "Design knowledge", "Design patterns", "Design guidelines", "Design heuristics", "Design procedures", "Design expertise",
    "Design methods", "Design rules", "Design principles", "Design rationale", "Design theory", "Design frameworks",
)
# Prefixes a DOI is freed of, in this order (in any case).
DOI_PREFIXES = ("doi:", "https://doi.org/", "http://doi.org/")
# Texts that count as true.
TRUE_TEXTS = ("1", "true", "yes", "y")
# Roots too general to tell evidence apart.
GENERIC_ROOTS = ("design", "paper", "study", "research", "approach", "method", "result", "work", "use", "user", "system", "process", "base", "way", "form")
# Headings that open a discussion.
DISCUSSION_HEADINGS = ("discussion", "discussions", "findings and discussion", "results and discussion", "discussion and conclusion", "discussion and conclusions")


def text(c: Column | str) -> Column:
    """The text, with null and the word ``nan`` as empty."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(t) == "nan", F.lit("")).otherwise(t)


def squeeze(c: Column) -> Column:
    """Outer white space off, inner runs one space."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def phrase(c: Column) -> Column:
    """Squeezed and lower-cased."""
    return F.lower(squeeze(c))


def canonical_keyword(c: Column) -> Column:
    """The canonical spelling of a keyword, else the trimmed input."""
    known = F.create_map(*[F.lit(x) for k in KEYWORDS for x in (k.lower(), k)])
    return F.coalesce(F.try_element_at(known, phrase(c)), F.trim(c))


def keyword_list(c: Column) -> Column:
    """A multi-valued keyword split at ``;``, ``|`` and ``,``; canonical, blanks dropped."""
    return F.transform(F.filter(F.split(text(c), r"\s*[;|,]\s*"), lambda x: F.trim(x) != ""), canonical_keyword)


def has_keyword(c: Column, focus: str) -> Column:
    return F.exists(keyword_list(c), lambda x: phrase(x) == phrase(canonical_keyword(F.lit(focus))))


def slug(c: Column) -> Column:
    """Runs of letters and digits joined by ``_``."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def safe_name(c: Column, default: str = "paper") -> Column:
    """A file name of plain characters."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def doi(c: Column) -> Column:
    """Lower-cased DOI, the known prefixes stripped one after the other."""
    out = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    for p in DOI_PREFIXES:
        out = F.when(out.startswith(p), F.substring(out, len(p) + 1, 1_000_000)).otherwise(out)
    return F.trim(out)


def title_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def arxiv_pdf(doi: Column, url: Column) -> Column:
    """The PDF address of an arXiv paper, from its DOI, else from a URL on arXiv's own host;
    '' if it is none."""
    of_doi = F.regexp_extract(F.coalesce(doi, F.lit("")), r"(?i)10\.48550/arxiv\.([^/]+)$", 1)
    of_url = F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^[a-z]+://(?:www\.)?arxiv\.org/(?:[^?#]*/)?(?:abs|pdf)/([^/?#]+)", 1), r"\.pdf$", "")
    number = F.when(of_doi != "", of_doi).otherwise(of_url)
    return F.when(number != "", F.concat(F.lit("https://arxiv.org/pdf/"), number, F.lit(".pdf"))).otherwise(F.lit(""))


def is_direct_pdf(url: Column) -> Column:
    """The URL's path, without its query, ends in ``.pdf``."""
    return F.coalesce(F.split(url, r"\?")[0].rlike(r"(?i)\.pdf$"), F.lit(False))


def is_true(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin(*TRUE_TEXTS)


def terms(c: Column) -> Column:
    """Comma-separated terms, trimmed, without blanks and ``nan``."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != "nan"))


def distinct_terms(arr: Column) -> Column:
    """The first spelling of each term, terms equal up to case and space."""
    keys = F.transform(arr, lambda x: phrase(x))
    return F.filter(arr, lambda x, i: F.array_position(keys, phrase(x)) == i + 1)


def clean_space(c: Column) -> Column:
    """NUL to space, horizontal space squeezed, three and more line feeds to two."""
    t = F.regexp_replace(F.translate(c, "\x00", " "), "[ \t\r\f\x0b]+", " ")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def blocks(c: Column) -> Column:
    """Parts between blank lines, trimmed and not empty."""
    parts = F.split(F.regexp_replace(c, "\n[ \t\r\f\x0b\n]*\n", "\x01"), "\x01")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` before a capital, quotation mark or bracket."""
    marked = F.regexp_replace(F.trim(c), r'([.!?])\s+([A-Z"“(])', "$1\x01$2")
    marked = F.regexp_replace(marked, r'([.!?])\s+([A-Z"“(])', "$1\x01$2")  # a one-letter sentence between
    return F.filter(F.transform(F.split(marked, "\x01"), lambda x: F.trim(x)), lambda x: x != "")


def fulltext_paragraphs(c: Column, least: int = 80) -> Column:
    """Parts at blank lines and at sentence ends before a capitalised word, squeezed; parts
    shorter than ``least`` characters are dropped."""
    marked = F.regexp_replace(clean_space(c), "\n[ \t\r\f\x0b\n]*\n", "\x01")
    marked = F.regexp_replace(marked, r"([.!?])\s+([A-Z][a-z])", "$1\x01$2")
    return F.filter(F.transform(F.split(marked, "\x01"), lambda x: squeeze(x)), lambda x: F.length(x) >= least)


def boundary_count(haystack: Column, term: str) -> Column:
    """Occurrences of ``term`` with no letter or digit beside it."""
    esc = "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in term)
    return F.regexp_count(haystack, F.lit(f"(?<![a-z0-9]){esc}(?![a-z0-9])"))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def relevance(haystack: Column, vocabulary: tuple[str, ...]) -> Column:
    """Occurrences of the terms in the squeezed, lower-cased text; several words weigh 4."""

    def total(low: Column) -> Column:
        out = F.lit(0)
        for t in dict.fromkeys(vocabulary):
            out = out + boundary_count(low, t) * (4 if " " in t else 1)
        return out

    return bound(phrase(haystack), total)


def present_terms(haystack: Column, vocabulary: tuple[str, ...], most: int = 10) -> Column:
    """The terms that occur, in the order of the vocabulary, at most ``most``."""
    hits = bound(phrase(haystack), lambda low: F.array_compact(F.array(*[F.when(boundary_count(low, t) > 0, F.lit(t)) for t in vocabulary])))
    return F.slice(hits, 1, most)


def root(tok: Column) -> Column:
    """Evidence root: ``ies`` to ``y``, ``es`` (not ``ses``) and ``s`` dropped."""
    n = F.length(tok)
    return (F.when((n > 4) & tok.endswith("ies"), F.concat(F.substring(tok, F.lit(1), n - 3), F.lit("y")))
            .when((n > 3) & tok.endswith("es") & ~tok.endswith("ses"), F.substring(tok, F.lit(1), n - 2))
            .when((n > 3) & tok.endswith("s"), F.substring(tok, F.lit(1), n - 1)).otherwise(tok))


def roots(c: Column) -> Column:
    """Distinct roots of the words, general and short ones left out."""
    toks = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9][a-z0-9'-]*)"), 1)
    r = F.array_distinct(F.transform(toks, root))
    return F.filter(F.array_except(r, F.array(*[F.lit(g) for g in GENERIC_ROOTS])), lambda x: F.length(x) >= 3)


# What counts as a citation marker.
CITATIONS = (
    r"\[\d+(?:\s*[,;–-]\s*\d+)*\]",
    r"\([A-Z][A-Za-z'’-]+(?:\s+(?:et\s+al\.?|and|&)\s+[A-Za-z'’.-]+)*,?\s+(?:19|20)\d{2}[a-z]?\)",
    r"(?i)\bet\s+al\.?",
    r"(?i)\((?:e\.g\.|cf\.)[^)]*\)",
)


def citation_density(c: Column) -> Column:
    """Citation markers per 100 words."""
    marks = F.lit(0)
    for p in CITATIONS:
        marks = marks + F.regexp_count(c, F.lit(p))
    words = F.greatest(F.lit(1), F.regexp_count(F.lower(c), F.lit("[a-z0-9][a-z0-9'-]*")))
    return F.lit(100.0) * marks / words
