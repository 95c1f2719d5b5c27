"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns of the headings, clauses, hierarchy markers and citations that results depend on.
HEADING = r"(?:SECTION|SEC\.)\s+(\d+[A-Za-z]?)\."
RESOLVED = r"(?<![A-Za-z])Resolved"
CLAUSE = r"(?<![A-Za-z0-9])\((\d+)\)"
AMENDMENT = r"(?i)amendment to the Constitution"
AMENDMENT_SECTION = r"(?<![A-Za-z])Section\s+(\d+[A-Za-z]?)\."
MARKER = r"(?<![A-Za-z])(DIVISION\s+(?:[IVXLC]+|[0-9]+|[A-Z])|TITLE\s+(?:[IVXLC]+|[0-9]+)|Subtitle\s+[A-Z]|PART\s+(?:[IVXLC]+|[0-9]+|[A-Z])|CHAPTER\s+(?:[IVXLC]+|[0-9]+|[A-Z]))"
US_CODE = r"(\d{1,2})\s*U\.?\s?S\.?\s?C\.?\s*(?:§+\s?)?(\d+[A-Za-z0-9]*)"
US_CODE_SPACED = r"(\d{1,2})\s+U\.?\s?S\.?\s?C\.?\s?(?:§+\s?)?(\d+[A-Za-z0-9]*)"
PUBLIC_LAW = r"[Pp]ub(?:lic)?\.?\s?L(?:aw)?\.?\s?(\d{1,3}[-–]\d{1,4})"
NAMED_ACT = r"([A-Z][A-Za-z']+(?:\s+[A-Z][A-Za-z']+){0,5})\s+Act\s+of\s+(\d{4})"

# Words that are no terms.
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "by", "with", "as", "at", "from", "is", "are", "be", "shall", "may", "not", "this",
    "that", "such", "any", "section", "sec", "subsection", "paragraph", "subparagraph", "clause", "act", "code", "title", "united", "states",
    "public", "law", "amended", "amend", "following", "under", "pursuant", "chapter", "part", "subtitle", "provided", "including", "include", "means",
    "term", "house", "senate", "congress", "bill", "resolution", "date", "effective", "whoever", "person", "rule",
)

#: The labels of a stored format, each by its name.
FORMATS = {"formatted xml": "FormattedXml", "formatted text": "FormattedText", "pdf": "Pdf"}


def trimmed(c: Column) -> Column:
    """Without white space and control characters at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def collapsed(c: Column) -> Column:
    """Trimmed, each run of white space one blank."""
    return F.regexp_replace(trimmed(c), r"\s+", " ")


def text_format(c: Column) -> Column:
    """The format a label names, whatever its case and blanks around it; else ``Other``."""
    key, out = F.lower(trimmed(c)), F.lit("Other")
    for label, name in FORMATS.items():
        out = F.when(key == label, F.lit(name)).otherwise(out)
    return out


def is_pdf(c: Column) -> Column:
    """Whether the content is a PDF file's bytes."""
    return F.regexp_replace(c, r"^\s+", "").startswith("%PDF")


def heading_ids(c: Column) -> Column:
    """The section numbers of all headings, in order."""
    return F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z])" + HEADING), F.lit(1))


def nesting_level(marker: Column) -> Column:
    """0 division, 1 title, 2 subtitle, 3 part, 4 chapter."""
    out = F.lit(4)
    for level, word in ((3, "PART"), (2, "Subtitle"), (1, "TITLE"), (0, "DIVISION")):
        out = F.when(marker.startswith(word), F.lit(level)).otherwise(out)
    return out


#: A run of three letters and more that is no stopword; one pattern, so that no word is compared with a list.
_UNIGRAM = "(?<![a-z])(?!(?:" + "|".join(STOPWORDS) + ")(?![a-z]))[a-z]{3,}"


def unigrams(c: Column) -> Column:
    """Lower-case words of three letters and more without the stopwords, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(_UNIGRAM), F.lit(0))


def bigrams_of(words: Column) -> Column:
    """Adjacent pairs of words joined by ``_``."""
    n = F.size(words)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(1))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(1))), lambda a, b: F.concat_ws("_", a, b)))


def tokens(c: Column) -> Column:
    """Unigrams, then their bigrams."""
    u = unigrams(c)
    return F.concat(u, bigrams_of(u))


def citations(c: Column, strict: bool = False) -> Column:
    """Distinct keys of the statutes a text cites.

    ``strict`` wants a blank before the code's name, writes a law's dash as a hyphen and keeps an act's year.
    """
    code = US_CODE_SPACED if strict else US_CODE
    pair = lambda p: F.arrays_zip(F.regexp_extract_all(c, F.lit(p), F.lit(1)).alias("a"), F.regexp_extract_all(c, F.lit(p), F.lit(2)).alias("b"))
    laws = F.transform(F.regexp_extract_all(c, F.lit(PUBLIC_LAW), F.lit(1)), lambda x: F.concat(F.lit("pl:"), F.translate(x, "–", "-") if strict else x))
    acts = F.transform(pair(NAMED_ACT), lambda x: F.concat(F.lit("act:"), F.lower(x["a"]), F.concat(F.lit(":"), x["b"]) if strict else F.lit("")))
    codes = F.transform(pair(code), lambda x: F.concat(F.lit("usc:"), x["a"], F.lit(":"), x["b"]))
    return F.array_sort(F.array_distinct(F.concat(codes, laws, acts)))


def windows(c: Column, size: int, overlap: int) -> Column:
    """A text's windows of at most ``size`` words, each repeating ``overlap`` words of the one before.

    A text of at most ``size`` words is its only window, unchanged; so is any text if ``size`` is not positive.
    """
    if size <= 0:
        return F.array(c)
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    step = max(1, size - max(0, overlap))
    n = F.size(words)
    count = F.ceil((n - size) / F.lit(step)).cast("int") + 1
    return F.when(n <= size, F.array(c)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.array_join(F.slice(words, k * step + 1, F.lit(size)), " ")))
