"""Text operators as Column expressions: cleaning, tokens, chapter headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers, token pattern, heading vocabulary.
START_MARKER = r"(?i)\*\*\*\s*START OF (THE|THIS) PROJECT GUTENBERG"
END_MARKER = r"(?i)\*\*\*\s*END OF (THE|THIS) PROJECT GUTENBERG"
TOKEN = r"""[A-Za-z0-9'\-]+|[.,!?;:"()\[\]]"""
ORDINALS = [
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen",
    "eighteen", "nineteen", "twenty", r"twenty[-\s]one", r"twenty[-\s]two",
    r"twenty[-\s]three", r"twenty[-\s]four", r"twenty[-\s]five",
    r"twenty[-\s]six", r"twenty[-\s]seven", r"twenty[-\s]eight",
    r"twenty[-\s]nine", "thirty", r"thirty[-\s]one", r"thirty[-\s]two",
    "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "one hundred",
]
ROMAN = r"M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})"
#: Only a line feed ends a line (d); case-insensitive, multi-line, Unicode classes.
HEADING = rf"(?imdU)^\s*(?:chapter|chap\.?)\s+(?:\d{{1,3}}|{ROMAN}(?!\w)|(?:{'|'.join(ORDINALS)}))[\s.:\-–—]*(?:.*)?$"
#: White space as Unicode has it, and the separators that count as space in text handling.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_MARK = "\x01"


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def strip_markers(text: Column) -> Column:
    """What stands after the line of the first start marker and before the first end marker.

    A start marker on a line that never ends leaves nothing, as does an end before the start.
    """
    start, end = F.regexp_instr(text, F.lit(START_MARKER)), F.regexp_instr(text, F.lit(END_MARKER))
    line_end = F.call_function("locate", F.lit("\n"), text, F.greatest(start, F.lit(1)))
    begin = F.when(start == 0, 1).when(line_end == 0, F.length(text) + 1).otherwise(line_end + 1)
    stop = F.when(end == 0, F.length(text) + 1).otherwise(end)
    return F.substring(text, begin, F.greatest(stop - begin, F.lit(0)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def normalize_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"{SPACE}+", " "))


def remove_non_printable(text: Column) -> Column:
    """Delete control characters but for line feed and tab; deleted, not spaced."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "")


def clean_chapter_text(text: Column) -> Column:
    return normalize_whitespace(remove_non_printable(text))


def tokenize(text: Column) -> Column:
    """array<string> of lower-case tokens."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def clean_tokens(text: Column) -> Column:
    """`tokenize` of `clean_chapter_text`: white space is in no token and runs of it part tokens as one space does, so only what is deleted matters."""
    return tokenize(remove_non_printable(text))


def token_rows(text: Column) -> Column:
    """Generator twin of `tokenize`: pos, tok."""
    return F.posexplode(tokenize(text)).alias("pos", "tok")


def chapter_parts(text: Column) -> Column:
    """array<string>: the preamble, then the text from each heading to the next."""
    return F.split(F.regexp_replace(text, HEADING, _MARK + "$0"), _MARK, -1)


def chapter_number(path: Column) -> Column:
    """The number after the last ``_ch`` of a file's stem; null where it is none."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.regexp_extract(stem, r"_ch([^_]*)$", 1).try_cast("int")


def context(tokens: Column, centre: Column, half: Column) -> Column:
    """Tokens from ``half`` before the centre to ``half`` after it, joined by spaces."""
    low = F.greatest(centre - half, F.lit(0))
    high = F.least(F.size(tokens), centre + half + 1)
    return F.array_join(F.slice(tokens, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")), " ")


def pieces(tokens: Column, size: int, before: int = 0, after: int = 0) -> Column:
    """array<struct<stretch, first, tokens>>: stretches of ``size`` positions, each with tokens of its neighbours on both sides; ``first`` is the position of its first token.

    Exploded, they let a long text be many rows of bounded size. No tokens (or null) give no pieces.
    """
    n = F.size(tokens)
    first = lambda i: F.greatest(i * size - before, F.lit(0)).cast("int")
    piece = lambda i: F.struct(i.cast("bigint").alias("stretch"), first(i).cast("bigint").alias("first"), F.slice(tokens, first(i) + 1, (i * size + size + after - first(i)).cast("int")).alias("tokens"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / size).cast("int") - 1, F.lit(0))), piece)
    return F.when(n > 0, cut).otherwise(F.slice(cut, 1, 0))
