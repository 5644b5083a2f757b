"""Text scalars: trimming, whitespace, hashes, quality and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() and \s treat as whitespace,
# which neither Java's \s nor SQL trim covers.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same as a character class. Low characters are listed one by one, which
# Java turns into a bit set; the high ones sit behind one range check, so that
# ordinary letters are rejected in two steps.
WS = (
    r"[\t\n\x{0b}\f\r\x{1c}\x{1d}\x{1e}\x{1f} \x{85}\x{a0}"
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
)

# Whitespace that squeezing changes: a run, or one character that is no plain
# space. The single spaces between words do not match, so they cost no rewrite.
_UNEVEN = f"{WS}(?:{WS}+|(?<! ))"

# Markdown patterns and the minimum useful lengths.
MD_IMAGE = r"!\[[^\]]*\]\([^)]*\)"
MD_LINK = r"\[[^\]]*\]\([^)]*\)"
MD_ROUNDS = 3
MIN_CHUNK_CHARS = 80
MIN_PAGE_CHARS = 50
TITLE_MAX_CHARS = 80


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.btrim(c, F.lit(WS_CHARS))


def squeeze(c: Column) -> Column:
    """Collapse each whitespace run to one space."""
    return F.regexp_replace(c, _UNEVEN, " ")


def normalise(c: Column) -> Column:
    """Collapse whitespace and strip."""
    return F.trim(squeeze(c))


def is_blank(c: Column) -> Column:
    return F.length(normalise(c)) == 0


def content_hash(text: Column) -> Column:
    """sha256 of the text exactly as it is."""
    return F.sha2(text, 256)


def chunk_hash(chunk: Column) -> Column:
    """Hash that ignores case and whitespace differences."""
    return normalised_hash(normalise(chunk))


def normalised_hash(normalised: Column) -> Column:
    """The same from text whose whitespace is normalised already; lower-casing
    neither makes nor removes whitespace, so the order of the two is free."""
    return F.sha2(F.lower(normalised), 256)


def without_markdown_links(c: Column) -> Column:
    """Drop images, then links; repeated, so that nested ones go too."""
    plain = c
    for _ in range(MD_ROUNDS):
        plain = F.regexp_replace(plain, MD_IMAGE, "")
        plain = F.regexp_replace(plain, MD_LINK, "")
    # Both patterns need "](", so most text never meets the regexes.
    return F.when(F.contains(c, F.lit("](")), plain).otherwise(c)


def quality_ok(chunk: Column, normalised: Column | None = None) -> Column:
    """Enough text, and enough of it left once links and images are gone.

    Pass the normalised chunk if it is at hand; it serves where there are no links.
    """
    long_enough = F.length(strip(chunk)) >= MIN_CHUNK_CHARS
    plain = normalise(without_markdown_links(chunk))
    if normalised is not None:
        plain = F.when(F.contains(chunk, F.lit("](")), plain).otherwise(normalised)
    return long_enough & (F.length(plain) >= MIN_CHUNK_CHARS)


def prettify(slug: Column) -> Column:
    """'salud-oral' -> 'Salud oral': only the first letter is upper case."""
    spaced = strip(F.replace(slug, F.lit("-"), F.lit(" ")))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substr(spaced, F.lit(2))))


def clean_title(raw: Column, default: str) -> Column:
    """First line of a model's title without quotes, or the default."""
    bare = strip(raw)
    for quote in ('"', "'"):
        bare = F.regexp_replace(bare, f"^{quote}+|{quote}+$", "")
    # The line boundaries Python's str.splitlines() knows.
    first = F.regexp_extract(
        bare, r"^([^\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]*)", 1)
    return F.coalesce(
        F.nullif(F.substring(first, 1, TITLE_MAX_CHARS), F.lit("")), F.lit(default))
