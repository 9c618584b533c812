"""Text expressions (T01-T10) as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_whitespace(c: Column) -> Column:
    """Runs of whitespace to one blank."""
    return F.regexp_replace(c, r"\s+", " ")


def scrub_pattern(words: list[str] | None = None, caseless: list[str] | None = None) -> str:
    """T01 pattern: whole words of the list; the first letter is case-free, and every letter of the
    ``caseless`` words. ``(?U)`` makes ``\\b`` Unicode-aware on every JVM.

    Alternatives are grouped by their (case-free) first letter, in list order within a group: the
    same language as the flat alternation, but the engine only explores the branch whose first
    letter matches.
    """
    from minpair.plans.dims import SCRUB_FULLY_CASELESS, SCRUB_WORDS
    words = SCRUB_WORDS if words is None else words
    caseless = SCRUB_FULLY_CASELESS if caseless is None else caseless

    def letter(ch: str) -> str:
        return f"[{ch.upper()}{ch.lower()}]" if ch.isalpha() else ch

    groups: dict[str, list[str]] = {}
    for w in words:
        rest = "".join(letter(ch) for ch in w[1:]) if w in caseless else w[1:]
        groups.setdefault(w[0].lower(), []).append(rest)
    alts = [letter(first) + "(?:" + "|".join(rests) + ")" for first, rests in groups.items()]
    return r"(?U)\b(?:" + "|".join(alts) + r")\b"


def scrub(c: Column, replacement: str = "_", pattern: str | None = None) -> Column:
    """Replace every listed gendered word by ``replacement``."""
    return F.regexp_replace(c, pattern or scrub_pattern(), replacement)


def scrub_count(c: Column, pattern: str | None = None) -> Column:
    """Number of replacements ``scrub`` makes in ``c`` (0 for NULL)."""
    return F.coalesce(F.regexp_count(c, F.lit(pattern or scrub_pattern())), F.lit(0)).cast("int")


def format_text(body: Column, title: Column) -> Column:
    """Body followed by title, no separator (NULL if either is NULL)."""
    return F.concat(body, title)


PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def punctuation_to_spaces(c: Column) -> Column:
    """Trim, punctuation to blanks, runs of blanks squeezed (an edge blank may remain)."""
    return F.regexp_replace(F.translate(F.trim(c), PUNCTUATION, " " * len(PUNCTUATION)), " +", " ")


def word_tokens(c: Column) -> Column:
    """T10 (words): lower-cased tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w\w+\b"), 0)


def char_tokens(c: Column) -> Column:
    """T10 (characters, for zh / ja): lower-cased characters, blank runs squeezed to one."""
    s = F.regexp_replace(F.lower(c), r"\s\s+", " ")
    return F.split(s, "")


def has_han(c: Column) -> Column:
    """Text contains a Han character."""
    return c.rlike(r"\p{IsHan}")
