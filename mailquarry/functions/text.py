"""Column expressions over text: term tests, word and sentence counts.

Word classes are spelled out so that results do not depend on an engine's idea of ``\\w``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as a character class body
SPACE = (r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
# the part of it that is ASCII; a much faster class to test
ASCII_SPACE = r"\x{09}-\x{0d}\x{1c}-\x{20}"
SENTENCE_END = "[.!?]+"
# letters, digits and underscore in any script
WORD_CHARS = r"\p{L}\p{N}_"


def add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def has(text: Column, term: str) -> Column:
    return F.contains(text, F.lit(term))


def has_any(text: Column, terms: list[str]) -> Column:
    """True when at least one term occurs in the text."""
    return any_of([has(text, t) for t in terms])


def mentions(text: Column, terms: list[str]) -> Column:
    """Like ``has_any`` for short texts such as hosts and file names: one pattern for all terms."""
    return text.rlike("|".join(rf"\Q{t}\E" for t in terms))


def texts(values: list[str]) -> Column:
    """A literal array of strings."""
    return F.expr("array(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")")


def term_hits(text: Column, terms: list[str]) -> Column:
    """How many distinct terms occur in the text."""
    return add([has(text, t).cast("int") for t in terms])


def matched_terms(text: Column, terms: list[str]) -> Column:
    """The terms that occur in the text, in list order."""
    return F.array_compact(F.array(*[F.when(has(text, t), F.lit(t)) for t in terms]))


def occurrences(text: Column, piece: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))


def plain_spaces(text: Column) -> Column:
    """True when only ASCII white space can occur, so that the short class is enough.

    Make it a column of its own.
    """
    ascii_only = F.octet_length(text) == F.length(text)
    # one range that covers all the wider spaces: quick to test, and a false alarm costs only time
    return ascii_only | ~text.rlike(r"[\x{85}\x{a0}\x{1680}-\x{3000}]")


def single_spaced(text: Column, plain: Column) -> Column:
    """The words with one space between them; ``plain`` as of :func:`plain_spaces`.

    Make it a column of its own. Single spaces, the most common, are no match, so little is replaced.
    """
    def runs(space: str) -> str:
        return f"[{space}]{{2,}}|[{space.replace('{20}', '{1f}')}]"

    return F.trim(F.when(plain, F.regexp_replace(text, runs(ASCII_SPACE), " ")).otherwise(F.regexp_replace(text, runs(SPACE), " ")))


def word_letters(spaced: Column) -> Column:
    """Characters that are not white space, of a text from :func:`single_spaced`."""
    return F.length(F.replace(spaced, F.lit(" "), F.lit("")))


def word_count(spaced: Column, letters: Column) -> Column:
    """Words of a text from :func:`single_spaced` with so many letters."""
    return F.when(letters > 0, F.length(spaced) - letters + 1).otherwise(0)


def sentence_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SENTENCE_END)) + 1


def ascii_words(text: Column) -> Column:
    """Words made of a-z only; words with digits, accents or underscores are left out."""
    pieces = F.split(text, f"[^{WORD_CHARS}]+")
    return F.filter(pieces, lambda w: w.rlike("^[a-zA-Z]+$"))


def clamp(score: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(score, F.lit(low)), F.lit(high))


def cap(score: Column) -> Column:
    return F.least(score, F.lit(1.0))


def flags(*pairs: tuple[Column, str]) -> Column:
    """The labels whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(label)) for c, label in pairs]))
