"""Column expressions that turn a text into words and n-grams, built from Spark functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters, marks, digits and underscores, joined by single apostrophes or full stops.
# The possessive quantifiers match the same words as plain ones, but keep the regex engine
# from recursing once per joint on a long dotted run.
_RUN = r"[\p{L}\p{M}\p{N}_]"
TOKEN = rf"{_RUN}++(?:['’.]{_RUN}++)*+"

# Scripts written without spaces, whose letters are words of one letter each, as no
# boundary between words can be told without a dictionary: ideographs, Hiragana, and the letters of Thai,
# Lao, Myanmar and Khmer; and the signs of Katakana, whose runs are words.
_SINGLE = (
    r"\p{IsHan}\p{IsHiragana}\u0E01-\u0E30\u0E32\u0E33\u0E40-\u0E46\u0E81-\u0EB0\u0EB2\u0EB3\u0EBD\u0EC0-\u0EC6\u0EDC-\u0EDF"
    r"\u1000-\u102A\u103F\u1050-\u1055\u1780-\u17B3\u17D7\u17DC"
)
_KATAKANA = r"\p{IsKatakana}\u30A0\u30FC\uFF70\u3031-\u3035\u309B\u309C"

# Closer to the Unicode word boundaries: a joint needs letters on both sides or digits on both
# sides, digits may also be joined by commas and semicolons, and underscores alone are no word. Marks
# stay with what they follow.
_JOINT = r"(?:(?<=[\p{L}\p{M}])['’‘.·‧](?=\p{L})|(?<=\p{N})['’‘.,;](?=\p{N}))"
# Names of ASCII letters and digits, a look at what a joint can be, and one at what is not ASCII come first: they match
# nothing else, and spare most characters the search for their script.
_LETTER = rf"a-z0-9[\p{{L}}\p{{M}}\p{{N}}&&[^{_SINGLE}{_KATAKANA}]]"
_SPACED = rf"[_{_LETTER}]"
# Plain quantifiers run faster over letters, and nothing that follows a word makes it shorter.
_SPACED_WORD = rf"_*+[{_LETTER}]{_SPACED}*(?:(?=['’‘.·‧,;]){_JOINT}{_SPACED}+)*+"
UAX_TOKEN = rf"{_SPACED_WORD}|(?=[^\x00-\x7F])(?:[{_SINGLE}]\p{{M}}*+|(?:[{_KATAKANA}]\p{{M}}*+)++)"

_PATTERNS = {"plain": TOKEN, "uax": UAX_TOKEN}


def words(text: Column | str, mode: str = "uax") -> Column:
    """Lower-case words of ``text`` in order, as an array.

    A null text gives one null word, an empty text none. Pass the expression straight to
    ``explode``: under an alias of its own, Catalyst would evaluate it again in a size filter.
    """
    column = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.lower(column), F.lit(_PATTERNS[mode]), F.lit(0))
    return F.coalesce(found, F.array(F.lit(None).cast("string")))


def ngrams(tokens: Column, n: int, short: str = "drop") -> Column:
    """Runs of ``n`` neighbouring words as an array of structs, overlapping.

    With ``short='null'`` a text of fewer words gives one n-gram of nulls, else none.
    """
    length = F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0))
    runs = F.arrays_zip(*[F.slice(tokens, start, length) for start in range(1, n + 1)])
    if short == "drop":
        return runs
    if short != "null":
        raise ValueError(f"short is 'drop' or 'null', not {short!r}")
    nothing = F.arrays_zip(*[F.array(F.lit(None).cast("string"))] * n)
    return F.when(F.size(tokens) >= n, runs).otherwise(nothing)


def runs_of_equals(ordered: Column) -> Column:
    """Runs of equal elements of a sorted array, as an array of structs (element, length)."""
    last = F.size(ordered) - F.lit(1)
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(
        places, lambda at: (at == 0) | ~F.get(ordered, at).eqNullSafe(F.get(ordered, at - F.lit(1)))
    )
    after = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))), F.array(F.size(ordered)))
    return F.zip_with(
        starts, F.slice(after, F.lit(1), F.size(starts)), lambda at, end: F.struct(F.get(ordered, at).alias("word"), (end - at).cast("long").alias("n"))
    )
