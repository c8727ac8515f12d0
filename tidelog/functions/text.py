"""Text functions of fuzzy search, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD = "\U0010ffff"

# Lower-case Latin letters with a mark, by the plain letter they fold to.
FOLDS = {
    "a": "àáâãäåāăą",
    "c": "çćĉċč",
    "d": "ðďđ",
    "e": "èéêëēĕėęě",
    "g": "ĝğġģ",
    "h": "ĥħ",
    "i": "ìíîïĩīĭįı",
    "j": "ĵ",
    "k": "ķĸ",
    "l": "ĺļľŀł",
    "n": "ñńņňŋŉ",
    "o": "òóôõöøōŏő",
    "r": "ŕŗř",
    "s": "śŝşšſ",
    "t": "ţťŧ",
    "u": "ùúûüũūŭůűų",
    "w": "ŵ",
    "y": "ýÿŷ",
    "z": "źżž",
}
EXPANSIONS = {"æ": "ae", "þ": "th", "ß": "ss", "ĳ": "ij", "œ": "oe"}


def normalize(text: Column, fold: str = "latin") -> Column:
    """Lower-cased, runs of Unicode white space as one space, trimmed; ``latin`` folds marks and ligatures."""
    if fold not in ("latin", "none"):
        raise ValueError(f"unknown fold {fold!r}")
    out = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    if fold == "latin":
        out = F.translate(out, "".join(FOLDS.values()), "".join(k * len(v) for k, v in FOLDS.items()))
        for letter, two in EXPANSIONS.items():
            out = F.replace(out, F.lit(letter), F.lit(two))
    return out


def grams(text: Column, n: int = 3) -> Column:
    """The set of windows of n characters over the text with n - 1 pads at both ends."""
    if n < 2:
        raise ValueError("grams need n of 2 or more")
    padded = F.concat(F.lit(PAD * (n - 1)), text, F.lit(PAD * (n - 1)))
    # an empty pattern splits into characters; substring() would count from the start for each window
    letters = F.split(padded, "")
    windows = F.size(letters) - (n - 1)
    out = F.slice(letters, 1, windows)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(letters, k, windows), lambda a, b: F.concat(a, b))
    return F.array_distinct(out)


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of two arrays as sets; 1 for two empty ones."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def containment(query: Column, record: Column) -> Column:
    """|query & record| / |query|; 1 for an empty query."""
    return F.when(F.size(query) == 0, 1.0).otherwise(F.size(F.array_intersect(query, record)) / F.size(F.array_distinct(query)))


def length_gap(a: Column, b: Column) -> Column:
    """Difference of lengths, each of which is kept in one byte."""
    return F.abs(F.least(F.char_length(a), F.lit(255)) - F.least(F.char_length(b), F.lit(255)))


def gram_threshold(mode: str, amount: float, total: Column, n: int = 3) -> Column:
    """Shared grams that a candidate needs, out of ``total`` grams of the query."""
    if mode == "distance":
        return F.greatest(F.lit(0), total - int(n * amount))
    return F.least(F.greatest(F.lit(1), F.ceil(total * amount).cast("int")), total)
