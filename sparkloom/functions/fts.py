"""Full-text expressions: sanitising, tokens, term frequencies, boolean match and cover density.

Tokens are maximal runs of ``[a-z0-9_]`` in the lower-cased text; stop words are dropped. There is no stemmer: results are
stated for this tokenizer, not for another engine's dictionaries.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The usual English stop words of full-text engines.
STOP_WORDS = (
    "a about after all also an and any are as at be been but by can could do does for from had has have he her his how i if in into is it its more most no not of on or other our out over "
    "she so some such than that the their them then there these they this those to under up was we were what when which while who will with would you your"
).split()


def sanitize(q: Column) -> Column:
    """Drop query operators, collapse white space, trim."""
    return F.trim(F.regexp_replace(F.regexp_replace(q, r"[&|!():*<>]", " "), r"\s+", " "))


def query_terms(text: str) -> list[str]:
    words = re.findall(r"[a-z0-9_]+", re.sub(r"[&|!():*<>]", " ", text).lower())
    return list(dict.fromkeys(w for w in words if w not in STOP_WORDS))


def tokens(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda x: (x != "") & ~x.isin(STOP_WORDS))
    return F.coalesce(words, F.array().cast("array<string>"))


def term_frequency(text: Column, term: str) -> Column:
    low = F.lower(text)  # the plain search spares most texts the pattern
    return F.when(low.contains(term), F.regexp_count(low, F.lit(rf"{re.escape(term)}(?![a-z0-9_])(?<![a-z0-9_]{re.escape(term)})"))).otherwise(0)


def contains_all(text: Column, terms: list[str]) -> Column:
    """Boolean AND match; an empty query matches nothing."""
    if not terms:
        return F.lit(False)
    out = term_frequency(text, terms[0]) > 0
    for t in terms[1:]:
        out = out & (term_frequency(text, t) > 0)
    return out


def cover_density(text: Column, terms: list[str]) -> Column:
    """Sum over minimal covers of 0.1 / (1 + noise); noise is the number of other tokens within the cover.

    One term: 0.1 times its frequency, a built-in expression. Several: an Arrow UDF over the rows that hold all of them.
    """
    if not terms:
        return F.lit(0.0)
    if len(terms) == 1:
        return term_frequency(text, terms[0]) * F.lit(0.1)
    want = set(terms)

    @F.pandas_udf("double")
    def rank(s: pd.Series) -> pd.Series:
        return s.map(lambda t: covers(t, want))

    return F.when(contains_all(text, terms), rank(text)).otherwise(F.lit(0.0))


def covers(text: str | None, want: set[str]) -> float:
    places = [(i, w) for i, w in enumerate(w for w in re.findall(r"[a-z0-9_]+", (text or "").lower()) if w not in STOP_WORDS) if w in want]
    total, count, left = 0.0, {}, 0
    for i, w in places:
        count[w] = count.get(w, 0) + 1
        while count[places[left][1]] > 1:
            count[places[left][1]] -= 1
            left += 1
        if len(count) == len(want):
            total += 0.1 / (1 + i - places[left][0] - (len(want) - 1))
            count.pop(places[left][1])  # the next cover starts behind this one's first term
            left += 1
    return total
