"""Keywords of a change, from phrases in channels. Everything is done within a row, on arrays.

A phrase's terms are its words without the stop words. Null arrays count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import PATH_WORDS, SYNTAX_WORDS, WEAK_WORDS, identifier_words

_STOP = sorted({*SYNTAX_WORDS, *PATH_WORDS, *WEAK_WORDS})


def terms(phrase: Column) -> Column:
    stop = F.array(*map(F.lit, _STOP))
    return F.array_distinct(F.filter(identifier_words(phrase), lambda w: (F.char_length(w) > 1) & ~F.array_contains(stop, w)))


def _empty() -> Column:
    return F.array().cast("array<struct<p: string, t: array<string>>>")


def _with_terms(phrases: Column) -> Column:
    return F.filter(F.transform(F.coalesce(phrases, F.array().cast("array<string>")), lambda p: F.struct(p.alias("p"), terms(p).alias("t"))), lambda x: F.size(x["t"]) > 0)


def _kept(phrases: Column, refused, most: int | None = None) -> Column:
    """The phrases that `refused(new, kept)` doesn't refuse against any kept before, in order."""

    def step(kept: Column, x: Column) -> Column:
        stop = F.exists(kept, lambda k: refused(x["t"], k["t"]))
        if most is not None:
            stop = stop | (F.size(kept) >= most)
        return F.when(stop, kept).otherwise(F.concat(kept, F.array(x)))

    return F.transform(F.aggregate(_with_terms(phrases), _empty(), step), lambda x: x["p"])


def apart(phrases: Column, most: int = 4) -> Column:
    """Phrases of which no two have more than one term in common, greedily from the first."""
    return _kept(phrases, lambda new, old: F.size(F.array_intersect(new, old)) > 1, most)


def longest_first(phrases: Column) -> Column:
    """By number of terms, most first, then by text."""
    keyed = F.transform(_with_terms(phrases), lambda x: F.struct((-F.size(x["t"])).alias("n"), x["p"].alias("p")))
    return F.transform(F.array_sort(keyed), lambda x: x["p"])


def _redundant(new: Column, old: Column) -> Column:
    same = F.size(F.array_intersect(new, old))
    return (
        F.when((same == F.size(new)) & (same == F.size(old)), True)
        .when((F.size(new) == 1) & (same == 1), True)
        .when((F.size(old) == 1) & (same == 1), False)
        .otherwise(same > 1)
    )


def channel(keywords: Column) -> Column:
    """Lower case, without stop words and without what says no more than a keyword before it."""
    clean = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.lower(F.trim(k)))
    return _kept(F.filter(clean, lambda k: (k != "") & ~k.isin(_STOP)), _redundant)


def interleaved(lists: Column) -> Column:
    """The items of several lists in turn: the first of each, then the second of each, and so on."""
    none = F.array().cast("array<string>")
    longest = F.aggregate(lists, F.lit(0), lambda n, x: F.greatest(n, F.size(F.coalesce(x, none))))
    turns = F.transform(F.sequence(F.lit(0), F.greatest(longest - 1, F.lit(0))), lambda i: F.transform(lists, lambda x: F.get(F.coalesce(x, none), i)))
    return F.filter(F.flatten(turns), lambda x: x.isNotNull())


def assembled(supporting: Column, symbols: Column, dependencies: Column, limit: int = 24, symbol_count: Column | None = None, dependency_cap: int = 8) -> Column:
    """The supporting channel up to its limit, all symbols, then as many dependencies as there are symbols, up to a cap; each once."""
    n = F.least(F.lit(dependency_cap), F.size(symbols) if symbol_count is None else symbol_count)
    return F.array_distinct(F.concat(F.slice(channel(supporting), 1, limit), symbols, F.slice(channel(dependencies), 1, F.greatest(n, F.lit(0)))))


def expanded(symbol: Column) -> Column:
    """The words of a symbol and the parts between its dots, sorted."""
    parts = F.filter(F.split(symbol, "\\."), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.transform(parts, F.lower), identifier_words(symbol)), lambda x: F.char_length(x) > 1)))
