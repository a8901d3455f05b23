"""Ranked full-text results: the best documents by BM25, and what to show of them.

A term is a word, a phrase or the beginning of a word; how often a document has it is read from the
index (``search``), how long documents are from a table of lengths (doc, tokens).  The score is

    sum over terms of idf * f * (K1 + 1) / (f + K1 * (1 - B + B * tokens / average))
    idf = ln((n - m + 0.5) / (m + 0.5)), LEAST_IDF at least

with n documents, of which m have the term; f counts each occurrence by the weight of its field.
Scores are rounded to six digits, so equal ones are equal everywhere, and ties go to the least doc.

``best`` needs the lengths of few documents only: with the shortest length of a range of documents
in place of its own, a document's score can't be less than what it is, so the best by that bound
are scored exactly, and then only those whose bound reaches the worst of these.

``highlight`` and ``snippet`` are column expressions over the texts that are shown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import written
from . import search
from .search import Term

# The parameters of the score.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Documents of one range of the bounds.
RANGE = 65_536
WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{Mn}]*"


def lengths(table: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """doc, tokens: how many tokens each document has in all its fields."""
    tokens = reduce(lambda a, b: a + b, [F.size(search.tokens(F.col(c))) for c in columns])
    return table.select(F.col(id_column).alias("doc"), tokens.cast("long").alias("tokens"))


def extents(docs: DataFrame) -> DataFrame:
    """range, docs, tokens, least: how many documents each range has, their tokens, and those of the shortest."""
    return docs.groupBy(F.floor(F.col("doc") / RANGE).alias("range")).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.min("tokens").alias("least"))


def frequencies(index: DataFrame, terms: list[Term], weights: dict[str, float] | None = None) -> DataFrame:
    """doc, f0, f1 and so on of the documents that have any term: how often each has it, by the weights of the fields (1 where none is given)."""
    exact = sorted({w for t in terms for w in t.words[: len(t.words) - t.prefix]})
    begun = sorted({t.words[-1] for t in terms if t.prefix})
    wanted = [F.col("term").isin(exact)] * bool(exact) + [F.col("term").startswith(w) for w in begun]
    rows = index.filter(reduce(lambda a, b: a | b, wanted))
    place = {}
    for i, t in enumerate(terms):
        for k, w in enumerate(t.words):
            mine = F.col("term").startswith(w) if t.prefix and k == len(t.words) - 1 else F.col("term") == w
            place[f"p{i}_{k}"] = F.flatten(F.collect_list(F.when(mine, F.col("places"))))
    fields = rows.groupBy("doc", "field").agg(*[c.alias(n) for n, c in place.items()])
    weight = reduce(lambda c, f: c.when(F.col("field") == f[0], float(f[1])), (weights or {}).items(), F.when(F.lit(False), 1.0)).otherwise(1.0)

    def often(i: int, t: Term) -> Column:
        at = F.col(f"p{i}_0")
        for k in range(1, len(t.words)):
            at = F.array_intersect(at, F.transform(F.col(f"p{i}_{k}"), search._back(k)))
        return F.sum(F.size(at) * weight).alias(f"f{i}")

    found = fields.groupBy("doc").agg(*[often(i, t) for i, t in enumerate(terms)])
    return found.filter(reduce(lambda a, b: a | b, [F.col(f"f{i}") > 0 for i in range(len(terms))]))


def _score(idf: list[float], tokens: Column, average: float) -> Column:
    parts = [F.lit(w) * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * tokens / average)) for i, w in enumerate(idf)]
    return F.round(reduce(lambda a, b: a + b, parts), 6)


def best(index: DataFrame, docs: DataFrame, text: str, k: int = 25, weights: dict[str, float] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """doc, score of the ``k`` best documents that have every term, the best first; none for a text without words.

    ``sizes``: the extents of ``docs``, if they are kept."""
    import math

    terms = search.parse(text)
    nothing = docs.limit(0).select("doc", F.lit(0.0).alias("score"))
    if terms is None:
        return nothing
    found = written(frequencies(index, terms, weights), "frequencies")
    sizes = sizes if sizes is not None else written(extents(docs), "extents")
    n, tokens = sizes.agg(F.sum("docs"), F.sum("tokens")).first()
    had = found.agg(*[F.count_if(F.col(f"f{i}") > 0) for i in range(len(terms))]).first()
    if not n or not min(had):
        return nothing
    idf = [max(math.log((n - m + 0.5) / (m + 0.5)), LEAST_IDF) if n - m + 0.5 > 0 else LEAST_IDF for m in had]
    average = max(tokens, 1) / n
    every = found.filter(reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in range(len(terms))]))
    # A rounded bound may be less than a rounded score by no digit, as rounding keeps the order.
    bounded = every.withColumn("range", F.floor(F.col("doc") / RANGE)).join(sizes.select("range", "least"), "range")
    bounded = bounded.withColumn("bound", _score(idf, F.col("least"), average))

    def scored(rows: DataFrame) -> DataFrame:
        return rows.join(docs.select("doc", "tokens"), "doc").select("doc", _score(idf, F.col("tokens"), average).alias("score"))

    first = scored(bounded.orderBy(F.desc("bound"), "doc").limit(k)).agg(F.count("*"), F.min("score")).first()
    if first[0] >= k:
        bounded = bounded.filter(F.col("bound") >= first[1])
    return scored(bounded).orderBy(F.desc("score"), "doc").limit(k)


# --- what is shown ------------------------------------------------------------------------------------


def _flags(words: Column, terms: list[Term]) -> Column:
    """Of each word of a text, folded, whether it belongs to an occurrence of a term."""

    def hit(word: Column, j: Column) -> Column:
        found = F.lit(False)
        for t in terms:
            for o in range(len(t.words)):  # the word is the o-th of the term
                here = F.lit(True)
                for k, w in enumerate(t.words):
                    at = word if k == o else F.get(words, j - o + k)
                    same = at.startswith(w) if t.prefix and k == len(t.words) - 1 else at == w
                    here = here & F.coalesce(same, F.lit(False))
                found = found | here
        return found

    return F.transform(words, hit)


def _pieces(column: Column) -> tuple[Column, Column, Column]:
    """The words of a text as they stand, the same folded, and what is between them (one more than words)."""
    text = F.coalesce(column, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return words, F.transform(words, search.plain), F.split(text, WORD, -1)


def _joined(words: Column, gaps: Column, flags: Column, start: Column, stop: Column, marks: tuple[str, str, str]) -> Column:
    """Words start to stop with what is between them; runs of flagged words stand between marks."""
    opened, closed, more = marks
    at = lambda a, i: F.get(a, i)
    flag = lambda i: F.coalesce(F.get(flags, i), F.lit(False))

    def one(j: Column) -> Column:
        before = F.when(flag(j) & ((j == start) | ~flag(j - 1)), opened).otherwise("")
        after = F.when(flag(j) & ((j == stop - 1) | ~flag(j + 1)), closed).otherwise("")
        return F.concat(F.when(j == start, "").otherwise(at(gaps, j)), before, at(words, j), after)

    body = F.array_join(F.transform(F.when(stop > start, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<int>")), one), "")
    head = F.when(start > 0, more).otherwise(at(gaps, F.lit(0)))
    tail = F.when(stop < F.size(words), more).when(F.size(words) == 0, "").otherwise(at(gaps, F.size(words)))
    return F.concat(head, body, tail)


def _over(table: DataFrame, column: str) -> DataFrame:
    words, folded, gaps = _pieces(F.col(column))
    return table.select("*", words.alias("__words"), folded.alias("__folded"), gaps.alias("__gaps"))


def highlight(table: DataFrame, column: str, text: str, out: str, marks: tuple[str, str] = ("[", "]")) -> DataFrame:
    """The table with ``out``: the column's text with marks around each run of words that belong to a term."""
    rows = _over(table, column)
    rows = rows.withColumn("__flags", _flags(F.col("__folded"), search.parse(text) or []))
    shown = _joined(F.col("__words"), F.col("__gaps"), F.col("__flags"), F.lit(0), F.size("__words"), (*marks, ""))
    return rows.select(*[F.col(f"`{c}`") for c in table.columns], F.when(F.col(column).isNotNull(), shown).alias(out))


def snippet(table: DataFrame, column: str, text: str, out: str, words: int = 16, marks: tuple[str, str, str] = ("[", "]", "…")) -> DataFrame:
    """The table with ``out``: those ``words`` words of the text, from the first that most words of terms are among, with marks and an ellipsis where text is left out."""
    rows = _over(table, column).withColumn("__flags", _flags(F.col("__folded"), search.parse(text) or []))
    # Places of flagged words; a window from the i-th has the next m of them if the m-th is near enough.
    rows = rows.withColumn("__hits", F.filter(F.transform("__flags", lambda f, i: F.when(f, i)), lambda i: i.isNotNull()))
    hit = lambda i: F.get("__hits", i)
    within = lambda i: F.size(F.filter(F.sequence(F.lit(0), F.lit(words - 1)), lambda m: F.coalesce(hit(i + m) < hit(i) + words, F.lit(False))))
    richest = F.array_max(F.transform("__hits", lambda h, i: F.struct(within(i).alias("n"), (-h).alias("at"))))
    last = F.greatest(F.size("__words") - words, F.lit(0))
    rows = rows.withColumn("__start", F.least(F.coalesce(-richest["at"], F.lit(0)), last))
    rows = rows.withColumn("__stop", F.least(F.col("__start") + words, F.size("__words")))
    shown = _joined(F.col("__words"), F.col("__gaps"), F.col("__flags"), F.col("__start"), F.col("__stop"), marks)
    return rows.select(*[F.col(f"`{c}`") for c in table.columns], F.when(F.col(column).isNotNull(), shown).alias(out))
