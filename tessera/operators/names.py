"""Kept indexes of names, for pickers: pieces of one to three characters for what a name has in it, and beginnings with their best names.

``grams`` (gram, id) is written in the order of the gram, so a needle reads the row groups of its own
pieces: one piece for a needle of one or two characters, all runs of three for longer ones; names
that have all of them are looked at.  ``beginnings`` (prefix, place, id, name, records, tier) has for
each beginning of up to LONGEST characters the BEST names with it, in the order of a picker (the same
name first, then by records, name and id), so type-ahead reads one row group and sorts nothing.
Both are made of a table of names (id, name, records) and follow its changes.  Names are compared in
lower case, without blanks at the ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE, LONGEST, BEST = 3, 16, 25
#: A beginning's names are cut to the best by so many parts first, so one that very many names have is no task of its own.
PARTS = 64
GRAMS = "gram string, id long"
BEGINNINGS = "prefix string, place int, id long, name string, records long, tier int"


def key(name: Column) -> Column:
    return F.trim(F.lower(name))


def needle(text: str) -> str:
    return text.strip().lower()


def grams(names: DataFrame) -> DataFrame:
    """gram, id: every piece of one to PIECE characters of each name, once."""
    k = key(F.col("name"))
    runs = [F.transform(F.sequence(F.lit(1), F.length("k") - n + 1), _piece(n)) for n in range(1, PIECE + 1)]
    runs = [F.when(F.length("k") >= n, r).otherwise(F.array().cast("array<string>")) for n, r in enumerate(runs, 1)]
    return names.select("id", k.alias("k")).select(F.explode(F.array_distinct(F.concat(*runs))).alias("gram"), "id")


def _piece(n: int):
    return lambda i: F.substring(F.col("k"), i, F.lit(n))


def _put(df: DataFrame, path: str, *order: str) -> DataFrame:
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", 8 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_grams(names: DataFrame, path: str) -> DataFrame:
    return _put(grams(names), path, "gram", "id")


def having(index: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """The rows of ``names`` (id, name and whatever else) whose name has the text in it; all for an empty text."""
    t = needle(text)
    if not t:
        return names
    wanted = sorted({t[i : i + PIECE] for i in range(max(1, len(t) - PIECE + 1))})
    ids = index.filter(F.col("gram").isin(wanted)).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("id")
    return names.join(ids, "id", "left_semi").filter(F.contains(key(F.col("name")), F.lit(t)))


def maintain_grams(index: DataFrame, changed: DataFrame, gone: DataFrame) -> DataFrame:
    """The index after changed names (id, name) and ids that went (id)."""
    touched = changed.select("id").unionByName(gone.select("id")).distinct()
    return index.join(touched, "id", "left_anti").select("gram", "id").unionByName(grams(changed))


# --- beginnings -----------------------------------------------------------------------------------------


def _prefixes(column: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.least(F.length(column), F.lit(LONGEST))), lambda n: F.substring(column, F.lit(1), n))


def beginnings(names: DataFrame, best: int = BEST, only: DataFrame | None = None) -> DataFrame:
    """prefix, place (from 1), id, name, records, tier (3: the whole name, 2: its beginning); ``only``: of these prefixes."""
    k = key(F.col("name"))
    rows = names.select("id", "name", "records", k.alias("k")).filter(F.length("k") > 0)
    rows = rows.select("id", "name", "records", "k", F.explode(_prefixes(F.col("k"))).alias("prefix"))
    if only is not None:
        rows = rows.join(only, "prefix", "left_semi")
    rows = rows.withColumn("tier", F.when(F.col("k") == F.col("prefix"), 3).otherwise(2))
    order = [F.desc("tier"), F.desc("records"), F.asc("name"), F.asc("id")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("prefix", "part").orderBy(*order))).filter(F.col("place") <= best)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("prefix").orderBy(*order))).filter(F.col("place") <= best)
    return rows.select([c.split()[0] for c in BEGINNINGS.split(", ")])


def keep_beginnings(names: DataFrame, path: str, best: int = BEST) -> DataFrame:
    return _put(beginnings(names, best), path, "prefix", "place")


def maintain_beginnings(kept: DataFrame, before: DataFrame, after: DataFrame, touched: DataFrame, best: int = BEST) -> DataFrame:
    """What is kept after the names of some ids (``touched``: id) have changed, come or gone: only the beginnings that they have or had are made anew."""
    had = [t.join(touched, "id", "left_semi").select(F.explode(_prefixes(key(F.col("name")))).alias("prefix")) for t in (before, after)]
    only = reduce(DataFrame.unionByName, had).distinct()
    return kept.join(only, "prefix", "left_anti").select([c.split()[0] for c in BEGINNINGS.split(", ")]).unionByName(beginnings(after, best, only))


def type_ahead(kept: DataFrame, names: DataFrame, text: str, limit: int = BEST) -> DataFrame:
    """id, name, records, tier of the best names that begin with the text; none for an empty text.

    Beginnings of up to LONGEST characters are kept; for a longer one the few names are looked for that have its first part (``names``)."""
    t = needle(text)
    found = kept.filter(F.col("prefix") == t).select("place", "id", "name", "records", "tier")
    if t and (len(t) > LONGEST or limit > BEST):
        k = key(F.col("name"))
        order = [F.desc("tier"), F.desc("records"), F.asc("name"), F.asc("id")]
        rows = names.filter(k.startswith(t)).select("id", "name", "records", F.when(k == t, 3).otherwise(2).alias("tier"))
        return rows.orderBy(*order).limit(limit)
    return found.orderBy("place").limit(limit).select("id", "name", "records", "tier")
