"""Full-text search over descriptions and names.

Tokens are runs of letters and digits, lower-cased, without accents (the marks of a letter's
canonical decomposition).  ``postings`` is an inverted index: a row for each token of a field of a
document, with its places.  ``keep`` writes it in ranges of the token, so the rows of a word, or of
all words with a beginning, are a few row groups that Parquet's statistics find, and the rows of a
frequent word are spread over many files.  ``find`` answers words, phrases, beginnings and their
conjunction from the index alone; where a corpus has none, ``search`` goes through the texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Corpus

# Letters below U+2000 that are a plain letter with marks, by the rule of canonical decomposition.
_PARTS = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x2000)}
ACCENTED = "".join(c for c, d in _PARTS.items() if d != c and c == c.lower() and all(unicodedata.category(x) == "Mn" for x in d[1:]) and unicodedata.category(d[0]) != "Mn")
PLAIN = "".join(_PARTS[c][0] for c in ACCENTED)
_TOKEN = re.compile(r'"([^"]*)"|([\w][\w\-]*)(\*)?')
FIELDS = ("descr", "title")
INDEX = "term string, doc long, field string, places array<int>"
#: Rows of an index that one range has, about, and how many documents the ranges are drawn from.
RANGE, DRAWN = 1 << 20, 2_000


@dataclass(frozen=True)
class Term:
    """Tokens that follow one another; the last may be the beginning of a word."""

    words: tuple[str, ...]
    prefix: bool = False


def fold(text: str) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return [w for w in re.split(r"[\W_]+", unicodedata.normalize("NFC", plain)) if w]


def parse(text: str) -> list[Term] | None:
    """Terms that must all match; None if the text has no word.  A star makes a beginning of a bare word, not of a quoted one."""
    out = []
    for m in _TOKEN.finditer(text):
        words = fold(m[1] if m[1] is not None else m[2])
        if words:
            out.append(Term(tuple(words), bool(m[3])))
    return out or None


def plain(column: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(column), ACCENTED, PLAIN), r"\p{Mn}+", "")


def tokens(column: Column) -> Column:
    return F.filter(F.split(plain(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def search(table: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows of the table that have every term, each in any of the columns; none for a text without words.  Reads all texts, each once."""
    terms = parse(text)
    if terms is None:
        return table.filter(F.lit(False))
    padded = [F.concat(F.lit(" "), F.array_join(tokens(F.col(c)), " "), F.lit(" ")) for c in columns]
    names = [f"__tokens{i}" for i in range(len(columns))]
    rows = table.withColumns(dict(zip(names, padded, strict=True)))
    for term in terms:
        wanted = " " + " ".join(term.words) + ("" if term.prefix else " ")
        rows = rows.filter(reduce(lambda a, b: a | b, [F.instr(F.col(n), wanted) > 0 for n in names]))
    return rows.drop(*names)


def restrict(corpus: Corpus, records: DataFrame, text: str) -> DataFrame:
    """Records that have every term of the text, by the corpus' index if it has one; a text without words needs none."""
    if parse(text) is None:
        return records.filter(F.lit(False))
    if corpus.postings is not None:
        hits = find(corpus.postings, text)
    else:
        hits = search(corpus.cve_text, text, list(FIELDS)).select(F.col("cve_id").alias("doc"))
    return records.join(hits.select(F.col("doc").alias("id")), "id", "left_semi")


def type_ahead(table: DataFrame, text: str, limit: int = 25) -> DataFrame:
    return search(table, text, ["name"]).select("id", "name").orderBy("name", "id").limit(limit)


# --- the index ---------------------------------------------------------------------------------------


def postings(table: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """term, doc, field, places of each token: one pass over the texts, in which a field's tokens are sorted and cut into runs where they stand, so none is shuffled."""
    placed = lambda c: F.sort_array(F.transform(tokens(F.col(c)), lambda t, i: F.struct(t.alias("term"), i.alias("place"))))
    fields = F.array(*[F.struct(F.lit(c).alias("field"), placed(c).alias("tokens")) for c in columns])
    each = table.select(F.col(id_column).alias("doc"), F.explode(fields).alias("f")).filter(F.size("f.tokens") > 0)
    at = lambda i: F.get("f.tokens", i)
    starts = F.filter(F.sequence(F.lit(0), F.size("f.tokens") - 1), lambda i: (i == 0) | (at(i)["term"] != at(i - 1)["term"]))
    each = each.select("doc", "f", F.explode(F.array(starts)).alias("starts"))  # a column of its own, so it isn't worked out for each run

    def run(start: Column, k: Column) -> Column:
        last = F.coalesce(F.get("starts", k + 1), F.size("f.tokens")) - 1
        return F.struct(at(start)["term"].alias("term"), F.transform(F.sequence(start, last), lambda j: at(j)["place"]).alias("places"))

    return each.select("doc", "f.field", F.explode(F.transform("starts", run)).alias("p")).select("p.term", "doc", "field", "p.places")


def keep(index: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """Write an index in the order of its terms and read it back."""
    ordered = index.repartitionByRange(files, "term", "doc") if files else index.repartitionByRange("term", "doc")
    ordered.sortWithinPartitions("term", "doc", "field").write.option("parquet.block.size", 8 << 20).parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def build(table: DataFrame, id_column: str, columns: list[str], path: str) -> DataFrame:
    """Write the index of a table's texts in the order of its terms and read it back: each text is read once and each row of the index shuffled once.

    Where ranges end is told by the rows of about DRAWN documents (all that a task orders there), so
    the texts aren't gone through for that; only the sizes of the files depend on it."""
    share = min(1.0, DRAWN / max(table.count(), 1))
    key = F.struct("term", "doc")
    drawn = postings(table.sample(share, 1) if share < 1 else table, id_column, columns).select(key.alias("key")).persist()
    ranges = max(1, math.ceil(drawn.count() / share / RANGE))
    tiles = drawn.withColumn("tile", F.ntile(ranges).over(Window.orderBy("key"))).groupBy("tile").agg(F.min("key").alias("key"))
    bounds = [r["key"] for r in tiles.orderBy("tile").collect()[1:]] if ranges > 1 else []
    drawn.unpersist()
    index = postings(table, id_column, columns)
    rows = index.withColumn("__range", F.lit(0))
    if bounds:
        held = F.array(*[F.struct(F.lit(b["term"]).alias("term"), F.lit(b["doc"]).cast("long").alias("doc")) for b in bounds])
        for bit in range(len(bounds).bit_length() - 1, -1, -1):  # how many bounds are not above a row, by halving
            more = F.get(held, F.col("__range") + ((1 << bit) - 1)) <= key
            rows = rows.withColumn("__range", F.col("__range") + F.when(more, 1 << bit).otherwise(0))
    ordered = rows.repartitionById(ranges, F.col("__range")).sortWithinPartitions("term", "doc", "field").drop("__range")
    ordered.write.option("parquet.block.size", 8 << 20).parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def _begins(term: str) -> Column:
    return F.col("term").startswith(term)


def find(index: DataFrame, text: str) -> DataFrame:
    """doc of the documents that have every term, each in any field.

    Only the rows of the terms' words are read; a document's rows meet once, where the places of a
    phrase's words are laid over one another."""
    terms = parse(text)
    if terms is None:
        return index.select("doc").filter(F.lit(False))
    exact = sorted({w for t in terms for w in t.words[: len(t.words) - t.prefix]})
    begun = sorted({t.words[-1] for t in terms if t.prefix})
    wanted = [F.col("term").isin(exact)] * bool(exact) + [_begins(w) for w in begun]
    rows = index.filter(reduce(lambda a, b: a | b, wanted))
    if all(len(t.words) == 1 for t in terms):
        hit = [F.max(_begins(t.words[0]) if t.prefix else F.col("term") == t.words[0]).alias(f"t{i}") for i, t in enumerate(terms)]
        return _having(rows.groupBy("doc").agg(*hit), len(terms))
    # Of each word of each term its places in a field, then whether they follow one another.
    place = {}
    for i, t in enumerate(terms):
        for k, w in enumerate(t.words):
            mine = _begins(w) if t.prefix and k == len(t.words) - 1 else F.col("term") == w
            place[f"p{i}_{k}"] = F.flatten(F.collect_list(F.when(mine, F.col("places"))))
    fields = rows.groupBy("doc", "field").agg(*[c.alias(n) for n, c in place.items()])

    def follows(i: int, t: Term) -> Column:
        at = F.col(f"p{i}_0")
        for k in range(1, len(t.words)):
            at = F.array_intersect(at, F.transform(F.col(f"p{i}_{k}"), _back(k)))
        return F.max(F.size(at) > 0).alias(f"t{i}")

    return _having(fields.groupBy("doc").agg(*[follows(i, t) for i, t in enumerate(terms)]), len(terms))


def _back(k: int):
    return lambda x: x - k


def _having(flags: DataFrame, terms: int) -> DataFrame:
    return flags.filter(reduce(lambda a, b: a & b, [F.col(f"t{i}") for i in range(terms)])).select("doc")


def lookup(index: DataFrame, terms: list[str]) -> DataFrame:
    """Documents that have all words, from postings."""
    words = [w for t in terms for w in fold(t)]
    return find(index, " ".join(words))


def maintain(index: DataFrame, changed: DataFrame, gone: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """Postings after a batch of changed rows and deleted ids; those of other documents stay as they are."""
    touched = changed.select(F.col(id_column).alias("doc")).unionByName(gone.select(F.col(id_column).alias("doc"))).distinct()
    return index.join(touched, "doc", "left_anti").select("term", "doc", "field", "places").unionByName(postings(changed, id_column, columns))


def drift(index: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Postings that one of the two has and the other hasn't: none if the index is sound."""
    columns = ["term", "doc", "field", "places"]
    a, b = index.select(columns), rebuilt.select(columns)
    return a.exceptAll(b).unionByName(b.exceptAll(a))
