"""Spelling variants of the words of a corpus: pairs of words one edit apart, and the form that each stands for.

``words`` counts the runs of letters of all texts, with one letter left out of about one run in
DROP, as the contract of the query wants its input.  ``near`` is an even-partition pigeonhole join
for one edit.  A word of ``l`` code points is cut in two segments at ``l div 2``; one edit leaves
one of the two as it was, so the word is indexed under both and another word of ``l`` or of
``l + 1`` code points probes with what it has at the segments' places: its beginning, and its end,
shifted by the difference of the lengths.  The key of an entry is a hash of the lengths and of what
is fixed; what is left open is the region [lo, hi).

A segment that very many words have is cut again: the open region is halved by the same rule
(either half must agree too), for the entries of that key alone, until a key has at most PAIRS
candidates or its region has one place.  Keys are counted, split and joined by Spark, so no task
holds the words of a segment.

A candidate comes up once: of the halves that two words agree on, the pair belongs to the first
(the region that has the end of their common beginning), which each key tells by itself, so no
pairs are shuffled to be told apart.  One edit is verified with the Levenshtein distance.

``forms`` gives each word its near word of the largest count, if that is RATIO times its own, and
follows forms to the last by doubling: counts grow RATIO times a step, so a chain is short.

Defined cases: null texts and texts without a letter have no words; a null doc_id is an empty one
in the hash; rows that are equal count as often as they stand; ties of the count go to the least
word; an empty table gives no rows; further columns are ignored; very long runs are words like
any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST, OCCURS, DROP, RATIO = 7, 2, 31, 10
#: Candidates that one key may give before it is cut again.
PAIRS = 1_024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Chains of forms are followed by doubling: 2 ** STEPS steps, more than a long has powers of RATIO.
STEPS = 6


def words(docs: DataFrame, least: int = LEAST, occurs: int = OCCURS) -> DataFrame:
    """word, n of all words of at least ``least`` code points that occur ``occurs`` times or more."""
    run = F.translate(F.col("run"), UPPER, LOWER)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"))
    rows = rows.select(run.alias("run"), F.crc32(F.concat("id", F.lit(":"), run)).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % DROP == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    counts = rows.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= occurs)


def _key() -> Column:
    """What the words of a key agree on: the length of the shorter ones, the open region, and all around it."""
    longer = F.length("word") - F.col("l")
    return F.xxhash64("l", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.col("hi") + longer + 1, F.length("word")))


def _halved(rows: DataFrame) -> DataFrame:
    """Entries for the two halves of each open region."""
    middle = ((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(middle.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), middle.alias("hi")))
    return rows.select("word", "n", "l", F.explode(halves).alias("r")).select("word", "n", "l", "r.lo", "r.hi").withColumn("key", _key())


def near(table: DataFrame, least: int = LEAST, pairs: int = PAIRS) -> DataFrame:
    """word, n, other, other_n for each two of the words (word, n; each once, of ``least`` code points or more) that are one edit apart, both ways."""
    lengths = F.expr(f"filter(array(length(word), length(word) - 1), x -> x >= {least})")
    rows = table.select("word", "n", F.explode(lengths).alias("l")).withColumns({"lo": F.lit(0), "hi": F.col("l")})
    entries, cold = common.cut(_halved(rows), "segments"), []
    while True:
        own = F.col("l") == F.length("word")
        keys = entries.groupBy("key").agg(F.sum(own.cast("long")).alias("own"), F.count("*").alias("all"), F.max(F.col("hi") - F.col("lo")).alias("open"))
        # A key without a word of the shorter length, or with one word only, has no candidates.
        keys = keys.filter((F.col("own") > 0) & (F.col("all") > 1)).select("key", ((F.col("own") * F.col("all") > pairs) & (F.col("open") > 1)).alias("hot"))
        found = common.cut(entries.join(keys, "key"), "segments")
        common.drop_cut(entries)
        cold.append(found.filter("not hot"))
        hot = found.filter("hot")
        if not hot.limit(1).count():
            break
        entries = common.cut(_halved(hot), "segments")
    out = None
    for part in cold:
        a = part.filter(F.col("l") == F.length("word")).select("key", F.col("word").alias("word"), F.col("n").alias("n"), "l", "hi")
        b = part.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
        first = (F.col("hi") == F.col("l")) | (F.substring("word", F.lit(1), F.col("hi")) != F.substring("other", F.lit(1), F.col("hi")))
        both = a.join(b, "key").filter((F.col("word") != F.col("other")) & first & (F.levenshtein("word", "other", 1) == 1))
        out = both if out is None else out.unionByName(both)
    # Words of one length meet in both orders, those of two lengths in one.
    turn = F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    same = F.struct("word", "n", "other", "other_n")
    return out.select(F.explode(F.when(F.length("other") > F.col("l"), F.array(same, turn)).otherwise(F.array(same))).alias("p")).select("p.*")


def forms(table: DataFrame, ratio: int = RATIO, least: int = LEAST) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of the words (word, n)."""
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    found = near(table, least).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    form_n = -F.col("best.n")
    taken = form_n >= F.col("n") * ratio
    told = table.join(found, "word", "left").select("word", F.when(taken, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, form_n).alias("form_n"))
    told = common.cut(told, "forms")
    roots = common.cut(told.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    for _ in range(STEPS):
        # A form that many words have is on the side that adaptive execution may split; each word is once on the other.
        step = roots.select(F.col("word").alias("via"), F.col("root").alias("next"))
        further = common.cut(roots.join(step, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        more = further.filter("moved").limit(1).count()
        common.drop_cut(roots)
        roots = further
        if not more:
            break
    return told.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms(common.cut(words(common.table(spark, sf_dir, "documents")), "words"))


# The hash is the usual CRC of 32 bits, by a table of its 256 steps; nearness is by what is left when a code point is taken out.
_SQL = """
WITH RECURSIVE t AS (SELECT list(c ORDER BY i) t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) c FROM range(256) r(i))),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') id, translate(unnest(regexp_extract_all("text", '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run FROM documents),
each AS (SELECT id, run, count(*) k FROM runs WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT run, k, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 + (ord(x) >> 6)::BIGINT, 128 + (ord(x) & 63)::BIGINT] END)) b FROM each),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) h FROM bytes, t),
word AS (SELECT w, sum(k)::BIGINT n, length(w) l FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END w, k FROM hashed) WHERE length(w) >= 7 GROUP BY w HAVING sum(k) >= 2),
less AS (SELECT DISTINCT w, n, i, left(w, i) || substr(w, i + 2) d FROM (SELECT w, n, unnest(range(l)) i FROM word)),
pair AS (SELECT a.w, b.w o, b.n m FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.w <> b.w
UNION SELECT a.w, b.w, b.n FROM less a JOIN word b ON a.d = b.w
UNION SELECT b.w, a.w, a.n FROM less a JOIN word b ON a.d = b.w),
best AS (SELECT w, count(*) n_near, max(m) m FROM pair GROUP BY w),
form AS (SELECT w, min(o) f, any_value(m) m FROM pair JOIN best USING (w, m) JOIN word USING (w) WHERE m >= 10 * word.n GROUP BY w),
chain AS (SELECT w, f r FROM form UNION ALL SELECT chain.w, form.f FROM chain JOIN form ON form.w = chain.r),
root AS (SELECT w, r FROM chain WHERE r NOT IN (SELECT w FROM form))
SELECT w AS word, f AS form, coalesce(r, w) AS root, word.n AS n, coalesce(n_near, 0) AS n_near, form.m AS form_n
FROM word LEFT JOIN best USING (w) LEFT JOIN form USING (w) LEFT JOIN root USING (w)
"""

QUERIES = {"op11_spelling": query}
ORACLES = {"op11_spelling": _SQL.strip()}
