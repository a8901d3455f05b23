"""Ad-hoc SQL that can only read the corpus: the policy looks at the parsed plan, never at the text.

What a statement may be made of is listed: kinds of plan nodes, groups of built-in functions and a
few functions by name.  All else is refused, and the analysed plan is looked at once more for
expressions that reach beyond the data.
"""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Corpus

#: Of an answer: rows, characters of a cell, characters in all, and seconds that the query may take.
MOST_ROWS, MOST_CELL, MOST_CHARS, SECONDS = 1_000, 1 << 20, 8_000_000, 60
#: Of what it may cost: bytes that it reads, by what is known of the files, and bytes of the smaller side of a join without equal keys.
MOST_READ, MOST_NESTED = 1 << 40, 16 << 10
UNKNOWN = (1 << 63) - 1
#: Of a statement.
MOST_SQL, MOST_ARGS, MOST_ARG = 65_536, 1_000, 65_536
# The same for a query that comes from outside.
HOSTED = {"rows": 20_000, "chars": 8_000_000, "seconds": 4.0, "read": 16 << 30}

# Nodes of a parsed query.
NODES = set("""
Project Filter Aggregate Join Sort GlobalLimit LocalLimit Limit Offset Distinct Deduplicate Union Intersect Except UnresolvedRelation UnresolvedWith SubqueryAlias
UnresolvedSubqueryColumnAliases OneRowRelation LocalRelation UnresolvedInlineTable UnresolvedHaving Generate Window WithWindowDefinition UnresolvedTableValuedFunction UnresolvedTVFAliases
Pivot Unpivot LateralJoin Sample Tail Expand GroupingSets UnionLoop UnresolvedOrdinal Rebalance ResolvedHint UnresolvedHint ParameterizedQuery NamedParametersQuery PosParameterizedQuery NameParameterizedQuery PipeOperator
""".split())
# Groups of built-in functions that only work on their arguments, and functions of other groups that do.
GROUPS = {"agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "url_funcs", "variant_funcs", "window_funcs", "xml_funcs"}
FUNCTIONS = set("""
typeof equal_null uuid coalesce if ifnull nvl nvl2 nullif nullifzero zeroifnull bitmap_bit_position bitmap_bucket_number bitmap_count hll_sketch_estimate hll_union
theta_sketch_estimate theta_union theta_intersection theta_difference approx_top_k_estimate
""".split())
TABLE_FUNCTIONS = {"explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "range", "json_tuple", "variant_explode", "variant_explode_outer"}
# Expressions of an analysed plan that reach beyond the data.
BEYOND = {"CallMethodViaReflection", "TryReflect", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "PythonUDF", "ScalaUDF", "PythonUDAF", "RaiseError", "AssertTrue"}


class Denied(ValueError):
    """The statement does something other than read the corpus."""


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _all(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _expressions(node) -> list:
    """A node's expressions with those inside them, and the plans of their subqueries."""
    out, plans, stack = [], [], _all(node.expressions())
    while stack:
        e = stack.pop()
        out.append(e)
        if "Subquery" in _kind(e) or _kind(e) in ("Exists", "ListQuery"):
            plans.append(e.plan())
        stack += _all(e.children())
    return out, plans


def _walk(plan):
    """(node, its expressions) of a plan, with the plans inside expressions and CTEs; the names of CTEs come as text."""
    stack = [plan]
    while stack:
        node = stack.pop()
        if _kind(node) == "UnresolvedWith":
            for relation in _all(node.cteRelations()):
                yield relation._1().lower(), None
                stack.append(relation._2())
        found, plans = _expressions(node)
        yield node, found
        stack += _all(node.children()) + plans


def _function(spark: SparkSession, names: list[str], known: set[str]) -> None:
    name = names[-1].lower()
    if len(names) == 1 and name in known:
        return
    jvm = spark._jvm.org.apache.spark.sql.catalyst
    info = jvm.analysis.FunctionRegistry.builtin().lookupFunction(jvm.FunctionIdentifier(name)) if len(names) == 1 else None
    if info is None or info.isEmpty() or info.get().getGroup() not in GROUPS:
        raise Denied(f"no such function here: {'.'.join(names)}")


def inspect(spark: SparkSession, sql: str, tables: set[str]) -> None:
    """Raises Denied unless the statement is one query over these tables with harmless functions."""
    if len(sql) > MOST_SQL:
        raise Denied("the statement is too long")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Denied(f"not one statement of SQL: {str(e).splitlines()[0][:200]}") from None
    found = list(_walk(plan))
    local = {name for name, expressions in found if expressions is None}
    for node, expressions in found:
        if expressions is None:
            continue
        kind = _kind(node)
        if kind not in NODES:
            raise Denied(f"only queries are run, not {kind}")
        if kind == "UnresolvedRelation":
            name = _all(node.multipartIdentifier())
            if len(name) != 1 or name[0].lower() not in tables | local:
                raise Denied(f"no such table here: {'.'.join(name)}")
        if kind == "UnresolvedTableValuedFunction":
            name = _all(node.name())
            if len(name) != 1 or name[0].lower() not in TABLE_FUNCTIONS:
                raise Denied(f"no such table function here: {'.'.join(name)}")
        for e in expressions:
            kind = _kind(e)
            if "Identifier" in kind:
                raise Denied("names can't be computed here")
            if kind == "UnresolvedFunction":
                _function(spark, _all(e.nameParts()), FUNCTIONS)
            elif kind == "UnresolvedGenerator":
                _function(spark, [e.name().unquotedString()], TABLE_FUNCTIONS)


def inspect_analysed(plan) -> None:
    for node, expressions in _walk(plan):
        for e in expressions or []:
            if _kind(e) in BEYOND:
                raise Denied(f"no such function here: {_kind(e)}")


@dataclass(frozen=True)
class Cost:
    """What Spark expects of an optimised plan: bytes read (of tables whose size is known), and of each join without equal keys the bytes of its smaller side."""

    read: int
    nested: list[int]


def cost(df: DataFrame) -> Cost:
    keys = df.sparkSession._jvm.org.apache.spark.sql.catalyst.planning.ExtractEquiJoinKeys
    read, nested = 0, []
    for node, _ in _walk(df._jdf.queryExecution().optimizedPlan()):
        size = lambda n: int(str(n.stats().sizeInBytes()))
        if not node.children().size():
            read += size(node) if size(node) < UNKNOWN else 0
        elif _kind(node) == "Join" and keys.unapply(node).isEmpty():
            nested.append(min(size(node.left()), size(node.right())))
    return Cost(read, nested)


def afford(df: DataFrame, read: int = MOST_READ, nested: int = MOST_NESTED) -> None:
    """Raises Denied, before any job runs, for a query that reads too much or pairs rows of two tables of which neither is small."""
    told = cost(df)
    if told.read > read:
        raise Denied(f"the query would read {told.read} bytes, {told.read - read} too many")
    if any(n > nested for n in told.nested):
        raise Denied("the query would pair all rows of two tables: join them by equal keys")


@dataclass(frozen=True)
class Answer:
    columns: list[str]
    rows: list[tuple]
    truncated: bool
    overflowed: bool


def frame(spark: SparkSession, corpus: Corpus, sql: str, args: dict | None = None) -> DataFrame:
    """The query as a lazy DataFrame, in a session of its own that has only the corpus."""
    views = corpus.tables()
    inspect(spark, sql, set(views))
    if len(args or {}) > MOST_ARGS or any(isinstance(v, str) and len(v) > MOST_ARG for v in (args or {}).values()):
        raise Denied("too many or too long arguments")
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    datasets = spark._jvm.org.apache.spark.sql.classic.Dataset
    for name, df in views.items():
        DataFrame(datasets.ofRows(session._jsparkSession, df._jdf.queryExecution().logical()), session).createOrReplaceTempView(name)
    out = session.sql(sql, args=args or {})
    inspect_analysed(out._jdf.queryExecution().analyzed())
    return out


def _bounded(c: Column, kind: str, most: int) -> Column:
    """A cell of at most so many characters: text is cut, what is nested becomes JSON text, bytes hexadecimal digits."""
    if kind == "string" or kind.startswith(("char", "varchar")):
        return F.substring(c, 1, most)
    if kind == "binary":
        return F.hex(F.substring(c, 1, most // 2))
    if kind.startswith(("array", "map", "struct", "variant")):
        return F.substring(F.to_json(c), 1, most)
    return c


def run(spark: SparkSession, corpus: Corpus, sql: str, args: dict | None = None, rows: int = MOST_ROWS, chars: int = MOST_CHARS, seconds: float = SECONDS, cell: int = MOST_CELL, read: int = MOST_READ) -> Answer:
    """At most ``rows`` rows and about ``chars`` characters (the first row always), within the time; refused if the plan would cost too much.

    Spark cuts the cells and adds up their sizes, so no more than that reaches the driver."""
    df = frame(spark, corpus, sql, args)
    afford(df, read)
    names, kinds = df.columns, [t for _, t in df.dtypes]
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    cut = plain.limit(rows + 1).select([_bounded(F.col(f"c{i}"), t, cell).alias(f"c{i}") for i, t in enumerate(kinds)])
    size = sum((F.coalesce(F.length(F.col(f"c{i}").cast("string")), F.lit(4)) for i in range(len(names))), F.lit(0))
    order = Window.orderBy("place")  # over at most rows + 1 rows
    told = cut.select("*", F.monotonically_increasing_id().alias("place"), size.cast("long").alias("size"))
    told = told.select("*", F.sum("size").over(order).alias("used"), F.row_number().over(order).alias("n"), F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    within = told.filter((F.col("used") <= chars) | (F.col("n") == 1)).orderBy("n").drop("place", "size", "used", "n")
    group, sc = f"guard-{uuid.uuid4().hex}", spark.sparkContext
    timer = threading.Timer(seconds, lambda: sc.cancelJobGroup(group))
    sc.setJobGroup(group, "ad-hoc query", interruptOnCancel=True)
    timer.start()
    try:
        found = within.collect()
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    total = found[0]["total"] if found else 0
    out = [tuple(r)[:-1] for r in found[:rows]]
    return Answer(names, out, total > len(out), len(out) < min(total, rows))
