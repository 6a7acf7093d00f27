"""What callers' own SQL may hold: plain queries and expressions, checked on the nodes of the parsed plan."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..model import AccessDenied, GovernanceError

# Functions of values alone.  None reaches files, the environment, the session or other code.
FUNCTIONS = set("""
    abs acos add_months any any_value approx_count_distinct array array_agg array_contains array_distinct array_join array_max array_min array_position array_sort ascii asin atan avg base64
    bit_length bool_and bool_or bround btrim cast cbrt ceil ceiling char_length character_length coalesce collect_list collect_set concat concat_ws contains corr cos count count_if covar_pop
    crc32 cume_dist date_add date_diff date_format date_part date_sub date_trunc datediff day dayofmonth dayofweek dayofyear dense_rank element_at endswith every exp explode extract
    filter first first_value flatten floor format_number from_unixtime get_json_object greatest grouping grouping_id hex hour if ifnull ilike in initcap instr isnan isnotnull isnull
    kurtosis lag last last_day last_value lcase lead least left length levenshtein like listagg ln locate log log10 log2 lower lpad ltrim make_date map max max_by md5 mean median min min_by
    minute mod mode month months_between named_struct next_day nth_value ntile nullif nvl nvl2 octet_length percent_rank percentile percentile_approx pmod position pow power quarter
    radians rank regexp_count regexp_extract regexp_like regexp_replace repeat replace reverse right rint rlike round row_number rpad rtrim second sequence sha1 sha2 sign sin size skewness
    slice some sort_array split split_part sqrt startswith std stddev stddev_pop stddev_samp string_agg struct substr substring substring_index sum tan to_date to_json to_timestamp transform
    translate trim trunc try_add try_cast try_divide try_subtract try_to_number typeof ucase unbase64 unhex unix_timestamp upper var_pop var_samp variance weekday weekofyear when xxhash64
    year + - * / % = == <=> != <> < > <= >= ! ~ & | ^ || and or not div between
""".split())

# What a query is made of.
_PLANS = set("""
    Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Limit Offset Distinct Deduplicate Union Except Intersect SubqueryAlias UnresolvedWith UnresolvedRelation UnresolvedHaving Window
    WithWindowDefinition UnresolvedSubqueryColumnAliases UnresolvedInlineTable OneRowRelation Generate Pivot Unpivot UnresolvedHint Tail
""".split())


def _each(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _nodes(session: SparkSession, root) -> Iterator[tuple[str, object]]:
    """(class, node) of a parsed plan or expression and of everything in it, subqueries and common table expressions too."""
    loader = session._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    plan = loader.loadClass("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
    subquery = loader.loadClass("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    stack = [root]
    while stack:
        node = stack.pop()
        kind = node.getClass().getSimpleName()
        yield ("plan:" if plan.isInstance(node) else "") + kind, node
        stack += _each(node.children())
        if plan.isInstance(node):
            stack += _each(node.expressions())
        elif subquery.isInstance(node):
            stack.append(node.plan())
        if kind == "UnresolvedWith":
            stack += [pair._2() for pair in _each(node.cteRelations())]


def _functions(kind: str, node) -> None:
    if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
        name = (node.nameParts().mkString(".") if kind == "UnresolvedFunction" else node.name().funcName()).lower()
        if name not in FUNCTIONS:
            raise GovernanceError(f"the function {name} is not allowed")


def expression(session: SparkSession, text: str) -> None:
    """Raises unless ``text`` is an expression of columns and allowed functions, without stars and subqueries."""
    for kind, node in _nodes(session, session._jsparkSession.sessionState().sqlParser().parseExpression(text)):
        if kind.startswith("plan:") or "Star" in kind or "Subquery" in kind or kind in ("Exists", "ListQuery"):
            raise AccessDenied("expressions are of columns and functions only")
        _functions(kind, node)


#: Expressions that reach beyond their arguments, whatever way they came into a column.
_BEYOND = {"CallMethodViaReflection", "TryReflect", "PythonUDF", "PythonUDAF", "PythonUDTF", "ScalaUDF", "ScalaAggregator", "HiveGenericUDF", "HiveSimpleUDF", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "Invoke", "CurrentDatabase", "CurrentCatalog", "CurrentUser", "SessionUser"}


def columns_only(df: DataFrame) -> None:
    """Raises if a column of an analysed frame holds a subquery, code of others, or what tells of files and the session."""
    session = df.sparkSession
    subquery = session._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    for kind, node in _nodes(session, df._jdf.queryExecution().analyzed()):
        if kind in _BEYOND or subquery.isInstance(node):
            raise AccessDenied("expressions are of columns and functions of values only")


def query(session: SparkSession, text: str) -> tuple[DataFrame, set[str]]:
    """A query that only reads the session's views, and the names of those it reads; anything else raises.

    A relation is one part: neither a catalog, nor a database, nor a file format may stand before its name, however it is
    quoted.  It is a view, or a common table expression that no table of the catalog shares its name with; so a name
    outside the scope of its expression finds nothing.  The session itself takes no paths for tables.
    """
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    parsed = session._jsparkSession.sessionState().sqlParser().parsePlan(text)
    views, names, read = {t.name.lower() for t in session.catalog.listTables() if t.isTemporary}, set(), set()
    for kind, node in _nodes(session, parsed):
        _functions(kind, node)
        if not kind.startswith("plan:"):
            continue
        kind = kind.removeprefix("plan:")
        if kind not in _PLANS:
            raise GovernanceError(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedRelation":
            parts = list(_each(node.multipartIdentifier()))
            if len(parts) != 1:
                raise GovernanceError(f"not granted: {' . '.join(parts)}")
            read.add(parts[0].lower())
        elif kind == "UnresolvedWith":
            names |= {pair._1().lower() for pair in _each(node.cteRelations())}
    if beyond := read - views - names:
        raise GovernanceError(f"not granted: {', '.join(sorted(beyond))}")
    if shared := [n for n in read - views if session.catalog.tableExists("`" + n.replace("`", "``") + "`")]:
        raise GovernanceError(f"not granted: {', '.join(sorted(shared))}")
    try:
        return session.sql(text), read & views
    except AnalysisException as e:
        raise GovernanceError(f"the query cannot be run ({e.getCondition() or 'not valid'})") from None
