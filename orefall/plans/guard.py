"""Guarded SQL: one read-only SELECT over allowed tables, checked on the parsed and the analysed plan, capped in rows, bytes and time."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefall.config import Settings
from orefall.errors import CodedError

#: Parsed nodes that only read (fixed list); any other kind of statement is refused.
READS = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit LimitAll Offset Tail Distinct Union Intersect Except SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedRelation UnresolvedHaving "
    "WithWindowDefinition UnresolvedInlineTable LocalRelation OneRowRelation Generate LateralJoin Pivot Unpivot Expand Window Sample UnresolvedHint CTERelationDef CTERelationRef WithCTE UnresolvedOrdinal "
    "Range UnresolvedTableValuedFunction AsOfJoin UnionLoop UnresolvedPivot UnresolvedUnpivot UnresolvedStarWithColumns ResolvedHint Deduplicate".split()
)

#: Groups of built-in functions that compute from their arguments alone (fixed list). Those of no such group (among them all that
#: call Java, read files or the session, or fail on purpose) are refused, and so are functions that aren't built in.
GROUPS = frozenset(
    "agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs generator_funcs hash_funcs "
    "json_funcs lambda_funcs map_funcs math_funcs operator_funcs predicate_funcs string_funcs struct_funcs url_funcs variant_funcs window_funcs".split()
)
BUILT_IN = "org.apache.spark.sql.catalyst.expressions."
TABLE_FUNCTIONS = frozenset("explode explode_outer posexplode posexplode_outer inline inline_outer stack".split())

#: Names that a parser leaves open and that are looked up as columns, checked functions or windows (fixed list). No other open name
#: is allowed, above all no identifier clause, whose name is only known once it has been computed.
OPEN = frozenset(
    "UnresolvedAlias UnresolvedAttribute UnresolvedFunction UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedExtractValue UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedGenerator "
    "UnresolvedWindowExpression UnresolvedSubqueryColumnAliases UnresolvedRegex".split()
)
#: Expressions that run other code than Spark's own, whatever function they come from (fixed list).
FOREIGN = frozenset("CallMethodViaReflection TryReflect ScalaUDF PythonUDF PythonUDAF PythonUDTF UserDefinedExpression ApplyFunctionExpression HiveSimpleUDF HiveGenericUDF".split())
#: Functions whose result is as large as an argument says, with the place of that argument (fixed list).
SIZED = {"StringRepeat": 1, "ArrayRepeat": 1, "StringSpace": 0, "StringLPad": 1, "StringRPad": 1}
#: All such sizes of a statement, multiplied, stay below.
LARGEST = 1_000_000
TOO_LARGE = "a row of the answer is too large"


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def relations(spark: SparkSession, sql: str) -> set[str]:
    """Names of the tables that a statement reads, without those of its common table expressions."""
    sessions = spark._jvm.org.apache.spark.sql.classic.SparkSession
    before = sessions.getActiveSession()
    sessions.setActiveSession(spark._jsparkSession)  # the parser reads the dialect of the active session
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise CodedError("sql_failed", f"the statement cannot be parsed: {(str(e).strip() or 'syntax error').splitlines()[0]}") from e
    finally:
        if before.isDefined():
            sessions.setActiveSession(before.get())
    found: set[str] = set()
    catalog = spark._jsparkSession.sessionState().catalog()
    identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier

    def checked(parts: list[str]) -> None:
        name = ".".join(parts)
        try:
            info = catalog.lookupFunctionInfo(identifier(name)) if len(parts) == 1 else None
        except Exception:
            info = None
        if info is None or info.getGroup() not in GROUPS or not info.getClassName().startswith(BUILT_IN):
            raise CodedError("function_denied", f"the function {name} is not allowed", 403)

    def expression(e) -> None:
        kind = e.getClass().getSimpleName().rstrip("$")
        if ("Unresolved" in kind or "Parameter" in kind) and kind not in OPEN or not e.getClass().getName().startswith("org.apache.spark.sql.catalyst."):
            raise CodedError("function_denied", f"{kind} is not allowed", 403)
        if kind == "UnresolvedFunction":
            checked(_seq(e.nameParts()))
        if kind == "UnresolvedGenerator":
            checked([e.name().funcName()])
        for child in _seq(e.children()):
            expression(child)

    def walk(node, known: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind not in READS:
            raise CodedError("not_a_select", f"{kind} is not allowed")
        if kind == "UnresolvedTableValuedFunction" and ".".join(_seq(node.name())).lower() not in TABLE_FUNCTIONS:
            raise CodedError("function_denied", f"the function {'.'.join(_seq(node.name()))} is not allowed", 403)
        for e in _seq(node.expressions()):
            expression(e)
        if kind == "WithWindowDefinition":  # named windows are no expressions of the node
            for definition in _seq(node.windowDefinitions().values().toSeq()):
                expression(definition)
        if kind == "UnresolvedRelation":
            name = ".".join(_seq(node.multipartIdentifier()))
            if name.lower() not in known:
                found.add(name)
        if kind == "UnresolvedWith":
            for pair in _seq(node.cteRelations()):
                name = pair._1().lower()
                inside = known | {name} if node.allowRecursion() else known
                walk(pair._2(), inside)
                known = known | {name}
        for child in [*_seq(node.children()), *_seq(node.subqueries())]:
            walk(child, known)

    walk(plan, frozenset())
    return found


@lru_cache(maxsize=8)
def _refused(spark: SparkSession) -> frozenset[str]:
    """Classes of the built-in functions that belong to none of the allowed groups, and to no allowed function as well."""
    registry = spark._jsparkSession.sessionState().functionRegistry()
    by_group: dict[bool, set[str]] = {True: set(), False: set()}
    for name in _seq(registry.listFunction()):
        info = registry.lookupFunction(name)
        if info.isDefined():
            by_group[info.get().getGroup() in GROUPS].add(info.get().getClassName())
    return frozenset(by_group[False] - by_group[True])


def check_analysed(spark: SparkSession, plan) -> None:
    """Refuses what a statement turned out to call, whatever it was written as, and sizes that no answer should have.

    Plans of the tables themselves, which stand below views, are trusted and not looked at.
    """
    refused, rules = _refused(spark), spark._jvm.java.lang.Class.forName(f"{BUILT_IN}InheritAnalysisRules")
    product = 1

    def number(e) -> int:
        if not e.foldable():
            raise CodedError("too_large", "the size of a value must be a constant", 413)
        value = e.eval(None)
        return max(1, int(str(value))) if value is not None else 1

    def expression(e) -> None:
        nonlocal product
        name, kind = e.getClass().getName(), e.getClass().getSimpleName()
        if kind in FOREIGN or name in refused or name.startswith(f"{BUILT_IN}objects."):
            raise CodedError("function_denied", f"{kind} is not allowed", 403)
        args = _seq(e.parameters() if rules.isInstance(e) else e.children())
        if kind in SIZED:
            product *= number(args[SIZED[kind]])
        if kind == "Sequence" and e.dataType().elementType().typeName() != "date":
            step = abs(number(args[2])) if len(args) > 2 and args[2].dataType().typeName() in ("byte", "short", "integer", "long") else 1
            first, last = (_whole(x) for x in args[:2])
            product *= max(1, abs(last - first) // max(1, step))
        if product > LARGEST:
            raise CodedError("too_large", f"values of a statement may have {LARGEST} parts at most", 413)
        for x in args:
            expression(x)

    def walk(node) -> None:
        if node.getClass().getSimpleName() == "View":
            return
        for e in _seq(node.expressions()):
            expression(e)
        for child in [*_seq(node.children()), *_seq(node.subqueries())]:
            walk(child)

    walk(plan)


def _whole(e) -> int:
    if not e.foldable() or e.dataType().typeName() not in ("byte", "short", "integer", "long"):
        raise CodedError("too_large", "a sequence must have constant ends", 413)
    value = e.eval(None)
    return int(str(value)) if value is not None else 0


@dataclass
class Answer:
    sql: str
    columns: list[str]
    rows: list[tuple]

    @property
    def row_count(self) -> int:
        return len(self.rows)


class Guard:
    """Runs statements over named DataFrames in a session of its own, in which no other table exists."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | Callable[[], DataFrame]], settings: Settings = Settings()) -> None:
        """tables: DataFrames, or functions that give them when a statement first reads them."""
        self.spark, self.settings = spark.newSession(), settings
        self.tables, self.known = {n.lower(): (n, df) for n, df in tables.items()}, set()
        self.spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")

    def _adopt(self, key: str) -> None:
        if key not in self.known:
            name, df = self.tables[key]
            df = df if isinstance(df, DataFrame) else df()
            view = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.queryExecution().logical())
            DataFrame(view, self.spark).createOrReplaceTempView("`" + name.replace("`", "``") + "`")
            self.known.add(key)

    def plan(self, sql: str) -> DataFrame:
        """The capped plan of a statement; a coded error if it isn't one SELECT over the tables."""
        text = sql.strip().rstrip(";").strip()
        if not text:
            raise CodedError("empty_sql", "the statement is empty")
        read = relations(self.spark, text)
        unknown = sorted(n for n in read if n.lower() not in self.tables)
        if unknown:
            raise CodedError("permission_denied", f"tables that are not visible: {', '.join(unknown)}", 403)
        for n in read:
            self._adopt(n.lower())
        try:
            df = self.spark.sql(text)
        except Exception as e:
            raise CodedError("sql_failed", str(e).splitlines()[0]) from e
        check_analysed(self.spark, df._jdf.queryExecution().analyzed())
        return df.limit(self.settings.sql_row_cap)

    def _bounded(self, df: DataFrame) -> DataFrame:
        """df, which fails on a row of more than sql_row_bytes: with the row cap that bounds what the driver gets."""
        plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in plain.columns), F.lit(0))
        return plain.where(F.when(size > self.settings.sql_row_bytes, F.raise_error(F.lit(TOO_LARGE)).cast("boolean")).otherwise(True))

    def run(self, sql: str) -> Answer:
        """The rows, at most the cap; a statement over the time limit is cancelled."""
        df, group = self.plan(sql), uuid.uuid4().hex
        sc = self.spark.sparkContext
        late = threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobsWithTag(group)

        timer = threading.Timer(self.settings.sql_timeout_ms / 1000, stop)
        sc.addJobTag(group)
        timer.start()
        try:
            rows = self._bounded(df).collect()
        except Exception as e:
            if TOO_LARGE in str(e):
                raise CodedError("too_large", TOO_LARGE, 413) from e
            raise CodedError("timeout" if late.is_set() else "sql_failed", str(e).splitlines()[0]) from e
        finally:
            timer.cancel()
            sc.removeJobTag(group)
        return Answer(sql, df.columns, [tuple(r) for r in rows])
