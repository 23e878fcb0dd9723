"""Read-only policy for free-form Spark SQL, checked on the names in the statement that Spark's parser reads.

The statement's kind, tables, functions and limit are held against lists of what is allowed. For analysts every SELECT outside a CTE is
checked: sensitive columns, and names that a CTE or lateral view gives to anything made of them, may be counted, filtered and joined on,
but not shown, grouped or sorted by. Names are judged alike wherever they stand, so a doubtful one is refused. Columns are resolved by Spark.
"""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from quillon.catalog import Catalog
from quillon.operators.quality import append_audit
from quillon.operators.validation import Contract, Verdict, validate

ROW_LIMITS = {"analyst": 200, "admin": 1000}
#: Rows that a query returns at most, whatever limit its role has.
MOST_ROWS = 1000
TIMEOUT_SECONDS = 5.0
#: Logical nodes of a read-only query; any other kind is refused.
_NODES = set("Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset UnresolvedWith CTERelationDef SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedHaving Distinct Union Except Intersect Window Pivot UnresolvedInlineTable WithWindowDefinition LateralJoin Generate OneRowRelation Subquery".split())
_FUNCTIONS = {"java_method", "reflect", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_catalog", "current_database", "current_schema", "session_user", "current_user", "user", "version", "raise_error", "sleep", "read_files"}


class PolicyViolation(ValueError):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Decision:
    sql: str
    role: str
    tables: tuple[str, ...]
    row_limit: int
    result: DataFrame


def _seq(s) -> Iterator:
    it = s.iterator()
    while it.hasNext():
        yield it.next()


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _expressions(e) -> Iterator:
    yield e
    for c in _seq(e.children()):
        yield from _expressions(c)


def _subquery(e) -> bool:
    """Whether an expression holds a plan."""
    kind = _kind(e)
    return kind in ("Exists", "ListQuery") or kind.endswith("Subquery") and kind != "InSubquery"


def _plans(plan, in_cte: bool = False) -> Iterator[tuple]:
    """The plan's nodes, those of CTEs and of subqueries inside expressions, each with whether it belongs to a CTE's query."""
    yield plan, in_cte
    if _kind(plan) == "UnresolvedWith":
        for t in _seq(plan.cteRelations()):
            yield from _plans(t._2(), True)
    for c in _seq(plan.children()):
        yield from _plans(c, in_cte)
    for e in _seq(plan.expressions()):
        for x in _expressions(e):
            if _subquery(x):
                yield from _plans(x.plan(), in_cte)


def _relations(plan, scope: frozenset[str]) -> Iterator[list[str]]:
    """Name parts of the relations that no CTE in scope defines. A CTE is known to those after it and to its own query, nowhere else."""
    if _kind(plan) == "UnresolvedWith":
        for t in _seq(plan.cteRelations()):
            yield from _relations(t._2(), scope)
            scope = scope | {t._1().lower()}
    elif _kind(plan) == "UnresolvedRelation":
        parts = list(_seq(plan.multipartIdentifier()))
        if len(parts) > 1 or parts[0].lower() not in scope:
            yield parts
    for c in _seq(plan.children()):
        yield from _relations(c, scope)
    for e in _seq(plan.expressions()):
        for x in _expressions(e):
            if _subquery(x):
                yield from _relations(x.plan(), scope)


def _parts(attribute) -> list[str]:
    return [p.lower() for p in _seq(attribute.nameParts())]


def _mentions(e, names: set[str], star: bool = False) -> bool:
    """Whether an expression holds one of the names (or, with `star`, a star) outside COUNT."""
    kind = _kind(e)
    if kind == "UnresolvedFunction" and list(_seq(e.nameParts()))[-1].lower() == "count":
        return False
    if kind in ("UnresolvedAttribute", "UnresolvedNamedLambdaVariable") and names.intersection(_parts(e)) or star and "Star" in kind:
        return True
    if _subquery(e) and any(_mentions(x, names, star) for n, _ in _plans(e.plan()) for x in _seq(n.expressions())):
        return True
    return any(_mentions(c, names, star) for c in _seq(e.children()))


def _is_relation(plan) -> bool:
    """Whether a plan is a table or CTE itself, perhaps under another name: new column names then stand for all its columns."""
    while _kind(plan) == "SubqueryAlias":
        plan = next(_seq(plan.children()))
    return _kind(plan) == "UnresolvedRelation"


def _tainted(nodes: list[tuple], sensitive: frozenset[str]) -> set[str]:
    """The sensitive names and all that the statement gives to anything made of them."""
    names = set(sensitive)
    while True:
        before = len(names)
        for n, in_cte in nodes:
            kind = _kind(n)
            if kind == "Generate" and _mentions(n.generator(), names):
                made = [a.name().lower() for a in _seq(n.generatorOutput())]
                if not made:
                    raise PolicyViolation("sensitive_column", "a lateral view without names")
                names.update(made)
            if kind == "UnresolvedSubqueryColumnAliases" and (_is_relation(n.child()) or any(_mentions(e, names, True) for c, _ in _plans(n.child()) for e in _seq(c.expressions()))):
                names.update(x.lower() for x in _seq(n.outputColumnNames()))
            # Branches of a set operation take the first one's names.
            if in_cte and kind in ("Union", "Except", "Intersect") and any(_mentions(e, names, True) for b in _seq(n.children()) for e in _projection(b)):
                raise PolicyViolation("sensitive_column", "a set operation in a CTE")
            for e in _seq(n.expressions()):
                for x in _expressions(e):
                    if _kind(x) == "Alias" and _mentions(x.child(), names):
                        names.add(x.name().lower())
                    elif _kind(x) == "MultiAlias" and _mentions(x.child(), names):
                        names.update(a.lower() for a in _seq(x.names()))
        if len(names) == before:
            return names


def _projection(plan) -> list:
    """What a query shows: the expressions of its SELECT; for a set operation those of all branches."""
    kind = _kind(plan)
    if kind == "Project":
        return list(_seq(plan.projectList()))
    if kind == "Aggregate":
        return list(_seq(plan.aggregateExpressions()))
    if kind == "UnresolvedRelation":
        raise PolicyViolation("star_not_allowed", "TABLE")
    return [e for c in _seq(plan.children()) for e in _projection(c)]


def evaluate(spark: SparkSession, sql: str, catalog: Catalog, role: str = "analyst") -> Decision:
    """The checked query as a DataFrame with the role's row limit, or PolicyViolation. Tables are temp views of the catalog's names.

    Analysts may filter and join on sensitive columns and count them, but not see, group or sort the result by them or by anything made of them,
    nor select all columns. Queries without any table of the catalog, other statements, several statements, unknown tables and
    columns, and functions that reach outside the query are refused.
    """
    if role not in ROW_LIMITS:
        raise PolicyViolation("unknown_role", role)
    sql = sql.strip().removesuffix(";").strip()
    if not sql:
        raise PolicyViolation("empty_statement")
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise PolicyViolation("syntax", str(e).splitlines()[0][:200]) from e
    nodes = list(_plans(parsed))
    for n, _ in nodes:
        if _kind(n) not in _NODES:
            raise PolicyViolation("not_a_query", _kind(n))
    tables = set()
    for parts in _relations(parsed, frozenset()):
        if len(parts) > 1 or parts[0].lower() not in catalog.tables:
            raise PolicyViolation("table_not_allowed", ".".join(parts))
        tables.add(parts[0].lower())
    if not tables:
        raise PolicyViolation("no_table")
    for n, _ in nodes:
        for e in _seq(n.expressions()):
            for x in _expressions(e):
                if _kind(x) in ("UnresolvedFunction", "UnresolvedAttribute", "UnresolvedNamedLambdaVariable") and list(_seq(x.nameParts()))[-1].lower() in _FUNCTIONS:
                    raise PolicyViolation("function_not_allowed", list(_seq(x.nameParts()))[-1])
                # Names that are made while the statement is analysed.
                if "UnresolvedIdentifier" in _kind(x) or _kind(x).startswith("Current"):
                    raise PolicyViolation("function_not_allowed", _kind(x))
    if role == "analyst":
        _check_names(parsed, nodes, catalog.sensitive)
    limit = min(ROW_LIMITS[role], MOST_ROWS)
    if _kind(parsed) == "GlobalLimit":
        asked = parsed.limitExpr()
        if _kind(asked) != "Literal" or int(str(asked.value())) <= 0:
            raise PolicyViolation("limit_not_positive")
        limit = min(limit, int(str(asked.value())))
    try:
        df = spark.sql(sql)
    except AnalysisException as e:
        raise PolicyViolation("not_resolved", str(e).splitlines()[0][:200]) from e
    return Decision(sql, role, tuple(sorted(tables)), limit, df.limit(limit))


def _check_names(parsed, nodes: list[tuple], sensitive: frozenset[str]) -> None:
    """Refuse an analyst's statement that shows, groups or sorts by a sensitive name outside a CTE, or shows all columns."""
    _projection(parsed)
    names = _tainted(nodes, sensitive)
    for n, in_cte in nodes:
        if in_cte:
            continue
        kind = _kind(n)
        if kind in ("Project", "Aggregate"):
            for e in _projection(n):
                if _mentions(e, set(), True):
                    raise PolicyViolation("star_not_allowed")
                if _mentions(e, names) or _kind(e) == "Alias" and e.name().lower() in sensitive:
                    raise PolicyViolation("sensitive_column", str(e)[:100])
        if kind == "Aggregate" and any(_mentions(e, names) for e in _seq(n.groupingExpressions())):
            raise PolicyViolation("sensitive_group")
        if kind == "Sort" and any(_mentions(e, names) for e in _seq(n.order())):
            raise PolicyViolation("sensitive_order")
        if kind == "WithWindowDefinition" and any(_mentions(w, names) for w in _seq(n.windowDefinitions().values())):
            raise PolicyViolation("sensitive_group", "WINDOW")
        if kind == "Pivot" and any(_mentions(e, names) for e in _seq(n.expressions())):
            raise PolicyViolation("sensitive_column", "PIVOT")


def _rows(spark: SparkSession, decision: Decision, timeout: float) -> list:
    """The result's rows, at most the decision's limit; its jobs are cancelled at the timeout."""
    group = f"policy-{id(decision)}"
    spark.sparkContext.setJobGroup(group, decision.sql[:100], interruptOnCancel=True)
    timer = threading.Timer(timeout, spark.sparkContext.cancelJobGroup, [group])
    timer.start()
    try:
        return decision.result.collect()
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def run(spark: SparkSession, sql: str, catalog: Catalog, role: str = "analyst", timeout: float = TIMEOUT_SECONDS) -> list:
    """Rows of a checked query; its jobs are cancelled at the timeout."""
    return _rows(spark, evaluate(spark, sql, catalog, role), timeout)


def guarded(spark: SparkSession, sql: str, catalog: Catalog, contract: Contract | None = None, audit: str | None = None, role: str = "analyst", timeout: float = TIMEOUT_SECONDS) -> tuple[DataFrame | None, Verdict]:
    """(rows, verdict) of one scan: policy, the role's limit, execution under the timeout, validation against the contract, and an audit row.

    The rows are None unless the verdict is valid or, without a contract, always there. A result as long as the role's limit counts as cut
    off. A refused or failed query raises as in `run`; it is audited all the same, with its secrets replaced.
    """
    began, seen = time.monotonic(), {"status": "failed", "reason": "", "rows": 0, "tables": ""}
    try:
        decision = evaluate(spark, sql, catalog, role)
        rows = _rows(spark, decision, timeout)
        seen |= {"rows": len(rows), "tables": ",".join(decision.tables)}
        df = spark.createDataFrame(rows, decision.result.schema)
        verdict = Verdict("valid", "unchecked", len(rows)) if contract is None else validate(df, replace(contract, limit_applied=contract.limit_applied or len(rows) >= min(ROW_LIMITS[role], MOST_ROWS)))
        seen |= {"status": verdict.state, "reason": verdict.reason}
        return (df if verdict.state == "valid" else None), verdict
    except PolicyViolation as e:
        seen |= {"status": "refused", "reason": e.code}
        raise
    finally:
        if audit:
            row = (datetime.now(UTC).replace(tzinfo=None), role, hashlib.sha256(sql.encode()).hexdigest()[:16], sql, seen["tables"], seen["status"], seen["reason"], seen["rows"], int((time.monotonic() - began) * 1000))
            append_audit(spark.createDataFrame([row], "created_at timestamp, role string, fingerprint string, sql string, tables string, status string, reason string, rows long, millis long"), audit)


def run_with_repair(spark: SparkSession, sql: str, catalog: Catalog, candidate: Callable[[str, str], str | None], role: str = "analyst") -> list:
    """Rows of a query; if it names something unknown or is misspelt, of one other candidate, which meets the same policy."""
    try:
        return run(spark, sql, catalog, role)
    except PolicyViolation as e:
        if e.code not in ("syntax", "not_resolved") or not (other := candidate(sql, e.code)) or other.strip() == sql.strip():
            raise
        return run(spark, other, catalog, role)
