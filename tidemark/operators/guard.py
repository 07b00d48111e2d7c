"""What a query reads, found on its plan's nodes and expressions, and refused unless it is known.

`relations` walks the plan as it was parsed, before any name is looked up; `read_only` walks it
once more when names are resolved, and compares what lies behind each name with what it stands
for. Both refuse by default: a node or leaf that is not listed here is no part of a query that is let through.
Nothing is matched in the text of a query or of a plan.
"""

from __future__ import annotations

from collections.abc import Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


class Refused(ValueError):
    """An input that the operators refuse rather than guess about."""


#: Nodes of parsed queries. Other ones, commands, functions that give tables and names from expressions among them, are refused.
PARSED = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Distinct Deduplicate Union Intersect Except UnresolvedWith Join SubqueryAlias UnresolvedRelation UnresolvedHaving WithWindowDefinition Offset "
    "UnresolvedSubqueryColumnAliases LateralJoin Pivot Unpivot OneRowRelation UnresolvedInlineTable ResolvedInlineTable LocalRelation Generate UnresolvedHint Sample".split()
)
#: Leaves of resolved queries that hold no table: rows written in the query, and references to its own names.
BARE = frozenset("OneRowRelation LocalRelation ResolvedInlineTable CTERelationRef".split())
#: Expressions whose function or column is named by an expression, and functions that call code by name.
NAMING = frozenset("ExpressionWithUnresolvedIdentifier PlanWithUnresolvedIdentifier UnresolvedIdentifier".split())
CALLING = frozenset("reflect java_method try_reflect".split())
EXPRESSION = "org.apache.spark.sql.catalyst.expressions.Expression"
SUBQUERY = "org.apache.spark.sql.catalyst.expressions.PlanExpression"
PLAN = "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"


def every(seq: JavaObject) -> Iterator[JavaObject]:
    return (seq.apply(i) for i in range(seq.size()))


def kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def isa(node: JavaObject, name: str) -> bool:
    return is_instance_of(SparkContext._gateway, node, name)


def expressions(node: JavaObject) -> Iterator[JavaObject]:
    """All expressions of a plan's node, with those inside them."""
    open_ = list(every(node.expressions()))
    while open_:
        e = open_.pop()
        yield e
        open_ += every(e.children())


def plans_in(node: JavaObject) -> Iterator[JavaObject]:
    """The plans of the subqueries among a node's expressions."""
    return (e.plan() for e in expressions(node) if isa(e, SUBQUERY))


def parsed(spark: SparkSession, text: str) -> JavaObject:
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(text)


def relations(spark: SparkSession, text: str) -> tuple[set[str], set[str]]:
    """The names in lower case that a query reads from outside, and those it gives to queries of its own. A name of its own counts only where it is in scope."""
    read: set[str] = set()
    own: set[str] = set()
    builtin, named = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin(), spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier

    def checked(node: JavaObject) -> None:
        for e in expressions(node):
            what = kind(e)
            if what in NAMING:
                raise Refused("names are written as they are, not computed")
            if what in ("UnresolvedFunction", "UnresolvedGenerator"):
                parts = [str(x).lower() for x in every(e.nameParts())] if what == "UnresolvedFunction" else [str(e.name().funcName()).lower()]
                if len(parts) != 1 or parts[0] in CALLING or not builtin.functionExists(named(parts[0])):
                    raise Refused(f"only functions that the engine brings are called here, not {'.'.join(parts)}")

    open_: list[tuple[JavaObject, frozenset[str]]] = [(parsed(spark, text), frozenset())]
    while open_:
        node, scope = open_.pop()
        what = kind(node)
        if what not in PARSED:
            raise Refused(f"no part of a query that is read here: {what}")
        checked(node)
        if what == "UnresolvedWith":
            inner = scope
            for pair in every(node.cteRelations()):
                name = str(pair.productElement(0)).lower()
                open_.append((pair.productElement(1), inner | {name} if node.allowRecursion() else inner))
                inner, _ = inner | {name}, own.add(name)
            open_.append((node.child(), inner))
            continue
        if what == "UnresolvedRelation":
            parts = [str(x).lower() for x in every(node.multipartIdentifier())]
            if len(parts) != 1:
                raise Refused(f"not registered, so not versioned: {'.'.join(parts)}")
            if parts[0] not in scope:
                read.add(parts[0])
        open_ += [(x, scope) for x in every(node.children())]
        open_ += [(x, scope) for x in every(node.innerChildren()) if isa(x, PLAN)]
        open_ += [(x, scope) for x in plans_in(node)]
    return read, own


def read_only(df: DataFrame, tables: dict[str, DataFrame]) -> None:
    """Refuses a resolved query that reaches anything but rows of its own and the views named in `tables`, or a view that is not the frame it stands for."""
    frames = {n.lower(): t._jdf.queryExecution().analyzed() for n, t in tables.items()}
    open_ = [df._jdf.queryExecution().analyzed()]
    while open_:
        node = open_.pop()
        what = kind(node)
        if what == "View":
            name = str(node.desc().identifier().table()).lower()
            if name not in frames or not node.isTempView() or not node.child().sameResult(frames[name]):
                raise Refused(f"not what is registered as {name}")
            continue
        children = [*every(node.children()), *(x for x in every(node.innerChildren()) if isa(x, PLAN)), *plans_in(node)]
        if not node.children().size() and what not in BARE:
            raise Refused(f"not registered, so not versioned: {what}")
        open_ += children
