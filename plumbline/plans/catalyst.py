"""What Spark's plans tell about a frame. The only module that reaches into the JVM; without it there are no hints."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession


def _plan(df: DataFrame, which: str):
    return getattr(df._jdf.queryExecution(), which)()


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def condition_of(df: DataFrame) -> str:
    """The condition of the filter on top of the plan, as SQL; empty where there is none."""
    plan = _plan(df, "analyzed")
    return plan.condition().sql() if plan.nodeName() == "Filter" else ""


def expression_of(df: DataFrame, column: str) -> str:
    """The expression that the operator on top makes the column of, as SQL; empty where it only passes the column on."""
    plan = _plan(df, "analyzed")
    for e in _made(plan):
        if e.nodeName() == "Alias" and e.name() == column and e.child().nodeName() != "AttributeReference":
            return e.child().sql()
    return ""


#: Operators that are worth computing once.
_WORK = {"Join", "Aggregate", "Window", "Sort", "Filter", "Generate", "Deduplicate", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas"}


def repeated(frames: dict[int, DataFrame]) -> list[tuple[int, list[int]]]:
    """Parts of plans that occur more than once over all frames: the part's canonical hash and the frames, one for each occurrence.

    Canonical hashes make no difference of names and ids of attributes. Only parts with work in them are told, and of parts
    that occur together, the largest.
    """
    met: dict[int, list[int]] = {}
    works: dict[int, bool] = {}
    above: dict[int, set[int | None]] = {}

    def walk(n: int, plan, parent: int | None) -> bool:
        key = plan.semanticHash()
        if key != parent:  # an operator that only names columns anew is the same as what is below it
            met.setdefault(key, []).append(n)
            above.setdefault(key, set()).add(parent)
        below = [walk(n, child, key) for child in _list(plan.children())]
        works[key] = works.get(key, False) or plan.nodeName() in _WORK or any(below)
        return works[key]

    for n, df in frames.items():
        walk(n, _plan(df, "analyzed"), None)
    often = {k for k, places in met.items() if len(places) > 1 and works[k]}
    # a part that never occurs but below a part that is told as often is not told again
    return [(k, met[k]) for k in met if k in often and not all(p in often and len(met[p]) == len(met[k]) for p in above[k])]


#: Expressions that hold a query of their own.
_SUBQUERIES = ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery")


def relations(spark: SparkSession, query: str) -> set[tuple[str, ...]]:
    """The tables that a query reads, by the parts of their names: those of its parsed plan, subqueries included.

    A name that WITH defines hides a table of that name in what comes after it, not in its own definition. Text in
    literals, comments, aliases and columns names no table. Nothing is looked up, so the tables need not exist.
    """
    found: set[tuple[str, ...]] = set()

    def expression(e, hidden: frozenset[str]) -> None:
        if e.getClass().getSimpleName() in _SUBQUERIES:
            walk(e.plan(), hidden)
        for child in _list(e.children()):
            expression(child, hidden)

    def walk(plan, hidden: frozenset[str]) -> None:
        kind = plan.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            parts = tuple(_list(plan.multipartIdentifier()))
            if len(parts) > 1 or parts[0].lower() not in hidden:
                found.add(parts)
        if kind == "UnresolvedWith":
            for cte in _list(plan.cteRelations()):
                own = hidden | {cte._1().lower()} if plan.allowRecursion() else hidden
                walk(cte._2(), own)
                hidden = hidden | {cte._1().lower()}
            walk(plan.child(), hidden)
            return
        for e in _list(plan.expressions()):
            expression(e, hidden)
        for child in _list(plan.children()):
            walk(child, hidden)

    walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(query), frozenset())
    return found


def observed(observation: Observation) -> bool:
    """Whether the metrics of an observation are there to be read."""
    return observation._jo is not None and observation._jo.future().isCompleted()


def filter_columns(df: DataFrame) -> set[str]:
    """The columns that the filter on top of the plan reads."""
    plan = _plan(df, "analyzed")
    if plan.nodeName() != "Filter":
        return set()
    it, out = plan.condition().references().iterator(), set()
    while it.hasNext():
        out.add(it.next().name())
    return out


def has_sort(df: DataFrame) -> bool:
    """Whether a sort below the top is left in the optimized plan."""
    return bool(re.search(r"^\W+Sort \[", _plan(df, "optimizedPlan").toString(), re.M))


def narrowed(df: DataFrame) -> bool:
    """Whether the optimizer turned an outer join of the plan into one with fewer rows."""
    count = lambda which: [len(re.findall(rf"Join {k}\b", _plan(df, which).toString())) for k in ("FullOuter", "LeftOuter", "RightOuter")]
    before, after = count("analyzed"), count("optimizedPlan")
    return sum(after) < sum(before) or after[0] < before[0]


def _nodes(plan):
    yield plan
    for child in _list(plan.children()):
        yield from _nodes(child)


def _ids(attributes) -> set[int]:
    """The ids of a set of attributes."""
    it, out = attributes.iterator(), set()
    while it.hasNext():
        out.add(it.next().exprId().id())
    return out


def lineage(df: DataFrame) -> dict[str, int]:
    """Column to the id of the attribute it is."""
    return {a.name(): a.exprId().id() for a in _list(_plan(df, "analyzed").output())}


def _made(plan) -> list:
    """The expressions that give a node's own columns: those of projections, aggregates and windows."""
    name = plan.nodeName()
    if name == "Project":
        return _list(plan.projectList())
    if name == "Aggregate":
        return _list(plan.aggregateExpressions())
    return _list(plan.windowExpressions()) if name == "Window" else []


def renames(a: DataFrame, b: DataFrame) -> dict[str, str]:
    """Columns of b that are a column of a under another name: followed through aliases of nothing but an attribute."""
    known = {v: k for k, v in lineage(a).items()}
    same: dict[int, int] = {}
    for node in _nodes(_plan(b, "analyzed")):
        for e in _made(node):
            if e.nodeName() == "Alias" and e.child().nodeName() == "AttributeReference":
                same[e.exprId().id()] = e.child().exprId().id()
    out = {}
    for name, i in lineage(b).items():
        while i not in known and i in same:
            i = same[i]
        if i in known and known[i] != name:
            out[name] = known[i]
    return out


def origins(df: DataFrame, sources: list[DataFrame]) -> dict[str, list[tuple[int, str]]]:
    """The columns of sources (by number and name) that each column of df is made of, through any operator.

    A column that an operator makes of rows as a whole (a Python function of batches) is made of all that it reads.
    """
    found: dict[int, set[tuple[int, str]]] = {}
    relations: dict[int, list[int]] = {}
    for n, source in enumerate(sources):
        for name, i in lineage(source).items():
            found.setdefault(i, set()).add((n, name))
        for node in _nodes(_plan(source, "analyzed")):
            if not _list(node.children()):
                relations.setdefault(node.semanticHash(), [a.exprId().id() for a in _list(node.output())])
    of = lambda ids: set().union(*[found.get(i, set()) for i in ids])

    def walk(plan) -> None:
        children = _list(plan.children())
        out = [a.exprId().id() for a in _list(plan.output())]
        if all(i in found for i in out):
            return
        if not children:  # a relation that a plan reads twice has new ids the second time
            for mine, copy in zip(relations.get(plan.semanticHash(), []), out, strict=False):
                if mine in found:
                    found.setdefault(copy, found[mine])
        for child in children:
            walk(child)
        for e in _made(plan):
            if e.exprId().id() not in found:
                found[e.exprId().id()] = of(_ids(e.references()))
        if plan.nodeName() == "Union":
            sides = [[a.exprId().id() for a in _list(c.output())] for c in children]
            for k, i in enumerate(out):
                found[i] = found.get(i, set()) | of([side[k] for side in sides])
        elif plan.nodeName() == "Generate":
            for i in out:
                found.setdefault(i, of(_ids(plan.generator().references())))
        elif plan.nodeName() == "Expand":
            rows = [_list(r) for r in _list(plan.projections())]
            for k, i in enumerate(out):
                found.setdefault(i, of(set().union(*[_ids(r[k].references()) for r in rows])))
        below = [a.exprId().id() for c in children for a in _list(c.output())]
        for i in out:
            if i not in found:
                found[i] = of(below)

    walk(_plan(df, "analyzed"))
    return {name: sorted(found.get(i, set())) for name, i in lineage(df).items()}


def unused_columns(pipeline, step) -> list[str]:
    """Columns of a source that no result needs: neither a result nor an operator of its optimized plan reads the attribute.

    Attributes are told apart by their ids, not names. The optimizer gives a source that is read twice in one plan new
    ids; such a copy is known by its relation, unless it is another source of the pipeline.
    """
    results = [s for s in pipeline.steps if not pipeline.consumers(s) and s is not step]
    if not results:
        return []
    own = lineage(step.df)
    others = {i for s in pipeline.steps if not s.inputs and s is not step for i in lineage(s.df).values()}
    leaves = {n.semanticHash(): [a.exprId().id() for a in _list(n.output())] for n in _nodes(_plan(step.df, "analyzed")) if not _list(n.children())}
    used: set[int] = set()
    for plan in (_plan(s.df, "optimizedPlan") for s in results):
        read, copies = {a.exprId().id() for a in _list(plan.output())}, {}
        for node in _nodes(plan):
            if _list(node.children()):
                read |= _ids(node.references())
        for node in _nodes(plan):
            if not _list(node.children()):
                outputs = [a.exprId().id() for a in _list(node.output())]
                for mine, copy in zip(leaves.get(node.semanticHash(), []), outputs, strict=False):
                    if copy != mine and copy not in others:
                        copies[copy] = mine
        used |= read | {copies[i] for i in read if i in copies}
    same = _aliases(_plan(step.df, "analyzed"))
    return [c for c, i in own.items() if i not in used and not _reaches(same, used, i)]


def _aliases(plan) -> dict[int, int]:
    return {e.exprId().id(): e.child().exprId().id() for node in _nodes(plan) for e in _made(node) if e.nodeName() == "Alias" and e.child().nodeName() == "AttributeReference"}


def _reaches(same: dict[int, int], used: set[int], i: int) -> bool:
    """Whether an attribute below, of which this one is an alias, is used: the optimizer puts it in the alias's place."""
    while i in same:
        i = same[i]
        if i in used:
            return True
    return False
