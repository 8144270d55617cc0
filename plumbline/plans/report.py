"""The facts about each step, and what the rules make of them: findings, generated checks, hints, differences."""

from __future__ import annotations

import json
import re
import time
from collections import deque
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import filters, groups, joins, profile
from plumbline.plans import catalyst
from plumbline.plans.observed import JOBS, Runs
from plumbline.plans.pipeline import ROW_WISE, TYPE_OPS, Pipeline, Step

#: Rows of an example, columns of null examples for a step, columns up to which a schema check is made.
EXAMPLE_ROWS, NULL_COLUMNS, SCHEMA_COLUMNS = 5, 3, 40
#: Categories whose dropped rows Report.examples can show.
SHOWN = ("filter", "other")
#: Share of rows lost from which a loss is a warning, and from which an earlier filter is worth a hint.
GREAT_LOSS, WORTH = 0.5, 0.1


@dataclass
class Facts:
    rows: int
    dtypes: dict[str, str]
    nulls: dict[str, int]
    n_unique: dict[str, int | None] = field(default_factory=dict)
    details: dict = field(default_factory=dict)
    #: Seconds of the run that counted the step (with all others it counted), and the optimizer's estimate of the frame's bytes.
    seconds: float = 0.0
    bytes: int = 0


@dataclass
class Finding:
    kind: str
    severity: str
    step: int
    message: str
    column: str | None = None
    #: The kind of Report.examples that shows rows of it.
    example: str | None = None


@dataclass
class Hint:
    kind: str
    step: int
    message: str
    #: "auto": Catalyst does it already; "actionable": it can't.
    status: str
    #: Code to write instead.
    suggestion: str = ""


@dataclass
class Check:
    kind: str
    step: int
    code: str
    passes: bool
    reason: str


def facts(df: DataFrame, distinct: bool) -> Facts:
    """Distinct values are exact up to profile.EXACT_ROWS rows, estimated beyond."""
    began = time.monotonic()
    rows = profile.profile(df, distinct, distinct and df.count() > profile.EXACT_ROWS).collect()
    out = Facts(rows[0]["rows"] if rows else df.count(), dict(df.dtypes), {r["column"]: r["null_count"] for r in rows}, {r["column"]: r["n_unique"] for r in rows} if distinct else {})
    out.seconds = round(time.monotonic() - began, 3)
    return out


def numbers(pipeline: Pipeline, s: Step, frames: dict[int, DataFrame]) -> dict:
    """What one aggregate of the keys tells of a join's or a grouping's inputs; nothing of other steps. frames: cached ones."""
    before = [frames.get(i, pipeline.steps[i].df) for i, _ in s.inputs]
    if s.category == "join" and s.args["how"] in ("inner", "left", "right", "outer"):
        return joins.join_stats(*before, s.args["left_on"], s.args["right_on"], s.args["how"], s.args["null_safe"]).first().asDict()
    if s.op in ("groupby", "value_counts") and before:
        return groups.group_stats(before[0], s.args["keys"], s.args["dropna"]).first().asDict()
    return {}


def measure(pipeline: Pipeline, distinct: bool, cache_shared: bool) -> tuple[dict[int, Facts], dict[int, dict]]:
    """The facts of all steps, from one run of each result where that is sure to count all of them, and the numbers of joins and groupings."""
    runs = Runs(pipeline, distinct, cache_shared)
    try:
        seen = runs.run()
        cached = {i: runs.frames[i] for i in runs.cached}
        with ThreadPoolExecutor(JOBS) as pool:
            counted = dict(zip([s.id for s in pipeline.steps], pool.map(lambda s: numbers(pipeline, s, cached), pipeline.steps), strict=True))
            for s in pipeline.steps:
                if s.category == "join" and counted[s.id]:
                    for (i, _), rows in zip(s.inputs, (counted[s.id]["rows_left"], counted[s.id]["rows_right"]), strict=True):
                        if i in seen and seen[i]["rows"] != rows:
                            for k in runs.above(i):
                                seen.pop(k, None)
            alone = [s for s in pipeline.steps if s.id not in seen or (distinct and seen[s.id]["rows"] <= profile.EXACT_ROWS)]
            known = dict(zip([s.id for s in alone], pool.map(lambda s: facts(cached.get(s.id, s.df), distinct), alone), strict=True))
    finally:
        runs.release()
    for s in pipeline.steps:
        if s.id not in known:
            m = seen[s.id]
            known[s.id] = Facts(m["rows"], dict(s.df.dtypes), m["nulls"], m["distinct"] if distinct else {}, seconds=runs.seconds[runs.run_of[s.id]])
    return {s.id: known[s.id] for s in pipeline.steps}, counted


class Report:
    def __init__(self, pipeline: Pipeline, known: dict[int, Facts]):
        self.pipeline, self.facts = pipeline, known
        self.findings = findings(pipeline, known)
        self.checks = checks(pipeline, known, self.findings)
        self.hints = hints(pipeline, known)

    @classmethod
    def of(cls, pipeline: Pipeline, distinct: bool, cache_shared: bool) -> Report:
        if not pipeline.steps:
            return cls(pipeline, {})
        known, counted = measure(pipeline, distinct, cache_shared)
        for s in pipeline.steps:
            f = known[s.id]
            f.details = counted[s.id]
            before = [pipeline.steps[i] for i, _ in s.inputs]
            if s.category in ("filter", "limit") and before:
                n = known[before[0].id].rows
                f.details = {"rows_in": n, "rows_out": f.rows, "rows_dropped": n - f.rows, "pct_kept": round(100 * f.rows / n, 2) if n else None}
            elif s.category == "join" and f.details:
                left, right = before
                f.details |= {"key_types": joins.key_type_mismatches(left.df, right.df, s.args["left_on"], s.args["right_on"]), "collisions": joins.suffix_collisions(left.df, right.df, s.df, s.args["suffixes"])}
            elif s.category == "join" and s.args["how"] == "cross":
                a, b = (known[x.id].rows for x in before)
                f.details = {"rows_left": a, "rows_right": b, "rows_out": f.rows, "explosion_factor": round(f.rows / a, 4) if a else None}
            elif s.op == "concat":
                f.details = {"rows_per_input": [known[b.id].rows for b in before], "rows_out": f.rows, "columns_not_in_all_inputs": joins.columns_not_in_all([b.df for b in before])}
        for s in pipeline.steps:
            known[s.id].bytes = profile.estimated_bytes(s.df)
            if not s.inputs:
                files = s.df.inputFiles()
                known[s.id].details = {"files": len(files), "first_file": min(files, default=None), "columns": len(s.df.columns), "bytes": known[s.id].bytes}
        return cls(pipeline, known)

    def examples(self, step: Step, kind: str, order_by: list, column: str | None = None, n: int = EXAMPLE_ROWS) -> DataFrame:
        """Up to n rows: dropped, unmatched_left, unmatched_right, duplicate_keys_left, duplicate_keys_right, null_keys_left, null_keys_right or nulls."""
        before = [self.pipeline.steps[i].df for i, _ in step.inputs]
        if kind == "nulls":
            found = step.df.where(F.col(column).isNull())
        elif kind == "dropped" and step.op in ("filter", "query"):
            found = filters.dropped_rows(before[0], step.args["condition"])
        elif kind == "dropped" and step.op == "dropna":
            found = filters.missing_rows(before[0], step.args["subset"], step.args["how"], step.args["thresh"])
        elif kind == "dropped" and step.op == "drop_duplicates":
            found = filters.duplicates(before[0], step.args["keys"], step.args["order_by"], step.args["keep"])
        elif kind == "dropped":
            if step.category != "filter" and (step.category != "other" or set(step.df.columns) != set(before[0].columns)):
                raise ValueError(f"{step.op} has no examples of dropped rows")
            found = filters.lost_rows(before[0], step.df, n)
        else:
            what, side = kind.rsplit("_", 1)
            own, other = (before[0], before[1]) if side == "left" else (before[1], before[0])
            a, b = (step.args["left_on"], step.args["right_on"]) if side == "left" else (step.args["right_on"], step.args["left_on"])
            found = joins.unmatched(own, other, a, b, step.args["null_safe"]) if what == "unmatched" else joins.duplicate_key_rows(own, a) if what == "duplicate_keys" else joins.null_key_rows(own, a)
        return found.orderBy(*order_by).limit(n)

    def null_examples(self, step: Step, order_by: list) -> dict[str, DataFrame]:
        """Rows with nulls for each of the first NULL_COLUMNS columns that have more nulls than before the step."""
        before = self.facts[step.inputs[0][0]].nulls if step.inputs else {}
        rose = [c for c, n in self.facts[step.id].nulls.items() if n > before.get(c, 0)]
        return {c: self.examples(step, "nulls", order_by, column=c) for c in rose[:NULL_COLUMNS]}

    def example_of(self, finding: Finding, order_by: list) -> DataFrame | None:
        """Rows that show a finding, where there are any to show."""
        if not finding.example:
            return None
        return self.examples(self.pipeline.steps[finding.step], finding.example, order_by, finding.column)

    def schema_change(self, step: Step) -> dict:
        if not step.inputs:
            return {"added": [], "removed": [], "dtype_changed": {}}
        old, new = dict(self.pipeline.steps[step.inputs[0][0]].df.dtypes), dict(step.df.dtypes)
        return {"added": [c for c in new if c not in old], "removed": [c for c in old if c not in new], "dtype_changed": {c: (old[c], new[c]) for c in new if c in old and old[c] != new[c]}}

    def as_dataframes(self, spark: SparkSession) -> dict[str, DataFrame]:
        steps = [(s.id, s.op, s.category, s.label, s.name, self.facts[s.id].rows, json.dumps(self.facts[s.id].details, default=str)) for s in self.pipeline.steps]
        edges = [(i, s.id, role) for s in self.pipeline.steps for i, role in s.inputs]
        return {
            "steps": spark.createDataFrame(steps, "id int, op string, category string, label string, name string, rows long, details string"),
            "edges": spark.createDataFrame(edges, "source int, target int, role string"),
            "checks": spark.createDataFrame([(c.kind, c.step, c.code, c.passes, c.reason) for c in self.checks], "kind string, step int, code string, passes boolean, reason string"),
            "hints": spark.createDataFrame([(h.kind, h.step, h.message, h.status, h.suggestion) for h in self.hints], "kind string, step int, message string, status string, suggestion string"),
            "findings": spark.createDataFrame([(f.kind, f.severity, f.step, f.column, f.message) for f in self.findings], "kind string, severity string, step int, column string, message string"),
        }

    def to_json(self) -> str:
        steps = [{"id": s.id, "op": s.op, "category": s.category, "label": s.label, "name": s.name, "site": s.site, "inputs": s.inputs, "schema_change": self.schema_change(s), **asdict(self.facts[s.id])} for s in self.pipeline.steps]
        return json.dumps({"steps": steps, "findings": [asdict(f) for f in self.findings], "checks": [asdict(c) for c in self.checks], "hints": [asdict(h) for h in self.hints], "warnings": self.pipeline.warnings}, default=str)

    def text(self) -> str:
        lines = [f"{s.id:>3} {s.category:<10} {s.label}: {self.facts[s.id].rows} rows, {len(s.df.columns)} columns, {self.facts[s.id].seconds} s" for s in self.pipeline.steps]
        lines += [f"{f.severity}: step {f.step}: {f.message}" for f in self.findings]
        lines += [f"hint ({h.status}): step {h.step}: {h.message}" + (f"; write {h.suggestion}" if h.suggestion else "") for h in self.hints]
        return "\n".join(lines)

    def checks_script(self) -> str:
        """The checks as code, in order of steps; each names the frame by its step's name."""
        return "\n".join(f"{c.code}  # {'passes' if c.passes else 'FAILS'}: {c.reason}" for c in sorted(self.checks, key=lambda c: c.step)) + "\n"


def findings(pipeline: Pipeline, known: dict[int, Facts]) -> list[Finding]:
    out: list[Finding] = []
    #: Columns of each step whose nulls were told of before.
    told: dict[int, set[str]] = {}
    #: The first step that computes a frame; one that computes the same again has nothing new to tell of its nulls.
    computed: dict[int, int] = {}
    for s in pipeline.steps:
        f = known[s.id]
        again = computed.setdefault(s.df.semanticHash(), s.id)
        if not s.inputs:
            continue
        before = known[s.inputs[0][0]]
        d = f.details
        if before.rows and not f.rows:
            out.append(Finding("row_loss", "error", s.id, f"no rows are left of {before.rows}", example="dropped" if s.category in SHOWN else None))
        elif f.rows < before.rows and (s.category in ("filter", "limit") or (s.category == "other" and set(f.dtypes) == set(before.dtypes))):
            lost = before.rows - f.rows
            out.append(Finding("row_loss", "warning" if lost >= GREAT_LOSS * before.rows else "info", s.id, f"{lost} of {before.rows} rows are dropped" + _where(s), example="dropped" if s.category in SHOWN else None))
        # a column is the one it was before under another name, or the one of its own name
        old = {c: c for c in f.nulls} | catalyst.renames(pipeline.steps[s.inputs[0][0]].df, s.df)
        told[s.id] = {c for c in f.nulls if c in told.get(again, ()) or any(old[c] in told.get(i, ()) or c in told.get(i, ()) for i, _ in s.inputs)}
        rose = [c for c, n in f.nulls.items() if n > before.nulls.get(old[c], 0)]
        if not (s.category == "reshape" and sum(f.nulls.values()) <= sum(before.nulls.values())):
            for c in rose:
                if c not in told[s.id]:
                    told[s.id].add(c)
                    out.append(Finding("null_origin", "warning", s.id, f"nulls of {c} first appear here: {_null_origin(s, c, before.nulls.get(old[c], 0), f.nulls[c])}", c, "nulls"))
        if s.op not in TYPE_OPS:
            for c, t in f.dtypes.items():
                if c in before.dtypes and before.dtypes[c] != t:
                    out.append(Finding("dtype_drift", "warning", s.id, f"{c} was {before.dtypes[c]} and is {t}", c))
        if s.category == "join" and "cardinality" in d:
            how = s.args["how"]
            if d["cardinality"] == "m:m":
                out.append(Finding("join", "error", s.id, "keys repeat on both sides", example="duplicate_keys_right"))
            if d["explosion_factor"] and d["explosion_factor"] > 1 and how in ("left", "inner"):
                out.append(Finding("row_explosion", "warning", s.id, f"each left row makes {d['explosion_factor']} rows", example="duplicate_keys_right"))
            if d["left_only"] and how == "inner":
                out.append(Finding("row_loss", "warning", s.id, f"{d['left_only']} left rows have no match and are lost", example="unmatched_left"))
            if d["left_only"] and how == "left":
                out.append(Finding("join", "info", s.id, f"{d['left_only']} left rows have no match", example="unmatched_left"))
            for a, ta, b, tb in d["key_types"]:
                out.append(Finding("join", "warning", s.id, f"keys differ in type: {a} {ta}, {b} {tb}", a))
            if d["collisions"]:
                out.append(Finding("join", "info", s.id, f"columns of both sides got suffixes: {', '.join(d['collisions'])}"))
            if d["left_null_keys"] or d["right_null_keys"]:
                means = "match each other" if s.args["null_safe"] else "match nothing"
                out.append(Finding("join", "warning", s.id, f"null keys {means}: {d['left_null_keys']} left, {d['right_null_keys']} right", example="null_keys_left" if d["left_null_keys"] else "null_keys_right"))
    return out


def _where(s: Step) -> str:
    """The text of a filter's condition and the place in the caller's code, for a message."""
    condition = catalyst.condition_of(s.df) if s.op in ("filter", "query") else ""
    return (f" by {condition}" if condition else "") + (f" ({s.site})" if s.site else "")


def _null_origin(s: Step, column: str, before: int, after: int) -> str:
    """Why nulls of a column may appear at a step: for a computed column with its expression and the place in the caller's code."""
    if s.category == "join":
        return f"rows without a match on the other side: {after} nulls"
    if s.op == "concat":
        return f"not every input of concat has a value there: {before} nulls in the first input, {after} after"
    if s.category == "reshape" or s.op in ("pivot_table", "crosstab"):
        return f"combinations that don't occur: {after} nulls"
    made = catalyst.expression_of(s.df, column)
    return f"the step's expression gives null: {before} before, {after} after" + (f"; {column} is {made}" if made else "") + (f" ({s.site})" if s.site else "")


def checks(pipeline: Pipeline, known: dict[int, Facts], found: list[Finding]) -> list[Check]:
    """Assertions to put after the steps; passes says how each comes out on the data seen."""
    out: list[Check] = []
    name = lambda s: s.name or f"step_{s.id}"
    for s in pipeline.steps:
        f, d = known[s.id], known[s.id].details
        before = [pipeline.steps[i] for i, _ in s.inputs]
        if s.category == "join" and "cardinality" in d:
            side, keys = (before[1], s.args["right_on"]) if d["suggested_validate"] == "m:1" else (before[0], s.args["left_on"])
            out.append(Check("unique_keys", s.id, f"assert {name(side)}.count() == {name(side)}.select({keys!r}).distinct().count()", d["validate_passes"], f"join {d['suggested_validate']}"))
            for b, k, n in ((before[0], s.args["left_on"], d["left_null_keys"]), (before[1], s.args["right_on"], d["right_null_keys"])):
                if not n:
                    test = " OR ".join(f"`{c}` IS NULL" for c in k)
                    out.append(Check("not_null", s.id, f"assert {name(b)}.filter({test!r}).isEmpty()", True, "join keys hold no null"))
            if s.args["how"] == "left":
                out.append(Check("row_count", s.id, f"assert {name(s)}.count() == {name(before[0])}.count()", f.rows == known[before[0].id].rows, "a left join keeps the number of rows"))
        if (s.category == "join" and s.args["how"] == "inner") or s.category in ("filter", "limit"):
            out.append(Check("not_empty", s.id, f"assert not {name(s)}.isEmpty()", f.rows > 0, "rows are left"))
        if s.name and not pipeline.consumers(s) and len(f.dtypes) <= SCHEMA_COLUMNS:
            out.append(Check("schema", s.id, f"assert dict({name(s)}.dtypes) == {f.dtypes!r}", True, "the result's columns and types"))
            for c, n in f.n_unique.items():
                if n == f.rows and f.rows > 1 and not f.nulls[c]:
                    out.append(Check("unique", s.id, f"assert {name(s)}.select({c!r}).distinct().count() == {name(s)}.count()", True, f"{c} is unique"))
    for x in found:
        s = pipeline.steps[x.step]
        if x.kind == "null_origin":
            out.append(Check("not_null", s.id, f"assert {name(s)}.filter({f'`{x.column}` IS NULL'!r}).isEmpty()", False, x.message))
        elif x.kind == "dtype_drift":
            old = known[s.inputs[0][0]].dtypes[x.column]
            out.append(Check("dtype", s.id, f"assert dict({name(s)}.dtypes)[{x.column!r}] == {old!r}", False, x.message))
    return out


def hints(pipeline: Pipeline, known: dict[int, Facts]) -> list[Hint]:
    """Rewrites that help; those that Catalyst makes by itself are marked so."""
    out: list[Hint] = []
    reads: dict[str, int] = {}
    for s in pipeline.steps:
        d = known[s.id].details
        if s.op in ("filter", "query") and d["rows_in"] and d["rows_dropped"] >= WORTH * d["rows_in"]:
            before = pipeline.steps[s.inputs[0][0]]
            used = catalyst.filter_columns(s.df)
            if before.category == "join" and len(pipeline.consumers(before)) == 1:
                if used and _one_side(pipeline, before, used):
                    out.append(Hint("filter_before_join", s.id, f"{', '.join(sorted(used))} could be filtered before the join", "auto", f"{s.label} on the input of step {before.id} that has the columns"))
                if catalyst.narrowed(s.df):
                    out.append(Hint("join_narrowed", s.id, "this filter makes the outer join an inner one", "actionable", "how='inner'"))
            elif before.category == "sort" or (before.op in ROW_WISE and used and not used & set(before.args["touched"])):
                out.append(Hint("filter_earlier", s.id, f"the filter could come before {before.op}", "auto", f"{s.label}, then {before.label}"))
        if s.category == "sort":
            after = pipeline.consumers(s)
            if len(after) == 1 and after[0].category == "sort":
                out.append(Hint("useless_sort", s.id, "the next step sorts anew", "auto", after[0].label))
            elif len(after) == 1 and after[0].op in ("groupby", "agg", "value_counts") and not any(_ORDERED.search(str(c)) for c in after[0].args.get("made", {}).values()):
                kept = catalyst.has_sort(after[0].df)
                out.append(Hint("useless_sort", s.id, "the order doesn't matter to the aggregate that follows", "actionable" if kept else "auto", after[0].label))
        if s.op == "apply":
            out.append(Hint("row_apply", s.id, "a Python function; an expression would stay in the JVM", "actionable", "assign() with functions of pyspark.sql"))
        if not s.inputs:
            unused = catalyst.unused_columns(pipeline, s)
            if unused:
                out.append(Hint("unused_columns", s.id, f"no later step reads {', '.join(unused)}", "auto", f"select({', '.join(repr(c) for c in s.df.columns if c not in unused)})"))
            for path in s.df.inputFiles():
                if path in reads and reads[path] != s.id:
                    out.append(Hint("duplicate_read", s.id, f"step {reads[path]} reads the same files; cache() would save a scan", "actionable", f"the frame of step {reads[path]}"))
                    break
                reads[path] = s.id
    steps: dict[int, Step] = {}
    for s in pipeline.steps:
        steps.setdefault(s.df.semanticHash(), s)
    for part, users in catalyst.repeated({s.id: s.df for s in pipeline.steps if not pipeline.consumers(s)}):
        if part in steps:
            s = steps[part]
            out.append(Hint("repeated_work", s.id, f"computed {len(users)} times, for the results of steps {', '.join(map(str, sorted({*users})))}", "actionable", f"{s.name or f'step_{s.id}'}.cache()"))
    return out


#: Aggregates whose result depends on the order of rows.
_ORDERED = re.compile(r"\b(first|last|first_value|last_value|any_value|collect_list|array_agg|listagg|string_agg)\(")


def _one_side(pipeline: Pipeline, join: Step, used: set[str]) -> bool:
    """Whether a filter on these columns of a join's result may run on one of its inputs: one that keeps no unmatched rows of the other."""
    columns = {role: set(pipeline.steps[i].df.columns) for i, role in join.inputs}
    sides = {"inner": ("left", "right"), "left": ("left",), "right": ("right",)}.get(join.args["how"], ())
    for own in sides:
        other = columns["right" if own == "left" else "left"]
        if used <= columns[own] and not used & (other - set(join.args[f"{own}_on"])):
            return True
    return False


def diff(report: Report, a: int, b: int) -> dict:
    """How step b differs from step a: relation, path, rows and columns; renames by lineage of attributes."""
    pipeline, fa, fb = report.pipeline, report.facts[a], report.facts[b]
    path, relation = _path(pipeline, a, b), "ancestor"
    if path is None:
        path, relation = _path(pipeline, b, a), "descendant"
    columns = {}
    renamed = catalyst.renames(pipeline.steps[a].df, pipeline.steps[b].df)
    for c in {**fa.dtypes, **fb.dtypes}:
        if c in fa.dtypes and c in fb.dtypes:
            same = fa.dtypes[c] == fb.dtypes[c] and fa.nulls[c] == fb.nulls[c]
            columns[c] = "same" if same else "changed"
        elif c in fb.dtypes:
            columns[c] = f"renamed from {renamed[c]}" if renamed.get(c) in fa.dtypes and renamed[c] not in fb.dtypes else "added"
        elif c not in renamed.values() or c in fb.dtypes:
            columns[c] = "removed"
    # a column that went and one that came with the same type, nulls and distinct values, alone of their kind, are likely one
    marks = lambda f, c: (f.dtypes[c], f.nulls[c], f.n_unique[c]) if (f.n_unique.get(c) or 0) > 1 else None
    gone, come = ([(c, marks(f, c)) for c, how in columns.items() if how == kind] for f, kind in ((fa, "removed"), (fb, "added")))
    for c, mark in come:
        same = [a for a, m in gone if m == mark]
        if mark and fa.rows == fb.rows and len(same) == 1 and [m for _, m in come].count(mark) == 1:
            columns[c] = f"likely renamed from {same[0]}"
            del columns[same[0]]
    return {"relation": "same" if a == b else relation if path is not None else "unrelated", "path": path or [], "rows": (fa.rows, fb.rows), "bytes": fb.bytes - fa.bytes, "columns": columns}


def diff_text(d: dict) -> str:
    """A difference in words: how the steps are related, then rows, then the columns that aren't the same."""
    (a, b), other = d["rows"], {c: how for c, how in d["columns"].items() if how != "same"}
    lines = [f"{d['relation']}, over steps {' > '.join(map(str, d['path']))}" if d["path"] else d["relation"], f"rows: {a} to {b} ({b - a:+d})"]
    return "\n".join([*lines, *[f"{c}: {how}" for c, how in other.items()]] if other else [*lines, "all columns are the same"])


def _path(pipeline: Pipeline, a: int, b: int) -> list[int] | None:
    todo, seen = deque([[a]]), {a}
    while todo:
        way = todo.popleft()
        if way[-1] == b:
            return way
        for s in pipeline.consumers(pipeline.steps[way[-1]]):
            if s.id not in seen:
                seen.add(s.id)
                todo.append([*way, s.id])
    return None
