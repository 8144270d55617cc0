"""Rows and nulls of every step of a pipeline from one run of each of its results.

The pipeline is built again from the functions that its steps keep, with metrics between the steps (`DataFrame.observe`).
Running a result then fills in the numbers of all steps it comes from; a frame that several steps use is cached for that
and run first. Only what a step changes is observed: rows where it may drop or add some, nulls of columns that are new
there (by the ids of their attributes) or whose rows changed, and none of columns that can't be null. Numbers are taken only where they are sure to be whole. Otherwise the step is counted by a job of its own:
where no numbers came back (a part that the optimizer left out), where a stage of the run was repeated or a task failed
(what a lost executor had counted may be counted again), where a join's own count of its inputs differs, and where one
join feeds another through a filter (sorted inputs need not be read to their end).
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans import catalyst
from plumbline.plans.pipeline import ROW_WISE, Pipeline, Step

#: Results that run side by side.
JOBS = 4
#: Seconds to wait for the numbers of a run that has ended; they come with its last event.
PATIENCE = 30.0

_RULES = "spark.sql.adaptive.optimizer.excludedRules"
#: Takes the other side of a join with nothing away while it runs, and with it what is counted there.
_EMPTY = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


#: Joins whose inputs are counted with them: a semi join need not read all of its right side, and a cross join reads it often.
COUNTED = ("inner", "left", "right", "outer")
#: Operations besides those on single rows that neither drop nor add rows.
_SAME_ROWS = ("convert_dtypes", "transform", "rank", "running", "cumcount", "set_index", "reset_index", "get_dummies")


def same_rows(s: Step) -> bool:
    return s.category in ("projection", "sort") or s.op in ROW_WISE or s.op in _SAME_ROWS


def stops_early(pipeline: Pipeline) -> set[int]:
    """Steps whose rows a later join may leave unread: joins that feed another join through a filter, and what lies between."""
    out: set[int] = set()
    for s in pipeline.steps:
        if s.category != "join":
            continue
        for i, _ in s.inputs:
            way, step = [], pipeline.steps[i]
            while step.category not in ("join", "sort", "source", "concat") and len(step.inputs) == 1:
                way.append(step)
                step = pipeline.steps[step.inputs[0][0]]
            if step.category == "join" and any(w.category in ("filter", "limit") or w.make is None for w in way):
                out |= {step.id, *(w.id for w in way)}
    return out


class Runs:
    """The observed frames of a pipeline and what their runs told."""

    def __init__(self, pipeline: Pipeline, distinct: bool, cache_shared: bool):
        self.pipeline, self.distinct = pipeline, distinct
        self.watch: dict[int, Observation] = {}
        #: Where a step's rows were counted, and each column's nulls: step and name of the metric, or nothing where there are none.
        self.rows_at: dict[int, int] = {}
        self.nulls_at: dict[int, dict[str, tuple[int, int] | None]] = {}
        self._ids: dict[int, dict[str, int]] = {}
        self.frames: dict[int, DataFrame] = {}
        self.cached: list[int] = []
        #: Steps by the result whose run counts them, and seconds of that run.
        self.run_of: dict[int, int] = {}
        self.seconds: dict[int, float] = {}
        self.repeated: set[int] = set()
        fed: set[int] = set()
        for s in pipeline.steps:
            df = self._again(s)
            if df is not None:
                fed |= {i for i, _ in s.inputs}
            self.frames[s.id] = self._watched(s, s.df if df is None else df, df is not None)
            if cache_shared and len(pipeline.consumers(s)) > 1:
                self.frames[s.id] = self.frames[s.id].persist()
                self.cached.append(s.id)
        self.results = [s.id for s in pipeline.steps if s.id not in fed and s.id not in self.cached]

    def _again(self, s: Step) -> DataFrame | None:
        """The step's frame of the observed ones, where a run of it reads each of them once and to the end.

        Sorts are left out: the numbers don't depend on the order, and looking for the bounds of its ranges reads all rows twice.
        """
        if s.make is None or not s.inputs or (s.category == "join" and s.args.get("how") not in COUNTED):
            return None
        if s.category == "sort":
            return self.frames[s.inputs[0][0]]
        try:
            df = s.make(*[self.frames[i] for i, _ in s.inputs])
        except AnalysisException:  # a column bound to the frame it was recorded with
            return None
        return df if df.columns == s.df.columns else None

    def _watched(self, s: Step, df: DataFrame, again: bool) -> DataFrame:
        """df with the metrics of what the step changes."""
        self._ids[s.id] = catalyst.lineage(df)
        before = s.inputs[0][0] if again and same_rows(s) else None
        known = {} if before is None else {self._ids[before][c]: at for c, at in self.nulls_at[before].items()}
        made: list[Column] = []
        if before is None:
            made.append(F.count(F.lit(1)).alias("rows"))
        self.rows_at[s.id] = s.id if before is None else self.rows_at[before]
        self.nulls_at[s.id] = {}
        for i, field in enumerate(df.schema.fields):
            own = self._ids[s.id][field.name]
            if own in known:
                self.nulls_at[s.id][field.name] = known[own]
                continue
            self.nulls_at[s.id][field.name] = (s.id, i) if field.nullable or self.distinct else None
            column = F.col(f"`{field.name}`")
            if field.nullable or self.distinct:
                made.append(F.count_if(column.isNull()).alias(f"n{i}"))
            if self.distinct and not isinstance(field.dataType, (T.MapType, T.VariantType)):
                made.append(F.approx_count_distinct(column).alias(f"d{i}"))
        if not made:
            return df
        self.watch[s.id] = Observation(f"step-{s.id}-{uuid.uuid4().hex}")
        return df.observe(self.watch[s.id], *made)

    def _run(self, i: int) -> None:
        df, group = self.frames[i], f"plumbline-{uuid.uuid4().hex}"
        sc = df.sparkSession.sparkContext
        sc.setJobGroup(group, f"step {i} and all it comes from")
        began = time.monotonic()
        df.write.format("noop").mode("overwrite").save()
        self.seconds[i] = round(time.monotonic() - began, 3)
        tracker = sc.statusTracker()
        stages = [tracker.getStageInfo(k) for j in tracker.getJobIdsForGroup(group) for k in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else [])]
        if any(k and (k.currentAttemptId > 0 or k.numFailedTasks or k.numCompletedTasks > k.numTasks) for k in stages):
            self.repeated.add(i)

    def run(self) -> dict[int, dict]:
        """The metrics of each step that are sure to be whole."""
        spark = self.pipeline.steps[0].df.sparkSession
        before = spark.conf.get(_RULES, None)
        spark.conf.set(_RULES, f"{before},{_EMPTY}" if before else _EMPTY)
        try:
            with ThreadPoolExecutor(JOBS) as pool:
                for i in self.cached:  # each before those that read it
                    pool.submit(self._run, i).result()
                list(pool.map(self._run, self.results))
        finally:
            if before is None:
                spark.conf.unset(_RULES)
            else:
                spark.conf.set(_RULES, before)
        for i in [*self.cached, *self.results]:
            for s in self.above(i):
                self.run_of.setdefault(s, i)
        doubtful, seen, until = stops_early(self.pipeline), {}, time.monotonic() + PATIENCE
        for i, watch in self.watch.items():
            if i in doubtful or self.run_of[i] in self.repeated:
                continue
            while not catalyst.observed(watch) and time.monotonic() < until:
                time.sleep(0.02)
            if catalyst.observed(watch):
                seen[i] = watch.get
        out = {}
        for s in self.pipeline.steps:
            at = self.nulls_at[s.id]
            if self.rows_at[s.id] in seen and all(a is None or a[0] in seen for a in at.values()):
                nulls = {c: 0 if a is None else seen[a[0]][f"n{a[1]}"] for c, a in at.items()}
                distinct = {c: None if a is None else seen[a[0]].get(f"d{a[1]}") for c, a in at.items()}
                out[s.id] = {"rows": seen[self.rows_at[s.id]]["rows"], "nulls": nulls, "distinct": distinct}
        return out

    def above(self, i: int) -> set[int]:
        """A step and all it comes from."""
        out, todo = set(), [i]
        while todo:
            i = todo.pop()
            if i not in out:
                out.add(i)
                todo += [k for k, _ in self.pipeline.steps[i].inputs]
        return out

    def release(self) -> None:
        for i in self.cached:
            self.frames[i].unpersist()
