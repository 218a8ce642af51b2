"""The task queue as data: transitions are rows of a log, the state is derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from inkgrid.config import Settings
from inkgrid.functions import text as t

EVENTS = (
    "task_id string, session_id string, kind string, at double, filename string, progress string, error string, report_path string, "
    "run_id string, upload_path string, request_id string"
)
#: Kinds of events, in the order in which those of one moment count.
KINDS = ("created", "recovered", "claimed", "progress", "failed", "done")
SESSION_TASKS = 200

# The progress document that each transition leaves; a failure's has its error too.
DOCUMENTS = {
    "created": '{"stage": "pending", "status": "pending"}',
    "recovered": '{"stage": "pending", "status": "pending", "reason": "recovered_stale_running_task"}',
    "claimed": '{"stage": "started", "status": "running"}',
    "done": '{"stage": "final", "status": "done"}',
}
STATES = {"created": "pending", "recovered": "pending", "claimed": "running", "done": "done", "failed": "failed"}


def _quoted(c: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("e"))), r"(?s)\A\{\"e\":(.*)\}\z", 1)


def document() -> Column:
    """The progress document that an event leaves."""
    failed = F.concat(F.lit('{"stage": "error", "status": "failed", "error": '), _quoted(F.col("error")), F.lit("}"))
    made = F.when(F.col("kind") == "failed", failed)
    for kind, text in DOCUMENTS.items():
        made = made.when(F.col("kind") == kind, text)
    return made.otherwise(F.col("progress"))


def _rank() -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))


def _events(rows: DataFrame, kind: str, at: float, **columns: Column) -> DataFrame:
    held = {"kind": F.lit(kind), "at": F.lit(float(at))} | columns
    names = [f.split()[0] for f in EVENTS.split(", ")]
    cast = lambda c, n: c.cast("double" if n == "at" else "string").alias(n)
    return rows.select(*[cast(held[n], n) if n in held else cast(F.col(n) if n == "task_id" else F.lit(None), n) for n in names])


def created(requests: DataFrame, at: float) -> DataFrame:
    """Events of new tasks (task_id, session_id, filename, upload_path, request_id); a task without a file name has its upload's."""
    name = t.first_filled(F.col("filename"), F.element_at(F.split("upload_path", "/"), -1))
    held = {c: F.col(c) for c in ("upload_path", "request_id")}
    return _events(requests, "created", at, session_id=t.session_id(F.col("session_id")), filename=name, run_id=F.col("task_id"), **held)


def progressed(rows: DataFrame, at: float) -> DataFrame:
    """Events of tasks at work (task_id, progress as JSON), which renew their lease."""
    return _events(rows, "progress", at, progress=F.col("progress"))


def finished(rows: DataFrame, at: float) -> DataFrame:
    """Events of tasks that end with a report (task_id, report_path)."""
    return _events(rows, "done", at, report_path=F.col("report_path"))


def failed(rows: DataFrame, at: float) -> DataFrame:
    """Events of tasks that end with an error (task_id, error)."""
    return _events(rows, "failed", at, error=F.col("error"))


def claimed(rows: DataFrame, at: float) -> DataFrame:
    """Events of tasks that a worker takes: what `claim` gives."""
    return _events(rows, "claimed", at)


def recovered(rows: DataFrame, at: float) -> DataFrame:
    """Events of the tasks that recover_stale puts back."""
    return _events(rows.filter("recovered"), "recovered", at)


def current(events: DataFrame, settings: Settings) -> DataFrame:
    """One row for each task: its state after the last event; of events of one moment the later kind of KINDS counts as the last."""
    when = F.struct("at", _rank().alias("r"))
    kind = F.col("kind")
    last = lambda c, cond=F.lit(True): F.max_by(c, F.when(cond, when))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), when)).alias(c)
    moves = kind.isin(*STATES)
    lease = F.when(kind.isin("claimed", "progress"), F.col("at") + settings.lease)
    status = F.coalesce(*[F.when(F.col("move") == k, v) for k, v in STATES.items()], F.lit("pending"))
    events = events.withColumn("__document", document())
    rows = events.groupBy("task_id").agg(
        F.min_by(t.session_id(F.col("session_id")), when).alias("session_id"),
        *[first(c) for c in ("filename", "run_id", "upload_path", "request_id")],
        F.min(F.when(kind == "created", F.col("at"))).alias("created_at"),
        F.max(F.when(kind == "claimed", F.col("at"))).alias("started_at"),
        F.max(F.when(kind.isin("done", "failed"), F.col("at"))).alias("finished_at"),
        F.max("at").alias("updated_at"),
        F.count_if(kind == "claimed").alias("attempt_count"),
        last(kind, moves).alias("move"),
        last(lease).alias("lease_expires_at"),
        last(F.col("error"), kind.isin("done", "failed", "recovered")).alias("error"),
        last(F.col("__document"), F.col("__document").isNotNull()).alias("progress"),
        last(F.col("report_path"), kind == "done").alias("report_path"),
    )
    return rows.withColumn("status", status).drop("move")


def claim(tasks: DataFrame, now: float, settings: Settings, count: int = 1) -> DataFrame:
    """The `count` oldest pending tasks as they are once claimed. Files have no row locks: one driver claims at a time."""
    oldest = tasks.filter("status = 'pending'").orderBy("created_at", "task_id").limit(count)
    return oldest.withColumns(
        {
            "status": F.lit("running"),
            "started_at": F.lit(now),
            "updated_at": F.lit(now),
            "lease_expires_at": F.lit(now + settings.lease),
            "attempt_count": F.coalesce("attempt_count", F.lit(0)) + 1,
            "progress": F.lit(DOCUMENTS["claimed"]),
        }
    )


def recover_stale(tasks: DataFrame, now: float) -> DataFrame:
    """All tasks, those put back to pending whose run has no lease left; `recovered` tells which."""
    stale = (F.col("status") == "running") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < now))
    new = {
        "status": F.lit("pending"),
        "updated_at": F.lit(now),
        "lease_expires_at": F.lit(None).cast("double"),
        "progress": F.lit(DOCUMENTS["recovered"]),
        "error": F.lit(None).cast("string"),
    }
    tasks = tasks.withColumn("recovered", F.coalesce(stale, F.lit(False)))
    return tasks.withColumns({c: F.when(F.col("recovered"), v).otherwise(F.col(c)) for c, v in new.items()})


def of_session(tasks: DataFrame, session: str | None, limit: int = SESSION_TASKS) -> DataFrame:
    """A session's newest tasks."""
    return tasks.filter(t.session_id(F.col("session_id")) == t.session_id(F.lit(session))).orderBy(F.desc("created_at"), "task_id").limit(limit)


def newest_of_sessions(tasks: DataFrame, limit: int = SESSION_TASKS) -> DataFrame:
    """The newest tasks of every session, with their place."""
    order = Window.partitionBy("session_id").orderBy(F.desc("created_at"), "task_id")
    return tasks.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def with_links(tasks: DataFrame) -> DataFrame:
    """Adds upload_url and, for tasks with a report, report_url of a task's run."""
    run = F.concat(F.lit("/runs/"), F.col("run_id"), F.lit("/"))
    name = F.element_at(F.split("upload_path", "/"), -1)
    return tasks.withColumns({"upload_url": F.concat(run, name), "report_url": F.when(F.col("report_path") != "", F.concat(run, F.lit("report.json")))})


def with_reports(tasks: DataFrame, reports: DataFrame) -> DataFrame:
    """Tasks with their report document, where there is one."""
    return tasks.join(reports.select("report_path", "report"), "report_path", "left")


def one(tasks: DataFrame, task_id: str) -> Row:
    """A task by its id; KeyError if there is none."""
    found = tasks.filter(F.col("task_id") == task_id).limit(1).collect()
    if not found:
        raise KeyError(task_id)
    return found[0]
