"""Run events as streams."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.runs import merge_folds, partial_fold, progress_rate, run_state

PARTIAL = ("run_id bigint, ran boolean, p_seq bigint, p struct<collected:bigint,total:bigint,message:string>, u_seq bigint, "
           "u string, r_seq bigint, r struct<csv:string,rows:bigint>, e_seq bigint, e string, log_lines bigint")


def fold_runs_stream(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Fold a stream of run events into ``folder``: one small partial fold per run and micro-batch.

    Each micro-batch is reduced by partial aggregation, so a run that sends most of the events does not
    load a single task. A repeated batch overwrites its own files only.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        partial_fold(batch).write.mode("overwrite").parquet(os.path.join(folder, f"batch={batch_id}"))
    return (events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def compact_folds(spark: SparkSession, folder: str, target: str) -> None:
    """Merge the partial folds written so far into one table at a new place."""
    merge_folds(spark.read.parquet(folder).drop("batch")).write.mode("errorifexists").parquet(target)


def read_run_state(spark: SparkSession, folder: str, exits: DataFrame | None = None) -> DataFrame:
    """State of every run from the partial folds."""
    return run_state(merge_folds(spark.read.parquet(folder)), exits)


#: What a set of events says about a run, flat: each fact with the seq it comes from, times in seconds.
FACTS = ("first double, last double, ran boolean, p_seq bigint, collected bigint, total bigint, message string, u_seq bigint, last_url string, "
         "r_seq bigint, r_t double, csv string, rows bigint, e_seq bigint, error string, log_lines bigint, "
         "x_t double, code int, canceled boolean, timed_out boolean, controlled boolean, has_output boolean, timeout bigint")
_NAMES = [f.split()[0] for f in FACTS.split(", ")]
#: Facts that go with a seq (or a time): the latest one wins.
_LATEST = {"p_seq": ["collected", "total", "message"], "u_seq": ["last_url"], "r_seq": ["r_t", "csv", "rows"], "e_seq": ["error"],
           "x_t": ["code", "canceled", "timed_out", "controlled", "has_output", "timeout"]}


def _reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row of facts per run and batch of events, so that a run that sends most of them is a few rows."""
    for events in batches:
        if not len(events):
            continue
        kind, by = events["hb_event"], ["run_id"]
        groups = events.groupby(by, dropna=False, sort=False)
        out = groups.agg(first=("t", "min"), last=("t", "max"))
        marks = events[by].assign(ran=(kind == "status") & (events["state"] == "running"), log_lines=kind.isin(["progress", "log"]).astype("int64"))
        out = out.join(marks.groupby(by, dropna=False, sort=False).agg(ran=("ran", "any"), log_lines=("log_lines", "sum")))
        for order, hit, names in (
                ("p_seq", kind == "progress", {"collected": "collected", "total": "total", "message": "message"}),
                ("u_seq", kind.isin(["progress", "error"]) & (events["url"] != ""), {"last_url": "url"}),
                ("r_seq", kind == "result", {"r_t": "t", "csv": "csv", "rows": "rows"}),
                ("e_seq", kind == "error", {"error": "message"}),
                ("x_t", kind == "exit", {n: n for n in _LATEST["x_t"]})):
            part = events[hit]
            column = "t" if order == "x_t" else "seq"
            latest = part.loc[part.groupby(by, dropna=False, sort=False)[column].idxmax()] if len(part) else part
            out = out.join(latest.set_index(by)[[column, *names.values()]].set_axis([order, *names], axis=1) if len(latest) else
                           pd.DataFrame(columns=[order, *names], index=out.index[:0], dtype=object))
        out = out.reset_index()
        whole = ["p_seq", "collected", "total", "u_seq", "r_seq", "rows", "e_seq", "code", "timeout"]
        yield out[["run_id", *_NAMES]].astype(dict.fromkeys(whole, "Int64"))


class RunFold(StatefulProcessor):
    """Keeps the latest facts of one run; parts carry their seq, so late lines never undo newer ones.

    With ``timeout_ms`` a run without result or exit fails when the watermark is so long after its first event; its
    timer goes as soon as either is seen. With ``abandon_ms`` what is known of a run is dropped so long after its last event.
    """

    STATE = FACTS + ", overdue boolean, timer bigint"
    OUTPUT = ("status string, collected bigint, total bigint, message string, last_url string, csv string, "
              "rows bigint, error string, log_lines bigint")

    def __init__(self, ttl_ms: int | None = None, timeout_ms: int | None = None, abandon_ms: int | None = None) -> None:
        self.ttl_ms, self.timeout_ms, self.abandon_ms = ttl_ms, timeout_ms, abandon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", self.STATE, self.ttl_ms)

    def read(self) -> dict:
        if self.state.exists():
            return dict(zip([*_NAMES, "overdue", "timer"], self.state.get(), strict=True))
        return {**dict.fromkeys(_NAMES), "ran": False, "log_lines": 0, "overdue": False, "timer": None}

    def store(self, s: dict) -> None:
        """Keep the facts, with one timer for what comes next."""
        due = []
        if self.timeout_ms and not s["overdue"] and s["r_seq"] is None and s["x_t"] is None and s["first"] is not None:
            due.append(self.deadline(s))
        if self.abandon_ms and s["last"] is not None:
            due.append(int(s["last"] * 1000) + self.abandon_ms)
        timer = min(due, default=None)
        if timer != s["timer"]:
            if s["timer"] is not None:
                self.handle.deleteTimer(s["timer"])
            if timer is not None:
                self.handle.registerTimer(timer)
        s["timer"] = timer
        self.state.update(tuple(s[n] for n in [*_NAMES, "overdue", "timer"]))

    def deadline(self, s: dict) -> int:
        return int(s["first"] * 1000) + self.timeout_ms

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        s = self.read()
        for row in rows:
            s["ran"] = bool(s["ran"] or row["ran"])
            s["log_lines"] += row["log_lines"]
            for name, pick in (("first", min), ("last", max)):
                if row[name] is not None:
                    s[name] = row[name] if s[name] is None else pick(s[name], row[name])
            for order, names in _LATEST.items():
                if row[order] is not None and (s[order] is None or row[order] > s[order]):
                    s.update({n: row[n] for n in [order, *names]})
        self.store(s)
        yield self.row(key, s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        s = self.read()
        now, s["timer"] = expiredTimerInfo.getExpiryTimeInMs(), None
        if self.abandon_ms and now >= int(s["last"] * 1000) + self.abandon_ms:
            self.state.clear()
            return
        if s["r_seq"] is None and s["x_t"] is None and not s["overdue"]:
            s["overdue"] = True
            self.store(s)
            yield self.row(key, s)

    def row(self, key, s: dict) -> Row:
        status, error = "running" if s["ran"] else "starting", s["error"]
        if s["overdue"]:
            status, error = "failed", f"workflow timed out after {self.timeout_ms // 1000}s"
        elif s["x_t"] is not None:
            done = s["code"] == 0 and s["has_output"]
            status = ("canceled" if s["canceled"] else "failed" if s["timed_out"] else "controlled" if s["controlled"]
                      else "succeeded" if done else "failed")
            if s["timed_out"] and not s["canceled"]:
                error = f"workflow timed out after {s['timeout']}s"
            elif status == "failed" and not error:
                error = f"workflow exited with code {s['code']}"
        return Row(run_id=key[0], status=status, **{n: s[n] for n in ("collected", "total", "message")}, last_url=s["last_url"] or "",
                   csv=s["csv"], rows=s["rows"], error=error, log_lines=s["log_lines"])

    def close(self) -> None:
        pass


#: Columns of the events that are folded; streams of exits have their own.
_EVENT = "hb_event string, t double, seq bigint, state string, collected bigint, total bigint, message string, url string, csv string, rows bigint"
_EXIT = "code int, canceled boolean, timed_out boolean, controlled boolean, has_output boolean, timeout bigint"


def live_run_state(events: DataFrame, abandon_after_ms: int | None = None, timeout_ms: int | None = None,
                   exits: DataFrame | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Low-latency form: the current state of each run that changed, as update rows of a stream.

    ``exits`` tells how processes ended (``run_id, t, code, canceled, timed_out, controlled, has_output, timeout``), and
    counts like in the batch fold. With ``timeout_ms`` a run fails so long after its first event, unless its result or
    exit is there, by the times of the events (``t``, in seconds): the clock is the watermark, ``lateness`` behind the
    latest event, so a backlog that is replayed ends as it did, and events that are later still are dropped.
    State of a run nobody hears of any more is dropped after ``abandon_after_ms``. Run ids may be of any type. Needs the
    RocksDB state store. Events are reduced where they are read, so a run that sends most of them is no hot key.
    """
    kind = events.schema["run_id"].dataType.simpleString()
    names = [f.split()[0] for f in _EVENT.split(", ")]
    rows = events.select("run_id", *[F.col(n) if n in events.columns else F.lit(None).cast(dict(f.split() for f in _EVENT.split(", "))[n]).alias(n) for n in names],
                         *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in _EXIT.split(", ")])
    if exits is not None:
        ended = exits.select("run_id", F.lit("exit").alias("hb_event"), F.col("t").cast("double").alias("t"),
                             *[F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in _EXIT.split(", ")])
        rows = rows.unionByName(ended, allowMissingColumns=True)
    facts = rows.mapInPandas(_reduce, f"run_id {kind}, {FACTS}")
    if timeout_ms:
        facts = facts.withColumn("_at", F.timestamp_seconds("last")).withWatermark("_at", lateness)
        fold, mode = RunFold(None, timeout_ms, abandon_after_ms), "EventTime"
    else:
        fold, mode = RunFold(abandon_after_ms), "ProcessingTime" if abandon_after_ms else "None"
    return facts.groupBy("run_id").transformWithState(
        statefulProcessor=fold, outputMode="Update", outputStructType=f"run_id {kind}, {RunFold.OUTPUT}", timeMode=mode)


def progress_windows(events: DataFrame, width: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Progress per window on a stream; windows close once the watermark passes them."""
    progress = events.where(F.col("hb_event") == "progress").withWatermark("ts", lateness)
    return progress_rate(progress, width, slide)
