"""Folding run events into run state, logs, schedules and captured results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_width
from .sequence import keep_newest
from .writes import Append, append

TERMINAL = ["succeeded", "failed", "canceled"]
ACTIVE = ["starting", "running", "controlled"]
TIMEOUT_RANGE = (30, 24 * 3600)
DEFAULT_TIMEOUT = 3600


def partial_fold(events: DataFrame) -> DataFrame:
    """What a set of events says about each run, with the seq each part comes from.

    Partial folds of disjoint event sets can be merged in any order (:func:`merge_folds`), so the fold
    is reduced where the events lie and streams keep one small row per run and batch.
    """
    kind = F.col("hb_event")
    parts = {"p": kind == "progress", "u": kind.isin("progress", "error") & (F.col("url") != ""),
             "r": kind == "result", "e": kind == "error"}
    seqs = {n: F.when(c, F.col("seq")) for n, c in parts.items()}
    return events.groupBy("run_id").agg(
        F.bool_or((kind == "status") & (F.col("state") == "running")).alias("ran"),
        F.max(seqs["p"]).alias("p_seq"), F.max_by(F.struct("collected", "total", "message"), seqs["p"]).alias("p"),
        F.max(seqs["u"]).alias("u_seq"), F.max_by("url", seqs["u"]).alias("u"),
        F.max(seqs["r"]).alias("r_seq"), F.max_by(F.struct("csv", "rows"), seqs["r"]).alias("r"),
        F.max(seqs["e"]).alias("e_seq"), F.max_by("message", seqs["e"]).alias("e"),
        F.count_if(kind.isin("progress", "log")).alias("log_lines"))


def merge_folds(partials: DataFrame) -> DataFrame:
    return partials.groupBy("run_id").agg(
        F.bool_or("ran").alias("ran"),
        *[x for n in "pure" for x in (F.max_by(n, f"{n}_seq").alias(n), F.max(f"{n}_seq").alias(f"{n}_seq"))],
        F.sum("log_lines").alias("log_lines"))


def fold_runs(events: DataFrame, exits: DataFrame | None = None) -> DataFrame:
    """One row per run from its events (any order) and, when known, how its process ended.

    ``exits`` has ``run_id, code, canceled, timed_out, controlled, has_output, timeout``.
    """
    return run_state(partial_fold(events), exits)


def run_state(folded: DataFrame, exits: DataFrame | None = None) -> DataFrame:
    state = folded.select("run_id", F.col("ran").alias("_ran"), F.col("p.collected").alias("collected"),
                          F.col("p.total").alias("total"), F.col("p.message").alias("message"),
                          F.coalesce("u", F.lit("")).alias("last_url"), F.col("r.csv").alias("csv"),
                          F.col("r.rows").alias("rows"), F.col("e").alias("error"), "log_lines")
    live = F.when(F.col("_ran"), "running").otherwise("starting")
    if exits is None:
        return state.withColumn("status", live).drop("_ran")
    joined = state.join(exits, "run_id", "left")
    ended = F.col("code").isNotNull()
    status = (F.when(~ended, live).when(F.col("canceled"), "canceled").when(F.col("timed_out"), "failed")
              .when(F.col("controlled"), "controlled").when((F.col("code") == 0) & F.col("has_output"), "succeeded")
              .otherwise("failed"))
    error = (F.when(F.col("timed_out") & ~F.col("canceled"), F.concat(F.lit("workflow timed out after "), F.col("timeout").cast("string"), F.lit("s")))
             .when((F.col("status") == "failed") & (F.coalesce("error", F.lit("")) == ""),
                   F.concat(F.lit("workflow exited with code "), F.col("code").cast("string")))
             .otherwise(F.col("error")))
    out = joined.withColumn("status", status).withColumn("error", error)
    return out.select("run_id", "status", "collected", "total", "message", "last_url", "csv", "rows", "error", "log_lines")


def log_lines(events: DataFrame, newest: int | None = None) -> DataFrame:
    """Progress and log events as log lines; the newest ones per run."""
    progress = F.concat(F.lit("[progress] "), F.col("collected").cast("string"), F.lit("/"),
                        F.col("total").cast("string"), F.lit(" "), F.col("message"))
    lines = events.where(F.col("hb_event").isin("progress", "log")).select(
        "run_id", "seq", F.when(F.col("hb_event") == "progress", progress).otherwise(F.col("message")).alias("line"))
    lines = lines.where(F.col("line") != "")
    return lines if newest is None else keep_newest(lines, ["run_id"], "seq", newest)


def activity(terminal: Sequence[str] = TERMINAL) -> list[Column]:
    """Sort order: live ones first, then the latest activity; ids break ties."""
    at = F.coalesce(F.when(F.col("finished_at") != 0, F.col("finished_at")), F.when(F.col("started_at") != 0, F.col("started_at")),
                    F.col("created_at"), F.lit(0.0))
    return [(~F.col("status").isin(list(terminal))).desc(), at.desc(), F.col("id").desc()]


def runs_by_activity(runs: DataFrame, limit: int | None = None) -> DataFrame:
    out = runs.orderBy(*activity())
    return out if limit is None else out.limit(limit)


def interrupted_runs(runs: DataFrame, now: Column) -> DataFrame:
    """State after a restart: what was not finished has failed; scheduled runs stay scheduled."""
    hit = ~F.col("status").isin([*TERMINAL, "scheduled"])
    return runs.withColumns({
        "status": F.when(hit, "failed").otherwise(F.col("status")),
        "error": F.when(hit & (F.coalesce("error", F.lit("")) == ""), "interrupted (backend restarted)").otherwise(F.col("error")),
        "finished_at": F.when(hit & (F.coalesce("finished_at", F.lit(0.0)) == 0), now).otherwise(F.col("finished_at"))})


def clamp_timeout(c: Column, default: int = DEFAULT_TIMEOUT) -> Column:
    """Seconds as a whole number between thirty and a day; unreadable text gives the default."""
    lo, hi = TIMEOUT_RANGE
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce(c.cast("string").try_cast("double"), F.lit(float(default))).cast("bigint")))


def overdue_runs(runs: DataFrame, now: Column) -> DataFrame:
    """Running runs past their timeout, failed with the reason."""
    limit = clamp_timeout(F.col("timeout_sec"))
    late = runs.where(F.col("status").isin(ACTIVE) & (now - F.col("started_at") > limit))
    return late.withColumns({"error": F.concat(F.lit("workflow timed out after "), limit.cast("string"), F.lit("s")),
                             "status": F.lit("failed"), "finished_at": F.lit(None).cast("double") + now})


def timed_out_runs(events: DataFrame, timeout: float, exits: DataFrame | None = None, now: float | None = None) -> DataFrame:
    """``run_id, error`` of the runs that were so many seconds past their first event, by ``now`` (the time of the latest
    event or exit), without a result or exit until then: what the stream's timers find, from the whole log."""
    told = events.groupBy("run_id").agg(F.min("t").alias("first"), F.max("t").alias("latest"), F.min(F.when(F.col("hb_event") == "result", F.col("t"))).alias("done"))
    if exits is not None:
        told = told.join(exits.groupBy("run_id").agg(F.min("t").alias("ended")), "run_id", "left")
    else:
        told = told.withColumn("ended", F.lit(None).cast("double"))
    until = F.lit(now) if now is not None else F.lit(told.agg(F.max(F.greatest("latest", "ended"))).first()[0])
    late = (F.col("first") + timeout <= until) & ~F.coalesce(F.least("done", "ended") < F.col("first") + timeout, F.lit(False))
    return told.where(late).select("run_id", F.lit(f"workflow timed out after {int(timeout)}s").alias("error"))


def resolve_start(defs: DataFrame, now: Column) -> DataFrame:
    """The start time from an absolute (``start_at``) or relative (``in_seconds``) input; none = now.

    Only a start more than a second ahead parks a run as scheduled.
    """
    start = F.coalesce(F.col("start_at"), now + F.col("in_seconds"))
    later = F.coalesce(start > now + 1, F.lit(False))
    return defs.withColumns({"start_at": F.when(later, start), "status": F.when(later, "scheduled").otherwise("queued")})


def next_occurrence(start: Column, every: Column, now: Column) -> Column:
    """First time on the cadence strictly after now, but never the start itself."""
    steps = F.greatest(F.floor((now - start) / every) + 1, F.lit(1))
    return F.when(every > 0, start + steps * every)


#: Fire times that are made from one row at a time.
OCCURRENCES = 10_000


def expand_schedule(defs: DataFrame, until: float, at_once: int = OCCURRENCES) -> DataFrame:
    """Every fire time of each definition (``start_at, every_seconds``) up to a horizon.

    Chunks of so many occurrences are listed and dealt out first, so a definition that fires very often is spread over
    the tasks and never one array."""
    every = F.coalesce("every_seconds", F.lit(0.0))
    count = F.greatest(F.when(every > 0, F.floor((F.lit(until) - F.col("start_at")) / every)).otherwise(0), F.lit(0)).cast("bigint")
    chunks = defs.where(F.col("start_at") <= until).select("*", count.alias("_last")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / at_once).cast("bigint"))).alias("_chunk"))
    dealt = chunks.repartition(shuffle_width(defs.sparkSession), F.xxhash64("start_at", "every_seconds", "_chunk"))
    steps = F.sequence(F.col("_chunk") * at_once, F.least(F.col("_last"), (F.col("_chunk") + 1) * at_once - 1))
    out = dealt.select(*defs.columns, F.explode(steps).alias("occurrence"))
    return out.withColumn("fire_at", F.col("start_at") + F.col("occurrence") * every)


def due(defs: DataFrame, now: float) -> DataFrame:
    """Definitions whose time has come, with the time they fire next."""
    return defs.where(F.col("start_at") <= now).withColumn(
        "next_at", next_occurrence(F.col("start_at"), F.col("every_seconds"), F.lit(now)))


def missing_params(runs: DataFrame, params: DataFrame) -> DataFrame:
    """One row per required parameter a run leaves blank.

    ``runs`` has ``run_id, workflow, params`` (a map); ``params`` has ``workflow, name, label, required``.
    """
    need = params.where("required").select(F.col("workflow").alias("_w"), "name", "label")
    joined = runs.join(need, F.col("workflow") == F.col("_w"))
    blank = F.coalesce(F.try_element_at("params", F.col("name")), F.lit("")) == ""
    return joined.where(blank).select("run_id", "workflow", "name",
                                      F.concat(F.lit("missing required parameter: "), "label").alias("error"))


def capture_run(result: DataFrame, target: DataFrame, run_id: str, workflow: str, keys: Sequence[str] | None = None,
                order: str = "_seq") -> tuple[Append, dict]:
    """Append a run's result to a dataset; returns the append and the provenance to store with it."""
    return append(target, result, keys, extend=True, order=order), {"kind": "run", "run_id": run_id, "workflow": workflow}


def progress_rate(progress: DataFrame, width: str, slide: str | None = None, ts: str = "ts",
                  keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Progress made per time window: highest and lowest count and number of reports."""
    slot = F.window(ts, width, slide) if slide else F.window(ts, width)
    return progress.groupBy(*keys, slot.alias("w")).agg(
        F.max("collected").alias("high"), F.min("collected").alias("low"), F.count("*").alias("reports"))
