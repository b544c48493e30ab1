"""Run output, transcripts and stored files as tables or streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Structured event lines start with the ASCII record separator.
EVENT_MARK = "\x1e"

EVENT_SCHEMA = ("hb_event string, t double, state string, collected string, total string, message string, "
                "url string, page string, csv string, rows string")


def parse_run_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Split process output into events, log lines and rejects.

    Adds ``part`` (event, log or reject), ``event`` (parsed struct) and ``text``. Blank lines vanish.
    """
    c = F.rtrim(F.regexp_replace(F.col(line), r"[\r\n]+$", ""))
    marked = c.startswith(EVENT_MARK)
    event = F.when(marked, F.from_json(F.substring(c, 2, 1 << 30), EVENT_SCHEMA))
    ok = event["hb_event"].isNotNull()
    part = F.when(marked & ok, "event").when(marked, "reject").otherwise("log")
    return lines.where(F.trim(c) != "").withColumns({"event": event, "part": part, "text": c})


def read_run_events(spark: SparkSession, path: str) -> DataFrame:
    """Run logs, one file per run: run id from the file name, ``seq`` in line order within a file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"),
                                         F.monotonically_increasing_id().alias("seq"))
    return parse_run_lines(lines).withColumn("run_id", F.regexp_extract("file", r"^([^.]+)", 1))


def read_run_events_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream of finished log files: ``seq`` is the line number in the file, and a file is one row
    until its lines are numbered."""
    lines = (spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path, wholetext=True)
             .select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("seq", "value"))
             .select("value", "file", F.col("seq").cast("bigint").alias("seq")))
    return parse_run_lines(lines).withColumn("run_id", F.regexp_extract("file", r"^([^.]+)", 1))


def normalize_run_events(events: DataFrame) -> DataFrame:
    """Typed event columns: missing counts are 0 and missing text is blank."""
    e = F.col("event")

    def count(name: str) -> Column:
        return F.coalesce(F.floor(e[name].try_cast("double")).cast("bigint"), F.lit(0).cast("bigint"))

    def text(name: str) -> Column:
        return F.coalesce(e[name], F.lit(""))

    return events.where(F.col("part") == "event").select(
        "run_id", "seq", e["t"].alias("t"), e["hb_event"].alias("hb_event"), text("state").alias("state"),
        count("collected").alias("collected"), count("total").alias("total"), text("message").alias("message"),
        text("url").alias("url"), e["page"].try_cast("int").alias("page"), text("csv").alias("csv"),
        count("rows").alias("rows"))


def read_transcripts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines transcripts, one file per session named after it."""
    return (spark.read.schema(schema).json(path)
            .select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("session"),
                    F.monotonically_increasing_id().alias("seq")))


def write_transcript(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the settled events of a live stream to a parquet transcript; partial ones are never stored."""
    return (stream.where(~F.coalesce(F.col("partial"), F.lit(False))).writeStream.format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Stored files with their bytes: path, length, modification time and content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)
