"""CSV and JSON in and out."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..model import INTERNAL, RID, as_dataset, column_specs, display_of, user_fields
from ..operators.sequence import number_rows
from ..operators.writes import Append, append
from .records import read_records

CORRUPT = "_corrupt_record"


def header_cells(record: bytes | str) -> list[str]:
    text = record.decode("utf-8", "replace") if isinstance(record, bytes) else record
    return next(csv.reader(io.StringIO(text.removesuffix("\r"), newline="")), [])


def read_csv(spark: SparkSession, path: str, contract: Sequence | None = None,
             keep_bad: bool = True, quoted_newlines: bool = True) -> DataFrame:
    """A CSV file, or a folder of CSV parts, with a header line as a dataset. Row ids count from 1 in the order of
    file names and lines.

    Cells in quotes may span lines; files are split all the same (:mod:`.records`). Without ``quoted_newlines`` every
    line is a row, whatever its quotes. Blank lines between rows are left out.

    Cells are read by position, so repeated header names keep their own data; parts with another header are refused.
    Types come from the contract by display name (any case), otherwise text; contract columns missing from the file are
    added. Rows that do not fit the header are kept, with their raw text in ``_corrupt_record``.
    """
    headers, records = read_records(spark, path, quoted_newlines)
    header = header_cells(headers[0]) if headers else []
    other = [h for h in set(headers) if header_cells(h) != header]
    if other:
        raise ValueError(f"a part begins with {other[0]!r}, another with {header}")
    raw = [f"c{i}" for i in range(len(header))]
    text = F.replace("record", F.lit("\r\n"), F.lit("\n"))
    text = F.when(F.endswith("record", F.lit("\r")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    cells_of = F.from_csv(text, ", ".join(f"{c} string" for c in [*raw, CORRUPT]), {
        "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = records.select(F.col("rid").alias(RID), cells_of.alias("row")).select(RID, "row.*") if raw else records.select(
        F.col("rid").alias(RID), F.col("record").alias(CORRUPT))
    wanted = {c["display"].strip().lower(): c for c in column_specs(contract or [])}
    specs = [{"display": h, "type": wanted.get(h.strip().lower(), {}).get("type", "text")} for h in header]
    seen = {h.strip().lower() for h in header}
    absent = [c for k, c in wanted.items() if k not in seen]
    rows = rows.select(RID, *([CORRUPT] if keep_bad else []), *raw,
                       *[F.lit(None).cast("string").alias(f"x{i}") for i in range(len(absent))])
    return as_dataset(rows, specs + absent)


def append_csv(spark: SparkSession, base: DataFrame, path: str, keys: Sequence[str] | None = None) -> Append:
    """Append a CSV to a dataset: new columns join the schema, rows with a known key are skipped."""
    rows = read_csv(spark, path).withColumnRenamed(RID, "_seq")
    return append(base, rows.drop(CORRUPT), keys, extend=True)


def cell_text(df: DataFrame) -> DataFrame:
    """Every user column as export text under its display name: NULL is blank, nested cells are JSON."""
    out = []
    for f in user_fields(df):
        c = F.col(f"`{f.name}`")
        out.append(F.coalesce(cells.text_of(c, f.dataType), F.lit("")).alias(display_of(f)))
    return df.select(*[c for c in df.columns if c == RID], *out)


def write_csv(df: DataFrame, path: str) -> None:
    """Export a dataset as a folder of CSV parts whose names sort in row order."""
    text = cell_text(df)
    if RID in df.columns:
        text = text.orderBy(RID).drop(RID)
    text.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Dump a dataset for a consumer as JSON lines under display names, file cells already expanded."""
    df.select(*[F.col(f"`{f.name}`").alias(display_of(f)) for f in user_fields(df)]).write.option(
        "ignoreNullFields", False).json(path)


def encode_nested(df: DataFrame) -> DataFrame:
    """A result with every nested cell as JSON text and every NULL as a blank."""
    return df.select(*[F.coalesce(F.to_json(F.col(f.name)) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
                                  else F.col(f"`{f.name}`").cast("string"), F.lit("")).alias(f.name)
                       for f in df.schema.fields if f.name not in INTERNAL])


def read_rows_json(df: DataFrame, column: str, columns: Sequence) -> tuple[DataFrame, DataFrame]:
    """Payloads holding JSON arrays of row objects: the good rows, and the rejected items with a reason.

    ``df`` needs the payload column and an ``id``. Row values arrive as text and are coerced to the
    declared columns; names match in any case.
    """
    parsed = df.select("id", F.from_json(F.col(column), "array<string>").alias("items"), F.col(column).alias("raw"))
    not_array = parsed.where(F.col("items").isNull() & (cells.squeeze(F.coalesce(F.col("raw"), F.lit(""))) != ""))
    items = parsed.select("id", F.posexplode("items").alias("index", "item"))
    is_object = F.coalesce(F.col("item"), F.lit("")).rlike(r"^\s*\{") & F.from_json("item", "map<string,string>").isNotNull()
    rows = items.where(is_object).select(
        "id", "index", F.transform_keys(F.from_json("item", "map<string,string>"), lambda k, v: F.lower(F.trim(k))).alias("m"))
    specs = column_specs(columns)
    good = number_rows(rows, "id", RID, ties=["index"]).select(
        RID,
                       *[F.try_element_at("m", F.lit(s["display"].strip().lower())).alias(s["name"]) for s in specs])
    rejects = items.where(~is_object).select("id", "index", F.lit("not an object").alias("reason")).unionByName(
        not_array.select("id", F.lit(-1).alias("index"), F.lit("not an array").alias("reason")))
    return as_dataset(good, [{"display": s["display"], "type": s["type"]} for s in specs]), rejects
