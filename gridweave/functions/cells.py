"""Cell typing: turning loose text into typed columns and typed columns back into text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that mean true.
TRUE_WORDS = ["1", "true", "yes", "y", "on"]

# What a number cell may look like once commas and outer blanks are gone.
NUMBER_PATTERN = (r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
                  r"|^[+-]?(?i:inf|infinity)$")
NAN_PATTERN = r"^[+-]?(?i:nan)$"

# Timestamps above this are milliseconds.
MILLISECOND_FLOOR = 1e11

_ID_LIST = "array<string>"


def squeeze(c: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def number_to_text(c: Column) -> Column:
    """Plain digits at every size: whole numbers without a fraction, no exponents."""
    d = c.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < F.lit(9e18))
    short = d.cast("string")

    def part(i: int) -> Column:
        return F.regexp_extract(short, r"^(-?)(\d)\.(\d+)E(-?\d+)$", i)

    shift, rest = part(4).try_cast("int"), F.regexp_replace(part(3), "^0$", "")
    wide = (F.when(shift < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -shift - 1), part(2), rest))
            .when(shift >= F.length(rest), F.concat(part(2), F.rpad(rest, shift, "0")))
            .otherwise(F.concat(part(2), F.substring(rest, F.lit(1), shift), F.lit("."), F.substring(rest, shift + 1, F.length(rest)))))
    return (F.when(whole, d.cast("bigint").cast("string"))
            .when(~F.contains(short, F.lit("E")), short).when(shift.isNotNull(), F.concat(part(1), wide)).otherwise(short))


def text_of(c: Column, dtype: T.DataType) -> Column:
    """The text form of a cell, as search, merge and dedup keys see it."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("string")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return number_to_text(c)
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def _bare_number(c: Column) -> Column:
    return squeeze(F.replace(c, F.lit(","), F.lit("")))


def coerce_number(c: Column) -> Column:
    """Parse text to double; blank, NaN and unparseable text give NULL (see :func:`rescue_number`)."""
    s = _bare_number(c)
    return F.when(s.rlike(NUMBER_PATTERN), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))


def rescue_number(c: Column) -> Column:
    """The original text when a number cell could not be read as a number, so nothing is lost."""
    s = _bare_number(c)
    return F.when((s != "") & ~s.rlike(NUMBER_PATTERN) & ~s.rlike(NAN_PATTERN), c)


def coerce_boolean(c: Column) -> Column:
    """Truthy words are true, every other non-NULL text is false."""
    return F.lower(squeeze(c)).isin(TRUE_WORDS)


def coerce_file_list(c: Column) -> Column:
    """A JSON array of ids, or one bare id, to an array of trimmed non-blank ids."""
    s = squeeze(c)
    parsed = F.when(s.startswith("["), F.from_json(s, _ID_LIST))
    ids = F.coalesce(parsed, F.array(s))
    return F.when(s != "", clean_ids(ids))


def clean_ids(ids: Column) -> Column:
    return F.filter(F.transform(ids, squeeze), lambda x: x != "")


def coerce_cell(c: Column, source: T.DataType, logical: str) -> Column:
    """One column of any Spark type to the Spark type of a logical type."""
    if logical == "number":
        if isinstance(source, (T.NumericType, T.BooleanType)):
            value = c.cast("double")
            return F.when(~F.isnan(value), value)
        return coerce_number(text_of(c, source))
    if logical == "boolean":
        if isinstance(source, T.BooleanType):
            return c
        return coerce_boolean(c.cast("string") if isinstance(source, T.NumericType) else text_of(c, source))
    if logical == "file_list":
        if isinstance(source, T.ArrayType):
            return clean_ids(c.cast(_ID_LIST))
        return coerce_file_list(text_of(c, source))
    return text_of(c, source)


def epoch_to_ts(c: Column) -> Column:
    """Epoch seconds to a timestamp; old records kept milliseconds."""
    return F.timestamp_seconds(epoch_seconds(c))


def epoch_seconds(c: Column) -> Column:
    return F.when(c > MILLISECOND_FLOOR, c / 1000.0).otherwise(c)
