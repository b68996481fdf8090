"""JSON lines with an open schema, in file order, and records of a fixed one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cuelight.functions import scalars as S
from cuelight.operators.numbering import last_wins
from cuelight.operators.segments import RECORD_PROJECT, record_segments
from cuelight.scratch import discard, written
from cuelight.sources.lines import line_number, read_lines


def read_json_lines(spark: SparkSession, path: str, check: bool = True, limit: int | None = None) -> DataFrame:
    """(position, v variant) of each line that isn't blank, the first ``limit`` of them if given (0 and less: none).

    position orders lines as the files do: struct(file, block, row, nth). The files are read and parsed once, into the shared folder, and
    a line that is no JSON object is a ValueError that names file and 1-based line; lines beyond the limit are not looked at. Without
    ``check`` nothing is read at once, and such a line fails when it is. A byte order mark is dropped.
    """
    place = F.struct("file", F.col("start").alias("block"), "row", "nth").alias("position")
    lines = read_lines(spark, path, limit).select(place, S.strip(F.col("line").cast("string")).alias("line"))
    parsed = lines.select("position", "line", F.try_parse_json("line").alias("v"))
    wrong = F.col("v").isNull() | (F.left("line", F.lit(1)) != "{")  # what else begins so is no JSON
    said = F.substring("line", 1, 80)
    if not check:
        failed = F.raise_error(F.concat(F.lit("not a JSON object: "), said))
        return parsed.select("position", F.when(wrong, failed.cast("variant")).otherwise(F.col("v")).alias("v"))
    seen = Observation()
    first = F.min(F.when(wrong, F.struct("position", said.alias("text"))))
    made = written(parsed.observe(seen, first.alias("bad")).select("position", "v"))
    bad = seen.get["bad"]
    if bad:
        discard(made)
        at = bad["position"]
        raise ValueError(f"{at['file']}, line {line_number(spark, path, at['file'], at['block'], at['row'])}: not a JSON object: {bad['text']}")
    return made


def field(v: Column, name: str) -> Column:
    """A key of an object, as a variant; null if it is missing."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def _number_text(value: Column) -> Column:
    """A number with a fraction or an exponent in the shortest digits that name it: 1e5 as 100000.0, 1e16 and 0.00001 as 1e+16 and 1e-05."""
    x = F.try_variant_get(value, "$", "double")
    said = x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(said.cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(said, r"\.0E", "E"), r"E(\d)", "e+$1"), r"E-", "e-")
    power = F.regexp_replace(power, r"e([+-])(\d)$", "e$10$2")
    return F.when(x == 0, said).when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), plain).otherwise(power)


def _said(value: Column) -> Column:
    """A JSON value as text: texts and whole numbers as they are, ``True`` and ``False``; lists and objects as JSON. -0.0 is read as 0.0."""
    kind = S.variant_kind(value)
    # A decimal without places had some that were zero, or is a whole number beyond 64 bits.
    broken = (kind == "DECIMAL") & (F.schema_of_variant(value).rlike(r",[1-9]") | (F.abs(F.try_variant_get(value, "$", "double")) < 2.0**63))
    return (
        F.when(kind == "BOOLEAN", F.initcap(F.try_variant_get(value, "$", "string")))
        .when(kind.isin("DOUBLE", "FLOAT") | broken, _number_text(value))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )


def text_field(v: Column, name: str, default: str = "", null_text: str = "") -> Column:
    """A key as text: the default if it is missing, ``null_text`` if it is JSON's null."""
    value = field(v, name)
    return F.when(value.isNull(), default).when(F.is_variant_null(value), null_text).otherwise(_said(value))


def truth(value: Column) -> Column:
    """Whether a JSON value counts as true: null, false, zero and what is empty do not."""
    kind = S.variant_kind(value)
    return (
        F.when(F.is_variant_null(value), False)
        .when(kind == "STRING", F.try_variant_get(value, "$", "string") != "")
        .when(kind == "ARRAY", F.size(F.try_variant_get(value, "$", "array<variant>")) > 0)
        .when(kind == "OBJECT", F.size(F.try_variant_get(value, "$", "map<string,variant>")) > 0)
        .otherwise(F.coalesce(S.variant_double(value) != 0, F.lit(True)))
    )


def _listed(value: Column) -> Column:
    """A JSON value as a list of texts: of a text its characters, of an object its keys; others are an error."""
    kind = S.variant_kind(value)
    chars = F.split(F.try_variant_get(value, "$", "string"), "(?!^)(?<!$)")
    return (
        F.when(kind == "ARRAY", F.transform(F.try_variant_get(value, "$", "array<variant>"), _said))
        .when(kind == "STRING", F.filter(chars, lambda c: c != ""))
        .when(kind == "OBJECT", F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")))
        .otherwise(F.raise_error(F.lit("raw_keys is not a list")).cast("array<string>"))
    )


def coerce_records(rows: DataFrame, carried: list[str] | None = None, null_text: str = "") -> DataFrame:
    """The record columns from a variant column ``v``.

    A null for a text gives ``null_text``; strictly it is the text ``None``. Numbers and truth values for a text are written out. Time points and sample_index must be numbers or texts of
    numbers, anything else is an error; so is a null for the points.
    """
    v = F.col("v")
    points = field(v, "timestamp_points")
    number = lambda x: F.coalesce(S.variant_double(x), F.raise_error(F.lit("a time point is not a number")).cast("double"))
    listed = F.transform(F.try_variant_get(points, "$", "array<variant>"), number)
    given = F.when(points.isNull(), F.array().cast("array<double>")).otherwise(
        F.coalesce(listed, F.raise_error(F.lit("timestamp_points is not a list")).cast("array<double>"))
    )
    index = field(v, "sample_index")
    whole = F.coalesce(S.variant_long(index), F.raise_error(F.lit("sample_index is not a number")).cast("long"))
    has = field(v, "has_timestamp")
    qid, keys = field(v, "qid"), field(v, "raw_keys")
    texts = ["sample_id", "video_name", "question", "answer", "transcript_text"]
    made = rows.select(
        *(carried or []),
        *(text_field(v, c, null_text=null_text).alias(c) for c in ("dataset_name", "subset_name", "split_name")),
        F.when(index.isNull(), F.lit(0).cast("long")).otherwise(whole).alias("sample_index"),
        *(text_field(v, c, null_text=null_text).alias(c) for c in texts),
        given.alias("timestamp_points"),
        has.isNull().alias("_unsaid"),
        truth(has).alias("has_timestamp"),
        F.when(qid.isNotNull() & ~F.is_variant_null(qid), _said(qid)).alias("qid"),
        F.when(keys.isNull(), F.array().cast("array<string>")).otherwise(_listed(keys)).alias("raw_keys"),
    )
    said = F.when(F.col("_unsaid"), F.size("timestamp_points") > 0).otherwise(F.col("has_timestamp"))
    return made.withColumn("has_timestamp", said).drop("_unsaid")


def read_records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``position`` and the record columns; the first ``limit`` lines if given (0 and less: none)."""
    return coerce_records(read_json_lines(spark, path, limit=limit), ["position"])


def read_record_segments(spark: SparkSession, path: str, project_id: str = RECORD_PROJECT, limit: int | None = None) -> DataFrame:
    return record_segments(read_records(spark, path, limit), project_id, carried=["position"])


def records_by_id(records: DataFrame) -> DataFrame:
    """One record for each sample_id: the last in the file."""
    return last_wins(records, "sample_id", "position")


def object_text(v: Column) -> Column:
    """A row with all its keys, as JSON."""
    return F.to_json(v)
