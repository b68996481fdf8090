"""Scalar expressions over text and numbers, all inside Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The hints that mark a mention of something on screen, in output order.
DEICTIC_HINTS = (
    "this", "that", "here", "left", "right", "top", "bottom", "graph", "chart", "matrix", "equation", "formula",
    "table", "red", "blue", "box", "line", "point", "figure",
    "이것", "이거", "이 부분", "이 장면", "여기", "왼쪽", "오른쪽", "그래프", "행렬", "수식", "표", "박스",
)

# White space as Unicode has it, with the four separators that Java's class leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]"

_NUMBER = r"^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
_SPECIAL = r"(?i)^[+-]?(inf|infinity|nan)$"
_WHOLE = r"^[+-]?\d+(_\d+)*$"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1))).rlike(r"(?U)[\s\x1c-\x1f]")  # most texts have none, which a look at the ends tells
    return F.when(ends, F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")).otherwise(text)


def collapse_space(text: Column) -> Column:
    """Each run of white space becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def slugify(text: Column) -> Column:
    """Runs of anything but ASCII letters, digits and ``_ . : -`` become ``_``; none at the ends; ``empty`` if nothing is left."""
    slug = F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9_.:-]+", "_"), F.lit("_"))
    return F.when(slug == "", "empty").otherwise(slug)


def mention_candidates(text: Column, hints: Sequence[str] = DEICTIC_HINTS) -> Column:
    """The hints that occur in the lower-cased text, inside of words too, in the order of the list."""
    # The variable of a lambda is worked out once, where the expression itself would be for each hint.
    found = lambda low: F.array_compact(F.array(*(F.when(F.contains(low, F.lit(h)), F.lit(h)) for h in hints)))
    return F.element_at(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), found), 1)


def excerpt(text: Column, most: int = 360) -> Column:
    """The first ``most`` code points, with ``...`` if there are more."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def path_stem(path: Column) -> Column:
    """Last component of a path without its last suffix; a name that begins with its only dot is kept. Null gives ''."""
    name = F.element_at(F.split(F.regexp_replace(F.coalesce(path, F.lit("")), "(?<=.)/+$", ""), "/"), -1)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def video_id(path: Column) -> Column:
    return slugify(path_stem(path))


def transcript_source(requested: Column, srt_path: Column) -> Column:
    """``auto`` is ``srt`` where there is a subtitle file and ``stt`` where not; others stand as they are."""
    return F.when(requested != "auto", requested).when(srt_path.isNotNull(), "srt").otherwise("stt")


def parse_double(text: Column) -> Column:
    """A text as a double, null if it isn't one: underscores between digits and ``inf`` and ``nan`` are allowed, type
    letters at the end aren't."""
    bare = strip(text)
    plain = F.when(bare.rlike(_NUMBER) | bare.rlike(_SPECIAL), F.replace(bare, F.lit("_"), F.lit("")))
    return plain.try_cast("double")


def parse_long(text: Column) -> Column:
    """A text as a whole number, null if it isn't one."""
    bare = strip(text)
    return F.when(bare.rlike(_WHOLE), F.replace(bare, F.lit("_"), F.lit(""))).try_cast("long")


def variant_kind(value: Column) -> Column:
    """The type of a variant in one word, such as OBJECT, ARRAY, STRING, BOOLEAN or VOID; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def variant_double(value: Column) -> Column:
    """A variant as a double, null on bad; booleans count as 1 and 0."""
    kind = variant_kind(value)
    return (
        F.when(kind == "STRING", parse_double(F.try_variant_get(value, "$", "string")))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
        .otherwise(F.try_variant_get(value, "$", "double"))
    )


def variant_long(value: Column) -> Column:
    """A variant as a long, null on bad: numbers are cut towards zero, texts must be whole."""
    kind = variant_kind(value)
    number = F.try_variant_get(value, "$", "double")
    cut = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("long")
    return (
        F.when(kind == "STRING", parse_long(F.try_variant_get(value, "$", "string")))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("long"))
        .when(kind == "BIGINT", F.try_variant_get(value, "$", "long"))
        .otherwise(F.when(F.abs(number) < 2.0**63, cut))
    )


def rounded(x: Column, places: int) -> Column:
    """Rounding to the nearest decimal of ``places`` by the exact binary value, ties to even.

    The product with the power of ten is taken with its rounding error (Dekker 1971), which decides where the product
    alone looks like a tie. Numbers too large to have such places stay as they are.
    """
    scale = F.lit(10.0**places)
    product, spread = x * scale, x * F.lit(134217729.0)
    high = spread - (spread - x)
    error = (high * scale - product) + (x - high) * scale
    whole = F.rint(product)
    beyond = product - whole
    nearest = F.when((beyond == 0.5) & (error > 0), whole + 1).when((beyond == -0.5) & (error < 0), whole - 1).otherwise(whole)
    return F.when(F.isnan(x) | (F.abs(product) >= 2.0**52), x).otherwise(nearest / scale)


def frame_time(number: Column, fps: float) -> Column:
    """Seconds of the frame of a 1-based number, to 3 places; null if the rate is not positive."""
    if fps <= 0:
        return F.lit(None).cast("double")
    return rounded((number - 1).cast("double") / F.lit(float(fps)), 3)


def frame_name(number: Column) -> Column:
    return F.format_string("frame_%06d", number)


def subtitle_seconds(stamp: Column) -> Column:
    """``HH:MM:SS,mmm`` (or a dot) as seconds."""
    part = F.split(F.replace(stamp, F.lit(","), F.lit(".")), ":")
    at = lambda i: F.try_element_at(part, F.lit(i))
    return at(1).cast("int") * 3600 + at(2).cast("int") * 60 + at(3).cast("double")


def mean(points: Column) -> Column:
    """Mean of an array of doubles, null if it is empty."""
    return F.when(F.size(points) > 0, F.aggregate(points, F.lit(0.0), lambda a, x: a + x) / F.size(points))


def delta_list(text: Column) -> Column:
    """Comma-separated whole numbers as an array; blanks are skipped, and none at all is an error."""
    given = F.filter(F.transform(F.split(text, ","), lambda d: F.trim(d)), lambda d: d != "")
    return F.when(F.size(given) == 0, F.raise_error(F.lit("at least one delta is needed"))).otherwise(
        F.transform(given, lambda d: d.cast("int"))
    )


def parse_deltas(text: str) -> list[int]:
    """The same on the driver."""
    deltas = [int(d) for d in text.split(",") if d.strip()]
    if not deltas:
        raise ValueError("at least one delta is needed")
    return deltas
