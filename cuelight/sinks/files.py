"""JSON artefacts."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, is_dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelight.scratch import Folder


def jsonable(value: Any) -> Any:
    """Dataclasses, rows and paths as JSON has them, inside of others too."""
    if is_dataclass(value) and not isinstance(value, type):
        value = asdict(value)
    elif isinstance(value, T.Row):
        value = value.asDict(recursive=True)
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [jsonable(v) for v in value]
    return str(value) if isinstance(value, Path) else value


def json_text(payload: Any) -> str:
    return json.dumps(jsonable(payload), ensure_ascii=False, indent=2) + "\n"


def write_json(path: Path, payload: Any) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json_text(payload), encoding="utf-8")


def write_lines(df: DataFrame, path: str | Path, order: str, line: Column | None = None, one_file: bool = False, compression: str | None = None) -> int:
    """One JSON object a line, nulls written out, in the given order: a folder of parts in that order, or ``one_file`` of the
    same bytes on request, for what is small. ``line``: the text of a line, if not the other columns. ``compression``: of parts, such as gzip. Returns the rows."""
    line = F.to_json(F.struct(*(c for c in df.columns if c != order)), {"ignoreNullFields": "false"}) if line is None else line
    return write_text(df.select(order, line.alias("value")).orderBy(order).select("value"), path, one_file, compression)


def write_text(text: DataFrame, path: str | Path, one_file: bool = False, compression: str | None = None) -> int:
    """The lines of one column in the order in which partitions have them, as ``write_lines`` writes them."""
    if one_file and compression:
        raise ValueError("only parts are compressed")
    rows, target = Observation(), str(path).rstrip("/")
    parts = f"{target}.parts" if one_file else target
    out = text.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    out.option("zlib.compress.level", "BEST_SPEED").text(parts, compression=compression)
    if one_file:
        folder, _, name = target.rpartition("/")
        Folder(text.sparkSession, folder).join(f"{name}.parts", name)
    return rows.get["n"]


def object_line(v: Column, **replaced: Column) -> Column:
    """An object of a variant column as JSON with all its keys, some replaced, or added, by columns."""
    kept = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(*replaced))
    made = F.create_map(*(x for k, c in replaced.items() for x in (F.lit(k), F.to_variant_object(c))))
    return F.to_json(F.map_concat(kept, made), {"ignoreNullFields": "false"})


def object_head(v: Column, name: str) -> Column:
    """An object of a variant column as JSON up to the value of a key, which comes last, as ``object_line`` has it; the value and the end of the object are to follow."""
    kept = F.to_json(F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: k != name), {"ignoreNullFields": "false"})
    return F.concat(F.left(kept, F.length(kept) - 1), F.when(kept == "{}", "").otherwise(","), F.lit(f"{json.dumps(name)}:"))


def merge_manifest(folder: Folder, name: str, most_seconds: float = 60.0, **sections: Any) -> dict[str, Any]:
    """Sets sections of a JSON object in a file; dictionaries are merged into what is there. A missing file, or one that holds
    something else, counts as empty, and so does a section that is no object.

    Writers beside each other lose nothing: each version of the file is made by the one writer that could claim its number, from the version before. A writer that
    comes too late reads again; a number whose writer is gone is passed over after ``most_seconds``.
    """
    versions, until, waited = f".{name}.versions", time.monotonic() + most_seconds, -1
    while True:
        claimed = [int(n.split(".")[0]) for n in folder.names(versions) if n.endswith(".claim")]
        done = [int(n.split(".")[0]) for n in folder.names(versions) if n.endswith(".json")]
        last = max(claimed, default=-1)
        if last > max(done, default=-1) and last > waited:  # a writer is at work
            if time.monotonic() < until:
                time.sleep(0.05)
                continue
            waited, until = last, time.monotonic() + most_seconds
        if folder.claim(f"{versions}/{last + 1:08d}.claim"):
            break
    known: Any = json.loads(folder.read_text(name)) if folder.exists(name) else {}
    known = known if isinstance(known, dict) else {}
    for key, value in sections.items():
        before = known.get(key)
        known[key] = (before if isinstance(before, dict) else {}) | value if key in ("artifacts", "counts") else value
    folder.write_text(name, json_text(known))
    folder.write_text(f"{versions}/{last + 1:08d}.json", "{}\n")
    return known
