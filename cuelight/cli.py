"""The command line: ``python -m cuelight COMMAND``."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from cuelight.functions.scalars import parse_deltas
from cuelight.plans import workflows
from cuelight.session import session, ship
from cuelight.sinks.index_store import IndexStore
from cuelight.sinks.server import ServerStore
from cuelight.sources import media

LANGUAGE_VARIABLE = "CUELIGHT_STT_LANGUAGE"
ROOT = Path(os.environ.get("CUELIGHT_ROOT", Path(__file__).resolve().parents[1]))


def under_root(path: Path) -> Path:
    return path if path.is_absolute() else ROOT / path


def build_parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cuelight", description="Evidence retrieval over timed lecture transcripts")
    top.add_argument("--index-root", type=Path, default=Path("artifacts/indexes"), help="folder of stored indexes")
    top.add_argument("--url", default=os.environ.get("CUELIGHT_SEARCH_URL"), help="a running search server instead of stored indexes")
    top.add_argument("--api-key", default=os.environ.get("CUELIGHT_SEARCH_KEY"), help="key of that server")
    top.add_argument("--master", help="Spark master")
    commands = top.add_subparsers(required=True)

    def command(name: str, does, about: str, *also: str) -> argparse.ArgumentParser:
        made = commands.add_parser(name, help=about, aliases=list(also))
        made.set_defaults(does=does)
        return made

    command("health", lambda store, a: store.health(), "check that the session answers")

    records = command("index-records", run_index_records, "index question records", "index-eduvidqa")
    records.add_argument("--input", required=True, type=Path)
    records.add_argument("--index", required=True)
    records.add_argument("--project-id", default=workflows.RECORD_PROJECT)
    records.add_argument("--limit", type=int)
    records.add_argument("--batch-size", type=int, default=500)
    records.add_argument("--reset", action="store_true")

    project = command("index-project", run_index_project, "index the segments of a project")
    project.add_argument("--index", required=True)
    where = project.add_mutually_exclusive_group(required=True)
    where.add_argument("--project-id")
    where.add_argument("--project-dir", type=Path)
    project.add_argument("--segments", type=Path, help="from the project's folder, if relative")
    project.add_argument("--batch-size", type=int, default=500)
    project.add_argument("--reset", action="store_true")

    ingest = command("ingest-video", run_ingest, "register a video and write its segments and frames")
    ingest.add_argument("--video", required=True, type=Path)
    ingest.add_argument("--project-id", required=True)
    ingest.add_argument("--video-id")
    ingest.add_argument("--srt", type=Path)
    ingest.add_argument("--output-root", type=Path, default=Path("artifacts/projects"))
    ingest.add_argument("--frame-rate", type=float, default=1.0)
    ingest.add_argument("--max-frames", type=int, default=120, help="0: no cap")
    ingest.add_argument("--skip-frames", action="store_true")
    ingest.add_argument("--copy-source", action="store_true")
    ingest.add_argument("--transcript-source", choices=sorted(media.TRANSCRIPT_SOURCES), default="auto")
    ingest.add_argument("--stt-model", default=media.STT_MODEL)
    ingest.add_argument("--stt-language", default=media.setting(LANGUAGE_VARIABLE, ROOT / ".env"))
    ingest.add_argument("--stt-task", choices=media.STT_TASKS, default="transcribe")
    ingest.add_argument("--stt-word-timestamps", action="store_true")

    align = command("align-frames", run_align, "give segments the frames of their windows")
    align.add_argument("--project-id", required=True)
    align.add_argument("--output-root", type=Path, default=Path("artifacts/projects"))
    for name in ("--segments", "--frames-manifest", "--output", "--manifest"):
        align.add_argument(name, type=Path)
    align.add_argument("--margin-seconds", type=float, default=0.0)
    align.add_argument("--parts", action="store_true", help="write a folder of parts instead of one file")

    query = command("query", run_query, "search one question")
    query.add_argument("--index", required=True)
    query.add_argument("--query", required=True)
    query.add_argument("--limit", type=int, default=5)

    evaluate = command("eval-records", run_evaluate, "distance in time of the candidates of all questions", "eval-eduvidqa")
    evaluate.add_argument("--input", required=True, type=Path)
    evaluate.add_argument("--index", required=True)
    evaluate.add_argument("--limit", type=int, default=5)
    evaluate.add_argument("--record-limit", type=int)
    evaluate.add_argument("--deltas", default="5,10,15")
    evaluate.add_argument("--output", type=Path)
    evaluate.add_argument("--parts", action="store_true", help="write a folder of parts instead of one file")
    return top


def run_index_records(store: IndexStore | ServerStore, a: argparse.Namespace) -> dict:
    tell = lambda text: print(text, file=sys.stderr)
    return workflows.index_records(store, str(a.input), a.index, a.project_id, a.limit, a.batch_size, a.reset, tell)


def run_index_project(store: IndexStore | ServerStore, a: argparse.Namespace) -> dict:
    folder = media.project_folder(ROOT / "artifacts" / "projects", a.project_id, a.project_dir)
    return workflows.index_project(store, a.index, folder, a.batch_size, a.reset, a.segments)


def run_ingest(store: IndexStore | ServerStore, a: argparse.Namespace) -> dict:
    config = workflows.IngestConfig(
        video_path=a.video, project_id=a.project_id, video_id=a.video_id or workflows.default_video_id(store.spark, a.video),
        output_root=under_root(a.output_root), srt_path=a.srt, frame_rate=a.frame_rate, max_frames=a.max_frames or None,
        skip_frames=a.skip_frames, copy_source=a.copy_source, transcript_source=a.transcript_source, stt_model=a.stt_model,
        stt_language=media.clean_setting(a.stt_language), stt_task=a.stt_task, stt_word_timestamps=a.stt_word_timestamps,
    )
    return workflows.ingest_video(store.spark, config)


def run_align(store: IndexStore | ServerStore, a: argparse.Namespace) -> dict:
    return workflows.align_frames(
        store.spark, a.project_id, under_root(a.output_root), a.margin_seconds, _home(a.segments), _home(a.frames_manifest), a.output, a.manifest, not a.parts
    )


def _home(path: Path | None) -> Path | None:
    return path.expanduser() if path else None


def run_query(store: IndexStore | ServerStore, a: argparse.Namespace) -> dict:
    return workflows.query_index(store, a.index, a.query, a.limit)


def run_evaluate(store: IndexStore | ServerStore, a: argparse.Namespace) -> dict:
    output = under_root(a.output) if a.output else None
    return workflows.evaluate_records(store, str(a.input), a.index, a.limit, a.record_limit, parse_deltas(a.deltas), output, not a.parts)


def main(argv: list[str] | None = None) -> int:
    asked = build_parser().parse_args(argv)
    try:
        spark = ship(session(asked.master))
        store = ServerStore(spark, asked.url, asked.api_key) if asked.url else IndexStore(spark, under_root(asked.index_root))
        result = asked.does(store, asked)
    except KeyboardInterrupt:
        return 130
    except Exception as wrong:
        print(f"error: {wrong}", file=sys.stderr)
        return 1
    print(json.dumps(result, ensure_ascii=False, indent=2))
    return 0
