"""Videos: external tools behind small callables, frame grids, and where files of a project lie."""

from __future__ import annotations

import importlib
import json
import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.functions import scalars as S

# Model and choices of speech recognition and of transcripts.
STT_MODEL = "mlx-community/whisper-large-v3-mlx"
TRANSCRIPT_SOURCES = frozenset(("auto", "none", "srt", "stt"))
STT_TASKS = ("transcribe", "translate")

Runner = Callable[[Sequence[str]], str]


@dataclass(frozen=True)
class Tool:
    """A program and groups of arguments, in which ``{name}`` stands for a value. A group whose value is None is left out."""

    program: str
    groups: tuple[tuple[str, ...], ...]

    def command(self, **values: Any) -> list[str]:
        gone = {f"{{{name}}}" for name, value in values.items() if value is None}
        own = [group for group in self.groups if not any(name in word for name in gone for word in group)]
        return [self.program, *(word.format(**values) for group in own for word in group)]

    def use(self, runner: Runner, to: Path | None = None, **values: Any) -> str:
        """Runs it, for a file or files in a folder that is made if there is none."""
        if to is not None:
            to.parent.mkdir(parents=True, exist_ok=True)
        return runner(self.command(to=to, **values))


# How the tools are asked for what a video is, its sound and its frames.
PROBE = Tool("ffprobe", (("-v", "error"), ("-select_streams", "v:0"), ("-show_entries", "stream=width,height,r_frame_rate:format=duration"), ("-of", "json"), ("{video}",)))
SOUND = Tool("ffmpeg", (("-hide_banner", "-loglevel", "error", "-y"), ("-i", "{video}"), ("-vn", "-ac", "1", "-ar", "16000", "-c:a", "pcm_s16le"), ("{to}",)))
FRAMES = Tool("ffmpeg", (("-hide_banner", "-loglevel", "error", "-y"), ("-i", "{video}"), ("-vf", "fps={fps}"), ("-frames:v", "{most}"), ("{to}",)))


def run(command: Sequence[str]) -> str:
    """What a program prints, gathered in files so that neither of its outputs can stall it. One that cannot be started, or that ends with
    another code than 0, is a RuntimeError that says why."""
    with tempfile.TemporaryFile() as printed, tempfile.TemporaryFile() as complaint:
        try:
            code = subprocess.call([str(word) for word in command], stdin=subprocess.DEVNULL, stdout=printed, stderr=complaint)
        except OSError as wrong:
            raise RuntimeError(f"{command[0]} cannot be started: {wrong.strerror}") from wrong
        heard = printed if code == 0 else complaint
        heard.seek(0)
        text = heard.read().decode(errors="replace")
    if code:
        raise RuntimeError(f"{command[0]} ended with {code}: {text.strip()}")
    return text


def probe_rows(outputs: DataFrame) -> DataFrame:
    """outputs: path, value (what ffprobe prints as JSON). duration_sec, width, height and r_frame_rate, null on bad."""
    v = F.try_parse_json("value")
    get = lambda p: F.try_variant_get(v, p, "variant")
    return outputs.select(
        "path",
        S.variant_double(get("$.format.duration")).alias("duration_sec"),
        S.variant_long(get("$.streams[0].width")).alias("width"),
        S.variant_long(get("$.streams[0].height")).alias("height"),
        F.try_variant_get(v, "$.streams[0].r_frame_rate", "string").alias("r_frame_rate"),
    )


def probe_video(spark: SparkSession, video: Path, runner: Runner = run) -> dict[str, Any]:
    printed = PROBE.use(runner, video=video)
    json.loads(printed)
    rows = probe_rows(spark.createDataFrame([(str(video), printed)], "path string, value string"))
    return rows.drop("path").first().asDict()


def extract_audio(video: Path, audio: Path, runner: Runner = run) -> Path:
    """Mono audio of 16 kHz, 16 bits, as a WAV file; one that is there is overwritten."""
    SOUND.use(runner, audio, video=video)
    return audio


def sample_frames(video: Path, folder: Path, fps: float, most: int | None, runner: Runner = run) -> int:
    """Writes frames at a rate; ``most`` of None, 0 or less is no cap. Returns how many frame files the folder then has."""
    FRAMES.use(runner, folder / "frame_%06d.jpg", video=video, fps=fps, most=most if most and most > 0 else None)
    return sum(name.startswith("frame_") and name.endswith(".jpg") for name in os.listdir(folder))


def frame_grid(spark: SparkSession, folder: str, fps: float, count: int) -> DataFrame:
    """(frame_id, frame_path, timestamp, ordinal) of ``count`` frames at a rate."""
    n = F.col("id")
    return spark.range(1, count + 1).select(
        S.frame_name(n).alias("frame_id"),
        F.concat(F.lit(f"{folder}/"), S.frame_name(n), F.lit(".jpg")).alias("frame_path"),
        S.frame_time(n, fps).alias("timestamp"),
        (n - 1).alias("ordinal"),
    )


def frame_grids(videos: DataFrame, folder: Column) -> DataFrame:
    """videos: video, fps, frames. (video, frame_id, frame_path, timestamp, ordinal) of every frame of every video, each in its ``folder``; no times at rates
    that are not positive."""
    n = F.col("n")
    each = videos.select("video", "fps", folder.alias("folder"), F.explode(F.when(F.col("frames") > 0, F.sequence(F.lit(1).cast("long"), F.col("frames").cast("long")))).alias("n"))
    at = F.when(F.col("fps") > 0, S.rounded((n - 1).cast("double") / F.col("fps").cast("double"), 3))
    return each.select("video", S.frame_name(n).alias("frame_id"), F.concat("folder", F.lit("/"), S.frame_name(n), F.lit(".jpg")).alias("frame_path"), at.alias("timestamp"), (n - 1).alias("ordinal"))


# What speech recognition is asked for unless it is told otherwise.
HEARING = {"word_timestamps": False, "temperature": 0.0, "condition_on_previous_text": False, "hallucination_silence_threshold": 1.0, "task": "transcribe"}


def transcribe(audio: Path, model: str = STT_MODEL, **wanted: Any) -> dict[str, Any]:
    """Speech to text by an optional library; any callable of this form can take its place. Options that are None or blank are not passed on."""
    try:
        hear = importlib.import_module("mlx_whisper").transcribe
    except ImportError as missing:
        raise RuntimeError("speech to text needs mlx-whisper") from missing
    options = {name: value for name, value in (HEARING | wanted).items() if value not in (None, "")}
    return hear(str(audio), path_or_hf_repo=model, **options)


def resolve_srt(video: Path, named: Path | None, exists: Callable[[str], bool] = os.path.exists) -> str | None:
    """The subtitle file of a video: the named one, which must be there, or one of the video's name beside it, or none."""
    file = str(video.with_suffix(".srt") if named is None else named.expanduser().resolve() if "://" not in str(named) else named)
    if exists(file):
        return file
    if named is not None:
        raise FileNotFoundError(f"no subtitle file at {file}")
    return None


def register_source(video: Path, folder: Path, copy: bool) -> Path:
    """Copies or links a video into a folder; what is there under its name stays."""
    target = folder / video.name
    if not (target.exists() or target.is_symlink()):
        folder.mkdir(parents=True, exist_ok=True)
        if copy:
            shutil.copy2(video, target)
        else:
            target.symlink_to(video)
    return target


def segment_file(project: str | Path, named: str | Path | None = None, exists: Callable[[str], bool] = os.path.exists) -> str:
    """The segments of a project: a named file (from the project's folder, if relative), else aligned ones, else plain ones."""
    inside = [str(named)] if named else ["segments/lecture_segments_aligned.jsonl", "segments/lecture_segments.jsonl"]
    options = [name if name.startswith("/") or "://" in name else f"{project}/{name}" for name in inside]
    for option in options:
        if exists(option):
            return option
    raise FileNotFoundError(f"no segments at {' or '.join(options)}")


def project_folder(root: Path, project_id: str | None = None, project_dir: Path | None = None) -> Path:
    """A project's folder by id or by path, exactly one of them; it must exist."""
    if bool(project_id) == bool(project_dir):
        raise ValueError("give either a project id or a project folder")
    folder = project_dir if project_dir else root / project_id
    if not folder.exists():
        raise FileNotFoundError(f"no project at {folder}")
    return folder


def clean_setting(value: str | None) -> str | None:
    """None for a blank."""
    return (value or "").strip() or None


def dotenv_setting(name: str, file: Path) -> str | None:
    """The value of a name in a file of NAME=value lines, without quotes around it."""
    if not file.exists():
        return None
    for line in file.read_text(encoding="utf-8").splitlines():
        key, equals, value = line.strip().partition("=")
        if equals and not key.startswith("#") and key.strip() == name:
            return value.strip().strip("\"'")
    return None


def setting(name: str, file: Path) -> str | None:
    """An environment variable, else the file's; a variable that is set but blank hides the file's."""
    return clean_setting(os.environ[name] if name in os.environ else dotenv_setting(name, file))
