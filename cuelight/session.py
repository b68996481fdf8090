"""Session settings and the shipping of this package to executors."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def session(master: str | None = None, app: str = "cuelight", **conf: str) -> SparkSession:
    """A session with the settings that results depend on: UTC, adaptive plans."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    return builder.config(map=settings | conf).getOrCreate()


_BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for a context, so that Python workers can import it.

    Arrow batches are bounded by bytes as well as rows: what a worker holds then does not grow with the length of texts.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_cuelight_shipped", False):
        return spark
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    archive = Path(tempfile.mkdtemp(prefix="cuelight-")) / "cuelight.zip"
    archive.write_bytes(data.getvalue())
    context.addPyFile(str(archive))
    context._cuelight_shipped = True
    return spark


def spread(df: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """A small table over all cores: a file with one row group is one task's work, however many cores there are.

    Only where the files hold at most ``most_bytes``; larger tables have row groups enough and stay as they are.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= most_bytes else df
