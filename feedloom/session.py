"""Session defaults: UTC, adaptive execution, shuffle partitions that follow the machine."""

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "feedloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the library's plans assume; `conf` overrides any of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


_SHIPPED: set[str] = set()


#: Rows of a batch between Spark and Python: texts are long, and the default of 10,000 holds 34 MB of them at once.
BATCH_ROWS = "1000"


def ready(spark: SparkSession) -> None:
    """Ship the package and, unless the session says otherwise, keep batches for Python small."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that Python functions find it there
    wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="feedloom-")) / "feedloom_package"
    made = shutil.make_archive(str(target), "zip", root_dir=package.parent, base_dir=package.name)
    spark.sparkContext.addPyFile(made)
