"""Session defaults and the shared work folder."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "logsieve", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; every setting can be overridden by keyword or spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests, one machine) is a
    temporary folder made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="logsieve-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder until nothing refers to it; its lineage ends here."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(work_dir(df.sparkSession))
    return df.checkpoint()
