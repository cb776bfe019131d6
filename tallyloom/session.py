"""Sessions with the settings that the operators expect."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Observation, SparkSession


def session(app: str = "tallyloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. A cluster's own settings win; `master` is for local use."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut(df, **seen):
    """The same rows with a short lineage, written by checkpoint() to the folder that all executors share.

    The folder is that of spark.checkpoint.dir. Only where the session names none and runs in one machine, as in tests, one
    is made here; a cluster without one is an error. With aggregates as keyword arguments the result is (rows, their
    values), which are taken while the rows are written and cost no pass of their own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix=f"tallyloom-{os.getpid()}-"))
    if not seen:
        return df.checkpoint(eager=True)
    watch = Observation()
    done = df.observe(watch, *[c.alias(name) for name, c in seen.items()]).checkpoint(eager=True)
    return done, watch.get
