"""The channel table: endpoints checked against the registries, rejects kept with their reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylog.functions.scalars import uri_rest, uri_scheme
from relaylog.operators.routing import valid_pattern
from relaylog.schema import HANDLER_CLASSES, QUEUE_CLASSES


def _registry(df: DataFrame, classes: dict[str, str], key: str, value: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(list(classes.items()), f"{key} string, {value} string"))


def channel_table(
    channels: DataFrame,
    queue_classes: dict[str, str] = QUEUE_CLASSES,
    handler_classes: dict[str, str] = HANDLER_CLASSES,
) -> DataFrame:
    """Add ``mq, mq_class, sapi_class, uri, status`` to rows of ``channel, endpoint, sapi``.

    ``status`` is ``ok`` or the first failing check. Only ``ok`` rows become routes.
    """
    rows = channels.withColumns({
        "mq": uri_scheme("endpoint"),
        "_rest": uri_rest("endpoint"),
        "_sapi": F.coalesce("sapi", F.lit("")),
    }).withColumn("_sapi_mq", uri_scheme("_sapi"))
    rows = rows.join(_registry(channels, queue_classes, "mq", "mq_class"), "mq", "left")
    rows = rows.join(_registry(channels, handler_classes, "_sapi_mq", "sapi_class"), "_sapi_mq", "left")
    uri = F.concat("_rest", F.when(F.endswith("_rest", F.lit("/")), F.lit("")).otherwise(F.lit("/")))
    status = (
        F.when(F.coalesce("mq", F.lit("")) == "", "invalid_endpoint")
        .when(F.col("mq_class").isNull(), "mq_not_found")
        .when((F.col("_sapi") != "") & F.col("sapi_class").isNull(), "invalid_sapi")
        .when((F.col("mq_class") == "SyncSAPI") & (uri_scheme("_sapi", "://") == ""), "init_failed")
        .when(~valid_pattern(uri), "invalid_pattern")
        .otherwise("ok")
    )
    return rows.withColumns({"status": status, "uri": F.when(status == "ok", uri)}).drop("_rest", "_sapi", "_sapi_mq")


def routes_of(checked: DataFrame) -> DataFrame:
    """The usable channels as routes."""
    return checked.filter(F.col("status") == "ok").select("channel", F.col("uri").alias("pattern"))
