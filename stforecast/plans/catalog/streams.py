"""Catalogue: streaming forms, run over everything available and compared with batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from stforecast.operators import blocks as bl
from stforecast.plans.catalog import panels as p
from stforecast.plans.catalog import sql
from stforecast.plans.catalog.models import FIT, ONE, one_readouts
from stforecast.plans.catalog.registry import query
from stforecast.streaming.stream import load_models, run_to_table, stream_one_step, stream_panel

r = sql.r


@query(
    "stream_panel",
    f"""WITH {sql.EVENTS}, closed AS (SELECT max(epoch(ts)) - 3600 AS until FROM events)
    SELECT CAST(t AS BIGINT) AS t, CAST(cell AS BIGINT) AS cell, {r('value')} AS value
    FROM ev, closed WHERE (t + 1) * 7200 + 1704067200 <= until""",
)
def stream_panel_job(spark, sf_dir):
    """Buckets the watermark has closed by the end of the events."""
    folder = p.work_folder(spark)
    source = p.table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    source.repartitionByRange(4, "ts").write.parquet(f"{folder}/in")
    events = spark.readStream.schema(source.schema).parquet(f"{folder}/in")
    cell = F.when(
        F.col("event_type").isin("purchase", "signup"), 8 + F.col("user_id") % 6
    ).otherwise(F.col("user_id") % 8)
    panel = run_to_table(
        stream_panel(events, "ts", cell, F.col("value"), "2 hours", "1 hour"), folder
    )
    bucket = F.floor((F.unix_seconds("ts") - p.EVENTS_ORIGIN) / p.BUCKET_SECONDS)
    return p.present(panel.select(bucket.alias("t"), "cell", "value"))


@query(
    "stream_one_step",
    f"""{FIT}, {ONE.fitted()}, {ONE.after_last()}
    SELECT t, CAST(cell AS BIGINT) AS cell, {r('value')} AS yhat FROM aft WHERE t >= 1
    UNION ALL SELECT t, CAST(cell AS BIGINT), {r('value')} FROM anx""",
)
def stream_one_step_job(spark, sf_dir):
    """The batch one-step scores, from a stream of frame files in any order."""
    block_map, nets, _, frames, n, readouts = one_readouts(spark, sf_dir)
    folder = p.work_folder(spark)
    frames.repartitionByRange(4, "t").write.parquet(f"{folder}/in")
    arriving = (
        spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    )
    inputs = bl.gather_inputs(arriving, block_map, keys=["run"])
    scored = run_to_table(stream_one_step(inputs, load_models(nets, readouts), max_early=n), folder)  # all but one may come first
    merged = bl.merge_block_outputs(scored.drop("run"), block_map)
    return p.present(merged.select("t", "cell", "yhat"))
