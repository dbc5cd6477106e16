import datetime as dt

from pyspark.sql import functions as F

from stforecast.streaming.stream import run_to_table, stream_panel


def test_late_events_do_not_reopen_a_bucket(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    schema = "ts timestamp_ntz, user_id long, value double"

    def write(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        events = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        panel = stream_panel(events, "ts", F.col("user_id") % 2, F.col("value"), "1 hour", "10 minutes")
        return {(r.ts.hour, r.cell): r.value for r in run_to_table(panel, str(tmp_path / "work")).collect()}

    write("a", [(day, 0, 1.0), (day + dt.timedelta(minutes=30), 0, 3.0), (day + dt.timedelta(hours=2), 1, 5.0)])
    assert run() == {(0, 0): 2.0}
    # one event within the bound for hour 2, one far too late for hour 0
    write("b", [(day + dt.timedelta(hours=2, minutes=5), 1, 7.0), (day + dt.timedelta(minutes=1), 0, 99.0),
                (day + dt.timedelta(hours=5), 0, 0.0)])
    assert run() == {(0, 0): 2.0, (2, 1): 6.0}
