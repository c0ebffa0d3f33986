from datetime import datetime, timedelta

from tidemark.streaming.bars import stream_bars


def test_bars_of_closed_windows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(minutes=10 * i), float(i + 1)) for i in range(12)] + [("b", start, 5.0), ("a", start + timedelta(hours=9), 1.0)]
    spark.createDataFrame(rows, "event_type string, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("event_type string, ts timestamp, value double").parquet(f"{tmp_path}/in")
    query = stream_bars(events).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination(120)
    got = {(r.ticker, r.date.hour): (r.open, r.high, r.low, r.close, r.nav, r.volume) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 0): (1.0, 6.0, 1.0, 6.0, 3.5, 6), ("a", 1): (7.0, 12.0, 7.0, 12.0, 9.5, 6), ("b", 0): (5.0, 5.0, 5.0, 5.0, 5.0, 1)}
