from datetime import date, datetime

from pyspark.sql import functions as F

from lexstrata.operators.temporal import status_as_of
from lexstrata.streaming.folds import running_status, suppress_repeats, windowed_counts

ROWS = [("a", date(2024, 1, 1), "x"), ("a", date(2024, 1, 3), "y"), ("a", date(2024, 1, 3), "z"), ("b", date(2024, 1, 2), "x"), ("a", date(2024, 1, 2), "late")]


def drain(frame, mode, name):
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return frame.sparkSession.table(name)


def test_running_status_ends_like_the_batch_fold(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "k string, d date, s string")
    for i, r in enumerate(ROWS):
        spark.createDataFrame([r], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = drain(running_status(stream, "k", "d", "s"), "update", "running").collect()
    want = {tuple(r) for r in status_as_of(df, "k", "d", "s", date(2024, 2, 1)).collect()}
    assert want <= {(r["k"], r["status"], r["outcome"]) for r in out}


def test_repeats_and_windows(spark, tmp_path):
    rows = [(1, "e", datetime(2024, 1, 1, 0, m)) for m in (0, 1, 1, 7)] + [(2, "e", datetime(2024, 1, 1, 0, 2))]
    df = spark.createDataFrame(rows, "op int, effect string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert drain(suppress_repeats(read(), ["op", "effect"], "ts", "1 hour"), "append", "once").count() == 2
    counts = drain(windowed_counts(read(), "ts", "effect", "5 minutes", "10 minutes"), "update", "windows")
    assert sorted(r["n"] for r in counts.select(F.col("n")).collect()) == [1, 4]
