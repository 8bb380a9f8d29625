import tempfile

from pyspark.sql import functions as F

from assaykit.streaming.windows import event_windows


def test_stream_gives_the_closed_windows_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = tempfile.mkdtemp(prefix="spark-")
    table.write.parquet(f"{folder}/in/1")
    stream = spark.readStream.schema(table.schema).parquet(f"{folder}/in/*")
    query = event_windows(stream).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination(90)
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(f"{folder}/out").collect()}
    every = {(r.start, r.event_type): r.n for r in event_windows(table).collect()}
    assert got and got.items() <= every.items()
    last = table.agg(F.max("ts")).first()[0]
    assert all((start, kind) in got for start, kind in every if (last - start).total_seconds() >= 7200)
