"""A stream of requests is served from state that outlives micro-batches and restarts."""

from tracelode.streaming import replay


def test_state_outlives_restarts(spark, tmp_path):
    answers = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "z")], "rec long, seq long, hash string")
    schema = "rec long, req long, hash string"

    def send(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        served = replay.serve_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), answers)
        out = served.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        out.trigger(availableNow=True).outputMode("append").start().awaitTermination()
        return {(r.rec, r.req): (r.via, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    first = send([(1, 0, "a"), (3, 0, "a")])
    assert first == {(1, 0): ("hash", 0), (3, 0): ("miss", None)}
    assert send([(1, 1, "a"), (1, 2, "q"), (1, 3, "q"), (2, 0, "z")]) == first | {(1, 1): ("hash", 2), (1, 2): ("cursor", 1), (1, 3): ("miss", None), (2, 0): ("hash", 0)}
