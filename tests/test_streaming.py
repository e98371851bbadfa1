from pacewise.streaming.closures import closure_counts, run_available


def test_stream_gives_the_batch_result_but_open_windows(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    ev.coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    run_available(spark, str(tmp_path / "in"), str(tmp_path / "cp"), str(tmp_path / "out"), ev.schema)
    got = {(r["start"], r["event_type"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    every = {(r["start"], r["event_type"], r["n"]) for r in closure_counts(ev).collect()}
    assert got and got <= every
