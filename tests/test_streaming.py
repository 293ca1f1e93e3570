from samewise.streaming import ingest


def test_events_once_and_windows(spark, data, tmp_path):
    batch = spark.read.parquet(f"{data}/events.parquet")
    src = str(tmp_path / "in")
    batch.unionByName(batch).write.parquet(src)
    out, seen = str(tmp_path / "out"), []

    def keep(df, n):
        seen.append(n)
        df.write.mode("overwrite").parquet(f"{out}/batch={n}")

    events = ingest.record_stream(spark, src, batch.schema)
    q = ingest.scan_new_records(ingest.distinct_events(events), str(tmp_path / "cp"), keep)
    q.awaitTermination()
    assert seen and spark.read.parquet(out).count() == batch.count()
    w = ingest.windowed_counts(ingest.record_stream(spark, src, batch.schema)).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.table("w").agg({"n": "sum"}).first()[0] == 2 * batch.count()
