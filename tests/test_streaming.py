from tidemark.streaming import hits


def test_min_gap_stream(spark, tmp_path):
    kind = "tv string, clip string, start double, length double, score double, ts timestamp"
    rows = [("t", "c", float(s), 1.0, q) for s, q in ((0, 0.1), (3, 0.2), (6, 0.3), (20, 0.5), (40, 0.1))]
    for i, part in enumerate((rows[:2], rows[2:4], rows[4:])):
        spark.createDataFrame(part, kind.rsplit(",", 1)[0]).selectExpr("*", "timestamp_seconds(start) as ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = hits.min_gap(stream, 4.0).writeStream.format("memory").queryName("kept_hits").option("checkpointLocation", f"{tmp_path}/c1").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    q.stop()
    assert sorted(r["start"] for r in spark.table("kept_hits").collect()) == [6.0, 20.0]
    q = hits.window_scores(stream, width="10 seconds").writeStream.format("memory").queryName("votes").option("checkpointLocation", f"{tmp_path}/c2").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    q.stop()
    assert [(r["votes"], round(r["best_score"], 3)) for r in spark.table("votes").orderBy("window").collect()][:1] == [(3, 0.3)]
