from millrace.streaming import telemetry


def drain(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def test_stream_equals_batch(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "events"))
    stream = telemetry.event_stream(spark, str(tmp_path / "events"), events.schema)
    for name, f in (("tumbling", telemetry.tumbling), ("sliding", telemetry.sliding)):
        got = {tuple(r) for r in drain(f(stream), name, "complete").collect()}
        assert got == {tuple(r) for r in f(events).collect()}
    assert drain(telemetry.deduplicated(stream.unionByName(stream), delay="40 days"), "dedup", "append").count() == events.select("event_id").distinct().count()


def test_expiring_cache(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet").coalesce(1)
    events.write.parquet(str(tmp_path / "events"))
    out = drain(telemetry.expiring_cache(telemetry.event_stream(spark, str(tmp_path / "events"), events.schema), 86_400), "expiring", "update")
    total = out.selectExpr("sum(n_served) s", "sum(n_stored) t").first()
    by_user, served, stored = {}, 0, 0
    for r in sorted(events.collect(), key=lambda r: r["ts"]):
        last = by_user.get(r["user_id"])
        if last is not None and (r["ts"] - last).total_seconds() < 86_400:
            served += 1
        else:
            by_user[r["user_id"]], stored = r["ts"], stored + 1
    assert (total["s"], total["t"]) == (served, stored)
