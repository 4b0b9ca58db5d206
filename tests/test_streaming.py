from pyspark.sql import functions as F

from aerolith.sources import levels as src
from aerolith.streaming import series as jobs


def run(spark, sf, job, name, mode="append"):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    rows = rows.select(F.col("user_id").alias("station"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value", F.col("event_type").alias("layer"))
    q = job(rows).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_sessions_match_the_batch_form(spark, sf):
    batch = {(r.station, r.first_time): r.n for r in jobs.sessions(src.series(spark, sf)).collect()}
    stream = {(r.station, r.first_time): r.n for r in run(spark, sf, jobs.sessions, "sessions").collect()}
    assert stream and all(batch[k] == n for k, n in stream.items())


def test_counters(spark, sf):
    batch = {(r.day, r.layer): r.n for r in jobs.counters(src.series(spark, sf), "ts", "layer").collect()}
    stream = run(spark, sf, lambda df: jobs.counters(df, "ts", "layer"), "counters", "update").collect()
    last = {}
    for r in stream:
        last[r.day, r.layer] = max(r.n, last.get((r.day, r.layer), 0))
    assert last == batch


def test_once(spark, sf):
    n = src.series(spark, sf).select("event_id").distinct().count()
    assert run(spark, sf, lambda df: jobs.once(df, ["event_id"], "ts"), "once").count() == n


def test_rolling_matches_the_batch_form(spark, sf):
    batch = {(r.station, r.until): (r.n, round(r.value, 9)) for r in jobs.rolling(src.series(spark, sf)).collect()}
    stream = {(r.station, r.until): (r.n, round(r.value, 9)) for r in run(spark, sf, jobs.rolling, "rolling").collect()}
    assert stream and all(batch[k] == v for k, v in stream.items())


def test_incremental_runs_take_new_files_only(spark, sf, tmp_path):
    rows = src.series(spark, sf)
    come, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    seen = []

    def job(batch):
        seen.append(batch.count())
        return batch

    for part in (0, 1):
        rows.where(F.col("station") % 2 == part).coalesce(1).write.mode("append").parquet(come)
        jobs.incremental(spark.readStream.schema(rows.schema).parquet(come), job, out, state)
    assert len(seen) == 2 and sum(seen) == rows.count()
    assert spark.read.parquet(out).drop("batch").exceptAll(rows).isEmpty()


def test_last_rows_over_batches_late_rows_and_a_restart(spark, sf, tmp_path):
    """Keyed state: rows come out of order in four batches with a restart between; what the watermark has passed is dropped, the rest equals the batch form."""
    import pytest

    from aerolith.streaming import state

    rows = src.series(spark, sf).select("station", "ts", "event_id", "value").where("station < 12")
    with pytest.raises(ValueError, match="RocksDB"):
        state.last_rows(spark.readStream.schema(rows.schema).parquet(str(tmp_path)), 3)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, state.ROCKSDB)
    try:
        come, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
        found = rows.orderBy("ts").collect()
        cut = [found[0].ts + (found[-1].ts - found[0].ts) * k / 3 for k in range(4)]
        parts = [[r for r in found if cut[k] <= r.ts < cut[k + 1] or k == 2 and r.ts == cut[3]] for k in range(3)]
        parts[1].append(parts[0].pop(len(parts[0]) - 1))  # late by less than a day: it still counts
        gone = parts[0].pop(0)
        parts[2].append(gone)  # far too late
        end = [(s, found[-1].ts.replace(year=found[-1].ts.year + 1), -1 - s, 0.0) for s in range(12)]
        for k, part in enumerate([*parts, end]):
            spark.createDataFrame(part, rows.schema).repartition(3).write.mode("append").parquet(come)
            stream = spark.readStream.schema(rows.schema).parquet(come)
            q = state.last_rows(stream, 3, 2).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)  # each run is a restart
            q.awaitTermination(200)
            assert q.exception() is None, k
        got = sorted(map(tuple, spark.read.parquet(out).where("event_id >= 0").collect()), key=lambda r: r[2])
        want = sorted(map(tuple, state.last_rows(rows.where(F.col("event_id") != gone.event_id), 3, 2).collect()), key=lambda r: r[2])
        near = lambda rs: [(*r[:4], *(None if x is None else round(x, 9) for x in r[4:])) for r in rs]
        assert len(got) == len(want) > 20 and near(got) == near(want)
    finally:
        spark.conf.set(name, before)
