"""Streams replayed from files, one at a time, against their batch twins."""

import datetime

from pyspark.sql import functions as F

from lodestar.operators import audit, logs
from lodestar.streaming import state

DAY = datetime.datetime(2024, 1, 1)


def at(minutes):
    return DAY + datetime.timedelta(minutes=minutes)


def replay(spark, folder, schema, batches):
    """A stream of one micro-batch for each list of rows."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{i:02d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def collected(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_events_wait_for_their_searches(spark, tmp_path):
    logs = replay(spark, tmp_path / "logs", "search_uuid string, ts timestamp", [[("a", at(0)), ("c", at(0))], [("b", at(31))], [("z", at(200))], [("z2", at(400))]])
    rows = [
        [("a", 1, 1, "click", at(1)), ("b", 2, 1, "click", at(31)), ("a", 0, 1, "dym_click", at(2)), ("a", 0, 1, "click", at(2)), ("a", 1, -1, "click", at(2)), ("a", 1, 1, "open", at(2)), (None, 1, 1, "click", at(2))],
        [("c", 5, 1, "click", at(61)), ("nobody", 1, 1, "click", at(30))], [("z", 9, 2, "click", at(201))], [("z2", 9, 2, "click", at(401))],
    ]
    events = replay(spark, tmp_path / "events", "search_uuid string, product_id long, position int, action string, ts timestamp", rows)
    got = {}
    for r in collected(state.matched_events(events, logs, "1 HOUR", "10 minutes"), "matched", tmp_path):
        got.setdefault(r.status, []).append((r.search_uuid, r.product_id))
    assert sorted(got["known"]) == [("a", 0), ("a", 1), ("b", 2), ("z", 9), ("z2", 9)]
    # an hour after its search, or never searched: told once the watermark has passed
    assert sorted(got["unknown"]) == [("c", 5), ("nobody", 1)] and len(got["invalid"]) == 4


def test_sign_ins_are_refused_as_in_the_batch_form(spark, tmp_path):
    schema = "id long, ts timestamp, who string, failed boolean"
    minutes = [0, 1, 2, 2, 3, 4, 5, 6, 16, 17, 18, 40, 41, 41, 41, 41, 41, 42, 60]
    rows = [(i, at(m), ["a", "b"][i % 7 == 6], i % 5 != 4) for i, m in enumerate(minutes)]
    batches = [rows[:4], rows[4:9], rows[9:14], rows[14:]]
    want = {(r.id, r.throttled) for r in audit.throttled(spark.createDataFrame(rows, schema), 3, 15).collect()}
    got = collected(state.throttled(replay(spark, tmp_path / "in", schema, batches), 3, 15), "sign_ins", tmp_path)
    assert {(r.id, r.throttled) for r in got} == want and {f for _, f in want} == {True, False}


def test_lifetimes_as_in_the_batch_form(spark, tmp_path):
    schema = "id long, ts timestamp, key string, empty boolean"
    rows = [(i, at(i * 700), f"k{i % 3 // 2}", i % 11 == 0) for i in range(60)]
    batches = [rows[i : i + 13] for i in range(0, 60, 13)]
    want = {(r.id, r.ttl) for r in logs.cache_lifetime(spark.createDataFrame(rows, schema), 5, 3).collect()}
    got = collected(state.cache_lifetime(replay(spark, tmp_path / "in", schema, batches), 5, 3), "lifetimes", tmp_path)
    assert {(r.id, r.ttl) for r in got} == want and {t for _, t in want} == {300, 86400, 7 * 86400}
