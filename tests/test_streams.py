"""The job queue as a stream: shuffled micro-batches, late rows, a stall, a restart, replayed batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexforge.operators import ranks, relational
from lexforge.streaming import logs
from lexforge.streaming import queue as Q
from lexforge.streaming import state

START = datetime(2024, 3, 1)
LOG = "job_id long, id long, status string, max_attempts long, ts timestamp"


def at(seconds):
    return START + timedelta(seconds=seconds)


def machine(rows, as_of, silent_s):
    """Transitions of one job, row by row."""
    out, state, failures, most, ended, heard = [], None, 0, 0, None, None

    def listen(now, strictly):
        nonlocal state
        lost = heard and heard[0] + timedelta(seconds=silent_s)
        if state == "running" and (lost < now if strictly else lost <= now):
            out.append((rows[0][0], lost, heard[1], "running", "queued", failures, True))
            state = "queued"

    for job, i, status, limit, ts in sorted(rows, key=lambda r: (r[4], r[1])):
        if ts > as_of:
            break
        listen(ts, True)
        failures, most = failures + (status == "failed"), max(most, limit)
        ended = ended or (status if status in ("done", "cancelled") else None)
        new = ended or ("queued" if status == "failed" and failures < most else status)
        if new != state:
            out.append((job, ts, i, state, new, failures, False))
        state, heard = new, (ts, i)
    listen(as_of, False)
    return out


def log_rows(seed, jobs=12, n=400, span=20_000):
    rng = random.Random(seed)
    hot = lambda: 0 if rng.random() < 0.34 else rng.randrange(jobs)
    return [(hot(), i, rng.choices(["queued", "running", "failed", "done", "cancelled"], [4, 10, 4, 0.3, 0.2])[0], 3, at(rng.choice([rng.randrange(span), rng.randrange(20) * 500]))) for i in range(n)]


def want(rows, as_of, silent_s):
    jobs = {r[0] for r in rows}
    return sorted((t for j in jobs for t in machine([r for r in rows if r[0] == j], as_of, silent_s)), key=str)


@pytest.mark.parametrize("seed,silent_s", [(1, 300), (2, 2000), (3, 0)])
def test_batch_transitions(spark, seed, silent_s):
    rows = log_rows(seed)
    for as_of in (at(19_000), at(90_000)):
        got = Q.transitions(spark.createDataFrame(rows, LOG), F.lit(as_of), silent_s).collect()
        assert sorted(map(tuple, got), key=str) == want(rows, as_of, silent_s)


def feed(spark, home, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{home}/log")


def drain(spark, home, late, silent_s):
    source = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{home}/log")
    q = Q.transition_stream(source, late, silent_s).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(map(tuple, spark.read.schema(Q.TRANSITION).parquet(f"{home}/out").collect()), key=str)


def test_stream_of_shuffled_batches_with_restarts(spark, tmp_path):
    rows, home = log_rows(4), f"file://{tmp_path}"
    random.Random(0).shuffle(rows)
    for i in range(0, len(rows), 100):  # each part goes through a stream started anew
        feed(spark, home, rows[i : i + 100])
        if i == 200:
            drain(spark, home, "30000 seconds", 300)
    feed(spark, home, [(99, 9999, "queued", 3, at(60_000))])
    assert drain(spark, home, "30000 seconds", 300) == want(rows, at(30_000), 300)


def test_stall_and_late_rows(spark, tmp_path):
    """A worker falls silent while others move time on; a row within the watermark still counts, one behind it does not."""
    home = f"file://{tmp_path}"
    feed(spark, home, [(1, 1, "running", 3, at(0)), (2, 2, "running", 3, at(10))])
    assert drain(spark, home, "100 seconds", 300) == []
    feed(spark, home, [(2, 3, "running", 3, at(250)), (2, 4, "running", 3, at(500))])
    # the watermark is at 400: job 1 was lost at 300, job 2 is still heard
    assert [t[:6] for t in drain(spark, home, "100 seconds", 300)] == [(1, at(0), 1, None, "running", 0), (1, at(300), 1, "running", "queued", 0), (2, at(10), 2, None, "running", 0)]
    feed(spark, home, [(1, 5, "done", 3, at(200)), (1, 6, "done", 3, at(450)), (3, 7, "queued", 3, at(420))])
    feed(spark, home, [(9, 8, "queued", 3, at(5000))])
    got = [t[:6] for t in drain(spark, home, "100 seconds", 300)]
    assert got[2:] and (1, at(450), 6, "queued", "done", 0) in got and (3, at(420), 7, None, "queued", 0) in got and (2, at(800), 4, "running", "queued", 0) in got
    assert not any(t[2] == 5 for t in got)


def test_final_states_equal_the_fold_of_the_log(spark, tmp_path):
    from lexforge.operators.transitions import job_states

    rows, home = log_rows(6), f"file://{tmp_path}"
    feed(spark, home, rows)
    feed(spark, home, [(99, 9999, "queued", 3, at(9_000_000))])
    last = {}
    for job, ts, i, _, state, *_ in sorted(drain(spark, home, "8000000 seconds", 5_000_000), key=lambda t: (t[1], t[2])):
        last[job] = state
    fold = job_states(spark.createDataFrame(rows, LOG).withColumnRenamed("ts", "created_at")).collect()
    assert last == {r.job_id: r.state for r in fold}


def test_each_job_is_given_once_though_a_batch_is_replayed(spark, tmp_path):
    home = f"file://{tmp_path}"
    rng = random.Random(5)
    jobs = [(i, 1 if i < 40 else rng.randrange(3), at(rng.randrange(50)), rng.choice(["queued", "queued", "done"])) for i in range(90)]
    queue = spark.createDataFrame(jobs, "id long, priority long, created_at timestamp, status string")
    order = [j[0] for j in sorted((j for j in jobs if j[3] == "queued"), key=lambda j: (-j[1], j[2], j[0]))]
    polls = [(i, i % 4, at(i // 2)) for i in range(70)]
    handed = []
    for k in (0, 1, 2):
        part = spark.createDataFrame(polls[25 * k : 25 * k + 25], "poll_id long, worker_id long, ts timestamp")
        part.coalesce(1).write.mode("append").parquet(f"{home}/polls")
        source = spark.readStream.schema(part.schema).parquet(f"{home}/polls")
        stream = Q.assign_stream(source, queue, f"{home}/out")
        stream.option("checkpointLocation", f"{home}/cp").trigger(availableNow=True).start().awaitTermination()
        handed.append(part)
    want = [(j, p[1], p[0]) for j, p in zip(order, polls, strict=False)]
    read = lambda: sorted(tuple(r)[:3] for r in Q.assignments(spark, f"{home}/out").collect())
    assert read() == sorted(want)
    # the last batch is forgotten by the checkpoint, as if the driver had died before it was marked done
    last = max(tmp_path.joinpath("cp", "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    for crc in last.parent.glob(f".{last.name}.crc"):
        crc.unlink()
    Q.assign_stream(spark.readStream.schema(handed[0].schema).parquet(f"{home}/polls"), queue, f"{home}/out").option("checkpointLocation", f"{home}/cp").trigger(availableNow=True).start().awaitTermination()
    assert read() == sorted(want)


def test_places_are_dealt_by_ranges(spark):
    """One priority for all: no range holds more than twice the mean, places are those of a sort."""
    jobs = spark.range(0, 20_000).selectExpr("id", "'queued' as status", "5 as priority", "timestamp_seconds(id % 7) as created_at").repartition(8)
    got = {r.id: r.place for r in relational.queue_order(jobs, "priority").collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(20_000), key=lambda i: (i % 7, i)) and set(got.values()) == set(range(1, 20_001))
    sizes = []
    kept, ranks.stored = ranks.stored, lambda df, name: sizes.append(df) or kept(df, name)
    try:
        relational.queue_order(jobs, "priority")
    finally:
        ranks.stored = kept
    counts = [r["count"] for r in sizes[0].groupBy("part").count().collect()]
    assert len(counts) == 4 and max(counts) <= 2 * 20_000 / 4


def test_places_of_nothing_and_of_equal_rows(spark):
    assert ranks.placed(spark.createDataFrame([], "a long"), [F.col("a")]).count() == 0
    same = spark.createDataFrame([(1, "x")] * 5 + [(0, None)], "part long, place string")
    assert sorted((r.part, r.n) for r in ranks.placed(same, [F.col("part")], "n").collect()) == [(0, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6)]


# ---- rate limit, windows, crash loops ----------------------------------------------
def limited(rows, window, most):
    """rows of (id, key, second)."""
    out, held = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        live = [x for x in held.get(k, []) if t - x < window]
        out[i] = len(live) <= most
        held[k] = live + [t] * out[i]
    return out


def hit_rows(seed, n=300):
    rng = random.Random(seed)
    return [(i, 0 if rng.random() < 0.5 else rng.choice([1, 2, 3]), rng.choice([rng.randrange(3000), rng.randrange(40), 2000])) for i in range(n)]


def hits_of(spark, rows):
    return spark.createDataFrame([(i, k, at(t)) for i, k, t in rows], "id long, key long, ts timestamp")


@pytest.mark.parametrize("window,most", [(60, 2), (7, 0), (500, 9)])
def test_rate_limit_by_runs(spark, window, most):
    for rows in (hit_rows(window), [(i, 7, i % 100) for i in range(200)], []):
        got = {r.id: r.accepted for r in state.rate_limit(hits_of(spark, rows), window, most).collect()}
        assert got == limited(rows, window, most)


def limit_run(spark, home, window, most, late):
    source = spark.readStream.schema("id long, key long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{home}/hits")
    state.rate_limit_stream(source, window, most, late).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/cp").trigger(availableNow=True).start().awaitTermination()
    return {r.id: r.accepted for r in spark.read.schema(state.LIMITED).parquet(f"{home}/out").collect()}


def test_rate_limit_stream(spark, tmp_path):
    """Shuffled micro-batches, a restart, and a stall longer than two windows of the clock before hits that are close in event time."""
    home, rows = f"file://{tmp_path}", hit_rows(8)
    random.Random(1).shuffle(rows)
    for part in (rows[:150], rows[150:]):
        hits_of(spark, part).coalesce(1).write.mode("append").parquet(f"{home}/hits")
        assert limit_run(spark, home, 60, 2, "4000 seconds") == {}
    hits_of(spark, [(9999, 9, 9000)]).coalesce(1).write.mode("append").parquet(f"{home}/hits")
    assert limit_run(spark, home, 60, 2, "4000 seconds") == limited(rows, 60, 2)


def test_rate_limit_stream_keeps_what_a_later_batch_needs(spark, tmp_path):
    home = f"file://{tmp_path}"
    steps = [[(1, 1, 0), (2, 1, 0)], [(3, 2, 30)], [(4, 1, 40), (5, 1, 65), (6, 1, 66)], [(7, 3, 500)]]
    for part in steps:
        hits_of(spark, part).coalesce(1).write.mode("append").parquet(f"{home}/hits")
        got = limit_run(spark, home, 60, 1, "1 second")
    assert got == {1: True, 2: True, 3: True, 4: False, 5: True, 6: True}


def test_windowed_counts_stream(spark, tmp_path):
    rows = hit_rows(2)
    hits_of(spark, rows).write.parquet(f"file://{tmp_path}/in")
    events = spark.readStream.schema("id long, key long, ts timestamp").parquet(f"file://{tmp_path}/in").withColumn("event_type", F.lit("view"))
    q = state.windowed_counts(events, "1 minute").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.start: r.n for r in spark.table("counted").collect()} == {at(60 * m): sum(t // 60 == m for *_, t in rows) for m in {t // 60 for *_, t in rows}}


def test_crash_loops(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(6), rng.randrange(4000)) for _ in range(120)] + [(9, 5)] + [(8, 60 * i) for i in range(4)]
    want = {}
    for w in {w for w, _ in rows}:
        times, best, run, last = sorted(t for v, t in rows if v == w), 0, 0, None
        for t in times:
            run = 1 if last is None or t - last > 60 else run + 1
            best, last = max(best, run), t
        want[w] = (len(times), best, best >= 5)
    got = state.crash_loops(spark.createDataFrame([(w, at(t)) for w, t in rows], "worker_id long, ts timestamp"), 5, 60)
    assert {r.worker_id: (r.n, r.longest, r.looped) for r in got.collect()} == want
    assert state.crash_loops(spark.createDataFrame([], "worker_id long, ts timestamp")).count() == 0


# ---- logs ---------------------------------------------------------------------------
def test_log_lines_are_stored_once(spark, tmp_path):
    """Malformed lines kept aside, a file that comes later, and a batch that runs again."""
    schema = "ts string, ok boolean, elapsed_s double, error string"
    good = ['{"ts": "1", "ok": true, "elapsed_s": 1.25, "error": "' + "e" * 300 + '"}', '{"ts": "2", "more": 3}']
    bad = ["not json", '{"ts": "3", "ok": tr', '{"ts": "4", "elapsed_s": "soon"}', "[1]", "3", "null"]
    log = tmp_path / "log"
    log.mkdir()

    def drain_log():
        lines = logs.telemetry(logs.log_lines(spark, f"file://{log}", schema, maxFilesPerTrigger=1))
        logs.store_log(lines, f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        rows, rescued = logs.stored_log(spark, f"file://{tmp_path}/out", schema)
        return sorted((r.ts, r.ok, r.elapsed_s, len(r.error or "")) for r in rows.collect()), sorted(r.rescued for r in rescued.collect())

    (log / "a.jsonl").write_text("\n".join([good[0], "", "  ", *bad[:3]]) + "\n")
    assert drain_log() == ([("1", True, 1.3, 100)], sorted(bad[:3]))
    (log / "b.jsonl").write_text("\n".join([*bad[3:], good[1]]))
    want = ([("1", True, 1.3, 100), ("2", None, None, 0)], sorted(bad))
    assert drain_log() == want
    last = max(tmp_path.joinpath("cp", "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    for crc in last.parent.glob(f".{last.name}.crc"):
        crc.unlink()
    assert drain_log() == want


def test_rate_limit_folds_many_runs_in_a_task(spark):
    plan = state.rate_limit(hits_of(spark, [(1, 1, 5)]), 60, 2)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_keys_share_a_bucket_of_state(spark, tmp_path):
    rows, home = log_rows(8), f"file://{tmp_path}"
    feed(spark, home, rows)
    feed(spark, home, [(99, 9999, "queued", 3, at(60_000))])
    source = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{home}/log")
    Q.transition_stream(source, "30000 seconds", 300, buckets=2).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.schema(Q.TRANSITION).parquet(f"{home}/out").collect()), key=str) == want(rows, at(30_000), 300)
