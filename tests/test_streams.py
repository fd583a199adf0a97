"""Streams give the batch result: across restarts, and for rows out of order within the watermark."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowwarden import schemas
from flowwarden.operators import alerts as A
from flowwarden.operators import detectors, flows
from flowwarden.operators.sequences import complete, host_sequences
from flowwarden.session import work_dir
from flowwarden.sources import store, tables
from flowwarden.streaming import jobs
from flowwarden.streaming.pieces import KEY, SUMS, FlowPieces
from flowwarden.streaming.state import AlertChain, dispositions_stream, host_sequences_stream

EPOCH = dt.datetime(2024, 1, 1)


def at(s):
    return EPOCH + dt.timedelta(seconds=s)


def alert_rows(spark, rows):
    data = [(i, at(s), "network", "low", 0.0, "", "unknown", "", ip, "8.8.8.8", port, None, "", "open", "{}") for i, s, ip, port in rows]
    return spark.createDataFrame(data, schemas.RAW_ALERTS)


def run(stream, out, checkpoint):
    q = jobs.start(stream, checkpoint, lambda b, e: b.write.mode("overwrite").parquet(f"{out}/epoch={e}"), every=None)
    q.awaitTermination()


def sample(seed, n=400, span=1500):
    rnd = random.Random(seed)
    rows = sorted((rnd.randint(0, span), f"a{i:04}", rnd.choice(["1.1.1.1", "1.1.1.1", "2.2.2.2"]), rnd.randint(1, 12)) for i in range(n))
    return [(i, s, ip, port) for s, i, ip, port in rows]


def read_stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_alert_chain_survives_a_restart_and_disorder(spark):
    rows = sample(2, span=1100)
    src, out, state = (work_dir(spark, n) for n in ("in", "out", "state"))

    def add(some):
        alert_rows(spark, some).coalesce(1).write.mode("append").parquet(src)

    def go():
        run(dispositions_stream(read_stream(spark, src, schemas.RAW_ALERTS)), out, state)

    half = len(rows) // 2
    # the two quarters come in the wrong order, less than the watermark of ten minutes apart
    add(rows[half // 2 : half])
    add(rows[: half // 2])
    go()
    add(rows[half:])
    add([("flush", 200_000, "flush", 1)])
    go()
    got = spark.read.parquet(f"{out}/epoch=*").filter("alert_id <> 'flush'")
    a = alert_rows(spark, rows)
    want = A.dispositions(a).join(A.hit_count(A.kept_alerts(a)).select("alert_id", "hit_count"), "alert_id", "left")
    cols = ["alert_id", "disposition", F.coalesce("hit_count", F.lit(0)).alias("h")]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(tuple(r) for r in want.select(*cols).collect())


class Held:
    """State of one key in plain dicts, that tells which buckets were read."""

    def __init__(self):
        self.maps, self.values, self.timers, self.read = {}, {}, [], []

    def registerTimer(self, ms):
        self.timers.append(ms)

    def getMapState(self, name, *_):
        held, read = self.maps.setdefault(name, {}), self.read

        class Map:
            containsKey = staticmethod(lambda k: k in held)
            updateValue = staticmethod(lambda k, v: held.__setitem__(k, v))
            removeKey = staticmethod(lambda k: held.pop(k))
            iterator = staticmethod(lambda: iter(list(held.items())))

            @staticmethod
            def getValue(k):
                if name == "pending":
                    read.append(k[0])
                return held[k]

        return Map

    def getValueState(self, name, *_):
        values = self.values

        class Value:
            exists = staticmethod(lambda: name in values)
            get = staticmethod(lambda: values[name])
            update = staticmethod(lambda v: values.__setitem__(name, v))
            clear = staticmethod(lambda: values.pop(name, None))

        return Value


def test_a_timer_reads_its_own_bucket_alone():
    held, second = Held(), 1_000_000
    chain = AlertChain(60 * second, 10, 60 * second, 3600 * second)
    chain.init(held)
    rows = pd.DataFrame([(t * second, f"a{t}", "k", "{}") for t in (3, 1, 12, 300, 301, 9999)], columns=chain.pending_columns)

    class Now:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    list(chain.handleInputRows(("s",), iter([rows]), Now))
    assert sorted(held.timers) == [10_000, 20_000, 310_000, 10_000_000] and held.read == []

    class Due:
        def __init__(self, ms):
            self.getExpiryTimeInMs = lambda: ms

    out = [pdf for ms in (10_000, 20_000) for pdf in chain.handleExpiredTimer(("s",), None, Due(ms))]
    assert held.read == [0, 1]  # neither the bucket of 300 s nor that of 9999 s
    assert [tuple(r) for pdf in out for r in pdf[["alert_id", "disposition"]].itertuples(index=False)] == [
        ("a1", "kept"), ("a3", "deduped"), ("a12", "deduped")]
    assert sorted(k[0] for k in held.maps["pending"]) == [30, 999]
    assert list(chain.handleExpiredTimer(("s",), None, Due(61_001))) == [] and held.maps["seen"] == {}  # a wake-up call


def test_state_is_touched_by_run_and_not_by_row():
    """Rows in 3,000 buckets: few timers, and the first one of a micro-batch takes all that the watermark has passed."""
    held, second = Held(), 1_000_000
    chain = AlertChain(60 * second, 10, 60 * second, 3600 * second)
    chain.init(held)
    rnd = random.Random(3)
    rows = [(t * 10 * second, f"a{t:04}", f"k{t % 4}", "{}") for t in range(1, 3001)]
    mixed = rnd.sample(rows, len(rows))

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    class Due:
        def __init__(self, ms):
            self.getExpiryTimeInMs = lambda: ms

    frames = [pd.DataFrame(mixed[i : i + 1500], columns=chain.pending_columns) for i in (0, 1500)]
    assert list(chain.handleInputRows(("s",), iter(frames), Now(0))) == []
    assert len(held.timers) < 10
    got = []
    for watermark in (14_999_000, 30_010_000):
        for ms in sorted(t for t in held.timers if t <= watermark):
            got += [tuple(r) for pdf in chain.handleExpiredTimer(("s",), Now(watermark), Due(ms))
                    for r in pdf[["us", "alert_id", "disposition"]].itertuples(index=False)]
        assert len(got) == min(watermark // 10_000 - 1, 3000)
    assert len(held.read) < 20 and held.maps["pending"] == {}
    # a key comes again after 40 s, within its 60 s
    assert got == [(us, i, "deduped" if (n // 4) % 2 else "kept") for n, (us, i, _, _) in enumerate(rows)]


def test_rows_behind_the_watermark_come_out_as_late(spark):
    src, out, state = (work_dir(spark, n) for n in ("in", "out", "state"))
    # "c" and "f" lie behind the watermark, "d" is out of order within it; "g" would be a copy of "a" were it in time
    for some in ([("a", 0, "1.1.1.1", 1)], [("b", 5000, "1.1.1.1", 1)],
                 [("c", 10, "1.1.1.1", 2), ("d", 4500, "1.1.1.1", 2), ("g", 1, "1.1.1.1", 1)], [("f", 4399, "9.9.9.9", 1)], [("flush", 200_000, "flush", 1)]):
        alert_rows(spark, some).coalesce(1).write.mode("append").parquet(src)
    run(dispositions_stream(read_stream(spark, src, schemas.RAW_ALERTS)), out, state)
    got = sorted((r.alert_id, r.disposition, r.hit_count, r.ts) for r in spark.read.parquet(f"{out}/epoch=*").collect())
    assert [g for g in got if g[0] != "flush"] == [
        ("a", "kept", 1, at(0)), ("b", "kept", 2, at(5000)), ("c", "late", None, at(10)), ("d", "kept", 1, at(4500)),
        ("f", "late", None, at(4399)), ("g", "late", None, at(1))]


def test_late_alerts_are_stored_aside(spark):
    alerts, counts, late = (work_dir(spark, n) for n in ("alerts", "counts", "late"))
    rows = alert_rows(spark, [("a", 0, "1.1.1.1", 1), ("b", 1, "1.1.1.1", 2)])
    batch = rows.withColumns({"dedup_key": A.dedup_key(), "disposition": F.when(F.col("alert_id") == "a", "kept").otherwise("late"),
                              "hit_count": F.when(F.col("alert_id") == "a", 1)})
    each = jobs.store_alert_chain(alerts, counts, late_path=late)
    for _ in range(2):
        each(batch, 0)
    assert [r._id for r in store.read(spark, alerts).collect()] == ["a"]
    assert [(r._id, r.ts) for r in store.read(spark, late).collect()] == [("b", at(1))]
    assert jobs.counters(spark, counts).first().asDict() == {"received": 2, "deduped": 0, "rate_limited": 0, "kept": 1, "late": 1, "escalated": 0}


def test_a_hot_session_is_added_up_before_it_is_shuffled(spark):
    """Both directions of one busy 5-tuple: the batch's flows, and sessions merged ahead of the shuffle."""
    rnd = random.Random(1)
    ends = [("10.0.0.1", "8.8.8.8", 50000, 443), ("8.8.8.8", "10.0.0.1", 443, 50000)]
    rows = [(at(rnd.randint(0, 30_000) / 100), *ends[rnd.random() < 0.4], 6, 2, 100) for _ in range(3000)]
    rows += [(at(1000), *ends[1], 6, 16, 7), (at(1001), *ends[0], 6, 16, 9)]
    df = spark.createDataFrame(rows, schemas.PACKETS)
    src, out, state = (work_dir(spark, n) for n in ("in", "out", "state"))
    df.repartition(4).write.parquet(src)
    spark.createDataFrame([(at(200_000), "flush", "flush", 1, 1, 6, 2, 1)], schemas.PACKETS).write.mode("append").parquet(src)
    stream = flows.build_flows_stream(flows.normalise_packets(spark.readStream.schema(schemas.PACKETS).parquet(src)), bidirectional=True)
    q = jobs.start(stream, state, lambda b, e: b.write.mode("overwrite").parquet(f"{out}/epoch={e}"), every=None)
    q.awaitTermination()
    below = q._jsq.explainInternal(False).split("Exchange", 1)[1]
    assert "MergingSessions" in below
    cols = ["flow_id", *flows.FLOW_KEY, "bytes_sent", "bytes_recv", "packets_total", "duration_ms"]
    got = spark.read.parquet(f"{out}/epoch=*").filter("src_ip <> 'flush'").select(*cols)
    want = flows.build_flows(flows.normalise_packets(df), bidirectional=True).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.filter("src_ip = '8.8.8.8' AND bytes_sent = 7 AND bytes_recv = 9").count() == 1


@pytest.mark.parametrize("bidirectional", [False, True])
def test_flows_are_kept_by_block_of_time_and_joined_over_its_ends(spark, bidirectional):
    """Blocks of 21 s: short flows, some over an end, one over many, over micro-batches and a restart; sizes and addresses missing."""
    rnd = random.Random(4)
    ends = [("10.0.0.1", "8.8.8.8", 50000, 443), ("8.8.8.8", "10.0.0.1", 443, 50000), ("10.0.0.2", None, 1, 2)]
    rows = [(at(rnd.uniform(0, 4000)), *rnd.choice(ends), 6, rnd.choice([2, 16]), rnd.choice([None, 100, 200])) for _ in range(1500)]
    rows += [(at(3 * i + 0.5), "10.0.0.3", "8.8.8.8", 7, 8, 6, 2, 10) for i in range(600)]
    # the last instant and the first of a block, pauses of just the idle time and of a microsecond more
    rows += [(at(s), "10.0.0.4", "8.8.8.8", 7, 8, 6, 2, None) for s in (20.999999, 21, 41, 48, 55.000001, 63, 83.999999, 91, 98.000001, 1000)]
    rows.sort(key=lambda r: r[0])
    src, out, state = (work_dir(spark, n) for n in ("in", "out", "state"))

    def go():
        packets = flows.normalise_packets(read_stream(spark, src, schemas.PACKETS))
        stream = flows.build_flows_stream(packets, 7, bidirectional=bidirectional, block_cells=3)
        q = jobs.start(stream, state, lambda b, e: b.write.mode("overwrite").parquet(f"{out}/epoch={e}"), every=None)
        q.awaitTermination()
        return q

    parts = [rows[i : i + 600] for i in range(0, len(rows), 600)]
    for some in (parts[0], parts[1], None, parts[2], parts[3], [(at(200_000), "flush", "flush", 1, 1, 6, 2, 1)], None):
        if some is None:
            q = go()
        else:
            spark.createDataFrame(rnd.sample(some, len(some)), schemas.PACKETS).coalesce(1).write.mode("append").parquet(src)
    # a store's key, whose sessions are compared with each other, is one block's
    restore = [x for x in q._jsq.explainInternal(True).splitlines() if "SessionWindowStateStoreRestore" in x]
    assert restore and all("_block" in x for x in restore)
    cols = ["flow_id", *flows.FLOW_KEY, "bytes_sent", "bytes_recv", "packets_sent", "packets_total", "duration_ms", F.array_join("tcp_flags", ",")]
    got = spark.read.parquet(f"{out}/epoch=*").filter("src_ip <> 'flush'").select(*cols)
    want = flows.build_flows(flows.normalise_packets(spark.createDataFrame(rows, schemas.PACKETS)), 7, bidirectional).select(*cols)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.filter("src_ip = '10.0.0.3' AND packets_total = 600").count() == 1
    assert got.filter("bytes_sent IS NULL").count() > 0


def test_at_most_one_row_a_5_tuple_waits_for_the_next_block():
    held, second = Held(), 1_000_000
    p = FlowPieces(60 * second, 600 * second)
    p.init(held)

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    def piece(a, b, src="a"):
        return (src, None, 1, 2, "TCP", a * second, b * second, 5, 0, 1, 0, 2, 2 * a * second, True)

    def given(pieces, ms):
        return [r for pdf in p.handleInputRows((0,), iter([pd.DataFrame(pieces, columns=KEY + SUMS)]), Now(ms)) for r in pdf.itertuples(index=False, name=None)]

    # within a block: out at once, and no state
    assert given([piece(100, 200), piece(270, 500)], 560_000) == [piece(100, 200), piece(270, 500)] and held.values == {}
    # up to the end of a block: waits; the next one's first piece is part of it
    assert given([piece(550, 595)], 700_000) == [] and held.timers == [1_260_000]
    assert given([piece(610, 700), piece(1190, 1199), piece(1190, 1199, "b")], 1_259_000) == [
        (*piece(550, 700)[:7], 10, 0, 2, 0, 2, 2 * 550 * second, True)]
    assert sorted(held.timers) == [1_260_000, 1_860_000, 1_860_000]
    assert list(p.handleExpiredTimer((0,), Now(1_859_999), Now(1_260_000))) == []
    assert [len(pdf) for pdf in p.handleExpiredTimer((0,), Now(1_860_000), Now(1_860_000))] == [2] and held.values == {}


def test_host_sequences(spark):
    rnd = random.Random(9)
    rows = sorted((rnd.randint(0, 900), f"u{i:04}", rnd.choice(["h1", "h1", "h2"])) for i in range(120))
    df = spark.createDataFrame([(u, at(s), h, [float(i)] * 8) for i, (s, u, h) in enumerate(rows)],
                               "event_uid string, ts timestamp, computer string, features array<float>")
    src, out, state = (work_dir(spark, n) for n in ("in", "out", "state"))
    for part in ("ts < '2024-01-01 00:07:00'", "ts >= '2024-01-01 00:07:00'"):
        df.filter(part).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([("z", at(200_000), "flush", [0.0] * 8)], df.schema).write.mode("append").parquet(src)
    run(host_sequences_stream(read_stream(spark, src, df.schema)), out, state)

    def flat(d):
        return {r.event_uid: [v[0] for v in r.seq] for r in complete(d).collect()}

    assert flat(spark.read.parquet(f"{out}/epoch=*")) == flat(host_sequences(df))


def test_json_stream_skips_what_it_cannot_read(spark):
    src, out, state = (work_dir(spark, n) for n in ("in", "out", "state"))
    rows = ['{"alert_id":"a","@timestamp":"2024-01-01T00:00:05Z"}', '{"alert_id"', '{"alert_id":"b"}']
    spark.createDataFrame([(r,) for r in rows], "value string").write.text(src)
    run(tables.read_json_stream(spark, schemas.ACTIONS, "text", path=src), out, state)
    assert {(r.alert_id, r.ts) for r in spark.read.parquet(f"{out}/epoch=*").collect()} == {("a", at(5)), ("b", None)}


def test_a_repeated_batch_is_written_once(spark):
    events, alerts = work_dir(spark, "events"), work_dir(spark, "alerts")
    batch = spark.createDataFrame([("f1", at(0), True, "high", 9.0, "a", "b", 80, "TCP"), ("f2", at(1), False, "none", 0.1, "a", "b", 80, "TCP")],
                                  "flow_id string, ts timestamp, is_anomaly boolean, severity string, anomaly_score double, src_ip string, dst_ip string, dst_port int, protocol string")
    each = jobs.store_and_alert("network", events, alerts)
    each(batch, 3)
    each(batch, 3)
    assert store.read(spark, events).count() == 2
    assert spark.read.schema("key string, value string").json(f"{alerts}/epoch=*").count() == 1


def test_observed_counters(spark):
    df, o = jobs.observed(spark.createDataFrame([(True,), (False,), (False,)], "is_anomaly boolean"))
    df.collect()
    assert o.get == {"processed": 3, "anomalies": 1}


def test_ports_of_a_stream_are_counted_in_bitmaps(spark):
    rows = [("a", "b", at(i % 60), p, ["SYN"]) for i, p in enumerate([0, 1, 32767, 32768, 65535, 65535, None, -1, 65536])]
    rows += [("flush", "b", at(200_000), 1, ["SYN"])]
    src, out, state = (work_dir(spark, n) for n in ("in", "out", "state"))
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, ts timestamp, dst_port int, tcp_flags array<string>")
    df.filter("src_ip = 'a'").coalesce(1).write.parquet(src)
    df.filter("src_ip = 'flush'").coalesce(1).write.mode("append").parquet(src)
    run(detectors.port_scan_stream(read_stream(spark, src, df.schema), min_ports=2), out, state)
    assert [(r.src_ip, r.ports, r.flows) for r in spark.read.parquet(f"{out}/epoch=*").collect()] == [("a", 5, 9)]


def test_counters_add_up_over_a_restart_and_a_repeated_batch(spark):
    rows = sample(5, n=200)
    src, state, alerts, counts = (work_dir(spark, n) for n in ("in", "state", "alerts", "counts"))
    each = jobs.store_alert_chain(alerts, counts)

    def twice(batch, epoch):
        for _ in range(2):
            each(batch, epoch)

    for some in (rows[:100], [*rows[100:], ("flush", 200_000, "flush", 1)]):
        alert_rows(spark, some).coalesce(1).write.mode("append").parquet(src)
        stream = dispositions_stream(read_stream(spark, src, schemas.RAW_ALERTS)).filter("alert_id <> 'flush'")
        jobs.start(stream, state, twice, every=None).awaitTermination()
    got = jobs.counters(spark, counts).first().asDict()
    a = alert_rows(spark, rows)
    want = {r["disposition"]: r["cnt"] for r in A.disposition_counts(A.dispositions(a)).collect()}
    done = A.process_alerts(a)
    assert got == {"received": 200, "escalated": done.filter("was_escalated").count(), **{k: want.get(k, 0) for k in ("deduped", "rate_limited", "kept", "late")}}
    assert store.read(spark, alerts).count() == want["kept"]


def test_state_of_a_port_scan_follows_the_ports_tried(spark):
    """300 pairs with two ports each: few bytes a pair, and no ports beyond the window's are counted."""
    rows = [(f"s{i}", "b", at(i % 60), p, ["SYN"]) for i in range(300) for p in (63, 64, 64)]
    src, out, state = (work_dir(spark, n) for n in ("in", "out", "state"))
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, ts timestamp, dst_port int, tcp_flags array<string>")
    df.coalesce(1).write.parquet(src)
    end = spark.createDataFrame([("flush", "b", at(200_000), 1, ["SYN"])], df.schema)
    end.coalesce(1).write.mode("append").parquet(src)
    stream = detectors.port_scan_stream(read_stream(spark, src, df.schema), min_ports=2)
    q = jobs.start(stream, state, lambda b, e: b.write.mode("overwrite").parquet(f"{out}/epoch={e}"), every=None)
    q.awaitTermination()
    got = spark.read.parquet(f"{out}/epoch=*").collect()
    assert sorted((r.src_ip, r.ports, r.flows) for r in got) == sorted((f"s{i}", 2, 3) for i in range(300))
    plan = q._jsq.explainInternal(False)
    assert "bitmap_construct_agg" not in plan and "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
