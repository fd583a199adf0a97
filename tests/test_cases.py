"""Small cases with known answers."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowwarden import lookups as L
from flowwarden import schemas
from flowwarden.functions import columns as C
from flowwarden.operators import alerts as A
from flowwarden.operators import detectors, features, flows, lookup_joins, search, stats
from flowwarden.operators import anchors
from flowwarden.operators.anchors import open_windows, run_steps
from flowwarden.operators.quantiles import exact_quantiles
from flowwarden.operators.scoring import DEFAULT_THRESHOLD, Model, error_profile, fit_reconstruction, load_model, save_model, score, sequence_score
from flowwarden.operators.sequences import complete, dealt, host_sequences
from flowwarden.plans import jobs
from flowwarden.session import stage, staging, work_dir
from flowwarden.sources import store, tables
from flowwarden.sources.event_xml import parse_event_xml, read_event_xml

EPOCH = dt.datetime(2024, 1, 1)


def at(seconds):
    return EPOCH + dt.timedelta(seconds=seconds)


# --- flows ---------------------------------------------------------------------------------------


def packets(spark, rows):
    """rows: (seconds, src_ip, dst_ip, src_port, dst_port, proto, flags, size)"""
    return spark.createDataFrame([(at(r[0]), *r[1:]) for r in rows], schemas.PACKETS)


def test_idle_split(spark):
    key = ("10.0.0.1", "8.8.8.8", 50000, 443, 6)
    p = packets(spark, [(0, *key, 2, 100), (60, *key, 16, 50), (121, *key, 1, 70)])
    got = [tuple(r) for r in jobs.packets_to_flows(p).orderBy("ts").select(
        "packets_total", "bytes_sent", "duration_ms", "bytes_per_sec", F.array_join("tcp_flags", ",")).collect()]
    assert got == [(2, 150, 60000.0, 2.5, "ACK,SYN"), (1, 70, 0.0, 70000.0, "FIN")]


def test_flow_cells_do_not_split_a_flow(spark):
    key = ("10.0.0.1", "8.8.8.8", 50000, 443, 6)
    p = packets(spark, [(t, *key, 2, 1) for t in range(0, 6000, 59)])
    f = jobs.packets_to_flows(p).collect()
    assert len(f) == 1 and f[0].packets_total == len(range(0, 6000, 59))


def test_non_ip_and_portless_packets(spark):
    p = packets(spark, [
        (0, None, None, None, None, None, None, 60),
        (0, "a", "b", None, None, 1, 63, 10),
        (0, "a", "b", 9, 9, 89, 63, 10),
        (0, "a", "b", 9, 53, 17, 63, 10),
    ])
    n = flows.normalise_packets(p)
    got = {(r.protocol, r.src_port, r.dst_port, r.flag_bits) for r in n.collect()}
    assert got == {("ICMP", 0, 0, 0), ("OTHER", 0, 0, 0), ("UDP", 9, 53, 0)}
    assert tuple(flows.packet_counts(p).first()) == (4, 3, 1)


def test_bidirectional_flow_starts_with_its_first_packet(spark):
    p = packets(spark, [(0, "z", "a", 5000, 80, 6, 2, 100), (1, "a", "z", 80, 5000, 6, 18, 900), (2, "z", "a", 5000, 80, 6, 16, 10)])
    f = jobs.packets_to_flows(p, bidirectional=True).collect()
    assert len(f) == 1
    assert (f[0].src_ip, f[0].dst_port, f[0].bytes_sent, f[0].bytes_recv, f[0].packets_sent, f[0].packets_recv) == ("z", 80, 110, 900, 2, 1)


def test_flows_keep_all_packets_and_bytes(spark):
    rnd = random.Random(3)
    rows = [(rnd.uniform(0, 5000), f"10.0.0.{rnd.choice([1, 1, 1, 2, 3])}", "8.8.8.8", 1, 443, 6, 2, rnd.randint(1, 1500)) for _ in range(3000)]
    p = packets(spark, rows)
    f = jobs.packets_to_flows(p, idle_s=7)
    total = f.agg(F.sum("packets_total"), F.sum("bytes_total")).first()
    assert tuple(total) == (3000, sum(r[-1] for r in rows))
    want = 0
    for ip in {r[1] for r in rows}:
        ts = sorted(r[0] for r in rows if r[1] == ip)
        want += 1 + sum(b - a > 7 for a, b in zip(ts, ts[1:]))
    assert f.count() == want
    assert flows.build_flows_stream(flows.normalise_packets(p), 7).select("flow_id").exceptAll(f.select("flow_id")).count() == 0


@pytest.mark.parametrize("bits,names", [(0, ""), (2, "SYN"), (63, "FIN,SYN,RST,PSH,ACK,URG"), (64 + 4, "RST")])
def test_flag_names(spark, bits, names):
    assert spark.range(1).select(F.array_join(C.decode_flags(F.lit(bits)), ",")).first()[0] == names


# --- windows that open at the first event ---------------------------------------------------------


def greedy(times, width):
    out, opener = [], None
    for t in times:
        if opener is None or t >= opener + width:
            opener = t
        out.append(opener)
    return out


def test_run_steps_agree_with_a_walk():
    rnd = random.Random(1)
    for _ in range(200):
        width = rnd.choice([5, 10, 60])
        start = 600 * rnd.randint(0, 3)
        times = np.array(sorted(rnd.sample(range(start, start + 600), rnd.randint(1, 300))))
        enter, leave = run_steps(times, start, width)
        for opener in range(start - 2 * width, start):
            j = np.searchsorted(enter, opener + width)
            got = int(leave[j]) if j < len(enter) else opener
            want = greedy([opener, *times], width)[-1]
            assert got == want


def alert_rows(spark, rows):
    """rows: (id, seconds, src_ip, dst_port, severity)"""
    data = [(i, at(s), "network", sev, 0.0, "", "unknown", "", ip, "8.8.8.8", port, None, "", "open", "{}") for i, s, ip, port, sev in rows]
    return spark.createDataFrame(data, schemas.RAW_ALERTS)


def test_ttl_dedup(spark):
    a = alert_rows(spark, [(f"a{i}", s, "1.1.1.1", 80, "low") for i, s in enumerate([0, 10, 59, 60, 100, 119, 120, 121])])
    assert sorted(int((r.ts - EPOCH).total_seconds()) for r in A.dedup(a).collect()) == [0, 60, 120]


def test_ties_go_by_id(spark):
    a = alert_rows(spark, [("b", 0, "1.1.1.1", 80, "low"), ("a", 0, "1.1.1.1", 80, "low"), ("c", 60, "1.1.1.1", 80, "low"), ("d", 60, "1.1.1.1", 80, "low")])
    assert sorted(r.alert_id for r in A.dedup(a).collect()) == ["a", "c"]


def test_step_tables_put_together_agree_with_a_walk():
    rnd = random.Random(2)
    for _ in range(200):
        width = rnd.choice([5, 10, 60])
        times = sorted(rnd.sample(range(0, 900), rnd.randint(6, 300)))
        cuts = sorted(rnd.sample(range(1, len(times)), rnd.randint(1, 5)))
        runs = [np.array(times[i:j]) for i, j in zip([0, *cuts], [*cuts, len(times)])]
        whole = run_steps(runs[0], times[0], width)
        for r in runs[1:]:
            whole = anchors.composed(whole, run_steps(r, int(r[0]), width), times[0], width)
        assert len(whole[0]) <= len(times) and (np.diff(whole[0]) > 0).all()
        for opener in [*range(times[0] - 2 * width, times[0]), -(2**62)]:
            assert anchors.stepped(opener, *whole, width) == greedy([opener, *times], width)[-1]


def test_a_busy_key_is_cut_into_bounded_runs_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        times = spark.range(30_000).selectExpr("'hot' AS _key", "id * 1000 AS _us", "id AS _first").repartition(5)
        rows = times.repartitionByRange("_key", "_us").sortWithinPartitions("_key", "_us").mapInArrow(anchors._cut(60_000_000, 500), anchors._TIMES)
        runs = rows.groupBy("_part", "_run").agg(F.count("*").alias("n"), F.count("enter").alias("tables"), F.max(F.size("enter")).alias("size")).collect()
        assert len({r["_part"] for r in runs}) == 8 and max(r["n"] for r in runs) == 500
        assert all(r["tables"] == 1 and r["size"] <= 500 for r in runs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("run_times", [5, 97, 100_000])
def test_one_busy_key_never_pausing(spark, run_times):
    """A key without any pause, times down to the microsecond: runs of every size agree with a walk."""
    rnd = random.Random(run_times)
    times = sorted({round(rnd.uniform(0, 5000), 6) for _ in range(4000)})
    hot = [("hot", t) for t in times]
    cold = [("cold", float(t)) for t in range(0, 5000, 61)]
    df = spark.createDataFrame([(k, at(t), f"{k}{i}") for i, (k, t) in enumerate(hot + cold)], "k string, ts timestamp, alert_id string")
    out = open_windows(df, "k", 60, run_times=run_times, opener="opens").select("k", C.micros(F.col("ts")).alias("us"), "opened_us", "opens")
    got = sorted(tuple(r) for r in out.collect())
    want = []
    for k, ts in (("hot", times), ("cold", [t for _, t in cold])):
        us = [int((at(t) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)) for t in ts]
        for t, o in zip(us, greedy(us, 60_000_000)):
            want.append((k, t, o, t == o))
    assert got == sorted(want)


def test_keys_that_pause_are_marked_where_they_lie(spark, monkeypatch):
    """Only rows ahead of a task's first pause, and one time a task, go through the steps; all agree with a walk."""
    rnd = random.Random(7)
    rows = [(f"k{rnd.randint(0, 3)}", 200 * rnd.randint(0, 300) + rnd.randint(0, 90)) for _ in range(5000)]
    df = spark.createDataFrame([(k, at(t), f"{i:05}") for i, (k, t) in enumerate(rows)], "k string, ts timestamp, alert_id string").repartition(7)
    seen, steps = [], anchors.opening_times
    monkeypatch.setattr(anchors, "opening_times", lambda times, *a: seen.append(times.count()) or steps(times, *a))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.alert_id: (r.opened_us // 1_000_000, r.opens, r.early) for r in
               open_windows(df, "k", 60, opener="opens", within=("early", 2)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    base, want = int((EPOCH - dt.datetime(1970, 1, 1)).total_seconds()), {}
    for k in {k for k, _ in rows}:
        mine = sorted((t, f"{i:05}") for i, (key, t) in enumerate(rows) if key == k)
        places = {}
        for (t, i), o in zip(mine, greedy([t for t, _ in mine], 60)):
            places[o] = places.get(o, 0) + 1
            want[i] = (base + o, places[o] == 1, places[o] <= 2)
    assert got == want and len(seen) == 1 and seen[0] <= 8 * 90


def test_repeated_rows_open_one_window(spark):
    """Of rows that agree in everything one opens the window; rows without a time have none."""
    df = spark.createDataFrame([("k", at(0), "a")] * 3 + [("k", at(0), None), ("k", None, "z"), (None, at(5), "n")], "k string, ts timestamp, alert_id string")
    got = open_windows(df, "k", 60, opener="opens", within=("early", 2)).collect()
    assert sum(r.opens for r in got) == 2 and [r.alert_id for r in got if r.opens and r.k] == [None]
    assert sum(r.early for r in got) == 3 and [(r.opened_us, r.opens, r.early) for r in got if r.ts is None] == [(None, False, False)]
    assert open_windows(df.limit(0), "k", 60, opener="opens").collect() == []


def test_rate_limit(spark):
    rows = [(f"a{i:02}", i, "1.1.1.1", 1000 + i, "low") for i in range(12)] + [("late", 60, "1.1.1.1", 99, "low")]
    marked = {r.alert_id: r.is_limited for r in A.mark_rate_limited(alert_rows(spark, rows)).collect()}
    assert [k for k in sorted(marked) if marked[k]] == ["a10", "a11"]
    assert marked["late"] is False


def test_duplicates_do_not_count_for_the_limit_but_limited_alerts_set_the_key(spark):
    rows = [(f"a{i:02}", i, "1.1.1.1", 1000 + i, "low") for i in range(11)]
    # a10 is limited at 10 s; its key stays taken until 70 s all the same
    rows += [("again", 65, "1.1.1.1", 1010, "low"), ("fresh", 70, "1.1.1.1", 1010, "low")]
    got = {r.alert_id: r.disposition for r in A.dispositions(alert_rows(spark, rows)).collect()}
    assert got["a10"] == "rate_limited" and got["again"] == "deduped" and got["fresh"] == "kept"


@pytest.mark.parametrize("gap,hits", [(3599, [1, 2, 3]), (3600, [1, 1, 1])])
def test_hit_reset(spark, gap, hits):
    a = A.hit_count(alert_rows(spark, [(f"a{i}", i * gap, "1.1.1.1", 80, "low") for i in range(3)]))
    assert [r.hit_count for r in a.orderBy("ts").collect()] == hits


def test_escalation(spark):
    rows = [(n, s) for n in (4, 5) for s in ("none", "low", "medium", "high", "critical", "odd")]
    df = spark.createDataFrame(rows, "hit_count int, severity string").withColumn("was", F.col("severity"))
    got = {(r.hit_count, r.was): (r.severity, r.was_escalated) for r in A.escalate(df).collect()}
    assert all(got[4, s] == (s, False) for s in ("none", "low", "critical", "odd"))
    assert got[5, "none"] == ("low", True) and got[5, "high"] == ("critical", True)
    assert got[5, "critical"] == ("critical", False) and got[5, "odd"] == ("medium", True)


def test_risk(spark):
    bad = L.KNOWN_BAD_IPS[0]
    rows = [("critical", 5.0, bad, 4444), ("low", 0.0, "10.0.0.1", 80), ("odd", None, "10.0.0.1", None), ("none", 0.19, bad, 9001), ("low", -0.25, "x", 80)]
    df = spark.createDataFrame(rows, "severity string, anomaly_score double, src_ip string, dst_port int").withColumn("dst_ip", F.lit("x"))
    got = [r.risk_score for r in A.risk_score(lookup_joins.flag_bad_ips(df)).select("severity", "anomaly_score", "risk_score").collect()]
    assert sorted(got) == sorted([100, 20, 20, 26, 18])


def test_chain_accounts_for_every_alert(spark):
    rnd = random.Random(5)
    rows = [(f"a{i:04}", rnd.randint(0, 4000), rnd.choice(["1.1.1.1", "1.1.1.1", "2.2.2.2", None]), rnd.randint(1, 30), "low") for i in range(1500)]
    d = A.dispositions(alert_rows(spark, rows)).collect()
    assert len(d) == len(rows) == len({r.alert_id for r in d})
    by_key = {}
    for r in d:
        if r.disposition != "deduped":
            by_key.setdefault(r.dedup_key, []).append(r.ts)
    for ts in by_key.values():
        ts.sort()
        assert all((b - a).total_seconds() >= 60 for a, b in zip(ts, ts[1:]))


def test_source_key_modes(spark):
    df = spark.createDataFrame([("1.1.1.1", "h"), (None, "h"), ("", "h"), (None, None)], "src_ip string, hostname string")
    got = df.select(A.source_key().alias("a"), A.source_key(legacy=True).alias("b")).collect()
    assert [tuple(r) for r in got] == [("1.1.1.1", "1.1.1.1"), ("h", ""), ("h", ""), ("", "")]


def test_actions(spark):
    a = alert_rows(spark, [("x", 0, "1.1.1.1", 1, "low"), ("y", 0, "1.1.1.1", 2, "low"), ("z", 0, "1.1.1.1", 3, "low")])
    acts = spark.createDataFrame(
        [("x", "acknowledge", None, "n1", at(1)), ("x", "acknowledge", "bo", None, at(5)), ("y", "acknowledge", "al", "n", at(1)),
         ("y", "dismiss", "al", None, at(9)), ("nobody", "dismiss", None, None, at(1))], schemas.ACTIONS)
    got = {r.alert_id: (r.status, r.acknowledged_by, r.analyst_notes, r.closed_at) for r in A.apply_actions(a, acts).collect()}
    assert got == {"x": ("acknowledged", "bo", None, None), "y": ("dismissed", "al", "n", at(9)), "z": ("open", None, None, None)}


# --- features and scores ---------------------------------------------------------------------------


def test_external_addresses(spark):
    ips = ["", None, "10.1.2.3", "172.15.0.1", "172.16.0.1", "172.31.9.9", "172.32.0.1", "8.8.8.8", "192.168.0.1", "127.0.0.1"]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "i int, ip string")
    got = [r[0] for r in df.orderBy("i").select(C.is_external(F.col("ip"))).collect()]
    assert got == [0, 0, 0, 1, 0, 0, 1, 1, 0, 0]
    assert {r[0] for r in df.select(C.is_external(F.col("ip"), legacy=True)).collect()} == {0.0}


def test_ports(spark):
    df = spark.createDataFrame([(None,), (0,), (50000,), (22,)], "dst_port int")
    got = {r.dst_port: r.dst_port_category for r in lookup_joins.port_category(df).collect()}
    assert got == {None: None, 0: None, 50000: "Unknown", 22: "SSH"}


def test_large_lookup_is_not_broadcast(spark):
    feed = spark.range(500).select(F.concat(F.lit("10.0.0."), "id").alias("ip"))
    assert L.small_side(feed, 500)._jdf.queryExecution().logical().toString().startswith("'UnresolvedHint") or "Hint" in str(
        L.small_side(feed, 500)._jdf.queryExecution().logical())
    assert "Hint" not in str(L.small_side(feed, 499)._jdf.queryExecution().logical())


@pytest.mark.parametrize("score_,want", [(1.0, "none"), (1.99, "low"), (2.0, "medium"), (5.0, "high"), (10.0, "critical"), (None, None)])
def test_severity_ladder(spark, score_, want):
    df = spark.createDataFrame([(score_,)], "s double")
    assert df.select(C.severity_from_score(F.col("s"), 1.0)).first()[0] == want


def events(spark, rows):
    return spark.createDataFrame([(f"u{i:05}", at(s), h, [float(v)] * 8) for i, (h, s, v) in enumerate(rows)],
                                 "event_uid string, ts timestamp, computer string, features array<float>")


def test_sequence_needs_ten_events(spark):
    rows = [("a", i, i) for i in range(10)] + [("b", i, 100 + i) for i in range(9)]
    got = host_sequences(events(spark, rows))
    assert got.count() == 19
    full = complete(got).collect()
    assert [(r.computer, [v[0] for v in r.seq]) for r in full] == [("a", [float(i) for i in range(10)])]


@pytest.mark.parametrize("parts", [None, 1, 7, 200])
def test_sequences_across_parts(spark, parts):
    rnd = random.Random(parts or 0)
    rows = [(rnd.choice(["hot", "hot", "hot", "x", "y"]), rnd.randint(0, 400), i) for i in range(600)]
    rows += [("sparse", i * 1000, i) for i in range(15)]
    got = {r.event_uid: [int(v[0]) for v in r.seq] if r.seq else None for r in host_sequences(events(spark, rows), parts=parts).collect()}
    want, held = {}, {}
    for s, i, h in sorted((s, i, h) for i, (h, s, _) in enumerate(rows)):
        held[h] = [*held.get(h, []), rows[i][2]][-10:]
        want[f"u{i:05}"] = held[h] if len(held[h]) == 10 else None
    assert got == want


@pytest.mark.parametrize("direct", [10, 100, 10_000_000])
@pytest.mark.parametrize("shape", ["normal", "ties", "two", "one"])
def test_exact_quantiles(spark, direct, shape):
    rng = np.random.default_rng(4)
    n = 5001
    x = {"normal": rng.normal(size=n), "ties": rng.integers(0, 7, n) * 1.0, "two": (rng.random(n) < 0.5) * 1.0, "one": np.ones(n)}[shape]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(4)
    probs = [0.0, 0.25, 0.333, 0.5, 0.8, 0.95, 1.0]
    got = exact_quantiles(df, {"x": F.col("x")}, probs, list_rows=direct, accuracy=50)["x"]
    assert np.allclose(got, np.quantile(x, probs), rtol=0, atol=1e-12)


def test_scaler_with_zero_range(spark):
    df = spark.createDataFrame([([float(i), 5.0] + [1.0] * 13,) for i in range(5)], "features array<float>")
    s = features.fit_scaler(df)
    assert s.center[:2] == [2.0, 5.0] and s.scale[:2] == [2.0, 1.0]
    got = features.apply_scaler(df, s).orderBy("features").first()[0]
    assert got[:3] == [-1.0, 0.0, 0.0] and got[8:] == [1.0] * 7
    assert features.apply_scaler(df, None) is df


def test_expression_and_batch_scores_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    for d, k in ((15, 4), (80, 32)):
        x = rng.normal(size=(50, d))
        w = np.linalg.qr(rng.normal(size=(d, k)))[0].T
        m = rng.normal(size=d)
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, features array<double>")
        got = [r[0] for r in score(df, Model("m", m.tolist(), w.tolist())).orderBy("i").select("raw_score").collect()]
        c = x - m
        want = ((c - c @ w.T @ w) ** 2).mean(axis=1)
        assert np.allclose(got, want)


def test_missing_sequence_has_no_score(spark):
    df = spark.createDataFrame([([[1.0] * 8] * 10,), (None,)], "seq array<array<float>>")
    got = [r[0] for r in score(df, Model("m", [0.0] * 80, []), "seq").select("raw_score").collect()]
    assert got == [1.0, None]


def counted(spark, df):
    """The rows of ``df``, and how many of them were computed so far."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema), seen


@pytest.mark.parametrize("parts", [1, 7])
def test_fit_takes_one_pass_and_agrees_with_numpy(spark, parts):
    """Far from zero as well, where products of the values themselves would lose the digits of the directions."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 12)) * np.arange(1, 13) + 1e6
    rows, seen = counted(spark, spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>").repartition(parts))
    m = fit_reconstruction(rows, k=5)
    # one for mean and directions, one for the threshold
    assert seen.value == 2 * 900
    w = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:5]
    assert np.allclose(m.mean, x.mean(axis=0), rtol=1e-12)
    got = np.array(m.components)
    assert np.allclose(got.T @ got, w.T @ w, atol=1e-9)
    c = x - x.mean(axis=0)
    assert np.isclose(m.threshold, np.quantile(((c - c @ w.T @ w) ** 2).mean(axis=1), 0.95), rtol=1e-9)


def test_fit_refuses_unlike_vectors(spark):
    for rows in ([[1.0, 2.0], [3.0]], [[1.0, 2.0], None], [[1.0, 2.0]], []):
        with pytest.raises(Exception, match="expected|too few"):
            fit_reconstruction(spark.createDataFrame([(r,) for r in rows], "features array<double>"), k=1)
    df = spark.createDataFrame([([[1.0], [2.0]],), ([[1.0]],), ([[1.0]] * 3,)], "seq array<array<double>>").coalesce(1)
    with pytest.raises(Exception, match="2 values expected"):
        score(df, Model("m", [0.0] * 2, []), "seq").collect()


def test_training_and_scoring_share_written_vectors(spark):
    """The events are computed once for both, and results are those of the two jobs by themselves."""
    rnd = random.Random(8)
    rows = [(f"u{i:05}", at(60 * i) if i % 90 else None, f"h{i % 3}", rnd.choice([4624, 4625, 4688, 4999]), rnd.choice([None, 2, 3, 10]),
             rnd.choice(["D:\\temp\\a.exe", ""]), rnd.choice(["", "8.8.8.8"])) for i in range(1200)]
    df = spark.createDataFrame(rows, "event_uid string, ts timestamp, computer string, event_id int, logon_type int, process_name string, src_ip string")
    df = df.withColumns({"user": F.lit("admin"), "severity": F.lit("low")})
    own = jobs.train_sequences(df)
    want = {r.event_uid: (r.anomaly_score, r.severity) for r in jobs.score_events(df, own).collect()}
    once, seen = counted(spark, df)
    vectors = jobs.event_vectors(once, "event_id", "severity")
    model = jobs.train_sequences(vectors, written=True)
    got = {r.event_uid: (r.anomaly_score, r.severity) for r in jobs.score_events(vectors, model, written=True).collect()}
    assert seen.value == 1200
    assert got == want and len(got) == 1200 and np.isclose(model.threshold, own.threshold, rtol=1e-9)


@pytest.mark.parametrize("parts", [1, 9])
def test_scores_are_made_before_rows_are_written(spark, parts):
    """The same scores as from sequences, for inner rows and for ends of parts, and no sequence in what is written."""
    rnd = random.Random(parts)
    df = events(spark, [(rnd.choice(["hot", "x"]), rnd.randint(0, 200), rnd.random()) for _ in range(400)] + [("few", 1, 1)] * 3)
    df = df.withColumn("ts", F.when(F.col("event_uid") != "u00007", F.col("ts")))
    model = Model("m", [0.1] * 80, np.linalg.qr(np.random.default_rng(2).normal(size=(80, 3)))[0].T.tolist())
    from_sequences = score(host_sequences(df, parts=parts, untimed=True), model, "seq").select("event_uid", "raw_score").collect()
    direct = host_sequences(df, parts=parts, untimed=True, out="raw_score", of=sequence_score(model))
    got, want = ({r.event_uid: r.raw_score for r in rows} for rows in (direct.collect(), from_sequences))
    assert got.keys() == want.keys() and len(got) == 403
    assert all((got[u] is None) == (want[u] is None) and np.isclose(got[u] or 0, want[u] or 0, rtol=1e-9) for u in got)
    assert sum(v is None for v in got.values()) == 3 + 1 + 2 * 9
    from_events = jobs.score_events(df.withColumns({"event_id": F.lit(4624), "logon_type": F.lit(2)} | {c: F.lit("a") for c in (
        "user", "process_name", "src_ip", "severity")}), model)
    assert all(spark.read.parquet(f).columns.count("seq") == 0 for f in [*direct.inputFiles(), *from_events.inputFiles()])


def test_error_profile(spark):
    p = error_profile(spark.createDataFrame([(float(i),) for i in range(101)], "raw_score double"))
    assert p["mean"] == 50 and p["pct"] == 95 and p["max"] == 100 and abs(p["std"] - np.std(np.arange(101))) < 1e-9


def test_model_table(spark):
    path = work_dir(spark, "models")
    save_model(spark, Model("m", [0.0], [[1.0]], 3.0, version=1), path)
    save_model(spark, Model("m", [1.0], [[1.0]], None, features.Scaler([1.0], [2.0]), version=2), path)
    m = load_model(spark, path, "m")
    assert (m.version, m.mean, m.threshold, m.scaler) == (2, [1.0], DEFAULT_THRESHOLD, features.Scaler([1.0], [2.0]))
    with pytest.raises(KeyError):
        load_model(spark, path, "other")


def test_training_gates(spark):
    f = spark.createDataFrame([(at(i), 10, 100.0, 80) for i in range(99)], "ts timestamp, bytes_sent bigint, duration_ms double, dst_port int")
    for c in ("bytes_recv", "bytes_total", "packets_sent", "packets_recv", "packets_total", "src_port"):
        f = f.withColumn(c, F.lit(1).cast("bigint"))
    f = f.withColumns({"bytes_per_sec": F.lit(1.0), "protocol": F.lit("TCP"), "tcp_flags": F.array(F.lit("SYN"))})
    with pytest.raises(ValueError):
        jobs.train_flows(f)


def test_legacy_forms(spark):
    flow = spark.createDataFrame([("f", at(0), True, "high", 9.0, "a", "b", 80, "TCP")],
                                 "flow_id string, ts timestamp, is_anomaly boolean, severity string, anomaly_score double, src_ip string, dst_ip string, dst_port int, protocol string")
    new, old = A.make_alerts(flow, "network").first(), A.make_alerts(flow, "network", legacy=True).first()
    assert (new.dst_port, old.dst_port, new.alert_id) == (80, None, old.alert_id)
    assert new.description == "[HIGH] Anomalous network flow detected: a → b:80 (TCP)"
    event = spark.createDataFrame([(4625, at(0), 3, "Admin", "C:\\Temp\\x.exe", "8.8.8.8")],
                                  "event_id int, ts timestamp, logon_type int, user string, process_name string, src_ip string")
    v = [round(x, 4) for x in features.event_features(event).first().features]
    assert v == [round(1 / 11, 4), 0.0, 0.0, round(3 / 11, 4), 1.0, 0.0, 1.0, 1.0]
    assert features.event_features(event, legacy=True).first().features[7] == 0.0


def test_packets_and_xml_to_alerts(spark):
    """Both ways from raw input to finished alerts in one go."""
    key = ("10.0.0.1", L.KNOWN_BAD_IPS[0], 50000)
    p = packets(spark, [(i * 100, *key, 4444, 6, 2, 100) for i in range(6)])
    x = xml_df(spark, *[event_xml(time=f'<TimeCreated SystemTime="2024-01-01T00:00:{i:02}Z"/>', data='<Data Name="LogonType">10</Data>')
                        for i in range(12)])
    flow_model = Model("f", [0.0] * 15, [], 1.0)
    event_model = Model("e", [0.0] * 80, [], 1e-9)
    out = jobs.packets_and_xml_to_alerts(p, x, flow_model, event_model).orderBy("ts").collect()
    net = [r for r in out if r.source_type == "network"]
    assert [r.hit_count for r in net] == [1, 2, 3, 4, 5, 6]
    assert all(r.dst_ip_known_bad and r.dst_port_category == "Metasploit" and r.risk_score == 100 for r in net)
    win = [r for r in out if r.source_type == "windows"]
    # three sequences are complete, one second apart: the first alert holds back the others
    assert [(r.hostname, r.event_id) for r in win] == [("gate7", 4624)]


# --- XML, JSON, tables ------------------------------------------------------------------------------

NS = f'xmlns="{L.EVENT_XML_NS}"'


def event_xml(eid="<EventID>4624</EventID>", time='<TimeCreated SystemTime="2024-01-01T10:00:00.5Z"/>', data="", computer="<Computer>gate7</Computer>"):
    return f"<Event {NS}><System>{eid}{time}{computer}</System><EventData>{data}</EventData></Event>"


def xml_df(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "xml string")


def test_broken_xml_is_dropped(spark):
    df = xml_df(spark, "<bad", f"<Event {NS}><EventData/></Event>", event_xml("<EventID>abc</EventID>"), event_xml(""), "",
                event_xml("<EventID Qualifiers='16384'> 7045 </EventID>"))
    assert [(r.event_id, r.severity, r.mitre_tactic) for r in parse_event_xml(df).collect()] == [(7045, "critical", "Persistence")]


def test_event_data_names(spark):
    data = ('<Data Name="TargetUserName">one</Data><Data Name="TargetUserName"> two </Data><Data>none</Data>'
            '<Data Name="SubjectUserName"></Data><Data Name="LogonType">10</Data><Data Name="IpAddress"/>')
    r = parse_event_xml(xml_df(spark, event_xml(data=data))).first()
    assert (r.user, r.logon_type, r.logon_type_name, r.src_ip, r.channel) == ("two", 10, "RemoteInteractive", None, "unknown")
    assert r.ts == dt.datetime(2024, 1, 1, 10, 0, 0, 500000)
    assert r.description == "Successful logon by two (RemoteInteractive logon) from "


def test_event_without_time_or_data(spark):
    r = parse_event_xml(xml_df(spark, f"<Event {NS}><System><EventID>4756</EventID></System></Event>")).first()
    assert r.ts is None and r.ts_missing and r.computer == "unknown" and r.description == "Windows Event 4756"
    assert r.logon_type is None and r.logon_type_name == ""


def test_event_id_filter(spark):
    df = xml_df(spark, event_xml(), event_xml("<EventID>1102</EventID>"))
    assert [r.event_id for r in parse_event_xml(df, event_ids=[1102]).collect()] == [1102]
    assert parse_event_xml(df, event_ids=None).count() == 2


def test_xml_files(spark):
    path = work_dir(spark, "xml")
    xml_df(spark, event_xml(), event_xml("<EventID>1102</EventID>"), event_xml("<EventID>x</EventID>")).write.text(path)
    assert sorted(r.event_id for r in read_event_xml(spark, path).collect()) == [1102, 4624]


def test_json_messages(spark):
    schema = schemas.ACTIONS
    rows = ['{"alert_id":"a","@timestamp":"2024-01-01T00:00:05Z","extra":1}', '{"alert_id":"b"', "", '{"alert_id":"c"}', "null"]
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    got = {(r.alert_id, r.ts) for r in tables.parse_json(df, schema).collect()}
    assert got == {("a", at(5)), ("c", None)}
    out = tables.to_messages(tables.parse_json(df, schema), "alert_id")
    assert all('"@timestamp":"' in r.value for r in out.collect())


def test_bounded_read_takes_the_earliest(spark):
    path = work_dir(spark, "topic")
    spark.range(100).select(F.format_string('{"alert_id":"%03d"}', 99 - F.col("id"))).write.text(path)
    got = tables.read_bounded(spark, schemas.ACTIONS, 5, "text", path, order=[F.col("alert_id")])
    assert [r.alert_id for r in got.collect()] == ["000", "001", "002", "003", "004"]


def test_upsert_and_latest(spark):
    path = work_dir(spark, "t")
    one = spark.createDataFrame([("a", at(0), 1), ("b", at(0), 1)], "id string, ts timestamp, v int")
    store.write(one, path, "id", F.lit(1))
    store.write(one.filter("id = 'a'").withColumn("v", F.lit(2)), path, "id", F.lit(2))
    assert {(r._id, r.v) for r in store.read(spark, path).collect()} == {("a", 2), ("b", 1)}


def test_a_micro_batch_run_again_replaces_itself_and_an_id_of_two_comes_out_once(spark):
    path = work_dir(spark, "epochs")
    rows = lambda *r: spark.createDataFrame(list(r), "id string, ts timestamp, v int")
    jobs_write = lambda df, e, source="q": store.write(df, path, "id", F.lit(e), source, e)
    jobs_write(rows(("a", at(0), 1), ("gone", at(0), 1)), 0)
    jobs_write(rows(("a", at(0), 1), ("b", None, 1)), 0)  # the same epoch, after a failure, with other rows
    jobs_write(rows(("a", at(0), 2), ("c", at(90_000), 2)), 1)
    jobs_write(rows(("a", at(0), 0)), 0, "another query")
    want = {("a", 2), ("b", 1), ("c", 2)}
    assert {(r._id, r.v) for r in store.read(spark, path).collect()} == want
    assert len(store.compact(spark, path)) == 1  # only the day of "a" has several pieces
    assert {(r._id, r.v) for r in store.read(spark, path).collect()} == want
    assert len(store.unused(spark, path)) == 2  # what the repeated epoch wrote first, and the other query's only day
    jobs_write(rows(("a", at(0), 1)), 0)  # an epoch that was folded already comes again
    jobs_write(rows(("d", at(1), 3)), 2)
    assert {(r._id, r.v) for r in store.read(spark, path).collect()} == want | {("d", 3)}
    assert store.compact(spark, path, least=2) != [] and store.compact(spark, path) == []
    assert {(r._id, r.v) for r in store.read(spark, path).collect()} == want | {("d", 3)}


def test_versions_are_dropped_before_rows_meet_and_days_found_without_opening_files(spark):
    path = work_dir(spark, "many")
    rows = spark.createDataFrame([(f"{i}", at(86_400 * i), i) for i in range(5)] + [("none", None, 9)], "id string, ts timestamp, v int")
    for version in (2, 3, 1):
        store.write(rows.withColumn("v", F.col("v") + 100 * version), path, "id", F.lit(version))
    plan = store.read(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    assert "InMemoryFileIndex(3 paths)" in plan  # a path a piece, not a day
    assert {(r._id, r.v) for r in store.read(spark, path).collect()} == {("none", 309)} | {(f"{i}", 300 + i) for i in range(5)}


def test_a_write_without_its_line_in_the_log_is_not_read(spark):
    path = work_dir(spark, "half")
    one = spark.createDataFrame([("a", at(0), 1)], "id string, ts timestamp, v int")
    store.write(one, path, "id", F.lit(1))
    lost = one.selectExpr("id AS _id", "v", "9L AS _version", "cast(null AS array<string>) AS _set", "date '2024-01-01' AS event_date", "ts", "id")
    store._write_piece(lost, path, "rows")
    assert [r.v for r in store.read(spark, path).collect()] == [1]


def test_patches_outlive_later_versions_and_compaction(spark):
    path = work_dir(spark, "patches")
    alert = spark.createDataFrame([("a", at(0), "low", "open"), ("b", at(0), "low", "open")], "alert_id string, ts timestamp, severity string, status string")
    store.write(alert, path, "alert_id", F.lit(1))
    act = lambda *r: jobs.store_actions(
        spark.createDataFrame(list(r), "alert_id string, action string, actor string, notes string, ts timestamp"), path)
    act(("a", "acknowledge", "amy", "n", at(10)), ("nobody", "dismiss", None, None, at(1)), ("b", "other", None, None, at(1)))
    store.compact(spark, path)
    act(("a", "dismiss", "bob", None, at(20)), ("a", "acknowledge", None, None, at(5)))  # the second is older
    store.write(alert.withColumn("severity", F.lit("high")), path, "alert_id", F.lit(2))
    state = lambda: [tuple(r) for r in store.read(spark, path, jobs.ACTED_ON).select(
        "_id", "severity", "status", "acknowledged_by", "acknowledged_at", "analyst_notes", "closed_at").orderBy("_id").collect()]
    want = [("a", "high", "dismissed", "amy", at(10), "n", at(20)), ("b", "high", "open", None, None, None, None)]
    assert state() == want
    store.compact(spark, path)
    assert state() == want


def test_retention(spark):
    days = [0, 29, 30, 31, 89, 90, 91]
    as_of = dt.date(2024, 6, 1)
    df = spark.createDataFrame([(d, as_of - dt.timedelta(days=d)) for d in days], "age int, event_date date")
    got = {r.age: r.tier for r in tables.with_tier(df, as_of).collect()}
    assert got == {0: "hot", 29: "hot", 30: "warm", 31: "warm", 89: "warm"}


def test_day_folders_are_pruned(spark):
    path = work_dir(spark, "days")
    tables.write_table(spark.createDataFrame([("a", at(0)), ("b", at(200_000))], "alert_id string, ts timestamp"), path)
    t = tables.read_table(spark, path, schemas.RAW_ALERTS).filter(F.col("event_date") == F.lit(dt.date(2024, 1, 3)))
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert [r.alert_id for r in t.collect()] == ["b"]


# --- search and statistics --------------------------------------------------------------------------


def test_search_without_conditions_is_everything(spark):
    df = spark.createDataFrame([("low", True), ("high", False)], "severity string, is_anomaly boolean")
    assert search.search_flows(df) is df
    assert search.search_flows(df, anomaly_only=True, severity="LOW").count() == 1


def test_pages(spark):
    df = spark.range(45).select(F.col("id").alias("flow_id"), F.timestamp_seconds("id").alias("ts"))
    last = search.page(df, search.by_time("flow_id"), page=3, size=20)
    assert [r.flow_id for r in last.collect()] == [4, 3, 2, 1, 0]
    assert tuple(search.page_counts(df).first()) == (45, 3)
    for bad in ({"page": 0}, {"size": 0}, {"size": 101}):
        with pytest.raises(ValueError):
            search.page(df, search.by_time("flow_id"), **bad)


def test_get_alert(spark):
    a = alert_rows(spark, [("x", 0, "1.1.1.1", 1, "low")])
    assert search.get_alert(a, "x").alert_id == "x"
    with pytest.raises(KeyError):
        search.get_alert(a, "y")


def test_terms_in_one_pass_equal_terms_one_by_one(spark):
    df = spark.createDataFrame([(i % 3, i % 17, None if i % 4 else "x") for i in range(100)], "a int, b int, c string")
    dims = {"a": 2, "b": 5, "c": 5}
    got = sorted(tuple(r) for r in stats.all_terms(df, dims).collect())
    want = sorted((d, str(r.key), r.cnt) for d, n in dims.items() for r in stats.terms(df.withColumn(d, F.col(d).cast("string")), d, n).collect())
    assert got == want


def test_empty_statistics(spark):
    df = spark.createDataFrame([], schemas.NET_FLOWS)
    got = {r.key: r.value for r in stats.flow_stats(df).collect()}
    assert got == {"total_events": 0, "total_anomalies": 0, "anomaly_rate_pct": 0, "avg_anomaly_score": 0}


@pytest.mark.parametrize("n,text", [(999, "999"), (1000, "1.0K"), (1250, "1.3K"), (1_000_000, "1.0M"), (12_340_000, "12.3M"), (None, "0")])
def test_short_numbers(spark, n, text):
    df = spark.createDataFrame([(n,)], "n bigint")
    assert df.select(C.short_number(F.col("n"))).first()[0] == text


# --- detectors --------------------------------------------------------------------------------------


def test_beacon_over_cells(spark):
    rows = [("a", "b", at(60 * i), 100) for i in range(200)] + [("a", "c", at(i * i), 100) for i in range(200)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, ts timestamp, bytes_sent bigint")
    for cell in (600, 3600, 10_000_000):
        got = [tuple(r) for r in detectors.beacon(df, cell_s=cell).collect()]
        assert got == [("a", "b", 200, 60.0, 0.0)]


def test_compromise_chain(spark):
    def host(name, fails, made, cleared):
        return [(name, 4625, at(s)) for s in fails] + [(name, 4720, at(s)) for s in made] + [(name, 1102, at(s)) for s in cleared]

    rows = host("hit", range(3590, 3600), [3605], [7200]) + host("few", range(9), [20], [30]) + host("late", range(10), [20], [3621])
    rows += host("old", range(10), [3605], [3700]) + host("order", range(10), [20], [10]) + host("twice", range(10), [20, 25], [30, 31])
    df = spark.createDataFrame(rows, "computer string, event_id int, ts timestamp")
    got = sorted((r.computer, r.failures, (r.user_created_at - EPOCH).seconds, (r.log_cleared_at - EPOCH).seconds)
                 for r in detectors.compromise_chain(df).collect())
    assert got == [("hit", 10, 3605, 7200), ("twice", 10, 25, 30), ("twice", 10, 25, 31)]


def test_port_scan_needs_syn_only(spark):
    rows = [("a", "b", at(i), i, ["SYN"]) for i in range(50)] + [("c", "b", at(i), i, ["SYN", "ACK"]) for i in range(50)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, ts timestamp, dst_port int, tcp_flags array<string>")
    assert [(r.src_ip, r.ports) for r in detectors.port_scan(df).collect()] == [("a", 50)]


# --- edges: missing times, zones, versions, repeated keys, plans --------------------------------------


def test_ids_do_not_collide_or_follow_the_zone(spark):
    rows = spark.createDataFrame(
        [(at(0), 1, "a", None), (at(0), 1, None, "a"), (None, 1, "a", "x"), (None, 1, "a", "y")],
        "ts timestamp, event_id int, computer string, user string")
    uid = C.event_uid(F.col("ts"), F.col("event_id"), F.col("computer"), F.col("user"))
    found = []
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            found.append([r[0] for r in rows.select(uid).collect()])
            hours = spark.range(1).select(F.timestamp_micros(F.lit(23 * 3_600_000_000)).alias("ts")).select(
                C.utc_hour(F.col("ts")), C.utc_date(F.col("ts")).cast("string"), C.utc_weekday(F.col("ts"))).first()
            assert tuple(hours) == (23, "1970-01-01", 3)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found[0] == found[1] and len(set(found[0])) == 4


def test_events_without_a_time_keep_ids_of_their_own(spark):
    def xml(ip):
        return f"<Event {NS}><System><EventID>4624</EventID></System><EventData><Data Name='IpAddress'>{ip}</Data></EventData></Event>"

    got = parse_event_xml(xml_df(spark, xml("10.0.0.1"), xml("10.0.0.2"))).collect()
    assert len({r.event_uid for r in got}) == 2


def test_a_busy_minute_of_one_host_lies_in_many_parts(spark):
    """20,000 events of one host within a minute: parts follow counts, and hold ranges in order."""
    df = spark.range(0, 20_000, 1, 4).selectExpr(
        "'hot' AS computer", "timestamp_micros(1704067200000000 + (id * 7919) % 20000 * 3000) AS ts", "CAST(id AS string) AS event_uid")
    got = dealt(df, "computer", "ts", "event_uid", parts=16).groupBy("_part").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    rows = got.orderBy("_part").collect()
    assert len(rows) >= 14 and max(r.n for r in rows) <= 2 * 20_000 / 16 and sum(r.n for r in rows) == 20_000
    assert all(x.b <= y.a for x, y in zip(rows, rows[1:]))


def test_sequences_compute_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = events(spark, [("a", i % 50, i) for i in range(400)])
    df = df.withColumn("ts", F.when(F.col("event_uid") >= "u00010", F.col("ts"))).mapInArrow(count, df.schema)
    got = host_sequences(df, untimed=True)
    assert got.count() == 400 and got.filter("ts IS NULL AND seq IS NULL").count() == 10 and complete(got).count() == 390 - 9
    assert seen.value == 400


def test_sequences_of_repeated_rows_and_of_nothing(spark):
    rows = events(spark, [("a", 1, 5)] * 3 + [(None, 1, 6)] * 2)
    twice = rows.withColumns({"event_uid": F.lit("same"), "other": F.lit(1)}).unionAll(rows.withColumns({"event_uid": F.lit(None), "other": F.lit(2)}))
    got = host_sequences(twice, n=2).collect()
    # of every host all events but the first have one before them
    assert sorted((r.computer or "", r.seq is None) for r in got) == [("", False)] * 3 + [("", True)] + [("a", False)] * 5 + [("a", True)]
    assert host_sequences(rows.limit(0)).columns == [*rows.columns, "seq"] and host_sequences(rows.limit(0)).count() == 0
    assert all(len(r.seq) == 1 for r in host_sequences(rows, n=1).collect())


def test_untimed_rows_take_no_part(spark):
    df = spark.createDataFrame([(at(i), "h", f"u{i:02}", [float(i)]) for i in range(12)] + [(None, "h", "x", [-1.0])],
                               "ts timestamp, computer string, event_uid string, features array<float>")
    got = host_sequences(df).collect()
    assert len(got) == 12 and all([-1.0] not in (r.seq or []) for r in got)
    assert [r.event_uid for r in C.untimed(df).collect()] == ["x"]


def test_untimed_alerts_pass_the_chain(spark):
    rows = [(f"a{i:02}", i, "1.1.1.1", 80 + i, "low") for i in range(13)] + [("b", 5, "1.1.1.1", 80, "low")]
    a = alert_rows(spark, rows + [(f"x{i:02}", 0, "1.1.1.1", 80, "low") for i in range(12)])
    a = a.withColumn("ts", F.when(~F.col("alert_id").startswith("x"), F.col("ts")))
    got = {r.alert_id: r.disposition for r in A.dispositions(a).collect()}
    assert len(got) == 26 and got["b"] == "deduped"
    assert {i for i, d in got.items() if d == "rate_limited"} == {"a10", "a11", "a12"}
    assert all(got[f"x{i:02}"] == "kept" for i in range(12))
    done = {r.alert_id: r for r in A.process_alerts(a).collect()}
    assert len(done) == 22 and all(done[f"x{i:02}"].hit_count is None and done[f"x{i:02}"].severity == "low" for i in range(12))
    assert [done[f"a{i:02}"].hit_count for i in range(10)] == list(range(1, 11))


def test_json_keeps_microseconds(spark):
    moment = dt.datetime(2024, 1, 1, 0, 0, 0, 123456)
    df = spark.createDataFrame([("a", moment)], "alert_id string, ts timestamp")
    assert [r.ts for r in tables.parse_json(tables.to_messages(df, "alert_id"), schemas.ACTIONS).collect()] == [moment]


def test_versions_outlive_compaction(spark):
    path = work_dir(spark, "v")
    row = spark.createDataFrame([("a", at(0), "new")], "id string, ts timestamp, v string")
    store.write(row, path, "id", F.lit(7))
    store.write(row.withColumn("v", F.lit("older")), path, "id", F.lit(2))
    assert store.compact(spark, path) == ["2024-01-01"]
    store.write(row.withColumn("v", F.lit("old")), path, "id", F.lit(3))
    assert [r.v for r in store.read(spark, path).collect()] == ["new"]


def test_rows_without_an_id_are_not_doubled_by_a_repeated_write(spark):
    path = work_dir(spark, "w")
    rows = spark.createDataFrame([(None, at(0), 1), (None, at(0), 2)], "id string, ts timestamp, v int")
    for _ in range(2):
        store.write(rows, path, "id", F.lit(1))
    assert sorted(r.v for r in store.read(spark, path).collect()) == [1, 2]


def test_latest_of_a_day_reads_that_day(spark):
    path = work_dir(spark, "days")
    store.write(spark.createDataFrame([("a", at(0)), ("b", at(200_000))], "id string, ts timestamp"), path, "id", F.lit(1))
    day = store.read(spark, path).filter(F.col("event_date") == F.lit(dt.date(2024, 1, 3)))
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert [r._id for r in day.collect()] == ["b"]
    assert [r._id for r in store.read(spark, path, days=["2024-01-03", "2030-01-01"]).collect()] == ["b"]
    assert store.read(spark, path, days=[]).collect() == []


ZONES = ("UTC", "Asia/Kolkata", "America/St_Johns", "Europe/Berlin")


def test_times_without_a_zone_are_utc_whatever_the_session_says(spark):
    """Also in the hours that a change of clocks skips or repeats in the session's zone."""
    texts = ["2024-01-01 02:00:00.25", "2024-03-31 02:30:00", "2024-10-27 02:30:00", "1969-12-31 23:59:59.999999", "2024-06-01 23:45:00"]
    want = None
    for zone in ZONES:
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            bare = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("cast(t AS timestamp_ntz) AS ts", "concat(t, 'Z') AS z")
            for ts in (F.col("ts"), F.col("z").cast("timestamp")):
                got = bare.select(
                    C.micros(ts), C.utc_date(ts).cast("string"), C.utc_hour(ts), C.utc_weekday(ts), C.utc_stamp(C.micros(ts)),
                    F.unix_micros(C.instant(ts)), C.event_uid(ts, F.lit(1), F.lit("a"), F.lit("b"))).collect()
                hours = stats.hourly(bare.select(ts.alias("ts"))).select(F.unix_micros("hour"), "cnt").collect()
                got = ([tuple(r) for r in got], sorted(tuple(r) for r in hours))
                want = got if want is None else want
                assert got == want
            xml = spark.createDataFrame([(t.replace(" ", "T"), f"{t.replace(' ', 'T')}Z") for t in texts], "a string, b string")
            same = xml.select(F.unix_micros(C.instant_of_text(F.col("a"))), F.unix_micros(C.instant_of_text(F.col("b")))).collect()
            assert [r[0] for r in same] == [r[1] for r in same] == [r[0] for r in want[0]]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r[0] for r in want[0]][3] == -1 and [r[4] for r in want[0]][0] == "2024-01-01 02:00:00"


def test_texts_of_times(spark):
    texts = ["2024-01-01T10:00:00.5Z", "2024-01-01T12:00:00.5+02:00", "2024-01-01T10:00:00.5", " 2024-01-01 10:00:00.5 ", "2024-01-01T10:00:00.5 UTC"]
    odd = ["2024-01-01", "2024-01", "nonsense", "", None]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        got = [r[0] for r in spark.createDataFrame([(t,) for t in texts + odd], "t string").select(F.unix_micros(C.instant_of_text(F.col("t")))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got[:5] == [1_704_103_200_500_000] * 5 and got[5:] == [1_704_067_200_000_000, 1_704_067_200_000_000, None, None, None]


def test_a_bound_needs_an_order(spark):
    path = work_dir(spark, "topic")
    spark.range(3).select(F.lit('{"alert_id":"a"}')).write.text(path)
    with pytest.raises(ValueError):
        tables.read_bounded(spark, schemas.ACTIONS, 2, "text", path)
    assert tables.read_bounded(spark, schemas.ACTIONS, None, "text", path).count() == 3


def test_a_repeated_lookup_key_does_not_multiply_rows(spark):
    events = spark.createDataFrame([(4624,), (1,)], "event_id int")
    table = spark.createDataFrame(
        [(4624, "b", "t", "n", "low"), (4624, "a", "t", "n", "low"), (None, "c", "t", "n", "low")],
        "event_id int, mitre_tactic string, mitre_technique string, mitre_technique_name string, baseline_severity string")
    got = lookup_joins.tag_mitre(events, table).collect()
    assert sorted((r.event_id, r.mitre_tactic) for r in got) == [(1, "unknown"), (4624, "a")]


def test_quantiles_leave_nan_out(spark):
    df = spark.createDataFrame([(float("nan"),)] * 50 + [(float(i),) for i in range(101)], "x double")
    assert exact_quantiles(df, {"x": F.col("x")}, [0.5], list_rows=10, accuracy=50)["x"] == [50.0]


def test_pages_behind_a_row(spark):
    df = spark.createDataFrame([(i % 7, f"{i:03}") for i in range(60)], "n int, id string")
    keys = [("n", True), ("id", False)]
    want = [tuple(r) for r in df.orderBy(F.desc("n"), "id").collect()]
    got, after = [], None
    while rows := [tuple(r) for r in search.page_after(df, keys, after, 25).collect()]:
        got += rows
        after = rows[-1]
    assert got == want


def test_statistics_document_reads_its_input_once(spark):
    path = work_dir(spark, "scored")
    cols = "severity string, protocol string, src_ip string, dst_port int, is_anomaly boolean, anomaly_score double"
    spark.createDataFrame([("low", "TCP", "a", 1, True, 0.25), ("low", None, "b", 1, False, None)], cols).write.parquet(path)
    doc = stats.flow_stats(spark.read.parquet(path))
    plan = doc._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    got = {(r.dim, r.key): r.value for r in doc.collect()}
    assert got["figure", "anomaly_rate_pct"] == 50.0 and got["figure", "avg_anomaly_score"] == 0.25 and got["dst_port", "1"] == 2.0


def test_quantiles_sketch_only_what_is_still_too_long(spark, monkeypatch):
    """Narrow intervals about ranks are counted, not sketched again."""
    made, sketch = [], F.kll_sketch_agg_double
    monkeypatch.setattr(F, "kll_sketch_agg_double", lambda *a: made.append(a) or sketch(*a))
    df = spark.range(30_001).select(F.col("id").cast("double").alias("x"))
    assert exact_quantiles(df, {"x": F.col("x")}, [0.25, 0.5])["x"] == [7500.0, 15000.0]
    assert len(made) == 1


def test_quantiles_take_few_passes(spark):
    """The input is computed once, and its columns are read three times whatever the number of columns and ranks."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(0, 60_000, 1, 4).select(F.rand(3).alias("x"), F.exp(F.randn(4)).alias("y")).mapInArrow(count, "x double, y double")
    tracker, before = spark.sparkContext.statusTracker(), "quantile-passes"
    spark.sparkContext.setJobGroup(before, before)
    got = exact_quantiles(df, {"x": F.col("x"), "y": F.col("y")}, [0.25, 0.5, 0.75])
    jobs_run = len(tracker.getJobIdsForGroup(before))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = df.agg(*[F.percentile(c, [0.25, 0.5, 0.75]).alias(c) for c in ("x", "y")]).first()
    assert np.allclose(got["x"], want["x"], rtol=0, atol=1e-12) and np.allclose(got["y"], want["y"], rtol=1e-12)
    assert seen.value == 2 * 60_000  # one of them is the comparison's
    # write, sketch, guesses, counts, lists; a job may come with its shuffle stage as another one
    assert jobs_run <= 8


def test_staged_rows_go_with_their_block(spark, tmp_path):
    before = stage(spark.range(3), "outer")
    with staging(spark) as folder:
        assert stage(spark.range(5), "inner").inputFiles()[0].removeprefix("file://").startswith(folder)
        with staging(spark) as nested:
            assert nested.startswith(folder) and stage(spark.range(2), "nested").count() == 2
        assert not os.path.exists(nested) and os.path.exists(folder)
        # a whole operator inside: its result is written before its staged rows go
        host_sequences(events(spark, [("a", i, i) for i in range(12)])).write.parquet(str(tmp_path / "out"))
    assert not os.path.exists(folder)
    assert before.count() == 3 and complete(spark.read.parquet(str(tmp_path / "out"))).count() == 3
    with pytest.raises(ZeroDivisionError), staging(spark) as folder:
        stage(spark.range(1), "lost")
        1 / 0
    assert not os.path.exists(folder) and not os.path.exists(work_dir(spark, "fresh"))
    with staging(spark):
        pass


@pytest.mark.parametrize("inclusive", [False, True])
def test_runs_of_a_key_are_numbered_over_its_blocks(spark, inclusive):
    """Cells of one key over many blocks, with pauses at, below and above the idle time inside blocks and between them."""
    rnd, idle = random.Random(4), 10
    us, rows = -50_000, []
    for _ in range(4000):
        us += rnd.choice([10, 10, 11, 12, 40, 9_000, 25_000]) if rnd.random() < 0.1 else 10
        rows.append((rnd.choice(["a", None]), us))
    df = spark.createDataFrame(rows, "k string, first bigint").withColumn("last", F.col("first"))
    runs = flows.idle_runs(df, ["k"], idle, "first", "last", "run", inclusive)
    want, at = set(), {}
    for k, us in rows:
        before, run = at.get(k, (us, 0))
        run += us - before >= idle and before != us if inclusive else us - before > idle
        at[k] = (us, run)
        want.add((k, us, run))
    assert {(r.k, r.first, r.run) for r in runs.collect()} == want and runs.count() == len(rows)
    # no window goes over the cells of a whole key
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert all("_block" in line for line in plan.splitlines() if "Window [" in line)
