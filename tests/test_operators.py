"""Operators on literal rows: boundaries, nulls, ties, empty tables and properties that hold for any input."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark import functions as fn
from waymark.operators import bootstrap, carry, cohort, episodes, evaluate, fitting, intervals, outcomes, pairing, quality, signals, windows
from waymark.operators.grid import landmark_grid

H = fn.HOUR

LABELS = [
    ({"death": 0, "died": 1}, "invalid_input", None, None),
    ({"death": 24, "died": 1}, "event", 1, False),
    ({"death": 30, "died": 0}, "status_conflict", None, None),
    ({"alive_discharge": 24, "last_seen": 24}, "non_event_alive_discharge", 0, True),
    ({"alive_discharge": 12, "last_seen": 12}, "non_event_alive_discharge", 0, False),
    ({"transfer": 12}, "acute_transfer", None, False),
    ({"died": 1}, "death_time_missing", None, None),
    ({"death": 30, "died": 0, "last_seen": 12}, "status_conflict", None, None),
    ({}, "non_event_observed", 0, True),
    ({"last_seen": 12}, "missing_status_left_observation", None, None),
    ({"alive_discharge": 30}, "non_event_observed", 0, True),
    ({"death": 30, "died": 1, "last_seen": 12}, "missing_status_left_observation", None, False),
    ({"alive_discharge": 12, "seen_after": True}, "non_event_alive_discharge", 0, False),
    ({"last_seen": 12, "seen_after": True}, "missing_status_left_observation", None, False),
    ({"last_seen": None}, "missing_status_left_observation", None, False),
]
REASONS = {0: "invalid_input", 2: "status_conflict", 5: "acute_transfer", 6: "death_time_missing", 9: "missing_status_left_observation", 13: "time_anomaly"}


def label_rows(spark):
    base = {"died": 0, "death": None, "transfer": None, "alive_discharge": None, "last_seen": 48, "seen_after": False}
    out = []
    for i, (over, *_) in enumerate(LABELS):
        r = base | over
        out.append((i, 0, 24 * H, r["died"], *[None if r[c] is None else r[c] * H for c in ("death", "transfer", "alive_discharge", "last_seen")], r["seen_after"]))
    return spark.createDataFrame(out, "i int, t long, w_end long, died int, death long, transfer long, alive_discharge long, last_seen long, seen_after boolean")


def test_label_states(spark):
    got = {r.i: r for r in outcomes.label_states(label_rows(spark)).collect()}
    for i, (_, state, y, full) in enumerate(LABELS):
        assert (got[i].state, got[i].y) == (state, y), i
        assert full is None or got[i].full_followup is full
        assert got[i].ascertainable == (y is not None) and (got[i].unknown_reason is None) == (y is not None)
        assert got[i].status == {1: "event", 0: "non_event", None: "unknown"}[y] and REASONS.get(i, got[i].unknown_reason) == got[i].unknown_reason
    queue = outcomes.adjudication_queue(outcomes.label_states(label_rows(spark))).collect()
    assert sorted(r.i for r in queue) == [0, 2, 6, 7] and {r.adjudication for r in queue} == {"pending"}


def test_competing_risk_order_and_censoring(spark):
    given = [(1, 0, 5, 5, 5, 9), (2, 0, None, 8, 5, 9), (3, 0, None, None, None, 200), (4, 0, None, None, None, 3), (5, 0, None, None, None, None), (6, 0, 0, None, 169, 300), (7, 0, 5, 2, None, 9), (8, 0, 168, 2, 1, 9)]
    rows = spark.createDataFrame(given, "i int, t long, death long, transfer long, alive_discharge long, last_seen long")
    got = {r.i: (r.cause, r.at, r.censor_type) for r in outcomes.competing_risk(rows, 168).collect()}
    assert got == {1: (1, 5, "window_end"), 2: (3, 8, "window_end"), 3: (0, 168, "window_end"), 4: (0, 3, "left_observation"), 5: (0, 168, "window_end"), 6: (0, 168, "window_end"), 7: (1, 5, "window_end"), 8: (1, 168, "window_end")}
    bins = rows.select(outcomes.event_bin(F.lit(13), F.lit(0), F.lit(1), 12, 14).alias("a"), outcomes.event_bin(F.lit(0), F.lit(0), F.lit(1), 12, 14).alias("b"), outcomes.event_bin(F.lit(3), F.lit(0), F.lit(0), 12, 14).alias("c")).first()
    assert tuple(bins) == (2, 1, 14)


def test_windows_are_half_open_and_strict_is_part_of_retro(spark):
    grid = spark.createDataFrame([("a", k, k * 6 * H) for k in range(6)], "key string, k long, t long")
    r = random.Random(1)
    rows = [("a", 1, 0, 0), ("a", 2, 6 * H, 6 * H + 1), ("a", 3, -24 * H, 0), ("b", 4, 0, 0)] + [("a", 10 + i, e := r.randrange(-30 * H, 40 * H), e + r.randrange(10 * H)) for i in range(200)]
    ev = spark.createDataFrame(rows, "key string, event_id long, e long, a long")
    retro = {(x.event_id, x.k) for x in windows.point_window(ev, grid, 24 * H, 6 * H).collect()}
    strict = {(x.event_id, x.k) for x in windows.point_window(windows.bounded(ev, grid, 24 * H), grid, 24 * H, 6 * H, clock="a").collect()}
    want = {(i, k) for key, i, e, _ in rows for k in range(6) if key == "a" and k * 6 * H - 24 * H < e <= k * 6 * H}
    assert retro == want and strict == {(i, k) for i, k in want if dict((x[1], x[3]) for x in rows)[i] <= k * 6 * H}
    assert strict < retro and not any(i == 3 for i, _ in retro if _ == 0)
    later = ev.unionByName(spark.createDataFrame([("a", 999, 0, 50 * H)], ev.schema))
    assert {(x.event_id, x.k) for x in windows.point_window(later, grid, 24 * H, 6 * H, clock="a").collect()} == strict


def test_overlap_and_active_at(spark):
    grid = spark.createDataFrame([("a", k, k * 6 * H) for k in range(6)], "key string, k long, t long")
    r = random.Random(2)
    rows = [("a", i, s := r.randrange(-40 * H, 40 * H), s + r.randrange(1, 30 * H) if i % 7 else None, 1.0) for i in range(120)]
    iv = spark.createDataFrame(rows, "key string, event_id long, start long, stop long, dose double")
    got = {(x.event_id, x.k) for x in windows.overlap_window(iv, grid, 24 * H, 6 * H).collect()}
    assert got == {(i, k) for _, i, s, e, _ in rows for k in range(6) if s <= k * 6 * H and (e is None or e > k * 6 * H - 24 * H)}
    on = {(x.event_id, x.k) for x in windows.active_at(iv, grid, 6 * H).collect()}
    assert on == {(i, k) for _, i, s, e, _ in rows for k in range(6) if s <= k * 6 * H and (e is None or e > k * 6 * H)}


def test_as_of_takes_the_latest_and_breaks_ties(spark):
    grid = spark.createDataFrame([("a", 0, 10), ("a", 1, 20), ("b", 0, 10)], "key string, k long, t long")
    ev = spark.createDataFrame([("a", 1, 10, 1.0), ("a", 2, 10, 2.0), ("a", 3, 11, None), ("a", 4, None, 9.0)], "key string, event_id long, e long, value double")
    got = {(r.key, r.k): (r.e, r.value) for r in windows.as_of(grid, ev, ["value"]).collect()}
    assert got == {("a", 0): (10, 2.0), ("a", 1): (11, None), ("b", 0): (None, None)}
    near = {(r.key, r.k): r.e for r in windows.as_of(grid, ev, ["value"], 9).collect()}
    assert near == {("a", 0): 10, ("a", 1): None, ("b", 0): None}


def test_pairs_at_their_bounds(spark):
    a = spark.createDataFrame([("x", 1, 100)], "key string, event_id long, e long")
    b = spark.createDataFrame([("x", i, e) for i, e in enumerate([27, 28, 100, 124, 125])], "key string, event_id long, e long")
    assert {r.id_b for r in windows.paired(a, b, 72, 24).collect()} == {1, 2, 3}
    assert windows.earliest_pair(windows.paired(a, b, 72, 24)).first().id_b == 1


def test_reconcile(spark):
    x = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id long, v long")
    y = spark.createDataFrame([(1, 5), (2, None), (4, 7)], "id long, v long")
    assert tuple(pairing.reconcile(x, y, ["id"], "v").first()) == (2, 1, 1, 1.0)
    assert tuple(pairing.reconcile(x.limit(0), y.limit(0), ["id"], "v").first()) == (0, 0, 0, None)


def test_grid(spark):
    c = spark.createDataFrame([(1, 0, 0, 13 * H), (2, 0, 7 * H, None), (3, 0, 0, 0), (4, 5, 5, 5 + 12 * H)], "key long, t0 long, start long, stop long")
    got = {}
    for r in landmark_grid(c, 6 * H, 3, 1, start="start", stop="stop").collect():
        got.setdefault(r.key, []).append((r.k, r.main))
    assert got == {1: [(0, True), (1, True), (2, False)], 2: [(2, False), (3, False)], 4: [(0, True), (1, True)]}


#: (gap in minutes, units and (from, to) minutes around the start of each move, units before and after): status, evidence, path class, decisions at thresholds 0 and 60
ICU, ED, WARD = "Medical Intensive Care Unit", "Emergency Department", "Medicine"
EDGES = [
    (None, [], ICU, ICU, "not_applicable", "no_transfer_evidence", "first_stay", "split", "split"),
    (-5, [(ICU, -9, 9)], ICU, ICU, "anomaly", "overlap", "overlapping_transfer_records", "pending_review", "pending_review"),
    (0, [], ICU, ICU, "missing_boundary", "no_transfer_evidence", "missing_left_boundary", "pending_review", "pending_review"),
    (0, [(ICU, -9, 9), (ICU, -8, 5)], ICU, ICU, "anomaly", "direct_icu", "multiple_conflicting_boundary_events", "pending_review", "pending_review"),
    (0, [(ICU, -9, 9), (WARD, -8, 5)], ICU, ICU, "anomaly", "via_ward", "multiple_conflicting_boundary_events", "split", "split"),
    (0, [(None, -9, 9)], ICU, ICU, "anomaly", "direct_icu", "unknown_careunit", "pending_review", "pending_review"),
    (0, [(ED, -9, 9)], ICU, ICU, "anomaly", "via_ed", "icu_to_ed_to_icu", "split", "split"),
    (0, [(WARD, -10, 20)], ICU, "CCU", "clean", "via_internal_placeholder", "icu_to_internal_placeholder_to_icu", "merged", "merged"),
    (0, [(WARD, -10, 21)], ICU, ICU, "anomaly", "via_ward", "icu_to_ward_to_icu", "split", "split"),
    (0, [(WARD, -10, None)], ICU, ICU, "missing_boundary", "no_transfer_evidence", "missing_left_boundary", "pending_review", "pending_review"),
    (60, [(WARD, -10, None)], ICU, ICU, "not_applicable", "via_ward", "icu_to_ward_to_icu", "split", "split"),
    (0, [(WARD, -10, 20)], WARD, ICU, "anomaly", "via_ward", "icu_to_ward_to_icu", "split", "split"),
    (0, [(ICU, -9, 9)], ICU, "CCU", "clean", "direct_icu", "icu_to_icu", "merged", "merged"),
    (60, [(ICU, -70, -20), (ED, -30, 5)], ICU, ICU, "not_applicable", "via_ed", "icu_to_ed_to_icu", "split", "split"),
    (60, [(WARD, -50, -20)], ICU, ICU, "not_applicable", "via_internal_placeholder", "icu_to_internal_placeholder_to_icu", "split", "merged"),
    (60, [(WARD, -50, -10)], ICU, ICU, "not_applicable", "via_ward", "icu_to_ward_to_icu", "split", "split"),
    (60, [(ICU, -50, -10), (ICU, -40, -5)], ICU, ICU, "not_applicable", "direct_icu", "icu_to_icu", "split", "merged"),
    (60, [], ICU, ICU, "not_applicable", "no_transfer_evidence", "no_transfer_rows", "split", "merged"),
    (61, [], ICU, ICU, "not_applicable", "no_transfer_evidence", "no_transfer_rows", "split", "split"),
]


def test_path_evidence_and_decisions_branch_by_branch(spark):
    m = fn.MINUTE
    stays, moves = [], []
    for i, (gap, path, before, after, *_) in enumerate(EDGES):
        start = 1000 * m
        stays += [(i, 2 * i, 0, None if gap is None else start - gap * m, before), (i, 2 * i + 1, start, start + 50 * m, after)]
        moves += [(i, 10 * i + j, start + a * m, None if b is None else start + b * m, u) for j, (u, a, b) in enumerate(path)]
    s = spark.createDataFrame(stays, "key long, stay_id long, start long, stop long, unit string")
    x = spark.createDataFrame(moves, "key long, move_id long, at long, stop long, unit string")
    got = {(r.key, r.tau): r for r in episodes.decided_edges(s, x, m, [0, 60]).collect()}
    for i, (_, _, _, _, status, evidence, path_class, at_0, at_60) in enumerate(EDGES):
        r = got[i, 0]
        assert (r.status, r.evidence, r.path_class, r.decision, got[i, 60].decision) == (status, evidence, path_class, at_0, at_60), i
    assert got[4, 0].between == WARD and got[4, 0].conflict and not got[16, 0].conflict and got[5, 0].exclusion == "unknown_careunit_in_path"
    judged = spark.createDataFrame([(2 * 2 + 1, "adjudicated", "merged"), (2 * 3 + 1, "pending", "merged"), (2 * 7 + 1, "adjudicated", "split")], "stay_id long, adjudication string, final string")
    early = {r.stay_id: r for r in episodes.merge_episodes(s, x, m, [60]).collect()}
    late = {r.stay_id: r for r in episodes.merge_episodes(s, x, m, [60], judged).collect()}
    assert early[5].episode_id == "EP_2_2" and early[5].unresolved and late[5].episode_id == "EP_2_1" and (late[5].mapping_status, late[5].stay_seq) == ("adjudicated", 2)
    assert late[7].episode_seq == 2 and late[7].unresolved and late[15].episode_seq == 1 and late[15].mapping_status == "clean" and late[15].gap_max == 0.0
    assert episodes.merge_episodes(s.limit(0), x, m, [0, 60]).count() == 0


@pytest.mark.parametrize("unit", [1, fn.MINUTE])
def test_intervals_meet_on_any_clock(spark, unit):
    r = random.Random(unit)
    length = lambda: r.choice([0, 0, 1, r.randint(0, 50), r.randint(0, 40_000)])
    a = [(r.choice("xy"), i, x := r.randint(-500, 60_000) * unit, r.choice([None, x + length() * unit, x + length() * unit])) for i in range(120)]
    b = [(r.choice("xyz"), i, x := r.randint(-500, 60_000) * unit, x + length() * unit) for i in range(120)] + [("x", 500, 0, -1)]
    x, y = spark.createDataFrame(a, "key string, i long, low long, high long"), spark.createDataFrame(b, "key string, j long, start long, stop long")
    got = sorted((r.i, r.j) for r in intervals.overlapping(x, y, ("low", "high"), ("start", "stop")).collect())
    meets = lambda p, q: p[0] == q[0] and q[2] <= q[3] and q[2] <= (p[3] if p[3] is not None else math.inf) and p[2] <= q[3]
    assert got == sorted((p[1], q[1]) for p in a for q in b if meets(p, q))
    points = [(k, n, t) for k, n, t, _ in b] + [("x", 999, None)]
    stabbed = intervals.stabbing(spark.createDataFrame(points, "key string, n long, at long"), x, "at", "low", "high").collect()
    assert sorted((r.i, r.n) for r in stabbed) == sorted((p[1], n) for p in a for k, n, t in points if t is not None and k == p[0] and p[2] <= t <= (p[3] if p[3] is not None else math.inf))
    assert intervals.overlapping(x.limit(0), y, ("low", "high"), ("start", "stop")).count() == 0


def test_a_move_that_stops_before_it_begins_is_evidence(spark):
    s = spark.createDataFrame([(1, 10, 0, 100, ICU), (1, 11, 300, 400, ICU)], "key long, stay_id long, start long, stop long, unit string")
    moves = [(1, 1, 250, 150, WARD), (1, 2, 250, 90, WARD), (1, 3, 350, 320, WARD), (1, 4, 50, None, ICU), (1, 5, None, 200, ICU), (2, 6, 250, 150, WARD), (1, 7, 305, 200, ED)]
    e = episodes.gap_events(episodes.stay_edges(s, 1), spark.createDataFrame(moves, "key long, move_id long, at long, stop long, unit string"))
    assert [[x["move_id"] for x in r.path] for r in e.collect()] == [[4, 1]]


@pytest.mark.parametrize("backwards", [False, True])
def test_a_hot_key_is_carried_in_stretches(spark, monkeypatch, backwards):
    r = random.Random(2)
    rows = [("hot" if i % 2 else r.choice(["a", "b", None]), r.randint(0, 900), i % 3, r.choice([None, i]), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "key string, at long, kind int, v long, id long")
    values = {n: (n, F.col("v")) for n in ("last", "max", "min", "sum", "count")}
    run = lambda: sorted(map(tuple, carry.carried(df, "key", "at", ["kind", "id"], values, backwards).collect()), key=str)
    plain = run()
    monkeypatch.setattr(carry, "STRETCH", 50)
    monkeypatch.setattr(carry, "HEAVY", 30)
    hot, least = carry.hot_keys(df, "key")
    assert least == 50 and "hot" in {x.key for x in hot.collect()} and run() == plain
    for key, at, kind, _, i, last, most, _, total, n in plain[::40]:
        held = sorted((-x[1] if backwards else x[1], x[2], x[4], x[3]) for x in rows if x[0] == key and (-x[1] if backwards else x[1], x[2], x[4]) <= (-at if backwards else at, kind, i))
        own = [x[3] for x in held if x[3] is not None]
        assert (last, most, total, n) == ((own[-1], max(own), sum(own), len(own)) if own else (None, None, None, 0))


def test_units_and_edges(spark):
    m = fn.MINUTE
    s = spark.createDataFrame([(1, 10, 0, 100 * m, ICU), (1, 11, 100 * m, 200 * m, ICU), (1, 12, 260 * m, None, WARD), (1, 13, 900 * m, 990 * m, None), (2, 20, 0, 5, ED)], "key long, stay_id long, start long, stop long, unit string")
    e = episodes.stay_edges(s, m)
    assert {r.stay_id: r.gap_min for r in e.collect()} == {11: 0.0, 12: 60.0, 13: None}
    moves = spark.createDataFrame([(1, 1, 210 * m, 250 * m, "Step ICU"), (1, 2, 205 * m, 215 * m, ICU)], "key long, move_id long, at long, stop long, unit string")
    assert {r.stay_id: [x["move_id"] for x in r.path] for r in episodes.gap_events(e, moves).collect()} == {11: [], 12: [2, 1], 13: []}
    kinds = spark.createDataFrame([("Surgical Intensive Care Unit",), (" Emergency Department ",), ("Ward 3",), ("CCU",), ("",), (None,), ("UNKNOWN",)], "u string").select(episodes.unit_kind(F.col("u"))).collect()
    assert [r[0] for r in kinds] == ["icu", "ed", "ward", "icu", "unknown", "unknown", "unknown"]


def test_observation_end_and_next_after(spark):
    e = spark.createDataFrame([("a", 5), ("a", 9), ("b", 3), ("d", 7)], "key string, e long")
    limits = spark.createDataFrame([("a", 8), ("b", None), ("c", 4), ("d", 9), ("e", None)], "key string, limit long")
    got = {r.key: (r.observed_until, r.end_source, r.after_limit) for r in outcomes.observation_end({"x": e, "y": e}, limits, ["x"]).collect()}
    assert got == {"a": (8, "discharge", True), "b": (3, "clinical_event", False), "c": (4, "discharge", False), "d": (7, "clinical_event", False), "e": (None, "unknown", False)}
    r = random.Random(3)
    ev = [("ab"[r.randrange(2)], r.randrange(40), r.randrange(3)) for _ in range(60)] + [("z", 1, 0)]
    grid = [(k, i, i * 5) for k in "abc" for i in range(9)]
    df = outcomes.next_after(spark.createDataFrame(grid, "key string, k int, t long"), spark.createDataFrame(ev, "key string, e long, v int"), {"zero": F.col("v") == 0, "any": F.lit(True)})
    later = lambda k, t, f: min((e for q, e, v in ev if q == k and e > t and f(v)), default=None)
    assert sorted((x.key, x.k, x.zero, x.any) for x in df.collect()) == sorted((k, i, later(k, t, lambda v: v == 0), later(k, t, lambda v: True)) for k, i, t in grid)


def test_chain_dedup(spark):
    ev = spark.createDataFrame([("a", "v", i, e, p) for i, e, p in [(1, 0, 2), (2, 5, 1), (3, 10, 2), (4, 16, 2)]], "key string, var string, event_id long, e long, p int")
    got = [(r.chain, r.event_id, r.n_merged) for r in episodes.chain_dedup(ev, 5, F.col("p")).orderBy("chain").collect()]
    assert got == [(1, 2, 3), (2, 4, 1)]


def test_identity_of_nested_rows(spark):
    import decimal
    import json

    rows = [
        (1, "é", decimal.Decimal("1.50"), 0.1, True, [("x", 1), ("y", None)], {"b": 1.5, "a": float("nan")}, dt.datetime(2024, 1, 2, 3, 4, 5), b"raw"),
        (2, "e\u0301", decimal.Decimal("1.5"), 0.1, True, [("x", 1), ("y", None)], {"a": float("nan"), "b": 1.5}, dt.datetime(2024, 1, 2, 3, 4, 5), b"raw"),
        (3, None, None, None, None, None, None, None, None),
        (4, "", decimal.Decimal("1E+3"), 1e22, False, [], {}, dt.datetime(2024, 1, 2, 3, 4, 5, 6), b""),
        (5, 'say "x"\n/', decimal.Decimal("-0.000"), -0.0, False, [(None, None)], {"k": 1e-7}, None, b"\xff"),
    ]
    df = spark.createDataFrame(rows, "i int, s string, d decimal(20,4), f double, b boolean, a array<struct<n:string,m:int>>, m map<string,double>, t timestamp_ntz, raw binary")
    got = {r.i: r for r in outcomes.with_ids(df, {c: c for c in df.columns if c != "i"}, "src", text="json").collect()}
    assert got[1].event_id == got[2].event_id and len({r.event_id for r in got.values()}) == 4
    assert got[1].json == '{"source_table":"src","s":"é","d":1.5,"f":0.1,"b":true,"a":[{"m":1,"n":"x"},{"m":null,"n":"y"}],"m":{"a":null,"b":1.5},"t":"2024-01-02T03:04:05","raw":"raw"}'
    assert got[3].json == '{"source_table":"src","s":null,"d":null,"f":null,"b":null,"a":null,"m":null,"t":null,"raw":null}'
    assert json.loads(got[4].json)["d"] == 1000 and json.loads(got[4].json)["f"] == 1e22 and json.loads(got[5].json)["s"] == 'say "x"\n/' and json.loads(got[5].json)["d"] == 0
    ids = outcomes.canonical_ids(df, ["s", "a"], ["s"])
    assert ids.columns == [*df.columns, "raw_id", "canonical_id"] and ids.limit(0).count() == 0


def test_incidence_of_replicates_equals_one_by_one(spark):
    r = random.Random(3)
    rows = [(f"p{r.randint(0, 9)}", r.choice("ab"), r.randint(1, 6), r.randint(0, 2), round(r.random(), 3)) for _ in range(150)]
    s = spark.createDataFrame(rows, "subject string, g string, bin int, cause int, p double")
    drawn = bootstrap.draws(s, 252)
    weight = {}
    for x in drawn.collect():
        for b in x.picks:
            weight[x.block * bootstrap.BLOCK + b, x.subject] = weight.get((x.block * bootstrap.BLOCK + b, x.subject), 0) + 1
    got = {(x.g, x.b): (x.predicted, x.observed) for x in bootstrap.incidences(s, ["g"], drawn, 252, 1, 4, "p").where("b in (0, 5, 251)").collect()}
    assert len(got) == 6
    for (g, b), (predicted, observed) in got.items():
        held = [(t, c, p, weight.get((b, q), 0)) for q, h, t, c, p in rows if h == g]
        left = 1.0
        for t in range(1, 5):
            risk = sum(w for u, _, _, w in held if u >= t)
            left *= 1 - sum(w for u, c, _, w in held if u == t and c == 1) / risk if risk else 1
        assert observed == pytest.approx(1 - left) and predicted == pytest.approx(sum(p * w for _, _, p, w in held) / sum(w for *_, w in held))


def test_draws_are_hashed_in_arrays():
    import hashlib

    import numpy as np

    for first, n, b, count in ((0, 120, 0, 25), (95, 15, 95, 10), (99_990, 30, 1990, 10), (7, 1, 3, 1)):
        want = [[int(hashlib.md5(f"{i}:{r}".encode()).hexdigest()[:8], 16) for i in range(first, first + n)] for r in range(b, b + count)]
        assert bootstrap.hashes(first, n, b, count).tolist() == want
    rank = np.random.default_rng(0).integers(0, 10**6, (2, 1000))
    for size, drawn in ((10**6, rank), (5000, rank % 5000)):
        held = dict(bootstrap._by_shard(drawn.copy(), size))
        assert sum(int(c.sum()) for c in held.values()) == 2000
        assert all(c[i, r % bootstrap.SHARD] == list(drawn[i]).count(r) for i in (0, 1) for r in drawn[i, :50].tolist() for c in [held[r // bootstrap.SHARD]])


def test_weights_of_a_bucket_are_a_product():
    import numpy as np

    r = np.random.default_rng(1)
    counts = r.integers(0, 4, (60, 500)).astype(np.uint8)
    for n in (20, 3000):  # many rows a cell, and few
        subject, cell, weight = r.integers(0, 60, 900), r.integers(0, n, 900), r.integers(1, 3, 900)
        want = np.zeros((n, 500))
        np.add.at(want, cell, counts[subject] * weight[:, None].astype(float))
        assert (bootstrap._product(counts, subject, cell, weight, n, np.float32) == want).all()


def test_cells_move_instead_of_rows(spark):
    r = random.Random(5)
    rows = [(r.randint(0, 40), i % 3, round(r.random(), 1), r.random(), i % 2) for i in range(2000)]
    s = spark.createDataFrame(rows, "subject long, k int, score double, other double, y int")
    drawn = bootstrap.draws(s, 300)
    summed = bootstrap._summed(s, drawn, ["subject"], ["k"], {"n": F.lit(1)}, {"": ["score", "y"]})
    assert summed.count() <= 3 * 2 * bootstrap.LEAST  # keys, blocks and buckets
    both = {(x.stat, x.k, x.b): x.auroc for x in bootstrap.aurocs(s, ["k"], drawn, 300, score={"a": "score", "c": "other"}).collect()}
    assert len(both) == 2 * 3 * 300
    for name, c in (("a", "score"), ("c", "other")):
        assert all(both[name, x.k, x.b] == pytest.approx(x.auroc) for x in bootstrap.aurocs(s, ["k"], drawn, 300, score=c).collect())


def test_several_horizons_of_replicates_in_one_pass(spark):
    r = random.Random(6)
    s = spark.createDataFrame([(r.randint(0, 9), r.choice([1, 2, 3, None]), r.randint(0, 2), r.random()) for _ in range(90)], "subject long, bin int, cause int, p double")
    drawn = bootstrap.draws(s, 20)
    both = {(x.horizon, x.b): (x.predicted, x.observed) for x in bootstrap.incidences(s, [], drawn, 20, 1, [1, 3], "p").collect()}
    for h in (1, 3):
        assert {(h, x.b): (x.predicted, x.observed) for x in bootstrap.incidences(s, [], drawn, 20, 1, h, "p").collect()} == {q: v for q, v in both.items() if q[0] == h}
    assert len(both) == 40


def test_since_last_and_tensors(spark):
    rows = [("r", "c", 3), ("r", "c", 7), ("r", "c", 20), ("s", "c", 0)]
    b = spark.createDataFrame(rows, "id string, var string, bin int")
    d = {(r.id, r.bin): r.delta for r in fitting.since_last(b, ["id"], 24, 48).collect()}
    assert (d["r", 3], d["r", 7], d["r", 8], d["r", 19], d["r", 0], d["r", 2]) == (0, 0, 1, 12, 48, 48) and d["s", 23] == 23 and max(d.values()) <= 48
    long = b.withColumn("value_median", F.col("bin") * 1.0 + 1)
    t = {r.id: r for r in fitting.tensors(long, ["id"], ["c", "none"], 24, recent_first=True).collect()}
    assert t["r"].x[0][7] == 8.0 and t["r"].m[0][7] and not t["r"].m[0][8] and t["r"].d[0][8] == 1 and t["r"].d[1] == [48] * 24
    back = fitting.tensors(long, ["id"], ["c"], 24).where("id = 'r'").first()
    assert back.x[0] == t["r"].x[0][::-1]
    assert all(r["pass"] for r in quality.mask_policy(fitting.tensors(long, ["id"], ["c"], 24)).collect())


def test_scalers_encoders_imputers_weights(spark):
    r = random.Random(3)
    long = spark.createDataFrame([("hr", r.gauss(80, 10) if r.random() < 0.7 else None) for _ in range(400)] + [("rr", r.gauss(20, 2)) for _ in range(100)], "var string, value double")
    s = fitting.scale_channels(long, fitting.fit_channels(long))
    assert all(abs(x[1]) < 1e-9 for x in s.where("value is not null").groupBy("var").avg("scaled").collect())
    assert s.where("value is null and scaled <> 0").count() == 0
    levels = fitting.fit_levels(spark.createDataFrame([("M",)] * 90 + [("F",)] * 9 + [("X",)], "g string"), "g", 0.05)
    got = fitting.encode_levels(spark.createDataFrame([("M",), ("ZZZ",), (None,), ("X",)], "g string"), levels, "g")
    assert sorted(x.level for x in got.collect()) == ["M", "Unknown", "Unknown", "Unknown"]
    w = spark.createDataFrame([(60.0,), (70.0,), (None,), (80.0,)], "w double")
    assert sorted((x.w, x.w_missing) for x in fitting.impute(w, fitting.fit_columns(w, ["w"]), ["w"]).collect()) == [(60.0, 0), (70.0, 0), (70.0, 1), (80.0, 0)]
    u = fitting.subject_weights(spark.createDataFrame([(1,), (1,), (1,), (2,), (2,)], "subject long"))
    assert all(math.isclose(x[1], 1.0) for x in u.groupBy("subject").sum("weight").collect())
    reg = fitting.registry({"scaler": fitting.fit_channels(long)}).collect()
    assert reg[0].fitted_on == "train" and reg[0].content == fitting.registry({"scaler": fitting.fit_channels(long.orderBy("value"))}).first().content
    z = spark.createDataFrame([("v", 0.0)] * 90 + [("v", float(i)) for i in range(10)] + [("v", float("nan"))], "var string, value double")
    passed = fitting.passes(z, fitting.fit_thresholds(z.where("not isnan(value)")))
    assert passed.where("isnan(value) and passed").count() == 0 and passed.where("value = 9 and passed").count() == 0


def test_checks(spark):
    sets = spark.createDataFrame([(1, "train"), (1, "train"), (2, "test")], "s long, name string")
    assert quality.pure_split(sets, "s", "name").first()["pass"]
    assert not quality.pure_split(sets.unionByName(spark.createDataFrame([(1, "test")], sets.schema)), "s", "name").first()["pass"]
    p = spark.createDataFrame([("a", "train"), ("b", "validation")], "x string, fitted_on string")
    assert not quality.fitted_on(p).first()["pass"] and quality.fitted_on(p.where("x = 'a'")).first()["pass"]
    nan = spark.createDataFrame([([[0.0, float("nan")]], [[False, True]]), ([[1.0, 2.0]], [[False, True]])], "x array<array<double>>, m array<array<boolean>>")
    assert {r.assertion: (r["pass"], r.detail) for r in quality.mask_policy(nan).collect()} == {"no_nan": (False, "1"), "masked_is_zero": (False, "1")}


def test_auroc_ties_one_class_and_empty(spark):
    rows = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2), (0, 1, 0.9), (0, 1, 0.8), (1, 0, 0.3), (1, 1, 0.4)], "k int, y int, score double")
    assert evaluate.auroc(rows, []).first().auroc == 1.0
    assert tuple(evaluate.integrated(evaluate.auroc(rows, ["k"]), [], 2).first()) == (1.0, 1.0, 2)
    assert evaluate.integrated(evaluate.auroc(rows, ["k"]), [], 3).first().iauroc is None
    assert evaluate.auroc(rows.withColumn("score", F.lit(0.5)), []).first().auroc == 0.5
    assert evaluate.auroc(rows.where("y = 1"), []).first().auroc is None
    assert evaluate.auroc(rows.limit(0), ["k"]).count() == 0


def test_auroc_equals_pairs(spark):
    r = random.Random(5)
    rows = [(r.randint(0, 1), r.randint(0, 9) / 10, r.randint(1, 3)) for _ in range(150)]
    df = spark.createDataFrame(rows, "y int, score double, w int")
    pos, neg = [(s, w) for y, s, w in rows if y], [(s, w) for y, s, w in rows if not y]
    want = sum(v * w * ((a > b) + (a == b) / 2) for a, v in pos for b, w in neg) / sum(v * w for _, v in pos for _, w in neg)
    assert math.isclose(evaluate.auroc(df, [], weight="w").first().auroc, want)


def test_incidence_and_concordance(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.2), (2, 1, 0.5), (2, 2, 0.7), (3, 0, 0.5), (3, 1, 0.1)]
    df = spark.createDataFrame(rows, "bin int, cause int, score double")
    got = {r.bin: r.incidence for r in evaluate.incidence(df, 1, []).collect()}
    s, want = 1.0, {}
    for t, d, n in ((1, 1, 6), (2, 1, 4), (3, 1, 2)):
        s *= 1 - d / n
        want[t] = 1 - s
    assert all(math.isclose(got[t], want[t]) for t in want)
    for same, tie in ((False, 0.0), (True, 0.5)):
        agree = pairs = 0
        for t, c, x in rows:
            for u, e, y in rows:
                if c == 1 and (u > t or same and u == t and e == 0):
                    pairs += 1
                    agree += (x > y) + (x == y) * tie
        got = evaluate.concordance(df, 1, same_bin=same, tie=tie).first()
        assert math.isclose(got.concordance, agree / pairs) and got.pairs == pairs


def test_bootstrap_draws(spark):
    s = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(50)] + [(3, "c")], "subject long, g string")
    flat = lambda d: sorted((r.block * bootstrap.BLOCK + b, r.subject) for r in d.collect() for b in r.picks)
    d = flat(bootstrap.draws(s, 300))
    assert [sum(b == x for x, _ in d) for b in (0, 299)] == [50, 50] and max(b for b, _ in d) == 299
    assert d == flat(bootstrap.draws(s.repartition(7), 300))
    assert sorted(set(d)) == flat(bootstrap.draws(s, 300, mode="membership"))
    own = bootstrap.draws(s, 20, by=("g",)).collect()
    assert {g: sum(len(r.picks) for r in own if r.g == g) for g in "abc"} == {"a": 500, "b": 500, "c": 20}


@pytest.mark.parametrize("few", [20_000, 5])
def test_replicates_in_arrays_equal_those_one_by_one(spark, monkeypatch, few):
    monkeypatch.setattr(evaluate, "FEW", few)
    r = random.Random(8)
    rows = [(f"p{r.randint(0, 12)}", r.choice(["x", "y", None]), r.randint(0, 1), round(r.random(), 2), r.randint(0, 1)) for _ in range(400)] + [("p1", "z", 0, 0.5, 1), ("q", "z", 0, None, 0)]
    s = spark.createDataFrame(rows, "subject string, g string, k int, score double, y int")
    drawn = bootstrap.draws(s, 255)
    weight = {}
    for d in drawn.collect():
        for b in d.picks:
            weight[d.block * bootstrap.BLOCK + b, d.subject] = weight.get((d.block * bootstrap.BLOCK + b, d.subject), 0) + 1

    def area(b, g, k):
        held = [(x[3] if x[3] is not None else -math.inf, x[4], weight.get((b, x[0]), 0)) for x in rows if x[1] == g and k in (None, x[2])]
        up = sum(w for _, y, w in held if y)
        down = sum(w for _, y, w in held if not y)
        return sum(w * v * (0.5 if p == q else p > q) for p, y, w in held if y for q, z, v in held if not z) / (up * down) if up and down else None

    got = {(x.g, x.b): x.auroc for x in bootstrap.aurocs(s, ["g"], drawn, 255).collect()}
    assert len(got) == 4 * 255
    got = {q: v for q, v in got.items() if q[1] in (0, 7, 249, 250, 254)}
    assert all(v == pytest.approx(area(b, g, None)) if v is not None else area(b, g, None) is None for (g, b), v in got.items())
    mean = {(x.g, x.b): x.iauroc for x in bootstrap.iaurocs(s, ["g"], drawn, 255, 2).where("b in (0, 251)").collect()}
    want = {(g, b): [area(b, g, k) for k in (0, 1)] for g, b in mean}
    assert all(v == (pytest.approx(sum(want[q]) / 2) if None not in want[q] else None) for q, v in mean.items()) and any(mean.values())


def test_no_range_of_skewed_scores_is_large(spark):
    cells = spark.range(60_000).select(F.lit("g").alias("g"), F.pow(F.col("id") / 60_000, 6).alias("s")).unionByName(spark.createDataFrame([("h", 0.5), ("h", 0.7)], "g string, s double"))
    sizes = evaluate.ranged(cells, ["g"], "s").groupBy("g", "__range").count().collect()
    assert max(x["count"] for x in sizes if x.g == "g") < 600 and [x.__getitem__("__range") for x in sizes if x.g == "h"] == [0]
    placed = evaluate.ranged(cells, ["g"], "s").where("g = 'g'").groupBy("__range").agg(F.min("s").alias("a"), F.max("s").alias("b")).orderBy("__range").collect()
    assert all(x.b < y.a for x, y in zip(placed, placed[1:], strict=False))


@pytest.mark.parametrize("few", [20_000, 5])
def test_concordance_equals_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(evaluate, "FEW", few)
    r = random.Random(few)
    rows = [(r.choice([round(r.random() * 50, 1), float(r.randint(1, 9))]), r.randint(0, 2), round(r.random(), 1)) for _ in range(250)]
    df = spark.createDataFrame(rows, "bin double, cause int, score double")
    for same, tie in ((False, 0.0), (True, 0.5)):
        held = [(s, z) for t, c, s in rows if c == 1 for u, e, z in rows if u > t or same and u == t and e == 0]
        x = evaluate.concordance(df, 1, same_bin=same, tie=tie).first()
        assert x.pairs == len(held) and x.concordance == pytest.approx(sum(tie if s == z else s > z for s, z in held) / len(held))
    assert evaluate.concordance(df.limit(0), 1).first().concordance is None


def test_platt_recovers_a_shift(spark):
    r = random.Random(6)
    rows = []
    for _ in range(4000):
        x = r.gauss(0, 1.5)
        rows.append((1 / (1 + math.exp(-x)), int(r.random() < 1 / (1 + math.exp(-(0.7 + 0.5 * x))))))
    a, b = fitting.platt(spark.createDataFrame(rows, "score double, y int"), "score", "y")
    assert abs(a - 0.7) < 0.12 and abs(b - 0.5) < 0.08


def test_parsing_and_scalars(spark):
    df = spark.createDataFrame([("> 89",), (" 42",), ("x1",), ("",), (None,)], "age string")
    v, c = fn.parse_capped(F.col("age"), "> 89", 90)
    assert [tuple(r) for r in df.select(v, c).collect()] == [(90, True), (42, False), (None, False), (None, False), (None, None)]
    one = spark.range(1)
    assert one.select(fn.cut(F.lit(65.0), [0, 65, 80], ["<65", "65-80"])).first()[0] == "<65"
    assert one.select(fn.cut(F.lit(65.0), [0, 65, 80], ["<65", "65-80"], right=False)).first()[0] == "65-80"
    assert [one.select(fn.ceil_div(F.lit(a), 6)).first()[0] for a in (-7, -6, -1, 0, 1, 6, 7)] == [-1, -1, 0, 0, 1, 1, 2]
    assert one.select(fn.micros(F.lit(dt.datetime(1970, 1, 2)).cast("timestamp_ntz"))).first()[0] == fn.DAY
    x = one.select(fn.as_fraction(F.lit(40.0)), fn.fahrenheit_to_celsius(F.lit(212.0)), fn.sigmoid(fn.logit(F.lit(0.25)))).first()
    assert x[0] == 0.4 and x[1] == 100.0 and math.isclose(x[2], 0.25)


def test_cohort_operators(spark):
    c = spark.createDataFrame([(1, 5, 10, 20), (1, 4, 10, 20), (1, 3, 5, 10), (2, 9, None, 70)], "key long, stay_id long, start long, age int")
    got = {r.key: (r.stay_id, r.included) for r in cohort.index_cohort(c, 18, {"old": F.col("age") > 60}).collect()}
    assert got == {1: (4, True), 2: (9, False)}
    t = cohort.track_membership({"a": spark.range(3).withColumnRenamed("id", "key"), "b": spark.range(2, 4).withColumnRenamed("id", "key")})
    assert {r.key: r.rule for r in t.collect()} == {0: "single", 1: "single", 2: "all", 3: "single"}


def test_signal_operators(spark):
    x = [math.sin(i / 3) for i in range(64)]
    df = spark.createDataFrame([(1, "I", x), (1, "II", [2 * v for v in x]), (2, "I", [0.0] * 64), (3, "I", [])], "record long, lead string, signal array<double>")
    assert {r.record: r.passed for r in signals.structural(df, 1, 10).collect()} == {1: True, 2: False, 3: False}
    assert math.isclose(signals.lead_correlation(df).where("record = 1").first().median_r, 1.0)
    assert signals.band_power(df, 64.0, (0.5, 32.0), (0.5, 32.0)).where("record = 1 and lead = 'I'").first().ratio == pytest.approx(1.0)
    assert signals.spikes(df.withColumn("signal", F.transform("signal", lambda v: v + F.when(F.abs(v) > 0.99, 5).otherwise(0)))).where("record = 1").first().n_spikes > 2
    assert signals.median_drift(df, 9).where("record = 2").first().drift == 0.0
    z = signals.zscored(spark.createDataFrame([(1, "I", [1.0, None, float("nan"), 3.0])], df.schema)).first().z
    assert z[1] == z[2] == 0.0 and math.isclose(z[0], -z[3])
    r = signals.reorder(df.where("record = 1"), ["II", "V", "I"], 64).first()
    assert r.lead_mask == [True, False, True] and len(r.signals[0]) == 64 and r.signals[1] == [0.0] * 64


def test_organ_ladders_at_their_bounds(spark):
    names = "ratio double, supported boolean, platelets double, bilirubin double, pressure double, drug_a double, drug_b double, drug_c double, drug_d double, alertness double, creatinine double, urine double"
    base = [400.0, False, 150.0, 1.1, 70.0, 0.0, 0.0, 0.0, 0.0, 15.0, 1.1, 500.0]
    at = {c.split()[0]: i for i, c in enumerate(names.split(", "))}
    cases = [({}, "cardio", 0)] + [
        ({"drug_a": x}, "cardio", w) for x, w in ((0.1, 2), (5.0, 2), (5.1, 3), (15.0, 3), (15.1, 4))
    ] + [({d: x}, "cardio", w) for d in ("drug_c", "drug_d") for x, w in ((0.01, 3), (0.1, 3), (0.11, 4))] + [
        ({"drug_b": 0.1}, "cardio", 2), ({"pressure": 69.9}, "cardio", 1), ({"bilirubin": 12.0}, "liver", 4), ({"bilirubin": 1.2}, "liver", 1), ({"platelets": 20.0}, "coag", 3), ({"ratio": 99.0}, "resp", 2), ({"ratio": 99.0, "supported": True}, "resp", 4),
        ({"ratio": 100.0, "supported": True}, "resp", 3), ({"alertness": 6.0}, "neuro", 3), ({"creatinine": 5.0}, "renal", 4), ({"urine": 199.0}, "renal", 4), ({"urine": 200.0}, "renal", 3),
    ]
    rows = []
    for over, *_ in cases:
        r = list(base)
        for k, v in over.items():
            r[at[k]] = v
        rows.append(r)
    got = outcomes.organ_scores(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + names)).collect()
    assert {r.i: r[part] for r, (_, part, _) in zip(sorted(got, key=lambda r: r.i), cases, strict=True)} == {i: w for i, (_, _, w) in enumerate(cases)}


def test_artifacts_known_later_do_not_count(spark):
    grid = spark.createDataFrame([("a", 0, 100 * H), ("b", 0, 100 * H), ("c", 0, 100 * H), ("d", 0, 100 * H)], "key string, k int, t long")
    known = [("a", 1, 50 * H, True), ("a", 2, 500 * H, True), ("b", 3, 76 * H, True), ("c", 4, 99 * H, False), ("c", 5, 60 * H, True), ("d", 6, 28 * H, True)]
    art = spark.createDataFrame(known, "key string, event_id long, a long, valid boolean")
    got = {r.key: (r.event_id, r.f24, r.f48, r.f72, r.availability) for r in pairing.latest_available(grid, art, {"f24": 24 * H, "f48": 48 * H, "f72": 72 * H}, 24 * H, H).collect()}
    assert got == {"a": (1, False, False, True, "stale"), "b": (3, True, True, True, "available"), "c": (4, False, False, False, "found"), "d": (None, False, False, False, "none")}


def test_attribution_by_its_conditions(spark):
    index = spark.createDataFrame([("a", 1, 100, 200, 80, 104), ("b", 1, 100, None, None, None), ("c", 1, 100, 200, 80, 150)], "key string, stay_id long, start long, stop long, visit_start long, visit_stop long")
    every = spark.createDataFrame([("a", 1, 100, 200), ("a", 2, 85, 90), ("a", 3, 300, None), ("b", 1, 100, None), ("c", 1, 100, 200)], "key string, stay_id long, start long, stop long")
    tests = [("a", i, e) for i, e in enumerate([79, 80, 84, 85, 90, 91, 99, 100, 200, 201, 300, 999])] + [("b", 50, 99), ("b", 51, 100), ("c", 60, 99)]
    got = {r.event_id: r.attribution for r in pairing.attribute(spark.createDataFrame(tests, "key string, event_id long, e long"), index, every, 19, 5).collect()}
    same, before, other, out = "same_hospitalization", "auditable_pre_admission_encounter", "other_encounter", "out_of_window"
    assert [got[i] for i in range(12)] == [out, out, before, other, other, before, before, same, same, out, other, other] and (got[50], got[51], got[60]) == (out, same, out)


def test_carried_flags_and_baselines_equal_brute_force(spark):
    r = random.Random(9)
    ev = [("ab"[r.randrange(2)], i, r.randrange(60), r.randrange(2), r.choice([None, 1.5, 2.5])) for i in range(80)]
    grid = [(k, i, i * 7) for k in "abc" for i in range(9)]
    e = spark.createDataFrame([(k, t, v) for k, _, t, v, _ in ev], "key string, e long, v int")
    got = windows.exists_flags(spark.createDataFrame(grid, "key string, k int, t long"), e, {"one": F.col("v") == 1, "any": F.lit(True)}, 5).collect()
    near = lambda k, t, f: any(q == k and t - 5 <= x < t and f(v) for q, _, x, v, _ in ev)
    assert sorted((x.key, x.k, x.one, x.any) for x in got) == sorted((k, i, near(k, t, lambda v: v == 1), near(k, t, lambda v: True)) for k, i, t in grid)
    h = spark.createDataFrame([(k, i, t, v) for k, i, t, _, v in ev], "key string, stay_id long, start long, value double")
    own = {x.stay_id: (x.n_prior, x.last_value, x.has_prior) for x in cohort.baseline(h.select("key", "stay_id", "start"), h, "value").collect()}
    for k, i, t, _, _ in ev:
        past = sorted((x, j, v) for q, j, x, _, v in ev if q == k and x < t)
        assert own[i] == (len(past), next((v for _, _, v in reversed(past) if v is not None), None), bool(past))


def test_signals_at_their_edges(spark):
    nan = float("nan")
    s = spark.createDataFrame([(1, "I", [1.0, 2.0, nan]), (1, "II", [1.0, 2.0]), (2, "II", [5.0, 6.0, 7.0, 8.0])], "record long, lead string, signal array<double>")
    got = {r.record: (r.signals, r.lead_mask) for r in signals.reorder(s, ["II", "I"], 3).collect()}
    assert got == {1: ([[0.0] * 3, [1.0, 2.0, 0.0]], [False, True]), 2: ([[5.0, 6.0, 7.0], [0.0] * 3], [True, False])}
    m = spark.createDataFrame([(1, 1000.0, 10.0, 50.0, 140.0, 400.0), (2, 0.0, 60.0, 50.0, 10.0, 0.0)], "id int, rr double, p_start double, qrs_start double, qrs_end double, t_end double")
    a, b = sorted(signals.measurements(m).collect(), key=lambda r: r.id)
    assert (a.rate, a.qrs, a.pr, a.qt, a.qtc) == (60.0, 90.0, 40.0, 350.0, 350.0) and (b.rate, b.qrs, b.pr, b.qt, b.qtc) == (None,) * 5
    x = spark.createDataFrame([(1, "I", [0.0] * 5 + [9.0] + [0.0] * 5), (1, "II", [0.0] * 11)], "record long, lead string, signal array<double>")
    assert tuple(signals.spikes(x, least=3).first()) == (1, 3, True) and signals.spikes(x, least=4).first().spiky is False
    assert {r.lead: r.drift for r in signals.median_drift(spark.createDataFrame([(1, "I", [0.0, 1.0, 2.0, 3.0, 9.0])], "record long, lead string, signal array<double>"), 3).collect()} == {"I": 9.0}


def test_prefixes_keep_repeated_rows_and_one_hot_names(spark):
    from waymark.operators import assembly

    p = spark.createDataFrame([(1, "A", "a"), (1, "AB", "ab"), (2, "B", "b")], "version int, prefix string, concept string")
    df = spark.createDataFrame([(1, "ABC"), (1, "ABC"), (2, "ABC"), (3, "A"), (1, None)], "v int, code string")
    got = sorted((r.v, r.code or "", tuple(r.concepts)) for r in assembly.has_prefix(df, "code", "v", p).collect())
    assert got == [(1, "", ()), (1, "ABC", ("a", "ab")), (1, "ABC", ("a", "ab")), (2, "ABC", ()), (3, "A", ())]
    c = spark.createDataFrame([("x",)] * 5 + [("y",)] * 5 + [("z",), (None,)], "c string")
    hot = fitting.one_hot(c, fitting.fit_levels(c, "c", 0.2), "c")
    assert hot.columns == ["c", "c=x", "c=y", "c=Unknown"] and [tuple(r)[1:] for r in hot.where("c = 'z' or c is null").collect()] == [(0, 0, 1)] * 2
    with pytest.raises(ValueError):
        assembly.renamed(c, {"not": "there"})
    r = fitting.registry({"levels": fitting.fit_levels(c, "c", 0.2)})
    assert r.first().content == fitting.registry({"levels": fitting.fit_levels(c, "c", 0.2).orderBy(F.desc("level"))}).first().content


@pytest.mark.parametrize("few", [20_000, 5])
def test_rank_sums_over_ranges_equal_one_sum(spark, monkeypatch, few):
    monkeypatch.setattr(evaluate, "FEW", few)
    r = random.Random(4)
    rows = [(g, round(r.random() ** 4, 5), r.randint(0, 3), r.randint(0, 2)) for g in (None, "a", "b") for _ in range(200)] + [("c", 1.0, 1, 0)]
    cells = spark.createDataFrame(rows, "g string, s double, p int, n int").groupBy("g", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    got = {x.g: x.u for x in evaluate.rank_sums(cells, ["g"], "s", "p", "n", 0.25).collect()}
    assert got == {g: sum(p * m * (0.25 if s == z else s > z) for q, s, p, _ in rows if q == g for h, z, _, m in rows if h == g) for g in got}
    assert [x[0] for x in spark.createDataFrame([(3,), (4,), (11,), (12,)], "k int").select(evaluate.segments(F.col("k"))).collect()] == ["0-3", "4-11", "4-11", "12+"]


def test_largest_share_counts_all_groups(spark):
    rows = [(g, k, i % 2, float(i % 2) + i % 3) for g, n in (("a", 500), ("b", 40), ("c", 30)) for i in range(n) for k in (0,)] + [("d", 0, 0, 1.0)] * 900
    s = spark.createDataFrame(rows, "g string, k int, y int, score double")
    x = evaluate.spread(evaluate.gated_iauroc(s, "g", 30, 5, 1), s, "g", 0.55).first()
    assert x.n_groups == 3 and x.largest_share == pytest.approx(900 / 1470)


def test_quantiles_are_exact_on_ties_skew_and_narrow_brackets(spark, monkeypatch):
    from waymark.operators import quantiles as Q

    r = np.random.default_rng(3)
    values = {"a": np.r_[r.random(4000) ** 6, [0.25] * 3000, -1e300, 1e300], "b": np.r_[r.integers(0, 5, 500).astype(float), np.nan], None: np.array([7.0]), "c": 10.0 ** r.uniform(-300, 300, 20_000)}
    rows = [(g, float(x)) for g, v in values.items() for x in v] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    p = [0.0, 1 / 3, 0.25, 0.5, 0.99, 1.0]
    want = {x["g"]: (x["n"], x["q"]) for x in df.groupBy("g").agg(F.count("x").alias("n"), F.percentile("x", p).alias("q")).where("n > 0").collect()}
    for listed, steps in ((Q.LISTED, 1000), (10, 1000), (10, 20)):  # the last two narrow their brackets once and twice
        monkeypatch.setattr(Q, "STEPS", steps)
        monkeypatch.setattr(Q, "_SHARE", 3 / steps + 2 / Q.ACCURACY)
        got = {x["g"]: (x["n"], x["q"]) for x in Q.quantiles(df, ["g"], ["x"], p, listed).collect()}
        assert got.keys() == want.keys()
        assert all(n == want[g][0] and np.allclose(q, want[g][1], rtol=1e-12, equal_nan=True) for g, (n, q) in got.items())
    assert Q.quantiles(df.limit(0), [], ["x"], p).count() == 0


def test_density_is_that_of_the_tensors_and_reads_no_arrays(spark):
    from waymark.plans import fitting as plans

    d = "/root/testdata/sf0.001"
    m = F.flatten("m")
    want = {(x.key, x.k): x.density for x in plans.tensors(spark, d).select("key", "k", (F.size(F.filter(m, lambda v: v)) / F.size(m)).alias("density")).collect()}
    got = plans.densities(spark, d)
    assert want and {(x.key, x.k): x.density for x in got.collect()} == want
    assert "Arrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_gaps_meet_moves_by_key_and_those_of_crowded_keys_by_cells(spark, monkeypatch):
    r = random.Random(11)
    unit = lambda: r.choice([ICU, WARD, ED, None])
    stays = [(k, 100 * (k or 9) + i, at := r.randint(0, 500), r.choice([None, at + r.randint(0, 60)]), unit()) for k, n in ((1, 12), (2, 3), (None, 3)) for i in range(n)]
    moves = [(r.choice([1, 2, 3, None]), i, at := r.choice([None, r.randint(0, 500), r.randint(0, 500)]), r.choice([None, (at or 0) + r.randint(-20, 80)]), unit()) for i in range(120)]
    s = spark.createDataFrame(stays, "key long, stay_id long, start long, stop long, unit string")
    m = spark.createDataFrame(moves, "key long, move_id long, at long, stop long, unit string")
    e = episodes.stay_edges(s, 1)
    path = lambda df: sorted(((x.key, x.stay_id, [tuple(y) for y in x.path]) for x in df.collect()), key=str)
    plain = episodes.gap_events(e, m)
    assert "Generate" not in plain._jdf.queryExecution().executedPlan().toString()
    want = []
    for x in e.collect():
        held = [y for y in moves if y[0] == x.key is not None and None not in (y[2], x.prev_stop) and y[2] < x.start and (x.start if y[3] is None else y[3]) > x.prev_stop]
        want.append((x.key, x.stay_id, [y[1] for y in sorted(held, key=lambda y: y[2:3] + y[1:2])]))
    got = path(plain)
    assert sorted(((k, i, [y[1] for y in p]) for k, i, p in got), key=str) == sorted(want, key=str) and sum(len(w[2]) for w in want) > 10
    monkeypatch.setattr(episodes, "FEW", 3)
    assert path(episodes.gap_events(e, m)) == got
    whole = episodes.merge_episodes(s, m, 1, [0, 60])
    assert whole.count() == 2 * len(stays)


def test_episode_map_moves_edges_and_moves_once(spark):
    s = spark.createDataFrame([(1, i, 100 * i, 100 * i + 50, ICU) for i in range(5)], "key long, stay_id long, start long, stop long, unit string")
    m = spark.createDataFrame([(1, 1, 60, 90, ICU)], "key long, move_id long, at long, stop long, unit string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = episodes.merge_episodes(s, m, 1, [0, 60])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 2
