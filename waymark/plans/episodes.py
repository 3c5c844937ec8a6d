"""Queries that merge stays to episodes and events to chains."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import DAY, MINUTE, micros
from ..operators import episodes as E
from .fixtures import point_events, sql, stays, table

#: Thresholds in minutes: none, 30 days, 60 days.
TAUS = [0, 43200, 86400]
UNITS = {"1-URGENT": "Medical Intensive Care Unit", "2-HIGH": "CCU", "3-MEDIUM": "Surgical Intensive Care Unit", "4-NOT SPECIFIED": "Medical Intensive Care Unit", "5-LOW": "Medicine"}
R6 = lambda c: F.round(c, 6).alias(c)


def _stays(spark, d):
    """Stays in units named by the order's priority; every third order of a user is shortened to end where the next begins."""
    unit = F.element_at(F.create_map(*[F.lit(x) for p in UNITS.items() for x in p]), F.col("unit"))
    after = F.lead("start").over(Window.partitionBy("key").orderBy("start", "stay_id"))
    stop = F.when(F.col("stop").isNotNull() & (F.col("stay_id") % 3 == 0), F.coalesce(after, F.col("stop"))).otherwise(F.col("stop"))
    return stays(spark, d).withColumn("stop", stop).withColumn("unit", unit)


def _edges(spark, d):
    return E.stay_edges(_stays(spark, d), MINUTE)


def _moves(spark, d):
    """Moves between stays: a line ships to a unit named by its return flag, for some tens of minutes; and at the start of each order a move or two of some minutes around it, some of which stop before they begin."""
    o = table(spark, d, "orders")
    li = table(spark, d, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    unit = F.when(F.col("l_returnflag") == "A", "Medicine").when(F.col("l_returnflag") == "N", "Medical Intensive Care Unit").otherwise("Emergency Department")
    at = micros("l_shipdate")
    a = li.select(F.col("o_custkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("move_id"), at.alias("at"), (at + F.col("l_linenumber").cast("long") * 10 * MINUTE).alias("stop"), unit.alias("unit"))
    start = micros("o_orderdate")
    n = F.col("o_orderkey") % 7
    kind = F.when(n < 3, "Medical Intensive Care Unit").when(n == 3, "Medicine").when(n == 4, "Emergency Department").when(n == 5, "Surgery")
    b = o.where("o_orderkey % 5 <> 0").select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") * 10 + 8).alias("move_id"), (start - 5 * MINUTE).alias("at"), F.when(n != 1, start + F.when(n == 5, F.lit(15 * MINUTE)).otherwise(F.lit(60 * MINUTE))).alias("stop"), kind.alias("unit"))
    c = o.where("o_orderkey % 11 = 1").select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") * 10 + 9).alias("move_id"), (start - 4 * MINUTE).alias("at"), (start + 9 * MINUTE).alias("stop"), F.lit("Medical Intensive Care Unit").alias("unit"))
    inverted = o.where("o_orderkey % 13 = 2").select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") * 10).alias("move_id"), (start - 2 * MINUTE).alias("at"), (start - 6 * MINUTE).alias("stop"), F.lit("Surgery").alias("unit"))
    return a.unionByName(b).unionByName(c).unionByName(inverted)


def _decided(spark, d):
    return E.decided_edges(_stays(spark, d), _moves(spark, d), MINUTE, TAUS)


def stay_edges(spark, d):
    return _edges(spark, d).select("key", "stay_id", "prev_id", R6("gap_min"), E.unit_kind(F.col("prev_unit")).alias("prev_kind"), E.unit_kind(F.col("unit")).alias("kind"))


def gap_event_list(spark, d):
    e = E.gap_events(_edges(spark, d), _moves(spark, d))
    return e.select("key", "stay_id", F.size("path").alias("n_moves"), F.array_join(F.transform("path", lambda m: F.concat_ws("@", m["unit"], m["move_id"].cast("string"))), "|").alias("moves"))


def edge_decision_by_tau(spark, d):
    return _decided(spark, d).select("key", "stay_id", "tau", "status", "evidence", "between", "path_class", "exclusion", "conflict", "decision")


def _map(m):
    return m.select("key", "stay_id", "tau", "episode_seq", "episode_id", "stay_seq", F.floor(F.col("episode_start") / DAY).alias("start_day"), F.floor(F.col("episode_stop") / DAY).alias("stop_day"), R6("gap_max"), "open", "mapping_status", "merge_decision", "unresolved")


def episode_map(spark, d):
    return _map(E.merge_episodes(_stays(spark, d), _moves(spark, d), MINUTE, TAUS))


def episode_map_adjudicated(spark, d):
    s = _stays(spark, d)
    judged = s.where("stay_id % 4 <> 0").select("stay_id", F.when(F.col("stay_id") % 4 == 1, "pending").otherwise("adjudicated").alias("adjudication"), F.when(F.col("stay_id") % 4 == 2, "merged").otherwise("split").alias("final"))
    return _map(E.merge_episodes(s, _moves(spark, d), MINUTE, TAUS, judged))


def chain_dedup(spark, d):
    c = E.chain_dedup(point_events(spark, d), 240 * MINUTE, F.when(F.col("kind") == "stored", 1).otherwise(2))
    return c.select("key", "var", "chain", "event_id", "n_merged", "first_e")


QUERIES = {f.__name__: f for f in (stay_edges, gap_event_list, edge_decision_by_tau, episode_map, episode_map_adjudicated, chain_dedup)}

_STAYS = """st AS (SELECT key, stay_id, start, CASE WHEN stop IS NOT NULL AND stay_id % 3 = 0 THEN coalesce(lead(start) OVER (PARTITION BY key ORDER BY start, stay_id), stop) ELSE stop END AS stop,
 CASE unit WHEN '1-URGENT' THEN 'Medical Intensive Care Unit' WHEN '2-HIGH' THEN 'CCU' WHEN '3-MEDIUM' THEN 'Surgical Intensive Care Unit' WHEN '4-NOT SPECIFIED' THEN 'Medical Intensive Care Unit' WHEN '5-LOW' THEN 'Medicine' END AS unit FROM stays)"""
_EDGES = f"""{_STAYS}, edges AS (SELECT *, (start - prev_stop) / 60000000.0 AS gap_min FROM (SELECT key, stay_id, start, unit, lag(stay_id) OVER w AS prev_id, lag(stop) OVER w AS prev_stop, lag(unit) OVER w AS prev_unit FROM st WINDOW w AS (PARTITION BY key ORDER BY start, stay_id)) WHERE prev_id IS NOT NULL)"""
_KIND = "CASE WHEN {0} IS NULL OR lower(trim({0})) IN ('', 'unknown') THEN 'unknown' WHEN lower({0}) LIKE '%intensive care unit%' OR lower({0}) LIKE '%ccu%' THEN 'icu' WHEN lower({0}) LIKE '%emergency department%' THEN 'ed' ELSE 'ward' END"
_MOVES = """moves AS (SELECT o_custkey AS key, l_orderkey * 10 + l_linenumber AS move_id, epoch_us(l_shipdate) AS at_, epoch_us(l_shipdate) + l_linenumber::BIGINT * 600000000 AS stop,
 CASE l_returnflag WHEN 'A' THEN 'Medicine' WHEN 'N' THEN 'Medical Intensive Care Unit' ELSE 'Emergency Department' END AS unit FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 UNION ALL SELECT o_custkey, o_orderkey * 10 + 8, epoch_us(o_orderdate) - 300000000, CASE WHEN o_orderkey % 7 <> 1 THEN epoch_us(o_orderdate) + CASE WHEN o_orderkey % 7 = 5 THEN 900000000 ELSE 3600000000 END END,
 CASE WHEN o_orderkey % 7 < 3 THEN 'Medical Intensive Care Unit' WHEN o_orderkey % 7 = 3 THEN 'Medicine' WHEN o_orderkey % 7 = 4 THEN 'Emergency Department' WHEN o_orderkey % 7 = 5 THEN 'Surgery' END FROM orders WHERE o_orderkey % 5 <> 0
 UNION ALL SELECT o_custkey, o_orderkey * 10 + 9, epoch_us(o_orderdate) - 240000000, epoch_us(o_orderdate) + 540000000, 'Medical Intensive Care Unit' FROM orders WHERE o_orderkey % 11 = 1
 UNION ALL SELECT o_custkey, o_orderkey * 10, epoch_us(o_orderdate) - 120000000, epoch_us(o_orderdate) - 360000000, 'Surgery' FROM orders WHERE o_orderkey % 13 = 2)"""
_PATHS = f"""hits AS (SELECT e.key, e.stay_id, m.move_id, m.at_, m.stop, m.unit, {_KIND.format('m.unit')} AS kind, row_number() OVER w AS i, last_value(m.stop IGNORE NULLS) OVER (PARTITION BY e.key, e.stay_id ORDER BY m.at_, m.move_id, m.stop, m.unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM edges e JOIN moves m ON e.key = m.key AND m.at_ < e.start AND coalesce(m.stop, e.start) > e.prev_stop WINDOW w AS (PARTITION BY e.key, e.stay_id ORDER BY m.at_, m.move_id, m.stop, m.unit)),
paths AS (SELECT key, stay_id, count(*) AS n, string_agg(concat_ws('@', unit, move_id), '|' ORDER BY i) AS moves, string_agg(coalesce(unit, 'unknown'), '|' ORDER BY i) FILTER (kind <> 'icu') AS between_, bool_or(kind = 'ed') AS ed, bool_or(kind = 'unknown') AS unk, bool_or(kind = 'ward') AS ward,
  coalesce(bool_and(coalesce(stop - at_ <= 1800000000, false)) FILTER (kind = 'ward'), false) AS brief, bool_or(coalesce(at_ < before, false)) AS bad FROM hits GROUP BY key, stay_id)"""
_CLASS = f"""c0 AS (SELECT e.*, coalesce(n, 0) AS n, between_, coalesce(ed, false) AS ed, coalesce(unk, false) AS unk, coalesce(ward, false) OR {_KIND.format('prev_unit')} = 'ward' OR {_KIND.format('unit')} = 'ward' AS ward, coalesce(bad, false) AS bad,
  coalesce(brief, false) AND {_KIND.format('prev_unit')} = 'icu' AND {_KIND.format('unit')} = 'icu' AND NOT ed AND NOT unk AS holder FROM edges e LEFT JOIN paths p ON e.key = p.key AND e.stay_id = p.stay_id),
c1 AS (SELECT *, CASE WHEN gap_min IS NULL THEN 'first_stay' WHEN gap_min < 0 THEN 'overlapping_transfer_records' WHEN gap_min = 0 AND n = 0 THEN 'missing_left_boundary' WHEN gap_min = 0 AND bad THEN 'multiple_conflicting_boundary_events' WHEN gap_min = 0 AND unk THEN 'unknown_careunit'
  WHEN ed THEN 'icu_to_ed_to_icu' WHEN holder THEN 'icu_to_internal_placeholder_to_icu' WHEN ward THEN 'icu_to_ward_to_icu' WHEN gap_min = 0 OR n > 0 THEN 'icu_to_icu' ELSE 'no_transfer_rows' END AS path_class FROM c0),
c2 AS (SELECT *, CASE path_class WHEN 'overlapping_transfer_records' THEN 'overlap' WHEN 'multiple_conflicting_boundary_events' THEN CASE WHEN between_ IS NULL THEN 'direct_icu' ELSE 'via_ward' END WHEN 'unknown_careunit' THEN 'direct_icu' WHEN 'icu_to_icu' THEN 'direct_icu' WHEN 'icu_to_ed_to_icu' THEN 'via_ed'
  WHEN 'icu_to_ward_to_icu' THEN 'via_ward' WHEN 'icu_to_internal_placeholder_to_icu' THEN 'via_internal_placeholder' ELSE 'no_transfer_evidence' END AS evidence,
  CASE WHEN gap_min IS NULL OR gap_min > 0 THEN 'not_applicable' WHEN path_class = 'missing_left_boundary' THEN 'missing_boundary' WHEN path_class IN ('icu_to_icu', 'icu_to_internal_placeholder_to_icu') THEN 'clean' ELSE 'anomaly' END AS status,
  CASE path_class WHEN 'overlapping_transfer_records' THEN 'overlap_records' WHEN 'missing_left_boundary' THEN 'missing_boundary_evidence' WHEN 'multiple_conflicting_boundary_events' THEN 'conflicting_boundary_events' WHEN 'unknown_careunit' THEN 'unknown_careunit_in_path' WHEN 'icu_to_ed_to_icu' THEN 'via_ed' WHEN 'icu_to_ward_to_icu' THEN 'via_ward' END AS exclusion FROM c1),
decided AS (SELECT *, CASE WHEN gap_min IS NULL THEN 'split' WHEN gap_min < 0 THEN 'pending_review' WHEN evidence IN ('via_ward', 'via_ed') THEN 'split' WHEN gap_min = 0 AND status = 'clean' THEN 'merged' WHEN gap_min = 0 THEN 'pending_review'
  WHEN gap_min <= tau AND evidence IN ('direct_icu', 'no_transfer_evidence', 'via_internal_placeholder') THEN 'merged' ELSE 'split' END AS decision FROM c2, (SELECT unnest([0, 43200, 86400])::INT AS tau))"""
_ALL = f"{_EDGES}, {_MOVES}, {_PATHS}, {_CLASS}"
_EARLY = "final AS (SELECT stay_id, tau, gap_min, CASE decision WHEN 'merged' THEN 'merged' ELSE 'split' END AS decision, 'preliminary' AS mapping_status, decision = 'pending_review' AS unresolved FROM decided)"
_LATE = """final AS (SELECT stay_id, tau, gap_min, CASE WHEN decision = 'pending_review' THEN CASE WHEN stay_id % 4 = 2 THEN 'merged' ELSE 'split' END ELSE decision END AS decision,
 CASE WHEN decision <> 'pending_review' THEN 'clean' WHEN stay_id % 4 >= 2 THEN 'adjudicated' ELSE 'unresolved_conservative_split' END AS mapping_status, decision = 'pending_review' AND stay_id % 4 < 2 AS unresolved FROM decided)"""
_MAP = """, seqs AS (SELECT s.*, t.tau, gap_min, decision, mapping_status, unresolved, CAST(sum(CASE WHEN decision = 'merged' THEN 0 ELSE 1 END) OVER (PARTITION BY s.key, t.tau ORDER BY s.start, s.stay_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode_seq
 FROM st s CROSS JOIN (SELECT unnest([0, 43200, 86400])::INT AS tau) t LEFT JOIN final f ON s.stay_id = f.stay_id AND t.tau = f.tau), numbered AS (SELECT *, row_number() OVER (PARTITION BY key, tau, episode_seq ORDER BY start, stay_id) AS stay_seq FROM seqs)"""
_MAPPED = """SELECT key, stay_id, tau, episode_seq, 'EP_' || key || '_' || episode_seq AS episode_id, stay_seq, CAST(floor(min(start) OVER e / 86400000000.0) AS BIGINT) AS start_day, CAST(floor(max(stop) OVER e / 86400000000.0) AS BIGINT) AS stop_day, round(max(gap_min) OVER e, 6) AS gap_max, bool_or(stop IS NULL) OVER e AS open,
 CASE WHEN stay_seq = 1 THEN 'episode_start' ELSE mapping_status END AS mapping_status, CASE WHEN stay_seq = 1 THEN 'episode_start' ELSE decision END AS merge_decision, coalesce(unresolved, false) AS unresolved FROM numbered WINDOW e AS (PARTITION BY key, tau, episode_seq)"""
ORACLES = {
    "stay_edges": sql("stays", more=_EDGES, body=f"SELECT key, stay_id, prev_id, round(gap_min, 6) AS gap_min, {_KIND.format('prev_unit')} AS prev_kind, {_KIND.format('unit')} AS kind FROM edges"),
    "gap_event_list": sql("stays", more=f"{_EDGES}, {_MOVES}, {_PATHS}", body="SELECT e.key, e.stay_id, coalesce(n, 0) AS n_moves, coalesce(moves, '') AS moves FROM edges e LEFT JOIN paths p ON e.key = p.key AND e.stay_id = p.stay_id"),
    "edge_decision_by_tau": sql("stays", more=_ALL, body="SELECT key, stay_id, tau, status, evidence, CASE WHEN path_class IN ('multiple_conflicting_boundary_events', 'unknown_careunit', 'icu_to_ed_to_icu', 'icu_to_internal_placeholder_to_icu', 'icu_to_ward_to_icu') THEN between_ END AS between, path_class, exclusion, path_class = 'multiple_conflicting_boundary_events' AS conflict, decision FROM decided"),
    "episode_map": sql("stays", more=f"{_ALL}, {_EARLY}{_MAP}", body=_MAPPED),
    "episode_map_adjudicated": sql("stays", more=f"{_ALL}, {_LATE}{_MAP}", body=_MAPPED),
    "chain_dedup": sql(
        "ev", more="c AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY key, var ORDER BY e, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain FROM (SELECT *, CASE WHEN e - lag(e) OVER (PARTITION BY key, var ORDER BY e, event_id) <= 14400000000 THEN 0 ELSE 1 END AS nw FROM ev))",
        body="SELECT key, var, chain, arg_min(event_id, (CASE kind WHEN 'stored' THEN 1 ELSE 2 END, e, event_id)) AS event_id, count(*) AS n_merged, min(e) AS first_e FROM c GROUP BY key, var, chain",
    ),
}
