"""Episodes: adjacent stays of one subject, merged by gap, transfer path and adjudication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stored
from .intervals import overlapping

#: Kinds of care unit by substring, in order; any other name is a ward, and no name is unknown.
UNIT_KINDS = {"icu": ("intensive care unit", "ccu"), "ed": ("emergency department",)}
PLACEHOLDER_MINUTES = 30
#: Keys of more edges meet their moves by cells of time; those of others meet all of the key's, as many pairs as moves times FEW at most.
FEW = 256


def unit_kind(name: Column, kinds: dict[str, tuple[str, ...]] = UNIT_KINDS, other: str = "ward") -> Column:
    """The first kind with a substring in the trimmed, lower-cased name; unknown for null, blank and the name unknown; else `other`."""
    text = F.lower(F.trim(name))
    out = F.lit(other)
    for kind, parts in reversed(kinds.items()):
        hit = F.lit(False)
        for p in parts:
            hit |= text.contains(p)
        out = F.when(hit, kind).otherwise(out)
    return F.when(name.isNull() | text.isin("", "unknown"), "unknown").otherwise(out)


def _followed(stays: DataFrame, minute: int) -> DataFrame:
    """Each stay with the one before it in its key and the gap in minutes; null for the first, and the gap after an open stay."""
    w = Window.partitionBy("key").orderBy("start", "stay_id")
    e = stays.select("key", "stay_id", "start", "stop", "unit", F.lag("stay_id").over(w).alias("prev_id"), F.lag("stop").over(w).alias("prev_stop"), F.lag("unit").over(w).alias("prev_unit"))
    return e.withColumn("gap_min", F.when(F.col("prev_id").isNotNull(), (F.col("start") - F.col("prev_stop")) / F.lit(float(minute))))


def stay_edges(stays: DataFrame, minute: int) -> DataFrame:
    """Each stay but the first of its key, with the stay before it and the gap in minutes; a gap after an open stay is null."""
    return _followed(stays, minute).where("prev_id is not null").drop("stop")


def gap_events(edges: DataFrame, moves: DataFrame, kinds: dict[str, tuple[str, ...]] = UNIT_KINDS) -> DataFrame:
    """edges with `path`: the moves (key, move_id, at, stop, unit) that overlap the gap (prev_stop, start), in order, with the kind of their unit; a move without a stop goes on.

    A move overlaps if it begins before the gap's end and stops after its start, so one whose stop lies before its
    beginning, an anomaly that is evidence too, overlaps where both lie in the gap.
    """
    edges = stored(edges)
    own = edges.groupBy("key").agg(F.count(F.lit(1)).alias("__n"))
    crowded = own.where(F.col("__n") > FEW).select("key") if (own.agg(F.max("__n")).first()[0] or 0) > FEW else None
    m = moves.where(F.col("at").isNotNull()).select("key", "at", F.col("stop").alias("m_stop"), F.col("unit").alias("m_unit"), "move_id")
    within = (F.col("at") < F.col("start")) & F.coalesce(F.col("m_stop") > F.col("prev_stop"), F.col("start") > F.col("prev_stop"))
    step = F.struct("at", "move_id", F.col("m_stop").alias("stop"), F.col("m_unit").alias("unit"), unit_kind(F.col("m_unit"), kinds).alias("kind"))
    if crowded is None:
        return _met(edges, m, within, step)
    few, many = (lambda df: df.join(crowded, "key", "left_anti")), (lambda df: df.join(crowded, "key", "left_semi"))
    end = F.when(F.col("m_stop").isNotNull(), F.greatest("at", "m_stop"))
    e = many(edges).where(F.col("prev_stop").isNotNull()).select("key", "stay_id", "prev_stop", "start", F.least("prev_stop", "start").alias("__low"), F.greatest("prev_stop", "start").alias("__high"))
    met = overlapping(e, many(m).withColumns({"__from": F.least("at", "m_stop"), "__to": end}), ("__low", "__high"), ("__from", "__to")).where(within)
    path = met.groupBy("key", "stay_id").agg(F.array_sort(F.collect_list(step)).alias("path"))
    by_cells = many(edges).join(path, ["key", "stay_id"], "left").withColumn("path", F.coalesce("path", F.array().cast(_PATH)))
    return _met(few(edges), few(m), within, step).unionByName(by_cells)


_PATH = "array<struct<at:bigint,move_id:bigint,stop:bigint,unit:string,kind:string>>"


def _met(edges: DataFrame, moves: DataFrame, within: Column, step: Column) -> DataFrame:
    """edges with `path`: their key's moves for which within holds, in order. Both sides move once, by key, and stay where they are: the path is gathered where they meet."""
    m = moves.withColumnRenamed("key", "__key")
    met = edges.withColumn("__row", F.monotonically_increasing_id()).join(m, (F.col("key") == F.col("__key")) & F.col("prev_stop").isNotNull() & within, "left")
    held = [c for c in edges.columns if c != "key"]
    g = met.groupBy("key", "__row").agg(*[F.first(c).alias(c) for c in held], F.collect_list(F.when(F.col("__key").isNotNull(), step)).alias("path"))
    return g.select(*edges.columns, F.array_sort("path").cast(_PATH).alias("path"))


def path_facts(path: Column, left: Column, right: Column, minute: int) -> dict[str, Column]:
    """What the moves between two stays of these kinds show: how many there are, whether one is an emergency visit, unknown or a ward, whether only brief wards lie between two ICUs, whether moves overlap, and the units that are no ICU."""
    has = lambda k: F.exists(path, lambda m: m["kind"] == k)
    inner = F.filter(path, lambda m: m["kind"] == "ward")
    brief = F.forall(inner, lambda m: F.coalesce(m["stop"] - m["at"] <= PLACEHOLDER_MINUTES * minute, F.lit(False)))
    walk = F.struct(F.lit(None).cast("long").alias("stop"), F.lit(False).alias("bad"))
    overlap = F.aggregate(path, walk, lambda s, m: F.struct(F.coalesce(m["stop"], s["stop"]).alias("stop"), (s["bad"] | F.coalesce(m["at"] < s["stop"], F.lit(False))).alias("bad")), lambda s: s["bad"])
    out = F.transform(F.filter(path, lambda m: m["kind"] != "icu"), lambda m: F.coalesce(m["unit"], F.lit("unknown")))
    return {
        "__size": F.size(path), "__ed": has("ed"), "__unknown": has("unknown"), "__ward": has("ward") | (left == "ward") | (right == "ward"), "__between": F.array_join(out, "|"),
        "__brief": (left == "icu") & (right == "icu") & (F.size(inner) > 0) & brief, "__overlap": overlap, "__some": F.size(out) > 0,
    }


def path_evidence(gap_min: Column) -> Column:
    """What the facts of path_facts say of a gap: a struct of status, evidence, between (the units that are no ICU), path_class, exclusion and conflict.

    A stay without a known end before it has no path. A negative gap is an overlap. At a gap of zero the path must be
    clean to merge: ICU to ICU directly, or through wards of PLACEHOLDER_MINUTES at most; no moves at all, moves that
    overlap, unknown units, an emergency visit or a ward are each a finding of their own. At a positive gap only the
    kind of path counts. The names are fixed values.
    """
    size, ed, unknown, ward, conflict, some = (F.col(c) for c in ("__size", "__ed", "__unknown", "__ward", "__overlap", "__some"))
    placeholder = F.col("__brief") & ~ed & ~unknown
    between = F.when(some, F.col("__between"))
    none = F.lit(None).cast("string")

    def found(status, evidence, units, path_class, exclusion, bad=False) -> Column:
        cols = [x if isinstance(x, Column) else F.lit(x).cast("string") for x in (status, evidence, units, path_class, exclusion)]
        return F.struct(*[c.alias(n) for c, n in zip(cols, ("status", "evidence", "between", "path_class", "exclusion"), strict=True)], F.lit(bad).alias("conflict"))

    zero = gap_min == 0
    via_ed = found(F.when(zero, "anomaly").otherwise("not_applicable"), "via_ed", between, "icu_to_ed_to_icu", "via_ed")
    via_ward = found(F.when(zero, "anomaly").otherwise("not_applicable"), "via_ward", between, "icu_to_ward_to_icu", "via_ward")
    brief_stop = found(F.when(zero, "clean").otherwise("not_applicable"), "via_internal_placeholder", between, "icu_to_internal_placeholder_to_icu", none)
    return (
        F.when(gap_min.isNull(), found("not_applicable", "no_transfer_evidence", none, "first_stay", none))
        .when(gap_min < 0, found("anomaly", "overlap", none, "overlapping_transfer_records", "overlap_records"))
        .when(zero & (size == 0), found("missing_boundary", "no_transfer_evidence", none, "missing_left_boundary", "missing_boundary_evidence"))
        .when(zero & conflict, found("anomaly", F.when(some, "via_ward").otherwise("direct_icu"), between, "multiple_conflicting_boundary_events", "conflicting_boundary_events", True))
        .when(zero & unknown, found("anomaly", "direct_icu", between, "unknown_careunit", "unknown_careunit_in_path"))
        .when(ed, via_ed).when(placeholder, brief_stop).when(ward, via_ward)
        .when(zero, found("clean", "direct_icu", none, "icu_to_icu", none))
        .when(size > 0, found("not_applicable", "direct_icu", none, "icu_to_icu", none))
        .otherwise(found("not_applicable", "no_transfer_evidence", none, "no_transfer_rows", none))
    )


def decide(gap_min: Column, tau: Column, status: Column, evidence: Column) -> Column:
    """split without a gap; pending_review at an overlap; split through a ward or an emergency visit; at a gap of zero merged if clean, else pending_review; merged within tau minutes by direct, brief or no evidence; else split."""
    return (
        F.when(gap_min.isNull(), "split").when(gap_min < 0, "pending_review").when(evidence.isin("via_ward", "via_ed"), "split")
        .when((gap_min == 0) & (status == "clean"), "merged").when(gap_min == 0, "pending_review")
        .when((gap_min <= tau) & evidence.isin("direct_icu", "no_transfer_evidence", "via_internal_placeholder"), "merged").otherwise("split")
    )


def by_tau(edges: DataFrame, taus: list[int]) -> DataFrame:
    """edges once for each threshold in minutes."""
    return edges.withColumn("tau", F.explode(F.array(*[F.lit(t).cast("int") for t in taus])))


def decided_edges(stays: DataFrame, moves: DataFrame, minute: int, taus: list[int], kinds: dict[str, tuple[str, ...]] = UNIT_KINDS) -> DataFrame:
    """The edges between stays, once for each threshold, with their path's evidence and the preliminary decision."""
    return _decided(stay_edges(stays, minute), moves, minute, taus, kinds)


def _decided(edges: DataFrame, moves: DataFrame, minute: int, taus: list[int], kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    e = gap_events(edges, moves, kinds).withColumns({"__left": unit_kind(F.col("prev_unit"), kinds), "__right": unit_kind(F.col("unit"), kinds)})
    e = e.withColumns(path_facts(F.col("path"), F.col("__left"), F.col("__right"), minute)).withColumn("__p", path_evidence(F.col("gap_min")))
    e = by_tau(e.select(*edges.columns, "path", "__p.*"), taus)
    return e.withColumn("decision", decide(F.col("gap_min"), F.col("tau"), F.col("status"), F.col("evidence")))


def adjudicated(edges: DataFrame, adjudications: DataFrame | None = None) -> DataFrame:
    """edges with their final decision, merged or split, mapping_status and unresolved.

    A pending edge takes its adjudication (stay_id, adjudication, final: merged or split where adjudicated); without one
    it is split, as unresolved_conservative_split. Without any adjudications the map is preliminary.
    """
    if adjudications is None:
        return _final(edges, False)
    return _final(edges.join(_judged(adjudications), "stay_id", "left"), True).drop("__d")


def _judged(adjudications: DataFrame) -> DataFrame:
    return adjudications.select("stay_id", F.when((F.col("adjudication") == "adjudicated") & F.col("final").isin("merged", "split"), F.col("final")).alias("__d"))


def _final(edges: DataFrame, judged: bool) -> DataFrame:
    """edges with their final decision; where there are adjudications, __d is that of a pending edge."""
    pending = F.col("decision") == "pending_review"
    if not judged:
        return edges.withColumns({"decision": F.when(F.col("decision") == "merged", "merged").otherwise("split"), "mapping_status": F.lit("preliminary"), "unresolved": pending})
    return edges.withColumns({
        "decision": F.when(pending, F.coalesce("__d", F.lit("split"))).otherwise(F.col("decision")),
        "mapping_status": F.when(pending & F.col("__d").isNull(), "unresolved_conservative_split").when(pending, "adjudicated").otherwise("clean"),
        "unresolved": pending & F.col("__d").isNull(),
    })


def episode_map(stays: DataFrame, edges: DataFrame, prefix: str = "EP") -> DataFrame:
    """stays once for each threshold tau of the final edges, with episode_seq, episode_id, stay_seq, the episode's start, stop and greatest gap, and whether it is open. A decision other than merged starts a new episode."""
    taus = edges.select("tau").distinct()
    j = stays.join(taus, how="cross").join(edges.select("stay_id", "tau", "decision", "gap_min", "path_class", "mapping_status", "unresolved"), ["stay_id", "tau"], "left")
    return _mapped(j, prefix)


def _mapped(j: DataFrame, prefix: str) -> DataFrame:
    w = Window.partitionBy("key", "tau").orderBy("start", "stay_id")
    new = F.when(F.col("decision") == "merged", 0).otherwise(1)
    j = j.withColumn("episode_seq", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    e = Window.partitionBy("key", "tau", "episode_seq")
    j = j.withColumn("stay_seq", F.row_number().over(e.orderBy("start", "stay_id")))
    first = F.col("stay_seq") == 1
    return j.select(
        "key", "stay_id", "tau", "episode_seq", F.concat_ws("_", F.lit(prefix), F.col("key").cast("string"), F.col("episode_seq").cast("string")).alias("episode_id"),
        "stay_seq", F.min("start").over(e).alias("episode_start"), F.max("stop").over(e).alias("episode_stop"), F.max("gap_min").over(e).alias("gap_max"), F.max(F.col("stop").isNull()).over(e).alias("open"),
        F.when(first, "episode_start").otherwise(F.col("mapping_status")).alias("mapping_status"), F.when(first, "episode_start").otherwise(F.col("decision")).alias("merge_decision"), F.coalesce("unresolved", F.lit(False)).alias("unresolved"),
    )


def merge_episodes(stays: DataFrame, moves: DataFrame, minute: int, taus: list[int], adjudications: DataFrame | None = None, kinds: dict[str, tuple[str, ...]] = UNIT_KINDS, prefix: str = "EP") -> DataFrame:
    """The episode map of stays (key, stay_id, start, stop, unit) from the moves between them, once for each threshold in minutes."""
    # Every stay takes its own edge along, the first of a key one without a gap, so that edges need not be joined to stays again.
    every = _followed(stays, minute)
    if adjudications is not None:
        every = every.join(_judged(adjudications), "stay_id", "left")
    return _mapped(_final(_decided(every, moves, minute, taus, kinds), adjudications is not None), prefix)


def chain_dedup(events: DataFrame, within: int, priority: Column) -> DataFrame:
    """Islands of events of one (key, var), each within `within` of the one before; of each island the best by priority, then time, stays, with how many were merged."""
    w = Window.partitionBy("key", "var").orderBy("e", "event_id")
    new = F.coalesce((F.col("e") - F.lag("e").over(w) > within).cast("int"), F.lit(1))
    chained = events.withColumn("__new", new).withColumn("chain", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    best = F.min_by("event_id", F.struct(priority.alias("p"), "e", "event_id"))
    return chained.groupBy("key", "var", "chain").agg(best.alias("event_id"), F.count(F.lit(1)).alias("n_merged"), F.min("e").alias("first_e"))
