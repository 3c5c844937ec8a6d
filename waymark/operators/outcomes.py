"""Outcomes at landmarks: observation ends, label states, competing risks, organ-style scores and their change."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import unicodedata
from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import contains_any
from .carry import carried
from .episodes import chain_dedup

SEVERE, MODERATE = (0, 1, 2, 3, 4), (0, 1)


def observation_end(sources: dict[str, DataFrame], limits: DataFrame, whitelist: list[str]) -> DataFrame:
    """Per key the end of observation: the last event of the whitelisted sources (frames of key, e), capped at the key's limit, or the limit where there is no event; which of the two it is, the source of the last event, and whether events lie beyond the limit."""
    parts = [df.select("key", "e", F.lit(n).alias("source")) for n, df in sources.items() if n in whitelist]
    last = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.max(F.struct("e", "source")).alias("m"))
    j = limits.join(last, "key", "left")
    e, limit = F.col("m.e"), F.col("limit")
    end = F.when(limit.isNotNull() & (e.isNull() | (limit <= e)), "discharge").when(e.isNotNull(), "clinical_event").otherwise("unknown")
    return j.select("key", F.least(e, limit).alias("observed_until"), end.alias("end_source"), F.col("m.source").alias("last_source"), F.coalesce(e > limit, F.lit(False)).alias("after_limit"))


def next_after(grid: DataFrame, events: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """grid rows (key, k, t) with, for each kind, the time of the next event (key, e) after t for which its condition holds. Grid and events are united and the times carried backwards, so no event meets every landmark of its key."""
    names = list(kinds)
    points = events.select("key", F.col("e").alias("__at"), F.lit(1).alias("__g"), *[F.when(c, F.col("e")).alias(n) for n, c in kinds.items()])
    marks = grid.select("key", "k", "t", F.col("t").alias("__at"), F.lit(0).alias("__g"))
    both = marks.unionByName(points.where(F.col("__at").isNotNull()), allowMissingColumns=True)
    # At equal times landmarks come first, so that what follows them is later.
    return carried(both, "key", "__at", ["__g"], {n: ("last", F.col(n)) for n in names}, backwards=True).select("key", "k", "t", "__g", *names).where("__g = 0").drop("__g")


#: The reasons for which an outcome is known, and those that go to adjudication.
KNOWN, CONFLICTS = ("event", "non_event_observed", "non_event_alive_discharge"), ("status_conflict", "death_time_missing", "invalid_input")


def label_states(rows: DataFrame) -> DataFrame:
    """rows with state, y, status, ascertainable, full_followup and unknown_reason.

    Columns: t, w_end, died (0 or 1), death, transfer, alive_discharge and last_seen (times, null where there is none)
    and seen_after (whether events lie beyond the discharge). The order of the states is part of their meaning.
    Follow-up is full where the whole window was observed: by the last sighting, or by a discharge at its end or later;
    an event or an earlier discharge ends it. Left observation with events beyond the discharge is an anomaly of times.
    """
    c = F.col
    within = lambda x: (c(x) > c("t")) & (c(x) <= c("w_end"))
    state = (
        F.when(c("death") <= c("t"), "invalid_input")
        .when(c("death").isNotNull() & (c("died") == 0), "status_conflict")
        .when(c("death").isNull() & (c("died") == 1), "death_time_missing")
        .when(within("death"), "event")
        .when(within("transfer"), "acute_transfer")
        .when(within("alive_discharge"), "non_event_alive_discharge")
        .when(c("last_seen") >= c("w_end"), "non_event_observed")
        .otherwise("missing_status_left_observation")
    )
    out = rows.withColumn("state", state)
    y = F.when(c("state") == "event", 1).when(c("state").isin(*KNOWN), 0)
    full = (c("state") == "non_event_observed") | ((c("state") == "non_event_alive_discharge") & (c("alive_discharge") >= c("w_end")))
    left = c("state") == "missing_status_left_observation"
    reason = F.when(left & F.coalesce(c("seen_after"), F.lit(False)), "time_anomaly").when(~c("state").isin(*KNOWN), c("state"))
    status = F.when(y == 1, "event").when(y == 0, "non_event").otherwise("unknown")
    return out.withColumns({"y": y.cast("int"), "status": status, "ascertainable": y.isNotNull(), "full_followup": full, "unknown_reason": reason})


def competing_risk(rows: DataFrame, horizon: int) -> DataFrame:
    """rows with cause, at and censor_type within the horizon after t: 1 a death in it, else 3 a transfer, else 2 a discharge, whichever comes first; else 0, censored at the horizon, or when last seen if that is known and earlier."""
    c = F.col
    end = c("t") + horizon
    within = lambda x: (c(x) > c("t")) & (c(x) <= end)
    seen = F.least(end, F.coalesce("last_seen", end))
    out = rows.withColumn("cause", F.when(within("death"), 1).when(within("transfer"), 3).when(within("alive_discharge"), 2).otherwise(0))
    at = F.when(c("cause") == 1, c("death")).when(c("cause") == 3, c("transfer")).when(c("cause") == 2, c("alive_discharge")).otherwise(seen)
    return out.withColumns({"at": at, "censor_type": F.when((c("cause") == 0) & (c("last_seen") < end), "left_observation").otherwise("window_end")})


def event_bin(at: Column, t: Column, cause: Column, width: int, n_bins: int) -> Column:
    """The bin 1..n_bins of an event time; a censored row is in the last bin."""
    b = F.ceil((at - t) / F.lit(float(width))).cast("int")
    return F.when(cause == 0, n_bins).otherwise(F.least(F.greatest(b, F.lit(1)), F.lit(n_bins)))


def adjudication_queue(labelled: DataFrame) -> DataFrame:
    """Labelled rows whose state only a reader of the record can settle, each pending."""
    return labelled.where(F.col("state").isin(*CONFLICTS)).withColumn("adjudication", F.lit("pending"))


def ladder(x: Column, steps: list[tuple[float, int]], below: bool = True, strict: bool = False) -> Column:
    """Points by thresholds, the worst first: x < edge (or x >= edge; x > edge if strict) gives the points; 0 beyond all; null for null."""
    out = F.when(x.isNotNull(), 0)
    for edge, points in reversed(steps):
        out = F.when((x < edge) if below else (x > edge) if strict else (x >= edge), points).otherwise(out)
    return F.when(x.isNotNull(), out)


#: Why a part of the score is unknown.
REASONS = {
    "resp": "pf_pair_missing", "coag": "platelets_missing", "liver": "bilirubin_missing",
    "cardio": "map_and_vaso_missing", "neuro": "gcs_unable_or_missing", "renal": "creatinine_and_urine_missing",
}


def measured(joined: DataFrame, by: list[str], inputs: dict[str, tuple[Callable, Column]], variants: dict[str, dict[str, tuple[int, int]]], name: str = "variant") -> DataFrame:
    """One row for each (by) and variant, with each input: an aggregate of a column over the events with t + low < e <= t + high.

    joined: events with the anchors t of their key. A variant (a window, or a track with a window of its own for some
    inputs) gives each input's (low, high). All aggregates come from one pass; what variants share is taken once.
    """
    e, t = F.col("e"), F.col("t")
    need = {(n, span): f"__{n}_{i}" for i, (n, span) in enumerate(dict.fromkeys((n, v[n]) for v in variants.values() for n in inputs))}
    wide = joined.groupBy(*by).agg(*[inputs[n][0](F.when((e > t + low) & (e <= t + high), inputs[n][1])).alias(c) for (n, (low, high)), c in need.items()])
    rows = F.array(*[F.struct(F.lit(v).alias(name), *[F.col(need[n, spans[n]]).alias(n) for n in inputs]) for v, spans in variants.items()])
    return wide.select(*by, F.explode(rows).alias("__v")).select(*by, "__v.*")


def organ_scores(rows: DataFrame, any_drug: str | None = None) -> DataFrame:
    """Six component scores of 0 to 4, how many are known, a mask and the reasons of the unknown, a status, a total only where all are known, and the sum of those that are.

    Columns: ratio with supported (worse steps need support; null is none), platelets, bilirubin, pressure and four drug
    rates (the worst counts), alertness, creatinine and urine (the worse counts). any_drug: a column that says whether
    any such drug was given, for sources without rates; it counts two points.
    """
    c = F.col
    supported = F.coalesce(c("supported"), F.lit(False))
    resp = F.when(c("ratio").isNull(), None).when((c("ratio") < 100) & supported, 4).when((c("ratio") < 200) & supported, 3).when(c("ratio") < 300, 2).when(c("ratio") < 400, 1).otherwise(0)
    if any_drug:
        drugs = [F.when(c(any_drug), 2), F.lit(None).cast("int")]
    else:
        drugs = [F.when(c(d) > 0, ladder(c(d), steps, below=False, strict=True)) for d, steps in (("drug_a", [(15.0, 4), (5.0, 3), (0.0, 2)]), ("drug_b", [(0.0, 2)]), ("drug_c", [(0.1, 4), (0.0, 3)]), ("drug_d", [(0.1, 4), (0.0, 3)]))]
    parts = {
        "resp": resp, "coag": ladder(c("platelets"), [(20, 4), (50, 3), (100, 2), (150, 1)]), "liver": ladder(c("bilirubin"), [(12.0, 4), (6.0, 3), (2.0, 2), (1.2, 1)], below=False),
        "cardio": F.greatest(F.when(c("pressure").isNotNull(), F.when(c("pressure") < 70, 1).otherwise(0)), *drugs), "neuro": ladder(c("alertness"), [(6, 4), (10, 3), (13, 2), (15, 1)]),
        "renal": F.greatest(ladder(c("creatinine"), [(5.0, 4), (3.5, 3), (2.0, 2), (1.2, 1)], below=False), F.when(c("urine") < 200, 4).when(c("urine") < 500, 3).when(c("urine").isNotNull(), 0)),
    }
    out = rows.withColumns({k: v.cast("int") for k, v in parts.items()})
    known = reduce(lambda a, b: a + b, [c(k).isNotNull().cast("int") for k in parts])
    mask = F.concat(*[F.when(c(k).isNull(), "1").otherwise("0") for k in parts])
    reasons = F.array_compact(F.array(*[F.when(c(k).isNull(), REASONS[k]) for k in parts]))
    held = reduce(lambda a, b: a + b, [F.coalesce(k, F.lit(0)) for k in parts])
    out = out.withColumns({"n_known": known, "missing": mask, "reasons": reasons, "known_sum": held})
    status = F.when(c("n_known") == len(parts), "complete_6_of_6").otherwise(F.concat(F.lit("partial_"), c("n_known").cast("string"), F.lit("_of_6")))
    return out.withColumns({"status": status, "total": F.when(c("n_known") == len(parts), c("known_sum"))})


def score_rise(scores: DataFrame, by: list[str], least: int = 2, name: str = "variant", before: str = "baseline", after: str = "qualifying", parts: int = 6) -> DataFrame:
    """Per row of `by` the scores of two windows (by, variant, known_sum, n_known) and the rise between them.

    A baseline of which a part is unknown is assumed to be zero; the rise over what was observed is known only where
    both windows are complete; the later window counts with what is known of it, and a missing window with zero.
    """
    one = lambda w, c: F.coalesce(F.max(F.when(F.col(name) == w, F.col(c))), F.lit(0))
    g = scores.groupBy(*by).agg(*[one(w, c).alias(f"{p}_{c}") for w, p in ((before, "b"), (after, "q")) for c in ("known_sum", "n_known")])
    complete, both = F.col("b_n_known") == parts, (F.col("b_n_known") == parts) & (F.col("q_n_known") == parts)
    base = F.when(complete, F.col("b_known_sum")).otherwise(0)
    delta = F.col("q_known_sum") - base
    return g.select(
        *by, base.alias("baseline"), F.when(complete, "observed_complete").otherwise("assumed_zero_by_phenotype_rule").alias("baseline_source"), (~complete).alias("assumed"), F.col("b_n_known").alias("baseline_known"),
        F.col("q_known_sum").alias("qualifying"), F.col("q_n_known").alias("qualifying_known"), F.when(both, F.col("q_known_sum") - F.col("b_known_sum")).alias("delta_observed"), delta.alias("delta"), (delta >= least).alias("qualifies"),
    )


def canonical_value(x: object) -> object:
    """A value as JSON has it: numbers as they are (decimals exact, without trailing zeros), NaN and infinities as null, times in ISO form, bytes as text, keys of nested rows and maps in order (an empty map is an empty list)."""
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, dt.datetime | dt.date):
        return x.isoformat()
    if isinstance(x, bytes):
        return x.decode("utf-8", "replace")
    if isinstance(x, dict):
        return {str(k): canonical_value(x[k]) for k in sorted(x, key=str)}
    if isinstance(x, list):
        # Of a map Arrow makes a list of pairs.
        pairs = bool(x) and all(isinstance(p, tuple) for p in x)
        return canonical_value(dict(x)) if pairs else [canonical_value(v) for v in x]
    return x


def canonical_text(row: dict) -> str:
    """The row as JSON without spaces, fields in their order, in Unicode's composed form."""
    import json

    def text(x: object) -> str:
        if isinstance(x, Decimal):
            return format(x.normalize(), "f") if x else "0"
        if isinstance(x, dict):
            return "{" + ",".join(f"{text(k)}:{text(v)}" for k, v in x.items()) + "}"
        if isinstance(x, list):
            return "[" + ",".join(map(text, x)) + "]"
        return json.dumps(x, ensure_ascii=False, allow_nan=False)

    return unicodedata.normalize("NFC", text({k: canonical_value(v) for k, v in row.items()}))


def with_ids(df: DataFrame, fields: dict[str, str], source: str | None = None, name: str = "event_id", text: str | None = None) -> DataFrame:
    """df with the SHA-256 of the canonical JSON of these fields (name to column, of any type, nested ones too), after the source's name if there is one, and with that text itself if it is named. Null and absent are one; null is not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head = {} if source is None else {"source_table": source}
            texts = [canonical_text(head | dict(zip(fields, row, strict=True))) for row in zip(*[b[c].to_pylist() for c in fields.values()], strict=True)]
            added = [pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())] + ([pa.array(texts, pa.string())] if text else [])
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, name, *([text] if text else [])])

    added = [T.StructField(n, T.StringType()) for n in (name, *([text] if text else []))]
    return df.mapInArrow(run, T.StructType([*df.schema, *added]))


def canonical_ids(df: DataFrame, fields: list[str], strings: list[str]) -> DataFrame:
    """df with raw_id, the identity of the fields as they are, and canonical_id, of the fields with these strings trimmed and lower-cased. Fields may be structs, arrays, maps and decimals; null is not empty."""
    plain = df.withColumns({f"__{f}": F.lower(F.trim(F.col(f))) for f in strings})
    both = with_ids(with_ids(plain, {f: f for f in fields}, name="raw_id"), {f: f"__{f}" if f in strings else f for f in fields}, name="canonical_id")
    return both.drop(*[f"__{f}" for f in strings])


def dedup_counts(df: DataFrame) -> DataFrame:
    """Per canonical_id: rows and distinct raw variants; the rows of all sum to the source's."""
    raw = df.groupBy("canonical_id", "raw_id").agg(F.count(F.lit(1)).alias("n"))
    return raw.groupBy("canonical_id").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_variants"))


def unify(sources: list[tuple[str, DataFrame, list[str]]], text: str) -> DataFrame:
    """Events whose text contains any of a source's needles, each event under the first source that takes it."""
    parts = [df.where(contains_any(F.col(text), needles)).withColumn("source", F.lit(n)).withColumn("priority", F.lit(i)) for i, (n, df, needles) in enumerate(sources)]
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("key", "event_id", "e").agg(F.min_by("source", "priority").alias("source"), F.min("priority").alias("priority"))


def unify_chains(sources: list[tuple[str, DataFrame, list[str]]], text: str, within: int) -> DataFrame:
    """The unified events, of which those of one key that follow one another within `within` are one: the best by source, then the earliest, with how many it stands for."""
    return chain_dedup(unify(sources, text).withColumn("var", F.lit("unified")), within, F.col("priority")).drop("var")


def coverage(df: DataFrame, group: str, covered: Column, least: float) -> DataFrame:
    """Per group and for all: rows, covered rows, their share, and whether it is enough, from one pass by grouping sets."""
    out = df.withColumn("__c", covered.cast("long")).rollup(group).agg(F.grouping(group).alias("__all"), F.count(F.lit(1)).alias("n"), F.sum("__c").alias("n_covered"))
    return out.select(F.when(F.col("__all") == 1, "ALL").otherwise(F.col(group)).alias(group), "n", "n_covered", F.round(F.col("n_covered") / F.col("n"), 6).alias("share"), (F.col("n_covered") >= least * F.col("n")).alias("enough"))
