"""Operator 2: mixing sources to target weights by a time-varying curriculum.

A source's share of the mix follows a piecewise linear schedule over training time 0..1. The schedule's integral,
scaled to the source's target, is its cumulative token demand D(t). The documents of a source queue in the order of
md5(doc_id); a document whose middle word is the source's c-th word is trained on at the t where D(t) = c. When the
queue is used up it starts again (a second pass), and the last document taken is cut where the target ends. The mix
is range-sorted by position. Queues are numbered by prefix sums in two levels (a sum for each source and hash bucket,
then within a bucket), so that a hot source is not one task.

Targets are set on a table of one row per source, so that part's work grows with the number of sources alone.

Defined results: a null or empty text has no words and takes none; a null source is a source of its own, after all
others; a null doc_id queues first; repeated rows are taken one after the other; a very long text is a long document,
cut like any other where its source's target ends; columns of docs pass through mixed(), names that begin with __ are
this operator's; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import row_key, stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MAX_PASSES = 1.5, 2
#: For the sources in turn: the schedule's height at times 0, 1/2 and 1.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
TIMES = (0.0, 0.5, 1.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_passes: int = MAX_PASSES) -> DataFrame:
    """From (source, source_size): rank, weight and target. Sources whose weighted part exceeds max_passes times their size stop there; the rest share what is left by weight."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(max_passes))
    fill = Window.orderBy(F.col("ratio"), F.col("rank"))
    before, ahead = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    # The level at which all sources from this one on are not above their caps; the true level is the first that fits.
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(ahead)
    steps = ranked.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(whole)
    return steps.withColumn("fit", fits["level"]).select("source", "source_size", "rank", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("fit"), F.col("cap"))).alias("target"))


def position_of(share: Column, rank: Column, schedules=SCHEDULES, times=TIMES) -> Column:
    """The time at which a source of this rank has had this share of its target: its integrated schedule, inverted."""
    out = F.lit(None).cast("double")
    for k, heights in enumerate(schedules):
        areas = [(a + b) / 2 * (v - u) for a, b, u, v in zip(heights, heights[1:], times, times[1:], strict=False)]
        need, start, branch = share * sum(areas), 0.0, F.lit(times[-1])
        parts = []
        for a, b, u, v, area in zip(heights, heights[1:], times, times[1:], areas, strict=False):
            x, slope = need - F.lit(start), (b - a) / (v - u)
            t = x / F.lit(a) if slope == 0 else (F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * x, F.lit(0.0))) - F.lit(a)) / F.lit(slope)
            parts.append((start + area, F.lit(u) + t))
            start += area
        for end, t in reversed(parts):
            branch = F.when(need <= F.lit(end), t).otherwise(branch)
        out = F.when(rank % len(schedules) == k, branch).otherwise(out)
    return out


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_passes: int = MAX_PASSES) -> DataFrame:
    """docs plus __size, __source_size, __target, __taken and __passes (pass, position, words), range-sorted by the first position; documents not taken come last."""
    keyed = docs.withColumn("__size", word_count(F.col("text"))).withColumn("__turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    queue = stored(keyed.select("doc_id", "source", F.col("__size").alias("size"), F.col("__turn").alias("turn"), row_key("text").alias("th")), "mix-queue")
    sizes = queue.groupBy("source").agg(F.sum("size").alias("source_size"))
    bucket = F.substring("turn", 1, 3)
    parts = queue.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("part"))
    starts = parts.select("source", "bucket", F.coalesce(F.sum("part").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("bucket_start"))
    plan = source_targets(sizes, weights, share, max_passes).alias("p").join(starts.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select("s.source", "bucket", "bucket_start", "source_size", "rank", "target")
    within = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)
    turns = queue.withColumn("bucket", bucket).withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = turns.alias("q").join(plan.alias("p"), F.col("q.source").eqNullSafe(F.col("p.source")) & (F.col("q.bucket") == F.col("p.bucket")))
    start, quota = F.col("p.bucket_start") + F.col("q.before"), F.floor("p.target")

    def one(k: Column) -> Column:
        words = F.greatest(F.lit(0), F.least(F.col("q.size"), quota - k * F.col("p.source_size") - start)).cast("long")
        middle = (k * F.col("p.source_size") + start).cast("double") + words / F.lit(2)
        return F.struct(k.alias("pass"), position_of(F.try_divide(middle, F.col("p.target")), F.col("p.rank")).alias("position"), words.alias("words"))

    passes = F.filter(F.array(*[one(F.lit(k)) for k in range(max_passes)]), lambda x: x["words"] > 0)
    taken = joined.select("q.doc_id", F.col("q.source").alias("source"), F.col("q.th").alias("th"), F.col("q.size").alias("__size"), F.col("p.source_size").alias("__source_size"), F.col("p.target").alias("__target"), passes.alias("__passes"))
    taken = taken.withColumn("__taken", F.aggregate("__passes", F.lit(0).cast("long"), lambda a, x: a + x["words"]))
    return taken


def in_order(taken: DataFrame) -> DataFrame:
    """Range-sorted by the first position; documents not taken come last."""
    first = taken.withColumn("__first", F.try_element_at(F.col("__passes.position"), F.lit(1)))
    return first.repartitionByRange(F.col("__first").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("__first").asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in its order: a row of docs' columns for each pass that takes words of a document, the last document of a source cut to the words taken, n_chars to match."""
    same = Window.partitionBy("__key").orderBy("__key")
    keyed = docs.withColumn("__th", row_key("text")).withColumn("__key", row_key("doc_id", "source", "__th")).drop("__th").withColumn("__copy", F.row_number().over(same))
    taken = mix(docs, **options).where("__taken > 0").select(row_key("doc_id", "source", "th").alias("__key"), "__size", "__passes").withColumn("__copy", F.row_number().over(same))
    each = keyed.join(taken, ["__key", "__copy"]).withColumn("__pass", F.explode("__passes"))
    words = F.col("__pass.words")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), words.cast("int")), " ")
    each = each.withColumn("text", F.when(words < F.col("__size"), cut).otherwise(F.col("text"))).withColumn("__at", F.col("__pass.position"))
    if "n_chars" in docs.columns:
        each = each.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return each.repartitionByRange("__at", "doc_id").sortWithinPartitions("__at", "doc_id").select(*docs.columns)
