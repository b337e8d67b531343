"""Mixing sources to target weights along a curriculum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.runtime import keep

#: Blocks of a source within which running sums are taken; a source of any size is spread over them.
BLOCKS = 1024
#: Supply and demand that differ by less than this part are equal: rounding of the integral must not decide a comparison.
TIE = 1e-12
#: Segments of a schedule that slopes.
KNOTS = 32
#: Rows up to which a table made from settings is broadcast.
SETTINGS = 100_000


def constant_schedule(targets: DataFrame) -> DataFrame:
    """The schedule (mix_id, source, t, weight) that keeps each weight from t = 0 to t = 1."""
    return targets.select("mix_id", "source", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"), "weight")


def tilted_schedule(targets: DataFrame) -> DataFrame:
    """A schedule (mix_id, source, t, weight) that begins with the large sources and ends with the small ones.

    A share starts above or falls below its target by its distance from the mix's mean share (by tokens), so the weights
    of each knot add up to one and the mean over time is the target. Repeated targets add up.
    """
    w = targets.groupBy("mix_id", "source").agg(F.sum(_weight()).alias("w"))
    mix = Window.partitionBy("mix_id")
    share = w.withColumn("s", F.when(F.sum("w").over(mix) > 0, F.col("w") / F.sum("w").over(mix)).otherwise(0.0))
    tilt = share.withColumn("a", F.col("s") - F.sum(F.col("s") * F.col("s")).over(mix))
    # demand is linear between knots, so a slope needs many of them
    knots = tilt.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(KNOTS)))).withColumn("t", F.col("k") / F.lit(float(KNOTS)))
    return knots.select("mix_id", "source", "t", (F.col("s") * (1 + (1 - 2 * F.col("t")) * F.col("a"))).alias("weight"))


def demand(schedule: DataFrame, total: DataFrame | float) -> DataFrame:
    """(mix_id, source, t0, t1, d0, d1): cumulative token demand of each source between the knots of its schedule.

    Weights are linear between knots and normalised by the sum of the mix at the knots, so the demand within a
    segment is integrated by the trapezium rule and is linear in t after it. All sources of a mix share its knots. Null
    or negative weights count as zero; a mix whose weights are all zero demands nothing. The table is of settings.
    """
    w = schedule.select("mix_id", "source", F.col("t").cast("double").alias("t"), _weight().alias("w"))
    w = w.groupBy("mix_id", "source", "t").agg(F.sum("w").alias("w"))
    share = w.withColumn("all", F.sum("w").over(Window.partitionBy("mix_id", "t"))).withColumn("share", F.when(F.col("all") > 0, F.col("w") / F.col("all")).otherwise(0.0))
    line = Window.partitionBy("mix_id", "source").orderBy("t")
    seg = (
        share.withColumn("t0", F.lag("t").over(line)).withColumn("s0", F.lag("share").over(line)).where("t0 is not null")
        .withColumn("add", (F.col("t") - F.col("t0")) * (F.col("share") + F.col("s0")) / 2 * F.lit(float(total)))
    )
    return seg.withColumn("d1", F.sum("add").over(line)).select("mix_id", "source", "t0", F.col("t").alias("t1"), (F.col("d1") - F.col("add")).alias("d0"), "d1")


def supply(counts: DataFrame) -> DataFrame:
    """(source, docs, tokens) of documents counted as (doc_id, source, n_tokens)."""
    return counts.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))


def _weight():
    """Null and negative weights are zero, in schedules and targets alike."""
    return F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))


def plan(targets: DataFrame, counts: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """One row per target: (mix_id, source, max_repeats, docs, tokens, target_share, target_tokens, due, short).

    T is the tokens of all counted documents; the target is the source's cumulative demand at the end of the schedule. A source
    supplies at most ``tokens x max_repeats`` (a null cap is no cap, a source without documents supplies nothing), so ``due`` is what it can be
    asked for, and it is short if that is less than the target; what the others deliver is not stretched to fill a gap. A
    repeated target row counts once for each repetition, as its weight does.
    """
    has = keep(supply(counts), "supply")
    total = has.agg(F.sum("tokens")).first()[0] or 0
    wanted = demand(schedule if schedule is not None else constant_schedule(targets), total).groupBy("mix_id", "source").agg(F.max("d1").alias("wanted"))
    mix, source = Window.partitionBy("mix_id"), Window.partitionBy("mix_id", "source")
    row = targets.select("mix_id", "source", "max_repeats", _weight().alias("w")).withColumn("share", F.col("w") / F.sum("w").over(mix))
    row = row.join(wanted, ["mix_id", "source"], "left").join(has, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    # repeated targets of a source divide its demand
    part = F.coalesce(F.col("w") / F.sum("w").over(source), 1 / F.count(F.lit(1)).over(source))
    need = F.coalesce("wanted", F.lit(0.0)) * part
    can = F.when(F.col("max_repeats").isNull() & (F.col("tokens") > 0), F.lit(None)).otherwise(F.col("tokens") * F.coalesce("max_repeats", F.lit(0)))
    row = row.withColumn("need", need).withColumn("can", can.cast("double"))
    return row.select(
        "mix_id", "source", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), "tokens", F.col("share").alias("target_share"), F.col("need").alias("target_tokens"),
        F.when(F.col("can").isNull(), F.col("need")).otherwise(F.least("can", "need")).alias("due"),
        F.coalesce(F.col("can") < F.col("need") * (1 - TIE), F.lit(False)).alias("short"),
    )


def shares(targets: DataFrame, counts: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """:func:`plan` with the real figures, counted from the rows that :func:`curriculum` emits: actual_tokens, actual_share of the
    mix, rows and passes over the source. Repeated targets of a source divide what it delivers like their targets."""
    made = curriculum(targets, counts, schedule).groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("made"), F.count(F.lit(1)).alias("rows"), (F.max("pass") + 1).alias("passes"))
    source = Window.partitionBy("mix_id", "source")
    part = F.coalesce(F.col("target_tokens") / F.sum("target_tokens").over(source), F.lit(0.0))
    row = plan(targets, counts, schedule).join(made, ["mix_id", "source"], "left").withColumn("actual_tokens", F.coalesce(F.col("made") * part, F.lit(0.0)))
    return row.select(
        "mix_id", "source", "max_repeats", "docs", "tokens", "target_share", "target_tokens", "actual_tokens",
        (F.col("actual_tokens") / F.sum("actual_tokens").over(Window.partitionBy("mix_id"))).alias("actual_share"),
        F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("passes", F.lit(0)).alias("passes"), "short",
    )


def _settings(rows: DataFrame) -> DataFrame:
    """A table made from settings, broadcast if it is counted to be at most SETTINGS rows."""
    rows = keep(rows, "settings")
    return F.broadcast(rows) if rows.count() <= SETTINGS else rows


def running_tokens(counts: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``counts`` with ``before``: tokens of the source's documents that come earlier in its shuffled order.

    The order is a hash of the id. Sums run within blocks of a source; the totals of the blocks (sources x blocks rows)
    are summed in a second, small window, so a source with a third of all rows is still spread over tasks.
    """
    h = counts.withColumn("h", F.xxhash64("doc_id", F.lit(17))).withColumn("block", F.floor(F.shiftrightunsigned("h", 1) / F.lit((1 << 63) / blocks)).cast("int"))
    inner = Window.partitionBy("source", "block").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    totals = h.groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block"))
    offset = totals.withColumn("offset", F.coalesce(F.sum("in_block").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("source", "block", "offset")
    run = h.withColumn("within", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    return run.join(offset, ["source", "block"]).select("doc_id", "source", "n_tokens", (F.col("offset") + F.col("within")).alias("before"))


def curriculum(targets: DataFrame, counts: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """(mix_id, position, doc_id, source, pass, n_tokens): documents of each mix in training order.

    Within a source, documents follow one another in shuffled order and start again up to the cap. The k-th token of a
    source belongs where its cumulative demand reaches k: the demand is inverted at the middle of the document, which
    gives its position between 0 and 1. Documents whose middle lies beyond the demand are left out, so a
    source misses its target by less than a document. Rows are range-partitioned and sorted by (mix_id, position).
    """
    due = plan(targets, counts, schedule).groupBy("mix_id", "source").agg(F.first("tokens").alias("tokens"), F.sum("due").alias("due")).where("tokens > 0 and due > 0")
    due = _settings(due.withColumn("passes", F.ceil(F.col("due") / F.col("tokens")).cast("int")))
    total = counts.agg(F.sum("n_tokens")).first()[0] or 0
    seg = _settings(demand(schedule if schedule is not None else constant_schedule(targets), total))
    docs = running_tokens(counts).where("n_tokens > 0")
    placed = docs.join(due, "source").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    placed = placed.withColumn("at", F.col("before") + F.col("pass") * F.col("tokens") + F.col("n_tokens") / 2.0).where("at <= due")
    inside = placed.join(seg, ["mix_id", "source"]).where("at > d0 and at <= d1")
    position = F.col("t0") + (F.col("at") - F.col("d0")) / (F.col("d1") - F.col("d0")) * (F.col("t1") - F.col("t0"))
    out = inside.select("mix_id", position.alias("position"), "doc_id", "source", "pass", "n_tokens")
    return out.repartitionByRange("mix_id", "position").sortWithinPartitions("mix_id", "position", "doc_id", "pass")
