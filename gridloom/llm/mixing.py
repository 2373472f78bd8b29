"""Mixing sources by a time-varying curriculum.

Each source has a weight schedule over training time t from 0 to 1, linear between knots. Its
integral is the source's weight, which sets its share of all words; no source gives
more than ``repeats`` times its size, and the excess is shared again by weight. A document's place in
its source's stream is the number of words before it in a hashed order; inverting the source's
cumulative demand turns that place into a training position, once for each pass over the source.
Documents are range-sorted by position.

Prefix sums run in two levels: hash buckets of a source, whose offsets are summed over
buckets, then rows inside a bucket; a source with most of the rows spreads over all tasks. The buckets are
4,096 a source, and sixteen times as many wherever a bucket would hold more than BUCKET rows. Rows of one source, id and
size are alike to the mix and are one row with a number of copies until their places are known, so a repeated or
missing id fills no bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import checkpoint, n_words, repeated, whole_row

Knots = Sequence[tuple[float, float]]

#: Weights 1, 2 and 3 over the whole of training: falling, peaking halfway, rising.
SCHEDULES: tuple[Knots, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (0.5, 3.0), (1.0, 1.0)), ((0.0, 2.0), (1.0, 4.0)))
REPEATS = 3
#: Rows of a bucket, about.
BUCKET = 1 << 16


def integral(knots: Knots) -> float:
    """Area under a schedule."""
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))


def invert(knots: Knots, y: Column) -> Column:
    """The time by which a share ``y`` of the schedule's integral is used up."""
    total, done, out = integral(knots), 0.0, None
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        area = (t1 - t0) * (w0 + w1) / 2
        slope = (w1 - w0) / (t1 - t0)
        need = F.greatest(y * total - done, F.lit(0.0))
        # w0 * x + slope * x * x / 2 = need, in the form that holds for a slope of 0 too.
        x = F.try_divide(2 * need, w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * need, F.lit(0.0))))
        t = F.lit(t0) + F.least(F.coalesce(x, F.lit(0.0)), F.lit(t1 - t0))
        done += area
        out = F.when(y * total <= done, t) if out is None else out.when(y * total <= done, t)
    return out.otherwise(F.lit(float(knots[-1][0])))


def targets(sizes: DataFrame, weights: Sequence[float], repeats: int = REPEATS) -> DataFrame:
    """(source_key, source_size, cycle, target) from (source, source_key, source_size), one row a source.

    Weights cycle over the sources in code-point order, null last. Water-filling in closed form: by
    rising cap / weight, sources are capped while their cap is at most the level of the rest.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    w = sizes.withColumn("cycle", ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("cycle") + 1)
    w = w.withColumn("w", weight).withColumn("cap", (repeats * F.col("source_size")).cast("double"))
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before, all_ = by.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    w = w.withColumn("left", F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    w = w.withColumn("level", F.col("left") / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # Levels hold up to the first source that stays open; all from there on are open.
    w = w.withColumn("rank", F.row_number().over(by))
    is_open = F.col("cap") > F.col("level") * F.col("w")
    w = w.withColumn("open", F.min(F.when(is_open, F.struct("rank", "level"))).over(all_))
    capped = F.col("open").isNull() | (F.col("rank") < F.col("open.rank"))
    return w.select("source_key", "source_size", "cycle", F.when(capped, F.col("cap")).otherwise(F.col("open.level") * F.col("w")).alias("target"))


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    schedules: Sequence[Knots] = SCHEDULES,
    repeats: int = REPEATS,
    seed: int = 0,
    row: bool = False,
) -> DataFrame:
    """(id, size, source_size, target, taken, positions) of every row, not yet sorted.

    ``taken`` counts the words the mix takes from the document, repeats included; the last document
    before a source's target is taken in part, so a source's sum is its target rounded down.
    ``positions`` are the training times of its passes. Null and blank texts have size 0, are never taken and
    have no positions; a null source is a source of its own; repeated rows each count; no rows give no rows.
    With ``row`` each also carries its whole row, as ``_row``; null ids are dealt and ordered by their texts, and rows of a
    repeated id inside a bucket stay separate. Without, the sizes are checkpointed, so each text is read once.
    """
    digits, count = 3, docs.count()
    while 16**digits * BUCKET < count:
        digits += 1
    carried = ["_row"] if row else []
    whole = [whole_row(docs).alias("_row")] if row else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *whole)
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    # With their rows, those without an id are dealt by their texts, not all to one bucket.
    nameless = F.coalesce(F.md5(F.col("_row")[text_col]), F.lit("")) if row else F.lit("")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), nameless)))
    rows = rows.select("id", "size", "source", key.alias("source_key"), order.alias("o"), F.substring(order, 1, digits).alias("bucket"), *carried)
    if row:
        rows = rows.withColumn("copies", F.lit(1).cast("bigint"))
    else:
        rows = checkpoint(rows.groupBy("source_key", "bucket", "o", "id", "size").agg(F.count("*").alias("copies"), F.first("source").alias("source")))
    many = F.col("size") * F.col("copies")
    buckets = rows.groupBy("source_key", "bucket").agg(F.sum(many).alias("n"), F.first("source").alias("source"))
    inside = W.partitionBy("source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.select("source_key", "bucket", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("offset"))
    sizes = buckets.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("n").alias("source_size"))
    wanted = offsets.join(targets(sizes, [integral(k) for k in schedules], repeats), "source_key")
    run = W.partitionBy("source_key", "bucket").orderBy("o", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select("id", "size", "copies", "source_key", "bucket", F.coalesce(F.sum(many).over(run), F.lit(0)).alias("within"), *carried)
    rows = rows.join(wanted, ["source_key", "bucket"])
    rows = rows.withColumn("copy", F.lit(0).cast("bigint")) if row else repeated(rows, "copies", "copy")
    rows = rows.withColumn("at", F.col("offset") + F.col("within") + F.col("copy") * F.col("size"))
    demand = F.floor("target").cast("long")
    taken = sum((F.least(F.greatest(demand - e * F.col("source_size") - F.col("at"), F.lit(0)), F.col("size")) for e in range(repeats)), F.lit(0))
    starts = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda e: (e * F.col("source_size") + F.col("at")).cast("double")),
        lambda s: (s < demand) & (F.col("size") > 0),
    )
    share = lambda s: F.try_divide(s, F.col("target"))

    def position(s: Column) -> Column:
        out = None
        for i, knots in enumerate(schedules):
            t = invert(knots, share(s))
            out = F.when(F.col("cycle") == i, t) if out is None else out.when(F.col("cycle") == i, t)
        return out

    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), F.transform(starts, position).alias("positions"), *carried)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """plan_mix, range-sorted by the first training position (rows that are not taken come last)."""
    plan = plan_mix(docs, **options)
    first = F.try_element_at("positions", F.lit(1))
    return plan.withColumn("first_position", first).orderBy(F.col("first_position").asc_nulls_last(), options.get("id_col", "doc_id"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The training stream: whole rows of ``docs``, one for each pass, range-sorted by position.

    Each row is placed by itself, so repeated and null ids each count once a pass. A document in
    which a source's demand ends comes whole.
    """
    plan = plan_mix(docs, id_col=id_col, row=True, **options)
    slots = plan.select("_row", F.col(id_col).alias("_id"), F.explode("positions").alias("_position"))
    return slots.orderBy("_position", "_id").select("_row.*")
