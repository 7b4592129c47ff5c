"""Mixing sources to target weights by capped water-filling, in DataFrame expressions only.

Every source gets a share of the budget in proportion to its weight, but at
most max_epochs times its own size; what the clamped sources leave is shared
out again among the others until none is above its clamp. Documents are then
repeated: as often as the whole part of target / size says, and once more for
a seeded sample that makes up the fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, restored, stage, words

WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
MAX_EPOCHS = 2
#: About so many documents of a source are sorted in one task.
BUCKET_ROWS = 4_096
#: A table of sources of up to so many rows (some MB) is broadcast.
BROADCAST_ROWS = 50_000


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, n, target of each row of (source, source_size, n).

    Sorted by clamp / weight, the clamped sources are a prefix: the first
    prefix whose rest can take its share decides the level. Weights repeat over
    the sources in code point order, nulls last. A source of size 0 has target
    0. The windows run over one row a source.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sources.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")).cast("long")
    s = ranked.withColumns({"w": weight, "cap": F.col("source_size") * max_epochs})
    # cap / weight is compared as an integer, so that equal levels tie exactly
    common = 1
    for w in weights:
        common *= int(w)
    s = s.withColumn("r", F.col("cap") * F.lit(common) / F.col("w"))
    order = Window.orderBy("r", "i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    s = s.withColumns(
        {
            "caps": F.coalesce(F.sum("cap").over(before), zero),
            "rest_w": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), zero),
            "budget": F.sum("source_size").over(everything) * F.lit(budget_percent) / F.lit(100),
        }
    )
    s = s.withColumn("level", (F.col("budget") - F.col("caps")) / F.col("rest_w"))
    level = F.min(F.when(F.col("cap") >= F.col("w") * F.col("level"), F.struct("r", "i", "level"))).over(everything)["level"]
    s = s.withColumn("final", level)
    target = F.when(F.col("final").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("w") * F.col("final")))
    return s.select("source", "source_size", "n", target.alias("target"))


def order_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A seeded hash of a document, its text included, so that ids that repeat or are null are spread as well."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def mix(
    df: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = WEIGHTS,
    budget_percent: int = BUDGET_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 0,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of df.

    copies is how often the mix holds the document; taken = size * copies. The
    fractional sample of a source is the start of its documents in the order of
    a seeded hash, up to the document whose middle reaches the wanted words; so
    a source comes within half a document of its target, and reruns agree.

    Null texts have size 0, null sources are a source of their own, null
    doc_ids hash like the empty string. Rows that agree in doc_id, source and
    text are aggregated before anything is sorted, and take places one after
    the other. Very long texts cost in proportion to their length.

    A hot source is split: its documents are dealt to buckets by their hash,
    bucket sums give each bucket its start, and only the running sum inside a
    bucket needs the bucket's rows together.
    """
    sized = stage(
        df.select(
            df[doc_id].alias("doc_id"),
            df[source].alias("source"),
            F.size(words(df[text])).cast("long").alias("size"),
            order_key(df[doc_id], df[text], seed).alias("h"),
        )
    )
    sources = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    n_sources = sources.count()
    targets = source_targets(sources, weights, budget_percent, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumns({"whole": F.floor(rate), "buckets": F.ceil(F.col("n") / BUCKET_ROWS)})
    targets = stage(targets.withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size")))
    small = F.broadcast(targets) if n_sources <= BROADCAST_ROWS else targets
    equal = sized.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("rows"))
    d = equal.alias("d").join(small.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).drop(F.col("t.source"))
    u = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    d = d.withColumn("b", F.floor(u * F.col("buckets") / F.lit(2.0**32)))
    # running sums of buckets: one row a source and bucket
    sums = d.groupBy("source", "b").agg(F.sum(F.col("size") * F.col("rows")).alias("sum"))
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "b", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "b").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("upto", F.sum(F.col("size") * F.col("rows")).over(within))
    d = d.alias("d").join(starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.b") == F.col("s.b"))).select("d.*", "s.start")
    # each of the equal rows again, with its own place
    d = d.withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    middle = F.col("start") + F.col("upto") - F.col("size") * (F.col("rows") - F.col("j")) - F.col("size") / F.lit(2.0)
    copies = F.col("whole") + F.when(middle < F.col("wanted"), 1).otherwise(0)
    d = d.withColumn("copies", copies.cast("long"))
    return d.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "h")


def mixed_documents(df: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of df, each as often as the mix holds it, in the columns of df.

    Rows that agree in doc_id, source and text get the copies that the mix has
    for such rows, one each. The texts are shuffled once: the place among such
    rows is counted where the join has put them.
    """
    source, text = options.get("source", "source"), options.get("text", "text")

    def keys(src, h) -> dict[str, Column]:
        return {f"k{i}": F.xxhash64(F.lit(i), src, src.isNull(), h) for i in range(2)}

    rows = carried(df, **keys(df[source], order_key(df[doc_id], df[text], options.get("seed", 0))))
    plan = mix(df, doc_id, **options)
    plan = plan.select("copies", *[v.alias(k) for k, v in keys(plan["source"], plan["h"]).items()])
    # equal rows have as many copies, or one more for the first of them
    plan = plan.groupBy("k0", "k1").agg(F.min("copies").alias("least"), (F.sum("copies") - F.min("copies") * F.count("*")).alias("more")).where((F.col("least") > 0) | (F.col("more") > 0))
    both = rows.join(plan, ["k0", "k1"])
    place = F.row_number().over(Window.partitionBy("k0", "k1").orderBy(F.xxhash64("row")))
    both = both.withColumn("n", F.col("least") + F.when(place <= F.col("more"), 1).otherwise(0))
    return restored(both.where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")))
