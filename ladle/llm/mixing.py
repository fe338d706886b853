"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladle.llm.storage import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: The rank axis of a source is cut into so many bins; only the bin in which the sample ends is ranked row by row.
BINS = 65_536
#: Inclusion odds fall with size: the probability of one copy more is in proportion to size ** -TILT, so that long texts are repeated less.
TILT = 0.25
#: Rounds fill what is left open of a target until it is no more than this share of it, or nothing that waits fits.
CLOSE = 0.001
#: A table with a row per source is broadcast up to so many sources.
BROADCAST_SOURCES = 50_000
#: A table with a row per source and size is broadcast up to so many rows (32 bytes each).
BROADCAST_SIZES = 1_000_000


def _uniform(seed: str, *columns: Column) -> Column:
    """A number strictly between 0 and 1 that follows from the columns."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds rank and target to (source, source_size), a row per source.

    Sources in order of code points, null last, take the weights in turn. The targets share ``share``
    times all sizes by weight; none exceeds ``most`` times its source's size, and the excess goes to the
    others by weight, as often as it takes: target = least(most * size, weight * level) for one level.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    limited = ranked.withColumn("weight", weight).withColumn("limit", most * F.col("source_size")).withColumn("full_at", F.col("limit") / F.col("weight"))
    order = Window.orderBy("full_at", "rank")
    filled = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    level = (share * F.sum("source_size").over(whole) - filled) / left
    leveled = limited.withColumn("level", level)
    # the first source that the level doesn't fill fixes it for the rest
    fixed = F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")), F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank"))).over(whole)
    return leveled.withColumn("fixed", fixed).select("source", "source_size", "rank", F.when(F.col("fixed").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("fixed"))).alias("target"))


def inclusion(sizes: DataFrame, tilt: float = TILT) -> DataFrame:
    """Adds p to (rank, size, n, rest), a row per source and size: n documents of that size, rest words to draw.

    p = least(1, c * size ** -tilt), with c such that the expected words, the sum of n * p * size, equal rest. The
    sizes with p = 1 are the smallest ones: going up, the first size at which c leaves p below 1 fixes it."""
    order = Window.partitionBy("rank").orderBy("size")
    share = F.col("n") * F.pow(F.col("size").cast("double"), F.lit(1.0 - tilt))
    before = F.coalesce(F.sum(F.col("n") * F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    c = (F.col("rest") - before) / F.sum(share).over(order.rowsBetween(0, Window.unboundedFollowing))
    full = F.pow(F.col("size").cast("double"), F.lit(tilt))
    leveled = sizes.withColumn("c", c).withColumn("fixed", F.min_by(F.when(c <= full, c), F.when(c <= full, F.col("size"))).over(Window.partitionBy("rank")))
    return leveled.select("rank", "size", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("fixed") / full, F.lit(1.0)))).alias("p"))


def _exchanged(out: DataFrame, still: DataFrame, per_source) -> DataFrame:
    """(row, becomes) for sources that are still words short of their target: the smallest document without the copy gets it, and
    that with the copy whose size makes up for it best loses it, or none does; two rows of a source at most, and none where the target gets no nearer."""
    least = out.where("size > 0 and not copy").join(per_source(still), "rank").groupBy("rank", "still").agg(F.min(F.struct("size", "order", "id", "row")).alias("x"))
    least = materialize(least.select("rank", "still", F.col("x.size").alias("wide"), F.col("x.row").alias("taken")), "least")
    off = F.abs(F.col("wide") - F.col("size") - F.col("still"))
    given = out.where("copy").join(per_source(least), "rank").groupBy("rank").agg(F.min(F.struct(off.alias("off"), F.col("size"), F.col("order"), F.col("id"), F.col("row"))).alias("y"))
    alone = F.abs(F.col("wide") - F.col("still"))
    both = least.join(given, "rank", "left").withColumn("swap", F.coalesce(F.col("y.off") < alone, F.lit(False))).where(F.when(F.col("swap"), F.col("y.off")).otherwise(alone) < F.col("still"))
    return materialize(both.select(F.col("taken").alias("row"), F.lit(True).alias("becomes")).union(both.where("swap").select("y.row", F.lit(False))), "exchanged")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, tilt: float = TILT, seed: str = "mix") -> DataFrame:
    """How often the mix takes each document: (id_col, size, source_size, target, copies, taken), a row per row of docs.

    A document's size is its number of words. With ratio = target / source_size, every document of a source
    gets floor(ratio) certain copies. One copy more has the inclusion probability p of ``inclusion``, which falls with the
    size; documents with p = 1 are certain of it. The others are ranked by (u / (1 - u)) / (p / (1 - p)), u drawn from id and size, and taken in this
    order, each if it still fits the rest of the target, until CLOSE of the target is left open at most or nothing that waits fits;
    then the smallest of the others is taken, alone or for one that was taken, if the target is nearer with it. taken = size * copies. Reruns agree, as u follows from seed, id and size.

    A null source is a source; a null or empty text has size 0 and takes nothing; a source without words
    has target 0. Equal rows are told apart by no more than which of them gets the copy. Other columns are not looked at.

    A source's rows are never gathered or ranked as a whole: sums over bins of the rank find the bin in
    which its sample ends, and only that bin is ordered. A document that doesn't fit ends a round;
    the next one goes on behind it, with the documents that fit what is open.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    base = materialize(base.withColumn("u", _uniform(seed, F.col("id"), F.col("size"))).withColumn("row", F.monotonically_increasing_id()), "sizes")
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    targets = targets.withColumn("certain", F.floor(ratio + 1e-12)).withColumn("rest", F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0)))
    targets = materialize(targets, "targets")
    few = targets.count() <= BROADCAST_SOURCES

    def per_source(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    by_source = targets.withColumnRenamed("source", "of")
    rated = base.join(per_source(by_source), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # a row per source and size: no more than there are different sizes
    sizes = rated.where("size > 0 and rest > 0").groupBy("rank", "size").agg(F.count("*").alias("n"), F.first("rest").alias("rest"))
    chances = materialize(inclusion(sizes, tilt).withColumnsRenamed({"rank": "of", "size": "sized"}), "chances")
    few_sizes = chances.count() <= BROADCAST_SIZES
    rated = rated.join(F.broadcast(chances) if few_sizes else chances, (F.col("rank") == F.col("of")) & (F.col("size") == F.col("sized")), "left").drop("of", "sized")
    odds = F.when((F.col("p") > 0) & (F.col("p") < 1), F.col("u") * (1 - F.col("p")) / ((1 - F.col("u")) * F.col("p")))
    rated = rated.withColumn("order", odds / (1 + odds)).withColumn("bin", F.least(F.floor(F.col("order") * BINS), F.lit(BINS - 1)))

    sampled = rated.where("p > 0 and p < 1")
    drawn = rated.where("p = 1").groupBy("rank").agg(F.sum("size").alias("drawn"))
    place = F.struct("order", "id", "row")
    taken = F.col("end_bin").isNull() | (F.col("bin") < F.col("end_bin")) | F.coalesce(place < F.col("stop"), F.lit(False))
    # what certain copies leave of the rest; a rounding error may leave less than nothing
    gaps = targets.join(drawn, "rank", "left").select("rank", (F.col("rest") - F.coalesce("drawn", F.lit(0))).alias("open"), F.lit(None).cast(sampled.select(place.alias("x")).schema["x"].dataType).alias("last"))
    gaps, first, extra, past = materialize(gaps.where("open >= 1"), "gaps"), None, None, []
    still = gaps.join(per_source(targets.select("rank", "target")), "rank").select("rank", "open", "last", (F.col("open") > CLOSE * F.col("target")).alias("far"))
    while not gaps.isEmpty():
        # what doesn't fit the gap now won't fit later
        waiting = sampled.join(per_source(gaps), "rank").where((F.col("size") <= F.col("open")) & (F.col("last").isNull() | (place > F.col("last"))))
        bins = waiting.groupBy("rank", "bin").agg(F.sum("size").alias("bin_size"), F.any_value("open").alias("open"))
        # the bin in which a source's sample ends: null where all of its documents fit
        summed = bins.withColumn("upto", F.sum("bin_size").over(Window.partitionBy("rank").orderBy("bin"))).withColumn("over", F.col("upto") > F.col("open"))
        ends = summed.groupBy("rank").agg(F.min(F.when(F.col("over"), F.col("bin"))).alias("end_bin"), F.min(F.when(F.col("over"), F.col("upto") - F.col("bin_size"))).alias("before"), F.sum("bin_size").alias("total"), F.first("open").alias("was"))
        ends = materialize(ends, "ends")
        # that bin row by row, up to the first document that doesn't fit
        exact = Window.partitionBy("rank").orderBy("order", "id", "row")
        inside = waiting.join(per_source(ends.where("end_bin is not null").drop("total", "was")), "rank").where("bin = end_bin").withColumn("upto", F.col("before") + F.sum("size").over(exact)).withColumn("fits", F.col("upto") <= F.col("open"))
        stops = inside.groupBy("rank").agg(F.max(F.when(F.col("fits"), F.col("upto"))).alias("upto"), F.min(F.when(~F.col("fits"), place)).alias("stop"))
        stops = materialize(stops, "stops")
        reached = ends.join(stops, "rank", "left")
        if first is None:
            # the first round takes the bulk: a condition on each row says so; those after it are few rows, written down
            first = materialize(gaps.join(reached, "rank").select("rank", F.col("open").alias("first_open"), "end_bin", "stop"), "first")
        else:
            now = waiting.join(per_source(reached.select("rank", "end_bin", "stop")), "rank").where(taken).select("row")
            extra = materialize(now if extra is None else extra.union(now), "extra")
        left = reached.select("rank", (F.col("was") - F.coalesce("upto", "before", "total")).alias("open"), F.col("stop").alias("last")).join(per_source(targets.select("rank", "target")), "rank")
        left = materialize(left.select("rank", "open", "last", ((F.col("open") >= 1) & (F.col("open") > CLOSE * F.col("target"))).alias("far")), "left")
        past += [ends, stops]
        still = still.union(left)
        gaps = left.where("far and last is not null").drop("far")
    out = rated.withColumn("copy", F.coalesce(F.col("p") == 1, F.lit(False)))
    if first is not None:
        out = out.join(per_source(first), "rank", "left").withColumn("copy", F.col("copy") | F.coalesce((F.col("p") < 1) & (F.col("size") <= F.col("first_open")) & taken, F.lit(False)))
    if extra is not None:
        out = out.join(extra.withColumn("extra", F.lit(True)), "row", "left").withColumn("copy", F.col("copy") | F.coalesce("extra", F.lit(False)))
    still = materialize(still.groupBy("rank").agg(F.min("open").alias("still"), F.every("far").alias("far")).where("far").drop("far"), "still")
    if not still.isEmpty():
        out = out.join(per_source(_exchanged(out, still, per_source)), "row", "left").withColumn("copy", F.coalesce("becomes", "copy"))
    discard(*past)
    copies = (F.col("certain") + F.when(F.col("copy"), 1).otherwise(0)).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
