"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums, exact cuts.

Each document gets a hash key that depends on the seed and the document alone. A source's keys are cut into ranges
(leading digits of the hash), so that a hot source is spread over many tasks. Prefix sums have three levels: groups of
ranges within a source, ranges within a group, documents within a range; each is a window over a bounded mean of rows. A
source whose budget is beyond its size repeats whole epochs, and the last epoch is cut inside the document where the
budget ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD_PATTERN, stage

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = 20
#: Mean documents of a key range over all sources at most; ranges grow in number with the input, by 16.
RANGE_ROWS = 512
#: Ranges of a group share all but so many leading digits.
GROUP_DIGITS = 3


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target: shares of the total by weight, none above most_epochs times its source's size.

    The fixed point of sharing the excess again: the sources whose bound is least for their weight are at their
    bound, and the rest share what is left by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    ranked = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long")).withColumn("bound", F.col("source_size") * most_epochs)
    # With bounds in the order of bound / weight, the k-th is met when sharing what the ones before it leave gives it more.
    by_ratio = Window.orderBy((F.col("bound") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    steps = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("bound").over(before), F.lit(0)).alias("bound_before"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    met = F.col("bound") * (F.col("all_weight") - F.col("weight_before")) <= F.col("weight") * (F.col("total") - F.col("bound_before"))
    # `met` holds for a prefix of the order and never again after it.
    sums = steps.withColumn("met", met).select(
        "*",
        F.sum(F.when(F.col("met"), F.col("bound")).otherwise(0)).over(everything).alias("bound_met"),
        F.sum(F.when(F.col("met"), F.col("weight")).otherwise(0)).over(everything).alias("weight_met"),
    )
    shared = (F.col("weight") * (F.col("total") - F.col("bound_met"))).cast("double") / (F.col("all_weight") - F.col("weight_met"))
    return sums.select("source", "source_size", F.when(F.col("met"), F.col("bound").cast("double")).otherwise(shared).alias("target"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: int = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row for each row of documents: doc_id, source, size, source_size, target, sort_key, words_before, taken.

    words_before is the distributed prefix sum in the source's random order; taken counts the words that the mix
    takes of the document, repeats included. The words taken of a source add up to its target, rounded down.
    Null texts have size 0 and take nothing; a null source is a source, the last one; equal rows get equal keys and
    follow one another, in any order, which no result depends on beyond which of the equal rows is cut; an empty
    table gives an empty result. Columns besides doc_id, text and source are ignored. Runs agree: keys depend on
    seed, doc_id, source and text only.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    said = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    sized = stage(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.md5(said.cast("binary")).alias("sort_key")))
    rows = sized.count()
    digits = next(d for d in range(16) if rows <= range_rows * 16**d)
    sized = sized.withColumn("key_range", F.substring("sort_key", 1, digits))
    sums = stage(sized.groupBy("source", "key_range").agg(F.sum("size").alias("range_size")))
    group = F.substring("key_range", 1, max(0, digits - GROUP_DIGITS)).alias("key_group")
    # Each level's sums before, from that level's rows alone.
    ahead = lambda value, order, *within: F.coalesce(F.sum(value).over(Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.groupBy("source", group).agg(F.sum("range_size").alias("group_size"))
    groups = groups.select(F.col("source").alias("g_source"), F.col("key_group").alias("g_group"), ahead("group_size", "key_group", "source").alias("group_offset"))
    inside = sums.select("source", "key_range", group, "range_size").withColumn("range_offset", ahead("range_size", "key_range", "source", "key_group"))
    offsets = inside.join(groups, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("key_group") == F.col("g_group")))
    offsets = offsets.select(F.col("source").alias("o_source"), F.col("key_range").alias("o_range"), (F.col("group_offset") + F.col("range_offset")).alias("offset"))
    targets = source_targets(sums.select("source", F.col("range_size").alias("size")), weights, most_epochs).select(F.col("source").alias("t_source"), "source_size", "target")
    offsets = offsets.join(targets, F.col("o_source").eqNullSafe(F.col("t_source"))).drop("t_source")
    in_range = Window.partitionBy("source", "key_range").orderBy("sort_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("inside", F.sum("size").over(in_range) - F.col("size")).join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("key_range") == F.col("o_range")))
    placed = placed.withColumn("words_before", F.col("offset") + F.col("inside"))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0)
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("words_before")))
    return placed.select("doc_id", "source", "size", "source_size", "target", "sort_key", "words_before", taken.cast("long").alias("taken"))
