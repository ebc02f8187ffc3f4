"""Mix sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket. The bucket in which a source's budget
runs out is found from the running sums and only that bucket is split again, so a
threshold on the hash picks the documents: nothing is sorted, and one pass over a
narrow (source, size, hash) table serves each level.

Rows equal in source, id and text are numbered, each number with a hash of its own, so a
source that is one repeated row is mixed as finely as any other. They are counted by
input partition first and numbered within it, so a hot row is no task's burden.

Cases: a null text has size 0 and a null source is a source of its own, last in
order. Very long texts are sizes like others. Which of several equal rows are taken is
not told apart, how many is. An empty table gives an empty result. Other columns are
not looked at, whatever their names; ``mixed`` hands them on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm._scratch import Scope, keep

#: A table of sources up to this many rows is broadcast; beyond it Spark picks a join that can split a hot source.
BROADCAST_SOURCES = 100_000
GAPS = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words, runs of anything but space and the controls 9 to 13; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, GAPS), "")), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``totals`` (src, src_null, source_size) with each source's target.

    Sources by code point, null last, get the weights in turn and share the sum of
    all sizes. A target stops at ``most`` times its source's size; the sources that
    would pass it are full, and the rest is shared again until none is above. Each round
    is one aggregate over sources, and ranks come from range partitions.
    """
    n = max(1, totals.sparkSession.sparkContext.defaultParallelism)
    placed = totals.repartitionByRange(n, "src_null", "src").withColumn("part", F.spark_partition_id())
    x = keep(placed.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("src_null", "src"))), "mix-sources")
    sizes = x.groupBy("part").agg(F.count("*").alias("n"), F.sum("source_size").alias("size")).orderBy("part").collect()
    counts = [r["n"] for r in sizes]  # a row for each range partition
    before = {r["part"]: sum(counts[:i]) for i, r in enumerate(sizes)}
    total = float(sum(r["size"] for r in sizes))
    skipped = F.element_at(F.create_map(*(F.lit(v) for kv in before.items() for v in kv)), F.col("part")) if before else F.lit(0)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(skipped + F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    x = x.select("src", "src_null", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    share, full = math.inf, None
    while True:
        is_full = F.lit(False) if full is None else F.col("cap") < F.lit(full) * F.col("weight")
        r = x.agg(F.sum(F.when(is_full, F.col("cap"))).alias("cap"), F.sum(F.when(~is_full, F.col("weight"))).alias("weight")).first()
        share = (total - (r["cap"] or 0.0)) / r["weight"] if r["weight"] else math.inf
        if full is not None and share <= full * (1 + 1e-12):
            break
        full = share
        if share == math.inf:
            break
    target = F.col("cap") if share == math.inf else F.least(F.col("cap"), F.lit(share) * F.col("weight"))
    return x.select("src", "src_null", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    most: int = 3,
    levels: int = 3,
    bits: int = 12,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs``.

    A document is taken ``copies`` times whole: as often as its source's target covers
    the source, and once more if its hash lies below the source's threshold. Hashes
    depend on source, id and text, and on the number of a repeated row, so reruns agree.
    ``levels`` histograms of 2**``bits`` buckets resolve the threshold to
    2**-(levels * bits) of a source.
    """
    span = levels * bits
    with Scope(docs.sparkSession) as passing:
        sized = _keyed(docs, id_col, text_col, source_col, F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"))
        sized = passing.hand_over(sized, "mix-keys")
        again = keep(_repeated(sized), "mix-repeated")
        sized = sized.withColumn("h", _hash(F.col("k"), span)) if again.isEmpty() else passing.hand_over(_numbered(sized, again, span), "mix-sizes")
        edges, dealt = _thresholds(sized, weights, most, levels, bits)
        edges = passing.hand_over(edges, "mix-edges")
    return (
        sized.join(dealt(edges), ["src", "src_null"])
        .withColumn("copies", _copies(most))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3), most: int = 3, levels: int = 3, bits: int = 12,
) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as ``mix_sources`` takes it."""
    span, key = levels * bits, ["src", "src_null"]
    full = _keyed(docs, id_col, text_col, source_col, F.struct("*").alias("row"))
    with Scope(docs.sparkSession) as passing:
        sized = keep(full.drop("row"), "mix-keys")
        again = passing.hand_over(_repeated(sized), "mix-repeated")
        once = again.isEmpty()
        sized = sized.withColumn("h", _hash(F.col("k"), span)) if once else keep(_numbered(sized, again, span), "mix-sizes")
        edges, dealt = _thresholds(sized, weights, most, levels, bits)
        edges = passing.hand_over(edges, "mix-edges")
        if once:
            rows = full.withColumn("h", _hash(F.col("k"), span))
        else:  # only repeated rows are moved, to be numbered
            rest = full.join(again, [*key, "k"], "left_anti").withColumn("h", _hash(F.col("k"), span))
            twice = keep(full.join(again, [*key, "k"], "left_semi"), "mix-rows")
            twice = passing.hand_over(_numbered(twice, again, span), "mix-rows")
            rows = rest.select("row", *key, "h").unionByName(twice.select("row", *key, "h"))
    taken = rows.join(dealt(edges), key).withColumn("copies", _copies(most)).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("n")).select("row.*")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, *payload: Column) -> DataFrame:
    """(payload, size, src, src_null, k, part): ``k`` names what makes rows equal, ``part`` the input partition."""
    source = F.col(source_col).cast("string")
    return docs.select(
        *payload, word_count(F.col(text_col)).alias("size"), F.coalesce(source, F.lit("")).alias("src"), source.isNull().alias("src_null"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"), F.spark_partition_id().alias("part"),
    )


def _repeated(rows: DataFrame) -> DataFrame:
    """The (src, src_null, k) of several rows."""
    return rows.groupBy("src", "src_null", "k").agg(F.count("*").alias("n")).where("n > 1").drop("n")


def _numbered(rows: DataFrame, again: DataFrame, span: int) -> DataFrame:
    """``rows``, of a written table, with their hash ``h``; that of rows in ``again`` depends on the number among equal ones.

    Numbers run within each input partition, after the counts of the partitions before it.
    """
    key = ["src", "src_null", "k"]
    some = rows.join(again, key, "left_semi")
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = some.groupBy(*key, "part").agg(F.count("*").alias("n"))  # a row for each partition that holds the key
    parts = parts.select(*key, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped"))
    nth = F.row_number().over(Window.partitionBy(*key, "part").orderBy(F.lit(0)))
    numbered = some.withColumn("nth", nth).join(parts, [*key, "part"]).withColumn("nth", F.col("nth") + F.col("skipped"))
    numbered = numbered.withColumn("h", _hash(F.when(F.col("nth") == 1, F.col("k")).otherwise(F.xxhash64("k", "nth")), span)).drop("nth", "skipped")
    rest = rows.join(again, key, "left_anti").withColumn("h", _hash(F.col("k"), span))
    return rest.unionByName(numbered).drop("part")


def _hash(key: Column, span: int) -> Column:
    return F.shiftrightunsigned(key, 64 - span)


def _copies(most: int) -> Column:
    copies = F.least(F.lit(most).cast("long"), F.col("whole") + (F.col("h") < F.col("below")).cast("long"))
    return F.when(F.col("target") > 0, copies).otherwise(F.lit(0).cast("long"))


def _thresholds(sized: DataFrame, weights: Sequence[int], most: int, levels: int, bits: int) -> tuple[DataFrame, Callable]:
    """(for each source its size, target, whole copies and the hash below which one more is taken; how to deal it out)."""
    span, key = levels * bits, ["src", "src_null"]
    totals = sized.groupBy(*key).agg(F.sum("size").alias("source_size"))
    targets = keep(source_targets(totals, weights, most), "mix-targets")
    small = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    dealt = F.broadcast if small else (lambda x: x)

    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = targets.select(*key, (F.col("target") - full * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("prefix"))
    by_bucket = Window.partitionBy(*key).orderBy("bucket")
    for level in range(levels):
        shift = span - bits * (level + 1)
        within = sized.join(dealt(state), key).where(F.shiftright("h", shift + bits) == F.col("prefix"))
        sums = within.groupBy(*key, "budget", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        run = sums.withColumn("upto", F.sum("n").over(by_bucket)).where(F.col("upto") > F.col("budget"))
        edge = run.withColumn("first", F.row_number().over(by_bucket)).where("first = 1")
        state = edge.select(*key, (F.col("budget") - (F.col("upto") - F.col("n"))).alias("budget"), F.col("bucket").alias("prefix"), "n")
        if level < levels - 1:
            state = state.drop("n")
    # The last bucket goes in if that comes nearer to the target than leaving it out.
    below = state.select(*key, (F.col("prefix") + (2 * F.col("budget") >= F.col("n")).cast("long")).alias("below"))
    edges = targets.join(below, key, "left").select(*key, "source_size", "target", full.alias("whole"), F.coalesce("below", F.lit(1 << span)).alias("below"))
    return edges, dealt


def op9_mix_sources(docs: DataFrame) -> DataFrame:
    """The digest of ``mix_sources`` over documents: doc_id, size, source_size, target, taken."""
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
