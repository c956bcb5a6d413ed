"""One ranking from several differently scaled scores: leximin over percentiles.

Each score becomes the item's percentile within its query (mean rank of its ties, 0 worst, 1 best);
an item's percentiles are sorted ascending and the vectors compared lexicographically, so that a weak
score cannot be masked by a strong one. Only standings count, never scale, spread or shape.

Items are brought together by query once; ranks of all scores are windows over that one partitioning.
Queries of more than ``HOT_ROWS`` rows are no single task: there every (query, score) is cut into blocks at
sketch quantiles, blocks are counted, and a rank is the count of the blocks below plus the rank inside.
Both ways give the same ranks.

Defined results: exact copies and repeated (query, item) rows count once (the row with the greatest
scores wins, score by score); a null or NaN score is replaced by the mean of the item's own other
percentiles, so it speaks neither for nor against; an item without any score stands at 0.5 throughout;
a query with one item gives it 0.5; ties of whole vectors are broken by item; rows with a null query
or item are ignored; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.runtime import cut

BLOCKS = 64
#: Rows of a query beyond which it is ranked by blocks, and how many such queries are told apart.
HOT_ROWS, MOST_HOT = 500_000, 10_000


def _scores(df: DataFrame, query: str, item: str, scores: list[str]) -> DataFrame:
    clean = [F.when(F.isnan(F.col(s).cast("double")), None).otherwise(F.col(s).cast("double") + 0.0).alias(f"s{k}") for k, s in enumerate(scores)]
    return df.select(F.col(query).alias("q"), F.col(item).alias("item"), *clean).where("q is not null and item is not null")


def _once(rows: DataFrame, n: int) -> DataFrame:
    return rows.groupBy("q", "item").agg(*[F.max(f"s{k}").alias(f"s{k}") for k in range(n)])


def _by_windows(rows: DataFrame, n: int) -> DataFrame:
    """Percentiles within queries that fit a task: one shuffle, by query."""
    base = _once(rows.repartition("q"), n)
    for k in range(n):
        s, known = F.col(f"s{k}"), Window.partitionBy("q")
        # nulls come last in descending order, so ranks among the known are not disturbed
        down = known.orderBy(s.desc_nulls_last())
        ties = F.count(F.lit(1)).over(down.rangeBetween(Window.currentRow, Window.currentRow))
        total = F.count(s).over(known)
        p = F.when(total <= 1, F.lit(0.5)).otherwise((total - F.rank().over(down) - (ties - 1) / 2) / (total - 1))
        base = base.withColumn(f"p{k}", F.when(s.isNotNull(), p))
    return base.select("q", "item", F.array(*[f"p{k}" for k in range(n)]).alias("p"))


def _by_blocks(rows: DataFrame, n: int, blocks: int) -> DataFrame:
    """Percentiles within queries of any size."""
    base = _once(rows, n)
    long = base.select("q", "item", F.posexplode(F.array(*[f"s{k}" for k in range(n)])).alias("k", "v"))
    cuts = [round(i / blocks, 6) for i in range(1, blocks)]
    known = long.where("v is not null")
    # one row per (query, score); the sketches merge on the map side
    edges = known.groupBy("q", "k").agg(F.percentile_approx("v", cuts, 10_000).alias("edges"))
    placed = long.join(edges, ["q", "k"], "left").select("q", "item", "k", "v", F.when(F.col("v").isNotNull(), F.size(F.filter("edges", lambda e: e < F.col("v")))).alias("block"))
    # equal scores are counted first: a value that most items share is one row here
    values = placed.where("v is not null").groupBy("q", "k", "block", "v").agg(F.count(F.lit(1)).alias("ties"))
    within = Window.partitionBy("q", "k", "block").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("least", F.coalesce(F.sum("ties").over(within), F.lit(0)))
    sizes = values.groupBy("q", "k", "block").agg(F.sum("ties").alias("n"))
    w = Window.partitionBy("q", "k")
    below = sizes.withColumn("below", F.sum("n").over(w.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).withColumn("total", F.sum("n").over(w)).select("q", "k", "block", F.coalesce("below", F.lit(0)).alias("below"), "total")
    mean_rank = F.col("below") + F.col("least") + (F.col("ties") - 1) / 2
    ranks = values.join(below, ["q", "k", "block"]).select("q", "k", "v", F.when(F.col("total") <= 1, F.lit(0.5)).otherwise(mean_rank / (F.col("total") - 1)).alias("p"))
    joined = placed.join(ranks, ["q", "k", "v"], "left")
    return joined.select("q", "item", F.struct("k", "p").alias("kp")).groupBy("q", "item").agg(F.transform(F.array_sort(F.collect_list("kp")), lambda x: x["p"]).alias("p"))


def percentiles(df: DataFrame, query: str, item: str, scores: list[str], blocks: int = BLOCKS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(q, item, p, hot): the array of percentiles in the order of ``scores``, null where the score is missing."""
    rows = _scores(df, query, item, scores)
    hot = rows.groupBy("q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("q").limit(MOST_HOT + 1).collect()
    names, n = [r["q"] for r in hot], len(scores)
    if len(names) > MOST_HOT:  # more hot queries than a filter should hold: all go by blocks
        return _by_blocks(rows, n, blocks).withColumn("hot", F.lit(True))
    if not names:
        return _by_windows(rows, n).withColumn("hot", F.lit(False))
    is_hot = F.col("q").isin(names)
    cool = _by_windows(rows.where(~is_hot), n).withColumn("hot", F.lit(False))
    return cool.unionByName(_by_blocks(rows.where(is_hot), n, blocks).withColumn("hot", F.lit(True)))


def leximin(df: DataFrame, query: str, item: str, scores: list[str], blocks: int = BLOCKS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(q, item, p, hot, key): ``key`` is the ascending vector to compare, greatest first."""
    ps = percentiles(df, query, item, scores, blocks, hot_rows)
    present = F.filter("p", lambda x: x.isNotNull())
    own = F.when(F.size(present) == 0, F.lit(0.5)).otherwise(F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))
    key = F.array_sort(F.transform("p", lambda x: F.round(F.coalesce(x, own), 9)))
    return ps.select("q", "item", "p", "hot", key.alias("key"))


def top_k(ranking: DataFrame, k: int) -> DataFrame:
    """The k best per query; each map task first keeps its own k best, so hot queries shuffle little."""
    w = Window.partitionBy("q").orderBy(F.col("key").desc(), "item")
    return ranking.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked(ranking: DataFrame) -> DataFrame:
    """Adds ``rank`` within the query. Hot queries are sorted by range; counts of the ranges before shift the numbers inside."""
    best = [F.col("key").desc(), F.col("item")]
    cool = ranking.where("not hot").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*best)))
    hot = ranking.where("hot")
    if hot.isEmpty():
        return cool
    cuts = cut(hot.repartitionByRange(F.col("q"), *best).withColumn("range", F.spark_partition_id()))
    sizes = cuts.groupBy("q", "range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("q", "range", F.coalesce(F.sum("n").over(Window.partitionBy("q").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = cuts.withColumn("rank", F.row_number().over(Window.partitionBy("q", "range").orderBy(*best)))
    return cool.unionByName(inside.join(before, ["q", "range"]).withColumn("rank", (F.col("rank") + F.col("before")).cast("int")).select(*cool.columns))
