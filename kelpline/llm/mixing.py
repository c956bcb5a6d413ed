"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

Natural source shares s become weights q(t) proportional to s * (w / s) ** t; t = 0 keeps the natural
mix, t = 1 is the target w. Within a token budget the exponent is bisected to the greatest t at which no
source would have to be repeated more than its limit; the source that binds there keeps its limit and the
others go on, so that shares end as near to the targets as the limits allow. Without a given budget the
largest one is taken at which every target is reached exactly. Without target weights the exponent of the
plain temperature family s ** t is bisected to a target entropy (``entropy_weights``).

A weight is realised as whole passes over the source plus one partial pass: records fall into hash
blocks; whole blocks are taken in hash order while they fit, and only the block on the boundary is
cut, in permutation order, by what still fits. Every pass has its own permutation key.

Defined results: source names are compared trimmed and in lower case; null sources and sources
without a weight contribute nothing; weighted sources without tokens are reported with share 0 and
the other weights are scaled up; a null ``max_repeats`` means 1, and 0 leaves a source out; records without tokens are never
drawn; an empty table gives an empty mixture.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpline.runtime import cut

PER_BLOCK = 10_000
MOST_SOURCES = 10_000


def source_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def temper(shares: list[float], exponent: float) -> list[float]:
    """Shares raised to ``exponent`` and normalised; zero stays zero."""
    raised = [s**exponent if s > 0 else 0.0 for s in shares]
    total = sum(raised) or 1.0
    return [r / total for r in raised]


def entropy(shares: list[float]) -> float:
    return -sum(s * math.log(s) for s in shares if s > 0)


def _bisect(ok, lo: float, hi: float) -> float:
    """The greatest exponent in [lo, hi] for which ``ok`` holds, given that it holds at lo."""
    if ok(hi):
        return hi
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ok(mid) else (lo, mid)
    return lo


def exponent_for_entropy(shares: list[float], target: float) -> float:
    """Exponent of the plain family whose entropy is ``target``: falling in the exponent from ln(n) at 0."""
    return _bisect(lambda t: entropy(temper(shares, t)) >= target, 0.0, 64.0)


def entropy_weights(tokens: list[int], target: float) -> tuple[list[float], float]:
    """(weights, exponent) of the plain temperature family at a share of the greatest possible entropy."""
    total = sum(tokens)
    shares = [t / total if total else 0.0 for t in tokens]
    live = sum(t > 0 for t in tokens)
    exponent = exponent_for_entropy(shares, target * math.log(live)) if live > 1 else 1.0
    return temper(shares, exponent), exponent


def plan_weights(tokens: list[int], wanted: list[float], repeats: list[int], budget: float | None = None) -> tuple[list[float], float, float]:
    """(weights, budget, exponent).

    With a budget the exponent rises from the natural mix towards the targets and is bisected to where the
    first source meets its repetition limit; that source stays there, and the exponent of the others rises
    on, until it is 1 or no source is left. Without one the largest budget is taken at which nothing is limited.
    """
    live = [t > 0 and w > 0 and r > 0 for t, w, r in zip(tokens, wanted, repeats)]
    scale = sum(w for w, a in zip(wanted, live) if a)
    if not scale:
        return [0.0] * len(tokens), 0.0, 1.0
    w = [x / scale if a else 0.0 for x, a in zip(wanted, live)]
    total = sum(t for t, a in zip(tokens, live) if a)
    s = [t / total if a else 0.0 for t, a in zip(tokens, live)]
    reach = min(r * t / x for r, t, x, a in zip(repeats, tokens, w, live) if a)
    if budget is None:
        return w, reach, 1.0
    budget = min(budget, sum(r * t for r, t, a in zip(repeats, tokens, live) if a))
    if budget <= 0:
        return [0.0] * len(tokens), 0.0, 0.0
    caps = [r * t / budget if a else 0.0 for r, t, a in zip(repeats, tokens, live)]
    limited, exponent = [not a for a in live], 0.0

    def weights(e: float) -> list[float]:
        room = 1.0 - sum(c for c, full in zip(caps, limited) if full)
        raw = [0.0 if full else y * (x / y) ** e for x, y, full in zip(w, s, limited)]
        scale = room / (sum(raw) or 1.0)
        return [c if full else x * scale for x, c, full in zip(raw, caps, limited)]

    over = lambda e: [x / c if c else 0.0 for x, c, full in zip(weights(e), caps, limited) if not full]
    fits = lambda e: max(over(e), default=0.0) <= 1 + 1e-12
    while not all(limited):
        at = exponent
        if fits(at):
            exponent = _bisect(fits, at, 1.0)
            if exponent >= 1.0:
                break
            at = min(1.0, exponent + 1e-9)
        # the source that would be repeated too often just beyond stays at its limit
        share = [-1.0 if full else x / c for x, c, full in zip(weights(at), caps, limited)]
        limited[share.index(max(share))] = True
    return weights(exponent), budget, exponent


def _fill_room(part: pd.DataFrame) -> pd.DataFrame:
    """Takes records in permutation order as long as they fit the room that is left."""
    part = part.sort_values(["hash", "item_id"], ignore_index=True)
    room, extra = float(part["room"].iloc[0]), []
    for n in part["n_tokens"].tolist():
        extra.append(int(n <= room))
        room -= n * extra[-1]
    return part.drop(columns="room").assign(extra=np.array(extra, np.int32))


def mix(records: DataFrame, weights: DataFrame, budget: float | str | None = None, seed: int = 17, entropy_share: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``records``: (item_id, source, n_tokens); ``weights``: (source, target_share, max_repeats).

    ``budget``: tokens to draw; "natural" stands for all tokens of the weighted sources. With
    ``entropy_share`` the targets are not the given ones but those of the temperature family whose
    entropy is that share of the greatest possible.

    Returns the mixture (source, item_id, pass_no, n_tokens, order_key; read in order of pass and key)
    and the report by source (target_share, actual_share, tokens, available_tokens, repeats).
    """
    spark = records.sparkSession
    rec = cut(records.select("item_id", source_key(F.col("source")).alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens")).where("source is not null"))
    have = {r["source"]: (r["t"], r["n"]) for r in rec.join(F.broadcast(weights.select(source_key(F.col("source")).alias("source")).distinct().limit(MOST_SOURCES + 1)), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    rows = weights.select(source_key(F.col("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).where("source is not null").groupBy("source").agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("r")).orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} weighted sources")
    tokens = [int(have.get(r["source"], (0, 0))[0] or 0) for r in rows]
    wanted = [float(r["w"] or 0) for r in rows]
    if entropy_share is not None:
        wanted, _ = entropy_weights([t if w > 0 else 0 for t, w in zip(tokens, wanted)], entropy_share)
    if budget == "natural":
        budget = float(sum(t for t, w in zip(tokens, wanted) if w > 0)) or None
    q, total, _ = plan_weights(tokens, wanted, [max(0, int(r["r"])) for r in rows], budget)
    plan = []
    for r, t, w, share in zip(rows, tokens, wanted, q):
        want = share * total
        passes = min(int(want / t + 1e-12), int(r["r"])) if t else 0
        partial = max(0.0, want - passes * t) if t and passes < int(r["r"]) else 0.0
        plan.append((r["source"], w, t, passes, float(partial), max(1, have.get(r["source"], (0, 1))[1] // PER_BLOCK + 1)))
    plan_df = spark.createDataFrame(plan, "source string, target_share double, available_tokens bigint, passes int, part double, blocks int")
    drawn = rec.where("n_tokens > 0").join(F.broadcast(plan_df), "source")  # at most MOST_SOURCES rows
    key = F.xxhash64(F.lit(seed), F.col("item_id"))
    drawn = drawn.withColumn("hash", key).withColumn("block", F.pmod("hash", "blocks"))
    sums = drawn.groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block"))
    run = sums.withColumn("upto", F.sum("in_block").over(Window.partitionBy("source").orderBy("block")))
    drawn = drawn.join(run, ["source", "block"])
    before = F.col("upto") - F.col("in_block")
    edge = (before < F.col("part")) & (F.col("upto") > F.col("part"))
    kept = drawn.where(~edge).withColumn("extra", (F.col("upto") <= F.col("part")).cast("int"))
    # one boundary block of about PER_BLOCK records per source
    edged = drawn.where(edge).select(*drawn.columns, (F.col("part") - before).alias("room"))
    schema = T.StructType([*drawn.schema.fields, T.StructField("extra", T.IntegerType())])
    cutting = edged.groupBy("source", "block").applyInPandas(_fill_room, schema)
    times = F.col("passes") + F.col("extra")
    every = kept.unionByName(cutting).where(times > 0)
    mixture = every.select("source", "item_id", F.explode(F.sequence(F.lit(1), times)).alias("pass_no"), "n_tokens")
    mixture = mixture.withColumn("order_key", F.xxhash64(F.lit(seed), F.col("pass_no"), F.col("item_id")))
    got = every.groupBy("source").agg(F.sum(F.col("n_tokens") * times).alias("tokens"), F.max(times).alias("repeats"))
    report = plan_df.join(got, "source", "left").select("source", "target_share", "available_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("repeats", F.lit(0)).alias("repeats"))
    whole = F.sum("tokens").over(Window.partitionBy())
    report = report.withColumn("actual_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(F.lit(0.0)))
    return mixture, report
