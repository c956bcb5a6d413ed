"""Filling fixed-capacity containers with items: pattern packing by non-negative least squares.

Items of less than an eighth of the capacity are gathered first, in bounded blocks, into bundles of up to a
quarter; a third of them stays loose to fill what is left over. Bundles and larger items are units. Unit
sizes are counted into classes (the histogram is bounded by the number of classes, not by the data);
patterns of few classes that fill a container are enumerated; repeat counts are fitted to the histogram by
non-negative least squares and rounded down; units get their pattern slot by their number within the
class. What is left is packed best-fit in bounded blocks, first into the room that patterns have left.

Defined results: an item longer than the capacity is split into full pieces and one remainder, no
other item is split; an item of size 0 (empty or null text) occupies no container (null
``container``); ids must be unique, exact copies of an id are merged to the largest size; null ids
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.tokens import numbered
from kelpline.runtime import cut

CLASSES = 40
MOST_ITEMS = 4
LEAST_FILL = 0.95
BLOCK = 20_000
#: Bundles hold up to this part of a container; items of half of that are bundled, but for one in LOOSE.
BUNDLE, LOOSE = 4, 3


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    grad = a.T @ (b - a @ x)
    tol = 1e-9 * max(1.0, float(np.abs(grad).max(initial=0)))
    for _ in range(rounds):
        free = np.where(active, -np.inf, grad)
        j = int(np.argmax(free)) if n else 0
        if n == 0 or free[j] <= tol:
            break
        active[j] = True
        while True:
            z = np.zeros(n)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (z[active] > 0).all():
                x = z
                break
            bad = active & (z <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
            x = x + step * (z - x)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                break
        grad = a.T @ (b - a @ x)
    return x


def patterns(tops: list[int], capacity: int, most: int = MOST_ITEMS, least_fill: float = LEAST_FILL) -> np.ndarray:
    """Columns: counts per class of every combination of at most ``most`` items that fills a container well enough."""
    found: list[list[int]] = []

    def extend(start: int, room: int, chosen: list[int]) -> None:
        if chosen and room <= (1 - least_fill) * capacity:
            found.append(chosen)
        if len(chosen) == most:
            return
        for j in range(start, -1, -1):
            if tops[j] <= room:
                extend(j, room - tops[j], [*chosen, j])

    extend(len(tops) - 1, capacity, [])
    out = np.zeros((len(tops), len(found)))
    for p, chosen in enumerate(found):
        for j in chosen:
            out[j, p] += 1
    return out


def fit(histogram: dict[int, int], tops: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, repeats) that never ask for more items of a class than there are."""
    a = patterns(tops, capacity)
    h = np.array([histogram.get(j, 0) for j in range(len(tops))], float)
    if a.shape[1] == 0 or not h.any():
        return []
    x = np.floor(nnls(a, h) + 1e-9)
    for p in np.argsort(x):  # rounding and misfit may overdraw a class
        over = a @ x - h
        if x[p] > 0 and (over[a[:, p] > 0] > 0).any():
            x[p] = max(0, x[p] - np.ceil(np.max(over[a[:, p] > 0] / a[a[:, p] > 0, p])))
    left = h - a @ x
    for p in np.argsort(-a.sum(0)):  # what still fits of the fitted kind
        if x[p] > 0:
            more = np.floor(np.min(left[a[:, p] > 0] / a[a[:, p] > 0, p]))
            if more > 0:
                x[p] += more
                left -= more * a[:, p]
    return [(a[:, p].astype(int), int(x[p])) for p in np.nonzero(x)[0]]


def _best_fit(capacity: int, name: str):
    """Best fit of a block's items, longest first, into the room of open containers and then into new ones."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        block = part["block"].iloc[0]
        open_ = part[part["container"].notna()].sort_values("container")
        names = open_["container"].tolist()
        rooms = sorted((room, c) for c, room in enumerate(open_["size"].tolist()))
        items = part[part["container"].isna()].sort_values(["size", "item_id", "piece"], ascending=[False, True, True], ignore_index=True)
        where = []
        for size in items["size"].tolist():
            at = bisect.bisect_left(rooms, (size, -1))
            if at < len(rooms):
                room, c = rooms.pop(at)
            else:
                room, c = capacity, len(names)
                names.append(f"{name}{block}-{c}")
            where.append(names[c])
            if room > size:
                bisect.insort(rooms, (room - size, c))
        return pd.DataFrame({"item_id": items["item_id"].astype("int64"), "piece": items["piece"].astype("int64"), "start": items["start"].astype("int64"), "size": items["size"], "container": where})

    return pack


_OUT = "item_id bigint, piece bigint, start bigint, size bigint, container string"


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """``sizes``: (item_id, n_tokens). One row per piece: item_id, piece, start, size, container."""
    items = sizes.groupBy("item_id").agg(F.max("n_tokens").alias("n"))
    full, rest = (F.col("n") / capacity).cast("bigint"), F.col("n") % capacity
    whole = items.where(F.col("n") >= capacity).select("item_id", F.posexplode(F.sequence(F.lit(0), full - 1)).alias("piece", "x"))
    whole = whole.select("item_id", F.col("piece").cast("bigint").alias("piece"), (F.col("piece") * F.lit(capacity)).cast("bigint").alias("start"), F.lit(capacity).cast("bigint").alias("size"), F.concat(F.lit("f"), F.col("item_id"), F.lit("-"), F.col("piece")).alias("container"))
    empty = items.where("n = 0").select("item_id", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("string").alias("container"))
    width = capacity / CLASSES
    tops = [min(capacity, int(np.floor((j + 1) * width))) for j in range(CLASSES)]
    part, hashed = max(1, capacity // BUNDLE), F.xxhash64("item_id")
    loose = items.where(rest > 0).select("item_id", full.alias("piece"), (full * capacity).cast("bigint").alias("start"), rest.cast("bigint").alias("size"))
    loose = cut(loose.withColumn("small", F.col("size") * 2 <= part).withColumn("kept", F.pmod(hashed, F.lit(LOOSE)) == 0))
    n = {(r["small"], r["kept"]): r["n"] for r in loose.groupBy("small", "kept").agg(F.count(F.lit(1)).alias("n")).collect()}
    none, blocks = F.lit(None).cast("string"), n.get((True, False), 0) // BLOCK + 1
    # the block must not follow from the hash that kept items back
    spread = F.pmod(F.xxhash64("item_id", F.lit(1)), F.lit(blocks)).alias("block")
    gather = loose.where("small and not kept").select("item_id", "piece", "start", "size", none.alias("container"), spread)
    bundled = gather.groupBy("block").applyInPandas(_best_fit(part, "b"), _OUT).withColumnRenamed("container", "unit")
    single = loose.where("not small").select("item_id", "piece", "start", "size", F.concat(F.lit("i"), "item_id").alias("unit"))
    members = cut(bundled.unionByName(single))
    edges = F.array(*[F.lit(t) for t in tops])
    units = members.groupBy("unit").agg(F.sum("size").alias("size")).withColumn("class", F.size(F.filter(edges, lambda t: t < F.col("size"))))
    histogram = {r["class"]: r["n"] for r in units.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most CLASSES rows
    slots: dict[int, list] = {}
    base, taken = 0, np.zeros(CLASSES, int)
    for counts, repeats in fit(histogram, tops, capacity):
        for j in np.nonzero(counts)[0]:
            a = int(counts[j])
            slots.setdefault(int(j), []).append((int(taken[j]), int(taken[j]) + a * repeats, a, base))
            taken[j] += a * repeats
        base += repeats
    ranges = sizes.sparkSession.createDataFrame(list(slots.items()), "class int, slots array<struct<lo:bigint,hi:bigint,each:bigint,base:bigint>>")
    # at most CLASSES rows of at most as many ranges
    counted = numbered(units, ["class"], "unit", sum(histogram.values())).join(F.broadcast(ranges), "class")
    hit = F.get(F.filter("slots", lambda s: (s["lo"] <= F.col("k")) & (F.col("k") < s["hi"])), F.lit(0))
    slotted = counted.withColumn("hit", hit).where("hit is not null")
    slotted = slotted.select("unit", F.concat(F.lit("p"), F.col("hit.base") + F.floor((F.col("k") - F.col("hit.lo")) / F.col("hit.each"))).alias("container"))
    placed = cut(members.join(slotted, "unit", "left"))
    still = placed.where("container is null").select("item_id", "piece", "start", "size").unionByName(loose.where("small and kept").select("item_id", "piece", "start", "size"))
    placed = placed.where("container is not null").select("item_id", "piece", "start", "size", "container")
    over = n.get((True, True), 0) + sum(histogram.values()) - int(taken.sum())
    blocks = max(1, over // BLOCK + 1, base // BLOCK + 1)
    left = still.withColumn("container", none).withColumn("block", F.pmod(F.xxhash64("item_id", F.lit(2)), F.lit(blocks)))
    room = placed.groupBy("container").agg((F.lit(capacity) - F.sum("size")).alias("size")).where("size > 0")
    no_id = F.lit(None).cast("bigint")
    room = room.select(no_id.alias("item_id"), no_id.alias("piece"), no_id.alias("start"), "size", "container", F.pmod(F.xxhash64("container"), F.lit(blocks)).alias("block"))
    packed = left.unionByName(room).groupBy("block").applyInPandas(_best_fit(capacity, "r"), _OUT)
    return whole.unionByName(empty).unionByName(placed).unionByName(packed)


def fill_report(packed: DataFrame) -> DataFrame:
    """containers, tokens, and items that were split."""
    whole = packed.agg(F.count_distinct("container").alias("containers"), F.sum("size").alias("tokens"))
    split = packed.groupBy("item_id").agg(F.count(F.lit(1)).alias("pieces")).agg(F.count_if(F.col("pieces") > 1).alias("split_items"))
    both = whole.unionByName(split, allowMissingColumns=True)
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])
