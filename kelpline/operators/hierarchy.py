"""Parent-child rows to full hierarchies by bottom-up leaf peeling.

Peeling: a node without unpeeled children is a leaf; each round peels all leaves at once and sends
their subtree sizes to their parents (aggregated before the shuffle, so a parent of a third of all
rows costs one row per map task). Because a node has one parent, whatever cannot be peeled is exactly
the set of nodes on cycles. The reverse of the peel order then hands path, depth and root from
parents to children. Once the unpeeled rest is at most ``tail_rows`` rows, that rest is finished in
one task, which holds the rest and the way from a root to one node, however long its paths are; above
the bound, rounds stay distributed. Cycles alone need no paths: peeling stops at what is left.

Defined results: rows with a null id are no nodes; of rows that share an id the smallest
(parent, name) counts, so exact copies merge; a parent that is not in the table ends the chain, and
the node is a root with ``parent_missing``; a null or empty name is written as ``#<id>`` in paths;
columns other than the three named are ignored; an empty table gives an empty hierarchy.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpline.runtime import cut, scratch

SCHEMA = T.StructType(
    [
        T.StructField("node_id", T.LongType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("status", T.StringType()),  # tree, cycle, below_cycle
        T.StructField("cycle_id", T.LongType()),
        T.StructField("root_id", T.LongType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("ancestors", T.ArrayType(T.LongType())),  # root first, the node itself excluded
        T.StructField("n_descendants", T.LongType()),
        T.StructField("parent_missing", T.BooleanType()),
    ]
)
TAIL_ROWS = 200_000


def _label() -> Column:
    return F.when(F.coalesce(F.col("name"), F.lit("")) == "", F.concat(F.lit("#"), F.col("node_id"))).otherwise(F.col("name"))


def _edges(df: DataFrame, id_col: str, parent_col: str, name_col: str) -> DataFrame:
    """node_id, parent_id (null where it leads nowhere), label, parent_missing, pending children."""
    picked = df.select(F.col(id_col).cast("long").alias("node_id"), F.struct(F.col(parent_col).cast("long").alias("p"), F.col(name_col).cast("string").alias("name")).alias("r"))
    nodes = picked.where(F.col("node_id").isNotNull()).groupBy("node_id").agg(F.min("r").alias("r")).select("node_id", F.col("r.p").alias("p"), F.col("r.name").alias("name"))
    nodes = cut(nodes)
    kids = nodes.where(F.col("p").isNotNull()).groupBy("p").agg(F.count(F.lit(1)).alias("pending"))
    known = nodes.select(F.col("node_id").alias("k"))
    kids = kids.join(known, kids.p == known.k, "left")
    missing = kids.where(F.col("k").isNull()).select(F.col("p").alias("gone"))
    state = nodes.join(kids.where(F.col("k").isNotNull()).select("k", "pending"), F.col("node_id") == F.col("k"), "left")
    state = state.join(missing, F.col("p") == F.col("gone"), "left")
    return state.select(
        "node_id",
        F.when(F.col("gone").isNull(), F.col("p")).alias("parent_id"),
        _label().alias("label"),
        F.col("gone").isNotNull().alias("parent_missing"),
        F.coalesce("pending", F.lit(0)).cast("long").alias("pending"),
        F.lit(0).cast("long").alias("below"),
    )


class _Rest:
    """A bounded rest of the forest in one task: peeled, with its cycles."""

    def __init__(self, batches: Iterator[pd.DataFrame]):
        got = [b for b in batches if len(b)]
        rest = pd.concat(got, ignore_index=True) if got else pd.DataFrame(columns=["node_id", "parent_id", "label", "parent_missing", "pending", "below"])
        self.ids = rest.node_id.tolist()
        self.parent = dict(zip(self.ids, (None if pd.isna(p) else int(p) for p in rest.parent_id)))
        self.label, self.lost = dict(zip(self.ids, rest.label)), dict(zip(self.ids, rest.parent_missing))
        self.below, pending = dict(zip(self.ids, rest.below.tolist())), dict(zip(self.ids, rest.pending.tolist()))
        self.order: list[int] = []  # peeled nodes, leaves first
        ready = [i for i in self.ids if pending[i] == 0]
        while ready:
            nxt = []
            for i in ready:
                self.order.append(i)
                p = self.parent[i]
                if p is not None:
                    self.below[p] += self.below[i] + 1
                    pending[p] -= 1
                    if pending[p] == 0:
                        nxt.append(p)
            ready = nxt
        peeled, self.cycle = set(self.order), {}
        for i in self.ids:
            if i not in peeled and i not in self.cycle:
                ring, j = [i], self.parent[i]
                while j != i:
                    ring.append(j)
                    j = self.parent[j]
                self.cycle.update(dict.fromkeys(ring, min(ring)))

    def rows(self) -> Iterator[tuple]:
        """Rows of ``SCHEMA``. Trees are walked depth first: only the way from the root to the node is held."""
        for i, least in self.cycle.items():
            yield (i, self.parent[i], "cycle", least, None, None, None, None, None, bool(self.lost[i]))
        kids: dict[int | None, list[int]] = {}
        for i in self.order:
            kids.setdefault(self.parent[i], []).append(i)
        under = [(k, least) for i, least in self.cycle.items() for k in kids.get(i, [])]
        while under:
            i, least = under.pop()
            yield (i, self.parent[i], "below_cycle", least, None, None, None, None, self.below[i], bool(self.lost[i]))
            under.extend((k, least) for k in kids.get(i, []))
        up: list[int] = []
        names: list[str] = []
        walk = [(i, 0) for i in kids.get(None, [])]
        while walk:
            i, depth = walk.pop()
            del up[depth:], names[depth:]
            names.append(self.label[i])
            yield (i, self.parent[i], "tree", None, up[0] if up else i, depth, "/".join(names), list(up), self.below[i], bool(self.lost[i]))
            up.append(i)
            walk.extend((k, depth + 1) for k in kids.get(i, []))


#: Ancestors and rows of an output batch of the last task.
BATCH = 200_000


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Peels a bounded rest and assigns it top-down."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=SCHEMA.names)
        for c in ("parent_id", "cycle_id", "root_id", "n_descendants"):
            out[c] = out[c].astype("Int64")
        out["depth"] = out["depth"].astype("Int32")
        return out

    rows, held = [], 0
    for row in _Rest(batches).rows():
        rows.append(row)
        held += 1 + len(row[7] or ())
        if held > BATCH:
            yield frame(rows)
            rows, held = [], 0
    if rows:
        yield frame(rows)


def _finish_cycles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a bounded rest only the cycles: what cannot be peeled."""
    rest = _Rest(batches)
    yield pd.DataFrame({"cycle_id": list(rest.cycle.values()), "node_id": list(rest.cycle)}, dtype="int64")


def _rings(rest: DataFrame) -> DataFrame:
    """Cycle nodes to the smallest id of their cycle, by pointer doubling: log2(longest cycle) rounds."""
    ptr = rest.select("node_id", F.col("parent_id").alias("next"), F.least("node_id", "parent_id").alias("least"))
    while True:
        far = ptr.select(F.col("node_id").alias("n"), F.col("next").alias("far"), F.col("least").alias("other"))
        step = cut(ptr.join(far, F.col("next") == F.col("n")).select("node_id", F.col("far").alias("next"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("moved")))
        ptr = step.drop("moved")
        if step.where("moved").isEmpty():
            return ptr.select("node_id", "least")


def peel(df: DataFrame, id_col: str, parent_col: str, name_col: str, tail_rows: int = TAIL_ROWS) -> tuple[DataFrame, list[DataFrame], bool]:
    """(rest, layers, ends): the layers peeled, lowest first, and what is left; ``ends`` if that is cycles alone."""
    state = cut(_edges(df, id_col, parent_col, name_col))
    layers: list[DataFrame] = []
    while state.count() > tail_rows:
        leaves = state.where("pending = 0")
        if leaves.isEmpty():
            return state, layers, True
        mail = leaves.where("parent_id is not null").groupBy(F.col("parent_id").alias("to")).agg(F.count(F.lit(1)).alias("gone"), F.sum(F.col("below") + 1).alias("size"))
        layers.append(leaves)
        rest = state.where("pending > 0").join(mail, F.col("node_id") == F.col("to"), "left")
        state = cut(rest.select("node_id", "parent_id", "label", "parent_missing", (F.col("pending") - F.coalesce("gone", F.lit(0))).alias("pending"), (F.col("below") + F.coalesce("size", F.lit(0))).alias("below")))
    return state, layers, False


def _top(rest: DataFrame, ends: bool) -> DataFrame:
    """The rest assigned: its trees and cycles."""
    if not ends:
        return cut(rest.coalesce(1).mapInPandas(_finish, SCHEMA))
    nothing = {"root_id": "long", "depth": "int", "path": "string", "ancestors": "array<bigint>", "n_descendants": "long"}
    ring = rest.join(_rings(rest), "node_id").withColumns({"status": F.lit("cycle"), "cycle_id": F.col("least"), **{c: F.lit(None).cast(t) for c, t in nothing.items()}})
    return cut(ring.select(*SCHEMA.names))


def build_hierarchy(df: DataFrame, id_col: str, parent_col: str, name_col: str, tail_rows: int = TAIL_ROWS) -> DataFrame:
    """One row per node, columns of ``SCHEMA``."""
    rest, layers, ends = peel(df, id_col, parent_col, name_col, tail_rows)
    top = _top(rest, ends)
    if not layers:
        return top
    spark, last = df.sparkSession, len(layers)
    peeled = None
    for k, layer in enumerate(layers):
        part = layer.select("node_id", "parent_id", "label", "parent_missing", "below", F.lit(k).alias("layer"))
        peeled = part if peeled is None else peeled.unionByName(part)
    where = peeled.select(F.col("node_id").alias("w"), F.col("layer").alias("parent_layer")).unionByName(top.select(F.col("node_id").alias("w"), F.lit(last).alias("parent_layer")))
    waiting = scratch(spark, "waiting")
    peeled.where("parent_id is not null").join(where, F.col("parent_id") == F.col("w")).drop("w").write.partitionBy("parent_layer").parquet(waiting)
    placed = scratch(spark, "placed")
    roots = peeled.where("parent_id is null").select(
        "node_id", "parent_id", F.lit("tree").alias("status"), F.lit(None).cast("long").alias("cycle_id"), F.col("node_id").alias("root_id"), F.lit(0).alias("depth"), F.col("label").alias("path"), F.array().cast("array<bigint>").alias("ancestors"), F.col("below").alias("n_descendants"), "parent_missing", "layer"
    )
    roots.write.partitionBy("layer").parquet(f"{placed}/step={last + 1}")
    top.withColumn("layer", F.lit(last)).write.partitionBy("layer").parquet(f"{placed}/step={last}")
    full = T.StructType([*SCHEMA.fields, T.StructField("step", T.IntegerType()), T.StructField("layer", T.IntegerType())])
    kids_schema = spark.read.parquet(waiting).schema
    for s in range(last, 0, -1):
        ready = spark.read.schema(full).parquet(placed).where(F.col("layer") == s).select(F.col("node_id").alias("p"), F.col("status").alias("p_status"), F.col("cycle_id").alias("p_cycle"), F.col("root_id").alias("p_root"), F.col("depth").alias("p_depth"), F.col("path").alias("p_path"), F.col("ancestors").alias("p_up"))
        kids = spark.read.schema(kids_schema).parquet(waiting).where(F.col("parent_layer") == s)
        tree = F.col("p_status") == "tree"
        kids.join(ready, F.col("parent_id") == F.col("p")).select(
            "node_id", "parent_id",
            F.when(tree, F.lit("tree")).otherwise(F.lit("below_cycle")).alias("status"),
            F.col("p_cycle").alias("cycle_id"), F.col("p_root").alias("root_id"), (F.col("p_depth") + 1).alias("depth"),
            F.concat(F.col("p_path"), F.lit("/"), F.col("label")).alias("path"), F.concat(F.col("p_up"), F.array("p")).alias("ancestors"),
            F.col("below").alias("n_descendants"), "parent_missing", "layer",
        ).write.partitionBy("layer").parquet(f"{placed}/step={s - 1}")
    return spark.read.schema(full).parquet(placed).select(*SCHEMA.names)


def descendants(tree: DataFrame) -> DataFrame:
    """All descendants of every node outside cycles, one row per (ancestor_id, descendant_id, distance)."""
    up = tree.where("status = 'tree' and depth > 0").select("node_id", "depth", F.posexplode("ancestors").alias("at", "ancestor_id"))
    return up.select("ancestor_id", F.col("node_id").alias("descendant_id"), (F.col("depth") - F.col("at")).alias("distance"))


def cycle_members(df: DataFrame, id_col: str, parent_col: str, name_col: str, tail_rows: int = TAIL_ROWS) -> DataFrame:
    """cycle_id (smallest id on the cycle) and node_id of every node that is its own ancestor."""
    rest, _, ends = peel(df, id_col, parent_col, name_col, tail_rows)
    if ends:
        return _rings(rest).select(F.col("least").alias("cycle_id"), "node_id")
    return rest.select("node_id", "parent_id", "label", "parent_missing", "pending", "below").coalesce(1).mapInPandas(_finish_cycles, "cycle_id bigint, node_id bigint")
