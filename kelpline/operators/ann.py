"""Approximate vector search by an inverted file: cells fitted on a bounded sample, a few probed per query.

Every row is indexed, in a table partitioned by cell, with the radius of each cell. A query reads its
nearest cells first and then every cell whose radius could hold a row as near as the k-th found, so
its rows are those of a full comparison; with ``probes`` it reads that many cells alone. Where the
table has the quantised columns, they stand in for missing vectors. Rows without a usable vector have
no cell and are never found.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.vectors import cosine, given_or_quantised, norm, normalise
from kelpline.runtime import SharedFiles

SAMPLE, LEAST_ROWS = 50_000, 1_000
#: Cells read before the bound is known.
FIRST = 8
QUANTISED = ("embedding_quantized", "embedding_min", "embedding_scale")


def _radii(placed: DataFrame, centroids: np.ndarray) -> dict[int, float]:
    """Largest distance of a row's ``_u`` from the centroid of its ``cell``."""

    def run(batches):
        for b in batches:
            if len(b):
                far = np.linalg.norm(np.stack(b["_u"].to_list()).astype(float) - centroids[b["cell"].to_numpy()], axis=1)
                yield pd.DataFrame({"cell": b["cell"], "far": far}).groupby("cell", as_index=False).max()

    return {r["cell"]: r["far"] for r in placed.select("cell", "_u").mapInPandas(run, "cell int, far double").groupBy("cell").agg(F.max("far").alias("far")).collect()}


class VectorIndex:
    def __init__(self, spark: SparkSession, home: str, centroids: np.ndarray, rows: int, checksum: int, radii: np.ndarray):
        self.radii = radii
        self.spark, self.home, self.centroids, self.rows, self.checksum = spark, home, centroids, rows, checksum

    @staticmethod
    def _unit(df: DataFrame, vec: str, dim: int) -> DataFrame:
        if set(QUANTISED) <= set(df.columns):
            df = df.withColumn(vec, given_or_quantised(F.col(vec), *map(F.col, QUANTISED)))
        usable = (F.size(vec) == dim) & (norm(F.col(vec)) > 0)
        return df.where(usable).withColumn("_u", normalise(F.col(vec)))

    @classmethod
    def build(cls, df: DataFrame, home: str, vec: str = "embedding", cells: int | None = None, seed: int = 7) -> VectorIndex:
        """Writes the table under ``home``; ``cells`` defaults to the root of the number of rows."""
        spark = df.sparkSession
        dim = df.where(F.col(vec).isNotNull()).select(F.size(vec).alias("n")).groupBy("n").count().orderBy(F.col("count").desc()).first()["n"]
        unit = cls._unit(df, vec, dim)
        stats = unit.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(vec)).alias("c")).first()
        n = stats["n"]
        cells = cells or max(1, min(4_096, round(n**0.5)))
        sample = unit.sample(False, min(1.0, 1.2 * SAMPLE / max(n, 1)), seed).limit(SAMPLE).select(array_to_vector("_u").alias("features"))
        model = KMeans(k=max(2, cells), seed=seed, maxIter=10).fit(sample)
        placed = model.transform(unit.withColumn("features", array_to_vector("_u"))).withColumnRenamed("prediction", "cell").drop("features")
        placed.drop("_u").write.mode("overwrite").partitionBy("cell").parquet(f"{home}/rows")
        centroids = np.stack(model.clusterCenters())
        far = _radii(placed, centroids)
        meta = {"centroids": centroids.tolist(), "radii": [far.get(c, -1.0) for c in range(len(centroids))], "rows": n, "checksum": stats["c"], "vec": vec}
        SharedFiles(spark, home).write("index.json", json.dumps(meta))
        return cls.load(spark, home)

    @classmethod
    def load(cls, spark: SparkSession, home: str) -> VectorIndex:
        meta = json.loads(SharedFiles(spark, home).read("index.json"))
        out = cls(spark, home, np.asarray(meta["centroids"]), meta["rows"], meta["checksum"], np.asarray(meta.get("radii") or [np.inf] * len(meta["centroids"])))
        out.vec = meta["vec"]
        return out

    def insert(self, df: DataFrame) -> None:
        """Appends rows to their nearest cells; the cells stay as fitted."""
        unit = self._unit(df, self.vec, self.centroids.shape[1])
        scores = [F.aggregate(F.zip_with("_u", F.array(*map(F.lit, c.tolist())), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) for c in self.centroids]
        nearest = F.array_position(F.array(*scores), F.array_min(F.array(*scores))) - 1
        placed = unit.withColumn("cell", nearest.cast("int"))
        # wider radii are stored first: a failed append leaves the bound valid
        for cell, far in _radii(placed, self.centroids).items():
            self.radii[cell] = max(self.radii[cell], far)
        files = SharedFiles(self.spark, self.home)
        files.write("index.json", json.dumps(json.loads(files.read("index.json")) | {"radii": self.radii.tolist()}))
        placed.drop("_u").write.mode("append").partitionBy("cell").parquet(f"{self.home}/rows")

    def _top(self, query: list[float], k: int, cells: list[int], keep: tuple[str, ...]) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.home}/rows").where(F.col("cell").isin(cells))
        return rows.select(*keep, cosine(F.col(self.vec), F.array(*[F.lit(float(x)) for x in query])).alias("similarity")).orderBy(F.col("similarity").desc(), *keep).limit(k)

    def cells_within(self, query: list[float], k: int) -> list[int]:
        """Cells that hold the k most similar rows: the others are farther than the k-th row of the nearest ones."""
        q = np.asarray(query, float)
        length = float(np.linalg.norm(q))
        away = np.sqrt(((self.centroids - (q / length if length else q)) ** 2).sum(1))
        first = np.argsort(away, kind="stable")[:FIRST].tolist()
        found = [r["similarity"] for r in self._top(query, k, first, ()).collect()]
        if not length or len(found) < k or not found:
            return list(range(len(away)))
        reach = (2 - 2 * (found[-1] - 1e-9)) ** 0.5 + 1e-6
        return np.nonzero((self.radii >= 0) & (away - self.radii <= reach))[0].tolist()

    def search(self, query: list[float], k: int, probes: int | None = None, least: float | None = None, keep: tuple[str, ...] = ("id",)) -> DataFrame:
        """The k most similar rows, of the ``probes`` nearest cells if given; ``least`` is applied after the k are taken."""
        if probes is None:
            cells = self.cells_within(query, k)
        else:
            q = np.asarray(query, float)
            length = float(np.linalg.norm(q))
            cells = np.argsort(((self.centroids - (q / length if length else q)) ** 2).sum(1), kind="stable")[:probes].tolist()
        top = self._top(query, k, cells, keep)
        return top if least is None else top.where(F.col("similarity") >= least)

    def matches(self, df: DataFrame) -> bool:
        """Whether the index was built from these vectors."""
        s = self._unit(df, self.vec, self.centroids.shape[1]).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(self.vec)).alias("c")).first()
        return (s["n"], s["c"]) == (self.rows, self.checksum)

    def clear(self) -> None:
        SharedFiles(self.spark, self.home).remove("index.json")
