"""Queries of the general corpus problems (hierarchies, change capture) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators.change_capture import changes_by_run
from kelpline.operators.hierarchy import build_hierarchy, cycle_members, descendants
from kelpline.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle_members(table(spark, sf_dir, "symbols"), "id", "parent_symbol_id", "name").select("cycle_id", F.col("node_id").alias("symbol_id"))


def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = build_hierarchy(table(spark, sf_dir, "symbols"), "id", "parent_symbol_id", "name")
    return tree.select(F.col("node_id").alias("symbol_id"), "status", "cycle_id", "root_id", "depth", "path", "n_descendants", "parent_missing")


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(build_hierarchy(table(spark, sf_dir, "symbols"), "id", "parent_symbol_id", "name"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes_by_run(table(spark, sf_dir, "file_inserts"), table(spark, sf_dir, "index_runs")).select("run_id", "path")


QUERIES = {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_descendants": p1_descendants, "p5_found": p5_found}

_NODES = """nodes AS (SELECT id, min(parent_symbol_id) AS p, any_value(name) AS name FROM symbols WHERE id IS NOT NULL GROUP BY id),
linked AS (SELECT n.id, CASE WHEN k.id IS NOT NULL THEN n.p END AS p, n.p IS NOT NULL AND k.id IS NULL AS gone,
 CASE WHEN coalesce(n.name, '') = '' THEN '#' || n.id ELSE n.name END AS label FROM nodes n LEFT JOIN nodes k ON n.p = k.id)"""
_TREE = f"""{_NODES},
tree AS (SELECT id, id AS root_id, 0 AS depth, label AS path, CAST([] AS BIGINT[]) AS up, gone FROM linked WHERE p IS NULL
 UNION ALL SELECT c.id, t.root_id, t.depth + 1, t.path || '/' || c.label, list_append(t.up, t.id), c.gone FROM linked c JOIN tree t ON c.p = t.id)"""
_CYCLES = f"""{_NODES},
tree0 AS (SELECT id FROM linked WHERE p IS NULL UNION ALL SELECT c.id FROM linked c JOIN tree0 t ON c.p = t.id),
walk AS (SELECT id AS start, p AS here FROM linked WHERE p IS NOT NULL AND id NOT IN (SELECT id FROM tree0)
 UNION SELECT w.start, l.p FROM walk w JOIN linked l ON w.here = l.id WHERE w.here <> w.start),
ring AS (SELECT DISTINCT start FROM walk WHERE start = here),
least AS (SELECT w.start AS symbol_id, least(min(w.here), w.start) AS cycle_id FROM walk w JOIN ring r ON w.start = r.start GROUP BY w.start)"""

ORACLE = {
    "p1_found": f"WITH RECURSIVE {_CYCLES} SELECT cycle_id, symbol_id FROM least",
    "p1_descendants": f"WITH RECURSIVE {_TREE} SELECT a AS ancestor_id, id AS descendant_id, depth - i + 1 AS distance FROM (SELECT id, depth, unnest(up) AS a, generate_subscripts(up, 1) AS i FROM tree)",
    "p5_found": r"""WITH feed AS (SELECT regexp_replace(regexp_replace(replace(path, '\', '/'), '/(\./|/)+', '/', 'g'), '^(\./)+', '') AS path, hash, modified_at, insert_id, batch_no FROM file_inserts),
ok AS (SELECT run_id, last_batch_no, lag(last_batch_no) OVER (ORDER BY run_id) AS prev FROM index_runs WHERE status = 'succeeded'),
cur AS (SELECT r.run_id, f.path, arg_max(f.hash, (f.modified_at, f.insert_id)) AS h FROM ok r JOIN feed f ON f.batch_no <= r.last_batch_no GROUP BY ALL),
old AS (SELECT r.run_id, f.path, arg_max(f.hash, (f.modified_at, f.insert_id)) AS h FROM ok r JOIN feed f ON f.batch_no <= r.prev GROUP BY ALL)
SELECT c.run_id, c.path FROM cur c LEFT JOIN old o ON c.run_id = o.run_id AND c.path = o.path WHERE o.path IS NULL OR c.h <> o.h""",
}
