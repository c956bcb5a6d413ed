"""Version history as rows, by the ``git`` program where it is there; facts then live in ordinary tables."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

COMMITS = "hash string, author string, email string, message string, ts bigint"
CHANGES = "hash string, path string, status string, ts bigint"
HUNKS = "start_line int, n_lines int, hash string, author string, ts bigint"


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, text=True, errors="replace").stdout


def commits(spark: SparkSession, root: str, limit: int = 1000) -> DataFrame:
    out = _git(root, "log", f"-n{limit}", "--format=%H%x1f%an%x1f%ae%x1f%s%x1f%ct%x1e")
    rows = [r.strip("\n").split("\x1f") for r in out.split("\x1e") if r.strip()]
    return spark.createDataFrame([(*r[:4], int(r[4])) for r in rows], COMMITS)


def file_changes(spark: SparkSession, root: str, limit: int = 1000) -> DataFrame:
    """Paths that differ from the first parent; a root commit touches all its paths."""
    out = _git(root, "log", f"-n{limit}", "--first-parent", "-m", "--root", "--name-status", "--no-renames", "--format=%x1e%H%x1f%ct")
    rows = []
    for block in out.split("\x1e")[1:]:
        head, *lines = block.strip("\n").split("\n")
        h, ts = head.split("\x1f")
        rows += [(h, x.split("\t", 1)[1], x[0], int(ts)) for x in lines if "\t" in x]
    return spark.createDataFrame(rows, CHANGES)


def file_commits(changes: DataFrame, path: str, limit: int) -> DataFrame:
    """Newest commits that touch a path and leave it in the tree."""
    from pyspark.sql import functions as F

    return changes.where((F.col("path") == path) & (F.col("status") != "D")).orderBy(F.col("ts").desc()).limit(limit)


def blame(spark: SparkSession, root: str, path: str) -> DataFrame:
    out, rows, at = _git(root, "blame", "--incremental", "--", path), [], {}
    author: dict[str, tuple[str, int]] = {}
    for line in out.split("\n"):
        p = line.split(" ")
        if len(p) == 4 and len(p[0]) == 40:
            at = {"h": p[0], "start": int(p[2]), "n": int(p[3])}
        elif line.startswith("author "):
            author[at["h"]] = (line[7:], 0)
        elif line.startswith("author-time "):
            author[at["h"]] = (author[at["h"]][0], int(line[12:]))
        elif line.startswith("filename ") and at:
            rows.append((at["start"], at["n"], at["h"], *author.get(at["h"], ("", 0))))
    return spark.createDataFrame(sorted(rows), HUNKS)


def uncommitted(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame([(_git(root, "diff", "HEAD"),)], "patch string")
