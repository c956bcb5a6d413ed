"""Path patterns, compiled on the driver into plain expressions: no UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default ignore globs and included extensions.
IGNORED = ["node_modules/**", "target/**", "dist/**", ".git/**", "*.lock", "__pycache__/**", ".venv/**", "venv/**"]
INCLUDED = ["rs", "ts", "tsx", "js", "jsx", "py", "go", "java", "md", "json", "toml", "yaml", "yml"]


def glob_match(pattern: str, text: Column) -> Column:
    """The search filter's glob: one ``**`` or one ``*`` splits into a prefix and a suffix test, else containment."""
    if not pattern:
        return text == ""
    if pattern.count("**") == 1:
        head, tail = (p.strip("/") for p in pattern.split("**"))
        ends = text.endswith(tail.split("*")[1]) if tail.count("*") == 1 else text.endswith(tail)
        return text.startswith(head) & ends
    if pattern.count("*") == 1:
        head, tail = pattern.split("*")
        return text.startswith(head) & text.endswith(tail)
    return text.contains(pattern)


def path_filter(patterns: list[str], path: Column) -> Column:
    """Any pattern contained in or matching the path; no pattern keeps everything, a null path fails any."""
    out: Column | None = None
    for p in patterns:
        hit = path.contains(p) | glob_match(p, path)
        out = hit if out is None else out | hit
    return F.lit(True) if out is None else F.coalesce(out, F.lit(False))


def glob_regex(glob: str) -> str:
    """A file glob as an anchored regular expression: ``**`` crosses folders, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def gitignore_globs(text: str) -> list[str]:
    """Rooted, folder and plain lines of an ignore file; blank lines, comments and negations are skipped."""
    out = []
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith(("#", "!")):
            continue
        if line.startswith("/"):
            out.append(line[1:])
        elif line.endswith("/"):
            out += [f"**/{line}**", f"**/{line[:-1]}"]
        else:
            out.append(f"**/{line}")
    return out


def ignored(path: Column, globs: list[str] | None = None, compat: bool = False) -> Column:
    """Whether a relative path is ignored. ``compat`` hides every path that contains ``.git``."""
    rules = "|".join(glob_regex(g) for g in (IGNORED if globs is None else globs))
    vcs = path.contains(".git") if compat else path.rlike(r"(^|/)\.git(/|$)")
    return vcs | (path.rlike(rules) if rules else F.lit(False))
