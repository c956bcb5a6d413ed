"""Generated, minified, vendored and data files, by Re-Pair grammars over token sequences.

Three grammars are inferred for every file, for a batch of files at once in NumPy rounds. A round counts
the pairs of every file and replaces, at once, each pair that is more frequent than the pairs it overlaps;
rounds go on until no pair of a file occurs twice.
* Over token classes (names, numbers and strings are one class each): ``reuse`` is the share of the file
  that lies in rules of at least ``RULE_TOKENS`` tokens. High reuse under a grammar that hardly grows with
  the file flags generated code; reused records around incompressible digests flag lock files.
* Over literals (numbers, unbroken long strings in pieces): a literal sequence whose grammar is about as
  large as itself is incompressible; where such literals fill the file it is data.
* Over the exact tokens: rules are keyed by a rolling hash of what they expand to, so equal text has equal
  rules in every file. What the start rule leaves is cut into phrases by content, and phrases and rules
  found in several repositories (counted over all files) flag copies by the share of the file they cover.
Upstream names of package folders and notices of origin are rules of the corpus too: they count only where
the same phrase stands in several repositories. Notices of generation only lower the reuse that is asked
for. Lines without layout mark minified code.

Defined results: files without content, or with null paths, are never marked; copies are judged alike;
the first segment of the path names the repository; a folder or notice found in one repository alone never
decides; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.runtime import cut

#: Tokens of a rule that says something about its file, and of a rule or phrase that says something about its origin.
RULE_TOKENS, SHARED_TOKENS = 12, 32
LEAST_TOKENS = 60
#: Code of n tokens is generated if rules cover REUSE of it and its grammar has fewer than GRAMMAR * n ** POWER symbols.
REUSE, GRAMMAR, POWER = 0.8, 10.0, 0.4
#: The reuse asked of a file that says it was generated.
NOTED_REUSE = 0.5
#: Lock files: reuse, and the share of characters in digests.
LOCK_REUSE, DIGESTS = 0.8, 0.25
#: Data: symbols of the literal grammar per literal, and share of the characters in such literals.
INCOMPRESSIBLE, DATA = 0.6, 0.85
SHARED = 0.5
BATCH_TOKENS = 400_000

_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\w\s]")
#: Reserved words of the languages of the data; they keep their identity in the class grammar.
KEYWORDS = frozenset("and as async await begin break case catch class const continue def default defer do else elsif end enum except export extends extern false final finally fn for from func function go if impl implements import in interface is lambda let loop match mod module mut namespace new nil none not null or package pass pub public private protected raise require rescue return self static struct super switch template this throw throws true try type unless unsafe use using var void while with yield".split())
_BANNER = re.compile(
    r"(?i)code generated by\b|this file (?:is|was) (?:automatically |auto-?)generated|\bauto-?generated (?:file|by)\b|<auto-generated|@generated\b|generated from \S+ on build|generated by .{1,60}do not (?:edit|modify)|do not edit(?: by hand| manually)?[.!]?\s*$|manual edits are overwritten"
)
_SCHEMA = re.compile(r"(?i)^\W*source:\s*\S+\.\w+\W*$")
_DIGEST = re.compile(r"(?i)^\W*digest:\s*[0-9a-f]{16,}\W*$")
_UPSTREAM = re.compile(r"(?i)vendored from|copied (?:verbatim )?from|@license\s|third-party code|imported unchanged from upstream|released under the (?:mit|bsd|apache|isc)|see upstream")
_PACKAGE_DIR = re.compile(r"/(?:vendor|node_modules|third_party|thirdparty|external|extern|deps|Pods|bower_components|site-packages|Carthage)/([^/]+)(?=/)")
_VERSION = re.compile(r"[-@_.]?v?\d[\w.+-]*$")
_LINE = re.compile(r"[^\n]+")
_LOCK = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.ya?ml|yarn\.lock|[^/]*\.lock(?:\.(?:json|toml|ya?ml))?|[^/]*[-.]lock\.(?:json|toml|ya?ml)|go\.sum|Gemfile\.lock|poetry\.lock)$")
_COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|--|;|<!--|\"\"\"|%)")
_LITERAL = re.compile(r"(?P<long>(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2})|0[xX][0-9a-fA-F]+|-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|(?:\\x[0-9a-fA-F]{2})+")
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x * _MIX
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _class(token: str) -> int:
    if token[0].isdigit():
        return 1
    if token[0] in "\"'" and len(token) > 1:
        return 2
    if (token[0].isalpha() or token[0] == "_") and token.lower() not in KEYWORDS:
        return 0
    return 3 + xxhash.xxh32_intdigest(token) % (1 << 20)


def _coded(sequences: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tokens, their number at every position, the sequence of every position, lengths)."""
    numbers: dict[str, int] = {}
    lengths = np.array([len(x) for x in sequences], np.int64)
    flat = np.fromiter((numbers.setdefault(t, len(numbers)) for x in sequences for t in x), np.int64, int(lengths.sum()))
    return list(numbers), flat, np.repeat(np.arange(len(sequences)), lengths), lengths


def _picked(pair: np.ndarray, inv: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs to replace in this round, pairs that recur): a pair goes before those it overlaps if it is more frequent.

    Of a run of one symbol every other pair counts; equal counts are ordered by the pair, so the first
    pair of a file is always replaced wherever it counts.
    """
    at = np.arange(len(pair))
    again = np.r_[False, live[1:] & live[:-1] & (pair[1:] == pair[:-1])]
    counts = live & ((at - np.maximum.accumulate(np.where(again, 0, at))) % 2 == 0)
    count = np.bincount(inv[counts], minlength=int(inv.max()) + 1)
    alive = live & (count[inv] > 1)
    rank = np.where(alive & counts, count[inv] * len(count) + inv + 1, 0)
    pick = (rank > np.r_[0, rank[:-1]]) & (rank > np.r_[rank[1:], 0])
    return pick & (np.bincount(inv[pick], minlength=len(count))[inv] > 1), alive


class Grammar:
    """Re-Pair grammars of many files: the symbols left in every start rule, with their tokens and content keys.

    A pair that occurs once never recurs, whatever is replaced beside it: symbols between two such pairs
    are final and leave the rounds.
    """

    def __init__(self, symbols: np.ndarray, files: np.ndarray, n_files: int, keyed: bool = False):
        n, files = len(symbols), files.astype(np.int64)
        _, sym = np.unique(symbols, return_inverse=True)
        _, sym = np.unique(files * (int(sym.max(initial=0)) + 1) + sym, return_inverse=True)  # every file its own symbols
        self.n_files, self.rules = n_files, np.zeros(n_files, np.int64)
        at, size, top = np.arange(n), np.ones(n, np.int64), int(sym.max(initial=0)) + 1
        key = _mixed(symbols.astype(np.uint64)) if keyed else np.zeros(n, np.uint64)
        power = np.full(n, _BASE, np.uint64)
        live = files[:-1] == files[1:] if n else np.zeros(0, bool)
        done: list[tuple[np.ndarray, ...]] = []
        while len(sym) > 1:
            pair = np.where(live, sym[:-1] * top + sym[1:], -1)
            _, inv = np.unique(pair, return_inverse=True)
            pick, alive = _picked(pair, inv, live)
            chosen = np.nonzero(pick)[0]
            if not len(chosen):
                break
            first = np.unique(inv[chosen], return_index=True)[1]
            self.rules += np.bincount(files[at[chosen[first]]], minlength=n_files)
            sym[chosen] = top + inv[chosen]
            size[chosen] += size[chosen + 1]
            if keyed:
                with np.errstate(over="ignore"):
                    key[chosen] = key[chosen] * power[chosen + 1] + key[chosen + 1]
                    power[chosen] *= power[chosen + 1]
            gone = np.zeros(len(sym), bool)
            gone[chosen + 1] = True
            joined = np.r_[alive, False]  # the pair to the right recurs
            joined[chosen] = joined[chosen + 1]
            stays = ~gone
            sym, size, key, power, at, joined = sym[stays], size[stays], key[stays], power[stays], at[stays], joined[stays]
            open_ = joined | np.r_[False, joined[:-1]]
            done.append((at[~open_], size[~open_], key[~open_], power[~open_]))
            sym, size, key, power, at, joined = sym[open_], size[open_], key[open_], power[open_], at[open_], joined[open_]
            live = joined[:-1]
            _, sym = np.unique(sym, return_inverse=True)
            top = int(sym.max(initial=0)) + 1
        parts = [np.concatenate(x) for x in zip(*done, (at, size, key, power))]
        order = np.argsort(parts[0])
        self.files = files[parts[0][order]]
        self.size, self.key, self.power = (x[order] for x in parts[1:])

    def symbols(self) -> np.ndarray:
        """Symbols of the whole grammar by file: the start rule and two for every other rule."""
        return np.bincount(self.files, minlength=self.n_files) + 2 * self.rules

    def covered(self, least: int) -> np.ndarray:
        """Tokens by file that lie in rules of at least ``least`` tokens."""
        return np.bincount(self.files, weights=np.where(self.size >= least, self.size, 0), minlength=self.n_files)

    def phrases(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(file, content key, tokens) of rules and phrases of ``least`` tokens or more.

        What no rule of the file covers is paired on by the content of the pair alone, so that the start
        rules of two files with equal text fall into equal phrases.
        """
        h, power, size, files = self.key, self.power, self.size, self.files
        while len(h) > 1:
            joins = (files[:-1] == files[1:]) & (size[:-1] < least) & (size[1:] < least)
            with np.errstate(over="ignore"):
                rank = np.where(joins, _mixed(h[:-1] ^ (h[1:] << np.uint64(1) | h[1:] >> np.uint64(63))) | np.uint64(1), np.uint64(0))
            left, right = np.r_[np.uint64(0), rank[:-1]], np.r_[rank[1:], np.uint64(0)]
            at = np.nonzero((rank > 0) & (rank > left) & (rank >= right))[0]
            if not len(at):
                break
            at = at[np.r_[True, np.diff(at) > 1]]
            h, size, power = h.copy(), size.copy(), power.copy()
            with np.errstate(over="ignore"):
                h[at] = h[at] * power[at + 1] + h[at + 1]
                power[at] *= power[at + 1]
            size[at] += size[at + 1]
            keep = np.ones(len(h), bool)
            keep[at + 1] = False
            h, size, power, files = h[keep], size[keep], power[keep], files[keep]
        big = size >= least
        return files[big], _mixed(h[big]), size[big]


def notices(path: str, text: str) -> tuple[bool, list[int]]:
    """(says it was generated, content keys of upstream names and notices of origin).

    Notices stand in the comments before the first code, however long these are; the upstream name is the
    folder below a folder of packages, without its version.
    """
    origin: set[str] = set()
    schema = digest = gen = False
    for m in _LINE.finditer(text):
        line = m.group()
        if not line.strip():
            continue
        if not _COMMENT.match(line):
            break
        gen |= bool(_BANNER.search(line))
        schema |= bool(_SCHEMA.match(line))
        digest |= bool(_DIGEST.match(line))
        origin.update(" ".join(_TOKEN.findall(x.lower())) for x in _UPSTREAM.findall(line))
    origin.update("folder " + _VERSION.sub("", x.lower()) for x in _PACKAGE_DIR.findall(path))
    return gen or schema and digest or bool(_LOCK.search(path)), sorted(xxhash.xxh64_intdigest(x) for x in origin)


def literals(text: str) -> tuple[list[str], list[int], int, int]:
    """(literal tokens, the characters each stands for, characters of the file, characters in digests).

    Unbroken strings are read in pieces of four characters; separators of a table belong to its literals.
    """
    tokens, sizes, digests = [], [], 0
    for m in _LITERAL.finditer(text):
        raw = m.group()
        if m.lastgroup == "long":
            pieces = [raw[i : i + 4] for i in range(0, len(raw), 4)]
            tokens += pieces
            sizes += map(len, pieces)
            digests += len(raw)
        else:
            tokens.append(raw)
            sizes.append(len(raw))
    separators = sum(map(text.count, ",[]{} \n"))
    return tokens, sizes, max(1, len(text) - min(separators, len(text) - 1)), digests


def dense(text: str) -> bool:
    """Hardly any layout: long lines and hardly a blank."""
    n = len(text)
    return n / (text.count("\n") + 1) > 160 and sum(map(text.count, " \t\n")) / n < 0.1


def judge(paths: list[str], texts: list[str], code: list[bool]) -> pd.DataFrame:
    """One row of features per file."""
    n = len(texts)
    known, flat, files, sizes = _coded([_TOKEN.findall(t) for t in texts])
    classes = Grammar(np.fromiter(map(_class, known), np.int64, len(known))[flat], files, n)
    exact = Grammar(np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))[flat], files, n, keyed=True)
    f, rule, size = exact.phrases(SHARED_TOKENS)
    order = np.argsort(f, kind="stable")
    rule, size, edges = rule[order], size[order], np.searchsorted(f[order], np.arange(n + 1))
    found = [literals(t) for t in texts]
    _, flat, files, count = _coded([x[0] for x in found])
    held = Grammar(flat, files, n)
    loose = held.symbols() > INCOMPRESSIBLE * count
    noted = [notices(p, t) for p, t in zip(paths, texts)]
    return pd.DataFrame(
        {
            "path": paths,
            "code": code,
            "tokens": sizes,
            "grammar": classes.symbols(),
            "reuse": classes.covered(RULE_TOKENS) / np.maximum(sizes, 1),
            "literals": [sum(x[1]) / x[2] if k else 0.0 for x, k in zip(found, loose)],
            "digests": [x[3] / x[2] if k else 0.0 for x, k in zip(found, loose)],
            "dense": [dense(t) for t in texts],
            "noted": [x[0] for x in noted],
            "origins": [np.array(x[1], np.uint64).view(np.int64) for x in noted],
            "rules": [rule[a:b].view(np.int64) for a, b in zip(edges, edges[1:])],
            "sizes": [size[a:b] for a, b in zip(edges, edges[1:])],
        }
    )


_FEATURES = "path string, code boolean, tokens bigint, grammar bigint, reuse double, literals double, digests double, dense boolean, noted boolean, origins array<bigint>, rules array<bigint>, sizes array<bigint>"


def features(df: DataFrame, path: str, text: str, code: Column) -> DataFrame:
    """What the grammars of every file say, one row per file with path and content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            paths, texts, flags, room = [], [], [], 0
            for p, t, c in zip(b["path"], b["text"], b["code"]):
                paths.append(p)
                texts.append(t)
                flags.append(bool(c))
                room += len(t) // 4
                if room > BATCH_TOKENS:
                    yield judge(paths, texts, flags)
                    paths, texts, flags, room = [], [], [], 0
            if paths:
                yield judge(paths, texts, flags)

    rows = df.select(F.col(path).alias("path"), F.col(text).alias("text"), F.coalesce(code, F.lit(False)).alias("code")).where("path is not null and text is not null and text <> ''")
    return rows.mapInPandas(run, _FEATURES)


def classify(df: DataFrame, path: str, text: str, code: Column, use_notices: bool = True) -> DataFrame:
    """(path, origin, by, reuse, grammar, literals, shared): origin is hand, generated, minified, vendored or data, ``by`` what decided.

    ``code`` tells program text from prose and settings, whose class grammars are small by nature.
    ``use_notices=False`` leaves out notices and folders, to measure what the bodies alone tell.
    """
    f = cut(features(df, path, text, code))
    repo = F.substring_index("path", "/", 1)
    own = F.arrays_zip(F.col("rules").alias("rule"), F.col("sizes").alias("size"))
    # upstream names and notices are phrases without length: they decide if they are shared at all
    named = F.transform("origins", lambda o: F.struct(o.alias("rule"), F.lit(None).cast("bigint").alias("size")))
    both = F.concat(own, named) if use_notices else own
    long = f.select("path", repo.alias("repo"), "tokens", F.explode(both).alias("z")).select("path", "repo", "tokens", "z.rule", "z.size")
    # one row per (rule, repository) leaves a map task, however often the rule occurs
    wide = long.groupBy("rule").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).where("a <> b").select("rule")
    shared = long.join(wide, "rule").groupBy("path").agg((F.coalesce(F.sum("size"), F.lit(0)) / F.max("tokens")).alias("shared"), F.count_if(F.col("size").isNull()).alias("upstream"))
    g = f.join(shared, "path", "left").withColumn("shared", F.coalesce("shared", F.lit(0.0))).withColumn("upstream", F.coalesce("upstream", F.lit(0)))
    enough = F.col("tokens") >= LEAST_TOKENS
    small = F.col("grammar") < GRAMMAR * F.pow("tokens", F.lit(POWER))
    noted = F.col("noted") & F.lit(use_notices)
    by = (
        F.when(enough & (F.col("shared") > SHARED), "shared rules")
        .when(F.col("upstream") > 0, "shared origin")
        .when(F.col("literals") > DATA, "literals")
        .when(F.col("code") & F.col("dense"), "layout")
        .when(enough & F.col("code") & small & (F.col("reuse") >= REUSE), "reuse")
        .when(enough & ~F.col("code") & (F.col("reuse") >= LOCK_REUSE) & (F.col("digests") >= DIGESTS), "reuse")
        .when(enough & noted & (F.col("reuse") >= NOTED_REUSE), "notice and reuse")
    )
    origins = {"shared rules": "vendored", "shared origin": "vendored", "literals": "data", "layout": "minified", "reuse": "generated", "notice and reuse": "generated"}
    origin = F.coalesce(F.create_map(*[F.lit(x) for kv in origins.items() for x in kv])[F.col("by")], F.lit("hand"))
    return g.withColumn("by", by).select("path", origin.alias("origin"), "by", F.round("reuse", 6).alias("reuse"), "grammar", F.round("literals", 6).alias("literals"), F.round("shared", 6).alias("shared"))
