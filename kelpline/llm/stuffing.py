"""Keyword-stuffed and link-list pages: coverage by repeated maximal substrings combined with missing clause structure.

A page's words, numerals (as one symbol), link marks and punctuation are the letters of its suffix
structure. A letter is covered if it lies in a substring that occurs at least twice and has at least
``LEAST`` letters. The suffix structure is a suffix array with common prefixes, built for a batch of pages
at once: its intervals are the states of the suffix automaton of the reversed page, and the longest
repeated substring at a letter is the same (``repeated_lengths`` is the automaton; tests compare them).

Clauses are told by shape alone, in any language: four words or more that close with a mark of a sentence.
Technical units (code, logs, traces, tables, fences) are told by their syntax. What is neither counts as
stuffing where it is covered, and as a whole where ``BARE_COVERED`` of it is. Clauses count as stuffing if
they are covered and one word or pair of words recurs more often than once a clause and fills
``PHRASE_SHARE`` of their characters. A page is marked if stuffing makes up more than half of its
characters; an address weighs as much as one short word. Nothing is marked without coverage.

Defined results: null, empty and very short pages are not marked; copies are judged alike; pages are always
judged whole, by the same steps at every length; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 2
#: Text without clauses of which at least this share repeats is stuffing as a whole.
BARE_COVERED = 0.35
#: A word or pair stuffs clauses if it comes so often a clause, fills this share of them, and this share of them repeats.
PHRASE_A_CLAUSE, PHRASE_SHARE, CLAUSES_COVERED = 1.8, 0.3, 0.7
LEAST_PHRASES = 4
LEAST_LETTERS = 12
CLAUSE_WORDS = 4
BATCH_CHARS = 2_000_000
_UPPER, _LOWER = "A-ZÄÖÜÉÁÍÓÚÑ", "a-zäöüßéáíóúñ"
#: Blanks and one letter; CamelCase tags are read word by word.
_LETTER = re.compile(rf"(\s*+)(https?://|[{_UPPER}]?[{_LOWER}]++(?:(?=[{_UPPER}])|(?![^\W\d_]))|[^\W\d_]+?(?<=[{_LOWER}])(?=[{_UPPER}])|[^\W\d_]+|\d+|[^\w\s]|_)")
#: A link address weighs as much as this many characters of text, however long it is.
LINK_WEIGHT = 5.0
_TECH = re.compile(
    r"^\s*(?:\d{4}-\d\d-\d\d[T ]\d\d:|\[?\d\d:\d\d:\d\d|\d+:\s+\w+::|at\s+\S+\s*[:(](?:\d|\S+:\d)|File \"|Traceback|thread |panic|\||>|#!|//|/\*|\*/|--\s)"
    r"|::|[{};]\s*$|^\s*[\w.\[\]\"'&*]+(?:,\s*\w+)?\s*(?::=|[-+*/]?=)\s|\w\([^)\n]*\)\s*[:;{,]?\s*$|=>|->|^\s*(?:def|fn|func|class|import|return|if|for|while|let|const|var|pub|use|end|else|try|catch)\b.*[:;{()]\s*$|\bat \S+\.\w+:\d+"
)
_LINK = re.compile(r"https?://|www\.|<a\s|\]\(")
_ADDRESS = re.compile(r"https?://[^\s<>\"')\]]+")
_MARKUP = re.compile(r"`[^`\n]*`|https?://\S+|<[^>\n]*>|\]\([^)\n]*\)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[\"'`*_(\[]*[A-ZÄÖÜÉÁÍÓÚ¿¡0-9])")
#: The mark that closes a sentence, with quotes, brackets and a reference behind it.
_CLOSED = re.compile(r"[.!?…:;。！？][\"'`)\]*_”»]*(?:\s*[(\[][^()\[\]]*[)\]])?\s*$")
_WORD = re.compile(r"[^\W\d_]+")


def suffix_levels(letters: np.ndarray) -> list[np.ndarray]:
    """Ranks of the substrings of 1, 2, 4, ... letters from every position, until every suffix has its own rank."""
    n = len(letters)
    order = np.argsort(letters, kind="stable")
    first = np.r_[True, np.diff(letters[order]) != 0] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, step = [rank], 1
    shared = np.nonzero(np.bincount(rank, minlength=n)[rank] > 1)[0] if n else order
    while len(shared):
        behind = shared + step
        key = rank[shared] * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        key, old, at = key[order], rank[shared][order], np.arange(len(order))
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        part = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
        rank = rank.copy()
        rank[shared[order]] = old + part - group
        levels.append(rank)
        step *= 2
        shared = np.sort(shared[order][np.bincount(part, minlength=len(order))[part] > 1])
    return levels


def longest_repeats(levels: list[np.ndarray]) -> np.ndarray:
    """For each position the length of the longest substring from there that occurs elsewhere too."""
    n = len(levels[-1])
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    a, b = order[:-1], order[1:]
    near = np.nonzero(levels[0][a] == levels[0][b])[0]
    a, b = a[near], b[near]
    x, y, common = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank, size = levels[k], 1 << k
        same = rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]
        same &= (x + size <= n) & (y + size <= n)
        common[same] += size
        x[same] += size
        y[same] += size
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def covered(longest: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The letters that lie in a repeated substring of at least ``least`` letters."""
    n = len(longest)
    mark = np.zeros(n + 1, np.int64)
    at = np.nonzero(longest >= least)[0]
    np.add.at(mark, at, 1)
    np.add.at(mark, at + longest[at], -1)
    return np.cumsum(mark)[:n] > 0


def repeated_lengths(letters: list[int]) -> list[int]:
    """For each prefix the length of its longest suffix that occurs elsewhere too, by suffix automaton."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    ends, last = [], 0
    for c in letters:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        ends.append(cur)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    recurs = set(link)  # a prefix that is the link of another state occurs again as a whole
    return [length[e] if e in recurs else length[link[e]] for e in ends]


BARE, LINK, TECHNICAL, CLAUSE = range(4)


def _kind(unit: str) -> int:
    plain = _MARKUP.sub(" ", unit)
    if _CLOSED.search(plain.rstrip()) and len(_WORD.findall(plain)) >= CLAUSE_WORDS:
        return CLAUSE
    if _LINK.search(unit):
        return LINK
    return TECHNICAL if _TECH.search(unit) else BARE


def units(text: str) -> Iterator[tuple[int, int]]:
    """(end, kind) of the units of a page in order: sentences of long lines, other lines whole."""
    fence, pos = False, 0
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fence = not fence
            yield pos + len(line), TECHNICAL
        elif fence:
            yield pos + len(line), TECHNICAL
        elif len(line) < 40:
            yield pos + len(line), _kind(line)
        else:
            start = 0
            for m in _SENTENCE.finditer(line):
                yield pos + m.start(), _kind(line[start : m.start()])
                start = m.end()
            yield pos + len(line), _kind(line[start:])
        pos += len(line) + 1


def read_letters(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(letters, starts, ends)."""
    found = _LETTER.findall(text)
    names = list(map(itemgetter(1), found))
    gaps = np.fromiter(map(len, map(itemgetter(0), found)), np.int64, len(found))
    sizes = np.fromiter(map(len, names), np.int64, len(found))
    ends = np.cumsum(gaps + sizes)
    return names, ends - sizes, ends


def _phrase(rank: np.ndarray, pick: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """(characters, occurrences) of the substring that fills most of the picked positions."""
    if not pick.any():
        return 0.0, 0
    _, inv, count = np.unique(rank[pick], return_inverse=True, return_counts=True)
    chars = np.bincount(inv, weights=weight[pick])
    best = int(np.argmax(chars))
    return float(chars[best]), int(count[best])


def judge_all(texts: list[str | None]) -> list[tuple[float, float, float]]:
    """(coverage of the page by repeats, share of clauses, share of stuffing) in characters, page by page."""
    pages = []
    for k, text in enumerate(texts):
        names, starts, ends = read_letters(text or "")
        if len(names) >= LEAST_LETTERS:
            pages.append((k, text, names, starts, ends))
    out = [(0.0, 0.0, 0.0)] * len(texts)
    if not pages:
        return out
    numbers = {x: i for i, x in enumerate(dict.fromkeys(chain.from_iterable(names for _, _, names, _, _ in pages)))}
    flat = [np.fromiter(map(numbers.__getitem__, names), np.int64, len(names)) for _, _, names, _, _ in pages]
    # case does not count, and every numeral is the same letter
    same: dict[str, int] = {}
    folded = np.fromiter((same.setdefault("#" if x[0].isdigit() else x.lower(), len(same)) for x in numbers), np.int64, len(numbers))
    alpha = np.fromiter((x[0].isalpha() for x in numbers), bool, len(numbers))
    # every page its own letters, and one more behind it that no other page has
    base = len(same) + 1
    sequence = np.empty(sum(len(x) + 1 for x in flat), np.int64)
    pos = 0
    for i, x in enumerate(flat):
        np.add(folded[x], i * base, out=sequence[pos : pos + len(x)])
        pos += len(x) + 1
        sequence[pos - 1] = i * base + base - 1
    levels = suffix_levels(sequence)
    cover = covered(longest_repeats(levels))
    words, pairs = levels[0], levels[1] if len(levels) > 1 else np.arange(len(sequence))
    pos = 0
    for (k, text, _, starts, ends), letters in zip(pages, flat):
        here = slice(pos, pos + len(starts))
        pos += len(starts) + 1
        out[k] = _judge(text, alpha[letters], starts, ends, cover[here], words[here], pairs[here])
    return out


def _judge(text: str, alpha: np.ndarray, starts: np.ndarray, ends: np.ndarray, cover: np.ndarray, words: np.ndarray, pairs: np.ndarray) -> tuple[float, float, float]:
    n, size = len(starts), (ends - starts).astype(float)
    addresses = np.array([m.span() for m in _ADDRESS.finditer(text)], np.int64).reshape(-1, 2)
    for lo, hi in np.searchsorted(starts, addresses).tolist():
        if hi > lo:
            size[lo:hi] *= min(1.0, LINK_WEIGHT / size[lo:hi].sum())
    found = list(units(text))
    upto = np.searchsorted(starts, np.fromiter((e for e, _ in found), np.int64, len(found)))
    kind = np.full(n, BARE)
    many = upto.copy()
    many[1:] -= upto[:-1]
    kind[: upto[-1]] = np.repeat(np.fromiter((k for _, k in found), np.int64, len(found)), many)
    chars = float(size.sum())
    share = lambda pick: float(size[pick].sum())
    clause = share(kind == CLAUSE)
    stuffed = share((kind == LINK) & cover)
    bare, bare_covered = share(kind == BARE), share((kind == BARE) & cover)
    stuffed += bare if bare_covered >= BARE_COVERED * bare else bare_covered
    if clause and share((kind == CLAUSE) & cover) >= CLAUSES_COVERED * clause:
        clauses = len(np.unique(np.searchsorted(starts, [e for e, k in found if k == CLAUSE])))
        alpha = alpha & (kind == CLAUSE)
        both = alpha & np.r_[alpha[1:], False]
        filled, times = max(_phrase(words, alpha, size), _phrase(pairs, both, size + np.r_[size[1:], 0.0]))
        if times >= max(LEAST_PHRASES, PHRASE_A_CLAUSE * clauses) and filled >= PHRASE_SHARE * clause:
            stuffed += clause
            clause = 0.0
    return share(cover) / chars, clause / chars, stuffed / chars


def judge(text: str | None) -> tuple[float, float, float]:
    return judge_all([text])[0]


def judge_pages(df: DataFrame, id_col: str, text_col: str, limit: float = 0.5) -> DataFrame:
    """(item_id, coverage, clauses, stuffed, marked) for every row with an id."""

    def rows(ids: list[int], texts: list[str | None]) -> pd.DataFrame:
        got = judge_all(texts)
        return pd.DataFrame({"item_id": ids, "coverage": [g[0] for g in got], "clauses": [g[1] for g in got], "stuffed": [g[2] for g in got], "marked": [g[2] > limit for g in got]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts, room = [], [], 0
            for i, t in zip(b["item_id"].tolist(), b["text"]):
                ids.append(i)
                texts.append(t if isinstance(t, str) else None)
                room += len(texts[-1] or "")
                if room > BATCH_CHARS:
                    yield rows(ids, texts)
                    ids, texts, room = [], [], 0
            if ids:
                yield rows(ids, texts)

    picked = df.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null")
    return picked.mapInPandas(run, "item_id bigint, coverage double, clauses double, stuffed double, marked boolean")
