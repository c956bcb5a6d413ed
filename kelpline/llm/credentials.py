"""Credentials in source text: found by one deterministic automaton, masked without breaking the code.

The anchors of all token formats, key armor, connection strings and credential names form one
deterministic automaton (a 256-column transition table over case-folded characters). A batch of texts
is one buffer cut into overlapping chunks that advance through the table in lockstep; hits have
absolute positions and are deduplicated. Behind a hit the body of its format is read in steps of
literals and counted classes (``BODIES``), counters beside the state, to whatever length it has; key
armor and assignments to credential names have grammars of their own. A judgement by value drops
placeholders, masked values, references, patterns, checksums, paths and public material. Literals split by ``+`` are read joined. Masking splices
``REDACTED`` placeholders over the secret characters alone; quotes and separators stay.

Defined results: null and empty texts hold nothing; whole texts are scanned whatever their length;
copies of a row give the same result; overlapping finds count once, the longest first.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 2_048
#: Anchors by the grammar they open; compared without case.
ANCHORS = {
    "aws": ["akia", "asia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "gitlab": ["glpat-"],
    "slack": ["xoxb-", "xoxp-", "xoxa-", "xoxs-", "xoxr-"],
    "google": ["aiza"],
    "stripe": ["sk_live_", "sk_test_", "rk_live_", "rk_test_"],
    "npm": ["npm_"],
    "pypi": ["pypi-"],
    "sk": ["sk-"],
    "jwt": ["eyj"],
    "armor": ["private key-----"],
    "url": ["://"],
    "bearer": ["bearer "],
    "basic": ["basic "],
    "login": [" -u", " --user"],
    "flag": [" -p"],
    "name": ["pass", "pwd", "pw", "secret", "token", "key", "auth", "credential"],
}
#: Bodies of the formats: what follows the anchor, in steps. A step is a literal, or a class of characters with
#: the least and the greatest number of them; the number is a counter beside the state of the automaton, so
#: that counted bodies add no states. `^` starts a new secret before the anchor, `<` where the secret begins
#: otherwise, `>` where it ends, `!` a class that may not follow.
_ALNUM, _WORD = "A-Za-z0-9", r"A-Za-z0-9_-"
BODIES = {
    "aws": [("^",), ("A-Z0-9", 16, 16), (">",), ("!", _ALNUM)],
    "github": [("^",), (_ALNUM, 36, None), (">",), ("!", _ALNUM)],
    "gitlab": [("^",), (_WORD, 20, None), (">",)],
    "slack": [("^",), ("0-9", 6, None), "-", ("0-9", 6, None), "-", ("A-Za-z0-9-", 16, None), (">",)],
    "google": [("^",), (_WORD, 35, 35), (">",), ("!", _WORD)],
    "stripe": [("^",), (_ALNUM, 16, None), (">",)],
    "npm": [("^",), (_ALNUM, 36, 36), (">",), ("!", _ALNUM)],
    "pypi": [("^",), (_WORD, 50, None), (">",), ("!", _ALNUM)],
    "sk": [("^",), (_WORD, 32, None), (">",), ("!", _ALNUM)],
    "jwt": [("^",), (_WORD, 8, None), ".", (_WORD, 8, None), ".", (_WORD, 8, None), (">",)],
    "url": [(r"^\s:/@\"'`<>", 0, None), ":", ("<",), (r"^\s@/\"'`", 1, None), (">",), "@", (r"A-Za-z0-9\[$({", 1, 1)],
    "bearer": [("<",), ("A-Za-z0-9._~+/=-", 20, None), (">",)],
    "basic": [("<",), ("A-Za-z0-9+/_-", 8, None), ("=", 0, 2), (">",)],
    "login": [("\"' =", 0, 2), ("A-Za-z0-9._-", 1, None), ":", ("<",), (r"^\s\"'`@:", 6, None), (">",)],
    "flag": [("<",), (r"^\s\"'`;|&<>", 8, None), (">",)],
}
_RUNS: dict[str, re.Pattern] = {}


def body_span(kind: str, text: str, start: int, at: int) -> tuple[int, int] | None:
    """The span of the secret whose anchor stands at ``start`` and ends before ``at``; None where its body does not hold."""
    lo = hi = None
    for step in BODIES[kind]:
        if isinstance(step, str):
            if not text.startswith(step, at):
                return None
            at += len(step)
        elif step[0] == "^" and len(step) == 1:
            lo = start
            if start and text[start - 1].isascii() and text[start - 1].isalnum():
                return None
        elif step == ("<",):
            lo = at
        elif step == (">",):
            hi = at
        elif step[0] == "!":
            if _run(step[1]).match(text, at).end() > at:
                return None
        else:
            chars, least, most = step
            end = _run(chars).match(text, at).end()
            end = end if most is None else min(end, at + most)
            if end - at < least:
                return None
            at = end
    return lo, hi


def _run(chars: str) -> re.Pattern:
    known = _RUNS.get(chars)
    if known is None:
        known = _RUNS[chars] = re.compile(f"[{chars}]*+")
    return known


_ARMOR = re.compile(r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----((?:\\[nr]|[A-Za-z0-9+/=\s]|[\"'+,]|[A-Z][A-Za-z-]+: [^\n]*)+?)(?:-----END|$)")
_ASSIGN = re.compile(
    r"(?P<name>--[A-Za-z][\w-]*(?=[ =])|[A-Za-z_][\w.-]*|(?<=/ )[a-z]+)[\"'`]?\)?(?:\s*:\s*&?(?:'static\s+)?[sS]tr(?:ing)?\b)?(?:\[\d*\])?"
    r"(?:\s*(?:=>|:=|\|\||\?\?|[:=]|,(?=\s*(?:\.\w+\s*=\s*)?[\"'`]))\s*(?:\.\w+\s*=\s*)?|\s+is\s+(?=\S*\d)|(?<=\w)\s+(?=(?P<cli>[\"'`]|\S*\d)))"
    r"(?:(?P<q>[\"'`])(?P<quoted>(?:(?!(?P=q))[^\n\\])*)(?P=q)|(?P<plain>[^\s\"'`,;&<>(){}\[\]]+)(?=[\s\"'`,;&)}\]]|$))"
)
_SCHEME = re.compile(r"[A-Za-z0-9+.-]")
#: Ends of a line whose value a formatter may have put on a later line, and that literal.
_OPEN_END = ("=>", "||", "??", "=", ":", ",")
_NEXT_QUOTED = re.compile(r"\s*([\"'`])(?:(?!\1)[^\n\\])*\1")
_QUERY = re.compile(r"[?&]([A-Za-z_][\w.-]*)=([^&\s\"'`<>#]+)")
_SPLIT = re.compile(r"([\"'`])\s*\+\s*\1")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_CRED = frozenset("pass pw password passwd passphrase pwd secret token apikey authkey credential credentials accesskey accountkey".split())
_KEY_OF = frozenset("api access secret auth private client account encryption signing hmac master deploy".split())
_OPEN_KEYS = frozenset("public verify primary foreign sort partition cache idempotency row group unique routing cipher host known map object json".split())
_NOT_A_VALUE = frozenset("path ref label hint help pattern regex name file id url uri type len length count hash digest checksum sum field header policy ttl expiry prompt title text placeholder doc docs index kind size limit env var version format rotation provider store manager vault role arn public".split())
_PLACEHOLDER = re.compile(r"(?i)x{4,}|\*{3,}|\.{3}|your|insert|example|change.?me|placeholder|replace|dummy|redacted|todo|fixme|\$\{|\$\(|\{\{|%\(|#\{|<|>|^\$|^%|^env[:.]|^vault[:.]|process\.env|getenv|environ|^(?:password|passwd|pass|secret|token|none|null|true|false|test|foobar)\d{0,3}$")
_PATTERN = re.compile(r"\[[^\]]*-[^\]]*\]|\([^)]*\||\(\?|\{\d|\.[*+]|\[\^|\\[dwsbDWSB]|[{}\\]")
_PATH = re.compile(r"^[./~]?[a-z0-9_.-]+(?:/[a-z0-9_.-]+)+$")
_CODE_NAME = re.compile(r"^[a-z_]+\d{0,3}$|^[A-Z_]+\d{0,3}$|^[a-z]+(?:[A-Z][a-z]+)*\d{0,3}$|^[a-z]+(?:\.\w+)+$")
_UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)


#: Anchors whose case matters, as they are written.
_CASED = {"aws": ("AKIA", "ASIA"), "google": ("AIza",), "jwt": ("eyJ",), **{k: tuple(ANCHORS[k]) for k in ("github", "gitlab", "slack", "stripe", "npm", "pypi", "sk")}}


def build_automaton() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(table of 256 columns a state, bit set of grammars a state accepts, grammar names)."""
    kinds = list(ANCHORS)
    nxt: list[dict[int, int]] = [{}]
    out = [0]
    for bit, kind in enumerate(kinds):
        for word in ANCHORS[kind]:
            s = 0
            for c in word.encode():
                if c not in nxt[s]:
                    nxt[s][c] = len(nxt)
                    nxt.append({})
                    out.append(0)
                s = nxt[s][c]
            out[s] |= 1 << bit
    table = np.zeros((len(nxt), 256), np.int32)
    fail, queue = [0] * len(nxt), []
    for c, s in nxt[0].items():
        table[0, c] = s
        queue.append(s)
    for s in queue:
        out[s] |= out[fail[s]]
        table[s] = table[fail[s]]
        for c, t in nxt[s].items():
            fail[t] = table[fail[s], c]
            table[s, c] = t
            queue.append(t)
    for c in range(ord("A"), ord("Z") + 1):
        table[:, c] = table[:, c + 32]
    return table, np.asarray(out, np.int32), kinds


_TABLE, _OUT, _KINDS = build_automaton()
_OVERLAP = max(len(w) for ws in ANCHORS.values() for w in ws) - 1


def anchor_hits(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(absolute end positions, grammar bits) of all anchors; ``buffer`` holds one byte per character."""
    n = len(buffer)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    rows = -(-n // CHUNK)
    padded = np.zeros(rows * CHUNK + _OVERLAP, np.uint8)
    padded[_OVERLAP : _OVERLAP + n] = buffer
    view = np.lib.stride_tricks.as_strided(padded, (rows, CHUNK + _OVERLAP), (CHUNK, 1))
    columns = np.ascontiguousarray(view.T)
    flat, state = _TABLE.ravel(), np.zeros(rows, np.int32)
    found_at, found = [], []
    starts = np.arange(rows, dtype=np.int64) * CHUNK - _OVERLAP
    accepts = _OUT > 0
    for i in range(CHUNK + _OVERLAP):
        state = flat[state * 256 + columns[i]]
        hit = np.nonzero(accepts[state])[0]
        if len(hit):
            found_at.append(starts[hit] + i)
            found.append(_OUT[state[hit]])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    at, bits = np.concatenate(found_at), np.concatenate(found)
    at, first = np.unique(at, return_index=True)  # overlaps see a hit twice
    return at, bits[first]


def plausible(value: str) -> bool:
    """A literal that could be used as it stands."""
    if len(value) < 8 or len(set(value)) < 4 or any(c.isspace() for c in value):
        return False
    if _PLACEHOLDER.search(value) or _PATTERN.search(value) or _PATH.match(value) or _UUID.match(value) or "://" in value:
        return False
    digit, upper, lower = any(c.isdigit() for c in value), any(c.isupper() for c in value), any(c.islower() for c in value)
    marked = len(value) >= 10 and any(c in "!@#$%^&*?~" for c in value)
    return digit and (upper or lower) or upper and lower and (marked or len(value) >= 20) or digit and len(value) >= 12


def _dense(value: str) -> bool:
    return len(value) >= 20 and any(map(str.isdigit, value)) and any(map(str.isupper, value)) and any(map(str.islower, value))


def names_a_credential(name: str, value: str = "") -> bool:
    """By the words of the name; a name that only ends in key or auth needs a dense random value."""
    words = [w.lower() for w in _WORDS.findall(name)]
    words = [w for w in words if not w.isdigit()]
    if not words or words[-1] in _NOT_A_VALUE:
        return False
    if words[-1] in ("key", "auth") and not _OPEN_KEYS & set(words) and _dense(value):
        return True
    return any(w in _CRED for w in words) or any(a in _KEY_OF and b == "key" for a, b in zip(words, words[1:])) or any(w.endswith(("password", "secret", "apikey")) for w in words)


def _basic_login(value: str) -> bool:
    try:
        plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return False
    user, colon, password = plain.partition(":")
    return bool(colon and user and len(password) >= 4 and password.isprintable()) and not _PLACEHOLDER.search(password)


def _spans_of(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of secrets; ``hits``: (end position of an anchor, grammar bits)."""
    spans: set[tuple[int, int, str]] = set()
    lines: set[tuple[int, int]] = set()
    past: dict[str, int] = {}  # end of the last secret of a grammar: what starts inside it is shorter
    for end, bits in hits:
        for bit, kind in enumerate(_KINDS):
            if not bits >> bit & 1:
                continue
            if kind == "name":
                lo, hi = text.rfind("\n", 0, end) + 1, text.find("\n", end)
                lines.add((lo, len(text) if hi < 0 else hi))
            elif kind == "armor":
                lo = text.rfind("-----BEGIN ", max(0, end - 80), end + 1)
                m = _ARMOR.match(text, lo) if lo >= 0 else None
                if m:
                    body = re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", m.group(2))
                    if len(body) >= 40 and len(set(body)) >= 8:
                        spans.add((*m.span(2), kind))
            elif kind == "url":
                lo = end - 2
                while lo > 0 and _SCHEME.match(text[lo - 1]):
                    lo -= 1
                span = body_span("url", text, lo, end + 1) if any(map(str.isalpha, text[lo : end - 2])) else None
                v = text[slice(*span)] if span else ""
                if len(v) >= 4 and not _PLACEHOLDER.search(v) and not _PATTERN.search(v) and not v.startswith("$"):
                    spans.add((*span, kind))
            else:
                for size in {len(w) for w in ANCHORS[kind]}:
                    start = end + 1 - size
                    exact = text[start : end + 1]
                    if start < past.get(kind, 0) or exact.lower() not in ANCHORS[kind] or not (span := body_span(kind, text, start, end + 1)):
                        continue
                    v = text[slice(*span)]
                    if kind == "basic":
                        ok = _basic_login(v)
                    elif kind in ("login", "flag"):
                        ok = plausible(v) and not _CODE_NAME.match(v)
                    else:
                        ok = not _PLACEHOLDER.search(v) and len(set(v)) >= 6 and (kind != "bearer" or any(c.isdigit() for c in v)) and (kind not in _CASED or exact in _CASED[kind])
                    if ok:
                        spans.add((*span, kind))
                        past[kind] = span[1]
    for lo, hi in lines:
        for m in _QUERY.finditer(text, lo, hi):
            if names_a_credential(m.group(1), m.group(2)) and plausible(m.group(2)):
                spans.add((*m.span(2), "assigned"))
        pos, reach = lo, hi
        if text[lo:hi].rstrip().endswith(_OPEN_END) and (m := _NEXT_QUOTED.match(text, hi)):
            reach = m.end()
        while (m := _ASSIGN.search(text, pos, reach)) and m.start() < hi:
            name = m.group("name")
            pos = m.end("name")
            which = "quoted" if m.group("quoted") is not None else "plain"
            v = m.group(which)
            if m.group("cli") is not None and not name.startswith("--") or not names_a_credential(name, v):
                continue
            if plausible(v) and (which == "quoted" or not _CODE_NAME.match(v)):
                spans.add((*m.span(which), "assigned"))
                pos = m.end()
    kept: list[tuple[int, int, str]] = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s)):
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return sorted(kept)


def _bytes(text: str) -> bytes:
    return text.encode("latin-1", "replace")


def find_all(texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """Secret spans of every text; a span of a split literal comes in its pieces."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    views: list[tuple[int, str, list[tuple[int, int]] | None]] = []
    for k, t in enumerate(texts):
        if not t:
            continue
        views.append((k, t, None))
        cuts = [m.span() for m in _SPLIT.finditer(t)] if "+" in t else []
        if cuts:
            joined, pos = [], 0
            for lo, hi in cuts:
                joined.append(t[pos:lo])
                pos = hi
            views.append((k, "".join([*joined, t[pos:]]), cuts))
    if not views:
        return out
    offsets = np.cumsum([0, *(len(v[1]) + 1 for v in views)])
    at, bits = anchor_hits(np.frombuffer(b"\n".join([*(_bytes(v[1]) for v in views), b""]), np.uint8))
    owner = np.searchsorted(offsets, at, side="right") - 1
    edges = np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0] if len(owner) else []
    for a, b in zip(edges, [*edges[1:], len(owner)]):
        v = int(owner[a])
        k, text, cuts = views[v]
        spans = _spans_of(text, [(int(x - offsets[v]), int(y)) for x, y in zip(at[a:b], bits[a:b])])
        if cuts is None:
            out[k] += spans
            continue
        for lo, hi, kind in spans:  # back to the pieces of the text itself
            gone, start = 0, lo
            for c_lo, c_hi in cuts:
                seam = c_lo - gone
                if seam <= lo:
                    gone += c_hi - c_lo
                    continue
                if seam >= hi:
                    break
                out[k].append((start + gone, c_lo, kind))
                gone, start = gone + c_hi - c_lo, seam
            out[k].append((start + gone, hi + gone, kind))
    for k, spans in enumerate(out):
        merged: list[tuple[int, int, str]] = []
        for s in sorted(set(spans), key=lambda s: (s[0] - s[1], s)):
            if all(s[1] <= m[0] or s[0] >= m[1] for m in merged):
                merged.append(s)
        out[k] = sorted(merged)
    return out


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, pos = [], 0
    for lo, hi, kind in spans:
        parts += [text[pos:lo], f"REDACTED_{kind.upper()}"]
        pos = hi
    return "".join([*parts, text[pos:]])


def scan(df: DataFrame, id_col: str, text_col: str, masked: bool = False) -> DataFrame:
    """(row_id, n_found, kinds by comma[, masked]) for rows that hold credentials; with ``masked`` for all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            for lo in range(0, len(texts), 2_000):
                part, ids = texts[lo : lo + 2_000], b["row_id"].iloc[lo : lo + 2_000].reset_index(drop=True)
                found = find_all(part)
                keep = [k for k, f in enumerate(found) if masked or f]
                if not keep:
                    continue
                text = lambda values: pd.Series(values, dtype=object)
                rows = pd.DataFrame({"row_id": ids.iloc[keep].array, "n_found": [len(found[k]) for k in keep], "kinds": text([",".join(sorted({s[2] for s in found[k]})) for k in keep])})
                if masked:
                    rows["masked"] = text([None if part[k] is None else mask(part[k], found[k]) for k in keep])
                yield rows

    schema = "row_id bigint, n_found int, kinds string" + (", masked string" if masked else "")
    return df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)
