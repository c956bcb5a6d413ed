"""Grammars against slow versions, and origins of small files."""

import random

import numpy as np
from pyspark.sql import functions as F

from kelpline.llm import provenance as pv

SCHEMA = "path string, text string, origin string"


def hand(seed, n=40):
    r = random.Random(seed)
    names = ["cache", "index", "row", "edge", "token", "path", "node"]
    lines = ["import re", ""]
    for k in range(n):
        a, b, c = r.sample(names, 3)
        lines += [r.choice([f"def {a}_{b}{seed}({c}):", f"class {a.title()}{b.title()}{seed}:\n    {c} = None\n    def go(self, {b}):"])]
        for _ in range(r.randrange(1, 5)):
            a, b, c = r.sample(names, 3)
            lines.append(r.choice([f"        {a} = {b}.{c}({r.randrange(99)})", f"        if {a} is None or len({b}) > {r.randrange(99)}:\n            return {c}", f"        {a}, {b} = {b}, {a}", f"        # the {a} may hold the {b}", f'        log.warn("{a} {b}", {c})', f"        while {a}[{r.randrange(9)}:]:\n            {b} += 1"]))
    return "\n".join(lines) + "\n"


def grammar(sym, files=None, n=1, **kw):
    return pv.Grammar(np.asarray(sym), np.zeros(len(sym), int) if files is None else files, n, **kw)


def exact_re_pair(seq):
    """One most frequent pair after the other: (symbols in the start rule, rules)."""
    s, rules, top = list(seq), 0, max(seq, default=0) + 1
    while True:
        count = {}
        last = None
        for p in zip(s, s[1:]):
            if p != last or p[0] != p[1]:
                count[p] = count.get(p, 0) + 1
                last = p
            else:
                last = None
        best = max(count, key=lambda p: (count[p], p), default=None)
        if best is None or count[best] < 2:
            return len(s), rules
        out, k = [], 0
        while k < len(s):
            if tuple(s[k : k + 2]) == best:
                out.append(top)
                k += 2
            else:
                out.append(s[k])
                k += 1
        s, rules, top = out, rules + 1, top + 1


def test_re_pair_compresses_each_file_alone():
    r = np.random.default_rng(0)
    a, b, c = np.tile([5, 6, 7, 8], 40), r.integers(0, 50, 160), np.full(64, 3)
    sym, files = np.concatenate([a, b, c]), np.repeat([0, 1, 2], [160, 160, 64])
    size = grammar(sym, files, 4).symbols()
    assert [int(grammar(x).symbols()[0]) for x in (a, b, c)] == size[:3].tolist()
    assert size[0] < 30 and size[2] < 20 and size[1] > 130 and size[3] == 0


def test_re_pair_is_about_as_small_as_one_pair_at_a_time():
    r = random.Random(4)
    for n in (0, 1, 2, 3, 30, 300, 900):
        seq = [r.choice([1, 2, 3, 4, 5, 6]) for _ in range(n)]
        seq += seq[: n // 2]
        left, rules = exact_re_pair(seq)
        assert int(grammar(seq).symbols()[0]) <= 1.15 * (left + 2 * rules) + 3
        assert int(grammar(seq).size.sum()) == len(seq)


def test_phrases_follow_content():
    r = np.random.default_rng(1)
    draw = lambda n: r.integers(0, 2**63, n).astype(np.uint64)
    body = draw(900)
    one, two, other = np.r_[draw(30), body], np.r_[draw(77), body], draw(400)
    f, rule, size = pv.Grammar(np.concatenate([one, two, other]), np.repeat([0, 1, 2], [930, 977, 400]), 3, keyed=True).phrases(pv.SHARED_TOKENS)
    common = set(rule[f == 0]) & set(rule[f == 1])
    assert sum(s for x, s, k in zip(rule, size, f) if k == 0 and x in common) > 600
    assert not set(rule[f == 2]) & set(rule[f < 2])


def test_origins(spark):
    gen = "".join(f"pub const FIELD_{k}: u32 = {k};\npub fn field_{k}(p: *mut u8) -> u32 {{\n    unsafe {{ ffi_field_{k}(p) }}\n}}\n" for k in range(40))
    copied = hand(77)
    r = random.Random(3)
    digest = lambda: "".join(r.choice("abcdefABCDEF0123456789") for _ in range(86))
    lock = "{" + ", ".join(f'"p{k}": {{"version": "1.{k}.0", "integrity": "sha512-{digest()}==", "resolved": "https://r.example/p{k}"}}' for k in range(9)) + "}"
    licence = "".join(f"# licence line {k} of a long notice that says what may be done\n" for k in range(90))
    rows = [
        ("a/src/x.py", hand(1)), ("a/vendor_portal/y.py", "# generated files are skipped here\n" + hand(2)), ("a/codegen_tool/z.py", hand(3)),
        ("a/src/gen.rs", gen), ("a/src/notice.py", "# Code generated by x. DO NOT EDIT.\n" + hand(4)),
        ("a/vendor/lib-1.2.0/c.py", hand(5)), ("b/third_party/lib/c2.py", hand(15)), ("a/vendor/ours/c3.py", hand(16)),
        ("a/src/d.py", "# Vendored from https://x.example at 1234\n" + hand(6)), ("b/src/d2.py", licence + "# Vendored from https://y.example\n" + hand(17)),
        ("a/src/e.py", copied), ("b/lib/f.py", "import os\n" + copied), ("c/lib/g.py", hand(18)),
        ("a/app.js", "!function(){" + ";".join(f"a.b{k}=function(c){{return c+{k}}}" for k in range(90)) + "}();"),
        ("a/data.py", "T = [\n" + ",\n".join(", ".join(str(r.randrange(10**5)) for _ in range(8)) for _ in range(40)) + "\n]\n"),
        ("a/zeros.py", "T = [\n" + ",\n".join(", ".join("0" for _ in range(8)) for _ in range(40)) + "\n]\n"),
        ("a/blob.py", 'B = "' + digest() * 1 + digest() + digest() + '"\n'), ("a/deps.json", lock),
        ("a/README.md", "# Title\n\n" + "The row is read and the index is built. " * 60), ("a/empty.py", ""), ("a/none.py", None), (None, hand(9)),
    ]
    df = spark.createDataFrame([(p, t, "x") for p, t in rows], SCHEMA)
    code = ~F.col("path").rlike(r"\.(md|json)$")
    got = {x.path: (x.origin, x.by) for x in pv.classify(df, "path", "text", code).collect()}
    assert {p for p, o in got.items() if o[0] == "hand"} == {"a/src/x.py", "a/vendor_portal/y.py", "a/codegen_tool/z.py", "a/vendor/ours/c3.py", "c/lib/g.py", "a/README.md"}
    assert {p: o for p, o in got.items() if o[0] != "hand"} == {
        "a/src/gen.rs": ("generated", "reuse"), "a/src/notice.py": ("generated", "notice and reuse"), "a/deps.json": ("generated", "reuse"), "a/zeros.py": ("generated", "reuse"),
        "a/vendor/lib-1.2.0/c.py": ("vendored", "shared origin"), "b/third_party/lib/c2.py": ("vendored", "shared origin"), "a/src/d.py": ("vendored", "shared origin"), "b/src/d2.py": ("vendored", "shared origin"),
        "a/src/e.py": ("vendored", "shared rules"), "b/lib/f.py": ("vendored", "shared rules"), "a/app.js": ("minified", "layout"), "a/data.py": ("data", "literals"), "a/blob.py": ("data", "literals"),
    }
    alone = {x.path: x.by for x in pv.classify(df, "path", "text", code, use_notices=False).collect()}
    assert alone["a/src/gen.rs"] == "reuse" and alone["a/src/e.py"] == "shared rules" and alone["a/src/d.py"] is None
    assert pv.classify(df.limit(0), "path", "text", F.lit(True)).count() == 0
