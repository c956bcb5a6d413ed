"""Expressions and operators on the small fixtures of the survey."""

import math

import pytest
from pyspark.sql import functions as F

from kelpline.functions import globs, jsoncols, scores, text, vectors
from kelpline.operators import chunking, context, retrieval, search, tables
from kelpline.operators.cache import Cache, ResultCache
from kelpline.operators.extract import extract
from kelpline.sources import config, manifests
from kelpline.streaming import changes, results


def one(spark, expr, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).select(expr.alias("x")).first()["x"]


def arr(xs):
    return F.array(*[F.lit(float(x)) for x in xs])


@pytest.mark.parametrize("pattern, path, want", [("main", "src/main.rs", True), ("*.rs", "main.rs", True), ("src/*.rs", "src/main.rs", True), ("src/**/*.rs", "src/foo/bar/main.rs", True), ("**/*.rs", "any/path/file.rs", True), ("", "", True), ("", "x", False), ("*.py", "main.rs", False), ("lib/**", "src/lib", False)])
def test_glob(spark, pattern, path, want):
    assert one(spark, globs.glob_match(pattern, F.col("p")), p=F.lit(path)) is want


def test_ignore(spark):
    paths = ["a/.git/x", ".github/w.yml", "node_modules/x/y.js", "src/a.rs", "Cargo.lock", "build/x", "a/build/y", ".gitignore"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    hidden = lambda g, **k: {r.p for r in rows.where(globs.ignored(F.col("p"), g, **k)).collect()}
    assert hidden(None) == {"node_modules/x/y.js", "Cargo.lock"} | {"a/.git/x"}
    assert hidden(globs.gitignore_globs("# c\n\nbuild/\n!keep\n/src/a.rs\n")) == {"a/.git/x", "build/x", "a/build/y", "src/a.rs"}
    assert {".github/w.yml", ".gitignore"} <= hidden([], compat=True)


def test_vectors(spark):
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=arr([1, 0]), b=arr([0, 1])) == 0
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=arr([1, 2]), b=arr([-1, -2])) == pytest.approx(-1)
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=arr([1, 2]), b=arr([1])) == 0
    v = [0.1, 0.5, -0.3, 0.8, -0.5, 0.2, 0, -0.1]
    q = one(spark, vectors.quantise(F.col("a")), a=arr(v))
    back = one(spark, vectors.dequantise(F.col("q.values"), F.col("q.min"), F.col("q.scale")), q=vectors.quantise(arr(v)))
    assert max(abs(a - b) for a, b in zip(v, back)) < 0.01
    wire = vectors.pack_quantised(q["values"], q["min"], q["scale"])
    assert vectors.unpack_quantised(wire)[0] == q["values"] and vectors.unpack_quantised(b"x") is None and len(wire) == 16
    flat = one(spark, vectors.quantise(F.col("a")), a=arr([2, 2]))
    assert flat["scale"] == 1.0 and flat["values"] == [-128, -128]
    assert one(spark, vectors.quantise(F.col("a"))["scale"], a=F.array().cast("array<float>")) == 0


def test_quantised_recall_and_error(spark):
    q = [math.sin(0.017 * i) for i in range(384)]
    docs = [[math.sin(i * (0.015 + 0.0001 * j)) for i in range(384)] for j in range(100)]
    df = spark.createDataFrame([(j, d) for j, d in enumerate(docs)], "id bigint, embedding array<double>").withColumn("s", vectors.quantise(F.col("embedding")))
    got = df.select("id", vectors.cosine(F.col("embedding"), arr(q)).alias("a"), vectors.cosine(vectors.dequantise(F.col("s.values"), F.col("s.min"), F.col("s.scale")), arr(q)).alias("b")).collect()
    top = lambda k: {r.id for r in sorted(got, key=lambda r: -r[k])[:10]}
    assert len(top("a") & top("b")) / 10 >= 0.98 and max(abs(r.a - r.b) for r in got) < 0.02


def test_priority_fixture(spark):
    rows = [("src/main.rs", 0.9, 0.8, 0.7, 0.6, 0.5), ("src/lib.rs", 0.5, 0.9, 0.8, 0.4, 0.3), ("tests/test.rs", 0.3, 0.2, 0.1, 0.2, 0.1)]
    df = spark.createDataFrame(rows, "path string, recency double, relevance double, centrality double, git_activity double, user_focus double")
    got = retrieval.priority_ranking(df).collect()
    assert [r.path for r in got] == [r[0] for r in rows] and [r.score for r in got] == pytest.approx([0.745, 0.645, 0.195])
    assert retrieval.priority_ranking(df, least=0.5).count() == 2 and retrieval.priority_ranking(df, most=0.5).count() == 1
    assert retrieval.priority_ranking(df, limit=2).count() == 2 and retrieval.priority_ranking(df, paths=["src/lib.rs"]).count() == 1


def test_fusion(spark):
    kw = spark.createDataFrame([("a", 1, "k", 1), ("b", None, "k", 2)], "path string, line_number int, content string, rank int")
    sem = spark.createDataFrame([("a", 1, "s", 1), ("b", None, "s", 3), ("c", 5, "s", 2)], kw.schema)
    got = {r.path: r for r in retrieval.fuse(kw, sem, 10).collect()}
    assert got["a"].match_type == got["b"].match_type == "Hybrid" and got["c"].match_type == "Semantic" and got["a"].content == "k"
    assert got["a"].score == pytest.approx(1 / 61) and got["a"].score > got["c"].score


def test_search(spark):
    df = spark.createDataFrame([("src/main.rs", 'fn main() {\n\n    println!("Hello, world!");\r\n}\n'), ("b", "hello hello world"), ("n", None)], "path string, text string")
    ls = search.text_lines(df, "path", "text")
    assert {(r.path, r.line_number) for r in ls.collect()} == {("src/main.rs", 1), ("src/main.rs", 3), ("src/main.rs", 4), ("b", 1)}
    assert [r.path for r in search.bm25(ls, "println", 5).collect()] == ["src/main.rs"]
    assert [r.path for r in search.bm25(ls, "hello", 5).collect()] == ["b", "src/main.rs"]
    assert [r.path for r in search.bm25(ls, '"hello world" -println', 5).collect()] == ["b"]
    assert search.bm25(ls, "+hello +missing", 5).count() == 0 and search.bm25(ls, "!!", 5).count() == 0
    with pytest.raises(ValueError):
        search.bm25(ls, '"open', 5)
    with pytest.raises(ValueError):
        search.bm25(ls, "nofield:x", 5)
    new = spark.createDataFrame([("b", 1, "other")], "path string, line_number bigint, content string")
    assert {r.content for r in search.replace_lines(ls, new).where("path = 'b'").collect()} == {"other"}


def test_budget_skips_what_does_not_fit(spark):
    rows = [(1, 9, "x" * 40), (2, 8, "x" * 400), (3, 7, "x" * 36), (4, 1, "x" * 8)]
    got = retrieval.pack_budget(spark.createDataFrame(rows, "id bigint, p int, t string"), 20, F.col("p"), F.col("t"), F.col("id")).collect()
    assert [(r.key, r.tokens, r.place) for r in sorted(got, key=lambda r: r.place)] == [(1, 10, 1), (3, 9, 2)]


def test_git(spark):
    rows = [("a", f"2024-01-{d:02d} 00:00:00") for d in range(1, 31)] + [("b", "2023-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "path string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.path: r for r in retrieval.git_scores(df, "2024-01-31 00:00:00").collect()}
    assert got["a"].commits_7d == 7 and got["a"].recent == 1 and got["b"].recent == 0 and got["b"].commits_30d == 0
    assert {r.path for r in retrieval.recently_changed(df, "2024-01-31 00:00:00", 48).collect()} == {"a"}


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "h", 1, 1, "go", 0.9, 7, 1), (2, "b", "h", 1, 1, "go", 0.5, None, 1)], tables.FILES)
    new = spark.createDataFrame([("a", "h2", 5, 2, "rust"), ("c", "h3", 5, 2, "rust"), ("c", "h0", 1, 2, "rust")], "path string, hash string, modified_at bigint, size bigint, language string")
    got = {r.path: r for r in tables.upsert_files(old, new, 99).collect()}
    assert got["a"].id == 1 and got["a"].hash == "h2" and got["a"].priority_score == 0.9 and got["a"].last_accessed == 7 and got["a"].indexed_at == 99
    assert got["b"].indexed_at == 1 and got["c"].hash == "h3" and len(got) == 3
    sy = tables.conform(spark.createDataFrame([(10, 1, "x", None), (11, 2, "y", 10), (12, 2, "z", 11)], "id bigint, file_id bigint, name string, parent_symbol_id bigint"), tables.SYMBOLS)
    em = tables.conform(spark.createDataFrame([(1, 10, 1), (2, 11, 2)], "id bigint, symbol_id bigint, file_id bigint"), tables.EMBEDDINGS)
    out = tables.delete_files({"files": old, "symbols": sy, "embeddings": em}, old.where("id = 1").select("path"))
    assert {(r.id, r.parent_symbol_id) for r in out["symbols"].collect()} == {(11, None), (12, 11)} and [r.id for r in out["embeddings"].collect()] == [2]
    store = tables.Store(spark, str(tmp_path / "s"))
    assert store.read("files").count() == 0 and store.write({"files": old}) == 1 and store.write({"files": store.read("files").where("id = 2")}) == 2
    assert [r.id for r in store.read("files").collect()] == [2]


def test_parents(spark):
    rows = [("f", 1, 1, "A", None, 1, 9), ("f", 2, 2, "m", "A", 2, 3), ("f", 3, 3, "m", "A", 5, 6), ("f", 4, 4, "q", "none", 7, 8)]
    df = spark.createDataFrame(rows, "path string, ordinal int, id bigint, name string, parent_name string, start_line int, end_line int")
    assert {r.id: r.parent_symbol_id for r in tables.link_parents(df).collect()} == {1: None, 2: None, 3: 1, 4: None}
    assert {r.id: r.parent_symbol_id for r in tables.link_parents_scoped(df).collect()} == {1: None, 2: 1, 3: 1, 4: None}


def test_text(spark):
    assert one(spark, text.normalise_query(F.col("a")), a=F.lit("  A  b\tC ")) == "a b c"
    assert one(spark, text.cache_key(F.col("a"), F.lit(5), F.lit(0.5)), a=F.lit("X y")) == "x y:5:0.50"
    assert one(spark, text.duration(F.col("a")), a=F.lit(3723)) == "1h 2m 3s" and one(spark, text.duration(F.col("a")), a=F.lit(62)) == "1m 2s"
    assert one(spark, text.visibility(F.col("a")), a=F.lit("PUB(crate)")) == "crate" and text.search_mode("Vector") == "semantic" and text.search_mode(None) == "hybrid"
    assert one(spark, text.language_of_extension(F.col("a")), a=F.lit("HPP")) == "cpp"
    assert one(spark, text.token_estimate(F.col("a")), a=F.lit("ééé")) == 1
    assert one(spark, jsoncols.decode_list(F.col("a")), a=F.lit("{bad")) == [] and one(spark, jsoncols.encode_list(F.col("a")), a=F.array().cast("array<string>")) is None


def test_scores(spark):
    assert one(spark, scores.recency(F.lit(24.0))) == pytest.approx(math.exp(-1))
    parts = scores.git_activity(F.lit(10), F.lit(13), F.lit(0.0))
    assert one(spark, parts["combined"]) == pytest.approx(0.4 * 1 + 0.3 * 1 + 0.3, abs=0.02)
    assert one(spark, scores.git_activity(F.lit(0), F.lit(0), F.lit(None).cast("double"))["combined"]) == 0
    assert one(spark, scores.watch_score(F.lit(True), F.lit(0), F.lit(0), F.lit(0))) == pytest.approx(0.55)


def test_chunks(spark):
    body = "\n".join(f"line {k}" for k in range(60)) + "\n"
    df = spark.createDataFrame([("a", body), ("e", ""), ("n", None)], "path string, text string")
    got = [(r.start_line, r.end_line) for r in chunking.fixed_chunks(df, "path", "text").collect()]
    assert got == [(1, 25), (24, 48), (47, 60), (59, 60)]
    code = "use x;\n\nfn a() {\n  b {\n  }\n}\nfn c() {}\n# tail\n".split("\n")
    assert [(s, e, k) for s, e, k, _ in chunking.split_semantic(code)] == [(1, 2, "CodeBlock"), (3, 6, "Symbol"), (7, 7, "Symbol"), (8, 9, "CodeBlock")]
    parts = list(chunking.split_recursive(["aaaa", "", "bbbbbbbb", "", "c"], target=16, overlap=0))
    assert [(s, e) for s, e, *_ in parts] == [(1, 3), (5, 5)]
    nested = "impl A {\n  fn a() {\n  }\n  fn b() {\n  }\n}\nfn c() {}".split("\n")
    assert [(s, e, k) for s, e, k, _ in chunking.split_semantic(nested)] == [(1, 1, "CodeBlock"), (2, 6, "Symbol"), (7, 7, "Symbol")]
    assert [(s, e, t) for s, e, _, t in chunking.split_recursive(["", "aaaaaaa", "", "b"], target=16, overlap=0)] == [(1, 2, "\naaaaaaa"), (4, 4, "b")]
    assert [(s, e) for s, e, *_ in chunking.split_recursive(["aaaa", "bbbb", "cccc", "dddd"], target=15, overlap=0.34)] == [(1, 3), (3, 4)]
    with pytest.raises(ValueError):
        chunking.chunks(df, "path", "text", "none")


def test_extract():
    rust = {r["name"]: r for r in extract("rust", "pub(crate) fn a() {}\npub unsafe fn b<T: X>(x: &T) -> u8 { 1 }\nfn c() {}\nstruct S;\nimpl S {\n  pub async fn m(&self) {}\n}\n")}
    assert rust["a"]["visibility"] == "crate" and rust["b"]["is_unsafe"] and rust["b"]["type_parameters"] == ["T"] and rust["b"]["return_type"] == "u8" and rust["c"]["visibility"] == "private"
    assert rust["m"]["parent_name"] == "S" and rust["m"]["is_async"]
    py = {r["name"]: r for r in extract("python", "class A:\n  def __p(self): pass\n  def __init__(self): pass\n  @staticmethod\n  def s(): pass\ndef _f(): pass\n")}
    assert py["__p"]["visibility"] == "private" and py["__init__"]["visibility"] == "protected" and py["s"]["is_static"] and py["_f"]["kind"] == "function" and py["s"]["kind"] == "method"
    rb = {r["name"]: r for r in extract("ruby", "class A\n  attr_accessor :x\n  def initialize(a)\n  end\n  def go\n    if x then y end\n  end\n  private\n  def hid\n  end\nend\n")}
    assert rb["x"]["kind"] == "property" and rb["initialize"]["kind"] == "function" and rb["hid"]["visibility"] == "private" and rb["go"]["visibility"] == "public" and rb["A"]["end_line"] == 11
    go = {r["name"]: r for r in extract("go", "package a\n\ntype T struct {\n\tx int\n}\n\nfunc (t *T) Do(a int) error {\n\treturn nil\n}\n")}
    assert go["Do"]["parent_name"] == "T" and go["Do"]["visibility"] == "public" and go["T"]["end_line"] == 5
    with pytest.raises(ValueError):
        extract("java", "class A {}")


def test_manifests(spark):
    one_text = lambda t: spark.createDataFrame([(t,)], "text string")
    assert {tuple(r) for r in manifests.cargo(one_text('[dependencies]\na = "1"\nb = {workspace = true}\n[build-dependencies]\nc = "3"\n')).collect()} == {("a", "1", "Runtime", "Cargo"), ("b", None, "Runtime", "Cargo"), ("c", "3", "Build", "Cargo")}
    assert manifests.cargo(one_text("[broken")).count() == 0


def test_context(spark):
    df = spark.createDataFrame([(2, "b.py", "y"), (1, "a.rs", "x")], "rank int, path string, content string")
    assert context.document(df, "markdown").first()["text"].startswith("## a.rs\n\n```rs\nx\n```")
    assert '"path":"a.rs"' in context.document(df, "json").first()["text"]


def test_cache():
    now = [0.0]
    c = Cache(2, ttl=10, clock=lambda: now[0])
    c.put("a", 1), c.put("b", 2), c.get("a"), c.put("c", 3)
    assert c.get("b") is None and c.get("a") == 1 and c.hit_rate == pytest.approx(2 / 3)
    now[0] = 11
    assert c.cleanup() == 2 and c.get("a") is None
    with pytest.raises(ValueError):
        Cache(0)
    r = ResultCache()
    k = r.key(" A  b ", limit=1)
    assert k == r.key("a b", limit=1) != r.key("a b", limit=1, paths=["x"])
    r.bump()
    assert k != r.key("a b", limit=1)


def test_config(tmp_path):
    c = config.parse("[indexing]\nmax_file_size = 9\nunknown = 1\n[other]\nx = 1\n")
    assert c.indexing.max_file_size == 9 and c.watching.debounce_ms == 1000 and c.validate() == []
    f = tmp_path / "c.toml"
    f.write_text("[watching]\ndebounce_ms = 5\n")
    r = config.Reloader(str(f))
    assert r.poll() and r.current.watching.debounce_ms == 5 and not r.poll()
    f.write_text("[watching]\ndebounce_ms = 0\n")
    import os

    os.utime(f, (9, 9))
    assert not r.poll() and r.problems and r.current.watching.debounce_ms == 5


def test_tiers_and_routes(spark):
    t = lambda e, s, r, a: one(spark, changes.tier(F.lit(e), F.lit(s), F.lit(r), F.lit(a)))
    assert t(True, 9999, 0, 0) == "Hot" and t(False, 10, 0, 0) == "Hot" and t(False, 9999, 10, 0) == "Warm" and t(False, 9999, 0, 15) == "Warm" and t(False, 9999, 2, 0) == "Cold" and t(None, None, None, None) == "Cold"
    a = lambda k, x: one(spark, changes.action(F.lit(k), F.lit(x)))
    assert [a("Deleted", "Cold"), a("Modified", "Hot"), a("Created", "Warm"), a("Modified", "Cold")] == ["RemoveFromIndex", "IndexImmediate", "QueueForIndex", "Ignore"]


def test_stream_end_to_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(f'{{"path": "p", "kind": "Modified", "ts": "2024-01-01T00:00:00.{k}00Z"}}' for k in range(1, 4)) + '\n{"path": "q", "kind": "Deleted", "ts": "2024-01-01T00:00:09Z"}\n')
    got = []
    state = spark.createDataFrame([("p", 20, "2023-12-31 00:00:00", False, 0)], "path string, accesses int, last_access string, is_entry boolean, references int")
    run = changes.start(changes.watch_folder(spark, str(tmp_path / "in")), lambda: state, lambda df, _: got.extend(df.collect()), str(tmp_path / "cp"))
    run.awaitTermination(60)
    assert {(r.path, r.action) for r in got} == {("p", "QueueForIndex"), ("q", "RemoveFromIndex")} and len(got) == 2


def test_results(spark):
    df = spark.range(25)
    parts = list(results.stream(df, 10))
    assert [len(p["items"]) for p in parts] == [10, 10, 5] and [p["is_last"] for p in parts] == [False, False, True]
    assert list(results.text_chunks("ab\ncdefgh ij", 4)) == ["ab\n", "cdef", "gh ", "ij"]
    assert "".join(results.text_chunks("x y\n" * 5000)) == "x y\n" * 5000


def test_budget_equals_plain_greedy(spark):
    import random

    r = random.Random(6)
    rows = [(k, r.randrange(9), "x" * (4 * r.choice([0, 1, 2, 3, 5, 8, 13, 60]))) for k in range(400)]
    got = retrieval.pack_budget(spark.createDataFrame(rows, "id bigint, p int, t string"), 90, F.col("p"), F.col("t"), F.col("id")).collect()
    room, want = 90, set()
    for k, _, t in sorted(rows, key=lambda x: (-x[1], x[0])):
        if len(t) // 4 <= room:
            room -= len(t) // 4
            want.add(k)
    assert {x.key for x in got} == want


def test_global_rank(spark):
    from kelpline.operators.numbering import global_rank

    got = global_rank(spark.range(500).repartition(7).selectExpr("id * 37 % 500 as v"), "v").collect()
    assert all(x["rank"] == x.v + 1 for x in got) and len(got) == 500


def test_progress():
    assert results.progress(5, 20, 10) == {"percent": 25.0, "per_second": 0.5, "seconds_left": 30.0}
    assert results.progress(0, 0, 0)["percent"] == 100.0 and results.progress(0, 5, 1)["seconds_left"] is None
