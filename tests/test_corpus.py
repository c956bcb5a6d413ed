"""The facade end to end over a small folder."""

import time

import pytest

from kelpline.corpus import Corpus, NotIndexed
from kelpline.operators import search
from kelpline.streaming.changes import watch_folder

FILES = {
    "src/lib.rs": 'pub struct Cache<T> {\n    rows: Vec<T>,\n}\n\nimpl<T> Cache<T> {\n    /// Finds a row.\n    pub async fn lookup(&self, key: &str) -> Option<T> {\n        println!("hello {");\n        None\n    }\n}\n\nconst LIMIT: usize = 3;\n',
    "src/module.py": 'class Parser:\n    """Parses."""\n    def _parse(self, text: str) -> int:\n        return 1\n\nasync def run():\n    pass\n',
    "src/index.ts": "export class Store {\n  private static async load(id: number): Promise<string> {\n    return 'x';\n  }\n}\n",
    "node_modules/a.js": "function hidden() {}\n", "big.json": "[" + "1," * 300_000 + "1]", "notes.bin": "x", ".git/config": "x",
}


@pytest.fixture()
def root(tmp_path):
    for p, t in FILES.items():
        f = tmp_path / "in" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    return tmp_path


def test_queries(spark, root):
    c = Corpus(spark, str(root / "index"))
    with pytest.raises(NotIndexed):
        c.index_status()
    assert c.reindex(str(root / "in"), now=1000)["indexed"] == 3
    status = c.index_status()
    assert status["files"] == 3 and status["by_kind"]["method"] == 2
    assert [r.path for r in c.find_symbol("lookup").collect()] == ["src/lib.rs"]
    assert {r.name for r in c.find_symbol("PARS", fuzzy=True).collect()} == {"Parser", "_parse"}
    assert c.find_symbol("_parse", visibility="protected", kind="method").count() == 1
    assert [r.name for r in c.get_file_outline("src/lib.rs").collect()] == ["Cache", "Cache", "lookup", "LIMIT"]
    (hit,) = c.context_grep("println")
    assert hit["path"] == "src/lib.rs" and hit["line_number"] == 8
    found = c.context_search("parse text")
    assert found[0]["path"] == "src/module.py" and c.context_search("parse text") is not None and c.cache.hits >= 1
    assert c.semantic_search("Store load", min_similarity=0.1, paths=["*.ts"])[0]["path"] == "src/index.ts"
    ranked = c.get_relevant_context("lookup", now=1000).collect()
    assert ranked[0].path == "src/lib.rs" and c.ping()["status"] == "ok"
    (root / "in/src/module.py").write_text("def new_function():\n    pass\n")
    (root / "in/src/index.ts").unlink()
    done = c.reindex(str(root / "in"), now=2000)
    assert done["indexed"] == 1 and done["removed"] == 1
    assert c.find_symbol("Parser").count() == 0 and c.find_symbol("new_function").count() == 1 and c.find_symbol("lookup").count() == 1
    c.remove_file("src/lib.rs")
    assert c.find_symbol("lookup").count() == 0 and c.context_grep("println") == []


def test_named_files_are_indexed_alone(spark, root):
    c, at = Corpus(spark, str(root / "index")), str(root / "in")
    c.reindex(at, now=1000)
    (root / "in/src/module.py").write_text("def another():\n    pass\n")
    (root / "in/src/fresh.py").write_text("def fresh():\n    pass\n")
    (root / "in/src/index.ts").unlink()
    (root / "in/src/lib.rs").write_text("fn not_asked_for() {}\n")
    done = c.index_files(at, ["src/module.py", "src/fresh.py", "src/index.ts", "src/never.py"], now=2000)
    assert done["indexed"] == 2 and done["removed"] == 1
    names = {r.name for r in c.find_symbol("", fuzzy=True).collect()}
    assert {"another", "fresh", "lookup"} <= names and not {"Parser", "Store", "not_asked_for"} & names
    routed = spark.createDataFrame([("src/lib.rs", "Modified", "IndexImmediate"), ("src/module.py", "Deleted", "RemoveFromIndex"), ("src/fresh.py", "Modified", "Ignore")], "path string, kind string, action string")
    (root / "in/src/module.py").unlink()
    assert c.apply_changes(at, routed, now=3000)["removed"] == 1
    assert c.find_symbol("not_asked_for").count() == 1 and c.find_symbol("another").count() == 0 and c.find_symbol("fresh").count() == 1
    assert c.index_files(at, [], now=4000)["indexed"] == 0


def test_ignore_file_of_the_folder(spark, root):
    (root / "in/.gitignore").write_text("# own rules\nsrc/\n!keep\n/top.py\n")
    (root / "in/top.py").write_text("x = 1\n")
    (root / "in/other.py").write_text("x = 1\n")
    c = Corpus(spark, str(root / "index"))
    c.reindex(str(root / "in"), now=1000)
    assert {r.path for r in c.store.read("files").collect()} == {"other.py"}


@pytest.mark.parametrize("query", ["println key", "+self key", "key -self", '"pub async" key', "absent", "key AND self", ""])
def test_postings_find_the_same_lines(spark, root, tmp_path, query):
    rows = [(p, k, t) for p, x in FILES.items() if len(x) < 5000 for k, t in enumerate(x.split("\n"), 1) if t.strip()]
    lines = spark.createDataFrame(rows, "path string, line_number bigint, content string")
    search.write_postings(lines, str(tmp_path / "p"))
    plain = [(r.path, r.line_number, round(r.score, 9)) for r in search.bm25(lines, query, 5).collect()]
    assert [(r.path, r.line_number, round(r.score, 9)) for r in search.bm25_indexed(lines, str(tmp_path / "p"), query, 5).collect()] == plain


def test_a_stream_of_events_reaches_the_index(spark, root):
    c, at, feed = Corpus(spark, str(root / "index")), str(root / "in"), root / "events"
    c.reindex(at, now=1000)
    feed.mkdir()
    (root / "in/src/module.py").write_text("def streamed():\n    pass\n")
    log = spark.createDataFrame([("src/module.py", 20, None, True, 0)], "path string, accesses bigint, last_access timestamp, is_entry boolean, references int")
    stream = c.watch(at, watch_folder(spark, str(feed)), lambda: log, str(root / "checkpoint"))
    try:
        for k in range(2):
            (feed / f"{k}.json").write_text('{"path": "src/module.py", "kind": "Modified", "ts": "2024-01-01T00:00:0%d"}\n' % k)
        end = time.time() + 90
        while time.time() < end and not c.find_symbol("streamed").count():
            time.sleep(1)
        assert stream.exception() is None and c.find_symbol("streamed").count() == 1 and c.find_symbol("Parser").count() == 0
    finally:
        stream.stop()
