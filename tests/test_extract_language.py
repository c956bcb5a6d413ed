"""Files without a language are read by their extension."""

from kelpline.operators.extract import extract_symbols


def test_null_language(spark):
    rows = [("r/a.py", None, "def f(): pass\n"), ("r/b.RS", " ", "fn g() {}\n"), ("r/c.go", " Go ", "package c\n\nfunc H() {}\n"), ("r/d.md", None, "# h\n"), ("r/e.py", "rust", "fn k() {}\n"), ("noext", None, "def x(): pass\n"), ("r/t.py", None, None)]
    got = extract_symbols(spark.createDataFrame(rows, "path string, language string, text string"), "path", "language", "text").where("kind = 'function'").collect()
    assert {(r.path, r.name) for r in got} == {("r/a.py", "f"), ("r/b.RS", "g"), ("r/c.go", "H"), ("r/e.py", "k")}
