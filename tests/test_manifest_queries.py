"""The manifest queries read the manifests of the tables."""

import duckdb

import __spark_entry__
from kelpline.sources import manifests

DOCS = {
    "web/package.json": '{"dependencies": {"left": "^2"}, "peerDependencies": {"right": "3"}}',
    "web/cut/package.json": '{"dependencies": {"lost"',
    "web/not-package.json": '{"dependencies": {"other": "1"}}',
    "ml/requirements.txt": "numpy==2.0\r\n",
    "ml/pyproject.toml": '[project]\ndependencies = ["pandas>=2", 3]\n[tool]\npoetry = 1\n',
    "ml/odd/pyproject.toml": 'project = "x"\n',
}


def test_manifests_of_the_tables(spark, tmp_path):
    spark.createDataFrame([(k, p, "json") for k, p in enumerate(DOCS)], "id bigint, path string, language string").write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame([(k, "File ", t) for k, t in enumerate(DOCS.values())], "file_id bigint, chunk_type string, chunk_text string").write.parquet(f"{tmp_path}/chunk_embeddings.parquet")
    rows = lambda name: {tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()}
    assert rows("S21_package_json") == {("left", "^2", "Runtime", "Npm"), ("right", "3", "Peer", "Npm")}
    assert rows("S22_requirements") == {("numpy", "==2.0", "Runtime", "PyPi")}
    assert rows("S23_pyproject") == {("pandas", ">=2", "Runtime", "PyPi")}
    con = duckdb.connect()
    for name in ("files", "chunk_embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("S21_package_json", "S22_requirements"):
        assert set(con.sql(__spark_entry__.oracle_sql()[name]).fetchall()) == rows(name)


def test_readers_of_manifests(spark):
    read = lambda reader, text: {tuple(r) for r in reader(spark.createDataFrame([(text,), (None,), ("",)], "text string")).collect()}
    assert read(manifests.package_json, '{"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}, "peerDependencies": {"c": {"x": 1}}}') == {("a", "^1", "Runtime", "Npm"), ("b", "2", "Development", "Npm"), ("c", None, "Peer", "Npm")}
    assert read(manifests.requirements, "# c\na==1.0\n\nb >= 2\n-r other\nc\n") == {("a", "==1.0", "Runtime", "PyPi"), ("b ", ">= 2", "Runtime", "PyPi"), ("c", None, "Runtime", "PyPi")}
    assert read(manifests.pyproject, '[project]\ndependencies = ["a>=1", "b[x]==2"]\n[tool.poetry.dependencies]\npython = "3"\nc = "^3"\n') == {("a", ">=1", "Runtime", "PyPi"), ("b", "[x]==2", "Runtime", "PyPi"), ("c", "^3", "Runtime", "PyPi")}
    assert read(manifests.cargo, '[dependencies]\na = "1"\nb = { version = "2" }\n[dev-dependencies]\nc = "3"\n') == {("a", "1", "Runtime", "Cargo"), ("b", "2", "Runtime", "Cargo"), ("c", "3", "Development", "Cargo")}
