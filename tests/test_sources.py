"""Sources and sinks on small files."""

from pyspark.sql import functions as F

from tallyloom.sources import files


def test_row_groups_from_footers(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"x": list(range(25))}), tmp_path / "a.parquet", row_group_size=10)
    pq.write_table(pa.table({"x": [1]}), tmp_path / "b.parquet")
    got = {(r.file.rsplit("/", 1)[1], r.row_group): (r.n_rows, r.base) for r in files.row_groups(spark, f"file://{tmp_path}").collect()}
    assert got == {("a.parquet", 0): (10, 0), ("a.parquet", 1): (10, 10), ("a.parquet", 2): (5, 20), ("b.parquet", 0): (1, 0)}


def test_big_files_last(spark):
    df = spark.createDataFrame([(f"f{i}", (1 << 30) if i % 3 == 0 else i) for i in range(12)], "path string, size long")
    got = [r["size"] >= 1 << 30 for r in files.file_order(df, "path", "size").collect()]
    assert got == [False] * 8 + [True] * 4


def test_places_of_datasets(spark):
    rows = ["https://host/datasets/a/b/resolve/r%2F1/x/y.parquet", "datasets/a/b@main/x.jsonl", "datasets/a/b/x.jsonl", "https://host/a/b", "", None]
    got = [r.p and tuple(r.p) for r in spark.createDataFrame([(x,) for x in rows], "u string").select(files.upstream_place(F.col("u")).alias("p")).collect()]
    assert got == [("a/b", "r/1", "x/y.parquet"), ("a/b", "main", "x.jsonl"), ("a/b", None, "x.jsonl"), None, None, None]


def test_paths_move_between_folders(spark):
    import posixpath

    paths = ["../images/a.png", "a/./b.png", "../../up.png", "x/../y.png", "/abs/z.png", "C:\\pic.png", "win\\a.png", None]
    got = [r.p for r in spark.createDataFrame([(x,) for x in paths], "p string").select(files.rebased(F.col("p"), "data/raw/text", "data/build/v1").alias("p")).collect()]
    want = [p if p is None or p.startswith("/") or p[1:2] == ":" else posixpath.relpath(posixpath.join("data/raw/text", p.replace("\\", "/")), "data/build/v1") for p in paths]
    assert got == want


def test_sources_are_skipped_before_parsing(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "1", "source": "a"}\n{"id": "2", "source": "b"}\n{"id": "3"}\n')
    assert sorted(r.id for r in files.without_sources(spark, f"file://{tmp_path}/r.jsonl", ("b",)).collect()) == ["1", "3"]


def test_runs_of_sources_are_resumed(spark, tmp_path):
    def fails(_):
        raise RuntimeError("down")

    jobs = {"one/a": lambda s: s.range(3), "none": lambda s: s.range(0), "bad": fails}
    run = lambda **k: {r.source: (r.outcome, r.rows) for r in files.run_sources(jobs, f"file://{tmp_path}", spark, **k).collect()}
    assert run() == {"one/a": ("written", 3), "none": ("empty", 0), "bad": ("failed", None)}
    assert run() == {"one/a": ("kept", None), "none": ("kept", None), "bad": ("failed", None)} and run(force=True)["one/a"] == ("written", 3)


def test_checked_files_and_json_values(spark, tmp_path):
    import hashlib

    import pytest

    (tmp_path / "t.txt").write_bytes(b"a\r\n\r\nb")
    sha = hashlib.sha256(b"a\r\n\r\nb").hexdigest()
    assert [r.line for r in files.checked(spark, f"file://{tmp_path}/t.txt", sha.upper()).orderBy("line_no").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="differs"):
        files.checked(spark, f"file://{tmp_path}/t.txt", "0" * 64).collect()
    (tmp_path / "l.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "m.json").write_text('{"k": {"x": 3}}')
    assert sorted(r.x for f in "lm" for r in files.read_json_values(spark, f"file://{tmp_path}/{f}.json", "x int").collect()) == [1, 2, 3]
    assert files.digest_of(spark, f"file://{tmp_path}/t.txt").first().sha256 == sha
