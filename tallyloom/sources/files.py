"""Reading and writing the project's files: JSON lines, JSON documents, CSV, Parquet with provenance, text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import rng

RECORD = "id STRING, source STRING, split STRING, license STRING, lang STRING, state STRING, questions STRING, targets STRING, meta STRING"


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """JSON lines with file name and text; blank lines are skipped, an unreadable line has ``bad`` set."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.length(F.trim(F.regexp_replace("value", "\r$", ""))) > 0)
    parsed = F.from_json("value", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("r", parsed).select("file", "r.*").withColumn("bad", F.col("_bad").isNotNull()).drop("_bad")


def checked(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A file whose content has the wanted digest, line by line with CRLF made LF; another file raises.

    The content is one value, so this is for files of some hundred MB at most.
    """
    content = spark.read.format("binaryFile").load(path).select(F.col("content").alias("c"))
    same = F.sha2("c", 256) == sha256.lower()
    text = F.decode(F.when(same, F.col("c")).otherwise(F.raise_error(F.lit("the file's digest differs"))), "utf-8")
    return content.select(F.posexplode(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")).alias("line_no", "line")).where("line <> ''")


def read_json_values(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON file that holds an array of objects or an object of objects: a row for each."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    rows = F.when(F.startswith("v", F.lit("[")), F.from_json("v", f"array<struct<{schema}>>")).otherwise(F.map_values(F.from_json("v", f"map<string, struct<{schema}>>")))
    return whole.select(F.explode(rows).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, schema: str, line_ends: bool = False) -> DataFrame:
    """CSV with a header and a declared schema; the schema is never guessed.

    Only fields that hold line ends need ``line_ends``; a file is then one task.
    """
    return spark.read.csv(path, header=True, schema=schema, multiLine=line_ends, escape='"')


def read_units(spark: SparkSession, path: str, columns: list[str], per_unit: int | None = None, seed: int = 0, key: str | None = None) -> DataFrame:
    """Parquet with pruned columns and the file of each row; at most ``per_unit`` rows a file by hashed rank."""
    df = spark.read.parquet(path).select(*columns, F.col("_metadata.file_name").alias("unit"))
    if per_unit is None:
        return df
    k = F.col(key or columns[0])
    w = Window.partitionBy("unit").orderBy(rng.unit(seed, F.col("unit"), k), k)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_unit).drop("_n")


def budgeted(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """About the first rows of a hashed order, exactly so many: a top-k, so each task sends no more than k."""
    return df.orderBy(rng.unit(seed, F.col(key)), key).limit(rows)


def raw_id(source: Column, index: Column) -> Column:
    """``source/raw/000123``."""
    return F.concat(source, F.lit("/raw/"), F.lpad(index.cast("string"), 6, "0"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, other than ASCII kept, line feeds only."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).write.mode("overwrite").text(path)


def write_splits(df: DataFrame, path: str, by: str = "split") -> None:
    """A folder a split; rows of a split are spread, so a large one is written by many tasks."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_valid(df: DataFrame, errors: str, path: str) -> dict[str, int]:
    """Write the rows without errors, and count kept and refused rows in the same pass; no row kept is a failure."""
    from pyspark.sql import Observation

    seen = Observation("write")
    ok = F.size(errors) == 0
    df.observe(seen, F.count_if(ok).alias("kept"), F.count_if(~ok).alias("refused")).where(ok).drop(errors).write.mode("overwrite").parquet(path)
    counts = {k: int(v) for k, v in seen.get.items()}
    if counts["kept"] == 0:
        raise ValueError("no record was written")
    return counts


def unique(df: DataFrame, key: str) -> DataFrame:
    """The rows, or a failure at run time if a key repeats."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated: "), F.col(key).cast("string")))).otherwise(F.lit(True)).cast("boolean")).drop("_n")


def digest_of(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select(F.col("path"), F.sha2("content", 256).alias("sha256"), "length")


def preview(text: Column, n: int = 300) -> Column:
    """The beginning of a text; what was cut is said by its length."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("… ("), F.length(text).cast("string"), F.lit(" characters)"))).otherwise(text)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table, at most ``most`` rows."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join("—" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])


def row_groups(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """``file``, ``row_group``, ``n_rows``, ``bytes``, ``base``: the row groups of Parquet files from their footers alone.

    ``base`` is the number of rows before the group in its file. Files are listed without their content, and footers are
    read by the tasks; the folder must be one that they reach as a path.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path")

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                m = pq.read_metadata(path.removeprefix("file://").removeprefix("file:"))
                rows += [(path, g, m.row_group(g).num_rows, m.row_group(g).total_byte_size) for g in range(m.num_row_groups)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["file", "row_group", "n_rows", "bytes"])

    groups = listed.mapInArrow(run, "file string, row_group int, n_rows long, bytes long")
    before = F.sum("n_rows").over(Window.partitionBy("file").orderBy("row_group").rowsBetween(Window.unboundedPreceding, -1))
    return groups.withColumn("base", F.coalesce(before, F.lit(0)))


def file_order(files: DataFrame, path: str, size: str, seed: int = 0, big: int = 1 << 30) -> DataFrame:
    """Files in a hashed order with the big ones last."""
    return files.orderBy(F.col(size) >= big, rng.unit(seed, F.col(path)), path)


def upstream_place(url: Column) -> Column:
    """Repository, revision and path in the address of a dataset file, or in its path with or without a revision; else null."""
    by_url = r"^https://[^/]+/datasets/([^/]+/[^/]+)/resolve/([^/]+)/(.+)$"
    by_path = r"^datasets/([^/@]+/[^/@]+)(?:@([^/]+))?/(.+)$"
    part = lambda p, k: F.regexp_extract(url, p, k)
    place = lambda p: F.struct(part(p, 1).alias("repo"), F.url_decode(F.nullif(part(p, 2), F.lit(""))).alias("revision"), part(p, 3).alias("path"))
    return F.when(url.rlike(by_url), place(by_url)).when(url.rlike(by_path), place(by_path))


def rebased(path: Column, from_folder: str, to_folder: str) -> Column:
    """A path relative to one folder as a path relative to another; absolute paths stay, separators become slashes."""
    import posixpath

    step = posixpath.relpath(from_folder, to_folder)
    parts = F.filter(F.split(F.concat_ws("/", F.lit(step), F.regexp_replace(path, r"\\", "/")), "/"), lambda x: ~x.isin("", "."))
    up = lambda a, x: F.when((x == "..") & (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("")), a), -1) != ".."), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.when(path.isNull() | path.rlike(r"^(/|[A-Za-z]:[\\/])"), path).otherwise(F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"))


def without_sources(spark: SparkSession, path: str, skip: tuple[str, ...], schema: str = RECORD) -> DataFrame:
    """JSON lines whose source is not to be skipped; the text of a line is judged before it is parsed."""
    lines = spark.read.text(path).where(~F.regexp_extract("value", '"source": "([^"]+)"', 1).isin(*skip))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def run_sources(jobs: dict, folder: str, spark: SparkSession, force: bool = False) -> DataFrame:
    """Run one writer a source, each a frame that goes to its own folder; sources that have output are skipped.

    Gives ``source``, ``outcome`` (written, kept, empty, failed), ``rows`` and ``error``; one source that fails stops no
    other. The number of sources is small and fixed, so the loop is over them and never over rows.
    """
    done = []
    for name, make in jobs.items():
        at = f"{folder}/{safe(name)}"
        try:
            if not force and _has_output(spark, at):
                done.append((name, "kept", None, None))
                continue
            make(spark).write.mode("overwrite").parquet(at)
            n = spark.read.parquet(at).count()
            done.append((name, "written" if n else "empty", n, None))
        except Exception as e:  # noqa: BLE001 - the report carries it
            done.append((name, "failed", None, f"{type(e).__name__}: {str(e)[:200]}"))
    return spark.createDataFrame(done, "source string, outcome string, rows long, error string")


def safe(name: str) -> str:
    """A folder's name of letters, digits and ``-_.``."""
    return "".join(c if c.isalnum() and c.isascii() or c in "-_." else "_" for c in name)[:120]


def _has_output(spark: SparkSession, at: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
