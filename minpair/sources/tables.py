"""Readers and writers.

Readers declare schemas where the format has none and let Catalyst prune columns and push filters
into the scan; writers partition by the columns later jobs filter on.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minpair.session import materialise

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as it is now; projections and filters applied later reach the parquet scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- S01 / S13: prepared reviews, partitioned by language and split -------------------------------

def read_reviews(spark: SparkSession, path: str, lang: str | None = None,
                 split: str | None = None) -> DataFrame:
    """Reviews of one language (and split); both are partition columns, so this prunes files."""
    df = spark.read.parquet(path)
    if lang is not None:
        df = df.where(F.col("language") == lang)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df


def write_reviews(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Save the prepared reviews partitioned by language and split."""
    df.write.mode(mode).partitionBy("language", "split").parquet(path)


# --- S02: many category files, corrupt or missing ones skipped ----------------------------------

def read_category_files(spark: SparkSession, paths: Iterable[str], schema: T.StructType) -> DataFrame:
    """Union of per-category parquet files (corrupt / missing ones skipped); the category comes
    from the file path."""
    df = (spark.read.schema(schema)
          .option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
          .parquet(*list(paths)))
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return df.withColumn("source_file", F.regexp_replace(name, r"\.parquet$", ""))


def account_categories(spark: SparkSession, root: str, expected: DataFrame, schema: T.StructType) -> DataFrame:
    """S02, the log of a tolerant read: for every expected category and every folder ``root/category=<c>``
    its ``state`` - ``read``, ``partly`` (some files gave no row), ``unread`` (none did: broken or empty) or
    ``missing`` (no folder) -, how many files gave no row, and the rows read. ``expected(category)``. Files
    are listed without being opened; rows are counted by the file they come from."""
    files = spark.read.format("binaryFile").option("basePath", root).load(root).select(
        F.col("category").cast("string").alias("category"), F.col("_metadata.file_path").alias("file"))
    rows = (spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").option("basePath", root)
            .parquet(root).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n")))
    found = files.join(rows, "file", "left").groupBy("category").agg(
        F.count_if(F.col("n").isNull()).alias("files_unread"), F.count("n").alias("read"), F.sum("n").alias("n_rows"))
    state = (F.when(F.col("read").isNull(), "missing").when(F.col("read") == 0, "unread")
             .when(F.col("files_unread") > 0, "partly").otherwise("read"))
    return expected.select("category").distinct().join(found, "category", "full").select(
        "category", state.alias("state"), F.coalesce("files_unread", F.lit(0)).alias("files_unread"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def skipped_categories(loaded: DataFrame, expected: DataFrame, key: str = "source_file") -> DataFrame:
    """Expected categories that produced no rows (anti join, the log of skipped files)."""
    return expected.join(loaded.select(key).distinct(), key, "left_anti")


# --- S04 / S05: nested JSON corpus <-> long table ------------------------------------------------

CORPUS_JSON_TYPE = "map<string, map<string, array<string>>>"


def read_corpus_json(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """``emotion -> group -> [sentences]`` JSON to ``(lang, emotion, grp, pair_id, sentence)``."""
    raw = spark.read.text(path, wholetext=True)
    nested = raw.select(F.from_json("value", CORPUS_JSON_TYPE).alias("m"))
    by_emotion = nested.select(F.explode("m").alias("emotion", "groups"))
    by_group = by_emotion.select("emotion", F.explode("groups").alias("grp", "sentences"))
    return by_group.select(F.lit(lang).alias("lang"), "emotion", "grp",
                           F.posexplode("sentences").alias("pair_id", "sentence"))


def corpus_to_json(long: DataFrame) -> DataFrame:
    """Inverse of :func:`read_corpus_json` for one language: a single JSON text row.

    Only for small corpora (the JSON document is one value); the long table is the normal sink.
    """
    per_group = (long.groupBy("emotion", "grp")
                 .agg(F.sort_array(F.collect_list(F.struct("pair_id", "sentence"))).alias("items")))
    per_group = per_group.select("emotion", "grp", F.transform("items", lambda s: s["sentence"]).alias("sents"))
    per_emotion = (per_group.groupBy("emotion")
                   .agg(F.map_from_entries(F.collect_list(F.struct("grp", "sents"))).alias("groups")))
    return per_emotion.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("emotion", "groups"))))
                           .alias("value"))


# --- S06 / S08 / S12: result CSVs -----------------------------------------------------------------

SUMMARY_SCHEMA = T.StructType([
    T.StructField("bias_cat_1_mean", T.DoubleType()), T.StructField("bias_cat_2_mean", T.DoubleType()),
    T.StructField("performance_gap", T.DoubleType()), T.StructField("statistical_significance", T.DoubleType()),
    T.StructField("bias_cat_1_name", T.StringType()), T.StructField("bias_cat_2_name", T.StringType()),
    T.StructField("bias_type", T.StringType()), T.StructField("steps", T.IntegerType()),
    T.StructField("lang", T.StringType()),
])

LABEL_SCHEMA = T.StructType([
    T.StructField("label_1", T.IntegerType()), T.StructField("label_2", T.IntegerType()),
    T.StructField("performance_gap", T.IntegerType()), T.StructField("bias_cat_1", T.StringType()),
    T.StructField("bias_cat_2", T.StringType()), T.StructField("bias_type", T.StringType()),
    T.StructField("steps", T.IntegerType()), T.StructField("lang", T.StringType()),
    T.StructField("emotion", T.StringType()),
])

PERFORMANCE_SCHEMA = T.StructType([
    T.StructField("precision", T.DoubleType()), T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()), T.StructField("support", T.LongType()),
    T.StructField("acc", T.DoubleType()), T.StructField("bias_cat", T.StringType()),
    T.StructField("bias_type", T.StringType()), T.StructField("steps", T.IntegerType()),
])


#: Older label-file layouts: column renames onto the current header.
LEGACY_LABEL_COLUMNS = {"bias_cat_1_name": "bias_cat_1", "bias_cat_2_name": "bias_cat_2", "label": "label_1",
                        "bias_cat_name": "bias_cat_1"}


def file_headers(spark: SparkSession, path: str, glob: str | None = None) -> dict[str, list[str]]:
    """Header line -> files that have it: the first line of every file, found in one pass (a row a
    file comes to the driver, as its name does when a family is listed)."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                     F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"))
    found: dict[str, list[str]] = {}
    for r in lines.groupBy("file").agg(F.min_by("value", F.struct("start", "i")).alias("header")).collect():
        found.setdefault(r["header"], []).append(r["file"])
    return found


def read_result_csv(spark: SparkSession, path: str, schema: T.StructType,
                    glob: str | None = None, renames: dict[str, str] | None = None) -> DataFrame:
    """Result CSV(s), optionally chosen by file-name glob, read by the names in each file's
    header: files of older layouts (other columns, other order, ``renames``) are read into the same
    columns, and what a layout lacks is NULL. ``nan`` becomes NULL, the file path is kept. Columns of
    a partitioned folder are taken from its path."""
    types = {f.name: f.dataType for f in schema.fields}
    parts = []
    for header, files in sorted(file_headers(spark, path, glob).items()):
        names = [c.strip().strip('"') for c in header.split(",")]
        # A rename applies where the layout lacks the current name and the schema lacks the old one.
        now = [(renames or {}).get(c, c) if c not in types else c for c in names]
        now = [c if c in names or now.count(c) == 1 else n for c, n in zip(now, names)]
        layout = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in now])
        df = (spark.read.schema(layout).option("header", "true").option("nanValue", "nan").option("enforceSchema", "true")
              .option("basePath", path).csv(files))
        have = {c: df[c] for c in df.columns}
        parts.append(df.select(*[(have[c] if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()],
                               F.col("_metadata.file_path").alias("source_file")))
    if not parts:
        empty = T.StructType([*schema.fields, T.StructField("source_file", T.StringType())])
        return spark.createDataFrame([], empty)
    df = reduce(DataFrame.unionByName, parts)
    doubles = [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)) for c in doubles})


def write_result_csv(df: DataFrame, path: str, partition_by: list[str] | None = None,
                     mode: str = "overwrite", ending: str = "csv") -> None:
    """Result tables as CSV with header, partitioned by the given columns; ``ending``: three
    letters that the files' names end in."""
    writer = df.write.mode(mode).option("header", "true").option("extension", ending)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


# --- S03: sheets -----------------------------------------------------------------------------------

def read_sheet(spark: SparkSession, path: str, schema: T.StructType, checked: int | None = None) -> DataFrame:
    """One kind of sheet, a CSV file or more for each ``path/lang=<l>``, read by type: the schema's columns,
    ``lang``, ``source_file``, and ``rejected``, the line of a row that doesn't fit its types (NULL for sound
    rows). Only files whose header starts with the schema's first ``checked`` names (default all) in their
    order are read; :func:`sheet_headers` lists all. Read once, as lines are checked only where all
    columns are read."""
    names = schema.names[:checked]
    sound = [f for header, files in file_headers(spark, path).items() if header_names(header)[:len(names)] == names for f in files]
    full = T.StructType([*schema.fields, T.StructField("rejected", T.StringType())])
    if not sound:
        return spark.createDataFrame([], T.StructType([*full.fields, T.StructField("lang", T.StringType()), T.StructField("source_file", T.StringType())]))
    rows = (spark.read.schema(full).option("header", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "rejected")
            .option("basePath", path).csv(sound))
    return materialise(rows.withColumn("source_file", F.col("_metadata.file_path")))


def header_names(header: str) -> list[str]:
    return [c.strip().strip('"') for c in header.split(",")]


def sheet_headers(spark: SparkSession, path: str, expected: list[str]) -> DataFrame:
    """``source_file, lang, header, header_ok`` of every file of a kind of sheet."""
    rows = [(f, header, header_names(header)[:len(expected)] == expected) for header, files in file_headers(spark, path).items() for f in files]
    found = spark.createDataFrame(rows, "source_file string, header string, header_ok boolean")
    return found.withColumn("lang", F.regexp_extract("source_file", r"/lang=([^/]+)/", 1))


# --- S10 / S12: all outputs of a set of runs -------------------------------------------------------

def write_outputs(outputs: dict[str, DataFrame], path: str, by: list[str]) -> dict[str, int]:
    """Every kind of output in one write, as CSV lines without header under ``kind=<k>/<by>=<v>/``.
    Partitions that the rows touch are replaced, others stay, so one run can be written again. Returns the
    number of rows of each kind, counted while they are written."""
    lines = reduce(DataFrame.unionByName, [
        df.select(F.lit(kind).alias("kind"), *by, F.to_csv(F.struct(*[c for c in df.columns if c not in by])).alias("value"))
        for kind, df in outputs.items()])
    seen = Observation()
    lines = lines.observe(seen, *[F.count_if(F.col("kind") == kind).alias(kind) for kind in outputs])
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", *by).text(path)
    return seen.get


def read_output(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    """One kind of a set written by :func:`write_outputs`; ``schema`` holds the line's columns and those of
    the folders."""
    return spark.read.schema(schema).option("basePath", f"{path}/kind={kind}").csv(f"{path}/kind={kind}")


# --- S07: a family of result files tagged by model type and language ----------------------------

def read_result_family(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """Results stored as ``root/model_type=<t>/lang=<l>/*.parquet``: one partitioned read.

    Missing combinations simply have no directory; partition pruning selects the ones asked for.
    """
    reader = spark.read.option("basePath", root)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(root)


def write_result_family(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Save an assembled mart partitioned by model type and language."""
    df.write.mode(mode).partitionBy("model_type", "lang").parquet(root)


# --- S09: run registry from config rows and checkpoint folder names ------------------------------

def run_registry(configs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """``configs(model_lang, test_lang, model_dirs array<string>)`` and ``checkpoints(model_dir,
    name)`` to ``(run, model_lang, test_lang, lang, epochs, seed, seed_rank, steps)``.

    The folder name is ``<lang>_<epochs>_<seed>`` and maybe a date (``multi+en`` is one token); checkpoint
    folders are ``checkpoint-<steps>``. ``seed_rank`` is the position in ``model_dirs`` (vote tie order).
    """
    runs = configs.select("model_lang", "test_lang",
                          F.posexplode("model_dirs").alias("seed_rank", "model_dir"))
    base = F.element_at(F.filter(F.split(F.col("model_dir"), "/"), lambda s: s != ""), -1)
    parts = F.split(base, "_")
    runs = runs.select("*", base.alias("run"), parts[0].alias("lang"),
                       parts[1].cast("double").cast("int").alias("epochs"), parts[2].cast("int").alias("seed"))
    runs = runs.withColumn("model_dir", folder_path(F.col("model_dir")))
    ck = checkpoints.where(F.col("name").startswith("checkpoint")).select(
        folder_path(F.col("model_dir")).alias("model_dir"), F.regexp_extract("name", r"checkpoint-(\d+)", 1).cast("int").alias("steps"))
    return runs.join(ck, "model_dir").drop("model_dir")


def folder_path(path: Column) -> Column:
    """A folder as a configuration or a listing names it, without the file system and the end's slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), r"/+$", "")


def read_run_configs(spark: SparkSession, path: str) -> DataFrame:
    """``(model_lang, test_lang, model_dirs)`` of every configuration text in a folder: two ``key: value``
    lines and a list of folders, one a line after a hyphen."""
    text = spark.read.text(path, wholetext=True)

    def key(name: str) -> Column:
        return F.regexp_extract("value", rf"(?m)^{name}:[ \t]*(\S+)", 1).alias(name)

    return text.select(key("model_lang"), key("test_lang"), F.regexp_extract_all(
        "value", F.lit(r"(?m)^[ \t]*-[ \t]+(\S+)"), 1).alias("model_dirs"))


def read_checkpoint_folders(spark: SparkSession, root: str) -> DataFrame:
    """``(model_dir, name)`` of every folder with files two levels below ``root``: a listing of paths, no
    file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path"))
    at = r"^(.*)/([^/]+)/[^/]+$"
    return files.select(F.regexp_extract("path", at, 1).alias("model_dir"), F.regexp_extract("path", at, 2).alias("name")).distinct()


# --- S15: category mapping -------------------------------------------------------------------------

def read_category_mapping(spark: SparkSession, path: str) -> DataFrame:
    """``source_category, target_category (x = none), uncertain ('?')``."""
    raw = spark.read.option("header", "true").csv(path)
    cols = raw.columns
    return raw.select(F.col(cols[0]).alias("source_category"),
                      F.when(F.col(cols[1]) == "x", F.lit(None)).otherwise(F.col(cols[1])).alias("target_category"),
                      (F.coalesce(F.col(cols[2]), F.lit("")) == "?").alias("uncertain"))


# --- S17: vote log lines ------------------------------------------------------------------------

def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Vote-log lines as a ``value`` column."""
    return spark.read.text(path)
