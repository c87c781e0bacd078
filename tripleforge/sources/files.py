"""Scans of the files that graphs and their tables come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file patterns of each kind of input.
LAYOUTS = {"movie_html": "tt*/movie_html/tt*.html", "movie_graph": "tt*/movie_html/tt*.ttl", "soundtrack_graph": "tt*/movie_soundtrack/*_soundtrack.ttl", "soundtrack_links": "tt*/movie_soundtrack/soundtrack_links.json", "actor_html": "nm*/actor.html", "actor_graph": "nm*/nm*.ttl"}


def whole_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, size, text) of the files below ``path`` whose name matches; one row per file."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))


def layout_files(spark: SparkSession, root: str, layout: str) -> DataFrame:
    """Files of one of the known layouts below ``root``, or below it as the directory of a single entity."""
    whole = spark.read.option("wholetext", True)
    pattern = LAYOUTS[layout]
    single = root.rstrip("/").rsplit("/", 1)[-1][:2] in ("tt", "nm") and root.rstrip("/")[-1].isdigit()
    files = whole.text(f"{root.rstrip('/')}/{pattern.split('/', 1)[1] if single else pattern}")
    return files.select(F.col("_metadata.file_path").alias("path"), entity_id(F.col("_metadata.file_path")).alias("g"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))


def entity_id(path: Column) -> Column:
    """The entity id in a path: the name of a directory, else of the file."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"/((?:tt|nm)\d+)/", 1), F.lit("")), F.nullif(F.regexp_extract(path, r"((?:tt|nm)\d+)[^/]*$", 1), F.lit("")))


def listed_entities(files: DataFrame, prefix: str = "tt") -> DataFrame:
    """(g): the entities of a listing of files (column path), by the directories in their paths whose whole name is the prefix
    and digits; other directories are left out."""
    found = F.regexp_extract_all("path", F.lit(f"(?<=/)({prefix}[0-9]+)(?=/)"), F.lit(1))
    return files.select(F.explode(found).alias("g")).distinct()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of text files; a missing path gives no lines."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    if not found:
        return spark.createDataFrame([], "path string, line string")
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV file with header, all columns as text; fails if one of ``required`` is missing; rows in which one of them is
    blank are left out."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    for c in required:
        df = df.where(F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return df


def read_json_arrays(files: DataFrame, text: str, schema: str) -> DataFrame:
    """Rows of JSON arrays held in a text column, with the file's other columns; text that is no array gives none."""
    parsed = F.from_json(F.col(text), f"array<{schema}>")
    return files.select(*[c for c in files.columns if c != text], F.explode(parsed).alias("_r")).where("_r is not null").select("*", "_r.*").drop("_r")


def qa_entries(files: DataFrame, text: str) -> DataFrame:
    """(movie_id, question, pos, url, caption) of question-and-answer documents; entries of fewer than two parts are
    left out."""
    parsed = F.from_json(F.col(text), "map<string, map<string, struct<html: array<array<string>>>>>")
    movies = files.select(F.explode(parsed).alias("movie_id", "questions"))
    rows = movies.select("movie_id", F.explode("questions").alias("question", "answer"))
    entries = rows.select("movie_id", "question", F.posexplode("answer.html").alias("pos", "e")).where(F.size("e") >= 2)
    return entries.select("movie_id", "question", "pos", F.col("e")[0].alias("url"), F.col("e")[1].alias("caption"))


def remove_first_entries(entries: DataFrame, removed: DataFrame) -> DataFrame:
    """Entries without the first one of each (movie_id, url, caption) in ``removed``."""
    keys = ["movie_id", "url", "caption"]
    first = entries.join(removed.select(*keys).distinct(), keys).groupBy(*keys).agg(F.min(F.struct("question", "pos")).alias("_f")).select(*keys, "_f.*")
    return entries.join(first, [*keys, "question", "pos"], "left_anti")


def setting_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small settings file without blanks and comments; fails if there are none."""
    rows = read_lines(spark, path).limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError(f"{path} has more than 100,000 lines, which are no settings")
    lines = [r["line"].strip() for r in rows]
    kept = [x for x in lines if x and not x.startswith("#")]
    if not kept:
        raise ValueError(f"{path} holds no settings")
    return kept
