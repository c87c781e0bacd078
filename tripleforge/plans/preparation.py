"""Queries for the general data-preparation operators: compaction, orphan references, packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleforge.operators.compaction import compact_files, equal_graphs, graph_catalogue, graph_classes, merge_graphs
from tripleforge.operators.multivalue import delimiter_scores, split_values
from tripleforge.operators.references import orphan_references, orphan_report, referenced_id
from tripleforge.runtime import load, scratch_path


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    return graph_catalogue(spark, load(spark, d, "ttl_files").select("file_id", F.col("ttl_file").alias("path"), "content"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of files that hold the same non-empty set of triples."""
    return equal_graphs(_catalogue(spark, d))


def p3_compacted(spark: SparkSession, d: str) -> DataFrame:
    """Report of consolidating all files: triples delivered, and distinct triples written and verified."""
    return merge_graphs(_catalogue(spark, d), scratch_path(spark, "graphs"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every file with its class of equal sets of triples."""
    return graph_classes(_catalogue(spark, d))


def p3_small_files(spark: SparkSession, d: str) -> DataFrame:
    """Report of consolidating tiny files: the deliveries, each written to a file of its own, read in combined splits."""
    files = load(spark, d, "ttl_files").select("file_id", "content")
    tiny, few = scratch_path(spark, "tiny"), scratch_path(spark, "few")
    files.write.option("maxRecordsPerFile", 1).parquet(tiny)
    done = compact_files(spark, tiny, few)
    back = spark.read.parquet(few)
    lost = files.exceptAll(back).agg(F.count("*").alias("n_lost"))
    counts = back.agg(F.count("*").alias("n_rows"), F.count_distinct("file_id").alias("n_distinct"))
    n_in = spark.read.parquet(tiny).select(F.input_file_name().alias("f")).distinct().agg(F.count("*").alias("n_files_in"))
    return n_in.join(counts).join(lost).withColumn("n_files_out", F.lit(done["output_files"]))


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    def of(table: str, key: str, iris: str) -> DataFrame:
        rows = load(spark, d, table).select(F.lit(table).alias("source_table"), F.col(key).alias("source_id"), F.explode(iris).alias("iri"), F.col("extracted_at").alias("at"))
        return rows.select("source_table", "source_id", referenced_id(F.col("iri")).alias("target_id"), "at")

    movies = load(spark, d, "movies")
    parents = movies.select(F.col("movie_id").alias("id"), F.col("extracted_at").alias("appeared"), F.col("deleted_at").alias("deleted"))
    return of("movies", "movie_id", "is_similar_to").union(of("persons", "person_id", "performer_in")), parents


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """References to movies that are missing, deleted by then, or extracted only later."""
    return orphan_references(*_references(spark, d)).select("source_table", "source_id", "target_id", "state").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per referring table, month and state."""
    report = orphan_report(orphan_references(*_references(spark, d)))
    return report.withColumn("period", F.date_format("period", "yyyy-MM"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The keywords of each movie with their positions."""
    movies = load(spark, d, "movies").where("movie_id is not null").groupBy("movie_id").agg(F.max_by("keywords", F.coalesce("loaded_at", F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00")))).alias("keywords"))
    return split_values(movies, "keywords", value="keyword").select("movie_id", "pos", "keyword")


def p6_delimiters(spark: SparkSession, d: str) -> DataFrame:
    """Evidence for each delimiter candidate of the packed keywords."""
    movies = load(spark, d, "movies").select(F.lit("movies").alias("source"), "keywords")
    return delimiter_scores(movies, "keywords", ["source"]).select("source", "delimiter", "n_rows", "n_pieces")


QUERIES = {f.__name__: f for f in (p3_found, p3_classes, p3_small_files, p3_compacted, p5_found, p5_report, p6_found, p6_delimiters)}

_ORPHANS = r"""
WITH parent AS (SELECT movie_id, min(extracted_at) AS e, min(deleted_at) AS x FROM movies GROUP BY movie_id),
named AS (
  SELECT 'movies' AS source_table, movie_id AS source_id, unnest(is_similar_to) AS iri, extracted_at AS t FROM movies
  UNION ALL SELECT 'persons', person_id, unnest(performer_in), extracted_at FROM persons),
refs AS (SELECT DISTINCT source_table, source_id, t, nullif(regexp_extract(iri, '(?:^|[^A-Za-z0-9])(tt[0-9]+)(?:$|[^A-Za-z0-9])', 1), '') AS target_id FROM named),
orphans AS (
  SELECT source_table, source_id, target_id, t,
    CASE WHEN parent.movie_id IS NULL THEN 'missing' WHEN x <= t THEN 'deleted' WHEN e > t THEN 'late' END AS state
  FROM refs LEFT JOIN parent ON target_id = movie_id WHERE target_id IS NOT NULL)
"""

ORACLES = {
    "p3_small_files": "SELECT count(*) AS n_files_in, count(*) AS n_rows, count(DISTINCT file_id) AS n_distinct, 0 AS n_lost, 1 AS n_files_out FROM ttl_files",
    "p5_found": _ORPHANS + "SELECT DISTINCT source_table, source_id, target_id, state FROM orphans WHERE state IS NOT NULL",
    "p5_report": _ORPHANS
    + """, seen AS (SELECT DISTINCT source_table, source_id, target_id, state, strftime(t, '%Y-%m') AS period FROM orphans WHERE state IS NOT NULL)
SELECT source_table, period, state, count(*) AS n_references, count(DISTINCT target_id) AS n_targets FROM seen GROUP BY ALL""",
    "p6_found": r"""
WITH one AS (SELECT movie_id, arg_max(keywords, loaded_at) AS packed FROM movies WHERE keywords IS NOT NULL GROUP BY movie_id),
piece AS (
  SELECT movie_id, unnest(list_transform(
    regexp_extract_all(packed, '(?:"[^"]*(?:""[^"]*)*"|“[^”]*”|\\[\s\S]|[^,;|/•\t\n"“\\]+|["“\\])+'),
    lambda x: trim(x, E' \t\r\n'))) AS p, generate_subscripts(regexp_extract_all(packed, '(?:"[^"]*(?:""[^"]*)*"|“[^”]*”|\\[\s\S]|[^,;|/•\t\n"“\\]+|["“\\])+'), 1) AS i
  FROM one),
bare AS (
  SELECT movie_id, i, CASE
    WHEN length(p) >= 2 AND p[1] = '"' AND p[-1] = '"' THEN trim(regexp_replace(replace(p[2:-2], '""', '"'), '\\([\s\S])', '\1', 'g'), E' \t\r\n')
    WHEN length(p) >= 2 AND p[1] = '“' AND p[-1] = '”' THEN trim(regexp_replace(p[2:-2], '\\([\s\S])', '\1', 'g'), E' \t\r\n')
    ELSE regexp_replace(p, '\\([\s\S])', '\1', 'g') END AS keyword FROM piece)
SELECT movie_id, CAST(row_number() OVER (PARTITION BY movie_id ORDER BY i) AS INTEGER) AS pos, keyword FROM bare WHERE keyword <> ''""",
}
