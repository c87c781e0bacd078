"""Writers: graphs as N-Triples, tables as CSV or JSON, workbooks as folders of sheets, error logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleforge.operators.store import to_ntriples


def write_graph(triples: DataFrame, path: str, verify: bool = True) -> int:
    """Distinct triples as N-Triples (which is Turtle) in one folder; reads them back and counts unless told not to."""
    lines = to_ntriples(triples).distinct()
    lines.write.mode("overwrite").text(path)
    if not verify:
        return -1
    from tripleforge.sources.turtle import turtle_triples

    back = triples.sparkSession.read.text(path).select(F.monotonically_increasing_id().cast("string").alias("line"), "value")
    bad = turtle_triples(back, "line", "value").where("error is not null").count()
    if bad:
        raise RuntimeError(f"{bad} lines of {path} cannot be read back")
    return triples.sparkSession.read.text(path).count()


def write_table(df: DataFrame, path: str, decimals: dict[str, int] | None = None) -> None:
    """CSV with header; nulls are empty, and the columns in ``decimals`` have that many places."""
    columns = [F.format_string(f"%.{decimals[c]}f", F.col(c)).alias(c) if c in (decimals or {}) else F.col(c).cast("string").alias(c) for c in df.columns]
    df.select(*[F.coalesce(c, F.lit("")).alias(n) for c, n in zip(columns, df.columns, strict=True)]).write.mode("overwrite").options(header=True, emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def result_rows(results: DataFrame) -> DataFrame:
    """Link results in the layout of twelve columns in which they are exchanged.

    ``results``: title, performer, composer, movie_title, search_query, url, video_title, channel_title, confidence,
    view_count, like_count, error. Nulls become empty texts, the confidence has two places.
    """
    confidence = F.format_string("%.2f", F.col("confidence"))
    columns = {
        "Song Title": F.col("title"), "Performer": F.col("performer"), "Composer": F.col("composer"), "Movie": F.col("movie_title"), "Search Query": F.col("search_query"),
        "YouTube URL": F.col("url"), "Video Title": F.col("video_title"), "Channel": F.col("channel_title"), "Confidence": F.when(F.col("confidence").isNotNull(), confidence),
        "Views": F.col("view_count").cast("string"), "Likes": F.col("like_count").cast("string"), "Error": F.col("error"),
    }
    return results.select(*[F.coalesce(c, F.lit("")).alias(name) for name, c in columns.items()])


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document per row; fields that are null are left out."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """Each sheet as a CSV table in a folder of its name."""
    for name, df in sheets.items():
        write_table(df, f"{path.rstrip('/')}/{name}")


def write_errors(failures: DataFrame, path: str, where: str = "path", message: str = "error") -> None:
    """``path: message`` per line."""
    failures.select(F.concat_ws(": ", where, message).alias("value")).write.mode("overwrite").text(path)


def write_increment(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the table at ``path`` lacks, so that a repeated run changes nothing; their number."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    new = df.join(spark.read.parquet(path).select(key), key, "left_anti").select(*df.columns) if there else df
    from tripleforge.runtime import materialize

    new = materialize(new, "increment")
    new.write.mode("append").parquet(path)
    return new.count()
