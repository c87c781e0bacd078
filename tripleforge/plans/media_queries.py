"""Queries over soundtracks, videos, comments and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleforge.operators import media
from tripleforge.operators.store import as_graph, lift
from tripleforge.runtime import load

EX = "http://example.org/"


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "soundtrack_tracks").dropDuplicates(["track_id"]).where("title is not null and movie_id is not null")


def _soundtracks(spark: SparkSession, d: str) -> DataFrame:
    """The tracks as graphs, one per movie."""
    tracks, g = _tracks(spark, d), F.col("movie_id")
    at = lambda kind, c: F.concat(F.lit(f"{EX}{kind}/"), F.col(c))
    people = None
    for c in ("performer", "composer", "lyrics_by", "producer"):
        one = lift(tracks.where(F.col(c).isNotNull()), g, at("person", c), {"schema:name": c})
        people = one if people is None else people.union(one)
    movies = lift(tracks, g, F.concat(F.lit(f"{EX}title/"), g), {"schema:audio": at("recording", "track_id")}, None, ("schema:audio",))
    recordings = lift(tracks, g, at("recording", "track_id"), {"schema:name": "title", "schema:byArtist": at("person", "performer"), "schema:producer": at("person", "producer"), "schema:recordingOf": at("work", "track_id")}, "schema:MusicRecording", ("schema:byArtist", "schema:producer", "schema:recordingOf"))
    works = lift(tracks, g, at("work", "track_id"), {"schema:composer": at("person", "composer"), "schema:lyricist": at("person", "lyrics_by")}, "schema:MusicComposition", ("schema:composer", "schema:lyricist"))
    return as_graph(people.union(movies).union(recordings).union(works))


def soundtrack_records(spark: SparkSession, d: str) -> DataFrame:
    out = media.soundtrack_records(_soundtracks(spark, d))
    return out.select(F.substring_index("recording", "/", -1).cast("long").alias("track_id"), "title", "performer", "composer", "lyrics_by", "producer")


def soundtrack_statistics(spark: SparkSession, d: str) -> DataFrame:
    out = media.soundtrack_statistics(_soundtracks(spark, d))
    return out.select(F.col("g").alias("movie_id"), "n_recordings", "n_compositions", "n_performers", "n_producers", "n_composers", "n_lyricists", "performers")


def _injected_all(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two links for every track: one of its own title, and one of a title that no recording has."""
    links = _tracks(spark, d).select(F.col("movie_id").alias("g"), F.upper("title").alias("title"), F.concat(F.lit("v/"), "track_id").alias("url"), F.col("track_id").alias("pos"))
    return media.inject_urls(_soundtracks(spark, d), links.union(links.withColumn("title", F.concat(F.lit("no such "), "title"))))


def injected_urls_all(spark: SparkSession, d: str) -> DataFrame:
    done = _injected_all(spark, d)[0].where(F.col("p") == "http://schema.org/url")
    return done.select(F.substring_index("s", "/", -1).cast("long").alias("track_id"), F.col("o").alias("url"))


def injected_unmatched_all(spark: SparkSession, d: str) -> DataFrame:
    return _injected_all(spark, d)[1].select(F.col("g").alias("movie_id"), "key", "url")


def video_comments(spark: SparkSession, d: str) -> DataFrame:
    videos = load(spark, d, "youtube_videos").select("video_id").distinct()
    comments = load(spark, d, "youtube_comments").select("video_id", "comment_id", "like_count").distinct()
    out = media.with_comments(videos, comments, "video_id", [F.desc_nulls_last("like_count"), F.col("comment_id")], 3)
    return out.select("video_id", F.size("comments").alias("n"), F.array_join(F.transform("comments", lambda c: c.comment_id.cast("string")), " ").alias("ids"))


def file_statistics(spark: SparkSession, d: str) -> DataFrame:
    return media.file_statistics(load(spark, d, "ttl_files"), "file_id", "content")


QUERIES = {f.__name__: f for f in (soundtrack_records, soundtrack_statistics, injected_urls_all, injected_unmatched_all, video_comments, file_statistics)}

_T = "t AS (SELECT DISTINCT track_id, movie_id, title, performer, composer, lyrics_by, producer FROM soundtrack_tracks WHERE title IS NOT NULL AND movie_id IS NOT NULL)"
_L = _T + r""", l AS (SELECT movie_id, lower(trim(upper(title), E' \t\r\n')) AS key, 'v/' || track_id AS url, track_id AS pos FROM t WHERE track_id % 2 = 0
  UNION ALL SELECT movie_id, lower(trim('no such ' || upper(title), E' \t\r\n')), 'v/' || track_id, track_id FROM t WHERE track_id % 10 = 0),
f AS (SELECT DISTINCT ON (movie_id, key) movie_id, key, url FROM l ORDER BY movie_id, key, pos DESC), n AS (SELECT track_id, movie_id, lower(trim(title, E' \t\r\n')) AS key FROM t)"""
_LA = _T + r""", l AS (SELECT movie_id, lower(trim(upper(title), E' \t\r\n')) AS key, 'v/' || track_id AS url, track_id AS pos FROM t
  UNION ALL SELECT movie_id, lower(trim('no such ' || upper(title), E' \t\r\n')), 'v/' || track_id, track_id FROM t),
f AS (SELECT DISTINCT ON (movie_id, key) movie_id, key, url FROM l ORDER BY movie_id, key, pos DESC), n AS (SELECT track_id, movie_id, lower(trim(title, E' \t\r\n')) AS key FROM t)"""
ORACLES = {
    "soundtrack_records": f"WITH {_T} SELECT track_id, title, performer, composer, lyrics_by, producer FROM t",
    "soundtrack_statistics": f"""WITH {_T}, n AS (SELECT movie_id, performer, row_number() OVER (PARTITION BY movie_id ORDER BY performer) AS i FROM (SELECT DISTINCT movie_id, performer FROM t WHERE performer IS NOT NULL)),
p AS (SELECT movie_id, string_agg(performer, '; ' ORDER BY performer) FILTER (i <= 10) || CASE WHEN max(i) > 10 THEN '...' ELSE '' END AS performers FROM n GROUP BY 1)
SELECT movie_id, count(DISTINCT track_id) AS n_recordings, count(DISTINCT track_id) AS n_compositions, count(DISTINCT performer) AS n_performers, count(DISTINCT producer) AS n_producers, count(DISTINCT composer) AS n_composers, count(DISTINCT lyrics_by) AS n_lyricists, any_value(performers) AS performers FROM t LEFT JOIN p USING (movie_id) GROUP BY 1""",
    "injected_urls_all": f"WITH {_LA} SELECT track_id, url FROM n JOIN f USING (movie_id, key)",
    "injected_unmatched_all": f"WITH {_LA} SELECT movie_id, key, url FROM f WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.movie_id = f.movie_id AND n.key = f.key)",
    "video_comments": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY like_count DESC NULLS LAST, comment_id) AS i FROM (SELECT DISTINCT video_id, comment_id, like_count FROM youtube_comments))
SELECT video_id, CAST(count(comment_id) AS INTEGER) AS n, coalesce(string_agg(CAST(comment_id AS VARCHAR), ' ' ORDER BY i), '') AS ids FROM (SELECT DISTINCT video_id FROM youtube_videos) LEFT JOIN (SELECT * FROM c WHERE i <= 3) USING (video_id) GROUP BY 1""",
    "file_statistics": r"SELECT file_id, CAST(strlen(coalesce(content, '')) AS INTEGER) AS n_bytes, CAST(length(coalesce(content, '')) - length(replace(coalesce(content, ''), E'\n', '')) + CASE WHEN coalesce(content, '') <> '' AND NOT ends_with(content, E'\n') THEN 1 ELSE 0 END AS INTEGER) AS n_lines FROM ttl_files",
}
