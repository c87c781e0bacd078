"""Queries over the finer points: standard modalities, credit lines, labels, result tables, and files written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleforge.functions import markup, text
from tripleforge.operators import comparison, linking, media, profile, statistics
from tripleforge.operators.credits import parse_credit_lines
from tripleforge.operators.store import expand_column, lift
from tripleforge.plans.graph_queries import EX, _all, _iri, _key, _lifted
from tripleforge.plans.media_queries import _soundtracks, _tracks
from tripleforge.runtime import load, scratch_path
from tripleforge.sources import files, sinks
from tripleforge.sources.turtle import read_turtle
from tripleforge.streaming.ingest import windowed_counts


def _standard(spark: SparkSession, d: str) -> DataFrame:
    counts = profile.lexical_counts(load(spark, d, "ttl_files"), "movie_id", "content")
    return profile.modality_rows(load(spark, d, "movies").select("movie_id"), counts, "movie_id")


def modality_standard(spark: SparkSession, d: str) -> DataFrame:
    return _standard(spark, d)


def modality_standard_summary(spark: SparkSession, d: str) -> DataFrame:
    return profile.modality_summary(_standard(spark, d), ["text", "image", "video"])


def audio_clips(spark: SparkSession, d: str) -> DataFrame:
    """Audio counts from a JSON list of link results per movie, beside the movies that have none."""
    match = F.when(F.col("performer").isNotNull(), F.struct(F.concat(F.lit("v/"), "track_id").alias("url")))
    lists = _tracks(spark, d).groupBy("movie_id").agg(F.to_json(F.collect_list(F.struct("track_id", match.alias("best_match")))).alias("json"))
    audio = profile.audio_counts(lists, "movie_id", "json")
    return profile.with_audio(load(spark, d, "movies").select("movie_id").distinct(), audio, "movie_id")


def credit_phrase_counts(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of the form "X by" in all documents and in credit lines of all tracks."""
    lines = load(spark, d, "soundtrack_tracks").select(F.concat_ws("; ", F.lit("Music by A"), F.concat(F.lit("additional Vocals by "), "performer"), F.concat(F.lit("Lyrics and Score by "), "lyrics_by")).alias("text"))
    texts = load(spark, d, "documents").select("text").union(lines)
    return texts.select(F.explode(text.credit_phrases(F.col("text"))).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))


def credit_lines(spark: SparkSession, d: str) -> DataFrame:
    """Credit blocks of all tracks, with lines of every kind, read back."""
    told = lambda start, c, end="": F.concat(F.lit(f"\n{start} "), F.col(c), F.lit(end))
    block = F.concat_ws(
        "", F.lit("Music by nobody yet\n"), F.trim("title"), told("Music by", "composer", " (as Someone)"), F.lit("\nby W"), told("Lyrics by", "lyrics_by", " & Partner"), told("Performed by", "performer", " and Arranged by Q"),
        F.lit("\nProduced by early bird"), told("Produced by", "producer"), F.when(F.col("is_traditional"), F.lit("\nArranged by a Traditional choir")), F.when(F.col("is_uncredited"), F.lit("\n(uncredited)")),
    )
    tracks = load(spark, d, "soundtrack_tracks").dropDuplicates(["track_id"]).where("title is not null")
    out = parse_credit_lines(tracks.select("track_id", block.alias("text")), "track_id", "text")
    return out.drop("track")


def role_counts_of_type(spark: SparkSession, d: str) -> DataFrame:
    """Performers and producers of recordings; other subjects with such roles do not count."""
    album = lift(_tracks(spark, d), F.col("movie_id"), F.concat(F.lit(f"{EX}album/"), "movie_id"), {"schema:byArtist": F.lit("an orchestra")}, "schema:MusicAlbum")
    t = _soundtracks(spark, d).union(album)
    return statistics.role_counts(t, {"n_performers": "schema:byArtist", "n_producers": "schema:producer"}, "schema:MusicRecording").withColumnRenamed("g", "movie_id")


def author_roles(spark: SparkSession, d: str) -> DataFrame:
    """Authors are composers of works without one, else lyricists of works without one."""
    composer = F.when(~F.coalesce("is_uncredited", F.lit(False)), F.col("composer"))
    t = lift(_tracks(spark, d), F.col("movie_id"), F.concat(F.lit("w/"), "track_id"), {"schema:composer": composer, "schema:lyricist": "lyrics_by", "schema:author": "performer"})
    out = statistics.composition_credits(t)
    return out.select(F.substring_index("work", "/", -1).cast("long").alias("track_id"), F.array_join("composer", "; ").alias("composer"), F.array_join("lyricist", "; ").alias("lyricist"))


def links_of_any_form(spark: SparkSession, d: str) -> DataFrame:
    videos = load(spark, d, "youtube_videos").select("video_id", "url", "description", "channel_title").distinct()
    there = text.has_link(F.when(F.col("description").isNotNull(), F.col("url")), F.when(F.col("channel_title").startswith("C"), F.col("video_id")))
    return videos.select("video_id", there.alias("has_link")).distinct()


def label_categories(spark: SparkSession, d: str) -> DataFrame:
    """Compound credit labels of the tracks, taken apart into roles with their category."""
    word = lambda c, w: F.when(F.col(c).isNotNull(), F.lit(w))
    labels = load(spark, d, "soundtrack_tracks").select(F.concat(F.concat_ws(" and ", word("performer", "Performed"), word("composer", "Written"), word("producer", "Mixed")), F.lit("  by: x")).alias("label"))
    known = spark.createDataFrame([("performed", "performer"), ("written", "composer")], "role string, category string")
    return profile.label_categories(labels, "label", known)


def original_triples(spark: SparkSession, d: str) -> DataFrame:
    """Normalised prices with the triples they come from."""
    t = lift(load(spark, d, "part").withColumn("price", F.col("p_retailprice").cast("decimal(12,3)")), _all(), _iri("part", "p_partkey"), {EX + "price": "price"})
    return comparison.originals(t).select(_key("s").alias("p_partkey"), F.substring_index("o", "|", 1).alias("price"), F.col("original_o").alias("original"))


def paired_graphs(spark: SparkSession, d: str) -> DataFrame:
    tracks = load(spark, d, "soundtrack_tracks").where("movie_id is not null")
    return linking.paired_graphs(load(spark, d, "movies"), tracks, "movie_id")


def sameas_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "persons").select("url", F.when(F.col("birth_place").isNotNull(), F.col("person_id")).alias("external"))
    return linking.same_as_counts(rows, "url", "external")


def resumed_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Tracks by their place in the movie, from the second on where a movie has a rating, else from the first."""
    tracks = load(spark, d, "soundtrack_tracks").select("movie_id", "track_id").distinct().where("movie_id is not null")
    start = load(spark, d, "movies").where("content_rating is not null").select("movie_id", F.lit(1).alias("start")).distinct()
    return linking.numbered_tracks(tracks, "movie_id", ["track_id"], start)


def candidate_texts(spark: SparkSession, d: str) -> DataFrame:
    videos = load(spark, d, "youtube_videos").select("video_id", "title", "channel_title", "description").distinct()
    comments = F.array(F.struct(F.lit("a").alias("author"), F.coalesce("description", F.lit("")).alias("text")))
    return videos.select("video_id", text.candidate_text(F.col("title"), F.col("channel_title"), F.col("description"), comments, description_width=40).alias("text"))


def iso_times(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", text.iso_text(F.col("o_orderdate")).alias("at"))


def typed_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a JSON list, or a single entry, that are persons, whether their type is one name or a list."""
    person = lambda name, kind: F.concat(F.lit('{"@type":' + kind + ',"name":"'), F.col(name), F.lit('"}'))
    many = F.concat(F.lit('{"actor":['), person("s_name", '"Person"'), F.lit(","), person("s_name", '["Thing","Person"]'), F.lit(","), person("s_name", '"Organization"'), F.lit("]}"))
    single = F.concat(F.lit('{"actor":'), person("s_name", '"Person"'), F.lit("}"))
    document = F.try_parse_json(F.when(F.col("s_acctbal") > 0, many).otherwise(single))
    return load(spark, d, "supplier").select("s_suppkey", F.size(markup.of_type(document, "$.actor", "Person")).alias("n_persons"))


def first_subjects(spark: SparkSession, d: str) -> DataFrame:
    """One region, and one literal and one node of each nation."""
    t = _lifted(spark, d, "region", "nation")
    region = statistics.first_of_type(t, f"{EX}Region").select(F.lit("region").alias("kind"), F.col("s").alias("node"), F.lit(None).cast("string").alias("value"))
    literal = statistics.first_object(t, f"{EX}name", True).select(F.lit("literal"), "s", "value")
    node = statistics.first_object(t, f"{EX}inRegion", False).select(F.lit("node"), "s", "value")
    return region.union(literal).union(node)


def listed_entities(spark: SparkSession, d: str) -> DataFrame:
    paths = load(spark, d, "movies").select(F.concat(F.lit("/data/movies/"), "movie_id", F.lit("/movie_html/x.ttl")).alias("path"))
    return files.listed_entities(paths)


def result_table_file(spark: SparkSession, d: str) -> DataFrame:
    """Link results written in their layout of twelve columns and read again."""
    tracks = load(spark, d, "soundtrack_tracks").dropDuplicates(["track_id"]).where("trim(title) <> ''")
    none = F.lit(None).cast("string")
    results = tracks.select("title", "performer", "composer", "movie_title", F.col("track_id").cast("string").alias("search_query"), none.alias("url"), none.alias("video_title"), none.alias("channel_title"), (F.col("track_id") % 100 / 100).alias("confidence"), F.col("track_id").alias("view_count"), F.lit(0).alias("like_count"), F.when(F.col("performer").isNull(), F.lit("none")).alias("error"))
    path = scratch_path(spark, "results")
    sinks.write_table(sinks.result_rows(results), path)
    back = files.read_csv(spark, path, ["Song Title", "Search Query"])
    return back.select(*[F.coalesce(f"`{c}`", F.lit("")).alias(c.lower().replace(" ", "_")) for c in back.columns])


def workbook_file(spark: SparkSession, d: str) -> DataFrame:
    """A workbook of two sheets, one of them read again."""
    path = scratch_path(spark, "workbook")
    sinks.write_workbook({"suppliers": load(spark, d, "supplier"), "nations": load(spark, d, "nation")}, path)
    return files.read_csv(spark, f"{path}/suppliers", ["s_suppkey"]).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))


def json_file(spark: SparkSession, d: str) -> DataFrame:
    """Reviews written as JSON documents, one per line, and read again as lists of one."""
    path = scratch_path(spark, "documents")
    sinks.write_documents(load(spark, d, "reviews").select("review_id", "review_body", "source").distinct(), path)
    lists = files.read_lines(spark, path).select(F.concat(F.lit("["), "line", F.lit("]")).alias("text"))
    return files.read_json_arrays(lists, "text", "struct<review_id: bigint, review_body: string, source: string>")


def html_files(spark: SparkSession, d: str) -> DataFrame:
    """A page per nation, each in its own file, and what its elements say."""
    path = scratch_path(spark, "pages")
    page = F.concat(F.lit("<html><body><h1>"), "n_name", F.lit("</h1><ul><li class='r'>"), F.col("n_regionkey").cast("string"), F.lit("</li></ul></body></html>"))
    load(spark, d, "nation").select(page.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    pages = files.whole_files(spark, path, "*.txt").where("text <> ''")
    said = lambda name, **kw: markup.extract(pages, "path", "text", **kw).select("path", F.col("value").alias(name))
    return said("name", tag="h1").join(said("region", tag="li", css_class="r"), "path").select("name", "region")


def graph_files(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers written as a graph and read again as Turtle files."""
    path = scratch_path(spark, "graph")
    sinks.write_graph(_lifted(spark, d, "supplier"), path)
    back = read_turtle(spark, path, "*.txt").where(F.col("p") == f"{EX}balance")
    return back.select(_key("s").alias("s_suppkey"), F.col("o").cast("double").alias("s_acctbal"))


def error_log_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "errors")
    failures = load(spark, d, "movies").where("abstract is null").select(F.col("movie_id").alias("path"), F.lit("no abstract").alias("error")).distinct()
    sinks.write_errors(failures, path)
    return files.read_lines(spark, path).select("line")


def caption_entities(spark: SparkSession, d: str) -> DataFrame:
    """Pictures and the people of the same movie whose name their caption contains."""
    tracks = _tracks(spark, d)
    person = F.concat(F.lit(f"{EX}person/"), "performer")
    pictures = lift(tracks, F.col("movie_id"), F.concat(F.lit(f"{EX}image/"), "track_id"), {"schema:caption": F.concat("title", F.lit(" with "), "performer")})
    people = lift(tracks.where("performer is not null"), F.col("movie_id"), person, {"schema:name": "performer"})
    actors = lift(tracks, F.col("movie_id"), F.concat(F.lit(f"{EX}title/"), "movie_id"), {"schema:actor": person}, None, ("schema:actor",))
    found = media.main_entities(pictures.union(people).union(actors))
    return found.select(F.col("g").alias("movie_id"), F.substring_index("image", "/", -1).cast("long").alias("track_id"), F.regexp_replace("person", "^.*?/person/", "").alias("name"))


def property_triples(spark: SparkSession, d: str) -> DataFrame:
    """Triples per property and nodes per type, by local name."""
    persons = load(spark, d, "persons").select("person_id", "url", "name", "job_title").distinct()
    t = lift(persons, F.lit("all"), F.col("url"), {"schema:name": "name", "schema:jobTitle": "job_title"}, "schema:Person")
    return profile.triple_counts(t).select("property", "n")


def subject_lines(spark: SparkSession, d: str) -> DataFrame:
    """The properties of each nation in one list."""
    t = _lifted(spark, d, "nation")
    out = comparison.grouped_by_subject(t.where(F.col("o_kind") == "L"))
    return out.select(_key("s").alias("n_nationkey"), "n", F.array_join("lines", "; ").alias("lines"))


def text_details(spark: SparkSession, d: str) -> DataFrame:
    """Scalar functions on the texts of all tracks."""
    tracks = load(spark, d, "soundtrack_tracks").dropDuplicates(["track_id"])
    info = F.coalesce("additional_info", F.concat(F.lit("Take 2. Then, "), F.col("title")))
    return tracks.select(
        "track_id", text.without_rank(F.concat((F.col("track_id") % 50).cast("string"), F.lit(".  x "), "title")).alias("unranked"), text.digits(info).alias("digits"), text.after_first_sentence(info).alias("abstract"),
        text.spaced_commas(F.concat_ws(",  ", "performer", "composer")).alias("names"), text.unescape(F.concat(F.lit('\\"'), "track_id", F.lit("\\\\"))).alias("plain"), text.one_line(F.concat(F.lit(" a\nb  "), F.col("track_id").cast("string"))).alias("line"),
        text.comment_text(F.when(F.col("performer").isNull(), F.lit("none")), F.col("composer"), F.array(F.lit("a"), F.lit("b"))).alias("comment"),
    )


def expanded_names(spark: SparkSession, d: str) -> DataFrame:
    """Prefixed names in a column as IRIs; other texts stay."""
    short = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("schema:size"), "p_size")).otherwise(F.concat(F.lit("http://x/y:"), "p_size"))
    return load(spark, d, "part").select("p_partkey", expand_column(short).alias("iri"))


def events_per_hour(spark: SparkSession, d: str) -> DataFrame:
    """Events per kind and hour, by the operator that counts a stream."""
    return windowed_counts(load(spark, d, "events"), "ts", "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        modality_standard, modality_standard_summary, audio_clips, credit_phrase_counts, credit_lines, role_counts_of_type, author_roles, links_of_any_form, label_categories, original_triples, paired_graphs, sameas_counts,
        resumed_tracks, candidate_texts, iso_times, typed_entries, first_subjects, listed_entities, result_table_file, workbook_file, json_file, html_files, graph_files, error_log_file, caption_entities, property_triples, subject_lines, text_details, expanded_names, events_per_hour,
    )
}

_PARTS = [(m, p) for m, ps in profile.MODALITIES.items() for p in ps]
_TOTALS = {m: " + ".join(f'"{m}_{p}"' for p in ps) for m, ps in profile.MODALITIES.items()}
_STANDARD = f"""WITH c AS (SELECT movie_id, unnest(regexp_extract_all(content, 'schema1?:([A-Za-z0-9_]+)', 1)) AS p FROM ttl_files),
w AS (SELECT movie_id, {', '.join(f"count(*) FILTER (p = '{p}') AS \"{m}_{p}\"" for m, p in _PARTS)} FROM c GROUP BY 1),
m AS (SELECT movie_id, {', '.join(f'coalesce("{m}_{p}", 0) AS "{m}_{p}"' for m, p in _PARTS)} FROM (SELECT DISTINCT movie_id FROM movies) LEFT JOIN w USING (movie_id)),
r AS (SELECT *, {', '.join(f'{t} AS {m}_total, {t} > 0 AS has_{m}' for m, t in _TOTALS.items())} FROM m)
"""
_TRACKS = "t AS (SELECT DISTINCT ON (track_id) * FROM soundtrack_tracks WHERE title IS NOT NULL AND movie_id IS NOT NULL ORDER BY track_id)"
#: As CREDIT_PHRASES, in the dialect of the database.
_PHRASES = ["Music", "Lyrics", "Written", "Performed", "Produced", "Arranged", "Conducted", "Orchestrated", "Sung", "Vocals", "Composed", "Score", "Words", "Mixed", "Engineered", "Remixed", "Programming", r"Additional[\p{L}\p{M}\p{N}_\s]+", r"[\p{L}\p{M}\p{N}_\s]+"]
_NAME = r"trim(regexp_replace({0}, '(\s+and|\s*&).*$', ''), E' \t\r\n')"

ORACLES = {
    "modality_standard": _STANDARD + "SELECT * FROM r",
    "modality_standard_summary": _STANDARD + " UNION ALL ".join(f"SELECT '{m}' AS modality, count(*) AS n_entities, count(*) FILTER (has_{m}) AS n_with, round(100 * count(*) FILTER (has_{m}) / count(*), 4) AS pct_with, round(avg({m}_total), 4) AS mean_total FROM r" for m in profile.MODALITIES),
    "audio_clips": f"WITH {_TRACKS}, a AS (SELECT movie_id, count(performer) AS linked, count(*) AS n FROM t GROUP BY 1) SELECT movie_id, coalesce(linked, 0) AS audio_clips_with_links, coalesce(n, 0) AS audio_soundtracks_total, coalesce(n, 0) > 0 AS has_audio FROM (SELECT DISTINCT movie_id FROM movies) LEFT JOIN a USING (movie_id)",
    "credit_phrase_counts": "WITH x AS (SELECT text FROM documents UNION ALL SELECT concat_ws('; ', 'Music by A', 'additional Vocals by ' || performer, 'Lyrics and Score by ' || lyrics_by) FROM soundtrack_tracks) SELECT phrase, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT unnest(regexp_extract_all(text, '(?i){p} by')) AS phrase FROM x" for p in _PHRASES) + ") GROUP BY 1",
    "credit_lines": f"""WITH t AS (SELECT DISTINCT ON (track_id) * FROM soundtrack_tracks WHERE title IS NOT NULL ORDER BY track_id)
SELECT track_id, trim(title, E' \\t\\r\\n') AS title, coalesce({_NAME.format('composer')}, 'W') AS composer, {_NAME.format('lyrics_by')} AS lyrics_by, 'by ' || {_NAME.format('performer')} AS performer,
  'by ' || coalesce({_NAME.format('producer')}, 'early bird') AS producer, nullif(concat_ws(' ', CASE WHEN composer IS NOT NULL THEN 'by W' END, CASE WHEN is_traditional THEN 'Arranged by a Traditional choir' END, CASE WHEN is_uncredited THEN '(uncredited)' END), '') AS additional_info, is_traditional, is_uncredited FROM t""",
    "role_counts_of_type": f"WITH {_TRACKS} SELECT movie_id, count(DISTINCT performer) AS n_performers, count(DISTINCT producer) AS n_producers FROM t GROUP BY 1 HAVING count(performer) + count(producer) > 0",
    "author_roles": f"""WITH {_TRACKS}, c AS (SELECT track_id, CASE WHEN NOT coalesce(is_uncredited, false) THEN composer END AS c, lyrics_by AS l, performer AS a FROM t)
SELECT track_id, coalesce(c, a, '') AS composer, coalesce(l, CASE WHEN c IS NOT NULL THEN a END, '') AS lyricist FROM c WHERE c IS NOT NULL OR l IS NOT NULL OR a IS NOT NULL""",
    "links_of_any_form": "SELECT DISTINCT video_id, (description IS NOT NULL AND coalesce(url, '') <> '') OR (coalesce(channel_title, '') LIKE 'C%' AND video_id <> '') AS has_link FROM youtube_videos",
    "label_categories": """WITH l AS (SELECT DISTINCT list_filter([CASE WHEN performer IS NOT NULL THEN 'Performed' END, CASE WHEN composer IS NOT NULL THEN 'Written' END, CASE WHEN producer IS NOT NULL THEN 'Mixed' END], lambda x: x IS NOT NULL) AS r FROM soundtrack_tracks),
e AS (SELECT array_to_string(r, ' and ') || '  by: x' AS label, lower(unnest(CASE WHEN len(r) = 0 THEN ['by'] ELSE r END)) AS role, len(r) > 1 AS is_compound FROM l)
SELECT label, role, CASE role WHEN 'performed' THEN 'performer' WHEN 'written' THEN 'composer' END AS category, role IN ('performed', 'written') AS matched, is_compound FROM e""",
    "original_triples": r"SELECT p_partkey, regexp_replace(regexp_replace(v, '(\.[0-9]*?)0+$', '\1'), '\.$', '') AS price, v AS original FROM (SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12,3)) AS VARCHAR) AS v FROM part)",
    "paired_graphs": "SELECT movie_id, CASE WHEN m IS NULL THEN 'movie graph not found' WHEN s IS NULL THEN 'soundtrack graph not found' END AS error FROM (SELECT DISTINCT movie_id, 1 AS m FROM movies) FULL JOIN (SELECT DISTINCT movie_id, 1 AS s FROM soundtrack_tracks WHERE movie_id IS NOT NULL) USING (movie_id)",
    "sameas_counts": "SELECT count(*) FILTER (coalesce(trim(url), '') <> '' AND birth_place IS NOT NULL) AS n_processed, count(*) FILTER (NOT (coalesce(trim(url), '') <> '' AND birth_place IS NOT NULL)) AS n_skipped FROM persons",
    "resumed_tracks": "SELECT movie_id, track_id, CAST(n AS INTEGER) AS place FROM (SELECT movie_id, track_id, row_number() OVER (PARTITION BY movie_id ORDER BY track_id) - 1 AS n FROM (SELECT DISTINCT movie_id, track_id FROM soundtrack_tracks WHERE movie_id IS NOT NULL)) WHERE n >= CASE WHEN movie_id IN (SELECT movie_id FROM movies WHERE content_rating IS NOT NULL) THEN 1 ELSE 0 END",
    "candidate_texts": "SELECT DISTINCT video_id, concat_ws(E'\\n', 'Title: ' || nullif(title, ''), 'Channel: ' || nullif(channel_title, ''), 'Description: ' || nullif(left(description, 40), ''), '- a: ' || left(coalesce(description, ''), 80)) AS text FROM (SELECT DISTINCT video_id, title, channel_title, description FROM youtube_videos)",
    "iso_times": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS at FROM orders",
    "typed_entries": "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 2 ELSE 1 END AS n_persons FROM supplier",
    "first_subjects": f"SELECT 'region' AS kind, '{EX}region/' || min(CAST(r_regionkey AS VARCHAR)) AS node, NULL AS value FROM region UNION ALL SELECT 'literal', '{EX}region/' || r_regionkey, r_name FROM region UNION ALL SELECT 'literal', '{EX}nation/' || n_nationkey, n_name FROM nation UNION ALL SELECT 'node', '{EX}nation/' || n_nationkey, '{EX}region/' || n_regionkey FROM nation",
    "listed_entities": "SELECT DISTINCT movie_id AS g FROM movies WHERE regexp_full_match(movie_id, 'tt[0-9]+')",
    "result_table_file": "SELECT DISTINCT ON (track_id) title AS song_title, coalesce(performer, '') AS performer, coalesce(composer, '') AS composer, coalesce(movie_title, '') AS movie, CAST(track_id AS VARCHAR) AS search_query, '' AS youtube_url, '' AS video_title, '' AS channel, printf('%.2f', (track_id % 100) / 100) AS confidence, CAST(track_id AS VARCHAR) AS views, '0' AS likes, CASE WHEN performer IS NULL THEN 'none' ELSE '' END AS error FROM soundtrack_tracks WHERE trim(title) <> '' ORDER BY track_id",
    "caption_entities": f"WITH {_TRACKS}, a AS (SELECT DISTINCT movie_id, performer AS name FROM t WHERE performer IS NOT NULL) SELECT movie_id, track_id, name FROM t JOIN a USING (movie_id) WHERE contains(title || ' with ' || performer, name)",
    "property_triples": "WITH p AS (SELECT DISTINCT person_id, url, name, job_title FROM persons WHERE url IS NOT NULL) SELECT 'name' AS property, count(name) AS n FROM p UNION ALL SELECT 'jobTitle', count(*) FROM (SELECT unnest(job_title) AS j FROM p) WHERE j IS NOT NULL UNION ALL SELECT 'Person', count(*) FROM p",
    "subject_lines": f"SELECT n_nationkey, 1 AS n, '{EX}name ' || n_name AS lines FROM nation",
    "text_details": r"""WITH t AS (SELECT DISTINCT ON (track_id) *, coalesce(additional_info, 'Take 2. Then, ' || title) AS i FROM soundtrack_tracks ORDER BY track_id)
SELECT track_id, 'x ' || title AS unranked, regexp_replace(i, '[^0-9]', '', 'g') AS digits, CASE WHEN contains(i, '. ') THEN substr(i, strpos(i, '. ') + 2) ELSE i END AS abstract, regexp_replace(concat_ws(',  ', performer, composer), ',\s*', ', ', 'g') AS names,
  '"' || track_id || '\' AS plain, 'a b ' || track_id AS line, concat_ws(' | ', CASE WHEN performer IS NULL THEN 'Error: none' END, 'Reasoning: ' || nullif(composer, ''), 'Concerns: a; b') AS comment FROM t""",
    "expanded_names": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'http://schema.org/size' ELSE 'http://x/y:' END || p_size AS iri FROM part",
    "events_per_hour": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "workbook_file": "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
    "json_file": "SELECT DISTINCT review_id, review_body, source FROM reviews",
    "html_files": "SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation",
    "graph_files": "SELECT s_suppkey, s_acctbal FROM supplier",
    "error_log_file": "SELECT DISTINCT movie_id || ': no abstract' AS line FROM movies WHERE abstract IS NULL",
}
