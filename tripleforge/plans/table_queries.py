"""Queries over texts and tables: profiles, rankings, scalar functions, JSON and HTML, links, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleforge.functions import markup, text
from tripleforge.operators import linking, profile, sampling, statistics
from tripleforge.operators.credits import parse_credits
from tripleforge.runtime import load, spread

def lexical_property_count(spark: SparkSession, d: str) -> DataFrame:
    counts = profile.lexical_counts(load(spark, d, "ttl_files"), "file_id", "content")
    return profile.ranked(counts.groupBy("property").agg(F.sum("n").cast("long").alias("n")), "n", "property")


def _modality(spark: SparkSession, d: str) -> DataFrame:
    files = load(spark, d, "ttl_files")
    shape = {"text": ["name", "abstract"], "date": ["datePublished"], "audio": ["audio", "byArtist"]}
    counts = profile.lexical_counts(files, "movie_id", "content")
    return profile.modality_rows(load(spark, d, "movies").select("movie_id"), counts, "movie_id", shape)


def modality_row(spark: SparkSession, d: str) -> DataFrame:
    return _modality(spark, d)


def modality_summary(spark: SparkSession, d: str) -> DataFrame:
    return profile.modality_summary(_modality(spark, d), ["text", "date", "audio"])


def modality_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return profile.property_breakdown(_modality(spark, d), "movie_id", ["text_name", "text_abstract", "date_datePublished", "audio_audio", "audio_byArtist"])


def category_rollup(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events").groupBy(F.col("event_type").alias("property")).agg(F.count("*").alias("n"))
    categories = spark.createDataFrame([("signup", "account"), ("purchase", "money"), ("click", "browse"), ("view", "browse"), ("error", "other")], "property string, category string")
    return profile.category_totals(events, categories)


def summary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return statistics.summary(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_linenumber"])


def top20_by_count(spark: SparkSession, d: str) -> DataFrame:
    counts = load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    return profile.ranked(counts, "n_orders", "o_custkey", 20)


def argmax_graph(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("quantity")).join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return statistics.argmax(lines, "quantity", "s_suppkey", ["s_nationkey"])


def names_first10_joined(spark: SparkSession, d: str) -> DataFrame:
    return statistics.first_names(load(spark, d, "part"), ["p_brand"], "p_name")


def failure_tallies(spark: SparkSession, d: str) -> DataFrame:
    movies = load(spark, d, "movies").dropDuplicates(["movie_id"])
    return statistics.tallies(movies, {"n_complete": F.col("abstract").isNotNull() & F.col("duration").isNotNull(), "n_without_text": F.col("abstract").isNull(), "n_withdrawn": F.col("deleted_at").isNotNull()})


def label_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = statistics.samples(load(spark, d, "reviews").dropDuplicates(["review_id"]).where("source is not null and review_body is not null"), "source", "review_body", "review_id")
    return rows.select("source", "n_all", F.posexplode("samples").alias("i", "sample"))


def url_id_extract(spark: SparkSession, d: str) -> DataFrame:
    refs = load(spark, d, "movies").select("movie_id", F.explode("is_similar_to").alias("url"))
    return refs.select("movie_id", "url", text.url_id(F.concat("url", F.lit("/")), "any").alias("id"))


def url_occurrences_vs_unique(spark: SparkSession, d: str) -> DataFrame:
    found = load(spark, d, "ttl_files").select("file_id", F.explode(text.url_matches(F.col("content"), [r"/title/(tt[0-9]+)", r"/name/(nm[0-9]+)"])).alias("id"))
    return found.groupBy("file_id").agg(F.count("*").alias("n_total"), F.countDistinct("id").alias("n_unique"))


def strip_query_absolute(spark: SparkSession, d: str) -> DataFrame:
    refs = load(spark, d, "movies").select("movie_id", F.explode("is_similar_to").alias("iri"))
    path = F.regexp_replace("iri", r"^https?://[^/]*", "")
    return refs.select("movie_id", text.absolute_url(path, "https://www.reelgraph.example").alias("url"))


def title_normalise(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "soundtrack_tracks").select("track_id", text.title_key(F.col("title")).alias("key"), text.squeeze(F.col("performer")).alias("performer"))


def human_number_parse(spark: SparkSession, d: str) -> DataFrame:
    whole = F.floor("o_totalprice").cast("long")
    typed = F.concat(F.lit("("), F.expr("cast(floor(o_totalprice) as bigint) div 10").cast("string"), F.lit("."), (whole % 10).cast("string"), F.lit("K)"))
    return load(spark, d, "orders").select("o_orderkey", text.human_number(typed).alias("votes"))


def by_pattern_counts_all(spark: SparkSession, d: str) -> DataFrame:
    """Words before "of" and a capital letter, over all documents."""
    found = F.regexp_extract_all("text", F.lit(r"([A-Za-z]+) of [A-Z]"), F.lit(1))
    return load(spark, d, "documents").select(F.explode(F.transform(found, F.lower)).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))


def json_path_props(spark: SparkSession, d: str) -> DataFrame:
    doc = F.try_parse_json("props")
    return load(spark, d, "events").select("event_id", markup.at_path(doc, "$.k", "bigint").alias("k"), markup.at_path(doc, "$.missing.deep", "string").alias("missing"))


def html_breaks(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("<article class='r x'><h1>"), F.coalesce("name", F.lit("")), F.lit("</h1><p>"), F.replace(F.coalesce("review_body", F.lit("")), F.lit("<br/>"), F.lit("</p><p>")), F.lit("</p></article>"))
    pages = spread(load(spark, d, "reviews").dropDuplicates(["review_id"]).select("review_id", page.alias("html")))
    paragraphs = markup.extract(pages, "review_id", "html", tag="p").where("value <> ''")
    return paragraphs.groupBy(F.col("review_id").cast("long").alias("review_id")).agg(F.count("*").alias("n_paragraphs"))


def credit_state_machine(spark: SparkSession, d: str) -> DataFrame:
    tracks = load(spark, d, "soundtrack_tracks").dropDuplicates(["track_id"]).where("title is not null")
    line = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n{label} "), F.col(c)))
    block = F.concat(F.trim("title"), *[F.coalesce(x, F.lit("")) for x in (line("Lyrics by", "lyrics_by"), line("Produced by", "producer"))], F.when(F.col("is_traditional"), F.lit("\nTraditional")).otherwise(""))
    parsed = parse_credits(tracks.select("track_id", block.alias("text")), "track_id", "text")
    return parsed.select("track_id", "title", "lyrics_by", "producer", "is_traditional")


def video_links(spark: SparkSession, d: str) -> DataFrame:
    videos = load(spark, d, "youtube_videos").dropDuplicates(["video_id"])
    return videos.select("video_id", text.is_video_link(F.col("url")).alias("is_link"), text.has_link(F.col("url"), F.col("video_id")).alias("has_link"), text.duration_seconds(F.col("duration")).alias("seconds"), F.date_format(text.mixed_date(F.col("published_at")), "yyyy-MM-dd").alias("published"))


def link_relax_cascade_all(spark: SparkSession, d: str) -> DataFrame:
    """Every part as item and every other part as candidate, first of its type and brand, then of its type.

    Which of the two a part gets is known from the least and greatest key of its type and brand, so that pairs are made
    once, in the end, and not moved: lists of items meet lists of candidates and are dealt out to tasks.
    """
    parts = load(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    several = F.min("p_partkey") < F.max("p_partkey")
    nears = parts.groupBy("p_type", "p_brand").agg(several.alias("_near")).where("_near")
    fars = parts.groupBy("p_type").agg(several.alias("_far")).where("_far")
    rows = parts.join(nears, ["p_type", "p_brand"], "left").join(fars, "p_type", "left")
    has = lambda c: F.col("p_partkey").isNotNull() & F.coalesce(c, F.lit(False))
    # a key that is there several times has the candidates of all its rows, as often as there are rows
    keys = rows.groupBy("p_partkey").agg(F.collect_list(F.struct("p_type", "p_brand", has("_near").alias("_near"), has("_far").alias("_far"))).alias("_rows"))
    any_ = lambda c: F.exists("_rows", lambda r: r[c])
    keys = keys.withColumn("attempt", F.when(any_("_near"), 0).when(any_("_far"), 1))
    each = keys.where("attempt is not null").select("p_partkey", "attempt", F.explode(F.array_repeat(F.filter("_rows", lambda r: F.when(F.col("attempt") == 0, r["_near"]).otherwise(r["_far"])), F.size("_rows"))).alias("_r"))
    items = each.select("p_partkey", "attempt", F.explode("_r").alias("_r")).select("p_partkey", "attempt", "_r.p_type", F.when(F.col("attempt") == 0, F.col("_r.p_brand")).alias("p_brand"))
    near = _pairs(items.where("attempt = 0"), parts, ["p_type", "p_brand"]).withColumn("attempt", F.lit(0))
    far = _pairs(items.where("attempt = 1"), parts, ["p_type"]).withColumn("attempt", F.lit(1))
    none = keys.where("attempt is null").select(F.explode(F.transform("_rows", lambda r: F.col("p_partkey"))).alias("p_partkey"), F.lit(None).cast("long").alias("candidate"), "attempt")
    return near.union(far).union(none).withColumn("error", F.when(F.col("attempt").isNull(), F.lit("no candidates")))


#: Items and candidates in one list of ``_pairs``. Each item is held with a list of candidates, so lists of items are shorter.
ITEM_KEYS, LIST_KEYS = 500, 4_000


def _pairs(items: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    """Items and the other parts that agree with them in ``by``."""

    def lists(df: DataFrame, most: int, number: str, name: str) -> DataFrame:
        sizes = df.groupBy(*by).agg(F.ceil(F.count("*") / most).cast("int").alias("_n"))
        dealt = df.join(sizes, by).withColumn(number, F.pmod(F.xxhash64("p_partkey"), F.col("_n")).cast("int"))
        return dealt.groupBy(*by, number).agg(F.collect_list("p_partkey").alias(name))

    met = lists(items, ITEM_KEYS, "_i", "_items").join(lists(parts.where("p_partkey is not null"), LIST_KEYS, "_j", "_others"), by)
    # dealt out in turn to several tasks a core, since each row stands for as many pairs as two lists make
    tasks = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * parts.sparkSession.sparkContext.defaultParallelism)
    each = met.repartition(tasks).select(F.explode("_items").alias("p_partkey"), "_others")
    # generated code holds all that comes of one row of its input; coalesce moves nothing, but ends it, so that these are
    # the pairs of one item and not of two lists
    return each.coalesce(tasks).select("p_partkey", F.explode("_others").alias("candidate")).where("candidate <> p_partkey")


def _links(spark: SparkSession, d: str) -> DataFrame:
    customers = load(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    suppliers = load(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"), "s_acctbal")
    return linking.nearest_matches(customers, suppliers, "c_nationkey", "c_custkey", "c_acctbal", "s_suppkey", "s_acctbal", 20000, F.col("c_acctbal") >= 0)


def link_best_match_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select("c_custkey", "s_suppkey", F.round("confidence", 7).alias("confidence"), "scored")


def link_result_classes(spark: SparkSession, d: str) -> DataFrame:
    results = load(spark, d, "customer").join(_links(spark, d).select("c_custkey", "s_suppkey", "scored"), "c_custkey", "left")
    failed = F.when(F.col("s_suppkey").isNotNull() & ~F.col("scored"), F.lit("scorer failed"))
    return linking.result_classes(results.withColumn("error", failed), "s_suppkey", "error")


def link_token_overlap(spark: SparkSession, d: str) -> DataFrame:
    tracks = load(spark, d, "soundtrack_tracks").dropDuplicates(["track_id"])
    return tracks.select("track_id", F.round(linking.token_overlap(F.col("title"), text.search_query(F.col("movie_title"), F.col("performer"), F.col("composer"), F.col("title"))), 6).alias("score"))


def inject_last_wins(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    users = events.select("user_id").distinct()
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("value").alias("url"), "ts", "event_id")
    return linking.inject_links(users, bought, ["user_id"], "url", "ts", "event_id")[0].select("user_id", F.col("url").alias("last_value"))


def inject_unmatched(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").where("l_quantity > 49 and l_discount > 0.09").select(F.col("l_suppkey").alias("s_suppkey"))
    return load(spark, d, "supplier").join(lines.distinct(), "s_suppkey", "left_anti").select("s_suppkey", "s_name")


def caption_mentions_anywhere(spark: SparkSession, d: str) -> DataFrame:
    """Names anywhere in the titles of videos; a name may begin at any word, a run of letters and digits."""
    word = r"[\p{L}\p{N}]+"
    videos = load(spark, d, "youtube_videos").select("video_id", "title").distinct().where("title is not null")
    # the empty word is for names without letters and digits
    words = F.array_distinct(F.array_append(F.regexp_extract_all("title", F.lit(word), F.lit(0)), F.lit("")))
    names = load(spark, d, "soundtrack_tracks").select(F.trim("title").alias("name")).distinct().where("name <> ''").withColumn("k", F.regexp_extract("name", word, 0))
    return linking.mentions(videos.withColumn("k", F.explode(words)), names, ["k"], "title", "name").select("video_id", "name").distinct()


def skip_existing_increment(spark: SparkSession, d: str) -> DataFrame:
    done = load(spark, d, "content_labels").where("source_table = 'reviews'").select(F.col("record_id").alias("review_id"))
    return linking.skip_existing(load(spark, d, "reviews").select("review_id", "movie_id").distinct(), done, "review_id")


def external_ids_found(spark: SparkSession, d: str) -> DataFrame:
    people = load(spark, d, "persons").groupBy("name").agg(F.min("person_id").alias("person_id"))
    tracks = load(spark, d, "soundtrack_tracks").select("producer").where("producer is not null").distinct().withColumnRenamed("producer", "name")
    return linking.first_external_id(tracks, people, "name", "person_id")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    parts = load(spark, d, "part").select("p_partkey", "p_brand")
    required = load(spark, d, "part").where("p_size = 1").select("p_partkey")
    return sampling.stratified(parts, "p_brand", "p_partkey", 5, required=required, order=F.col("p_partkey") * 7919 % 1009)


def subset_missing(spark: SparkSession, d: str) -> DataFrame:
    ids = load(spark, d, "movies").select(F.explode("is_similar_to").alias("iri")).select(text.url_id(F.concat("iri", F.lit("/")), "any").alias("movie_id")).where("movie_id is not null")
    kept, missing = sampling.subset(load(spark, d, "movies").select("movie_id").distinct(), ids, "movie_id")
    return kept.withColumn("there", F.lit(True)).union(missing.withColumn("there", F.lit(False)))


def reviewed_filter(spark: SparkSession, d: str) -> DataFrame:
    labels = load(spark, d, "content_labels").withColumn("correct", F.when(F.col("record_id") % 3 == 0, F.lit(None)).when(F.col("is_abusive") == 1, "n").otherwise("?"))
    return linking.unreviewed(labels, "correct").select("source_table", "record_id")


def decision_merge(spark: SparkSession, d: str) -> DataFrame:
    tracks = load(spark, d, "soundtrack_tracks").select("track_id", F.lit("N").alias("correct")).distinct()
    made = load(spark, d, "soundtrack_tracks").where("is_uncredited").select("track_id", F.lit("Y").alias("correct")).distinct()
    return linking.merge_decisions(tracks, made, "track_id", "correct")


def pct_of_total(spark: SparkSession, d: str) -> DataFrame:
    return profile.share_of_total(load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type", "n")


def qa_entries_flatten(spark: SparkSession, d: str) -> DataFrame:
    from tripleforge.sources.files import qa_entries

    movies = load(spark, d, "movies").dropDuplicates(["movie_id"]).select("movie_id", F.coalesce("genre", F.array().cast("array<string>")).alias("genre"))
    doc = F.to_json(F.create_map("movie_id", F.create_map(F.lit("q1"), F.struct(F.array(F.array(F.lit("u1"), F.coalesce(F.get("genre", F.lit(0)), F.lit("none"))), F.array(F.lit("alone"))).alias("html")))))
    return qa_entries(movies.select(doc.alias("text")), "text")


_FUNCTIONS = (lexical_property_count, modality_row, modality_summary, modality_breakdown, category_rollup, summary_metrics, top20_by_count, argmax_graph, names_first10_joined, failure_tallies, label_samples, url_id_extract, url_occurrences_vs_unique, strip_query_absolute, title_normalise, human_number_parse, by_pattern_counts_all, json_path_props, html_breaks, credit_state_machine, video_links, link_relax_cascade_all, link_best_match_fallback, link_result_classes, link_token_overlap, inject_last_wins, inject_unmatched, caption_mentions_anywhere, skip_existing_increment, external_ids_found, stratified_sample, subset_missing, reviewed_filter, decision_merge, pct_of_total, qa_entries_flatten)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_COUNTED = """c AS (SELECT movie_id, unnest(regexp_extract_all(content, 'schema1?:([A-Za-z0-9_]+)', 1)) AS p FROM ttl_files),
w AS (SELECT movie_id, count(*) FILTER (p = 'name') AS text_name, count(*) FILTER (p = 'abstract') AS text_abstract, count(*) FILTER (p = 'datePublished') AS "date_datePublished", count(*) FILTER (p = 'audio') AS audio_audio, count(*) FILTER (p = 'byArtist') AS "audio_byArtist" FROM c GROUP BY 1),
m AS (SELECT movie_id, coalesce(text_name, 0) AS text_name, coalesce(text_abstract, 0) AS text_abstract, coalesce("date_datePublished", 0) AS "date_datePublished", coalesce(audio_audio, 0) AS audio_audio, coalesce("audio_byArtist", 0) AS "audio_byArtist" FROM (SELECT DISTINCT movie_id FROM movies) LEFT JOIN w USING (movie_id)),
r AS (SELECT *, text_name + text_abstract AS text_total, text_name + text_abstract > 0 AS has_text, "date_datePublished" AS date_total, "date_datePublished" > 0 AS has_date, audio_audio + "audio_byArtist" AS audio_total, audio_audio + "audio_byArtist" > 0 AS has_audio FROM m)
"""
_ID = "nullif(regexp_extract({0} || '/', '/(tt[0-9]+|nm[0-9]+|co[0-9]+)/', 1), '')"
_BEST = """p AS (SELECT c_custkey, s_suppkey, CASE WHEN c_acctbal >= 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - abs(c_acctbal - s_acctbal) / 20000)) END AS x FROM customer JOIN supplier ON c_nationkey = s_nationkey),
b AS (SELECT DISTINCT ON (c_custkey) * FROM p ORDER BY c_custkey, x DESC NULLS LAST, s_suppkey)"""


def _summary_sql(columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS metric, round_even(CAST(sum({c}) AS DOUBLE), 2) AS total, round_even(avg({c}), 2) AS mean, CAST(max({c}) AS DOUBLE) AS maximum FROM lineitem" for c in columns)


def _breakdown_sql(columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS property, CAST(sum(\"{c}\") AS BIGINT) AS total, round(avg(\"{c}\"), 4) AS mean, count(*) FILTER (\"{c}\" > 0) AS n_with, round(100 * count(*) FILTER (\"{c}\" > 0) / count(*), 4) AS pct_with FROM m" for c in columns)


ORACLES = {
    "lexical_property_count": "SELECT property, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, 'schema1?:([A-Za-z0-9_]+)', 1)) AS property FROM ttl_files) GROUP BY 1",
    "modality_row": f"WITH {_COUNTED} SELECT * FROM r",
    "modality_summary": f"WITH {_COUNTED} " + " UNION ALL ".join(f"SELECT '{m}' AS modality, count(*) AS n_entities, count(*) FILTER (has_{m}) AS n_with, round(100 * count(*) FILTER (has_{m}) / count(*), 4) AS pct_with, round(avg({m}_total), 4) AS mean_total FROM r" for m in ("text", "date", "audio")),
    "modality_breakdown": f"WITH {_COUNTED} " + _breakdown_sql(["text_name", "text_abstract", "date_datePublished", "audio_audio", "audio_byArtist"]),
    "category_rollup": "SELECT category, property, count(*) AS total FROM (SELECT event_type AS property, CASE event_type WHEN 'signup' THEN 'account' WHEN 'purchase' THEN 'money' WHEN 'click' THEN 'browse' WHEN 'view' THEN 'browse' WHEN 'error' THEN 'other' END AS category FROM events) WHERE category IS NOT NULL GROUP BY ROLLUP (category, property)",
    "summary_metrics": _summary_sql(["l_quantity", "l_extendedprice", "l_linenumber"]),
    "top20_by_count": "SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1 ORDER BY n_orders DESC, o_custkey LIMIT 20",
    "argmax_graph": "WITH q AS (SELECT s_nationkey, s_suppkey, sum(l_quantity) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) SELECT DISTINCT ON (s_nationkey) s_nationkey, s_suppkey, quantity FROM q ORDER BY s_nationkey, quantity DESC, s_suppkey",
    "names_first10_joined": "WITH n AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS i FROM (SELECT DISTINCT p_brand, p_name FROM part)) SELECT p_brand, string_agg(p_name, '; ' ORDER BY p_name) FILTER (i <= 10) || CASE WHEN max(i) > 10 THEN '...' ELSE '' END AS names FROM n GROUP BY 1",
    "failure_tallies": "WITH m AS (SELECT DISTINCT ON (movie_id) * FROM movies ORDER BY movie_id) SELECT count(*) FILTER (abstract IS NOT NULL AND duration IS NOT NULL) AS n_complete, count(*) FILTER (abstract IS NULL) AS n_without_text, count(*) FILTER (deleted_at IS NOT NULL) AS n_withdrawn FROM m",
    "label_samples": "WITH r AS (SELECT DISTINCT review_id, source, review_body FROM reviews WHERE source IS NOT NULL AND review_body IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY review_id) AS k, count(*) OVER (PARTITION BY source) AS n_all FROM r) SELECT source, n_all, CAST(k - 1 AS INTEGER) AS i, review_body[1:200] AS sample FROM n WHERE k <= 5",
    "url_id_extract": f"SELECT movie_id, url, {_ID.format('url')} AS id FROM (SELECT movie_id, unnest(is_similar_to) AS url FROM movies)",
    "url_occurrences_vs_unique": "SELECT file_id, count(*) AS n_total, count(DISTINCT id) AS n_unique FROM (SELECT file_id, unnest(regexp_extract_all(content, '/title/(tt[0-9]+)', 1) || regexp_extract_all(content, '/name/(nm[0-9]+)', 1)) AS id FROM ttl_files) GROUP BY 1",
    "strip_query_absolute": "SELECT movie_id, split_part('https://www.reelgraph.example' || regexp_replace(iri, '^https?://[^/]*', ''), '?', 1) AS url FROM (SELECT movie_id, unnest(is_similar_to) AS iri FROM movies)",
    "title_normalise": r"SELECT track_id, lower(trim(title, E' \t\r\n')) AS key, regexp_replace(trim(performer, E' \t\r\n'), '\s+', ' ', 'g') AS performer FROM soundtrack_tracks",
    "human_number_parse": "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 100 AS votes FROM orders",
    "by_pattern_counts_all": "SELECT lower(p) AS phrase, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '([A-Za-z]+) of [A-Z]', 1)) AS p FROM documents) GROUP BY 1",
    "json_path_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events",
    "html_breaks": r"WITH r AS (SELECT DISTINCT review_id, review_body FROM reviews), p AS (SELECT review_id, unnest(string_split(coalesce(review_body, ''), '<br/>')) AS x FROM r) SELECT review_id, count(*) AS n_paragraphs FROM p WHERE trim(x, E' \t\r\n') <> '' GROUP BY 1",
    "credit_state_machine": r"WITH t AS (SELECT DISTINCT track_id, trim(title, E' \t\r\n') AS title, lyrics_by, producer, is_traditional FROM soundtrack_tracks WHERE title IS NOT NULL) SELECT track_id, title, trim(lyrics_by, E' \t') AS lyrics_by, trim(producer, E' \t') AS producer, is_traditional FROM t",
    "video_links": r"""WITH v AS (SELECT DISTINCT ON (video_id) * FROM youtube_videos ORDER BY video_id)
SELECT video_id, coalesce(regexp_matches(url, '^https?://(?:www\.)?youtube\.com/watch\?v=[A-Za-z0-9_-]+'), false) AS is_link, true AS has_link,
  CASE WHEN regexp_matches(duration, '^PT([0-9]+H)?([0-9]+M)?([0-9]+S)?$') THEN coalesce(TRY_CAST(regexp_extract(duration, '([0-9]+)H', 1) AS BIGINT), 0) * 3600 + coalesce(TRY_CAST(regexp_extract(duration, '([0-9]+)M', 1) AS BIGINT), 0) * 60 + coalesce(TRY_CAST(regexp_extract(duration, '([0-9]+)S', 1) AS BIGINT), 0) END AS seconds,
  strftime(coalesce(TRY_CAST(nullif(regexp_extract(published_at, '^([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS DATE), CAST(try_strptime(published_at, '%d/%m/%Y') AS DATE), CAST(try_strptime(published_at, '%d %b %Y') AS DATE)), '%Y-%m-%d') AS published FROM v""",
    "link_relax_cascade_all": """WITH a AS (SELECT i.p_partkey, c.p_partkey AS candidate, 0 AS attempt FROM part i JOIN part c ON i.p_type = c.p_type AND i.p_brand = c.p_brand AND i.p_partkey <> c.p_partkey UNION ALL SELECT i.p_partkey, c.p_partkey, 1 FROM part i JOIN part c ON i.p_type = c.p_type AND i.p_partkey <> c.p_partkey),
k AS (SELECT a.* FROM a JOIN (SELECT p_partkey, min(attempt) AS attempt FROM a GROUP BY 1) USING (p_partkey, attempt))
SELECT i.p_partkey, candidate, CAST(attempt AS INTEGER) AS attempt, CASE WHEN attempt IS NULL THEN 'no candidates' END AS error FROM part i LEFT JOIN k USING (p_partkey)""",
    "link_best_match_fallback": f"WITH {_BEST} SELECT c_custkey, s_suppkey, round(coalesce(x, 0.3), 7) AS confidence, x IS NOT NULL AS scored FROM b",
    "link_result_classes": f"WITH {_BEST}, r AS (SELECT customer.c_custkey, s_suppkey, CASE WHEN s_suppkey IS NOT NULL AND x IS NULL THEN 'e' END AS error FROM customer LEFT JOIN b USING (c_custkey)) SELECT count(*) FILTER (s_suppkey IS NOT NULL AND error IS NULL) AS n_success, count(*) FILTER (s_suppkey IS NULL AND error IS NULL) AS n_no_result, count(error) AS n_failure FROM r",
    "link_token_overlap": r"""WITH t AS (SELECT DISTINCT track_id, title, concat_ws(' ', movie_title, coalesce(performer, composer), title) AS q FROM soundtrack_tracks),
w AS (SELECT track_id, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(q), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS b FROM t)
SELECT track_id, round(coalesce(len(list_intersect(a, b)) / nullif(len(a), 0), 0), 6) AS score FROM w""",
    "inject_last_wins": "WITH l AS (SELECT DISTINCT ON (user_id) user_id, value FROM events WHERE event_type = 'purchase' ORDER BY user_id, ts DESC, event_id DESC) SELECT u.user_id, l.value AS last_value FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN l USING (user_id)",
    "inject_unmatched": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09)",
    "caption_mentions_anywhere": r"WITH v AS (SELECT DISTINCT video_id, title FROM youtube_videos WHERE title IS NOT NULL), n AS (SELECT DISTINCT trim(title) AS name FROM soundtrack_tracks WHERE trim(title) <> '') SELECT DISTINCT video_id, name FROM v JOIN n ON list_contains(list_append(regexp_extract_all(v.title, '[\p{L}\p{N}]+'), ''), regexp_extract(name, '[\p{L}\p{N}]+')) AND contains(v.title, name)",
    "skip_existing_increment": "SELECT DISTINCT review_id, movie_id FROM reviews WHERE review_id NOT IN (SELECT record_id FROM content_labels WHERE source_table = 'reviews')",
    "external_ids_found": "SELECT t.name, p.person_id FROM (SELECT DISTINCT producer AS name FROM soundtrack_tracks WHERE producer IS NOT NULL) t LEFT JOIN (SELECT name, min(person_id) AS person_id FROM persons GROUP BY 1) p USING (name)",
    "stratified_sample": "SELECT p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size = 1 THEN 0 ELSE 1 END, p_partkey * 7919 % 1009, p_partkey) <= 5",
    "subset_missing": f"WITH i AS (SELECT DISTINCT {_ID.format('iri')} AS movie_id FROM (SELECT unnest(is_similar_to) AS iri FROM movies)), m AS (SELECT DISTINCT movie_id FROM movies) SELECT movie_id, movie_id IN (SELECT movie_id FROM m) AS there FROM i WHERE movie_id IS NOT NULL",
    "reviewed_filter": "SELECT source_table, record_id FROM content_labels WHERE record_id % 3 = 0 OR is_abusive <> 1",
    "decision_merge": "SELECT DISTINCT track_id, CASE WHEN track_id IN (SELECT track_id FROM soundtrack_tracks WHERE is_uncredited) THEN 'Y' ELSE 'N' END AS correct FROM soundtrack_tracks",
    "pct_of_total": "SELECT event_type, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS pct FROM events GROUP BY 1",
    "qa_entries_flatten": "WITH m AS (SELECT DISTINCT ON (movie_id) movie_id, genre FROM movies ORDER BY movie_id) SELECT movie_id, 'q1' AS question, CAST(0 AS INTEGER) AS pos, 'u1' AS url, coalesce(genre[1], 'none') AS caption FROM m",
}
