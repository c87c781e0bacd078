"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleforge.llm.content import content_rates, content_scores
from tripleforge.llm.leakage import leaked_items
from tripleforge.llm.linkage import link_tracks
from tripleforge.llm.packing import pack_documents, packing_report, token_counts
from tripleforge.llm.pii import find_pii, private_pii, redact
from tripleforge.llm.shared_spans import shared_shares, shared_spans
from tripleforge.llm.spellings import name_entities, variant_pairs
from tripleforge.runtime import load

#: Where the files of public tokenizers are; never copied into the library.
TOKENIZER = os.environ.get("TRIPLEFORGE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p1_pii(spark: SparkSession, d: str) -> DataFrame:
    """Personal information of private people in comments and in their authors' names."""
    found = find_pii(load(spark, d, "youtube_comments"), "comment_id", ["text", "author"], author="author")
    tracks, persons = load(spark, d, "soundtrack_tracks"), load(spark, d, "persons")
    credited = tracks.select(F.explode(F.array("performer", "composer", "lyrics_by", "producer")).alias("name"))
    listed = persons.select(F.explode(F.array("name", "alternate_name")).alias("name"))
    return private_pii(found, credited.union(listed), "name")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Type and place of each piece of personal information."""
    return p1_pii(spark, d).select("comment_id", "field", "pii_type", "start_pos").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Comments with personal information replaced by its type."""
    comments = load(spark, d, "youtube_comments").select("comment_id", "video_id", "author", "text")
    return redact(comments, p1_pii(spark, d), "comment_id", ["text", "author"])


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of every review and comment for abusive, hateful or sexual content."""
    reviews = load(spark, d, "reviews").select(F.lit("reviews").alias("source_table"), F.col("review_id").alias("record_id"), "source", F.col("review_body").alias("text"))
    comments = load(spark, d, "youtube_comments").select(F.lit("youtube_comments"), "comment_id", F.lit("youtube_comments"), "text")
    return content_scores(reviews.union(comments), load(spark, d, "content_labels"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Reviews and comments with such content."""
    return p2_scores(spark, d).where("flagged").select("source_table", "record_id").distinct()


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of such records per source."""
    return content_rates(p2_scores(spark, d))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Tracks and the videos that present them, with a confidence."""
    tracks = load(spark, d, "soundtrack_tracks").where("not coalesce(is_traditional, false)")
    tracks = tracks.select("track_id", "title", F.coalesce("performer", "composer").alias("artist"), F.col("movie_title").alias("film"))
    return link_tracks(tracks, load(spark, d, "youtube_videos"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Tracks and the videos that present them."""
    return p4_links(spark, d).select("track_id", "video_id")


def _entities(spark: SparkSession, d: str) -> DataFrame:
    tracks = load(spark, d, "soundtrack_tracks")
    return name_entities(tracks.select(F.explode(F.array("performer", "composer", "lyrics_by")).alias("name")), "name")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different spellings of one person or group."""
    return variant_pairs(_entities(spark, d))


def p7_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with the entity it names."""
    return _entities(spark, d)


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Training sequences of 512 to 4,096 tokens: every document with its sequence."""
    return pack_documents(token_counts(load(spark, d, "documents"), "doc_id", "text", TOKENIZER), "doc_id", [512, 1024, 2048, 4096])


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """How full the sequences of each length are."""
    return packing_report(p8_packed(spark, d))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with verbatim or reworded passages of evaluation items."""
    return leaked_items(load(spark, d, "documents"), "doc_id", "text", load(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Items and the documents that hold at least 12 consecutive words of them."""
    return p9_leaks(spark, d).where("kind = 'verbatim'").select("item_id", "doc_id")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(load(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Maximal runs of characters that other documents hold verbatim, in spans of 300 characters or more."""
    return _spans(spark, d).select("doc_id", "start_pos", "end_pos")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of each document's text that other documents hold."""
    return shared_shares(_spans(spark, d), "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_pii, p1_redacted, p2_found, p2_scores, p2_rates, p4_found, p4_links, p7_found, p7_entities, p8_packed, p8_report, p9_found, p9_leaks, p10_found, p10_shares)}

ORACLES = {
    "p9_found": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
ig AS (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT item_id, doc_id FROM dg JOIN ig USING (g)""",
    "p10_found": """
WITH w AS (SELECT doc_id, p, hash(substr(text, p + 1, 300)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 299)) AS p FROM documents WHERE length(text) >= 300)),
s AS (SELECT doc_id, p FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1) USING (h)),
o AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 300 THEN 0 ELSE 1 END AS opens FROM s),
r AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM o)
SELECT doc_id, CAST(min(p) AS INTEGER) AS start_pos, CAST(max(p) + 300 AS INTEGER) AS end_pos FROM r GROUP BY doc_id, run""",
}
