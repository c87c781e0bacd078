"""Soundtracks, videos and their comments in graphs: records from paths, statistics, injected links, captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleforge.functions.text import title_key
from tripleforge.operators.linking import last_per_key
from tripleforge.operators.statistics import composition_credits, first_names, resolved_names
from tripleforge.operators.store import COLUMNS, PREFIXES, RDF_TYPE, expand


def _edge(triples: DataFrame, predicate: str, s: str, o: str) -> DataFrame:
    return triples.where(F.col("p") == expand(predicate)).select("g", F.col("s").alias(s), F.col("o").alias(o)).distinct()


def _named(pairs: DataFrame, names: DataFrame, key: str, node: str, alias: str) -> DataFrame:
    """Names of the nodes of each key in one text, sorted and separated by commas."""
    named = pairs.join(names.select("g", F.col("s").alias(node), "name"), ["g", node]).where("name is not null")
    return named.groupBy("g", key).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias(alias))


def soundtrack_records(triples: DataFrame) -> DataFrame:
    """(g, recording, title, performer, composer, lyrics_by, producer) of every recording that a movie lists as audio.

    The path is movie, audio, recordingOf, credits; people come out by name, else by the end of their IRI. A work without
    composer takes its authors as composers; with one, authors without lyricist count as lyricists.
    """
    recordings = _edge(triples, "schema:audio", "movie", "recording").select("g", "recording").distinct()
    names = resolved_names(triples)
    titles = triples.where((F.col("p") == expand("schema:name")) & (F.col("o_kind") == "L")).groupBy("g", F.col("s").alias("recording")).agg(F.min("o").alias("title"))
    works = _edge(triples, "schema:recordingOf", "recording", "work")
    credits = works.join(composition_credits(triples), ["g", "work"])
    out = recordings.join(titles, ["g", "recording"])
    for predicate, alias in (("schema:byArtist", "performer"), ("schema:producer", "producer")):
        out = out.join(_named(_edge(triples, predicate, "recording", "node"), names, "recording", "node", alias), ["g", "recording"], "left")
    for column, alias in (("composer", "composer"), ("lyricist", "lyrics_by")):
        nodes = credits.select("g", "recording", F.explode(column).alias("node"))
        out = out.join(_named(nodes, names, "recording", "node", alias), ["g", "recording"], "left")
    return out.select("g", "recording", "title", "performer", "composer", "lyrics_by", "producer")


def soundtrack_statistics(triples: DataFrame) -> DataFrame:
    """Per graph: triples, recordings, compositions, people per role, and the first ten performers' names."""
    is_type = lambda t: (F.col("p") == RDF_TYPE) & (F.col("o") == expand(t))
    roles = {"n_performers": "schema:byArtist", "n_producers": "schema:producer", "n_composers": "schema:composer", "n_lyricists": "schema:lyricist", "n_authors": "schema:author"}
    counts = triples.groupBy("g").agg(
        F.count_distinct("s", "p", "o", F.coalesce("o_dt", F.lit(""))).alias("n_triples"),
        F.count_distinct(F.when(is_type("schema:MusicRecording"), F.col("s"))).alias("n_recordings"),
        F.count_distinct(F.when(is_type("schema:MusicComposition"), F.col("s"))).alias("n_compositions"),
        *[F.count_distinct(F.when(F.col("p") == expand(p), F.col("o"))).alias(c) for c, p in roles.items()],
    )
    performers = _edge(triples, "schema:byArtist", "recording", "s").select("g", "s").distinct().join(resolved_names(triples), ["g", "s"])
    return counts.join(first_names(performers, ["g"], "name").withColumnRenamed("names", "performers"), "g", "left")


def inject_urls(triples: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triples with the new ones, links that name no recording of their graph).

    ``links``: g, title, url, pos. Titles agree without regard to case and outer white space; of links with one title the
    last counts; recordings that have a url keep it; several recordings of one title all get it.
    """
    final = last_per_key(links.withColumn("key", title_key(F.col("title"))), ["g", "key"], "pos", "url").select("g", "key", "url")
    typed = triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == expand("schema:MusicRecording"))).select("g", "s", "s_kind")
    named = typed.join(triples.where((F.col("p") == expand("schema:name")) & (F.col("o_kind") == "L")).select("g", "s", title_key(F.col("o")).alias("key")), ["g", "s"]).distinct()
    bare = named.join(triples.where(F.col("p") == expand("schema:url")).select("g", "s").distinct(), ["g", "s"], "left_anti")
    new = bare.join(final, ["g", "key"]).select("g", "s", "s_kind", F.lit(expand("schema:url")).alias("p"), F.col("url").alias("o"), F.lit("L").alias("o_kind"), F.lit(PREFIXES["xsd"] + "string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    return triples.select(*COLUMNS).unionByName(new.distinct()), final.join(named.select("g", "key").distinct(), ["g", "key"], "left_anti")


def with_comments(videos: DataFrame, comments: DataFrame, key: str, order: list, n: int = 5) -> DataFrame:
    """Videos with their first ``n`` comments as an array of structures; a video without comments keeps an empty one.

    Comments are ranked before they are collected, so a video that most comments belong to costs no memory.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    fields = [c for c in comments.columns if c != key]
    top = comments.withColumn("_n", place).where(F.col("_n") <= n).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", *fields))).alias("comments"))
    return videos.join(top, key, "left").withColumn("comments", F.coalesce("comments", F.array()))


def file_statistics(files: DataFrame, key: str, text: str) -> DataFrame:
    """Bytes (UTF-8) and lines of each text; a last line without line feed counts, null has none."""
    content = F.coalesce(F.col(text), F.lit(""))
    lines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + (~content.endswith("\n") & (content != "")).cast("int")
    return files.select(key, F.octet_length(content).alias("n_bytes"), lines.alias("n_lines"))


def main_entities(triples: DataFrame) -> DataFrame:
    """(g, image, person): pictures and the actors of the same graph whose name their caption contains."""
    captions = triples.where(F.col("p") == expand("schema:caption")).select("g", F.col("s").alias("image"), F.col("o").alias("caption"))
    actors = _edge(triples, "schema:actor", "movie", "s").select("g", "s").distinct().join(resolved_names(triples), ["g", "s"])
    return captions.join(actors, "g").where(F.contains("caption", "name")).select("g", "image", F.col("s").alias("person")).distinct()
