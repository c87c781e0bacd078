"""Queries over tables lifted to triples: patterns, paths, SPARQL text, comparison, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleforge.operators import comparison, patterns, statistics
from tripleforge.operators.linking import same_as
from tripleforge.operators.store import as_graph, canonical_id, lift, qname, to_ntriples
from tripleforge.plans import sparql
from tripleforge.runtime import load, spread
from tripleforge.sources.turtle import turtle_triples

EX = "http://example.org/"
_PREFIX = f"PREFIX ex: <{EX}>\n"
def _all():
    return F.lit("all")



def _iri(kind: str, column: str):
    return F.concat(F.lit(f"{EX}{kind}/"), F.col(column))


def _lifted(spark: SparkSession, d: str, *tables: str) -> DataFrame:
    """The named tables as one graph of triples."""
    shapes = {
        "region": ("region", "r_regionkey", {EX + "name": "r_name"}, {}),
        "nation": ("nation", "n_nationkey", {EX + "name": "n_name"}, {EX + "inRegion": ("region", "n_regionkey")}),
        "customer": ("customer", "c_custkey", {EX + "name": "c_name", EX + "segment": "c_mktsegment", EX + "balance": "c_acctbal"}, {EX + "nation": ("nation", "c_nationkey")}),
        "supplier": ("supplier", "s_suppkey", {EX + "name": "s_name", EX + "balance": "s_acctbal"}, {EX + "nation": ("nation", "s_nationkey")}),
        "orders": ("order", "o_orderkey", {EX + "priority": "o_orderpriority", EX + "status": "o_orderstatus", EX + "total": "o_totalprice"}, {EX + "customer": ("customer", "o_custkey")}),
        "part": ("part", "p_partkey", {EX + "name": "p_name", EX + "brand": "p_brand", EX + "size": "p_size", EX + "price": "p_retailprice"}, {}),
    }
    out = None
    for table in tables:
        kind, key, literals, links = shapes[table]
        properties = literals | {p: _iri(k, c) for p, (k, c) in links.items()}
        one = lift(load(spark, d, table), _all(), _iri(kind, key), properties, f"{EX}{kind.title()}", tuple(links))
        out = one if out is None else out.union(one)
    return out


def _key(column: str):
    return F.regexp_extract(column, r"/(\d+)$", 1).cast("long")


def bgp_orders_per_nation(spark: SparkSession, d: str) -> DataFrame:
    t = _lifted(spark, d, "customer", "nation", "orders")
    found = patterns.join(patterns.join(patterns.scan(t, "?o", f"<{EX}customer>", "?c", unique=True), patterns.scan(t, "?c", f"<{EX}nation>", "?n", unique=True)), patterns.scan(t, "?n", f"<{EX}name>", "?name", unique=True))
    return found.groupBy("name").agg(F.count("*").alias("n_orders"))


def bgp_star_customer(spark: SparkSession, d: str) -> DataFrame:
    t = _lifted(spark, d, "customer")
    return patterns.star(t, "c", {"name": EX + "name", "segment": EX + "segment"}).select(_key("c").alias("c_custkey"), "name", "segment")


def bgp_optional_orders(spark: SparkSession, d: str) -> DataFrame:
    t = _lifted(spark, d, "customer", "orders")
    urgent = patterns.join(patterns.scan(t, "?o", f"<{EX}customer>", "?c", unique=True), patterns.scan(t, "?o", f"<{EX}priority>", '"1-URGENT"', unique=True))
    rows = patterns.optional(patterns.scan(t, "?c", f"<{EX}name>", "?name", unique=True), urgent)
    return rows.groupBy("name").agg(F.count("o").alias("n_urgent"))


def bgp_minus_no_orders(spark: SparkSession, d: str) -> DataFrame:
    t = _lifted(spark, d, "customer", "orders")
    urgent = patterns.join(patterns.scan(t, "?o", f"<{EX}customer>", "?c", unique=True), patterns.scan(t, "?o", f"<{EX}priority>", '"1-URGENT"', unique=True))
    return patterns.minus(patterns.scan(t, "?c", f"<{EX}segment>", "?segment", unique=True), urgent).select(_key("c").alias("c_custkey"), "segment")


def bgp_union_parties(spark: SparkSession, d: str) -> DataFrame:
    t = _lifted(spark, d, "customer", "supplier")
    named = lambda kind: patterns.join(patterns.scan(t, "?x", "rdf:type", f"<{EX}{kind}>", unique=True), patterns.scan(t, "?x", f"<{EX}name>", "?name", unique=True))
    return patterns.union(named("Customer"), named("Supplier")).select("name")


def bgp_filter_typed(spark: SparkSession, d: str) -> DataFrame:
    text = _PREFIX + "SELECT ?name ?size WHERE { ?p ex:name ?name ; ex:size ?size ; ex:price ?price . FILTER(?size >= 40 && ?price < 1200) }"
    return sparql.select(_lifted(spark, d, "part"), text, unique=True).select("name", F.col("size").cast("int").alias("p_size"))


def bgp_exists(spark: SparkSession, d: str) -> DataFrame:
    t = _lifted(spark, d, "supplier")
    lines = load(spark, d, "lineitem").select(_iri("supplier", "l_suppkey").alias("s"), "l_quantity").where("l_quantity >= 50").select("s").distinct()
    large = lines.select(_all().alias("g"), "s", F.lit("I").alias("s_kind"), F.lit(EX + "large").alias("p"), F.lit("true").alias("o"), F.lit("L").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    text = _PREFIX + 'SELECT ?name WHERE { ?s ex:name ?name . FILTER EXISTS { ?s ex:large "true" } }'
    return sparql.select(t.union(large), text, unique=True).select("name")


def bgp_group_having(spark: SparkSession, d: str) -> DataFrame:
    text = _PREFIX + "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o ex:customer ?c . } GROUP BY ?c HAVING (COUNT(?o) >= 12)"
    return sparql.select(_lifted(spark, d, "orders"), text, unique=True).select(_key("c").alias("o_custkey"), F.col("n").cast("long").alias("n_orders"))


def bgp_order_limit(spark: SparkSession, d: str) -> DataFrame:
    text = _PREFIX + "SELECT ?o ?total WHERE { ?o ex:total ?total } ORDER BY DESC(?total) ?o LIMIT 15"
    return sparql.select(_lifted(spark, d, "orders"), text, unique=True).select(_key("o").alias("o_orderkey"), F.col("total").cast("double").alias("o_totalprice"))


def bgp_path_region(spark: SparkSession, d: str) -> DataFrame:
    text = _PREFIX + "SELECT ?region (COUNT(?s) AS ?n) WHERE { ?r ^(ex:nation/ex:inRegion) ?s ; ex:name ?region . ?s a ex:Supplier } GROUP BY ?region"
    return sparql.select(_lifted(spark, d, "supplier", "nation", "region"), text, unique=True).select("region", F.col("n").cast("long").alias("n_suppliers"))


def bgp_bind_values(spark: SparkSession, d: str) -> DataFrame:
    text = _PREFIX + 'SELECT ?name ?double WHERE { VALUES ?segment { "BUILDING" "MACHINERY" } ?c ex:segment ?segment ; ex:name ?name ; ex:balance ?b BIND(?b * 2 AS ?double) FILTER(?b > 9000) }'
    return sparql.select(_lifted(spark, d, "customer"), text, unique=True).select("name", F.round(F.col("double").cast("double"), 2).alias("twice"))


def bgp_distinct_brands(spark: SparkSession, d: str) -> DataFrame:
    text = _PREFIX + "SELECT DISTINCT ?brand WHERE { ?p ex:brand ?brand ; ex:size ?s FILTER(?s IN (1, 2, 3)) }"
    return sparql.select(_lifted(spark, d, "part"), text, unique=True).select("brand")


def bgp_subselect(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose largest order is above 400,000, with that order's total: a query within a query."""
    text = _PREFIX + "SELECT ?name ?most WHERE { ?c ex:name ?name . { SELECT ?c (MAX(?total) AS ?most) WHERE { ?o ex:customer ?c ; ex:total ?total } GROUP BY ?c } FILTER(?most > 400000) }"
    return sparql.select(_lifted(spark, d, "customer", "orders"), text, unique=True).select("name", F.col("most").cast("double").alias("most"))


def bgp_group_expression(spark: SparkSession, d: str) -> DataFrame:
    """Orders per first word of their priority."""
    text = _PREFIX + 'SELECT ?level (COUNT(?o) AS ?n) WHERE { ?o ex:priority ?p } GROUP BY (STRBEFORE(?p, "-") AS ?level)'
    return sparql.select(_lifted(spark, d, "orders"), text, unique=True).select("level", F.col("n").cast("long").alias("n_orders"))


def bgp_optional_then_join(spark: SparkSession, d: str) -> DataFrame:
    """A variable that an OPTIONAL may leave unbound is bound by a later pattern: rows without it meet every supplier's nation."""
    text = _PREFIX + "SELECT ?c ?n (COUNT(?s) AS ?k) WHERE { ?c ex:segment ?g OPTIONAL { ?c ex:nation ?n . FILTER(?b > 9990) . ?c ex:balance ?b } ?s ex:nation ?n . ?s a ex:Supplier . FILTER(?g = \"BUILDING\") } GROUP BY ?c ?n"
    rows = sparql.select(_lifted(spark, d, "customer", "supplier"), text, unique=True)
    return rows.select(_key("c").alias("c_custkey"), _key("n").alias("n_nationkey"), F.col("k").cast("long").alias("n_suppliers"))


def qnames(spark: SparkSession, d: str) -> DataFrame:
    """Prefixed names of predicates and their triples."""
    t = _lifted(spark, d, "customer", "nation")
    return t.groupBy(qname(F.col("p"), {"ex": EX}).alias("property")).agg(F.count("*").alias("n"))


def path_plus_reachability(spark: SparkSession, d: str) -> DataFrame:
    movies = load(spark, d, "movies").groupBy("movie_id").agg(F.min("is_similar_to").alias("similar"))
    edges = movies.select("movie_id", F.explode("similar").alias("iri")).where("iri is not null").select(F.col("movie_id").alias("s"), canonical_id(F.col("iri")).alias("o"))
    t = edges.select(_all().alias("g"), "s", F.lit("I").alias("s_kind"), F.lit(EX + "similar").alias("p"), "o", F.lit("I").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    text = _PREFIX + "SELECT ?from ?to WHERE { { BIND(\"late\" AS ?from) <tt900000015> ex:similar+ ?to } UNION { BIND(\"to first\" AS ?from) ?to ex:similar+ <tt900000003> } }"
    return sparql.select(t, text).select("from", "to").distinct()


def value_any_deterministic(spark: SparkSession, d: str) -> DataFrame:
    t = lift(load(spark, d, "orders"), _all(), _iri("customer", "o_custkey"), {EX + "status": "o_orderstatus"})
    return statistics.any_value(t, EX + "status", "status").select(_key("s").alias("o_custkey"), "status")


def triples_per_graph(spark: SparkSession, d: str) -> DataFrame:
    movies = load(spark, d, "movies").dropDuplicates(["movie_id"])
    t = lift(movies, F.col("movie_id"), F.col("url"), {"schema:name": "name", "schema:genre": "genre", "schema:inLanguage": "in_language", "schema:contentRating": "content_rating"}, "schema:Movie")
    return statistics.graph_sizes(as_graph(t)).select(F.col("g").alias("movie_id"), "n_triples", "n_predicates")


def role_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem")
    t = lift(lines, F.col("l_orderkey"), _iri("order", "l_orderkey"), {EX + "supplier": "l_suppkey", EX + "part": "l_partkey"})
    return statistics.role_counts(t, {"n_suppliers": EX + "supplier", "n_parts": EX + "part"}).select(F.col("g").cast("long").alias("l_orderkey"), "n_suppliers", "n_parts")


def typed_node_counts(spark: SparkSession, d: str) -> DataFrame:
    return statistics.typed_counts(_lifted(spark, d, "region", "nation", "supplier"), {"n_regions": EX + "Region", "n_nations": EX + "Nation", "n_suppliers": EX + "Supplier"})


def name_resolution_all(spark: SparkSession, d: str) -> DataFrame:
    """Names of persons and of what they performed in."""
    persons = load(spark, d, "persons").dropDuplicates(["person_id"])
    t = lift(persons, _all(), F.col("url"), {"schema:name": "name", "schema:performerIn": "performer_in"}, None, ("schema:performerIn",))
    return statistics.resolved_names(t).select("s", "name")


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = load(spark, d, "orders")
    one = lambda df: comparison.normalised(lift(df, _all(), _iri("order", "o_orderkey"), {EX + "status": "o_orderstatus", EX + "priority": "o_orderpriority"}))
    return one(orders.where("o_orderstatus <> 'P'")), one(orders.where("o_totalprice < 200000"))


def graph_diff_metrics(spark: SparkSession, d: str) -> DataFrame:
    return comparison.agreement(*_versions(spark, d))


def graph_diff_sides(spark: SparkSession, d: str) -> DataFrame:
    return comparison.difference(*_versions(spark, d)).select(_key("s").alias("o_orderkey"), F.substring_index("p", "/", -1).alias("property"), F.substring_index("o", "|", 1).alias("value"), "side")


def decimal_normalise_diff(spark: SparkSession, d: str) -> DataFrame:
    parts = load(spark, d, "part").withColumn("text", F.col("p_retailprice").cast("decimal(12,3)").cast("string"))
    return parts.select("p_partkey", comparison.decimal_text(F.col("text")).alias("price"))


def iri_canonical_join(spark: SparkSession, d: str) -> DataFrame:
    movies = load(spark, d, "movies").select(canonical_id(F.col("url")).alias("id"), "name").distinct()
    refs = load(spark, d, "movies").select("movie_id", F.explode("is_similar_to").alias("iri")).select("movie_id", canonical_id(F.col("iri")).alias("id")).distinct()
    return refs.join(movies, "id").select("movie_id", "id", "name")


def query_coverage(spark: SparkSession, d: str) -> DataFrame:
    movies = load(spark, d, "movies").dropDuplicates(["movie_id"])
    t = lift(movies, F.col("content_rating"), F.col("url"), {"schema:name": "name", "schema:duration": "duration", "schema:ratingValue": "rating_value", "schema:abstract": "abstract"}).where("g is not null")
    text = """PREFIX schema: <http://schema.org/>
# Q1: long films
SELECT ?m WHERE { ?m schema:duration ?d . FILTER(STRSTARTS(?d, "PT2H5")) }
# Q2: best rated
SELECT ?m WHERE { ?m schema:ratingValue ?r . FILTER(?r > 9.5) } ORDER BY ?r LIMIT 5
# Q10: nothing
SELECT ?m WHERE { ?m schema:name "no such film" }
"""
    return sparql.coverage(t, sparql.load_queries(text), t.select("g").distinct())


def sameas_links(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "persons").select("url", F.when(F.col("birth_place").isNotNull(), F.concat(F.lit("Q"), F.substring("person_id", 3, 20))).alias("external"))
    return same_as(rows, "url", "external", slash=True).select("s", "o")


def turtle_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    lines = to_ntriples(_lifted(spark, d, "part")).select(F.lit("part").alias("g"), "value")
    back = turtle_triples(spread(lines), "g", "value").where(F.col("p") == EX + "name")
    return back.select(_key("s").alias("p_partkey"), F.col("o").alias("p_name"))


QUERIES = {f.__name__: f for f in (bgp_orders_per_nation, bgp_star_customer, bgp_optional_orders, bgp_minus_no_orders, bgp_union_parties, bgp_filter_typed, bgp_exists, bgp_group_having, bgp_order_limit, bgp_path_region, bgp_bind_values, bgp_distinct_brands, bgp_subselect, bgp_group_expression, bgp_optional_then_join, qnames, path_plus_reachability, value_any_deterministic, triples_per_graph, role_distinct_counts, typed_node_counts, name_resolution_all, graph_diff_metrics, graph_diff_sides, decimal_normalise_diff, iri_canonical_join, query_coverage, sameas_links, turtle_roundtrip)}

_CANON = "coalesce(nullif(regexp_extract({0}, '/(?:title|name|company)/((?:tt|nm|co)[0-9]+)(?:[/?#].*)?$', 1), ''), {0})"
_SIDES = """WITH a AS (SELECT DISTINCT o_orderkey, unnest([{'p': 'status', 'v': o_orderstatus}, {'p': 'priority', 'v': o_orderpriority}]) AS x FROM orders WHERE o_orderstatus <> 'P'),
b AS (SELECT DISTINCT o_orderkey, unnest([{'p': 'status', 'v': o_orderstatus}, {'p': 'priority', 'v': o_orderpriority}]) AS x FROM orders WHERE o_totalprice < 200000)
"""
ORACLES = {
    "bgp_orders_per_nation": "SELECT n_name AS name, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "bgp_star_customer": "SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer",
    "bgp_optional_orders": "SELECT c_name AS name, count(o_orderkey) AS n_urgent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1",
    "bgp_minus_no_orders": "SELECT c_custkey, c_mktsegment AS segment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "bgp_union_parties": "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier",
    "bgp_filter_typed": "SELECT p_name AS name, p_size FROM part WHERE p_size >= 40 AND p_retailprice < 1200",
    "bgp_exists": "SELECT s_name AS name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50)",
    "bgp_group_having": "SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1 HAVING count(*) >= 12",
    "bgp_order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 15",
    "bgp_path_region": "SELECT r_name AS region, count(*) AS n_suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "bgp_bind_values": "SELECT c_name AS name, round(c_acctbal * 2, 2) AS twice FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 9000",
    "bgp_distinct_brands": "SELECT DISTINCT p_brand AS brand FROM part WHERE p_size IN (1, 2, 3)",
    "bgp_subselect": "SELECT c_name AS name, max(o_totalprice) AS most FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING max(o_totalprice) > 400000",
    "bgp_group_expression": "SELECT split_part(o_orderpriority, '-', 1) AS level, count(*) AS n_orders FROM orders GROUP BY 1",
    "bgp_optional_then_join": """WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal > 9990 THEN c_nationkey END AS n FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT c_custkey, CAST(s_nationkey AS BIGINT) AS n_nationkey, count(*) AS n_suppliers FROM c JOIN supplier ON n IS NULL OR n = s_nationkey GROUP BY ALL""",
    "qnames": "SELECT p AS property, CASE WHEN p IN ('ex:inRegion') THEN n ELSE c END AS n FROM (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM nation) AS n), (SELECT unnest(['ex:segment', 'ex:balance', 'ex:nation', 'ex:inRegion']) AS p) UNION ALL SELECT unnest(['ex:name', 'rdf:type']), (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation)",
    "path_plus_reachability": f"""WITH RECURSIVE e AS (SELECT DISTINCT movie_id AS a, {_CANON.format('iri')} AS b FROM (SELECT movie_id, unnest(min(is_similar_to)) AS iri FROM movies GROUP BY movie_id) WHERE iri IS NOT NULL),
f AS (SELECT b FROM e WHERE a = 'tt900000015' UNION SELECT e.b FROM f JOIN e ON f.b = e.a),
t AS (SELECT a FROM e WHERE b = 'tt900000003' UNION SELECT e.a FROM t JOIN e ON t.a = e.b)
SELECT 'late' AS "from", b AS "to" FROM f UNION ALL SELECT 'to first', a FROM t""",
    "value_any_deterministic": "SELECT o_custkey, min(o_orderstatus) AS status FROM orders GROUP BY 1",
    "triples_per_graph": """WITH m AS (SELECT DISTINCT ON (movie_id) * FROM movies ORDER BY movie_id),
t AS (SELECT movie_id, 'name' AS p, name AS o FROM m UNION SELECT movie_id, 'genre', unnest(genre) FROM m UNION SELECT movie_id, 'lang', unnest(in_language) FROM m UNION SELECT movie_id, 'rating', content_rating FROM m UNION SELECT movie_id, 'type', 'Movie' FROM m)
SELECT movie_id, count(*) AS n_triples, count(DISTINCT p) AS n_predicates FROM t WHERE o IS NOT NULL GROUP BY 1""",
    "role_distinct_counts": "SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1",
    "typed_node_counts": "SELECT 'all' AS g, (SELECT count(*) FROM region) AS n_regions, (SELECT count(*) FROM nation) AS n_nations, (SELECT count(*) FROM supplier) AS n_suppliers",
    "name_resolution_all": r"""WITH p AS (SELECT DISTINCT ON (person_id) url, name, performer_in FROM persons ORDER BY person_id),
f AS (SELECT unnest(performer_in) AS s FROM p WHERE url IS NOT NULL),
n AS (SELECT url AS s FROM p WHERE url IS NOT NULL AND (name IS NOT NULL OR len(list_filter(performer_in, lambda x: x IS NOT NULL)) > 0) UNION SELECT s FROM f WHERE s IS NOT NULL),
b AS (SELECT url AS s, min(name) AS name FROM p GROUP BY url)
SELECT s, coalesce(name, split_part(regexp_replace(s, '/+$', ''), '/', -1)) AS name FROM n LEFT JOIN b USING (s)""",
    "graph_diff_metrics": _SIDES
    + """, n AS (SELECT (SELECT count(*) FROM a) AS t, (SELECT count(*) FROM b) AS u, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS c)
SELECT t AS n_truth, u AS n_tested, c AS n_common, t - c AS n_missing, u - c AS n_extra, round(c / u, 6) AS precision, round(c / t, 6) AS recall, round(2 * c / (t + u), 6) AS f1, round(c / t, 6) AS coverage, round(c / greatest(t, u), 6) AS accuracy, round(c / (t + u - c), 6) AS jaccard FROM n""",
    "graph_diff_sides": _SIDES + "SELECT o_orderkey, x.p AS property, x.v AS value, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT o_orderkey, x.p, x.v, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "decimal_normalise_diff": r"SELECT p_partkey, regexp_replace(regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(12,3)) AS VARCHAR), '(\.[0-9]*?)0+$', '\1'), '\.$', '') AS price FROM part",
    "iri_canonical_join": f"""WITH m AS (SELECT DISTINCT {_CANON.format('url')} AS id, name FROM movies), r AS (SELECT DISTINCT movie_id, {_CANON.format('iri')} AS id FROM (SELECT movie_id, unnest(is_similar_to) AS iri FROM movies))
SELECT movie_id, id, name FROM r JOIN m USING (id)""",
    "query_coverage": """WITH m AS (SELECT DISTINCT ON (movie_id) * FROM movies WHERE content_rating IS NOT NULL ORDER BY movie_id), g AS (SELECT DISTINCT content_rating AS g FROM m),
c AS (SELECT 'Q1' AS query, content_rating AS g FROM m WHERE starts_with(duration, 'PT2H5') UNION SELECT 'Q2', content_rating FROM m WHERE rating_value > 9.5)
SELECT q AS query, count(c.g) AS n_success, count(*) - count(c.g) AS n_empty, CAST(0 AS BIGINT) AS n_error, round(100.0 * count(c.g) / count(*), 4) AS pct FROM g CROSS JOIN (SELECT unnest(['Q1', 'Q2', 'Q10']) AS q) LEFT JOIN c ON c.g = g.g AND c.query = q GROUP BY q""",
    "sameas_links": "SELECT DISTINCT regexp_replace(trim(url), '/+$', '') || '/' AS s, 'http://www.wikidata.org/entity/Q' || person_id[3:] AS o FROM persons WHERE birth_place IS NOT NULL AND url IS NOT NULL AND trim(url) <> ''",
    "turtle_roundtrip": "SELECT p_partkey, p_name FROM part",
}
