"""Triples as DataFrames: lifting tables, canonical ids, storage by predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a triple table. g: graph; *_kind: 'I' IRI, 'B' blank node, 'L' literal; o_dt, o_lang: of literals.
COLUMNS = ["g", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]

#: Well-known namespaces.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "schema": "http://schema.org/",
}
RDF_TYPE = PREFIXES["rdf"] + "type"

_XSD = {"string": "string", "boolean": "boolean", "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "double", "double": "double", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime"}


def expand(curie: str, prefixes: dict[str, str] | None = None) -> str:
    """The IRI of a prefixed name; anything else stays as it is."""
    known = PREFIXES | (prefixes or {})
    prefix, colon, local = curie.partition(":")
    return known[prefix] + local if colon and prefix in known else curie


def expand_column(term: Column, prefixes: dict[str, str] | None = None) -> Column:
    """Prefixed names to IRIs, by row; IRIs and names of unknown prefix stay as they are."""
    pairs = [x for k, v in (PREFIXES | (prefixes or {})).items() for x in (F.lit(k), F.lit(v))]
    base = F.try_element_at(F.create_map(*pairs), F.substring_index(term, ":", 1))
    return F.when(term.startswith("http") | ~term.contains(":") | base.isNull(), term).otherwise(F.concat(base, F.regexp_replace(term, "^[^:]*:", "")))


def qname(iri: Column, prefixes: dict[str, str] | None = None) -> Column:
    """IRIs to prefixed names, by row, with the longest namespace that fits; what fits none stays as it is."""
    out = iri
    for prefix, base in sorted((PREFIXES | (prefixes or {})).items(), key=lambda x: len(x[1])):
        local = F.substring(iri, len(base) + 1, 1 << 30)
        out = F.when(iri.startswith(base) & local.rlike(r"^[\w.-]+$"), F.concat(F.lit(prefix + ":"), local)).otherwise(out)
    return out


def canonical_id(iri: Column) -> Column:
    """The id within an entity's IRI (``…/title/tt1/``, ``…/name/nm1?x``), or the IRI itself: joins graphs that write
    IRIs with and without slash."""
    found = F.regexp_extract(iri, r"/(?:title|name|company)/((?:tt|nm|co)[0-9]+)(?:[/?#].*)?$", 1)
    return F.when(found != "", found).otherwise(iri)


def _cells(values: Column, predicate: str, datatype: str | None) -> Column:
    """One structure per value: literals of a datatype, or IRIs without one."""
    kind = "I" if datatype is None else "L"
    return F.transform(values, lambda v: F.struct(F.lit(predicate).alias("p"), v.alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("o_dt")))


def _is_scan(df: DataFrame) -> bool:
    """Whether ``df`` only reads, filters and computes, so that reading it again for another column costs no more."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not any(x in plan for x in ("Aggregate", "Join", "Window", "Sort", "Distinct", "Deduplicate", "Repartition", "Generate", "Python", "Pandas"))


def lift(df: DataFrame, graph: Column, subject: Column, properties: dict[str, Column | str], rdf_type: str | None = None, iris: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a table as triples: one per row and property that is not null.

    ``properties`` maps predicates to columns; array columns give one triple per element. Predicates in ``iris`` have
    IRIs as objects, all others literals of the column's type. Of a plain scan the triples are a union with one branch
    per predicate: a pattern with a bound predicate then keeps only that branch, and the scan reads only its columns. What
    is computed (an aggregate, a join) is taken apart in one pass instead.
    """
    cells = []
    columns = {p: F.col(c) if isinstance(c, str) else c for p, c in properties.items()}
    probe = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns.values())])
    for (p, c), (_, kind) in zip(columns.items(), probe.dtypes, strict=True):
        element = kind[6:-1] if kind.startswith("array<") else kind
        datatype = PREFIXES["xsd"] + ("decimal" if element.startswith("decimal") else _XSD.get(element, "string"))
        cells.append((expand(p), c.cast("array<string>") if kind.startswith("array<") else c.cast("string"), kind.startswith("array<"), None if p in iris else datatype))
    if rdf_type:
        cells.append((RDF_TYPE, F.lit(expand(rdf_type)), False, None))
    if not cells:
        cells.append((RDF_TYPE, F.lit(None).cast("string"), False, None))
    g, s = graph.cast("string").alias("g"), subject.cast("string").alias("s")
    constant = lambda p, datatype: [F.lit(p).alias("p"), F.lit("I" if datatype is None else "L").alias("o_kind"), F.lit(datatype).cast("string").alias("o_dt")]
    if _is_scan(df):
        rows = None
        for p, c, several, datatype in cells:
            own = df.select(g, s, (F.explode(c) if several else c).alias("o"), *constant(p, datatype))
            rows = own if rows is None else rows.union(own)
    else:
        values = [_cells(c if several else F.array(c), p, datatype) for p, c, several, datatype in cells]
        every = F.flatten(F.array(*[F.coalesce(v, F.array().cast("array<struct<p:string,o:string,o_kind:string,o_dt:string>>")) for v in values]))
        rows = df.select(g, s, F.explode(every).alias("t")).select("g", "s", "t.o", "t.p", "t.o_kind", "t.o_dt")
    return rows.where("o is not null and s is not null").select("g", "s", F.lit("I").alias("s_kind"), "p", "o", "o_kind", "o_dt", F.lit(None).cast("string").alias("o_lang"))


def as_graph(triples: DataFrame) -> DataFrame:
    """Set semantics: repeated triples of a graph vanish."""
    return triples.dropDuplicates(COLUMNS)


def write_store(triples: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 10_000_000) -> None:
    """Triples in one folder per predicate, sorted by subject, so that a pattern reads only its own predicate.

    A predicate goes to as many tasks as its triples need, so that no task gets all of a frequent one.
    """
    tasks = triples.groupBy("p").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / rows_per_file)).cast("int").alias("_tasks"))
    rows = triples.select(*COLUMNS).join(tasks, "p").withColumn("_part", F.pmod(F.xxhash64("g", "s"), F.col("_tasks")))
    rows.repartition("p", "_part").sortWithinPartitions("p", "s").select(*COLUMNS).write.mode(mode).partitionBy("p").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """What write_store wrote."""
    return spark.read.parquet(path).select(*COLUMNS)


def to_ntriples(triples: DataFrame) -> DataFrame:
    """One column ``value`` with a line of N-Triples per triple; graphs are not part of it."""
    escaped = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    node = lambda kind, term: F.when(kind == "B", F.concat(F.lit("_:"), F.regexp_replace(term, "[^A-Za-z0-9]", "x"))).otherwise(F.concat(F.lit("<"), term, F.lit(">")))
    plain = F.col("o_dt").isNull() | (F.col("o_dt") == PREFIXES["xsd"] + "string")
    suffix = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(plain, F.lit("")).otherwise(F.concat(F.lit("^^<"), F.col("o_dt"), F.lit(">")))
    literal = F.concat(F.lit('"'), escaped, F.lit('"'), suffix)
    obj = F.when(F.col("o_kind") == "L", literal).otherwise(node(F.col("o_kind"), F.col("o")))
    return triples.select(F.concat(node(F.col("s_kind"), F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), obj, F.lit(" .")).alias("value"))
