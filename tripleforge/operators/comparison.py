"""Comparison of two graphs: normalised triples, differences both ways, and measures of agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleforge.operators.store import PREFIXES, expand_column

_NUMBERS = [PREFIXES["xsd"] + t for t in ("decimal", "integer", "double", "float")]


def decimal_text(text: Column) -> Column:
    """A number's text without a fraction of zeros (``200.0`` is ``200``); other text as it is."""
    number = text.try_cast("decimal(38,10)")
    plain = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(plain, text)


def normalised(triples: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Distinct triples in a form in which equal ones are equal text.

    Blank nodes become one constant, so structure hanging on them is compared by content only; prefixed names become
    IRIs; decimals lose their zeros; a literal is its text, datatype and language.
    """
    return _normal(triples, prefixes).distinct()


def _normal(triples: DataFrame, prefixes: dict[str, str] | None, *kept: str) -> DataFrame:
    node = lambda kind, term: F.when(kind == "B", F.lit("_blank")).otherwise(expand_column(term, prefixes))
    value = F.when(F.col("o_dt").isin(_NUMBERS[:1]), decimal_text(F.col("o"))).otherwise(F.col("o"))
    literal = F.concat_ws("|", value, F.coalesce("o_dt", F.lit(PREFIXES["xsd"] + "string")), F.coalesce("o_lang", F.lit("")))
    return triples.select(*[F.col(c) for c in kept], node(F.col("s_kind"), F.col("s")).alias("s"), expand_column(F.col("p"), prefixes).alias("p"), F.when(F.col("o_kind") == "L", literal).otherwise(node(F.col("o_kind"), F.col("o"))).alias("o"))


def difference(truth: DataFrame, tested: DataFrame) -> DataFrame:
    """(s, p, o, side): triples of the truth only ('missing') and of the tested graph only ('extra')."""
    both = _sides(truth, tested)
    return both.where("not (a and b)").select("s", "p", "o", F.when(F.col("a"), "missing").otherwise("extra").alias("side"))


def _sides(truth: DataFrame, tested: DataFrame) -> DataFrame:
    """Each triple with the sides that have it: one aggregation, reducing within partitions first."""
    rows = truth.select("s", "p", "o", F.lit(True).alias("a"), F.lit(False).alias("b")).union(tested.select("s", "p", "o", F.lit(False), F.lit(True)))
    return rows.groupBy("s", "p", "o").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))


def agreement(truth: DataFrame, tested: DataFrame) -> DataFrame:
    """One row: sizes, common, missing, extra, precision, recall, F1, coverage, accuracy, Jaccard.

    A measure whose denominator is 0 is 0. Coverage is the recall; accuracy divides by the larger graph.
    """
    n = _sides(truth, tested).agg(F.count_if("a").alias("n_truth"), F.count_if("b").alias("n_tested"), F.count_if(F.col("a") & F.col("b")).alias("n_common"))
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    common, truth_n, tested_n = F.col("n_common"), F.col("n_truth"), F.col("n_tested")
    return n.select(
        "n_truth", "n_tested", "n_common", (truth_n - common).alias("n_missing"), (tested_n - common).alias("n_extra"),
        ratio(common, tested_n).alias("precision"), ratio(common, truth_n).alias("recall"), ratio(2 * common, truth_n + tested_n).alias("f1"),
        ratio(common, truth_n).alias("coverage"), ratio(common, F.greatest(truth_n, tested_n)).alias("accuracy"), ratio(common, truth_n + tested_n - common).alias("jaccard"),
    )


def originals(triples: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(s, p, o, original_s, original_p, original_o): each normalised triple with the least of those it stands for."""
    raw = triples.select(F.struct(F.col("s").alias("original_s"), F.col("p").alias("original_p"), F.col("o").alias("original_o")).alias("_r"), *triples.columns)
    kept = _normal(raw, prefixes, "_r")
    return kept.groupBy("s", "p", "o").agg(F.min("_r").alias("_r")).select("s", "p", "o", "_r.*")


def grouped_by_subject(triples: DataFrame) -> DataFrame:
    """(s, n, lines): the predicates and objects of each subject in sorted order."""
    return triples.groupBy("s").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.concat_ws(" ", "p", "o"))).alias("lines"))
