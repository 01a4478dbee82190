"""Query analysis as Columns: identifiers and quoted phrases decide a query's kind and the weights of its signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderfind.functions.text import strip

TICKET = r"\b[A-Z][0-9A-Z]{1,9}-[0-9]+\b"
CODED = r"\b(?:ERRNO|HRESULT|SQLSTATE)\s+[A-Fa-f0-9]+\b"
CONSTANT = r"\b[A-Z][0-9A-Z]*(?:[_][0-9A-Z]+)+\b"
PHRASE = r'"([^"]+)"'


def identifiers(query: Column) -> Column:
    """Tickets, then coded errors, then constants; each once."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(query, F.lit(p), F.lit(0)) for p in (TICKET, CODED, CONSTANT)]))


def phrases(query: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(query, F.lit(PHRASE), F.lit(1)), strip), lambda p: p != "")


def analyze(queries: DataFrame, text: str = "text", lexical_boost: float = 2.0) -> DataFrame:
    """Adds kind (empty, identifier, phrase, natural), dense_weight, lexical_weight, identifiers and phrases."""
    if lexical_boost <= 0:
        raise ValueError("lexical_boost is positive")
    q = F.coalesce(F.col(text), F.lit(""))
    out = queries.withColumns({"identifiers": identifiers(q), "phrases": phrases(q)})
    kind = F.when(strip(q) == "", "empty").when(F.size("identifiers") > 0, "identifier").when(F.size("phrases") > 0, "phrase").otherwise("natural")
    boosted = F.when(F.col("kind").isin("identifier", "phrase"), float(lexical_boost)).otherwise(1.0)
    return out.withColumn("kind", kind).withColumn("dense_weight", F.lit(1.0)).withColumn("lexical_weight", boosted)
