"""Queries of the llm-tagged problems, over the whole tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import canonical, formatting, mixing, quality, tokens, vectors
from terraloom.runtime import read

CAMERA = ["make", "model", "lens_model"]
EXACT = ["sensor_width_px", "sensor_height_px", "focal"]


def _copies(spark: SparkSession, d: str) -> DataFrame:
    return formatting.collapse(read(spark, d, "camera_db_raw"), "ord", CAMERA, EXACT)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d).filter("id > first").select(F.col("first").alias("first_ord"), F.col("id").alias("ord")).distinct()


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """One record for each camera with the exact number of its copies."""
    raw = read(spark, d, "camera_db_raw").dropDuplicates(["ord"])
    return formatting.copies(_copies(spark, d)).join(raw, F.col("first") == F.col("ord")).select("ord", *CAMERA, *EXACT, "copies")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest_pairs(read(spark, d, "features"), "node_id", "idx", "descriptor").drop("bits")


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the true neighbours of every feature whose node_id is divisible by 50, how many the index finds."""
    f = read(spark, d, "features")
    true = vectors.exact_neighbours(f, "node_id", "idx", "descriptor", F.col("node") % 50 == 0)
    pairs = vectors.nearest_pairs(f, "node_id", "idx", "descriptor")
    a, b = F.struct(F.col("qnode").alias("n"), F.col("qidx").alias("i")), F.struct(F.col("node").alias("n"), F.col("idx").alias("i"))
    true = true.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), F.col("qnode").alias("node_id"), F.col("qidx").alias("idx"))
    got = pairs.select(F.struct(F.col("node_a").alias("n"), F.col("idx_a").alias("i")).alias("x"), F.struct(F.col("node_b").alias("n"), F.col("idx_b").alias("i")).alias("y"), F.lit(1).alias("hit"))
    return true.join(got, ["x", "y"], "left").groupBy("node_id", "idx").agg(F.count("*").alias("neighbours"), F.count("hit").alias("found"))


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_values(read(spark, d, "camera_log"), "log_id", read(spark, d, "camera_db"), "ord", CAMERA)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("log_id", "ord")


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that no single entry answers, with how often they were typed and how many entries were left."""
    return _mapped(spark, d).filter("ord = -1").groupBy(*CAMERA).agg(F.count("*").alias("rows"), F.max("candidates").alias("candidates"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(read(spark, d, "documents"), "doc_id", "text")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = read(spark, d, "documents")
    counted = tokens.token_counts(documents, "doc_id", "text")
    sized = documents.select("doc_id", "source").distinct().join(counted, "doc_id")
    return mixing.mix(sized, "doc_id", "source", "n_tokens", read(spark, d, "mix_targets"))


def p9_selected(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix, with how often each is used for which source."""
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached."""
    return _mixed(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.outlierness(read(spark, d, "documents"), "doc_id", "text").filter("form is not null").select("doc_id", "form")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of every text, its distance from prose and each statistic's part of it."""
    return quality.outlierness(read(spark, d, "documents"), "doc_id", "text")


def queries() -> dict:
    names = (p1_found, p1_records, p2_found, p2_recall, p4_found, p4_unmatched, p8_ids, p9_selected, p9_shares, p10_found, p10_statistics)
    return {f.__name__: f for f in names}


_P1_KEYS = r"""
WITH keyed AS (
  SELECT DISTINCT ord, array_to_string(list_sort([coalesce(regexp_replace(replace(lower(make), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g'), ''),
      coalesce(regexp_replace(replace(lower(model), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g'), ''), coalesce(regexp_replace(replace(lower(lens_model), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g'), '')]), chr(31)) AS k,
    sensor_width_px AS w, sensor_height_px AS h, CASE WHEN isnan(focal) THEN NULL ELSE focal END AS f
  FROM camera_db_raw),
firsts AS (SELECT ord, min(ord) OVER (PARTITION BY k, w, h, f) AS first_ord FROM keyed)
"""

_P2 = """WITH f AS (SELECT DISTINCT node_id, idx, descriptor AS d FROM features WHERE descriptor IS NOT NULL AND len(descriptor) = 8 AND len(list_filter(descriptor, lambda x: x <> 0)) > 0),
  p AS (SELECT a.node_id AS na, a.idx AS ia, b.node_id AS nb, b.idx AS ib, list_sum(list_transform(range(1, 9), lambda i: bit_count(xor(a.d[i], b.d[i])))) AS n FROM f a JOIN f b ON (a.node_id, a.idx) <> (b.node_id, b.idx)),
  k AS (SELECT *, row_number() OVER (PARTITION BY na, ia ORDER BY n, nb, ib) AS k FROM p WHERE n <= 96)
  SELECT DISTINCT CASE WHEN (na, ia) < (nb, ib) THEN na ELSE nb END AS node_a, CASE WHEN (na, ia) < (nb, ib) THEN ia ELSE ib END AS idx_a, CASE WHEN (na, ia) < (nb, ib) THEN nb ELSE na END AS node_b, CASE WHEN (na, ia) < (nb, ib) THEN ib ELSE ia END AS idx_b FROM k WHERE k <= 5"""


def oracle_sql() -> dict:
    return {
        "p2_found": _P2,
        "p1_found": _P1_KEYS + "SELECT first_ord, ord FROM firsts WHERE ord > first_ord",
        "p1_records": _P1_KEYS + "SELECT r.ord, r.make, r.model, r.lens_model, r.sensor_width_px, r.sensor_height_px, r.focal, c.copies FROM (SELECT first_ord, count(*) AS copies FROM firsts GROUP BY 1) c JOIN camera_db_raw r ON r.ord = c.first_ord",
    }
