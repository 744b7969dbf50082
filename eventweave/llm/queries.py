"""Queries of the training-data operators over the whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweave.llm import leaks, mixing, quantiles, truncation
from eventweave.operators.merge import with_position
from eventweave.session import materialise, spread, table

EPS = 0.01
PERCENTS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*columns))


def _daily_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of `vlm` and one of `cl` for each symb, feed and UTC day of arrival."""
    bars = table(spark, sf_dir, "cdf_bars").select("symb", "feed", F.to_date("recv_at").alias("day"), "vlm", "cl")
    return quantiles.digests(bars, ["symb", "feed", "day"], ["vlm", "cl"], EPS)


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each symb, from the merged digests of its days and feeds."""
    return quantiles.quantiles(_daily_digests(spark, sf_dir), ["symb"], PERCENTS, EPS)


def p4_rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each percentile the true one, by its rank among all rows, if what the merged digest gave keeps its bound, else null.

    The bound is that of `quantiles`: at least `want` rows are no greater than the value, fewer than want + rank_error are less, and
    rank_error is within EPS of all rows.
    """
    found = materialise(p4_percentiles(spark, sf_dir).where("symb is not null"), "percentiles").withColumnRenamed("n", "of")
    found = found.withColumn("want", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("of") - 1e-9)))
    bars = table(spark, sf_dir, "cdf_bars").select("symb", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x")) for c in ("vlm", "cl")])))
    rows = bars.where("x is not null and symb is not null")
    by = ["symb", "field"]
    counts = rows.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("m"))
    ranks = found.join(counts, by).groupBy(*by, "q", "of", "want", "rank_error").agg(
        F.sum("m").alias("n"), F.sum(F.when(F.col("x") <= F.col("value"), F.col("m")).otherwise(0)).alias("upto"), F.sum(F.when(F.col("x") < F.col("value"), F.col("m")).otherwise(0)).alias("less")
    )
    kept = (F.col("of") == F.col("n")) & (F.col("upto") >= F.col("want")) & (F.col("less") < F.col("want") + F.col("rank_error")) & (F.col("rank_error") <= EPS * F.col("n"))
    true = with_position(rows, "x", "want", by=by)
    return ranks.join(true, [*by, "want"]).select(*by, "q", F.col("n").cast("bigint").alias("n"), F.when(kept, F.col("x")).alias("percentile"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items they leak."""
    return leaks.find_leaks(_documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item that leaked, in how many documents and at most which share of its own words."""
    found = leaks.find_leaks(_documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.max("share"), 4).alias("most"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _documents(spark, sf_dir, "doc_id", "source", "text").withColumn("weight", mixing.quality_weight(F.col("text")))
    counted = materialise(mixing.token_counts(docs, doc_id="doc_id", text="text", keep=["source", "weight"]), "tokens")
    return mixing.mix(counted, table(spark, sf_dir, "mix_targets"), weight="weight")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix and how often each is used."""
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of each source in each mix."""
    return _mixed(spark, sf_dir)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncation.find_truncated(_documents(spark, sf_dir, "doc_id", "source", "text"))[0].where("cut").select("doc_id")


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source its texts, those cut off by what told them, their share, and the field limit that shows."""
    verdicts, limits = truncation.find_truncated(_documents(spark, sf_dir, "doc_id", "source", "text"))
    told = [F.count_if(F.col("reason") == r).alias(f"by_{r}") for r in ("limit", "mark", "block", "ending")]
    per = verdicts.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("cut").alias("n_cut"), *told)
    return per.withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_texts"), 6)).join(limits.select("source", "measure", "field_limit"), "source", "left")


QUERIES = {f.__name__: f for f in (p4_percentiles, p4_rank_check, p6_found, p6_items, p7_mixture, p7_shares, p8_found, p8_sources)}

_VALUES = """v AS (SELECT symb, 'vlm' AS field, CAST(vlm AS DOUBLE) AS x FROM cdf_bars UNION ALL SELECT symb, 'cl', CAST(cl AS DOUBLE) FROM cdf_bars),
        r AS (SELECT symb, field, x, row_number() OVER (PARTITION BY symb, field ORDER BY x) AS rank, count(*) OVER (PARTITION BY symb, field) AS n FROM v WHERE x IS NOT NULL AND symb IS NOT NULL),
        p(q) AS (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE))"""

#: Where the answer follows from the tables alone. The other operators sample, score or parse; tests/llm hold them against brute force.
ORACLE = {
    # Groups of fewer than BITS / EPS = 6,300 rows have exact digests, as all have up to sf0.01.
    "p4_percentiles": f"""WITH {_VALUES} SELECT symb, field, q, x AS value, n, CAST(0 AS BIGINT) AS rank_error FROM r JOIN p ON rank = greatest(1, CAST(ceil(q * n - 1e-9) AS BIGINT))""",
    "p4_rank_check": f"""WITH {_VALUES} SELECT symb, field, q, n, x AS percentile FROM r JOIN p ON rank = greatest(1, CAST(ceil(q * n - 1e-9) AS BIGINT))""",
}
