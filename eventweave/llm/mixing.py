"""Mixing sources to target shares of all tokens, with a cap on repeats.

Sampling is that of Efraimidis and Spirakis: each document draws an exponential key divided by its quality weight, and a source's
documents are taken in order of keys until its token budget is met. Whole epochs of a source come before any such partial one.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from eventweave.session import materialise

#: Where the public vocabularies are, unless EVENTWEAVE_TOKENIZERS or the parameter says otherwise.
TOKENIZERS = "/opt/tokenizers"
#: The usual splitting pattern of the byte-level vocabulary. Fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, *, doc_id: str, text: str, keep: list[str], folder: str | None = None, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, keep..., n_tokens): tokens of each whole text under a public tokenizer; null and empty texts have 0."""
    path = os.path.join(folder or os.environ.get("EVENTWEAVE_TOKENIZERS", TOKENIZERS), vocabulary)
    kinds = dict(docs.dtypes)
    # Ids and what is kept travel in one column, untouched: pandas would make floats of integers beside nulls.
    rows = docs.select(F.to_json(F.struct(F.col(doc_id).cast("string").alias("id"), *[F.col(f"`{c}`").cast("string").alias(f"k{i}") for i, c in enumerate(keep)])).alias("kept"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(path)
        for pdf in batches:
            yield pd.DataFrame({"kept": pdf["kept"], "n_tokens": [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in pdf["text"]]})

    fields = F.from_json("kept", ", ".join(["id string", *[f"k{i} string" for i in range(len(keep))]]))
    counted = rows.mapInPandas(run, "kept string, n_tokens bigint").withColumn("f", fields)
    return counted.select(F.col("f.id").cast(kinds[doc_id]).alias(doc_id), *[F.col(f"f.k{i}").cast(kinds[c]).alias(c) for i, c in enumerate(keep)], "n_tokens")


def quality_weight(text: Column) -> Column:
    """A weight in 0.1 to 1 from what commonly tells running text from tables, logs, menus and fragments; 0.1 for null and empty texts.

    The product of four shares, each 1 for plain prose: letters and spaces among the characters; distinct lines among the lines that aren't
    blank; length, up to 20 words; and how near the mean length of words comes to 3 to 10 letters.
    """
    n = F.length(text)
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\s]", "")) / n
    many = n - F.length(F.replace(text, F.lit(" "), F.lit(""))) + n - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    lines = F.split(text, "\n+")
    distinct = F.size(F.array_distinct(lines)) / F.size(lines)
    mean = n / many - 1
    usual = F.when(mean < 3, F.greatest(mean, F.lit(0.0)) / 3).when(mean > 10, 10 / mean).otherwise(1.0)
    weight = plain * distinct * F.least(many / 20, F.lit(1.0)) * usual
    return F.when(n > 0, F.greatest(F.lit(0.1), F.least(F.lit(1.0), weight))).otherwise(F.lit(0.1))


def _key(doc_id: Column, mix: Column, weight: Column, seed: int) -> Column:
    # A uniform draw in (0, 1) that depends on the document, the mix and the seed alone, so that lost tasks draw again the same.
    u = (F.pmod(F.xxhash64(doc_id, mix, F.lit(seed)), F.lit(2**52)).cast("double") + 0.5) / float(2**52)
    return -F.log(u) / weight


def _plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """One row per listed (mix_name, source): its tokens, the mix's total and the source's budget, whole epochs and rest."""
    listed = targets.where("mix_name is not null and source is not null and target_share > 0 and max_repeats >= 1").groupBy("mix_name", "source").agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").cast("bigint").alias("max_repeats")
    )
    joined = listed.join(sizes, "source", "left").fillna(0, ["source_tokens", "source_docs"])
    of_mix = W.partitionBy("mix_name")
    there = F.col("source_tokens") > 0
    live = F.sum(F.when(there, F.col("target_share"))).over(of_mix)
    planned = joined.withColumn("effective_share", F.when(there, F.col("target_share") / live).otherwise(0.0))
    most = F.min(F.when(there, F.col("max_repeats") * F.col("source_tokens") / F.col("effective_share"))).over(of_mix)
    if total_tokens is not None:
        most = F.least(most, F.lit(float(total_tokens)))
    planned = planned.withColumn("mix_tokens", F.floor(F.coalesce(most, F.lit(0.0)) + 1e-6))
    budget = F.least(F.round(F.col("mix_tokens") * F.col("effective_share")).cast("bigint"), F.col("max_repeats") * F.col("source_tokens"))
    planned = planned.withColumn("budget", budget)
    epochs = F.when(there, F.call_function("div", F.col("budget"), F.greatest(F.col("source_tokens"), F.lit(1)).cast("bigint"))).otherwise(0)
    return planned.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_tokens"))


def mix(docs: DataFrame, targets: DataFrame, *, weight: str | None = None, total_tokens: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(selection, report) for every mix of ``targets`` (mix_name, source, target_share, max_repeats).

    ``docs`` has doc_id, source, n_tokens and, if named, a weight. Selection: (mix_name, source, doc_id, n_tokens, copies), one row per
    document row taken at least once. Report: (mix_name, source, target_share, source_docs, source_tokens, budget, tokens, actual_share,
    most_copies), one row per listed source.

    A mix is as large as the caps allow with every share met, or ``total_tokens`` if that is less. Sources without tokens get nothing
    and the others their shares among themselves. The document at which the rest of a budget ends is taken if that comes nearer to the
    budget, so a source is off by half a document at most. Documents of null source or without tokens are never taken; weights that
    are null or not above 0 count as 1e-9; ties of keys are taken in order of doc_id. Empty tables give empty selections.
    """
    usable = docs.where("source is not null and n_tokens > 0").select("doc_id", "source", "n_tokens", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"))
    sizes = usable.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_docs"))
    # A row per listed source, read several times: written once, so that its size is known.
    plan = materialise(_plan(sizes, targets, total_tokens), "mix")
    wanted = plan.where("budget > 0").select("mix_name", "source", "epochs", "rest")
    weighed = F.when(F.col("__w") > 0, F.col("__w")).otherwise(F.lit(1e-9))
    drawn = usable.join(wanted, "source").withColumn("key", _key(F.col("doc_id"), F.col("mix_name"), weighed, seed))
    # Prefix sums in key order without ordering a whole source in one task: ranges of keys, even whatever the weights, are summed first,
    # then only the range in which the budget ends is ordered. Written once; sources that give whole epochs alone stay out.
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = drawn.where("rest > 0").repartitionByRange(ranges, "mix_name", "source", "key", "doc_id")
    ranged = materialise(ranged.select("mix_name", "source", "doc_id", "n_tokens", "epochs", "rest", "key", F.spark_partition_id().alias("range")), "drawn")
    by_range = ranged.groupBy("mix_name", "source", "range", "rest").agg(F.sum("n_tokens").alias("t"))
    upto = W.partitionBy("mix_name", "source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    border = by_range.withColumn("before", F.coalesce(F.sum("t").over(upto), F.lit(0)))
    # A row per listed source, written so that its size is known: broadcast under the threshold.
    border = materialise(border.where("before < rest and before + t >= rest").select("mix_name", "source", F.col("range").alias("border"), "before"), "border")
    at = ranged.join(border, ["mix_name", "source"])
    order = W.partitionBy("mix_name", "source").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    cut = at.where("range = border").withColumn("end", F.col("before") + F.sum("n_tokens").over(order)).withColumn("begin", F.col("end") - F.col("n_tokens"))
    cut = cut.withColumn("part", ((F.col("end") <= F.col("rest")) | ((F.col("begin") < F.col("rest")) & (F.col("end") - F.col("rest") <= F.col("rest") - F.col("begin")))).cast("int"))
    clear = at.where("range <> border").withColumn("part", (F.col("range") < F.col("border")).cast("int"))
    even = drawn.where("rest = 0").withColumn("part", F.lit(0))
    cols = ["mix_name", "source", "doc_id", "n_tokens", (F.col("epochs") + F.col("part")).cast("int").alias("copies")]
    selection = even.select(*cols).unionByName(clear.select(*cols)).unionByName(cut.select(*cols)).where("copies > 0")
    reached = selection.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    report = plan.join(reached, ["mix_name", "source"], "left").fillna(0, ["tokens", "most_copies"])
    total = F.sum("tokens").over(W.partitionBy("mix_name"))
    report = report.select(
        "mix_name", "source", "target_share", "source_docs", "source_tokens", "budget", "tokens",
        F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("actual_share"), "most_copies",
    )
    return selection, report
