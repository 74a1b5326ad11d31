"""Registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotalake.llm import audit, chat, clusters, decontaminate, langid, lines, packing, pii, quality, simhash, substrings, topk, urls
from quotalake.llm.common import read_table
from quotalake.llm.sql import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents without the lines that match an earlier line."""
    docs = read_table(spark, sf_dir, "documents")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "n_near", "text")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document; learned outside the fold that is held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    fold = quality.fold(F.col("doc_id"))
    return quality.quality_scores(docs, labels, fold != 1, F.coalesce(fold == 1, F.lit(False)))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item."""
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.with_digest(packing.pack(read_table(spark, sf_dir, "documents")))


RULES = [urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"),
         urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/")]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return urls.judge_urls(read_table(spark, sf_dir, "pages"), RULES)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 4-word shingles, linked at 4 or fewer differing bits."""
    docs = read_table(spark, sf_dir, "documents")
    return simhash.simhash_near_duplicates(docs, shingle=4, max_bits=4)


PROBE = "\\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations and of a probe with control strings, read back from the output."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], turns.schema)
    return chat.digests(chat.read_back(chat.format_windows(turns.unionByName(probe))))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents without the words that 13-word windows of an earlier document cover."""
    found = substrings.dedup_substrings(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document: counts and digest of the patterns' spans, and all spans."""
    docs = read_table(spark, sf_dir, "documents")
    model = pii.train(*pii.training_windows(docs))
    found = pii.find_personal_data(docs, model)
    joined = lambda spans: F.array_join(F.transform(
        spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(spans, x -> x.base and x.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


LARGEST = (1 << 63) - 1


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer products of every 50th vector with all others.

    A score beyond a long is given as the largest or smallest long (by sign);
    ranks go by the exact scores.
    """
    # floor() of Spark ends at a long; larger doubles are whole already.
    whole = F.expr("""transform(embedding, x -> if(isnan(x) or abs(x) = float('infinity'), double(x),
        if(abs(double(x)) < 1e15, double(floor(256 * double(x))), 256 * double(x))))""")
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", whole.alias("vector"))
    found = topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5, whole=True)
    beyond = F.when(F.col("score") < 0, F.lit(-LARGEST)).otherwise(F.lit(LARGEST))
    return found.select("query_id", "rank", "vec_id", F.coalesce(F.col("exact").try_cast("long"), beyond).alias("score"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order of them, per source."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return audit.audit_filters(docs, labels)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds of integer k-means over all whole vectors of 64 components."""
    return clusters.cluster(read_table(spark, sf_dir, "embeddings"), k=8, rounds=10, width=64, scale=1024, seed=3)


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document; learned outside the fold that is held out."""
    docs = read_table(spark, sf_dir, "documents")
    fold = langid.fold(F.col("doc_id"))
    return langid.identify(docs, langid.fit(docs, fold != 2), F.coalesce(fold == 2, F.lit(False)))


def queries() -> dict[str, Query]:
    found = (op1_lines, op2_quality, op3_decontaminate, op4_packing, op5_urls, op6_simhash, op7_chat, op8_substrings, op9_pii, op10_topk,
             op11_audit, op12_clusters, op13_langid)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
