"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bloomlm, decontam, idfiles, mixing, neardup, oracles, quality, secret_scan, sharding, toxicity, warc
from pagewright.llm.common import PACKED, crc_class


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the deduplicated archives of ``pages``, read back from them; the archives stay in the shared folder."""
    back, _ = warc.deduplicated_archives(spark, table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest of base spans and all spans of the secrets in every document."""
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(secret_scan.KINDS[: secret_scan.BASE_KINDS]))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the trees' verdict on every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, forest).select(f"{PACKED}.doc_id", *quality.COUNTS, "base_failed", "kept", "probability")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document; the smallest doc_id of a component is kept."""
    marked = neardup.components_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact base score and the model's score of every document, learnt from those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = bloomlm.scores(docs, docs.where(~bloomlm.held_out()))
    return scored.select("doc_id", bloomlm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, number and checksum of every document's ids, read back from the files; these stay in the shared folder."""
    import public_tokenizers

    back, _ = idfiles.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return back


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows, items found and verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort("items"), ",")
    return found.select(f"{PACKED}.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a classifier that saw no held-out label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    held = F.coalesce(crc_class("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by the law ``key``."""
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, beside its source's size and target."""
    report = mixing.mix_report(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return report.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_revisits, op2_secret_scan, op3_quality_rules, op4_near_duplicates, op5_bloom_lm, op6_token_ids, op7_decontamination, op8_toxicity, op9_sharding, op10_source_mix)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
