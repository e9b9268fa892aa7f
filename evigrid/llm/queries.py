"""The thin opN queries over the driver's tables: digests of what the operators return."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cap_filters import link_vectors
from .common import shared_dir
from .conversations import damage, digests, repair_conversations
from .importance import importance_resample
from .language_crf import CrfModel, label_languages, sample_rows
from .language_crf import fit_on_rows as fit_languages
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .mpegts import encode_media, parse_media
from .ngram_join import ngram_jaccard_join
from .packing import pack_by_retrieval
from .sharding import shard_by_ring
from .substring_dedup import substring_dedup
from .toxicity import ToxicModel, fit_on_rows, labelled_rows, score_toxicity
from .wavelet import read_documents, shard_table, write_shards


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def toxic_model(spark: SparkSession, sf_dir: str) -> ToxicModel:
    """Learned from at most 3000 labelled documents of either label, none of the held-out fold."""
    return fit_on_rows(*labelled_rows(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def tokenizer_files() -> dict[str, str]:
    """Paths of the public vocabulary files; never copied here."""
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document the mixture takes. Null sources are a source of their own, the last; null texts have size 0; repeated rows each have a place."""
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every whole text. Null and empty texts score like texts without a toxic window; without labels every text has the prior."""
    return score_toxicity(documents(spark, sf_dir), toxic_model(spark, sf_dir)).select("doc_id", held_out().alias("held_out"), "score", "predicted", "toxic_windows")


def op3_cap_filter_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every vector. Vectors that are null, zero or hold null or non-finite numbers link with nothing; lengths are compared apart."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def language_model(spark: SparkSession, sf_dir: str) -> CrfModel:
    """Learned from at most 2000 documents, none of the held-out fold."""
    return fit_languages(sample_rows(documents(spark, sf_dir)))


def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text; null texts and texts without a letter are `und` with score 0."""
    return label_languages(documents(spark, sf_dir), language_model(spark, sf_dir)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after its frequent lines went. Null texts are one empty line; rows that share an id count as one document."""
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_bytes and media_sha256 are of the stored stream; the payload is what its parse gives back."""
    read = parse_media(encode_media(documents(spark, sf_dir)))
    one = F.get(F.col("elementary"), F.lit(0))
    payload = F.coalesce(one["payload"], F.lit(b""))
    tail = F.crc32(F.substring(payload, F.greatest(F.lit(1), F.length(payload) - 15), F.lit(16)))
    feature = F.concat_ws(":", "programs", F.size("elementary"), "packets", one["units"], "faults", F.size(one["random_access"]), F.try_element_at(one["timestamps"], F.lit(-1)))
    return read.select(
        "doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), tail.alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and component of every document. Texts without words link with nothing; shorter ones than five words are one n-gram."""
    return ngram_jaccard_join(documents(spark, sf_dir)).drop("text_hash")


def op8_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document under the law `bytes`. Null texts have size 1; a null id's place is that of its text."""
    out = shard_by_ring(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document; null texts are the end id alone."""
    return pack_by_retrieval(documents(spark, sf_dir), **tokenizer_files()).drop("ids")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of repeated windows; null texts have no words, repeated rows remove each other's windows."""
    out = substring_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in wavelet-matrix shards in the shared folder, and what the shards give back."""
    path = f"{shared_dir(spark)}/evigrid/wavelet-{uuid.uuid4().hex}"
    write_shards(documents(spark, sf_dir), path, **tokenizer_files())
    return read_documents(shard_table(spark, path))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage and repair; those that lost all their rows have zeros, no edits and the digest of nothing."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    repaired = repair_conversations(damage(talks))
    out = talks.select("conv_id").distinct().alias("t")
    for name, part in (("s", repaired.summary), ("d", digests(repaired.rows))):
        out = out.join(part.alias(name), F.col("t.conv_id").eqNullSafe(F.col(f"{name}.conv_id")), "left")
    counts = [F.coalesce(F.col(f"s.{c}"), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("t.conv_id", *counts, F.coalesce("s.audit", F.lit("")).alias("audit"), F.coalesce("d.repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the texts of benchmark; undrawn ones have no rank."""
    drawn = importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_source_mix, op2_toxicity_compression, op3_cap_filter_links, op4_language_crf, op5_line_dedup, op6_transport_streams,
        op7_ngram_jaccard_join, op8_bounded_ring, op9_retrieval_packing, op10_substring_dedup, op11_wavelet_shards, op12_conversation_repair, op13_importance_resampling,
    )
}
