"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.llm import collocations, mixing, ngram_join, order_minhash, personal_data, quality, ranked_search, repeats, sentence_pieces, sharding, toxicity, url_filter, wavelet
from placeweave.llm.shared import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(_table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(personal_data.KINDS)]
    base = F.sha2(personal_data.spans_text(F.col("base")), 256).alias("base_sha256")
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return found.select(F.col("id").alias("doc_id"), *counts, base, personal_data.spans_text(F.col("spans")).alias("spans"), n_spans)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, round_trip = sentence_pieces.piece_functions(spark, tokenizer_path("piece_bpe_32k.model"))
    read = _table(spark, sf_dir, "documents").select("doc_id", round_trip(F.col("text")).alias("r")).select("doc_id", "r.*")
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return read.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = _table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.assign_shards(sized)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Weights of the mix: by domain, domain/language, domain/language/source; all others are 1.
MIX_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d0/en": 3, "d1/en": 3, "d2/en": 2, "d3/en": 2, "d0/en/src0": 2}
MIX_PERCENT, MIX_EPOCHS = 80, 2


def source_domain() -> Column:
    """The tables have no domain column: a source's number modulo 4 stands for one."""
    return F.concat(F.lit("d"), (F.coalesce(F.regexp_extract(F.col("source"), "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0)) % 4).cast("string"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", mixing.word_tokens(F.col("text")).alias("n"))
    mixed = mixing.mix_sources(docs, source_domain(), F.col("lang"), F.col("source"), MIX_WEIGHTS, MIX_PERCENT, MIX_EPOCHS, n_tokens=F.col("n"))
    return mixed.select("doc_id", F.col("m_domain").alias("domain"), F.col("m_lang").alias("lang"), F.col("m_source").alias("source"), F.col("mix_tokens").alias("n_tokens"), "epochs")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = order_minhash.compare_edited(_table(spark, sf_dir, "documents"))
    return c.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        order_minhash.fingerprint(F.col("sig")).alias("fingerprint"), order_minhash.fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), order_minhash.likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), rule, strict=True)]) for rule in URL_RULES])
    rules = spark.range(1).select(F.inline(listed))
    return url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "wavelet")
    wavelet.write_token_shards(_table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return wavelet.read_token_shards(spark, path)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SEARCH_RESULTS = 50


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked_search.search_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), SEARCH_RESULTS)
    return found.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


PHRASES_PER_LANG = 2000


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents").select("text", "lang"), PHRASES_PER_LANG)


def held_out(doc_id: Column) -> Column:
    """A fifth of all ids, never learnt from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_personal_data": op1_personal_data,
    "op2_quality": op2_quality,
    "op3_sentence_pieces": op3_sentence_pieces,
    "op4_sharding": op4_sharding,
    "op5_mixing": op5_mixing,
    "op6_order_minhash": op6_order_minhash,
    "op7_ngram_join": op7_ngram_join,
    "op8_url_filter": op8_url_filter,
    "op9_wavelet": op9_wavelet,
    "op10_repeats": op10_repeats,
    "op11_ranked_search": op11_ranked_search,
    "op12_collocations": op12_collocations,
    "op13_toxicity": op13_toxicity,
}
