"""The corpus pipeline: quality rules, near-duplicate removal, personal data, mixing, tokenization.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; every stage's result is written
as Parquet and read again. All stages but the last return the columns of documents.

Defined results: a null or blank text has no words and fails the quality rules; of near duplicates the row with the
smallest id stays, rows without an id coming last, and rows with one id and different texts are documents of their
own; a null language or source goes by the name ``null``; texts may be of any length. Columns beyond those of
documents are kept, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.llm import mixing, ngram_join, personal_data, quality, sentence_pieces
from placeweave.llm.queries import MIX_WEIGHTS, source_domain, tokenizer_path
from placeweave.llm.shared import join_hot, materialize, maybe_in, only_result, packed

#: Share of all tokens that the mix takes. One epoch only: repeats would undo the removal of near duplicates.
MIX_PERCENT = 90


def _rows(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all columns as one, so that no name clashes with an operator's."""
    return docs.select(packed(docs).alias("document"), *names)


def _documents(rows: DataFrame, names: list[str], text: Column | None = None) -> DataFrame:
    """The columns of documents again, with another text if one is given, and n_chars to match where there is such a column."""
    new = {} if text is None else {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    rows = rows if text is None else rows.select("document", text.alias("new_text"))
    return rows.select(*[new[c].alias(c) if c in new else F.col("document").getField(c).alias(c) for c in names])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failing lines."""
    kept = quality.quality_rules(_rows(docs, "text")).where("kept")
    return _documents(kept, docs.columns, F.col("clean_text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return ngram_join.one_of_each(docs)


def personal_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by the name of its kind. Most texts without any are not shuffled."""
    keys = personal_data.DIGESTS
    spans = lambda: personal_data.find_personal_data(docs).where(F.size("spans") > 0).groupBy(*keys).agg(F.first("spans").alias("spans"))
    found = only_result(spans, "spans-by-text")
    marked = maybe_in(personal_data.with_digests(_rows(docs, "text")), keys[0], found.select(keys[0]))
    joined = join_hot(marked.where("maybe").drop("maybe"), found, keys, "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(personal_data.redact(F.col("text"), F.col("spans")))
    return _documents(joined, docs.columns, text).union(_documents(marked.where("not maybe"), docs.columns, F.col("text")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's token prefix under the target weights."""
    rows = _rows(docs, "doc_id", "lang", "source", "text")
    mixed = mixing.mix_sources(rows, source_domain(), F.col("lang"), F.col("source"), MIX_WEIGHTS, MIX_PERCENT)
    return _documents(mixed.where("epochs > 0"), docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the round trip's verdict."""
    *_, round_trip = sentence_pieces.piece_functions(spark, tokenizer_path("piece_bpe_32k.model"))
    coded = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), round_trip(F.col("text")).alias("r"))
    checked = coded.select("doc_id", "source", "text", "r.*")
    same = F.col("decoded") == F.replace(F.col("text"), F.lit(sentence_pieces.SPACE), F.lit(" "))
    return checked.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("personal data", personal_spans),
    ("mixing", mixture),
    ("sentence pieces", token_ids),
]

#: The personal-data and tokenization stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
