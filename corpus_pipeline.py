"""Corpus preparation in stages; each stage's result is written and read again as the next one's documents.

Defined cases, of all stages: only ``COLUMNS`` go on, so further columns with any name do no harm; null doc_ids are
documents of their own and stay with every row until the end; null and empty texts are judged by the classifier like
others, are near copies of nothing, hold no benchmark passage, and leave at the mix, which takes no word of them; rows
that repeat a doc_id are judged one by one, of rows that repeat a whole text one group is kept; ties end on the smaller
doc_id; an empty table gives an empty table of tokens. Every stage bounds the session's Arrow batches by ``BATCH_BYTES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from socialspark.llm import decontaminate, minhash_dedup, quality_qda, source_mix, token_output
from socialspark.sources.scratch import cut, discard
from socialspark.sources.tables import table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Of a stage's texts on their way to Python and back. Spark's 64 MB a batch, several times over for each task, is much of an executor.
BATCH_BYTES = "8m"
#: A worker that has encoded lives on in the next stages with what it remembers; more pieces would save time here, at some 130 bytes each.
MEMO_ENTRIES = 100_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant accepts; it learns from the labels of ``docs``."""
    _small_batches(spark)
    model = quality_qda.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(*COLUMNS)
    return quality_qda.scores(rows, model, keep=list(COLUMNS)).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts at similarity 0.8 or more on five-word shingles."""
    _small_batches(spark)
    return minhash_dedup.drop_near_copies(docs.select(*COLUMNS), k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    _small_batches(spark)
    return decontaminate.decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights takes them."""
    _small_batches(spark)
    return source_mix.apply_mix(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file, read back: doc_id, start, n_tokens, tokens."""
    _small_batches(spark)
    return token_output.token_table(docs, tokenizer_path(), END_ID, memo_entries=MEMO_ENTRIES)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
    ("token output", tokens),
]
#: The stages use a trained model, sketches and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(docs)  # the stage before; the given table is left alone
        docs = kept
    out = STAGES[-1][1](spark, docs, sf_dir)  # written, and read back from its own files
    discard(docs)
    return out
