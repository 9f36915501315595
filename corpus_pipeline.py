"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, sampled segmentations.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before
the next. All but the last return the columns of docs; each works on all rows that the one before kept.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlens.llm import decontaminate, language, near_dup, queries, scratch, secrets, segment

#: Texts of which the best language's filter covers less than this share of all n-grams are rejected. Clean texts
#: of sf0.01 have 0.66 and more; those in a language that was left out (sf0.001) 0.46 at most, random letters 0.05.
LEAST_COVERAGE = 0.55
#: So are texts of which the second language covers as much but for this share; clean ones differ by 0.16 and more.
LEAST_MARGIN = 0.02


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose predicted language is a learned one, by LEAST_COVERAGE and LEAST_MARGIN.

    The filters learn as in op3: from the rows of docs with a lang and an id remainder other than 0.
    Null, empty and letterless texts go; where no row has a lang, nothing is learned and all rows go.
    """
    scratch.small_batches(spark)
    filters = language.fit(docs, queries.id_remainder(5) != 0)
    taken = {c: n for c, n in zip(language.ADDED, scratch.fresh(docs, *language.ADDED)) if c in docs.columns}
    found = language.predict(docs.withColumnsRenamed(taken), filters)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("coverage") >= LEAST_COVERAGE) & (F.col("margin") >= LEAST_MARGIN)).drop(*language.ADDED)
    return kept.withColumnsRenamed({n: c for c, n in taken.items()}).select(*docs.columns)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the least doc_id."""
    return near_dup.deduplicated(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap no item of the table benchmark."""
    return decontaminate.decontaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced."""
    return secrets.redacted(docs)


def sample_segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each row's text with their ids, several rows for each."""
    return segment.sample_segmentations(docs, queries.PIECE_MODEL)


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_class),
    ("decontamination", drop_benchmark_passages),
    ("secrets", redact_secrets),
    ("segmentations", sample_segmentations),
]

#: Sampling, hashing and learned models are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table documents, each one's rows written to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
