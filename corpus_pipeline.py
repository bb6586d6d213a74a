"""The corpus pipeline: four stages over ``documents``, each written as Parquet and read back by the next.

toxicity         documents whose score reaches 0.5 go
near_duplicates  one document of each group of exact and near copies stays, the one with the smallest doc_id (null last)
decontamination  documents that hold a benchmark item within its edit budget go
bpe              the last stage: token counts and digests of what was kept, for a null doc_id too

Every row is decided by its own text, whether its doc_id is null or occurs again: rows that share an id but not the text are
different documents.  Null and empty texts are scored as clean, and are copies of one another; rows that
are equal in all columns are copies too.  Columns beyond those of documents are dropped.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlake.llm import _common, bpe, decontamination, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = _common.table(spark, sf_dir, "labels")
    keyed = docs.select(*COLUMNS)
    model = toxicity.fit(keyed, labels, toxicity.TRAINING)
    scored = toxicity.score(keyed, model, carry=COLUMNS)
    return scored.where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.select(*COLUMNS)
    stay = simhash.near_duplicate_leaders(keyed, "doc_id", "text", **simhash.NEAR)
    # rows are known by id and text; a null id counts as the least number, as equal texts are of one class anyway
    number = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id")
    stay = stay.select(number, F.col("text_hash").alias("_hash"))
    rows = keyed.select("*", number, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash")).join(stay, ["_id", "_hash"], "left_semi")
    # of rows that share id and text one stays: the least is taken in each task before the shuffle, so a million of them are no hot key
    rest = [c for c in COLUMNS if c != "text"]
    return rows.groupBy("_id", "_hash").agg(F.min(F.struct("text", *rest[1:], rest[0])).alias("x")).select(*[F.col(f"x.{c}") for c in COLUMNS])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = _common.table(spark, sf_dir, "benchmark")
    return decontamination.without_leaks(docs.select(*COLUMNS), benchmark)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]
#: SQL can express none of the stages' scores; the tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written to the shared folder and read again."""
    docs = _common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
