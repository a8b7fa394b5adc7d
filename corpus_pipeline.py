"""A corpus from documents: quality, near duplicates, benchmark items, mixture, token ids.

Each stage gets all that the stage before kept, as a table with the columns of documents; the last one returns what the
files of token ids hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import persisted, scratch, table
from keyloom.llm.decontaminate import drop_contaminated
from keyloom.llm.mixing import mixed_documents
from keyloom.llm.quality import score_documents, train
from keyloom.llm.queries import tokenizer_path
from keyloom.llm.simhash import drop_similar
from keyloom.llm.token_store import read_tokens, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier predicts to be good.

    Null and empty texts are scored as empty ones. Rows that repeat, or share an id, are each judged by their own text, so
    equal texts stay or go together. Where nothing can be learnt (no labels, no positives, an empty table) all rows stay.
    Other columns, of any type, stay as they are, also ones named score or predicted.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    if not model.learnt:
        return docs
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col("text"))
    return score_documents(own, model).where("predicted = 1").select("own.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that SimHash links (4 bits, found by the covering family of op7) or a similarity
    of 0.8 over five words, of which samples' SimHashes make the candidates.

    The row of the smallest doc_id stays, null ids being the last; of rows with one id, that of the least text hash; of
    rows equal in both, one. An id that stands for other texts too does no harm. Null and empty texts are one group. Very
    long texts are compared whole. An empty table stays empty; other columns, of any type, are carried along.
    """
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item.

    Each row is judged by its own whole text: null and empty texts hold nothing and stay, repeated rows stay or go
    together. Without items all rows stay; an empty table stays empty; other columns are carried along.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mixture takes them: a row for each turn, cut to the words taken in its last one.

    Null and empty texts have no words to take and go; a null source is one of its own. Rows that repeat, or share an id,
    are taken on their own, each with its own columns, of any type. An empty table stays empty.
    """
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, read back from the files of token ids.

    Rows stand in ascending order of the id, null ids first, those with one id by the hash of their text; repeated rows
    each stay. A null or empty text has only the end id. Other columns are not read; an empty table gives no rows.
    """
    uri = scratch(spark, "tokens")
    write_tokens(docs, uri, tokenizer_path())
    return read_tokens(spark, uri, with_ids=False)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("tokens", tokens)]

#: The classifier's training, XXH64 and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = persisted(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
