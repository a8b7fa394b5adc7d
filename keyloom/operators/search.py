"""Full-text search over an inverted index of normalised words, kept by partition and status group.

Relevance: the number of the query's words that a record holds, all of them being required unless asked otherwise; ties go
by id. BM25 is offered as another score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.text import normalize, normalize_value, status_group
from keyloom.operators.query import Table
from keyloom.plans.schema import SchemaError


def search_text(table: Table, df: DataFrame | None = None) -> DataFrame:
    """part, grp, id and norm (the normalised text) of records; empty texts are left out."""
    s, df = table.schema, table.data if df is None else df
    if not s.text:
        raise SchemaError(f"table {s.name} declares no text")
    status = F.col(s.status) if s.status and s.status in df.columns else None
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in s.text])
    rows = df.select(F.col(s.partition).alias("part"), status_group(status).alias("grp"), F.col(s.keys[0]).alias("id"), normalize(text).alias("norm"))
    return rows.where("norm <> ''")


def postings(texts: DataFrame) -> DataFrame:
    """part, grp, id, word, n (its number in the text) and length."""
    words = texts.withColumn("_w", F.split("norm", " "))
    each = words.select("part", "grp", "id", F.size("_w").alias("length"), F.explode("_w").alias("word"))
    return each.groupBy("part", "grp", "id", "word", "length").agg(F.count(F.lit(1)).alias("n"))


def upsert(index: DataFrame, written: Table) -> DataFrame:
    """The index with the written records in place of what it had of them, in either group."""
    ids = written.data.select(F.col(written.schema.partition).alias("part"), F.col(written.schema.keys[0]).alias("id")).distinct()
    return index.join(ids, ["part", "id"], "left_anti").select(*index.columns).unionByName(postings(search_text(written)))


def changed_texts(prev: Table, cur: Table) -> DataFrame:
    """Records of cur whose text or group is not the one of prev: the ones to index again."""
    old = search_text(prev).select("part", "id", F.col("grp").alias("_g"), F.col("norm").alias("_t"))
    new = search_text(cur).join(old, ["part", "id"], "left")
    return new.where(~(F.col("norm").eqNullSafe(F.col("_t")) & F.col("grp").eqNullSafe(F.col("_g")))).select("part", "id")


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without these records (part, id), in both groups."""
    return index.join(ids, ["part", "id"], "left_anti").select(*index.columns)


def flush(index: DataFrame, part: int, group: int | None = None) -> DataFrame:
    """The index without a partition, or one group of it."""
    gone = (F.col("part") == F.lit(part)) & (F.lit(True) if group is None else F.col("grp") == F.lit(group))
    return index.where(~gone)


def search_ids(index: DataFrame, part: int | None, query: str, group: int = 0, limit: int | None = None, require_all: bool = True, score: str = "words") -> DataFrame:
    """id and weight of the records that match, best first if limited. A query without words matches nothing."""
    words = sorted(set(normalize_value(query).split()))
    if score not in ("words", "bm25"):
        raise ValueError(f"unknown score {score}")
    bucket = index.where(F.col("grp") == F.lit(group))
    if part is not None:
        bucket = bucket.where(F.col("part") == F.lit(part))
    hits = bucket.where(F.col("word").isin(words) if words else F.lit(False))
    weight = F.count(F.lit(1)).cast("double")
    if score == "bm25":
        about = bucket.select("part", "id", "length").distinct().agg(F.count(F.lit(1)).alias("_docs"), F.avg("length").alias("_mean"))
        frequency = hits.groupBy("word").agg(F.count(F.lit(1)).alias("_df"))
        hits = hits.join(F.broadcast(frequency), "word").join(F.broadcast(about))  # a row for each word of the query, and one
        idf = F.log1p((F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
        weight = F.sum(idf * F.col("n") * 2.2 / (F.col("n") + 1.2 * (0.25 + 0.75 * F.col("length") / F.col("_mean"))))
    found = hits.groupBy("part", "id").agg(weight.alias("weight"), F.count(F.lit(1)).alias("_n"))
    if require_all:
        found = found.where(F.col("_n") == len(words))
    found = found.select("id", "weight")
    return found if limit is None else found.orderBy(F.col("weight").desc(), "id").limit(limit)


def search(table: Table, index: DataFrame, part: int, query: str, group: int = 0, limit: int = 100, **options) -> DataFrame:
    """The rows of the records that match, best first; records that are gone are skipped."""
    hits = search_ids(index, part, query, group, limit, **options).withColumnsRenamed({"id": "_id", "weight": "_weight"})
    own = table.data.where(F.col(table.schema.partition) == F.lit(part))
    joined = own.join(F.broadcast(hits), own[table.schema.keys[0]] == hits["_id"])  # at most `limit` rows
    return joined.orderBy(F.col("_weight").desc(), "_id").select(*own.columns)
