"""Near duplicates among embeddings: Euclidean p-stable hashing (Datar et al., 2004), then exact cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import persisted
from keyloom.llm.components import components
from keyloom.llm.runs import Links, in_blocks, pairs, sorted_runs, whole_runs

#: A pair at cosine 0.98 (distance 0.2) falls into one bucket of a table with probability 0.84^8, and in no table of the
#: 40 with probability 1.1e-5; one at a right angle shares a given bucket with probability 3e-5.
COSINE, TABLES, HASHES, WIDTH, SEED, BLOCK = 0.98, 40, 8, 1.0, 11, 2048
_AT_ONCE = 1 << 16


def normalised(vectors: list) -> np.ndarray:
    """Rows of length one in double precision, padded with zeros to the longest."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def codes(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """One 32-bit number per row and table, of its quantised random projections."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    lines, shift = rng.normal(size=(unit.shape[1], tables * hashes)), rng.uniform(0, width, tables * hashes)
    steps = np.floor((unit @ lines + shift) / width).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, hashes)
    out = np.zeros((len(unit), tables), np.uint64)
    for h in range(hashes):
        out = (out ^ steps[:, :, h]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _unit_rows(raw: list[bytes], kind: type) -> np.ndarray:
    """Rows of length one of the bytes of vectors."""
    if len(set(map(len, raw))) == 1:
        out = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
        out /= np.abs(out).max(axis=1, keepdims=True)
        return out / np.sqrt((out * out).sum(axis=1, keepdims=True))
    return normalised([np.frombuffer(r, kind) for r in raw])


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """id_col, n_links, component: links between vectors of equal labels with a cosine of at least `cosine`.

    One row per row of vectors. Rows that are null, zero, empty, or hold null or non-finite components, and rows without a
    label, link with nothing. Equal vectors of a label are one class: their links are counted by class sizes, not listed.
    Vectors of different lengths are not compared. A pair that meets in several tables counts in the first one only, so
    no list of pairs is kept. A null id stays null, counts as a vector and names no component but its own. Other columns
    are not read; an empty table gives an empty result. A pair at the very threshold is missed with probability 1e-5.
    """
    v, x = F.col("v"), vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    fit = F.col("label").isNotNull() & v.isNotNull() & F.coalesce(finite & F.exists(v, lambda e: e != 0), F.lit(False))
    rows, _ = persisted(x.withColumn("fit", fit), "vectors")
    some = rows.where("fit").groupBy("label", "v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("c", F.coalesce("least", F.xxhash64("label", "v")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = [x.as_py() for x in batch.column("v")]
            out: list = [None] * len(vs)
            for n in set(map(len, vs)):
                own = [k for k, y in enumerate(vs) if len(y) == n]
                for k, c in zip(own, codes(normalised([vs[k] for k in own]), tables, hashes, width), strict=True):
                    out[k] = c
            raw = pa.array([np.array(y, kind).tobytes() for y in vs], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32())), raw], [*batch.schema.names, "codes", "raw"])

    label = vectors.schema[label_col].dataType.simpleString()
    kind = np.float32 if vectors.schema[vector_col].dataType.simpleString() in ("array<float>", "array<smallint>", "array<tinyint>") else np.float64
    coded, _ = persisted(some.mapInArrow(hashed, f"label {label}, v array<double>, least bigint, n bigint, c bigint, codes array<int>, raw binary"), "codes")
    keys = ["label", "dim", "t", "code"]
    buckets = coded.select("c", "label", F.size("v").alias("dim"), F.posexplode("codes").alias("t", "code"))
    dealt = in_blocks(buckets, keys, F.col("c"), block, shared=True).select("c", "t", "run", "side", "cross")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches):
            c, at = np.unique(rows["c"].to_numpy(), return_inverse=True)
            unit, code = _unit_rows(rows["raw"].to_pylist(), kind), rows["codes"].combine_chunks().flatten().to_numpy().reshape(-1, tables)
            t, n = rows["t"].to_numpy(), rows["n"].to_numpy()
            links, count = Links(len(c)), np.zeros(len(c), np.int64)
            for i, j in pairs(rows, _AT_ONCE):
                own = np.argmax(code[i] == code[j], axis=1) == t[i]
                i, j = i[own], j[own]
                near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
                i, j = i[near], j[near]
                np.add.at(count, at[i], n[j])
                np.add.at(count, at[j], n[i])
                links.add(at[i], at[j])
            root = links.roots(np.arange(len(c)))
            own = count > 0
            yield pa.RecordBatch.from_arrays([pa.array(c[own]), pa.array(count[own]), pa.array(c[root[own]])], ["c", "links", "root"])

    found, _ = persisted(sorted_runs(dealt.join(coded.select("c", "raw", "codes", "n"), "c")).mapInArrow(compare, "c bigint, links bigint, root bigint"), "links")
    joined = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    named = coded.select("label", "v", "n", "c", "least").join(counts, "c", "left").join(joined.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    classes = named.join(least, "root").select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    linked = rows.where("fit").join(classes, ["label", "v"]).select("id", "n_links", "component")
    alone = rows.where("NOT fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).withColumnRenamed("id", id_col)
