"""SimHash fingerprints and their links within a Hamming radius, found by covering locality-sensitive hashing."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import persisted
from keyloom.llm.components import components
from keyloom.llm.runs import Links, in_blocks, pairs, sorted_runs, whole_runs
from keyloom.llm.substring_dedup import shingle_hashes, word_hashes

SHINGLE, RADIUS, SEED, BLOCK = 4, 4, 42, 4096
_AT_ONCE = 1 << 15
#: The eight bits of each byte, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a UTF-8 text as a signed 64-bit number; a bit is set if it is in over half the shingle hashes."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly blank and tab to carriage return
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(shingle, len(words))
    n = len(words) - width + 1
    ones = np.zeros((8, 8), np.int64)
    for at in range(0, n, _AT_ONCE):
        to = min(n, at + _AT_ONCE)
        h = np.array([hashed(joined[a:b], seed) for a, b in zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)], np.uint64)
        for k, byte in enumerate(h.view(np.uint8).reshape(-1, 8).T):
            ones[k] += np.bincount(byte, minlength=256) @ _BITS
    bits = np.packbits(2 * ones.ravel() > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def masks(radius: int = RADIUS) -> list[int]:
    """Masks of a covering family over 64 bits (Pagh, 2016), as signed numbers.

    Bit i gets the nonzero vector m(i) of radius + 1 bits, dealt in turn; mask v keeps the bits whose m(i) has an odd
    number of ones in common with v. The at most `radius` vectors of the bits in which two fingerprints differ lie in a
    hyperplane, so some v is orthogonal to all of them: under that mask the two are equal.
    """
    top = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, top + 1):
        mask = sum(1 << i for i in range(64) if ((1 + i % top) & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t, c and text of each row; null texts count as empty. t and c are two hashes of the text, which together say
    which texts are equal."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("c"), text.alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns to keep, and fp (bigint) of each row. A null text counts as empty; no words give 0."""
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t or b"", shingle, seed) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp, pa.int64())], [*names, "fp"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).cast("binary").alias("_t")).mapInArrow(run, f"{kinds}, fp bigint")


def near_links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """a, b: links that join the distinct values of fps (fp) just as all pairs within the radius would.

    Every pair within the radius meets in some bucket; a task keeps only one link per fingerprint and set that it finds.
    """
    kept = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))]))
    rows = fps.select("fp").distinct().select("fp", kept.alias("_k")).select("fp", "_k.mask", "_k.key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches):
            fp, at = np.unique(rows["fp"].to_numpy(), return_inverse=True)
            links = Links(len(fp))
            for i, j in pairs(rows):
                near = np.bitwise_count((fp[at[i]] ^ fp[at[j]]).view(np.uint64)) <= radius  # of signed numbers it counts the bits of the absolute value
                links.add(at[i[near]], at[j[near]])
            root = links.roots(np.arange(len(fp)))
            own = root != np.arange(len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[root[own]])], ["a", "b"])

    return sorted_runs(in_blocks(rows, ["mask", "key"], F.col("fp"), block).select("fp", "run", "side", "cross")).mapInArrow(run, "a bigint, b bigint").distinct()


def _fp_classes(rows: DataFrame, radius: int, block: int) -> DataFrame:
    """fp and root: the classes of fingerprints that links join, under one of them."""
    classes, _ = persisted(rows.select("fp").distinct(), "classes")
    joined = components(near_links(classes, radius, block))
    return classes.join(joined, classes.fp == joined.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """id_col, fp, component: each row of docs with its fingerprint and the smallest id that links reach.

    Rows: one per input row, repeated rows and ids included. A null or empty text has fingerprint 0 and links like any
    other. A null id stays null and never names a component that has another id. Other columns are not read, so clashing
    names do not matter. An empty table gives an empty result.
    """
    rows, _ = persisted(fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")), "_id", "text", shingle, seed), "fingerprints")
    rooted = _fp_classes(rows, radius, block)
    least = rows.groupBy("fp").agg(F.min("_id").alias("least")).join(rooted, "fp")
    named = least.groupBy("root").agg(F.min("least").alias("component"))
    names = rooted.join(named, "root").select("fp", "component")
    return rows.join(names, "fp").select(F.col("_id").alias(id_col), "fp", "component")


def _one_of_each(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each class. members: id, t, c and root of every row.

    The row of the smallest id stays, null ids being the last; of rows with that id, the one whose text has the least
    hashes; of rows equal in both, the one whose other columns have the least hash. Rows are found by id and text, so an
    id that stands for other texts too does no harm. Texts are exchanged once, by id and text; where the chosen rows
    repeat, these are aggregated before the exchange.
    """
    chosen = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t", "c")).alias("_w")).select("_w.id", "_w.t", "_w.c")
    same = [members[k].eqNullSafe(chosen[k]) for k in ("id", "t", "c")]
    counted = members.join(chosen.hint("merge"), same[0] & same[1] & same[2]).groupBy(members["id"], members["t"], members["c"]).agg(F.count(F.lit(1)).alias("_n"))
    winners, _ = persisted(counted.toDF("_i", "_a", "_b", "_n"), "winners")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_t"), F.xxhash64(F.lit(1), text).alias("_c"))
    on = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_t") == F.col("_a")) & (F.col("_c") == F.col("_b"))
    out = keyed.join(winners.where("_n = 1").hint("merge"), on).select("_own.*")
    if winners.where("_n > 1").isEmpty():
        return out
    order = F.xxhash64(*[F.to_json(F.struct(F.col(f"_own.`{f.name}`"))) if "map" in f.dataType.simpleString() else F.col(f"_own.`{f.name}`") for f in docs.schema.fields if f.name not in (id_col, text_col)], F.lit(0))
    first = keyed.withColumn("_order", order).groupBy("_id", "_t", "_c").agg(F.min_by("_own", "_order").alias("_own"))
    return out.unionByName(first.join(winners.where("_n > 1").hint("merge"), on).select("_own.*"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """docs with one row of each group of near duplicates, see _one_of_each; columns, of any type, stay. Null and empty
    texts are one group; an empty table stays empty."""
    rows, _ = persisted(fingerprints(_rows(docs, id_col, text_col), "id", "text", shingle, seed, ("t", "c")), "fingerprints")
    return _one_of_each(docs, rows.join(_fp_classes(rows, radius, block), "fp"), id_col, text_col)


# Similarity of 0.8 over five-word shingles ------------------------------------------------------------------------

#: Near copies at a similarity of 0.8 differ in about ten bits of a whole text's fingerprint, so no radius that buckets
#: can cover finds them all. Fingerprints of samples find the rest: the shingles are dealt by their hash to parts of about
#: PART_SIZE, and of SAMPLES parts each one is left untouched by the differing shingles with a probability of 0.4 or more.
SIMILARITY, SIMILAR_SHINGLE, PART_SIZE, SAMPLES, PIVOTS = 0.8, 5, 4, 24, 4
#: Bits of a text's parity sketch for each shingle, and the fewest and most of them.
WIDTH, NARROW, WIDE = 4, 256, 1 << 16
#: Texts that a text of a bucket is compared with first, and by how much that grows from round to round.
NEAREST, GROWTH = 4, 8
#: Texts whose shingles a task keeps while it compares, pairs and words of sketches that are held at once.
KEPT, AT_ONCE, WORDS = 16, 1 << 14, 1 << 19


def shingle_set(text: bytes, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of fewer words, that of the whole sequence."""
    words = word_hashes(text)
    return np.unique(shingle_hashes(words, min(shingle, len(words)) or 1))


def sample_keys(tokens: np.ndarray, similarity: float = SIMILARITY, size: int = PART_SIZE, samples: int = SAMPLES) -> np.ndarray:
    """Keys of the SimHashes of samples of a text's shingles; texts of neighbouring sizes share the number of parts."""
    return placed_keys(tokens, similarity, size, samples)[0]


def placed_keys(tokens: np.ndarray, similarity: float = SIMILARITY, size: int = PART_SIZE, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """sample_keys, and a place for each from 0 to 3 * samples - 1: equal keys of two texts have the same place."""
    n = len(tokens)
    if not n:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    out, places = [], []
    for parts in {1 << int(x / (size if n >= 16 * size else 2)).bit_length() for x in (n * similarity, n, n / similarity)}:
        part = (tokens >> np.uint64(40)) % np.uint64(parts)
        some = part < samples
        part, own = part[some].astype(np.int64), tokens[some]
        bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
        ones, total = np.zeros((min(parts, samples), 64), np.int64), np.bincount(part, minlength=min(parts, samples))
        np.add.at(ones, part, bits)
        prints = np.packbits(2 * ones > total[:, None], axis=1).view(np.uint64).ravel()[total > 0]
        out.append((prints ^ np.uint64(parts)) * np.uint64(0x9E3779B97F4A7C15) + np.flatnonzero(total > 0).astype(np.uint64))
        places.append(parts.bit_length() % 3 * samples + np.flatnonzero(total > 0))  # the numbers of parts are neighbouring powers of two
    return np.concatenate(out).view(np.int64), np.concatenate(places)


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """Bits that tell for each place whether it has an odd number of tokens (Odd Sketch, Mitzenmacher et al., 2014).

    Tokens that two sets share cancel out, so their sketches differ in no more bits than the sets do in tokens.
    """
    width = min(WIDE, max(NARROW, 1 << (WIDTH * len(tokens) - 1).bit_length() if len(tokens) else 0))
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def differing(sketches: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the sketches i and j differ; of two widths, the wider one is folded to the other."""
    width = np.array([len(x) for x in sketches])
    least, out = np.minimum(width[i], width[j]), np.zeros(len(i), np.int64)
    for w in np.unique(least).tolist():
        of = np.flatnonzero(least == w)
        some, at = np.unique(np.r_[i[of], j[of]], return_inverse=True)
        bits = np.array([np.bitwise_xor.reduce(sketches[k].reshape(-1, w), axis=0) for k in some.tolist()])
        a, b, step = at[: len(of)], at[len(of) :], max(1, WORDS // w)
        for k in range(0, len(of), step):
            out[of[k : k + step]] = np.bitwise_count(bits[a[k : k + step]] ^ bits[b[k : k + step]]).sum(axis=1, dtype=np.int64)
    return out


def nearest(i: np.ndarray, j: np.ndarray, far: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (i, j) those that are one of the n nearest of either side, with `far`, and the items that have more."""
    own, other = np.r_[i, j], np.r_[j, i]
    order = np.lexsort((other, np.r_[far, far], own))
    rank = np.arange(len(own)) - np.searchsorted(own[order], own[order])
    kept = np.unique(order[rank < n] % max(1, len(i)))
    return i[kept], j[kept], far[kept], np.unique(own[order][rank == n])


def _similar_members(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, radius: int = RADIUS) -> DataFrame:
    """id, t, c and root of each row: its class of similar texts."""
    rows = _rows(docs, id_col, text_col)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The keys of each text, and in place -1 its fingerprint with the sketch of its shingles."""
        seen: set[int] = set()  # copies that one task meets are sampled once
        for batch in batches:
            ts, ks, ns, ps, odd = [], [], [], [], []
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if t not in seen:
                    seen.add(t)
                    text = text.as_py()
                    tokens = shingle_set(text, shingle)
                    own, places = placed_keys(tokens, similarity)
                    ts.append(np.full(len(own) + 1, t))
                    ks.append(np.r_[own, fingerprint(text)])
                    ns.append(np.full(len(own) + 1, len(tokens)))
                    ps.append(np.r_[places, -1])
                    odd += [None] * len(own) + [parity_sketch(tokens).tobytes()]
            if ts:
                yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(x)) for x in (ts, ks, ns, ps)], pa.array(odd, pa.binary())], ["t", "key", "n", "place", "odd"])

    def may(n, m) -> Column:
        """Whether sets of these sizes can be similar."""
        return F.least(n, m) >= F.lit(similarity) * F.greatest(n, m)

    every, _ = persisted(rows.select("t", F.col("text").cast("binary").alias("b")).mapInArrow(keys, "t bigint, key bigint, n bigint, place bigint, odd binary").distinct(), "samples")
    found, prints = every.where("place >= 0").select("t", "key", "n"), every.where("place < 0").select("t", F.col("key").alias("fp"), "odd")
    # the links of the fingerprints, by the covering family
    classes = prints.select("t", "fp").join(_fp_classes(prints, radius, BLOCK), "fp")
    least = classes.groupBy("root").agg(F.min("t").alias("b"))
    by_prints, _ = persisted(classes.join(least, "root").where("t <> b").select(F.col("t").alias("a"), "b"), "similar")

    sizes = found.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared, _ = persisted(found.join(sizes.hint("merge"), "key"), "shared")
    degree = shared.groupBy("t").agg(F.sum(F.log2("m")).alias("degree"))
    central = shared.join(degree.hint("merge"), "t").groupBy("key").agg(F.max(F.struct("degree", "t", "n")).alias("a"), F.min(F.struct("t", "n")).alias("b"))
    pivots = central.select("key", F.explode(F.array_distinct(F.array(F.struct("a.t", "a.n"), F.struct("b.t", "b.n")))).alias("o")).select("key", F.col("o.t").alias("o"), F.col("o.n").alias("on"))
    votes = shared.join(pivots.hint("merge"), "key").where((F.col("t") != F.col("o")) & may("n", "on")).groupBy("t", "o").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("n", "o")), False).alias("os"))  # at most two of each of a text's few keys
    tried, _ = persisted(best.select("t", F.explode(F.slice("os", 1, PIVOTS)).alias("w")).select(F.least("t", "w.o").alias("x"), F.greatest("t", "w.o").alias("y")).distinct(), "pairs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()

        def tokens(t: int, text: pa.Scalar) -> np.ndarray:
            if t not in kept:
                kept[t] = shingle_set(text.as_py(), shingle)
                if len(kept) > KEPT:
                    kept.popitem(last=False)
            kept.move_to_end(t)
            return kept[t]

        for batch in batches:
            keep = []
            for k, (i, j, a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                x, y = tokens(i, a), tokens(j, b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).take(pa.array(keep, pa.int64()))

    def compared(tried: DataFrame) -> DataFrame:
        needed = tried.select(F.col("x").alias("t")).union(tried.select(F.col("y").alias("t"))).distinct()
        texts, _ = persisted(rows.join(needed.hint("merge"), "t").groupBy("t").agg(F.min("text").alias("text")).select("t", F.col("text").cast("binary").alias("b")), "texts")
        first, second = texts.select(F.col("t").alias("x"), F.col("b").alias("xb")), texts.select(F.col("t").alias("y"), F.col("b").alias("yb"))
        both = tried.join(first.hint("merge"), "x").join(second.hint("merge"), "y").select("x", "y", "xb", "yb")
        return persisted(both.mapInArrow(compare, "a bigint, b bigint"), "similar")[0]

    def unlinked(last: int):
        """For each text of a bucket the `last` nearest ones that links have not joined with it and whose sketches allow the
        similarity, and for each bucket where a text has more of them a row without a pair."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in whole_runs(batches):
                t, root, n, key = (held[c].to_numpy() for c in ("t", "root", "n", "key"))
                sketches = [np.frombuffer(x, np.uint64) for x in held["odd"].to_pylist()]
                none = np.empty(0, np.int64)
                x, y, far, more = none, none, none, none
                for i, j in pairs(held, AT_ONCE):
                    some = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
                    i, j = i[some], j[some]
                    d = differing(sketches, i, j)
                    some = d <= (1 - similarity) / (1 + similarity) * (n[i] + n[j]) + 1e-6
                    x, y, far, rest = nearest(np.r_[x, i[some]], np.r_[y, j[some]], np.r_[far, d[some]], last)
                    more = np.union1d(more, rest)
                again = np.unique(key[more])
                if len(x) + len(again):
                    first, second = np.minimum(t[x], t[y]), np.maximum(t[x], t[y])
                    yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.nulls(len(x), pa.int64())], ["x", "y", "key"])
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(again), pa.int64()), pa.nulls(len(again), pa.int64()), pa.array(again)], ["x", "y", "key"])

        return run

    roots, held, last = components(by_prints.unionByName(compared(tried))), shared, NEAREST
    while True:
        marked = held.join(roots.withColumnRenamed("node", "t"), "t", "left").withColumn("root", F.coalesce("root", "t"))
        apart = marked.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b").select("key")
        dealt = in_blocks(marked.join(apart.hint("merge"), "key"), ["key"], F.col("t"), BLOCK).select("t", "key", "n", "root", "run", "side", "cross")
        met, _ = persisted(sorted_runs(dealt.join(prints.select("t", "odd").hint("merge"), "t")).mapInArrow(unlinked(last), "x bigint, y bigint, key bigint"), "met")
        new, _ = persisted(met.where("key IS NULL").select("x", "y").distinct().join(tried.hint("merge"), ["x", "y"], "left_anti"), "pairs")
        if not new.isEmpty():
            roots = components(roots.toDF("a", "b").unionByName(compared(new)))
        again = met.where("key IS NOT NULL").select("key").distinct()
        if again.isEmpty():
            break
        # buckets where a text has more that its links have not joined
        held, tried, last = held.join(again.hint("merge"), "key", "left_semi"), tried.unionByName(new), GROWTH * last
    joined = roots.withColumnRenamed("node", "t")
    members, _ = persisted(rows.select("id", "t", "c"), "members")
    # a text that shares t with another by chance is a class of its own
    known = members.groupBy("t").agg(F.min("c").alias("_first")).join(joined, "t", "left").select("t", "_first", F.coalesce("root", "t").alias("root"))
    return members.join(known, "t").select("id", "t", "c", F.when(F.col("c") == F.col("_first"), F.col("root")).otherwise(F.xxhash64("t", "c")).alias("root"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """id_col, component: each row of docs and the smallest id that links of similar texts reach.

    Texts link if their SimHashes lie within RADIUS bits, found by the covering family as in simhash_components. They also
    link if the Jaccard similarity of their shingles is at least `similarity`; candidates for that are texts for which the
    SimHashes of a sample of their shingles are equal. Equal texts are one class. A text is first compared with the pivots
    of its buckets: those that share most buckets with others, which in a group of copies is what they are copies of. Then
    all pairs of a bucket that links have not joined are met, in blocks, by sketches that differ in no more bits than the
    texts do in shingles; where these allow the similarity the texts are compared, the nearest first, in rounds that end
    when no text has further ones. So no candidate is left out. Null and empty texts are alike; null ids and repeated rows
    stay, as in simhash_components. An empty table gives an empty result.
    """
    members = _similar_members(docs, id_col, text_col, shingle, similarity)
    named = members.groupBy("root").agg(F.min("id").alias("component"))
    return members.join(named, "root").select(F.col("id").alias(id_col), "component")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of similar texts, see _one_of_each; columns, of any type, stay. Null and empty texts
    are one group; an empty table stays empty."""
    return _one_of_each(docs, persisted(_similar_members(docs, id_col, text_col, shingle, similarity), "members")[0], id_col, text_col)
