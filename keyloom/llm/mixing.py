"""Mixing sources to target weights, on DataFrame operations only.

The words of each source, in a pseudorandom order of its documents, are packed into blocks of fixed length. Output shards
have slots; the numbers of slots that each shard gives the sources are drawn from the multinomial of the target shares. A
pseudorandom permutation of its block numbers says which block a source's slot gets, and blocks are joined by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.llm.common import WORD, persisted, word_count

WEIGHTS, SHARE, MOST, BLOCK, BUCKETS, SHARD_SLOTS = (5, 2, 1), 1.5, 2, 256, 1024, 4096
#: A prime modulus with a multiplier of full period, for pseudorandom numbers that SQL can express too.
PRIME, FACTOR = 2147483647, 48271


def _long(x) -> Column:
    return F.lit(x).cast("long")


def _mixed(x: Column) -> Column:
    """A pseudorandom number below PRIME of a bigint."""
    low = F.pmod(x, _long(PRIME))
    once = F.pmod(low * FACTOR + 1, _long(PRIME))
    return F.pmod(once * once + low * 16807, _long(PRIME))


def _bucket(mixed: Column) -> Column:
    return F.floor(mixed * BUCKETS / PRIME).cast("long")


def _running(df: DataFrame, by: list[str], bucket: str, order: list[str], **values: str) -> DataFrame:
    """df with the sums (new column: of which one) before each row of `by`, ordered by bucket, then `order`: a window over
    the buckets' sums, then one within each bucket, so that a source with a third of all rows is not one task's."""
    keys = [*by, bucket]
    sums = df.groupBy(*keys).agg(*[F.sum(v).alias(f"_s_{n}") for n, v in values.items()])
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, *[F.coalesce(F.sum(f"_s_{n}").over(before), _long(0)).alias(f"_base_{n}") for n in values])
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumns({f"_in_{n}": F.coalesce(F.sum(v).over(inner), _long(0)) for n, v in values.items()})
    return own.join(base.hint("merge"), keys).select(*df.columns, *[(F.col(f"_base_{n}") + F.col(f"_in_{n}")).alias(n) for n in values])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes (source_key, source_size) with rank and target (words, double).

    Sources in the order of their key get the weights in turn, and share `share` times all words; a target stops at `most`
    times its source's size, and what is above is shared by weight among the rest. Sorted by cap for each weight, the
    level at which all is given out is the greatest of those where the sources up to there are capped. The windows are
    over sources.
    """
    if not 0 < share <= most:
        raise ValueError("the share must be positive and within the most that sources may give")
    by_key = Window.orderBy("source_key")
    rank = sizes.withColumn("rank", F.row_number().over(by_key).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, _long(len(weights))) + 1).cast("int"))
    weighed = rank.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    none = _long(0)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), none)) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), none))
    levels = weighed.withColumn("_level", level).withColumn("_level", F.max("_level").over(every))
    return levels.select("source_key", "source_size", "rank", F.least(F.col("cap").cast("double"), F.col("_level") * F.col("weight")).alias("target"))


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))  # null last


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), _source_key(F.col(source_col)).alias("source_key"), F.col(text_col).alias("_t"))
    return sized.select("doc_id", "source_key", word_count(F.col("_t")).alias("size"), F.coalesce(F.octet_length("_t").cast("long"), _long(0)).alias("n_bytes"))


def _numbered(df: DataFrame, count: str, out: str, *by: str) -> DataFrame:
    """A row for each number below `count` of each row of df, dealt to many tasks in steps."""
    step = 1 << 14
    some = df.where(F.col(count) > 0)
    chunks = some.withColumn("_c", F.explode(F.sequence(_long(0), F.floor((F.col(count) - 1) / step).cast("long")))).repartition(*by, "_c")
    return chunks.withColumn(out, F.explode(F.sequence(F.col("_c") * step, F.least(F.col("_c") * step + (step - 1), F.col(count) - 1)))).drop("_c")


def _blocks(targets: DataFrame, block: int) -> DataFrame:
    """source_key, block, length, place, whole, part, n: the blocks of each source and their places in its permutation.

    whole: how many times all blocks are taken; part: how many words of this one are taken once more, in the order of the
    places. The last block that is taken is cut so that a source gives its target to the word. Joins with what comes from
    here need a hint: the rows are made from a few sources, so the planner takes them for few and would broadcast them all.
    """
    wanted = F.floor(F.col("target")).cast("long")
    sized = targets.where("source_size > 0").withColumns({"whole": F.floor(wanted / F.col("source_size")).cast("long"), "n": F.ceil(F.col("source_size") / F.lit(block)).cast("long")})
    sized = sized.withColumn("_rest", wanted - F.col("whole") * F.col("source_size"))
    each = _numbered(sized, "n", "block", "source_key").withColumn("length", F.least(_long(block), F.col("source_size") - F.col("block") * block))
    drawn = each.withColumns({"_m": _mixed(F.col("block") * 65537 + F.col("rank")), "_one": _long(1)}).withColumn("_bucket", _bucket(F.col("_m")))
    ordered = _running(drawn, ["source_key"], "_bucket", ["_m", "block"], _before="length", place="_one")
    part = F.greatest(_long(0), F.least(F.col("length"), F.col("_rest") - F.col("_before")))
    return ordered.select("source_key", "block", "length", "place", "whole", part.alias("part"), "n")


def drawn_slots(quotas: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """slot, shard, source_key: for each of the slots a source drawn by its share, so a shard's counts are multinomial.

    quotas: source_key and quota, a source's number of slots in all; the shares are those of the quotas. A slot's
    pseudorandom number is looked up in the cumulative shares, within one of BUCKETS bins of equal width.
    """
    before = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, -1)  # over sources
    shares = quotas.withColumns({"_total": F.sum("quota").over(Window.partitionBy()), "_low": F.coalesce(F.sum("quota").over(before), _long(0))})
    edge = lambda x: F.floor(x.cast("double") / F.col("_total") * PRIME).cast("long")
    ranges = shares.withColumns({"low": edge(F.col("_low")), "high": edge(F.col("_low") + F.col("quota"))}).where("high > low")
    bins = ranges.withColumn("bin", F.explode(F.sequence(_bucket(F.col("low")), _bucket(F.col("high") - 1)))).select("bin", "source_key", "low", "high")
    total = quotas.agg(F.sum("quota").alias("total"))
    slots = _numbered(total, "total", "slot").withColumn("u", _mixed(_mixed(F.col("slot") + seed * 7919) * 31 + F.floor(F.col("slot") / PRIME).cast("long") + F.col("slot"))).withColumn("bin", _bucket(F.col("u")))
    found = slots.join(bins.hint("merge"), "bin").where("u >= low AND u < high")
    return found.select("slot", F.floor(F.col("slot") / shard_slots).cast("long").alias("shard"), "source_key")


def settled_slots(drawn: DataFrame, quotas: DataFrame) -> DataFrame:
    """slot, shard, source_key, k: the slots with each source's numbered from 0 to its quota.

    Draws miss the quotas by about the root of their number. The last slots of a source that drew too many are given to
    sources that drew too few, one by one in the order of slots, so the totals are met and no source exceeds its cap.
    """
    ones = drawn.withColumn("_one", _long(1))
    numbered, _ = persisted(_running(ones, ["source_key"], "shard", ["slot"], k="_one").drop("_one"), "slots")
    counts = quotas.join(numbered.groupBy("source_key").agg(F.count(F.lit(1)).alias("_n")).hint("merge"), "source_key", "left").withColumn("_n", F.coalesce("_n", _long(0)))
    kept = numbered.join(quotas.hint("merge"), "source_key")
    extra = _running(kept.where("k >= quota").select("slot", "shard", _long(1).alias("_one"), F.lit(0).alias("_all")), ["_all"], "shard", ["slot"], z="_one").select("slot", "shard", "z")
    short = counts.where("_n < quota").withColumn("_few", F.col("quota") - F.col("_n"))
    short = short.withColumn("_z", F.coalesce(F.sum("_few").over(Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, -1)), _long(0)))  # over sources
    wanted = _numbered(short, "_few", "_i", "source_key").select((F.col("_z") + F.col("_i")).alias("z"), "source_key", (F.col("_n") + F.col("_i")).alias("k"))
    names = ["slot", "shard", "source_key", "k"]
    return kept.where("k < quota").select(names).unionByName(extra.join(wanted.hint("merge"), "z").select(names))


def _slots(targets: DataFrame, block: int, shard_slots: int) -> DataFrame:
    """slot, shard, source_key, block, turn, words, whole: the slots of all shards and what fills them."""
    blocks, _ = persisted(_blocks(targets, block), "blocks")
    quotas, _ = persisted(blocks.groupBy("source_key").agg((F.max(F.col("whole") * F.col("n")) + F.sum((F.col("part") > 0).cast("long"))).alias("quota"), F.max("n").alias("n")).where("quota > 0"), "quotas")
    settled = settled_slots(drawn_slots(quotas.select("source_key", "quota"), shard_slots), quotas.select("source_key", "quota"))
    own = settled.join(quotas.select("source_key", "n").hint("merge"), "source_key").select("slot", "shard", "source_key", F.floor(F.col("k") / F.col("n")).cast("long").alias("turn"), F.pmod("k", "n").alias("place"))
    filled = own.join(blocks.drop("n").hint("merge"), ["source_key", "place"])
    words = F.when(F.col("turn") < F.col("whole"), F.col("length")).otherwise(F.col("part"))
    return filled.select("slot", "shard", "source_key", "block", "turn", words.alias("words"), "whole")


def _fills(slots: DataFrame) -> DataFrame:
    """source_key, block, whole, part of the blocks that slots hold: full turns, and the words of the last turn."""
    last = F.col("turn") >= F.col("whole")
    return slots.groupBy("source_key", "block").agg(F.sum((~last).cast("long")).alias("whole"), F.sum(F.when(last, F.col("words")).otherwise(_long(0))).alias("part"))


def _pieces(sized: DataFrame, block: int) -> DataFrame:
    """Each document's words [at, to) of each block of its source that it lies in."""
    mixed = _mixed(F.coalesce(F.col("doc_id"), _long(-1)) + F.col("size") * 31 + F.col("n_bytes"))
    order = ["_m", "doc_id", "size", "n_bytes", *[c for c in ("h", "row") if c in sized.columns]]
    placed = _running(sized.withColumn("_m", mixed).withColumn("_bucket", _bucket(F.col("_m"))), ["source_key"], "_bucket", order, start="size").drop("_m", "_bucket")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    each = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return each.withColumns({"at": F.greatest(_long(0), F.col("start") - F.col("block") * block), "to": F.least(_long(block), F.col("start") + F.col("size") - F.col("block") * block)})


def _once_more() -> Column:
    return F.greatest(_long(0), F.least(F.coalesce(F.col("part"), _long(0)), F.col("to")) - F.col("at"))


def _targets(rows: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    return persisted(source_targets(rows.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")[0]


def mixture_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """slot, shard, source_key, block, turn, words, whole: the slots of the output shards and what fills them.

    A shard has `shard_slots` slots (the last one fewer); their sources are drawn, see drawn_slots, and the totals settled,
    see settled_slots. The k-th slot of a source with n blocks gets the block at place k mod n of its permutation, in turn
    k div n. Null and empty texts have no words and fill no slot; a null source is one of its own, the last; repeated rows
    count as often as they stand; an empty table has no slots.
    """
    return _slots(_targets(_sized(docs, id_col, text_col, source_col), weights, share, most), block, shard_slots)


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each row of docs the slots hold, repeats counted.

    Rows: one per input row; a null or empty text has size 0 and is taken 0 times; a null source is one of its own, the
    last; a null id counts as -1 in the order; rows equal in id, source and sizes share their places in any order. Other
    columns are not read. A rerun takes the same words. An empty table gives an empty result.
    """
    rows, _ = persisted(_sized(docs, id_col, text_col, source_col), "sizes")
    targets = _targets(rows, weights, share, most)
    fills = _fills(_slots(targets, block, shard_slots))
    parts = _pieces(rows, block).join(fills.hint("merge"), ["source_key", "block"], "left")
    words = F.coalesce(F.col("whole"), _long(0)) * (F.col("to") - F.col("at")) + _once_more()
    taken = parts.groupBy("source_key", "start", "doc_id", "size").agg(F.sum(words).alias("taken"))
    some = taken.join(targets, "source_key").select("doc_id", "size", "source_size", "target", "taken")
    none = rows.where("size = 0").join(targets, "source_key").select("doc_id", "size", "source_size", "target", _long(0).alias("taken"))
    return some.unionByName(none)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """docs as the slots hold them: a row for each turn in which a document is taken, its text cut to the words taken.

    A document that is taken whole keeps its text; else the taken words of its blocks follow each other, with the white
    space that stood before them. Columns, of any type, stay as they are, each row's own, also where rows repeat or share
    an id; rows with no word taken go, such as those of null and empty texts. docs is written once with row numbers, by
    which the takes find their rows, so texts are exchanged once. Null ids and sources as in mix_counts; an empty table
    gives an empty result.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.monotonically_increasing_id().alias("row"))
    base, _ = persisted(own, "rows")
    text = F.col(f"own.`{text_col}`")
    keyed = base.select("row", F.col(f"own.`{id_col}`").cast("long").alias("doc_id"), _source_key(F.col(f"own.`{source_col}`")).alias("source_key"), word_count(text).alias("size"), F.coalesce(F.octet_length(text).cast("long"), _long(0)).alias("n_bytes"), F.xxhash64(text).alias("h"))
    rows, _ = persisted(keyed, "sizes")
    fills = _fills(_slots(_targets(rows, weights, share, most), block, shard_slots))
    parts = _pieces(rows, block).join(fills.hint("merge"), ["source_key", "block"])
    from_word = F.col("block") * block + F.col("at") - F.col("start")
    takes = parts.groupBy("row").agg(F.max("size").alias("size"), F.max("whole").alias("whole"), F.array_sort(F.collect_list(F.when(_once_more() > 0, F.struct(from_word.alias("at"), _once_more().alias("n"))))).alias("once"))
    turned = base.join(takes.hint("merge"), "row").withColumn("turn", F.explode(F.sequence(_long(0), F.col("whole"))))
    every = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*" + WORD + ")"), F.lit(1))
    words = F.aggregate(F.col("once"), _long(0), lambda n, x: n + x["n"])
    cut = F.when(words == F.col("size"), text).otherwise(F.array_join(F.flatten(F.transform(F.col("once"), lambda x: F.slice(every, (x["at"] + 1).cast("int"), x["n"].cast("int")))), ""))
    taken = turned.withColumn("cut", F.when(F.col("turn") < F.col("whole"), text).otherwise(F.when(words > 0, cut))).where(F.col("cut").isNotNull())
    return taken.select(*[F.col("cut").alias(c) if c == text_col else F.col(f"own.`{c}`").alias(c) for c in docs.columns])
