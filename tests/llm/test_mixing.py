import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from keyloom.llm.mixing import drawn_slots, mix_counts, mixed_documents, mixture_slots, settled_slots
from keyloom.llm.queries import OP9_SQL

SCHEMA = "doc_id bigint, text string, source string, size string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    sources = ["b", "a", "Z", None, "é", ""]
    rows = []
    for i in range(n):
        k = rng.choice([0, 1, 5, 40, 900])
        rows.append((i, " \n".join(f"w{rng.randrange(99)}" for _ in range(k)), rng.choices(sources, [60, 5, 5, 3, 2, 1])[0], "x"))
    return rows + [(None, None, "a", None), (3, "one two", "b", "x"), (3, "one two", "b", "x")]


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    share = 1.5 * sum(sizes.values())
    capped = {}
    while True:
        rest = [s for s in order if s not in capped]
        left = share - sum(capped.values())
        target = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest} | capped
        over = {s: 2.0 * sizes[s] for s in rest if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_counts_meet_targets_and_caps(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix_counts(df.repartition(3)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(words(r[1]))
    want = brute_targets(sizes)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[round(r.target, 6)].append(r)
    for s, target in want.items():
        own = by[round(target, 6)]
        assert {r.source_size for r in own} == {sizes[s]}
        assert abs(sum(r.taken for r in own) - target) <= 1
    again = mix_counts(df).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_sql_gives_the_same(spark):
    rows = corpus(seed=4)
    got = mix_counts(spark.createDataFrame(rows, SCHEMA)).toPandas()
    documents = spark.createDataFrame(rows, SCHEMA).toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    want = duckdb.sql(OP9_SQL).df()
    key = lambda df: sorted(tuple(-1.0 if x != x or x is None else round(float(x), 6) for x in r) for r in df[["doc_id", "size", "source_size", "target", "taken"]].astype("float64").itertuples(index=False))
    assert key(got) == key(want) and len(got) == len(rows)


def test_draws_follow_the_multinomial_and_totals_are_settled(spark):
    quotas = {"a": 6000, "b": 2500, "c": 1400, "d": 90, "e": 10}
    table = spark.createDataFrame(list(quotas.items()), "source_key string, quota bigint")
    per, total = 100, sum(quotas.values())
    drawn = drawn_slots(table, per).toPandas()
    assert sorted(drawn["slot"]) == list(range(total)) and (drawn["shard"] == drawn["slot"] // per).all()
    counts = drawn.groupby(["shard", "source_key"]).size().unstack(fill_value=0)
    for s, quota in quotas.items():  # a shard's count of a source has the binomial's mean and variance
        p = quota / total
        assert abs(counts[s].mean() - per * p) < 4 * (per * p * (1 - p) / len(counts)) ** 0.5
        assert 0.55 < counts[s].var() / (per * p * (1 - p)) < 1.6
    together = counts["a"].cov(counts["b"]) / -(per * 0.6 * 0.25)  # and two sources the multinomial's covariance
    assert 0.5 < together < 1.6
    settled = settled_slots(drawn_slots(table, per), table).toPandas()
    assert sorted(settled["slot"]) == list(range(total))
    for s, quota in quotas.items():
        assert sorted(settled.loc[settled["source_key"] == s, "k"]) == list(range(quota))
    both = drawn.merge(settled, on="slot")
    assert (both["source_key_x"] != both["source_key_y"]).sum() == sum(max(0, n - quotas[s]) for s, n in drawn["source_key"].value_counts().items())
    other = drawn_slots(table, per, seed=1).toPandas().sort_values("slot")
    assert (other["source_key"].values != drawn.sort_values("slot")["source_key"].values).mean() > 0.3


@pytest.mark.parametrize("block", [7, 256])
def test_documents_and_slots_agree_with_counts(spark, block):
    rows = [r for r in corpus(120, 2) if r[0] not in (3, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    counts = {r.doc_id: r.taken for r in mix_counts(df, block=block).collect()}
    taken = Counter()
    texts = {r[0]: words(r[1]) for r in rows}
    out = mixed_documents(df, block=block)
    assert out.columns == df.columns
    for r in out.collect():
        taken[r.doc_id] += len(words(r.text))
        left = iter(texts[r.doc_id])
        assert all(w in left for w in words(r.text))  # words of the document in their order
    assert all(taken[k] == v for k, v in counts.items())
    slots = mixture_slots(df, block=block, shard_slots=50).collect()
    assert sum(r.words for r in slots) == sum(counts.values())
    per_shard = Counter(r.shard for r in slots)
    assert max(per_shard.values()) == min(50, len(slots)) and sorted(r.slot for r in slots) == list(range(len(slots)))
    turns = defaultdict(list)
    for r in slots:
        turns[r.source_key, r.block].append(r.turn)
    assert all(sorted(t) == list(range(len(t))) for t in turns.values())


def test_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix_counts(empty).count() == 0 and mixed_documents(empty).count() == 0
    nothing = spark.createDataFrame([(1, None, None, None), (None, "", "a", None), (2, " \t", "a", None)], SCHEMA)
    assert {r.taken for r in mix_counts(nothing).collect()} == {0} and mix_counts(nothing).count() == 3
    assert mixed_documents(nothing).count() == 0
    twice = spark.createDataFrame([(1, "a b c", "s", "x")] * 3, SCHEMA)
    assert sum(len(words(r.text)) for r in mixed_documents(twice).collect()) == sum(r.taken for r in mix_counts(twice).collect()) == 13


def test_rows_that_share_an_id_or_repeat_keep_their_columns(spark):
    rows = [(1, "a b c d", "s", "en", {"k": 1}), (1, "a b c d", "s", "de", {"k": 2}), (1, "x y", "s", "fr", None), (None, "p q r", "s", "it", {}), (None, "p q r", "s", "it", {})]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, row string, own map<string, int>")
    out = mixed_documents(df, block=2).collect()
    assert {r.row for r in out} == {"en", "de", "fr", "it"}
    for r in out:
        assert any(r.doc_id == x[0] and r.row == x[3] and r.own == x[4] and iter_in(words(r.text), words(x[1])) for x in rows)
    assert Counter(len(words(r.text)) for r in out) and sum(len(words(r.text)) for r in out) == 24


def iter_in(some, every):
    left = iter(every)
    return all(w in left for w in some)
