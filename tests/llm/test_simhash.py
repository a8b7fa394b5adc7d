import random

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import simhash
from keyloom.llm.components import components
from keyloom.llm.simhash import differing, drop_near_duplicates, drop_similar, fingerprint, masks, near_links, nearest, parity_sketch, sample_keys, shingle_set, similar_components, simhash_components

SCHEMA = "doc_id bigint, text string, fp string, component int"


def brute_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    name = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and name[a] != name[b]:
                    name[a] = name[b] = min(name[a], name[b])
                    changed = True
    return name


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(["Alpha", "beta", "GAMMA", "Äß", "d\te", "z q"]) + str(rng.randrange(50)) for _ in range(rng.choice([2, 5, 80, 300]))) for _ in range(n // 4)]
    texts = []
    for i in range(n):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = f"new{i}"
        texts.append(" ".join(words))
    return texts + ["", None, " \n ", "one", "ONE"]


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    assert len(masks(4)) == 31 and all((m & (2**64 - 1)).bit_count() >= 32 for m in masks(4))
    for _ in range(3000):
        differing = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(not differing & m for m in masks(4))


def test_fingerprint_matches_plain_one():
    for text in corpus():
        assert fingerprint((text or "").encode()) % 2**64 == brute_print(text or "")


def test_components_match_all_pairs(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.component for r in simhash_components(df, block=3).collect()}
    assert got == brute_components({i: brute_print(t or "") for i, t in enumerate(texts)})


def test_links_see_every_bit(spark):
    rng, prints = random.Random(6), []
    for bit in range(64):
        one = rng.getrandbits(64)
        others = rng.sample([b for b in range(64) if b != bit], 3)
        prints += [one, one ^ 1 << bit, one ^ 1 << bit ^ sum(1 << b for b in others), one ^ sum(1 << b for b in rng.sample(range(64), 6))]
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    name = brute_components({s: p for p, s in signed.items()})
    links = near_links(spark.createDataFrame([(s,) for s in signed.values()], "fp bigint"), block=7)
    got = {r.node: r.root for r in components(links).collect()}
    assert {s: got.get(s, s) for s in name} == name


def test_edge_cases(spark):
    assert simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(5, "a b c d e", None, None), (5, "a b c d e", None, None), (None, "a b c d e", None, None), (3, "A B C D E", None, None), (None, None, None, None)], SCHEMA)
    got = sorted(((r.doc_id, r.component) for r in simhash_components(df).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (None, 3), (3, 3), (None, None)], key=str)
    kept = [tuple(r) for r in drop_near_duplicates(df).collect()]
    assert kept == [(3, "A B C D E", None, None), (None, None, None, None)] or kept[::-1] == [(3, "A B C D E", None, None), (None, None, None, None)]
    assert drop_near_duplicates(df).columns == df.columns and drop_near_duplicates(df.limit(0)).count() == drop_similar(df.limit(0)).count() == 0


@pytest.mark.parametrize("drop", [drop_near_duplicates, drop_similar])
def test_rows_are_dropped_by_row(spark, drop):
    long = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"term{i}" for i in range(60))
    rows = [(5, long, {"k": 1}), (1, long, {"k": 2}), (1, long, {"k": 2}), (5, other, {"k": 3}), (7, None, None), (8, "", {"k": 4}), (None, "only " + other[::-1], {}), (None, "only " + other[::-1], {})]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, t map<string, int>")
    got = sorted(((r.doc_id, r.text, r.t) for r in drop(df.repartition(3)).collect()), key=str)
    assert got == sorted([(1, long, {"k": 2}), (5, other, {"k": 3}), (7, None, None), (None, "only " + other[::-1], {})], key=str)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 180)] + [(1000, i) for i in range(1001, 1200)] + [(7, 7)]
    random.Random(2).shuffle(chain)
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, **{i: 1000 for i in range(1000, 1200)}}
    assert components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0


def test_long_text_uses_every_shingle():
    words = [f"w{i}" for i in range(70000)]
    assert fingerprint(" ".join(words).encode()) % 2**64 == brute_print(" ".join(words))
    assert isinstance(np.int64(fingerprint(b"x")), np.int64)


def five_words(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_similar_texts_find_what_they_are_copies_of(spark):
    rng = random.Random(8)
    rows, group = [], {}
    for k, (n, copies) in enumerate([(30, 2), (60, 4), (90, 3), (250, 6), (250, 60), (900, 5), (3000, 3)]):
        base = [f"{rng.choice('abcdef')}{rng.randrange(5000)}" for _ in range(n)]
        for c in range(copies + 1):
            words = list(base)
            for at in rng.sample(range(n), 0 if not c else max(1, n // 70)):
                words[at] = f"new{c}x{at}"
            group[len(rows)] = k
            rows.append((len(rows), " ".join(words).upper() if c == 1 else " ".join(words), "x", 1))
    for _ in range(80):
        group[len(rows)] = -len(rows)
        rows.append((len(rows), " ".join(f"z{rng.randrange(9000)}" for _ in range(rng.randrange(1, 200))), "x", 1))
    rows += [(1000, "", None, None), (1001, None, None, None), (1002, " ", None, None), (1003, rows[0][1], None, None), (None, rows[0][1], None, None)]
    got = {r.doc_id: r.component for r in similar_components(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    sets = [five_words(r[1] or "") for r in rows]
    for a in group:
        for b in group:
            if a < b and jaccard(sets[a], sets[b]) >= 0.8:
                assert group[a] == group[b]
            if group[a] != group[b]:
                assert got[a] != got[b]
    first = {k: min(i for i in group if group[i] == k) for k in set(group.values())}
    linked = [i for i in group if jaccard(sets[i], sets[first[group[i]]]) >= 0.8]
    assert sum(got[i] == first[group[i]] for i in linked) >= 0.99 * len(linked) and len(linked) > 160
    assert got[1001] == got[1002] == 1000 and got[1003] == got[None] == 0
    kept = {r.doc_id for r in drop_similar(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {i for i in got if i is not None and got[i] == i}


def test_variants_of_a_template_that_is_not_in_the_table(spark):
    rng = random.Random(17)
    base = [f"{rng.choice('abcdef')}{rng.randrange(5000)}" for _ in range(250)]
    edits = [rng.sample(range(250), rng.randint(3, 4)) for _ in range(150)]  # each has its own edits, so pairs scatter about 0.8
    rows = []
    for k, places in enumerate(edits):
        words = list(base)
        for at in places:
            words[at] = f"new{k}x{at}"
        rows.append((k, " ".join(words), "x", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.component for r in similar_components(df).collect()}
    sets = [five_words(r[1]) for r in rows]
    keys = [set(sample_keys(shingle_set(r[1].encode())).tolist()) for r in rows]
    linked = [(a, b) for a in range(150) for b in range(a) if keys[a] & keys[b] and jaccard(sets[a], sets[b]) >= 0.8]
    assert len(linked) > 100 and all(got[a] == got[b] for a, b in linked)


def test_similar_texts_of_an_empty_table(spark):
    assert similar_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketches_differ_in_no_more_bits_than_sets_do():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 63, 64, 65, 300, 20_000)]
    sets += [np.unique(np.r_[s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, len(s) // 12 + 1).astype(np.uint64)]) for s in sets]
    i, j = np.triu_indices(len(sets), 1)
    apart = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    got = differing([parity_sketch(s) for s in sets], i, j)
    assert (got <= apart).all() and (got[apart < 40] >= 0.8 * apart[apart < 40] - 2).all()


def test_nearest_pairs_and_items_that_have_more():
    i, j, far = np.array([0, 0, 0, 1, 2]), np.array([1, 2, 3, 2, 3]), np.array([5, 1, 9, 2, 3])
    x, y, d, more = nearest(i, j, far, 1)
    assert sorted(zip(x.tolist(), y.tolist(), d.tolist(), strict=True)) == [(0, 2, 1), (1, 2, 2), (2, 3, 3)] and more.tolist() == [0, 1, 2, 3]
    assert len(nearest(i, j, far, 3)[0]) == 5 and not len(nearest(i, j, far, 3)[3])


def test_pipeline_links_by_fingerprints(spark):
    """Texts within the radius that have few five-word shingles in common: the covering family links them."""
    rng = random.Random(23)
    words = [f"v{rng.randrange(9000)}" for _ in range(60)]
    one = fingerprint(" ".join(words).encode())
    while True:
        other = list(words)
        for at in rng.sample(range(60), 3):
            other[at] = f"v{rng.randrange(9000)}"
        text = " ".join(other)
        if jaccard(five_words(" ".join(words)), five_words(text)) < 0.8 and ((one ^ fingerprint(text.encode())) % 2**64).bit_count() <= 4:
            break
    df = spark.createDataFrame([(1, " ".join(words), "x", 1), (2, text, "x", 1), (3, "none of these", "x", 1)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 3]


def test_pairs_of_a_group_of_scattered_copies_grow_with_its_size(spark, monkeypatch):
    rng, sizes = random.Random(29), []
    base = [f"{rng.choice('abcdef')}{rng.randrange(5000)}" for _ in range(250)]
    rows = []
    for k in range(300):
        words = list(base)
        for at in rng.sample(range(250), rng.randint(5, 12)):
            words[at] = f"new{k}x{at}"
        rows.append((k, " ".join(words), "x", 1))
    plain = simhash.persisted

    def counted(df, name):
        out = plain(df, name)
        if name == "pairs":
            sizes.append(out[0].count())
        return out

    monkeypatch.setattr(simhash, "persisted", counted)
    assert similar_components(spark.createDataFrame(rows, SCHEMA)).count() == 300
    assert sum(sizes[1:]) <= 2 * len(rows)  # pairs beside those with pivots
