import random
from collections import Counter

import numpy as np
import pytest

from keyloom.llm.decontaminate import Index, Item, Searcher, drop_contaminated, find_benchmark_items, question_and_answer, words_of

SCHEMA = "doc_id bigint, text string, hits string, item_id int"


def sentence(rng, n, words=400):
    return " ".join(f"w{min(rng.randrange(words), rng.randrange(words))}" for _ in range(n)) + "."


def index_of(texts, overlap=0.8):
    items = [Item(i, t) for i, t in enumerate(texts)]
    df = Counter(w for x in items for w in set(x.words))
    idf = {t: float(np.log1p((len(items) - d + 0.5) / (d + 0.5))) for t, d in df.items()}
    return items, idf, float(np.mean([len(x.words) for x in items]))


def test_wand_finds_all_items_above_the_threshold():
    rng = random.Random(1)
    texts = [sentence(rng, rng.randint(16, 32), 120) for _ in range(120)]
    items, idf, mean = index_of(texts)
    index = Index(items, idf, mean)
    names = list(index.terms)
    found = 0
    for _ in range(150):
        words = words_of(rng.choice(texts))[: rng.randint(10, 32)] + words_of(sentence(rng, 30, 120))
        terms = list({index.terms[w] for w in words if w in index.terms})
        want = Counter()
        for t in terms:
            for k, w in zip(index.docs[t], index.weights[t], strict=True):
                want[k] += w
        want = {k: v for k, v in want.items() if v >= 1 - 1e-6}
        got = dict(index.wand(terms))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
        found += len(got)
    assert found > 50 and len(names) > 50


def test_search_matches_comparing_every_item_with_every_text():
    rng = random.Random(2)
    texts = [sentence(rng, rng.randint(3, 60)) + " " + sentence(rng, rng.randint(1, 6)) for _ in range(80)]
    items, idf, mean = index_of(texts)
    searcher = Searcher(items, idf, mean)
    docs, want = [], []
    for _ in range(120):
        item = rng.choice(items)
        kept = list(item.words)
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            kept[rng.randrange(len(kept))] = b"changed"
        docs.append(words_of(sentence(rng, rng.randrange(200))) + kept + words_of(sentence(rng, rng.randrange(200))))
    for words in docs:
        own = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        want.append({x.id for x in items if (len(x.whole & own) >= 0.8 * len(x.whole) if len(x.words) >= 5 else any(words[i : i + len(x.words)] == x.words for i in range(len(words))))})
    got = [{h[0] for h in hits} for hits in searcher.search(docs)]
    assert sum(map(len, want)) > 60
    assert all(w <= g for w, g in zip(want, got, strict=True))
    for words, hits in zip(docs, searcher.search(docs), strict=True):
        for item_id, score, whole, question, answer in hits:
            assert score > 0.99 and (whole >= 0.8 or min(question, answer) >= 0.8), item_id


def test_items_without_rare_terms_are_found():
    rng = random.Random(6)
    text = sentence(rng, 20)
    items, idf, mean = index_of([text] * 4 + [sentence(rng, 300)])
    for item in items[:4]:
        assert not set(item.words) - set(items[0].words)
    searcher = Searcher(items, idf, mean)
    assert any((index.row < 0).all() for index in searcher.indexes)
    other = words_of(" ".join(f"x{k}" for k in range(90)))
    hits = searcher.search([other, other + words_of(text) + other])
    assert [{h[0] for h in x} for x in hits] == [set(), {0, 1, 2, 3}]
    assert [{h[0] for h in x} for x in searcher.search([words_of(text)])] == [{0, 1, 2, 3}]


def test_question_and_answer():
    assert question_and_answer("What is it? One two.\nThe answer.") == (words_of("What is it One two"), words_of("The answer"))
    assert question_and_answer("Only one sentence.") == (words_of("Only one sentence"), [])
    assert question_and_answer("") == ([], [])


@pytest.mark.parametrize("shard", [3, 100])
def test_tables(spark, shard):
    rng = random.Random(4)
    texts = [sentence(rng, 20) for _ in range(10)]
    items = spark.createDataFrame([*enumerate(texts), (50, texts[0]), (None, None), (60, ""), (61, "!!")], "item_id bigint, text string")
    rows = [(1, "before " + texts[3].upper().replace(".", "%%% after"), "x", 1), (2, sentence(rng, 300), "x", 1), (3, None, None, None), (3, "", None, None), (None, texts[0] + " " + texts[1], None, None), (5, sentence(rng, 60_000) + texts[9], "x", 1), (5, sentence(rng, 5), "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = find_benchmark_items(docs, items, shard=shard)
    assert found.columns == ["doc_id", "text", "item_id", "hits"]
    got = [(r.doc_id, sorted(h.item_id for h in r.hits)) for r in found.collect()]
    assert got == [(1, [3]), (2, []), (3, []), (3, []), (None, [0, 1, 50]), (5, [9]), (5, [])]
    kept = drop_contaminated(docs, items, shard=shard)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2, 3, 3, 5]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a b c", None, None)], SCHEMA)
    assert [r.hits for r in find_benchmark_items(docs, none).collect()] == [[]]
    assert find_benchmark_items(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).count() == 0
