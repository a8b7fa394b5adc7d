import random
from functools import cache

import public_tokenizers
import pytest

from keyloom.llm.token_counts import MARK, Counter, Trie, count_tokens, pieces_of

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, n_tokens string"


def brute(word, pieces, byte):
    """(score, -tokens) of the best of all segmentations, from left to right."""

    @cache
    def best(end):
        if not end:
            return 0.0, 0
        s, t = best(end - 1)
        n = len(word[end - 1].encode())
        options = [(s + n * byte, t - n)]
        for start in range(end):
            if (p := pieces.get(word[start:end])) is not None:
                s, t = best(start)
                options.append((s + p, t - 1))
        return max(options)

    return -best(len(word))[1]


def test_small_model():
    pieces = {MARK: -1.0, "a": -2.0, "b": -2.0, "ab": -3.5, "aba": -6.0, MARK + "a": -3.0}
    rng = random.Random(1)
    trie = Trie(pieces)
    for _ in range(500):
        word = MARK + "".join(rng.choice("abcé") for _ in range(rng.randrange(9)))
        assert trie.insert(word) == brute(word, pieces, trie.byte) == trie.insert(word)
    assert len(trie.score) == 1 + len(trie.child)  # a node for each distinct prefix


@pytest.fixture(scope="module")
def pieces():
    return pieces_of(PATH)


def test_public_model(pieces):
    assert len(pieces) > 30_000 and all(p < 0 for p in pieces.values())
    counter, rng = Counter(pieces), random.Random(2)
    words = ["the", "Licensed", "xyzzyqq", "日本", "ö" * 20, "a" * 300, "don't"] + ["".join(rng.choice("aeithnsr") for _ in range(12)) for _ in range(60)]
    for w, (n, t) in zip(words, counter.count(words), strict=True):
        assert n == 1 and t == brute(MARK + w, pieces, counter.trie.byte)


def test_tables(spark, pieces):
    rows = [(1, "the cat  the\ncat", "x"), (1, "the cat  the\ncat", "x"), (None, None, None), (2, "", None), (3, "word " * 50_000, None)]
    out = count_tokens(spark.createDataFrame(rows, SCHEMA), PATH)
    assert out.columns == ["doc_id", "text", "n_words", "n_tokens"]
    counter = Counter(pieces)
    assert [(r.n_words, r.n_tokens) for r in out.collect()] == counter.count([r[1] or "" for r in rows])
    assert count_tokens(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_long_words_are_scored_alike_without_nodes(monkeypatch):
    pieces = {MARK: -1.0, "a": -2.0, "b": -2.0, "ab": -3.5, "aba": -6.0, MARK + "a": -3.0}
    rng, trie = random.Random(5), Trie(pieces)
    for _ in range(200):
        word = MARK + "".join(rng.choice("abcé") for _ in range(rng.randrange(40)))
        assert trie.tokens_of(word) == brute(word, pieces, trie.byte)
    assert len(trie.score) == 1
    counter = Counter(pieces)
    word = "ab" * 50_000
    assert counter.count([f"ab {word} ab", word]) == [(3, 2 * counter.known["ab"] + trie.tokens_of(MARK + word)), (1, trie.tokens_of(MARK + word))]
    assert word not in counter.known and len(counter.trie.score) < 10
