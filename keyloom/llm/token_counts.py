"""Token counts of texts under a unigram model, by dynamic programming over a trie of distinct words.

Words are cut at white space and get the mark of a word's start. The best segmentation of a word maximises the sum of its
pieces' log-probabilities; the forward scores of a prefix do not depend on what follows, so words that share a prefix
share the trie's nodes and their scores, and each terminal node keeps the number of tokens of its word.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Nodes of a trie, words whose counts a worker remembers, and characters of text that are counted together.
NODES, REMEMBER, AT_ONCE = 400_000, 500_000, 2_000_000
#: Characters of the longest word that gets nodes; longer ones are scored without them, and not remembered.
LONG = 1000


def pieces_of(model_file: str) -> dict[str, float]:
    """Log-probabilities of the pieces of a sentencepiece file, its control, unknown and byte pieces left out.

    The file lists pieces from the most to the least frequent. Where its scores are only those ranks, as in files of merges,
    the probabilities are taken to follow Zipf's law with Mandelbrot's shift: p(rank) ~ 1 / (rank + 2.7).
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())}
    if all(scores[n] == round(scores[n]) for n in names):
        total = math.log(sum(1 / (k + 2.7) for k in range(len(names))))
        return {n: -math.log(k + 2.7) - total for k, n in enumerate(names)}
    return {n: scores[n] for n in names}


class Trie:
    """Words with their forward scores: at each node, the best score of its prefix and the tokens of that segmentation.

    A character that no piece covers costs its UTF-8 bytes, each a token with a score below all pieces. Of segmentations
    with equal scores the one with fewer tokens counts.
    """

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.byte = min(pieces.values(), default=0.0) - 10
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.tokens = [0.0], [0]
        self.terminal: dict[int, int] = {}

    def insert(self, word: str) -> int:
        """The number of tokens of a word; only the nodes below its longest known prefix are scored."""
        child, path, node, known = self.child, [0], 0, 0
        for c in word:
            if (below := child.get((node, c))) is None:
                break
            node = below
            path.append(node)
            known += 1
        for end in range(known + 1, len(word) + 1):
            n = len(word[end - 1].encode())
            best, least = self.score[path[end - 1]] + n * self.byte, self.tokens[path[end - 1]] + n
            for start in range(max(0, end - self.longest), end):
                if (p := self.pieces.get(word[start:end])) is not None:
                    s, t = self.score[path[start]] + p, self.tokens[path[start]] + 1
                    if s > best or (s == best and t < least):
                        best, least = s, t
            self.score.append(best)
            self.tokens.append(least)
            child[node, word[end - 1]] = node = len(self.score) - 1
            path.append(node)
        self.terminal[node] = self.tokens[node]
        return self.terminal[node]


    def tokens_of(self, word: str) -> int:
        """The number of tokens of a word, from the scores of as many prefixes as the longest piece has characters."""
        score, tokens = deque([0.0], self.longest), deque([0], self.longest)
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            best, least = score[-1] + n * self.byte, tokens[-1] + n
            for back in range(len(score), 0, -1):
                if (p := self.pieces.get(word[end - back : end])) is not None:
                    s, t = score[-back] + p, tokens[-back] + 1
                    if s > best or (s == best and t < least):
                        best, least = s, t
            score.append(best)
            tokens.append(least)
        return tokens[-1]


class Counter:
    """Tokens of whole texts; remembers the counts of a bounded number of words, and holds one trie at a time."""

    def __init__(self, pieces: dict[str, float]):
        self.trie, self.known = Trie(pieces), {}

    def count(self, texts: Iterable[str]) -> list[tuple[int, int]]:
        """(words, tokens) of each text."""
        cut = [t.split() for t in texts]
        if len(self.known) > REMEMBER:
            self.known.clear()
        known, insert, long = self.known, self.trie.insert, {}
        for w in sorted({w for words in cut for w in words if w not in known}):
            if len(w) > LONG:
                long[w] = self.trie.tokens_of(MARK + w)
                continue
            known[w] = insert(MARK + w)
            if len(self.trie.score) > NODES:
                self.trie.clear()
        return [(len(words), sum(known[w] if len(w) <= LONG else long[w] for w in words) if long else sum(map(known.__getitem__, words))) for words in cut]


_COUNTERS: dict[str, Counter] = {}


def _counter(model_file: str) -> Counter:
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = Counter(pieces_of(model_file))
    return _COUNTERS[model_file]


def count_tokens(docs: DataFrame, model_file: str, text_col: str = "text", words: str = "n_words", tokens: str = "n_tokens") -> DataFrame:
    """docs with the numbers of words and tokens of each whole text; model_file: a sentencepiece file on every executor.

    Null and empty texts have none. Rows are counted on their own, so repeated rows get equal counts; other columns stay,
    those with the names of the results are replaced; an empty table stays empty. Nothing is exchanged: each worker shares
    its trie over the words that its tasks meet.
    """

    @F.arrow_udf("struct<w: bigint, t: bigint>")
    def count(texts: pa.Array) -> pa.Array:
        counter, out, part, held = _counter(model_file), [], [], 0
        for t in texts:
            part.append(t.as_py())
            held += len(part[-1])
            if held >= AT_ONCE:
                out += counter.count(part)
                part, held = [], 0
        out += counter.count(part)
        return pa.StructArray.from_arrays([pa.array([w for w, _ in out], pa.int64()), pa.array([t for _, t in out], pa.int64())], ["w", "t"])

    own = [c for c in docs.columns if c not in (words, tokens)]
    counted = docs.select(*own, count.asNondeterministic()(F.coalesce(F.col(text_col), F.lit(""))).alias("_counts"))
    return counted.select(*own, F.col("_counts.w").alias(words), F.col("_counts.t").alias(tokens))
