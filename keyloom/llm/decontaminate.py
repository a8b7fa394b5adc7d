"""Training texts that hold benchmark items: BM25 over an inverted index of the items, with block-max WAND.

The documents are the queries: each passage of each text is run against the index. An item's weights are divided by the
score that it must reach, so that one threshold, 1, holds for all items.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import persisted, scratch

K1, B, SHINGLE, OVERLAP = 1.2, 0.75, 5, 0.8
#: Items of an index shard, items of a column of the passage filter, postings of a block.
SHARD, COLUMN, POSTINGS = 2000, 8, 8
#: Words of texts that are searched together, in one shard and in each of several; shards that a worker keeps.
AT_ONCE, AT_ONCE_OF_MANY, KEPT = 1 << 16, 1 << 20, 2
EPS = 1e-6
#: Each byte as it is, but for the signs of ASCII.
_SIGNS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[bytes]:
    """The words of a text in lower case, as UTF-8; the signs of ASCII and white space are between words."""
    return text.lower().encode().translate(_SIGNS).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words before the last sentence of an item, and those of the last sentence; a single sentence is a question."""
    parts = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    return ([w for p in parts[:-1] for w in p], parts[-1]) if len(parts) > 1 else (parts[0] if parts else [], [])


def shingles(words: list[bytes], n: int = SHINGLE) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


class Item:
    def __init__(self, item_id: int | None, text: str):
        self.id, self.words = item_id, words_of(text)
        question, answer = question_and_answer(text)
        self.whole = shingles(self.words)
        self.question, self.answer = shingles(question), Counter(answer)

    def overlaps(self, passage: list[bytes]) -> tuple[float, float, float]:
        """Shares of the item's shingles, of its question's shingles and of its answer's words that the passage holds."""
        if len(self.words) < SHINGLE:
            n = len(self.words)
            hit = float(any(passage[i : i + n] == self.words for i in range(len(passage) - n + 1)))
            return hit, hit, hit
        own = shingles(passage)
        whole = len(self.whole & own) / len(self.whole)
        inner = shingles(passage, len(next(iter(self.question)))) if self.question and len(next(iter(self.question))) < SHINGLE else own
        question = len(self.question & inner) / len(self.question) if self.question else whole
        answer = (self.answer & Counter(passage)).total() / self.answer.total() if self.answer else question
        return whole, question, answer


class Index:
    """Inverted index of items whose lengths are within a factor of two."""

    def __init__(self, items: list[Item], idf: dict[bytes, float], mean: float, overlap: float = OVERLAP):
        self.items = items
        self.cell = (max(len(x.words) for x in items) + 1) // 2
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for k, item in enumerate(items):
            tf, n = Counter(item.words), len(item.words)
            weight = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * n / mean)) for t, f in tf.items()}
            lost = sorted(weight.values(), reverse=True)[: int((1 - overlap) * n + EPS)]
            least = max(sum(weight.values()) - sum(lost), EPS)  # what a passage with enough of the shingles scores at least
            for t, w in weight.items():
                postings.setdefault(t, []).append((k, w / least))
        self.terms = {t: k for k, t in enumerate(postings)}
        self.docs = [[k for k, _ in p] for p in postings.values()]
        self.weights = [[w for _, w in p] for p in postings.values()]
        self.most = [max(w) for w in self.weights]
        self.blocks = [[max(w[i : i + POSTINGS]) for i in range(0, len(w), POSTINGS)] for w in self.weights]
        rare = [t for t, d in enumerate(self.docs) if len(d) <= max(2, len(items) // 10)]
        n = -(-len(items) // COLUMN)
        self.row = np.full(len(self.terms), -1)  # of the rare terms
        self.row[rare] = np.arange(len(rare))
        self.columns = np.zeros((len(rare), n))
        common = np.zeros(n * COLUMN)
        for t, (docs, ws) in enumerate(zip(self.docs, self.weights, strict=True)):
            if self.row[t] >= 0:
                np.maximum.at(self.columns[self.row[t]], np.array(docs) // COLUMN, ws)
            else:
                common[docs] += ws
        self.common = common.reshape(n, COLUMN).max(axis=1)

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """Items that score 1 or more for a passage of distinct terms, with their scores."""
        at = dict.fromkeys(terms, 0)
        found = []
        while True:
            order = sorted((t for t in at if at[t] < len(self.docs[t])), key=lambda t: self.docs[t][at[t]])
            sum_, pivot = 0.0, None
            for k, t in enumerate(order):
                sum_ += self.most[t]
                if sum_ >= 1 - EPS:
                    pivot = k
                    break
            if pivot is None:
                return found
            doc = self.docs[order[pivot]][at[order[pivot]]]
            while pivot + 1 < len(order) and self.docs[order[pivot + 1]][at[order[pivot + 1]]] == doc:
                pivot += 1
            bound, ahead = 0.0, self.docs[order[pivot + 1]][at[order[pivot + 1]]] if pivot + 1 < len(order) else len(self.items)
            for t in order[: pivot + 1]:
                docs = self.docs[t]
                i = bisect_left(docs, doc, at[t])
                if i < len(docs):
                    block = i // POSTINGS
                    bound += self.blocks[t][block]
                    ahead = min(ahead, docs[min(len(docs), (block + 1) * POSTINGS) - 1] + 1)
            if bound < 1 - EPS:  # no item before `ahead` can do
                for t in order[: pivot + 1]:
                    at[t] = bisect_left(self.docs[t], max(ahead, doc + 1), at[t])
                continue
            score = 0.0
            for t in order[: pivot + 1]:
                i = at[t] = bisect_left(self.docs[t], doc, at[t])
                if i < len(self.docs[t]) and self.docs[t][i] == doc:
                    score += self.weights[t][i]
                    at[t] = i + 1
            if score >= 1 - EPS:
                found.append((doc, score))

    def passages(self, lengths: list[int], terms: np.ndarray, known: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """Text, start and distinct terms of the passages that may hold an item.

        terms: the terms of all texts, one text after the other, -1 for others; known: where they are not -1. Texts are
        cut into cells of half the longest item's length; a passage is four cells, and one starts at each. What the items
        of a column can score is bounded by the block maxima of the distinct rare terms of each cell, and by what the
        common terms of any of them weigh. The bounds of all passages of all texts are worked out at once.
        """
        rows = self.row[terms[known]]
        rare = rows >= 0
        at, rows = known[rare], rows[rare]
        if not len(at) and (self.common < 1 - EPS).all():
            return
        first = np.cumsum([0, *[max(1, -(-n // self.cell)) for n in lengths]])
        begin = np.cumsum([0, *lengths])
        sums = np.zeros((first[-1] + 3, self.columns.shape[1]))
        if len(at):
            text = np.searchsorted(begin, at, "right") - 1
            cell = first[text] + (at - begin[text]) // self.cell
            cell, row = np.divmod(np.unique(cell * len(self.columns) + rows), len(self.columns))
            heads = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sums[cell[heads]] = np.add.reduceat(self.columns[row], heads, axis=0)
        bounds = sums[:-3] + sums[1:-2] + sums[2:-1] + sums[3:]  # the last cells of a text also see the next text's: a bound still
        for k in np.flatnonzero((bounds + self.common >= 1 - EPS).any(axis=1)):
            i = int(np.searchsorted(first, k, "right")) - 1
            start = int(k - first[i]) * self.cell
            own = terms[begin[i] + start : min(begin[i + 1], begin[i] + start + 4 * self.cell)]
            yield i, start, [t for t in set(own.tolist()) if t >= 0]


class Searcher:
    """The indexes of a shard, one for each range of item lengths, over shared term numbers."""

    def __init__(self, items: list[Item], idf: dict[bytes, float], mean: float, overlap: float = OVERLAP):
        by_length: dict[int, list[Item]] = {}
        for x in items:
            by_length.setdefault((len(x.words) - 1).bit_length(), []).append(x)
        self.indexes = [Index(xs, idf, mean, overlap) for _, xs in sorted(by_length.items())]
        self.overlap = overlap
        self.terms = {t: k for k, t in enumerate(sorted({w for x in items for w in x.words}))}
        self.own = []
        for index in self.indexes:
            own = np.full(len(self.terms) + 1, -1)  # the last: words of no item
            own[[self.terms[t] for t in index.terms]] = list(index.terms.values())
            self.own.append(own)

    def search(self, texts: list[list[bytes]]) -> list[list[tuple]]:
        """(id, score, whole, question, answer) of the items that a passage of each text holds."""
        lengths = list(map(len, texts))
        every = np.fromiter(map(self.terms.get, chain.from_iterable(texts), repeat(-1)), np.int64, sum(lengths))
        out: list[list[tuple]] = [[] for _ in texts]
        for index, own in zip(self.indexes, self.own, strict=True):
            terms = own[every]
            best: dict[tuple[int, int], tuple] = {}
            for i, start, passage in index.passages(lengths, terms, np.flatnonzero(terms >= 0)):
                for k, score in index.wand(passage):
                    whole, question, answer = index.items[k].overlaps(texts[i][start : start + 4 * index.cell])
                    if whole >= self.overlap or min(question, answer) >= self.overlap:
                        best[i, k] = max(best.get((i, k), (0.0,) * 4), (whole, question, answer, score), key=lambda x: (x[0], x[3]))
            for (i, k), (whole, question, answer, score) in sorted(best.items()):
                out[i].append((index.items[k].id, score, whole, question, answer))
        return out


HIT = "array<struct<item_id: bigint, score: double, overlap: double, question: double, answer: double>>"
_ARROW_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))


def _write_shard(searcher: Searcher, uri: str, number: int) -> str:
    files, root = fs.FileSystem.from_uri(uri)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/{number:06d}.index") as out:
        out.write(pickle.dumps(searcher))
    return f"{uri}/{number:06d}.index"


@lru_cache(KEPT)
def _read_shard(uri: str) -> Searcher:
    files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_stream(path) as file:
        return pickle.loads(file.read())


def _finder(shards: list[str]):
    """A function that searches texts in shards of the index, which workers read from the shared folder one by one."""
    most = AT_ONCE if len(shards) == 1 else AT_ONCE_OF_MANY

    @F.arrow_udf(HIT)
    def find(texts: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        batch: list[list[bytes]] = []

        def search() -> None:
            found: list[list[dict]] = [[] for _ in batch]
            for shard in shards:
                for own, hits in zip(found, _read_shard(shard).search(batch), strict=True):
                    own += [dict(zip(("item_id", "score", "overlap", "question", "answer"), h, strict=True)) for h in hits]
            out.extend(found)
            batch.clear()

        held = 0
        for t in texts:
            batch.append(words_of(t.as_py()))
            held += len(batch[-1])
            if held >= most:
                search()
                held = 0
        if batch:
            search()
        return pa.array(out, _ARROW_HIT)

    return find.asNondeterministic()  # else the optimizer would run it twice, for a filter too


def find_benchmark_items(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "item_id", item_col: str = "text", overlap: float = OVERLAP, shard: int = SHARD, out: str = "hits") -> DataFrame:
    """docs with the column `out`: the items that a passage of the row's text holds.

    An item is held if the passage has at least `overlap` of the item's five-word shingles, or of its question's shingles
    and its answer's words; words are compared in lower case, without signs. Passages are windows of twice the length of
    the items sought, each starting half a length after the last. The index is written in shards of at most `shard` items,
    which the driver makes and the workers read one after the other, while the documents are read once; document
    frequencies are those of all items. Null texts count as empty and hold nothing, items without words are never held, repeated
    items are each found. A column of docs named so is replaced. An empty table of items gives empty lists.
    """
    spark = docs.sparkSession

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [words_of(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(r) for r in rows], pa.int64()), pa.array([[w.decode() for w in sorted(set(r))] for r in rows], pa.list_(pa.string()))], ["n", "terms"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(item_col).alias("text"))
    counted, _ = persisted(rows.select("text").mapInArrow(terms, "n bigint, terms array<string>").where("n > 0"), "items")
    about = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean")).first()
    frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    own, uri = [c for c in docs.columns if c != out], scratch(spark, "index")
    shards: list[str] = []

    def add(batch: list[Item]) -> None:
        names = spark.createDataFrame([(w.decode(),) for w in sorted({w for x in batch for w in x.words})], "term string")
        df = {r["term"].encode(): r["df"] for r in frequency.join(F.broadcast(names), "term").collect()}  # terms of one shard
        idf = {t: float(np.log1p((about["n"] - d + 0.5) / (d + 0.5))) for t, d in df.items()}
        shards.append(_write_shard(Searcher(batch, idf, about["mean"], overlap), uri, len(shards)))

    batch: list[Item] = []
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if (item := Item(r["item_id"], r["text"] or "")).words:
            batch.append(item)
        if len(batch) == shard:
            add(batch)
            batch = []
    if batch:
        add(batch)
    held = _finder(shards)(F.coalesce(F.col(text_col), F.lit(""))) if shards else F.array().cast(HIT)
    return docs.select(*own, held.alias(out))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the rows whose text holds a benchmark item."""
    return find_benchmark_items(docs, items, out="_held", **options).where(F.size("_held") == 0).select(*docs.columns)
