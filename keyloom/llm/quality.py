"""A quality classifier learnt from positive and unlabelled texts by the non-negative unbiased risk (Kiryo et al., 2017).

A linear model of character and word statistics is fitted on the driver, from bounded samples of the trusted positives and
of the unlabelled text. The share of positives, which the risk needs, is estimated over all unlabelled text. Every text is
then scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
#: Bound of each of the two samples that the weights are fitted on, in texts.
SAMPLE = 6000
#: Fewest texts of each sample for an estimate of the prior, and the prior without one.
FEWEST, NO_PRIOR = 20, 0.5
_LETTER, _UPPER, _DIGIT, _SPACE, _LINE, _HIGH, _CONTROL = range(7)


def _classes() -> np.ndarray:
    """The class of each byte: letters, digits, white space and bytes beyond ASCII share one each, signs have their own."""
    kind, signs = np.full(256, _CONTROL, np.int64), _CONTROL + 1
    for b in range(256):
        c = chr(b)
        if b >= 128:
            kind[b] = _HIGH
        elif c.isalpha():
            kind[b] = _UPPER if c.isupper() else _LETTER
        elif c.isdigit():
            kind[b] = _DIGIT
        elif c == "\n":
            kind[b] = _LINE
        elif c in " \t":
            kind[b] = _SPACE
        elif c.isprintable():
            kind[b], signs = signs, signs + 1
    return kind


CLASS = _classes()
N = int(CLASS.max()) + 1
EXTRA = 10
SIZE = N + N * N + EXTRA


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the statistics of a whole UTF-8 text; an empty one has only the constant."""
    kinds = CLASS[np.frombuffer(text, np.uint8)]
    words = text.split()
    extra = np.zeros(EXTRA)
    extra[0] = 1
    counts = np.bincount(kinds, minlength=N)
    pairs = np.bincount(kinds[:-1] * N + kinds[1:], minlength=N * N) if len(kinds) > 1 else np.zeros(N * N, np.int64)
    if words:
        n = len(words)
        lines = [x for x in text.split(b"\n") if x]
        again = sum(map(bytes.__eq__, words, words[1:])) / n
        plain = sum(map(bytes.isalnum, words)) / n
        extra[1:] = [
            again,
            again > 0.02,
            1 - len(set(words)) / n,
            (1 - len(set(words)) / n) ** 2,
            1 - len(set(lines)) / max(1, len(lines)),
            np.log1p(n) / 10,
            n < 5,
            min(1.0, len(text) / n / 20),
            plain,
        ]
    values = np.concatenate([np.sqrt(counts / max(1, len(kinds))), np.sqrt(pairs / max(1, len(kinds))), extra])
    at = np.flatnonzero(values)
    return at.astype(np.int32), values[at].astype(np.float32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    prior: float
    #: Whether there were texts to learn from; else all scores are 0.5.
    learnt: bool = True

    def score(self, text: bytes) -> float:
        g = self.margin(text)
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))

    def margin(self, text: bytes) -> float:
        at, values = features(text)
        return float(np.dot(self.weights[at], values))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int, rate: float, decay: float, seed: int) -> np.ndarray:
    """Weights by Adam. With a prior: the non-negative unbiased risk with the logistic loss; without: p against u."""
    rng, w = np.random.default_rng(seed), np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        a, b = p[rng.integers(0, len(p), 512)], u[rng.integers(0, len(u), 512)]
        ga, gb = a @ w, b @ w
        as_positive, as_negative = -_sigmoid(-ga) @ a / len(a), _sigmoid(ga) @ a / len(a)
        unlabelled = _sigmoid(gb) @ b / len(b)
        if prior is None:
            grad = as_positive + unlabelled
        else:
            below = np.logaddexp(0, gb).mean() - prior * np.logaddexp(0, ga).mean()
            grad = prior * as_positive + unlabelled - prior * as_negative if below >= 0 else prior * as_negative - unlabelled
        grad = grad + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _used(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    return np.flatnonzero(p.any(axis=0) | u.any(axis=0))  # most pairs of signs never occur


def _weights(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int, rate: float, decay: float, seed: int) -> np.ndarray:
    used, out = _used(p, u), np.zeros(SIZE)
    out[used] = _fit(p[:, used].astype(np.float64), u[:, used].astype(np.float64), prior, steps, rate, decay, seed)
    return out


def prior_cuts(p: np.ndarray, u: np.ndarray, others: np.ndarray, steps: int = 400, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of a classifier of p against u; cuts of its scores of other positives; their share at or above each."""
    w = _weights(p, u, None, steps, 0.02, 1e-4, seed)
    sp = np.sort(others @ w)
    cuts = np.quantile(sp, np.linspace(0.005, 0.5, 100))
    return w, cuts, 1 - np.searchsorted(sp, cuts) / len(sp)


def class_prior(above_u: np.ndarray, above_p: np.ndarray) -> float:
    """Share of positives: above any cut, the unlabelled hold at least that share times what the positives hold there, so
    the least ratio of the two is the estimate."""
    return float(np.clip(np.min(above_u / above_p), 0.05, 0.99))


def fit(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 1200, seed: int = 8) -> Model:
    return Model(_weights(p, u, prior, steps, 0.03, 1e-5, seed), prior)


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves HELD_OUT of FOLDS; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _matrix(rows: list) -> np.ndarray:
    out = np.zeros((len(rows), SIZE), np.float32)
    for k, r in enumerate(rows):
        out[k, r["at"]] = r["value"]
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from the rows of docs whose id is known and not held out: positives are those whose labels are all 1, and
    all of them, whatever their label, are the unlabelled text.

    The weights are fitted on `sample` texts of each kind at most, those of the least hash of id and text, repeated rows
    counting once: the driver gets no more than that, and the same in each run. The prior is estimated from counts over
    every unlabelled row. Labels that are null or disagree make no positive. Without positives nothing is learnt and all
    scores are 0.5; with fewer than FEWEST of either kind the prior is NO_PRIOR.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    fold = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), text.cast("binary").alias("_t"))
    ids = fold.select("_id", "_h").distinct()
    order = [F.xxhash64("_id", "_h"), "_id", "_h"]
    drawn = ids.orderBy(*order).limit(sample).withColumn("_u", F.lit(True))
    trusted = ids.join(known.where("_y = 1 AND _z = 1"), "_id").select("_id", "_h").orderBy(*order).limit(sample).withColumn("_u", F.lit(False))
    chosen = F.broadcast(drawn.unionByName(trusted).withColumnsRenamed({"_id": "_i", "_h": "_g"}))  # 2 * sample rows
    texts = fold.join(chosen, (fold["_id"] == chosen["_i"]) & (fold["_h"] == chosen["_g"])).groupBy("_id", "_h", "_u").agg(F.first("_t").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))], ["h", "u", "at", "value"])

    rows = sorted(texts.select("_h", "_u", "_t").mapInArrow(run, "h bigint, u boolean, at array<int>, value array<float>").collect(), key=lambda r: (r["h"], r["at"], r["value"]))
    p, u = _matrix([r for r in rows if not r["u"]]), _matrix([r for r in rows if r["u"]])
    if not len(p) or not len(u):
        return Model(np.zeros(SIZE), NO_PRIOR, False)
    if min(len(p), len(u)) < FEWEST:
        return fit(p, u, NO_PRIOR)
    # each text is counted by a classifier that was fitted on others: those whose hash has the other parity
    hp, hu = (np.array([r["h"] & 1 for r in rows if r["u"] == kind]) for kind in (False, True))
    if min((h == k).sum() for h in (hp, hu) for k in (0, 1)) < FEWEST // 4:
        return fit(p, u, NO_PRIOR)
    folds = [prior_cuts(p[hp != k], u[hu != k], p[hp == k]) for k in (0, 1)]
    against = [Model(w, 0.0) for w, _, _ in folds]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[list[float]] = [[], []]
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own[h & 1].append(against[h & 1].margin(t))
            above = sum(len(x) - np.searchsorted(np.sort(x), cuts) for x, (_, cuts, _) in zip(own, folds, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(above)), pa.int32()), pa.array([batch.num_rows, *above.tolist()], pa.int64())], ["cut", "n"])

    with_cut = fold.select("_h", "_t").mapInArrow(counts, "cut int, n bigint").groupBy("cut").agg(F.sum("n").alias("n")).collect()  # a row for each cut
    n = {r["cut"]: r["n"] for r in with_cut}
    above_p = sum(share * (hp == k).mean() for k, (_, _, share) in enumerate(folds))
    return fit(p, u, class_prior(np.array([n[k] for k in range(len(above_p))]) / n[-1], above_p))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1, higher for better texts) and predicted (1 from the threshold on).

    Each whole text is scored on its own, so repeated rows and ties get equal scores; null counts as empty. Columns named
    score or predicted are replaced. Empty tables stay empty.
    """
    own = [c for c in docs.columns if c not in ("score", "predicted")]

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(lambda t: model.score(t or b""))

    scored = docs.select(*own, score(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
