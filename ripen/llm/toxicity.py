"""Toxicity: a linear-chain conditional random field tags toxic words; documents are scored by its marginals.

Words are maximal runs of letters, lower-cased.  Features of a position are the word, its beginnings and its endings, of
the position itself and of both neighbours.  A chain has two tags and weights for features, transitions and the
start.

* Labels mark whole documents.  Word labels come from them: a feature is marking if it occurs so much more often
  in toxic documents than in others that, by its likelihood ratio, none of the features tried is expected to reach
  that by chance.  In toxic documents words with a marking feature are toxic, all other words are not.
* The field is fitted on a sample of labelled documents, at most about ``per_class`` of either label, drawn by hash;
  of near copies, told by the least hash of their word triples, one is used.  The whole likelihood is maximised by
  limited-memory quasi-Newton steps: a job per step adds up loss and gradient over the stored sample, so the result
  does not depend on how rows are dealt out.  Fixed memory of the driver: ``features`` weights by three places.
* Forward-backward marginals are exact over whole documents.  All chains of a slice are run as one: a first word forgets
  what stood before it.  Products of blocks of positions carry the messages across, so that a very long text takes
  no more steps than short ones.
* A document's score is a logistic function of its expected toxic words, its largest marginal and their share, fitted on
  the sample with weights that undo the sampling.  Offending runs of words are reported by code point offsets.

Null texts and texts without letters have no words; their score is that of no evidence.  Documents with a null id
are scored, not learnt from.  Repeated rows are scored each.  Of conflicting labels of an id the toxic one counts; null
labels are ignored.  Without labels of both kinds, the score is the smoothed share of toxic labels.  An empty
table has no rows.  Other columns, with any name, are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import prepare_session, store
from .recurring import runs
from .wordhash import ONE, OTHER, mixed

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6, 7, 8)
SUFFIXES = (3, 4, 5)
KINDS = 1 + len(PREFIXES) + len(SUFFIXES)
CHARS_AT_ONCE = 2_000_000
BLOCK = 96
#: Weights behind those of the features: bias, three transitions, start with the toxic tag.
REST = 5


@dataclass(frozen=True)
class Settings:
    per_class: int = 4_000
    features: int = 40_000
    #: Documents of the sample that a feature, and a marking one, occurs in at least.
    least_docs: int = 2
    least_marking: int = 3
    #: How many times more frequent a marking feature is in toxic documents.
    marking_ratio: float = 10.0
    ridge: float = 0.3
    steps: int = 40
    tolerance: float = 1e-5
    tagged: float = 0.5


@dataclass(frozen=True)
class Field:
    """``codes``: sorted feature codes; ``weights``: by place (own, before, after) and feature, then the REST."""

    codes: np.ndarray
    marking: np.ndarray
    weights: np.ndarray

    @property
    def by_place(self) -> np.ndarray:
        """Weights (3, features + 1); the last feature is none."""
        n = len(self.codes)
        return np.concatenate((self.weights[:3 * n].reshape(3, n), np.zeros((3, 1))), 1)


@dataclass(frozen=True)
class Model:
    field: Field | None
    #: Intercept and slopes of the document score.
    logistic: np.ndarray


# --- words and features -------------------------------------------------------------------------------------

def _codes(words: list[str]) -> np.ndarray:
    """Feature codes (words, KINDS) of distinct words; 0 where a word is too short for the feature."""
    lowered = [w.lower() for w in words]
    sizes = np.fromiter(map(len, lowered), np.int64, len(words))
    out = np.zeros((len(words), KINDS), np.uint64)
    out[:, 0] = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in lowered), np.uint64, len(words)) | np.uint64(1)
    at = 1
    for spans, parts, salt in ((PREFIXES, [w[:PREFIXES[-1]] for w in lowered], ONE),
                               (SUFFIXES, [w[:-SUFFIXES[-1] - 1:-1] for w in lowered], OTHER)):
        letters = np.array(parts, f"U{spans[-1]}").view(np.uint32).reshape(len(words), spans[-1])
        h = np.full(len(words), salt, np.uint64)
        for k in range(spans[-1]):
            h = mixed(h + letters[:, k].astype(np.uint64) + np.uint64(k))
            if k + 1 in spans:
                out[:, at] = np.where(sizes > k + 1, h | np.uint64(1), np.uint64(0))
                at += 1
    return out


def _slices(batch: pa.RecordBatch):
    """First row, texts, distinct words, place of every word among them, and words of each text."""
    texts = batch.column("text").to_pylist()
    first = 0
    while first < len(texts):
        lists, size, at = [], 0, first
        while at < len(texts) and size < CHARS_AT_ONCE:
            lists.append(WORD.findall(texts[at] or ""))
            size += len(texts[at] or "")
            at += 1
        words = list(chain.from_iterable(lists))
        place = {w: i for i, w in enumerate(dict.fromkeys(words))}
        yield (first, texts[first:at], list(place), np.fromiter(map(place.__getitem__, words), np.int32, len(words)),
               np.fromiter(map(len, lists), np.int64, len(lists)))
        first = at


def _indices(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of codes among the sorted ``known``; their number where unknown."""
    if not len(known):
        return np.zeros(codes.shape, np.int32)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[at] == codes, at, len(known)).astype(np.int32)


def _firsts(lengths: np.ndarray, n: int) -> np.ndarray:
    first = np.zeros(n, bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    return first


# --- the chain ----------------------------------------------------------------------------------------------

def emissions(scores: np.ndarray, place: np.ndarray, first: np.ndarray, bias: float) -> np.ndarray:
    """Score of the toxic tag at every position, from the scores (own, before, after) of distinct words."""
    e = scores[0][place] + bias
    inner = ~first[1:]
    e[1:] += np.where(inner, scores[1][place[:-1]], 0.0)
    e[:-1] += np.where(inner, scores[2][place[1:]], 0.0)
    return e


def forward_backward(e: np.ndarray, first: np.ndarray, rest: np.ndarray):
    """Marginals of the toxic tag, log-normaliser of all chains, expected transitions (2, 2).

    ``rest``: bias, transition weights clean-toxic, toxic-clean, toxic-toxic, start weight.  A ``first`` position
    starts a chain.
    """
    n = len(e)
    if not n:
        return e, 0.0, np.zeros((2, 2))
    n_blocks = -(-n // BLOCK)
    start, t01, t10, t11 = np.exp(np.clip(rest[[4, 1, 2, 3]], -50, 50))
    clean, toxic = np.exp(-np.maximum(e, 0)), np.exp(np.minimum(e, 0))
    m = np.zeros((4, n_blocks * BLOCK))
    m[0], m[3] = 1, 1  # behind the last word: nothing changes
    m[0, :n], m[1, :n] = clean, toxic * np.where(first, start, t01)
    m[2, :n], m[3, :n] = clean * np.where(first, 1, t10), toxic * np.where(first, start, t11)
    m00, m01, m10, m11 = np.ascontiguousarray(m.reshape(4, n_blocks, BLOCK).transpose(0, 2, 1))
    p00, p01, p10, p11 = m00[0], m01[0], m10[0], m11[0]
    for k in range(1, BLOCK):
        p00, p01, p10, p11 = (p00 * m00[k] + p01 * m10[k], p00 * m01[k] + p01 * m11[k],
                              p10 * m00[k] + p11 * m10[k], p10 * m01[k] + p11 * m11[k])
        scale = 1 / (p00 + p01 + p10 + p11)
        p00, p01, p10, p11 = p00 * scale, p01 * scale, p10 * scale, p11 * scale
    products = list(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist()))
    entering, a0, a1 = [], 0.5, 0.5
    for q00, q01, q10, q11 in products:
        entering.append((a0, a1))
        a0, a1 = a0 * q00 + a1 * q10, a0 * q01 + a1 * q11
        a0, a1 = a0 / (a0 + a1), a1 / (a0 + a1)
    leaving, b0, b1 = [], 0.5, 0.5
    for q00, q01, q10, q11 in reversed(products):
        leaving.append((b0, b1))
        b0, b1 = q00 * b0 + q01 * b1, q10 * b0 + q11 * b1
        b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
    alpha, norms, beta = np.empty((BLOCK, n_blocks)), np.empty((BLOCK, n_blocks)), np.empty((BLOCK, n_blocks))
    a0, a1 = np.array(entering).T
    for k in range(BLOCK):
        a0, a1 = a0 * m00[k] + a1 * m10[k], a0 * m01[k] + a1 * m11[k]
        norms[k] = a0 + a1
        a0, a1 = a0 / norms[k], a1 / norms[k]
        alpha[k] = a1
    b0, b1 = np.array(leaving[::-1]).T
    for k in range(BLOCK - 1, -1, -1):
        beta[k] = b1
        b0, b1 = m00[k] * b0 + m01[k] * b1, m10[k] * b0 + m11[k] * b1
        b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
    alpha, norms, beta = (x.T.reshape(-1)[:n] for x in (alpha, norms, beta))
    both = alpha * beta
    marginals = both / (both + (1 - alpha) * (1 - beta))
    # Pairs of neighbours within a chain.
    before, inner = alpha[:-1], ~first[1:]
    w = np.stack(((1 - before) * m[0, 1:n] * (1 - beta[1:]), (1 - before) * m[1, 1:n] * beta[1:],
                  before * m[2, 1:n] * (1 - beta[1:]), before * m[3, 1:n] * beta[1:]))[:, inner]
    pairs = (w / w.sum(0)).sum(1).reshape(2, 2)
    return marginals, float(np.log(norms).sum() + np.maximum(e, 0).sum()), pairs


def loss_and_gradient(weights: np.ndarray, index: np.ndarray, place: np.ndarray, lengths: np.ndarray, tags: np.ndarray):
    """Negative log-likelihood of the tags of a slice and its gradient; ``index``: features (words, KINDS)."""
    n = (len(weights) - REST) // 3
    by_place = np.concatenate((weights[:3 * n].reshape(3, n), np.zeros((3, 1))), 1)
    rest, first = weights[3 * n:], _firsts(lengths, len(place))
    e = emissions(by_place[:, index].sum(2), place, first, rest[0])
    p, log_z, pairs = forward_backward(e, first, rest)
    y = tags.astype(float)
    seen = np.zeros((2, 2))
    inner = ~first[1:]
    np.add.at(seen, (tags[:-1][inner].astype(int), tags[1:][inner].astype(int)), 1)
    score = y @ e + rest[1] * seen[0, 1] + rest[2] * seen[1, 0] + rest[3] * seen[1, 1] + rest[4] * y[first].sum()
    off = p - y
    by_word = np.stack((
        np.bincount(place, off, len(index)),
        np.bincount(place[:-1], np.where(inner, off[1:], 0), len(index)) if len(place) else np.zeros(len(index)),
        np.bincount(place[1:], np.where(inner, off[:-1], 0), len(index)) if len(place) else np.zeros(len(index))))
    grad = [np.bincount(index.ravel(), np.repeat(own, index.shape[1]), n + 1)[:n] for own in by_word]
    apart = pairs - seen
    grad.append(np.array([off.sum(), apart[0, 1], apart[1, 0], apart[1, 1], off[first].sum()]))
    return log_z - score, np.concatenate(grad)


# --- fitting ------------------------------------------------------------------------------------------------

def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings, id_col: str, text_col: str,
                    label_col: str) -> DataFrame | None:
    """``toxic, weight, id, text`` of the documents to learn from, or None without labels of both kinds."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("toxic")).where(
        "id IS NOT NULL AND toxic IS NOT NULL").where(learn).groupBy("id").agg((F.max("toxic") > 0).alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None, n
    share = {y: min(1.0, settings.per_class / c) for y, c in n.items()}
    drawn = (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)) < F.when(F.col("toxic"), share[True]).otherwise(share[False])
    few = known.where(drawn).withColumn("weight", F.when(F.col("toxic"), 1 / share[True]).otherwise(1 / share[False]))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Some per_class rows of either label are drawn, whatever the size of the tables: they may be broadcast.
    met = rows.join(F.broadcast(few), "id").select("toxic", "weight", "id", "text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for _, _, words, place, lengths in _slices(batch):
                h = np.fromiter((xxhash.xxh64_intdigest(w.lower().encode()) for w in words), np.uint64, len(words))[place]
                ends = np.cumsum(lengths)
                for end, n in zip(ends.tolist(), lengths.tolist()):
                    own = h[end - n:end]
                    own = mixed(mixed(own[:-2] + ONE) + own[1:-1] * OTHER + own[2:] * ONE) if n > 2 else own
                    least.append(int(own.min() >> np.uint64(1)) if n else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=[*batch.schema.names, "sketch"])

    told = met.mapInArrow(sketch, "toxic boolean, weight double, id long, text string, sketch long")
    return store(told.groupBy("sketch").agg(F.max(F.struct("toxic", "weight", "id", "text")).alias("x")).select("x.*")), n


def _document_codes(sample: DataFrame, known: np.ndarray | None) -> dict[int, int]:
    """Documents of ``sample`` by feature; only of the ``known`` codes, where given."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            for _, _, words, place, lengths in _slices(batch):
                codes, each = _codes(words), []
                for end, m in zip(np.cumsum(lengths).tolist(), lengths.tolist()):
                    own = np.unique(codes[place[end - m:end]])
                    each.append(own[own > 0])
                every = np.concatenate([found, *each])
                if known is not None:
                    every = every[_indices(every, known) < len(known)]
                # A code that was counted before stands once more among the new ones.
                order = np.argsort(every, kind="stable")
                add = np.concatenate((n, np.ones(len(every) - len(n), np.int64)))[order]
                starts, _ = runs(every[order])
                found, n = every[order][starts], np.add.reduceat(add, starts) if len(starts) else n
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["code", "n"])

    counted = sample.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return counted


def choose_features(sample: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of the features used, and which of them are marking."""
    def columns(counted):
        table = counted.toArrow()
        codes = table.column("code").to_numpy().view(np.uint64)
        order = np.argsort(codes)
        return codes[order], table.column("n").to_numpy()[order]

    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(True, 0), n.get(False, 0)
    codes, hits = columns(_document_codes(sample.where("toxic"), None).where(F.col("n") >= settings.least_docs))
    tried = max(len(codes), 1)
    seen, misses = columns(_document_codes(sample.where("NOT toxic"), codes))
    clean_hits = np.zeros(len(codes), np.int64)
    clean_hits[np.searchsorted(codes, seen)] = misses
    ratio = likelihood_ratio(hits, clean_hits, n_toxic, n_clean)
    rate, clean_rate = hits / max(n_toxic, 1), (clean_hits + 0.5) / (n_clean + 1)
    # Of so many null features, none is expected beyond this value of a chi-square variable.
    marking = ((hits >= settings.least_marking) & (rate >= settings.marking_ratio * clean_rate) & (ratio >= 2 * np.log(tried)))
    kept = np.sort(np.lexsort((codes, -ratio))[:settings.features])
    return codes[kept], marking[kept]


def likelihood_ratio(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Twice the log-likelihood ratio of two rates a / n_a and b / n_b against a common one."""
    def part(x, n):
        rate = np.clip(x / max(n, 1), 1e-300, 1)
        return x * np.log(rate) + (n - x) * np.log(np.clip(1 - rate, 1e-300, 1))

    rate = np.clip((a + b) / max(n_a + n_b, 1), 1e-300, 1)
    common = (a + b) * np.log(rate) + (n_a + n_b - a - b) * np.log(np.clip(1 - rate, 1e-300, 1))
    return 2 * (part(a, n_a) + part(b, n_b) - common)


ENCODED = "index binary, place binary, lengths binary, tags binary"


def encode_sample(sample: DataFrame, codes: np.ndarray, marking: np.ndarray) -> DataFrame:
    """Slices of the sample as arrays: features of distinct words, words in turn, lengths, tags."""
    marks = np.append(marking, False)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for first, texts, words, place, lengths in _slices(batch):
                index = _indices(_codes(words), codes)
                tags = marks[index].any(1)[place] & np.repeat(toxic[first:first + len(texts)], lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in (index, place, lengths, tags)],
                    names=[c.split()[0] for c in ENCODED.split(", ")])

    return store(sample.select("toxic", "text").mapInArrow(encode, ENCODED))


def _total(encoded: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad = 0.0, np.zeros(len(weights))
        for batch in batches:
            for row in batch.to_pylist():
                own, g = loss_and_gradient(
                    weights, np.frombuffer(row["index"], np.int32).reshape(-1, KINDS), np.frombuffer(row["place"], np.int32),
                    np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["tags"], bool))
                loss, grad = loss + own, grad + g
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([grad.tobytes()])], names=["loss", "grad"])

    told = encoded.mapInArrow(add, "loss double, grad binary").collect()
    return sum(r["loss"] for r in told), sum((np.frombuffer(r["grad"]) for r in told), np.zeros(len(weights)))


def minimise(total, x: np.ndarray, ridge: np.ndarray, steps: int, tolerance: float, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton minimum of ``total`` (value and gradient) plus half the weighted squares."""
    def value(x):
        f, g = total(x)
        return f + 0.5 * float(ridge @ (x * x)), g + ridge * x

    f, g = value(x)
    pairs, left = [], steps
    while left > 0:
        d, told = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            told.append(a)
            d -= a * y
        if pairs:
            s, y = pairs[-1]
            d *= (s @ y) / (y @ y)
        else:
            d /= max(np.abs(g).max(), 1e-12)
        for (s, y), a in zip(pairs, reversed(told)):
            d += (a - (y @ d) / (s @ y)) * s
        rate, slope = 1.0, -(g @ d)
        while True:
            left -= 1
            f_new, g_new = value(x - rate * d)
            if f_new <= f + 1e-4 * rate * slope or left <= 0:
                break
            rate /= 3
        if f_new > f:
            break
        s, y = -rate * d, g_new - g
        if s @ y > 1e-10:
            pairs = [*pairs, (s, y)][-memory:]
        done = f - f_new <= tolerance * max(abs(f), 1.0)
        x, f, g = x + s, f_new, g_new
        if done:
            break
    return x


def _evidence(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: log of one plus expected toxic words, largest marginal, expected toxic share in percent."""
    ends = np.cumsum(lengths)
    sums = np.concatenate(([0.0], np.cumsum(p)))
    expected = np.maximum(sums[ends] - sums[ends - lengths], 0)
    largest = np.zeros(len(lengths))
    some = lengths > 0
    if some.any():
        largest[some] = np.maximum.reduceat(p, (ends - lengths)[some])
    return np.stack((np.log1p(expected), largest, 100 * expected / (lengths + 1)), 1)


def _marginals(field: Field, words: list[str], place: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    rest = field.weights[-REST:]
    first = _firsts(lengths, len(place))
    scores = field.by_place[:, _indices(_codes(words), field.codes)].sum(2)
    return forward_backward(emissions(scores, place, first, rest[0]), first, rest)[0]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression with an intercept, by Newton steps."""
    x = np.concatenate((np.ones((len(x), 1)), x), 1)
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [ridge * weight.sum()] * (x.shape[1] - 1)) / 100
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (weight * (p - y)) + penalty @ w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings(), *, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic") -> Model:
    """The field and the document score; ``learn`` tells by ``id`` which labels may be used."""
    prepare_session(docs.sparkSession)
    sample, n = labelled_sample(docs, labels, learn, settings, id_col, text_col, label_col)
    known = {} if sample is None else {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(known) < 2:
        share = (n.get(True, 0) + 1) / (sum(n.values()) + 4)
        return Model(None, np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0]))
    codes, marking = choose_features(sample, settings)
    encoded = encode_sample(sample, codes, marking)
    size = 3 * len(codes) + REST
    ridge = np.full(size, settings.ridge)
    ridge[-REST] = 0.0
    weights = minimise(lambda w: _total(encoded, w), np.zeros(size), ridge, settings.steps, settings.tolerance)
    field = Field(codes, marking, weights)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_evidence(_marginals(field, words, place, lengths), lengths) for _, _, words, place, lengths in _slices(batch)]
            x = np.concatenate(found) if found else np.empty((0, 3))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("weight"), *map(pa.array, x.T)],
                                             names=["toxic", "weight", "a", "b", "c"])

    told = sample.select("toxic", "weight", "text").mapInArrow(
        evidence, "toxic boolean, weight double, a double, b double, c double").toPandas()
    return Model(field, fit_logistic(told[["a", "b", "c"]].to_numpy(), told.toxic.to_numpy(float), told.weight.to_numpy()))


# --- scoring ------------------------------------------------------------------------------------------------

def _spans(text: str, p: np.ndarray, tagged: float) -> list[dict]:
    """Runs of tagged words: code point offsets and the largest marginal."""
    out, open_ = [], False
    for m, own in zip(WORD.finditer(text), p.tolist()):
        if own < tagged:
            open_ = False
        elif open_:
            out[-1]["end"], out[-1]["p"] = m.end(), max(out[-1]["p"], own)
        else:
            out.append({"start": m.start(), "end": m.end(), "p": own})
            open_ = True
    return out


SCORED = "id long, n_words long, score double, spans array<struct<start:long,end:long,p:double>>"


def score(docs: DataFrame, model: Model, settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, score, spans`` of every row; ``spans`` has the offsets of toxic runs of words."""
    prepare_session(docs.sparkSession)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts, words, place, lengths in _slices(batch):
                p = np.zeros(len(place)) if model.field is None else _marginals(model.field, words, place, lengths)
                x = _evidence(p, lengths)
                ends = np.cumsum(lengths)
                spans = [_spans(t, p[e - n:e], settings.tagged) if own[1] >= settings.tagged else []
                         for t, n, e, own in zip(texts, lengths.tolist(), ends.tolist(), x)]
                value = 1 / (1 + np.exp(-np.clip(model.logistic[0] + x @ model.logistic[1:], -35, 35)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, len(texts)), pa.array(lengths), pa.array(value), pa.array(spans, spans_type)],
                    names=["id", "n_words", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scored, SCORED)
