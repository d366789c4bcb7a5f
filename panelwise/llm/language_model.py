"""Language-model scores: a causal self-attention model on subword ids, trained in numpy.

Counts. Every training text counts: its words (A-Z lowered, between ASCII white space) and one end. The words'
subword ids give the corpus frequency of every id of a public vocabulary.

Model. One attention layer with a learnt bias for each distance, a feed-forward layer and a direct weight for each pair
of neighbouring classes predict the next id's class from the ids before it; a frequent id is a class of its own, the others share classes of about equal
frequency, inside which the corpus frequencies decide. Ids that begin a word and others never share a class, so a word's
probability as subwords is that of its ids times that of another beginning (or the end) after them. A word's
probability is the mean of that and of its smoothed share of the corpus, weighted by ``UNIGRAM``. The share is that of the base score:
one place for every known word and one for "not known", so that over these events the probabilities add up
to at most one, and a word that the corpus lacks costs no more than the unknown one and the weight.

Training. The rounds make one pass over all training documents, each on its own share of them. Texts lie one after another
in windows without gaps or overlap, so that each id is a target once and no place is empty. A round trains a copy of the
model in every task and averages the copies, weighted by their tokens (local stochastic gradient descent).

Scoring. A text is cut into windows of ``WINDOW`` ids that overlap by ``WINDOW - STRIDE``; windows of many
texts form one batch of masked attention, and each id is scored once, in the first window that has
it, so all but a text's first window see at least the overlap as context.

Both scores need the count of every word. The most frequent words are broadcast (``TOP`` of them);
the others leave the text as (row, word hash, log-probabilities as subwords) and meet the counts in a join, which
mixes in their shares.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.llm.bpe import Merges, parse_ranks
from panelwise.llm.common import pick, store

FOLDS, HELD_OUT = 7, 2
TOP = 1 << 16
WIDTH, HIDDEN = 16, 32
WINDOW, STRIDE = 32, 24
OWN_CLASSES, SHARED_CLASSES = 95, 32
OWN_ROWS = 4096
#: Rounds of one pass over the training documents.
ROUNDS = 2
BATCH, RATE = 64, 0.01
#: Words that a training task has at least: a small table has fewer tasks, each with enough steps to learn.
LEAST_WORDS = 1 << 17
#: Weight of the corpus share; by a training fold left out of counts and fit, 0.4 to 0.6 are alike.
UNIGRAM = 0.5
#: Windows scored at a time; their logits should fit a core's cache (the scores are the same for any number).
SCORE_BATCH = 64
#: Characters of text that are scored at a time, and words remembered by a worker.
CHUNK, REMEMBERED = 1 << 21, 1 << 18
#: Words below this many bytes are merged in lockstep.
SHORT = 64
END = b""


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


def word_keys(words: Iterable[bytes]) -> list[int]:
    """The signed 64-bit hashes by which words are joined (XXH64, as Spark's xxhash64)."""
    from xxhash import xxh64_intdigest

    hashes = (xxh64_intdigest(word, 42) for word in words)
    return [h - (1 << 64) if h >> 63 else h for h in hashes]


# ---- corpus counts -------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.binary()), "n": pa.array(seen.values(), pa.int64())})
        seen.clear()
        return out

    for batch in batches:
        for text in batch.column("text"):
            seen.update(words_of(text.as_py()))
            seen[END] += 1
            if len(seen) > 300_000:
                yield flush()
    yield flush()


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over all texts; the end of a text is the empty word."""
    return rows.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Subwords:
    """Subword ids of words (each with the space before it), with a bounded memory."""

    def __init__(self, raw: bytes):
        self.merges = Merges(parse_ranks(raw))
        self.size = self.merges.size
        self.known: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word; very long ones go through the rank queue."""
        out: list[bytes] = [b""] * len(words)
        for merge, own in (
            (self.merges.lockstep, [k for k, w in enumerate(words) if len(w) < SHORT]),
            (self.merges.merge, [k for k, w in enumerate(words) if len(w) >= SHORT]),
        ):
            if own:
                ids, bounds = merge([b" " + words[k] for k in own])
                packed, ends = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
                for k, a, b in zip(own, ends[:-1], ends[1:]):
                    out[k] = packed[a:b]
        return out

    def encode_all(self, texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text, and the number of ids of each of its words."""
        used = set().union(*texts)
        if fresh := list(used.difference(self.known)):
            self.known.update(zip(fresh, self.learn(fresh)))
        packed = [list(map(self.known.__getitem__, t)) for t in texts]
        ids = [np.frombuffer(b"".join(p), "<u4").astype(np.int64) for p in packed]
        pieces = [np.fromiter(map(len, p), np.int64, len(p)) // 4 for p in packed]
        if len(self.known) > REMEMBERED:
            self.known = {w: self.known[w] for w in used} if len(used) < REMEMBERED else {}
        return ids, pieces


_SUBWORDS: dict[int, tuple[object, Subwords]] = {}


def _subwords(shared) -> Subwords:
    raw = shared.value
    if _SUBWORDS.get(0, (None,))[0] is not raw:
        _SUBWORDS[0] = (raw, Subwords(raw))
    return _SUBWORDS[0][1]


def _count_ids(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = _subwords(shared)
        total = np.zeros(subwords.size, np.int64)
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for lo in range(0, len(words), 100_000):
                packed = subwords.learn(words[lo : lo + 100_000])
                ids = np.frombuffer(b"".join(packed), "<u4")
                weight = np.repeat(n[lo : lo + 100_000], [len(p) // 4 for p in packed])
                total += np.bincount(ids, weight, subwords.size).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    return run


# ---- the model -----------------------------------------------------------------------------


@dataclass
class Shape:
    """How ids map to input rows and classes.

    ``inside`` is the log-probability of an id in its class; the classes from ``begins`` on begin a word.
    """

    row: np.ndarray
    cls: np.ndarray
    inside: np.ndarray
    bias: np.ndarray
    begins: int

    @property
    def rows(self) -> int:
        return int(self.row.max()) + 1


def shape_of(counts: np.ndarray, ends: int, begins: np.ndarray) -> Shape:
    """``counts`` of every id and whether it begins a word; the end is the id after the last one, and also begins a text."""
    n = np.append(counts, ends).astype(np.float64) + 1.0
    begins = np.append(begins, True)
    order = np.argsort(-n[:-1], kind="stable")
    group = np.empty(len(n), np.int64)
    own, rest = order[:OWN_CLASSES], order[OWN_CLASSES:]
    group[own] = np.arange(len(own))
    group[-1] = len(own)
    if len(rest):
        mass = np.cumsum(n[rest])
        group[rest] = len(own) + 1 + np.minimum((mass - n[rest]) / mass[-1] * SHARED_CLASSES, SHARED_CLASSES - 1).astype(np.int64)
    _, cls = np.unique(group + begins * (len(own) + 1 + SHARED_CLASSES), return_inverse=True)
    total = np.bincount(cls, n)
    row = np.empty(len(n), np.int64)
    row[order] = np.minimum(np.arange(len(order)), OWN_ROWS)
    rare = order[OWN_ROWS:]
    row[rare] = OWN_ROWS + cls[rare] - cls[rare].min(initial=len(total))
    row[-1] = row[:-1].max() + 1
    return Shape(row, cls, np.log(n / total[cls]), np.log(total / total.sum()), int(cls[begins].min()))


def blank(shape: Shape, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights before training: the classes' corpus frequencies and small random numbers."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    return {
        "embed": (rng.standard_normal((shape.rows, WIDTH)) * 0.3).astype(np.float32),
        "qkv": draw(WIDTH, 3 * WIDTH),
        "near": np.zeros(WINDOW, np.float32),
        "out": draw(WIDTH, WIDTH) * np.float32(0.5),
        "up": draw(WIDTH, HIDDEN),
        "up_b": np.zeros(HIDDEN, np.float32),
        "down": draw(HIDDEN, WIDTH) * np.float32(0.5),
        "head": draw(WIDTH, len(shape.bias)) * np.float32(0.1),
        "pair": np.zeros((len(shape.bias), len(shape.bias)), np.float32),
        "head_b": shape.bias.astype(np.float32),
    }


_GAP = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
_LATER = np.where(_GAP < 0, np.float32(-1e9), np.float32(0))


def _exp(a: np.ndarray) -> None:
    """exp in place, shifted only if it could overflow."""
    if a.max(initial=0) > 60:
        a -= a.max(axis=-1, keepdims=True)
    np.exp(a, out=a)


def _grouped(index: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that puts equal values (below ``limit``) together, the values found, and where each begins."""
    index = index.astype(np.uint16 if limit <= 1 << 16 else np.int64)  # 16 bits are sorted by radix
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
    return order, index[first], first


def _summed(index: np.ndarray, values: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Rows of ``values`` added up by ``index``."""
    out = np.zeros_like(like)
    order, found, first = _grouped(index, len(like))
    out[found] = np.add.reduceat(values[order], first, axis=0)
    return out


def _forward(w: dict[str, np.ndarray], rows: np.ndarray, last: np.ndarray, on: np.ndarray | None = None) -> tuple:
    """Class logits, and what the gradient needs.

    ``rows`` has the input rows (batch x window), ``last`` the input classes of the places
    asked for: all of them, or the flat places ``on``.
    """
    b, n = rows.shape
    x = np.take(w["embed"], rows, axis=0)
    qkv = x.reshape(-1, WIDTH) @ w["qkv"]
    qkv[:, :WIDTH] *= np.float32(WIDTH**-0.5)
    q, k, v = (qkv[:, i * WIDTH : (i + 1) * WIDTH].reshape(b, n, WIDTH) for i in range(3))
    a = q @ k.transpose(0, 2, 1)
    a += (w["near"][np.maximum(_GAP, 0)] + _LATER)[None, :n, :n]
    _exp(a)
    a /= a.sum(axis=2, keepdims=True)
    o = (a @ v).reshape(-1, WIDTH)
    h = x.reshape(-1, WIDTH) + o @ w["out"]
    h = h if on is None else h[on]
    u = np.maximum(h @ w["up"] + w["up_b"], 0)
    z = h + u @ w["down"]
    logits = z @ w["head"]
    logits += np.take(w["pair"] + w["head_b"], last, axis=0)
    return logits, (x, q, k, v, a, o, h, u, z)


def _log_probs(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each place's class; ``logits`` is overwritten."""
    _exp(logits)
    at = logits[np.arange(len(target)), target].astype(np.float64)
    return np.log(np.maximum(at, 1e-37)) - np.log(logits.sum(axis=1).astype(np.float64))


def _gradient(w: dict[str, np.ndarray], rows: np.ndarray, last: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    b, n = rows.shape
    order, found, first = _grouped(last, len(w["pair"]))
    p, (x, q, k, v, a, o, h, u, z) = _forward(w, rows, last[order], order)
    _exp(p)
    total = p @ np.ones(p.shape[1], p.dtype)
    p[np.arange(len(order)), target[order]] -= total
    # the places' weights are left to the factors of p, which is by far the largest array
    weight = (weight[order] / max(weight.sum(), 1.0) / total).astype(p.dtype)
    pair = np.zeros_like(w["pair"])
    for c, lo, hi in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        np.dot(weight[lo:hi], p[lo:hi], out=pair[c])
    g = {"head": (z * weight[:, None]).T @ p, "head_b": pair.sum(axis=0), "pair": pair}
    dz = p @ w["head"].T
    dz *= weight[:, None]
    g["down"] = u.T @ dz
    du = (dz @ w["down"].T) * (u > 0)
    g["up"], g["up_b"] = h.T @ du, du.sum(axis=0)
    dh = np.empty_like(dz)
    dh[order] = dz + du @ w["up"].T
    g["out"] = o.T @ dh
    do = (dh @ w["out"].T).reshape(b, n, WIDTH)
    dv = a.transpose(0, 2, 1) @ do
    da = do @ v.transpose(0, 2, 1)
    ds = a * (da - (da * a).sum(axis=2, keepdims=True))
    g["near"] = np.bincount(np.maximum(_GAP, 0).ravel(), ds.sum(axis=0).ravel(), WINDOW).astype(np.float32)
    dqkv = np.concatenate([(ds @ k).reshape(-1, WIDTH), (ds.transpose(0, 2, 1) @ q).reshape(-1, WIDTH), dv.reshape(-1, WIDTH)], 1)
    dqkv[:, :WIDTH] *= np.float32(WIDTH**-0.5)
    g["qkv"] = x.reshape(-1, WIDTH).T @ dqkv
    dx = dh + dqkv @ w["qkv"].T
    g["embed"] = _summed(rows.ravel(), dx, w["embed"])
    return g


def windows(sequences: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, scored, text) of the windows over all texts; each text ends, and begins, with ``end``."""
    lengths = np.array([len(s) + 1 for s in sequences], np.int64)
    flat = np.concatenate([np.append(s, end) for s in sequences])
    begins = np.cumsum(lengths) - lengths
    count = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(sequences)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    place = (nth * STRIDE)[:, None] + np.arange(WINDOW)[None, :]
    there = place < lengths[text][:, None]
    at = np.minimum(begins[text][:, None] + place, len(flat) - 1)
    target = np.where(there, flat[at], end)
    before = np.where(place == 0, end, flat[np.maximum(at - 1, 0)])
    fresh = there & ((nth == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - STRIDE)[None, :])
    return np.where(there | (place == 0), before, end), target, fresh, text


def packed(sequences: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, scored) of windows over all texts laid one after another, each with its ``end``."""
    flat = np.concatenate([np.append(s, end) for s in sequences])
    room = -len(flat) % WINDOW
    targets = np.append(flat, np.full(room, end)).reshape(-1, WINDOW)
    inputs = np.append(end, targets.ravel()[:-1]).reshape(-1, WINDOW)
    return inputs, targets, (np.arange(targets.size) < len(flat)).reshape(-1, WINDOW)


class Trainer:
    """Adam on batches of windows."""

    def __init__(self, shape: Shape, weights: dict[str, np.ndarray]):
        self.shape, self.step, self.tokens = shape, 0, 0
        self.flat = _pack(weights)  # all weights in one array; the named ones are views of it
        self.w = _views(self.flat, weights)
        self.m, self.v, self.d, self.room = (np.zeros_like(self.flat) for _ in range(4))
        self.g = _views(self.d, weights)

    def learn(self, sequences: list[np.ndarray]) -> None:
        inputs, targets, fresh = packed(sequences, len(self.shape.cls) - 1)
        order = np.random.default_rng(self.step).permutation(len(inputs))
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            g = _gradient(self.w, self.shape.row[inputs[own]], self.shape.cls[inputs[own]].ravel(), self.shape.cls[targets[own]].ravel(), fresh[own].ravel().astype(np.float32))
            self.step += 1
            self.tokens += int(fresh[own].sum())
            for name, d in g.items():
                self.g[name][...] = d
            self.adam(RATE * min(1.0, self.step / 20) / (1 + self.step / 400))

    def adam(self, rate: float) -> None:
        """One step against the gradient ``d``, without new arrays."""
        room, unbias = self.room, (1 - 0.98**self.step) ** 0.5
        np.subtract(self.d, self.m, out=room)
        room *= 0.1
        self.m += room
        np.multiply(self.d, self.d, out=room)
        room -= self.v
        room *= 0.02
        self.v += room
        np.sqrt(self.v, out=room)
        room += 1e-8 * unbias
        np.divide(self.m, room, out=room)
        room *= rate * unbias / (1 - 0.9**self.step)
        self.flat -= room


def word_logs(shape: Shape, w: dict[str, np.ndarray], sequences: list[np.ndarray], pieces: list[np.ndarray]) -> np.ndarray:
    """Log-probability as subwords of each word and the end of each text, one after another.

    ``pieces`` has the number of ids of each word of a text.
    """
    lengths = np.array([len(s) + 1 for s in sequences], np.int64)
    inputs, targets, fresh, text = windows(sequences, len(shape.cls) - 1)
    log_id, log_begin = np.zeros(lengths.sum()), np.zeros(lengths.sum() + 1)
    masses = np.ones((len(shape.bias), 2), np.float32)  # of all classes, and of those that begin a word
    masses[: shape.begins, 1] = 0
    done = 0  # fresh places come in the order of the texts
    for lo in range(0, len(inputs), SCORE_BATCH):
        part = slice(lo, lo + SCORE_BATCH)
        on = np.flatnonzero(fresh[part].ravel())
        logits, _ = _forward(w, shape.row[inputs[part]], shape.cls[inputs[part].ravel()[on]], on)
        t = targets[part].ravel()[on]
        _exp(logits)
        total, begin = (logits @ masses).T.astype(np.float64)
        at = logits[np.arange(len(on)), shape.cls[t]].astype(np.float64)
        log_id[done : done + len(on)] = np.log(np.maximum(at, 1e-37) / total) + shape.inside[t]
        log_begin[done : done + len(on)] = np.log(np.maximum(begin / total, 1e-30))
        done += len(on)
    ids = np.concatenate([np.append(p, 1) for p in pieces])
    first = np.cumsum(ids) - ids
    whole = np.add.reduceat(log_id, first) - log_begin[first]
    words = np.array([len(p) + 1 for p in pieces])
    after = np.append(log_begin[first[1:]], 0.0)
    after[np.cumsum(words) - 1] = 0.0  # nothing comes after the end
    return whole + after


def mixed(own: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Log-probability of words from that as subwords and their smoothed corpus shares."""
    return np.logaddexp(np.log(UNIGRAM * share), np.log(1 - UNIGRAM) + own)


def text_scores(shape: Shape, w: dict[str, np.ndarray], sequences: list[np.ndarray], pieces: list[np.ndarray], shares: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each text; ``shares`` has the smoothed corpus share of each word and of the end."""
    words = np.array([len(p) + 1 for p in pieces])
    logp = mixed(word_logs(shape, w, sequences, pieces), np.concatenate(shares))
    return np.add.reduceat(logp, np.cumsum(words) - words) / np.log(10)


# ---- training on the cluster ---------------------------------------------------------------


def _pack(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _views(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return _views(flat.astype(np.float32), like)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the batches with about CHUNK characters of text, and their words."""
    for batch in batches:
        texts = batch.column("text")
        lo, size, chunk = 0, 0, []
        for k in range(batch.num_rows):
            text = texts[k].as_py() or ""
            chunk.append(words_of(text))
            size += len(text)
            if size >= CHUNK:
                yield batch.slice(lo, k + 1 - lo), chunk
                lo, size, chunk = k + 1, 0, []
        if chunk:
            yield batch.slice(lo), chunk


def _train(subwords_of, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = _subwords(subwords_of)
        trainer = Trainer(*model.value)
        for _, chunk in _chunks(batches):
            trainer.learn(subwords.encode_all(chunk)[0])
        if trainer.tokens:
            flat = _pack(trainer.w).astype(np.float64) * trainer.tokens
            yield pa.RecordBatch.from_pydict({"at": np.arange(len(flat)), "value": flat, "tokens": np.full(len(flat), float(trainer.tokens))})

    return run


@dataclass
class Model:
    spark: SparkSession
    subwords: object
    fitted: object
    words: DataFrame
    tokens: int
    different: int
    #: Subword ids and ends that the network was trained on, over all rounds.
    trained: int


def fit(rows: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> Model:
    """Fit on all rows (id, text) outside the held-out fold, each in one round; a null id is never held out."""
    spark = rows.sparkSession
    with open(vocabulary, "rb") as f:
        subwords = spark.sparkContext.broadcast(f.read())
    train = rows.where(F.coalesce(fold("id") != HELD_OUT, F.lit(True)))
    words = store(word_counts(train), "words")
    state = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))).alias("ends")).first()
    ranks = parse_ranks(subwords.value)
    counts, begins = np.zeros(max(ranks.values()) + 1, np.int64), np.zeros(max(ranks.values()) + 1, bool)
    begins[[rank for token, rank in ranks.items() if token[:1] == b" "]] = True
    found = words.where(F.col("word") != F.lit(END)).mapInArrow(_count_ids(subwords), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    for r in found.collect():  # at most one row for each id of the vocabulary
        counts[r["id"]] = r["n"]
    shape = shape_of(counts, state["ends"] or 0, begins)
    weights = blank(shape)
    trained = 0
    for k in range(rounds):
        model = spark.sparkContext.broadcast((shape, weights))
        chosen = train.where(F.pmod(F.xxhash64("id", "text"), F.lit(rounds)) == k)
        tasks = max(1, (state["n"] or 0) // rounds // LEAST_WORDS)
        copies = chosen.select("text").coalesce(tasks).mapInArrow(_train(subwords, model), "at long, value double, tokens double")
        got = copies.groupBy("at").agg((F.sum("value") / F.sum("tokens")).alias("value"), F.sum("tokens").alias("tokens")).toPandas()
        if len(got):
            weights = _unpack(got.sort_values("at")["value"].to_numpy(), weights)
            trained += int(got["tokens"].iloc[0])
    return Model(spark, subwords, spark.sparkContext.broadcast((shape, weights)), words, state["n"] or 0, state["v"] or 0, trained)


def _score(subwords_of, fitted, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, (shape, w), (top, places) = _subwords(subwords_of), fitted.value, frequent.value
        for batch, chunk in _chunks(batches):
            flat = [x for words in chunk for x in (*words, END)]
            counts = np.fromiter(map(top.get, flat, repeat(0)), np.int64, len(flat))
            n_tokens = np.array([len(words) + 1 for words in chunk])
            first = np.cumsum(n_tokens) - n_tokens
            own = word_logs(shape, w, *subwords.encode_all(chunk))
            rare: list[dict[bytes, list[float]]] = [{} for _ in chunk]
            at = np.flatnonzero(counts == 0)
            text = np.searchsorted(first, at, "right") - 1
            for k, t, log in zip(at.tolist(), text.tolist(), own[at].tolist()):
                rare[t].setdefault(flat[k], []).append(log)
            out = {
                "n_tokens": n_tokens,
                "known": np.add.reduceat((counts > 0).astype(np.int64), first),
                "logs": np.add.reduceat(np.log10(counts + 1.0), first),
                "rare": [word_keys(r) for r in rare],
                "own": [list(r.values()) for r in rare],
                "score": np.add.reduceat(mixed(own, (counts + 1) / places), first) / np.log(10),
            }
            kinds = {"n_tokens": pa.int64(), "known": pa.int64(), "logs": pa.float64(), "rare": pa.list_(pa.int64()), "own": pa.list_(pa.list_(pa.float64())), "score": pa.float64()}
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(out[k], t) for k, t in kinds.items()]], ["id", *kinds])

    return run


def scored(rows: DataFrame, model: Model, top: int = TOP) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of (id, text)."""
    spark = model.spark
    frequent = {bytes(r["word"]): r["n"] for r in model.words.orderBy(F.desc("n"), "word").limit(top).collect()}
    places = model.tokens + model.different + 1.0
    run = _score(model.subwords, model.fitted, spark.sparkContext.broadcast((frequent, places)))
    schema = f"id {dict(rows.dtypes)['id']}, n_tokens long, known long, logs double, rare array<long>, own array<array<double>>, score double"
    # numbered after storing, so that every later read gives a row the same number
    first = store(rows.mapInArrow(run, schema), "scores").withColumn("row", F.monotonically_increasing_id())
    rare = first.select("row", F.explode(F.arrays_zip("rare", "own")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.own").alias("own"))
    counts = model.words.select(F.xxhash64("word").alias("key"), "n")
    share = F.lit(UNIGRAM / places)

    def gain(total: Column, own: Column) -> Column:
        """``total`` and what its count adds to a word that was scored as one not known."""
        model_part = F.exp(own) * (1 - UNIGRAM)
        return total + F.log(share * (F.col("n") + 1) + model_part) - F.log(share + model_part)

    more = rare.join(counts, "key").select("row", "n", F.size("own").alias("number"), F.aggregate("own", F.lit(0.0), gain).alias("gain"))
    more = more.groupBy("row").agg(F.sum(F.col("number") * F.log10(F.col("n") + 1.0)).alias("more_logs"), F.sum("number").alias("more_known"), F.sum("gain").alias("gain"))
    out = first.join(more, "row", "left")
    per_token = float(np.log10(places))
    return out.select(
        "id",
        F.coalesce(fold("id") == HELD_OUT, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("score") + F.coalesce("gain", F.lit(0.0)) / F.lit(float(np.log(10)))).alias("score"),
    )


def scores(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the training rows of ``df`` and score every row.

    A null or empty text is its end alone. Repeated rows count and are scored each; a null id is
    a training row. With no training row all counts are zero and the model is untrained. Columns other than
    the two named don't matter.
    """
    rows = pick(df, id=id_col, text=text_col)
    return scored(rows, fit(rows, vocabulary))
