"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values.

* Token scores: log-odds of a word between toxic and other training texts (each text counts a
  word once). The Dirichlet prior of a word is the posterior of its stem (six letters), whose own
  prior is the posterior of a shorter stem (four letters); an unseen word has its stem's score.
* Segments: a drift is taken from every token, so that ordinary text scores below zero, and one
  linear scan finds all maximal scoring segments of the whole text.
* Calibration: the number of segments of score S or more that n ordinary tokens hold by
  chance is about K n exp(-lambda S), whose largest score follows an extreme-value law. K and
  lambda are fitted by maximum likelihood to the segments of clean labelled texts that took no part in the
  token counts. Segments with an expected number under ``SIGNIFICANT`` are toxic passages; their
  summed log evidence passes a logistic link fitted on the same texts.

Training takes at most ``TRAIN_ROWS`` labelled rows a class (a hash share of them if
there are more) and keeps at most ``FEATURES`` token scores: both bound what is broadcast.
Everything else covers every row and every word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.llm.common import fresh_names, pick, release, store

TRAIN_ROWS = 10_000
FEATURES = 65_536
#: Letters of the two stems, and the prior's weight at each level (short stem, stem, word).
STEMS = (4, 6)
PRIOR = (20.0, 10.0, 10.0)
#: Token scores up to LEANING count as zero; DRIFT is taken from every token.
LEANING = 1.6
DRIFT = 0.5
SIGNIFICANT = 0.05
#: Folds of the row's hash: 0 is held out, CALIBRATE calibrates, the others count.
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 4
EDGE = ".,;:!?\"'()[]{}<>«»“”¡¿*#$%&"
FOUND_TYPE = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
    ]
)
FOUND_ARROW = pa.struct([("n", pa.int64()), ("scores", pa.list_(pa.float64())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def fold(id_col: str | Column) -> Column:
    """crc32 of the id's text, modulo FOLDS; null for a null id."""
    return F.pmod(F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string").cast("binary")), F.lit(FOLDS))


def words_of(text: str | None) -> list[str]:
    return [w.strip(EDGE) for w in (text or "").lower().split()]


def _key(part: str, level: int) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(part.encode(), level)
    return h - (1 << 64) if h >> 63 else h


def keys_of(word: str) -> tuple[int, int, int]:
    return _key(word[: STEMS[0]], 0), _key(word[: STEMS[1]], 1), _key(word, 2)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        keys = [keys_of(w) for w in seen]
        out = {"k0": [k[0] for k in keys], "k1": [k[1] for k in keys], "k2": [k[2] for k in keys]}
        out |= {"toxic": [c[1] for c in seen.values()], "clean": [c[0] for c in seen.values()]}
        seen.clear()
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            for w in set(words_of(text.as_py())):
                if w:
                    seen.setdefault(w, [0, 0])[toxic] += 1
            if len(seen) > 100_000:
                yield flush()
    yield flush()


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) of a list, in linear time.

    Each kept segment remembers the last one before it whose running total starts lower,
    so a search skips what an earlier search has ruled out.
    """
    low_at: list[float] = []
    high_at: list[float] = []
    span: list[tuple[int, int]] = []
    lower: list[int] = []
    total = 0.0
    for i, s in enumerate(scores):
        low, total = total, total + s
        if s <= 0:
            continue
        start, j = i, len(span) - 1
        while True:
            while j >= 0 and low_at[j] >= low:
                j = lower[j]
            if j < 0 or high_at[j] >= total:
                break
            low, start, before = low_at[j], span[j][0], lower[j]
            del low_at[j:], high_at[j:], span[j:], lower[j:]
            j = before
        low_at.append(low)
        high_at.append(total)
        span.append((start, i + 1))
        lower.append(j)
    return [(h - l, a, b) for l, h, (a, b) in zip(low_at, high_at, span)]


@dataclass
class Weights:
    """Token scores by level; absent words have score zero."""

    short: dict[int, float]
    stem: dict[int, float]
    word: dict[int, float]

    def __post_init__(self) -> None:
        self.of = lru_cache(maxsize=1 << 15)(self._of)

    def _of(self, raw: str) -> float:
        word = raw.strip(EDGE)
        if not word:
            return 0.0
        a, b, c = keys_of(word)
        for level, key in ((self.word, c), (self.stem, b), (self.short, a)):
            if key in level:
                return level[key] if level[key] > LEANING else 0.0
        return 0.0

    def find(self, text: str | None) -> dict:
        """Maximal segments of a whole text; positions are words."""
        raw = (text or "").lower().split()
        x = np.fromiter(map(self.of, raw), float, len(raw)) - DRIFT
        up = np.flatnonzero(x > 0)
        if not len(up):
            return {"n": len(raw), "scores": [], "starts": [], "ends": []}
        # between two positive words lies one negative run: scan the runs only
        total = np.concatenate([[0.0], np.cumsum(x)])
        runs: list[float] = []
        for k, i in enumerate(up.tolist()):
            if k:
                runs.append(float(total[i] - total[up[k - 1] + 1]))
            runs.append(float(x[i]))
        found = segments(runs)
        return {
            "n": len(raw),
            "scores": [s for s, _, _ in found],
            "starts": [int(up[a // 2]) for _, a, _ in found],
            "ends": [int(up[(b - 1) // 2]) + 1 for _, _, b in found],
        }


@lru_cache(maxsize=2)
def _weights(packed: tuple) -> Weights:
    return Weights(*[dict(zip(np.frombuffer(k, np.int64).tolist(), np.frombuffer(v, np.float64).tolist())) for k, v in packed])


class Model:
    """Fitted scores and calibration; ``passages`` and ``score`` are columns over any texts."""

    def __init__(self, shared, rate: float, scale: float, intercept: float, slope: float):
        self.rate, self.scale, self.intercept, self.slope = rate, scale, intercept, slope
        self.passages = _finder(shared)

    def evidence(self, found: str) -> Column:
        return _evidence(found, self.rate, self.scale)

    def score(self, found: str) -> Column:
        x = F.log1p(self.evidence(found))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.intercept) + F.lit(self.slope) * x)))


def _finder(shared):
    @F.arrow_udf(FOUND_TYPE)
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _weights(shared.value)
        for part in texts:
            yield pa.array([model.find(t.as_py()) for t in part], FOUND_ARROW)
        del model
        _weights.cache_clear()  # the worker goes on to other stages
        release()

    return find


def _evidence(found: str, rate: float, scale: float) -> Column:
    """Summed -log of the expected chance count over the significant segments."""
    chance = lambda s: F.log(F.lit(scale)) + F.log(F.greatest(F.col(found)["n"], F.lit(1)).cast("double")) - F.lit(rate) * s
    return F.aggregate(
        F.col(found)["scores"],
        F.lit(0.0),
        lambda acc, s: acc + F.when(chance(s) < math.log(SIGNIFICANT), -chance(s)).otherwise(0.0),
    )


def training_rows(labels: DataFrame, per_class: int = TRAIN_ROWS) -> DataFrame:
    """(id, toxic) of at most about ``per_class`` labelled rows a class, outside the held-out fold.

    Rows with a null id or label take no part; an id labelled twice counts as toxic
    if either label says so. The share of a class above the bound is chosen by the id's hash.
    """
    known = labels.where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & (fold("id") != HELD_OUT))
    known = known.groupBy("id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    rows = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for kind, n in rows.items():
        share = F.when(F.col("toxic") == kind, F.lit(min(1.0, per_class / n))).otherwise(share)
    # half a per cent below the bound on average: the hash share varies by a few rows
    return known.where(F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1 << 30)) < share * (1 << 30))


def _log_odds(toxic: str, clean: str, prior: Column, weight: float, base: float) -> Column:
    expected = F.lit(1.0) / (F.lit(1.0) + F.exp(-(prior + F.lit(base))))
    return F.log((F.col(toxic) + weight * expected) / (F.col(clean) + weight * (F.lit(1.0) - expected))) - F.lit(base)


def token_scores(counts: DataFrame, toxic_docs: int, clean_docs: int, features: int = FEATURES) -> list[tuple[bytes, bytes]]:
    """Packed (keys, scores) of the short stems, stems and words that matter.

    A word or stem is kept if its score, or its parent's, leans to toxic; of more
    than ``features`` at a level the most frequent in toxic texts are kept.
    """
    base = math.log(max(toxic_docs, 1) / max(clean_docs, 1))
    word = counts.groupBy("k0", "k1", "k2").agg(F.sum("toxic").alias("t2"), F.sum("clean").alias("c2"))
    stem = word.groupBy("k0", "k1").agg(F.sum("t2").alias("t1"), F.sum("c2").alias("c1"))
    short = stem.groupBy("k0").agg(F.sum("t1").alias("t0"), F.sum("c1").alias("c0"))
    short = short.withColumn("s0", _log_odds("t0", "c0", F.lit(0.0), PRIOR[0], base))
    stem = stem.join(short.select("k0", "s0"), "k0").withColumn("s1", _log_odds("t1", "c1", F.col("s0"), PRIOR[1], base))
    word = word.join(stem.select("k0", "k1", "s0", "s1"), ["k0", "k1"]).withColumn("s2", _log_odds("t2", "c2", F.col("s1"), PRIOR[2], base))
    wanted = (
        short.where(F.col("s0") > LEANING).select("k0", "s0", "t0"),
        stem.where((F.col("s1") > LEANING) | (F.col("s0") > LEANING)).select("k1", "s1", "t1"),
        word.where((F.col("s2") > LEANING) | (F.col("s1") > LEANING) | (F.col("s0") > LEANING)).select("k2", "s2", "t2"),
    )
    packed = []
    for level in wanted:
        key, score, n = level.columns
        rows = level.groupBy(key).agg(F.max_by(score, n).alias(score), F.sum(n).alias(n)).orderBy(F.desc(n), key).limit(features).collect()
        packed.append((np.array([r[0] for r in rows], np.int64).tobytes(), np.array([r[1] for r in rows], np.float64).tobytes()))
    return packed


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Ridge logistic regression on one feature, by Newton steps."""
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        ridge = np.array([1e-3, 1e-2])
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag(ridge), design.T @ (p - y) + ridge * beta)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled rows of ``df`` outside the held-out fold.

    With no toxic or no clean training row every text scores 0. Null texts
    count as empty.
    """
    spark = df.sparkSession
    chosen = training_rows(pick(labels, id=id_col, toxic=label_col), per_class)
    # at most 2 * per_class short rows, by construction
    rows = pick(df, id=id_col, text=text_col).join(F.broadcast(chosen), "id")
    counted = rows.where(fold("id") != CALIBRATE)
    counts = store(
        counted.select("text", "toxic").mapInArrow(_count_words, "k0 long, k1 long, k2 long, toxic long, clean long")
        .groupBy("k0", "k1", "k2").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")),
        "words",
    )
    docs = {r["toxic"]: r["n"] for r in chosen.where(fold("id") != CALIBRATE).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not docs.get(1) or not docs.get(0):
        return Model(spark.sparkContext.broadcast(((b"", b""),) * 3), 1.0, 1.0, -math.inf, 0.0)
    shared = spark.sparkContext.broadcast(tuple(token_scores(counts, docs[1], docs[0])))
    found = store(rows.where(fold("id") == CALIBRATE).select("toxic", _finder(shared)("text").alias("found")), "calibrate")
    clean = found.where("toxic = 0").select("found.n", F.size("found.scores").alias("m"), F.aggregate("found.scores", F.lit(0.0), lambda a, x: a + x).alias("s"))
    n, m, s = (x or 0 for x in clean.agg(F.sum("n"), F.sum("m"), F.sum("s")).first())
    # maximum likelihood of an exponential tail; one more segment of score one keeps both finite
    rate, scale = (m + 1) / (s + 1.0), (m + 1) / (n + 1.0)
    sample = found.select(F.col("toxic").cast("double"), F.log1p(_evidence("found", rate, scale))).collect()
    if not sample:
        return Model(shared, rate, scale, -2.0, 2.0)
    y, x = np.array([r[0] for r in sample]), np.array([r[1] for r in sample])
    return Model(shared, rate, scale, *_logistic(x, y))


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, found) for every row; null and empty texts have no passage."""
    rows = pick(df, id=id_col, text=text_col).select("id", model.passages("text").alias("found"))
    return rows.select(
        "id",
        F.coalesce(fold("id") == HELD_OUT, F.lit(False)).alias("held_out"),
        model.score("found").alias("score"),
        (model.score("found") >= 0.5).cast("int").alias("predicted"),
        "found",
    )


def keep_clean(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows whose text the model doesn't call toxic, with their columns as they came."""
    (name,) = fresh_names(df, "toxic_found")
    return df.withColumn(name, model.passages(F.col(text_col))).where(model.score(name) < 0.5).drop(name)
