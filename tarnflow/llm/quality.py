"""Quality classifier: Bradley-Terry ranking learnt from preference pairs, thresholded by a quantile of the scores."""

from __future__ import annotations

import operator
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm.common import blank_to_empty, slices, table

#: Labelled rows that the model is fitted on at most; they are the first by a hash of the id.
MAX_TRAINING_ROWS = 20_000
PAIRS, EPOCHS, BATCH, RATE, DECAY, SEED = 200_000, 30, 2_000, 0.5, 1e-5, 17
CUT = 0.7

FEATURES = (
    "log_length", "words", "word_length", "upper", "digit", "symbol", "other_mark", "comma_stop", "wide", "space",
    "repeat", "top_word", "distinct", "symbol_words", "symbol_lines", "upper_lines", "repeat_lines", "small_starts", "worst_symbols", "worst_repeats", "line_length", "same_lines",
)

_CLASS = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~=+<>/\\{}[]_|", b"\"'():;-!?", b",.", bytes(range(128, 256)), b" \t\r\n"), 1):
    _CLASS[list(_chars)] = _k
_SYMBOLS = frozenset("#$%&*@^~=+<>/\\{}[]_|!?")


def features(text: str) -> list[float]:
    """Shares of kinds of characters, words and lines over the whole text; all zero for an empty one."""
    raw = text.encode("utf-8", "replace")
    if not raw.strip():
        return [0.0] * len(FEATURES)
    n = len(raw)
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256), minlength=8) / n
    words = text.split()
    m = len(words)
    counts = Counter(words)
    repeats = sum(map(operator.eq, words, words[1:])) / m
    odd = small = upper = bad_repeat = 0
    marked = worst_symbols = worst_repeats = 0.0
    lines = [x for x in text.split("\n") if x.strip()]
    for line in lines:
        own = line.split()
        with_symbol = sum(1 for w in own if w[-1] in _SYMBOLS or w[0] in _SYMBOLS) / len(own)
        again = sum(map(operator.eq, own, own[1:])) / len(own)
        marked += with_symbol * len(own)
        worst_symbols, worst_repeats = max(worst_symbols, with_symbol), max(worst_repeats, again)
        odd += with_symbol > 0.25
        bad_repeat += again > 0.25
        small += line[0].islower()
        upper += line.isupper()
    k = len(lines)
    share = lambda x: float(np.sqrt(x))
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(np.log(n / m)), *map(share, kinds[1:8]),
        share(repeats), share(counts.most_common(1)[0][1] / m), len(counts) / m**0.85, share(marked / m), share(odd / k), share(upper / k), share(bad_repeat / k),
        share(small / k), share(worst_symbols), share(worst_repeats), float(np.log1p(n / k)), share(1 - len(set(lines)) / k),
    ]


def _featurise(batches):
    for batch in slices(batches):
        rows = [features(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rest"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "rest", "features"])


def _featurise_rest(text: str):
    """The same where the text is among what goes along."""

    def run(batches):
        for batch in slices(batches):
            rows = [features(t or "") for t in pc.struct_field(batch.column("rest"), text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rest"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "rest", "features"])

    return run


def bradley_terry(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Weights w that make the sigmoid of w . (better - worse) likely over seeded pairs; zero if a class is missing."""
    better, worse = x[y == 1], x[y == 0]
    w = np.zeros(x.shape[1])
    if not len(better) or not len(worse):
        return w
    rng = np.random.default_rng(seed)
    gain = np.zeros_like(w)
    for _ in range(EPOCHS):
        a, b = rng.integers(len(better), size=PAIRS // EPOCHS), rng.integers(len(worse), size=PAIRS // EPOCHS)
        for i in range(0, len(a), BATCH):
            d = better[a[i : i + BATCH]] - worse[b[i : i + BATCH]]
            g = -(d / (1 + np.exp(np.clip(d @ w, -50, 50)))[:, None]).mean(axis=0) + DECAY * w
            gain += g * g
            w -= RATE * g / np.sqrt(gain + 1e-8)
    return w


def best_quantile(s: np.ndarray, y: np.ndarray) -> float:
    """The share of scores to reject at which accepting the rest agrees best with the labels.

    Classes weigh alike.  Of shares that agree alike the one at the widest gap between scores counts, so the cut keeps off both classes.
    """
    order = np.argsort(s, kind="stable")
    ys = y[order]
    bad, good = max(1, (y == 0).sum()), max(1, (y == 1).sum())
    right = np.concatenate([[0], np.cumsum(ys == 0)]) / bad + (good - np.concatenate([[0], np.cumsum(ys == 1)])) / good
    alike = np.flatnonzero(right >= right.max() - 1e-12)
    gaps = np.concatenate([[0.0], np.diff(s[order]), [0.0]])
    return float(alike[gaps[alike].argmax()]) / len(s)


def at_quantile(s: np.ndarray, quantile: float) -> float:
    """The score below which that share of the scores lies: halfway between its neighbours."""
    ordered = np.sort(s)
    k = round(quantile * len(s))
    edge = np.concatenate([[ordered[0] - 1], ordered, [ordered[-1] + 1]])
    return float((edge[k] + edge[k + 1]) / 2)


def pair_accuracy(s: np.ndarray, y: np.ndarray) -> float:
    """Share of all pairs of a better and a worse row that the scores order rightly, ties by half; nan without both kinds."""
    good, bad = np.sort(s[y == 1]), s[y == 0]
    below = np.searchsorted(good, bad, side="left") + np.searchsorted(good, bad, side="right")
    return float(1 - below.sum() / (2 * len(good) * len(bad))) if len(good) and len(bad) else float("nan")


class Model:
    """Scores between 0 and 1; CUT is the score at the chosen quantile of the training scores, or at ``cut`` if given."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        # Features that are constant keep weight 0.
        self.mean, spread = x.mean(axis=0), x.std(axis=0)
        self.scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0.0)
        self.w = bradley_terry(self.standard(x), y)
        s = self.raw(x)
        self.quantile = best_quantile(s, y) if self.w.any() else 0.0
        self.cut = at_quantile(s, self.quantile) if self.w.any() else 0.0
        self.unit = max(1e-9, float(np.median(np.abs(s - self.cut)))) if len(s) else 1.0

    def standard(self, x: np.ndarray) -> np.ndarray:
        """Outliers count by their logarithm."""
        return np.arcsinh((x - self.mean) * self.scale)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.w

    def raw_column(self, features: str = "features"):
        """The ranking score as a DataFrame expression over the features."""
        terms = [F.asinh((F.col(features)[i] - float(m)) * float(k)) * float(w) for i, (m, k, w) in enumerate(zip(self.mean, self.scale, self.w)) if w]
        return sum(terms, F.lit(0.0))

    def column(self, raw, cut: float | None = None):
        """The ranking score as a number between 0 and 1."""
        return 1 / (1 + F.exp(-(raw - (self.cut if cut is None else cut)) / self.unit * 2 - float(np.log(CUT / (1 - CUT)))))


def labelled(labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """One label an id: the larger where rows disagree."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max(label_col).alias("label"))


def training_texts(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``doc_id, label, text`` of at most ``most`` labelled ids, the first by a hash; of rows that share an id the shortest text.

    A threshold on the hash leaves about that many ids before they are sorted, so partitions don't each hand on as many.  Only ids are
    joined with the labels; the chosen ids, bounded by ``most``, are broadcast to find their texts.
    """
    ids = docs.select("doc_id").distinct().join(labelled(labels), "doc_id")
    n, order = ids.count(), F.xxhash64("doc_id")
    if n > most:
        ids = ids.where(order < F.lit(int(-(1 << 63) + (1 << 64) * min(1.0, (most + 4 * most**0.5 + 16) / n)) - 1))
    chosen = ids.orderBy(order, "doc_id").limit(most)
    shortest = F.min(F.struct(F.char_length("text"), F.col("text").alias("text")))
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(shortest.alias("s")).select("doc_id", "label", "s.text")


def fit(docs: DataFrame, labels: DataFrame, max_training_rows: int) -> Model:
    rows = training_texts(docs, labels, max_training_rows).select("doc_id", "text", F.struct("label").alias("rest"))
    # A bounded sample comes to the driver, 0.2 kB a row; sorted, so that the model doesn't depend on partitions.
    known = sorted((r["doc_id"], r["rest"]["label"], r["features"]) for r in _featured(rows).collect())
    x = np.array([f for _, _, f in known]).reshape(-1, len(FEATURES))
    return Model(x, np.array([y for _, y, _ in known])) if len(x) else Model(np.zeros((1, len(FEATURES))), np.zeros(1))


def _featured(rows: DataFrame) -> DataFrame:
    """``doc_id, rest, features`` of ``doc_id, text, rest``."""
    schema = T.StructType([rows.schema["doc_id"], rows.schema["rest"], T.StructField("features", T.ArrayType(T.DoubleType()))])
    return rows.select("doc_id", "text", "rest").mapInArrow(_featurise, schema)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_training_rows: int = MAX_TRAINING_ROWS, quantile: float | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted`` and the columns in ``carry``.

    Ids with crc32 mod 4 = 2 are held out.  Pairs of a better and a worse document, of at most ``max_training_rows`` other labelled ones (the bounded sample),
    teach the ranking; only the text is an input.  The cut is the quantile of the training scores that agrees best with their labels; with
    ``quantile``, a share of documents to reject, it is that quantile of all rows' scores.  Every whole text is read once to be scored, without a shuffle or
    a table in between, and ``carry`` goes along.

    Null and empty texts are scored as texts without words.  Null ids are never used for training and count as not held out.  Repeated rows
    get the same score.  Without labels of both kinds all scores are CUT.  An empty table gives no rows; other columns are ignored.
    """
    text = blank_to_empty(F.col(text_col)).alias("text")
    src = docs.select(F.col(id_col).alias("doc_id"), text, F.struct(F.lit(0).alias("_"), *(F.col(c) for c in carry)).alias("rest"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = fit(src.where(~held_out).select("doc_id", "text"), labels, max_training_rows)
    raw = model.raw_column()
    cut = None
    if quantile is not None:
        narrow = _featured(src.select("doc_id", "text", F.struct(F.lit(0).alias("_")).alias("rest")))
        cut = narrow.agg(F.percentile_approx(raw, quantile, 10_000)).first()[0]
    if text_col in carry:  # the text goes to Python and back once
        scored = src.select("doc_id", "rest").mapInArrow(_featurise_rest(text_col), T.StructType([src.schema["doc_id"], src.schema["rest"], T.StructField("features", T.ArrayType(T.DoubleType()))]))
    else:
        scored = _featured(src)
    scored = scored.select("doc_id", held_out.alias("held_out"), model.column(raw, cut).alias("score"), *(F.col(f"rest.`{c}`").alias(c) for c in carry))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op3_bradley_terry_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
