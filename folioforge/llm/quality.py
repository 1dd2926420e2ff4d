"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

Features are indicators of hashed n-grams, of one to three tokens, over each word's shape (case, length class, marks
around it, whether it repeats the word before) and of single marks with their neighbours.  Each indicator is scaled by its
log-count ratio between the classes; a linear hinge-loss model is fitted to the scaled indicators by dual coordinate descent
(Hsieh et al., 2008) and mixed with the plain ratios.  A logistic curve turns margins into scores.

Fitting uses at most ``labelled.FIT_ROWS`` labelled rows.  Each comes to the driver as a bitmap of fixed size.

Defined cases: null and empty texts get the model's bias alone; without labels of both classes every score is the share of
label 1 (0.5 without any); repeated rows get equal scores; an empty table gives an empty result; further columns are
ignored, labels too where they are not asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled

BUCKETS = 1 << 12
#: Shapes of words that a task remembers at most.
WORDS_KEPT = 400_000


class Features:
    """Indicators of a text: a boolean array of BUCKETS."""

    def __init__(self) -> None:
        self._known: dict[bytes, int] = {}

    def _shape(self, word: bytes) -> int:
        import xxhash

        text = word.decode("utf-8", "replace")
        core = text.strip("*#$%&|<>!?.,;:()[]{}'\"-_=+~/\\")
        marks = text.replace(core, " ", 1) if core else text[:3]
        case = "A" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "a" if core.isalpha() else "0" if core.isdigit() else "m" if core else "-"
        length = min(len(core) // 4, 5)
        return xxhash.xxh32_intdigest(f"{case}{length}{marks[:8]}".encode("utf-8", "replace"))

    def __call__(self, text: str | None) -> np.ndarray:
        out = np.zeros(BUCKETS, bool)
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if not words:
            return out
        known = self._known
        if len(known) > WORDS_KEPT:
            known.clear()
        shapes = []
        before = None
        for w in words:
            s = known.get(w)
            if s is None:
                s = known[w] = self._shape(w)
            shapes.append(s ^ 0x5BD1E995 if w == before else s)
            before = w
        x = np.array(shapes, np.uint64)
        with np.errstate(over="ignore"):
            grams = x
            for n in range(1, 4):
                h = grams * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
                h ^= h >> np.uint64(31)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                out[(h >> np.uint64(40)).astype(np.int64) % BUCKETS] = True
                if len(x) <= n:
                    break
                grams = h[:-1] + x[n:]
        return out


def log_count_ratio(x: np.ndarray, y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of each indicator's smoothed share in class 1 and in class 0."""
    one, zero = x[y == 1].sum(0) + smooth, x[y == 0].sum(0) + smooth
    return np.log((one / ((y == 1).sum() + 2 * smooth)) / (zero / ((y == 0).sum() + 2 * smooth)))


def dual_coordinate_descent(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of the linear hinge-loss model; y is +1 or -1, ``cost`` bounds each dual variable.

    Each step minimises the dual exactly in one variable and keeps the weights up to date.
    """
    rng = np.random.default_rng(seed)
    w, alpha, norm = np.zeros(x.shape[1]), np.zeros(len(x)), np.maximum((x * x).sum(1), 1e-12)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(x)):
            slope = y[i] * (x[i] @ w) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < 1e-4:
            break
    return w


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through margins, by Newton steps with a small ridge."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = logistic(x @ b)
        grad = x.T @ (p - y) + 1e-3 * b
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        b -= step
        if abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def fit(x: np.ndarray, y: np.ndarray, mixture: float = 0.25, c: float = 0.5) -> tuple[np.ndarray, float, float]:
    """(weights, slope, intercept): a text's score is logistic(slope * mean weight of its indicators + intercept)."""
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        return np.zeros(BUCKETS), 0.0, float(np.log(share / (1 - share)))

    def weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        r = log_count_ratio(x, y)
        scaled = x * r.astype(x.dtype)
        scaled /= np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-9)
        sign = np.where(y == 1, 1.0, -1.0)
        cost = np.where(y == 1, 0.5 * len(y) / (y == 1).sum(), 0.5 * len(y) / (y == 0).sum()) * c
        w = dual_coordinate_descent(scaled, sign, cost)
        return ((1 - mixture) * abs(w).mean() + mixture * w) * r

    def margins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (x @ w) / np.sqrt(np.maximum(x.sum(1), 1.0))

    # The curve is fitted to margins of texts that the weights have not seen.
    order = np.random.default_rng(3).permutation(len(y))
    out = np.zeros(len(y))
    for k in range(3):
        test = np.zeros(len(y), bool)
        test[order[k::3]] = True
        if len(set(y[~test].tolist())) < 2:
            test[:] = False
        w = weights(x[~test].astype(np.float32), y[~test])
        out[test] = margins(x[test], w)
    w = weights(x.astype(np.float32), y)
    return w, *fit_curve(out, y)


def model(docs: DataFrame, labels: DataFrame, label: str, train, rows: int = labelled.FIT_ROWS) -> tuple[np.ndarray, float, float]:
    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            bits = [np.packbits(features(t)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(bits, pa.binary())], ["y", "bits"])

    table = labelled.sample(docs, labels, label, train, rows).mapInArrow(bitmaps, "y int, bits binary").toArrow()
    y = np.array(table.column("y"), np.int64)
    bits = table.column("bits").to_pylist()
    order = sorted(range(len(y)), key=lambda i: (y[i], bits[i]))  # rows that are still level are equal: the order of arrival does not matter
    x = np.unpackbits(np.frombuffer(b"".join(bits[i] for i in order), np.uint8)).reshape(-1, BUCKETS).astype(bool)
    return fit(x, y[order])


def score(docs: DataFrame, fitted: tuple[np.ndarray, float, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score; a map over the scan."""
    weights, slope, intercept = fitted
    weights = weights.astype(np.float32)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                x = features(text)
                out.append(slope * weights[x].sum() / max(x.sum(), 1) ** 0.5 + intercept)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(logistic(np.array(out, np.float64)))], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


#: Production parameters: folds, the held-out fold, and the score from which a document is good.
FOLDS, HELD_OUT, GOOD = 4, 2, 0.7


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = labelled.FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = score(docs, model(docs, labels, label, labelled.fold("id", FOLDS) != HELD_OUT, rows))
    held = F.coalesce(labelled.fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = labelled.FIT_ROWS, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the classifier rejects; all columns, no shuffle."""
    weights, slope, intercept = model(docs, labels, label, labelled.fold("id", FOLDS) != HELD_OUT, rows)
    weights = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            keep = []
            for text in batch.column(text_col).to_pylist():
                x = features(text)
                keep.append(bool(logistic(slope * weights[x].sum() / max(x.sum(), 1) ** 0.5 + intercept) >= GOOD))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
