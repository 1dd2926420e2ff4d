"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding undoes disguises: compatibility forms and accents are resolved, look-alike letters of other scripts become Latin,
and digits or signs between letters become the letters they imitate.  The automaton finds all terms and all exception
phrases at word bounds in one pass; a term inside an exception phrase does not count.  The sum of weights is set against
the text's length, and a logistic curve over both turns them into a score.

The lexicon is a fixed list, plus words and word stems that the labels show to be signs of toxicity; weights are log-odds in
the labelled sample.  A stem stands for all words that begin with it, and is learned only if several different words do, so that the
words of one much copied document do not become terms.  Stems are learned and matched in folded text like terms, by the same automaton, and
do not count inside exception phrases either.
Fitting uses at most ``labelled.FIT_ROWS`` labelled rows, from which only counts (at most MOST_TERMS of them each) and
three numbers a row come to the driver.

Defined cases: null and empty texts have no term and the least score; without labels the fixed weights and curve hold;
repeated rows get equal scores; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .scratch import written

#: Insults and slurs of common use, in folded form (English, German, French, Spanish).
TERMS = tuple(
    """
    arsehole asshole bastard bitch bullshit clown coward cretin crap degenerate dimwit disgusting dumbass filth filthy
    freak fuck fucker fucking garbage idiot idiotic imbecile jerk loser lowlife maggot moron moronic parasite pathetic
    pig prick retard rubbish scum scumbag shit shithead shitty slut stupid subhuman swine trash twat vermin weirdo
    whore worthless
    arschloch abschaum dummkopf drecksau idioten miststueck schwachkopf trottel vollidiot
    abruti connard connasse cretine debile imbeciles ordure salaud salope
    basura cabron estupido gilipollas imbecil pendejo
    """.split()
)
#: Harmless phrases that hold a term, in folded form.
EXCEPTIONS = (
    "circus clown", "class clown", "clown fish", "garbage collection", "garbage collector", "garbage disposal",
    "garbage truck", "guinea pig", "jerk chicken", "jerk seasoning", "pig farm", "pig iron", "rodeo clown", "rubbish bin",
    "sore loser rule", "trash bag", "trash bin", "trash can", "trash collection", "trash folder", "white trash bag",
)
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans({
    "\u0430": "a", "\u0432": "b", "\u0435": "e", "\u043a": "k", "\u043c": "m", "\u043d": "h", "\u043e": "o", "\u0440": "p",
    "\u0441": "c", "\u0442": "t", "\u0443": "y", "\u0445": "x", "\u0456": "i", "\u0458": "j", "\u0455": "s", "\u0501": "d",
    "\u051b": "q", "\u03b1": "a", "\u03b2": "b", "\u03b5": "e", "\u03b7": "n", "\u03b9": "i", "\u03ba": "k", "\u03bd": "v",
    "\u03bf": "o", "\u03c1": "p", "\u03c4": "t", "\u03c5": "u", "\u03c7": "x", "\u0131": "i", "\u0261": "g", "\u0251": "a",
})
#: Digits and signs, and the letters they imitate.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
_DISGUISED = re.compile(r"(?<![a-z0-9])[0134579@$](?=[a-z])|(?<=[a-z])[013457890@$!|]+(?=[a-z])|(?<=[a-z])[013457$]{1,2}(?![a-z0-9$#%&*])")
_MARKS = re.compile("[̀-ͯ]+")
_OTHER = re.compile("[^a-z]+")

#: Words from the labels that join the lexicon at most, and the share of toxic texts that must hold one.
MOST_TERMS, LEAST_SHARE = 200, 0.08
#: Lengths of stems, the share of toxic texts that must hold one, how much more often their words must begin with it than those
#: of clean texts, and in how many different words.
STEM_LENGTHS, STEM_SHARE, STEM_RATIO, STEM_WORDS = range(3, 9), 0.03, 6.0, 8
DEFAULT_WEIGHT = 2.0
#: Curve without labels: density of weight, log weight, intercept.
DEFAULT_CURVE = (1.5, 0.5, -3.0)


def fold(text: str | None) -> str:
    """Lower-case Latin letters and single spaces, a space at both ends."""
    if not text:
        return " "
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold().translate(HOMOGLYPHS)
    else:
        text = text.lower()
    if any(c in text for c in "01345789@$!|"):
        text = _DISGUISED.sub(lambda m: "".join(DIGITS[c] for c in m[0]), text)
    return f" {_OTHER.sub(' ', text).strip()} "


def stems(text: str | None) -> dict[str, set[str]]:
    """Proper beginnings of a text's words, with the different words; the fixed terms are left out."""
    out: dict[str, set[str]] = {}
    for w in set(fold(text).split()).difference(TERMS):
        for n in STEM_LENGTHS:
            if n < len(w):
                out.setdefault(w[:n], set()).add(w)
    return out


@dataclass(frozen=True)
class Lexicon:
    """Weights of terms and stems, exception phrases, and the curve."""

    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(TERMS, DEFAULT_WEIGHT))
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = DEFAULT_CURVE


class Matcher:
    """The automaton of a lexicon: exception phrases and terms between blanks, stems after one."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self._found = ahocorasick.Automaton()
        for stem, weight in lexicon.stems.items():
            self._found.add_word(f" {stem}", (len(stem) + 1, weight, "stem"))
        for term, weight in lexicon.weights.items():
            self._found.add_word(f" {term} ", (len(term) + 2, weight, "term"))
        for phrase in lexicon.exceptions:
            self._found.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, "exception"))
        self._some = len(self._found) > 0
        if self._some:
            self._found.make_automaton()

    def spans(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of what counts in the folded text; a word that is a term counts as no stem."""
        found: dict[str, list] = {"stem": [], "term": [], "exception": []}
        for end, (n, weight, kind) in self._found.iter(folded) if self._some else ():
            found[kind].append((end - n + 1, end + 1, weight))
        whole = {a for a, *_ in found["term"]}
        counted = found["term"] + [x for x in found["stem"] if x[0] not in whole]
        free = found["exception"]
        return [t for t in counted if not any(a <= t[0] and t[1] <= b for a, b, _ in free)] if free else counted

    def measure(self, text: str | None) -> tuple[float, int, int]:
        """Sum of weights, number of words, number of terms and stems."""
        folded = fold(text)
        found = [w for *_, w in self.spans(folded)]
        return float(sum(found)), max(folded.count(" ") - 1, 0), len(found)


def inputs(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Columns of the curve: weight per hundred words, damped; log of the weight; one."""
    weight, words = np.maximum(np.asarray(weight, float), 0.0), np.asarray(words, float)
    return np.stack([np.log1p(100.0 * weight / np.maximum(words, 20.0)), np.log1p(weight), np.ones_like(weight)], 1)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit_curve(weight: np.ndarray, words: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a ridge; a longer text never gains from a term's absence."""
    x = inputs(weight, words)
    b = np.zeros(3)
    for _ in range(100):
        p = logistic(x @ b)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (p - y) + 0.5 * b)
        b -= step
        if abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def learn(docs: DataFrame, labels: DataFrame, label: str, train, rows: int = labelled.FIT_ROWS) -> Lexicon:
    """The lexicon as the labelled sample has it."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ys = [], []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                own = {w for w in fold(text).split() if len(w) > 2}
                out += own
                ys += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(ys, pa.int32())], ["word", "y"])

    texts = written(labelled.sample(docs, labels, label, train, rows), "toxic-sample")  # read seven times, made once
    totals = texts.agg(F.count(F.when(F.col("y") == 1, 1)).alias("toxic"), F.count(F.when(F.col("y") == 0, 1)).alias("clean")).first()
    toxic, clean = totals.toxic, totals.clean
    if not toxic or not clean:
        return Lexicon()
    counts = texts.mapInArrow(words, "word string, y int").groupBy("word").agg(
        F.count(F.when(F.col("y") == 1, 1)).alias("a"), F.count(F.when(F.col("y") == 0, 1)).alias("b")
    )
    odds = lambda a, b: math.log(((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1)))
    least = max(5, LEAST_SHARE * toxic)
    strong = counts.where((F.col("a") >= least) & ((F.col("a") + 0.5) / (toxic + 1) >= 8 * (F.col("b") + 0.5) / (clean + 1)))
    mined = strong.orderBy(F.desc("a"), "word").limit(MOST_TERMS).collect()
    known = counts.where(F.col("word").isin(*TERMS)).limit(len(TERMS)).collect()
    weights = dict.fromkeys(TERMS, DEFAULT_WEIGHT)
    for r in [*known, *mined]:
        w = odds(r.a, r.b)
        # A listed term that the labels hardly speak about keeps part of its fixed weight.
        n = r.a + r.b
        weights[r.word] = round((n * w + 5 * weights.get(r.word, w)) / (n + 5), 4)
    weights = {t: w for t, w in weights.items() if w > 0.3}
    draft = Lexicon(weights, learn_stems(texts, toxic, clean))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(draft)
        for batch in batches:
            out = [matcher.measure(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array([w for w, _, _ in out], pa.float64()), pa.array([n for _, n, _ in out], pa.int64())], ["y", "w", "n"]
            )

    table = texts.mapInArrow(measured, "y int, w double, n long").toArrow()
    w, n, y = (np.array(table.column(c), float) for c in ("w", "n", "y"))
    order = np.lexsort([n, w, y])  # the fit does not depend on the order of arrival
    return Lexicon(weights, draft.stems, EXCEPTIONS, fit_curve(w[order], n[order], y[order]))


def learn_stems(texts: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Weights of the stems that set the toxic texts apart; of a stem and its extensions the most telling one.

    A stem tells by how often words begin with it, not by whether any does: common syllables begin words everywhere.
    """

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                own = {x: len(ws) for x, ws in stems(text).items()}
                columns = [pa.array(own, pa.string()), pa.array([y] * len(own), pa.int32()), pa.array(own.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["stem", "y", "n"])

    bad, good = F.col("y") == 1, F.col("y") == 0
    n_words = F.regexp_count("text", F.lit(r"\p{L}+"))
    totals = texts.agg(F.sum(F.when(bad, n_words)).alias("a"), F.sum(F.when(good, n_words)).alias("b")).first()
    in_toxic, in_clean = (totals.a or 0) + 1.0, (totals.b or 0) + 1.0
    counts = texts.mapInArrow(begun, "stem string, y int, n long").groupBy("stem").agg(
        F.count(F.when(bad, 1)).alias("texts"), F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).alias("b")
    )
    ratio = (F.col("a") + 0.5) / in_toxic * in_clean / (F.col("b") + 0.5)
    gain = F.col("a") * F.log(ratio) - F.col("a") * (1 - 1 / ratio)
    strong = counts.where((F.col("texts") >= max(5, STEM_SHARE * toxic)) & (ratio >= STEM_RATIO))
    found = {r.stem: r for r in strong.select("stem", F.log(ratio).alias("weight"), gain.alias("gain")).orderBy(F.desc("gain"), "stem").limit(5 * MOST_TERMS).collect()}
    if not found:
        return {}
    kept = frozenset(found)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list({(x, w) for text in batch.column("text").to_pylist() for x, ws in stems(text).items() if x in kept for w in ws})
            columns = list(zip(*pairs)) if pairs else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["stem", "word"])

    words = texts.where(bad).mapInArrow(whole, "stem string, word string").groupBy("stem").agg(F.count_distinct("word").alias("n"))
    various = {r.stem for r in words.where(F.col("n") >= STEM_WORDS).collect()}
    out: dict[str, float] = {}
    for x in sorted(various, key=lambda x: (-round(found[x].gain, 6), len(x), x)):
        if len(out) < MOST_TERMS and not any(x.startswith(k) or k.startswith(x) for k in out):
            out[x] = round(found[x].weight, 4)
    return out


#: Production parameters: folds and the held-out fold.
FOLDS, HELD_OUT = 5, 0


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, weight, n_terms; a map over the scan."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            found = [matcher.measure(t) for t in batch.column("text").to_pylist()]
            weight, words, terms = ([x[i] for x in found] for i in range(3))
            scores = logistic(inputs(np.array(weight), np.array(words)) @ np.array(lexicon.curve))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(scores, pa.float64()), pa.array(weight, pa.float64()), pa.array(terms, pa.int64())], ["doc_id", "score", "weight", "n_terms"]
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double, weight double, n_terms long"
    )


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = labelled.FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, weight, n_terms of every document."""
    out = score(docs, learn(docs, labels, label, labelled.fold("id", FOLDS) != HELD_OUT, rows))
    held = F.coalesce(labelled.fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "weight", "n_terms")
