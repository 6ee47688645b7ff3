"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all texts, toxic or not, is the
unlabelled side.  With the share p of toxic texts known, the risk of taking a text for
clean is estimated from the unlabelled texts less p times that of the positives; where
that estimate falls below zero the step goes the other way (Kiryo et al., 2017).

A text is what its words (runs of letters, lower-cased) begin with: whole words and their
first letters, each with how much of the text it makes up.  Spark counts which of those
are more frequent among positives; thousands of them are kept, scaled by their log-odds,
and classifiers over them are trained in numpy from different draws, their scores averaged.
The decay of the risk decides which count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cellfold.llm.common import remainder, uniform, whole_texts
from cellfold.runtime import written

HELD_OUT_PARTS, HELD_OUT = 4, 2
#: Bounds of the training sample: positive texts, unlabelled texts, beginnings looked at.
POSITIVES, UNLABELLED, WORDS = 4000, 8000, 8000
#: How far the rates of a beginning have to be apart, in standard errors, and positives it needs.
APART, LEAST = 1.0, 2
#: Log-odds count up to this many; a beginning of half as many is taken as it is.
MOST_ODDS = 4.0
#: Letters of a beginning.
LENGTHS = (4, 5, 6, 7)
THRESHOLD = 0.3

LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def beginnings(word: str) -> list[str]:
    """The word itself, closed by a space, and its first letters."""
    return [word + " ", *(word[:k] for k in LENGTHS if k < len(word))]


def values(words: list[str], at: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The places of the known beginnings of a text, and how much of it each makes up: 1 for
    4 in 100 words and more."""
    found: Counter = Counter()
    for word, n in Counter(words).items():
        for begin in beginnings(word):
            if begin in at:
                found[at[begin]] += n
    counts = np.fromiter(found.values(), float, len(found))
    return np.fromiter(found, np.int64, len(found)), np.minimum(1, 25 * counts / (len(words) + 25))


@dataclass
class Rows:
    """Texts over beginnings, entry by entry: which text, which beginning, how much."""

    text: np.ndarray
    place: np.ndarray
    value: np.ndarray
    texts: int

    @classmethod
    def of(cls, pairs: list[np.ndarray], scale: np.ndarray) -> Rows:
        """``pairs``: of each text its places, and behind them as many values."""
        sizes = [len(p) // 2 for p in pairs]
        place = np.concatenate([p[:n] for p, n in zip(pairs, sizes)]).astype(np.int64)
        value = np.concatenate([p[n:] for p, n in zip(pairs, sizes)])
        return cls(np.repeat(np.arange(len(pairs)), sizes), place, value * scale[place], len(pairs))

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.text, self.value * weights[self.place], self.texts) + bias

    def gradient(self, slopes: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.place, self.value * slopes[self.text], width)


@dataclass
class Classifiers:
    """Weights and bias of each classifier over one list of beginnings."""

    words: list[str]
    weights: np.ndarray  # words x classifiers
    bias: np.ndarray


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def nnpu_risk(p_scores: np.ndarray, u_scores: np.ndarray, prior: float, p_shares: np.ndarray | None = None,
              u_shares: np.ndarray | None = None) -> tuple[float, float]:
    """Risk on positives, and the corrected (perhaps negative) risk on negatives.  Every text
    counts the same, or by its share."""
    mean = lambda x, shares: np.average(x, weights=shares)
    return (prior * mean(softplus(-p_scores), p_shares),
            mean(softplus(u_scores), u_shares) - prior * mean(softplus(p_scores), p_shares))


def train(positive: Rows, unlabelled: Rows, width: int, prior: float, seed: int, rounds: int = 400,
          rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """One linear classifier by Adam over a bootstrap draw of both sides."""
    rng = np.random.default_rng(seed)
    drawn = lambda n: np.bincount(rng.integers(0, n, n), minlength=n) / n
    sp, su = drawn(positive.texts), drawn(unlabelled.texts)
    w, b = np.zeros(width), -1.0
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1):
        fp, fu = positive.scores(w, b), unlabelled.scores(w, b)
        _, negative = nnpu_risk(fp, fu, prior, sp, su)
        gp, gu = -prior * sigmoid(-fp) * sp, sigmoid(fu) * su
        if negative >= 0:
            gp = gp - prior * sigmoid(fp) * sp
        else:  # the corrected part alone, upwards
            gp, gu = prior * sigmoid(fp) * sp, -gu
        g = np.append(positive.gradient(gp, width) + unlabelled.gradient(gu, width) + decay * w, gp.sum() + gu.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def _sample_beginnings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [sorted({b for w in set(words_of(t)) for b in beginnings(w)}) for t in frame["text"]]
        yield pd.DataFrame({"doc_id": frame["doc_id"], "positive": frame["positive"], "words": found})


def learned() -> Column:
    return remainder("doc_id", HELD_OUT_PARTS) != HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
        count: int = 5, words: int = WORDS) -> Classifiers | None:
    """Classifiers from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``).

    Held-out rows teach nothing.  Samples are drawn by a hash of the id, about
    ``positives`` and ``unlabelled`` texts whatever the input's size.  The prior is the
    toxic share of the labels that may be learned from, taken to be that of all documents,
    which the unlabelled side is drawn from.  None where no confirmed toxic
    text is left to learn from.
    """
    usable = labels.where(learned()).where("toxic IS NOT NULL")
    known = usable.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if not known["toxic"]:
        return None
    prior = min(0.9, known["toxic"] / known["n"])
    chosen = usable.where("toxic = 1").where(uniform("doc_id", F.lit("toxic")) < positives / known["toxic"])
    chosen = chosen.select(F.col("doc_id").alias("_of")).distinct().limit(2 * positives)
    able = whole_texts(docs).where(learned()).select("doc_id", "text")
    total = able.count()
    marked = able.join(F.broadcast(chosen), able["doc_id"] == chosen["_of"], "left")  # at most 2 * positives ids
    drawn = uniform("doc_id", F.lit("unlabelled")) < unlabelled / max(total, 1)
    sample = marked.select("doc_id", "text", F.explode(F.array_compact(F.array(
        F.when(F.col("_of").isNotNull(), F.lit(True)), F.when(drawn, F.lit(False))))).alias("positive"))
    sample = written(sample, "toxicity")
    rows = written(sample.mapInPandas(_sample_beginnings, "doc_id long, positive boolean, words array<string>"), "beginnings")
    sizes = {r["positive"]: r["count"] for r in rows.groupBy("positive").count().collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return None
    rates = rows.select("positive", F.explode("words").alias("word")).groupBy("word").agg(
        F.count(F.when(F.col("positive"), 1)).alias("p"), F.count(F.when(~F.col("positive"), 1)).alias("u"))
    both = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 1)
    apart = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(both * (1 - F.least(both, F.lit(0.999))) * (1 / n_p + 1 / n_u))
    top = rates.where(F.col("p") >= LEAST).withColumn("apart", apart).where(F.col("apart") >= APART)
    odds = F.log((F.col("p") + 0.5) / (n_p + 1)) - F.log((F.col("u") + 0.5) / (n_u + 1))
    listed = {r["word"]: r["odds"] for r in top.withColumn("odds", odds).orderBy(F.desc("apart"), "word").limit(words).collect()}
    if not listed:
        return None
    names = sorted(listed)
    scale = np.clip([listed[w] for w in names], 0, MOST_ODDS) / (MOST_ODDS / 2)
    sent = {w: k for k, w in enumerate(names)}

    @F.pandas_udf(ArrayType(DoubleType()))
    def known(texts: pd.Series) -> pd.Series:
        """The places of what is there, and how much there is of each."""
        return texts.map(lambda text: np.concatenate(values(words_of(text), sent)))

    found = sample.select("doc_id", "positive", F.xxhash64("text").alias("h"), known("text").alias("x")).toPandas()
    found = found.sort_values(["doc_id", "positive", "h"])  # any order of arrival, same training
    mask = found["positive"].to_numpy(bool)
    sides = [Rows.of([np.asarray(x, float) for x in found["x"][chosen]], scale) for chosen in (mask, ~mask)]
    made = [train(*sides, len(names), prior, seed) for seed in range(count)]
    return Classifiers(names, np.stack([w * scale for w, _ in made], axis=1), np.array([b for _, b in made]))


def score(docs: DataFrame, model: Classifiers | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``held_out, score, predicted``; columns so called are replaced.

    Null and empty texts are scored as texts without words.  Without a model every score
    is 0.  A null doc_id is not held out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def toxic(texts: pd.Series) -> pd.Series:
        model = sent.value
        if model is None:
            return pd.Series(np.zeros(len(texts)))
        at = {w: k for k, w in enumerate(model.words)}
        found = []
        for text in texts:
            places, much = values(words_of(text), at)
            found.append(sigmoid(much @ model.weights[places] + model.bias).mean())
        return pd.Series(found, dtype=float)

    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    return whole_texts(docs).select(
        *kept, F.coalesce(remainder("doc_id", HELD_OUT_PARTS) == HELD_OUT, F.lit(False)).alias("held_out"),
        toxic("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
