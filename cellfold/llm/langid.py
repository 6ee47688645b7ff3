"""Language of a text by a convolutional network over its bytes, trained in numpy.

Filters of several widths run over windows of a fixed number of bytes, each filter's
strongest response in a window is kept, and a softmax over those gives the window's
languages.  A text is all of its windows: their probabilities, weighted by the bytes in
them, are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfold.llm.common import remainder, tidy, uniform, whole_texts

WINDOW = 256
WIDTHS = (2, 3, 4)
#: Bounds of the training sample: texts of one language, windows of one text.
TEXTS, WINDOWS = 600, 4
HELD_OUT_PARTS = 5


@dataclass
class Network:
    languages: list[str]
    bytes_: np.ndarray            # 256 x d
    filters: dict[int, np.ndarray]  # width -> width x d x f
    bias: dict[int, np.ndarray]
    out: np.ndarray               # (widths * f) x languages
    out_bias: np.ndarray

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Each filter as sums of table rows: one row per two bytes, then one per byte left over."""
        found = {}
        for width, kernel in self.filters.items():
            single = np.einsum("bd,odf->obf", self.bytes_, kernel).astype(np.float32)
            pairs = [(single[o][:, None] + single[o + 1][None, :]).reshape(65536, -1) for o in range(0, width - 1, 2)]
            found[width] = pairs + ([single[-1]] if width % 2 else [])
        return found


def windows_of(data: bytes) -> np.ndarray:
    """The whole text as windows, the last one filled up with zero bytes."""
    rows = -(-len(data) // WINDOW)
    padded = np.zeros(rows * WINDOW, np.uint8)
    padded[:len(data)] = np.frombuffer(data, np.uint8)
    return padded.reshape(rows, WINDOW)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(net: Network, tables: dict[int, list[np.ndarray]], windows: np.ndarray, batch: int = 256) -> np.ndarray:
    parts = []
    for k in range(0, len(windows), batch):
        part = windows[k:k + batch]
        two = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
        pooled = []
        for width, rows in tables.items():
            n = WINDOW - width + 1
            total = rows[0][two[:, :n]]
            for o, more in enumerate(rows[1:], 1):
                at = 2 * o
                total += more[two[:, at:at + n]] if len(more) == 65536 else more[part[:, at:at + n]]
            pooled.append(np.maximum(total.max(axis=1) + net.bias[width], 0))
        parts.append(softmax(np.concatenate(pooled, axis=1) @ net.out + net.out_bias))
    return np.concatenate(parts) if parts else np.zeros((0, len(net.languages)))


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], size: int = 8, filters: int = 12,
          rounds: int = 500, batch: int = 64, rate: float = 5e-3, seed: int = 7) -> Network:
    """Cross-entropy by Adam.  Same windows, same network."""
    rng = np.random.default_rng(seed)
    p = {"bytes": rng.normal(0, 0.3, (256, size)), "out": rng.normal(0, 0.1, (len(WIDTHS) * filters, len(languages))),
         "out_bias": np.zeros(len(languages))}
    for w in WIDTHS:
        p[f"k{w}"], p[f"b{w}"] = rng.normal(0, 0.3, (w, size, filters)), np.zeros(filters)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        pick = rng.integers(0, len(windows), batch)
        x, y = windows[pick], labels[pick]
        seen = p["bytes"][x]
        pooled, at = [], {}
        for w in WIDTHS:
            n = WINDOW - w + 1
            response = sum(seen[:, o:o + n] @ p[f"k{w}"][o] for o in range(w))
            at[w] = response.argmax(axis=1)
            pooled.append(response.max(axis=1) + p[f"b{w}"])
        z = np.concatenate(pooled, axis=1)
        hidden = np.maximum(z, 0)
        slope = softmax(hidden @ p["out"] + p["out_bias"])
        slope[np.arange(batch), y] -= 1
        slope /= batch
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["out_bias"] = hidden.T @ slope, slope.sum(axis=0)
        back = (slope @ p["out"].T) * (z > 0)
        for k, w in enumerate(WIDTHS):
            part = back[:, k * filters:(k + 1) * filters]
            g[f"b{w}"] = part.sum(axis=0)
            for o in range(w):
                byte = x[np.arange(batch)[:, None], at[w] + o]
                vector = p["bytes"][byte]
                g[f"k{w}"][o] = np.einsum("bfd,bf->df", vector, part)
                np.add.at(g["bytes"], byte, part[:, :, None] * p[f"k{w}"][o].T[None])
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
            p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    f32 = {k: v.astype(np.float32) for k, v in p.items()}
    return Network(languages, f32["bytes"], {w: f32[f"k{w}"] for w in WIDTHS}, {w: f32[f"b{w}"] for w in WIDTHS},
                   f32["out"], f32["out_bias"])


def learned_from() -> Column:
    return (remainder("doc_id", HELD_OUT_PARTS) != 0) & F.col("lang").isNotNull() & (F.length("text") > 0)


def fit(docs: DataFrame, texts: int = TEXTS, windows: int = WINDOWS) -> Network | None:
    """A network from the rows of ``docs`` (``doc_id, text, lang``) that are not held out.

    From each language about ``texts`` texts are drawn by a hash of their id, and from
    each of those ``windows`` windows at hashed places: what reaches the driver is bounded
    by the number of languages.  None if there is nothing to learn from.
    """
    known = docs.where(learned_from())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(1.0, texts / counts[lang]))])
    data = F.encode("text", "utf-8")
    start = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.lit(1), F.length(data) - WINDOW + 1)).cast("int") + 1
    sample = known.where(uniform("doc_id", F.lit("language sample")) < share[F.col("lang")]).limit(2 * texts * len(languages))
    rows = sample.select("doc_id", "lang", F.explode(F.array(*[F.substring(data, start(k), F.lit(WINDOW)) for k in range(windows)])).alias("w"))
    found = rows.toPandas().sort_values(["doc_id", "lang", "w"])  # any order of arrival, same training
    x = np.concatenate([windows_of(bytes(w)) for w in found["w"]])
    y = np.searchsorted(np.array(languages), found["lang"].to_numpy(str))
    # Each language is drawn as often, however rare it is.
    rng = np.random.default_rng(5)
    most = max(np.bincount(y))
    pick = np.concatenate([rng.permutation(np.resize(np.nonzero(y == k)[0], most)) for k in range(len(languages)) if (y == k).any()])
    return train(x[pick], y[pick], languages)


def has_letter(text: str) -> bool:
    return next(filter(str.isalpha, text), None) is not None


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with ``held_out, lang_pred, score``.

    ``lang_pred`` is `und` and the score 0 where the text is null or has no letter, or
    where no labelled row was there to learn from.  A null doc_id is not held out.
    """
    tables = net.tables() if net else None
    sent = docs.sparkSession.sparkContext.broadcast((net, tables))

    @F.pandas_udf("lang_pred string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net, tables = sent.value
        for texts in batches:
            named, scores = [], []
            for text in texts:
                if net is None or text is None or not has_letter(text):
                    named.append("und")
                    scores.append(0.0)
                    continue
                data = text.encode()
                each = probabilities(net, tables, windows_of(data))
                weight = np.full(len(each), WINDOW)
                weight[-1] = len(data) - WINDOW * (len(each) - 1)
                mean = np.average(each, axis=0, weights=weight)
                named.append(net.languages[int(mean.argmax())])
                scores.append(min(1.0, float(mean.max())))
            yield pd.DataFrame({"lang_pred": named, "score": scores})
        tidy()

    kept = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    # Said to be non-deterministic so that a filter on the result doesn't run it once more.
    found = whole_texts(docs).select(*kept, language.asNondeterministic()("text").alias("_found"))
    return found.select(
        *kept, F.coalesce(remainder("doc_id", HELD_OUT_PARTS) == 0, F.lit(False)).alias("held_out"),
        F.col("_found.lang_pred").alias("lang_pred"), F.col("_found.score").alias("score"))
