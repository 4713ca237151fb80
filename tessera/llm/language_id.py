"""Language ID: a byte convolutional network, trained in numpy, over batched fixed-length windows.

Bytes are embedded, filters of several widths slide over a window, each filter's largest response goes through a ReLU into a
softmax over the languages. A text is cut into windows of ``WINDOW`` bytes that cover all of it; the mean of the windows'
log probabilities, each weighted by its share of letters, decides, and its softmax value is the score.

The fit uses about ``PER_LANGUAGE`` texts of each language, those with the least hash of their id, and at most
``PER_TEXT`` windows, spread evenly, of each of these. The windows are cut where the texts are, one task fits the network, and only
that comes to the driver; prediction covers every byte of every text.

Results by case: null text, empty text and text without a letter get ``und`` with score 0; a text shorter than a window is
padded with zero bytes; very long texts are read whole; repeated rows get equal results; without any training row every text gets
``und``; only the named columns are read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.llm.hashing import utf8
from tessera.llm.toxicity import fold

WINDOW, DIM, WIDTHS, FILTERS = 128, 6, (2, 3, 4, 5), 10
PER_LANGUAGE, PER_TEXT = 600, 6
BLOCK, PARTS = 512, 120
#: Texts to fit are looked up by broadcasting their ids up to this many, by a shuffle beyond.
BROADCAST_IDS = 1_000_000
_LETTER = np.zeros(256, dtype=np.float32)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
UNKNOWN = "und"


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows that cover each row, and each window's row; rows without bytes have none."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    # the last window of a longer row is moved back to end with it
    start = offsets[owner] + np.minimum(nth * WINDOW, np.maximum(0, size[owner] - WINDOW))
    return start, owner


def cut(data: np.ndarray, start: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The windows' bytes; zero past a row's end."""
    at = start[:, None] + np.arange(WINDOW)[None, :]
    inside = at < ends[:, None]
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


class Network:
    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        wide, total = max(WIDTHS), FILTERS * len(WIDTHS)
        self.embedding = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.mask = np.zeros((wide * DIM, total), dtype=np.float32)
        for i, w in enumerate(WIDTHS):  # a narrower filter has zeros at its end
            self.mask[: w * DIM, i * FILTERS : (i + 1) * FILTERS] = 1
        self.filters = (rng.normal(0, 1, self.mask.shape) * self.mask / np.sqrt(self.mask.sum(0))).astype(np.float32)
        self.bias = np.zeros(total, dtype=np.float32)
        self.out = rng.normal(0, 0.1, (total, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), dtype=np.float32)

    def patches(self, batch: np.ndarray) -> np.ndarray:
        x = self.embedding[batch]
        b, t, wide = len(batch), WINDOW - max(WIDTHS) + 1, max(WIDTHS) * DIM
        s = x.strides
        return np.ascontiguousarray(as_strided(x, (b, t, wide), (s[0], s[1], s[2]))).reshape(b * t, wide)

    def responses(self, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.patches(batch)
        return p, (p @ self.filters).reshape(len(batch), -1, self.filters.shape[1])

    def log_probabilities(self, batch: np.ndarray) -> np.ndarray:
        _, r = self.responses(batch)
        z = np.maximum(r.max(1) + self.bias, 0) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.out, self.out_bias]

    def gradients(self, batch: np.ndarray, truth: np.ndarray) -> list[np.ndarray]:
        p, r = self.responses(batch)
        b, t, f = r.shape
        best = r.argmax(1)
        top = np.take_along_axis(r, best[:, None, :], 1)[:, 0, :] + self.bias
        hidden = np.maximum(top, 0)
        z = hidden @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(b), truth] -= 1
        z /= b
        d_top = (z @ self.out.T) * (top > 0)
        chosen = p[(np.arange(b)[:, None] * t + best).ravel()].reshape(b, f, -1)
        d_filters = np.einsum("bf,bfk->kf", d_top, chosen) * self.mask
        d_patch = d_top[:, :, None] * self.filters.T[None]
        at = best[:, :, None] + np.arange(max(WIDTHS))[None, None, :]
        which = batch[np.arange(b)[:, None, None], at].ravel()
        d_embedding = np.zeros_like(self.embedding)
        flat = d_patch.reshape(-1, DIM)
        for d in range(DIM):
            d_embedding[:, d] = np.bincount(which, weights=flat[:, d], minlength=256)
        return [d_embedding, d_filters, d_top.sum(0), hidden.T @ z, z.sum(0)]

    def predict(self, texts: pa.Array) -> tuple[list[str | None], np.ndarray]:
        """A language and score for each text; None without bytes."""
        data, offsets = utf8(texts)
        start, owner = windows(data, offsets)
        sums = np.zeros((len(texts), len(self.languages)))
        weight = np.zeros(len(texts))
        for i in range(0, len(start), BLOCK):
            own = owner[i : i + BLOCK]
            batch = cut(data, start[i : i + BLOCK], offsets[own + 1])
            share = _LETTER[batch].mean(1) + 1e-3
            logs = self.log_probabilities(batch) * share[:, None]
            np.add.at(sums, own, logs)
            np.add.at(weight, own, share)
        mean = sums / np.maximum(weight, 1e-9)[:, None]
        prob = np.exp(mean - mean.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        best = prob.argmax(1)
        named = [self.languages[b] if w > 0 else None for b, w in zip(best, weight)]
        return named, np.where(weight > 0, prob.max(1), 0.0)


def spread_windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """At most ``PER_TEXT`` windows of each text, and each window's text."""
    data, offsets = utf8(texts)
    start, owner = windows(data, offsets)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    taken = [np.unique(np.linspace(a, b - 1, min(PER_TEXT, b - a)).astype(int)) for a, b in zip(first[:-1], first[1:]) if b > a]
    taken = np.concatenate(taken) if taken else np.zeros(0, int)
    return cut(data, start[taken], offsets[owner[taken] + 1]), owner[taken]


def fit(batch: np.ndarray, langs: list[str], epochs: int = 8, size: int = 128, seed: int = 13) -> Network | None:
    """Fit on windows of known languages."""
    languages = sorted(set(langs))
    if not languages:
        return None
    net, rng = Network(languages), np.random.default_rng(seed)
    truth = np.searchsorted(np.array(languages, dtype=object), np.array(langs, dtype=object))
    keep = _LETTER[batch].mean(1) > 0.3
    batch, truth = (batch[keep], truth[keep]) if keep.any() else (batch, truth)
    state, t = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()], 0
    for epoch in range(epochs):
        order = rng.permutation(len(batch))
        rate = 0.01 * (0.5 ** (epoch / 3))
        for i in range(0, len(order), size):
            pick, t = order[i : i + size], t + 1
            for p, g, (m, v) in zip(net.parameters(), net.gradients(batch[pick], truth[pick]), state):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (1 - 0.99**t) ** 0.5 / (1 - 0.9**t)) * m / (np.sqrt(v) + 1e-8)
    return net


def _cut_windows(batches):
    for batch in batches:
        cuts, owner = spread_windows(batch.column(2))
        at, flat = np.arange(len(cuts) + 1, dtype=np.int32) * WINDOW, np.ascontiguousarray(cuts)
        bytes_ = pa.BinaryArray.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(at), pa.py_buffer(flat)])
        rows = pa.array(owner)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), bytes_], names=["doc_id", "lang", "window"])


def _fit_task(batches):
    rows = pd.concat([pd.DataFrame({"doc_id": [], "lang": [], "window": []}), *batches]).sort_values(["doc_id", "lang", "window"])
    batch = np.frombuffer(b"".join(rows["window"]), np.uint8).reshape(-1, WINDOW)
    yield pd.DataFrame({"network": [pickle.dumps(fit(batch, list(rows["lang"])))]})


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Network | None:
    """Fit on texts with a language outside fold 1 of 3, about ``per_language`` of each language."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = rows.select("doc_id", "lang").where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), 3) != 1))
    # a language's rows are ranked in parts, so no language is ordered in one task
    least = F.xxhash64("doc_id", "lang")
    ranked = known.withColumn(
        "nth", F.row_number().over(Window.partitionBy("lang", F.pmod(least, F.lit(PARTS))).orderBy(least, "doc_id"))
    )
    taken = staged(ranked.where(F.col("nth") <= -(-per_language // PARTS)).select("doc_id", "lang").distinct(), "language-taken")
    taken = F.broadcast(taken) if taken.count() <= BROADCAST_IDS else taken
    texts = rows.join(taken, ["doc_id", "lang"], "left_semi").where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    cuts = texts.mapInArrow(_cut_windows, "doc_id long, lang string, window binary")
    got = cuts.repartition(1).mapInPandas(_fit_task, "network binary").first()
    return None if got is None else pickle.loads(got[0])


def language(text: Column, net: Network | None) -> Column:
    """struct<lang, score> of each text."""
    if net is None:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    shared = [net]

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        named, score = shared[0].predict(texts)
        return pa.StructArray.from_arrays([pa.array(named, pa.string()), pa.array(score)], names=["lang", "score"])

    found = run(text)
    known = F.coalesce(text, F.lit("")).rlike(r"\p{L}")
    return F.struct(
        F.when(known, F.coalesce(found["lang"], F.lit(UNKNOWN))).otherwise(F.lit(UNKNOWN)).alias("lang"),
        F.when(known, found["score"]).otherwise(F.lit(0.0)).alias("score"),
    )
