"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the average of the embeddings of its character n-grams (with its boundaries) and of itself, all hashed into
``BUCKETS`` rows; a stretch of ``SPAN`` words is the average of its words and goes through a two-class softmax. A text
scores by its most toxic stretch, through a logistic curve fitted on the training texts, so a few words in a long text
count as they do in a short one. Labels belong to texts: after a first fit on all stretches, the stretches of toxic texts
that score highest are taken as the toxic ones, and the model is fitted again.

The fit uses at most ``SAMPLE`` labelled texts of each class, those with the least hash of their id; scoring covers every text.

Results by case: a null or empty text, or one without letters or digits, scores 0; very long texts are scored whole; repeated
rows score alike; without any label of one class every score is the share of toxic labels; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashing import mix, powers, steps, utf8

BUCKETS, DIM, SPAN, SAMPLE = 1 << 18, 8, 3, 2500
GRAMS = (3, 4, 5, 6)
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[65:91] = _WORD[128:] = True


class Words:
    """The words of some texts: ids into distinct words, whose subword buckets lie flat, and the texts' offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        base = offsets[0]
        part, offs = data[base : offsets[-1]], offsets - base
        n = len(part)
        inside = _WORD[part]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offs] = True
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:n]
        ends[:-1] &= ~inside[1:] | edge[1:n]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.texts = np.searchsorted(s, offs)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
        inverse = powers(pow(_BASE, -1, 1 << 64), n)
        h = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        self.hashes, first, self.ids = np.unique(h, return_index=True, return_inverse=True)
        s, e = s[first], e[first]
        size = e - s
        # each distinct word between boundary marks, one after the other
        room = size + 2
        at = np.concatenate([[0], np.cumsum(room)])
        marked = np.full(int(at[-1]), 60, dtype=np.uint8)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        marked[np.repeat(at[:-1] + 1, size) + inner] = part[np.repeat(s, size) + inner]
        marked[at[1:] - 1] = 62
        m = len(marked)
        sums = np.zeros(m + 1, dtype=np.uint64)
        np.cumsum((marked.astype(np.uint64) + np.uint64(1)) * powers(_BASE, m), out=sums[1:])
        inverse = powers(pow(_BASE, -1, 1 << 64), m)
        word = np.repeat(np.arange(len(s)), room)
        grams, owners = [mix(self.hashes) & np.uint64(BUCKETS - 1)], [np.arange(len(s))]
        for g in GRAMS:
            if m < g:
                continue
            begin = np.flatnonzero(word[: m - g + 1] == word[g - 1 :])
            code = mix((sums[begin + g] - sums[begin]) * inverse[begin] + np.uint64(g))
            grams.append(code & np.uint64(BUCKETS - 1))
            owners.append(word[begin])
        self.buckets, self.owner = np.concatenate(grams).astype(np.int64), np.concatenate(owners)
        self.weight = 1.0 / np.maximum(1, np.bincount(self.owner, minlength=len(s)))

    def scores(self, table: np.ndarray) -> np.ndarray:
        """Of each word occurrence: the average of its subwords' entries."""
        per = np.bincount(self.owner, weights=table[self.buckets], minlength=len(self.weight)) * self.weight
        return per[self.ids]


class Part:
    """A step of a corpus: its texts' words, the subword buckets of the words that are new in it, and its stretches."""

    def __init__(self, words: Words, first: int, numbers: np.ndarray, fresh: np.ndarray, known: int):
        keep = fresh[words.owner]
        self.ids = numbers[words.ids]
        self.buckets = words.buckets[keep].astype(np.int32)
        self.owner = numbers[words.owner[keep]] - np.int32(known)
        self.weight = words.weight[fresh]
        self.rows = slice(first, first + len(words.texts) - 1)
        # stretches every half span, whose average is over the words there are
        start, self.last = words.texts[:-1], words.texts[1:].astype(np.int32)
        starts = [np.arange(a, max(a + 1, b - SPAN + 1), SPAN // 2, dtype=np.int32) for a, b in zip(start, self.last) if b > a]
        held = np.flatnonzero(self.last > start).astype(np.int32)
        self.begin = np.concatenate([np.zeros(0, np.int32), *starts])
        self.text = np.repeat(held, [len(x) for x in starts])

    def ends(self, pick: np.ndarray | slice) -> np.ndarray:
        return np.minimum(self.begin[pick] + SPAN, self.last[self.text[pick]])


class Corpus:
    """Many texts, held in parts: what is made on the way is of a part's size, or of that of the distinct words.

    Words are numbered as they first occur, so a word's subwords lie in one part. Sums run on from part to part in the order they
    would have at once, so parts change results by rounding only.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.parts: list[Part] = []
        seen, numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        for a, b in steps(offsets):
            if offsets[b] == offsets[a]:
                continue
            words = Words(data, offsets[a : b + 1])
            at = np.searchsorted(seen, words.hashes)
            fresh = np.ones(len(at), dtype=bool)
            inside = at < len(seen)
            fresh[inside] = seen[at[inside]] != words.hashes[inside]
            own = np.empty(len(at), np.int32)
            own[~fresh] = numbers[at[~fresh]]
            own[fresh] = np.arange(len(seen), len(seen) + int(fresh.sum()), dtype=np.int32)
            self.parts.append(Part(words, a, own, fresh, len(seen)))
            seen, numbers = np.insert(seen, at[fresh], words.hashes[fresh]), np.insert(numbers, at[fresh], own[fresh])
        self.n_words = len(seen)

    def forward(self, table: np.ndarray, picks: list):
        """Of each part: the averages of its picked stretches."""
        per, at = np.empty(self.n_words), 0
        for p in self.parts:
            n = len(p.weight)
            per[at : at + n] = np.bincount(p.owner, weights=table[p.buckets], minlength=n) * p.weight
            at += n
        carry = 0.0
        for p, pick in zip(self.parts, picks):
            sums = np.cumsum(np.concatenate([[carry], per[p.ids]]))
            carry = sums[-1]
            yield (sums[p.ends(pick)] - sums[p.begin[pick]]) / SPAN

    def back(self, gradients: list[np.ndarray], picks: list) -> np.ndarray:
        """Gradient of the stretches' logits summed into the buckets."""
        per, carry, open_end = np.zeros(self.n_words), 0.0, 0.0
        for p, pick, g in zip(self.parts, picks, gradients):
            step = np.zeros(len(p.ids) + 1)
            step[0] = open_end
            np.add.at(step, p.begin[pick], g / SPAN)
            np.add.at(step, p.ends(pick), -g / SPAN)
            open_end = step[-1]
            sums = np.cumsum(np.concatenate([[carry], step[:-1]]))
            carry = sums[-1]
            np.add.at(per, p.ids, sums[1:])
        out, at = np.zeros(BUCKETS), 0
        for p in self.parts:
            n = len(p.weight)
            np.add.at(out, p.buckets, (per[at : at + n] * p.weight)[p.owner])
            at += n
        return out


def stretches(values: np.ndarray, texts: np.ndarray, span: int | None = None) -> list[np.ndarray]:
    """Of each text: the average of each run of ``span`` words (of all its words, if fewer)."""
    span = span or SPAN
    sums = np.concatenate([[0.0], np.cumsum(values)])
    out = []
    for a, b in zip(texts[:-1], texts[1:]):
        if b - a > span:
            out.append((sums[a + span : b + 1] - sums[a : b - span + 1]) / span)
        else:
            out.append(np.full(1, (sums[b] - sums[a]) / span) if b > a else np.zeros(0))
    return out


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null(""))


class Model:
    """table: for each bucket, its embedding times the difference of the softmax's two weight rows."""

    def __init__(self, table: np.ndarray, slope: float, shift: float, constant: float | None = None):
        self.table, self.slope, self.shift, self.constant = table.astype(np.float32), slope, shift, constant

    def peaks(self, texts: pa.Array) -> np.ndarray:
        """The highest stretch of each text; minus infinity without words."""
        data, offsets = utf8(_lower(texts))
        out = np.full(len(texts), -np.inf)
        for first, last in steps(offsets):
            if offsets[last] == offsets[first]:
                continue
            words = Words(data, offsets[first : last + 1])
            for i, runs in enumerate(stretches(words.scores(self.table), words.texts)):
                if len(runs):
                    out[first + i] = runs.max()
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        peak = self.peaks(texts)
        if self.constant is not None:
            return np.where(np.isfinite(peak), self.constant, 0.0)
        z = np.clip(self.slope * np.where(np.isfinite(peak), peak, 0.0) + self.shift, -40, 40)
        return np.where(np.isfinite(peak), 1 / (1 + np.exp(-z)), 0.0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[str] | pa.Array, labels: list[int], rounds: int = 3, steps_each: int = 25, seed: int = 7) -> Model:
    y = np.asarray(labels, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(BUCKETS), 0.0, 0.0, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.large_string())
    corpus = Corpus(*utf8(_lower(texts)))
    parts = corpus.parts
    if not any(len(p.begin) for p in parts):
        return Model(np.zeros(BUCKETS), 0.0, 0.0, float(y.mean()))

    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    top = rng.normal(0, 0.5, DIM).astype(np.float32)
    bias, everything = 0.0, [slice(None)] * len(parts)
    moments = [np.zeros_like(emb), np.zeros(BUCKETS, np.float32), np.zeros_like(top), np.zeros_like(top), 0.0, 0.0]
    t = 0
    picks = everything
    for r in range(rounds):
        if r:
            picks = []
            for p, z in zip(parts, corpus.forward(emb @ top, everything)):
                best = np.full(len(p.last), -np.inf)
                np.maximum.at(best, p.text, z)
                truth, high = y[p.rows][p.text], z >= best[p.text] - 1e-9
                # of toxic texts the stretches near their best, of the others the highest and a random share
                hard = (truth == 0) & (high | (rng.random(len(z)) < 0.15))
                picks.append(np.flatnonzero(((truth == 1) & high) | hard).astype(np.int32))
        positives = [y[p.rows][p.text[pick]] == 1 for p, pick in zip(parts, picks)]
        n_positive, n_picked = sum(int(x.sum()) for x in positives), sum(map(len, positives))
        weights = 0.5 / max(1, n_picked - n_positive), 0.5 / max(1, n_positive)
        bounds = np.cumsum([len(x) for x in positives])[:-1]
        held = np.empty(n_picked)
        gradients = np.split(held, bounds)
        for _ in range(steps_each):
            t += 1
            for g, positive, z in zip(gradients, positives, corpus.forward(emb @ top, picks)):
                g[:] = np.where(positive, weights[1], weights[0]) * (_sigmoid(z + bias) - positive)
            per_bucket = corpus.back(gradients, picks).astype(np.float32)
            d_emb, d_top, d_bias = per_bucket[:, None] * top[None, :], emb.T @ per_bucket, float(held.sum())
            scale = (1 - 0.99**t) ** 0.5 / (1 - 0.9**t)
            moments[0] = 0.9 * moments[0] + 0.1 * d_emb
            moments[1] = 0.99 * moments[1] + 0.01 * (per_bucket**2) * float(top @ top) / DIM
            emb -= 0.1 * scale * moments[0] / (np.sqrt(moments[1])[:, None] + 1e-7)
            moments[2] = 0.9 * moments[2] + 0.1 * d_top
            moments[3] = 0.99 * moments[3] + 0.01 * d_top**2
            top -= 0.05 * scale * moments[2] / (np.sqrt(moments[3]) + 1e-7)
            moments[4] = 0.9 * moments[4] + 0.1 * d_bias
            moments[5] = 0.99 * moments[5] + 0.01 * d_bias**2
            bias -= 0.05 * scale * moments[4] / (moments[5] ** 0.5 + 1e-7)
            emb *= 0.998
    model = Model(emb @ top, 1.0, 0.0)
    peaks = model.peaks(texts)
    ok = np.isfinite(peaks)
    model.slope, model.shift = _logistic(peaks[ok], y[ok])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by damped Newton steps on scaled values."""
    centre, width = x.mean(), x.std() + 1e-9
    u = np.stack([(x - centre) / width, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = _sigmoid(u @ w)
        h = (u * (p * (1 - p))[:, None]).T @ u / len(y) + 1e-3 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, u.T @ (p - y) / len(y) + 1e-4 * w), -1, 1)
    return float(w[0] / width), float(w[1] - w[0] * centre / width)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled texts outside fold 0 of 5, at most ``sample`` of each class."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), 5) != 0))
    taken = None
    for value in (0, 1):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        taken = part if taken is None else taken.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = texts.join(F.broadcast(taken), "doc_id").select("doc_id", "text", "toxic").repartition(1)
    # the sample is bounded, so one task fits the model; only the model comes to the driver
    got = rows.mapInArrow(_fit_task, "model binary, slope double, shift double, constant double").first()
    if got is None:  # no row, no task
        return fit([], [])
    return Model(np.frombuffer(got[0], np.float32), got[1], got[2], got[3])


def _fit_task(batches):
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string()), ("toxic", pa.int32())])
    held = pa.Table.from_batches([b.cast(kinds) for b in batches if b.num_rows], kinds)
    held = held.take(pc.sort_indices(held, [("doc_id", "ascending"), ("text", "ascending"), ("toxic", "ascending")], null_placement="at_start"))
    texts, labels = held["text"].combine_chunks(), held["toxic"].to_pylist()
    del held
    m = fit(texts, labels)
    kinds = pa.schema([("model", pa.binary()), ("slope", pa.float64()), ("shift", pa.float64()), ("constant", pa.float64())])
    yield pa.RecordBatch.from_pylist([{"model": m.table.tobytes(), "slope": m.slope, "shift": m.shift, "constant": m.constant}], kinds)


def toxicity(text: Column, model: Model) -> Column:
    """Score from 0 to 1 of each text."""
    shared = [model]

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(shared[0].score(texts))

    return run(text)
