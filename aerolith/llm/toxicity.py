"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy on a bounded labelled sample."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import fold, table, texts

MARKS = b".,;:!?\"'()[]{}|#*$%&<>-_"


@dataclass(frozen=True)
class Shape:
    slots: int = 1 << 16
    dim: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    #: A word's vector is the sum of the vectors of itself and of its first so many bytes.
    prefixes: tuple[int, ...] = (4, 5, 6)
    #: A slot that fewer training texts have keeps a zero vector, as has any that none has.
    least_texts: int = 4


class Words:
    """Numbers for words and the hashed slots of each; 0 is the gap between texts."""

    def __init__(self, shape: Shape, most: int = 400_000):
        self.shape, self.most = shape, most
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.slots = np.zeros((1, 1 + len(self.shape.prefixes)), np.int64)

    def _slots(self, word: bytes) -> list[int]:
        w = word.strip(MARKS)
        n = self.shape.slots - 1
        return [1 + xxhash.xxh3_64_intdigest(b"w" + w) % n, *(1 + xxhash.xxh3_64_intdigest(b"p%d" % k + w[:k]) % n for k in self.shape.prefixes)]

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, each followed by gaps so that no filter spans two texts; the start of each text."""
        if len(self.number) > self.most:
            self.clear()
        number, gaps = self.number, max(self.shape.widths)
        known, flat, starts, new = len(number), [], [], []
        for text in texts:
            starts.append(len(flat))
            words = text.encode("utf-8", "replace").lower().split()
            for w in set(words):
                if w not in number:
                    number[w] = len(number) + 1
                    new.append(w)
            flat += map(number.__getitem__, words)
            flat += [0] * gaps
        if len(number) > known:
            self.slots = np.concatenate([self.slots, np.array([self._slots(w) for w in new])])
        return np.array(flat, np.int64), np.array(starts, np.int64)


@dataclass
class Net:
    shape: Shape
    embed: np.ndarray
    filters: list[np.ndarray]  # width, dim, filters
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def new(cls, shape: Shape, seed: int) -> Net:
        rng = np.random.default_rng(seed)
        draw = lambda *n, by=1.0: (rng.standard_normal(n) * by).astype(np.float32)
        embed = draw(shape.slots, shape.dim, by=0.02)  # small: words that training has not moved stay quiet under the maximum
        embed[0] = 0
        n = len(shape.widths) * shape.filters
        return cls(shape, embed, [draw(k, shape.dim, shape.filters, by=(k * shape.dim) ** -0.5) for k in shape.widths], np.zeros(n, np.float32), draw(n, by=n**-0.5))

    def vectors(self, slots: np.ndarray) -> np.ndarray:
        return self.embed[slots].sum(1)

    def pooled(self, x: np.ndarray, starts: np.ndarray, where: bool = False):
        """The largest answer of each filter in each text, and with where its position."""
        best, at = [], []
        for k, w in zip(self.shape.widths, self.filters, strict=True):
            y = x @ w[0]
            for j in range(1, k):
                y[:-j] += x[j:] @ w[j]
            best.append(np.maximum.reduceat(y, starts))
            if where:
                ends = np.append(starts[1:], len(x))
                at.append(np.stack([a + y[a:b].argmax(0) for a, b in zip(starts, ends, strict=True)]))
        return np.concatenate(best, 1), at

    def logits(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(x, starts)[0] + self.bias, 0) @ self.out + self.shift

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x, starts).astype(np.float64), -30, 30)))


def fit(rows: list[tuple[str, int, str]], shape: Shape = Shape(), epochs: int = 5, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Net:
    """rows: text, label, language. A fifth is held back to calibrate the cut at 0.5 and the thresholds of languages.

    Without rows the net gives every text the same score.
    """
    net, words, rng = Net.new(shape, seed), Words(shape, 1 << 60), np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    back, train = order[: len(rows) // 5], order[len(rows) // 5 :]
    coded = [words.numbers([text])[0] for text, _, _ in rows]
    label = np.array([y for _, y, _ in rows], np.float32)
    if not len(rows):
        net.embed *= 0
        return net
    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-6), 0.5 / max(1 - label.mean(), 1e-6))
    moments: dict = {}
    seen = np.bincount(np.concatenate([np.zeros(0, np.int64), *(np.unique(words.slots[np.unique(coded[i])]) for i in train)]), minlength=shape.slots)
    common = (seen >= shape.least_texts)[:, None]
    common[0] = False
    net.embed *= common

    def step(name: str, p: np.ndarray, g: np.ndarray, rows_of: np.ndarray | slice = slice(None)) -> None:
        m, v = moments.setdefault(name, (np.zeros_like(p), np.zeros_like(p)))
        m[rows_of] = 0.9 * m[rows_of] + 0.1 * g
        v[rows_of] = 0.99 * v[rows_of] + 0.01 * g * g
        p[rows_of] -= rate * m[rows_of] / (np.sqrt(v[rows_of]) + 1e-6)

    for _ in range(epochs):
        for at in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
            flat = np.concatenate([coded[i] for i in at])
            starts = np.cumsum([0, *(len(coded[i]) for i in at[:-1])])
            x = net.vectors(words.slots[flat])
            best, where = net.pooled(x, starts, True)
            h = best + net.bias
            p = 1 / (1 + np.exp(-np.clip(np.maximum(h, 0) @ net.out + net.shift, -30, 30)))
            d = ((p - label[at]) * weight[at] / len(at)).astype(np.float32)
            dh = d[:, None] * net.out * (h > 0)
            step("out", net.out, np.maximum(h, 0).T @ d + 1e-4 * net.out)
            step("bias", net.bias, dh.sum(0))
            dx: dict[int, np.ndarray] = {}
            touched, grads = [], []
            for n, (k, w) in enumerate(zip(shape.widths, net.filters, strict=True)):
                g, pos = dh[:, n * shape.filters : (n + 1) * shape.filters], where[n]
                dw = np.zeros_like(w)
                for j in range(k):
                    q = np.minimum(pos + j, len(x) - 1)
                    dw[j] = np.einsum("df,dfe->ef", g, x[q])
                    touched.append(q.ravel())
                    grads.append((g[:, :, None] * w[j].T[None]).reshape(-1, shape.dim))
                step(f"w{k}", w, dw)
            slots = words.slots[flat[np.concatenate(touched)]]
            slot, inverse = np.unique(slots, return_inverse=True)
            g = np.repeat(np.concatenate(grads), slots.shape[1], axis=0)
            sums = np.stack([np.bincount(inverse.ravel(), g[:, e], len(slot)) for e in range(shape.dim)], 1).astype(np.float32)
            step("embed", net.embed, sums * common[slot], slot)
            net.shift -= rate * float(d.sum())
    if len(back):
        flat, starts = np.concatenate([coded[i] for i in back]), np.cumsum([0, *(len(coded[i]) for i in back[:-1])])
        z = net.logits(net.vectors(words.slots[flat]), starts)
        net.shift -= _cut(z, label[back])
        z = 1 / (1 + np.exp(-np.clip(z - _cut(z, label[back]), -30, 30)))
        lang = np.array([str(rows[i][2]) for i in back])
        net.thresholds = {str(k): float(_cut(z[lang == k], label[back][lang == k], 0.5)) for k in np.unique(lang)}
    return net


def _cut(z: np.ndarray, label: np.ndarray, other: float = 0.0) -> float:
    """The cut with the best F1, in the middle of the gap; other where one of the labels is missing."""
    if not 0 < label.sum() < len(label):
        return other
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + label.sum())
    k = int(f1.argmax())
    return float((z[order[k]] + z[order[min(k + 1, len(z) - 1)]]) / 2)


def sample(docs: DataFrame, labels: DataFrame, most: int = 1600, most_chars: int = 200_000) -> list[tuple[str, int, str]]:
    """Labelled training rows outside the held-out fold: most rows of each label by hash of the id, texts of most_chars at most."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    marked = marked.where(fold("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [marked.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (1, 0)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.length("text") <= most_chars)
    found = rows.join(F.broadcast(some[0].unionAll(some[1])), "doc_id").select("doc_id", "text", "toxic", "lang")  # 2 * most rows
    return [(r.text, r.toxic, r.lang) for r in sorted(found.collect(), key=lambda r: (r.doc_id, r.text))]


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, lang, score and predicted for each row of docs, from its whole text alone.

    A null or empty text has the score of a text without words; repeated rows score alike, and rows that share a doc_id
    or have none each on their own. A score that equals a threshold counts as toxic. A text of any length is read whole,
    in one task, with memory in proportion to it; an empty table gives an empty one. Other columns are not read; lang is
    carried only to be compared with the threshold of its language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words, vectors = Words(model.shape), np.zeros((0, model.shape.dim), np.float32)
        for batch in batches:
            done = 0
            while done < batch.num_rows:  # about a million bytes of text at a time
                n, size = 0, 0
                while done + n < batch.num_rows and (n == 0 or size < 1 << 20):
                    size += len(batch.column(1)[done + n].as_buffer() or b"")
                    n += 1
                part = batch.slice(done, n)
                done += n
                flat, starts = words.numbers(part.column(1).to_pylist())
                if len(words.slots) < len(vectors):
                    vectors = vectors[:0]
                vectors = np.concatenate([vectors, model.vectors(words.slots[len(vectors) :])])
                s = model.scores(vectors[flat], starts)
                limit = np.array([model.thresholds.get(str(x), 0.5) for x in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array((s >= limit).astype(np.int32))], ["doc_id", "score", "predicted", "flagged"]
                )

    return texts(docs, F.col("lang").cast("string").alias("lang")).mapInArrow(run, "doc_id long, score double, predicted int, flagged int")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, fit(sample(docs, labels)))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "flagged")
