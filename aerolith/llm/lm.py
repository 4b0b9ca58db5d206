"""Language-model scores by deleted interpolation: bigram, unigram and uniform estimates, mixed by how frequent the context is.

Words are numbered by count. Bigrams of the very most frequent words are a small matrix that every task has, so none of the
keys that are left is hot. All other bigrams of numbered words travel in packed blocks (sorted keys and the rows they are
in), as shuffling one row a token costs more than the work itself. Bigrams of rarer words are joined with their counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import fold, least_count, parts, staged, table, texts
from aerolith.llm.hashing import STEP, U64, WordHashes, signed

#: Stands at the end of each text; no word has white space.
END = b"\n"
#: Bytes of text that are taken apart together.
BLOCK = 1 << 22
#: Bits of a word's number.
BITS = 20
#: Words whose number is its hash with this bit set are not numbered by count.
RARE = -(1 << 63)
#: Bits of a row's number within the texts whose sums are put together in one place.
NEAR = 16
#: Lines of the matrix of the most frequent words that are summed in one place.
LINES = 16


@dataclass(frozen=True)
class Plan:
    """Bounds of what every task holds and of what is counted in one place; none of them changes a result.

    listed: words that are numbered, the most frequent ones (1 << BITS at most). head: those whose bigrams are a matrix.
    held: one training text in so many is held out to learn the weights. entries: tokens counted together.
    """

    listed: int = 1 << BITS
    head: int = 1024
    held: int = 10
    entries: int = 1 << 21
    rounds: int = 40


class Counts(NamedTuple):
    """In all training texts, and in those of them that are held out."""

    all: np.ndarray
    held: np.ndarray


@dataclass
class Model:
    total: int
    held: int
    distinct: int
    hashes: np.ndarray  # of numbered words, sorted
    order: np.ndarray  # their numbers
    words: Counts  # by number
    head: Counts = field(default_factory=lambda: Counts(np.zeros((0, 0), np.int64), np.zeros((0, 0), np.int64)))
    weights: np.ndarray = field(default_factory=lambda: np.tile([0.0, 0.0, 1.0], (64, 1)))  # bucket x (bigram, unigram, uniform)

    def codes(self, words: list[bytes], known: WordHashes) -> np.ndarray:
        """Number of each word, or its hash with the sign bit set."""
        h = known.of(words)
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        found = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        return np.where(found, self.order[at] if len(self.hashes) else 0, signed(h | U64(1 << 63)))

    def log(self, c: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
        """log10 of the probability of words of count cy after contexts of count cx, which they follow c times."""
        w = self.weights[bucket(cx)]
        p = w[:, 0] * c / np.maximum(cx, 1) + w[:, 1] * cy / max(self.total, 1) + w[:, 2] / (self.distinct + 1)
        return np.log10(np.maximum(p, 1e-300))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.total + self.distinct + 1))

    def events(self, c: Counts, x: Counts, y: Counts) -> np.ndarray:
        """Rows bucket, mass, bigram, unigram (estimates without the held-out texts) in cells of a quarter of a power of two."""
        mine = np.flatnonzero(c.held)
        c, x, y = (Counts(t.all[mine], t.held[mine]) for t in (c, x, y))
        mass, after = c.held.astype(float), x.all - x.held
        two = (c.all - c.held) / np.maximum(after, 1)
        one = (y.all - y.held) / max(self.total - self.held, 1)
        cell = [bucket(after), *(np.floor(4 * np.log2(np.maximum(v, 1e-30))).astype(np.int64) for v in (two, one))]
        keys, inverse = np.unique(np.stack(cell, 1), axis=0, return_inverse=True)
        sums = [np.bincount(inverse.ravel(), v, len(keys)) for v in (mass, mass * two, mass * one)]
        return np.column_stack([keys, *sums])


EVENTS = "b double, i double, j double, m double, t double, o double"


def bucket(cx: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(cx, 1)).astype(np.int64)


def _event_batch(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in rows.T.astype(float)], list("bijmto"))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, all as long, as zstd of their bytes by significance."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), 8).T).tobytes() for c in columns), 1)


def unpack(z: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(z), np.uint8)
    return np.ascontiguousarray(raw.reshape(-1, 8, n).transpose(0, 2, 1)).view(np.int64)[:, :, 0]


def _split(said: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct lower-cased words, the number of each word of the texts among them, words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(said)))
    coded = lists.flatten().dictionary_encode()
    words, index = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
    sizes = np.diff(lists.offsets.to_numpy())
    if b"" in words:  # a text without words
        keep = index != words.index(b"")
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
        index = index[keep]
    return words, index, sizes


def unigrams(docs: DataFrame) -> DataFrame:
    """h (hash of a token), c, held (how often training texts, and the held-out ones of them, have it). docs: text, part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = WordHashes(), [], 0

        def merged() -> tuple[np.ndarray, ...]:
            h, c, f = (np.concatenate(v) for v in zip(*held, strict=True))
            h, inverse = np.unique(h, return_inverse=True)
            return h, np.bincount(inverse, c, len(h)).astype(np.int64), np.bincount(inverse, f, len(h)).astype(np.int64)

        for batch in batches:
            for block in parts(batch, 0, BLOCK):
                words, index, sizes = _split(block.column(0))
                part = np.repeat(block.column(1).to_numpy(), sizes)
                ends = np.bincount(block.column(1).to_numpy(), minlength=3)
                c, f = (np.r_[np.bincount(index[part >= k], minlength=len(words)), ends[k:].sum()] for k in (1, 2))
                some = np.flatnonzero(c)
                held.append((known.of([*words, END])[some], c[some], f[some]))
                size += len(some)
                if size > 2_000_000:
                    held[:] = [merged()]
                    if len(held[0][0]) > 1_000_000:
                        yield _columns(["h", "c", "held"], *held.pop())
                    size = sum(len(x[0]) for x in held)
        if held:
            yield _columns(["h", "c", "held"], *merged())

    return docs.select("text", "part").mapInArrow(run, "h long, c long, held long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("held").alias("held"))


def _columns(names: list[str], *values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(v) if v.dtype == U64 else v) for v in values], names)


class Block(NamedTuple):
    rows: np.ndarray  # of each text: task << 40 | number in it << 2 | part
    docs: pa.RecordBatch
    sizes: np.ndarray
    x: np.ndarray  # code of the word before each token; of END before a text's first
    y: np.ndarray  # code of each token


def _blocks(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[Block]:
    """batches: text, part and more. The same rows get the same numbers each time that a table is read."""
    known, row = WordHashes(), TaskContext.get().partitionId() << 38
    end = int(model.codes([END], known)[0])
    for batch in batches:
        for docs in parts(batch, 0, BLOCK):
            words, index, sizes = _split(docs.column(0))
            y = np.insert(model.codes(words, known)[index] if len(index) else np.zeros(0, np.int64), np.cumsum(sizes), end)
            sizes = sizes + 1
            x = np.r_[end, y[:-1]]
            yield Block((row + np.arange(len(sizes))) << 2 | docs.column(1).to_numpy(), docs, sizes, x, y)
            row += len(sizes)


def _tail(docs: DataFrame, shared, head: int, places: int) -> DataFrame:
    """p, n, z: packed keys (context << BITS | word, sorted) and rows of n tokens outside the matrix, dealt to places by a hash of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            key, row = (np.concatenate(v) for v in zip(*held, strict=True))
            place = ((key.astype(U64) * STEP >> U64(32)) * U64(places) >> U64(32)).astype(np.int64)
            order = np.argsort(place << 2 * BITS | key)
            key, row, place = key[order], row[order], place[order]
            cut = np.flatnonzero(np.r_[True, np.diff(place) != 0, True]) if len(place) else np.zeros(1, np.int64)
            out = [(int(place[a]), int(b - a), pack(np.diff(key[a:b], prepend=0), row[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["p", "n", "z"])

        for block in _blocks(batches, shared.value):
            mine = (block.x >= 0) & (block.y >= 0) & ((block.x >= head) | (block.y >= head))
            held.append((block.x[mine] << BITS | block.y[mine], np.repeat(block.rows, block.sizes)[mine]))
            size += len(held[-1][0])
            if size > 4_000_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    return docs.select("text", "part").mapInArrow(run, "p long, n long, z binary")


def _of_one_place(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """p and its unpacked blocks, from rows p, n, z in order of p."""
    now, held = None, []
    for batch in batches:
        for p, n, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if p != now and held:
                yield now, held
                held = []
            now = p
            held.append(unpack(z.as_buffer(), n))
    if held:
        yield now, held


def _counted(tail: DataFrame, shared) -> DataFrame:
    """n, z: packed distinct bigrams (key, c, tokens) and k, rows: packed rows of these tokens; or events of the held-out ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for _, blocks in _of_one_place(batches):
            key, row = np.concatenate([np.cumsum(b[0]) for b in blocks]), np.concatenate([b[1] for b in blocks])
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order]
            new = np.flatnonzero(np.r_[True, np.diff(key) != 0])
            c = Counts(*(np.add.reduceat((row & 3) >= k, new, dtype=np.int64) for k in (1, 2)))
            pair, size = key[new], np.diff(np.r_[new, len(key)])
            x, y = pair >> BITS, pair & (1 << BITS) - 1
            z, rows = pack(np.diff(pair, prepend=0), c.all, size), pack(row >> 2)
            events = model.events(c, Counts(*(t[x] for t in model.words)), Counts(*(t[y] for t in model.words)))
            empty = pa.nulls(1, pa.float64())
            first = [pa.array([len(pair)]), pa.array([z], pa.binary()), pa.array([len(row)]), pa.array([rows], pa.binary())]
            names = ["n", "z", "k", "rows", *"bijmto"]
            yield pa.RecordBatch.from_arrays([*first, *[empty] * 6], names)
            if len(events):
                e = _event_batch(events)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(events), a.type) for a in first), *e.columns], names)

    near = tail.repartition("p").sortWithinPartitions("p")
    return near.mapInArrow(run, f"n long, z binary, k long, rows binary, {EVENTS}")


def _others(docs: DataFrame, shared, head: int) -> DataFrame:
    """p, n, z: packed cells, counts and held-out counts of some lines of the matrix; or x, y, row: a token with a word that isn't numbered."""
    names = ["p", "n", "z", "x", "y", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, head * head), np.int64)
        for block in _blocks(batches, shared.value):
            rows = np.repeat(block.rows, block.sizes)
            for k in (1, 2):
                mine = (block.x >= 0) & (block.y >= 0) & (block.x < head) & (block.y < head) & ((rows & 3) >= k)
                sums[k - 1] += np.bincount(block.x[mine] * head + block.y[mine], minlength=head * head)
            rare = np.flatnonzero((block.x < 0) | (block.y < 0))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rare), pa.int64()), pa.nulls(len(rare), pa.int64()), pa.nulls(len(rare), pa.binary()), *map(pa.array, (block.x[rare], block.y[rare], rows[rare]))], names)
        cell = np.flatnonzero(sums[0])
        place = cell // (head * LINES)
        cut = np.flatnonzero(np.r_[True, np.diff(place) != 0, True]) if len(cell) else np.zeros(1, np.int64)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            z = pack(np.diff(cell[a:b], prepend=0), sums[0, cell[a:b]], sums[1, cell[a:b]])
            yield pa.RecordBatch.from_arrays([pa.array([int(place[a])]), pa.array([int(b - a)]), pa.array([z], pa.binary()), *[pa.nulls(1, pa.int64())] * 3], names)

    return docs.select("text", "part").mapInArrow(run, "p long, n long, z binary, x long, y long, row long")


def _matrix(cells: DataFrame, head: int) -> Counts:
    """The counts of the most frequent words' bigrams, head * head of them at any size of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros((2, head * LINES), np.int64)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sums.shape[1]]), pa.array([pack(*sums)], pa.binary())], ["p", "n", "z"])

        for batch in batches:
            for p, n, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if p != now:
                    if now is not None:
                        yield made()
                    now = p
                    sums[:] = 0
                cell, c, held = unpack(z.as_buffer(), n)
                at = np.cumsum(cell) - p * head * LINES
                sums[0, at] += c
                sums[1, at] += held
        if now is not None:
            yield made()

    out = np.zeros((2, -(-head // LINES) * LINES * head), np.int64)
    for r in cells.select("p", "n", "z").repartition("p").sortWithinPartitions("p").mapInArrow(run, "p long, n long, z binary").collect():
        out[:, r.p * r.n : (r.p + 1) * r.n] = unpack(bytes(r.z), r.n)
    return Counts(*(v[: head * head].reshape(head, head) for v in out))


def _with_words(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """pairs (x, y and more) with ux, uxh, uy, uyh: counts of the words that aren't numbered, 0 for those never seen.

    Rows with a numbered word are spread over that join by keys that no word has.
    """
    for s in "xy":
        pairs = pairs.withColumn("__key", F.when(F.col(s) < 0, F.col(s)).otherwise(F.xxhash64("x", "y").bitwiseAND((1 << 63) - 1)))
        named = words.select(F.col("code").alias("__key"), F.col("c").alias(f"u{s}"), F.col("held").alias(f"u{s}h"))
        pairs = pairs.join(named, "__key", "left").drop("__key").fillna(0, [f"u{s}", f"u{s}h"])
    return pairs


def _of_words(code: np.ndarray, c: np.ndarray, held: np.ndarray, model: Model) -> Counts:
    """Counts of words by code, where c and held have those that aren't numbered."""
    if not len(model.words.all):
        return Counts(c, held)
    at = np.maximum(code, 0)
    return Counts(np.where(code < 0, c, model.words.all[at]), np.where(code < 0, held, model.words.held[at]))


def _mixed(events: np.ndarray, rounds: int) -> np.ndarray:
    """Weights of the three estimates for each bucket by expectation-maximisation; those of all events where a bucket has none.

    events: bucket, mass, bigram, unigram, uniform.
    """

    def learnt(e: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            p = e[:, 2:] * w
            w = (e[:, 1:2] * p / np.maximum(p.sum(1, keepdims=True), 1e-300)).sum(0)
            w = np.maximum(w / w.sum(), 1e-6)
            w /= w.sum()
        return w

    out = np.tile(learnt(events) if len(events) else [0.0, 0.0, 1.0], (64, 1))
    for b in np.unique(events[:, 0]).astype(int):
        out[b] = learnt(events[events[:, 0] == b])
    return out


def scored(documents: DataFrame, trained: Column, plan: Plan = Plan()) -> tuple[DataFrame, Model]:
    """doc_id, n_tokens, n_known, base_score, score for each row of documents, and the model of the rows where trained holds.

    A text's probability is the product over its tokens (lower-cased words, then one end) of
    w2 * c(context, token) / c(context) + w1 * c / N + w0 / (V + 1), the weights by the bucket of the context's count. They
    are learnt by expectation-maximisation on the training texts whose hash modulo plan.held is 0 (copies go together),
    with the counts of all others; the estimates of the model are from all training texts. Every bigram and every word
    counts, down to one.

    A null or empty text is its end alone. Repeated rows are scored alike, each on its own, also where rows share a doc_id
    or have none; other columns are not read. A very long text needs memory for its words. Without training texts all
    probabilities are one. documents is read four times and has to give its rows in the same order each time, as a table
    does.
    """
    spark = documents.sparkSession
    docs = texts(documents, trained.alias("__trained")).withColumn("part", F.when(~F.coalesce("__trained", F.lit(False)), 0).when(F.pmod(F.xxhash64("text"), F.lit(plan.held)) == 0, 2).otherwise(1).cast("long"))
    docs = docs.select("text", "part", "doc_id")
    words = staged(unigrams(docs), "unigrams")
    total, held, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("held"), F.lit(0)), F.count("*")).first()
    least = least_count(words, plan.listed)
    listed = words.where(F.col("c") >= least).toArrow()  # at most plan.listed rows
    h, c, f = (listed.column(k).to_numpy() for k in range(3))
    rank = np.lexsort((h, -c))
    h = h[rank].view(U64)
    order = np.argsort(h)
    model = Model(total, held, distinct, h[order], order, Counts(c[rank], f[rank]))
    shared = spark.sparkContext.broadcast(model)

    tail = staged(_counted(_tail(docs, shared, plan.head, 1 + int(1.2 * total) // plan.entries), shared), "bigrams")
    others = staged(_others(docs, shared, plan.head), "others")
    rare = others.where("z IS NULL").select("x", "y", "row")
    seen = lambda k: F.sum((F.col("row").bitwiseAND(3) >= k).cast("long"))
    pairs = rare.groupBy("x", "y").agg(seen(1).alias("c"), seen(2).alias("held"))
    pairs = staged(_with_words(pairs, words.where(F.col("c") < least).select(F.col("h").bitwiseOR(F.lit(RARE)).alias("code"), "c", "held")), "pairs")

    def rare_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x, y, c, held, ux, uxh, uy, uyh = (col.to_numpy() for col in batch.columns)
            yield _event_batch(m.events(Counts(c, held), _of_words(x, ux, uxh, m), _of_words(y, uy, uyh, m)))

    found = pairs.where("held > 0").select("x", "y", "c", "held", "ux", "uxh", "uy", "uyh").mapInArrow(rare_events, EVENTS)
    found = found.unionAll(tail.where("b IS NOT NULL").select(*"bijmto")).groupBy("b", "i", "j").agg(*(F.sum(k).alias(k) for k in "mto"))
    model.head = _matrix(others.where("z IS NOT NULL"), plan.head)
    x, y = np.divmod(np.flatnonzero(model.head.held), plan.head)
    at = lambda t, i: Counts(t.all[i], t.held[i])
    events = np.array([tuple(r) for r in found.collect()], float).reshape(-1, 6)
    if len(x):
        events = np.concatenate([events, model.events(Counts(model.head.all[x, y], model.head.held[x, y]), at(model.words, x), at(model.words, y))])
    e = events[events[:, 3] > 0]
    model.weights = _mixed(np.column_stack([e[:, 0], e[:, 3], e[:, 4] / e[:, 3], e[:, 5] / e[:, 3], np.full(len(e), 1 / (distinct + 1))]), plan.rounds)
    return _summed(docs, tail.where("z IS NOT NULL"), rare, pairs, model), model


def _summed(docs: DataFrame, tail: DataFrame, rare: DataFrame, pairs: DataFrame, model: Model) -> DataFrame:
    """The scores from what each kind of token adds to its row."""
    shared, size = docs.sparkSession.sparkContext.broadcast(model), len(model.head.all)
    names = ["row", "doc_id", "n_tokens", "n_known", "base", "score"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for b in _blocks(batches, m):
            owner, n = np.repeat(np.arange(len(b.sizes)), b.sizes), len(b.sizes)
            known = b.y >= 0
            base = np.bincount(owner[known], m.base(m.words.all[b.y[known]]), n)
            here = known & (b.x >= 0) & (b.x < size) & (b.y < size)
            x, y = b.x[here], b.y[here]
            score = np.bincount(owner[here], m.log(m.head.all[x, y], m.words.all[x], m.words.all[y]), n)
            columns = [b.rows >> 2, b.docs.column(2), b.sizes.astype(np.int64), np.bincount(owner[known], minlength=n).astype(np.int64), base.astype(float), score.astype(float)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    def added(row: np.ndarray, known: np.ndarray | None, base: np.ndarray | None, score: np.ndarray) -> pa.RecordBatch:
        rows, inverse = np.unique(row, return_inverse=True)
        sums = [np.bincount(inverse, v, len(rows)) if v is not None else np.zeros(len(rows)) for v in (known, base, score)]
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.nulls(len(rows), pa.int64()), pa.array(np.zeros(len(rows), np.int64)), pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:])], names)

    def of_tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            for n, z, k, rows in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                key, c, tokens = unpack(z.as_buffer(), n)
                key = np.cumsum(key)
                p = m.log(c, m.words.all[key >> BITS], m.words.all[key & (1 << BITS) - 1])
                row, inverse = np.unique(unpack(rows.as_buffer(), k)[0], return_inverse=True)
                score = np.bincount(inverse, np.repeat(p, tokens), len(row)).view(np.int64)
                cut = np.flatnonzero(np.r_[True, np.diff(row >> NEAR) != 0, True])
                out = [(int(row[i] >> NEAR), int(j - i), pack(np.diff(row[i:j], prepend=0), score[i:j])) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in out], t) for f, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["p", "n", "z"])

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in _of_one_place(batches):
            yield added(np.concatenate([np.cumsum(b[0]) for b in blocks]), None, None, np.concatenate([b[1].view(np.float64) for b in blocks]))

    def of_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            x, y, row, c, ux, uy = (col.to_numpy() for col in batch.columns)
            cx, cy = _of_words(x, ux, ux, m).all, _of_words(y, uy, uy, m).all
            yield added(row >> 2, (y < 0) & (cy > 0), np.where(y < 0, m.base(cy), 0.0), m.log(c, cx, cy))

    schema = "row long, doc_id long, n_tokens long, n_known long, base double, score double"
    tail = tail.select("n", "z", "k", "rows").mapInArrow(of_tail, "p long, n long, z binary")
    out = docs.mapInArrow(whole, schema).unionAll(tail.repartition("p").sortWithinPartitions("p").mapInArrow(by_row, schema))
    out = out.unionAll(rare.join(pairs, ["x", "y"]).select("x", "y", "row", "c", "ux", "uy").mapInArrow(of_rare, schema))
    out = out.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(k).alias(k) for k in names[2:]))
    return out.select("doc_id", "n_tokens", "n_known", F.col("base").alias("base_score"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    out, model = scored(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return out.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
