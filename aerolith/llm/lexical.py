"""Ranked lexical search: posting lists cut into blocks of similar documents, each with the coordinatewise maxima of its documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.common import keyed, parts, staged, table, unkeyed

#: Bytes that belong to no term become spaces, A-Z become a-z; bytes of other characters stay.
FOLD = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


@dataclass(frozen=True)
class Plan:
    """Sizes of the index; results don't depend on them."""

    #: Bytes of different items that are searched together.
    items: int = 1 << 21
    #: Documents and pairs of document and term that are indexed together.
    shard_docs: int = 4096
    shard_pairs: int = 1_000_000
    #: Documents of a block at most.
    block: int = 32
    #: Coordinates of a document's sketch, by which similar ones of a list meet.
    sketch: int = 8
    #: Summary entries that a shard keeps; lists are cut anew after that.
    kept: int = 6_000_000


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


class Best:
    """The k best documents of an item so far, by score, then doc_id; limit: a score that a document needs to be worth a look."""

    __slots__ = ("k", "scores", "docs", "limit")

    def __init__(self, k: int, limit: int):
        self.k, self.limit = k, max(1, limit)
        self.scores = self.docs = np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        keep = scores >= self.limit
        scores, docs = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.docs, docs[keep]])
        order = np.lexsort((docs, -scores))[: self.k]
        self.scores, self.docs = scores[order], docs[order]
        if len(order) == self.k:
            self.limit = max(self.limit, int(self.scores[-1]))


class Shard:
    """Index of some documents over the terms of the items. A pair's impact is what one occurrence in an item adds to the score."""

    def __init__(self, docs: np.ndarray, ptr: np.ndarray, ids: np.ndarray, tf: np.ndarray, n: np.ndarray, weight: np.ndarray, total: int, length: int, plan: Plan):
        self.plan, self.docs, self.ptr, self.ids = plan, docs, ptr, ids
        m = 75 + (25 * n * total) // max(1, length)
        self.row = np.repeat(np.arange(len(docs)), np.diff(ptr))
        self.impact = weight[ids] * (1_000_000_000 * tf // (1000 * tf + 12 * m[self.row]))
        order = np.argsort(ids, kind="stable")
        self.listed = self.row[order]
        self.list_ptr = np.searchsorted(ids[order], np.arange(len(weight) + 1))
        self.top = np.zeros(len(weight), np.int64)
        np.maximum.at(self.top, ids, self.impact)
        directions = np.random.default_rng(11).standard_normal((len(weight), plan.sketch)).astype(np.float32)
        self.sketch = np.zeros((len(docs), plan.sketch), np.float32)
        some = np.flatnonzero(np.diff(ptr))
        if len(some):
            scaled = np.sqrt(self.impact.astype(np.float32))
            for c in range(plan.sketch):
                self.sketch[some, c] = np.add.reduceat(directions[ids, c] * scaled, ptr[some])
        self.sketch /= np.maximum(np.linalg.norm(self.sketch, axis=1, keepdims=True), 1e-6)
        self.known: dict[int, tuple] = {}
        self.held = 0

    def pairs(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows' pairs, and the number of pairs of each row."""
        size = self.ptr[rows + 1] - self.ptr[rows]
        ends = np.cumsum(size)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ptr[rows] - (ends - size), size), size

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """rows in block order, ends of blocks, and the summaries' terms (ascending), blocks and maxima.

        A document of the list belongs to the pivot that its sketch is nearest to; a pivot's documents are cut into blocks by nearness.
        """
        if term in self.known:
            return self.known[term]
        rows, most = self.listed[self.list_ptr[term] : self.list_ptr[term + 1]], self.plan.block
        if len(rows) > most:
            pivots = rows[:: max(1, most)]
            near = self.sketch[rows] @ self.sketch[pivots].T
            to = near.argmax(1)
            order = np.lexsort((-near[np.arange(len(rows)), to], to))
            rows, to = rows[order], to[order]
            start = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            place = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
            ends = np.r_[np.flatnonzero(place % most == 0)[1:], len(rows)]
        else:
            ends = np.array([len(rows)])
        at, size = self.pairs(rows)
        block = np.repeat(np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends])), size)
        key = self.ids[at] * len(ends) + block
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        highest = np.maximum.reduceat(self.impact[at[order]], first)
        found = (rows, ends, key[first] // len(ends), key[first] % len(ends), highest)
        if self.held + len(first) > self.plan.kept:
            self.known.clear()
            self.held = 0
        self.known[term] = found
        self.held += len(first)
        return found

    def scores(self, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Exact scores; asked: occurrences in the item by term. Each row has a pair at least."""
        at, size = self.pairs(rows)
        return np.add.reduceat(self.impact[at] * asked[self.ids[at]], np.cumsum(size) - size)

    def search(self, item: np.ndarray, times: np.ndarray, asked: np.ndarray, best: Best, quick: bool) -> None:
        """Adds this shard's documents to the item's best. quick: only the best blocks of the first list, for a first limit.

        Lists are read by what their term adds at most. Once the lists that are left add less than the limit together, no
        unread document reaches it; a block is skipped only if its summary's score for the item is below the limit.
        """
        most = times * self.top[item]
        order = np.argsort(-most, kind="stable")
        left = np.cumsum(most[order][::-1])[::-1]
        seen = np.zeros(len(self.docs), bool)
        for j, k in enumerate(order):
            if left[j] < best.limit:
                return
            rows, ends, of, block, highest = self.blocks(int(item[k]))
            low, high = np.searchsorted(of, item, "left"), np.searchsorted(of, item, "right")
            size = high - low
            at = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
            bound = np.zeros(len(ends), np.int64)
            np.add.at(bound, block[at], highest[at] * np.repeat(times, size))
            go = np.argsort(-bound, kind="stable")
            starts, step, a = np.r_[0, ends[:-1]], 1, 0
            while a < len(go) and bound[go[a]] >= best.limit:
                some = go[a : a + step]
                some = some[bound[some] >= best.limit]
                look = np.concatenate([rows[starts[b] : ends[b]] for b in some])
                look = look[~seen[look]]
                seen[look] = True
                if len(look):
                    best.add(self.scores(look, asked), self.docs[look])
                a, step = a + step, step * 2
                if quick and len(best.docs) == best.k:
                    return
            if quick:
                return


class Items:
    """Items of one block: each one's terms as numbers, with their occurrences."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        self.keys = [k for k, _ in rows]
        counts = [Counter(terms(t)) for _, t in rows]
        self.vocabulary = {w: i for i, w in enumerate(sorted(set().union(*counts)))} if counts else {}
        self.items = [(np.array([self.vocabulary[w] for w in c], np.int64), np.array(list(c.values()), np.int64)) for c in counts]


def _blocks(items: DataFrame, plan: Plan) -> Iterator[Items]:
    """Different texts of the items, plan.items bytes at a time."""
    listed = items.select("key", "text").distinct()
    total = listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // plan.items))
    if blocks > 1:
        listed = staged(listed, "items")
    for b in range(blocks):
        some = listed.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()
        yield Items(sorted((r.key, r.text.encode()) for r in some))


def _vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (all terms), ids and tf of the terms that items have, for each document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        for batch in batches:
            for part in parts(batch, 1, 1 << 22):
                who, n, ids, tf = [], [], [], []
                for k, text in enumerate(part.column(1)):
                    words = terms((text.as_buffer() or pa.py_buffer(b"")).to_pybytes())
                    if words:
                        count = Counter(map(get, words))
                        count.pop(None, None)
                        who.append(k)
                        n.append(len(words))
                        ids.append(list(count))
                        tf.append(list(count.values()))
                values = [part.column(0).take(pa.array(who, pa.int64())), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(values, ["doc_id", "n", "ids", "tf"])

    return docs.mapInArrow(run, "doc_id long, n long, ids array<int>, tf array<int>")


def _shards(batches: Iterator[pa.RecordBatch], weight: np.ndarray, total: int, length: int, plan: Plan) -> Iterator[Shard]:
    held: list[pa.RecordBatch] = []
    docs = size = 0

    def shard() -> Shard:
        columns = [pa.concat_arrays([b.column(c) for b in held]) for c in range(4)]
        doc, n = (columns[c].to_numpy().astype(np.int64) for c in (0, 1))
        ids, tf = (columns[c].flatten().to_numpy().astype(np.int64) for c in (2, 3))
        return Shard(doc, np.r_[0, np.cumsum(columns[2].value_lengths().to_numpy().astype(np.int64))], ids, tf, n, weight, total, length, plan)

    for batch in batches:
        for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
            held.append(part)
            docs, size = docs + part.num_rows, size + len(part.column(2).flatten())
            if docs >= plan.shard_docs or size >= plan.shard_pairs:
                yield shard()
                held, docs, size = [], 0, 0
    if held:
        yield shard()


def _top(scored: DataFrame, k: int) -> DataFrame:
    """key, doc_id, score, rank of the k best of each key. A task brings k rows a key at most."""
    by = Window.partitionBy("key").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _searched(vectors: DataFrame, shared, k: int, plan: Plan, quick: bool) -> DataFrame:
    """key, doc_id, score: the best of each item in each task; tasks carry limits from shard to shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, total, length, limits = shared.value
        best = [Best(k, limits.get(key, 1)) for key in items.keys]
        asked = np.zeros(len(weight), np.int64)
        for shard in _shards(batches, weight, total, length, plan):
            for (ids, times), found in zip(items.items, best, strict=True):
                asked[ids] = times
                own = Best(k, 1) if quick else found
                shard.search(ids, times, asked, own, quick)
                if quick:
                    found.add(own.scores, own.docs)
                asked[ids] = 0
        rows = [(key, b) for key, b in zip(items.keys, best, strict=True) if len(b.docs)]
        if rows:
            keys = pa.array([key for key, b in rows for _ in range(len(b.docs))], pa.string())
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(np.concatenate([getattr(b, c) for _, b in rows])) for c in ("docs", "scores"))], ["key", "doc_id", "score"])

    return vectors.mapInArrow(run, "key string, doc_id long, score long")


def search(documents: DataFrame, items: DataFrame, k: int = 20, plan: Plan = Plan()) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, those with a score above 0; equal scores by doc_id.

    Each document is indexed, in shards of bounded size where it lies; only terms that items have get posting lists. A
    first run looks at the most promising blocks alone; its k-th best scores are limits, below which the second, exact
    run skips blocks. Nothing is shuffled but k rows an item and task.

    A null, empty or termless text has no terms and no ranks, as document and as item, and doesn't count. Rows that share
    a doc_id, or repeat, are documents of their own; a null doc_id comes first among equal scores. Items that repeat each
    have their rows. Empty tables give an empty result; other columns are not read. A text of any length is one row's work.
    """
    spark = documents.sparkSession
    listed = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").withColumn("key", F.sha2("text", 256))
    docs, out = keyed(documents), None
    for block in _blocks(listed, plan):
        vectors = staged(_vectors(docs, spark.sparkContext.broadcast(block.vocabulary)), "vectors")
        total, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(block.vocabulary), np.int64)
        for r in vectors.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # a number for each term of the block
            df[r.id] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        facts = (block, weight, total, length)
        first = _top(_searched(vectors, spark.sparkContext.broadcast((*facts, {})), k, plan, True), k)
        limits = {r.key: r.score for r in first.where(F.col("rank") == k).select("key", "score").collect()}  # a number for each item of the block
        found = _top(_searched(vectors, spark.sparkContext.broadcast((*facts, limits)), k, plan, False), k)
        out = found if out is None else out.unionAll(found)
    ranked = listed.select("item_id", "key").join(out, "key")
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), unkeyed(), "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    """Scores each document that has a term of the item, then ranks."""
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}'))"
    return f"""
WITH d AS (SELECT doc_id, {words} AS term FROM documents), q AS (SELECT item_id, {words} AS term FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id), t AS (SELECT count(*) AS docs, sum(n) AS terms FROM n),
f AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, t GROUP BY term, docs),
m AS (SELECT doc_id, CAST(75 + (25 * n * docs) // terms AS BIGINT) AS m FROM n, t),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS impact FROM f JOIN w USING (term) JOIN m USING (doc_id)),
s AS (SELECT item_id, doc_id, CAST(sum(impact * times) AS BIGINT) AS score FROM (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL) JOIN i USING (term) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20"""
