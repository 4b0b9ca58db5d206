"""Benchmark decontamination: pieces that any copy keeps propose places, an exact edit distance decides.

Every place that the pieces leave is aligned, so no copy within the allowed edits is lost, wherever in a text it starts and
however long its item is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import keyed, parts, staged, table, unkeyed
from aerolith.llm.hashing import STEP, U64


@dataclass(frozen=True)
class Plan:
    #: Edits that a copy may have, in per cent of the item's bytes.
    percent: int = 10
    #: Items of fewer bytes are matched exactly.
    least: int = 16
    #: Pieces that an item is cut into beyond its edits; so many pieces are whole in any copy.
    whole: int = 4
    #: Bytes of items that are broadcast at once; more items take more passes over the documents.
    block: int = 4 << 20

    def edits(self, item: bytes) -> int:
        return len(item) * self.percent // 100 if len(item) >= self.least else 0


def plain(text: str) -> bytes:
    """ASCII lower case, words joined by a space."""
    return b" ".join(text.encode("utf-8", "replace").lower().split())


def grams(flat: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each q of sizes (8 at most), ascending: q, the q bytes that start at each place as a number."""
    runs = {1: flat.astype(U64)}
    for k in (1, 2, 4):
        x = runs[k]
        runs[2 * k] = (x[:-k] << U64(8 * k)) | x[k:] if len(x) > k else x[:0]
    for q in sorted(sizes):
        code, done = None, 0
        for k in (8, 4, 2, 1):
            if q & k:
                x = runs[k][done:]
                code = x if code is None else (code[: len(x)] << U64(8 * k)) | x[: len(code)]
                done += k
        yield q, code


def slots(codes: np.ndarray) -> np.ndarray:
    """20 bits of each code."""
    return (codes * STEP >> U64(44)).astype(np.int64)


def distance(item: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """The least edits between item and any part of text, and where that part ends; None if over most. Bit-parallel, on whole integers."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (m, 0)
    for at, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
        ph = (ph << 1) & full
        pv = ((mh << 1) & full) | (~(xv | ph) & full)
        mv = ph & xv
        if score < best[0]:
            best = (score, at + 1)
    return best if best[0] <= most else None


def _edited(item: bytes, edits: int, rng: np.random.Generator) -> bytes:
    s = bytearray(item)
    for _ in range(edits):
        at, kind = int(rng.integers(0, max(1, len(s)))), int(rng.integers(0, 3))
        c = int(rng.choice(np.frombuffer(item, np.uint8)))
        if kind == 0:
            s[at : at + 1] = bytes([c])
        elif kind == 1:
            s[at:at] = bytes([c])
        else:
            del s[at : at + 1]
    return bytes(s)


@dataclass
class Pieces:
    """Pieces of q bytes of all items cut that fine. Edits spoil a piece each at most, so plan.whole stay whole in a copy."""

    q: int
    slots: np.ndarray
    codes: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    edits: np.ndarray
    whole: np.ndarray

    def near(self, coded: np.ndarray) -> np.ndarray:
        """(item, low, high): ranges of starts where whole pieces of an item lie as a copy would have them.

        Within a copy the starts that its pieces point to differ by as many bytes as it has edits, at most; of two grids
        of twice that width one has them all in a cell.
        """
        at = np.flatnonzero(self.slots[slots(coded)])
        left, right = np.searchsorted(self.codes, coded[at]), np.searchsorted(self.codes, coded[at], "right")
        count = right - left
        pick = np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item, offset, edits, whole = self.item[pick], self.offset[pick], self.edits[pick], self.whole[pick]
        start, wide, out = np.repeat(at, count) - offset, 2 * edits + 2, [np.zeros((0, 3), np.int64)]
        for phase in (0, 1) if len(pick) else ():
            cell = (start + phase * (edits + 1)) // wide
            order = np.lexsort((offset, cell, item))
            keys = np.stack([item, cell, offset], 1)[order]
            differs = keys[1:] != keys[:-1]
            new = np.flatnonzero(np.r_[True, differs[:, :2].any(1)])
            pieces = np.add.reduceat(np.r_[True, differs.any(1)].astype(np.int64), new)
            full = new[pieces >= whole[order][new]]
            low = keys[full, 1] * wide[order][full] - phase * (edits[order][full] + 1)
            out.append(np.stack([keys[full, 0], low - edits[order][full] - 1, low + wide[order][full] + edits[order][full] + 1], 1))
        return np.concatenate(out)


def pieces(items: list[tuple[int, bytes]], plan: Plan) -> list[Pieces]:
    rows: dict[int, list[tuple]] = {}
    for i, (_, s) in enumerate(items):
        edits, whole = plan.edits(s), plan.whole if len(s) >= plan.least else 1
        q = min(8, len(s) // (edits + whole))
        for j in range(edits + whole):
            rows.setdefault(q, []).append((s[j * q : j * q + q], i, j * q, edits, whole))
    out = []
    for q, found in sorted(rows.items()):
        codes = next(grams(np.frombuffer(b"".join(x[0] for x in found), np.uint8), [q]))[1][::q]
        order = np.argsort(codes, kind="stable")
        columns = [np.array([x[k] for x in found], np.int64)[order] for k in range(1, 5)]
        used = np.zeros(1 << 20, bool)
        used[slots(codes)] = True
        out.append(Pieces(q, used, codes[order], *columns))
    return out


def _blocks(benchmark: DataFrame, plan: Plan) -> Iterator:
    """Broadcast tables of the items, plan.block bytes at a time."""
    spark = benchmark.sparkSession
    listed = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND text <> ''")
    total = listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // plan.block))
    if blocks > 1:
        listed = staged(listed, "items")
    for b in range(blocks):
        some = listed.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        items = [(r.item_id, s) for r in sorted(some, key=lambda r: (r.text, r.item_id or 0)) if (s := plain(r.text))]
        yield spark.sparkContext.broadcast((items, pieces(items, plan)))


def _found(texts: list[str], items: list[tuple[int, bytes]], cut: list[Pieces], plan: Plan) -> list[tuple[int, int | None, int, int, int]]:
    """(number of the text, item_id, edits, item bytes, start) of the copies in texts: the best in each stretch that may hold some."""
    strings = [plain(t) for t in texts]
    flat = np.frombuffer(b"\0".join(strings) + b"\0" * 8, np.uint8)
    begin = np.cumsum([0, *(len(s) + 1 for s in strings[:-1])])
    by_q = {c.q: c for c in cut}
    ranges = np.concatenate([by_q[q].near(coded) for q, coded in grams(flat, list(by_q))])
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))].tolist()
    rows, k = [], 0
    while k < len(ranges):
        n, low, high = ranges[k]
        item_id, item = items[n]
        edits = plan.edits(item)
        k += 1
        while k < len(ranges) and ranges[k][0] == n and ranges[k][1] <= high + len(item) + edits:  # looked at once where they overlap
            high = max(high, ranges[k][2])
            k += 1
        end = high + len(item) + edits
        for d in range(max(0, int(np.searchsorted(begin, low, "right")) - 1), int(np.searchsorted(begin, end, "right"))):
            a = max(0, low - int(begin[d]))
            part = strings[d][a : max(0, end - int(begin[d]))]
            if not edits:
                at = part.find(item)
                best = (0, at + len(item)) if at >= 0 else None
            else:
                best = distance(item, part, edits) if len(part) >= len(item) - edits else None
            if best:
                rows.append((d, item_id, best[0], len(item), max(0, a + best[1] - len(item))))
    return rows


def matches(documents: DataFrame, benchmark: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, item_id, edits, item_bytes, start (byte in the text, lower-cased and with single spaces): the best match of each pair.

    A pair matches if some stretch of the document is within plan.percent of the item's bytes in edits. Cutting an item
    into more pieces than it may have edits leaves some pieces whole in any copy, so places without them, in the right
    order of distances, drop out at no loss. All that are left are aligned exactly, whatever stands before and after
    them. Items of fewer than plan.least bytes have to be there as they are; null and empty ones are left out. Null and empty texts match
    nothing; repeated rows and rows that share a doc_id give one row for each pair; a null item_id or doc_id stays null.
    Of places with as few edits the first counts; two items that match at one place are two rows. A text of any length is
    read whole in one task. Empty tables give an empty one. Other columns are not read. Items go to the tasks in blocks of plan.block bytes, documents pass once for each block,
    and nothing is shuffled but the matches.
    """
    docs, out = keyed(documents), None
    for shared in _blocks(benchmark, plan):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, cut = shared.value
            for batch in batches:
                for part in parts(batch, 1, 1 << 20) if items else ():
                    rows = _found(part.column(1).to_pylist(), items, cut, plan)
                    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
                    who = part.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                    yield pa.RecordBatch.from_arrays([who, *(pa.array([r[j + 1] for r in rows], t) for j, t in enumerate(types))], ["doc_id", "item_id", "edits", "item_bytes", "start"])

        found = docs.mapInArrow(run, "doc_id long, item_id long, edits int, item_bytes int, start long")
        out = found if out is None else out.unionAll(found)
    best = F.min(F.struct("edits", "start", "item_bytes")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select(unkeyed(), "item_id", "m.edits", "m.item_bytes", "m.start")


def clean(documents: DataFrame, benchmark: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows of documents that match no item, all columns as they are. Each row is judged by its own text: no shuffle."""
    at = documents.columns.index("text")
    for shared in _blocks(benchmark, plan):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, cut = shared.value
            for batch in batches:
                for part in parts(batch, at, 1 << 20) if items else [batch]:
                    texts = [t or "" for t in part.column(at).to_pylist()]
                    bad = {r[0] for r in _found(texts, items, cut, plan)} if items else set()
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents


def query(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
