"""Repeated windows of a corpus, the ground that suffix-array and substring dedup share.

A text is a sequence of units (bytes or words); a window is a run of so many of them in one text. Rolling hashes of short
grams pick one trigger in each window, the smallest hash, so equal windows have equal triggers. Neighbouring windows with
the same trigger form a phrase; phrases overlap by a window less one unit, so each window lies whole in exactly one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from aerolith.llm.common import packed, parts, staged
from aerolith.llm.hashing import BASE, U64, WordHashes, mix, powers, signed

#: Units that are hashed together.
BLOCK = 1 << 19
#: Phrases of one trigger that are compared inside a task; more of them are compared window by window in a shuffle.
GROUP = 2000
#: Bits of a place within a phrase, and of a phrase's number of starts; bounds a window's length.
BITS = 16
#: A trigger with over a SHARE-th of all phrases is dealt out in pieces.
SHARE = 1000
LOW = (1 << BITS) - 1
#: What names a document: rows that share an id (null ones too) but not the text are documents of their own.
KEY = ["doc_id", "__text"]


class Prefix:
    """Polynomial prefix hashes of a sequence of unit hashes; hash of any run in constant time."""

    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, units: np.ndarray, which: int):
        n, base = len(units), BASE[which]
        up, down = self.tables.get(which, (np.zeros(0), np.zeros(0)))
        if len(up) <= n:
            size = max(n, BLOCK + (BLOCK >> 2))
            up, down = self.tables[which] = powers(base, size), powers(pow(base, -1, 1 << 64), size)
        self.down = down
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(units * up[:n], out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


@dataclass(frozen=True)
class Cut:
    """How a text becomes units. window: units of a window; gram: units of a trigger; words: units are words, not bytes."""

    window: int
    gram: int
    words: bool

    def __post_init__(self):
        if not 0 < self.gram <= self.window < 1 << BITS:
            raise ValueError(f"a window has up to {(1 << BITS) - 1} units, a trigger not more than a window")

    def units(self, text: bytes):
        return text.split() if self.words else text

    def joined(self, units) -> bytes:
        return b" ".join(units) if self.words else bytes(units)

    def hashes(self, units, known: WordHashes) -> np.ndarray:
        return known.of(units) if self.words else mix(np.arange(1, 257, dtype=U64))[np.frombuffer(units, np.uint8)]

    def keys(self, sequences: list, starts: list[int], known: WordHashes) -> np.ndarray:
        """The windows at 0 .. starts - 1 of each sequence as fixed-width strings: the bytes themselves, or 128-bit hashes of words."""
        width = self.window
        sizes = np.array([len(s) for s in sequences])
        first = np.cumsum(sizes) - sizes
        at = np.concatenate([f + np.arange(n) for f, n in zip(first, starts, strict=True)])
        if not self.words:
            flat = np.frombuffer(b"".join(sequences), np.uint8)
            return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, width)[at]).view(f"S{width}").ravel()
        u = np.concatenate([known.of(s) for s in sequences])
        both = np.stack([Prefix(u, 0).runs(at, at + width), Prefix(mix(u), 1).runs(at, at + width)], 1)
        return np.ascontiguousarray(both).view("S16").ravel()

    def settled(self, sequences: list, trigger: np.ndarray, place: np.ndarray, starts: np.ndarray, later: bool, known: WordHashes) -> np.ndarray:
        """For the windows of phrases in corpus order, one phrase after another: whether another has the same units; later: an earlier one."""
        keys = self.keys(sequences, starts.tolist(), known)
        _, first, inverse, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        return first[inverse] != np.arange(len(keys)) if later else count[inverse] > 1


def triggers(u: np.ndarray, sizes: np.ndarray, cut: Cut) -> tuple[np.ndarray, ...]:
    """For the phrases of some texts (unit hashes one after another): text, first start, starts, trigger's place, trigger and phrase hash."""
    n, span = len(u), cut.window - cut.gram + 1
    if n < cut.window:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U64),) * 2
    first, at = Prefix(u, 0), np.arange(n - cut.gram + 1)
    grams = first.runs(at, at + cut.gram)
    low = (grams & ~U64((1 << 24) - 1)) | at.astype(U64)  # ties: the leftmost
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    chosen = (low & U64((1 << 24) - 1)).astype(np.int64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(chosen)]
    whole = np.flatnonzero(np.arange(len(chosen)) + cut.window <= ends[text])
    if not len(whole):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U64),) * 2
    new = np.flatnonzero(np.r_[True, (np.diff(chosen[whole]) != 0) | (np.diff(text[whole]) != 0)])
    start, starts = whole[new], np.diff(np.r_[new, len(whole)])
    phrase = Prefix(mix(u), 1).runs(start, start + starts - 1 + cut.window) >> U64(16)
    return text[start], start, starts, chosen[start] - start, grams[chosen[start]], phrase


def _parse(batches: Iterator[pa.RecordBatch], cut: Cut) -> Iterator[tuple[np.ndarray, ...]]:
    """trigger, phrase, doc_id, __text, at of the phrases of some texts (doc_id, text, __text) at a time."""
    known = WordHashes()
    for batch in batches:
        for part in parts(batch, 1, BLOCK):
            ids, marks, units = part.column(0).to_numpy(), part.column(2).to_numpy(), [cut.units(t.as_buffer().to_pybytes()) for t in part.column(1)]
            sizes = np.array([len(x) for x in units])
            if sizes.max() > BLOCK:  # a very long text, in pieces that overlap by a window less one
                todo = [(np.array([i]), 0, [x]) for i, x in enumerate(units)]
                todo = [(i, a, [x[0][a : a + BLOCK + cut.window - 1]]) for i, _, x in todo for a in range(0, max(1, len(x[0]) - cut.window + 1), BLOCK)]
            else:
                todo = [(np.arange(len(ids)), 0, units)]
            for who, base, seqs in todo:
                n = np.array([len(x) for x in seqs])
                u = np.concatenate([cut.hashes(x, known) for x in seqs]) if cut.words else cut.hashes(b"".join(seqs), known)
                text, start, starts, place, trigger, phrase = triggers(u, n, cut)
                local = start - (np.cumsum(n) - n)[text] + base if len(text) else start
                yield signed(trigger), signed(phrase), ids[who[text]], marks[who[text]], (local << 2 * BITS) | (place << BITS) | (starts - 1)


def phrases(docs: DataFrame, cut: Cut) -> DataFrame:
    """trigger, phrase, doc_id, __text, at: a row for each phrase of each text. at: first start, trigger's place, starts - 1, the last two of BITS bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _parse(batches, cut):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["trigger", "phrase", *KEY, "at"])

    return docs.select("doc_id", "text", "__text").mapInArrow(run, "trigger long, phrase long, doc_id long, __text long, at long")


def frequent(docs: DataFrame, cut: Cut) -> DataFrame:
    """trigger, pieces: the triggers of more than a SHARE-th of all phrases, and in how many pieces each is dealt out so that none holds that many; 2 * SHARE rows at most.

    Tasks count a trigger where it has over half that share of the texts that are read together, so few rows are shuffled;
    a frequent one has that share somewhere, and what isn't counted of it is below half a SHARE-th.
    """
    share = SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trigger, *_ in _parse(batches, cut):
            found, count = np.unique(trigger, return_counts=True)
            often = np.flatnonzero((count > 1) & (count * 2 * share > len(trigger)))
            yield pa.RecordBatch.from_arrays([pa.array([*found[often].tolist(), None], pa.int64()), pa.array(np.r_[count[often], len(trigger)])], ["trigger", "c"])

    counted = staged(docs.select("doc_id", "text", "__text").mapInArrow(run, "trigger long, c long").groupBy("trigger").agg(F.sum("c").alias("c")), "frequent")
    total = (counted.where("trigger IS NULL").first() or {"c": 1})["c"] or 1
    often = counted.where(F.col("trigger").isNotNull() & (F.col("c") * 2 * share > total))
    return often.select("trigger", (F.ceil(F.col("c") * F.lit(share / total)) + 1).alias("pieces"))


#: Kinds of rows that met() finds.
WHOLE, MIXED, PIECE = 0, 1, 2


def met(parse: DataFrame, often: DataFrame, later: bool) -> DataFrame:
    """kind, trigger, phrase, doc_id, __text, at, size: what phrases that meet by their trigger say of each other.

    WHOLE: phrases that occur elsewhere too (later: earlier); only doc_id, __text and at are given. MIXED: the first occurrence of each
    phrase of a trigger that has several, and how many (those over GROUP are not told apart). PIECE: the first occurrence, in each piece, of the phrases of a frequent trigger.
    Phrases are shuffled once, in order; a task holds no more than GROUP of them beside a batch.
    """
    group = GROUP
    names = ["kind", "trigger", "phrase", *KEY, "at", "size"]
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64(*KEY, "at"), "pieces")).otherwise(0)
    dealt = parse.join(F.broadcast(often), "trigger", "left").select("trigger", "phrase", *KEY, "at", "pieces")
    dealt = dealt.repartition("trigger", piece).sortWithinPartitions("trigger", "phrase", *KEY, "at")

    def rows(kind: int, doc, mark, at, trigger=None, phrase=None, size=None) -> pa.RecordBatch:
        n = len(doc)
        more = [pa.nulls(n, pa.int64()) if x is None else pa.array(x) for x in (trigger, phrase, size)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *more[:2], pa.array(doc), pa.array(mark), pa.array(at), more[2]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5  # the last trigger's phrases so far, each with its first occurrence
        before, alone, wide = None, False, False  # the row before; whether it is the first of its phrase; whether its trigger has over GROUP phrases
        for batch in batches:
            now = [batch.column(k).to_numpy() for k in range(5)]
            trigger, phrase, *place = now
            if not len(trigger):
                continue
            same = np.r_[before is not None and before[:2] == (trigger[0], phrase[0]), (trigger[1:] == trigger[:-1]) & (phrase[1:] == phrase[:-1])]
            again = same.copy()
            if not later:
                again[:-1] |= same[1:]
                if same[0] and alone:
                    yield rows(WHOLE, *(np.array([x]) for x in before[2:]))
            yield rows(WHOLE, *(x[again] for x in place))
            often = np.r_[np.zeros(len(held[0]), bool), batch.column(5).is_valid().to_numpy(zero_copy_only=False)[~same]]
            words = [np.r_[x, y[~same]] for x, y in zip(held, now, strict=True)]
            new = np.flatnonzero(np.r_[len(words[0]) > 0, np.diff(words[0]) != 0][: len(words[0])])
            size = np.repeat(np.diff(np.r_[new, len(words[0])]), np.diff(np.r_[new, len(words[0])]))
            if wide:
                size[words[0] == before[0]] = group + 1
            last = words[0] == trigger[-1]
            wide = bool(last.sum() > group or wide and before[0] == trigger[-1]) and batch.column(5)[-1].as_py() is None
            if wide:
                size[last] = group + 1
            known = ~often & (size > 1) & (~last | wide)
            for kind, use in ((MIXED, known), (PIECE, often)):
                t, p, *at = (x[use] for x in words)
                yield rows(kind, *at, t, p, size[use])
            held = [x[last & ~often & (not wide)] for x in words]
            before, alone = tuple(int(x[-1]) for x in now), not same[-1]
        if len(held[0]) > 1:
            t, p, *at = held
            yield rows(MIXED, *at, t, p, np.full(len(t), len(t)))

    return dealt.mapInArrow(run, "kind byte, trigger long, phrase long, doc_id long, __text long, at long, size long")


def _open(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    code = zstandard.ZstdDecompressor()
    return (code.decompress(z.as_buffer().to_pybytes()) for z in batch.column(column))


def contexts(texts: DataFrame, chosen: DataFrame, cut: Cut, then=None, schema: str = "trigger long, phrase long, doc_id long, at long, units binary, __text long") -> DataFrame:
    """chosen (trigger, phrase, doc_id, at, __text) with the units of each phrase, joined, or what then makes of such batches in the same task. texts: packed()."""
    wanted = chosen.groupBy(*KEY).agg(F.collect_list(F.struct("trigger", "phrase", "at")).alias("ps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1, BLOCK // 2):
                cols: list[list] = [[], [], [], [], [], []]
                for doc, text, ps, mark in zip(part.column(0).to_pylist(), _open(part, 1), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    units = cut.units(text)
                    for p in ps:
                        lo, n = p["at"] >> 2 * BITS, (p["at"] & LOW) + 1
                        if lo + n - 1 + cut.window <= len(units):
                            for c, v in zip(cols, (p["trigger"], p["phrase"], doc, p["at"], cut.joined(units[lo : lo + n - 1 + cut.window]), mark), strict=True):
                                c.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.int64())], ["trigger", "phrase", "doc_id", "at", "units", "__text"])

    return texts.join(wanted, KEY).select("doc_id", "z", "ps", "__text").mapInArrow((lambda batches: then(run(batches))) if then else run, schema)


def _inside(cut: Cut, later: bool):
    """Sorted phrases to the starts (doc_id, __text, lo, n) of windows that other phrases have too; later: that an earlier one has."""

    def settle(rows: pa.Table, known: WordHashes) -> pa.RecordBatch:
        trigger, phrase, doc, at, mark = (rows.column(k).to_numpy() for k in (0, 1, 2, 3, 5))
        again = np.r_[False, (np.diff(trigger) == 0) & (np.diff(phrase) == 0)]  # a document that was read twice
        pick = np.flatnonzero(~again)
        pick = pick[np.lexsort((at[pick], mark[pick], doc[pick]))]
        units = rows.column(4).take(pa.array(pick)).to_pylist()
        starts, place = (at[pick] & LOW) + 1, at[pick] >> BITS & LOW
        hit = cut.settled([cut.units(x) for x in units], trigger[pick], place, starts, later, known)
        row = np.repeat(np.arange(len(pick)), starts)
        pos = (at[pick] >> 2 * BITS)[row] + np.arange(len(hit)) - (np.cumsum(starts) - starts)[row]
        hit = np.flatnonzero(hit)
        if not len(hit):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, [*KEY, "lo", "n"])
        new = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (np.diff(row[hit]) != 0)])
        which = pick[row[hit[new]]]
        return pa.RecordBatch.from_arrays([pa.array(doc[which]), pa.array(mark[which]), pa.array(pos[hit[new]]), pa.array(np.diff(np.r_[new, len(hit)]))], [*KEY, "lo", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = WordHashes(), None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            trigger = rows.column(0).to_numpy()
            done = int(np.searchsorted(trigger, trigger[-1])) if len(trigger) else 0
            at = 0
            while at < done:  # some thousand phrases at a time, never a trigger in two
                end = done if done - at <= 2 * GROUP else int(np.searchsorted(trigger, trigger[at + GROUP], "right"))
                yield settle(rows.slice(at, min(end, done) - at).combine_chunks(), known)
                at = min(end, done)
            held = rows.slice(done)
        if held is not None and held.num_rows:
            yield settle(held.combine_chunks(), known)

    return run


def _windows(cut: Cut):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                at, units = part.column(3).to_numpy(), part.column(4).to_pylist()
                starts = (at & LOW) + 1
                keys = cut.keys([cut.units(x) for x in units], starts.tolist(), known)
                row = np.repeat(np.arange(len(at)), starts)
                pos = (at >> 2 * BITS)[row] + np.arange(len(keys)) - (np.cumsum(starts) - starts)[row]
                width = keys.dtype.itemsize
                raw = keys.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[i * width : i * width + width] for i in range(len(keys))], pa.binary()), pa.array(part.column(2).to_numpy()[row]), pa.array(part.column(5).to_numpy()[row]), pa.array(pos)], ["key", *KEY, "lo"])

    return run


def repeated(docs: DataFrame, texts: DataFrame, cut: Cut, later: bool) -> DataFrame:
    """doc_id, __text, spans (array of structs lo, n: runs of window starts) of the windows that start elsewhere too; later: that start earlier.

    docs: doc_id, text and __text, each document once; texts: the same, packed(). All occurrences of a phrase share its fate, so phrases (one row an occurrence) are
    shuffled once, by trigger and in order, which tells those that occur twice; only the first occurrences of phrases that
    differ though they share a trigger are looked into. A frequent trigger is dealt out in pieces, of which each tells its
    own; the first occurrences of all pieces are put together after that. Triggers with over GROUP phrases are compared by a
    shuffle of their windows instead of in one task. Nothing is written after the parse, so that a plan that joins the spans
    with texts shuffles these once for both joins.
    """
    often = frequent(docs, cut)
    found = staged(met(phrases(docs, cut), often, later), "found")
    whole = found.where(F.col("kind") == WHOLE).select(*KEY, "at")
    mixed = found.where(F.col("kind") == MIXED).select("trigger", "phrase", *KEY, "at", "size")
    if not often.isEmpty():
        place = F.struct(*KEY, "at")
        firsts = found.where(F.col("kind") == PIECE).select("trigger", "phrase", *KEY, "at")
        words = staged(firsts.groupBy("trigger", "phrase").agg(F.min(place).alias("first"), F.max(place).alias("last")), "pieces")
        several = firsts.join(words.where("first <> last"), ["trigger", "phrase"])  # a row a piece at most
        if later:
            several = several.where(place != F.col("first"))
        sizes = words.groupBy("trigger").agg(F.count("*").alias("size")).where("size > 1")  # frequent triggers only
        whole = whole.unionAll(several.select(*KEY, "at"))
        mixed = mixed.unionAll(words.join(F.broadcast(sizes), "trigger").select("trigger", "phrase", "first.doc_id", "first.__text", "first.at", "size"))
    whole = whole.select(*KEY, F.shiftright("at", 2 * BITS).alias("lo"), (F.col("at").bitwiseAND(LOW) + 1).alias("n"))
    few = contexts(texts, mixed.where(F.col("size") <= GROUP), cut).repartition("trigger").sortWithinPartitions("trigger", "phrase")
    within = few.mapInArrow(_inside(cut, later), "doc_id long, __text long, lo long, n long")
    spans = whole.unionAll(within)
    many = mixed.where(F.col("size") > GROUP)
    if not many.isEmpty():
        windows = contexts(texts, many, cut, _windows(cut), "key binary, doc_id long, __text long, lo long")
        spot = F.struct(*KEY, "lo")
        known = windows.groupBy("key").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).where("first <> last")
        apart = windows.join(known, "key")
        if later:
            apart = apart.where(spot != F.col("first"))
        spans = spans.unionAll(apart.select(*KEY, "lo", F.lit(1).cast("long").alias("n")))
    return spans.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "n")).alias("spans"))


def covered(spans, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of units that the windows cover, within size units."""
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo = np.array([s["lo"] for s in spans])
    hi = np.minimum(lo + np.array([s["n"] for s in spans]) - 1 + window, size)
    lo, hi = lo[lo < size], hi[lo < size]
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[1:] > hi[:-1]]
    return lo[new], hi[np.r_[np.flatnonzero(new)[1:] - 1, len(hi) - 1]]


def _told(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with __text, a hash of the text where ids are shared, else 0; and each document once: equal rows that share an id are one. Texts are shuffled for it only if there are such rows."""
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.withColumn("__text", F.lit(0).cast("long"))
        return docs, docs
    docs = docs.withColumn("__text", F.xxhash64("text"))
    if docs.groupBy(*KEY).count().where("count > 1").isEmpty():
        return docs, docs
    return docs, staged(docs.select("doc_id", "text", "__text").dropDuplicates(KEY), "once")


def stripped(docs: DataFrame, cut: Cut, later: bool, row, schema: str, *more: str) -> DataFrame:
    """row(units, run starts, run ends) as the columns of schema after doc_id, for each row of docs; then other columns if named."""
    docs, once = _told(docs)
    texts = packed(docs, "__text", *more)
    spans = repeated(once, texts if once is docs and not more else packed(once, "__text"), cut, later)
    texts = texts.join(spans, KEY, "left").select("doc_id", "z", "spans", *more)
    own = _parse_datatype_string(schema)
    whole = T.StructType([texts.schema[0], *own, *texts.schema[3:]])
    types = [f.type for f in to_arrow_schema(own)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1, BLOCK):
                rows = []
                for text, found in zip(_open(part, 1), part.column(2).to_pylist(), strict=True):
                    units = cut.units(text)
                    rows.append(row(units, *covered(found, cut.window, len(units))))
                made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made, *part.columns[3:]], whole.names)

    return texts.mapInArrow(run, whole)
