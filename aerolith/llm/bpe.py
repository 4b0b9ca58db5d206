"""Byte-level BPE by merge replay over the corpus' words, with an inverted index from pair to word positions."""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.llm.common import least_count, parts, staged, table, texts

#: Bytes of texts that are encoded together.
BLOCK = 1 << 22
#: Larger texts are encoded some matches of the pattern at a time.
BLOCK_CHARS = 1 << 20
#: Words and pieces that a task keeps with their ids.
CACHE_WORDS = 300_000
#: Words whose ids all tasks are given, the most frequent ones.
LISTED = 1 << 18


class Replay:
    """Merges by rank over all words of a block at once.

    The words lie one after another in flat arrays with links to their neighbours. index[rank] holds the positions
    whose pair has that rank; ranks are taken from a heap, smallest first, and a merge touches two pairs at most. A
    merge may make a pair of a smaller rank; the word then waits until that pair is done, as each word alone would.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)])
        self.first = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        #: Rank of a pair of ids, as left << 32 | right; -1: it never merges.
        self.pairs: dict[int, int] = {}

    def _index(self, raw: np.ndarray, ends: np.ndarray) -> dict[int, list[int]]:
        """Positions by the rank of the pair that starts there, ascending; none spans two words."""
        rank = self.first[raw[:-1].astype(np.int64) * 256 + raw[1:]] if len(raw) else np.zeros(0, np.int64)
        rank[ends[:-1] - 1] = -1
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        if not len(at):
            return {}
        cuts = np.flatnonzero(np.diff(rank[at])) + 1
        return {int(rank[x[0]]): x.tolist() for x in np.split(at, cuts)}

    def encode(self, words: list[bytes]) -> list[list[int]]:
        out: list = [[self.ranks[w]] if w in self.ranks else None for w in words]
        todo = [i for i, ids in enumerate(out) if ids is None]
        raw = np.frombuffer(b"".join([words[i] for i in todo]), np.uint8)
        sizes = np.array([len(words[i]) for i in todo], np.int64)
        ends = np.cumsum(sizes)
        ids = self.single[raw].tolist()
        nxt, prv = np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)
        nxt[ends - 1] = prv[ends - sizes] = -1
        nxt, prv = nxt.tolist(), prv.tolist()
        owner = np.repeat(np.arange(len(todo)), sizes).tolist()
        index = self._index(raw, ends)
        heap = list(index)
        heapq.heapify(heap)
        pairs, bytes_of, rank_of = self.pairs, self.bytes_of, self.ranks.get
        if len(pairs) > 1_000_000:
            pairs.clear()
        while heap:
            now = heapq.heappop(heap)
            waits, later = set(), []
            token = bytes_of[now]
            for p in sorted(index.pop(now)):
                q = nxt[p]
                if q < 0 or (a := ids[p]) < 0 or len(bytes_of[a]) + len(bytes_of[b := ids[q]]) != len(token) or bytes_of[a] + bytes_of[b] != token:
                    continue  # the pair has gone
                if waits and owner[p] in waits:
                    later.append(p)
                    continue
                ids[p], ids[q] = now, -1
                r = nxt[p] = nxt[q]
                nxt[q] = -1
                if r >= 0:
                    prv[r] = p
                    code = now << 32 | ids[r]
                    if (new := pairs.get(code)) is None:
                        new = pairs[code] = rank_of(token + bytes_of[ids[r]], -1)
                    if new >= 0:
                        if (at := index.get(new)) is None:
                            index[new] = [p]
                            heapq.heappush(heap, new)
                        else:
                            at.append(p)
                        if new < now:
                            waits.add(owner[p])
                if (left := prv[p]) >= 0:
                    code = ids[left] << 32 | now
                    if (new := pairs.get(code)) is None:
                        new = pairs[code] = rank_of(bytes_of[ids[left]] + token, -1)
                    if new >= 0:
                        if (at := index.get(new)) is None:
                            index[new] = [left]
                            heapq.heappush(heap, new)
                        else:
                            at.append(left)
                        if new < now:
                            waits.add(owner[p])
            if later:
                if now not in index:
                    index[now] = []
                    heapq.heappush(heap, now)
                index[now] += later
        left = [i for i in ids if i >= 0]
        at = 0
        counts = np.add.reduceat(np.array(ids) >= 0, ends - sizes).tolist() if todo else []
        for i, n in zip(todo, counts, strict=True):
            out[i] = left[at : at + n]
            at += n
        return out


def load_ranks(lines: Iterator[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers, and back to bytes.

    known has the ids of words (matches of the pattern) of the whole corpus; words that are too rare for it are replayed
    block by block. at_spaces: no match of the pattern reaches over a space that comes after something other than white
    space, so texts are cut there and each distinct piece of a block is looked at once.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, at_spaces: bool = False, known: dict[str, bytes] | None = None):
        import regex

        self.find, self.replay, self.at_spaces, self.known = regex.compile(pattern), Replay(ranks), at_spaces, known or {}
        self.more: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.of = [self.replay.bytes_of.get(i, b"") for i in range(max(self.replay.bytes_of) + 1)]

    def cut(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pieces of texts, the number of each piece among them, pieces of each text. A text where cuts aren't safe is one piece."""
        n = len(texts)
        if not self.at_spaces:
            return texts.to_pylist(), np.arange(n), np.ones(n, np.int64)
        lists = pc.split_pattern(texts, " ")
        coded, start = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
        words, index, start = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), start - start[0]
        bare = np.array([not w or w[-1].isspace() for w in words], bool)[index]  # not to be cut after
        bare[start[1:] - 1] = False
        whole = np.logical_or.reduceat(bare, start[:-1]) if n else np.zeros(0, bool)
        first = [texts[i].as_py() if w else words[index[at]] for i, (w, at) in enumerate(zip(whole.tolist(), start[:-1].tolist(), strict=True))]
        index[start[:-1]] = np.arange(n) + len(words)  # a text's first piece has no space before it
        sizes = np.where(whole, 1, np.diff(start))
        keep = ~np.repeat(whole, np.diff(start))
        keep[start[:-1]] = True
        return [" " + w for w in words] + first, index[keep], sizes

    def matches(self, piece: str) -> Iterator[list[str]]:
        """The matches in a piece, some at a time."""
        if len(piece) <= BLOCK_CHARS:
            yield self.find.findall(piece)
        else:
            found = (m.group() for m in self.find.finditer(piece))
            while part := list(islice(found, BLOCK_CHARS // 4)):
                yield part

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known and w not in self.more]
        if len(self.more) > CACHE_WORDS:
            self.more = {w: self.more[w] for w in words if w in self.more}
        coded = self.replay.encode([w.encode() for w in new])
        self.more.update(zip(new, (array("I", ids).tobytes() for ids in coded), strict=True))

    def coded(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece."""
        short = [p for p in pieces if len(p) < 200]
        if len(self.pieces) > CACHE_WORDS:
            self.pieces = {p: self.pieces[p] for p in short if p in self.pieces}
        new = {p: self.find.findall(p) for p in short if p not in self.pieces}
        self._learn(set().union(*new.values()))
        known, more = self.known, self.more
        for p, ms in new.items():
            self.pieces[p] = b"".join([known[m] if m in known else more[m] for m in ms])
        return [self.pieces[p] if len(p) < 200 else self._long(p) for p in pieces]

    def _long(self, piece: str) -> bytes:
        out = []
        for ms in self.matches(piece):
            self._learn(set(ms))
            out += [self.known[m] if m in self.known else self.more[m] for m in ms]
        return b"".join(out)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each text ends."""
        pieces, index, count = self.cut(texts)
        found = self.coded(pieces)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, first = np.frombuffer(b"".join(found), np.uint32), np.cumsum(sizes) - sizes
        n = sizes[index]
        ends = np.cumsum(n)
        ids = pool[np.repeat(first[index] - (ends - n), n) + np.arange(n.sum())]
        return ids, np.r_[0, ends][np.cumsum(count)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.of.__getitem__, ids.tolist()))


def _words(docs: DataFrame, load) -> DataFrame:
    """word, c: the matches of all texts and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts, seen = load(), Counter(), {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
            counts.clear()
            return out

        for batch in batches:
            for part in parts(batch, 1, BLOCK):
                pieces, index, _ = encoder.cut(part.column(1))
                for piece, c in zip(pieces, np.bincount(index, minlength=len(pieces)).tolist(), strict=True):
                    if c:
                        if (ms := seen.get(piece)) is None:
                            if len(piece) >= 200:
                                for ms in encoder.matches(piece):
                                    counts.update(ms)
                                continue
                            ms = seen[piece] = encoder.find.findall(piece)
                        for m in ms:
                            counts[m] += c
                if len(seen) > CACHE_WORDS:
                    seen.clear()
                if len(counts) > CACHE_WORDS:
                    yield flush()
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _per_text(docs: DataFrame, ranks_path: str, pattern: str, at_spaces: bool, schema: T.StructType, row) -> DataFrame:
    """row(ids, encoder) as columns after doc_id, for each row of docs."""
    docs, context = texts(docs), docs.sparkSession.sparkContext
    context.addFile(ranks_path)
    name = ranks_path.rsplit("/", 1)[-1]
    types = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string() for f in schema.fields[1:]]

    def load(known: dict[str, bytes] | None = None) -> Encoder:
        with open(SparkFiles.get(name), "rb") as f:
            return Encoder(load_ranks(f), pattern, at_spaces, known)

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load()
        for batch in batches:
            coded = encoder.replay.encode([w.as_buffer().to_pybytes() for w in batch.column(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([array("I", ids).tobytes() for ids in coded], pa.binary())], ["word", "ids"])

    words = staged(_words(docs, load), "words")
    listed = words.where(F.col("c") >= least_count(words, LISTED)).select("word").repartition("word").mapInArrow(replayed, "word string, ids binary").toArrow()
    shared = context.broadcast(listed)  # at most LISTED words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(dict(zip(shared.value.column(0).to_pylist(), shared.value.column(1).to_pylist(), strict=True)))
        for batch in batches:
            for part in parts(batch, 1, BLOCK):
                ids, ends = encoder.encode(part.column(1))
                rows = [row(ids[a:b], encoder) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], schema.names)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, at_spaces: bool = False) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) for each row of docs.

    The words (matches of the pattern) of the corpus are counted, and the most frequent of them, LISTED at most, are
    merged by rank once for the whole corpus, in as many places as Spark deals them to; each of those has one inverted
    index. Tasks that encode texts get their ids, and replay the words that are left for a block of texts at a time.
    at_spaces may be set if no match reaches over a space that comes after something other than white space.

    A null text is empty and has no ids. An empty table gives an empty one. Each row is encoded on its own, repeated rows alike, also where rows share a
    doc_id or have none. A very long text is encoded piece by piece, so it needs memory for its ids but not for all its
    words. Other columns are not read.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])
    return _per_text(docs, ranks_path, pattern, at_spaces, schema, lambda ids, encoder: (ids.tobytes(),))


def decode(coded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and text for doc_id and ids as encode() gives them."""
    context = coded.sparkSession.sparkContext
    context.addFile(ranks_path)
    name = ranks_path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(SparkFiles.get(name), "rb") as f:
            of = {i: b for b, i in load_ranks(f).items()}
        for batch in batches:
            said = [b"".join([of[i] for i in memoryview(ids.as_buffer()).cast("I")]).decode() for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, ranks_path: str, pattern: str, at_spaces: bool = False, ids: bool = False) -> DataFrame:
    """n_tokens, the digest of the ids and the digest of what they decode to, for each row of docs; the ids too if asked for.

    Nulls, empty, repeated and very long texts and other columns as in encode().
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if ids:
        schema.add("ids", T.BinaryType())

    def row(found: np.ndarray, encoder: Encoder) -> tuple:
        coded = found.tobytes()
        return len(found), hashlib.sha256(coded).hexdigest(), hashlib.sha256(encoder.decode(found)).hexdigest(), coded

    return _per_text(docs, ranks_path, pattern, at_spaces, schema, row)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, at_spaces=True)
