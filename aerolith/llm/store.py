"""Token ids in a content-addressed store: chunks cut by rolling hashes, document recipes, Merkle manifests.

Files below the store's path, all Parquet:
  blocks/kind=1   a row for each distinct chunk: digest, n (ids), body (zstd of its ids, little-endian, unsigned 16 or 32 bits)
  recipes         a row for each document in ascending doc_id order: start, n_tokens, root, and its chunks' digests and sizes
  manifest        a row for each part of the recipes: what it holds, its Merkle root
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm.common import keyed, new_path, parts, table, unkeyed

DIGEST = 16
#: Ids that a rolling hash covers; one position in MEAN is a cut; a longer chunk is cut at each MOST ids.
ROLL, MEAN, MOST = 8, 512, 8192
CACHE_WORDS = 600_000
#: Bytes of text that are encoded together.
BLOCK = 1 << 21
#: Leaves below a Merkle node.
FAN = 1024


#: Schemas of the files; a store of no documents has no files to infer them from.
BLOCKS = "digest binary, doc_id long, n long, body binary, copies long, kind int"
RECIPES = "doc_id long, copy long, n_tokens long, root binary, chunks array<binary>, sizes array<long>, part int"
MANIFEST = "part int, root string, n_tokens long, documents long, low long, high long"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


#: A letter or digit and a mark: a space between them changes no pre-token and makes words with and without a mark one word.
BEFORE_MARK = r"([a-z0-9])([.,;:!?])"


class WordEncoder:
    """Ids of whole texts from ids of their words; right where white space always ends a pre-token and is no part of one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16

    def _learn(self, words: list[str]) -> None:
        """Lower-case ASCII letters are one pre-token as they are, so the model alone is asked; other words go the whole way."""
        model, other = self.tokenizer.model, []
        for w in words:
            if w.isascii() and w.isalpha() and w.islower():
                self.known[w] = array("I", [t.id for t in model.tokenize(w)]).tobytes()
            else:
                other.append(w)
        coded = self.tokenizer.encode_batch_fast(other, add_special_tokens=False)
        self.known.update(zip(other, (array("I", x.ids).tobytes() for x in coded), strict=True))

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end_id after each, and where each text ends."""
        marked = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=BEFORE_MARK, replacement=r"\1 \2")
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, marked))  # <| may start a special token
        coded = lists.flatten().dictionary_encode()
        words, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.known) > CACHE_WORDS:
            self.known = {w: self.known[w] for w in words if w in self.known}
        found = list(map(self.known.get, words))
        new = [k for k, x in enumerate(found) if x is None]
        self._learn([words[k] for k in new])
        for k in new:
            found[k] = self.known[words[k]]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, first = np.frombuffer(b"".join(found), np.uint32), np.cumsum(sizes) - sizes
        n = sizes[index]
        ends = np.cumsum(n)
        ids = pool[np.repeat(first[index] - (ends - n), n) + np.arange(n.sum())]
        offsets = lists.offsets.to_numpy()
        ends = np.r_[0, ends][offsets[1:] - offsets[0]]
        return np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """One for a Python worker, so that words encoded in one task are known in the next."""
    return WordEncoder(path)


def cuts(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the chunks of texts that end at ends: where the hash of a text's last ROLL ids is a multiple of MEAN, after each MOST ids, and at the end."""
    starts, at = np.r_[0, ends[:-1]], np.zeros(0, np.int64)
    if len(ids) >= ROLL:
        h, k = ids * np.uint32(0x9E3779B1), 1
        while k < ROLL:  # of 1, 2, 4, 8 ids
            h, k = h[:-k] * np.uint32(pow(0x85EBCA6B, k, 1 << 32)) + h[k:], 2 * k
        at = np.flatnonzero((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(10) & np.uint32(MEAN - 1) == 0)
        at = at[at >= starts[np.searchsorted(ends, at + ROLL)]] + ROLL
    out = np.unique(np.concatenate([at, ends]))
    size = np.diff(np.r_[0, out])
    for k in np.flatnonzero(size > MOST):
        out = np.append(out, np.arange(out[k] - size[k] + MOST, out[k], MOST))
    return np.sort(out)


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encodes each row's whole text, appends end_id and stores the ids in ascending doc_id order.

    A null or empty text is end_id alone; a null doc_id comes first. Rows that share a doc_id are documents of their own,
    ordered by digest; equal rows share a recipe with a count. A text of any length is encoded in one task, with memory
    in proportion to it; an empty table makes a store without documents. Other columns are not read.
    """
    spark = documents.sparkSession
    spark.sparkContext.addFile(tokenizer)
    name = tokenizer.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, code = _encoder(SparkFiles.get(name)), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in parts(batch, 1, BLOCK):
                ids, ends = encoder.ids(part.column(1), end_id)
                out = cuts(ids, ends)
                raw, small = ids.tobytes(), b"" if encoder.wide else ids.astype(np.uint16).tobytes()
                rows: list[tuple] = []
                stored, a, k = set(), 0, 0
                out_list = out.tolist()
                for doc, start, end in zip(part.column(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    names, sizes = [], []
                    while a < end:
                        b = out_list[k]
                        names.append(d := digest(raw[4 * a : 4 * b]))
                        sizes.append(b - a)
                        if d not in stored:
                            stored.add(d)
                            rows.append((1, d, 0, b - a, code.compress(raw[4 * a : 4 * b] if encoder.wide else small[2 * a : 2 * b])))
                        a, k = b, k + 1
                    rows.append((0, digest(b"".join(names)), doc, end - start, b"".join(names) + np.array(sizes, ">u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], ["kind", "digest", "doc_id", "n", "body"]
                )

    rows = keyed(documents).mapInArrow(run, "kind int, digest binary, doc_id long, n long, body binary")
    once = rows.groupBy("kind", "digest", "doc_id").agg(F.first("n").alias("n"), F.first("body").alias("body"), F.count("*").alias("copies"))
    once.write.partitionBy("kind").option("compression", "none").parquet(f"{path}/blocks")

    plain = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where("kind = 0")
    k = F.expr(f"length(body) div {DIGEST + 4}")
    names = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.substr(F.col("body"), i * DIGEST + 1, F.lit(DIGEST)))

    def size(i):
        return F.conv(F.hex(F.substr(F.col("body"), k * DIGEST + i * 4 + 1, F.lit(4))), 16, 10).cast("long")

    sizes = F.transform(F.sequence(F.lit(0), k - 1), size)
    ordered = plain.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"), F.col("n").alias("n_tokens"), F.col("digest").alias("root"), names.alias("chunks"), sizes.alias("sizes"))
    ordered = ordered.repartitionByRange("doc_id", "root", "copy").sortWithinPartitions("doc_id", "root", "copy").withColumn("part", F.spark_partition_id())
    ordered.write.option("compression", "zstd").parquet(f"{path}/recipes")

    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    _manifest(recipes).write.parquet(f"{path}/manifest")


def _manifest(recipes: DataFrame) -> DataFrame:
    """A row for each part of the recipes: its Merkle root over the documents in order, FAN to a node, and what it holds."""
    by_row = _placed(recipes.select("part", "doc_id", "root", "copy", "n_tokens"))
    leaves = by_row.groupBy("part", ((F.col("row") - 1) / FAN).cast("long").alias("node"))
    nodes = leaves.agg(F.sort_array(F.collect_list(F.struct("row", "root"))).alias("x"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("documents"))
    nodes = nodes.withColumn("x", F.sha2(F.array_join(F.transform("x", lambda r: F.hex(r["root"])), ""), 256))
    return nodes.groupBy("part").agg(
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "x"))), lambda r: r["x"]), ""), 256).alias("root"),
        F.sum("n_tokens").alias("n_tokens"), F.sum("documents").alias("documents"), F.min("low").alias("low"), F.max("high").alias("high"),
    )


def verify(spark: SparkSession, path: str) -> None:
    """Fails if a part's recipes don't give its root and counts in the manifest, or if a part is missing on either side."""
    given = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    held = _manifest(spark.read.schema(RECIPES).parquet(f"{path}/recipes")).select(*given.columns)
    both = given.withColumn("__given", F.lit(1)).unionAll(held.withColumn("__given", F.lit(-1)))
    odd = both.groupBy(*given.columns).agg(F.sum("__given").alias("n")).where("n <> 0").select("part").distinct()
    bad = [r.part for r in odd.take(5)]
    if bad:
        raise ValueError(f"recipes of part {bad} don't match the manifest")


def _placed(recipes: DataFrame) -> DataFrame:
    """row: number in the part; before: ids of the part's documents before it."""
    from pyspark.sql import Window

    by = Window.partitionBy("part").orderBy("doc_id", "root", "copy")
    return recipes.withColumn("row", F.row_number().over(by)).withColumn("before", F.sum("n_tokens").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, root, chunks, sizes. The manifest has a row for each part, so offsets of parts are few."""
    manifest = sorted(spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("part", "n_tokens").collect())
    starts, at = [], 0
    for part, n in manifest:
        starts.append((part, at))
        at += n
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, offset long"))
    placed = _placed(spark.read.schema(RECIPES).parquet(f"{path}/recipes"))
    return placed.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "root", "chunks", "sizes")


POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial, bits reversed."""
    p, m = 0, 1 << 31
    while a:
        if a & m:
            p ^= b
            a ^= m
        m >>= 1
        b = b >> 1 ^ POLY if b & 1 else b >> 1
    return p


@cache
def _shift(n: int) -> int:
    """x ** (8 * n) modulo the polynomial."""
    p, square, n = 1 << 31, 1 << 23, n
    while n:
        if n & 1:
            p = _times(square, p)
        square, n = _times(square, square), n >> 1
    return p


def joined_crc(parts_of: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation from (CRC-32, bytes) of its parts."""
    crc = 0
    for c, n in parts_of:
        crc = _times(_shift(n), crc) ^ c
    return crc


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """digest, n, crc, of the ids that the chunk files hold; fails where a body doesn't have its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = zstandard.ZstdDecompressor()
        for batch in batches:
            n, crc = [], []
            for d, size, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = code.decompress(body)
                raw = np.frombuffer(raw, np.uint16 if len(raw) == 2 * size else np.uint32).astype(np.uint32).tobytes()
                if digest(raw) != d or len(raw) != 4 * size:
                    raise ValueError(f"chunk {d.hex()} is damaged")
                n.append(size)
                crc.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["digest", "n", "crc"])

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where("kind = 1").select("digest", "n", "body").mapInArrow(run, "digest binary, n long, crc long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files; fails where its Merkle root isn't that of its chunks.

    The manifest's roots and counts are checked first, so a recipe that was lost or replaced is seen too.

    Each chunk's ids are read once; only its CRC and size go to the documents that hold it.
    """
    verify(spark, path)
    listed = recipes(spark, path).select("doc_id", "start", "n_tokens", "root", F.posexplode("chunks").alias("k", "digest"))
    found = listed.join(chunks(spark, path), "digest", "left")
    whole = found.groupBy("start", "doc_id", "n_tokens", "root").agg(F.sort_array(F.collect_list(F.struct("k", "n", "crc", "digest"))).alias("cs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = []
            for doc, n, root, cs in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                if digest(b"".join(c["digest"] for c in cs)) != root or any(c["n"] is None for c in cs) or sum(c["n"] for c in cs) != n:
                    raise ValueError(f"document {doc} doesn't match its recipe")
                crc.append(joined_crc([(c["crc"], 4 * c["n"]) for c in cs]))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), batch.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    out = whole.select("start", "doc_id", "n_tokens", "root", "cs").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", unkeyed())


def ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array of long) of each document, put together from its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for cs in batch.column(2).to_pylist():
                raw = [(code.decompress(c["body"]), c["n"]) for c in cs]
                out.append(np.concatenate([np.frombuffer(x, np.uint16 if len(x) == 2 * n else np.uint32).astype(np.int64) for x, n in raw]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    listed = recipes(spark, path).select("doc_id", "start", F.posexplode("chunks").alias("k", "digest"))
    bodies = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where("kind = 1").select("digest", "n", "body")
    whole = listed.join(bodies, "digest").groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("k", "n", "body"))).alias("cs"))
    return whole.mapInArrow(run, "doc_id long, start long, ids array<long>").withColumn("doc_id", unkeyed())


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "store")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, path)
