"""Near-duplicates: MinHash bands propose pairs, odd sketches thin them out, full shingle sets confirm them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import NO_ID, ROWS, free, gathered, packed, parts, staged, table, unkeyed
from aerolith.llm.components import components
from aerolith.llm.hashing import STEP, U64, WordHashes, mix, powers, signed


@dataclass(frozen=True)
class Plan:
    """A pair of similarity s meets in some band with probability 1 - (1 - s ** rows) ** bands: 0.999995 at 0.75."""

    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    #: Bits of an odd sketch, a multiple of 64.
    bits: int = 1024
    #: How far below the expectation, in deviations, a sketch may lie before its pair is dropped.
    slack: float = 5.0
    #: Rounds of further stars before the rest is compared by differences.
    rounds: int = 1

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_odd_bits(self) -> int:
        """Bits in which the sketches of a pair at the threshold differ, at most.

        Of k samples k * (1 - s) differ, give or take a binomial deviation, and each puts two elements into the
        symmetric difference; d elements leave bits * (1 - (1 - 2 / bits) ** d) / 2 bits set, less two for each of the
        d * (d - 1) / (2 * bits) meetings that chance adds.
        """
        k, s, n = self.samples, self.percent / 100, self.bits
        d = 2 * k * (1 - s)
        expected, slope = n * (1 - (1 - 2 / n) ** d) / 2, 2 * (1 - 2 / n) ** d
        spread = slope**2 * k * s * (1 - s) + 4 * d * max(d - 1, 0) / (2 * n)
        return math.ceil(expected + self.slack * math.sqrt(spread))


def shingles(text: str, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of n words; of fewer words, one hash of them all."""
    w = hashes.of(text.encode("utf-8", "replace").lower().split())
    if not len(w):
        return w
    k = min(n, len(w))
    p = powers(int(STEP), k)
    h = np.zeros(len(w) - k + 1, U64)
    for j in range(k):
        h += w[j : len(h) + j] * p[j + 1]
    return np.unique(mix(h + U64(k)))


def signatures(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n, set_a and set_b (which name the set), bands (array of long) and sketch (array of long)."""
    k = plan.samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rng = WordHashes(), np.random.default_rng(20)
        a, b = rng.integers(1, 1 << 63, k, dtype=np.uint64) * U64(2) + U64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                n, size = 0, 0
                while done + n < batch.num_rows and (n == 0 or size < 1 << 19):
                    size += len(batch.column(1)[done + n].as_buffer() or b"")
                    n += 1
                sets = [shingles(t.as_py(), plan.words, hashes) for t in batch.column(1).slice(done, n)]
                sizes = np.array([len(s) for s in sets])
                flat, full = np.concatenate(sets), sizes > 0
                names, low, odd = np.zeros((2, n), U64), np.zeros((k, n), U64), np.zeros((n, plan.bits // 64), U64)
                if full.any():
                    starts = (np.cumsum(sizes) - sizes)[full]
                    names[0, full], names[1, full] = np.add.reduceat(mix(flat + STEP), starts), np.add.reduceat(mix(flat ^ STEP), starts)
                    for i in range(k):
                        low[i, full] = np.minimum.reduceat((flat * a[i] + b[i]) >> U64(16), starts)
                    # sample i of value v toggles one bit
                    bit = mix(low + (np.arange(k, dtype=U64) * STEP)[:, None]) % U64(plan.bits)
                    hit = np.zeros((n, plan.bits), np.uint8)
                    for i in range(k):
                        hit[np.arange(n), bit[i]] ^= full
                    odd = np.packbits(hit, axis=1).view(U64)
                keys = np.zeros((plan.bands, n), U64)
                for j in range(plan.bands):
                    for i in range(plan.rows):
                        keys[j] = mix(keys[j] * STEP + low[j * plan.rows + i] + U64(j))
                array = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(signed(np.ascontiguousarray(x)).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, n), pa.array(sizes.astype(np.int64)), pa.array(signed(names[0])), pa.array(signed(names[1])), array(keys.T), array(odd)],
                    ["doc_id", "n", "set_a", "set_b", "bands", "sketch"],
                )
                done += n

    return docs.mapInArrow(run, "doc_id long, n long, set_a long, set_b long, bands array<long>, sketch array<long>")


def _close(x: str, y: str, plan: Plan) -> Column:
    odd = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(plan.bits // 64)), F.lit(0))
    return odd <= plan.most_odd_bits


#: Pairs of texts, or texts, that are worth a task.
TEXTS = 2000
#: Bits at most of the filter that tells which documents may be named, in parts of PART bits: 8 MB at any size of the input.
FILTER, PART = 1 << 26, 1 << 15


def _likely(rows: DataFrame, named: DataFrame, n: int) -> DataFrame:
    """The rows whose doc_id is in named (n rows at most), and a few others, without a shuffle of rows.

    What a bit of a bitmap says of the id is all that tasks are handed: 16 bits for each named row, FILTER at most. Where
    very many are named the bitmap is full and lets most rows pass; the join after it decides.
    """
    size = min(FILTER, max(PART, 1 << (16 * n).bit_length()))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    placed = named.select(F.floor(at / PART).cast("int").alias("__part"), (at % PART).alias("__bit"))
    bits = placed.groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    both = rows.withColumns({"__part": F.floor(at / PART).cast("int"), "__bit": (at % PART).cast("int")}).join(F.broadcast(bits), "__part")
    byte = F.conv(F.hex(F.substr(F.col("__bits"), F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return both.where(F.getbit(byte, F.col("__bit") % 8) == 1).select(*rows.columns)


def _held(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id and z (packed text) of the documents that pairs, a table, names; as a table."""
    named = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b"))
    n = 2 * pairs.count()
    return staged(packed(_likely(docs, named, n)).join(named.distinct(), "doc_id", "left_semi"), "texts", n, TEXTS)


def _sets(batch: pa.RecordBatch, column: int, plan: Plan, hashes: WordHashes) -> Iterator[np.ndarray]:
    code = zstandard.ZstdDecompressor()
    return (shingles(code.decompress(z.as_buffer().to_pybytes()).decode("utf-8", "replace"), plan.words, hashes) for z in batch.column(column))


def confirmed(pairs: DataFrame, held: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b; a table) whose full sets are similar enough. held has the packed text of each document that a pair names."""
    side = lambda x: held.select(F.col("doc_id").alias(x), F.col("z").alias(f"z_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "z_a", "z_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, known = WordHashes(), None, np.zeros(0, U64)
        for batch in batches:
            keep = []
            for k, (a, other) in enumerate(zip(batch.column(0).to_pylist(), _sets(batch, 3, plan, hashes), strict=True)):
                if a != last:
                    last, known = a, next(_sets(batch.slice(k, 1), 2, plan, hashes))
                same = len(np.intersect1d(known, other, assume_unique=True))
                keep.append(100 * same >= plan.percent * (len(known) + len(other) - same) and same > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return gathered(both, pairs.count(), TEXTS).mapInArrow(run, "a long, b long")


def _related(pairs: DataFrame, held: DataFrame, plan: Plan) -> DataFrame:
    """How documents differ from a hub. pairs: a (hub), b (document), cb (its component), ca (the hub's).

    A row without key for each pair: n shingles, i of them shared with the hub. Besides rows for the first shingles, in
    order of their hashes, that the hub lacks: key, and left, how many such shingles there are from it on. Another
    document similar enough can share no more than i shingles of the hub, so it shares one of these or needs none.
    """
    side = lambda x: held.select(F.col("doc_id").alias(x), F.col("z").alias(f"z_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "z_a", "z_b", "ca", "cb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, known = WordHashes(), None, np.zeros(0, U64)
        for batch in batches:
            for part in parts(batch, 3, 1 << 18):
                who, keys, left, n, i = [], [], [], [], []
                for k, (a, other) in enumerate(zip(part.column(0).to_pylist(), _sets(part, 3, plan, hashes), strict=True)):
                    if a != last:
                        last, known = a, next(_sets(part.slice(k, 1), 2, plan, hashes))
                    own = np.setdiff1d(other, known, assume_unique=True)
                    same = len(other) - len(own)
                    first = len(own) + 1 - max(1, -(-plan.percent * len(other) // 100) - same)
                    keys += [None, *signed(own[: max(first, 0)]).tolist()]
                    left += [0, *range(len(own), len(own) - max(first, 0), -1)]
                    for column, value in ((who, k), (n, len(other)), (i, same)):
                        column += [value] * (len(keys) - len(column))
                rows = part.select([0, 1, 4, 5]).take(pa.array(who, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(x, pa.int64()) for x in (n, i, keys, left))], ["hub", "x", "ca", "c", "n", "i", "key", "left"])

    return gathered(both, pairs.count(), TEXTS).mapInArrow(run, "hub long, x long, ca long, c long, n long, i long, key long, left long")


def _between(pairs: DataFrame, held: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) of documents of different components under one hub that may be linked: all that are, and few others.

    With p per cent as the limit, x and y need ceil(p * (nx + ny) / (100 + p)) shingles in common. At most min(ix, iy) of
    these are the hub's. If that is not enough they share some that the hub lacks, and so one of the first of them
    (prefix filtering on differences); what a passage or an original gives to a whole group the hub has too, so it is no
    key. If it may be enough, one of the two is shorter than the hub or closer to it, which few are.
    """
    rows = staged(_related(pairs, held, plan), "differences")
    p, q = plan.percent, 100 + plan.percent
    need = F.ceil(p * (F.col("nx") + F.col("ny")) / q)
    common = F.least("ix", "iy")
    side = lambda t, s, *more: t.select("hub", *more, *(F.col(c).alias(c + s if c != "x" else s) for c in ("x", "n", "i", "c", "left")))

    mixed = rows.where("key IS NOT NULL").groupBy("hub", "key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("hub", "key")
    many = rows.count()
    keyed_rows = staged(rows.join(mixed, ["hub", "key"]), "keys", many)
    x, y = side(keyed_rows, "x", "key"), side(keyed_rows, "y", "key")
    some = x.join(y, ["hub", "key"]).where((F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")) & (need > common) & (F.least("leftx", "lefty") >= need - common))

    plain = rows.where("key IS NULL").withColumn("most", q * F.col("i") - p * F.col("n"))  # p times the length of what it may be linked with
    reach = staged(plain.groupBy("hub").agg(F.max(F.when(F.col("c") != F.col("ca"), F.col("most"))).alias("far"), F.min("n").alias("short")), "reach", many)
    plain = plain.join(reach, "hub")
    x, y = side(plain.where((F.col("c") != F.col("ca")) & (F.col("most") >= p * F.col("short"))), "x"), side(plain.where(p * F.col("n") <= F.col("far")), "y")
    rest = x.join(y, "hub").where((F.col("cx") != F.col("cy")) & (need <= common))
    return some.select("x", "y").unionAll(rest.select("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _grouped(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n and top (the smallest doc_id reachable over links) for docs (doc_id, text), whose ids are all different."""
    sets = staged(signatures(docs, plan), "signatures")
    n = sets.count()
    name = ["set_a", "set_b", "n"]
    classes = sets.where("n > 0").groupBy(*name).agg(F.min("doc_id").alias("rep"))
    member = staged(sets.select("doc_id", *name).join(classes, name, "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "members", n)
    reps = member.where("n > 0 AND doc_id = rep").select("doc_id")
    stand = staged(sets.join(reps, "doc_id", "left_semi").select("doc_id", "bands", "sketch"), "representatives", n, ROWS // 10)
    rows = stand.select("doc_id", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    sized = staged(rows.join(buckets, "key"), "buckets", plan.bands * stand.count())
    many = sized.count()
    known = sized.groupBy("doc_id").agg(F.sum("size").alias("weight"))
    weighed = staged(sized.join(known, "doc_id").select("key", "doc_id", "size", "weight"), "weighed", many)
    first = lambda t: t.groupBy("key").agg(F.max(F.struct("weight", F.bitwise_not("doc_id").alias("hub"))).alias("m")).select("key", F.bitwise_not(F.col("m.hub")).alias("hub"))
    sketch = lambda x: stand.select(F.col("doc_id").alias(x), F.col("sketch").alias(f"sketch_{x}"))

    def close(pairs: DataFrame, n_pairs: int | None) -> DataFrame:
        near = pairs.join(sketch("b"), "b").join(sketch("a"), "a").where(_close("sketch_a", "sketch_b", plan))
        return staged(near.select("a", "b"), "pairs", n_pairs)

    def held(pairs: DataFrame) -> DataFrame:
        return _held(docs, pairs)

    def joined(links: DataFrame) -> DataFrame:
        return components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    shared = staged(weighed.join(first(weighed), "key"), "hubs", many)
    stars = close(shared.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), many)
    links = staged(confirmed(stars, held(stars), plan), "links")
    found = joined(links)
    gained = True
    for k in range(plan.rounds + 1):
        label = lambda x, as_: found.select(F.col("u").alias(x), F.col("component").alias(as_))  # noqa: B023, E731
        big = shared.where("size > 2").join(label("doc_id", "c"), "doc_id", "left").join(label("hub", "ca"), "hub", "left")
        big = big.select("key", "doc_id", "weight", "hub", F.coalesce("c", "doc_id").alias("c"), F.coalesce("ca", "hub").alias("ca"))
        mixed = big.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
        left = staged(big.join(mixed, "key", "left_semi"), "left", many)
        if left.isEmpty():
            break
        if final := k == plan.rounds or not gained:
            pairs = left.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"), "ca", F.col("c").alias("cb")).distinct()
            pairs = staged(pairs, "compared", many)
            pairs = _between(pairs, held(pairs), plan)
        else:  # another star in each bucket, around a document that its hub did not draw in
            second = first(left.where("c <> ca")).join(left.select("key", F.col("doc_id").alias("hub"), F.col("c").alias("ch")), ["key", "hub"])
            pairs = left.select("key", "doc_id", "c").join(second, "key").where("c <> ch").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
        pairs = close(pairs, None if final else many)
        late = staged(confirmed(pairs, held(pairs), plan), "links")
        if gained := not late.isEmpty():
            links = links.unionAll(late)
            found = joined(links)
        if final:
            break
    return member.join(found.withColumnRenamed("u", "rep"), "rep", "left").select("doc_id", "n", F.coalesce("component", "rep").alias("top"))


def _numbered(documents: DataFrame, node: str, text: str) -> tuple[DataFrame, bool]:
    """documents with node, a number for each distinct pair of doc_id and text in order of doc_id (null first), and text without nulls.

    The number is the doc_id itself where no two rows share one; also returned: whether some do.
    """
    rows = documents.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn(node, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    if rows.groupBy(node).count().where("count > 1").isEmpty():
        return rows, False
    digest = free(rows, "digest")
    rows = staged(rows.withColumn(digest, F.xxhash64(text)), "rows")
    nodes = rows.select(F.col(node).alias("id"), F.col(digest).alias("digest")).distinct().orderBy("id", "digest").withColumn("number", F.monotonically_increasing_id())
    nodes = staged(nodes, "nodes").select(F.col("id").alias(node), F.col("digest").alias(digest), F.col("number").alias(number := free(rows, "number")))
    return staged(rows.join(nodes, [node, digest]).drop(node, digest).withColumnRenamed(number, node), "named"), True


def near_duplicates(documents: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept, for each row of documents.

    1. Documents of equal sets form a class; its smallest doc_id stands for it.
    2. In each band's bucket every class is paired with its hub (a star, not all pairs): the class that shares most
       buckets with most others, so that copies of one original meet at the original. Sketches thin the pairs out, full
       sets confirm them, and the links give components. Buckets that still hold several components get further stars,
       around what the hub did not draw in, for plan.rounds rounds.
    3. Documents of buckets that hold several components even then are compared across components by how they differ
       from their hub (see _between). So no link between documents of one bucket is lost because a hub stood between
       its ends, and neither a bucket of copies nor a passage that many documents share is expanded into all pairs.

    A null or empty text has no shingles and no links; a null doc_id is a document whose id is below all others and
    whose component_id is null. Repeated rows give repeated results. Rows that share a doc_id, or have none, but not the
    text are documents of their own; kept says whether doc_id = component_id. Very long texts are whole sets in one
    task. An empty table gives an empty one. Other columns are not read, whatever their names.
    """
    rows, repeated = _numbered(documents.select("doc_id", "text"), "node", "whole")
    docs = rows.select(F.col("node").alias("doc_id"), F.col("whole").alias("text"))
    out = _grouped(docs.dropDuplicates(["doc_id"]) if repeated else docs, plan)
    if repeated:
        ids = rows.groupBy("node").agg(F.first(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).alias("id"), F.count("*").alias("rows"))
        ids = staged(ids, "ids")
        out = out.join(ids.select(F.col("node").alias("doc_id"), "id", "rows"), "doc_id").join(ids.select(F.col("node").alias("top"), F.col("id").alias("top_id")), "top")
        out = out.select(F.col("id").alias("doc_id"), "n", F.col("top_id").alias("top"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return out.select(unkeyed(), F.col("n").alias("n_shingles"), unkeyed("top").alias("component_id"), (F.col("doc_id") == F.col("top")).alias("kept"))


def one_of_each(documents: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row of each group of near-duplicates, the one of the smallest doc_id, with all its columns; of equal rows one.

    Rows that share a doc_id, or have none, are documents of their own if their texts differ; among rows of a group that
    share the smallest doc_id the one with the smallest hash of its text stays. Empty texts are in no group and stay.
    """
    node, text = free(documents, "node"), free(documents, "whole")
    rows, repeated = _numbered(documents, node, text)
    docs = rows.select(F.col(node).alias("doc_id"), F.col(text).alias("text"))
    found = _grouped(docs.dropDuplicates(["doc_id"]) if repeated else docs, plan)
    kept = found.where("doc_id = top").select(F.col("doc_id").alias(node))
    rows = rows.join(kept, node, "left_semi")
    return (rows.dropDuplicates([node]) if repeated else rows).select(*documents.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """Every pair of documents with a shingle in common is counted; for small tables only."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM l JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS top FROM documents UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.node)
SELECT r.node AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.top) AS component_id, r.node = min(r.top) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node"""
