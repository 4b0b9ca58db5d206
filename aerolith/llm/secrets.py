"""Secret scans: patterns of known secrets, and strings that a vocabulary of subwords can't shorten."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import parts, table, texts

#: Order of kinds among spans of one start.
KINDS = ("assign", "access", "hex", "random")
#: The patterns of known secrets. Case is ignored among ASCII letters alone, in the first.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
#: Digests in any case, by their hex length: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512; and subresource digests.
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|sha(?:256|384|512)-[A-Za-z0-9+/]+={0,2})")
#: Identifiers: UUIDs, alone or with a name before or after; dates and times with zone or number.
IDENTIFIER = re.compile(r"(?:[A-Za-z]+[_-])?[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}(?:[_-][A-Za-z0-9]{1,8})?|[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-]?[0-9_-]*Z?(?:[+-][0-9]{2,4})?")
#: Parts of names: words of one case or with a capital, and short numbers.
NAME = re.compile(r"(?:[A-Z]?[a-z]{3,}|[A-Z]{2,12}(?![a-z])|[0-9]{1,4}(?![0-9])|[+/_-])+")
#: Characters that are tokenised at once.
SLICE = 1024
#: Bytes of texts that are scanned together; strings whose token count a task keeps.
BLOCK, CACHE = 1 << 22, 200_000


@dataclass(frozen=True)
class Plan:
    """A string of least characters or more is random if it has at most ratio_percent / 100 characters a token."""

    least: int = 20
    ratio_percent: int = 180
    #: Letters and digits that it must have.
    letters: int = 4
    digits: int = 1


class Tokens:
    """Number of tokens of a string; slices of SLICE characters count for themselves, so that time is linear."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def count(self, s: str) -> int:
        n = self.known.get(s)
        if n is None:
            n = sum(len(self.encode(s[k : k + SLICE])) for k in range(0, len(s), SLICE))
            if len(s) <= SLICE:
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[s] = n
        return n


class Scanner:
    def __init__(self, path: str, plan: Plan = Plan()):
        self.tokens, self.plan = Tokens(path), plan
        self.run = re.compile(rf"[A-Za-z0-9+/_-]{{{plan.least},}}+={{0,2}}")

    def is_random(self, s: str) -> bool:
        """Whether s is neither a digest, nor an identifier, nor a name, and has few characters a token."""
        p, body = self.plan, s.rstrip("=")
        if sum(map(str.isdigit, body)) < p.digits or sum(map(str.isalpha, body)) < p.letters:
            return False
        if DIGEST.fullmatch(s) or IDENTIFIER.fullmatch(body) or NAME.fullmatch(body):
            return False
        return 100 * len(body) <= p.ratio_percent * self.tokens.count(body)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end) in order: code points, end exclusive. A random string that touches another kind's span isn't listed."""
        found = []
        if ":" in text or "=" in text:
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        found.sort()
        more, k, reach = [], 0, 0
        for m in self.run.finditer(text):  # k: base spans that start before this run's end
            while k < len(found) and found[k][0] < m.end():
                reach, k = max(reach, found[k][2]), k + 1
            if reach <= m.start() and self.is_random(m[0]):
                more.append((m.start(), 3, m.end()))
        return sorted(found + more) if more else found


def scan(docs: DataFrame, vocabulary: str, plan: Plan = Plan()) -> DataFrame:
    """One row per row of docs: doc_id, secrets (array of structs: kind, start, end; in order, code points, end exclusive).

    Kinds assign, access and hex are known patterns, leftmost matches that don't overlap within a kind. Kind random is a
    maximal run of letters, digits and +/_- that is long enough and that the vocabulary (a file of tiktoken ranks, read
    by path on the driver and handed to tasks) cuts into short tokens; digests of known lengths, UUIDs, dates and names
    are left out, and so is what overlaps a known pattern. A null or empty text has no secrets; rows that repeat or share
    a doc_id, or have none, are scanned each on its own; columns other than doc_id and text are not read; an empty table
    gives an empty one. A text of any length is one row's work, linear in its length.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(SparkFiles.get(name), plan)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for part in parts(batch, 1, BLOCK):
                rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scanner.spans(t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(kind))], ["doc_id", "secrets"])

    return texts(docs).mapInArrow(run, "doc_id long, secrets array<struct<kind:string,start:long,end:long>>")


def redacted(docs: DataFrame, vocabulary: str, plan: Plan = Plan(), by: str = "[secret]") -> DataFrame:
    """docs with each stretch of text that spans of scan() cover, overlaps joined, replaced by by; n_secrets long counts these stretches.

    Rows and their other columns stay as they are; a null text stays null and has 0. The column is named n_secrets with as
    many underscores after it as docs needs. What scan() says of odd rows holds here too.
    """
    from pyspark.sql import types as T

    from aerolith.llm.common import free

    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary)
    name, at = vocabulary.rsplit("/", 1)[-1], next(k for k, c in enumerate(docs.columns) if c.lower() == "text")
    count = free(docs, "n_secrets")
    rows = docs.withColumn(docs.columns[at], F.col(docs.columns[at]).cast("string"))
    schema = T.StructType([*rows.schema.fields, T.StructField(count, T.LongType())])

    def clean(scanner: Scanner, text: str | None) -> tuple[str | None, int]:
        if not text:
            return text, 0
        out, upto, n = [], 0, 0
        for a, _, b in scanner.spans(text):
            if a >= upto:
                out += [text[upto:a], by]
                n += 1
            upto = max(upto, b)
        return "".join([*out, text[upto:]]), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(SparkFiles.get(name), plan)
        for batch in batches:
            for part in parts(batch, at, BLOCK):
                new = [clean(scanner, t) for t in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array([t for t, _ in new], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in new], pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    listed = lambda ss: F.array_join(F.transform(ss, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = listed(F.filter("secrets", lambda s: s["kind"] != "random"))
    return found.select("doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
