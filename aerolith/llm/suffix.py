"""Dedup of repeated bytes by comparison of winnowed phrases."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from aerolith.llm.common import keyed, table, unkeyed
from aerolith.llm.repeats import Cut, stripped


def _kept(units: bytes, lo: np.ndarray, hi: np.ndarray) -> bytes:
    at = np.r_[0, hi]
    return b"".join(units[a:b] for a, b in zip(at, np.r_[lo, len(units)], strict=True))


def _cut(length: int) -> Cut:
    return Cut(length, max(1, min(24, length // 2)), False)


def dedup(documents: DataFrame, length: int = 100, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text without each byte covered by a string of length bytes that also starts earlier, n_bytes, n_removed, more.

    Rolling-hash triggers cut each text into phrases that overlap by length - 1 bytes, so each window lies whole in one
    phrase and equal windows share its trigger. Copies of a phrase are settled by their first occurrence; phrases that
    differ though they share a trigger are compared window by window. No suffix array is built.

    Cutting UTF-8 between bytes may leave parts of characters; they are left out of text. A null or empty text stays
    empty; a null doc_id comes before all others. Repeated rows count as one document: they are treated alike and
    neither is earlier than the other. Rows that share a doc_id but not the text are documents in order of a hash of it. Other columns are carried if named in more, else not read.
    A text of any length is cut in one task, with memory in proportion to it; its repeats may lie anywhere in it or in others. An empty table gives an empty one.
    """

    def row(units, lo, hi):
        left = _kept(units, lo, hi)
        return left.decode("utf-8", "ignore"), len(units), len(units) - len(left)

    out = stripped(keyed(documents, *more), _cut(length), True, row, "text string, n_bytes long, n_removed long", *more)
    return out.withColumn("doc_id", unkeyed())


def digests(documents: DataFrame, length: int = 100) -> DataFrame:
    """As dedup(), with counts and the digest of the bytes that are left."""

    def row(units, lo, hi):
        left = _kept(units, lo, hi)
        return len(units), len(units) - len(left), len(lo), hashlib.sha256(left).hexdigest()

    out = stripped(keyed(documents), _cut(length), True, row, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", unkeyed())


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
