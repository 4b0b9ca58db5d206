"""Substring dedup by seeds: winnowed anchors that occur twice are extended word by word, both ways."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from aerolith.llm.common import keyed, table, unkeyed
from aerolith.llm.repeats import Cut, stripped


def _split(agreeing: np.ndarray, unit: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Classes of seed occurrences that agree so far, split by their next unit; -1: no other one agrees any more."""
    out = np.full(len(agreeing), -1)
    at = np.flatnonzero((agreeing >= 0) & there)
    _, which, count = np.unique(agreeing[at] * (int(unit.max(initial=0)) + 1) + unit[at], return_inverse=True, return_counts=True)
    out[at] = np.where(count[which] > 1, which, -1)
    return out


@dataclass(frozen=True)
class Seeds(Cut):
    """Occurrences of a seed are extended together, so that no pairs are listed: those that agree are a class, each further word splits it."""

    words: bool = True

    def settled(self, sequences, trigger, place, starts, later, known) -> np.ndarray:
        """Extends from each seed's start to the right and to the left; a window repeats where others go with it both ways."""
        numbers: dict[bytes, int] = {}
        flat = np.fromiter((numbers.setdefault(w, len(numbers)) for s in sequences for w in s), np.int64)
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        first = np.cumsum(sizes) - sizes
        _, seed = np.unique(trigger, return_inverse=True)

        def extended(step: int, most: int) -> list[np.ndarray]:
            classes = [seed]
            for k in range(most):
                at = place + k if step > 0 else place - 1 - k
                there = (at >= 0) & (at < sizes)
                classes.append(_split(classes[-1], flat[np.where(there, first + at, 0)], there))
            return classes

        right, left = extended(1, self.window), extended(-1, self.window - self.gram)
        hit = np.zeros(int(starts.sum()), bool)
        begin = np.cumsum(starts) - starts
        for n, before in enumerate(left):  # windows with n words before the seed
            after, at = right[self.window - n], place - n
            both = np.flatnonzero((at >= 0) & (at < starts) & (before >= 0) & (after >= 0))
            _, earliest, who, count = np.unique(before[both] * len(sizes) + after[both], return_index=True, return_inverse=True, return_counts=True)
            again = earliest[who] != np.arange(len(both)) if later else count[who] > 1
            hit[(begin + at)[both[again]]] = True
        return hit


def _left(units: list[bytes], lo: np.ndarray, hi: np.ndarray) -> bytes:
    at = np.r_[0, hi]
    return b" ".join(w for a, b in zip(at, np.r_[lo, len(units)], strict=True) for w in units[a:b])


def _cut(length: int) -> Seeds:
    return Seeds(length, max(1, min(8, length // 2)))


def dedup(documents: DataFrame, length: int = 35) -> DataFrame:
    """doc_id, text (the words that are left, joined by a space), n_words, n_removed.

    Seeds are winnowed anchors: of each window of length words the smallest hash of a gram of eight words. Documents are
    joined on seeds that occur twice. All occurrences of a seed are extended together to the right and to the left, as far
    as a window around it reaches: a class of occurrences that agree is split by each further word, and those alone in
    their class end. Where two or more go together over length words or more, they are a repeat; its windows are merged
    with those of neighbouring seeds, so a removed run is the union of maximal repeats of at least length words.
    Occurrences with the same words all around (64 + 48 bits of hashes) are extended once. Seeds in over repeats.GROUP
    contexts are too many for a task: their windows meet in a shuffle, by 128-bit hashes.

    A text of any length is cut in one task, with memory in proportion to it. An empty table gives an empty one.

    Every copy of a repeat goes, the first too. A null or empty text has no words. Repeated rows are one document read
    twice: they are treated alike and do not repeat each other; rows that share a
    doc_id, or have none, but not the text are documents of their own. Other columns
    are not read.
    """

    def row(units, lo, hi):
        return _left(units, lo, hi).decode("utf-8", "replace"), len(units), int((hi - lo).sum())

    out = stripped(keyed(documents), _cut(length), False, row, "text string, n_words long, n_removed long")
    return out.withColumn("doc_id", unkeyed())


def digests(documents: DataFrame, length: int = 35) -> DataFrame:
    """As dedup(), with counts and the digest of what is left."""

    def row(units, lo, hi):
        return len(units), int((hi - lo).sum()), hashlib.sha256(_left(units, lo, hi)).hexdigest()

    out = stripped(keyed(documents), _cut(length), False, row, "n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("doc_id", unkeyed())


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """Every window of every document is listed; for small tables only."""
    return """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w)),
t AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY gram) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM t),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id"""
