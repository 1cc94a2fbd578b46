"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is found in a document if the document holds at least 0.8 of the
item's distinct five-word shingles (an item of fewer words is one shingle).
Shingles that no item has cannot count, so a document's set is first cut down
to the items' universe. Documents and items are then classed by set size. For
each pair of classes the containment threshold becomes a bound on the Jaccard
similarity, and from that follows how many single-row bands leave a miss with
probability ``MISS`` at most. Candidates are verified by their exact sets.
Where that takes more than ``MAX_HASHES`` bands, every item that shares a
shingle is verified instead, so no size class is cut short.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.llm.names import unused
from fabula.session import written

WORD = re.compile(r"\w+")
SHINGLE = 5
THRESHOLD = 0.8
MISS = 1e-12
MAX_HASHES = 256  #: a band number fits a byte
#: The items that one pass over the documents carries (64 characters are added
#: for each, so 11,000 empty ones fill a block, and their bands take 4 KB each);
#: more take more passes.
BLOCK_CHARS = 1 << 20
MATCHES = "array<struct<item_id:bigint,n_item:int,n_shared:int>>"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def bands(small: int, large: int, threshold: float) -> int:
    """Hashes needed so that a set of at most ``large`` elements that holds
    ``threshold`` of a set of at least ``small`` is missed with odds MISS."""
    shared = threshold * small
    jaccard = min(1.0, shared / max(small + large - shared, shared))
    return 1 if jaccard >= 1 else math.ceil(math.log(MISS) / math.log1p(-jaccard))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of unsigned integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class ItemIndex:
    """MinHash bands of a bounded block of items, by size class: sorted keys,
    each a least hash with its number in the lowest byte, and their items."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, seed: int = 11):
        self.threshold = threshold
        self.vocabulary: dict[str, int] = {}
        self.universe: dict[tuple, int] = {}
        self.items: list[tuple[int, frozenset]] = []
        self.holders: dict[int, list[int]] = defaultdict(list)
        self.short: set[int] = set()
        for item_id, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary)) for x in words(text)]
            if not w or item_id is None:
                continue
            n = min(SHINGLE, len(w))
            if n < SHINGLE:
                self.short.add(n)
            found = frozenset(self.universe.setdefault(tuple(w[i : i + n]), len(self.universe)) for i in range(len(w) - n + 1))
            for s in found:
                self.holders[s].append(len(self.items))
            self.items.append((item_id, found))
        rng = np.random.default_rng(seed)
        self.seeds = rng.integers(0, 1 << 64, MAX_HASHES, np.uint64, endpoint=False)
        self.classes: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        by_class: dict[int, list[int]] = defaultdict(list)
        for k, (_, found) in enumerate(self.items):
            by_class[len(found).bit_length()].append(k)
        for c, members in by_class.items():
            keys = np.concatenate([self.signature(self.items[k][1], MAX_HASHES) for k in members])
            order = np.argsort(keys, kind="stable")
            owners = np.repeat(np.array(members, np.int32), MAX_HASHES)[order]
            self.classes[c] = (min(len(self.items[k][1]) for k in members), keys[order], owners)

    def signature(self, found, n: int) -> np.ndarray:
        """The first ``n`` band keys of a set of shingles."""
        x = mixed(np.fromiter(found, np.uint64, len(found)) + np.uint64(1))
        least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        for a in range(0, len(x), 1024):
            np.minimum(least, mixed(x[a : a + 1024, None] ^ self.seeds[None, :n]).min(0), out=least)
        return (least & ~np.uint64(0xFF)) | np.arange(n, dtype=np.uint64)

    def shared_shingles(self, text: str | None) -> set[int]:
        """The shingles of the text that some item has."""
        get = self.vocabulary.get
        ids = np.array([get(x, -1) for x in words(text)], np.int64)
        found: set[int] = set()
        if not len(ids):
            return found
        known = (ids >= 0).astype(np.int8)
        for n in (SHINGLE, *self.short):
            if len(ids) < n:
                continue
            run = known[: len(ids) - n + 1].copy()
            for k in range(1, n):
                run &= known[k : len(ids) - n + 1 + k]
            for i in np.flatnonzero(run).tolist():
                s = self.universe.get(tuple(ids[i : i + n].tolist()))
                if s is not None:
                    found.add(s)
        return found

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distinct shingles of the item, those in the text)."""
        found = self.shared_shingles(text)
        if not found:
            return []
        upper = (1 << len(found).bit_length()) - 1
        need = {c: bands(least, upper, self.threshold) for c, (least, *_) in self.classes.items()}
        hashed = max([n for n in need.values() if n <= MAX_HASHES], default=0)
        signature = self.signature(found, hashed)
        candidates: set[int] = set()
        for c, (_, keys, owners) in self.classes.items():
            if need[c] <= MAX_HASHES:
                own = signature[: need[c]]
                for a, b in zip(np.searchsorted(keys, own), np.searchsorted(keys, own, "right")):
                    candidates.update(owners[a:b].tolist())
        if any(n > MAX_HASHES for n in need.values()):
            candidates.update(k for s in found for k in self.holders[s])
        out = []
        for k in sorted(candidates):
            item_id, own = self.items[k]
            n = len(own & found)
            if n >= self.threshold * len(own):
                out.append((item_id, len(own), n))
        return out


def blocks(items: DataFrame, key: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Blocks of items, each bounded; the driver holds one at a time."""
    block, size = [], 0
    for r in items.select(key, text).distinct().orderBy(key, text).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1] or "") + 64
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def match_column(index: ItemIndex, text: str) -> Column:
    @F.pandas_udf(MATCHES)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"item_id": a, "n_item": b, "n_shared": c} for a, b, c in index.matches(t)] for t in texts])

    return find(F.col(text))


def find_matches(docs: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS, into: str = "_matches") -> DataFrame:
    """``docs`` with a column ``into`` of the items each text holds, in place of
    an input column of that name. Texts of any length count whole.

    Null and empty texts hold nothing; items without a word or without an id
    are found nowhere; two items with one id are two items. A benchmark of
    more than ``block_chars`` is taken in blocks, a pass over the documents
    for each, written between passes.
    """
    out = docs.drop(into).withColumn(into, F.array().cast(MATCHES))
    for n, block in enumerate(blocks(items, item_key, item_text, block_chars)):
        if n:
            out = written(out, "matches")
        index = ItemIndex(block, threshold)
        found = match_column(index, text)
        out = out.withColumn(into, found if n == 0 else F.concat(into, found))
    return out


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id,
    n_item, n_shared, containment. Repeated rows give repeated results."""
    found = find_matches(docs, items, **options)
    return found.select("doc_id", F.explode("_matches").alias("m")).select(
        "doc_id", "m.item_id", "m.n_item", "m.n_shared", (F.col("m.n_shared") / F.col("m.n_item")).alias("containment")
    )


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no item, with their columns as they were,
    whatever their names."""
    (into,) = unused(docs.columns, "_matches")
    return find_matches(docs, items, into=into, **options).where(F.size(into) == 0).drop(into)
