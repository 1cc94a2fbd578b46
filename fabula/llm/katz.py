"""Katz back-off language model of any order over whole corpora, and its scores.

Documents are packed into chunks of about ``CHUNK`` tokens that keep their
words as small local ids. Order by order, a chunk asks about each of its
distinct n-grams once, so an n-gram that fills a third of the corpus arrives at
most once per chunk. Requests go to buckets by the hash of the history; a
bucket adds up the training counts of all chunks, keeps its share of the
model's table for that order, and answers each chunk. The n-grams of a very
frequent history are spread over several buckets, whose sums are added again.
An n-gram that only one chunk asked about is that chunk's own: longer ones that
begin with it are counted and kept there and not sent.

Counts are Good-Turing discounted up to ``K``. The back-off weight of a history
is its left-over mass divided by the mass that the next lower order leaves to
the words not seen after it, so each history's distribution sums to one over
the vocabulary and one class of unknown words. A token's probability is found
by recursion: its n-gram's if that was seen, else the weight times that of the
n-gram without its first word. A bucket hands out whole numbers only, so sums
do not depend on the order of rows.

Words are told apart by their 64-bit xxHash: with V distinct words the odds of
any clash are V * V / 2**65 (1e-6 for 6 million words, 3% for a thousand
million). The exchange has a row per chunk and bucket that share an n-gram,
never more than there are distinct n-grams in all chunks.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.session import new_folder, shuffles_dropped, written

ORDER = 3
CHUNK = 600_000
#: Bytes of text for which there is one bucket.
BUCKET_BYTES = 18_000_000
#: Training n-grams of one history that one bucket takes.
HOT = 4_000_000
K = 5
END, START = b"\n", b"\r"  # no word holds white space
STATS, MODEL = -1, -2
MASK = (1 << 32) - 1
#: Bytes of packed rows that a task hands on at a time.
YIELD = 4 << 20
#: The chunks are scored in so many turns; the last order's answers to a share
#: of them are in a shuffle at a time.
TURNS = 4
#: Rows are blobs of up to megabytes: Spark's defaults would hold thousands of
#: them in a batch and a hundred before a page or a row group ends.
ONE_ROW = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
BLOBS = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


# -- blobs ------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays, each in the least number of bytes that holds it, bytes
    in planes, compressed."""
    head, planes = [len(arrays)], []
    for x in arrays:
        x = np.ascontiguousarray(x, np.int64)
        width = max(1, (int(x.view(np.uint64).max()).bit_length() + 7) // 8) if len(x) else 1
        head += [width, len(x)]
        small = x.astype("<u4") if 1 < width <= 4 else x.astype(np.uint8) if width == 1 else x
        planes.append(np.ascontiguousarray(small.view(np.uint8).reshape(-1, small.itemsize)[:, :width].T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, "<i8").tobytes() + b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8).tolist()
    at, out = 8 + 16 * n, []
    for width, size in zip(head[::2], head[1::2]):
        planes = np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size)
        at += width * size
        if width == 1:
            out.append(planes[0].astype(np.int64))
            continue
        x = np.zeros((size, 4 if width <= 4 else 8), np.uint8)
        x[:, :width] = planes.T
        out.append(x.view("<u4" if width <= 4 else "<i8").reshape(-1).astype(np.int64))
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of unsigned integers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of one of each, and each key's number."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    of = np.empty(len(keys), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return ranked[new], order[new], of


def numbered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the columns as numbers 0, 1, ... in sorted order, and the place
    of a row for each number."""
    if len(columns) > 1 and all(not len(c) or c.max() <= MASK >> 1 for c in columns[:2]):
        columns = (columns[0].astype(np.int64) << 32 | columns[1], *columns[2:])
    _, first, of = distinct(columns[0])
    for c in columns[1:]:
        small = c if not len(c) or c.max() <= MASK else distinct(c)[2]
        _, first, of = distinct(of.astype(np.int64) << 32 | small)
    return of, first


# -- model ------------------------------------------------------------------


def discounts(n: np.ndarray) -> np.ndarray:
    """d[1..K] from the numbers n[1..K+1] of types seen so often (index 0 is
    not used). Where the Good-Turing ratio does not lie between 0 and 1, the
    absolute discount n1 / (n1 + 2 n2) is taken; without singletons, none."""
    d = np.ones(K + 1)
    if n[1] == 0:
        return d
    absolute = n[1] / (n[1] + 2 * n[2])
    common = (K + 1) * n[K + 1] / n[1]
    for r in range(1, K + 1):
        ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else -1.0
        good = (ratio - common) / (1 - common) if common < 1 else -1.0
        d[r] = good if 0 < good < 1 else 1 - absolute / r
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c <= K, d[np.minimum(c, K)], 1.0)


class Unigrams:
    """Discounted unigram probabilities; what is left is the unknown class."""

    def __init__(self, tokens: int, types: int, n: np.ndarray):
        self.tokens, self.types, self.d = tokens, types, discounts(n)
        spared = float(sum((1 - self.d[r]) * r * n[r] for r in range(1, K + 1)))
        self.total = tokens if spared > 0 else tokens + 1
        self.unknown = spared / self.total if spared > 0 else 1 / self.total

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / self.total, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def share(times: np.ndarray, often: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominator and left-over mass of histories seen ``times`` times with
    ``often[:, r - 1]`` successors seen r times. A history from whose successors
    discounting took nothing gives up one count of a total raised by one."""
    spared = often @ ((1 - d[1:]) * np.arange(1, K + 1))
    total = np.maximum(np.where(spared > 0, times, times + 1.0), 1.0)
    return total, np.where(spared > 0, spared, 1.0) / total


def history_numbers(head: np.ndarray, total: np.ndarray, suffix: np.ndarray, heads: int) -> np.ndarray:
    """The whole numbers that weights are made of, a row for each history: how
    many of its n-grams were seen 1..K times, how many seen ones have a
    shortened n-gram counted 1..K times, and the sum of all larger counts."""
    out = np.zeros((heads, 2 * K + 1), np.int64)
    seen = np.flatnonzero(total > 0)
    head, total, suffix = head[seen], total[seen], suffix[seen]
    for r in range(1, K + 1):
        out[:, r - 1] = np.bincount(head[total == r], minlength=heads)
        out[:, K + r - 1] = np.bincount(head[suffix == r], minlength=heads)
    big = suffix > K
    out[:, 2 * K] = np.bincount(head[big], suffix[big], heads)
    return out


def give_back() -> None:
    """Hands memory that was freed back to the system, so that the workers of
    an executor do not all keep their largest chunk."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lower_mass(low: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts of the shortened n-grams, from the numbers of those
    counted 1..K times and the sum of all larger counts."""
    return low[:, :K] @ (d[1:] * np.arange(1, K + 1)) + low[:, K]


@dataclass
class Model:
    """unigrams, the discounts of each higher order, and for each order a
    written table with a row per bucket or chunk: the words of its histories,
    the number of n-grams of each, and the words and counts of these (order 1:
    hashes, numbers and counts of the words)."""

    buckets: int
    unigrams: Unigrams | None = None
    d: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, DataFrame] = field(default_factory=dict)

    def vocabulary(self) -> DataFrame:
        """hash (XXH64, seed 0, as a signed long), number, count."""

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for blob in pdf["body"]:
                    yield pd.DataFrame(dict(zip(("hash", "number", "count"), unpack(blob))))

        return self.tables[1].select("body").mapInPandas(rows, "hash long, number long, count long").where("count > 0")

    def ngrams(self, n: int) -> DataFrame:
        """history (numbers of n - 1 words), word, count, discounted."""
        d = self.d[n]

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for blob in pdf["body"]:
                    *columns, runs, word, count = unpack(blob)
                    of = np.repeat(np.stack(columns, 1), runs, axis=0)
                    yield pd.DataFrame({"history": list(of), "word": word, "count": count, "discounted": discounted(count, d)})

        return self.tables[n].select("body").mapInPandas(rows, "history array<long>, word long, count long, discounted double")

    def weights(self, n: int) -> DataFrame:
        """history, total and left_over: a seen n-gram has the probability
        discounted / total, the words not seen share left_over."""
        d = self.d[n]

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for blob in pdf["body"]:
                    *columns, runs, _, count = unpack(blob)
                    head = np.repeat(np.arange(len(runs)), runs)
                    times, spared = (np.bincount(head, x, len(runs)) for x in (count, count - discounted(count, d)))
                    yield pd.DataFrame({"history": list(np.stack(columns, 1)), "times": times, "spared": spared})

        parts = self.tables[n].select("body").mapInPandas(rows, "history array<long>, times double, spared double")
        summed = parts.groupBy("history").agg(F.sum("times").alias("times"), F.sum("spared").alias("spared"))
        rich = F.col("spared") > 0
        return summed.select("history", F.when(rich, F.col("times")).otherwise(F.col("times") + 1).alias("total"), F.when(rich, F.col("spared")).otherwise(1.0).alias("left")).select(
            "history", "total", (F.col("left") / F.col("total")).alias("left_over")
        )


# -- chunks -----------------------------------------------------------------


class Numbering(dict):
    """Numbers words as they are first seen."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def chunk_row(task: int, part: int, docs: list, tokens: list[np.ndarray], words: dict, buckets: int) -> dict:
    """Local ids are given by bucket, so that answers need no further order."""
    hashes = np.array([xxhash.xxh64_intdigest(w, 0) for w in words], "<u8")
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    lengths = np.array([len(t) for t in tokens], np.int64)
    return {
        "chunk": task << 32 | part,
        "doc_ids": np.array([0 if d is None else d for d, _ in docs], "<i8").tobytes(),
        "no_id": np.array([d is None for d, _ in docs], np.uint8).tobytes(),
        "held": np.array([h for _, h in docs], np.uint8).tobytes(),
        "tokens": pack(lengths, rank[np.concatenate(tokens)], np.bincount(bucket, minlength=buckets), rank[:2]),
        "hashes": hashes[order].tobytes(),
    }


CHUNK_SCHEMA = "chunk long, doc_ids binary, no_id binary, held binary, tokens binary, hashes binary"


def make_chunks(chunk: int, buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, part = TaskContext.get().partitionId(), 0
        docs, tokens, size, words = [], [], 0, Numbering({END: 0, START: 1})
        for pdf in batches:
            for d, held, text in zip(pdf["doc_id"], pdf["held"], pdf["text"]):
                w = text.encode("utf-8", "surrogatepass").lower().split()
                docs.append((None if pd.isna(d) else int(d), bool(held)))
                tokens.append(np.fromiter(map(words.__getitem__, w), np.int32, len(w)) if w else np.zeros(0, np.int32))
                tokens[-1] = np.append(tokens[-1], np.int32(0))
                size += len(w) + 1
                if size >= chunk:
                    yield pd.DataFrame([chunk_row(task, part, docs, tokens, words, buckets)])
                    part += 1
                    docs, tokens, size, words = [], [], 0, Numbering({END: 0, START: 1})
                    give_back()
        if docs:
            yield pd.DataFrame([chunk_row(task, part, docs, tokens, words, buckets)])

    return run


@dataclass
class Level:
    """Distinct n-grams of a chunk by (history, word): local ids of word and
    history, of the n-gram without its first word, a hash of each, and for each
    token the n-gram that ends there (-1: too near to the document's start)."""

    history: np.ndarray | None
    word: np.ndarray
    suffix: np.ndarray | None
    hashes: np.ndarray | None
    of_token: np.ndarray


class Chunk:
    def __init__(self, row):
        self.lengths, ids, self.sizes, (self.end, self.start) = unpack(row.tokens)
        self.ids = ids.astype(np.int32)
        self.held = np.frombuffer(row.held, np.uint8).astype(bool)
        ends = np.cumsum(self.lengths)
        self.begins = (ends - self.lengths)[self.lengths > 0]
        words = np.arange(int(self.sizes.sum()), dtype=np.int32)
        self.levels = [Level(None, words, None, None, self.ids)]
        #: By order: training counts in the corpus of this chunk's n-grams.
        self.count: dict[int, np.ndarray] = {}
        #: By order: n-grams that no other chunk has.
        self.private: dict[int, np.ndarray] = {}
        self.number = np.zeros(0, np.int64)

    def level(self, n: int) -> Level:
        while len(self.levels) < n:
            below = self.levels[-1]
            before = np.empty(len(self.ids), np.int64)
            before[1:] = below.of_token[:-1]
            before[self.begins] = self.start if len(self.levels) == 1 else -1  # the start stands before a document once
            at = np.flatnonzero(before >= 0).astype(np.int32)
            keys, first, inverse = distinct(before[at] << 32 | self.ids[at])
            history, word = (keys >> 32).astype(np.int32), (keys & MASK).astype(np.int32)
            of = np.full(len(self.ids), -1, np.int32)
            of[at] = inverse
            del before, inverse, keys
            with np.errstate(over="ignore"):
                hashes = mix(below.hashes[history] * np.uint64(0x9E3779B97F4A7C15) + self.levels[0].hashes[word])
            self.levels.append(Level(history, word, below.of_token[at[first]], hashes, of))
        return self.levels[n - 1]

    def training(self, n: int) -> np.ndarray:
        """Training counts of the n-grams in this chunk."""
        of = self.level(n).of_token
        return np.bincount(of[(of >= 0) & ~np.repeat(self.held, self.lengths)], minlength=len(self.level(n).word))

    def columns(self, n: int, which: np.ndarray) -> list[np.ndarray]:
        """Numbers of the words of some n-grams."""
        lv = self.level(n)
        return ([] if n == 1 else self.columns(n - 1, lv.history[which])) + [self.number[lv.word[which]]]

    def times(self, n: int) -> np.ndarray:
        """How often each n-gram is a history in training: its count, and for
        the document start as often as a document ends."""
        c = self.count[n]
        return np.where(np.arange(len(c)) == self.start, c[self.end], c) if n == 1 else c

    def word_layout(self) -> Iterator[tuple[int, slice]]:
        ends = np.cumsum(self.sizes)
        for k in np.flatnonzero(self.sizes).tolist():
            yield k, slice(int(ends[k] - self.sizes[k]), int(ends[k]))

    def layout(self, n: int, buckets: int, hot: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Where the n-grams are asked about: for each bucket its n-grams, by
        history, and the histories that may have n-grams there. Not asked are
        those whose history or shortened n-gram training has not, and those of
        private histories."""
        lv, below, times = self.level(n), self.level(n - 1), self.times(n - 1)
        there = times > 0
        if n - 1 in self.private:
            there &= ~self.private[n - 1]
        home = (below.hashes >> np.uint64(1)).astype(np.int64)
        spread = np.minimum(buckets, np.maximum(1, -(-times // hot)))
        narrow = np.int16 if buckets < 1 << 15 else np.int64
        base = (home % buckets).astype(narrow)
        grams = np.flatnonzero(there[lv.history] & (self.count[n - 1][lv.suffix] > 0))
        bucket = base[lv.history[grams]]
        wide = np.flatnonzero(spread[lv.history[grams]] > 1)
        if len(wide):
            walk = (mix(self.levels[0].hashes ^ np.uint64(0x5BD1E995)) >> np.uint64(1)).astype(np.int64)
            of = lv.history[grams[wide]]
            bucket[wide] = (home[of] + walk[lv.word[grams[wide]]] % spread[of]) % buckets
        own = lv.history[np.append(True, lv.history[1:] != lv.history[:-1])] if len(lv.history) else lv.history
        own = own[there[own]]
        asked = np.repeat(own, spread[own])
        step = np.arange(len(asked)) - np.repeat(np.cumsum(spread[own]) - spread[own], spread[own])
        where = ((base[asked] + step) % buckets).astype(narrow)
        by_gram, by_ask = np.argsort(bucket, kind="stable"), np.argsort(where, kind="stable")
        cut = np.searchsorted(bucket[by_gram], np.arange(buckets + 1))
        ask_cut = np.searchsorted(where[by_ask], np.arange(buckets + 1))
        for k in range(buckets):
            if ask_cut[k] < ask_cut[k + 1]:
                yield k, grams[by_gram[cut[k] : cut[k + 1]]], asked[by_ask[ask_cut[k] : ask_cut[k + 1]]]

    def own_grams(self, n: int) -> np.ndarray:
        """The n-grams of private histories."""
        return np.flatnonzero(self.private[n - 1][self.level(n).history]) if n - 1 in self.private else np.zeros(0, np.int64)

    def own_table(self, n: int) -> bytes | None:
        """The model's rows for private histories; ``hear`` came before."""
        own = self.own_grams(n)
        own = own[self.count[n][own] > 0]
        if not len(own):
            return None
        lv = self.level(n)
        heads, runs = np.unique(lv.history[own], return_counts=True)
        return pack(*self.columns(n - 1, heads), runs, self.number[lv.word[own]], self.count[n][own])

    def hear_words(self, answers: list) -> None:
        found = {a["bucket"]: a["body"] for a in answers}
        self.count[1], self.number = np.zeros(int(self.sizes.sum()), np.int64), np.zeros(int(self.sizes.sum()), np.int64)
        for k, at in self.word_layout():
            self.count[1][at], self.number[at] = unpack(found[k])
        self.levels[0].hashes = mix(self.number.view(np.uint64))

    def hear(self, n: int, answers: list, buckets: int, hot: int) -> np.ndarray:
        """Takes in the counts of order n; returns the whole numbers of each
        history, a row each."""
        found = {a["bucket"]: a["body"] for a in answers} if answers is not None else {}  # no document is so long
        lv = self.level(n)
        self.count[n] = np.zeros(len(lv.word), np.int64)
        self.private[n] = np.zeros(len(lv.word), bool)
        stats = np.zeros((len(self.level(n - 1).word), 2 * K + 1), np.int32 if n > 2 else np.int64)
        for k, grams, asked in self.layout(n, buckets, hot):
            self.count[n][grams], self.private[n][grams], numbers = unpack(found.pop(k))
            stats[asked] += numbers.reshape(2 * K + 1, -1).T
        own = self.own_grams(n)
        if len(own):
            self.private[n][own] = True
            self.count[n][own] = self.training(n)[own]
            heads, head = np.unique(lv.history[own], return_inverse=True)
            stats[heads] = history_numbers(head, self.count[n][own], self.count[n - 1][lv.suffix[own]], len(heads))
        return stats


def in_portions(rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
    """Frames of about ``YIELD`` bytes, so that few blobs are held at a time."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["body"])
        if size >= YIELD:
            yield pd.DataFrame(held)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held)


ASK = "bucket int, chunk long, body binary"
ANSWER = "chunk long, bucket int, body binary, stats array<long>"


def deal_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows(pdf: pd.DataFrame) -> Iterator[dict]:
        for row in pdf.itertuples():
            c, hashes = Chunk(row), np.frombuffer(row.hashes, "<i8")
            train = c.training(1)
            for k, at in c.word_layout():
                yield {"bucket": k, "chunk": row.chunk, "body": pack(hashes[at], train[at])}

    for pdf in batches:
        yield from in_portions(rows(pdf))
        give_back()


def number_stats(total: np.ndarray) -> np.ndarray:
    """Tokens, types, and the numbers of types seen 1..K+1 times."""
    seen = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2]
    return np.concatenate(([total.sum(), (total > 0).sum()], seen)).astype(np.int64)


def add_words(buckets: int):
    """Answers each chunk with count and number of its words."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asks = [unpack(b) for b in pdf["body"]]
        words, inverse = np.unique(np.concatenate([a[0] for a in asks]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([a[1] for a in asks]), len(words)).astype(np.int64)
        number = np.empty(len(words), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(words))
        number = number * buckets + key[0]  # frequent words have small numbers
        out = [(STATS, key[0], b"", number_stats(total)), (MODEL, key[0], pack(words, number, total), None)]
        at = 0
        for chunk, (h, _) in zip(pdf["chunk"], asks):
            part = inverse[at : at + len(h)]
            at += len(h)
            out.append((chunk, key[0], pack(total[part], number[part]), None))
        return pd.DataFrame(out, columns=["chunk", "bucket", "body", "stats"])

    return run


def deal(n: int, buckets: int, hot: int):
    def rows(pdf: pd.DataFrame) -> Iterator[dict]:
        for row in pdf.itertuples():
            c = Chunk(row)
            c.hear_words(row.a1)
            for m in range(2, n):
                c.hear(m, getattr(row, f"a{m}"), buckets, hot)
            lv, train, low = c.level(n), c.training(n), c.count[n - 1]
            own = c.own_grams(n)
            if len(own):
                yield {"bucket": row.chunk % buckets, "chunk": STATS, "body": pack(number_stats(train[own]))}
            for k, grams, asked in c.layout(n, buckets, hot):
                runs = np.diff(np.searchsorted(lv.history[grams], np.append(asked, MASK)))
                body = pack(*c.columns(n - 1, asked), runs, c.number[lv.word[grams]], train[grams], low[lv.suffix[grams]])
                yield {"bucket": k, "chunk": row.chunk, "body": body}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from in_portions(rows(pdf))
            give_back()

    return run


def add(n: int):
    """Answers each chunk with the counts of its n-grams and, for each history,
    how many of its n-grams here were seen 1..K times, and what the seen ones'
    shortened n-grams count (see ``lower_mass``)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["chunk"] == STATS
        out = [(STATS, key[0], b"", unpack(b)[0]) for b in pdf["body"][own]]
        pdf = pdf[~own]
        asks = [unpack(b) for b in pdf["body"]]
        if not asks:
            return pd.DataFrame(out, columns=["chunk", "bucket", "body", "stats"])
        columns = [np.concatenate([a[i] for a in asks]) for i in range(n - 1)]
        runs = np.concatenate([a[n - 1] for a in asks])
        word, train, low = (np.concatenate([a[n + i] for a in asks]) for i in range(3))
        sizes = [(len(a[n - 1]), len(a[n])) for a in asks]
        del asks
        of_ask, first_ask = numbered(*columns)
        head = np.repeat(of_ask, runs)
        of_gram, first = numbered(head, word)
        total = np.bincount(of_gram, train, len(first)).astype(np.int64)
        alone = np.bincount(of_gram, minlength=len(first)) == 1
        head, suffix, word = head[first], low[first], word[first]
        del low, train
        heads = len(first_ask)
        stats = history_numbers(head, total, suffix, heads)
        seen = total > 0
        many = np.bincount(head[seen], minlength=heads)
        live = np.flatnonzero(many)
        out.append((STATS, key[0], b"", number_stats(total)))
        out.append((MODEL, key[0], pack(*[c[first_ask[live]] for c in columns], many[live], word[seen], total[seen]), None))
        at = gram = 0
        for chunk, (a, g) in zip(pdf["chunk"], sizes):
            of = of_gram[gram : gram + g]
            out.append((chunk, key[0], pack(total[of], alone[of], stats[of_ask[at : at + a]].T.reshape(-1)), None))
            at, gram = at + a, gram + g
        give_back()
        return pd.DataFrame(out, columns=["chunk", "bucket", "body", "stats"])

    return run


# -- scores -----------------------------------------------------------------


def token_probabilities(c: Chunk, model: Model, stats: dict[int, np.ndarray], order: int) -> np.ndarray:
    """P(word | history) of each token, by recursion over the orders: the
    discounted n-gram if it was seen, else the back-off weight times the
    probability of the n-gram without its first word."""
    denominator = {1: np.float64(model.unigrams.total)}
    d = {1: model.unigrams.d} | model.d

    def probability(n: int) -> np.ndarray:
        """Of the chunk's distinct n-grams."""
        if n == 1:
            return model.unigrams.p(c.count[1])
        shorter = probability(n - 1)
        lv, below, times = c.level(n), c.level(n - 1), c.times(n - 1)
        total, left = share(times, stats[n][:, :K], d[n])
        denominator[n] = total
        mass = lower_mass(stats[n][:, K:], d[n - 1]) / (denominator[1] if n == 2 else denominator[n - 1][below.suffix])
        weight = np.where(times > 0, left / np.maximum(1.0 - mass, 1e-300), 1.0)
        own = shorter[lv.suffix]
        found = np.where(c.count[n] > 0, discounted(c.count[n], d[n]) / total[lv.history], weight[lv.history] * own)
        of = lv.of_token
        at = of >= 0
        tokens[at] = found[of[at]]
        return found

    tokens = np.zeros(len(c.ids))
    if order == 1:
        return model.unigrams.p(c.count[1])[c.ids]
    probability(order)
    return tokens


SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, order int, body binary"


def score_chunks(model: Model, order: int, hot: int):
    unigrams, d, buckets = model.unigrams, model.d, model.buckets
    light = Model(buckets, unigrams, d)  # without the tables, which do not travel

    def score(row) -> Iterator[pd.DataFrame]:
        c = Chunk(row)
        c.hear_words(row.a1)
        stats = {n: c.hear(n, getattr(row, f"a{n}"), buckets, hot) for n in range(2, order + 1)}
        for lv in c.levels:
            lv.hashes = None  # all is heard
        give_back()
        n, doc = len(c.lengths), np.repeat(np.arange(len(c.lengths), dtype=np.int32), c.lengths)
        log = np.log10(token_probabilities(c, light, stats, order))
        ids = np.frombuffer(row.doc_ids, "<i8")
        yield pd.DataFrame(
            {
                "doc_id": pd.Series(pd.array(ids, "Int64")).mask(np.frombuffer(row.no_id, np.uint8).astype(bool)),
                "held_out": c.held,
                "n_tokens": c.lengths,
                "n_known": np.bincount(doc, c.count[1][c.ids] > 0, n).astype(np.int64),
                "train_tokens": unigrams.tokens,
                "base_score": np.bincount(doc, unigrams.base(c.count[1])[c.ids], n),
                "score": np.bincount(doc, log, n),
                "order": pd.Series(pd.array([None] * n, "Int32")),
                "body": None,
            }
        )
        for m in range(3, order + 1):
            body = c.own_table(m)
            if body is not None:
                yield pd.DataFrame({"order": pd.array([m], "Int32"), "body": [body]}).reindex(columns=[x.split()[0] for x in SCORE_SCHEMA.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                yield from score(row)
                give_back()

    return run


def held_out(key: str = "doc_id"):
    """crc32 of the key as text, modulo 5, is 1. A null key counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


@contextlib.contextmanager
def chunk_by_chunk(spark: SparkSession):
    """Tables are read, and Python workers get chunks, a row of megabytes at a time."""
    before = {name: spark.conf.get(name) for name in ONE_ROW}
    for name in ONE_ROW:
        spark.conf.set(name, "1")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def by_chunk(answers: DataFrame, name: str, buckets: int) -> DataFrame:
    """The answers of each chunk, dealt as the chunk tables are."""
    return answers.where("chunk >= 0").select("chunk", "bucket", "body").repartition(buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "body")).alias(name))


def corpus_numbers(answers: DataFrame) -> np.ndarray:
    """The sums of the buckets' statistics: K + 3 rows reach the driver."""
    out = np.zeros(K + 3, np.int64)
    for r in answers.where(F.col("chunk") == STATS).select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        out[r["pos"]] = r["n"]
    return out


def train_and_score(docs: DataFrame, *, order: int = ORDER, chunk: int = CHUNK, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> tuple[Model, DataFrame]:
    """The model and the scores of ``score_documents``."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long"), held_out().alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    buckets = max(1, round(size / bucket_bytes))
    model = Model(buckets)
    # Bucketed tables: chunks are read with answers again and again, and never
    # moved. They are managed tables below the shared folder, each dropped when
    # the next one has taken in the answers to it.
    own = "fabula_" + uuid.uuid4().hex
    spark.sql(f"CREATE DATABASE {own} LOCATION '{new_folder(spark, 'katz')}'")

    def keep(df: DataFrame, name: str, bucketed: bool) -> DataFrame:
        rows = df.write.options(**BLOBS)
        with shuffles_dropped(spark):
            (rows.bucketBy(buckets, "chunk") if bucketed else rows).saveAsTable(f"{own}.{name}")
        return spark.table(f"{own}.{name}")

    try:
        chunks = keep(base.mapInPandas(make_chunks(chunk, buckets), CHUNK_SCHEMA), "chunks_0", True)
        for n in range(1, order + 1):
            if n == 1:
                asked = chunks.select("chunk", "held", "tokens", "hashes").mapInPandas(deal_words, ASK)
                answers = asked.groupBy("bucket").applyInPandas(add_words(buckets), ANSWER)
            else:
                asked = chunks.drop("doc_ids", "no_id").mapInPandas(deal(n, buckets, hot), ASK)
                answers = asked.groupBy("bucket").applyInPandas(add(n), ANSWER)
            with chunk_by_chunk(spark):
                answers = keep(answers, f"answers_{n}", False) if n < order else written(answers, f"order-{n}", **BLOBS)
            numbers = corpus_numbers(answers)
            if n == 1:
                model.unigrams = Unigrams(int(numbers[0]), int(numbers[1]), np.concatenate(([0], numbers[2:])))
            else:
                model.d[n] = discounts(np.concatenate(([0], numbers[2:])))
            model.tables[n] = answers.where(F.col("chunk") == MODEL).select("body")
            if n < order:
                heard = chunks.drop("hashes").join(by_chunk(answers, f"a{n}", buckets).hint("shuffle_hash"), "chunk", "left")
                with chunk_by_chunk(spark):
                    model.tables[n] = written(model.tables[n], f"order-{n}", **BLOBS)
                    chunks = keep(heard, f"chunks_{n}", True)
                spark.sql(f"DROP TABLE {own}.chunks_{n - 1}")
                spark.sql(f"DROP TABLE {own}.answers_{n}")
        out = None
        for turn in range(TURNS):
            mine = F.pmod("chunk", F.lit(TURNS)) == turn
            heard = chunks.where(mine).drop("hashes").join(by_chunk(answers.where(mine), f"a{order}", buckets).hint("shuffle_hash"), "chunk", "left")
            with chunk_by_chunk(spark):
                part = written(heard.mapInPandas(score_chunks(model, order, hot), SCORE_SCHEMA), "scores", **BLOBS)
            out = part if out is None else out.union(part)
        for n in range(3, order + 1):
            model.tables[n] = model.tables[n].union(out.where(F.col("order") == n).select("body"))
        return model, out.where("body is null").drop("order", "body")
    finally:
        spark.sql(f"DROP DATABASE {own} CASCADE")


def score_documents(docs: DataFrame, **options) -> DataFrame:
    """Trains on the rows that are not held out and scores every row.

    Null and empty texts are one end token. Repeated rows are counted and
    scored as often as they stand; null keys are kept. Without training rows
    every token is unknown. An empty table gives an empty result. Only doc_id
    and text are read; other columns, whatever their names, are not. A text of
    any length is one document and is never cut; a chunk then is that long.
    """
    return train_and_score(docs, **options)[1]
