"""Token sequences in training order, as fixed-stride binary shards.

A keyed Feistel network with cycle-walking permutes 0..n-1 and so gives every
sequence its global slot without a sort or a random table. Shard k holds the
slots [k * SHARD, (k + 1) * SHARD); each sequence takes ``length`` unsigned
16-bit little-endian ids, so slot s starts at byte (s mod SHARD) * 2 * length
of its shard and a run can be resumed at any slot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.session import new_folder, written

LENGTH = 512
SHARD = 8192
ROUNDS = 6
#: The shards are written in so many turns, each with its own shuffle, dropped after it.
TURNS = 4
#: Characters that are encoded at a time.
SLICE = 1 << 20
MASK64 = (1 << 64) - 1


def mix(x: np.ndarray, key: int) -> np.ndarray:
    """The round function: a keyed 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(key & MASK64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def feistel(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Slots of the indexes x in 0..n-1 (or the way back). The network works on
    the smallest even number of bits that holds n; a value that falls outside
    is walked on, which ends because the network is a permutation."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [int(k) for k in np.random.Generator(np.random.PCG64(key)).integers(0, 1 << 63, ROUNDS)]

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> np.uint64(half), v & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                a, b = b ^ (mix(a, k) & mask), a
            else:
                a, b = b, a ^ (mix(b, k) & mask)
        return (a << np.uint64(half)) | b

    out = once(np.asarray(x, np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def sequences(docs: DataFrame, encode, *, length: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Written table (task, local, doc_id, part, n_tokens, ids): the ids of each
    document with ``end_id`` after them, cut to ``length``. ``task`` and
    ``local`` number the rows as they were written. encode: makes, in the
    task, a function from a list of texts to lists of ids."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, task, local = encode(), TaskContext.get().partitionId(), 0
        for pdf in batches:
            keys, texts, first = pdf["doc_id"].tolist(), pdf["text"].tolist(), 0
            while first < len(texts):  # few token lists are in memory at a time
                end, chars = first, 0
                while end < len(texts) and chars < SLICE:
                    chars += len(texts[end])
                    end += 1
                doc, part, size, blob = [], [], [], []
                for d, ids in zip(keys[first:end], run(texts[first:end])):
                    ids = np.append(np.asarray(ids, np.uint16), np.uint16(end_id))
                    for p in range(0, len(ids), length):
                        piece = ids[p : p + length]
                        doc.append(d)
                        part.append(p // length)
                        size.append(len(piece))
                        blob.append(piece.astype("<u2").tobytes())
                at = np.arange(local, local + len(doc))
                local, first = local + len(doc), end
                yield pd.DataFrame({"task": task, "local": at, "doc_id": pd.array(doc, "Int64"), "part": part, "n_tokens": size, "ids": blob})

    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return written(base.mapInPandas(cut, "task int, local long, doc_id long, part int, n_tokens int, ids binary"), "sequences", "zstd")


def open_folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_in_order(seqs: DataFrame, path: str, *, length: int = LENGTH, pad_id: int, key: int, shard: int = SHARD) -> DataFrame:
    """Writes the shards and returns the manifest: slot, shard, byte_offset,
    doc_id, part, n_tokens and crc32 of the stored bytes.

    A shard's file is written beside its place and renamed, so a task that
    runs twice leaves the same whole file. An empty table writes nothing.
    """
    spark = seqs.sparkSession
    counts = {r["task"]: r["count"] for r in seqs.groupBy("task").count().collect()}  # a row per writing task
    total, before = 0, {}
    for t in sorted(counts):
        before[t] = total
        total += counts[t]

    def slots(turn: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    index = pdf["task"].map(before).to_numpy(np.int64) + pdf["local"].to_numpy(np.int64)
                    slot = feistel(index, total, key)
                    out = pdf[["doc_id", "part", "n_tokens", "ids"]].assign(doc_id=pdf["doc_id"].astype("Int64"), slot=slot, shard=slot // shard)
                    yield out[out["shard"] % TURNS == turn]

        return run

    def write(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        stride = 2 * length
        pad = np.full(length, pad_id, "<u2").tobytes()
        records = [b + pad[len(b) :] for b in pdf["ids"]]
        system, folder = open_folder(path)
        system.create_dir(folder, recursive=True)
        place = f"{folder}/{shard_name(int(k[0]))}"
        own = f"{place}.{TaskContext.get().taskAttemptId()}.part"
        with system.open_output_stream(own) as out:
            out.write(b"".join(records))
        system.move(own, place)
        return pd.DataFrame(
            {
                "slot": pdf["slot"], "shard": pdf["shard"], "byte_offset": (pdf["slot"] - k[0] * shard) * stride, "doc_id": pdf["doc_id"].astype("Int64"),
                "part": pdf["part"], "n_tokens": pdf["n_tokens"], "crc32": [zlib.crc32(r) for r in records],
            }
        )

    rows = "doc_id long, part int, n_tokens int, ids binary, slot long, shard long"
    lines = "slot long, shard long, byte_offset long, doc_id long, part int, n_tokens int, crc32 long"
    if not total:
        return spark.createDataFrame([], lines)
    out = None
    for turn in range(TURNS):  # only a share of the shards is in a shuffle at a time
        dealt = seqs.mapInPandas(slots(turn), rows).repartition(max(1, total // (shard * TURNS)), "shard")  # about a shard a task
        done = written(dealt.groupBy("shard").applyInPandas(write, lines), "manifest")
        out = done if out is None else out.union(done)
    return out


def read_from(path: str, slot: int, n: int, *, length: int = LENGTH, shard: int = SHARD) -> Iterator[np.ndarray]:
    """Up to n sequences from a slot on, in order, by seeking."""
    system, folder = open_folder(path)
    stride = 2 * length
    while n > 0:
        place = f"{folder}/{shard_name(slot // shard)}"
        with system.open_input_file(place) as f:
            f.seek(slot % shard * stride)
            raw = f.read(min(n, shard - slot % shard) * stride)
        rows = len(raw) // stride
        yield from np.frombuffer(raw, "<u2").reshape(rows, length)
        if rows < min(n, shard - slot % shard):
            return
        slot, n = slot + rows, n - rows


def byte_bpe(name: str = "byte_bpe_50k.tiktoken"):
    """Encoder of a public byte-level vocabulary; ids below 50,256."""

    def make():
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [coder.encode_ordinary(t) for t in texts]

    return make


END_ID = 50256


def materialise(docs: DataFrame, path: str | None = None, *, length: int = LENGTH, key: int = 2024, shard: int = SHARD) -> DataFrame:
    """Tokenises all documents, writes them in training order and returns the
    manifest. A null text is an empty one: a sequence of the end id alone.
    Repeated rows and null keys are sequences of their own; an empty table
    gives an empty manifest; a text of any length is cut into sequences and
    lost nowhere; other columns, whatever their names, are not read."""
    seqs = sequences(docs, byte_bpe(), length=length, end_id=END_ID)
    return write_in_order(seqs, path or new_folder(docs.sparkSession, "shards"), length=length, pad_id=END_ID, key=key, shard=shard)
