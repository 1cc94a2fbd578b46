"""Alignment of two tokenizers' tokens over the bytes of each document.

Tokenizer A is a byte-level BPE of the ``tokenizers`` library, B a
SentencePiece model. A text is cut into units at places where neither lets a
token cross; for a new unit both libraries' spans (character offsets of A, the
proto's spans of B) give coarse cuts, and where characters of several bytes or
byte-fallback tokens stand in the way, the tokens' decoded bytes refine them.

Two tokens that end together have bytes of which one is a suffix of the other,
so the id pairs that can ever be linked follow from the two vocabularies: each
entry has as many suffixes as bytes. They are numbered once per worker; counts
over the corpus are arrays of that bounded length.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.session import written

#: A unit begins at a single space between two characters that are no space to
#: either tokenizer: A's pattern takes that space with what follows, and no
#: piece of B has a space behind another character.
CUT = re.compile(r"(?<=[^\s▁])(?= [^\s▁])")
#: Units that fit such a place at both ends.
JOINABLE = re.compile(r" [^\s▁](.*[^\s▁])?", re.DOTALL)
#: Units kept per generation (two generations), and the length of a kept one.
KEPT_UNITS = 300_000
KEPT_CHARS = 48
#: New units encoded as one text.
TOGETHER = 2048
#: Characters encoded between two hand-overs of results.
STEP = 1 << 20

Entry = tuple[int, int, str, bytes]


def default_a() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_b() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's letters: printable bytes of Latin-1 stand for
    themselves, the others for characters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Both tokenizers, their tokens' bytes and the numbers of linkable pairs."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_alphabet()
        self.a_bytes = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)}
        self.b_bytes = {}
        self.fallback = {i for i in range(self.b.vocab_size()) if self.b.is_byte(i)}
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            if i in self.fallback:
                self.b_bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (self.b.is_control(i) or self.b.is_unknown(i)):
                self.b_bytes[i] = piece.replace("▁", " ").encode()
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            if i not in self.fallback and re.search(r"[^▁]▁", piece):
                raise ValueError("a piece has a space behind another character; units would not be independent")
        self.pairs = linkable(self.a_bytes, self.b_bytes)
        self.a_length, self.a_name = by_id(self.a_bytes)
        self.b_length, self.b_name = by_id(self.b_bytes)
        self.is_fallback = np.zeros(len(self.b_length), bool)
        self.is_fallback[list(self.fallback)] = True
        self.young: dict[str, Entry | None] = {}
        self.old: dict[str, Entry | None] = {}

    # -- new units ---------------------------------------------------------

    def entries(self, units: list[str]) -> list[Entry | None]:
        """Alignment of units that begin with a space (which B adds by itself);
        None where a tokenizer's bytes are not the unit's. Units that may stand
        next to each other are encoded as one text."""
        out: list[Entry | None] = [None] * len(units)
        row = [k for k, u in enumerate(units) if JOINABLE.fullmatch(u)]
        for part in [row[x : x + TOGETHER] for x in range(0, len(row), TOGETHER)] + [[k] for k in sorted(set(range(len(units))) - set(row))]:
            for k, e in zip(part, self.aligned([units[k] for k in part])):
                out[k] = e
        return out

    def aligned(self, units: list[str]) -> list[Entry | None]:
        """Entries of neighbouring units of one text."""
        whole = "".join(units)
        raw = whole.encode()
        spans_a = self.a.encode(whole, add_special_tokens=False)
        pieces = self.b.encode(whole[1:], return_type="proto", num_threads=1).pieces
        ids_a, ids_b = spans_a.ids, [p.id for p in pieces]
        if b"".join([self.a_bytes.get(i, b"") for i in ids_a]) != raw or b"".join([self.b_bytes.get(i, b"") for i in ids_b]) != raw:
            half = len(units) // 2
            return self.aligned(units[:half]) + self.aligned(units[half:]) if half else [None]
        a, b = np.array(ids_a), np.array(ids_b)
        # Spans of A count characters, those of B bytes (without the first space).
        first = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        at_a = np.append(first[1:], len(raw))[np.array([e for _, e in spans_a.offsets]) - 1]
        at_b = np.array([p.end for p in pieces]) + 1
        # Inside a character of several bytes spans tell nothing: A repeats the
        # character's end, B has empty spans for all but the last fallback byte.
        at_a = refined(at_a, np.append(at_a[:-1] == at_a[1:], False), self.a_length[a])
        at_b = refined(at_b, (np.diff(at_b, prepend=-1) == 0) & self.is_fallback[b], self.b_length[b])
        end_a = np.flatnonzero(np.isin(at_a, at_b, assume_unique=True)) + 1
        end_b = np.searchsorted(at_b, at_a[end_a - 1]) + 1
        names_a, names_b = [self.a_name[i] for i in ids_a], [self.b_name[i] for i in ids_b]
        groups, i, k = [], 0, 0
        for j, m in zip(end_a.tolist(), end_b.tolist()):
            left = names_a[i] if j - i == 1 else ",".join(names_a[i:j])
            groups.append(f"{left}|{names_b[k]}" if m - k == 1 else f"{left}|{','.join(names_b[k:m])}")
            i, k = j, m
        links = np.searchsorted(self.pairs, a[end_a - 1] << 32 | b[end_b - 1]).astype(np.int32).tobytes()
        # Both tokenizers end a token where a unit ends, so a group ends there.
        unit_end = np.cumsum([len(u.encode()) for u in units])
        g = (np.searchsorted(at_a[end_a - 1], unit_end) + 1).tolist()
        n_a, n_b = np.diff(end_a[np.array(g) - 1], prepend=0).tolist(), np.diff(end_b[np.array(g) - 1], prepend=0).tolist()
        return [(n_a[k], n_b[k], ";".join(groups[x:y]), links[4 * x : 4 * y]) for k, (x, y) in enumerate(zip([0, *g], g))]

    # -- many texts --------------------------------------------------------

    def align(self, texts: list[str | None]) -> list[tuple[int, int, str, bytes]]:
        """Counts, groups and link numbers of each text."""
        cut = [CUT.split(" " + t) if t else [] for t in texts]
        young, old = self.young, self.old
        missing = set(chain.from_iterable(cut)).difference(young)
        young.update((u, old[u]) for u in missing if u in old)
        new = [u for u in missing if u not in old]
        young.update(zip(new, self.entries(new)))
        out = []
        for units in cut:
            found = [young[u] for u in units]
            if None in found:  # the bytes of units that differ could still add up
                found = self.entries(["".join(units)])
            if not found or found[0] is None:
                out.append((0, 0, "", b""))
                continue
            n_a, n_b, groups, links = zip(*found)
            out.append((sum(n_a), sum(n_b), ";".join(groups), b"".join(links)))
        for u in new:
            if len(u) > KEPT_CHARS:
                del young[u]
        if len(young) > KEPT_UNITS:
            self.young, self.old = {}, young
        return out


def linkable(a_bytes: dict[int, bytes], b_bytes: dict[int, bytes]) -> np.ndarray:
    """Sorted keys (a << 32 | b) of the entries of which one's bytes end in the
    other's: at most one key for each byte of an entry and each entry of the
    other vocabulary with these very bytes."""
    by: tuple[dict[bytes, list[int]], dict[bytes, list[int]]] = ({}, {})
    for side, names in zip(by, (a_bytes, b_bytes)):
        for i, x in names.items():
            side.setdefault(x, []).append(i)
    keys = {a << 32 | b for a, x in a_bytes.items() for k in range(len(x)) for b in by[1].get(x[k:], ())}
    keys |= {a << 32 | b for b, x in b_bytes.items() for k in range(len(x)) for a in by[0].get(x[k:], ())}
    return np.array(sorted(keys), np.int64)


def by_id(names: dict[int, bytes]) -> tuple[np.ndarray, list[str]]:
    """Lengths of the entries and their ids as text, by id."""
    size = np.zeros(max(names, default=-1) + 1, np.int64)
    for i, x in names.items():
        size[i] = len(x)
    return size, [str(i) for i in range(len(size))]


def refined(ends: np.ndarray, inside: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``ends`` in bytes, where those of tokens that end ``inside`` a character
    are counted on from the token before by the decoded bytes."""
    if not inside.any():
        return ends
    total = np.cumsum(sizes)
    known = np.maximum.accumulate(np.where(inside, 0, np.arange(1, len(ends) + 1)))
    base = np.concatenate(([0], ends - total))
    return np.where(inside, total + base[known], ends)


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def align_documents(docs: DataFrame, *, text: str = "text", key: str = "doc_id", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """The key, n_a, n_b, n_groups, groups and links of every row.

    ``groups`` is written ``a1,a2|b1;a3|b2,b3``: ids of A and of B between
    neighbouring byte offsets where tokens of both end. ``links`` holds, as
    int32 numbers into ``Aligner.pairs``, the pair of tokens that ends each
    group. Null and empty texts, and those whose tokens of A or B don't spell
    space and text, have no tokens. Special tokens' names are plain text. Each
    row counts by itself, repeated and keyless ones too; an empty table gives
    an empty one; other columns are not read. Texts of any length are encoded
    whole; memory is bounded by a batch of texts and the kept units.
    """
    a_path, b_path = a_path or default_a(), b_path or default_b()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = aligner(a_path, b_path)
        for pdf in batches:
            ends = np.cumsum(pdf["t"].str.len().fillna(0).to_numpy()) // STEP
            for _, part in pdf.groupby(ends):
                n_a, n_b, groups, links = zip(*tool.align(part["t"].tolist()))
                yield pd.DataFrame({"k": part["k"].to_numpy(), "n_a": n_a, "n_b": n_b, "n_groups": [len(x) // 4 for x in links], "groups": groups, "links": links})

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInPandas(
        run, f"k {kind}, n_a long, n_b long, n_groups long, groups string, links binary"
    )
    return found.withColumnRenamed("k", key)


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair and n: how many links of the whole table hold the pair. A task adds
    up what it reads and hands on a row per pair that it saw."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for pdf in batches:
            seen = np.bincount(np.frombuffer(b"".join(pdf["links"]), np.int32), minlength=len(total))
            seen[: len(total)] += total
            total = seen
        pairs = np.flatnonzero(total)
        yield pd.DataFrame({"pair": pairs.astype(np.int32), "n": total[pairs]})

    return aligned.select("links").mapInPandas(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def best_links(aligned: DataFrame, *, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``aligned`` with n_links, n_best (links whose pair is the most frequent
    one of its B id, ties included) and count_sum (over links). The counts pass
    through the driver: a number per linkable pair at most, which the two
    vocabularies bound (324,297 for the given ones), whatever the corpus."""
    tool = aligner(a_path or default_a(), b_path or default_b())
    counts = np.zeros(len(tool.pairs), np.int64)
    for r in link_counts(aligned).collect():
        counts[r["pair"]] = r["n"]
    b = tool.pairs & 0xFFFFFFFF
    top = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(top, b, counts)
    shared = aligned.sparkSession.sparkContext.broadcast((counts, counts == top[b]))

    @F.pandas_udf("n_best long, count_sum long")
    def add(blobs: pd.Series) -> pd.DataFrame:
        counts, best = shared.value
        each = [np.frombuffer(x, np.int32) for x in blobs]
        return pd.DataFrame({"n_best": [int(best[x].sum()) for x in each], "count_sum": [int(counts[x].sum()) for x in each]}, dtype=np.int64)

    rest = [c for c in aligned.columns if c != "links"]
    return aligned.withColumn("_best", add("links")).select(*rest, (F.octet_length("links") / 4).cast("long").alias("n_links"), "_best.*")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query; groups as their SHA-256."""
    aligned = align_documents(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    sha = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256")
    stored = written(aligned.select("doc_id", "n_a", "n_b", "n_groups", sha, "links"), "aligned", compression="zstd")
    return best_links(stored).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
