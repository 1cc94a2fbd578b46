"""SimHash near-duplicates by a self-join of the fingerprints' binary trie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.llm.names import unused
from fabula.operators.components import connected_components
from fabula.session import written

BITS = 64
SHINGLE = 3
SEED = 42
BLOCK = 1 << 16
#: Depth down to which Spark counts the trie's nodes (2**16 counts at most
#: reach the driver), and how many leaves the driver splits it into at most.
TOP_BITS = 16
MAX_LEAVES = 2048
#: Leaves are split until they hold so many fingerprints at most, and at least
#: into so many leaves, to have tasks for all cores. A fingerprint is sent once
#: for each leaf that the budget can reach, so more leaves cost more shuffle.
TARGET = 1 << 20
LEAST_LEAVES = 16
#: Node pairs with so few leaf pairs are compared directly.
DIRECT = 64


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 (seed 42) of the 3-word shingles, repeats included. ASCII letters
    are lower-cased; words are split at blanks and 0x09 to 0x0D, which is what
    ``bytes.split`` does. Fewer words give one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate(([0], np.cumsum(length[:-1] + 1)))
    end = (start + length)[SHINGLE - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[s:e], SEED) for s, e in zip(start.tolist(), end)), np.uint64, len(end))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit j is set if it is set in over half of the hashes; none: zero."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[k : k + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << j for j in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprint_column(text: str) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        out = np.fromiter((fingerprint(shingle_hashes(t)) for t in texts), np.uint64, len(texts))
        return pd.Series(out.view(np.int64))

    return prints(F.col(text))


# -- trie traversal ---------------------------------------------------------


def trie_join(a: np.ndarray, b: np.ndarray, same: bool, budget: int, depth: int, used: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the sorted unsigned arrays ``a`` and ``b`` within
    ``budget`` differing bits. The first ``depth`` bits are equal inside each
    array and differ in ``used`` places between the two. Node pairs are walked
    together, bits that differ are added up, and a pair over the budget is
    dropped with everything below it. same: a is b, and each pair comes once.
    """
    # A frontier is (a_lo, a_hi, b_lo, b_hi, used); all its pairs have one depth.
    stack = [(depth, np.array([[0, len(a), 0, len(b), used]], np.int64))]
    while stack:
        depth, f = stack.pop()
        if len(f) > BLOCK:  # memory stays bounded: halves go one after the other
            stack += [(depth, f[: len(f) // 2]), (depth, f[len(f) // 2 :])]
            continue
        leaves = (f[:, 1] - f[:, 0]) * (f[:, 3] - f[:, 2])
        done = (leaves <= DIRECT) | (depth >= BITS)
        if done.any():
            yield from compare(a, b, f[done], same, budget)
        f = f[~done]
        if not len(f):
            continue
        bit = np.uint64(1 << (BITS - 1 - depth))
        low = bit - np.uint64(1)
        split = []
        for arr, lo, hi in ((a, f[:, 0], f[:, 1]), (b, f[:, 2], f[:, 3])):
            node = arr[lo] & ~(low | bit)
            split.append(np.clip(np.searchsorted(arr, node | bit), lo, hi))
        am, bm = split
        own = same & (f[:, 0] == f[:, 2]) & (f[:, 1] == f[:, 3])
        kids = [
            (f[:, 0], am, f[:, 2], bm, f[:, 4], None),
            (am, f[:, 1], bm, f[:, 3], f[:, 4], None),
            (f[:, 0], am, bm, f[:, 3], f[:, 4] + 1, None),
            (am, f[:, 1], f[:, 2], bm, f[:, 4] + 1, ~own),
        ]
        nxt = []
        for x0, x1, y0, y1, u, also in kids:
            keep = (x0 < x1) & (y0 < y1) & (u <= budget)
            if also is not None:
                keep &= also
            nxt.append(np.stack([x0, x1, y0, y1, u], 1)[keep])
        stack.append((depth + 1, np.concatenate(nxt)))


def compare(a: np.ndarray, b: np.ndarray, f: np.ndarray, same: bool, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k in range(0, len(f), BLOCK):
        g = f[k : k + BLOCK]
        wa, wb = g[:, 1] - g[:, 0], g[:, 3] - g[:, 2]
        n = wa * wb
        at = np.repeat(np.arange(len(g)), n)
        off = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        i, j = g[at, 0] + off // wb[at], g[at, 2] + off % wb[at]
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        if same:
            near &= i < j
        if near.any():
            yield i[near], j[near]


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Root of each of n nodes under the pairs: links inside one task are kept
    as a forest, so that a dense group does not leave the task as all its pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            ri, rj = root[i], root[j]
            if (open_ := ri != rj).sum() == 0:
                break
            hi, lo = np.maximum(ri, rj)[open_], np.minimum(ri, rj)[open_]
            np.minimum.at(root, hi, lo)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def split_top(counts: np.ndarray, target: int, max_leaves: int, least: int = 1) -> list[tuple[int, int]]:
    """Leaves (depth, prefix) of the top of the trie: the fullest node is split
    until there are ``least`` leaves and each holds ``target`` fingerprints at
    most, or until leaves run out."""
    import heapq

    sums = [counts]
    while len(sums[-1]) > 1:
        sums.append(sums[-1].reshape(-1, 2).sum(1))
    sums = sums[::-1]  # sums[d][prefix]
    heap, leaves = [(-int(sums[0][0]), 0, 0)], []
    while heap:
        n, d, p = heapq.heappop(heap)
        few = len(heap) + len(leaves) + 1 < least
        if (-n <= target and not few) or -n <= 1 or d == len(sums) - 1 or len(heap) + len(leaves) + 2 > max_leaves:
            leaves.append((d, p))
        else:
            for q in (2 * p, 2 * p + 1):
                if sums[d + 1][q]:
                    heapq.heappush(heap, (-int(sums[d + 1][q]), d + 1, q))
    return leaves


def leaf_pairs(leaves: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """Pairs of leaves whose common depth differs in ``budget`` bits at most."""
    pairs = []
    d = np.array([x[0] for x in leaves], np.int64)
    p = np.array([x[1] for x in leaves], np.int64)
    for i in range(len(leaves)):
        m = np.minimum(d[i], d[i:])
        diff = np.bitwise_count((p[i] >> (d[i] - m)) ^ (p[i:] >> (d[i:] - m)))
        pairs += [(i, i + int(k)) for k in np.flatnonzero(diff <= budget)]
    return pairs


def link_fingerprints(prints: DataFrame, *, budget: int = 3, target: int = TARGET) -> DataFrame:
    """Links (src, dst) that connect all distinct fingerprints of the column
    ``fp`` (long) within ``budget`` differing bits.

    The links span the same groups as all near pairs do. A fingerprint goes to
    each task that joins its trie leaf with a leaf that the budget can reach.
    """
    spark = prints.sparkSession
    top = F.shiftrightunsigned("fp", BITS - TOP_BITS).cast("int")
    counts = np.zeros(1 << TOP_BITS, np.int64)
    for r in prints.groupBy(top.alias("p")).count().toLocalIterator():  # 65,536 rows at most
        counts[r["p"]] = r["count"]
    if not counts.any():
        return spark.createDataFrame([], "src long, dst long")
    leaves = split_top(counts, target, MAX_LEAVES, LEAST_LEAVES)
    pairs = leaf_pairs(leaves, budget)
    of = np.zeros(1 << TOP_BITS, np.int32)
    for k, (d, p) in enumerate(leaves):
        of[p << (TOP_BITS - d) : (p + 1) << (TOP_BITS - d)] = k
    tasks: list[list[int]] = [[] for _ in leaves]
    for n, (i, j) in enumerate(pairs):
        tasks[i].append(n)
        if i != j:
            tasks[j].append(n)
    sent = [np.array(t, np.int32) for t in tasks]
    ends = np.array(pairs, np.int32)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy()
            leaf = of[fp.view(np.uint64) >> np.uint64(BITS - TOP_BITS)]
            n = np.array([len(sent[x]) for x in leaf], np.int64)
            if len(fp):
                yield pd.DataFrame({"task": np.concatenate([sent[x] for x in leaf]), "leaf": np.repeat(leaf, n), "fp": np.repeat(fp, n)})

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = ends[key[0]]
        leaf, fp = pdf["leaf"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
        a = np.sort(fp[leaf == i])
        b = a if i == j else np.sort(fp[leaf == j])
        depth = min(leaves[i][0], leaves[j][0])
        differ = int(leaves[i][1] >> (leaves[i][0] - depth)) ^ int(leaves[j][1] >> (leaves[j][0] - depth))
        if not len(a) or not len(b):
            return pd.DataFrame({"src": np.zeros(0, np.int64), "dst": np.zeros(0, np.int64)})
        shift = 0 if i == j else len(a)
        nodes = a if i == j else np.concatenate([a, b])
        found = trie_join(a, b, bool(i == j), budget, depth, differ.bit_count())
        root = spanning(len(nodes), ((x, y + shift) for x, y in found))
        at = np.flatnonzero(root != np.arange(len(nodes)))
        return pd.DataFrame({"src": nodes[at].view(np.int64), "dst": nodes[root[at]].view(np.int64)})

    return prints.select("fp").mapInPandas(deal, "task int, leaf int, fp long").groupBy("task").applyInPandas(join, "src long, dst long")


def simhash_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", budget: int = 3) -> DataFrame:
    """Fingerprint and component of every row: (key, fingerprint, component_id).

    Null and empty texts have the fingerprint zero and link like any other.
    component_id is the smallest key that can be reached by links, null only
    if no key of the group is set. Repeated rows give repeated results; an
    empty table an empty one; other columns are not read.
    """
    return labelled_groups(docs, key=key, text=text, budget=budget).drop("component")


def labelled_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", budget: int = 3) -> DataFrame:
    """``simhash_groups`` with the label ``component``, a fingerprint of the
    group. Unlike component_id it tells groups apart where a key stands in
    several of them, or none is set."""
    prints = written(docs.select(F.col(key).alias("doc_id"), fingerprint_column(text).alias("fp")), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    parts = connected_components(written(link_fingerprints(nodes, budget=budget), "links"))
    labelled = nodes.join(parts, nodes["fp"] == parts["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of = written(labelled.join(ids, "component").select("fp", "component", "component_id"), "classes")
    return prints.join(of, "fp").select(
        F.col("doc_id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component"
    )


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", budget: int = 3) -> DataFrame:
    """One row of each group: that of the least key, and where several rows
    have this key, one of them (the least text of their least fingerprint).
    Rows without a key stay only where no row of their group has one, one of
    them. Columns stay as they were, whatever their names."""
    own, of, print_, turn = unused(docs.columns, "_key", "_of", "_print", "_r")
    # Fingerprints are made twice, so that the texts need not move with them.
    # component_id is the group's least key; the head's rows are among those that have it.
    least = F.col(key).eqNullSafe(F.col("component_id"))
    groups = labelled_groups(docs, key=key, text=text, budget=budget).where(least)
    rows = groups.groupBy("component", F.col("component_id").alias(own), F.col("fingerprint").alias("print")).agg(F.count(F.lit(1)).alias("n"))
    heads = written(rows.groupBy("component", own).agg(F.min("print").alias(of), F.min_by("n", "print").alias("n")).drop("component"), "heads")
    marked = docs.withColumn(print_, F.lpad(F.lower(F.hex(fingerprint_column(text))), 16, "0"))
    same = F.col(key).eqNullSafe(F.col(own)) & (F.col(print_) == F.col(of))
    kept = marked.join(heads.where("n = 1").drop("n"), same, "left_semi")
    again = heads.where("n > 1").drop("n")
    if not again.isEmpty():
        first = Window.partitionBy(key, print_).orderBy(F.col(text).asc_nulls_first())
        repeated = marked.join(again, same, "left_semi").withColumn(turn, F.row_number().over(first)).where(F.col(turn) == 1).drop(turn)
        kept = kept.unionByName(repeated)
    return kept.drop(print_)
