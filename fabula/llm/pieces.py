"""SentencePiece (BPE with byte fallback) encoding by a max-plus scan.

A merge never undoes another across a piece boundary, so a sequence of pieces
is the encoding of its text exactly if each neighbouring pair is the encoding
of the pair's own text. That turns encoding into a path in the lattice of all
pieces, with weight 0 for a pair that fits and minus infinity otherwise; there
is one finite path. A long document is cut into chunks. For a chunk, the
boundary states are the pieces that can lie across or end at its two ends, and
a max-plus transfer matrix says which entry state leads to which exit state.
Matrices are combined associatively (groups of ``FAN`` at a time, level by
level), each chunk gets its entry and exit, and is traced back on its own.

Before a blank that follows a non-blank, and around a line end, no merge
crosses. Units between such places are encoded alone: all new units of a batch
are merged in step, as rows of one array, and kept in a small table of recent
units. A text of one chunk is the plain case: its units are all of it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.session import written

NEG = -np.inf
NO_MERGE = float("inf")
CHUNK = 32_768
FAN = 64
UNIT_CACHE = 150_000
#: Units up to this length are merged in step, longer ones by a lattice walk.
IN_STEP = 64
PAIR_CACHE = 200_000
#: Characters of input after which a task hands on its results.
YIELD = 1 << 20
PREFIX = 4
#: Longer units are not kept.
UNIT_KEPT = 48
BLANK = "▁"
UNIT = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, their merge priority and the byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        usual = [i for i in range(len(self.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.pieces[i]: i for i in usual}
        self.rank = {self.pieces[i]: -sp.get_score(i) for i in usual}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.piece_bytes = [p.encode("utf-8") for p in self.pieces]
        for b, i in self.byte_id.items():
            self.piece_bytes[i] = bytes([b])
        self.longest = max(map(len, self.id), default=1)
        if any("\n" in p for p in self.id):
            raise ValueError("a piece has a line end; units would not be independent")
        if any(BLANK in p.strip(BLANK) or (p[-1:] == BLANK and p.strip(BLANK)) for p in self.id):
            raise ValueError("a piece has a blank after another character; units would not be independent")
        self._safe = re.compile(f"(?<=[^{BLANK}]){BLANK}|\n|(?<=\n)")
        self._symbols()
        self._pair: dict[str, dict[str, bool]] = {}
        self._pairs = 0
        #: Ids of recent units, as bytes of int32.
        self._units: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        #: Length of the longest piece by its first PREFIX characters; where a
        #: text's next ones are not here, pieces are shorter than PREFIX.
        self.reach: dict[str, int] = {}
        for p in self.id:
            if len(p) >= PREFIX:
                self.reach[p[:PREFIX]] = max(self.reach.get(p[:PREFIX], 0), len(p))

    # -- merges ------------------------------------------------------------

    def _symbols(self) -> None:
        """Numbers for pieces and the characters they are made of, and a sorted
        table of the pairs that merge, with rank and result."""
        names = list(self.id)
        names += sorted({c for p in names for c in p} - set(names))
        self._symbol = {p: k for k, p in enumerate(names)}
        self._output = [np.array(self.ids([p]), np.int32) for p in names]
        pairs = [
            (self._symbol[p[:k]] << 32 | self._symbol[p[k:]], self.rank[p], self._symbol[p])
            for p in self.id
            for k in range(1, len(p))
            if p[:k] in self._symbol and p[k:] in self._symbol
        ]
        pairs.sort()
        self._pair_key = np.array([k for k, _, _ in pairs], np.int64)
        self._pair_rank = np.array([r for _, r, _ in pairs] + [NO_MERGE], np.float64)
        self._pair_new = np.array([n for _, _, n in pairs] + [-1], np.int32)
        self._single = np.full(0x110000, -1, np.int32)
        for c, k in self._symbol.items():
            if len(c) == 1:
                self._single[ord(c)] = k
        size = [len(x) for x in self._output]
        self._output_at = np.concatenate(([0], np.cumsum(size)))
        self._output = np.concatenate(self._output) if names else np.zeros(0, np.int32)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in the table; its length where they do not merge."""
        if not len(self._pair_key):
            return np.zeros(left.shape, np.int64)
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(self._pair_key, key), len(self._pair_key) - 1)
        return np.where((self._pair_key[at] == key) & (left >= 0) & (right >= 0), at, len(self._pair_key))

    def merge_in_step(self, units: list[str]) -> list[bytes]:
        """Ids of units as bytes of int32: ``merge`` of each, where in a step
        every unit merges its best pair and loses a column."""
        out: list[bytes] = [b""] * len(units)
        length = np.fromiter(map(len, units), np.int64, len(units))
        for most in (6, 10, 16, 28, IN_STEP):  # units of like lengths share an array
            which = np.flatnonzero((length > 0) & (length <= most))
            if not len(which):
                continue
            length[which] = 0
            text = "".join([units[k].ljust(most, "\n") for k in which.tolist()])
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, most).astype(np.int64)
            sizes = np.fromiter((len(units[k]) for k in which.tolist()), np.int64, len(which))
            inside = np.arange(most)[None, :] < sizes[:, None]
            # -1 ends a unit; a character that no piece has is -2 - its code.
            symbols = np.where(inside, np.where(self._single[points] >= 0, self._single[points], -2 - points), -1).astype(np.int32)
            at = self._lookup(symbols[:, :-1], symbols[:, 1:])
            while len(which):
                rank = self._pair_rank[at]
                best = rank.argmin(1) if at.shape[1] else np.zeros(len(which), np.int64)
                rows = np.arange(len(which))
                open_ = rank[rows, best] < NO_MERGE if at.shape[1] else np.zeros(len(which), bool)
                if not open_.all():
                    done = np.flatnonzero(~open_)
                    for k, ids in zip(which[done].tolist(), self.symbol_ids(symbols[done])):
                        out[k] = ids
                    which, symbols, at, best = which[open_], symbols[open_], at[open_], best[open_]
                    rows = np.arange(len(which))
                    if not len(which):
                        break
                symbols[rows, best] = self._pair_new[at[rows, best]]
                width = symbols.shape[1] - 1
                take = np.arange(width)[None, :]
                symbols = np.take_along_axis(symbols, take + (take > best[:, None]), 1)
                pairs = np.arange(width - 1)[None, :]
                at = np.take_along_axis(at, pairs + (pairs > best[:, None]), 1) if width > 1 else at[:, :0]
                for side in (0, -1):
                    where = best + side
                    fine = np.flatnonzero((where >= 0) & (where < width - 1))
                    at[fine, where[fine]] = self._lookup(symbols[fine, where[fine]], symbols[fine, where[fine] + 1])
        for k in np.flatnonzero(length).tolist():
            out[k] = np.array(self.ids(self.path(units[k])), np.int32).tobytes()
        return out

    def symbol_ids(self, symbols: np.ndarray) -> list[bytes]:
        """Ids of rows of symbols; unknown characters as byte pieces."""
        if not len(symbols):
            return []
        used = symbols != -1
        flat = symbols[used]
        per = used.sum(1)
        if (flat >= 0).all():
            start = self._output_at[flat]
            size = self._output_at[flat + 1] - start
            place = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            ids = self._output[place]
            total = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(per)))]
            raw = ids.astype(np.int32).tobytes()
            ends = (4 * total).tolist()
            return [raw[a:b] for a, b in zip(ends, ends[1:])]
        known = (symbols >= 0) | (symbols == -1)
        plain = known.all(1)
        out: list[bytes] = [b""] * len(symbols)
        for k, ids in zip(np.flatnonzero(plain).tolist(), self.symbol_ids(symbols[plain])):
            out[k] = ids
        for k in np.flatnonzero(~plain).tolist():
            ids = []
            for x in symbols[k].tolist():
                if x >= 0:
                    ids += self._output[self._output_at[x] : self._output_at[x + 1]].tolist()
                elif x < -1:
                    ids += [self.byte_id[b] for b in chr(-2 - x).encode("utf-8", "surrogatepass")]
            out[k] = np.array(ids, np.int32).tobytes()
        return out

    def merge(self, text: str) -> list[str]:
        """Best-priority pair first, leftmost among equals, until none is left."""
        rank = self.rank.get
        parts = list(text)
        ranks = [rank(a + b, NO_MERGE) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_MERGE:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], NO_MERGE)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], NO_MERGE)
        return parts

    def fits(self, left: str, right: str) -> bool:
        row = self._pair.get(left)
        known = None if row is None else row.get(right)
        return self.fit(left, right) if known is None else known

    def fit(self, left: str, right: str) -> bool:
        """Merges the pair's text and keeps the answer."""
        if self._pairs >= PAIR_CACHE:
            self._pair, self._pairs = {}, 0
        self._pairs += 1
        known = self._pair.setdefault(left, {})[right] = self.merge(left + right) == [left, right]
        return known

    # -- lattice -----------------------------------------------------------

    def at(self, text: str, i: int) -> list[str]:
        """Pieces of the text that start at i; a single character always is one."""
        found = [text[i]]
        for n in range(2, min(self.longest, len(text) - i) + 1):
            if text[i : i + n] in self.id:
                found.append(text[i : i + n])
        return found

    def states(self, text: str, boundary: int) -> list[tuple[str, int]]:
        """(piece, characters past the boundary) of all pieces that start
        before the boundary and end at it or after: the boundary's states."""
        found = []
        for i in range(max(0, boundary - self.longest), boundary):
            for p in self.at(text, i):
                if i + len(p) >= boundary:
                    found.append((p, i + len(p) - boundary))
        return found

    def forward(self, text: str, lo: int, hi: int, entry: list[tuple[str, int]] | None) -> dict[tuple[int, str], int]:
        """For pieces that start in [lo, hi), the set (bit mask) of entry
        states from which a fitting path reaches them. entry None: the text
        starts at lo."""
        reach: dict[tuple[int, str], int] = {}
        ending: dict[int, list[tuple[str, int]]] = {}
        if entry is not None:
            for k, (p, over) in enumerate(entry):
                ending.setdefault(lo + over, []).append((p, 1 << k))
        for i in range(lo, hi):
            before = ending.pop(i, ())
            if not before and not (entry is None and i == lo):
                continue
            for p in self.at(text, i):
                mask = 1 if entry is None and i == lo else 0
                for q, m in before:
                    if m & ~mask and self.fits(q, p):
                        mask |= m
                if mask:
                    reach[i, p] = mask
                    ending.setdefault(i + len(p), []).append((p, mask))
        return reach

    def transfer(self, text: str, lo: int, hi: int, entry, exit_) -> np.ndarray:
        """Max-plus matrix: 0 where the entry state leads to the exit state.
        exit None: one column, for paths that end at hi, the end of the text."""
        reach = self.forward(text, lo, hi, entry)
        rows = 1 if entry is None else len(entry)
        if exit_ is None:
            mask = sum(1 << k for k, (_, over) in enumerate(entry or ()) if lo + over == hi)
            for (i, p), m in reach.items():
                if i + len(p) == hi:
                    mask |= m
            return np.array([[0.0 if mask >> k & 1 else NEG] for k in range(rows)])
        out = np.full((rows, len(exit_)), NEG)
        for x, (p, over) in enumerate(exit_):
            start = hi + over - len(p)
            mask = reach.get((start, p), 0) if start >= lo else 0
            if start < lo and entry is not None:  # one piece lies across the whole chunk
                for k, (q, qover) in enumerate(entry):
                    if q == p and lo + qover == hi + over:
                        mask |= 1 << k
            for k in range(rows):
                if mask >> k & 1:
                    out[k, x] = 0.0
        return out

    def safe(self, text: str, lo: int, hi: int) -> list[int]:
        """First and last place in [lo, hi) that no merge crosses, if any."""
        found = [m.start() for m in (self._safe.search(text, lo, hi),) if m]
        if found:
            found.append(next(i for i in range(hi - 1, lo - 1, -1) if self._safe.match(text, i, hi)))
        return found

    def fast_transfer(self, text: str, lo: int, hi: int, entry, exit_) -> np.ndarray:
        """``transfer`` that skips what lies between two safe places: all paths
        meet there, so the matrix is the sum of a column and a row."""
        found = self.safe(text, lo, hi)
        if not found:
            return self.transfer(text, lo, hi, entry, exit_)
        first, last = found
        into = np.zeros((1, 1)) if entry is None else self.transfer(text, lo, first, entry, None)
        return into + (0.0 if exit_ is None else self.transfer(text, last, hi, None, exit_))

    def fast_trace(self, text: str, lo: int, hi: int, entry, exit_) -> list[int]:
        """Ids of the pieces that start in [lo, hi)."""
        before, inner, after = self.trace_ends(text, lo, hi, entry, exit_)
        return before + self.encode(inner).tolist() + after

    def trace_ends(self, text: str, lo: int, hi: int, entry, exit_) -> tuple[list[int], str, list[int]]:
        """Ids up to the first safe place and from the last one on, and the
        units between, whose ids depend on no state."""
        found = self.safe(text, lo, hi)
        if not found:
            return self.ids(self.trace(text, lo, hi, entry, exit_)), "", []
        first = lo if entry is None else found[0]
        last = hi if exit_ is None else found[1]
        before = self.ids(self.trace(text, lo, first, entry, None)) if first > lo else []
        after = self.ids(self.trace(text, last, hi, None, exit_)) if last < hi else []
        return before, text[first:last], after

    def trace(self, text: str, lo: int, hi: int, entry: tuple[str, int] | None, exit_: tuple[str, int] | None) -> list[str]:
        """Pieces that start in [lo, hi) on the path from entry to exit;
        exit None: the text ends at hi."""
        reach = self.forward(text, lo, hi, None if entry is None else [entry])
        first = lo if entry is None else lo + entry[1]
        if first == hi and exit_ is None:
            return []
        ends: dict[int, list[str]] = {}
        for i, p in reach:
            ends.setdefault(i + len(p), []).append(p)
        out: list[str] = []
        if exit_ is None:
            options = ends.get(hi, [])
        else:
            p, over = exit_
            if hi + over - len(p) < lo:
                return []
            options = [p]
            hi = hi + over
        stack = [(hi, None, options)]
        path: list[tuple[int, str]] = []
        # One finite path exists; wrong turns end where no neighbour fits.
        while stack:
            end, after, options = stack[-1]
            if end == first and after is not None and (entry is None or self.fits(entry[0], after)):
                return [p for _, p in reversed(path)]
            while options:
                p = options.pop()
                i = end - len(p)
                if (i, p) in reach and (after is None or self.fits(p, after)):
                    path.append((i, p))
                    stack.append((i, p, list(ends.get(i, []))))
                    break
            else:
                stack.pop()
                if path:
                    path.pop()
        return out

    # -- ids ---------------------------------------------------------------

    def ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            else:
                out.extend(self.byte_id[b] for b in p.encode("utf-8", "surrogatepass"))
        return out

    def path(self, text: str) -> list[str]:
        """The finite path through the lattice of a whole text: the longest
        piece that fits first, a step back where none does. States that lead
        nowhere are remembered, so the work stays linear."""
        known, reach, n = self.id, self.reach.get, len(text)
        out: list[str] = []
        dead: set[tuple[int, str]] = set()
        i, prev, size = 0, "", min(reach(text[:PREFIX], PREFIX - 1), n)
        while i < n:
            row = self._pair.get(prev) or {}
            while size:
                p = text[i : i + size]
                if size == 1 or p in known:
                    if not prev:
                        break
                    fine = row.get(p)
                    if (self.fit(prev, p) if fine is None else fine) and (not dead or (i + size, p) not in dead):
                        break
                size -= 1
            if size:
                out.append(p)
                i, prev = i + size, p
                size = min(reach(text[i : i + PREFIX], PREFIX - 1), n - i)
            else:
                dead.add((i, prev))
                out.pop()
                i, size = i - len(prev), len(prev) - 1
                prev = out[-1] if out else ""
        return out

    def encode(self, marked: str) -> np.ndarray:
        """Ids of a text whose blanks are marked."""
        return self.encode_all([marked])[0]

    def encode_all(self, marked: list[str]) -> list[np.ndarray]:
        """Ids of texts whose blanks are marked. Units that are not among the
        recent ones are merged together, each distinct one once."""
        cut = [UNIT.findall(m) for m in marked]
        recent, older = self._units, self._older
        new = set().union(*cut).difference(recent)
        kept = new.intersection(older)
        recent.update((u, older[u]) for u in kept)
        fresh = list(new.difference(kept))
        recent.update(zip(fresh, self.merge_in_step(fresh)))
        get = recent.__getitem__
        out = [np.frombuffer(b"".join(map(get, units)), np.int32) for units in cut]
        for u in fresh:
            if len(u) > UNIT_KEPT:
                del recent[u]
        if len(recent) >= UNIT_CACHE:
            self._older, self._units = recent, {}
        return out

    def decode(self, ids, first: bool = True) -> str:
        """The text again: pieces joined, byte pieces as UTF-8, marks as
        blanks; the first part without the blank that encoding put in front."""
        raw = b"".join(map(self.piece_bytes.__getitem__, ids))
        text = raw.decode("utf-8", "surrogatepass").replace(BLANK, " ")
        return text[1:] if first and text.startswith(" ") else text


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def marked(text: str) -> str:
    """Identity normalisation, a blank in front, blanks as marks."""
    return BLANK + text.replace(" ", BLANK) if text else ""


def pack(ids: list[int]) -> np.ndarray:
    return np.asarray(ids, np.int32)


def frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.assign(doc_id=out["doc_id"].astype("Int64"))


# -- chunks over Spark --------------------------------------------------------


def encode_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, token_ids, n_chunks, decoded (the text read back from
    the ids) and round_trip (whether that is the text again) of every row.

    Null and empty texts have no ids and decode to the empty text. Repeated
    rows and null keys stay rows of their own. Texts of at most ``chunk``
    characters are one chunk; longer ones are cut at every ``chunk`` characters,
    wherever that falls, and no task holds more than ``FAN`` matrices or one
    chunk of a document at a time. The ids of a document are one value.
    """
    path = model or default_model()

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for pdf in batches:
            keys, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            at = 0
            while at < len(texts):  # few token lists are in memory at a time
                end, size = at, 0
                while end < len(texts) and size < YIELD:
                    size += len(texts[end])
                    end += 1
                done = []
                for doc, text, ids in zip(keys[at:end], texts[at:end], v.encode_all([marked(t) for t in texts[at:end]])):
                    decoded = v.decode(ids.tolist())
                    done.append((doc, len(ids), ids, 1, decoded, decoded == text))
                yield frame(done, names)
                at = end

    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = "doc_id long, n_tokens int, token_ids array<int>, n_chunks int, decoded string, round_trip boolean"
    names = [c.split()[0] for c in out.split(", ")]
    short = base.where(F.char_length("text") <= chunk).mapInPandas(whole, out)
    giant = base.where(F.char_length("text") > chunk)
    return short.unionByName(encode_giants(giant, path, chunk, out)).withColumnRenamed("doc_id", key)


def encode_giants(docs: DataFrame, path: str, chunk: int, out: str) -> DataFrame:
    """The chunked way: matrices, associative combination, backtrace."""
    context = 32  # over the longest piece on either side of a chunk
    if vocabulary(path).longest > context:
        raise ValueError("pieces are longer than the context kept with a chunk")
    # A digest goes with the chunks, so that the text need not come back to be compared.
    numbered = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("digest", F.sha2("text", 256))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, doc, text, digest in zip(pdf["row"], pdf["doc_id"], pdf["text"], pdf["digest"]):
                m = marked(text)
                n = -(-len(m) // chunk)
                for c in range(n):
                    lo, hi = c * chunk, min(len(m), (c + 1) * chunk)
                    left = min(context, lo)
                    yield pd.DataFrame(
                        {"row": [row], "doc_id": pd.array([doc], "Int64"), "c": [c], "n": [n], "left": [left], "len": [hi - lo], "text": [m[lo - left : hi + context]], "digest": [digest]}
                    )

    pieces = written(
        numbered.mapInPandas(cut, "row long, doc_id long, c int, n int, left int, len int, text string, digest string").repartition("row", "c"),
        "chunks",
    )

    def ends(v: Vocabulary, c: int, n: int, left: int, length: int, text: str):
        entry = None if c == 0 else v.states(text, left)
        exit_ = None if c == n - 1 else v.states(text, left + length)
        return entry, exit_

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for pdf in batches:
            blobs = []
            for r in pdf.itertuples():
                entry, exit_ = ends(v, r.c, r.n, r.left, r.len, r.text)
                blobs.append(to_blob(v.fast_transfer(r.text, r.left, r.left + r.len, entry, exit_)))
            yield pd.DataFrame({"row": pdf["row"], "c": pdf["c"], "m": blobs})

    level = [written(pieces.mapInPandas(matrices, "row long, c int, m binary"), "matrices")]
    most = level[0].agg(F.max("c")).first()[0] or 0
    while most > 0:  # up: products of FAN neighbours, until one is left
        groups = level[-1].groupBy("row", F.expr(f"c div {FAN}").cast("int").alias("g"))

        def product(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("c")
            m = from_blob(pdf["m"].iloc[0])
            for b in pdf["m"].iloc[1:]:
                m = max_plus(m, from_blob(b))
            return pd.DataFrame({"row": [k[0]], "c": [k[1]], "m": [to_blob(m)]})

        level.append(written(groups.applyInPandas(product, "row long, c int, m binary"), "products"))
        most //= FAN

    # down: the entry and exit state of a group fix those of its members
    starts = level[-1].select("row", "c", F.lit(0).alias("entry"), F.lit(0).alias("leave"))
    for below in level[-2::-1]:

        def hand_down(k: tuple, pdf: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("c")
            states = path_states([from_blob(b) for b in pdf["m"]], int(up["entry"].iloc[0]), int(up["leave"].iloc[0]))
            return pd.DataFrame({"row": pdf["row"], "c": pdf["c"], "entry": states[:-1], "leave": states[1:]})

        mine = below.withColumn("g", F.expr(f"c div {FAN}").cast("int")).groupBy("row", "g")
        theirs = starts.withColumnRenamed("c", "g").groupBy("row", "g")
        starts = written(mine.cogroup(theirs).applyInPandas(hand_down, "row long, c int, entry int, leave int"), "entries")

    def backtrace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for pdf in batches:
            rows = list(pdf.itertuples())
            for k in range(0, len(rows), together):
                some, parts = rows[k : k + together], []
                for r in some:
                    entry, exit_ = ends(v, r.c, r.n, r.left, r.len, r.text)
                    leave = None if exit_ is None else exit_[int(r.leave)]
                    parts.append(v.trace_ends(r.text, r.left, r.left + r.len, entry[int(r.entry)] if entry else None, leave))
                inner = v.encode_all([m for _, m, _ in parts])
                ids = [np.concatenate((pack(b), i, pack(a))) for (b, _, a), i in zip(parts, inner)]
                # Pieces hold whole characters and byte pieces stand together, so chunks decode apart.
                texts = [v.decode(i.tolist(), first=r.c == 0) for i, r in zip(ids, some)]
                out = pd.DataFrame([(r.row, r.doc_id, r.c, i, t, r.digest) for r, i, t in zip(some, ids, texts)], columns=names)
                yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    together = max(1, YIELD // chunk)
    columns = "row long, doc_id long, c int, ids array<int>, part string, digest string"
    names = [c.split()[0] for c in columns.split(", ")]
    traced = pieces.join(starts, ["row", "c"]).mapInPandas(backtrace, columns)
    chunks = F.array_sort(F.collect_list(F.struct("c", "ids", "part")))
    whole = traced.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), chunks.alias("chunks"), F.count(F.lit(1)).cast("int").alias("n_chunks"), F.first("digest").alias("digest")
    )
    read = whole.select(
        "doc_id",
        F.flatten(F.transform("chunks", lambda x: x["ids"])).alias("token_ids"),
        "n_chunks",
        F.array_join(F.transform("chunks", lambda x: x["part"]), "").alias("decoded"),
        "digest",
    )
    again = F.sha2("decoded", 256) == F.col("digest")
    return read.select("doc_id", F.size("token_ids").alias("n_tokens"), "token_ids", "n_chunks", "decoded", again.alias("round_trip"))


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def path_states(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """States at all boundaries of the finite path from entry to leave."""
    ahead = [np.where(np.arange(matrices[-1].shape[1]) == leave, 0.0, NEG)]
    for m in reversed(matrices):
        ahead.append((m + ahead[-1][None, :]).max(axis=1))
    ahead.reverse()
    states = [entry]
    for m, after in zip(matrices, ahead[1:]):
        states.append(int(np.argmax(m[states[-1]] + after)))
    return states


def to_blob(m: np.ndarray) -> bytes:
    return np.array(m.shape, np.int32).tobytes() + zlib.compress(m.astype(np.float32).tobytes(), 1)


def from_blob(b: bytes) -> np.ndarray:
    shape = np.frombuffer(b[:8], np.int32)
    return np.frombuffer(zlib.decompress(b[8:]), np.float32).reshape(shape)
