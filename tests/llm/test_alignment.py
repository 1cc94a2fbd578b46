import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fabula.llm.alignment import align_documents, aligner, default_a, default_b, digest, linkable

LETTERS = {}
for b in range(256):  # the published rule, written for itself
    LETTERS[chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else chr(256 + sum(not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255) for x in range(b)))] = b


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def plain(tools, text):
    """Whole text at once, by decoded bytes alone: groups with their links."""
    if not text:
        return [], []
    a, b = tools
    raw = (" " + text).encode()
    xs = [(i, bytes(LETTERS[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    ys = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if b"".join(x for _, x in xs) != raw or b"".join(y for _, y in ys) != raw:
        return [], []

    def ends(tokens):
        out, n = {}, 0
        for k, (_, x) in enumerate(tokens):
            n += len(x)
            out[n] = k + 1
        return out

    ea, eb = ends(xs), ends(ys)
    groups, links, i, k = [], [], 0, 0
    for e in sorted(set(ea) & set(eb)):
        groups.append((xs[i : ea[e]], ys[k : eb[e]]))
        links.append((xs[ea[e] - 1][0], ys[eb[e] - 1][0]))
        i, k = ea[e], eb[e]
    return groups, links


def written_out(groups):
    return ";".join(",".join(str(i) for i, _ in x) + "|" + ",".join(str(i) for i, _ in y) for x, y in groups)


def brute(tools, rows):
    each = [(key, *plain(tools, text)) for key, text in rows]
    count = Counter(x for _, _, links in each for x in links)
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for key, groups, links in each:
        s = written_out(groups)
        out.append((key, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(s.encode()).hexdigest() if s else ""))
    return sorted(out, key=str)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces\n\nnew ▁ line"), (5, "two <s> <|endoftext|> names </s> <unk> <0x41>  "), (6, "日本語𝓐のテキスト😀 héllo wörld 😀😀 x"), (7, "a\x00b \x01 \x1c \x85  "),
    (8, "a a b 　 c​ d﻿ é é"), (9, "a b c a b c"), (9, "a b c a b c"), (None, "a key that is null"), (11, "x" * 20_000 + " " + "é𝓐" * 3000), (12, "\n \n  y \t z"), (13, "𝓐"), (14, "don't we'll ’s 12 345,678.90"), (15, "🏽‍♂️ 👩‍👩‍👧 \U0010ffff"), (16, "a▁b and more words"), (17, "▁"),
]


def test_odd_rows_equal_brute_force(spark, tools):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in ODD], "doc_id long, text string, groups string, pair int")
    assert sorted((tuple(r) for r in digest(docs).collect()), key=str) == brute(tools, ODD)
    assert digest(docs.limit(0)).count() == 0


def test_given_documents_equal_brute_force(spark, sf, tools):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert sorted((tuple(r) for r in digest(docs).collect()), key=str) == brute(tools, [tuple(r) for r in docs.collect()])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁aé日𝓐😀'. ́"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_units_equal_the_whole(tools, text):
    n_a, n_b, groups, links = aligner(default_a(), default_b()).align([text])[0]
    want, pairs = plain(tools, text)
    assert groups == written_out(want) and len(links) == 4 * len(pairs)
    numbers = aligner(default_a(), default_b()).pairs
    assert [(int(numbers[i]) >> 32, int(numbers[i]) & 0xFFFFFFFF) for i in memoryview(links).cast("i")] == pairs


def test_generations_of_units(tools, monkeypatch):
    import fabula.llm.alignment as m

    monkeypatch.setattr(m, "KEPT_UNITS", 3)
    tool = m.Aligner(default_a(), default_b())
    texts = ["one two three four five", "two three six", "one six seven two", "seven one"]
    for _ in range(3):
        assert [tool.align([t])[0][2] for t in texts] == [written_out(plain(tools, t)[0]) for t in texts]


def test_linkable_pairs():
    a, b = {1: b"ab", 2: b"b", 3: b"abc"}, {7: b"b", 8: b"b", 9: b"cab"}
    keys = [(int(k) >> 32, int(k) & 0xFFFFFFFF) for k in linkable(a, b)]
    assert keys == [(1, 7), (1, 8), (1, 9), (2, 7), (2, 8), (2, 9)]


def test_general_interface(spark):
    rows = spark.createDataFrame([("u", "hi there")], "name string, body string")
    r = align_documents(rows, text="body", key="name").first()
    assert r.name == "u" and r.groups.count("|") == r.n_groups == len(r.links) // 4
