import hashlib
import sys

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rinseframe.llm import bytebpe, queries
from tests.llm.helpers import FOLDER, LONG, documents, odd

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bytebpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bytebpe.tokenizer(PATH, PATTERN)


def test_every_character(library, own):
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)}.{chr(c)} " for c in points[at : at + 64]) for at in range(0, len(points), 64)]
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        assert own.encode_all(some) == [library.encode_ordinary(text) for text in some]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdeſ'st'll <|endoftext|>́\n\t\x1c\x85　漢😀"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_random_texts(library, own, text):
    ids = own.encode(text)
    assert ids == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=64), st.integers(0, 3))
def test_one_tree_and_many(own, piece, letters):
    if letters:  # few letters: many merges and ties
        piece = bytes(97 + b % letters for b in piece)
    one = tuple(own.ranks[token] for token in bytebpe.merged(piece, own.ranks))
    width = next(w for w in bytebpe.WIDTHS if len(piece) <= w)
    for wide in (w for w in bytebpe.WIDTHS if w >= width):
        assert bytebpe.merged_together([piece, b"other", piece], own.pairs, own.of_byte, wide)[0::2] == [one, one] if wide > 4 else True


def test_small_ranks_by_brute_force():
    """Ranks without a known tokenizer: the least pair, leftmost first, found by looking at all of them."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ba": 256, b"ab": 257, b"aba": 258, b"bb": 259, b"abab": 260, b"aa": 261, b"aaaa": 262}
    own = bytebpe.ByteBpe(ranks, r"\S+|\s+")

    def plain(piece):
        symbols = [piece[i : i + 1] for i in range(len(piece))]
        while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in ranks]:
            _, i = min(found)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    for n in range(1 << 11):
        piece = bytes(97 + (n >> i & 1) for i in range(1 + n % 11))
        assert bytebpe.merged(piece, ranks) == plain(piece)
        assert own.pieces([piece.decode()])[piece.decode()] in ((ranks.get(piece),), tuple(ranks[t] for t in plain(piece)))


def test_long_pieces(library, own):
    for text in ("a" * 30_000, "ab" * 10_000, "!?" * 5_000, "漢" * 4_000, LONG[:50_000]):
        assert own.encode(text) == library.encode_ordinary(text)


def test_memory_is_bounded(library, own, monkeypatch):
    monkeypatch.setattr(bytebpe, "REMEMBERED", 50)
    monkeypatch.setattr(bytebpe, "LONGEST", 4)
    fresh = bytebpe.ByteBpe(own.ranks, PATTERN)
    for i in range(20):
        text = " ".join(f"word{i}x{j} ab" for j in range(20))
        assert fresh.encode(text) == library.encode_ordinary(text)
        assert len(fresh.seen) <= 50 + 100


def test_table(spark, library):
    rows = bytebpe.encode(odd(spark), PATH, PATTERN).collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows}
    texts = {r.doc_id: r.text or "" for r in odd(spark).collect()}
    assert {i: list(r.token_ids) for i, r in by.items()} == {i: library.encode_ordinary(text) for i, text in texts.items()}
    assert by[2].n_tokens == by[3].n_tokens == 0 and by[5].n_tokens > 0
    back = bytebpe.decode(bytebpe.encode(odd(spark), PATH, PATTERN), PATH, PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == {i: text.encode() for i, text in texts.items()}
    assert bytebpe.encode(odd(spark).limit(0), PATH, PATTERN).count() == 0
    assert bytebpe.decode(odd(spark).selectExpr("CAST(NULL AS array<long>) AS token_ids"), PATH, PATTERN).first().decoded == b""


def test_vocabulary_in_json_is_the_same():
    assert bytebpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")) == bytebpe.read_ranks(PATH)


def test_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in documents(spark).collect()}
    rows = queries.op11_byte_bpe(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode_bytes(ids)).hexdigest()
