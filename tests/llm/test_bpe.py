import hashlib
import struct
import sys
import unicodedata

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rinseframe.llm import bpe, queries
from tests.llm.helpers import FOLDER, documents, odd

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def same(library, text):
    expected = library.encode(text, add_special_tokens=False).ids
    ours = bpe.tokenizer(PATH).encode(text)
    assert list(ours) == expected, text
    assert bpe.tokenizer(PATH).decode(ours) == library.decode(expected, skip_special_tokens=False)


def test_every_character(library):
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    wrong = []
    for at in range(0, len(points), 8):
        text = "".join(f"a{chr(c)}b " for c in points[at : at + 8])
        if list(bpe.tokenizer(PATH).encode(text)) != library.encode(text, add_special_tokens=False).ids:
            wrong += [c for c in points[at : at + 8] if list(bpe.tokenizer(PATH).encode(f"a{chr(c)}b")) != library.encode(f"a{chr(c)}b", add_special_tokens=False).ids]
    # Two libraries, two versions of Unicode: they may differ on characters that Python's does not know yet.
    assert not [hex(c) for c in wrong if unicodedata.category(chr(c)) != "Cn"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdeſΣσİ '’s't'll<|endoftext|>́\n\t"), st.characters(max_codepoint=0x2FF)), max_size=60))
def test_random_texts(library, text):
    same(library, text)


def test_given_documents_and_edges(library, spark):
    for text in [*(r.text for r in documents(spark).collect() if r.text), "", "<|endoftext|><|startoftext|>x", "ab" * 20_000, "it's they'll WE'VE", "Ａ ﬁ é"]:
        same(library, text)


def test_table(spark, library):
    rows = bpe.encode(odd(spark), PATH).collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows}
    assert by[2].n_tokens == by[3].n_tokens == by[5].n_tokens == 0 and by[2].decoded == ""
    assert bpe.encode(odd(spark).limit(0), PATH).count() == 0
    back = bpe.decode(bpe.encode(odd(spark), PATH, decoded=False), PATH)
    assert {r.doc_id: r.decoded for r in back.collect()} == {r.doc_id: r.decoded for r in rows}


def test_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in documents(spark).collect()}
    for r in queries.op9_bpe(spark, FOLDER).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
