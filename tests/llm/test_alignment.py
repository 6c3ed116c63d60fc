import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rinseframe.llm import alignment, queries
from rinseframe.llm.bytebpe import printable_bytes
from tests.llm.helpers import FOLDER, documents, odd

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    """The ids and end offsets of a text by the libraries, or None where it has no tokens."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    a.encode_special_tokens = True
    place = printable_bytes()
    of_a = {i: bytes(place[c] for c in token) for token, i in a.get_vocab().items() if token != "<|endoftext|>"}
    of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in range(32_000) for p in [b.id_to_piece(i)]]

    def found(text):
        if not text:
            return None
        out = []
        for ids, of in ((a.encode(" " + text, add_special_tokens=False).ids, of_a), (b.encode(text), of_b)):
            if b"".join(of[i] for i in ids) != (" " + text).encode():
                return None
            ends, at = [], 0
            for i in ids:
                at += len(of[i])
                ends.append(at)
            out.append((ids, ends))
        return out

    return found


def plain(rows, tokens):
    """Every document's links and groups in plain Python, one occurrence after another."""
    linked, groups, sizes = [], [], []
    for text in rows:
        if (found := tokens(text)) is None:
            linked.append([]), groups.append(""), sizes.append((0, 0, 0))
            continue
        (a, end_a), (b, end_b) = found
        common = sorted(set(end_a) & set(end_b))
        ending: dict[int, list[int]] = {}
        for y, f in zip(b, end_b):
            ending.setdefault(f, []).append(y)
        linked.append([(x, y) for x, e in zip(a, end_a) for y in ending.get(e, ())])
        shown, low, i, j = [], 0, 0, 0
        for high in common:
            sides = []
            for ids, ends, at in ((a, end_a, i), (b, end_b, j)):
                sides.append([x for x, e in zip(ids[at : at + high - low], ends[at : at + high - low]) if low < e <= high])
            i, j, low = i + len(sides[0]), j + len(sides[1]), high
            shown.append("|".join(",".join(map(str, side)) for side in sides))
        groups.append(";".join(shown))
        sizes.append((len(a), len(b), len(common)))
    counts = Counter(pair for links in linked for pair in links)
    best: Counter = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (*size, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for size, links, g in zip(sizes, linked, groups)
    ]


ROW = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    "it's <|endoftext|> plain", "<s> a </s> <unk>", "a  b   c \n\n\t d ", " ", "   ", "\n", "tab\there", "▁ under ▁▁", "a\x00b", "<0x41> A",
    "Ａ ﬁ é é", "漢字😀 ſK İ", "x" * 3000, "1234567890 " * 50, "word " * 2000, "\x01\x02", "…—“”", None, "", "same text", "same text",
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def compare(spark, texts, tokens, table=None):
    got = {r.doc_id: tuple(r[c] for c in ROW) for r in alignment.align(table or frame(spark, texts), *PATHS).collect()}
    assert got == dict(enumerate(plain(texts, tokens)))


def test_odd_texts(spark, tokens):
    compare(spark, ODD, tokens)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab cde  \n.,'s1éß漢😀<|>▁\t"), max_size=60), min_size=1, max_size=30))
def test_random_texts(spark, tokens, texts):
    compare(spark, texts, tokens)


def test_tokens_are_those_of_the_libraries(tokens):
    both = alignment.aligner(*PATHS)
    texts = [t for t in ODD if t]
    for text, a, b in zip(texts, *both.encode_all(texts)):
        found = tokens(text)
        assert (a, b) == (([], []) if found is None else (found[0][0], found[1][0])), text


def test_same_bytes():
    both = alignment.aligner(*PATHS)
    for a in (0, 220, 262, 1000, 50_000):
        if both.same[a] >= 0:
            assert both.b.bytes_of[both.same[a]] == both.a.bytes_of[a]
    assert not both.b.model.is_byte(int(both.same[both.a.ranks[b"A"]]))


def test_table(spark):
    found = alignment.align(odd(spark), *PATHS)
    assert "text" not in found.columns and {"n_words", "kept", "items", "score"} <= set(found.columns)
    rows = found.collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows}
    assert by[2].n_a == by[3].n_a == 0 and by[2].groups_sha256 == "" and by[4].n_a > 100_000
    assert by[None].kept == "k" and by[1].n_a == by[1].n_b == 12
    assert alignment.align(odd(spark).limit(0), *PATHS).count() == 0
    assert alignment.align(odd(spark).where("text IS NULL"), *PATHS, keep=[]).first().n_a == 0


def test_counts_do_not_depend_on_partitions(spark):
    docs = documents(spark)
    one, many = (sorted(alignment.align(docs.repartition(n), *PATHS, keep=["doc_id"]).collect()) for n in (1, 13))
    assert one == many


def test_query(spark, tokens):
    rows = {r.doc_id: r.text for r in documents(spark).collect()}
    ids = sorted(rows)
    got = {r.doc_id: tuple(r[c] for c in ROW) for r in queries.op12_token_alignment(spark, FOLDER).collect()}
    assert got == dict(zip(ids, plain([rows[i] for i in ids], tokens)))
