import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_encoder_equals_the_tokenizer(docs):
    texts = [r["text"] for r in docs.select("text").collect()][:60]
    texts += ["don't it's  a!'s '!s 'll x'5's we'Re 'RE", "<|endoftext|>a <|startoftext|>", "éa naïve ÀÉ é 日本語 ①②½ a b\x85c İ", "", " ", "\x0bq\x0c 12ab3"]
    t, e = tokenizer(), P.Encoder(None)
    assert [x.tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


ENCODER = []
ANY = st.text(st.characters(exclude_categories=["Cs"]), max_size=24)
NEAR = st.text(st.sampled_from("aİıßéE\u0307\u0301.,!?'()-_ 12\n\t<|>"), max_size=24)


@given(st.lists(st.one_of(ANY, NEAR, st.text(st.characters(max_codepoint=0x24F), max_size=24)), max_size=30))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_the_tokenizer_on_any_text(texts):
    if not ENCODER:
        ENCODER.append(P.Encoder(None))
    e = ENCODER[0]
    assert [x.tolist() for x in e.encode(texts)] == [e.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_dotted_capital_i_and_texts_that_defeat_polynomial_hashes():
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [f"İ{c}" for c in ".!(),-?_'"] + ["xİ.y", word, word.translate(str.maketrans("ab", "ba"))]
    t, e = tokenizer(), P.Encoder(None)
    assert [x.tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_a_full_table_starts_anew(docs):
    texts = [r["text"] for r in docs.select("text").collect()][:20]
    t, e = tokenizer(), P.Encoder(None)
    e.table = P.textvec.HashTable(16)
    e.table.room = 500
    for x in texts:
        assert e.encode([x])[0].tolist() == t.encode(x, add_special_tokens=False).ids


def test_cuts():
    for n in (1, 2, 100, 1365, 2000, 2048, 3000, 4095, 4096, 4097, 20_000):
        got = P.cuts(n, 4096, 1 / 32)
        assert sum(got) == n and all(0 < x <= 4096 for x in got)
        assert all(4096 - (4096 // x) * x <= 4096 / 32 for x in got)


def check(df):
    """A round trip: pieces give each document's ids back, sequences are gapless and within capacity, padding is little."""
    t = tokenizer()
    pieces = P.pack(df).collect()
    want = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        want[r["doc_id"]].append([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2])
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], dtype="<u4")
        assert len(ids) == p["length"] > 0 and zlib.crc32(bytes(p["ids"])) >= 0
        of_doc[p["doc_id"]].append((p["start"], ids.tolist(), p["doc_tokens"]))
        of_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(of_doc) == set(want)
    for i, texts in want.items():
        if len(texts) == 1:
            got = sorted(of_doc[i])
            assert [x for _, ids, _ in got for x in ids] == texts[0] and [s for s, _, _ in got] == list(np.cumsum([0, *(len(x) for _, x, _ in got[:-1])]))
            assert {n for _, _, n in got} == {len(texts[0])}
        else:
            assert sorted(x for _, ids, _ in of_doc[i] for x in ids) == sorted(x for x in sum(texts, []))
    padded = total = 0
    for parts in of_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
        total += at
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded <= 0.03 * total


def test_round_trip(docs, odd):
    check(docs)
    check(odd)


def test_empty(none):
    assert P.pack(none).collect() == []
