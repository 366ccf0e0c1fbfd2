import zlib

import numpy as np

from keyloom.llm import language as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in L.identify(docs, L.train_outside_fold(docs)).collect()}
    held = [r for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held)
    assert len(got) == docs.count() and right >= 0.97 * len(held)


def brute(scores, penalty):
    """Best labelling of one text by trying every predecessor."""
    value, back = scores[0].astype(float), []
    for s in scores[1:]:
        moves = value[:, None] - penalty * (1 - np.eye(len(value)))
        back.append(moves.argmax(axis=0))
        value = moves.max(axis=0) + s
    path = [int(value.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return value.max(), path[::-1]


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(3)
    lengths = [0, 1, 5, 40, 0, 13]
    firsts = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(size=(firsts[-1], 3)).astype(np.float32) * 3
    label = L.viterbi(scores, firsts, 2.5)
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if b > a:
            best, _ = brute(scores[a:b], 2.5)
            mine = sum(scores[a + i, label[a + i]] for i in range(b - a)) - 2.5 * sum(label[a + i] != label[a + i - 1] for i in range(1, b - a))
            assert abs(best - mine) < 1e-3


def test_spans_of_a_mixed_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = {}
    for r in docs.orderBy("doc_id").collect():
        if r["n_chars"] > 800:
            by.setdefault(r["lang"], r["text"][:800])
    model = L.train_outside_fold(docs)
    text = by["en"] + " " + by["de"]
    _, _, spans = L.label_texts(model, [text])
    langs = [s["lang"] for s in spans.to_pylist()[0]]
    ends = [s["end"] for s in spans.to_pylist()[0]]
    assert langs[0] == "en" and langs[-1] == "de" and any(abs(e - 800) < 60 for e in ends)


def test_odd_and_empty(odd, none, docs):
    model = L.train_outside_fold(docs)
    out = L.identify(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    texts = {r["doc_id"]: r["text"] for r in odd.select("doc_id", "text").collect()}
    for r in out:
        if r["doc_id"] in (0, 1, 2):
            assert r["lang_pred"] == L.UNKNOWN and r["score"] == 0
        elif r["doc_id"] is not None and any(c.isalpha() for c in texts[r["doc_id"]] or ""):
            assert r["lang_pred"] in model.languages
    assert L.identify(none, model).collect() == []
    blank = L.train_outside_fold(none)
    assert {r["lang_pred"] for r in L.identify(odd, blank).collect()} == {L.UNKNOWN}
    kept = L.with_language(odd, model, "in_lang", "in_share")
    assert kept.columns == [*odd.columns, "in_lang", "in_share"] and kept.count() == odd.count()
