import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import test_simhash

import corpus_pipeline
from keyloom.llm import secret_scan, simhash


def test_stages_take_effect(spark, docs, tmp_path):
    held, before = docs, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"{k}")
        stage(spark, held, "/root/testdata/sf0.001").write.parquet(out)
        held = spark.read.parquet(out)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert held.columns == docs.columns, name
        if name == "language":
            assert held.count() >= 0.98 * before
        if name == "near_duplicates":
            assert held.count() == held.select("doc_id").distinct().count() <= before
        if name == "secrets":
            assert not any(secret_scan.scan(r["text"], secret_scan._automaton()) for r in held.select("text").collect())
    assert {"doc_id", "sequence_id", "offset", "ids_crc32"} <= set(held.columns) and held.count() > 0


def test_odd_rows_and_none(spark, odd, none):
    for df in (odd, none):
        held = df
        for _, stage in corpus_pipeline.STAGES:
            held = stage(spark, held, "/root/testdata/sf0.001")
            held = spark.createDataFrame(held.collect(), held.schema)
        assert (held.count() > 0) == (df.count() > 0)


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and np.all([r["length"] > 0 for r in got.select("length").collect()])


def test_against_brute_force(spark, tmp_path):
    """Each stage of a run over real documents, redone here without the operators' exchanges."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    docs = t.to_pylist()
    docs += [{**r, "doc_id": 9000 + r["doc_id"]} for r in docs[:25]]  # exact copies
    pq.write_table(pa.Table.from_pylist(docs, schema=t.schema), tmp_path / "documents.parquet")
    held, out = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        held = spark.read.parquet(str(tmp_path / f"{k}"))
        out.append([r.asDict() for r in held.collect()])
    spoken, single, clean, mixed, packed = out
    # language: what is left is whole, and only texts without a clear language are gone
    by_id = {r["doc_id"]: r for r in docs}
    assert all(r == by_id[r["doc_id"]] for r in spoken) and len({r["doc_id"] for r in spoken}) == len(spoken)
    gone = set(by_id) - {r["doc_id"] for r in spoken}
    assert not any(by_id[i]["lang"] and len(re.findall(r"[^\W\d_]{2,}", by_id[i]["text"] or "")) > 30 for i in gone)
    # near-duplicates: the smallest id of every component of fingerprints
    label = test_simhash.component_of([simhash.fingerprint(r["text"] or "") for r in spoken])
    least = {}
    for r, c in zip(spoken, label, strict=True):
        least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in single) == sorted(least.values()) and all(r == by_id[r["doc_id"]] for r in single)
    # secrets: spans found one by one, masked
    automaton = secret_scan._automaton()
    mask = lambda text: text if text is None else secret_scan.replace(text, [(a, b) for a, _, b in secret_scan.scan(text, automaton)], "[SECRET]")
    want = [{**r, "text": mask(r["text"]), "n_chars": len(mask(r["text"]) or "")} for r in single]
    assert sorted(map(str, clean)) == sorted(map(str, want))
    # mixing: whole copies, and one cut document per source at most, near each source's target
    words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))
    sources = sorted({r["source"] for r in clean}, key=lambda x: (x is None, x))
    size = {s: sum(words(r["text"]) for r in clean if r["source"] == s) for s in sources}
    weight, target, open_, rest = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}, {}, set(sources), sum(size.values())
    while open_:  # those above three times their size stop there, the excess is shared anew
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * size[s]}
        for s in full or open_:
            target[s] = 3 * size[s] if full else level * weight[s]
            rest -= target[s] if full else 0
        open_ = open_ - full if full else set()
    text_of = {r["doc_id"]: r["text"] for r in clean}
    for s in sources:
        mine = [r for r in mixed if r["source"] == s]
        assert abs(sum(words(r["text"]) for r in mine) - target[s]) <= 1
        assert sum(r["text"] != text_of[r["doc_id"]] for r in mine) <= 1
    assert max(Counter(r["doc_id"] for r in mixed).values(), default=0) <= 3
    # packing: every id of every mixed row in one place
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4") for r in mixed]
    assert sum(r["length"] for r in packed) == sum(map(len, ids))
    crcs = {(r["doc_id"], len(x)): x for r, x in zip(mixed, ids, strict=True)}
    for r in packed:
        x = crcs[r["doc_id"], r["doc_tokens"]]
        assert zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    spans = {}
    for r in packed:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spans.values():
        s.sort()
        assert [a for a, _ in s] == np.cumsum([0, *(n for _, n in s[:-1])]).tolist() and sum(n for _, n in s) <= 4096
