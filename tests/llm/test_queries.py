"""The registered queries themselves, every column of theirs, against brute force on tables with odd rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import test_neighbours
import test_repeats
import test_scoring
import test_simhash
from conftest import EXTRA, rows

from keyloom.llm import language, queries

TABLES = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), *((c, pa.string()) for c in EXTRA)])


def folder_of(path, docs):
    """Tables of odd documents, labels and vectors in a folder."""
    pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*docs, strict=True) if docs else [[] for _ in TABLES], TABLES, strict=True)], schema=TABLES), path / "documents.parquet")
    labels = [(i, q, t) for i, q, t in ((0, 1, 0), (4, 1, 0), (6, 1, 0), (7, 1, 1), (8, 0, 0), (9, None, 0), (10, 1, 0), (10, 1, 0), (None, 1, 0), (999, 1, 0))] if docs else []
    pq.write_table(pa.table({c: pa.array([r[k] for r in labels], pa.int64()) for k, c in enumerate(("doc_id", "quality", "toxic"))}), path / "labels.parquet")
    x = np.random.default_rng(1).normal(size=(160, 8)) if docs else np.zeros((0, 8))
    pq.write_table(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(x.tolist(), pa.list_(pa.float64()))}), path / "embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def held(tmp_path_factory):
    real = pq.read_table("/root/testdata/sf0.001/documents.parquet").slice(0, 40).to_pylist()
    more = [(100 + r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) + tuple("x" for _ in EXTRA) for r in real]
    docs = rows() + more
    return folder_of(tmp_path_factory.mktemp("odd"), docs), docs


@pytest.fixture(scope="module")
def run(spark, held):
    known = {}

    def get(name):
        if name not in known:
            known[name] = queries.QUERIES[name](spark, held[0]).collect()
        return known[name]

    return get


def alike(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base_spans(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_op2(run, held):
    want = []
    for d in held[1]:
        spans = base_spans(d[1] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((d[0], *(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")), hashlib.sha256(joined.encode()).hexdigest()))
    got = run("op2_secrets")
    alike([(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got], want)
    by_id = defaultdict(set)
    for r in got:
        by_id[r["doc_id"]] |= set((r["spans"] or "").split(","))
    assert all(f"{k}:{a}:{b}" in by_id[d[0]] for d in held[1] for k, a, b in base_spans(d[1] or ""))


def test_op3(run, held):
    got = run("op3_language")
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    alike([(r["doc_id"], r["held_out"]) for r in got], [(d[0], fold(d[0])) for d in held[1]])
    letters = defaultdict(set)
    for d in held[1]:
        letters[d[0]].add(any(c.isalpha() for c in d[1] or ""))
    known = {d[2] for d in held[1] if d[2]}
    for r in got:
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] in known or r["lang_pred"] == "und")
        assert (r["lang_pred"] != "und") in letters[r["doc_id"]]


def test_op3_held_out_accuracy_and_no_use_of_labels(spark, tmp_path):
    """Right on held-out documents; with all other columns' values taken away from them, the predictions are the same."""
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet")
    rows_ = t.to_pylist()
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_language"](spark, "/root/testdata/sf0.01").collect()}
    out = [r for r in rows_ if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["lang"] and got[r["doc_id"]]["lang_pred"] != "und"]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in out) >= 0.97 * len(out)
    for r in rows_:
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
            r["lang"], r["source"] = None, "zz"
    pq.write_table(pa.Table.from_pylist(rows_, schema=t.schema), tmp_path / "documents.parquet")
    again = {r["doc_id"]: r for r in queries.QUERIES["op3_language"](spark, str(tmp_path)).collect()}
    assert all(got[i]["lang_pred"] == r["lang_pred"] and abs(got[i]["score"] - r["score"]) < 1e-12 for i, r in again.items())
    assert language.UNKNOWN == "und"


def test_op4(run, held):
    import ast

    want = []
    for text in test_repeats.brute([(d[0], d[1]) for d in held[1]]):
        i, n, spans, kept = ast.literal_eval(text)
        want.append((i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    alike([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run("op4_repeats")], want)


def test_op6(run, held):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = defaultdict(list)
    for d in held[1]:
        want[d[0]].append(np.array([*t.encode(d[1] or "", add_special_tokens=False).ids, 2], dtype="<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in run("op6_packing"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for i, docs in want.items():
        assert sum(r["length"] for r in pieces[i]) == sum(map(len, docs))
        for r in pieces[i]:
            same = [d for d in docs if len(d) == r["doc_tokens"]]
            assert any(zlib.crc32(d[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for d in same)
        if len(docs) == 1:
            at = sorted((r["start"], r["length"]) for r in pieces[i])
            assert [a for a, _ in at] == np.cumsum([0, *(n for _, n in at[:-1])]).tolist()
    padded = 0
    for spans in sequences.values():
        spans.sort()
        assert [a for a, _ in spans] == np.cumsum([0, *(n for _, n in spans[:-1])]).tolist()
        n = sum(x for _, x in spans)
        assert n <= 4096
        padded += 0 if n & (n - 1) == 0 else 4096 - n
    assert padded <= sum(len(d) for ds in want.values() for d in ds) / 20


def test_op7(run, held):
    """The target is what the labels call good and not toxic; a repeated or lacking label changes nothing."""
    good = {0, 4, 6, 10}
    want = [(d[0], *x) for d, x in zip(held[1], test_scoring.brute([(d[0], True, d[0] in good, d[1]) for d in held[1]]), strict=True)]
    order = lambda x: (x[0] is None, x[0] or 0, x[1], round(x[2], 6), round(x[3], 6))
    got = sorted(((r["doc_id"], r["n_tokens"], r["loss_background"], r["loss_target"]) for r in run("op7_scoring")), key=order)
    for a, b in zip(got, sorted(want, key=order), strict=True):
        assert a[:2] == b[:2] and np.allclose(a[2:], b[2:])
    assert all(abs(r["score"] - (r["loss_background"] - r["loss_target"])) < 1e-12 for r in run("op7_scoring"))


def test_op8(run, held):
    import xxhash

    def fingerprint(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(d[1]) for d in held[1]]
    label = test_simhash.component_of(fps)
    least = defaultdict(list)
    for d, k in zip(held[1], label, strict=True):
        if d[0] is not None:
            least[k].append(d[0])
    alike([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in run("op8_simhash")], [(d[0], f"{f:016x}", min(least[k], default=None)) for d, f, k in zip(held[1], fps, label, strict=True)])


def test_op9(run, held):
    vectors = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{held[0]}/embeddings.parquet").to_pylist()]
    got = {}
    for r in run("op9_neighbours"):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = test_neighbours.brute(vectors)
    assert set(got) == set(want)
    for q, near in got.items():
        assert [(k, i) for k, i, _ in sorted(near)] == [(k + 1, i) for k, (i, _) in enumerate(want[q])]
        assert np.allclose([s for *_, s in sorted(near)], [s for _, s in want[q]], atol=1e-12)


def test_a_common_blank(spark, tmp_path):
    """A third of all rows blank: one fingerprint, one component, and none of them lost."""
    base = rows()[:12]
    docs = base + [(1000 + i, (None, "", " \n")[i % 3], None, None, 0) + tuple("x" for _ in EXTRA) for i in range(600)]
    got = queries.QUERIES["op8_simhash"](spark, folder_of(tmp_path, docs)).collect()
    assert len(got) == len(docs) and {r["component_id"] for r in got if r["doc_id"] >= 1000} == {0}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    assert queries.QUERIES[name](spark, folder_of(tmp_path, [])).collect() == []


def test_one_very_long_text(spark, tmp_path):
    """A text of 6.5 MB, beyond every block and slice, beside one that holds some of it."""
    rng = np.random.default_rng(0)
    lexicon = np.array(["".join(rng.choice(list("abcdefghijklmnop"), n)) for n in rng.integers(2, 9, 30_000)])
    long = " ".join(lexicon[rng.integers(0, len(lexicon), 1_080_000)])[: 6_500_000]
    part = long[3_000_000:3_100_000]
    docs = [(i, t, lang, "s", len(t)) + tuple("x" for _ in EXTRA) for i, t, lang in ((1, "a short text of a few words", "en"), (2, long, "en"), (3, "before " + part + " after", "en"), (4, "encore un texte court de mots", "fr"))]
    folder = folder_of(tmp_path, docs)
    get = lambda name: {r["doc_id"]: r for r in queries.QUERIES[name](spark, folder).collect()}
    repeats = get("op4_repeats")
    assert repeats[2]["n_removed"] == 0 and repeats[2]["kept_sha256"] == hashlib.sha256(long.encode()).hexdigest() and 100_000 <= repeats[3]["n_removed"] <= 100_002
    n = len(long.split())
    assert get("op1_mixing")[2]["size"] == get("op7_scoring")[2]["n_tokens"] == get("op10_quality")[2]["n_words"] == n
    assert get("op2_secrets")[2]["n_hex"] == len([s for s in base_spans(long) if s[0] == "hex"])
    assert get("op3_language")[2]["lang_pred"] in ("en", "fr")
    assert get("op8_simhash")[2]["component_id"] == 2
    assert "op5_licenses" in queries.QUERIES and get("op5_licenses") == {}
    pieces = [r for r in queries.QUERIES["op6_packing"](spark, folder).collect() if r["doc_id"] == 2]
    assert sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"]
