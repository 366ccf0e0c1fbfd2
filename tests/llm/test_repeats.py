import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm import repeats as R


def brute(rows, length=50):
    """(id, removed runs, kept bytes) of every row, by a dictionary of all windows."""
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        if i is not None:
            for k in range(len(b) - length + 1):
                w = b[k : k + length]
                least[w] = min(i, least.get(w, i))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), dtype=bool)
        if i is not None:
            for k in range(len(b) - length + 1):
                if least[b[k : k + length]] < i:
                    gone[k : k + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((i, len(b), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(map(str, out))


def run(df, **how):
    return sorted(str((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"]))) for r in R.remove_repeats(df, **how).collect())


def test_equals_brute_force(docs, odd):
    for df in (docs, odd):
        want = brute([tuple(r) for r in df.select("doc_id", "text").collect()])
        assert run(df) == want
        assert run(df, block_bytes=60_000) == want


def test_repeats_at_every_offset(spark):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared = word(120)
    rows = [(int(i), word(rng.integers(0, 60)) + shared[: rng.integers(40, 120)] + word(rng.integers(0, 60))) for i in rng.permutation(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id").cache()
    assert run(df, block_bytes=500) == brute(rows)


def test_runs_of_one_letter(spark):
    rows = [(1, "a" * 300), (2, "a" * 49), (3, "b" + "a" * 50 + "c"), (0, "a" * 10), (5, "ab" * 100), (6, "ba" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df) == brute(rows)


def test_a_common_line_in_many_surroundings(spark):
    """Hot keys travel window by window, with the same result; no group holds more parts than the limit."""
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    line = "a line of forty-seven bytes, more or less, here"
    rows = [(i, word(rng.integers(20, 90)) + line + word(rng.integers(20, 90)) + (line * 2 if i % 3 == 0 else "")) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id").cache()
    want = brute(rows)
    for hot in (0, 5, 10_000):
        assert run(df, block_bytes=2_000, hot=hot) == want
    parts = R.Parts(list(range(80)), [t.encode() for _, t in rows])
    assert parts.numbered(5)[3].max() > 20  # so the middle limit is met


@given(st.lists(st.text("ab", max_size=130), min_size=2, max_size=6), st.integers(0, 1))
@settings(max_examples=60, deadline=None)
def test_exchange_in_one_process(texts, hot):
    """The three exchanges without Spark, on texts that repeat themselves everywhere."""
    rows = list(enumerate(texts))
    n = 3
    held = {b: ([i], [t.encode()], [None]) for b, (i, t) in enumerate(rows)}

    def meet(messages, reply):
        out = []
        for to in sorted({m[0] for m in messages}):
            mine = sorted((m for m in messages if m[0] == to), key=lambda m: m[1])
            out += [(to, m[1], body) for m, body in zip(mine, reply([m[2] for m in mine]), strict=True) if body is not None]
        return out

    def at_blocks(answers, use):
        for b in held:
            for batch in use(b, held[b], sorted((to, body) for to, at, body in answers if at == b)):
                yield from batch.to_pylist()

    verdicts = meet([(to, b, body) for b in held for to, body in R._say_keys(n)(b, held[b])], R._match_keys(hot))
    parts = [tuple(r.values()) for r in at_blocks(verdicts, R._say_parts(n))]
    got = list(at_blocks(meet(parts, R._compare), R._cut_texts("doc_id")))
    assert sorted(str((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], r["kept"])) for r in got) == brute(rows)


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(2)
    length = rng.integers(60, 70, 300)
    buf = np.concatenate([rng.integers(97, 99, int(length.sum())), np.zeros(64)]).astype(np.uint8)
    buf[100:160] = buf[200:260]
    first = np.cumsum(length) - length
    at = np.repeat(first, 10) + np.tile(np.arange(10), 300)
    at[5] = at[4]
    group = np.sort(rng.integers(0, 40, len(at)))
    order, new = R.Suffixes(buf, first, length).sort(at, group)
    key = [(group[i], buf[at[i] : at[i] + 50].tobytes()) for i in order]
    assert key == sorted(key) and sorted(order) == list(range(len(at)))
    assert new.tolist() == [True] + [a != b for a, b in zip(key[1:], key, strict=False)]


def test_collisions_are_settled_by_bytes(monkeypatch, docs):
    """With hashes that mean nothing every order and equality must still come out right."""
    s = R.Suffixes(np.frombuffer(b"x" * 60 + b"y" * 60 + b"x" * 60 + bytes(64), dtype=np.uint8), np.array([0, 60, 120]), np.array([60, 60, 60]))
    s.prefix[:] = 0
    order, new = s.sort(np.array([0, 60, 120, 1]), np.zeros(4, dtype=np.int64))
    assert sorted(order[:3].tolist()) == [0, 2, 3] and new.tolist() == [True, False, False, True]
    rows = [tuple(r) for r in docs.select("doc_id", "text").limit(12).collect()]
    want = brute(rows)
    monkeypatch.setattr(R, "key_hashes_of", lambda buf, first, length: np.zeros(len(first), dtype=np.uint64))
    monkeypatch.setattr(R, "_mix", lambda a: a * np.uint64(0))
    held = ([i for i, _ in rows], [(t or "").encode() for _, t in rows], [None] * len(rows))
    verdict = [(to, 0, body) for to, body in R._say_keys(1)(0, held)]
    verdict = [(to, body) for (to, _, _), body in zip(verdict, R._match_keys(10**9)([v[2] for v in verdict]), strict=True)]
    parts = [r["body"] for batch in R._say_parts(1)(0, held, verdict) for r in batch.to_pylist()]
    answers = [(0, body) for body in R._compare(parts) if body is not None]
    got = [r for batch in R._cut_texts("doc_id")(0, held, answers) for r in batch.to_pylist()]
    assert sorted(str((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], r["kept"])) for r in got) == want


def test_empty(none):
    assert R.remove_repeats(none).collect() == []
