import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm import secret_scan as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def spans(df):
    return [(r["doc_id"], [(x["start"], S.KINDS.index(x["kind"]), x["end"]) for x in r["found"]]) for r in S.find(df).collect()]


def test_base_spans_equal_a_plain_scan(odd, docs):
    for df in (odd, docs):
        want = sorted(str((r["doc_id"], base(r["text"] or ""))) for r in df.select("doc_id", "text").collect())
        assert want == sorted(str((i, [x for x in s if x[1] < 3])) for i, s in spans(df))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWD", "secret", "TOKEN", "api_key", "apikey", "=", ":", " ", "'", '"', "abc", "012345", "AKIA", "A" * 18, "f" * 23, "a", "İ", "K", "é\n"]), max_size=14).map("".join))
def test_any_mixture(text):
    assert [x for x in S.scan(text, S._automaton()) if x[1] < 3] == base(text)


def test_checksums():
    body = "A1b2" * 7 + "zz"
    good = f"ghp_{body}{S._crc_base62(body)}"
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert len(good) == 40 and zlib.crc32(body.encode()) >= 0
    kinds = lambda t: [S.KINDS[k] for _, k, _ in S.scan(t, S._automaton())]
    assert kinds(f"x {good}.") == ["code_host"] and kinds(f"x {bad}.") == []
    assert kinds("card: 4111 1111 1111 1111") == ["card"] and kinds("card: 4111 1111 1111 1112") == []
    assert kinds("eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.abc") == ["web_token"] and kinds("eyJhbGciOiJIUzI1.eyJzdWIiOiIxIn0.abc") == []
    assert kinds("-----BEGIN RSA PRIVATE KEY-----") == ["private_key"]


def test_redaction_and_empty(odd, none):
    out = S.redact(odd)
    assert out.columns == odd.columns
    assert not any(base(r["text"] or "") for r in out.select("text").collect())
    assert S.find(none).collect() == [] and S.redact(none).collect() == []
    assert S.replace("abcdef", [(1, 3), (2, 4)], "#") == "a#ef"
