import pytest

LONG = " ".join(f"word{i % 977}x" for i in range(30_000))
SHARED = "a passage of some length that stands in more than one of the documents here, word for word"
TEXTS = [
    None, "", "   \n\t", "one", "two words", "Three short words", LONG,
    SHARED + " first", SHARED + " second", "before it " + SHARED, SHARED + " first",
    "password = hunter2222 and token:'abcdef99' AKIA" + "A1B2" * 5 + " deadbeef" * 3 + "deadbeefdeadbeefdeadbeef",
    "Licensed under the Apache License, Version 2.0.", "x y z x y z x y z x y z x y z x y z",
    "line one here\nline one here\n\nother\nline one here", "ÄÖÜ straße ñandú 日本語 текст на русском İstanbul",
    "\x0b\x0cvertical and form feed\x85next", "don't we'll it's '!s 12345 <|endoftext|> end",
]
#: columns that share names with what operators use inside
EXTRA = ["id", "fp", "size", "key", "part", "found", "spans", "h", "ws", "hs", "score", "length", "taken", "target", "group", "bucket", "n", "doc", "start", "component", "host", "kept", "v"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def rows():
    out = []
    for i, t in enumerate(TEXTS):
        out.append((i, t, None if i % 5 == 0 else ("en", "de")[i % 2], None if i % 4 == 0 else f"s{i % 3}", len(t or "")))
    out += [out[7], out[7], (None, SHARED + " first", "en", "s1", 3), (None, None, None, None, None), (3, "another text under an id that is taken", "en", None, None)]
    return [r + tuple("x" for _ in EXTRA) for r in out]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, repeated rows and ids, and columns with clashing names."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
