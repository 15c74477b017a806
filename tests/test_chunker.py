import tracemalloc

import pyarrow as pa
import pytest

from tessera.errors import ConfigError
from tessera.operators import chunker as C


def chunks(text, kind="markdown", target=64, most=256):
    return C.chunk_text(text, kind, C.ChunkerConfig(target, most))


def test_sections():
    text = "# Intro\n\nFirst words here.\n\n## Install\n\nStep one of it all.\n\nStep two of it all.\n\n## Usage\n\nRun it.\n"
    got = chunks(text)
    assert [c.heading for c in got] == ["Intro", "Install", "Usage"]
    for c in got:
        assert text.encode()[c.start : c.end].decode() == c.text


def test_runs_of_headings_stay_with_their_text():
    (c,) = chunks("# A\n\n## B\n\nbody of b\n")
    assert c.heading == "B" and c.text.startswith("# A") and c.kind == "prose"
    assert [(c.text, c.kind) for c in chunks("# only\n")] == [("# only", "prose")]


def test_fences_are_whole():
    text = "Some prose before it.\n\n```python\n# not a heading\n\nx = 1\n```\n\nSome prose after it.\n"
    got = chunks(text, target=64, most=1024)
    code = [c for c in got if "```" in c.text]
    assert len(code) == 1 and code[0].text.count("```") == 2 and all(c.heading is None for c in got)
    assert chunks("```\nopen to the end\n\n# still code\n")[0].kind == "code"
    assert chunks("````\n```\n````\nafter\n")[0].text.startswith("````\n```\n````")


def test_packing():
    text = "\n\n".join(f"Paragraph {k} says the same thing. " * 4 for k in range(40))
    got = chunks(text, "text", 400, 800)
    assert len(got) > 5 and all(len(c.text.encode()) <= 800 for c in got)
    assert sum(len(c.text) for c in got) > 0.9 * len(text)


def test_multibyte():
    got = chunks("ü" * 3000 + "\n\nshort tail\n", "text", 100, 500)
    assert all(len(c.text.encode()) <= 500 for c in got) and sum(len(c.text.encode()) for c in got) == 6010


def test_code():
    text = "# a comment\nfn a() {}\n\nfn bb() {\n}\n\nfn c() {}\n"
    got = C.chunk_text(text * 4, "code", C.ChunkerConfig(64, 200))
    assert all(c.kind == "code" and c.heading is None for c in got) and len(got) > 1


def test_degenerate_texts():
    assert chunks("") == chunks(None) == chunks(" \n\t\n \r\n") == []
    assert [c.text for c in chunks("no end of line", "text")] == ["no end of line"]
    assert [c.text for c in chunks("a\r\n\r\nb\r\n", "text")] == ["a\r\n\r\nb"]
    assert [c.text for c in chunks("a" + "\n" * 300 + "b", "text", 64, 64)][-1].endswith("b")
    long = "# " + "h" * 100 + "\n" + "word " * 45
    assert len(chunks(long, target=64, most=230)[0].text.encode()) > 230  # a heading is not charged to its block


def test_helpers():
    assert C.heading_text("### Title ###") == "Title" and C.heading_text("#hashtag") is None and C.heading_text("#" * 7 + " x") is None and C.heading_text("#") == ""
    assert C.split_point("hello world foo", 13) == 12 and C.split_point("line one\nline two", 12) == 9 and C.split_point("日本語", 2) == 3
    assert C.split_point("ab. cdefgh", 6) == 4 and C.split_point("abcdefgh", 4) == 4 and C.split_point("", 4) == 0
    assert C.estimate_tokens("Hello, world!") == 4 and C.estimate_tokens("") == 0
    assert C.fence_open(b"``` a`b") is None and C.fence_open(b"~~~~ x") == (b"~", 4) and C.fence_closes(b"~~~~~ \r", b"~", 4)


def test_config():
    for bad in ((63, 100), (100, 99)):
        with pytest.raises(ConfigError):
            C.ChunkerConfig(*bad)


def test_documents(spark):
    df = spark.createDataFrame([(1, "# H\n\nbody", "markdown"), (2, None, "text"), (3, "x", None)], "id long, text string, kind string")
    got = {r["id"]: r["chunks"] for r in C.chunk_documents(df).collect()}
    assert got[1][0]["heading"] == "H" and got[2] == [] and got[3][0]["text"] == "x"


def test_token_counts_of_many_texts():
    texts = ["", "one", "a longer_word, and more", "seven77 é漢字! ?", " \t\n\x0b", "", "x" * 13 + "-" + "y" * 6, "end"]
    assert C.token_counts([t.encode() for t in texts]).tolist() == [C.estimate_tokens(t) for t in texts]
    assert C.token_counts([]).tolist() == [] and C.token_counts([b"", b""]).tolist() == [0, 0]


def test_batches_are_taken_in_pieces(spark, monkeypatch):
    rows = [(i, None if i % 7 == 3 else f"text {i} " * (i % 50)) for i in range(300)] + [(300, "x " * C.PIECE), (301, "")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["id", "text"])
    for most in (1, 100, 5000, 1 << 30):
        monkeypatch.setattr(C, "PIECE", most)
        got = list(C.pieces(batch, 1))
        assert pa.Table.from_batches(got).to_pylist() == batch.to_pylist()
        assert all(sum(len(x or "") for x in p.column(1).to_pylist()[:-1]) < most for p in got)
    assert [p.num_rows for p in C.pieces(batch.slice(0, 0), 1)] == [0]


def test_chunks_of_many_texts_need_little_memory():
    """The counts of tokens of one batch took sixteen bytes for each byte of text."""
    texts = [b"some words, and more. " * 100] * 1000
    C.token_counts(texts[:1])
    tracemalloc.start()
    got = C.token_counts(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [C.estimate_tokens(texts[0].decode())] * 1000 and most < 14 * sum(map(len, texts))
