import random

import numpy as np
import pyarrow as pa

from tessera.llm import kernels


def words_of(texts, **options):
    return kernels.split_words(*kernels.text_buffer(pa.array(texts, pa.string())), **options)


def test_words_are_those_of_bytes_split():
    r = random.Random(1)
    texts = ["".join(r.choice("aB ß\t\n\x0b\x0c\r\x1c 漢.") for _ in range(r.randrange(30))) for _ in range(400)] + [None, "", "  ", "x" * 5000]
    w = words_of(texts)
    raw = w.data.tobytes()
    at = 0
    for t, n in zip(texts, w.counts):
        assert [raw[a:b] for a, b in zip(w.starts[at : at + n], w.ends[at : at + n])] == (t or "").encode().lower().split()
        at += n
    assert at == len(w.starts)


def test_equal_words_have_equal_hashes_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(kernels, "_SEGMENT", 64)
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(50)] + ["y" * 200]
    texts = [" ".join(r.choice(vocabulary) for _ in range(40)) for _ in range(30)]
    seen = {}
    w = words_of(texts)
    for word, h in zip(" ".join(texts).split(), w.hashes.tolist()):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_windows_depend_on_content_alone():
    h = words_of(["a b c d a b c", "x a b c"]).hashes
    three = kernels.windows(h, 3)
    assert three[0] == three[4] == three[8] and three[0] != three[1]
    assert len(kernels.windows(h[:2], 3)) == 0


def test_batches_hold_rows_together():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 50)], names=["t"])
    parts = list(kernels.batches([batch], 4000))
    assert sum(p.num_rows for p in parts) == 50 and len(parts) > 5
    assert not list(kernels.batches([batch.slice(0, 0)]))


def test_sliced_columns():
    column = pa.array(["aa", "bb cc", None, "dd"]).slice(1)
    assert kernels.split_words(*kernels.text_buffer(column)).counts.tolist() == [2, 0, 1]
    assert np.array_equal(words_of(["bb cc"]).hashes, kernels.split_words(*kernels.text_buffer(column)).hashes[:2])
