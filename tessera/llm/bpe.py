"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece of text exactly one token can be the last of the
prefix's encoding. An automaton with suffix links over all tokens reports the
tokens that end at each byte, longest first; the first of them that is
compatible with the last token of the prefix before it is stored. Following the
stored tokens backwards gives the exact ids. Two tokens are compatible if the
merges, undone in reverse order, never find a pair across their border that
would have been merged earlier.

Vocabulary and merges come from a tokenizer file whose path is a parameter;
only the driver reads it, and the tables (about 1 MB) are broadcast. Pieces are
remembered per task in a bounded table.

Defined results
* null or empty text has no ids and decodes to the empty text;
* strings of added tokens in a text become their ids, as the library does;
* bytes that are not UTF-8 count as U+FFFD; rows repeated are encoded each; an
  empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workspace
from .kernels import batches

_W = r"\p{White_Space}"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|[{_W}]+(?![^{_W}])|[{_W}]+"
#: Pieces that a task remembers, and the longest of them.
REMEMBER, LONGEST = 300_000, 48


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tables:
    """What a task needs: token bytes by internal number, ids, merges, added tokens.

    Internal numbers follow the order of merging: bytes first, then the result
    of merge r at 256 + r."""

    def __init__(self, tokens: list[bytes], ids: list[int], pairs: list[tuple[int, int]], added: dict[str, int]):
        self.tokens, self.ids, self.pairs, self.added = tokens, ids, pairs, added


def load(path: str) -> Tables:
    """Tables of a byte-level BPE file in the tokenizers library's JSON form."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges"):
        raise ValueError("not a plain byte-level BPE tokenizer")
    byte_of = _byte_of_char()
    vocab = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
    tokens = [bytes([b]) for b in range(256)]
    number = {t: k for k, t in enumerate(tokens)}
    pairs = []
    for merge in model["merges"]:
        a, b = (bytes(byte_of[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
        if a + b in number:
            raise ValueError("two merges make one token")
        pairs.append((number[a], number[b]))
        number[a + b] = len(tokens)
        tokens.append(a + b)
    return Tables(tokens, [vocab[t] for t in tokens], pairs, {x["content"]: x["id"] for x in spec.get("added_tokens", [])})


class Encoder:
    """Encoding and decoding with one set of tables."""

    def __init__(self, tables: Tables):
        n = len(tables.tokens)
        self.left, self.right = list(range(256)), list(range(256))
        self.merged = {}
        for k, (a, b) in enumerate(tables.pairs):
            self.left.append(a)
            self.right.append(b)
            self.merged[a * n + b] = 256 + k
        self.count = n
        self.size = [len(t) for t in tables.tokens]
        self.ids = tables.ids
        self.fits: dict[int, bool] = {}
        reachable = [True] * n
        for t in range(256, n):  # a token that its own bytes do not encode to never appears
            a, b = self.left[t], self.right[t]
            reachable[t] = reachable[a] and reachable[b] and self._own(a, b, t)
        self.matches = ahocorasick.Automaton()
        for t in range(n):
            if reachable[t]:
                self.matches.add_word(tables.tokens[t].decode("latin-1"), t)
        self.matches.make_automaton()
        self.number = {t: k for k, t in enumerate(tables.tokens) if reachable[k]}
        self.bytes_of = {i: t for i, t in zip(tables.ids, tables.tokens)} | {i: s.encode() for s, i in tables.added.items()}
        self._spans(max(self.bytes_of) + 1)
        self.added = tables.added
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(tables.added, key=len, reverse=True)) + ")") if tables.added else None
        self.split = regex.compile(PIECE).findall
        self.pieces = _Pieces(self)

    def _own(self, a: int, b: int, t: int) -> bool:
        """Whether the pair that makes token t survives until its own merge."""
        return self._compatible(a, b, t)

    def _compatible(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether no merge below ``limit`` joins bytes across the border of a and b
        before both are whole; undoes the later of the two merges each time."""
        left, right, merged, n = self.left, self.right, self.merged, self.count
        while True:
            made = merged.get(a * n + b)
            if made is not None and made < limit:
                return False
            if a > b:
                if a < 256:  # both are bytes
                    return True
                limit = a
                a = right[a]
            else:
                if b < 256:
                    return True
                limit = b + 1
                b = left[b]

    def compatible(self, a: int, b: int) -> bool:
        key = a * self.count + b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            known = self.fits[key] = self._compatible(a, b)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Internal numbers of a piece: last token of every prefix, then backwards."""
        whole = self.number.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        last = [-1] * n
        size, compatible = self.size, self.compatible
        for end, t in self.matches.iter(piece.decode("latin-1")):
            if last[end] < 0:
                before = end - size[t]
                if before < 0 or last[before] >= 0 and compatible(last[before], t):
                    last[end] = t
        out, at = [], n - 1
        while at >= 0:
            t = last[at]
            out.append(t)
            at -= size[t]
        out.reverse()
        return out

    def joined(self, text: str) -> str:
        """Decimal ids of a text, joined by commas."""
        get = self.pieces.__getitem__
        if self.cut is None or not any(s in text for s in self.added):
            return ",".join(map(get, self.split(text)))
        parts = []
        for part in self.cut.split(text):
            if part in self.added:
                parts.append(str(self.added[part]))
            elif part:
                parts.append(",".join(map(get, self.split(part))))
        return ",".join(parts)

    def encode(self, text: str | None) -> list[int]:
        joined = self.joined(text or "")
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode_joined(self, joined: str) -> bytes:
        """UTF-8 of the text that comma-joined ids stand for."""
        if not joined:
            return b""
        ids = np.fromstring(joined, np.int64, sep=",")
        size = self.span_size[ids]
        if not size.all():
            raise ValueError("an id that the vocabulary lacks")
        ends = np.cumsum(size)
        raw = self.span_bytes[np.arange(ends[-1]) + np.repeat(self.span_start[ids] - ends + size, size)].tobytes()
        return raw.decode("utf-8", "replace").encode()

    def _spans(self, n: int) -> None:
        """All tokens' bytes in one buffer, with the place of each id."""
        self.span_size, self.span_start = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = 0
        for i, t in self.bytes_of.items():
            self.span_size[i], self.span_start[i] = len(t), at
            at += len(t)
        self.span_bytes = np.frombuffer(b"".join(self.bytes_of.values()), np.uint8)


class _Pieces(dict):
    """Piece -> its decimal ids joined by commas, worked out when first asked for."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> str:
        e = self.encoder
        value = ",".join([str(e.ids[t]) for t in e.encode_piece(piece.encode())])
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBER:
                self.clear()
            self[piece] = value
        return value


_encoders: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per worker process, kept for as long as the same tables are
    asked for: a later job finds it, whatever broadcast brings them."""
    if shared.id not in _encoders:
        _encoders.clear()
        _encoders[shared.id] = Encoder(shared.value)
    return _encoders[shared.id]


class _Shared:
    """A broadcast of tables with a digest of them."""

    def __init__(self, sc, tables):
        self.broadcast = sc.broadcast(tables)
        self.id = hashlib.sha256(repr((tables.tokens, tables.ids, tables.pairs, tables.added)).encode()).hexdigest()

    def __getstate__(self):
        return (self.broadcast, self.id)

    def __setstate__(self, state):
        self.broadcast, self.id = state

    @property
    def value(self):
        return self.broadcast.value


def _strings(column: pa.Array) -> list[str]:
    return [b.decode("utf-8", "replace") if b else "" for b in column.cast(pa.binary()).to_pylist()]


def _texts(docs: DataFrame) -> DataFrame:
    workspace.ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) for every row of ``docs`` (doc_id, text)."""
    shared = _Shared(docs.sparkSession.sparkContext, load(path))

    def run(stream):
        encoder = _encoder(shared)
        for batch in batches(stream):
            ids = pa.array([encoder.encode(t) for t in _strings(batch.column(1))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text for every row of ``encoded`` (doc_id, ids); null ids are the empty text."""
    shared = _Shared(encoded.sparkSession.sparkContext, load(path))

    def run(stream):
        encoder = _encoder(shared)
        for batch in batches(stream):
            texts = pa.array([encoder.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])

    workspace.ship(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def encode_checked(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, position, n_tokens, ids, decoded_sha256 for every row of ``docs``.
    ``position`` rises in the order in which ``docs`` was stored (null if it was not)."""
    workspace.ship(docs.sparkSession)
    shared = _Shared(docs.sparkSession.sparkContext, load(path))

    def run(stream):
        encoder = _encoder(shared)
        for batch in batches(stream):
            ids, decoded = [], []
            for text in _strings(batch.column(1)):
                joined = encoder.joined(text)
                ids.append(np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32))
                decoded.append(hashlib.sha256(encoder.decode_joined(joined)).hexdigest())
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(ends), pa.int64()), lists, pa.array(decoded, pa.string())], names=["doc_id", "position", "n_tokens", "ids", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), workspace.file_order(docs).alias("position"))
    return rows.mapInArrow(run, "doc_id long, position long, n_tokens long, ids array<int>, decoded_sha256 string")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text is encoded, and
    its ids are decoded again, in one pass; only the digests leave the task."""
    shared = _Shared(docs.sparkSession.sparkContext, load(path))

    def run(stream):
        encoder = _encoder(shared)
        for batch in batches(stream):
            counts, ids, decoded = [], [], []
            for text in _strings(batch.column(1)):
                joined = encoder.joined(text)
                counts.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode_joined(joined)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
