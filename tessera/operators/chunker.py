"""Structure-aware chunking: blocks of a document packed greedily into chunks.

Works on UTF-8 bytes throughout, since sizes and offsets are byte counts. A
document is cut into blocks (blank line, heading, fenced code, paragraph);
blocks are packed up to ``target`` bytes; a heading starts a new chunk; a block
over ``max`` bytes is split at the best place within its budget.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..errors import ConfigError

_BLANK = b" \t\n\f\r"
_HEADING = re.compile(rb" {0,3}#{1,6}(?![^ \t])(.*)", re.S)
#: Lines that are not blank, one after the other.
_PARAGRAPH = re.compile(rb"(?m)^(?:[ \t\f\r]*+[^ \t\n\f\r][^\n]*(?:\n|\Z))+")
_FENCE = re.compile(rb" {0,3}(`{3,}(?!.*`)|~{3,})", re.S)


@dataclass(frozen=True)
class ChunkerConfig:
    target: int = 1200
    max: int = 2400

    def __post_init__(self):
        if self.target < 64:
            raise ConfigError(f"target {self.target} is below 64 bytes")
        if self.max < self.target:
            raise ConfigError(f"max {self.max} is below target {self.target}")


@dataclass(frozen=True)
class Chunk:
    text: str
    start: int
    end: int
    heading: str | None
    kind: str


def is_blank(line: bytes) -> bool:
    return not line.strip(_BLANK)


def heading_text(line: str | bytes) -> str | None:
    """Text of an ATX heading line (``## Title ##`` gives ``Title``), or None."""
    found = _HEADING.fullmatch(line.encode() if isinstance(line, str) else line)
    return found and found[1].decode().strip().rstrip("#").rstrip()


def fence_open(line: bytes) -> tuple[bytes, int] | None:
    found = _FENCE.match(line)
    return found and (found[1][:1], len(found[1]))


def fence_closes(line: bytes, mark: bytes, run: int) -> bool:
    return re.fullmatch(rb" {0,3}" + re.escape(mark) + b"{%d,}[ \\t\\n\\f\\r]*" % run, line) is not None


def split_point(text: str | bytes, budget: int) -> int:
    """Where to cut within ``budget`` bytes: after a line, a sentence or a word if
    that keeps more than half, else between two characters; always makes progress."""
    raw = text.encode() if isinstance(text, str) else text
    if len(raw) <= budget:
        return len(raw)
    cut = max(0, budget)
    while cut and raw[cut] & 0xC0 == 0x80:
        cut -= 1
    if not cut:
        cut = 1
        while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
            cut += 1
        return cut
    half = cut // 2
    for found in (raw.rfind(b"\n", 0, cut) + 1, raw.rfind(b". ", 0, cut) + 2 if raw.rfind(b". ", 0, cut) >= 0 else 0, max(raw.rfind(b" ", 0, cut), raw.rfind(b"\t", 0, cut)) + 1):
        if found > half:
            return found
    return cut


def estimate_tokens(text: str) -> int:
    """As functions.text.estimate_tokens, for one string."""
    raw = text.encode()
    words = re.findall(rb"[A-Za-z0-9_\x80-\xff]+", raw)
    return sum(-(-len(w) // 6) for w in words) + len(re.findall(rb"[^A-Za-z0-9_\x80-\xff \t\n\f\r]", raw))


_PART_OF_WORD = np.zeros(256, bool)
_PART_OF_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\f\r")] = True


def token_counts(texts: list[bytes]) -> np.ndarray:
    """``estimate_tokens`` of many texts, in a few passes over all their bytes."""
    ends = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    word = _PART_OF_WORD[data]
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    inner = ends[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner], stop[inner - 1] = word[inner], word[inner - 1]
    starts = np.flatnonzero(begin)
    tokens = np.r_[0, np.cumsum((np.flatnonzero(stop) - starts) // 6 + 1)]
    signs = np.flatnonzero(~word & ~_SPACE[data])
    return np.diff(tokens[np.searchsorted(starts, ends)]) + np.diff(np.searchsorted(signs, ends))


def _blocks(raw: bytes, markdown: bool):
    """(start, end, kind, heading) of every block; blank ones may be left out."""
    if not markdown:
        for found in _PARAGRAPH.finditer(raw):
            yield found.start(), found.end(), "paragraph", None
        return
    at, n = 0, len(raw)

    def line(k):
        stop = raw.find(b"\n", k)
        return (n, n) if stop < 0 else (stop, stop + 1)

    while at < n:
        stop, following = line(at)
        first = raw[at:stop]
        if is_blank(first):
            yield at, following, "blank", None
            at = following
            continue
        title = heading_text(first)
        if title is not None:
            yield at, following, "heading", title
            at = following
            continue
        fence = fence_open(first)
        end = following
        if fence:
            while end < n:
                stop, following = line(end)
                closed = fence_closes(raw[end:stop], *fence)
                end = following
                if closed:
                    break
        else:
            while end < n:
                stop, following = line(end)
                inner = raw[end:stop]
                if is_blank(inner) or heading_text(inner) is not None or fence_open(inner):
                    break
                end = following
        yield at, end, "fence" if fence else "paragraph", None
        at = end


def chunk_text(text: str | None, kind: str = "text", config: ChunkerConfig = ChunkerConfig()) -> list[Chunk]:
    """Chunks of a document; ``kind`` is markdown, text or code."""
    raw = (text or "").encode()
    out: list[Chunk] = []
    title: str | None = None
    begin = end = -1  # of the open chunk
    body = prose = code = False

    def emit(lo, hi, what):
        cut = raw[lo:hi].decode().rstrip()
        if cut:
            out.append(Chunk(cut, lo, lo + len(cut.encode()), title, what))

    def flush():
        nonlocal begin, body, prose, code
        if begin >= 0:
            emit(begin, end, "mixed" if prose and code else "code" if code else "prose")
        begin, body, prose, code = -1, False, False, False

    for lo, hi, what, name in _blocks(raw, kind == "markdown"):
        if what == "blank":
            continue
        if what == "heading":
            if body:
                flush()
            if begin < 0:
                begin = lo
            title, prose, end = name, True, hi
            continue
        is_code = what == "fence" or kind == "code"
        size = hi - lo
        if body and end - begin + size > config.target or body and size > config.max:
            flush()
        if begin < 0:
            begin = lo
        if size > config.max:
            budget = max(config.max - (lo - begin), config.max // 2)
            cut = lo + split_point(raw[lo:hi], budget)
            piece = "code" if is_code else "prose"
            emit(begin, cut, "mixed" if prose and is_code else piece)
            while cut < hi:
                following = cut + split_point(raw[cut:hi], config.max)
                emit(cut, following, piece)
                cut = following
            begin, body, prose, code = -1, False, False, False
            continue
        prose, code = prose or not is_code, code or is_code
        body, end = True, hi
    flush()
    return out


CHUNKS = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("heading", pa.string()), ("kind", pa.string()), ("tokens", pa.int64())]))


#: Text that is chunked at once: a batch is taken in pieces that end with the row that reaches it.
PIECE = 1 << 20


def pieces(batch: pa.RecordBatch, at: int):
    """``batch`` in slices of bounded text in column ``at``; one row is never cut."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), np.int64)
    if not len(sizes):
        yield batch
    of = (np.cumsum(sizes) - sizes) // PIECE
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
    for lo, hi in zip(starts, [*starts[1:], len(sizes)]):
        yield batch.slice(lo, hi - lo)


def chunk_documents(df: DataFrame, *, text: str = "text", kind: str | None = "kind", config: ChunkerConfig = ChunkerConfig()) -> DataFrame:
    """``df`` with a column ``chunks``: an array of (text, start, end, heading,
    kind, tokens) structs per document. ``kind`` names a column, or is None for plain text."""
    at, of = df.columns.index(text), df.columns.index(kind) if kind else None

    def run(stream):
        for batch in (piece for whole in stream for piece in pieces(whole, at)):
            kinds = batch.column(of).to_pylist() if of is not None else ["text"] * batch.num_rows
            made = [chunk_text(t, k or "text", config) for t, k in zip(batch.column(at).to_pylist(), kinds)]
            each = [c for chunks in made for c in chunks]
            tokens = token_counts([c.text.encode() for c in each])
            columns = [pa.array([getattr(c, f.name) for c in each], f.type) for f in list(CHUNKS.value_type)[:-1]]
            flat = pa.StructArray.from_arrays([*columns, pa.array(tokens, pa.int64())], fields=list(CHUNKS.value_type))
            ends = pa.array(np.cumsum([0, *map(len, made)], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, flat)], names=[*batch.schema.names, "chunks"])

    schema = df.selectExpr("*", "cast(null as array<struct<text:string,start:bigint,end:bigint,heading:string,kind:string,tokens:bigint>>) as chunks").schema
    return df.mapInArrow(run, schema)
