"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. Each chunk is pre-tokenised on its own; neighbours are stitched at a boundary that
both have in the overlap, where the pre-tokeniser has resynchronised; the text's pre-tokens, each whole, are then encoded one by one.

Why this is exact: the pre-token pattern looks ahead but never back, so what it matches from a position depends only on the text
from there on. A boundary of the left chunk is a true one unless the match that made it came within ``_AHEAD`` characters of the
chunk's end. From a true boundary that the right chunk also has, the right chunk goes on as the whole text would.
Where an overlap holds no such boundary (a run of thousands of letters), the left chunk goes on over the text, twice as far each time, until it has a
boundary that some later chunk has, or the text ends.

Documents up to ``long_chars`` are encoded where they lie. Longer ones are cut into chunks that are dealt over all tasks for pre-tokenising,
so that one huge text doesn't hold up one task; a document's chunks then meet in a task of its own, which holds no more than the row that was read.
Both ways run the same functions and give the same ids.

Defined cases: a null text counts as empty; empty texts have 0 tokens and the digest of no bytes. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LONG, STRING, batch_of, few_rows_a_batch, schema, small_batches, texts

CHUNK_CHARS, OVERLAP_CHARS, LONG_CHARS = 32_768, 256, 65_536
#: Pre-tokens whose ids a worker remembers.
CACHE_PIECES = 400_000
#: Matches that end this close to a chunk's end may look different with more text.
_AHEAD = 2


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    """Ranks from a file on each machine, a pre-token pattern, a bounded memory of encoded pre-tokens."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.find = regex.compile(pattern)
        top = max(ranks.values()) + 1
        known = {i: b for b, i in ranks.items()}
        self.length = np.array([len(known.get(i, b"")) for i in range(top)], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.raw = np.frombuffer(b"".join(known.get(i, b"") for i in range(top)), np.uint8)
        self.memory: dict[str, bytes] = {}

    def boundaries(self, text: str) -> list[int]:
        """Where the pre-tokens of a text end."""
        return [m.end() for m in self.find.finditer(text)]

    def ids(self, pieces: list[str]) -> bytes:
        """Ids of whole pre-tokens, as little-endian unsigned 32-bit integers."""
        memory = self.memory
        try:
            return b"".join([memory[p] for p in pieces])
        except KeyError:
            pass
        if len(memory) > CACHE_PIECES:
            memory.clear()
        out = []
        for p in pieces:
            got = memory.get(p)
            if got is None:
                got = b"".join(i.to_bytes(4, "little") for i in self.encoding.encode_ordinary(p))
                if len(p) <= 64:
                    memory[p] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The raw bytes of the ids, one after another."""
        i = np.frombuffer(ids, "<u4")
        n = self.length[i]
        ends = np.cumsum(n)
        return self.raw[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[i] - (ends - n), n)].tobytes()

    def encode(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> bytes:
        """A whole text, by chunks, in one place."""
        if len(text) <= chunk:  # one chunk has all the pre-tokens
            return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        parts = [(a, text[a : a + chunk + overlap]) for a in range(0, len(text), chunk)]
        cuts = stitched([(a, len(t), self.boundaries(t)) for a, t in parts], len(text), lambda a, z: self.boundaries(text[a:z]))
        return b"".join(self.ids([text[i:j] for i, j in zip(cut, cut[1:], strict=False)]) for cut in cuts)


def stitched(parts: list[tuple[int, int, list[int]]], n: int, more) -> list[list[int]]:
    """True boundaries of a text of ``n`` characters, in lists, each starting where the last one ended.

    parts: start, length and ends of matches of each chunk, in order. more(a, z): the ends of matches of the text from a to z, counted from a.
    """
    out: list[list[int]] = []
    at, k = 0, 0  # a true boundary; the chunk to read from
    later: dict[int, int] = {}  # boundaries of later chunks, and the chunk; made where an overlap holds none
    while at < n:
        start, length, ends = parts[k]
        last = start + length >= n
        sure = [start + e for e in ends if start + e > at and (last or e <= length - _AHEAD)]
        if last:
            out.append([at, *sure])
            break
        nxt_start, _, nxt_ends = parts[k + 1]
        theirs = {nxt_start, *(nxt_start + e for e in nxt_ends)}
        # A match that ends well before the chunk's end is what it would be in the whole text.
        meet = next((p for p in reversed(sure[:-1]) if p in theirs and p >= nxt_start), None)
        if meet is not None:
            out.append([at, *(p for p in sure if p <= meet)])
            at, k = meet, k + 1
            continue
        # No resynchronisation: go on over the text from the last sure boundary.
        if not later:
            later = {p: j for j, (s, _, e) in enumerate(parts) for p in (s, *(s + x for x in e)) if p < n}
        tail, size = (sure[-2] if len(sure) > 1 else at), length
        while True:
            end = min(n, tail + size)
            found = [tail + e for e in more(tail, end) if end == n or e <= end - tail - _AHEAD]
            met = next((p for p in found if later.get(p, -1) > k), None)
            if met is not None or end == n:
                break
            size *= 2
        out.append([at, *(p for p in sure if p <= tail), *(p for p in found if met is None or p <= met)])
        if met is None:
            break
        at, k = met, later[met]
    return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    key = (ranks_path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, long_chars: int = LONG_CHARS, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of documents (text: string) with n_tokens, ids (little-endian unsigned 32-bit integers), decoded_sha256 and ids_sha256."""
    few_rows_a_batch(docs.sparkSession)
    ranks_path, pattern = ranks_path or default_ranks(), pattern or default_pattern()
    kept = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    names = [f.name for f in kept.schema.fields[:-1]]
    kinds = T.StructType([*kept.schema.fields[:-1], *schema(n_tokens=LONG, ids=T.BinaryType(), ids_sha256=STRING, decoded_sha256=STRING).fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in small_batches(batches, 16 << 20):
            ids = [c.encode(t, chunk_chars, overlap_chars) for t in texts(b.column(b.num_columns - 1))]
            made = {"n_tokens": [len(i) // 4 for i in ids], "ids": ids, "ids_sha256": list(map(_sha, ids)), "decoded_sha256": [_sha(c.decode(i)) for i in ids]}
            yield batch_of(kinds, {c: b.column(k) for k, c in enumerate(names)} | made)

    short = kept.filter(F.length("__text") <= long_chars).mapInArrow(rows, kinds)
    long = kept.filter(F.length("__text") > long_chars)

    # Long texts: a row a chunk, dealt over tasks by document and chunk, pre-tokenised there.
    numbered = long.withColumn("__row", F.monotonically_increasing_id())
    piece_kinds = T.StructType([*(f for f in numbered.schema.fields if f.name != "__text"), *schema(__at=LONG, __n=LONG, __text=STRING).fields])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 4 << 20):
            for i, text in enumerate(texts(b.column("__text"))):
                at = list(range(0, len(text), chunk_chars))
                for j in range(0, len(at), 64):
                    some = at[j : j + 64]
                    same = pa.array([i] * len(some), pa.int64())
                    yield batch_of(piece_kinds, {f.name: b.column(f.name).take(same) for f in piece_kinds.fields[:-3]} | {"__at": some, "__n": [len(text)] * len(some), "__text": [text[a : a + chunk_chars + overlap_chars] for a in some]})

    chunks = numbered.select(*names, "__row", "__text").mapInArrow(pieces, piece_kinds).repartition(F.col("__row"), F.col("__at"))
    chunk_names = chunks.columns
    cut_kinds = T.StructType([*chunks.schema.fields, T.StructField("__ends", T.ArrayType(T.IntegerType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in small_batches(batches, 16 << 20):
            yield batch_of(cut_kinds, {c: b.column(k) for k, c in enumerate(chunk_names)} | {"__ends": [c.boundaries(t) for t in texts(b.column(b.num_columns - 1))]})

    def join(group: pa.Table) -> pa.Table:
        c = codec(ranks_path, pattern)
        rows_ = sorted(zip(group["__at"].to_pylist(), group["__text"].to_pylist(), group["__ends"].to_pylist(), strict=True))
        n = group["__n"][0].as_py()
        text = "".join(t[:chunk_chars] for _, t, _ in rows_)
        cuts = stitched([(a, len(t), e) for a, t, e in rows_], n, lambda a, z: c.boundaries(text[a:z]))
        ids = b"".join(c.ids([text[i:j] for i, j in zip(x, x[1:], strict=False)]) for x in cuts)
        made = {"n_tokens": [len(ids) // 4], "ids": [ids], "ids_sha256": [_sha(ids)], "decoded_sha256": [_sha(c.decode(ids))]}
        return pa.Table.from_batches([batch_of(kinds, {k: pa.array(group[k][:1].to_pylist(), group[k].type) for k in names} | made)])

    return short.unionByName(chunks.mapInArrow(cut, cut_kinds).groupBy("__row").applyInArrow(join, kinds))


def decode(encoded: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ``decoded`` (binary): the raw bytes of the ids, one after another."""
    ranks_path, pattern = ranks_path or default_ranks(), pattern or default_pattern()
    names = encoded.columns
    kinds = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            out = [c.decode(i or b"") for i in b.column("ids").to_pylist()]
            yield batch_of(kinds, {c: b.column(c) for c in names} | {"decoded": out})

    return encoded.mapInArrow(rows, kinds)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
