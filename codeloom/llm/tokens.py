"""Encoding of a corpus with a public byte-level BPE, each shared chunk encoded once.

Texts are cut where a rolling hash of the last characters says so, so equal
passages of different texts fall into equal chunks wherever they stand. The keys
of all chunks are counted first; a filter of bounded size of those that occur more
than once goes to all workers. A chunk that is not in it is encoded where its
text lies; of the others the texts meet, are encoded once each, and only these
encodings travel to the texts that hold them. A cut may run through what the
tokenizer's pre-splitter takes as one piece; therefore each join is repaired: the
pieces at a chunk's end that more text could change are split and encoded again
together with what follows, until the new pieces end where a piece of the next chunk ends. From
there on both splittings agree for good, because a piece depends only on the
text from its start, so the result is exactly that of the whole text.

Defined results: null and empty texts give an empty list; strings that look like
special tokens are ordinary text; a document id that occurs in several equal
rows gives one row, and of different texts under one id the greatest wins; a
null id is kept as an id; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import importlib
from collections.abc import Iterator
from itertools import accumulate, chain
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from codeloom.llm.rows import one_text_each, own_id, whole_id
from codeloom.sources.tables import Scratch

#: Characters in the rolling hash, and the mean length of a chunk less the shortest one. Fixed so that equal passages are cut alike everywhere.
WINDOW, MEAN, SHORTEST, LONGEST = 12, 192, 64, 1024
#: Characters from its start that may decide a piece, beyond those it takes: contractions need three.
LOOK = 4
#: Bits of the filter of shared chunks: so many each, between these bounds. A full filter lets all chunks through, which costs time and changes nothing.
FILTER_BITS, FILTER_LEAST, FILTER_MOST = 16, 1 << 16, 1 << 26
#: Characters that are cut at once.
STRETCH = 2_000_000
#: Pieces whose ids a worker remembers; a bound on memory only.
REMEMBERED = 200_000


def default_vocabulary() -> str:
    """Where the public tokenizers of this machine keep byte_bpe_50k."""
    return str(importlib.import_module("public_tokenizers").path("byte_bpe_50k.tiktoken"))


@functools.lru_cache(maxsize=4)
def _codec(vocabulary: str, pattern: str | None):
    """(splitter of a text into pieces, encoder of one piece)."""
    import regex
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).read_bytes().splitlines())}
    pattern = pattern or importlib.import_module("public_tokenizers").PATTERN
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return regex.compile(pattern), _Pieces(encoding.encode_ordinary)


class _Pieces(dict):
    """Ids by piece; what is not remembered is encoded."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> list[int]:
        ids = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def cuts(s: str) -> list[int]:
    """Ends of the chunks of a text: content-defined, at least SHORTEST and at most LONGEST characters apart."""
    return cuts_of([s])[0]


def cuts_of(texts: list[str]) -> list[list[int]]:
    """The cuts of several texts, hashed in one go; texts are set apart by places that hash to nothing."""
    gap = WINDOW - 1
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths + gap)))[:-1]
    codes = np.frombuffer(("\0" * gap).join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes)
    with np.errstate(over="ignore"):
        mixed = (codes + np.uint64(1)) * _MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
        if len(texts) > 1:
            mixed[((starts + lengths)[:-1, None] + np.arange(gap)).ravel()] = 0
        # a sum over the window of each character's hash times a power of its age
        h = np.zeros(n, dtype=np.uint64)
        for k in range(min(WINDOW, n)):
            h[k:] += mixed[: n - k] * np.uint64(pow(0xBF58476D1CE4E5B9, k + 1, 1 << 64))
        h ^= h >> np.uint64(32)
        h *= _MULTIPLIER
    at = np.flatnonzero((h >> np.uint64(40)) % np.uint64(MEAN) == 0) + 1
    bounds = np.searchsorted(at, np.stack([starts, starts + lengths], axis=1), side="right").tolist()
    out = []
    for k, size in enumerate(lengths.tolist()):
        if size <= SHORTEST:
            out.append([size] if size else [])
            continue
        a, b = bounds[k]
        ends, last = [], 0
        for p in (at[a:b] - starts[k]).tolist():
            while p - last > LONGEST:
                last += LONGEST
                ends.append(last)
            if p - last >= SHORTEST:
                ends.append(p)
                last = p
        while size - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if last < size:
            ends.append(size)
        out.append(ends)
    return out


def chunked(texts: list[str]) -> Iterator[list[str]]:
    """The chunks of each text, a stretch of texts at a time."""
    group: list[str] = []
    size = 0
    for k, s in enumerate(texts):
        group.append(s)
        size += len(s)
        if size >= STRETCH or k == len(texts) - 1:
            for t, ends in zip(group, cuts_of(group)):
                yield [t[a:b] for a, b in zip([0, *ends], ends)]
            group, size = [], 0


def chunks(s: str) -> list[str]:
    return next(chunked([s]))


def encode_chunk(text: str, vocabulary: str, pattern: str | None = None) -> tuple[list[int], list[int], list[int]]:
    """(ids, ends of the pieces in characters, ids of each piece) of a chunk on its own."""
    split, known = _codec(vocabulary, pattern)
    pieces = split.findall(text)
    parts = [known[p] for p in pieces]
    return list(chain.from_iterable(parts)), list(accumulate(map(len, pieces))), list(map(len, parts))


def join_chunks(texts: list[str], parts: list[tuple[list[int], list[int], list[int]]], vocabulary: str, pattern: str | None = None) -> list[int]:
    """Ids of the joined text from those of its chunks, repaired at every join."""
    split, known = _codec(vocabulary, pattern)
    out: list[int] = []
    carry = ""  # text of the piece that touches the last join, not yet encoded for good
    tried = 0  # length at which the repair last met no end; a piece over many chunks is tried again at twice that
    last = len(texts) - 1
    for k, (text, (ids, ends, counts)) in enumerate(zip(texts, parts)):
        skip = 0  # pieces of this chunk that the repair has already covered
        if carry:
            whole = carry + text
            if k < last and len(whole) < 2 * tried:
                carry = whole
                continue
            shift = len(carry)
            stops = {e + shift: i for i, e in enumerate(ends)}
            agreed = False
            at = 0
            while at < len(whole):
                m = split.match(whole, at)
                at = m.end()
                if k < last and (at == len(whole) or m.start() + LOOK > len(whole)):
                    # the next join may change it: everything from its start waits
                    at = m.start()
                    break
                out += known[m[0]]
                i = stops.get(at)
                if i is not None and at < len(whole):
                    skip, agreed = i + 1, True
                    break
            if not agreed:
                carry = whole[at:]
                tried = len(carry) if at == 0 else 0
                continue
            carry, tried = "", 0
        # the rest is as in the chunk, but for the pieces that what follows may change
        stop = len(counts)
        while k < last and stop > skip and (ends[stop - 1] == len(text) or (ends[stop - 2] if stop > 1 else 0) + LOOK > len(text)):
            stop -= 1
        a = sum(counts[:skip])
        b = a + sum(counts[skip:stop])
        out += ids[a:b]
        carry = "" if k == last else text[ends[stop - 1] if stop else 0 :]
    if carry:
        for m in split.finditer(carry):
            out += known[m[0]]
    return out


def pack(text: str, ids: list[int], ends: list[int], counts: list[int]) -> bytes:
    """A chunk and its encoding as bytes: a head of four numbers, ids, lengths and id counts of the pieces, the text."""
    wide = bool(ids) and max(ids) > 0xFFFF
    lengths = np.diff(np.array([0, *ends], dtype=np.int64)).astype(np.uint16)
    body = np.array(ids, dtype=np.uint32 if wide else np.uint16)
    head = np.array([wide, len(ids), len(ends), 0], dtype=np.uint32)
    return head.tobytes() + body.tobytes() + lengths.tobytes() + np.array(counts, dtype=np.uint16).tobytes() + text.encode("utf-8", "surrogatepass")


def unpack(b: bytes) -> tuple[str, tuple[list[int], list[int], list[int]]]:
    wide, n, m, _ = np.frombuffer(b, dtype=np.uint32, count=4).tolist()
    at = 16
    ids = np.frombuffer(b, dtype=np.uint32 if wide else np.uint16, count=n, offset=at)
    at += ids.nbytes
    lengths = np.frombuffer(b, dtype=np.uint16, count=m, offset=at)
    at += lengths.nbytes
    counts = np.frombuffer(b, dtype=np.uint16, count=m, offset=at)
    at += counts.nbytes
    return b[at:].decode("utf-8", "surrogatepass"), (ids.tolist(), np.cumsum(lengths, dtype=np.int64).tolist(), counts.tolist())


def chunk_key(chunk: str) -> tuple[int, int]:
    """128 bits of SHA-256 as two numbers: what stands for a chunk in counts and joins."""
    d = hashlib.sha256(chunk.encode("utf-8", "surrogatepass")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:16], "little", signed=True)


def _filter_places(ka, kb, bits: int) -> list:
    """Three places of a key in a filter of `bits` bits, a power of two; for columns and for arrays of numbers."""
    if isinstance(ka, np.ndarray):
        m = np.int64(bits - 1)
        return [ka & m, kb & m, (ka >> np.int64(32)) & m]
    m = F.lit(bits - 1).cast("long")
    return [ka.bitwiseAND(m), kb.bitwiseAND(m), F.shiftright(ka, 32).bitwiseAND(m)]


def _shared_filter(shared: DataFrame) -> tuple[int, bytes]:
    """(bits, filter) of the keys of shared chunks; of bounded size, so it may go to the driver and from there to all workers."""
    n = shared.count()
    bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (n * FILTER_BITS - 1).bit_length() if n else 0))
    places = shared.select(F.explode(F.array(*_filter_places(F.col("ka"), F.col("kb"), bits))).alias("at"))
    # the engine's buckets and positions count from one
    one = F.col("at") + 1
    rows = places.groupBy((F.bitmap_bucket_number(one) - 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("map"))
    out = bytearray(bits // 8)
    size = 4096
    for r in rows.collect():
        at = r["bucket"] * size
        out[at : at + size] = bytes(r["map"])
    return bits, bytes(out)


def _in_filter(keys: list[tuple[int, int]], bits: int, filter_: np.ndarray) -> list[bool]:
    if not keys:
        return []
    k = np.array(keys, dtype=np.int64)
    hit = np.ones(len(k), dtype=bool)
    for at in _filter_places(k[:, 0], k[:, 1], bits):
        hit &= (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return hit.tolist()


def encoded(documents: DataFrame, vocabulary: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of each document.

    `vocabulary` is a path that every executor can read; by default each
    machine's own copy of the public tokenizers.
    """
    path = vocabulary or default_vocabulary()
    spark = documents.sparkSession
    scratch = Scratch(spark, "tokens")
    kind = dict(documents.dtypes)[id_col]

    sent_kind = "bigint" if kind == "int" else kind

    def count_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [chunk_key(c) for part in chunked(b["s"].tolist()) for c in part]
            yield pd.DataFrame(keys, columns=["ka", "kb"], dtype="int64")

    docs = one_text_each(documents, id_col, text_col, scratch, kind)
    if kind in ("bigint", "int"):  # ids pass through Python batches
        docs = docs.withColumn("i", whole_id("i"))
    some = docs.where("s is not null and s <> ''")
    counts = some.select("s").mapInPandas(count_keys, "ka long, kb long").groupBy("ka", "kb").agg(F.count("*").alias("n"))
    bits, filter_ = _shared_filter(scratch.cut(counts.where("n > 1").select("ka", "kb")))
    sent = spark.sparkContext.broadcast(filter_)

    def in_place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.frombuffer(sent.value, dtype=np.uint8)
        for b in batches:
            texts = b["s"].tolist()
            every = list(chunked(texts))
            keys = [chunk_key(c) for part in every for c in part]
            hits = _in_filter(keys, bits, known)
            rows, at = [], 0
            for part in every:
                hit, key = hits[at : at + len(part)], keys[at : at + len(part)]
                at += len(part)
                if not any(hit):
                    rows.append((join_chunks(part, [encode_chunk(c, path, pattern) for c in part], path, pattern), None, None))
                    continue
                own = [{"place": k, "packed": pack(c, *encode_chunk(c, path, pattern))} for k, c in enumerate(part) if not hit[k]]
                holes = [{"place": k, "ka": key[k][0], "kb": key[k][1], "chunk": c} for k, c in enumerate(part) if hit[k]]
                rows.append((None, own, holes))
            out = pd.DataFrame(rows, columns=["ids", "own", "holes"])
            out.insert(0, "i", b["i"])
            yield out

    @F.pandas_udf(T.BinaryType())
    def encode(chunk: pd.Series) -> pd.Series:
        return chunk.map(lambda c: pack(c, *encode_chunk(c, path, pattern)))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def joined(parts: pd.Series) -> pd.Series:
        out = []
        for p in parts:
            both = [unpack(x["packed"]) for x in p]
            out.append(join_chunks([t for t, _ in both], [e for _, e in both], path, pattern))
        return pd.Series(out, dtype="object")

    first = scratch.cut(some.mapInPandas(in_place, f"i {sent_kind}, ids array<int>, own array<struct<place: int, packed: binary>>, holes array<struct<place: int, ka: bigint, kb: bigint, chunk: string>>"))
    whole = first.where("ids is not null").select("i", "ids")
    open_ = first.where("ids is null")
    holes = open_.select("i", F.explode("holes").alias("h"))
    # each shared chunk is encoded once; written, so that the planner knows the size and can split a hot key of the other side
    texts = holes.groupBy(F.col("h.ka").alias("m_ka"), F.col("h.kb").alias("m_kb")).agg(F.min("h.chunk").alias("chunk"))
    made = scratch.cut(texts.select("m_ka", "m_kb", encode("chunk").alias("packed")))
    asked = holes.select("i", F.col("h.place").alias("place"), F.col("h.ka").alias("ka"), F.col("h.kb").alias("kb"))
    filled = asked.join(made, (asked["ka"] == made["m_ka"]) & (asked["kb"] == made["m_kb"])).select("i", F.struct("place", "packed").alias("part"))
    parts = open_.select("i", F.explode("own").alias("part")).unionByName(filled)
    mended = parts.groupBy("i").agg(F.array_sort(F.collect_list("part")).alias("parts")).select("i", joined("parts").alias("ids"))
    none = docs.where("s is null or s = ''").select("i", F.array().cast("array<int>").alias("ids"))
    return whole.unionByName(mended).unionByName(none).select((own_id("i").cast(kind) if kind in ("bigint", "int") else F.col("i")).alias(id_col), "ids")
