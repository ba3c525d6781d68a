"""Best-fit packing of token pieces into fixed-length sequences.

Texts are turned into ids and cut into pieces where the data is read. Pieces
that fill a sequence need no partner. The others are dealt into groups of
about ``GROUP`` pieces; each group is packed by itself, so a group costs at
most one underfull sequence. Inside a group, best fit by falling length gives
a start, then a local search works on the underfull sequences: it moves a
piece, exchanges one for one or two for one, always so that the sum of squared
fills rises, until the emptiest sequence is empty, and goes on with the next
until the lower bound is met or no exchange helps.
"""

from __future__ import annotations

import json
import math
import re
import struct
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, small_batches, table

CAPACITY = 1024
END_ID = 2
#: Pieces that one task packs together.
GROUP = 20_000
#: Exchanges tried for one sequence before it is left as it is.
TRIES = 200
#: Sequences between which exchanges are tried when the emptiest one has none.
NEARBY = 40
#: Whitespace signs in a row that the faster encoder isn't given: some 100,000 it
#: takes, a million overflow its stack.
LONG_SPACE = 20_000
_LONG_SPACE = re.compile(rf"(?<!\s)\s{{{LONG_SPACE}}}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable letter: printable
    Latin-1 as itself, the rest from code point 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Ids:
    """Texts to little-endian 32-bit ids, as the ``tokenizers`` library gives them
    for the vocabulary file, no special ids added. An added token in a text is its
    own id, as by the library's default; with ``ordinary`` it is ordinary text. The
    merges of a byte-level vocabulary are its ids in order, so a faster encoder can
    run on the same file; the tests hold one against the other. It knows no added
    tokens and can't take whitespace without an end, so texts with either go to the
    library itself."""

    def __init__(self, vocabulary: str, ordinary: bool = True):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)
        letters = _byte_of_letter()
        added = [x["content"] for x in model.get("added_tokens", [])]
        self._added = [] if ordinary else added
        ranks = {bytes(letters[c] for c in word): k for word, k in model["model"]["vocab"].items() if word not in added}
        self._fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._library = Tokenizer.from_file(vocabulary)
        self._library.encode_special_tokens = ordinary

    def _encode(self, text: str) -> list[int]:
        if any(x in text for x in self._added) or (len(text) >= LONG_SPACE and _LONG_SPACE.search(text)):
            return self._library.encode(text, add_special_tokens=False).ids
        return self._fast(text)

    def __call__(self, text: str) -> bytes:
        ids = array("I", self._encode(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


@lru_cache(maxsize=2)
def ids_for(vocabulary: str, ordinary: bool = True) -> Ids:
    return Ids(vocabulary, ordinary)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: a short one first, then full ones."""
    short = n % capacity
    starts = [*([0] if short else []), *range(short, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", ordinary: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each row's ids and a closing
    END_ID. Null or empty text: one piece with the closing id alone."""
    small_batches(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    end = struct.pack("<I", END_ID)

    def run(batches):
        ids = ids_for(vocabulary, ordinary)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for k, raw in enumerate(batch.column(1).to_pylist()):
                held = ids(raw.decode("utf-8", "replace")) + end
                view = memoryview(held)
                rows += [(k, p, a, n, zlib.crc32(view[4 * a : 4 * (a + n)])) for p, (a, n) in enumerate(cut(len(held) // 4, capacity))]
            of, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows)) if rows else ([np.zeros(0, np.int64)] * 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kept = docs.select(F.col(doc_id).alias("doc_id"), as_bytes(text).alias("raw"))
    schema = kept.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return kept.mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of positions: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fit = mask >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            open_at[room - n].append(b)
            mask |= 1 << (room - n)
    return bins


def _exchange(low: list[int], high: list[int], room: int, lengths: list[int]) -> bool:
    """Change low and high (room: free in high) so that high gets fuller."""
    for x in sorted(low, key=lambda i: -lengths[i]):
        if lengths[x] <= room:
            low.remove(x), high.append(x)
            return True
    best = None
    for a in {lengths[i]: i for i in high}.values():
        for x in {lengths[i]: i for i in low}.values():
            gain = lengths[x] - lengths[a]
            if 0 < gain <= room and (best is None or gain > best[0]):
                best = (gain, a, (x,))
        sizes = {lengths[i]: i for i in low}
        for x in sizes.values():
            for y in low:
                gain = lengths[x] + lengths[y] - lengths[a]
                if x != y and 0 < gain <= room and (best is None or gain > best[0]):
                    best = (gain, a, (x, y))
    if best is None:
        return False
    _, a, some = best
    high.remove(a), low.append(a)
    for x in some:
        low.remove(x), high.append(x)
    return True


def improve(bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY, tries: int = TRIES) -> list[list[int]]:
    """Local search between underfull bins; each exchange takes from a bin at most
    as full as the other, so the sum of squared fills rises. Never more bins."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = math.ceil(sum(fill) / capacity)

    def exchange(low: int, high: int) -> bool:
        if fill[high] >= capacity or not fill[high] or fill[high] < fill[low] or not _exchange(bins[low], bins[high], capacity - fill[high], lengths):
            return False
        total = fill[low] + fill[high]
        fill[high] = sum(lengths[i] for i in bins[high])
        fill[low] = total - fill[high]
        return True

    while True:
        rank = sorted((k for k in range(len(bins)) if 0 < fill[k] < capacity), key=lambda k: (fill[k], k))
        if sum(1 for f in fill if f) <= least or len(rank) < 2:
            break
        v, left, moved = rank[0], tries, True
        while fill[v] and left > 0 and moved:
            left -= 1
            # out of the emptiest, into the fullest that takes it
            moved = any(exchange(v, h) for h in reversed(rank[1:]))
            if not moved:  # else between others, which changes what has room
                some = sorted(rank[1:], key=lambda k: (fill[k], k))[:NEARBY]
                moved = any(exchange(a, b) for k, a in enumerate(some) for b in reversed(some[k + 1 :]))
        if fill[v]:
            break
    return [b for b in bins if b]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return improve(best_fit(lengths, capacity), lengths, capacity)


def packed(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, group: int = GROUP, ordinary: bool = True) -> DataFrame:
    """pieces(docs) with sequence_id and offset.

    Every row of docs is packed, repeated rows as often as given; null or empty
    texts count as the closing id alone; other columns are ignored. Piece by
    piece: sequences are gapless from offset 0 and hold at most ``capacity`` ids.
    An empty table gives an empty result."""
    made = materialize(pieces(docs, vocabulary, capacity, ordinary=ordinary), "pieces")
    marked = made.withColumn("row", F.monotonically_increasing_id())
    full = marked.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    groups = max(1, math.ceil(made.where(F.col("length") < capacity).count() / group))
    some = marked.where(F.col("length") < capacity).withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups))).drop("row")

    def run(part: pa.Table) -> pa.Table:
        sequence, offset = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        lengths = part.column("length").to_pylist()
        base = part.column("grp")[0].as_py() << 32
        for b, members in enumerate(pack(lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = base + b, at
                at += lengths[i]
        return part.drop_columns(["grp"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return some.groupBy("grp").applyInArrow(run, full.schema).unionByName(full)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), ordinary=False)
