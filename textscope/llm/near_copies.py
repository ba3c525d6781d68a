"""Near copies at a real word-shingle similarity, found by SimHash tries.

Copies that hardly differ share a fingerprint of four bits' distance, but texts
at a Jaccard similarity of 0.8 differ in some 15 % of the bits, so no small
Hamming budget finds them and a wide one meets chance pairs. Here a text's
fingerprint has 128 bits; a forest of tries, each over the texts that agree on
a few 4-bit blocks, is walked in pairs with a budget of ``WORD_BITS`` in the
first word and ``MAX_BITS`` in both, and each pair that is to link two texts is
confirmed by the Jaccard similarity of the two texts' shingles.

A text at the similarity asked for meets its copy in a trie with probability
(1 - 0.15) ** lead, so the number of tries is set from the lead, and the lead
grows with the logarithm of the number of texts: the work grows like their
number to the power of 1.25, not 2. A trie gives a spanning forest of its
pairs, closest first, never all pairs of a group. The first few tries are
confirmed and their links settled before the others run, so that a large group
of near copies is one class by then and costs no further pairs.
"""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, materialize, small_batches
from .components import components
from .simhash import Groups, _slabs, trie_pairs

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Differing bits of pairs that are confirmed: of the first word, and of both.
WORD_BITS, MAX_BITS = 18, 31
#: Share of the bits in which texts of the similarity asked for differ, and the
#: number of tries in which such a pair is expected to meet.
DIFFERING, MEETINGS = 0.15, 4.5
#: Texts of one trie cell that are aimed at, as a power of two.
CELL_BITS = 8
#: Tries whose links are settled before the others run.
FIRST = 2
#: Ids, of eight bytes each, that are broadcast at most.
BROADCAST_IDS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_text(name: str) -> Column:
    """Lower-case A-Z, words joined by one space: what decides whether two texts
    are exact copies."""
    return F.trim(F.regexp_replace(F.translate(as_text(name), _UPPER, _LOWER), r"[\x20\x09-\x0D]+", " "))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A second hash word from the first."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _parts(normal: bytes, words: int) -> list[bytes]:
    """The shingles of a normal text, in order; a shorter one is a single shingle."""
    split = normal.split(b" ")
    if len(split) <= words:
        return [normal]
    stop = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    start = np.concatenate([[0], stop[:-1] + 1])
    return [normal[a:b] for a, b in zip(start[: len(split) - words + 1].tolist(), stop[words - 1 :].tolist())]


def two_words(normal: bytes, words: int = SHINGLE_WORDS) -> tuple[int, int]:
    """128 majority bits of a normal text's shingles, as two signed longs; of a
    wordless one, zeros."""
    if not normal:
        return 0, 0
    shingles = _parts(normal, words)
    counts = np.zeros((2, 64), np.int64)
    for a in range(0, len(shingles), 1 << 16):
        h = np.array([xxhash.xxh64_intdigest(x, 42) for x in shingles[a : a + (1 << 16)]], np.uint64)
        for k, word in enumerate((h, _mixed(h))):
            counts[k] += np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return tuple(np.packbits(counts * 2 > len(shingles), axis=1, bitorder="little").view(np.int64).ravel().tolist())


def similarity(a: bytes, b: bytes, words: int = SHINGLE_WORDS) -> float:
    """Jaccard similarity of two normal texts' sets of shingles."""
    x, y = set(_parts(a, words)), set(_parts(b, words))
    return len(x & y) / len(x | y)


def _fingerprints(texts: DataFrame, words: int) -> DataFrame:
    """(id, normal) -> (id, w1, w2)."""

    def run(batches):
        for batch in batches:
            found = np.array([two_words(t, words) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["id", "w1", "w2"])

    return texts.select("id", F.col("normal").cast("binary")).mapInArrow(run, "id long, w1 long, w2 long")


def tries(n: int) -> list[tuple[int, ...]]:
    """The 4-bit blocks (0..31) on which the texts of each trie's cells agree."""
    lead = max(3, math.ceil((math.log2(max(n, 2)) - CELL_BITS) / 4))
    count = math.ceil(MEETINGS / (1 - DIFFERING) ** (4 * lead))
    r, seen = random.Random(17), set()
    while len(seen) < count:
        seen.add(tuple(sorted(r.sample(range(32), lead))))
    return sorted(seen, key=lambda x: hashlib.sha256(repr(x).encode()).digest())


def _cells(prints: DataFrame, blocks: list[tuple[int, ...]], first: int) -> DataFrame:
    """(id, w1, w2, label) -> (trie, lead, w1, w2, id, label), one row a trie."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            data = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            nibble = [(data[1 + b // 16] >> np.int64(4 * (b % 16))) & np.int64(15) for b in range(32)]
            for k, some in enumerate(blocks):
                lead = np.zeros(n, np.int64)
                for b in some:
                    lead = (lead << np.int64(4)) | nibble[b]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(n, first + k), lead, data[1], data[2], data[0], data[3])], names=["trie", "lead", "w1", "w2", "id", "label"])

    return prints.select("id", "w1", "w2", "label").mapInArrow(run, "trie long, lead long, w1 long, w2 long, id long, label long")


def _forest(batches):
    """Cells sorted by (trie, lead) -> candidate links (u, v): a spanning forest of
    each cell's near pairs, by rising budget, over the classes that labels name."""
    for data, starts, stops in _slabs(batches, 6, 2):
        cell = np.repeat(np.arange(len(starts)), stops - starts)
        one = data[2].view(np.uint64)
        order = np.lexsort((one, cell))
        one, two, ids, labels = one[order], data[3].view(np.uint64)[order], data[4][order], data[5][order]
        # texts of one class in one cell start as one group
        by = np.lexsort((np.arange(len(ids)), labels, cell))
        new = np.concatenate([[True], (labels[by][1:] != labels[by][:-1]) | (cell[by][1:] != cell[by][:-1])])
        root = np.empty(len(ids), np.int64)
        root[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
        groups = Groups(len(ids), root)
        found = []

        def link(i, j, budget):
            bits = np.bitwise_count(one[i] ^ one[j]).astype(np.int64) + np.bitwise_count(two[i] ^ two[j])
            fine = np.flatnonzero(bits <= budget)
            fine = fine[np.argsort(bits[fine], kind="stable")]
            used = fine[groups.join(i[fine], j[fine])]
            found.append((i[used], j[used]))

        at = np.flatnonzero(cell[1:] == cell[:-1])
        for share in (4, 2, 1):
            link(at, at + 1, MAX_BITS // share)
            for i, j in trie_pairs(one, starts, stops, 64, WORD_BITS // share, groups):
                link(i, j, MAX_BITS // share)
        i, j = (np.concatenate(x) for x in zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["u", "v"])


def _confirmed(pairs: DataFrame, texts: DataFrame, least: float, words: int) -> DataFrame:
    """The pairs (u, v) whose texts are similar enough. Only texts of a pair move:
    their ids are broadcast where they are few, else joined."""
    ids = materialize(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "paired")
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = materialize(texts.join(some, "id", "left_semi"), "paired-texts")
    left, right = texts.select(F.col("id").alias("u"), F.col("normal").cast("binary").alias("a")), texts.select(F.col("id").alias("v"), F.col("normal").cast("binary").alias("b"))

    def run(batches):
        for batch in batches:
            fine = [similarity(a, b, words) >= least for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(fine, pa.bool_())) for k in (0, 1)], names=["u", "v"])

    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _named(normal: Column, seed: int) -> Column:
    return F.xxhash64(normal, F.lit(seed))


def classes(docs: DataFrame, text: str = "text", words: int = SHINGLE_WORDS, least: float = SIMILARITY) -> tuple[DataFrame, int]:
    """((id, class) of each distinct normal text, the seed that ids were hashed with).

    id is a hash of the normal text, checked to be free of collisions, class the
    smallest id that confirmed links reach."""
    spark = docs.sparkSession
    small_batches(spark)
    normal = materialize(docs.select(normal_text(text).alias("normal")).groupBy(F.md5("normal").alias("key")).agg(F.min("normal").alias("normal")), "normal-texts")
    for seed in range(42, 62):
        n, ids = normal.agg(F.count(F.lit(1)), F.count_distinct(_named(F.col("normal"), seed))).first()
        if n == ids:
            break
    else:
        raise RuntimeError("no hash told the texts apart")
    texts = normal.select(_named(F.col("normal"), seed).alias("id"), "normal")
    prints = materialize(_fingerprints(texts, words), "wide-fingerprints")
    blocks = tries(n)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    known = prints.select("id", F.col("id").alias("label"))
    for first, some in ((0, blocks[:FIRST]), (FIRST, blocks[FIRST:])):
        cells = _cells(prints.join(known, "id"), some, first)
        dealt = cells.repartition(parts, "trie", "lead").sortWithinPartitions("trie", "lead")
        pairs = materialize(dealt.mapInArrow(_forest, "u long, v long").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "candidates")
        fine = materialize(_confirmed(pairs, texts, least, words), "confirmed")
        if not fine.limit(1).count():
            continue
        # the classes so far stand for the links that made them
        found = components(fine.unionByName(known.where("id <> label").select(F.col("id").alias("u"), F.col("label").alias("v"))))
        known = materialize(prints.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("label")), "classes")
    return known.select("id", F.col("label").alias("class")), seed


def keep_one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, least: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class of near copies: the one with the smallest
    doc_id, null last; of rows with that id, the one whose columns hash lowest, so
    that only rows equal in everything are interchangeable.

    Texts are exact copies if their words are, A-Z in either case; null, empty and
    wordless texts are copies of each other. Near copies have a Jaccard similarity
    of at least ``least`` over their sets of ``words``-word shingles; a shorter
    text is one shingle. Rows are compared, not ids: rows of different texts that
    repeat an id all stay. Empty docs: empty."""
    found, seed = classes(docs, text, words, least)
    mark = {"__id": _named(normal_text(text), seed), "__none": F.col(doc_id).isNull(), "__doc": F.col(doc_id), "__hash": F.xxhash64(*docs.columns)}
    marked = docs.select(F.struct(*docs.columns).alias("__row"), *[c.alias(n) for n, c in mark.items()])
    best = F.min(F.struct("__none", "__doc", "__hash", "__id"))
    own = marked.groupBy("__id").agg(best.alias("b"))
    kept = own.join(found, F.col("__id") == F.col("id")).groupBy("class").agg(F.min("b").alias("b")).select("b.*")
    same = [marked[c].eqNullSafe(kept[c]) for c in mark]
    return marked.join(kept, same, "left_semi").dropDuplicates(list(mark)).select("__row.*")
