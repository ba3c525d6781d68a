"""SimHash near-duplicate classes by a binary trie self-join.

A text's fingerprint is the bitwise majority of its shingles' XXH64 values.
Fingerprints at most ``max_bits`` apart are linked, classes are the connected
components. Copies share a fingerprint, so the join runs over distinct
fingerprints only.

The trie is cut into independent subtrees. The 64 bits are split into
``BLOCKS`` blocks; two fingerprints within ``max_bits`` agree on at least
``BLOCKS - max_bits`` of them. For every choice of that many blocks the bits
come first: there the error budget is zero, hence only leaves that agree on
them can match, and those leaves are the unit of work dealt out to the cluster.
In it, node pairs of the trie are walked together bit by bit, the differing
bits are accumulated, and a pair whose count exceeds the budget is dropped with
all its leaves. So is a pair whose leaves are all linked already, which keeps a
dense group of near copies from costing its square. A unit that holds more than
``HOT_ROWS`` fingerprints is cut again the same way on its remaining bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, hub_join, materialize, small_batches, table
from .components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
BLOCKS = 6
#: Fingerprints below one trie node before it is cut again.
HOT_ROWS = 1 << 20
#: Node pairs with at most this many leaf pairs are compared leaf by leaf.
LEAF_PAIRS = 64
#: Node pairs, or leaf pairs, held at a time.
FRONTIER = 1 << 18


def fingerprints_of(texts: list[bytes], words: int = SHINGLE_WORDS) -> np.ndarray:
    """uint64 fingerprint of each UTF-8 text; no word: zero; fewer words than a
    shingle: the whole sequence is the one shingle."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    held: list[int] = []
    ends: list[int] = []
    owners: list[int] = []
    counts = np.zeros(64, np.int64)

    def flush() -> None:
        if not owners:
            return
        bits = np.unpackbits(np.array(held, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.array([0, *ends[:-1]]), axis=0, dtype=np.int32)
        sizes = np.diff(np.array([0, *ends]))
        out[owners] = np.packbits(sums * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
        held.clear(), ends.clear(), owners.clear()

    for k, text in enumerate(texts):
        parts = text.lower().split()
        if not parts:
            continue
        joined = b" ".join(parts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        stop = np.cumsum(lengths + 1) - 1
        start = stop - lengths
        if len(parts) > words:
            start, stop = start[: len(parts) - words + 1], stop[words - 1 :]
        else:
            start, stop = start[:1], stop[-1:]
        spans = zip(start.tolist(), stop.tolist())
        if len(start) > 1 << 17:  # a very long text: count its bits piece by piece
            counts[:] = 0
            hashes = [digest(joined[a:b], 42) for a, b in spans]
            for i in range(0, len(hashes), 1 << 16):
                part = np.array(hashes[i : i + (1 << 16)], np.uint64).view(np.uint8).reshape(-1, 8)
                counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[k] = np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
            continue
        held.extend([digest(joined[a:b], 42) for a, b in spans])
        ends.append(len(held))
        owners.append(k)
        if len(held) > 1 << 16:
            flush()
    flush()
    return out


def with_fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, text: str = "text", name: str = "fp") -> DataFrame:
    """docs and a long column ``name`` (replacing one of that name)."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != name]
    schema = docs.select(*kept).schema.add(name, "long")
    raw = "__raw_text"

    def run(batches):
        for batch in batches:
            fps = fingerprints_of(batch.column(batch.num_columns - 1).to_pylist(), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], names=[*kept, name])

    return docs.select(*kept, as_bytes(text).alias(raw)).mapInArrow(run, schema)


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    cuts = [round(k * width / parts) for k in range(parts + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def _orders(max_bits: int) -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """(leading blocks, other blocks) as bit ranges, one entry per choice."""
    blocks = _blocks(64, max(BLOCKS, max_bits + 1))
    lead = len(blocks) - max_bits
    return [([blocks[i] for i in some], [b for i, b in enumerate(blocks) if i not in some]) for some in combinations(range(len(blocks)), lead)]


def _gather(fp: Column, ranges: list[tuple[int, int]]) -> Column:
    """The bits of the ranges, packed into one long."""
    out, shift = F.lit(0).cast("long"), 0
    for lo, hi in ranges:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")), shift))
        shift += hi - lo
    return out


class Groups:
    """Positions 0..n-1 and the groups they are linked to; a group is named by its
    smallest position. ``root`` may start with groups known already."""

    def __init__(self, n: int, root: np.ndarray | None = None):
        self.root = np.arange(n) if root is None else root
        self._seam: np.ndarray | None = None

    def join(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Link the pairs; returns which of them, earlier ones first, linked two
        groups: a forest, thus fewer than there are positions."""
        used = []
        at = np.arange(len(i))
        while True:
            a, b = self.root[i[at]], self.root[j[at]]
            apart = a != b
            if not apart.any():
                return np.concatenate(used) if used else np.zeros(0, np.int64)
            at, a, b = at[apart], a[apart], b[apart]
            high, first = np.unique(np.maximum(a, b), return_index=True)
            self.root[high] = np.minimum(a, b)[first]
            used.append(at[first])
            self._seam = None
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def linked(self, lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
        """Whether all positions of two ranges are of one group."""
        if self._seam is None:
            self._seam = np.concatenate([[0], np.cumsum(self.root[1:] != self.root[:-1])])
        seam, root = self._seam, self.root
        return (seam[hi_a - 1] == seam[lo_a]) & (seam[hi_b - 1] == seam[lo_b]) & (root[lo_a] == root[lo_b])


def _pairs_in(lo_a, hi_a, lo_b, hi_b, same):
    """All leaf index pairs of the node pairs; within one node, each pair once."""
    na, nb = hi_a - lo_a, hi_b - lo_b
    sizes = na * nb
    which = np.repeat(np.arange(len(sizes)), sizes)
    k = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    i, j = lo_a[which] + k // nb[which], lo_b[which] + k % nb[which]
    fine = ~same[which] | (i < j)
    return i[fine], j[fine]


def trie_pairs(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, depth: int, max_bits: int, groups: Groups | None = None):
    """Yield arrays (i, j), i < j, of positions whose values differ in at most
    max_bits bits, within each range [start, stop) of ``values`` (uint64,
    ascending in each range, using the low ``depth`` bits). With ``groups``, which
    the caller extends as pairs come, pairs of one group may be left out."""
    keep = stops - starts > 1
    first = (starts[keep], stops[keep], starts[keep], stops[keep], np.zeros(keep.sum(), np.int64), np.ones(keep.sum(), bool))
    zeros: dict[int, np.ndarray] = {}
    stack = [(depth, first)]
    while stack:
        level, nodes = stack.pop()
        if len(nodes[0]) > FRONTIER:
            half = len(nodes[0]) // 2
            stack += [(level, tuple(x[half:] for x in nodes)), (level, tuple(x[:half] for x in nodes))]
            continue
        if groups is not None and len(nodes[0]):
            open_ = ~groups.linked(*nodes[:4])
            nodes = tuple(x[open_] for x in nodes)
        lo_a, hi_a, lo_b, hi_b, bits, same = nodes
        work = (hi_a - lo_a) * (hi_b - lo_b)
        # equal values never part: their node is compared leaf by leaf, however wide
        ready = (work <= LEAF_PAIRS) | (level == 0)
        if ready.any():
            todo = [x[ready] for x in (lo_a, hi_a, lo_b, hi_b, same)]
            cut = np.searchsorted(np.cumsum(work[ready]), np.arange(FRONTIER, work[ready].sum() + FRONTIER, FRONTIER))
            last = 0
            for end in [*np.unique(cut + 1), len(todo[0])]:
                part = [x[last:end] for x in todo]
                last = min(end, len(todo[0]))
                if len(part[0]):
                    i, j = _pairs_in(*part)
                    near = np.bitwise_count(values[i] ^ values[j]) <= max_bits
                    if near.any():
                        yield i[near], j[near]
        if ready.all():
            continue
        lo_a, hi_a, lo_b, hi_b, bits, same = (x[~ready] for x in nodes)
        level -= 1
        if level not in zeros:
            zeros[level] = np.concatenate([[0], np.cumsum((values >> np.uint64(level)) & np.uint64(1) == 0)])
        z = zeros[level]
        mid_a, mid_b = lo_a + z[hi_a] - z[lo_a], lo_b + z[hi_b] - z[lo_b]
        child = [
            (lo_a, mid_a, lo_b, mid_b, bits, same),
            (mid_a, hi_a, mid_b, hi_b, bits, same),
            (lo_a, mid_a, mid_b, hi_b, bits + 1, np.zeros_like(same)),
            tuple(x[~same] for x in (mid_a, hi_a, lo_b, mid_b, bits + 1, same)),
        ]
        merged = tuple(np.concatenate([c[k] for c in child]) for k in range(6))
        alive = (merged[0] < merged[1]) & (merged[2] < merged[3]) & (merged[4] <= max_bits) & (~merged[5] | (merged[1] - merged[0] > 1))
        if alive.any():
            stack.append((level, tuple(x[alive] for x in merged)))


def _stars(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, depth: int, max_bits: int) -> np.ndarray:
    """The smallest position reachable by links from each position."""
    groups = Groups(len(values))
    at = np.arange(len(values) - 1)
    # neighbours first: they link most of a dense group, and its node pairs fall away
    near = np.bitwise_count(values[1:] ^ values[:-1]) <= max_bits
    near[stops[:-1] - 1] = False
    groups.join(at[near], at[near] + 1)
    for i, j in trie_pairs(values, starts, stops, depth, max_bits, groups):
        groups.join(i, j)
    return groups.root


def _slabs(batches, width: int, keys: int, room: int = 1 << 17):
    """Batches of long columns, sorted by the first ``keys`` of them -> (data, starts,
    stops): matrices of about ``room`` rows that end where a key does."""
    held: list[np.ndarray] = []
    rows = 0

    def ready(data: np.ndarray):
        edge = np.flatnonzero((data[:keys, 1:] != data[:keys, :-1]).any(axis=0)) + 1
        return data, np.concatenate([[0], edge]), np.concatenate([edge, [data.shape[1]]])

    for batch in batches:
        now = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)]).astype(np.int64)
        if not now.shape[1]:
            continue
        held.append(now)
        rows += now.shape[1]
        if rows >= room:
            data = np.concatenate(held, axis=1)
            cut = int(np.flatnonzero((data[:keys] == data[:keys, -1:]).all(axis=0))[0])
            held, rows = [data[:, cut:]], data.shape[1] - cut
            if cut:
                yield ready(data[:, :cut])
    if rows:
        yield ready(np.concatenate(held, axis=1))


def _link_slabs(batches, max_bits: int):
    """Batches (unit, lead, part, fp) sorted by all four -> links (u, v)."""
    for data, starts, stops in _slabs(batches, 4, 3):
        values = data[3].view(np.uint64)
        # long order puts the upper half first: ascending within a unit needs a sort by value
        order = np.lexsort((values, np.repeat(np.arange(len(starts)), stops - starts)))
        values = values[order]
        root = _stars(values, starts, stops, 64, max_bits)
        moved = np.flatnonzero(root != np.arange(len(root)))
        fp = values.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], names=["u", "v"])


def _recut(hot: DataFrame, orders, max_bits: int) -> DataFrame:
    """Deal a hot unit's fingerprints out again: of max_bits + 1 parts of the bits
    that don't lead, two linked fingerprints share at least one."""
    made = []
    for _, rest in orders:
        bits = [b for lo, hi in rest for b in range(lo, hi)]
        parts = [[(b, b + 1) for b in bits[lo:hi]] for lo, hi in _blocks(len(bits), max_bits + 1)]
        made.append(F.array(*[F.struct(F.lit(k + 1).alias("k"), _gather(F.col("fp"), p).alias("bits")) for k, p in enumerate(parts)]))
    cells = F.element_at(F.array(*made), F.col("unit") + 1) if len(made) > 1 else made[0]
    flat = hot.select("unit", "lead", "fp", F.explode(cells).alias("cell"))
    return flat.select((F.col("unit") + F.lit(len(orders)) * F.col("cell.k")).alias("unit"), "lead", F.col("cell.bits").alias("part"), "fp")


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """fps: (fp long, distinct). Links (u, v) that connect exactly the
    fingerprints connected by chains of pairs at most max_bits apart; a spanning
    star per unit rather than every pair. Empty: empty."""
    orders = _orders(max_bits)
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("unit"), _gather(F.col("fp"), lead).alias("lead")) for k, (lead, _) in enumerate(orders)]))
    keyed = fps.select("fp", cells.alias("cell")).select("cell.unit", "cell.lead", F.lit(0).cast("long").alias("part"), "fp")
    hot = keyed.groupBy("unit", "lead").count().where(F.col("count") > hot_rows).select("unit", "lead")
    if max_bits and hot.limit(1).count():
        hot = materialize(hot, "hot-units")
        again = _recut(keyed.join(hot, ["unit", "lead"], "left_semi"), orders, max_bits)
        keyed = keyed.join(hot, ["unit", "lead"], "left_anti").select("unit", "lead", "part", "fp").unionByName(again)
    spark = fps.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = keyed.repartition(count, "unit", "lead", "part").sortWithinPartitions("unit", "lead", "part")
    return dealt.mapInArrow(lambda batches: _link_slabs(batches, max_bits), "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: doc_id, fp long, component_id (smallest doc_id
    reachable over links, its own included).

    Null or wordless text: fingerprint zero, linked like any other. Repeated rows
    are returned as often as given. A null doc_id is returned but never names a
    component while another id is there. Other columns are ignored. Empty: empty."""
    marked = materialize(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words).select("doc_id", "fp"), "fingerprints")
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    found = components(fingerprint_links(fps.select("fp"), max_bits))
    rooted = materialize(fps.join(found, fps.fp == found.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    rows, distinct = rooted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    named = materialize(hub_join(rooted.select("fp", "root", "n"), lows, "root", "fps", distinct), "named")
    return hub_join(marked, named.select("fp", "component_id", "n"), "fp", "n", rows).select("doc_id", "fp", "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
