"""SimHash near-duplicates: 64-bit fingerprints linked at a Hamming distance, searched by a Gray-order hierarchical index.

Fingerprints (distinct ones only) are dealt by every choice of ``agree`` of ``blocks`` bit blocks: two fingerprints that
differ in at most ``blocks - agree`` bits have ``agree`` blocks in common, so each pair meets in some bucket.  Inside a
bucket the fingerprints are sorted by Gray rank and cut into groups, groups into larger groups; each node keeps the bits
all its members share.  Two nodes descend together, adding the differing shared bits that are new at each level, and are
dropped with all members once the sum passes the distance; so are nodes that are one component already.  All buckets of a
batch, small or large, are segments of one such index.  A bucket gives a star per component, never all pairs.  A bucket of more than ``most`` fingerprints is cut into chunks, and each pair of
chunks is a task of its own, so no bucket is capped and none lands in one task.

Rows: a null or blank text has fingerprint zero and is linked like any other; repeated rows share a fingerprint; a null
doc_id keeps its row and never becomes a component's id unless it is alone (component_id null); an empty table gives no
row.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, map_arrow, map_rows, materialize
from .components import connected_components
from .shingle_join import similar_groups

DISTANCE, SHINGLE = 4, 4  # of the fingerprint query
COPY_WORDS, COPY_SIMILAR = 5, 0.8  # of keep_one
FAN = 16


def shingle_hashes(text: str | None, words: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle, in order; a text of fewer words is one shingle, a blank one none."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only \\x20 and \\x09-\\x0D
    if not w:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    line = b" ".join(w)
    if len(w) <= words:
        return np.array([digest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(w) - words + 1
    a, b = starts[:n].tolist(), ends[words - 1 :].tolist()
    return np.fromiter((digest(line[x:y], seed) for x, y in zip(a, b, strict=True)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > len(h)).tolist())


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = 42) -> int:
    """A bit is set if it is set in over half the XXH64 of the text's word shingles (repeats count)."""
    return majority(shingle_hashes(text, words, seed))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer."""

    def make():
        return lambda c: {"doc_id": c["doc_id"], "fp": [signed(fingerprint(t, words)) for t in c["text"]]}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, fp long")


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Position of a code in the reflected Gray sequence."""
    out = v.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def roots(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Least index of each component of the graph i - j, on top of ``label``."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


class GrayIndex:
    """Levels of groups over fingerprints in Gray order, segment by segment: what all members of a group share.

    ``v`` is sorted by segment, then by Gray rank; ``begin`` holds where each segment starts.  A level has the first child
    and the number of children of each of its nodes, the mask of the bits that all fingerprints below share, and those
    bits; at level 0 the children are fingerprints.  No node crosses a segment, and the last level has a node per segment.
    """

    def __init__(self, v: np.ndarray, begin: np.ndarray, fan: int = FAN):
        self.v = v
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.place: list[np.ndarray] = []  # the first fingerprint below each node
        mask, bits, sizes = np.full(len(v), ~np.uint64(0)), v, np.diff(np.append(begin, len(v)))
        place = np.arange(len(v))
        while not self.levels or (sizes > 1).any():
            first, groups = np.cumsum(sizes) - sizes, -(-sizes // fan)
            at = np.repeat(first - fan * (np.cumsum(groups) - groups), groups) + fan * np.arange(groups.sum())
            both, none = np.bitwise_and.reduceat(mask & bits, at), np.bitwise_and.reduceat(mask & ~bits, at)
            count = np.diff(np.append(at, len(mask)))
            mask, bits, place, sizes = both | none, both, place[at], groups
            self.levels.append((at, count, mask, bits))
            self.place.append(place)

    def one_component(self, level: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Node pairs all of whose members have one label already."""
        low, high = np.minimum.reduceat(label, self.place[level]), np.maximum.reduceat(label, self.place[level])
        return (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])


def children(first: np.ndarray, count: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parent pair, child of a, child of b) for all pairs of children; of a node with itself, each pair once."""
    n = count[a] * count[b]
    parent = np.repeat(np.arange(len(a)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = count[b][parent]
    x, y = first[a][parent] + k // wide, first[b][parent] + k % wide
    once = x <= y
    return parent[once], x[once], y[once]


def link_segments(v: np.ndarray, begin: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], distance: int = DISTANCE, step: int = 1 << 19) -> np.ndarray:
    """Labels (least index of the component) of ``v`` after linking, in each pair of segments, all that is at the distance.

    The pairs (i <= j, a segment with itself or two segments) descend together from their top nodes: a pair of nodes adds up
    the differing bits among those shared that its ancestors have not counted, and goes with all its members once the sum
    passes the distance, or once all are one component.
    """
    index = GrayIndex(v, begin)
    label = np.arange(len(v))
    own = np.zeros(len(begin), bool)
    own[pairs[0][pairs[0] == pairs[1]]] = True
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(v))))
    for lag in (1, 2, 3, 4):  # neighbours in Gray order first: most of a dense group becomes one component at once
        a = np.flatnonzero((of[:-lag] == of[lag:]) & own[of[:-lag]]) if len(v) > lag else np.zeros(0, int)
        a = a[np.bitwise_count(v[a] ^ v[a + lag]) <= distance]
        label = roots(len(v), a, a + lag, label)

    def descend(level: int, a: np.ndarray, b: np.ndarray, seen: np.ndarray, sum_: np.ndarray) -> None:
        """Node pairs at ``level``; ``seen``: shared bits counted so far; ``sum_``: how many of them differ."""
        nonlocal label
        first, count = index.levels[level][:2]
        cuts = np.searchsorted(np.cumsum(count[a] * count[b]), np.arange(step, max(step, int((count[a] * count[b]).sum())), step)) + 1
        for x, y, s, t in zip(*(np.split(z, np.unique(cuts)) for z in (a, b, seen, sum_)), strict=True):
            keep = ~index.one_component(level, x, y, label)
            x, y, s, t = x[keep], y[keep], s[keep], t[keep]
            if not len(x):
                continue
            parent, ca, cb = children(first, count, x, y)
            if level == 0:
                hit = np.bitwise_count((v[ca] ^ v[cb]) & ~s[parent]) + t[parent] <= distance
                label = roots(len(v), ca[hit], cb[hit], label)
            else:
                mask, bits = index.levels[level - 1][2:]
                new = mask[ca] & mask[cb] & ~s[parent]
                total = t[parent] + np.bitwise_count((bits[ca] ^ bits[cb]) & new)
                ok = total <= distance
                if ok.any():
                    descend(level - 1, ca[ok], cb[ok], (s[parent] | new)[ok], total[ok])

    a, b = pairs
    _, _, mask, bits = index.levels[-1]
    new = mask[a] & mask[b]
    total = np.bitwise_count((bits[a] ^ bits[b]) & new).astype(np.int64)
    ok = total <= distance
    descend(len(index.levels) - 1, a[ok], b[ok], new[ok], total[ok])
    return label


def link(v: np.ndarray, distance: int = DISTANCE, other: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Stars that join what is linked among ``v`` (with ``other``: between the two only): (fingerprint, its component's first)."""
    v = v[np.argsort(gray_rank(v), kind="stable")]
    begin, pairs = np.zeros(1, int), (np.zeros(1, int), np.zeros(1, int))
    if other is not None:
        begin, pairs = np.array([0, len(v)]), (np.zeros(1, int), np.ones(1, int))
        v = np.concatenate([v, other[np.argsort(gray_rank(other), kind="stable")]])
    label = link_segments(v, begin, pairs, distance)
    far = np.flatnonzero(label != np.arange(len(v)))
    return list(zip(v[far].tolist(), v[label[far]].tolist(), strict=True))


def bands(blocks: int, agree: int) -> list[int]:
    """The bit masks of every choice of ``agree`` of ``blocks`` blocks of 64 bits."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(part[k] for k in c) for c in combinations(range(blocks), agree)]


def link_distinct(fps: DataFrame, distance: int = DISTANCE, blocks: int = 6, most: int = 4096) -> DataFrame:
    """Distinct ``fp`` -> star edges (a, b) of all that is linked."""
    masks = bands(blocks, blocks - distance)
    keys = F.array(*[F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(masks)])
    dealt = fps.select("fp", F.explode(keys).alias("k")).select("k.band", "k.key", "fp")
    sizes = dealt.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = dealt.join(sizes, ["band", "key"])
    chunks = F.ceil(F.col("n") / most).cast("int")
    own: Column = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), chunks - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    tasks = met.select("band", "key", "fp", own.alias("own"), F.explode(pair).alias("p")).select("band", "key", "p.i", "p.j", "own", "fp")

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def pairs(cols: list[np.ndarray]) -> pa.RecordBatch | None:
            band, key, i, j, own, fp = cols
            task = np.cumsum(np.concatenate([[0], (band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            v = fp.view(np.uint64)
            side = (own != i).astype(np.int64)  # a task of two chunks has two segments
            order = np.lexsort((gray_rank(v), side, task))
            v, task, side = v[order], task[order], side[order]
            new = np.concatenate([[True], (task[1:] != task[:-1]) | (side[1:] != side[:-1])])
            begin = np.flatnonzero(new)
            two = np.flatnonzero((task[begin][:-1] == task[begin][1:]) & (side[begin][:-1] < side[begin][1:]))
            one = np.flatnonzero((i == j)[order][begin])
            label = link_segments(v, begin, (np.concatenate([one, two]), np.concatenate([one, two + 1])), distance)
            far = np.flatnonzero(label != np.arange(len(v)))
            if len(far):
                return pa.RecordBatch.from_arrays([pa.array(v[far].view(np.int64)), pa.array(v[label[far]].view(np.int64))], ["a", "b"])

        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]) | (cols[3] != cols[3][-1]))
            at = int(last[-1]) + 1 if len(last) else 0
            if at and (got := pairs([x[:at] for x in cols])):
                yield got
            rest = [x[at:] for x in cols]
        if rest is not None and len(rest[0]) and (got := pairs(rest)):
            yield got

    dealt_out = tasks.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    return map_arrow(dealt_out, search, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, words: int = SHINGLE, blocks: int = 6, most: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; ``blocks`` > ``distance`` sets the size of buckets, not the result."""
    fp = materialize(fingerprints(docs, words), "fingerprints")
    nodes = materialize(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = connected_components(link_distinct(nodes.select("fp"), distance, blocks, most))
    home = materialize(nodes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "homes")
    named = materialize(join_skewed(home.select("fp", "root"), home.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id"), "components")
    return join_skewed(fp, named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, distance: int = DISTANCE, words: int = COPY_WORDS, similar: float = COPY_SIMILAR, blocks: int = 6, most: int = 4096) -> DataFrame:
    """The documents, one of each group: the smallest doc_id; of its rows in the group, the one whose text hashes least.

    Rows that share a doc_id but no group are kept apart.  A group is what pairs with a shingle Jaccard of ``similar`` or more
    join, checked on the texts.  At 0.8 two 64-bit fingerprints differ in ten bits on average and in twenty at times, so the
    Gray index finds the close pairs first and ``shingle_join`` every other one.  Rows without a doc_id can't be named as
    anyone's copy and stay as they are.  Null and empty texts are copies of each other.
    """
    groups = similar_groups(docs, words, similar, distance, blocks, most).where("doc_id is not null")
    least = groups.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("r")).select("r.*")
    alike = groups.groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    named = materialize(least.join(alike, ["doc_id", "th"]).select("doc_id", F.col("th").alias("th "), "n"), "kept-rows")
    rows = docs.withColumn("th ", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = rows.join(named.where("n = 1").select("doc_id", "th "), ["doc_id", "th "], "left_semi").select(*docs.columns)
    if not (again := named.where("n > 1").select("doc_id", "th ")).isEmpty():  # rows that share doc_id and text: one is left
        one = rows.join(again, ["doc_id", "th "], "left_semi").groupBy("doc_id", "th ").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("r"))
        found = found.union(one.select("r.*").select(*docs.columns))
    return found.union(docs.where("doc_id is null"))
