"""Pairs of documents by the Jaccard similarity of their word shingles, every candidate checked on the shingles themselves.

A shingle is an XXH64 of ``words`` words, as in the fingerprints; equal sets are one node.  Candidates come from the Gray
index over the fingerprints and, as those differ too much at a similarity of 0.8, from ``BANDS`` bands of ``ROWS`` least
hashes: a pair at similarity s has no band in common with probability (1 - s**ROWS) ** BANDS, 5e-7 at 0.8 and less above,
whatever the size of the corpus.  A bucket of more than ``most`` sets is cut into chunks, each pair of chunks a task, so no
bucket is capped.

There are two rounds, and counts of a set's hashes in ``BINS`` bins, which bound what two sets share from above, drop most
chance meetings inside their bucket, so that what leaves it follows the links and not the square of its size.  The first takes the links that the Gray index gives and, in each bucket, neighbours
by size and the star around the set whose fingerprint is nearest to the majority of the bucket's bits: copies of one text are
like that text, if not always like each other, so dense groups become one component with a few checks for each member.  The
second takes every pair of a bucket whose sets are not one component yet, unless their fingerprints differ in more than
``FAR`` bits, which a pair at 0.8 does with a probability below 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_skewed, map_arrow, map_rows, materialize
from .components import connected_components

BANDS, ROWS = 48, 6
SMALL, BINS, BITS, FAR, BLOCK = 64, 256, 1 << 23, 26, 1 << 20


def hash_family(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and terms of ``BANDS * ROWS`` hashes of 32 bits: x -> a * x + b, modulo 2**32."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint64).astype(np.uint32)
    return a | np.uint32(1), b


def bands_of(s: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """A 64-bit name of each band's least hashes over a set of shingle hashes; none for an empty set."""
    import xxhash

    if not len(s):
        return []
    a, b = family
    x = (s ^ s >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), ~np.uint32(0))
    for k in range(0, len(x), 1024):
        least = np.minimum(least, (x[k : k + 1024, None] * a + b).min(axis=0))
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[4 * ROWS * k : 4 * ROWS * (k + 1)], k) - (1 << 63) for k in range(BANDS)]


def sketches(texts: DataFrame, words: int) -> DataFrame:
    """(doc_id, th, fp, key, n, bands, bins) of every row of ``texts`` (doc_id, text, th): ``key`` names the set, ``n`` is its size.

    ``bins`` are full where a count passes a byte, so that such a set is never dropped by the bound.
    """
    from .simhash import majority, shingle_hashes, signed

    def make():
        import xxhash

        family = hash_family()

        def f(c):
            out = {"doc_id": c["doc_id"], "th": c["th"], "fp": [], "key": [], "n": [], "bands": [], "bins": []}
            for t in c["text"]:
                h = shingle_hashes(t, words)
                s = np.unique(h)
                out["fp"].append(signed(majority(h)))
                out["key"].append(signed(xxhash.xxh64_intdigest(s.tobytes(), 42)))
                out["n"].append(len(s))
                out["bands"].append(bands_of(s, family))
                counts = np.bincount((s & np.uint64(BINS - 1)).astype(int), minlength=BINS)
                out["bins"].append(counts.astype(np.uint8).tobytes() if counts.max() < 256 else b"\xff" * BINS)
            return out

        return f

    return map_rows(texts, make, "doc_id long, th long, fp long, key long, n int, bands array<long>, bins binary")


def candidates(met: DataFrame, sizes: DataFrame, similar: float, most: int, every: bool) -> DataFrame:
    """(a, b) of ``met`` (k, key, n, fp, root, bins): neighbours and the star of a bucket, or ``every`` pair of unlike roots that can be similar."""
    dealt = join_skewed(met, sizes, "k")
    chunks = F.ceil(F.col("c") / most).cast("int")
    own = F.pmod(F.xxhash64("key"), chunks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), chunks - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    tasks = dealt.select("k", "key", "n", "fp", "root", own.alias("own"), "bins", F.explode(pair).alias("p")).select("k", "p.i", "p.j", "n", "key", "fp", "root", "own", "bins")

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def blocks(cols: list[np.ndarray]) -> Iterator[np.ndarray]:
            """Candidate pairs, some of them more than once."""
            k, i, j, n, key, fp, root, own, bins = cols
            fp = fp.view(np.uint64)

            def take(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                ok = (root[a] != root[b]) & ((i[a] == j[a]) | (own[a] != own[b]))
                ok &= np.minimum(n[a], n[b]) >= similar * np.maximum(n[a], n[b]) - 1e-6
                a, b = a[ok], b[ok]
                near = np.bitwise_count(fp[a] ^ fp[b]) <= FAR
                a, b = a[near], b[near]
                fits = np.zeros(len(a), bool)
                for at in range(0, len(a), 1 << 14):
                    p, q = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
                    room = np.minimum(bins[p], bins[q]).sum(axis=1, dtype=np.int64)
                    fits[at : at + (1 << 14)] = (room * (1 + similar) >= similar * (n[p].astype(float) + n[q]) - 1e-6) | (np.minimum(n[p], n[q]) > 128 * BINS)
                x, y = key[a[fits]], key[b[fits]]
                return np.stack([np.minimum(x, y), np.maximum(x, y)], 1)

            begin = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            size = np.diff(np.append(begin, len(k)))
            group = np.repeat(np.arange(len(begin)), size)
            small = (size <= SMALL)[group]
            if not every:
                a = np.flatnonzero(group[:-1] == group[1:])
                yield take(a, a + 1)
                votes = np.add.reduceat(np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32), begin, axis=0)
                middle = np.packbits(2 * votes > size[:, None], axis=1).view(np.uint64).ravel()
                far = np.bitwise_count(fp ^ middle[group]).astype(np.int64)
                hub = np.lexsort((key, far, group))[begin]
                a = np.flatnonzero(hub[group] != np.arange(len(k)))
                yield take(hub[group[a]], a)
                return
            for lag in range(1, SMALL):
                a = np.flatnonzero((group[:-lag] == group[lag:]) & small[:-lag]) if len(k) > lag else np.zeros(0, int)
                if not len(a):
                    break
                yield take(a, a + lag)
            for g in np.flatnonzero(size > SMALL).tolist():  # in order of size
                m = n[begin[g] : begin[g] + size[g]]
                reach = np.minimum(np.searchsorted(m, m / similar + 1e-6, side="right"), size[g]) - np.arange(size[g]) - 1
                at = 0
                while at < size[g]:  # as many rows as make a block of pairs
                    to = max(at + 1, int(np.searchsorted(np.cumsum(reach[at:]), BLOCK, side="right")) + at)
                    r = reach[at:to]
                    a = np.repeat(np.arange(at, to), r)
                    b = a + 1 + np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r)
                    yield take(a + begin[g], b + begin[g])
                    at = to

        def pairs(cols: list[np.ndarray]) -> Iterator:
            held, count = [], 0
            for block in blocks(cols):
                held.append(block)
                count += len(block)
                if count >= BLOCK:
                    yield batch_of(held)
                    held, count = [], 0
            if count:
                yield batch_of(held)

        def batch_of(held: list[np.ndarray]) -> pa.RecordBatch:
            both = np.unique(np.concatenate(held), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(x).to_numpy(zero_copy_only=False) for x in range(8)]
            cols.append(np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint8).reshape(-1, BINS))
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
            at = int(last[-1]) + 1 if len(last) else 0
            if at:
                yield from pairs([x[:at] for x in cols])
            rest = [x[at:] for x in cols]
        if rest is not None and len(rest[0]):
            yield from pairs(rest)

    return map_arrow(tasks.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "n", "key"), search, "a long, b long").distinct()


def shared_only(dealt: DataFrame) -> DataFrame:
    """The rows of ``dealt`` (k, key, n, fp) whose k occurs more than once, by one shuffle."""

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rest, carried = None, False
        for batch in batches:  # a row goes once the next one is known
            whole = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            k = whole.column(0).to_numpy()
            same = k[1:] == k[:-1]
            keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            done = len(k) - 1
            if carried:
                keep[0] = True
            yield from whole.slice(0, done).filter(pa.array(keep[:done])).to_batches()
            rest, carried = whole.slice(done).combine_chunks().to_batches()[0], bool(keep[done])
        if carried:
            yield rest

    return map_arrow(dealt.repartition("k").sortWithinPartitions("k"), search, "k long, key long, n int, fp long")


def holding(texts: DataFrame, need: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose th can be in ``need`` (some others pass too): a bitmap, so that few texts are shuffled."""
    at = need.select(F.pmod("th", F.lit(BITS)).cast("int").alias("x")).distinct().toArrow().column(0).to_numpy()
    bits = np.zeros(BITS, bool)
    bits[at] = True
    packed = np.packbits(bits)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = np.unpackbits(packed).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(known[batch.column(1).to_numpy() % BITS]))

    return map_arrow(texts.select("text", "th"), run, "text string, th long")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similar: float) -> DataFrame:
    """The pairs (a, b) of keys whose shingle sets are similar; sets are made from the texts of those that are candidates."""
    from .simhash import shingle_hashes

    pairs = materialize(pairs, "candidates")
    need = materialize(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct().join(nodes.select("key", "th"), "key"), "candidate-sets")
    one = holding(texts, need).groupBy("th").agg(F.first("text").alias("text"))

    def sets():
        return lambda c: {"key": c["key"], "s": [np.unique(shingle_hashes(t, words)).view(np.int64).tolist() for t in c["text"]]}

    held = materialize(map_rows(need.join(one, "th").select("key", "text"), sets, "key long, s array<long>"), "candidate-shingles")
    side = lambda x: held.select(F.col("key").alias(x), F.col("s").alias(f"s_{x}"))
    both = F.size(F.array_intersect("s_a", "s_b"))  # row by row, so that long sets never meet in one batch
    met = join_skewed(join_skewed(pairs, side("a"), "a"), side("b"), "b")
    out = materialize(met.where(both >= similar * (F.size("s_a") + F.size("s_b") - both) - 1e-9).select("a", "b"), "similar-pairs")
    discard(pairs, need, held)
    return out


def similar_groups(docs: DataFrame, words: int, similar: float, distance: int, blocks: int, most: int) -> DataFrame:
    """(doc_id, th, root) of every row: ``root`` is the same for all that chains of similar pairs join, ``th`` hashes the text."""
    from .simhash import link_distinct

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    rows = materialize(sketches(texts, words), "sketches")
    firsts = [F.first(x).alias(x) for x in ("fp", "n", "bands", "bins")]
    nodes = materialize(rows.groupBy("key").agg(F.min("th").alias("th"), *firsts), "sets")
    dealt = nodes.select("key", "n", "fp", F.explode("bands").alias("k")).select("k", "key", "n", "fp")
    met = materialize(shared_only(dealt).join(nodes.select("key", "bins"), "key").withColumn("root", F.col("key")), "shared-bands")
    first = nodes.groupBy("fp").agg(F.min("key").alias("least"))
    stars = link_distinct(first.select("fp"), distance, blocks, most)
    gray = stars.join(first.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    same = nodes.join(first, "fp").select(F.col("key").alias("x"), F.col("least").alias("y"))
    linked = gray.select("x", "y").union(same).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    sizes = met.groupBy("k").agg(F.count("*").alias("c"))
    edges = verified(linked.union(candidates(met, sizes, similar, most, False)).distinct(), nodes, texts, words, similar)
    homes = connected_components(edges).select(F.col("node").alias("key"), F.col("root").alias("home"))
    left = materialize(met.join(homes, "key", "left").withColumn("root", F.coalesce("home", "key")).drop("home"), "open-bands")
    discard(met)
    sizes = left.groupBy("k").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("k", "c")
    more = verified(candidates(left, sizes, similar, most, True), nodes, texts, words, similar)
    homes = connected_components(edges.union(more)).select(F.col("node").alias("key"), F.col("root").alias("home"))
    out = materialize(rows.select("doc_id", "th", "key").join(homes, "key", "left").select("doc_id", "th", F.coalesce("home", "key").alias("root")), "similar-groups")
    discard(left, rows, nodes, edges, more)
    return out
