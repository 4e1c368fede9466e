"""Benchmark decontamination by pigeonhole edit matching.

Texts are reduced to lower-case words with one blank between.  A test item of n characters may differ from a passage of a
document by ``rate * n`` edits.  It is cut into that many pieces plus one, so in any such passage one piece at least is
left whole.  Aho-Corasick finds all pieces of all items in one scan of a document; each place where a piece fits an item is
a window, kept only if it shares as many 4-grams with the item as the edits must leave (each edit spoils four), and then
verified with Myers' bit-parallel edit distance.

Items go to the executors in blocks of ``BLOCK_CHARS`` characters at most on average, each block against all documents.

Rows: null or blank documents match nothing; a null or blank item is matched by nothing; an item shorter than ten
characters must occur unchanged; repeated items are reported under each of their ids, repeated documents each; a null
doc_id is carried; empty tables give no row.  Columns other than doc_id, text, item_id are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, slices

RATE = 0.1
BLOCK_CHARS = 4_000_000
GRAM = 4

_gap = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    """Lower-case words with one blank between."""
    return _gap.sub(" ", (text or "").lower()).strip()


def budget(n: int, rate: float = RATE) -> int:
    """Edits an item of ``n`` characters may differ by."""
    return int(n * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces of about equal length with their offsets."""
    n = errors + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, passage: str) -> tuple[int, int]:
    """(least edit distance of ``item`` to any substring of ``passage``, end of the first such substring)."""
    m = len(item)
    if not m:
        return 0, 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, now, best, end = full, 0, m, m, 0
    for j, c in enumerate(passage, 1):
        eq = where.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            now += 1
        elif down & top:
            now -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if now < best:
            best, end = now, j
    return best, end


def matcher(items: list[tuple[int, str]], rate: float = RATE) -> Callable[[str | None], list[tuple[int, int, int]]]:
    """text -> [(item_id, edits, characters of the item)], one for each item that some passage of the text matches."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    known: dict[str, list[int]] = {}
    for item_id, text in items:
        if t := plain(text):
            if item_id not in known.setdefault(t, []):
                known[t].append(item_id)
    texts = list(known)
    errors = [budget(len(t), rate) for t in texts]
    grams = [{t[i : i + GRAM] for i in range(len(t) - GRAM + 1)} for t in texts]
    at: dict[str, list[tuple[int, int, int, str, str]]] = {}
    for k, t in enumerate(texts):
        cut = pieces(t, errors[k])
        for i, (offset, p) in enumerate(cut):
            j = i ^ 1
            mate = cut[j][1] if j < len(cut) else ""
            at.setdefault(p, []).append((k, offset, (j > i) - (j < i) if mate else 0, mate[: len(mate) // 2], mate[len(mate) // 2 :]))
    for p, places in at.items():
        auto.add_word(p, (len(p), places))
    if not at:
        return lambda text: []
    auto.make_automaton()

    def search(text: str | None) -> list[tuple[int, int, int]]:
        t = plain(text)
        starts: dict[int, set[int]] = {}
        for end, (n, places) in auto.iter(t):
            for k, offset, side, first, second in places:
                if side > 0:  # the neighbour follows
                    b = end + 1 + len(first)
                    if not (t.startswith(first, end + 1) or t.startswith(second, b) or t.startswith(second, b - 1) or t.startswith(second, b + 1)):
                        continue
                elif side < 0:
                    b = end + 1 - n - len(second)
                    a = b - len(first)
                    if not (b >= 0 and t.startswith(second, b) or a >= 0 and t.startswith(first, a) or a > 0 and t.startswith(first, a - 1) or a >= -1 and t.startswith(first, a + 1)):
                        continue
                starts.setdefault(k, set()).add(end + 1 - n - offset)
        out = []
        for k, found in starts.items():
            item, e, own = texts[k], errors[k], grams[k]
            n, best, done = len(item), None, -1 << 60
            need = len(own) - GRAM * e
            for s in sorted(found):
                if s <= done:  # the window before holds this one
                    continue
                done = s + e
                window = t[max(0, s - e) : s + 2 * e + n]
                if need > 0:
                    has = {window[i : i + GRAM] for i in range(len(window) - GRAM + 1)}
                    if len(own & has) < need:
                        continue
                d, _ = myers(item, window)
                if d <= e and (best is None or d < best):
                    best = d
            if best is not None:
                out += [(item_id, best, n) for item_id in known[item]]
        return out

    return search


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """(number of blocks, the blocks): their total is measured first, and each block is collected when it is its turn."""
    some = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = some.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // block_chars + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return n, ([(r["item_id"], r["text"]) for r in some.where(block == k).orderBy("item_id", "text").collect()] for k in range(n))


FOUND = "doc_id long, item_id long, edits int, item_chars int"


def leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, item_chars): which documents hold which test items, a row for each pair.

    Where there are several blocks, each is searched for and its finds written before the next one is fetched.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, blocks = item_blocks(items, block_chars)
    found = None
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(block)  # bounded by the block's size
        part = map_arrow(rows, _finder(shared, rate), FOUND)
        if n > 1:
            part = materialize(part, "leaks")
            shared.destroy()
        found = part if found is None else found.union(part)
    return found


def _finder(shared, rate: float):
    def run(batches):
        import pyarrow as pa

        search = matcher(shared.value, rate)
        for b in (part for whole in batches for part in slices(whole)):
            got = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in search(t)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "edits", "item_chars"])

    return run


def drop_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no test item, with their own columns; each block is a pass without a join."""
    n, blocks = item_blocks(items, block_chars)
    before = None
    for k, block in enumerate(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            import pyarrow as pa

            search = matcher(shared.value, rate)
            for b in (part for whole in batches for part in slices(whole)):
                text = b.column(b.schema.names.index("text")).to_pylist()
                yield b.filter(pa.array([not search(t) for t in text], pa.bool_()))

        docs = map_arrow(docs, run, docs.schema)
        if k + 1 < n:
            docs = materialize(docs, "decontaminated")
            shared.destroy()
            if before is not None:
                discard(before)
            before = docs
    return docs
