"""Token-id output: shards of concatenated ids with Elias-Fano document boundaries.

A shard file holds, in this order:

* the ids of its documents, concatenated, as little-endian unsigned integers (2 bytes where the vocabulary allows, else 4);
* an Elias-Fano sequence of the documents' end offsets inside the shard (in ids);
* an Elias-Fano sequence of the doc_ids, less the smallest of them;
* a footer of fixed size with the counts, section lengths, a CRC-32 of the two sequences and one of the ids.

Offsets inside a shard come from ``select`` on the unary high bits plus the packed low bits; the only 64-bit offset is
one base per shard, kept in the manifest.  Documents are dealt by range of doc_id, so shard k precedes shard k + 1.

Rows: a null text counts as empty (the end id alone); a null doc_id sorts first; repeated doc_ids stay, ordered by the
hash of their text, and wholly equal rows may be dealt to different shards; an empty table gives no shard and no row.  The
text of a special token becomes that token's id, as the library has it.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import string
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import fresh_path, map_arrow, materialize, slices, worker_state

FOOTER = "<8sIQQQqQQII"
FOOTER_SIZE = struct.calcsize(FOOTER)
MAGIC = b"TSSREF01"
EVERY = 64
BLOCK_DOCS = 4096


class EliasFano:
    """A non-decreasing sequence of ``n`` integers below ``universe`` in about n * (2 + log2(universe / n)) bits."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values) -> "EliasFano":
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"", b"")
        universe = int(v[-1]) + 1
        k = max(0, (universe // n).bit_length() - 1)
        shifts = np.arange(k, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (v >> np.uint64(k)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, k, low, np.packbits(bits, bitorder="little").tobytes(), ones[::EVERY].astype("<u8").tobytes())

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.select_range(i, i + 1)[0])

    def select_range(self, a: int, b: int) -> np.ndarray:
        """The values a .. b - 1 as int64: only the bits between the sampled one-bits around them are looked at."""
        if a >= b:
            return np.zeros(0, np.int64)
        first, last = a // EVERY, -(-b // EVERY)
        at = np.frombuffer(self.samples, "<u8")
        begin, end = int(at[first]) >> 3, (int(at[last]) >> 3) + 1 if last < len(at) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8, end - begin, begin), bitorder="little")) + (begin << 3)
        ones = ones[np.searchsorted(ones, int(at[first])) :][a - first * EVERY : b - first * EVERY]
        out = (ones - np.arange(a, b)).astype(np.int64) << self.low_bits
        if self.low_bits:
            begin, end = a * self.low_bits, b * self.low_bits
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8, (end + 7 >> 3) - (begin >> 3), begin >> 3), bitorder="little")
            bits = bits[begin & 7 :][: end - begin].reshape(b - a, self.low_bits)
            out |= bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<QIQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low + self.high + self.samples

    @classmethod
    def from_bytes(cls, data: bytes) -> "EliasFano":
        n, k, a, b, c = struct.unpack_from("<QIQQQ", data)
        at = struct.calcsize("<QIQQQ")
        return cls(n, k, data[at : at + a], data[at + a : at + a + b], data[at + a + b : at + a + b + c])


MEMO_BYTES = 24 << 20  # per Python worker: about what remembered chunks take; later ones are encoded without being kept
MEMO_CHUNK = 64  # characters of the longest chunk that is kept
BATCH_BYTES = 8 << 20  # of text that is encoded at a time, one document at least
TAILS = string.punctuation


def encoder(tokenizer_path: str, end_id: int) -> "Encoder":
    """The worker's encoder, made once."""
    kept = worker_state()
    if ("encoder", tokenizer_path, end_id) not in kept:
        kept["encoder", tokenizer_path, end_id] = Encoder(tokenizer_path, end_id)
    return kept["encoder", tokenizer_path, end_id]


class Encoder:
    """Texts -> ids with the end id, by the tokenizers library.

    Byte-level BPE splits a text before every single blank that stands between two visible characters, and between a letter
    or digit and the punctuation that ends such a chunk.  So a batch's chunks are cut and made distinct by Arrow, only new
    words go to the library, in strings of a thousand, and short ones are remembered.  Texts with any other run of blanks,
    or with the text of a special token, are encoded whole, and so is every text where the tokenizer is of another kind.
    """

    def __init__(self, tokenizer_path: str, end_id: int, memo_bytes: int = MEMO_BYTES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = tok = Tokenizer.from_file(tokenizer_path)
        self.size = 2 if max(tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.kind = f"<u{self.size}"
        self.end = np.array([end_id], self.kind).tobytes()
        cut = tok.pre_tokenizer
        self.by_chunks = tok.normalizer is None and isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space
        self.special = tuple(t.content for t in tok.get_added_tokens_decoder().values())
        self.opens = np.zeros(tok.get_vocab_size(), bool)
        self.opens[[i for t, i in tok.get_vocab().items() if t.startswith("\u0120")]] = True
        self.memo: dict[str, bytes] = {}
        self.room = memo_bytes

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, each as it stands after a blank; a chunk's ids begin where a token begins with a blank."""
        got: list[bytes] = []
        for a in range(0, len(chunks), 1000):
            some = chunks[a : a + 1000]
            ids = np.array(self.tok.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            at = (np.flatnonzero(self.opens[ids]) * self.size).tolist()
            if len(at) != len(some):
                raise RuntimeError("the tokenizer does not open each chunk with a token of its own")
            raw = ids.tobytes()
            got += map(raw.__getitem__, map(slice, at, [*at[1:], len(raw)]))
        return got

    def words(self, found: list[str]) -> list[bytes]:
        """Ids of distinct words as they stand after a blank."""
        out = list(map(self.memo.get, found))
        new = [i for i, v in enumerate(out) if v is None]
        words = [found[i] for i in new]
        got = self.learn(words)
        for i, v in zip(new, got, strict=True):
            out[i] = v
        if self.room > 0:
            small = {c: v for c, v in zip(words, got, strict=True) if len(c) <= MEMO_CHUNK}
            self.memo.update(small)
            self.room -= 190 * len(small) + sum(map(len, small)) + sum(map(len, small.values()))
        return out

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the texts, an Arrow array, in a row; end offset of each)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.equal(texts, "")
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False) | (not self.by_chunks)
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        at = split.offsets.to_numpy()
        distinct = split.values.dictionary_encode()
        codes, chunks = distinct.indices.to_numpy(), distinct.dictionary
        bare = pc.and_(pc.equal(pc.utf8_trim_whitespace(chunks), chunks), pc.not_equal(chunks, ""))
        unfit = ~bare.to_numpy(zero_copy_only=False)[codes]
        odd[np.searchsorted(at, np.flatnonzero(unfit), side="right") - 1] = True
        # A chunk is a word and its tail: the punctuation after its last letter or digit.
        cut = pc.utf8_rtrim(chunks, TAILS)
        word = pc.if_else(pc.and_(bare, pc.match_substring_regex(cut, "[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]$")), cut, pc.if_else(bare, chunks, "."))
        shorter = (pc.binary_length(word).to_numpy() < pc.binary_length(chunks).to_numpy()) & bare.to_numpy(zero_copy_only=False)
        tail = np.zeros(len(chunks), np.int64)  # number of each chunk's tail; the first one is none
        which = np.flatnonzero(shorter)
        tails: dict[str, int] = {"": 0}
        some = pa.array(which)
        pairs = zip(chunks.take(some).to_pylist(), pc.utf8_length(word.take(some)).to_pylist(), strict=True)
        tail[which] = [tails.setdefault(c[n:], len(tails)) for c, n in pairs]
        words = word.dictionary_encode()
        ids = self.words(words.dictionary.to_pylist())
        of = words.indices.to_numpy().astype(np.int64)
        after = [b"", *self.whole(list(tails)[1:])]
        tops = self.whole([t if o else h for t, o, h in zip(texts.to_pylist(), odd.tolist(), chunks.take(pa.array(codes[at[:-1]])).to_pylist(), strict=True)])
        n, m, k = len(ids), len(after), len(texts)
        both = np.stack([of[codes], n + tail[codes]], 1)
        rows = []
        for i, (o, a, b) in enumerate(zip(odd.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)):  # head or whole, words and tails, the end id
            rows += [[n + m + i], [] if o else both[a + 1 : b].ravel(), [n + m + k]]
        row = np.concatenate(rows).astype(np.int64)
        values = [*ids, *after, *tops, self.end]
        lens = np.fromiter(map(len, values), np.int64, len(values)) // self.size
        begin = np.cumsum(lens) - lens
        each = lens[row]
        until = np.cumsum(each)
        out = np.frombuffer(b"".join(values), self.kind)[np.repeat(begin[row] - until + each, each) + np.arange(until[-1])]
        return out, until[np.cumsum([len(r) for r in rows])[2::3] - 1]


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Encode ``docs`` into shard files under ``folder``; returns the manifest (shard, path, n_docs, n_ids, base).

    Each attempt of a task writes a file of its own; the manifest, a table that Spark commits, names the one that counts,
    so files of lost attempts are never read.
    """
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})  # repeated rows are told apart by their place
        .repartitionByRange("doc_id", "tie", "place")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )

    def shards(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        coder = encoder(tokenizer_path, end_id)
        out, ends, ids, nulls, total, crc = None, [], [], 0, 0, 0
        for batch in batches:
            for part in slices(batch, BATCH_BYTES):
                if out is None:
                    path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.ids"
                    store, inside = filesystem(path)
                    store.create_dir(inside.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(inside)
                packed, until = coder.encode(part.column(1))
                ends.append(until + total)
                total += len(packed)
                nulls += part.column(0).null_count
                ids.append(part.column(0).drop_null().to_numpy())
                data = packed.tobytes()
                crc = zlib.crc32(data, crc)
                out.write(data)
        if out is None:
            return
        known, until = np.concatenate(ids), np.concatenate(ends)
        least = int(known[0]) if len(known) else 0
        one, two = EliasFano.build(until).to_bytes(), EliasFano.build(known - least).to_bytes()
        out.write(one + two + struct.pack(FOOTER, MAGIC, coder.size, len(until), total, nulls, least, len(one), len(two), zlib.crc32(one + two), crc))
        out.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [len(until)], "n_ids": [total]})

    found = materialize(map_arrow(rows, shards, "shard long, path string, n_docs long, n_ids long"), "token-manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row per shard, not per document
    return found.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class Shard:
    """Random access to one shard file."""

    def __init__(self, path: str):
        store, inside = filesystem(path)
        self.file = store.open_input_file(inside)
        end = self.file.size()
        magic, self.size, self.n_docs, self.n_ids, self.nulls, self.least, a, b, crc, self.crc = struct.unpack(FOOTER, self.file.read_at(FOOTER_SIZE, end - FOOTER_SIZE))
        data = self.file.read_at(a + b, self.n_ids * self.size)
        if magic != MAGIC or zlib.crc32(data) != crc:
            raise ValueError(f"{path} is damaged")
        self.ends, self.ids = EliasFano.from_bytes(data[:a]), EliasFano.from_bytes(data[a:])

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.ids.select(i - self.nulls)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def tokens(self, a: int, b: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((b - a) * self.size, a * self.size), f"<u{self.size}")


def read_shards(manifest: DataFrame) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as 4-byte integers)."""

    def documents(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, base in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                s = Shard(path)
                crc, start = 0, 0
                for a in range(0, s.n_docs, BLOCK_DOCS):
                    b = min(a + BLOCK_DOCS, s.n_docs)
                    ends = s.ends.select_range(a, b)
                    starts = np.concatenate([[start], ends[:-1]]).astype(np.int64)
                    lead = min(max(s.nulls - a, 0), b - a)
                    ids = [None] * lead + (s.ids.select_range(a + lead - s.nulls, b - s.nulls) + s.least).tolist()
                    k = 0
                    while k < b - a:  # as many documents as make about 4 million ids
                        m = max(k + 1, int(np.searchsorted(ends, starts[k] + (4 << 20), side="right")))
                        raw, off = s.tokens(int(starts[k]), int(ends[m - 1])), int(starts[k])
                        crc = zlib.crc32(raw, crc)
                        wide = raw.astype("<u4")
                        each = [zlib.crc32(wide[x - off : y - off]) for x, y in zip(starts[k:m].tolist(), ends[k:m].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[k:m], pa.int64()), pa.array(starts[k:m] + base), pa.array(ends[k:m] - starts[k:m]), pa.array(each, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        k = m
                    start = int(ends[-1])
                if crc != s.crc:
                    raise ValueError(f"the ids of {path} are damaged")

    n = max(1, manifest.count())
    return map_arrow(manifest.select("path", "base").repartition(n), documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokens_on_disk(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as token shards and read them back."""
    spark: SparkSession = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    return read_shards(write_shards(docs, folder, tokenizer_path or tokenizer_file(), end_id))
