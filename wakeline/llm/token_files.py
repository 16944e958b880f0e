"""Token ids of documents in binary files with Elias-Fano encoded document boundaries.

A file holds one key range of documents, in ascending key order:

    ids         n_tokens unsigned little-endian integers of `width` bytes
    boundaries  Elias-Fano code of the n_docs + 1 offsets 0 .. n_tokens
    keys        Elias-Fano code of the keys, less the smallest
    footer      fixed size: counts, widths, section sizes, magic

An Elias-Fano code of n ascending values up to u keeps the low
log2(u / n) bits of each in a packed array and the high parts as ones in a bit
vector: about 2 + log2(u / n) bits a value. Value i is `select(i) - i` over
that vector, joined with its low bits; every 256th one's position is stored, so
a look-up reads one short stretch and no table of 64-bit offsets is needed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.batches import SLICE_BYTES, slices
from wakeline.llm.files import Written, new_folder, opened
from wakeline.llm.ordering import RANGE, in_ranges, range_bounds, shuffle_width, with_range
from wakeline.llm.tokens import LOOKED_UP_BYTES, encoder, tokenizer_path
from wakeline.session import cut_lineage

END_ID = 2
SAMPLE = 256
MAGIC = b"WKLNIDS1"
FOOTER = "<QQQqQQQ8s"  # documents, keys, tokens, smallest key, id width, bytes of boundaries, bytes of keys, magic
HEADER = "<QQQQ"  # values, low bits, words of low bits, words of high bits


class EliasFano:
    """Ascending non-negative integers in near-minimal space, with random access."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if n == 0:
            return cls(0, 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        top = int(v[-1])
        low_bits = max(0, (top // n).bit_length() - 1)
        bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = _words(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1, np.uint8)
        flags[ones] = 1
        return cls(n, low_bits, low, _words(np.packbits(flags, bitorder="little")), ones[::SAMPLE].astype(np.uint64))

    def to_bytes(self) -> bytes:
        head = struct.pack(HEADER, self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, lows, highs = struct.unpack_from(HEADER, data)
        a = struct.calcsize(HEADER)
        b = a + 8 * lows
        rest = np.frombuffer(data, np.uint64, offset=b)
        return cls(n, low_bits, np.frombuffer(data, np.uint64, lows, a), rest[:highs], rest[highs:])

    def select(self, i: int) -> int:
        """Position of the i-th one (from 0) of the high bits."""
        at = int(self.samples[i // SAMPLE])
        left, word = i % SAMPLE, at // 64
        if not left:
            return at
        bits = int(self.high[word]) >> (at % 64) << (at % 64)
        left += 1
        while (ones := bits.bit_count()) < left:
            left -= ones
            word += 1
            bits = int(self.high[word])
        for _ in range(left - 1):
            bits &= bits - 1
        return 64 * word + (bits & -bits).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        low = 0
        if self.low_bits:
            at = i * self.low_bits
            word, shift = divmod(at, 64)
            low = int(self.low[word]) >> shift
            if shift + self.low_bits > 64:
                low |= int(self.low[word + 1]) << (64 - shift)
            low &= (1 << self.low_bits) - 1
        return (self.select(i) - i) << self.low_bits | low

    def values(self, start: int, stop: int) -> np.ndarray:
        """Values start .. stop - 1, from one stretch of the code."""
        if stop <= start:
            return np.zeros(0, np.int64)
        first, last = self.select(start), self.select(stop - 1)
        stretch = np.unpackbits(self.high[first // 64 : last // 64 + 1].view(np.uint8), bitorder="little")
        base = first // 64 * 64
        ones = np.flatnonzero(stretch[first - base : last - base + 1]) + first
        out = (ones - np.arange(start, stop)) << self.low_bits
        if self.low_bits:
            a, b = start * self.low_bits, stop * self.low_bits
            bits = np.unpackbits(self.low[a // 64 : (b + 63) // 64].view(np.uint8), bitorder="little")[a % 64 : a % 64 + b - a]
            out |= bits.reshape(-1, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out


def _words(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(-len(data) % 8, np.uint8)]).view(np.uint64)


def _file_name(part: int) -> str:
    return f"ids-{part:06d}.bin"


class _Shard:
    """One file under way: ids are streamed out; two integers a document are kept."""

    def __init__(self, folder: str, part: int, width: int):
        self.part, self.width, self.out = part, width, Written(folder, _file_name(part))
        self.keys: list[int] = []
        self.lengths: list[np.ndarray] = []
        self.documents = 0

    def add(self, keys: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.keys += [k for k in keys if k is not None]
        self.lengths.append(lengths)
        self.documents += len(keys)
        self.out.write(ids.astype(f"<u{self.width}").tobytes())

    def close(self) -> tuple[int, int, int]:
        upto = np.concatenate([[0], np.cumsum(np.concatenate(self.lengths))])
        least = self.keys[0] if self.keys else 0
        bounds = EliasFano.of(upto).to_bytes()
        keys = EliasFano.of(np.array(self.keys, np.int64) - least).to_bytes()
        self.out.write(bounds + keys + struct.pack(FOOTER, self.documents, len(self.keys), int(upto[-1]), least, self.width, len(bounds), len(keys), MAGIC))
        self.out.close()
        return self.part, self.documents, int(upto[-1])


def write_token_files(docs: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the ids of every text to files of `folder`, and return the manifest (part, n_docs, n_tokens).

    Files follow each other in ascending key order, and so do the documents of
    a file. Rows without a key come last; rows of one key are in the order of
    their texts. A null text is empty and has only the end id.
    """
    path = tokenizer or tokenizer_path()
    ranges = shuffle_width(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = in_ranges(with_range(rows, "key", range_bounds(rows, "key", ranges)), ranges, F.col("key").asc_nulls_last(), "text")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, done = encoder(path), None, []
        width = 2 if max(words.size, end_id + 1) <= 1 << 16 else 4
        for batch in slices(batches, "text", LOOKED_UP_BYTES):
            parts = batch.column(RANGE).to_numpy()
            keys, (ids, lengths) = batch.column("key").to_pylist(), words.encode(batch.column("text"))
            ends = np.cumsum(lengths)
            ids, lengths = np.insert(ids, ends, end_id), lengths + 1
            ends = np.concatenate([[0], np.cumsum(lengths)])
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                if shard is None or shard.part != parts[a]:
                    done += [shard.close()] if shard else []
                    shard = _Shard(folder, int(parts[a]), width)
                shard.add(keys[a:b], ids[ends[a] : ends[b]], lengths[a:b])
        done += [shard.close()] if shard else []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.int32(), pa.int64(), pa.int64()))], ["part", "n_docs", "n_tokens"])

    return cut_lineage(placed.mapInArrow(write, "part int, n_docs long, n_tokens long"))


class TokenFile:
    """Random access to one file."""

    def __init__(self, folder: str, part: int):
        system, root = opened(folder)
        self._file = system.open_input_file(f"{root}/{_file_name(part)}")
        size, footer = self._file.size(), struct.calcsize(FOOTER)
        self.documents, self.keyed, self.tokens, self.least, self.width, bounds, keys, magic = struct.unpack(FOOTER, self._file.read_at(footer, size - footer))
        if magic != MAGIC:
            raise ValueError(f"{_file_name(part)} is no token file")
        code = self._file.read_at(bounds + keys, self.tokens * self.width)
        self.bounds, self._keys = EliasFano.from_bytes(code[:bounds]), EliasFano.from_bytes(code[bounds:])

    def keys(self, start: int, stop: int) -> list[int | None]:
        known = (self._keys.values(start, min(stop, self.keyed)) + self.least).tolist() if start < self.keyed else []
        return known + [None] * (stop - start - len(known))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from token `start` to before token `stop`."""
        return np.frombuffer(self._file.read_at((stop - start) * self.width, start * self.width), f"<u{self.width}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds[i], self.bounds[i + 1])


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the files: key, start (ids before it in all files), n_tokens, ids_crc32.

    The manifest has a row for each file, at most one for each shuffle
    partition; the driver adds up their sizes. A task reads the ids of a file
    in stretches of bounded size.
    """
    files = sorted(map(tuple, manifest.select("part", "n_docs", "n_tokens").collect()))
    base = dict(zip([f[0] for f in files], np.concatenate([[0], np.cumsum([f[2] for f in files])])[:-1].tolist() if files else []))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("part").to_pylist():
                yield from _documents(TokenFile(folder, part), base[part])

    parts = manifest.select("part").repartitionById(max([0, *base]) + 1, F.col("part"))
    return parts.mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long")


def _documents(file: TokenFile, base: int) -> Iterator[pa.RecordBatch]:
    at = 0
    while at < file.documents:
        ends = file.bounds.values(at, min(at + 4096, file.documents) + 1)
        take = max(1, int(np.searchsorted(ends, ends[0] + SLICE_BYTES, side="right")) - 1)
        ends = ends[: take + 1]
        data = memoryview(file.ids(int(ends[0]), int(ends[-1])).tobytes())
        here = ((ends - ends[0]) * 4).tolist()
        crc = [zlib.crc32(data[a:b]) for a, b in zip(here, here[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(file.keys(at, at + take), pa.int64()), pa.array(ends[:-1] + base, pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())],
            ["key", "start", "n_tokens", "ids_crc32"],
        )
        at += take


def token_files(docs: DataFrame, *, folder: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write all texts as token files and read them back: doc_id, start, n_tokens, ids_crc32.

    An empty table gives an empty result and no file.
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer=tokenizer), folder).withColumnRenamed("key", "doc_id")
