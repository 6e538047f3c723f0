"""Token ids in directly addressable codes, and their readers.

An id is split into bytes. Level 0 holds the lowest byte of every id, level 1 the next byte of those
ids that have more, and so on. A continuation bitmap beside each level but the last says which ids
go on; a rank directory with one count for each 512 bits and a popcount inside the block give the
place in the next level, so any token is read without decoding a block.

Texts are encoded where they are read; what is shuffled are the ids. Documents are dealt by range of
their id, whose bounds come of a pass over ids alone, and each partition writes segments of whole documents in ascending order. A segment is one
row of a Parquet table, its levels as uncompressed binary columns in a page of their own: Spark's
committer makes it whole or absent, whatever executor is lost, in any store that Spark can write.
Beside the segments lies a directory that says at which token each begins. `tokens` looks a stretch
up there, reads the pages of the segments that hold it (about 130 KB each) and nothing else, and
takes the ids out of the levels without decoding them.

Defined cases: a null text is empty and holds the end id only; null ids come first; rows with one id
follow each other in the order of their texts' hashes, and are split over partitions as any others;
a document is never split, so that of a longer one is a longer segment; ids of more than 16 bits are
stored as well; an empty table gives an empty store.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .bytesops import mix, slices
from .common import arrow_map, materialise, scratch, shuffle_partitions, text_hash, work_dir
from .wordbpe import WordBpe

SCHEMA = "part int, seq int, part_offset long, n_tokens long, doc_ids binary, doc_known binary, doc_sizes binary, levels array<binary>, more array<binary>, ranks array<binary>"
_BLOCK = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Dac:
    """One code: levels[k] bytes, more[k] bitmap (least bit first) and ranks[k] directory."""

    def __init__(self, levels: list[np.ndarray], more: list[np.ndarray], ranks: list[np.ndarray]):
        self.levels, self.more, self.ranks = levels, more, ranks

    @classmethod
    def encode(cls, ids: np.ndarray) -> Dac:
        levels, more, ranks = [], [], []
        ids = ids.astype(np.uint32)
        while True:
            levels.append((ids & 255).astype(np.uint8))
            on = ids > 255
            if not on.any():
                return cls(levels, more, ranks)
            more.append(np.packbits(on, bitorder="little"))
            blocks = np.add.reduceat(on, np.arange(0, len(on), _BLOCK), dtype=np.int64)
            ranks.append((np.cumsum(blocks) - blocks).astype(np.uint32))
            ids = ids[on] >> 8

    def decode(self) -> np.ndarray:
        """All ids."""
        out = np.zeros(0, np.uint32)
        for k in reversed(range(len(self.levels))):
            here = self.levels[k].astype(np.uint32)
            if k < len(self.more):
                here[np.flatnonzero(np.unpackbits(self.more[k], count=len(here), bitorder="little"))] |= out << 8
            out = here
        return out

    def take(self, at: np.ndarray) -> np.ndarray:
        """The ids at some places, found by rank: nothing else is decoded."""
        out = np.zeros(len(at), np.uint32)
        rows, at = np.arange(len(at)), np.asarray(at, np.int64)
        for k, level in enumerate(self.levels):
            out[rows] |= level[at].astype(np.uint32) << np.uint32(8 * k)
            if k == len(self.more) or not len(at):
                break
            bits = self.more[k]
            on = (bits[at >> 3] >> (at & 7) & 1).astype(bool)
            rows, at = rows[on], at[on]
            at = self._rank(k, at)
        return out

    def _rank(self, k: int, at: np.ndarray) -> np.ndarray:
        """How many bits of bitmap k are set before each place: the block's count and those inside the block."""
        out = np.empty(len(at), np.int64)
        for lo in range(0, len(at), 4096):
            own = at[lo : lo + 4096]
            block = own // _BLOCK
            byte = (block * _BLOCK >> 3)[:, None] + np.arange(_BLOCK >> 3)
            inside = _ONES[self.more[k][np.minimum(byte, len(self.more[k]) - 1)]].astype(np.int64)
            inside[byte >= (own >> 3)[:, None]] = 0
            partial = _ONES[self.more[k][own >> 3] & ((1 << (own & 7)) - 1).astype(np.uint8)]
            out[lo : lo + 4096] = self.ranks[k][block].astype(np.int64) + inside.sum(axis=1) + partial
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.take(np.array([i]))[0])


def encode_rows(column: pa.Array, bpe: WordBpe, end_id: int, long_bytes: int = 1 << 18, overlap: int = 1024) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, ids of these rows with their end ids, ids of each row)."""
    for lo, hi, data, offsets in slices(column):
        raw = data.tobytes()
        if b"<|" in raw or len(data) > long_bytes:
            for k in range(lo, hi):
                text = raw[offsets[k - lo] : offsets[k - lo + 1]]
                parts = bpe.spliced(text.decode(), long_bytes, overlap) if len(text) > long_bytes else [np.array(bpe.whole(text.decode()), np.int64)]
                ids = np.concatenate([*parts, [end_id]]).astype(bpe.dtype)
                yield k, k + 1, ids, np.array([len(ids)])
            continue
        starts, ends = bpe.units(data, offsets)
        entries = bpe.entries(data, starts, ends)
        sizes = bpe.table.size[entries].astype(np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]
        counts = np.diff(at) + 1
        ids = np.full(int(counts.sum()), end_id, bpe.dtype)
        body = np.ones(len(ids), bool)
        body[np.cumsum(counts) - 1] = False
        ids[body] = bpe.table.gather(entries)
        yield lo, hi, ids, counts


def range_bounds(docs: DataFrame, n: int) -> list[tuple]:
    """The greatest key (known, doc_id, tie, salt) of each of at most n ranges of about as many rows, but the last.

    The salt is a random number: rows that agree in id and text, however many, fall in as many
    ranges as their share asks for.
    """
    keys = docs.select(F.col("doc_id").cast("long"), text_hash(F.col("text")).alias("tie"), F.rand(7).alias("salt"))
    order = ["doc_id", "tie", "salt"]
    dealt = materialise(keys.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "token-keys")
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tie", "salt")
    rows = dealt.groupBy("part").agg(F.max(key).alias("k")).orderBy("part").collect()  # n rows
    return [tuple(r.k) for r in rows[:-1]]


def encoded(docs: DataFrame, vocab: str, end_id: int, bounds: list[tuple]) -> DataFrame:
    """part (the range), doc_id, tie (hash of the text), row (a number of its own), wide and ids (little-endian, 32 bits if wide, else 16) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, row, bounds = WordBpe.load(vocab), TaskContext.get().partitionId() << 33, sent.value
        wide = bpe.dtype == np.uint32
        for batch in batches:
            doc_ids, ties = batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist()
            for lo, hi, ids, counts in encode_rows(batch.column("text"), bpe, end_id):
                raw, ends = memoryview(ids.astype("<u4" if wide else "<u2").tobytes()), np.cumsum(counts) * (4 if wide else 2)
                own = [bytes(raw[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                salts = mix(np.arange(row, row + hi - lo).astype(np.uint64)) / 2.0**64
                parts = [bisect_left(bounds, (i is not None, i or 0, t, s)) for i, t, s in zip(doc_ids[lo:hi], ties[lo:hi], salts.tolist(), strict=True)]
                cols = [pa.array(parts, pa.int32()), batch.column("doc_id").slice(lo, hi - lo), batch.column("tie").slice(lo, hi - lo), pa.array(np.arange(row, row + hi - lo)), pa.array([wide] * (hi - lo)), pa.array(own, pa.binary())]
                row += hi - lo
                yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "tie", "row", "wide", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), text_hash(F.col("text")).alias("tie"), F.col("text").cast("string"))
    return arrow_map(rows, run, "part int, doc_id long, tie long, row long, wide boolean, ids binary")


def write_store(docs: DataFrame, path: str, vocab: str, end_id: int = 1, segment_tokens: int = 1 << 16) -> None:
    """Encode every text, write segments of about `segment_tokens` ids to `path` and their directory beside it."""
    spark = docs.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, offset = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        n = 0

        def segment() -> pa.RecordBatch:
            nonlocal held, n, seq, offset
            code = Dac.encode(np.concatenate([x[2] for x in held]))
            sizes = np.array([len(x[2]) for x in held], "<i8")
            row = [part, seq, offset, n, np.array([x[0] for x in held], "<i8").tobytes(), np.array([x[1] for x in held], np.uint8).tobytes(), sizes.tobytes()]
            row += [[x.tobytes() for x in group] for group in (code.levels, code.more, code.ranks)]
            seq, offset, held, n = seq + 1, offset + n, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        binary = pa.binary()
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), binary, binary, binary, *[pa.list_(binary)] * 3]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for doc_id, wide, ids in zip(batch.column("doc_id").to_pylist(), batch.column("wide").to_pylist(), batch.column("ids"), strict=True):
                held.append((doc_id or 0, doc_id is not None, np.frombuffer(ids.as_buffer(), "<u4" if wide else "<u2")))
                n += len(held[-1][2])
                if n >= segment_tokens:
                    yield segment()
        if held:
            yield segment()

    n_parts = shuffle_partitions(spark)
    with scratch(spark):
        rows = encoded(docs, vocab, end_id, range_bounds(docs, n_parts))
    dealt = rows.repartitionById(n_parts, F.col("part")).sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "wide", "ids")
    out = arrow_map(dealt, pack, SCHEMA).write.option("compression", "none").option("parquet.page.row.count.limit", "1")
    out.parquet(path)
    table = spark.read.schema(SCHEMA).parquet(path).select("part", "seq", "part_offset", "n_tokens")
    # a row for each partition of the writer
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    earlier = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("base"))
    starts = table.join(F.broadcast(parts), "part").select("part", "seq", (F.col("base") + F.col("part_offset")).alias("start"), "n_tokens")
    starts.coalesce(max(1, shuffle_partitions(spark) // 8)).write.parquet(f"{path}-directory")


def open_segment(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, Dac]:
    """Document ids, whether each is known, ids of each document, and the code of a segment's row."""
    code = Dac([np.frombuffer(x, np.uint8) for x in row["levels"]], [np.frombuffer(x, np.uint8) for x in row["more"]], [np.frombuffer(x, np.uint32) for x in row["ranks"]])
    return np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_known"], np.uint8).astype(bool), np.frombuffer(row["doc_sizes"], "<i8"), code


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each stored document."""
    table = spark.read.schema(SCHEMA).parquet(path)
    parts = directory(spark, path).where("seq = 0").select("part", F.col("start").alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                doc_ids, known, sizes, code = open_segment(row)
                raw = memoryview(code.decode().astype("<u4").tobytes())
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                starts = ends - sizes + row["base"] + row["part_offset"]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=~known), pa.array(starts), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a row for each partition of the writer
    return arrow_map(table.join(F.broadcast(parts), "part"), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, start and n_tokens of each segment."""
    return spark.read.schema("part int, seq int, start long, n_tokens long").parquet(f"{path}-directory")


def tokens(spark: SparkSession, path: str, start: int, n: int) -> np.ndarray:
    """The ids from place `start` on, `n` or as many as there are: only the segments that hold them are read."""
    wanted = directory(spark, path).where((F.col("start") < start + n) & (F.col("start") + F.col("n_tokens") > start)).orderBy("start").collect()
    at = {(r.part, r.seq): r for r in wanted}
    if not at:
        return np.zeros(0, np.uint32)
    either = lambda xs: reduce(or_, xs)
    runs = either([(F.col("part") == p) & F.col("seq").between(min(s for q, s in at if q == p), max(s for q, s in at if q == p)) for p in sorted({p for p, _ in at})])
    found = {}
    for row in spark.read.schema(SCHEMA).parquet(path).where(runs).toLocalIterator():
        own = at[row["part"], row["seq"]]
        code = open_segment(row.asDict())[3]
        found[own.start] = code.take(np.arange(max(0, start - own.start), min(own.n_tokens, start + n - own.start)))
    return np.concatenate([found[k] for k in sorted(found)])


def store_and_read(docs: DataFrame, vocab: str) -> DataFrame:
    """Write all documents to a new store in the shared folder and read it back."""
    path = work_dir(docs.sparkSession, "token-store")
    write_store(docs, path, vocab)
    return read_store(docs.sparkSession, path)
