"""Exact duplicates: polynomial fingerprints composed from blocks, and equal fingerprints compared chunk by chunk."""
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.session import materialize

#: A text is hashed modulo this prime in four lanes, one for each base. Any would do.
PRIME, BASES = 2**31 - 1, (1_103_515_245, 1_664_525_013, 69_069_691, 214_013_401)
#: Bytes hashed as one row of a matrix product: 255 * PRIME * BLOCK is below 2**53, so that doubles are exact.
BLOCK = 256
#: Bytes of a text that are compared at a time.
CHUNK = 32 << 10
#: The fingerprint: four lanes in two longs, and the length in bytes.
KEY = ["h0", "h1", "n_bytes"]


def combine(left: tuple[int, ...], right: tuple[int, ...], right_bytes: int, bases=BASES, prime: int = PRIME) -> tuple[int, ...]:
    """The hash of two texts in a row from their hashes: the left one is shifted by the right one's length."""
    return tuple((a * pow(x, right_bytes, prime) + b) % prime for a, b, x in zip(left, right, bases, strict=True))


class Fingerprints:
    """Hashes of many texts that stand in one buffer: all blocks at once, then each text's blocks by length-shifted sums."""

    def __init__(self, prime: int = PRIME, bases: tuple[int, ...] = BASES):
        self.prime, self.bases = prime, bases
        self.inner = np.array([[pow(x, BLOCK - 1 - i, prime) for x in bases] for i in range(BLOCK)], float)
        self.shifts = np.ones((1, len(bases)), np.int64)

    def _shifts(self, n: int) -> np.ndarray:
        """Powers of the bases by which the 0th to n-1st block from a text's end are shifted."""
        while len(self.shifts) < n:
            step = np.array([pow(x, BLOCK * len(self.shifts), self.prime) for x in self.bases], np.int64)
            self.shifts = np.vstack([self.shifts, self.shifts * step % self.prime])
        return self.shifts

    def of(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        """One row of lanes for each text data[offsets[i]:offsets[i+1]]; zeros for an empty one.

        A text is laid out to end at the end of a block; zeros in front leave its polynomial as it is, and the
        length, which belongs to the fingerprint, tells such texts apart.
        """
        lengths = np.diff(offsets)
        blocks = -(-lengths // BLOCK)
        ends = np.cumsum(blocks)
        lanes = np.zeros((len(lengths), len(self.bases)), np.int64)
        src, at = np.frombuffer(data, np.uint8), 0
        while at < len(lengths):  # about 4 MB at a time, one text at least
            start = ends[at] - blocks[at]
            to = max(at + 1, int(np.searchsorted(ends, start + (4 << 20) // BLOCK, "right")))
            laid = np.zeros(int(ends[to - 1] - start) * BLOCK, np.uint8)
            for i in range(at, to):
                end = int(ends[i] - start) * BLOCK
                laid[end - lengths[i] : end] = src[offsets[i] : offsets[i + 1]]
            laid = laid.reshape(-1, BLOCK)
            hashes = np.vstack([(laid[k : k + 16384].astype(float) @ self.inner).astype(np.int64) % self.prime for k in range(0, len(laid), 16384)] or [lanes[:0]])
            some = np.flatnonzero(blocks[at:to]) + at
            if len(some):
                behind = np.repeat(ends[some], blocks[some]) - 1 - start - np.arange(len(hashes))
                hashes = hashes * self._shifts(int(blocks[some].max()))[behind] % self.prime
                lanes[some] = np.add.reduceat(hashes, (ends[some] - blocks[some] - start).astype(np.int64), axis=0) % self.prime
            at = to
        return lanes


def _normalised(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The texts' bytes in a row with A-Z in lower case, and where each begins and the last ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = b"" if data is None else data[int(offsets[0]) : int(offsets[-1])].to_pybytes()
    return data.lower(), offsets - offsets[0]


def _keys(lanes: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
    return [pa.array(lanes[:, 0] << 32 | lanes[:, 1]), pa.array(lanes[:, 2] << 32 | lanes[:, 3]), pa.array(lengths, pa.int64())]


def fingerprints(documents: DataFrame, prime: int = PRIME) -> DataFrame:
    """doc_id, h0, h1, n_bytes, sha256 (binary) of every row's normalised text; a null text is empty. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Fingerprints(prime)
        for batch in batches:
            data, offsets = _normalised(batch.column(1))
            view = memoryview(data)
            digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_keys(hashes.of(data, offsets), np.diff(offsets)), pa.array(digests, pa.binary())], ["doc_id", *KEY, "sha256"])

    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return df.mapInArrow(run, "doc_id long, h0 long, h1 long, n_bytes long, sha256 binary")


def text_chunks(documents: DataFrame, prime: int = PRIME, chunk: int = CHUNK) -> DataFrame:
    """row, doc_id, h0, h1, n_bytes, sha256, no, chunk: normalised texts in pieces of `chunk` bytes, each with its text's fingerprint. An empty text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Fingerprints(prime)
        for batch in batches:
            data, offsets = _normalised(batch.column(2))
            lengths = np.diff(offsets)
            view = memoryview(data)
            digests = pa.array([hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets, offsets[1:])], pa.binary())
            pieces = -(-lengths // chunk)
            text = np.repeat(np.arange(len(lengths)), pieces)
            no = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            cuts = np.append(offsets[text] + no * chunk, len(data)).astype(np.int64)
            chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(text), [None, pa.py_buffer(cuts), pa.py_buffer(data)]).cast(pa.binary())
            take = pa.array(text)
            columns = [batch.column(0), batch.column(1), *_keys(hashes.of(data, offsets), lengths), digests]
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in columns), pa.array(no, pa.int64()), chunks], ["row", "doc_id", *KEY, "sha256", "no", "chunk"])

    df = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return df.mapInArrow(run, "row long, doc_id long, h0 long, h1 long, n_bytes long, sha256 binary, no long, chunk binary")


def _collided(documents: DataFrame, prime: int, chunk: int) -> DataFrame:
    """The fingerprints whose texts differ somewhere.

    Chunks meet those with the same fingerprint and number; equal ones fold within each task before they are
    exchanged, so a group of copies crosses once a task however large it is. This is the one exchange of texts; to
    leave out texts whose fingerprint is alone would take a join that exchanges as much.
    """
    forms = text_chunks(documents, prime, chunk).groupBy(*KEY, "no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    return forms.groupBy(*KEY, "no").agg(F.count(F.lit(1)).alias("forms")).filter("forms > 1").select(*KEY).distinct()


def _told_apart(documents: DataFrame, collided: DataFrame, prime: int, chunk: int) -> DataFrame:
    """doc_id, h0, h1, n_bytes, sha256, forms, n of the rows with collided fingerprints: forms says which form each chunk of the text has."""
    chunks = materialize(text_chunks(documents, prime, chunk).join(collided, KEY, "left_semi"), "collided-chunks")
    kinds = chunks.groupBy(*KEY, "no", "chunk").agg(F.min("row").alias("form"))
    each = chunks.join(kinds, [*KEY, "no", "chunk"]).groupBy("row", "doc_id", *KEY, "sha256").agg(F.sort_array(F.collect_list(F.struct("no", "form"))).alias("forms"))
    return each.withColumn("forms", F.to_json("forms")).groupBy("doc_id", *KEY, "sha256", "forms").agg(F.count(F.lit(1)).alias("n"))


def exact_classes(documents: DataFrame, prime: int = PRIME, chunk: int = CHUNK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row: the class of texts equal but for the case of A-Z.

    The row with the largest doc_id stays; of rows that share that doc_id and text one stays. A null text is empty, and
    empty texts are equal. A null doc_id is smaller than any other; where all of a class are null, keep_id is, too. An
    empty table gives no rows; columns beside doc_id and text are not read. Texts are equal by their bytes: equal
    fingerprints are compared chunk by chunk, and if any of them hold texts that differ, these are told apart.
    """
    rows = fingerprints(documents, prime).groupBy("doc_id", *KEY, "sha256").agg(F.count(F.lit(1)).alias("n")).withColumn("forms", F.lit(""))
    rows = materialize(rows, "fingerprints")
    groups = lambda t: t.groupBy(*KEY, "forms").agg(F.max("doc_id").alias("_keep"), F.sum("n").alias("_size")).filter("_size > 1")
    collided = materialize(_collided(documents, prime, chunk), "collided", release=True)
    if not collided.isEmpty():
        rows = materialize(rows.join(collided, KEY, "left_anti").unionByName(_told_apart(documents, collided, prime, chunk)), "fingerprints")
    repeated = materialize(groups(rows), "repeated")  # so that both sides of the join are plain exchanges, which Spark splits for a hot class
    out = rows.join(repeated, [*KEY, "forms"], "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"), ((F.col("_copy") == 1) & F.col("doc_id").eqNullSafe(keep)).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"))


ORACLE = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
