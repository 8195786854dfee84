"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and decoding by joining the pieces of ids."""
import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"
#: Words whose encoding a task remembers, and the longest of them; beyond, the memory is emptied and fills anew.
MEMO, MEMO_CHARS = 300_000, 64
#: Above so many bytes a word is merged with a heap instead of scanning all pairs each time.
LONG = 48

# White space of the Unicode property of that name, which the words' pattern means by \\s, and the
# letters and digits within Latin-1.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN_SPACE = r"\t-\r \x85\xa0"
LATIN_LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
LATIN_NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"


def split_pattern(pattern: str, space: str = SPACE, letter: str = r"\p{L}", number: str = r"\p{N}") -> str:
    """The words' pattern with its classes written out."""
    for old, new in ((r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]"), (r"\p{L}", letter if letter.startswith("\\p") else f"[{letter}]"), (r"\p{N}", number if number.startswith("\\p") else f"[{number}]"), (r"\S", f"[^{space}]"), (r"\s", f"[{space}]")):
        pattern = pattern.replace(old, new)
    return pattern


def load_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 bytes and rank. The driver reads the file; its size is the vocabulary's, so it travels with the task."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def fold_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """ids of one word: the adjacent pair of lowest rank, the leftmost of equals, merges until none has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > LONG:
        return _fold_with_heap(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    none = len(ranks)
    costs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while costs:
        best = min(costs)
        if best == none:
            break
        i = costs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i:
            costs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(costs):
            costs[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _fold_with_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end = list(range(1, n + 1))  # the part that starts at i ends there; 0 once merged away
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or end[j] != k:
            continue
        end[i], end[j] = k, 0
        if k < n:
            before[k] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Words(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers, folded when first met; what it remembers is bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        ids = fold_merges(word.encode("utf-8", "surrogatepass"), self.ranks)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = packed
        return packed


class Codec:
    """Encodes and decodes texts. Made once a task from the ranks and the words' pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.words = Words(ranks)
        self.latin = re.compile(split_pattern(pattern, LATIN_SPACE, LATIN_LETTER, LATIN_NUMBER)).findall
        self.any = regex.compile(split_pattern(pattern)).findall
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, r in ranks.items():
            self.pieces[r] = piece

    def encode(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit integers. Texts within Latin-1 take the standard library's faster pattern."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return b"".join(map(self.words.__getitem__, self.any(text)))
        return b"".join(map(self.words.__getitem__, self.latin(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


def _map(df: DataFrame, ranks_path: str, schema: str, make) -> DataFrame:
    ranks = load_ranks(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks)
        for batch in batches:
            yield from make(codec, batch)

    return df.mapInArrow(run, schema)


def encode_documents(documents: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids (array<int>) of every row; null text is empty and gives no ids. Texts of any length are encoded whole."""

    def make(codec, batch):
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            texts = part.column(1).to_pylist()
            ids = [codec.encode(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([struct.unpack(f"<{len(x) // 4}i", x) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _map(documents.select("doc_id", "text"), ranks_path, "doc_id long, ids array<int>", make)


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, text_bytes: the bytes that the ids stand for. Null ids give null bytes."""

    def make(codec, batch):
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            out = [None if x is None else b"".join(map(codec.pieces.__getitem__, x)) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["doc_id", "text_bytes"])

    return _map(encoded.select("doc_id", "ids"), ranks_path, "doc_id long, text_bytes binary", make)


def round_trip(documents: DataFrame, ranks_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if asked for) of every row: encoded, then decoded from the ids.

    Null text is empty; repeated rows repeat their result; an empty table gives no rows. Columns beside doc_id and text
    are not read. One pass over the table, no shuffle; a task's memory is its batch and a bounded store of words.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def make(codec, batch):
        step = 256 if with_ids else batch.num_rows
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            n, one, two, lists = [], [], [], []
            for t in part.column(1):
                ids = codec.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                one.append(hashlib.sha256(ids).hexdigest())
                two.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(np.frombuffer(ids, "<i4"))
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return _map(df, ranks_path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, make)
