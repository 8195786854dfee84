"""Where the tokens of two tokenizers end together: relational over distinct units of text, and looked up by documents in blocks."""
import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.session import materialize, scratch

#: Between a sign that is no white space and a space both tokenizers always cut: the byte-level pattern has no word with
#: a space behind another sign, the pieces none with one behind a letter. What lies between such cuts is a unit, whose
#: tokens are the same wherever it stands. Each begins with a space, which its name leaves out. Signs beyond these
#: ranges, which all readings of Unicode take for no white space, merely make longer units.
SOLID = "!-~\u00a1-\u167f\u2010-\u2027\u2030-\u205e\u2070-\u2fff\u3001-\ud7ff"
CUT = re.compile(f"(?<=[{SOLID}])(?= )")
UNCUT = re.compile(f"[^{SOLID}] ")
#: The sign that the pieces have for a space: a text that holds it can't be given back, and has no tokens.
META = "\u2581"
#: Bytes of text in a block, whose documents and distinct units meet in one task.
BLOCK_BYTES = 16 << 20
#: Blocks are read in so many turns, so that a part of the texts only is on its way between tasks at a time.
TURNS = 3
#: Signs of a run of units that are encoded as one text.
RUN = 4000
ENDS_SOLID = re.compile(f"[{SOLID}]\\Z").search
#: Bytes of text that are cut at a time, and units whose groups are joined at a time.
PART_BYTES, UNITS = 4 << 20, 1 << 18
#: What is summed for a document over its units.
SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Tokenizers:
    """A byte-level BPE (A) and a piece BPE that adds a space in front (B), for units; made once a task from the files' bytes."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        vocabulary = json.loads(a)["model"]["vocab"]
        signs = _byte_signs()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(signs[c] for c in entry if c in signs)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        if any(META in self.b.id_to_piece(i).lstrip(META) for i in range(self.b.get_piece_size())):
            raise ValueError("a piece reaches over a space: units don't stand for themselves")
        self.space = self.b.piece_to_id(META)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(META, " ").encode()

    def _ends(self, flat: np.ndarray, sizes: np.ndarray, table: list[bytes], data: bytes) -> np.ndarray:
        """How many of the tokens in a row stand up to each unit's end."""
        if b"".join(map(table.__getitem__, flat.tolist())) != data:
            raise ValueError("tokens don't give back their text")
        ends = np.cumsum(np.fromiter(map(len, map(table.__getitem__, flat.tolist())), np.int64, len(flat)))
        at = np.searchsorted(ends, np.cumsum(sizes))
        if len(sizes) and not np.array_equal(ends[at], np.cumsum(sizes)):
            raise ValueError("a token reaches over a unit's end")
        return at + 1

    def units(self, names: list[str]) -> tuple[np.ndarray, ...]:
        """For each unit how many tokens A and B make of it; and the ids of all in a row, each unit's of A then of B, with their lengths in bytes.

        Units are encoded in runs, where each stands before the next as it does in a text.
        """
        runs, run, held = [], [], 0
        for name in names:
            run.append(name)
            held += len(name) + 1
            if held > RUN or not name or not ENDS_SOLID(name):
                runs.append(" ".join(run))
                run, held = [], 0
        runs += [" ".join(run)] if run else []
        sizes = np.array([len(name.encode()) + 1 for name in names], np.int64)
        data = "".join(f" {r}" for r in runs).encode()
        a = [i for e in self.a.encode_batch([f" {r}" for r in runs], add_special_tokens=False) for i in e.ids]
        b = [i for r, ids in zip(runs, self.b.encode(runs, num_threads=1), strict=True) for i in (ids if r else [self.space])]
        flat = [np.array(x, np.int64) for x in (a, b)]
        counts = [np.diff(self._ends(x, sizes, table, data), prepend=0) for x, table in zip(flat, (self.a_bytes, self.b_bytes), strict=True)]
        starts = np.cumsum(counts[0] + counts[1]) - counts[0] - counts[1]
        ids, lens = np.zeros(len(a) + len(b), np.int32), np.zeros(len(a) + len(b), np.int32)
        for x, n, first, table in zip(flat, counts, (starts, starts + counts[0]), (self.a_bytes, self.b_bytes), strict=True):
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(x))
            ids[at], lens[at] = x, np.fromiter(map(len, map(table.__getitem__, x.tolist())), np.int32, len(x))
        return counts[0], counts[1], ids, lens


def _byte_signs() -> dict[str, int]:
    """The sign that byte-level vocabularies have for each byte: printable ones stand for themselves, others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def has_tokens(text: Column) -> Column:
    return F.coalesce((text != "") & ~text.contains(META), F.lit(False))


def cut_units(text: str) -> list[str]:
    """The names of the units of a text, the space in front of it included."""
    return [u[1:] for u in CUT.split(" " + text)]


def units_of(texts: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """Which texts, their units in a row, and how many each has; about `most` bytes of text at a time, one text at least.

    Where every space follows a solid sign the words are the units, and are cut at once; other texts are one by one.
    """
    plain = pc.invert(pc.or_(pc.starts_with(texts, " "), pc.match_substring_regex(texts, UNCUT.pattern))).to_numpy(zero_copy_only=False)
    sizes = pc.binary_length(texts).to_numpy()
    for kind in (True, False):
        which = np.flatnonzero(plain == kind)
        at = 0
        while at < len(which):
            to = at + max(1, int(np.searchsorted(np.cumsum(sizes[which[at:]]), most, "right")))
            some = texts.take(pa.array(which[at:to]))
            lists = pc.split_pattern(some, " ") if kind else pa.array(map(cut_units, some.to_pylist()), pa.list_(pa.string()))
            yield which[at:to], lists.flatten(), pc.list_value_length(lists).to_numpy()
            at = to


def _tokenised(texts: pa.ChunkedArray) -> pa.Array:
    """Positions of the texts that have tokens."""
    return pa.array(np.flatnonzero(pc.fill_null(pc.and_(pc.greater(pc.binary_length(texts), 0), pc.invert(pc.match_substring(texts, META))), False).to_numpy()))


def block_units(documents: DataFrame) -> DataFrame:
    """block, unit, n from doc_id, text, block: the distinct units of each block, counted where its documents are."""

    def run(docs: pa.Table) -> pa.Table:
        counted = []
        for _, units, _ in units_of(docs.column("text").combine_chunks()):
            counts = pc.value_counts(units)
            counted.append(pa.table({"unit": counts.field(0), "n": counts.field(1)}))
        all_ = pa.concat_tables(counted).group_by("unit").aggregate([("n", "sum")])
        del counted
        pa.default_memory_pool().release_unused()
        return pa.table({"block": pa.repeat(docs.column("block")[0], all_.num_rows), "unit": all_.column("unit"), "n": all_.column("n_sum")})

    return documents.filter(has_tokens(F.col("text"))).select("block", "text").groupBy("block").applyInArrow(run, "block int, unit string, n long")


def unit_tokens(units: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """unit, n, n_a, pos, id, length: both tokenizers' tokens of distinct units, A's before B's, a row each. Units are exchanged whole, by name."""
    names = ["unit", "n", "n_a", "ids", "lens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers(a, b)
        for batch in batches:
            n_a, n_b, ids, lens = both.units(batch.column(0).to_pylist())
            offsets = pa.array(np.append(0, np.cumsum(n_a + n_b)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, lens.astype(np.int16))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_a.astype(np.int32)), *lists], names)

    t = units.select("unit", "n").mapInArrow(run, "unit string, n long, n_a int, ids array<int>, lens array<smallint>").repartition("unit")
    return t.select("unit", "n", "n_a", F.posexplode(F.arrays_zip("ids", "lens")).alias("pos", "t")).select("unit", "n", "n_a", "pos", F.col("t.ids").alias("id"), F.col("t.lens").alias("length"))


def aligned_tokens(tokens: DataFrame) -> DataFrame:
    """unit, n, end, side, id, group, b in order of unit, end and side, from unit_tokens.

    Running lengths give the byte where each token ends; sorted by that byte, a token of A and one of B that end
    together are neighbours, which is the equi-join on unit and end: b is then B's id. The running count of such cuts
    is a token's group. No token is empty, so a cut links one pair. What is hashed by unit needs no exchange for it.
    """
    t = tokens.select("unit", "n", "pos", "id", "length", (F.col("pos") >= F.col("n_a")).cast("int").alias("side"))
    t = t.withColumn("end", F.sum("length").over(Window.partitionBy("unit", "side").orderBy("pos"))).drop("length", "pos")
    w = Window.partitionBy("unit").orderBy("end", "side")
    met = F.when(F.lead("end").over(w) == F.col("end"), F.lead("id").over(w))
    t = t.withColumn("b", met).withColumn("own", F.coalesce(F.lag("end").over(w) == F.col("end"), F.lit(False)).cast("int"))
    before = F.coalesce(F.sum(F.col("b").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.select("unit", "n", "end", "side", "id", (before - F.col("own")).cast("int").alias("group"), "b").sortWithinPartitions("unit", "end", "side")


def aligned_units(tokens: DataFrame) -> DataFrame:
    """unit, n, n_a, groups, a, b (arrays: the pairs linked) of each unit, from aligned_tokens. A unit's rows are a task's, one behind the other."""
    schema = "unit string, n long, n_a int, groups string, a array<int>, b array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, said = None, {}
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([kept, rows]).combine_chunks() if kept is not None else rows
            unit = rows.column("unit").combine_chunks()
            new = np.flatnonzero(pc.not_equal(unit[1:], unit[:-1]).to_numpy(zero_copy_only=False)) + 1
            if len(new):  # the last unit may go on in the next batch
                yield from units(rows.slice(0, new[-1]), np.append(0, new[:-1]), said)
                rows = rows.slice(new[-1])
            kept = rows
        if kept is not None and kept.num_rows:
            yield from units(kept, np.array([0]), said)

    def units(rows: pa.Table, starts: np.ndarray, said: dict) -> Iterator[pa.RecordBatch]:
        col = lambda c: rows.column(c).to_numpy().astype(np.int64)
        side, ids, group = col("side"), col("id"), col("group")
        nth = np.zeros(len(side), np.int64)
        nth[starts[1:]] = 1
        nth = np.cumsum(nth)
        order = np.argsort((nth << 32 | group) << 1 | side, kind="stable")
        fresh, part, which = np.append(True, np.diff(nth[order]) != 0), np.append(True, np.diff(group[order]) != 0), np.append(True, np.diff(side[order]) != 0)
        mark = np.where(fresh, 0, np.where(part, 1, np.where(which, 2, 3)))
        pieces = [said.get(c) or said.setdefault(c, ("", ";", "|", ",")[c & 3] + str(c >> 2)) for c in (ids[order] << 2 | mark).tolist()]
        ends = np.append(starts[1:], len(side))
        text = ["".join(pieces[x:y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
        b = rows.column("b").combine_chunks()
        cut = b.is_valid().to_numpy(zero_copy_only=False)
        n_b, links = np.add.reduceat(side, starts), np.add.reduceat(cut.astype(np.int64), starts)
        offsets = pa.array(np.append(0, np.cumsum(links)).astype(np.int32))
        pairs = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (ids[cut], b.drop_null().to_numpy())]
        at = pa.array(starts)
        yield pa.RecordBatch.from_arrays(
            [rows.column("unit").combine_chunks().take(at), rows.column("n").combine_chunks().take(at), pa.array((ends - starts - n_b).astype(np.int32)), pa.array(text, pa.string()), *pairs],
            ["unit", "n", "n_a", "groups", "a", "b"])

    return tokens.select("unit", "n", "side", "id", "group", "b").mapInArrow(run, schema)


def linked_pairs(units: DataFrame, *columns: str) -> DataFrame:
    """A row for each pair that a unit links: columns of the unit, a, b."""
    return units.select(*columns, F.explode(F.arrays_zip("a", "b")).alias("l")).select(*columns, "l.a", "l.b")


def pair_counts(units: DataFrame) -> DataFrame:
    """a, b, count, best: how many links hold each pair in all documents, and whether that is the highest of its b (ties included).

    The highest counts are broadcast: they number as the ids of B's vocabulary at most.
    """
    pairs = materialize(linked_pairs(units, "n").groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    highest = pairs.groupBy("b").agg(F.max("count").alias("_most"))
    return pairs.join(F.broadcast(highest), "b").select("a", "b", "count", (F.col("count") == F.col("_most")).cast("int").alias("best"))


def _of_documents(documents: DataFrame, dictionary: DataFrame, with_groups: bool) -> DataFrame:
    names = ["doc_id", *SUMS, "groups_sha256", *["groups"] * with_groups]
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in SUMS), ("groups_sha256", pa.string()), *[("groups", pa.string())] * with_groups])

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        have, groups = known.column("unit").combine_chunks(), known.column("groups").combine_chunks()
        # a group ends in a link, and a mark stands between each two tokens
        n_groups = pc.add(pc.count_substring(groups, ";"), 1).to_numpy()
        n_b = pc.count_substring_regex(groups, "[;|,]").to_numpy() + 1 - known.column("n_a").to_numpy()
        columns = {"n_groups": n_groups, "n_links": n_groups, "n_b": n_b}
        numbers = np.stack([columns[c] if c in columns else known.column(c).to_numpy() for c in SUMS], 1).astype(np.int64)
        sums, digests, texts = np.zeros((docs.num_rows, len(SUMS)), np.int64), [""] * docs.num_rows, [""] * docs.num_rows
        column = docs.column("text")
        own = _tokenised(column)
        for which, units, counts in units_of(column.take(own).combine_chunks()) if len(own) else ():
            at, ends = pc.index_in(units, value_set=have), np.cumsum(counts)
            rows = own.to_numpy()[which]
            sums[rows] = np.add.reduceat(numbers[at.to_numpy()], ends - counts, axis=0)
            if len(at) <= UNITS or len(rows) > 1:
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), groups.take(at)), ";")
                said = [hashlib.sha256(memoryview(x.as_buffer())).hexdigest() for x in joined]
            else:  # one text of many units: piece by piece
                digest, joined = hashlib.sha256(), [""]
                for k in range(0, len(at), UNITS):
                    piece = ";" * (k > 0) + ";".join(groups.take(at[k : k + UNITS]).to_pylist())
                    digest.update(piece.encode())
                    joined[0] += piece * with_groups
                said = [digest.hexdigest()]
            for d, x, y in zip(rows.tolist(), said, joined, strict=True):
                digests[d], texts[d] = x, str(y) * with_groups
        more = [pa.array(texts, pa.string())] * with_groups
        del have, groups, numbers
        pa.default_memory_pool().release_unused()
        return pa.Table.from_arrays([docs.column("doc_id").combine_chunks(), *(pa.array(sums[:, i]) for i in range(len(SUMS))), pa.array(digests, pa.string()), *more], names).cast(schema)

    ddl = "doc_id long, " + ", ".join(f"{c} long" for c in SUMS) + ", groups_sha256 string" + ", groups string" * with_groups
    return documents.groupBy("block").cogroup(dictionary.groupBy("block")).applyInArrow(run, ddl)


def align(documents: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups, if asked for) of every row.

    A: the byte-level vocabulary in a_path, of space and text; B: the pieces in b_path, which add that space. Special
    tokens' strings are plain text. Null and empty texts, and those with U+2581, which B reads as a space, have no
    tokens: zeros and ''. Repeated rows count, and are returned, each time. An empty table gives no rows; columns
    beside doc_id and text are not read. Texts of any length are whole; what a task holds is a block of about
    block_bytes, or one longer text. Texts are exchanged twice, by block: for their distinct units, and, a third of the
    blocks at a time, to meet what is known of these.
    """
    with open(a_path, "rb") as f, open(b_path, "rb") as g:
        a, b = f.read(), g.read()
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(total / block_bytes), TURNS * documents.sparkSession.sparkContext.defaultParallelism)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    with scratch(documents.sparkSession) as keep:
        local = materialize(block_units(docs), "block-units", release=True)
        units = materialize(aligned_units(aligned_tokens(unit_tokens(local.groupBy("unit").agg(F.sum("n").alias("n")), a, b))), "aligned-units", release=True)
        linked = linked_pairs(units, "unit").join(pair_counts(units), ["a", "b"]).groupBy("unit").agg(F.sum("best").cast("int").alias("n_best"), F.sum("count").alias("count_sum"))
        known = materialize(units.select("unit", "n_a", "groups").join(linked, "unit"), "known-units", release=True)
        turn = F.pmod("block", F.lit(TURNS))
        parts = [keep(materialize(_of_documents(docs.filter(turn == k), local.filter(turn == k).select("block", "unit").join(known, "unit"), with_groups), "aligned", release=True)) for k in range(TURNS)]
    return reduce(DataFrame.unionByName, parts)
