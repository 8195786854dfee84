"""The trie of conversations that begin alike: an external mergesort whose runs carry longest common prefixes, and a stack of open nodes over its output."""
import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.session import materialize

#: Bytes of a turn's digest. A conversation is the string of its turns' digests, its path the string of a prefix.
TURN = 16
#: Bytes of runs that a task holds before it writes the next ones to a file of its own, which goes with the task.
RUN_BYTES = 64 << 20
#: Conversations are rebuilt within groups of so many ids, from at most so many of the first one's turns.
GROUP, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"


def rebuilt_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of digest, words): each conversation's first turns taken from the first of its group of ids.

    Turns stand in order of turn, null first; those of one number in order of their digests. Null roles and texts are
    empty. Rows without a conv_id are no conversation's and are left out. Texts aren't shuffled, only digests and
    counts of words; one conversation's, about 40 bytes a turn, are one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(2 * TURN)))
    turns = conversations.filter("conv_id IS NOT NULL").select("conv_id", F.struct("turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("own"))
    first = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = turns.filter(F.col("conv_id") == first).groupBy("conv_id").agg(F.slice(F.sort_array(F.collect_list("t")), 1, HEADS - 1).alias("head"))
    heads = heads.select(F.col("conv_id").alias("_first"), F.transform("head", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    both = own.withColumn("_first", first).join(heads, "_first", "left")
    head = F.when(F.col("head").isNull(), F.array().cast("array<struct<digest:binary,words:int>>")).otherwise(F.slice("head", F.lit(1), h))
    rest = F.when(F.size("own") > h, F.slice("own", h + 1, F.size("own"))).otherwise(F.array().cast("array<struct<digest:binary,words:int>>"))
    return both.select("conv_id", F.concat(head, rest).alias("turns"))


def paths(rebuilt: DataFrame) -> DataFrame:
    """conv_id, path, words (binary): the digests in a row, and the turns' words as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
            flat = lists.values
            digests = b"".join(flat.field(0).slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pylist())
            words = flat.field(1).slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_numpy(zero_copy_only=False).astype("<i4").tobytes()
            at = offsets - offsets[0]
            cut = lambda data, n: pa.array([data[n * a : n * b] for a, b in zip(at, at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), cut(digests, TURN), cut(words, 4)], ["conv_id", "path", "words"])

    return rebuilt.mapInArrow(run, "conv_id long, path binary, words binary")


def common_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """How many turns two paths share, of which the first `known` are known to be shared and aren't compared."""
    most = min(len(a), len(b)) // TURN
    step = 1
    while known < most:  # ever longer stretches while they are alike, then ever shorter ones
        step = min(step, most - known)
        if a[known * TURN : (known + step) * TURN] == b[known * TURN : (known + step) * TURN]:
            known += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 4)
    return known


class Runs:
    """Sorted runs of (path, value), each path with the turns it shares with the one before it in its run."""

    def __init__(self, most: int = RUN_BYTES):
        self.most, self.held, self.runs, self.files = most, 0, [], []

    def add(self, rows: list[tuple[bytes, object]]) -> None:
        rows.sort(key=lambda r: r[0])
        run, before = [], b""
        for path, value in rows:
            run.append((path, common_turns(before, path), value))
            before = path
            self.held += len(path) + 200
        self.runs.append(run)
        if self.held > self.most:
            self.spill()

    def spill(self) -> None:
        """What is held becomes one run in a file without a name, which is gone when closed."""
        file = tempfile.TemporaryFile()
        for row in merged([iter(r) for r in self.runs]):
            pickle.dump(row, file)
        file.seek(0)
        self.files.append(file)
        self.runs, self.held = [], 0

    @staticmethod
    def _read(file) -> Iterator[tuple[bytes, int, object]]:
        with file:
            while True:
                try:
                    yield pickle.load(file)
                except EOFError:
                    return

    def merged(self) -> Iterator[tuple[bytes, int, object]]:
        return merged([*(self._read(f) for f in self.files), *(iter(r) for r in self.runs)])


def merged(runs: list[Iterator[tuple[bytes, int, object]]]) -> Iterator[tuple[bytes, int, object]]:
    """Runs merged by a tree of losers, each row with the turns it shares with the row before it in the output.

    A contender's count is what it shares with the row that left last: of two, the one that shares more comes first,
    unseen; if they share as much they differ from there on only, and the loser keeps what it shares with the winner.
    So no turn is compared twice for a row, however many rows begin alike.
    """
    n = 1
    while n < len(runs):
        n *= 2
    runs = [*runs, *(iter(()) for _ in range(n - len(runs)))]

    def beats(a, b):
        """Winner and loser; a row is [path, shared, value, run], or None at a run's end."""
        if a is None or b is None:
            return (b, a) if a is None else (a, b)
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        shared = common_turns(a[0], b[0], a[1])
        at = slice(shared * TURN, None)
        first, second = (b, a) if b[0][at] < a[0][at] else (a, b)
        second[1] = shared
        return first, second

    def pull(k):
        row = next(runs[k], None)
        return row and [*row, k]

    losers: list = [None] * n
    level = [pull(k) for k in range(n)]
    while len(level) > 1:
        played = [beats(level[i], level[i + 1]) for i in range(0, len(level), 2)]
        losers[len(played) : 2 * len(played)] = [loser for _, loser in played]
        level = [winner for winner, _ in played]
    winner = level[0]
    while winner is not None:
        yield winner[0], winner[1], winner[2]
        at = (winner[3] + n) // 2
        winner = pull(winner[3])
        while at:
            winner, losers[at] = beats(winner, losers[at])
            at //= 2


#: What a task knows of a node: of nodes that several ranges share, each range has a part, and parts add up.
NODE = "key binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_ROOT = hashlib.md5(b"").digest()


class _Open:
    """A node on the path that is being read."""

    __slots__ = ("children", "conv", "hash", "leaf", "leaves", "n", "new", "saved", "words")

    def __init__(self, hash_, words: int, new: bool):
        self.hash, self.words, self.new = hash_, words, new
        self.conv, self.n, self.children, self.leaves, self.saved, self.leaf = None, 0, 0, 0, 0, False


def finished_nodes(rows: Iterable[tuple[bytes, int, object]]) -> Iterator[tuple]:
    """NODE's columns of each node, when the last path through it has gone by.

    rows: of each range its distinct paths in order, behind one that stands for the range, with the turns shared with
    the row before; value: (words, conv_id, n). A value of None marks the last path of the ranges before, whose nodes
    count as theirs; or, at a range's end, the first path of those behind, which tells whether the last one is a leaf.
    """
    stack: list[_Open] = []

    def close(depth: int):
        while len(stack) > depth:
            node = stack.pop()
            above = stack[-1] if stack else None
            saved = node.saved + node.n * node.words - (node.words if node.new else 0)
            leaves = node.leaves + node.leaf
            if node.n:
                yield node.hash.digest(), above.hash.digest() if above else None, len(stack), node.conv, node.n, node.children, leaves, saved
            if above:
                above.n, above.leaves, above.saved, above.children = above.n + node.n, above.leaves + leaves, above.saved + saved, above.children + node.new
                above.conv = node.conv if above.conv is None or node.conv is not None and node.conv < above.conv else above.conv

    def open_to(path: bytes, words, new: bool):
        if not stack:
            stack.append(_Open(hashlib.md5(), 0, new))
        for d in range(len(stack) - 1, len(path) // TURN - 1):
            hash_ = stack[-1].hash.copy()
            hash_.update(path[(d + 1) * TURN : (d + 2) * TURN])
            stack.append(_Open(hash_, int(words[d]), new))

    own = False  # whether a path of this range has been read
    for path, shared, value in rows:
        if not shared:  # another range begins
            yield from close(0)
            own = False
        if value is None and not own:
            open_to(path, np.zeros(len(path) // TURN, np.int32), False)
            continue
        if stack and (shared == len(stack)):
            stack[-1].leaf = False
        yield from close(max(1, shared)) if stack else ()
        if value is None:
            continue
        words, conv, n = value
        words = np.frombuffer(words, "<i4")
        if not own:  # nodes shared with the ranges before were opened without their words
            for d in range(1, len(stack)):
                stack[d].words = int(words[d - 1])
            own = True
        open_to(path, words, True)
        end = stack[-1]
        end.n, end.leaf = end.n + n, True
        end.conv = conv if end.conv is None else min(end.conv, conv)
    yield from close(0)


def partial_nodes(sequences: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """NODE's columns, from distinct path, words, conv_id, n: ranges of paths are sorted and read side by side, one task each.

    Equal paths have been counted together, so ranges of even size can be cut however many conversations begin alike.
    Each range is given the last path before it and the first behind it: what its nodes hold of their subtrees then adds
    up over ranges, for a node counts as new in one of them only.
    """
    ranged = materialize(sequences.repartitionByRange("path").withColumn("range", F.spark_partition_id()), "ranges")
    edges = ranged.groupBy("range").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    w = Window.orderBy("range")  # a row a range
    edges = edges.select("range", F.array(F.lag("high").over(w), F.lead("low").over(w)).alias("both"))
    edges = edges.select("range", F.explode("both").alias("path")).filter("path IS NOT NULL").select("range", "path", F.lit(None).cast("binary").alias("words"), F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("n"))
    rows = ranged.select("range", "path", "words", "conv_id", "n").unionByName(edges).repartition("range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(run_bytes)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            runs.add([(r.to_bytes(TURN, "big") + path, None if words is None else (words, conv, n)) for r, path, words, conv, n in zip(*columns, strict=True)])
        kinds = [f.type for f in schema]
        held: list[tuple] = []
        for node in finished_nodes(runs.merged()):
            held.append(node)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], schema=schema)

    schema = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in NODE.split(", ")])
    return rows.mapInArrow(run, NODE)


def ends(members: DataFrame) -> DataFrame:
    """key, ends_sha256 from key, conv_id: ids are sorted within tasks and fed to one hash a key, so a key's ids are never held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, done = [], []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k == key:
                    state.update(b",%d" % c)
                    continue
                if key is not None:
                    keys.append(key)
                    done.append(state.hexdigest())
                key, state = k, hashlib.sha256(b"%d" % c)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(done, pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])

    return members.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ends_sha256 string")


def _key(path: Column) -> Column:
    return F.unhex(F.md5(path))


def prefix_trie(conversations: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node of the rebuilt conversations' trie.

    A node is a distinct sequence of first turns; conv_id is the smallest of the conversations that begin so. Equal
    turns have equal digests (128 bits of SHA-256). For nulls, ties and rows without a conv_id see
    rebuilt_conversations; repeated rows are turns of their own. An empty table has no node, not even the root.
    Columns beside conv_id, turn, role and text are not read.
    """
    members = materialize(paths(rebuilt_conversations(conversations)), "paths")
    sequences = members.groupBy("path", "words").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = materialize(partial_nodes(sequences, run_bytes).groupBy("key", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), *sums), "nodes")
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    last = ends(members.select(_key(F.col("path")).alias("key"), "conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = nodes.join(parents, "parent", "left").join(last, "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


ORACLE = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS rn, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(x ORDER BY rn) AS own FROM t GROUP BY 1),
c AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(str_split(conv_id::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 4 AS h FROM o),
p AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:h], []), c.own[h + 1:]) AS path FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 20),
m AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM p),
n AS (SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = len(path)) AS ends FROM m GROUP BY 1, 2),
k AS (SELECT n.*, (SELECT count(*) FROM n s WHERE s.depth = n.depth + 1 AND s.node[1:n.depth] = n.node) AS n_children FROM n),
w AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(node[-1].t, '[^\\x20\\x09-\\x0D]+')) END AS saved FROM k)
SELECT a.conv_id, a.depth, any_value(u.conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs, any_value(a.n_children) AS n_children,
  count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens, sha256(coalesce(any_value(a.ends), '')) AS ends_sha256
FROM w a JOIN w b ON b.depth >= a.depth AND b.node[1:a.depth] = a.node LEFT JOIN n u ON u.depth = a.depth - 1 AND u.node = a.node[1:a.depth - 1]
GROUP BY a.conv_id, a.depth, a.node
"""
