"""Prefix trie of conversations by union-find over sorted neighbours.

Conversations are sequences of turns, and each turn is one token, a 128-bit digest of its role and text.  Sorted by their
tokens, conversations with a common beginning are neighbours, and the longest common prefix (LCP) of two neighbours is an edge.

* Edges are taken in descending depth.  A component is a run of neighbours with one open node.  Before an edge of depth d
  joins two components, each climbs to depth d + 1, which closes the nodes on its way, and the merge makes (or adds to) the
  branching node of depth d.  When a node closes, its members, children and sums are complete and go to its parent.
* Spark sorts all sequences by ranges of (tokens, id), so a large group of equal conversations spreads over tasks.  A task
  works on blocks of ``BLOCK`` rows.  Only nodes on the paths of the first and the last sequence of a block can continue in
  its neighbours.  They stay open: the block's forest is contracted to these two paths, whose nodes carry what hangs below
  them.  Paths are sorted sequences again, so the same union-find merges those of a task to two, and then those of all tasks.
  The last merge reads two paths a task, whatever the number of conversations.
* Ids that end in a node are hashed where they are when the node closes in its block; for open nodes they leave as pieces of
  text, sorted and hashed as a stream, so a group of equal conversations is never held as a whole.

One conversation has to fit a row in its compact form (20 bytes a turn), its texts need not.

Order and ties: by turn, nulls first, then role, then text; null role or text is empty.  Rows without an id are one
conversation, which borrows nothing, counts as a member, is written as an empty id before all others, and never is the
smallest member of a node that has another one.  An empty table has no nodes.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stopwise.llm.store import crc32_sql, keep, to_batch

TOKEN = 16
BLOCK = 20_000
#: Paths that a task gathers before it merges them.
PATHS = 2_000
PIECE = 4_096
FAMILY, BORROWED = 100, 6
EMPTY = hashlib.sha256(b"").hexdigest()
#: n_convs, smallest id, children, leaves below, tokens saved below.
Sums = tuple[int, int | None, int, int, int]
NONE: Sums = (0, None, 0, 0, 0)

NODE, IDS, PATH = 0, 1, 2
_TYPES = {T.IntegerType(): "kind", T.LongType(): "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens first_id",
          T.BinaryType(): "parent node tokens lengths sums", T.StringType(): "ends_sha256 ids"}
OUT = T.StructType([T.StructField(name, kind) for kind, names in _TYPES.items() for name in names.split()])
_AT = {name: i for i, name in enumerate(OUT.names)}


def record(kind: int, **values) -> list:
    row = [None] * len(OUT)
    row[0] = kind
    for name, value in values.items():
        row[_AT[name]] = value
    return row


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _add(a: Sums, b: Sums) -> Sums:
    return a[0] + b[0], _least(a[1], b[1]), a[2] + b[2], a[3] + b[3], a[4] + b[4]


def _ids_text(ids: list[int | None]) -> str:
    return ",".join("" if i is None else str(i) for i in ids)


class Sequence:
    """Tokens, code points of each turn, by depth what is known of the nodes on the way, and the ids that end here."""

    __slots__ = ("tokens", "lengths", "sums", "ids")

    def __init__(self, tokens: bytes, lengths: np.ndarray, sums: dict[int, Sums], ids: list[int | None]):
        self.tokens, self.lengths, self.sums, self.ids = tokens, lengths, sums, ids

    def __len__(self) -> int:
        return len(self.lengths)

    def packed(self) -> dict[str, bytes]:
        table = [(d, n, lo is not None, lo or 0, kids, leaves, saved) for d, (n, lo, kids, leaves, saved) in self.sums.items()]
        return {"tokens": self.tokens, "lengths": self.lengths.tobytes(), "sums": np.array(table, np.int64).tobytes()}

    @staticmethod
    def unpacked(tokens: bytes, lengths: bytes, sums: bytes) -> "Sequence":
        table = np.frombuffer(sums, np.int64).reshape(-1, 7).tolist()
        return Sequence(tokens, np.frombuffer(lengths, np.int64), {d: (n, lo if some else None, *rest) for d, n, some, lo, *rest in table}, [])


def common(a: Sequence, b: Sequence) -> int:
    """Turns that two sequences begin with alike."""
    n = min(len(a), len(b)) * TOKEN
    differ = np.flatnonzero(np.frombuffer(a.tokens, np.uint8, n) != np.frombuffer(b.tokens, np.uint8, n))
    return (int(differ[0]) if len(differ) else n) // TOKEN


def prefix_names(tokens: bytes) -> list[bytes]:
    """128-bit name of each prefix: the digest of the name before it and the next token."""
    out = [b"root".ljust(TOKEN, b"\0")]
    for at in range(0, len(tokens), TOKEN):
        out.append(hashlib.md5(out[-1] + tokens[at:at + TOKEN]).digest())
    return out


class _Component:
    """A run of neighbours with one open node: its depth, what is known of it, and its finished children, who wait for its
    smallest member."""

    __slots__ = ("depth", "sums", "waiting", "members")

    def __init__(self, depth: int, member: int):
        self.depth, self.sums, self.waiting, self.members = depth, NONE, [], [member]


class _Forest:
    """Union-find over the LCP edges of sorted sequences.

    With ``contract`` the outer two paths stay open, else every node closes.  ``rows`` says that the sequences are groups of
    rows, which hold the ids that end in them; paths do not, their ids have left under the names of the nodes.
    """

    def __init__(self, found: list[Sequence], contract: bool, rows: bool):
        self.found, self.rows, self.out = found, rows, []
        outer = sorted({0, len(found) - 1}) if contract else []
        self.open: dict[int, dict[int, Sums]] = {i: {} for i in outer}
        self.names = {i: prefix_names(found[i].tokens) for i in (outer if rows else range(len(found)))}
        self.up = list(range(len(found)))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def run(self) -> tuple[list[list], list[Sequence]]:
        found = self.found
        comps = [_Component(len(s), i) for i, s in enumerate(found)]
        for c in comps:
            self.take(c)
        lcp = [common(a, b) for a, b in zip(found, found[1:])]
        for edge in sorted(range(len(lcp)), key=lambda e: -lcp[e]):
            a, b = self.root(edge), self.root(edge + 1)
            x, y = comps[a], comps[b]
            for c in (x, y):
                self.climb(c, lcp[edge])
            x.sums, x.waiting, x.members = _add(x.sums, y.sums), x.waiting + y.waiting, x.members + y.members
            self.up[b], comps[b] = a, None
        top = comps[self.root(0)]
        self.climb(top, 0)
        if self.open:
            self.leave_open(top, 0)
        else:
            self.close(top)
            self.out += top.waiting
        return self.out, [Sequence(found[i].tokens, found[i].lengths, sums, []) for i, sums in self.open.items()]

    def take(self, c: _Component) -> None:
        """Add what the sequences themselves know about the open node."""
        for i in c.members:
            known = self.found[i].sums.get(c.depth)
            if known:
                c.sums = _add(c.sums, known)

    def climb(self, c: _Component, depth: int) -> None:
        while c.depth > depth:
            mine = self.root(c.members[0])
            path = next((i for i in self.open if self.root(i) == mine), None)
            if path is None:
                self.close(c)
            else:
                self.leave_open(c, path)
            c.depth -= 1
            self.take(c)

    def ends(self, c: _Component) -> list[int | None]:
        return [x for i in c.members if len(self.found[i]) == c.depth for x in self.found[i].ids]

    def close(self, c: _Component) -> None:
        """The open node is complete: tell its children its smallest member, and become a waiting child itself."""
        n, least, kids, leaves, saved = c.sums
        one = c.members[0]
        if c.depth:
            saved += (n - 1) * int(self.found[one].lengths[c.depth - 1])
        leaves += kids == 0
        for child in c.waiting:
            child[_AT["parent_conv_id"]] = least
        self.out += c.waiting
        known = {"ends_sha256": hashlib.sha256(_ids_text(self.ends(c)).encode()).hexdigest()} if self.rows else {"node": self.names[one][c.depth]}
        c.sums = (n, least, 1, leaves, saved)
        c.waiting = [record(NODE, conv_id=least, depth=c.depth, n_convs=n, n_children=kids, n_leaves=leaves, saved_tokens=saved, **known)]

    def leave_open(self, c: _Component, path: int) -> None:
        """The open node may go on elsewhere: what is known stays with the path, its children learn their parent by name."""
        name = self.names[path][c.depth]
        ids = self.ends(c)
        for at in range(0, len(ids), PIECE):
            self.out.append(record(IDS, node=name, first_id=ids[at], ids=_ids_text(ids[at:at + PIECE])))
        for child in c.waiting:
            child[_AT["parent"]] = name
        self.out += c.waiting
        self.open[path][c.depth] = c.sums
        c.sums, c.waiting = NONE, []


def grow(found: list[Sequence], contract: bool, rows: bool) -> tuple[list[list], list[Sequence]]:
    """Records of the nodes that close, and the contracted outer paths."""
    return _Forest(found, contract, rows).run() if found else ([], [])


def _partition_forests(sequences: DataFrame) -> DataFrame:
    """Closed nodes, pieces of ids and two paths of each task; the rows come sorted."""
    arrow = to_arrow_schema(OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n, paths = [], 0, []

        def contracted() -> list[list]:
            nonlocal block, n, paths
            out, new = grow(block, True, True)
            block, n, paths = [], 0, paths + new
            if len(paths) > PATHS:
                more, paths = grow(paths, True, False)
                out += more
            return out

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                for conv_id, tokens, lengths in zip(*(c.to_pylist() for c in batch.slice(i, 1000).columns)):
                    if n == BLOCK:
                        out = contracted()
                        yield from _batches(out, arrow)
                    if not block or block[-1].tokens != tokens:
                        block.append(Sequence(tokens, np.array(lengths, np.int64), {}, []))
                    block[-1].ids.append(conv_id)
                    depth = len(block[-1])
                    block[-1].sums[depth] = _add(block[-1].sums.get(depth, NONE), (1, conv_id, 0, 0, 0))
                    n += 1
        out = contracted()
        more, paths = grow(paths, True, False)
        yield from _batches(out + more + [record(PATH, **p.packed()) for p in paths], arrow)

    return sequences.repartitionByRange("tokens", "conv_id").sortWithinPartitions("tokens", "conv_id") \
        .select("conv_id", "tokens", "lengths").mapInArrow(run, OUT)


def _batches(rows: list[list], arrow: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), size):
        yield to_batch(rows[at:at + size], arrow)


def _merged(paths: DataFrame) -> DataFrame:
    """Nodes of the paths of all tasks, merged in one task: two rows of each."""
    arrow = to_arrow_schema(OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Sequence.unpacked(*values) for batch in batches for values in zip(*(c.to_pylist() for c in batch.columns))]
        yield from _batches(grow(found, False, False)[0], arrow)

    return paths.repartition(1).sortWithinPartitions("tokens").select("tokens", "lengths", "sums").mapInArrow(run, OUT)


def _ends(pieces: DataFrame) -> DataFrame:
    """``node, hashed``: pieces of ids in order, hashed as they pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([hashed.hexdigest()])], ["node", "hashed"])

        for batch in batches:
            for node, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if node != now:
                    if hashed:
                        yield done()
                    now, hashed = node, hashlib.sha256(ids.encode())
                else:
                    hashed.update(b"," + ids.encode())
        if hashed:
            yield done()

    return pieces.repartition("node").sortWithinPartitions("node", "first_id").select("node", "ids").mapInArrow(run, "node binary, hashed string")


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(sequences: DataFrame) -> DataFrame:
    """One row per node of the sequences ``conv_id, tokens, lengths``."""
    found = keep(_partition_forests(sequences))
    merged = keep(_merged(found.filter(F.col("kind") == PATH)))
    nodes = found.filter(F.col("kind") == NODE)
    whole = F.col("parent").isNull() & F.col("node").isNull()
    named = merged.unionByName(nodes.filter(F.col("node").isNotNull()))
    parents = named.select(F.col("node").alias("parent"), F.col("conv_id").alias("least"))
    rest = merged.unionByName(nodes.filter(~whole)).join(parents, "parent", "left") \
        .join(_ends(found.filter(F.col("kind") == IDS)), "node", "left") \
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "least")) \
        .withColumn("ends_sha256", F.coalesce("ends_sha256", "hashed", F.lit(EMPTY)))
    return nodes.filter(whole).select(*RESULT).unionByName(rest.select(*RESULT))


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place`` (from 1), ``token`` (hex) and ``length`` (code points of the text) of each turn."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    name = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("place"), name.alias("token"),
                       F.length("text").cast("long").alias("length"))


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its family."""
    return F.coalesce(F.crc32(conv_id.cast("string").cast("binary")) % BORROWED, F.lit(0).cast("long"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """Conversations whose first turns are those of the first of their family: ``place`` 0 stands for the conversation itself."""
    each = rows.filter(F.col("place") == 1).select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    heads = rows.filter(F.col("place") < BORROWED).select(F.col("conv_id").alias("base"), "place", "token", "length")
    taken = each.join(heads, "base").filter(F.col("place") <= borrowed(F.col("conv_id")))
    none = each.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("token"), F.lit(0).cast("long").alias("length"))
    return rows.filter(F.col("place") > borrowed(F.col("conv_id"))).unionByName(taken.select(*rows.columns)).unionByName(none)


def sequences(rows: DataFrame) -> DataFrame:
    """``conv_id, tokens, lengths`` of each conversation."""
    found = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "token", "length"))).alias("s"))
    real = F.filter("s", lambda x: x["token"].isNotNull())
    return found.select("conv_id", F.unhex(F.concat_ws("", F.transform(real, lambda x: x["token"]))).alias("tokens"),
                        F.transform(real, lambda x: x["length"]).alias("lengths"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the rebuilt conversations."""
    return trie(keep(sequences(rebuilt(keep(turns(conversations))))))


SQL = f"""
WITH t AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations),
own AS (SELECT conv_id, list(x ORDER BY p) AS s FROM t GROUP BY conv_id),
h AS (SELECT conv_id, s, coalesce({crc32_sql('CAST(conv_id AS VARCHAR)')} % {BORROWED}, 0) AS h FROM own),
r AS (SELECT h.conv_id, list_concat(coalesce(b.s, [])[1:h.h], h.s[h.h + 1:]) AS s
      FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % {FAMILY}),
m AS (SELECT conv_id, s[1:d] AS k, len(s) = d AS ends FROM r, unnest(range(0, len(s) + 1)) AS u(d)),
n AS (SELECT k, len(k) AS d, count(*) AS n, min(conv_id) AS c, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
      FILTER (ends), '')) AS e FROM m GROUP BY k),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(kids, 0) AS kids, CASE WHEN d > 0 THEN (n - 1) * length(k[d].text) ELSE 0 END AS own FROM n LEFT JOIN kids USING (k)),
sub AS (SELECT k[1:a] AS k, CAST(sum(CAST(kids = 0 AS INT)) AS BIGINT) AS leaves, CAST(sum(own) AS BIGINT) AS saved
        FROM f, unnest(range(0, d + 1)) AS u(a) GROUP BY ALL)
SELECT f.c AS conv_id, f.d AS depth, p.c AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, leaves AS n_leaves, saved AS saved_tokens,
       f.e AS ends_sha256
FROM f JOIN sub USING (k) LEFT JOIN n p ON f.d > 0 AND p.k = f.k[1:f.d - 1]
"""
