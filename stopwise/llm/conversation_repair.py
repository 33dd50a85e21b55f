"""Repair of conversation structure at least cost.

A conversation in order must read ``(s?(ua)+)?`` in the initials of its roles.  Rows are kept (0), given the role user or
assistant (2) or deleted (3; a must for blank and repeated ones), rows with an empty text may be inserted anywhere (2), and
rows that end without a full stop cost 1 more unless they are deleted.

* Every way through the rows is one whole number.  Its high digits carry the cost; below them each edit has one digit of
  fixed width at its place, D < I < K < R as in the alphabet, and zeros behind the last one.  The smaller of two numbers is
  the cheaper way, or at equal cost the one whose edits come first as text, so a plain minimum per state decides everything.
  The cost of a way follows from its letters and the rows, so of two ways of equal cost to one state, none begins with the
  other, and dropping the larger number loses nothing.
* The states are: nothing yet, after system, after user, after assistant.  Each allows one of user and assistant only, so the
  letters alone say which role is given or inserted.
* Numbers stay short: after ``BLOCK`` rows the letters so far are replaced by their rank among the four states.  All of
  them end with the same row then, so none begins with another one and the ranks decide like the letters.
* Rows are sorted by Spark.  A task reads them as a stream: the first pass keeps a few bytes a row of one conversation, the
  second applies the finished edits to the texts, which pass by one at a time.

Order and ties: by turn, nulls first, then role, then text.  A null role or text counts as one space; rows without an id are
one conversation.  Empty tables give no rows.  Other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stopwise.llm.store import crc32_sql, keep, to_batch

BLOCK = 128
LETTERS = "DIKR"
BITS = 3
DELETE, GIVE, INSERT, UNFINISHED = 3, 2, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: State after the one of user and assistant that fits.
FILL = (USER, USER, ASSISTANT, USER)
FITS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
LEGAL = {"su", "ua", "au"}
WIDTH = 3 * BLOCK + 2
_COST = BITS * (WIDTH + 1)
_DIGIT = {x: [(i + 1) << BITS * (WIDTH - 1 - p) for p in range(WIDTH)] for i, x in enumerate(LETTERS)}
_KINDS = [(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]


def _with_inserts(live: dict[int, tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
    """Best ways with up to two insertions; more of them come back to a state at a higher cost."""
    out = dict(live)
    for sources, target in (((NOTHING, SYSTEM, ASSISTANT), USER), ((USER,), ASSISTANT)):
        for q in sources:
            if q in out:
                v, p, o = out[q]
                new = (v + (INSERT << _COST) + _DIGIT["I"][p], p + 1, o)
                if target not in out or new < out[target]:
                    out[target] = new
    return out


def _letters(value: int, n: int) -> str:
    return "".join(LETTERS[(value >> BITS * (WIDTH - 1 - p) & 7) - 1] for p in range(n))


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and edits for rows of (role initial, has to be deleted, is truncated).

    A way is (number, places used, state at the start of the block).
    """
    total, before = {NOTHING: 0}, {NOTHING: 0}
    trail: list[dict[int, tuple[int, str]]] = []
    for at in range(0, max(len(rows), 1), BLOCK):
        live = {q: ((total[q] << _COST) + (before[q] << BITS * WIDTH), 0, q) for q in total}
        for initial, gone, unfinished in rows[at:at + BLOCK]:
            step: dict[int, tuple[int, int, int]] = {}
            fits = FITS.get(initial, {})
            for q, (v, p, o) in _with_inserts(live).items():
                ways = [(q, "D", DELETE)]
                if not gone:
                    ways.append((FILL[q], "R", GIVE + unfinished * UNFINISHED))
                    if q in fits:
                        ways.append((fits[q], "K", unfinished * UNFINISHED))
                for target, letter, cost in ways:
                    new = (v + (cost << _COST) + _DIGIT[letter][p], p + 1, o)
                    if target not in step or new < step[target]:
                        step[target] = new
            live = step
        if at + BLOCK >= len(rows):
            live = {q: way for q, way in _with_inserts(live).items() if q in (NOTHING, ASSISTANT)}
        total = {q: v >> _COST for q, (v, _, _) in live.items()}
        below = {q: v & ((1 << _COST) - 1) for q, (v, _, _) in live.items()}
        before = {q: sorted(below.values()).index(below[q]) for q in below}
        trail.append({q: (o, _letters(v, p)) for q, (v, p, o) in live.items()})
    q = min(total, key=lambda s: (total[s], before[s]))
    cost, parts = total[q], []
    for block in reversed(trail):
        q, letters = block[q]
        parts.append(letters)
    return cost, "".join(reversed(parts))


class _Conversation:
    """Faults of one conversation whose rows come in order; a few bytes are kept of each row."""

    def __init__(self):
        self.seen: set[bytes] = set()
        self.rows: list[tuple[str, bool, bool]] = []
        self.low = self.high = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        end = text.rstrip(BLANK)
        name = hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()
        again, blank = name in self.seen, not end
        self.seen.add(name)
        unfinished = not blank and not again and end[-1] not in ".!?"
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += unfinished
        if self.rows:
            self.illegal += self.last + role[:1] not in LEGAL
        self.last = role[:1]
        self.rows.append((role[:1], blank or again, unfinished))

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest(self.rows)


def _stream(df: DataFrame, make: Callable[[], object], kind: T.StructType, flush: int = 2000) -> DataFrame:
    """Rows of each task through ``row(values)`` and ``end()`` of one object, in order."""
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, out = make(), []
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for values in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns)):
                    out.extend(work.row(*values))
                if len(out) >= flush:
                    yield to_batch(out, arrow)
                    out = []
            if out:
                yield to_batch(out, arrow)
                out = []
        out = list(work.end())
        if out:
            yield to_batch(out, arrow)

    return df.mapInArrow(run, kind)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def _ordered(df: DataFrame, *first: str) -> DataFrame:
    """Each conversation in one task, in order; the sort spills to disk."""
    order = [*first, F.col("turn").asc_nulls_first(), "role", "text"]
    return df.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", *order)


def edits(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of each conversation of ``conv_id, turn, role, text``."""
    kind = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType)]
                        + [T.StructField(n, t) for n, t in _KINDS] + [T.StructField("audit", T.StringType())])

    class Work:
        now, conv = None, None

        def row(self, conv_id, turn, role, text):
            done = []
            if self.conv is None or conv_id != self.now:
                done = self.end()
                self.now, self.conv = conv_id, _Conversation()
            self.conv.add(turn, role, text)
            return done

        def end(self):
            return [(self.now, *self.conv.result())] if self.conv else []

    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"))
    return _stream(_ordered(plain), Work, kind)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text`` of the repaired conversations, each in one task and in order.

    The edits of a conversation are sorted before its rows, so a row is dealt with as it comes.
    """
    kind = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType)] + T.StructType.fromDDL(
        "place long, edit string, role string, text string").fields)

    class Work:
        now, audit, at, place, state = None, "", 0, 0, NOTHING

        def inserted(self):
            out = []
            while self.audit[self.at:self.at + 1] == "I":
                out.append(self.put("I", None, ""))
            return out

        def put(self, letter, role, text):
            self.at, self.place = self.at + 1, self.place + 1
            self.state = FITS[role[:1]][self.state] if letter == "K" else FILL[self.state]
            return self.now, self.place, letter, role if letter == "K" else ROLE[self.state], text

        def row(self, conv_id, audit, turn, role, text):
            if audit is not None:
                done = self.end()
                self.now, self.audit, self.at, self.place, self.state = conv_id, audit, 0, 0, NOTHING
                return done
            out = self.inserted()
            if self.audit[self.at] == "D":
                self.at += 1
            else:
                out.append(self.put(self.audit[self.at], role, text))
            return out

        def end(self):
            return self.inserted()

    plain = rows.select("conv_id", F.lit(None).cast("string").alias("audit"), F.col("turn").cast("long").alias("turn"),
                        _text("role").alias("role"), _text("text").alias("text"))
    heads = found.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))
    return _stream(_ordered(plain.unionByName(heads), F.col("audit").desc_nulls_last()), Work, kind)


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of ``repaired`` rows, hashed as they pass."""
    kind = T.StructType([rows.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    class Work:
        now, hash = None, None

        def row(self, conv_id, place, role, text):
            done = []
            if place == 1:
                done = self.end()
                self.now, self.hash = conv_id, hashlib.sha256()
            self.hash.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            return done

        def end(self):
            return [(self.now, self.hash.hexdigest())] if self.hash else []

    return _stream(rows.select("conv_id", "place", "role", "text"), Work, kind)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with rows dropped, emptied, cut, repeated or given to the user by the hash of their id and turn."""
    case = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.translate(_text("text"), ".!?", "")).otherwise(_text("text"))
    return conversations.filter(case != 0).select(
        "conv_id", "turn", F.when(case == 4, "user").otherwise(_text("role")).alias("role"), text.alias("text"),
        F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def conversation_repair(conversations: DataFrame) -> DataFrame:
    """Faults, cost, edits and digest of the repaired rows of every conversation, after damage."""
    rows = damaged(conversations)
    found = keep(edits(rows))
    hashed = digests(repaired(rows, found))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    every = conversations.select("conv_id").distinct()
    done = every.join(found, same(every, found), "left").drop(found["conv_id"])
    done = done.join(hashed, same(done, hashed), "left").drop(hashed["conv_id"])
    zero, empty = F.lit(0).cast("long"), F.lit(hashlib.sha256(b"").hexdigest())
    return done.select("conv_id", *[F.coalesce(n, zero).alias(n) for n, _ in _KINDS],
                       F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def _more(way: str, cost: str | int, letter: str) -> str:
    return f"lpad(CAST(CAST({way}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {way}[10:] || '{letter}'"


def _filled(a: str) -> str:
    user = f"least({a}[3], {_more(f'{a}[1]', INSERT, 'I')}, {_more(f'{a}[2]', INSERT, 'I')}, {_more(f'{a}[4]', INSERT, 'I')})"
    return f"list_transform([{user}], lambda n: [{a}[1], {a}[2], n, least({a}[4], {_more('n', INSERT, 'I')})])[1]"


def _step(a: str, x: str) -> str:
    """The ways after one row; a way is its cost in nine digits and its letters, x the initial, whether it must go, and what keeping costs."""
    gone, unfinished = f"{x}[2] = '1'", f"CAST({x}[3] AS BIGINT)"
    give = lambda *q: [f"CASE WHEN NOT {gone} THEN {_more(f'b[{i}]', f'{GIVE} + {unfinished}', 'R')} END" for i in q]
    hold = lambda name, *q: [f"CASE WHEN NOT {gone} AND {x}[1] = '{name}' THEN {_more(f'b[{i}]', unfinished, 'K')} END" for i in q]
    ways = [[], hold("s", 1), give(1, 2, 4) + hold("u", 1, 2, 4), give(3) + hold("a", 3)]
    new = [f"least({', '.join([_more(f'b[{i + 1}]', DELETE, 'D'), *w])})" for i, w in enumerate(ways)]
    return f"list_transform([{_filled(a)}], lambda b: [{', '.join(new)}])[1]"


SQL = f"""
WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(
    "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS c FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
             CASE c WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM k, unnest(range(0, CASE c WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p,
             regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) AS z, substr(role, 1, 1) AS i FROM d),
f AS (SELECT *, CASE WHEN z = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate' WHEN z NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             lag(i) OVER (PARTITION BY conv_id ORDER BY p) || i AS pair FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
             list([i, CASE WHEN fault IN ('blank', 'duplicate') THEN '1' ELSE '0' END, CASE WHEN fault = 'truncated' THEN '{UNFINISHED}' ELSE '0' END]
                  ORDER BY p) AS x FROM f GROUP BY conv_id),
w AS (SELECT *, list_reduce(list_prepend(['000000000', NULL, NULL, NULL], x), lambda a, x: {_step('a', 'x')}) AS last FROM g),
v AS (SELECT *, {_filled('last')} AS done FROM w),
b AS (SELECT *, CAST(least(done[1], done[4])[1:9] AS BIGINT) AS cost, least(done[1], done[4])[10:] AS audit FROM v),
l AS (SELECT conv_id, e, audit[e] AS letter, CAST(sum(CAST(audit[e] <> 'I' AS INT)) OVER (PARTITION BY conv_id ORDER BY e) AS BIGINT) AS p,
             CAST(sum(CAST(audit[e] <> 'D' AS INT)) OVER (PARTITION BY conv_id ORDER BY e) AS BIGINT) AS place
      FROM b, unnest(range(1, length(audit) + 1)) AS u(e)),
m AS (SELECT l.*, f.role, f.text, coalesce(bool_or(place = 1 AND letter = 'K' AND f.i = 's') OVER (PARTITION BY l.conv_id), false) AS led
      FROM l LEFT JOIN f ON l.letter <> 'I' AND f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.p = l.p),
r AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - CAST(led AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END
             || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY e)) AS h FROM m WHERE letter <> 'D' GROUP BY conv_id)
SELECT c.conv_id, {', '.join(f'CAST(coalesce({n}, 0) AS BIGINT) AS {n}' for n, _ in _KINDS)}, coalesce(audit, '') AS audit,
       coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""
