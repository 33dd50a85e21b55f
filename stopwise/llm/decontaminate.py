"""Benchmark decontamination by winnowing.

Test items and documents are cut into words; of each ``WINDOW - GRAM + 1`` consecutive word grams the one with the smallest
hash is a fingerprint, so any shared run of ``WINDOW`` words shares a fingerprint at the same place.  A fingerprint of a
document that also belongs to an item is extended to all windows of ``WINDOW`` words around it, and the windows are joined
with those of the items by their words, so hash collisions have no effect.  Items of fewer than ``WINDOW`` words are one
window each; the grams of their lengths are looked up at every position.

Documents are first held against a bit table of the items' fingerprints.  Its size is fixed (``TABLE_BITS``), whatever the
number of items; when it fills up, more windows reach the exact join, but no hit is ever lost.

Results depend on the text alone and are keyed by it.  Null has no words; repeated item rows count once.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise.llm import bytehash as bh
from stopwise.llm.store import keep, map_rows, raw_text, text_key

WINDOW = 13
GRAM = 8
TABLE_BITS = 24
SHARE = 20


def fingerprints(grams: np.ndarray) -> np.ndarray:
    """Places of the winnowed grams: the leftmost smallest of each window."""
    width = WINDOW - GRAM + 1
    if len(grams) < width:
        return np.zeros(0, np.int64)
    step, out = 1 << 20, []
    for at in range(0, len(grams) - width + 1, step):
        out.append(np.unique(bh.window_argmin(grams[at:at + step + width - 1], width)) + at)
    return np.unique(np.concatenate(out))


def _folded(raw: bytes) -> bytes:
    return bh.FOLD[np.frombuffer(raw, np.uint8)].tobytes() if raw else raw


def _window(raw: bytes, start: np.ndarray, end: np.ndarray, at: int, n: int) -> bytes:
    return b" ".join(raw[s:e] for s, e in zip(start[at:at + n].tolist(), end[at:at + n].tolist()))


def item_windows(items: DataFrame) -> DataFrame:
    """``item_id``, the number of words and the folded words of each window of each item."""
    def make():
        def step(r):
            raw = _folded(r["raw"])
            _, start, end = bh.words(raw, bh.NON_WORD, False)
            size = min(WINDOW, len(start))
            return [(r["item_id"], size, _window(raw, start, end, i, size)) for i in range(len(start) - size + 1)] if size else []

        return step

    return map_rows(items.select("item_id", raw_text().alias("raw")), make, _with_id(items, "item_id", "size int, window binary"))


def _with_id(df: DataFrame, name: str, ddl: str) -> T.StructType:
    return T.StructType([T.StructField(name, df.schema[name].dataType)] + T.StructType.fromDDL(ddl).fields)


def bit_table(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bits of the items' gram hashes, and the sizes of the short windows.

    The table is put together by the executors in words of 32 bits; at most 2^(TABLE_BITS - 5) rows come to the driver.
    """
    def make():
        def step(r):
            h, _, _ = bh.words(r["window"], bh.NON_WORD, False)
            g = bh.grams(h, GRAM if r["size"] == WINDOW else r["size"])
            g = g[np.unique(bh.window_argmin(g, len(g)))]
            slot = (g >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            return [(r["size"] if r["size"] < WINDOW else 0, int(s) >> 5, 1 << (int(s) & 31)) for s in slot]

        return step

    rows = map_rows(windows.select("size", "window").distinct(), make, "short int, slot int, bit long") \
        .groupBy("slot").agg(F.bit_or("bit").alias("bits"), F.collect_set("short").alias("short")).collect()
    table = np.zeros(1 << (TABLE_BITS - 5), "<u4")
    for r in rows:
        table[r["slot"]] = r["bits"]
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool), sorted({s for r in rows for s in r["short"] if s})


def candidates(docs: DataFrame, table: np.ndarray, short: list[int]) -> DataFrame:
    """Per row: number of words, and the windows around fingerprints that hit the table."""
    shared = docs.sparkSession.sparkContext.broadcast((np.packbits(table), short))

    def make():
        packed, short = shared.value
        table = np.unpackbits(packed).astype(bool)
        shift = np.uint64(64 - TABLE_BITS)

        def step(r):
            h, start, end = bh.words(r["raw"], bh.NON_WORD)
            n, windows = len(h), []
            g = bh.grams(h, GRAM)
            at = fingerprints(g)
            at = at[table[(g[at] >> shift).astype(np.int64)]]
            if len(at):
                around = (at[:, None] - np.arange(WINDOW - GRAM + 1)).ravel()
                windows += [(int(i), WINDOW) for i in np.unique(around[(around >= 0) & (around <= n - WINDOW)])]
            for size in short:
                g = bh.grams(h, size)
                windows += [(int(i), size) for i in np.flatnonzero(table[(g >> shift).astype(np.int64)])]
            raw = _folded(r["raw"]) if windows else b""
            return [(r["doc_id"], r["key"], n, [
                {"start": i, "size": size, "window": _window(raw, start, end, i, size)} for i, size in windows] or None)]

        return step

    return map_rows(docs.select("doc_id", text_key().alias("key"), raw_text().alias("raw")), make, _with_id(
        docs, "doc_id", "key binary, n_words long, found array<struct<start:int,size:int,window:binary>>"), flush=500)


def _hit_words(spans) -> F.Column:
    """Number of places covered by (start, size) pairs in order of their start."""
    def add(acc, s):
        end = s["start"] + s["size"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))).alias("n"),
                        F.greatest(acc["end"], end).alias("end"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(F.array_sort(spans), zero, add, lambda a: a["n"])


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row."""
    windows = keep(item_windows(items))
    table, short = bit_table(windows)
    rows = keep(candidates(docs, table, short))
    places = rows.filter("found is not null").select("key", F.explode("found").alias("x")).select("key", "x.*").distinct()
    known = windows.select("size", "window").distinct()
    hits = keep(places.join(known, ["size", "window"], "left_semi"))
    covered = hits.groupBy("key").agg(_hit_words(F.collect_set(F.struct("start", "size"))).cast("long").alias("n_hit"))
    owners = hits.select("key", "size", "window").distinct().join(windows.distinct(), ["size", "window"]) \
        .groupBy("key").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    done = rows.select("doc_id", "key", "n_words").join(covered, "key", "left").join(owners, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return done.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(ids)), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * SHARE >= F.col("n_words"))).alias("contaminated"))


_WORDS = r"""list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS g
       FROM b, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS u(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
hit AS (SELECT DISTINCT r, i, k, g FROM (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)) SEMI JOIN bw USING (k, g)),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM hit JOIN bw USING (k, g) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AND {SHARE} * coalesce(words.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
