"""Exact substring deduplication with suffix arrays.

A byte goes when it is covered by a string of ``LENGTH`` bytes that starts anywhere else in the corpus.

1. Every start position is dealt to an anchor: the smallest hash of ``GRAM`` bytes inside its string.  Equal strings have
   equal anchors, so the anchor's hash brings all copies of a string together and unrelated text apart.  The consecutive
   starts of one anchor form a region of at most ``2 * LENGTH`` bytes.
2. Anchors whose hash occurs once are done.  Equal regions under a hash are counted, not moved: with two or more of them
   every start in them is repeated.
3. The different regions under a hash are laid side by side in shards of bounded size, and each shard gets a suffix
   array by induced sorting: suffixes are classified, leftmost-smaller (LMS) substrings are sorted and named, the order of
   the LMS suffixes is found by recursion on the names, and the array is induced from it in two linear bucket scans.
   Permuted common prefixes are computed at the irreducible positions and carried on from there; a start is repeated when
   the common prefix with a neighbour has ``LENGTH`` bytes.
4. A hash with more different regions than a shard holds is a hot key (a passage in very many documents): the strings of
   its regions are counted by 128-bit digest over all tasks instead, which is exact as well and has no large group.

Results depend on the texts alone, so they are keyed by text: repeated rows and repeated or null ids get one row each.
Null and empty texts have no bytes; their digest is the one of the empty string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise.llm import bytehash as bh
from stopwise.llm.store import keep, map_rows, raw_text, text_key, to_batch

LENGTH = 200
GRAM = 40
SHARD_REGIONS = 6000
COMPARED = 512
OCCURRENCE = "t binary, h long, g long, start long, n int"


# ---- anchors and regions -------------------------------------------------------------------------------------------------

def regions(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, int]]:
    """(anchor hash, region digest, first start, number of starts) of a text, a bounded piece at a time."""
    for at in range(0, max(len(data) - length + 1, 0), bh.PIECE):
        piece = data[at:at + bh.PIECE + length - 1]
        b = np.frombuffer(piece, np.uint8)
        sums = bh.prefix(b)
        first = np.arange(len(b) - gram + 1)
        hashes = bh.spans_hash(sums, first, first + gram)
        anchor = bh.window_argmin(hashes, length - gram + 1)
        begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        end = np.append(begin[1:], len(anchor))
        anchor = anchor[begin]
        for h, lo, hi, off in zip(hashes[anchor].view(np.int64).tolist(), begin.tolist(), end.tolist(), (anchor - begin).tolist()):
            g = xxhash.xxh3_64_intdigest(piece[lo:hi + length - 1], seed=off)
            yield h, g - (1 << 63), at + lo, hi - lo


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    def make():
        return lambda row: [(row["t"], *r) for r in regions(row["raw"], length)]

    return map_rows(docs.select(text_key().alias("t"), raw_text().alias("raw")), make, OCCURRENCE)


# ---- suffix array --------------------------------------------------------------------------------------------------------

def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S type); the end mark counts as S."""
    n = len(s)
    up = np.zeros(n, np.int8)
    up[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    up[-1] = 1
    told = np.where(up != 0, np.arange(n), n)
    return up[np.minimum.accumulate(told[::-1])[::-1]] > 0


def _deal(waiting: list[list[np.ndarray]], items: np.ndarray, symbol: np.ndarray) -> None:
    """Append the items to the bucket of their symbol, in order."""
    if len(items):
        order = np.argsort(symbol, kind="stable")
        items, symbol = items[order], symbol[order]
        cuts = np.flatnonzero(np.diff(symbol)) + 1
        for c, part in zip(symbol[np.concatenate([[0], cuts])].tolist(), np.split(items, cuts)):
            waiting[c].append(part)


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array from LMS suffixes in order: one scan over the buckets for L suffixes, one backwards for S suffixes."""
    edges = np.searchsorted(s[lms], np.arange(sigma + 1))
    waiting: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    large: list[np.ndarray] = []
    for c in range(sigma):
        found, now = [], np.concatenate(waiting[c]) if waiting[c] else lms[:0]
        while len(now):
            found.append(now)
            before = now[now > 0] - 1
            before = before[~small[before]]
            symbol = s[before]
            _deal(waiting, before[symbol != c], symbol[symbol != c])
            now = before[symbol == c]
        large.append(np.concatenate(found) if found else lms[:0])
        before = lms[edges[c]:edges[c + 1]]
        before = before[before > 0] - 1
        _deal(waiting, before, s[before])
    waiting = [[] for _ in range(sigma)]
    waiting[int(s[-1])].append(np.array([len(s) - 1]))
    out: list[np.ndarray] = []
    for c in range(sigma - 1, -1, -1):
        found, now = [], np.concatenate(waiting[c]) if waiting[c] else lms[:0]
        while len(now):
            found.append(now)
            before = now[now > 0] - 1
            before = before[small[before]]
            symbol = s[before]
            _deal(waiting, before[symbol != c], symbol[symbol != c])
            now = before[symbol == c]
        out += [*found, large[c][::-1]]
        before = large[c][::-1]
        before = before[before > 0] - 1
        before = before[small[before]]
        _deal(waiting, before, s[before])
    return np.concatenate(out)[::-1]


def _rank(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
    rank = np.empty(len(key), np.int64)
    rank[order] = new
    return rank, order, int(new[-1]) + 1


def order_names(names: np.ndarray) -> np.ndarray:
    """Order of the reduced string's suffixes: each round names pairs of names anew, until all names differ."""
    rank, order, kinds = _rank(names)
    reach = 1
    while kinds < len(names):
        follow = np.zeros(len(names), np.int64)
        follow[:-reach] = rank[reach:] + 1
        rank, order, kinds = _rank(rank * (len(names) + 1) + follow)
        reach *= 2
    return order


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of integers below ``sigma`` that end with the only 0."""
    small = classify(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return induce(s, small, lms, sigma)
    rough = induce(s, small, lms[np.argsort(s[lms], kind="stable")], sigma)  # sorts the LMS substrings
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    stop = np.full(len(s), len(s))
    stop[lms[:-1]] = lms[1:] + 1
    end = stop[ordered]
    digest = bh.spans_hash(bh.prefix(s), ordered, end)
    new = np.concatenate([[0], np.cumsum((digest[1:] != digest[:-1]) | (np.diff(end - ordered) != 0))])
    name = np.empty(len(s), np.int64)
    name[ordered] = new
    return induce(s, small, lms[order_names(name[lms])], sigma)


def permuted_lcp(s: np.ndarray, sa: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, by text position, cut at ``COMPARED`` symbols.

    Only irreducible positions are compared (the symbols before both suffixes differ, or a region begins); any other
    value is one less than that of the position before.
    """
    n = len(s)
    phi = np.full(n, -1)
    phi[sa[1:]] = sa[:-1]
    left = s[np.maximum(phi - 1, 0)]
    irreducible = np.ones(n, bool)
    irreducible[1:] = left[1:] != s[:-1]
    irreducible[phi <= 0] = True
    irreducible[heads] = True
    at = np.flatnonzero(irreducible)
    padded = np.concatenate([s, np.zeros(COMPARED + 8, s.dtype)]).astype(np.uint16)
    lcp = np.zeros(len(at), np.int64)
    live = np.flatnonzero(phi[at] >= 0)
    while len(live):
        a, b = at[live] + lcp[live], phi[at[live]] + lcp[live]
        same = padded[a[:, None] + np.arange(8)] == padded[b[:, None] + np.arange(8)]
        run = np.where(same.all(1), 8, np.argmin(same, 1))
        lcp[live] += run
        live = live[(run == 8) & (lcp[live] < COMPARED)]
    base = np.maximum.accumulate(np.where(irreducible, np.arange(n), 0))
    values = np.zeros(n, np.int64)
    values[at] = lcp
    return np.maximum(values[base] - (np.arange(n) - base), 0)


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, the positions whose string of ``length`` bytes starts anywhere else in the parts as well."""
    sizes = np.array([len(p) for p in parts])
    s = np.ones(int(sizes.sum()) + len(parts) + 1, np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    joined = np.frombuffer(b"\x00".join(parts), np.uint8)
    s[:len(joined)] = joined + np.int64(2)
    s[begin + sizes] = 1
    s[-1] = 0
    sa = suffix_array(s, 258)
    lcp = permuted_lcp(s, sa, begin)
    twice = lcp >= length
    twice[sa[:-1]] |= lcp[sa[1:]] >= length
    return [np.flatnonzero(twice[b:b + max(0, n - length + 1)]) for b, n in zip(begin.tolist(), sizes.tolist())]


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive positions as (first, last + 1)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    return [(int(x[0]), int(x[-1]) + 1) for x in np.split(starts, cut)]


# ---- the job -------------------------------------------------------------------------------------------------------------

def _shard_spans(length: int):
    """Rows sorted by hash come in; whole hashes are gathered until the shard is full."""
    schema = pa.schema([("t", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64())])

    def solve(rows: list[tuple]) -> list[tuple]:
        out = []
        for (t, start, times, _), found in zip(rows, repeated_starts([r[3] for r in rows], length)):
            if times == 1:
                out += [(t, start + lo, start + hi) for lo, hi in runs(found)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, last = [], [], None
        for batch in batches:
            for h, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if h != last:
                    if len(held) + len(group) > SHARD_REGIONS and held:
                        if found := solve(held):
                            yield to_batch(found, schema)
                        held = []
                    held, group, last = held + group, [], h
                group.append(tuple(row))
        for part in ([held + group] if len(held) + len(group) <= SHARD_REGIONS else [held, group]):
            if part and (found := solve(part)):
                yield to_batch(found, schema)

    return run


def _digests(length: int):
    def make():
        return lambda r: [(xxhash.xxh3_128_digest(r["region"][i:i + length]), r["t"], r["start"] + i, r["times"])
                          for i in range(len(r["region"]) - length + 1)]

    return make


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Text key and ranges of repeated start positions (``t``, ``lo``, ``hi``)."""
    found = occurrences(docs, length)
    often = found.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    found = keep(found.join(often, "h", "left_semi"))
    # One row for each different region; rows of one text under equal region and start are copies of the text.
    kinds = keep(found.groupBy("h", "g").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("t", "start", "n")).alias("r"))
                 .select("h", "g", "times", "r.*"))
    equal = found.join(kinds.filter("times > 1").select("h", "g"), ["h", "g"], "left_semi") \
        .select("t", F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"))
    mixed = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("least")) \
        .filter("kinds > 1 and least = 1").select("h", "kinds")
    wanted = kinds.join(mixed, "h").groupBy("t").agg(F.collect_list(F.struct("h", "kinds", "times", "start", "n")).alias("parts"))
    texts = docs.select(text_key().alias("t"), raw_text().alias("raw")).filter(F.length("raw") >= length)

    def cut():
        return lambda r: [(p["h"], p["kinds"], r["t"], p["start"], p["times"], r["raw"][p["start"]:p["start"] + p["n"] + length - 1])
                          for p in r["parts"]]

    # Copies of a text bring the same regions again; one row of each remains.
    parts = map_rows(texts.join(wanted, "t"), cut, "h long, kinds long, t binary, start long, times long, region binary") \
        .dropDuplicates(["h", "t", "start"])
    parts = keep(parts)
    shards = parts.filter(F.col("kinds") <= SHARD_REGIONS).select("h", "t", "start", "times", "region") \
        .repartition("h").sortWithinPartitions("h")
    sorted_out = shards.mapInArrow(_shard_spans(length), "t binary, lo long, hi long")
    hot = map_rows(parts.filter(F.col("kinds") > SHARD_REGIONS).repartition("t", "start"), _digests(length),
                   "d binary, t binary, lo long, times long")
    counted = hot.groupBy("d").agg(F.count(F.lit(1)).alias("c"), F.min("times").alias("least")).filter("c > 1 and least = 1")
    counted = hot.filter("times = 1").join(counted.select("d"), "d", "left_semi").select("t", "lo", (F.col("lo") + 1).alias("hi"))
    return equal.unionByName(sorted_out).unionByName(counted)


def _removed(raw: bytes, spans: list[dict], length: int) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs, and what is left."""
    cover: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if cover and lo <= cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], hi + length - 1)
        else:
            cover.append([lo, hi + length - 1])
    left, at = [], 0
    for lo, hi in cover:
        left.append(raw[at:lo])
        at = hi
    return [(lo, hi) for lo, hi in cover], b"".join([*left, raw[at:]])


def suffix_dedup(docs: DataFrame, length: int = LENGTH, extra: bool = False) -> DataFrame:
    """One row per document: bytes, removed bytes and runs, digest of the rest; with ``extra`` also the runs and the rest."""
    spans = repeated_spans(docs, length).groupBy("t").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    rows = docs.select("doc_id", text_key().alias("t"), raw_text().alias("raw")).join(spans, "t", "left")

    def make():
        def step(r):
            cover, rest = _removed(r["raw"], r["spans"], length)
            out = (r["doc_id"], len(r["raw"]), sum(hi - lo for lo, hi in cover), len(cover), hashlib.sha256(rest).hexdigest())
            return [(*out, [{"lo": lo, "hi": hi} for lo, hi in cover], rest) if extra else out]

        return step

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind)] + T.StructType.fromDDL(
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        + (", removed array<struct<lo:long,hi:long>>, kept binary" if extra else "")).fields)
    return map_rows(rows.select("doc_id", "raw", "spans"), make, schema)
