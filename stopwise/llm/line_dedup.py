"""Line deduplication: repeated runs of lines, and by content-defined chunks of lines.

``run_dedup`` (operator 2 and the pipeline) removes every run of whole lines with more than ``LEAST_WORDS`` words that occurs at
an earlier place, one-line runs included.

* Chunks are the seeds.  From each line on and up to each line the shortest stretch above that number of words is looked at.  A rolling
  hash over the last ``WINDOW`` line hashes sets boundaries where it is divisible by ``SPACING``; the stretch's chunk lies between its
  first and its last boundary, judged by its own lines alone.  A stretch without two boundaries, or with few words between them, is a
  chunk as a whole, one-line ones too.  So equal stretches have equal chunks, and a repeated run holds a repeated chunk.
* Occurrences of a repeated chunk grow line by line, on both sides, to the stretches that hold it; equal ones meet by 128-bit hashes of
  their lines, and each later one is paired with the first.  Pairs of two texts that lie at the same distance join to whole runs.
* The bytes of a run are compared with those of its first occurrence (they are grouped by their bytes).  If any differ, the stretches
  of these hashes are grouped by their own bytes instead.
* Which stretches are the shortest depends on nothing but their own lines, and those inside a run cover all of its lines, so a line goes
  exactly if one of its stretches occurs earlier; no run is missed and none is cut short.

The first occurrence stays: the one with the smallest id (null ids last), then the smallest text digest, then the first place; a copy
that overlaps it in the same text loses the rest only.  Words are separated by white space; a line counts at least one word per
``WORD_BYTES`` bytes, for scripts without spaces.  Texts are moved for the comparison and at the end only where a bitmap of the
wanted rows says so (``store.marked``).

``line_dedup`` is the coarser rule of chunks.  A rolling hash over the last ``WINDOW`` line hashes ends a chunk where it is divisible
by ``SPACING``, so a boundary depends on nothing but the lines before it.  Only chunks of at least two lines count, and at the ends
of a passage a chunk also holds lines of its surroundings, so many repeated passages stay in part or whole.
Chunks whose hash occurs more than once are compared byte by byte (they are grouped by their bytes), and all but the first
occurrence are removed.

Repeated rows, alike in id and text, are one document: all of them lose the same lines.  Null texts stay null.
"""

from __future__ import annotations


import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise.llm.bytehash import WORD_BASE, mix, powers, spans_hash
from stopwise.llm.store import keep, map_rows, marked, raw_text

WINDOW = 2
SPACING = 2
LEAST_LINES = 2
LEAST_WORDS = 50
WORD_BYTES = 16


def boundaries(hashes: np.ndarray, window: int = WINDOW, spacing: int = SPACING) -> np.ndarray:
    """Numbers of the lines before which a chunk ends; each is judged by the hashes of the ``window`` lines before it."""
    rolled = hashes.copy()
    factor = 1
    for j in range(1, min(window, len(hashes))):
        factor = factor * WORD_BASE % (1 << 64)
        rolled[j:] += hashes[:-j] * np.uint64(factor)
    return np.flatnonzero(mix(rolled) % np.uint64(spacing) == 0) + 1


def line_chunks(raw: bytes, window: int = WINDOW, spacing: int = SPACING) -> list[tuple[int, int, int, int]]:
    """(hash, first line, number of lines, first byte) of each chunk; the last item holds the end of the text."""
    lines = raw.split(b"\n")
    hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64)
    ends = np.unique(np.append(boundaries(hashes, window, spacing), len(lines)))
    begins = np.concatenate([[0], ends[:-1]])
    offsets = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])
    out = []
    for lo, hi in zip(begins.tolist(), ends.tolist()):
        out.append((xxhash.xxh3_64_intdigest(raw[offsets[lo]:offsets[hi] - 1]) - (1 << 63), lo, hi - lo, int(offsets[lo])))
    return [*out, (0, len(lines), 0, len(raw) + 1)]


def _row_key():
    """Rows alike in id and text share a key."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), raw_text())))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Occurrences to remove: ``key`` of the row and the numbers of its chunks (``gone``)."""
    rows = docs.select(_row_key().alias("key"), "doc_id", raw_text().alias("raw")).filter(F.length("raw") > 0)
    kind = docs.schema["doc_id"].dataType
    place = [T.StructField("key", T.BinaryType()), T.StructField("doc_id", kind), T.StructField("chunk", T.IntegerType()),
             T.StructField("h", T.LongType())]

    def listed():
        def step(r):
            return [(r["key"], r["doc_id"], i, c[0]) for i, c in enumerate(line_chunks(r["raw"])) if c[2] >= LEAST_LINES]

        return step

    chunks = keep(map_rows(rows, listed, T.StructType(place)))
    twice = chunks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    wanted = chunks.join(twice, "h", "left_semi").groupBy("key").agg(F.collect_set("chunk").alias("chunks"))

    def with_bytes():
        def step(r):
            c = line_chunks(r["raw"])
            return [(r["key"], r["doc_id"], i, c[i][0], r["raw"][c[i][3]:c[i + 1][3] - 1]) for i in r["chunks"]]

        return step

    found = map_rows(rows.join(wanted, "key"), with_bytes, T.StructType([*place, T.StructField("bytes", T.BinaryType())]))
    found = keep(found.withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "chunk")))
    # Grouping by the bytes compares them; every text under a hash gets the place of its first occurrence.
    first = keep(found.groupBy("h", "bytes").agg(F.min("place").alias("first")))
    ambiguous = first.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    plain = found.drop("bytes").join(first.drop("bytes").join(ambiguous, "h", "left_anti"), "h")
    mixed = found.join(ambiguous, "h", "left_semi").join(first, ["h", "bytes"]).drop("bytes")
    gone = plain.unionByName(mixed).filter((F.col("first.key") != F.col("key")) | (F.col("first.chunk") != F.col("chunk")))
    return gone.groupBy("key").agg(F.collect_set("chunk").alias("gone"))


COUNTS = ("n_lines", "n_removed_lines", "n_removed_chunks")


def line_dedup(docs: DataFrame) -> DataFrame:
    """The rows with the remaining ``text`` and the columns ``COUNTS`` (which replace input columns of these names)."""
    docs = docs.drop(*COUNTS, "_key", "_gone")
    gone = repeated_chunks(docs).withColumnsRenamed({"key": "_key", "gone": "_gone"})
    touched = docs.withColumn("_key", _row_key()).join(gone, "_key", "left").drop("_key")
    names = docs.columns

    def make():
        def step(r):
            text = r["text"]
            if text is None:
                return [(*(r[c] for c in names), 0, 0, 0)]
            if not r["_gone"]:
                return [(*(r[c] for c in names), text.count("\n") + 1, 0, 0)]
            raw, gone = text.encode(), set(r["_gone"])
            c = line_chunks(raw)
            left = b"".join(raw[a[3]:b[3]] for i, (a, b) in enumerate(zip(c, c[1:])) if i not in gone)
            clean = left.removesuffix(b"\n") if len(c) - 2 in gone else left
            r["text"] = clean.decode()
            return [(*(r[x] for x in names), c[-1][1], sum(c[i][2] for i in gone), len(gone))]

        return step

    return map_rows(touched, make, T.StructType(docs.schema.fields + [T.StructField(c, T.LongType()) for c in COUNTS]))


def line_table(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each line, and its 128-bit digest as two numbers."""
    lines = raw.split(b"\n")
    words = np.array([max(len(x.split()), len(x) // WORD_BYTES) for x in lines], np.int64)
    return words, np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in lines), np.uint64).reshape(-1, 2)


def stretches(words: np.ndarray, digests: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First line and end of the shortest stretches with more words, from each line on and up to each line, and of the chunk of each."""
    n = len(words)
    total = np.zeros(n + 1, np.int64)
    np.cumsum(words, out=total[1:])
    ends = np.searchsorted(total, total[:-1] + least_words, "right")
    begins = np.searchsorted(total, total[1:] - least_words, "left") - 1
    ahead, back = np.flatnonzero(ends <= n), np.flatnonzero(begins >= 0)
    pairs = np.unique(np.concatenate([np.stack([ahead, ends[ahead]], 1), np.stack([begins[back], back + 1], 1)]), axis=0)
    lo, hi = pairs[:, 0], pairs[:, 1]
    cuts = boundaries(digests[:, 0])
    if not len(cuts):
        return lo, hi, lo, hi
    first = cuts[np.minimum(np.searchsorted(cuts, lo + WINDOW, "left"), len(cuts) - 1)]
    last = cuts[np.maximum(np.searchsorted(cuts, hi, "right") - 1, 0)]
    between = (lo < first) & (first < last) & (last <= hi)
    between[between] = (total[last[between]] - total[first[between]]) * 2 > least_words
    return lo, hi, np.where(between, first, lo), np.where(between, last, hi)


def line_hashes(digests: np.ndarray, half: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of each stretch of lines, from one half of their digests."""
    n = len(digests)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(digests[:, half]) * powers(n)[0][:n], out=sums[1:])
    return spans_hash(sums, lo, hi).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_row_key().alias("key"), "doc_id", raw_text().alias("raw")).filter(F.length("raw") > 0)


def _grown(docs: DataFrame, least_words: int) -> DataFrame:
    """The stretches that hold a repeated chunk: ``key, doc_id, at, n, h, g``."""
    kind = docs.schema["doc_id"].dataType
    place = [T.StructField("key", T.BinaryType()), T.StructField("doc_id", kind)]

    def listed():
        def step(r):
            words, digests = line_table(r["raw"])
            if words.sum() <= least_words:
                return []
            lo, hi = np.unique(np.stack(stretches(words, digests, least_words)[2:], 1), axis=0).T
            return [(r["key"], r["doc_id"], words.astype(np.uint32).tobytes(), digests.tobytes(), line_hashes(digests, 0, lo, hi).tolist())]

        return step

    lines = keep(map_rows(_keyed(docs), listed, T.StructType([*place, *T.StructType.fromDDL("words binary, digests binary, chunks array<long>").fields])))
    chunks = lines.select("key", F.explode("chunks").alias("c"))
    twice = chunks.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("c")
    wanted = chunks.join(twice, "c", "left_semi").groupBy("key").agg(F.collect_set("c").alias("wanted"))

    def grown():
        def step(r):
            words, digests = np.frombuffer(r["words"], np.uint32).astype(np.int64), np.frombuffer(r["digests"], np.uint64).reshape(-1, 2)
            lo, hi, first, last = stretches(words, digests, least_words)
            hold = np.isin(line_hashes(digests, 0, first, last), np.array(r["wanted"], np.int64))
            lo, hi = lo[hold], hi[hold]
            found = (line_hashes(digests, half, lo, hi).tolist() for half in (0, 1))
            return [(r["key"], r["doc_id"], *w) for w in zip(lo.tolist(), (hi - lo).tolist(), *found)]

        return step

    fields = T.StructType([*place, *T.StructType.fromDDL("at int, n int, h long, g long").fields])
    return map_rows(lines.drop("chunks").join(wanted, "key"), grown, fields)


def _later(windows: DataFrame, same: list[str]) -> DataFrame:
    """Each later one of equal stretches with the place of the first: ``key, at, n, fkey, fat`` and the columns ``same``."""
    twice = windows.groupBy(*same).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(*same)
    windows = keep(windows.join(twice, same, "left_semi"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "at")
    first = windows.groupBy(*same).agg(F.min(place).alias("first")).select(*same, F.col("first.key").alias("fkey"), F.col("first.at").alias("fat"))
    return windows.join(first, same).filter((F.col("fkey") != F.col("key")) | (F.col("fat") != F.col("at"))).drop("doc_id")


def _runs(later: DataFrame) -> DataFrame:
    """Pairs of two texts joined to runs of lines, ``lo`` to ``hi`` of ``key`` like those from ``flo`` on of ``fkey``."""
    pairs = later.groupBy("key", "fkey", (F.col("at") - F.col("fat")).alias("apart")).agg(F.collect_set(F.struct("at", "n")).alias("found"))

    def make():
        def step(r):
            runs = []
            for lo, hi in sorted((x["at"], x["at"] + x["n"]) for x in r["found"]):
                if runs and lo <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], hi)
                else:
                    runs.append([lo, hi])
            return [(r["key"], r["fkey"], lo, hi, lo - r["apart"]) for lo, hi in runs]

        return step

    return map_rows(pairs, make, "key binary, fkey binary, lo int, hi int, flo int")


def _bytes(docs: DataFrame, wanted: DataFrame, names: list[str]) -> DataFrame:
    """The wanted stretches (``key, at, n`` and the columns ``names``) with their ``bytes``."""
    asked = keep(wanted.groupBy("key").agg(F.collect_set(F.struct("at", "n", *names)).alias("asked")))
    rows = marked(_keyed(docs), "key", asked).filter("marked").drop("marked").join(asked, "key")

    def make():
        def step(r):
            lines = r["raw"].split(b"\n")
            return [(r["key"], r["doc_id"], *(x[c] for c in ("at", "n", *names)), b"\n".join(lines[x["at"]:x["at"] + x["n"]])) for x in r["asked"]]

        return step

    fields = [*rows.schema.fields[:2], *asked.schema["asked"].dataType.elementType.fields, T.StructField("bytes", T.BinaryType())]
    return map_rows(rows, make, T.StructType(fields))


def _unlike(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """First occurrences that differ in a byte from one of the runs paired with them: ``fkey, flo, n``."""
    runs = runs.withColumn("n", F.col("hi") - F.col("lo"))
    sides = runs.select("key", F.col("lo").alias("at"), "n", "fkey", "flo").unionByName(
        runs.select(F.col("fkey").alias("key"), F.col("flo").alias("at"), "n", "fkey", "flo").distinct())
    texts = _bytes(docs, sides, ["fkey", "flo"]).groupBy("fkey", "flo", "n", "bytes").agg(F.count(F.lit(1)).alias("c"))
    return texts.groupBy("fkey", "flo", "n").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")


#: What equal stretches have in common before their bytes are compared.
ALIKE = ["h", "g", "n"]


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Lines to remove: ``key`` of the row and ranges of its lines (``gone``: first, end)."""
    windows = keep(_grown(docs, least_words))
    later = keep(_later(windows, ALIKE))
    unlike = keep(_unlike(docs, keep(_runs(later))))
    if not unlike.isEmpty():
        place = (F.col("l.fkey") == F.col("u.fkey")) & F.col("l.fat").between(F.col("u.flo"), F.col("u.flo") + F.col("u.n") - 1)
        mixed = keep(later.alias("l").join(unlike.alias("u"), place).select(*[f"l.{c}" for c in ALIKE]).distinct())
        names = [c for c in ALIKE if c != "n"]
        told = _bytes(docs, windows.join(mixed, ALIKE, "left_semi"), names)
        pairs = ["key", "at", "n", "fkey", "fat"]
        later = later.join(mixed, ALIKE, "left_anti").select(pairs).unionByName(_later(told, [*ALIKE, "bytes"]).select(pairs))
    same = F.col("fkey") == F.col("key")
    lo = F.when(same, F.greatest(F.col("at"), F.col("fat") + F.col("n"))).otherwise(F.col("at"))
    ranges = later.select("key", lo.alias("lo"), (F.col("at") + F.col("n")).alias("hi")).filter("lo < hi")
    return ranges.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("gone"))


def run_dedup(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """As ``line_dedup``, by repeated runs of lines; ``n_removed_chunks`` counts the stretches taken out."""
    docs = docs.drop(*COUNTS, "_key", "_gone")
    names = docs.columns
    gone = keep(repeated_runs(docs, least_words).withColumnsRenamed({"key": "_key", "gone": "_gone"}))
    rows = marked(docs.select(F.struct("*").alias("row"), _row_key().alias("_key")), "_key", gone)
    touched = rows.filter("marked").join(gone, "_key", "left").select("row.*", "_gone").unionByName(
        rows.filter("not marked").select("row.*", F.lit(None).cast(gone.schema["_gone"].dataType).alias("_gone")))

    def make():
        def step(r):
            text = r["text"]
            if text is None:
                return [(*(r[c] for c in names), 0, 0, 0)]
            if not r["_gone"]:
                return [(*(r[c] for c in names), text.count("\n") + 1, 0, 0)]
            lines = text.split("\n")
            out = np.zeros(len(lines) + 1, np.int8)
            for x in r["_gone"]:
                out[x["lo"]:x["hi"]] = 1
            r["text"] = "\n".join(x for x, o in zip(lines, out.tolist()) if not o)
            return [(*(r[x] for x in names), len(lines), int(out.sum(dtype=np.int64)), int((np.diff(out, prepend=0) == 1).sum()))]

        return step

    return map_rows(touched, make, T.StructType(docs.schema.fields + [T.StructField(c, T.LongType()) for c in COUNTS]))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: lines, removed lines and stretches, and the digest of the remaining text."""
    return run_dedup(docs.select("doc_id", "text")).select("doc_id", *COUNTS, F.sha2(raw_text(), 256).alias("kept_sha256"))
