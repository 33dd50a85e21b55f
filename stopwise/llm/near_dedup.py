"""Near-duplicate detection with bottom-k sketches.

A document's set are its distinct runs of five words.  Its sketch keeps the ``K`` smallest hashes of one hash function.

* Rows with equal sets are one class from the start.
* Inverted lists hold retained values.  A set enters the lists of the first values of its sketch only, in an order that puts
  values of very many documents last: of n values, the first n - ceil(0.75 n) + 1 must hold a common one when three quarters
  of the union are shared.  Sets of ``HALF`` values or more enter ``HALF`` lists, half of the sketch, so a pair is missed
  only when the sketches differ four standard deviations more than expected.
* The values in that last group are those in more than a ``FREQUENT``-th part of all retained ones, so there are at most
  ``FREQUENT`` of them whatever the input, and they can be broadcast.
* A list brings forth links between each member and one pivot per round, not all pairs, and each member is compared with the
  ``PARTNERS`` pivots it shares most lists with.  Pairs are filtered by the overlap
  estimated from the union of both sketches, then confirmed on the full sets.  Rounds go on with other pivots while some
  list holds more than one component; members of one component need no comparison any more.  When rounds merge next to nothing, all
  remaining pairs between different components of a list are compared, so no link between components is lost.
* Inside the lists a pair is passed on only if the sizes allow a link and the sets are close enough in a bit signature: sets
  of na and nb values with three quarters of their union in common differ in (na + nb) / 7 values at most, and never in more
  bits.  The signature holds the ``SIGNED`` smallest values.  Larger sets at the limit are about 61 bits apart when equally
  large and 97 when one is three quarters of the other, give or take 10; five times that or more is added.  Its halves are
  combined, which only brings signatures closer.
* The texts of a round are fetched for the pairs that are left to confirm, by a bitmap of fixed size (``store.marked``).
* Components grow by the smallest id along confirmed links.

Null and empty texts and texts without words have empty sets and no links.  Repeated ids and rows are members of the class of
their set each; null ids never become the name of a component that has another.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise.llm import bytehash as bh
from stopwise.llm.store import freeing_shuffles, keep, map_rows, marked, raw_text, text_key

WORDS = 5
K = 64
HALF = 32
FREQUENT = 1 << 19
LEAST_FREQUENT = 8
ROUNDS = 3
#: A round of pivots that links fewer than this share of the linked sets is the last one before all pairs are compared.
LEAST_MERGED = 0.01
PARTNERS = 4
SIGNED = 256
SIGNATURE = [f"s{i}" for i in range(8)]
SAMPLED_APART, UNEQUAL_APART = 119, 140
#: Estimates this low are no links; the error of an estimate from 64 values is about 0.054 at 0.75.
LEAST_ESTIMATE = 0.5


def shingles(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word runs; a text of fewer words is one run."""
    h, _, _ = bh.words(raw, bh.SPACES)
    return np.unique(bh.grams(h, min(words, len(h)))) if len(h) else np.zeros(0, np.uint64)


def set_digest(s: np.ndarray) -> bytes:
    """128-bit digest of a whole set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def list_values(sketch: np.ndarray, size: int, frequent: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The values whose lists a set enters; ``frequent`` is sorted, ``weight`` is larger for more frequent values."""
    heavy = np.zeros(len(sketch), weight.dtype)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, sketch), len(frequent) - 1)
        heavy = np.where(frequent[at] == sketch, weight[at], heavy)
    first = size - -(-3 * size // 4) + 1
    return sketch[np.lexsort((sketch, heavy))[:max(first, HALF) if size >= HALF else first]]


def signature(s: np.ndarray) -> list[int]:
    """1,024 bits, set at the places of the smallest values; the halves are combined, which brings no two signatures farther apart."""
    bits = np.zeros(128 * len(SIGNATURE), np.uint8)
    bits[(bh.mix(s[:SIGNED]) >> np.uint64(54)).astype(np.int64)] = 1
    halves = np.packbits(bits).view(np.int64).reshape(2, -1)
    return (halves[0] ^ halves[1]).tolist()


def sketched(docs: DataFrame) -> DataFrame:
    """Per row: size of its set, digest of the whole set, and the sketch."""
    def make():
        def step(r):
            s = shingles(r["raw"])
            if not len(s):
                return [(r["doc_id"], r["t"], 0, None, None, *[None] * len(SIGNATURE))]
            return [(r["doc_id"], r["t"], len(s), set_digest(s), s[:K].tobytes(), *signature(s))]

        return step

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind)] + T.StructType.fromDDL(
        "t binary, n long, digest binary, sketch binary, " + ", ".join(f"{c} long" for c in SIGNATURE)).fields)
    return map_rows(docs.select("doc_id", text_key().alias("t"), raw_text().alias("raw")), make, schema)


def estimate(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Similarity from the k smallest values of the union of two sketches."""
    union = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1])) / len(union)


def _frequent(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Retained values of very many sets with the binary logarithm of their number."""
    rows = classes.select("sketch")

    def make():
        return lambda r: [(v,) for v in np.frombuffer(r["sketch"], np.int64).tolist()]

    least = max(LEAST_FREQUENT, classes.count() * K // FREQUENT + 1)
    with freeing_shuffles(classes.sparkSession):
        found = map_rows(rows, make, "v long", 20_000).groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).toArrow()
    values, n = found["v"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(values)
    return values[order], np.log2(np.maximum(n[order], 1)).astype(np.int8)


def _lists(classes: DataFrame) -> DataFrame:
    """Inverted lists with two members or more: ``key``, ``id``."""
    shared_values = classes.sparkSession.sparkContext.broadcast(_frequent(classes))

    def make():
        frequent, weight = shared_values.value
        return lambda r: [(k, r["id"]) for k in list_values(
            np.frombuffer(r["sketch"], np.uint64), r["n"], frequent, weight).view(np.int64).tolist()]

    kind = classes.schema["id"].dataType
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", kind)])
    rows = map_rows(classes.select("id", "n", "sketch"), make, schema, 20_000)
    shared = keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"))
    return keep(marked(rows, "key", shared).filter("marked").drop("marked").join(shared, "key", "left_semi"))


def _needed(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of a table by ``id`` that take part in stored pairs; few pairs are broadcast by their file size, and nothing else is shuffled."""
    return table.join(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), "id", "left_semi")


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose estimate allows a link."""
    classes = _needed(classes.select("id", "n", "sketch"), pairs)
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b") \
        .filter("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)")

    def make():
        def step(r):
            a, b = (np.frombuffer(r[x], np.uint64) for x in ("s_a", "s_b"))
            return [(r["a"], r["b"])] if estimate(a, b) >= LEAST_ESTIMATE else []

        return step

    return map_rows(both.select("a", "b", "s_a", "s_b"), make, pairs.schema)


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs with 100 * intersection >= 75 * union on the full sets."""
    side = lambda x: texts.select(F.col("id").alias(x), F.col("raw").alias(f"m_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def make():
        def step(r):
            a, b = shingles(r["m_a"]), shingles(r["m_b"])
            common = len(np.intersect1d(a, b, assume_unique=True))
            return [(r["a"], r["b"])] if 100 * common >= 75 * (len(a) + len(b) - common) else []

        return step

    return map_rows(both.select("a", "b", "m_a", "m_b"), make, pairs.schema)


def components(edges: DataFrame) -> DataFrame:
    """``id, comp`` (smallest id reachable) of every vertex of an edge table (``a``, ``b``), by label passing and pointer jumps.

    Each round writes its table to the shared folder.  The loop ends when no label changes.
    """
    both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select(
            "id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        step = keep(step)
        # Jump: the label of the label is a smaller label of the same component.
        jump = step.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        new = keep(step.join(jump, "comp", "left").select("id", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")))
        changed = new.filter("old <> comp").limit(1).count()
        labels = new.select("id", "comp")
        if not changed:
            return labels


def _signed(classes: DataFrame, suffix: str) -> DataFrame:
    return classes.select(F.col("id").alias(f"id_{suffix}"), *[F.col(c).alias(f"{c}_{suffix}") for c in ("n", *SIGNATURE)])


def _may_link(a: str, b: str) -> Column:
    """Whether sizes and signatures of two sets allow a link."""
    na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
    apart = sum((F.bit_count(F.col(f"{s}_{a}").bitwiseXOR(F.col(f"{s}_{b}"))) for s in SIGNATURE), F.lit(0))
    bound = F.when(F.greatest(na, nb) <= SIGNED, F.floor((na + nb) / 7)).otherwise(
        SAMPLED_APART + UNEQUAL_APART * (1 - F.least(na, nb) / F.greatest(na, nb)))
    return (100 * F.least(na, nb) >= 75 * F.greatest(na, nb)) & (apart <= bound)


def _pivot_pairs(open_lists: DataFrame, classes: DataFrame, salt: int) -> DataFrame:
    """Each member with the pivots of its lists, those first that it shares most lists with, across components only."""
    order = F.xxhash64("id", F.lit(salt)) if salt else F.col("id")
    pivots = open_lists.groupBy("key").agg(F.min(F.struct(order.alias("o"), "id", "comp")).alias("p")).select("key", F.col("p.id").alias("p"), F.col("p.comp").alias("pc"))
    pairs = open_lists.join(pivots, "key").filter("pc <> comp").groupBy("id", "p").agg(F.count(F.lit(1)).alias("n"))
    best = pairs.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "p"))).filter(F.col("k") <= PARTNERS)
    best = best.select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b")).distinct()
    return best.join(_signed(classes, "a"), F.col("a") == F.col("id_a")) \
        .join(_signed(classes, "b"), (F.col("b") == F.col("id_b")) & _may_link("a", "b")).select("a", "b")


def _all_pairs(open_lists: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs of members of a list that are in different components and may be linked, each in its first common list only.

    Every entry knows the lists that its set is in before this one; when two entries share one of those, the pair is met there.
    """
    keys = open_lists.groupBy("id").agg(F.min("comp").alias("comp"), F.sort_array(F.collect_list("key")).alias("keys"))
    rows = keys.join(classes.select("id", "n", *SIGNATURE), "id").select("id", "comp", "n", *SIGNATURE, "keys", F.posexplode("keys").alias("at", "key"))
    rows = rows.withColumn("before", F.slice("keys", F.lit(1), F.col("at"))).drop("keys", "at")
    left, right = (rows.select(*[F.col(c).alias(f"{c}_{side}") for c in rows.columns]) for side in "ab")
    on = (F.col("key_a") == F.col("key_b")) & (F.col("id_a") < F.col("id_b")) & (F.col("comp_a") != F.col("comp_b")) & _may_link("a", "b") \
        & ~F.arrays_overlap("before_a", "before_b")
    return left.join(right, on).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def _open(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Lists that hold more than one component, with the component of each member."""
    if labels is None:
        return lists.withColumn("comp", F.col("id"))
    told = lists.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    told = keep(told)
    many = told.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    return keep(told.join(many, "key", "left_semi"))


def _texts(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, raw`` of the classes in the pairs: the text of one row each, which is smaller than its set of hashes.

    A round confirms few of the pairs that share a list, so only their texts are moved.
    """
    wanted = keep(_needed(classes.select("id", "t"), pairs))
    rows = marked(docs.select(text_key().alias("t"), raw_text().alias("raw")), "t", wanted).filter("marked").drop("marked")
    return keep(rows.join(wanted, "t").dropDuplicates(["t"]).select("id", "raw"))


def links(docs: DataFrame, classes: DataFrame) -> DataFrame | None:
    """``id, comp`` of the classes that are linked with another one, None without links."""
    lists = _lists(classes)
    if lists.isEmpty():
        return None
    linked = tested = labels = None
    salt = 0
    while True:
        now = _open(lists, labels)
        with freeing_shuffles(docs.sparkSession):
            sizes = now.groupBy("key").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("rows"), F.sum(F.col("c") * F.col("c")).alias("pairs")).first()
        if not sizes["rows"]:
            return labels
        # Comparing everything left costs no more than a few rounds of pivots, or the rounds have stopped merging.
        last = salt > ROUNDS or sizes["pairs"] <= 8 * sizes["rows"]
        pairs = _all_pairs(now, classes) if last else _pivot_pairs(now, classes, salt)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = keep(pairs)
        close = keep(_estimated(pairs, classes))
        found = keep(_confirmed(close, _texts(docs, classes, close)))
        merged = found.count()
        if merged:
            linked = found if linked is None else linked.unionByName(found)
            labels = components(linked)
        if salt and (labels is None or merged < LEAST_MERGED * labels.count()):
            salt = ROUNDS
        if last:
            return labels
        tested = pairs if tested is None else tested.unionByName(pairs)
        salt += 1


def near_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row."""
    docs = docs.select("doc_id", "text")
    rows = keep(sketched(docs).withColumn("row", F.monotonically_increasing_id()))
    classes = keep(rows.filter("n > 0").groupBy("digest").agg(
        F.min("row").alias("id"), F.min("doc_id").alias("doc_id"), F.min("t").alias("t"), *[F.first(c).alias(c) for c in ("n", "sketch", *SIGNATURE)]))
    labels = links(docs, classes)
    named = classes.select("digest", "doc_id", F.col("id").alias("comp"))
    if labels is not None:
        named = classes.select("digest", "doc_id", "id").join(labels, "id", "left").select("digest", "doc_id", F.coalesce("comp", "id").alias("comp"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = named.select("digest", "comp").join(least, "comp").select("digest", "component_id")
    linked = rows.filter("n > 0").select("doc_id", "n", "digest").join(named, "digest").select("doc_id", "n", "component_id")
    alone = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
  list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.x, p.y FROM reach JOIN p ON reach.y = p.x)
SELECT doc_id, len(sh) AS n_shingles, min(y) AS component_id, doc_id = min(y) AS kept FROM s JOIN reach ON doc_id = x GROUP BY doc_id, sh
"""
