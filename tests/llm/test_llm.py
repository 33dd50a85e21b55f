"""Text operators against brute-force versions on small fixtures: nulls, empties, ties, repeats, long texts, odd columns."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise.llm import (
    decontaminate, exact_dedup, line_dedup, main_text, near_dedup, personal_data, quality, spm_tokens, suffix_dedup, toxicity)
from stopwise.llm.store import FREE_SHUFFLES, keep, marked

from ..conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage, base = words(rng, 70), words(rng, 120)
    out = [(1, None), (2, ""), (3, "  \n "), (None, "a b c"), (4, "A b C"), (4, "A b C"), (5, base), (6, re.sub("[a-z]", lambda m: m.group().upper(), base)), (7, base + " tail"),
           (8, words(rng, 40) + "\n" + passage + "\n" + words(rng, 40)), (9, words(rng, 30) + " " + passage), (10, "x" * 5000),
           (11, words(rng, 6000)), (12, "one two three four"), (13, "one two three four"), (14, base.replace(" ", "\n", 30))]
    lines = [words(rng, 12) for _ in range(30)]
    out += [(15, "\n".join(lines)), (16, "\n".join(["first"] + lines[3:25] + ["last"])), (17, "\n".join(lines))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def test_suffix_array_and_prefixes():
    import numpy as np
    rng = random.Random(2)
    for _ in range(60):
        s = np.array([rng.randint(1, rng.choice([1, 2, 9])) for _ in range(rng.randint(0, 50))] + [0])
        order = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        sa = suffix_dedup.suffix_array(s, 258)
        assert sa.tolist() == order
        lcp = suffix_dedup.permuted_lcp(s, sa, np.array([0]))
        for a, b in zip(order, order[1:]):
            n = 0
            while s[a + n] == s[b + n]:
                n += 1
            assert lcp[b] == n


@pytest.mark.parametrize("shard", [6000, 1])
def test_suffix_dedup(monkeypatch, docs, rows, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_REGIONS", shard)
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + 200] for _, b in raw for k in range(len(b) - 199))
    want = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        rest = bytes(x for x, y in zip(b, gone) if not y)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    assert Counter(map(tuple, suffix_dedup.suffix_dedup(docs).collect())) == Counter(want)


def test_near_dedup(docs, rows):
    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", fold(t))
        return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    want = []
    for k, (i, _) in enumerate(rows):
        named = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[k] and rows[j][0] is not None]
        least = min(named) if named else None
        want.append((i, len(sets[k]), least if sets[k] else i, i == (least if sets[k] else i)))
    assert Counter(map(tuple, near_dedup.near_dedup(docs).collect())) == Counter(want)


def test_exact_dedup(docs, rows):
    groups = Counter(fold(t) for _, t in rows)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    best = {}
    for i, t in rows:
        best[fold(t)] = max(best.get(fold(t), i) or -1, i or -1)
    digest = {hashlib.sha256(k.encode()).hexdigest(): k for k in groups}
    for r in got:
        assert (r.keep_id if r.keep_id is not None else -1, r.group_size) == (best[digest[r.text_sha256]], groups[digest[r.text_sha256]])
    assert Counter(digest[r.text_sha256] for r in got if r.kept) == Counter(dict.fromkeys(groups, 1))


def test_exact_dedup_collision(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    got = exact_dedup.exact_dedup(docs.filter("doc_id in (5, 6, 7, 11, 12, 13)")).collect()
    assert {(r.doc_id, r.keep_id) for r in got} == {(5, 6), (6, 6), (7, 7), (11, 11), (12, 13), (13, 13)}


def test_line_dedup(docs, rows):
    chunks = []
    for k, (i, t) in enumerate(rows):
        raw = (t or "").encode()
        c = line_dedup.line_chunks(raw) if raw else []
        chunks.append([(a[2], raw[a[3]:b[3] - 1]) for a, b in zip(c, c[1:])])
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).filter("doc_id > 13").collect()}
    first, left = {}, {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        out = []
        for n, b in chunks[k]:
            if n < 2 or first.setdefault(b, rows[k][0]) == rows[k][0]:
                out.append(b)
        left[rows[k][0]] = b"\n".join(out).decode()
    for i in (14, 15, 16, 17):
        assert got[i].text == left[i]
    assert got[16].n_removed_lines > 0 and got[17].n_removed_lines > 0 == got[15].n_removed_lines


def test_run_dedup(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 2, 3, 5, 12, 14]))) for _ in range(60)]
    passages = [rng.choices(pool, k=rng.randint(1, 6)) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else [words(rng, rng.randint(1, 15))] for _ in range(rng.randint(1, 6))]
        texts.append("\n".join(x for p in parts for x in p))
    texts += ["\n".join(["a b c d"] * 12), "x y\n" * 20, "\n" * 30 + pool[0], None, ""]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(1, texts[1])]
    key = lambda i, t: hashlib.md5(f"{'-' if i is None else i}:{t or ''}".encode()).digest()
    first, want = {}, {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, key(*r))):
        if t is None:
            want[i, t] = (None, 0)
            continue
        part, gone = t.split("\n"), set()
        for a in range(len(part)):
            for b in range(a + 1, len(part) + 1):
                if sum(len(x.split()) for x in part[a:b]) > 10:
                    owner, at = first.setdefault(tuple(part[a:b]), ((i, t), a))
                    gone.update(range(a if owner != (i, t) else max(a, at + b - a) if at != a else b, b))
        want[i, t] = ("\n".join(x for k, x in enumerate(part) if k not in gone), len(gone))
    got = line_dedup.run_dedup(spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, before string"), 10).collect()
    assert Counter((r.doc_id, r.before, r.text, r.n_removed_lines) for r in got) == Counter((i, t, *want[i, t]) for i, t in rows)
    assert sum(n for _, n in want.values()) > 100


def test_run_dedup_short_runs(spark):
    rng = random.Random(9)
    one, two = words(rng, 60), words(rng, 30) + "\n" + words(rng, 30)
    texts = [one, two, "top\n" + one + "\nend", "top\n" + two + "\nend", two.split("\n")[0]]
    got = {r.doc_id: r.text for r in line_dedup.run_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(5)] == [one, two, "top\nend", "top\nend", texts[4]]


def test_run_dedup_compares_bytes(spark, monkeypatch):
    """Stretches that meet although their lines differ are told apart by their bytes."""
    monkeypatch.setattr(line_dedup, "ALIKE", ["n"])
    test_run_dedup(spark)


def test_pipeline_line_stage_compares_bytes(spark, monkeypatch):
    """The line stage of the pipeline removes equal runs only, also where the hashes of different ones are alike."""
    import corpus_pipeline

    monkeypatch.setattr(line_dedup, "ALIKE", ["n"])
    rng = random.Random(11)
    one, two, three = (words(rng, 60) for _ in range(3))
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"x\n{two}"), (4, one), (5, three), (6, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {1: one, 2: two, 3: "x", 5: three, 6: None}


def test_run_dedup_chunks(spark):
    """A chunk depends on the lines of its stretch alone, and some are shorter than their stretch."""
    rng = random.Random(10)
    run = [words(rng, 3) for _ in range(40)]
    seen = []
    for before, after in ((["x y"], []), ([], ["x y z"]), ([words(rng, 4) for _ in range(7)], [words(rng, 2)])):
        count, digests = line_dedup.line_table("\n".join([*before, *run, *after]).encode())
        found = line_dedup.stretches(count, digests, 50)
        k = len(before)
        seen.append({tuple(int(x) - k for x in r) for r in zip(*found) if r[0] >= k and r[1] <= k + len(run)})
    assert seen[0] == seen[1] == seen[2]
    assert any((c, d) != (a, b) for a, b, c, d in seen[0]) and all(a <= c < d <= b for a, b, c, d in seen[0])
    for lines in (["a"] * 60, ["b " * 60], ["", "c " * 51, ""]):
        count, digests = line_dedup.line_table("\n".join(lines).encode())
        assert all(a <= c < d <= b for a, b, c, d in zip(*line_dedup.stretches(count, digests, 50)))


def test_run_dedup_same_names(spark):
    """Columns named like the ones used inside stay."""
    text = "\n".join(f"w{i} " * 30 for i in range(4))
    docs = spark.createDataFrame([(i, text, i, i, i, i) for i in range(3)], "doc_id long, text string, marked long, _bucket long, _at long, row long")
    got = sorted(map(tuple, line_dedup.run_dedup(docs).collect()))
    assert got == [(0, text, 0, 0, 0, 0, 4, 0, 0), (1, "", 1, 1, 1, 1, 4, 4, 1), (2, "", 2, 2, 2, 2, 4, 4, 1)]


def test_marked(spark):
    """Every wanted key is marked, and few others."""
    wanted = spark.range(0, 30_000, 3).selectExpr("unhex(md5(string(id))) k")
    got = marked(spark.range(30_000).selectExpr("id", "unhex(md5(string(id))) k"), "k", wanted).filter("marked").select("id").toArrow()["id"].to_pylist()
    assert set(range(0, 30_000, 3)) <= set(got) and len(got) < 10_100
    assert marked(wanted, "k", wanted.limit(0)).filter("marked").isEmpty()


def test_near_dedup_moves_few_texts(spark):
    """Only the texts of pairs under comparison are moved, one of each class."""
    docs = spark.createDataFrame([(i, f"a b c d e f{i % 6} g h") for i in range(12)], "doc_id long, text string")
    classes = docs.filter("doc_id < 6").selectExpr("doc_id id", "unhex(md5(cast(text as binary))) t")
    pairs = spark.createDataFrame([(0, 2), (2, 5)], "a long, b long")
    got = near_dedup._texts(docs, classes, pairs).collect()
    assert sorted((r.id, bytes(r.raw)) for r in got) == [(i, f"a b c d e f{i} g h".encode()) for i in (0, 2, 5)]


def test_near_dedup_signatures():
    """Combined halves are no farther apart than the values allow, so no linked pair is turned away; they are half as long."""
    rng = np.random.default_rng(3)
    for n, differ in ((20, 3), (200, 28), (256, 36)):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        b = np.unique(np.concatenate([a[differ:], rng.integers(0, 1 << 63, differ, np.uint64)]))
        x, y = near_dedup.signature(a), near_dedup.signature(b)
        assert len(x) == 8 and sum(((u ^ v) & ((1 << 64) - 1)).bit_count() for u, v in zip(x, y)) <= 2 * differ


def test_decontaminate(spark, docs, rows):
    items = [(1, rows[8][1][:400]), (2, "One TWO three"), (3, None), (4, ""), (5, rows[11][1][3000:3900]), (5, rows[11][1][3000:3900])]
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold(t))
    want = []
    for i, t in rows:
        w, hit, found = cut(t), set(), set()
        for item, text in items:
            v = cut(text)
            k = min(13, len(v))
            for a in range(len(v) - k + 1 if k else 0):
                for p in range(len(w) - k + 1):
                    if w[p:p + k] == v[a:a + k]:
                        hit.update(range(p, p + k))
                        found.add(str(item))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                     len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_personal_data(spark):
    texts = ["a@b.c_d@e.f x@y", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8", "4539 1488 0343 6467 and 4539148803436468", "+1 (377) 555-0271 +12",
             "tokén token = \"40d78a45c418324758e099eb7cb89bc0f5fa9f62\" é a@b.de", None, "", "1 " * 3000, "z" * 20000 + "@q.de"]
    got = {r.doc_id: r for r in personal_data.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].spans == "email:0:5,email:5:11"
    assert got[1].spans == "ip:0:7,ip:18:25,ip:26:33"
    assert got[2].spans.startswith("card:0:19") and got[2].n_card == 1
    assert got[3].spans == "phone:0:17"
    assert got[4].spans.startswith("email:59:65") and (got[4].n_email, got[4].n_ip) == (1, 0)
    assert got[5].spans == got[6].spans == got[7].spans == ""
    assert got[8].spans == "email:0:20005"
    assert got[5].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_tokens(docs):
    got = spm_tokens.encode(docs.withColumn("ids", F.lit(1))).collect()
    assert all(r.round_trip for r in got) and [len(r.ids) for r in got if not r.text] == [0, 0]
    with open(spm_tokens.MODEL, "rb") as f:
        spm_tokens.check_parity(f.read(), [r.text or "" for r in got], [r.ids for r in got])


def test_tokens_space_runs(spark):
    from sentencepiece import SentencePieceProcessor

    with open(spm_tokens.MODEL, "rb") as f:
        data = f.read()
    texts = [a + " " * n + b for n in range(1, 201) for a, b in (("x", "y"), ("", "return"), ("end", ""), ("a\n", "\n7 "))]
    texts += ["=" * n for n in range(1, 80)] + ["a" * n + "-" * n + "." * n for n in range(1, 80)]
    want = SentencePieceProcessor(model_proto=data).encode(texts)
    assert [e.ids for e in spm_tokens.build(data).encode_batch(texts, add_special_tokens=False)] == want
    got = spm_tokens.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    assert [r.ids for r in sorted(got, key=lambda r: r.doc_id)] == want and all(r.round_trip for r in got)
    pieces = spm_tokens.piece_bytes(spm_tokens.parse(data))
    assert [b"".join(pieces[i] for i in ids)[1:].decode() for ids in want] == spm_tokens.build(data).decode_batch(want, skip_special_tokens=False) == texts


def test_token_parts_equal_the_library(monkeypatch):
    """The ids of parts, joined, are the library's ids of the whole text, whatever is remembered between batches."""
    import random

    from sentencepiece import SentencePieceProcessor

    with open(spm_tokens.MODEL, "rb") as f:
        data = f.read()
    rng, library = random.Random(5), SentencePieceProcessor(model_proto=data)
    alphabet = ["a", "e", "th", "ing", " ", "  ", " ", "\n", "\t", ".", "é", "日本", "🙂", "\x00", "<s>", "<0x41>", "\u00a0", "=", "7"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(3000)] + ["", " ", "x" * 50_000, "ab " * 20_000]
    marked = ["a▁b", "▁", " ▁▁ x▁"]
    monkeypatch.setattr(spm_tokens, "KEPT_PARTS", 500)
    assert spm_tokens.separable(spm_tokens.parse(data))
    parts = spm_tokens.Parts(data)
    for at in range(0, len(texts), 400):
        ids, same, parity = parts.encode(texts[at:at + 400])
        assert spm_tokens.id_lists(ids).to_pylist() == library.encode(texts[at:at + 400]) and all(same) and all(parity)
    ids, same, _ = parts.encode(marked)
    assert spm_tokens.id_lists(ids).to_pylist() == library.encode(marked) and not any(same)
    whole = spm_tokens.Texts(data)
    assert whole.encode(texts[:50] + marked) == parts.encode(texts[:50] + marked)


def test_token_parts_flag_what_differs():
    """A part that the library encodes otherwise takes its ids and marks exactly the texts that hold it."""
    with open(spm_tokens.MODEL, "rb") as f:
        data = f.read()
    parts = spm_tokens.Parts(data)
    real = parts.library

    class Other:
        def encode(self, texts, num_threads):
            return [[5, 6] if t == "▁odd" else i for t, i in zip(texts, real.encode(texts, num_threads=1))]

    parts.library = Other()
    ids, same, parity = parts.encode(["so odd it is", "fine", "odd"])
    assert parity == [False, True, False] and same == [False, True, False] and ids[2] == spm_tokens.packed([5, 6])


def test_segments():
    import numpy as np
    rng = np.random.default_rng(3)
    for _ in range(100):
        x = rng.integers(-3, 4, rng.integers(0, 14)).astype(float)
        got = toxicity.maximal_segments(x)
        assert all(abs(x[a:b].sum() - s) < 1e-9 and s > 0 for a, b, s in got)
        best = max((x[a:b].sum() for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=0)
        assert (max((s for _, _, s in got), default=0)) == max(best, 0)
        assert all(p[1] <= q[0] for p, q in zip(got, got[1:]))


@pytest.mark.parametrize("run", [quality.quality, toxicity.toxicity])
def test_classifiers(spark, run):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    more = docs.unionByName(spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "", "", 0)], docs.schema))
    got = run(more, labels)
    assert got.count() == docs.count() + 2 and got.filter("score is null or score < 0 or score > 1").isEmpty()
    target = "quality" if run is quality.quality else "toxic"
    right = got.join(labels, "doc_id").select((F.col("predicted") == F.col(target)).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right > 0.85
    assert run(docs, labels.limit(0)).count() == docs.count()


def test_main_text(spark):
    page = ("<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><header>site</header><div class='ad'>buy</div>"
            "<article><h1>Head &amp; more</h1><p><b>One  two.<br><p>Three\n<i>four</i>.</p><ul><li>five<li>six</ul></article>"
            "<div id=comments><p>me too</p></div><form>q</form><script>var a='</p>';</script><footer>end</footer></body></html>")
    got = {r.page_id: r for r in main_text.main_text(spark.createDataFrame(
        [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "no tags &lt;here"), (5, "u", "<div>" * 3000 + "deep")], "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head & more\nOne two.\nThree four.\nfive\nsix"
    assert (got[2].text, got[3].text, got[4].text, got[5].text) == ("", "", "no tags <here", "deep")
    assert got[1].n_chars == len(got[1].text)


def test_main_text_short_parts():
    rest = "<nav><a href=x>menu</a></nav>{}<div><ul><li><a href=y>more stories</a></ul></div><footer>end</footer>"
    for n in (3, 5, 10, 11, 12, 20, 50, 100):
        parts = ["Title", "Lead.", *(f"{i} " + "word " * 59 + "x" for i in range(n)), "Closing."]
        body = "<h1>Title</h1><p>Lead.</p><div>" + "".join(f"<p>{x}</p>" for x in parts[2:-1]) + "</div><p>Closing.</p>"
        sections = "<h1>Title</h1><section><h2>Lead.</h2></section><section>" + "".join(f"<p>{x}</p>" for x in parts[2:-1]) + "</section><section><p>Closing.</p></section>"
        for inner in (body, sections):
            for name in ("article", "main", "div"):
                page = f"<html><body>{rest.format(f'<{name}>{inner}</{name}>')}</body></html>"
                assert main_text.Page(page).text().split("\n") == parts, (n, name)


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (suffix_dedup.suffix_dedup(empty), near_dedup.near_dedup(empty), exact_dedup.exact_dedup(empty), line_dedup.digest(empty),
                decontaminate.decontaminate(empty, items), personal_data.personal_data(empty), spm_tokens.digest(empty),
                quality.quality(empty, labels), toxicity.toxicity(empty, labels)):
        assert out.count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF)
    assert set(docs.columns) <= set(got.columns) and 0 < got.count() < docs.count()
    assert got.filter("not round_trip").isEmpty()
    left = near_dedup.near_dedup(got)
    assert left.filter("not kept").isEmpty()


def test_written_tables_leave_no_shuffle_files(spark):
    """Shuffle files of a written plan used to stay until the driver's garbage collection; the setting of the session stays as it was."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = manager.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(FREE_SHUFFLES, "false")
    counts = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    kept = keep(counts.join(counts.hint("merge").withColumnRenamed("n", "m"), "k"))
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert sorted(r["k"] for r in kept.collect()) == list(range(10)) and spark.conf.get(FREE_SHUFFLES, "false") == setting


def test_rows_that_stay_are_not_shuffled_to_drop_others(spark):
    """Dropping decided ids used to shuffle every text; null and repeated ids stay or go as before."""
    import corpus_pipeline

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = manager.getAllFiles()
        return {files.apply(i).getName(): files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    rng = random.Random(3)
    rows = [(None if i % 50 == 0 else i // 2, "".join(rng.choices("abcdefghijklmnop", k=400)), "en", "s", 400) for i in range(2000)]
    docs, gone = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(7,), (400,), (None,), (5000,)], "doc_id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline._decided(docs, gone)
        before = shuffles()
        got = out.select(docs.columns).collect()
        moved = sum(n for name, n in shuffles().items() if name not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert Counter(map(tuple, got)) == Counter(r for r in rows if r[0] not in (7, 400))
    assert moved < 0.1 * 400 * len(rows)
