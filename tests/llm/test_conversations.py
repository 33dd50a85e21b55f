"""Conversation repair and prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from stopwise.llm import conversation_repair as repair
from stopwise.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn int, role string, text string, audit string, place string, node string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def null_first(value):
    return (value is not None, value if value is not None else 0)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    texts = ["Hello.", "what is it?", "no stop", "", " \t", "same!", "Größe, und. . ", "a" * 4000 + "."]
    out = []
    for c in [*range(60), *range(200, 240), 395, 1000]:
        for turn in range(rng.randint(1, 9)):
            out.append((c, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]),
                        rng.choice([*texts, f"text {c} {turn}.", None])))
    out += [(7, 3, "user", "twice."), (7, 3, "user", "twice."), (None, 1, "user", "lost."), (None, None, "assistant", "id"), (-3, 0, "user", "minus.")]
    out += [(500, t, "user" if t % 2 else "assistant", f"long {t}" + "." * (t % 3)) for t in range(700)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5)


def cheapest(rows):
    """All ways with up to three insertions between rows, by (cost, letters)."""
    def with_inserts(live):
        out, new = dict(live), live
        for _ in range(3):
            new = {repair.FILL[q]: min((k + 2, a + "I") for p, (k, a) in new.items() if repair.FILL[p] == repair.FILL[q]) for q in new}
            for q, v in new.items():
                out[q] = min(v, out.get(q, v))
        return out

    live = {0: (0, "")}
    for initial, gone, unfinished in rows:
        step = defaultdict(list)
        for q, (k, a) in with_inserts(live).items():
            step[q].append((k + 3, a + "D"))
            if not gone:
                step[repair.FILL[q]].append((k + 2 + unfinished, a + "R"))
                if (q, initial) in {(0, "s"), (0, "u"), (1, "u"), (3, "u"), (2, "a")}:
                    step[{"s": 1, "u": 2, "a": 3}[initial]].append((k + unfinished, a + "K"))
        live = {q: min(v) for q, v in step.items()}
    live = with_inserts(live)
    return min(live[q] for q in (0, 3) if q in live)


def plain_repair(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        convs[c] += [] if case == 0 else [(turn, "user" if case == 4 else role, "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text)] * (
            2 if case == 3 else 1)
    out = []
    for c, found in convs.items():
        found.sort(key=lambda r: (null_first(r[0]), r[1], r[2]))
        seen, codes = set(), []
        counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in found:
            real = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not real else "duplicate" if (role, text) in seen else "truncated" if real[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] = counts.get(fault, 0) + 1
            codes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        known = [t for t, _, _ in found if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        cost, audit = cheapest(codes)
        lines, at = [], 0
        for letter in audit:
            role, text = (None, "") if letter == "I" else found[at][1:]
            at += letter != "I"
            if letter in "IR":
                role = "assistant" if lines and lines[-1][0] == "u" else "user"
            if letter != "D":
                lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out.append((c, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 3, 128])
def test_cheapest(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block)
    for n in [0, 1, 2, 3, 4, 5, 8, 20, 60] * 25:
        rows = [(rng.choice(["s", "u", "u", "a", "a", "x", ""]), rng.random() < .2, rng.random() < .3) for _ in range(n)]
        rows = [(i, gone, unfinished and not gone) for i, gone, unfinished in rows]
        assert repair.cheapest(rows) == cheapest(rows)


def test_repair(spark, rows):
    got = sorted((tuple(r) for r in repair.conversation_repair(table(spark, rows)).collect()), key=str)
    assert got == plain_repair(rows)


def test_repaired_rows(spark, rows):
    damaged = repair.damaged(table(spark, rows))
    found = repair.repaired(damaged, repair.edits(damaged)).collect()
    places = defaultdict(list)
    for r in found:
        places[r["conv_id"]].append((r["place"], r["role"][:1]))
    for got in places.values():
        assert sorted(p for p, _ in got) == list(range(1, len(got) + 1))
        assert re.fullmatch("s?(ua)+", "".join(x for _, x in sorted(got)))


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((null_first(turn), role or "", text or ""))
    convs = {c: [r[1:] for r in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in convs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        base = [] if c is None else convs.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        made[c] = tuple(base[:h] + own[h:])
    members = defaultdict(list)
    for c, s in made.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    least = {k: min((c for c in v if c is not None), default=None) for k, v in members.items()}
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        kids[k[:-1]] += len(k) > 0
    for k, v in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(v) - 1) * len(k[-1][1]) if k else 0
    return sorted(((least[k], len(k), least[k[:-1]] if k else None, len(v), kids[k], leaves[k], saved[k],
                    sha(",".join("" if c is None else str(c) for c in sorted((c for c in v if made[c] == k), key=null_first))))
                   for k, v in members.items()), key=str)


@pytest.mark.parametrize("block,paths,piece", [(20_000, 2_000, 4_096), (7, 4, 2), (1, 2, 1)])
def test_trie(monkeypatch, spark, rows, block, paths, piece):
    for name, value in (("BLOCK", block), ("PATHS", paths), ("PIECE", piece)):
        monkeypatch.setattr(trie, name, value)
    copies = [(c, t, "user" if t % 2 == 0 else "assistant", f"copy {t}") for c in range(3000, 3080) for t in range(5)]
    rows = rows + copies
    assert sorted((tuple(r) for r in trie.prefix_trie(table(spark, rows)).collect()), key=str) == plain_trie(rows)


def test_merge_of_any_cut():
    """However the sorted sequences are cut into forests, the merged trie is the same."""
    rng = random.Random(1)
    for _ in range(60):
        found = sorted({tuple(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 25))})
        whole = None
        for cut in (100, 1, 2, 3):
            nodes, paths = [], []
            make = lambda s, i: trie.Sequence("".join(x.ljust(16) for x in s).encode(), trie.np.arange(1, len(s) + 1), {len(s): (1, i, 0, 0, 0)}, [i])
            for at in range(0, len(found), cut):
                out, new = trie.grow([make(s, i + at) for i, s in enumerate(found[at:at + cut])], True, True)
                nodes, paths = nodes + out, paths + [trie.Sequence.unpacked(**p.packed()) for p in new]
            nodes += trie.grow(paths, False, False)[0]
            keys = [trie._AT[n] for n in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")]
            got = sorted([n[k] for k in keys] for n in nodes if n[0] == trie.NODE)
            whole = whole or got
            assert got == whole


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert not repair.conversation_repair(none).collect()
    assert not trie.prefix_trie(none).collect()
