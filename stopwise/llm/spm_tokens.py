"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed here (protobuf wire format); its normaliser, white-space marker, pieces with scores and byte
fallback are rebuilt as a tokenizers pipeline:

* unigram models become a unigram model with the scores;
* pair-merge models become merges, ordered by the score of the merged piece; among equal scores the longer piece comes first, and
  within a piece the longer left part, so that tied runs grow from the left as the SentencePiece library grows them;
* when no piece has the marker behind another character, texts are cut in front of runs of markers first, which changes
  nothing in the result and lets the library reuse words.

When merges cannot cross the cuts (``separable``), the ids of a text are the ids of its parts one after the other.  Each task then
encodes every different part once: the new parts of a batch go through the rebuilt tokenizer together, on its own threads, and the ids are
kept for the parts to come, in the later tasks of the worker too.  Parity is verified on each of these parts against the SentencePiece library, and a part is decoded
and compared, so a text decodes to itself when all its parts do.  At ``KEPT_PARTS`` parts or ``KEPT_CHARS`` characters all but the parts
met in several batches are forgotten, and encoded again when met again; results do not depend on it.  Other models encode, verify and decode text by text.

``parity`` is false for a text with a part (or itself, for other models) on which the library disagrees; such a part takes the library's ids.

Null counts as empty; an empty text has no ids.  Repeated rows are encoded alike, an empty table gives no rows, and input columns named
``ids``, ``round_trip`` or ``parity`` are replaced.  A text holds the marker character itself only at the price of coming back
with a space, so ``round_trip`` is false there.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
PARTS = f"{MARK}+[^{MARK}]*|[^{MARK}]+"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, PAIRS = 1, 2
BATCH_CHARS = 1_000_000
KEPT_PARTS, KEPT_CHARS = 300_000, 4_000_000
#: Appended to a model file (fields of a later message win): normalizer_spec { add_dummy_prefix: false }.
NO_PREFIX = bytes([3 << 3 | 2, 2, 3 << 3, 0])


@dataclass
class Spec:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; nested messages stay bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at:at + size], at + size
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        else:
            raise ValueError(f"wire type {wire} in a model file")
        yield tag >> 3, value


def parse(data: bytes) -> Spec:
    spec = Spec()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
            spec.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec.kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            norm = {2: b"", 3: 1, 4: 1, 5: 1} | dict(_fields(value))
            spec.charsmap, spec.dummy_prefix, spec.trim_spaces, spec.escape = norm[2], bool(norm[3]), bool(norm[4]), bool(norm[5])
    return spec


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs that merge into a piece, best score first."""
    normal = {p: s for p, s, kind in pieces if kind == NORMAL}
    ranked = sorted((p for p in normal if len(p) > 1), key=lambda p: (-normal[p], -len(p)))
    return [(p[:i], p[i:]) for p in ranked for i in range(len(p) - 1, 0, -1) if p[:i] in normal and p[i:] in normal]


def separable(spec: Spec) -> bool:
    """Whether texts may be cut in front of runs of markers: no piece reaches over a cut, and every character has its own bytes."""
    kinds = {k for _, _, k in spec.pieces}
    return (spec.kind == PAIRS and not spec.charsmap and not spec.trim_spaces and spec.escape and BYTE in kinds
            and kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} and not any(MARK in p.lstrip(MARK) for p, _, k in spec.pieces if k == NORMAL))


def build(data: bytes, parts: bool = False) -> Tokenizer:
    """The tokenizer of a model file; with ``parts`` it takes parts of texts that are marked and cut already."""
    spec = parse(data)
    if spec.kind not in (UNIGRAM, PAIRS):
        raise ValueError(f"model type {spec.kind} is neither unigram nor pair merges")
    kinds = {k for _, _, k in spec.pieces}
    unknown = next(i for i, (_, _, k) in enumerate(spec.pieces) if k == UNKNOWN)
    if spec.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unk_id=unknown, byte_fallback=BYTE in kinds)
    else:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, merges(spec.pieces), unk_token=spec.pieces[unknown][0],
                           fuse_unk=True, byte_fallback=BYTE in kinds)
    tokenizer = Tokenizer(model)
    if parts:
        return tokenizer
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.trim_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    space = MARK if spec.escape else " "
    steps += [normalizers.Prepend(space)] if spec.dummy_prefix else []
    steps += [normalizers.Replace(" ", MARK)] if spec.escape else []
    tokenizer.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, k in spec.pieces if k == NORMAL):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(PARTS), "isolated")
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
                                          + ([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []))
    return tokenizer


def piece_bytes(spec: Spec) -> list[bytes]:
    """What each id decodes to; the tokenizer's decoder gives the same text, several times slower."""
    return [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in spec.pieces]


def packed(ids: list[int]) -> bytes:
    """Ids as 32-bit integers one after the other."""
    return array("i", ids).tobytes()


class Texts:
    """Encodes batches of texts to (packed ids, round trip, parity) per text, text by text."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.tokenizer, self.library = build(data), SentencePieceProcessor(model_proto=data)
        spec = parse(data)
        self.piece, self.lead = piece_bytes(spec).__getitem__, b" " if spec.dummy_prefix else b""

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[bool]]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        right = self.library.encode(texts, num_threads=1)
        parity = [a == b for a, b in zip(ids, right)]
        ids = [a if same else b for a, b, same in zip(ids, right, parity)]
        same = [t.encode() == b"".join(map(self.piece, i)).removeprefix(self.lead) for t, i in zip(texts, ids)]
        return list(map(packed, ids)), same, parity


class Parts:
    """The same for separable models: each different part is encoded, verified and decoded once and remembered."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        spec = parse(data)
        self.tokenizer, self.library = build(data, parts=True), SentencePieceProcessor(model_proto=data + NO_PREFIX)
        self.piece, self.lead = piece_bytes(spec).__getitem__, MARK if spec.dummy_prefix else ""
        self.cut = re.compile(PARTS).findall
        self.known: dict[str, bytes] = {}
        self.again: set[str] = set()
        self.chars = 0
        self.changed: set[str] = set()
        self.differ: set[str] = set()

    def learn(self, parts: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        right = self.library.encode(parts, num_threads=1)
        if ids != right:
            self.differ.update(p for p, a, b in zip(parts, ids, right) if a != b)
            ids = right
        back = [b"".join(map(self.piece, i)) for i in ids]
        self.changed.update(p for p, text in zip(parts, back) if p.replace(MARK, " ").encode() != text)
        self.known.update(zip(parts, map(packed, ids)))
        self.chars += sum(map(len, parts))

    def forget(self) -> None:
        """Keep the parts met in several batches if they fill at most half of the room."""
        chars = sum(map(len, self.again))
        kept = self.again if len(self.again) <= KEPT_PARTS // 2 and chars <= KEPT_CHARS // 2 else set()
        self.known = {part: self.known[part] for part in kept}
        self.changed, self.differ = self.changed & kept, self.differ & kept
        self.chars, self.again = chars if kept else 0, set()

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[bool]]:
        if len(self.known) > KEPT_PARTS or self.chars > KEPT_CHARS:
            self.forget()
        cut = [self.cut(self.lead + t.replace(" ", MARK)) if t else [] for t in texts]
        met = set().union(*cut)
        new = met.difference(self.known)
        met -= new
        self.again |= met
        if new:
            self.learn(list(new))
        ids = [b"".join(map(self.known.__getitem__, parts)) for parts in cut]
        same = [MARK not in t for t in texts]
        if self.changed:
            same = [s and self.changed.isdisjoint(parts) for s, parts in zip(same, cut)]
        return ids, same, [self.differ.isdisjoint(parts) for parts in cut] if self.differ else [True] * len(texts)


@lru_cache(maxsize=1)
def encoder_of(data: bytes) -> Texts | Parts:
    """The encoder of a model, built once a worker."""
    return Parts(data) if separable(parse(data)) else Texts(data)


def id_lists(rows: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def encode(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """The rows with ``ids``, ``round_trip`` and ``parity`` (these replace input columns of the same names)."""
    docs = docs.drop("ids", "round_trip", "parity")
    with open(model_path, "rb") as f:  # a small file beside the driver; executors get its bytes
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType(docs.schema.fields + T.StructType.fromDDL("ids array<int>, round_trip boolean, parity boolean").fields)
    arrow = to_arrow_schema(schema)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        encoder = encoder_of(shared.value)
        for batch in batches:
            for part in bounded(batch, place):
                ids, same, parity = encoder.encode([t or "" for t in part.column(place).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, id_lists(ids).cast(arrow.field("ids").type),
                                                  pa.array(same, pa.bool_()), pa.array(parity, pa.bool_())], schema=arrow)

    return docs.mapInArrow(run, schema)


def bounded(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``BATCH_CHARS`` bytes of text."""
    at = size = 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(place)).to_pylist()):
        size += n or 0
        if size >= BATCH_CHARS:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def check_parity(model: bytes, texts: list[str], ids: list[list[int]]) -> None:
    from sentencepiece import SentencePieceProcessor

    if SentencePieceProcessor(model_proto=model).encode(texts, num_threads=1) != ids:
        raise ValueError("ids differ from those of the SentencePiece library")


def digest(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """Per document: number of ids, digest of the ids (comma-joined), whether decoding gives the text back, and parity."""
    rows = encode(docs.select("doc_id", "text"), model_path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "round_trip", "parity")
