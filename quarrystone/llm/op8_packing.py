"""Harmonic packing of tokenised documents into fixed-length sequences.

Class k holds pieces of at most capacity // k tokens, and each of its bins takes
exactly k of them. Which bin a piece gets follows from its number in its class
alone, so workers fill bins without asking each other. Documents are cut so that
pieces lie close under their class's limit: whole capacities first, then the
largest limits that fit, and the rest where it leaves little room. Only the last
bin of a class may be short of pieces.

Defined results: null and empty texts are the end token alone; repeated rows are
documents of their own, and so are rows of one id with other texts; rows without an
id keep a null id; texts of any length are encoded whole; an empty table gives no
rows; columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import lookup, materialize, number_rows, read_table

#: Reciprocal classes; the last one takes every shorter rest.
CLASSES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128)
#: A rest that leaves at most this share of its place empty is not cut further.
SLACK = 0.04
#: Below this, characters are composed, and lower case is one letter for one but for the dotted capital I.
FAR = "\u0250"


def cuts(tokens: int, capacity: int = 2048) -> list[tuple[int, int, int]]:
    """(start, length, class) of a document's pieces."""
    limits = [(k, capacity // k) for k in CLASSES]
    out, at = [], 0
    while at < tokens:
        rest = tokens - at
        k, limit = next((x for x in reversed(limits) if x[1] >= rest), limits[0])
        take = min(rest, limit)
        if rest < limit * (1 - SLACK) and k != CLASSES[-1]:
            k, take = next(x for x in limits if x[1] <= rest)
        out.append((at, take, k))
        at += take
    return out


class _Ids(dict):
    """Chunk without spaces -> its token ids, packed; pre-tokens never span a space.

    The tokenizer composes marks (NFC), lower-cases, and cuts text into runs of letters,
    single digits and runs of other characters. Chunks below U+0250 hold nothing to
    compose, so they are lower-cased here; a point or comma after a letter or digit from
    that range is a pre-token of its own. The one letter there whose lower case ends in a
    mark, the dotted capital I, and every character beyond are left to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.encode, self.model = whole.encode, whole.model
        # byte-level alphabet: printable bytes stand for themselves, the others for code points from 256
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}

    def __missing__(self, chunk: str) -> bytes:
        if "<|" in chunk:  # special tokens are looked for before anything else
            packed = self._packed(self.encode(chunk, add_special_tokens=False).ids)
        elif max(chunk, default="") < FAR and (low := chunk.lower()) != chunk:
            packed = self[low]
        elif len(chunk) > 1 and chunk[-1] in ".," and chunk[-2] < FAR and chunk[-2] != "İ" and chunk[-2].isalnum():
            packed = self[chunk[:-1]] + self[chunk[-1]]
        elif chunk.isalpha() and max(chunk) < FAR:  # a single pre-token that normalising leaves as it is
            packed = self._packed([t.id for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(self.alphabet))])
        else:
            packed = self._packed(self.encode(chunk, add_special_tokens=False).ids)
        if len(self) < 600_000 and len(chunk) < 64:
            self[chunk] = packed
        return packed

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)


def _known(path: str) -> _Ids:
    """The chunks that this worker process knows, kept from task to task in a module of their own."""
    import sys
    import types

    kept = vars(sys.modules.setdefault("_quarrystone_chunks", types.ModuleType("_quarrystone_chunks")))
    if path not in kept:
        kept[path] = _Ids(path)
    return kept[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """``(doc_id, start, length, doc_tokens, klass, ids)``, ids as little-endian unsigned 32-bit integers."""
    end = struct.pack("<I", end_id)

    def run(batches):
        known = _known(tokenizer_path(tokenizer))
        for b in batches:
            rows = ([], [], [], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = b"".join(map(known.__getitem__, (text or "").replace("\n", " ").split(" "))) + end
                for start, length, klass in cuts(len(ids) // 4, capacity):
                    for col, v in zip(rows, (doc, start, length, len(ids) // 4, klass, ids[4 * start:4 * (start + length)]), strict=True):
                        col.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["doc_id", "start", "length", "doc_tokens", "klass", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, klass int, ids binary")


def harmonic_bins(cut: DataFrame, block_rows: int = 5_000) -> DataFrame:
    """``cut(doc_id, start, length, klass, ...)`` with sequence_id and offset."""
    counts = {r["klass"]: r["n"] for r in cut.groupBy("klass").agg(F.count(F.lit(1)).alias("n")).collect()}
    base, at = {}, 0
    for k in sorted(counts):
        base[k] = at
        at += -(-counts[k] // k)
    numbered = number_rows(cut, ["klass"], ["doc_id", "start", *[c for c in cut.columns if c not in ("doc_id", "start", "klass")]], "_n", max(1, max(counts.values(), default=0) // block_rows))
    bins = numbered.withColumn("sequence_id", lookup(F.col("klass"), base, 0) + F.floor(F.col("_n") / F.col("klass")))
    before = Window.partitionBy("sequence_id").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    return bins.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("_n", "klass")


def pack(docs: DataFrame) -> DataFrame:
    cut = materialize(pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return harmonic_bins(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return pack(docs)
