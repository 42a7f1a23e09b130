"""Line deduplication by content-defined chunks and by repeated pairs of lines.

A text's lines are hashed, and a rolling hash over neighbouring line hashes says
where chunks end; inserting or deleting a line moves boundaries near it only. Chunks
of two or more lines whose hash occurs elsewhere are compared byte by byte with the
chunk's first occurrence (by id, then position) and removed where they equal it.

Chunks alone miss a short passage in foreign lines, since its first and last chunk
hold some of those. So every two consecutive lines are indexed and compared in the
same way, pairs that follow each other are joined to a passage, and a passage of
``min_words`` words or more is removed whatever the chunks' boundaries are.

Defined results: null texts stay null, empty texts empty; passages of one line, or of
fewer than ``min_words`` words, are never removed; a pair is no copy of one that it
overlaps; the first occurrence of a line that repeats always stays; identical rows
(same id and text) are one document and do not remove each other's lines; of rows that
tie for the first occurrence the one with the lesser text hash is first; rows without an
id come before all others; a document all of whose lines are copies becomes empty; texts
of any length are read whole; an empty table gives no rows; other columns pass through,
but ``_removed`` is replaced. The stage keeps the columns that it gets.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import fresh, materialize, read_table

_M = (1 << 64) - 1


def chunks(text: str, average: int = 4, least: int = 2, most: int = 64, min_words: int = 8) -> list[tuple[int, int, int, int]]:
    """(number, start, end, hash) of the multi-line chunks; offsets are code points, an end is the next line's start."""
    out, at, start, before, lines, number = [], 0, 0, 0, 0, 0
    parts = text.split("\n")
    for i, line in enumerate(parts):
        here = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
        rolled = ((before * 0x9E3779B97F4A7C15 + here) & _M) * 0xBF58476D1CE4E5B9 & _M
        before, lines = here, lines + 1
        at += len(line) + (i < len(parts) - 1)
        if (rolled >> 40) % average == 0 and lines >= least or lines >= most or i == len(parts) - 1:
            body = text[start:at].removesuffix("\n")
            if lines >= least and len(body.split(None, min_words)) >= min_words:
                out.append((number, start, at, xxhash.xxh64_intdigest(body.encode("utf-8", "surrogatepass")) - (1 << 63)))
            start, lines, number = at, 0, number + 1
    return out


def line_pairs(text: str) -> list[tuple[int, int, int, int, int, int]]:
    """(line number, start, end, hash, words of the line, words of the next) of every two consecutive lines; offsets as in chunks."""
    out, at, start, before, words = [], 0, 0, 0, 0
    for i, line in enumerate(parts := text.split("\n")):
        here, n = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")), len(line.split())
        end = at + len(line) + (i < len(parts) - 1)
        if i:
            both = ((before * 0x9E3779B97F4A7C15 + here) & _M) * 0xBF58476D1CE4E5B9 & _M
            out.append((i - 1, start, end, (both ^ both >> 31) - (1 << 63), words, n))
        start, at, before, words = at, end, here, n
    return out


def chunk_index(keyed: DataFrame, pairs: bool = False) -> DataFrame:
    """``(doc_id, key, pair, pos, s, e, h, w, v)`` of all chunks of keyed(doc_id, key, text), and of all pairs of lines."""

    def run(batches):
        for b in batches:
            rows = ([], [], [], [], [], [], [], [], [])
            for doc, key, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for item in [*((False, *c, 0, 0) for c in chunks(text)), *((True, *p) for p in (line_pairs(text) if pairs else ()))]:
                    for col, v in zip(rows, (doc, key, *item), strict=True):
                        col.append(v)
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["doc_id", "key", "pair", "pos", "s", "e", "h", "w", "v"])

    return keyed.where("text is not null").mapInArrow(run, "doc_id bigint, key bigint, pair boolean, pos int, s bigint, e bigint, h bigint, w int, v int")


def passages(same: DataFrame, min_words: int = 8) -> DataFrame:
    """Repeated chunks and runs of repeated pairs of ``min_words`` words, joined where they overlap or touch: ``(_key, pos, s, e)``, pos the first line."""
    each = same.dropDuplicates(["_key", "pair", "pos"])
    run = F.col("pos") - F.row_number().over(Window.partitionBy("_key").orderBy("pos"))
    runs = each.where("pair").withColumn("_run", run).groupBy("_key", "_run").agg(F.min("pos").alias("pos"), F.min("s").alias("s"), F.max("e").alias("e"), (F.sum("w") + F.max_by("v", "pos")).alias("n"))
    cuts = runs.where(F.col("n") >= min_words).select("_key", "pos", "s", "e").unionByName(each.where("not pair").select("_key", F.lit(None).cast("int").alias("pos"), "s", "e"))
    by_start = Window.partitionBy("_key").orderBy("s", "e")
    apart = F.coalesce(F.col("s") > F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    cuts = cuts.withColumn("_apart", apart.cast("int")).withColumn("_cut", F.sum("_apart").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return cuts.groupBy("_key", "_cut").agg(F.min("pos").alias("pos"), F.min("s").alias("s"), F.max("e").alias("e"))


def line_dedup(docs: DataFrame, pairs: bool = False, together: int = 2000, removed: str = "_removed") -> DataFrame:
    """``docs`` with repeated chunks, and with ``pairs`` all repeated passages, cut from ``text``, and ``removed`` array<struct<pos, s, e>>.

    Copies of one chunk are compared with its first occurrence by about ``together`` in a task.
    """
    docs = docs.drop(removed)
    key, found_ = fresh([*docs.columns, removed], "_key", "_found")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    index = materialize(chunk_index(keyed.select(F.col("doc_id").cast("bigint"), F.col(key).alias("key"), "text"), pairs), "chunks")
    place = F.struct("doc_id", "key", "pos")
    parts = F.ceil(F.count(F.lit(1)) / together).cast("int").alias("parts")
    # a repeated row may be all that is counted twice: then nothing but first occurrences is found
    firsts = index.groupBy("pair", "h").agg(F.min(place).alias("first"), parts, F.count(F.lit(1)).alias("n")).where("n > 1").select("pair", "h", "first", "parts")
    overlaps = F.col("pair") & (F.col("key") == F.col("first.key")) & (F.col("pos") == F.col("first.pos") + 1)
    found = index.join(firsts, ["pair", "h"]).where(~overlaps).select("key", F.struct("pair", "pos", "s", "e", "h", "w", "v", "parts", (place == F.col("first")).alias("own")).alias("c"))
    per_doc = found.groupBy("key").agg(F.collect_set("c").alias(found_)).withColumnRenamed("key", key)
    marked = materialize(keyed.join(per_doc, key, "left"), "marked")
    body = F.expr("regexp_replace(substring(text, int(c.s) + 1, int(c.e - c.s)), '\\n\\\\z', '')")
    bodies = marked.where(F.col(found_).isNotNull()).select(F.col(key).alias("_key"), "text", F.explode(found_).alias("c")).select("_key", "c.*", body.alias("body"))
    owners = bodies.where("own").select("pair", "h", "parts", F.col("body").alias("first_body")).dropDuplicates(["pair", "h"])
    owners = owners.select("pair", "h", "first_body", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    copies = bodies.where("not own").withColumn("part", F.pmod(F.xxhash64("_key", "pos"), F.col("parts")).cast("int"))
    same = copies.join(owners, ["pair", "h", "part"]).where("body = first_body").select("_key", "pair", "pos", "s", "e", "w", "v")
    same = passages(same) if pairs else same
    cuts = same.groupBy("_key").agg(F.sort_array(F.collect_set(F.struct("pos", "s", "e"))).alias(removed)).withColumnRenamed("_key", key)
    touched = marked.where(F.col(found_).isNotNull()).join(cuts, key, "left")
    none = F.expr("CAST(array() AS array<struct<pos:int,s:bigint,e:bigint>>)")
    # what is kept lies between the cuts
    length = F.length("text").cast("bigint")
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(removed, lambda c: c["e"]))
    ends = F.concat(F.transform(removed, lambda c: c["s"]), F.array(length))
    rest = F.array_join(F.zip_with(begins, ends, lambda b, e: F.substring("text", (b + 1).cast("int"), (e - b).cast("int"))), "")
    # where the last chunk goes, so does the line break before it
    rest = F.when(~F.col("text").endswith("\n") & (F.element_at(removed, -1)["e"] == length), F.regexp_replace(rest, r"\n\z", "")).otherwise(rest)
    touched = touched.withColumn("text", F.when(F.size(removed) > 0, rest).otherwise(F.col("text")))
    plain = marked.where(F.col(found_).isNull()).withColumn(removed, none)
    return touched.withColumn(removed, F.coalesce(removed, none)).unionByName(plain.select(touched.columns)).select(*docs.columns, removed)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), pairs=True)
    lines = F.size(F.split("text", "\n", -1))
    return done.select("doc_id", F.length("text").cast("bigint").alias("kept_chars"), F.when(F.col("text").isNull(), 0).otherwise(lines).cast("bigint").alias("kept_lines"), F.size("_removed").cast("bigint").alias("removed_chunks"), F.sha2("text", 256).alias("text_sha256"), F.to_json("_removed").alias("removed"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; one that holds nothing else goes."""
    removed, = fresh(docs.columns, "_removed")
    done = line_dedup(docs, pairs=True, removed=removed)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.size(removed) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return done.where(~((F.size(removed) > 0) & F.coalesce(F.trim("text") == "", F.lit(False)))).drop(removed)
