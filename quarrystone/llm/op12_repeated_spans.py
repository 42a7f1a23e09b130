"""Substring deduplication on a compacted De Bruijn graph of words.

An edge of the graph is a window of ``k`` consecutive words; it leads from the window's
first k - 1 words to its last. Edges are gathered by minimizer, as graph builders for
genomes do: the least hash of a window's ``m``-word stretches. Neighbouring windows mostly
share it, so they travel as one row with their hashes of 48 bits, and all copies of an edge
meet in the task of their minimizer, in the order of their coordinates, where each learns
its source: the first window with these words. Edges that follow each other in a text and
whose sources follow each other form a path without a branch. Such paths are compacted
within each task, and then end to start by (text, source text, distance); a join with the
documents brings them to both of their coordinates, where the words are read again and
compared: digests of the words, cut at every 64th word of the source, so that a document's
pieces are bounded by its own length however many copies it has. Were any piece to differ,
the run would be repeated with every edge dealt by a hash of its own, 112 bits in all.

What many texts share is combined before it is shuffled: of equal windows within about 4 MB
of texts only the first is sent on, for the others are decided. Minimizers that hold more
than a fair part of all rows (a quarter of a partition's, told by a sixteenth of the
documents, as a range partitioning samples its bounds; at most 4 entries a partition) deal
their windows out by window instead, so no task gets a common phrase with all its
surroundings. Results do not depend on which these are.

Defined results: null texts stay null, others become their words joined by single blanks,
whether or not any were removed; fewer than k words are all kept; a document is a row's
doc_id with its text, so repeated rows are one document and are handled alike, and rows of
one id with other texts are documents none of which is earlier; rows without an id come
before all others; windows are judged on the input; texts of any length are read whole; an
empty table gives no rows; other columns pass through, but ``n_words`` and ``n_removed``
are replaced.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.llm.common import discard, fresh, materialize, read_table
from quarrystone.llm.words import Words, in_words

GRID = 64
_ROWS = "route bigint, doc bigint, th bigint, s int, n int, hashes binary, src_doc bigint, src_th bigint, src_s int"
_COPIES = "doc bigint, th bigint, s int, n int, src_doc bigint, src_th bigint, src_s int"
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4D)  # odd


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def _stretch_hashes(words: np.ndarray, k: int, base: int) -> np.ndarray:
    """A hash of 64 bits of each ``k`` consecutive words, from the words' own."""
    power = np.full(len(words) + 1, base, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[:-1], out=sums[1:])
    back = np.full(len(words) + 1, pow(base, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    return _mixed((sums[k:] - sums[:-k]) * back[: len(words) - k + 1])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    out = x
    while have * 2 <= width:
        out, have = np.minimum(out[: len(out) - have], out[have:]), have * 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def earlier(key: np.ndarray, doc: np.ndarray, th: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows start earlier too, the index of the earlier one, and which only repeat the row before.

    Windows come in the order of (doc, th, s) where their keys are equal.
    """
    order = np.argsort(key, kind="stable")
    k, d, t, p = key[order], doc[order], th[order], s[order]
    new = np.r_[True, k[1:] != k[:-1]]
    own = new | np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])]
    at = np.arange(len(k))
    first, first_own = (np.maximum.accumulate(np.where(x, at, 0)) for x in (new, own))
    other = d > d[first]
    copied, source, again = np.empty(len(k), bool), np.empty(len(k), np.int64), np.empty(len(k), bool)
    copied[order] = other | (p > p[first_own])
    source[order] = order[np.where(other, first, first_own)]
    again[order] = ~own & np.r_[False, p[1:] == p[:-1]]
    return copied, source, again


def _paths(doc, th, s, src_doc, src_th, src_s) -> list[np.ndarray]:
    """Neighbouring copied windows with neighbouring sources as (doc, th, s, n, src_doc, src_th, src_s)."""
    if not len(s):
        return [np.array([], t) for t in (np.int64, np.int64, np.int32, np.int32, np.int64, np.int64, np.int32)]
    on = (doc[1:] == doc[:-1]) & (th[1:] == th[:-1]) & (s[1:] == s[:-1] + 1) & (src_doc[1:] == src_doc[:-1]) & (src_th[1:] == src_th[:-1]) & (src_s[1:] == src_s[:-1] + 1)
    at = np.flatnonzero(np.r_[True, ~on])
    n = np.diff(np.r_[at, len(s)])
    return [doc[at], th[at], s[at].astype(np.int32), n.astype(np.int32), src_doc[at], src_th[at], src_s[at].astype(np.int32)]


def _edges(w: Words, doc: np.ndarray, th: np.ndarray, k: int, m: int, heavy: np.ndarray | None):
    """The windows of some texts: ``(route, doc, th, s, hash)``, in the order of (doc, th, s). With ``heavy`` None all are dealt by a hash of their own."""
    order = np.lexsort((th, doc))
    order = order[np.diff(w.starts)[order] >= k]
    counts = np.diff(w.starts)[order]
    if not len(order):
        return None
    ids = np.concatenate([w.ids[w.starts[i] : w.starts[i + 1]] for i in order])
    # words above 64 bits: their digests
    known = np.array([xxhash.xxh64_intdigest(x) for x in w.known.cast(pa.large_binary()).to_pylist()], np.uint64)
    words = known[ids]
    begins = np.r_[0, np.cumsum(counts)]
    place = np.arange(len(ids) - k + 1)
    text = np.repeat(np.arange(len(order)), counts)[: len(place)]
    whole = place + k <= begins[text + 1]
    full = _stretch_hashes(words, k, _BASES[0])
    if heavy is not None:
        route = _mixed(_least(_stretch_hashes(words, m, _BASES[0]), k - m + 1))
        common = np.isin(route, heavy) if len(heavy) else None
    if heavy is None or common is not None and common.any():
        apart = _stretch_hashes(words, k, _BASES[1])
        route = apart if heavy is None else np.where(common, apart, route)
    text, place = text[whole], place[whole]
    return route[whole], doc[order][text], th[order][text], place - begins[text], full[whole]


def _runs(route, doc, th, s) -> np.ndarray:
    """Where neighbouring windows with one route begin."""
    on = (route[1:] == route[:-1]) & (doc[1:] == doc[:-1]) & (th[1:] == th[:-1]) & (s[1:] == s[:-1] + 1)
    return np.flatnonzero(np.r_[True, ~on])


def _index(docs: DataFrame, k: int, m: int, heavy: np.ndarray | None) -> DataFrame:
    """All first windows of every 4 MB of texts by route, and the copies found within these."""
    schema = pa.schema([("route", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary()), ("src_doc", pa.int64()), ("src_th", pa.int64()), ("src_s", pa.int32())])

    def run(batches):
        for b in batches:
            docs_, ths = (b.column(i).to_numpy() for i in range(2))
            for w in in_words(b.column(2)):
                found = _edges(w, docs_[w.rows], ths[w.rows], k, m, heavy)
                if found is None:
                    continue
                route, doc, th, s, full = found
                copied, source, again = earlier(full, doc, th, s)
                c = copied & ~again
                paths = _paths(doc[c], th[c], s[c], doc[source[c]], th[source[c]], s[source[c]])
                none = pa.nulls(len(paths[0]), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(_mixed(paths[0].view(np.uint64)).view(np.int64)), *map(pa.array, paths[:4]), none, *map(pa.array, paths[4:])], schema=schema)
                keep = ~copied & ~again
                route, doc, th, s, full = (x[keep] for x in (route, doc, th, s, full))
                at = _runs(route, doc, th, s)
                ends = np.r_[at, len(s)]
                body = np.ascontiguousarray(full.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()
                hashes = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((ends * 6).astype(np.int32)), pa.py_buffer(body)])
                cols = [pa.array(route[at].view(np.int64)), pa.array(doc[at]), pa.array(th[at]), pa.array(s[at].astype(np.int32)), pa.array(np.diff(ends).astype(np.int32)), hashes]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int32())], schema=schema)

    return docs.mapInArrow(run, _ROWS)


def _heavy(docs: DataFrame, k: int, m: int) -> np.ndarray:
    """Minimizers with more than a quarter of a partition's fair part of the rows; at most 4 entries a partition."""
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for b in batches:
            docs_, ths = (b.column(i).to_numpy() for i in range(2))
            for w in in_words(b.column(2)):
                if found := _edges(w, docs_[w.rows], ths[w.rows], k, m, np.array([], np.uint64)):
                    route, n = np.unique(found[0][_runs(*found[:4])], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(n)], ["route", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc", "th"), F.lit(16)) == 0)
    counts = materialize(some.mapInArrow(run, "route bigint, n bigint").groupBy("route").agg(F.sum("n").alias("n")), "minimizers")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = counts.where((F.col("n") * parts > total) & (F.col("n") > 8)).select("route").limit(parts).toArrow()
    discard(counts)
    return out.column(0).to_numpy().view(np.uint64)


def _sources(rows: DataFrame) -> DataFrame:
    """Copies among the windows of rows that come route by route, each route's in the order of (doc, th, s)."""

    def run(batches):
        kept = None  # of the last route: its number, and the windows that later ones are held against
        for big in batches:
            for b in (big.slice(i, 1 << 14) for i in range(0, len(big), 1 << 14)):
                told = b.filter(b.column("hashes").is_null()).select(_COPIES.replace(",", "").split()[::2])
                b = b.filter(b.column("hashes").is_valid())
                route, doc, th, s, n = (b.column(i).to_numpy() for i in range(5))
                if not len(b):
                    yield told
                    continue
                row = np.repeat(np.arange(len(b)), n)
                s = s[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                hashes = np.zeros((len(row), 8), np.uint8)
                hashes[:, :6] = np.frombuffer(b"".join(b.column("hashes").to_pylist()), np.uint8).reshape(-1, 6)
                number = np.r_[0, np.cumsum(route[1:] != route[:-1])]
                key = hashes.view(np.uint64)[:, 0] | number[row].astype(np.uint64) << np.uint64(48)
                doc, th = doc[row], th[row]
                old = 0
                if kept is not None and kept[0] == route[0]:
                    old = len(kept[1])
                    key, doc, th, s = (np.concatenate(x) for x in zip(kept[1:], (key, doc, th, s), strict=True))
                copied, source, again = earlier(key, doc, th, s)
                c = copied & ~again
                c[:old] = False
                paths = _paths(doc[c], th[c], s[c], doc[source[c]], th[source[c]], s[source[c]])
                yield pa.RecordBatch.from_arrays([*map(pa.array, paths)], schema=told.schema)
                yield told
                # each window of the last route: its first copy, and the first of the document that holds its last copy
                tail = np.flatnonzero(key >> np.uint64(48) == np.uint64(number[-1]))
                order = tail[np.argsort(key[tail], kind="stable")]
                begins = np.flatnonzero(np.r_[True, key[order[1:]] != key[order[:-1]]])
                last = order[np.r_[begins[1:], len(order)] - 1]
                own = copied[last] & (doc[source[last]] == doc[last]) & (th[source[last]] == th[last])
                stay = np.concatenate([order[begins], np.where(own, source[last], last)])
                kept = (route[-1], key[stay] & np.uint64((1 << 48) - 1), doc[stay], th[stay], s[stay])

    return rows.mapInArrow(run, _COPIES)


def copied_paths(docs: DataFrame, k: int = 20, m: int = 8, spread: bool = False) -> DataFrame:
    """``(doc, th, s, n, src_doc, src_th, src_s)``: n windows from word s on also start, one by one, earlier from word src_s on of the source.

    ``docs``: doc, th (bigint, never null; together a document, doc its order) and text.
    """
    texts = docs.where("text is not null")
    rows = _index(texts, k, m, None if spread else _heavy(texts, k, m))
    copies = materialize(_sources(rows.repartition("route").sortWithinPartitions("route", "doc", "th", "s")), "copies")
    same = Window.partitionBy("doc", "th", "src_doc", "src_th", F.col("s") - F.col("src_s")).orderBy("s", "n")
    gap = F.coalesce(F.col("s") > F.max(F.col("s") + F.col("n")).over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    paths = copies.withColumn("_gap", gap.cast("int")).withColumn("_path", F.sum("_gap").over(same.rowsBetween(Window.unboundedPreceding, 0)))
    by = paths.groupBy("doc", "th", "src_doc", "src_th", (F.col("s") - F.col("src_s")).alias("_far"), "_path")
    return by.agg(F.min("s").alias("s"), (F.max(F.col("s") + F.col("n")) - F.min("s")).alias("n"), F.min("src_s").alias("src_s")).select("doc", "th", "s", "n", "src_doc", "src_th", "src_s")


def _cut(joined: DataFrame, asks: str, text: str, k: int, proofs_: str) -> DataFrame:
    """Texts without their copied words, and digests of the words at both coordinates of each copied piece."""
    schema = T.StructType([f for f in joined.schema.fields if f.name != asks] + T._parse_datatype_string(f"n_words bigint, n_removed bigint, {proofs_} array<struct<doc: bigint, th: bigint, s: int, n: int, digest: binary>>").fields)
    kind = pa.list_(pa.struct([("doc", pa.int64()), ("th", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())]))
    names = [f.name for f in joined.schema.fields]

    def run(batches):
        for b in batches:
            texts, lists = b.column(names.index(text)), b.column(names.index(asks))
            empty = texts.is_null().to_pylist()
            kept, n_words, n_removed, proofs = [], [], [], []
            for raw, no, ask in zip(texts.cast(pa.binary()), empty, lists, strict=True):
                words = b"" if no else raw.as_py()
                words = words.split()
                n_words.append(len(words))
                gone = np.zeros(len(words) + 1, np.int64)
                told: list[tuple] = []
                for a in ask.as_py() or ():
                    if a["src_doc"] is None:  # a piece that a copy points to
                        told.append((a["doc"], a["th"], a["s"], a["n"], blake2b(b" ".join(words[a["s"] : a["s"] + a["n"]]), digest_size=16).digest()))
                        continue
                    length, far = a["n"] + k - 1, a["s"] - a["src_s"]
                    gone[a["s"]] += 1
                    gone[a["s"] + length] -= 1
                    at, end = a["src_s"], a["src_s"] + length
                    while at < end:
                        to = min(end, at // GRID * GRID + GRID)
                        told.append((a["src_doc"], a["src_th"], at, to - at, blake2b(b" ".join(words[at + far : to + far]), digest_size=16).digest()))
                        at = to
                left = np.cumsum(gone[:-1]) == 0
                n_removed.append(len(words) - int(left.sum()))
                if n_removed[-1]:
                    words = [words[i] for i in np.flatnonzero(left)]
                kept.append(None if no else b" ".join(words))
                proofs.append([dict(zip(("doc", "th", "s", "n", "digest"), x, strict=True)) for x in told])
            cols = {name: b.column(i) for i, name in enumerate(names) if name != asks}
            cols[text] = pa.array(kept, pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(proofs, kind)], names=[*cols, "n_words", "n_removed", proofs_])

    return joined.mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, k: int = 20, m: int = 8, spread: bool = False) -> DataFrame:
    """``docs`` with ``text`` rid of each word that lies in a window of ``k`` words that also starts earlier, ``n_words`` and ``n_removed``."""
    docs = docs.drop("n_words", "n_removed")
    doc, th, asks, proofs_ = fresh([*docs.columns, "n_words", "n_removed"], "_doc", "_th", "_asks", "_proofs")
    keyed = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))).withColumn(th, F.xxhash64("text"))
    paths = materialize(copied_paths(keyed.select(F.col(doc).alias("doc"), F.col(th).alias("th"), "text"), k, m, spread), "paths")
    blocks = F.sequence(F.expr(f"src_s div {GRID}"), F.expr(f"(src_s + n + {k - 2}) div {GRID}"))
    end = F.col("src_s") + F.col("n") + (k - 1)
    pieces = paths.select("src_doc", "src_th", "src_s", "n", F.explode(blocks).alias("g"))
    pieces = pieces.select(F.col("src_doc").alias("doc"), F.col("src_th").alias("th"), F.greatest(F.col("src_s"), F.col("g") * GRID).cast("int").alias("s"), F.least(end, (F.col("g") + 1) * GRID).cast("int").alias("end"))
    pieces = pieces.select("doc", "th", "s", (F.col("end") - F.col("s")).alias("n")).distinct()
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("src_doc", "bigint"), ("src_th", "bigint"), ("src_s", "int"))]
    both = pieces.select("doc", "th", "s", "n", *nothing).unionByName(paths)
    per_doc = both.groupBy("doc", "th").agg(F.collect_list(F.struct("doc", "th", "s", "n", "src_doc", "src_th", "src_s")).alias(asks))
    joined = keyed.join(per_doc.select(F.col("doc").alias(doc), F.col("th").alias(th), asks), [doc, th], "left").select(*docs.columns, asks)
    done = materialize(_cut(joined, asks, "text", k, proofs_), "deduped")
    proofs = done.select(F.explode(proofs_).alias("p")).groupBy("p.doc", "p.th", "p.s", "p.n").agg(F.min("p.digest").alias("a"), F.max("p.digest").alias("b"))
    if proofs.where("a <> b").limit(1).count():
        if spread:
            raise RuntimeError("windows with other words have the same hashes")
        return substring_dedup(docs, k, m, spread=True)
    return done.drop(proofs_)


def op12_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 20), ' ') AS seq FROM d, UNNEST(range(len(w) - 19)) u(i)),
c AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) > 1),
g AS (SELECT DISTINCT doc_id, i + j AS i FROM c, UNNEST(range(20)) u(j)),
t AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
k AS (SELECT t.doc_id, count(*) FILTER (g.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY t.i) FILTER (g.i IS NULL) AS kept FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
