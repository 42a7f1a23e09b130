"""Periodic runs by descending-LCP Kruskal.

A run is a stretch of words with smallest period q, at least twice as long as q, that
no neighbouring word extends. Within a document, suffixes are put in order and the
longest common prefix (LCP) of neighbours is an edge between them. Edges are taken by
decreasing LCP, as in Kruskal's algorithm: each unites two classes of suffixes, whose
members are kept as ordered positions. Where the union makes positions i < j neighbours
in this order and j - i <= LCP, words i to j + LCP have the period j - i, and a run begins
at i if the words before i and j differ. Two positions of one run that are a period apart
are never parted by another member of their class, since a nearer one would give the
words a smaller period; so each run is found once, with its smallest period.

Runs shorter than ``least`` words are not looked for: a run of that length has two equal
stretches of half of it, so suffixes whose first ``least // 2`` words are met nowhere else
in the document stand alone and are left out before suffixes are ordered. Suffixes are
ordered by doubling, for many documents at once, and LCPs are read from the doubled ranks.
Documents are apart: there is no shuffle, and a task holds about ``some`` bytes of texts
at a time, or one longer text.

Defined results: null and empty texts have no words, no runs and an empty collapsed text
(null if the text is null); repeated rows are handled alike; a word of any length is one
word; a word that several runs hold goes if any of them drops it; rows and all other
columns stay, but ``runs`` and ``collapsed`` are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.llm.common import CRC_TABLE, crc_sql, read_table
from quarrystone.llm.words import in_words

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _repeated(ids: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """The documents in which some stretch of ``least`` words occurs twice, by hashes (more may be named)."""
    if len(ids) < least:
        return np.array([], np.int64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    key = np.zeros(len(ids) - least + 1, np.uint64)
    for i in range(least):
        key = key * np.uint64(0x2545F4914F6CDD1D) + mixed[i : i + len(key)]
    key = (key ^ key >> np.uint64(32)) * np.uint64(0x94D049BB133111EB) + doc[: len(key)].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    key, whole = np.where(doc[: len(key)] == doc[least - 1 :], key, 0), doc[: len(key)] == doc[least - 1 :]
    places = np.flatnonzero(whole)
    order = places[np.argsort(key[places], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    return np.unique(doc[order[1:][same]])


def suffix_edges(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, lcp)`` of neighbours in the order of the suffixes of ``ids`` that share ``least`` words or more.

    Equal words have equal numbers; words of different documents have different ones, so each document's suffixes are together.
    """
    n = len(ids)
    ranks = [np.unique(ids, return_inverse=True)[1]]
    counts = np.bincount(ranks[0])
    ranks[0] = (np.cumsum(counts) - counts)[ranks[0]]  # a class is named by the place of its first suffix
    open_, size = np.flatnonzero(counts[np.unique(ranks[0], return_inverse=True)[1]] > 1), 1
    while len(open_):
        rank = ranks[-1].copy()
        ahead = np.where(open_ + size < n, rank[np.minimum(open_ + size, n - 1)], -1)
        order = np.lexsort((ahead, rank[open_]))
        at, old, new = open_[order], rank[open_][order], ahead[order]
        first = np.r_[True, old[1:] != old[:-1]]
        cut = first | np.r_[True, new[1:] != new[:-1]]
        place = np.arange(len(at))
        begin = np.maximum.accumulate(np.where(first, place, 0))
        rank[at] = old + np.maximum.accumulate(np.where(cut, place, 0)) - begin
        ranks.append(rank)
        alone = cut & np.r_[cut[1:], True]
        open_, size = at[~alone], size * 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    lcp, i, j = np.zeros(n - 1, np.int64), a.copy(), b.copy()
    near = np.arange(n - 1)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (i < n) & (j < n)
        same = near[inside][ranks[k][i[inside]] == ranks[k][j[inside]]]
        step = 1 << k
        lcp[same] += step
        i[same] += step
        j[same] += step
    keep = lcp >= least
    return a[keep], b[keep], lcp[keep]


def kruskal_runs(words: list[int], edges: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of one document, from its edges ``(lcp, i, j)``."""
    own: dict[int, list[int]] = {}
    name: dict[int, int] = {}
    out = []
    for lcp, a, b in sorted(edges, reverse=True):
        for x in (a, b):
            if x not in name:
                name[x], own[x] = x, [x]
        small, large = sorted((name[a], name[b]), key=lambda c: len(own[c]))
        into, new = own[large], own.pop(small)
        for x in new:
            insort(into, x)
        for x in new:
            k = bisect_left(into, x)
            for i, j in ((into[k - 1] if k else x, x), (x, into[k + 1] if k + 1 < len(into) else x)):
                # neighbours of one old class have met before
                if 0 < j - i <= lcp and j - i + lcp >= least and (name[i] != name[j]) and (not i or words[i - 1] != words[j - 1]):
                    out.append((i, j - i + lcp, j - i))
        for x in new:
            name[x] = large
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def runs_of(texts: pa.Array, least: int = 12, some: int = 4_000_000) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """The runs of each text, and each text with one period of every run."""
    found, kept = [[] for _ in range(len(texts))], [b""] * len(texts)
    for w in in_words(texts, some):
        doc = np.repeat(np.arange(len(w.rows)), np.diff(w.starts))
        for k, joined in zip(w.rows, w.joined, strict=True):
            kept[k] = joined
        some_docs = _repeated(w.ids, doc, least // 2)
        if not len(some_docs):
            continue
        # the suffixes of these documents; each has its own numbers for words and one more that closes it
        spans = [(w.starts[d], w.starts[d + 1]) for d in some_docs]
        known = len(w.known)
        joint = np.concatenate([np.r_[w.ids[s:e], known] + k * (known + 1) for k, (s, e) in enumerate(spans)])
        begins = np.cumsum([0] + [e - s + 1 for s, e in spans])
        a, b, lcp = suffix_edges(joint, least // 2)
        within = np.searchsorted(begins, a, side="right") - 1
        order = np.argsort(within, kind="stable")
        cuts = np.searchsorted(within[order], np.arange(len(spans) + 1))
        for k, (s, e) in enumerate(spans):
            mine = order[cuts[k] : cuts[k + 1]]
            if not len(mine):
                continue
            base = begins[k]
            runs = kruskal_runs(w.ids[s:e].tolist(), list(zip(lcp[mine].tolist(), (a[mine] - base).tolist(), (b[mine] - base).tolist(), strict=True)), least)
            if runs:
                row = w.rows[some_docs[k]]
                found[row] = runs
                gone = np.zeros(e - s + 1, np.int64)
                for start, length, period in runs:
                    gone[start + period] += 1
                    gone[start + length] -= 1
                words = kept[row].split(b" ")
                kept[row] = b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)])
    return found, kept


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """``docs`` with ``runs`` (by start, then period) and ``collapsed``: the text without what repeats a run's first period."""
    docs = docs.drop("runs", "collapsed")
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("runs", T._parse_datatype_string(RUNS)), T.StructField("collapsed", T.StringType())])

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            texts = b.column(place)
            runs, kept = runs_of(texts, least)
            empty = texts.is_null().to_pylist()
            flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
            offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(kind.value_type))
            collapsed = pa.array([None if no else k for k, no in zip(kept, empty, strict=True)], pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets), items, type=kind), collapsed], names=[*b.schema.names, "runs", "collapsed"])

    return docs.mapInArrow(run, schema)


def looped(text: Column, doc: Column) -> Column:
    """One text in ten with its end put in a loop: from word a = g % n on, the words that follow a repeat with a period of 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(doc.cast("string"))
    squeezed = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))

    def written(words: Column) -> Column:
        n, g = F.size(words).cast("bigint"), F.floor(h / 10).cast("bigint")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("bigint")
        at = F.sequence(F.lit(0).cast("bigint"), n - 1)
        return F.array_join(F.transform(at, lambda i: F.element_at(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int") + 1)), " ")

    once = F.element_at(F.transform(F.array(F.split(squeezed, " ", -1)), written), 1)  # the words are split once
    return F.when((h % 10 == 0) & (squeezed != ""), once).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text"))
    done = periodic_runs(docs)
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    done = done.withColumn("best", F.when(F.size("runs") > 0, best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    length = -F.col("best.l")
    return done.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("bigint").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )


ORACLE = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w, {crc_sql("doc_id")} AS h FROM documents, bytes),
g AS (SELECT doc_id, w, h % 10 = 0 AND len(w) > 0 AS loops, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM d),
e AS (SELECT doc_id, CASE WHEN loops THEN list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) END]) ELSE w END AS w FROM g),
t AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM e),
q AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
s AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM q) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.doc_id = s.doc_id AND x.q < s.q AND x.s <= s.s AND x.s + x.n >= s.s + s.n)),
l AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS listed, arg_min({{'s': s, 'n': n, 'q': q}}, [-n, s, q]) AS best FROM r GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id AND t.i >= r.s + r.q AND t.i < r.s + r.n) GROUP BY doc_id)
SELECT e.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.n::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.n // best.q)::BIGINT AS exponent_milli,
    sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM e LEFT JOIN l ON l.doc_id = e.doc_id LEFT JOIN k ON k.doc_id = e.doc_id
"""
