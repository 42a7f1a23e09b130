"""op11, op12 and op13 against plain Python on small and awkward tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import op11_prefix_trie, op12_repeated_spans, op13_periodic_runs
from quarrystone.llm.registry import QUERIES

DOCS = "doc_id bigint, text string, n_words string, runs string, _doc int, _th int, _proofs string, doc int, th int"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# op11


def nodes(rows):
    """The contract's nodes of conversation rows, path by path."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - c % 100, [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(path))))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), sum(len(p) == len(path) + 1 for p in below), leaves, saved, sha(ends)))
    return sorted(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(4)
    say = lambda: rng.choice(["hi", "hi", "yes", "no", "", None, "çà 東京", "ok " * 9])
    rows = [(c, t, rng.choice(["user", "user", "assistant", None]), say()) for c in [*range(60), *range(100, 130), 205, 399] for t in range(rng.randint(1, 5))]
    rows += [(c, None, "user", "no turn") for c in (3, 100, 399)] + [(7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, 1, "user", "ties")] + [(None, 0, "user", "nobody's")]
    rows += [(8, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(70)] + [(c, t, "user", "same") for c in (301, 302, 303) for t in range(9)]
    return rows + rows[:5]


def test_trie_equals_plain_python(spark, talk, tmp_path):
    df = spark.createDataFrame(talk, "conv_id bigint, turn bigint, role string, text string").withColumns({"depth": F.lit("x"), "name": F.lit(1), "at": F.lit(2)})
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op11_prefix_trie"](spark, str(tmp_path)).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == nodes(talk)


def test_trie_of_turnless_conversations(spark):
    convs = spark.createDataFrame([(5,), (9,), (9,)], "conv_id bigint")
    none = spark.createDataFrame([], "conv_id bigint, at bigint, role string, text string")
    assert [tuple(r)[:7] for r in op11_prefix_trie.prefix_trie(convs, none).select(COLUMNS).collect()] == [(5, 0, None, 2, 0, 1, 0)]


def test_a_long_conversation_is_numbered_in_order(spark):
    rows = [(1, t % 700, "user", str(t % 7)) for t in range(5000)] + [(2, 0, "a", "b")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7)
    got = [(r.conv_id, r.at, r.text) for r in op11_prefix_trie.numbered_turns(df).collect()]
    want = [(1, i, x[3]) for i, x in enumerate(sorted(rows[:-1]))]
    assert sorted(got) == sorted([*want, (2, 0, "b")])


# op12


def left(rows, k=20):
    """doc_id, words, removed, kept of each row: windows in a dict of all their places."""
    docs = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    places = defaultdict(list)
    for doc in docs:
        w = words(doc[2])
        for i in range(len(w) - k + 1):
            places[tuple(w[i : i + k])].append((doc, i))
    gone = defaultdict(set)
    for found in places.values():
        for doc, i in found:
            if any(d[:2] < doc[:2] or d == doc and j < i for d, j in found):
                gone[doc] |= set(range(i, i + k))
    out = []
    for r in rows:
        doc, w = (r[0] is not None, r[0] or 0, r[1] or ""), words(r[1])
        out.append((r[0], len(w), len(gone[doc]), sha(" ".join(x for i, x in enumerate(w) if i not in gone[doc]))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def copied():
    rng = random.Random(8)
    some = lambda n, v=10**6: [f"w{rng.randrange(v)}" for _ in range(n)]
    passage, common = some(60), some(22)
    texts = [None, "", " \t\n\r\x0b\x0c", "one", " ".join(some(19)), " ".join(passage[:20]), " ".join(passage), "\n".join([*some(30), *passage, *some(5)]), " ".join(some(40)), "  " + " ".join(some(25))]
    texts += [" ".join([*some(rng.randint(0, 12)), *passage[i : i + rng.randint(19, 45)], *some(rng.randint(0, 12))]) for i in range(0, 40, 3)]
    texts += [" ".join(["a"] * n) for n in (19, 20, 21, 60)] + [" ".join(some(70, 2)) for _ in range(6)] + [" ".join([*passage[:25], *some(3), *passage[:25], *passage[10:35]])]
    texts += [" ".join([*some(9), *common, *some(9)]) for _ in range(150)] + [" ".join(some(9000, 50000)), " ".join([*some(30), *(long := some(3000)), *some(4)]), " ".join(long[:2500]), "x" * 70000 + " y" * 30]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (7, texts[6]), (7, " ".join([*some(3), *passage])), (None, texts[6]), (None, texts[7]), (-4, texts[20]), (10**12, texts[6] + " and more")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("how", ["query", "spread", "small batches", "many heavy"])
def test_repeated_spans_equal_plain_python(spark, copied, tmp_path, how):
    df = spark.createDataFrame([(*r, "n", "r", 1, 2, "p", 3, 4) for r in copied], DOCS).repartition(6)
    if how == "query":
        df.write.parquet(f"{tmp_path}/documents.parquet")
        got = QUERIES["op12_repeated_spans"](spark, str(tmp_path))
    else:
        was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3" if how == "small batches" else was)
        try:
            if how == "many heavy":
                keyed = df.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("th"), "text")
                heavy = np.unique(np.concatenate([x[0] for x in routes(keyed)]))[::2]
                rows = op12_repeated_spans._index(keyed.where("text is not null"), 20, 8, heavy)
                one = op12_repeated_spans._sources(rows.coalesce(1).sortWithinPartitions("route", "doc", "th", "s"))
                assert covered(one) == covered(op12_repeated_spans.copied_paths(keyed))
                return
            done = op12_repeated_spans.substring_dedup(df, spread=how == "spread")
            assert done.columns == [c for c in df.columns if c != "n_words"] + ["n_words", "n_removed"]
            got = done.withColumn("kept_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
            assert all(r._proofs == "p" and r._doc == 1 and r.th == 4 for r in got)
            got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got]
            assert sorted(got, key=repr) == left(copied)
            return
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == left(copied)


def routes(keyed):
    for r in keyed.where("text is not null").collect():
        for w in op12_repeated_spans.in_words(pa.array([r.text])):
            if found := op12_repeated_spans._edges(w, np.array([r.doc]), np.array([r.th]), 20, 8, np.array([], np.uint64)):
                yield found


def covered(paths):
    return {(r.doc, r.th, r.s + i) for r in paths.collect() for i in range(r.n)}


def test_minimizers_that_many_share_are_told(spark):
    rng = random.Random(2)
    phrase = " ".join(f"p{i}" for i in range(14))
    rows = [(i, f"{' '.join(f'w{rng.randrange(10**6)}' for _ in range(12))} {phrase} {' '.join(f'w{rng.randrange(10**6)}' for _ in range(12))}") for i in range(3000)]
    keyed = spark.createDataFrame(rows, "doc bigint, text string").withColumn("th", F.xxhash64("text")).select("doc", "th", "text")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        assert 1 <= len(op12_repeated_spans._heavy(keyed, 20, 8)) <= 128
        assert covered(op12_repeated_spans.copied_paths(keyed)) == set()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


# op13


def runs(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                out.append((start, i - start + q, q))
            i += 1
    return sorted((r for r in out if not any(x[2] < r[2] and x[0] <= r[0] and sum(x[:2]) >= sum(r[:2]) for x in out)), key=lambda r: (r[0], r[2]))


def periodic(doc, text):
    w = words(text)
    n, h = len(w), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(found), *told, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.fixture(scope="module")
def looping():
    rng = random.Random(6)
    texts = [None, "", " \n\t", "one", "é " * 11, "é " * 12, " a b" * 6, "a b c d e f " * 2, "a b c d e f " * 2, "x" * 60000, "\r\n".join(["tick tock"] * 400), " ".join(f"v{i % 700}" for i in range(2100))]
    for _ in range(400):
        v = "abcdefgh"[: rng.randint(1, 8)]
        w = [rng.choice(v) for _ in range(rng.randint(0, 80))]
        if w and rng.random() < 0.6:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(v) for _ in range(rng.randint(1, 9))] * rng.randint(2, 6)
        texts.append(" ".join(w))
    rows = [(i * 7 - 50, t) for i, t in enumerate(texts)]
    return rows + rows[9:14] + [(None, "a " * 30), (None, None)]


def test_runs_equal_plain_python(spark, looping, tmp_path):
    df = spark.createDataFrame([(*r, "n", "r", 1, 2, "p", 3, 4) for r in looping], DOCS).repartition(4)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_periodic_runs"](spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((periodic(*r) for r in looping), key=repr)
    done = op13_periodic_runs.periodic_runs(df)
    assert done.columns == [c for c in df.columns if c != "runs"] + ["runs", "collapsed"]
    assert all(r._doc == 1 and (r.collapsed is None) == (r.text is None) for r in done.collect())


def test_runs_in_small_slices(looping):
    texts = [t for _, t in looping]
    want = [runs(words(t)) for t in texts]
    for some in (1, 300, 10**9):
        assert op13_periodic_runs.runs_of(pa.array(texts), 12, some)[0] == want
    assert op13_periodic_runs.runs_of(pa.array(texts), 4)[0] == [runs(words(t), 4) for t in texts]
