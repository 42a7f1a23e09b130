"""op6: repeated passages in foreign lines, against a brute force over lines that knows no chunks."""

import random
from collections import Counter

import pytest

from quarrystone.llm import op6_line_chunks
from quarrystone.llm.registry import QUERIES

WORDS = "river stone house maple winter garden quiet engine copper jardin maison garten strasse 東京".split()


def lines(rng, n, words=9):
    return [" ".join(rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(words)) for _ in range(n)]


def kept_lines(docs, min_words=8):
    """The texts' lines without those of every run of pairs of lines that an earlier pair, not overlapping, equals."""
    first, out = {}, []
    for doc, text in sorted(docs):
        parts = text.split("\n")
        copy = [first.setdefault(pair := (parts[i], parts[i + 1]), (doc, i)) not in ((doc, i), (doc, i - 1)) for i in range(len(parts) - 1)]
        gone, i = set(), 0
        while i < len(copy):
            j = i
            while j < len(copy) and copy[j]:
                j += 1
            if j > i and sum(len(x.split()) for x in parts[i : j + 1]) >= min_words:
                gone |= set(range(i, j + 1))
            i = max(j, i + 1)
        out.append((doc, [x for k, x in enumerate(parts) if k not in gone]))
    return out


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(11)
    docs, passages = [], []
    for size in range(2, 11):
        for _ in range(8):
            passage = lines(rng, size)
            passages.append(passage)
            for _ in range(2):
                docs.append([*lines(rng, rng.randint(3, 12)), *passage, *lines(rng, rng.randint(3, 12))])
    one, pair, short = lines(rng, 1), lines(rng, 2), ["a b", "c"]
    docs += [[*lines(rng, 4), *one, *lines(rng, 4)] for _ in range(2)]  # one line stays
    docs += [[*lines(rng, 3), *short, *lines(rng, 3)] for _ in range(2)]  # too few words
    docs += [[*lines(rng, 2), *pair], [*pair, *lines(rng, 2)], pair, [*pair, ""], [*pair, *pair, *pair], one * 2, one * 3, one * 7, [x for k in range(12) for x in (f"w{k}", "z")]]
    docs += [docs[0], [*docs[0][:5], "one more line", *docs[0][5:]], [f"w{k // 2}" if k % 2 == 0 else "z" for k in range(24)]]
    return passages, list(enumerate("\n".join(d) for d in docs))


def test_every_planted_passage_is_cut(spark, planted):
    passages, docs = planted
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.text for r in op6_line_chunks.line_dedup(df, pairs=True).collect()}
    want = {doc: "\n".join(left) for doc, left in kept_lines(docs)}
    assert {d: t.removesuffix("\n") for d, t in got.items()} == {d: t.removesuffix("\n") for d, t in want.items()}
    held = Counter(x for t in got.values() for x in t.split("\n"))
    assert all(held[x] == 1 for p in passages for x in p)
    assert {x for _, t in docs for x in t.split("\n") if x} <= set(held)  # the first of each line stays


def test_query_cuts_them(spark, planted, tmp_path):
    _, docs = planted
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    want = {doc: len(left) for doc, left in kept_lines(docs)}
    got = {r.doc_id: (r.kept_lines, r.kept_chars) for r in QUERIES["op6_line_dedup"](spark, str(tmp_path)).collect()}
    assert all(abs(got[d][0] - max(1, n)) <= 1 for d, n in want.items())
    staged = op6_line_chunks.stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert {r.doc_id: r.n_chars for r in staged} == {d: n for d, (_, n) in got.items() if n}
