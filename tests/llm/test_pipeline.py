"""The pipeline's stages one by one, and its result against a version in plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_contracts import brute_components, sentence
from test_op6_passages import kept_lines

from quarrystone.llm import op2_language_id, op8_packing
from quarrystone.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        sizes.append(docs.count())
        if name != "pack":
            assert docs.columns == cols
        if name == "near":
            assert docs.count() == docs.select("doc_id").distinct().count()
        if name == "mix":
            words = docs.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
            held = docs
    assert sizes[1] <= sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2] and words > 0
    assert docs.agg(F.countDistinct("doc_id")).first()[0] == held.agg(F.countDistinct("doc_id")).first()[0]
    fill = docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.avg("n")).first()
    assert fill[0] <= 2048 and fill[1] > 1500


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_mix(rows):
    """(row, times) by hash thresholds, each source alone and in the order of its hashes."""
    size = lambda r: len(r[1].split())
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r) for r in rows if r[3] == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), sum(total.values())
    while open_:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > 3 * total[s]]
        if not over:
            target |= part
            break
        for s in over:
            target[s] = 3 * total[s]
            left -= target[s]
            open_.discard(s)
    out = []
    for s in sources:
        own = [(int(hashlib.md5(str(r[0]).encode()).hexdigest()[:12], 16), r) for r in rows if r[3] == s]
        full = int(target[s] // total[s]) if total[s] else 0
        rest, before, more = target[s] - full * total[s], 0, set()
        for h in sorted({h for h, _ in own}):
            w = sum(size(r) for x, r in own if x == h)
            if before > rest:
                break
            if before + w <= rest or before + w - rest < rest - before:  # whole, or as the nearer end
                more.add(h)
            before += w
        out += [(r, full + (h in more and full < 3)) for h, r in own]
    return out


def test_run_equals_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(23)
    passage = "\n".join(sentence(rng, 12) for _ in range(5))
    texts = [sentence(rng, rng.randint(20, 400)) for _ in range(60)]
    texts += [texts[0], texts[1] + " tail", texts[2].replace("the", "of", 1), "!!! 42", "", None, "\n".join([sentence(rng, 9), passage, sentence(rng, 9)]), "\n".join([sentence(rng, 9), sentence(rng, 9), passage]), passage]
    rows = [(i * 7 % 101, t, rng.choice(["en", "fr"]), rng.choice(["a", "a", "a", "b", None]), 3) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = op2_language_id.learned(docs)
    with np.errstate(over="ignore"):
        kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1]) and model.predict(r[1])[1] >= 0.4]
    left = {d: "\n".join(x) for d, x in kept_lines([(r[0], r[1]) for r in kept])}
    cut = [(r[0], left[r[0]], *r[2:]) for r in sorted(kept, key=lambda r: r[0]) if left[r[0]].strip()]
    _, component = brute_components([r[1] for r in cut])
    near = [r for i, r in enumerate(cut) if component[i] == i]
    encode = Tokenizer.from_file(op8_packing.tokenizer_path("word_bpe_49k.json")).encode
    want = Counter()
    for r, times in plain_mix(near):
        ids = np.array([*encode(r[1], add_special_tokens=False).ids, 1], "<u4")
        for start, length, _ in op8_packing.cuts(len(ids)):
            want[r[0], start, length, zlib.crc32(ids[start:start + length].tobytes()), len(ids)] += times
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == Counter({k: n for k, n in want.items() if n}) and len(near) < len(cut) < len(kept) < len(rows)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 2048


def test_run_on_awkward_rows(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "!!!", "en", None, 3), (4, "some words of plain text here", "en", "a", 20), (4, "some words of plain text here", "en", "a", 20), (5, "d'autres mots de texte ici encore", "fr", "b", 20)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    # of 12 words a gets 4 and b 8; a document of six words is the nearest for both
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == {4: 1, 5: 1}


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
