"""Clashing names, skew, ties, deep trees and foreign letters, each against plain Python."""

import hashlib
import itertools
import json
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_contracts import SCHEMA, WORDS, awkward, brute_components, sentence

from quarrystone.llm import (
    common,
    op1_interleaved,
    op2_language_id,
    op3_tool_calls,
    op4_kd_sharding,
    op5_mixing,
    op6_line_chunks,
    op7_spotsigs,
    op8_packing,
    op9_signature_trees,
    op10_secrets,
)
from quarrystone.llm.registry import QUERIES


@pytest.fixture(scope="module")
def rows():
    return awkward(random.Random(17))


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("hard"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    return d


CLASH = ["_row", "_key", "_found", "_removed", "_s", "_rid", "_weight", "_at", "_node", "_v", "_d0", "_letters", "_id", "_th", "_block", "_copy", "_rank", "takes", "target", "source_size", "spans", "shard", "score", "lang_pred", "full", "threshold", "level", "key"]


@pytest.fixture(scope="module")
def clashing(spark, rows):
    """The awkward rows with a column for each name that an operator might use."""
    df = spark.createDataFrame(rows, SCHEMA).drop("_node", "shard", "size", "hash", "n_chars")
    return common.materialize(df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH], F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"), F.xxhash64("doc_id").alias("hash")), "clash")


def own_columns(df, replaced=()):
    """Every clashing column that the operator does not own came through."""
    kept = [c for c in CLASH if c not in replaced]
    got = df.select(kept).distinct().collect()
    return len(got) == 1 and all(got[0][c] == f"own {c}" for c in kept)


def test_clashing_names_pass_through(spark, clashing, rows):
    model = op2_language_id.learned(clashing)
    assert own_columns(op2_language_id.identify(clashing, model), ("lang_pred", "score"))
    sharded = op4_kd_sharding.kd_shards(clashing, {"doc_id": F.col("doc_id"), "level": F.length("level")}, F.col("size"), F.col("doc_id"), leaves=4)
    assert own_columns(sharded, ("shard",)) and sharded.columns.count("shard") == 1 and sharded.count() == len(rows)
    mixed = op5_mixing.mix_sources(clashing)
    assert own_columns(mixed, ("takes", "target", "source_size")) and len(set(mixed.columns)) == len(mixed.columns) and mixed.count() == len(rows)
    assert own_columns(op6_line_chunks.line_dedup(clashing, pairs=True), ("_removed",))
    found = op10_secrets.secret_spans(clashing)
    assert own_columns(found, ("spans",)) and found.count() == len(rows)
    for stage in (op2_language_id.stage, op6_line_chunks.stage, op9_signature_trees.stage, op5_mixing.stage):
        out = stage(spark, clashing, "")
        assert out.columns == clashing.columns and own_columns(out)
    assert op8_packing.stage(spark, clashing, "").count() >= len(rows)
    assert own_columns(op7_spotsigs.with_next(clashing.drop("_block", "_copy"), "doc_id"), ("_block", "_copy"))


def test_fresh_names():
    assert common.fresh(["a", "A_", "_x"], "a", "_X", "b") == ["a__", "_X_", "b"]


def test_op1_sequences_equal_plain_python(spark, sf, rows):
    want = Counter()
    for r in rows:
        text = r[1] or ""
        b = text.encode()
        p = b + b"\0" * (-len(b) % 64 if b else 64)
        digest, caption = hashlib.sha256(p).hexdigest(), f"text of {len(b)} bytes"
        first, *rest = text.split("\n")
        items = [("text", x) for x in [first] if x.strip()] + [("media", caption)] + [("text", x) for x in rest if x.strip()] + [("media", "again: " + caption)]
        told = [f"{i}|text|{hashlib.md5(x.encode()).hexdigest()[:16]}" if kind == "text" else f"{i}|media|{x}|{digest}" for i, (kind, x) in enumerate(items)]
        want[r[0], len(b), digest, len(items), len(items) - 2, hashlib.sha256("\n".join(told).encode()).hexdigest(), True] += 1
    got = QUERIES["op1_interleaved_media"](spark, sf)
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.n_items, r.n_texts, r.sequence_sha256, r.aligned) for r in got.collect()) == want
    media = got.select("payload_sha256", "media_bytes", "media_sha256", "feature").distinct().collect()
    texts = {hashlib.sha256(p).hexdigest(): p for r in rows for b in [(r[1] or "").encode()] for p in [b + b"\0" * (-len(b) % 64 if b else 64)]}
    for m in media:
        png, x = op1_interleaved.to_png(texts[m.payload_sha256]), np.frombuffer(texts[m.payload_sha256], np.uint8)
        assert (m.media_bytes, m.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        bins = ",".join(str(sum(int(v) // 16 == k for v in x) * 1000 // len(x)) for k in range(16))
        assert m.feature == f"mean={x.mean():.3f};std={x.std():.3f};hist={bins}"


def test_op2_learns_a_rare_language_and_equals_plain_python(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 20), "en" if i % 2 else "fr") for i in range(3000)] + [(5000 + i, "жук дом лес река " * 3 + str(i), "ru") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = op2_language_id.fit(df.select(F.col("doc_id").alias("id"), "text", "lang"), max_train=400)
    assert model.langs == ["en", "fr", "ru"] and model.predict("лес и дом")[0] == "ru"
    assert op2_language_id.quotas({"a": 5, "b": 1000, "c": 700}, 300) == {"a": 5, "c": 147, "b": 148}
    got = {r.doc_id: (r.lang_pred, r.score) for r in op2_language_id.identify(df, model).collect()}
    with np.errstate(over="ignore"):
        for i, text, _ in rows[::300]:
            z = np.log1p(0) + model.logits(*op2_language_id.grams(text)) / model.temperature
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            assert got[i][0] == model.langs[int(p.argmax())] and abs(got[i][1] - p.max()) < 1e-9
    long = "la maison " * 150_000
    with np.errstate(over="ignore"):
        idx, n = op2_language_id.grams(long)
    assert n.sum() == 3 * len(long) - 3


CALL = "conv_id long, turn long, kind string, role string, call_id string, parents array<string>, name string, arguments string, content string"


def test_op3_names_count_within_their_conversation(spark):
    m = [
        (1, 0, "call", "assistant", "call_0", None, "f", "{}", None), (3, 0, "result", "tool", "call_0", None, None, None, "r"), (2, 0, "call", "assistant", "call_0", ["call_1"], "f", "{}", None),
        (2, 1, "result", "tool", "call_0", None, None, None, "r"), (2, 2, "call", "assistant", "call_1", [], "f", "{}", None), (None, 0, "call", "a", "call_0", None, "f", "{}", None), (None, 1, "result", "t", "call_0", None, None, None, None),
    ]
    got = {(r.conv_id, r.turn): (r.linked, r.level) for r in op3_tool_calls.link_tool_calls(spark.createDataFrame(m, CALL), {"f": {}}).collect()}
    assert got == {(1, 0): (False, 0), (3, 0): (False, None), (2, 0): (True, 2), (2, 1): (True, 3), (2, 2): (False, 0), (None, 0): (True, 0), (None, 1): (True, 1)}


def test_op3_levels_of_a_graph(spark):
    rng = random.Random(6)
    edges = [(i, p) for i in range(60) for p in rng.sample(range(i), min(i, rng.randint(0, 3)))] + [(70, 71), (71, 72), (72, 70), (73, 70), (73, 1), (74, 999)]
    ids = {i for i in range(60)} | {70, 71, 72, 73, 74}
    want = {}
    for i in range(60):
        want[i] = max((want[p] + 1 for x, p in edges if x == i), default=0)
    want |= {70: None, 71: None, 72: None, 73: None, 74: 0}
    rows = [(str(i), str(p)) for i, p in edges] + [(str(i), None) for i in ids]
    got = {int(r.id): r.level for r in op3_tool_calls.levels(spark.createDataFrame(rows, "id string, parent string")).collect()}
    assert got == want


def test_op3_nested_schemas_and_ties(spark):
    schema = {"book": {"seat": ({"type": "string", "enum": ["aisle", "window"]}, True), "who": ({"type": "object", "closed": True, "fields": {"age": ("integer", True), "names": ({"type": "array", "items": "string"}, False)}}, False)}}
    cases = {
        '{"seat":"aisle"}': "", '{"seat":"roof"}': "seat is none of its values", '{"seat":1}': "seat is not string", '{"seat":"aisle","more":1}': "call holds unnamed more",
        '{"seat":"window","who":{"age":3,"names":["a"]}}': "", '{"seat":"window","who":{"names":["a",2],"x":0}}': "missing who.age; who.names holds other than string; who holds unnamed x", '{"seat":"window","who":[]}': "who is not object",
    }
    m = [(1, i, "call", "assistant", f"c{i}", None, "book", a, None) for i, a in enumerate(cases)]
    got = {r.turn: r.problems for r in op3_tool_calls.link_tool_calls(spark.createDataFrame(m, CALL), schema, closed=True).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    ties = [(1, 0, "call", "a", "t", None, "b", "{}", None), (1, 0, "call", "a", "t", None, "a", "{}", None), (1, 0, "call", "a", "t", None, "a", "{}", None), (1, 1, "result", "t", "t", None, None, None, None)]
    out = op3_tool_calls.link_tool_calls(spark.createDataFrame(ties, CALL).withColumn("key", F.lit("own")), {"a": {}, "b": {}}).collect()
    assert Counter((r.turn, r.linked) for r in out) == {(0, True): 2, (0, False): 1, (1, True): 1}
    assert all(json.loads(r.json) for r in out)


def test_op4_sizes_are_near_equal(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_kd_shards"](spark, sf).groupBy("shard").agg(F.sum("size").alias("n"), F.max("size").alias("most"), F.count(F.lit(1)).alias("rows"), F.max("slot").alias("last")).collect()
    sizes = [r.n for r in got]
    # no row is split, so shards may differ by one
    assert len(got) == 24 and max(sizes) - min(sizes) <= max(r.most for r in got) and all(r["last"] == r["rows"] - 1 for r in got)
    words = ["", "a", "b", "ba", "de", "en", "zz"]
    codes = [r.c for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(op4_kd_sharding.alphabetical(F.col("w")).alias("c")).collect()]
    assert codes == sorted(codes) and len(set(codes)) == len(words)


def test_op7_blocks_hold_under_skewed_ids(spark):
    df = spark.range(50_000).select("id", F.lit("x").alias("text")).union(spark.createDataFrame([(2**60, "y")], "id long, text string"))
    got = op7_spotsigs.with_next(df, "id").groupBy("_block").agg(F.count(F.lit(1)).alias("n"), F.count_if("_copy").alias("copies"), F.min(F.when(~F.col("_copy"), F.col("id"))).alias("low"), F.min(F.when(F.col("_copy"), F.col("id"))).alias("next")).orderBy("_block").collect()
    assert len(got) >= 45 and max(r.n for r in got) < 1500 and all(r.copies == 1 for r in got)
    assert all(a["next"] == b["low"] for a, b in itertools.pairwise(got)) and got[-1]["next"] == got[0]["low"]
    few = spark.createDataFrame([(None, "n"), (1, "a"), (1, "b"), (2, "c")], "id long, text string")
    assert op7_spotsigs.with_next(few, "id").where("_copy").select("text").first().text == "n"


def test_op8_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    path = op8_packing.tokenizer_path("word_bpe_49k.json")
    whole, known, rng = Tokenizer.from_file(path), op8_packing._Ids(path), random.Random(8)
    pool = [*"abcXYZ019 .,;:!?'\"-_/()\n\t\r  ", *"İıßﬁŉǰÅÅéñÇşĞğ", *"’‘“”…–—«»", *"़̧́̇̈‍️", *"क़शिכּשׁαΣςДжЁ東京カが가각", *"😀👍🏽  \u0085­İẞⅧ²½", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "i̇", "İ.", "SS."]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(100_000)] + ["TÜRKİYE’Lİ, ABD’Lİ.", "“ESKİ.", "2024’TEKİ,", "क़. שׁ, é."]
    encoded = whole.encode_batch(texts, add_special_tokens=False)
    for text, e in zip(texts, encoded, strict=True):
        got = b"".join(known[x] for x in text.replace("\n", " ").split(" "))
        assert np.frombuffer(got, "<u4").tolist() == e.ids, text


def near_texts(rng, groups=14):
    texts = []
    for _ in range(groups):
        words = sentence(rng, rng.choice([3, 5, 8, 40, 200])).split()
        for _ in range(rng.choice([1, 2, 12])):
            edit = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                edit[rng.randrange(len(edit))] = rng.choice(WORDS)
            texts.append(" ".join(edit))
    return texts


@pytest.mark.parametrize("unit", [1000, 5])
def test_op9_exact_way_equals_all_pairs(spark, unit):
    texts = near_texts(random.Random(31))
    n, comp = brute_components(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op9_signature_trees.near_components(df, unit=unit, exact=True).collect()}
    assert got == {i: (n[i], comp[i]) for i in range(len(texts))}


def test_op9_prefixes_of_near_sets_meet():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 60), dtype=np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) < 0.9], rng.integers(0, 2**64, rng.integers(0, 6), dtype=np.uint64)))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
            assert set(op9_signature_trees.prefix_keys(a, 75, 100).tolist()) & set(op9_signature_trees.prefix_keys(b, 75, 100).tolist())


def test_op9_deep_trees_prune_node_pairs(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**9)}" for _ in range(120)]
    texts = [" ".join([*base, f"tail{i}"]) for i in range(90)]  # 90 sharers of a key
    for _ in range(60):
        words = [f"v{rng.randrange(10**9)}" for _ in range(rng.randint(30, 200))]
        texts += [" ".join(words), " ".join([*words, "more"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    sets = common.materialize(op9_signature_trees.shingle_sets(df), "sets")
    reps = sets.groupBy("cid").agg(F.min(F.struct("doc_id", "th")).alias("rep"))
    walks = op9_signature_trees.set_links(df, sets, reps, 5, 75, 100, 1000).agg(F.sum("met"), F.sum("pruned"), F.count_if(F.col("cid") != F.col("root"))).first()
    assert walks[1] > 0.25 * walks[0] > 0 and walks[2] == 89 + 60
    with np.errstate(over="ignore"):
        tree = op9_signature_trees.SignatureTree([op9_signature_trees.shingles(t, 5, op9_signature_trees._WordHashes()) for t in texts])
    assert len(tree.levels) >= 5


def test_op9_stage_keeps_rows_of_one_id_with_other_texts(spark):
    rng = random.Random(4)
    a, b = sentence(rng, 60), " ".join(f"q{i}" for i in range(40))
    rows = [(1, a, "s1"), (1, b, "s1"), (2, a, "s2"), (2, a, "s2"), (3, b + " end", "s1"), (4, None, "s"), (4, None, "s"), (5, "", None), (None, a, "s"), (None, a, "s")]
    out = op9_signature_trees.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    assert Counter(map(tuple, out.collect())) == Counter([(1, a, "s1"), (1, b, "s1"), (4, None, "s"), (4, None, "s"), (5, "", None), (None, a, "s"), (None, a, "s")])


def test_op10_all_spans_and_verdicts_equal_plain_regexes(spark):
    rng = random.Random(10)
    letters = "abcdefghijklmnopqrstuvwxyz"
    live, copied, shared = "Zk39xQp7Lm2Vt8Rb4Nc6Hd1W", "Qa81zXw0Pn5Ys3Tv7Bk2Jf9L", "Mm41aBc2De3Fg4Hi5Jk6Ln7O"
    long = letters * 4 + "Aa1"
    texts = [f"use {live} here", f"{copied}", f"{copied} {copied}", copied, f"x {shared}", f"y={shared} z", "abcdefghijklmnopqrstuvwx1 Hello", long, f"token: {live[::-1]} 😀 password = hunter2hunter2 AKIA" + "B" * 16, "secret=EXAMPLEexample123456789012", "aaaaaaaaaaaaaaaaaaaaaaA1", None, "", " ".join(f"token={rng.randrange(16**20):020x}" for _ in range(300))]
    rows = [(i, t, f"o{i}") for i, t in enumerate(texts)] + [(100 + i, "Rr55tTy6Uu7Ii8Oo9Pp0Aa1S", "one owner") for i in range(30)]
    pats = {"assign": re.compile(op10_secrets.ASSIGN), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+"), "token": re.compile("[A-Za-z0-9+/_=-]+")}
    least = {"assign": 12, "access": 18, "hex": 16, "token": 24}
    found = {}
    for i, t, _ in rows:
        found[i] = []
        for kind, p in pats.items():
            for m in p.finditer(t or ""):
                v = m[2] if kind == "assign" else m[0]
                mixed = re.search("[0-9]", v) and re.search("[A-Z]", v) and re.search("[a-z]", v)
                if len(v) >= least[kind] and (kind != "token" or mixed):
                    found[i].append((kind, m.start(), m.end(), v))
    owners, repositories = {}, {}
    for i, _, o in rows:
        for *_, v in found[i]:
            owners.setdefault(v, set()).add(o)
            repositories.setdefault(v, set()).add(i)

    def verdict(v):
        if len(owners[v]) >= 3 or len(repositories[v]) >= 25:
            return "copied"
        if re.search(op10_secrets.PLACEHOLDER, v) or len(set(v)) < op10_secrets.VARIETY:
            return "made_up"
        return "live" if len(owners[v]) == 1 else "shared"

    want = {i: sorted((k, s, e, hashlib.sha256(v.encode()).hexdigest(), len(owners[v]), len(repositories[v]), verdict(v)) for k, s, e, v in x if k != "token" or verdict(v) == "live") for i, x in found.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: sorted(map(tuple, r.spans)) for r in op10_secrets.secret_spans(df).collect()}
    assert got == want
    assert [len(want[i]) for i in (0, 1, 6, 7, 100)] == [1, 0, 0, 1, 0] and len(want[13]) == 600
