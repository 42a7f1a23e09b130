"""op9: a set whose only shared keys are those of a large group of copies."""

import random

import numpy as np

from quarrystone.llm import op9_signature_trees as op9


def text_and_copy(rng):
    """A text of 100 shingles and its first 75, which share 1 to 6 keys."""
    with np.errstate(over="ignore"):
        for _ in range(60_000):
            words = [f"w{rng.randrange(10**9)}" for _ in range(104)]
            sets = [op9.shingles(" ".join(w), 5, op9._WordHashes()) for w in (words, words[:79])]
            keys = [set(op9.band_keys(s).tolist()) for s in sets]
            if 0 < len(keys[0] & keys[1]) <= 6:
                return words
    raise AssertionError("no such pair")


def components(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(80)
    return {r.doc_id: r.component_id for r in op9.near_components(df).collect()}


def test_copy_of_a_crowded_text_is_found(spark):
    rng = random.Random(7)
    words = text_and_copy(rng)
    other = " ".join(f"v{rng.randrange(10**9)}" for _ in range(104))
    exact = [" ".join(words)] * 160
    got = components(spark, [*exact, " ".join(words[:79]), other])
    assert got == {i: 0 for i in range(161)} | {161: 161}
    near = [" ".join([*words, f"tail{i}"]) for i in range(90)]  # near copies, each a set of its own
    got = components(spark, [*near, " ".join(words), " ".join(words[:79]), other])
    assert got == {i: 0 for i in range(92)} | {92: 92}
