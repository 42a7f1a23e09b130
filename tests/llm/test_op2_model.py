"""The language model against plain Python: dictionaries of grams, one number at a time."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import op2_language_id as op2

M = 0xFFFFFFFF
SALT = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
WORDS = {"en": "the river and stone of house with winter quiet", "fr": "le la maison rivière pierre où être hiver", "de": "der die das Straße über Haus und Winter Fluß"}


def plain_grams(text):
    """Counts of the buckets of all 1- to 3-grams."""
    out, code = Counter(), [ord(c) for c in text.lower()]
    for i in range(len(code)):
        h = code[i] * SALT[0] & M
        for n in range(3):
            if n:
                if i + n >= len(code):
                    break
                h = ((h ^ h >> 15) * SALT[n] + code[i + n] * SALT[0]) & M
            out[((h ^ h >> 16) * 0x7FEB352D & M) >> 18] += 1
    return out


def plain_fit(rows, langs):
    """``rows`` of text and language in the order of the sample: weights, bias and temperature."""
    counts = [plain_grams(t) for t, _ in rows]
    df = Counter(b for c in counts for b in c)
    idf = {b: math.log((1 + len(rows)) / (1 + n)) + 1 for b, n in df.items()}

    def vector(c):
        x = {b: (1 + math.log(n)) * idf[b] for b, n in c.items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        return {b: v / length for b, v in x.items()} | {"bias": 1.0}

    data = [(vector(c), lang) for c, (_, lang) in zip(counts, rows, strict=True)]
    train, left = [d for i, d in enumerate(data) if i % 5], data[::5]
    z, n = defaultdict(float), defaultdict(float)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.5

    def weight(key):
        if abs(z[key]) <= l1:
            return 0.0
        return -(z[key] - math.copysign(l1, z[key])) / ((beta + math.sqrt(n[key])) / alpha + l2)

    def logits(x):
        return [sum(weight((k, b)) * v for b, v in x.items()) for k in langs]

    def shares(s):
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]

    for epoch in range(3):
        for i in np.random.default_rng(epoch).permutation(len(train)):
            x, lang = train[i]
            for k, p in zip(langs, shares(logits(x)), strict=True):
                for b, v in x.items():
                    g, w = (p - (k == lang)) * v, weight((k, b))
                    sigma = (math.sqrt(n[k, b] + g * g) - math.sqrt(n[k, b])) / alpha
                    z[k, b] += g - sigma * w
                    n[k, b] += g * g
    told = [(logits(x), langs.index(lang)) for x, lang in left]
    loss = lambda t: -sum(math.log(shares([v / t for v in s])[y]) for s, y in told) / len(told)
    temperature = min((2.0 ** (-3 + 6 * i / 80) for i in range(81)), key=loss)
    return weight, temperature, loss


@pytest.mark.parametrize("text", ["a", "ab", "Straße Été 東京 😀", "x" * 40, "İstanbul ÅNGSTRÖM\n\t z"])
def test_grams(text):
    with np.errstate(over="ignore"):
        idx, n = op2.grams(text)
    assert dict(zip(idx.tolist(), n.tolist(), strict=True)) == dict(plain_grams(text))


def test_weights_and_temperature(spark):
    rng = random.Random(8)
    # a few rows are labelled wrongly, so that the temperature has something to mend
    rows = [(i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(1, 6))), lang if rng.random() < 0.9 else rng.choice(sorted(WORDS))) for i, lang in enumerate(rng.choices(sorted(WORDS), k=200))]
    df = spark.createDataFrame(rows, "id int, text string, lang string")
    model = op2.fit(df)
    # the sample's order: by the hash within each language, languages in turn
    hashed = {r.id: r.h for r in df.select("id", F.xxhash64("id", "text").alias("h")).collect()}
    ranked = []
    for lang in sorted(WORDS):
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (hashed[r[0]] % 1_000_000, hashed[r[0]], r[0]))
        ranked += [(i, lang, r[1]) for i, r in enumerate(own)]
    weight, temperature, loss = plain_fit([(t, lang) for _, lang, t in sorted(ranked, key=lambda r: r[:2])], sorted(WORDS))
    assert model.langs == sorted(WORDS)
    for k, lang in enumerate(model.langs):
        assert abs(model.bias[k] - weight((lang, "bias"))) < 1e-9
        want = np.array([weight((lang, b)) for b in range(op2.BUCKETS)])
        assert np.abs(model.weights[k] - want).max() < 1e-6
        assert (want == 0).sum() == (model.weights[k] == 0).sum() > op2.BUCKETS / 2
    assert abs(loss(model.temperature) - loss(temperature)) < 1e-6 and 0.125 < model.temperature < 8
