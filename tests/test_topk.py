"""The best postings by blocks and bounds, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import scoring as S
from quarrystone.operators.topk import top_postings

POSTINGS = "posting_id bigint, region int, asked array<struct<skill:string,required:boolean>>, kind string, static double, posted_at int, company string"
PROFILES = "profile_id bigint, region int, offer array<struct<skill:string,sure:boolean,adjacent:double>>, admits array<string>"


def fit(asked, offer):
    by = {o[0]: o for o in offer}
    earned = needed = met = hits = 0
    for skill, required in asked or ():
        needed += required
        if skill in by:
            _, sure, adjacent = by[skill]
            full = 4.0 if required else 3.0
            earned += max([] + ([full if sure else full / 2] if sure is not None else []) + ([adjacent] if adjacent is not None else []))
            met += required
            hits += 1
    return max(0.0, min(45.0, 20 + earned - min(12.0, 3.0 * (needed - met)))) if hits else None


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(9)
    skill = lambda: rng.choice("abcdefghij")
    asked = [sorted({s: rng.random() < 0.5 for s in (skill() for _ in range(rng.randint(0, 6)))}.items()) for _ in range(300)]
    postings = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(asked), rng.choice(["x", "y", None]), rng.choice([None, *map(float, range(56))]), rng.choice([None, 1, 2]), rng.choice([None, "c", "d"])) for i in range(4000)]
    offers = [sorted((s, rng.choice([True, False, None]), rng.choice([None, 1.0])) for s in {skill() for _ in range(rng.randint(0, 7))}) for _ in range(25)]
    offers = [[o for o in x if o[1] is not None or o[2] is not None] for x in offers]
    profiles = []
    for p in range(60):
        offer, admits = rng.choice(offers), rng.choice([["x"], ["x", "y"], []])
        profiles += [(p, r, offer, admits) for r in rng.sample([1, 2, 3, 4], rng.randint(1, 3))]
    return postings, profiles


def judge(pairs):
    return pairs.where("kind is null or array_contains(admits, kind)").withColumn("points", S.set_fit(F.col("asked"), F.col("offer")))


def brute(postings, profiles, k):
    out = []
    for p in sorted({x[0] for x in profiles}):
        mine = [x for x in profiles if x[0] == p]
        regions, (_, _, offer, admits) = {x[1] for x in mine}, mine[0]
        rows = []
        for i, region, asked, kind, static, at, company in postings:
            points = fit(asked, offer) if region in regions and static is not None and (kind is None or kind in admits) else None
            if points is not None:
                rows.append((-(points + static), at is None, -(at or 0), company is None, company or "", i))
        out += [(p, r[-1], -r[0], n + 1) for n, r in enumerate(sorted(rows)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("k", "first", "grow", "step"), [(10, 8, 2, 0.5), (3, 1, 4, 5.0), (200, 64, 4, 0.5)])
def test_equals_all_pairs(spark, tables, k, first, grow, step):
    postings, profiles = tables
    got = top_postings(spark.createDataFrame(postings, POSTINGS), spark.createDataFrame(profiles, PROFILES), ["region"], ["asked", "kind"], ["offer", "admits"], judge, S.most_fit(F.col("asked")), [("posted_at", False), ("company", True)], k, step, first, grow)
    assert sorted(map(tuple, got.ranking.collect())) == brute(postings, profiles, k)
    assert 0 < got.judged <= got.possible
    if k < 20:
        assert got.judged < got.possible / 2


def test_few_pairs_are_judged_where_postings_are_many(spark):
    rng = random.Random(1)
    postings = [(i, 1, sorted({s: rng.random() < 0.5 for s in rng.sample("abcdefghij", 4)}.items()), None, float(rng.randrange(56)), 1, "c") for i in range(20000)]
    profiles = [(p, 1, sorted((s, True, None) for s in rng.sample("abcdefghij", 7)), []) for p in range(40)]
    got = top_postings(spark.createDataFrame(postings, POSTINGS), spark.createDataFrame(profiles, PROFILES), ["region"], ["asked", "kind"], ["offer", "admits"], judge, S.most_fit(F.col("asked")), [("posted_at", False), ("company", True)])
    assert sorted(map(tuple, got.ranking.collect())) == brute(postings, profiles, 10)
    assert got.judged < 0.05 * len(postings) * len(profiles)


def test_empty_sides(spark, tables):
    postings, profiles = tables
    for a, b in (([], profiles), (postings, []), ([], [])):
        got = top_postings(spark.createDataFrame(a, POSTINGS), spark.createDataFrame(b, PROFILES), ["region"], ["asked", "kind"], ["offer", "admits"], judge, S.most_fit(F.col("asked")), [("posted_at", False), ("company", True)])
        assert got.ranking.collect() == []
