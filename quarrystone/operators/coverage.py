"""Coverage of an independent sample by the postings we hold."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.functions.identity import posting_identity
from quarrystone.functions.text import canonical_url, company_key, norm, place_key
from quarrystone.plans.shared import stored

#: Thresholds of a fuzzy match: sure, and worth a look.
SURE, LIKELY = 0.90, 0.80


@F.pandas_udf(T.DoubleType())
def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp similarity of normalised texts, which no native function gives."""
    for a, b in pairs:
        yield pd.Series([SequenceMatcher(a=x, b=y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def place_similarity(a: Column, b: Column) -> Column:
    """Of two place keys: 1 for equal ones, 0.96 where the words of one are among the other's, null where only letters can tell."""
    wa, wb = F.split(a, " "), F.split(b, " ")
    within = (F.size(F.array_except(wa, wb)) == 0) | (F.size(F.array_except(wb, wa)) == 0)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(within, 0.96)


def _shared_letters(a: Column, b: Column) -> Column:
    """How many letters two sorted strings have in common at most: matching blocks cannot hold more of a letter than either text."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789 "
    count = lambda t, x: F.length(t) - F.length(F.replace(t, F.lit(x), F.lit("")))
    return reduce(lambda p, q: p + q, [F.least(count(a, x), count(b, x)) for x in letters])


def _classes(rows: DataFrame, block: str, own: str, text: str, place: str) -> DataFrame:
    """``rows`` as (block, own, text, place): what ``similarity_join`` compares of them. Rows that agree in all three are one class."""
    return rows.select(block, own, norm(F.col("title")).alias(text), place_key(F.col("location")).alias(place))


def _class_pairs(s: DataFrame, p: DataFrame, block: str, salts: int, hot: int) -> DataFrame:
    """``(block, _ta, _la, _tb, _lb, score)`` of classes at least ``LIKELY``, each pair once.

    Titles and places are compared once for each pair of distinct values. Pairs that
    cannot reach ``LIKELY`` are left out before any letter is compared in order: by the
    lengths of the titles, then by the letters that they share, which bound the ratio from
    above. Blocks of more than ``hot`` titles are spread over ``salts`` parts, to each of
    which the sample's titles go.
    """
    a, b = s.where("_ta <> ''").select(block, "_ta", "_la").distinct(), p.where("_tb <> ''").select(block, "_tb", "_lb").distinct()
    big = b.groupBy(block).agg((F.count(F.lit(1)) > hot).alias("_big"))
    parts = b.join(big, block).withColumn("_s", F.when(F.col("_big"), F.pmod(F.xxhash64("_tb"), F.lit(salts))).otherwise(0).cast("int"))
    every = a.join(big, block).withColumn("_s", F.explode(F.when(F.col("_big"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    la, lb = F.length("_ta"), F.length("_tb")
    place = place_similarity(F.col("_la"), F.col("_lb"))
    # an unknown place counts in full until its letters are compared
    room = (LIKELY - 0.22 * F.coalesce(place, F.lit(1.0))) / 0.78
    near = every.join(parts, [block, "_s"]).where(2 * F.least(la, lb) >= room * (la + lb) - 1e-9).where(2 * _shared_letters(F.col("_ta"), F.col("_tb")) >= room * (la + lb) - 1e-9)
    pairs = near.select(block, "_ta", "_la", "_tb", "_lb", place.alias("_place"))
    titles = pairs.select("_ta", "_tb").distinct().withColumn("_title", F.when(F.col("_ta") == F.col("_tb"), 1.0).otherwise(ratio(F.col("_ta"), F.col("_tb"))))
    scored = pairs.join(titles, ["_ta", "_tb"]).where(0.78 * F.col("_title") + 0.22 * F.coalesce("_place", F.lit(1.0)) >= LIKELY - 1e-9)
    return scored.withColumn("score", 0.78 * F.col("_title") + 0.22 * F.coalesce("_place", ratio(F.col("_la"), F.col("_lb")))).where(F.col("score") >= LIKELY).drop("_title", "_place")


def similarity_join(sample: DataFrame, postings: DataFrame, block: str, left: str, right: str, salts: int = 16, hot: int = 10_000) -> DataFrame:
    """``(left, right, score)`` within blocks: 0.78 of the title's and 0.22 of the place's similarity, at least ``LIKELY``.

    Both sides share ``block``. Every pair of rows comes out, so copies multiply; where
    that is not wanted, ``similarity_links`` counts them and ``best_similar`` picks one.
    """
    s, p = _classes(sample, block, left, "_ta", "_la"), _classes(postings, block, right, "_tb", "_lb")
    back = _class_pairs(s, p, block, salts, hot).join(s, [block, "_ta", "_la"]).join(p, [block, "_tb", "_lb"])
    return back.select(left, right, "score")


def _best_of_classes(s: DataFrame, p: DataFrame, block: str, right: str, salts: int, hot: int) -> DataFrame:
    """Per class of the sample: ``links``, the most alike posting (the least one of equals) and its score."""
    held = p.groupBy(block, "_tb", "_lb").agg(F.min(right).alias("_least"), F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct(F.negative("score").alias("s"), F.col("_least")))
    met = _class_pairs(s, p, block, salts, hot).join(held, [block, "_tb", "_lb"]).groupBy(block, "_ta", "_la").agg(F.sum("_n").alias("links"), best.alias("_b"))
    return met.select(block, "_ta", "_la", "links", F.col("_b._least").alias(right), F.negative("_b.s").alias("score"))


def similarity_links(sample: DataFrame, postings: DataFrame, block: str, left: str, right: str, salts: int = 16, hot: int = 10_000) -> DataFrame:
    """``(left, class_id, links, right, score)``, a row per row of the sample: the least row of its class, how many postings ``similarity_join`` links to it, the most alike of them (the least of equals) and its score.

    A class is the rows of one block, title and place. No pair of copies is made: links
    are counted by classes.
    """
    s, p = _classes(sample, block, left, "_ta", "_la"), _classes(postings, block, right, "_tb", "_lb")
    own = s.groupBy(block, "_ta", "_la").agg(F.min(left).alias("class_id"))
    keys = lambda t, u: reduce(lambda x, y: x & y, [t[c].eqNullSafe(u[c]) for c in (block, "_ta", "_la")])
    best = _best_of_classes(s, p, block, right, salts, hot)
    told = own.join(best, [block, "_ta", "_la"], "left")
    return s.join(told, keys(s, told)).select(left, "class_id", F.coalesce("links", F.lit(0)).alias("links"), right, "score")


def best_similar(sample: DataFrame, postings: DataFrame, block: str, left: str, right: str, salts: int = 16, hot: int = 10_000) -> DataFrame:
    """``(left, right, score)``: of the pairs of ``similarity_join`` each sample row's most alike, the least one of equals."""
    s, p = _classes(sample, block, left, "_ta", "_la"), _classes(postings, block, right, "_tb", "_lb")
    return s.join(_best_of_classes(s, p, block, right, salts, hot), [block, "_ta", "_la"]).select(left, right, "score")


def coverage_tiers(sample: DataFrame, postings: DataFrame, key: str) -> list[tuple[str, DataFrame]]:
    """The tiers of a coverage audit, surest first: URL, signature, the provider's own id, likeness within the employer.

    ``sample``: key, company, title, location, url. ``postings``: posting_id and the same.
    An id of a provider outside the five matches only with a like title. What each tier
    compares is worked out once, into tables, so no tier reads a URL again. A tier gives
    the one match that ``cascade`` can choose of it, not all of them, so copies do not
    multiply.
    """
    def keyed(df: DataFrame, own: str) -> DataFrame:
        named = [norm(F.col(c)) for c in ("company", "title", "location")]
        return df.select(F.col(own).alias("_id"), F.nullif(canonical_url(F.col("url")), F.lit("")).alias("_url"), F.concat_ws("|", *named).alias("_sig"), posting_identity(F.col("url")).alias("_native"), company_key(F.col("company")).alias("_employer"), "title", "location")

    a, b = stored(keyed(sample, key)), stored(keyed(postings, "posting_id"))
    native = F.concat_ws("|", "_native.provider", F.array_join("_native.parts", "|"))

    def met(value: Column) -> DataFrame:
        x, y = a.select(F.col("_id").alias(key), value.alias("_v")).where("_v <> ''"), b.select(F.col("_id").alias("posting_id"), value.alias("_v")).where("_v <> ''")
        return x.join(y.groupBy("_v").agg(F.min("posting_id").alias("posting_id")), "_v").select(key, "posting_id", F.lit(1.0).alias("score"))

    sure = a.where("_employer <> ''").withColumnRenamed("_id", key)
    fuzzy = best_similar(sure, b.where("_employer <> ''").withColumnRenamed("_id", "posting_id"), "_employer", key, "posting_id")
    return [("url", met(F.col("_url"))), ("signature", met(F.col("_sig"))), ("identity", met(F.when(F.col("_native").isNotNull(), native))), ("fuzzy", fuzzy)]


def coverage_audit(sample: DataFrame, postings: DataFrame, covered: DataFrame, issues: Column, key: str) -> DataFrame:
    """``sample`` with tier, posting_id, score, status, confidence and reason: the whole cascade.

    ``covered``: source, whether that source is configured. ``issues``: what keeps a
    matched posting from view, an array over the posting's columns. A known employer
    without the role and a configured source without the row are misses of their own.
    """
    best = cascade(sample.select(key), key, coverage_tiers(sample, postings, key))
    seen = postings.select(F.col("posting_id").alias("_p"), issues.alias("_issues"))
    employers = postings.select(company_key(F.col("company")).alias("_e")).where("_e <> ''").distinct()
    rows = sample.withColumn("_key", company_key(F.col("company"))).join(best, key).join(seen, F.col("posting_id") == F.col("_p"), "left").join(employers, F.col("_key") == F.col("_e"), "left").join(covered.select(F.col("source").alias("_s"), "configured"), F.col("source") == F.col("_s"), "left")
    hidden, fuzzy, found = F.size(F.coalesce("_issues", F.expr("CAST(array() AS array<string>)"))) > 0, (F.col("tier") == "fuzzy") & (F.col("score") < SURE), F.col("tier").isNotNull()
    configured = F.coalesce("configured", F.lit(False))
    reason = (
        F.when(found & ~fuzzy & (F.col("tier") == "fuzzy"), F.when(hidden, "probable_match_but_hidden").otherwise("probable_duplicate"))
        .when(found & ~fuzzy & hidden, F.when(F.col("tier") == "identity", "provider_identity_match_hidden").otherwise("present_but_hidden"))
        .when(found & ~fuzzy, F.when(F.col("tier") == "identity", "provider_identity_match").otherwise("exact_match"))
        .when(F.col("_e").isNotNull() & ~configured, "known_employer_missing_role").when(configured, "configured_source_listing_absent").when(F.col("configured").isNotNull(), "uncovered_source").otherwise("insufficient_source_context")
    )
    status = {
        "captured_visible": ["exact_match", "provider_identity_match"], "captured_hidden": ["present_but_hidden", "provider_identity_match_hidden", "probable_match_but_hidden"], "probable_duplicate": ["probable_duplicate"],
        "missing": ["known_employer_missing_role", "uncovered_source", "insufficient_source_context"], "missing_from_covered_source": ["configured_source_listing_absent"],
    }
    named = F.lit(None).cast("string")
    for name, reasons in status.items():
        named = F.when(F.col("reason").isin(reasons), F.lit(name)).otherwise(named)
    sureness = F.when(F.col("reason").isin("probable_match_but_hidden", "probable_duplicate", "configured_source_listing_absent"), "medium").when(F.col("reason") == "insufficient_source_context", "low").otherwise("high")
    out = rows.withColumn("reason", reason)
    matched = F.col("status").isin(CAPTURED)
    out = out.withColumns({"status": named, "confidence": sureness})
    return out.select(*sample.columns, "status", "confidence", "reason", *[F.when(matched, F.col(c)).alias(c) for c in ("tier", "posting_id", "score")])


def cascade(sample: DataFrame, key: str, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """``sample`` with the best match: the first tier with a match, its highest score, its least posting.

    A tier gives (key, posting_id, score). Rows without a match have tier null.
    """
    every = reduce(DataFrame.unionByName, [df.select(key, "posting_id", F.col("score").cast("double").alias("score"), F.lit(i).alias("_t"), F.lit(name).alias("tier")) for i, (name, df) in enumerate(tiers)])
    best = F.min(F.struct("_t", F.negative("score").alias("s"), "posting_id", "tier"))
    found = every.groupBy(key).agg(best.alias("b")).select(key, "b.posting_id", "b.tier", F.negative("b.s").alias("score"))
    return sample.join(found, key, "left")


def coverage_status(tier: Column, score: Column, issues: Column, source_covered: Column) -> Column:
    """What became of a sampled row."""
    return (
        F.when(tier.isNull() & source_covered, "missing_from_covered_source").when(tier.isNull(), "missing")
        .when((tier == "fuzzy") & (score < SURE), "probable_duplicate").when(F.size(issues) > 0, "captured_hidden").otherwise("captured_visible")
    )


CAPTURED = ["captured_visible", "captured_hidden", "probable_duplicate"]


def coverage_report(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Rows, captured and visible ones with rates: over all and by each dimension, in one pass of grouping sets."""
    captured, visible = F.count_if(F.col("status").isin(CAPTURED)).alias("captured"), F.count_if(F.col("status") == "captured_visible").alias("visible")
    out = rows.groupingSets([[], *[[d] for d in dims]], *dims).agg(F.grouping_id(*dims).alias("level"), F.count(F.lit(1)).alias("n"), captured, visible)
    return out.withColumn("capture_rate", F.col("captured") / F.col("n")).withColumn("visible_rate", F.col("visible") / F.col("n"))


def recall_by_region(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Captured share per state and region; pseudo-states (remote, whole country) do not count. ``regions``: state, region."""
    held = rows.select("status", F.explode("states").alias("state")).join(regions, "state")
    counted = held.groupBy("region", "state").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin(CAPTURED)).alias("captured"))
    w = Window.partitionBy("region")
    return counted.withColumn("recall", F.col("captured") / F.col("n")).withColumn("region_recall", F.sum("captured").over(w) / F.sum("n").over(w))
