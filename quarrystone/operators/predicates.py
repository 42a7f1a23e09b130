"""Filters, admission rules, quarantine, contract checks, scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import canonical_url, clean_text, parse_term, states
from quarrystone.operators.joins import miles


def array_of(*items: Column) -> Column:
    """The items that are not null."""
    return F.array_compact(F.array(*items))


def normalize_observations(raw: DataFrame) -> DataFrame:
    """Observations with clean fields, derived states and term; rows without a usable title go."""
    title, company = clean_text(F.col("title")), clean_text(F.col("company"))
    rows = raw.withColumns({
        "title": title, "company": F.when(company.isin("↳", "", "—", "-"), "Company not listed").otherwise(company),
        "location": F.coalesce(F.nullif(clean_text(F.col("location")), F.lit("")), F.lit("Location not listed")), "url": canonical_url(F.col("url")),
    })
    usable = (F.length("title") >= 3) & ~F.lower("title").isin("role", "job title", "position")
    return rows.where(usable).withColumns({"states": states(F.col("location")), "term": parse_term(F.col("title"), F.coalesce("section", F.lit("")))})


def admitted(rows: DataFrame, student: str, target: str, target_exact: str, places: list[str]) -> DataFrame:
    """Rows whose title is for students and on target, in a wanted place.

    ``target_exact`` is matched with case, for short names that are words in lower case.
    """
    t = F.col("title")
    return rows.where(t.rlike(f"(?i){student}") & (t.rlike(f"(?i){target}") | t.rlike(target_exact)) & F.arrays_overlap("states", F.array(*[F.lit(p) for p in places])))


def default_eligible(education: Column, kind: Column, kinds: list[str]) -> Column:
    return (F.coalesce(education, F.lit("")) != "graduate-only") & kind.isin(kinds)


def browse(postings: DataFrame, profile: str | None = None, text: str | None = None, newer_than: Column | None = None, places: list[str] | None = None, acted: DataFrame | None = None, only_acted: bool = False, near: tuple[DataFrame, float, float, float] | None = None) -> DataFrame:
    """Postings by profile, words, freshness, places and the user's actions (hidden ones out, or only those).

    ``near`` is (points of postings: id, latitude, longitude; latitude; longitude; miles):
    postings with a point that near pass, and so do remote ones.
    """
    out = postings
    if profile:
        out = out.where(F.array_contains("profiles", profile))
    if text:
        blob = F.lower(F.concat_ws(" ", "company", "title", "location"))
        out = out.where(reduce(lambda a, b: a & b, [F.contains(blob, F.lit(w)) for w in text.lower().split()]))
    if newer_than is not None:
        out = out.where(F.col("posted_at") >= newer_than)
    if places:
        out = out.where(F.arrays_overlap("states", F.array(*[F.lit(p) for p in places])))
    if near:
        points, lat, lon, radius = near
        # degrees of latitude first, which cost no trigonometry
        within = points.where(F.abs(F.col("latitude") - lat) <= radius / 69.0).where(miles(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon)) <= radius)
        reached = within.select("id").union(postings.where(F.array_contains("states", "Remote")).select("id")).distinct()
        out = out.join(reached, "id", "left_semi")
    if acted is not None:
        out = out.join(acted.select("id").distinct(), "id", "left_semi" if only_acted else "left_anti")
    return out


def suitable(postings: DataFrame, reference: Column, days: int, kinds: list[str], profiles: list[str], foreign: str) -> DataFrame:
    """Shortlist rows: a web link, not abroad, right kind, profiles in common, recent."""
    recent = F.col("posted_at").cast("double") >= reference.cast("double") - days * 86400
    return postings.where(F.col("url").rlike("^https?://") & ~F.col("location").rlike(f"(?i){foreign}") & F.col("link_kind").isin(kinds) & F.arrays_overlap("profiles", F.array(*[F.lit(p) for p in profiles])) & recent)


def candidate_pool(pairs: DataFrame, actions: DataFrame, known_terms: Column, wanted_term: Column) -> DataFrame:
    """Profile and posting pairs without those acted on (by posting or by its key) or known to be for another term."""
    left = pairs.where((F.size(known_terms) == 0) | F.array_contains(known_terms, wanted_term))
    left = left.join(actions.select("profile_id", "posting_id").distinct(), ["profile_id", "posting_id"], "left_anti")
    return left.join(actions.select("profile_id", "canonical_key").where("canonical_key is not null").distinct(), ["profile_id", "canonical_key"], "left_anti")


def fresh_funnel(ranked: DataFrame, age: Column, qualified: Column, days: int = 7) -> DataFrame:
    """How many rows are ranked, fresh, qualified and both."""
    fresh = F.coalesce(age <= days, F.lit(False))
    return ranked.agg(F.count(F.lit(1)).alias("ranked"), F.count_if(fresh).alias("fresh"), F.count_if(qualified).alias("qualified"), F.count_if(fresh & qualified).alias("fresh_qualified"), F.count_if(age.isNull()).alias("undated"))


def split_by_rules(df: DataFrame, key: str, order: str, structural: dict[str, Column], downgrade: dict[str, Column]) -> dict[str, DataFrame]:
    """``valid``, ``quarantined`` and ``downgraded`` rows with their ``reasons``; a key's later rows are quarantined as duplicates.

    A rule holds where its column is true. All three come from one plan.
    """
    w = Window.partitionBy(key).orderBy(order)
    # rules are judged before rows are ordered, so that what only they read is not ordered with them
    flags = {**{f"_h{i}": c for i, c in enumerate(structural.values())}, **{f"_d{i}": c for i, c in enumerate(downgrade.values())}}
    rows = df.withColumns(flags).withColumn("_n", F.row_number().over(w))
    hard = array_of(*[F.when(F.col(f"_h{i}"), F.lit(n)) for i, n in enumerate(structural)], F.when(F.col("_n") > 1, "duplicate id"))
    soft = array_of(*[F.when(F.col(f"_d{i}"), F.lit(n)) for i, n in enumerate(downgrade)])
    rows = rows.withColumn("_hard", hard).withColumn("_soft", soft).drop("_n", *flags)
    out = lambda test, reasons: rows.where(test).withColumn("reasons", reasons).drop("_hard", "_soft")
    return {
        "valid": out((F.size("_hard") == 0) & (F.size("_soft") == 0), F.col("_soft")),
        "quarantined": out(F.size("_hard") > 0, F.col("_hard")),
        "downgraded": out((F.size("_hard") == 0) & (F.size("_soft") > 0), F.col("_soft")),
    }


def first_error(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check that fails (is not true); null if all hold."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        out = F.when(F.coalesce(ok, F.lit(False)), out).otherwise(F.lit(name))
    return out


def usage_errors(batches: DataFrame, schema: str, allowed_events: list[str]) -> DataFrame:
    """``batches`` with ``error``: the first broken rule of the usage contract."""
    counts = F.map_values("events")
    checks = [
        ("unsupported_schema", F.col("schema") == schema),
        ("invalid_visitor", F.col("visitor_id").rlike(r"^visitor-[A-Za-z0-9-]{1,64}$")),
        ("invalid_session", F.col("session_id").rlike(r"^session-[A-Za-z0-9-]{1,64}$")),
        ("invalid_sequence", F.col("sequence").between(1, 1_000_000)),
        ("invalid_time_order", F.col("ended_at") >= F.col("started_at")),
        ("invalid_build", F.coalesce("build_sha", F.lit("")).rlike("^[A-Fa-f0-9]{0,40}$")),
        ("invalid_events", F.size(F.array_except(F.map_keys("events"), F.array(*[F.lit(e) for e in allowed_events]))) == 0),
        ("empty_events", F.size("events") > 0),
        ("invalid_event_count", F.forall(counts, lambda n: n.between(0, 1_000_000))),
    ]
    return batches.withColumn("error", first_error(checks))


def search(tables: dict[str, tuple[DataFrame, str, list[str]]], query: str, limit: int) -> DataFrame:
    """Rows of several tables whose fields hold the query, case-insensitively. ``tables``: name -> (rows, id, fields)."""
    q = query.lower()
    found = None
    for name, (df, key, fields) in tables.items():
        hit = F.exists(F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), lambda x: F.contains(F.lower(x), F.lit(q)))
        part = df.where(hit).select(F.lit(name).alias("kind"), F.col(key).cast("string").alias("key")).orderBy("key").limit(limit)
        found = part if found is None else found.unionByName(part)
    return found.orderBy("kind", "key").limit(limit)


#: What personal data looks like.
PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "phone": r"(?<!\d)(?:\+?1[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)"}


def pii_hits(rows: DataFrame, key: str, fields: list[str], forbidden: list[str] = ()) -> DataFrame:
    """``(key, path, kind, value)`` of personal data in text fields, and of fields whose names are forbidden."""
    items = F.array(*[F.struct(F.lit(f).alias("path"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("text")) for f in fields])
    each = rows.select(key, F.explode(items).alias("i")).select(key, "i.path", "i.text")
    found = F.concat(*[_hits(kind, p) for kind, p in PII.items()])
    hits = each.select(key, "path", F.explode(found).alias("h")).select(key, "path", "h.kind", "h.value")
    names = each.where(F.col("path").isin(list(forbidden)) & (F.col("text") != "")).select(key, "path", F.lit("forbidden_key").alias("kind"), F.lit("").alias("value"))
    return hits.unionByName(names)


def _hits(kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def verification(rows: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Each dimension's decision (verified, rejected or unknown) and the decision over all: one rejection rejects, all must verify."""
    out = rows.withColumns(dimensions)
    all_ = F.array(*[F.col(d) for d in dimensions])
    decision = F.when(F.array_contains(all_, "rejected"), "rejected").when(F.forall(all_, lambda x: x == "verified"), "verified").otherwise("unknown")
    return out.withColumn("decision", decision)


def expectation_issues(profiles: Column, states_: Column, kind: Column, education: Column, want_profiles: Column, want_states: Column, visible_kinds: list[str]) -> Column:
    """What keeps a posting from being shown as expected (array<string>)."""
    missing = lambda name, want, got: F.transform(F.array_except(want, got), lambda x: F.concat(F.lit(f"missing expected {name} "), x))
    hidden = array_of(F.when(education == "graduate-only", "graduate-only is hidden"), F.when((kind != "") & ~kind.isin(visible_kinds), F.concat(F.lit("hidden type "), kind)))
    return F.concat(missing("profile", want_profiles, profiles), missing("state", want_states, states_), hidden)
