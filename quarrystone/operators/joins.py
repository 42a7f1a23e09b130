"""Joins: evidence, prior snapshots, link ladders, places, distances, providers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import canonical_url, compact, host, place_key
from quarrystone.plans.shared import dealt


def attach_evidence(postings: DataFrame, bridge: DataFrame, evidence: DataFrame) -> DataFrame:
    """Postings with their evidence; an authoritative date replaces the posting's own."""
    e = evidence.select("canonical_url", F.col("status").alias("evidence_status"), F.col("posted_at").alias("_date"))
    out = postings.join(bridge, postings["id"] == bridge["posting_id"], "left").drop("posting_id").join(e, "canonical_url", "left")
    return out.withColumn("posted_at", F.coalesce("_date", "posted_at")).drop("_date")


def attach_evidence_by_posting(postings: DataFrame, bridge: DataFrame, evidence: DataFrame) -> DataFrame:
    """As ``attach_evidence``, but bridge and evidence meet first: postings that lie in buckets of their id are not moved."""
    e = evidence.select("canonical_url", F.col("status").alias("evidence_status"), F.col("posted_at").alias("_date"))
    known = bridge.join(e, "canonical_url", "left").withColumnRenamed("posting_id", "id")
    out = postings.join(known, "id", "left")
    return out.withColumn("posted_at", F.coalesce("_date", "posted_at")).drop("_date")


def unique_lookup(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys`` -> ``value`` where a key has one value only; null keys and values do not count."""
    rows = df.dropna(subset=[*keys, value])
    return rows.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_max")).where(F.col(value) == F.col("_max")).drop("_max")


def ladder_join(left: DataFrame, rungs: list[tuple[list[str], DataFrame]], value: str) -> DataFrame:
    """``left`` with ``value`` and ``rung`` (from 1) of the first lookup that knows the row's key."""
    out, names = left, []
    for i, (keys, right) in enumerate(rungs, 1):
        names.append(f"_v{i}")
        out = out.join(right.select(*keys, F.col(value).alias(names[-1])), keys, "left")
    rung = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(i)) for i, n in enumerate(names, 1)])
    return out.withColumn(value, F.coalesce(*names)).withColumn("rung", rung).drop(*names)


def match_prior(postings: DataFrame, previous: DataFrame, tiers: list[str], value: str) -> DataFrame:
    """The prior id by the first tier whose key is unique in the previous snapshot."""
    return ladder_join(postings, [([t], unique_lookup(previous, [t], value)) for t in tiers], value)


def carry_forward(current: DataFrame, previous: DataFrame, failed: DataFrame, key: str = "id") -> DataFrame:
    """Previous postings of sources that failed now, unless known dead or present; ``carried_from`` is the first such source.

    The previous postings are read once: a row meets its failed sources and keeps the first.
    """
    rows = previous.where(F.col(key).isNotNull() & F.coalesce(F.col("link_status") != "dead", F.lit(True))).withColumn("_row", F.monotonically_increasing_id())
    met = rows.withColumn("_k", F.explode("source_keys")).join(failed.select(F.col("key").alias("_k")).distinct(), "_k")
    rest = [c for c in previous.columns if c != key]
    held = met.groupBy(key, "_row").agg(*[F.any_value(c).alias(c) for c in rest], F.min("_k").alias("carried_from")).drop("_row")
    return held.join(current.select(key), key, "left_anti").withColumn("carried_forward", F.lit(True))


def best_tier(left: DataFrame, key: str, tiers: list[DataFrame], value: str) -> DataFrame:
    """Per row the candidates of its first tier that has any, kept only if one is left. Each tier: (key, value)."""
    every = reduce(DataFrame.unionByName, [t.select(key, value, F.lit(i).alias("tier")) for i, t in enumerate(tiers, 1)])
    ends = every.groupBy(key, "tier").agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    first = ends.groupBy(key).agg(F.min(F.struct("tier", "_low", "_high")).alias("_f")).select(key, "_f.*")
    return left.join(first.where("_low = _high").select(key, "tier", F.col("_low").alias(value)), key, "left")


def _parts(values: DataFrame, text: str, lengths: DataFrame, text_of: str) -> DataFrame:
    """``values`` with ``_part``: every stretch of ``text`` that is as long as some ``text_of`` in ``lengths``, and shorter than the whole."""
    held = lengths.agg(F.collect_set(F.length(text_of)).alias("_lengths"))
    n = F.length(text)
    each = values.crossJoin(F.broadcast(held)).select(*values.columns, F.explode(F.filter("_lengths", lambda x: x < n)).alias("_l"))
    return each.withColumn("_part", F.explode(F.transform(F.sequence(F.lit(1), F.length(text) - F.col("_l") + 1), lambda i: F.substring(F.col(text), i, F.col("_l"))))).drop("_l")


def containment_match(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, value: str, key: str) -> DataFrame:
    """Equal keys, and one place within the other; only where a single candidate is left.

    Places meet as equals of stretches of each other, each distinct one once and with the
    least and the greatest of its values, which tell whether there is one; so no row meets
    every row of its key.
    """
    x = left.select(key, *on, place_key(F.col(a)).alias("_x"))
    ends = lambda low, high: [F.min(low).alias("_low"), F.max(high).alias("_high")]
    again = ends("_low", "_high")
    y = right.select(*on, place_key(F.col(b)).alias("_y"), value).groupBy(*on, "_y").agg(*ends(value, value))
    places = x.select(*on, "_x").distinct()
    same = places.join(y.withColumnRenamed("_y", "_x"), [*on, "_x"])
    within = _parts(y, "_y", places, "_x").groupBy(*on, F.col("_part").alias("_x")).agg(*again).join(places, [*on, "_x"])
    around = _parts(places, "_x", y, "_y").join(y.withColumnRenamed("_y", "_part"), [*on, "_part"])
    best = reduce(DataFrame.unionByName, [t.select(*on, "_x", "_low", "_high") for t in (same, within, around)]).groupBy(*on, "_x").agg(*again)
    found = x.join(best, [*on, "_x"]).groupBy(key).agg(*again)
    return found.where("_low = _high").select(key, F.col("_low").alias(value))


def alias_match(postings: DataFrame, aliases: DataFrame, employers: DataFrame) -> DataFrame:
    """Employer of each posting: by id if it has one, else by normalised name where only one employer has it."""
    named = unique_lookup(aliases, ["name_key"], "employer_id").withColumnRenamed("employer_id", "_by_name")
    out = postings.join(employers.select(F.col("employer_id").alias("_by_id")), postings["employer_hint"] == F.col("_by_id"), "left").join(named, "name_key", "left")
    return out.withColumn("employer_id", F.coalesce("_by_id", "_by_name")).drop("_by_id", "_by_name")


def _anchored(cities: DataFrame) -> DataFrame:
    """``cities`` with ``_name`` (words), and the word of it that fewest names have, with its ``_place``."""
    names = cities.withColumn("_name", F.split("city", " "))
    each = names.select("city", F.posexplode("_name").alias("_place", "_word")).distinct()
    shared = each.groupBy("_word").agg(F.countDistinct("city").alias("_in"))
    rarest = each.join(shared, "_word").groupBy("city").agg(F.min(F.struct("_in", "_place", "_word")).alias("r"))
    return names.join(rarest.select("city", "r._place", "r._word"), "city")


def resolve_places(locations: DataFrame, zips: DataFrame, cities: DataFrame) -> DataFrame:
    """``(id, value)`` to points: the ZIP in the text, else state and city, else a city name that one state has, else the longest city contained.

    ``cities``: state, city, latitude, longitude, unique_name. Contained cities, of any number
    of words, are met by the rarest word of their name and verified word by word around it,
    so no location meets every city. A point follows from the value alone, so each
    distinct value is looked up once.
    """
    rows = locations.select("value").distinct().select("value", F.regexp_extract("value", r"\b(\d{5})\b", 1).alias("zip"), place_key(F.substring_index("value", ",", 1)).alias("city"), F.upper(F.trim(F.element_at(F.split("value", ","), -1))).alias("state"))
    words = F.split(place_key(F.col("value")), " ")
    c = cities.withColumn("city", place_key(F.col("city")))
    point = [F.col("latitude"), F.col("longitude")]
    unique = c.where("unique_name")
    t1 = rows.join(zips.select(F.col("zip_code").alias("zip"), *point), "zip").select("value", F.lit(1).alias("tier"), *point, F.lit(0).alias("length"))
    t2 = rows.join(c.select("state", "city", *point), ["state", "city"]).select("value", F.lit(2), *point, F.lit(0))
    t3 = rows.join(unique.select("city", *point), "city").select("value", F.lit(3), *point, F.lit(0))
    said = rows.select("value", words.alias("_words"), F.posexplode(words).alias("_at", "_word"))
    around = F.slice("_words", F.greatest(F.lit(1), F.col("_at") - F.col("_place") + 1), F.size("_name"))
    t4 = said.join(_anchored(unique.select("city", *point)), "_word").where((F.col("_at") >= F.col("_place")) & (around == F.col("_name"))).select("value", F.lit(4), *point, F.length("city"))
    best = F.min(F.struct("tier", F.negative("length").alias("l"), "latitude", "longitude"))
    found = t1.union(t2).union(t3).union(t4).groupBy("value").agg(best.alias("b")).select(F.col("value").alias("_value"), "b.tier", "b.latitude", "b.longitude")
    each = dealt(locations.select("id", "value"), "id").distinct()
    return each.join(found, F.col("value").eqNullSafe(F.col("_value"))).drop("_value")


EARTH_MILES = 3958.7613


def miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_MILES * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def radius_join(points: DataFrame, bases: DataFrame, radius: float) -> DataFrame:
    """``(id, base)`` with the least distance of any point of id to the base, where within ``radius`` miles.

    Points and bases meet in cells of latitude and longitude; a base reaches into
    every cell its circle can touch (wider in longitude towards the poles; all of a
    row of cells beyond 80 degrees and across the date line).
    """
    step = radius / 69.0
    lat_cell = lambda c: F.floor(c / step).cast("int")
    width = 360.0 / max(1, int(360.0 / step))
    wrap = int(round(360.0 / width))
    lon_cell = lambda c: F.floor((c + 180.0) / width).cast("int")
    reach = F.when(F.abs("latitude") + step > 80, F.lit(wrap)).otherwise(F.ceil(step / F.cos(F.radians(F.abs(F.col("latitude")) + step)) / width) + 1)
    b = bases.withColumn("_r", F.least(F.lit(wrap), reach).cast("int")).withColumn("_lat", F.explode(F.sequence(lat_cell(F.col("latitude")) - 1, lat_cell(F.col("latitude")) + 1)))
    span = F.when(2 * F.col("_r") + 1 >= wrap, F.sequence(F.lit(0), F.lit(wrap - 1))).otherwise(F.transform(F.sequence(lon_cell(F.col("longitude")) - F.col("_r"), lon_cell(F.col("longitude")) + F.col("_r")), lambda x: F.pmod(x, F.lit(wrap))))
    b = b.withColumn("_lon", F.explode(span)).select("base", F.col("latitude").alias("_y"), F.col("longitude").alias("_x"), "_lat", "_lon")
    p = points.withColumn("_lat", lat_cell(F.col("latitude"))).withColumn("_lon", F.pmod(lon_cell(F.col("longitude")), F.lit(wrap)))
    near = p.join(b, ["_lat", "_lon"]).withColumn("distance", miles(F.col("latitude"), F.col("longitude"), F.col("_y"), F.col("_x"))).where(F.col("distance") <= radius)
    return near.groupBy("id", "base").agg(F.min("distance").alias("distance"))


def host_suffixes(h: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]."""
    parts = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def provider_family(pages: DataFrame, key: str, url: Column, rules: DataFrame) -> DataFrame:
    """``(key, family, status)``: resolved by one family, ambiguous by several, unresolved by none.

    ``rules``: suffix, family. A host's suffixes are exploded, so the match is an equi-join.
    """
    held = pages.select(key, F.explode(host_suffixes(host(url))).alias("suffix")).join(rules, "suffix")
    found = held.groupBy(key).agg(F.collect_set("family").alias("f"))
    out = pages.select(key).join(found, key, "left")
    n = F.coalesce(F.size("f"), F.lit(0))
    return out.select(key, F.when(n == 1, F.col("f")[0]).when(n > 1, "unknown").otherwise("custom_unknown").alias("family"), F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved").alias("status"))


def upsert(base: DataFrame, incoming: DataFrame, key: str, fill: list[str], unite: list[str]) -> DataFrame:
    """Rows of both by key: arrays united, nulls of the base filled, keys of one side kept."""
    a, b = base.alias("a"), incoming.alias("b")
    out = [F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key)]
    out += [F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in fill]
    none = lambda c: F.coalesce(F.col(c), F.expr("CAST(array() AS array<string>)"))
    out += [F.array_sort(F.array_distinct(F.concat(none(f"a.{c}"), none(f"b.{c}")))).alias(c) for c in unite]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*out)


#: Prefixes of the sources that a provider's discovery adds by itself.
AUTO_PREFIXES = {"workday": ["us-auto-workday-", "us-feed-workday-"], **{p: [f"auto-{p}-"] for p in ("icims", "greenhouse", "smartrecruiters", "oracle", "successfactors", "lever", "ashby")}}


def merge_providers(base: DataFrame, incoming: DataFrame, fill: list[str], unite: list[str]) -> DataFrame:
    """Provider postings merged into ``base``: a row meets the base row of its canonical URL, else that of its id, else it is new.

    ``incoming`` has ``priority``, the provider's place in the order, and ``direct_employer``.
    Arrays unite; a direct employer's row gives URL and company; the newest date wins;
    blank fields take the first value by priority. New rows of one URL (or of one id,
    without a URL) are one.
    """
    base = base.withColumn("_cu", F.nullif(canonical_url(F.col("url")), F.lit("")))
    rows = incoming.withColumn("_cu", F.nullif(canonical_url(F.col("url")), F.lit("")))
    by_url = base.where("_cu is not null").groupBy("_cu").agg(F.max("id").alias("_u"))
    by_id = base.select(F.col("id").alias("_i")).distinct()
    found = rows.join(by_url, "_cu", "left").join(by_id, rows["id"] == by_id["_i"], "left")
    found = found.withColumn("_target", F.coalesce(F.concat(F.lit("base "), F.coalesce("_u", "_i")), F.concat(F.lit("new "), F.coalesce("_cu", "id"))))
    old = base.select("*", F.lit(-1).alias("priority"), F.concat(F.lit("base "), "id").alias("_target"))
    every = old.unionByName(found.select(*old.columns))
    order = F.struct("priority", "id")
    first = lambda c: F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), order))
    own = lambda c: F.max_by(F.col(c), F.when(F.col("direct_employer") & (F.col("priority") >= 0) & F.nullif(F.col(c), F.lit("")).isNotNull(), order))
    none = F.expr("CAST(array() AS array<string>)")
    return every.groupBy("_target").agg(
        F.min_by("id", order).alias("id"), *[F.coalesce(own(c), first(c)).alias(c) for c in ("url", "company")], F.max("posted_at").alias("posted_at"), F.coalesce(F.max("direct_employer"), F.lit(False)).alias("direct_employer"),
        *[first(c).alias(c) for c in fill], *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, none))))).alias(c) for c in unite],
    ).drop("_target")


def merge_sources(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """``(key, status)``: base sources without a provider's own ones that it no longer reports, overlaid by what the providers report. ``incoming``: provider, key, status."""
    owner = F.lit(None).cast("string")
    for provider, prefixes in AUTO_PREFIXES.items():
        owner = F.when(reduce(lambda x, y: x | y, [F.col("key").startswith(x) for x in prefixes]), F.lit(provider)).otherwise(owner)
    own = base.withColumn("provider", owner).join(incoming.select("provider").distinct(), "provider", "left_semi").select("key")
    stale = own.join(incoming.select("key"), "key", "left_anti")
    latest = incoming.groupBy("key").agg(F.max_by("status", "provider").alias("status"))
    return base.join(stale, "key", "left_anti").join(latest.select("key"), "key", "left_anti").select("key", "status").unionByName(latest)


def new_drafts(incoming: DataFrame, existing: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Incoming rows whose keys do not exist yet, the first of each."""
    w = Window.partitionBy(*keys).orderBy(order)
    return incoming.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").join(existing.select(*keys).distinct(), keys, "left_anti")


def discover_boards(evidence: DataFrame, configured: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Boards that postings or employers point to and nobody configured or quarantined. ``evidence``: board, company, url."""
    boards = evidence.where("board is not null").groupBy("board").agg(F.min(F.struct("company", "url")).alias("f"), F.count(F.lit(1)).alias("evidence"))
    out = boards.join(configured.select("board").distinct(), "board", "left_anti").join(quarantined.select("board").distinct(), "board", "left_anti")
    return out.select("board", "f.company", "f.url", "evidence")


def plausible_domains(names: DataFrame, domains: DataFrame, salts: int = 16) -> DataFrame:
    """Pairs (employer_id, domain) where a name's first word begins the domain's label, or the compact name holds it.

    They meet on the first four letters of word and label. An employer's names with the
    same letters are one row, so each pair is made once and none is compared with the
    others; employers are dealt out before they meet domains, and letters that many share
    over ``salts`` parts, to each of which the domains go.
    """
    label = F.regexp_extract(F.lower("domain"), r"([^.]+)\.[^.]+$", 1)
    word = F.split(F.lower("name"), r"[^a-z0-9]+")[0]
    a = names.where("name is not null").select("employer_id", F.struct(word.alias("w"), compact(F.col("name")).alias("c")).alias("n")).withColumn("t", F.substring("n.w", 1, 4)).where(F.length("t") >= 3)
    a = a.groupBy("employer_id", "t").agg(F.collect_set("n").alias("said")).withColumn("_s", F.pmod(F.xxhash64("employer_id"), F.lit(salts)))
    b = domains.select("domain", label.alias("l")).distinct().withColumn("t", F.substring("l", 1, 4)).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return a.join(b, ["t", "_s"]).where(F.exists("said", lambda n: F.startswith(F.col("l"), n["w"]) | F.contains(n["c"], F.col("l")))).select("employer_id", "domain")


def brand_override(rows: DataFrame, boards: DataFrame) -> DataFrame:
    """A board's own name replaces a company that is only the board's token. ``boards``: url, token, brand."""
    b = boards.select(canonical_url(F.col("url")).alias("_u"), "token", "brand").dropDuplicates(["_u"])
    out = rows.withColumn("_k", canonical_url(F.col("url"))).join(b, F.col("_k") == F.col("_u"), "left")
    return out.withColumn("company", F.when(compact(F.col("company")) == compact(F.col("token")), F.coalesce("brand", "company")).otherwise(F.col("company"))).drop("_u", "_k", "token", "brand")


def apply_observations(employers: DataFrame, observations: DataFrame) -> dict[str, DataFrame]:
    """``updated`` employers, ``unknown`` ids and ``repeated`` ids; an observation counts if it is its employer's only one."""
    counted = observations.groupBy("employer_id").agg(F.count(F.lit(1)).alias("n"), F.min("family").alias("_family"))
    once = counted.where("n = 1").select("employer_id", "_family")
    return {
        "updated": employers.join(once, "employer_id", "left").withColumn("family", F.coalesce("_family", "family")).drop("_family"),
        "unknown": counted.join(employers.select("employer_id"), "employer_id", "left_anti").select("employer_id"),
        "repeated": counted.where("n > 1").select("employer_id", "n"),
    }
