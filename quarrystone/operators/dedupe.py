"""Deduplication and entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.identity import posting_identity, with_posting_key
from quarrystone.functions.text import bound, canonical_url, host, norm
from quarrystone.plans.components import components
from quarrystone.plans.shared import stored
from quarrystone.sources.listings import link_kind_rank, provenance_rank


def signature_key(company: Column, title: Column, location: Column) -> Column:
    return F.concat_ws("|", norm(company), norm(title), norm(location))


def group_observations(obs: DataFrame) -> DataFrame:
    """``obs`` with ``group_id``, the ordinal of the row that opens the row's group.

    In order, a row joins the group of its URL, else that of its signature, else it
    opens one; later URLs join, later signatures do not. In closed form: a row of a
    known URL follows the URL's first row, and a group opens with the first such row
    of its signature. Both are aggregations over the first row of each URL as it is
    written, a narrow table that is written once; so only distinct URLs are made
    canonical. Full rows are shuffled once, to meet their group by their URL. A row
    without a URL is a URL of its own.
    """
    own = F.concat(F.lit("row "), F.col("ordinal").cast("string"))
    keyed = obs.withColumn("_url", F.when(F.coalesce("url", F.lit("")) == "", own).otherwise(F.col("url")))
    first = keyed.groupBy("_url").agg(F.min(F.struct("ordinal", "company", "title", "location")).alias("f"))
    urls = stored(first.select("_url", canonical_url(F.col("_url")).alias("_key"), F.col("f.ordinal").alias("_o"), signature_key(F.col("f.company"), F.col("f.title"), F.col("f.location")).alias("_sig")))
    firsts = urls.groupBy("_key").agg(F.min(F.struct("_o", "_sig")).alias("f")).select("_key", "f._o", F.col("f._sig").alias("_eff"))
    groups = firsts.groupBy("_eff").agg(F.min("_o").alias("group_id"))
    found = urls.select("_url", "_key").join(firsts.join(groups, "_eff").select("_key", "group_id"), "_key").drop("_key")
    return keyed.join(found, "_url").drop("_url")


def merge_groups(grouped: DataFrame, aggregators: list[str]) -> DataFrame:
    """One posting per group: united sources, best link, preferred date, salary, dates seen.

    Links: higher kind wins, then hosts that are no aggregators, then the earlier row.
    Dates: higher provenance wins, then the newest, then the earlier row. Salary: the
    first structured one that has a range, else the first structured, else the first.
    """
    o = F.col("ordinal")
    link = F.struct(F.col("url").isNotNull().cast("int").alias("has"), link_kind_rank(F.col("link_kind")).alias("kind"), (~host(F.col("url")).isin(aggregators)).cast("int").alias("own"), F.negative(o).alias("o"), "url", "link_kind", "link_status")
    date = F.struct(provenance_rank(F.col("posted_date_provenance")).alias("rank"), "posted_at", F.negative(o).alias("o"), "posted_date_provenance", F.col("source_key").alias("date_source"))
    pay = F.struct((F.col("salary_min") != F.col("salary_max")).cast("int").alias("range"), F.negative(o).alias("o"), "salary_min", "salary_max")
    first = F.struct("ordinal", "company", "title", "location")
    sets = {"source_keys": "source_key", "source_names": "source_name", "source_urls": "source_url"}
    out = grouped.groupBy("group_id").agg(
        F.min(first).alias("f"), F.max(link).alias("l"), F.max(F.when(F.col("posted_at").isNotNull(), date)).alias("d"), F.max(F.when(F.col("salary_min").isNotNull(), pay)).alias("p"),
        *[F.array_sort(F.collect_set(c)).alias(n) for n, c in sets.items()], F.count(F.lit(1)).alias("observations"),
    )
    return out.select("group_id", "f.company", "f.title", "f.location", "l.url", "l.link_kind", "l.link_status", "d.posted_at", "d.posted_date_provenance", "d.date_source", "p.salary_min", "p.salary_max", *sets, "observations")


# --- fixed values -----------------------------------------------------------
#: Query parameters that name a posting.
POSTING_PARAMETERS = ["job", "jobid", "job_id", "jobcode", "job_code", "jid", "posting", "postingid", "posting_id", "requisition", "requisitionid", "requisition_id", "reqid", "req_id"]
# ----------------------------------------------------------------------------


def _names_posting(text: Column) -> Column:
    """Whether a text holds an id long enough to be one posting's only: a number of eight digits or more, or a UUID."""
    number = lambda p: (F.length(p) >= 8) & (F.translate(p, "0123456789", "") == "")
    uuid = lambda p: (F.length(p) >= 36) & (F.instr(p, "-") == 9) & (F.translate(F.lower(p), "0123456789abcdef-", "") == "")
    pieces = F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9-]+")
    return F.exists(pieces, lambda p: (F.length(p) >= 8) & (uuid(p) | F.exists(F.split(p, "-"), number)))


def _direct_identity() -> Column:
    """Of direct links the URL if it names one posting, else the URL with company, title and place; null otherwise."""
    described = F.array(*[norm(F.col(c)) for c in ("company", "title", "location")])

    def direct(url: Column) -> Column:
        values = F.filter(F.split(F.regexp_extract(url, r"\?(.*)$", 1), "&"), lambda x: F.lower(F.substring_index(x, "=", 1)).isin(POSTING_PARAMETERS))
        named = _names_posting(F.substring_index(url, "?", 1)) | F.exists(values, lambda x: _names_posting(F.regexp_extract(x, "=(.*)$", 1)))
        whole = bound(described, lambda d: F.when(~F.array_contains(d, ""), F.concat_ws("|", F.lit("direct-url"), url, d)))
        return F.when(url != "", F.when(named, F.concat(F.lit("direct-posting-url|"), url)).otherwise(whole))

    return F.when(F.col("link_kind") == "direct", bound(canonical_url(F.col("url")), direct))


def reconciliation_identity(rows: DataFrame) -> Column:
    """What two copies of a posting share: the provider's own id, else of direct links the URL if it names one posting, else the URL with company, title and place; null otherwise."""
    native = bound(posting_identity(F.col("url")), lambda i: F.when(i.isNotNull(), F.concat_ws("|", i["provider"], F.array_join(i["parts"], "|"))))
    return F.coalesce(native, _direct_identity())


def identified(rows: DataFrame, name: str = "identity") -> DataFrame:
    """``rows`` with ``reconciliation_identity`` as ``name``, worked out by steps of columns: the same values for less work where rows are many."""
    return with_posting_key(rows, F.col("url"), "_native").withColumn(name, F.coalesce("_native", _direct_identity())).drop("_native")


def reconcile(rows: DataFrame, identity: Column, order: str = "id", fill: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows of one native identity made one: the winner by directness, link kind, number of sources, date and id; others pass.

    The winner keeps its fields, but: sources unite; ``first_seen`` is the earliest and
    ``last_seen`` the latest; ``posted_at`` is the newest; ``link_status`` is "ok" if any is,
    else the first one known; of rows with ``direct_employer`` the best one gives company,
    title and location; blank fields of ``fill`` take the first value that another row has.
    Columns that are not there are passed over. ``merged`` counts the rows. ``keep`` names
    the columns wanted, else all are: what the winner is not asked for is not carried, and
    identities, which begin alike, are sorted by their hash first.
    """
    have, keep, fill = set(rows.columns), keep or rows.columns, fill or []
    keyed = rows.withColumn("_identity", F.coalesce(identity, F.concat(F.lit("row "), F.col(order).cast("string")))).withColumn("_hash", F.xxhash64("_identity"))
    led = (F.col("direct_employer") if "direct_employer" in have else F.col("link_kind") == "direct").cast("int")
    first = lambda c, usable: F.min_by(F.when(usable, F.col(c)), F.when(usable, F.col(order)))
    over = {"source_keys": F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_keys"))))}
    over |= {c: f(c) for c, f in (("first_seen", F.min), ("last_seen", F.max), ("posted_at", F.max)) if c in have}
    if "link_status" in have:
        known = F.nullif(F.col("link_status"), F.lit(""))
        over["link_status"] = F.when(F.max(F.coalesce(known == "ok", F.lit(False))), "ok").otherwise(first("link_status", known.isNotNull()))
    carried = [c for c in keep if c != order and (c not in over or c in fill)]
    row = [F.struct(*carried).alias("row")] if carried else []
    rank = F.struct(F.coalesce(led, F.lit(0)).alias("a"), link_kind_rank(F.col("link_kind")).alias("b"), F.size("source_keys").alias("c"), F.col("posted_at").alias("d"), F.col(order).alias("e"), *row)
    of = lambda winner, c: winner["e"] if c == order else winner["row"][c]
    best = F.max(rank)
    value = {c: over[c] if c in over else of(best, c) for c in keep}
    if "direct_employer" in have:
        employer = F.max(F.when(F.coalesce(F.col("direct_employer"), F.lit(False)), rank))
        value |= {c: F.coalesce(F.nullif(of(employer, c), F.lit("")), of(best, c)) for c in ("company", "title", "location") if c in keep}
    for c in [c for c in fill if c in keep]:
        filled = F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        value[c] = F.coalesce(F.when(of(best, c).cast("string") != "", of(best, c)), first(c, filled))
    out = keyed.groupBy("_hash", "_identity").agg(*[v.alias(c) for c, v in value.items()], F.count(F.lit(1)).alias("merged"))
    last = ["source_keys", "first_seen", "merged"]
    return out.select(*[c for c in keep if c not in last], *[c for c in last if c in out.columns])


def reconcile_stats(rows: DataFrame, identity: Column) -> DataFrame:
    """Identified rows, groups, duplicates merged and rows that pass, in one aggregation by identity."""
    groups = rows.groupBy(identity.alias("i")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("i").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    return groups.agg(zero(F.sum(F.when(known, F.col("n")))).alias("identified"), F.count_if(known).alias("groups"), zero(F.sum(F.when(known, F.col("n") - 1))).alias("merged_rows"), zero(F.sum(F.when(~known, F.col("n")))).alias("passed"))


def pool_dedupe(rows: DataFrame, canonical: Column, semantic: Column, strong: Column, order: list[Column]) -> DataFrame:
    """First row per canonical key, then per semantic key, where two strong identities never merge."""
    w1 = Window.partitionBy("_c").orderBy(*order)
    once = rows.withColumns({"_c": canonical, "_s": semantic, "_strong": strong}).withColumn("_n", F.row_number().over(w1)).where("_n = 1")
    # a strong row has its canonical key beside the semantic one; weak rows fall to the first row of the semantic key
    own = F.when(F.col("_strong"), F.concat_ws("\x01", "_s", "_c")).otherwise(F.col("_s"))
    w2 = Window.partitionBy("_own").orderBy(*order)
    held = Window.partitionBy("_s")
    kept = once.withColumn("_own", own).withColumn("_n", F.row_number().over(w2)).where("_n = 1")
    return kept.withColumn("_any", F.max(F.col("_strong").cast("int")).over(held)).where(F.col("_strong") | (F.col("_any") == 0)).drop("_c", "_s", "_strong", "_n", "_own", "_any")


def merge_by_keys(rows: DataFrame, node: str, keys: Column) -> DataFrame:
    """``rows`` with ``entity``: the least node of all that are reachable over shared keys (several per row)."""
    held = rows.select(F.col(node).alias("n"), F.explode(F.array_distinct(keys)).alias("k"))
    lead = held.groupBy("k").agg(F.min("n").alias("m"))
    edges = held.join(lead, "k").where("n <> m").select(F.col("n").alias("a"), F.col("m").alias("b")).distinct()
    labels = components(edges)
    return rows.join(labels, rows[node] == labels["node"], "left").withColumn("entity", F.coalesce("component", node)).drop("node", "component")


def key_collisions(rows: DataFrame, entity: str, keys: Column) -> DataFrame:
    """Keys that lead to more than one entity."""
    held = rows.select(entity, F.explode(F.array_distinct(keys)).alias("key"))
    return held.groupBy("key").agg(F.countDistinct(entity).alias("entities")).where("entities > 1")


def best_representative(rows: DataFrame, group: str, quality: Column, order: str) -> DataFrame:
    """Each group's row of the best quality, with how many rows and which sources it stands for."""
    best = F.max(F.struct(quality.alias("q"), F.negative(F.col(order)).alias("o"), F.struct(*rows.columns).alias("row")))
    out = rows.groupBy(F.col(group).alias("_g")).agg(best["row"].alias("row"), F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set("source")).alias("sources"))
    return out.select("row.*", "rows", "sources")


def stable_ids(rows: DataFrame, prior: Column, basis: Column, order: str) -> DataFrame:
    """``rows`` with ``stable_id``: the prior id, at most once; else a hash of the identity basis; else that hash with a number.

    A row claims its prior id, or its hash if it has none or lost it; of rows that
    claim one id the first in order has it, and numbers follow the order.
    """
    hashed = F.substring(F.sha1(basis.cast("binary")), 1, 16)
    claim1 = Window.partitionBy("_prior").orderBy(order)
    first = rows.withColumns({"_prior": prior, "_hash": hashed}).withColumn("_keeps", F.col("_prior").isNotNull() & (F.row_number().over(claim1) == 1))
    taken = first.where("_keeps").select(F.col("_prior").alias("_taken")).distinct()
    rest = first.join(taken, F.col("_hash") == F.col("_taken"), "left")
    claim2 = Window.partitionBy("_keeps", "_hash").orderBy(order)
    number = F.row_number().over(claim2) - F.when(F.col("_taken").isNull(), 1).otherwise(0)
    rest = rest.withColumn("_no", number)
    new = F.when(F.col("_keeps"), F.col("_prior")).when(F.col("_no") == 0, F.col("_hash")).otherwise(F.substring(F.sha1(F.concat_ws("|", "_hash", F.col("_no").cast("string")).cast("binary")), 1, 16))
    return rest.withColumn("stable_id", new).drop("_prior", "_hash", "_keeps", "_taken", "_no")


def unique_listings(results: DataFrame, identity: list[Column], order: list[str]) -> DataFrame:
    """The first result of each identity, which is the first of ``identity`` that is not empty."""
    key = F.coalesce(*[F.nullif(c, F.lit("")) for c in identity], F.concat(F.lit("row "), F.concat_ws("/", *order)))
    w = Window.partitionBy("_key").orderBy(*order)
    return results.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n")


def keep_first(rows: DataFrame, key: Column, position: str, limit: int) -> DataFrame:
    """Rows that are the first of their key in order, at most ``limit``."""
    w = Window.partitionBy("_key").orderBy(position)
    return rows.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n").orderBy(position).limit(limit)


def location_pieces(rows: DataFrame, node: str, location: Column) -> DataFrame:
    """``(node, pos, piece)``: a posting's places, one per city, those with a state before those without."""
    pieces = rows.select(node, F.posexplode(F.split(location, r"\s*[;|/]\s*")).alias("pos", "piece")).where(F.trim("piece") != "")
    city = norm(F.substring_index("piece", ",", 1))
    initials = F.array_join(F.transform(F.split(city, " "), lambda w: F.substring(w, 1, 1)), "")
    key = F.when(F.contains(city, F.lit(" ")), initials).otherwise(city)
    w = Window.partitionBy(node, "_key").orderBy(F.desc(F.contains(F.col("piece"), F.lit(","))), "pos")
    return pieces.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").select(node, "pos", F.trim("piece").alias("piece"))
