"""Readers and shapers of landed files: snapshots, samples, feeds, boards, evidence, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.functions.facts import html_lines
from quarrystone.functions.text import STATES, authoritative_places, clean_text, norm, states
from quarrystone.operators.predicates import admitted

POSTING = "id string, company string, title string, location string, url string, listing_url string, source_keys array<string>, source_names array<string>, source_urls array<string>, profiles array<string>, states array<string>, posted_at timestamp, first_seen timestamp, last_seen timestamp, posted_date_provenance string, education_level string, opportunity_type string, link_kind string, link_status string, link_checked_at timestamp, carried_forward boolean"
HEALTH = "status string, count bigint, name string, error string, configured boolean, auto_discovered boolean, direct boolean"
SNAPSHOT = f"generated_at timestamp, content_hash string, jobs array<struct<{', '.join(f'{a}: {b}' for a, b in (x.split(' ', 1) for x in POSTING.split(', ')))}>>, sources map<string, struct<{', '.join(f'{a}: {b}' for a, b in (x.split(' ', 1) for x in HEALTH.split(', ')))}>>"


def load_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Postings and source health of snapshot documents, each with its snapshot's time."""
    docs = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path)
    postings = docs.select(F.col("generated_at").alias("snapshot_ts"), F.posexplode("jobs").alias("ordinal", "j")).select("snapshot_ts", "ordinal", "j.*")
    health = docs.select(F.col("generated_at").alias("snapshot_ts"), F.explode("sources").alias("key", "s")).select("snapshot_ts", "key", "s.*")
    return postings, health


def first_filled(df: DataFrame, names: list[str]) -> Column:
    """The first of these columns that is there and not blank."""
    have = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


#: Names under which samples carry a field.
ALIASES = {"company": ["company", "employer", "organization"], "title": ["title", "role", "position"], "location": ["location", "place", "city"], "url": ["url", "link", "apply_url"], "source": ["source", "source_name"]}


def load_sample(spark: SparkSession, path: str, kind: str, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Discoveries of JSON documents (under one of several keys), JSON lines or CSV, under the names of ``aliases``."""
    if kind == "csv":
        rows = spark.read.option("header", True).csv(path)
    else:
        rows = spark.read.option("multiLine", kind == "json").json(path)
        for key in ("discoveries", "jobs", "listings", "opportunities"):
            if key in rows.columns:
                rows = rows.select(F.explode(key).alias("x")).select("x.*")
                break
    return rows.select(*[first_filled(rows, names).alias(field) for field, names in aliases.items()])


def adapt_feed(payload: DataFrame, renames: dict[str, str], constants: dict[str, str]) -> DataFrame:
    """A feed under our names: ``renames`` maps ours to an expression over theirs."""
    return payload.select(*[F.expr(e).alias(n) for n, e in renames.items()], *[F.lit(v).alias(n) for n, v in constants.items()])


def markdown_rows(pages: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, table_no, row_no, cells, headers)`` of markdown tables; a table begins at the line before its rule."""
    lines = pages.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line")).where(F.col("line").rlike(r"^\s*\|"))
    order = Window.partitionBy(key).orderBy("n")
    rule = F.col("line").rlike(r"^\s*\|[\s:|-]+\|?\s*$")
    head = F.lead(rule).over(order)
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"(?<!\\)\|"), lambda x: F.trim(x))
    rows = lines.withColumn("_rule", rule).withColumn("_head", F.coalesce(head, F.lit(False))).withColumn("cells", cells).withColumn("table_no", F.sum(F.col("_head").cast("int")).over(order))
    rows = rows.where("not _rule and table_no > 0").withColumn("headers", F.first(F.when(F.col("_head"), F.col("cells")), ignorenulls=True).over(Window.partitionBy(key, "table_no").orderBy("n")))
    inside = Window.partitionBy(key, "table_no").orderBy("n")
    return rows.where("not _head").withColumn("row_no", F.row_number().over(inside)).select(key, "table_no", "row_no", "cells", "headers")


def table_jobs(rows: DataFrame, key: str, columns: dict[str, list[str]]) -> DataFrame:
    """Table rows as jobs: each field from the first header that names it; a blank or "↳" company repeats the one above."""
    lowered = F.transform("headers", F.lower)
    cell = lambda names: F.coalesce(*[F.get("cells", F.nullif(F.array_position(lowered, n), F.lit(0)).cast("int") - 1) for n in names])
    out = rows.select(key, "table_no", "row_no", *[cell(names).alias(f) for f, names in columns.items()])
    w = Window.partitionBy(key, "table_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("company", F.last(F.when(~F.col("company").isin("", "↳"), F.col("company")), ignorenulls=True).over(w)) if "company" in columns else out


def html_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, table_no, row_no, cells, headers)`` of HTML tables; the first row with header cells (else the first row) names the columns."""
    bare = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    tables = F.regexp_extract_all(bare, F.lit(r"(?is)<table\b[^>]*>(.*?)(?:</table>|\z)"), F.lit(1))
    rows = F.regexp_extract_all(F.col("t"), F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|\z)"), F.lit(1))
    cells = F.transform(F.regexp_extract_all(F.col("r"), F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=</t[dh]>|<t[dh]\b|\z)"), F.lit(1)), clean_text)
    flat = pages.where(F.col(html).rlike("(?i)<table")).select(key, F.posexplode(tables).alias("table_no", "t")).select(key, "table_no", F.posexplode(rows).alias("n", "r"))
    flat = flat.select(key, (F.col("table_no") + 1).alias("table_no"), "n", cells.alias("cells"), F.col("r").rlike(r"(?i)<th\b").alias("_th")).where(F.size("cells") > 0)
    whole = Window.partitionBy(key, "table_no")
    head = F.coalesce(F.min(F.when(F.col("_th"), F.col("n"))).over(whole), F.min("n").over(whole))
    rows = flat.withColumn("_head", head).withColumn("headers", F.max(F.when(F.col("n") == F.col("_head"), F.col("cells"))).over(whole)).where("n > _head")
    return rows.withColumn("row_no", F.row_number().over(whole.orderBy("n"))).select(key, "table_no", "row_no", "cells", "headers")


#: Payloads of eight kinds of job boards: JSON schema, and our fields over it (``p``). ``board`` is the board's name in its URLs.
BOARD_SHAPES: dict[str, tuple[str, dict[str, str]]] = {
    "greenhouse": ("id bigint, title string, absolute_url string, location struct<name: string>", {"native_id": "p.id", "title": "p.title", "location": "p.location.name", "url": "coalesce(p.absolute_url, concat('https://job-boards.greenhouse.io/', board, '/jobs/', p.id))"}),
    "lever": ("id string, text string, hostedUrl string, country string, createdAt bigint, categories struct<location: string>", {"native_id": "p.id", "title": "p.text", "location": "concat_ws(', ', p.categories.location, p.country)", "url": "coalesce(p.hostedUrl, concat('https://jobs.lever.co/', board, '/', p.id))", "posted_at": "timestamp_millis(p.createdAt)"}),
    "ashby": ("id string, title string, jobUrl string, location string, publishedAt string, secondaryLocations array<struct<location: string>>", {"native_id": "p.id", "title": "p.title", "location": "concat_ws(' | ', p.location, array_join(transform(p.secondaryLocations, x -> x.location), ' | '))", "url": "coalesce(p.jobUrl, concat('https://jobs.ashbyhq.com/', board, '/', p.id))", "posted_at": "try_to_timestamp(p.publishedAt)"}),
    "oracle": ("Id string, Title string, PrimaryLocation string, secondaryLocations array<struct<Name: string>>, PostedDate string", {"native_id": "p.Id", "title": "p.Title", "location": "concat_ws(' | ', p.PrimaryLocation, array_join(transform(p.secondaryLocations, x -> x.Name), ' | '))", "url": "concat(board, '/job/', p.Id)", "posted_at": "try_to_timestamp(p.PostedDate)"}),
    "smartrecruiters": ("id string, name string, releasedDate string, location struct<city: string, region: string, country: string>", {"native_id": "p.id", "title": "p.name", "location": "concat_ws(', ', p.location.city, p.location.region, p.location.country)", "url": "concat('https://jobs.smartrecruiters.com/', board, '/', p.id)", "posted_at": "try_to_timestamp(p.releasedDate)"}),
    "icims": ("url string, status string, posting struct<title: string, date_posted: string, locations: struct<values: array<string>>>", {"native_id": "regexp_extract(p.url, '/jobs/([0-9]+)', 1)", "title": "if(p.status = 'inspected', p.posting.title, NULL)", "location": "array_join(p.posting.locations.values, ' ')", "url": "p.url", "posted_at": "try_to_timestamp(p.posting.date_posted)"}),
    "successfactors": ("link string, title string, location string, date string", {"native_id": "coalesce(nullif(regexp_extract(p.link, '-([0-9]+)(?:-[^/]+)?/[0-9]+/?$', 1), ''), p.link)", "title": "p.title", "location": "coalesce(p.location, regexp_extract(p.title, '[(]([^)]+)[)]$', 1))", "url": "p.link", "posted_at": "try_to_timestamp(p.date)"}),
    "workday": ("title string, locationsText string, externalPath string, postedOn string", {"native_id": "coalesce(nullif(p.externalPath, ''), concat(p.title, '|', p.locationsText))", "title": "p.title", "location": "p.locationsText", "url": "concat(board, p.externalPath)"}),
}
#: Who is admitted: student titles, on target, in the United States.
STUDENT = r"\b(?:intern|interns|internship|co-?op|student|apprentice|trainee|fellow|fellowship|undergraduate|university|new grad)\b"
TARGET = r"software|developer|engineer|programmer|computer|data|machine learning|\bai\b|cyber|security|cloud|devops|technology|\bit\b|analytics|analyst|product|quantitative"
TARGET_EXACT = r"\b(?:IT|AI|ML|QA|UX|UI)\b"


def board_payloads(raw: DataFrame, shapes: dict[str, tuple[str, dict[str, str]]] = BOARD_SHAPES, admit: bool = False) -> DataFrame:
    """Raw payloads (provider, board, body) as observations: native_id, title, location, url, posted_at.

    ``shapes``: provider -> (JSON schema, field -> expression over it). A board's row of
    one id is one; rows without an id go. ``admit`` keeps those that the one rule for all
    shapes lets in: a student's title, on target, in the United States.
    """
    out = None
    for provider, (schema, fields) in shapes.items():
        kinds = {"posted_at": "timestamp"}
        part = raw.where(F.col("provider") == provider).withColumn("p", F.from_json("body", schema))
        part = part.select("provider", "board", *[F.expr(fields.get(n, "NULL")).cast(kinds.get(n, "string")).alias(n) for n in ("native_id", "title", "location", "url", "posted_at")])
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("board", "native_id").orderBy("title", "url")
    rows = out.withColumn("title", clean_text(F.col("title"))).withColumn("_n", F.row_number().over(w)).where("_n = 1 and native_id is not null").drop("_n")
    if not admit:
        return rows
    placed = rows.withColumn("states", F.array_union(states(F.col("location")), F.when(F.col("location").rlike(r"(?i)(?:^|[,|\s])(?:us|united states of america)\s*$"), F.array(F.lit("US"))).otherwise(F.expr("CAST(array() AS array<string>)"))))
    us = [*sorted(set(STATES.values())), "US"]
    return admitted(placed, STUDENT, TARGET, TARGET_EXACT, us)


def json_ld(html: Column) -> Column:
    """Embedded JSON-LD texts of a page."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))


CLOSED = r"no longer (?:available|accepting)|position (?:has been )?(?:filled|closed)"


def evidence_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Title, requisition, places, description, lines and apply status of posting pages, from JSON-LD where there is any."""
    ld = F.try_parse_json(F.get(json_ld(F.col(html)), F.lit(0)))
    got = lambda path, kind="string": F.try_variant_get(ld, path, kind)
    title = F.coalesce(got("$.title"), F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit("")))
    # a place or a list of them
    many = F.coalesce(got("$.jobLocation", "array<variant>"), F.when(got("$.jobLocation", "variant").isNotNull(), F.array(got("$.jobLocation", "variant"))))
    part = lambda x, name: F.try_variant_get(x, f"$.address.{name}", "string")
    places = F.filter(F.transform(many, lambda x: F.concat_ws(", ", part(x, "addressLocality"), part(x, "addressRegion"), part(x, "addressCountry"))), lambda x: x != "")
    closed = F.lower(html).rlike(CLOSED)
    return pages.select(
        key, title.alias("title"), F.coalesce(got("$.identifier.value"), got("$.identifier")).alias("requisition"), F.coalesce(places, F.expr("CAST(array() AS array<string>)")).alias("locations"),
        clean_text(got("$.description")).alias("description"), F.size(html_lines(F.col(html))).alias("lines"), F.when(closed, "closed").otherwise("open").alias("application_status"),
    )


#: Payloads of five kinds of inspected postings: JSON schema, and the fields of evidence over it (``p``).
EVIDENCE_SHAPES: dict[str, tuple[str, dict[str, str]]] = {
    "workday": ("jobPostingInfo struct<title: string, jobDescription: string, jobReqId: string, location: string, additionalLocations: array<string>, canApply: boolean, posted: boolean>", {"title": "p.jobPostingInfo.title", "description": "p.jobPostingInfo.jobDescription", "requisition": "p.jobPostingInfo.jobReqId", "locations": "concat(array(p.jobPostingInfo.location), coalesce(p.jobPostingInfo.additionalLocations, array()))", "open": "p.jobPostingInfo.canApply"}),
    "greenhouse": ("id bigint, title string, content string, requisition_id string, location struct<name: string>, offices array<struct<location: string>>", {"title": "p.title", "description": "p.content", "requisition": "coalesce(p.requisition_id, cast(p.id AS string))", "locations": "concat(array(p.location.name), transform(coalesce(p.offices, array()), x -> x.location))", "open": "p.title IS NOT NULL"}),
    "ashby": ("id string, title string, descriptionHtml string, location string, secondaryLocations array<struct<location: string>>, isListed boolean", {"title": "p.title", "description": "p.descriptionHtml", "requisition": "p.id", "locations": "concat(array(p.location), transform(coalesce(p.secondaryLocations, array()), x -> x.location))", "open": "p.isListed"}),
    "oracle": ("Id string, Title string, ExternalDescriptionStr string, PrimaryLocation string, secondaryLocations array<struct<Name: string>>, ExternalPostedEndDate string", {"title": "p.Title", "description": "p.ExternalDescriptionStr", "requisition": "p.Id", "locations": "concat(array(p.PrimaryLocation), transform(coalesce(p.secondaryLocations, array()), x -> x.Name))", "open": "p.ExternalPostedEndDate IS NULL"}),
    "icims": ("title string, description string, identifier struct<value: string>, jobLocation array<struct<address: struct<addressLocality: string, addressRegion: string, addressCountry: string>>>", {"title": "p.title", "description": "p.description", "requisition": "p.identifier.value", "locations": "transform(p.jobLocation, x -> concat_ws(', ', x.address.addressLocality, x.address.addressRegion, x.address.addressCountry))", "open": "p.title IS NOT NULL"}),
}


def evidence_payloads(raw: DataFrame, key: str, shapes: dict[str, tuple[str, dict[str, str]]] = EVIDENCE_SHAPES) -> DataFrame:
    """Raw evidence (key, provider, body) as ``(key, provider, title, requisition, locations, description, lines, application_status)``.

    Places are cleaned and come once each; a description gives its block-level lines;
    the status is unknown where the payload says nothing.
    """
    out = None
    for provider, (schema, fields) in shapes.items():
        part = raw.where(F.col("provider") == provider).withColumn("p", F.from_json("body", schema))
        part = part.select(key, "provider", *[F.expr(e).alias(n) for n, e in fields.items()])
        out = part if out is None else out.unionByName(part)
    said = F.filter(F.coalesce("locations", F.expr("CAST(array() AS array<string>)")), lambda x: x.isNotNull() & (x != ""))
    status = F.when(F.col("open"), "open").when(~F.col("open"), "closed").otherwise("unknown")
    return out.select(key, "provider", clean_text(F.col("title")).alias("title"), "requisition", authoritative_places(said).alias("locations"), clean_text(F.col("description")).alias("description"), html_lines(F.col("description")).alias("lines"), status.alias("application_status"))


def seed_rows(df: DataFrame, name: Column, rank: Column | None = None) -> DataFrame:
    """Employer seeds: key, name and rank, the best rank of each key."""
    rows = df.select(norm(name).alias("key"), name.alias("name"), (rank if rank is not None else F.lit(None).cast("int")).alias("rank")).where("key <> ''")
    return rows.groupBy("key").agg(F.min(F.struct("rank", "name")).alias("s")).select("key", "s.name", "s.rank")


def contiguous(df: DataFrame, rank: str) -> DataFrame:
    """Whether ranks run from 1 without a gap or repetition."""
    return df.agg(F.min(rank).alias("first"), F.max(rank).alias("last"), F.count(rank).alias("n"), F.countDistinct(rank).alias("distinct")).withColumn("contiguous", (F.col("first") == 1) & (F.col("last") == F.col("n")) & (F.col("n") == F.col("distinct")))


def serving_projection(facts: DataFrame, key: str, levels: list[str]) -> DataFrame:
    """Facts of the wanted levels nested per document and field, for serving; empty fields do not appear."""
    kept = facts.where(F.col("level").isin(levels))
    return kept.groupBy(key, "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "sentence", "level", "statement"))), lambda x: F.struct(x["level"].alias("level"), x["statement"].alias("statement"))).alias("facts"))


def candidate_projection(postings: DataFrame, fields: list[str], kinds: list[str]) -> DataFrame:
    """Postings of the wanted kinds that can be applied to, with the fields that ranking reads; blank fields are null."""
    kept = postings.where(F.col("link_kind").isin(kinds) & F.col("url").rlike("^https?://"))
    text = {f.name for f in postings.schema if f.dataType.simpleString() == "string"}
    return kept.select("id", *[F.nullif(F.trim(c), F.lit("")).alias(c) if c in text else F.col(c) for c in fields])


def shortlist_projection(ranked: DataFrame, postings: DataFrame, fields: list[str], top: int) -> DataFrame:
    """The first ``top`` postings of each profile with the fields that a reader sees."""
    return ranked.where(F.col("rank") <= top).select("profile_id", "rank", "posting_id").join(postings.select(F.col("id").alias("posting_id"), *fields), "posting_id").select("profile_id", "rank", "posting_id", *fields)


def load_zips(spark: SparkSession, path: str) -> DataFrame:
    """The postal table of a CSV file; rows without coordinates go."""
    schema = "zip_code string, city string, state string, latitude double, longitude double, population bigint"
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.where("latitude is not null and longitude is not null").withColumn("zip_code", F.lpad("zip_code", 5, "0"))
