"""Native identity of a posting from its URL, and provider families.

A rule says how a provider's URLs look: host pattern and path pattern whose groups
are the identity's parts. The first rule that fits names the identity; the rest of
the URL (language, query, slug) does not count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.text import bound, canonical_url, host, url_part


@dataclass(frozen=True)
class Rule:
    provider: str
    host: str  # pattern over the host; its groups are parts
    path: str  # pattern over the path; its groups are parts
    url: str  # canonical form, with {0}, {1}, ... for the parts


#: Public URL shapes of five providers.
RULES = (
    Rule("workday", r"^([a-z0-9-]+)\.(?:wd\d+\.)?myworkday(?:jobs|site)\.com$", r"^/(?:[a-z]{2}-[A-Z]{2}/)?([^/]+)/job/(?:.*_)?([A-Za-z]*-?\d[\w-]*?)(?:/apply.*)?/?$", "workday:{0}/{1}/{2}"),
    Rule("greenhouse", r"^(?:job-)?boards(?:\.eu)?\.greenhouse\.io$", r"^/([^/]+)/jobs/(\d+)", "https://boards.greenhouse.io/{0}/jobs/{1}"),
    Rule("icims", r"^([a-z0-9.-]+\.icims\.com)$", r"^/jobs/(\d+)", "https://{0}/jobs/{1}/job"),
    Rule("oracle_hcm", r"^([a-z0-9-]+\.fa\.[a-z0-9-]+\.oraclecloud\.com)$", r"(?i)/candidateexperience/[^/]+/sites/[^/]+/job/([^/]+)", "https://{0}/job/{1}"),
    Rule("ashby", r"^jobs\.ashbyhq\.com$", r"^/([^/]+)/([0-9a-fA-F-]{36})", "https://jobs.ashbyhq.com/{0}/{1}"),
)


def _groups(pattern: str) -> int:
    import re

    return re.compile(pattern).groups


def _parts(of: Column, path: Column, rule: Rule) -> list[Column]:
    return [F.lower(F.regexp_extract(of, rule.host, i + 1)) for i in range(_groups(rule.host))] + [F.regexp_extract(path, rule.path, i + 1) for i in range(_groups(rule.path))]


def _by_rule(url: Column, rules, made) -> Column:
    """``made`` of the first rule that fits and its parts; a path is read only where the host fits."""
    path = F.coalesce(url_part(url, "PATH"), F.lit(""))
    by = lambda h, r: F.when(h.rlike(r.host), bound(path, lambda p: F.when(p.rlike(r.path), made(r, _parts(h, p, r)))))
    return bound(host(url), lambda h: F.coalesce(*[by(h, r) for r in rules]))


def posting_identity(url: Column, rules=RULES) -> Column:
    """struct<provider, parts array<string>>, null where no rule fits."""
    return _by_rule(url, rules, lambda r, parts: F.struct(F.lit(r.provider).alias("provider"), F.array(*[F.lower(p) for p in parts]).alias("parts")))


def with_posting_key(rows: DataFrame, url: Column, name: str, rules=RULES) -> DataFrame:
    """``rows`` with ``name``: ``provider|part|...`` of ``posting_identity``, null where no rule fits.

    Host and path are columns of a step before, so that each is read once and Spark
    compiles what follows; the lambdas of ``posting_identity`` are interpreted.
    """
    read = rows.withColumns({"_host": host(url), "_path": F.coalesce(url_part(url, "PATH"), F.lit(""))})
    h, p = F.col("_host"), F.col("_path")
    key = lambda r: F.concat_ws("|", F.lit(r.provider), *[F.lower(x) for x in _parts(h, p, r)])
    return read.withColumn(name, F.coalesce(*[F.when(h.rlike(r.host) & p.rlike(r.path), key(r)) for r in rules])).drop("_host", "_path")


def identity_key(url: Column, rules=RULES) -> Column:
    """``provider|part|...``, else ``url|<canonical>``, else null."""
    i = posting_identity(url, rules)
    c = canonical_url(url)
    return F.coalesce(F.concat(i["provider"], F.lit("|"), F.array_join(i["parts"], "|")), F.when(c != "", F.concat(F.lit("url|"), c)))


def native_url(url: Column, rules=RULES) -> Column:
    """The provider's own form of a posting's URL; null where no rule fits."""

    def form(r: Rule, parts: list[Column]) -> Column:
        out = F.lit(r.url)
        for i, p in enumerate(parts):
            out = F.replace(out, F.lit(f"{{{i}}}"), p)
        return out

    return _by_rule(url, rules, form)


def id_tokens(url: Column) -> Column:
    """Long numbers and UUIDs in a URL: native ids of unknown providers."""
    return F.array_distinct(F.regexp_extract_all(F.lower(url), F.lit(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\d{5,}"), F.lit(0)))


def apply_switch(url: Column, to_apply: bool) -> Column:
    """A posting's apply page, or back from it; a query stays at the end."""
    path, query = F.regexp_extract(url, r"^[^?]*", 0), F.regexp_extract(url, r"\?.*$", 0)
    bare = F.regexp_replace(path, r"/apply/?$", "")
    return F.concat(F.regexp_replace(bare, r"/$", ""), F.lit("/apply"), query) if to_apply else F.concat(bare, query)


#: Providers whose public URL follows from a slug of provider, board and id: pattern and URL.
SLUGS = {
    "greenhouse": (r"(?i)^greenhouse-(.+)-(\d+)$", "https://job-boards.greenhouse.io/{0}/jobs/{1}"),
    "ashby": (r"^ashby-(.+)-([0-9a-fA-F-]{32,36})$", "https://jobs.ashbyhq.com/{0}/{1}"),
    "lever": (r"^lever-(.+)-([0-9a-fA-F-]{32,36})$", "https://jobs.lever.co/{0}/{1}"),
}


def slug_url(url: Column, hosts: list[str], slugs=SLUGS) -> Column:
    """The direct URL that an intermediary's slug tells, for the shapes where nothing has to be guessed; null otherwise."""
    slug = F.substring_index(F.regexp_replace(F.coalesce(url_part(url, "PATH"), F.lit("")), "/+$", ""), "/", -1)
    out = F.lit(None).cast("string")
    for pattern, form in reversed(slugs.values()):
        filled = F.replace(F.replace(F.lit(form), F.lit("{0}"), F.regexp_extract(slug, pattern, 1)), F.lit("{1}"), F.regexp_extract(slug, pattern, 2))
        out = F.when(slug.rlike(pattern), filled).otherwise(out)
    return F.when(host(url).isin(hosts), out)


def is_job_page(url: Column) -> Column:
    """Whether a URL is a posting's page at a provider that keeps its apply form elsewhere."""
    path = F.lower(F.coalesce(url_part(url, "PATH"), F.lit("")))
    return host(url).rlike(r"^[^.]+\.wd\d+\.myworkday(?:jobs|site)\.com$") & (path.contains("/job/") | path.contains("/details/")) & ~path.rlike("/apply/?$")


def tokens_match(a: Column, b: Column) -> Column:
    """Whether two URLs name a common posting: one of their id tokens is the same."""
    return F.coalesce(F.arrays_overlap(id_tokens(a), id_tokens(b)), F.lit(False))


def hint_status(hint: Column, shared: list[str], sso: str = r"(?i)^(?:login|sso|auth|accounts|id)\.") -> Column:
    """Whether a hint names a tenant, a shared host, or nothing: ``tenant``, ``shared`` or ``invalid``."""
    h = F.when(hint.contains("://"), host(hint)).otherwise(F.lower(F.regexp_extract(hint, r"^([^/]+)", 1)))
    return F.when(~h.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"), "invalid").when(h.rlike(sso) | h.isin(shared), "shared").otherwise("tenant")


PAGE_FLAGS = {"job_detail": (r"(?i)/jobs?/[^/]*\d{3,}", -40), "careers": (r"(?i)/(?:careers?|jobs?|join[-_]?us|opportunities)(?:/|$)", 50), "search": (r"(?i)[?&](?:q|query|keyword)=", 15), "blog": (r"(?i)/(?:blog|news|press)/", -60)}


def landing_score(url: Column, flags=PAGE_FLAGS) -> Column:
    """How much a page looks like an employer's list of openings; shorter paths win ties."""
    score = F.lit(0.0)
    for pattern, weight in flags.values():
        score = score + F.when(url.rlike(pattern), weight).otherwise(0)
    return score - F.size(F.split(F.regexp_replace(url, r"^[a-z]+://[^/]*", ""), "/")) * 0.5
