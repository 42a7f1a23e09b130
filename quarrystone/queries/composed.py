"""Facts, evidence and fit over pages and documents that hold some: each row's own text with a part before it that is drawn by its key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quarrystone.functions import classify as K
from quarrystone.functions import facts as X
from quarrystone.functions import scoring as S
from quarrystone.functions import text as TX
from quarrystone.operators import dedupe as D
from quarrystone.queries.registry import query
from quarrystone.sources import snapshots as SN
from quarrystone.sources.listings import observations, table, with_sql

TECH = ["Python", "Java", "SQL", "Linux", "Docker", "AWS", "MATLAB", "Git", "C++", "Kubernetes", "Azure", "TypeScript"]
HEADS = [("Required Qualifications:", "required"), ("Preferred Qualifications", "preferred"), ("What we're looking for", "required"), ("Skills and abilities", "unspecified")]
DEGREE = ["You must hold a Bachelor's degree in Mathematics.", "You must hold a Bachelor’s degree in Physics.", "You must enjoy long walks."]
#: Places in TECH of a page's technologies.
PICKS = ["{k} % 12", "({k} * 7 + 3) % 12", "({k} * 5 + 1) % 12", "({k} + 6) % 12"]


def picked(key, words):
    return F.element_at(F.array(*map(F.lit, words)), (F.expr(key) + 1).cast("int"))


def page_facts(spark, sf):
    """Facts of all pages: a posting's sections drawn by the page's number, then the page as it is."""
    k = "page_id"
    t = [picked(p.format(k=k), TECH) for p in PICKS]
    line = lambda tag, *parts: F.concat(F.lit(f"<{tag}>"), *[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit(f"</{tag}>"))
    composed = F.concat(
        line("h2", picked("page_id % 4", [h for h, _ in HEADS])), F.lit("<ul>"), line("li", "Experience with ", t[0], " and ", t[1], "."), line("li", picked("page_id % 3", DEGREE)), line("li", "GPA of 3.0 preferred."),
        line("li", "Visa sponsorship isn't required."), line("li", "Minimum of two projects using ", t[2], "."), F.lit("</ul>"), line("h3", "What you'll do"), line("p", "Build services in Rust."),
        line("p", "Hands-on experience with ", t[3], "."), line("h3", "What we offer"),
    )
    pages = table(spark, sf, "pages").select(k, F.posexplode(X.html_lines(F.concat(composed, F.coalesce("html", F.lit(""))))).alias("ordinal", "line"))
    return X.extract_facts(pages, k, "ordinal", "line")


def _pick(words, key):
    """The same choice in SQL."""
    return "([" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + f"])[{key} + 1]"


_T = [_pick(TECH, p.format(k="page_id")) for p in PICKS]
_SECTION = _pick([level for _, level in HEADS], "page_id % 4")
_INDEX = "list_position(['" + "', '".join(X.TECHNOLOGIES) + "'], {})"
FACTS = f"""p AS (SELECT page_id, {_T[0]} AS a, {_T[1]} AS b, {_T[2]} AS c, {_T[3]} AS d, {_SECTION} AS section, {_pick(DEGREE, "page_id % 3")} AS asks FROM pages),
facts AS (SELECT page_id, 1 AS ordinal, 'skills' AS field, section AS level, 'Experience with ' || a || ' and ' || b || '.' AS statement, CASE WHEN a = b THEN [a] WHEN {_INDEX.format("a")} < {_INDEX.format("b")} THEN [a, b] ELSE [b, a] END AS technologies FROM p
UNION ALL SELECT page_id, 2, unnest(CASE WHEN page_id % 3 < 2 THEN ['education', 'major_fields'] ELSE ['other_eligibility'] END), 'required', asks, [] FROM p
UNION ALL SELECT page_id, 3, 'other_eligibility', 'preferred', 'GPA of 3.0 preferred.', [] FROM p
UNION ALL SELECT page_id, 4, 'work_authorization', 'not_required', 'Visa sponsorship isn''t required.', [] FROM p
UNION ALL SELECT page_id, 5, 'skills', CASE WHEN section = 'preferred' THEN 'preferred' ELSE 'required' END, 'Minimum of two projects using ' || c || '.', [c] FROM p
UNION ALL SELECT page_id, 8, 'skills', 'unspecified', 'Hands-on experience with ' || d || '.', [d] FROM p)"""


@query("c11_page_facts", f"WITH {FACTS} SELECT page_id, ordinal, 0 AS sentence, field, level, statement, technologies, level = 'not_required' AS negated FROM facts")
def c11_facts(spark, sf):
    return page_facts(spark, sf)


@query("c11_page_classes", f"WITH {FACTS} SELECT page_id, field, CASE WHEN count(DISTINCT level) = 1 THEN min(level) ELSE 'mixed' END AS classification, count(*) AS facts FROM facts GROUP BY 1, 2")
def c11_classes(spark, sf):
    return X.field_classes(page_facts(spark, sf), "page_id")


@query("s10_page_projection", f"WITH {FACTS} SELECT page_id, field, count(*) AS n, string_agg(level || ': ' || statement, '|' ORDER BY ordinal) AS said FROM facts WHERE level IN ('required', 'preferred') GROUP BY 1, 2")
def s10_pages(spark, sf):
    served = SN.serving_projection(page_facts(spark, sf), "page_id", ["required", "preferred"])
    return served.select("page_id", "field", F.size("facts").cast("bigint").alias("n"), F.array_join(F.transform("facts", lambda x: F.concat(x["level"], F.lit(": "), x["statement"])), "|").alias("said"))


_FAMILY = {skill: family for family, skills in reversed(S.FAMILIES.items()) for skill in skills}
_KNOWN = ", ".join(f"({i}, '{n}', {chr(39) + _FAMILY[n.lower()] + chr(39) if n.lower() in _FAMILY else 'NULL'})" for i, n in enumerate(X.TECHNOLOGIES))
FIT = f"""WITH {FACTS}, known(i, name, family) AS (VALUES {_KNOWN}), held AS (SELECT n_nationkey AS p, name, family FROM nation, known WHERE (i + n_nationkey) % 3 = 0),
asked AS (SELECT DISTINCT page_id, page_id % 25 AS p, level = 'required' AS required, unnest(technologies) AS skill FROM facts WHERE field = 'skills'),
kinds AS (SELECT a.page_id, a.skill, required, CASE WHEN h.name IS NOT NULL AND a.p % 2 = 0 THEN 'exact' WHEN h.name IS NOT NULL AND required THEN 'cautious' WHEN a.p % 2 = 0 AND EXISTS (SELECT 1 FROM held o WHERE o.p = a.p AND o.family = k.family AND o.name <> a.skill) THEN 'adjacent' WHEN required THEN 'hard' END AS kind
 FROM asked a JOIN known k ON k.name = a.skill LEFT JOIN held h ON h.p = a.p AND h.name = a.skill),
n AS (SELECT page_id, count_if(kind = 'exact' AND required) AS exact, count_if(kind = 'adjacent' AND required) AS adjacent, count_if(kind = 'exact' AND NOT required) AS wanted, count_if(kind = 'adjacent' AND NOT required) AS kin, count_if(kind = 'cautious') AS cautious, count_if(kind = 'hard') AS hard FROM (SELECT DISTINCT * FROM kinds) GROUP BY 1),
c AS (SELECT page_id, page_id % 25 AS p, coalesce(exact, 0) AS exact, coalesce(adjacent, 0) AS adjacent, coalesce(wanted, 0) AS wanted, coalesce(kin, 0) AS kin, coalesce(cautious, 0) AS cautious, coalesce(hard, 0) AS hard,
 CASE WHEN page_id % 3 = (CASE WHEN page_id % 25 % 2 = 1 THEN 0 ELSE 1 END) THEN 1 ELSE 0 END AS major, CASE WHEN page_id % 3 < 2 THEN 1 ELSE 0 END AS degree FROM pages LEFT JOIN n USING (page_id)),
d AS (SELECT *, exact + adjacent + major + degree AS signals, CASE WHEN hard >= 1 THEN 5 ELSE 0 END + CASE WHEN hard >= 2 THEN 3 ELSE 0 END + 2 * greatest(0, hard - 2) AS gaps FROM c),
e AS (SELECT *, 18 + least(5, 3 * major + 2 * degree) + CASE WHEN signals > 0 AND hard + cautious + (degree - major) = 0 THEN least(7, 4 + signals) ELSE 0 END + least(9.0, 3.0 * exact) + least(6.0, 1.5 * adjacent) + least(3.0, 1.0 * wanted) + least(2.0, 0.5 * kin) - least(3.0, 1.0 * cautious) - least(10, gaps) AS total FROM d)
SELECT p AS profile_id, page_id AS posting_id, floor(greatest(0, least(45, total)) + 0.5)::INT AS fit FROM e WHERE p IN (SELECT n_nationkey FROM nation)"""


@query("c15_page_fit", FIT)
def c15_pages(spark, sf):
    """Pages as postings by their facts, for the profile of the nation that a page's number deals it to."""
    facts = page_facts(spark, sf).withColumnRenamed("page_id", "posting_id")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("profile_id"))
    pairs = table(spark, sf, "pages").select((F.col("page_id") % 25).alias("profile_id"), F.col("page_id").alias("posting_id")).join(nations, "profile_id")
    every = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(X.TECHNOLOGIES)])
    skills = nations.select("profile_id", F.explode(F.filter(every, lambda x: (x["i"] + F.col("profile_id")) % 3 == 0)).alias("x")).select("profile_id", F.col("x.n").alias("skill"), F.when(F.col("profile_id") % 2 == 0, "supported").otherwise("cautious").alias("support"))
    majors = nations.select("profile_id", F.when(F.col("profile_id") % 2 == 1, "Mathematics").otherwise("Physics").alias("major"), F.lit("bachelor").alias("degree"))
    return S.evidence_fit(S.skill_evidence(facts, skills, pairs), S.academic_support(facts, majors, pairs), facts, pairs)


RIGHTS = [("U.S. citizen.", "U.S. citizen", X.UNKNOWN), ("Needs visa sponsorship.", None, "Needs visa sponsorship"), ("Authorized to work in the US without sponsorship.", None, "Authorized to work in the U.S. without sponsorship"), ("No sponsorship required.", None, "Authorized to work in the U.S. without sponsorship"), ("", None, None)]
CLEARANCE = [("Active Top Secret clearance", "Active Top Secret clearance"), ("secret clearance (active)", "Active Secret clearance"), ("Eligible to obtain a security clearance", "Eligible / able to obtain a clearance"), ("Without active security clearance", "No active security clearance"), ("plan C, R’n’B, réunion", None)]
SCHOOLS = [("B.S. in", "Bachelor of Science"), ("Bachelor of Arts in", "Bachelor of Arts"), ("Master's in", "Master's degree")]
SUBJECTS = ["Computer Science", "Mathematics", "Physics", "Mechanical Engineering"]
_DOC = [_pick(TECH, p.format(k="doc_id")) for p in PICKS]
EVIDENCE = f"""WITH d AS (SELECT doc_id, {_DOC[0]} AS a, {_DOC[1]} AS b FROM documents),
e AS (SELECT doc_id, unnest([{{'kind': 'graduation', 'value': {_pick(X.MONTHS, "doc_id % 12")} || ' ' || (2020 + doc_id % 9)}}, {{'kind': 'degree', 'value': {_pick([v for _, v in SCHOOLS], "doc_id % 3")}}}, {{'kind': 'major', 'value': {_pick(SUBJECTS, "doc_id % 4")}}},
 {{'kind': 'citizenship', 'value': CASE WHEN doc_id % 5 = 0 THEN 'U.S. citizen' END}}, {{'kind': 'work_authorization', 'value': CASE doc_id % 5 WHEN 4 THEN NULL WHEN 1 THEN 'Needs visa sponsorship' ELSE 'Authorized to work in the U.S. without sponsorship' END}},
 {{'kind': 'clearance', 'value': {_pick([v or "" for _, v in CLEARANCE], "doc_id // 5 % 5")}}}, {{'kind': 'skill', 'value': a}}, {{'kind': 'skill', 'value': CASE WHEN a <> b THEN b END}}, {{'kind': 'section:skills', 'value': a || ', ' || b}}], recursive := true) FROM d)
SELECT doc_id, kind, value FROM e WHERE value <> ''"""


@query("c22_document_evidence", EVIDENCE)
def c22_documents(spark, sf):
    """Every kind and value found in a profile that is drawn by the document's number, with the document after it."""
    t = [picked(p.format(k="doc_id"), TECH) for p in PICKS]
    year = (F.lit(2020) + F.col("doc_id") % 9).cast("string")
    said = F.concat(
        F.lit("Jo Doe\nEducation\nLincoln High School, June 2010\nClubs: chess, debate, robotics, orchestra, track and field\nState University, "), picked("doc_id % 3", [s for s, _ in SCHOOLS]), F.lit(" "), picked("doc_id % 4", SUBJECTS), F.lit(", expected "), picked("doc_id % 12", X.MONTHS), F.lit(" "), year, F.lit("\n"),
        picked("doc_id % 5", [r[0] for r in RIGHTS]), F.lit("\n"), picked("doc_id div 5 % 5", [c for c, _ in CLEARANCE]), F.lit("\nSkills:\n• "), t[0], F.lit(", "), t[1], F.lit("\nAwards\n"),
    )
    docs = table(spark, sf, "documents").select("doc_id", F.concat(said, F.coalesce("text", F.lit(""))).alias("text"))
    return X.profile_evidence(docs, "doc_id", "text")


@query("c22_evidence_counts", f"SELECT kind, value, count(DISTINCT doc_id) AS documents FROM ({EVIDENCE}) GROUP BY 1, 2")
def c22_counts(spark, sf):
    return c22_documents(spark, sf).groupBy("kind", "value").agg(F.countDistinct("doc_id").alias("documents"))


ASKED = ["You must hold an active Secret clearance.", "Must possess a current Top Secret clearance.", "Must be able to obtain a security clearance.", "Must already have a clearance.", "TS/SCI clearance must be active."]
HELD = [None, "No active security clearance", "Eligible / able to obtain a clearance", "Active Secret clearance", "Active Top Secret clearance", "Lapsed secret clearance", "Current clearance"]


@query("c14_clearance", """WITH o AS (SELECT o_orderkey, n_nationkey AS p, [2, 3, -1, 0, 3][o_orderkey % 5 + 1] AS rank, o_orderkey % 5 IN (0, 1, 4) AS standing, n_nationkey % 7 AS held FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT o_orderkey, rank >= 0 AND (held = 1 OR (held = 2 AND standing)) AS excluded, CASE WHEN rank < 0 OR held = 1 OR (held = 2 AND standing) THEN 0 WHEN held = 4 OR (held = 3 AND rank < 3) OR (held = 6 AND rank = 0) THEN 0 ELSE 5 END::INT AS penalty FROM o""")
def c14_clearance(spark, sf):
    """Every clearance that a statement asks for against every one that a profile states; the statements are read once each."""
    asks = F.array(*[F.struct(F.lit(i).alias("ask"), F.lit(x).alias("statement")) for i, x in enumerate(ASKED)])
    says = F.array(*[F.struct(F.lit(i).alias("said"), F.lit(x).cast("string").alias("text")) for i, x in enumerate(HELD)])
    nation = table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") % 7).alias("said"))
    one = nation.agg(F.count(F.lit(1)))
    facts = one.select(F.explode(asks).alias("x")).select("x.*", F.lit("other_eligibility").alias("field"), F.lit("required").alias("level"))
    held = one.select(F.explode(says).alias("x")).select("x.said", S.held_clearance(F.col("x.text")).alias("held"))
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("ask", F.col("o_orderkey") % 5)
    gate = S.clearance_gate(F.col("clearance"), F.col("held"))
    return o.join(S.asked_clearances(facts, "ask"), "ask", "left").join(held, "said", "left").select("o_orderkey", gate["excluded"].alias("excluded"), gate["penalty"].alias("penalty"))


TITLES = [("Software Engineer Intern", ["cs"]), ("Data Analyst Intern", ["tech-business"]), ("Data Scientist", ["cs"]), ("Mechanical Engineering Co-op", ["engineering"]), ("Audit and Treasury Intern", ["finance"]), ("Brand Communications", ["marketing"]), ("Nuclear Robotics Research", ["engineering"]), ("Product Manager, Cloud", ["cs", "tech-business"]), ("Cook", ["general"]), ("HVAC Design and Financial Planning", ["engineering", "finance"])]


@query("c6_areas_of_titles", "SELECT p_partkey, [" + ", ".join("[" + ", ".join(f"'{a}'" for a in areas) + "]" for _, areas in TITLES) + "][p_partkey % 10 + 1] AS areas FROM part")
def c6_titles(spark, sf):
    """Both rule sets and the shared titles over a title that is drawn by the part's number."""
    return table(spark, sf, "part").select("p_partkey", K.career_areas(F.concat(picked("p_partkey % 10", [t for t, _ in TITLES]), F.lit(" #"), F.col("p_partkey").cast("string"))).alias("areas"))


@query("c20_place_labels", """SELECT c_custkey, unnest(CASE c_custkey % 7 WHEN 0 THEN ['Town ' || w || ', NY', 'Remote'] WHEN 1 THEN ['San ' || w || ', CA'] WHEN 2 THEN ['Port ' || w || ', TX'] WHEN 3 THEN ['Albany, NY'] WHEN 4 THEN ['Salem, OR', 'Berlin, Land ' || w] WHEN 5 THEN ['Spring' || lower(w) || ', IL'] ELSE ['Fort ' || w || '-upon, OH'] END) AS place
 FROM (SELECT *, (['Alder', 'Birch', 'Cedar', 'Elm'])[c_custkey % 4 + 1] AS w FROM customer)""")
def c20_labels(spark, sf):
    """Feed places split and shown: every notation, around a name that is drawn by the customer's number."""
    k, w = F.col("c_custkey") % 7, picked("c_custkey % 4", ["Alder", "Birch", "Cedar", "Elm"])
    raw = F.when(k == 0, F.concat(F.lit("2 Locations town "), w, F.lit(", New York; USA Remote"))).when(k == 1, F.concat(F.lit("US-CA-San "), w, F.lit("-12"))).when(k == 2, F.concat(F.lit("port "), w, F.lit(", Texas, United States")))
    raw = raw.when(k == 3, F.lit("NY01-02-ALBANY-x")).when(k == 4, F.concat(F.lit("12 High St, Salem, OR | Berlin, Land "), w)).when(k == 5, F.concat(F.lit("Spring"), F.lower(w))).otherwise(F.concat(F.lit("OH > fort "), w, F.lit("-upon > Dock 4")))
    states = F.when(k == 5, F.array(F.lit("IL")))
    return table(spark, sf, "customer").select("c_custkey", F.explode(F.transform(TX.split_places(raw), lambda x: TX.place_label(x, states))).alias("place"))


@query("d3_native_reconciliation", with_sql("obs") + """, r AS (SELECT *, posting_id % 6 AS t, link_kind = 'direct' AS led, CASE WHEN url IS NULL THEN NULL WHEN t < 4 THEN 'p' || posting_id WHEN led AND t = 4 THEN 'd' || posting_id WHEN led THEN 'e' || company || '/' || title || '/' || location END AS i FROM obs)
SELECT (list(ordinal ORDER BY led DESC, CASE link_kind WHEN 'direct' THEN 4 WHEN 'listing' THEN 2 ELSE 1 END DESC, posted_at DESC, ordinal DESC))[1] AS id, list_sort(list(DISTINCT source_key)) AS source_keys, max(posted_at) AS posted_at, count(*) AS merged FROM r GROUP BY coalesce(i, 'row ' || ordinal)""")
def d3_native(spark, sf):
    """Observations under the URLs of four providers, each in the shapes that it has, under an employer's own numbered URLs, and under one page of openings."""
    o = observations(spark, sf, deal=True)
    k, even = F.col("posting_id").cast("string"), F.col("ordinal") % 2 == 0
    both = lambda a, b: F.when(even, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in a])).otherwise(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in b]))
    uuid = F.concat(F.lit("0000abcd-0000-0000-0000-"), F.lpad(k, 12, "0"))
    forms = [
        both(["https://boards.greenhouse.io/acme/jobs/", k], ["https://job-boards.greenhouse.io/Acme/jobs/", k, "?gh_src=x"]),
        both(["https://jobs.ashbyhq.com/acme/", uuid], ["https://jobs.ashbyhq.com/acme/", F.upper(uuid), "/application"]),
        both(["https://careers-acme.icims.com/jobs/", k, "/engineer/job"], ["https://careers-acme.icims.com/jobs/", k, "/job?mobile=true"]),
        both(["https://acme.wd1.myworkdayjobs.com/en-US/Ext/job/Albany/Engineer_R-", k], ["https://acme.wd5.myworkdayjobs.com/Ext/job/Engineer_R-", k, "/apply"]),
        both(["https://jobs.example.com/", F.lpad(k, 9, "0")], ["https://jobs.example.com/", F.lpad(k, 9, "0"), "?utm_source=x"]), F.lit("https://jobs.example.com/openings"),
    ]
    url = reduce(lambda done, i: done.when(F.col("posting_id") % 6 == i, forms[i]), range(1, 6), F.when(F.col("posting_id") % 6 == 0, forms[0]))
    rows = o.select(F.col("ordinal").alias("id"), "company", "title", "location", "link_kind", "posted_at", F.array("source_key").alias("source_keys"), F.when(F.col("url").isNotNull(), url).alias("url"))
    return D.reconcile(D.identified(rows), F.col("identity"), keep=["id", "source_keys", "posted_at"]).select("id", "source_keys", "posted_at", "merged")
