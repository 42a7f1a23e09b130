"""Rules over texts and scores against what they must give, and against plain Python on random rows."""

import itertools
import random
import re
from datetime import date, datetime, timezone
from difflib import SequenceMatcher

import pytest
import pandas as pd
from pyspark.sql import functions as F

from quarrystone.functions import classify, facts, identity, pay, scoring, text
from quarrystone.operators import coverage, dedupe, joins, predicates
from quarrystone.sources import snapshots


def values(spark, expr, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expr).collect()]


def stated(spark, lines):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "d int, pos int, line string")
    return facts.extract_facts(df, "d", "pos", "line").collect()


def classes(rows):
    out = {}
    for r in rows:
        out.setdefault(r.field, set()).add(r.level)
    return {f: next(iter(s)) if len(s) == 1 else "mixed" for f, s in out.items()}


def test_required_preferred_and_denied(spark):
    got = stated(spark, ["Required Qualifications:", "C++ development experience is required.", "U.S. citizenship is not required.", "Visa sponsorship isn’t required.", "Preferred Qualifications:", "Linux experience preferred."])
    assert classes(got) == {"skills": "mixed", "citizenship": "not_required", "work_authorization": "not_required"}
    assert [(r.level, r.technologies) for r in got if r.field == "skills"] == [("required", ["C++"]), ("preferred", ["Linux"])]


@pytest.mark.parametrize("mark", ["'", "’"])
def test_sections_open_and_end(spark, mark):
    got = stated(spark, [f"What we{mark}re looking for:", "Foundational knowledge of Python, SQL/PLSQL, Tableau, and Oracle (coursework or project experience acceptable).", "Strong communication skills and the ability to collaborate.", f"What you{mark}ll do:", "Build Python data pipelines."])
    skills = [r for r in got if r.field == "skills"]
    assert classes(got)["skills"] == "required" and skills[0].technologies == ["Python", "SQL", "Tableau", "Oracle"] and len(skills) == 2


def test_technologies_and_their_spellings(spark):
    find = lambda x: values(spark, facts.technologies_in(F.col("x")), [x])[0]
    assert find("Academic or project experience with React, C#/.NET, PostgreSQL, Node.js, GCP, and Jenkins.") == ["C#", "React", "Node.js", ".NET", "PostgreSQL", "GCP", "Jenkins"]
    assert find("finite element analysis, computational fluid dynamics, GD&T, Siemens NX, and FMEA; real-time operating system, ROS2") == ["Siemens NX", "FEA", "CFD", "GD&T", "FMEA", "ROS 2", "RTOS"]
    assert find("gitlab going rust category c-level") == [] and find("C++ and C") == ["C++", "C"] and find("") == []
    # words of other languages, plain words, single letters that name no language
    for x in ("çréoi réea èr", "résumé Ŕ", "You will go to the office. Go to room C.", "Spark new ideas, react quickly; excel in class", "plan C or b", "an oracle of snowflakes", "golangs", "C'est la vie et R’n’B"):
        assert find(x) == [], x
    assert find("Go, React and Spark required; MICROSOFT EXCEL") == ["Go", "React", "Excel", "Spark"]
    assert find("golang, react.js") == ["Go", "React"] and find("written in R") == ["R"] and find("C/C++ or R, with SQL") == ["C++", "C", "SQL", "R"] and find("Python–SQL") == ["Python", "SQL"]


def test_other_fields(spark):
    got = stated(spark, ["Requirements", "Applicants must be current sophomores or rising juniors.", "Graduating between May 2026 and June 2027.", "Lawful permanent resident or STEM OPT accepted.", "GPA of 3.0", "Punctual.", "Major in a related field."])
    assert {(r.field, r.ordinal) for r in got} == {("student_status", 1), ("graduation", 2), ("citizenship", 3), ("work_authorization", 3), ("other_eligibility", 4), ("other_eligibility", 5), ("major_fields", 6)}
    loose = stated(spark, ["About the company", "Hands-on experience with Docker.", "Build services in Go.", "At least 18 years old", "Ph.D. students welcome"])
    assert {(r.field, r.level, r.ordinal) for r in loose} == {("skills", "unspecified", 1), ("other_eligibility", "required", 3), ("education", "unspecified", 4)}


def test_schedule_evidence(spark):
    lines = ["Autumn 2027 or SUMMER 2028, autumn 2027", "A 10-week program for twelve months", "June 1 through August 15", "Applications due 3 Oct.", "May be"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "d int, pos int, line string")
    got = {(r.kind, r.value) for r in facts.schedule_evidence(df, "d", "pos", "line").collect()}
    assert got == {("term", "Fall 2027"), ("term", "Summer 2028"), ("duration", lines[1]), ("date_range", lines[2]), ("deadline", lines[3])}


def test_profile_evidence(spark):
    doc = "Jo Doe\nEDUCATION:\nLincoln High School diploma June 2022\nState University, B.S. in Computer Science, expected May 2026\nU.S. citizen, active secret clearance\nSkills\n• Python, Node.js\nProjects:\n- Built a rover\nok\n"
    got = {(r.kind, r.value) for r in facts.profile_evidence(spark.createDataFrame([(1, doc), (2, None), (3, "needs visa sponsorship; June 2024")], "d int, t string"), "d", "t").where("d = 1").collect()}
    assert got == {("graduation", "May 2026"), ("degree", "Bachelor of Science"), ("major", "Computer Science"), ("citizenship", "U.S. citizen"), ("work_authorization", "Authorized to work in the U.S. without sponsorship"), ("clearance", "Active Secret clearance"), ("skill", "Python"), ("skill", "Node.js"), ("section:skills", "Python, Node.js"), ("section:projects", "Built a rover")}


def test_pay_is_read_off_tokens(spark):
    cases = {
        "USD 25.50 to 30 per hour": (25.5, 30.0, "hour", "USD"), "Earn 401k, then €60,000–€70,000/year": (60000.0, 70000.0, "year", "EUR"), "$1k weekly": (1000.0, 1000.0, "week", "USD"), "pay 20 - CA$25 hourly": (20.0, 25.0, "hour", "CAD"),
        "A fixed stipend of US$ 5,000": (5000.0, 5000.0, "stipend", "USD"), "3000 fixed stipend": (3000.0, 3000.0, "stipend", "USD"), "25. per hour": None, "room 12 h": None, "10 to 12 people": None, "$700/hr": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: tuple(r.salary)[:4] if r.salary else None for r in pay.extract_pay(df, "t").collect()} == cases


def test_links_and_cleaning(spark):
    page = 'see https://c.example.com/x. [a](https://a.example.com/1) <a HREF="https://b.example.com/(2)?q=1">b</a> [a](https://a.example.com/1) src="https://no.example.com/3"'
    assert values(spark, text.links(F.col("x")), [page, None]) == [["https://a.example.com/1", "https://b.example.com/(2)?q=1", "https://c.example.com/x"], []]
    assert values(spark, text.clean_text(F.col("x")), ["| ![logo](l.png) [Acme](http://x) &amp; <b>Co</b><br/>NY <style>p</style> |", None, " a\n b "]) == ["Acme & Co / NY", "", "a b"]


def test_places(spark):
    cases = [("US - Remote", "Remote"), ("Texas - Remote Office", "Remote (TX)"), ("United States - California - San Jose", "San Jose, CA"), ("100 MAIN STREET NY", "Main Street, NY"), ("Boise, ID, USA", "Boise, ID"), ("Berlin", "Berlin"), ("", None)]
    assert values(spark, text.authoritative_place(F.col("x"), F.lit(False)), [c[0] for c in cases]) == [c[1] for c in cases]
    assert values(spark, text.authoritative_places(F.col("x")), [["Remote", "Ohio - Remote Office", "Boise, ID, US", "boise, id"]], "x array<string>") == [["Remote", "Boise, ID"]]
    labels = {("2 locations Austin, Texas", ()): "Austin, TX", ("US-CA-San Diego-123", ()): "San Diego, CA", ("NY01-02-ALBANY-x", ()): "Albany, NY", ("USA Remote", ()): "Remote", ("12 High St, Salem, OR", ()): "Salem, OR", ("Springfield", ("IL",)): "Springfield, IL", ("Springfield", ("IL", "MO")): "Springfield", ("US - Kansas City", ()): "Kansas City"}
    df = spark.createDataFrame([(i, r, list(f)) for i, (r, f) in enumerate(labels)], "i int, r string, f array<string>")
    assert [r[0] for r in df.orderBy("i").select(text.place_label(F.col("r"), F.col("f"))).collect()] == list(labels.values())
    assert values(spark, text.split_places(F.col("x")), ["A, NY; B | C / D"]) == [["A, NY", "B", "C", "D"]]
    df = spark.createDataFrame([("Albany, NY", ["CA"]), ("here", ["CA", "Remote"]), ("here", ["CA", "TX"]), (None, None)], "l string, m array<string>")
    assert [r[0] for r in df.select(text.reliable_states(F.col("l"), F.col("m"))).collect()] == [["NY"], ["CA"], [], []]


def test_areas_and_disciplines(spark):
    assert values(spark, classify.career_areas(F.col("x")), ["Avionics intern", "Data Analyst", "Machine Learning", "Cook"]) == [["engineering"], ["tech-business"], ["cs"], ["general"]]
    assert values(spark, classify.disciplines(F.col("x"), F.array(F.lit("nuclear"), F.lit("cs"))), ["Mechanical and robotics"]) == [["mechanical", "nuclear", "robotics"]]


def test_slugs_and_apply_pages(spark):
    urls = ["https://s.example.com/j/greenhouse-acme-co-42/", "https://s.example.com/lever-x-0a0b0c0d-1111-2222-3333-444455556666", "https://s.example.com/other-1", "https://else.example.com/greenhouse-a-1"]
    assert values(spark, identity.slug_url(F.col("x"), ["s.example.com"]), urls) == ["https://job-boards.greenhouse.io/acme-co/jobs/42", "https://jobs.lever.co/x/0a0b0c0d-1111-2222-3333-444455556666", None, None]
    assert values(spark, identity.apply_switch(F.col("x"), True), ["https://a/b/", "https://a/b/apply?x=1", None]) == ["https://a/b/apply", "https://a/b/apply?x=1", None]
    assert values(spark, identity.is_job_page(F.col("x")), ["https://t.wd5.myworkdayjobs.com/s/job/1", "https://t.wd5.myworkdayjobs.com/s/job/1/apply", "https://x/job/1"]) == [True, False, False]


def test_eligibility(spark):
    said = [(1, "graduation", "required", "Graduate no earlier than 2026."), (2, "graduation", "preferred", "between 2024 and 2025"), (3, "student_status", "required", "Rising seniors or sophomores"), (4, "citizenship", "required", "Must be a U.S. citizen"), (5, "graduation", "required", "class of 2027 by then")]
    cond = {r.p: r for r in scoring.posting_conditions(spark.createDataFrame(said, "p int, field string, level string, statement string"), "p").collect()}
    assert [tuple(w) for w in cond[1].windows.any] == [(2026, 9999)] and [tuple(w) for w in cond[2].windows.any] == [(2024, 2025)] and cond[2].windows.level == "preferred"
    assert sorted(cond[3].stages.any) == ["junior", "sophomore"] and cond[4].restrictive and [tuple(w) for w in cond[5].windows.any] == [(0, 2027)]
    years = [(y, date(2026, 9, 1)) for y in (2031, 2029, 2028, 2027, 2026)]
    df = spark.createDataFrame(years, "y int, d date")
    assert [r[0] for r in df.select(scoring.student_stage(F.col("y"), F.col("d"))).collect()] == ["freshman", "sophomore", "junior", "senior", "graduate"]


def fit_of(asked, held, worked, families):
    """Plain points of one posting for one profile: asked is a list of (level, words, technologies)."""
    sure = {s for s, k in held.items() if k == "supported"}
    first = lambda t: next((i for i, m in enumerate(families) if t in m), None)
    near = lambda t: first(t) is not None and any(o != t and first(o) == first(t) for o in sure)
    got = {k: set() for k in ("exact", "worked", "adjacent", "wanted", "wanted_adjacent", "cautious", "hard", "learnable")}
    for level, words, techs in asked:
        need = level == "required"
        learn, strong, exp = "familiarity" in words, "strong" in words, "experience" in words
        if need and "or" in words.split() and len(techs) > 1:
            hit = [t for t in techs if t in sure]
            if hit:
                got["exact"] |= set(hit)
                got["worked"] |= {t for t in hit if exp and t in worked}
            elif any(held.get(t) == "cautious" for t in techs):
                got["cautious"].add(next(t for t in techs if held.get(t) == "cautious"))
            elif any(map(near, techs)):
                got["adjacent"].add(next(t for t in techs if near(t)))
                if strong:
                    got["hard"].add(" / ".join(techs))
            else:
                got["learnable" if learn else "hard"].add(" / ".join(techs))
            continue
        for t in techs:
            if t in sure:
                got["exact" if need else "wanted"].add(t)
                if need and exp and t in worked:
                    got["worked"].add(t)
            elif need and held.get(t) == "cautious":
                got["cautious"].add(t)
            elif near(t):
                got["adjacent" if need else "wanted_adjacent"].add(t)
            elif need:
                got["learnable" if learn else "hard"].add(t)
    n = {k: len(v) for k, v in got.items()}
    needed = sum(a[0] == "required" for a in asked)
    signals = n["exact"] + n["adjacent"]
    bonus = 0
    if needed and signals and not n["hard"] + n["cautious"]:
        bonus = min(5, 3 + signals) if n["learnable"] else min(7, 4 + signals)
    gaps = min(10, sum([5, 3, *[2] * 50][: n["hard"]]))
    total = 18 + bonus + min(9, 3 * n["exact"]) + min(4, 2 * n["worked"]) + min(6, 1.5 * n["adjacent"]) + min(3, n["wanted"]) + min(2, 0.5 * n["wanted_adjacent"]) - min(3, n["cautious"]) - gaps
    return int(max(0, min(45, total)) + 0.5)


def test_evidence_fit_equals_plain_points(spark):
    rng = random.Random(15)
    techs = ["Python", "Java", "SQL", "Oracle", "AWS", "Azure", "Docker", "Excel", "Git"]
    words = ["experience with", "familiarity with", "strong", "", "familiarity or", "strong or", "experience or", "or"]
    postings = {p: [(rng.choice(["required", "required", "preferred", "unspecified"]), rng.choice(words), rng.sample(techs, rng.randint(1, 3))) for _ in range(rng.randint(1, 4))] for p in range(40)}
    profiles = {q: {t: rng.choice(["supported", "cautious"]) for t in rng.sample(techs, rng.randint(0, 5))} for q in range(4)}
    worked = {q: {t for t, k in h.items() if rng.random() < 0.5} for q, h in profiles.items()}
    fact_rows = [(p, "skills", level, f"{w} {i}", t) for p, asked in postings.items() for i, (level, w, t) in enumerate(asked)]
    f = spark.createDataFrame(fact_rows, "posting_id int, field string, level string, statement string, technologies array<string>")
    skill_rows = [(q, t, k) for q, h in profiles.items() for t, k in h.items()] + [(q, t, "worked") for q, w in worked.items() for t in w]
    s = spark.createDataFrame(skill_rows, "profile_id int, skill string, support string")
    pairs = spark.createDataFrame([(q, p) for q in profiles for p in [*postings, 99]], "profile_id int, posting_id int")
    academic = scoring.academic_support(f, spark.createDataFrame([(q, "", None) for q in profiles], "profile_id int, major string, degree string"), pairs)
    got = {(r.profile_id, r.posting_id): r.fit for r in scoring.evidence_fit(scoring.skill_evidence(f, s, pairs), academic, f, pairs).collect()}
    low = {q: {t.lower(): k for t, k in h.items()} for q, h in profiles.items()}
    want = {(q, p): fit_of([(lv, w, [t.lower() for t in ts]) for lv, w, ts in asked], low[q], {t.lower() for t in worked[q]}, list(scoring.FAMILIES.values())) for q in profiles for p, asked in postings.items()}
    assert got == want | {(q, 99): 19 for q in profiles}


def test_academic_support(spark):
    f = spark.createDataFrame([(1, "major_fields", "required", "Major in Computer Science"), (1, "education", "preferred", "Bachelor degree"), (2, "major_fields", "required", "Physics")], "posting_id int, field string, level string, statement string")
    who, pairs = spark.createDataFrame([(7, "computer science", "bachelor")], "profile_id int, major string, degree string"), spark.createDataFrame([(7, 1), (7, 2), (7, 3)], "profile_id int, posting_id int")
    assert {r.posting_id: (r.bonus, r.met, r.open, r.asked) for r in scoring.academic_support(f, who, pairs).collect()} == {1: (4, 1, 0, 1), 2: (0, 0, 1, 1)}


def test_hits_of_a_batch_come_in_parts(spark):
    from quarrystone.functions.phrases import AT_ONCE, Phrases

    book = Phrases({"tool": ["Python", "SQL"]})
    texts = [None if i % 97 == 0 else "" if i % 89 == 0 else "Python and SQL. " * (i % 400) for i in range(2000)] + ["SQL " * AT_ONCE]
    parts = list(book.found(iter([pd.Series(texts), pd.Series([], dtype=object), pd.Series(["SQL"])])))
    assert [h for part in parts for h in part] == [book.find(t) if t else [] for t in [*texts, "SQL"]]
    sizes, at = [], 0
    for part in parts:
        sizes.append(sum(len(t or "") for t in [*texts, "SQL"][at : at + len(part)][:-1]))
        at += len(part)
    assert max(sizes) < AT_ONCE and len(parts) > 5
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:2000])], "i int, t string").repartition(1)
    got = {r.i: r.n for r in rows.select("i", F.size(book.hits(F.col("t"))).alias("n")).collect()}
    assert got == {i: len(book.find(t)) if t else 0 for i, t in enumerate(texts[:2000])}


def test_qualification_fit_judges_each_set_of_skills_once(spark):
    rng = random.Random(33)
    facts = [(i, rng.choice(["required", "preferred", None]), rng.choice([*"abcdef", None])) for i in range(40) for _ in range(rng.randint(1, 4))] + [(i, "required", "a") for i in range(100, 160)]
    skills = [(q, rng.choice("abcdef"), rng.choice(["supported", "cautious"])) for q in range(6) for _ in range(2)]
    kin = {"a": "x", "b": "x", "c": "y", "d": "y", "e": "z"}
    want = {}
    for q in range(6):
        sure = {k: any(h == "supported" for p, s, h in skills if (p, s) == (q, k)) for p, k, _ in skills if p == q}
        near = {k for k, f in kin.items() if f in {kin.get(s) for s in sure}}
        for g in {g for g, _, _ in facts}:
            asked = {}
            for x, level, k in facts:
                if x == g:
                    asked[k] = asked.get(k) or level == "required"
            got = {k: max((4.0 if r else 3.0) / (1 if sure[k] else 2) if k in sure else 0.0, 1.0 if k in near else 0.0) for k, r in asked.items() if k in sure or k in near}
            if got:
                want[q, g] = max(0.0, min(45.0, 20 + sum(got.values()) - min(12.0, 3.0 * (sum(bool(r) for r in asked.values()) - sum(bool(asked[k]) for k in got)))))
    f, s = spark.createDataFrame(facts, "posting_id long, level string, technology string"), spark.createDataFrame(skills, "profile_id long, skill string, support string")
    fam = spark.createDataFrame(list(kin.items()), "skill string, family string")
    every = scoring.qualification_fit(f, s, fam)
    pairs = spark.createDataFrame([(q, g) for q, g in itertools.product(range(6), range(0, 160, 3))], "profile_id long, posting_id long")
    assert {(r.profile_id, r.posting_id): r.fit for r in every.collect()} == want
    assert {(r.profile_id, r.posting_id): r.fit for r in scoring.qualification_fit(f, s, fam, pairs=pairs).collect()} == {k: v for k, v in want.items() if k[1] % 3 == 0}
    # no aggregation is over pairs of profile and posting
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[(?:profile_id#\d+L, posting_id#|posting_id#\d+L, profile_id#)", plan)


def test_similarity_join_equals_all_pairs(spark):
    rng = random.Random(20)
    words = ["data", "software", "intern", "engineer", "summer", "analyst", "2026", "remote"]
    title = lambda: " ".join(rng.sample(words, rng.randint(2, 5)))
    place = lambda: rng.choice(["Albany, NY", "Albany", "Boston", "Bostonn", None, ""])
    a, b = [(i, rng.choice("ef"), title(), place()) for i in range(50)], [(i, rng.choice("ef"), title(), place()) for i in range(90)]

    def like(x, y):
        return SequenceMatcher(a=x, b=y).ratio() if x and y else 0.0

    def near(x, y):
        x, y = (re.sub("[^a-z0-9]+", " ", (v or "").lower()).strip() for v in (x, y))
        if not x or not y or x == y:
            return float(bool(x) and x == y)
        return 0.96 if set(x.split()) <= set(y.split()) or set(y.split()) <= set(x.split()) else like(x, y)

    want = {}
    for (i, e, t, p), (j, g, u, q) in itertools.product(a, b):
        score = 0.78 * like(t, u) + 0.22 * near(p, q)
        if e == g and score >= coverage.LIKELY:
            want[i, j] = round(score, 9)
    df = lambda rows, name: spark.createDataFrame(rows, f"{name} int, emp string, title string, location string")
    got = {(r.d, r.p): round(r.score, 9) for r in coverage.similarity_join(df(a, "d"), df(b, "p"), "emp", "d", "p").collect()}
    assert got == want and len(want) > 10


def test_reconcile_merges_fields(spark):
    t = lambda d: datetime(2026, 1, d, tzinfo=timezone.utc)
    schema = "id string, company string, title string, location string, url string, link_kind string, link_status string, posted_at timestamp, first_seen timestamp, last_seen timestamp, source_keys array<string>, direct_employer boolean, term string"
    rows = [
        ("a", "Acme Inc", "Intern", "NY", "https://x.example.com/jobs/12345678", "direct", "dead", t(1), t(1), t(2), ["s1"], False, None),
        ("b", "Acme", "Intern II", "Albany", "https://x.example.com/jobs/12345678?utm_source=q", "direct", "ok", t(3), t(2), t(5), ["s2", "s1"], True, ""),
        ("c", "acme inc", "intern", "ny", "https://X.example.com/jobs/12345678/", "direct", None, None, None, None, ["s3"], None, "Summer 2027"),
        ("d", "Other", "Role", "NY", "https://y.example.com/careers", "direct", None, t(1), t(1), None, ["s"], False, None), ("e", "Other", "role", "NY", "https://y.example.com/careers", "direct", None, t(2), t(1), None, ["s"], False, None),
        ("f", "Third", "role", "NY", "https://y.example.com/careers", "listing", None, t(2), t(1), None, ["s"], False, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.id: r for r in dedupe.reconcile(df, dedupe.reconciliation_identity(df), fill=["term"]).collect()}
    assert {k: r.merged for k, r in got.items()} == {"b": 3, "e": 2, "f": 1}
    b = got["b"]
    assert (b.company, b.title, b.link_status, b.term, b.source_keys) == ("Acme", "Intern II", "ok", "Summer 2027", ["s1", "s2", "s3"])
    assert [x.day for x in (b.posted_at, b.first_seen, b.last_seen)] == [3, 1, 5]


def test_browse_near_a_point(spark):
    p = spark.createDataFrame([(1, ["NY"]), (2, ["CA"]), (3, ["Remote"])], "id int, states array<string>")
    points = spark.createDataFrame([(1, 42.65, -73.75), (2, 34.05, -118.24)], "id int, latitude double, longitude double")
    assert {r.id for r in predicates.browse(p, near=(points, 42.7, -73.8, 25.0)).collect()} == {1, 3}


def test_board_payloads_admit(spark):
    raw = [("greenhouse", "acme", '{"id": 5, "title": "Software Intern", "location": {"name": "Austin, TX"}}'), ("ashby", "acme", '{"id": "u", "title": "AI Fellow", "location": "Paris", "secondaryLocations": [{"location": "Remote, United States"}]}'), ("lever", "acme", '{"id": "z", "text": "Data Intern", "country": "US"}'), ("lever", "acme", '{"id": "y", "text": "Data Lead", "country": "US"}'), ("lever", "acme", "nonsense"), ("oracle", "b", '{"Id": "1", "Title": "IT trainee", "PrimaryLocation": "Rome"}')]
    got = {(r.provider, r.native_id, r.url) for r in snapshots.board_payloads(spark.createDataFrame(raw, "provider string, board string, body string"), admit=True).collect()}
    assert got == {("greenhouse", "5", "https://job-boards.greenhouse.io/acme/jobs/5"), ("ashby", "u", "https://jobs.ashbyhq.com/acme/u"), ("lever", "z", "https://jobs.lever.co/acme/z")}


def test_provider_rows_of_one_url_are_one(spark):
    cols = "id string, url string, company string, source_keys array<string>, posted_at timestamp, direct_employer boolean, term string"
    t = datetime(2026, 1, 1, tzinfo=timezone.utc)
    base = spark.createDataFrame([("1", "https://x/1", "A", ["m"], t, False, None)], cols)
    new = spark.createDataFrame([("9", "https://x/1?utm_source=z", "B", ["p"], t, True, "T", 0), ("8", "https://x/8", "C", ["p"], t, False, None, 1), ("7", "https://x/8/", "D", ["q"], t, False, "U", 0)], cols + ", priority int")
    got = {r.id: (r.company, r.source_keys, r.term) for r in joins.merge_providers(base, new, ["term"], ["source_keys"]).collect()}
    assert got == {"1": ("B", ["m", "p"], "T"), "7": ("D", ["p", "q"], "U")}


def test_a_gate_that_need_not_be_measured_passes(spark):
    from quarrystone.operators.aggregates import gates

    m = spark.createDataFrame([(5.0, None)], "a double, b double")
    got = {r.gate: (r.measurable, r.passed, r.ready) for r in gates(m, {"a": ("min", 3), "b": ("max", 1)}, {"b": False}).collect()}
    assert got == {"a": (True, True, True), "b": (True, True, True)}
    assert not any(r.ready for r in gates(m, {"a": ("min", 3), "b": ("max", 1)}).collect())


def test_places_of_many_words(spark):
    cities = spark.createDataFrame([("IL", "Lake in the Hills", 42.2, -88.3, True), ("IL", "Crystal Lake", 42.2, -88.3, True), ("TX", "The Hills", 30.3, -98.0, True), ("NV", "Lake", 1.0, 1.0, False), ("NY", "York", 2.0, 2.0, True)], "state string, city string, latitude double, longitude double, unique_name boolean")
    zips = spark.createDataFrame([], "zip_code string, latitude double, longitude double")
    said = ["Office near Lake in the Hills", "near Crystal Lake", "lake in the valley", "the hills", "Hills of Lake in the Hills and York", "new york, york", "", None]
    rows = joins.resolve_places(spark.createDataFrame(list(enumerate(said)), "id int, value string"), zips, cities).collect()
    assert {r.id: (r.tier, r.latitude) for r in rows} == {0: (4, 42.2), 1: (4, 42.2), 3: (3, 30.3), 4: (4, 42.2), 5: (4, 2.0)}
