"""Score components of a posting for a profile, and their sum under a contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.facts import plain, says
from quarrystone.functions.phrases import Phrases, has
from quarrystone.functions.text import skill_key

#: component: (role, maximum). The maxima of ranking components sum to 100.
CONTRACT = {"fit": ("ranking", 45), "freshness": ("ranking", 10), "roi": ("ranking", 25), "location": ("ranking", 20), "eligibility": ("gate", 0), "link": ("metadata", 0)}
#: Age in days and the score it earns; between them the score runs straight.
FRESHNESS = ((0, 10), (2, 10), (7, 8), (14, 6), (30, 3), (60, 1), (90, 0))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def freshness(age_days: Column, anchors=FRESHNESS, unknown: int = 3) -> Column:
    age = F.greatest(F.lit(0.0), age_days.cast("double"))
    out = F.lit(0)
    for (a, x), (b, y) in reversed(list(zip(anchors, anchors[1:], strict=False))):
        out = F.when(age <= b, half_up(x + (y - x) * (F.greatest(F.lit(float(a)), age) - a) / (b - a))).otherwise(out)
    return F.when(age_days.isNull(), unknown).otherwise(out).cast("int")


def gate(checks: list[tuple[str, Column]]) -> Column:
    """The first reason that excludes a pair, null if none does. A check that is unknown does not exclude."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(reason)) for reason, bad in checks])


# --- fixed values -----------------------------------------------------------
STAGES = ["freshman", "sophomore", "junior", "senior", "graduate"]
STAGE_WORDS = {"freshman": ["freshman", "freshmen"], "sophomore": ["sophomore", "sophomores"], "junior": ["junior", "juniors"], "senior": ["senior", "seniors"], "graduate": ["graduate", "graduates"]}
FROM_YEAR, TO_YEAR = ["after", "no earlier than"], ["before", "by", "no later than"]
RESTRICTIVE = ["us citizen", "us person", "united states citizen", "united states person", "authorized to work", "does not sponsor", "will not sponsor", "no sponsorship"]
#: Points: explicit undergraduate level and any other; type; term that fits and one that may; open applications; graduation; authorization held and lacking.
UNDERGRAD, ANY_LEVEL, TYPE, TERM, MAYBE_TERM, OPEN, GRADUATION, AUTHORIZED, SPONSORED, MOST_ELIGIBILITY = 6, 4, 7, 7, 4, 1, {"required": 2, "preferred": 1}, 2, -6, 20
LEARNABLE = ["familiarity", "familiar", "interest", "exposure", "foundational", "basic understanding", "working knowledge", "coursework", "academic", "project experience", "school project", "willingness to learn", "eager to learn"]
STRONG = ["strong", "proficient", "proficiency", "advanced", "expert", "expertise", "deep understanding", "firm grasp", "solid grasp", "demonstrated", "hands on", "professional", "production"]
EXPERIENCED = ["experience", "experienced", "professional", "production", "hands on", "prior", "previous"]
FAMILIES = {
    "programming": ["c", "c++", "c#", "java", "python", "go", "rust"], "web": ["javascript", "typescript", "react", "node.js"], "data": ["sql", "postgresql", "mysql", "oracle", "snowflake", "databricks", "spark", "r"],
    "cloud": ["aws", "azure", "gcp"], "containers": ["docker", "kubernetes"], "os": ["linux", "unix"], "ci": ["jenkins", "gitlab ci", "github actions"], "analytics": ["tableau", "power bi", "excel", "r", "sql"],
}
#: Fit: where it starts, and without evidence; points per skill and their limits.
BASE_FIT, NEUTRAL_FIT, MOST_FIT = 18, 19, 45
EXACT, WORKED, ADJACENT, EXACT_PREFERRED, ADJACENT_PREFERRED, CAUTIOUS = (3, 9), (2, 4), (1.5, 6), (1, 3), (0.5, 2), (1, 3)
MAJOR, DEGREE, MOST_ACADEMIC = {"required": 3, "preferred": 2}, {"required": 2, "preferred": 1}, 5
# ----------------------------------------------------------------------------


def student_stage(graduation_year: Column, today: Column) -> Column:
    """The stage of a student who graduates in a year; academic years begin in July."""
    left = graduation_year - (F.year(today) - F.when(F.month(today) >= 7, 0).otherwise(1))
    return F.when(left >= 4, "freshman").when(left == 3, "sophomore").when(left == 2, "junior").when(left == 1, "senior").when(left <= 0, "graduate")


def graduation_window(statement: Column) -> Column:
    """struct<first, last> of the years that a statement admits; null if it names none."""
    years = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(statement, F.lit(r"\b20\d{2}\b"), F.lit(0)), lambda y: y.cast("int"))))
    p, low, high = plain(statement), F.get(years, F.lit(0)), F.get(years, F.size(years) - 1)
    single = F.size(years) == 1
    first = F.when(single & ~says(p, FROM_YEAR) & says(p, TO_YEAR), 0).otherwise(low)
    last = F.when(single & says(p, FROM_YEAR), 9999).otherwise(high)
    return F.when(F.size(years) > 0, F.struct(first.cast("int").alias("first"), last.cast("int").alias("last")))


def admitted_stages(statement: Column) -> Column:
    """Stages that a statement admits; who is to rise to a stage is still at the one before."""
    p = plain(statement)
    out = []
    for before, stage in zip([None, *STAGES], STAGES, strict=False):
        rising = says(p, [f"rising {w}" for w in STAGE_WORDS[stage]]) if stage in STAGES[1:4] else F.lit(False)
        out += [F.when(says(p, STAGE_WORDS[stage]) & ~rising, F.lit(stage)), F.when(rising, F.lit(before))]
    return F.array_distinct(F.array_compact(F.array(*out)))


def posting_conditions(facts: DataFrame, posting: str) -> DataFrame:
    """``(posting, windows, stages, restrictive)`` from facts(posting, field, level, statement): per posting the graduation windows and stages it
    requires (or prefers, where it requires none), with that level, and whether it restricts who may work."""
    asked = facts.where(F.col("level").isin("required", "preferred") & F.col("field").isin("graduation", "student_status", "citizenship", "work_authorization"))
    window, stages = graduation_window(F.col("statement")), admitted_stages(F.col("statement"))

    def kept(field: str, value: Column, level: str) -> Column:
        return F.array_compact(F.collect_set(F.when((F.col("field") == field) & (F.col("level") == level), value)))

    restrictive = F.col("field").isin("citizenship", "work_authorization") & (F.col("level") == "required") & says(plain(F.col("statement")), RESTRICTIVE)
    per = asked.withColumns({"_w": window, "_s": F.when(F.size(stages) > 0, stages)}).groupBy(posting).agg(
        *[kept("graduation", F.col("_w"), level).alias(f"w_{level}") for level in GRADUATION], *[kept("student_status", F.col("_s"), level).alias(f"s_{level}") for level in GRADUATION],
        F.max(restrictive).alias("restrictive"),
        *[F.max((F.col("field") == f) & (F.col("level") == "required")).alias(f"r_{f}") for f in ("graduation", "student_status")],
    )
    level = lambda f: F.when(F.col(f"r_{f}"), "required").otherwise("preferred")
    pick = lambda c, f: F.when(F.col(f"r_{f}"), F.col(f"{c}_required")).otherwise(F.col(f"{c}_preferred"))
    return per.select(
        posting, F.struct(level("graduation").alias("level"), pick("w", "graduation").alias("any")).alias("windows"),
        F.struct(level("student_status").alias("level"), F.flatten(pick("s", "student_status")).alias("any")).alias("stages"), "restrictive",
    )


#: Clearances from least to most; an active one satisfies those below it.
CLEARANCES = ["none", "eligible", "secret", "top secret"]
_ASKED = Phrases({"clearance": ["clearance"], "standing": ["active", "existing", "current"], "having": ["already", "possess", "hold", "held"], "top secret": ["top secret", "ts/sci"], "secret": ["secret"]})
_HELD = Phrases({"none": ["no", "none", "without", "not cleared"], "eligible": ["eligible to obtain", "able to obtain", "ability to obtain"], "standing": ["active", "current", "existing"], "top secret": ["top secret", "ts/sci"], "secret": ["secret"]})
UNVERIFIED = 5


def _rank(hits: Column) -> Column:
    return F.when(has(hits, "top secret"), CLEARANCES.index("top secret")).when(has(hits, "secret"), CLEARANCES.index("secret"))


def asked_clearances(facts: DataFrame, posting: str) -> DataFrame:
    """``(posting, clearance)`` of facts(posting, field, level, statement) that require one to be held: struct<rank, standing>, the highest rank (null: any) and whether it must be active now."""
    asked = facts.where("field = 'other_eligibility' and level = 'required'").withColumn("_h", _ASKED.hits(plain(F.col("statement"))))
    asked = asked.where(has(F.col("_h"), "clearance") & has(F.col("_h"), "standing", "having"))
    return asked.groupBy(posting).agg(F.struct(F.max(_rank(F.col("_h"))).alias("rank"), F.max(has(F.col("_h"), "standing")).alias("standing")).alias("clearance"))


def held_clearance(text: Column) -> Column:
    """struct<none, eligible, standing, rank> of what a profile says of its clearance; null if it says nothing."""
    h = _HELD.hits(plain(text))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.struct(has(h, "none").alias("none"), has(h, "eligible").alias("eligible"), has(h, "standing").alias("standing"), _rank(h).alias("rank")))


def clearance_gate(asked: Column, held: Column) -> Column:
    """struct<excluded, penalty>: a posting that asks for a clearance excludes who has none, and who may only obtain one where an active one is asked; one that is not known to be active and high enough costs points."""
    enough = held["standing"] & (asked["rank"].isNull() | F.coalesce(held["rank"] >= asked["rank"], F.lit(False)))
    out = lambda excluded, penalty: F.struct(F.lit(excluded).alias("excluded"), F.lit(penalty).alias("penalty"))
    return (
        F.when(asked.isNull(), out(False, 0)).when(held.isNull(), out(False, UNVERIFIED)).when(held["none"] | (held["eligible"] & asked["standing"]), out(True, 0))
        .when(enough, out(False, 0)).otherwise(out(False, UNVERIFIED))
    )


def eligibility(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``reason`` (why a profile is excluded from a posting, null if it is not) and ``eligibility``, 0 to 20.

    Of the posting: available (boolean), opportunity_type, education_level, term, stated_terms
    (array), windows, stages, restrictive (see ``posting_conditions``). Of the profile:
    allowed_types (array), graduate_only (boolean, whether it takes such postings),
    target_term, graduation_year, stage, authorized, needs_sponsorship. Unknown values do
    not exclude. Where there are clearance (see ``asked_clearances``) and held (``held_clearance``),
    they are a gate too.
    """
    c = F.col
    known = lambda x: F.coalesce(x, F.lit(False))
    target, term = F.lower(F.trim(c("target_term"))), F.lower(F.trim(c("term")))
    stated = F.transform(F.coalesce("stated_terms", F.expr("CAST(array() AS array<string>)")), lambda x: F.lower(x))
    no_target, is_stated = F.coalesce(target, F.lit("")) == "", F.size(stated) > 0
    year = F.regexp_extract(target, r"(20\d{2})$", 1)
    term_points = (
        F.when(no_target, TERM).when(is_stated, F.when(F.array_contains(stated, target), TERM)).when(term == target, TERM)
        .when(F.coalesce(term, F.lit("")) == "", MAYBE_TERM).when(term == year, MAYBE_TERM)
    )
    windows = F.exists(c("windows.any"), lambda w: (c("graduation_year") >= w["first"]) & (c("graduation_year") <= w["last"]))
    asks_year = known(F.size(c("windows.any")) > 0) & c("graduation_year").isNotNull()
    asks_stage = known(F.size(c("stages.any")) > 0) & c("stage").isNotNull()
    checks = [
        ("unavailable", c("available") == F.lit(False)), ("graduate_only", (c("education_level") == "graduate-only") & ~known(c("graduate_only"))),
        ("type", (F.size("allowed_types") > 0) & ~F.array_contains("allowed_types", c("opportunity_type"))), ("term", term_points.isNull()),
        ("graduation", asks_year & (c("windows.level") == "required") & ~windows), ("stage", asks_stage & (c("stages.level") == "required") & ~F.array_contains("stages.any", c("stage"))),
    ]
    if {"clearance", "held"} <= set(pairs.columns):
        checks.append(("clearance", clearance_gate(c("clearance"), c("held"))["excluded"]))
    year_points = F.when(asks_year & windows, F.when(c("windows.level") == "required", GRADUATION["required"]).otherwise(GRADUATION["preferred"])).otherwise(0)
    work_points = F.when(known(c("restrictive")), F.when(known(c("authorized")), AUTHORIZED).when(known(c("needs_sponsorship")), SPONSORED).otherwise(0)).otherwise(0)
    total = F.when(c("education_level") == "undergrad", UNDERGRAD).otherwise(ANY_LEVEL) + TYPE + F.coalesce(term_points, F.lit(0)) + F.when(known(c("available")), OPEN).otherwise(0) + year_points + work_points
    out = pairs.withColumn("reason", gate(checks))
    return out.withColumn("eligibility", F.when(c("reason").isNull(), F.greatest(F.lit(0), F.least(F.lit(MOST_ELIGIBILITY), total))).otherwise(0).cast("int"))


def canonical_skill(c: Column) -> Column:
    """Key of a skill under its usual name."""
    aliases = {"cpp": "c++", "c plus plus": "c++", "csharp": "c#", "c sharp": "c#", "js": "javascript", "ts": "typescript", "golang": "go", "nodejs": "node.js", "postgres": "postgresql"}
    key = skill_key(c)
    out = key
    for alias, name in aliases.items():
        out = F.when(key == alias, F.lit(name)).otherwise(out)
    return out


def skill_evidence(facts: DataFrame, skills: DataFrame, pairs: DataFrame, families: dict[str, list[str]] = FAMILIES) -> DataFrame:
    """``(profile_id, posting_id, skill, kind, required)``: how a profile meets each skill that a posting asks for.

    facts: posting_id, level, statement, technologies. skills: profile_id, skill, support
    (``supported``, ``cautious``, ``worked`` or ``studied``). ``pairs``: the
    (profile_id, posting_id) to judge, those that the gates left. kind: ``exact``,
    ``worked`` (exact, and asked and held as experience), ``cautious``, ``adjacent`` (another skill of the
    family), ``learnable`` or ``hard``; the last two are gaps. Of required alternatives
    ("x or y") the best one counts alone.
    """
    asked = facts.where("level in ('required', 'preferred', 'unspecified') and size(technologies) > 0").withColumn("_p", plain(F.col("statement"))).select(
        "posting_id", (F.col("level") == "required").alias("required"), F.array_distinct(F.transform("technologies", canonical_skill)).alias("_t"), F.xxhash64("posting_id", "level", "statement").alias("fact"),
        says(F.col("_p"), LEARNABLE).alias("learnable"), says(F.col("_p"), STRONG).alias("strong"), says(F.col("_p"), EXPERIENCED).alias("worked"), says(F.col("_p"), ["or", "either"]).alias("_or"),
    ).distinct()
    asked = asked.withColumn("choice", F.col("required") & F.col("_or") & (F.size("_t") > 1)).withColumn("group", F.array_join("_t", " / ")).select("*", F.posexplode("_t").alias("at", "skill")).drop("_t", "_or")
    member = F.lit(None).cast("string")
    for name, members in reversed(families.items()):
        member = F.when(F.col("skill").isin(members), F.lit(name)).otherwise(member)
    held = skills.withColumn("skill", canonical_skill(F.col("skill"))).groupBy("profile_id", "skill").agg(*[F.max(F.col("support") == s).alias(f"_{s}") for s in ("supported", "cautious", "worked", "studied")])
    kin = held.where("_supported").withColumn("_family", member).where("_family is not null").groupBy("profile_id", "_family").agg(F.collect_set("skill").alias("_kin"))
    rows = pairs.select("profile_id", "posting_id").distinct().join(asked.withColumn("_family", member), "posting_id")
    rows = rows.join(held, ["profile_id", "skill"], "left").join(kin, ["profile_id", "_family"], "left")
    has = lambda s: F.coalesce(F.col(f"_{s}"), F.lit(False))
    adjacent = F.coalesce(F.size(F.array_except("_kin", F.array("skill"))) > 0, F.lit(False))
    kind = F.when(has("supported"), "exact").when(F.col("required") & has("cautious"), "cautious").when(adjacent, "adjacent").when(F.col("required"), F.when(F.col("learnable"), F.when(~has("studied"), "learnable")).otherwise("hard"))
    rows = rows.select("profile_id", "posting_id", "fact", "group", "at", "skill", "required", "choice", "strong", "learnable", has("studied").alias("studied"), (has("supported") & F.col("worked") & F.col("required") & has("worked")).alias("worked"), kind.alias("kind"))
    single = rows.where("not choice")
    # alternatives: all exact ones, else one cautious, else the first adjacent, else one gap for all of them
    order = F.when(F.col("kind") == "exact", 0).when(F.col("kind") == "cautious", 1).when(F.col("kind") == "adjacent", 2).otherwise(3)
    w = Window.partitionBy("profile_id", "posting_id", "fact")
    chosen = rows.where("choice").withColumn("_o", order).withColumn("_best", F.min("_o").over(w)).withColumn("_any", F.max("studied").over(w)).where("_o = _best").withColumn("_n", F.row_number().over(w.orderBy("at"))).where("_best = 0 or _n = 1")
    chosen = chosen.withColumn("kind", F.when(F.col("_best") == 3, F.when(F.col("learnable"), F.when(~F.col("_any"), "learnable")).otherwise("hard")).otherwise(F.col("kind"))).withColumn("skill", F.when(F.col("_best") == 3, F.col("group")).otherwise(F.col("skill")))
    too_weak = chosen.where("kind = 'adjacent' and strong").withColumns({"kind": F.lit("hard"), "skill": F.col("group")})
    cols = ["profile_id", "posting_id", "skill", "kind", "required"]
    every = single.unionByName(chosen.select(single.columns)).unionByName(too_weak.select(single.columns)).where("kind is not null")
    return every.select(cols).unionByName(every.where("worked").withColumn("kind", F.lit("worked")).select(cols)).distinct()


def academic_support(facts: DataFrame, profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(profile_id, posting_id, bonus, met, open, asked)`` from required (else preferred) majors and degrees; profiles: profile_id, major, degree (``bachelor``, ``master``...)."""
    about = facts.where("field in ('major_fields', 'education') and level in ('required', 'preferred')").select("posting_id", "field", "level", skill_key(F.col("statement")).alias("_s")).distinct()
    rows = pairs.select("profile_id", "posting_id").distinct().join(about, "posting_id").join(profiles.select("profile_id", skill_key(F.col("major")).alias("_m"), F.lower("degree").alias("_d")), "profile_id")
    has = F.when(F.col("field") == "major_fields", (F.col("_m") != "") & F.contains(F.col("_s"), F.col("_m"))).otherwise(F.coalesce(F.contains(F.col("_s"), F.col("_d")), F.lit(False)))
    per = rows.withColumn("_has", has).groupBy("profile_id", "posting_id", "field").agg(*[F.count_if(F.col("level") == x).alias(f"n_{x}") for x in MAJOR], *[F.coalesce(F.max(F.when(F.col("level") == x, F.col("_has"))), F.lit(False)).alias(f"has_{x}") for x in MAJOR])
    points = lambda x: F.when(F.col("field") == "major_fields", MAJOR[x]).otherwise(DEGREE[x])
    bonus = F.when(F.col("n_required") > 0, F.when(F.col("has_required"), points("required")).otherwise(0)).otherwise(F.when(F.col("has_preferred"), points("preferred")).otherwise(0))
    return per.groupBy("profile_id", "posting_id").agg(F.least(F.lit(MOST_ACADEMIC), F.sum(bonus)).alias("bonus"), F.count_if((F.col("n_required") > 0) & F.col("has_required")).alias("met"), F.count_if((F.col("n_required") > 0) & ~F.col("has_required")).alias("open"), F.sum("n_required").alias("asked"))


def evidence_fit(evidence: DataFrame, academic: DataFrame, facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(profile_id, posting_id, fit)``, 0 to 45, of all ``pairs``: neutral for postings without facts, else points for skills met less those for gaps, and a bonus where all that is required is met."""
    n = lambda kind, required=None: F.count_if((F.col("kind") == kind) & (F.lit(True) if required is None else F.col("required") == required))
    counts = evidence.groupBy("profile_id", "posting_id").agg(
        n("exact", True).alias("exact"), n("worked").alias("worked"), n("adjacent", True).alias("adjacent"), n("exact", False).alias("wanted"), n("adjacent", False).alias("wanted_adjacent"),
        n("cautious").alias("cautious"), n("hard").alias("hard"), n("learnable").alias("learnable"),
    )
    inspected = facts.groupBy("posting_id").agg(F.count_if((F.col("field") == "skills") & (F.col("level") == "required")).alias("skill_facts"))
    rows = pairs.select("profile_id", "posting_id").distinct().join(inspected, "posting_id", "left").join(counts, ["profile_id", "posting_id"], "left").join(academic, ["profile_id", "posting_id"], "left")
    c = lambda x: F.coalesce(F.col(x), F.lit(0))
    capped = lambda x, rule: F.least(F.lit(float(rule[1])), c(x) * float(rule[0]))
    signals = c("exact") + c("adjacent") + c("met")
    covered = (c("skill_facts") + c("asked") > 0) & (signals > 0) & (c("hard") + c("cautious") + c("open") == 0)
    bonus = F.when(covered, F.when(c("learnable") > 0, F.least(F.lit(5), 3 + signals)).otherwise(F.least(F.lit(7), 4 + signals))).otherwise(0)
    gaps = F.least(F.lit(10), F.when(c("hard") >= 1, 5).otherwise(0) + F.when(c("hard") >= 2, 3).otherwise(0) + 2 * F.greatest(F.lit(0), c("hard") - 2))
    total = BASE_FIT + c("bonus") + bonus + capped("exact", EXACT) + capped("worked", WORKED) + capped("adjacent", ADJACENT) + capped("wanted", EXACT_PREFERRED) + capped("wanted_adjacent", ADJACENT_PREFERRED) - capped("cautious", CAUTIOUS) - gaps
    return rows.select("profile_id", "posting_id", F.when(F.col("skill_facts").isNull(), NEUTRAL_FIT).otherwise(half_up(F.greatest(F.lit(0.0), F.least(F.lit(float(MOST_FIT)), total)))).cast("int").alias("fit"))


def qualification_fit(facts: DataFrame, skills: DataFrame, families: DataFrame, base: int = 20, pairs: DataFrame | None = None) -> DataFrame:
    """``(profile_id, posting_id, fit)`` from technologies asked for and skills held.

    facts: posting_id, level, technology. skills: profile_id, skill, support (``supported``
    or ``cautious``). families: skill -> family; a skill of the same family is adjacent.
    Exact skills earn 4 when required and 3 otherwise, cautious ones half, adjacent ones
    1; a required gap costs 3, and costs stop at 12. Pairs meet on skills or families only,
    which most do; so give the ``pairs`` (profile_id, posting_id) that gates have left:
    then only they are looked at. Each distinct set of skills meets a profile once.
    """
    each = facts.where("posting_id is not null").groupBy("posting_id", F.col("technology").alias("skill")).agg(F.max(F.col("level") == "required").alias("required"))
    asked = each.groupBy("posting_id").agg(F.sort_array(F.collect_list(F.struct("skill", "required"))).alias("asked"))
    # what a profile has to offer for each skill: the skill itself, or one of its family
    held = skills.groupBy("profile_id", "skill").agg(F.max(F.col("support") == "supported").alias("sure"))
    kin = skills.join(families, "skill").select("profile_id", "family").distinct().join(families, "family").select("profile_id", "skill", F.lit(1.0).alias("adjacent")).distinct()
    offer = held.join(kin, ["profile_id", "skill"], "full_outer")
    # postings that ask the same are judged once: what is summed up grows with distinct sets of skills, not with postings
    given = None if pairs is None else pairs.select("profile_id", "posting_id").distinct().join(asked, "posting_id")
    sets = asked.select("asked").distinct() if given is None else given.select("profile_id", "asked").distinct()
    rows = sets.select("*", F.inline("asked")).join(offer, ["skill"] if given is None else ["profile_id", "skill"])
    worth = F.when(F.col("required"), 4.0).otherwise(3.0)
    points = F.greatest(F.when(F.col("sure"), worth).when(~F.col("sure"), worth / 2), F.col("adjacent"))
    got = rows.groupBy("profile_id", "asked").agg(F.sum(points).alias("earned"), F.count_if("required").alias("met"))
    needed = F.size(F.filter("asked", lambda x: x["required"]))
    gap = F.least(F.lit(12.0), (needed - F.col("met")) * 3.0)
    fits = got.select("profile_id", "asked", F.greatest(F.lit(0.0), F.least(F.lit(45.0), base + F.col("earned") - gap)).alias("fit"))
    out = asked.join(fits, "asked") if given is None else given.join(fits, ["profile_id", "asked"])
    return out.select("profile_id", "posting_id", "fit")


def offers(skills: DataFrame, families: DataFrame) -> DataFrame:
    """``(profile_id, offer)``: per profile the skills that it holds (``sure`` if one is supported) or has a family in common with (``adjacent``), by name."""
    held = skills.groupBy("profile_id", "skill").agg(F.max(F.col("support") == "supported").alias("sure"))
    kin = skills.join(families, "skill").select("profile_id", "family").distinct().join(families, "family").select("profile_id", "skill", F.lit(1.0).alias("adjacent")).distinct()
    both = held.join(kin, ["profile_id", "skill"], "full_outer")
    return both.groupBy("profile_id").agg(F.sort_array(F.collect_list(F.struct("skill", "sure", "adjacent"))).alias("offer"))


def worth(required: Column) -> Column:
    return F.when(required, 4.0).otherwise(3.0)


def set_fit(asked: Column, offer: Column, base: int = 20) -> Column:
    """What ``qualification_fit`` gives, from a posting's skills (array<struct<skill, required>>, each skill once) and a profile's ``offers``; null where no skill meets any."""
    by_skill = F.map_from_entries(F.transform(offer, lambda x: F.struct(x["skill"], F.struct(x["sure"], x["adjacent"]))))
    met = F.filter(F.transform(asked, lambda a: F.struct(a["required"].alias("required"), F.try_element_at(by_skill, a["skill"]).alias("has"))), lambda m: m["has"].isNotNull())
    points = F.transform(met, lambda m: F.greatest(F.when(m["has"]["sure"], worth(m["required"])).when(~m["has"]["sure"], worth(m["required"]) / 2), m["has"]["adjacent"]))
    earned = F.aggregate(points, F.lit(0.0), lambda a, x: a + x)
    gaps = F.size(F.filter(asked, lambda a: a["required"])) - F.size(F.filter(met, lambda m: m["required"]))
    return F.when(F.size(met) > 0, F.greatest(F.lit(0.0), F.least(F.lit(45.0), base + earned - F.least(F.lit(12.0), gaps * 3.0))))


def most_fit(asked: Column, base: int = 20) -> Column:
    """The most that ``set_fit`` can give, whatever a profile offers."""
    return F.least(F.lit(45.0), base + F.aggregate(asked, F.lit(0.0), lambda a, x: a + worth(x["required"])))


def role_value(title: Column, families: dict[str, list[str]], most: int = 15) -> Column:
    """Points for the role family a title belongs to; families in order of preference."""
    t = F.lower(title)
    out = F.lit(0)
    for i, words in reversed(list(enumerate(families.values()))):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words]), max(0, most - 3 * i)).otherwise(out)
    return out


def market_value(generic: Column, pressure: Column, demand: Column) -> Column:
    """5, less competition (2 for a generic title, and pressure, at most 6), plus demand (at most 5); between 0 and 10."""
    penalty = F.least(F.lit(6), F.when(generic, 2).otherwise(0) + pressure)
    return F.greatest(F.lit(0), F.least(F.lit(10), 5 - penalty + F.least(F.lit(5), demand)))


def location_score(remote: Column, distance: Column, commute: Column, region_score: Column, remote_score: int = 20, most: int = 20, least: int = 12, moving: int = 4) -> Column:
    """struct<min, max>: remote, commutable (falling from ``most`` to ``least``), moving by region; a range where the distance is unknown."""
    limit = F.greatest(F.lit(5.0), commute)
    near = half_up(most - (most - least) * distance / limit)
    away = F.coalesce(region_score, F.lit(moving))
    both = lambda a, b: F.struct(a.cast("int").alias("min"), b.cast("int").alias("max"))
    return F.when(remote, both(F.lit(remote_score), F.lit(remote_score))).when(distance.isNull(), both(away, F.lit(most))).when(distance <= limit, both(near, near)).otherwise(both(away, away))


def compose(df: DataFrame, contract=CONTRACT) -> DataFrame:
    """``df`` with score_min and score_max: the sum of ranking components, each within its maximum.

    A component is a column of its name; ``<name>_max`` is its upper end where it has one.
    """
    ranking = {n: m for n, (role, m) in contract.items() if role == "ranking"}
    if sum(ranking.values()) != 100:
        raise ValueError("the contract's maxima must sum to 100")
    within = lambda c, m: F.greatest(F.lit(0.0), F.least(F.lit(float(m)), F.coalesce(F.col(c).cast("double"), F.lit(0.0))))
    low = {n: within(n, m) for n, m in ranking.items()}
    high = {n: F.greatest(low[n], within(f"{n}_max", m)) if f"{n}_max" in df.columns else low[n] for n, m in ranking.items()}
    total = lambda parts: reduce(lambda a, b: a + b, parts.values())
    return df.withColumn("score_min", total(low)).withColumn("score_max", F.least(F.lit(100.0), total(high)))
