"""Classes of postings from their titles and texts: rules are parameters, label -> pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAREER_AREAS = {
    "cs": r"software|developer|programmer|machine learning|data scien|cyber|computer|cloud|devops",
    "engineering": r"\b(?:mechanical|electrical|civil|chemical|aerospace|manufacturing|hardware) engineer",
    "finance": r"financ|accounting|audit|actuar|bank|invest|treasury",
    "tech-business": r"product manage|business intelligence|data analy|business analy|program manage",
    "marketing": r"marketing|brand|communications|social media",
}
#: Engineering disciplines, the second rule set: they are told apart within engineering.
DISCIPLINES = {
    "aerospace": r"aerospace|aeronautic|astronautic|avionics|propulsion", "biomedical": r"biomedical|bioengineer|medical device", "chemical": r"chemical engineer|process engineer", "civil": r"civil engineer|structural engineer|transportation engineer|geotechnical",
    "electrical": r"electrical|electronics|hardware engineer|embedded|\bfpga\b|\bvlsi\b|power systems", "environmental": r"environmental engineer|water resources", "industrial": r"industrial engineer|operations research|supply chain engineer",
    "manufacturing": r"manufacturing|production engineer|quality engineer", "materials": r"materials engineer|materials science|metallurg", "mechanical": r"mechanical|thermal engineer|\bhvac\b|mechatronic", "nuclear": r"nuclear", "robotics": r"robotic", "systems": r"systems engineer",
}
#: Titles of one area that belong to another as well.
SHARED_AREAS = {"tech-business": r"data analyst|business intelligence|analytics (?:intern|&|and)|product manage(?:r|ment)|technical program manager", "cs": r"data scientist|machine learning|software"}


def disciplines(text: Column, hints: Column | None = None) -> Column:
    """Sorted engineering disciplines that a text or a hint names."""
    found = labels(text, DISCIPLINES)
    named = F.array_intersect(hints, F.array(*map(F.lit, DISCIPLINES))) if hints is not None else F.expr("CAST(array() AS array<string>)")
    return F.array_sort(F.array_union(found, F.coalesce(named, F.expr("CAST(array() AS array<string>)"))))


def career_areas(text: Column, hints: Column | None = None) -> Column:
    """Sorted areas of both rule sets: a discipline makes engineering, shared titles count for each area, hints are kept; ``general`` if nothing fits."""
    none = F.expr("CAST(array() AS array<string>)")
    areas = F.array_union(labels(text, CAREER_AREAS), labels(text, SHARED_AREAS))
    areas = F.array_union(areas, F.when(F.size(disciplines(text, hints)) > 0, F.array(F.lit("engineering"))).otherwise(none))
    if hints is not None:
        areas = F.array_union(areas, F.array_except(F.coalesce(hints, none), F.array(*map(F.lit, DISCIPLINES))))
    return F.when(F.size(areas) == 0, F.array(F.lit("general"))).otherwise(F.array_sort(areas))


EDUCATION = [
    ("undergrad", r"(?i)\b(?:undergrad(?:uate)?|bachelor'?s?|associate'?s? degree|freshman|sophomore|junior)\b|(?:^|[\s,(/])B\.?[SA]\.?(?=$|[\s,)/])"),
    ("graduate-only", r"(?i)\b(?:ph\.?d\b|doctora(?:l|te)|master'?s?|graduate (?:student|internship)|mba|juris doctor)|(?:^|[\s,(/])(?:M\.?[SA]|J\.?D)\.?(?=$|[\s,)/])"),
]
OPPORTUNITY = [
    ("co-op", r"\bco[- ]?op\b|cooperative education"), ("internship", r"\bintern(?:ship)?s?\b|student trainee|pathways"), ("fellowship", r"\bfellow(?:ship)?\b"),
    ("research", r"research (?:assistant|program|experience)"), ("student", r"\bstudent\b"),
]
EXPERIENCE = [("none", r"no (?:prior |previous )?experience|entry[- ]level"), ("years", r"\b\d+\+? years?\b"), ("some", r"(?:prior|previous|relevant|hands-on) experience"), ("preferred", r"experience .{0,40}(?:preferred|a plus)")]


def labels(text: Column, rules: dict[str, str], default: str | None = None) -> Column:
    """Sorted labels whose pattern occurs; ``default`` if none does."""
    t = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_sort(F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(n)) for n, p in rules.items()])))
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found) if default else found


def first_class(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The first class whose pattern occurs."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def education(title: Column) -> Column:
    return first_class(title, EDUCATION, "unspecified")


def opportunity_type(title: Column, internship_source: Column | None = None) -> Column:
    found = first_class(F.lower(F.coalesce(title, F.lit(""))), OPPORTUNITY, "other")
    return F.when((found == "other") & internship_source, "internship").otherwise(found) if internship_source is not None else found


def experience_burden(statement: Column) -> Column:
    return first_class(F.lower(statement), EXPERIENCE, "unstated")


SEASONS = r"(?i)\b(spring|summer|fall|autumn|winter)\s+(20\d{2})\b"


def schedule_terms(text: Column) -> Column:
    """Terms named in a text, in order, each once; autumn is fall."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(SEASONS), F.lit(1)).alias("s"), F.regexp_extract_all(text, F.lit(SEASONS), F.lit(2)).alias("y"))
    return F.array_distinct(F.transform(both, lambda x: F.concat(F.initcap(F.when(F.lower(x["s"]) == "autumn", "fall").otherwise(x["s"])), F.lit(" "), x["y"])))


def term_window(term: Column) -> Column:
    """struct<start, end> of a named term."""
    season, year = F.lower(F.split(term, " ")[0]), F.try_to_number(F.element_at(F.split(term, " "), -1), F.lit("9999")).cast("int")
    month = lambda a: F.when(season == "spring", a[0]).when(season == "summer", a[1]).when(season == "fall", a[2]).when(season == "winter", a[3])
    start = F.make_date(year, month((1, 5, 8, 12)), F.lit(1))
    return F.when(start.isNotNull(), F.struct(start.alias("start"), F.last_day(F.add_months(start, month((4, 3, 4, 2)))).alias("end")))
