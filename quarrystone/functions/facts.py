"""Facts stated in texts: lines, headed sections, sentences, levels, fields; schedules; a profile's own evidence.

What to recognise is told by tables of plain phrases. A text is brought to one form
(lower case, contractions written out, initials without points), and one pass of a dictionary
over it tells all phrases of all tables and their places (``phrases``); rules are about which
phrases were found and how far apart.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.phrases import Phrases, first_of, has, named, near
from quarrystone.functions.text import unescaped

# --- fixed values -----------------------------------------------------------
#: Technologies in the order in which they are reported, and their spellings.
TECHNOLOGIES = {
    "C++": ["C++"], "C#": ["C#"], "C": ["C"], "Python": ["Python"], "Go": ["Go", "Golang"], "JavaScript": ["JavaScript"], "TypeScript": ["TypeScript"], "React": ["React", "React.js", "ReactJS"],
    "Node.js": ["Node.js", "NodeJS"], ".NET": [".NET", "dotnet"], "Java": ["Java"], "SQL": ["SQL"], "PostgreSQL": ["PostgreSQL", "Postgres"], "MySQL": ["MySQL"], "R": ["R"], "Git": ["Git"], "GitHub": ["GitHub"],
    "GitLab CI": ["GitLab CI"], "Linux": ["Linux"], "Unix": ["Unix"], "Microsoft Office": ["Microsoft Office", "MS Office"], "Excel": ["Excel"], "Tableau": ["Tableau"], "Power BI": ["Power BI", "PowerBI"],
    "Oracle": ["Oracle"], "Snowflake": ["Snowflake"], "Databricks": ["Databricks"], "Spark": ["Spark", "Apache Spark"], "SolidWorks": ["SolidWorks"], "AutoCAD": ["AutoCAD"], "CAD": ["CAD", "computer aided design"],
    "Siemens NX": ["Siemens NX", "NX CAD", "Unigraphics"], "Creo": ["Creo", "Pro/ENGINEER", "ProE"], "CATIA": ["CATIA"], "ANSYS": ["ANSYS"], "Abaqus": ["Abaqus"], "FEA": ["FEA", "finite element analysis"],
    "CFD": ["CFD", "computational fluid dynamics"], "GD&T": ["GD&T", "geometric dimensioning and tolerancing", "geometric dimensioning & tolerancing"], "DFM": ["DFM", "design for manufacturing", "design for manufacturability"],
    "DFA": ["DFA", "design for assembly"], "DFMA": ["DFMA", "design for manufacture and assembly", "design for manufacturing and assembly"], "FMEA": ["FMEA", "failure mode and effects analysis", "failure modes and effects analysis"],
    "CNC": ["CNC", "computer numerical control"], "Aerodynamics": ["aerodynamic", "aerodynamics"], "Propulsion": ["propulsion"], "Orbital mechanics": ["orbital mechanics", "astrodynamics"], "Flight dynamics": ["flight dynamics", "flight mechanics"],
    "GNC": ["GNC", "guidance navigation and control", "guidance, navigation, and control", "guidance, navigation and control", "guidance, navigation & control"], "Avionics": ["avionics"], "Flight test": ["flight test", "flight testing"],
    "Controls": ["control system", "control systems", "controls engineering", "feedback control"], "PID": ["PID", "PID control", "proportional integral derivative"], "Kalman filter": ["Kalman filter", "Kalman filtering"],
    "Sensor fusion": ["sensor fusion"], "ROS 2": ["ROS 2", "ROS2"], "RTOS": ["RTOS", "FreeRTOS", "real time operating system"], "MATLAB": ["MATLAB"], "AWS": ["AWS", "Amazon Web Services"], "Azure": ["Azure"],
    "GCP": ["GCP", "Google Cloud", "Google Cloud Platform"], "Docker": ["Docker"], "Kubernetes": ["Kubernetes"], "Jenkins": ["Jenkins"],
}
#: Headings and the level that they set, the first that fits; ``reset`` ends a section.
HEADINGS = {
    "preferred": ["preferred qualification", "preferred qualifications", "qualification we prefer", "qualifications we prefer", "ideal candidate", "preferred but not required", "nice to have", "desired qualification", "desired qualifications", "what sets you apart", "bonus point", "bonus points"],
    "required": ["qualification must have", "qualifications must have", "qualification you must have", "qualifications you must have", "required qualification", "required qualifications", "required skill", "required skills", "minimum qualification", "minimum qualifications", "basic qualification", "basic qualifications", "what a must have", "what is a must have", "requirement", "requirements", "what we looking for", "what we are looking for", "who we looking for", "who we are looking for", "what you will need", "what we seek", "you bring", "you will bring", "what it takes"],
    "unspecified": ["qualification", "qualifications", "candidate profile", "this job might be for you if", "what you bring", "skills and abilities", "education"],
    "reset": ["what you will do", "what you will be doing", "responsibilities", "duties", "about us", "about the role", "what we offer", "benefits", "compensation", "salary", "employment practices", "location information", "who are we", "job category", "target openings", "what is the opportunity", "what you will learn", "learn more"],
}
#: What a statement says itself about its level.
NOT_REQUIRED = ["not required", "is not required", "do not require", "does not require", "did not require", "will not require"]
REQUIRED = ["must", "require", "requires", "required to", "required qualification", "does not sponsor", "will not sponsor", "unable to sponsor"]
PREFERRED = ["preferred", "ideally", "desired", "a plus", "nice to have", "suggested"]
AT_LEAST = ["minimum of", "at least"]
#: Fields in the order in which they are reported, and the phrases that tell of them.
FIELDS = {
    "education": ["degree", "bachelor", "bachelors", "bachelor's", "master", "masters", "master's", "phd", "ph.d", "ph d", "doctorate", "associate", "associates", "associate's", "bs", "b s", "ba", "b a", "ms", "m s"],
    "graduation": ["graduate", "graduating", "graduation", "class of"],
    "student_status": ["current student", "current a student", "currently student", "currently a student", "actively enrolled", "enrolled in", "enrolled through", "enrolled at", "pursuing degree", "pursuing a degree", "pursuing bachelor", "pursuing a bachelor", "pursuing a bachelor's", "pursuing master", "pursuing a master", "pursuing a master's", "pursuing a bs", "pursuing a ba", "pursuing an ms", "returning to school", "freshman", "freshmen", "sophomore", "sophomores", "junior", "juniors", "senior", "seniors", "undergraduate", "graduate student", "graduate students"],
    "major_fields": ["major", "majors", "majoring", "degree in", "discipline", "field of study", "academic field", "related field"],
    "citizenship": ["us citizen", "us citizenship", "us person", "us national", "us permanent resident", "united states citizen", "united states citizenship", "united states person", "united states national", "united states permanent resident", "lawful permanent resident", "refugee or asylee", "asylee status"],
    "work_authorization": ["authorized to work", "authorization to work", "work authorization", "work authorized", "sponsor", "sponsored", "sponsoring", "sponsorship", "h1b", "h-1b", "stem opt", "opt", "i-983", "work visa", "employment eligibility"],
    "skills": ["experience", "knowledge", "proficient", "proficiency", "skill", "skills", "ability to", "familiar", "familiarity", "expertise", "competency", "using", "communication", "problem solving", "problem-solving"],
    "other_eligibility": ["gpa", "credit hour", "credit hours", "credit by", "credits by", "background check", "drug test", "driver's license", "drivers license", "security clearance", "minimum age", "able to work", "available to work", "work part time", "work part-time", "work full time", "work full-time", "travel up to", "onsite", "on-site"],
}
#: A statement of graduation names a time as well.
TIMES = ["spring", "summer", "fall", "winter", "between", "before", "after", "by"]
#: Statements outside any section that tell of skills all the same, unless they begin as duties do.
CANDIDATE = ["experience with", "experience in", "experience using", "knowledge of", "proficient with", "proficient in", "proficiency with", "proficiency in", "familiar with", "familiarity with", "expertise in", "background in", "coursework with", "coursework in", "skill with", "skill in", "skills with", "skills in"]
DUTIES = ["you", "you will", "build", "develop", "design", "create", "implement", "support", "maintain", "work on", "use", "write", "deliver", "own", "help", "gain", "learn", "participate", "collaborate"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
SHORT_MONTHS = ["Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
NUMBER_WORDS = ["three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
DEADLINES = ["deadline", "apply by", "application will close", "applications will close", "application close", "applications close", "application due", "applications due", "closing date", "submit by"]
#: Sections of a profile's document.
PROFILE_SECTIONS = {
    "skills": ["skills", "skill"], "coursework": ["coursework", "relevant coursework"], "projects": ["projects", "project"], "experience": ["experience", "employment", "professional experience", "work experience"],
    "leadership": ["leadership", "activities", "extracurriculars", "extracurricular"], "other": ["education", "awards", "award", "certifications", "certification", "research"],
}
SCIENCE, ARTS = ["B.S.", "B.S", "BS", "Bachelor of Science", "Bachelor's of Science"], ["B.A.", "B.A", "BA", "Bachelor of Arts", "Bachelor's of Arts"]
DEGREES = {"Bachelor of Science": SCIENCE, "Bachelor of Arts": ARTS, "Bachelor's degree": ["Bachelor", "Bachelor's"], "Master's degree": ["Master", "Master's", "M.S.", "M.S", "MS"]}
MAJORS = ["Computer Science", "Computer Engineering", "Software Engineering", "Data Science", "Information Technology", "Information Systems", "Electrical Engineering", "Mechanical Engineering", "Aerospace Engineering", "Civil Engineering", "Industrial Engineering", "Biomedical Engineering", "Chemical Engineering", "Mathematics", "Statistics", "Physics", "Finance", "Accounting", "Economics", "Business Administration", "Marketing"]
#: Technologies whose names are plain words or letters: they count as written only.
PLAIN_NAMES = {"C", "R", "Go", "React", "Excel", "Oracle", "Spark", "Snowflake", "Tableau"}
# ----------------------------------------------------------------------------
UNKNOWN = "Unknown / not provided"


def pattern(phrases: list[str]) -> str:
    """A pattern that finds any of the phrases as whole words; blanks and hyphens stand for each other.

    Phrases are grouped by their first character, so that most words are passed over at
    once however long the table is.
    """
    by_first: dict[str, list[str]] = {}
    for p in sorted(set(phrases), key=lambda p: (-len(p), p)):
        rest = p[1:]
        inner = r"[\s-]+".join(map(re.escape, re.split(r"[\s-]+", rest))) if re.search(r"\w[\s-]+\w", p) else re.escape(rest)
        by_first.setdefault(p[0], []).append(inner)
    words = "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in by_first.items())
    return rf"(?<![\p{{L}}\p{{M}}\p{{N}}+#])(?:{words})(?![\p{{L}}\p{{M}}\p{{N}}+#])"


def plain(text: Column) -> Column:
    """Lower case, apostrophes alike, contractions written out, initials without points (U.S. as us)."""
    t = F.lower(F.translate(F.coalesce(text, F.lit("")), "’‘ʼ＇", "''''"))
    for short, long in (("'ll\\b", " will"), ("'re\\b", " are"), ("n't\\b", " not")):
        t = F.regexp_replace(t, short, long)
    return F.regexp_replace(t, r"\b([a-z])\.(?=[a-z]\b)|(?<=\b[a-z]\.[a-z])\.|(?<=\b[a-z])\.(?=\s|$|,)", "$1")


def says(text: Column, phrases: list[str]) -> Column:
    return text.rlike(pattern(phrases))


def html_lines(html: Column) -> Column:
    """Block-level lines of an HTML text, none of them blank."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</?(?:p|div|li|ul|ol|h[1-6]|tr|section|article|title)\b[^>]*>", "\n")
    lines = F.transform(F.split(unescaped(F.regexp_replace(t, r"<[^>]*>", "")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(lines, lambda x: x != "")


def _heading(line: Column, hits: Column, headings: dict[str, list[str]]) -> Column:
    short = (F.length(line) <= 100) & (F.size(F.split(F.trim(line), r"\s+")) <= 14)
    return F.when(short, first_of(hits, {f"heading {level}": level for level in headings}))


def heading_level(line: Column, headings: dict[str, list[str]] = HEADINGS) -> Column:
    """Level that a short heading line sets (``reset`` ends a section); null for other lines."""
    return _heading(line, Phrases({f"heading {level}": phrases for level, phrases in headings.items()}).hits(plain(line)), headings)


#: What statements say of their level, and what to look for beside the fields.
_LEVELS = {"denied": NOT_REQUIRED, "demanded": REQUIRED, "wished": PREFERRED, "minimum": AT_LEAST, "no": ["no"], "required": ["required"]}
_CUES = {"times": TIMES, "candidate": CANDIDATE, "duties": DUTIES, "regardless": ["without regard to"], "origin": ["citizenship", "national origin"]}


def _level(hits: Column, section: Column) -> Column:
    return (
        F.when(has(hits, "denied") | near(hits, "no", "required", 60, "clause"), "not_required").when(has(hits, "demanded"), "required").when(has(hits, "wished"), "preferred")
        .when(has(hits, "minimum"), F.when(section == "preferred", "preferred").otherwise("required")).otherwise(section)
    )


def stated_level(statement: Column, section: Column) -> Column:
    """A statement's own level, else its section's; a minimum is required outside preferred sections."""
    return _level(Phrases(_LEVELS).hits(plain(statement)), section)


def technologies_in(text: Column, technologies: dict[str, list[str]] = TECHNOLOGIES) -> Column:
    """Names of the technologies that a text mentions, in the order of the table; plain words only where they are names."""
    return named(Phrases(technologies, PLAIN_NAMES).hits(text), list(technologies))


def sectioned(lines: DataFrame, doc: str, pos: str, heading: Column) -> DataFrame:
    """``lines`` that are no headings, with ``section``, the level that the last heading before them set; null where none did or it ended."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_head", heading).withColumn("section", F.last("_head", ignorenulls=True).over(w)).where("_head is null")
    return rows.withColumn("section", F.when(F.col("section") != "reset", F.col("section"))).drop("_head")


def extract_facts(lines: DataFrame, doc: str, pos: str, line: str, fields=FIELDS, technologies=TECHNOLOGIES, headings=HEADINGS, heading: Column | None = None) -> DataFrame:
    """``(doc, ordinal, sentence, field, level, statement, technologies, negated)``: a row per fact.

    ``lines`` has a row per line. The level of a section holds from its heading to the
    next one; a statement's own words come before its section's level. Statements with
    a level that tell of no field are other conditions; statements without one count
    as skills where they speak of a candidate and not of duties.
    """
    book = Phrases({**{f"heading {h}": p for h, p in headings.items()}, **_LEVELS, **{f"field {f}": p for f, p in fields.items()}, **_CUES})
    head = heading if heading is not None else _heading(F.col(line), F.col("_hits"), headings)
    rows = sectioned(lines.withColumn("_hits", book.hits(plain(F.col(line)))), doc, pos, head)
    # outside sections only lines with a phrase of some level or field can state a fact
    telling = [*_LEVELS, *(f"field {f}" for f in fields)]
    rows = rows.where(F.col("section").isNotNull() | has(F.col("_hits"), *telling) | F.contains(F.lower(line), F.lit("required")))
    # a sentence ends at a mark before a capital, but not after an initial
    said = rows.select(doc, F.col(pos).alias("ordinal"), "section", F.posexplode(F.split(line, r"(?<=[.!?])(?<![^\p{L}]\p{Lu}\.)\s+(?=\p{Lu})")).alias("sentence", "statement")).where(F.trim("statement") != "")
    rows = said.withColumn("_plain", plain(F.col("statement"))).withColumns({"_hits": book.hits(F.col("_plain")), "technologies": technologies_in(F.col("statement"), technologies)})
    h, p = F.col("_hits"), F.col("_plain")
    rows = rows.withColumn("level", _level(h, F.col("section")))
    headed = F.col("level").isNotNull()
    asks = has(h, "candidate") & ~F.exists(h, lambda x: (x["name"] == "duties") & (x["start"] == 0))
    rules = {name: has(h, f"field {name}") for name in fields if name not in ("skills", "other_eligibility")}
    if "graduation" in rules:
        rules["graduation"] = rules["graduation"] & (has(h, "times") | p.rlike(r"\b20\d{2}\b"))
    if "citizenship" in rules:
        rules["citizenship"] = rules["citizenship"] & ~near(h, "regardless", "origin")
    rules["skills"] = (headed | asks) & ((F.size("technologies") > 0) | has(h, "field skills"))
    known = F.array_compact(F.array(*[F.when(found, F.lit(name)) for name, found in rules.items()]))
    hard = has(h, "field other_eligibility") | p.rlike(r"\bat least \d+ years? old\b")
    known = F.when(hard | (headed & (F.size(known) == 0)), F.array_append(known, F.lit("other_eligibility"))).otherwise(known)
    out = rows.withColumn("field", F.explode(known))
    return out.select(doc, "ordinal", "sentence", "field", F.coalesce("level", F.lit("unspecified")).alias("level"), "statement", F.when(F.col("field") == "skills", F.col("technologies")).otherwise(F.expr("CAST(array() AS array<string>)")).alias("technologies"), (F.coalesce("level", F.lit("")) == "not_required").alias("negated"))


def field_classes(facts: DataFrame, doc: str) -> DataFrame:
    """Per document and field: its only level, or ``mixed``."""
    levels = F.collect_set("level")
    return facts.groupBy(doc, "field").agg(F.when(F.size(levels) == 1, F.element_at(levels, 1)).otherwise("mixed").alias("classification"), F.count(F.lit(1)).alias("facts"))


def schedule_evidence(lines: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """``(doc, kind, ordinal, value)``: terms named, and the lines that state a duration, a range of dates or a deadline, each once."""
    text = F.col(line)
    month, any_month = pattern(MONTHS), pattern(MONTHS + SHORT_MONTHS)
    terms = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:spring|summer|fall|autumn|winter)\s+20\d{2}\b"), F.lit(0))
    named = F.transform(terms, lambda x: F.struct(F.lit("term").alias("kind"), F.replace(F.initcap(F.regexp_replace(x, r"\s+", " ")), F.lit("Autumn"), F.lit("Fall")).alias("value")))
    # what stands between two months of one sentence tells whether they are the ends of a range
    between = F.slice(F.split(text, f"(?i){month}", -1), 2, F.greatest(F.lit(0), F.size(F.split(text, f"(?i){month}", -1)) - 2))
    ranged = F.exists(between, lambda x: (F.length(x) <= 120) & ~F.contains(x, F.lit(".")) & (F.contains(x, F.lit("-")) | says(F.lower(x), ["through", "to", "until", "thru"])))
    kinds = {"duration": text.rlike(rf"(?i)\b(?:\d+|{'|'.join(NUMBER_WORDS)})[ -]?(?:months?|weeks?)\b"), "date_range": ranged, "deadline": text.rlike(rf"(?i){pattern(DEADLINES)}[^.\n]*{any_month}")}
    lines_of = F.array_compact(F.array(*[F.when(told, F.struct(F.lit(kind).alias("kind"), text.alias("value"))) for kind, told in kinds.items()]))
    found = lines.select(doc, F.col(pos).alias("ordinal"), F.explode(F.concat(named, lines_of)).alias("x")).select(doc, "x.kind", "ordinal", "x.value")
    return found.groupBy(doc, "kind", "value").agg(F.min("ordinal").alias("ordinal")).select(doc, "kind", "ordinal", "value")


#: What a profile's document is searched for; dates are all months of this century, by rule.
_PROFILE = {
    "citizen": ["us citizen", "us citizenship", "united states citizen", "united states citizenship"], "authorized": ["authorized to work", "authorised to work"], "unsponsored": ["without sponsorship"],
    "free": ["no sponsorship required", "no sponsorship is required"], "sponsored": [f"{verb}{of} sponsorship" for verb in ("need", "needs", "require", "requires") for of in ("", " visa")] + ["sponsorship required"],
    "active": ["active"], "top secret": ["top secret", "ts/sci"], "secret": ["secret clearance"], "obtainable": ["eligible to obtain", "ability to obtain"], "clearance": ["clearance"],
    "uncleared": [f"{no}{active}{security} clearance" for no in ("no", "without") for active in ("", " active") for security in ("", " security")],
    "announced": ["expected", "anticipated", "graduation", "graduating", "class of"], "high school": ["high school", "secondary school", "ged"],
    "school": ["university", "college", "bachelor", "bachelor's", "master", "master's", "associate", "associate's", "bs", "ba", "ms", "ma", *MAJORS],
    "date": [f"{month} {year}" for month in MONTHS for year in range(2000, 2100)],
    **{f"degree {d}": [w.replace(".", "") for w in words] for d, words in DEGREES.items()}, **{f"major {m}": [m] for m in MAJORS},
}


def _authorization(h: Column) -> Column:
    citizen = has(h, "citizen")
    free = near(h, "authorized", "unsponsored", 60) | has(h, "free")
    work = F.when(free, "Authorized to work in the U.S. without sponsorship").when(has(h, "sponsored"), "Needs visa sponsorship").when(citizen, "Authorized to work in the U.S. without sponsorship").otherwise(UNKNOWN)
    return F.struct(F.when(citizen, "U.S. citizen").otherwise(UNKNOWN).alias("citizenship"), work.alias("work"))


def _clearance(h: Column) -> Column:
    held = lambda what: near(h, "active", what, 30) | near(h, what, "active", 30)
    return (
        F.when(held("top secret"), "Active Top Secret clearance").when(held("secret"), "Active Secret clearance").when(near(h, "obtainable", "clearance", 40), "Eligible / able to obtain a clearance")
        .when(has(h, "uncleared"), "No active security clearance").otherwise(UNKNOWN)
    )


def _graduation(h: Column) -> Column:
    """The best scored of all dates: points for an announcement close before it on its line, more for a higher school on its line or close before, most off for a high school; then the latest year, then the first."""

    def before(d: Column, what: str, far: int, line: bool, close: int = -1) -> Column:
        def stands(x: Column) -> Column:
            ahead = (x["name"] == what) & (x["stop"] <= d["start"])
            return ahead & (((x["line"] == d["line"]) if line else F.lit(True)) & (d["start"] - x["stop"] <= far) | (d["start"] - x["start"] <= close))

        return F.exists(h, stands)

    def scored(d: Column) -> Column:
        score = F.when(before(d, "announced", 50, True), 4).otherwise(0) + F.when(before(d, "school", 140, True, 90), 6).otherwise(0) - F.when(before(d, "high school", 140, True, 70), 12).otherwise(0)
        return F.struct(score.alias("score"), F.right(d["text"], F.lit(4)).alias("year"), F.negative(d["start"]).alias("first"), F.initcap(F.replace(d["text"], F.lit("\n"), F.lit(" "))).alias("value"))

    return F.array_max(F.filter(F.transform(F.filter(h, lambda x: x["name"] == "date"), scored), lambda x: x["score"] > 0))["value"]


def _sections(t: Column) -> Column:
    """map<section, array<line>>-like array of structs: the lines under each heading line of the table."""
    lines = F.split(F.regexp_replace(t, "\r", ""), "\n")
    name = F.lit(None).cast("string")
    heads = lambda x: F.lower(F.trim(F.regexp_replace(x, r"[\s:]+$", "")))

    def section(x: Column) -> Column:
        out = name
        for s, words in PROFILE_SECTIONS.items():
            out = F.when(heads(x).isin(words), F.lit(s)).otherwise(out)
        return out

    return F.transform(lines, lambda x, i: F.struct(i.alias("i"), section(x).alias("head"), F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*[•*–—-]+\s*", ""), r"\s+", " ")).alias("line")))


def profile_evidence(docs: DataFrame, doc: str, text: str, skills=TECHNOLOGIES) -> DataFrame:
    """``(doc, kind, value)``: graduation (best scored), degree, major, authorization, clearance, each skill, and the lines of each headed section."""
    t = F.coalesce(F.col(text), F.lit(""))
    looked = docs.select(doc, F.col(text).alias("_t"), Phrases(_PROFILE).hits(plain(t)).alias("_h"), technologies_in(t, skills).alias("_skills"))
    h = F.col("_h")
    own = _authorization(h)
    one = {
        "graduation": _graduation(h), "degree": first_of(h, {f"degree {d}": d for d in DEGREES}), "major": first_of(h, {f"major {m}": m for m in MAJORS}),
        "citizenship": own["citizenship"], "work_authorization": own["work"], "clearance": _clearance(h),
    }
    said = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in one.items()]), lambda x: x["value"].isNotNull() & (x["value"] != UNKNOWN))
    many = F.transform("_skills", lambda x: F.struct(F.lit("skill").alias("kind"), x.alias("value")))
    facts = looked.select(doc, F.explode(F.concat(said, many)).alias("x")).select(doc, "x.kind", "x.value")
    # section lines: only documents with a heading are taken apart
    words = [w for names in PROFILE_SECTIONS.values() for w in names]
    headed = docs.where(t.rlike(rf"(?im)^\s*(?:{'|'.join(words)})\s*:?\s*$"))
    # numbered before they are taken apart, so that rows of one id stay apart
    lines = headed.withColumn("_row", F.monotonically_increasing_id()).select("_row", doc, F.explode(_sections(t)).alias("x")).select("_row", doc, "x.*")
    under = Window.partitionBy("_row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.last("head", ignorenulls=True).over(under)).where("head is null and section is not null and section <> 'other' and length(line) >= 4")
    return facts.unionByName(lines.select(doc, F.concat(F.lit("section:"), "section").alias("kind"), F.col("line").alias("value")).distinct())
