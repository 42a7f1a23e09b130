"""Rules over wordings that each row's key draws: every wording of a table meets every other, and SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import classify as K
from quarrystone.functions import facts as X
from quarrystone.functions import text as TX
from quarrystone.operators import incremental as INC
from quarrystone.queries.composed import picked
from quarrystone.queries.registry import query
from quarrystone.sources.listings import table


def said(words, key: str) -> str:
    """In SQL, the word that ``picked`` draws."""
    return "([" + ", ".join("NULL" if w is None else "'" + w.replace("'", "''") + "'" for w in words) + f"])[{key} + 1]"


NAMES, CODES = list(TX.STATES), list(TX.STATES.values())
ONE, OTHER = f"c_custkey % {len(NAMES)}", f"(c_custkey * 7 + 3) % {len(NAMES)}"
_FORM = f"(c_custkey // {len(NAMES)}) % 6"
_A, _B = said(CODES, ONE), said(CODES, OTHER)
NAMED = f"SELECT c_custkey, c_nationkey, list_sort(list_distinct(CASE {_FORM} WHEN 0 THEN [{_A}] WHEN 1 THEN [{_A}] WHEN 2 THEN [{_A}, {_B}] WHEN 3 THEN ['Remote', 'US', {_B}] WHEN 4 THEN [{_A}, {_B}] ELSE [] END)) AS states FROM customer"


def drawn_places(spark, sf):
    """Places of one state or two, by name or code, after words that are codes in capitals only; the last form names none."""
    form = F.expr(f"(c_custkey div {len(NAMES)}) % 6")
    code, code2 = picked(ONE, CODES), picked(OTHER, CODES)
    name, name2 = picked(ONE, NAMES), picked(OTHER, NAMES)
    forms = [
        ("Offices in town or near me, ", code), ("hi from ", F.initcap(name)), (code, " / ", code2), ("Remote - United States; Oak Hill, ", code2), (F.upper(name), " and ", name2), ("somewhere in or near ok",),
    ]
    place = F.element_at(F.array(*[F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]) for parts in forms]), (form + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", place.alias("place"))


@query("c5_drawn_states", f"SELECT c_custkey, states FROM ({NAMED})")
def c5_drawn(spark, sf):
    """Every state beside another one, in every form."""
    return drawn_places(spark, sf).select("c_custkey", TX.states(F.col("place")).alias("states"))


@query("c5_drawn_reliable_states", f"""WITH s AS (SELECT *, list_filter(states, lambda x: x NOT IN ('Remote', 'US')) AS named, CASE c_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN [{_A}] WHEN 2 THEN [{_A}, {_A}, 'US'] ELSE [{_A}, 'Remote', {_B}] END AS given FROM ({NAMED})),
g AS (SELECT *, list_distinct(list_filter(coalesce(given, []), lambda x: x NOT IN ('Remote', 'US'))) AS known FROM s) SELECT c_custkey, CASE WHEN len(named) > 0 THEN named WHEN len(known) = 1 THEN known ELSE [] END AS states FROM g""")
def c5_reliable(spark, sf):
    """Those places with states in their metadata: none, one, one twice, two."""
    k, a, b = F.col("c_nationkey") % 4, picked(ONE, CODES), picked(OTHER, CODES)
    given = F.when(k == 1, F.array(a)).when(k == 2, F.array(a, a, F.lit("US"))).when(k == 3, F.array(a, F.lit("Remote"), b))
    return drawn_places(spark, sf).select("c_custkey", TX.reliable_states(F.col("place"), given).alias("states"))


FOUND = {
    "aerospace": "Avionics", "biomedical": "Medical Device", "chemical": "Process Engineer", "civil": "Geotechnical", "electrical": "FPGA", "environmental": "Water Resources", "industrial": "Operations Research",
    "manufacturing": "Quality Engineer", "materials": "Metallurgy", "mechanical": "HVAC", "nuclear": "Nuclear", "robotics": "Robotics", "systems": "Systems Engineer", None: "Cook",
}
HINTS = [None, "nuclear", "cs", "civil"]
_P, _Q, _HINT = "p_partkey % 14", "(p_partkey * 5 + 2) % 14", "(p_partkey // 14) % 4"


@query("c6_drawn_disciplines", f"SELECT p_partkey, list_sort(list_distinct(list_filter([{said(FOUND, _P)}, {said(FOUND, _Q)}, nullif({said(HINTS, _HINT)}, 'cs')], lambda x: x IS NOT NULL))) AS disciplines FROM part")
def c6_drawn(spark, sf):
    """Every discipline beside another one, with a hint that is a discipline, another area or none."""
    words = list(FOUND.values())
    hint = picked("(p_partkey div 14) % 4", HINTS)
    title = F.concat(picked(_P, words), F.lit(", "), picked(_Q, words), F.lit(" #"), F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", K.disciplines(title, F.when(hint.isNotNull(), F.array(hint))).alias("disciplines"))


LEVELS = [
    ("Undergraduate", "undergrad"), ("Bachelor's", "undergrad"), ("(B.S.)", "undergrad"), ("sophomore", "undergrad"), ("Associate's Degree", "undergrad"), ("PhD", "graduate-only"), ("Master's", "graduate-only"), ("DOCTORAL", "graduate-only"),
    ("MBA", "graduate-only"), ("M.S.,", "graduate-only"), ("Juris Doctor", "graduate-only"), ("", "unspecified"), ("Basalt", "unspecified"),
]
KINDS = [
    ("Software Co-op", "co-op"), ("Cooperative Education in Robotics", "co-op"), ("Engineering Internship", "internship"), ("Pathways Analyst", "internship"), ("Summer INTERNS", "internship"), ("Policy Fellow", "fellowship"),
    ("Research Assistant", "research"), ("Student Worker", "student"), ("Internal Auditor", "other"), ("Coopersmith", "other"),
]
_KIND = f"o_orderkey // {len(LEVELS)} % {len(KINDS)}"


@query("c7_drawn_titles", f"SELECT o_orderkey, {said([v for _, v in LEVELS], f'o_orderkey % {len(LEVELS)}')} AS education, {said([v for _, v in KINDS], _KIND)} AS kind FROM orders")
def c7_drawn(spark, sf):
    """Every wording of a level with every wording of a kind."""
    title = F.concat(picked(f"o_orderkey % {len(LEVELS)}", [w for w, _ in LEVELS]), F.lit(" "), picked(f"(o_orderkey div {len(LEVELS)}) % {len(KINDS)}", [w for w, _ in KINDS]))
    return table(spark, sf, "orders").select("o_orderkey", K.education(title).alias("education"), K.opportunity_type(title).alias("kind"))


SEASONS = [("spring", "Spring"), ("SUMMER", "Summer"), ("Fall", "Fall"), ("autumn", "Fall"), ("Winter", "Winter")]
LENGTHS = [*map(str, range(1, 13)), *X.NUMBER_WORDS]
UNITS = [" months", "-week", " weeks", "-month"]
_YEAR, _LENGTH = "(2020 + o_orderkey % 12)", said(LENGTHS, f"o_orderkey % {len(LENGTHS)}")
_FIRST, _SECOND = said(X.MONTHS, "o_orderkey % 12"), said(X.MONTHS, "o_custkey % 12")
_RANGE, _DUE = f"'Runs ' || {_FIRST} || ' through ' || {_SECOND} || '.'", f"'Applications close on ' || {_FIRST} || ' 5.'"


@query("c8_drawn_schedules", f"""SELECT o_orderkey, 'term' AS kind, 0 AS ordinal, {said([v for _, v in SEASONS], "o_custkey % 5")} || ' ' || {_YEAR} AS value FROM orders
UNION ALL SELECT o_orderkey, 'duration', 1, 'A paid ' || {_LENGTH} || {said(UNITS, "o_custkey % 4")} || ' stay' FROM orders
UNION ALL SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'date_range' ELSE 'deadline' END, 2, CASE o_orderkey % 3 WHEN 0 THEN {_RANGE} ELSE {_DUE} END FROM orders WHERE o_orderkey % 3 < 2""")
def c8_drawn(spark, sf):
    """A term, named twice, a duration and a range of months, a deadline or only a date, each on a line of the order's posting."""
    first, second = picked("o_orderkey % 12", X.MONTHS), picked("o_custkey % 12", X.MONTHS)
    term = F.concat(picked("o_custkey % 5", [w for w, _ in SEASONS]), F.lit("  "), F.expr("2020 + o_orderkey % 12").cast("string"))
    stay = F.concat(F.lit("A paid "), picked(f"o_orderkey % {len(LENGTHS)}", LENGTHS), picked("o_custkey % 4", UNITS), F.lit(" stay"))
    told = [F.concat(F.lit("Runs "), first, F.lit(" through "), second, F.lit(".")), F.concat(F.lit("Applications close on "), first, F.lit(" 5.")), F.concat(F.lit("Posted on "), first, F.lit(" 5. Seen in "), second, F.lit("."))]
    lines = F.array(F.concat(F.lit("Starts "), term, F.lit(" ("), term, F.lit(")")), stay, F.element_at(F.array(*told), (F.col("o_orderkey") % 3 + 1).cast("int")))
    rows = table(spark, sf, "orders").select("o_orderkey", F.posexplode(lines).alias("ordinal", "line"))
    return X.schedule_evidence(rows, "o_orderkey", "ordinal", "line")


BURDENS = [
    ("No prior experience needed, # openings", "none"), ("ENTRY-LEVEL role with # shifts", "none"), ("#+ years in labs", "years"), ("# years of relevant experience", "years"), ("Relevant experience with # kilns", "some"), ("Hands-on experience, # shifts", "some"),
    ("Experience with # kilns preferred", "preferred"), ("Experience is a plus", "preferred"), ("Experience", "unstated"), ("# yearly reviews", "unstated"), (None, "unstated"),
]


@query("c12_drawn_burdens", f"SELECT event_id, {said([v for _, v in BURDENS], f'event_id % {len(BURDENS)}')} AS burden FROM events")
def c12_drawn(spark, sf):
    """Every wording of an experience burden, with the user's number in it."""
    wording = F.replace(picked(f"event_id % {len(BURDENS)}", [w for w, _ in BURDENS]), F.lit("#"), F.col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", K.experience_burden(wording).alias("burden"))


@query("t6_source_verdicts", """WITH r AS (SELECT user_id, event_id % 3 AS s, epoch_ms(ts) AS ms FROM events), g AS (SELECT user_id, max(ms) FILTER (s = 0) AS done, max(ms) FILTER (s = 1) AS running, max(ms) AS latest FROM r GROUP BY 1)
SELECT user_id, CASE WHEN latest - done <= 48 * 3600000 THEN 'fresh' WHEN latest - running <= 720 * 60000 THEN 'in_progress' ELSE 'stale' END AS verdict FROM g""")
def t6_sources(spark, sf):
    """Each user as a source, events as its runs: good, under way or failed; as of the source's last run."""
    k = F.col("event_id") % 3
    runs = table(spark, sf, "events").select("user_id", F.when(k == 0, "success").when(k == 1, "in_progress").otherwise("failed").alias("status"), F.col("ts").alias("started_at"))
    generated = F.when(F.col("status") == "success", F.col("started_at"))
    return INC.freshness_verdict(runs, generated, F.col("started_at"), 48, 720, by=["user_id"]).select("user_id", "verdict")
