"""Secret scans weighed by corpus-wide ownership (native).

Patterns find candidates in every text. A candidate's value is hashed, and the
corpus tells how many repositories and owners hold that hash: a value that many
hold is a copied example, one that a single owner holds in few repositories looks
live, unless the value itself is a placeholder. The stricter patterns always report
their spans; a looser pattern, which alone would report too much, reports a span
only where its value looks live.

Owner and repository are columns of the input. Offsets are code points, ends
exclusive. Defined results: null and empty texts have no spans; a null owner
counts as one owner of its own, a null repository as one repository; repeated rows
are rows of their own but one repository; spans that begin together are ordered by
kind; texts and runs of any length are read whole; an empty table gives no rows;
other columns pass through, but ``spans`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import fresh, materialize, read_table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: pattern, group that holds the value, least characters of that group. Greedy runs make the quantifiers equal to a filter on the whole run.
BASE = {"assign": (ASSIGN, 2, 12), "access": (r"AKIA[A-Z0-9]{14,}", 0, 18), "hex": (r"[0-9a-f]{16,}", 0, 16)}
#: Long mixed tokens: a digit, an upper-case and a lower-case letter in one run. A run is tried at its start only and read without going back.
LOOSE = {"token": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[a-z0-9+/_=-]*+[A-Z])(?=[A-Z0-9+/_=-]*+[a-z])[A-Za-z0-9+/_=-]{24,}", 0, 24)}
#: Words that say that a value is made up.
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|change_?me|your[_-]|x{4}"
#: A value of fewer distinct characters is made up as well.
VARIETY = 8
STEP = "array<struct<kind:string,gap:int,len:int,size:int,hash:string,made_up:boolean>>"
SPAN = "array<struct<kind:string,s:bigint,e:bigint,hash:string,owners:bigint,repositories:bigint,verdict:string>>"


def _steps(text: Column, kind: str, pattern: str, group: int) -> Column:
    """The leftmost non-overlapping matches in order, each with the characters between it and the one before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(match: Column, gap: Column) -> Column:
        value = F.regexp_extract(match, pattern, group) if group else match
        made_up = value.rlike(PLACEHOLDER) | (F.size(F.array_distinct(F.split(value, ""))) < VARIETY)
        return F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), F.length(match).alias("len"), F.length(value).alias("size"), F.sha2(value, 256).alias("hash"), made_up.alias("made_up"))

    return F.when(text.rlike(pattern), F.zip_with(found, F.slice(gaps, 1, F.size(found)), step)).otherwise(F.expr(f"CAST(array() AS {STEP})"))


def _joined(spans: Column, rank: dict[str, int]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    place = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), place[x["kind"]].alias("r"), x["e"].alias("e"), x["kind"].alias("k"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, row: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with a number ``row`` for each row and ``steps``, its candidates in the order of kind and place."""
    body = F.coalesce(F.col(text), F.lit(""))
    steps = F.concat(*[_steps(body, k, pattern, group) for k, (pattern, group, _) in (BASE | LOOSE).items()])
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), "spans")]
    return docs.select(*kept, F.monotonically_increasing_id().alias(row), steps.alias("spans"))


def candidates(scanned: DataFrame, row: str, owner: str, repository: str) -> DataFrame:
    """``(rid, o, r, kind, s, e, hash, made_up)``: a row per candidate, its place summed up from gaps and lengths."""
    steps = scanned.select(F.col(row).alias("rid"), F.col(owner).alias("o"), F.col(repository).alias("r"), F.posexplode("spans").alias("pos", "x"))
    upto = Window.partitionBy("rid", "x.kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = steps.withColumn("e", F.sum(F.col("x.gap") + F.col("x.len")).over(upto))
    least = F.create_map(*[F.lit(v) for k, (_, _, n) in (BASE | LOOSE).items() for v in (k, n)])
    return placed.where(F.col("x.size") >= least[F.col("x.kind")]).select("rid", "o", "r", "x.kind", (F.col("e") - F.col("x.len")).alias("s"), "e", "x.hash", "x.made_up")


def ownership(found: DataFrame) -> DataFrame:
    """``(hash, owners, repositories)``: distinct holders of each value of ``found(hash, o, r)``, summed in two steps so that no value's holders meet in one task."""
    by_repository = found.groupBy("hash", "r").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    by_owner = found.groupBy("hash", "o").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    return by_repository.join(by_owner, "hash")


def secret_spans(docs: DataFrame, copied_owners: int = 3, copied_repositories: int = 25, text: str = "text", owner: str = "source", repository: str = "doc_id", salts: int = 8) -> DataFrame:
    """A row per row of ``docs``: its columns but the text, ``spans`` with owners, repositories and verdict.

    verdict: ``copied`` (``copied_owners`` owners or ``copied_repositories`` repositories
    or more), ``made_up`` (a placeholder), ``live`` (one owner), else ``shared``. The
    holders of a common value are dealt to ``salts`` tasks when it gets its verdict.
    """
    row, = fresh(docs.columns, "_rid")
    scanned = materialize(scan(docs, row, text), "secrets")
    found = materialize(candidates(scanned, row, owner, repository), "candidates")
    owned = ownership(found).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    verdict = (
        F.when((F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories), "copied")
        .when(F.col("made_up"), "made_up").when(F.col("owners") == 1, "live").otherwise("shared")
    )
    judged = found.withColumn("salt", F.pmod(F.xxhash64("rid", "s"), F.lit(salts)).cast("int")).join(owned, ["hash", "salt"]).withColumn("verdict", verdict)
    judged = judged.where(F.col("kind").isin(list(BASE)) | (F.col("verdict") == "live"))
    per_row = judged.groupBy("rid").agg(F.collect_list(F.struct("kind", "s", "e", "hash", "owners", "repositories", "verdict")).alias("spans"))
    rows = scanned.drop("spans")
    return rows.join(per_row, rows[row] == per_row["rid"], "left").select(*[rows[c] for c in rows.columns if c != row], F.coalesce("spans", F.expr(f"CAST(array() AS {SPAN})")).alias("spans"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    rank = {k: i for i, k in enumerate([*BASE, *LOOSE])}
    base = F.filter("spans", lambda x: x["kind"].isin(list(BASE)))

    def count(field: str, value: str) -> Column:
        return F.size(F.filter("spans", lambda x: x[field] == value)).cast("bigint")

    return found.select(
        "doc_id",
        *[count("kind", k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base, rank), 256).alias("base_sha256"),
        _joined(F.col("spans"), rank).alias("spans"),
        count("verdict", "live").alias("n_live"),
        count("verdict", "copied").alias("n_copied"),
        count("verdict", "made_up").alias("n_made_up"),
    )
