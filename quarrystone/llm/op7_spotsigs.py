"""SpotSigs document fingerprints (native).

A spot signature starts at a common-word anchor and chains the content words that
follow it. A document's fingerprint is the set of its signatures' hashes; the
likeness of two documents is the Jaccard similarity of their sets. Sets are
compared only where their lengths allow the wanted likeness.

Defined results: texts without any chain (no anchor, too few words, other
languages) are signed as a whole, so they equal only themselves; texts without a
word, empty ones and nulls have the empty fingerprint, alike (1.0) to one another
and to nothing else; rows without an id come before all others; rows that share an id
are ordered by text, repeated rows follow each other; texts of any length are read
whole; an empty table gives no rows; columns besides the key and the text are not read
by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import read_table

#: Common words of the four languages; they anchor chains and are never content words.
ANCHORS = (
    "the of and to in a is that it was for on are as with at be this have from or by not but",
    "le la les de des un une et est que qui en du dans pour par sur au avec ne pas plus ce il",
    "der die das und ist von zu den mit sich des dem nicht ein eine auf für im auch als an",
    "el los las y es se lo su al con para no por una del como más o si",
)
ANCHOR_WORDS = sorted({w for line in ANCHORS for w in line.split()})
MARK = "\x01"


def with_signatures(df: DataFrame, text: str, out: str, chain: int = 2) -> DataFrame:
    """``df`` with ``out``: sorted distinct 32-bit hashes (array<bigint>) of the spot signatures of ``text``.

    Each step is a column of its own, so that none is computed more than once.
    """
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    # each run of anchors is glued to the content word after it: "of<1>the<1>house"
    glued = F.rtrim(F.array_join(F.transform(words, lambda w: F.concat(w, F.when(w.isin(ANCHOR_WORDS), MARK).otherwise(" "))), ""))
    rows = df.withColumn("_glued", glued).withColumn("_tokens", F.split("_glued", " "))
    content = lambda t: F.substring_index(t, MARK, -1)
    ahead = [F.slice("_tokens", k + 1, F.greatest(F.size("_tokens"), F.lit(1))) for k in range(1, chain)]
    chained = F.col("_tokens")
    for tail in ahead[:-1]:
        chained = F.zip_with(chained, tail, lambda a, b: F.when(b.isNotNull() & (content(b) != ""), F.concat(a, F.lit(" "), content(b))))
    spots = F.zip_with(chained, ahead[-1], lambda a, b: F.when((F.instr(a, MARK) > 0) & b.isNotNull() & (content(b) != ""), F.xxhash64(a, content(b)).bitwiseAND(F.lit(0xFFFFFFFF))))
    hashed = F.sort_array(F.array_distinct(F.array_compact(spots)))
    rows = rows.withColumn("_hashed", hashed)
    nothing = F.expr("CAST(array() AS array<bigint>)")
    whole = F.array(F.xxhash64("_glued", F.lit("whole")).bitwiseAND(F.lit(0xFFFFFFFF)))
    return rows.withColumn(out, F.when(F.length("_glued") == 0, nothing).when(F.size("_hashed") > 0, F.col("_hashed")).otherwise(whole)).drop("_glued", "_tokens", "_hashed")


def pruned_jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without comparing them where lengths keep it under ``least``."""
    na, nb = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    return (
        F.when((na == 0) & (nb == 0), F.lit(1.0)).when((na == 0) | (nb == 0), F.lit(0.0))
        .when(F.least(na, nb) < F.greatest(na, nb) * least, F.lit(0.0))
        .otherwise(both / (na + nb - both))
    )


def spotsigs_join(sets: DataFrame, least: float = 0.75) -> DataFrame:
    """Pairs ``(a, b, likeness)`` of ids whose signature sets are alike, from ``sets(id, sigs)``.

    Sets are dealt by length class, so that alike sets lie in the same class or the
    next. In a class a pair meets on the signatures of its prefixes, rarest first:
    alike sets share one there. Equal sets should be made one row before.
    """
    rows = sets.where(F.size("sigs") > 0).select("id", "sigs", F.size("sigs").alias("n"))
    held = rows.select("id", "n", F.explode("sigs").alias("sig"))
    rarity = held.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("id").orderBy("df", "sig")
    prefix = held.join(rarity, "sig").where("df > 1").withColumn("rest", F.row_number().over(order)).withColumn("common", F.count(F.lit(1)).over(Window.partitionBy("id")))
    # signatures held once come first in the order; df > 1 begins after them
    prefix = prefix.where(F.col("rest") + F.col("n") - F.col("common") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
    klass = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / least))).cast("int")
    right = prefix.select("sig", klass.alias("klass"), F.col("id").alias("b"), F.col("n").alias("nb"))
    left = prefix.select("sig", F.explode(F.array(klass, klass - 1, klass + 1)).alias("klass"), F.col("id").alias("a"), F.col("n").alias("na"))
    pairs = left.join(right, ["sig", "klass"]).where("a < b").where(F.least("na", "nb") >= F.greatest("na", "nb") * least).select("a", "b").distinct()
    full = pairs.join(rows.select(F.col("id").alias("a"), F.col("sigs").alias("sa")), "a").join(rows.select(F.col("id").alias("b"), F.col("sigs").alias("sb")), "b")
    return full.select("a", "b", pruned_jaccard(F.col("sa"), F.col("sb"), least).alias("likeness")).where(F.col("likeness") >= least)


def with_next(docs: DataFrame, key: str, block_rows: int = 1000, most_blocks: int = 1 << 16) -> DataFrame:
    """``docs`` dealt into blocks of neighbouring keys, with ``_block``, and ``_copy`` true on each block's extra last rows: those with the key that follows it.

    Blocks lie between approximate quantiles of the key, so they are alike however the
    keys lie. A quantile is itself a key and the first one of its block, so a row tells
    by comparing that a copy of it goes to the block before. At most ``most_blocks``
    keys reach the driver. Null keys come before all others.
    """
    k = F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63)))
    low, rows = docs.agg(F.min(k), F.count(F.lit(1))).first()
    blocks = max(1, min(most_blocks, rows // block_rows))
    step = 64

    def listed(values: list, kind: str = "bigint"):
        return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.expr(f"CAST(array() AS array<{kind}>)")

    wanted = listed([i / blocks for i in range(1, blocks)], "double")
    at = docs.agg(F.percentile_approx(k, wanted, 4 * blocks).alias("at")).first()["at"] if blocks > 1 else []
    bounds = sorted(set(at) - {low})

    every, coarse = listed(bounds), listed(bounds[step - 1::step])
    # how many bounds a key has reached: whole steps first, then within one step
    whole = (F.size(F.filter(coarse, lambda x: x <= F.col("_k"))) * step).cast("int")
    keyed = docs.withColumn("_k", k).withColumn("_whole", whole)
    inside = F.slice(every, F.col("_whole") + 1, F.lit(step))
    keyed = keyed.withColumn("_own", F.col("_whole") + F.size(F.filter(inside, lambda x: x <= F.col("_k"))))
    before = F.when(F.col("_k") == F.lit(low), F.lit(len(bounds))).when(F.col("_k") == F.get(every, F.col("_own") - 1), F.col("_own") - 1)
    place = lambda block, copy: F.struct(block.cast("bigint").alias("_block"), F.lit(copy).alias("_copy"))
    places = F.when(before.isNull(), F.array(place(F.col("_own"), False))).otherwise(F.array(place(F.col("_own"), False), place(before, True)))
    return keyed.withColumn("_place", F.explode(places)).select(*docs.columns, "_place.*")


def fingerprint_string(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.hex(x))), " ")


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = with_signatures(with_next(docs, "doc_id").repartition("_block"), "text", "sigs")
    ahead = Window.partitionBy("_block").orderBy("_copy", F.col("doc_id").asc_nulls_first(), "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    pairs = dealt.withColumn("next_text", F.lead("text").over(ahead)).withColumn("next_sigs", F.lead("sigs").over(ahead)).where(~F.col("_copy"))
    pairs = pairs.withColumn("n_chars", n.cast("bigint")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", "text"), F.lit(1), half)))
    pairs = with_signatures(pairs, "edited", "edited_sigs")
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_string(F.col("sigs")).alias("fingerprint"), fingerprint_string(F.col("edited_sigs")).alias("edited_fingerprint"),
        pruned_jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        pruned_jaccard(F.col("sigs"), F.coalesce("next_sigs", "sigs")).alias("near_next"),
    )
