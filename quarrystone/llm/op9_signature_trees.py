"""N-gram Jaccard join by signature trees, and near-duplicate groups from its links.

Documents are sets of word shingles. A tree node holds the OR of its documents'
token bitmaps and their range of sizes. A tree is walked against itself level by
level: a pair of nodes is dropped where even the largest overlap that bitmaps and
sizes allow is too small, and the pairs of their children come next. Pairs of
documents that pass the same bound are compared exactly.

The trees' root level is cut by keys, so that it can be dealt to workers: a
document goes under each of ``BANDS`` keys of ``ROWS`` min-hashes. Documents at the
least similarity 0.75 share no key with probability (1 - 0.75**4)**56 < 6e-10, and
nearer ones less; that is the only step that is not exact. ``exact`` takes as keys all
tokens of a set's prefix in hash order instead, of which two near sets always share
one; it links what the other way links, with more and larger groups. Equal sets are
one node. No key is left out, however many sets share it.

Documents reachable through keys form a candidate group. Groups are dealt to units of
about ``UNIT`` sets, and a task walks the tree of a unit. A group over ``UNIT`` sets is
cut into units around hubs; then the sets outside the group's largest component meet
all of its sets, block by block. Joins whose sides grow with the input are sort-merge
joins at every size.

Defined results: texts without words and nulls have 0 shingles and are linked with
nothing; fewer words than a shingle make one shingle of all of them; rows without
an id are linked with nothing and have a null component; repeated rows are linked;
rows of one id with other texts are documents of their own; texts of any length are
read whole; an empty table gives no rows; columns besides ``doc_id`` and ``text`` are
not read. The stage keeps one row of each group, the one with the least id (of rows
that share it the least text hash), and all rows without an id or without words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import discard, fresh, materialize, min_label_components, read_table

BANDS, ROWS, UNIT = 56, 4, 1000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_rng = np.random.default_rng(20240817)
MULT = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
FLIP = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
BASE = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """word -> 64-bit hash, kept while there are few."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < k:
        acc = np.uint64(len(h))
        for x in h:
            acc = _mix(np.array([acc * BASE + x]))[0]
        return np.array([acc], np.uint64)
    n = len(h) - k + 1
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= BASE
        acc += h[j:j + n]
        acc ^= acc >> np.uint64(29)
    return np.unique(_mix(acc))


def band_keys(tokens: np.ndarray) -> np.ndarray:
    """Keys (int64) of the bands of min-hashes of a set."""
    low = (tokens >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(least, ((low[None, at:at + 4096] ^ FLIP[:, None]) * MULT[:, None]).min(axis=1), out=least)
    part = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = _mix(key * BASE + part[:, j])
    return key.view(np.int64)


def _set_id(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def prefix_keys(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least tokens of a set of which it shares one with every set at least num/den like it."""
    return tokens[:len(tokens) - -(-len(tokens) * num // den) + 1].view(np.int64)


def shingle_sets(docs: DataFrame, k: int = 5, prefix: tuple[int, int] | None = None) -> DataFrame:
    """``(doc_id, th, n, cid, keys)``: hash of the text, number of shingles, id of the set, keys (null where the task gave them before).

    Keys are bands of min-hashes, or with ``prefix`` = (num, den) the prefix of the set.
    """

    def run(batches):
        known = _WordHashes()
        seen: set[int] = set()
        with np.errstate(over="ignore"):
            for b in batches:
                n, cid, keys = [], [], []
                for doc, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                    t = shingles(text, k, known)
                    c = _set_id(t) if len(t) else None
                    n.append(len(t))
                    cid.append(c)
                    if c is None or doc is None or c in seen:
                        keys.append(None)
                    else:
                        keys.append(prefix_keys(t, *prefix) if prefix else band_keys(t))
                        if len(seen) < 200_000:
                            seen.add(c)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "th", "n", "cid", "keys"])

    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text"), "text").mapInArrow(run, "doc_id bigint, th bigint, n bigint, cid bigint, keys array<bigint>")


class SignatureTree:
    """Bitmaps and size ranges over sets: leaves of ``LEAF`` neighbouring sets, each level above halves the number of nodes.

    ``met`` and ``pruned`` count the node pairs that a walk looked at and dropped.
    """

    LEAF = 8

    def __init__(self, sets: list[np.ndarray], labels: list[int] | None = None):
        self.sets, m = sets, len(sets)
        self.size = np.array([len(s) for s in sets])
        bits = 1 << int(np.clip(np.ceil(np.log2(32 * self.size.max() + 1)), 8, 16))
        self.bitmap = np.zeros((m, bits // 64), np.uint64)
        for i, s in enumerate(sets):
            row = np.zeros(bits, bool)
            row[(s & np.uint64(bits - 1)).astype(np.int64)] = True
            self.bitmap[i] = np.packbits(row).view(np.uint64)
        self.spare = self.size - np.bitwise_count(self.bitmap).sum(axis=1, dtype=np.int64)  # tokens that share another's bit
        #: sets of one label are linked already
        first: dict[int, int] = {}
        self.root = [first.setdefault(x, i) for i, x in enumerate(labels)] if labels else list(range(m))
        label = np.array(self.root)
        at, nodes = np.arange(0, m, self.LEAF), (self.bitmap, self.size, self.size, self.spare, label, label)
        self.levels = []
        while True:
            nodes = tuple(f.reduceat(x, at) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum), nodes, strict=True))
            self.levels.append(nodes)
            if len(nodes[0]) == 1:
                break
            at = np.arange(0, len(nodes[0]), 2)
        self.met = self.pruned = 0

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether any set under node i can be near enough to any under node j and is not linked with it, for pairs of nodes."""
        maps, lo, hi, spare, least, most = self.levels[level]
        open_ = (den * hi[i] >= num * lo[j]) & (den * hi[j] >= num * lo[i])
        open_ &= (least[i] != most[i]) | (least[j] != most[j]) | (least[i] != least[j])
        at = np.flatnonzero(open_)
        for part in np.array_split(at, max(1, len(at) // 512)):
            x, y = i[part], j[part]
            both = np.bitwise_count(maps[x] & maps[y]).sum(axis=1, dtype=np.int64) + np.minimum(spare[x], spare[y])
            both = np.minimum(both, np.minimum(hi[x], hi[y]))
            open_[part] = (num + den) * both >= num * (lo[x] + lo[y])
        self.met += len(i)
        self.pruned += int(len(i) - open_.sum())
        return open_

    def leaf_pairs(self, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves that are left when tree and tree are walked together, each leaf with itself first."""
        i = j = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            keep = self._possible(level, i, j, num, den)
            i, j = i[keep], j[keep]
            if level:
                below = len(self.levels[level - 1][0])
                i, j = (2 * i[:, None] + [0, 0, 1, 1]).ravel(), (2 * j[:, None] + [0, 1, 0, 1]).ravel()
                inside = (i <= j) & (j < below)
                i, j = i[inside], j[inside]
        order = np.argsort(i != j, kind="stable")
        return i[order], j[order]

    def _find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def _compare(self, i: int, j: int, num: int, den: int) -> None:
        """The sets of two leaves: the same bound for all pairs at once, then those left exactly."""
        m = len(self.sets)
        a, b = np.arange(i * self.LEAF, min(m, (i + 1) * self.LEAF)), np.arange(j * self.LEAF, min(m, (j + 1) * self.LEAF))
        ra, rb = np.array([self._find(x) for x in a]), np.array([self._find(x) for x in b])
        open_ = ra[:, None] != rb[None, :]
        if i == j:
            open_ = np.triu(open_)
        if not open_.any():
            return
        sa, sb = self.size[a][:, None], self.size[b][None, :]
        most = np.bitwise_count(self.bitmap[a][:, None, :] & self.bitmap[b][None, :, :]).sum(axis=2, dtype=np.int64) + np.minimum(self.spare[a][:, None], self.spare[b][None, :])
        most = np.minimum(most, np.minimum(sa, sb))
        xs, ys = np.nonzero(open_ & ((num + den) * most >= num * (sa + sb)))
        for k in np.argsort(-(most[xs, ys] / (sa[xs, 0] + sb[0, ys])), kind="stable"):  # the nearest first
            x, y = int(a[xs[k]]), int(b[ys[k]])
            rx, ry = self._find(x), self._find(y)
            if rx != ry:
                both = len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True))
                if den * both >= num * (len(self.sets[x]) + len(self.sets[y]) - both):
                    self.root[max(rx, ry)] = min(rx, ry)

    def links(self, num: int, den: int) -> list[int]:
        """For each set the least index of its component under links of at least num/den and equal labels."""
        for i, j in zip(*(x.tolist() for x in self.leaf_pairs(num, den)), strict=True):
            self._compare(i, j, num, den)
        return [self._find(x) for x in range(len(self.sets))]


def _walk(num: int, den: int):
    """A task's work: the tree of one unit, links as (cid, root cid), and for the least set of the unit the node pairs met and pruned."""

    def run(table: pa.Table) -> pa.Table:
        cids, labels, groups = (table.column(c).to_pylist() for c in ("cid", "label", "comp"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        order = sorted(range(len(sets)), key=lambda i: (groups[i], int(sets[i][0]), int(sets[i][len(sets[i]) // 2]), len(sets[i]), cids[i]))
        tree = SignatureTree([sets[i] for i in order], [labels[i] for i in order])
        a, roots = np.array([cids[i] for i in order]), tree.links(num, den)
        count = lambda n: pa.array([n] + [0] * (len(a) - 1), pa.int64())
        return pa.table({"cid": a, "root": a[np.array(roots)], "met": count(tree.met), "pruned": count(tree.pruned)})

    return run


def _walked(units: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """``(cid, root, met, pruned)`` from the trees of all ``units(cid, unit, comp, label)``."""
    placed = units.join(tokens.hint("merge"), "cid").select("unit", "cid", "comp", "label", "tokens")
    return placed.groupBy("unit").applyInArrow(_walk(num, den), "cid bigint, root bigint, met bigint, pruned bigint")


def _tokens(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """``(cid, tokens)`` of members(doc_id, th, cid), one row of docs for each."""

    def run(batches):
        known = _WordHashes()
        with np.errstate(over="ignore"):
            for b in batches:
                out = [(c, shingles(x, k, known).tobytes()) for c, x in zip(*(b.column(i).to_pylist() for i in (0, 1)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary()))], ["cid", "tokens"])

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text").join(members.hint("merge"), ["doc_id", "th"])
    # rows of one id and text are one document
    return picked.dropDuplicates(["doc_id", "th"]).select("cid", "text").mapInArrow(run, "cid bigint, tokens binary")


def near_classes(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, unit: int = UNIT, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows, and ``(cid, component_id, th)``: to each set its group's least id and the hash of that row's text."""
    sets = materialize(shingle_sets(docs, k, (num, den) if exact else None), "sets")
    reps = materialize(sets.where("n > 0 and doc_id is not null").groupBy("cid").agg(F.min(F.struct("doc_id", "th")).alias("rep")), "reps")
    walks = set_links(docs, sets, reps, k, num, den, unit)
    labels = min_label_components(walks.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = reps.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = named.groupBy("comp").agg(F.min("rep").alias("least"))
    return sets, materialize(named.join(least, "comp").select("cid", F.col("least.doc_id").alias("component_id"), F.col("least.th").alias("th")), "set-classes")


def near_components(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, unit: int = UNIT, exact: bool = False) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, a row for each row of ``docs(doc_id, text)``."""
    sets, classes = near_classes(docs, k, num, den, unit, exact)
    found = sets.select("doc_id", "n", "cid").join(classes.select("cid", "component_id"), "cid", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def set_links(docs: DataFrame, sets: DataFrame, reps: DataFrame, k: int, num: int, den: int, unit: int) -> DataFrame:
    """``(cid, root, met, pruned)``: links between sets, and how many node pairs the trees met and pruned."""
    # a set comes once from each task that met it
    entries = sets.where("keys is not null").select("cid", "keys").dropDuplicates(["cid"]).select("cid", F.explode("keys").alias("key"))
    shared = materialize(entries.groupBy("key").agg(F.min("cid").alias("lead"), F.max("cid").alias("last")).where("lead < last").select("key", "lead"), "keys")
    kept = materialize(entries.join(shared.hint("merge"), "key"), "kept")
    discard(shared)
    pairs = kept.where("cid <> lead").select(F.col("cid").alias("a"), F.col("lead").alias("b")).distinct()
    groups = materialize(min_label_components(pairs), "groups").withColumnRenamed("node", "cid")
    sizes = groups.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    members = materialize(groups.join(sizes, "comp").join(reps.hint("merge"), "cid").select("cid", "comp", "rep.*", (F.col("size") > unit).alias("cut")), "members")
    total = members.count()
    tokens = materialize(_tokens(docs, members.select("doc_id", "th", "cid"), k), "tokens")
    # whole groups are dealt to units
    dealt = F.pmod(F.xxhash64("comp"), F.lit(max(1, -(-total // unit))))
    links = materialize(_walked(members.where("not cut").select("cid", "comp", dealt.alias("unit"), F.col("cid").alias("label")), tokens, num, den), "links")
    cut = members.where("cut").select("cid", "comp")
    if cut.limit(1).count():
        links = _cut_groups(materialize(cut, "cut"), kept.select("cid", "key"), tokens, links, num, den, unit)
    return links


def _hub_units(cut: DataFrame, keys: DataFrame, unit: int) -> DataFrame:
    """Units of large groups: each set with its hub, the set it shares a key with that shares keys with most.

    Near copies of one text need not be near each other, but are to the text, which
    collides most; so a unit holds the hubs of its members as well. A quarter of the
    keys shows them: a hub at 0.77 shares one of 14 keys with all but 0.3 % of its copies,
    and what this step leaves apart the next one compares.
    """
    held = keys.where(F.pmod("key", F.lit(4)) == 0).join(cut.hint("merge"), "cid")
    weight = held.groupBy("key").agg(F.count(F.lit(1)).alias("w"))
    weighed = held.join(weight, "key").groupBy("cid").agg(F.sum("w").alias("w"))
    best = F.max(F.struct("w", F.negative("cid").alias("c")))
    hubs = held.join(weighed, "cid").groupBy("key").agg(best.alias("h"))
    own = materialize(held.select("cid", "key").join(hubs, "key").groupBy("cid").agg(F.max("h").alias("h")).select("cid", F.negative("h.c").alias("hub")), "hubs")
    parts = own.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / unit).alias("parts"))
    placed = own.join(parts, "hub").select("cid", "hub", F.xxhash64("hub", F.pmod(F.xxhash64("cid"), F.col("parts"))).alias("unit"))
    return placed.select("cid", "unit").union(placed.select(F.col("hub").alias("cid"), "unit")).distinct()


def _cut_groups(cut: DataFrame, keys: DataFrame, tokens: DataFrame, links: DataFrame, num: int, den: int, unit: int) -> DataFrame:
    """All links between components of groups that are too large for one task, added to ``links``."""
    hubs = _hub_units(cut, keys, unit).select("cid", "unit", F.col("unit").alias("comp"), F.col("cid").alias("label"))
    links = materialize(links.union(_walked(hubs, tokens, num, den)), "links")
    label = min_label_components(links.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b"))).toDF("cid", "label")
    label = materialize(cut.join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid")), "labels")
    # sets outside their group's largest component meet all sets of the group, block by block;
    # a tree over both blocks passes over what is linked already
    by_label = label.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("n"))
    main = by_label.groupBy("comp").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("out")).where("out > 0")
    open_ = label.join(main, "comp").withColumn("outside", F.col("label") != F.col("main"))
    blocks = lambda n: F.ceil(F.col(n) / unit).cast("int")
    own = lambda n, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), blocks(n)).cast("int")
    rows = open_.where("outside").select("cid", "comp", "label", own("out", 1).alias("i"), F.explode(F.sequence(F.lit(0), blocks("all") - 1)).alias("j"))
    every = open_.select("cid", "comp", "label", F.explode(F.sequence(F.lit(0), blocks("out") - 1)).alias("i"), own("all", 2).alias("j"))
    units = rows.union(every).select("cid", "comp", F.xxhash64("comp", "i", "j").alias("unit"), "label").distinct()
    return materialize(links.union(_walked(units, tokens, num, den)), "links")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read_table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group; rows without an id or without words stay."""
    _, classes = near_classes(docs)
    id_, th = fresh(docs.columns, "_id", "_th")
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = classes.select(F.col("component_id").alias(id_), F.col("th").alias(th)).distinct()
    # repeated rows of the kept id and text are one document
    named = docs.where(~alone).withColumns({id_: F.col("doc_id").cast("bigint"), th: F.xxhash64("text")})
    one = named.join(kept, [id_, th], "left_semi").dropDuplicates([id_, th])
    return one.select(docs.columns).unionByName(docs.where(alone))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS sh FROM w WHERE ws IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON d.doc_id = m.a
"""
