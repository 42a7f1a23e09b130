"""Language identification: logistic regression on character n-grams.

TF-IDF of hashed character 1- to 3-grams feeds a sparse multinomial logistic
regression, trained by follow-the-regularised-leader (FTRL-proximal) with elastic-net
penalties; a temperature, fitted on rows left out of the training, calibrates its
probabilities. Document frequencies come from all rows that may be learned from;
the regression is fitted on at most ``max_train`` of them, as evenly dealt over the
languages as their numbers allow, those with the least hash. Predictions read whole
texts, in pieces of a million characters where they are longer.

Defined results: null texts and texts without a letter are ``und`` with score 0; so
is everything if nothing can be learned; ties go to the first language by name;
repeated rows get equal results; an empty table gives no rows; other columns pass
through, but ``lang_pred`` and ``score`` are replaced. The stage keeps the columns that
it gets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import fresh, lookup, read_table

BUCKETS = 1 << 14
UNKNOWN = "und"
_SALT = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and counts of a whole text's 1- to 3-grams."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), 1 << 20):  # pieces overlap so that no gram is lost
        part = text[at:at + (1 << 20) + 2].lower()
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        own = 1 << 20
        h = c * np.uint32(_SALT[0])
        for n in range(3):
            if n:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(_SALT[n]) + c[n:] * np.uint32(_SALT[0])
            got = h[:own] if len(text) > own else h
            total += np.bincount(((got ^ (got >> np.uint32(16))) * np.uint32(0x7FEB352D)) >> np.uint32(18), minlength=BUCKETS)
    idx = np.flatnonzero(total)
    return idx, total[idx]


def _tfidf(idx: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[idx]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


class Model:
    """Weights (languages x buckets, and a bias), idf and temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, idf: np.ndarray, temperature: float):
        self.langs, self.weights, self.bias, self.idf, self.temperature = langs, weights, bias, idf, temperature

    def logits(self, idx: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.weights[:, idx] @ _tfidf(idx, counts, self.idf) + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        z = self.logits(*grams(text)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def _ftrl(rows, idf: np.ndarray, classes: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.5, epochs=3) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal; rows are (bucket numbers, counts, class)."""
    z, n = np.zeros((classes, BUCKETS + 1)), np.zeros((classes, BUCKETS + 1))

    def weights(zi, ni):
        w = (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) > l1, w, 0.0)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            idx, counts, y = rows[i]
            at = np.append(idx, BUCKETS)
            x = np.append(_tfidf(idx, counts, idf), 1.0)
            zi, ni = z[:, at], n[:, at]
            w = weights(zi, ni)
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * x[None, :]
            after = ni + g * g
            z[:, at] = zi + g - (np.sqrt(after) - np.sqrt(ni)) / alpha * w
            n[:, at] = after
    w = weights(z, n)
    return w[:, :BUCKETS], w[:, BUCKETS]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, among 81 from 1/8 to 8."""
    best = (np.inf, 1.0)
    for t in 2.0 ** np.linspace(-3, 3, 81):
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        nll = float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())
        best = min(best, (nll, float(t)))
    return best[1]


def quotas(counts: dict[str, int], most: int) -> dict[str, int]:
    """Rows to take of each language: all of the rare ones, equal shares of the others, ``most`` in all."""
    out, left = {}, most
    for i, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[lang] = min(counts[lang], max(1, left // (len(counts) - i)))
        left -= out[lang]
    return out


def fit(labelled: DataFrame, max_train: int = 3000) -> Model | None:
    """Learn from ``labelled(id, text, lang)``: frequencies from all rows, weights from at most ``max_train``.

    The sample holds equal numbers of each language, or all rows of a rare one. It
    reaches the driver as Arrow arrays, at most ``max_train * BUCKETS`` pairs of bucket
    and count, and is freed after the fit.
    """

    def frequencies(batches):
        df, rows = np.zeros(BUCKETS + 1, np.int64), 0
        with np.errstate(over="ignore"):
            for b in batches:
                for text in b.column(0).to_pylist():
                    df[grams(text)[0]] += 1
                    rows += 1
        df[BUCKETS] = rows
        idx = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(idx, pa.int32()), pa.array(df[idx], pa.int64())], ["bucket", "df"])

    usable = labelled.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    # one row per bucket reaches the driver: BUCKETS + 1 of them
    table = usable.select("text").mapInArrow(frequencies, "bucket int, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[table.column("bucket").to_numpy()] = table.column("df").to_numpy()
    rows = int(df[BUCKETS])
    if not rows:
        return None
    idf = np.log((1 + rows) / (1 + df[:BUCKETS])) + 1

    def features(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                got = [grams(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.int32()))], ["lang", "idx", "counts"])

    # a row per language, the model's classes
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    take = quotas(counts, max_train)
    # half as many again as wanted and 50 more pass the hash, so the exact number is cut from few rows
    chance = lookup(F.col("lang"), {x: min(1_000_000, int(1_000_000 * (1.5 * n + 50) / counts[x]) + 1) for x, n in take.items()})
    hashed = usable.select(F.xxhash64("id", "text").alias("h"), "id", "lang", "text").where(F.pmod("h", F.lit(1_000_000)) < chance)
    picked = hashed.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1_000_000)), "h", "id")))
    picked = picked.where(F.col("_rank") <= lookup(F.col("lang"), take))
    sample = picked.orderBy("_rank", "lang").select("lang", "text").mapInArrow(features, "lang string, idx array<int>, counts array<int>").toArrow()
    langs = sorted(counts)
    at = {x: i for i, x in enumerate(langs)}
    data = []
    for b in sample.to_batches():
        idx, n = b.column(1), b.column(2)
        data += [(idx[i].values.to_numpy(), n[i].values.to_numpy(), at[lang]) for i, lang in enumerate(b.column(0).to_pylist())]
    kept, left = [d for i, d in enumerate(data) if i % 5], data[::5]
    w, bias = _ftrl(kept or data, idf, len(langs))
    model = Model(langs, w.astype(np.float32), bias, idf, 1.0)
    if len(left) > 20:
        model.temperature = _temperature(np.array([model.logits(i, c) for i, c, _ in left]), np.array([y for _, _, y in left]))
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; a column of that name is replaced."""
    rows = docs.drop("lang_pred", "score")
    flag, = fresh(rows.columns, "_letters")
    rows = rows.withColumn(flag, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != flag) + ", lang_pred string, score double"

    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                texts, ok = b.column(b.schema.get_field_index("text")).to_pylist(), b.column(b.num_columns - 1).to_pylist()
                got = [model.predict(t) if k and model else (UNKNOWN, 0.0) for t, k in zip(texts, ok, strict=True)]
                names = b.schema.names[:-1]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame) -> Model | None:
    return fit(docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    told = identify(docs.select("doc_id", "text"), learned(docs))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.4) -> DataFrame:
    """Documents whose language is told with a score of at least ``least``."""
    told = identify(docs.select(F.struct(*docs.columns).alias("_row"), "text"), learned(docs))
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("_row.*")
