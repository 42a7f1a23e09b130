"""Interleaved document sequences with media columns.

HTML is parsed into an ordered sequence of text and media-reference items; a
reference names its payload by digest and carries its caption. References are joined
to a store of payloads by digest, and the sequence is put together again by position,
so text, media and captions stay aligned. Payloads are kept as 8-bit greyscale PNG,
which is lossless, in rows of 64 samples.

Defined results: null HTML gives no items; references without a stored payload keep
their place with null media; a payload may be stored more than once and resolves
once; rows that share all keys share one sequence; markup that ends early is read as
far as it goes; texts of any length are read whole; empty tables give no rows; columns
besides the keys and the HTML are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import materialize, read_table, text_bytes

ROW = 64
MEDIA_TAGS = ("img", "video", "audio", "source")
SCHEME = "media:sha256/"


class _Items(HTMLParser):
    """Text runs and media references in document order; a figcaption belongs to its figure's last medium."""

    BLOCKS = frozenset(("p", "div", "article", "section", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "figure", "blockquote", "pre", "br", "ul", "ol", "table", "title"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.run, self.skip, self.caption = [], [], 0, None

    def flush(self):
        text = "".join(self.run)
        self.run = []
        if text.strip():
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in MEDIA_TAGS and (src := dict(attrs).get("src")):
            self.flush()
            self.items.append(["media", None, src, dict(attrs).get("alt")])
        elif tag in self.BLOCKS:
            self.flush()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = "".join(self.caption).strip(), None
            last = next((x for x in reversed(self.items) if x[0] == "media"), None)
            if last:
                last[3] = text
            elif text:
                self.items.append(["text", text, None, None])
        elif tag in self.BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            (self.run if self.caption is None else self.caption).append(data)


def parse_html(pages: DataFrame, keys: list[str] | str, html: str, digest_text: bool = False) -> DataFrame:
    """``(*keys, pos, kind, text, src, caption)``, a row per item in document order.

    ``digest_text`` gives the first half of a text's MD5 in its place, for sequences that
    need not carry the texts themselves.
    """
    keys = [keys] if isinstance(keys, str) else keys

    def run(batches):
        for b in batches:
            at, rows = [], ([], [], [], [], [])
            for i, page in enumerate(b.column(b.num_columns - 1).to_pylist()):
                p = _Items()
                p.feed(page or "")
                p.close()
                p.flush()
                for pos, (kind, text, src, caption) in enumerate(p.items):
                    if digest_text and text is not None:
                        text = hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()[:16]
                    at.append(i)
                    for col, v in zip(rows, (pos, kind, text, src, caption), strict=True):
                        col.append(v)
            types = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            own = [c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(rows, types, strict=True))], [*keys, "pos", "kind", "text", "src", "caption"])

    read = pages.select(*keys, F.col(html))
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema[:-1])
    return read.mapInArrow(run, f"{own}, pos int, kind string, text string, src string, caption string")


def to_png(payload: bytes) -> bytes:
    """The payload's bytes as samples of a greyscale image, ROW wide."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)  # each row begins with filter 0
    raw[:, 1:] = rows

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw.tobytes(), 6)) + part(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    at, data = 8, []
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at:at + 8])
        if kind == b"IHDR":
            width, height = struct.unpack(">II", media[at + 8:at + 16])
        elif kind == b"IDAT":
            data.append(media[at + 8:at + 8 + n])
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def store_media(payloads: DataFrame) -> DataFrame:
    """Write ``payloads(digest, payload)`` to the media store; returns ``(digest, media)`` as stored."""

    def run(batches):
        seen: set[str] = set()  # a task stores a payload once; the same one of another task resolves to either
        for b in batches:
            out = []
            for d, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if d not in seen:
                    out.append((d, to_png(p)))
                    if len(seen) < 200_000:
                        seen.add(d)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], ["digest", "media"])

    return materialize(payloads.select("digest", "payload").mapInArrow(run, "digest string, media binary"), "media")


def media_features(store: DataFrame) -> DataFrame:
    """A row per digest, computed from the stored bytes: sizes, hashes and ``feature``.

    The feature is the mean and deviation of the samples and their histogram over
    16 bins, in thousandths.
    """

    def run(batches):
        for b in batches:
            rows = [[] for _ in range(7)]
            for d, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = from_png(m)
                x = np.frombuffer(p, np.uint8)
                bins = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
                feature = f"mean={x.mean():.3f};std={x.std():.3f};hist=" + ",".join(map(str, bins))
                for col, v in zip(rows, (d, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature), strict=True):
                    col.append(v)
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    read = store.mapInArrow(run, "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    return read.dropDuplicates(["digest"])


def resolve(items: DataFrame, store: DataFrame) -> DataFrame:
    """``items`` with the columns of ``store`` where a reference's digest is stored; other items meet no store.

    The store is dealt by digest as it was when its repetitions were dropped. Many
    references may name one payload; Spark splits such a key where it outgrows a task.
    """
    digest = F.when(F.col("src").startswith(SCHEME), F.substring(F.col("src"), len(SCHEME) + 1, 64))
    named = items.withColumn("digest", digest)
    found = named.where("digest is not null").join(store, "digest", "left")
    return found.unionByName(named.where("digest is null"), allowMissingColumns=True)


def sequences(resolved: DataFrame, keys: list[str] | str, columns: list[str]) -> DataFrame:
    """``(*keys, items)``: each document's items in order as structs of pos, kind, text, caption and ``columns``."""
    return resolved.groupBy(keys).agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "text", "caption", *columns))).alias("items"))


def as_page(text: Column, digest: Column, caption: Column) -> Column:
    """HTML of a text: its lines as paragraphs, its payload as a figure after the first one and as a picture at the end."""
    safe = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.transform(F.split(safe, "\n", -1), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>")))
    src = F.concat(F.lit(f'src="{SCHEME}'), digest, F.lit('"'))
    figure = F.concat(F.lit("<figure><img "), src, F.lit("/><figcaption>"), caption, F.lit("</figcaption></figure>"))
    rest = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), "")
    return F.concat(F.lit("<article>"), F.get(lines, F.lit(0)), figure, rest, F.lit("<img "), src, F.lit(' alt="again: '), caption, F.lit('"/></article>'))


MEDIA = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op1_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page of paragraphs and two references to its payload, taken apart and put together again.

    The contract's columns are those of the figure's medium. ``n_items``, ``n_texts`` and
    ``sequence_sha256`` tell of the whole sequence; ``aligned`` says that each reference
    kept its caption and found the document's payload.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    body = text_bytes(F.col("text"))
    size = F.octet_length(body)
    pad = F.when(size == 0, ROW).otherwise(F.pmod(-size, F.lit(ROW)))
    padded = docs.withColumn("n_bytes", size.cast("bigint")).withColumn("payload", F.concat(body, F.unhex(F.repeat(F.lit("00"), pad.cast("int")))))
    media = padded.withColumn("digest", F.sha2("payload", 256))
    store = media_features(store_media(media))
    caption = F.concat(F.lit("text of "), F.col("n_bytes").cast("string"), F.lit(" bytes"))
    keys = ["doc_row", "doc_id", "n_bytes"]
    pages = media.select(F.monotonically_increasing_id().alias("doc_row"), "doc_id", "n_bytes", as_page(F.col("text"), F.col("digest"), caption).alias("html"))
    items = parse_html(pages, keys, "html", digest_text=True)
    # the later references of a page need their payload's hash only
    met = resolve(items, store).withColumns({c: F.when(~F.col("caption").startswith("again: "), F.col(c)) for c in MEDIA if c != "payload_sha256"})
    whole = sequences(met, keys, MEDIA)
    found = F.filter("items", lambda x: x["kind"] == "media")
    told = F.transform("items", lambda x: F.concat_ws("|", x["pos"].cast("string"), x["kind"], x["text"], x["caption"], x["payload_sha256"]))
    figure, again = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    aligned = (F.size(found) == 2) & (figure["caption"] == caption) & (again["caption"] == F.concat(F.lit("again: "), caption)) & (figure["payload_sha256"] == again["payload_sha256"])
    return whole.select(
        "doc_id", "n_bytes", *[figure[c].alias(c) for c in MEDIA],
        F.size("items").alias("n_items"), (F.size("items") - F.size(found)).alias("n_texts"), F.sha2(F.array_join(told, "\n"), 256).alias("sequence_sha256"), F.coalesce(aligned, F.lit(False)).alias("aligned"),
    )
