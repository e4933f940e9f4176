"""Interleaved sequences of text and media.

An HTML document is parsed into one ordered array of structs: text blocks and references to media by digest, with their
positions and captions. Stored media live in a table keyed by digest. A join on the digest resolves each reference, and
the sequence is put together again by position, so text, media and captions stay aligned.

Media are stored losslessly as binary greyscale images (PGM, one byte per sample).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowkit.llm.common import text_of

#: A payload has a positive multiple of UNIT bytes: rows of WIDTH samples.
UNIT, WIDTH = 576, 24
SCHEME = "sha256:"
_ITEM = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_BLOCKS = frozenset("address article aside blockquote br caption dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


class _Sequence(HTMLParser):
    """Ordered (kind, text, digest, caption); a figure's caption goes to all media of the figure."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[list] | None = None
        self.hidden = 0

    def flush(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.items.append(["text", text, None, None])
        self.text = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in ("img", "audio", "video", "source"):
            attrs = dict(attrs)
            if (src := attrs.get("src") or "").startswith(SCHEME):
                self.flush()
                self.items.append(["media", None, src.removeprefix(SCHEME), attrs.get("alt") or None])
                if self.figure is not None:
                    self.figure.append(self.items[-1])
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = []

    def handle_endtag(self, tag) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            if said := " ".join("".join(self.caption).split()):
                for item in self.figure or []:
                    item[3] = said
            self.caption = None
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def sequence_of(page: str | None) -> list[dict]:
    """The ordered items of one page; a null or empty page has none."""
    parser = _Sequence()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return [{"position": k, "kind": i[0], "text": i[1], "digest": i[2], "caption": i[3]} for k, i in enumerate(parser.items)]


def parse_sequences(pages: DataFrame, key: str, page: str) -> DataFrame:
    """key and items, the ordered array of structs (position, kind, text, digest, caption) of each page."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sequence_of(x) for x in part.column(1).to_pylist()], kind)], names=[key, "items"])

    return pages.select(key, page).mapInArrow(parse, f"{key} {pages.schema[key].dataType.simpleString()}, items {_ITEM}")


def media_references(sequences: DataFrame, key: str) -> DataFrame:
    """One row per media item: key, position, digest, caption."""
    item = F.explode(F.filter("items", lambda i: i["kind"] == "media"))
    return sequences.select(key, item.alias("item")).select(key, "item.position", "item.digest", "item.caption")


def resolve(references: DataFrame, store: DataFrame) -> DataFrame:
    """References with the columns of the store's row of that digest; one that the store lacks keeps nulls."""
    return references.join(store, "digest", "left")


def put_together(sequences: DataFrame, resolved: DataFrame, key: str, value: str) -> DataFrame:
    """sequences with the resolved value of each media item beside it; text items and unresolved media have null."""
    found = resolved.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("position", value))).alias("__found"))
    items = F.transform("items", lambda i: F.struct(i["position"].alias("position"), i["kind"].alias("kind"), i["text"].alias("text"), i["digest"].alias("digest"), i["caption"].alias("caption"), F.col("__found")[i["position"]].alias(value)))
    return sequences.join(found, key, "left").withColumn("items", items).drop("__found")


def payload_of(text: Column) -> Column:
    """UTF-8 bytes, padded with bytes 255 up to a positive multiple of UNIT."""
    n = F.octet_length(text)
    missing = F.when(n == 0, F.lit(UNIT)).otherwise(F.pmod(-n, F.lit(UNIT)))
    return F.concat(F.encode(text, "utf-8"), F.unhex(F.repeat(F.lit("FF"), missing)))


def stored(payload: Column) -> Column:
    """The payload as a PGM image WIDTH samples wide."""
    head = F.concat(F.lit(f"P5\n{WIDTH} "), (F.octet_length(payload) / WIDTH).cast("long").cast("string"), F.lit("\n255\n"))
    return F.concat(F.encode(head, "utf-8"), payload)


def samples_of(media: bytes) -> np.ndarray:
    """The samples of a stored image, rows by columns."""
    magic, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not a stored image")
    return np.frombuffer(samples, np.uint8).reshape(height, width)


def _features(media: bytes) -> str:
    """Mean, deviation and 16-bin histogram of the samples, and their mean change between rows."""
    x = samples_of(media).astype(np.int64)
    n, total, squares = x.size, int(x.sum()), int((x * x).sum())
    bins = ",".join(map(str, np.bincount((x >> 4).ravel(), minlength=16)))
    change = int(np.abs(np.diff(x, axis=0)).sum())
    return f"{total / n:.4f};{max(0, squares / n - (total / n) ** 2) ** 0.5:.4f};{bins};{change / max(1, n - WIDTH):.4f}"


def describe_store(store: DataFrame) -> DataFrame:
    """From (digest, media): sizes and digests of the stored form and of the samples read back from it, and features."""
    import hashlib
    import zlib

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                back = samples_of(media).tobytes()
                rows.append((digest, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), _features(media)))
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return store.select("digest", "media").mapInArrow(read, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def document_pages(docs: DataFrame) -> DataFrame:
    """Each document as a page: its text, then a figure that refers to its stored payload, captioned with the text's length in bytes."""
    text = text_of()
    digest = F.sha2(payload_of(text), 256)
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<article><p>"), escaped, F.lit(f'</p><figure><img src="{SCHEME}'), digest, F.lit('"><figcaption>bytes '), F.octet_length(text).cast("string"), F.lit("</figcaption></figure></article>"))
    return docs.select(F.col("doc_id"), page.alias("page"))


def media_store(docs: DataFrame) -> DataFrame:
    """digest and media of every distinct text: the stored payload, once for all texts that pad to it."""
    text = text_of()
    rows = docs.select(F.sha2(payload_of(text), 256).alias("digest"), F.col("doc_id"), text.alias("text"))
    return rows.groupBy("digest").agg(F.min("text").alias("text")).select("digest", stored(payload_of(F.col("text"))).alias("media"))


def document_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what was read back from each document's stored payload.

    Null texts count as empty and have a payload of 576 bytes of 255. Texts are whole. Repeated rows and ids give rows
    each; texts that pad to the same payload share one stored form. Other columns are ignored.
    """
    sequences = parse_sequences(document_pages(docs), "doc_id", "page")
    references = media_references(sequences, "doc_id")
    found = resolve(references, describe_store(media_store(docs)))
    n_bytes = F.regexp_extract("caption", r"bytes (\d+)", 1).cast("long")
    return found.select("doc_id", n_bytes.alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
