"""Interleaved document sequences with media payloads resolved by digest.

parse_sequences() turns html into ordered items: text items, and media items
that hold a reference, its digest if it names one, and a caption (of the figure,
else the alternative text). store_png() and read_png() keep any bytes losslessly as
8-bit gray samples. resolve() joins media rows to the items by digest and gives each
document its items in order again, so positions and captions stay aligned whatever
the join does with rows; resolve_references() does so for the media items alone,
without moving texts.

The join is keyed by digest; the media side has one row for each digest, found
by a partial aggregate and written first, so that both sides of the join are
plain exchanges that Spark can split where one digest holds a third of all
references. Null html or text counts as empty; a reference that no media row has
(or that names no digest) stays in its place, unresolved; a figure's caption without
media is a text; repeated rows keep apart by a row number; an empty table gives an
empty result. Texts of any length are stored and read whole. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import in_parts, materialize, small_batches, trim

ROW = 576
ITEMS = "array<struct<position:int,kind:string,text:string,reference:string,digest:string,caption:string>>"

_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][\w-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_BLOCK = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "article", "section", "figure", "blockquote", "br", "tr", "td"}
_MEDIA = {"img", "video", "audio", "source", "embed"}
SCHEME = "media:"


def parse_sequence(page: str | None) -> list[dict]:
    """Items in page order. A figure's caption goes to the media of that figure; else the alternative text is the caption."""
    items: list[dict] = []
    parts: list[str] = []
    figure: list[dict] | None = None
    caption: list[str] | None = None
    skip, at = "", 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            items.append({"position": len(items), "kind": "text", "text": text, "reference": None, "digest": None, "caption": None})
        parts.clear()

    def end_caption() -> None:
        nonlocal caption
        if caption is None:
            return
        if figure:
            text = " ".join(html.unescape("".join(caption)).split())
            for item in figure:
                item["caption"] = text
        else:
            parts.extend(caption)
            flush()
        caption = None

    page = page or ""
    for m in [*_TAG.finditer(page), None]:
        piece = page[at : m.start() if m else len(page)]
        if not skip:
            (parts if caption is None else caption).append(piece)
        if m is None:
            break
        at = m.end()
        if not m[2]:
            continue
        close, name = bool(m[1]), m[2].lower()
        if skip:
            skip = "" if close and name == skip else skip
        elif name in ("script", "style") and not close:
            skip = name
        elif name == "figcaption":
            end_caption()
            if not close:
                flush()
                caption = []
        elif name == "figure":
            end_caption()
            flush()
            figure = None if close else []
        elif name in _MEDIA and not close:
            values = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[3])}
            reference = values.get("src", "")
            if reference:
                flush()
                digest = reference[len(SCHEME) :] if reference.startswith(SCHEME) else None
                items.append({"position": len(items), "kind": "media", "text": None, "reference": reference, "digest": digest, "caption": values.get("alt")})
                if figure is not None:
                    figure.append(items[-1])
        elif name in _BLOCK and caption is None:
            flush()
    end_caption()
    flush()
    return items


def _parse(keep: list[str]):
    kind = pa.list_(pa.struct([("position", pa.int32()), *[(n, pa.string()) for n in ("kind", "text", "reference", "digest", "caption")]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, ["html"], 512, 4 << 20):
                items = pa.array([parse_sequence(x) for x in part.column("html").to_pylist()], kind)
                yield pa.record_batch([*[part.column(n) for n in keep], items], names=[*keep, "items"])
        trim()

    return run


def parse_sequences(pages: DataFrame, keep: tuple[str, ...] = ("row",)) -> DataFrame:
    """pages(html, ...) to the columns to keep and items."""
    small_batches(pages.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema.fields)
    return pages.select(*keep, "html").mapInArrow(_parse(list(keep)), f"{fields}, items {ITEMS}")


def padded(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of ROW."""
    return data + b"\xff" * (-len(data) % ROW if data else ROW)


def store_png(payload: bytes, width: int = ROW) -> bytes:
    """A gray 8-bit PNG whose samples are the payload, row by row."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height = len(payload) // width
    rows = np.zeros((height, width + 1), np.uint8)  # the first byte of a row: no filter
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, width)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def read_png(stored: bytes) -> np.ndarray:
    """Samples of a gray 8-bit PNG without filters, as height x width; checksums are verified."""
    at, data, width, height = 8, b"", 0, 0
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError(f"damaged {kind.decode('latin-1')} chunk")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not expected")
    return rows[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Mean, deviation and a 64-bit gradient hash of the samples in 9 x 8 cells."""
    height, width = samples.shape
    columns = np.add.reduceat(samples, np.arange(8) * width // 8, axis=1, dtype=np.int64)
    sums = np.add.reduceat(columns, np.minimum(np.arange(9) * height // 9, height - 1), axis=0)
    bits = (np.diff(sums, axis=0) > 0).ravel()
    return f"{samples.mean():.4f}:{samples.std():.4f}:{int(''.join('01'[b] for b in bits.tolist()), 2):016x}"


def page_of(text: str, mark: str, caption: str, again: str) -> str:
    """An article of the text's lines as paragraphs, the payload as a figure in their middle and as an image after them."""
    lines = [f"<p>{html.escape(x, quote=False)}</p>" for x in text.split("\n")]
    figure = f'<figure><img src="{SCHEME}{mark}" alt=""><figcaption>{html.escape(caption)}</figcaption></figure>'
    middle = len(lines) // 2
    return "".join(["<article>", *lines[:middle], figure, *lines[middle:], f'<img src="{SCHEME}{mark}" alt="{html.escape(again)}"></article>'])


def _attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in in_parts(batch, ["text"], 512, 4 << 20):
            out, made = [], {}
            for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                data = (text or "").encode()
                if data not in made:
                    payload = padded(data)
                    made[data] = hashlib.sha256(payload).hexdigest(), store_png(payload)
                mark, stored = made[data]
                page = page_of(text or "", mark, f"{len(data)} bytes of document {key}", f"document {key} again")
                out.append((key, len(data), page, mark, stored))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "html", "digest", "stored"])


def attach_payloads(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's text as a stored payload, and a page of it that refers to the payload by digest; row numbers tell repeated rows apart once it is written."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    stored = rows.mapInArrow(_attach, "doc_id long, n_bytes long, html string, digest string, stored binary")
    return stored.withColumn("row", F.monotonically_increasing_id())


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for mark, stored in zip(batch.column("digest").to_pylist(), batch.column("stored").to_pylist(), strict=True):
            samples = read_png(stored)
            payload = samples.tobytes()
            out.append((mark, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(samples)))
        if out:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[n.split()[0] for n in FEATURES.split(", ")])


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """media(digest, stored) to one row of features for each digest, from the stored bytes. Written, since it is joined."""
    read = media.select("digest", "stored").mapInArrow(_read_back, FEATURES)
    names = [n.split()[0] for n in FEATURES.split(", ")][1:]
    first = read.groupBy("digest").agg(*[F.min(n).alias(n) for n in names])
    return materialize(first, "features")


def resolve_references(references: DataFrame, media: DataFrame) -> DataFrame:
    """(row, references of position and digest) with the media items' rows of media(digest, ...) in order: (row, resolved of position and media)."""
    columns = [c for c in media.columns if c != "digest"]
    one = references.select("row", F.explode("references").alias("x")).select("row", "x.position", "x.digest")
    joined = one.join(media.select("digest", F.struct(*columns).alias("media")), "digest", "left")
    return joined.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("position", "media"))).alias("resolved"))


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """(row, items) with each media item's row of media(digest, ...) beside it: items become (item, media) in order."""
    columns = [c for c in media.columns if c != "digest"]
    exploded = sequences.select("row", F.explode("items").alias("item")).withColumn("digest", F.col("item.digest"))
    # items without a reference stay out of the join: a null key would gather them in one task
    plain = exploded.where("digest is null").select("row", "item", F.lit(None).cast(media.select(F.struct(*columns)).schema[0].dataType).alias("media"))
    joined = exploded.where("digest is not null").join(media.select("digest", F.struct(*columns).alias("media")), "digest", "left").select("row", "item", "media")
    both = joined.unionByName(plain).groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("item.position").alias("position"), "item", "media"))).alias("sequence"))
    return sequences.select("row").join(both, "row", "left")
