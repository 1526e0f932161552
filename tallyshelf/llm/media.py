"""Media columns: what binary values are, by signature.

An Aho-Corasick automaton finds magic bytes at any place in one pass.  At each
hit the format's validator checks structure and lengths; only confirmed media
count.  A confirmed hit at offset 0 corrects the declared type, confirmed hits
further inside are carved as embedded media.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.batches import slices
from tallyshelf.scratch import stage


class Value(bytes):
    """Bytes with what validators found out about them, so that many hits in one
    value don't search or walk the same stretch again."""

    def __init__(self, _: bytes = b""):
        self.places: dict[bytes, list[int]] = {}
        self.ends: dict[tuple[str, int], int] = {}

    def next(self, mark: bytes, at: int) -> int:
        """The first place of ``mark`` from ``at`` on (-1: none); all places are
        searched once."""
        if mark not in self.places:
            self.places[mark] = [m.start() for m in re.finditer(re.escape(mark), self)]
        found = self.places[mark]
        k = bisect_left(found, at)
        return found[k] if k < len(found) else -1

    def walk(self, kind: str, place: int, step: Callable[[Value, int], tuple[int, bool]]) -> int:
        """The end of the structure whose part lies at ``place`` (0: broken).  ``step``
        gives the next place and whether it is the end; 0 says broken."""
        path, end = [], None
        while (end := self.ends.get((kind, place))) is None:
            path.append(place)
            place, last = step(self, place)
            if last or not place:
                end = place
                break
        for p in path:
            self.ends[kind, p] = end
        return end


def _riff(data: Value, at: int, kind: bytes, first: bytes) -> int:
    if data[at + 8 : at + 12] != kind or at + 12 > len(data):
        return 0
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    place, seen = at + 12, False
    if end > len(data):
        return 0
    while place + 8 <= end:
        seen = seen or data[place : place + len(first)] == first
        size = int.from_bytes(data[place + 4 : place + 8], "little")
        place += 8 + size + size % 2
    return end - at if seen and place in (end, end + 1) else 0


def wav(data: Value, at: int) -> int:
    return _riff(data, at, b"WAVE", b"fmt ")


def webp(data: Value, at: int) -> int:
    return _riff(data, at, b"WEBP", b"VP8")


def _png_chunk(data: Value, place: int) -> tuple[int, bool]:
    size = int.from_bytes(data[place : place + 4], "big")
    end = place + 12 + size
    if end > len(data) or place + 12 > len(data) or zlib.crc32(memoryview(data)[place + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
        return 0, False
    return end, data[place + 4 : place + 8] == b"IEND"


def png(data: Value, at: int) -> int:
    """Chunks with right checksums from IHDR to IEND."""
    if data[at + 8 : at + 16] != b"\0\0\0\x0dIHDR":
        return 0
    end = data.walk("png", at + 8, _png_chunk)
    return end and end - at


def _gif_table(flags: int) -> int:
    return 3 << ((flags & 7) + 1) if flags & 0x80 else 0


def _gif_part(data: Value, place: int) -> tuple[int, bool]:
    """A sub-block (length byte and bytes)."""
    if place >= len(data):
        return 0, False
    return place + 1 + data[place], data[place] == 0


def _gif_block(data: Value, place: int) -> tuple[int, bool]:
    if place >= len(data):
        return 0, False
    mark = data[place]
    if mark == 0x3B:
        return place + 1, True
    if mark == 0x21:
        place += 2
    elif mark == 0x2C and place + 10 <= len(data):
        place += 11 + _gif_table(data[place + 9])
    else:
        return 0, False
    return data.walk("gif part", place, _gif_part), False


def gif(data: Value, at: int) -> int:
    """Logical screen, blocks and sub-blocks up to the trailer."""
    if len(data) < at + 14 or data[at + 4 : at + 5] not in (b"7", b"9") or data[at + 5 : at + 6] != b"a":
        return 0
    end = data.walk("gif", at + 13 + _gif_table(data[at + 10]), _gif_block)
    return end and end - at


def bmp(data: Value, at: int) -> int:
    if len(data) < at + 26:
        return 0
    size, reserved, offset, header = struct.unpack_from("<IIII", data, at + 2)
    return size if reserved == 0 and header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= offset <= size <= len(data) - at else 0


def _jpeg_segment(data: Value, place: int) -> tuple[int, bool]:
    if place + 4 > len(data) or data[place] != 0xFF:
        return 0, False
    size = int.from_bytes(data[place + 2 : place + 4], "big")
    after = place + 2 + size
    if size < 2 or after > len(data):
        return 0, False
    if data[place + 1] != 0xDA:
        return after, False
    end = data.next(b"\xff\xd9", after)
    return (end + 2, True) if end >= 0 else (0, False)


def jpeg(data: Value, at: int) -> int:
    """Segments up to the scan, then the end marker."""
    end = data.walk("jpeg", at + 2, _jpeg_segment)
    return end and end - at


def pdf(data: Value, at: int) -> int:
    if not (data[at + 5 : at + 6].isdigit() and data[at + 6 : at + 7] == b"."):
        return 0
    end = data.next(b"%%EOF", at)
    return end + 5 - at if end > 0 and 0 < data.next(b"startxref", at) < end else 0


def zip_(data: Value, at: int) -> int:
    """A local header, and an end record whose directory lies before it."""
    end = data.next(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(data):
        return 0
    size, offset, note = struct.unpack_from("<IIH", data, end + 12)
    ok = at + offset + size == end and data[at + offset : at + offset + 4] == b"PK\x01\x02" and end + 22 + note <= len(data)
    return end + 22 + note - at if ok else 0


def gzip_(data: Value, at: int) -> int:
    """A whole stream, unpacked piece by piece, with its checksum."""
    if data[at + 2 : at + 3] != b"\x08" or len(data) < at + 18 or data[at + 3] > 31:
        return 0
    unpack, place = zlib.decompressobj(31), at
    try:
        while not unpack.eof and place < len(data):
            piece = data[place : place + (1 << 12)]
            place += len(piece)
            while piece and not unpack.eof:
                unpack.decompress(piece, 1 << 20)
                piece = unpack.unconsumed_tail
    except zlib.error:
        return 0
    return place - len(unpack.unused_data) - at if unpack.eof else 0


def _flac_block(data: Value, place: int) -> tuple[int, bool]:
    if place + 4 > len(data):
        return 0, False
    after = place + 4 + int.from_bytes(data[place + 1 : place + 4], "big")
    return (after, bool(data[place] & 0x80)) if after <= len(data) else (0, False)


def flac(data: Value, at: int) -> int:
    """STREAMINFO first, whole metadata blocks, and a frame's sync code where audio
    follows; audio has no length and runs to the end."""
    if len(data) < at + 42 or data[at + 4] & 0x7F or data[at + 5 : at + 8] != b"\0\0\x22":
        return 0
    audio = data.walk("flac", at + 4, _flac_block)
    return len(data) - at if audio and (audio == len(data) or data[audio : audio + 2] in (b"\xff\xf8", b"\xff\xf9")) else 0


#: Magic bytes and validators; a validator returns the medium's length or 0.
FORMATS: dict[str, tuple[bytes, Callable[[Value, int], int]]] = {
    "audio/wav": (b"RIFF", wav),
    "image/webp": (b"RIFF", webp),
    "image/png": (b"\x89PNG\r\n\x1a\n", png),
    "image/gif": (b"GIF8", gif),
    "image/bmp": (b"BM", bmp),
    "image/jpeg": (b"\xff\xd8\xff", jpeg),
    "application/pdf": (b"%PDF-", pdf),
    "application/zip": (b"PK\x03\x04", zip_),
    "application/gzip": (b"\x1f\x8b", gzip_),
    "audio/flac": (b"fLaC", flac),
}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    words: dict[str, list[str]] = {}
    for kind, (magic, _) in FORMATS.items():
        words.setdefault(magic.decode("latin-1"), []).append(kind)
    out = ahocorasick.Automaton()
    for word, kinds in words.items():
        out.add_word(word, (len(word), kinds))
    out.make_automaton()
    return out


def sniff_bytes(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the confirmed media, outermost, in order.

    What lies inside a confirmed medium is not reported apart from it, unless
    that medium is the whole value: then its inside is carved."""
    data = Value(data)
    out: list[tuple[str, int, int]] = []
    until = 0
    for last, (size, kinds) in _automaton().iter(data.decode("latin-1")):
        at = last + 1 - size
        if at < until:
            continue
        for kind in kinds:
            if n := FORMATS[kind][1](data, at):
                out.append((kind, at, n))
                until = 0 if at == 0 and n == len(data) else at + n
                break
    return out


_FOUND = "detected string, corrected boolean, length long, embedded array<struct<type:string,offset:long,length:long>>"


def sniff(media: DataFrame, content: str = "content", declared: str = "declared_type") -> DataFrame:
    """``media`` with detected, corrected, length and embedded.

    detected is the type confirmed at offset 0 (null: none), length its length,
    corrected whether it differs from the declared type, embedded the confirmed
    media at later offsets.  Null content: all null but an empty embedded list.
    Columns of ``media`` that have these names already are replaced.
    """
    names = [c for c in media.columns if c not in ("detected", "corrected", "length", "embedded")]
    kinds = {f.name: f.dataType.simpleString() for f in media.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        for batch in slices(batches):
            detected, corrected, length, embedded = [], [], [], []
            for value, said in zip(batch.column(content), batch.column(declared).to_pylist(), strict=True):
                found = sniff_bytes(value.as_py()) if value.is_valid else []
                head = found[0] if found and found[0][1] == 0 else None
                detected.append(head and head[0])
                corrected.append(None if head is None else head[0] != said)
                length.append(head and head[2])
                embedded.append([{"type": t, "offset": o, "length": n} for t, o, n in found if o])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(detected, pa.string()), pa.array(corrected, pa.bool_()), pa.array(length, pa.int64()), pa.array(embedded, inner)], names=[*names, "detected", "corrected", "length", "embedded"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", " + _FOUND
    return media.select(*names).mapInArrow(run, schema)


def carve(sniffed: DataFrame, content: str = "content", key: str = "doc_id") -> DataFrame:
    """One row per embedded medium: key, type, offset, length, part (its bytes)."""
    one = sniffed.select(key, content, F.explode("embedded").alias("e"))
    return one.select(key, "e.type", "e.offset", "e.length", F.substring(F.col(content), (F.col("e.offset") + 1).cast("int"), F.col("e.length").cast("int")).alias("part"))


BLOCK = 576


def store_wav(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as 8-bit unsigned mono samples of a WAV file."""
    body = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def load_wav(media: bytes) -> bytes:
    """The samples of a WAV file, by its chunks."""
    place = 12
    while place + 8 <= len(media):
        size = int.from_bytes(media[place + 4 : place + 8], "little")
        if media[place : place + 4] == b"data":
            return media[place + 8 : place + 8 + size]
        place += 8 + size + size % 2
    raise ValueError("no data chunk")


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, content (a WAV file of the text's bytes, padded with 255 to
    a positive multiple of 576) and declared_type, which says nothing of it.

    ``docs`` needs doc_id and text; further columns are ignored.  Null texts count
    as empty, a block of padding; rows with equal or null doc_id are stored each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, stored = [], []
            for text in batch.column("text"):
                raw = (text.as_py() or "").encode("utf-8")
                sizes.append(len(raw))
                stored.append(store_wav(raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(stored, pa.binary()), pa.array(["application/octet-stream"] * len(sizes))], names=["doc_id", "n_bytes", "content", "declared_type"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, content binary, declared_type string")


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for doc, n, media, kind, length, inner in zip(*(batch.column(c) for c in ("doc_id", "n_bytes", "content", "detected", "length", "embedded")), strict=True):
            data = media.as_py()[: length.as_py()]
            if kind.as_py() != "audio/wav":
                raise ValueError("the stored form was not recognised")
            payload = load_wav(data)
            parts = ",".join(f"{e['type']}@{e['offset']}+{e['length']}" for e in inner.as_py())
            feature = f"{kind.as_py()};samples={len(payload)};mean={sum(payload) / len(payload):.6f};embedded=[{parts}]"
            rows.append((doc.as_py(), n.as_py(), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), sha256(data).hexdigest(), feature))
        columns = zip(*rows, strict=True) if rows else [()] * 8
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def op3(spark, sf_dir: str) -> DataFrame:
    """All texts as media: written, read back, sniffed and digested."""
    media = stage(text_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return sniff(media).mapInArrow(_digest, _DIGEST)
