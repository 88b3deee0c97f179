"""Metadata of media and documents, marks of their origin, and bytes that do not belong: parsers of bytes in Arrow batches.

Input: files (key, path, content BINARY). Defined results: null, empty and unknown contents give no rows; what is cut off is read
as far as it goes; a file that does not parse gives what was read before.
"""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame

PNG = b"\x89PNG\r\n\x1a\n"
# Tags of EXIF that are told; frames of ID3; chunks that a PNG may hold.
EXIF = {0x010F: "make", 0x0110: "model", 0x0131: "software", 0x0132: "modified", 0x013B: "artist", 0x8298: "copyright", 0x9003: "taken"}
ID3 = {b"TIT2": "title", b"TPE1": "artist", b"TALB": "album", b"TYER": "year", b"TDRC": "year", b"TENC": "encoder", b"TSSE": "encoder"}
PNG_CHUNKS = {b"IHDR", b"PLTE", b"IDAT", b"IEND", b"tRNS", b"gAMA", b"cHRM", b"sRGB", b"iCCP", b"sBIT", b"bKGD", b"hIST", b"pHYs", b"sPLT", b"tIME", b"tEXt", b"zTXt", b"iTXt", b"eXIf", b"acTL", b"fcTL", b"fdAT", b"caBX"}

Pairs = Iterator[tuple[str, str]]


def png_chunks(c: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(c):
        n, kind = struct.unpack(">I4s", c[at : at + 8])
        yield kind, c[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IEND":
            return


def png(c: bytes) -> Pairs:
    for kind, data in png_chunks(c):
        if kind == b"IHDR" and len(data) >= 8:
            yield "size", "{}x{}".format(*struct.unpack(">II", data[:8]))
        elif kind in (b"tEXt", b"zTXt", b"iTXt"):
            name, _, value = data.partition(b"\0")
            if kind == b"zTXt":
                try:
                    value = zlib.decompressobj().decompress(value[1:], 65536)
                except zlib.error:
                    value = b""
            elif kind == b"iTXt":
                value = value[2:].split(b"\0", 2)[-1]
            yield "text." + name.decode("latin-1"), value.decode("utf-8", "replace")[:500]
        elif kind == b"eXIf":
            yield from exif(data)


def exif(tiff: bytes) -> Pairs:
    """Tags of a TIFF header; whether there is a place, and which."""
    if tiff[:2] not in (b"II", b"MM"):
        return
    order = "<" if tiff[:2] == b"II" else ">"
    get = lambda fmt, at: struct.unpack_from(order + fmt, tiff, at)

    def entries(at: int) -> Iterator[tuple[int, int, int, int]]:
        (n,) = get("H", at)
        for i in range(min(n, 500)):
            yield (*get("HHI", at + 2 + 12 * i), at + 10 + 12 * i)

    def text(n: int, at: int) -> str:
        where = at if n <= 4 else get("I", at)[0]
        return tiff[where : where + n].split(b"\0")[0].decode("latin-1", "replace").strip()

    try:
        todo, seen = [get("I", 4)[0]], set()
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            for tag, kind, n, place in entries(at):
                if tag in EXIF and kind == 2:
                    yield EXIF[tag], text(n, place)
                elif tag == 0x8769:
                    todo.append(get("I", place)[0])
                elif tag == 0x8825:
                    gps = {t: (k, m, p) for t, k, m, p in entries(get("I", place)[0])}
                    for name, ref in ((2, 1), (4, 3)):
                        if name in gps:
                            where = get("I", gps[name][2])[0]
                            d = [a / b if b else 0.0 for a, b in (get("II", where + 8 * i) for i in range(3))]
                            sign = -1 if ref in gps and tiff[gps[ref][2] : gps[ref][2] + 1] in (b"S", b"W") else 1
                            yield ("latitude" if name == 2 else "longitude"), f"{sign * (d[0] + d[1] / 60 + d[2] / 3600):.5f}"
    except struct.error:
        return


def jpeg(c: bytes) -> Pairs:
    at = 2
    while at + 4 <= len(c) and c[at] == 0xFF:
        mark, n = c[at + 1], struct.unpack(">H", c[at + 2 : at + 4])[0]
        data = c[at + 4 : at + 2 + n]
        if mark == 0xE1 and data[:6] == b"Exif\0\0":
            yield from exif(data[6:])
        elif mark == 0xFE:
            yield "comment", data.decode("utf-8", "replace")[:500]
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and len(data) >= 5:
            yield "size", "{1}x{0}".format(*struct.unpack(">HH", data[1:5]))
        elif mark == 0xDA:
            return
        at += 2 + n


def gif(c: bytes) -> Pairs:
    if len(c) >= 10:
        yield "size", "{}x{}".format(*struct.unpack("<HH", c[6:10]))
    for m in re.finditer(rb"\x21\xfe(.)", c, re.S):
        yield "comment", c[m.end() : m.end() + m.group(1)[0]].decode("latin-1")


def webp(c: bytes) -> Pairs:
    at = 12
    while at + 8 <= len(c):
        kind, n = c[at : at + 4], struct.unpack("<I", c[at + 4 : at + 8])[0]
        if kind == b"VP8X" and len(c) >= at + 18:
            yield "size", f"{1 + int.from_bytes(c[at + 12 : at + 15], 'little')}x{1 + int.from_bytes(c[at + 15 : at + 18], 'little')}"
        elif kind == b"EXIF":
            yield from exif(c[at + 8 : at + 8 + n].removeprefix(b"Exif\0\0"))
        at += 8 + n + (n & 1)


def pdf(c: bytes) -> Pairs:
    yield "version", c[5:8].decode("latin-1")
    for name in (b"Title", b"Author", b"Creator", b"Producer", b"CreationDate", b"ModDate"):
        if m := re.search(rb"/" + name + rb"\s*\(((?:[^()\\]|\\.)*)\)", c):
            raw = m.group(1)
            yield name.decode().lower(), (raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1"))[:500]
    if re.search(rb"/(?:JavaScript|JS)\b", c):
        yield "active", "javascript"


def id3(c: bytes) -> Pairs:
    size = int("".join(f"{b & 0x7F:07b}" for b in c[6:10]), 2) if len(c) >= 10 else 0
    at, end = 10, min(len(c), 10 + size)
    while at + 10 <= end and c[at : at + 4].strip(b"\0"):
        n = int.from_bytes(c[at + 4 : at + 8], "big") if c[3] < 4 else int("".join(f"{b & 0x7F:07b}" for b in c[at + 4 : at + 8]), 2)
        if name := ID3.get(c[at : at + 4]):
            data = c[at + 10 : at + 10 + n]
            yield name, data[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(data[:1][0] if data else 0, "utf-8"), "replace").strip("\0")
        at += 10 + max(n, 0)


def office(c: bytes) -> Pairs:
    try:
        with zipfile.ZipFile(BytesIO(c)) as z:
            for part in ("docProps/core.xml", "docProps/app.xml"):
                if part in z.namelist():
                    with z.open(part) as f:
                        text = f.read(1 << 20).decode("utf-8", "replace")
                    for tag in ("creator", "lastModifiedBy", "title", "created", "modified", "Application", "Company"):
                        if m := re.search(rf"<(?:\w+:)?{tag}\b[^>]*>([^<]*)<", text):
                            yield tag, m.group(1)
            if any(n.endswith("vbaProject.bin") for n in z.namelist()):
                yield "active", "macros"
    except (zipfile.BadZipFile, KeyError, NotImplementedError, EOFError, zlib.error):
        return


READERS: list[tuple[Callable[[bytes], bool], str, Callable[[bytes], Pairs]]] = [
    (lambda c: c[:8] == PNG, "png", png), (lambda c: c[:3] == b"\xff\xd8\xff", "jpeg", jpeg), (lambda c: c[:4] == b"GIF8", "gif", gif), (lambda c: c[:4] == b"RIFF" and c[8:12] == b"WEBP", "webp", webp),
    (lambda c: c[:5] == b"%PDF-", "pdf", pdf), (lambda c: c[:3] == b"ID3", "mp3", id3), (lambda c: c[:4] == b"PK\x03\x04", "office", office),
]
# Marks of how a file was made.
ORIGINS = [
    ("provenance manifest", re.compile(rb"c2pa|jumb[fd]|contentauth:urn")), ("declared synthetic", re.compile(rb"trainedAlgorithmicMedia|compositeWithTrainedAlgorithmicMedia")),
    ("generator", re.compile(rb"(?i)stable.?diffusion|midjourney|dall.?e|comfyui|automatic1111|firefly")), ("parameters", re.compile(rb"(?s)Steps: \d+, Sampler: ")),
]


def trailing(c: bytes) -> int | None:
    """Bytes behind the end of a picture, archive or document; null where the end is not known."""
    if c[:8] == PNG:
        at = 8
        while at + 8 <= len(c):
            n, kind = struct.unpack(">I4s", c[at : at + 8])
            at += 12 + n
            if kind == b"IEND":
                return max(0, len(c) - at)
        return None
    if c[:3] == b"\xff\xd8\xff":
        at = c.rfind(b"\xff\xd9")
        return len(c) - at - 2 if at >= 0 else None
    if c[:4] == b"GIF8":
        at = c.rfind(b"\x00\x3b")
        return len(c) - at - 2 if at >= 0 else None
    if c[:2] == b"BM" and len(c) >= 6:
        return max(0, len(c) - struct.unpack("<I", c[2:6])[0])
    if c[:4] == b"RIFF" and len(c) >= 8:
        n = struct.unpack("<I", c[4:8])[0]
        return max(0, len(c) - 8 - n - (n & 1))
    if c[:5] == b"%PDF-":
        at = c.rfind(b"%%EOF")
        return len(c[at + 5 :].strip()) if at >= 0 else None
    if c[:4] == b"PK\x03\x04":
        at = c.rfind(b"PK\x05\x06")
        return max(0, len(c) - at - 22 - struct.unpack("<H", c[at + 20 : at + 22])[0]) if at >= 0 and at + 22 <= len(c) else None
    return None


def _rows(files: DataFrame, make: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *r) for k, c in zip(b["key"], b["content"], strict=True) if c is not None and len(c) for r in make(bytes(c))]
            yield pd.DataFrame(rows, columns=["key", *names])

    return files.select("key", "content").mapInPandas(each, f"key {dict(files.dtypes)['key']}, {schema}")


def metadata(files: DataFrame) -> DataFrame:
    """(key, form, field, value)."""

    def make(c: bytes) -> Iterator[tuple]:
        for fits, form, read in READERS:
            if fits(c):
                yield from ((form, f, v) for f, v in read(c))

    return _rows(files, make, "form string, field string, value string")


def origins(files: DataFrame) -> DataFrame:
    """(key, mark): marks of provenance manifests and of generators."""
    return _rows(files, lambda c: ((name,) for name, rx in ORIGINS if rx.search(c)), "mark string")


def hidden(files: DataFrame) -> DataFrame:
    """(key, what, bytes): bytes behind the end, chunks that a PNG does not have."""

    def make(c: bytes) -> Iterator[tuple]:
        if n := trailing(c):
            yield "trailing", n
        if c[:8] == PNG:
            yield from ((f"chunk {k.decode('latin-1')}", len(d)) for k, d in png_chunks(c) if k not in PNG_CHUNKS)

    return _rows(files, make, "what string, bytes bigint")
