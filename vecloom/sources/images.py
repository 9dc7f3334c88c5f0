"""Whether image files are whole, by their own structure: chunks and checksums of PNG, segments of JPEG, sizes of BMP and WebP."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PNG = bytes.fromhex("89504E470D0A1A0A")
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # fixed values: samples of a pixel by PNG colour type


def _png(raw: bytes) -> str | None:
    at, pixels, size, kinds = len(_PNG), zlib.decompressobj(), 0, []
    expected = None
    while at < len(raw):
        if at + 12 > len(raw):
            return "png: a chunk is cut off"
        (length,), kind = struct.unpack(">I", raw[at : at + 4]), raw[at + 4 : at + 8]
        end = at + 12 + length
        if end > len(raw):
            return "png: a chunk is cut off"
        if zlib.crc32(raw[at + 4 : end - 4]) != struct.unpack(">I", raw[end - 4 : end])[0]:
            return "png: a checksum is wrong"
        kinds.append(kind)
        data = raw[at + 8 : end - 4]
        if kind == b"IHDR":
            if len(data) != 13 or data[9] not in _CHANNELS:
                return "png: the header is wrong"
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", data)
            expected = None if interlaced else height * (1 + (width * depth * _CHANNELS[colour] + 7) // 8)
        if kind == b"IDAT":
            try:
                while data:  # piece by piece, so that a small file cannot fill the memory
                    size += len(pixels.decompress(data, 1 << 20))
                    data = pixels.unconsumed_tail
            except zlib.error:
                return "png: the pixels do not inflate"
        at = end
        if kind == b"IEND":
            break
    if kinds[:1] != [b"IHDR"] or b"IDAT" not in kinds or kinds[-1] != b"IEND":
        return "png: a part is missing"
    if not pixels.eof or (expected is not None and size != expected):
        return "png: pixels are missing"
    return None


def _jpeg(raw: bytes) -> str | None:
    at, framed, scanned = 2, False, False
    while at + 1 < len(raw):
        if raw[at] != 0xFF:
            return "jpeg: no marker where one is due"
        mark = raw[at + 1]
        if mark == 0xFF:  # fill
            at += 1
        elif mark == 0xD9:
            return None if framed and scanned else "jpeg: a part is missing"
        elif mark == 0x01 or 0xD0 <= mark <= 0xD8:
            at += 2
        else:
            if at + 4 > len(raw):
                break
            (length,) = struct.unpack(">H", raw[at + 2 : at + 4])
            if length < 2 or at + 2 + length > len(raw):
                break
            framed |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
            at += 2 + length
            if mark == 0xDA:  # coded pixels follow, up to a marker that is neither stuffing nor a restart
                scanned = True
                at = raw.find(b"\xff", at)
                while 0 <= at < len(raw) - 1 and (raw[at + 1] == 0 or 0xD0 <= raw[at + 1] <= 0xD7):
                    at = raw.find(b"\xff", at + 2)
                if at < 0:
                    break
    return "jpeg: it is cut off"


def _sized(raw: bytes, name: str, size: int) -> str | None:
    return None if size <= len(raw) else f"{name}: it is cut off"


def fault(raw: bytes | None) -> str | None:
    """What is wrong with the bytes of an image file, or None.

    PNG pixels are inflated and counted; JPEG pixels are walked, not decoded, so damage within them that leaves the
    markers in place is for the detector to find.
    """
    if not raw:
        return "empty"
    if raw.startswith(_PNG):
        return _png(raw)
    if raw.startswith(b"\xff\xd8\xff"):
        return _jpeg(raw)
    if raw.startswith(b"BM") and len(raw) >= 26:
        return _sized(raw, "bmp", struct.unpack("<I", raw[2:6])[0])
    if raw.startswith(b"RIFF") and raw[8:12] == b"WEBP":
        return _sized(raw, "webp", 8 + struct.unpack("<I", raw[4:8])[0])
    return "no image of a known kind"


def image_fault(content: Column) -> Column:
    """fault() of a binary column, over Arrow batches."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda raw: fault(None if raw is None else bytes(raw)))

    return run(content)
