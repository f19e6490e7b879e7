"""PNG pictures as arrays of RGB pixels, and back: all five row filters, all colour types and depths, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Fixed values of the format: samples of a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
GREY, RGB, PALETTE, GREY_ALPHA, RGB_ALPHA = 0, 2, 3, 4, 6


def _chunks(content: bytes) -> dict[bytes, bytes]:
    if not content.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, out = len(SIGNATURE), {}
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        out[kind] = out.get(kind, b"") + body
        at += 12 + size
    return out


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    x, y, z = abs(p - a), abs(p - b), abs(p - c)
    return a if x <= y and x <= z else b if y <= z else c


def unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """The bytes of rows (a filter's number and the filtered bytes each); ``step`` bytes are a pixel."""
    out = np.zeros((len(rows), rows.shape[1] - 1), np.uint8)
    above = np.zeros(rows.shape[1] - 1, np.uint8)
    for i, row in enumerate(rows):
        kind, given = int(row[0]), row[1:]
        if kind == 0:
            out[i] = given
        elif kind == 1:  # each byte adds to the pixel before: running sums by sample
            for k in range(step):
                out[i, k::step] = np.cumsum(given[k::step], dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            out[i] = given + above
        elif kind in (3, 4):
            line, up, made = given.tolist(), above.tolist(), [0] * step + [0] * len(given)
            over = [0] * step + up
            for j, x in enumerate(line):
                left = made[j]
                made[j + step] = (x + ((left + up[j]) >> 1 if kind == 3 else _paeth(left, up[j], over[j]))) & 255
            out[i] = made[step:]
        else:
            raise ValueError(f"unknown filter {kind}")
        above = out[i]
    return out


def decode(content: bytes) -> np.ndarray:
    """(height, width, 3) bytes; what is transparent shows white."""
    parts = _chunks(content)
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if interlaced:
        raise ValueError("interlaced pictures are not read")
    samples = SAMPLES[colour]
    size = -(-width * samples * depth // 8)
    data = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8)
    rows = unfiltered(data[: height * (size + 1)].reshape(height, size + 1), max(1, samples * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]  # the high byte of each sample
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)
        if colour == GREY:
            rows = (rows.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    pixels = rows[:, : width * samples].reshape(height, width, samples)
    alpha = None
    if colour == PALETTE:
        table = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)
        if b"tRNS" in parts:
            clear = np.full(len(table), 255, np.uint8)
            clear[: len(parts[b"tRNS"])] = np.frombuffer(parts[b"tRNS"], np.uint8)
            alpha = clear[pixels[..., 0]]
        pixels = table[pixels[..., 0]]
    elif colour in (GREY_ALPHA, RGB_ALPHA):
        pixels, alpha = pixels[..., :-1], pixels[..., -1]
    pixels = np.broadcast_to(pixels, (height, width, 3)) if pixels.shape[2] == 1 else pixels
    if alpha is not None:
        a = alpha[..., None].astype(np.uint16)
        pixels = ((pixels * a + 255 * (255 - a) + 127) // 255).astype(np.uint8)
    return np.ascontiguousarray(pixels)


def encode(pixels: np.ndarray) -> bytes:
    """An RGB picture; each row is filtered by the one above, which costs least to undo."""
    height, width, _ = pixels.shape
    flat = pixels.astype(np.uint8).reshape(height, 3 * width)
    rows = np.full((height, 3 * width + 1), 2, np.uint8)
    rows[:, 1:] = flat - np.vstack([np.zeros((1, 3 * width), np.uint8), flat[:-1]])

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, RGB, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def painted(pixels: np.ndarray, boxes: list[tuple[float, float, float, float]], colour: tuple[int, int, int] = (0, 0, 0)) -> np.ndarray:
    """The picture with boxes (left, top, right, bottom) filled, cut to it; those outside of it do nothing."""
    height, width, _ = pixels.shape
    out = pixels.copy()
    for left, top, right, bottom in boxes:
        x0, y0, x1, y1 = max(0, int(left)), max(0, int(top)), min(width, int(np.ceil(right))), min(height, int(np.ceil(bottom)))
        if x0 < x1 and y0 < y1:
            out[y0:y1, x0:x1] = colour
    return out


def luminance(pixels: np.ndarray) -> np.ndarray:
    return pixels[..., 0] * 0.299 + pixels[..., 1] * 0.587 + pixels[..., 2] * 0.114
