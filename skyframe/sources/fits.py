"""Image files: header cards, pixel arrays, a reader for directories and a synthetic field."""

from __future__ import annotations

import math
import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

BLOCK, CARD, MOST_BLOCKS, MOST_PIXELS = 2880, 80, 256, 600_000_000
KINDS = {8: ">u1", 16: ">i2", 32: ">i4", -32: ">f4"}


class FrameError(ValueError):
    """A frame that cannot be read; ``reason`` is its reason code."""

    def __init__(self, reason: str, detail: str) -> None:
        super().__init__(detail)
        self.reason = reason


def clean(raw: str) -> str:
    """Value of a card without quotes, padding and comment; a doubled quote is a quote."""
    raw = raw.strip()
    if raw.startswith("'"):
        out, i = [], 1
        while i < len(raw):
            if raw[i] == "'":
                if raw[i + 1 : i + 2] != "'":
                    break
                i += 1
            out.append(raw[i])
            i += 1
        return "".join(out).strip()
    return raw.split("/", 1)[0].strip()


def read_header(data: bytes) -> tuple[list[tuple[str, str]], int]:
    """Cards in order (names may recur) and the offset of the data; END must come within 256 blocks."""
    cards = []
    for block in range(MOST_BLOCKS):
        page = data[block * BLOCK : (block + 1) * BLOCK]
        if len(page) < BLOCK:
            raise FrameError("CANNOT_READ", "the header is cut off")
        for at in range(0, BLOCK, CARD):
            card = page[at : at + CARD].decode("ascii", "replace")
            name = card[:8].strip()
            if name == "END":
                return cards, (block + 1) * BLOCK
            if name:
                cards.append((name, clean(card[10:]) if card[8:10] == "= " else card[8:].strip()))
    raise FrameError("CANNOT_READ", "no END card")


def text(cards: list[tuple[str, str]], name: str) -> str | None:
    """First value of a name."""
    return next((v for n, v in cards if n == name), None)


def number(cards: list[tuple[str, str]], name: str) -> float | None:
    """Finite number of a card; exponents may be written with D."""
    try:
        x = float((text(cards, name) or "").replace("D", "E").replace("d", "e"))
    except ValueError:
        return None
    return x if math.isfinite(x) else None


def integer(cards: list[tuple[str, str]], name: str) -> int | None:
    x = number(cards, name)
    return None if x is None else int(x)


def read_image(data: bytes) -> tuple[list[tuple[str, str]], np.ndarray, int]:
    """Cards, pixels as float32 (ny, nx), and the binning: a colour mosaic is averaged over 2x2 cells."""
    cards, offset = read_header(data)
    bits, nx, ny = (integer(cards, k) for k in ("BITPIX", "NAXIS1", "NAXIS2"))
    if bits not in KINDS:
        raise FrameError("UNSUPPORTED_FORMAT" if bits is not None else "CANNOT_READ", f"BITPIX {bits}")
    if not nx or not ny or nx < 1 or ny < 1 or nx * ny > MOST_PIXELS:
        raise FrameError("CANNOT_READ", f"dimensions {nx} x {ny}")
    size = nx * ny * abs(bits) // 8
    if len(data) < offset + size:
        raise FrameError("CANNOT_READ", f"{len(data) - offset} of {size} bytes")
    scale, zero = number(cards, "BSCALE") or 1.0, number(cards, "BZERO") or 0.0
    px = (np.frombuffer(data, KINDS[bits], nx * ny, offset).astype(np.float64) * scale + zero).astype(np.float32).reshape(ny, nx)
    if text(cards, "BAYERPAT") and nx >= 2 and ny >= 2:
        half = px[: ny // 2 * 2, : nx // 2 * 2].reshape(ny // 2, 2, nx // 2, 2)
        return cards, half.mean(axis=(1, 3), dtype=np.float64).astype(np.float32), 2
    return cards, px, 1


def write_image(px: np.ndarray, cards: list[tuple[str, object]] = ()) -> bytes:
    """A 16-bit file with BZERO 32768."""
    ny, nx = px.shape
    head = [("SIMPLE", True), ("BITPIX", 16), ("NAXIS", 2), ("NAXIS1", nx), ("NAXIS2", ny), ("BZERO", 32768), *cards]
    lines = []
    for k, v in head:
        shown = "T" if v is True else "F" if v is False else f"'{v}'" if isinstance(v, str) else repr(v)
        lines.append(f"{k:<8}= {shown:>20}"[:80].ljust(80))
    blob = ("".join(lines) + "END".ljust(80)).encode()
    body = (np.clip(np.rint(px), 0, 65535) - 32768).astype(">i2").tobytes()
    return blob.ljust(-(-len(blob) // BLOCK) * BLOCK) + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def update_header(path: str, cards: list[tuple[str, object]]) -> None:
    """Put cards into the header of a file in place: old values of their names are replaced, new cards follow.

    ``COMMENT`` and ``HISTORY`` cards are always added. The new header must fit in the blocks of
    the old one, so that no pixel moves; otherwise, or if the copy does not have the very pixels
    and cards, the file stays as it was. A synced copy beside the file takes its place at once.
    """
    from .sidecar import card

    with open(path, "rb") as f:
        data = f.read()
    _, offset = read_header(data)
    old = [data[at : at + CARD] for at in range(0, offset, CARD)]
    old = old[: next(i for i, c in enumerate(old) if c[:8].strip() == b"END")]
    new = [(n, card(n, v).encode("ascii", "replace")) for n, v in cards]
    named = {n: c for n, c in new if n not in ("COMMENT", "HISTORY", "")}
    out, seen = [], set()
    for c in old:
        name = c[:8].decode("ascii", "replace").strip()
        if name not in named:
            out.append(c)
        elif name not in seen:
            out.append(named[name])
            seen.add(name)
    out += [c for n, c in new if n not in seen]
    head = b"".join(out) + b"END".ljust(CARD)
    if len(head) > offset:
        raise FrameError("CANNOT_READ", f"the header needs {-(-len(head) // BLOCK)} blocks and has {offset // BLOCK}")
    copy = f"{path}.{os.getpid()}.tmp"
    try:
        with open(copy, "xb") as f:
            f.write(head.ljust(offset) + data[offset:])
            f.flush()
            os.fsync(f.fileno())
        with open(copy, "rb") as f:
            again = f.read()
        if again[offset:] != data[offset:] or read_header(again)[1] != offset or not all(c in again[:offset] for _, c in new):
            raise FrameError("CANNOT_READ", "the copy does not hold what was written")
        os.chmod(copy, os.stat(path).st_mode)
        os.replace(copy, path)
    finally:
        if os.path.exists(copy):
            os.remove(copy)


def update_headers(outcomes: DataFrame, cards: Callable[[dict], list[tuple[str, object]]]) -> DataFrame:
    """``path, error``: files whose headers were updated with the cards of their row, each by one task; null if all went well."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                try:
                    update_header(r["path"].removeprefix("file:"), cards(r))
                    rows.append((r["path"], None))
                except (FrameError, OSError, StopIteration) as e:
                    rows.append((r["path"], str(e) or "no header"))
            yield pd.DataFrame(rows, columns=["path", "error"])

    return outcomes.mapInPandas(run, "path string, error string")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path as ``path, content``; one file is one row."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.fit*").option("recursiveFileLookup", "true").load(path).select("path", "content")


def header_cards(files: DataFrame) -> DataFrame:
    """``path, pos, name, value, error`` of every card; an unreadable file has one row with its error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for p, data in zip(pdf.path, pdf.content):
                try:
                    rows += [(p, i, n, v, None) for i, (n, v) in enumerate(read_header(data)[0], 1)]
                except FrameError as e:
                    rows.append((p, 0, None, None, e.reason))
            yield pd.DataFrame(rows, columns=["path", "pos", "name", "value", "error"])

    return files.mapInPandas(run, "path string, pos int, name string, value string, error string")


def synthetic_field(ra0: float, dec0: float, scale: float, nx: int = 640, ny: int = 480, stars: int = 60, rotation: float = 20.0, mirrored: bool = False, seed: int = 1, sky: float = 1000.0):
    """Pixels and catalogue (ra, dec, mag) of a field with a known solution, for closed-loop tests."""
    from ..operators.plate import Solution

    rng = np.random.default_rng(seed)
    t, s = math.radians(rotation), scale / 3600.0
    m = 1.0 if mirrored else -1.0
    truth = Solution(np.array([ra0, dec0]), np.array([(nx - 1) / 2, (ny - 1) / 2]), np.array([[m * s * math.cos(t), s * math.sin(t)], [-m * s * math.sin(t), s * math.cos(t)]]))
    x, y = rng.uniform(15, nx - 15, stars), rng.uniform(15, ny - 15, stars)
    mag = rng.uniform(8, 13, stars)
    px = sky + rng.normal(0, 5, (ny, nx))
    yy, xx = np.mgrid[0:ny, 0:nx]
    for a, b, g in zip(x, y, mag):
        peak = 20000.0 * 10 ** (-0.4 * (g - 8))
        lo_y, hi_y, lo_x, hi_x = max(0, int(b) - 9), int(b) + 10, max(0, int(a) - 9), int(a) + 10
        box = (slice(lo_y, hi_y), slice(lo_x, hi_x))
        px[box] += peak * np.exp(-((xx[box] - a) ** 2 + (yy[box] - b) ** 2) / (2 * 1.6**2))
    ra, dec = truth.to_sky(x, y)
    return px, pd.DataFrame({"ra": ra, "dec": dec, "mag": mag}), truth
