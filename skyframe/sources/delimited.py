"""Vectorised parsing of delimited lines whose header differs from shard to shard."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pv

#: Roles of a catalogue row and the default column of each (fixed values).
DEFAULTS = {"source_id": "source_id", "ra": "ra", "dec": "dec", "mag": "phot_g_mean_mag", "pmra": "pmra", "pmdec": "pmdec"}
ROLES = list(DEFAULTS)
CHECKED = ["ra", "dec", "mag", "pmra", "pmdec"]
REASONS = ["", "quoting", "field_count", *[f"bad_{r}" for r in CHECKED]]

#: A line whose quoted fields are closed and whose unquoted ones have no quote (linear-time engine).
WELL_QUOTED = r'^(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*$'
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def header_names(line: str) -> list[str]:
    """Names of a header line without surrounding blanks and quotes; later doubles get a suffix."""
    names, seen = [], {}
    for cell in _split(line.rstrip()):
        name = cell.strip().strip('"').strip()
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}#{seen[name]}")
    return names


def _split(line: str) -> list[str]:
    import csv

    return next(csv.reader([line.replace("\r", " ").replace("\n", " ")], strict=False), [])


def column_spec(spec: str | None) -> dict[str, str]:
    """``role=column`` overrides; parts that are not of this form are passed over."""
    parts = [p.split("=", 1) for p in (spec or "").split(",") if "=" in p]
    return {k.strip(): v.strip() for k, v in parts if k.strip() in DEFAULTS and v.strip()}


class Parsed:
    """Rows of equal width: ``at`` their places in the batch, ``columns`` their string fields."""

    def __init__(self, at: np.ndarray, columns: list[pa.Array]) -> None:
        self.at, self.columns, self.n = at, columns, len(at)
        self._all = None

    def cells(self, row: np.ndarray, column: np.ndarray) -> pa.Array:
        """The values at these places."""
        if self._all is None:
            self._all = pa.concat_arrays(self.columns)
        return self._all.take(pa.array(column * self.n + row))


def parse_batch(lines: pa.Array, width: np.ndarray) -> tuple[np.ndarray, list[Parsed]]:
    """Structural check of a batch: a reason code per line (0 good) and the good rows by width.

    Broken quoting is found first, by one linear regular expression over all lines; the rest
    goes through the CSV reader with all fields as strings, whose invalid-row callback reports
    the rows with too few or too many fields.
    """
    lines = pc.utf8_rtrim_whitespace(lines)
    odd = _matches(lines, r"[\r\n]")
    plain = ~pc.match_substring(lines, '"').to_numpy(zero_copy_only=False).astype(bool)
    quoted = plain if plain.all() else plain | _matches(lines, WELL_QUOTED)
    code = np.where(quoted, 0, 1).astype(np.int8)
    parsed = []
    for w in np.unique(width[quoted]):
        at = np.flatnonzero(quoted & (width == w))
        part = lines.take(pa.array(at))
        if odd[at].any():  # the reader would break such a line in two
            part = pc.replace_substring_regex(part, r"[\r\n]", " ")
        data = ("\n".join(part.to_pylist()) + "\n").encode()
        wrong: list[int] = []

        def report(row, wrong=wrong):
            wrong.append(row.number - 1)
            return "skip"

        names = [f"f{i}" for i in range(w)]
        t = pv.read_csv(
            io.BytesIO(data),
            read_options=pv.ReadOptions(use_threads=False, column_names=names, block_size=len(data) + 16),
            parse_options=pv.ParseOptions(invalid_row_handler=report, ignore_empty_lines=False, newlines_in_values=False),
            convert_options=pv.ConvertOptions(column_types={k: pa.string() for k in names}, strings_can_be_null=False, null_values=[], quoted_strings_can_be_null=False),
        )
        code[at[wrong]] = 2
        good = np.delete(at, wrong)
        if len(good) != t.num_rows:
            raise ValueError(f"the CSV reader returned {t.num_rows} of {len(good)} rows")
        if len(good):
            parsed.append(Parsed(good, [one(t.column(k)) for k in names]))
    return code, parsed


def one(c: pa.ChunkedArray) -> pa.Array:
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)


def present(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values without blanks around them, and where they are not missing (empty or ``null``)."""
    v = pc.utf8_trim_whitespace(pc.fill_null(values, ""))
    missing = pc.or_(pc.equal(v, ""), pc.equal(pc.ascii_lower(v), "null"))
    return v, ~missing.to_numpy(zero_copy_only=False).astype(bool)


def numbers(values: pa.Array) -> np.ndarray:
    """Doubles of plain ASCII decimal numbers; NaN where the text is anything else."""
    ok = _matches(values, NUMBER)
    out = np.full(len(values), np.nan)
    if ok.any():
        plain = values if ok.all() else values.filter(pa.array(ok))
        try:
            got = pc.cast(pc.utf8_ltrim(plain, "+"), pa.float64()).to_numpy(zero_copy_only=False)
        except pa.ArrowInvalid:  # a number beyond the range of doubles
            got = np.array([float(x) for x in plain.to_pylist()])
        out[ok] = got
    out[~np.isfinite(out)] = np.nan
    return out


def _matches(values: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False).astype(bool)


#: What a pattern says of a value: missing, text, or a number that is an integer or not and may be a right
#: ascension, a declination, both or neither. A row that has no fields has the pattern of its reason.
MISSING, TEXT = "m", "t"
NUMBERS = {s: (k & 4 == 0, k & 2 != 0, k & 1 != 0) for k, s in enumerate("abcdefgh")}
INTEGERS = [s for s, (whole, _, _) in NUMBERS.items() if whole]
RA_ALLOWED = [s for s, (_, ra, _) in NUMBERS.items() if ra]
DEC_ALLOWED = [s for s, (_, _, dec) in NUMBERS.items() if dec]
BROKEN = {1: "!1", 2: "!2"}


class Cells:
    """The values of one column of equal-width rows, looked at once."""

    def __init__(self, values: pa.Array) -> None:
        self.text, self.there = present(values)
        self.number = numbers(self.text)
        known = ~np.isnan(self.number)
        self.whole = known & ~_matches(self.text, "[.eE]")
        x = np.where(known, self.number, -1e9)
        kind = ord("a") + 4 * ~self.whole + 2 * ((x >= 0) & (x <= 360)) + ((x >= -90) & (x <= 90))
        self.symbol = np.where(~self.there, ord(MISSING), np.where(known, kind, ord(TEXT))).astype(np.uint8)

    def tokens(self, telling: int) -> np.ndarray:
        """A hash of each value, equal for equal numbers however they are written; -1 where it cannot tell a source from others."""
        digits = pc.replace_substring_regex(self.text, r"^[+-]?[0.]*|[.]|[eE][+-]?[0-9]+$", "")
        tells = self.there & (pc.utf8_length(digits).to_numpy(zero_copy_only=False) >= telling)
        exact = np.abs(self.number) < 2.0**53
        out = np.full(len(tells), -1, np.int64)
        by_value = tells & exact
        out[by_value] = (self.number[by_value] + 0.0).view(np.int64)
        rest = np.flatnonzero(tells & ~exact)  # long integers and text keep all their characters
        if len(rest):
            plain = pc.replace_substring_regex(self.text.take(pa.array(rest)), r"^\+", "")
            out[rest] = pd.util.hash_array(plain.to_numpy(zero_copy_only=False).astype(object)).view(np.int64)
        out[tells] = (out[tells].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)).view(np.int64)
        return out


def patterns(columns: list[Cells], n: int) -> pa.Array:
    """One string per row with the symbol of each of its values."""
    w = len(columns)
    flat = np.stack([c.symbol for c in columns], axis=1).tobytes()
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer((np.arange(n + 1) * w).astype(np.int32)), pa.py_buffer(flat)])
