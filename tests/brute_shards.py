"""Plain-Python twins of the shard operators, row by row, for small fixtures."""

import math
import re
from collections import Counter, defaultdict

DEFAULT = {"source_id": "source_id", "ra": "ra", "dec": "dec", "mag": "phot_g_mean_mag", "pmra": "pmra", "pmdec": "pmdec"}
NUM = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", re.ASCII)


def split(line):
    """Fields of a line, or None if its quoting is broken."""
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i += 1
            s = ""
            while True:
                if i >= n:
                    return None
                if line[i] == '"':
                    if i + 1 < n and line[i + 1] == '"':
                        s += '"'
                        i += 2
                        continue
                    i += 1
                    break
                s += line[i]
                i += 1
            if i < n and line[i] != ",":
                return None
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            s = line[i:j]
            if '"' in s:
                return None
            i = j
        out.append(s)
        if i >= n:
            return out
        i += 1


def value(v):
    v = v.strip()
    if v.lower() in ("", "null"):
        return None
    if NUM.fullmatch(v) and math.isfinite(float(v)):
        return float(v)
    return v


def kind(v):
    v = v.strip()
    if v.lower() in ("", "null"):
        return None
    if re.fullmatch(r"[+-]?\d+", v, re.ASCII):
        return "integer"
    return "decimal" if isinstance(value(v), float) else "text"


def solve(raw, files):
    """(p4 changes, p5 rejects) of tuples (raw_id, shard_id, line_no, line) and (shard_id, feed, seq, spec)."""
    shards = defaultdict(dict)
    for r, s, n, line in raw:
        if line is not None and line.strip() and not line.startswith("#"):
            shards[s][r] = (n, r, line)
    heads, rows = {}, {}
    for s, m in shards.items():
        o = sorted(m.values())
        heads[s] = [x.strip().strip('"').strip() for x in split(o[0][2].rstrip())]
        rows[s] = [(r, split(x.rstrip())) for _, r, x in o[1:]]
    feeds = defaultdict(list)
    for s, f, q, spec in {x[0]: x for x in files}.values():
        if s in heads:
            feeds[f].append((q, s, spec))
    p4, p5, types = set(), set(), {}
    for shards_of in feeds.values():
        last, roles = None, {}
        for _, s, spec in sorted(shards_of, key=lambda x: x[:2]):
            names = heads[s]
            moved = {}
            gone = fresh = []
            if last is not None:
                gone, fresh = [n for n in heads[last] if n not in names], [n for n in names if n not in heads[last]]
                if gone and fresh:
                    moved = find_moved(heads[last], rows[last], names, rows[s], gone, fresh)
            given = dict(p.split("=") for p in (spec or "").replace(" ", "").split(",") if "=" in p)
            roles = {k: next((c for c in (given.get(k), d, roles.get(k), moved.get(roles.get(k))) if c in names), None) for k, d in DEFAULT.items()}
            count = defaultdict(Counter)
            for r, f in rows[s]:
                why = judge(names, roles, f)
                if why:
                    p5.add((r, why))
                else:
                    for n, v in zip(names, f):
                        count[n][kind(v)] += 1
            types[s] = {}
            for n, c in count.items():
                c.pop(None, None)
                if c:
                    types[s][n] = max(("text", "decimal", "integer"), key=lambda k: c[k])
            if last is not None:
                p4 |= {(s, "renamed", a, b) for a, b in moved.items()}
                p4 |= {(s, "removed", a, "") for a in gone if a not in moved}
                p4 |= {(s, "added", "", b) for b in fresh if b not in moved.values()}
                p4 |= {(s, "retyped", n, n) for n in names if n in types[s] and n in types[last] and types[s][n] != types[last][n]}
            last = s
    return p4, p5


def judge(names, roles, f):
    if f is None:
        return "quoting"
    if len(f) != len(names):
        return "field_count"
    row = dict(zip(names, f))
    for k in ("ra", "dec", "mag", "pmra", "pmdec"):
        v = value(row[roles[k]]) if roles[k] else None
        if v is None:
            if k in ("ra", "dec"):
                return f"bad_{k}"
        elif not isinstance(v, float) or (k == "ra" and not 0 <= v <= 360) or (k == "dec" and not -90 <= v <= 90):
            return f"bad_{k}"
    return None


def find_moved(h0, r0, h1, r1, gone, fresh):
    """Link rows by the values that columns of the same name share; then compare lost and new columns."""
    a = [dict(zip(h0, map(value, f))) for _, f in r0 if f and len(f) == len(h0)]
    b = [dict(zip(h1, map(value, f))) for _, f in r1 if f and len(f) == len(h1)]
    links = Counter()
    for n in set(h0) & set(h1):
        ca, cb = Counter(x[n] for x in a), Counter(x[n] for x in b)
        ib = {x[n]: j for j, x in enumerate(b)}
        for i, x in enumerate(a):
            v = x[n]
            if v is not None and ca[v] == 1 and cb.get(v) == 1 and len(str(v)) > 6:
                links[(i, ib[v])] += 1
    best = {}
    for (i, j), c in links.items():
        if c > best.get(i, (0, 0))[0]:
            best[i] = (c, j)
    moved, scores = {}, []
    for g in gone:
        for f in fresh:
            pairs = [(a[i][g], b[j][f]) for i, (_, j) in best.items() if a[i][g] is not None or b[j][f] is not None]
            same = sum(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-6 * max(abs(x), abs(y))) for x, y in pairs)
            if pairs and same / len(pairs) > 0.5:
                scores.append((same / len(pairs), g, f))
    for _, g, f in sorted(scores, reverse=True):
        if g not in moved and f not in moved.values():
            moved[g] = f
    return moved
