"""Evaluation passages in training texts: rare n-gram seeds, then Smith-Waterman alignment.

Both sides are folded (compatibility forms, case, invisible characters) and turned into words,
or into single letters and digits for texts without word spaces. N-grams of the passages that
few documents hold join passages with documents; the pairs are aligned, and the score of the
best local alignment decides which of them leaked.

For exact copies the seeds are six words (twelve letters): of every window of the asked length
the rarest one, so no document with a full window is lost. Edited copies need seeds that
survive edits: three words (four letters), all rare ones and the rarest three of every window.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import narrow_batches

#: Languages whose passages are compared letter by letter.
UNSPACED = ("ja", "zh")
#: Consecutive words or letters that make a leak. A local alignment with the score of an intact
#: window (a match counts 1, a mismatch or gap -1) is taken as an edited copy.
WINDOW = {"word": 12, "char": 24}
#: Length of a seed for exact and for edited copies.
SEED = {"word": 6, "char": 12}
SHORT_SEED = {"word": 3, "char": 4}
#: An n-gram is rare if at most this part of all documents hold it, or this many.
RARE_PART = 0.001
RARE_LEAST = 10
#: Seeds of each window whatever their frequency.
PER_WINDOW = 2
#: Cells of a row of alignments that are filled side by side; one text may have more.
CELLS_AT_ONCE = 1 << 17
#: Passages of a block that may be sent to all tasks; a larger test set runs in several blocks.
BLOCK_CHARS = 4_000_000
DOCS_AT_ONCE = 1024

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IGNORED = "͏ᅟᅠ឴឵᠋-᠏︀-️ㅤﾠ\U000e0100-\U000e01ef"
_tables: dict[str, np.ndarray] = {}
_powers: list[np.ndarray] = []
_invisible: list = []


def _classes() -> np.ndarray:
    """Per code point: 2 letter or digit, 1 mark, 0 anything else."""
    if "class" not in _tables:
        kind = {"L": 2, "N": 2, "M": 1}
        _tables["class"] = np.array([kind.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.int8)
    return _tables["class"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def _segments(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash (mod 2^64) of each segment of ``values``."""
    up, down = _power(len(values) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(values * up[: len(values)])])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def fold(text: str) -> str:
    """Text without invisible characters, in compatibility form and without case."""
    if text.isascii():
        return text.lower()
    if not _invisible:
        chars = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf")
        pattern = re.compile(f"[{re.escape(chars)}{_IGNORED}]+")
        _invisible[:] = [pattern, frozenset(c for c in map(chr, range(0x110000)) if pattern.match(c))]
    if not _invisible[1].isdisjoint(text):
        text = _invisible[0].sub("", text)
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


@dataclass
class Tokens:
    """Tokens of a batch of texts: hashes, text numbers, and places in the joined folded text."""

    text: str
    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def strings(self, a: int, b: int) -> list[str]:
        return [self.text[s:e] for s, e in zip(self.start[a:b], self.end[a:b])]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first token of each n-gram within a text."""
        if len(self.hash) < n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])
        return _segments(self.hash, at, at + n), at


def tokens(folded: list[str], kind: str) -> Tokens:
    joined = "\n".join(folded) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.cumsum([len(x) + 1 for x in folded])
    table = _classes()[codes]
    if kind == "char":
        start = np.flatnonzero(table == 2)
        end = start + 1
        hashed = _mix(codes[start].astype(np.uint64) + _BASE)
    else:
        inside = np.concatenate([[False], table > 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        hashed = _segments(_mix(codes.astype(np.uint64) + _BASE), start, end)
    return Tokens(joined, hashed, np.searchsorted(bounds, start, side="right"), start, end)


def smith_waterman(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score (match 1, mismatch and gap -1) of each pair of token arrays.

    Pairs of similar size are filled side by side, one vectorised row per item token; a single
    pair may be of any size.
    """
    out = np.zeros(len(items), np.int64)
    size = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * (size[order[hi]] + 1) <= CELLS_AT_ONCE and size[order[hi]] <= 2 * size[order[lo]] + 64:
            hi += 1
        part = order[lo:hi]
        high, wide = max(len(items[k]) for k in part), int(size[part[-1]])
        # small numbers for the items' tokens: fewer bytes to compare; other tokens and the padding match nothing
        known = np.unique(np.concatenate([items[k] for k in part]))
        want, have = np.full((len(part), high), -2, np.int32), np.full((len(part), wide), -1, np.int32)
        for r, k in enumerate(part):
            want[r, : len(items[k])] = np.searchsorted(known, items[k])
            at = np.minimum(np.searchsorted(known, texts[k]), len(known) - 1)
            have[r, : size[k]] = np.where(known[at] == texts[k], at, -1) if len(known) else -1
        kind = np.int16 if wide + high < 1 << 14 else np.int32
        place, one = np.arange(1, wide + 1, dtype=kind), kind(1)
        row, best = np.zeros((len(part), wide + 1), kind), np.zeros(len(part), kind)
        for j in range(high):
            h = np.where(have == want[:, j, None], one, -one)
            h += row[:, :-1]
            np.maximum(h, row[:, 1:] - one, out=h)
            np.maximum(h, kind(0), out=h)
            h += place
            np.maximum.accumulate(h, axis=1, out=h)
            h -= place
            row[:, 1:] = h
            np.maximum(best, h.max(axis=1, initial=0), out=best)
        out[part] = best
        lo = hi
    return out


def longest_common_run(a: np.ndarray, b: np.ndarray, shifts: np.ndarray) -> tuple[int, int, int]:
    """Longest run of equal tokens on the diagonals ``a[i + shift] == b[i]``: length, place in a, in b."""
    best = (0, 0, 0)
    for d in shifts:
        lo, hi = max(0, -d), min(len(b), len(a) - d)
        if hi - lo <= best[0]:
            continue
        same = np.concatenate([[False], a[lo + d : hi + d] == b[lo:hi], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        if len(edge):
            size = edge[1::2] - edge[::2]
            k = int(size.argmax())
            if size[k] > best[0]:
                best = (int(size[k]), int(edge[2 * k] + lo + d), int(edge[2 * k] + lo))
    return best


@dataclass
class TestSet:
    """Folded passages of one kind, their grams, and after :meth:`choose` the seeds with postings.

    ``length`` is that of a seed; a passage with fewer tokens is a seed as a whole.
    """

    kind: str
    length: int
    ids: list[int]
    words: Tokens
    first: np.ndarray
    lengths: list[int] = field(default_factory=list)
    hash: np.ndarray = field(default=None)
    at: np.ndarray = field(default=None)
    grams: np.ndarray = field(default=None)
    seeds: np.ndarray = field(default=None)
    posting: np.ndarray = field(default=None)
    seed_item: np.ndarray = field(default=None)
    seed_at: np.ndarray = field(default=None)
    _vocabulary: np.ndarray = field(default=None)

    @classmethod
    def of(cls, kind: str, rows: list[tuple[int, str]], edited: bool) -> TestSet:
        t = tokens([fold(p) for _, p in rows], kind)
        first = np.searchsorted(t.doc, np.arange(len(rows) + 1))
        s = cls(kind, (SHORT_SEED if edited else SEED)[kind], [i for i, _ in rows], t, first)
        own = np.minimum(np.diff(first), s.length)
        s.lengths = sorted({int(n) for n in own if n > 0} if edited else {s.length})
        parts = [(g[own[t.doc[at]] == n], at[own[t.doc[at]] == n]) for n in s.lengths for g, at in [t.grams(n)]]
        s.hash, s.at = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*parts)) or [(), ()]))
        order = np.argsort(s.at, kind="stable")
        s.hash, s.at = s.hash[order], s.at[order]
        s.grams = np.unique(s.hash)
        return s

    def grams_of(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of all grams of a text that may be seeds."""
        parts = [t.grams(n) for n in self.lengths]
        return np.concatenate([g for g, _ in parts]), np.concatenate([at for _, at in parts])

    def need(self) -> np.ndarray:
        """Score of each passage that makes a leak: that of an intact window, or of all of a shorter passage."""
        return np.minimum(np.diff(self.first), WINDOW[self.kind])

    def choose(self, frequency: dict[int, int], documents: int, edited: bool) -> None:
        """Keep the rarest grams of each window, and with ``edited`` all rare ones; grams of no document are no seeds.

        Frequencies are compared by their power of two: an edited copy of a passage that many
        documents hold lacks some of its grams, which must not become the rarest for that.
        """
        df = np.array([frequency.get(int(x), 0) for x in self.hash], np.int64)
        held = df > 0
        chosen = held & (df <= max(RARE_LEAST, RARE_PART * documents)) if edited else np.zeros(len(df), bool)
        rank = np.empty(len(df), np.int64)
        rank[np.lexsort((self.hash, np.frexp(df)[1]))] = np.arange(len(df))
        if edited:
            rank[~held] = len(df)
        bounds = np.searchsorted(self.words.doc[self.at], np.arange(len(self.ids) + 1))
        for a, b in zip(bounds, bounds[1:]):
            wide = WINDOW[self.kind] - self.length + 1
            if b - a < wide and not edited:
                continue
            if b > a:
                view = np.lib.stride_tricks.sliding_window_view(rank[a:b], min(wide, b - a))
                best = np.argsort(view, axis=1, kind="stable")[:, : PER_WINDOW if edited else 1]
                chosen[a + np.unique(best + np.arange(len(view))[:, None])] = True
        keep = np.flatnonzero(chosen & held)
        order = keep[np.argsort(self.hash[keep], kind="stable")]
        self.seeds, self.posting = np.unique(self.hash[order], return_index=True)
        self.posting = np.append(self.posting, len(order))
        self.seed_item = self.words.doc[self.at[order]]
        self.seed_at = self.at[order] - self.first[self.seed_item]

    @property
    def vocabulary(self) -> np.ndarray:
        """The tokens of each item as numbers that tell them from those of other items, sorted."""
        if self._vocabulary is None:
            self._vocabulary = np.unique(self.words.hash ^ _mix(self.words.doc + 1))
        return self._vocabulary

    def item(self, i: int) -> np.ndarray:
        return self.words.hash[self.first[i] : self.first[i + 1]]


def _members(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in x that occur in ``sorted_values``, and which value each is.

    A table over the leading bits passes over most of x before the search.
    """
    table = np.zeros(1 << 20, bool)
    table[(sorted_values >> np.uint64(44)).astype(np.int64)] = True
    at = np.flatnonzero(table[(x >> np.uint64(44)).astype(np.int64)])
    k = np.searchsorted(sorted_values, x[at])
    ok = k < len(sorted_values)
    ok[ok] = sorted_values[k[ok]] == x[at][ok]
    return at[ok], k[ok]


def _count(sets: list[TestSet]):
    """Document frequency of the passages' n-grams, summed within each batch, and the number of documents."""

    def run(batches):
        for t in narrow_batches(batches, DOCS_AT_ONCE, "text"):
            folded = [fold(x) for x in t.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([0], pa.int64()), pa.array([len(folded)], pa.int64())], names=["kind", "gram", "docs"])
            for s in sets:
                tk = tokens(folded, s.kind)
                g, at = s.grams_of(tk)
                hit, which = _members(s.grams, g)
                pairs = np.unique(tk.doc[at[hit]].astype(np.int64) * len(s.grams) + which) % max(1, len(s.grams))
                which, n = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([s.kind] * len(which), pa.string()), pa.array(s.grams[which].view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "gram", "docs"])

    return run


FOUND = "doc_id long, item_id long, kind string, score int, item_tokens int, longest_run int"


def _seeded(s: TestSet, tk: Tokens):
    """Hits of seeds as (doc, item, place in the item, place in the batch), sorted by the first two and the last."""
    g, at = s.grams_of(tk)
    hit, seed = _members(s.seeds, g)
    many = s.posting[seed + 1] - s.posting[seed]
    post = np.arange(int(many.sum())) + np.repeat(s.posting[seed] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
    place = np.repeat(at[hit], many)
    doc, item, there = tk.doc[place], s.seed_item[post], s.seed_at[post]
    order = np.lexsort((place, item, doc))
    return doc[order], item[order], there[order], place[order]


def _align(sets: list[TestSet]):
    def run(batches):
        for t in narrow_batches(batches, DOCS_AT_ONCE, "text"):
            ids = t.column("doc_id").to_pylist()
            folded = [fold(x) for x in t.column("text").to_pylist()]
            out = []
            for s in sets:
                tk = tokens(folded, s.kind)
                doc, item, there, place = _seeded(s, tk)
                if not len(doc):
                    continue
                first = np.searchsorted(tk.doc, np.arange(len(folded) + 1))
                wide, place = np.diff(s.first)[item], place - first[doc]
                pair = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
                # the parts of a text that a passage with these seeds can reach, each aligned with the whole passage
                part = np.flatnonzero(pair | np.concatenate([[False], np.diff(place) > wide[1:]]))
                last = np.append(part[1:], len(doc)) - 1
                low, high = np.maximum(0, place[part] - wide[part]), place[last] + s.length + wide[part]
                texts = [tk.hash[first[d] + a : min(first[d + 1], first[d] + b)] for d, a, b in zip(doc[part], low, high)]
                want = [s.item(i) for i in item[part]]
                # no alignment has more matches than tokens that the other side has too
                least, score = s.need()[item[part]], np.zeros(len(part), np.int64)
                size = np.array([len(x) for x in texts])
                shared, _ = _members(s.vocabulary, np.concatenate(texts) ^ np.repeat(_mix(item[part] + 1), size))
                shared = np.bincount(np.repeat(np.arange(len(part)), size)[shared], minlength=len(part))
                able = np.flatnonzero(shared >= least)
                score[able] = smith_waterman([want[k] for k in able], [texts[k] for k in able])
                cut = np.flatnonzero(pair)
                best = np.maximum.reduceat(score, np.searchsorted(part, cut))
                enough = best >= s.need()[item[cut]]
                for a, b, points in zip(cut[enough], np.append(cut[1:], len(doc))[enough], best[enough]):
                    d, i = int(doc[a]), int(item[a])
                    text, want = tk.hash[first[d] : first[d + 1]], s.item(i)
                    size, pd, pi = longest_common_run(text, want, np.unique(place[a:b] - there[a:b]))
                    if size and tk.strings(first[d] + pd, first[d] + pd + size) != s.words.strings(s.first[i] + pi, s.first[i] + pi + size):
                        size = 0  # equal hashes of unequal texts
                    out.append((ids[d], s.ids[i], s.kind, int(points), len(want), size))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "kind", "score", "item_tokens", "longest_run"])

    return run


def _blocks(items: DataFrame) -> list[DataFrame]:
    size = items.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-int(size) // BLOCK_CHARS))
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


def leaks(documents: DataFrame, items: DataFrame, edited: bool = True) -> DataFrame:
    """Documents that contain passages of items, wholly or partly: pairs whose alignment scores enough.

    A pair leaked if the best local alignment of the whole passage with the text scores at least
    12 (24 for ja and zh): as much as an intact window, or as a longer copy with edits. All of a
    shorter passage makes a leak too. Without ``edited`` the seeds are long and find all pairs
    with an intact window, with ``edited`` they find copies in which one word of four is changed
    as well; the second result holds the first.

    ``score`` is that of the alignment with the passage of ``item_tokens`` tokens, ``longest_run``
    the longest run of consecutive equal tokens on the seeds' diagonals. The passages are sent to
    all tasks in blocks of a bounded size; documents are read twice per block and never shuffled.
    Without ``edited``, passages shorter than the window match nothing. Null or empty texts and
    passages match nothing; repeated rows count once, and an item with several passages has leaked
    if any of them has. Documents may be of any length; no candidate is left out.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    items = items.select("item_id", "lang", "passage").where(F.col("item_id").isNotNull() & (F.length("passage") > 0)).distinct()
    parts = []
    for block in _blocks(items):
        rows = [(r["item_id"], "char" if r["lang"] in UNSPACED else "word", r["passage"]) for r in block.collect()]  # at most about BLOCK_CHARS
        sets = [TestSet.of(k, [(i, p) for i, kk, p in sorted(rows) if kk == k], edited) for k in ("word", "char") if any(r[1] == k for r in rows)]
        sets = [s for s in sets if len(s.grams)]
        if not sets:
            continue
        counted = docs.select("text").mapInArrow(_count(sets), "kind string, gram long, docs long").groupBy("kind", "gram").agg(F.sum("docs").alias("docs"))
        frequency: dict[str, dict[int, int]] = {}
        for r in counted.collect():  # at most one row per n-gram of the block's passages
            frequency.setdefault(r["kind"], {})[r["gram"] % (1 << 64)] = r["docs"]
        for s in sets:
            s.choose(frequency.get(s.kind, {}), frequency.get("", {}).get(0, 0), edited)
        parts.append(docs.mapInArrow(_align([s for s in sets if len(s.seeds)]), FOUND))
    if not parts:
        return documents.sparkSession.createDataFrame([], FOUND)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("kind", "score", "item_tokens", "longest_run")])


def exact(found: DataFrame) -> DataFrame:
    """Of the pairs that the alignment has decided, those with an intact run of the window's length."""
    need = F.when(F.col("kind") == "char", WINDOW["char"]).otherwise(WINDOW["word"])
    return found.where(F.col("longest_run") >= need)
