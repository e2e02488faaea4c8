"""Sentence boundaries across languages and scripts, as offsets of whole texts.

A pushdown automaton walks the marks of a text: one stack holds the open list levels, on top of
it the open quotes and brackets of a line or paragraph. It asks an abbreviation trie about each
full stop and knows the terminators of the scripts. The layout decides beforehand where a line
break ends a unit.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import narrow_batches

# --- fixed values: marks and abbreviations -------------------------------------------------

BRACKETS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "｛": "｝", "【": "】", "〔": "〕"}
QUOTES = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "‘": "’", "‚": "‘’", "｢": "｣"}
OPENERS = BRACKETS | QUOTES
CLOSERS = {c for cs in OPENERS.values() for c in cs}
#: Full stops of scripts that need no space after them, and other certain terminators.
CERTAIN = "。｡．！？!?؟۔।॥።᠃᠉။།᥄᥅꓿꘎‼⁇⁈⁉"
ELLIPSES = "…‥"
#: Format characters that do not part words.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

#: Never the end of a sentence unless the unit ends: titles, links, introductions.
LEADING = """
dr mr mrs ms prof st mt obs rev gen col capt lt sgt hon sr dra sra srta dott dipl ing hr fr mme mlle mgr
vs cf viz approx aprox ca env incl excl e.g i.e eg ie resp bzw z.b d.h u.a u.u vgl sog evtl ggf inkl exkl zzgl
p.ex p.ej ej ex núm num av rue pl ul ул пл пр им см напр т.е т.к т.н т.д г-н г-жа акад проф доц
د م أ डॉ श्री प्रो श्रीमती
""".split()
#: Followed by a number, a name or a sign they go on; before a word with a capital they may end.
COUNTED = """
no nos nr nrs ver fig figs tab abb sec secs eq eqs ch chap p pp vol art pag pág cap s n рис стр табл гл с разд
jan feb mar apr jun jul aug sep sept oct nov dec jän mär mrz okt dez r.a ra ref refs ed eds sect
""".split()
#: May end a sentence: they do before a capital, an opening mark or a number.
CLOSING = """
etc usw al a.m p.m am pm u.t ut jr inc ltd co corp bros h г гг в вв др пр ч мин сек руб тыс млн н.э i.a ff et.al
""".split()

MONTHS = """
Januar Jänner Februar Feber März April Mai Juni Juli August September Oktober November Dezember
Jan Jän Feb Mär Mrz Apr Jun Jul Aug Sep Sept Okt Nov Dez
January February March May June July October December Mar Oct Dec
""".split()
#: Units without vowels, after which a new sentence may begin with a small letter.
UNITS = "px nm mm cm dm km ms ns kg mg hz khz mhz ghz kb mb gb tb pb db pc kpc mpc mpx".split()
#: German words before an ordinal.
ORDINAL_CUES = "am vom zum im der den dem des die das bis seit ab beim jeden jeder dieser am".split()
#: After a closing quote these go on with the sentence in scripts without capitals.
GOES_ON = ("と", "って", "という", "とい", "は", "が", "を", "に", "の", "も", "で", "然后", "然後", "并", "並", "接着", "便", "就", "的", "ثم", "وقال", "فقال", "قال")


def _trie(words: list[str], kind: str, root: dict) -> dict:
    for w in words:
        node = root
        for ch in reversed(w):
            node = node.setdefault(ch, {})
        node.setdefault("", kind)
    return root


#: Abbreviations read backwards from their full stop.
TRIE = _trie(CLOSING, "closing", _trie(COUNTED, "counted", _trie(LEADING, "leading", {})))

_MARK = re.compile("[" + re.escape("".join(OPENERS) + "".join(sorted(CLOSERS)) + '"') + "]|[." + re.escape(CERTAIN + ELLIPSES) + "]+")
_MARK_THAI = re.compile(_MARK.pattern + r"|(?<=[ก-ฺเ-๎])\s+(?=[ก-ฺเ-๎])")
_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_BLANK = re.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85  ])[^\S\n\r]*(?:\r\n|[\n\r\x0b\x0c\x85  ])\s*")
_LIST_NUMBER = re.compile(r"\d{1,3}|[A-Za-z]")
_MARKER = re.compile(r"\s*\(?(\d{1,3}(?:\.\d{1,3})*|[A-Za-z]|[ivxlcdm]+|[IVXLCDM]+)[.)](?=\s)")
_ROMAN = re.compile(r"m*(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_ROMAN_DIGITS = dict(zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000)))
_WORD = re.compile(r"\w+")
_THAI = re.compile(r"[ก-ฺเ-๎]")


def _abbreviation(text: str, dot: int, start: int) -> str | None:
    """Kind of the abbreviation that ends before the full stop at ``dot``."""
    node, kind, i = TRIE, None, dot - 1
    while i >= start:
        ch = text[i]
        if ch in INVISIBLE:
            i -= 1
            continue
        low = ch.lower() if ch.isascii() else unicodedata.normalize("NFKC", ch).lower()
        if ch.isspace() or low not in node:
            break
        node = node[low]
        if "" in node and (i == start or not (text[i - 1].isalnum() or text[i - 1] in ".-_/'’" or "ऀ" <= text[i - 1] <= "෿")):
            kind = node[""]
        i -= 1
    return kind


def _caseless(ch: str) -> bool:
    return ch.isalpha() and ch.lower() == ch.upper() and ch.lower() == ch


def _pairs(text: str, marks: list[tuple[int, int]]) -> dict[int, int]:
    """Matching quotes and brackets; those without a partner are passed over.

    ``waiting`` counts the open marks that each closing mark would close, so one look tells
    whether it has a partner, however deep the nesting.
    """
    stack: list[tuple[str, int]] = []
    pair: dict[int, int] = {}
    waiting: dict[str, int] = dict.fromkeys(CLOSERS, 0)
    straight = -1

    def pop() -> tuple[str, int]:
        top = stack.pop()
        for c in OPENERS.get(top[0], ""):
            waiting[c] -= 1
        return top

    for a, b in marks:
        ch = text[a]
        if b != a + 1:
            continue
        if ch == '"':
            before = text[a - 1] if a else " "
            if straight >= 0:
                while stack and stack[-1][1] != straight:
                    pop()
                if stack:
                    pair[straight] = a
                    pair[a] = straight
                    pop()
                straight = -1
            elif before.isspace() or before in OPENERS or before in ".!?":
                straight = a
                stack.append((ch, a))
        elif waiting.get(ch):
            while ch not in OPENERS.get(stack[-1][0], ""):
                if pop()[0] == '"':
                    straight = -1
            _, i = pop()
            pair[i] = a
            pair[a] = i
        elif ch in OPENERS:
            stack.append((ch, a))
            for c in OPENERS[ch]:
                waiting[c] += 1
    return pair


def _ordinals(label: str) -> list[tuple[str, int]]:
    """How a marker may be read: (style, number), a lone letter before a roman number."""
    if label[-1].isdigit():
        return [("digit", int(label.rsplit(".", 1)[-1]))]
    low, case = label.lower(), "lower" if label.islower() else "upper"
    read = [("letter " + case, ord(low) - 96)] if len(low) == 1 else []
    if _ROMAN.fullmatch(low):
        worth = [_ROMAN_DIGITS[c] for c in low]
        read.append(("roman " + case, sum(-a if a < b else a for a, b in zip(worth, [*worth[1:], 0]))))
    return read


def _list_marker(text: str, start: int, end: int, levels: list[tuple[str, str, int]]) -> int:
    """The place of the full stop of a list marker at ``start``, or -1; ``levels`` is the stack of open lists.

    A marker goes on with an open level (those above it are closed) or opens a new one with its
    first number. Short numbers and single letters are markers even out of turn; dotted numbers
    and roman numbers only in turn, since a decimal or a name may begin a line as well.
    """
    m = _MARKER.match(text, start, end)
    if m is None:
        return -1
    label = m.group(1)
    parent = label.rpartition(".")[0]
    options = _ordinals(label)
    for depth in range(len(levels) - 1, -1, -1):
        style, above, last = levels[depth]
        for kind, number in options:
            if kind == style and parent == above and number == last + 1:
                levels[depth:] = [(kind, parent, number)]
                return m.end() - 1 if text[m.end() - 1] == "." else -1
    short = not parent and (len(label) == 1 or label.isdigit())
    under = not parent or (bool(levels) and _label_of(levels[-1]) == parent)
    for kind, number in options[::-1]:
        if number == 1 and under and (kind != "letter lower" or len(options) == 1):
            levels.append((kind, parent, 1))
            return m.end() - 1 if text[m.end() - 1] == "." else -1
    if short:
        levels[:] = [(*options[0][:1], "", options[0][1])]
        return m.end() - 1 if text[m.end() - 1] == "." else -1
    return -1


def _label_of(level: tuple[str, str, int]) -> str:
    style, above, number = level
    return (above + "." if above else "") + str(number) if style == "digit" else ""


class _Before:
    """The word before a place, which may only move forward, so that each character is seen once."""

    def __init__(self, text: str, start: int) -> None:
        self.text, self.at, self.begin, self.sign = text, start, start, -1

    def move(self, place: int, start: int) -> tuple[int, bool]:
        """Where the word begins (not before ``start``), and whether it has a sign of paths and names."""
        for i in range(place - 1, self.at - 1, -1):
            if self.text[i].isspace():
                self.begin = i + 1
                break
        self.sign = max(self.sign, *(self.text.rfind(c, self.at, place) for c in "_/@\\"))
        self.at = max(self.at, place)
        begin = max(self.begin, start)
        return begin, self.sign >= begin


def _initial_before(text: str, i: int, start: int) -> bool:
    """Whether another single letter with a full stop stands before the one at ``i``."""
    j = i - 1
    while j >= start and text[j].isspace():
        j -= 1
    return j > start and text[j] == "." and _WORD.match(text, j - 1) is not None and (j - 2 < start or text[j - 2].isspace())


def _skip(text: str, i: int, end: int) -> int:
    while i < end and text[i].isspace():
        i += 1
    return i


def _starts_sentence(text: str, i: int, end: int) -> bool:
    """Whether the text at i begins with a capital or a number, perhaps after opening marks."""
    while i < end and (text[i] in OPENERS or text[i] in '"¿¡'):
        i += 1
    return i < end and (text[i].isupper() or text[i].isdigit() or text[i].istitle())


def _full_stop_ends(text: str, start: int, dot: int, end: int, word: _Before) -> bool:
    """Whether a single full stop before more text ends the sentence that began at ``start``."""
    nxt = text[dot + 1]
    before = text[dot - 1] if dot > start else " "
    if before.isspace() or dot == start:
        return not nxt.isalnum() and dot > start
    at, path = word.move(dot, start)
    if not nxt.isspace():
        if nxt.isalpha():
            if _caseless(nxt):
                return _caseless(before)
            joined = nxt.isupper() and (dot + 2 >= end or text[dot + 2].islower() or text[dot + 2].isspace())
            if not joined or path or not (before.islower() or before.isdigit() or before in ")]”»\""):
                return False
            return (before.isdigit() or text.find(".", at, dot) < 0) and not _abbreviation(text, dot, start)
        return (nxt in OPENERS or nxt == '"') and before.isalnum() and dot + 2 < end and text[dot + 2].isupper()
    i = _skip(text, dot + 1, end)
    if i >= end:
        return True
    ch = text[i]
    if ch in ",;:":
        return False
    bare = text[at:dot].lstrip("".join(OPENERS) + '"')
    if len(bare) == 1 and (bare.isupper() or re.match(r"[^\W\d_]\.", text[i : i + 2])):
        return False  # an initial, or a shortening of several parts
    kind = _abbreviation(text, dot, start)
    if kind == "leading":
        return False
    if kind == "counted":
        return not (ch.isdigit() or ch in "+-−–.([#IVX" or ch.islower() or _caseless(ch))
    if kind == "closing":
        if len(bare) == 1 and _initial_before(text, dot - 1, start):
            return False
        return _starts_sentence(text, i, end) if ch not in "([" else text[min(i + 1, end - 1)].isupper()
    if len(bare) == 1 and bare.isalpha():
        if not text[start : dot - 1].strip():
            return False
        return _starts_sentence(text, i, end) and not _initial_before(text, dot - 1, start)
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", bare):  # further dotted shortenings
        return _starts_sentence(text, i, end) and not ch.isdigit()
    if bare.isdigit():
        if at == start and _LIST_NUMBER.fullmatch(text, at, dot):
            return False
        if len(bare) <= 2:
            after = _WORD.match(text, i)
            if after and after.group() in MONTHS:
                return False
            if ch.islower() and at > start and _word_ending(text, at, start) in ORDINAL_CUES:
                return False
    if ch.islower() and len(bare) <= 3 and bare.isalpha() and not re.search("[aeiouyаеиоуыэюяàáâäéèêëíïóôöúùûü]", bare.lower()):
        return bare.lower() in UNITS
    return True


def _word_ending(text: str, i: int, start: int) -> str:
    """The word before the white space before ``i``."""
    while i > start and text[i - 1].isspace():
        i -= 1
    j = i
    while j > start and not text[j - 1].isspace():
        j -= 1
    return text[j:i].lower()


def _split_segment(text: str, start: int, end: int, out: list[int], levels: list[tuple[str, str, int]]) -> None:
    """Append the starts and ends of the sentences of ``text[start:end]`` to ``out``.

    ``levels`` is the part of the stack that lasts from line to line: the open lists.
    """
    marker = _list_marker(text, start, end, levels)
    word = _Before(text, start)
    found = (_MARK_THAI if _THAI.search(text, start, end) else _MARK).finditer(text, start, end)
    marks = [m.span() for m in found]
    pair = _pairs(text, marks)
    begin = _skip(text, start, end)
    stack: list[int] = []
    for a, b in marks:
        if b <= begin:
            if a in pair and pair[a] > a:
                stack.append(a)
            elif a in pair and stack:
                stack.pop()
            continue
        ch = text[a]
        if a in pair:
            if pair[a] > a:
                stack.append(a)
            elif stack:
                stack.pop()
            continue
        if ch in OPENERS or ch in CLOSERS or ch == '"':
            continue
        if ch.isspace():
            if not stack:
                _emit(text, begin, a, out)
                begin = b
            continue
        # a run of terminators; closing marks that follow belong to it
        stop, left = b, list(stack)
        while stop < end and left and pair.get(left[-1]) == stop:
            left.pop()
            stop += 1
        if left:
            continue
        if stack:
            ends = _ends_after_closing(text, begin, stack[0], stop, end)
        else:
            ends = a != marker and _ends_plain(text, begin, a, b, end, word)
            while ends and stop < end and text[stop] in CLOSERS and stop not in pair:
                stop += 1
        if ends:
            _emit(text, begin, stop, out)
            begin = _skip(text, stop, end)
    _emit(text, begin, end, out)


def _ends_plain(text: str, begin: int, a: int, b: int, end: int, word: _Before) -> bool:
    run = text[a:b]
    i = _skip(text, b, end)
    if i >= end:
        return True
    nxt, spaced = text[i], i > b
    if nxt in ",;:，；：、":
        return False
    if run == ".":
        return _full_stop_ends(text, begin, a, end, word)
    if all(c in "." or c in ELLIPSES for c in run):
        if not spaced and not (nxt.isupper() or nxt in OPENERS):
            return False
        return _starts_sentence(text, i, end)
    if run == "．" and a > begin and text[a - 1].isdigit() and nxt.isdigit() and not spaced:
        return False
    if nxt in "—–-" and spaced:
        return not text[_skip(text, i + 1, end) : _skip(text, i + 1, end) + 1].islower()
    if all(c in "!?." for c in run) and not spaced:
        return nxt.isupper() or _caseless(nxt) or nxt in OPENERS or nxt == '"' or not (nxt.isalnum() or nxt in "/=&_#%.-")
    return True


def _ends_after_closing(text: str, begin: int, opener: int, stop: int, end: int) -> bool:
    """A terminator stood before the closing marks that end at ``stop``: does the sentence end too?"""
    i = _skip(text, stop, end)
    if i >= end:
        return True
    nxt = text[i]
    first = not text[begin:opener].strip("".join(OPENERS) + '"¿¡ \t\n')
    if text[opener] in BRACKETS:
        return first and not nxt.islower() and nxt not in ",;:.!?，；：。！？"
    if nxt in ",;:.!?，；：、。！？…—–-)）]" or nxt.islower():
        return False
    if nxt in OPENERS or nxt in '"¿¡':
        return True
    if _caseless(nxt):
        return not first and not text.startswith(GOES_ON, i)
    return True


def _emit(text: str, a: int, b: int, out: list[int]) -> None:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    if b > a:
        out += (a, b)


def sentences(text: str | None, layout: str | None = "prose") -> list[tuple[int, int]]:
    """Offsets in code points of the units of a text, which cover all of it but white space.

    ``lines``: each non-empty line is one unit. ``wrapped``: blank lines part units, other line
    breaks are spaces. ``prose`` and any other layout: each line break parts units. Null, empty
    and blank texts have no units.
    """
    out: list[int] = []
    if text:
        breaks = (_BLANK if layout == "wrapped" else _LINE).finditer(text)
        at, levels = 0, []
        for a, b in [*((m.start(), m.end()) for m in breaks), (len(text), len(text))]:
            if layout == "lines":
                _emit(text, at, a, out)
            else:
                _split_segment(text, at, a, out, levels)
            at = b
    return list(zip(out[::2], out[1::2]))


def _run(batches):
    for t in narrow_batches(batches, 4096, "text"):
        ids, starts, ends = [], [], []
        for i, text, layout in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), t.column("layout").to_pylist()):
            units = sentences(text, layout)
            ids.append(np.full(len(units), -1 if i is None else i, np.int64))
            starts += [u[0] for u in units]
            ends += [u[1] for u in units]
        ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "start_char", "end_char"])


def sentence_units(documents: DataFrame) -> DataFrame:
    """``doc_id, start_char, end_char`` of every unit of every text.

    Texts never leave the task that reads them; only the offsets of repeated rows meet in a
    shuffle and count once. Rows with a null id are left out, as are null, empty and blank texts.
    A document of any length is processed whole. Further columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "layout").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return docs.mapInArrow(_run, "doc_id long, start_char int, end_char int").distinct()
