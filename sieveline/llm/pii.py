"""Personal information inside free text.

High-recall generators propose overlapping spans; boosted trees score each by its format and its context; calibrated
thresholds select the spans that become typed placeholders. The trees learn from the labelled texts of the table
itself (a bounded sample); generators, scoring and selection see every text whole.
"""

from __future__ import annotations

import ast
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scale import bounded_sample, frames
from .trees import Boosted, Isotonic, by_tasks, serially

KINDS = ["email", "phone_number", "identity_number", "street_address", "name"]
#: Labels of gold spans by kind.
LABELS = {"email": "email", "phone_number": "phone_number", "street_address": "street_address", "person_name": "name", "name": "name", "ssn": "identity_number", "national_id": "identity_number", "tax_id": "identity_number", "identity_number": "identity_number"}
#: Digits as words in English, German, French and Spanish.
DIGIT_WORDS = "zero oh one two three four five six seven eight nine double null eins zwei drei vier fünf sechs sieben acht neun zéro un deux trois quatre cinq sept huit neuf cero uno dos tres cuatro cinco seis siete ocho nueve".split()
SAMPLE_TEXTS = 3_000
#: Of the proposals far from any gold span, which are many and alike, one in so many is trained on, with that weight.
FAR = 4
#: Most digits of a number: telephone numbers have up to 15, with trunk and exit codes up to 20.
DIGITS = 20
#: Longest part of a run of capitalised words of which every part is proposed; a longer run is proposed whole too.
NAME_WORDS = 8
#: Characters from the start of an address to its postcode, and parts of an address without one.
ADDRESS_REACH, ADDRESS_PARTS = 240, 5
#: Margin a span gains per character against others it overlaps.
LONGER = 0.15

S = r"[^\S\r\n]"
_DOMAIN = rf"{S}?[\w-]+(?:(?:\.|\[\.\]|\(\.\)|{S}?[(\[]{S}?dot{S}?[)\]]{S}?|{S}dot{S})[\w-]+)+"
EMAIL = re.compile(rf"[\w+-][\w.+-]*{S}?(?:@|[(\[]{S}?at{S}?[)\]]){_DOMAIN}", re.I)
EMAIL_WORDS = re.compile(rf"(?<![\w.+-])(?=([\w+-][\w.+-]*{S}at(?=\s){_DOMAIN}))", re.I)
GROUP = re.compile(r"\d+")
GAP = re.compile(rf"(?:{S}?[().\-/–]{{1,2}}{S}?|{S}{{1,2}})(?:\(0\){S}?)?")
EXTENSION = re.compile(rf"{S}?(?:,{S})?(?:ext\.?|extension|x|poste|durchwahl|dw\.?|app\.?){S}?\d{{1,5}}(?!\w)", re.I)
SPELLED = re.compile(rf"(?<!\w)(?:(?:{'|'.join(DIGIT_WORDS)})(?:[\s,-]{{1,2}}(?=\w)|(?!\w))){{6,}}", re.I)
POSTCODE = re.compile(r"(?<!\w)(?:[A-Z]{2}[^\S\r\n]\d{5}(?:-\d{4})?|[A-Z]{1,2}\d{1,2}[A-Z]?[^\S\r\n]?\d[A-Z]{2}|(?:[A-Z]{1,2}-)?\d{4,5})(?!\w)", re.I)
HOUSE = re.compile(r"(?<![\w.,/-])\d{1,4}[A-Za-z]?(?![\w/-])(?!\.\d)")
TOWN = re.compile(r"[^\S\r\n]{1,2}[^\W\d_]+(?:['’-][^\W\d_]+)*")
START = re.compile(r"(?<![\w'’-])(?:\d+|[^\W\d_][\w'’.-]*|[cC]/)")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


class _Signs(dict):
    """For ``str.translate``: each character as 9, A, a, a blank or itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        got = self[code] = "9" if c.isdecimal() else " " if c.isspace() else "A" if c.isupper() else "a" if c.isalpha() else c
        return got


_SIGNS, _LOW, _HIGH = _Signs(), re.compile("aa+"), re.compile("AA+")
_NINES = str.maketrans("0123456789", "9999999999")
SHAPED_WORD = re.compile("[Aa]+")


def shape(text: str) -> str:
    """Digits as 9, runs of small letters as a, of capitals as A, all blanks alike."""
    sh = text.translate(_SIGNS)
    if "aa" in sh:
        sh = _LOW.sub("a", sh)
    return _HIGH.sub("A", sh) if "AA" in sh else sh


def _numbers(text: str) -> Iterator[tuple[int, int]]:
    """Runs of digit groups with short gaps, and all their parts of at most DIGITS digits; with a sign, bracket, letter or extension beside them."""
    groups = [m.span() for m in GROUP.finditer(text)]
    i = 0
    while i < len(groups):
        j = i
        while j + 1 < len(groups) and GAP.fullmatch(text, groups[j][1], groups[j + 1][0]):
            j += 1
        for a in range(i, j + 1):
            digits = 0
            for b in range(a, j + 1):
                digits += groups[b][1] - groups[b][0]
                if digits < 6:
                    continue
                if digits > DIGITS and b > a:
                    break
                s, e = groups[a][0], groups[b][1]
                starts, ends = [s], [e]
                if s and text[s - 1] in "+(":
                    s -= 1
                    starts = [s] if text[s] == "+" else [s + 1, s]
                    if s and text[s - 1] in "+(":
                        starts.append(s - 1)
                m = re.search(r"(?<!\w)[A-Za-z]{1,2}[ .-]?$", text[max(0, s - 4) : s])
                if m and starts == [groups[a][0]]:
                    starts.append(s - len(m[0]))
                m = re.match(r"[ .-]?[A-Za-z](?!\w)", text[e : e + 3])
                if m:
                    ends.append(e + m.end())
                m = EXTENSION.match(text, e)
                if m:
                    ends.append(m.end())
                for x in starts:
                    for y in ends:
                        if not (x and (text[x - 1].isalnum() or text[x - 1] == "_")) and not (y < len(text) and (text[y].isalnum() or text[y] == "_")):
                            yield x, y
        i = j + 1


#: Words that begin in lower case and yet may begin an address.
LOW_STARTS = ("flat", "apt", "unit", "the", "c/", "suite", "calle", "rue")
_PLACE = r"(?:[^\W\d_][\w'’-]{0,3}\.|[^\W\d_][\w'’-]*)"
PART = re.compile(rf"(?:\d+[A-Za-z]?|{_PLACE})(?:{S}(?:\d+[A-Za-z]?|(?:[dD]e|[dD]el|[lL]a|[lL]as|[dD]u|[dD]es|[vV]on|[aA]m|[zZ]ur|of|the)\b|(?![a-z]){_PLACE})){{0,5}}")
BETWEEN = re.compile(rf"{S}?(?:,|{S}-){S}?(?:\r?\n)?|\r?\n")


def _starts(text: str, low: int, high: int) -> Iterator[int]:
    for s in START.finditer(text, low, high):
        if s.start() == low and low and not text[low - 1].isspace():
            continue
        if s[0][0].islower() and s[0][:5].lower().rstrip(" .") not in LOW_STARTS and not s[0].lower().startswith(LOW_STARTS):
            if not re.search(r"(?:^|[:;|=\"(]\s?)$", text[max(0, s.start() - 3) : s.start()]):
                continue
        yield s.start()


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """From every possible start to a postcode (and the town behind it), and chains of parts, one of which has a house
    number, to a town or state."""
    for m in POSTCODE.finditer(text):
        ends = [m.end()]
        if m[0][-1].isdigit() and not re.match(r"[A-Za-z]{2}\s", m[0]):
            t = TOWN.match(text, m.end())
            if not t or not t[0].strip()[0].isupper():
                continue
            ends = [t.end()]
            t2 = TOWN.match(text, t.end())
            if t2 and t2[0].strip()[0].isupper():
                ends.append(t2.end())
        for s in _starts(text, max(0, m.start() - ADDRESS_REACH), m.start()):
            for e in ends:
                yield s, e
    for m in HOUSE.finditer(text):
        # The part that holds the number, from each of its words on, and up to ADDRESS_PARTS - 1 parts after it.
        begin = max(text.rfind(c, max(0, m.start() - 60), m.start()) for c in "\n,;:.(|") + 1
        ends, at = [], PART.match(text, m.start())
        while at and len(ends) < ADDRESS_PARTS:
            ends.append(at.end())
            gap = BETWEEN.match(text, at.end())
            at = PART.match(text, gap.end()) if gap else None
            if at and not (at[0][0].isupper() or at[0][0].isdigit()):
                at = None
        for s in _starts(text, begin, m.start() + 1):
            for e in ends[1:]:
                yield s, e


class NameWords:
    """How often a word stands inside, first in and last in gold names; ``known`` are words mostly used so."""

    def __init__(self, rates: dict[str, tuple[int, int, int, int]]):
        self.rates = rates
        self.known = {w for w, (inside, _, _, total) in rates.items() if inside >= 2 and inside >= 0.1 * total}

    def of(self, w: str) -> tuple[float, float, float, float]:
        inside, first, last, total = self.rates.get(w.lower(), (0, 0, 0, 0))
        return inside / (total + 2), first / (inside + 1), last / (inside + 1), math.log1p(total)


#: Small words inside names.
PARTICLES = frozenset("de del della di da das do dos du des von van vom zu zur zum den der dem ter ten la las le les los y e i of bin ibn al el af av".split())


def _names(text: str, lexicon: NameWords) -> Iterator[tuple[int, int]]:
    """Every part, up to NAME_WORDS words, of every run of name-like words, initials and the particles between them;
    the family name may come first, before a comma. Longer runs are proposed whole too."""
    words = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text)]
    n, known = len(words), lexicon.known
    # 2 for a word like a name, 1 for an initial, -1 for a particle, 0 for others.
    kind = [0] * n
    for i, (_, e, w) in enumerate(words):
        if len(w) == 1:
            kind[i] = 1 if e < len(text) and text[e] == "." else 0
        elif w[0].isupper() or w.lower() in known or ("-" in w and any(p in known for p in w.lower().split("-"))):
            kind[i] = 2
        elif w.lower() in PARTICLES:
            kind[i] = -1
    # Whether a word goes on after the one before it: 1 after a blank, 2 after a comma.
    after = [0] * n
    for i in range(1, n):
        gap = text[words[i - 1][1] : words[i][0]]
        if (len(gap) == 1 and gap.isspace()) or (len(words[i - 1][2]) == 1 and gap in (". ", ".", ".\n", ".\xa0")):
            after[i] = 1
        elif gap in (", ", ",\n", ",\xa0"):
            after[i] = 2
    for i in range(n):
        if kind[i] < 1:
            continue
        s, j, commas, last = words[i][0], i, 0, None
        if kind[i] == 2:
            yield s, words[i][1]
        while j + 1 < n and after[j + 1]:
            j += 1
            lone = len(words[j][2]) == 1 and not kind[j]
            if after[j] == 2:
                commas += 1
                if commas > 1 or j > i + 2:
                    break
            if not kind[j] and not lone:
                break
            if kind[j] > 0:
                last = (s, words[j][1] + (kind[j] == 1))
                if j - i < NAME_WORDS:
                    yield last
                elif not i or not after[i]:
                    continue
                else:
                    break
        if last and j - i >= NAME_WORDS:
            yield last


#: Groups of proposals and the kinds each is scored for; a number may be either.
GROUPS = {0: (0,), 1: (1, 2), 3: (3,), 4: (4,)}


def candidates(text: str, lexicon: NameWords) -> list[tuple[int, int, int]]:
    """(start, end, group number) of all proposals, without repeats."""
    out = {(m.start(), m.end(), 0) for m in EMAIL.finditer(text)} | {(*m.span(1), 0) for m in EMAIL_WORDS.finditer(text)}
    out.update((s, e, 1) for s, e in _numbers(text))
    for m in SPELLED.finditer(text):
        out.add((m.start(), m.start() + len(m[0].rstrip(" ,-\n\t\xa0")), 1))
    out.update((s, e, 3) for s, e in _addresses(text))
    out.update((s, e, 4) for s, e in _names(text, lexicon))
    return sorted(out)


HYPHENED = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)+")
_NAME = r"([^\W\d_]+(?:-[^\W\d_]+)*)"
NAME_AFTER, COMMA_NAME, INITIAL_AFTER = re.compile(r"[ ]" + _NAME), re.compile(r",[ ]" + _NAME), re.compile(r"[ ][^\W\d_]\.")


class _Memo(dict):
    """A function's results by argument; emptied when it holds too many."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) > 200_000:
            self.clear()
        got = self[key] = self.make(key)
        return got


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_HASHED = _Memo(_hash)


def _word_before(near: str) -> str | None:
    """The letters and hyphens a text ends with."""
    i = len(near)
    while i and (near[i - 1].isalpha() or near[i - 1] == "-"):
        i -= 1
    return near[i:].strip("-") or None


def _compound(lexicon: NameWords, w: str) -> tuple[float, float, float, float]:
    got = lexicon.of(w)
    if "-" in w and got[3] < 1.5:
        parts = [lexicon.of(p) for p in w.split("-")]
        return tuple(min(p[i] for p in parts) for i in range(4))
    return got


class Facts:
    """Format and context of proposals. What depends only on the start, on the end or on the words themselves is read once
    for all proposals that share it, names for all texts."""

    def __init__(self, lexicon: NameWords):
        self.lexicon = lexicon
        self.names = _Memo(self._name)
        self.around = _Memo(lambda w: _compound(lexicon, w)[:3] if w else (-1.0, -1.0, -1.0))

    def __getstate__(self) -> dict:
        return {"lexicon": self.lexicon}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["lexicon"])

    def _left(self, text: str, s: int, name: bool) -> tuple:
        near = text[max(0, s - 45) : s]
        words = near.lower().translate(_NINES).split()[-2:]
        out = (_HASHED[words[-1] if words else "^"], _HASHED[" ".join(words)], ord(text[s - 1]) if s else 0), (float(s > 0 and text[s - 1].isspace()),)
        if not name:
            return out
        before = _word_before(near[:-1].removesuffix(".")) if near[-1:] == " " else None
        comma = _word_before(near[:-2]) if near[-2:] == ", " else None
        return out[0], out[1] + (*self.around[before], *self.around[comma], float(len(near) > 2 and near[-2:] == ". " and near[-3].isalpha()))

    def _right(self, text: str, e: int, name: bool) -> tuple:
        near = text[e : e + 30]
        words = near.lower().translate(_NINES).split(None, 1)
        out = (_HASHED[words[0] if words else "$"], ord(near[0]) if near else 0), (float(near[:1].isspace()),)
        if not name:
            return out[0], out[1] + (float(EXTENSION.match(text, e) is not None),)
        after, comma = NAME_AFTER.match(near), COMMA_NAME.match(near)
        return out[0], out[1] + (*self.around[after and after[1]], *self.around[comma and comma[1]], float(INITIAL_AFTER.match(near) is not None))

    @staticmethod
    def _plain(x: str) -> tuple:
        words = x.lower().translate(_NINES).split() or [""]
        sh = shape(x)
        low = "a" in sh
        nums = (float(len(x)), float(sh.count("9")), float(len(SHAPED_WORD.findall(sh))) if low or "A" in sh else 0.0, float(x.count(",") + x.count("\n") + x.count(" - ")), float(not low and "A" in sh), float(sh[:1] == "A"),
                float((low or "A" in sh) and EXTENSION.search(x) is not None))
        return sh, words[0], words[-1], nums

    def _name(self, x: str) -> tuple:
        plain = x if x.isupper() else HYPHENED.sub("Xx" if x[:1].isupper() else "xx", x)
        _, first, last, nums = self._plain(x)
        own = [w for w in WORD.findall(x) if len(w) > 1]
        got = [_compound(self.lexicon, w) for w in own] or [(0.0, 0.0, 0.0, 0.0)]
        low = [w.lower() for w in own] or [""]
        cats = (_HASHED[re.sub(r"[A-Z]\.", "I.", shape(plain))], _HASHED[first], _HASHED[last], _HASHED[low[-1][-4:]], _HASHED[low[0][:4]], _HASHED[f"fg{low[0]}" if len(own) == 1 else f"f2{low[0]}"])
        return cats, (*nums, float(len(own)), min(g[0] for g in got), max(g[0] for g in got), got[0][1], got[-1][2], min(g[3] for g in got), got[0][2], got[-1][1], float("," in x), float("." in x))

    def of(self, text: str, locale: str, proposals: list[tuple[int, int, int]]) -> list[tuple[tuple, tuple]]:
        """(categorical facts as numbers, numeric facts) of each proposal."""
        lefts: dict[tuple[int, bool], tuple] = {}
        rights: dict[tuple[int, bool], tuple] = {}
        place, out = _HASHED[locale], []
        for s, e, group in proposals:
            name = group == 4
            left = lefts.get((s, name))
            if left is None:
                left = lefts[s, name] = self._left(text, s, name)
            right = rights.get((e, name))
            if right is None:
                right = rights[e, name] = self._right(text, e, name)
            x = text[s:e]
            if name:
                inside, nums = self.names[x]
            else:
                sh, first, last, nums = self._plain(x)
                inside = _HASHED[re.sub("9+", "9", sh) if group == 3 else sh], _HASHED[first], _HASHED[last]
            out.append(((place, *left[0], *right[0], *inside), (*left[1], *right[1], *nums)))
        return out


_ODD = np.int64(-7046029254386353131)


def _ids(facts: list[tuple]) -> np.ndarray:
    """One column of keys for each kind of fact: words on either side, form, form by locale, glued characters, own words."""
    a = np.array(facts, np.int64)
    place, left, left2, before, right, after, form, *own = a.T
    columns = [form, form * _ODD ^ place, left, left2, right, before * 1_114_112 + after, *own]
    return np.column_stack([(c + np.int64(i + 1)) * _ODD ^ np.int64((i + 1) * 0x1F123BB5) for i, c in enumerate(columns)])


def gold(text: str, spans: str) -> list[tuple[int, int, str]] | None:
    """Parsed gold spans of known kinds; a span whose offsets don't hold its text is moved to the nearest place that does."""
    try:
        got = ast.literal_eval(spans)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    out = []
    for g in got if isinstance(got, list) else []:
        if not isinstance(g, dict) or not isinstance(g.get("text"), str) or not isinstance(g.get("start"), int) or not g["text"]:
            continue
        kind = LABELS.get(str(g.get("label")))
        if kind is None:
            continue
        s, x = g["start"], g["text"]
        if text[s : s + len(x)] != x:
            near = [m.start() for m in re.finditer(re.escape(x), text)]
            if not near:
                continue
            s = min(near, key=lambda p: abs(p - g["start"]))
        out.append((s, s + len(x), kind))
    return out


class Encoder:
    """Smoothed rates of one kind's categorical facts."""

    def __init__(self, ids: np.ndarray, y: np.ndarray):
        self.keys, inverse = np.unique(ids.ravel(), return_inverse=True)
        self.n = np.bincount(inverse, minlength=len(self.keys)).astype(np.float32)
        self.pos = np.bincount(inverse, np.repeat(y, ids.shape[1]) if ids.size else None, len(self.keys)).astype(np.float32)
        self.prior = (y.sum() + 1) / (len(y) + 20)

    def rates(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((len(ids), 2 * ids.shape[1]))
        at = np.minimum(np.searchsorted(self.keys, ids), len(self.keys) - 1)
        hit = self.keys[at] == ids
        n, pos = np.where(hit, self.n[at], 0), np.where(hit, self.pos[at], 0)
        return np.concatenate([(pos + 3 * self.prior) / (n + 3), np.log1p(n)], 1)


class Model:
    """Generators' lexicon, encoders, trees, calibration and thresholds, by kind."""

    def __init__(self) -> None:
        self.lexicon, self.facts = NameWords({}), Facts(NameWords({}))
        self.encoders: dict[int, Encoder] = {}
        self.trees: dict[int, Boosted] = {}
        self.calibration: dict[int, Isotonic] = {}
        self.thresholds: dict[int, float] = {}

    def score(self, text: str, locale: str) -> list[tuple[int, int, int, float, float]]:
        return self.score_all([(text, locale)])[0]

    def score_all(self, texts: list[tuple[str, str]]) -> list[list[tuple[int, int, int, float, float]]]:
        """(start, end, kind, probability, margin) of each text's proposals; of all proposals, none is ruled out before."""
        found: dict[int, tuple[list, list, list]] = {g: ([], [], []) for g in GROUPS}
        wanted = {g for g, kinds in GROUPS.items() if any(k in self.trees for k in kinds)}
        for i, (text, locale) in enumerate(texts):
            got = [c for c in candidates(text, self.lexicon) if c[2] in wanted]
            for c, (cats, nums) in zip(got, self.facts.of(text, locale, got)):
                where = found[c[2]]
                where[0].append((i, c[0], c[1]))
                where[1].append(cats)
                where[2].append(nums)
        out: list[list] = [[] for _ in texts]
        for g, (where, cats, nums) in found.items():
            if not where:
                continue
            ids, nums = _ids(cats), np.array(nums, np.float32)
            for k in GROUPS[g]:
                if k in self.trees:
                    margin = self.trees[k].margin(np.hstack([self.encoders[k].rates(ids), nums]))
                    good = np.flatnonzero(margin >= self.thresholds[k] - 1e-9)
                    for at, p in zip(good, self.calibration[k].predict(margin[good])):
                        i, s, e = where[at]
                        out[i].append((s, e, k, float(p), float(margin[at])))
        return out

    def select(self, scored: list[tuple[int, int, int, float, float]]) -> list[tuple[int, int, int]]:
        """Spans above their kind's threshold, the best first, none that overlaps a better one."""
        taken: list[tuple[int, int, int]] = []
        over = [c for c in scored if c[4] >= self.thresholds[c[2]]]
        for s, e, k, _, _ in sorted(over, key=lambda c: (-c[4] - LONGER * (c[1] - c[0]), c[:3])):
            if all(e <= a or s >= b for a, b, _ in taken):
                taken.append((s, e, k))
        return sorted(taken)


STANDING = re.compile(r"(?<![\w@.+/'’-])[^\W\d_]+(?:['’-][^\W\d_]+)*(?![\w@+/'’-]|\.\w)")


def _lexicon(docs: list[tuple[str, str, list]]) -> NameWords:
    inside: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for text, _, spans in docs:
        for m in STANDING.finditer(text):
            inside[m[0].lower()][3] += 1
        for s, e, kind in spans:
            if kind != "name":
                continue
            own = [w.lower() for w in WORD.findall(text[s:e]) if len(w) > 1]
            swap = "," in text[s:e]
            for i, w in enumerate(own):
                r = inside[w]
                r[0] += 1
                if len(own) > 1:
                    r[2 if (i == len(own) - 1) != swap else 1] += 1
    return NameWords({w: tuple(r) for w, r in inside.items()})


def _rows(lexicons: list[NameWords], part: tuple[int, list]) -> list[tuple | None]:
    """By kind, of the texts from the given number on: text number, start and end, facts, numbers, label, weight."""
    begin, docs = part
    got: dict[int, tuple[list, ...]] = {g: ([], [], [], [], []) for g in GROUPS}
    labels: list[list[bool]] = [[] for _ in KINDS]
    facts = [Facts(lexicon) for lexicon in lexicons]
    for i, (text, locale, spans) in enumerate(docs, begin):
        true = {(s, e, KINDS.index(k)) for s, e, k in spans}
        use = []
        for c in candidates(text, lexicons[i % FOLDS]):
            far = not any(a < c[1] and c[0] < b for a, b, _ in true)
            if not far or not (c[0] * 31 + c[1] * 17 + i) % FAR:
                use.append((c, far))
        for (c, far), (cats, nums) in zip(use, facts[i % FOLDS].of(text, locale, [c for c, _ in use])):
            for column, v in zip(got[c[2]], (i, c[:2], cats, nums, float(FAR) if far else 1.0)):
                column.append(v)
            for k in GROUPS[c[2]]:
                labels[k].append((c[0], c[1], k) in true)
    out: list[tuple | None] = [None] * len(KINDS)
    for g, (d, p, a, n, w) in got.items():
        if d:
            shared = np.array(d), np.array(p), _ids(a), np.array(n, np.float32)
            for k in GROUPS[g]:
                out[k] = (*shared, np.array(labels[k], np.float32), np.array(w, np.float32))
    return out


class _Table:
    """All proposals of the labelled texts, by kind."""

    def __init__(self, docs: list, lexicons: list[NameWords], spread):
        self.true = [[(s, e) for s, e, _ in spans] for _, _, spans in docs]
        parts = spread(_rows, lexicons, [(i, docs[i : i + 100]) for i in range(0, len(docs), 100)])
        self.kinds = []
        for k in range(len(KINDS)):
            own = [p[k] for p in parts if p[k]]
            self.kinds.append(tuple(np.concatenate(c) for c in zip(*own)) if own else None)

    def encoder(self, kind: int, without: int | None = None) -> Encoder:
        doc, _, cats, _, y, _ = self.kinds[kind]
        keep = np.ones(len(doc), bool) if without is None else doc % FOLDS != without
        return Encoder(cats[keep], y[keep])


FOLDS = 3


def _apart(doc: np.ndarray, place: np.ndarray, margin: np.ndarray) -> list[int]:
    """Candidates by falling margin, without those that overlap a better one of their text."""
    taken: dict[int, list[tuple[int, int]]] = defaultdict(list)
    kept = []
    for i in np.argsort(-margin - LONGER * (place[:, 1] - place[:, 0]), kind="stable"):
        s, e = place[i]
        if margin[i] > -4 and all(e <= a or s >= b for a, b in taken[doc[i]]):
            taken[doc[i]].append((s, e))
            kept.append(int(i))
    return sorted(kept, key=lambda i: -margin[i]) or [0]


def _fitted(data: dict, job: tuple[int, int | None, dict]) -> np.ndarray | Boosted:
    """Margins of one fold by a model of the others, or a model of all."""
    kind, fold, params = job
    x, y, weight, folds = data[kind]
    if fold is None:
        return Boosted(**params).fit(x, y, weight)
    own = folds == fold
    return Boosted(**params).fit(x[~own], y[~own], weight[~own]).margin(x[own])


def fit(docs: list[tuple[str, str, list[tuple[int, int, str]]]], spread=serially) -> Model:
    """A model from (text, locale, gold spans). Texts whose gold misses what the first round finds without doubt are
    left out of the second round, as their gold is incomplete. Without any gold the model finds nothing."""
    model = Model()
    for round_no in range(2):
        # Each text sees the name words of the others, so that unknown names occur in training too.
        table = _Table(docs, [_lexicon([d for i, d in enumerate(docs) if i % FOLDS != k]) for k in range(FOLDS)], spread)
        data = {}
        for kind, t in enumerate(table.kinds):
            if t and len(t[4]) >= 20 and t[4].sum() >= 5:
                doc, _, cats, nums, y, weight = t
                x = np.zeros((len(y), 2 * cats.shape[1] + nums.shape[1]), np.float32)
                for k in range(FOLDS):
                    at = doc % FOLDS == k
                    x[at] = np.hstack([table.encoder(kind, k).rates(cats[at]), nums[at]])
                data[kind] = x, y, weight, doc % FOLDS
        # Gold is wrong in places, so leaves are large and steps are damped.
        params = {"depth": 4, "leaf": 12.0, "ridge": 6.0} | ({"trees": 50, "rate": 0.2} if round_no else {"trees": 25, "rate": 0.4})
        # Names and identity numbers take many forms and contexts, so they get finer trees.
        own = {kind: params | ({"leaf": 6.0, "ridge": 3.0, "depth": 5, "trees": params["trees"] * 3 // 2} if KINDS[kind] in ("name", "identity_number") else {}) for kind in data}
        jobs = [(kind, k, own[kind]) for kind in data for k in range(FOLDS)]
        if round_no:
            jobs += [(kind, None, own[kind]) for kind in data]
        results = dict(zip(((kind, k) for kind, k, _ in jobs), spread(_fitted, data, jobs)))
        suspect: set[int] = set()
        for kind, (_, y, weight, folds) in data.items():
            doc, place = table.kinds[kind][:2]
            oof = np.zeros(len(y))
            for k in range(FOLDS):
                oof[folds == k] = results[kind, k]
            for i, (s, e), m, v in zip(doc, place, oof, y):
                if not v and m > 1.0 and not any(a < e and s < b for a, b in table.true[i]):
                    suspect.add(int(i))
            order = np.array(_apart(doc, place, oof))
            tp, n = np.cumsum(y[order]), np.cumsum(weight[order])
            f1 = 2 * tp / (n + y.sum())
            even = int((oof[order] > 0).sum()) - 1
            # Where even odds are about as good as the best cut, they are the safer one: gold that is incomplete favours too high a cut.
            best = even if even >= 0 and f1[even] >= f1.max() - 0.01 else int(f1.argmax())
            after = oof[order[best + 1]] if best + 1 < len(order) else oof[order[best]] - 1
            model.calibration[kind] = Isotonic().fit(np.repeat(oof, weight.astype(int)), np.repeat(y, weight.astype(int)))
            model.thresholds[kind] = float((oof[order[best]] + after) / 2)
            if round_no:
                model.trees[kind] = results[kind, None]
                model.encoders[kind] = table.encoder(kind)
        if not round_no:
            docs = [d for i, d in enumerate(docs) if i not in suspect]
    model.lexicon = _lexicon(docs)
    model.facts = Facts(model.lexicon)
    return model


def trained(df: DataFrame, record: str, text: str, spans: str, locale: str, sample: int = SAMPLE_TEXTS) -> Model:
    """A model fitted on at most ``sample`` labelled texts, chosen by hash."""
    rows = df.select(F.col(record).alias("record"), F.col(text).alias("text"), F.col(locale).alias("locale"), F.col(spans).alias("spans")).where("text IS NOT NULL AND spans IS NOT NULL")
    got = bounded_sample(rows, ["record", "text"], sample).collect()
    docs = [(r["text"], r["locale"] or "", g) for r in sorted(got, key=lambda r: (str(r["record"]), r["text"])) if (g := gold(r["text"], r["spans"])) is not None]
    return fit(docs, by_tasks(df.sparkSession))


def find_spans(df: DataFrame, record: str, text: str, locale: str, model: Model) -> DataFrame:
    """(record, span_start, span_end, kind): 0-based half-open code-point offsets in every text.

    Null and empty texts have no spans. Null locales are a locale of their own. Repeated rows give repeated spans. Very
    long texts are read whole. Other columns are ignored. Spans of a text never overlap.
    """
    kind = dict(df.dtypes)[record]
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(record).alias("record"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(locale).cast("string"), F.lit("")).alias("locale")).where("text IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                part = pdf.iloc[i : i + 500]
                out = [(r, s, e, KINDS[k]) for r, scored in zip(part["record"], m.score_all(list(zip(part["text"], part["locale"])))) for s, e, k in m.select(scored)]
                if out:
                    yield from frames(dict(zip(("record", "span_start", "span_end", "kind"), map(list, zip(*out)))))

    return rows.mapInPandas(run, f"record {kind}, span_start int, span_end int, kind string").withColumnRenamed("record", record)


def redact(df: DataFrame, record: str, text: str, locale: str, model: Model) -> DataFrame:
    """(record, redacted, n_spans): each text with its spans replaced by ``[KIND]`` and nothing else changed; a null text stays null."""
    kind = dict(df.dtypes)[record]
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(record).alias("record"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(locale).cast("string"), F.lit("")).alias("locale"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                part = pdf.iloc[i : i + 500]
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                redacted, n = [], []
                for raw, t, scored in zip(part["text"], texts, m.score_all(list(zip(texts, part["locale"])))):
                    spans, at, new = m.select(scored), 0, []
                    for s, e, k in spans:
                        new += [t[at:s], f"[{KINDS[k].upper()}]"]
                        at = e
                    redacted.append("".join([*new, t[at:]]) if isinstance(raw, str) else None)
                    n.append(len(spans))
                yield from frames({"record": list(part["record"]), "redacted": redacted, "n_spans": n})

    return rows.mapInPandas(run, f"record {kind}, redacted string, n_spans int").withColumnRenamed("record", record)
