"""Sentence units in ten languages and their scripts, by a linear-chain model.

A text is cut into blocks (headings, list items, paragraphs, fenced code). The
characters of a block are tagged boundary or inside. In marked scripts only the
ends of mark clusters, with what closes behind them, can be boundaries, so
Viterbi over these places is Viterbi over all characters. In scripts that set no
sentence marks (Thai, Lao, Khmer, Burmese) the places are the white space between
letters, and, where none is written, every character before which a known end
and behind which a known beginning of a sentence stands.

The weights are an averaged structured perceptron's, fitted to all documents and
the built-in lines below. What training sees of each block is written once, repeats
told by their contents, and dealt into parts by hash; each part is fitted with the
built-in lines, the weights are mixed, and fitted once more from the mixture. How the
rows lie in files or tasks does not change the parts. Marked text is
labelled by a conservative rule set, whose knowledge of words the features do not
share: they see the words themselves. For unmarked scripts sentences are taken
from where text is set apart by white space, stripped of it and joined anew: with
a space, which is then a boundary, without one, where only the letters on both sides can
tell, and with spaces put inside sentences, which are none.

Defined results: null and blank texts have no units; a byte-order mark belongs
to none; repeated rows count once; of different texts under one id the greatest
counts; positions are code points of the text as stored; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.rows import one_text_each, own_id, spread, whole_id
from codeloom.sources.tables import Scratch

#: Characters of training data that one task fits at a time; all parts together are the whole corpus.
PART = 4_000_000
EPOCHS = 8
#: Where there are several parts, how often they are fitted and mixed; the epochs are shared among these rounds.
ROUNDS = 2
#: Weights cross tasks as whole numbers of this fraction, so that sums do not depend on their order.
FINE = 1 << 24
#: Characters before and behind a place that features can see.
SEEN = 40

_UNMARKED = "ก-๛ກ-ໟក-៿က-႟"
_CJK = "぀-ヿ㐀-鿿豈-﫿＀-￯"
_CLOSERS = "\"'”’»」』）)\\]】》›"
_CANDIDATE = re.compile(
    rf"(?:[.!?…。！？।॥؟۔｡．]+)(?:[   ]?»|[{_CLOSERS}*_])*"
    rf"|(?<=[{_UNMARKED}])[ \t 　\r\n]+(?=[“\"«(]?[{_UNMARKED}A-Z])"
)
_UNMARKED_RUN = re.compile(rf"[{_UNMARKED}]{{8,}}")
_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]|$)")
_ITEM = re.compile(r"[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]+\S")
_QUOTE = re.compile(r"[ \t]{0,3}>")


def blocks(s: str) -> list[tuple[int, int, bool]]:
    """(start, end, fenced) of the blocks of a text, outer white space left out."""
    out: list[tuple[int, int, bool]] = []
    start = -1
    at = 0
    n = len(s)
    last_quote = False

    def close(end: int) -> None:
        nonlocal start
        if start >= 0:
            _add(out, s, start, end, False)
        start = -1

    while at < n:
        stop = s.find("\n", at)
        stop = n if stop < 0 else stop
        line = s[at:stop]
        bare = line.strip().lstrip("﻿").strip()
        shown = line.lstrip("﻿")
        if not bare:
            close(at)
            last_quote = False
        elif m := _FENCE.match(shown):
            close(at)
            mark = m[1]
            end = stop
            k = stop + 1
            while k < n:
                e = s.find("\n", k)
                e = n if e < 0 else e
                inner = s[k:e].strip()
                end = e
                if inner.startswith(mark[0] * len(mark)) and not inner.strip(mark[0]):
                    break
                k = e + 1
            else:
                end = n
            _add(out, s, at, end, True)
            stop = end
            last_quote = False
        elif _HEADING.match(shown):
            close(at)
            _add(out, s, at, stop, False)
            last_quote = False
        else:
            quoted = bool(_QUOTE.match(shown))
            if (m := _ITEM.match(shown)) and not _wrapped(s[start:at] if start >= 0 else "", m[0]) or quoted and not last_quote:
                close(at)
            if start < 0:
                start = at
            last_quote = quoted or (last_quote and start >= 0)
        at = stop + 1
    close(n)
    return out


def _wrapped(above: str, mark: str) -> bool:
    """Whether what looks like a numbered item is a line broken inside a paragraph: a number other than one, or one in an open bracket, cannot begin a list there."""
    mark = mark.strip()
    if not above.strip() or not mark[0].isdigit() or _ITEM.match(above.lstrip("﻿")):
        return False
    return not re.match(r"1[.)]", mark) or above.count("(") > above.count(")")


def _add(out: list, s: str, a: int, b: int, fenced: bool) -> None:
    while a < b and (s[a].isspace() or s[a] == "﻿"):
        a += 1
    while b > a and (s[b - 1].isspace() or s[b - 1] == "﻿"):
        b -= 1
    if a < b:
        out.append((a, b, fenced))


# fixed values: abbreviations that never end a sentence, and those that may
_NEVER = frozenset(
    "no nos nr fig figs abb abschn kap vgl cf vs est approx ca env aprox max min. bzw evtl ggf inkl exkl sog e.g i.e viz e.g. z.b d.h u.a p.ex p.ej ej ex pág págs cap art núm vol eq sec ch pp рис ок стр см им гл табл ул д-р डॉ श्री jan feb mar apr jun jul aug sep sept oct nov dec incl".split()
) - {"min."}
_TITLES = frozenset("Mr Mrs Ms Dr Prof Fr Hr Hrn St Mme Mlle M MM Sr Sra Dra Srta Проф Д-р Messrs Rev Hon Sgt Lt Col Gen".split())
_MAYBE = frozenset("etc usw inc ltd co corp gmbh al a.m p.m jr h ч мин г мб тыс д п m.".split())
_ORDINAL_BEFORE = frozenset("der die das den dem des am im zum zur vom beim ab seit bis jeder jeden jedem jedes diesem dieser nächsten und oder mit erst el la".split())
#: Words that begin a sentence rather than go on with a name behind initials.
_STARTERS = frozenset("It The This That These Those He She We They You There Then In On At If When While After Before But And So A An Its Our No Yes".split())
_OPEN = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "《": "》", "‘": "’", "[": "]", "【": "】"}
_OPENERS = frozenset(_OPEN) | {'"', "¿", "¡", "`", "*", "_"}
_CLOSE_MARKS = frozenset("”“»」』）)]】》\"’")


_MARKS = re.compile("[" + re.escape("".join(sorted({"`", '"', "”", *_OPEN, *_OPEN.values()} - {"‘", "’"}))) + "]")


class Quotes:
    """For each place of a block: how many quotes and brackets are open behind it, and where the outermost opened (-1: none). Only marks are looked at."""

    def __init__(self, s: str, a: int, b: int):
        depth: list[str] = []
        first = last_first = -1
        code = False
        self.at: list[int] = []
        self.states: list[tuple[int, int]] = []
        for m in _MARKS.finditer(s, a, b):
            k, c = m.start(), m[0]
            if c == "`":
                code = not code
            elif code:
                continue
            elif depth and c == depth[-1]:
                depth.pop()
                if not depth:
                    last_first, first = first, -1
            elif c == '"':
                if k == a or not s[k - 1].isalnum():
                    depth.append('"')
                    first = k if len(depth) == 1 else first
                else:
                    continue
            elif c in _OPEN:
                depth.append("“" if c == "„" else _OPEN[c])
                first = k if len(depth) == 1 else first
            elif c == "”" and depth and depth[-1] in ("“", '"'):
                depth.pop()
                if not depth:
                    last_first, first = first, -1
            else:
                continue
            self.at.append(k)
            self.states.append((len(depth) + code, first if depth else last_first))
        # a mark that is never closed quotes nothing
        self.unclosed = self.states[-1][1] if depth else b

    def open(self, k: int) -> int:
        n = bisect_right(self.at, k) - 1
        return self.states[n][0] if n >= 0 and k < self.unclosed else 0

    def opened(self, k: int) -> int:
        n = bisect_right(self.at, k) - 1
        return self.states[n][1] if n >= 0 else -1


_WORD_AFTER = re.compile(r"[*_\"“«(]*([^\W\d_]*)")
_WORD_BACK = re.compile(r"[^\s(（“„«「『\"‘\[`*]*")


def _last_word(t: str) -> str:
    """What a text ends with since its last blank or opening mark."""
    return _WORD_BACK.match(t[::-1])[0][::-1]




def _kind(n: str) -> str:
    """What the text after a place begins with."""
    k = 0
    while k < len(n) and n[k] in "*_":
        k += 1
    if k >= len(n):
        return "end"
    c = n[k]
    if c in "—–-" and n[k + 1 : k + 2].isspace() or c in "—–":
        return "dash"
    if c in ",;:،；：，、)”»":
        return "comma"
    if c.isdigit():
        return "digit"
    if c in _OPENERS:
        return "open"
    if "฀" <= c <= "๿":
        return "thai"
    if "぀" <= c <= "鿿" or "＀" <= c <= "￯" or "豈" <= c <= "﫿":
        return "cjk"
    if c.isupper() or c.istitle():
        return "upper"
    if c.islower():
        word = re.match(r"[^\s,;:!?()]+", n[k:])[0].rstrip(".")
        if "." in word and not word.endswith(".") and re.match(r"[a-z]\w*\.[a-z]", word) or re.match(r"[a-z]{1,2}[A-Z]", word):
            return "name"
        return "lower"
    if c.isalpha():
        return "uncased"
    return "other"


class Place:
    """A place where a unit may end: its end, where the next would start, and what is seen there."""

    #: In a block without capitals any letter may begin a unit.
    __slots__ = ("end", "next", "mark", "closers", "word", "before", "kind", "open", "opened", "prev", "gap", "stem", "after", "left", "right", "masked")

    def __init__(self, s: str, a: int, b: int, m: re.Match, quotes: Quotes):
        t = m[0]
        if t[0].isspace():
            self.mark, self.closers, self.end, self.next = " ", "", m.start(), m.end()
            self.gap = "s"
        else:
            k = 0
            while k < len(t) and t[k] in ".!?…。！？।॥؟۔｡．":
                k += 1
            self.mark, self.closers = t[:k], t[k:].strip()
            self.end = m.end()
            e = m.end()
            while e < b and s[e].isspace():
                e += 1
            self.next = e
            self.gap = "" if e == m.end() else "s"
        head = s[max(a, m.start() - SEEN) : m.start()]
        self.word = _last_word(head)
        rest = head[: len(head) - len(self.word)].rstrip()
        self.before = _last_word(rest) if rest else ""
        self.kind = _kind(s[self.next : min(b, self.next + SEEN)]) if self.next < b else "end"
        self.open = quotes.open(self.end - 1 if self.mark != " " else m.start() - 1)
        self.opened = quotes.opened(self.end - 1)
        self.prev = s[m.start() - 1] if m.start() > a else ""
        self.stem = self.word.lower()
        self.after = _WORD_AFTER.match(s, self.next, min(b, self.next + SEEN))[1]
        self.left = self.right = ""
        self.masked = False
        if self.mark == " ":
            self.left, self.right = s[max(a, self.end - SEEN) : self.end], s[self.next : min(b, self.next + SEEN)]


class Junction:
    """A place in a run of unmarked script where nothing is written between two letters."""

    __slots__ = ("end", "next", "left", "right", "opened")
    mark = ""
    masked = False
    kind = "thai"

    def __init__(self, s: str, a: int, b: int, at: int):
        self.end = self.next = at
        self.left, self.right = s[max(a, at - SEEN) : at], s[at : min(b, at + SEEN)]
        self.opened = -1


def places(s: str, a: int, b: int, edges: tuple[frozenset, frozenset] | None = None) -> list:
    """The places of one block, its end not among them. `edges`: letters that end and that begin known sentences of unmarked scripts."""
    out = []
    small = quotes = None
    for m in _CANDIDATE.finditer(s, a, b):
        if m.end() >= b:
            continue  # the block ends there anyway
        quotes = quotes or Quotes(s, a, b)
        p = Place(s, a, b, m, quotes)
        if p.kind == "lower":
            if small is None:
                small = not any(map(str.isupper, s[a:b])) and sum(m2[0][0] in ".!?…" for m2 in _CANDIDATE.finditer(s, a, b)) > 1
            if small:
                p.kind = "upper"
        if p.next >= b:
            continue
        if p.gap == "" and not (p.mark[-1] in "。！？｡．।" or p.kind in ("cjk",) or p.mark[0] == "…" and "⺀" <= p.prev):
            continue  # inside a name, a number or an address
        out.append(p)
    if edges and edges[0]:
        ends, begins = edges
        joints = []
        for m in _UNMARKED_RUN.finditer(s, a, b):
            for k in range(m.start() + EDGE, m.end() - EDGE + 1):
                if s[k - EDGE : k] in ends and s[k : k + EDGE] in begins:
                    joints.append(Junction(s, a, b, k))
        if joints:
            out = sorted(out + joints, key=lambda p: p.end)
    return out


#: Letters on either side of a place between letters that have to be known.
EDGE = 4


def _quoted(p: Place) -> bool:
    return any(c in _CLOSE_MARKS for c in p.closers)


def rule(p: Place, start: int, s: str) -> bool:
    """The label that the rules give a place in a unit that starts at `start`."""
    if p.open > 0:
        return False
    k = p.kind
    if p.mark == " ":
        return True
    if k in ("comma", "dash"):
        return False
    if _quoted(p):
        lead = start
        while lead < p.end and s[lead] in "-*>#•+ \t0123456789.)":
            if s[lead] in "0123456789" and p.opened >= 0 and lead >= p.opened:
                break
            lead += 1
        at_start = p.opened >= 0 and p.opened <= lead
        round_ = ")" in p.closers or "）" in p.closers
        if k == "lower":
            return False
        if round_:
            return at_start or k in ("upper", "name", "open", "digit")
        if k == "cjk":
            return not at_start
        if k in ("uncased", "thai"):
            return False
        return k in ("upper", "name", "open", "digit", "other")
    m = p.mark
    if m[0] in "。！？।॥؟۔｡．":
        return True
    if m[0] == "…" or m.startswith("..."):
        return k not in ("lower",)
    if m[0] in "!?":
        return k != "lower"
    # one full stop
    return k != "lower" and _class(p) not in ("never", "title", "first", "initial", "ordinal")


def _class(p: Place) -> str:
    """What the word before a full stop is known as."""
    w = p.stem.rstrip(".")
    core = p.word.rstrip(".")
    two = f"{p.before.lower().rstrip('.')}.{w}"
    if two in ("z.b", "d.h", "u.a", "p.ex", "p.ej", "т.е", "i.e", "e.g", "o.ä", "s.o", "v.a"):
        return "never"
    if two in ("т.д", "т.п", "p.m", "a.m"):
        return "maybe"
    if w in _NEVER or w.split("-")[-1] in _NEVER:
        return "never"
    if core in _TITLES:
        return "title"
    if w in ("d", "z", "u", "p", "т", "i", "e") and core == w and p.kind in ("lower", "upper"):
        return "first"  # of two, as in z. B.
    if w in _MAYBE and (w != "h" or core == "h"):
        return "maybe"
    if re.fullmatch(r"(?:[^\W\d_]\.)*[^\W\d_]", core) and core[-1].isupper():
        return "word" if p.after in _STARTERS and len(p.after) > 1 else "initial"
    if w.isdigit() and len(w) <= 2 and p.before.lower() in _ORDINAL_BEFORE:
        return "ordinal"
    return "word"


def _letters(p, base: str) -> list[str]:
    """Features of the letters around a place in unmarked script, and of how far the nearest spaces are."""
    l, r = p.left, p.right
    gap_l, gap_r = len(l) - 1 - l.rfind(" "), r.find(" ")
    gap_r = len(r) if gap_r < 0 else gap_r
    far_l, far_r = min(gap_l // 3, 8), min(gap_r // 3, 8)
    far = [base, f"{base}|d={far_l}|{far_r}", f"{base}|m={min(far_l, far_r)}|{min(far_l + far_r, 12)}"]
    if p.masked:
        return far
    return [
        *far, f"{base}|l1={l[-1:]}", f"{base}|l2={l[-2:]}", f"{base}|l3={l[-3:]}", f"{base}|l4={l[-4:]}", f"{base}|l6={l[-6:]}", f"{base}|r1={r[:1]}", f"{base}|r2={r[:2]}", f"{base}|r3={r[:3]}", f"{base}|r4={r[:4]}", f"{base}|r6={r[:6]}",
        f"{base}|b1={l[-1:]}{r[:1]}", f"{base}|b2={l[-2:]}{r[:2]}",
    ]


def _sort(mark: str) -> str:
    return "…" if mark[0] == "…" or mark.startswith("...") else "!" if mark[0] in "!?" else "." if mark[0] == "." else "。"


def _features(p, starts_quoted: bool) -> list[str]:
    if p.mark == "":
        return _letters(p, "j")
    if p.mark == " ":
        return [*_letters(p, "s"), f"o{bool(p.open)}"]
    m = _sort(p.mark)
    q = ("q" if _quoted(p) else "") + ("r" if ")" in p.closers or "）" in p.closers else "") + ("o" if p.open else "") + ("a" if starts_quoted else "")
    base = f"{m}|{q}|{p.kind}"
    out = ["b", base, f"o{bool(p.open)}"]
    if m != ".":
        return out
    w = core = p.word.rstrip(".")
    shape = "d" if w.isdigit() and len(w) <= 2 else "D" if w[-1:].isdigit() else "i" if core and core[-1].isupper() and _INITIALS.fullmatch(core) else "1" if len(w) == 1 else "c" if "." in w else "w" if w.isalpha() else "x"
    low, before, after = w.lower(), p.before.lower(), p.after.lower()
    return [
        *out, f"{base}|{shape}", f"{base}|{shape}|{w[:1].isupper()}", f"w={w}", f"W={low}", f"W={low}|{p.kind}", f"W={low.split('-')[-1]}", f"v={before}|{shape}", f"v={before}|{low}|{p.kind}", f"{shape}|n={after}", f"n={after}",
        f"l{min(len(w), 5)}|{p.kind}", f"l{min(len(w), 5)}|{shape}|{w[:1].isupper()}",
    ]


_INITIALS = re.compile(r"(?:[^\W\d_]\.)*[^\W\d_]")


class Seen:
    """What the features see of a place, kept without its text. Starts of units are counted by places: 0 is the block's, k + 1 that behind place k."""

    __slots__ = ("mark", "closers", "kind", "open", "word", "before", "after", "since", "next", "opened")

    def __init__(self, k: int, mark: str, closers: str, kind: str, open_: int, word: str, before: str, after: str, since: int):
        self.mark, self.closers, self.kind, self.open, self.word, self.before, self.after = mark, closers, kind, open_, word, before, after
        #: The first start from which a quotation that ends here opened the unit, -1 if none.
        self.since = self.opened = since
        self.next = k + 1


def _lead(start: int, end: int, s: str) -> int:
    while start < end and s[start] in "-*>#•+ \t":
        start += 1
    return start


def instance(s: str, a: int, ps: list[Place], gold: list[bool]) -> str:
    """The places of a marked block and their labels as text: equal ones train alike."""
    leads = [_lead(x, len(s), s) for x in (a, *(p.next for p in ps))]
    out = []
    for k, (p, t) in enumerate(zip(ps, gold)):
        since = -1
        if p.opened >= 0 and (j := bisect_left(leads, p.opened, 0, k + 1)) <= k:
            since = j
        m = _sort(p.mark)
        words = (p.word.rstrip("."), p.before.lower(), p.after.lower()) if m == "." else ("", "", "")
        out.append((m, ("”" if _quoted(p) else "") + (")" if ")" in p.closers or "）" in p.closers else ""), p.kind, int(p.open > 0), *words, since, int(t)))
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def _read(v: str) -> tuple[None, int, list[Seen], list[bool]]:
    rows = json.loads(v)
    return None, 0, [Seen(k, *r[:-1]) for k, r in enumerate(rows)], [bool(r[-1]) for r in rows]


def _at_start(p: Place | Seen, start: int, s: str | None) -> bool:
    if s is None:
        return 0 <= p.since <= start
    lead = start
    while lead < p.end and s[lead] in "-*>#•+ \t":
        lead += 1
    return 0 <= p.opened <= lead


class Model:
    """Weights of features for the tag 'boundary', and of tag pairs; decoding."""

    def __init__(self, weights: dict[str, float], edges: tuple[frozenset, frozenset] = (frozenset(), frozenset())):
        self.w, self.edges = weights, edges

    def score(self, p: Place, quoted: bool) -> float:
        get = self.w.get
        total = 0.0
        for f in self.features(p, quoted):
            total += get(f, 0.0)
        return total

    def features(self, p, quoted: bool) -> list[str]:
        return _features(p, quoted)

    def decode(self, ps: list[Place], a: int, s: str) -> list[bool]:
        """Best tags by Viterbi. A state is where the running unit starts; only two matter at a place: it started here or the best earlier one goes on."""
        if not ps:
            return []
        w = self.w
        # tag of the last place -> (score, start of the unit, tags so far)
        best = {False: (0.0, a, None)}
        for p in ps:
            new: dict[bool, tuple] = {}
            scores: dict[bool, float] = {}
            for tag, (sc, start, back) in best.items():
                # where the unit starts matters only behind a quotation
                quoted = p.opened >= 0 and _at_start(p, start, s)
                x = scores.get(quoted)
                if x is None:
                    x = scores[quoted] = self.score(p, quoted)
                for t in (False, True):
                    v = sc + (x if t else 0.0) + w.get(f"T{tag:d}{t:d}", 0.0)
                    if t not in new or v > new[t][0]:
                        new[t] = (v, p.next if t else start, (t, back))
            best = new
        back = max(best.values(), key=lambda z: z[0])[2]
        tags = []
        while back is not None:
            tags.append(back[0])
            back = back[1]
        return tags[::-1]


def unmarked_sentences(texts: list[str]) -> list[str]:
    """Sentences of unmarked scripts: what stands between white space in blocks of such letters."""
    out = []
    for s in texts:
        for a, b, fenced in blocks(s):
            if fenced:
                continue
            for part in re.split(r"\s+", s[a:b]):
                if len(part) >= 2 * EDGE and _UNMARKED_RUN.fullmatch(part):
                    out.append(part)
    return out


#: Lines of training text of unmarked scripts, at least.
LINES = 600


def stripped(sentences_: list[str], seed: int = 0, edges: tuple[frozenset, frozenset] | None = None) -> list[tuple[str, list[bool], list]]:
    """Training text of unmarked scripts: (text, whether each place is a boundary, the places), made of known sentences stripped of what sets them apart.

    A third is joined by spaces, a third by nothing, and a third has spaces put
    inside its sentences besides. Every other line hides the letters, so that the
    distances of spaces are weighed for letters that were never seen: there,
    sentences joined by spaces stand against single ones with spaces inside.
    `edges` are those of more sentences than these, if there are.
    """
    import random

    r = random.Random(seed)
    edges = edges or _edges(sentences_)
    out = []
    for k in range(max(LINES, len(sentences_)) if sentences_ else 0):
        few = [sentences_[k % len(sentences_)]] + [r.choice(sentences_) for _ in range(r.randint(1, 3))]
        how = k % 3
        hide = k % 2 == 1 and how != 1
        if hide and how == 2:
            few = few[:1]
        text, true, spaces = "", set(), set()
        for n, u in enumerate(few):
            if n:
                if how != 1:
                    true.add(len(text))
                    text += " "
                else:
                    true.add(len(text))
            if how == 2:
                # phrases of a sentence, set apart though the sentence goes on
                cuts = sorted(r.sample(range(2, len(u) - 1), min(r.randint(1, 4), max(0, len(u) - 3))))
                u = " ".join(u[x:y] for x, y in zip([0, *cuts], [*cuts, len(u)]))
            text += u
        ps = places(text, 0, len(text), None if hide else edges)
        for p in ps:
            if hide:
                p.masked = True
        out.append((text, [p.end in true for p in ps], ps))
    return out


def _edges(sentences_: list[str]) -> tuple[frozenset, frozenset]:
    """Letters that end and that begin sentences."""
    return frozenset(u[-EDGE:] for u in sentences_), frozenset(u[:EDGE] for u in sentences_)


def _label(s: str, a: int, ps: list) -> list[bool]:
    start, out = a, []
    for p in ps:
        t = rule(p, start, s)
        out.append(t)
        if t:
            start = p.next
    return out


class _Training(Model):
    """A model that remembers the features of its training data's places, which every epoch asks for."""

    def __init__(self, weights: dict[str, float]):
        super().__init__(weights)
        self.known: dict[tuple[int, bool], list[str]] = {}

    def features(self, p, quoted: bool) -> list[str]:
        key = (id(p), quoted)
        got = self.known.get(key)
        if got is None:
            got = self.known[key] = _features(p, quoted)
        return got


def _marked(texts: list[str]) -> Iterator[tuple[str, int, list[Place], list[bool]]]:
    """The blocks of marked text that hold places, with the labels of the rules."""
    for s in texts:
        for a, b, fenced in blocks(s):
            if not fenced and (ps := [p for p in places(s, a, b) if p.mark != " "]):
                yield s, a, ps, _label(s, a, ps)


def _learn(data: list[tuple], start: dict[str, float], epochs: int) -> dict[str, float]:
    """What an averaged structured perceptron adds to the weights that it starts from."""
    w: dict[str, float] = defaultdict(float, start)
    added: dict[str, float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    step = 1
    model = _Training(w)
    for _ in range(epochs):
        wrong = 0
        for s, a, ps, gold in data:
            tags = model.decode(ps, a, s)
            if tags != gold:
                wrong += 1
                for sign, path in ((1.0, gold), (-1.0, tags)):
                    start_, last = a, False
                    for p, t in zip(ps, path):
                        fs = [f"T{last:d}{t:d}"]
                        if t:
                            fs += model.features(p, p.opened >= 0 and _at_start(p, start_, s))
                            start_ = p.next
                        for f in fs:
                            w[f] += sign
                            added[f] += sign
                            total[f] += sign * step
                        last = t
            step += 1
        if not wrong:
            break
    return {f: v - total[f] / step for f, v in added.items() if v or total[f]}


def fit(texts: list[str], epochs: int = EPOCHS) -> Model:
    """An averaged structured perceptron from texts labelled by the rules."""
    known = sorted(set(unmarked_sentences(texts)))
    data = [*_marked(texts), *((s, 0, ps, gold) for s, gold, ps in stripped(known) if ps)]
    return Model(_learn(data, {}, epochs), _edges(known))


def units(s: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text, in code points."""
    out = []
    for a, b, fenced in blocks(s):
        if fenced:
            out.append((a, b))
            continue
        ps = places(s, a, b, model.edges)
        start = a
        for p, t in zip(ps, model.decode(ps, a, s)):
            if t:
                _unit(out, s, start, p.end)
                start = p.next
        _unit(out, s, start, b)
    return out


def _unit(out: list, s: str, a: int, b: int) -> None:
    while a < b and (s[a].isspace() or s[a] == "﻿"):
        a += 1
    while b > a and (s[b - 1].isspace() or s[b - 1] == "﻿"):
        b -= 1
    if a < b:
        out.append((a, b))


#: Built-in training lines, so that a model exists for any corpus.
SEED = [
    "Hi. There it is. No. Yes. OK. Go. So be it. We do. I am. Run it. Es ist so. Oui. Non. Sí. Да.",
    "Mr. Hall met Dr. Ives at 9 a.m. on Jan. 4, 2020. They spoke of costs, etc. and left. He works for Orla Inc. in the U.S. office.",
    "It took 3.5 s, i.e. twice as long. See No. 7, e.g. the third row. “Is it done?” she asked. He said “not yet.” Then it ended!",
    "What now? Nothing. It broke… Try again... and again. (It is rebuilt.) A. Berg wrote it. iPads are fine. main.py is not needed.",
    "Das gilt z. B. für den 2. Lauf am 25. Mai, d. h. ca. 3 Tage. Siehe Abschn. 4. „Ist das so?“, fragte er. Bücher usw. fehlen. Ende.",
    "M. Roux et Mme Lys ont vu la fig. 4, p. ex. hier. « C'est vrai ! » dit-elle. Il est 17 h. Partons. Pourquoi ?",
    "El Sr. Paz y la Dra. Sol ven la pág. 5, p. ej. hoy. «¿Ya?», dijo. ¡Vamos! ¿Quién? Son las 5 p. m. Nada más.",
    "Проф. Ильин пришёл в 5 ч. вечера, т. е. поздно. См. рис. 3. «Готово?» — спросил он. Да! Книги и т. д. лежат. Всё.",
    "重建很慢……“走吗？”她问。雨だ……「はい。」と言った。H. Berg wrote it. Véase la pág. 4. El fin. Cf. la note no. 6. Pourquoi ? Es dauert 5 ms. (Das war es.) Um 17 h. Ende.",
    "今天下雨。“走吗？”他问。他说：“好。”我们走了……结束！「はい。」と言った。雨です。本当ですか？終わり。",
    "यह घर है। “क्या?” उसने पूछा। डॉ. राम आए। ठीक है!",
    "هذا بيت. لماذا؟ قال: «نعم.» ثم ذهب. انتهى!",
    "See item a. Boxes follow. Take plan b. Go on. Option c. It is done. Part k. Then rest. Step x. Begin. Line n. Stop. Keep it at a. Be quick. Row g. We go.",
    "Seen in Washington D.C. It rains there. Made in the U.S. They sell it. A U.S. office. J. R. Hall came. Vitamin C. It helps. See sec. 4 for it. Then go.",
    "Der Plan wird am 4. Mai neu gebaut. Sie kommt am 12. Juni. Im 3. Lauf, am 21. März und zum 1. Mal. Es war Stufe 32. Wir gehen. Nach Schritt 7. Dann weiter. Der Wagen wird erst am 6. Mai fertig.",
    "It fails after step 32. Could it wait? The count is 85. Sensors agree. Take version 2. Next one. Rows 4 to 9. All done. She said “never do it.” Then node.js came.",
    "วันนี้ฝนตก เราไม่ไปตลาด พรุ่งนี้ค่อยไป",
    "เขาอ่านหนังสืออยู่ที่บ้าน แม่ทำอาหารเย็นให้ทุกคน พวกเราดูข่าวแล้วเข้านอน",
    "ระบบหยุดทำงานเมื่อคืนนี้ ทีมงานกำลังตรวจสอบสาเหตุ เราจะแจ้งให้ทราบภายหลัง",
]


class _Rules:
    """The rules in a model's place."""

    edges = (frozenset(), frozenset())

    def decode(self, ps: list[Place], a: int, s: str) -> list[bool]:
        return _label(s, a, ps)


def seed_texts(n: int = 400) -> list[str]:
    """The built-in lines, and `n` paragraphs of their units in new orders, the same on every call."""
    import random

    groups = [[s[a:b] for a, b in units(s, _Rules())] for s in SEED]
    every = [u for g in groups for u in g]
    r = random.Random(0)
    out = list(SEED)
    for k in range(n):
        pool = every if k % 2 else groups[k // 2 % len(groups)]
        few = [r.choice(pool) for _ in range(r.randint(2, 6))]
        text = few[0]
        for u in few[1:]:
            text += ("" if text[-1] in "。！？…”」" and "⺀" <= u.lstrip("“「《")[0] else " ") + u
        out.append(text)
    return out


def _training_data(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = list(b["t"])
        rows = dict.fromkeys((True, instance(*x)) for x in _marked(texts))
        rows |= dict.fromkeys((False, u) for u in unmarked_sentences(texts))
        yield pd.DataFrame(list(rows), columns=["marked", "v"])


def train(documents: DataFrame, text_col: str = "text") -> Model:
    """A model from all documents of the corpus and the built-in lines.

    A weight of the mixture is the mean over the parts that moved it, so what only
    one part has seen is not thinned by the others.
    """
    spark = documents.sparkSession
    texts = spread(documents.select(F.col(text_col).alias("t")).where("t is not null"))
    data = Scratch(spark, "training").cut(texts.mapInPandas(_training_data, "marked boolean, v string").distinct())
    lines = seed_texts()
    own = unmarked_sentences(lines)
    ends, begins = (set(x) for x in _edges(own))
    unmarked = data.where("not marked")
    ends |= {r[0] for r in unmarked.select(F.substring("v", -EDGE, EDGE)).distinct().collect()}
    begins |= {r[0] for r in unmarked.select(F.substring("v", 1, EDGE)).distinct().collect()}
    edges = frozenset(ends), frozenset(begins)
    parts = max(1, -(-(data.agg(F.sum(F.length("v"))).first()[0] or 0) // PART))
    # an empty corpus still has the built-in lines
    seeds = spark.range(parts).select(F.col("id").alias("part"), F.lit(None).cast("boolean").alias("marked"), F.lit("").alias("v"))
    dealt = data.select(F.pmod(F.xxhash64("v"), F.lit(parts)).alias("part"), "marked", "v").unionByName(seeds).repartition(parts, "part")
    rounds = ROUNDS if parts > 1 else 1
    weights: dict[str, float] = {}
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((weights, edges, EPOCHS // rounds))

        def learn(part: pd.DataFrame) -> pd.DataFrame:
            start, all_edges, epochs = sent.value
            built_in = seed_texts()
            mine = sorted(part["v"][part["marked"] == True])  # noqa: E712
            known = sorted({*unmarked_sentences(built_in), *part["v"][part["marked"] == False]})  # noqa: E712
            fitted = [*_marked(built_in), *map(_read, mine), *((s, 0, ps, gold) for s, gold, ps in stripped(known, edges=all_edges) if ps)]
            return pd.DataFrame([(f, round(v * FINE)) for f, v in _learn(fitted, start, epochs).items()], columns=["f", "d"])

        moved = dealt.groupBy("part").applyInPandas(learn, "f string, d long").groupBy("f").agg(F.sum("d").alias("d"), F.count("*").alias("n")).collect()
        weights = dict(weights)
        for r in moved:
            weights[r["f"]] = weights.get(r["f"], 0.0) + r["d"] / r["n"] / FINE
    return Model(weights, edges)


def sentences(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, start_char, end_char) of each sentence unit of each document."""
    model = model or train(documents, text_col)
    weights = documents.sparkSession.sparkContext.broadcast((model.w, model.edges))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*weights.value)
        for b in batches:
            rows = [(i, x, y) for i, s in zip(b["i"], b["s"]) for x, y in units(s, m)]
            yield pd.DataFrame(rows, columns=["doc_id", "start_char", "end_char"])

    docs = one_text_each(documents, id_col, text_col, Scratch(documents.sparkSession, "sentences")).where("s is not null and s <> ''")
    cuts = docs.withColumn("i", whole_id("i")).mapInPandas(cut, "doc_id long, start_char long, end_char long")
    return cuts.withColumn("doc_id", own_id("doc_id"))
