"""Personal data in texts, also behind disguises, with offsets into the source.

Plain detectors run on the text as it is. Then a transducer rewrites disguises
(homoglyphs, spelled digits, "at" and "dot" for their signs) and notes for every
piece of its output which piece of the source it came from. The same detectors
run on that output, and what they find is mapped back to source characters.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patchlake.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*+")
# A run of digits is taken whole by any leftmost match, so possessive runs give the same matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches around each @: the whole run of local characters before it, the domain behind it."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at - _LOCAL_BACK.match(text[done:at][::-1]).end()
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, done))
        else:
            # The @ itself is no local character, so a later address begins behind it.
            done = at + 1
        at = text.find("@", done)
    return found


def _ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]


def _cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append(m.span())
    return found


def _phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


_DETECT = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def plain_spans(text: str) -> dict[str, list[Span]]:
    """Spans by kind, leftmost and not overlapping within a kind; failing matches are dropped without a retry."""
    return {kind: detect(text) for kind, detect in _DETECT.items()}


# Look-alikes beyond what compatibility forms give: Cyrillic and Greek letters for Latin ones, dashes and dots.
_ALIKE = dict(
    zip("асеорхуікѕјһԁԛԝАВСЕНІЈКМОРЅТХУΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορν", "aceopxyiksjhdqwABCEHIJKMOPSTXYABEZHIKMNOPTYXaopv")
) | dict(zip("‐‑‒–—―−•∙·․。", "-------....."))
_DIGIT_WORDS = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789")),
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789")),
    **dict(zip("zéro un deux trois quatre cinq sept huit neuf".split(), "012345789")),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789")),
    "six": "6", "oh": "0", "fuenf": "5", "zwo": "2",
}
_WORD = "(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + ")"
_GAP = r"[\s,.-]{1,3}"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
# Words for the two signs: in brackets, and bare between blanks, _ * or -.
_AT_WORDS, _DOT_WORDS, _BARE_DOTS = ("at", "arobase", "arroba"), ("dot", "point", "punkt", "punto"), ("dot", "punkt", "punto")
_AT_SIGN, _DOT_SIGN = rf"(?:{'|'.join(_AT_WORDS)}|@)", rf"(?:{'|'.join(_DOT_WORDS)}|\.)"
_AT = rf"\s*{_OPEN}\s*{_AT_SIGN}\s*{_CLOSE}\s*"
_DOT = rf"\s*{_OPEN}\s*{_DOT_SIGN}\s*{_CLOSE}\s*|\s*[\s_*-](?:{'|'.join(_BARE_DOTS)})[\s_*-]\s*"
# A bare "at" stands for the sign if a domain follows with a disguised dot in it, plain dots before that or not.
_BARE_AT = (
    rf"(?<=[A-Za-z0-9_%+-])\s*[\s_*-](?:{'|'.join(_AT_WORDS)})[\s_*-]\s*"
    rf"(?=(?:[A-Za-z0-9-]++\.)*+[A-Za-z0-9-]+?(?:{_DOT})[A-Za-z0-9-]+)"
)
# If all dots are plain, the domain has to be on the same line and end in two or more letters of one case, and "at"
# must not stand behind a word of _BEFORE_PLACE.
_PLAIN_AT = (
    rf"(?<=[A-Za-z0-9_%+-])[ \t]*[ \t_*-](?:{'|'.join(_AT_WORDS)})[ \t_*-][ \t]*"
    r"(?=(?:[A-Za-z0-9-]++\.)+(?-i:[a-z]{2,}|[A-Z]{2,})(?![\w-]))"
)
_BEFORE_PLACE = frozenset(
    """a all also am and anyone are arrive arrived article articles at available back based be been blog book booked bought but
    buy call chat check code come day described details directly discussed docs document documentation documented
    download downloaded downloads each else everyone everything example file files find first for found free from get go
    good guide had has have he her here him hosted how i instructions is it its join just last later learn learned link
    links listed live lived lives located look looked looking looks made maintained me meet meeting met more new news
    next not now on one online only open or ordered our out page pages people posted posts present presented public
    published purchase purchased reach reached read register registered release released report reported resources run
    running runs see seen sell sells shop shopping shown sign site sites sold someone source start started stay stayed
    stop stopped store stored stuff submit that the their them then there these they thing things this those time today
    tomorrow tool up updated us use used using version video videos visit visited watch was we website websites were
    what when where which while who with work worked working works you your""".split()
)
_DISGUISE = re.compile(
    rf"(?P<at>{_AT}|{_BARE_AT})|(?P<plain_at>{_PLAIN_AT})|(?P<dot>(?<=[A-Za-z0-9])(?:{_DOT})(?=[A-Za-z0-9]))"
    rf"|(?P<digits>(?:\bplus\s+)?\b(?:{_WORD}|[0-9]++)\b(?:{_GAP}(?:{_WORD}|[0-9]++)\b)*+)",
    re.IGNORECASE,
)
_BRACKETED = re.compile(rf"{_OPEN}\s*(?:{_AT_SIGN}|{_DOT_SIGN})\s*{_CLOSE}", re.IGNORECASE)
# Digits of the shortest identifier made of them, an IP address.
_LEAST_DIGITS = 4
_DIGIT = re.compile(r"[0-9]")
# For the search of hints: letters in lower case, all else as spaces.
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else 32 for b in range(256))
_NO_LETTERS = re.compile(r"[\W\d_]+")


def _lower(text: str) -> str:
    """Lower case, also of the two letters that patterns without case take for an i."""
    low = text.lower()
    return low if low.isascii() else low.replace("i̇", "i").replace("ı", "i")


@lru_cache(maxsize=1)
def _hint_words():
    """Finds words of the signs (0) and digit words (1) between spaces in folded text."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in (*_AT_WORDS, *_BARE_DOTS):
        found.add_word(f" {word} ", 0)
    for word in _DIGIT_WORDS:
        found.add_word(f" {word} ", 1)
    found.make_automaton()
    return found


def _hinted(text: str) -> bool:
    """Whether a disguise can be in the text: a bracketed sign, a bare word for one, or digit words with enough digits for an address."""
    if _BRACKETED.search(text):
        return True
    folded = text.encode().translate(_FOLD).decode() if text.isascii() else _NO_LETTERS.sub(" ", _lower(text))
    words = 0
    for _, kind in _hint_words().iter(f" {folded} "):
        words += kind
        if not kind:
            return True
    return words > 0 and (words >= _LEAST_DIGITS or words + len(_DIGIT.findall(text)) >= _LEAST_DIGITS)


_DIGIT_PART = re.compile(rf"(?P<plus>plus)|(?P<word>{_WORD})|(?P<number>[0-9]+)", re.IGNORECASE)
_HIDDEN = {"­", "​", "‌", "‍", "⁠", "﻿"}


def _alike(c: str) -> str:
    """The plain form of one character, or itself; invisible characters vanish."""
    if c in _HIDDEN:
        return ""
    plain = _ALIKE.get(c)
    if plain is None:
        plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() and not plain.isspace() else c


_ODD = re.compile(r"[^\x00-\x7F]")


class Normalised:
    """Output of the transducer with, for every piece, its start here and its span in the source."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.at: list[int] = []
        self.source: list[tuple[int, int, bool]] = []
        self.length = 0
        # Whether a plain dot stands between spelled digits, so that there is a second reading.
        self.dotted = False

    def add(self, piece: str, start: int, end: int, same: bool) -> None:
        """``same``: the piece has the characters of the source one by one."""
        if piece:
            self.at.append(self.length)
            self.source.append((start, end, same))
            self.parts.append(piece)
            self.length += len(piece)

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def back(self, start: int, end: int) -> Span:
        """The source span of an output span."""
        first, last = bisect.bisect_right(self.at, start) - 1, bisect.bisect_right(self.at, end - 1) - 1
        a, _, same = self.source[first]
        if same:
            a += start - self.at[first]
        c, d, same = self.source[last]
        return a, c + end - self.at[last] if same else d


def normalise(text: str, dots: bool = False) -> Normalised | None:
    """The text without disguises, or None if it has none; ``dots``: a plain dot between spelled digits stays one."""
    plain, changed = text, False
    if not text.isascii():
        hidden = any(h in text for h in _HIDDEN)
        if not hidden:
            table = {ord(c): p for c in set(_ODD.findall(text)) if (p := _alike(c)) != c}
            if table:
                plain, changed = text.translate(table), True
        else:
            return _with_hidden(text, dots)
    if not _hinted(plain):
        if not changed:
            return None
        out = Normalised()
        out.add(plain, 0, len(plain), True)
        return out
    out = Normalised()
    _rewrite(plain, out, lambda i: i, dots)
    return out if changed or len(out.parts) > 1 or out.parts[:1] != [text] else None


def _with_hidden(text: str, dots: bool) -> Normalised:
    """As above for texts with invisible characters, whose places have to be counted."""
    kept, places = [], []
    for i, c in enumerate(text):
        p = c if c.isascii() else _alike(c)
        if p:
            kept.append(p)
            places.append(i)
    places.append(len(text))
    out = Normalised()
    _rewrite("".join(kept), out, places.__getitem__, dots, straight=False)
    return out


def _rewrite(plain: str, out: Normalised, place, dots: bool, straight: bool = True) -> None:
    """Run the transducer over ``plain``; ``place`` gives the source offset of each of its characters.

    Every run of digits with a digit word in it is rewritten: words next to each
    other are joined, a space parts them from plain digits behind; what stands
    before the first word stays. With ``dots`` a plain dot between two of them
    stays a dot.
    """

    def copy(start: int, end: int) -> None:
        if straight:
            out.add(plain[start:end], place(start), place(end), True)
            return
        run = start
        for i in range(start + 1, end + 1):
            if i == end or place(i) != place(i - 1) + 1:
                out.add(plain[run:i], place(run), place(i - 1) + 1, True)
                run = i

    done = 0
    for m in _DISGUISE.finditer(plain):
        copy(done, m.start())
        if m["plain_at"] is not None and _lower(_LOCAL_BACK.match(plain[max(0, m.start() - 64) : m.start()][::-1])[0][::-1]) in _BEFORE_PLACE:
            copy(m.start(), m.end())
        elif m["digits"] is None:
            out.add("." if m["dot"] is not None else "@", place(m.start()), place(m.end() - 1) + 1, False)
        else:
            words = list(_DIGIT_PART.finditer(plain, m.start(), m.end()))
            if not any(w["word"] for w in words):
                copy(m.start(), m.end())
            else:
                before, spelled = None, False
                for w in words:
                    if before is not None and not before["plus"]:
                        gap = plain[before.end() : w.start()]
                        dot = gap.strip() == "." and (gap == "." or gap[0].isspace())
                        if not spelled:
                            copy(before.end(), w.start())
                        else:
                            out.dotted |= dot
                            piece = "." if dots and dot else "" if before["word"] and w["word"] else " "
                            out.add(piece, place(before.end()), place(w.start() - 1) + 1, False)
                    spelled = spelled or w["word"] is not None
                    if w["number"]:
                        copy(w.start(), w.end())
                    else:
                        sign = "+" if w["plus"] else _DIGIT_WORDS[_lower(w[0])]
                        out.add(sign, place(w.start()), place(w.end() - 1) + 1, False)
                    before = w
        done = m.end()
    copy(done, len(plain))


def _inside(span: Span, spans: list[Span]) -> bool:
    """Whether one of the sorted spans, which do not overlap, equals or holds ``span``."""
    i = bisect.bisect_right(spans, (span[0], float("inf"))) - 1
    return i >= 0 and span[1] <= spans[i][1]


def find(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(plain spans, added spans) by kind. An added one reaches beyond every plain span of its kind that it meets."""
    if not text:
        return {k: [] for k in KINDS}, {k: [] for k in KINDS}
    base = plain_spans(text)
    added: dict[str, list[Span]] = {k: [] for k in KINDS}
    hidden = normalise(text)
    readings = [] if hidden is None else [hidden, normalise(text, dots=True)] if hidden.dotted else [hidden]
    for reading in readings:
        for kind, spans in plain_spans(reading.text).items():
            found = (reading.back(*span) for span in spans)
            added[kind] += [span for span in found if not _inside(span, base[kind]) and not _inside(span, added[kind])]
    return base, added


def joined(spans: dict[str, list[Span]]) -> str:
    """kind:start:end by start, then kind in the order of KINDS, joined by commas."""
    rows = sorted((s, k, e) for k, kind in enumerate(KINDS) for s, e in spans[kind])
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in rows)


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("n_added", pa.int64()), ("base", pa.string()),
     ("base_sha256", pa.string()), ("spans", pa.string())]
)
_DDL = "doc_id bigint, " + "".join(f"n_{k} bigint, " for k in KINDS) + "n_added bigint, base string, base_sha256 string, spans string"


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest and spans of personal data for every row, repeated ones too.

    n_email, n_ip, n_card and n_phone count plain spans, n_added those found
    behind disguises; ``base`` has the plain spans, ``spans`` both, as
    kind:start:end in code points. Null and empty texts have none. One narrow
    pass over whole texts, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for value in batch.column(1).to_pylist():
                base, added = find(value)
                plain = joined(base)
                rows.append(
                    (
                        *(len(base[k]) for k in KINDS),
                        sum(map(len, added.values())),
                        plain,
                        hashlib.sha256(plain.encode()).hexdigest(),
                        joined({k: base[k] + added[k] for k in KINDS}),
                    )
                )
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(_SCHEMA)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema=_SCHEMA)

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, _DDL)
