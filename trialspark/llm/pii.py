"""Personal data, also where it is disguised, at its place in the source.

Plain identifiers are found in the source text by four patterns. Then a chain of
transducers rewrites the text: homoglyphs and full-width forms to ASCII,
spelled-out digits to digits, "[at]"/"(dot)" and the like to "@" and ".". Every
output character keeps the source span it came from, so what the patterns find in
the normalised text maps back to source characters. A found span is added when it
holds a rewritten character and meets no span of its kind from the source, or takes
in whole what it meets ("+1 202 555 014 seven" ends a word after the plain number).

Offsets are code points, ends exclusive. A null text is empty; an empty one has no
spans. Rows are handled one by one, so that ties, repeats and null ids don't matter; a
very long text costs some 20 bytes a character. Kept columns named as a result give
way to it. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from .common import map_texts, quoted

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = r"A-Za-z0-9._%+-"
_EMAIL_TAIL = re.compile(rf"[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL = re.compile(rf"(?<![{_LOCAL}])" + _EMAIL_TAIL.pattern)
_IP_TAIL = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_IP = re.compile(r"(?<![0-9])" + _IP_TAIL.pattern)
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _runs(text: str, at_start: re.Pattern, anywhere: re.Pattern) -> Iterator[re.Match]:
    """Leftmost matches that don't overlap, each tried from the start of a run of
    its first class only: a later start in the run meets the same failure."""
    pos = 0
    while True:
        found = (at_start.match(text, pos) if pos else None) or anywhere.search(text, pos)
        if not found:
            return
        yield found
        pos = found.end()


def find(text: str) -> dict[str, list[Span]]:
    """Spans by kind of the plain identifiers of a text."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = [m.span() for m in _runs(text, _EMAIL_TAIL, _EMAIL)]
    if "." in text:
        out["ip"] = [m.span() for m in _runs(text, _IP_TAIL, _IP) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out["phone"].append(m.span())
    return out


# Letters of other scripts that look like these ASCII letters.
_LOOKALIKE = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅαορνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTYXIJSaopvABEZHIKMNOPTYX", strict=True))
# Digits and signs as words, in English, German, French and Spanish.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "une": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_SIGN_WORDS = {"at": "@", "ät": "@", "arroba": "@", "arobase": "@", "klammeraffe": "@", "dot": ".", "punkt": ".", "point": ".", "punto": "."}
_AT_WORD, _DOT_WORD = "at|ät|arroba|arobase|klammeraffe", "dot|punkt|punto|point"
_BRACKETED = re.compile(
    r"[\x20]*[\[({<][\x20]*(at|ät|arroba|arobase|dot|punkt|point|punto|@|\.)[\x20]*[\])}>][\x20]*|(?<=[A-Za-z0-9])[_*~-]{1,3}(at|dot)[_*~-]{1,3}(?=[A-Za-z0-9])|&(?:#64|\#x40|commat);()|&(?:\#46|\#x2e|period);()", re.I
)
# " @ " and " . " with spaces on both sides
_LOOSE_SIGNS = re.compile(r"(?<=[A-Za-z0-9_%+-])(\x20*@\x20*)((?:[A-Za-z0-9-]+(?:\.|\x20+\.\x20+))+[A-Za-z]{2,})(?![A-Za-z0-9-])")
_LOOSE_DOT = re.compile(r"\x20+\.\x20+")
_SPOKEN = "|".join(sorted(_DIGIT_WORDS, key=lambda w: -len(w)))
# runs of spelled digits and numbers, one spelled digit at least, or a spelled plus
_DIGIT_WORD = re.compile(
    rf"(?<![^\W_])(?:(?:plus|más)[\s-]+(?=(?:(?:{_SPOKEN}|[0-9])[0-9\s,-]*+){{4}}))?(?:[0-9]+[\s,-]+)*+(?:{_SPOKEN})(?:[\s,-]+(?:{_SPOKEN}|[0-9]+))*+(?![^\W_])", re.I
)
_PLUS_DIGITS = re.compile(r"(?<![^\W_])(?:plus|más)[\s-]+(?=[0-9](?:[\x20().-]*+[0-9]){8,14}(?![0-9]))", re.I)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+")
# four numbers of an address, of digits or of one to three spelled ones
_SPOKEN_PART = rf"(?:[0-9]{{1,3}}|(?:{_SPOKEN})(?:[\s-]+(?:{_SPOKEN})){{0,2}})"
_SPOKEN_IP = re.compile(rf"(?<![^\W_])(?<![0-9.]){_SPOKEN_PART}(?:(?:\x20+(?:{_DOT_WORD})\x20+|\x20*\.\x20*){_SPOKEN_PART}){{3}}(?![^\W_])", re.I)
_IP_DOT = re.compile(rf"\x20+(?:{_DOT_WORD})\x20+|\x20*\.\x20*", re.I)
# "x at y dot z" in words is an address only with a country's or a common ending.
_COUNTRIES = (
    "ac ad ae af ag ai al am ao ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz "
    "de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it "
    "je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz "
    "om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz "
    "ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"
).split()
_GENERIC = (
    "com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post dev app xyz online site website shop store blog cloud tech email "
    "live news world life today agency club design space top wiki media digital network systems solutions services company group academy global studio team tools page art fun"
).split()
_END = "(?:" + "|".join(sorted(_COUNTRIES + _GENERIC, key=lambda e: -len(e))) + ")"
#: Endings that are words as well, and words that are no domain before them.
_WORDLIKE = frozenset("ad am as at be by co de do es et fun group id il in is it la life live ma me mu my name news no page post re so space team tech to today tools top us world art".split())
_NO_DOMAIN = frozenset("the a an this that these those each every any one some another no which what my your our his her its their first second third last next same".split())
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9_%+-]+(?:(?:\.|\x20+dot\x20+)[A-Za-z0-9_%+-]+)*)(\x20+at\x20+)([A-Za-z0-9-]{2,}(?:(?:\.|\x20+dot\x20+)[A-Za-z0-9-]{2,})*\x20+dot\x20+(?:" + _END + r"))(?![A-Za-z0-9-])", re.I)
_SPACED_DOT = re.compile(rf"\x20+(?:{_DOT_WORD})\x20+", re.I)
#: The same with the signs' words of other languages, or with any ending where the
#: address ends a line, a clause or the text. "at" and "point" are too common together.
_FOREIGN = re.compile(
    rf"(?<![{_LOCAL}])([A-Za-z0-9_%+-]+(?:(?:\.|\x20+(?:dot|punkt|punto|point)\x20+)[A-Za-z0-9_%+-]+)*)(\x20+(?:arroba|arobase|klammeraffe|ät)\x20+|\x20+at\x20+(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\x20+(?:punkt|punto)\x20))"
    rf"([A-Za-z0-9-]{{2,}}(?:(?:\.|\x20+(?:{_DOT_WORD})\x20+)[A-Za-z0-9-]{{2,}})*\x20+(?:{_DOT_WORD})\x20+(?:{_END}))(?![A-Za-z0-9-])", re.I,
)
_OPEN_END = re.compile(
    r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9_%+-]+(?:(?:\.|\x20+dot\x20+)[A-Za-z0-9_%+-]+)*)(\x20+at\x20+)([A-Za-z0-9-]{2,}(?:(?:\.|\x20+dot\x20+)[A-Za-z0-9-]{2,})*\x20+dot\x20+[A-Za-z]{2,12})(?=\x20*(?:[.,;:!?)\n]|\Z))", re.I
)
# mixed forms: " dot " about a given "@", " at " before a domain whose dot was disguised, " dot " between numbers
_AT_DOMAIN = re.compile(r"@((?:[A-Za-z0-9-]+(?:\.|\x20+dot\x20+))+" + _END + r")(?![A-Za-z0-9-])", re.I)
_LABELS = re.compile(rf"\.|\x20+(?:{_DOT_WORD})\x20+", re.I)
_LOCAL_DOTS = re.compile(rf"(?<![{_LOCAL}])(?:[{_LOCAL}]+\x20+dot\x20+)+[{_LOCAL}]+\Z", re.I)
_AT_DOTTED = re.compile(rf"(?<=[{_LOCAL}])(\x20+at\x20+)((?:[A-Za-z0-9-]{{2,}}(?:\.|\x20+dot\x20+))*[A-Za-z0-9-]{{2,}}\.{_END})(?![A-Za-z0-9-])", re.I)
_NUMBER_DOT = re.compile(r"(?<=[0-9])\x20+dot\x20+(?=[0-9])", re.I)
#: A text without any of these has nothing to rewrite.
_HINT = re.compile(
    r"[\[({<][\x20]*(?:at|ät|arroba|arobase|dot|punkt|point|punto|@|\.)[\x20]*[\])}>]|[\x20_*~-](?:dot|punkt|punto)[\x20_*~-]|\x20(?:arroba|arobase|klammeraffe|ät)\x20|(?<![^\W_])(?:plus|más)\x20+[0-9]|\x20@|@\x20|\x20\.\x20|&(?:\#|commat|period)", re.I
)
#: Nor one without two spelled digits, or one beside a number or a dot's word. It is for
#: lower-cased text, since a choice of words is slow to match in either case.
_SPOKEN_HINT = re.compile(rf"(?<![^\W_])(?=[a-zäéf])(?:(?:{_SPOKEN})[\s,-]+(?:{_SPOKEN}|[0-9])|point\x20+(?:{_SPOKEN})(?![^\W_]))|[0-9][\s,-]+(?:{_SPOKEN})(?![^\W_])")

# beyond Latin letters and general punctuation, or invisible
_LATIN = re.compile("[^\\x00-\\u024f\\u2000-\\u206f]|[\\u00ad\\u200b-\\u200d\\u2060]")


class Traced:
    """A rewritten text whose characters know their source span."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text), dtype=np.int32)
        self.end = self.start + 1
        self.new = np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans (start, end, by), ascending and apart."""
        text, at = [], 0
        begins, ends, sizes = (np.array(x, np.int64) for x in zip(*((a, b, len(by)) for a, b, by in edits), strict=True))
        for start, end, by in edits:
            text += [self.text[at:start], by]
            at = end
        self.text = "".join([*text, self.text[at:]])
        # each new character stands on the edit's first source character
        take = np.ones(len(self.start), np.int64)
        cover = np.zeros(len(take) + 1, np.int64)
        np.add.at(cover, begins, 1)
        np.add.at(cover, ends, -1)
        take[np.cumsum(cover[:-1]) > 0] = 0
        take[begins] = sizes
        first, last = self.start[begins], self.end[ends - 1]
        self.end[begins], self.new[begins], self.start[begins] = last, True, first
        self.start, self.end, self.new = (np.repeat(x, take) for x in (self.start, self.end, self.new))


def _plain_char(c: str) -> str | None:
    if c in _LOOKALIKE:
        return _LOOKALIKE[c]
    if c in "\u00ad\u200b\u200c\u200d\u2060":
        return ""
    if ord(c) > 0x24F:
        if c.isdecimal():
            return str(unicodedata.decimal(c))
        folded = unicodedata.normalize("NFKC", c)
        if len(folded) == 1 and folded != c and folded.isascii() and not folded.isspace():
            return folded
    return None


def _sign(found: re.Match) -> str:
    word = found.group(1) or found.group(2)
    if word:
        return _SIGN_WORDS.get(word.lower(), word)
    return "@" if found.group(3) is not None else "."


def _as_digits(text: str) -> str:
    return "".join("+" if t.lower() in ("plus", "más") else _DIGIT_WORDS.get(t.lower(), t) for t in _TOKEN.findall(text))


def _digits_of(found: re.Match) -> str:
    return _as_digits(found.group())


def _dots(found: re.Match, group: int) -> list[tuple[int, int, str]]:
    return [(g.start() + found.start(group), g.end() + found.start(group), ".") for g in _SPACED_DOT.finditer(found.group(group))]


def normalise(text: str) -> Traced | None:
    """The rewritten text, or None where nothing needs rewriting."""
    odd = [(m.start(), m.end(), by) for m in _LATIN.finditer(text) if (by := _plain_char(m.group())) is not None]
    if not odd and not _HINT.search(text) and not _SPOKEN_HINT.search(text.lower()):
        return None
    out = Traced(text)
    if odd:
        out.rewrite(odd)
    if signs := [(m.start(), m.end(), _sign(m)) for m in _BRACKETED.finditer(out.text)]:
        out.rewrite(signs)
    loose = [e for m in _LOOSE_SIGNS.finditer(out.text) if "\x20" in m.group() for e in [(*m.span(1), "@"), *((d.start() + m.start(2), d.end() + m.start(2), ".") for d in _LOOSE_DOT.finditer(m.group(2)))]]
    if loose:
        out.rewrite(loose)
    for pattern in (_SPELLED, _FOREIGN, _OPEN_END):
        spelled = []
        for m in pattern.finditer(out.text):
            labels = _LABELS.split(m.group(3).lower())
            if labels[-2] in _NO_DOMAIN and (labels[-1] in _WORDLIKE or pattern is _OPEN_END):
                continue
            spelled += sorted([(*m.span(2), "@"), *_dots(m, 1), *_dots(m, 3)])
        if spelled:
            out.rewrite(spelled)
    if dotted := [e for m in _AT_DOTTED.finditer(out.text) if any(out.new[i] for i in range(*m.span(2)) if out.text[i] == ".") for e in [(*m.span(1), "@"), *_dots(m, 2)]]:
        out.rewrite(dotted)
    mixed: set[tuple[int, int, str]] = set()
    for m in _AT_DOMAIN.finditer(out.text):
        own = _dots(m, 1)
        mixed.update(own)
        if (own or out.new[m.start() : m.end()].any()) and (local := _LOCAL_DOTS.search(out.text, max(0, m.start() - 512), m.start())):
            mixed.update(_dots(local, 0))
    mixed.update((*m.span(), ".") for m in _NUMBER_DOT.finditer(out.text))
    if mixed:
        out.rewrite(sorted(mixed))
    parts = []
    for m in _SPOKEN_IP.finditer(out.text):
        at = m.start()
        for piece in [*_IP_DOT.finditer(m.group()), None]:
            end = m.start() + piece.start() if piece else m.end()
            if not out.text[at:end].isdigit():
                parts.append((at, end, _as_digits(out.text[at:end])))
            if piece:
                at = m.start() + piece.end()
                if piece.group() != ".":
                    parts.append((end, at, "."))
    if parts:
        out.rewrite(parts)
    if numbers := [(m.start(), m.end(), _digits_of(m)) for m in _DIGIT_WORD.finditer(out.text) if len(_TOKEN.findall(m.group())) > 3]:
        out.rewrite(numbers)
    if signs := [(m.start(), m.end(), "+") for m in _PLUS_DIGITS.finditer(out.text)]:
        out.rewrite(signs)
    return out


def find_disguised(text: str, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans in the source of identifiers that only the normalised text shows."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    traced = normalise(text)
    if traced is None or not traced.new.any():
        return out
    for kind, spans in find(traced.text).items():
        known = plain[kind]
        begins, ends = [x for x, _ in known], [y for _, y in known]
        for start, end in spans:
            if traced.new[start:end].any():
                a, b = int(traced.start[start]), int(traced.end[end - 1])
                # plain spans are apart and ascend; one that is met must be a part of the found one
                low, high = bisect_right(ends, a), bisect_left(begins, b)
                if all(a <= x and y <= b and (a, b) != (x, y) for x, y in known[low:high]):
                    out[kind].append((a, b))
    return out


def spans_text(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def detect(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), counts of plain identifiers by kind, the
    hash of their spans, and spans: all of them as text."""

    def make():
        def work(texts: pa.Array):
            counts: list[list[int]] = [[] for _ in KINDS]
            hashes, all_spans = [], []
            for value in texts:
                text = value.as_py() or ""
                plain = find(text)
                extra = find_disguised(text, plain)
                for i, k in enumerate(KINDS):
                    counts[i].append(len(plain[k]))
                own = spans_text(plain)
                hashes.append(hashlib.sha256(own.encode()).hexdigest())
                all_spans.append(spans_text({k: plain[k] + extra[k] for k in KINDS}) if any(extra.values()) else own)
            return [pa.array(c, pa.int64()) for c in counts] + [pa.array(hashes, pa.string()), pa.array(all_spans, pa.string())]

        return work

    fields = [StructField(f"n_{k}", LongType()) for k in KINDS] + [StructField("base_sha256", StringType()), StructField("spans", StringType())]
    return map_texts(docs, docs.columns if keep is None else keep, make, fields)


def mask_text(text: str) -> str:
    """Every identifier, plain or disguised, replaced by its kind in angle brackets."""
    plain = find(text)
    extra = find_disguised(text, plain)
    found = sorted((a, -b, k) for k in KINDS for a, b in plain[k] + extra[k])
    out, at = [], 0
    for a, b, k in found:
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with identifiers masked in text; a null text stays null."""

    def make():
        return lambda texts: [pa.array([None if (t := v.as_py()) is None else mask_text(t) for v in texts], pa.string())]

    out = map_texts(docs, docs.columns, make, [StructField("text", StringType())])
    return out.select(*quoted(docs.columns))
