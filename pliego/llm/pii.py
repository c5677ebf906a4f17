"""Operator 7: personal data by boosted candidates.

Base rules find e-mail addresses, IPv4 addresses, card numbers and phone numbers; their
spans always stay. High-recall generators propose further, overlapping spans: spelled-out
addresses, numbers without a plus sign, access keys, assigned secrets, account and identity
numbers. Boosted trees score each candidate from its format and its context, and thresholds
calibrated to a precision select among them; of overlapping ones the most probable stays.

The trees are fit on planted examples (``planted``), whose labels are known because they
were made as personal data or as look-alikes; one set of surroundings trains the trees,
another calibrates the thresholds, a third is kept for tests. No rule labels a candidate, and
nothing is fit on the documents. All documents are searched in full.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded
from .boosting import Boosted, boost

#: Span kinds in the order that breaks ties of position; the base kinds come first.
KINDS = ("email", "ip", "card", "phone", "secret", "account", "identity")
BASE = KINDS[:4]
#: The share of right spans among those selected that a kind's threshold is calibrated to.
PRECISION = 0.95
#: Planted examples of each shape in each of the two sets of surroundings.
PLANTED = 60

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A digit run is taken whole or not at all, which changes no match and keeps the search linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost non-overlapping addresses, found from their @ outwards."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    out = [(a, 0, b) for a, b in emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_GENERATORS = [
    (0, re.compile(r"\b[\w.+-]{1,64}(?:\s?[(\[]\s?at\s?[)\]]\s?|\sat\s|\s?@\s?)[\w-]{1,64}(?:\s?[(\[]\s?dot\s?[)\]]\s?|\sdot\s|\s?\.\s?)[a-z]{2,10}\b", re.I | re.A)),
    (3, re.compile(r"(?<![\w+])\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?!\w)")),
    (4, re.compile(r"\b[A-Z0-9]{16,40}\b")),
    (4, re.compile(r"(?<=[=:])\s?[\"']?([^\s\"'=:]{7,199}[^\s\"'=:.,;!?)\]])")),
    (4, re.compile(r"\b[0-9a-f]{16,128}\b")),
    (5, re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    (6, re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    (6, re.compile(r"\b[XYZ]?[0-9]{7,8}-?[A-Z]\b")),
]
#: Words that announce what follows, by group; any one of a group counts for all.
_HINTS = {
    "secret": re.compile("passw|contraseñ|clave|secret|token|(?<![a-z])key|_key|apikey"), "phone": re.compile("tel|phone|call|mobile|móvil|llam|appel|ruf|ring|number is|fax"),
    "mail": re.compile("mail|correo|contact|write|reach|schreib|send"), "account": re.compile("iban|account|cuenta|konto|pay|bank"), "identity": re.compile(r"ssn|social|(?<![a-z])(?:dni|nie|nif|tax)(?![a-z])"),
    "digest": re.compile("checksum|sha|md5|hash|commit|digest|revision|etag|blob"), "number": re.compile(r"version|release|build|page|(?<![a-z])pp?\.|order|invoice|batch|isbn|ref|serial|part"),
    "date": re.compile(r"date|since|until|(?<![a-z])(?:on|el|am|le)\s*$"), "size": re.compile("size|count|total|note|see|title"),
}


def candidates(text: str) -> list[Span]:
    """Overlapping spans worth a look, by the generators."""
    out = set()
    for kind, pattern in _GENERATORS:
        for m in pattern.finditer(text):
            group = 1 if pattern.groups else 0
            if m.end(group) > m.start(group):
                out.add((m.start(group), kind, m.end(group)))
    return sorted(out)


def checks(s: str) -> list[bool]:
    """What the digits and letters of a span say about its format."""
    digits, plain = "".join(c for c in s if c in "0123456789"), s.replace(" ", "")
    moved = plain[4:] + plain[:4]
    account = bool(re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", plain)) and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    number = s[:-1].rstrip("-").translate(str.maketrans("XYZ", "012"))
    lettered = number.isascii() and number.isdigit() and len(number) in (7, 8) and LETTERS[int(number) % 23] == s[-1]
    social = bool(re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", s)) and not s.startswith(("000", "666", "9"))
    day = bool(re.fullmatch(r"(?:[0-3]?[0-9][ .-][01]?[0-9][ .-](?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}[ .-][01]?[0-9][ .-][0-3]?[0-9])(?:[ .-][0-9]{2})*", s))
    return [account, lettered, social, day, 9 <= len(digits) <= 15, len(digits) >= 12 and luhn(digits), s.startswith("AKIA") and len(s) == 20]


def features(text: str, span: Span) -> list[float]:
    """Format of the span, then its context."""
    start, kind, end = span
    s = text[start : min(end, start + 300)]
    n = len(s)
    counts = [sum(c.isdigit() for c in s), sum(c.isupper() for c in s), sum(c.islower() for c in s), sum(c.isspace() for c in s)]
    freq = [s.count(c) / n for c in set(s)]
    before = text[max(0, start - 24) : start].lower()
    own = [1.0 if p.search(before) else 0.0 for p in _HINTS.values()]
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:]))
    return [
        n, *(c / n for c in counts), counts[0], -sum(f * math.log2(f) for f in freq), switches / n,
        s.count(".") + s.count("-"), "@" in s, bool(re.search(r"\Wat\W", s, re.I)), bool(re.search(r"\Wdot\W", s, re.I)), bool(re.search(r"\w\.\s", s)), s[:1].isalpha(), s[-1:].isalpha(),
        before[-1:].isalnum(), before.rstrip(" \"'")[-1:] in ("=", ":"), text[end : end + 1].isalnum(), *checks(s),
        *(float(kind == k) for k in range(len(KINDS))), *own,
    ]


#: Fixed value: the check letters of a national identity number, by its remainder of 23.
LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

#: Words before and after a planted span, for three disjoint sets of surroundings.
_CUES = {
    "email": (("write to", "mail:", "contact"), ("send it to", "e-mail", "correo:"), ("reach me:", "my mail is", "schreib an")),
    "phone": (("call", "phone:", "tel."), ("my number is", "Telefon", "llama al"), ("ring", "mobile", "appelez le")),
    "secret": (("password=", "token = ", "api_key: "), ("secret=", "passwd: ", "access_token="), ("auth_token = ", "client_secret: ", "PASSWORD=")),
    "account": (("iban", "account"), ("IBAN:", "cuenta"), ("pay to", "Konto")),
    "identity": (("ssn", "dni"), ("SSN:", "DNI:"), ("social security", "con NIE")),
    "date": (("on", "date:"), ("since", "dated"), ("until", "el")),
    "number": (("version", "pages", "order"), ("release", "pp.", "invoice"), ("build", "p.", "batch")),
    "digest": (("checksum", "commit", "sha1"), ("md5", "hash", "revision"), ("digest", "etag", "blob")),
    "plain": (("in", "and", "the"), ("of", "with", "la"), ("from", "und", "le")),
    "size": (("size=", "note: "), ("count=", "see: "), ("total=", "title: ")),
}
_TAILS = ((" then", " of it", ", and"), (" now", " please", ". After"), (" today", "; next", "\nand so"))


def planted(count: int = PLANTED, part: int = 0) -> list[tuple[str, Span, bool]]:
    """(text, span, whether it is personal data): made-up examples, the same on every run.

    ``part`` is one of three disjoint sets of surroundings; shapes are shared, values differ.
    """
    r = random.Random(100 + part)
    chars = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    digits, lower, upper, hexes = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
    d, w = (lambda n: chars(digits, n)), (lambda: chars(lower, r.randint(3, 9)))

    def iban(valid: bool) -> str:
        country, body = chars(upper, 2), d(20)
        check = 98 - int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
        number = f"{country}{(check if valid else (check + r.randint(1, 96)) % 98):02d}{body}"
        return " ".join(number[i : i + 4] for i in range(0, 24, 4)) if r.random() < 0.5 else number

    def dni(valid: bool) -> str:
        number = d(8)
        own = LETTERS[int(number) % 23]
        return number + (own if valid else r.choice([c for c in LETTERS if c != own]))

    tld = lambda: r.choice(("com", "org", "net", "es", "io", "info"))
    sep = lambda: r.choice((" ", "-", "."))
    shapes = [  # kind of span, cues, maker, whether it is personal data
        (0, "email", lambda: f"{w()} at {w()} dot {tld()}", True), (0, "email", lambda: f"{w()} (at) {w()} (dot) {tld()}", True), (0, "email", lambda: f"{w()}[at]{w()}[dot]{tld()}", True),
        (0, "plain", lambda: f"{w()}.{w()} at {w()} dot {tld()}", True), (0, "plain", lambda: f"{w()} at {w()}. {w().title()}", False), (0, "plain", lambda: f"{w()} at {w()} . {w()}", False),
        (0, "plain", lambda: f"{w()} at {w()}.\n{w().title()}", False), (0, "number", lambda: f"{w()} at {w()}. {w().title()}", False),
        (3, "phone", lambda: (s := sep(), f"{d(3)}{s}{d(3)}{s}{d(4)}")[1], True), (3, "phone", lambda: f"({d(3)}) {d(3)}-{d(4)}", True), (3, "phone", lambda: (s := sep(), f"{d(2)}{s}{d(2)}{s}{d(2)}{s}{d(2)}{s}{d(2)}")[1], True),
        (3, "plain", lambda: f"({d(3)}) {d(3)}-{d(4)}", True), (3, "date", lambda: (s := sep(), f"{r.randint(1, 31):02d}{s}{r.randint(1, 12):02d}{s}{r.randint(1950, 2030)}")[1], False),
        (3, "date", lambda: f"{r.randint(1950, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 31):02d}", False), (3, "number", lambda: f"{d(2)}.{d(2)}.{d(2)}", False), (3, "number", lambda: f"{d(3)}-{d(3)}-{d(2)}", False),
        (3, "number", lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", False), (3, "plain", lambda: f"{d(3)}.{d(3)}.{d(3)}.{d(3)}", False),
        (4, "secret", lambda: chars(digits + "abcdef", r.randint(16, 24)), True), (4, "secret", lambda: chars(hexes, 40), True), (4, "secret", lambda: chars(lower + upper + digits + "_-", r.randint(10, 30)), True),
        (4, "secret", lambda: f"{w()}{r.choice('!#%')}{d(4)}{chars(upper, 2)}", True), (4, "plain", lambda: f"AKIA{chars(upper + '234567', 16)}", True), (4, "number", lambda: f"AKIA{chars(upper + '234567', 16)}", True),
        (4, "plain", lambda: chars(upper, r.randint(16, 24)), False), (4, "size", lambda: f"{w()}{w()}{w()}", False), (4, "digest", lambda: chars(hexes, r.choice((32, 40, 64))), False),
        (4, "plain", lambda: chars(hexes, 32), False), (4, "number", lambda: d(r.randint(16, 19)), False), (4, "plain", lambda: d(16), False), (4, "size", lambda: d(9), False), (4, "size", lambda: f"{w()}-{w()}-{w()}", False),
        (5, "account", lambda: iban(True), True), (5, "plain", lambda: iban(True), True), (5, "account", lambda: iban(False), False), (5, "number", lambda: iban(False), False),
        (6, "identity", lambda: f"{r.choice('12345')}{d(2)}-{d(2)}-{d(4)}", True), (6, "plain", lambda: f"{r.choice('12345')}{d(2)}-{d(2)}-{d(4)}", True), (6, "identity", lambda: dni(True), True), (6, "plain", lambda: dni(True), True),
        (6, "number", lambda: f"9{d(2)}-{d(2)}-{d(4)}", False), (6, "plain", lambda: f"{r.choice(('000', '666', '9' + d(2)))}-{d(2)}-{d(4)}", False), (6, "plain", lambda: dni(False), False), (6, "number", lambda: dni(False), False),
    ]
    out = []
    for kind, cues, make, personal in shapes:
        for _ in range(count):
            cue, value = r.choice(_CUES[cues][part]), make()
            head = f"{w()} {w()} {cue}{'' if cue[-1] in '= ' else ' '}" + ('"' if kind == 4 and cue[-1] in "= " and r.random() < 0.3 else "")
            out.append((f"{head}{value}{r.choice(_TAILS[part])} {w()}", (len(head), kind, len(head) + len(value)), personal))
    return out


def labelled_candidates(examples: list[tuple[str, Span, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, kinds) of all candidates in the examples: right only where exactly personal data was planted."""
    x, y, kinds = [], [], []
    for text, span, personal in examples:
        for found in candidates(text):
            x.append(features(text, found))
            y.append(personal and found == span)
            kinds.append(found[1])
    return np.array(x, float), np.array(y, float), np.array(kinds)


@dataclass
class Redactor:
    trees: Boosted
    thresholds: tuple[float, ...]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Selected candidates that overlap neither a base span nor a more probable one."""
        found = candidates(text)
        if not found:
            return []
        p = self.trees.probability(np.array([features(text, s) for s in found], float))
        starts, ends, out = [], [], []  # disjoint ranges in order
        for start, _, end in base:
            if ends and start < ends[-1]:
                ends[-1] = max(ends[-1], end)
            else:
                starts.append(start)
                ends.append(end)
        for i in np.argsort(-p, kind="stable").tolist():
            start, kind, end = found[i]
            if p[i] < self.thresholds[kind]:
                continue
            at = bisect_right(starts, start)
            if (at and ends[at - 1] > start) or (at < len(starts) and starts[at] < end):
                continue
            starts.insert(at, start)
            ends.insert(at, end)
            out.append(found[i])
        return out


@cache
def fit(precision: float = PRECISION) -> Redactor:
    """Trees from one set of planted examples, thresholds from another.

    A kind's threshold is the lowest at which the share of right candidates among those
    selected reaches ``precision``, but not below 0.5; a kind that never does selects nothing.
    """
    x, y, _ = labelled_candidates(planted(part=0))
    trees = boost(x, y, rounds=80)
    x, y, kinds = labelled_candidates(planted(part=1))
    p, thresholds = trees.probability(x), []
    for kind in range(len(KINDS)):
        own = kinds == kind
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= precision)
        thresholds.append(max(0.5, float(p[own][order][good[-1]])) if len(good) else 2.0)
    return Redactor(trees, tuple(thresholds))


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _span_rows(redactor: Redactor):
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "redacted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.string()]
        for batch in batches:
            out: list[list] = [[] for _ in types]
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                every = base + redactor.added(text, base)
                digest = hashlib.sha256(written_spans(base).encode()).hexdigest()
                for x, value in zip(out, (*(sum(s[1] == k for s in base) for k in range(4)), digest, written_spans(every), len(every), redact(text, every) if every else text)):
                    x.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, types))], names)

    return run


def personal_data(docs: DataFrame, precision: float = PRECISION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, redacted) for each row of docs.

    Counts and base_sha256 cover the base rules; spans lists all n_spans spans as
    kind:start:end in code points; redacted is the text with them replaced. A null text
    counts as empty, null ids and repeated rows stay, an empty table gives an empty result,
    other columns are not read. Every text is searched whole, in time that grows with its
    length.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, redacted string"
    return rows.mapInArrow(_span_rows(fit(precision)), schema)
