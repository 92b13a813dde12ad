"""Personal data: regular expressions propose spans, checksums confirm them, context words nearby adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns and checks and are always kept; the score only says how sure they
are. Further kinds (iban, ssn, secret) count only if their score reaches a threshold: an IBAN by its mod-97 checksum, a social
security number by its form and a context word close by, a secret (a long run of mixed letters and digits) by a word that
names one close by. Further spans may overlap base spans, which stay as they are.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuetime.llm.tokens import blocks

# Kinds in their order, patterns, base scores, context words.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LENGTHS = {k: int(n) for n, ks in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,CR,HR,LI,LV 22:BG,BH,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV "
    "29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
).split()) for k in ks.split(",")}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,128}(?![A-Za-z0-9_-])")
_SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "secret": 0.4}
_CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "server", "host", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "password", "passwd", "apikey", "key", "credential", "bearer"),
}
_BOOST, _WINDOW, _THRESHOLD = 0.2, 50, 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str):
    """Leftmost matches of the address pattern, found from each @ outwards instead of from each letter."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            after = found.end()
            yield start, after
        at = text.find("@", max(after, at + 1))


def _ips(text: str):
    """Leftmost matches of four dotted numbers: of each run of dotted numbers every four in turn, so that digits are read once."""
    for found in _DOTTED.finditer(text):
        start, parts = found.start(), found[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            numbers = [p.lstrip("0") for p in four]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in numbers):
                yield start, end
            start = end + 1


def _secrets(text: str):
    """Long runs of letters and digits of which both kinds come often, as in keys and tokens."""
    for found in _SECRET.finditer(text):
        digits = sum(map(found[0].count, "0123456789"))
        if 3 <= digits <= len(found[0]) - 3 and len(set(found[0])) >= 8:
            yield found.span()


def _ibans(text: str):
    """Confirmed IBANs. The pattern may take in words or numbers behind one, so it may also end at a space: at its country's fixed length, or the longest that fits."""
    found = _IBAN.search(text)
    while found:
        a, b = found.span()
        ends = [b, *(a + i for i in range(b - a - 1, 0, -1) if text[a + i] == " ")]
        sizes = {e: e - a - text.count(" ", a, e) for e in ends}
        fixed = _LENGTHS.get(text[a : a + 2])
        ends = [e for e in ends if e == b or (sizes[e] == fixed if fixed else sizes[e] >= 15)]
        ends.sort(key=lambda e: (sizes[e] != fixed, -e))
        end = next((e for e in ends if mod97(text[a:e].replace(" ", ""))), None)
        if end:
            yield a, end
        found = _IBAN.search(text, end or a + 1)


def _long_number(text: str) -> bool:
    digits = sum(map(text.count, "0123456789"))
    return 13 <= digits <= 19 and luhn("".join(c for c in text if c.isdigit()))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", *x) for x in _ips(text)]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and _long_number(m[0])]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(m[0].count, "0123456789")) <= 15]
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's base score, raised by a context word within the window on either side."""
    near = f" {text[max(0, start - _WINDOW) : start]} {text[end : end + _WINDOW]} ".lower()
    words = re.findall(r"[a-z]+", near)
    return min(1.0, _SCORES[kind] + _BOOST * any(w.startswith(c) for w in words for c in _CONTEXT[kind]))


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans of a text with their scores, by kind as listed, then start."""
    base = base_spans(text)
    more = [("iban", *x) for x in _ibans(text)]
    more += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    more += [("secret", *x) for x in _secrets(text)]
    scored = [(k, a, b, score(text, k, a, b)) for k, a, b in [*base, *more]]
    return [x for x in scored if x[0] in BASE_KINDS or x[3] >= _THRESHOLD]


def redact(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; where spans overlap, the union goes under the first kind."""
    out, at = [], 0
    for kind, a, b, _ in sorted(find_spans(text), key=lambda x: (x[1], -x[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end, score) of every whole text of ``docs``, one row per row.

    Columns read: doc_id, text. Offsets are code points, ends exclusive. A null text counts as empty and has no spans;
    an empty table gives no rows. Nothing is shuffled.
    """

    def spans(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for ids, texts in blocks(batches, ("doc_id", "text")):
            found = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find_spans(t or "")] for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "spans": pa.array(found, kind)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(spans, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans, all spans and their scores as text, of :func:`personal_data`'s rows."""
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    scores = F.array_join(F.transform("spans", lambda x: F.format_number(x["score"], 2)), ",")
    of_kind = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), scores.alias("scores"))


def digest_of(spans: list[tuple]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans).encode()).hexdigest()
