"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Four base kinds are always reported once their pattern and validator hold:
email, ip, card (Luhn) and phone. The method adds two kinds: iban, confirmed by
mod-97 at its country's length, and ssn, which has no checksum and so needs a context word nearby.
Every span has a score: its kind's prior, more for a checksum that holds, more
for a context word within CONTEXT characters before it. Only added kinds are
dropped by a low score.

A null or empty text has no spans. Offsets are code points, end exclusive.
Repeated rows give repeated rows. All scans are linear in the text's length,
so a text of any length is read whole. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import picked, slices, table, texts_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
CONTEXT = 48
THRESHOLD = 0.6

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of the plain pattern always starts where a run of digits starts, so the
# look-behind and the possessive runs change no result; they keep long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}))")
#: Characters by country, of the IBAN registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.4, "ssn": 0.4}
CHECKSUM, NEARBY = 0.4, 0.2
WORDS = {
    "email": re.compile(r"\b(?:e-?mail|contact|write|courriel|correo)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|login)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|credit|debit|carte|tarjeta|karte)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|telefon|t[eé]l[eé]phone)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security)\b", re.I),
}

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[Span]:
    """From each @ outwards: the local part cannot hold an @, so the walk back is linear."""
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            low = m.end()
        else:
            low = max(low, at + 1)
        at = text.find("@", max(at + 1, low))
    return found


def base_spans(text: str) -> list[Span]:
    found = emails(text)
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-3:] if len(x) > 3 else x) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


def ibans(text: str) -> list[Span]:
    """The candidate is cut to its country's length; for a country that is not in the registry, to each end of a word, the longest first."""
    found, low = [], 0
    for m in IBAN.finditer(text):
        if m.start() < low:
            continue
        # Ends of words, by the number of characters up to them.
        ends, n = {}, 4
        for at in range(*m.span(2)):
            if text[at] != " ":
                n += 1
                after = text[at + 1 : at + 2]
                if not (after.isascii() and after.isalnum()):
                    ends[n] = at + 1
        known = IBAN_LENGTHS.get(m[1])
        for n in [known] if known else sorted(ends, reverse=True):
            if n in ends and mod97(text[m.start() : ends[n]].replace(" ", "")):
                found.append(("iban", m.start(), ends[n]))
                low = ends[n]
                break
    return found


def added_spans(text: str) -> list[Span]:
    if not DIGIT.search(text):
        return []
    return ibans(text) + [("ssn", *m.span()) for m in SSN.finditer(text)]


def score(text: str, span: Span) -> float:
    kind, start, _ = span
    checked = CHECKSUM if kind in ("card", "iban") else 0.0
    near = NEARBY if WORDS[kind].search(text, max(0, start - CONTEXT), start) else 0.0
    return min(1.0, PRIOR[kind] + checked + near)


def find_pii(text: str) -> list[tuple[Span, float]]:
    """All spans with their scores: base kinds as listed, then added ones, each by start."""
    scored = [(s, score(text, s)) for s in base_spans(text)]
    more = [(s, score(text, s)) for s in added_spans(text)]
    return scored + [x for x in more if x[1] >= THRESHOLD]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores")
    for batch in slices(batches, "text"):
        out: dict[str, list] = {n: [] for n in names}
        for text in texts_of(batch, "text"):
            found = find_pii(text)
            base = [s for s, _ in found if s[0] in BASE]
            for kind in BASE:
                out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined([s for s, _ in found]))
            out["scores"].append(",".join(f"{x:.1f}" for _, x in found))
        columns = [pa.array(out[n], pa.int64() if n.startswith("n_") else pa.string()) for n in names]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", *names])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of base kinds, their digest, all spans and their scores.

    Narrow: no shuffle, so neither hot sources nor copies matter.
    """
    return picked(docs, doc_id=id_col, text=text_col).mapInArrow(_rows, SCHEMA)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))
