"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, "://", plus signs, digits, cue words and prefixes of keys. At each anchor a
local parser expands the span to both sides and validates it. Kinds, in the order used for ties:
email, ip, card, phone (their exact rules are those of the reference patterns below), and the method's own: url (http, https, ftp);
after a cue, account (a number; an IBAN must pass its check digits), ssn (no unused area, group or serial number), passport (six to nine
capitals and digits, at least four of them digits), tax (an EIN, a German number with its check digit, a Spanish one with its letter, or
a VAT number of a country that has them) and secret (a value of eight characters or more with letters and digits, behind ":" or "=");
and, without a cue, secrets of well-known formats. A cue stands at the start of a word; cues in prose without such a value give nothing.

Matches of a kind do not overlap and are the leftmost ones; a match that fails its validation is dropped, and the search goes on
after it. Offsets are code points, ends exclusive. A null text is empty and has no spans. Each row is handled by itself, so repeated
rows and ties get equal spans. Work is linear in the text's length for any input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "url", "account", "ssn", "passport", "tax", "secret")
BASE_KINDS = KINDS[:4]
SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
ACCOUNT = re.compile(r"[ \t]*(?:no|nr|number|num)?[ \t.:#=]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){10,30}|[0-9](?:[ -]?[0-9]){7,33})")
FILLER = r"[ \t]*(?:(?i:no|nr|number|nummer|num|id|is|card)\b)?[ \t.:#=]{1,4}"
SSN = re.compile(FILLER + r"([0-9]{3}([- ]?)[0-9]{2}\2[0-9]{4})(?![A-Za-z0-9])")
PASSPORT = re.compile(FILLER + r"([A-Z0-9]{6,9})(?![A-Za-z0-9])")
TAX = re.compile(FILLER + r"([0-9]{2}-[0-9]{7}|[0-9]{2}(?: ?[0-9]{3}){3}|[0-9]{8}-?[A-Z]|[A-Z]{2} ?[A-Z0-9]{8,12})(?![A-Za-z0-9])")
SECRET = re.compile(r"[\"']?[ \t]{0,4}(?::|=|=>)[ \t]{0,4}(?:(?i:bearer) )?[\"']?([A-Za-z0-9_./+~!@#$%^&*-]{8,512}={0,2})")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = "0123456789"
SCHEMES = ("https", "http", "ftp")
# Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22,
    "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
# Cues by kind, countries with VAT numbers, letters of Spanish tax numbers, public formats of keys.
CUES = {
    "account": ("iban", "account", "acct", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security"),
    "passport": ("passport", "reisepass", "passeport", "pasaporte"),
    "tax": ("tax id", "tax number", "taxpayer id", "ein", "vat", "vat id", "steuer-id", "steuernummer", "ust-idnr", "nif", "tva"),
    "secret": (
        "api key", "api_key", "api-key", "apikey", "access key", "access_key", "access-key", "secret key", "secret_key", "secret-key",
        "secret", "token", "password", "passwd", "pwd", "passphrase", "authorization", "passwort", "kennwort", "mot de passe", "contraseña",
    ),
}
VAT_COUNTRIES = frozenset("AT BE BG CY CZ DE DK EE EL ES FI FR GB HR HU IE IT LT LU LV MT NL PL PT RO SE SI SK XI".split())
NIF_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
FORMATS = {
    "AKIA": re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    "ASIA": re.compile(r"ASIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    "AIza": re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z])"),
    "ghp_": re.compile(r"ghp_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "gho_": re.compile(r"gho_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "ghs_": re.compile(r"ghs_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "glpat-": re.compile(r"glpat-[0-9A-Za-z_-]{20}(?![0-9A-Za-z])"),
    "xoxb-": re.compile(r"xoxb-[0-9A-Za-z-]{10,250}"),
    "xoxp-": re.compile(r"xoxp-[0-9A-Za-z-]{10,250}"),
    "sk_live_": re.compile(r"sk_live_[0-9A-Za-z]{16,250}"),
    "eyJ": re.compile(r"eyJ[0-9A-Za-z_-]{8,2000}\.eyJ[0-9A-Za-z_-]{8,4000}\.[0-9A-Za-z_-]{8,2000}"),
    "-----BEGIN ": re.compile(r"-----BEGIN (?:[A-Z]{2,10} )?PRIVATE KEY-----[A-Za-z0-9+/=\s]{0,20000}(?:-----END (?:[A-Z]{2,10} )?PRIVATE KEY-----)?"),
}


def automaton() -> ahocorasick.Automaton:
    """Anchors with their first character's kind and length."""
    found = ahocorasick.Automaton()
    for digit in DIGITS:
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for kind, cues in CUES.items():
        for cue in cues:
            forms = {cue, cue.upper(), cue.title(), cue.capitalize(), cue.replace("api", "API")}
            for form in forms | {re.sub(r"\b[Ii]d\b", "ID", f) for f in forms}:
                found.add_word(form, (kind, len(form)))
    for prefix in FORMATS:
        found.add_word(prefix, ("format", len(prefix)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def iban_length(text: str) -> int:
    """Length of the IBAN that text begins with, with its spaces; 0 if there is none. Capitals that follow are not part of it: a listed
    country's length is fixed; for another country the longest end that passes the check digits counts."""
    ends = [i + 1 for i, c in enumerate(text) if c != " "]
    own = IBAN_LENGTHS.get(text[:2])
    sizes = [own] if own else range(min(len(ends), 34), 14, -1)
    return next((ends[n - 1] for n in sizes if n <= len(ends) and iban(text[: ends[n - 1]])), 0)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def ssn(text: str) -> bool:
    d = _digits(text)
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def passport(text: str) -> bool:
    return len(_digits(text)) >= 4


def german_tax(digits: str) -> bool:
    """ISO 7064, MOD 11, 10."""
    rest = 10
    for c in digits[:-1]:
        rest = ((rest + int(c)) % 10 or 10) * 2 % 11
    return digits[0] != "0" and (11 - rest) % 10 == int(digits[-1])


def tax(text: str) -> bool:
    d = _digits(text)
    if text[0] not in DIGITS:
        return text[:2] in VAT_COUNTRIES and len(d) >= 7
    if text[-1] not in DIGITS:
        return NIF_LETTERS[int(d) % 23] == text[-1]
    return text[2] == "-" or german_tax(d)


def secret(text: str) -> bool:
    return any(c in DIGITS for c in text) and any(c.isalpha() for c in text)


#: Pattern and validation of what follows a cue; accounts have a rule of their own.
AFTER = {"ssn": (SSN, ssn), "passport": (PASSPORT, passport), "tax": (TAX, tax), "secret": (SECRET, secret)}


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of all spans, in order."""
    out: list[tuple[int, int, int]] = []
    done = [0] * len(KINDS)  # where the last match of a kind ended, kept or dropped
    for last, (anchor, length) in anchors.iter(text):
        at = last - length + 1
        if anchor == "digit":
            if at >= done[1] and (at == done[1] or at == 0 or text[at - 1] not in DIGITS) and (m := IP.match(text, at)):
                done[1] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    out.append((at, 1, m.end()))
            if at >= done[2] and (m := CARD.match(text, at)):
                done[2] = m.end()
                if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                    out.append((at, 2, m.end()))
        elif anchor == "at":
            start = at
            while start > done[0] and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                done[0] = m.end()
                out.append((start, 0, m.end()))
        elif anchor == "plus":
            if at >= done[3] and (m := PHONE.match(text, at)):
                done[3] = m.end()
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append((at, 3, m.end()))
        elif anchor == "scheme":
            scheme = next((s for s in SCHEMES if text[max(0, at - len(s)) : at].lower() == s), None)
            if scheme and at - len(scheme) >= done[4] and (m := URL.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)]"))
                done[4] = m.end()
                if end > last + 1:
                    out.append((at - len(scheme), 4, end))
        elif at and text[at - 1].isalnum():
            continue  # inside a word
        elif anchor == "account":
            if at >= done[5] and (m := ACCOUNT.match(text, last + 1)):
                length = len(m[1]) if m[1][0] in DIGITS else iban_length(m[1])
                done[5] = m.start(1) + length if length else m.end()
                if length:
                    out.append((m.start(1), 5, m.start(1) + length))
        elif anchor == "format":
            if at >= done[9] and (m := FORMATS[text[at : last + 1]].match(text, at)):
                done[9] = m.end()
                out.append((at, 9, m.end()))
        else:
            place, (pattern, valid) = KINDS.index(anchor), AFTER[anchor]
            if at >= done[place] and (m := pattern.match(text, last + 1)) and valid(value := m[1].rstrip(".!")):
                done[place] = m.start(1) + len(value)
                out.append((m.start(1), place, done[place]))
    return sorted(out)


@F.pandas_udf(SPANS)
def spans_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    anchors = automaton()
    for texts in batches:
        yield pd.Series(
            [
                [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(text, anchors)] if text else []
                for text in texts
            ]
        )


def spans(documents: DataFrame) -> DataFrame:
    """doc_id and all spans, by start, then kind."""
    return documents.select("doc_id", spans_of("text").alias("spans"))


def redacted(documents: DataFrame) -> DataFrame:
    """doc_id and the text with each run of overlapping spans replaced by its first kind in brackets."""

    @F.pandas_udf("string")
    def redact(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, found, strict=True):
            parts, done = [], 0
            for span in spans:
                if span["start"] >= done:
                    parts += [text[done : span["start"]], f"[{span['kind']}]"]
                done = max(done, span["end"])
            out.append("".join(parts) + (text or "")[done:])
        return pd.Series(out)

    rows = documents.select("doc_id", "text", spans_of("text").alias("spans"))
    return rows.select("doc_id", "spans", redact("text", "spans").alias("text"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
