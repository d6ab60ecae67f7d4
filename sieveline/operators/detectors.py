"""Rule detectors of typed values in text: fixed shapes first, then values named by a key phrase, then loose shapes.

The order of the tables is the priority: a later detector never takes characters of an earlier one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Shapes, key phrases and values of the detectors.
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?"
WEEKDAY = r"(?:Mon|Tue|Tues|Wed|Thu|Thurs|Fri|Sat|Sun)[a-z]*,?\s+"
MERIDIEM = r"(?:[APap]\.[Mm]\.?|[APap][Mm])"
SHAPES = [
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", None),
    ("url", r"\b(?:https?|ftp)://[^\s\"'<>]*[^\s\"'<>.,;:!?)\]]", None),
    ("date_time", r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", None),
    ("mac_address", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", None),
    ("ipv6", r"\b(?:[0-9A-Fa-f]{1,4}:){1,7}(?::[0-9A-Fa-f]{1,4})+\b|\b(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{0,4}\b", "ipv6"),
    ("ipv4", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", None),
    ("vehicle_identifier", r"\b[A-HJ-NPR-Z0-9]{17}\b", "mixed"),
    ("postcode", r"\b[A-Z]{1,2}\d[A-Z0-9]?\s\d[A-Z]{2}\b", None),
    ("swift_bic", r"\b[A-Z]{6}[A-Z0-9]{2,6}\b", "digit"),
    ("unique_id", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", None),
    ("coordinate", r"\b-?\d{1,3}\.\d{3,8},\s*-?\d{1,3}\.\d{3,8}\b", None),
    ("coordinate", r"(?i:Latitude:\s*-?\d{1,3}\.\d+,\s*Longitude:\s*-?\d{1,3}\.\d+)", None),
]
ID = r"(?:[A-Za-z]{1,4}-){0,2}(?:[A-Za-z0-9]*\d[A-Za-z0-9]*)(?:-[A-Za-z0-9]+)*(?:\s\d{1,4})?(?:\s[A-Z]{2})?"
PHONE = r"\+?[\d][\d\s().-]{6,17}\d"
IBAN = r"[A-Z]{2}\d{2}(?:\s[A-Z0-9]{2,4}){2,8}"
COOKIE_DATE = r"(?:Expires|expires)=[A-Za-z]{3},\s*\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{2}:\d{2}:\d{2}\s+GMT"
COOKIE = rf"(?:{COOKIE_DATE}|[\w-]+=[\w./%-]+)(?:;\s*(?:{COOKIE_DATE}|[\w-]+(?:=[\w./%-]+)?))*"
ASSIGNED = r"[\s*]{0,3}(?:is|was)[\s*]{0,3}|[\s*]{0,3}[:,][\s*]{0,3}|[\s*]{0,3},\s*for\s+example[\s*]{0,3}|[\s*]{0,3}\|[\s*]{0,3}|[\s*]{1,3}"
#: label, key phrase, value, widest gap or delimiter, whether the value needs a digit
NAMED = [
    ("account_number", r"account[,\s]*number|accountNumber|bank\s*account", rf"(?:{IBAN}|{ID})", 20, True),
    ("customer_id", r"customer\s*id|user[\s_]*id", ID, 40, True),
    ("employee_id", r"employee\s*id", ID, 20, True),
    ("medical_record_number", r"medical\s*record\s*number|\bMRN\b", ID, 20, True),
    ("health_plan_beneficiary_number", r"health\s*plan\s*beneficiary\s*number", ID, 20, True),
    ("national_id", r"national\s*id", ID, 40, True),
    ("tax_id", r"tax\s*id(?:entification\s*number)?|\bTIN\b", ID, 20, True),
    ("certificate_license_number", r"certificate\s*license\s*number|driver'?s?\s*license\s*number|license\s*number", ID, 20, True),
    ("ssn", r"social\s*security(?:\s*number)?|\bSSN\b", r"\d{3}-?\d{2}-?\d{4}", 20, True),
    ("bank_routing_number", r"(?:bank\s*)?routing\s*number", r"\d{9}", 20, True),
    ("pin", r"\bPIN\b", r"\d{3,6}", 20, True),
    ("cvv", r"\bCVV\b|security\s*code", r"\d{3,4}", 20, True),
    ("api_key", r"api\s*key|apiKey", r"[A-Za-z0-9_.]{11,47}[A-Za-z0-9_]", 40, False),
    ("password", r"password", r"(?=[^\s,;.\n]*[^A-Za-z\s,;.\n])[^\s,;.\n]{4,30}", ASSIGNED, False),
    ("device_identifier", r"device\s*identifier|device\s*id", ID, 20, True),
    ("biometric_identifier", r"biometric\s*identifier", ID, 20, True),
    ("license_plate", r"license\s*plate", r"[A-Z0-9]{1,5}(?:[\s-][A-Z0-9]{1,5}){0,4}", r"[\s:*]{1,5}", True),
    ("postcode", r"postcode|zip\s*code|postal\s*code", r"(?:[A-Za-z0-9]{0,3}\d[A-Za-z0-9]{0,3})(?:\s?[A-Za-z0-9]{2,4})?", 20, True),
    ("fax_number", r"fax(?:\s*number)?", PHONE, 40, True),
    ("phone_number", r"phone(?:\s*number)?|\btel\b|\bmobile\b", PHONE, 40, True),
    ("http_cookie", r"cookie", COOKIE, 40, False),
    ("unique_id", r"unique\s*(?:bug\s*)?id", ID, 20, True),
]
CARD = re.compile(r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)")
LOOSE_PHONE = re.compile(r"(?<!\d)\+?\(?\d[\d\-. ()]{6,16}\d(?!\d)")
DATE = re.compile(rf"\b(?:(?:{WEEKDAY})?(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}}-\d{{1,2}}-\d{{4}}|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|{MONTH}\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}\s+{MONTH}\s+\d{{4}}))\b", re.I)
BIRTH = re.compile(r"born|birth|dob", re.I)
TIME = re.compile(rf"\b\d{{1,2}}:\d{{2}}(?::\d{{2}}(?:\.\d+)?)?(?:\s*{MERIDIEM})?(?:[+-]\d{{2}}:?\d{{2}})?(?!\d)|\b\d{{1,2}}\s*{MERIDIEM}\b")
TO_TIME = re.compile(r"\s*(?:-|to)\s*")
BIRTH_WINDOW = 30

_SHAPES = [(label, re.compile(p), rule) for label, p, rule in SHAPES]
_NAMED = [(label, re.compile(rf"(?i:{key})(?:{gap if isinstance(gap, str) else rf'[^\n]{{0,{gap}}}?'})(?P<val>{value})"), digit) for label, key, value, gap, digit in NAMED]


def _digit(x: str) -> bool:
    return any(c.isdigit() for c in x)


def _ipv6(x: str) -> bool:
    """Not a mere time: shortened, or at least three colons, or a hexadecimal letter."""
    return x.count(":") >= 2 and ("::" in x or x.count(":") >= 3 or any(c in "abcdefABCDEF" for c in x))


def _mixed(x: str) -> bool:
    return _digit(x) and any(c.isalpha() for c in x)


RULES = {None: lambda x: True, "ipv6": _ipv6, "mixed": _mixed, "digit": _digit}


def _phone(x: str) -> bool:
    return not DATE.fullmatch(x) and (x.startswith("+") or bool(re.search(r"[\-. ()]", x))) and 7 <= sum(c.isdigit() for c in x) <= 15


def proposals(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, label) of all detectors in order of priority."""
    for label, pattern, rule in _SHAPES:
        yield from ((*m.span(), label) for m in pattern.finditer(text) if RULES[rule](m[0]))
    for label, pattern, digit in _NAMED:
        yield from ((*m.span("val"), label) for m in pattern.finditer(text) if m["val"] and (_digit(m["val"]) or not digit))
    yield from ((*m.span(), "credit_debit_card") for m in CARD.finditer(text))
    yield from ((*m.span(), "phone_number") for m in LOOSE_PHONE.finditer(text) if _phone(m[0]))
    for m in DATE.finditer(text):
        yield *m.span(), "date_of_birth" if BIRTH.search(text, max(0, m.start() - BIRTH_WINDOW), m.start()) else "date"
    for m in TIME.finditer(text):
        yield *m.span(), "time"


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, label) of spans that don't overlap, by start: each proposal in turn takes its characters if free."""
    starts: list[int] = []
    taken: list[tuple[int, int, str]] = []
    for s, e, label in proposals(text):
        i = bisect_left(starts, s + 1)
        if (i and taken[i - 1][1] > s) or (i < len(taken) and taken[i][0] < e):
            continue
        if label == "time" and (gap := TO_TIME.match(text, e)) and (end := TIME.match(text, gap.end())):
            e = end.end()  # a range of times is one span
        starts.insert(i, s)
        taken.insert(i, (s, e, label))
    return taken


def detected(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, span_start, span_end, label, value): 0-based half-open code-point offsets. Null texts have no spans."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, s, e, label, t[s:e]) for k, t in zip(pdf["key"], pdf["text"]) for s, e, label in detect(t)]
            if rows:
                yield pd.DataFrame({c: pd.Series(list(v), dtype="object") for c, v in zip(("key", "span_start", "span_end", "label", "value"), zip(*rows))})

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    return rows.mapInPandas(run, f"key {kind}, span_start int, span_end int, label string, value string").withColumnRenamed("key", key)
