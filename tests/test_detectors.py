import re

import pytest

from sieveline.operators import detectors as D

CASES = [
    ("write to a.b+c@mail.example.org now", "email", "a.b+c@mail.example.org"),
    ("see https://x.example/a?b=1.", "url", "https://x.example/a?b=1"),
    ("at 2024-02-03T10:11:12Z sharp", "date_time", "2024-02-03T10:11:12Z"),
    ("mac 00:1A:2b:3C:4d:5E up", "mac_address", "00:1A:2b:3C:4d:5E"),
    ("v6 fe80::1ff:fe23 up", "ipv6", "fe80::1ff:fe23"),
    ("host 10.0.254.9 up", "ipv4", "10.0.254.9"),
    ("VIN 1HGCM82633A004352.", "vehicle_identifier", "1HGCM82633A004352"),
    ("TR14 8BE here", "postcode", "TR14 8BE"),
    ("BIC DEUTDEFF500 ok", "swift_bic", "DEUTDEFF500"),
    ("id 123e4567-e89b-12d3-a456-426614174000", "unique_id", "123e4567-e89b-12d3-a456-426614174000"),
    ("at 51.5007, -0.1246 there", "coordinate", "51.5007, -0.1246"),
    ("Account number: NL37 RABO 1234 5678 90", "account_number", "NL37 RABO 1234 5678 90"),
    ("customer id is C-77812", "customer_id", "C-77812"),
    ("Employee ID: EM-4411", "employee_id", "EM-4411"),
    ("MRN 8842193", "medical_record_number", "8842193"),
    ("health plan beneficiary number HP-99182", "health_plan_beneficiary_number", "HP-99182"),
    ("national id 7781-22", "national_id", "7781-22"),
    ("TIN: 12-3456789", "tax_id", "12-3456789"),
    ("driver's license number: WA-RN-642819", "certificate_license_number", "WA-RN-642819"),
    ("SSN: 123-45-6789", "ssn", "123-45-6789"),
    ("routing number 021000021", "bank_routing_number", "021000021"),
    ("PIN 4471", "pin", "4471"),
    ("CVV 123", "cvv", "123"),
    ("API key: abcDEF123456xyz", "api_key", "abcDEF123456xyz"),
    ("password: River99#", "password", "River99#"),
    ("device id DV-1009", "device_identifier", "DV-1009"),
    ("biometric identifier BIO-2201", "biometric_identifier", "BIO-2201"),
    ("license plate: PB 09 YP 3852", "license_plate", "PB 09 YP 3852"),
    ("fax number +44 20 7946 0958", "fax_number", "+44 20 7946 0958"),
    ("phone: (212) 555-0100", "phone_number", None),
    ("cookie sid=ab12; Path=/; Secure", "http_cookie", "sid=ab12; Path=/; Secure"),
    ("pay 4111 1111 1111 1111 now", "credit_debit_card", "4111 1111 1111 1111"),
    ("call +1 212 555 0100 now", "phone_number", "+1 212 555 0100"),
    ("due 15.07.2024 at noon", "date", "15.07.2024"),
    ("born on 15 Jan 1980 in", "date_of_birth", "15 Jan 1980"),
    ("from 9:00 AM to 11:00 AM", "time", "9:00 AM to 11:00 AM"),
]


@pytest.mark.parametrize("text,label,value", CASES)
def test_each_label(text, label, value):
    got = [(lab, text[s:e]) for s, e, lab in D.detect(text)]
    assert any(lab == label and (value is None or v == value) for lab, v in got), got


def test_priorities_and_rejections():
    assert [x[2] for x in D.detect("at 12:34:56 today")] == ["time"]
    assert D.detect("the password should be strong") == []
    assert D.detect("customer id missing") == []
    assert D.detect("") == []


def test_spans_never_overlap():
    text = " ".join(t for t, _, _ in CASES)
    got = D.detect(text)
    assert got == sorted(got)
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_offsets_are_code_points(spark):
    df = spark.createDataFrame([(1, "é😀 a@b.example"), (2, None), (3, "")], "k long, t string")
    assert [tuple(r) for r in D.detected(df, "k", "t").collect()] == [(1, 3, 14, "email", "a@b.example")]


def test_native_spans_agree_with_regex(spark):
    from sieveline.plans.catalog import NATIVE
    from sieveline.operators import spans
    from pyspark.sql import functions as F

    texts = ["x a@b.example, 10.1.2.3 on 2024-01-02", "no", "", "call +1 212 555 0100 or 10.0.0.1", "ß a@b.cd a@b.ef"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for label, p in NATIVE.items():
        got = {(r.i, x.start, x.end) for r in df.select("i", spans.matches(F.col("t"), p, label).alias("x")).collect() for x in r.x}
        assert got == {(i, *m.span()) for i, t in enumerate(texts) for m in re.finditer(p, t, re.A)}
