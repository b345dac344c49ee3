"""Personal data spans, against Python's regular expressions."""

import re

from sensorloom.llm import pii
from tests.llm.conftest import rows_of


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
)


def brute(text):
    out = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(BASE) for m in re.finditer(p, text or "") if ok(m[0])]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def spans(row, base=True):
    return [(x["kind"], x["start"], x["end"]) for x in row["pii"] if x["base"] or not base]


TRICKY = (
    "a@b.c._x@y.z then ..a@b..c q@q", "x@y.z@w.v a%b+c@d-e.f-g.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 0.0.0.0",
    "1.2.3", "4111 1111 1111 1111-4111-1111-1111-1111", "4111111111111111 12 34", "+1 (171) 555-2028. +44 20 7946 0958 ++1 22 333 4444 55",
    "+1", "\u0001a@b.c\u0002 \U0001F600 me@home.org", "5" * 5000 + " " + "a" * 5000 + "@b", "x@" + "a." * 3000 + "z",
    " ".join(f"u{i}@mail.org" for i in range(700)), "tel +1 234 567 8901 card 5500-0000-0000-0004", None, "",
)


def test_base_spans(spark, documents):
    docs = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    for row in rows_of(pii.find_pii(documents.select("doc_id", "text").unionByName(docs))):
        assert spans(row) == brute(row["text"]), row["text"][:200]


def test_added_kinds_are_checked(spark):
    docs = spark.createDataFrame([
        (1, "Pay to account DE89 3704 0044 0532 0130 00 today"), (2, "Pay to account DE89 3704 0044 0532 0130 01 today"),
        (3, "my social security number is 123-45-6789"), (4, "part 123-45-6789"), (5, 'token = "d61a29ffaa0098ddeeff00112233445566778899"'),
    ], "doc_id long, text string")
    got = {r["doc_id"]: [x[0] for x in spans(r, False)] for r in rows_of(pii.find_pii(docs))}
    assert got == {1: ["iban"], 2: [], 3: ["ssn"], 4: [], 5: ["secret"]}
    text = rows_of(pii.redacted(pii.find_pii(docs)))[0]["text"]
    assert text == "Pay to account [IBAN] today"


def test_ibans_before_capitals_and_digits(spark):
    texts = {
        "GB82 WEST 1234 5698 7654 32 Please pay": ["GB82 WEST 1234 5698 7654 32"],
        "IBAN GB82WEST12345698765432 2024": ["GB82WEST12345698765432"],
        "DE89370400440532013000 BIC COBADEFF": ["DE89370400440532013000"],
        "DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32 X": ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"],
        "NO93 8601 1117 947 AND MT84MALT011000012345MTLCAST001S": ["NO93 8601 1117 947", "MT84MALT011000012345MTLCAST001S"],
        "Order AB12 CDEF GHIJ KLMN DE89370400440532013000": ["DE89370400440532013000"],
        "GB83 WEST 1234 5698 7654 32 Please pay": [], "DE89370400440532013000X": [], "DE8937040044053201300 BIC": [],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["text"]: [r["text"][a:b] for k, a, b in spans(r, False) if k == "iban"] for r in rows_of(pii.find_pii(docs))}
    assert got == texts


def test_odd_rows(odd, empty):
    out = pii.find_pii(odd.withColumnRenamed("n_words", "pii"))
    assert out.count() == odd.count() and out.columns == ["doc_id", "text", "source", "pii"]
    assert pii.find_pii(empty).count() == 0


def test_no_python_in_the_plan(spark, documents):
    plan = pii.find_pii(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_context_is_whole_words_on_both_sides(spark):
    rows = [(1, "ssn 123-45-6789"), (2, "antisocial 123-45-6789"), (3, "123-45-6789 is the social security number"), (4, "123-45-6789 socially"),
            (5, "ssn " + "x " * 30 + "123-45-6789"), (6, "SSN: 123-45-6789, 987-65-4321 and 123-45-6780")]
    got = {r["doc_id"]: [x["start"] for x in r["pii"] if x["kind"] == "ssn"] for r in rows_of(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == {1: [4], 2: [], 3: [0], 4: [], 5: [], 6: [5]}
