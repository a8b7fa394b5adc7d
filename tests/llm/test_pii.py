import random
import re

import pytest

from keyloom.llm.pii import BASE, candidates, find_personal_data, luhn, mod97, redact, spans

SCHEMA = "doc_id bigint, text string, spans string"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }


def test_base_spans_match_the_plain_expressions():
    rng = random.Random(1)
    parts = ["a@b.c", "@", "x.y@", "d-e.f", ".", " ", "1.2.3.4", "256.1.1.1", "12.34", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", "-", "é", "日", "0012.1.2.3", "\n", "a%+", "77", "..", "@@b.c", "5500000000000004"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert {k: v for k, v in candidates(text).items() if k in BASE} == brute(text), text


def test_validators():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("GB82WEST12345698765432") and not mod97("GB82WEST12345698765433")


def test_context_raises_scores_and_lets_weak_kinds_in():
    text = "my ssn 123-45-6789 and 123-45-6780 is far far far far far far far far far far far far far away 321-54-9876"
    assert [(k, a) for k, a, _, _ in spans(text)] == [("ssn", 7), ("ssn", 23)]
    (kind, _, _, near), (_, _, _, far) = spans("iban GB82 WEST 1234 5698 7654 32")[0], spans("x GB82WEST12345698765432")[0]
    assert kind == "iban" and near > far


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a." * 150_000, "1." * 150_000, "@" * 300_000, "+1 " * 100_000, "GB82 " * 60_000):
        spans(text)


def test_tables(spark):
    assert find_personal_data(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "é a@b.cd and 10.0.0.1", "x"), (1, "é a@b.cd and 10.0.0.1", "x"), (None, None, None), (2, "", None)]
    out = find_personal_data(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "spans"]
    assert [[(s.kind, s.start, s.end) for s in r.spans] for r in out.collect()] == [[("email", 2, 8), ("ip", 13, 21)]] * 2 + [[], []]
    assert [r.text for r in redact(spark.createDataFrame(rows, SCHEMA)).collect()] == ["é <email> and <ip>"] * 2 + [None, ""]


@pytest.mark.parametrize("text", ["", "no digits here", "a@b"])
def test_nothing_found(text):
    assert spans(text) == []
