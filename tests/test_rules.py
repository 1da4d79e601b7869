"""Single-rule matching and validators (golden cases of the reference tests)."""

import pytest
from pyspark.sql import functions as F

from pseudoflow.functions.rules import RULES, PACKS, rule_by_id, rules_for_language, rules_for_level
from pseudoflow.functions import validators as V
from pseudoflow.operators.detect import detect


def find(spark, rule_id, text):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return [r.value for r in detect(df, [rule_by_id(rule_id)], strict=False).orderBy("hit_no").collect()]


CASES = [
    ("pl.pesel", "nr PESEL: 90010112318", ["90010112318"]),
    ("pl.pesel", "ref: 9001011231", []),
    ("pl.pesel", "ref: 900101123180", []),
    ("pl.pesel", "+48601234567", []),
    ("pl.pesel", "ż90010112318", ["90010112318"]),
    ("pl.iban", "Konto: PL61109010140000071219812874", ["PL61109010140000071219812874"]),
    ("pl.iban", "61 1090 1014 0000 0712 1981 2874", ["61 1090 1014 0000 0712 1981 2874"]),
    ("pl.iban", "1234567890123456789012345", []),
    ("pl.phone", "Tel: +48 601 234 567", ["+48 601 234 567"]),
    ("pl.phone", "Tel: 601234567", ["601234567"]),
    ("pl.phone", "Tel: (22) 555-44-33", ["(22) 555-44-33"]),
    ("pl.phone", "+48 22 300 400 500", []),
    ("pl.nip", "NIP: 526-000-00-05", ["NIP: 526-000-00-05"]),
    ("pl.nip", "5260000005", []),
    ("en.ssn", "SSN: 123-45-6789", ["123-45-6789"]),
    ("en.credit-card", "card 4111 1111 1111 1111.", ["4111 1111 1111 1111"]),
    ("en.phone", "Call (555) 123-4567", ["(555) 123-4567"]),
    ("en.phone", "Call +1 (555) 123-4567", ["+1 (555) 123-4567"]),
    ("global.email", "Visit example.com", []),
    ("global.email", "mail john@company.com.", ["john@company.com"]),
    ("global.ipv4", "host 192.168.1.255 and 256.1.1.1", ["192.168.1.255"]),
    ("global.ipv6", "addr 2001:db8:85a3:0:0:8a2e:370:7334", ["2001:db8:85a3:0:0:8a2e:370:7334"]),
    ("global.url", 'see https://a.example/x?y=1" ok', ["https://a.example/x?y=1"]),
    ("global.iban", "DE89370400440532013000", ["DE89370400440532013000"]),
    ("pl.postal-code", "00-950 Warszawa", ["00-950"]),
    ("en.zip-code", "Austin 78701-1234", ["78701-1234"]),
    ("global.phone", "call +44 20 7946 0958", ["+44 20 7946 0958"]),
]


@pytest.mark.parametrize("rule_id,text,expected", CASES)
def test_rule_matches(spark, rule_id, text, expected):
    assert find(spark, rule_id, text) == expected


def test_catalogue_invariants():
    ids = [r.rule_id for r in RULES]
    assert len(ids) == len(set(ids)) == 15
    bal, strict, par = (set(r.rule_id for r in rules_for_level(l)) for l in ("balanced", "strict", "paranoid"))
    assert len(bal) == 7 and len(strict) == 11 and len(par) == 15
    assert bal <= strict <= par
    assert [r.rule_id for r in rules_for_language("de")] == list(PACKS["en"])


VALID = [
    ("ssn", "123-45-6789", True), ("ssn", "000-12-3456", False), ("ssn", "666-12-3456", False),
    ("ssn", "900-12-3456", False), ("ssn", "123-00-6789", False), ("ssn", "123-45-0000", False),
    ("luhn", "4111111111111111", True), ("luhn", "5500-0000-0000-0004", True), ("luhn", "378282246310005", True),
    ("luhn", "1234567890123456", False), ("luhn", "411111111111", False),
    ("nip", "526-000-00-05", True), ("nip", "NIP: 526-000-00-05", True), ("nip", "526-000-00-00", False),
]


@pytest.mark.parametrize("name,value,ok", VALID)
def test_validators(spark, name, value, ok):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(V.VALIDATORS[name](F.col("v")).alias("ok")).first().ok is ok
