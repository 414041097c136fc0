import hashlib
import random
import re

from tables import documents, empty, messy, plain

from sondage.llm import pii_rules
from sondage.llm.pii import find_personal_data, redact
from sondage.llm.queries import QUERIES

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def confirmed(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(digits[::-1])]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS for m in re.finditer(p, text) if confirmed(k, m.group())]


def expected(doc_id, text):
    spans = brute(text or "")
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (doc_id, *[sum(s[0] == k for s in spans) for k, _ in PATTERNS], hashlib.sha256(joined.encode()).hexdigest())


def test_base_spans_are_those_of_the_plain_patterns():
    random.seed(3)
    letters = ["a", "Z", "7", "0", "1", "25", "4539", ".", "@", "-", "+", " ", "_", "%", "(", ")", "é", "\U0001f600", "a.b@c.de", "10.0.0.1", "4485275742308327", "+1 (212) 555-0199"]
    for _ in range(20_000):
        text = "".join(random.choices(letters, k=random.randint(0, 24)))
        assert pii_rules.base_spans(text) == brute(text), text


def test_validators_and_context():
    assert [s[:3] for s in pii_rules.find("IBAN DE89 3704 0044 0532 0130 00 please")] == [("iban", 5, 32)]
    assert pii_rules.find("IBAN DE88 3704 0044 0532 0130 00 please") == []
    assert pii_rules.find("my ssn is 123-45-6789")[0][:2] == ("national_id", 10)
    assert pii_rules.find("rod 123-45-6789") == []
    card = pii_rules.find("order 4485275742308327")
    assert card[0][3] < 0.5 and card[0][4]  # unlikely by its context, but a base span stays
    assert pii_rules.find("visa 4485275742308327")[0][3] == 1.0


def test_long_runs_take_linear_time():
    for text in ("7" * 1_000_000, "a" * 1_000_000 + "@", "+" + "1 " * 500_000, "a@" * 300_000, "1.1." * 300_000, "AA00" * 250_000):
        pii_rules.find(text)


def test_query_against_plain_patterns(spark):
    got = plain(QUERIES["op13_personal_data"](spark, "/root/testdata/sf0.001"))
    assert [r[:6] for r in got] == sorted(expected(r["doc_id"], r["text"]) for r in documents(spark).collect())
    assert sum(sum(r[1:5]) for r in got) > 10


def test_messy_and_empty_tables(spark):
    more = [(30, "é a@b.cd and 10.0.0.256 then 10.0.0.255"), (30, "é a@b.cd and 10.0.0.256 then 10.0.0.255"), (None, "+49 30 123456 7"), (31, "9" * 5000 + ".1.1.1")]
    table = messy(spark, more)
    rows = find_personal_data(table).select("row.doc_id", "row.text", "row.mark", "spans").collect()
    assert len(rows) == 4 and all([tuple(s)[:3] for s in r["spans"]] == brute(r["text"]) for r in rows if r["doc_id"] != 31)
    assert sorted(str(r["doc_id"]) for r in redact(table).where("text like '%[email]% then [ip]'").collect()) == ["30", "30"]
    clean = redact(messy(spark))
    assert clean.columns == messy(spark).columns and clean.where("text is null").count() == 1
    assert find_personal_data(empty(spark)).count() == redact(empty(spark)).count() == 0


