import duckdb
import pytest

from gavelwork.llm import license_scan, pii
from gavelwork.llm.queries import QUERIES, SQL
from tests.conftest import SF
from tests.llm.helpers import ROWS, empty, hard
from tools.compare import rows_of

KEY = b"0123456789abcdef"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, cursor.fetchall())


def brute(text):
    found = []
    for name, body in license_scan.TEMPLATES:
        own, other = set(license_scan.template_bigrams(text)), set(license_scan.template_bigrams(body))
        found.append((-2 * len(own & other) / (len(own) + len(other)) if own else 0, name))
    score, name = min(found)
    return (name, -score) if -score >= license_scan.THRESHOLD else None


def test_units_are_matched_like_brute_force(spark):
    texts = [
        "intro\nReleased under the MIT License.\nend", "LICENSED under the Apache-License;\n version 2.0", "Licensed under CC BY 4.0.",
        "Licensed under CC BY-NC 4.0 now", "nothing here", "the the the the", license_scan.TEMPLATES[3][1].replace(", ", ",\n"),
        "x\n\n" + license_scan.TEMPLATES[7][1].replace(". ", ".\n") + "\n \n tail", "of the\n" * 300, "mit license " * 5000,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["unit"], r["place"]): (r["license"], r["dice"]) for r in license_scan.scan(docs).collect()}
    want = {}
    for i, text in enumerate(texts):
        for place, line in enumerate(text.split("\n")):
            want[i, "line", place] = brute(line)
        if "\n" in text:
            want[i, "text", 0] = brute(text)
    assert {k: v for k, v in got.items() if k[1] != "paragraph"} == {k: v for k, v in want.items() if v}
    assert got[7, "paragraph", 1][0] == "GPL-3.0-or-later" and got[6, "text", 0][0] == "MIT"
    assert license_scan.scan(empty(spark)).count() == 0 and license_scan.scan(hard(spark)).count() == 0


@pytest.mark.parametrize("kind,value", [
    ("date", "2024-02-29"), ("date", "31/12/1999"), ("date", "12/11/1999"), ("date", "1.2.2020"), ("date", "31.1.2020"),
    ("card", "4111-1111-1111-1111"), ("card", "4111111111111111"), ("ssn", "123-45-6789"), ("ssn", "667-01-0001"), ("ip", "1.2.3.4"),
    ("iban", "GB82 WEST 1234 5698 7654 32"), ("email", "a.B9@x.com"), ("phone", "+1 (017) 555-7713"), ("phone", "+4915112345678"),
])
def test_pseudonym_keeps_the_format_and_can_be_undone(kind, value):
    new = pii.pseudonym(kind, value, KEY)
    assert new != value and pii.pseudonym(kind, new, KEY, back=True) == value
    if kind != "ip":  # its numbers have one to three digits each
        assert [c if not c.isalnum() else "9" for c in new] == [c if not c.isalnum() else "9" for c in value]
    assert pii.pseudonymiser(KEY)(f"see {value}, ok")[0] == f"see {new}, ok"
    assert pii.pseudonym(kind, value, b"other key") != new


@pytest.mark.parametrize("text", [
    "4111111111111112", "300.1.1.1", "2024-02-30", "000-12-3456", "version 1.2.3", "GB00 WEST 1234 5698 7654 32", "1/2", "token f3ef4d6b2755111111119",
    "0000000000000000", "a@b", "99/99/2020", "1.2.3.4.5",
])
def test_what_is_not_valid_stays(text):
    assert pii.pseudonymiser(KEY)(text) == (text, [])


@pytest.mark.parametrize("text,kind,value", [
    ("4111 1111 1111 1111 123", "card", "4111 1111 1111 1111"), ("4111 1111 1111 1111 12/27", "card", "4111 1111 1111 1111"),
    ("4111-1111-1111-1111-123", "card", "4111-1111-1111-1111"), ("ref 1234 4111 1111 1111 1111", "card", "4111 1111 1111 1111"),
    ("AT61 1904 3002 3457 3201 BIC OPSKATWW", "iban", "AT61 1904 3002 3457 3201"),
    ("GB82 WEST 1234 5698 7654 32 ABC", "iban", "GB82 WEST 1234 5698 7654 32"),
    ("+49 151 1234 5678 2024", "phone", "+49 151 1234 5678"),
])
def test_values_before_other_digits_and_capitals(text, kind, value):
    new = pii.pseudonym(kind, value, KEY)
    assert pii.pseudonymiser(KEY)(text) == (text.replace(value, new), [kind])


@pytest.mark.parametrize("size", [1, 2, 3, 10, 1000, 4097])
def test_permutation(size):
    assert sorted(pii.permute(i, size, KEY, "x") for i in range(size)) == list(range(size))
    assert all(pii.permute(pii.permute(i, size, KEY, "x"), size, KEY, "x", True) == i for i in range(size))


def test_values_stay_linked_across_documents(spark):
    rows = [(1, "call +1 (017) 555-7713 now"), (2, "again +1 (017) 555-7713"), (3, "other +1 (017) 555-7714"), (4, None), (5, "")]
    got = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    assert got[1]["text"].split("call ")[1][:17] == got[2]["text"].split("again ")[1]
    assert got[2]["text"][6:] != got[3]["text"][6:] and got[1]["pii"]["phone"] == 1
    assert got[4]["text"] is None and got[5]["text"] == "" and got[4]["pii"]["phone"] == 0
    changed = pii.pseudonymise(hard(spark), KEY)
    assert changed.columns == [*hard(spark).columns, "pii"] and changed.count() == len(ROWS)
    assert pii.pseudonymise(empty(spark), KEY).count() == 0
