import datetime
import re

from pyspark.sql import functions as F

from lintlake.llm import pseudonyms

SF = "/root/testdata/sf0.001"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban):
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


CASES = {
    "card": ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"],
    "ip": ["49.37.233.206", "0.0.0.0", "255.255.255.255"],
    "date": ["2024-02-29", "31.12.1999", "07/04/2021", "25/12/2020", "1900-01-01", "2099-12-31"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "email": ["fakol.33@mail7.example.com", "A.b-C_9@x.org", "z@y.de"],
    "phone": ["+1 (726) 555-7857", "+4930123456", "030 123 45678"],
}
LEFT = ["4111111111111112", "256.1.1.1", "2023-02-30", "31.04.2021", "13/13/2020", "1850-01-01", "DE89370400440532013001", "12345678", "1234567890123", "1.2.3", "v1.2.3.4.5"]


def valid(kind, m):
    digits = re.sub(r"\D", "", m)
    if kind == "card":
        return luhn(digits)
    if kind == "ip":
        return all(int(x) < 256 for x in m.split("."))
    if kind == "iban":
        return mod97(m) == 1
    if kind == "date":
        forms = {"-": ["%Y-%m-%d"], ".": ["%d.%m.%Y"], "/": ["%m/%d/%Y", "%d/%m/%Y"]}
        for form in forms[re.search(r"[-./]", m)[0]]:
            try:
                return 1900 <= datetime.datetime.strptime(m, form).year <= 2099
            except ValueError:
                pass
        return False
    return True


def shape(kind, m):
    if kind == "ip":
        return "ip"
    return re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "0", m)))


def texts(df):
    return {r.doc_id: r for r in df.collect()}


def test_pseudonyms_keep_format_and_come_back(docs_of):
    cases = [(kind, m) for kind in CASES for m in CASES[kind]]
    docs = docs_of({i: f"Call {m}, or {m}." for i, (_, m) in enumerate(cases)}).coalesce(2)
    new = pseudonyms.with_pseudonyms(docs)
    rows = texts(new)
    back = texts(pseudonyms.with_pseudonyms(new.drop(pseudonyms.KIND), undo=True))
    other = texts(pseudonyms.with_pseudonyms(docs, key="other"))
    for i, (kind, m) in enumerate(cases):
        row = rows[i]
        found = re.fullmatch(r"Call (.*), or (.*)\.", row.text)
        assert row[pseudonyms.KIND] == [kind, kind] and found[1] == found[2] and found[1] != m
        assert shape(kind, found[1]) == shape(kind, m) and valid(kind, found[1])
        if kind != "date" or "/" not in m:
            assert back[i].text == f"Call {m}, or {m}."
        assert other[i].text != row.text or len(m) < 8


def test_what_fails_its_check_stays(docs_of):
    docs = docs_of(dict(enumerate(LEFT)))
    for i, r in texts(pseudonyms.with_pseudonyms(docs)).items():
        assert r.text == LEFT[i] and r[pseudonyms.KIND] == []


def test_values_beside_other_words_are_found(docs_of):
    cases = [
        ("4111 1111 1111 1111", "{} 123", "card"), ("4111111111111111", "{} 12/25", "card"), ("378282246310005", "{} 1234", "card"), ("4111 1111 1111 1111", "12 {}", "card"),
        ("ES91 2100 0418 4502 0005 1332", "{} EUR", "iban"), ("DE89370400440532013000", "{} EUR", "iban"), ("ES9121000418450200051332", "{} 1234", "iban"),
        ("555.123.4567", "{}", "phone"), ("+1.555.123.4567", "({})", "phone"), ("+49 30 1234567", "{} 12345678", "phone"),
    ]
    rows = texts(pseudonyms.with_pseudonyms(docs_of({i: f"Pay {around.format(m)}." for i, (m, around, _) in enumerate(cases)})))
    for i, (m, around, kind) in enumerate(cases):
        found = re.fullmatch(r"Pay " + re.escape(around).replace(r"\{\}", "(.*)") + r"\.", rows[i].text)
        assert found and rows[i][pseudonyms.KIND] == [kind], (m, rows[i].text)
        assert found[1] != m and shape(kind, found[1]) == shape(kind, m) and valid(kind, found[1])


def test_long_names_have_no_clear_tail(docs_of):
    letters, digits = "abcdefghijklmnopqrst" + "secretname", "1" * 30 + "23456"
    docs = docs_of({1: f"{letters}@x.org", 2: f"a{digits}@x.org"})
    new = pseudonyms.with_pseudonyms(docs)
    rows = texts(new)
    assert "secretname" not in rows[1].text and len(rows[1].text) == len(letters) + 6
    assert "23456" not in rows[2].text and re.fullmatch(r"[a-z]\d{35}@x\.org", rows[2].text)
    back = texts(pseudonyms.with_pseudonyms(new.drop(pseudonyms.KIND), undo=True))
    assert [back[i].text for i in (1, 2)] == [f"{letters}@x.org", f"a{digits}@x.org"]


def test_feistel_is_a_permutation(spark):
    key = F.lit("k")
    df = spark.range(1000)
    three = df.select(pseudonyms.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), key, "x").alias("x")).collect()
    assert sorted(r.x for r in three) == [f"{i:03}" for i in range(1000)]
    two = spark.range(676).select(pseudonyms.permuted_letters(pseudonyms._as_letters(F.col("id"), F.lit(2)), key, "x").alias("x")).distinct().count()
    one = spark.range(10).select(pseudonyms.permuted_digits(F.col("id").cast("string"), key, "x").alias("x")).distinct().count()
    assert two == 676 and one == 10


def test_equal_values_are_linked(docs_of):
    rows = texts(pseudonyms.with_pseudonyms(docs_of({1: "4111 1111 1111 1111", 2: "x 4111-1111-1111-1111 y"})))
    assert re.sub(r"\D", "", rows[1].text) == re.sub(r"\D", "", rows[2].text) and rows[2].text.startswith("x 4")


def test_query_leaves_no_value_behind(spark, corpus):
    rows = texts(pseudonyms.query(spark, SF))
    total = 0
    for k, text in corpus.items():
        new = rows[k].text
        mails = re.findall(r"[\w.+-]+@[\w.-]+\w", text)
        ips = re.findall(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)", text)
        cards = [m for m in re.findall(r"(?<!\d)\d{13,19}(?!\d)", text) if luhn(m)]
        total += len(mails) + len(ips) + len(cards)
        assert not any(m in new for m in mails + ips + cards)
        if not re.search(r"\d", text):
            assert new == text
    assert total > 0


def test_edge_cases(docs_of):
    rows = [(1, None), (2, ""), (3, "4111111111111111"), (3, "4111111111111111"), (None, "no digits"), (4, "x" * 1_000_000 + "@"), (5, "1 " * 200_000), (6, "9" * 300_000)]
    out = pseudonyms.with_pseudonyms(docs_of(rows, found="int", parts="string", kind="string"))
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got[1] == [None] and got[2] == [""] and got[3][0] == got[3][1] != "4111111111111111" and got[None] == ["no digits"]
    assert got[4] == ["x" * 1_000_000 + "@"] and got[6] == ["9" * 300_000] and len(got[5][0]) == 400_000
    assert pseudonyms.with_pseudonyms(docs_of({})).collect() == []
