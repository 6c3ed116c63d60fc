import datetime
import random
import re

import pytest

from rinseframe.llm import pii as op
from rinseframe.llm import queries
from tests.llm.helpers import FOLDER, SCHEMA, documents, odd

KEY = "a key"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def run(spark, texts, key=KEY):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    return [r for r in op.pseudonymize(docs, key).orderBy("doc_id").collect()]


def card(rng, n=16):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def test_each_kind_stays_valid_in_its_form(spark):
    rng = random.Random(3)
    day = datetime.date(1800, 1, 1)
    values = {
        "card": [card(rng, n) for n in (13, 15, 16, 19) for _ in range(30)],
        "phone": [f"+1 ({rng.randrange(200, 1000)}) {rng.randrange(200, 1000)}-{rng.randrange(10000):04d}" for _ in range(60)],
        "ssn": [f"{rng.choice([1, 7, 665, 667, 899]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}" for _ in range(60)],
        "ip": [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(60)],
        "date": [(day + datetime.timedelta(rng.randrange(146_097))).isoformat() for _ in range(60)],
        "email": [f"ab{i}.Cd+{i}@mail{i}.example.com" for i in range(40)],
    }
    forms = {
        "card": r"\d+", "phone": r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", "ssn": r"\d{3}-\d\d-\d{4}", "ip": r"\d+(\.\d+){3}",
        "date": r"\d{4}-\d\d-\d\d", "email": r"[a-z]{2}\d+\.[A-Z][a-z]\+\d+@mail\d+\.example\.com",
    }
    for kind, originals in values.items():
        rows = run(spark, [f"see {v}, again {v}." for v in originals])
        seen = {}
        for v, r in zip(originals, rows, strict=True):
            assert r[f"n_{kind}"] == 2, (kind, v, r)
            m = re.fullmatch(r"see (.*), again (.*)\.", r.text)
            assert m[1] == m[2] and re.fullmatch(forms[kind], m[1]) and len(m[1]) == len(v) or kind == "ip"
            seen[v] = m[1]
            if kind == "card":
                assert luhn(m[1]) and m[1][0] == v[0]
            if kind == "ip":
                assert all(int(x) < 256 for x in m[1].split("."))
            if kind == "ssn":
                area, group, serial = m[1].split("-")
                assert area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
            if kind == "date":
                datetime.date.fromisoformat(m[1])
        assert len(set(seen.values())) == len(seen), kind
        assert sum(a != b for a, b in seen.items()) > 0.9 * len(seen)


def test_the_permutation_reaches_every_value_once(spark):
    from pyspark.sql import functions as F

    grid = spark.range(12 * 9).select((F.col("id") / 9).cast("bigint").alias("x"), (F.col("id") % 9).alias("y"))
    out = grid.select(op._permuted("k", "test", F.col("x"), F.col("y"), F.lit(12), F.lit(9)).alias("p")).select("p.l", "p.r").collect()
    assert sorted((r.l, r.r) for r in out) == [(x, y) for x in range(12) for y in range(9)]


def test_links_hold_across_forms_and_documents_and_keys_differ(spark):
    v = "4465758382889437"
    a, b, c = (r.text for r in run(spark, [v, f"x {v[:4]}-{v[4:8]}-{v[8:12]}-{v[12:]}", "1984-02-29 and 29.02.1984"]))
    assert re.sub(r"\D", "", b) == a
    one, other = c.split(" and ")
    assert other == ".".join(reversed(one.split("-")))
    assert run(spark, [v], "another")[0].text != a


@pytest.mark.parametrize("text", ["4465758382889438", "999.1.1.1", "1984-02-30", "666-12-1234", "000-12-1234", "2.0. and 3.", "12345", "7" * 60, "1.2.3.4.5", "31/02/2000", "2200-01-01", "@home a@b"])
def test_what_is_not_valid_stays(spark, text):
    assert run(spark, [text])[0].text == text


def test_phones_with_any_area_code(spark):
    rng = random.Random(5)
    old = ["+1 (017) 555-7713", "+1 (132) 555-1352", "017-155-7713", "+10171557713"]
    old += [f"+1 ({rng.randrange(1000):03d}) {rng.randrange(1000):03d}-{rng.randrange(10000):04d}" for _ in range(60)]
    rows = run(spark, [f"call {v}." for v in old])
    new = [r.text[5:-1] for r in rows]
    assert all(r.n_phone == 1 for r in rows) and all(a != b for a, b in zip(old, new, strict=True))
    assert [re.sub(r"\d", "0", v) for v in new] == [re.sub(r"\d", "0", v) for v in old]
    assert re.sub(r"\D", "", new[2]) == new[3][2:]
    assert len({re.sub(r"\D", "", v)[-10:] for v in new}) == len({re.sub(r"\D", "", v)[-10:] for v in old})


CARD = "4111 1111 1111 1111"


@pytest.mark.parametrize(
    ("before", "card", "after"),
    [
        ("", CARD, " 12/25"), ("", CARD, " 123"), ("No. 7 ", CARD.replace(" ", "-"), ""), ("7 ", CARD, " 123 and more"), ("12-34 ", CARD.replace(" ", ""), " 99"),
        ("1 2 3 ", "3782 822463 10005", " 4 5"), ("a ", CARD, " 10.5"),
    ],
)
def test_cards_beside_other_digits(spark, before, card, after):
    alone, row = run(spark, [card, before + card + after])
    assert alone.n_card == row.n_card == 1 and alone.text != card
    assert row.text == before + alone.text + after


def test_two_cards_and_other_kinds_in_one_run_of_digits(spark):
    parts = [CARD, "5500 0000 0000 0004", "123-45-6789", "555-123-4567", "12 34", "2024-12-25", "+49 30 123456", CARD]
    *alone, row = run(spark, [*parts, " ".join(parts)])
    assert row.text == " ".join(r.text for r in alone)
    assert (row.n_card, row.n_ssn, row.n_phone, row.n_date) == (3, 1, 2, 1)


def test_dates_in_all_their_forms(spark):
    forms = ["2024-12-25", "25.12.2024", "25/12/2024", "12/25/2024", "2024/12/25", "25-12-2024"]
    rows = run(spark, forms)
    assert all(r.n_date == 1 for r in rows)
    new = datetime.date.fromisoformat(rows[0].text)
    assert [r.text for r in rows] == [new.strftime(f) for f in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d-%m-%Y")]
    short = run(spark, ["5/4/2024", "05/04/2024", "2024-4-5", "1/31/1999", "01/31/1999"])
    assert all(r.n_date == 1 for r in short)
    read = [tuple(map(int, re.split("[/-]", r.text))) for r in short]
    assert read[0] == read[1] == read[2][::-1] and read[3] == read[4] and read[3][1] > 12
    assert not any(re.search(r"(?<!\d)0", r.text) for r in (short[0], short[2], short[3]))


def test_the_calendar_is_permuted_once(spark):
    from pyspark.sql import functions as F

    days = spark.range(146_097).select(F.date_add(F.lit(op._FIRST_DAY).cast("date"), F.col("id").cast("int")).alias("d"))
    new = days.select("d", op._date(KEY, F.date_format("d", "yyyy-MM-dd")).cast("date").alias("n"))
    row = new.agg(F.count_distinct("n"), F.min("n"), F.max("n"), F.sum(((F.dayofmonth("n") > 12) != (F.dayofmonth("d") > 12)).cast("int"))).first()
    assert tuple(map(str, row)) == ("146097", "1800-01-01", "2199-12-31", "0")


def test_given_documents(spark):
    before = {r.doc_id: r.text for r in documents(spark).collect()}
    emails, cards = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]*\w"), re.compile(r"(?<!\d)\d{13,19}(?!\d)")
    changed, mapped = 0, {}
    for r in op.pseudonymize(documents(spark), KEY).collect():
        old = before[r.doc_id] or ""
        changed += old != (r.text or "")
        found = cards.findall(old)
        assert len(found) >= r.n_card and sum(map(luhn, found)) == r.n_card
        assert r.n_email == len(emails.findall(old))
        for x, y in zip(emails.findall(old), emails.findall(r.text or ""), strict=True):
            assert mapped.setdefault(x, y) == y
        if old == r.text:
            assert not any(r[f"n_{k}"] for k in op.KINDS)
    assert changed > 3


def test_odd_and_empty_tables(spark):
    rows = op.pseudonymize(odd(spark).selectExpr("*", "'mine' AS n_card"), KEY)
    assert rows.columns.count("n_card") == 1
    by = {r.doc_id: r for r in rows.collect()}
    assert len(by) == 7 and by[2].text is None and by[3].text == "" and by[6].text == odd(spark).where("doc_id = 6").first().text
    assert op.pseudonymize(odd(spark).limit(0), KEY).count() == 0


def test_plan_is_native_and_moves_nothing(spark):
    from tests.oracle import plan_text

    plan = plan_text(queries.op5_pii(spark, FOLDER))
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
