import calendar
import random
import re

import pytest
from fixtures import SF_DIR, clashing, frame, odd_rows

from hushlog.llm.feistel import (
    FIRST_DAY,
    changed,
    iban,
    luhn_digit,
    permute,
    pseudonymised,
    with_pseudonyms,
)
from hushlog.llm.queries import op2_pseudonyms

KEY = b"test key"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutations(size):
    for make in (permute, changed):
        images = [make(i, size, KEY, "t") for i in range(size)]
        assert sorted(images) == list(range(size))
        assert [make(i, size, KEY, "t", True) for i in images] == list(range(size))
    assert size == 1 or all(changed(i, size, KEY, "t") != i for i in range(size))
    big = 10**30 + size
    assert permute(permute(size, big, KEY, "t"), big, KEY, "t", True) == size


def check_digits(country, account):
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def samples(pick):
    digits = lambda n: "".join(pick.choice("0123456789") for _ in range(n))
    payload = "4" + digits(14)
    day = FIRST_DAY.fromordinal(FIRST_DAY.toordinal() + pick.randrange(73049))
    account = "".join(pick.choice("ABZ") for _ in range(4)) + digits(14)
    bank = f"GB{check_digits('GB', account)}{account}"
    return {
        "email": f"a{digits(3)}.Bc@mail{digits(1)}.example.com",
        "card": payload + luhn_digit(payload),
        "phone": f"+1 ({pick.randint(200, 999)}) {pick.randint(200, 999)}-{digits(4)}",
        "ip": ".".join(str(pick.randrange(256)) for _ in range(4)),
        "social": f"{pick.choice([1, 665, 667, 899]):03d}-{pick.randint(1, 99):02d}-{pick.randint(1, 9999):04d}",
        "access_key": "AKIA" + "".join(pick.choice("ABCXYZ0189") for _ in range(16)),
        "iban": bank,
        "date": day.isoformat(),
        "secret": "f8cb0ab732d2" + digits(6),
    }


def test_pseudonyms_keep_formats_and_turn_back():
    pick = random.Random(2)
    seen = {}
    for _ in range(60):
        for kind, value in samples(pick).items():
            front = "password=" if kind == "secret" else "see "
            text = f"Dear x,\n{front}{value}, and {front}{value}. End"
            new, places = pseudonymised(text, KEY)
            assert [p[0] for p in places] == [kind, kind], (kind, value)
            first, second = (new[a:b] for _, a, b in places)
            assert first == second != value and value not in new
            assert [re.sub(r"\d", "0", c) for c in first if not c.isalnum()] == [c for c in value if not c.isalnum()]
            assert len(first) == len(value) or kind == "ip"
            assert seen.setdefault((kind, first), value) == value
            assert pseudonymised(new, KEY, back=True)[0] == text
            if kind == "card":
                assert luhn_digit(first[:-1]) == first[-1] and first[0] == "4"
            if kind == "iban":
                assert iban(first, KEY, False) is not None and first[:2] == "GB"
            assert pseudonymised(text, b"other")[0] != new


def test_dates_in_all_forms_are_linked():
    text = "2024-02-29 02/29/2024 29.02.2024 29 February 2024 February 29, 2024 2024/02/29"
    new, _ = pseudonymised(text, KEY)
    days = set()
    for m in re.finditer(r"(\d{4})[-/](\d\d)[-/](\d\d)", new):
        days.add(m.groups())
    (year, month, day) = days.pop()
    assert not days and f"{month}/{day}/{year} {day}.{month}.{year}" in new
    assert f"{calendar.month_name[int(month)]} {int(day):02d}, {year}" in new
    late, _ = pseudonymised("on 29/02/2024", KEY)
    assert 13 <= int(late[3:5]) <= 31 and pseudonymised(late, KEY, True)[0] == "on 29/02/2024"


def test_what_fails_its_check_stays():
    text = (
        "4111111111111112 1.2.3.4.5 256.1.1.1 000-12-1234 666-12-1234 123-00-1234 2024-02-30 31/31/2024 "
        "GB00 WEST 1234 5698 7654 32 version 12-15 version 2.0. CC BY-NC 4.0, token = none, 12345"
    )
    assert pseudonymised(text, KEY) == (text, [])


def test_query_leaves_no_value_and_clean_texts_alone(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = op2_pseudonyms(spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == set(texts)
    private = re.compile(
        r"[\w.]+@[\w.]+|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\d)\d{16}(?!\d)|\d+\.\d+\.\d+\.\d+|AKIA\w{16}"
        r"|password=\w+|token = \"\w+\""
    )
    valid = lambda v: not v.isdigit() or luhn_digit(v[:-1]) == v[-1]
    linked = {}
    for r in rows:
        old, new = (list(filter(valid, private.findall(t))) for t in (texts[r.doc_id], r.text))
        assert len(old) == len(new) == r.n_pii
        assert all(value not in r.text for value in old)
        assert private.sub("", texts[r.doc_id]) == private.sub("", r.text)
        for a, b in zip(old, new):
            assert linked.setdefault(a, b) == b
    assert linked


def test_odd_rows(spark):
    rows = odd_rows() + [(9, "ip 10.1.2.3 " * 3000, None, None, None)]
    docs = clashing(frame(spark, rows), "PII", "kind")
    got = with_pseudonyms(docs, KEY)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "kind", "pii"]
    done = got.collect()
    assert len(done) == len(rows)
    assert sorted(len(r.pii) for r in done)[-2:] == [0, 3000]
    assert sorted(str(r.text) for r in done if not r.pii) == sorted(str(r[1]) for r in rows[:-1])
    assert sorted(r.text for r in with_pseudonyms(got.drop("pii"), KEY, back=True).where("doc_id = 9").collect()) == [rows[-1][1]]
    assert with_pseudonyms(docs.limit(0), KEY).collect() == []
