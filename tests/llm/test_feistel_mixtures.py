import datetime
import itertools
import random

import pytest
from fixtures import clashing, frame

from hushlog.llm import feistel
from hushlog.llm.feistel import pseudonymised, with_pseudonyms

KEY = b"a key for made-up documents only"


def there_and_back(text):
    new, places = pseudonymised(text, KEY)
    old, _ = pseudonymised(new, KEY, back=True)
    assert old == text, (text, new, old)
    return new, places


def spellings(day):
    y, m, d = day.year, day.month, day.day
    for a, b in itertools.product((str(m), f"{m:02d}"), (str(d), f"{d:02d}")):
        yield f"{a}/{b}/{y}", "/", (1, 0, 2)
        yield f"{b}.{a}.{y}", ".", (0, 1, 2)
        yield f"{y}-{a}-{b}", "-", (2, 1, 0)
        if d > 12:
            yield f"{b}/{a}/{y}", "/", (0, 1, 2)


def test_every_spelling_of_a_date_is_found_linked_and_turned_back():
    rng = random.Random(2)
    for _ in range(1500):
        day = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73_049))
        seen = set()
        for text, sep, order in spellings(day):
            new, places = there_and_back(text)
            assert [p[0] for p in places] == ["date"] and new != text and len(new) == len(text)
            numbers = [int(n) for n in new.split(sep)]
            seen.add(tuple(numbers[i] for i in order))
        named = there_and_back(f"{day.day} {feistel.MONTHS[day.month - 1]} {day.year}")[0].split()
        seen.add((int(named[0]), feistel.MONTHS.index(named[1]) + 1, int(named[2])))
        assert len(seen) == 1


@pytest.mark.parametrize("text", ["31/4/1990", "29.2.1900", "0/5/1990", "2000-13-01", "1899-12-31", "00.00.2000"])
def test_no_dates(text):
    assert there_and_back(text)[0] == text


def digits(rng, n):
    return "".join(rng.choice("0123456789") for _ in range(n))


def value(rng):
    kind = rng.randrange(12)
    if kind < 3:
        d = [str(rng.randrange(1, 13)), str(rng.randrange(1, 32))]
        rng.shuffle(d)
        sep = rng.choice("/.-")
        return sep.join([*[x.zfill(rng.choice((1, 2))) for x in d], str(rng.randrange(1900, 2100))])
    if kind < 6:
        return digits(rng, rng.choice((1, 2, 3, 4, 9, 10, 13, 16)))
    if kind == 6:
        return f"{digits(rng, 3)}-{digits(rng, 2)}-{digits(rng, 4)}"
    if kind == 7:
        body = digits(rng, 15)
        return " ".join((body + feistel.luhn_digit(body))[i : i + 4] for i in range(0, 16, 4))
    if kind == 8:
        return ".".join(str(rng.randrange(300)) for _ in range(4))
    if kind == 9:
        return f"+{rng.choice('123456789')}{digits(rng, 1)} {digits(rng, 3)} {digits(rng, rng.choice((3, 4)))}"
    if kind == 10:
        return rng.choice(("password: ", "token=")) + "".join(rng.choice("aZ1!&-_/") for _ in range(rng.randrange(4, 12)))
    return f"{digits(rng, 3)} {digits(rng, 3)}-{digits(rng, 4)}"


def test_random_mixtures_neither_crash_nor_fail_to_turn_back():
    rng = random.Random(7)
    for _ in range(12_000):
        there_and_back(rng.choice((" ", " ", ", ", "-", "/")).join(value(rng) for _ in range(rng.randrange(1, 5))))


def test_a_number_beside_another_stays_apart():
    rng = random.Random(5)
    alone = {}
    for _ in range(1000):
        number = f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10_000):04d}"
        new, places = there_and_back(f"{digits(rng, 9)} {number}")
        assert [p[0] for p in places] == ["social"]
        alone[number] = pseudonymised(number, KEY)[0]
        assert new.endswith(alone[number])


def test_known_keys_are_linked_inside_and_outside_assignments():
    rng = random.Random(6)
    for prefix, n in (("ghp_", 36), ("AKIA", 16), ("sk-", 30)):
        bare = prefix + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n - 1)) + "7"
        new = there_and_back(bare)[0]
        assert new.startswith(prefix) and new != bare
        assert there_and_back(f"token: {bare}")[0] == f"token: {new}"


@pytest.mark.parametrize("text", ["password=abc123!xyz9", "pwd: Tr0ub4dor&3", 'secret: "p4ssw0rd wörd"', "token='a+b/c=1234'"])
def test_secrets_go_to_their_end(text):
    new, places = there_and_back(text)
    (kind, start, end) = places[0]
    assert kind == "secret" and new[:start] == text[:start] and new[end:] in ("", '"', "'", ' wörd"')
    assert all(a != b or not a.isalnum() for a, b in zip(new[start:end], text[start:end])) or new[start:end] != text[start:end]


def test_own_columns_stay(spark):
    docs = clashing(frame(spark, [(1, "call 212 555 0100")]), "_new_text", "_text0", "pii")
    row = with_pseudonyms(docs, KEY).collect()[0]
    assert (row["_new_text"], row["_text0"]) == ("own", "own") and row.text != "call 212 555 0100"
