"""Every kind of personal value there and back, values of a kind staying different, formats kept."""

import random
import re
from datetime import date, timedelta

import pytest

from ledgerloom.llm import pseudonym


def luhn(body):
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(body)))
    return body + str(-total % 10)


def values(rnd):
    day = lambda: date(1800, 1, 1) + timedelta(rnd.randrange(146_097))
    late = lambda: (d if (d := day()).day > 12 else late())
    return {
        "ssn": lambda: f"{rnd.choice([1, 665, 667, 899, rnd.randint(100, 600)]):03}-{rnd.randint(1, 99):02}-{rnd.randint(1, 9999):04}",
        "date": lambda: rnd.choice([day().strftime("%Y-%m-%d"), day().strftime("%m/%d/%Y"), day().strftime("%d.%m.%Y"), late().strftime("%d/%m/%Y"), "29/02/2020", "29/02/1904"]),
        "ip": lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4)),
        "phone": lambda: rnd.choice([f"({rnd.randint(200, 999)}) {rnd.randint(200, 999)}-{rnd.randint(1000, 9999)}", f"+{rnd.randint(1, 99)} {rnd.randint(10, 99)} {rnd.randint(1000, 9999)} {rnd.randint(1000, 9999)}"]),
        "card": lambda: luhn("4" + "".join(rnd.choice("0123456789") for _ in range(14))),
        "email": lambda: "".join(rnd.choice("abcXYZ019._") for _ in range(8)).strip("._") + "q@example.org",
        "secret": lambda: "a1" + "".join(rnd.choice("0123456789abcdef") for _ in range(38)),
    }


@pytest.mark.parametrize("kind", ["ssn", "date", "ip", "phone", "card", "email", "secret"])
def test_kind_there_and_back(spark, kind):
    rnd = random.Random(kind)
    found = sorted({values(rnd)[kind]() for _ in range(150)})
    rows = [(k, f"see {v} there", "m", 5) for k, v in enumerate(found + found[:5])] + [(900, None, "m", 5), (901, "", "m", 5), (902, f"{found[0]} {found[1]} and {found[2]}", "m", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, n_values int")
    made = pseudonym.pseudonymise(docs, "k").persist()
    assert {r.doc_id: r.text for r in pseudonym.restore(made, "k").collect()} == {r[0]: r[1] for r in rows}
    got = {r.doc_id: r for r in made.collect()}
    assert all(v.kind == kind for r in got.values() for v in r["values"])
    new = [got[k].text[4:-6] for k in range(len(found))]
    assert len(set(new)) == len(found) and sum(a != b for a, b in zip(new, found, strict=True)) > 0.9 * len(found)
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t)))
    assert kind in ("ip", "secret") or [shape(x) for x in new] == [shape(x) for x in found]
    assert got[902].text == f"{new[0]} {new[1]} and {new[2]}" and [got[len(found) + k].text for k in range(5)] == [f"see {x} there" for x in new[:5]]
    if kind == "date":
        assert all(date(int(x[6:]), int(x[3:5]), int(x[:2])).day > 12 for x, v in zip(new, found, strict=True) if v[2] == "/" and int(v[:2]) > 12)
    made.unpersist()


def test_small_domain_is_permuted(spark):
    """Every leap day gets another, and all days after the twelfth of one year stay apart."""
    leap = [f"29/02/{y}" for y in range(1800, 2200) if date(y, 12, 31).timetuple().tm_yday == 366]
    rest = [d.strftime("%d/%m/%Y") for k in range(365) if (d := date(2021, 1, 1) + timedelta(k)).day > 12]
    docs = spark.createDataFrame(list(enumerate(leap + rest)), "doc_id int, text string")
    got = [r.text for r in pseudonym.pseudonymise(docs, "k").orderBy("doc_id").collect()]
    assert sorted(got[: len(leap)]) == sorted(leap) and len(set(got)) == len(got)
