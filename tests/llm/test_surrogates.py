import re

import pytest
from pyspark.sql import functions as F

from confab.llm import surrogates

SF = "/root/testdata/sf0.01"


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = by_id(surrogates.report(docs, "k"))
    mail, phone = re.compile(surrogates.KINDS["email"]), re.compile(surrogates.KINDS["phone"])
    ip, secret = re.compile(surrogates.KINDS["ip"]), re.compile(surrogates.KINDS["secret"])
    found, swaps = 0, {}
    for i, text in before.items():
        out = after[i].text
        cards = lambda t: [m for m in re.findall(surrogates.KINDS["card"], t) if luhn(re.sub(r"\D", "", m))]
        for find in (mail.findall, phone.findall, ip.findall, secret.findall, cards):
            old, new = find(text), find(out)
            assert len(old) == len(new), (i, old, new)
            for a, b in zip(old, new):
                assert a != b and a not in out
                assert swaps.setdefault(a, b) == b  # one entity, one surrogate everywhere
            found += len(old)
        if not after[i].n_found:
            assert out == text
    assert found > 60 and len(set(swaps.values())) == len(swaps) and not set(swaps.values()) & set(swaps)


def test_names_format_gender_and_mentions(spark):
    text = ("Mrs. Anna Schmidt met Mr. Smith. Anna called SMITH at +1 (743) 555-3824 or +1 743 555 3824. Card 4785 3805 9239 1139 or 4785-3805-9239-1139, not 4785380592391138. "
            "Госпожа is no title, but госпожа Анна Петрова is named. Petrova stays. SSN 123-45-6789, IBAN DE89 3704 0044 0532 0130 00, DNI 12345678Z.")
    card = "4111 1111 1111 1111"
    df = spark.createDataFrame([(1, text), (2, f"Dr. Schmidt and {card}"), (3, "Schmidt alone"), (4, card.replace(" ", "-"))], "doc_id long, text string")
    out = by_id(surrogates.pseudonymise(df, "k1"))
    t = out[1].text
    assert not re.search(r"Schmidt|Smith|SMITH|555|4785|3704|12345678|123-45|Петрова", t.replace("4785380592391138", "")) and "4785380592391138" in t and "Petrova stays" in t
    one = re.search(r"Mrs\. (\w+) (\w+) met Mr\. (\w+)\. (\w+) called (\w+) at", t)
    assert one[1] == one[4] and one[3].upper() == one[5] and one[1].lower().endswith(surrogates.ENDINGS["latin"]["f"])
    a, b = re.search(r"at (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1 \d{3} \d{3} \d{4})\.", t).groups()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b)
    assert re.search(r"госпожа [а-я]+ [а-я]+ is named", t, re.I) and re.search(r"SSN \d{3}-\d\d-\d{4}, IBAN DE\d\d( \d{4}){4} \d\d, DNI \d{8}[A-Z]\.", t)
    c = re.search(r"Dr\. (\w+) and (4\d{3}( \d{4}){3})", out[2].text)
    assert c[1] == one[2] and c[2].replace(" ", "-") == out[4].text and luhn(re.sub(r"\D", "", c[2])) and out[3].text == "Schmidt alone" and out[3].n_found == 0
    other = by_id(surrogates.pseudonymise(df, "k2"))
    assert other[1].text != t and by_id(surrogates.pseudonymise(df, "k1"))[1].text == t


def test_collisions_are_settled(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "SYLLABLES", {s: ("ba", "be") for s in surrogates.SYLLABLES})
    names = [f"Name{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    df = spark.createDataFrame([(i, f"Mr. {n} and Mrs. Babasson") for i, n in enumerate(names)], "doc_id long, text string")
    out = [re.fullmatch(r"Mr\. (\w+) and Mrs\. (\w+)", r.text) for r in surrogates.pseudonymise(df, "k").collect()]
    made = {m[1] for m in out} | {m[2] for m in out}
    assert len({m[2] for m in out}) == 1 and len(made) == 201 and "Babasson" not in made and not made & set(names)


@pytest.mark.parametrize("draws", [0])
def test_edges(spark, draws):
    rows = [(1, None), (2, ""), (3, "a@b.example.com " * 5000), (3, "a@b.example.com " * 5000), (None, "x a@b.example.com"), (4, "x" * 100_000), (5, "300.1.1.1 1.2.3.4.5 +1 12")]
    df = spark.createDataFrame([(*r, 9, "s", {"k": "v"}) for r in rows], "doc_id long, text string, n_found int, swaps string, text_key map<string,string>")
    full = surrogates.pseudonymise(df, "k")
    assert full.columns == ["doc_id", "text", "swaps", "text_key", "n_found"]
    got = full.collect()
    assert sorted(r.n_found for r in got) == [0, 0, 0, 0, 1, 5000, 5000]
    same = {re.findall(r"\S+@\S+", r.text)[0] for r in got if r.text and "@" in r.text}
    assert len(same) == 1 and "a@b.example.com" not in same
    assert {r.text for r in got if r.doc_id in (1, 2, 4, 5)} == {None, "", "x" * 100_000, rows[-1][1]}
    assert surrogates.report(df.where(F.lit(False)), "k").count() == 0


def iban_ok(text):
    turned = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in turned[4:] + turned[:4])) % 97 == 1


def test_short_phones_and_check_digits(spark):
    """Planted entities, found again by patterns written here."""
    phones = [f"+7 10 {a:02d} {b:02d}" for a in range(30, 60) for b in (56, 57)]
    rows = [(i, f"call {p} now") for i, p in enumerate(phones)]
    rows += [(100, "IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, DNI 12345678Z and 87654321X."), (101, "from 10.1.2.3 to 10.1.2.3")]
    out = by_id(surrogates.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k"))
    made = [re.fullmatch(r"call (\+\d \d\d \d\d \d\d) now", out[i].text)[1] for i in range(len(phones))]
    assert len(set(made)) == len(phones) and not set(made) & set(phones)
    ibans = re.findall(r"DE\d\d(?: \d{4}){4} \d\d|GB\d\d[A-Z]{4}\d{14}", out[100].text)
    assert len(ibans) == 2 and all(map(iban_ok, ibans)) and "3704" not in out[100].text and "WEST" not in out[100].text
    numbers = re.findall(r"(\d{8})([A-Z])\b", out[100].text)
    assert len(numbers) == 2 and all(letter == "TRWAGMYFPDXBNJZSQVHLCKE"[int(n) % 23] and n not in ("12345678", "87654321") for n, letter in numbers)
    a, b = re.fullmatch(r"from (\S+) to (\S+)", out[101].text).groups()
    assert a == b != "10.1.2.3"


def test_a_full_kind_grows(spark):
    """All four-digit endings of one number but a few are entities: their surrogates need another digit."""
    taken = [f"+1 23 {a:02d} {b:02d}" for a in range(10, 100) for b in range(0, 100, 2)]
    rows = [(i, f"call {p}") for i, p in enumerate(taken)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = surrogates.entity_table(spark.createDataFrame([("ssn", str(n)) for n in range(9, 0, -1)], "kind string, canon string"), "k").collect()
    assert len({r.surrogate for r in table}) == 9 and not {r.surrogate for r in table} & set("123456789")
    out = [r.text for r in surrogates.pseudonymise(df, "k").collect()]
    assert len(set(out)) == len(taken) and all(re.fullmatch(r"call \+\d \d\d \d\d \d\d+", t) for t in out)


def test_key_is_required(spark):
    df = spark.createDataFrame([(1, "a@b.org")], "doc_id long, text string")
    with pytest.raises(ValueError):
        surrogates.pseudonymise(df)
