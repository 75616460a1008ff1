"""Pseudonyms against a plain Feistel network."""

import datetime
import hashlib
import re

import pytest

pytest.importorskip("weald.llm")

from pyspark.sql import functions as F

from tests.llm.data import DOCS, docs
from weald.llm import pii


def plain_text(s, key):
    left, right = s[: len(s) // 2], s[len(s) // 2 :]

    def shift(t, h):
        out = ""
        for i, c in enumerate(t):
            by = int(h[i % 64 * 2 : i % 64 * 2 + 2], 16)
            for lo, n in (("0", 10), ("a", 26), ("A", 26)):
                if c.isascii() and c.isalnum() and ord(lo) <= ord(c) < ord(lo) + n:
                    c = chr((ord(c) - ord(lo) + by) % n + ord(lo))
                    break
            out += c
        return out

    for r in range(1, pii.ROUNDS + 1):
        stream = lambda x: hashlib.sha512(f"{key}|{r}|{x}".encode()).hexdigest()  # noqa: E731, B023
        if r % 2 == 0:
            left = shift(left, stream(right))
        else:
            right = shift(right, stream(left))
    return left + right


def plain_pair(a, b, m, n, key):
    for r in range(1, pii.ROUNDS + 1):
        add = lambda x: int(hashlib.sha256(f"{key}|{r}|{x}".encode()).hexdigest()[:12], 16)  # noqa: E731, B023
        if r % 2 == 0:
            a = (a + add(b)) % m
        else:
            b = (b + add(a)) % n
    return a, b


def luhn_ok(s):
    return sum((int(c) * 2 - 9 * (c > "4")) if i % 2 else int(c) for i, c in enumerate(reversed(re.sub(r"\D", "", s)))) % 10 == 0


def change(spark, *texts, key="k"):
    return [r["text"] for r in pii.pseudonymise(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1), key).orderBy("i").collect()]


def test_values_follow_the_plain_network(spark):
    a, b, c, d, e, f = change(spark, "mail foo.Bar9@mail9.example.com.", "tel +1 (310) 555-4510, then", "ip 227.5.221.1.", "card 4316522678525456 end", "on 2024-02-29;", "ssn 123-45-6789")
    local = plain_text("foo.bar9", "k|email")
    assert a == f"mail {local[:4]}{local[4].upper()}{local[5:]}@mail9.example.com."
    n = plain_text("3105554510", "k|phone")
    assert b == f"tel +1 ({n[:3]}) {n[3:6]}-{n[6:]}, then"
    hi, lo = plain_pair(227 * 256 + 5, 221 * 256 + 1, 65536, 65536, "k|ip")
    assert c == f"ip {hi // 256}.{hi % 256}.{lo // 256}.{lo % 256}."
    assert d.split()[1][:15] == plain_text("431652267852545", "k|card") and luhn_ok(d.split()[1]) and len(d.split()[1]) == 16
    n = (datetime.date(2024, 2, 29) - datetime.date(1800, 1, 1)).days
    hi, lo = plain_pair(n // 773, n % 773, 189, 773, "k|date")
    assert e == f"on {datetime.date(1800, 1, 1) + datetime.timedelta(hi * 773 + lo)};"
    assert re.fullmatch(r"ssn (?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", f) and f != "ssn 123-45-6789"


def test_invalid_values_and_plain_texts_stay(spark):
    texts = ["card 4316522678525457", "ip 300.1.2.3", "on 2023-02-30", "ssn 666-12-1234", "version 1.2.3", "$5,000 in 1999", "", "a@b", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"']
    assert change(spark, *texts) == texts


def test_address_of_single_digits_alone_in_a_text(spark):
    alone, beside = change(spark, "dns 8.8.8.8", "12 and 8.8.8.8")
    hi, lo = plain_pair(8 * 256 + 8, 8 * 256 + 8, 65536, 65536, "k|ip")
    new = f"{hi // 256}.{hi % 256}.{lo // 256}.{lo % 256}"
    assert (alone, beside) == (f"dns {new}", f"12 and {new}")


def test_equal_values_stay_linked_and_different_ones_apart(spark):
    values = [f"+1 (310) 555-{i:04d}" for i in range(300)]
    out = change(spark, *(f"x {v} y {v}" for v in values), "4316522678525456 4316522678525456", "tel +1 (310) 555-0007 4316522678525456")
    pairs = [re.fullmatch(r"x (.*) y (.*)", t).groups() for t in out[:300]]
    assert all(a == b for a, b in pairs) and len({a for a, _ in pairs}) == 300
    card = out[300].split()
    assert card[0] == card[1] and out[301] == f"tel {pairs[7][0]} {card[0]}"
    assert change(spark, values[0], key="other") != change(spark, values[0])


def test_ways_of_writing_stay_linked(spark):
    digits = lambda t: re.sub(r"\D", "", t)
    cards = change(spark, "4316 5226 7852 5456", "4316-5226-7852-5456", "4316522678525456")
    assert len(set(map(digits, cards))) == 1 and cards[0] != "4316 5226 7852 5456" and [x.count("-") for x in cards] == [0, 3, 0]
    phones = change(spark, "(310) 555-4510", "310-555-4510", "+1 (310) 555-4510", "+1 310-555-4510")
    assert {digits(x)[-10:] for x in phones} == {digits(phones[0])} and phones[2].startswith("+1 (")
    mails = change(spark, "Foo@x.com", "foo@x.com", "FOO@x.com")
    assert len({m.lower() for m in mails}) == 1 and mails[0][0].isupper() and mails[1].islower()
    days = change(spark, "2024-02-29", "2024/02/29", "29.02.2024")
    assert days[0].replace("-", "/") == days[1] and days[2].split(".")[::-1] == days[0].split("-")


def test_very_long_texts_reach_the_patterns(spark):
    """A megabyte that each pattern has to look through, and repetitions that a recursive matcher would choke on."""
    size = 1_000_000
    texts = [x * (size // len(x)) for x in ("1", "12-", "1.2.", "a@", "a.b@c.", "+1 (310) ", "1234 ", "2024-02-", "(310)", "x" * 70 + "@y.com ")]
    texts += ["a@" + "b1." * 3000 + "com", "a@" + "b." * 300_000 + "com", "x" * size + "@x.com", "a@" + "b" * size + ".com", "9" * 20 + " " + "8.8.8.8 " * 100_000]
    out = change(spark, *texts)
    assert [len(a) > 0 for a in out] == [True] * len(texts) and out[:1] == texts[:1]
    again = change(spark, "4316522678525456 " * 20_000)
    assert len(set(again[0].split())) == 1 and again[0].split()[0] != "4316522678525456"


def test_key_comes_from_the_session(spark, tmp_path):
    docs(spark, [(1, "card 4316522678525456")]).write.parquet(str(tmp_path / "documents.parquet"))
    one = pii.op6_pii(spark, str(tmp_path)).collect()[0]["text"]
    spark.conf.set(pii.KEY_SETTING, "another")
    try:
        assert pii.op6_pii(spark, str(tmp_path)).collect()[0]["text"] != one
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_pairs_are_permuted(spark):
    got = spark.range(63).select(pii.permute_pair(F.floor(F.col("id") / 9), F.col("id") % 9, 7, 9, F.lit("k")).alias("s")).select("s.*").collect()
    assert {tuple(r) for r in got} == {(i, j) for i in range(7) for j in range(9)}


def test_awkward_rows(spark):
    df = docs(spark)
    got = pii.pseudonymise(df.withColumn("pii", F.lit(1)), "k")
    assert got.columns == [*df.columns, "pii"]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, DOCS))
    assert pii.pseudonymise(docs(spark, []), "k").count() == 0
