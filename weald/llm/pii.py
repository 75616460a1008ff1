"""Format-preserving Feistel pseudonyms for personal data, in DataFrame operations only.

Values are found by pattern, validated (card numbers by their check digit, addresses by their octets, dates by the
calendar, social security numbers by their ranges) and permuted within their format by a keyed Feistel network: a
bijection of the values of one format, so that equal values get equal pseudonyms in all documents and different values
different ones. What is permuted is the value without its separators, the country's prefix and capitals, which are put
back: a number gets the same pseudonym however it is written. What fails validation is left as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weald.llm.common import named, positional, table

#: Patterns of candidates, by kind; the first kind that fits at a place takes it. Addresses keep to the standard's lengths
#: (64 characters before the @, labels of 63, 253 in all), so that no repetition is longer than the matcher's stack bears.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}",
    "phone": r"\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/])\d{4}/\d{2}/\d{2}(?![\d/])|(?<![\d.])\d{2}\.\d{2}\.\d{4}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{13,19})(?!\d)".replace(r"([ -])\d{4}\1\d{4}\1\d{4}", r"(?:-\d{4}-\d{4}-\d{4}| \d{4} \d{4} \d{4})"),
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without such a character sequence hold no candidate and are passed on untouched.
GATE = r"\d\d|@|\d\.\d\.\d\.\d"
#: Rounds of every network; even, so that unequal halves end where they began.
ROUNDS = 8
#: Formats of dates, and the days of their domain: 400 years from 1800 on, 189 * 773 = 146097 days.
DATES = {"yyyy-MM-dd": r"^\d{4}-", "yyyy/MM/dd": r"^\d{4}/", "dd.MM.yyyy": r"^\d{2}\."}
FIRST_DAY, DAYS_HIGH, DAYS_LOW = "1800-01-01", 189, 773
#: Domain of social security numbers: 898 areas with 99 groups, 9999 serial numbers.
AREAS, GROUPS, SERIALS = 898, 99, 9999

LEFT, RIGHT = "l", "r"


def let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def number_at(hexadecimal: Column, at: Column | int, digits: int) -> Column:
    return F.conv(F.substring(hexadecimal, F.lit(at) if isinstance(at, int) else at, F.lit(digits)), 16, 10).cast("long")


def permute_pair(high: Column, low: Column, high_size: int, low_size: int, key: Column) -> Column:
    """struct(l, r): the pair permuted in Z_high_size x Z_low_size. Rounds add a keyed hash of one part to the other in turn."""

    def one(state: Column, r: Column) -> Column:
        add = lambda x: number_at(F.sha2(F.concat_ws("|", key, r.cast("string"), x.cast("string")), 256), 1, 12)
        return F.when(r % 2 == 0, F.struct(F.pmod(state[LEFT] + add(state[RIGHT]), F.lit(high_size)).alias(LEFT), state[RIGHT].alias(RIGHT))).otherwise(
            F.struct(state[LEFT].alias(LEFT), F.pmod(state[RIGHT] + add(state[LEFT]), F.lit(low_size)).alias(RIGHT))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(high.cast("long").alias(LEFT), low.cast("long").alias(RIGHT)), one)


def shifted(text: Column, hexadecimal: Column) -> Column:
    """text with its i-th character moved within its class (digits, lower-case, upper-case ASCII letters) by the hash's i-th byte."""

    def moved(by_all: Column) -> Column:
        def move(c: Column, i: Column) -> Column:
            by = number_at(by_all, F.pmod(i, F.lit(64)) * 2 + 1, 2)
            code = F.ascii(c)
            turned = lambda base, n: F.char(F.pmod(code - base + by, F.lit(n)) + base)
            return F.when(c.rlike("^[0-9]$"), turned(48, 10)).when(c.rlike("^[a-z]$"), turned(97, 26)).when(c.rlike("^[A-Z]$"), turned(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), move), "")

    return let(hexadecimal, moved)  # hashed once, not for every character


def permute_text(text: Column, key: Column) -> Column:
    """The text permuted among those with the same classes of characters at the same places; other characters stay."""

    def run(t: Column) -> Column:
        half = F.floor(F.length(t) / 2).cast("int")

        def one(state: Column, r: Column) -> Column:
            stream = lambda x: F.sha2(F.concat_ws("|", key, r.cast("string"), x), 512)
            return F.when(r % 2 == 0, F.struct(shifted(state[LEFT], stream(state[RIGHT])).alias(LEFT), state[RIGHT].alias(RIGHT))).otherwise(
                F.struct(state[LEFT].alias(LEFT), shifted(state[RIGHT], stream(state[LEFT])).alias(RIGHT))
            )

        start = F.struct(F.substring(t, F.lit(1), half).alias(LEFT), F.substring(t, half + 1, F.length(t)).alias(RIGHT))
        return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one), lambda s: F.concat(s[LEFT], s[RIGHT]))

    return let(text, run)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def with_digits(text: Column, digits: Column) -> Column:
    """text with its digits replaced by the given ones in a row; all other characters stay."""
    before = lambda i: F.length(digits_of(F.substring(text, F.lit(1), i)))
    put = lambda new: F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(new, before(i) + 1, F.lit(1))).otherwise(c))
    return F.array_join(let(digits, put), "")


def with_case(text: Column, new: Column) -> Column:
    """new, with capitals where text (of the same length) has them."""
    each = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    return F.array_join(F.zip_with(each(text), each(new), lambda c, n: F.when(c.rlike("^[A-Z]$"), F.upper(n)).otherwise(n)), "")


def luhn(text: Column, payload: bool) -> Column:
    """Sum of the check-digit rule modulo 10, of a whole number or of one whose check digit is still to come."""
    digits = F.reverse(F.filter(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), lambda c: c != ""))
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    value = F.transform(digits, lambda c, i: F.when((i + int(payload)) % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10


def day_of(text: Column, form: str) -> Column:
    return F.datediff(F.try_to_timestamp(text, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date"))


def pseudonym(x: Column, key: str) -> Column:
    """struct(kind, value): the pseudonym of a candidate, or kind null and the candidate itself if it is not valid."""
    keyed = lambda kind: F.lit(f"{key}|{kind}")
    answer = lambda kind, value: F.struct(F.lit(kind).cast("string").alias("kind"), value.alias("value"))
    same = answer(None, x)

    local = F.substring_index(x, "@", 1)
    email = F.concat(with_case(local, permute_text(F.lower(local), keyed("email"))), F.lit("@"), F.substring_index(x, "@", -1))
    prefix = F.regexp_extract(x, r"^(\+\d{1,3}[ .-]?)?", 0)
    national = F.substring(x, F.length(prefix) + 1, F.length(x))
    phone = F.concat(prefix, with_digits(national, permute_text(digits_of(national), keyed("phone"))))
    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("int"))
    address = let(permute_pair(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, 65536, keyed("ip")), lambda s: F.concat_ws(".", F.floor(s[LEFT] / 256).cast("string"), (s[LEFT] % 256).cast("string"), F.floor(s[RIGHT] / 256).cast("string"), (s[RIGHT] % 256).cast("string")))
    area, group, serial = (F.substring(x, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    ssn_ok = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    pad = lambda n, size: F.lpad(n.cast("string"), size, "0")
    ssn = let(
        permute_pair(place * GROUPS + group - 1, serial - 1, AREAS * GROUPS, SERIALS, keyed("ssn")),
        lambda s: let(F.floor(s[LEFT] / GROUPS), lambda p: F.concat_ws("-", pad(F.when(p > 664, p + 2).otherwise(p + 1), 3), pad(s[LEFT] % GROUPS + 1, 2), pad(s[RIGHT] + 1, 4))),
    )
    number = digits_of(x)
    payload = F.substring(number, F.lit(1), F.length(number) - 1)
    card = with_digits(x, let(permute_text(payload, keyed("card")), lambda p: F.concat(p, ((10 - luhn(p, True)) % 10).cast("string"))))

    out = F.when(F.contains(x, F.lit("@")), answer("email", email)).when(x.rlike(r"^(?:\+|\(|\d{3}-\d{3}-)"), answer("phone", phone))
    out = out.when(x.rlike(r"^\d+(?:\.\d+){3}$"), F.when(F.forall(octets, lambda o: o < 256), answer("ip", address)).otherwise(same))
    out = out.when(x.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(ssn_ok, answer("ssn", ssn)).otherwise(same))
    for form, begin in DATES.items():
        moved = lambda n, form=form: let(
            permute_pair(F.floor(n / DAYS_LOW), n % DAYS_LOW, DAYS_HIGH, DAYS_LOW, keyed("date")),
            lambda s: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (s[LEFT] * DAYS_LOW + s[RIGHT]).cast("int")), form),
        )
        day = day_of(x, form)
        out = out.when(x.rlike(begin) & (F.length(x) == 10), F.when(day.between(0, DAYS_HIGH * DAYS_LOW - 1), answer("date", moved(day))).otherwise(same))
    return out.otherwise(F.when(luhn(x, False) == 0, answer("card", card)).otherwise(same))


def pseudonymise(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """df with the valid personal values of each whole text replaced, and column pii: array of the replaced values' (kind, value).

    One narrow projection without Python: rows, their order and all other columns stay. Null and empty texts stay as
    they are with an empty array. A column pii of df is replaced. `key` decides the permutations; domains of e-mail
    addresses, country prefixes of telephone numbers, capitals and all separators stay.
    """
    given, plain, text_at = df.columns, positional(df), named(df, text_col)
    text = F.col(text_at).cast("string")
    found = F.when(text.rlike(GATE), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    step = plain.withColumn("_found", found).withColumn("_new", F.transform("_found", lambda x: pseudonym(x, key)))
    between = F.split(text, ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(between, F.transform("_new", lambda n: n["value"]), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    kept = [c for c in given if c != "pii"]
    return step.select(
        *((F.when(F.size("_found") > 0, joined).otherwise(text) if c == text_col else F.col(named(df, c))).alias(c) for c in kept),
        F.coalesce(F.filter("_new", lambda n: n["kind"].isNotNull()), F.array().cast("array<struct<kind:string,value:string>>")).alias("pii"),
    )


#: The session setting that holds the secret key, and the key of the registered query where it is unset.
KEY_SETTING, QUERY_KEY = "weald.pii.key", "weald demonstration key"


def key_of(spark) -> str:
    return spark.conf.get(KEY_SETTING, QUERY_KEY)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms in place of personal values, and how many of each kind. Null and empty texts stay as
    they are with zeros; repeated rows and null ids are rows of their own."""
    found = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
    count = lambda kind: F.size(F.filter("pii", lambda n: n["kind"] == kind)).alias(f"n_{kind}")
    return found.select("doc_id", "text", *map(count, PATTERNS))


def without_personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: pseudonyms in place of personal values; no document goes, null and repeated ones included. n_chars
    follows the text (null for a null one)."""
    plain, text = positional(docs), named(docs, "text")
    found = pseudonymise(plain, key_of(spark), text)
    return found.select(*((F.length(text).cast("long") if c == "n_chars" else F.col(named(docs, c))).alias(c) for c in docs.columns))
