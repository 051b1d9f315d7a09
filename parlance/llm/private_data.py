"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.spans import Rule, as_words, spans_of
from parlance.llm.tables import text_or_empty

_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_IP_PARTS = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass Luhn's check: every second one from the right doubled, its digits summed."""
    numbers = F.transform(F.split(F.reverse(digits_of(value)), ""), lambda c: c.try_cast("int"))
    doubled = F.transform(numbers, lambda n, i: F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n))
    total = F.aggregate(doubled, F.lit(0), lambda sofar, n: sofar + F.coalesce(n, F.lit(0)))
    return total % 10 == 0


def mod_97(value: Column) -> Column:
    """Whether an account number leaves 1 on division by 97, its first four characters put last, A as 10 to Z as 35."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    numbers = F.transform(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        lambda c: F.coalesce(c.try_cast("int"), F.ascii(c) - F.lit(55)),
    )
    rest = F.aggregate(numbers, F.lit(0), lambda sofar, n: (sofar * F.when(n > 9, 100).otherwise(10) + n) % 97)
    return rest == 1


def _digit_count(value: Column, least: int, most: int) -> Column:
    return F.length(digits_of(value)).between(least, most)


def _sql_digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '', 'g')"


_SQL_LUHN = (
    f"list_sum(list_transform(string_split(reverse({_sql_digits('s.value')}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS BIGINT) "
    "WHEN CAST(c AS BIGINT) > 4 THEN 2 * CAST(c AS BIGINT) - 9 ELSE 2 * CAST(c AS BIGINT) END)) % 10 = 0"
)
_SQL_MOD_97 = (
    "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(replace(s.value, ' ', '')[5:] || replace(s.value, ' ', '')[:4], ''), "
    "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(ascii(c) - 48 AS BIGINT) ELSE CAST(ascii(c) - 55 AS BIGINT) END)), "
    "lambda a, n: (a * CASE WHEN n > 9 THEN 100 ELSE 10 END + n) % 97) = 1"
)

# Characters of an account number by the country that starts it.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _account(length: int, countries: str) -> str:
    """Account numbers of one length, with or without a space after every four characters."""
    fours, rest = divmod(length - 4, 4)
    last = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{fours}}}{last}"


_ACCOUNT = "(?:" + "|".join(_account(length, countries) for length, countries in ACCOUNT_LENGTHS.items()) + ")"

# The first four are fixed; account numbers and national numbers are added, the latter only near words that name them.
RULES = (
    Rule(
        "email",
        rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        needs="@",
        sql_pattern=rf"{_LOCAL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        base=True,
        score=90,
        context=as_words("e?-?mails?|contact|write|address"),
        context_score=10,
    ),
    Rule(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        needs=r"[0-9]\.[0-9]++\.[0-9]",
        sql_pattern=r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        valid=lambda value: value.rlike(_IP_PARTS),
        sql_valid=f"regexp_matches(s.value, '{_IP_PARTS}')",
        base=True,
        score=60,
        context=as_words("address|hosts?|servers?|login|visit|ip"),
        context_score=30,
    ),
    Rule(
        "card",
        r"[0-9](?:[\x20-]?[0-9]){13,}+",
        needs=r"[0-9](?:[\x20-]?[0-9]){13}",
        sql_pattern=r"[0-9](?:[\x20-]?[0-9])+",
        valid=lambda value: _digit_count(value, 14, 19) & luhn(value),
        sql_valid=f"CASE WHEN length({_sql_digits('s.value')}) BETWEEN 14 AND 19 THEN {_SQL_LUHN} ELSE false END",
        base=True,
        score=70,
        context=as_words("cards?|visa|credit|pay"),
        context_score=30,
    ),
    Rule(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        needs=r"\+[0-9]",
        valid=lambda value: _digit_count(value, 10, 15),
        sql_valid=f"length({_sql_digits('s.value')}) BETWEEN 10 AND 15",
        base=True,
        score=60,
        context=as_words("phone|call|tel|mobile|fax"),
        context_score=30,
    ),
    Rule(
        "iban",
        _ACCOUNT,
        needs="[A-Z]{2}[0-9]{2}\\x20?[A-Z0-9]{4}",
        valid=mod_97,
        sql_valid=_SQL_MOD_97,
        score=80,
        context=as_words("iban|account|bank|transfer"),
        context_score=20,
        least=50,
    ),
    Rule(
        "national_id",
        "[0-9]{3}-[0-9]{2}-[0-9]{4}",
        needs="[0-9]{3}-[0-9]{2}-[0-9]{4}",
        score=40,
        context=as_words("ssn|social security|national id|tax"),
        context_score=50,
        least=60,
    ),
)


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row of ``docs``: key, found (sorted array of spans with scores in percent).

    Works inside the row, without a shuffle. A null text is an empty one; repeated rows are
    treated alike; an empty table gives an empty one.
    """
    bodies = docs.select(F.col(key).alias(key), text_or_empty(text).alias("body"))
    found = F.concat(*[spans_of(rule, place, F.col("body")) for place, rule in enumerate(rules)])
    return bodies.select(key, F.array_sort(found).alias("found"))
