"""Personal data by format-preserving Feistel pseudonyms, in DataFrame functions only.

One regular expression finds candidates; each is validated (Luhn for card numbers, mod 97 for IBANs, octets of addresses,
ranges of national numbers, calendars for dates), and what doesn't validate stays as it is. A validated number is a pair
(A, B) in its format's domain, and a keyed Feistel network with modular addition permutes that domain, so the pseudonym is
a valid value of the same format, with its separators, and equal values get equal pseudonyms in every document. Names of
mail addresses and secrets, which have no number format, become keyed digests.

Formats: payment cards (13 to 19 digits, first digit kept, check digit recomputed), phone numbers (+C (AAA) BBB-DDDD and
the like: country code and the first digits of area and exchange kept), IPv4 addresses, US social security numbers,
IBANs, also in groups of four (country and the next four characters kept, all further digits permuted in their places, check
digits recomputed), dates (YYYY-MM-DD and DD/MM/YYYY, 1900 to 2099), mail addresses,
access keys (AKIA...), and values after password, token, secret or api key.

Everything is a projection over rows: no shuffle, no state. Texts that hold no digit, @ or secret's name are passed on after
one scan. Null texts stay null with a count of 0; empty texts stay empty. Repeated rows are treated alike; all other
columns are kept, also one that is called n_private (it becomes _in_n_private). The key has no default: a deployment takes
it from its secret store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.llm import columnar as C

ROUNDS = 8
#: The key that the query over the test tables uses. It protects nothing.
TEST_KEY = "a-key-for-tests"
#: Candidates, by format; the first that matches at a place wins.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"(?i:\bAKIA[0-9A-Z]{16}\b)",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9_./+=-]{6,})",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}\b|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}\b",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9/])[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}(?![0-9/])",
    "card": r"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7})(?![0-9A-Za-z-])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text that this doesn't match holds no candidate.
HINT = r"[0-9@]|(?i:passw|pwd|secret|token|api.?key|AKIA)"
DAYS = (319, 229)  # 1900-01-01 to 2099-12-31: 73049 days, 319 x 229


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def feistel(key: str, tweak: Column | str, a: Column, b: Column, size_a: Column | int, size_b: Column | int) -> tuple[Column, Column]:
    """Permutes the pairs (a, b) with 0 <= a < size_a, 0 <= b < size_b: each half in turn gets a keyed function of the other."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    size_a, size_b = (F.lit(x).cast("long") if isinstance(x, int) else x.cast("long") for x in (size_a, size_b))

    def f(i: Column, side: str, x: Column) -> Column:
        return F.conv(F.substring(_digest(key, tweak, i.cast("string"), F.lit(side), x.cast("string")), 1, 12), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        left = (s["a"] + f(i, "a", s["b"])) % size_a
        return F.struct(left.alias("a"), s["b"].alias("b"))

    def back(s: Column, i: Column) -> Column:
        return F.struct(s["a"].alias("a"), ((s["b"] + f(i, "b", s["a"])) % size_b).alias("b"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), lambda s, i: F.when(i % 2 == 1, turn(s, i)).otherwise(back(s, i)))
    return out["a"], out["b"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _permuted_digits(key: str, tweak: str, digits: Column) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    size = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    a, b = feistel(key, F.concat(F.lit(tweak), n.cast("string")), F.substring(digits, F.lit(1), half).cast("long"), F.substring(digits, half + 1, n - half).cast("long"), size(half), size(n - half))
    return F.concat(F.lpad(a.cast("string"), half, "0"), F.lpad(b.cast("string"), n - half, "0"))


def _luhn_sum(digits: Column) -> Column:
    """Of a number without its check digit: its last digit is doubled first."""
    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("sum"), F.lit(True).alias("double")), lambda s, c: F.struct((s["sum"] + F.when(s["double"], c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))).alias("sum"), (~s["double"]).alias("double")))["sum"]


def _refill(value: Column, digits: Column) -> Column:
    """The value with its digits replaced in order, separators kept."""
    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))))["out"]


def _card(key: str, value: Column) -> Column:
    digits = _digits(value)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    check = lambda x: (10 - _luhn_sum(x) % 10) % 10
    new = F.concat(F.substring(digits, 1, 1), _permuted_digits(key, "card", F.substring(digits, F.lit(2), F.length(digits) - 2)))
    valid = F.length(digits).between(13, 19) & (check(body) == F.substring(digits, -1, 1).cast("int"))
    return F.when(valid, _refill(value, F.concat(new, check(new).cast("string")))).otherwise(value)


def _phone(key: str, value: Column) -> Column:
    digits = _digits(value)
    last = F.substring(digits, -10, 10)
    new = _permuted_digits(key, "phone", F.concat(F.substring(last, 2, 2), F.substring(last, 5, 6)))
    whole = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), F.substring(last, 1, 1), F.substring(new, 1, 2), F.substring(last, 4, 1), F.substring(new, 3, 6))
    return _refill(value, whole)


def _ip(key: str, value: Column) -> Column:
    o = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    a, b = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
    text = F.concat_ws(".", *((F.floor(x / 256) if high else x % 256).cast("string") for x in (a, b) for high in (True, False)))
    return F.when(F.forall(o, lambda x: x <= 255), text).otherwise(value)


def _ssn(key: str, value: Column) -> Column:
    area, group, serial = (F.substring(value, s, n).cast("int") for s, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas
    a, b = feistel(key, "ssn", index * 99 + group - 1, serial - 1, 898 * 99, 9999)
    new = F.floor(a / 99)
    new = F.when(new >= 665, new + 2).otherwise(new + 1)
    text = F.concat_ws("-", F.lpad(new.cast("string"), 3, "0"), F.lpad((a % 99 + 1).cast("string"), 2, "0"), F.lpad((b + 1).cast("string"), 4, "0"))
    return F.when(valid, text).otherwise(value)


def _date(key: str, value: Column) -> Column:
    iso = value.rlike("^[0-9]{4}-")
    day = F.when(iso, F.try_to_timestamp(value, F.lit("yyyy-MM-dd"))).otherwise(F.try_to_timestamp(value, F.lit("dd/MM/yyyy"))).cast("date")
    origin = F.to_date(F.lit("1900-01-01"))
    number = F.datediff(day, origin)
    a, b = feistel(key, "date", F.floor(number / DAYS[1]), number % DAYS[1], *DAYS)
    new = F.date_add(origin, (a * DAYS[1] + b).cast("int"))
    return F.when(day.isNull(), value).when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.date_format(new, "dd/MM/yyyy"))


def _mod97(text: Column) -> Column:
    v = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: (s * F.when(v(c) > 9, 100).otherwise(10) + v(c)) % 97)


def _iban(key: str, value: Column) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    country, check, bank, account = F.substring(plain, 1, 2), F.substring(plain, 3, 2), F.substring(plain, 5, 4), F.substring(plain, 9, 30)
    digits = _digits(account)
    new = _refill(account, _permuted_digits(key, "iban", digits))
    checked = F.lpad((98 - _mod97(F.concat(bank, new, country, F.lit("00")))).cast("string"), 2, "0")
    valid = (_mod97(F.concat(bank, account, country, check)) == 1) & (F.length(digits) >= 2)
    return F.when(valid, _refill(value, F.concat(checked, _digits(bank), _digits(new)))).otherwise(value)


def pseudonym(key: str, value: Column) -> Column:
    """What stands for a candidate; the candidate itself if it doesn't validate."""
    at = F.instr(value, "@")
    mail = F.concat(F.lit("user-"), F.substring(_digest(key, F.lit("mail"), F.lower(value)), 1, 12), F.lit("@host-"), F.substring(_digest(key, F.lit("host"), F.lower(F.substring(value, at + 1, F.length(value)))), 1, 8), F.lit(".invalid"))
    name = F.regexp_extract(value, r"^(.*?[:=]\s*[\"']?)", 1)
    secret = F.concat(name, F.lit("SECRET-"), F.substring(_digest(key, F.lit("secret"), F.substring(value, F.length(name) + 1, F.length(value))), 1, 12))
    is_a = lambda kind: value.rlike(f"^(?:{PATTERNS[kind]})$")
    return (
        F.when(at > 0, mail)
        .when(is_a("key"), F.concat(F.lit("KEY-"), F.substring(_digest(key, F.lit("key"), F.upper(value)), 1, 12)))
        .when(is_a("secret"), secret)
        .when(is_a("iban"), _iban(key, value))
        .when(is_a("phone"), _phone(key, value))
        .when(is_a("ip"), _ip(key, value))
        .when(is_a("ssn"), _ssn(key, value))
        .when(is_a("date"), _date(key, value))
        .otherwise(_card(key, value))
    )


def pseudonymised(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with personal data replaced in ``text``, and n_private: how many values were replaced."""
    documents = C.renamed(documents, "n_private") if text.lower() != "n_private" else documents
    old, fresh = (C.spare(documents.columns, c) for c in ("_found", "_new"))
    found = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)))
    marked = documents.withColumn(old, F.when(F.size(found) > 0, found))
    marked = marked.withColumn(fresh, F.transform(old, lambda v: pseudonym(key, v)))
    changed = F.size(F.filter(F.zip_with(old, fresh, lambda a, b: a != b), lambda x: x))
    joined = F.array_join(F.zip_with(F.split(F.col(text), ANY, -1), fresh, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = marked.withColumn("n_private", F.when(F.col(fresh).isNotNull(), changed).otherwise(0).cast("long"))
    return out.withColumn(text, F.when(F.col(fresh).isNotNull(), joined).otherwise(F.col(text))).drop(old, fresh)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(spark.read.parquet(f"{sf_dir}/documents.parquet"), TEST_KEY).select("doc_id", "text", "n_private")


QUERIES = {"op4_pii": op4_pii}

ORACLE_SQL: dict[str, str] = {}
