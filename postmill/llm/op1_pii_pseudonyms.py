"""Format-preserving Feistel pseudonyms for personal data, in Spark SQL functions only.

One expression finds candidates; a candidate is replaced if its kind's validation holds:

email      local part and host labels of letters and digits; the local part is permuted
iban       check digits right modulo 97; the account characters are permuted, check digits made anew
date       a day from 1900 to 2099, as Y-M-D, D.M.Y or M/D/Y (D/M/Y where only that is a date)
ip         four numbers to 255; permuted as 32 bits
phone      +country and 7 to 12 more digits, or a North American form; the digits after the country permuted
ssn        three groups within the numbers that can be issued
card       13 to 19 digits with a right Luhn digit; all between the first and the last permuted, the last made anew

A value's permutation is a keyed Feistel network over its own characters (digits stay digits, letters keep
their case) or, for dates, addresses, phone and social security numbers, over its place among the valid ones: two
factors whose product is exactly their number, so every result is valid at once and no two values share one.
Separators stay, so one number in two notations keeps one pseudonym, and equal values stay linked across documents
and tables under one key. Like any permutation it may map a value to itself (one in as many as its format allows).

Not hidden: host names, country codes, a card's first digit, an address's symbols (a local part of one letter or digit
is shifted by the key), and values whose validation fails. A local part
has at most 320 characters, a host 127 labels of 63.

Defined cases: a null text stays null with no counts; an empty one stays empty. Repeated rows each keep their
row; a null doc_id stays null. Extra columns are not read; an empty table gives no rows. No pattern backtracks over
more than a candidate or recurses with a text's length, so texts are as long as a Java string may be (the parts of one
with candidates stand in memory about four times). Two kinds at one place: the first in the order above.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import documents, narrow

ROUNDS = 8
KEY = "postmill-pii-v1"
KEY_CHARACTERS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-_"
#: Days from 1900 to 2099 as two factors, and a day's place among them.
DAYS, FIRST_DAY = (17, 4297), "datediff(day, date'1900-01-01')"
KINDS = ("email", "iban", "date", "ip", "phone", "ssn", "card")
#: Candidates; the first form that fits at a place is taken.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,320}+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]{1,63}+){0,125}\.[A-Za-z]{2,}+(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9A-Za-z/-]|\.[0-9])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]{1,3}[ -]?(?:\([0-9]{1,4}\)[ -]?)?[0-9]{1,4}(?:[ -]?[0-9]{2,4}){1,5}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])",
}


def _quoted(s: str) -> str:
    return "r'" + s + "'"


def _pattern() -> str:
    """All patterns as one alternation (only that of cards has groups, so their numbers hold)."""
    return "|".join(PATTERNS[k] for k in KINDS)


def _stream(tweak: str, i: str, other: str, key: str) -> str:
    return f"sha2(concat('{key}:', {tweak}, ':', cast({i} as string), ':', {other}), 256)"


def feistel(s: str, tweak: str, key: str = KEY) -> str:
    """SQL: the string s (two characters and more) permuted; a digit stays one, letters keep their case."""
    k = "cast(conv(substr(h, 4 * j - 3, 4), 16, 10) as int)"
    c = "ascii(substr(a.l, j, 1))"
    moved = (
        f"case when {c} between 48 and 57 then chr(48 + ({c} - 48 + {k}) % 10) when {c} between 97 and 122 then chr(97 + ({c} - 97 + {k}) % 26) "
        f"when {c} between 65 and 90 then chr(65 + ({c} - 65 + {k}) % 26) else substr(a.l, j, 1) end"
    )
    half = f"array_join(transform(sequence(1, length(a.l)), j -> {moved}), '')"
    stream = _stream(tweak, "i", "a.r", key)  # 16 characters' worth; more of it for a longer half
    stream = f"if(length(a.l) <= 16, {stream}, array_join(transform(sequence(0, (length(a.l) - 1) div 16), b -> if(b = 0, {stream}, sha2(concat({stream}, ':', cast(b as string)), 256))), ''))"
    step = f"named_struct('l', a.r, 'r', element_at(transform(array({stream}), h -> {half}), 1))"
    start = f"named_struct('l', substr({s}, 1, cast(length({s}) / 2 as int)), 'r', substr({s}, cast(length({s}) / 2 as int) + 1))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (a, i) -> {step}, a -> concat(a.l, a.r))"


def feistel_number(n: str, left: int | str, right: int | str, tweak: str, key: str = KEY) -> str:
    """SQL: n below left * right permuted, as a pair of a number below left and one below right (numbers, or SQL)."""
    left, right = (f"{x}L" if isinstance(x, int) else x for x in (left, right))
    f = lambda i, other: f"cast(conv(substr({_stream(tweak, i, f'cast({other} as string)', key)}, 1, 12), 16, 10) as bigint)"
    odd = f"named_struct('l', a.l, 'r', (a.r + {f('i', 'a.l')}) % {right})"
    even = f"named_struct('l', (a.l + {f('i', 'a.r')}) % {left}, 'r', a.r)"
    start = f"named_struct('l', cast({n} as bigint) div {right}, 'r', cast({n} as bigint) % {right})"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (a, i) -> if(i % 2 = 0, {even}, {odd}), a -> a.l * {right} + a.r)"


def digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def refill(s: str, new: str, chars: str = "0-9") -> str:
    """SQL: s with its characters of a class replaced, in order, by those of new."""
    return (
        f"array_join(transform(split({s}, ''), (ch, p) -> if(ch rlike '^[{chars}]$', "
        f"substr({new}, 1 + length(regexp_replace(substr({s}, 1, p), '[^{chars}]', '')), 1), ch)), '')"
    )


def luhn_sum(payload: str) -> str:
    """SQL: the Luhn sum of the digits before the check digit."""
    d = f"cast(substr({payload}, length({payload}) + 1 - j, 1) as int)"
    return f"aggregate(sequence(1, length({payload})), 0, (s, j) -> s + if(j % 2 = 1, if({d} > 4, 2 * {d} - 9, 2 * {d}), {d}))"


def mod97(s: str) -> str:
    """SQL: the number that an IBAN's characters (A = 10, ...) spell, modulo 97."""
    c = f"ascii(substr({s}, j, 1))"
    return f"aggregate(sequence(1, length({s})), 0, (r, j) -> if({c} < 58, (r * 10 + {c} - 48) % 97, (r * 100 + {c} - 55) % 97))"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with name bound to value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _shifted(loc: str, key: str) -> str:
    """SQL: one character, moved within its class by the key's own steps (never by none)."""
    k = int(hashlib.sha256(f"{key}:email:one".encode()).hexdigest()[:12], 16)
    classes = [("0123456789", 1 + k % 9), ("abcdefghijklmnopqrstuvwxyz", 1 + k // 9 % 25), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1 + k // 225 % 25)]
    return f"translate({loc}, '{''.join(c for c, _ in classes)}', '{''.join(c[n:] + c[:n] for c, n in classes)}')"


def _email(m: str, key: str) -> str:
    local, host = f"substring_index({m}, '@', 1)", f"substring_index({m}, '@', -1)"
    body = _let("loc", local, f"if(length(loc) > 1, {feistel('loc', repr('email'), key)}, {_shifted('loc', key)})")
    return f"concat({body}, '@', {host})"


def _iban(m: str, key: str) -> str:
    flat = f"replace({m}, ' ', '')"
    valid = f"{mod97('concat(substr(flat, 5), substr(flat, 1, 4))')} = 1"
    check = mod97("concat(bban, substr(flat, 1, 2), '00')")
    new = _let("bban", feistel("substr(flat, 5)", "concat('iban', substr(flat, 1, 2))", key), f"concat(substr(flat, 1, 2), lpad(cast(98 - {check} as string), 2, '0'), bban)")
    return _let("flat", flat, f"if({valid}, {_let('neu', new, refill(m, 'neu', 'A-Z0-9'))}, {m})")


def _date(m: str, key: str) -> str:
    p = f"split({m}, '[./-]')"
    ymd = lambda y, mo, d: f"try_to_date(concat(lpad({y}, 4, '0'), '-', lpad({mo}, 2, '0'), '-', lpad({d}, 2, '0')), 'yyyy-MM-dd')"
    day = f"case when {m} like '%-%' then {ymd('p[0]', 'p[1]', 'p[2]')} when {m} like '%.%' then {ymd('p[2]', 'p[1]', 'p[0]')} else coalesce({ymd('p[2]', 'p[0]', 'p[1]')}, {ymd('p[2]', 'p[1]', 'p[0]')}) end"
    month_first = f"({ymd('p[2]', 'p[0]', 'p[1]')} is not null)"
    new = f"date_add(date'1900-01-01', cast({feistel_number(FIRST_DAY, *DAYS, repr('date'), key)} as int))"
    pad = lambda f, part: f"if(length({part}) = 2, date_format(neu, '{f}{f}'), date_format(neu, '{f}'))"
    shown = (
        f"case when {m} like '%-%' then date_format(neu, 'yyyy-MM-dd') when {m} like '%.%' then concat({pad('d', 'p[0]')}, '.', {pad('M', 'p[1]')}, '.', date_format(neu, 'yyyy')) "
        f"when {month_first} then concat({pad('M', 'p[0]')}, '/', {pad('d', 'p[1]')}, '/', date_format(neu, 'yyyy')) else concat({pad('d', 'p[0]')}, '/', {pad('M', 'p[1]')}, '/', date_format(neu, 'yyyy')) end"
    )
    ok = "day is not null and day between date'1900-01-01' and date'2099-12-31'"
    return _let("p", p, _let("day", day, f"if({ok}, {_let('neu', new, shown)}, {m})"))


def _ip(m: str, key: str) -> str:
    n = "((cast(o[0] as bigint) * 256 + cast(o[1] as bigint)) * 256 + cast(o[2] as bigint)) * 256 + cast(o[3] as bigint)"
    shown = "concat_ws('.', cast(q div 16777216L as string), cast(q div 65536L % 256 as string), cast(q div 256L % 256 as string), cast(q % 256 as string))"
    ok = "forall(o, x -> cast(x as int) < 256)"
    return _let("o", f"split({m}, '[.]')", f"if({ok}, {_let('q', feistel_number(n, 65536, 65536, repr('ip'), key), shown)}, {m})")


def _phone(m: str, key: str) -> str:
    """A number's first digit stays among 2 to 9 or among 0 and 1: each of the two classes is permuted by itself."""
    country = f"regexp_extract({m}, '^[+]([0-9]{{1,3}}(?=[^0-9])|1|[0-9]{{2}})', 0)"
    rest = f"substr({m}, length(cc) + 1)"
    ten = lambda e: f"cast(pow(10, {e}) as bigint)"
    moved = feistel_number("cast(nat as bigint) - low", f"(most * {ten('length(nat) - 1 - length(nat) div 2')})", ten("length(nat) div 2"), "concat('phone', cc, cast(most as string), '/', cast(length(nat) as string))", key)
    new = f"lpad(cast({moved} + low as string), length(nat), '0')"
    new = _let("most", "if(nat >= '2', 8L, 2L)", _let("low", f"if(most = 8, 2 * {ten('length(nat) - 1')}, 0L)", new))
    body = _let("nat", digits(rest), f"if(length(nat) between 7 and 12, concat(cc, {_let('neu', new, refill(rest, 'neu'))}), {m})")
    return _let("cc", country, body)


def _ssn(m: str, key: str) -> str:
    """898 areas (no 000, 666, 900 and more), 99 groups, 9999 serial numbers."""
    valid = "(substr(num, 1, 3) not in ('000', '666') and substr(num, 1, 1) <> '9' and substr(num, 4, 2) <> '00' and substr(num, 6) <> '0000')"
    place = "((cast(substr(num, 1, 3) as int) - if(num > '666', 2, 1)) * 99 + cast(substr(num, 4, 2) as int) - 1) * 9999L + cast(substr(num, 6) as int) - 1"
    area = "q div (99 * 9999L) + if(q div (99 * 9999L) >= 665, 2, 1)"
    new = f"concat(lpad(cast({area} as string), 3, '0'), lpad(cast(q div 9999L % 99 + 1 as string), 2, '0'), lpad(cast(q % 9999 + 1 as string), 4, '0'))"
    new = _let("q", feistel_number(place, 898 * 99, 9999, "'ssn'", key), new)
    return _let("num", digits(m), f"if({valid}, {_let('neu', new, refill(m, 'neu'))}, {m})")


def _card(m: str, key: str) -> str:
    payload = "substr(num, 1, length(num) - 1)"
    valid = f"({luhn_sum(payload)} + cast(right(num, 1) as int)) % 10 = 0"
    body = f"concat(substr(num, 1, 1), {feistel('substr(num, 2, length(num) - 2)', 'concat(' + repr('card') + ', substr(num, 1, 1))', key)})"
    new = _let("pay", body, f"concat(pay, cast((10 - {luhn_sum('pay')} % 10) % 10 as string))")
    return _let("num", digits(m), f"if({valid}, {_let('neu', new, refill(m, 'neu'))}, {m})")


_MAKE = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "phone": _phone, "ssn": _ssn, "card": _card}


def _kind(m: str) -> str:
    return "case " + " ".join(f"when {m} rlike {_quoted('^(?:' + PATTERNS[k] + ')$')} then '{k}'" for k in KINDS[:-1]) + " else 'card' end"


def replacements(text: str, key: str = KEY) -> str:
    """SQL: for every candidate in text a struct of its kind, the candidate, and what replaces it."""
    made = "case k " + " ".join(f"when '{k}' then {_MAKE[k]('m', key)}" for k in KINDS) + " end"
    one = f"element_at(transform(array({_kind('m')}), k -> named_struct('kind', k, 'old', m, 'new', {made})), 1)"
    return f"transform(regexp_extract_all({text}, {_quoted(_pattern())}, 0), m -> {one})"


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with pseudonyms, n_email, n_iban, ... (replaced values of each kind) of every document."""
    if not set(key) <= set(KEY_CHARACTERS):
        raise ValueError("a key is of letters, digits, - and _")
    d = narrow(docs, "doc_id", "text").withColumn("found", F.expr(replacements("text", key)))
    pieces = f"split(text, {_quoted(_pattern())}, -1)"
    joined = f"array_join(zip_with({pieces}, found, (a, b) -> concat(a, coalesce(b.new, ''))), '')"
    counts = [F.coalesce(F.expr(f"size(filter(found, x -> x.kind = '{k}' and x.old <> x.new))").cast("bigint"), F.lit(0)).alias(f"n_{k}") for k in KINDS]
    return d.select("doc_id", F.expr(f"if(size(found) > 0, {joined}, text)").alias("text"), *counts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir))
