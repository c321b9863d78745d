import datetime
import hashlib
import random
import re

import pytest

from postmill.llm import op1_pii_pseudonyms as op1


def luhn(d):
    d = [int(c) for c in re.sub(r"\D", "", d)][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def card(r):
    d = "4" + "".join(r.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if luhn(d + c) % 10 == 0)


def apply(spark, texts):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, n_card int")
    return {r.doc_id: r for r in op1.pseudonymise(df).collect()}


def test_values_keep_format_and_validity_and_stay_linked(spark):
    r = random.Random(1)
    cards = [card(r) for _ in range(40)]
    texts = [f"é {c} a, ({c[:4]} {c[4:8]} {c[8:12]} {c[12:]})." for c in cards]
    got = apply(spark, texts)
    for i, c in enumerate(cards):
        new = re.search(r"\d{16}", got[i].text)[0]
        assert new != c and luhn(new) % 10 == 0 and new[0] == c[0] and c not in got[i].text
        assert f"({new[:4]} {new[4:8]} {new[8:12]} {new[12:]})" in got[i].text and got[i].n_card == 2
    assert len({got[i].text for i in range(40)}) == 40


CASES = {
    "email": ["bosbt.42@mail8.example.com", "a@b.org", "Jo-Ann_x%9@sub.host-name.de"],
    "date": ["2024-02-29", "31.12.1999", "1.2.2003", "12/31/1999", "31/12/1999"],
    "ip": ["42.144.35.254", "0.0.0.0", "255.255.255.255"],
    "phone": ["+1 (988) 555-2485", "+49 30 1234567", "(212) 555-0187", "212-555-0187", "+33 6 12 34 56 78"],
    "ssn": ["123-45-6789"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
}
SHAPE = {
    "email": r"[^@]+@\S+",
    "date": r"\d{4}-\d\d-\d\d|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}",
    "ip": r"\d{1,3}(\.\d{1,3}){3}",
    "phone": r"[+\d() .-]+",
    "ssn": r"\d{3}-\d\d-\d{4}",
    "iban": r"[A-Z]{2}\d\d[A-Z0-9 ]+",
}


@pytest.mark.parametrize("kind", CASES)
def test_every_kind(spark, kind):
    texts = [f"vor {v} nach" for v in CASES[kind]] + [f"{v}" for v in CASES[kind]]
    got = apply(spark, texts)
    for i, v in enumerate(CASES[kind]):
        new = got[i].text.removeprefix("vor ").removesuffix(" nach")
        assert new != v and re.fullmatch(SHAPE[kind], new), (v, new)
        assert got[i + len(CASES[kind])].text == new  # linked across documents
        assert getattr(got[i], f"n_{kind}") == 1
        if kind == "iban":
            flat = new.replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
        if kind in ("phone", "iban"):
            assert re.sub(r"[A-Z0-9]", "x", new) == re.sub(r"[A-Z0-9]", "x", v)


def test_neighbouring_values_are_told_apart(spark):
    got = apply(spark, ["+1 (826) 555-4081 190.137.223.204 du", "+49 30 1234567 190.137.223.204", "190.137.223.204, 4111111111111111 a@b.org"])
    assert (got[0].n_phone, got[0].n_ip, got[1].n_phone, got[1].n_ip) == (1, 1, 1, 1)
    assert (got[2].n_ip, got[2].n_card, got[2].n_email) == (1, 1, 1)
    assert not any(x in got[i].text for i in range(3) for x in ("555-4081", "1234567", "190.137.223.204", "4111111111111111", "a@b.org"))
    assert len({re.search(r"(\d+\.){3}\d+", got[i].text)[0] for i in range(3)}) == 1


def test_permutations_have_no_collisions(spark):
    for left, right in ((17, 4297), (3, 7), (1, 5)):
        n = left * right
        days = spark.sql(f"select {op1.feistel_number('id', left, right, repr('date'))} as d from range({n})")
        assert days.distinct().count() == n and days.filter(f"d < 0 or d >= {n}").count() == 0
    four = spark.sql(f"select {op1.feistel('lpad(cast(id as string), 4, repr)'.replace('repr', repr('0')), repr('t'))} as d from range(10000)")
    assert four.distinct().count() == 10000 and four.filter("d rlike '^[0-9]{4}$'").count() == 10000


def test_what_is_not_valid_stays(spark):
    texts = [None, "", "1234567890123456", "2023-02-30", "256.1.1.1", "000-12-3456", "DE00370400440532013000", "version 1.2.3.4.5", "x" * 100000, "no data here"]
    got = apply(spark, texts)
    assert [got[i].text for i in range(len(texts))] == texts
    assert op1.pseudonymise(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_plan_has_no_python(spark):
    df = op1.pseudonymise(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString().replace("Scan ExistingRDD", ""))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def moved(c, k):
    for low, n in (("0", 10), ("a", 26), ("A", 26)):
        if ord(low) <= ord(c) < ord(low) + n:
            return chr(ord(low) + (ord(c) - ord(low) + k) % n)
    return c


def feistel(s, tweak):
    a, b = s[: len(s) // 2], s[len(s) // 2 :]
    for i in range(op1.ROUNDS):
        h = sha(f"{op1.KEY}:{tweak}:{i}:{b}")
        h += "".join(sha(f"{h[:64]}:{j}") for j in range(1, 1 + (len(a) - 1) // 16))
        a, b = b, "".join(moved(c, int(h[4 * j : 4 * j + 4], 16)) for j, c in enumerate(a))
    return a + b


def number(n, left, right, tweak):
    a, b = divmod(n, right)
    for i in range(op1.ROUNDS):
        f = int(sha(f"{op1.KEY}:{tweak}:{i}:{b if i % 2 == 0 else a}")[:12], 16)
        a, b = ((a + f) % left, b) if i % 2 == 0 else (a, (b + f) % right)
    return a * right + b


def refill(s, new, chars):
    it = iter(new)
    return re.sub(f"[{chars}]", lambda _: next(it), s)


def day_of(y, m, d):
    try:
        return datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None


def replaced(m):
    """(kind, what stands for the candidate m), one value after the other."""
    kind = next((k for k in op1.KINDS[:-1] if re.fullmatch(op1.PATTERNS[k], m)), "card")
    num = re.sub("[^0-9]", "", m)
    if kind == "email":
        local, host = m.split("@")
        k = int(sha(f"{op1.KEY}:email:one")[:12], 16)
        step = {"0": 1 + k % 9, "a": 1 + k // 9 % 25, "A": 1 + k // 225 % 25}
        one = lambda c: moved(c, step["0" if c.isdigit() else "a" if c.islower() else "A"]) if c.isalnum() else c
        return kind, (feistel(local, "email") if len(local) > 1 else one(local)) + "@" + host
    if kind == "iban":
        flat = m.replace(" ", "")
        value = lambda s: int("".join(str(int(c, 36)) for c in s))
        if value(flat[4:] + flat[:4]) % 97 != 1:
            return kind, m
        bban = feistel(flat[4:], "iban" + flat[:2])
        return kind, refill(m, f"{flat[:2]}{98 - value(bban + flat[:2] + '00') % 97:02d}{bban}", "A-Z0-9")
    if kind == "date":
        p = re.split("[./-]", m)
        if "-" in m:
            day, form = day_of(*p), "ymd"
        elif "." in m:
            day, form = day_of(p[2], p[1], p[0]), "d.m"
        else:
            day, form = day_of(p[2], p[0], p[1]), "m/d"
            if day is None:
                day, form = day_of(p[2], p[1], p[0]), "d/m"
        if day is None or not 1900 <= day.year <= 2099:
            return kind, m
        new = datetime.date(1900, 1, 1) + datetime.timedelta(days=number((day - datetime.date(1900, 1, 1)).days, 17, 4297, "date"))
        if form == "ymd":
            return kind, new.isoformat()
        parts = [f"{x:02d}" if len(q) == 2 else str(x) for x, q in zip((new.day, new.month) if form[0] == "d" else (new.month, new.day), p, strict=False)]
        return kind, form[1].join([*parts, str(new.year)])
    if kind == "ip":
        o = list(map(int, m.split(".")))
        if max(o) > 255:
            return kind, m
        q = number(int.from_bytes(bytes(o)), 65536, 65536, "ip")
        return kind, ".".join(map(str, q.to_bytes(4)))
    if kind == "phone":
        cc = (re.match("[+]([0-9]{1,3}(?=[^0-9])|1|[0-9]{2})", m) or [""])[0]
        nat = re.sub("[^0-9]", "", m[len(cc) :])
        n = len(nat)
        if not 7 <= n <= 12:
            return kind, m
        most = 8 if nat[0] >= "2" else 2
        low = 2 * 10 ** (n - 1) if most == 8 else 0
        new = number(int(nat) - low, most * 10 ** (n - 1 - n // 2), 10 ** (n // 2), f"phone{cc}{most}/{n}") + low
        return kind, cc + refill(m[len(cc) :], f"{new:0{n}d}", "0-9")
    if kind == "ssn":
        area, group, serial = int(num[:3]), int(num[3:5]), int(num[5:])
        if area in (0, 666) or area > 899 or not group or not serial:
            return kind, m
        q = number(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn")
        area = q // (99 * 9999) + 1
        return kind, refill(m, f"{area + (area >= 666):03d}{q // 9999 % 99 + 1:02d}{q % 9999 + 1:04d}", "0-9")
    if luhn(num) % 10:
        return kind, m
    pay = num[0] + feistel(num[1:-1], "card" + num[0])
    return kind, refill(m, pay + next(c for c in "0123456789" if luhn(pay + c) % 10 == 0), "0-9")


def brute(text):
    counts = dict.fromkeys(op1.KINDS, 0)

    def put(m):
        kind, new = replaced(m[0])
        counts[kind] += new != m[0]
        return new

    return re.sub(op1._pattern(), put, text, flags=re.A), counts


def test_matches_brute_force(spark):
    r = random.Random(6)
    pick = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    digits, letters = "0123456789", "abcXYZ"
    makers = [
        lambda: pick(letters + digits + "._-", 1, 40) + "@" + pick(letters + "-.", 1, 12) + "." + pick(letters, 1, 4),
        lambda: f"{r.randint(1, 33):0{r.choice([1, 2])}d}{(s := r.choice('./'))}{r.randint(1, 14):0{r.choice([1, 2])}d}{s}{r.randint(1890, 2110)}",
        lambda: f"{r.randint(1890, 2110)}-{r.randint(0, 13):02d}-{r.randint(0, 32):02d}",
        lambda: ".".join(str(r.randint(0, 270)) for _ in range(r.randint(3, 5))),
        lambda: f"+{r.choice(['1', '44', '49', '358'])} 0{pick(digits, 2, 3)} {pick(digits, 3, 4)} {pick(digits, 2, 4)}",
        lambda: f"({pick(digits, 3, 3)}) {pick(digits, 3, 3)}-{pick(digits, 4, 4)}",
        lambda: f"{pick('0689', 3, 3)}-{pick('01', 2, 2)}-{pick('01', 4, 4)}",
        lambda: card(r),
        lambda: pick(digits, 12, 20),
        lambda: r.choice(CASES["iban"]),
        lambda: "GB" + pick(digits, 2, 2) + pick("AB12", 11, 30),
        lambda: r.choice(["é", "@", ".", "-", "+", "A@b.org", "z@b.co", "7@x.info", "x@y", "a" * 30 + "@b.de"]),
    ]
    texts = ["".join(r.choice(makers)() + r.choice([" ", ", ", "\n", "; ", ""]) for _ in range(r.randint(1, 6))) for _ in range(1500)]
    got = apply(spark, texts)
    for i, t in enumerate(texts):
        want, counts = brute(t)
        assert got[i].text == want, t
        assert {k: getattr(got[i], f"n_{k}") for k in op1.KINDS} == counts, t


def test_one_character_local_parts_are_moved_by_the_key(spark):
    got = apply(spark, ["A@example.com", "a@example.com", "7@example.com"])
    assert all(got[i].n_email == 1 and got[i].text[1:] == "@example.com" for i in range(3))
    assert got[0].text[0].isupper() and got[0].text[0] != "A" and got[1].text[0] != "a" and got[2].text[0] != "7"
    assert [r.text for r in op1.pseudonymise(spark.createDataFrame([(1, "a@example.com")], "doc_id bigint, text string"), "other").collect()] != [got[1].text]
    with pytest.raises(ValueError):
        op1.pseudonymise(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), "it's")


def test_every_phone_number_keeps_its_class(spark):
    got = apply(spark, [f"+44 0{i:09d}" for i in range(0, 999999999, 99991)][:10000])
    assert len({r.text for r in got.values()}) == len(got) == 10000 and all(re.fullmatch(r"\+44 [01]\d{9}", r.text) for r in got.values())


def test_very_long_texts_of_parts_of_candidates(spark):
    n = 1 << 20
    texts = ["a@" + "a." * (n // 2), "1" * n, "@" * n, " " * n, "a@a-" + "-" * n, "1.1" * (n // 3), "a." * (n // 2) + "@b.org", "+1 " * (n // 3), "12-" * (n // 3), ("x" * 200 + "@") * (n // 201)]
    got = apply(spark, texts)
    assert all(got[i].text == t for i, t in enumerate(texts)) and not any(r.n_email for r in got.values())
