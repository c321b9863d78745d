import random
import re

import pyarrow as pa

from postmill.llm import op5_quality_rules as op5

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    r = random.Random(5)
    word = lambda: r.choice(["the", "Où", "naïve", "a", "x***", "|", "日本", "REALLY", "dog.", " ", " z"])
    out = [None, "", " ", "\n\n", "one", "a b\na b\n\na b", "x " * 50, "\t\x0b\x0c\r\n", "a\nA\na ", "\n a"]
    for _ in range(60):
        out.append("".join(word() + r.choice([" ", "  ", "\n", "\t"]) for _ in range(r.randint(1, 60))))
    return out + [" ".join(["lorem ipsum dolor"] * 4000)]


def brute(t):
    t = t or ""
    words = WORD.findall(t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    win = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    cover = set()
    count = {}
    for x in win:
        count[x] = count.get(x, 0) + 1
    for i, x in enumerate(win):
        if count[x] > 1:
            cover.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))


def rows():
    return [(i, t, "en", "s", 0, "clash") for i, t in enumerate(texts())] + [(3, "same id", None, None, None, None)]


def test_measurements_match_brute_force(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = op5.apply_policy(op5.ledger(df)).collect()
    want = [(i, *brute(t)) for i, t, *_ in rows()]
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(want)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_policies_and_ablation_read_only_the_ledger(spark):
    led = op5.ledger(spark.createDataFrame(rows(), SCHEMA))
    kept = {v: op5.apply_policy(led, v).filter("kept").count() for v in op5.POLICIES}
    assert kept["v2-strict"] <= kept["v1-base"]
    table = {r.rule: r for r in op5.ablate(led).collect()}
    bits = [r.failures for r in led.collect()]
    for rule in op5.RULES:
        b = 1 << rule.bit
        assert table[rule.name].n_failed == sum(bool(x & b) for x in bits)
        assert table[rule.name].n_only_this == sum(x == b for x in bits)
        assert table[rule.name].n_kept_without == sum(not x & ~b for x in bits)


def test_stage_keeps_rows_whole(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    good = {r.doc_id for r in op5.apply_policy(op5.ledger(df)).filter("kept").collect()}
    out = op5.stage(spark, df, "")
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == good


def test_empty_table(spark):
    assert op5.apply_policy(op5.ledger(spark.createDataFrame([], SCHEMA))).count() == 0


def test_the_stage_s_ledger_holds_bits_and_measurements(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumnRenamed("n_words", "_ledger")
    want = sorted((r.doc_id, r.failures, r.n_words, r.n_dup_lines) for r in op5.ledger(df).collect())
    assert sorted((r.doc_id, r.x.failures, r.x.n_words, r.x.n_dup_lines) for r in op5.judged(df, "x").collect()) == want
    assert op5.stage(spark, df, "").columns == df.columns


def test_lines_and_windows_that_collide_under_polynomials_modulo_a_power_of_two():
    a = "a"
    while len(a) < 2048:  # Thue and Morse
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    t = f"{a}\n{b}\n{' '.join(a[:1024])}\n{' '.join(b[:1024])}\n{a}"
    m = op5.measure(pa.array([t]))
    assert tuple(int(m[k][0]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(t)
