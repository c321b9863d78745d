"""Fill-in-the-middle: against a plain version written from the contract, and the defined cases."""

import hashlib
import random
import re

import pytest

from postmill.llm import op11_fill_in_middle as op11

SCHEMA = "doc_id bigint, text string, lang string, n bigint, output string"


def plain_version(doc_id, text):
    """The contract's words, one by one, without offsets."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    lo, hi = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    pre, mid, suf = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), "<S>" + suf + "<P>" + pre + "<M>" + mid
    return n, "psm", len(pre), len(mid), "<P>" + pre + "<S>" + suf + "<M>" + mid


def sample():
    rnd = random.Random(5)
    parts = ["a", "word", " ", "  ", "\n", "\t\r", "\x0b\x0c", "é", "語", "😀", " ", " ", "<", "<P", "P>", "S>", "<M", "\x00", "\x1f", "\x85"]
    rows = [(k, "".join(rnd.choices(parts, k=rnd.randrange(0, 40))), "en", 7, "x") for k in range(600)]
    return [*rows, (None, "null id has a text", None, None, None), (7, None, None, None, None), (8, "", "en", 1, "y"), (9, "<P>already", "en", 1, "y"), (2**62 + 1, "a big id must not lose digits", "en", 1, "y"),
            (11, "same row", "en", 1, "z"), (11, "same row", "en", 1, "z"), (-3, " \n ", "en", 1, "z")]


def test_against_the_contract(spark):
    rows = sample()
    got = op11.with_digests(op11.transform(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in rows:
        n, form, a, b, out = plain_version(r[0], r[1])
        want.append((r[0], n, form, a, b, out, digest(out), digest(r[1] or "")))
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {x.form for x in got} == {"plain", "spm", "psm"}


def test_the_table(spark):
    """Every row of the table, and its whole texts."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op11.query(spark, sf).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        n, form, a, b, out = plain_version(doc_id, text)
        r = got[doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, a, b)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("rate,spm_rate,form", [(100, 100, "spm"), (100, 0, "psm"), (0, 50, "plain")])
def test_rates_and_seeds(rate, spm_rate, form):
    outs = set()
    for seed in range(20):
        n, f, a, b, out = op11.rewritten("one two  three\nfour 語 five ", "17", seed, rate, spm_rate)
        assert f == form and op11.restored(out, f) == "one two  three\nfour 語 five "
        outs.add(out)
    assert (len(outs) == 1) == (form == "plain")


def test_a_very_long_text(spark):
    """Longer than any batch's usual size; nothing of it is lost."""
    text = ("wort " * 9 + "\n\n ende, ") * 120_000
    (r,) = op11.with_digests(op11.transform(spark.createDataFrame([(3, text)], "doc_id bigint, text string"), rate=100)).collect()
    assert r.form in ("spm", "psm") and r.n == 120_000 * 10 + 1 and len(r.output) == len(text) + 9
    assert r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_an_empty_table(spark):
    assert op11.with_digests(op11.transform(spark.createDataFrame([], SCHEMA))).collect() == []
