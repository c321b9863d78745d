"""Source divergence: against a brute-force version in whole numbers of any size, by both ways of handing totals over."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from postmill.llm import op12_source_divergence as op12

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, value double"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sample():
    rnd = random.Random(12)
    words = ["the", "The", "of", "é", "É", "日本", "x", "xy", "xyz", "xylem", "zeta", "Zeta", "ｚ", "a1b", "don't", "😀", "rare"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for k in range(240):
        lang, source = rnd.choice(["en", "de", "", None]), rnd.choice(["hot", "hot", "hot", "s1", "s2", "", None])
        own = words[: rnd.randrange(5, len(words))]
        rows.append((k, rnd.choice(["", None, " ".join(rnd.choices(own, k=rnd.randrange(1, 60)))] if k % 9 == 0 else [" ".join(rnd.choices(own, k=rnd.randrange(1, 60)))]), lang, source, "clash", 1.0))
    rows += [rows[1]] * 3 + [(None, "the the the", "en", "s1", None, None), (900, "once only here", "xx", "a", None, None), (901, "12 34", "xx", "b", None, None), (902, None, "yy", "alone", None, None)]
    rows += [(903, "same same", "zz", s, None, None) for s in ("one", "two", "three")]  # ties
    return rows


def brute(rows, min_docs=3, top=200):
    count, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        groups[lang].add(source)
        count[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in in_docs[lang].items() if n >= min_docs), key=lambda t: t.encode())
        share = lambda c, total: 1 + 10**9 * (c + 1) // (total + len(kept))
        p, all_of = {}, Counter()
        for s in sources:
            total = sum(count[lang, s][t] for t in kept)
            p[s] = {t: share(count[lang, s][t], total) for t in kept}
            all_of.update({t: count[lang, s][t] for t in kept})
        q = {t: share(all_of[t], sum(all_of.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, top)):
                for rank, (x, item) in enumerate(sorted(found, key=lambda v: (-v[0], v[1].encode()))[:limit], 1):
                    out.append((lang, s, part, item, x, rank))
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    rows = sample()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(map(tuple, op12.audit(docs).collect())) == brute(rows)
    monkeypatch.setattr(op12, "MAX_GROUPS", 0)  # totals joined, not broadcast
    assert sorted(map(tuple, op12.audit(docs).collect())) == brute(rows)


def test_small_tries_pieces_and_sums(spark, monkeypatch):
    """Tries, pieces of texts, pairs and sums are cut everywhere, and candidates to a few: the same rows but for those ranks."""
    rows = sample()
    for name, x in (("MAX_COUNTERS", 10), ("MAX_WAITING", 5), ("PIECE", 7), ("PAIRS", 3), ("ROWS", 3)):
        monkeypatch.setattr(op12, name, x)
    streams = op12.Streams(4)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert sorted(map(tuple, op12.audit(docs, top=4).collect())) == brute(rows, top=4)
    for text in (b"", b"ab", b"ab cd", b"a" * 30 + b" b", b" " * 30, "日本語 日本語 日本語 x".encode()):
        parts = list(op12.pieces(text))
        assert b"".join(parts) == text and [t for p in parts for t in op12.TERM.findall(p)] == op12.TERM.findall(text)
    streams.leaves("en", 2, 7, [b"a", b"b"], np.array([0, 3, 4]), ["s", "t", "u", "s"], np.array([1, 2, 3, 1]), np.array([2, 2, 3, 2]))
    assert {k[1:] for k in streams.sums} == {(a, b) for a in "stu" for b in "stu" if a != b}


def test_the_trie_is_an_ordered_map():
    rnd = random.Random(1)
    trie, want = op12.RadixTrie(), defaultdict(Counter)
    for _ in range(5000):
        term = bytes(rnd.choices(b"ab\xc3\xa9\xff", k=rnd.randrange(1, 7)))
        source = rnd.choice("xyz")
        trie.add(source, {term: 2})
        want[term][source] += 2
    assert [(t, x.counts) for t, x in trie.leaves()] == sorted((t, dict(c)) for t, c in want.items())
    assert trie.counters == sum(map(len, want.values()))


def test_shares_are_exact():
    rnd = random.Random(2)
    counts, of = [], []
    for _ in range(3000):
        n = rnd.choice([1, 7, 10**3, 10**9, 9 * 10**15 - 1])
        counts.append(rnd.randrange(n))
        of.append(n)
    got = op12.shares(np.array(counts), np.array(of))
    assert got.tolist() == [1 + 10**9 * (c + 1) // n for c, n in zip(counts, of)]


def test_a_very_long_text_and_an_empty_table(spark):
    assert op12.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "eins zwei " * 400_000 + "x" * 3_000_000
    rows = [(1, long, "de", "a", "", 0.0), (2, "eins", "de", "b", "", 0.0), (3, "eins zwei", "de", "b", "", 0.0), (4, "zwei", "de", "c", "", 0.0)]
    assert sorted(map(tuple, op12.audit(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)
