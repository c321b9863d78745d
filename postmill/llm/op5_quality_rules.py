"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: ledger() stores the measurements and one bit per failed
rule. A policy is a versioned mask of the bits that reject; apply_policy() and ablate() only do
bit arithmetic on the ledger, so a new policy never reads a text again.

Defined cases: a null or empty text has no words, all measurements 0, and fails `few_words`. Repeated
rows and doc_ids, null ones too, each keep their own row. Extra columns are not read. An empty table gives no rows. A
text takes about 60 bytes of memory for each of its own while its task works on it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.blocks import Words, blocks, hashes, per_doc_keys, repeated
from postmill.llm.common import documents, narrow, saved, ship, text_digest, without

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
ALPHA = np.zeros(256, bool)
ALPHA[65:91] = ALPHA[97:123] = ALPHA[0xC3:0xF5] = True  # letters, and the first byte of characters past Latin-1 signs
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
WINDOW = 8
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha", "n_upper")


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each whole text, an array a field."""
    out = {k: [] for k in FIELDS}
    for b in blocks(texts):
        w = Words(b)
        first_byte = (b.data & 0xC0) != 0x80
        # lines with a word; a line ends before its \n or with its document
        cuts = np.flatnonzero(b.data == 10)
        start = np.sort(np.concatenate([b.off[:-1], cuts + 1]))
        doc = np.searchsorted(b.off, start, "right") - 1
        end = np.concatenate([start[1:], [len(b.data)]])
        end = end - ((end > start) & (b.data[np.maximum(end - 1, 0)] == 10) if len(b.data) else 0)
        solid = np.zeros(len(b.data) + 1, np.int64)
        np.cumsum(w.solid, out=solid[1:])
        keep = solid[end] > solid[start]
        start, end, doc = start[keep], end[keep], doc[keep]
        lines = np.bincount(doc, minlength=b.n)
        _, at = np.unique(per_doc_keys(hashes(b.data, start, end), doc), return_index=True)
        out["n_dup_lines"].append(lines - np.bincount(doc[at], minlength=b.n))
        out["n_lines"].append(lines)
        at, h = w.windows(WINDOW)
        twice = at[repeated(per_doc_keys(h, w.doc[at]))]
        cover = np.zeros(len(w.h) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + WINDOW, -1)
        inside = np.cumsum(cover)[:-1] > 0
        out["n_repeat_words"].append(np.bincount(w.doc[inside], minlength=b.n))
        out["n_words"].append(w.n)
        out["word_chars"].append(b.per_doc(w.solid & first_byte))
        for k, table in (("n_symbols", SYMBOLS), ("n_alpha", ALPHA), ("n_upper", UPPER)):
            out[k].append(b.per_doc(table[b.data]))
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in out.items()}


@dataclass(frozen=True)
class Rule:
    """bit: its place in the ledger, never reused. fails: a condition over the measurements, be they columns or arrays."""

    bit: int
    name: str
    fails: Callable[[Mapping], Any]


RULES = (
    Rule(0, "few_words", lambda m: m["n_words"] < 20),
    Rule(1, "repeated_windows", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule(2, "symbol_share", lambda m: 100 * m["n_symbols"] > 5 * m["word_chars"]),
    Rule(3, "mean_word_short", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule(4, "mean_word_long", lambda m: m["word_chars"] > 20 * m["n_words"]),
    Rule(5, "duplicate_lines", lambda m: (m["n_lines"] >= 4) & (100 * m["n_dup_lines"] > 50 * m["n_lines"])),
    Rule(6, "few_letters", lambda m: 100 * m["n_alpha"] < 60 * m["word_chars"]),
    Rule(7, "shouting", lambda m: 100 * m["n_upper"] > 50 * m["n_alpha"]),
)


BASE_MASK = 0b11
#: Versioned policies: a document is rejected if it fails a rule whose bit is set. Old versions stay.
POLICIES = {"v1-base": 0b00000011, "v2-strict": 0b11111111}


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, failures (bit i set: rule i failed)."""
    ship(docs.sparkSession)
    docs = narrow(docs, "doc_id", "text")

    def run(batches):
        for x in batches:
            m = measure(x.column(1))
            yield pa.RecordBatch.from_arrays([x.column(0), *map(pa.array, m.values())], names=["doc_id", *m])

    out = docs.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{k} bigint" for k in FIELDS))
    measured = {k: F.col(k) for k in FIELDS}
    bits = F.lit(0).cast("bigint")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(r.fails(measured), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint"))
    return out.withColumn("failures", bits)


def apply_policy(led: DataFrame, version: str = "v2-strict") -> DataFrame:
    """Adds base_failed and kept under a policy."""
    f = F.col("failures")
    return led.withColumn("base_failed", f.bitwiseAND(F.lit(BASE_MASK)) != 0).withColumn("kept", f.bitwiseAND(F.lit(POLICIES[version] | BASE_MASK)) == 0)


def ablate(led: DataFrame, version: str = "v2-strict") -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that the policy keeps without it."""
    mask, f = POLICIES[version], F.col("failures")
    hit = f.bitwiseAND(F.lit(mask))
    per = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in RULES if mask >> r.bit & 1]
    counts = led.groupBy(hit.alias("hit")).count()  # at most 2 ** rules rows go on
    x = counts.select("*", F.explode(F.array(*per)).alias("r"))
    bit = F.col("r.bit")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0))
    return x.groupBy(F.col("r.rule").alias("rule")).agg(
        n(F.col("hit").bitwiseAND(bit) != 0).alias("n_failed"),
        n(F.col("hit") == bit).alias("n_only_this"),
        n(F.col("hit").bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept_without"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_policy(ledger(documents(spark, sf_dir)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


def judged(docs: DataFrame, column: str = "ledger") -> DataFrame:
    """The pipeline's ledger: doc_id, the text's digest, a struct of failures and measurements; written, without texts."""
    ship(docs.sparkSession)
    kind = T.StructType([T.StructField(k, T.LongType()) for k in ("failures", *FIELDS)])

    def run(batches):
        for x in batches:
            m = measure(x.column(2))
            bits = np.zeros(x.num_rows, np.int64)
            for r in RULES:
                bits |= np.where(r.fails(m), 1 << r.bit, 0)
            row = pa.StructArray.from_arrays([pa.array(bits), *map(pa.array, m.values())], names=["failures", *m])
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), row], names=["doc_id", "digest", column])

    rows = narrow(docs, "doc_id", "text").select("doc_id", text_digest(F.col("text")).alias("digest"), "text")
    return saved(rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], T.StructField(column, kind)])), "ledger")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the policy keeps, by the bits of their written ledger; equal texts fail alike."""
    mask = POLICIES["v2-strict"] | BASE_MASK
    return without(docs, judged(docs).filter(F.col("ledger.failures").bitwiseAND(F.lit(mask)) != 0).select("digest").distinct())


#: The query in DuckDB SQL (for tables whose doc_id is unique).
SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
x as (select doc_id, i, array_to_string(ws[i : i + 7], ' ') as win from (select doc_id, ws, unnest(generate_series(1, len(ws) - 7)) as i from w)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as n from x) where n > 1),
c as (select doc_id, count(distinct i + k) as n from r, (select unnest(generate_series(0, 7)) as k) group by 1),
m as (select w.doc_id, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, len(ls) as n_lines, length(regexp_replace(t, '[^A-Za-z\x{C0}-\x{10FFFF}]', '', 'g')) as n_alpha, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper
  from w left join c on w.doc_id = c.doc_id),
b as (select *, cast((n_words < 20)::int + 2 * (100 * n_repeat_words > 30 * n_words)::int + 4 * (100 * n_symbols > 5 * word_chars)::int + 8 * (word_chars < 2 * n_words)::int + 16 * (word_chars > 20 * n_words)::int
  + 32 * (n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines)::int + 64 * (100 * n_alpha < 60 * word_chars)::int + 128 * (100 * n_upper > 50 * n_alpha)::int as bigint) as failures from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 as base_failed, failures = 0 as kept, failures from b"""
