"""Fill-in-the-middle rewriting of whole texts, as an Arrow-batched pandas UDF.

A text is cut into units: a word with the white space before it, or white space that no word follows. The offsets at
which units end are kept in a compact array (four bytes a unit), so a cut is one look-up and a slice. Where to cut, and
whether and in which order to write the parts, follows from a keyed digest of the document's id: the same document is
written alike in every run, in whatever partition it stands.

Defined cases: a null text is the empty one, which is written plainly (n 0, no cut). A null doc_id has the digest of
the seed alone. A text that contains a sentinel is written plainly, so the parts of any other text can be found again
(restored()). Repeated rows each keep their own row, extra columns are not read, an empty table gives no rows. A very
long text is never cut short; while its task works on it, it takes up to about 20 bytes of memory for each of its own
(the text, its output and the restored text, as UTF-8 and as Python strings of up to four bytes a character, and
the offsets).
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import documents, narrow, ship

UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: Before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
SEED = 42
#: Percent of texts that are rewritten, and of those the percent that begin with the suffix.
RATE, SPM_RATE = 50, 80


def unit_ends(text: str) -> array:
    """Offsets, in code points, at which the text's units end."""
    return array("I", (m.end() for m in UNIT.finditer(text)))


def numbers(seed: int, doc_id: str | None) -> list[int]:
    """Four 32-bit numbers that belong to the document's id."""
    d = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).digest()
    return [int.from_bytes(d[k : k + 4], "big") for k in range(0, 16, 4)]


def rewritten(text: str, doc_id: str | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """Units, form (plain, spm or psm), code points of prefix and middle (None if plain), and the text to be trained on."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = numbers(seed, doc_id)
    if not text or h3 % 100 >= rate or any(s in text for s in SENTINELS):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    if h4 % 100 < spm_rate:
        form, parts = "spm", (SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b])
    else:
        form, parts = "psm", (PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b])
    return n, form, a, b - a, "".join(parts)


def restored(output: str, form: str) -> str:
    """The text that was rewritten. No part holds a sentinel, and none arises where a part and a sentinel meet (each
    begins with `<`, which it has nowhere else), so the first of each is the one that was written."""
    if form == "plain":
        return output
    one, two = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, middle = output.removeprefix(one).split(MIDDLE, 1)
    x, y = head.split(two, 1)
    return (y + middle + x) if form == "spm" else (x + middle + y)


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: the text as it is trained on."""
    ship(docs.sparkSession)

    @F.pandas_udf("n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [rewritten(t or "", k, seed, rate, spm_rate) for k, t in zip(ids, texts)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"n": "Int64", "prefix_chars": "Int64", "middle_chars": "Int64", "form": object, "output": object})

    # an id with nulls beside it would reach pandas as a float, so it travels as its digits
    x = narrow(docs, "doc_id", "text").select("doc_id", cut(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).alias("r"))
    return x.select("doc_id", "r.*")


def with_digests(rewritten_docs: DataFrame) -> DataFrame:
    """Adds output_sha256, and restored_sha256 of what is rebuilt from output and form alone."""

    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def digests(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        rows = [(hashlib.sha256(x.encode()).hexdigest(), hashlib.sha256(restored(x, form).encode()).hexdigest()) for x, form in zip(outputs, forms)]
        return pd.DataFrame(rows, columns=["output_sha256", "restored_sha256"])

    x = rewritten_docs.withColumn("_d", digests("output", "form"))
    return x.select(*rewritten_docs.columns, "_d.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(transform(documents(spark, sf_dir))).drop("output")


#: The query in DuckDB SQL.
SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as us, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3,
    ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, cast(len(us) as bigint) as n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) as a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
p as (select doc_id, t, n, form, array_to_string(us[1:a], '') as pre, array_to_string(us[a + 1:b], '') as mid, array_to_string(us[b + 1:], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256
from p"""
