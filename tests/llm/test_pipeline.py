"""The pipeline against the brute-force versions of its operators, one stage after the other."""

import os

import corpus_pipeline
import pytest
import tiktoken

from postmill.llm import op6_byte_bpe as op6
from postmill.llm import op8_decontamination as op8
from postmill.llm import op10_secret_scan as op10
from tests.llm import test_op3, test_op5, test_op8, test_op10


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents that every stage has something to do with."""
    d = str(tmp_path_factory.mktemp("pipe"))
    items, leaking = test_op8.corpus()
    texts = [t for _, t in test_op3.corpus()] + leaking + test_op5.texts()
    # words in another order: neither near copies of the others nor benchmark items
    texts += [f"{' '.join(reversed(t.split()))}\npassword=abcdef{i} end of a line with enough words to stay" for i, t in enumerate(leaking[14:34])]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_match_brute_force(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}

    def good(t):
        n, chars, symbols, _, repeats = test_op5.brute(t)
        lines = [x for x in (t or "").split("\n") if test_op5.WORD.search(x)]
        letters = sum(65 <= b < 91 or 97 <= b < 123 or 0xC3 <= b < 0xF5 for b in (t or "").encode())
        upper = sum(65 <= b < 91 for b in (t or "").encode())
        dup = len(lines) - len(set(lines))
        return not (n < 20 or 100 * repeats > 30 * n or 100 * symbols > 5 * chars or chars < 2 * n or chars > 20 * n or (len(lines) >= 4 and 2 * dup > len(lines)) or 100 * letters < 60 * chars or 100 * upper > 50 * letters)

    docs = {d: t for d, t in docs.items() if good(t)}
    docs = {d: docs[d] for d, _, _, kept in test_op3.at_percent(80, sorted(docs.items())) if kept}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    ids = sorted(docs)
    bad = {ids[k] for k, _ in test_op8.brute(items, [docs[d] for d in ids])}
    docs = {d: t for d, t in docs.items() if d not in bad}
    secrets = {d: test_op10.brute(t) for d, t in docs.items()}
    assert bad and any(secrets.values())
    docs = {d: op10.redact(t, secrets[d]) for d, t in docs.items()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert got.keys() == docs.keys() and len(docs) > 20
    bpe = op6.ByteBPE()
    enc = tiktoken.Encoding("t", pat_str=__import__("public_tokenizers").PATTERN, mergeable_ranks={p: i for i, p in enumerate(bpe.piece)}, special_tokens={})
    for d, t in docs.items():
        assert got[d].n_tokens == len(enc.encode_ordinary(t)), d


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    os.symlink(f"{folder}/benchmark.parquet", f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert op8.indexes(spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 1
