import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from postmill.llm import op6_byte_bpe as op6


@pytest.fixture(scope="module")
def enc():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(op6.VOCABULARY), "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(6)
    alphabet = "abcde  \n\t.,'\"AZé日本🙂▁<|\x00Ā0123456789-ñ\r"
    out = [None, "", " ", "   a", "hello world", "<|endoftext|>", "<unk>", "▁▁", "aaaaaaaaaaaaaaaaaaaaaaaaaaa" * 50, "I'll we've 1234567"]
    out += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 400))) for _ in range(300)]
    return out + [bytes(range(1, 128)).decode() * 3, "lorem ipsum dolor sit amet " * 3000]


def test_same_ids_as_tiktoken_and_exact_round_trip(spark, enc):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in op6.round_trip(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), t
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_encode_then_decode_gives_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id bigint, text string")
    back = {r.doc_id: r.text for r in op6.decode(op6.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts())}


def test_every_vocabulary_entry_encodes_as_tiktoken(enc):
    bpe = op6.ByteBPE()
    words = [v.decode() for v in bpe.piece[:50256:7] if _text(v)]
    for w in words:
        assert np.frombuffer(bpe.encode(w), "<u4").tolist() == enc.encode_ordinary(w)


def _text(v):
    try:
        return v.decode()
    except UnicodeDecodeError:
        return ""


def test_empty_table(spark):
    assert op6.round_trip(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_every_character_beside_letters_digits_and_spaces(enc):
    """The engines' Unicode tables differ; the ids may not."""
    bpe = op6.tokenizer()
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    for k in range(0, len(points), 400):
        text = "".join(f"a{chr(c)}鴜 {chr(c)}1{chr(c)}{chr(c)} \n" for c in points[k : k + 400])
        if np.frombuffer(bpe.encode(text), "<u4").tolist() != enc.encode_ordinary(text):
            for c in points[k : k + 400]:
                text = f"a{chr(c)}鴜 {chr(c)}1{chr(c)}{chr(c)} \n"
                assert np.frombuffer(bpe.encode(text), "<u4").tolist() == enc.encode_ordinary(text), hex(c)
    r = random.Random(66)
    odd = [chr(c) for c in op6.stand_ins()[0]]
    for _ in range(3000):
        text = "".join(r.choice([chr(r.choice(points)), r.choice(odd or ["x"]), r.choice("aZ 1.\n'")]) for _ in range(r.randint(1, 12)))
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == enc.encode_ordinary(text), ascii(text)
