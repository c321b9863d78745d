import random

import numpy as np
from postmill.llm import op9_training_order as op9


def test_permutation_is_keyed_and_invertible():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        p = op9.Permutation(n)
        s = p.slot(np.arange(n))
        assert sorted(s.tolist()) == list(range(n)) and (p.sequence(s) == np.arange(n)).all()
    assert (op9.Permutation(1000, 1).slot(np.arange(1000)) != op9.Permutation(1000, 2).slot(np.arange(1000))).any()


def texts():
    r = random.Random(9)
    return [None, "", "a", "naïve 日本"] + [" ".join(r.choice(["the", "of", "Ünder", "x1"]) for _ in range(r.randint(1, 300))) for _ in range(80)] + ["word " * 5000]


def test_shards_hold_every_token_in_the_keyed_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op9, "SEQUENCES", 16)
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(3, "same id", "x"), (2, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, slot string").repartition(5)
    length = 64
    got = sorted(op9.materialise(df, str(tmp_path), length).collect(), key=lambda r: r.slot)
    enc = op9._encoding(op9.VOCABULARY)
    want = sorted(tuple(enc.encode_ordinary(t or "")) for _, t, _ in rows)
    assert [r.slot for r in got] == list(range(len(got)))
    assert all(r.byte_offset == (r.slot % 16) * 2 * length and r.shard == r.slot // 16 for r in got)
    read = list(op9.Shards(str(tmp_path), len(got), length).read())
    by_sequence = [read[r.slot] for r in sorted(got, key=lambda r: r.sequence)]
    flat = np.concatenate(by_sequence)[: sum(r.n_tokens for r in got)].tolist()
    docs, now = [], []
    for t in flat:
        if t == op9.END:
            docs.append(tuple(now))
            now = []
        else:
            now.append(t)
    assert not now and sorted(docs) == want
    assert {d for r in got for d in r.doc_ids} == {d for d, _, _ in rows}
    resumed = list(op9.Shards(str(tmp_path), len(got), length).read(21))
    assert len(resumed) == len(got) - 21 and all((a == b).all() for a, b in zip(resumed, read[21:], strict=True))


def test_a_second_run_gives_the_same_order(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id bigint, text string").repartition(3, "doc_id").sortWithinPartitions("doc_id")
    a = op9.materialise(df, f"{tmp_path}/a", 128)
    b = op9.materialise(df, f"{tmp_path}/b", 128)
    assert sorted(a.collect()) == sorted(b.collect())


def test_empty(spark, tmp_path):
    assert op9.materialise(spark.createDataFrame([], "doc_id bigint, text string"), str(tmp_path)).count() == 0


def test_the_order_does_not_depend_on_files_or_partitions(spark, tmp_path):
    rows = list(enumerate(texts())) + [(None, "no id"), (None, "no id either"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = []
    for k, x in enumerate((df.coalesce(1), df.repartition(7), df.orderBy("text").coalesce(2))):
        m = op9.materialise(x, f"{tmp_path}/{k}", 128)
        got.append((sorted((r.slot, r.sequence, r.n_tokens, r.sha256, sorted(r.doc_ids, key=str)) for r in m.collect()), [b.tobytes() for b in op9.Shards(f"{tmp_path}/{k}", m.count(), 128).read()]))
    assert got[0] == got[1] == got[2]


def test_a_second_attempt_leaves_a_whole_shard(tmp_path):
    fs, top = op9._open(str(tmp_path))
    for name, body in (("a", b"one"), ("b", b"one"), ("c", b"other")):
        with fs.open_output_stream(f"{top}/{name}") as f:
            f.write(body)
        op9.commit(fs, f"{top}/{name}", f"{top}/shard")
        assert (tmp_path / "shard").read_bytes() == body and [x.name for x in tmp_path.iterdir()] == ["shard"]


def test_a_folder_holds_its_last_run(spark, tmp_path):
    """Another key, other documents, fewer of them: the slots are the new manifest's, and no shard of the old run is left."""
    import hashlib

    docs = spark.createDataFrame([(i, f"text number {i} " * 40) for i in range(120)], "doc_id bigint, text string")
    other = docs.selectExpr("doc_id", "reverse(text) as text")
    (tmp_path / ".shard-00000000.bin.0123456789abcdef0123456789abcdef").write_bytes(b"an attempt that was lost")
    (tmp_path / "notes.txt").write_text("stays")
    for rows, key in ((docs, 1), (docs, 2), (other, 2), (docs.limit(3), 1)):
        m = sorted(op9.materialise(rows, str(tmp_path), 8, key=key).collect(), key=lambda r: r.slot)
        read = [b.tobytes() for b in op9.Shards(str(tmp_path), len(m), 8).read()]
        assert [hashlib.sha256(b).hexdigest() for b in read] == [r.sha256 for r in m]
        names = {op9.file_name(r.shard) for r in m}
        assert {x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")} == names | {"notes.txt"}
