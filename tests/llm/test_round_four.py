"""What workers and shuffles carry: bounds that larger inputs would break."""

import numpy as np
import public_tokenizers

from lapwise.llm import byte_bpe, minhash, similar_sets


def test_encoder_keeps_few_pieces():
    """300,000 different words: a worker holds the pieces of half of them at most, and the ids still give the text back."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
    tool = byte_bpe.Encoder(byte_bpe.merge_table(ranks), byte_ids, byte_bpe._vocabulary(ranks), public_tokenizers.PATTERN, True)
    for begin in range(0, 300_000, 20_000):
        text = "".join(f" {k:x}" for k in range(begin, begin + 20_000)).encode()
        data, offsets = np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)])
        ids, cuts = tool.encode(data, offsets)
        assert tool.decoder.decode(ids, np.diff(cuts)) == [text]
        assert len(tool.table.known) <= byte_bpe.PIECES_KEPT + 20_000 <= 200_000
    tool.close()


def test_stage_runs_in_small_batches(spark):
    """The ids come from a table that was written in batches of few rows, and the session's batches are as before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    docs = spark.createDataFrame([(k, "web", f"text number {k}") for k in range(1000)], "doc_id long, source string, text string")
    out = byte_bpe.bpe_stage(spark, docs, "")
    assert not any(word in out._jdf.queryExecution().executedPlan().toString() for word in ("MapInArrow", "PythonMapInArrow"))
    assert spark.conf.get(name) == was and out.count() == 1000


def test_minhash_rounds_read_only_nodes_of_shared_buckets(spark, monkeypatch):
    """200 texts that share no bucket never reach the steps that verify pairs; the copies with a changed word do, and link."""
    asked = []

    def counted(texts, pairs, sketches, words):
        asked.append((texts.count(), sketches.count()))
        return similar_sets.similar(texts, pairs, sketches, words)

    monkeypatch.setattr(minhash, "similar", counted)
    near = [(k, " ".join(f"w{j}" for j in range(100)) + f" end{k}") for k in range(6)]
    apart = [(k, " ".join(f"x{k}y{j}" for j in range(30))) for k in range(100, 300)]
    rows = minhash.group_by_minhash(spark.createDataFrame(near + apart, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {k: 0 if k < 6 else k for k, _ in near + apart}
    assert asked and max(max(x) for x in asked) <= 6
