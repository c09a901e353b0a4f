"""What the encoder learns again, and that the table of pieces met most often changes no result."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from lapwise.llm import byte_bpe, pieces


def as_block(texts):
    """UTF-8 bytes and row offsets of texts."""
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def byte_values(found):
    """Stands for an encoder: the ids of a piece are its bytes."""
    return np.frombuffer(b"".join(found), dtype=np.uint8).astype(np.int32), np.array([len(p) for p in found], dtype=np.int64)


def test_common_pieces_are_learned_once():
    """2,000 words that stand in every block are encoded once, though 400,000 others pass through the table between."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
    tool = byte_bpe.Encoder(byte_bpe.merge_table(ranks), byte_ids, byte_bpe._vocabulary(ranks), public_tokenizers.PATTERN, True)
    learned, learn = Counter(), tool.table.learn

    def counted(found):
        learned.update(found)
        return learn(found)

    tool.table.learn = counted
    common = "".join(f" common{k}" for k in range(2000)) * 2
    for begin in range(0, 400_000, 20_000):
        texts = [common, "".join(f" {k:x}" for k in range(begin, begin + 20_000))]
        ids, cuts = tool.encode(*as_block(texts))
        assert tool.decoder.decode(ids, np.diff(cuts)) == [t.encode() for t in texts]
    tool.close()
    assert {learned[f" common{k}".encode()] for k in range(2000)} == {1}


@pytest.mark.parametrize("hashed", [None, lambda data, bounds: np.zeros(len(bounds) - 1, dtype=np.uint64), lambda data, bounds: np.diff(bounds).astype(np.uint64)])
def test_table_of_often_met_pieces_equals_plain_bytes(monkeypatch, hashed):
    """Empty rows, one text over the hashed part, many forgettings; also where all pieces, or all of a size, share a hash."""
    if hashed:
        monkeypatch.setattr(pieces, "_hashes", hashed)
    rng = np.random.default_rng(0)
    for bytes_kept in (1 << 20, 2000):
        table = pieces.OftenTable(byte_values, 300, 200, bytes_kept)
        for _ in range(30):
            texts = ["".join(rng.choice(list("abÃ©ß., \n 🙂"), rng.integers(0, 60))) for _ in range(40)] + ["", "z" * 70_000 + " end"]
            data, offsets = as_block(texts)
            ids, cuts = table.encode(data, offsets)
            assert ids.tolist() == data.tolist() and cuts.tolist() == offsets.tolist()
            assert len(table.known) == len(table.met) == len(table.hashes) == len(table.ends) - 1
        assert table.encode(np.zeros(0, dtype=np.uint8), np.zeros(3, dtype=np.int64))[1].tolist() == [0, 0, 0]


def test_words_that_are_not_split_are_letters():
    """Every character up to U+0300: taken as one word exactly if Python calls it a letter of the Latin blocks."""
    import pyarrow as pa
    import pyarrow.compute as pc

    signs = [chr(k) for k in range(0x300)]
    for form in ("x{}", "{}x", " x{}x"):
        found = pc.match_substring_regex(pa.array([form.format(c) for c in signs]), byte_bpe.ONE_WORD).to_pylist()
        assert found == [(c.isalpha() and c <= "ɏ") or (form == "{}x" and c == " ") for c in signs]
    assert not any(pc.match_substring_regex(pa.array(["", " ", "  x", "x\n", "\nx", "x "]), byte_bpe.ONE_WORD).to_pylist())
