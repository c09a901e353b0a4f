"""The corpus operators against brute force, round trips and held-out labels on small fixtures with awkward rows."""

import base64
import collections
import hashlib
import io
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from lapwise.llm import ann, byte_bpe, line_dedup, mixing, quality_classifier, quality_rules, simhash, token_files, toxicity, warc
from lapwise.llm.components import components, forest
from lapwise.llm.scratch import fresh_path, written
from tests.oracle import check

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"w{i}x" for i in range(60))
#: Nulls, empty and very long texts, ties, repeated rows, odd characters.
ROWS = [
    (1, "The quick brown fox, it's 12 o'clock.\n\nAnd  then?", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n ", "fr", "b"),
    (5, "é́ñ文字 😀 x y z " * 3, "zz", "b"),
    (6, "a" * 5000 + " " * 300 + "end", "en", "c"),
    (7, "The quick brown fox, it's 12 o'clock.\n\nAnd  then?", "en", "a"),
    (7, "The quick brown fox, it's 12 o'clock.\n\nAnd  then?", "en", "a"),
    (8, f"first words here {PASSAGE} tail one", "en", "c"),
    (9, f"other start {PASSAGE}\nand another tail", "en", "c"),
    (None, "a row without an id", "en", "d"),
    (10, "<|endoftext|> THE QUICK brown", "en", None),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns with the names that operators use for their own."""
    clash = ["score", "ids", "mix", "row", "position", "_words", "hash", "size"]
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("own") for c in clash}).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def arrow_text(texts):
    """UTF-8 bytes and row offsets of texts."""
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_the_library_and_decodes(spark, docs, nothing):
    tool = tiktoken_encoding()
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded="back")
    for r in byte_bpe.decode(encoded, RANKS, out="again").collect():
        assert r["ids"] == tool.encode_ordinary(r["text"] or "")
        assert bytes(r["back"]) == bytes(r["again"]) == (r["text"] or "").encode()
    assert byte_bpe.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_long_words_equals_the_library():
    """Words of up to 100,000 letters, also of parts whose merges make pairs of lower rank; with cuts before the pattern and without."""
    tool, ranks, rng = tiktoken_encoding(), byte_bpe.read_ranks(RANKS), np.random.default_rng(0)
    lower = [t.decode() for t in ranks if len(t) > 1 and t.isalpha() and t.isascii()]
    letters = list("abcdefghijklmnopqrstuvwxyz")
    words = ["".join(rng.choice(letters, 100_000)), "a" * 5001, "ab" * 3000, "=" * 3000, "".join(rng.choice(list("=-*#_"), 4000)), "".join(rng.choice(list("ACGT"), 5000)), "Ã" * 900]
    words += ["".join(rng.choice(lower, 40)) for _ in range(100)] + ["".join(rng.choice(list("aeshint"), rng.integers(150, 300))) for _ in range(100)]
    table = byte_bpe.merge_table(ranks), np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32), byte_bpe._vocabulary(ranks), public_tokenizers.PATTERN
    for cut_first in (True, False):
        ids, cuts = byte_bpe.Encoder(*table, cut_first).encode(*arrow_text(words))
        for word, a, b in zip(words, cuts[:-1], cuts[1:], strict=True):
            assert ids[a:b].tolist() == tool.encode_ordinary(word)


def test_bpe_rejects_unknown_ids(spark):
    with pytest.raises(Exception, match="vocabulary"):
        byte_bpe.decode(spark.createDataFrame([([1, 50256],)], "ids array<int>"), RANKS).collect()


def test_op1_digests(spark):
    tool = tiktoken_encoding()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in byte_bpe.op1_byte_bpe(spark, SF).collect():
        ids = tool.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_token_files_round_trip(spark, docs, nothing):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(JSON)
    manifest = written(token_files.write_token_files(docs, fresh_path(spark, "t"), JSON, end_id=2, shard_bytes=200), "m")
    found = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r["start"])
    start = 0
    for r, (_, text) in zip(found, sorted(((i if i is not None else -1), t or "") for i, t, *_ in ROWS), strict=True):
        ids = tool.encode(text, add_special_tokens=False).ids + [2]
        assert r["start"] == start and np.frombuffer(r["ids"], dtype="<u4").tolist() == ids
        start += len(ids)
    empty = written(token_files.write_token_files(nothing, fresh_path(spark, "t"), JSON, end_id=2), "m")
    assert token_files.read_token_files(empty).count() == 0


def test_pieces_equal_whole_texts():
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(JSON)
    rng = np.random.default_rng(0)
    letters = list("    \t\n\r\x1c\x1d\x85\xa0\u2003\u1680\u3000 aAbz'sT09²ñ文字!?.,;:-_=|é×÷é́😀") + ["'re", "<|endoftext|>", "the", " of"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(4000)] + ["word " * 200_000]
    ids, cuts = token_files.PieceTokenizer(JSON).encode(*arrow_text(texts))
    for text, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True):
        assert ids[a:b].tolist() == tool.encode(text, add_special_tokens=False).ids


def test_token_file_reads_one_frame_and_checks_it(tmp_path):
    uri = f"file://{tmp_path}/a.lwtok"
    out = token_files.FileWriter(uri)
    for n, key in enumerate(["a", None, "c", 'd"\n', "a"]):
        out.add(key, np.arange(n * 10, dtype="<u4").tobytes())
    out.close()
    reader = token_files.FileReader(uri)
    assert reader.find("a") == [0, 4] and reader.find(None) == [1] and reader.find('d"\n') == [3] and reader.find("x") == []
    assert len(reader) == 5 and reader.read(3) == np.arange(30, dtype="<u4").tobytes()
    raw = bytearray((tmp_path / "a.lwtok").read_bytes())
    entry = reader.entries[3]
    raw[int(entry["offset"]) + int(entry["size"]) - 6] ^= 1
    (tmp_path / "a.lwtok").write_bytes(raw)
    assert token_files.FileReader(uri).read(2) == np.arange(20, dtype="<u4").tobytes()
    with pytest.raises(Exception):
        token_files.FileReader(uri).read(3)


def test_a_document_is_found_by_its_id(spark, docs):
    """The manifest names the one shard, the shard's table the frame; every shard's keys lie within its first and last."""
    manifest = written(token_files.write_token_files(docs, fresh_path(spark, "t"), JSON, end_id=2, shard_bytes=150), "m").collect()
    assert len(manifest) > 3
    tool = token_files.PieceTokenizer(JSON)
    for doc_id, text in ((1, ROWS[0][1]), (9, ROWS[9][1]), (None, ROWS[10][1])):
        shards = [m for m in manifest if (m["first"] is None if doc_id is None else (m["first"] is None or m["first"] <= doc_id) and m["last"] is not None and doc_id <= m["last"])]
        found = [token_files.FileReader(m["uri"]).read(k) for m in shards for k in token_files.FileReader(m["uri"]).find(doc_id)]
        assert [np.frombuffer(f, dtype="<u4").tolist() for f in found] == [tool.encode(*arrow_text([text]))[0].tolist() + [2]]


def test_mixing_against_sql(spark):
    check(spark, mixing.op3_mixing, mixing.OP3_SQL)


def test_mixing_awkward_rows(spark, docs, nothing):
    found = mixing.plan_mix(docs.drop("mix")).select("doc_id", "text", "row", "mix.*").collect()
    assert len(found) == len(ROWS) and all(r["taken"] <= 3 * r["size"] and len(r["positions"]) == r["copies"] and r["row"] == "own" for r in found)
    assert all(r["size"] == len(WORD.findall(r["text"] or "")) for r in found)
    assert all(0 <= p <= 1 for r in found for p in r["positions"])
    assert mixing.mix(docs.drop("mix")).count() == sum(r["copies"] for r in found)
    assert mixing.plan_mix(nothing).count() == 0


def test_inverse_schedule_inverts(spark):
    df = spark.createDataFrame([(0.1, 1.0, 3.0), (0.5, 2.0, 2.0), (0.9, 3.0, 1.0)], "share double, a double, b double")
    for r in df.withColumn("u", mixing.inverse_schedule(F.col("share"), F.col("a"), F.col("b"))).collect():
        used = (r["a"] * r["u"] + (r["b"] - r["a"]) * r["u"] ** 2 / 2) / ((r["a"] + r["b"]) / 2)
        assert used == pytest.approx(r["share"])


def test_warc_against_sql(spark):
    check(spark, warc.op4_warc, warc.OP4_SQL)


@pytest.mark.parametrize("version", [1, 2])
def test_warc_awkward_rows(spark, version):
    rows = [(1, "http://a/b c", "<p>x</p>"), (2, None, None), (3, "http://é/", ""), (4, "http://a", "<p>x</p>"), (4, "http://a", "<p>x</p>"), (None, "u", "y\r\n\r\nz\nWARC/1.1"), (5, "u", "é" * 4000)]
    pages = warc.with_revisits(spark.createDataFrame([(None if i is None else str(i), u, h) for i, u, h in rows] + [("", "e", "own\n"), ("a\r\nb", "f", "<p>x</p>")], "page_id string, url string, html string").withColumns({c: F.lit("own") for c in ("record_type", "tag", "sha", "first", "id")}))
    files = written(warc.convert_arc(written(warc.write_arc(pages, fresh_path(spark, "a"), version=version), "a"), fresh_path(spark, "w")), "w")
    found = warc.read_warcs(files).collect()
    assert len(found) == len(rows) + 2
    kinds = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in found)
    assert kinds == {("1", "response", None): 1, ("2", "response", None): 1, ("3", "revisit", "2"): 1, ("4", "revisit", "1"): 2, (None, "response", None): 1, ("5", "response", None): 1, ("", "response", None): 1, ("a\r\nb", "revisit", "1"): 1}
    sizes = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in found}
    assert sizes["5"] == (8000, base64.b32encode(hashlib.sha1(("é" * 4000).encode()).digest()).decode())
    records = {r["record_id"]: r["page_id"] for r in found}
    assert len(records) == len(found) and all(records[r["refers_to_record"]] == r["refers_to"] for r in found if r["record_type"] == "revisit")


def test_a_wrong_payload_header_is_refused(spark, tmp_path):
    """A WARC whose payload is not what its header says is not read."""
    import gzip

    pages = warc.with_revisits(spark.createDataFrame([("1", "http://a", "<p>x</p>")], "page_id string, url string, html string"))
    uri = written(warc.convert_arc(written(warc.write_arc(pages, fresh_path(spark, "a")), "a"), fresh_path(spark, "w")), "w").first()["uri"]
    fs, path = token_files.open_at(uri)
    raw = gzip.decompress(fs.open_input_file(path).read())
    for old, new in ((b"X-Payload-Length: 8", b"X-Payload-Length: 9"), (b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:A")):
        assert old in raw
        (tmp_path / "bad.warc.gz").write_bytes(gzip.compress(raw.replace(old, new)))
        with pytest.raises(Exception, match="header names"):
            warc.read_warcs(spark.createDataFrame([(f"file://{tmp_path}/bad.warc.gz",)], "uri string")).collect()


def test_revisits_keep_to_the_least_size_and_have_one_response(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (3, "u", "abc"), (4, "u", "abc"), (None, "u", "z"), (None, "u", "z")], "page_id long, url string, html string")
    found = warc.with_revisits(pages, min_bytes=3).collect()
    assert sorted((r["id"], r["original"] and r["original"]["id"]) for r in found if r["original"]) == [(3, 3), (4, 3)]
    assert sum(r["id"] == 3 and r["original"] is None for r in found) == 1
    found = warc.with_revisits(pages.where("page_id IS NULL")).collect()
    assert sorted(r["original"] is None for r in found) == [False, True]
    assert warc.with_revisits(pages.limit(0)).count() == 0


def test_arc_reader_takes_declared_lengths():
    data = warc.arc_version_block(1, "x") + warc.arc_record(1, "u", b"one\ntwo", "x", 0) + warc.arc_record(1, "v", b"", "x", 0)
    assert [(h["URL"], b) for h, b in warc.read_arc(io.BytesIO(data))] == [("u", b"one\ntwo"), ("v", b"")]
    with pytest.raises(ValueError, match="shorter"):
        list(warc.read_arc(io.BytesIO(warc.arc_version_block(1, "x") + b"u i d t 9\nabc")))


def test_ann_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    found = collections.defaultdict(list)
    for r in ann.op5_ann(spark, SF).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        best = [ids[i] for i in np.lexsort((ids, -s)) if i != q][:20]
        hits.append(len(set(best) & {v for v, _ in found[ids[q]]}) / len(best))
        assert all(score == pytest.approx(float(s[np.flatnonzero(ids == v)[0]]), abs=1e-12) for v, score in found[ids[q]])
    assert np.mean(hits) >= 0.9


def test_ann_awkward_rows(spark):
    good = [(i, [float(i % 7) + 1, 1.0, float(i)]) for i in range(30)]
    bad = [(100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 2.0]), (160, [float("nan"), 1.0, 1.0]), (180, [1.0]), (None, [1.0, 2.0, 3.0])]
    same = [(200 + 20 * i, [5.0, 5.0, 5.0]) for i in range(40)]
    df = spark.createDataFrame(good + bad + same, "vec_id long, embedding array<float>").withColumn("score", F.lit("own"))
    found = ann.nearest(df, k=5).orderBy("query_id", "rank").collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r["query_id"]].append((r["vec_id"], r["score"]))
    usable = {i: np.array(v, dtype=np.float64) for i, v in good + same}
    assert set(by) == {i for i in usable if i % 20 == 0}
    for q, got in by.items():
        assert got == sorted(((i, float(v @ usable[q])) for i, v in usable.items() if i != q), key=lambda t: (-t[1], t[0]))[:5]
    assert ann.nearest(df.limit(0)).count() == 0


def exact_nearest(vectors, query, k):
    """(id, score) of the k largest inner products in double precision; vectors: id and array."""
    best = {}
    for i, v in vectors:
        if i != query[0]:
            best[i] = max(best.get(i, -np.inf), float(v @ query[1]))
    return sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k]


def test_ann_keeps_doubles_repeated_ids_and_long_vectors(spark):
    """Doubles that floats round together, ids on several vectors, and a few vectors of a great norm, over several shards and groups."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6)) for i in range(400)] + [(500 + i, np.array([1.0, 0, 0, 0, 0, 1e-12 * i])) for i in range(40)]
    rows += [(600 + i, rng.normal(size=6) * 1e9) for i in range(4)] + [(40, rng.normal(size=6)), (7, rng.normal(size=6) * 3)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    original = ann.search.__kwdefaults__
    ann.search.__kwdefaults__ = {**original, "block_rows": 7, "group_shards": 2}
    try:
        found = ann.nearest(df, k=5, shard_rows=60).collect()
    finally:
        ann.search.__kwdefaults__ = original
    by = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((r["vec_id"], r["score"]))
    arrays = collections.defaultdict(list)
    for i, v in rows:
        arrays[i].append(v)
    for q, got in by.items():
        if len(arrays[q]) == 1:
            want = exact_nearest(rows, (q, arrays[q][0]), 5)
            assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])
        assert q not in [i for i, _ in got] and len({i for i, _ in got}) == 5
    assert set(by) == {i for i in arrays if i % 20 == 0}


def test_ann_beam_grows_on_hard_vectors():
    """Isotropic vectors and a few very long ones beside unit vectors: the shard's own measure keeps the recall."""
    rng, k = np.random.default_rng(0), 20
    hard = rng.normal(size=(3000, 48)).astype(np.float32)
    unit = hard / np.linalg.norm(hard, axis=1, keepdims=True)
    unit[:3] *= 1e4
    for vectors in (hard, unit):
        points = ann.Points.of(vectors)
        graph, entries = ann.build_graph(points)
        shard = {"vec": vectors, "graph": graph, "entries": entries, "ids": np.arange(len(vectors))[:, None]}
        queries = vectors[::30]
        _, ids = ann.search_shard(shard, points, ann.wanted_beam(points, graph, entries, k), queries, k)
        exact = np.argsort(-(queries.astype(np.float64) @ vectors.T.astype(np.float64)), axis=1)[:, :k]
        assert np.mean([len(set(a) & set(b)) / k for a, b in zip(ids.tolist(), exact.tolist(), strict=True)]) >= 0.9


def brute_fingerprint(text, words):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(low))
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


@pytest.mark.parametrize("parts", [2, 4])
def test_simhash_against_brute_force(spark, parts):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in table.collect())
    prints = {i: brute_fingerprint(t, 3) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in prints.items():
        for j, b in prints.items():
            if i < j and (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    original = simhash.links
    simhash.links = lambda p, radius: original(p, radius=radius, parts=parts)
    try:
        found = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.group_near_duplicates(table).collect()}
    finally:
        simhash.links = original
    assert found == {i: (prints[i], find(i)) for i in prints}


def test_simhash_awkward_rows(spark, docs, nothing):
    found = simhash.group_near_duplicates(docs).collect()
    assert len(found) == len(ROWS)
    by = collections.defaultdict(set)
    for r in found:
        by[r["doc_id"]].add((int(r["fingerprint"], 16), r["component_id"]))
    assert by[7] == by[1] and {c for _, c in by[2] | by[3] | by[4]} == {2}
    assert all(by[i] == {(brute_fingerprint(t, 3), next(iter(by[i]))[1])} for i, t, *_ in ROWS)
    assert simhash.group_near_duplicates(nothing).count() == 0


def test_near_dedup_keeps_one_of_each_group(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(1, base), (2, base), (3, base.replace("word150", "other")), (4, " ".join(f"free{i}" for i in range(300))), (5, " ".join(f"word{i}" for i in range(150)) + " " + " ".join(f"more{i}" for i in range(150)))]
    kept = simhash.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5]


def test_components_and_forest(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (None, 4), (2, 1)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20, 5: 5}
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 40, 300), rng.integers(0, 40, 300)
    use = forest(40, a, b, rng.integers(0, 5, 300))
    assert len(use) == 39


def brute_counts(text):
    w = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_base_counts(spark, docs, nothing):
    extra = [(50, "a b c d e f a b c d e f g\nx\nx\n\n#$ <>", "en", "a"), (51, "z " * 40, "de", "a"), (52, "a b c d", "en", "a")]
    rows = ROWS + extra
    found = quality_rules.judge(spark.createDataFrame(rows, SCHEMA).withColumn("_words", F.lit("own")))
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found.collect())
    want = collections.Counter()
    for i, t, *_ in rows:
        n, *rest, again = brute_counts(t)
        want[(i, n, *rest, again, n < 10 or 100 * again > 20 * n)] += 1
    assert got == want
    assert quality_rules.judge(nothing).count() == 0


def test_js_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5])], "p array<double>, q array<double>")
    assert [r[0] for r in df.select(quality_rules.js_distance(F.col("p"), F.col("q"))).collect()] == pytest.approx([1.0, 0.0])


def test_quality_rules_catch_junk_and_keep_the_rest(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = {r["doc_id"]: r for r in quality_rules.op7_quality_rules(spark, sf).collect()}
    good = [found[i]["kept"] for i, q in labels.items() if q == 1 and not found[i]["base_failed"]]
    bad = [found[i]["kept"] for i, q in labels.items() if q == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.05


def accuracy(found, labels, name):
    marked = {r["doc_id"]: r[name] for r in labels.collect()}
    held = [(r["predicted"], marked[r["doc_id"]]) for r in found.collect() if r["held_out"] and r["doc_id"] in marked]
    return np.mean([p == y for p, y in held])


def test_quality_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    assert accuracy(quality_classifier.op8_quality_classifier(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), "quality") >= 0.93


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    assert accuracy(toxicity.op10_toxicity(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), "toxic") >= 0.9


def test_ftrl_against_a_dense_loop():
    """Every coordinate by the published update, one by one."""
    rng, bits = np.random.default_rng(2), 5
    examples = [(int(y), np.unique(rng.integers(0, 32, 6))) for y in rng.integers(0, 2, 60)]
    alpha, beta, l1, l2 = 0.4, 1.0, 0.3, 0.7
    z, n, zb, nb = [0.0] * 32, [0.0] * 32, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else (np.sign(z[i]) * l1 - z[i]) / ((beta + n[i] ** 0.5) / alpha + l2)
    for _ in range(3):
        for y, at in examples:
            w, bias = {i: weight(i) for i in at}, -zb * alpha / (beta + nb**0.5)
            g = 1 / (1 + np.exp(-(sum(w.values()) + bias))) - y
            for i in at:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * bias
            nb += g * g
    found, bias = toxicity.ftrl(examples, bits, 3, alpha, beta, l1, l2)
    assert found == pytest.approx([weight(i) for i in range(32)]) and bias == pytest.approx(-zb * alpha / (beta + nb**0.5))


def test_toxicity_features_against_brute_force():
    texts = ["You, you IDIOT-like thing", "", "one", "a b c d"]
    rows, buckets = toxicity.features(*arrow_text(texts), 40, (3,))
    for r, text in enumerate(texts):
        w = re.findall(r"[a-z0-9]+", text.lower())
        grams = [("1", x) for x in w] + [("p", x[:3]) for x in w if len(x) > 3] + [("2", *x) for x in zip(w, w[1:])] + [("s", *x) for x in zip(w, w[2:])]
        assert (rows == r).sum() == len(grams) and len(set(buckets[rows == r].tolist())) == len(set(grams))


def test_quality_scores_against_direct_compression(spark):
    import zstandard

    rng = np.random.default_rng(1)
    word = lambda kind: f"{kind}{rng.integers(0, 400)}"
    rows = [(i, " ".join(word("calm" if i % 2 else "JUNK!") for _ in range(200)), i % 2) for i in range(400)] + [(500, "calm7 " * 180_000, None), (501, "", None), (502, None, None)]
    texts = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = quality_classifier.fit(texts, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    tools = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d)) for d in (model.good, model.bad)]
    for r in quality_classifier.score(texts, model).collect():
        s = (r["text"] or "").encode()
        good, bad = (len(t.compress(s)) for t in tools)
        want = 1 / (1 + np.exp(-(model.weights[0] + model.weights[1] * (good - bad) / len(s)))) if s else 0.5
        assert r["score"] == pytest.approx(want, abs=1e-6) and (r["doc_id"] >= 500 or (r["score"] > 0.5) == r["doc_id"] % 2)


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_classifiers_awkward_rows(spark, docs, nothing, module):
    rows = [(i, f"good prose number {i} with calm words " * 5, 1) for i in range(20, 30)] + [(i, f"JUNK!! idiot {i} $$$ ### " * 6, 0) for i in range(30, 40)]
    texts = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    name = "quality" if module is quality_classifier else "toxic"
    marks = spark.createDataFrame([(i, y) for i, _, y in rows] + [(20, 1), (1, None), (None, 1)], f"doc_id long, {name} int")
    model = module.fit(texts, marks)
    found = module.score(docs, model).collect()
    assert len(found) == len(ROWS) and all(0 <= r["score"] <= 1 for r in found) and found[0]["hash"] == "own"
    assert module.score(nothing, model).count() == 0
    for labels in (marks.limit(0), marks.where(f"{name} = 1")):
        assert all(0 <= r["score"] <= 1 for r in module.score(docs, module.fit(texts, labels)).collect())


def brute_removed(rows, min_lines=1, min_line_words=2, min_words=50):
    """Words left where runs of lines, and of words, that occur earlier go; rows: id and text, in order."""
    seen, out = set(), []
    for _, text in rows:
        lines = [WORD.findall(line) for line in (text or "").split("\n")]
        words, dead = [w for line in lines for w in line], set()
        for k in range(len(words) - min_words + 1):
            g = tuple(words[k : k + min_words])
            if g in seen:
                dead.update(range(k, k + min_words))
            seen.add(g)
        ends = np.cumsum([len(line) for line in lines]).tolist()
        long = [(e - len(line), e, tuple(line)) for line, e in zip(lines, ends, strict=True) if len(line) >= min_line_words]
        for k in range(len(long) - min_lines + 1):
            g = ("lines", *(line for _, _, line in long[k : k + min_lines]))
            if g in seen:
                dead.update(i for begin, end, _ in long[k : k + min_lines] for i in range(begin, end))
            seen.add(g)
        out.append([w for i, w in enumerate(words) if i not in dead])
    return out


@pytest.mark.parametrize("min_lines", [1, 3, 0])
def test_line_dedup_of_lines_against_brute_force(spark, min_lines):
    """Few different lines, so that runs of all lengths repeat; short lines, white space, words that go on over a break."""
    rng, rows = np.random.default_rng(min_lines), []
    for n in range(120):
        lines = rng.choice(["a b c", "a  b\tc", "d e", "x", "f g h i", "", f"own {n} line"], rng.integers(0, 12))
        rows.append((n, "\n".join(lines) + "\n" * int(rng.integers(0, 2))))
    found = line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), sizes=line_dedup.Sizes(min_lines=min_lines, min_words=12), out_words="gone").collect()
    want = dict(zip([n for n, _ in rows], brute_removed(rows, min_lines, min_words=12), strict=True))
    assert {r["doc_id"]: WORD.findall(r["text"]) for r in found} == want
    assert all(r["gone"] == len(WORD.findall(rows[r["doc_id"]][1])) - len(want[r["doc_id"]]) for r in found)


def test_line_dedup_awkward_rows(spark, docs, nothing):
    found = line_dedup.remove_repeats(docs, out_words="gone").collect()
    assert len(found) == len(ROWS) and all(r["row"] == "own" and r["hash"] == "own" for r in found)
    left = {7: "", 9: "other start\nand another tail"}
    assert collections.Counter((r["doc_id"], r["text"]) for r in found) == collections.Counter((i, left.get(i, t)) for i, t, *_ in ROWS)
    assert next(r["gone"] for r in found if r["doc_id"] == 9) == 60
    assert line_dedup.remove_repeats(nothing).count() == 0


def test_line_dedup_of_other_ids_and_long_texts(spark):
    """Ids are strings, and one id holds most rows; a text of a megabyte; the first line goes without the white space after it."""
    long = " ".join(f"m{k}" for k in range(150_000))
    rows = [("a", "one two\nthree four"), ("b", "one two\n\n  new line"), ("c", long), ("d", f"start {long} end")] + [("x", f"text {k} of one id\nshared by all") for k in range(40)]
    found = line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    texts = collections.defaultdict(list)
    for r in found:
        texts[r["doc_id"]].append(r["text"])
    assert texts["a"] == [rows[0][1]] and texts["b"] == ["new line"] and texts["c"] == [long] and texts["d"] == ["start end"]
    assert sorted(t.partition("\n")[0] for t in texts["x"]) == sorted(f"text {k} of one id" for k in range(40)) and sum("shared" in t for t in texts["x"]) == 1


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 60, 50).astype(np.uint64)
    prints = []
    for n, m in ((33, 40), (71, 40)):
        x = np.concatenate([rng.integers(0, 1 << 60, n).astype(np.uint64), shared, rng.integers(0, 1 << 60, m).astype(np.uint64)])
        at = np.arange(len(x))
        prints.append(set(line_dedup.marks_of(line_dedup.Level(x, x, np.array([0, len(x)]), 50, at, at + 1)).hash.tolist()))
    assert prints[0] & prints[1] and len(prints[0]) < 12


def test_crc_of_ids_matches(spark):
    from tokenizers import Tokenizer

    tool, start = Tokenizer.from_file(JSON), 0
    found = {r["doc_id"]: r for r in token_files.op2_token_files(spark, SF).collect()}
    for doc in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*tool.encode(doc["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        r = found[doc["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def brute_near(rows, words=5):
    """Ids that stay: the smallest of each component of Jaccard similarity 0.8; the similarities of all such pairs."""
    grams = lambda w: frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    sets = {i: grams((t or "").split()) for i, t in rows}
    root, found = {i: i for i in sets}, {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sorted(sets.items()), 2):
        both = len(a & b)
        if 5 * both >= 4 * (len(a) + len(b) - both):
            found[i, j] = both / (len(a) + len(b) - both) if a or b else 1.0
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {find(i) for i in root}, found


def edited(rng, words, edits, tag):
    out = list(words)
    for k in rng.choice(len(out), edits, replace=False):
        out[k] = f"{tag}e{k}"
    return " ".join(out)


def test_near_dedup_finds_pairs_of_every_similarity(spark):
    """Pairs of 0.80 to 1 in a table where a third of the rows shares a passage, against brute force."""
    rng, rows = np.random.default_rng(3), []
    shared = " ".join(f"common{k}" for k in range(12))
    for n in range(150):
        words = [f"t{n}w{k}" for k in range(200)]
        tail = f" {shared}" if n % 3 == 0 else ""
        rows += [(2 * n, " ".join(words) + tail), (2 * n + 1, edited(rng, words, 1 + n % 6, n) + tail)]
    kept, pairs = brute_near(rows)
    bands = collections.Counter(min(int(20 * j), 18) for j in pairs.values())
    assert bands[16] >= 20 and bands[17] >= 20 and bands[18] >= 20
    found = {r["doc_id"] for r in simhash.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    missed = collections.Counter(min(int(20 * j), 18) for (_, b), j in pairs.items() if b in found)
    assert not missed and found == kept


def test_near_dedup_verifies_before_it_thins(spark):
    """Families of edited copies near the similarity: a pair counts even where closer fingerprints link both to a third."""
    rng, rows = np.random.default_rng(5), []
    for n in range(30):
        words = [f"f{n}w{k}" for k in range(200)]
        rows += [(8 * n + k, edited(rng, words, int(rng.integers(1, 4)), f"{n}x{k}")) for k in range(8)]
    kept, pairs = brute_near(rows)
    found = {r["doc_id"] for r in simhash.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert len(pairs) > 200 and found == kept


def test_line_dedup_equals_brute_force(spark):
    """Runs whose fingerprint occurs first in a text that holds less than the run; then a whole table, exactly."""
    rng = np.random.default_rng(4)
    rows, at = [], 0
    for n in range(12):
        passage = [f"p{n}w{k}" for k in range(50 + n)]
        cut = int(rng.integers(0, len(passage) - 40))
        for part in (passage[cut : cut + 40], passage, passage, passage + passage):
            rows.append((at, " ".join([f"b{at}x{k}" for k in range(30)] + part + [f"a{at}x{k}" for k in range(30)])))
            at += 1
    rows.append((at, "again " * 120))
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for made in (spark.createDataFrame(rows, "doc_id long, text string"), table):
        given = sorted((r["doc_id"], r["text"]) for r in made.collect())
        for options in ({}, {"min_lines": 0}):
            want = dict(zip([i for i, _ in given], brute_removed(given, **options), strict=True))
            found = {r["doc_id"]: WORD.findall(r["text"] or "") for r in line_dedup.remove_repeats(made, sizes=line_dedup.Sizes(**options)).collect()}
            assert found == want


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_classifiers_take_one_text_of_a_repeated_id(spark, module, monkeypatch):
    """One labelled id that holds most rows gives one training row."""
    rows = [(i, f"good prose number {i} with calm words", 1) for i in range(8)] + [(i, f"JUNK!! idiot {i} $$$ ###", 0) for i in range(8, 16)]
    texts = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, f"copy {k} of an id") for k in range(500)], "doc_id long, text string")
    name, seen = "quality" if module is quality_classifier else "toxic", []
    original = module.one_text
    monkeypatch.setattr(module, "one_text", lambda *a: seen.append(original(*a)) or seen[-1])
    module.fit(texts, spark.createDataFrame([(i, y) for i, _, y in rows], f"doc_id long, {name} int"))
    assert sorted(r["doc_id"] for r in seen[0].collect()) == list(range(16))


def test_null_and_repeated_ids_take_part_by_their_text(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "other words of a third kind here"
    rows = [(None, a), (None, a), (4, a), (3, b), (3, b), (3, c), (None, "alone in the world of null ids")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.near_dedup_stage(spark, table, SF).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept) == {(4, a): 1, (3, b): 1, (3, c): 1, (None, rows[-1][1]): 1}


def test_simhash_null_ids_bridge(spark, monkeypatch):
    """Fingerprints 0, 3 bits, 6 bits apart: the middle one is held by null ids alone and joins the outer two."""
    rows = spark.createDataFrame([(1, 0), (None, 7), (2, 63), (None, 1 << 40 | 0xFF00), (5, -1)], "doc_id long, fingerprint long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, **_: docs)
    found = {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in simhash.group_near_duplicates(rows).collect()}
    assert found == {(1, 0): 1, (None, 7): 1, (2, 63): 1, (None, 1 << 40 | 0xFF00): None, (5, (1 << 64) - 1): 5}


def numpy_kept(rows):
    """doc_id -> kept, by histograms and Jensen-Shannon distances in plain Python; rows: id, text, language."""
    import regex

    patterns = [r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[.,;:'\"()\-]", r"[!?#*$%&|<>@_=+/\\~^\[\]{}]"]
    measured = {}
    for i, text, language in rows:
        words, body = WORD.findall(text or ""), text or ""
        chars, n = sum(map(len, words)), len(words)
        classes = [len(regex.findall(p, body)) for p in patterns]
        listed = quality_rules.COMMON.get(language, quality_rules.ANY)
        counts = [sum(w.lower() == c for w in words) for c in listed]
        hist = lambda found, whole: np.array([*found, max(whole - sum(found), 0)]) / whole if whole else np.zeros(len(found) + 1)
        again = brute_counts(text)[4]
        measured[i] = (language, hist(classes, chars), hist(counts, n), n < 10 or 100 * again > 20 * n, chars, n)

    def distance(p, q):
        m = (p + q) / 2
        half = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0) / 2
        return np.sqrt(max(half(p) + half(q), 0))

    def mean(use):
        return {lang: [np.mean([measured[i][k] for i in use if measured[i][0] == lang], axis=0) for k in (1, 2)] for lang in {measured[i][0] for i in use}}

    rough = mean([i for i, m in measured.items() if not m[3]])
    known = mean([i for i, m in measured.items() if not m[3] and m[0] in rough and distance(m[1], rough[m[0]][0]) <= 0.25])
    out = {}
    for i, (language, char, word, failed, chars, n) in measured.items():
        c, w = (distance(x, r) for x, r in zip((char, word), known[language], strict=True)) if language in known else (0.0, 0.0)
        out[i] = not failed and not (chars >= 150 and c > 0.3 or n >= 40 and (w > 0.45 or c > 0.16 and w > 0.23))
    return out


def test_quality_verdicts_against_numpy(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    long = spark.createDataFrame([(10_000_001, "the quick Fox of 12 and " * 50_000, "en"), (10_000_002, "Zq9# " * 200_000, "fr")], table.schema)
    both = table.unionByName(long)
    want = numpy_kept([tuple(r) for r in both.collect()])
    found = {r["doc_id"]: r["kept"] for r in quality_rules.judge(both).collect()}
    assert found == want and any(want.values()) and not all(want.values())


def test_a_megabyte_in_every_operator(spark):
    """One text of over a megabyte beside short ones: fingerprints, scores, sizes and ids are those of the whole text."""
    long = "Plain words about a river, " * 45_000 + "idiot scum. " + " ".join(f"last{k}" for k in range(20_000))
    docs = spark.createDataFrame([(1, long, "en", "a"), (2, "short text of the other kind", "en", "b")], SCHEMA)
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in simhash.group_near_duplicates(docs).collect()}
    assert prints[1] == brute_fingerprint(long, 3)
    assert {r["doc_id"]: r["mix"]["size"] for r in mixing.plan_mix(docs).collect()}[1] == len(WORD.findall(long))
    encoded = {r["doc_id"]: (r["n"], bytes(r["back"])) for r in byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded="back").select("doc_id", F.size("ids").alias("n"), "back").collect()}
    assert encoded[1] == (len(tiktoken_encoding().encode_ordinary(long)), long.encode())
    model = toxicity.ToxicityModel(22, (), -3.0, *(np.array(x) for x in zip(*sorted({int(b): 4.0 for b in toxicity.features(*arrow_text(["scum"]), 22, ())[1]}.items()), strict=True)))
    assert {r["doc_id"]: r["score"] > 0.5 for r in toxicity.score(docs, model).collect()} == {1: True, 2: False}
