"""Alignment, MinHash groups and whitening against plain versions, on awkward rows, hot groups and empty tables."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lapwise.llm import alignment, minhash, whitening

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = [
    (1, "The quick brown fox, it's 12 o'clock.\n\nAnd  then?"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "é́ñ文字 😀 x y z " * 3),
    (6, "a" * 3000 + " " * 300 + "end "),
    (7, "The quick brown fox, it's 12 o'clock.\n\nAnd  then?"),
    (7, "another text of the same id"),
    (None, "a row without an id"),
    (8, "a▁b has a piece that does not spell its text " * 60),
    (9, "<|endoftext|> <s> </s> plain"),
    (10, "abc.def,ghi!jk " * 200 + "\n".join(["foo.bar", "éé—x "] * 200)),
    (11, "日本語テキスト。" * 200 + " end "),
]


def awkward(spark, rows=TEXTS):
    clash = ["row", "block", "pair", "n", "key", "c", "head", "pos", "size", "component", "component_id", "kept", "n_a"]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in clash}).repartition(3)


@pytest.fixture(scope="module")
def tools():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A_FILE), SentencePieceProcessor(model_file=B_FILE)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    spell_a = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in a.get_vocab().items()}
    spell_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))]
    return a, b, spell_a, spell_b


def plain_alignment(tools, text):
    """Numbers of tokens, groups as text, and links of one text, token by token."""
    a, b, spell_a, spell_b = tools
    ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
    if b"".join(spell_a[i] for i in ids_a) != (" " + text).encode() if text else True:
        return 0, 0, [], []
    if b"".join(spell_b[i] for i in ids_b) != (" " + text).encode():
        return 0, 0, [], []
    ends_a, ends_b = (np.cumsum([len(s[i]) for i in ids]).tolist() for s, ids in ((spell_a, ids_a), (spell_b, ids_b)))
    groups, links, at_a, at_b = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        to_a, to_b = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append(",".join(map(str, ids_a[at_a:to_a])) + "|" + ",".join(map(str, ids_b[at_b:to_b])))
        links.append((ids_a[to_a - 1], ids_b[to_b - 1]))
        at_a, at_b = to_a, to_b
    return len(ids_a), len(ids_b), groups, links


@pytest.mark.parametrize(("long", "size"), [(1 << 20, 256 << 10), (200, 40), (0, 1)])
def test_alignment_equals_the_plain_version(spark, tools, long, size):
    """Whole texts, ranges of a few words, and ranges as small as they can be cut; trees of several levels."""
    got, pairs = alignment.align(awkward(spark), A_FILE, B_FILE, long=long, size=size)
    expected = [(i, *plain_alignment(tools, t)) for i, t in TEXTS]
    counts = collections.Counter(link for row in expected for link in row[4])
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = [(i, a, b, len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, x in expected]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(rows)
    assert {(r["a"], r["b"]): (r["n"], r["best"]) for r in pairs.collect()} == {p: (n, n == best[p[1]]) for p, n in counts.items()}


def test_alignment_of_an_empty_table_and_null_texts(spark):
    schema = "doc_id long, text string"
    assert alignment.align(spark.createDataFrame([], schema), A_FILE, B_FILE)[0].count() == 0
    assert alignment.align(spark.createDataFrame([(1, None)], schema), A_FILE, B_FILE)[0].first().groups_sha256 == ""


def test_fragments_compose_associatively():
    """Any bracketing of a sequence of fragments gives one fragment and the same closed groups."""
    rng = random.Random(3)
    for _ in range(200):
        parts = []
        for seq in range(5):
            ids = lambda: [rng.randrange(9) for _ in range(rng.randrange(1, 3))]
            has = rng.random() < 0.5
            parts.append((alignment.Fragment(rng.random() < 0.9, seq if has else None, (ids(), ids()), (ids(), ids()) if has else ([], [])), []))

        def compose(x, y):
            whole, seam = x[0].then(y[0])
            return whole, x[1] + ([seam] if seam else []) + y[1]

        def fold(xs):
            if len(xs) == 1:
                return xs[0]
            k = rng.randrange(1, len(xs))
            return compose(fold(xs[:k]), fold(xs[k:]))

        assert fold(parts) == fold(parts) == fold(parts)


def shingle_set(text, words=4):
    found = WORD.findall((text or "").encode().lower())
    return frozenset(b" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))) if found else frozenset()


def plain_groups(rows):
    """Size, component and kept of every row, from all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k)), i == least.get(find(k))) for k, (i, _) in enumerate(rows)]


def test_minhash_of_awkward_rows(spark):
    rows = [*TEXTS, (12, "THE quick\tbrown fox, it's 12 o'clock.\nand then?"), (13, "two words"), (14, "Two  WORDS"), (15, "one"), (16, " \n")]
    got = minhash.group_by_minhash(awkward(spark, rows))
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(plain_groups(rows))
    assert minhash.group_by_minhash(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert minhash.group_by_minhash(spark.createDataFrame([(None, None)], "doc_id long, text string")).first().kept


def edited(rng, words, share):
    out = list(words)
    for k in rng.sample(range(len(out)), int(len(out) * share)):
        out[k] = f"e{rng.randrange(10**9)}"
    return out


def test_minhash_equals_all_pairs_where_rows_are_alike(spark, monkeypatch):
    """Chains of edits, families of copies edited at many places, a passage in a third of the rows, exact copies; small tiles."""
    monkeypatch.setattr(minhash, "TILE_ROWS", 8)
    monkeypatch.setattr(minhash, "AT_ONCE", 2000)
    monkeypatch.setattr(minhash, "BUCKETS", 16)
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts, passage = [], words(30)
    for _ in range(6):  # a chain: neighbours alike, its ends not
        at = words(60)
        for _ in range(8):
            texts.append(at)
            at = edited(rng, at, 0.03)
    for share in (0.01, 0.03, 0.05, 0.07):  # families about the border of 0.8
        base = words(80)
        texts += [edited(rng, base, share) for _ in range(12)]
    texts += [passage + words(rng.randrange(5, 12)) for _ in range(60)]
    texts += [words(50) for _ in range(10)] + [texts[0]] * 40
    rng.shuffle(texts)
    rows = [(100 + i, " ".join(t)) for i, t in enumerate(texts)]
    got = minhash.group_by_minhash(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(plain_groups(rows))


def test_marks_never_bound_below_what_is_common(monkeypatch):
    """Of sets of all sizes, with marks of several lengths, small blocks and large: the room is never less than the intersection."""
    rng = np.random.default_rng(8)
    make = lambda n: [np.unique(np.concatenate([rng.integers(0, 900, rng.integers(0, 700)), rng.integers(0, 10**6, rng.integers(1, 500))])) for _ in range(n)]
    a, b = make(30), make(20)
    a[3] = a[4] = b[5]
    for at_once in (1 << 21, 10):
        monkeypatch.setattr(minhash, "AT_ONCE", at_once)
        for x in a:
            for y in b:
                p, q = (np.frombuffer(minhash.mark_of(s), dtype=np.uint8).reshape(1, -1) for s in (x, y))
                least = min(p.shape[1], q.shape[1])
                found = minhash.room(minhash.fold(p, least), minhash.fold(q, least))[0, 0]
                assert len(np.intersect1d(x, y)) <= found <= min(len(x), len(y))
    assert minhash.mark_of(np.arange(256)) == bytes([1] * 256) and len(minhash.mark_of(np.arange(257))) == 512


def test_min_max_values_agree_as_often_as_sets_are_similar():
    """Minima and maxima are both unbiased; agreement over many pairs of similarity 0.6 stays near 0.6."""
    rng = np.random.default_rng(1)
    seen = []
    for _ in range(150):
        pool = rng.integers(-(1 << 62), 1 << 62, 100)
        a, b = minhash.signatures([np.unique(pool[:80]), np.unique(pool[20:])])
        seen.append(a == b)
    low, high = np.mean(seen, axis=(0,)).reshape(2, -1).mean(axis=1)
    assert abs(low - 0.6) < 0.015 and abs(high - 0.6) < 0.015


VECTORS = [[0.1, -0.7, 2.5], [1.0, 0.3, 0.2], [0.5, 0.5, -0.25], [-1.0, 0.1, 0.9], [0.33, -0.2, 0.0]]


def plain_whitening(vectors, most=32):
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    apart = (n * x - s) / n
    covariance = apart.T @ apart / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return ((n * x - s) ** 2).sum(axis=1), apart @ (axes / np.sqrt(values)), values / np.trace(covariance)


def test_whitening_equals_numpy(spark):
    """Blocks of a few rows over many partitions, so that products and grids have many blocks."""
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 3).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit("own")).withColumn("x", F.lit(1)).repartition(7)
    got = whitening.whiten(df, components=4, block_rows=9).toPandas()
    deviation, whitened, explained = plain_whitening(vectors.astype(np.float64), 4)
    one = got[got.component == 1].set_index("vec_id").loc[range(300)]
    assert (one.deviation.to_numpy() == deviation).all() and (got.n == 300).all()
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(300)].to_numpy()
    assert np.abs(table * np.sign((table * whitened).sum(axis=0)) - whitened).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first().to_numpy(), explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9 and list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_of_awkward_rows(spark):
    bad = [(20, None), (21, [1.0, None, 2.0]), (22, [float("nan"), 0.0, 0.0]), (23, [0.0, float("inf"), 0.0]), (24, [1.0]), (25, [])]
    rows = [(i, v) for i, v in enumerate(VECTORS)] + [(0, VECTORS[0]), (None, VECTORS[1])]
    schema = "vec_id long, embedding array<float>"
    got = whitening.whiten(spark.createDataFrame(rows + bad, schema).repartition(3)).toPandas()
    assert len(got) == 7 * 3 and got.vec_id.isna().sum() == 3 and (got.n == 7).all()
    deviation, _, explained = plain_whitening([np.float32(v) for _, v in rows])
    assert sorted(got[got.component == 2].deviation) == sorted(deviation)
    assert np.allclose(got.groupby("component").explained.first().to_numpy(), explained)
    for empty in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(empty, schema)).count() == 0


def test_whitening_without_variance(spark):
    """A constant dimension, fewer rows than dimensions, and one row: null values there, and the rest as it should be."""
    schema = "vec_id long, embedding array<double>"
    got = whitening.whiten(spark.createDataFrame([(i, [*v, 4.0]) for i, v in enumerate(VECTORS)], schema)).toPandas()
    assert got[got.component == 4].whitened.isna().all() and got[got.component < 4].whitened.notna().all() and got.identity_error[0] < 1e-9
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 5.0])], schema)).toPandas()
    assert got[got.component == 1].whitened.notna().all() and got[got.component > 1].whitened.isna().all()
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).toPandas()
    assert one.whitened.isna().all() and one.explained.isna().all() and one.identity_error.isna().all() and (one.deviation == 0).all()
