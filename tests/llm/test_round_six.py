"""Near copies of which line dedup leaves only what was edited."""

from lapwise.llm import line_dedup, simhash


def test_near_copies_go_though_their_lines_went_first(spark, tmp_path):
    """Copies with a changed word are remnants after line dedup; the stage drops them, and nothing that only quotes them."""
    base = [f"w{k}" for k in range(300)]
    rows = [(5, " ".join(base))]
    rows += [(10 + n, " ".join([*base[:at], f"edit{n}", *base[at + 1 :]])) for n, at in enumerate((90, 150, 220))]
    rows += [(20, " ".join(base[:150] + [f"own{k}" for k in range(150)])), (21, " ".join(f"free{k}" for k in range(80))), (None, "a text without an id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lines = line_dedup.line_dedup_stage(spark, table, str(tmp_path))
    assert {r["doc_id"] for r in lines.collect()} == {i for i, _ in rows}
    kept = simhash.near_dedup_stage(spark, lines, str(tmp_path)).collect()
    assert {r["doc_id"] for r in kept} == {5, 20, 21, None} and len(kept) == 4
    assert {r["doc_id"]: r["text"] for r in kept}[5] == rows[0][1]


def test_whole_texts_count_only_for_what_is_left_of_them(spark):
    """Other texts under the same ids, repeated ids and null ids are no near copies by what the input has for them."""
    same = " ".join(f"w{k}" for k in range(60))
    whole = spark.createDataFrame([(1, same), (2, same + " x"), (3, same), (4, same), (4, same), (None, same), (6, same)], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "w1 w2"), (2, "\n x"), (3, "other"), (4, "w3"), (None, "w4"), (6, "w5"), (6, "w6"), (7, "w7")], "doc_id long, text string")
    assert [r["gone"] for r in simhash.later_copies(docs, whole).collect()] == [2]
    assert simhash.later_copies(docs.limit(0), whole).count() == 0
