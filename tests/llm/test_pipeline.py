"""The pipeline's stages, each on what the one before has written, against plain versions."""

import corpus_pipeline
from geofeat.llm.queries import tokenizer_path
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "123 !!", "en", "src1", 6), (9003, "the and of with that", None, None, 20)], docs.schema)
    docs = docs.unionByName(odd)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = docs.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == names
        after = docs.collect()
        if k == 0:
            assert {r["doc_id"] for r in after} == {d for d, _ in before} - {9001, 9002}
            assert all(r["lang"] for r in after)
        elif k == 1:
            want = {d for d, v in brute.components(before, 5, 80).items() if v[1] == d}
            assert sorted(r["doc_id"] for r in after) == sorted(want)
        elif k == 2:
            hit = brute.contamination(before, items)
            left = {r["doc_id"]: r["text"] for r in after}
            assert set(left) == {d for d, v in hit.items() if v[1] == 0 or v[1] < v[0]}
            assert all(left[d] == t for d, t in before if hit[d][1] == 0)
            again = brute.contamination(list(left.items()), items)
            assert all(again[d][0] == hit[d][0] - hit[d][1] for d in left)
            assert all(r["n_chars"] == len(r["text"]) for r in after if hit[r["doc_id"]][1])
        elif k == 3:
            uses = [r["doc_id"] for r in after]
            assert set(uses) == {d for d, _ in before} and max(map(uses.count, set(uses))) <= 2
        else:
            rows = sorted(before, key=lambda r: r[0])
            assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in after) == brute.tokens(rows, tokenizer_path())
        seen.append(len(after))
    assert seen[-1] == seen[-2] > 0


def test_only_near_duplicates_go(spark):
    """Rows without an id, or of one id and several texts, stay unless they are copies; so do all texts where no language is known."""
    text = {k: " ".join(f"{k}{j}word" for j in range(12)) for k in "abcd"}
    rows = [(None, text["a"]), (None, text["b"]), (7, text["c"]), (7, text["d"]), (8, text["c"]), (None, text["d"]), (7, text["d"]), (9, "12 34"), (10, None)]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = corpus_pipeline.language_id(spark, docs, SF)
    assert docs.count() == 7
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, text["a"]), (0, text["b"]), (7, text["c"]), (7, text["d"])]


def test_mixing_repeats_the_smallest_source_twice(spark):
    docs = spark.createDataFrame([(k, f"w{k} w w w", "en", "small" if k < 40 else "big", 1) for k in range(440)], "doc_id long, text string, lang string, source string, n_chars long")
    uses = corpus_pipeline.source_mixing(spark, docs, SF).groupBy("source").count().collect()
    uses = {r["source"]: r["count"] for r in uses}
    assert uses["big"] == 400 and 76 <= uses["small"] <= 80


def test_columns_of_any_name_come_out_as_they_went_in(spark):
    """score, langs, lang_pred, spans and others that stages use inside are the table's own."""
    rows = [(k, f"word{k} and some others{k} here now for all{k} to see them {k}", "en", "s", 9, -5.0, "mine", "theirs", "own", k * 7, "i", "cmp") for k in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, langs string, lang_pred string, spans string, n_words long, items string, component_id string"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), schema)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
        own = {(r["doc_id"], r["score"], r["langs"], r["lang_pred"], r["spans"], r["n_words"], r["items"], r["component_id"]) for r in docs.collect()}
        assert own <= {(r[0], *r[5:]) for r in rows} and len(own) == 30, name


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
