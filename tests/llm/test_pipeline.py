from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cartloom.llm import bpe, decontaminate, near_dups, toxicity
from cartloom.llm.queries import QUERIES, SQL, tokenizer_path

ROOT = Path("/root/testdata/sf0.001")


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(SQL) <= set(QUERIES) <= set(entry.queries()) and entry.queries()["pipeline"] is corpus_pipeline.run
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "bpe"]


@pytest.mark.skipif(not ROOT.exists(), reason="needs the given tables")
def test_stages_on_the_given_tables(spark):
    folder = str(ROOT)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    automaton = decontaminate.Automaton(items)

    def clean(text):
        words = decontaminate.words_of(text)
        hit = sum(b - a for a, b in automaton.scan(words)[0])
        return not hit or 20 * hit < len(words)

    (_, toxic), (_, near), (_, bench), (_, private), (_, encode) = corpus_pipeline.STAGES
    one = toxic(spark, docs, folder)
    kept = {i: t for i, t in before.items() if model.score(t) < 0.5}
    assert one.columns == columns and {r.doc_id: r.text for r in one.collect()} == kept
    two = near(spark, one, folder)
    least = {r.doc_id for r in near_dups.classes(one).collect() if r.doc_id == r.class_id}
    kept = {i: t for i, t in kept.items() if i in least}
    assert two.columns == columns and {r.doc_id: r.text for r in two.collect()} == kept
    three = bench(spark, two, folder)
    kept = {i: t for i, t in kept.items() if clean(t)}
    assert three.columns == columns and {r.doc_id: r.text for r in three.collect()} == kept
    four = private(spark, three, folder)
    redacted = {r.doc_id: r.text for r in four.collect()}
    assert four.columns == columns and set(redacted) == set(kept)
    assert all(r.n_chars == len(r.text) for r in four.collect())
    coder = bpe.Encoder(open(tokenizer_path(), encoding="utf-8").read())
    for r in encode(spark, four, folder).collect():
        assert r.ids == coder.encode(redacted[r.doc_id]) and r.n_tokens == len(r.ids) and r.decoded == coder.decode(r.ids)


def test_stages_with_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, words string, row string"
    rows = [(1, None, None, None, None, "w", "r"), (2, "", "en", "s", 0, None, "r"), (3, "call +1 988 555 2485 now", "en", "s", 24, "w", None)]
    for name, frame in {
        "documents": spark.createDataFrame(rows, schema),
        "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([], "item_id long, text string"),
    }.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.count() == (2 if name == "near_duplicates" else 3), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 3}
