import corpus_pipeline
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_simhash import plain_classes, plain_fingerprint
from tradewell.llm import pfair_mix, quality_gbdt
from tradewell.llm.piece_codec import codec, model_path


def test_every_stage_against_a_plain_version(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        before = docs.collect()
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = before, docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    good, lines, near, mixed, coded = seen.values()

    bad = {r.doc_id for r in quality_gbdt.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect() if not r.predicted}
    assert bad and {r.doc_id for r in good[1]} == {r.doc_id for r in good[0]} - bad

    want = plain_lines([(r.doc_id, r.text) for r in lines[0]], equal=1)
    text = {r.doc_id: want[r.doc_id, r.text][2] for r in lines[0]}
    assert {r.doc_id: (r.text, r.n_chars) for r in lines[1]} == {i: (t, len(t)) for i, t in text.items()}

    classes = plain_classes([(r.doc_id, plain_fingerprint(r.text)) for r in near[0]])
    assert sorted(r.doc_id for r in near[1]) == sorted({c for _, c in classes})

    order = [r.row.doc_id for r in pfair_mix.mix(spark.createDataFrame(mixed[0], docs_schema(spark, sf))).orderBy("slot", "place").collect()]
    assert [r.doc_id for r in mixed[1]] == order

    c = codec(model_path())
    assert {r.doc_id: list(r.ids) for r in coded[1]} == {r.doc_id: c.encode(r.text) for r in coded[0]}


def docs_schema(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").schema


def test_the_order_of_the_mix_is_in_the_result(spark, tmp_path, monkeypatch):
    """Also when the mix is many files, some ids are missing or repeated, and sources differ in size."""
    rows = [(None if i % 50 == 0 else i // 2, f"text {i} " * (1 + i % 30), "en", "abbccc"[i % 6], i) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(7, "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    as_it_is = ("as it is", lambda spark, docs, sf_dir: docs.repartition(6, "n_chars"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [as_it_is, *corpus_pipeline.STAGES[-2:]])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    c = codec(model_path())
    want = pfair_mix.mix(docs).orderBy("slot", "place").select("row.doc_id", "row.text", "slot", "place").collect()
    placed = sorted(got, key=lambda r: (r.slot, r.place))
    assert [(r.doc_id, r.slot, r.place, list(r.ids)) for r in placed] == [(r.doc_id, r.slot, r.place, c.encode(r.text)) for r in want]


def test_odd_rows_through_all_stages(odd, empty, clash, spark, tmp_path):
    labels = spark.createDataFrame([(i, 1) for i in range(9)] + [(None, 0)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    for docs in (clash, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
