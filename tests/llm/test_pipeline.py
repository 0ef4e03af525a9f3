import corpus_pipeline
from lattice.llm import oracles, queries

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decisions(spark):
    docs = queries.table(spark, DATA, "documents")
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, DATA)
        assert out.columns == columns and 0 < out.count() <= n, k
        docs, n = out, out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == n


def test_run_matches_the_stages_one_by_one(spark):
    docs = queries.table(spark, DATA, "documents")
    good = queries.quality.keep_good(spark, docs, queries.quality.fit(spark, docs, queries.table(spark, DATA, "labels")))
    ids = {r.doc_id for r in good.collect()}
    groups = queries.jaccard.link_components(spark, good)
    ids &= {r.doc_id for r in groups.collect() if r.doc_id == r.component_id}
    kept = docs.where(docs.doc_id.isin(*ids))
    leaks = {r.doc_id for r in queries.decontam.find_leaks(spark, kept, queries.table(spark, DATA, "benchmark")).collect()}
    kept = kept.where(~kept.doc_id.isin(*leaks)) if leaks else kept
    want = {r.doc_id for r in queries.mixing.mix(spark, kept).collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == want


def test_every_oracle_names_a_query():
    assert set(oracles.ORACLES) <= set(queries.QUERIES)
    assert [name for name in queries.QUERIES] == sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, _r string, leak int, topic string"


def staged(spark, rows, tmp_path, labels=((1, 1, 0), (2, 0, 0))):
    """The rows after each stage, each written and read again as the driver does."""
    for name, frame in (("labels", spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, None), (2, "the quick brown fox jumps over the lazy dog while seven quiet cats watch from a garden wall")], "item_id long, text string"))):
        frame.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    docs, out = spark.createDataFrame(rows, SCHEMA), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.mode("overwrite").parquet(f"{tmp_path}/{name}{k}")
        docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
        if k < 4:
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        out.append(docs.collect())
    return out


def test_stages_on_an_empty_table(spark, tmp_path):
    assert staged(spark, [], tmp_path) == [[]] * 5


def test_stages_on_nulls_repeats_and_clashing_columns(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(60))
    leak = "before it all the quick brown fox jumps over the lazy dog while seven quiet cats watch from a garden wall"
    long = " ".join(f"w{i % 5000}x{i}" for i in range(40_000))
    rows = [(1, text, "en", "a", 1, 1, "r", 1, "t"), (1, text, "en", "a", 1, 2, "r", 1, "t"), (None, text, None, None, None, None, None, None, None), (None, None, None, "a", 1, 1, "r", 1, None), (None, "", "en", None, 1, 1, "r", 1, "t"), (7, leak, "en", "a", 1, 1, "r", 1, "t"), (None, leak + " more", "en", "a", 1, 1, "r", 1, "t"), (7, long, "de", "b", 1, 1, "r", 1, "u"), (8, "  \n ", "de", "b", 1, 1, "r", 1, "u")]
    good, single, clean, mixed, shards = staged(spark, rows, tmp_path, labels=())
    assert len(good) == 9  # without labels all score one half
    assert sorted(r.doc_id or 0 for r in single if r.text == text) == [1] and len(single) == 6
    assert not any("quick brown" in (r.text or "") for r in clean) and len(clean) == 5
    assert {r.text for r in mixed} <= {r.text for r in clean} and len(shards) == len(mixed)
