import glob

import corpus_pipeline


def folders(spark):
    return set(glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/octavo-*"))


def test_a_stage_removes_the_steps_of_written_stages(spark, sf, tmp_path):
    before, docs = folders(spark), spark.read.parquet(f"{sf}/documents.parquet").limit(200)
    docs.write.parquet(f"{tmp_path}/in")
    docs, own = spark.read.parquet(f"{tmp_path}/in"), set()
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        assert not own & folders(spark), name
        found.write.parquet(f"{tmp_path}/{name}")
        own = folders(spark) - before
        assert own or name == "packing"
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert not own and docs.count()


def test_steps_that_are_still_read_stay(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    chained = stages["exact_dedup"](spark, stages["quality_rules"](spark, docs, str(tmp_path)), str(tmp_path))  # unwritten output
    apart = stages["simhash"](spark, docs, str(tmp_path))  # what the first stage read, not what it returned
    assert 0 < chained.count() < docs.count() and apart.count()


def test_run_returns_the_same_pieces_as_the_stages_one_by_one(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    got = docs.select("doc_id", "start", "length", "ids_crc32").collect()
    assert want and sorted(got) == sorted(want)
