import random

import pytest
from samples import sentence

import corpus_pipeline as P

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def junk(rng, words):
    return rng.choice([" ".join(w + "&&&" for w in words), " ".join(w.upper() + "!!" for w in words), " ".join(w for w in words for _ in range(5))])


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good, junk, copied, contaminated and secret documents, by id range."""
    rng = random.Random(9)
    texts, labels = {}, []
    for k in range(400):
        words = sentence(rng, rng.randint(40, 90)).split()
        good = k < 250 or rng.random() < 0.5
        texts[k] = " ".join(words) if good else junk(rng, words)
        labels.append((k, int(good), 0))
    for k in range(400, 420):  # near copies of 0 to 19
        words = texts[k - 400].split()
        words[-1] = "changed"
        texts[k] = " ".join(words)
    item = sentence(rng, 25)
    for k in range(420, 425):
        texts[k] = f"{sentence(rng, 30)} {item} {sentence(rng, 30)}"
    for k in range(425, 430):
        texts[k] = f'{sentence(rng, 40)} token = "{"0123456789abcdef" * 3}" {sentence(rng, 40)}'
    rows = [(k, t, "en", "src0", len(t)) for k, t in texts.items()] + [(900, None, None, None, None), (901, "", "en", "s", 0), (None, texts[30], "en", "s", 5)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, {k: q for k, q, _ in labels}


def test_every_stage_takes_effect(spark, corpus):
    folder, texts, label = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema = docs.schema
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if name != P.STAGES[-1][0]:
            assert docs.schema == schema
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    good = {k for k, q in label.items() if q}
    assert len(good - kept["quality"]) <= 3 and len((set(label) - good) & kept["quality"]) <= 6
    assert {*range(420, 430), None} <= kept["quality"]
    assert kept["quality"] - kept["near_duplicates"] <= set(range(400, 420)) and not {*range(400, 420)} & kept["near_duplicates"]
    assert kept["near_duplicates"] - kept["benchmark"] == set(range(420, 425))
    assert kept["secrets"] == kept["benchmark"] == kept["token_ids"]
    secrets = {r.doc_id: r for r in spark.read.parquet(f"{folder}/secrets").collect()}
    for k in range(425, 430):
        assert "0123456789abcdef" not in secrets[k].text and "[secret]" in secrets[k].text and secrets[k].n_chars == len(secrets[k].text)
    assert secrets[30].text == texts[30]
    assert all(r.round_trip for r in docs.collect())


def test_run_and_empty_tables(spark, corpus, tmp_path):
    folder, _, _ = corpus
    assert sorted(map(str, P.run(spark, folder).columns)) == sorted(["doc_id", "n_ids", "n_byte_ids", "ids", "ids_sha256", "decoded_sha256", "round_trip"])
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
