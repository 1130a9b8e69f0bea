import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from prosa.llm import packing, quality_classifier as qc, quality_rules as qr
from tests.llm.test_simhash import brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(240):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(60, 150)))
        if i % 15 == 0:
            text = " ".join(w + "***" for w in text.split())
        elif i % 10 == 1 and i > 10:
            text = rows[i - 9][1] + ("" if i % 20 == 1 else " end")
        elif i % 12 == 5:
            text = "too short"
        rows.append((i, text, "en", f"s{i % 2}", len(text)))
        if i % 5:
            labels.append((i, int(i % 15 != 0), 0))
    rows += [(7, rows[7][1], "en", "s0", 1), (500, None, None, None, None), (501, "", "en", "s1", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_equals_the_stages_by_brute_force(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    kept = {r.doc_id for r in qr.score_documents(docs, labels).collect() if r.kept}
    first = docs.where(docs.doc_id.isin(sorted(kept)))
    good = {r.doc_id for r in qc.score_documents(first, labels).collect() if r.predicted}
    left = [(r.doc_id, r.text) for r in first.collect() if r.doc_id in good]
    named = brute_components([(i, brute_fingerprint(t)) for i, t in left])
    one = {i: t for (i, t), c in zip(left, named) if i == c}
    assert 50 < len(one) < len(left) < 243, (len(kept), len(good), len(left), len(one))
    tokenizer = Tokenizer.from_file(packing.public_vocabulary("byte_bpe_50k.json"))
    want = Counter((i, zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in one.items())
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in items) <= 2048 for items in bins.values())


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), folder).count() == 0


def test_the_classifier_rejects_bad_documents_that_the_rules_left(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("length(text) > 200").dropDuplicates(["doc_id"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.selectExpr("doc_id", "cast(doc_id % 15 <> 0 as int) as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    clean = docs.where("doc_id % 15 <> 0")
    planted = docs.where("doc_id % 15 = 0").selectExpr("doc_id + 10000 as doc_id", "text", "lang", "source", "n_chars")  # without labels
    assert planted.count() > 10
    kept = [r.doc_id for r in corpus_pipeline.quality_classifier_stage(spark, clean.unionByName(planted), str(tmp_path)).collect()]
    assert not [i for i in kept if i >= 10000] and len(kept) > 0.95 * clean.count()
