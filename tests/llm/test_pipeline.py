import hashlib

import corpus_pipeline
import numpy as np
import sentencepiece
from pyspark.sql import functions as F

from brevispark.llm import decontaminate, jaccard_join, language_id, pii, queries
from brevispark.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_work_on_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), f"test-{name}")
        if name == "near_duplicates":
            marks = jaccard_join.near_duplicates(docs)
            assert out.count() == marks.select("class_id").distinct().count()
        if name == "personal_data":
            assert out.count() == docs.count()
            left = pii.find_personal_data(out).where(F.size(F.filter("spans", lambda s: s["source"] == "pattern")) > 0)
            assert left.count() == 0
        if name != "sentencepiece":
            assert out.columns == columns
        seen.append(out.count())
        docs = out
    assert seen == sorted(seen, reverse=True) and seen[-1] > 100


def test_equals_plain_stages(spark, tmp_path):
    """The whole pipeline against one document at a time: plain mixture inference, all pairs of shingle sets, tiling of all pairs,
    spans, and the library's encoding."""
    from test_jaccard_join import brute
    from test_language_id import plain

    table = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500")
    some = {r.lang: r.text for r in table.where("length(text) > 900").collect()}
    mixed = " ".join(" ".join(some[lang].split()[:60]) for lang in sorted(some))
    table = table.unionByName(spark.createDataFrame([(10**6, "12 % 34 --", "en", "x", 10), (10**6 + 1, mixed, "en", "x", len(mixed))], table.schema))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, model = {r.doc_id: r.text for r in table.collect()}, language_id.train(table)
    shares = {i: plain(t, model) for i, t in docs.items()}
    kept = {i: t for i, t in docs.items() if max(shares[i]) >= corpus_pipeline.LEAST_SHARE}
    classes = brute(kept)
    unique = {i: t for i, t in kept.items() if classes[i][0] == i}
    items = [decontaminate.tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaked(text):
        own = decontaminate.tokens(text)
        for item in items:
            number = {}
            a = np.array([number.setdefault(w, len(number)) for w in item])
            tiles = decontaminate.tile(a, np.array([number.get(w, -1) for w in own], int), 5)
            if sum(n for _, _, n in tiles) >= 0.5 * len(item):
                return True
        return False

    clean = {i: t for i, t in unique.items() if not leaked(t)}
    assert len(docs) > len(kept) > len(unique) > len(clean) > 50
    field, full = pii.train_field(pii.labelled_lines()), sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_path())
    want = {}
    for i, text in clean.items():
        for kind, a, b, _ in sorted(pii.find_in([text], field)[0], key=lambda s: -s[1]):
            text = f"{text[:a]}<{kind.upper()}>{text[b:]}"
        ids = full.encode(text, add_bos=True, add_eos=True)
        want[i] = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want


def test_odd_rows_go_through_every_stage(spark, odd_documents):
    docs = odd_documents
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"odd-{name}")
        if name == "language_id":
            assert docs.where("text IS NULL OR text = ''").count() == 0
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is not None)[:2] == [1, 7]
            assert docs.where("doc_id = 3").count() == 0 and docs.where("doc_id IS NULL").count() == 1 and docs.where("doc_id = 9").count() == 2
    assert docs.where("doc_id IS NULL").count() == 1


def test_empty_table_goes_through_every_stage(spark, no_documents):
    docs = no_documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_all_operators_are_registered():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
