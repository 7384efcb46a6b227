from __future__ import annotations

from collections import Counter

import corpus_pipeline
from helpers import clashing, docs

from quillspan.scratch import save


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "packing"]


def test_stages_keep_columns_and_rows_fall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = table.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = save(stage(spark, table, sf_dir), "test")
        assert out.columns == table.columns and out.dtypes == table.dtypes
        assert 0.7 * last < out.count() <= last, name
        ids = Counter(r.doc_id for r in out.select("doc_id").collect())
        assert max(ids.values()) == 1
        table, last = out, out.count()
    pieces = corpus_pipeline.pack_sequences(spark, table, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == set(ids)


def test_planted_cases(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()
    passage = " ".join(f"passage{i}" for i in range(60))
    base = [f"base{i}" for i in range(200)]
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(40))
    rows = [(1, own(1), "s"), (2, own(2) + "\n" + passage, "s"), (3, own(3) + "\n" + passage, "s"), (4, own(4) + "\n" + bench.text + "\n" + own(5), "s"), (5, " ".join(base), "s"), (6, " ".join([*base[:50], "edit", *base[51:150], "more", *base[151:]]), "s"), (7, own(1), "s")]
    table = clashing(docs(spark, rows))
    deduped = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, table, sf_dir).collect()}
    assert passage in deduped[2] and deduped[3] == own(3) and 7 not in deduped and deduped[5] == " ".join(base)
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, table, sf_dir).collect()} == {1, 2, 3, 4, 5}
    assert {r.doc_id for r in corpus_pipeline.decontaminate(spark, table, sf_dir).collect()} == {1, 2, 3, 5, 6, 7}
    assert corpus_pipeline.keep_one_of_each(spark, table, sf_dir).columns == table.columns


def test_rows_without_a_doc_id_or_of_one_doc_id_are_judged_apart(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(40))
    near = own(1) + " more"
    rows = [(None, own(1), "s"), (None, own(2), "s"), (None, own(2), "t"), (None, own(3), "s"), (1, own(4), "s"), (1, own(5), "s"), (2, near, "s"), (None, own(6) + "\n" + bench.text, "s"), (1, own(7) + "\n" + bench.text, "s")]
    table = docs(spark, rows)
    kept = sorted([(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each(spark, table, sf_dir).collect()], key=str)
    assert kept == sorted({(i, t) for i, t, _ in rows} - {(None, own(1))}, key=str)
    clean = sorted([(r.doc_id, r.text) for r in corpus_pipeline.decontaminate(spark, table, sf_dir).collect()], key=str)
    assert clean == sorted([(i, t) for i, t, _ in rows if bench.text not in t], key=str)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100


def test_stages_take_odd_and_empty_tables(spark, sf_dir):
    from helpers import odd_docs

    for table in (clashing(odd_docs(spark)), clashing(docs(spark, []))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, sf_dir)
            assert out.columns == table.columns, name
            assert out.where("doc_id in (1, 2)").count() == table.where("doc_id in (1, 2)").count(), name
        assert corpus_pipeline.pack_sequences(spark, table, sf_dir).select("doc_id").distinct().count() == table.select("doc_id").distinct().count()
