"""The pipeline's stages one after another, on a corpus with every odd case; and its wiring."""

import corpus_pipeline
from tests.llm.test_ops import corpus, near_brute

from tessera.llm import decontaminate, secrets
from tessera.llm.quality import ledger, passes


def test_stages(spark, tmp_path):
    rows = [*corpus(), (9001, "my token = abcdefgh12345 " + " ".join(f"word{k}" for k in range(60)))]
    marked = [t for _, t in rows if t and len(t.split()) > 60][10]
    items = [(1, " ".join(marked.split()[:40]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, d = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    columns = docs.columns
    key = lambda df: sorted(str(r.doc_id) for r in df.collect())

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "decontamination", "secret_scans", "packing"]
    good = stages["quality_rules"](spark, docs, d)
    assert good.columns == columns and key(good) == key(ledger(docs).where(passes("v1")))
    one = stages["near_dedup"](spark, good, d)
    left = [(r.doc_id, r.text) for r in good.collect()]
    assert one.columns == columns and key(one) == sorted(str(i) for i, *_, kept in set(near_brute(left, 5, 80)) if kept)
    clean = stages["decontamination"](spark, one, d)
    brute = decontaminate.brute([(str(r.doc_id), r.text) for r in one.collect()], items)
    assert clean.columns == columns and key(clean) == sorted(i for i, (n, hit, _) in brute.items() if not (hit and 20 * len(hit) >= n))
    safe = stages["secret_scans"](spark, clean, d)
    assert safe.columns == columns and key(safe) == key(clean)
    assert all(not secrets.find(r.text) and r.n_chars == len(r.text) for r in safe.collect())
    pieces = stages["packing"](spark, safe, d)
    assert sorted({str(r.doc_id) for r in pieces.collect()}) == sorted(set(key(safe)))
    # cuts follow the partitions of the scan; what is packed doesn't
    whole = lambda df: sorted(map(str, df.groupBy("doc_id", "doc_tokens").sum("length").collect()))
    assert whole(corpus_pipeline.run(spark, d)) == whole(pieces)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
