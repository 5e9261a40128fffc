import shutil
import subprocess
import sys
from pathlib import Path

from lexigrid.llm import decontam, neardup, packing, pii, quality
from tests_llm_common import SMALL

ROOT = Path(__file__).resolve().parents[2]


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if k < 4:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        rows = {r.doc_id: r for r in docs.collect()} if k < 4 else docs.collect()
        old = {r.doc_id: r for r in before.collect()}
        if name == "quality":
            score = {r.doc_id: r.predicted for r in quality.score(before, quality.fit(before, spark.read.parquet(f"{SMALL}/labels.parquet"))).collect()}
            assert set(rows) == {d for d in old if score[d]} and all(rows[d] == old[d] for d in rows)
        elif name == "near_duplicates":
            kept = {r.doc_id for r in neardup.near_duplicates(before).collect() if r.is_kept}
            assert set(rows) == kept and len(kept) < len(old) and all(rows[d] == old[d] for d in rows)
        elif name == "decontamination":
            bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
            hits = {r.doc_id: r for r in decontam.contamination(before, bench).collect()}
            assert set(rows) == {d for d in old if not hits[d].contaminated}
            assert all((rows[d].text == old[d].text) == (hits[d].n_hit == 0) for d in rows) and any(h.n_hit for h in hits.values())
            assert {r.n_hit for r in decontam.contamination(docs, bench).collect()} == {0}
        elif name == "pii":
            assert set(rows) == set(old) and sum(rows[d].text != old[d].text for d in rows) == pii.pseudonymise(before, "k").filter("n_pii > 0").count() > 0
        else:
            assert {r.doc_id for r in rows} == set(old)
            key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
            assert sorted(map(key, rows)) == sorted(map(key, packing.pack_documents(before).collect()))
        counts.append(len(rows))
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0


def test_run_gives_pieces_of_kept_documents(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert len(rows) > 100 and sum(r.length for r in rows if r.start == 0) > 0


def test_the_rest_imports_without_this_package(tmp_path):
    for name in ("lexigrid", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "lexigrid" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
