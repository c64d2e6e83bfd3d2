"""The pipeline's stages, each on its own input, and the guard in the entry module."""

import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from leafwire.llm import quality, secrets, simhash
from tests.llm import brute
from tests.llm.test_similar import brute as near_copies

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, sf_dir).cache()
        if i < 4:
            assert out.columns == docs.columns and out.schema == docs.schema
        after = {r["doc_id"] for r in out.collect()}
        if i == 0:
            net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            keep = quality.scores(net, [t.encode() for _, t in before]) >= 0.7
            assert after == {d for (d, _), k in zip(before, keep) if k}
        elif i == 1:
            assert after == near_copies(before)
        elif i == 2:
            assert after == {r[0] for r in brute.contamination(before, bench) if not r[3]}
        elif i == 3:
            for r in out.collect():
                assert not brute.secret_spans(r["text"]) and r["n_chars"] == len(r["text"])
            assert after == {d for d, _ in before}
        else:
            assert after == {d for d, _ in before}
        docs = out


def test_planted_passages_go_and_clean_documents_stay(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/../sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    some = [r["text"] for r in bench.orderBy("item_id").limit(5).collect()]
    clean = [(i, f"word{i} " * 30 + "nothing of the benchmark stands here") for i in range(5)]
    planted = [(100 + i, f"some text before {t} and some after") for i, t in enumerate(some)]
    mine = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in clean + planted], docs.select(*corpus_pipeline.COLUMNS).schema)
    assert {r["doc_id"] for r in corpus_pipeline.without_benchmark(spark, mine, f"{sf_dir}/../sf0.01").collect()} == set(range(5))
    got = {r["doc_id"] for r in corpus_pipeline.without_benchmark(spark, docs, f"{sf_dir}/../sf0.01").collect()}
    rows = brute.contamination([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    hit = {r[0] for r in rows if r[3]}
    assert hit and got == {r[0] for r in rows} - hit


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_odd_tables(spark, odd_docs, empty_docs, sf_dir):
    """Nulls, repeated rows, long and empty texts, extra columns: each stage's defined result."""
    stages = [f for _, f in corpus_pipeline.STAGES]
    for stage in stages:
        assert stage(spark, empty_docs, sf_dir).count() == 0
    before = sorted((r["doc_id"], r["text"]) for r in odd_docs.where("doc_id is not null and text is not null").collect())
    good = stages[0](spark, odd_docs, sf_dir)
    assert good.columns == corpus_pipeline.COLUMNS and {r["doc_id"] for r in good.collect()} <= {d for d, _ in before} | {None, 2}
    alone = [r["doc_id"] for r in stages[1](spark, odd_docs, sf_dir).collect()]
    assert {2, 5, 8, 9} <= set(alone) and not {3, 4, 6, 7} & set(alone) and alone.count(5) == 2  # another text under the same id stays
    assert stages[2](spark, odd_docs, sf_dir).count() == odd_docs.count()
    clean = {r["doc_id"]: r for r in stages[3](spark, odd_docs, sf_dir).collect()}
    assert clean[2]["text"] is None and "[secret]" in clean[9]["text"] and clean[9]["n_chars"] == len(clean[9]["text"])
    packed = stages[4](spark, odd_docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in odd_docs.collect()}
    assert secrets.redact(odd_docs).columns == odd_docs.columns
    assert simhash.drop_near_duplicates(odd_docs).columns == odd_docs.columns


def test_entry_without_the_subpackage(tmp_path):
    for name in ("leafwire", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "leafwire" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    shutil.copytree(ROOT / "tests", tmp_path / "tests")
    shutil.rmtree(tmp_path / "tests" / "llm")
    subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=tmp_path, check=True)
    subprocess.run([sys.executable, "-m", "pytest", "tests/test_grammar.py", "tests/test_codec.py", "-q"], cwd=tmp_path, check=True)
