"""The pipeline against brute force, stage by stage, and the registry."""

import __spark_entry__ as entry
import corpus_pipeline
from examlytics.llm import decontaminate
from test_decontaminate import leaks, tokens
from test_minhash_dedup import groups, shingles

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 120").cache()
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    before = docs.collect()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = docs.collect()
        if name == "best_fit_packing":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            continue
        assert docs.columns == columns and set(after) <= set(before)
        left = sorted(r.doc_id for r in after)
        if name == "language_id":
            assert left == sorted(r.doc_id for r in before if any(c.isalpha() for c in r.text or ""))
        elif name == "exact_dedup":
            top = {}
            for r in before:
                top[r.text] = max(top.get(r.text, -1), r.doc_id)
            assert left == sorted(top.values())
        elif name == "minhash_near_dedup":
            root = groups([shingles(r.text) for r in before])
            least = {}
            for r, g in zip(before, root):
                least[g] = min(least.get(g, r.doc_id), r.doc_id)
            assert left == sorted(least.values())
        else:
            words = [set(tokens(b)) for b in bench]
            assert left == sorted(r.doc_id for r in before if not any(
                len(w & set(tokens(r.text))) * 100 >= 40 * len(w) and leaks(r.text, b) for b, w in zip(bench, words)))
        before = after
    assert decontaminate.WINDOW == 20


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and len([k for k in names if k.startswith("op")]) >= 10
    assert set(entry.oracle_sql()) <= set(names)


def test_sql(spark):
    from examlytics.llm import queries
    from tools.check_oracle import check
    report = check(spark, SF, sorted(queries.ORACLE_SQL))
    assert all(v["ok"] is True for v in report.values()), report


def test_near_stage_links_from_080(spark):
    """Pairs with a similarity from 0.80 up to 0.85 link in the pipeline's stage and not in op3; lower ones stay."""
    from examlytics.llm import minhash_dedup
    rows, similar = [], []
    for p in range(60):
        words = [f"p{p}w{i}" for i in range(104)]
        other = list(words)
        for e in range(p % 3):
            other[20 + 30 * e] = "x"  # five shingles of 100: 0.90, 0.82 and, with the tail, 0.80 and lower
        cut = {0: 20, 1: 0, 2: 0}[p % 3] + (p // 3) % 4
        rows += [(2 * p, " ".join(words)), (2 * p + 1, " ".join(other[:len(other) - cut]))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        similar.append(100 * len(a & b) / len(a | b))
    assert sum(80 <= s < 85 for s in similar) >= 20 and min(similar) < 80 < 85 < max(similar) and 80 in similar
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.no_near_copies(spark, docs, SF).collect()}
    assert left == {2 * p for p in range(60)} | {2 * p + 1 for p in range(60) if similar[p] < 80}
    assert {r.doc_id for r in minhash_dedup.keep_one(docs).collect()} == {2 * p for p in range(60)} | {
        2 * p + 1 for p in range(60) if similar[p] < 85}
    assert [minhash_dedup.bands_for(x) for x in (80, 85)] == [35, 24]
