import corpus_pipeline
import pytest
from oracle_check import compare, connect
import oracle_check

import __spark_entry__ as entry_module
from dispatchmart.llm import queries
from dispatchmart.llm.common import table
from test_near_copies import brute_groups, brute_links
from test_packing import check_layout
from test_quality_rules import brute_force

SF_DIR = "/root/testdata/sf0.01"


def test_stages_agree_with_brute_force(spark, tmp_path):
    docs = table(spark, SF_DIR, "documents")
    columns = docs.columns
    results = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        results.append(docs)
    classified, cleaned, single, packed = results
    assert all(df.columns == columns for df in results[:-1])
    first = {r["doc_id"]: r for r in classified.collect()}
    quality = {r["doc_id"]: r["quality"] for r in table(spark, SF_DIR, "labels").collect()}
    assert sum(quality.get(i) == 0 for i in first) <= 2
    assert sum(q == 1 for i, q in quality.items() if i not in first) <= 2
    wanted = {i: brute_force(r["text"]) for i, r in first.items()}
    second = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert second == {i: m["clean_text"] for i, m in wanted.items() if m["kept"]}
    texts = sorted(second.items())
    third = {r["doc_id"]: r for r in single.collect()}
    groups = brute_groups(texts, brute_links(texts))
    missed = set(third) - set(groups.values())
    assert set(groups.values()) <= set(third) and len(missed) <= 0.01 * (len(texts) - len(set(groups.values())))
    assert all(r["text"] == second[i] and r["n_chars"] == len(r["text"]) for i, r in third.items())
    rows = packed.collect()
    assert {r["doc_id"] for r in rows} == set(third)
    assert check_layout(rows, 1024) <= 1.005 * sum(r["length"] for r in rows) / 1024 + 1


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_against_sql(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(oracle_check, "QUERIES", queries.QUERIES)
    monkeypatch.setattr(oracle_check, "ORACLES", queries.ORACLES)
    monkeypatch.setattr(oracle_check, "TABLES", (*oracle_check.TABLES, "pages", "labels"))
    con = connect(sf_dir)
    assert compare(spark, con, name, sf_dir) == ""


def test_all_are_registered():
    names = entry_module.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
