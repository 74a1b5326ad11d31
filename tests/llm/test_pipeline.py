"""The pipeline over a small corpus with planted cases, and each stage on the stage before's own output."""

import random

import duckdb
import pytest

import corpus_pipeline as pipeline
from quotalake.llm import queries as Q
from tests.llm.conftest import SF, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(11)
    path = str(tmp_path_factory.mktemp("planted"))
    item = prose(rng, 40)
    good = {d: ". ".join(prose(rng, 12).capitalize() for _ in range(10)) + "." for d in range(300)}
    texts = dict(good)
    junk = {d: " | ".join(prose(rng, 60).upper().split()) + "!!" for d in range(300, 360)}
    texts |= junk
    texts |= {400: good[3], 401: good[4] + " extra", 402: good[5][:300] + " " + item + " " + good[6][:200], 403: "", 404: None}
    near = good[7].split()
    near[50] = "other"
    texts[405] = " ".join(near)
    texts[406] = good[8] + "\nOne shared line of quite a few words here."
    texts[407] = good[9] + "\nOne shared line of quite a few words here."
    rows = [(d, t, "en", f"s{d % 4}", len(t or "")) for d, t in texts.items()]
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{path}/documents.parquet")
    labels = [(d, 1, 0) for d in range(0, 300, 2)] + [(d, 0, 0) for d in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, junk


def test_stages(spark, planted):
    path, texts, junk = planted
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out.write.parquet(f"{path}/{name}")
            docs = spark.read.parquet(f"{path}/{name}")
            seen.append({r.doc_id: r.text for r in docs.collect()})
    quality, deduped, single, clean = seen
    assert not set(junk) & set(quality) and len(set(range(300)) - set(quality)) <= 3
    assert 400 not in deduped and "One shared line" not in (deduped.get(407) or "")
    assert {400, 401, 405}.isdisjoint(single) and {3, 4, 7} <= set(single) | (set(range(300)) - set(quality))
    assert set(single) - set(clean) == ({402} & set(single)) and len(clean) > 280
    packed = pipeline.run(spark, path).collect()
    assert {r.doc_id for r in packed} == set(clean)
    assert sorted(r.sequence_id * 2048 + r.offset + k for r in packed for k in range(r.length)) == list(range(sum(r.length for r in packed)))


@pytest.mark.parametrize("key", sorted(Q.oracle_sql()))
def test_oracle(spark, key):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = Q.queries()[key](spark, SF)
    rel = con.execute(Q.oracle_sql()[key])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(rel.fetchall())


def test_thirteen_operators_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in Q.queries()) == list(range(1, 14))
