import random

import pytest

import corpus_pipeline
from packetlens.llm import secrets

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, prose(rng, rng.randint(100, 200)), "en", f"s{k % 3}") for k in range(120)]
    rows += [(200 + k, rows[k][1], "en", "s0") for k in range(10)]
    rows += [(300 + k, rows[k][1].replace(rows[k][1].split()[9], "other", 1), "en", "s1") for k in range(10, 20)]
    rows += [(400 + k, " ".join(w + "###" for w in prose(rng, 80).split()), "en", "s1") for k in range(10)]
    rows += [rows[3]]
    rows += [(500, prose(rng, 40) + " password = hunter2222", "en", "s2"), (500, "twice the same id " + prose(rng, 40), "en", "s2")]
    df = spark.createDataFrame([(*r, len(r[1])) for r in rows], COLUMNS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == df.columns
        kept.append(docs.collect())
    ids = [[r.doc_id for r in x] for x in kept]
    assert {i for i in ids[0] if i < 400} == {r[0] for r in rows if r[0] < 400} and not any(400 <= i < 420 for i in ids[0])
    assert sorted(ids[1]) == [*range(120), 500, 500]
    assert sorted(r.text.endswith("[secret]") for r in kept[2] if r.doc_id == 500) == [False, True]
    assert secrets.scanned(spark.read.parquet(str(tmp_path / "stage2"))).where("n_assign > 0").count() == 0
    assert set(ids[3]) <= set(ids[2]) and max(ids[3].count(i) for i in set(ids[3]) - {500}) <= 2
    assert sorted(ids[4]) == sorted(ids[3]) and all(r.n_tokens > 0 for r in kept[4])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids[4])


def some(spark, n=80):
    rng = random.Random(3)
    rows = [(k, prose(rng, rng.randint(30, 60)), "en", f"s{k % 3}") for k in range(n)]
    rows += [(n + k, " ".join(w + "###" for w in prose(rng, 40).split()), "en", "s1") for k in range(8)]
    return spark.createDataFrame([(*r, len(r[1])) for r in rows], COLUMNS)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_each_stage_alone(spark, tmp_path, k):
    """A stage needs no session that an earlier stage has set up, and no table beside its rows."""
    corpus_pipeline.FITTED.clear()
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    name, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, some(spark), str(tmp_path / "none")).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000" or name == "secret scans"


def test_mixture_takes_the_first_stage_s_classifier(spark, tmp_path, monkeypatch):
    """The mix is the one of a classifier fitted anew, without reading and fitting all documents again."""
    some(spark).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    corpus_pipeline.FITTED.clear()
    anew = sorted(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect())
    corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    monkeypatch.setattr(corpus_pipeline.quality, "fit", lambda *_: pytest.fail("fitted again"))
    assert anew == sorted(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect())
