import math
import random

import numpy as np

from packetlens.llm import language

STEMS = {"xx": "ba be bi bo bu da de di".split(), "yy": "kra kro stri sta ple plo gru".split(), "zz": "oa ue ai iou éa ôe".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(spark, n=300):
    rng = random.Random(2)
    rows = [(k, prose(rng, x, rng.choice([2, 10, 80])), x, "s") for k in range(n) for x in [rng.choice(list(STEMS))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_held_out_accuracy(spark):
    df = corpus(spark)
    langs = {r.doc_id: r.lang for r in df.collect()}
    got = language.identified(df).collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in got if r.held_out]) > 0.97
    assert all(0 < r.score <= 1 for r in got)


def test_mixtures_are_found(spark):
    df = corpus(spark)
    langs, logs = language.fit(df)
    rng = random.Random(5)
    text = prose(rng, "xx", 140) + " " + prose(rng, "yy", 60)
    chosen, share = language.identified_one(language.grams(text), np.exp(logs))
    assert [langs[c] for c in chosen] == ["xx", "yy"] and share.argmax() == 0 or share[list(chosen).index(1)] > 0.2
    chosen, _ = language.identified_one(language.grams(prose(rng, "zz", 100)), np.exp(logs))
    assert [langs[c] for c in chosen] == ["zz"]


def test_only_text_decides(spark):
    df = corpus(spark)
    text = {r.doc_id: r.lang_pred for r in language.identified(df).collect()}
    import zlib

    held = [k for k in text if zlib.crc32(str(k).encode()) % 4 == 2]
    from pyspark.sql import functions as F

    other = df.withColumn("lang", F.when(F.col("doc_id").isin(held), "qq").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    assert {r.doc_id: r.lang_pred for r in language.identified(other).collect()} == text


def test_grams_by_blocks():
    text = prose(random.Random(1), "yy", 500)
    assert (language.grams(text, 64) == language.grams(text)).all()


def slow_grams(text):
    letters = [b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in (" " + text.lower() + " ").encode()]
    out = {}
    for k in range(1, 5):
        for i in range(len(letters) - k + 1):
            if k == 1 and letters[i] == 32:
                continue
            code = 0
            for b in letters[i : i + k]:
                code = code * 257 + b + 1
            place = ((code + k - 1) * 0x9E3779B1 >> 11) % language.DIMS
            out[place] = out.get(place, 0) + 1
    return out


def slow_identified(rows, text):
    """The whole method with dictionaries and plain loops."""
    import zlib

    sums = {}
    for i, t, lang in {(i, t, x) for i, t, x in rows if x is not None and zlib.crc32(str(i).encode()) % 4 != 2}:
        g = slow_grams(t)
        scale = min(1.0, 20_000 / max(1, sum(g.values())))
        for k, n in g.items():
            sums.setdefault(lang, {})[k] = sums.setdefault(lang, {}).get(k, 0) + round(n * 4096 * scale) / 4096
    langs = sorted(sums)
    total = {x: sum(sums[x].values()) for x in langs}
    everything = sum(total.values())
    g = slow_grams(text)
    weight = {k: n / 4 for k, n in g.items()}
    size = sum(weight.values())
    whole = {k: (sum(sums[x].get(k, 0) for x in langs) + 0.5) / (everything + 0.5 * language.DIMS) for k in g}
    p = {x: {k: (sums[x].get(k, 0) + 200 * whole[k]) / (total[x] + 200) for k in g} for x in langs}

    def em(share):
        for _ in range(12):
            new = {x: share[x] / size * sum(w * p[x][k] / sum(share[y] * p[y][k] for y in share) for k, w in weight.items()) for x in share}
            done = max(abs(new[x] - share[x]) for x in share) < 1e-4
            share = new
            if done:
                break
        return share, sum(w * math.log(sum(share[x] * p[x][k] for x in share)) for k, w in weight.items())

    share, fit = em({x: 1 / len(langs) for x in langs})
    while len(share) > 1:
        least = min(share, key=lambda x: (share[x], x))
        left = {x: share[x] for x in share if x != least}
        fewer, its = em({x: v / max(1e-12, sum(left.values())) for x, v in left.items()})
        if its + 0.5 * math.log(max(2.0, size)) < fit:
            break
        share, fit = fewer, its
    best = max(share, key=lambda x: share[x])
    return best, min(1.0, share[best])


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng, x, rng.choice([1, 5, 30])), x) for k in range(60) for x in [rng.choice(list(STEMS))]]
    rows += [(100 + k, prose(rng, "xx", 20) + " " + prose(rng, "yy", rng.choice([5, 20])), None) for k in range(10)]
    rows += [rows[0]] * 30  # repeats are learned from once
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identified(df).collect()}
    for i, t, _ in rows[:70:3] + rows[60:70]:
        best, score = slow_identified(rows, t)
        assert got[i][0] == best and abs(got[i][1] - score) < 1e-6


def test_the_fit_is_one_job_over_the_texts(spark):
    df = corpus(spark).repartition(40)
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("fit", "fit")
    language.fit(df)
    jobs = len(tracker.getJobIdsForGroup("fit"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 8


def test_odd_rows(spark, odd_docs, no_docs):
    rows = language.identified(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (0, 1, 2))
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert language.identified(no_docs).count() == 0
    unlabelled = corpus(spark, 5).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language.identified(unlabelled).collect()} == {"und"}


def test_rows_of_counts_do_not_follow_partitions(spark, monkeypatch):
    frame, made = type(spark.range(0)), []
    counted = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: made.append(counted(self, *a, **k)) or made[-1])
    docs = spark.createDataFrame([(k, f"words of number {k} and more of them", "en") for k in range(300)], "doc_id long, text string, lang string")
    found = []
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 60):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            langs, logs = language.fit(docs)
            found.append((made[-1].count(), logs.tolist()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert found[0] == found[1]
