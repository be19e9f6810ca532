import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import lang_id, quality
from graphloom.llm.common import fold_of
from graphloom.llm.queries import queries

EN, DE = "the thing that they thought about with other people there ", "der schöne Tag und die Nacht über dem großen Wald nicht weit "


def brute_rank(text):
    """Most frequent n-grams by counting in a dictionary."""
    clean = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = f" {' '.join(clean.split())} "
    code = lambda c: 0 if c == " " else ord(c)
    counts = {}
    for n, tag in ((1, 2 << 60), (2, 1 << 60), (3, 0)):
        for k in range(len(padded) - n + 1):
            gram = padded[k : k + n]
            if gram != " ":
                value = 0
                for c in gram:
                    value = value << 20 | code(c)
                counts[tag | value] = counts.get(tag | value, 0) + 1
    return sorted(counts, key=lambda g: (-counts[g], g))[: lang_id.DOC_GRAMS]


def test_ranks_equal_brute_force():
    for text in (EN * 3, DE * 9, "Ünï ßtraße 123 привет, мир! 中文", "a", "x-y", " ".join(random.Random(k).choice(["der", "the", "ça", "niño"]) for k in range(400))):
        assert lang_id.ranked(lang_id.letter_grams_of(text)).tolist() == brute_rank(text)
    assert len(lang_id.letter_grams_of("123 !?")) == 0


def test_letters_of_scripts_are_apart():
    draw = random.Random(3)
    texts = {"ru": " ".join("".join(draw.choices("абвгдежз", k=4)) for _ in range(80))}
    texts["ar"] = "".join(c if c == " " else chr(ord(c) + 0x200) for c in texts["ru"])
    profiles = lang_id.Profiles.of({k: lang_id.ranked(lang_id.letter_grams_of(t), 400).tolist() for k, t in texts.items()})
    assert {k: profiles.predict(t)[0] for k, t in texts.items()} == {"ru": "ru", "ar": "ar"}
    got = lang_id.letter_grams_of("中 a\U00030000")
    h, x, e = 0x4E2D, 0x61, 0x30000
    two, three = [h, h << 20, x, x << 20 | e, e << 20], [h << 20, h << 40 | x, x << 20 | e, x << 40 | e << 20]
    assert sorted(got.tolist()) == sorted([g | 2 << 60 for g in (h, x, e)] + [g | 1 << 60 for g in two] + three)


def test_prediction_and_undecided(spark):
    rows = [(k, (EN if k % 2 else DE) * (1 + k % 5), "en" if k % 2 else "de") for k in range(60)] + [(100, None, "en"), (101, "123", None), (102, "", "de"), (103, "the thing with people", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = lang_id.learn(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lang_id.predict(docs, model, keep=["doc_id"]).collect()}
    assert all(got[k][0] == ("en" if k % 2 else "de") and 0.5 < got[k][1] <= 1 for k in range(60))
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "en"
    assert sorted(r["doc_id"] for r in lang_id.identified(docs, model).collect()) == [*range(60), 103]
    none = lang_id.learn(docs.where("false"))
    assert {r["lang_pred"] for r in lang_id.predict(docs, none, keep=["doc_id"]).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries()["op5_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_bradley_terry_orders_and_thresholds(spark):
    draw = np.random.default_rng(1)
    x = draw.standard_normal((400, quality.N_FEATURES))
    label = (x[:, 3] + 0.1 * draw.standard_normal(400) > -0.7).astype(int)
    model = quality.fit(x, label)
    p = model.probability(model.latent(x))
    assert np.mean((p >= quality.THRESHOLD) == label) > 0.93
    assert abs(np.mean(p < quality.THRESHOLD) - np.mean(label == 0)) < 0.02
    assert np.allclose(quality.fit(x, np.ones(400, int)).probability(np.zeros(2)), quality.THRESHOLD)


def test_quality_on_held_out_labels_and_edge_cases(spark):
    sf = "/root/testdata/sf0.01"
    got = queries()["op6_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 100_000), (3, "x " * 100_000)], "doc_id long, text string")
    model = quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    rows = quality.predict(docs, model, ["doc_id"]).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_folds(spark):
    import zlib

    rows = spark.range(50).select("id", fold_of(F.col("id")).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)
