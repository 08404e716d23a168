"""Language identification and toxicity: held-out accuracy and defined results for odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from glucolake.llm import langid as L
from glucolake.llm import toxicity as T
from glucolake.llm.queries import QUERIES, fold

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op5_langid"](spark, SF).join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.min("score"), F.max("score"), F.count("*")).first()
    assert got[0] >= 0.97 and 0 <= got[1] <= got[2] <= 1 and got[3] > 200


def test_byte_classes_ignore_case():
    assert (L.TABLE[np.frombuffer("ÉTÉ Ñandú ß".encode(), np.uint8)] == L.TABLE[np.frombuffer("été ñANDÚ ß".encode(), np.uint8)]).all()


def test_pooled_equals_convolution():
    rng = np.random.default_rng(2)
    net = L.train(rng.integers(0, 60, (40, L.WINDOW)).astype(np.uint8), rng.integers(0, 2, 40), ["a", "b"])
    x = rng.integers(0, 64, (3, L.WINDOW)).astype(np.uint8)
    slow = np.concatenate([np.stack([sum(net.filters[w][j][x[:, t + j]] for j in range(w)) for t in range(L.WINDOW - w + 1)]).max(axis=0) for w in L.WIDTHS], axis=1)
    assert np.allclose(net.pooled(x, net.tables()), np.maximum(0, slow + net.bias), atol=1e-4)


def test_language_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = L.fit(docs, fold(F.col("doc_id"), 4) != 2)
    rows = [(1, None), (2, ""), (3, "123 ... !!"), (4, "日本"), (5, "a"), (5, "a"), (None, "the and of that with"), (6, "the and of that with " * 20000)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int"), net).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] in net.labels and got[6][0] == "en" and 0 < got[6][1] <= 1
    assert L.fit(docs.where("false"), F.lit(True)) is None
    assert L.predict(docs.limit(1), None).first()["lang_pred"] == "und"


def test_short_texts_are_learned(spark):
    docs = spark.createDataFrame([(i, *(("bonjour", "fr"), ("hello", "en"), ("hallo", "de"))[i % 3]) for i in range(90)], "doc_id long, text string, lang string")
    net = L.fit(docs, F.lit(True))
    assert {(r["text"], r["lang_pred"]) for r in L.predict(docs, net).join(docs, "doc_id").collect()} == {("bonjour", "fr"), ("hello", "en"), ("hallo", "de")}


def test_all_labels_are_learned(spark):
    docs = spark.createDataFrame([(i, f"{chr(97 + i % 80 % 9) * 8} {chr(110 + i % 80 // 9) * 8}", f"l{i % 80}") for i in range(2400)], "doc_id long, text string, lang string")
    net = L.fit(docs, F.lit(True))
    assert len(net.labels) == 80
    right = L.predict(docs, net).join(docs, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count_distinct("lang_pred")).first()
    assert right[0] > 0.8 and right[1] > 64


def test_labelled_rows_without_text_still_give_a_label(spark):
    docs = spark.createDataFrame([(1, None, "xx"), (2, "", "yy")], "doc_id long, text string, lang string")
    net = L.fit(docs, F.lit(True))
    got = L.predict(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), net).collect()
    assert {r["doc_id"]: r["lang_pred"] in ("xx", "yy") for r in got} == {1: True, 2: False}


def test_sample_windows_come_from_whole_texts(spark, monkeypatch):
    """Every window of every labelled text is learned from where the bound allows; where it doesn't, windows from all over the text."""
    text = "".join(chr(97 + i // 256 % 26) for i in range(256 * 40))
    docs = spark.createDataFrame([(1, text, "xx")], "doc_id long, text string, lang string")
    args = (docs, F.lit(True), "doc_id", "text", "lang")
    assert len(L.sample_windows(*args)[0]) == 40
    monkeypatch.setattr(L, "SAMPLE", 12)
    x = L.sample_windows(*args)[0]
    assert 2 <= len(x) <= 30 and (x[:, 0] > 15).any()


def test_predictions_equal_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = L.fit(docs, fold(F.col("doc_id"), 4) != 2)
    some = docs.where("doc_id < 40")
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    for r in L.predict(some, net).collect():
        c = [int(L.TABLE[b]) for b in (texts[r["doc_id"]] or "").encode()]
        if not any(map(str.isalpha, texts[r["doc_id"]] or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        z = np.zeros(len(net.labels))
        cut = [(c[i : i + L.WINDOW] + [0] * L.WINDOW)[: L.WINDOW] for i in range(0, len(c), L.WINDOW)]
        for window in cut:
            for w in L.WIDTHS:
                for f in range(L.FILTERS):
                    k = L.WIDTHS.index(w) * L.FILTERS + f
                    best = max(sum(float(net.filters[w][j][window[t + j], f]) for j in range(w)) for t in range(L.WINDOW - w + 1))
                    z += max(0.0, best + float(net.bias[k])) * net.out[k]
            z += net.out_bias
        p = np.exp(z / len(cut) - (z / len(cut)).max())
        p /= p.sum()
        assert net.labels[int(p.argmax())] == r["lang_pred"] and abs(p.max() - r["score"]) < 1e-3
        if r["doc_id"] > 12:
            break


def sentences(n, seed):
    """Toxic ones carry an insult.  Of the labelled ones that name a group, nearly all are toxic, so a plain classifier would blame the group."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        toxic = i % 3 == 0
        words = [f"w{rng.randrange(60)}" for _ in range(12)]
        if toxic:
            words[3] = rng.choice(["vileword", "nastyish", "scumlike"])
            if rng.random() < 0.9:
                words[5] = "muslims"
        elif rng.random() < 0.02:
            words[5] = "christians"
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_neutral_mentions_are_left_alone(spark):
    rows = sentences(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (4, None)], "doc_id long, toxic int")
    score = T.fit(docs, labels, lambda c: F.lit(True)).scorer()
    neutral = "w1 w2 w3 {} w5 w6 w7"
    a, b, c = (score(neutral.format(x)) for x in ("muslims", "christians", "jews"))
    assert max(a, b, c) < 0.5 and abs(a - b) < 0.15
    assert score("w1 vileword w2") >= 0.5 > score("w1 w2") and score(None) == score("")


def test_toxicity_of_held_out_documents(spark):
    """Recall and precision on labelled rows that were not learned from."""
    large = SF.replace("0.01", "0.1")
    labels = spark.read.parquet(f"{large}/labels.parquet").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = QUERIES["op10_toxicity"](spark, large).where("held_out").join(labels, "doc_id").groupBy("predicted", "toxic").count().collect()
    n = {(r["predicted"], r["toxic"]): r["count"] for r in got}
    hit, missed, wrong = n.get((1, 1), 0), n.get((0, 1), 0), n.get((1, 0), 0)
    assert hit + missed > 80 and hit / (hit + missed) > 0.9 and hit / (hit + wrong) > 0.9


def test_scores_equal_plain_loops(spark):
    rows = sentences(300, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, "Vileword vileword")], "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), lambda c: F.lit(True))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in T.scored(docs, model).collect():
        found = {f for w in T.LETTERS.findall((texts[r["doc_id"]] or "").lower()) for f in T.features_of(w)}
        z = model.bias + sum(float(w) for f, w in zip(model.features, model.weights, strict=True) if f in found)
        assert abs(1 / (1 + np.exp(-z)) - r["score"]) < 1e-9


def test_few_toxic_texts_are_enough(spark):
    rows = [(i, f"w{i % 7} w{i % 11} " + ("vileword" if i < 3 else "fine"), int(i < 3)) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), lambda c: F.lit(True))
    assert "vileword" in model.features and model.scorer()("w1 vileword") >= 0.5


def test_swaps_equal_the_features_of_swapped_texts():
    """The features that come and go are those by which the whole swapped text differs."""
    names = {t: set(T.features_of(t)) for terms in T.IDENTITIES for t in terms}
    for words in ({"black", "blacksmith", "cat"}, {"women", "men", "womens"}, {"old", "young", "gay"}):
        whole = lambda ws: {f for w in ws for f in T.features_of(w)}
        x = whole(words)
        own = {t: {f for f in names[t] if sum(f in T.features_of(w) for w in words) == 1} for t in words if t in names}
        got = T.swaps(x, own, names)
        want = [(whole(words - {t} | {o}), t, o) for terms in T.IDENTITIES for t in terms if t in words for o in terms if o != t]
        assert len(got) == len(want) > 0
        for (come, go), (after, _, _) in zip(got, want, strict=True):
            assert (x - set(go)) | set(come) == after


def test_toxicity_of_odd_rows(spark):
    rows = sentences(300, 2)
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows] + [(None, None, 1), (7, "", 1), (7, "x " * 100000, 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = T.fit(docs, labels, lambda c: F.lit(True))
    got = T.scored(docs, model).collect()
    assert len(got) == 303 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert T.scored(docs, T.fit(docs, labels.where("toxic = 0"), lambda c: F.lit(True))).agg(F.max("score")).first()[0] == 0.0
    assert T.scored(docs.where("false"), model).count() == 0
