import random

from pyspark.sql import functions as F

from brevispark.llm import language_id as op

WORDS = {"en": "the and that with from this have which their there would about".split(), "de": "und der nicht auch eine sich werden schon über zwischen".split(), "fr": "les des une dans pour avec être cette leurs après où".split()}


def labelled(spark, n=200, seed=1):
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(5, 60))), lang) for i in range(n) for lang in [rnd.choice(sorted(WORDS))]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_held_out_accuracy(spark):
    docs = labelled(spark)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    out = op.identify(docs.where(held), op.train(docs.where(~held))).join(docs, "doc_id")
    assert out.where("lang <> lang_pred").count() == 0 and out.count() > 30


def test_mixtures(spark):
    model = op.train(labelled(spark))
    text = " ".join(WORDS["en"] * 6 + WORDS["de"] * 2)
    row = op.identify(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model).first()
    assert [x.lang for x in row.languages] == ["en", "de"] and 0.65 < row.score < 0.9
    single = op.identify(spark.createDataFrame([(1, " ".join(WORDS["fr"] * 4))], "doc_id bigint, text string"), model).first()
    assert [x.lang for x in single.languages] == ["fr"] and single.score == 1.0


def test_small_memory_changes_nothing(spark, monkeypatch):
    model = op.train(labelled(spark))
    texts = [(i, " ".join(random.Random(i).choices(WORDS["en"] + WORDS["de"], k=40))) for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    usual = sorted(map(str, op.identify(docs, model).collect()))
    monkeypatch.setattr(op, "MOST_WORDS", 5)
    again = sorted(map(str, op.identify(docs.repartition(1), model).collect()))
    assert usual == again


def test_copies_teach_once_and_every_language_is_taught(spark):
    rows = [(f"und der nicht auch {w} eine sich werden schon", "de") for w in ("hier", "dort")] * 300
    rows += [(" ".join(WORDS["fr"]), lang) for lang in ["fr"] * 900] + [("the and that with from this " + "x" * i, "en") for i in range(1, 60)] + [("12 34", "zz")] * 5
    docs = spark.createDataFrame(rows, "text string, lang string")
    for most in (1, 2, 10):
        model, single = op.train(docs.repartition(7), most), op.train(docs.distinct(), most)
        assert model.names == single.names == ["de", "en", "fr"]
        assert model.weights.digest() == single.weights.digest()
    one = docs.where("lang = 'fr'")
    assert op.train(one).weights.digest() == op.train(one.limit(1)).weights.digest()


def test_every_label_is_learnt(spark, monkeypatch):
    names = [f"l{i:03}" for i in range(200)]
    own = lambda i: [f"{chr(0x4E00 + i)}{chr(0x5E00 + i)}{x}" for x in "abcdefgh"]
    rows = [(" ".join(random.Random(7 * i + j).choices(own(i), k=12)), n) for i, n in enumerate(names) for j in range(3)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = op.train(docs)
    assert model.names == names and model.weights.dense is None
    asked = spark.createDataFrame([(i, " ".join(random.Random(-i).choices(own(i), k=9))) for i in range(200)], "doc_id bigint, text string")
    assert {r.doc_id: r.lang_pred for r in op.identify(asked, model).collect()} == dict(enumerate(names))
    monkeypatch.setattr(op, "MOST_DENSE", 300)
    dense = op.train(docs)
    words = ["xyz", *own(0), *own(199)]
    for m in (model, dense):
        m.learn(words)
    assert dense.weights.dense is not None and abs(model.rows - dense.rows).max() < 1e-3


def plain(text, model):
    """Mixture inference by the book, one word and language at a time: shares of the chosen set."""
    import math

    words = [w for w in text.split() if any(map(str.isalpha, w))]
    k = len(model.names)
    logs = [[sum(float(model.weights[[g]][0, j]) for g in op.grams(w)) for j in range(k)] for w in words]
    if not words:
        return [0.0] * k

    def em(chosen):
        share = [1 / len(chosen) if j in chosen else 0.0 for j in range(k)]
        for _ in range(op.ROUNDS):
            total = [0.0] * k
            for row in logs:
                part = [s * math.exp(max(x - max(row), -60)) for s, x in zip(share, row)]
                total = [t + p / sum(part) for t, p in zip(total, part)]
            share = [t / len(words) for t in total]
        return share, sum(math.log(sum(s * math.exp(max(x - max(row), -60)) for s, x in zip(share, row))) for row in logs)

    single = [sum(row[j] - max(row) for row in logs) for j in range(k)]
    best = max(range(k), key=lambda j: (single[j], -j))
    full, _ = em(range(k))
    order = [best, *sorted((j for j in range(k) if j != best), key=lambda j: -full[j])]
    answer, criterion = [float(j == best) for j in range(k)], -2 * single[best]
    for size in range(2, k + 1):
        share, fit = em(order[:size])
        if (now := -2 * fit + math.log(max(len(words), 2)) * (size - 1)) < criterion:
            answer, criterion = share, now
    return answer


def test_equals_plain_inference(spark):
    import numpy as np

    model = op.train(labelled(spark))
    rnd = random.Random(7)
    texts = ["", "12 %", "the"]
    for _ in range(40):
        langs = rnd.sample(sorted(WORDS), rnd.randint(1, 3))
        texts.append(" ".join(rnd.choice(WORDS[rnd.choice(langs)]) for _ in range(rnd.randint(1, 50))))
    at, owner = model.words_of(texts)
    shares, _ = model.infer(model.rows[at], owner, len(texts))
    for text, got in zip(texts, shares):
        assert np.allclose(got, plain(text, model), atol=1e-3), text


def test_odd_rows(spark, odd_documents):
    model = op.train(odd_documents)
    rows = op.identify(odd_documents, model, keep=tuple(odd_documents.columns)).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        und = r.text is None or not any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == und and 0 <= r.score <= 1


def test_empty_tables(spark, no_documents, odd_documents):
    model = op.train(no_documents)
    assert {r.lang_pred for r in op.identify(odd_documents, model).collect()} == {"und"}
    assert op.identify(no_documents, model).count() == 0


def test_words_learnt_together_equal_single_ones(spark):
    model = op.train(labelled(spark))
    words = ["the", "Straße", "x", "a1-é", "\x02\x03q", "und,", "12"]
    model.learn(words)
    for w in words[:-1]:
        assert abs(model.rows[model.known[w]] - model.weights[op.grams(w)].sum(0)).max() < 1e-4
    assert model.known["12"] == -1
