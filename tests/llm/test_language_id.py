import numpy as np
from pyspark.sql import functions as F

from examlytics.llm import language_id as m


def test_score_matches_counting_by_hand():
    """The vectorised score is the sum of the log probabilities of the bins of each n-gram."""
    rng = np.random.default_rng(2)
    logp = np.log(rng.random((3, 512)).astype(np.float32))
    logp[:, 0] = 0
    texts = ["Hello, World", "a", "", None, "1 2 3", "é" * 5, "ab 12 cd"]
    names, score = m.score_texts(texts, ["x", "y", "z"], logp)
    for t, name, s in zip(texts, names, score):
        c, start, has = m.codes([t or ""])
        bins = m.ngram_bins(c, 512)[:, start[0]:].ravel()
        total = logp[:, bins].sum(1)
        if not has[0]:
            assert (name, s) == ("und", 0.0)
        else:
            assert name == "xyz"[int(total.argmax())]
            assert abs(s - 1 / np.exp(total - total.max()).sum()) < 1e-5


def test_pieces_do_not_change_short_texts(monkeypatch):
    rng = np.random.default_rng(3)
    logp = np.log(rng.random((2, 512)).astype(np.float32))
    logp[:, 0] = 0
    texts = ["one two three", "vier fünf", "seis"] * 20
    whole = m.score_texts(texts, ["a", "b"], logp)
    monkeypatch.setattr(m, "PIECE", 30)
    part = m.score_texts(texts, ["a", "b"], logp)
    assert whole[0] == part[0] and np.allclose(whole[1], part[1])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels, logp = m.train(docs.filter(~m.held_out()))
    assert labels == ["de", "en", "es", "fr"]
    out = m.predict(docs.filter(m.held_out()), labels, logp)
    assert out.columns == [*docs.columns, "lang_pred", "score"]
    hit, n, lo, hi = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 200 and hit > 0.97 and 0 <= lo <= hi <= 1


def test_label_is_no_input(spark):
    """A held-out row's own label does not change its prediction."""
    rows = [(i, f"alpha beta gamma {i}" if i % 2 else f"uno dos tres {i}", "en" if i % 2 else "es") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = docs.withColumn("lang", F.when(m.held_out(), F.lit("xx")).otherwise(F.col("lang")))

    def run(d):
        return m.predict(d.select("doc_id", "text"), *m.train(d.filter(~m.held_out()))).orderBy("doc_id").collect()

    assert run(docs) == run(wrong)


def test_rejects_and_nulls(spark, docs, no_docs):
    train = docs.withColumn("lang", F.lit("en"))
    kept = m.drop_unknown(train)
    assert kept.columns == train.columns
    expected = [r.text for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]
    assert sorted(r.text for r in kept.collect()) == sorted(expected)
    labels, logp = m.train(no_docs.withColumn("lang", F.lit("en")))
    assert labels == [] and set(r.lang_pred for r in m.predict(docs.select("text"), labels, logp).collect()) == {"und"}


def test_texts_in_no_learned_language_are_dropped(spark):
    """Foreign and noise texts go, short or long; clean ones of the learned languages stay, however short."""
    import base64
    import random
    rng = random.Random(6)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    foreign = ["Tietokone on laite, joka suorittaa laskutoimituksia ja käsittelee tietoja ohjelman mukaan.",
               "Komputer to maszyna elektroniczna przeznaczona do przetwarzania informacji, które da się zapisać.",
               "Компьютер это устройство способное выполнять заданную последовательность операций"]
    noise = [base64.b64encode(rng.randbytes(300)).decode(), "".join(rng.choice("asdfghjklqwertyuiop ") for _ in range(300)),
             "asdfkjh qwlekrj xcvmn zpoiu"]
    bad = [t * n for t in foreign + noise for n in (1, 200)]
    clean = ["the", "of the and", "und der die", "le la des", "los de la", "Is and the of, the."]
    rows = [(10**6 + i, t, None) for i, t in enumerate(bad)] + [(2 * 10**6 + i, t, None) for i, t in enumerate(clean)]
    kept = m.drop_unknown(docs.unionByName(spark.createDataFrame(rows, docs.schema)))
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not [t[:40] for i, t, _ in rows[:len(bad)] if i in left]
    assert not [t for i, t, _ in rows[len(bad):] if i not in left]
    given = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert given <= left


def test_long_texts_have_the_ngrams_of_the_whole():
    """A text in pieces counts as it does whole, whatever stands at the cuts."""
    rng = np.random.default_rng(3)
    letters = "abcdé ß.,\n1語"
    for most in (1, 2, 3, 7, 50):
        text = "".join(rng.choice(list(letters), 400))
        whole = m.ngram_bins(m.codes([text])[0], m.BINS)
        parts = list(m.cuts(text, most))
        assert "".join(parts) == text and (most > 1 or len(parts) > 50)
        cut = m.ngram_bins(m.codes(parts)[0], m.BINS)
        for x, y in zip(whole, cut):
            assert np.bincount(x[x > 0], minlength=m.BINS).tolist() == np.bincount(y[y > 0], minlength=m.BINS).tolist()
    run = "a" * 1000
    assert list(m.cuts(run, 10)) == [run] and list(m.cuts("", 10)) == []
