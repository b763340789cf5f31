from gneiss.llm import langid


def corpus(spark, rng):
    words = {"en": "the and with from this that".split(), "de": "und nicht auch eine über schon".split(), "fr": "pour avec dans une être élève".split()}
    rows = [(i, " ".join(rng.choice(words[la]) for _ in range(rng.randint(5, 40))), la) for i, la in enumerate([*"en de fr".split()] * 60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_rejection(spark, rng):
    docs = corpus(spark, rng)
    model = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    other = spark.createDataFrame([(900, "Съешь ещё этих мягких булок"), (901, "12 34"), (902, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(docs.select("doc_id", "text").unionByName(other), model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(got[i]["lang_pred"] == la for i, la in truth.items())
    assert not any(got[i]["rejected"] for i in truth)
    assert got[900]["rejected"] and got[901]["lang_pred"] == got[902]["lang_pred"] == "und" and got[901]["score"] == 0


def test_odd_rows(spark, odd, none):
    model = langid.fit(odd)
    out = langid.predict(odd, model).collect()
    assert len(out) == odd.count()
    assert {r["lang_pred"] for r in out if r["doc_id"] in (3, 4, 5, 7)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in out)
    assert langid.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(none)).collect()} == {"und"}
    kept = langid.keep_recognised(odd)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    assert langid.keep_recognised(none).count() == 0


def test_long_random_letters_are_rejected_and_clean_documents_kept(spark, rng):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    junk = [" ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 9))) for _ in range(n)) for a in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя") for n in (10, 200, 1000, 5000)]
    assert all(r for _, _, r in model.predict(junk))
    assert not any(r for _, _, r in model.predict([r["text"] for r in docs.collect() if r["text"]]))


def test_documents_against_plain_python(spark):
    """Held-out accuracy, and every label, score and rejection computed character by character."""
    import plain

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    rows = docs.withColumn("out", langid.held_out(docs["doc_id"])).collect()
    held = [r for r in rows if r["out"] and r["text"] and r["lang"]]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    assert not any(got[r["doc_id"]]["rejected"] for r in held)
    for r in rows[:150]:
        label, score, rejected = plain.predict(model, r["text"])
        g = got[r["doc_id"]]
        assert (g["lang_pred"], g["rejected"]) == (label, rejected) and abs(g["score"] - score) < 2e-5


def test_too_many_labels_are_an_error(spark):
    import pytest

    docs = spark.createDataFrame([(i, "ein text", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.fit(docs, max_labels=4)
    assert len(langid.fit(docs, max_labels=5).labels) == 5
