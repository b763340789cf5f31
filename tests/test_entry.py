import __spark_entry__ as entry


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 60


def test_ship_without_python_path(spark, monkeypatch):
    import gneiss

    monkeypatch.setenv("PYTHONPATH", "")
    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, p: sent.append(p))
    gneiss.ship(spark)
    assert len(sent) == 1 and sent[0].endswith("gneiss.zip")
    spark.sparkContext._gneiss_shipped = False
