from collections import Counter

import plain
from oracle import connect
from pyspark.sql import functions as F
from test_jaccard import brute
from test_packing import check

import corpus_pipeline
from gneiss.llm import langid, mixing, packing

SF = "/root/testdata/sf0.001"


def key(row):
    return tuple(map(repr, row))


def test_each_stage_against_a_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = [(9001, "1234 5678", None, "src0", 9), (9002, None, None, None, 0)]
    docs = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    columns, tables = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(str(tmp_path / f"{name}.parquet"))
        docs = spark.read.parquet(str(tmp_path / f"{name}.parquet"))
        rows, out = docs.collect(), stage(spark, docs, SF).cache()
        tables[name] = out
        if name != "packing":
            assert out.columns == columns, name
        got = Counter(map(key, out.collect()))
        at = columns.index("text")
        if name == "language_id":
            model = langid.fit(docs)
            want = Counter(key(r) for r in rows if not plain.predict(model, r["text"])[2])
            assert len(rows) - sum(want.values()) == 2
        elif name == "line_dedup":
            texts = plain.drop_templates([r["text"] for r in rows])
            want = Counter(key((*r[:at], t, *r[at + 1 :])) for r, t in zip(rows, texts, strict=True))
            assert want != Counter(map(key, rows))
        elif name == "near_duplicates":
            classes = brute([(r["doc_id"], r["text"]) for r in rows])
            want = Counter(key(r) for r in rows if classes[r["doc_id"]][0] == r["doc_id"])
            assert sum(want.values()) < len(rows)
        elif name == "mixing":
            con = connect(SF)
            con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/mixing.parquet/*.parquet'")
            copies = dict(con.sql(f"SELECT doc_id, copies FROM ({mixing.ORACLE})").fetchall())
            want = Counter({k: n for r in rows if (n := copies[r["doc_id"]]) for k in [key(r)]})
        else:
            _, ids, seen = check([(r["doc_id"], r["text"]) for r in rows], out.collect(), packing.CAPACITY)
            times = Counter(r["doc_id"] for r in rows)
            assert all(seen[i] == len(ids[i]) * times[i] for i in ids)
            continue
        assert got == want, name
        docs = out
    first = lambda df: Counter(map(tuple, df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))
    with_junk = first(tables["packing"])
    run = first(corpus_pipeline.run(spark, SF))
    assert run == with_junk  # the two rows go in the first stage


def test_stages_keep_clashing_columns(spark):
    names = ["size", "key", "level", "stratum", "place", "of", "gone", "own", "mix", "copy", "cell", "class_id", "n_links", "lang_pred", "part", "h", "line", "pos"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(i))
    docs = docs.checkpoint()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.select(*names).collect()} <= {tuple(range(len(names)))}, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 40


def test_oracles(spark):
    from oracle import differences

    from gneiss.llm import registry

    for name, sql in registry.ORACLES.items():
        n, wrong = differences(connect(SF), sql, registry.QUERIES[name](spark, SF))
        assert n and not wrong, name
