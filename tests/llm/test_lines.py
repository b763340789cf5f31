from gneiss.llm import lines
from gneiss.llm import lines as lines_op
from textgen import prose


def test_recurring_lines_and_variable_fields_go(spark, rng):
    rows = []
    for i in range(12):
        body = [prose(rng, 12) for _ in range(4)]
        rows.append((i, "\n".join(["Home About Contact Us", body[0], f"Posted on 2024-01-{i:02d} by user{i}", "", body[1], f"Read more about our {prose(rng, 1)[:4]}{chr(97 + i)} recipes from the north side", body[2], body[3]])))
    rows += [(100, "A line of its own\nHome About Contact Us"), (101, None), (102, "")]
    got = {r["doc_id"]: r for r in lines.drop_templates(spark.createDataFrame(rows, "doc_id long, text string"), counts_as="n").collect()}
    for i in range(12):
        kept = got[i]["text"].split("\n")
        assert "Home About Contact Us" not in kept and not any(x.startswith(("Posted on", "Read more")) for x in kept)
        assert [x for x in rows[i][1].split("\n") if x in kept] == kept and len(kept) == 5
        assert got[i]["n"]["n_lines"] == 8 and got[i]["n"]["n_dropped"] == 3
    assert got[100]["text"] == "A line of its own" and got[101]["text"] is None and got[102]["text"] == ""


def test_copies_count_once(spark):
    text = "first line of a page\nsecond line of a page"
    df = spark.createDataFrame([(i, text) for i in range(50)], "doc_id long, text string")
    assert {r["text"] for r in lines.drop_templates(df).collect()} == {text}


def test_odd_rows(spark, odd, none):
    out = lines.drop_templates(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert lines.drop_templates(none).count() == 0


def test_against_plain_python(spark):
    import plain

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    got = {r["doc_id"]: r["text"] for r in lines.drop_templates(docs).collect()}
    want = plain.drop_templates([r["text"] for r in rows])
    assert [got[r["doc_id"]] for r in rows] == want and want != [r["text"] for r in rows]


def test_very_long_texts_ties_and_clashing_columns(spark, rng):
    names = ["key", "of", "gone", "line", "form", "leaf", "pos", "at", "n"]
    long = "\n".join(f"{prose(rng, 6)} unique {i}" for i in range(20_000))
    rows = [(i, f"Subscribe to our letter\n{long if i == 0 else prose(rng, 9)}\nSubscribe to our letter", *range(len(names))) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = {r["doc_id"]: r for r in lines.drop_templates(df).collect()}
    assert all("Subscribe" not in got[i]["text"] and tuple(got[i])[2:] == tuple(range(len(names))) for i in range(5))
    assert got[0]["text"].count("\n") == 19_999


def test_many_recurring_lines_in_one_text_are_linear(spark):
    """Texts of 100,000 lines that all recur, and one line that does not, end soon and keep that line."""
    import time

    lines = [f"recurring line {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)} of many" for i in range(100_000)]
    rows = [(k, "\n".join([*lines[:50_000], f"only here {'x' * (k + 1)} once", *lines[50_000:]])) for k in range(6)]
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in lines_op.drop_templates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == {k: f"only here {'x' * (k + 1)} once" for k in range(6)} and time.time() - began < 120
