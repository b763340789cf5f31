from gneiss.llm import licences


def test_headers_files_and_inheritance(spark):
    rows = [
        (1, "p/LICENSE", "Released under the MIT License."), (2, "p/a/x.py", "some code"), (3, "p/a/b/y.py", "# Licensed under the Apache License, Version 2.0.\nmore code follows here"),
        (4, "p/a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (5, "p/a/b/z.py", "code"), (6, "q/a.py", "no word of it"), (7, "top.py", None), (8, None, "x"), (9, "q/b.py", "I have a driving licence and many friends"), (2, "p/a/x.py", "some code"),
    ]
    df = spark.createDataFrame(rows, "rid long, path string, text string")
    got = {r["rid"]: (r["licence"], r["how"], r["from_path"]) for r in licences.scan(df).collect()}
    assert got == {
        1: ("MIT", "file", None), 2: ("MIT", "inherited", "p/LICENSE"), 3: ("Apache-2.0", "header", None), 4: ("GPL-3.0", "file", None), 5: ("GPL-3.0", "inherited", "p/a/b/LICENSE"),
        6: (None, "none", None), 7: (None, "none", None), 8: (None, "none", None), 9: (None, "none", None),
    }


def test_empty(spark):
    assert licences.scan(spark.createDataFrame([], "rid long, path string, text string")).count() == 0


def test_templates_find_themselves(spark):
    rows = [(i, f"d{i}/f", t) for i, (_, t) in enumerate(licences.TEMPLATES)]
    got = {r["rid"]: (r["licence"], r["score"]) for r in licences.scan(spark.createDataFrame(rows, "rid long, path string, text string")).collect()}
    named = [i for i, (_, t) in enumerate(licences.TEMPLATES) if __import__("re").search(licences.NAMES_A_LICENCE, t)]
    assert named and all(got[i] == (licences.TEMPLATES[i][0], 1.0) for i in named)


def test_full_texts_are_licence_files(spark):
    full = dict(licences.full_texts())
    rows = []
    for i, (name, text) in enumerate(sorted(full.items())):
        text = "Copyright (c) 2021 Some Person\nAll rights reserved.\n\n" + text
        rows += [(2 * i, f"{name}/LICENSE", text), (2 * i + 1, f"{name}/src/x.py", "some code")]
    got = {r["path"]: (r["licence"], r["how"], r["from_path"]) for r in licences.scan(spark.createDataFrame(rows, "rid long, path string, text string")).collect()}
    assert {"MIT", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "AGPL-3.0", "ISC", "MPL-2.0"} <= set(full)
    for name in full:
        assert got[f"{name}/LICENSE"] == (name, "file", None) and got[f"{name}/src/x.py"] == (name, "inherited", f"{name}/LICENSE")


def test_headers_with_full_notices(spark):
    comment = lambda text: "".join(f"# {line}\n" for line in text.split("\n")) + "\n\n" + "def f(x): return x\n" * 300
    full = dict(licences.full_texts())
    want = {n: comment(full[n]) for n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause")}
    for name, title, version in licences.GNU_KINDS:
        text = licences.GNU.format(title, version) + " " + licences.NO_WARRANTY.format(title)
        want[name] = comment("Copyright (C) 2021 Some Person\n" + text.replace(" the ", " the\n"))
    rows = [(i, f"{name}/x.py", text) for i, (name, text) in enumerate(want.items())]
    got = {r["path"]: (r["licence"], r["how"]) for r in licences.scan(spark.createDataFrame(rows, "rid long, path string, text string")).collect()}
    assert got == {f"{name}/x.py": (name, "header") for name in want}


def test_every_template_is_found_as_line_paragraph_and_file(spark):
    forms = {"file": lambda t: t, "line": lambda t: "x = 1\n" * 200 + t + "\n" + "y = 2\n" * 200, "paragraph": lambda t: "x = 1\n" * 200 + "\n" + t.replace(" ", "\n") + "\n\n" + "y = 2\n" * 200}
    rows = [(name, form(t)) for name, t in licences.TEMPLATES for form in forms.values()]
    files = spark.createDataFrame([(i, f"d{i}/f", t) for i, (_, t) in enumerate(rows)], "rid long, path string, text string")
    got = {r["rid"]: (r["licence"], r["score"]) for r in licences.scan(files).collect()}
    assert all(got[i] == (name, 1.0) for i, (name, _) in enumerate(rows))


def test_the_bound_excludes_no_unit_at_the_threshold():
    for templates in (licences.Templates(licences.TEMPLATES, licences.HEADER), licences.Templates(licences.full_texts(), licences.FULL)):
        vocabulary = list(templates.at)
        for t in range(len(templates.names)):
            weight = templates.weight[:, t]
            own = sorted((v for v in vocabulary if weight[templates.at[v]]), key=lambda v: weight[templates.at[v]])
            for n in range(1, len(own) + 1):
                if templates.best(licences.Counter(own[:n])):
                    assert templates.possible(set(own[:n]))


def test_whole_corpus_against_plain_python(spark):
    import plain

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    files = docs.selectExpr("doc_id as rid", "concat_ws('/', source, lang, cast(doc_id as string)) as path", "text")
    extra = spark.createDataFrame([(10**6, "src0/LICENSE", dict(licences.full_texts())["MIT"]), (10**6 + 1, "src1/en/LICENSE", dict(licences.full_texts())["ISC"])], files.schema)
    files = files.unionByName(extra)
    got = {r["rid"]: (r["licence"], r["how"], r["from_path"]) for r in licences.scan(files).collect()}
    want = plain.scan([tuple(r) for r in files.collect()])
    assert {k: v for k, v in got.items() if v != want[k]} == {} and {h for _, h, _ in got.values()} == {"file", "header", "inherited", "none"}


def test_ties_very_long_texts_and_clashing_columns(spark):
    mit = dict(licences.full_texts())["MIT"]
    long = "some code\n" * 100_000 + "Released under the MIT License.\n" + "more code\n" * 100_000
    rows = [(1, "a/LICENSE", mit), (2, "a/COPYING", mit), (3, "a/x.py", "code"), (4, "b/y.py", long), (5, "b/z.py", "")]
    names = ["licence", "score", "dir", "i", "file", "how"]
    df = spark.createDataFrame([(*r, *["k"] * len(names)) for r in rows], "rid long, path string, text string, " + ", ".join(f"{n} string" for n in names))
    got = {r["rid"]: (r["licence"], r["how"], r["from_path"]) for r in licences.scan(df).collect()}
    assert got == {1: ("MIT", "file", None), 2: ("MIT", "file", None), 3: ("MIT", "inherited", "a/COPYING"), 4: ("MIT", "header", None), 5: (None, "none", None)}
