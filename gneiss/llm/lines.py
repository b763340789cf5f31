"""Line dedup by a log-template tree, with DataFrame functions only.

A line's variable tokens (with a digit, an at sign or a double quote) become ``<*>``.  The tree has fixed depth: token
count, then the first LEAD tokens; a line of fewer than MIN_TOKENS tokens is its own template.  In a leaf with at least
MIN_TEXTS different lines, a token that fewer than MIN_TEXTS of them have at its place is a variable field, too, and becomes ``<*>``; a line keeps
its own form if less than KEPT of its tokens would stay.  Lines whose template is found in at least MIN_TEXTS different
texts are dropped from every document.

Equal texts count once: a page that was merely copied is not a template, whatever the number of its copies.  Counts are
made over all lines of all documents, combined before each shuffle; no group is collected, except the tokens of one line
and the dropped positions of one text.

Defined cases: null text stays null and has no lines; blank lines are never dropped; a text whose lines all go becomes
empty, its row stays; repeated rows are treated alike; lines end at line feeds (a carriage return before it is blank);
other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch, fresh

LEAD = 3
MIN_TOKENS = 5
MIN_TEXTS = 5
KEPT = 0.8
VARIABLE = r'(?<!\S)(?=\S*[\d@"])\S+'


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def exploded(docs: DataFrame) -> DataFrame:
    """key, pos, line of every line that is not blank."""
    keyed = docs.where("text is not null").select(text_key().alias("key"), "text")  # below the generator: once a text
    return keyed.select("key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.col("line").rlike(r"\S"))


def normalised(lines: DataFrame) -> DataFrame:
    """lines with `form` in place of line: variable tokens masked, single blanks.  Most lines need no rewriting, so tests come first."""
    out = lines.withColumn("form", F.when(F.col("line").rlike('[0-9@"]'), F.regexp_replace("line", VARIABLE, "<*>")).otherwise(F.col("line"))).drop("line")
    out = out.withColumn("form", F.when(F.col("form").rlike(r"  |[\t\f\r\x0B]"), F.regexp_replace("form", r"\s+", " ")).otherwise(F.col("form")))
    return out.withColumn("form", F.trim("form"))  # no filter on the form: it would be pushed down and computed twice


def parsed(docs: DataFrame) -> DataFrame:
    """key, pos, line (hash of the form), leaf (null where lines are not generalised)."""
    lines = normalised(exploded(docs))
    n = F.length("form") - F.length(F.replace(F.col("form"), F.lit(" "), F.lit(""))) + 1
    leaf = F.when(n >= MIN_TOKENS, F.xxhash64(n, F.substring_index("form", " ", LEAD)))
    return lines.select("key", "pos", leaf.alias("leaf"), F.unhex(F.md5(F.col("form").cast("binary"))).alias("line"))


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df, marked for broadcast if it is a written table of few rows; else it is joined by shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def templates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(line, template) hashes of generalised lines."""
    counts = scratch.spark.read.parquet(scratch.path("counts"))
    busy = counts.where("leaf is not null").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_TEXTS)
    busy = scratch.save(busy.select("leaf"), "busy", 1)
    # one place of each line of a busy leaf: only those lines are cut into tokens
    lines = scratch.spark.read.parquet(scratch.path("lines"))
    place = F.min(F.struct("key", "pos")).alias("at")
    places = lines.where("leaf is not null").join(small(busy), "leaf", "left_semi").groupBy("leaf", "line").agg(place)
    places = scratch.save(places.select("leaf", F.col("line").alias("hash"), "at.key", "at.pos"), "places", 1)
    shapes = exploded(docs).join(small(places), ["key", "pos"]).select("leaf", "hash", "line")
    shapes = normalised(shapes).select("leaf", F.col("hash").alias("line"), F.split("form", " ", -1).alias("tokens")).dropDuplicates(["line"])
    shapes = scratch.save(shapes, "shapes", 1)
    placed = shapes.select("leaf", "line", F.posexplode("tokens").alias("at", "token"))
    common = scratch.save(placed.groupBy("leaf", "at", "token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_TEXTS), "common", 1)
    marked = placed.join(common, ["leaf", "at", "token"], "left")
    field = F.struct("at", F.when(F.col("n").isNull(), "<*>").otherwise(F.col("token")).alias("token"))
    lines = marked.groupBy("line").agg(F.sort_array(F.collect_list(field)).alias("f"), F.count("n").alias("kept"), F.count(F.lit(1)).alias("all"))
    lines = lines.where((F.col("kept") < F.col("all")) & (F.col("kept") >= F.col("all") * KEPT))
    return scratch.save(lines.select("line", F.unhex(F.md5(F.array_join("f.token", " ").cast("binary"))).alias("template")), "templates", 1)


def dropped_positions(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, gone, n_gone): which lines go from each text, as a mark 0 or 1 for each line up to the last that goes."""
    lines = scratch.save(parsed(docs), "lines")
    counts = scratch.save(lines.groupBy("leaf", "line").agg(F.countDistinct("key").alias("n")), "counts")
    general = templates(docs, scratch)
    frequent = counts.where(F.col("n") >= MIN_TEXTS).select("line")
    texts = lines.join(general, "line").groupBy("template").agg(F.countDistinct("key").alias("n")).where(F.col("n") >= MIN_TEXTS)
    # a line that occurs as often by itself has its own form as template, too
    texts = scratch.save(texts.select("template"), "recurring", 1)
    bad = scratch.save(frequent.union(general.join(texts, "template", "left_semi").select("line")).distinct(), "bad", 1)
    gone = lines.join(bad, "line", "left_semi").groupBy("key").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    gone = scratch.save(gone, "gone_at", 1)
    # a step per line that goes, so a text of any number of lines costs in proportion to it
    before = F.concat(F.array(F.lit(-1)), F.slice("at", F.lit(1), F.size("at") - 1))
    marks = F.zip_with("at", before, lambda g, p: F.concat(F.repeat(F.lit("0"), g - p - 1), F.lit("1")))
    gone = scratch.save(gone.select("key", F.array_join(marks, "").alias("gone"), F.size("at").alias("n_gone")), "gone", 1)
    for name in ("lines", "counts", "busy", "places", "shapes", "common", "templates", "gone_at"):
        scratch.remove(name)
    return gone


def drop_templates(docs: DataFrame, counts_as: str | None = None) -> DataFrame:
    """docs with recurring lines taken out of text; with counts_as also a struct of that name: n_lines, n_dropped."""
    scratch = Scratch(docs.sparkSession, "lines")
    key, of, gone, n_gone = fresh(docs, "key", "of", "gone", "n_gone")
    places = dropped_positions(docs.select("text"), scratch).toDF(of, gone, n_gone)
    joined = docs.withColumn(key, text_key()).join(places, F.col(key) == F.col(of), "left")
    lines = F.split("text", "\n", -1)
    left = F.array_join(F.zip_with(lines, F.split(gone, ""), lambda x, mark: F.when(mark.eqNullSafe("1"), F.lit(None)).otherwise(x)), "\n")  # nulls are left out
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    some = F.col(gone).isNotNull() & F.col("text").isNotNull()
    info = F.struct(n.cast("long").alias("n_lines"), F.when(some, F.col(n_gone)).otherwise(0).cast("long").alias("n_dropped"))
    columns = [F.when(some, left).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, *([info.alias(counts_as)] if counts_as else []))


def op10_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_templates(docs, counts_as="lines").select("doc_id", "lines.n_lines", "lines.n_dropped", "text")


ORACLE = r"""
WITH u AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL), s AS (SELECT text, string_split(text, chr(10)) AS x FROM u),
l AS (SELECT text, unnest(x) AS line, unnest(generate_series(0, len(x) - 1)) AS pos FROM s),
k AS (SELECT text, pos, list_transform(list_filter(string_split_regex(line, '[ \t\n\x0B\f\r]+'), lambda t: t <> ''), lambda t: CASE WHEN regexp_matches(t, '[0-9@"]') THEN '<*>' ELSE t END) AS tokens FROM l),
f AS (SELECT text, pos, array_to_string(tokens, ' ') AS form, len(tokens) AS n, tokens FROM k WHERE len(tokens) > 0),
c AS (SELECT form, n, any_value(tokens) AS tokens, count(DISTINCT text) AS texts, n || ' ' || array_to_string(any_value(tokens)[1:LEAD], ' ') AS leaf FROM f GROUP BY form, n),
b AS (SELECT leaf FROM c WHERE n >= MIN_TOKENS GROUP BY leaf HAVING count(*) >= MIN_TEXTS),
p AS (SELECT leaf, form, n, unnest(tokens) AS token, unnest(generate_series(1, n)) AS place FROM c WHERE n >= MIN_TOKENS AND leaf IN (SELECT leaf FROM b)),
m AS (SELECT leaf, place, token FROM p GROUP BY ALL HAVING count(*) >= MIN_TEXTS),
g AS (SELECT form, n, array_to_string(list(CASE WHEN m.token IS NULL THEN '<*>' ELSE p.token END ORDER BY p.place), ' ') AS template, count(m.token) AS kept FROM p LEFT JOIN m USING (leaf, place, token) GROUP BY form, n),
t AS (SELECT form, template FROM g WHERE kept < n AND kept >= n * KEPT), r AS (SELECT template FROM t JOIN f USING (form) GROUP BY template HAVING count(DISTINCT text) >= MIN_TEXTS),
bad AS (SELECT form FROM c WHERE texts >= MIN_TEXTS UNION SELECT form FROM t WHERE template IN (SELECT template FROM r)),
gone AS (SELECT text, list(pos) AS gone FROM f WHERE form IN (SELECT form FROM bad) GROUP BY text)
SELECT d.doc_id, coalesce(len(s.x), 0)::BIGINT AS n_lines, coalesce(len(gone.gone), 0)::BIGINT AS n_dropped,
CASE WHEN gone.gone IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(generate_series(0, len(s.x) - 1), lambda i: NOT list_contains(gone.gone, i)), lambda i: s.x[i + 1]), chr(10)) END AS text
FROM documents d LEFT JOIN s ON s.text = d.text LEFT JOIN gone ON gone.text = d.text
"""
for _name in ("MIN_TOKENS", "MIN_TEXTS", "LEAD", "KEPT"):
    ORACLE = ORACLE.replace(_name, str(globals()[_name]))
