"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so words of the same letters have the same key, whatever their order.
Two words that differ by one letter have keys that differ by that letter's value (added or removed) or by the difference of two
values (exchanged).  Every word therefore goes to its own key and to its key less the value of each of its letters: a word meets
the words it is one removal from at its own key, and those with one letter exchanged at a key that both reach by taking one away.

Letter order is verified where they meet: next to the key stands what is left of the word in its order, and only equal rests are
compared; words with an exchanged letter must also have lost it at the same place.  At one key and rest there can be no more words
than places times letters of the alphabet, so a group is bounded however large an anagram class is, and no pairs of a class are made.

A word's form is the near word that is most frequent, if it is RATIO times as frequent or more; its root is where the forms lead.
Frequencies grow by RATIO a step, so a chain is short; it is followed by doubling.

Defined cases: null and empty texts and texts without letters give no words; repeated rows count as often as they stand; ties go to
the smaller word in code-point order; an empty table gives an empty result; a null doc_id stands as nothing before the colon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch

PRIME = (1 << 31) - 1
RATIO = 10
LEAST_LENGTH = 7
LEAST_COUNT = 2
RUN = "[A-Za-zÀ-ÿ]+"
SLIPS = 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_value(c):
    """Fifth power of a letter's code point, modulo a prime: no sum of them overflows."""
    x = F.ascii(c).cast("long")
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def places(words: DataFrame) -> DataFrame:
    """key, rest, at, word, n from words(word, n): each word at its own key (at 0) and at its key less each of its letters (at that place)."""
    chars = words.select("word", "n", F.split("word", "").alias("c")).withColumn("v", F.transform("c", letter_value))
    keyed = chars.withColumn("key", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x))
    gone = F.transform(
        "v",
        lambda x, i: F.struct(
            (F.col("key") - x).alias("key"),
            F.concat(F.substring("word", F.lit(1), i), F.substring("word", i + 2, F.size("v"))).alias("rest"),
            (i + 1).alias("at"),
        ),
    )
    whole = F.struct(F.col("key"), F.col("word").alias("rest"), F.lit(0).alias("at"))
    return keyed.select("word", "n", F.explode(F.concat(F.array(whole), gone)).alias("p")).select("p.*", "word", "n")


def near(words: DataFrame) -> DataFrame:
    """word, other, other_n: both directions of every pair of words(word, n) that differ by exactly one letter added, removed or exchanged."""
    met = places(words).groupBy("key", "rest").agg(F.collect_list(F.struct("at", "word", "n")).alias("m")).where(F.size("m") > 1)
    together = lambda a, b: (a["word"] != b["word"]) & ((a["at"] == b["at"]) | (a["at"] == 0) | (b["at"] == 0))
    partners = lambda a: F.transform(F.filter("m", lambda b: together(a, b)), lambda b: F.struct(a["word"].alias("word"), b["word"].alias("other"), b["n"].alias("other_n")))
    # a doubled letter can be lost at two places: the pair stands once
    return met.select(F.explode(F.array_distinct(F.flatten(F.transform("m", partners)))).alias("p")).select("p.*")


def follow(scratch: Scratch, links: DataFrame) -> DataFrame:
    """word, to: where links(word, to) lead in the end; the links have no cycle."""
    links, k = scratch.save(links, "links0"), 0
    while True:
        onward = links.join(links.select(F.col("word").alias("to"), F.col("to").alias("next")), "to", "left")
        if onward.where("next is not null").isEmpty():
            return links
        k += 1
        links = scratch.save(onward.select("word", F.coalesce("next", "to").alias("to")), f"links{k}")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n from words(word, n), each word once."""
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.save(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    found = near(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    formed = -F.col("best.less") >= ratio * F.col("n")
    # a near word has at most a few hundred partners, so no key of these joins is hot
    all_words = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"),
    )
    all_words = scratch.save(all_words, "forms")
    ends = follow(scratch, all_words.where("form is not null").select("word", F.col("form").alias("to")))
    return all_words.join(ends, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slips: int = SLIPS) -> DataFrame:
    """word, n: the letter runs of docs(doc_id, text), A-Z lower-cased.  A run whose keyed checksum `slips` divides loses one letter;
    0 leaves all runs as they are."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= least_length)
    # lower() also changes letters beyond Z, so it only tells which runs need nothing
    runs = runs.select("doc_id", F.when(F.col("run") == F.lower("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    word = F.col("run")
    if slips:
        runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))))
        runs = runs.withColumn("at", (F.col("h") % F.length("run")).cast("int"))
        cut = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.length("run")))
        word = F.when(F.col("h") % slips == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))


# the checksum is spelt out: table by 8 shifts of each byte, then a byte at a time; letters beyond Z take two bytes
ORACLE = r"""
WITH RECURSIVE bits AS (SELECT i::BIGINT AS byte, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) GROUP BY ALL HAVING length(run) >= 7),
bytes AS (SELECT doc_id, run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x)::BIGINT >> 6), 128 + (unicode(x)::BIGINT & 63)] END)) AS b FROM runs),
sums AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, tab),
cut AS (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM sums),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) u(i)),
near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM words a JOIN less b ON a.word = b.rest
    UNION SELECT b.word, a.word, a.n FROM words a JOIN less b ON a.word = b.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
    FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON f.word = c.word
WHERE c.at NOT IN (SELECT word FROM forms WHERE form IS NOT NULL)
"""
