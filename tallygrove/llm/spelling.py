"""Spelling variants: words one edit apart, found by an index of grams of variable length.

A gram is as short as its frequency allows: at each place of a word (with a mark before it and marks after it) it is the
shortest piece of ``SHORTEST`` to ``LONGEST`` characters that at most ``FREQUENT`` words' places begin with, or the longest.
The dictionary of frequent pieces is what decides; whether a gram ends depends on its own characters alone.  So one edit
touches only the grams that cover its place, and a word's *bound* is the largest number of its grams over one place.

Two words one edit apart agree in all grams outside, in order, at the same place or one apart.  Of each word's grams, rarest
first, at least one of the first bound + 1 is therefore among the other's first bound + 1: the first gram of the agreement
has, on either side, only grams before it that the edit touched.  Those lists alone are merged, by gram, place and length,
and what meets is verified by edit distance.  A word of ``LONGEST`` + 1 or more characters has more grams than its bound.

Defined results: a null text has no runs; a null doc_id reads as '' in the rule that deletes a code point; equal rows count
as often as they occur; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

RUN = "[A-Za-zÀ-ÿ]+"
#: Code points and occurrences that a word has at least.
LEAST, OFTEN = 5, 3
#: Lengths of grams, and the number of places up to which a piece is rare enough to be one.
SHORTEST, LONGEST, FREQUENT = 2, 4, 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Marks before and after a word, which no run holds.
FRONT, BACK = "^", "$"


def lowered(run: Column) -> Column:
    """A-Z alone in lower case."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, UPPER.lower()))


def misspelt(doc_id: Column, word: Column) -> Column:
    """The word, or with one code point deleted where 97 divides the checksum of ``<doc_id>:<word>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % 97 == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """(word, n): words of at least ``least`` code points that occur at least ``often`` times in all documents."""
    runs = docs.select(docs[doc_id].alias("doc_id"), F.explode(F.regexp_extract_all(docs[text].cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    each = runs.select(misspelt(F.col("doc_id"), lowered(F.col("run"))).alias("word"))
    return each.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def _grams(words: DataFrame, frequent: int) -> DataFrame:
    """(word, size, pos, gram): every word's gram at each place, by the dictionary of frequent pieces."""
    padded = F.concat(F.lit(FRONT), F.col("word"), F.lit(BACK * (LONGEST - 1)))
    places = words.select("word", F.length("word").alias("size"), padded.alias("p")).select("word", "size", "p", F.explode(F.sequence(F.lit(0), F.col("size"))).alias("pos"))
    cut = lambda q: F.substring(F.col("p"), F.col("pos") + 1, F.lit(q)).alias(f"g{q}")
    places = stored(places.select("word", "size", "pos", *[cut(q) for q in range(SHORTEST, LONGEST + 1)]), "spelling")
    gram = F.col(f"g{LONGEST}")
    for q in range(LONGEST - 1, SHORTEST - 1, -1):
        # Dictionary of the pieces that are too frequent to stop at.
        common = places.groupBy(f"g{q}").count().where(F.col("count") > frequent).select(f"g{q}", F.lit(True).alias(f"more{q}"))
        places = places.join(common, f"g{q}", "left")
        gram = F.when(F.col(f"more{q}").isNull(), F.col(f"g{q}")).otherwise(gram)
    return places.select("word", "size", "pos", gram.alias("gram"))


def bound(spans: Column) -> Column:
    """The largest number of ``spans`` (array<struct<pos, length>> in order of pos, one a place) that cover one place."""
    over = lambda i: F.size(F.filter(F.slice(spans, F.greatest(i - LONGEST + 2, F.lit(1)), F.least(i + 1, F.lit(LONGEST))), lambda s: s["pos"] + s["length"] > i))
    return F.array_max(F.transform(F.sequence(F.lit(0), F.size(spans) - 1), over))


def near(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(a, b): pairs of ``words`` (word; distinct, of at least LONGEST + 1 code points) one edit apart, each once."""
    grams = stored(_grams(words, frequent), "spelling")
    seen = grams.groupBy("gram").agg(F.count("*").alias("seen"))
    row = F.struct("seen", "gram", "pos", F.length("gram").alias("length"))
    lists = grams.join(seen, "gram").groupBy("word", "size").agg(F.sort_array(F.collect_list(row)).alias("g"))
    spans = F.sort_array(F.transform("g", lambda x: F.struct(x["pos"].alias("pos"), x["length"].alias("length"))))
    lists = lists.withColumn("spans", spans).withColumn("g", F.slice("g", F.lit(1), bound(F.col("spans")) + 1))
    lists = stored(lists.select("word", "size", F.explode("g").alias("g")).select("word", "size", "g.gram", "g.pos"), "spelling")
    # A word of the same length has the gram at the same place, a longer one there or one later.
    meets = F.array(*[F.struct((F.col("size") + d).alias("size"), (F.col("pos") + e).alias("pos")) for d, e in ((0, 0), (1, 0), (1, 1))])
    probe = lists.select(F.col("word").alias("a"), "gram", F.col("size").alias("a_size"), F.explode(meets).alias("m")).select("a", "a_size", "gram", "m.size", "m.pos")
    met = probe.join(lists.withColumnRenamed("word", "b"), ["gram", "size", "pos"])
    met = met.where((F.col("a_size") < F.col("size")) | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of all ``words`` (word, n): how many near words, and the form, if a word has one."""
    own = lambda side: words.select(F.col("word").alias(side), F.col("n").alias(f"{side}_n"))
    known = pairs.join(own("a"), "a").join(own("b"), "b")
    both = known.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")).unionByName(known.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    taken = -F.col("best.m") >= 2 * F.col("n")
    out = words.join(best, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n"))


def rooted(rows: DataFrame) -> DataFrame:
    """``rows`` (word, form and others) with ``root``: the end of the word's chain of forms, itself without one.

    Every round follows each word's chain twice as far; as a form occurs at least twice as often, chains are short.
    """
    ends = stored(rows.where("form IS NOT NULL").select(F.col("word").alias("w"), F.col("form").alias("root")), "spelling")
    while True:
        ahead = ends.select(F.col("w").alias("root"), F.col("root").alias("further"))
        step = stored(ends.join(ahead, "root", "left").select("w", F.coalesce("further", "root").alias("root"), F.isnotnull("further").alias("moved")), "spelling")
        if not step.where("moved").take(1):
            break
        ends = step.drop("moved")
    return rows.join(ends, rows["word"] == ends["w"], "left").withColumn("root", F.coalesce("root", "word")).drop("w")


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, often: int = OFTEN, frequent: int = FREQUENT) -> DataFrame:
    """(word, n, n_near, form, form_n, root): every word of the documents with its spelling group's root."""
    if least <= LONGEST:
        raise ValueError(f"words need more than {LONGEST} code points")
    found = stored(words(docs, text, doc_id, least, often), "spelling")
    return rooted(stored(forms(found, stored(near(found, frequent), "spelling")), "spelling"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op13_spelling": op13_spelling}
ORACLES = {
    "op13_spelling": r"""
WITH RECURSIVE crc(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM crc WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
keyed AS (SELECT doc_id, w, k, concat(cast(doc_id AS VARCHAR), ':', w) AS s FROM runs),
bytes AS (SELECT w, k, s, list_transform(range(octet_length(encode(s))), lambda i: cast(('0x' || hex(encode(s))[2 * i + 1:2 * i + 2]) AS BIGINT)) AS b FROM keyed),
hashed AS (SELECT w, k, xor(4294967295, list_reduce(list_prepend(cast(4294967295 AS BIGINT), b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS h FROM bytes, t),
words AS (SELECT word, cast(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
longer AS (SELECT DISTINCT c.word AS l, c.n AS ln, w.word AS s, w.n AS sn FROM cuts c JOIN words w ON c.v = w.word),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.v = b.v AND a.i = b.i AND a.word <> b.word UNION SELECT l, s, sn FROM longer UNION SELECT s, l, ln FROM longer),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM pairs GROUP BY word),
form AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
chain(word, stop, nxt) AS (SELECT word, word, form FROM form UNION ALL SELECT c.word, c.nxt, f.form FROM chain c JOIN form f ON f.word = c.nxt)
SELECT f.word, f.form, c.stop AS root, f.n, f.n_near, f.form_n FROM form f JOIN chain c ON c.word = f.word WHERE c.nxt IS NULL"""
}
