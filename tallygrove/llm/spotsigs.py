"""Document fingerprints: chains of content words after common words, compared by Jaccard similarity.

An *anchor* is one of the corpus's common words.  Each anchor in a text, and the start of the text, opens a chain: the
anchor and the next ``CHAIN`` words that are no anchors (fewer at the end of the text).  The chains' hashes, each once, are
the text's signatures; its fingerprint is these in order, eight hexadecimal digits each.  Anchors are words that make up at
least ``SHARE`` of all words of all documents (so at most 1 / SHARE of them), most frequent first, up to half of all
words.  Words are runs of letters, marks and digits in lower case.

Two sets can reach a similarity only if their sizes are that near.  :func:`linked` cuts the sets into classes of size,
indexes each by its rarest signatures only, as many as a similar set must share one of, joins a class with itself and
the next, and compares what meets.  :func:`likeness` compares two given sets, not at all if their sizes rule it out.

Defined results: a null text counts as empty; a text without words has no signatures, the fingerprint '' and likeness 1
to another such and 0 to others; equal texts have equal fingerprints.  The next document is the one of the next smaller
doc_id (null below all; the first after the last; itself if alone).  Rows of one doc_id come in the order of a hash of all
their columns, equal rows one after another.  Other columns are ignored, and an empty table gives an empty one.  Only SQL
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, row_key, stored, table
from .spans import let

#: Words after an anchor; with it, five.
CHAIN = 4
#: Least share of all words that makes a word an anchor.
SHARE = 0.001
#: Characters of a range of neighbouring documents, and the most ranges.
SPAN, SPANS = 8_000_000, 100_000
WORDS = r"[\p{L}\p{M}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORDS), F.lit(0))


def anchors(docs: DataFrame, share: float = SHARE, text: str = "text") -> list[str]:
    """The common words of all documents, at most 1 / ``share`` of them."""
    counts = stored(docs.select(F.explode(words(docs[text])).alias("word")).groupBy("word").count(), "spotsigs")
    total = counts.agg(F.sum("count")).first()[0] or 0
    common = counts.where(F.col("count") >= share * total).orderBy(F.desc("count"), "word").collect()
    out, taken = [], 0
    for w, n in common:
        taken += n
        if 2 * taken > total:
            break
        out.append(w)
    return out


def signatures(text: Column, common: list[str], chain: int = CHAIN) -> Column:
    """array<bigint>: the text's signatures in order, each once."""

    def of(w: Column) -> Column:
        # The k-th anchor, at place p, has p - k words before it that are none.
        content = F.filter(w, lambda x: ~x.isin(common))
        places = F.filter(F.transform(w, lambda x, i: F.when(x.isin(common), i)), lambda i: i.isNotNull())
        after = lambda c, at: F.concat(F.lit(" "), F.array_join(F.slice(c, at + 1, F.lit(chain)), " "))
        chains = lambda c: F.transform(places, lambda p, k: F.concat(F.get(w, p), after(c, p - k)))
        return F.when(F.size(w) < 1, F.array().cast("array<string>")).otherwise(let(content, lambda c: F.concat(F.array(after(c, F.lit(0))), chains(c))))

    hashed = F.transform(let(words(text), of), lambda s: F.conv(F.substring(F.md5(s.cast("binary")), 1, 8), 16, 10).cast("bigint"))
    return F.sort_array(F.array_distinct(hashed))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without a comparison where their sizes rule out ``least``, 1 if both are empty."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when(large < 1, F.lit(1.0)).when((small < 1) | (small < least * large), F.lit(0.0)).otherwise(both)


def _order(doc_id: str, key: str) -> Column:
    """What documents are in order of: descending doc_id, null last, then ``key``."""
    return F.struct(F.isnull(doc_id).alias("none"), F.coalesce(F.bitwise_not(doc_id), F.lit(0)).alias("down"), F.col(key).alias("key"))


def bounds(rows: DataFrame) -> DataFrame:
    """One row, ``b``: the first of each of the ranges that ``rows`` (order, size) are dealt in, of about SPAN characters."""
    rows = stored(rows, "spotsigs")
    n = min(SPANS, max(1, (rows.agg(F.sum("size")).first()[0] or 0) // SPAN))
    heads = rows.repartitionByRange(n, "order").groupBy(F.spark_partition_id()).agg(F.min("order").alias("head"))
    return stored(heads.agg(F.sort_array(F.collect_list("head")).alias("b")), "spotsigs")


def _place(b: Column, order: Column) -> Column:
    """The range that ``order`` lies in: the last whose first is not above it, by halving."""

    def halved(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        right = F.struct(mid.alias("lo"), at["hi"].alias("hi"))
        left = F.struct(at["lo"].alias("lo"), mid.alias("hi"))
        return F.when(at["hi"] - at["lo"] <= 1, at).when(F.get(b, mid) <= order, right).otherwise(left)

    return F.aggregate(F.sequence(F.lit(1), F.lit(SPANS.bit_length())), F.struct(F.lit(0).alias("lo"), F.size(b).alias("hi")), halved)["lo"]


def neighbours(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, text, order, span, guest) of whole ranges: each document in its own, the first of each as a guest behind the one before.

    So every document and the next one are in one range, and texts are moved once.
    """
    plain = F.coalesce(docs[text].cast("string"), F.lit(""))
    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), row_key(docs).alias("key"), plain.alias("text"))
    base = base.select("doc_id", "text", _order("doc_id", "key").alias("order"))
    b = bounds(base.select("order", F.length("text").cast("long").alias("size")))
    base = base.withColumn("b", b.scalar()).withColumn("own", _place(F.col("b"), F.col("order")))
    last = F.when(F.col("own") > 0, F.col("own")).otherwise(F.size("b")) - 1
    at = lambda span, guest: F.struct(span.alias("span"), F.lit(guest).alias("guest"))
    places = F.when(F.get("b", F.col("own")) == F.col("order"), F.array(at(F.col("own"), False), at(last, True))).otherwise(F.array(at(F.col("own"), False)))
    return base.select("doc_id", "text", "order", F.explode(places).alias("p")).select("doc_id", "text", "order", "p.span", "p.guest").repartition("span")


def compared(docs: DataFrame, common: list[str] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its edited text, and likenesses to this and to the next document.

    Columns doc_id, text, edited, sigs, edited_sigs, near_edited, near_next.  The edited text is the text whose last third is
    replaced by as much (or all) of the next document's start.
    """
    common = anchors(docs, text=text) if common is None else common
    rows = neighbours(docs, text, doc_id).withColumn("sigs", signatures(F.col("text"), common))
    ahead = F.lead(F.struct("text", "sigs")).over(Window.partitionBy("span").orderBy("guest", "order"))
    rows = rows.withColumn("next", ahead).where("NOT guest")
    want = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - want), F.substring(F.col("next.text"), F.lit(1), want))
    rows = rows.select("doc_id", "text", "sigs", F.col("next.sigs").alias("next_sigs"), edited.alias("edited")).withColumn("edited_sigs", signatures(F.col("edited"), common))
    near = {"near_edited": likeness(F.col("sigs"), F.col("edited_sigs")), "near_next": likeness(F.col("sigs"), F.col("next_sigs"))}
    return rows.withColumns(near).drop("next_sigs")


def _index(sets: DataFrame, least: float) -> DataFrame:
    """(sig, part, node, n): each set under its rarest signatures and its class of size."""
    each = sets.select("node", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    seen = each.groupBy("sig").count()
    kept = F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1
    rare = each.join(seen, "sig").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("count", "sig"))).alias("s"))
    part = F.col("n") if least >= 1 else F.floor(F.log("n") / F.log(F.lit(1 / least)) + 1e-9).cast("int")
    return rare.select("node", "n", part.alias("part"), F.explode(F.slice("s", F.lit(1), kept.cast("int"))["sig"]).alias("sig"))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of distinct pairs (a, b) whose sets are as similar as ``least``."""
    own = lambda side: sets.select(F.col("node").alias(side), F.col("sigs").alias(f"{side}_sigs"))
    j = pairs.distinct().join(own("a"), "a").join(own("b"), "b")
    return j.where(likeness(F.col("a_sigs"), F.col("b_sigs"), least) >= least).select("a", "b")


def linked(sets: DataFrame, least: float = 0.8) -> DataFrame:
    """(node, root): components of sets (node, sigs; distinct, not empty) linked at a similarity of ``least`` or more.

    What meets at a signature is compared with one set of them first; only what is then in different components is
    compared pair by pair, so that a large group of near copies makes few pairs.
    """
    rows = stored(_index(sets, least), "spotsigs")
    hubs = rows.groupBy("sig", "part").agg(F.min("node").alias("a"))
    probe = rows.withColumn("near", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    meet = probe.join(hubs.withColumnRenamed("part", "near"), ["sig", "near"]).where("a <> node")
    edges = stored(_verified(meet.select("a", F.col("node").alias("b")), sets, least), "spotsigs")
    roots = components(edges)
    named = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stored(named, "spotsigs")
    probe = named.select("sig", "n", F.col("node").alias("a"), F.col("root").alias("a_root"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    other = named.select("sig", "part", F.col("node").alias("b"), F.col("root").alias("b_root"), F.col("n").alias("m"))
    fits = (F.col("a_root") != F.col("b_root")) & (F.least("n", "m") >= least * F.greatest("n", "m")) & ((F.col("n") != F.col("m")) | (F.col("a") < F.col("b")))
    rest = _verified(probe.join(other, ["sig", "part"]).where(fits).select("a", "b"), sets, least)
    return components(edges.unionByName(rest))


def near_duplicates(docs: DataFrame, least: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row, component_id the smallest doc_id reachable by links of ``least`` or more."""
    common = anchors(docs, text=text)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), signatures(docs[text], common).alias("sigs"))
    rows = stored(rows.withColumn("node", F.xxhash64("sigs")), "spotsigs")
    sets = stored(rows.where(F.size("sigs") > 0).groupBy("node").agg(F.first("sigs").alias("sigs")), "spotsigs")
    roots = linked(sets, least)
    rows = rows.join(roots, "node", "left").select("doc_id", "sigs", F.coalesce("root", "node").alias("root"))
    least_id = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least_id, "root").select("doc_id", fingerprint(F.col("sigs")).alias("fingerprint"), "component_id")


def op11_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compared(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


QUERIES = {"op11_spotsigs": op11_spotsigs}
ORACLES = {
    "op11_spotsigs": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS following, first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS top FROM documents),
e AS (SELECT doc_id, text, coalesce(following, top) AS nxt, length(text) AS n, length(text) // 3 AS m FROM d),
f AS (SELECT doc_id, text, nxt, n, substr(text, 1, n - m) || substr(nxt, 1, m) AS edited FROM e),
w AS (SELECT word, count(*) AS c FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS word FROM d) GROUP BY word),
common AS (SELECT coalesce(list(word), []) AS a FROM (SELECT word, c, sum(c) OVER () AS total, sum(c) OVER (ORDER BY c DESC, word) AS taken FROM w) WHERE c >= 0.001 * total AND 2 * taken <= total),
texts AS (SELECT text FROM f UNION SELECT edited FROM f),
split AS (SELECT text, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS ws FROM texts),
each AS (SELECT text, u.p AS p, ws[u.p] AS word, ws[u.p] IN (SELECT unnest(a) FROM common) AS anchor FROM split, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS p) u),
content AS (SELECT text, list(word ORDER BY p) AS c FROM each WHERE NOT anchor GROUP BY text),
places AS (SELECT text, word, p - row_number() OVER (PARTITION BY text ORDER BY p) AS before FROM each WHERE anchor UNION ALL SELECT text, '', 0 FROM split WHERE len(ws) > 0),
sigs AS (SELECT text, list(DISTINCT substr(md5(word || ' ' || array_to_string(coalesce(c, [])[before + 1:before + 4], ' ')), 1, 8)) AS s FROM places LEFT JOIN content USING (text) GROUP BY text),
prints AS (SELECT text, coalesce(list_sort(s), []) AS s FROM split LEFT JOIN sigs USING (text)),
j AS (SELECT f.doc_id, f.n, f.edited, a.s AS a, b.s AS b, x.s AS x FROM f JOIN prints a ON a.text = f.text JOIN prints b ON b.text = f.edited JOIN prints x ON x.text = f.nxt)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END AS near_edited,
  CASE WHEN len(a) + len(x) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, x))::DOUBLE / (len(a) + len(x) - len(list_intersect(a, x))) END AS near_next
FROM j"""
}
