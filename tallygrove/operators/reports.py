"""What is made of findings: order, merging, risk, summaries and analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graphs import components, stored


def rank(severity: Column) -> Column:
    return F.when(severity == "HIGH", 3).when(severity == "MEDIUM", 2).when(severity == "LOW", 1).otherwise(0)


def ordered(f: DataFrame) -> DataFrame:
    """H1: by severity, then score, both falling."""
    return f.orderBy(F.desc(rank(F.col("severity"))), F.desc("score"), "finding_type", "entity")


def deduplicated(v: DataFrame) -> DataFrame:
    """H2: one violation of each (type, document, entity): the most severe, then the one of smallest id."""
    w = Window.partitionBy("finding_type", "document_name", "entity").orderBy(F.desc(rank(F.col("severity"))), "finding_id")
    return v.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


#: What a merged finding tells of its strongest one.
TOLD = ("source", "finding_type", "document_name", "severity", "entity", "amount", "evidence", "finding_id")


def rooted(f: DataFrame, told: tuple[str, ...] = TOLD) -> DataFrame:
    """Distinct findings with ``fid`` and ``root``: findings of one root share transaction ids, directly or through others.

    Only the columns ``told`` (with the score and the ids) are kept, and stored once."""
    f = f.select(F.xxhash64("finding_id", "source", "evidence").alias("fid"), "score", "transaction_ids", *told)
    f = stored(f.dropDuplicates(["fid"]), "merge")
    ids = f.select("fid", F.explode("transaction_ids").alias("id")).where("id is not null").select("fid", F.xxhash64("id").alias("id"))
    # Each id ties its findings to the smallest of them: a star, not all pairs.
    star = ids.groupBy("id").agg(F.min("fid").alias("hub"))
    roots = components(ids.join(star, "id").select(F.col("fid").alias("a"), F.col("hub").alias("b")))
    return f.join(roots.withColumnRenamed("node", "fid"), "fid", "left").withColumn("root", F.coalesce("root", "fid"))


def merged(f: DataFrame) -> DataFrame:
    """H3: findings that share a transaction id become one: the strongest, with the types and the number of all.

    Findings are connected over ids, so the outcome does not depend on their order; a finding that bridges two groups
    joins them.  The ids of a merged finding are rows of :func:`members`, as a group may have any number of them.
    """
    return strongest(rooted(f))


def strongest(rows: DataFrame, **more: Column) -> DataFrame:
    """The merged finding of each root of :func:`rooted` findings; ``more`` are further aggregates."""
    best = F.max_by(F.struct(*[c for c in TOLD if c in rows.columns]), F.struct(rank(F.col("severity")).alias("rank"), "score", (-F.col("fid")).alias("tie")))
    g = rows.groupBy("root").agg(best.alias("b"), F.max("score").alias("score"), F.array_sort(F.collect_set("finding_type")).alias("merged_types"), F.count("*").alias("n"), *[x.alias(k) for k, x in more.items()])
    return g.select("root", "b.*", "score", "merged_types", "n", *more)


def members(f: DataFrame) -> DataFrame:
    """(root, transaction_id): the ids that merged findings stand on."""
    return rooted(f).select("root", F.explode("transaction_ids").alias("transaction_id")).distinct()


def risk(f: DataFrame) -> DataFrame:
    """A5: the risk score, in one row: weighted findings, flattened above fifty, at most a hundred."""
    weight = F.when(F.col("severity") == "HIGH", 18.0).when(F.col("severity") == "MEDIUM", 6.0).when(F.col("severity") == "LOW", 2.0).otherwise(0.0)
    weak = (F.col("finding_type") == "multivariate_anomaly") | F.coalesce(F.get_json_object("evidence", "$.z_method_flag") == "false", F.lit(False))
    anomaly = weight * F.col("score") * F.when((F.col("severity") == "MEDIUM") & weak, 0.5).otherwise(1.0)
    rule = weight * F.when(F.col("severity") == "HIGH", 1.2).otherwise(1.0)
    raw = f.agg((F.coalesce(F.sum(F.when(F.col("source") == "policy", rule).otherwise(anomaly)), F.lit(0.0)) * 100 / 300).alias("raw"))
    return raw.select(F.round(F.least(F.lit(100.0), F.when(F.col("raw") > 50, 50 + (F.col("raw") - 50) * 0.5).otherwise(F.col("raw"))), 1).alias("risk_score"))


def simple_risk(f: DataFrame) -> DataFrame:
    """The fallback score from counts alone."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return f.agg(F.round(F.least(F.lit(100.0), (18 * n("HIGH") + 6 * n("MEDIUM") + 2 * n("LOW")) / 300.0 * 100), 1).alias("risk_score"))


def severities(f: DataFrame) -> DataFrame:
    """A4: findings by severity, in one row."""
    return f.agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("HIGH", "MEDIUM", "LOW")], F.count("*").alias("total"))


def breakdown(f: DataFrame) -> DataFrame:
    """Findings by type, with the worst severity."""
    worst = F.max(rank(F.col("severity")))
    return f.groupBy("finding_type").agg(F.count("*").alias("n"), worst.alias("worst_rank"))


def flagged(f: DataFrame) -> DataFrame:
    """A10: flagged amounts, all and of high severity."""
    a = F.coalesce("amount", F.lit(0.0))
    return f.agg(F.round(F.sum(a), 2).alias("total"), F.round(F.sum(F.when(F.col("severity") == "HIGH", a).otherwise(0.0)), 2).alias("high"))


def by_category(f: DataFrame) -> DataFrame:
    """Flagged amount by the category in a finding's evidence."""
    return f.groupBy(F.coalesce(F.get_json_object("evidence", "$.category"), F.lit("uncategorized")).alias("category")).agg(F.round(F.sum(F.coalesce("amount", F.lit(0.0))), 2).alias("total"), F.count("*").alias("n"))


def concentration(t: DataFrame) -> DataFrame:
    """Total and number of payments by vendor."""
    return t.groupBy("party_name").agg(F.round(F.sum("amount"), 2).alias("total"), F.count("*").alias("n"))


def timeline(t: DataFrame) -> DataFrame:
    """Amount and number by day."""
    return t.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("amount"), 2).alias("total"), F.count("*").alias("n"))


def by_document(f: DataFrame) -> DataFrame:
    """Findings by document."""
    return f.groupBy("document_name").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "HIGH").alias("high"), F.collect_list(F.struct("finding_type", "severity", "entity")).alias("findings"))


def top(f: DataFrame, n: int = 3) -> DataFrame:
    """H4: the strongest findings; violations take a score by severity."""
    s = F.when(F.col("source") == "policy", F.when(F.col("severity") == "HIGH", 0.85).when(F.col("severity") == "MEDIUM", 0.65).otherwise(0.45)).otherwise(F.col("score"))
    return f.withColumn("score", s).orderBy(F.desc(rank(F.col("severity"))), F.desc("score"), "finding_type", "entity").limit(n)


def top_types(f: DataFrame, n: int = 10) -> DataFrame:
    """H5: the most frequent types."""
    return f.groupBy("finding_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "finding_type").limit(n)


def page(f: DataFrame, number: int, size: int = 50) -> DataFrame:
    """H6: one page of the ordered findings, with the ``total`` of all; a page has 200 at most."""
    size, f = min(max(size, 1), 200), stored(f, "page")  # the checks run once, for the count and the page
    total = f.agg(F.count("*").alias("total"))  # one row
    return ordered(f).offset((max(number, 1) - 1) * size).limit(size).crossJoin(F.broadcast(total))


TYPES = ("bank_statement", "expense", "gst", "invoice", "ledger")


def by_type(documents: DataFrame) -> DataFrame:
    """A2: documents and rows of each type, 0 where there are none; ``documents`` is (document_type, document_name, n)."""
    types = documents.sparkSession.createDataFrame([(x,) for x in TYPES], "document_type string")
    g = documents.groupBy("document_type").agg(F.count("*").alias("documents"), F.sum("n").alias("n"))
    return g.join(F.broadcast(types), "document_type", "right").select("document_type", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents", "n")])


def counters(documents: DataFrame, f: DataFrame) -> DataFrame:
    """A3: documents, transactions (bank and expense rows, else those that the findings stand on), tax lines, invoices, all rows."""
    of = lambda *types: F.coalesce(F.sum(F.when(F.col("document_type").isin(*types), F.col("n"))), F.lit(0)).cast("long")
    rows = documents.agg(F.count("*").alias("documents"), of("bank_statement", "expense").alias("own"), of("gst").alias("tax_lines"), of("invoice").alias("invoices"), of(*TYPES).alias("rows"))
    named = f.select(F.explode("transaction_ids").alias("id")).agg(F.count_distinct("id").alias("named"))
    both = rows.crossJoin(named)  # one row each
    return both.select("documents", F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("named")).alias("transactions"), "tax_lines", "invoices", "rows")


def scope(f: DataFrame, name: str) -> DataFrame:
    """(kind, value): the distinct transactions and entities of a document's findings."""
    own = f.where(F.lower(F.trim("document_name")) == name.strip().lower())
    pairs = F.concat(F.transform("transaction_ids", lambda x: F.struct(F.lit("transaction").alias("kind"), x.alias("value"))), F.array(F.struct(F.lit("entity").alias("kind"), F.col("entity").alias("value"))))
    return own.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL").distinct()


def filtered(f: DataFrame, severity: str | None = None, kind: str | None = None, document: str | None = None, text: str | None = None) -> DataFrame:
    """findings by severity, part of the type or document name, and free text."""
    if severity:
        f = f.where(F.col("severity") == severity.upper())
    if kind:
        f = f.where(F.contains(F.lower("finding_type"), F.lit(kind.lower())))
    if document:
        f = f.where(F.contains(F.lower("document_name"), F.lit(document.lower())))
    if text:
        f = f.where(F.contains(F.lower(F.to_json(F.struct("*"))), F.lit(text.lower())))
    return f


def summary(f: DataFrame, most: int = 5, kind: str = "document") -> DataFrame:
    """A summary from the counts, the score, and the most frequent types of high and of medium severity; for a clean
    audit a line that names the ``kind`` of document."""
    level = F.when(F.col("risk_score") >= 60, "HIGH").when(F.col("risk_score") >= 30, "MEDIUM").otherwise("LOW")
    order = Window.partitionBy("severity").orderBy(F.desc("n"), "finding_type")
    types = f.where(F.col("severity").isin("HIGH", "MEDIUM")).groupBy("severity", "finding_type").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    said = F.concat(F.col("finding_type"), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    listed = lambda s: F.coalesce(F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("severity") == s, F.struct("r", said.alias("t"))))), lambda x: x["t"]), ", "), F.lit("")), F.lit("none"))
    tops = types.agg(listed("HIGH").alias("top_high"), listed("MEDIUM").alias("top_medium"))
    one = severities(f).crossJoin(risk(f)).crossJoin(tops)  # one row each
    line = F.format_string("Overall risk is %s (%.1f): %d findings, %d high, %d medium, %d low. High: %s. Medium: %s.", level, F.col("risk_score"), F.col("total"), F.col("high"), F.col("medium"), F.col("low"), F.col("top_high"), F.col("top_medium"))
    clean = F.lit(f"No issues found: every check of this {kind} passed.")
    return one.select("high", "medium", "low", "total", "risk_score", F.when(F.col("total") == 0, clean).otherwise(line).alias("summary"))


def vendor_totals(f: DataFrame) -> DataFrame:
    """Flagged amount and number by the vendor a finding is about."""
    v = F.nullif(F.regexp_extract("entity", "(?i)^(vendor .+)$", 1), F.lit(""))
    return f.withColumn("vendor", v).where("vendor is not null").groupBy("vendor").agg(F.round(F.sum(F.coalesce("amount", F.lit(0.0))), 2).alias("total"), F.count("*").alias("n"))


def sink_safe(df: DataFrame) -> DataFrame:
    """Numbers that JSON cannot hold (NaN, infinite) as 0."""
    inf = float("inf")
    return df.select(*[F.when(F.isnan(c) | (F.abs(c) == inf), 0.0).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
