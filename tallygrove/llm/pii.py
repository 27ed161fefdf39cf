"""Personal data by boosted trees over candidate spans, with DataFrame functions only.

Base rules find e-mail addresses, IP addresses, card and phone numbers; what they find is always redacted.  Generators
of high recall propose further spans, which may overlap: addresses with spelt-out signs, addresses of the newer internet
protocol, numbers with any separators.  Boosted trees score a candidate by its format, its check digit and its context.
For each kind the threshold is the lowest score at which held-out candidates reach ``PRECISION``; candidates above it that
touch no base span are added, best first.  The trees are turned into one SQL expression, so scoring takes no second pass
and no join.

The trees' labels don't come from the base rules.  Each document of the fit gives two snippets of its own words with a
written example set between them.  Positive examples have shapes that the base rules miss (signs spelt out, separators
changed, fifteen digits, a mistyped digit, national phone numbers); negative ones look alike but are none (dates, times,
versions, sums, order numbers, identifiers of any length).  The generators run over the snippets, and what overlaps the
example is labelled by it, so a shape that no generator proposes is not learned.

The fit reads the texts of ``FIT_DOCS`` documents at most, those of least hash.

Defined results: a null text is an empty one and has no spans; very long texts are read whole; of candidates that overlap
the one of higher score stays, on ties the first; repeated rows get the same spans; without documents of a word to fit
on only base spans are found; an empty table gives an empty table; other columns are ignored by :func:`detected` and kept
by :func:`redacted`, whose columns travel in a struct, so none clashes; it leaves a null text null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .spans import disjoint, found, joined, overlaps, plain, replaced, tagged, united

KINDS = ("email", "ip", "card", "phone")
FIT_DOCS = 10_000
PRECISION = 0.97
TREES, DEPTH = 20, 4
TAGGED = "array<struct<kind:int,start:int,end:int>>"

# A match begins where its first run begins or where the match before it ended; any later start in the run would fail
# as well.  With that and possessive runs the patterns take linear time, and find what the plain ones find.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates: addresses with a spelt-out sign, dotted numbers, long numbers, numbers with separators.
PROPOSE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+)++",
    r"(?<![0-9.])[0-9]{1,4}+(?:\.[0-9]{1,4}+){3}+(?![0-9.])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:{1,2}){3,7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    r"(?<![0-9.])[0-9](?:[\x20./-]?[0-9]){12,18}+(?![0-9])",
    r"(?<![0-9+(])[+(]?[0-9][\x20().0-9-]{5,18}[0-9](?![0-9])",
)
HINTS = r"(?i)\b(?:e-?mail|mail|phone|tel|call|fax|mobile|contact|card|visa|account|acct|ip|host|address|ssn)\W*$"
LABELS = r"(?i)\b(?:order|invoice|ref|no|nr|id|isbn|version|release|v|on|at|from|total|sum|page|section|since|ticket|build)\W*$"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check-digit rule."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.ascii(c) - 48)
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def base(text: Column) -> list[Column]:
    """The spans (with their matches) that each base rule finds in plain text, in the order of KINDS."""
    small = r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
    cards = F.filter(found(text, CARD), lambda s: F.length(_digits(s["match"])).between(16, 19))
    return [
        found(text, EMAIL),
        F.filter(found(text, IP), lambda s: F.forall(F.split(s["match"], r"\."), lambda p: p.rlike(small))),
        F.filter(cards, lambda s: luhn(_digits(s["match"]))),
        F.filter(found(text, PHONE), lambda s: F.length(_digits(s["match"])).between(8, 15)),
    ]


def features(text: Column, s: Column, kind: int) -> list[Column]:
    """Numbers that describe a candidate's format and what stands around it."""
    m, near = s["match"], F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24)))
    after = F.substring(text, s["end"] + 1, F.lit(1))
    count = lambda chars: F.length(m) - F.length(F.translate(m, chars, ""))
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    out = [
        F.lit(kind), F.length(m), F.length(_digits(m)), count("."), count("-"), count(" "), count("()"), count("+"), count("@"),
        F.size(F.split(m, "[^0-9]+")), flag(near.rlike(HINTS)), flag(near.rlike(r"[A-Za-z0-9]$")), flag(after.rlike(r"[A-Za-z0-9]")),
        flag(m.rlike(r"^[(+]")), flag(luhn(_digits(m)) & (F.length(_digits(m)) > 11)), flag(m.rlike("^[3-6]")), count(":"), flag(near.rlike(LABELS)),
        F.length(F.regexp_extract(m, r"^[^0-9]*([0-9]*)", 1)), F.length(F.regexp_extract(m, r"([0-9]*)[^0-9]*$", 1)),
    ]
    return [x.cast("double") for x in out]


FEATURES = 20


def proposed(text: Column, spans: Column, score=None) -> Column:
    """Candidates that touch no span of ``spans`` (null: any), with features ``f``, or with ``score(features)`` as ``p``."""
    out = []
    for kind, pattern in enumerate(PROPOSE):
        cands = found(text, pattern)
        if spans is not None:
            cands = F.filter(cands, lambda s: ~F.exists(spans, lambda b: overlaps(s, b)))

        out.append(_described(text, cands, kind, score))
    return F.flatten(F.array(*out))


def _described(text: Column, cands: Column, kind: int, score) -> Column:
    def one(s: Column) -> Column:
        f = features(text, s, kind)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.array(*f).alias("f") if score is None else score(f).alias("p"))

    return F.transform(cands, one)


def _margin(node, f: list[Column]) -> Column:
    """A regression tree as nested conditions."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(f[split.featureIndex()] <= float(split.threshold()), _margin(node.leftChild(), f)).otherwise(_margin(node.rightChild(), f))


class Model:
    """Boosted trees as a SQL expression, with a threshold a kind; nothing is above the threshold of an unfitted one."""

    def __init__(self, trees=(), weights=(), thresholds=(2.0,) * len(KINDS)):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def score(self, f: list[Column]) -> Column:
        margin = F.lit(0.0)
        for t, w in zip(self.trees, self.weights):
            margin = margin + _margin(t, f) * float(w)
        return 1 / (1 + F.exp(-2 * margin))


def _shapes(d: Column, w: Column) -> tuple[list[list[Column]], list[Column]]:
    """Written examples from 36 random digits ``d`` and a word ``w``: those of each kind that are personal data, and others."""
    part = lambda lo, n: F.substring(d, lo, n)
    octet = lambda lo: (part(lo, 5).cast("int") % 256).cast("string")
    month, day, year = (F.lpad((part(lo, 3).cast("int") % n + first).cast("string"), size, "0") for lo, n, first, size in ((1, 12, 1, 2), (4, 28, 1, 2), (7, 70, 1960, 4)))
    body = F.concat(F.element_at(F.array(F.lit("4"), F.lit("5"), F.lit("3"), F.lit("6")), part(1, 1).cast("int") % 4 + 1), part(2, 14))
    # The check digit that completes the body, and one that is off.
    check = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0), lambda acc, i: F.when(luhn(F.concat(body, i.cast("string"))), i).otherwise(acc))
    card = F.concat(body, check.cast("string"))
    typo = F.concat(body, ((check + 1 + part(20, 1).cast("int") % 9) % 10).cast("string"))
    cut = lambda x, sep, *sizes: F.concat_ws(sep, *[F.substring(x, 1 + sum(sizes[:i]), n) for i, n in enumerate(sizes)])
    hexed = lambda lo: F.lower(F.hex(part(lo, 5).cast("int") % 65536))
    user = F.concat(w, F.lit("."), part(30, 2))
    yes = [
        [F.concat(user, F.lit(at), F.lit("mail"), part(1, 1), F.lit(dot), F.lit("example"), F.lit(dot), F.lit("org")) for at, dot in ((" (at) ", " (dot) "), ("[at]", "."), (" @ ", " . "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" @ ", "."))],
        [F.concat_ws(":", *[hexed(1 + 4 * i) for i in range(8)]), F.concat_ws(":", F.lit("2001"), hexed(5), F.lit(""), hexed(9), hexed(13)), F.concat_ws(".", octet(1), octet(6), octet(11), octet(16))],
        [typo, cut(typo, " ", 4, 4, 4, 4), cut(card, ".", 4, 4, 4, 4), cut(card, "/", 4, 4, 4, 4), F.concat(F.lit("37"), part(3, 13)), F.concat(F.lit("37"), part(3, 2), F.lit(" "), part(5, 6), F.lit(" "), part(11, 5)), card],
        [F.concat(F.lit("("), part(1, 3), F.lit(") 555-"), part(4, 4)), F.concat_ws("-", part(1, 3), F.lit("555"), part(4, 4)), F.concat(F.lit("0"), part(1, 3), F.lit(" "), part(4, 3), F.lit(" "), part(7, 4)), F.concat(F.lit("00"), part(1, 2), F.lit(" "), part(3, 3), F.lit(" "), part(6, 6)), F.concat_ws(" ", part(1, 3), F.lit("555"), part(4, 4))],
    ]
    no = [
        F.concat_ws("-", year, month, day), F.concat_ws(".", day, month, year), F.concat(F.concat_ws("-", year, month, day), F.lit(" "), F.concat_ws(":", day, month, part(1, 1))), F.concat_ws(":", day, month, part(9, 2), part(11, 2)),
        F.concat_ws(".", part(1, 1), part(2, 2), (part(4, 3).cast("int") + 256).cast("string"), part(7, 4)), F.concat_ws(".", part(1, 1), part(2, 1), (part(4, 3).cast("int") % 700 + 300).cast("string"), part(7, 2)),
        F.concat(part(1, 1), F.lit(" "), part(2, 3), F.lit(" "), part(5, 3), F.lit("."), part(8, 2)), F.concat_ws("-", year, (year.cast("int") + 1).cast("string")),
        part(1, 9), part(1, 10), part(1, 12), part(1, 13), F.concat(F.lit("1"), part(2, 14)), F.concat(F.lit("9"), part(2, 15)), F.concat(F.lit("8"), part(2, 15)), F.concat(F.lit("2"), part(2, 15)), F.concat(F.lit("7"), part(2, 16)), F.concat(F.lit("0"), part(2, 17)), part(1, 18), part(1, 19),
        F.concat_ws("-", F.lit("978"), part(1, 1), part(2, 4), part(6, 4), part(10, 1)), F.concat_ws("-", part(1, 5), part(6, 4), part(10, 6)), F.concat_ws(" ", part(1, 2), part(3, 2), part(5, 2), part(7, 2)),
    ]
    return yes, no


def examples(texts: DataFrame) -> DataFrame:
    """(doc_id, t, lo, hi, kind): snippets of the documents' words around a written example at lo to hi; kind -1: it is none."""
    digits = F.concat(*[F.lpad(F.pmod(F.xxhash64("doc_id", "turn", F.lit(i)), F.lit(10**12)).cast("string"), 12, "0") for i in range(3)])
    rows = texts.select("doc_id", F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1))))
    pick = lambda salt, n: F.pmod(F.xxhash64("doc_id", "turn", F.lit(salt)), n).cast("int")
    rows = rows.select("doc_id", "turn", "words", digits.alias("d"), pick("place", F.size("words")).alias("at"), pick("kind", F.lit(len(KINDS))).alias("kind"))
    plain_word = F.lower(F.regexp_replace(F.get("words", F.col("at")), "[^A-Za-z]", ""))
    rows = rows.withColumn("w", F.when(F.length(plain_word) > 1, F.substring(plain_word, 1, 12)).otherwise(F.lit("jo")))
    yes, no = _shapes(F.col("d"), F.col("w"))
    of = lambda shapes, salt: F.get(F.array(*shapes), pick(salt, F.lit(len(shapes))))
    good = F.get(F.array(*[of(x, "shape") for x in yes]), F.col("kind"))
    hint = F.array(*[F.lit(x) for x in ("", "", "", "", "call", "mail:", "tel.", "contact", "id", "no.", "order", "card", "ip")])
    rows = rows.withColumn("example", F.when(F.col("turn") == 0, good).otherwise(of(no, "no"))).withColumn("kind", F.when(F.col("turn") == 0, F.col("kind")).otherwise(-1))
    # A hint that names the wrong thing would teach the wrong thing: positives get no "order", negatives no "mail".
    said = F.get(hint, F.when(F.col("turn") == 0, F.get(F.array(*[F.lit(i) for i in (0, 1, 4, 5, 6, 7, 11, 12)]), pick("hint", F.lit(8)))).otherwise(F.get(F.array(*[F.lit(i) for i in (0, 1, 2, 3, 8, 9, 10)]), pick("hint", F.lit(7)))))
    before = F.array_join(F.concat(F.slice("words", F.greatest(F.col("at") - 4, F.lit(1)), F.least(F.col("at"), F.lit(5))), F.when(said == "", F.array().cast("array<string>")).otherwise(F.array(said))), " ")
    rows = rows.withColumn("before", F.when(before == "", "").otherwise(F.concat(before, F.lit(" "))))
    rows = rows.withColumn("t", F.concat("before", "example", F.lit(" "), F.array_join(F.slice("words", F.col("at") + 1, F.lit(5)), " ")))
    return rows.select("doc_id", "t", F.length("before").alias("lo"), (F.length("before") + F.length("example")).alias("hi"), "kind")


def fit(docs: DataFrame) -> Model:
    """Trees and thresholds from written examples set into a bounded sample of documents."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    # The hash is of the id alone, so only ids are sorted; a document with several rows may add each of them.
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
    texts = docs.select("doc_id", plain(F.col("text")).alias("t")).join(F.broadcast(ids), "doc_id", "left_semi")
    rows = examples(texts).withColumn("c", F.explode(proposed(F.col("t"), None))).where(F.col("c.start") < F.col("hi")).where(F.col("c.end") > F.col("lo"))
    # A candidate that takes in half of the example or less, or is mostly context, is none.
    both = F.least("hi", "c.end") - F.greatest("lo", "c.start")
    hit = (F.col("kind") == F.col("c.kind")) & (both * 2 > F.col("hi") - F.col("lo")) & (both * 2 > F.col("c.end") - F.col("c.start"))
    rows = stored(rows.select(hit.cast("double").alias("label"), F.col("c.kind").alias("kind"), F.col("c.f").alias("f"), (F.pmod(F.xxhash64("doc_id", F.lit("hold")), F.lit(4)) == 0).alias("held")), "pii")
    train = rows.where("not held").select("label", array_to_vector("f").alias("features"))
    if train.select("label").distinct().count() < 2:
        return Model()
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=32, seed=3).fit(train)
    model = Model([t._java_obj.rootNode() for t in fitted.trees], fitted.treeWeights)
    f = [F.col("f")[i] for i in range(FEATURES)]
    bins = rows.where("held").groupBy("kind", F.floor(model.score(f) * 200).cast("int").alias("bin")).agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
    model.thresholds = [_threshold([b for b in bins if b["kind"] == k]) for k in range(len(KINDS))]
    return model


def _threshold(bins: list) -> float:
    """The lowest score from which on held-out candidates reach PRECISION; unreachable where none do."""
    best, good, n = 2.0, 0.0, 0
    for b in sorted(bins, key=lambda b: -b["bin"]):
        good, n = good + b["good"], n + b["n"]
        # One candidate more, and a wrong one: few candidates prove little.
        if good / (n + 1) >= PRECISION:
            best = b["bin"] / 200
    return best


def _with_spans(rows: DataFrame, model: Model) -> DataFrame:
    """Adds ``base`` and ``spans`` to rows with plain text ``_t``: base spans, and all, by kind and start."""
    t = F.col("_t")
    rows = rows.withColumn("_b", F.array(*[tagged(s, k) for k, s in enumerate(base(t))])).withColumn("_base", F.flatten("_b"))
    if not model.trees:
        return rows.withColumn("_spans", F.col("_base"))
    limit = F.array(*[F.lit(float(x)) for x in model.thresholds])
    cands = F.filter(proposed(t, F.col("_base"), model.score), lambda c: c["p"] >= F.get(limit, c["kind"]))
    rows = rows.withColumn("_c", cands)
    ranked = F.array_sort(F.transform("_c", lambda c: F.struct((-c["p"]).alias("p"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    best = disjoint(ranked, "array<struct<p:double,start:int,end:int,kind:int>>")
    more = F.transform(best, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return rows.withColumn("_spans", F.when(F.size("_c") < 1, F.col("_base")).otherwise(F.array_sort(F.concat(F.col("_base"), more))))


def detected(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, base, spans): for each row its base spans and all spans, as (kind, start, end) by kind, then start."""
    rows = docs.select("doc_id", plain(F.col("text")).alias("_t"))
    rows = _with_spans(rows, model or fit(docs))
    return rows.select("doc_id", F.col("_base").alias("base"), F.col("_spans").alias("spans"), F.transform("_b", lambda b: F.size(b)).alias("counts"))


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with every span of a text replaced by its kind in brackets, such as [EMAIL]."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), plain(docs["text"]).alias("_t"))
    rows = _with_spans(rows, model or fit(docs))
    by_start = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    merged = united(F.transform(by_start, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), TAGGED)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = replaced(F.col("doc.text").cast("string"), merged, lambda s: F.get(names, s["kind"]))
    clean = F.when(F.size("_spans") < 1, F.col("doc.text")).otherwise(text)
    return rows.select(*[(clean if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detected(table(spark, sf_dir, "documents"))
    counts = [F.get("counts", F.lit(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))


QUERIES = {"op3_pii": op3_pii}
ORACLES: dict[str, str] = {}
