"""Secrets by a battery of randomness tests, with DataFrame functions only.

Base rules find assignments to secret names, access keys and long hexadecimal runs; these are always reported.  Further
candidates are long runs of key characters.  For each the encoding is inferred (hexadecimal, base 32, 36, 62 and 64,
letters alone), and tests ask whether its symbols are drawn at random: chi-squared for a uniform alphabet, over all its
symbols and over vowels against the rest; runs above and below the alphabet's middle; and serial correlation of neighbours, of
their places in the alphabet, of being vowels, and of the pairs of letters that words are made of.  The tests' p-values are combined (Fisher's sum of logarithms): the statistic
is large where symbols are not random.

Secrets are what the tests can *not* tell from random, so a false discovery is a written name that looks random.  How
often those do is measured on decoys: every document gives ``DECOYS`` identifiers that are put together from its own
words.  Within a class of length and family of encodings (as names are written: in letters of one case or of both, each with
digits or without), the share of decoys whose statistic is at most a candidate's is its p-value against being written.  A false-discovery procedure (Benjamini-Hochberg) over the candidates of the corpus, with
p-values weighted by class (longer ones more, as the tests have more power there; the weights' mean over the candidates
is 1), declares those secrets that keep the share of written ones under ``LEVEL``.

Candidates are found in one scan and stored; the counts behind the procedure are histograms of at most ``BINS`` bins a
class over all candidates and all decoys, whatever their number.

Defined results: a null text is an empty one and has no spans; very long texts are read whole; candidates of one statistic
are secrets together or not at all; with few decoys nothing can be declared, so tables of a few documents get base spans
only; repeated rows count as often as they occur; columns travel in a struct, so none clashes; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .spans import found, joined, let, overlaps, plain, replaced, tagged, united

KINDS = ("assign", "access", "hex", "random")
#: Largest share of written names among what is declared a secret.
LEVEL = 0.05
#: Bins of the statistic, and how many of them make a factor of e.
BINS, FINE = 4000, 40
#: Lengths from which the classes of length begin, and what a candidate of each weighs before the weights' mean is made 1.
LENGTHS, WEIGHTS = (20, 28, 40, 64), (0.5, 1.0, 1.5, 2.0)
#: Made-up names that each document gives.
DECOYS = 4
TAGGED = "array<struct<kind:int,start:int,end:int>>"

ASSIGN = r"""(?:(?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
VALUE = r"""^(?:(?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
# Only runs long enough can match; a shorter tail of the same run can't either.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
# A name and the value after its '=' are two runs; '=' belongs to a run only as its padding.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"

#: Encodings: what shows one, its alphabet in order, its family; the first that a token shows is its own.
UPPER, LOWER, DIGITS, VOWELS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "aeiouAEIOU"
ENCODINGS = (
    (r"^(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]+$", DIGITS + "abcdef", 2),
    (r"^(?=[0-9A-F]*[0-9])(?=[0-9A-F]*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF", 2),
    (r"^(?=[A-Z2-7]*[2-7])(?=[A-Z2-7]*[A-Z])[A-Z2-7]+$", UPPER + "234567", 2),
    (r"^(?=[A-Z0-9]*[0-9])(?=[A-Z0-9]*[A-Z])[A-Z0-9]+$", DIGITS + UPPER, 2),
    (r"^(?=[a-z0-9]*[0-9])(?=[a-z0-9]*[a-z])[a-z0-9]+$", DIGITS + LOWER, 2),
    (r"^[a-z]+$", LOWER, 0),
    (r"^[A-Z]+$", UPPER, 0),
    (r"^[A-Za-z]+$", UPPER + LOWER, 1),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, 3),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", 3),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_", 3),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+$", UPPER + LOWER + DIGITS + "+/-_", 3),
)
# Pairs of letters that are frequent in words of languages written in Latin letters.
PAIRS = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur "
    "ie ai qu ei us la ta ss em un il et ec tr ge no"
).split()
#: Letters of one case, of both; letters of one case, of both with digits.
FAMILIES = 4


def weight(class_: int) -> float:
    """What a candidate of a class weighs, by its length."""
    return WEIGHTS[class_ // FAMILIES]


def base(text: Column) -> list[Column]:
    """The spans (with their matches) that each base rule finds in plain text, in the order of KINDS."""
    long = lambda s: F.length(F.regexp_replace(s["match"], VALUE, "")) >= 8
    return [F.filter(found(text, ASSIGN), long), found(text, ACCESS), found(text, HEX)]


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal, by a logistic approximation (absolute error under 2e-4)."""
    z = F.greatest(F.least(z, F.lit(20.0)), F.lit(-20.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def tested(token: Column) -> Column:
    """(class, bin): the class of length and family of a token, and the bin of the battery's statistic, 0 where most random;
    null where it has no encoding."""
    alphabets, families = F.array(*[F.lit(e[1]) for e in ENCODINGS]), F.array(*[F.lit(e[2]) for e in ENCODINGS])

    def encoded(body: Column) -> Column:
        case = F.lit(None).cast("int")
        for i, (shows, _, _) in reversed(list(enumerate(ENCODINGS))):
            case = F.when(body.rlike(shows), F.lit(i)).otherwise(case)
        return F.struct(body.alias("body"), case.alias("which"))

    def of(x: Column) -> Column:
        group = sum((F.length(x["body"]) >= least).cast("int") for least in LENGTHS) - 1
        bin_ = F.least(F.floor(_battery(x["body"], F.get(alphabets, x["which"])) * FINE), F.lit(BINS - 1)).cast("int")
        return F.when(x["which"].isNotNull(), F.struct((group * FAMILIES + F.get(families, x["which"])).alias("class"), bin_.alias("bin")))

    return let(let(F.regexp_replace(token, "=+$", ""), encoded), of)


def _battery(body: Column, alphabet: Column) -> Column:
    """The tests' p-values for the symbols of a token, combined: the sum of their negative logarithms."""
    symbols = F.transform(F.split(body, ""), lambda c: F.struct((F.position(c, alphabet).cast("double") - 1).alias("at"), (F.position(c, F.lit(VOWELS)) > 0).cast("double").alias("vowel")))
    k = F.length(alphabet).cast("double")
    vowels = k - F.length(F.translate(alphabet, VOWELS, ""))
    battery = let(symbols, lambda x: let(x["at"], lambda at: _combined(at, k)) + let(x["vowel"], lambda v: _vowels(v, vowels / k)))
    return battery + let(F.split(F.lower(body), ""), _paired)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _information(p: Column) -> Column:
    return -F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12)))


def _serial(x: Column, flat: Column) -> Column:
    """The standard score of the correlation of neighbours; ``flat`` where all are equal."""
    n = F.size(x).cast("double")
    after, before = F.slice(x, F.lit(2), F.size(x)), F.slice(x, F.lit(1), F.size(x) - 1)

    def lagged(s: Column) -> Column:
        centre = s["sum"] / n
        var = s["squares"] - n * centre * centre
        lag = s["products"] - centre * (2 * s["sum"] - F.element_at(x, 1) - F.element_at(x, -1)) + (n - 1) * centre * centre
        return F.when(var > 1e-6, F.abs(lag) / F.greatest(var, F.lit(1e-9)) * F.sqrt(n)).otherwise(flat)

    return let(F.struct(_sum(x).alias("sum"), _sum(F.transform(x, lambda v: v * v)).alias("squares"), _sum(F.zip_with(after, before, lambda a, b: a * b)).alias("products")), lagged)


def _vowels(v: Column, share: Column) -> Column:
    """Chi-squared of vowels against the rest, and their serial correlation; the first tells where all are equal."""
    n = F.size(v).cast("double")
    z = F.abs(_sum(v) - n * share) / F.sqrt(n * share * (1 - share))
    return _information(2 * _tail(z)) + _information(2 * _tail(_serial(v, F.lit(0.7))))


def _paired(c: Column) -> Column:
    """How many neighbouring letters are a frequent pair, against letters drawn at random; pairs with other symbols don't count."""
    after, before = F.slice(c, F.lit(2), F.size(c)), F.slice(c, F.lit(1), F.size(c) - 1)
    pairs = F.filter(F.zip_with(before, after, lambda a, b: F.concat(a, b)), lambda x: x.rlike("^[a-z][a-z]$"))
    share = len(PAIRS) / 676

    def score(x: Column) -> Column:
        n = F.size(x).cast("double")
        hits = F.size(F.filter(x, lambda v: v.isin(PAIRS))).cast("double")
        return F.when(n > 0, (hits - n * share) / F.sqrt(F.greatest(n, F.lit(1.0)) * share * (1 - share))).otherwise(0.0)

    return _information(_tail(let(pairs, score)))


def _combined(at: Column, k: Column) -> Column:
    n = F.size(at).cast("double")
    # Chi-squared over the alphabet, from the lengths of runs of equal symbols in order; Wilson and Hilferty's cube root
    # makes it normal.
    start = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(1.0)
        return F.struct(x.alias("last"), run.alias("run"), (acc["sum"] + 2 * run - 1).alias("sum"))

    chi = F.aggregate(F.array_sort(at), start, step, lambda acc: acc["sum"]) * k / n - n
    df = k - 1
    z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
    after, before = F.slice(at, F.lit(2), F.size(at)), F.slice(at, F.lit(1), F.size(at) - 1)

    def runs(x: Column) -> Column:
        """Runs above and below the middle of the alphabet."""
        n1, turns = x["high"], x["turns"]
        n0 = n - n1
        mean = 2 * n0 * n1 / n + 1
        spread = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))
        return F.when((n0 > 0) & (n1 > 0), F.abs(turns + 1 - mean) / F.sqrt(spread)).otherwise(F.sqrt(n))

    turned = F.zip_with(after, before, lambda a, b: ((a >= k / 2) != (b >= k / 2)).cast("double"))
    z_runs = let(F.struct(_sum(F.transform(at, lambda x: (x >= k / 2).cast("double"))).alias("high"), _sum(turned).alias("turns")), runs)
    return _information(_tail(z_chi)) + _information(2 * _tail(z_runs)) + _information(2 * _tail(_serial(at, F.sqrt(n))))


def candidates(text: Column, spans: Column) -> Column:
    """array<struct<start, end, t>>: candidates with an encoding that touch no span of ``spans``, and their class and bin."""
    free = F.filter(found(text, CANDIDATE), lambda s: ~F.exists(spans, lambda b: overlaps(s, b)))
    binned = F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), tested(s["match"]).alias("t")))
    return F.filter(binned, lambda s: s["t"].isNotNull())


def decoys(text: Column) -> Column:
    """array<struct<class, bin>> of identifiers put together from consecutive words at random places of a text."""

    def name(hashed: Column, turn: int) -> Column:
        h = F.xxhash64(hashed, F.lit(turn))
        near = F.substring(text, F.pmod(h, F.greatest(F.length(text) - 300, F.lit(1))).cast("int") + 1, F.lit(300))
        # What may be cut off, and what may be a secret itself, gives no words.
        whole = F.split(F.regexp_replace(near, r"^\S+|\S+$|\S{20,}+", " "), "[^A-Za-z]+")
        some = F.filter(whole, lambda w: F.length(w).between(2, 15))
        digits = F.pmod(F.shiftright(h, 16), F.lit(1000)).cast("string")
        size = F.lit(LENGTHS[0]) + F.pmod(F.shiftright(h, 32), F.lit(60)).cast("int")

        def written(w: Column) -> Column:
            form = F.pmod(F.shiftright(h, 8), F.lit(6))
            low = F.lower(F.array_join(w, ""))
            camel = F.array_join(F.transform(w, lambda x: F.initcap(x)), "")
            return F.when(form == 0, low).when(form == 1, F.upper(low)).when(form == 2, camel).when(form == 3, F.concat(digits, low)).when(form == 4, F.concat(digits, F.upper(low))).otherwise(F.concat(digits, camel))

        return let(F.substring(let(some, written), F.lit(1), size), lambda token: F.when(F.length(token) >= LENGTHS[0], tested(token)))

    made = let(F.xxhash64(text), lambda h: F.array(*[name(h, i) for i in range(DECOYS)]))
    return F.filter(made, lambda t: t.isNotNull())


def _scan(docs: DataFrame, row: Column) -> DataFrame:
    """(row, _b, _base, _c, _d), stored: spans of each base rule, all of them, candidates and decoys."""
    rows = docs.select(row.alias("row"), plain(docs["text"]).alias("_t"))
    rows = rows.withColumn("_b", F.array(*[tagged(s, k) for k, s in enumerate(base(F.col("_t")))]))
    rows = rows.withColumn("_base", F.flatten("_b"))
    rows = rows.withColumn("_c", candidates(F.col("_t"), F.col("_base"))).withColumn("_d", decoys(F.col("_t")))
    return stored(rows.drop("_t"), "secrets")


def limits(scan: DataFrame) -> list[int]:
    """For each class the last bin that is declared a secret, -1 for none."""
    both = scan.select(F.explode(F.concat(F.transform("_c", lambda c: F.struct(F.lit(1).alias("real"), c["t"].alias("t"))), F.transform("_d", lambda t: F.struct(F.lit(0).alias("real"), t.alias("t"))))).alias("x"))
    counts = both.groupBy("x.real", F.col("x.t.class").alias("class"), F.col("x.t.bin").alias("bin")).count().collect()
    return _declared([(r["real"], r["class"], r["bin"], r["count"]) for r in counts])


def _declared(counts: list[tuple[int, int, int, int]]) -> list[int]:
    """limits() from the counts (real or decoy, class, bin, number)."""
    classes = range(FAMILIES * len(LENGTHS))
    real, made = ({(c, b): n for r, c, b, n in counts if r == side} for side in (1, 0))
    total = sum(real.values())
    of = [sum(n for (c, _), n in real.items() if c == k) for k in classes]
    mean = sum(weight(k) * of[k] for k in classes) / max(total, 1)
    cells = []
    for k in classes:
        seen, n_made = 0, sum(n for (c, _), n in made.items() if c == k)
        for b in range(BINS):
            seen += made.get((k, b), 0)
            if (k, b) in real:
                cells.append(((1 + seen) / (1 + n_made) * mean / weight(k), k, b))
    out, above, last = [-1] * len(classes), 0, 0
    cells.sort()
    for i, (p, k, b) in enumerate(cells):
        above += real[k, b]
        if p <= LEVEL * above / total:
            last = i + 1
    for _, k, b in cells[:last]:
        out[k] = max(out[k], b)
    return out


def detected(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(row, base, spans, counts): ``row`` (by default the doc_id), its base spans and all spans, as (kind, start, end) by
    start, then kind, and the numbers of base spans by kind."""
    scan = _scan(docs, docs["doc_id"] if row is None else row)
    last = F.array(*[F.lit(x) for x in limits(scan)])
    more = F.transform(F.filter("_c", lambda c: c["t"]["bin"] <= F.get(last, c["t"]["class"])), lambda c: F.struct(F.lit(len(KINDS) - 1).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    counts = F.transform("_b", lambda b: F.size(b))
    return scan.select("row", _ordered(F.col("_base")).alias("base"), _ordered(F.concat(F.col("_base"), more)).alias("spans"), counts.alias("counts"))


def _ordered(spans: Column) -> Column:
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(by_start, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret of a text replaced by [SECRET]."""
    rows = detected(docs, F.struct(*[docs[c] for c in docs.columns]))
    text = replaced(F.col("row.text").cast("string"), united(F.col("spans"), TAGGED), lambda s: F.lit("[SECRET]"))
    clean = F.when(F.size("spans") < 1, F.col("row.text")).otherwise(text)
    return rows.select(*[(clean if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detected(table(spark, sf_dir, "documents")).withColumnRenamed("row", "doc_id")
    counts = [F.get("counts", F.lit(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))


QUERIES = {"op4_secrets": op4_secrets}
ORACLES: dict[str, str] = {}
