"""Joins between invoices, payments, vendors and employees.

Fuzzy and ranged conditions are blocked by equalities that lose nothing, and then checked exactly.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..graphs import components, stored
from ..schema import HIGH, findings
from .vectors import near

#: Rows up to which a list (of queries or words) is broadcast.
SMALL = 10_000


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has at most SMALL rows."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def candidates(inv: DataFrame, pay: DataFrame, vectors: DataFrame, vendor_ratio: float = 0.85) -> DataFrame:
    """Payments within two per cent and thirty days of an invoice, of a similar vendor, with a confidence.

    Invoices have invoice_id, seq, vendor, invoice_date and amt, payments txn_id, seq, vendor, pay_date and amount, and
    ``vectors`` (vendor, vec) one row a vendor.  Vendors are compared once; invoices then meet only payments of similar
    vendors with amounts and days of one of two or three neighbouring ranges, by equality.
    """
    log = lambda c: F.floor(F.log(F.abs(c)) / 0.020202707)
    day = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / 31)
    asked, paid = (vectors.join(side.select("vendor").distinct(), "vendor", "left_semi") for side in (inv, pay))
    alike = stored(near(asked, paid, vendor_ratio, key="vendor", vector="vec", distinct=False), "vendors")
    alike = alike.select(F.col("query_id").alias("vendor"), F.col("vendor").alias("payee"), F.least(F.lit(1.0), "similarity").alias("vendor_score")).where(F.col("vendor_score") >= vendor_ratio)
    i = inv.where("amt > 0").select("invoice_id", F.col("seq").alias("i_seq"), "vendor", "invoice_date", "amt", log(F.col("amt")).alias("b0"), day("invoice_date").alias("s0")).join(small(alike), "vendor")
    i = i.withColumn("block", F.explode(F.array(*[F.col("b0") + d for d in (-1, 0, 1)]))).withColumn("span", F.explode(F.array("s0", F.col("s0") + 1)))
    p = pay.where("amount > 0").select("txn_id", F.col("seq").alias("p_seq"), F.col("vendor").alias("payee"), "pay_date", "amount", log(F.col("amount")).alias("block"), day("pay_date").alias("span"))
    met = i.join(p, ["payee", "block", "span"]).where((F.abs(F.col("amt") - F.col("amount")) <= 0.02 * F.col("amt")) & F.datediff("pay_date", "invoice_date").between(0, 30))
    score = 0.45 * S.amount_similarity(F.col("amt"), F.col("amount")) + 0.40 * F.col("vendor_score") + 0.15 * S.date_proximity(F.col("invoice_date"), F.col("pay_date"))
    return met.select("invoice_id", "i_seq", "txn_id", "p_seq", F.round(score, 6).alias("confidence"))


def best_match(cand: DataFrame) -> DataFrame:
    """The best payment of each invoice, ties to the earlier payment."""
    order = Window.partitionBy("invoice_id").orderBy(F.desc("confidence"), "p_seq")
    return cand.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


#: Candidates of a group of invoices and payments that one task serves.
GROUP = 200_000


def _served(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that are matches, of rows in order of root, invoice and preference; a group may go on in the next batch."""
    root, invoice, taken = None, None, set()
    for b in batches:
        rows = []
        for at, r in enumerate(zip(*(b.column(c).to_pylist() for c in ("root", "i_seq", "invoice_id", "txn_id")))):
            if r[0] != root:
                root, invoice, taken = r[0], None, set()
            if r[1:3] != invoice and r[3] not in taken:
                taken.add(r[3])
                rows.append(at)
                invoice = r[1:3]
        yield b.take(pa.array(rows, pa.int64())).select(["invoice_id", "i_seq", "txn_id", "p_seq", "confidence"])


def reconciled(cand: DataFrame) -> DataFrame:
    """Each payment used once, invoices served in order, each by its best payment left.

    Only invoices and payments that are linked through candidates can take something from each other.  An invoice whose
    payments no other can use takes its best.  All others are grouped by connected components; many groups pass through a task
    in one stream of rows.  Groups of more than ``GROUP`` candidates are served by rounds over all tasks, however many they
    need: in each the invoices that come first for their best payment are final.
    """
    cand = stored(cand, "reconcile")
    wanted = cand.groupBy("txn_id").agg(F.count("*").alias("wanted"))
    rivals = cand.join(wanted, "txn_id").groupBy("invoice_id").agg(F.max("wanted").alias("wanted"))
    rivals = stored(rivals, "reconcile")
    alone = best_match(cand.join(rivals.where("wanted = 1"), "invoice_id", "left_semi"))
    cand = stored(cand.join(rivals.where("wanted > 1"), "invoice_id", "left_semi"), "reconcile")
    edges = cand.select(F.xxhash64(F.lit("i"), "invoice_id").alias("a"), F.xxhash64(F.lit("p"), "txn_id").alias("b"))
    keyed = cand.withColumn("node", F.xxhash64(F.lit("i"), "invoice_id")).join(components(edges), "node").drop("node")
    sizes = keyed.groupBy("root").count()
    keyed = stored(keyed.join(sizes, "root"), "reconcile")
    few = keyed.where(F.col("count") <= GROUP).repartition("root").sortWithinPartitions("root", "i_seq", "invoice_id", F.desc("confidence"), "p_seq")
    schema = "invoice_id string, i_seq long, txn_id string, p_seq long, confidence double"
    few = few.select("root", "invoice_id", F.col("i_seq").cast("long"), "txn_id", F.col("p_seq").cast("long"), "confidence").mapInArrow(_served, schema)
    columns = ["invoice_id", "i_seq", "txn_id", "p_seq", "confidence"]
    large = _by_rounds(keyed.where(F.col("count") > GROUP).drop("root", "count"))
    return alone.select(columns).unionByName(few).unionByName(large.select(columns))


def _by_rounds(left: DataFrame) -> DataFrame:
    left, matched = stored(left, "reconcile"), left.limit(0)
    while left.take(1):
        offers = best_match(left)
        # An offer is final once no earlier invoice can still want its payment.
        rival = left.groupBy("txn_id").agg(F.min(F.struct("i_seq", "invoice_id")).alias("first"))
        final = stored(offers.join(rival, "txn_id").where((F.col("first.i_seq") == F.col("i_seq")) & (F.col("first.invoice_id") == F.col("invoice_id"))).drop("first"), "reconcile")
        matched = matched.unionByName(final)
        left = left.join(final.select("invoice_id"), "invoice_id", "left_anti").join(final.select("txn_id"), "txn_id", "left_anti")
        left = stored(left, "reconcile")
    return matched


MATCH = "invoice_id string, i_seq long, txn_id string, p_seq long, confidence double"


def _served_by_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches, of rows in order of root and kind: pairs of kinds (0), payments by ``seq`` (1), invoices by ``seq`` (2); a group
    may go on in the next batch."""
    names = [c.split(" ")[0] for c in MATCH.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64()]
    root, liked, left = None, {}, {}
    for b in batches:
        out = []
        for r, what, kind, other, seq, id_, confidence in zip(*(b.column(c).to_pylist() for c in ("root", "what", "kind", "other", "seq", "id", "confidence"))):
            if r != root:
                root, liked, left = r, {}, {}
            if what == 0:
                liked.setdefault(kind, []).append((confidence, other))
            elif what == 1:
                left.setdefault(kind, deque()).append((seq, id_))
            else:
                # The best kind of which a payment is left; of equally good ones the earliest payment.
                best = max(((c, -left[k][0][0], k) for c, k in liked.get(kind, ()) if left.get(k)), default=None)
                if best:
                    p_seq, txn_id = left[best[2]].popleft()
                    out.append((id_, seq, txn_id, p_seq, best[0]))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 5, types)], names=names)


def matched(inv: DataFrame, pay: DataFrame, vectors: DataFrame) -> DataFrame:
    """What :func:`reconciled` gives for all :func:`candidates` of invoices and payments, without a row for each pair.

    Invoices of one vendor, amount and day are a kind, and so are payments; the confidence is one of kinds, so only pairs of kinds
    are made.  Kinds are grouped by connected components.  A group's invoices are served in order, each by the first payment left
    of its best kind; groups of more than ``GROUP`` rows are expanded to pairs and served by rounds.
    """
    i = inv.where("amt > 0 and invoice_date is not null").select(F.xxhash64(F.lit("i"), "vendor", "amt", "invoice_date").alias("kind"), "vendor", "amt", "invoice_date", F.col("seq").cast("long").alias("seq"), F.col("invoice_id").alias("id"))
    p = pay.where("amount > 0 and pay_date is not null").select(F.xxhash64(F.lit("p"), "vendor", "amount", "pay_date").alias("kind"), "vendor", "amount", "pay_date", F.col("seq").cast("long").alias("seq"), F.col("txn_id").alias("id"))
    nothing = F.lit(0).alias("seq")
    kinds = candidates(i.select(F.col("kind").alias("invoice_id"), "vendor", "amt", "invoice_date", nothing).distinct(), p.select(F.col("kind").alias("txn_id"), "vendor", "amount", "pay_date", nothing).distinct(), vectors)
    kinds = stored(kinds.select(F.col("invoice_id").alias("kind"), F.col("txn_id").alias("other"), "confidence"), "reconcile")
    roots = components(kinds.select(F.col("kind").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "kind")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    row = ("root", "what", "kind", "other", "seq", "id", "confidence")
    pairs = kinds.join(roots, "kind").withColumns({"what": F.lit(0), "seq": none("seq", "long"), "id": none("id", "string")}).select(*row)
    of = lambda side, what: side.select("kind", "seq", "id").join(roots, "kind").withColumns({"what": F.lit(what), "other": none("other", "long"), "confidence": none("confidence", "double")}).select(*row)
    rows = stored(pairs.unionByName(of(p, 1)).unionByName(of(i, 2)), "reconcile")
    large = stored(rows.groupBy("root").count().where(F.col("count") > GROUP).select("root"), "reconcile")
    few = rows.join(F.broadcast(large), "root", "left_anti").repartition("root").sortWithinPartitions("root", "what", "seq", "id")
    few = few.mapInArrow(_served_by_kinds, MATCH)
    if not large.take(1):
        return few
    rest = rows.join(F.broadcast(large), "root", "left_semi")
    side = lambda what, kind, id_, seq: rest.where(F.col("what") == what).select(F.col("kind").alias(kind), F.col("id").alias(id_), F.col("seq").alias(seq))
    cand = rest.where("what = 0").select(F.col("kind").alias("i_kind"), F.col("other").alias("p_kind"), "confidence")
    cand = cand.join(side(2, "i_kind", "invoice_id", "i_seq"), "i_kind").join(side(1, "p_kind", "txn_id", "p_seq"), "p_kind")
    columns = [c.split(" ")[0] for c in MATCH.split(", ")]
    return few.unionByName(_by_rounds(cand.select(columns)).select(columns))


def unmatched(rows: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Rows (invoices or payments) without a match among reconciled ones."""
    return rows.join(matches.select(key), key, "left_anti")


def fuzzy_duplicates(inv: DataFrame, similar: float = 0.9) -> DataFrame:
    """Pairs of invoices of vendors whose names' ratio is above ``similar``, amounts within a paisa, dates within a week."""
    from ..functions.fuzzy import sequence_ratio

    cents = F.round(F.col("total_amount") * 100).cast("long")
    a = inv.select(F.col("seq").alias("a_seq"), F.lower(F.trim("vendor_name")).alias("a_vendor"), F.col("invoice_date").alias("a_date"), F.col("total_amount").alias("a_total"), cents.alias("cents"))
    b = inv.select(F.col("seq").alias("b_seq"), F.lower(F.trim("vendor_name")).alias("b_vendor"), F.col("invoice_date").alias("b_date"), F.col("total_amount").alias("b_total"), F.explode(F.array(cents - 1, cents, cents + 1)).alias("cents"))
    j = a.join(b, "cents").where((F.col("a_seq") < F.col("b_seq")) & (F.abs(F.col("a_total") - F.col("b_total")) <= 0.0100001) & (F.abs(F.datediff("a_date", "b_date")) <= 7))
    # Names are compared once a pair of names; equal ones, and ones that letters rule out, not at all.
    apart = j.where((F.col("a_vendor") != F.col("b_vendor")) & (ratio_bound("a_vendor", "b_vendor") > similar))
    alike = apart.select("a_vendor", "b_vendor").distinct().where(sequence_ratio("a_vendor", "b_vendor") > similar)
    both = j.where(F.col("a_vendor") == F.col("b_vendor")).unionByName(apart.join(alike, ["a_vendor", "b_vendor"]).select(j.columns))
    return both.select("a_seq", "b_seq", F.round("a_total", 2).alias("amount"))


def similar_vendors(queries: DataFrame, vectors: DataFrame, threshold: float = 0.85, k: int = 25) -> DataFrame:
    """Of each query's ``k`` nearest vectors, those of at least ``threshold`` (above 0), by cells of vectors."""
    j = near(queries, vectors, threshold - 1e-6, k).select("query_id", "vec_id", F.round(F.least(F.lit(1.0), "similarity"), 6).alias("similarity"))
    j = j.where(F.col("similarity") >= threshold)
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))).where(F.col("rank") <= k)


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def ratio_bound(a: str, b: str) -> Column:
    """An upper bound of the sequence ratio of two lower-case strings, from their lengths and numbers of each letter."""
    count = lambda c, x: F.length(c) - F.length(F.replace(F.col(c), F.lit(x), F.lit("")))
    common = sum((F.least(count(a, x), count(b, x)) for x in LETTERS), F.lit(0))
    other = lambda c: F.length(F.translate(F.col(c), LETTERS, ""))
    return 2 * (common + F.least(other(a), other(b))) / (F.length(a) + F.length(b))


#: Names of up to LONGEST characters are looked up in tables of numbers of grams; pairs of more than PAIRED characters together
#: share single grams instead of pairs of grams.
LONGEST, PAIRED = 400, 128


def shared(ratio: float, la: int, lb: int) -> int:
    """The least number of pairs of neighbouring characters that two unequal names of these lengths share in order: their m
    matched characters lie in at most as many blocks as there are others, and one."""
    m = math.ceil(ratio * (la + lb) / 2 - 1e-9)
    return m - (la + lb - 2 * m + 1) if 2 * m <= la + lb and m <= min(la, lb) else -(1 << 20)


def kinds(ratio: float) -> dict[str, list[int]]:
    """For each kind of key and each length up to LONGEST, of how many of its rarest grams a name's keys are made; 0 for none.

    ``letter``: single characters, for pairs of tiny names that may share no two neighbours; ``one``: a gram, for pairs that
    may share but one; ``two``: two grams in order, for pairs that share more; ``long``: a gram, for long names.  A name needs
    the kinds of all lengths that a similar name may have.
    """
    out = {k: [0] * (LONGEST + 1) for k in ("letter", "one", "two", "long")}
    for la in range(1, LONGEST + 1):
        for lb in range(max(1, math.floor(la * ratio / (2 - ratio))), math.ceil(la * (2 - ratio) / ratio) + 1):
            c = shared(ratio, la, lb)
            if c < -1000:
                continue
            if c < 1:
                out["letter"][la] = la
            elif la + lb > PAIRED:
                out["long"][la] = max(out["long"][la], la - 1 - c + 1)
            elif c == 1:
                out["one"][la] = la - 1
            else:
                out["two"][la] = max(out["two"][la], la - 1 - c + 2)
    return out


#: Words of 64 bits that stand for a name's grams.
WORDS = 4


def _keys(names: DataFrame, ratio: float) -> DataFrame:
    """(side, id, n, k, p, q, bits, lost): keys that a name shares with each name as similar as ``ratio``, with their grams' places.

    A gram is two neighbouring characters.  Of two names' grams at least :func:`shared` agree in order, so a name's grams
    that do not agree are few; with its rarest grams first, as many more as a key has are enough for one that agrees.
    ``bits`` has a bit set for every gram; ``lost`` is how many grams it has above its number of bits.
    """
    grams = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.struct(F.substring("name", i, F.lit(2)).alias("gram"), i.alias("pos")))
    names = names.select("side", "name", F.xxhash64("name").alias("id"), F.length("name").alias("n"))
    each = names.where("n > 1").select("side", "id", "n", F.explode(grams).alias("g")).select("side", "id", "n", "g.gram", "g.pos")
    seen = each.groupBy("gram").agg(F.count("*").alias("seen"))
    bit = F.pmod(F.xxhash64("gram"), F.lit(64 * WORDS))
    words = [F.bit_or(F.when(F.floor(bit / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(WORDS)]
    rare = each.join(seen, "gram").groupBy("side", "id", "n").agg(F.sort_array(F.collect_list(F.struct("seen", "gram", "pos"))).alias("g"), *words)
    bits = F.array(*[F.col(f"w{w}") for w in range(WORDS)])
    rare = rare.withColumns({"bits": bits, "lost": F.col("n") - 1 - sum((F.bit_count(f"w{w}") for w in range(WORDS)), F.lit(0))})
    tables = kinds(ratio)
    # Beyond the table every gram counts.
    many = lambda kind: F.when(F.col("n") <= LONGEST, F.get(F.array(*[F.lit(x) for x in tables[kind]]), F.col("n"))).otherwise(F.col("n") if kind == "long" else 0)
    first = lambda kind: F.array_sort(F.transform(F.slice("g", F.lit(1), many(kind)), lambda x: F.struct(x["pos"].alias("pos"), x["gram"].alias("gram"))))
    key = lambda kind, text, p, q: F.struct(F.xxhash64(F.lit(kind), text).alias("k"), p.alias("p"), q.alias("q"))
    single = lambda kind: F.transform(first(kind), lambda x: key(kind, x["gram"], x["pos"], x["pos"]))
    pairs = lambda g: F.flatten(F.transform(g, lambda x, i: F.transform(F.slice(g, i + 2, F.greatest(F.size(g) - i - 1, F.lit(0))), lambda y: key("two", F.concat(x["gram"], y["gram"]), x["pos"], y["pos"]))))
    two = F.flatten(F.transform(F.array(first("two")), pairs))
    columns = ("side", "id", "n", "k.k", "k.p", "k.q", "bits", "lost")
    by_grams = rare.select("side", "id", "n", "bits", "lost", F.explode(F.concat(single("one"), single("long"), two)).alias("k")).select(*columns)
    none = names.withColumns({"bits": F.array_repeat(F.lit(0).cast("long"), WORDS), "lost": F.lit(1 << 30)})
    letters = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: key("letter", F.substring("name", i, F.lit(1)), i, i))
    by_letters = none.where(many("letter") > 0).withColumn("k", F.explode(letters)).select(*columns)
    same = none.withColumn("k", key("=", F.col("name"), F.lit(1), F.lit(1))).select(*columns)
    return by_grams.unionByName(by_letters).unionByName(same)


#: Longest names that are cut into parts, and most keys of one name for names of one other length.
CUT, MOST = 64, 3000
#: Share of all pairs of names that meet at keys of grams, keys of grams of a name, and letters that a text tells apart.
MET, GRAMS, TELLS = 0.05, 80, 12
#: What a pair that meets at a key by chance costs, in keys: its letters are compared by a bit count, while keys are moved and sorted.
CHANCE = 0.03


def _windows(la: int, lb: int, ratio: float, p: int) -> tuple[set, set] | None:
    """For names of ``la`` characters cut into ``p`` parts and others of ``lb``: ({(part, start, characters, left out)}, the same of windows of the others).

    Of two names' characters m at least agree in order, so exactly da = la - m of the one and db = lb - m of the other may be
    left out: such parts' shares of these add up to da + db, so in one part they are at most its limit, if the limits
    and one each add up to more.  The first and last part lie at the ends; a window for one between is moved by what is left out
    before it.  ``None`` where a part would be nothing.
    """
    m = math.ceil(ratio * (la + lb) / 2 - 1e-9)
    if m > min(la, lb):
        return set(), set()
    if p > la:
        return None
    da, db, cuts = la - m, lb - m, [la * q // p for q in range(p + 1)]
    base, extra = divmod(max(0, da + db - p + 1), p)
    order = [0, p - 1, *range(1, p - 1)]
    limit = {q: base + (rank < extra) for rank, q in enumerate(order)}
    parts, windows = set(), set()
    for q in order:
        at, n = cuts[q], cuts[q + 1] - cuts[q]
        if limit[q] >= n:
            return None
        for i in range(min(limit[q], da) + 1):
            for j in range(min(limit[q] - i, db) + 1):
                size = n - i + j
                # Parts are looked at in order, so those before this one and the last are over their limits.
                spent = range(sum(limit[r] + 1 for r in range(q)), da + db - i - j - limit[p - 1])
                starts = {0} if q == 0 else {lb - size} if q == p - 1 else {at + y - x for x in range(da - i + 1) for y in range(db - j + 1) if x + y in spent}
                found = {(q, start, size, j) for start in starts if 0 <= start <= lb - size}
                if found:
                    windows |= found
                    parts.add((q, at, n, i))
    return parts, windows


def _choices(spans: set) -> int:
    return sum(math.comb(size, out) for _, _, size, out in spans)


def _cut(own: dict[int, int], others: dict[int, int], ratio: float) -> tuple[float, dict[int, int]]:
    """What it costs to find the pairs of names (numbers by length), and into how many parts names of a length are cut; those of
    the lengths that do not occur meet by grams, which is chosen where it costs less."""
    total, plan = 0.0, {}
    for la, na in own.items():
        like = {lb: nb for lb, nb in others.items() if math.ceil(ratio * (la + lb) / 2 - 1e-9) <= min(la, lb)}
        best, parts = GRAMS * (na + sum(like.values())) + MET * na * sum(like.values()), None
        for p in range(2, 9) if like and max(la, *like) <= CUT and MET * na * sum(like.values()) > GRAMS * (na + sum(like.values())) else ():
            made = [_windows(la, lb, ratio, p) for lb in like]
            if any(x is None or max(map(_choices, x)) > MOST for x in made):
                continue
            keys = na * _choices(set().union(*[x[0] for x in made]))
            keys += sum(nb * _choices(x[1]) for nb, x in zip(like.values(), made))
            # Pairs that have a key of some length in common by chance.
            for nb, (a, b) in zip(like.values(), made):
                sizes = {(q, n - i): math.comb(n, i) for q, _, n, i in a}
                keys += CHANCE * sum(na * nb * sizes.get((q, n - j), 0) * math.comb(n, j) / TELLS ** (n - j) for q, _, n, j in b)
            if keys < best:
                best, parts = keys, p
        total += best
        if parts:
            plan[la] = parts
    return total, plan


def _pieces(kept: tuple[int, ...]) -> list[tuple[int, int]]:
    """Runs (first place from 1, length) of places from 0."""
    out = []
    for x in kept:
        if out and out[-1][0] + out[-1][1] == x + 1:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((x + 1, 1))
    return out


#: Groups of letters whose numbers :func:`_letters` tells, up to three each.
GROUPS = 21


def _letters(name: str) -> Column:
    """The numbers of a name's letters by group, three bits each, of which as many are set: two names differ in at most as many
    bits as letters are left out or put in."""
    def bits(g: int) -> Column:
        own = LETTERS[g::GROUPS]
        n = F.length(name) - F.length(F.translate(name, own, ""))
        return F.when(n >= 3, F.lit(7 << 3 * g)).when(n == 2, F.lit(3 << 3 * g)).when(n == 1, F.lit(1 << 3 * g)).otherwise(F.lit(0)).cast("long")

    return reduce(Column.bitwiseOR, map(bits, range(GROUPS)))


def _by_parts(a: DataFrame, b: DataFrame, plan: dict[int, int], others: dict[int, int], ratio: float) -> DataFrame:
    """(a, b): pairs of names, those of ``a`` cut into parts by ``plan``, that share what is left of a part and a window.

    What is left out of which places is a small table by length, so that keys are made of it by a join.  Of a name only a hash and
    the numbers of its letters travel with its keys, and few pairs are left to be looked at whole.
    """
    of_a, of_b = set(), set()
    left = lambda start, size, out: ([x for x in range(start, start + size) if x not in gone] for gone in map(set, combinations(range(start, start + size), out)))
    for la, p in plan.items():
        for lb in others:
            parts, windows = _windows(la, lb, ratio, p)
            of_a |= {(la, la * 8 + q, tuple(kept)) for q, start, size, out in parts for kept in left(start, size, out)}
            of_b |= {(lb, la * 8 + q, tuple(kept)) for q, start, size, out in windows for kept in left(start, size, out)}
    runs = max((len(_pieces(kept)) for _, _, kept in of_a | of_b), default=1)
    many = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def keyed(names: DataFrame, specs: set, name: str) -> DataFrame:
        rows = [(n, tag, *[x for run in (_pieces(kept) + [(1, 0)] * runs)[:runs] for x in run]) for n, tag, kept in sorted(specs)]
        table = names.sparkSession.createDataFrame(rows, "n int, tag int, " + ", ".join(f"p{r} int, l{r} int" for r in range(runs)))
        text = F.concat(*[F.substring(name, F.col(f"p{r}"), F.col(f"l{r}")) for r in range(runs)])
        # Dealt anew, as few names make many keys.
        names = names.repartition(many, name).withColumns({"n": F.length(name), f"id_{name}": F.xxhash64(name), f"has_{name}": _letters(name)})
        return names.join(F.broadcast(table), "n").select(f"id_{name}", f"has_{name}", F.xxhash64("tag", text).alias("k"))

    # What does not agree is left out or put in.
    most = max((la + lb - 2 * math.ceil(ratio * (la + lb) / 2 - 1e-9) for la in plan for lb in others), default=0)
    j = keyed(a, of_a, "a").join(keyed(b, of_b, "b"), "k").where(F.bit_count(F.col("has_a").bitwiseXOR(F.col("has_b"))) <= most)
    j = stored(j.select("id_a", "id_b").distinct(), "names")
    own = lambda names, name: names.select(F.xxhash64(name).alias(f"id_{name}"), name)
    j = j.join(own(a, "a"), "id_a").join(own(b, "b"), "id_b")
    both = F.length("a") + F.length("b")
    return j.where(F.levenshtein("a", "b") <= both - 2 * F.ceil(F.lit(ratio) * both / 2 - 1e-9)).select("a", "b")


def _ratio_pairs(names: DataFrame, others: DataFrame, at_least: float) -> DataFrame:
    """Pairs (name, other, pos, ratio) of distinct names whose ratio may reach ``at_least`` (0.8 or more).

    Names of lengths of which there are many are cut into parts, one of which has few differences (:func:`_by_parts`), so that
    keys grow with the names; the others meet by grams (:func:`_by_grams`).  Pairs whose letters allow the ratio are
    compared.
    """
    from ..functions.fuzzy import sequence_ratio

    a, b = (stored(df.select(F.col(c).alias("name")).distinct().where("name <> ''"), "names") for df, c in ((names, "name"), (others, "other")))
    # Names beyond CUT are one length.
    lengths = [{r["n"]: r["c"] for r in x.groupBy(F.least(F.length("name"), F.lit(CUT + 1)).alias("n")).agg(F.count("*").alias("c")).collect()} for x in (a, b)]
    (cost, plan), (turned_cost, turned) = _cut(*lengths, at_least), _cut(*lengths[::-1], at_least)
    one, two, one_lengths, two_lengths, swapped = (a, b, *lengths, False) if cost <= turned_cost else (b, a, *lengths[::-1], True)
    plan = turned if swapped else plan
    cut = F.length("name").isin(list(plan)) if plan else F.lit(False)
    found = []
    if plan:
        pairs = _by_parts(one.where(cut).withColumnRenamed("name", "a"), two.withColumnRenamed("name", "b"), plan, two_lengths, at_least)
        found.append(pairs.select(F.col("b" if swapped else "a").alias("name"), F.col("a" if swapped else "b").alias("other")))
    if set(one_lengths) - set(plan):
        rest = one.where(~cut)
        # Only names that are not too short or long for one of the rest.
        at = sorted(n for n in two_lengths if n > CUT or any(m > CUT or math.ceil(at_least * (n + m) / 2 - 1e-9) <= min(n, m) for m in set(one_lengths) - set(plan)))
        met = two.where(F.least(F.length("name"), F.lit(CUT + 1)).isin(at)) if at else two.limit(0)
        found.append(_by_grams(*((met, rest) if swapped else (rest, met)), at_least))
    j = reduce(DataFrame.unionByName, found) if found else a.crossJoin(b.withColumnRenamed("name", "other")).limit(0)
    j = j.where((F.col("name") == F.col("other")) | (ratio_bound("name", "other") >= at_least))
    many = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = j.repartition(many, "name", "other").withColumn("ratio", sequence_ratio("name", "other")).where(F.col("ratio") >= at_least)
    return j.join(others.select("other", "pos"), "other")


def _by_grams(names: DataFrame, others: DataFrame, at_least: float) -> DataFrame:
    """(name, other): pairs of names that share a key with places that the ratio allows, whose lengths and grams allow it."""
    both = names.select(F.lit("a").alias("side"), "name").union(others.select(F.lit("b"), "name"))
    keys = stored(_keys(both, at_least), "names")
    a = keys.where("side = 'a'").select(F.col("id").alias("a"), F.col("n").alias("la"), "k", F.col("p").alias("ap"), F.col("q").alias("aq"), F.col("bits").alias("a_bits"), F.col("lost").alias("a_lost"))
    b = keys.where("side = 'b'").select(F.col("id").alias("b"), F.col("n").alias("lb"), "k", F.col("p").alias("bp"), F.col("q").alias("bq"), F.col("bits").alias("b_bits"), F.col("lost").alias("b_lost"))
    t = F.col("la") + F.col("lb")
    m = F.ceil(F.lit(at_least) * t / 2 - 1e-9)
    # Before a matched character stand at most la - m unmatched ones of the one name and lb - m of the other.
    moved = lambda x, y: (F.col(y) - F.col(x)).between(-(F.col("la") - m), F.col("lb") - m)
    common = sum((F.bit_count(F.col("a_bits")[w].bitwiseAND(F.col("b_bits")[w])) for w in range(WORDS)), F.lit(0))
    # Grams that agree have their bits in common; each has its own, but for those that a name has lost.
    enough = common >= m - (t - 2 * m + 1) - F.least("a_lost", "b_lost")
    j = a.join(b, "k").where((m <= F.least("la", "lb")) & moved("ap", "bp") & moved("aq", "bq") & enough).select("a", "b").distinct()
    own = lambda side, name: both.where(F.col("side") == side).select(F.xxhash64("name").alias(side), F.col("name").alias(name))
    return j.join(own("a", "name"), "a").join(own("b", "other"), "b").select("name", "other")


def vendor_set(*tables: DataFrame) -> DataFrame:
    """The distinct (name, gstin) of invoices, ledger and transactions; each has ``name`` and may have ``gstin``."""
    parts = [t.select(F.trim("name").alias("name"), F.coalesce(F.col("gstin") if "gstin" in t.columns else F.lit(None), F.lit("")).alias("gstin")) for t in tables]
    return reduce(DataFrame.unionByName, parts).where("name <> ''").distinct()


def blacklisted(vendors: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Vendors (vendor_name, vendor_gst) on a blacklist (pos, name, gstin): by GSTIN, or a name ratio above 0.9."""
    v = vendors.select(F.lower(F.trim("vendor_name")).alias("name"), "vendor_name", "vendor_gst").distinct()
    listed = blacklist.select(F.col("pos"), F.lower(F.trim("name")).alias("other"), F.col("gstin"))
    by_name = _ratio_pairs(v, listed.select("pos", "other").where("other <> ''"), 0.9).where("ratio > 0.9").select("name", "pos")
    by_name = v.join(by_name, "name").select("vendor_name", "vendor_gst", "pos")
    by_gst = v.join(listed.where("gstin <> ''").select("gstin", "pos"), F.col("vendor_gst") == F.col("gstin")).select("vendor_name", "vendor_gst", "pos")
    first = by_name.unionByName(by_gst).groupBy("vendor_name", "vendor_gst").agg(F.min("pos").alias("pos"))
    return findings(first, "vendor_blacklist", HIGH, 0.9, F.col("vendor_name"), F.lit(None), source="policy", entry=F.col("pos"))


def related(vendors: DataFrame, employees: DataFrame) -> DataFrame:
    """Each vendor's most similar employee, above 0.8; ties to the first employee (pos, name)."""
    return _related(_named_like(vendors, employees, 0.8))


def _named_like(vendors: DataFrame, employees: DataFrame, at_least: float) -> DataFrame:
    return _ratio_pairs(vendors.select(F.lower(F.trim("vendor_name")).alias("name")), employees.select("pos", F.lower(F.trim("name")).alias("other")), at_least)


def _related(pairs: DataFrame) -> DataFrame:
    pairs = pairs.where("ratio > 0.8")
    best = pairs.groupBy("name").agg(F.max(F.struct("ratio", (-F.col("pos")).alias("pos"), "other")).alias("b"))
    return findings(best, "related_party_vendor", HIGH, 0.9, F.col("name"), F.lit(None), source="policy", employee=F.col("b.other"), ratio=F.round("b.ratio", 4))


def like_employees(vendors: DataFrame, employees: DataFrame) -> DataFrame:
    """Vendors named almost, but not exactly, like an employee (0.88 or more); the first such employee."""
    return _like_employees(_named_like(vendors, employees, 0.88))


def _like_employees(pairs: DataFrame) -> DataFrame:
    pairs = pairs.where("ratio >= 0.88 and name <> other")
    first = pairs.groupBy("name").agg(F.min(F.struct("pos", "ratio", "other")).alias("b"))
    return findings(first, "vendor_name_similar_to_employee", HIGH, F.round(0.75 + (F.col("b.ratio") - 0.88), 6), F.col("name"), F.lit(None), employee=F.col("b.other"))


def named_like_employees(vendors: DataFrame, employees: DataFrame) -> DataFrame:
    """R24 and K37 together: names are compared once for both."""
    pairs = stored(_named_like(vendors, employees, 0.8), "alike")
    return _related(pairs).unionByName(_like_employees(pairs))
