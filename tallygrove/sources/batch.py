"""Folders of CSV files in one distributed read, each file on its own.

Files are read as bytes, so that each is decoded by itself: bytes that are valid UTF-8 (with or without a mark) are that, all
others are Windows-1252 where every byte stands for a character there, or else Latin-1.  A file's header tells what it is
(:func:`tables.kind_of_headers`), whose bank it comes from, and which cells are which canonical column.  A file that cannot be
read (of a type or size that is not accepted, empty, without a header, or with quotes that don't close) is quarantined: it
yields one row with the reason, and stops no other file.

A file of up to ``WHOLE`` bytes is read within one task, a larger one by lines in as many tasks as Spark splits it into
(:func:`_in_pieces`); ``most`` may bound the size.  Rows keep their place in the file as ``seq``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..graphs import stored
from . import tables as X

#: Largest file that one task reads, and the suffixes that are read.
WHOLE, SUFFIXES = 10 * 1024 * 1024, ("csv", "txt")
SCANNED = "path string, encoding string, kind string, bank_name string, seq long, cells map<string,string>, error string"
# Encodings that are tried, in order; a file in a later one is not valid in those before.
ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")


def decoded(content: bytes) -> tuple[str, str]:
    """(text, encoding) by the first encoding in which all bytes are valid."""
    for e in ENCODINGS:
        try:
            return content.decode(e), e.replace("-sig", "")
        except UnicodeDecodeError:
            pass
    raise ValueError("no encoding")  # not reached: every byte is valid Latin-1


def columns(name: str, head: list[str]) -> tuple[str, str, dict[str, int]]:
    """(kind, bank, places of canonical columns) of a file by its name and its first row; ValueError where that is no header."""
    names = [c.strip() for c in head]
    if sum(bool(n) for n in names) < 2:
        raise ValueError("no header")
    kind = X.kind_of_headers(name, names)
    aliases = {"expense": X.EXPENSE, "invoice": X.INVOICE_ROWS}.get(kind, X.STATEMENT)
    return kind, X.bank_of_headers(names), {c: names.index(h) for c, found in aliases.items() if (h := X.header(names, found)) is not None}


def parsed(name: str, content: bytes) -> tuple[str, str, str, list[dict[str, str]]]:
    """(encoding, kind, bank, rows as canonical columns) of one file; ValueError or csv.Error where it can't be read."""
    import csv
    import io

    text, encoding = decoded(content)
    lines = csv.reader(io.StringIO(text, newline=""), strict=True)
    head = next((x for x in lines if any(c.strip() for c in x)), None)
    if head is None:
        raise ValueError("empty file")
    kind, bank, places = columns(name, head)
    rows = [{c: r[i] for c, i in places.items() if i < len(r)} for r in lines if any(c.strip() for c in r)]
    return encoding, kind, bank, rows


def quoted(line: str, inside: bool) -> bool:
    """Whether a line ends within quotes, by whether it begins so; a quote opens a cell only at its start."""
    at, n = 0, len(line)
    while True:
        if not inside:
            # The next cell that begins with a quote, from here on.
            if line.startswith('"', at):
                at += 1
            else:
                found = [x for x in (line.find(',"', at), line.find('\r"', at)) if x >= 0]
                if not found:
                    return False
                at = min(found) + 2
        inside = True
        while inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
            else:
                inside = False
                at += 1
        if at >= n:
            return False
        # Past the cell's end; what follows a quote but a comma is an error that the reading finds.
        if line[at] in ",\r":
            at += 1


_LINES = "url string, block long, line long, value binary, s0 boolean, s1 boolean, e0 boolean, e1 boolean, utf8 boolean, cp1252 boolean"


def _scanned_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines numbered in their block, with whether they begin (s) and end (e) within quotes, by whether the block begins so."""
    at, n, s0, s1 = None, 0, False, True
    for b in batches:
        out = []
        for url, block, value in zip(b["url"], b["block"], b["value"]):
            if (url, block) != at:
                at, n, s0, s1 = (url, block), 0, False, True
            e0, e1 = s0, s1
            if b'"' in value:
                text = value.decode("latin-1")
                e0, e1 = quoted(text, s0), quoted(text, s1)
            valid = [True, True] if value.isascii() else [_valid(value, e) for e in ("utf-8", "cp1252")]
            out.append((url, block, n, value, s0, s1, e0, e1, *valid))
            n, s0, s1 = n + 1, e0, e1
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in _LINES.split(", ")])


def _valid(value: bytes, encoding: str) -> bool:
    try:
        value.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells of the rows that begin in a block, from its lines in order; rows that are blank are left out."""
    import csv
    import io

    def text(rows) -> Iterator[str]:
        for *_, encoding, value in rows:
            line = value.decode(encoding) + "\n"
            # As a file would be read, with single carriage returns as ends of lines.
            yield from io.StringIO(line, newline="") if "\r" in line else (line,)

    names = ["url", "owner", "i", "row", "error"]
    every = (r for b in batches for r in zip(b["url"], b["owner"], b["encoding"], b["value"]))
    for (url, owner), rows in groupby(every, key=lambda r: r[:2]):
        part, n = [], 0
        try:
            for r in csv.reader(text(rows), strict=True):
                if any(c.strip() for c in r):
                    part.append((url, owner, n, r, None))
                    n += 1
                    if len(part) == 10_000:
                        yield pd.DataFrame(part, columns=names)
                        part = []
        except csv.Error as e:
            part.append((url, owner, n, None, str(e)))
        if part:
            yield pd.DataFrame(part, columns=names)


def _in_pieces(spark: SparkSession, folder: str, files: DataFrame, whole: int) -> DataFrame:
    """Rows of the large ``files`` (path, url), each read in the blocks that Spark splits it into.

    A block's lines are scanned twice at once, as if it began within quotes and as if not; a fold over the blocks of a
    file, few numbers each, tells which holds.  A row belongs to the block in which it begins, to which its other lines
    go.  The encoding is that in which all lines of a file are valid.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(folder).where(F.col("_metadata.file_size") > whole)
    lines = lines.select(F.col("_metadata.file_path").alias("url"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    lines = stored(lines.mapInPandas(_scanned_lines, _LINES).join(F.broadcast(files.select("url")), "url", "left_semi"), "lines")
    last = [F.max_by(e, "line").alias(e) for e in ("e0", "e1")]
    blocks = lines.groupBy("url", "block").agg(*last, F.min("s0").alias("s0"), F.min("s1").alias("s1"), F.min("utf8").alias("utf8"), F.min("cp1252").alias("cp1252"))
    chain = F.sort_array(F.collect_list(F.struct("block", "e0", "e1", "s0", "s1")))
    g = blocks.groupBy("url").agg(chain.alias("b"), F.when(F.min("utf8"), "utf-8").when(F.min("cp1252"), "cp1252").otherwise("latin-1").alias("encoding"))
    states = F.aggregate("b", F.array(F.lit(False)), lambda acc, x: F.array_append(acc, F.when(F.element_at(acc, -1), x["e1"]).otherwise(x["e0"])))
    g = g.select("url", "encoding", F.posexplode("b").alias("at", "x"), states.alias("states"))
    began = F.get("states", F.col("at"))
    g = g.select("url", "encoding", "x.block", began.alias("began"), (~F.when(began, F.col("x.s1")).otherwise(F.col("x.s0"))).alias("own"))
    before = Window.partitionBy("url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("before", F.last(F.when(F.col("own"), F.col("block")), ignorenulls=True).over(before))
    told = lines.join(F.broadcast(g), ["url", "block"])
    # Lines before the first row that begins in a block go to the block before.
    begins = ~F.when(F.col("began"), F.col("s1")).otherwise(F.col("s0"))
    first = F.broadcast(told.where(begins).groupBy("url", "block").agg(F.min("line").alias("first")))
    told = told.join(first, ["url", "block"], "left").withColumn("owner", F.when(F.col("line") >= F.col("first"), F.col("block")).otherwise(F.col("before")))
    told = told.select("url", "owner", "block", "line", "encoding", "value").repartition("url", "owner").sortWithinPartitions("url", "owner", "block", "line")
    rows = stored(told.select("url", "owner", "encoding", "value").mapInPandas(_records, "url string, owner long, i long, row array<string>, error string"), "rows")
    one = rows.groupBy("url").agg(F.min_by("row", F.when(F.col("row").isNotNull(), F.struct("owner", "i"))).alias("head"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("owner"))).alias("error"))
    heads = files.join(one, "url", "left").join(g.select("url", "encoding").distinct(), "url", "left")

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, url, encoding, head, error in zip(b["path"], b["url"], b["encoding"], b["head"], b["error"]):
                told = (None, None, None)
                try:
                    if not error and head is None:
                        raise ValueError("empty file")
                    told = columns(path.rsplit("/", 1)[-1], list(head)) if head is not None else told
                except ValueError as e:
                    error = str(e)
                out.append((path, url, encoding, *told, error))
            yield pd.DataFrame(out, columns=["path", "url", "encoding", "kind", "bank_name", "places", "error"])

    heads = stored(heads.select("path", "url", "encoding", "head", "error").mapInPandas(headed, "path string, url string, encoding string, kind string, bank_name string, places map<string,int>, error string"), "heads")
    counts = rows.where("error IS NULL").groupBy("url", "owner").agg(F.count("*").alias("n"))
    counts = counts.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("url").orderBy("owner").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    good = rows.where("error IS NULL").join(F.broadcast(heads.where("error IS NULL").drop("error")), "url").join(F.broadcast(counts.select("url", "owner", "offset")), ["url", "owner"])
    good = good.withColumn("seq", F.col("offset") + F.col("i") - 1).where("seq >= 0")
    cells = F.map_from_entries(F.transform(F.filter(F.map_entries("places"), lambda e: e["value"] < F.size("row")), lambda e: F.struct(e["key"], F.get(F.col("row"), e["value"]))))
    good = good.select("path", "encoding", "kind", "bank_name", "seq", cells.alias("cells"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(heads.where("error IS NOT NULL").select("path", "error"), allowMissingColumns=True)


def scan(spark: SparkSession, folder: str, most: int | None = None, suffixes: tuple[str, ...] = SUFFIXES, whole: int = WHOLE) -> DataFrame:
    """A row for each row of each file below ``folder``, and one with ``error`` for each file that can't be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    refused = F.when(~suffix.isin(*suffixes), "type not accepted").when(F.col("length") > F.lit(most), "too large")
    taken, left = files.where(refused.isNull() & (F.col("length") <= whole)).select("path", "content"), files.where(refused.isNotNull()).select("path", refused.alias("error"))
    large = files.where(refused.isNull() & (F.col("length") > whole)).select("path", F.col("_metadata.file_path").alias("url"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    encoding, kind, bank, rows = parsed(path.rsplit("/", 1)[-1], content)
                    for lo in range(0, max(1, len(rows)), 10_000):
                        part = rows[lo : lo + 10_000]
                        yield pd.DataFrame({"path": path, "encoding": encoding, "kind": kind, "bank_name": bank, "seq": range(lo, lo + len(part)), "cells": part, "error": None}, index=range(len(part)))
                except (ValueError, csv.Error) as e:
                    yield pd.DataFrame([[path, None, None, None, None, None, str(e)]], columns=[c.split(" ")[0] for c in SCANNED.split(", ")])

    good = taken.mapInPandas(run, SCANNED)
    out = good.unionByName(left, allowMissingColumns=True)
    return out.unionByName(_in_pieces(spark, folder, large, whole)) if large.take(1) else out


def _document(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def statements(rows: DataFrame, document: Column | None = None) -> DataFrame:
    """Canonical statement rows of the bank statements among scanned files."""
    cell = [F.try_element_at("cells", F.lit(c)).alias(c) for c in X.STATEMENT]
    document = _document(F.col("path")) if document is None else document
    return X.statement(rows.where("kind = 'bank_statement' AND error IS NULL").select("seq", document.alias("document_name"), "bank_name", *cell), bank=F.col("bank_name"))


def claims(rows: DataFrame, document: Column | None = None) -> DataFrame:
    """Canonical expense claims of the expense sheets among scanned files, with ids and categories filled in."""
    cell = [F.try_element_at("cells", F.lit(c)).alias(c) for c in X.EXPENSE]
    document = _document(F.col("path")) if document is None else document
    return X.expenses(rows.where("kind = 'expense' AND error IS NULL").select("seq", document.alias("document_name"), *cell))


def load_batch(spark: SparkSession, folder: str, **limits) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantined): what could be read of a folder's files, and (path, error) of those that could not; read once."""
    got = stored(scan(spark, folder, **limits), "batch")
    return got.where("error IS NULL"), got.where("error IS NOT NULL").select("path", "error")
