"""Alignment of two tokenizers' tokens by byte offsets, with counts of aligned id pairs over the corpus.

Inside a task everything is an Arrow table: a slice's token lists are flattened with their parent indices, token lengths
are summed up text by text (one running sum over the slice, less the sum before each text), the two sides' tables of
(document, end) are joined by Acero's hash join, and the aligned id pairs are counted by ``Table.group_by``.  A task adds up
its slices' counts and gives them out once; Spark merges the tasks' counts, and joins them back to the documents' pairs.

A text's bytes are a space and the text in UTF-8, as the SentencePiece model adds a space.  No token is empty, so at most one
token of either side ends at a byte: places where both end cut the text into groups, and each is one link.

Defined results: a text that is null or empty, or whose tokens' bytes on either side differ from the text's (such as one
with U+2581, which the model reads as a space), has no tokens: zeros and ''.  Equal rows are rows of their own.  Strings of
special tokens are plain text.  Other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table

#: Pair counts up to which they are broadcast (about 24 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000
#: Bits of an id of the second tokenizer within a pair.
SHIFT = 20
COLUMNS = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>, pair long, count long"


class Side:
    """One tokenizer: ``encode(texts)`` as lists of ids, and each id's bytes."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.table = None

    def joined(self, ids: list[np.ndarray]):
        """Each text's tokens' bytes: taken one after another, they stand joined in one buffer."""
        import pyarrow as pa

        if self.table is None:
            self.table = pa.array(self.pieces, pa.large_binary())
        _, at, data = self.table.take(pa.array(np.concatenate([np.empty(0, np.int32), *ids]))).buffers()
        cuts = np.frombuffer(at, np.int64)[np.cumsum([0, *map(len, ids)])] if at else np.zeros(len(ids) + 1, np.int64)
        return [data[lo:hi] if hi > lo else b"" for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


class ByteBpe(Side):
    """A byte-level BPE vocabulary file, of which the ranked file's tokens are the same ids and bytes."""

    def __init__(self, name: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name)) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
        pieces = [b""] * (max(ranks.values()) + 1)
        for p, i in ranks.items():
            pieces[i] = p
        super().__init__(pieces)
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encoding.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int32) for t in texts]


class PieceBpe(Side):
    """A SentencePiece model, which adds a space before the text."""

    def __init__(self, name: str):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        super().__init__([self._bytes(i) for i in range(self.model.vocab_size())])

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self.model.is_control(i) or self.model.is_unknown(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int32) for x in self.model.encode(texts, num_threads=1)]


def sides(a: str = "byte_bpe_50k.tiktoken", b: str = "piece_bpe_32k.model") -> tuple[Side, Side]:
    """The two tokenizers, by the names of their public vocabulary files."""
    return ByteBpe(a), PieceBpe(b)


def _flat(side: Side, ids: list[np.ndarray]):
    """(doc, end, pos, id) of all tokens as an Arrow table; ``pos`` counts the slice's tokens of this side."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
    tokens, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    lengths = pa.array(side.lengths).take(tokens)
    total = pc.cumulative_sum(lengths)
    # What the running sum was before each text: segments start anew.
    sums = np.concatenate([[0], total.to_numpy()])
    before = pa.array(sums[lists.offsets.to_numpy()[:-1]])
    end = pc.subtract(total, before.take(doc))
    return pa.table({"doc": pc.cast(doc, pa.int64()), "end": end, "pos": pa.array(np.arange(len(tokens))), "id": tokens})


class Aligner:
    """Aligns the texts of slices; keeps its decimal texts of ids."""

    def __init__(self, a: Side, b: Side):
        import pyarrow as pa

        self.a, self.b = a, b
        self.size = max(len(a.pieces), len(b.pieces))
        # Each id's decimal text before a comma, a bar, a semicolon, and the end.
        self.decimal = pa.array([f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(self.size)], pa.large_string())

    def usable(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids on both sides; none where the bytes differ."""
        plain = [t or "" for t in texts]
        a, b = self.a.encode(plain), self.b.encode(plain)
        none = np.empty(0, np.int32)
        for i, (t, x, y) in enumerate(zip(plain, self.a.joined(a), self.b.joined(b))):
            want = b" " + t.encode()
            if not t or x != want or y != want:
                a[i] = b[i] = none
        return a, b

    def slice(self, texts: list[str | None]):
        """(n_a, n_b, n_groups, groups, links): counts and group texts by text, links as a table (doc, pair)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        a_ids, b_ids = self.usable(texts)
        a, b = _flat(self.a, a_ids), _flat(self.b, b_ids)
        links = a.join(b, ["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False).sort_by("pos")
        pair = pc.bit_wise_or(pc.shift_left(pc.cast(links["id"], pa.int64()), SHIFT), pc.cast(links["id_b"], pa.int64()))
        n_groups = np.bincount(links["doc"].to_numpy(), minlength=len(texts))
        return np.array([len(x) for x in a_ids]), np.array([len(x) for x in b_ids]), n_groups, self._groups(a, b, links, len(texts)), pa.table({"doc": links["doc"], "pair": pair})

    def _groups(self, a, b, links, n: int) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text: a group's tokens of the first side stand before those of the second."""
        import pyarrow as pa

        n_a, n_b = a.num_rows, b.num_rows
        last_a, last_b = links["pos"].to_numpy(), links["pos_b"].to_numpy()
        out = np.empty(n_a + n_b, np.int64)
        for count, own, other, ids, mark in ((n_a, last_a, np.concatenate([[-1], last_b])[:-1], a["id"], 1), (n_b, last_b, last_a, b["id"], 2)):
            group = np.searchsorted(own, np.arange(count))  # both sides' tokens end with a group, as both cover the text
            at = np.arange(count) + (other[group] + 1 if count else 0)
            ends = np.zeros(count, np.int64)
            ends[own] = mark
            out[at] = ends * self.size + ids.to_numpy()
        doc = np.concatenate([a["doc"].to_numpy(), b["doc"].to_numpy()])
        sizes = np.bincount(doc, minlength=n)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        final = offsets[1:][sizes > 0] - 1
        out[final] += self.size  # the last group of a text ends without a mark
        # Taken one after another, the decimal texts already stand joined in one buffer.
        taken = self.decimal.take(pa.array(out))
        _, at, data = taken.buffers()
        cuts = np.frombuffer(at, np.int64, len(out) + 1)[offsets]
        return [data[lo:hi].to_pybytes() for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist())] if len(out) else [b""] * n


def _counted(parts: list):
    """Tables (pair, count) added up."""
    import pyarrow as pa

    return pa.concat_tables(parts).group_by("pair", use_threads=False).aggregate([("count", "sum")]).rename_columns(["pair", "count"])


def aligned(docs: DataFrame, a: str = "byte_bpe_50k.tiktoken", b: str = "piece_bpe_32k.model", text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Documents (row, doc_id, n_a, n_b, n_groups, groups_sha256, pairs, times) and pairs (pair, count, best), both stored.

    ``pairs`` are a document's linked id pairs (the first id shifted left by SHIFT bits, or the second), ``times`` how often.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        aligner, row, counts = Aligner(*sides(a, b)), TaskContext.get().partitionId() << 40, []
        names = [c.strip().split(" ")[0] for c in COLUMNS.split(",")]
        kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64()]

        def given(n: int, **have):
            return pa.RecordBatch.from_arrays([have.get(c, None) if c in have else pa.nulls(n, k) for c, k in zip(names, kinds)], names=names)

        for batch in batches:
            for s in slices(pa.Table.from_batches([batch]).to_batches(), 500):
                for lo, hi in _small(s.column(1)):
                    part = s.slice(lo, hi - lo)
                    n_a, n_b, n_groups, groups, links = aligner.slice(part.column(1).to_pylist())
                    own = links.group_by(["doc", "pair"], use_threads=False).aggregate([("pair", "count")]).sort_by([("doc", "ascending"), ("pair", "ascending")])
                    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(own["doc"].to_numpy(), minlength=hi - lo))]), pa.int32())
                    pairs, times = own["pair"].combine_chunks(), pc.cast(own["pair_count"].combine_chunks(), pa.int32())
                    digest = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                    counts = [_counted([*counts, own.select(["pair"]).append_column("count", own["pair_count"])])]
                    yield given(hi - lo, row=pa.array(np.arange(row, row + hi - lo)), doc_id=part.column(0), n_a=pa.array(n_a), n_b=pa.array(n_b), n_groups=pa.array(n_groups), groups_sha256=pa.array(digest, pa.string()), pairs=pa.ListArray.from_arrays(offsets, pairs), times=pa.ListArray.from_arrays(offsets, times))
                    row += hi - lo
        for c in counts:
            for x in c.combine_chunks().to_batches(max_chunksize=10_000):
                yield given(x.num_rows, pair=x.column(0), count=x.column(1))

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    both = stored(rows.mapInArrow(run, COLUMNS), "alignment")
    counts = both.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("count").alias("count"))
    counts = stored(counts, "alignment")
    highest = counts.groupBy(second("pair").alias("b_id")).agg(F.max("count").alias("highest"))
    # A group for each id of the second vocabulary: as many rows as that has ids.
    counts = counts.join(F.broadcast(highest), second("pair") == F.col("b_id")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    return both.where("row IS NOT NULL").drop("pair", "count"), counts


def _small(texts, most: int = 1_000_000):
    """Ranges of rows of about ``most`` bytes of text, or one longer text."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if total + n > most and i > lo:
            yield lo, i
            lo, total = i, 0
        total += n
    if len(sizes):
        yield lo, len(sizes)


def second(pair: str) -> Column:
    """The second tokenizer's id of a pair."""
    return F.col(pair).bitwiseAND(F.lit((1 << SHIFT) - 1))


def scored(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``docs`` of :func:`aligned` with n_links, n_best and count_sum.

    The documents' pairs meet the corpus's counts by a join; the sums are gathered within a partition before they are
    shuffled.  Counts are broadcast while there are at most BROADCAST_PAIRS.
    """
    few = counts.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    keys = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    each = docs.select(*keys, F.explode_outer(F.arrays_zip("pairs", "times")).alias("p")).select(*keys, F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
    each = each.join(F.broadcast(counts) if few else counts, "pair", "left")
    best = F.sum(F.when(F.col("best"), F.col("times")))
    sums = {"n_links": F.sum("times"), "n_best": best, "count_sum": F.sum(F.col("times") * F.col("count"))}
    return each.groupBy(*keys).agg(*[F.coalesce(x, F.lit(0)).cast("long").alias(c) for c, x in sums.items()]).drop("row")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(*aligned(table(spark, sf_dir, "documents")))


QUERIES = {"op12_alignment": op12_alignment}
#: Tokens cannot be said in SQL; the tests compare with a brute-force version.
ORACLES: dict[str, str] = {}
