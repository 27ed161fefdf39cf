"""SentencePiece encoding and decoding by a max-plus parallel scan.

A segmentation is a path through the lattice of vocabulary pieces over the text, scored by ``link(previous, piece)``:

* ``unigram``: the piece's score, so the best path is the most likely segmentation;
* ``bpe``: 0 where the two pieces, taken alone, would be encoded as just these two, else minus infinity.  Exactly one
  path of a text has only such neighbours, the one that merging by rank gives, so the scan yields the merges' result.

A text of more than ``CHUNK`` characters is split into chunks.  A boundary state is a piece that ends at or crosses the
boundary, with the characters it reaches beyond.  Each chunk yields its matrix of best scores from entry to exit
states (max-plus); matrices combine associatively, first within blocks of chunks, then over a document's blocks; the
states on the best path come back down, and every chunk is then backtraced on its own.  No piece spans the start of a
word, so shorter texts, and the inner words of a chunk, are encoded word by word from a bounded memory.

Defined results: a null text has null ids and decodes to null; an empty text has no ids; characters outside the
vocabulary become byte pieces, or the unknown id where the vocabulary has none; U+2581 in a text is the same as a space
(as in the original library), so it decodes to a space, and everything else decodes to itself; repeated rows are
encoded one by one; other columns pass through unchanged; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import re
from array import array

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32_768
#: Chunks whose matrices are combined in one task.
BLOCK = 256
SPACE = "▁"
UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words and pairs that a task remembers before it starts anew.
MEMORY = 150_000
#: Words merged at once, and the length from which a word is merged on its own.
AT_ONCE, LONG = 20_000, 48
START = ("", 0)
NEVER = float("-inf")
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces of a model file with their ids and scores.  It is read on the driver and sent to the tasks (some MB at most)."""

    def __init__(self, path: str = MODEL, mode: str | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model.ParseFromString(sp.serialized_model_proto())
        if model.normalizer_spec.name != "identity" or not model.normalizer_spec.add_dummy_prefix or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave the text as it is are supported")
        kinds = model.SentencePiece
        self.mode = mode or {1: "unigram", 2: "bpe"}[model.trainer_spec.model_type]
        self.names = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.scores = {p: model.pieces[i].score for p, i in self.ids.items()}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.longest = max(map(len, self.ids))
        if self.mode == "bpe":
            self.known, self.base, self.symbols, self.keys, self.joins, self.ranks, self.lists, self.offsets = self._tables()
        self.lowest = min(self.scores.values()) - UNKNOWN_PENALTY
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("only vocabularies without pieces across the start of a word are supported")

    def _tables(self):
        """For merging many words at once: number of symbols known, bound of symbols, symbols of characters, sorted pairs of
        symbols with what they join to, ranks by score, and each symbol's ids.  Symbols are the pieces, the characters in them,
        and then all other characters."""
        names = sorted(self.ids, key=self.scores.get, reverse=True)
        number = {p: i for i, p in enumerate(names)}
        for p in names:  # single characters that only occur inside pieces
            for c in p:
                number.setdefault(c, len(number))
        known = len(number)
        base = known + 0x110000
        pairs = [(number[p[:i]] * base + number[p[i:]], number[p]) for p in names for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        keys, joins = (np.array(x, np.int64) for x in zip(*sorted(pairs)))
        # Pieces of one score rank alike, so that the leftmost of them is merged first.
        scores = np.array([self.scores[p] for p in names])
        ranks = np.searchsorted(np.unique(-scores), -scores).astype(np.int32)
        lists = [self.id_list(p) for p in number]
        offsets = np.cumsum([0, *map(len, lists)])
        return known, base, {ord(c): i for c, i in number.items() if len(c) == 1}, keys, joins.astype(np.int32), ranks, np.array([i for x in lists for i in x], np.int32), offsets

    @classmethod
    def of(cls, fields: dict) -> Vocabulary:
        """From the fields of another: tasks get plain values, not objects of this module."""
        out = cls.__new__(cls)
        vars(out).update(fields)
        return out

    def id_list(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]


class Encoder:
    """Segments texts under one vocabulary, remembering words and pairs in bounded memory."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.words, self.bare, self.pairs = vocabulary, {}, {}, {}
        if vocabulary.mode == "bpe":
            self.symbols = np.arange(vocabulary.known, vocabulary.base, dtype=np.int32)
            self.symbols[list(vocabulary.symbols)] = list(vocabulary.symbols.values())

    def is_piece(self, t: str) -> bool:
        return len(t) == 1 or t in self.v.scores

    def merged(self, unit: str) -> list[str]:
        """Merge the adjacent pair of best score, leftmost first, until none is a piece."""
        score, parts = self.v.scores.get, list(unit)
        if len(parts) > LONG:
            return self._merged_long(parts)
        pairs = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) != NEVER:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], NEVER)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], NEVER)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        score, n = self.v.scores.get, len(parts)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (s := score(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if parts[i] != a or after[i] >= n or parts[after[i]] != b:
                continue
            j = after[i]
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def link(self, left: str, piece: str) -> float | None:
        """The score of ``piece`` after ``left``, None where the two can't be neighbours."""
        if self.v.mode == "unigram":
            return self.v.scores.get(piece, self.v.lowest)
        if (ok := self.pairs.get((left, piece))) is None:
            if len(self.pairs) > MEMORY:
                self.pairs.clear()
            alone = [p for p in (left, piece) if p]
            ok = self.pairs[left, piece] = self.merged("".join(alone)) == alone
        return 0.0 if ok else None

    def unit(self, unit: str) -> tuple[list[str], float]:
        """The pieces of a word with the white space before it, and their score."""
        if self.v.mode == "bpe":
            return self.merged(unit), 0.0
        exits, path = self.paths(unit, 0, "", len(unit))
        return path(("", 0) if not unit else max(exits, key=exits.get)), max(exits.values(), default=0.0)

    def unit_ids(self, unit: str) -> bytes:
        """The ids of a word with the white space before it, as 32-bit integers."""
        if unit[:1] == SPACE and SPACE not in unit[1:]:
            return self.word_ids(unit[1:])
        found = self.words.get(unit)
        if found is None:
            if len(self.words) > MEMORY:
                self.words.clear()
            found = array("i", [i for p in self.unit(unit)[0] for i in self.v.id_list(p)]).tobytes()
            if len(unit) < 64:
                self.words[unit] = found
        return found

    def word_ids(self, word: str) -> bytes:
        """The ids of a word after one space; remembered without the space."""
        found = self.bare.get(word)
        if found is None:
            if len(self.bare) > MEMORY:
                self.bare.clear()
            found = array("i", [i for p in self.unit(SPACE + word)[0] for i in self.v.id_list(p)]).tobytes()
            if len(word) < 64:
                self.bare[word] = found
        return found

    def text_ids(self, text: str) -> bytes:
        """The ids of a whole text, word by word."""
        if not text:
            return b""
        if text[0] == " " or "  " in text or SPACE in text:
            return b"".join([self.unit_ids(u) for u in UNITS.findall(SPACE + text.replace(" ", SPACE))])
        get, ids = self.bare.get, self.word_ids
        return b"".join([get(w) or ids(w) for w in text.split(" ")])

    def many_ids(self, texts: list[str | None]) -> list[bytes | None]:
        """The ids of each text; words not seen before are merged all at once."""
        self.learn({w for t in texts if t and SPACE not in t for w in t.split(" ")})
        return [None if t is None else self.text_ids(t) for t in texts]

    def learn(self, words: set[str]) -> None:
        """Merge the words that are not remembered yet, all at once."""
        if self.v.mode == "bpe":
            if len(self.bare) > MEMORY:
                self.bare.clear()
            fresh = [w for w in words.difference(self.bare) if 0 < len(w) < LONG]
            fresh.sort(key=len)  # so that words merged together are about as long
            for at in range(0, len(fresh), AT_ONCE):
                self.bare.update(zip(fresh[at : at + AT_ONCE], self._merged_many(fresh[at : at + AT_ONCE])))

    def _merged_many(self, words: list[str]) -> list[bytes]:
        """What word_ids gives for each word: every round merges each word's best pair, leftmost first."""
        v = self.v
        n = np.array([len(w) + 1 for w in words])
        width = int(n.max())
        inside = np.arange(width) < n[:, None]
        flat = self.symbols[np.frombuffer("".join([SPACE + w for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)]
        sym = np.full((len(n), width + 1), -1, np.int32)
        sym[:, :width][inside] = flat
        none = np.iinfo(np.int32).max

        def look(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(rank, joined symbol) of pairs of symbols."""
            key = a.astype(np.int64) * v.base + b
            at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
            hit = (v.keys[at] == key) & (b >= 0) & (a >= 0)
            to = v.joins[at]
            return np.where(hit, v.ranks[to], none), to

        rank, join = look(sym[:, :-1], sym[:, 1:])
        live = np.arange(len(n))
        while len(live):
            best = rank[live].argmin(1)
            going = rank[live, best] != none
            live, best = live[going], best[going]
            if not len(live):
                break
            # Close the gap: symbols after the pair move one place to the left.
            shift = np.arange(width)
            part, r, j = sym[live], rank[live], join[live]
            merged = j[np.arange(len(live)), best]
            take = shift + (shift > best[:, None])
            wide = np.minimum(take, width)
            part[:, :width] = np.take_along_axis(part, wide, 1)
            part[:, width] = -1
            at = np.arange(len(live))
            part[at, best] = merged
            wide = np.minimum(take, width - 1)
            r, j = np.take_along_axis(r, wide, 1), np.take_along_axis(j, wide, 1)
            r[:, width - 1] = none
            left = np.maximum(best - 1, 0)
            x, y = look(part[at, left], part[at, left + 1])
            r[at, left], j[at, left] = x, y
            x, y = look(part[at, best], part[at, best + 1])
            r[at, best], j[at, best] = x, y
            sym[live], rank[live], join[live] = part, r, j
        # Ids of the symbols, then of the words.
        kept = sym[:, :width] >= 0
        flat, count = sym[:, :width][kept], kept.sum(1)
        lists, offsets = v.lists, v.offsets
        odd = np.unique(flat[flat >= v.known])
        if len(odd):
            more = [v.id_list(chr(c - v.known)) for c in odd.tolist()]
            flat = np.where(flat >= v.known, v.known + np.searchsorted(odd, flat), flat)
            lists, offsets = np.append(lists, np.array([i for x in more for i in x], np.int32)), np.append(offsets, offsets[-1] + np.cumsum([len(x) for x in more]))
        size = offsets[flat + 1] - offsets[flat]
        ends = np.cumsum(size)
        ids = lists[np.repeat(offsets[flat] - ends + size, size) + np.arange(ends[-1])].tobytes()
        cut = np.append(0, ends[np.cumsum(count) - 1] * 4).tolist()
        return [ids[i:j] for i, j in zip(cut, cut[1:])]

    def paths(self, s: str, start: int, left: str, stop: int):
        """Best scores of the states that reach ``stop`` from ``left`` ending at ``start``; and what gives a state's pieces."""
        at, exits, back = {start: {left: 0.0}}, {}, {}
        if start >= stop:
            exits[(left, start - stop)] = 0.0
        for p in range(start, stop):
            states = at.pop(p, None)
            if not states:
                continue
            for e in range(p + 1, min(p + self.v.longest, len(s)) + 1):
                t = s[p:e]
                if not self.is_piece(t):
                    continue
                best, frm = None, None
                for prev, score in states.items():
                    w = self.link(prev, t)
                    if w is not None and (best is None or score + w > best):
                        best, frm = score + w, prev
                if best is None:
                    continue
                back[e, t] = (p, frm)
                if e >= stop:
                    exits[(t, e - stop)] = best
                elif self.v.mode == "unigram":  # only the best way to a position matters
                    old = at.setdefault(e, {})
                    if not old or best > next(iter(old.values())):
                        at[e] = {t: best}
                else:
                    at.setdefault(e, {})[t] = best

        def path(state: tuple[str, int]) -> list[str]:
            t, e = state[0], stop + state[1]
            out = []
            while (e, t) in back and e > start:
                out.append(t)
                e, t = back[e, t]
            return out[::-1]

        return exits, path


class Chunk:
    """A chunk between what stands to its left and right; the pieces that start inside are its own."""

    def __init__(self, encoder: Encoder, left: str, body: str, right: str):
        self.e, self.s = encoder, left + body + right
        self.lo, self.hi = len(left), len(left) + len(body)
        cuts = [m.start() + 1 for m in re.finditer(f"[^{SPACE}](?={SPACE})", self.s)]
        cuts = [c for c in cuts if self.lo <= c <= self.hi] if left else [0, *[c for c in cuts if c <= self.hi]]
        self.first, self.last = (cuts[0], cuts[-1]) if cuts else (None, None)

    def entries(self) -> list[tuple[str, int]]:
        if not self.lo or self.first == self.lo:
            return [START]
        s, v = self.s, self.e.v
        return [(s[a:b], b - self.lo) for a in range(max(0, self.lo - v.longest), self.lo) for b in range(self.lo, min(a + v.longest, len(s)) + 1) if self.e.is_piece(s[a:b])]

    def matrix(self) -> list[tuple[str, int, str, int, float]]:
        """(entry piece, entry reach, exit piece, exit reach, best score)."""
        if self.first is None:
            return [(*entry, *out, w) for entry in self.entries() for out, w in self.e.paths(self.s, self.lo + entry[1], entry[0], self.hi)[0].items()]
        inner = sum(self.e.unit(u)[1] for u in UNITS.findall(self.s[self.first : self.last])) if self.e.v.mode == "unigram" else 0.0
        tail = self.e.paths(self.s, self.last, "", self.hi)[0]
        out = []
        for entry in self.entries():
            if self.lo + entry[1] <= self.first:
                head = self.e.paths(self.s, self.lo + entry[1], entry[0], self.first)[0]
                if head:
                    out += [(*entry, *x, max(head.values()) + inner + w) for x, w in tail.items()]
        return out

    def ids(self, entry: tuple[str, int], out: tuple[str, int]) -> np.ndarray:
        """The ids of the chunk's own pieces on the best path between two states."""
        if self.first is None:
            return self._ids(self.e.paths(self.s, self.lo + entry[1], entry[0], self.hi)[1](out))
        exits, path = self.e.paths(self.s, self.lo + entry[1], entry[0], self.first)
        inner = b"".join([self.e.unit_ids(u) for u in UNITS.findall(self.s[self.first : self.last])])
        tail = self.e.paths(self.s, self.last, "", self.hi)[1](out)
        return np.concatenate([self._ids(path(max(exits, key=exits.get))), np.frombuffer(inner, np.int32), self._ids(tail)])

    def _ids(self, pieces: list[str]) -> np.ndarray:
        return np.array([i for p in pieces for i in self.e.v.id_list(p)], np.int32)


def times(a: dict, b: dict) -> dict:
    """Max-plus product of two matrices {entry: {exit: score}}."""
    out: dict = {}
    for entry, row in a.items():
        got: dict = {}
        for mid, w in row.items():
            for x, u in b.get(mid, {}).items():
                if x not in got or w + u > got[x]:
                    got[x] = w + u
        if got:
            out[entry] = got
    return out


def as_matrix(rows) -> dict:
    out: dict = {}
    for a, i, b, j, w in rows:
        out.setdefault((a, int(i)), {})[(b, int(j))] = float(w)
    return out


def states_between(matrices: list[dict], entry: tuple[str, int], out: tuple[str, int] | None) -> list[tuple[str, int]]:
    """The states on the best path through the matrices, from ``entry`` to ``out`` (None: the best that reaches no further)."""
    fronts = [{entry: 0.0}]
    for m in matrices:
        fronts.append(times({entry: fronts[-1]}, m).get(entry, {}))
    if out is None:
        out = max((x for x in fronts[-1] if x[1] == 0), key=fronts[-1].get)
    path = [out]
    for front, m in zip(reversed(fronts[:-1]), reversed(matrices)):
        path.append(max((x for x in front if path[-1] in m.get(x, {})), key=lambda x: front[x] + m[x][path[-1]]))
    return path[::-1]


_MATRIX = "array<struct<a:string,i:int,b:string,j:int,w:double>>"


def _giants(rows: DataFrame, shared, parts: int) -> DataFrame:
    """(row, ids) of the rows (key, row, text) whose texts are split into chunks; their matrices are dealt to ``parts`` tasks."""
    c, reach = CHUNK, shared.value["longest"]
    text = F.concat(F.lit(SPACE), F.translate("text", " ", SPACE))
    whole = rows.select("key", text.alias("t")).withColumn("n", F.length("t"))
    cut = whole.select("key", "t", F.posexplode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {c} as int)"))).alias("no", "_"))
    at = F.col("no") * c
    left = F.least(at, F.lit(reach))
    chunks = cut.select("key", "no", F.expr("cast(no div %d as int)" % BLOCK).alias("block"), F.substring("t", at - left + 1, left).alias("left"), F.substring("t", at + 1, F.lit(c)).alias("body"), F.substring("t", at + c + 1, F.lit(reach)).alias("right"))
    chunks = stored(chunks, "pieces")

    def matrices(batches):
        import pandas as pd

        encoder = Encoder(Vocabulary.of(shared.value))
        for b in batches:
            yield pd.DataFrame({"key": b.key, "block": b.block, "no": b.no, "m": [[dict(zip("aibjw", x)) for x in Chunk(encoder, *t).matrix()] for t in zip(b.left, b.body, b.right)]})

    def read(m) -> dict:
        return as_matrix((x["a"], x["i"], x["b"], x["j"], x["w"]) for x in m)

    def combined(group):
        import pandas as pd

        group = group.sort_values("no")
        total = read(group.m.iloc[0])
        for m in group.m.iloc[1:]:
            total = times(total, read(m))
        flat = [dict(zip("aibjw", (*x, *y, w))) for x, row in total.items() for y, w in row.items()]
        return pd.DataFrame({"key": [group.key.iloc[0]], "block": [group.block.iloc[0]], "m": [flat]})

    def over_blocks(group):
        import pandas as pd

        group = group.sort_values("block")
        s = states_between([read(m) for m in group.m], START, None)
        return pd.DataFrame({"key": group.key, "block": group.block, "fa": [x[0] for x in s[:-1]], "fi": [x[1] for x in s[:-1]], "ta": [x[0] for x in s[1:]], "ti": [x[1] for x in s[1:]]})

    def within(group):
        import pandas as pd

        group = group.sort_values("no")
        r = group.iloc[0]
        s = states_between([read(m) for m in group.m], (r.fa, int(r.fi)), (r.ta, int(r.ti)))
        return pd.DataFrame({"key": group.key, "no": group.no, "fa": [x[0] for x in s[:-1]], "fi": [x[1] for x in s[:-1]], "ta": [x[0] for x in s[1:]], "ti": [x[1] for x in s[1:]]})

    def backtraced(batches):
        import pandas as pd

        encoder = Encoder(Vocabulary.of(shared.value))
        for b in batches:
            encoder.learn({w for body in b.body for w in body.split(SPACE)})
            ids = [Chunk(encoder, r.left, r.body, r.right).ids((r.fa, r.fi), (r.ta, r.ti)) for r in b.itertuples()]
            yield pd.DataFrame({"key": b.key, "no": b.no, "ids": ids})

    own = stored(chunks.mapInPandas(matrices, f"key long, block int, no int, m {_MATRIX}"), "pieces")
    ends = "fa string, fi int, ta string, ti int"
    blocks = own.repartition(parts, "key", "block").groupBy("key", "block").applyInPandas(combined, f"key long, block int, m {_MATRIX}")
    blocks = blocks.repartition(parts, "key").groupBy("key").applyInPandas(over_blocks, f"key long, block int, {ends}")
    inside = own.join(blocks, ["key", "block"]).repartition(parts, "key", "block").groupBy("key", "block").applyInPandas(within, f"key long, no int, {ends}")
    ids = chunks.join(inside, ["key", "no"]).mapInPandas(backtraced, "key long, no int, ids array<int>")
    ids = ids.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))
    return rows.join(ids, "key").select("row", "ids")


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, columns: list[str] | None = None) -> DataFrame:
    """(row, ids): each row's ``columns`` (all by default) as a struct, and the ids of column ``text``."""
    vocabulary = vocabulary or Vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocabulary))
    columns = columns or docs.columns
    row = F.struct(*[docs[c] for c in columns]).alias("row")
    text = docs["text"].cast("string")
    inside = "text" in columns and docs.schema["text"].dataType.simpleString() == "string"
    kind = docs.select(row).schema["row"].dataType.simpleString()
    giant = F.coalesce(F.length(text) > CHUNK, F.lit(False))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        encoder = Encoder(Vocabulary.of(shared.value))
        for b in slices(batches, 300):
            texts = pc.struct_field(b.column(0), "text") if inside else b.column(1)
            ids = encoder.many_ids(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids)], names=["row", "ids"])

    short = docs.where(~giant).select(row, *([] if inside else [text.alias("text")])).mapInArrow(run, f"row {kind}, ids array<int>")
    giants = stored(docs.where(giant).select(row, text.alias("text"), F.monotonically_increasing_id().alias("key")), "pieces")
    n = giants.count()
    return short.unionByName(_giants(giants, shared, 8 + n // 32)) if n else short


def _lists(ids: list[bytes | None]):
    """An Arrow array of lists from the bytes of 32-bit integers."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) // 4 for x in ids])]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join([x for x in ids if x is not None]), np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([x is None for x in ids], pa.bool_()))


def decode(rows: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(row, ids, decoded): the text of column ``ids``."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(vocabulary or Vocabulary()))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        v = Vocabulary.of(shared.value)
        parts = [b"" if i in v.silent else p.replace(SPACE, " ").encode() for i, p in enumerate(v.names)]
        for byte, i in v.bytes.items():
            parts[i] = bytes([byte])
        parts[v.unknown] = " \u2047 ".encode()
        pool = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(p) for p in parts])
        start = np.cumsum(size) - size
        for b in slices(batches, 300):
            lists = b.column(1)
            ids, at = lists.flatten().to_numpy(), np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()))
            ends = np.append(0, np.cumsum(size[ids]))
            data, cut = np.empty(ends[-1], np.uint8), ends[at]
            for lo in range(0, len(ids), AT_ONCE):  # in parts, as places take eight times the bytes
                some = ids[lo : lo + AT_ONCE]
                x, n = ends[lo : lo + len(some)], size[some]
                data[x[0] : x[0] + n.sum()] = pool[np.repeat(start[some] - (x - x[0]), n) + np.arange(n.sum())]
            # A text's first byte is dropped if it is the space that encoding puts before it.
            first = cut[:-1][cut[1:] > cut[:-1]]
            first = first[data[first] == 32]
            kept = np.ones(len(data), bool)
            kept[first] = False
            cut = (cut - np.searchsorted(first, cut)).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(cut), pa.py_buffer(data[kept])])
            try:
                texts = raw.cast(pa.string())
            except pa.ArrowInvalid:  # ids that are no text
                texts = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
            texts = pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), texts)
            yield pa.RecordBatch.from_arrays([b.column(0), lists, texts], names=["row", "ids", "decoded"])

    return rows.select("row", "ids").mapInArrow(run, f"row {kind}, ids array<int>, decoded string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Vocabulary()
    out = decode(encode(table(spark, sf_dir, "documents"), vocabulary, ["doc_id", "text"]), vocabulary)
    same = F.col("decoded").eqNullSafe(F.translate("row.text", SPACE, " "))
    return out.select("row.doc_id", F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"), "ids", same.alias("round_trip"))


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
ORACLES: dict[str, str] = {}
