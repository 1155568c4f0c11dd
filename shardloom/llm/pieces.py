"""SentencePiece encoding and decoding by streaming Viterbi.

Of a BPE model every prefix of a text has exactly one encoding, and two pieces may follow each other exactly if
encoding their joined string gives them again. So the best path to a position has one backpointer: the last piece of the
prefix's encoding, found among the pieces that end there. A unigram model has scores instead: the best path to a position is
the one with the largest sum. Backpointers that can still matter lie in a window of the longest piece's length; pieces are
committed as soon as all paths from the window pass one boundary. Many units of text go through the stream at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words of which a Python worker keeps the ids, and characters of text that it encodes at once (or one longer text).
CACHED, AT_ONCE = 250_000, 1 << 19
#: Characters of a word up to which its ids are remembered.
SHORT = 64
NORMAL, BYTE, BPE = 1, 6, 2


class _Table:
    """Non-negative int64 keys to int32 values, looked up for whole arrays; open addressing."""

    def __init__(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where a key is unknown."""
        slots, out = self._slots(keys), np.full(len(keys), -1, np.int32)
        at = np.arange(len(keys))
        while len(at):
            held = self.keys[slots]
            hit = held == keys[at]
            out[at[hit]] = self.values[slots[hit]]
            go = ~hit & (held >= 0)
            at, slots = at[go], (slots[go] + 1) & ((1 << self.bits) - 1)
        return out

    def put(self, keys: list, values: list) -> None:
        """Keeps new keys. A table that would be over half full forgets the keys it had, and takes no more than fill half of it."""
        half = 1 << (self.bits - 1)
        if self.used + len(keys) > half:
            self.used, keys, values = 0, keys[:half], values[:half]
            self.keys.fill(-1)
        for key, value, slot in zip(keys, values, self._slots(np.asarray(keys, np.int64)).tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.values[slot] = key, value
        self.used += len(keys)


class Pieces:
    """A model's vocabulary, and text to ids and back.

    The text is taken as it is (identity normalisation): every blank becomes the space mark, one more is put before the
    text. Characters without a piece become the pieces of their UTF-8 bytes, and so does a space mark that the text
    itself contains, so that decoding always gives the text back.
    """

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with identity normalisation can be decoded to the very text")
        self.bpe = proto.trainer_spec.model_type == BPE
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = [p.score for p in proto.pieces]
        self.longest = max(map(len, self.ids))
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        back = {i: bytes([b]) for b, i in self.bytes.items()}
        self.texts = [back.get(i, p.piece.replace(SPACE, " ").encode()) for i, p in enumerate(proto.pieces)]
        self.starts_words = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        self.unknown = min(self.scores) * 2 - 1
        self.known: dict[str, bytes] = {}
        self.names = [p.piece for p in proto.pieces]
        self.pairs = _Table(21)  # first * n + second: may second follow first?
        self.size = np.array([*map(len, self.names), 1])
        chars = sorted(set("".join(self.ids)))
        self.chars = np.full(0x110000, len(chars), np.int32)
        self.chars[[ord(c) for c in chars]] = np.arange(len(chars))
        self.n_chars = len(chars) + 1
        nodes, moves, self.piece_at = {"": 0}, {}, [-1]
        for piece, i in self.ids.items():
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    nodes[piece[:k]] = len(nodes)
                    moves[nodes[piece[: k - 1]] * self.n_chars + int(self.chars[ord(piece[k - 1])])] = nodes[piece[:k]]
                    self.piece_at.append(-1)
            self.piece_at[nodes[piece]] = i
        self.piece_at = np.array(self.piece_at, np.int32)
        self.moves = _Table(max(8, (2 * len(moves)).bit_length()))
        self.moves.put(list(moves), list(moves.values()))

    def merged(self, text: str) -> list[str]:
        """A short string's BPE encoding by its definition: merge the best pair, the leftmost of equals, until none is left."""
        parts = list(text)
        while True:
            found = [(-self.scores[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                return parts
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def may_follow(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether a BPE encoding can have the pieces one after the other; characters without a piece (id n) part everything."""
        n = len(self.names)
        key = first.astype(np.int64) * n + second
        real = (first < n) & (second < n)
        out = np.ones(len(key), np.int32)
        out[real] = self.pairs.get(key[real])
        new, which = np.unique(key[out < 0], return_inverse=True)
        if len(new):  # answered from here: the table may forget keys that it had for this call
            may = [self.merged(self.names[k // n] + self.names[k % n]) == [self.names[k // n], self.names[k % n]] for k in new.tolist()]
            out[out < 0] = np.array(may, np.int32)[which]
            self.pairs.put(new.tolist(), may)
        return out > 0

    def stream(self, units: list[str]) -> list[np.ndarray]:
        """Ids of units of text in which blanks are space marks, all taken character by character at once; characters without a
        piece have the id n.

        Of each unit the backpointers (and, of unigram models, sums) of the positions after its last commit are kept. As
        soon as that window is twice the longest piece, the paths back from all positions at which a later piece can begin
        are compared, and what they share is committed; a unit's end commits the rest.
        """
        n, longest, big = len(units), self.longest, len(self.names)
        sizes = np.fromiter(map(len, units), np.int64, n)
        order = np.argsort(-sizes, kind="stable")  # units that have ended are at the end
        ends = sizes[order]
        text = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        begin = (np.cumsum(sizes) - sizes)[order]
        width, base = min(int(ends[0]) if n else 0, 3 * longest) + 1, 0  # columns are the positions from ``base`` on
        last, sums = np.full((n, width), -1, np.int32), None if self.bpe else np.zeros((n, width))
        done, out = np.zeros(n, np.int64), [[] for _ in range(n)]
        gain = None if self.bpe else np.array([*self.scores, self.unknown])
        who, start, node = (np.zeros(0, np.int64) for _ in range(3))
        live = n
        for k in range(int(ends[0]) if n else 0):
            while live and ends[live - 1] <= k:
                live -= 1
            code = self.chars[text[begin[:live] + k]].astype(np.int64)
            keep = who < live
            who = np.concatenate([who[keep], np.arange(live)])
            start = np.concatenate([start[keep], np.full(live, k)])
            node = np.concatenate([node[keep], np.zeros(live, np.int64)])
            node = self.moves.get(node * self.n_chars + code[who]).astype(np.int64)
            piece = np.where(node < 0, -1, self.piece_at[node])
            piece = np.where((piece < 0) & (start == k), big, piece)
            if k + 1 - base >= width:  # the columns move on, or grow where a unit's paths have not met
                low = int(done[:live].min())
                if low - base < width // 2:
                    last = np.pad(last, ((0, 0), (0, width)), constant_values=-1)
                    sums = sums if sums is None else np.pad(sums, ((0, 0), (0, width)))
                    width *= 2
                else:
                    for table, fill in ((last, -1), (sums, 0)):
                        if table is not None:
                            table[:live, : width - (low - base)] = table[:live, low - base :]
                            table[:live, width - (low - base) :] = fill
                    base = low
            hit = np.flatnonzero(piece >= 0)
            w, s, p = who[hit], start[hit], piece[hit]
            if self.bpe:
                before = last[w, s - base]
                first = s == 0
                ok = first | (before >= 0)
                ok[ok] = first[ok] | self.may_follow(np.where(first[ok], 0, before[ok]), p[ok])
                last[w[ok], k + 1 - base] = p[ok]
            else:
                total = sums[w, s - base] + gain[p]
                best = np.lexsort((total, w))
                last[w[best], k + 1 - base], sums[w[best], k + 1 - base] = p[best], total[best]  # of equal units the last assignment stays
            go = (node >= 0) & (start > k + 1 - longest)
            who, start, node = who[go], start[go], node[go]
            for u in np.flatnonzero(k + 1 - done[:live] >= 2 * longest).tolist():
                shared = self._shared(last[u], base, int(done[u]), k + 1)
                out[u] += shared
                done[u] += sum(self.size[shared].tolist())
            for u in range(live - 1, -1, -1):
                if ends[u] > k + 1:
                    break
                out[u] += self._path(last[u], base, int(done[u]), k + 1)
        found: list = [None] * n
        for u, at in enumerate(order.tolist()):
            found[at] = np.array(out[u], np.int32)
        return found

    def _path(self, last: np.ndarray, base: int, start: int, end: int) -> list[int]:
        """The ids on the way from ``start`` to ``end``, read from the end."""
        out = []
        while end > start:
            out.append(int(last[end - base]))
            end -= int(self.size[out[-1]])
        return out[::-1]

    def _shared(self, last: np.ndarray, base: int, start: int, end: int) -> list[int]:
        """The ids from ``start`` to the last boundary that is on the path to every position at which a later piece can begin."""
        paths = [self._path(last, base, start, x) for x in range(max(start + 1, end - self.longest + 1), end + 1) if last[x - base] >= 0]
        shared: list[int] = []
        for step in zip(*paths, strict=False):
            if len(set(step)) > 1:
                break
            shared.append(step[0])
        return shared

    def segments(self, text: str) -> list[str]:
        """The pieces of a text in which blanks are space marks; single characters where the vocabulary has none."""
        out, at = [], 0
        for i in self.stream([text])[0].tolist():
            out.append(text[at : at + int(self.size[i])])
            at += len(out[-1])
        return out

    def _encoded(self, units: list[str], stand: str = "") -> list[bytes]:
        """Ids (int32) of units, with the byte pieces of the characters that have no piece; ``stand`` stands for a space mark of the text itself."""
        out, n = [], len(self.names)
        for unit, ids in zip(units, self.stream(units), strict=True):
            if (ids == n).any():
                own, at = [], 0
                for i in ids.tolist():
                    own += [i] if i < n else [self.bytes[b] for b in (SPACE if unit[at] == stand else unit[at]).encode()]
                    at += int(self.size[i])
                ids = np.array(own, np.int32)
            out.append(ids.tobytes())
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts. No piece of such a vocabulary goes over a blank that follows another character, so all paths meet
        there: a text's units are its words, each with the blanks before it, and the ids of shorter ones are remembered."""
        known, parted, out = self.known, [], []
        for text in texts:
            mark = ""
            if SPACE in text:  # a character that neither text nor vocabulary has stands for a mark in the text
                mark = next(c for c in map(chr, range(0x10FFFF, 0, -1)) if c not in text and c not in self.ids)
                text = text.replace(SPACE, mark)
            if not self.starts_words:
                parts = [text] if text else []
            else:
                parts = text.split(" ") if text else []
                if "" in parts:
                    words, blanks = [], 0
                    for part in parts[:-1]:
                        if part:
                            words.append(" " * blanks + part)
                        blanks = 0 if part else blanks + 1
                    parts = [*words, " " * blanks + parts[-1]]
            parted.append((parts, mark))
        new = {w for parts, _ in parted for w in parts}.difference(known)
        if len(known) + len(new) > CACHED:
            known.clear()
            new = {w for parts, _ in parted for w in parts}
        marked = [*new]
        ids = dict(zip(marked, self._encoded([SPACE + w.replace(" ", SPACE) for w in marked]), strict=True))
        known.update((w, x) for w, x in ids.items() if len(w) <= SHORT)
        long = {w: x for w, x in ids.items() if len(w) > SHORT}
        for parts, mark in parted:
            meant = long
            if mark:
                own = [w for w in set(parts) if mark in w]
                meant = long | dict(zip(own, self._encoded([SPACE + w.replace(" ", SPACE) for w in own], mark), strict=True))
            found = [meant[w] if w in meant else known[w] for w in parts] if meant else map(known.__getitem__, parts)
            out.append(np.frombuffer(b"".join(found), np.int32))
        return out

    def decode(self, ids) -> str:
        """The text of ids, without the blank that encoding put before it."""
        return b"".join(map(self.texts.__getitem__, ids))[1:].decode()


@lru_cache(1)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def read_model(docs: DataFrame, path: str) -> bytes:
    """The model file, through Spark's file sources; a vocabulary, so its size is bounded."""
    return bytes(docs.sparkSession.read.format("binaryFile").load(f"file://{path}" if path.startswith("/") else path).select("content").first()[0])


def encode(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """Per row of ``docs``: its id, ``ids`` (array<int>), ``n_ids`` (long) and ``round_trip`` (decoding gave the text back).

    An empty text has no ids; a null text has null ids, n_ids 0 and a null round_trip. Texts are
    encoded whole, however long. Repeated rows and null ids are rows like any other. An empty table gives no rows.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    model = docs.sparkSession.sparkContext.broadcast(read_model(docs, model_path))

    def batches(parts):
        pieces = _pieces(model.value)
        for part in parts:
            lengths = np.cumsum(pc.utf8_length(part.column(1)).fill_null(0).to_numpy(zero_copy_only=False)) // AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), part.num_rows]
            for at, to in zip(cuts, cuts[1:], strict=False):
                texts = part.column(1)[at:to].to_pylist()
                some = iter(pieces.encode([t for t in texts if t is not None]))
                ids = [None if t is None else next(some) for t in texts]
                same = [None if x is None or not check else pieces.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]
                counts = [0 if x is None else len(x) for x in ids]
                flat = np.concatenate([x for x in ids if x is not None]) if any(counts) else np.array([], np.int32)
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                missing = pa.array([x is None for x in ids], pa.bool_())
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat), mask=missing)
                yield pa.RecordBatch.from_arrays([part.column(0)[at:to], lists, pa.array(counts, pa.int64()), pa.array(same, pa.bool_())], ["id", "ids", "n_ids", "round_trip"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(batches, f"id {kind}, ids array<int>, n_ids long, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row of ``encoded``: its id and ``text``, decoded from its ids; null ids give a null text, no ids an empty one.

    An id that the model lacks is an error. Repeated rows and null ids of documents are rows like any other. An empty table
    gives no rows.
    """
    import pyarrow as pa

    model = encoded.sparkSession.sparkContext.broadcast(read_model(encoded, model_path))

    def batches(parts):
        pieces = _pieces(model.value)
        for part in parts:
            texts = [None if ids is None else pieces.decode(ids) for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(batches, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
