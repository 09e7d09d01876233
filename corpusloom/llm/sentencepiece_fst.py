"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from the model file: the normaliser (rewriting rules by longest match, white space squeezed where the model asks
for it, blanks to the word mark, a mark before the text), the piece
lexicon with a byte loop for characters that no piece holds, and an acceptor over neighbouring pieces. Their composition with
an input is expanded as far as the search for the shortest path in the tropical semiring goes, which is one routine for all models. The normaliser gives every
input one output at no cost, so composing with it is taking that output. For a unigram model an arc costs minus
the piece's score and every neighbour is accepted. For a BPE model pieces cost nothing and the acceptor gives infinity to
neighbours that the merge order would have joined or split otherwise; one path stays finite, and it is the library's encoding.

The composition is taken per stretch between certain cuts: no piece holds a word mark after another character, nor a line feed, so
stretches are independent, and so with marks of punctuation that no piece holds after a letter; a worker keeps the paths of those that recur.
New stretches are searched in order of their characters, and what is known of the places of a common beginning stays.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import bounded_batches, text_of, tidied
from corpusloom.llm.token_files import FIRST, Kept, id_lists, in_portions, of_size, regrouped, strings

MARK = "▁"
#: Bytes of the stretches that a worker keeps and their ids.
KEPT_STRETCHES = 24 << 20
#: Pairs of neighbours whose weights a worker remembers.
KEPT_JOINS = 400_000
#: Longer stretches have all their places settled in order.
SHORT = 100
#: Bytes of text that are encoded at once.
TEXTS = 4 << 20
PORTION = 4 << 20


def _fields(buffer: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = buffer[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(buffer):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, buffer[at : at + size]
        at += size


class Rewriter:
    """Rewriting rules of a model, as the file has them: a double-array trie over the bytes of what is rewritten, and the new strings."""

    def __init__(self, table: bytes):
        size = int.from_bytes(table[:4], "little")
        self.units = np.frombuffer(table[4 : 4 + size], dtype="<u4").tolist()
        self.strings = table[4 + size :]
        self.starts: dict[str, bool] = {}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, raw: bytes) -> tuple[int, bytes]:
        """Length of the longest rule that ``raw`` begins with (0: none), and its new string."""
        node, length, place = self._offset(self.units[0]), 0, 0
        for at, byte in enumerate(raw, 1):
            node ^= byte
            unit = self.units[node]
            if unit & (1 << 31 | 255) != byte:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                length, place = at, self.units[node] & (1 << 31) - 1
        return length, self.strings[place : self.strings.index(b"\0", place)] if length else b""

    def _may_start(self, character: str) -> bool:
        """Whether the bytes of a character are the beginning of any rule, or a rule is the beginning of them."""
        node, raw = self._offset(self.units[0]), character.encode("utf-8", "surrogatepass")
        for at, byte in enumerate(raw, 1):
            node ^= byte
            unit = self.units[node]
            if unit & (1 << 31 | 255) != byte:
                return False
            node ^= self._offset(unit)
            if unit >> 8 & 1 or at == len(raw):
                return True
        return False

    def rewrite(self, text: str) -> str:
        out, at, plain = [], 0, 0
        while at < len(text):
            c = text[at]
            may = self.starts.get(c)
            if may is None:
                may = self.starts[c] = self._may_start(c)
            length, new = self.longest(text[at : at + 32].encode("utf-8", "surrogatepass")) if may else (0, b"")
            if not length:
                at += 1
                continue
            out += [text[plain:at], new.decode("utf-8", "replace")]
            at += len(text[at : at + 32].encode("utf-8", "surrogatepass")[:length].decode("utf-8", "replace"))
            plain = at
        return "".join([*out, text[plain:]])


class _Row(dict):
    """Weights of one left neighbour with right ones, worked out when first asked for."""

    def __init__(self, machine: Transducer, left: str):
        self.machine, self.left = machine, left

    def __missing__(self, right: str) -> float:
        self[right] = found = self.machine._join(self.left, right)
        self.machine.joins.pairs += 1
        return found


class _Joins(dict):
    """A row for each left neighbour."""

    def __init__(self, machine: Transducer):
        self.machine, self.pairs = machine, 0

    def __missing__(self, left: str) -> _Row:
        self[left] = row = _Row(self.machine, left)
        return row


class Transducer:
    """The compiled machines of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = dict(_fields(model.serialized_model_proto()))
        trainer, normaliser = dict(_fields(spec[2])), dict(_fields(spec[3]))
        self.rewriter = Rewriter(normaliser[2]) if normaliser.get(2) else None
        self.squeezes = bool(normaliser.get(4, 1))
        if not normaliser.get(5, 1):
            raise ValueError("models that keep blanks as they are aren't compiled")
        self.prefix = MARK if normaliser.get(3, 1) else ""
        self.merges = trainer.get(3, 1) == 2
        ids = range(model.get_piece_size())
        self.names = [model.id_to_piece(i) for i in ids]
        special = {i for i in ids if model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)}
        self.byte_id = {int(self.names[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown = next(i for i in ids if model.is_unknown(i))
        self.pieces = {self.names[i]: i for i in ids if i not in special}
        self.score = [model.get_score(i) for i in ids]
        #: what a character without a piece costs: ten more than the worst piece, as the library weighs it
        self.worst = 10 - min((self.score[i] for i in self.pieces.values()), default=0.0)
        # the lexicon's states by the characters read so far, from a place backwards: the piece that begins there, or "" inside a piece
        self.states = {p[k:]: "" for p in self.pieces for k in range(1, len(p))} | {p: p for p in self.pieces}
        if any("\n" in p[1:] + p[:-1] or re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces):
            raise ValueError("a piece crosses the cuts between stretches")
        # marks of punctuation end a stretch of letters, but for those letters after which some piece holds the mark
        stops = ".,;:!?*&%#-)"
        joined = "".join(sorted({p[k - 1] for p in self.pieces for k in range(1, len(p)) if p[k] in stops and re.match(r"[^\W\d_]", p[k - 1])}))
        apart = rf"(?<![{re.escape(joined)}])" if joined else ""
        self.stretches = re.compile(rf"{MARK}*[^\W\d_]+{apart}(?=[{re.escape(stops)}])|{MARK}*[^{MARK}\n]+|\n|{MARK}+")
        self.out = [b"" if i in special else self.names[i].replace(MARK, " ").encode() for i in ids]
        for byte, i in self.byte_id.items():
            self.out[i] = bytes([byte])
        self.bytes_of = np.isin(np.arange(len(self.names)), list(self.byte_id.values()))
        self.spines: dict[str, tuple | None] = {}
        self.joins = _Joins(self)
        self.arcs = {p: 0.0 if self.merges else -self.score[i] for p, i in self.pieces.items()}
        self.byte_arc = 0.0 if self.merges else self.worst
        #: a place can't be reached at less
        self.least = 0.0 if self.merges else -math.inf
        self.kept = Kept(KEPT_STRETCHES, self._of_stretches)

    def _rank(self, piece: str) -> float:
        i = self.pieces.get(piece)
        return math.inf if i is None else -self.score[i]

    def _spine(self, piece: str) -> tuple | None:
        """(left, right) edges of the piece's merge history, or None where merging its characters doesn't give the piece.

        An edge lists the symbols that stood at that end, each with the rank at which a larger one took it in.
        """
        if piece in self.spines:
            return self.spines[piece]
        # a node: (symbol, rank at which it was complete, left child, right child)
        row = [(c, -math.inf, None, None) for c in piece]
        while len(row) > 1:
            rank, at = min((self._rank(row[k][0] + row[k + 1][0]), k) for k in range(len(row) - 1))
            if rank == math.inf:
                break
            a, b = row[at], row[at + 1]
            row[at : at + 2] = [(a[0] + b[0], max(rank, a[1], b[1]), a, b)]
        found = None
        if len(row) == 1:
            edges = []
            for side in (2, 3):
                node, taken, edge = row[0], math.inf, []
                while node is not None:
                    edge.append((node[0], taken))
                    taken, node = node[1], node[side]
                edges.append(edge[::-1])
            found = tuple(edges)
        self.spines[piece] = found
        return found

    def _accepts(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` leaves the boundary between them alone; of equal ranks the leftmost merges first."""
        ends, starts = self._spine(left)[1], self._spine(right)[0]
        i = j = 0
        while True:
            (x, x_taken), (y, y_taken) = ends[i], starts[j]
            across = self._rank(x + y)
            if across < x_taken and across <= y_taken and across < math.inf:
                return False
            if x_taken == math.inf and y_taken == math.inf:
                return True
            if x_taken <= y_taken:
                i += 1
            else:
                j += 1

    def _bytes(self, character: str) -> list[int]:
        return [self.byte_id.get(b, self.unknown) for b in character.encode("utf-8", "surrogatepass")] if self.byte_id else [self.unknown]

    def _join(self, before: str, symbol: str) -> float:
        """Weight of two neighbours: nothing, or infinity where merging would have joined or split them otherwise."""
        if self._spine(symbol) is None or (before and not self._accepts(before, symbol)):
            return math.inf
        return 0.0

    def _ids(self, symbols: list[str]) -> list[int]:
        ids = list(map(self.pieces.get, symbols))
        if None not in ids:
            return ids
        out = []
        for symbol, i in zip(symbols, ids, strict=True):
            if i is not None:
                out.append(i)
            elif self.byte_id or out[-1:] != [self.unknown]:  # a run of unknown characters is one unknown piece
                out += self._bytes(symbol)
        return out

    def shortest_path(self, stretch: str) -> list[int]:
        """Ids on the cheapest path of the stretch; of equal costs the longer last piece."""
        return self._ids(self._search(stretch))

    def _search(self, stretch: str) -> list[str]:
        return self._searcher()(stretch)

    def _searcher(self) -> Callable[[str], list[str]]:
        """The search for the symbols of a stretch's shortest path, for either kind of model.

        A state is a place and what the acceptor remembers: the last symbol of a BPE model, nothing of a unigram model. Either way one state of a place
        can have a finite cost at most: what comes before a place has one encoding by merges. A place is settled when it is asked for, over
        the arcs that end there, longest first, and no further than to the least cost that there can be; what the acceptor adds is asked for only where an arc
        would be cheaper without it. Places depend on what comes before them alone, so those of the beginning that two successive stretches share stay.
        """
        state, arcs, joins, merges, byte_arc, least = self.states.get, self.arcs, self.joins, self.merges, self.byte_arc, self.least
        held, costs, last = "", [0.0], [""]

        def settle(end: int) -> float:
            start, ending = end - 1, []
            while start >= 0:
                piece = state(held[start:end])
                if piece:
                    ending.append((start, piece))
                elif piece is None:
                    break
                start -= 1
            if held[end - 1] not in arcs:
                ending.insert(0, (end - 1, ""))
            best = math.inf
            for start, piece in reversed(ending):
                cost = costs[start]
                if cost is None:
                    cost = settle(start)
                total = cost + (arcs[piece] if piece else byte_arc)
                if total < best and not (merges and joins[last[start]][piece or held[start]]):
                    best, last[end] = total, piece or held[start]
                    if best <= least:
                        break
            costs[end] = best
            return best

        def search(stretch: str) -> list[str]:
            nonlocal held
            n, shared = len(stretch), 0
            for a, b in zip(held, stretch):
                if a != b:
                    break
                shared += 1
            held = stretch
            costs[shared + 1 :] = [None] * (n - shared)
            last[shared + 1 :] = [""] * (n - shared)
            for place in range(1, n) if n > SHORT else ():
                if costs[place] is None:
                    settle(place)
            if n and costs[n] is None:
                settle(n)
            if costs[n] == math.inf:
                raise ValueError("no path reaches the end of a stretch")
            symbols, at = [], n
            while at:
                symbols.append(last[at])
                at -= len(last[at])
            return symbols[::-1]

        return search

    def _of_stretches(self, stretches: pa.StringArray) -> pa.ListArray:
        names, search, paths = strings(stretches), self._searcher(), {}
        for name in sorted(names):
            if self.joins.pairs > KEPT_JOINS:
                self.joins.clear()
                self.joins.pairs = 0
            paths[name] = np.array(self._ids(search(name)), dtype="<i4").tobytes()
        return id_lists([paths[name] for name in names])

    def normalised(self, text: str) -> str:
        if self.rewriter:
            text = self.rewriter.rewrite(text)
        if self.squeezes:
            text = re.sub(" {2,}", " ", text.strip(" "))
        return self.prefix + text.replace(" ", MARK) if text else ""

    def encode_all(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text. Texts are cut at word marks, and each different part once into stretches; those with marks side by side are cut into stretches."""
        texts, find = list(map(self.normalised, texts)), self.stretches.findall
        tied = np.array([MARK + MARK in t or FIRST in t for t in texts], dtype=bool)
        apart = self.kept.together(find(texts[k]) for k in np.flatnonzero(tied))
        plain = pa.array([t for t, k in zip(texts, tied, strict=True) if not k], type=pa.string())
        del texts
        cut = pc.split_pattern(pc.binary_join_element_wise(FIRST, plain, ""), MARK)
        ends, coded = np.asarray(cut.offsets), cut.flatten().dictionary_encode()
        del plain, cut
        parts = self.kept.together(find(w[1:] if w[:1] == FIRST else MARK + w) for w in strings(coded.dictionary))
        found = [regrouped(parts.take(coded.indices), ends), apart]
        return pa.concat_arrays(found).take(pa.array(np.argsort(np.argsort(tied, kind="stable"))))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        return np.asarray(self.encode_all([text]).values).astype("<i4").tobytes()

    def decode(self, ids: list[int]) -> str:
        out = self.out
        text = b"".join([out[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) per row: piece ids of the whole text; null and empty texts give an empty list, repeated rows stay. A text of any length is
    encoded as a whole; an empty table gives no rows; further columns, whatever their names, are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(model_path)
        for batch in of_size(batches, TEXTS):
            lists = own.encode_all(strings(batch.column(1)))
            at = 0
            for sizes in in_portions(pc.list_value_length(lists).to_pylist(), int, PORTION // 4):
                until = at + len(sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:until], pa.concat_arrays([lists[at:until]])], names=["doc_id", "ids"])
                at = until

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(tidied(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, text): the text that the ids stand for; null lists read as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(model_path)
        for batch in batches:
            at = 0
            values, ends = np.asarray(batch.column(1).values), np.asarray(batch.column(1).offsets).tolist()
            spans = list(zip(ends[:-1], ends[1:], strict=True))
            for portion in in_portions(spans, lambda s: s[1] - s[0], PORTION // 4):
                texts = [own.decode(values[a:b].tolist()) for a, b in portion]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(texts, type=pa.string())], names=["doc_id", "ids", "text"])
                at += len(texts)

    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(encoded: DataFrame, model_path: str) -> DataFrame:
    """Per row of ``encode``: numbers of pieces and of byte pieces, CRC-32 of the ids (little-endian 32-bit), SHA-256 of the text
    that they decode to. Decoded and hashed by one worker, so texts don't travel again; null lists read as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(model_path)
        for batch in batches:
            values, ends = np.ascontiguousarray(np.asarray(batch.column(1).values), dtype="<i4"), np.asarray(batch.column(1).offsets)
            spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            raw = memoryview(values).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans]
            sha = [hashlib.sha256(own.decode(values[a:b].tolist()).encode()).hexdigest() for a, b in spans]
            fallback = np.concatenate([[0], np.cumsum(own.bytes_of[values])])[ends]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(np.diff(fallback).astype(np.int64)), pa.array(crc, type=pa.int64()), pa.array(sha, type=pa.string())],
                names=["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_sha256"],
            )

    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string")


def _model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(encode(docs, _model()), _model())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: what the encoder makes of each row, with a digest of the ids; rows as in ``encode``."""
    return digests(encode(docs, _model()), _model())
