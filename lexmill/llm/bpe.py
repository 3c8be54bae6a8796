"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

The merges are given as token ranks.  Two tokens may stand next to each other in
an encoding exactly if encoding their joined bytes gives the two back, and an
encoding is correct exactly if all its neighbours may.  So the last token of the
encoding of every prefix is fixed, and it is the transducer's output for the byte that ends the prefix.

A state is what the last tokens of longer prefixes depend on: every place from which the
bytes so far are a strict prefix of a vocabulary entry, as the entry's place in the trie of the vocabulary
and the token before it, and the last token itself.  What lies further back isn't part of it, so the
same states come back all the time: of the bytes of new words nine in ten take an arc that
is there already.  States and arcs are made when first taken and kept in a table of MAX_ARCS
arcs, which is emptied when it is full; every byte of every piece that isn't a token is a step of it.

Ids are emitted after a bounded lookahead: at the end of a piece, and in long pieces every
LOOKAHEAD bytes, up to the last boundary through which the ways back from the end and from all open places pass.

Pieces (the matches of the split pattern) are encoded one by one; a piece that is
itself a token is that token, as the rank format defines, and pieces met lately keep their ids.

Decoding joins token bytes, and an incremental UTF-8 machine turns them into text
chunk by chunk: it holds back at most three bytes of an unfinished character.

Defined cases: a null text is the empty text, with no ids; texts of any length are
read as a stream of pieces, whole; lone surrogates can't occur in Spark strings;
equal rows give equal results; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import small_batches

MAX_ARCS, MAX_PIECES = 600_000, 250_000
LOOKAHEAD = 64


def load_ranks(path: str) -> dict[bytes, int]:
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class Transducer:
    """Byte transducer of one vocabulary; arcs are determinised lazily.

    Arcs are held as (state, byte) -> (state after it, rank of the last token), each packed into an integer.
    """

    NONE = -1

    def __init__(self, ranks: dict[bytes, int], max_arcs: int = MAX_ARCS) -> None:
        self.ranks, self.max_arcs = ranks, max_arcs
        self.token = {r: t for t, r in ranks.items()}
        self.length = {r: len(t) for t, r in ranks.items()}
        self.bits = max(ranks.values(), default=0).bit_length()
        #: The trie: (node, byte) -> node; of each node its rank, its depth, and whether it is open.
        self.child: dict[int, int] = {}
        self.rank_at, self.depth, self.open = [self.NONE], [0], [True]
        for t, r in ranks.items():
            node = 0
            for i, byte in enumerate(t, 1):
                self.open[node] = True
                node = self.child.setdefault(node << 8 | byte, len(self.depth))
                if node == len(self.depth):
                    self.rank_at.append(self.NONE)
                    self.depth.append(i)
                    self.open.append(False)
            self.rank_at[node] = r
        self._may: dict[int, bool] = {}
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._edge: dict[tuple[bytes, int], list[tuple[bytes, float]]] = {}
        self._empty()

    def _empty(self) -> None:
        """A table without arcs; state 0 is the start: the root is open, and no token is before it."""
        self.arcs: dict[int, int] = {}
        self.states: list[tuple[tuple[int, int], ...]] = [((0, self.NONE),)]
        self.numbers = {self.states[0]: 0}

    @property
    def n_arcs(self) -> int:
        return len(self.arcs)

    def _number(self, state: tuple[tuple[int, int], ...]) -> int:
        n = self.numbers.setdefault(state, len(self.states))
        if n == len(self.states):
            self.states.append(state)
        return n

    def merge(self, piece: bytes, stop: int = 1) -> list[bytes]:
        """The encoding by the definition: join the pair of least rank, leftmost first, again and again."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > stop:
            pairs = [(self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(pairs)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes ``token``; None for single bytes and what merging can't reach."""
        if token not in self._halves:
            parts = self.merge(token, 2)
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """What stands at the left (0) or right (1) edge of ``token`` while it is merged, with the rank that ends it."""
        known = self._edge.get((token, side))
        if known is None:
            parts = [(token, float("inf"))]
            while (two := self.halves(parts[-1][0])) is not None:
                parts.append((two[side], self.ranks[parts[-1][0]]))
            known = self._edge[token, side] = parts[::-1]
        return known

    def may_follow(self, left: bytes, right: bytes) -> bool:
        """Whether no merge crosses the boundary while both tokens are built side by side."""
        a, b = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            across = self.ranks.get(x + y, float("inf"))
            if across < x_ends and across <= y_ends and across != float("inf"):
                return False
            if x_ends == y_ends == float("inf"):
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def fits(self, rank: int, left: int) -> bool:
        """Whether a token is one that merges lead to and may stand after the token ``left``."""
        pair = (left + 1) << self.bits | rank
        known = self._may.get(pair)
        if known is None:
            token = self.token[rank]
            reached = len(token) == 1 or self.halves(token) is not None
            known = reached and (left == self.NONE or self.may_follow(self.token[left], token))
            if len(self._may) >= self.max_arcs:
                self._may.clear()
            self._may[pair] = known
        return known

    def _arc(self, number: int, byte: int) -> int:
        """Make the arc of a state for a byte.

        The last token is the longest that fits its left neighbour; it starts where the
        bytes so far were open, and the longest of these comes first.
        """
        state = self.states[number]
        if len(self.arcs) >= self.max_arcs:  # the table is full: it is made anew from here on
            self._empty()
            number = self._number(state)
        last, still = self.NONE, []
        for node, left in state:
            after = self.child.get(node << 8 | byte)
            if after is None:
                continue
            if self.open[after]:
                still.append((after, left))
            rank = self.rank_at[after]
            if last == self.NONE and rank != self.NONE and self.fits(rank, left):
                last = rank
        if last == self.NONE:
            raise ValueError("the vocabulary lacks single bytes")
        arc = self.arcs[number << 8 | byte] = self._number((*still, (0, last))) << self.bits | last
        return arc

    def _settled(self, tape: list[int], state: tuple[tuple[int, int], ...]) -> int:
        """The last boundary that holds whatever follows: later tokens start where the input is open, and here their ways back meet."""
        settled = len(tape)
        for node, _ in state:
            at = len(tape) - self.depth[node]
            while at != settled:
                if at > settled:
                    at -= self.length[tape[at - 1]]
                else:
                    settled -= self.length[tape[settled - 1]]
            if not settled:
                break
        return settled

    def _back(self, tape: list[int], at: int) -> list[int]:
        """The encoding of the first ``at`` bytes, from their last tokens."""
        out = []
        while at:
            out.append(tape[at - 1])
            at -= self.length[tape[at - 1]]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        tape: list[int] = []  # the last token of each prefix since the settled boundary
        bits, mask, number = self.bits, (1 << self.bits) - 1, 0
        for lo in range(0, len(piece), LOOKAHEAD):
            if lo and (settled := self._settled(tape, self.states[number])):
                out += self._back(tape, settled)
                del tape[:settled]
            for byte in piece[lo : lo + LOOKAHEAD]:
                arc = self.arcs.get(number << 8 | byte)
                if arc is None:
                    arc = self._arc(number, byte)
                tape.append(arc & mask)
                number = arc >> bits
        return out + self._back(tape, len(tape))


class ByteBpe:
    """Encoder and decoder of a rank file with a split pattern."""

    def __init__(self, path: str, pattern: str, max_pieces: int = MAX_PIECES) -> None:
        import regex

        ranks = load_ranks(path)
        self.fst = Transducer(ranks)
        self.split = regex.compile(pattern).finditer
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, array] = {}  # short pieces met lately, and those met before them
        self.older: dict[str, array] = {}
        self.max_pieces = max_pieces
        self.bytes_of = {i: t for t, i in ranks.items()}

    def encode(self, text: str, stream_over: int = 1 << 16) -> array:
        ids = array("I")
        known, extend = self.known, ids.extend
        found = self.pieces(text) if len(text) <= stream_over else (m.group() for m in self.split(text))
        for piece in found:
            got = known.get(piece)
            if got is None:
                got = self.older.get(piece)
                if got is None:
                    got = array("I", self.fst.encode(piece.encode("utf-8")))
                if len(piece) <= 64:
                    if len(known) >= self.max_pieces:
                        self.older, self.known = known, {}
                        known = self.known
                    known[piece] = got
            extend(got)
        return ids

    def decode_chunks(self, ids: Iterable[int], tokens: int = 8192) -> Iterator[bytes]:
        ids = ids if isinstance(ids, array) else array("I", ids)
        for i in range(0, len(ids), tokens):
            yield b"".join(map(self.bytes_of.__getitem__, ids[i : i + tokens]))


class Utf8Machine:
    """Incremental UTF-8 decoder; what can't be UTF-8 becomes U+FFFD, as in ``bytes.decode(errors="replace")``."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def unfinished(raw: bytes) -> int:
        """How many bytes at the end may be the start of a character."""
        for back in range(1, min(3, len(raw)) + 1):
            lead = raw[-back]
            if lead < 0x80:
                return 0
            if lead >= 0xC0:
                need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
                if back >= need:
                    return 0
                if back >= 2:  # the second byte's range depends on the lead
                    low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                    high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                    if not low <= raw[-back + 1] <= high:
                        return 0
                return back
        return 0

    def feed(self, raw: bytes) -> str:
        raw = self.held + raw
        keep = self.unfinished(raw)
        self.held = raw[len(raw) - keep :]
        return raw[: len(raw) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


@cache
def coder(path: str, pattern: str) -> ByteBpe:
    """One coder per worker process; its tables live on, so the collector need not walk them often."""
    gc.set_threshold(200_000, 50, 100)
    return ByteBpe(path, pattern)


def _little(ids: array) -> bytes:
    import sys

    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def _run(path: str, pattern: str, columns: list[str], digest: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in batches:
            rows = []
            for text in b.column(b.schema.get_field_index("text")).to_pylist():
                ids = bpe.encode(text or "")
                if not digest:
                    rows.append((len(ids), ids))
                    continue
                back, machine, same, at = hashlib.sha256(), Utf8Machine(), True, 0
                for chunk in bpe.decode_chunks(ids):
                    back.update(chunk)
                    part = machine.feed(chunk)
                    same = same and (text or "").startswith(part, at)
                    at += len(part)
                at += len(machine.close())
                rows.append((len(ids), hashlib.sha256(_little(ids)).hexdigest(), back.hexdigest(), same and at == len(text or "")))
            keep = [b.column(b.schema.get_field_index(c)) for c in columns]
            cells = list(zip(*rows, strict=True)) or [()] * (4 if digest else 2)
            if digest:
                made = [pa.array(cells[0], pa.int64()), pa.array(cells[1], pa.string()), pa.array(cells[2], pa.string()), pa.array(cells[3], pa.bool_())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
            else:
                offsets = [0]
                flat = array("I")
                for ids in cells[1]:
                    flat.extend(ids)
                    offsets.append(len(flat))
                made = [pa.array(cells[0], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(memoryview(flat), pa.uint32()).cast(pa.int32()) if flat else pa.array([], pa.int32()))]
                names = ["n_tokens", "ids"]
            yield pa.RecordBatch.from_arrays([*keep, *made], [*columns, *names])

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids of every whole text; no shuffle."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_run(path, pattern, ["doc_id"], False), f"doc_id {kind}, n_tokens bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of what ``encode_documents`` gave, decoded as a stream."""
    kind = dict(encoded.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in batches:
            texts = []
            for ids in b.column(1).to_pylist():
                machine = Utf8Machine()
                texts.append("".join(map(machine.feed, bpe.decode_chunks(ids or []))) + machine.close())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def encode_decode(docs: DataFrame, path: str, pattern: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the ``carried`` columns, n_tokens, ids_sha256, decoded_sha256, round_trip of every whole text; no shuffle."""
    small_batches(docs.sparkSession)
    kinds, kept = dict(docs.dtypes), ["doc_id", *carried]
    return docs.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(
        _run(path, pattern, kept, True), ", ".join(f"{c} {kinds[c]}" for c in kept) + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    )
