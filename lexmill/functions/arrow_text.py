"""Tokens of Arrow batches, cut by array operations on their bytes: what ``text.tokens`` gives, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text makes a slice of its own.
SLICE = 1 << 18
#: Rows (term, count) that a task holds back at most; Spark adds up before the shuffle what comes in parts.
HELD_TERMS = 1 << 18
#: The lower-cased byte of those that tokens are made of, else 0.
_LOWER = np.zeros(256, np.uint8)
for _from, _to in (("abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")):
    _LOWER[np.frombuffer(_from.encode(), np.uint8)] = np.frombuffer(_to.encode(), np.uint8)
#: The only other letters whose lower case has an ASCII letter: dotted capital I (i and a mark, which parts words) and the Kelvin sign.
_TO_ASCII = (("İ", "i "), ("K", "k"))


def slices(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about SLICE bytes of text; null texts are empty."""
    field = batch.schema.field(column).with_type(pa.string())
    upto = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))]
    first = 0
    while first < len(batch):
        past = max(first + 1, int(np.searchsorted(upto, upto[first] + SLICE, "right")) - 1)
        b = batch.slice(first, past - first)  # only a slice's texts are copied, not the batch's
        yield b.set_column(column, field, pc.fill_null(b.column(column).cast(pa.string()), ""))
        first = past


def text_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all texts, where each begins and the last ends)."""
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(inside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where runs of true values begin; a text's first value begins one."""
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    before[at[at < len(inside)]] = False
    return np.flatnonzero(inside & ~before)


def cut_tokens(texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """(number of tokens of each text, the tokens of all)."""
    raw, at = text_bytes(texts)
    held = raw.tobytes()
    if any(c.encode() in held for c, _ in _TO_ASCII):
        for c, low in _TO_ASCII:
            texts = pc.replace_substring(texts, c, low)
        raw, at = text_bytes(texts)
    low = _LOWER[raw]
    inside = low != 0
    starts = runs(inside, at)
    place = np.cumsum(inside, dtype=np.int32)[starts] - 1
    kept = low[inside]
    offsets = np.r_[place, len(kept)].astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept))
    return np.diff(np.searchsorted(starts, at)), tokens


def cut_buckets(texts: pa.StringArray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of tokens of each text, the tokens' buckets by the first six hex digits of their MD5)."""
    length, tokens = cut_tokens(texts)
    coded = tokens.dictionary_encode()
    of = np.array([int.from_bytes(md5(t.encode(), usedforsecurity=False).digest()[:3], "big") % buckets for t in coded.dictionary.to_pylist()], np.int64)
    return length, of[coded.indices.to_numpy()]


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, df, tokens of a task's texts (column text): how many have a term; the row without a term counts the texts and their tokens."""
    schema = pa.schema([("term", pa.string()), ("df", pa.int64()), ("tokens", pa.int64())])
    held: list[pa.Table] = []
    n = n_tokens = rows = 0

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("term").aggregate([("df", "sum")]).rename_columns(["term", "df"])

    def out(t: pa.Table) -> list[pa.RecordBatch]:
        return t.append_column("tokens", pa.nulls(len(t), pa.int64())).select(schema.names).cast(schema).to_batches()

    for whole in batches:
        for b in slices(whole, 0):
            length, tokens = cut_tokens(b.column(0))
            n, n_tokens = n + len(b), n_tokens + int(length.sum())
            if not len(tokens):
                continue
            coded = tokens.dictionary_encode()
            width = len(coded.dictionary)
            met = np.unique(np.repeat(np.arange(len(b)), length) * width + coded.indices.to_numpy())
            held.append(pa.table({"term": coded.dictionary, "df": np.bincount(met % width, minlength=width)}))
            rows += width
            if rows > HELD_TERMS:
                held = [summed()]
                rows = len(held[0])
                if rows > HELD_TERMS // 2:
                    yield from out(held[0])
                    held, rows = [], 0
    if held:
        yield from out(summed())
    yield from pa.table({"term": [None], "df": [n], "tokens": [n_tokens]}, schema).to_batches()


_POWERS: dict[str, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15
_RUN = np.uint64(0xBF58476D1CE4E5B9)
#: White space that parts words, as in ``text.ws_tokens``.
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\f\r")] = True


def _powers(name: str, base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(name, ())) < n:
        _POWERS[name] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, SLICE) - 1, base, np.uint64)], dtype=np.uint64)
    return _POWERS[name][:n]


def word_hashes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(number of white-space words of each text, a hash of each word of all): equal words have equal hashes."""
    raw, at = text_bytes(texts)
    inside = ~_BLANK[raw]
    starts = runs(inside, at)
    after = np.zeros(len(raw), bool)
    if len(raw):
        after[:-1] = inside[1:]
        ends_here = at[1:] - 1
        after[ends_here[ends_here >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, len(raw)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers("down", pow(_BASE, -1, 1 << 64), len(raw))[starts]
    return np.diff(np.searchsorted(starts, at)), h ^ (h >> np.uint64(29))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` word hashes, in their order."""
    h = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        h = (h * _RUN) + words[k : k + len(h)]
    return (h ^ (h >> np.uint64(31))) * _RUN
