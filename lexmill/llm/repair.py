"""Token ids in binary shards under Re-Pair grammar compression.

Documents are sorted by id over range partitions, tokenized, and cut into shards of
about ``shard_tokens`` ids.  In each shard the frequent pairs of neighbouring symbols
are replaced by nonterminals, pass after pass, until no pair occurs 16 times; pairs never
cross a document's end.  A shard is one Parquet row:

    part, shard        its place: parts and shards ascend with the ids
    base               smallest nonterminal (terminals are below it)
    doc_ids, lengths   per document: id, tokens with the end id
    symbols            per document: symbols after compression
    rules              little-endian uint32 pairs; the n-th is what nonterminal base + n stands for
    spans              little-endian uint32: terminals under each nonterminal
    width, sequence    little-endian symbols of 2 bytes where all fit, else 4

``spans`` lets a reader skip to any token: symbols before it are passed by adding their
spans, and only nonterminals that reach into the wanted range are opened.

Spark's writer commits whole files, so a lost executor's shard is written again; no file
is touched outside it.

Defined cases: a null text is the empty text (its end id alone); null ids sort first;
repeated rows are documents of their own, ties of id ordered by text; an empty table
gives an empty archive; a document longer than a shard makes a shard of its own; extra
columns are ignored.
"""

from __future__ import annotations

import gc
import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import fresh_path, small_batches, text_or_empty

END_ID, SHARD_TOKENS = 1, 1 << 18
RULES_A_PASS, LEAST_COUNT = 1024, 16
_BUCKETS = 1 << 18
_LEFT, _RIGHT, _SHIFT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(32 - 18)
_CACHED_WORDS = 400_000
_LATIN_END = "\u0250"  # letters below it are precomposed, and fold case one by one
_STOPS = frozenset(b",.;:!?")

SHARD = "part int, shard int, base int, width int, n_tokens bigint, doc_ids array<bigint>, lengths array<int>, symbols array<int>, rules binary, spans binary, sequence binary"


def _byte_alphabet() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ALPHABET = _byte_alphabet()


# The pipeline of vocabularies that lower-case and take runs of letters, single digits and runs of other marks as words.
_WORD_PIPELINE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None, "truncation": None, "padding": None,
}


def by_words(description: str) -> bool:
    """Whether a tokenizer (its JSON) gives a text the ids of its white-space words one after another, as _WORD_PIPELINE does."""
    d = json.loads(description)
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not any(map(str.isspace, t["content"])) for t in d["added_tokens"])
    return plain and d["model"]["type"] == "BPE" and not d["model"]["dropout"] and all(d[k] == v for k, v in _WORD_PIPELINE.items())


class WordTokenizer(dict):
    """Ids by the tokenizers library: word -> its ids, packed in 2 bytes each where all fit, else 4.

    Where the vocabulary's pipeline is known to part at white space (``by_words``), texts are
    encoded word by word: words met lately are kept, and those met before them until the next
    change.  With any other pipeline the library encodes whole texts.  With ``added`` the vocabulary's added
    tokens, such as <|endoftext|>, are matched as the library does by default.
    """

    def __init__(self, path: str, added: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker per core already
        from tokenizers import Tokenizer

        super().__init__()
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = not added
        self.word_by_word = by_words(self.model.to_str())
        self.merges = self.model.model.tokenize
        self.base = self.model.get_vocab_size(with_added_tokens=True)
        self.kind = "H" if self.base <= 1 << 16 else "I"
        self.older: dict[bytes, bytes] = {}
        self.stops = {c: array(self.kind, self.model.encode(chr(c), add_special_tokens=False).ids).tobytes() for c in _STOPS}

    def __missing__(self, word: bytes) -> bytes:
        """Ids of a word not met lately.

        Latin letters in lower case, and a stop after them, are as the vocabulary's normaliser
        and splitter would leave them, so their byte alphabet goes to its BPE model at once,
        unless the word is known in lower case and without the stop.
        """
        ids = self.older.get(word)
        if ids is None:
            stop = word[-1] in _STOPS
            core = word[:-1] if stop else word
            if core.isalpha():
                lower = core.lower()
            else:
                text = core.decode("utf-8")
                folded = text.lower()
                lower = folded.encode("utf-8") if text.isalpha() and folded.isalpha() and max(text) < _LATIN_END else b""
            if not lower:
                ids = array(self.kind, self.model.encode(word.decode("utf-8"), add_special_tokens=False).ids).tobytes()
            else:
                ids = (self.get(lower) or self.older.get(lower)) if lower != word else None
                if ids is None:
                    ids = array(self.kind, [t.id for t in self.merges(lower.decode("latin-1").translate(_ALPHABET))]).tobytes()
                if stop:
                    ids += self.stops[word[-1]]
        self[word] = ids
        return ids

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each UTF-8 text."""
        if not self.word_by_word:
            return [np.array(e.ids, self.kind) for e in self.model.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)]
        if len(self) >= _CACHED_WORDS:
            self.older = dict(self)  # those before are forgotten
            self.clear()
        return [np.frombuffer(b"".join(map(self.__getitem__, t.split())), self.kind) for t in texts]


@cache
def tokenizer(path: str, added: bool = False) -> WordTokenizer:
    """One tokenizer per worker process; its table lives on, so the collector need not walk it often."""
    gc.set_threshold(200_000, 50, 100)
    return WordTokenizer(path, added)


def compress(ids: np.ndarray, ends: np.ndarray, base: int, passes: int | None = None, rules_a_pass: int = RULES_A_PASS, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, rules, spans, symbols per document) of the ids of a shard.

    ``ends``: running sums of the documents' tokens.  Every pass counts all pairs, makes
    nonterminals of the most frequent, and replaces them left to right; passes go on, unless
    ``passes`` bounds them, until no pair occurs ``least`` times.
    """
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[ends[ends > 0] - 1] = True
    rules = np.empty((0, 2), np.int64)
    spans = np.empty(0, np.int64)
    n_passes = 0
    while len(seq) > 1 and n_passes != passes:
        n_passes += 1
        bucket = (seq[:-1] * _LEFT + seq[1:] * _RIGHT) >> _SHIFT
        bucket[last[:-1]] = 0
        heavy = np.bincount(bucket, minlength=_BUCKETS) >= least  # a pair in a light bucket can't be frequent
        heavy = heavy[bucket] & ~last[:-1]
        at = np.flatnonzero(heavy)
        code = (seq[at].astype(np.int64) << 32) | seq[at + 1]
        pairs, counts = np.unique(code, return_counts=True)
        good = np.flatnonzero(counts >= least)
        if not len(good):
            break
        good = good[np.argsort(-counts[good], kind="stable")[:rules_a_pass]]
        chosen = pairs[good]
        # A rule is found by its bucket; of two in one bucket the rarer waits for the next pass.
        own = ((chosen >> 32).astype(np.uint32) * _LEFT + (chosen & 0xFFFFFFFF).astype(np.uint32) * _RIGHT) >> _SHIFT
        by_bucket = np.full(_BUCKETS, -1, np.int32)
        by_bucket[own[::-1]] = np.arange(len(own), dtype=np.int32)[::-1]
        alone = by_bucket[own] == np.arange(len(own))
        chosen = chosen[alone]
        by_bucket[own[alone]] = np.arange(len(chosen), dtype=np.int32)
        rule = by_bucket[bucket[at]]
        hit = (rule >= 0) & (chosen[rule] == code)
        where, rule = at[hit], rule[hit]
        # Of a run of overlapping hits every second is taken, from its first on.
        starts = np.r_[True, np.diff(where) > 1]
        first = where[starts][np.cumsum(starts) - 1]
        odd = (where - first) % 2 == 0
        take, rule = where[odd], rule[odd]
        pair = np.stack([chosen >> 32, chosen & 0xFFFFFFFF], 1)
        width = np.ones(pair.shape, np.int64)
        deep = pair >= base
        width[deep] = spans[pair[deep] - base]
        seq[take] = base + len(rules) + rule
        rules, spans = np.concatenate([rules, pair]), np.concatenate([spans, width.sum(1)])
        last[take] = last[take + 1]
        keep = np.ones(len(seq), bool)
        keep[take + 1] = False
        seq, last = seq[keep], last[keep]
    stops = np.flatnonzero(last) + 1
    symbols = np.zeros(len(ends), np.int64)
    lengths = np.diff(np.r_[0, ends])
    symbols[lengths > 0] = np.diff(np.r_[0, stops])
    return seq.astype("<u4"), rules.astype("<u4"), spans.astype("<u4"), symbols


def _open(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The terminals of a short sequence: nonterminals are opened level by level."""
    seq = seq.astype(np.int64)
    while (opened := seq >= base).any():
        width = np.where(opened, 2, 1)
        start = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int64)
        out[start[~opened]] = seq[~opened]
        out[start[opened]] = rules[seq[opened] - base, 0]
        out[start[opened] + 1] = rules[seq[opened] - base, 1]
        seq = out
    return seq


def expand(seq: np.ndarray, rules: np.ndarray, base: int, spans: np.ndarray | None = None) -> np.ndarray:
    """The terminals of a sequence.  With ``spans`` every rule is opened once, and copied where it stands."""
    if spans is None or not len(rules):
        return _open(seq, rules, base).astype("<u4")
    table = _open(np.arange(base, base + len(rules)), rules, base).astype("<u4")
    spans = spans.astype(np.int64)
    opened = np.flatnonzero(seq >= base)
    which = seq[opened].astype(np.int64) - base
    extra = spans[which] - 1
    place = np.arange(len(seq))
    shift = np.zeros(len(seq) + 1, np.int64)
    shift[opened + 1] = extra
    place += np.cumsum(shift[:-1])
    out = np.empty(len(seq) + int(extra.sum()), "<u4")
    out[place] = seq
    width = extra + 1
    inner = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
    out[np.repeat(place[opened], width) + inner] = table[np.repeat((np.cumsum(spans) - spans)[which], width) + inner]
    return out


def sequence_of(shard: dict) -> np.ndarray:
    return np.frombuffer(shard["sequence"], f"<u{shard['width']}").astype("<u4")


def read_range(shard: dict, start: int, stop: int) -> np.ndarray:
    """Tokens [start, stop) of a shard, opening only the nonterminals that reach into them."""
    base = shard["base"]
    rules = np.frombuffer(shard["rules"], "<u4").reshape(-1, 2)
    spans = np.frombuffer(shard["spans"], "<u4").astype(np.int64)
    seq = sequence_of(shard).astype(np.int64)
    width = np.ones(len(seq), np.int64)
    if len(spans):
        width = np.where(seq < base, 1, spans[np.maximum(seq - base, 0)])
    ends = np.cumsum(width)
    first, past = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    skipped = int(ends[first - 1]) if first else 0
    return expand(seq[first:past], rules, base)[start - skipped : stop - skipped]


def _write(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words = TaskContext.get().partitionId(), tokenizer(path, added=True)
        end = np.array([end_id], words.kind)
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        n_held = n_shards = 0

        def close() -> pa.RecordBatch:
            seq, rules, spans, symbols = compress(np.concatenate(held), np.cumsum(lengths), words.base)
            width = 2 if words.base + len(rules) <= 1 << 16 else 4
            row = {
                "part": part, "shard": n_shards, "base": words.base, "width": width, "n_tokens": sum(lengths), "doc_ids": list(doc_ids), "lengths": list(lengths),
                "symbols": symbols.tolist(), "rules": rules.tobytes(), "spans": spans.tobytes(), "sequence": seq.astype(f"<u{width}").tobytes(),
            }
            held.clear()
            doc_ids.clear()
            lengths.clear()
            return pa.RecordBatch.from_pylist([row], _SCHEMA)

        for b in batches:
            for at in range(0, len(b), 500):
                ids, texts = b.column(0).slice(at, 500).to_pylist(), b.column(1).slice(at, 500).cast(pa.binary()).to_pylist()
                for i, tokens in zip(ids, words.encode(texts), strict=True):
                    held += (tokens, end)
                    lengths.append(len(tokens) + 1)
                    doc_ids.append(i)
                    n_held += len(tokens) + 1
                    if n_held >= shard_tokens:
                        yield close()
                        n_held, n_shards = 0, n_shards + 1
        if held:
            yield close()

    return run


_SCHEMA = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("base", pa.int32()), ("width", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int32())), ("symbols", pa.list_(pa.int32())), ("rules", pa.binary()), ("spans", pa.binary()), ("sequence", pa.binary()),
])


def write_token_shards(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> str:
    """Write the ids of all documents below ``path`` in ascending doc_id order; returns ``path``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_write(vocabulary, end_id, shard_tokens), SHARD).write.parquet(path)
    return path


_INDEX = ["part", "shard", "base", "width", "doc_ids", "lengths", "rules", "spans", "sequence"]


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        small = b.select([c for c in _INDEX if c not in ("doc_ids", "lengths")]).to_pylist()
        for i, shard in enumerate(small):
            ids = expand(sequence_of(shard), np.frombuffer(shard["rules"], "<u4").reshape(-1, 2), shard["base"], np.frombuffer(shard["spans"], "<u4"))
            doc_ids = b.column(_INDEX.index("doc_ids"))[i].values
            lengths = b.column(_INDEX.index("lengths"))[i].values.to_numpy().astype(np.int64)
            ends = np.cumsum(lengths)
            raw = memoryview(ids).cast("B")
            cuts = [0, *(4 * ends).tolist()]
            crc = [zlib.crc32(raw[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, shard["part"], np.int32)), pa.array(np.full(n, shard["shard"], np.int32)), doc_ids, pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files.

    ``start`` counts the ids of all documents before: sums over the parts (as many as
    range partitions), over a part's shards, and inside a shard.
    """
    small_batches(spark)
    shards = spark.read.schema(SHARD).parquet(path)
    sizes = shards.select("part", "shard", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("shard_start")).join(parts, "part").select(
        "part", "shard", (F.col("part_start") + F.col("shard_start")).alias("first")
    )
    docs = shards.select(*_INDEX).mapInArrow(_decoded, "part int, shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    spark = docs.sparkSession
    return read_token_index(spark, write_token_shards(docs, vocabulary, fresh_path(spark, "tokens")))
