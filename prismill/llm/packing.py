"""Documents packed into training windows next to documents that share their rare terms.

Tokenised documents are range-partitioned along a lexical key (a minimum hash of token pairs, so near texts lie together) and
cut into shards of bounded size. Each shard has a BM25 inverted index: a seed document retrieves unused neighbours, which fill
its window greedily; what a window cannot take opens the next one. A partition's last, partly filled window is cut into
sequences of powers of two, so nothing is padded.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from prismill.llm.text import require
from prismill.session import durable

# Words that a task remembers before it drops those not met since the last time, and documents encoded at once.
REMEMBERED, DOCS_AT_ONCE = 300_000, 2_000
# Tokens of a shard, terms of a query, and the usual parameters of BM25.
SHARD, TERMS, K1, B = 1_000_000, 12, 1.2, 0.75
# Signs that are pieces of their own behind letters.
TAILS = frozenset(".,;:!?")
# The commonest of these, where they end a word, behind letters that every edition of Unicode knows.
TAIL = r"([a-z\x{DF}-\x{F6}\x{F8}-\x{17F}\x{430}-\x{45F}])([.,;:!?])([\x09-\x0D\x20]|$)"
# The signs that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_SIGNS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
# The white space, and the borders between pieces, of the vocabulary file that words can be remembered of.
WHITE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZER = [
    {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
find_pieces = regex.compile(PIECES.replace("\\s", WHITE)).findall


def spans(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of `values` with these beginnings and sizes, one behind the other."""
    upto = np.cumsum(size, dtype=np.int64)
    total = int(upto[-1]) if len(upto) else 0
    kind = np.int32 if max(len(values), total) < 2**31 else np.int64
    return values[np.repeat((begin - (upto - size)).astype(kind), size) + np.arange(total, dtype=kind)]


class WordIds:
    """Token ids of texts from remembered words and pieces of words.

    A vocabulary whose rules are those above splits texts into pieces that never cross a blank and that the model encodes one
    by one, so a text's ids are those of its words in turn and a word's ids those of its pieces. With any other vocabulary,
    and for texts that may hold special tokens, whole texts are encoded.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        parts = lambda name, inner: (rules.get(name) or {}).get(inner)
        self.by_words = parts("normalizer", "normalizers") == NORMALIZER and parts("pre_tokenizer", "pretokenizers") == PRE_TOKENIZER and not parts("model", "byte_fallback")
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.store, self.begin = array("I"), array("q", [0])
        self.old: tuple[dict[str, int], array, array] = ({}, self.store, self.begin)

    def age(self) -> None:
        """Words that are not met again before the next ageing are forgotten."""
        old = self.codes, self.store, self.begin
        self.forget()
        self.old = old

    def learn(self, words: list[str]) -> None:
        """Remember words that are not remembered yet, and their pieces."""
        codes, store, begin = self.codes, self.store, self.begin
        old, old_store, old_begin = self.old
        tokenize = self.tokenizer.model.tokenize

        def add(piece: str) -> None:
            sent = piece if piece.isascii() and piece.isprintable() else "".join(map(_SIGNS.__getitem__, piece.encode()))
            store.extend([t.id for t in tokenize(sent)])
            codes[piece] = len(begin) - 1
            begin.append(len(store))

        for word in words:
            code = old.get(word)
            if code is not None:
                store.extend(old_store[old_begin[code] : old_begin[code + 1]])
            elif word.isalpha():
                if word not in codes:  # as a piece of another word
                    add(word)
                continue
            elif not word.isprintable():
                # Python may not know a character yet that the vocabulary's rules take for a letter.
                store.extend(self.tokenizer.encode(word, add_special_tokens=False).ids)
            else:
                base = word[:-1]
                pieces = (base, word[-1]) if word[-1:] in TAILS and base.isalpha() else find_pieces(word)
                for piece in pieces:
                    if piece not in codes:
                        add(piece)
                if word in codes:
                    continue
                for piece in pieces:
                    code = codes[piece]
                    store.extend(store[begin[code] : begin[code + 1]])
            codes[word] = len(begin) - 1
            begin.append(len(store))

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        """Ids of each text, with `end` behind."""
        if not texts:
            return []
        whole = {k for k, t in enumerate(texts) if not self.by_words or "<|" in t}
        if len(self.codes) > REMEMBERED:
            self.age()
        # One letter has another lower case at a word's end in Python than in the vocabulary's rules.
        plain = ["" if k in whole else (t if t.isascii() else unicodedata.normalize("NFC", t).replace("\u03a3", "\u03c3")).lower() for k, t in enumerate(texts)]
        # Signs behind a word are words of their own, so each word is met once, whatever follows it.
        split = pa.compute.ascii_split_whitespace(pa.compute.replace_substring_regex(pa.array(plain, pa.large_string()), TAIL, r"\1 \2\3"))
        seen = split.values.dictionary_encode()
        words = seen.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = list(map(self.codes.get, words))
        unknown = [k for k, code in enumerate(codes) if code is None]
        if unknown:
            self.learn([words[k] for k in unknown])
            for k in unknown:
                codes[k] = self.codes[words[k]]
        codes = np.array(codes, np.int64)
        begins, store = np.frombuffer(self.begin, np.int64), np.frombuffer(self.store, np.uint32)
        # The ids of each word met, close together; the end is a word of its own behind each text.
        begin, size = begins[codes], begins[codes + 1] - begins[codes]
        near = np.append(spans(store, begin, size), np.uint32(end))
        size = np.append(size, 1)
        begin = np.cumsum(size) - size
        ends = split.offsets.to_numpy()[1:]
        met = np.insert(seen.indices.to_numpy(), ends, len(words))
        size = size.astype(np.int32)[met]
        ids = spans(near, begin.astype(np.int32)[met], size)
        upto = np.cumsum(size, dtype=np.int64)
        out = np.split(ids, upto[ends + np.arange(len(ends))][:-1])
        for k in whole:
            out[k] = np.array([*self.tokenizer.encode(texts[k], add_special_tokens=False).ids, end], np.uint32)
        return out


_known: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per Python worker; the words are forgotten where a task ends, the vocabulary stays."""
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


def lexical_key(ids: np.ndarray) -> int:
    """The smallest hash of the token pairs."""
    pairs = ids[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ids[1:].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) if len(ids) > 1 else ids.astype(np.uint64)
    pairs ^= pairs >> np.uint64(29)
    pairs *= np.uint64(0xBF58476D1CE4E5B9)
    return int((pairs ^ (pairs >> np.uint64(32))).min() >> np.uint64(1))


def id_type(path: str, end: int) -> str:
    """The narrowest packed form that holds every id of the vocabulary."""
    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end + 1) <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, path: str, end: int, form: str) -> DataFrame:
    """(id, key, h, ids) of (id, text): ids as packed unsigned numbers of the form `form`."""

    def run(batches: Iterator[pa.RecordBatch]):
        known = word_ids(path)
        try:
            for batch in batches:
                for k in range(0, batch.num_rows, DOCS_AT_ONCE):
                    part = batch.slice(k, DOCS_AT_ONCE)
                    found = known.encode([t or "" for t in part.column("text").to_pylist()], end)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), pa.array([lexical_key(x) for x in found], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64()), pa.array([x.astype(form).tobytes() for x in found], pa.binary())],
                        ["id", "key", "h", "ids"],
                    )
        finally:
            # The worker goes on to other stages, whose memory these would take; most words are met in one task only.
            known.forget()
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, key long, h long, ids binary")


class Index:
    """BM25 over the documents of one shard."""

    def __init__(self, docs: list[np.ndarray]):
        self.n = len(docs)
        sizes = np.array([len(d) for d in docs], np.int64)
        cells, tf = np.unique(np.concatenate(docs).astype(np.int64) * self.n + np.repeat(np.arange(self.n), sizes), return_counts=True)
        term, self.doc = cells // self.n, (cells % self.n).astype(np.int32)
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        df = np.diff(np.append(starts, len(term)))
        code = np.repeat(np.arange(len(starts)), df)
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        self.weight = (idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.doc] / sizes.mean()))).astype(np.float32)
        self.starts = np.append(starts, len(term))
        # A query is made of a document's heaviest terms that others have too.
        useful = np.flatnonzero((df > 1)[code])
        order = useful[np.lexsort((-self.weight[useful], self.doc[useful]))]
        owner = self.doc[order]
        first = np.searchsorted(owner, np.arange(self.n + 1))
        self.terms, self.first = code[order], first

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a query term, best first."""
        scores = np.zeros(self.n, np.float32)
        for term in self.terms[self.first[seed] : min(self.first[seed + 1], self.first[seed] + TERMS)]:
            lo, hi = self.starts[term], self.starts[term + 1]
            scores[self.doc[lo:hi]] += self.weight[lo:hi]
        scores[~unused] = 0
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]


class Packer:
    """Fills windows from one shard after the other; `pieces` are (row, start, length, sequence, offset)."""

    def __init__(self, window: int):
        self.window, self.sequence, self.pieces, self.open = window, 0, [], []
        self.room = window

    def add(self, row: int, size: int, start: int = 0) -> None:
        """Put a document's ids from `start` on into the open window and, as far as need be, into the next ones."""
        while start < size:
            part = min(self.room, size - start)
            self.open.append((row, start, part))
            start, self.room = start + part, self.room - part
            if not self.room:
                self.close()

    def close(self) -> None:
        offset = 0
        for row, start, length in self.open:
            self.pieces.append((row, start, length, self.sequence, offset))
            offset += length
        self.sequence, self.open, self.room = self.sequence + 1, [], self.window

    def finish(self) -> None:
        """Cut the open window into sequences of powers of two, the largest first."""
        rest, total = self.open, self.window - self.room
        while total:
            take, self.open = 1 << (total.bit_length() - 1), []
            total -= take
            while take:
                row, start, length = rest[0]
                part = min(length, take)
                self.open.append((row, start, part))
                take -= part
                rest = rest[1:] if part == length else [(row, start + part, length - part), *rest[1:]]
            self.close()

    def shard(self, rows: list[int], docs: list[np.ndarray]) -> None:
        index, unused = Index(docs), np.ones(len(docs), bool)
        for seed in range(len(docs)):
            if not unused[seed]:
                continue
            unused[seed] = False
            sequence = self.sequence
            self.add(rows[seed], len(docs[seed]))
            if not self.room or self.room == self.window:
                continue
            for near in index.neighbours(seed, unused):
                unused[near] = False
                sequence = self.sequence
                self.add(rows[near], len(docs[near]))
                # The window is full: what follows belongs to the next seed.
                if self.sequence != sequence:
                    break


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end: int = 2, shard: int = SHARD) -> DataFrame:
    """One row per piece: id_col, start, length, ids (packed unsigned 32-bit), doc_tokens, sequence_id, offset.

    * A document is its token ids, without special tokens, and `end`. Null and empty texts are `end` alone.
    * Every id lies in exactly one piece. A sequence holds `window` ids, or a power of two where a partition ends.
    * Rows that repeat an id or a text are packed each. Other columns of `docs` don't matter. No rows: no rows.
    * `tokenizer` is the path of the vocabulary file on every executor.
    """
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    form = id_type(tokenizer, end)
    ready = durable(tokenised(rows, tokenizer, end, form))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        packer, base = Packer(window), TaskContext.get().partitionId() << 40
        held: list[np.ndarray] = []  # of the rows that are not written yet
        ids: list = []
        lost, pending, total = 0, 0, 0  # rows already written, rows of the shard so far, their tokens

        def write():
            nonlocal held, ids, lost
            pieces, packer.pieces = packer.pieces, []
            get = [held[r - lost] for r, *_ in pieces]
            out = [
                pa.array([ids[r - lost] for r, *_ in pieces], batch_kind), pa.array([p[1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([d[p[1] : p[1] + p[2]].astype("<u4").tobytes() for d, p in zip(get, pieces)], pa.binary()), pa.array([len(d) for d in get], pa.int64()),
                pa.array([base + p[3] for p in pieces], pa.int64()), pa.array([p[4] for p in pieces], pa.int64()),
            ]
            keep = min([r for r, *_ in packer.open], default=lost + len(held))
            held, ids, lost = held[keep - lost :], ids[keep - lost :], keep
            return pa.RecordBatch.from_arrays(out, ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def settle():
            nonlocal pending, total
            at = len(held) - pending
            packer.shard([lost + at + i for i in range(pending)], held[at:])
            pending, total = 0, 0

        batch_kind = None
        for batch in batches:
            batch_kind = batch.schema.field("id").type
            for name, raw in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist()):
                held.append(np.frombuffer(raw, form))
                ids.append(name)
                pending, total = pending + 1, total + len(held[-1])
                if total >= shard:
                    settle()
                    yield write()
        if pending:
            settle()
        packer.finish()
        if packer.pieces:
            yield write()

    ordered = ready.repartitionByRange(F.col("key"), F.col("h"), F.col("id")).sortWithinPartitions("key", "h", "id")
    packed = ordered.select("id", "ids").mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
