"""Token counts without token ids.

The tokenizer never merges across pre-tokens, so a document's count is the sum over its pre-tokens. Tasks count the pre-tokens of
their documents; a pre-token that is itself a vocabulary entry is one piece and is summed on the spot (the vocabulary is a
fixed table). Of the others a task emits, per pre-token and block of documents, one row with its list of (document, frequency).
These rows are dealt and sorted by pre-token, so each distinct one is encoded once, where its lists are, and joined to them in
place: only lists travel, once, and neither counts nor ids do. The products are added up per block, and the blocks' parts
per document.

Hot words: a block has at most BLOCK_DOCS documents, so a list is at most 96 KB; all rows are dealt by 1,024 input partitions at a
time, and within those the rows of long lists are salted by block, which costs such a word up to SALTS encodings there instead of
one. So a word's rows in a task are bounded by the blocks of 1,024 partitions. Nothing is broadcast.

Texts with a special string inside are counted by the library directly, as such strings stand outside the pre-tokens; so are texts
with a character that the pattern engine, which follows a newer Unicode version, classes differently. Edge cases:
null and empty texts have no tokens; null ids and repeated rows are counted like any row; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import tokenizing

BLOCK_DOCS = 32_768
BLOCK_CHARS = 16_000_000
LONG_LIST, SALTS = 256, 64
#: What a task adding up lists holds at most: sums of so many blocks (256 KB each), rows and bytes of lists.
MOST_SUMS, HELD_ROWS, HELD_BYTES = 128, 200_000, 16_000_000
#: A blank before white space: there pre-tokens may reach over the blank, and the text is not split at blanks first.
LOOSE = re.compile(r" (?=\s)")
POSTING = "slot long, piece string, salt int, list binary"
#: A document inside a row of documents: its id and whether that is null, bytes of text, pieces known at once.
OWN = np.dtype([("doc_id", "<i8"), ("missing", "u1"), ("n_bytes", "<i8"), ("known", "<i8")])


@cache
def _pattern():
    import regex

    return regex.compile(tokenizing.PRE_TOKEN)


@cache
def single_pieces(path: str) -> frozenset[str]:
    """The vocabulary entries that are text."""
    out = []
    for token in tokenizing.byte_level(path)._mergeable_ranks:
        try:
            out.append(token.decode("utf-8"))
        except UnicodeDecodeError:
            continue
    return frozenset(out)


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Block:
    """Documents of a task until they are posted. A document is kept as its distinct chunks (stretches from blank to blank,
    which begin with the blank as pre-tokens do) and their frequencies; chunks are cut into pre-tokens once per block."""

    def __init__(self, path: str, unlike: str = ""):
        self.plain = frozenset(unlike).isdisjoint  # thousands of characters: a pattern would try them one by one
        self.path, self.known, self.special = path, single_pieces(path), tokenizing.special_strings(path)
        self.find = _pattern().findall
        self.reset()

    def reset(self) -> None:
        self.rows, self.chunks, self.chars = [], Numbers(), 0
        self.which, self.times, self.sizes = [], [], []

    def add(self, doc_id, text: str) -> None:
        known, seen = 0, Counter()
        strange = not text.isascii() and not self.plain(text)
        if strange or any(s in text for s in self.special):
            known = len(tokenizing.library(self.path).encode(text, add_special_tokens=False).ids)
        elif text:
            first, *rest = [text] if LOOSE.search(text) else text.split(" ")
            seen = Counter(rest)
            seen[(first,)] = 1
        self.which.append(np.fromiter(map(self.chunks.__getitem__, seen), np.int64, len(seen)))
        self.times.append(np.fromiter(seen.values(), np.int64, len(seen)))
        self.sizes.append(len(seen))
        self.rows.append((doc_id, len(text.encode()), known))
        self.chars += len(text)

    def cut(self) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The pre-tokens that need counting, and per chunk its known pieces, the end of its codes, and all codes."""
        codes, known, ends, flat = Numbers(), [], [], []
        for chunk in self.chunks:
            sure = 0
            for p in self.find(" " + chunk if isinstance(chunk, str) else chunk[0]):
                if p in self.known:
                    sure += 1
                else:
                    flat.append(codes[p])
            known.append(sure)
            ends.append(len(flat))
        return list(codes), np.array(known, np.int64), np.array(ends, np.int64), np.array(flat, np.int64)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_DOCS or self.chars >= BLOCK_CHARS

    def post(self, slot: int):
        """Batches of the block's rows: its documents (no piece), then one row per pre-token with its list of (document,
        frequency); an entry takes three bytes, and a frequency above 255 several entries."""
        names = ["slot", "piece", "salt", "list"]
        codes, known, ends, flat = self.cut()
        which, times = np.concatenate(self.which), np.concatenate(self.times)
        doc = np.repeat(np.arange(len(self.rows)), self.sizes)
        own = np.zeros(len(self.rows), OWN)
        own["doc_id"] = [d or 0 for d, _, _ in self.rows]
        own["missing"] = [d is None for d, _, _ in self.rows]
        own["n_bytes"] = [n for _, n, _ in self.rows]
        own["known"] = np.bincount(doc, known[which] * times, len(own)) + [k for _, _, k in self.rows]
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.nulls(1, pa.string()), pa.array([slot % 8191], pa.int32()),
                                          pa.array([own.tobytes()], pa.binary())], names)
        if not codes:
            return
        n = np.diff(ends, prepend=0)[which]
        first = (ends - np.diff(ends, prepend=0))[which]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        key, times = flat[place] << 16 | np.repeat(doc, n), np.repeat(times, n)
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, times = key[start], np.add.reduceat(times, start)
        more = -(-times // 255)
        if (more > 1).any():
            spread = np.repeat(np.arange(len(key)), more)
            nth = np.arange(len(spread)) - np.repeat(np.cumsum(more) - more, more)
            key, times = key[spread], np.minimum(times[spread] - 255 * nth, 255)
        entry = np.empty((len(key), 3), np.uint8)
        entry[:, 0], entry[:, 1], entry[:, 2] = key & 255, key >> 8 & 255, times
        size = np.bincount(key >> 16, minlength=len(codes))
        salt = ((slot >> 34) * (SALTS + 1) + np.where(size > LONG_LIST, slot % SALTS, SALTS)).astype(np.int32)
        pieces = pa.array(codes, pa.string())
        lists = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(
            np.concatenate([[0], 3 * np.cumsum(size)]).astype("<i4").tobytes()), pa.py_buffer(entry.tobytes())])
        for lo in range(0, len(pieces), 10_000):
            n = min(10_000, len(pieces) - lo)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, slot), pa.int64()), pieces.slice(lo, n),
                                              pa.array(salt[lo:lo + n]), lists.slice(lo, n)], names)


def postings(docs: DataFrame, path: str) -> DataFrame:
    """Rows of two kinds: one per document (bytes and the pieces counted at once), one per pre-token and block."""

    unlike = tokenizing.unlike(path)

    def run(batches):
        block, slot = Block(path, unlike), TaskContext.get().partitionId() << 24
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                block.add(doc_id, text or "")
                if block.full():
                    yield from block.post(slot)
                    block.reset()
                    slot += 1
        if block.rows:
            yield from block.post(slot)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, POSTING)


def _parts(dealt: DataFrame, path: str) -> DataFrame:
    """(slot, docs, sums) from rows sorted by pre-token: each pre-token's count times its lists, added up per block as far as a
    task sees them. Rows of documents pass through with null docs."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        held, rows, size = [], 0, 0

        def add():
            slots = np.concatenate([h[0] for h in held])
            data = np.frombuffer(b"".join(h[1] for h in held), np.uint8).reshape(-1, 3)
            n = np.concatenate([h[2] for h in held])
            docs = data[:, 0].astype(np.int64) | data[:, 1].astype(np.int64) << 8
            gain = data[:, 2].astype(np.int64) * np.repeat(np.concatenate([h[3] for h in held]), n)
            names, of = np.unique(slots, return_inverse=True)
            of = np.repeat(of, n)
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(len(names) + 1))
            for i, name in enumerate(names.tolist()):
                pick = order[cuts[i]:cuts[i + 1]]
                got = np.bincount(docs[pick], gain[pick], BLOCK_DOCS).astype(np.int64)
                sums[name] = sums[name] + got if name in sums else got
                if len(sums) >= MOST_SUMS:
                    yield from flush()
            held.clear()

        def flush():
            for name, acc in sums.items():
                docs = np.flatnonzero(acc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name], pa.int64()), pa.array([docs.astype("<u2").tobytes()], pa.binary()),
                     pa.array([acc[docs].astype("<u4").tobytes()], pa.binary())], ["slot", "docs", "sums"])
            sums.clear()

        tokenizer, last = tokenizing.library(path), (None, 0)
        for batch in batches:
            own = batch.filter(batch.column("piece").is_null())
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column("slot"), pa.nulls(own.num_rows, pa.binary()), own.column("list")],
                                                 ["slot", "docs", "sums"])
                batch = batch.filter(batch.column("piece").is_valid())
                if not batch.num_rows:
                    continue
            pieces = batch.column("piece").dictionary_encode()
            distinct = pieces.dictionary.to_pylist()
            new = [p for p in distinct if p != last[0]]
            sizes = dict(zip(new, (len(e.ids) for e in tokenizer.encode_batch_fast(new, add_special_tokens=False))))
            sizes.setdefault(*last)
            tokens = np.array([sizes[p] for p in distinct], np.int64)[pieces.indices.to_numpy()]
            last = (distinct[-1], sizes[distinct[-1]])  # the rows are sorted, so only this one can come again
            lists = batch.column("list")
            n = np.diff(np.frombuffer(lists.buffers()[1], np.int32)[lists.offset:lists.offset + len(lists) + 1])
            held.append((batch.column("slot").to_numpy(), b"".join(lists.to_pylist()), n // 3, tokens))
            rows, size = rows + batch.num_rows, size + len(held[-1][1])
            if rows >= HELD_ROWS or size > HELD_BYTES:
                yield from add()
                rows = size = 0
        if held:
            yield from add()
        yield from flush()

    return dealt.select("slot", "piece", "list").mapInArrow(run, "slot long, docs binary, sums binary")


def _totals(parts: DataFrame) -> DataFrame:
    """The documents of each block with its parts added up, one block at a time."""

    def run(batches):
        name, acc, own = None, None, None

        def out():
            docs = np.concatenate(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs["doc_id"], pa.int64(), mask=docs["missing"].astype(bool)), pa.array(docs["n_bytes"], pa.int64()),
                 pa.array(docs["known"] + acc[:len(docs)], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

        for batch in batches:
            for slot, docs, sums in zip(*[batch.column(c).to_pylist() for c in ("slot", "docs", "sums")]):
                if slot != name:
                    if name is not None:
                        yield from out()
                    name, acc, own = slot, np.zeros(BLOCK_DOCS, np.int64), []
                if docs is None:
                    own.append(np.frombuffer(sums, OWN))
                else:
                    acc[np.frombuffer(docs, "<u2")] += np.frombuffer(sums, "<u4")
        if name is not None:
            yield from out()

    dealt = parts.repartition("slot").sortWithinPartitions("slot")
    return dealt.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens."""
    dealt = postings(docs, path).repartition("piece", "salt").sortWithinPartitions("piece")
    return _totals(_parts(dealt, path))
