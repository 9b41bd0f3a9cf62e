"""Cost-balanced packing of documents into token sequences of fixed capacity.

Tasks pack what they read in groups of bounded size; nothing is shuffled. In a group, documents are cut into full
sequences and a rest. Open sequences hold exactly the rests' tokens together, the last ones with capacities that are
powers of two, so that no sequence needs padding. Rests go, longest first, to the sequence of the lowest estimated cost
(linear plus quadratic in each piece's length) that has room; one that fits nowhere is cut at the most room that is left.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import by_value, chunks, per_process, small_batches

CAPACITY = 1024
#: A group is packed once it holds this many tokens; bounds a task's memory and the sequences that a piece chooses from.
GROUP_TOKENS = 1 << 20
#: Cost of a piece: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
END_OF_TEXT = 0

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
#: Texts of these characters only get the same ids from either library; others go to the slower reference tokenizer.
_PLAIN = re.compile("[^\u0000-ɏ -⁯€]")


def tokenizer(name: str = "byte_bpe_50k"):
    """A function from text to the ids of the public byte-level BPE vocabulary.

    The vocabulary's rank file gives the same ids several times faster; texts with characters outside the Latin and
    punctuation blocks, and texts on which the fast path fails, are encoded by the vocabulary's own definition.
    """
    import base64
    import json

    import public_tokenizers
    import tiktoken

    own = public_tokenizers.path(f"{name}.json")
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(own, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def slow():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(own)

    def encode(text: str) -> np.ndarray:
        if not _PLAIN.search(text):
            try:
                return fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # the pattern's backtracking limit, on a very long run of spaces
                pass
        return np.array(per_process(("slow", name), slow).encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def capacities(total: int, capacity: int = CAPACITY) -> list[int]:
    """Sequence capacities that sum to total: full ones, then powers of two."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """Pieces (document, start, length, sequence, offset) for documents of these token counts, and each sequence's cost."""
    pieces, rests, n_full = [], [], 0
    for d, n in enumerate(sizes):
        for s in range(0, n - capacity + 1, capacity):
            pieces.append((d, s, capacity, n_full, 0))
            n_full += 1
        if n % capacity:
            rests.append((n % capacity, d))
    caps = capacities(sum(r for r, _ in rests), capacity)
    room, cost = np.array(caps, dtype=np.int64), np.zeros(len(caps))
    left, used = room.copy(), np.zeros(len(caps), dtype=np.int64)
    for n, d in sorted(rests, key=lambda r: (-r[0], r[1])):
        start = sizes[d] - n
        while n:
            fits = np.flatnonzero(left >= n)
            if len(fits):
                q = int(fits[np.argmin(cost[fits])])
            else:  # cut where most room is left
                q = int(np.argmax(left))
            m = int(min(n, left[q]))
            pieces.append((d, start, m, n_full + q, int(used[q])))
            left[q] -= m
            used[q] += m
            cost[q] += LINEAR * m + QUADRATIC * m * m
            start += m
            n -= m
    return pieces, np.concatenate([np.full(n_full, LINEAR * capacity + QUADRATIC * capacity * capacity), cost])


def pack_batches(batches):
    from pyspark import TaskContext

    encode = per_process("encode", tokenizer)
    task, sequence = TaskContext.get().partitionId(), 0
    ids: list = []
    docs: list[np.ndarray] = []
    held = 0

    def flush():
        nonlocal ids, docs, held, sequence
        pieces, cost = pack([len(x) for x in docs])
        crc = [zlib.crc32(docs[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces]
        base = (task << 33) + sequence
        columns = [
            pa.array([ids[p[0]] for p in pieces], pa.int64()),
            pa.array([p[1] for p in pieces], pa.int64()),
            pa.array([p[2] for p in pieces], pa.int64()),
            pa.array(crc, pa.int64()),
            pa.array([len(docs[p[0]]) for p in pieces], pa.int64()),
            pa.array([base + p[3] for p in pieces], pa.int64()),
            pa.array([p[4] for p in pieces], pa.int64()),
            pa.array([cost[p[3]] for p in pieces], pa.float64()),
        ]
        sequence += len(cost)
        ids, docs, held = [], [], 0
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"])

    for batch in batches:
        for part in chunks(batch, "text"):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                tokens = np.append(encode(text), np.uint32(END_OF_TEXT)) if text else np.array([END_OF_TEXT], np.uint32)
                ids.append(doc_id)
                docs.append(tokens)
                held += len(tokens)
                if held >= GROUP_TOKENS:
                    yield flush()
    if docs:
        yield flush()


def pack_documents(docs: DataFrame) -> DataFrame:
    """A row for each piece: document, start, length and checksum of its ids, sequence, offset there and the sequence's cost.

    Null and empty texts hold the closing id alone; a null doc_id stays null. Repeated rows are packed each. A text of any length is cut into
    sequences. sequence_id is the task's number times 2**33 plus a count. Further columns are ignored; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(pack_batches, SCHEMA)


by_value(__name__)
