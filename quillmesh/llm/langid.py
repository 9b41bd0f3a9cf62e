"""Language identification by unigram pieces, marginalised over segmentations.

Pieces are those of a fixed public vocabulary. Each language has its own piece probabilities, learned by expectation
maximisation from a bounded sample of labelled rows. A word's probability is the sum over all its segmentations, by the
forward algorithm; a text's is the product over its words. Every word of every text counts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_value, chunks, shared, small_batches
from .minhash import mix

#: About this many labelled rows of each language are learned from, chosen by a hash of their id.
SAMPLE_PER_LANG = 300
WORD = re.compile(r"[^\W\d_]+")
ROUNDS = 4
#: Letters of the words that are scored at once, so that arrays stay small however many words there are.
BLOCK_LETTERS = 1 << 17
#: Positions after which running probabilities are scaled back to 1, so that words of any length stay within range.
RESCALE = 8
#: With fewer words than this left, all piece lengths are taken in one step.
FEW = 64
BASE = np.uint64(0x100000001B3)
MARK = "▁"
PIECE = re.compile(rf"{MARK}?[^\W\d_]*")


def text_words(text: str | None) -> list[str]:
    """Lower-case runs of letters, whole; a text without any letter has none."""
    words = WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    # characters such as fractions count as parts of words, but are no letters
    return [x for w in words for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def hash_pieces(pieces: list[str]) -> np.ndarray:
    out = np.zeros(len(pieces), np.uint64)
    for i, p in enumerate(pieces):
        h = 0
        for c in p:
            h = (h * int(BASE) + ord(c)) & (1 << 64) - 1
        out[i] = h
    return mix(out)


class Lookup:
    """Numbers of hashed pieces: tables by different bits of the hash, each with what found no place before."""

    BITS = 18

    def __init__(self, hashes: np.ndarray):
        self.tables, left = [], np.arange(len(hashes))
        shift = 0
        while len(left):
            slot = self.slot(hashes[left], shift)
            _, first = np.unique(slot, return_index=True)
            keys, numbers = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)
            keys[slot[first]], numbers[slot[first]] = hashes[left[first]], left[first]
            self.tables.append((shift, keys, numbers))
            left = np.delete(left, first)
            shift += 11

    def slot(self, h: np.ndarray, shift: int) -> np.ndarray:
        return (h >> np.uint64(shift % 46)).astype(np.int64) & ((1 << self.BITS) - 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        for shift, keys, numbers in self.tables:
            s = self.slot(h, shift)
            hit = keys[s] == h
            out[hit] = numbers[s[hit]]
        return out


class Model:
    """Piece probabilities: row 0 for what is no piece, row 1 for a character that is none, then the pieces."""

    UNKNOWN = 1e-7

    def __init__(self, pieces: list[str], langs: list[str]):
        self.langs, self.hashes = langs, hash_pieces(pieces)
        #: Characters of the longest piece that a word can have, mark included.
        self.longest = max((len(p) for p in pieces if PIECE.fullmatch(p)), default=1)
        self.p = np.full((len(pieces) + 2, len(langs)), 1.0 / max(1, len(pieces)))
        self.p[0], self.p[1] = 0, self.UNKNOWN
        self.find = None

    def __getstate__(self):
        return {"langs": self.langs, "hashes": self.hashes, "longest": self.longest, "p": self.p, "find": None}

    def blocks(self, words: list[str]):
        """Indexes of words by falling length, as many as have about BLOCK_LETTERS letters together, each with lattice()."""
        order, a = np.argsort([-len(w) for w in words], kind="stable"), 0
        while a < len(order):
            own = order[a : a + max(1, BLOCK_LETTERS // (len(words[order[a]]) + 1))]
            yield own, *self.lattice([words[i] for i in own])
            a += len(own)

    def lattice(self, words: list[str]):
        """Lengths and starts of words of falling length, and the piece number at each end position for each piece length."""
        if self.find is None:
            self.find = Lookup(self.hashes)
        n = np.array([len(w) + 1 for w in words])
        flat = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        within = np.arange(len(flat)) - np.repeat(start, n)
        ids, h = np.zeros((min(self.longest, n[0]), len(flat)), np.int32), np.zeros(len(flat), np.uint64)
        for k in range(1, len(ids) + 1):
            h = (np.concatenate([[np.uint64(0)], h[:-1]]) if k > 1 else h) * BASE + flat
            fits = np.flatnonzero(within >= k - 1)
            found = self.find(mix(h[fits])) + 2
            found[found == 1] = 1 if k == 1 else 0
            ids[k - 1, fits] = found
        return n, start, ids

    def totals(self, n, start, ids) -> np.ndarray:
        """Log probabilities by language over all segmentations of words of falling length.

        Only as many positions as the longest piece reaches back are kept, in a ring; a word's values are divided by their
        latest one now and then, and its logarithm is kept.
        """
        slots, langs = len(ids) + 1, len(self.langs)
        ring = np.zeros((slots, len(n), langs))
        ring[0] = 1
        scale, out = np.zeros((len(n), langs)), np.zeros((len(n), langs))
        live = len(n)
        for t in range(1, n[0] + 1):
            at, now, reach = start[:live] + t - 1, ring[t % slots, :live], min(t, len(ids))
            if live < FEW:
                back = (t - np.arange(1, reach + 1)) % slots
                now[:] = (ring[back, :live] * self.p[ids[:reach, at]]).sum(axis=0)
            else:
                now[:] = 0
                for k in range(1, reach + 1):
                    piece = ids[k - 1][at]
                    some = np.flatnonzero(piece)
                    now[some] += ring[(t - k) % slots][some] * self.p[piece[some]]
            if t % RESCALE == 0:
                last = now.copy()
                ring[:, :live] /= last
                scale[:live] += np.log(last)
            rest = int(np.searchsorted(-n, -t - 1, side="right"))
            out[rest:live] = np.log(ring[t % slots, rest:live]) + scale[rest:live]
            live = rest
        return out

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """A row of log probabilities, by language, for each word."""
        out = np.zeros((len(words), len(self.langs)))
        for own, n, start, ids in self.blocks(words):
            out[own] = self.totals(n, start, ids)
        return out

    def learn(self, counts: dict[str, dict[str, int]], rounds: int = ROUNDS) -> Model:
        """Expectation maximisation from each language's own word counts, with a little of a uniform prior; in logarithms."""
        for j, lang in enumerate(self.langs):
            words = sorted(counts.get(lang, ()))
            weights = np.array([counts[lang][w] for w in words], float)
            blocks = list(self.blocks(words))
            for _ in range(rounds):
                seen = sum((self.expected(np.log(np.maximum(self.p[:, j], 1e-300)), np.log(weights[own]), *rest) for own, *rest in blocks), np.full(len(self.p), 0.01))
                self.p[2:, j] = seen[2:] / seen[2:].sum()
        return self

    def expected(self, log_p, log_weight, n, start, ids) -> np.ndarray:
        """How often each piece occurs over all segmentations of words, by the logarithms of probabilities and counts."""
        alpha, steps, each = np.full((n[0] + 1, len(n)), -np.inf), [], np.arange(len(n))
        alpha[0] = 0
        for t in range(1, n[0] + 1):
            live = int(np.searchsorted(-n, -t, side="right"))
            at = start[:live] + t - 1
            for k in range(1, min(t, len(ids)) + 1):
                piece = ids[k - 1][at]
                some = np.flatnonzero(piece)
                if len(some):
                    steps.append((t, k, some, piece[some]))
                    alpha[t, some] = np.logaddexp(alpha[t, some], alpha[t - k, some] + log_p[piece[some]])
        beta = np.full_like(alpha, -np.inf)
        beta[n, each] = log_weight - alpha[n, each]
        seen = np.zeros(len(log_p))
        for t, k, some, piece in reversed(steps):
            back = log_p[piece] + beta[t, some]
            np.add.at(seen, piece, np.exp(back + alpha[t - k, some]))
            beta[t - k, some] = np.logaddexp(beta[t - k, some], back)
        return seen


def vocabulary(name: str = "piece_bpe_32k") -> list[str]:
    """All pieces of the public vocabulary but its control and byte pieces."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model"))
    every = range(model.get_piece_size())
    return sorted({model.id_to_piece(i).lower() for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """A model from about per_lang labelled rows of each language that are not held out, whole texts.

    Null texts and labels teach nothing; where no row is left, the model has no languages. Words are counted by the
    executors, and those of the sample come to the driver.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = dict(rows.groupBy("lang").count().collect())  # as many as there are languages
    langs = sorted(sizes)
    model = Model(vocabulary(), langs)
    if not langs:
        return model
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    rate = F.coalesce(F.create_map(*[F.lit(x) for lang in langs for x in (lang, per_lang / sizes[lang])])[F.col("lang")], F.lit(0.0))
    counts: dict[str, dict[str, int]] = {lang: {} for lang in langs}
    sample = rows.where(draw < rate).select("lang", "text").mapInArrow(count_words, "lang string, word string, n long")
    for lang, word, n in sample.groupBy("lang", "word").agg(F.sum("n")).toLocalIterator():  # words of the sample, not texts
        counts[lang][word] = n
    return model.learn(counts)


def count_words(batches):
    """How often each word occurs in each language's texts."""
    for batch in batches:
        for part in chunks(batch, "text"):
            seen: dict[tuple[str, str], int] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for w in text_words(text):
                    seen[lang, w] = seen.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score, the posterior of lang_pred under equal priors, for each document.

    Null texts, texts without a letter, and all texts under a model without languages are `und` with score 0. Repeated
    rows are scored each; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    given = shared(docs.sparkSession, "langid", model)  # piece probabilities; as large as vocabulary times languages

    def run(batches):
        model = given()
        for batch in batches:
            for part in chunks(batch, "text", 8 << 20):
                words, ends = [], []
                for text in part.column(part.schema.get_field_index("text")).to_pylist():
                    words += text_words(text)
                    ends.append(len(words))
                n = np.diff(ends, prepend=0)
                full = np.flatnonzero(n)
                pred, score = np.full(len(n), "und", dtype=object), np.zeros(len(n))
                if len(full) and model.langs:
                    coded = pa.array(words, pa.string()).dictionary_encode()
                    each = model.log_likelihoods(coded.dictionary.to_pylist())
                    index = coded.indices.to_numpy()
                    total = np.add.reduceat(each[index], (np.array(ends) - n)[full], axis=0)
                    odds = np.exp(total - total.max(axis=1, keepdims=True))
                    best = total.argmax(axis=1)
                    pred[full] = [model.langs[i] for i in best]
                    score[full] = 1 / odds.sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


by_value(__name__)
