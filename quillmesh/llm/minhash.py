"""Near-duplicate classes by min-max hashing.

A document's signature keeps the minimum and the maximum of its shingle hashes under each permutation, so 64 hash
evaluations give 128 values. Bands of four values (two minima, two maxima) collide with probability j ** 4: of 32 bands
a pair of similarity 0.75 misses all with probability 6e-6. Documents with equal shingle sets collapse to their least
doc_id first. In a bucket, members meet the bucket's leader; further rounds choose other leaders among members that are
not yet connected, and what is still apart in a bucket is compared block by block; only links leave a block. Sketches of
two bits a value sort out most pairs, and every link is confirmed on whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.vectors import components

from .batches import by_value, chunks, per_process, raw, small_batches
from .store import materialise, maybe_broadcast

SHINGLE = 5
PERCENT = 75
PERMUTATIONS = 64
BAND = 2  # permutations; two values each
BANDS = PERMUTATIONS // BAND
#: A sketch has two bits of each value, in this many words. Values that differ have equal bits in one of four cases; a pair
#: of similarity 0.75 differs in 24 of 128 on average, and in more than 46 with probability 3e-7 (five standard errors).
WORDS = 2 * PERMUTATIONS // 32
MAX_DIFFERENT = 46
#: Buckets are dealt over this many salts where leaders are joined to members.
SALTS = 16
#: Rounds with a leader for each bucket before pairs that are still apart are compared directly.
LEADER_ROUNDS = 2
#: Members of a bucket in a block, and about how many shingles they have together at most.
BLOCK = 512
BLOCK_SHINGLES = 1 << 21

#: Bytes of text hashed at a time; numpy needs some fifty times as much.
CHUNK_BYTES = 1 << 18
M = np.uint64(0x9E3779B97F4A7C15 | 1)
M_INVERSE = np.uint64(pow(int(M), -1, 1 << 64))
STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base):
        x = np.full(n, base, dtype=np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)

    return run(M), run(M_INVERSE)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word in concatenated texts; A-Z count as a-z, words end at the six ASCII spaces."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = per_process("powers", lambda: _powers(2 * CHUNK_BYTES)) if len(data) <= 2 * CHUNK_BYTES else _powers(len(data))
    lut = np.arange(1, 257, dtype=np.uint64)
    lut[65:91] += np.uint64(32)
    gap = np.zeros(256, bool)
    gap[[9, 10, 11, 12, 13, 32]] = True
    word = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate([word[1:], [False]])
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    terms = lut[data]
    terms *= power[: len(data)]
    np.cumsum(terms, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: five words, or all words where there are fewer."""
    h, doc = word_hashes(data, offsets)
    n_docs = len(offsets) - 1
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    n = np.diff(first)
    wide = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    full = sum((wide[j : len(h) + j] * STEPS[j] for j in range(SHINGLE)), np.zeros(len(h), np.uint64))
    full = mix(full + np.uint64(SHINGLE))
    out = []
    for d in range(n_docs):
        a, k = first[d], n[d]
        if k >= SHINGLE:
            out.append(np.unique(full[a : a + k - SHINGLE + 1]))
        elif k:
            out.append(mix(np.array([(h[a : a + k] * STEPS[:k]).sum() + np.uint64(k)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * M)
    return x[:PERMUTATIONS] | np.uint64(1), x[PERMUTATIONS:]


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row for each set: its band keys, then its sketch, two bits of each value. No set may be empty."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    a, b = _permutations()
    values = []
    for k in range(PERMUTATIONS):
        v = flat * a[k] + b[k]
        values += [np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)]
    keys = []
    for i in range(0, PERMUTATIONS, BAND):
        key = np.full(len(sets), i + 1, np.uint64)
        for v in values[2 * i : 2 * (i + BAND)]:
            key = mix(key * M + v)
        keys.append(key)
    for i in range(0, len(values), 32):
        word = np.zeros(len(sets), np.uint64)
        for j, v in enumerate(values[i : i + 32]):
            word |= (mix(v) & np.uint64(3)) << np.uint64(2 * j)
        keys.append(word)
    return np.stack(keys, axis=1).view(np.int64)


def text_sets(part: pa.RecordBatch) -> list[np.ndarray]:
    return shingle_sets(*raw(part.column(part.schema.get_field_index("text"))))


def signature_batches(batches):
    bands_type = pa.list_(pa.int64())
    for batch in batches:
        for part in chunks(batch, "text", CHUNK_BYTES):
            sets = text_sets(part)
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            keys = band_keys([sets[i] for i in full]) if len(full) else np.zeros((0, BANDS + WORDS), np.int64)
            counts = np.zeros(len(sets) + 1, np.int32)
            counts[1:][full] = keys.shape[1]
            d1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            d2 = np.array([mix(s ^ M).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(d1), pa.array(d2), bands.cast(bands_type)], names=["doc_id", "n_shingles", "d1", "d2", "bands"])


def set_batches(batches):
    """Key columns and the set instead of text."""
    for batch in batches:
        for part in chunks(batch, "text", CHUNK_BYTES):
            i = part.schema.get_field_index("text")
            sets = text_sets(part)
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = np.concatenate(sets).view(np.int64)
            yield part.set_column(i, "set", pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    small, large = sorted((len(x), len(y)))
    if 100 * small < PERCENT * large:
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = int((y[at] == x).sum())
    return 100 * same >= PERCENT * (len(x) + len(y) - same)


def link_batches(batches):
    """The (a, b) of pairs with sets set_a and set_b whose similarity is high enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
            keep.append(alike(x, y))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough on their whole sets."""
    pairs = pairs.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b")
    pairs = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a")
    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(link_batches, "a long, b long")


def close(a, b):
    """Whether two sketches differ in few enough values to be compared on whole sets."""

    def different(i: int):
        x = a[i].bitwiseXOR(b[i])
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    return sum((different(i) for i in range(1, WORDS)), different(0)) <= MAX_DIFFERENT


def _led(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (leader, member) from members (key, rep, label) of buckets that hold several labels.

    Each round takes another leader: the least rep first, then the least by a hash with the round's number. Only members
    that are not yet connected with the leader are paired.
    """
    order = F.col("rep") if turn == 0 else F.xxhash64(F.col("rep"), F.lit(turn))
    leaders = members.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("rep").alias("rep"), F.col("label").alias("label"), F.col("sketch").alias("sketch"))).alias("l"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    leaders = leaders.where(F.col("lo") != F.col("hi")).select("key", F.col("l.rep").alias("a"), F.col("l.label").alias("a_label"), F.col("l.sketch").alias("a_sketch"), F.explode(F.array(*[F.lit(s) for s in range(SALTS)])).alias("salt"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    alike = close(F.col("a_sketch"), F.col("sketch"))
    pairs = salted.join(leaders, (salted.key == leaders.key) & (salted.salt == leaders.salt) & (F.col("label") != F.col("a_label")) & alike)
    return pairs.select("a", F.col("rep").alias("b")).distinct()


def _apart(members: DataFrame, ids: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between members of a bucket that are not connected yet, all pairs considered.

    Members of a large bucket are dealt into blocks by their number and by their shingles, and each pair of blocks is one
    group, so no group is larger than two blocks, or two long texts, and only links leave it. A pair is looked at in the first band it shares. A shingle that no other open
    document has can't be shared: with u of them among n, a pair has at most min(n_a - u_a, n_b - u_b) in common and at
    least max(n_a + u_b, n_b + u_a) together. What this bound and the sketches leave is compared on whole sets.
    """
    sized = members.join(ids.select("rep", "n"), "rep")
    by = sized.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("n")).where(F.col("lo") != F.col("hi"))
    by = by.select("key", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rest = materialise(members.join(by, "key"), "open")
    own = sets.join(rest.select("rep").distinct(), "rep")
    single = own.select("rep", F.explode("set").alias("g")).groupBy("g").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")).where(F.col("rep") == F.col("other")).groupBy("rep").agg(F.count("*").alias("single"))
    several = own.groupBy("rep").agg((F.count("*") > 1).alias("several"))
    unshared = several.join(single, "rep", "left").select("rep", F.when(F.col("several"), F.lit(0)).otherwise(F.coalesce("single", F.lit(0))).cast("long").alias("u"))
    own = own.join(unshared, "rep").join(ids.select("rep", "bands"), "rep")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(block, j).alias("i"), F.greatest(block, j).alias("j")))
    dealt = rest.select("key", "band", "rep", "label", block.alias("block"), F.explode(pairs).alias("p")).select("key", "band", "rep", "label", "block", "p.i", "p.j")
    return dealt.join(own, "rep").groupBy("key", "i", "j").applyInArrow(block_links, "a long, b long")


def block_links(table: pa.Table) -> pa.Table:
    """Links between members of one block, or of two."""
    rep, label, block, u = (table[c].to_numpy() for c in ("rep", "label", "block", "u"))
    signed = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(rep), BANDS + WORDS)
    bands, sketch = signed[:, :BANDS], signed[:, BANDS:].view(np.uint64)
    own = table["set"].combine_chunks()
    n = own.value_lengths().to_numpy()
    sets = np.split(own.flatten().to_numpy().view(np.uint64), np.cumsum(n)[:-1])
    band, i, j = (table[c][0].as_py() for c in ("band", "i", "j"))
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    root = {x: x for x in set(label.tolist())}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a in left:
        other = right[right > a] if i == j else right
        other = other[label[other] != label[a]]
        most, least = np.minimum(n[a] - u[a], n[other] - u[other]), np.maximum(n[a] + u[other], n[other] + u[a])
        other = other[100 * most >= PERCENT * least]
        if not len(other):
            continue
        x = sketch[other] ^ sketch[a]
        different = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)
        near = different <= MAX_DIFFERENT
        near &= (bands[other] == bands[a]).argmax(axis=1) == band
        for b in other[near][np.argsort(different[near], kind="stable")]:
            ra, rb = find(label[a]), find(label[b])
            if ra != rb and alike(sets[a], sets[b]):
                root[ra] = rb
                out.append((rep[a], rep[b]))
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each document; see the module for the method.

    Null, empty and blank texts have no shingles and are their own class. Repeated rows belong to one class. A null doc_id
    has a null component unless copies of its set have an id. No rows give no rows; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_shingles long, d1 long, d2 long, bands array<bigint>"
    signed = materialise(docs.select("doc_id", "text").mapInArrow(signature_batches, schema), "signatures")
    whole = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    reps = materialise(whole.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min_by("bands", "doc_id").alias("bands")), "reps")
    banded = reps.select("rep", F.posexplode(F.slice("bands", 1, BANDS)).alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where(F.col("lo") != F.col("hi")).select("key")
    members = materialise(banded.join(shared, "key").select("key", "band", "rep"), "members")
    ids = materialise(reps.join(members.select("rep").distinct(), "rep").groupBy("rep").agg(F.min("bands").alias("bands"), F.max("n_shingles").alias("n")), "candidates")
    sketches = ids.select("rep", F.slice("bands", BANDS + 1, WORDS).alias("sketch"))
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(maybe_broadcast(ids.select("rep")), "rep", "left_semi")
    sets = texts.mapInArrow(set_batches, "rep long, set array<bigint>")
    # rows that share a doc_id are one node; a link of any of its texts links it
    sets = materialise(sets.dropDuplicates() if docs_repeat(signed) else sets, "sets")
    labels = ids.select("rep", F.col("rep").alias("label"))
    links = None
    for turn in range(LEADER_ROUNDS + 1):
        open_members = members.join(labels, "rep")
        ends = open_members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        if not ends.where(F.col("lo") != F.col("hi")).limit(1).count():
            break  # no bucket has members that are not connected
        found = _confirmed(_led(open_members.join(sketches, "rep"), turn), sets) if turn < LEADER_ROUNDS else _apart(open_members, ids, sets)
        found = materialise(found, "links")
        if found.limit(1).count():
            links = found if links is None else links.unionByName(found)
            joined = components(links)
            labels = materialise(ids.join(joined, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("label", "rep").alias("label")), "classes")
    moved = labels.where(F.col("rep") != F.col("label"))
    classes = reps.where(F.col("copies") > 1).select("d1", "d2", "n_shingles", "rep").unionByName(reps.where(F.col("copies") == 1).select("d1", "d2", "n_shingles", "rep").join(moved, "rep", "left_semi"))
    classes = classes.join(moved, "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("label", "rep").alias("class"))
    out = signed.drop("bands").join(classes, ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("class", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def docs_repeat(signed: DataFrame) -> bool:
    """Whether a doc_id occurs in several rows."""
    return signed.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).limit(1).count() > 0


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of each class's least doc_id, with their columns; rows without a doc_id stay."""
    gone = materialise(near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_qm_d")).distinct(), "duplicates")
    return docs.join(maybe_broadcast(gone), F.col("doc_id") == F.col("_qm_d"), "left_anti")


by_value(__name__)
