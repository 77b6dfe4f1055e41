"""Near-duplicate detection by BagMinHash over multisets of word shingles.

A text is a multiset of shingles of five words; the similarity of two texts is their weighted Jaccard overlap,
the sum of the smaller over the sum of the larger multiplicities. Weights are discretised to whole numbers, and
the axis of weights is a hierarchy of blocks [0, 1), [1, 2), [2, 4), [4, 8), ... Each shingle runs a Poisson
process in every block below its multiplicity, at the rate of the block's width; points of a block that is only
partly below it are thinned by their place. Every point falls on one of the signature's components, which
keeps its earliest point. So two signatures agree in a component with a probability of exactly the similarity,
and processes stop as soon as they pass the latest component.
"""

from __future__ import annotations

import gc
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.partitions import spread
from corpusq.llm.common import Words, checkpoint, mix64, ship

SHINGLE, SIZE, ROWS = 5, 128, 4
#: 32 bands of 4: a pair of similarity 0.8 meets in no band with a probability of (1 - 0.8^4)^32 < 5e-8.
BANDS = SIZE // ROWS
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_words(text: str) -> list[str]:
    return text.lower().split()


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def multisets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text row, shingle hash, multiplicity) of all texts, and 128 bits of each text's word sequence (two columns)."""
    words, flat, ends = Words(), [], [0]
    for t in texts:
        if t:
            flat.extend(map(words.__getitem__, shingle_words(t)))
        ends.append(len(flat))
    hashes = np.array([word_hash(w) for w in words], np.uint64)
    h = hashes[np.array(flat, np.int64)] if flat else np.zeros(0, np.uint64)
    n = np.diff(ends)
    roll = np.zeros(len(h), np.uint64)
    for i in range(SHINGLE):  # position by position, so that order counts
        shifted = np.append(h[i:], np.zeros(min(i, len(h)), np.uint64))
        roll = mix64(roll * GOLD + shifted + np.uint64(i + 1)) if i else mix64(shifted + np.uint64(1))
    owner, items, counts = [], [], []
    keys = np.zeros((len(texts), 2), np.int64)
    for d, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if a == z:
            continue
        digest = hashlib.blake2b(h[a:z].tobytes(), digest_size=16).digest()
        keys[d] = np.frombuffer(digest, "<i8")
        if n[d] < SHINGLE:  # one shingle of all words
            s, c = np.frombuffer(digest[:8], "<u8"), np.ones(1, np.int64)
        else:
            s, c = np.unique(roll[a : z - SHINGLE + 1], return_counts=True)
        owner.append(np.full(len(s), d))
        items.append(s)
        counts.append(c)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(owner, np.int64), join(items, np.uint64), join(counts, np.int64), keys


def _step(k: int) -> np.uint64:
    return np.uint64(k * int(GOLD) & 0xFFFFFFFFFFFFFFFF)


def signatures(owner: np.ndarray, item: np.ndarray, count: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """n x size array of the earliest points' 64-bit names. Rows without items stay zero."""
    row, seed, rate, low, top = [owner], [mix64(item)], [np.ones(len(owner))], [np.zeros(len(owner))], [count.astype(float)]
    block = 1
    while (more := count > (1 << (block - 1))).any():
        row.append(owner[more])
        seed.append(mix64(item[more] + _step(block)))
        rate.append(np.full(more.sum(), float(1 << (block - 1))))
        low.append(np.full(more.sum(), float(1 << (block - 1))))
        top.append(count[more].astype(float))
        block += 1
    row, seed, rate, low, top = map(np.concatenate, (row, seed, rate, low, top))
    partial = top < low + rate
    early, name = np.full(n * size, np.inf), np.zeros(n * size, np.uint64)
    time, latest, k = np.zeros(len(row)), np.full(n, np.inf), 0
    while len(row):
        k += 1
        r = mix64(seed + _step(k))
        time = time - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        on = time < latest[row]
        if not on.all():
            row, seed, rate, low, top, partial, time, r = (x[on] for x in (row, seed, rate, low, top, partial, time, r))
            if not len(row):
                break
        r2 = mix64(r ^ GOLD)
        at = row * size + (r2 % np.uint64(size)).astype(np.int64)
        t = time
        if partial.any():
            inside = ~partial | (low + rate * ((r2 >> np.uint64(11)).astype(float) * 2.0**-53) < top)
            at, t, r = at[inside], time[inside], r[inside]
        np.minimum.at(early, at, t)
        won = early[at] == t
        name[at[won]] = r[won]
        live = np.unique(row)
        latest[live] = early.reshape(n, size)[live].max(1)
    return name.reshape(n, size)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    n, size = sig.shape
    parts = sig.reshape(n, size // ROWS, ROWS)
    key = np.broadcast_to(np.arange(size // ROWS, dtype=np.uint64), parts.shape[:2])
    for i in range(ROWS):
        key = mix64(key * GOLD + parts[:, :, i])
    return key.view(np.int64)


def shingles(text: str) -> Counter:
    """The multiset itself, of words."""
    w = shingle_words(text)
    return Counter([tuple(w)]) if len(w) < SHINGLE else Counter(zip(*(w[i:] for i in range(SHINGLE)), strict=False))


def overlap(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity."""
    if len(a) > len(b):
        a, b = b, a
    low = sum(min(n, m) for x, n in a.items() if (m := b.get(x)))
    return low / (a.total() + b.total() - low)


def sign(docs: DataFrame, id_col: str, text_col: str, group: int = 500) -> DataFrame:
    """doc_id, k1, k2 (128 bits of the word sequence), n (words), bands (array of long) of every row."""
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, group):
                batch = whole.slice(at, group)
                owner, item, count, keys = multisets(batch.column(1).to_pylist())
                n = np.bincount(owner, count, batch.num_rows).astype(np.int64)
                bands = band_keys(signatures(owner, item, count, batch.num_rows))
                offsets = pa.array(np.arange(batch.num_rows + 1) * bands.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(bands.ravel()))], ["doc_id", "k1", "k2", "n", "bands"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, n long, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, least: float, share: int = 512) -> DataFrame:
    """The pairs (a, b, la, lb) whose multisets overlap enough; texts: rep, text.

    A text that stands in many pairs as ``a`` is sent once for about every ``share`` of them, in front of their own
    texts, so no pair carries two texts and no task meets all partners of a hot one.
    """
    spans = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("parts"))
    own, other = (texts.select(F.col("rep").alias(x), "text") for x in "ab")
    blank = [F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in ("b", "la", "lb")]
    heads = spans.join(own, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *blank, "text")
    tails = pairs.join(spans, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts").cast("long")).cast("int")).join(other, "b").select("a", "part", "b", "la", "lb", "text")
    rows = heads.union(tails).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Counter = Counter()
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (b, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                if b is None:
                    head = shingles(text)
                else:
                    ok[i] = overlap(head, shingles(text)) >= least
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 2, 3, 4)], ["a", "b", "la", "lb"])

    kind = pairs.schema["a"].dataType.simpleString()
    return rows.mapInArrow(run, f"a {kind}, b {kind}, la {kind}, lb {kind}")


def unmet_pairs(texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different labels among texts (rep, label, text), none of an overlap of at least ``least`` missing.

    The copies of a shingle are numbered, so multisets become sets, and a set's items are ordered from rare to
    frequent. Two sets that overlap enough share an item among the first n - ceil(least * n) + 1 of both, and the
    places of the first one they share leave room for the overlap (prefix and positional filter).
    """
    kind = texts.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, item, count, _ = multisets(batch.column(2).to_pylist())
            each = np.repeat(np.arange(len(item)), count)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            item = np.where(nth > 0, mix64(item[each] + nth.astype(np.uint64) * GOLD), item[each])
            n = np.bincount(owner, count, batch.num_rows).astype(np.int64)
            at = pa.array(owner[each])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(n).take(at), pa.array(item.view(np.int64))], ["rep", "label", "n", "item"])

    items = texts.select("rep", "label", "text").mapInArrow(run, f"rep {kind}, label {kind}, n long, item long")
    shared = items.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # Items that no other text has come first in the order: only their number counts.
    known = items.join(shared, "item")
    order = Window.partitionBy("rep").orderBy(F.desc("df"), F.desc("item"))
    back = F.row_number().over(order)  # items from this one to the end of the order
    prefix = checkpoint(known.withColumn("back", back).where(F.col("back") >= F.ceil(F.lit(least) * F.col("n") - 1e-9)).select("item", "rep", "label", "n", "back"))
    a, b = (prefix.select("item", *[F.col(c).alias(f"{x}_{c}") for c in ("rep", "label", "n", "back")]) for x in "ab")
    need = F.lit(least / (1 + least)) * (F.col("a_n") + F.col("b_n")) - 1e-9
    near = (F.col("a_rep") < F.col("b_rep")) & (F.col("a_label") != F.col("b_label")) & (F.least("a_back", "b_back") >= need)
    return a.join(b, "item").where(near).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"), F.col("a_label").alias("la"), F.col("b_label").alias("lb")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, root (the smallest id reachable) of every node of the edges (a, b); each step shortens paths twofold."""
    both = checkpoint(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = checkpoint(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(roots, both["b"] == roots["id"]).groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near, roots["id"] == near["a"], "left").select("id", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        up = roots.select(F.col("id").alias("root"), F.col("root").alias("above"))
        after = checkpoint(step.join(up, "root", "left").select("id", "old", F.least("root", F.coalesce("above", "root")).alias("root")))
        roots = after.select("id", "root")
        if after.where("old <> root").isEmpty():
            return roots


def merged_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (rep, label) after the classes of each edge (a, b) of labels have become one."""
    roots = components(edges)
    return checkpoint(labels.join(roots, labels["label"] == roots["id"], "left").select("rep", F.coalesce("root", "label").alias("label")))


def bucket_leaders(held: DataFrame, many: int) -> DataFrame:
    """key, leader, leader_mates, leader_label: the most central member of each of ``many`` shares of a bucket. held: key, rep, mates, label."""
    best = held.groupBy("key", F.pmod(F.xxhash64("rep"), F.lit(many)).alias("share")).agg(F.min(F.struct((-F.col("mates")).alias("least"), "rep", "label")).alias("best"))
    return best.select("key", F.col("best.rep").alias("leader"), (-F.col("best.least")).alias("leader_mates"), F.col("best.label").alias("leader_label"))


def leader_pairs(held: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pairs (a, b, la, lb) of leaders and members of another class, each once, the more central text in front."""
    first = F.struct((-F.col("leader_mates")).alias("m"), F.col("leader").alias("r")) < F.struct((-F.col("mates")).alias("m"), F.col("rep").alias("r"))
    sides = (("leader", "rep", "a"), ("rep", "leader", "b"), ("leader_label", "label", "la"), ("label", "leader_label", "lb"))
    return held.join(chosen, "key").where("label <> leader_label").select(*[F.when(first, F.col(x)).otherwise(F.col(y)).alias(to) for x, y, to in sides]).distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, leaders: tuple[int, ...] = (1,)) -> DataFrame:
    """One row per document id: doc_id, class_id (the smallest id of its class), kept (that id).

    Classes are the connected parts of the graph of verified links (overlap of at least ``least``). Texts of the
    same words (lower-cased, split at white space) are copies: one stands for all. Texts of fewer than five
    words are one shingle. Texts without words (null, empty, blank) are in no class with others; each row without
    an id gives one row without a class, kept. Texts are read whole, however long. A repeated row is one document;
    if one id has several texts, its class is the smallest one of theirs and links are verified on the greatest
    text. An empty table gives an empty result; further columns, whatever their names, are ignored.

    No pairs within a bucket are listed. First every text meets the most central member of the largest bucket it is in.
    Then, in each round, a band bucket that holds several classes has as many leaders
    as ``leaders`` says, the most central member (the one with the most bucket mates) of each of so many shares
    of the bucket, and they meet all members of other classes; verified links merge classes. Leaders then leave the
    bucket, as they have met everybody there. A round's work is linear in the members of mixed buckets. What is
    still in mixed buckets after the rounds meets in one join with a lossless filter (:func:`unmet_pairs`), whose
    result is verified too. So every link between texts that share a band is found, however the rounds are
    chosen; ``leaders=()`` leaves all to the join.
    Aggregations combine on the map side, and the other side of each join has one row per key (or leader), so
    Spark can split a hot bucket.
    """
    spark = docs.sparkSession
    ship(spark)
    signed = checkpoint(sign(docs.where(F.col(id_col).isNotNull()), id_col, text_col))
    worded = signed.where("n > 0")
    reps = checkpoint(worded.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    bands = reps.select("rep", F.explode(F.array_distinct("bands")).alias("key"))
    print_ = [F.bit_xor(F.xxhash64(F.lit(i), "rep")).alias(f"p{i}") for i in range(2)]
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *print_).where("size > 1")
    # Buckets of the very same members (128 bits of their set) say the same: one of them stays, with their number.
    once = sizes.groupBy("size", "p0", "p1").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("times")).select("key", "size", "times")
    met = checkpoint(bands.join(once, "key"))
    central = met.groupBy("rep").agg(F.sum((F.col("size") - 1) * F.col("times")).alias("mates"))
    rest = met.select("key", "rep").join(central, "rep")
    labels = checkpoint(central.select("rep", F.col("rep").alias("label")))
    texts = checkpoint(docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(labels.select("rep"), "rep").groupBy("rep").agg(F.max("text").alias("text")))
    # First each text meets the most central member of its largest bucket alone, which joins the large classes.
    largest = F.max_by("key", F.struct("size", "key")).alias("key")
    homes = met.groupBy("rep").agg(largest).join(central, "rep")
    for many in ("home", *leaders, "all"):
        held = (homes if many == "home" else rest).join(labels, "rep")
        mixed = held.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        held = checkpoint(held.join(mixed, "key", "left_semi").select("key", "rep", "mates", "label"))
        if held.isEmpty():
            if many == "home":
                continue
            break
        if many == "all":
            pairs = checkpoint(unmet_pairs(held.select("rep", "label").distinct().join(texts, "rep"), least))
        else:
            chosen = bucket_leaders(held, 1 if many == "home" else many)
            pairs = checkpoint(leader_pairs(held, chosen))
            if many != "home":
                rest = held.join(chosen.select("key", F.col("leader").alias("rep")), ["key", "rep"], "left_anti").select("key", "rep", "mates")
        edges = checkpoint(verify(pairs, texts, least).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
        if not edges.isEmpty():
            labels = merged_labels(labels, edges)
        # Let Spark's cleaner free what the round has left on disk: it acts on what the JVM has collected.
        del held, mixed, pairs, edges
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    named = reps.select("k1", "k2", "rep").join(labels, "rep", "left").select("k1", "k2", F.coalesce("label", "rep").alias("class"))
    ids = signed.select("doc_id", "n", "k1", "k2").distinct()
    found = ids.where("n > 0").join(named, ["k1", "k2"]).select("doc_id", "class").union(ids.where("n = 0").select("doc_id", F.col("doc_id").alias("class")))
    classes = found.groupBy("doc_id").agg(F.min("class").alias("class_id")).withColumn("kept", F.col("doc_id") == F.col("class_id"))
    nameless = docs.where(F.col(id_col).isNull()).select(F.col(id_col).alias("doc_id"), F.col(id_col).alias("class_id"), F.lit(True).alias("kept"))
    return classes.unionByName(nameless)
