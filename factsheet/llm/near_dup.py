"""Near-duplicates by Order MinHash over five-word shingles, verified by banded alignment.

Shingles of a text are labelled with their occurrence number. For each of ``SKETCHES`` hash functions
the three least labelled shingles are taken and kept in text order: two texts share such an element only
if they share the shingles and their order, which follows edit similarity rather than set overlap.

Texts of equal words form one class at once and go on as one representative. Representatives that
share an element and are of like length form a bucket. Texts are similar when the alignment of their words
finds at most 20 % edits of the longer one. In ROUNDS rounds the least of each class known so far is compared with
one member of each of its buckets, so a round gives at most one pair for each member, and large groups of copies
become one class. Then all pairs of a bucket that are still of two classes are met: an edit moves at most one
word out of a bin of word counts and one in, so counts that are too far apart rule a pair out for certain, and what they
don't rule out is aligned where it meets, unless links of the same block have joined its classes before: a block of n
members hands on n - 1 links at most, never its pairs. A pair that shares several buckets meets in one of them, chosen by a digest.
No pair of a bucket is lost. Large buckets are dealt over pairs of blocks, so that a task
holds few texts at a time. Classes are the connected components of all links.

Chance: two texts with shingle similarity J share one of 32 elements with probability 1 - (1 - J^3)^32:
above 0.99999 from J = 0.7 on, 0.9996 at J = 0.6, 0.986 at J = 0.5. Edits of single words spread over a text lower J
quickly: 12 % of them leave about half of the shingles, 18 % a third, and such pairs are missed often.

Defined cases: null and empty texts, and texts without a word, are like no other text; texts under
five words have one shingle; rows that share an id are one node; rows without id get the class of an
equal text that has one, else null; empty tables give empty results; other columns are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsheet.llm.align import grams, labelled, mixed, similar
from factsheet.llm.common import grouped, is_small, joined, lists, picked, stored, word_hashes, words
from factsheet.llm.graph import components

SHINGLE = 5
SKETCHES = 32
#: Shingles of an element.
ORDERED = 3
CHUNK = 1 << 15
#: Rounds in which members of a bucket are compared with one of it, before all that are of two classes meet.
ROUNDS = 2
#: Bins of a text's word counts.
BINS = 256
#: Members of a block: two blocks of a bucket meet in a task at a time.
FEW = 1024
#: Words of a block's texts, on average.
BLOCK_WORDS = 1 << 22
#: Nodes whose labels are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def order_sketch(values: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """The elements of one text's word hashes; none for a text without words."""
    found = grams(values, SHINGLE)
    if not len(found):
        return np.zeros(0, np.int64)
    found = labelled(found)
    seeds = mixed(np.arange(1, sketches + 1, dtype=np.uint64))[:, None]
    rows = np.arange(sketches)
    best, place = np.zeros((sketches, 0), np.uint64), np.zeros((sketches, 0), np.int64)
    for at in range(0, len(found), CHUNK):
        part = found[at : at + CHUNK]
        value = (part ^ seeds) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(32)
        value *= np.uint64(0xD6E8FEB86659FD93)
        for _ in range(min(ORDERED, len(part))):
            least = value.argmin(axis=1)
            best = np.column_stack([best, value[rows, least]])
            place = np.column_stack([place, least + at])
            value[rows, least] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.argsort(best, axis=1, kind="stable")[:, :ORDERED]
    place = np.sort(np.take_along_axis(place, least, axis=1), axis=1)
    element = np.zeros(sketches, np.uint64)
    for k in range(place.shape[1]):
        element = mixed(element + found[place[:, k]])
    return mixed(element ^ seeds[:, 0]).view(np.int64)


def signatures(docs: DataFrame, doc_id: str, text: str, sketches: int = SKETCHES) -> DataFrame:
    """id, key (equal for equal words; null without words), n words, elements."""
    rows = picked(docs, (doc_id, "id"), (text, "text")).select("id", word_hashes(F.col("text")).alias("words"))
    kind = rows.schema["id"].dataType.simpleString()
    n = F.size("words")
    key = F.when(n > 0, F.concat_ws(":", F.xxhash64("words"), F.hash("words"), n))
    rows = rows.select("id", key.alias("key"), n.alias("n"), "words")

    def sketch(batches):
        for batch in batches:
            values, ends = lists(batch.column(3))
            each = [order_sketch(values[a:b], sketches) for a, b in zip(ends[:-1], ends[1:])]
            sizes = np.cumsum([0] + [len(e) for e in each]).astype(np.int32)
            flat = pa.array(np.concatenate(each) if each else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(pa.array(sizes), flat)], names=["id", "key", "n", "elements"])

    return rows.mapInArrow(sketch, f"id {kind}, key string, n int, elements array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b, ok) of (a, b) pairs, from (id, words)."""
    left = texts.select(F.col("id").alias("a"), F.col("words").alias("wa"))
    right = texts.select(F.col("id").alias("b"), F.col("words").alias("wb"))

    def check(batches):
        for batch in batches:
            (x, at), (y, bt) = lists(batch.column(2)), lists(batch.column(3))
            ok = [similar(x[at[i] : at[i + 1]], y[bt[i] : bt[i + 1]], least) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb")
    return both.mapInArrow(check, f"a {kind}, b {kind}, ok boolean")


def counted(values: np.ndarray) -> np.ndarray:
    """How many words fall into each of BINS bins; what is more than 16 bits hold counts as the most."""
    return np.minimum(np.bincount(values & (BINS - 1), minlength=BINS), (1 << 15) - 1).astype("<i2")


def binned(texts: DataFrame) -> DataFrame:
    """(id, bins): how many words of each text fall into each of BINS bins, as 16-bit numbers."""
    kind = texts.schema["id"].dataType.simpleString()

    def count(batches):
        for batch in batches:
            values, ends = lists(batch.column(1))
            each = [counted(values[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(each, pa.binary())], names=["id", "bins"])

    return texts.select("id", "words").mapInArrow(count, f"id {kind}, bins binary")


def may_be_similar(n: np.ndarray, root: np.ndarray, bins: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of a left and a right member that are of two classes and that lengths and bins don't rule out.

    A pair occurs once, also where members are on both sides.
    """
    same = np.array_equal(left, right)
    right = right[np.argsort(n[right], kind="stable")]
    sizes, found = n[right], []
    for i in left.tolist():
        low = np.searchsorted(sizes, least * n[i] - 1e-9, side="left")
        high = np.searchsorted(sizes, (n[i] + 1e-9) / least, side="right")
        near = right[low:high]
        near = near[root[near] != root[i]]
        if same:
            near = near[near > i]
        if len(near):
            apart = np.abs(bins[near] - bins[i]).sum(axis=1, dtype=np.int64)
            near = near[apart <= 2 * np.floor((1 - least) * np.maximum(n[near], n[i]) + 1e-9)]
            found.append((np.full(len(near), i), near))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def candidates(part: pa.Table, bins: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of a block that may be similar, from (k, i, j, mine, id, n, root)."""
    i, j, mine, n = (part[c].to_numpy() for c in ("i", "j", "mine", "n"))
    root = part["root"].combine_chunks().dictionary_encode().indices.to_numpy()
    return may_be_similar(n.astype(np.int64), root, bins, np.flatnonzero(mine == i), np.flatnonzero(mine == j), least)


def meets_here(k: int, ks: np.ndarray, digest: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether bucket k is the one, of all that x and y share, in which the pair is aligned; ks are padded with 0."""
    here = np.zeros(len(x), bool)
    order = np.argsort(x, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(x[order])) + 1) if len(x) else []:
        i, near = x[at[0]], y[at]
        pair = (digest[near] ^ digest[i])[:, None]
        value = mixed((ks[near] ^ pair).view(np.uint64))
        value[~np.isin(ks[near], ks[i]) | (ks[near] == 0)] = np.uint64(0xFFFFFFFFFFFFFFFF)
        here[at] = value.min(axis=1) == mixed((np.int64(k) ^ pair[:, 0]).view(np.uint64))
    return here


def met(entries: DataFrame, counts: DataFrame, texts: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """(a, b): links that join all similar pairs of each bucket that are of two classes, from (k, id, n, root).

    A bucket of more than FEW members is dealt over blocks, of which each two meet in a task. Word counts (id, bins) tell which
    members may be similar to another one; only those take their words (id, words) and buckets (id, n, ks) to the block.
    """
    kind = entries.schema["id"].dataType.simpleString()
    sizes = entries.groupBy("k").agg(F.ceil(F.greatest(F.count(F.lit(1)) / FEW, F.sum("n") / BLOCK_WORDS)).cast("int").alias("blocks"))
    dealt = joined(entries, stored(sizes.filter("blocks > 1"), "large"), "k", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ("k", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "n", "root")
    dealt = dealt.select(*columns)

    def choose(part):
        bins = np.frombuffer(b"".join(part["bins"].to_pylist()), "<i2").reshape(-1, BINS)
        at = np.unique(np.concatenate(candidates(part, bins, least)))
        if len(at):
            yield from part.drop(["bins"]).take(pa.array(at)).combine_chunks().to_batches()

    def align(part):
        values, ends = lists(part["words"].combine_chunks())
        bins = np.stack([counted(values[a:b]) for a, b in zip(ends[:-1], ends[1:])])
        buckets, at = lists(part["ks"].combine_chunks())
        size = np.diff(at)
        ks = np.zeros((len(part), max(1, size.max())), np.int64)
        ks[np.arange(ks.shape[1]) < size[:, None]] = buckets
        x, y = candidates(part, bins, least)
        here = meets_here(part["k"][0].as_py(), ks, part["digest"].to_numpy(), x, y)
        top = part["root"].combine_chunks().dictionary_encode().indices.to_numpy().tolist()
        parent = list(range(max(top) + 1))

        def find(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        links = []
        for a, b in zip(x[here].tolist(), y[here].tolist()):
            p, q = find(top[a]), find(top[b])
            if p != q and similar(values[ends[a] : ends[a + 1]], values[ends[b] : ends[b + 1]], least):
                parent[q] = p
                links.append((a, b))
        if links:
            ids = part["id"].combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(c)) for c in zip(*links)], names=["a", "b"])

    members = dealt.join(counts, "id").select("k", "i", "j", "mine", "id", "n", "root", "bins")
    chosen = stored(grouped(members, choose, f"k bigint, i int, j int, mine int, id {kind}, n int, root {kind}"), "chosen")
    whole = chosen.join(texts, "id").join(held, ["id", "n"])
    whole = whole.select("k", "i", "j", "mine", "id", "n", "root", "words", "ks", F.xxhash64("id").alias("digest"))
    return grouped(whole, align, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, least: float = 0.8, doc_id: str = "doc_id", text: str = "text", sketches: int = SKETCHES) -> DataFrame:
    """One row per document: doc_id, class_id (least id of its class), n_words."""
    signed = stored(signatures(docs, doc_id, text, sketches), "signatures")
    # Equal words: one representative. min() passes over null ids.
    reps = stored(signed.filter("key is not null").groupBy("key").agg(F.min("id").alias("rep")), "representatives")
    heads = signed.filter("key is not null").join(reps.filter("rep is not null"), (signed["id"] == reps["rep"]) & (signed["key"] == reps["key"]), "left_semi")
    heads = heads.select("id", "n", "elements").dropDuplicates(["id", "elements"])
    entries = heads.select("id", "n", F.posexplode("elements").alias("at", "e"))
    # Texts of too different lengths part here: each bucket is split into classes of length, and a text
    # enters its own and the next, so that two of similar length meet in one of them.
    step = F.floor(F.log(F.col("n") + 0.0) / math.log(1 / least)).cast("int") if least < 1 else F.col("n")
    entries = entries.select(F.explode(F.array(step, step + 1)).alias("c"), "at", "e", "id", "n").select(F.xxhash64("at", "e", "c").alias("k"), "id", "n")
    entries = stored(entries.distinct(), "entries")
    shared = entries.groupBy("k").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("k")
    held = stored(entries.join(shared, "k").groupBy("id", "n").agg(F.collect_list("k").alias("ks")), "held")
    some = stored(held.select("id").distinct(), "entered")
    raw = picked(docs, (doc_id, "id"), (text, "text"))
    texts = joined(raw, some, "id", "left_semi").select("id", F.transform(words(F.col("text")), lambda w: F.hash(w)).alias("words"))
    texts = stored(texts.filter(F.size("words") > 0).dropDuplicates(["id"]), "texts")
    labels = some.select(F.col("id").alias("node"), F.col("id").alias("root"))
    judged = None
    few_nodes = is_small(some, BROADCAST_ROWS)

    def side(narrow: DataFrame) -> DataFrame:
        return F.broadcast(narrow) if few_nodes else narrow

    def linked(pairs: DataFrame) -> None:
        """Align new pairs and merge the classes of those that are similar."""
        nonlocal judged
        if judged is not None:
            pairs = pairs.join(judged, ["a", "b"], "left_anti")
        found = stored(verified(pairs, texts, least), "verdicts")
        judged = found.select("a", "b") if judged is None else judged.union(found.select("a", "b"))
        merge(found.filter("ok").select("a", "b"))

    def merge(links: DataFrame) -> None:
        nonlocal labels
        if links.isEmpty():
            return
        place = side(labels.select(F.col("node").alias("id"), "root"))
        links = links.join(place.withColumnsRenamed({"id": "a", "root": "ra"}), "a").join(place.withColumnsRenamed({"id": "b", "root": "rb"}), "b")
        links = stored(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b").distinct(), "links")
        merged = components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
        labels = stored(labels.join(side(merged), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")

    def live(of: DataFrame) -> DataFrame:
        """Entries of the buckets that hold two classes or more, with their class."""
        classed = held.join(side(of), held["id"] == of["node"]).select(F.explode("ks").alias("k"), "id", "n", "root")
        mixed_ = classed.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("k")
        return stored(classed.join(mixed_, "k"), "live")

    for turn in range(ROUNDS):
        # The least member of each class in a bucket, and that of them that comes first in this round's order.
        of_class = stored(live(labels).groupBy("k", "root").agg(F.min(F.struct("id", "n")).alias("m")).select("k", "root", "m.*"), "classes")
        first = F.min(F.struct((F.col("id") if not turn else F.xxhash64("id", F.lit(turn))).alias("o"), "id", "root", "n")).alias("p")
        pairs = of_class.join(of_class.groupBy("k").agg(first), "k").filter(F.col("root") != F.col("p.root"))
        close = F.least("n", "p.n") >= least * F.greatest("n", "p.n") - 1e-9
        linked(pairs.filter(close).select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct())
    left = live(labels)
    counts = stored(binned(texts.join(left.select("id").distinct(), "id", "left_semi")), "bins")
    merge(stored(met(left, counts, texts, held, least), "met"))
    known = signed.select("id", "key", "n").join(reps, "key", "left")
    known = known.withColumn("start", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.coalesce("rep", "id")))
    known = known.join(labels, known["start"] == labels["node"], "left")
    return known.select(F.col("id").alias("doc_id"), F.coalesce("root", "start").alias("class_id"), F.col("n").cast("bigint").alias("n_words"))


def keep_one(docs: DataFrame, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, that with the least id, with all its columns.

    Rows without id stay unless their text equals that of a row with an id; rows that share an id and
    are kept are all kept, as nothing tells them apart.
    """
    found = near_duplicates(docs, least, doc_id, text)
    drop = stored(found.filter("class_id <> doc_id").select(F.col("doc_id").alias("_dup")).distinct(), "duplicates")
    return joined(docs, drop, docs[doc_id] == drop["_dup"], "left_anti")
