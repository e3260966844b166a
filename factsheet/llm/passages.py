"""Substring dedup by collinear chaining: fuzzy passages that texts share.

Seeds are the minimisers of eight-word k-mers: the least hash in each window of sixteen, so texts that
share a run of 23 words share a seed; the n-th occurrence of a k-mer in one text meets the n-th in the
other, so runs of one repeated word are followed too. Each seed points to the least document that holds it, its pivot,
so a passage in n documents gives n - 1 pairs per seed and not all pairs. The seeds that a document and
a pivot share are chained in order, over gaps of at most ``MAX_GAP`` words and with gap costs; each chain is aligned, or, if it has
too many edits, the longest parts between its seeds that have few enough; these are extended
word by word on both sides, and kept if they have at least ``min_words`` words and few enough edits.

A pivot may hold but a part of a passage. Seeds of a document that no passage found so far covers are open. In a second round
an open seed points to the least document in which it is open too, and the pair is judged by all the seeds it shares. What is open
after that meets all lesser holders of the seed, block by block, with the words and seeds around it: a pair is left out if its chain
ends near and what it and the equal words beside it give is surely too short, as with a short line that many texts hold. The others go on. Where the seed before
is open too and it and the words up to it are the same, it says the same of the pair; a seed of which this holds for all holders meets nobody. So a word of a document
that lies in a passage with any lesser document, by seeds as above, is listed with one of them, not with all.

Texts of equal words go on as one representative; their copies are listed with their whole length.

Chance: none for runs of ``min_words`` words without edits; edits so dense that no 23 words stay equal hide a passage. Extension reaches at most 64 words beyond a chain's last seed.

Defined cases: null and empty texts have no passage; texts shorter than a k-mer have no seed; repeats
inside one text are not listed; rows that share an id are one document; rows without id only get the
row that names an equal text; empty tables give empty results; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsheet.llm.align import distance, grams, labelled, mixed
from factsheet.llm.common import joined, lists, picked, stored, word_hashes, words

#: What every text with a word holds.
WORD = r"[\p{L}\p{N}]"
K = 8
WINDOW = 16
MAX_GAP = 48
GAP_COST = 0.01
EXTEND = 64
AHEAD = 4
#: Holders of a seed in a block: two blocks meet in a task at a time.
FEW = 1024
#: Words whose k-mers are hashed at a time, if they are of several texts.
STEP_WORDS = 1 << 15
#: Holders that are laid out at a time, and numbers of them compared at a time.
STEP_HOLDERS = 2048
CELLS = 1 << 17
#: What a pair of holders counts beside the seeds near it.
PAIR_CELLS = 8
#: Beyond the ends of a text, and what it is taken for on one of two sides: equal to no word, nor to each other.
BEYOND, OTHER = -(1 << 40), -(1 << 41)


def minimisers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word position of the least k-mer of each window, each once."""
    return least_of(grams(values, K)[: max(0, len(values) - K + 1)])


def least_of(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from the hashes of all k-mers."""
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    n = max(1, len(found) - WINDOW + 1)
    width = min(WINDOW, len(found))
    least, span = found.copy(), 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span : width - span + n])
    # A k-mer is taken if it is the least of a window that holds it.
    taken = np.zeros(len(found), bool)
    for k in range(width):
        taken[k : k + n] |= found[k : k + n] == least
    at = np.flatnonzero(taken)
    return labelled(found)[at].view(np.int64), at.astype(np.int32)


def seeds(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, key (equal for equal words; null without words), n words, and seeds with their positions."""
    rows = picked(docs, (doc_id, "id"), (text, "text")).select("id", word_hashes(F.col("text")).alias("words"))
    kind = rows.schema["id"].dataType.simpleString()
    n = F.size("words")
    key = F.when(n > 0, F.concat_ws(":", F.xxhash64("words"), F.hash("words"), n))

    def take(batches):
        for batch in batches:
            values, ends = lists(batch.column(3))
            each, first = [], 0
            while first < batch.num_rows:
                # The k-mers of many short texts are hashed together, those over two texts are left out.
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + STEP_WORDS, "right")) - 1)
                low, found = ends[first], grams(values[ends[first] : ends[last]], K)
                each += [least_of(found[a - low : max(a, b - K + 1) - low]) for a, b in zip(ends[first:last], ends[first + 1 : last + 1])]
                first = last
            each = each or [minimisers(values)]
            sizes = pa.array(np.cumsum([0] + [len(h) for h, _ in each])[: batch.num_rows + 1].astype(np.int32))
            columns = [pa.ListArray.from_arrays(sizes, pa.array(np.concatenate([e[k] for e in each]))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["id", "key", "n", "h", "at"])

    rows = rows.select("id", key.alias("key"), n.alias("n"), "words")
    return rows.mapInArrow(take, f"id {kind}, key string, n int, h array<bigint>, at array<int>")


def held_by_several(entries: DataFrame) -> DataFrame:
    """(id, h, at, a, x): seeds (id, h, at) that two documents hold at least, with the least place that holds them.

    Seeds are dealt out once and read in order; of a seed nothing is kept but its least place, and the least document's rows until another one comes.
    """
    kind = entries.schema["id"].dataType.simpleString()

    def run(batches):
        rest = known = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            ids, h, at = (c.to_numpy() for c in table.columns)
            fresh = np.append(True, h[1:] != h[:-1])
            starts, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
            a, x, several = ids[starts], at[starts], np.zeros(len(starts), bool)
            if known and known[0] == h[0]:
                a[0], x[0], several[0] = known[1], known[2], True
            several[group[ids != a[group]]] = True
            keep = several[group]
            rest = None if several[-1] else table.slice(int(starts[-1])).combine_chunks()
            known = (h[-1], a[-1], x[-1]) if several[-1] else None
            if keep.any():
                columns = [c.combine_chunks() for c in table.filter(pa.array(keep)).columns]
                least = [pa.array(v[group[keep]], c.type) for v, c in ((a, columns[0]), (x, columns[2]))]
                yield pa.RecordBatch.from_arrays([*columns, *least], names=["id", "h", "at", "a", "x"])

    dealt = entries.select("id", "h", "at").repartition("h").sortWithinPartitions("h", "id", "at")
    return dealt.mapInArrow(run, f"id {kind}, h bigint, at int, a {kind}, x int")


def with_links(whole: DataFrame, most: int) -> DataFrame:
    """(id, h, at, first, words) with ``prev``, the place of the seed before each seed if at most ``most`` words away (else -1), and
    ``sig``, a hash of that seed, the distance and the words up to the seed (0 without one): where it is equal, so are these words."""
    kind = whole.schema["id"].dataType.simpleString()
    base = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(int(base), -1, 1 << 64))

    def run(batches):
        for batch in batches:
            (h, ht), (at, _), (words_, wt) = (lists(batch.column(c)) for c in (1, 2, 4))
            sig, prev = np.zeros(len(at), np.uint64), np.full(len(at), -1, np.int32)
            for i in range(batch.num_rows):
                y, found = at[ht[i] : ht[i + 1]], h[ht[i] : ht[i + 1]].view(np.uint64)
                values = words_[wt[i] : wt[i + 1]].astype(np.int64).view(np.uint64)
                near = np.flatnonzero(np.diff(y) <= most) if len(values) else []
                near = near[y[near + 1] <= len(values)] if len(near) else near
                if not len(near):
                    continue
                # Sums of words times powers of an odd number: a run's sum, moved to the text's start, tells its words.
                powers = np.cumprod(np.append(np.uint64(1), np.full(len(values) - 1, base)))
                total = np.append(np.uint64(0), np.cumsum(mixed(values) * powers))
                low, high = y[near], y[near + 1]
                shifts = np.cumprod(np.append(np.uint64(1), np.full(int(low.max()), back)))
                run_ = (total[high] - total[low]) * shifts[low]
                one = mixed(mixed(run_) + found[near] + (high - low).astype(np.uint64) * base)
                sig[ht[i] + near + 1] = np.maximum(one, np.uint64(1))
                prev[ht[i] + near + 1] = low
            ends = pa.array(ht.astype(np.int32))
            columns = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (sig.view(np.int64), prev)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["id", "h", "at", "first", "words", "sig", "prev"])

    whole = whole.select("id", "h", "at", "first", "words")
    return whole.mapInArrow(run, f"id {kind}, h array<bigint>, at array<int>, first array<boolean>, words array<int>, sig array<bigint>, prev array<int>")


def collinear(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Collinear chains of matches (x, y), each as the numbers of its matches in order.

    The best chain that ends at a match adds the match to the best chain whose last match lies before
    it in both texts and at most ``MAX_GAP`` words back, less the cost of the gap. All matches that lie so near
    are tried: there are at most ``MAX_GAP`` of them, as a text has one seed at a word.
    """
    xs, ys = x.tolist(), y.tolist()
    score, parent = [1.0] * len(xs), [-1] * len(xs)
    order, first = np.lexsort((-y, x)).tolist(), 0
    for n, i in enumerate(order):
        while xs[i] - xs[order[first]] > MAX_GAP:
            first += 1
        for j in order[first:n]:
            if xs[j] < xs[i] and 0 < ys[i] - ys[j] <= MAX_GAP:
                value = 1.0 + score[j] - GAP_COST * (xs[i] - xs[j] + ys[i] - ys[j])
                if value > score[i]:
                    score[i], parent[i] = value, j
    used, out = [False] * len(xs), []
    for i in sorted(range(len(xs)), key=lambda i: (-score[i], i)):
        if used[i]:
            continue
        j, members = i, []
        while j >= 0 and not used[j]:
            used[j] = True
            members.append(j)
            j = parent[j]
        out.append(members[::-1])
    return out


def chain(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Collinear chains of matches (x, y): first x, last x, first y, last y, matches."""
    return [(int(x[m[0]]), int(x[m[-1]]), int(y[m[0]]), int(y[m[-1]]), len(m)) for m in collinear(x, y)]


def chains(matches: DataFrame) -> DataFrame:
    """a, b, xs, ys: chains of the matches (a, b, x, y) as the starts of their seeds in both texts."""
    kind = matches.schema["a"].dataType.simpleString()

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            a, b, x, y = (c.to_numpy() for c in table.columns)
            starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            yield from emit(a, b, x, y, starts[:-1], starts[1:])
            rest = table.slice(int(starts[-1]))
        if rest is not None:
            a, b, x, y = (c.to_numpy() for c in rest.columns)
            yield from emit(a, b, x, y, [0], [len(a)])

    def emit(a, b, x, y, froms, tos):
        rows = [(a[i], b[i], x[i:j][m], y[i:j][m]) for i, j in zip(froms, tos) for m in collinear(x[i:j], y[i:j])]
        if rows:
            columns = list(zip(*rows))
            sizes = pa.array(np.cumsum([0] + [len(m) for m in columns[2]]).astype(np.int32))
            arrays = [pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(c), pa.int32())) for c in columns[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), *arrays], names=["a", "b", "xs", "ys"])

    sorted_ = matches.select("a", "b", "x", "y").repartition("a", "b").sortWithinPartitions("a", "b", "x", "y")
    return sorted_.mapInArrow(run, f"a {kind}, b {kind}, xs array<int>, ys array<int>")


def extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """How far two sequences go on alike from their starts: words of a, words of b, edits.

    An edit is passed if ``AHEAD`` equal words follow it.
    """
    i = j = edits = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for di, dj in ((1, 1), (1, 0), (0, 1)):
            p, q = a[i + di : i + di + AHEAD], b[j + dj : j + dj + AHEAD]
            if len(p) == len(q) == AHEAD and (p == q).all():
                i, j, edits = i + di, j + dj, edits + 1
                break
        else:
            break
    return i, j, edits


def gap_edits(p: np.ndarray, q: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Edits between each seed of a chain and the next, from the words of both texts."""
    out = np.zeros(len(xs) - 1, np.int64)
    for i, (dx, dy) in enumerate(zip(np.diff(xs).tolist(), np.diff(ys).tolist())):
        if min(dx, dy) <= K:
            out[i] = abs(dx - dy)
        else:
            x, y = xs[i] + K, ys[i] + K
            out[i] = distance(p[x : xs[i + 1]], q[y : ys[i + 1]], max(dx, dy) - K)
    return out


def parts(xs: np.ndarray, ys: np.ndarray, edits: np.ndarray, least: float) -> list[tuple[int, int]]:
    """First and last seed of the parts of a chain that have few enough edits: the longest, then those of what is left.

    Each seed is in one part; a seed alone has no edits.
    """
    share, total = 1 - least, np.append(0, np.cumsum(edits))
    out, todo = [], [(0, len(xs) - 1)]
    while todo:
        low, high = todo.pop()
        best = (-1, low, low)
        for at in (xs, ys):
            # A part passes if the edits less those that its words allow don't rise; the least of all
            # later values only grows, so the last seed that passes is found by search.
            value = total[low : high + 1] - share * at[low : high + 1]
            later = np.minimum.accumulate(value[::-1])[::-1]
            far = np.searchsorted(later, value + share * K + 1e-9, side="right") - 1
            length = xs[low + far] - xs[low : high + 1]
            i = int(length.argmax())
            best = max(best, (int(length[i]), low + i, low + int(far[i])))
        _, i, j = best
        out.append((i, j))
        todo += [t for t in ((low, i - 1), (j + 1, high)) if t[0] <= t[1]]
    return sorted(out)


def passages_of(p: np.ndarray, q: np.ndarray, xs: np.ndarray, ys: np.ndarray, min_words: int, least: float) -> list[tuple[int, int, int, int, float]]:
    """x0, x1, y0, y1, similarity of the passages along a chain whose seeds lie at xs and ys of the words p and q."""

    def core(i: int, j: int) -> int | None:
        a, b = p[xs[i] : xs[j] + K], q[ys[i] : ys[j] + K]
        return distance(a, b, int((1 - least) * max(len(a), len(b)) + 1e-9))

    last = len(xs) - 1
    pieces = [(0, last)] if core(0, last) is not None else parts(xs, ys, gap_edits(p, q, xs, ys), least)
    out = []
    for i, j in pieces:
        x0, x1, y0, y1 = int(xs[i]), int(xs[j]) + K, int(ys[i]), int(ys[j]) + K
        edits = core(i, j)
        ri, rj, re = extend(p[x1 : x1 + EXTEND], q[y1 : y1 + EXTEND])
        li, lj, le = extend(p[max(0, x0 - EXTEND) : x0][::-1], q[max(0, y0 - EXTEND) : y0][::-1])
        for m, a0, a1, b0, b1 in ((edits + re + le, x0 - li, x1 + ri, y0 - lj, y1 + rj), (edits, x0, x1, y0, y1)):
            alike = 1 - m / max(a1 - a0, b1 - b0)
            if alike >= least - 1e-9 and min(a1 - a0, b1 - b0) >= min_words:
                out.append((a0, a1, b0, b1, alike))
                break
    return out


def aligned(found: DataFrame, texts: DataFrame, min_words: int, least: float) -> DataFrame:
    """Chains as passages: a, b, x0, x1, y0, y1, similarity. A chain of too many edits is judged in parts."""
    kind = found.schema["a"].dataType.simpleString()
    columns = ("a", "b", "xs", "ys")

    def cut(at: str, side: str):
        low = F.greatest(F.element_at(at, 1) - EXTEND, F.lit(0))
        return F.slice("words", low + 1, F.element_at(at, -1) + K + EXTEND - low).alias(side)

    left = found.select(*columns).join(texts.select(F.col("id").alias("a"), "words"), "a").select(*columns, cut("xs", "wa"))
    both = left.join(texts.select(F.col("id").alias("b"), "words"), "b").select(*columns, "wa", cut("ys", "wb"))

    def run(batches):
        for batch in batches:
            keep, out = [], []
            (xs, st), (ys, _), (wa, at), (wb, bt) = (lists(batch.column(k)) for k in (2, 3, 4, 5))
            for i in range(batch.num_rows):
                x, y = xs[st[i] : st[i + 1]], ys[st[i] : st[i + 1]]
                s, t = max(0, int(x[0]) - EXTEND), max(0, int(y[0]) - EXTEND)
                for a0, a1, b0, b1, alike in passages_of(wa[at[i] : at[i + 1]], wb[bt[i] : bt[i + 1]], x - s, y - t, min_words, least):
                    keep.append(i)
                    out.append((a0 + s, a1 + s, b0 + t, b1 + t, alike))
            if keep:
                rest = [pa.array([r[k] for r in out], pa.int32() if k < 4 else pa.float64()) for k in range(5)]
                ids = [batch.column(k).take(pa.array(keep)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, *rest], names=["a", "b", "x0", "x1", "y0", "y1", "similarity"])

    return both.mapInArrow(run, f"a {kind}, b {kind}, x0 int, x1 int, y0 int, y1 int, similarity double")


def judged(pairs: DataFrame, heads: DataFrame, left: DataFrame) -> DataFrame:
    """a, b, xs, ys: chains of all seeds that the pairs (a, b) share and that hold an open seed (id, at) of b."""
    kind = pairs.schema["a"].dataType.simpleString()
    wanted = left.groupBy(F.col("id").alias("b")).agg(F.collect_list("at").alias("open"))
    for side in ("a", "b"):
        pairs = pairs.join(heads.select(F.col("id").alias(side), F.size("h").alias(f"n{side}")), side)
    # The text with fewer seeds goes to the other one.
    fewer = F.col("na") <= F.col("nb")
    pairs = pairs.join(wanted, "b").select("a", "b", "open", fewer.alias("fewer"), F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("c"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("d"))
    for side in ("c", "d"):
        pairs = pairs.join(heads.select(F.col("id").alias(side), F.col("h").alias(f"h{side}"), F.col("at").alias(f"x{side}")), side)
    one = [F.when(F.col("fewer"), F.col(f"{v}c")).otherwise(F.col(f"{v}d")) for v in "hx"]
    other = [F.when(F.col("fewer"), F.col(f"{v}d")).otherwise(F.col(f"{v}c")) for v in "hx"]
    both = pairs.select("a", "b", one[0].alias("ha"), one[1].alias("xa"), other[0].alias("hb"), other[1].alias("yb"), "open")

    def run(batches):
        for batch in batches:
            (ha, at), (xa, _), (hb, bt), (yb, _), (open_, ot) = (lists(batch.column(c)) for c in range(2, 7))
            keep, xs, ys = [], [], []
            for i in range(batch.num_rows):
                _, p, q = np.intersect1d(ha[at[i] : at[i + 1]], hb[bt[i] : bt[i + 1]], return_indices=True)
                x, y = xa[at[i] : at[i + 1]][p], yb[bt[i] : bt[i + 1]][q]
                for m in collinear(x, y):
                    if np.isin(y[m], open_[ot[i] : ot[i + 1]]).any():
                        keep.append(i)
                        xs.append(x[m])
                        ys.append(y[m])
            if keep:
                sizes = pa.array(np.cumsum([0] + [len(m) for m in xs]).astype(np.int32))
                arrays = [pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(c), pa.int32())) for c in (xs, ys)]
                ids = [batch.column(c).take(pa.array(keep)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, *arrays], names=["a", "b", "xs", "ys"])

    return both.mapInArrow(run, f"a {kind}, b {kind}, xs array<int>, ys array<int>")


def contexts(members: DataFrame, heads: DataFrame, texts: DataFrame, min_words: int) -> DataFrame:
    """(k, id, blocks, open, sig, skips, near, off, before, after) of seeds (id, h, at, open, sig, skips, blocks) that have blocks: other seeds at most ``span_of`` words away, twice their offsets (plus one if they are open), and the words on both sides, outwards."""
    kind = members.schema["id"].dataType.simpleString()
    side, span = side_of(min_words), span_of(min_words)
    wanted = members.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "h", "open", "sig", "skips", "blocks"))).alias("m")).filter(F.exists("m", lambda m: m["blocks"] > 0))
    wanted = wanted.select("id", F.col("m.at").alias("mine"), F.col("m.h").alias("key"), F.col("m.open").cast("array<int>").alias("open"), F.col("m.sig").alias("sig"), F.col("m.skips").cast("array<int>").alias("skips"), F.col("m.blocks").alias("blocks"))
    whole = wanted.join(heads.select("id", "h", "at"), "id").join(texts.select("id", "words"), "id").select("id", "mine", "key", "open", "sig", "skips", "blocks", "h", "at", "words")

    def run(batches):
        for batch in batches:
            (mine, mt), (key, _), (open_, _), (sig, _), (skips, _), (blocks, _), (h, ht), (at, _), (words_, wt) = (lists(batch.column(c)) for c in range(1, 10))
            row, near, off, before, after = np.repeat(np.arange(batch.num_rows), np.diff(mt)), [], [], [], []
            lies_open = np.concatenate([np.isin(at[ht[i] : ht[i + 1]], mine[mt[i] : mt[i + 1]][open_[mt[i] : mt[i + 1]] > 0]) for i in range(batch.num_rows)] or [[]])
            live = np.flatnonzero(blocks > 0)
            row = row[live]
            for i, y in zip(row.tolist(), mine[live].tolist()):
                start = int(wt[i])
                low, high = np.searchsorted(at[ht[i] : ht[i + 1]], (y - span, y + span + 1)) + ht[i]
                away = at[low:high] - y
                near.append(h[low:high][away != 0])
                off.append((2 * away + lies_open[low:high])[away != 0])
                before.append(words_[start + max(0, y - side) : start + y][::-1])
                after.append(words_[start + y + K : min(start + y + K + side, int(wt[i + 1]))])
            if len(row):
                found = []
                for rows, type_ in ((near, pa.int64()), (off, pa.int16()), (before, pa.int32()), (after, pa.int32())):
                    sizes = pa.array(np.cumsum([0] + [len(x) for x in rows]).astype(np.int32))
                    found.append(pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(rows), type_)))
                columns = [pa.array(key[live]), batch.column(0).take(pa.array(row)), pa.array(blocks[live]), pa.array(open_[live] > 0), pa.array(sig[live]), pa.array(skips[live] > 0), *found]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "id", "blocks", "open", "sig", "skips", "near", "off", "before", "after"])

    return whole.mapInArrow(run, f"k bigint, id {kind}, blocks int, open boolean, sig bigint, skips boolean, near array<bigint>, off array<smallint>, before array<int>, after array<int>")


def runs_of(rows: np.ndarray, group: np.ndarray):
    """A function of pairs of rows of one group: how many words they go on with each other.

    Rows are sorted by group and words; two rows share as many words as the least that neighbours between them do. What lies beyond a text is equal to nothing.
    """
    n, side = rows.shape
    length = (rows != BEYOND).sum(axis=1)
    order = np.lexsort((*rows.T[::-1], group))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    same = np.zeros((max(0, n - 1), side + 1), bool)
    np.equal(rows[order[:-1]], rows[order[1:]], out=same[:, :-1])
    levels = [same.argmin(axis=1).astype(np.int32)]
    most, span = int(np.bincount(group).max(initial=0)), 1
    while span * 2 < most:
        levels.append(np.minimum(levels[-1][: len(levels[-1]) - span], levels[-1][span:]))
        span *= 2
    width = max(1, n - 1)
    table = np.zeros((len(levels), width), np.int32)
    for k, level in enumerate(levels):
        table[k, : len(level)] = level

    def run(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        low, high = np.minimum(place[p], place[q]), np.maximum(place[p], place[q])
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.minimum(table[k, low], table[k, high - (1 << k)])
        return np.minimum(found, np.minimum(length[p], length[q]))

    return run


def aheads(rows: np.ndarray, beyond: int) -> np.ndarray:
    """A hash of the ``AHEAD`` words from each place of each row on."""
    rows = np.where(rows == BEYOND, beyond, rows).view(np.uint64)
    n = rows.shape[1] - AHEAD + 1
    out = np.zeros((len(rows), n), np.uint64)
    for k in range(AHEAD):
        out = mixed(out + rows[:, k : k + n] + np.uint64(0x9E3779B97F4A7C15))
    return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from each start on, and of which start each is."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(row)) + (starts - np.cumsum(sizes) + sizes)[row], row


def lesser_ones(group: np.ndarray, mine: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First of the lesser holders that each row meets, and how many there are, if rows are sorted by (group, block, id).

    Holders of one block meet each other, those of two blocks the ones of the other block.
    """
    rows = np.arange(len(group))
    fresh = np.append(True, group[1:] != group[:-1])
    first = rows[fresh][np.cumsum(fresh) - 1]
    n = rows - first
    second = np.flatnonzero(~fresh & np.append(False, mine[1:] != mine[:-1]))
    for mid, low, high in zip(second, first[second], np.append(np.flatnonzero(fresh), len(group))[np.cumsum(fresh)[second]]):
        n[low:mid], first[low:mid] = np.searchsorted(rank[mid:high], rank[low:mid]), mid
        n[mid:high], first[mid:high] = np.searchsorted(rank[low:mid], rank[mid:high]), low
    return first, n


def may_share(open_: np.ndarray, sig: np.ndarray, skips: np.ndarray, group: np.ndarray, first: np.ndarray, n: np.ndarray, near: np.ndarray, off: np.ndarray, ends: np.ndarray, before: np.ndarray, after: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(lesser, greater) holders of a seed, the greater one open, that may share a passage around it; each row has n lesser ones from ``first`` on.

    Where the words stop to be alike no edit can be passed, and all seeds near that both hold lie within these words, the
    chain ends there too: what it gives is as long as these words, or as ``extend`` says. All other pairs go on, once: not
    where an earlier open seed lies within the same words, as it says the same of the pair. If the seed before is open (``skips``) and lies
    within the same words by ``sig``, the pair isn't even looked at.
    """
    side, none = before.shape[1], 1 << 30
    runs = [runs_of(x, group) for x in (before, after)]
    ahead, own_ahead = [aheads(x, BEYOND) for x in (before, after)], [aheads(x, OTHER) for x in (before, after)]

    def goes_on(k: int, less: np.ndarray, greater: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words pairs go on alike on one side, and whether ``extend`` passes an edit there."""
        run = runs[k](less, greater)
        at = np.minimum(run, side - AHEAD - 1)
        p, q, p1, q1 = ahead[k][less, at], own_ahead[k][greater, at], ahead[k][less, at + 1], own_ahead[k][greater, at + 1]
        return run, (p1 == q1) | (p1 == q) | (p == q1)

    own_before, own_after = (np.where(x == BEYOND, OTHER, x) for x in (before, after))
    off, lies_open = off >> 1, (off & 1).astype(bool)
    # Seeds near, numbered in each group.
    at = np.repeat(group, np.diff(ends))
    order = np.lexsort((near, at))
    fresh = np.append(True, (near[order][1:] != near[order][:-1]) | (at[order][1:] != at[order][:-1]))[: len(order)]
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(fresh) - 1
    least = np.full(int(group.max(initial=0)) + 2, len(order))
    np.minimum.at(least, at, code)
    # Seeds that one holder of a group has alone are left out.
    several = np.bincount(code, minlength=1)[code] > 1
    number = np.cumsum(np.append(False, np.bincount(code[several], minlength=int(code.max(initial=0)) + 1) > 0))
    code, least = number[code[several]], number[np.minimum(least, len(number) - 1)]
    holder = np.repeat(np.arange(len(group)), np.diff(ends))[several]
    at, off, lies_open = at[several], off[several], lies_open[several]
    sizes = np.bincount(holder, minlength=len(group))
    ends = np.append(0, np.cumsum(sizes))
    code = code - least[at]
    codes = np.zeros(len(least), np.int64)
    np.maximum.at(codes, at, code + 1)
    asking = np.flatnonzero(open_ & (n > 0))
    total = np.append(0, np.cumsum(sizes))
    cost = np.cumsum(n[asking] * PAIR_CELLS + total[(first + n)[asking]] - total[first[asking]])
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    start = 0
    while start < len(asking):
        stop = max(start + 1, int(np.searchsorted(cost, (cost[start - 1] if start else 0) + CELLS, "right")))
        width = int(codes[group[asking[start:stop]]].max())
        stop = min(stop, start + max(1, CELLS // max(1, width)))
        c = asking[start:stop]
        start = stop
        less, row = spread(first[c], n[c])
        new = np.flatnonzero(~(skips[c][row] & (sig[less] == sig[c][row])))
        less, row = less[new], row[new]
        if not len(less):
            continue
        greater = c[row]
        back, back_edit = goes_on(0, less, greater)
        on, on_edit = goes_on(1, less, greater)
        keep = back + K + on >= min_words
        place = np.full((len(c), max(1, width)), none, np.int32)
        spots, own = spread(ends[c], sizes[c])
        place[own, code[spots]] = np.arange(len(spots))
        mine = spots
        spots, who = spread(ends[less], sizes[less])
        met_at = place[row[who], code[spots]]
        both = np.flatnonzero(met_at < none)
        mine, who = mine[met_at[both]], who[both]
        x, y = off[spots[both]], off[mine]
        low, high = -back[who], on[who]
        inside = (x == y) & (low <= y) & (y <= high)
        # A chain needs a seed within the words before or after it, in both texts.
        least_at, most_at = np.minimum(x, y), np.maximum(x, y)
        linked = ((least_at > low) & (most_at <= high + MAX_GAP)) | ((most_at < high) & (least_at >= low - MAX_GAP))
        keep[who[linked & (most_at - least_at < MAX_GAP) & ~inside]] = True
        again = np.zeros(len(keep), bool)
        again[who[inside & lies_open[mine] & (y < 0)]] = True
        keep &= ~again
        for i in np.flatnonzero(~keep & ~again & (back_edit | on_edit)).tolist():
            p, q = less[i], greater[i]
            gone = [extend(a[p], b[q])[:2] for a, b in ((before, own_before), (after, own_after))]
            # So near the last known word ``extend`` can't look ahead.
            far = max(max(g) for g in gone) >= side - AHEAD - 1
            keep[i] = far or all(gone[0][k] + K + gone[1][k] >= min_words for k in (0, 1))
        found.append((less[keep], greater[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def filled(rows: pa.ListArray, side: int) -> np.ndarray:
    """Lists of at most ``side`` words as rows, filled up with what lies beyond a text."""
    values, ends = lists(rows)
    sizes = np.diff(ends)
    out = np.full((len(rows), side), BEYOND)
    out[np.repeat(np.arange(len(rows)), sizes), np.arange(len(values)) - np.repeat(ends[:-1], sizes)] = values
    return out


def met(members: DataFrame, heads: DataFrame, texts: DataFrame, min_words: int) -> DataFrame:
    """(a, b): holders of a seed that may share a passage around it, b open and a lesser, of seeds (id, h, at, open, sig, skips)."""
    kind = members.schema["id"].dataType.simpleString()
    side = side_of(min_words)
    # Where all holders have the same seed and words before and that seed is open too, it says the same of all their pairs.
    same = (F.min("sig") == F.max("sig")) & (F.min("sig") != 0) & F.min(~F.col("open") | F.col("skips"))
    sizes = members.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / FEW).cast("int").alias("blocks"), same.alias("same"))
    dealt = joined(members, stored(sizes.filter("not same").drop("same"), "groups"), "h", "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)))
    dealt = contexts(dealt, heads, texts, min_words)
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("k", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "open", "sig", "skips", "near", "off", "before", "after")

    def choose(part):
        ids = part["id"].combine_chunks()
        rank = np.empty(len(part), np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(part))
        k, i, j, mine = (part[c].to_numpy() for c in ("k", "i", "j", "mine"))
        order = np.lexsort((rank, mine, j, i, k))
        k, i, j, mine, rank = (x[order] for x in (k, i, j, mine, rank))
        part = part.take(pa.array(order))
        group = np.cumsum(np.append(False, (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        near, ends = lists(part["near"].combine_chunks())
        off = lists(part["off"].combine_chunks())[0].astype(np.int64)
        before, after = (filled(part[c].combine_chunks(), side) for c in ("before", "after"))
        open_, skips = (part[c].to_numpy().astype(bool) for c in ("open", "skips"))
        pairs = may_share(open_, part["sig"].to_numpy(), skips, group, *lesser_ones(group, mine, rank), near, off, ends, before, after, min_words)
        ids = part["id"].combine_chunks()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)) for x in pairs], names=["a", "b"])

    def run(batches):
        # Whole groups, many at a time, as most are small.
        rest = None
        for part in (batch.slice(n, STEP_HOLDERS) for batch in batches for n in range(0, batch.num_rows, STEP_HOLDERS)):
            table = pa.Table.from_batches([part]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([part])])
            k, i, j = (table.column(c).to_numpy() for c in range(3))
            start = int(np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))[-1])
            if start:
                yield from choose(table.slice(0, start))
            rest = table.slice(start)
        if rest is not None:
            yield from choose(rest)

    dealt = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def side_of(min_words: int) -> int:
    """Words beside a seed that tell whether a passage of it alone is long enough, and what follows them."""
    return max(0, min_words - K) + AHEAD + 2


def span_of(min_words: int) -> int:
    """Words from a seed to all that a chain can link next to seeds within fewer than ``min_words`` words around it."""
    return max(0, min_words - K) + MAX_GAP


def texts_of(docs: DataFrame, doc_id: str, text: str, ids: DataFrame) -> DataFrame:
    """(id, words): hashed words of the documents of a narrow table of ids."""
    # A filter on the words would have them made twice.
    raw = picked(docs, (doc_id, "id"), (text, "text")).filter(F.lower("text").rlike(WORD))
    texts = joined(raw, ids, "id", "left_semi").select("id", F.transform(words(F.col("text")), lambda w: F.hash(w)).alias("words"))
    return texts.dropDuplicates(["id"])


def shared_passages(docs: DataFrame, min_words: int = 50, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages of documents that another, lesser document holds too.

    doc_id, start_word, end_word, other_id, other_start, other_end (ends exclusive, counted in words of
    letters and digits), n_words, similarity.
    """
    found = stored(seeds(docs, doc_id, text), "seeds")
    reps = stored(found.filter("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.min("n").alias("n")).filter("rep is not null"), "representatives")
    heads = found.join(reps.select("key", "rep"), (found["id"] == reps["rep"]) & (found["key"] == reps["key"]), "left_semi")
    heads = stored(heads.select("id", "h", "at"), "heads")
    entries = heads.select("id", F.explode(F.arrays_zip("h", "at")).alias("s")).select("id", "s.h", "s.at")
    shared = stored(held_by_several(entries), "shared")
    linked = stored(chains(shared.filter("id <> a").select("a", F.col("id").alias("b"), "x", F.col("at").alias("y"))), "chains")
    # All holders of a seed that two documents hold are here, so no later round needs others.
    some = stored(shared.select("id").distinct(), "chained")
    mine = shared.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("at", "h", (F.col("id") == F.col("a")).alias("first")))).alias("s"))
    mine = mine.select("id", F.col("s.h").alias("h"), F.col("s.at").alias("at"), F.col("s.first").alias("first"))
    one = stored(with_links(mine.join(texts_of(docs, doc_id, text, some), "id"), side_of(min_words)), "holders")
    texts = one.select("id", "words")
    rounds = [stored(aligned(linked, texts, min_words, least), "passages")]

    def uncovered(seeds_: DataFrame) -> DataFrame:
        """Of (id, h, at), those whose words no passage found in the last round covers."""
        spans = rounds[-1].groupBy(F.col("b").alias("id")).agg(F.collect_set(F.struct("y0", "y1")).alias("spans"))
        inside = F.exists("spans", lambda s: (s["y0"] <= F.col("at")) & (F.col("at") + K <= s["y1"]))
        return seeds_.join(spans, "id", "left").filter(F.col("spans").isNull() | ~inside).select("id", "h", "at")

    def again(pairs: DataFrame, left: DataFrame) -> None:
        """Judge pairs (a, b) by all seeds they share."""
        new = stored(judged(pairs, one, left), "chains")
        rounds.append(stored(aligned(new, texts, min_words, least), "passages"))

    spots = one.select("id", F.explode(F.arrays_zip("h", "at", "first", "sig", "prev")).alias("s")).select("id", "s.*")
    left = stored(uncovered(spots.filter("not first")), "open")
    firsts = left.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("hi")).filter("a < hi")
    again(stored(left.join(firsts, "h").filter("id <> a").select("a", F.col("id").alias("b")).distinct(), "pairs"), left)
    left = stored(uncovered(left), "open")
    # A holder behind all documents in which a seed is open is lesser than none of them.
    keys = stored(left.groupBy("h").agg(F.max("id").alias("hi")), "keys")
    mine = left.groupBy("id").agg(F.collect_set("at").alias("mine"))
    members = joined(spots, keys, "h").filter("id <= hi").join(mine, "id", "left")
    is_open = [F.coalesce(F.array_contains("mine", F.col(at)), F.lit(False)) for at in ("at", "prev")]
    members = members.select("id", "h", "at", is_open[0].alias("open"), "sig", (is_open[1] & (F.col("sig") != 0)).alias("skips"))
    members = stored(members, "members")
    again(stored(met(members, one, texts, min_words), "pairs"), left)
    fuzzy = rounds[0].unionByName(rounds[1]).unionByName(rounds[2]).distinct()
    names = ("doc_id", "start_word", "end_word", "other_id", "other_start", "other_end", "n_words", "similarity")
    fuzzy = fuzzy.select("b", "y0", "y1", "a", "x0", "x1", (F.col("y1") - F.col("y0")).alias("n"), "similarity").toDF(*names)
    zero = F.lit(0)
    copies = found.select("id", "key").join(reps, "key").filter((F.col("id").isNull() | (F.col("id") != F.col("rep"))) & (F.col("n") >= min_words))
    copies = copies.select("id", zero, "n", "rep", zero, "n", "n", F.lit(1.0)).toDF(*names)
    return fuzzy.unionByName(copies)
