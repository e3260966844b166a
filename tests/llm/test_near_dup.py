import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factsheet.llm import near_dup, passages
from factsheet.llm.align import distance
from tests.llm.fixtures import SCHEMA, odd_rows, sentence


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distance_is_edit_distance_within_the_band():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.randrange(6) for _ in range(rng.randrange(40))]
        b = list(a) if rng.random() < 0.6 else [rng.randrange(6) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(6)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(6))
        most, true = rng.randrange(15), edits(a, b)
        assert distance(np.array(a, int), np.array(b, int), most) == (true if true <= most else None)


def test_sketch_follows_order():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 1 << 60, 200)
    turned = np.concatenate([text[100:], text[:100]])
    same = (near_dup.order_sketch(text) == near_dup.order_sketch(text)).mean()
    assert same == 1 and (near_dup.order_sketch(text) == near_dup.order_sketch(turned)).mean() < 0.8
    assert len(near_dup.order_sketch(text[:0])) == 0 and len(near_dup.order_sketch(text[:3])) == near_dup.SKETCHES


def groups(rows):
    """Classes by comparing all pairs."""
    words = {i: t.split() for i, t in rows}
    root = {i: i for i in words}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(words)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = words[a], words[b]
            if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and edits(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def planted(seed):
    """Groups of near copies, and texts that share only a passage."""
    rng, rows = random.Random(seed), []
    passage = sentence(rng, 40)
    for _ in range(6):
        words = sentence(rng, 90).split()
        for copy in range(4):
            mine = list(words)
            for _ in range(0 if copy == 0 else 4):
                mine[rng.randrange(len(mine))] = sentence(rng, 1)
            rows.append(" ".join(mine))
    rows += [sentence(rng, 50) + " " + passage + " " + sentence(rng, 20) for _ in range(25)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = planted(seed)
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == groups(rows)


def test_large_bucket_of_unlike_texts(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "FEW", 2)
    rows = planted(3)
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == groups(rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    found = near_dup.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    classes = defaultdict(set)
    for r in found:
        classes[r.doc_id].add(r.class_id)
    assert classes[1] == classes[2] == classes[3] == {1} and classes[None] == {1, None}
    assert all(classes[i] == {i} for i in (4, 5, 6, 7, 8, 13)) and classes[9] == {8} and classes[11] == {10}
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 4, 5, 6, 7, 8, 10, 12, 13, None}
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0 and near_dup.keep_one(docs.limit(0)).count() == 0


def test_passages_of_planted_texts(spark):
    rng = random.Random(9)
    passage = sentence(rng, 70).split()
    fuzzy = list(passage)
    fuzzy[33] = "another"
    rows = [(i, " ".join(sentence(rng, 60).split() + (fuzzy if i % 2 else passage) + sentence(rng, 30 + i).split())) for i in range(12)]
    rows += [(100 + i, sentence(rng, 150)) for i in range(8)]
    found = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == set(range(1, 12)) and {r.other_id for r in found} <= set(range(12))
    for r in found:
        assert r.start_word <= 60 and r.end_word >= 130 and r.n_words >= 50 and r.similarity > 0.9


def test_short_passages_are_left_alone(spark):
    rng = random.Random(10)
    passage = sentence(rng, 40)
    rows = [(i, sentence(rng, 60) + " " + passage + " " + sentence(rng, 60)) for i in range(5)]
    assert passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_chain_keeps_order_and_breaks_at_gaps():
    x = np.array([0, 5, 10, 200, 205, 7])
    y = np.array([0, 5, 10, 40, 45, 300])
    assert sorted(passages.chain(x, y)) == [(0, 10, 0, 10, 3), (7, 7, 300, 300, 1), (200, 205, 40, 45, 2)]


def test_passages_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    found = {(r.doc_id, r.other_id) for r in passages.shared_passages(docs).collect()}
    assert {(2, 1), (None, 1), (3, 1), (11, 10)} <= found and not {r for r in found if r[0] in (4, 5, 6, 7, 8, 9, 13)}
    assert passages.shared_passages(docs.limit(0)).count() == 0


@pytest.mark.parametrize("first, gap, second", [(55, 25, 23), (55, 30, 55), (23, 20, 55), (60, 45, 60)])
def test_runs_apart_are_judged_each(spark, first, gap, second):
    rng = random.Random(first + gap)
    one, two = sentence(rng, first), sentence(rng, second)
    rows = [(i, " ".join((sentence(rng, 40), one, sentence(rng, gap), two, sentence(rng, 40)))) for i in (1, 2)]
    found = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = [(r.start_word, r.end_word) for r in found]
    assert all(edits(rows[1][1].split()[r.start_word : r.end_word], rows[0][1].split()[r.other_start : r.other_end]) <= 0.2 * r.n_words + 1 for r in found)
    for start, n in ((40, first), (40 + first + gap, second)):
        assert n < 50 or any(a <= start and b >= start + n for a, b in covered)


def test_parts_equal_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 9)
        xs = np.cumsum([rng.randrange(1, 40) for _ in range(n)])
        ys = np.cumsum([rng.randrange(1, 40) for _ in range(n)])
        between = np.array([rng.randrange(12) for _ in range(n - 1)], int)
        found = passages.parts(xs, ys, between, 0.8)
        assert [k for i, j in found for k in range(i, j + 1)] == list(range(n))
        passing = [xs[j] - xs[i] for i in range(n) for j in range(i, n) if between[i:j].sum() <= 0.2 * (max(xs[j] - xs[i], ys[j] - ys[i]) + passages.K) + 1e-9]
        assert max(xs[j] - xs[i] for i, j in found) == max(passing)


def test_chains_go_on_behind_a_long_run():
    run, later = np.arange(60) * 8, 60 * 8 + 100 + np.arange(5) * 8
    x, y = np.append(run, later), np.append(run, later + 7)
    assert sorted(passages.chain(x, y)) == [(0, 472, 0, 472, 60), (580, 612, 587, 619, 5)]


def best_score(x, y):
    """Score of the best chain by trying all predecessors."""
    score = {}
    for i in sorted(range(len(x)), key=lambda i: (x[i], y[i])):
        near = [score[j] - passages.GAP_COST * (x[i] - x[j] + y[i] - y[j]) for j in score if 0 < x[i] - x[j] <= passages.MAX_GAP and 0 < y[i] - y[j] <= passages.MAX_GAP]
        score[i] = 1 + max([0, *near])
    return max(score.values())


def test_best_chain_equals_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        x, y = rng.choice(400, n, replace=False), rng.choice(400, n, replace=False)
        found = passages.collinear(x, y)
        assert sorted(i for m in found for i in m) == list(range(n))
        scores = [len(m) - passages.GAP_COST * float(x[m[-1]] - x[m[0]] + y[m[-1]] - y[m[0]]) for m in found]
        assert all(0 < d <= passages.MAX_GAP for m in found for v in (x, y) for d in np.diff(v[m])) and np.isclose(max(scores), best_score(x, y))


def test_fuzzy_passage_behind_a_long_one(spark):
    rng = random.Random(12)
    long, one, two = sentence(rng, 500), sentence(rng, 30), sentence(rng, 30)
    rows = [(i, " ".join((long, sentence(rng, 60), one, sentence(rng, 3), two, sentence(rng, 20)))) for i in (1, 2)]
    found = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.start_word, r.end_word) for r in found) == [(0, 500), (560, 623)]


def test_pairs_of_a_bucket_that_nothing_else_splits(spark):
    rng = random.Random(14)
    passage, texts = sentence(rng, 60), []
    for _ in range(30):
        own = sentence(rng, 20).split()
        texts += [passage + " " + " ".join(own), passage + " " + " ".join([*own[:9], "changed", *own[10:]])]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    element = {r.id: tuple(r.elements) for r in near_dup.signatures(docs, "doc_id", "text", 1).collect()}
    large = max(set(element.values()), key=list(element.values()).count)
    together = [r for r in rows if element[r[0]] == large]
    assert len(together) > 20
    found = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs, sketches=1).collect()}
    assert {i: found[i] for i, _ in together} == groups(together)


def test_bins_rule_no_similar_pair_out():
    rng = random.Random(15)
    texts = []
    for _ in range(30):
        words = [rng.randrange(50) for _ in range(rng.randrange(1, 60))]
        texts.append(words)
        mine = list(words)
        for _ in range(rng.randrange(1 + len(words) // 5)):
            mine[rng.randrange(len(mine))] = rng.randrange(50)
        texts.append(mine)
    n, root = np.array([len(t) for t in texts]), np.arange(len(texts)) // 7
    bins = np.stack([np.bincount(t, minlength=near_dup.BINS) for t in texts]).astype("<i2")
    every = np.arange(len(texts))
    left, right = near_dup.may_be_similar(n, root, bins, every, every, 0.8)
    found = {frozenset(p) for p in zip(left.tolist(), right.tolist())}
    assert len(found) == len(left) and all(root[a] != root[b] for a, b in found)
    alike = {frozenset((a, b)) for a in every.tolist() for b in range(a) if root[a] != root[b] and edits(texts[a], texts[b]) <= 0.2 * max(n[a], n[b]) + 1e-9}
    assert alike <= found


def test_passage_whose_parts_lie_in_lesser_documents(spark):
    rng, rows = random.Random(21), []
    for n in range(6):
        passage = sentence(rng, 55).split()
        mine = [" ".join(passage[:40]), " ".join(passage[15:]), " ".join(passage), " ".join(passage)]
        rows += [(4 * n + k, " ".join((sentence(rng, 30), part, sentence(rng, 30)))) for k, part in enumerate(mine)]
    found = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for n in range(6):
        assert any(r.doc_id == 4 * n + 3 and r.other_id == 4 * n + 2 and r.start_word <= 30 and r.end_word >= 85 for r in found)
    assert {r.doc_id for r in found} == {4 * n + 3 for n in range(6)}


def test_open_seed_meets_documents_that_are_covered(spark, monkeypatch):
    monkeypatch.setattr(passages, "FEW", 2)
    rng = random.Random(22)
    whole = sentence(rng, 120).split()

    def around(words):
        return " ".join((sentence(rng, 30), " ".join(words), sentence(rng, 30)))

    # 2 lies in 0 whole; the end of 5 lies in 2 alone, and the least holders of its seeds, 1 and 3, hold 40 words.
    texts = [whole[:60], whole[60:100], whole, whole[80:], whole[:30], whole[60:]]
    rows = [(i, around(t)) for i, t in enumerate(texts)]
    found = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert any(r.doc_id == 5 and r.other_id == 2 and r.start_word <= 30 and r.end_word >= 90 for r in found)
    assert any(r.doc_id == 2 and r.other_id == 0 and r.n_words >= 60 for r in found)


def all_holders(members, heads, texts, min_words):
    return members.select("h", F.col("id").alias("a")).join(members.filter("open").select("h", F.col("id").alias("b")), "h").filter("a < b").select("a", "b").distinct()


@pytest.mark.parametrize("few, min_words, least", [(2, 30, 20), (1024, 50, 10)])
def test_pairs_left_out_have_no_passage(spark, monkeypatch, few, min_words, least):
    rng, rows = random.Random(24), []
    lines = [sentence(rng, n).split() for n in (20, 35, 44, 70)] + [["of"] * 45, ["of"] * 20 + ["to"] * 38]
    for i in range(40):
        text = []
        for _ in range(3):
            line = list(rng.choice(lines))
            line = line[rng.randrange(8) :][: rng.randrange(12, 80)]
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                at = rng.randrange(len(line))
                line[at : at + rng.randrange(2)] = rng.choice(([], ["changed"], sentence(rng, 2).split()))
            text += sentence(rng, rng.choice((0, 3, 30, 60))).split() + line
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(passages, "FEW", few)
    found = sorted(map(tuple, passages.shared_passages(docs, min_words).collect()))
    monkeypatch.setattr(passages, "met", all_holders)
    assert found == sorted(map(tuple, passages.shared_passages(docs, min_words).collect()))
    assert len(found) > least


def test_short_common_line_gives_no_pairs(spark, monkeypatch):
    rng, seen, judged = random.Random(25), [], passages.judged
    line = sentence(rng, 42)
    rows = [(i, " ".join((sentence(rng, 30), line, sentence(rng, 30)))) for i in range(30)]

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return judged(pairs, *rest)

    monkeypatch.setattr(passages, "judged", counted)
    assert passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    assert seen == [28, 0]


def test_seeds_that_say_the_same_do_not_meet(spark, monkeypatch):
    rng, seen, contexts = random.Random(26), [], passages.contexts
    line = sentence(rng, 42)
    rows = [(i, " ".join((sentence(rng, 30), line, sentence(rng, 30)))) for i in range(30)]

    def counted(members, *rest):
        found = contexts(members, *rest)
        seen.append((found.count(), members.count()))
        return found

    monkeypatch.setattr(passages, "contexts", counted)
    assert passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    (met, held), = seen
    assert 30 <= met <= held / 2


def test_words_that_go_on_equal_brute_force():
    rng, side = np.random.default_rng(27), 8
    rows = np.full((60, side), passages.BEYOND)
    for row in rows:
        n = rng.integers(0, side + 1)
        row[:n] = rng.integers(0, 2, n)
    group = np.sort(rng.integers(0, 9, 60))
    p, q = np.nonzero((group[:, None] == group) & ~np.eye(60, dtype=bool))
    alike = [next((k for k in range(side) if a[k] != b[k] or a[k] == passages.BEYOND), side) for a, b in zip(rows[p], rows[q])]
    assert passages.runs_of(rows, group)(p, q).tolist() == alike
    assert passages.runs_of(rows[:1], group[:1])(p[:0], p[:0]).tolist() == []


@pytest.mark.parametrize("kind", ["long", "string"])
def test_seeds_that_several_documents_hold(spark, kind):
    rng = random.Random(28)
    rows = [(rng.randrange(40), rng.choice((0, rng.randrange(60))), rng.randrange(9)) for _ in range(200)]
    entries = spark.createDataFrame(rows, "id long, h bigint, at int").selectExpr(f"cast(id as {kind}) id", "h", "at")
    rows = [tuple(r) for r in entries.collect()]
    holders = {h: {i for i, g, _ in rows if g == h} for _, h, _ in rows}
    least = {h: min((i, at) for i, g, at in rows if g == h) for h in holders}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = sorted(map(tuple, passages.held_by_several(entries).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == sorted((i, h, at, *least[h]) for i, h, at in rows if len(holders[h]) > 1)


def test_blocks_hand_on_links_and_not_pairs(spark, monkeypatch):
    rng, texts = random.Random(23), []
    passage = sentence(rng, 60)
    base = (passage + " " + sentence(rng, 20)).split()
    for _ in range(24):
        mine = list(base)
        for at in rng.sample(range(60, 80), 8):
            mine[at] = sentence(rng, 1)
        texts.append(" ".join(mine))
    handed = []

    def met(entries, *rest, met=near_dup.met):
        handed.append((entries.select("id").distinct().count(), entries.count(), near_dup.stored(met(entries, *rest), "links")))
        return handed[-1][2]

    monkeypatch.setattr(near_dup, "ROUNDS", 0)
    monkeypatch.setattr(near_dup, "met", met)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_dup.near_duplicates(docs, sketches=1).collect()
    members, entries, links = handed[0]
    # Texts that share the element are similar; each of their two buckets hands on a tree at most.
    distinct = len({tuple(r.elements) for r in near_dup.signatures(docs, "doc_id", "text", 1).collect()})
    assert entries == 2 * members and 24 - distinct <= links.count() <= 2 * (24 - distinct) < 16
    assert len({r.class_id for r in found}) == distinct
