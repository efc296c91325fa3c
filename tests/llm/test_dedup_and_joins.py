import collections
import hashlib
import random
import re

import numpy as np
import pytest

from quarrylight.llm import components, exact_dedup, ngram_join
from tests.llm import cases


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(norm.encode()).hexdigest()) for norm, g in groups.items() for _, i in g}


def test_exact_dedup_matches_brute_force(spark):
    docs = cases.documents(spark)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == brute_exact(docs.collect())


def test_drop_copies_keeps_one_of_each_and_all_columns(spark):
    docs = cases.clashing(cases.documents(spark), "fp", "norm", "raw", "_gone_id", "kept")
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    want = {i for i, v in brute_exact(docs.collect()).items() if v[2]}
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_drop_copies_with_repeated_rows(spark):
    docs = cases.documents(spark, 5)
    twice = docs.union(docs)
    assert exact_dedup.drop_copies(twice).count() == exact_dedup.drop_copies(docs).count()
    same_id = spark.createDataFrame([(1, "one two", "en", "s", 7), (1, "three", "en", "s", 5)], cases.SCHEMA)
    assert exact_dedup.drop_copies(same_id).count() == 2


def test_counting_quotient_filter_merges_without_loss():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    a[:900] = a[0]
    b[:300] = a[0]
    make = lambda x: exact_dedup.CountingQuotientFilter.of(x, 10)
    merged = make(a).merge(exact_dedup.CountingQuotientFilter.from_bytes(make(b).to_bytes()))
    prints, counts = merged.items()
    want = collections.Counter(a.tolist() + b.tolist())
    assert dict(zip(prints.tolist(), counts.tolist(), strict=True)) == want
    back = {}
    for block, part in merged.blocks(3):
        p, c = part.items()
        back |= dict(zip(((p >> np.uint64(3)) | (np.uint64(block) << np.uint64(61))).tolist(), c.tolist(), strict=True))
    assert back == want


def shingles(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_near(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    links, root = collections.Counter(), {i: i for i, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                links[i] += 1
                links[j] += 1
                p, q = top(i), top(j)
                root[max(p, q)] = min(p, q)
    return {i: (top(i), links[i]) for i, _ in sets}


@pytest.mark.parametrize("sizes", [{}, {"SLICE_SETS": 3, "CHUNK_SETS": 2, "BLOCK_SETS": 4}, {"SLICE_SETS": 2, "CHUNK_SETS": 1, "SPLIT_OTHERS": 1, "SPLIT_LEVELS": 1}])
def test_near_duplicates_match_brute_force(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(ngram_join, k, v)
    docs = cases.documents(spark)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute_near(docs.collect())


def test_near_duplicates_at_the_threshold(spark):
    r = random.Random(4)
    rows = []
    for k in range(60):
        w = cases.words(r, 84).split(" ")
        cut = r.randint(0, 18)
        rows += [(2 * k, " ".join(w), "en", "s", 1), (2 * k + 1, " ".join([*w[cut:], *cases.words(r, r.randint(0, 3)).split()]), "en", "s", 1)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute_near(rows)


def test_drop_near_copies_keeps_one_of_each_class(spark):
    docs = cases.clashing(cases.documents(spark), "f1", "rep", "_near_id")
    out = ngram_join.drop_near_copies(docs)
    assert out.columns == docs.columns
    want = {i for i, (c, _) in brute_near(docs.collect()).items() if c == i}
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_drop_near_copies_with_repeated_and_null_ids(spark):
    r = random.Random(6)
    a, b, c, d, e, f, g, h, i, j, k, m = (cases.words(r, 120) for _ in range(12))
    near = lambda t: f"{t} more"
    rows = [(5, a), (5, b), (3, near(a)), (7, c), (None, near(c)), (None, d), (20, e), (20, e), (20, f), (30, g), (30, h), (None, i), (None, j), (None, k), (None, k), (40, m), (40, near(m)), (None, ""), (None, ""), (5, None)]
    docs = spark.createDataFrame([(n, t, "en", "s", 1) for n, t in rows], cases.SCHEMA)
    got = collections.Counter((x.doc_id, x.text) for x in ngram_join.drop_near_copies(docs).collect())
    one = [x for x in ((40, m), (40, near(m))) if x in got]
    assert len(one) == 1
    assert got == collections.Counter([(3, near(a)), (5, b), (7, c), (None, d), (20, e), (20, f), (30, g), (30, h), (None, i), (None, j), (None, k), *one, (None, ""), (None, ""), (5, None)])


def test_empty_tables(spark):
    docs = cases.empty(spark)
    assert exact_dedup.exact_dedup(docs).count() == 0
    assert exact_dedup.drop_copies(docs).count() == 0
    assert ngram_join.near_duplicates(docs).count() == 0
    assert ngram_join.drop_near_copies(docs).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def test_repetitions_reach_the_recall():
    assert ngram_join.repetitions(1, 0.9) < ngram_join.repetitions(3, 0.9) < ngram_join.repetitions(3, 0.999)
