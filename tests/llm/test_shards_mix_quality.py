import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quarrylight.llm import mixing, quality, sharding
from tests.llm import cases


def test_shards_by_key_have_gapless_slots_and_grow_into_the_new_one_only(spark, tmp_path):
    docs = cases.documents(spark, 200)
    rows = sharding.op4_two_pass_shuffle(spark, cases.sf(docs, tmp_path)).collect()
    source = {r.doc_id: r.text or "" for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(source)
    slots = collections.defaultdict(list)
    for r in rows:
        assert r.size == len(source[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(source[r.doc_id].encode())
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16 and r.law == "key"
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert any(r.grown_shard == 16 for r in rows)


def test_shuffle_is_seeded_and_repeats(spark):
    docs = cases.documents(spark, 100).select("doc_id", "text")
    run = lambda d, seed: {(r.doc_id): (r.shard, r.slot) for r in sharding.shuffle_shards(d, "doc_id", 3, seed=seed).collect()}
    assert run(docs, 1) == run(docs.repartition(7), 1) != run(docs, 2)


def test_fisher_yates_matches_its_definition(spark):
    n = 50
    got = spark.range(1).select(sharding.fisher_yates(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(9)).alias("p"), F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.pmod(F.xxhash64(F.lit(9), i), i + 1).cast("int")).alias("draws")).first()
    want = [0]
    for i, j in enumerate(got.draws, 1):
        want.append(want[j] if j < i else i)
        want[j] = i
    assert got.p == want and sorted(want) == list(range(n))


def test_shards_with_a_row_that_repeats_very_often(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    same = spark.range(300).select(F.lit(5).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shuffle_shards(cases.clashing(same.union(spark.createDataFrame([(None, None), (7, "y")], "doc_id long, text string")), "shard", "slot", "_row"), "doc_id", 2).collect()
    assert len(rows) == 302
    for s in (0, 1):
        assert sorted(r.slot for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert {"_shard", "_slot", "_row"} <= set(rows[0].asDict())


def test_query_moves_whole_documents_into_the_shards(spark, tmp_path, monkeypatch):
    written, write = [], sharding.write_shards
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 4)
    monkeypatch.setattr(sharding, "TASK_BYTES", 1 << 13)
    monkeypatch.setattr(sharding, "write_shards", lambda df, path, **more: (written.append(path), write(df, path, **more)))
    docs = cases.documents(spark, 200)
    rows = {r.doc_id: r for r in sharding.op4_two_pass_shuffle(spark, cases.sf(docs, tmp_path)).collect()}
    assert len(written) == 1
    stored = spark.read.parquet(written[0]).withColumn("file", F.input_file_name()).collect()
    plain = lambda r: (r.doc_id, r.text, r.lang, r.source, r.n_chars)
    assert sorted(map(plain, stored), key=lambda r: r[0]) == sorted(map(plain, docs.collect()), key=lambda r: r[0])
    slots = collections.defaultdict(list)
    for r in stored:
        assert (r["shard"], r.slot, r.grown_shard) == (rows[r.doc_id]["shard"], rows[r.doc_id].slot, rows[r.doc_id].grown_shard)
        slots[r.file].append(r.slot)
    assert all(s == list(range(s[0], s[0] + len(s))) for s in slots.values()) and len(slots) > 16


def test_slots_have_no_gaps_where_rows_are_read_in_another_order(spark, monkeypatch):
    def dealt(frames):  # a new order each time the rows are read, as from a shuffle
        for f in frames:
            yield f.sample(frac=1)

    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    ids = spark.range(600).selectExpr("if(id < 300, 5, id) AS doc_id").coalesce(1).mapInPandas(dealt, "doc_id long")
    rows = sharding.shuffle_shards(ids, "doc_id", 2).collect()
    assert len(rows) == 600
    for s in (0, 1):
        assert sorted(r.slot for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / share for s in order}
        over = {s for s in order if target[s] > 2 * sizes[s]} - full
        if not over:
            return target
        full |= over


def test_mix_meets_its_targets(spark, tmp_path):
    docs = cases.documents(spark, 80)
    rows = mixing.op8_curriculum_mix(spark, cases.sf(docs, tmp_path)).collect()
    source = {r.doc_id: r for r in docs.collect()}
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = collections.Counter(), collections.Counter()
    for r in source.values():
        sizes[r.source] += count(r.text)
    target = brute_targets(sizes)
    for r in rows:
        s = source[r.doc_id]
        assert r.size == count(s.text) and r.source_size == sizes[s.source] and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(target[s.source])
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
        taken[s.source] += r.taken
    assert len(rows) == len(source)
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    seen = [r.position for r in rows if r.position is not None]
    assert seen == sorted(seen)


def test_mix_returns_documents_in_training_order(spark):
    docs = cases.clashing(cases.documents(spark, 40), "size", "position", "_mix_id")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    times = collections.Counter(r.doc_id for r in out.collect())
    assert max(times.values()) <= 2
    assert mixing.mix(cases.empty(spark)).count() == 0


def test_demand_is_inverted(spark):
    for i in range(3):
        got = spark.range(101).select((F.col("id") / 100).alias("u"), mixing.invert_demand(F.col("id") / 100, F.lit(i)).alias("t")).collect()
        for r in got:
            demand = max((d + w * (r.t - t0) + s / 2 * (r.t - t0) ** 2 for d, t0, n, w, s in mixing._integrated(mixing.SCHEDULES[i]) if t0 <= r.t), default=0)
            assert demand == pytest.approx(r.u, abs=1e-9)


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_counts_match_brute_force(spark, tmp_path):
    docs = cases.documents(spark)
    more = [(900 + i, t, "en", "s", 1) for i, t in enumerate(["a\na\n\na\n b\nb", "x y z x y z x", "one\n", "\n\n", "a b a b a b " * 40, "## $$\r\n## $$\r\n", "same line\nsame line", "é é é é é é"])]
    docs = docs.union(spark.createDataFrame(more, cases.SCHEMA))
    rows = {r.doc_id: r for r in quality.op10_adaptive_quality(spark, cases.sf(docs, tmp_path)).collect()}
    for r in docs.collect():
        n, chars, symbols, dup, rep = brute_counts(r.text)
        got = rows[r.doc_id]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (n, chars, symbols, dup, rep), r.text
        assert got.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (got.base_failed and got.kept)


def test_unusual_documents_go_and_usual_ones_stay(spark):
    docs = cases.documents(spark, 80).filter("doc_id < 80")
    junk = spark.createDataFrame([(1000 + i, " ".join(f"w{i}{k}***" for k in range(80)), "en", "src1", 1) for i in range(3)], cases.SCHEMA)
    kept = {r.doc_id for r in quality.keep_usual(cases.clashing(docs.union(junk), "n_words", "kept")).collect()}
    assert kept == set(range(80))
    assert quality.keep_usual(cases.empty(spark)).count() == 0


def test_a_source_that_is_40_percent_junk_loses_its_junk(spark):
    r = random.Random(8)
    symbols = lambda: " ".join(f"{w}***" for w in cases.words(r, 80).split(" "))
    lines = lambda: "\n".join([cases.words(r, 60), *r.choices([f"line{k}" for k in range(12)], k=40)])
    repeats = lambda: " ".join([p := cases.words(r, 20), cases.words(r, 60), p])
    rows = []
    for s, junk in (("symbols", symbols), ("lines", lines), ("repeats", repeats)):
        rows += [(1000 + len(rows) + k, cases.words(r, 80), "en", s, 1) for k in range(120)]
        rows += [(-1000 - len(rows) - k, junk(), "en", s, 1) for k in range(80)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    assert not quality.annotate(docs).filter(quality.base_failed()).count()
    assert sorted(x.doc_id for x in quality.keep_usual(docs).collect()) == sorted(i for i, *_ in rows if i > 0)


def brute_kept(rows):
    """doc_id -> kept, from the words of the rule alone: plain lists instead of sketches."""
    import math

    def cell(v):
        e = max(0, v.bit_length() - 5)
        return v if v < 16 else 16 * e + (v >> e)

    def share(k, n, unit):
        return cell(math.floor(1000 * max(0.0, k - 3 * math.sqrt(unit * k)) / n) if n else 0)

    told = {}
    for i, text, lang, source, _ in rows:
        n, chars, symbols, dup, rep = brute_counts(text)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
        told[i] = (lang, source, n < 50 or 100 * rep > 50 * n, (share(symbols, chars, 1), share(dup, lines, 1), share(rep, n, 3)))

    def fence(values):
        values = sorted(values)
        if not values:
            return None, False
        n, total, best = len(values), sum(values), None
        for k in range(1, n):
            if values[k] != values[k - 1]:
                gap = float(total) * float(k) - float(n) * float(sum(values[:k]))
                score = gap * gap / (float(k) * (float(n) - float(k)))
                if best is None or score > best[0]:
                    best = score, k
        tail = [v for v in values if v]
        if best:
            low, high = values[: best[1]], values[best[1] :]
            if 2 * len(high) < n and high[math.ceil(len(high) / 10) - 1] - low[math.ceil(0.99 * len(low)) - 1] >= 32:
                return low[-1], n >= 200
        q = lambda p: tail[math.ceil(p * len(tail)) - 1]
        return (q(0.5) + 8 * (q(0.5) - q(0.25)) if tail else None), n >= 200 and len(tail) >= 100

    usable = [t for t in told.values() if not t[2]]
    out = {}
    memo = {}
    for i, (lang, source, bad, values) in told.items():
        kept = not bad
        for m, v in enumerate(values):
            for key, group in (((m, lang, source), lambda t: t[:2] == (lang, source)), ((m, lang), lambda t: t[0] == lang), ((m,), lambda t: True)):
                if key not in memo:
                    memo[key] = fence([t[3][m] for t in usable if group(t)])
                most, sure = memo[key]
                if sure or key == (m,):
                    kept = kept and (most is None or v <= most)
                    break
        out[i] = kept
    return out


def test_kept_matches_brute_force(spark, tmp_path):
    r = random.Random(12)
    rows = [(i, t, lang, source, n) for i, t, lang, source, n in (tuple(x) for x in cases.documents(spark).collect())]
    at = 5000
    for source, lang, n, junk in (("hot", "en", 260, 0.3), ("hot", "de", 60, 0.1), ("calm", "en", 230, 0.0), ("small", "fr", 40, 0.2), (None, None, 210, 0.02), ("code", "en", 220, 1.0)):
        for _ in range(n):
            words = cases.words(r, r.randint(50, 140)).split(" ")
            if r.random() < junk:
                words = [w + "*" * r.randint(1, 4) for w in words]
            for _ in range(r.choice([0, 0, 0, 1, 2, 4])):  # repeats, few and many
                words += words[: r.randint(3, 12)]
            text = " ".join(words)
            if r.random() < 0.2:
                text += "\nsame line" * r.randint(1, 25)
            rows.append((at, text, lang, source, 1))
            at += 1
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    got = {x.doc_id: x.kept for x in quality.op10_adaptive_quality(spark, cases.sf(docs, tmp_path)).collect()}
    want = brute_kept(rows)
    assert got == want
    code = [i for i, _, _, source, _ in rows if source == "code"]
    assert sum(want[i] for i in code) > 0.8 * len(code)  # what is usual in its source stays
