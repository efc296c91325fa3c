import base64
import collections
import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from quarrylight.llm import bpe, quotes, registry
from tests.llm import cases
from tests.llm.test_dedup_and_joins import brute_exact, brute_near


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_tiktoken(spark, tmp_path, encoding):
    docs = cases.documents(spark)
    rows = {r.doc_id: r for r in bpe.op9_segment_tree_bpe(spark, cases.sf(docs, tmp_path)).collect()}
    for r in docs.collect():
        ids = encoding.encode_ordinary(r.text or "")
        got = rows[r.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_both_segment_trees_and_forgetting(encoding, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    r, ranks = random.Random(8), bpe.load(bpe.vocabulary_path())
    texts = ["".join(chr(r.choice([97, 98, 116, 104, 101, 32, 233, 0x3042, 0x1F389])) for _ in range(r.randint(0, 300))) for _ in range(60)] + ["ab" * 900, "é" * 700]
    encoder, compiled = bpe.Encoder(ranks), regex.compile(public_tokenizers.PATTERN)
    for t in texts:
        ids, _ = encoder.encode([compiled.findall(t)])
        assert ids.tolist() == encoding.encode_ordinary(t)
        assert all(bpe.merge_alone(p.encode(), ranks) == encoding.encode_ordinary(p) for p in compiled.findall(t))


def test_the_faster_split_is_the_public_pattern():
    compiled = regex.compile(public_tokenizers.PATTERN)
    for code in [*range(0xD800), 0x1D7D8, 0x1F389]:
        c = chr(code)
        for t in (f"a{c}b", f" {c}", f"{c}{c} 1"):
            assert bpe.split(t, public_tokenizers.PATTERN, compiled) == compiled.findall(t)


def test_encode_keeps_other_columns(spark):
    docs = cases.clashing(cases.documents(spark, 5), "n_tokens")
    assert bpe.encode(docs).columns == [*docs.columns, "ids", "decoded"]
    assert bpe.encode(cases.empty(spark)).count() == 0


MESSAGES = [
    (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "> How are you?\nFine, thanks."), (1, 2, "user", "Good."),
    (1, 3, "assistant", "On Monday X wrote:\n> Hello   there.\n> how are you?\nReplying to the first."), (1, 4, "user", "go on"),
    (1, 5, "assistant", "> > Hello there.\n> Replying to the first.\nnested"), (1, 6, "user", "> Good.\nto two"), (2, 0, "user", None), (None, 0, "user", "> x"),
    (2, None, "user", "a > b"), (3, 0, "user", "same"), (3, 1, "user", "same"), (3, 2, "assistant", "> same\nwhich?"), (3, 3, "user", ">>> deep\n>not said\nx"),
]


def brute_replies(rows):
    """reply_to of every message by comparing passages and lines with all earlier turns."""
    norm = lambda t: " ".join(t.lower().split())
    parse = lambda t: [(len(m[0].replace(" ", "").replace("\t", "")) if (m := regex.match(r"[ \t]*>(?:[ \t]*>)*", x)) else 0, regex.sub(r"^[ \t]*>(?:[ \t]*>)*[ \t]?", "", x)) for x in (t or "").split("\n")]
    own = {}
    for c, t, _, text in rows:
        lines = parse(text)
        keep = [b for i, (n, b) in enumerate(lines) if n == 0 and not (b.endswith("wrote:") and i + 1 < len(lines) and lines[i + 1][0])]
        own[c, t] = "\n".join(keep).strip()
    out = {}
    for c, t, _, text in rows:
        if c is None or t is None:
            out[c, t] = None
            continue
        earlier = sorted(k for d, k in own if d == c and k is not None and k < t)
        lines, best = parse(text), None
        least = min((n for n, _ in lines if n), default=0)
        runs, prev = [], None
        for n, b in lines:
            if n == least and least:
                runs[-1].append(b) if prev == n else runs.append([b])
            prev = n
        for piece in {norm(" ".join(x)) for x in runs} | {norm(b) for x in runs for b in x}:
            said = [k for k in earlier if piece and piece in [norm(own[c, k]), *map(norm, own[c, k].split("\n"))]]
            if said:
                best = max(best or (0, -1), (len(piece), said[-1]))
        out[c, t] = best[1] if best else earlier[-1] if earlier else None
    return out


def test_replies_match_brute_force(spark):
    frame = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    rows = quotes.reply_order(cases.clashing(frame, "reply_to", "path", "extra")).collect()
    assert len(rows) == len(MESSAGES) and {"_reply_to", "path", "extra"} <= set(rows[0].asDict())
    want = brute_replies(MESSAGES)
    assert {(r.conv_id, r.turn): r.reply_to for r in rows} == want
    place = {(r.conv_id, r.turn): i for i, r in enumerate(rows)}
    assert all(place[c, to] < place[c, t] for (c, t), to in want.items() if to is not None)
    assert not any(line.startswith(">") for r in rows for line in r.text.split("\n"))
    assert quotes.reply_order(frame.limit(0)).count() == 0


def test_replies_over_ranges_of_turns(spark, monkeypatch):
    monkeypatch.setattr(quotes, "RANGE_TURNS", 2)
    frame = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.turn): r.reply_to for r in quotes.reply_order(frame).collect()} == brute_replies(MESSAGES)


def test_a_nested_quote_is_found_where_the_outer_one_is_edited(spark):
    texts = ["the original", "an answer", "something else", "> an edited answer\n> > the original\nnew", "> an answer\n> > the original\nnewer"]
    frame = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    assert {r.turn: (r.reply_to, r.quoted) for r in quotes.link_quotes(frame.select("conv_id", "turn", "text")).collect()} == {3: (0, 1), 4: (1, 2)}


def brute_order(replies, turns):
    """(place, depth) of the turns of one conversation: branches below each other, sorted by whole paths."""
    before = {t: turns[i - 1] if i else None for i, t in enumerate(turns)}
    branch, paths = None, {None: ()}
    of, parent = {}, {}
    for t in turns:
        if replies[t] is not None and replies[t] != before[t]:
            parent[t] = replies[t]
            branch = t
        of[t] = branch
    for b, p in parent.items():  # a parent's turn is earlier, so its path is known
        paths[b] = (*paths[of[p]], (-p, b))
    order = sorted(turns, key=lambda t: (paths[of[t]], t))
    return {t: (order.index(t), len(paths[of[t]])) for t in turns}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_reply_order_of_deep_and_wide_trees(spark, shape):
    import random

    r, n = random.Random(4), 120
    says = lambda t: f"message number {t}"
    target = {"chain": lambda t: max(0, t - 2), "star": lambda t: 0, "random": lambda t: r.randint(0, t - 1)}[shape]
    to = {t: target(t) if t else None for t in range(n)}
    rows = [(1, t, "user", says(t) if to[t] is None else f"> {says(to[t])}\n{says(t)}") for t in range(n)]
    got = quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {x.turn: x.reply_to for x in got} == to
    assert {x.turn: (i, x.depth) for i, x in enumerate(got)} == brute_order(to, list(range(n)))


def test_alternating_quotes_of_a_long_message(spark):
    import time

    n = 20_000
    text = "\n".join(f"> line {i}\nanswer {i}" for i in range(n))
    frame = spark.createDataFrame([(1, 0, "user", "\n".join(f"line {i}" for i in range(n))), (1, 1, "user", text)], "conv_id long, turn long, role string, text string")
    began = time.monotonic()
    assert [(r.turn, r.reply_to, r.quoted) for r in quotes.link_quotes(frame.select("conv_id", "turn", "text")).collect()] == [(1, 0, n)]
    assert time.monotonic() - began < 60


def test_pipeline_against_brute_force(spark, tmp_path, encoding):
    import corpus_pipeline

    from quarrylight.llm import quality

    docs = cases.documents(spark, 80)
    path = cases.sf(docs, tmp_path)
    rows = docs.collect()
    kept = {r.doc_id for r in quality.op10_adaptive_quality(spark, path).collect() if r.kept}
    rows = [r for r in rows if r.doc_id in kept]
    exact = brute_exact(rows)
    rows = [r for r in rows if exact[r.doc_id][2]]
    near = brute_near(rows)
    rows = [r for r in rows if near[r.doc_id][0] == r.doc_id]
    out = corpus_pipeline.run(spark, path).collect()
    text = {r.doc_id: r.text for r in rows}
    assert {r.doc_id for r in out} <= set(text)
    times = collections.Counter(r.doc_id for r in out)
    assert max(times.values()) <= 2
    size = sum(len(t.split()) for t in text.values())
    assert sum(n * len(text[i].split()) for i, n in times.items()) == pytest.approx(1.5 * size, rel=0.2)
    assert all(r.ids == encoding.encode_ordinary(text[r.doc_id]) and r.round_trip and r.n_tokens == len(r.ids) for r in out)


def test_stages_return_the_columns_of_documents(spark):
    import corpus_pipeline

    docs = cases.documents(spark, 40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, cases.empty(spark), "").columns == docs.columns


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")) == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
