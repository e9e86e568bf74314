"""Sharding, packing, toxicity, fingerprints, language model, licenses and decontamination."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spantile.llm import decontaminate, fingerprints, licenses, line_dedup, lm_scoring, packing, sharding, toxicity


def test_sharding(docs, rows, none):
    got = sharding.kd_shards(docs, 5).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert sorted(by) == list(range(5))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    assert sharding.kd_shards(none, 3).count() == 0


def test_sharding_cuts_a_group_of_equal_rows(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    sizes = [r["count"] for r in sharding.kd_shards(docs, 7).groupBy("shard").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 6
    assert sharding.kd_shards(docs, target_bytes=21 * 100).agg(F.max("shard")).first()[0] == 3


def test_packing(docs, rows, none):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows:
        ids = [*coder.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want[(r[0], tuple(ids))] += 1
    got = packing.pack(docs, window=64).collect()
    at = defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and r.length <= 64
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    joined = defaultdict(list)
    for r in got:
        joined[(r.doc_id, r.doc_tokens)].append((r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())))
    for (doc_id, n), parts in joined.items():
        seen = sum(len(p) for _, p in parts)
        assert seen % n == 0
        for start, part in parts:
            assert any(k[0] == doc_id and k[1][start : start + len(part)] == part for k in want)
    assert sum(r.length for r in got) == sum(len(k[1]) * n for k, n in want.items())
    assert sum(64 - sum(n for _, n in p) for p in at.values()) < 0.02 * sum(r.length for r in got) + 64
    assert packing.pack(none).count() == 0


def test_packing_reads_the_special_token_as_the_library_does(spark):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "a<|endoftext|>b", "<|endoftext|><|endoftext|>\n", "x <|endoftext|>  y", "<|endoftext|", "it's  <|endoftext|>'s"]
    got = {r.doc_id: r.ids for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        assert np.frombuffer(got[i], "<u4").tolist() == [*coder.encode(text, add_special_tokens=False).ids, packing.END_ID]
    assert 50256 in np.frombuffer(got[0], "<u4")


def test_best_fit_is_tightest():
    rnd = random.Random(4)
    lengths = sorted((rnd.randint(1, 50) for _ in range(300)), reverse=True)
    windows, offsets = packing.best_fit(lengths, 50)
    left = {}
    for n, w, o in zip(lengths, windows, offsets, strict=True):
        fits = [c for c in left.values() if c >= n]
        assert 50 - left.get(w, 50) == o
        assert (left[w] == min(fits)) if fits and n < 50 else w not in left
        left[w] = left.get(w, 50) - n


def _toxic(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rnd.choice(("th", "an", "re", "ion", "ed")) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(20, 120))]
        if i % 3 == 0:
            for _ in range(3):
                bad = list(rnd.choice(("worthless", "disgusting", "pathetic")))
                bad[rnd.randrange(2, len(bad))] = rnd.choice("xyz")
                words.insert(rnd.randrange(len(words)), "".join(bad))
        out.append((i, " ".join(words), int(i % 3 == 0)))
    return out


def test_toxicity(spark, none):
    data = _toxic(300, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(1000, None), (1001, ""), (None, "worthless")], "doc_id long, text string").withColumn("toxic", F.lit(5))
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(5000, 1), (None, 1), (1000, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels, ~toxicity.held_out(F.col("doc_id"))).collect()
    y = dict((i, t) for i, _, t in data)
    held = [r for r in got if r.doc_id in y and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got) and len(got) == 303
    empty = toxicity.toxicity(docs, labels.limit(0), F.lit(True))
    assert {r.predicted for r in empty.collect()} == {0}
    assert toxicity.toxicity(none, labels, F.lit(True)).count() == 0


def brute_anchors(units, word, pair, run):
    """The closed syncmers of a row of units, from the hashes that Spark gives single units, pairs and runs."""
    k, s = fingerprints.K, fingerprints.S
    out = []
    for i in range(len(units) - k + 1):
        inner = [pair[tuple(units[i + j : i + j + s])] for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((run[tuple(units[i : i + k])], i))
    if len(units) < k and units:
        out.append((run[tuple(units)], 0))
    return out


def brute_likeness(a, b):
    """By the definition: of the hashes to which both are complete, what share of either's both have."""
    p, q = ({x[i : i + 8] for i in range(0, len(x), 8)} for x in (a, b))
    if a == b:
        return 1.0
    bound = min((max(max(x), f"{fingerprints.SHARE - 1:08X}") if len(x) >= fingerprints.BOTTOM else "G") for x in (p, q))
    p, q = ({h for h in x if h <= bound} for x in (p, q))
    return len(p & q) / len(p | q) if p | q else 0.0


def test_fingerprints(spark, docs, rows, none):
    """Anchors, fingerprints and likeness against brute force over Spark's hashes of units."""
    texts = sorted({r[1] or "" for r in rows})
    data = spark.createDataFrame([(t,) for t in texts], "text string")
    got = data.select("text", fingerprints.units(F.col("text")).alias("units"), fingerprints.placed_anchors(F.col("text")).alias("anchors"), fingerprints.fingerprint(F.col("text")).alias("mark"), F.shiftrightunsigned(F.xxhash64("text"), 32).alias("whole")).collect()
    k = fingerprints.K
    grams = {n: sorted({tuple(r.units[i : i + n]) for r in got for i in range(len(r.units) - n + 1)}) for n in (1, 2, k)}
    word = {g[0]: h for g, h in spark.createDataFrame([(list(g),) for g in grams[1]], "g array<string>").select("g", F.xxhash64(F.col("g")[0])).collect()}

    def hashed(n):
        frame = spark.createDataFrame([([word[w] for w in g], list(g)) for g in grams[n]], "h array<bigint>, g array<string>")
        return {tuple(r.g): r.x for r in frame.select("g", F.xxhash64(*[F.col("h")[i] for i in range(n)]).alias("x")).collect()}

    pair, run = hashed(2), hashed(k)
    short = spark.createDataFrame([([word[w] for w in r.units], r.units) for r in got if 0 < len(r.units) < k], "h array<bigint>, g array<string>")
    run |= {tuple(r.g): r.x for r in short.select("g", F.xxhash64("h").alias("x")).collect()}
    for r in got:
        want = brute_anchors(r.units, word, pair, run)
        assert [(a.hash, a.place) for a in r.anchors] == want
        marks = sorted({(h % 2**64) >> 32 for h, _ in want}) or ([r.whole] if r.units else [])
        n = max(fingerprints.BOTTOM, sum(h < fingerprints.SHARE for h in marks))
        assert r.mark == "".join(f"{h:08X}" for h in marks[:n])
    pairs = [(a.mark, b.mark) for a in got[::3] for b in got[::5]]
    near = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fingerprints.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(abs(r.x - brute_likeness(r.a, r.b)) < 1e-12 for r in near)


def test_fingerprints_of_edited_and_next_texts(docs, rows, none):
    """Repeated rows, ties and null ids: by falling doc_id, null last, then by falling hash of the text."""
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashes = {r.text: r.h for r in some.select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(((-(2**63) if r[0] is None else r[0], hashes[r[1] or ""], r[1] or "", r[0]) for r in rows), key=lambda x: x[:3], reverse=True)
    out = fingerprints.with_next(some, {"fingerprint": fingerprints.fingerprint(F.col("text"))}).withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text")))
    want = Counter()
    for i, (_, _, text, doc_id) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][2]
        half = len(text) // 2
        want[(doc_id, text, following, text[: len(text) - half] + following[:half])] += 1
    assert Counter((r.doc_id, r.text, r.next_text, r.edited) for r in out.collect()) == want
    assert fingerprints.with_next(none.select("doc_id", "text"), {}).count() == 0


def test_fingerprints_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PART_DOCS", 7)
    monkeypatch.setattr(fingerprints, "RANGES", 100)
    ids = sorted({i * i % 997 for i in range(90)}, reverse=True)
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(docs, {}).collect()}
    assert got == {i: f"text {ids[(n + 1) % len(ids)]}" for n, i in enumerate(ids)}


def test_fingerprints_of_an_id_that_many_rows_have(spark, monkeypatch):
    """Rows without an id, and rows under one id, are cut into ranges by their texts' hash."""
    monkeypatch.setattr(fingerprints, "PART_DOCS", 10)
    monkeypatch.setattr(fingerprints, "RANGES", 100)
    docs = spark.range(300).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    ordered = [r.text for r in sorted(rows, key=lambda r: (-(2**63) if r.doc_id is None else r.doc_id, r.h), reverse=True)]
    out = fingerprints.with_next(docs, {"range": F.spark_partition_id()})
    assert {r.text: r.next_text for r in out.collect()} == {t: ordered[(i + 1) % 300] for i, t in enumerate(ordered)}


def test_syncmers_are_context_free(spark):
    words = [f"w{i * 7919 % 101}" for i in range(60)]
    texts = [" ".join(words), "before " * 3 + " ".join(words) + " after"]
    a, b = (set(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "text string").select(fingerprints.anchors(F.col("text"))).collect())
    assert len(a) > 10 and a <= b


def test_shared_passages(spark):
    """Positional matching: a passage is found at its places, whatever stands around it."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    texts, places = [], {}
    for i in range(30):
        before = [word() for _ in range(rnd.randint(0, 40))]
        own = passage if i % 3 == 0 else [word() for _ in range(60)]
        places[i] = len(before) if i % 3 == 0 else None
        texts.append((i, " ".join([*before, *own, *(word() for _ in range(20))])))
    docs = spark.createDataFrame([*texts, (None, None), (99, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1000, " ".join(passage)), (1001, None)], "doc_id long, text string")
    got = fingerprints.shared_passages(docs, asked).collect()
    assert {r.doc_id for r in got} == {i for i, at in places.items() if at is not None}
    for r in got:
        assert r.query_id == 1000 and r.place - r.query_place == places[r.doc_id] and r.length >= 40
    with pytest.raises(ValueError, match="anchors"):
        fingerprints.shared_passages(docs, asked, 3)


def test_lm_scoring(docs, rows, none):
    got = lm_scoring.lm_scores(docs).collect()
    words = [(r[0], (r[1] or "").encode().lower().split()) for r in rows]
    count = Counter()
    for i, w in words:
        if lm_scoring.is_training(i):
            count.update([*w, None])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, w in words:
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in [*w, None])
        want[(i, len(w) + 1, sum(count[x] > 0 for x in [*w, None]), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm_scoring.lm_scores(none).count() == 0


def _weights(rng, rows=9, size=4, classes=5):
    return {"x": rng.normal(size=(rows, size)), **{n: rng.normal(size=(size, size)) for n in "qkvs"}, "lag": rng.normal(size=2 * lm_scoring.WINDOW), "out": rng.normal(size=(size, classes)), "bias": rng.normal(size=classes)}


def _states(par, rows, text, low, high):
    x = par["x"]
    return lm_scoring.attend(rows, lm_scoring.starts(text), low, high, x @ par["q"], x @ par["k"], lm_scoring.ones_beside(x @ par["v"]), x @ par["s"], par["lag"])[0]


def test_lm_attention_is_causal_attention():
    """Against attention worked out place by place: over the place's window and the one before, of its text alone."""
    rng = np.random.default_rng(1)
    par, w = _weights(rng), lm_scoring.WINDOW
    rows, text = rng.integers(0, 9, 5 * w + 7), np.repeat([0, 1, 2], [w + 5, 2 * w, 2 * w + 2])
    q, k, v, s = (par["x"][rows] @ par[n] for n in "qkvs")
    want = []
    for i in range(len(rows)):
        there = [j for j in range(max(0, (i // w - 1) * w), i + 1) if text[j] == text[i]]
        e = np.exp([q[i] @ k[j] + par["lag"][i - j] for j in there])
        want.append(s[i] + (e / e.sum()) @ v[there])
    assert np.allclose(_states(par, rows, text, 0, len(rows)), want)
    # lots of windows are the same as all at once
    assert np.allclose(np.concatenate([_states(par, rows, text, at, min(len(rows), at + 2 * w)) for at in range(0, len(rows), 2 * w)]), want)


def test_lm_gradients():
    rng = np.random.default_rng(0)
    par, w = _weights(rng), lm_scoring.WINDOW
    n = 4 * w + 3
    rows, text, following, keep = rng.integers(0, 8, n), np.repeat([0, 1], [w + 9, 3 * w - 6]), rng.integers(0, 5, n), rng.random(n) > 0.2
    start = lm_scoring.starts(text)
    for low in (0, 2 * w):

        def loss(low=low):
            z = _states(par, rows, text, low, n) @ par["out"] + par["bias"]
            return float(-((z - np.log(np.exp(z).sum(1, keepdims=True)))[np.arange(n - low), following[low:]] * keep[low:]).sum() / keep[low:].sum())

        grad = lm_scoring.gradients(par, rows, start, low, n, following[low:], keep[low:])
        for name, at in (("x", (rows[low + 3], 1)), ("q", (1, 2)), ("k", (0, 3)), ("v", (2, 2)), ("s", (1, 1)), ("lag", (1,)), ("lag", (w + 2,)), ("out", (2, 3)), ("bias", (1,))):
            old, eps = par[name][at], 1e-4
            par[name][at] = old + eps
            up = loss()
            par[name][at] = old - eps
            down = loss()
            par[name][at] = old
            assert abs((up - down) / (2 * eps) - grad[name][at]) < 1e-4 * max(1, abs(grad[name][at])), name


def test_lm_is_a_distribution():
    """Classes' shares sum to one, and so do the probabilities of what may follow, with counts and without."""
    counts, opens = np.arange(lm_scoring.IDS) % 7, np.arange(lm_scoring.IDS) % 2 == 0
    row, of_class, begin = lm_scoring.classes(counts, opens)
    inside = lm_scoring.shares(counts, of_class)
    assert np.allclose(np.bincount(of_class, weights=np.exp(inside.astype(float)), minlength=lm_scoring.CLASSES)[np.unique(of_class)], 1, atol=1e-3)
    assert row.max() < lm_scoring.OWN_ROWS + lm_scoring.CLASSES and set(begin) == {0, 1}
    model = lm_scoring.Model(_weights(np.random.default_rng(2), lm_scoring.OWN_ROWS + lm_scoring.CLASSES, 4, lm_scoring.CLASSES), row, of_class, inside, begin)
    # classes without ids get no mass
    model.par["bias"] = np.where(np.isin(np.arange(lm_scoring.CLASSES), of_class), model.par["bias"], -60)
    ids = np.stack([np.full(lm_scoring.IDS, 5), np.arange(lm_scoring.IDS)], 1).ravel()
    p, opening = model.scores(ids, np.repeat(np.arange(lm_scoring.IDS), 2))
    assert abs(np.exp(p[::2].astype(float)).sum() - 1) < 1e-3
    assert np.allclose(opening[::2], opening[0], atol=1e-4) and abs(np.exp(p[::2].astype(float))[begin[of_class] > 0].sum() - np.exp(opening[0])) < 1e-3
    own, seen, gram = np.log([0.2, 0.3, 0.1, 0.4]), np.array([3.0, 1, 0, 6]), np.array([0.0, 2, 0, 1])
    assert abs(lm_scoring.mixed(own, seen, 10, gram, 3.0, 0.3, 2.0).sum() - 1) < 1e-12


def test_lm_reads_and_spells_a_block_once(monkeypatch):
    """What follows the coding of a block learns and scores without its texts, and from the same words, hashes and ids."""
    ranks = lm_scoring.public_tokenizers.path("byte_bpe_50k.tiktoken")
    rnd = random.Random(5)
    for texts, lot in (["Red green\tred", "", "x\u3000y \u65e5\u672c <|endoftext|>", "é" * 40], 1 << 19), ([" ".join(rnd.choice(("a", "bb", "cé", "x\u2003y")) + str(rnd.randint(0, 9)) for _ in range(30)) for _ in range(9)], 16), (["\ud800x y"], 1 << 19):
        monkeypatch.setattr(lm_scoring, "HASHED_BYTES", lot)
        held, ids = [t.encode("utf-8", "surrogatepass") for t in texts], [None, *range(1, len(texts))]
        packed = pd.DataFrame({"block": [0], "ids": [ids], "sizes": [[len(t) for t in held]], "data": [zstandard.compress(b"".join(held))]})
        coded = next(lm_scoring._coding(ranks)(iter([packed])))
        assert not {"data", "text"} & set(coded.columns)
        words, spelling, back = lm_scoring._coded(next(coded.itertuples(index=False)), ranks)
        want = lm_scoring.words_of(held)
        assert back == ids and words.hashes.tolist() == want.hashes.tolist()
        assert words.unit_hashes()[words.units()[0]].tolist() == want.unit_hashes()[want.units()[0]].tolist()
        assert words.units()[1].tolist() == want.units()[1].tolist()
        for got, x in zip(lm_scoring.stream(words, *spelling), lm_scoring.stream(want, *lm_scoring.spellings(want.spelled, ranks)), strict=True):
            assert got.tolist() == x.tolist()
        chosen = np.arange(len(texts)) % 2 == 0
        some, fewer = words.those(chosen), lm_scoring.words_of([t for t, x in zip(held, chosen, strict=True) if x])
        assert [some.hashes[some.number].tolist(), some.of.tolist(), some.texts] == [fewer.hashes[fewer.number].tolist(), fewer.of.tolist(), fewer.texts]


def test_lm_counts_runs_of_the_whole_corpus(spark):
    """Runs of three words and their first two are counted in all training documents, and in no other."""
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(("red", "green", "blue", "Red")) for _ in range(rnd.randint(0, 12))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    packed = lm_scoring.written(lm_scoring.blocks(docs))
    rows = packed.mapInPandas(lm_scoring._counting(2, lm_scoring.is_training), lm_scoring._ASKED).groupBy("part").applyInPandas(lm_scoring._adding, lm_scoring._ANSWERS).toPandas()
    want, contexts = Counter(), Counter()
    units = [["^^", "^", *t.lower().split(), "$"] for t in texts]
    for i, u in enumerate(units):
        if lm_scoring.is_training(i):
            want.update(zip(u, u[1:], u[2:], strict=False))
            contexts.update(zip(u, u[1:-1], strict=False))
    for r in packed.collect():
        words = lm_scoring.words_of(lm_scoring._read(r)[0])
        asked, (_, gram, context) = lm_scoring.Asked.of(words), lm_scoring.told(rows[rows["block"] == r.block])
        own = [x for i in r.ids for x in zip(units[i], units[i][1:], units[i][2:], strict=False)]
        assert gram[asked.gram_of].tolist() == [want[x] for x in own]
        assert context[asked.gram_of].tolist() == [contexts[x[:2]] for x in own]


def test_lm_trains_on_more_as_the_corpus_grows(spark, monkeypatch):
    """Tasks learn from a share of all training documents; the frequencies within classes show how many ids that were."""
    monkeypatch.setattr(lm_scoring, "TRAIN_DOCS", 8)
    learnt = []
    trained = lm_scoring.trained
    monkeypatch.setattr(lm_scoring, "trained", lambda packed, model, *a: learnt.append((model, trained(packed, model, *a))) or learnt[-1][1])
    shared = [i for i in range(4000) if lm_scoring.is_training(i) and lm_scoring.xxhash.xxh32_intdigest(f"red green blue {i}".encode()) % lm_scoring.SHARE == 0]
    for n in (400, 4000):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("red green blue "), F.col("id")).alias("text"))
        got = lm_scoring.lm_scores(docs).collect()
        assert len(got) == n
        assert not np.allclose(learnt[-1][0].par["x"], learnt[-1][1].par["x"])
    assert sum(i < 400 for i in shared) * 3 < len(shared)


def test_lm_learns_from_all_training_documents(spark, monkeypatch):
    """Ids, weights, and what weight and mass are chosen from: of all training documents, however few the driver samples."""
    monkeypatch.setattr(lm_scoring, "TRAIN_DOCS", 4)
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(("red", "green", "blue", "Éclair", "x" * 30)) for _ in range(rnd.randint(0, 40))) for _ in range(300)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    held, used, counted = {}, [], []
    for name in ("trained", "fitted"):
        monkeypatch.setattr(lm_scoring, name, lambda learnt, x, name=name, own=getattr(lm_scoring, name): held.setdefault(name, learnt) and own(learnt, x))
    monkeypatch.setattr(lm_scoring, "counted_ids", lambda *a, own=lm_scoring.counted_ids: counted.append(own(*a)) or counted[0])
    assert lm_scoring.lm_scores(docs).count() == 301
    ranks = lm_scoring.public_tokenizers.path("byte_bpe_50k.tiktoken")
    words = lm_scoring.words_of([(t or "").encode() for i, t in enumerate(texts) if lm_scoring.is_training(i)])
    flat, text, _ = lm_scoring.stream(words, *lm_scoring.spellings(words.spelled, ranks))
    assert lm_scoring._total(held["trained"].where(F.col("part") != lm_scoring.BINS))[0] == len(flat)
    bins = held["fitted"].where(F.col("part") == lm_scoring.BINS).select("held").mapInPandas(lm_scoring._bins, "key double, n double, own double, seen double, runs double, contexts double").toPandas()
    assert bins["n"].sum() == len(words.units()[0])
    assert (counted[0][0] == np.bincount(flat, minlength=lm_scoring.IDS)).all()
    near = np.zeros((lm_scoring.IDS, lm_scoring.NEAR))
    for i in range(len(flat)):
        for j in range(max(0, i - lm_scoring.REACH), min(len(flat), i + lm_scoring.REACH + 1)):
            near[flat[i]] += lm_scoring._codes()[flat[j]] * (i != j and text[i] == text[j])
    assert np.allclose(counted[0][1], near, rtol=1e-4, atol=0.02)
    assert np.allclose(lm_scoring.neighbours(flat, text, 7), near, atol=1e-4)


def test_lm_counts_of_other_texts(spark):
    """Weight and mass are chosen without a text's own counts, by what was said of each word before it was learnt from."""
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(("red", "green", "blue")) for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    packed = lm_scoring.blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()[0]
    words = lm_scoring.words_of(lm_scoring._read(packed)[0])
    learns = np.array([lm_scoring.is_training(i) for i in packed.ids])
    rows = lm_scoring.Asked.of(words).rows(0, learns[words.units()[1]], 0)
    got = np.stack(lm_scoring.without_own(words, lm_scoring._adding(rows), learns), 1)
    want, units = [], {i: ["^^", "^", *t.split(), "$"] for i, t in enumerate(texts) if lm_scoring.is_training(i)}
    each = {i: [Counter(zip(*[u[k:] for k in at])) for at in ((2,), (0, 1, 2))] + [Counter(zip(u, u[1:-1]))] for i, u in units.items()}
    for i in (i for i in packed.ids if i in units):
        others = [sum((each[j][k] for j in units if j != i), Counter()) for k in range(3)]
        want += [(others[0][x[2:]], others[1][x], others[2][x[:2]]) for x in zip(units[i], units[i][1:], units[i][2:])]
    assert got.tolist() == [list(map(float, x)) for x in want]
    flat, text = np.array([1, 2, 1, 3, 2, 1] * 30), np.zeros(180, int)
    par, told_ = {k: v.astype(np.float64) for k, v in _weights(np.random.default_rng(3)).items()}, np.zeros((2, 179))
    lm_scoring.learn(par, flat, text, flat, 1, 0.0, opens=np.array([0, 1.0, 0, 1, 0]), told=told_)
    logits = _states(par, flat, text, 0, 179) @ par["out"] + par["bias"]
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    assert np.allclose(told_, [np.log(p[np.arange(179), flat[1:]]), np.log(p[:, 1] + p[:, 3])], atol=1e-6)


def test_lm_with_a_doc_id_that_many_rows_have(spark):
    docs = spark.range(2000).select(F.lit(3).cast("long").alias("doc_id"), F.substring(F.md5(F.col("id").cast("string")), 1, 3).alias("text"))
    assert len(lm_scoring.sampled(docs, lm_scoring.is_training)) == 1
    assert lm_scoring.lm_scores(docs).count() == 2000


def test_lm_scores_beat_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [r for r in lm_scoring.lm_scores(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


MIT = licenses.TEMPLATES[1][1]


def test_licenses(spark, docs, none):
    changed = MIT.split()
    changed[10] = "some"
    del changed[25]
    texts = {1: "Under the MIT License. And mit license", 2: f"x y {' '.join(changed)} z", 3: "Apache License, Version 2.0", 4: "nothing here", 5: None, 6: "", 7: "CC-BY-NC", 8: " ".join(MIT.split()[:12]), 9: "Released under the MIT license."}
    data = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(data).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (7, 1, 0, 0, "mit")
    assert got[2].labels == "mit" and got[2].base_labels == "" and got[2].n_base == 0 and got[2].first_word is None and 0.9 < got[2].score < 1
    assert got[3].base_labels == "apache-2" and got[7].base_labels == "cc-by-nc" and got[9].labels == "mit"
    assert all(got[i].labels == "" and got[i].score == 0 for i in (4, 5, 6, 8))
    assert licenses.scan(none).count() == 0
    assert licenses.scan(docs).count() == docs.count()


def test_licenses_of_the_contract(spark, tmp_path):
    texts = {1: "Under the MIT License. And mit license", 2: "MIT License", 3: "x y, under the MIT license; under the mit license"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in licenses.query(spark, str(tmp_path)).collect()}
    places = {i: (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for i, r in got.items()}
    assert places == {1: (1, 0, 0, "mit", "mit", 1.0), 2: (0, None, None, "", "mit", 0.0), 3: (2, 2, 6, "mit", "mit", 1.0)}


def brute_base(text):
    """Words and places of the contract's phrases, character by character."""
    words, now = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            words, now = (words + [now] if now else words), ""
        else:
            now += c.lower() if c.isascii() else c
    places, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses_against_brute_force(spark):
    """The base columns of the query over a whole table."""
    want = {r.doc_id: brute_base(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = licenses.query(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_spans_of_a_long_text_with_many_notices(spark):
    text = " and ".join(["Released under the MIT License."] * 500)
    found = licenses.spans(spark.createDataFrame([(1, text, 5), (None, text, 5)], "doc_id long, text string, row long"), (("mit", "released under the mit license"),)).collect()
    assert {r.first_word for r in found if r.doc_id == 1} == {r.first_word for r in found if r.doc_id is None}
    assert len([r for r in found if r.doc_id == 1]) >= 1 and all(r.score == 1 for r in found)


def edits(item, text):
    before = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        now = [i + 1]
        for j, y in enumerate(text):
            now.append(min(before[j] + (x != y), before[j + 1] + 1, now[-1] + 1))
        before = now
    return min(before)


def test_decontamination(spark, docs, none):
    rnd = random.Random(9)
    items = [(i, " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(12))) for i in range(6)] + [(6, ""), (7, None), (8, "a b")]
    texts = []
    for n in range(60):
        item = list(rnd.choice(items[:6])[1])
        for _ in range(rnd.randint(0, 8)):
            at = rnd.randrange(len(item))
            item[at] = rnd.choice(("", "z", item[at] + "q"))
        texts.append((n, f"Before it, {''.join(item).upper()}! and after " + "word " * rnd.randint(0, 30)))
    texts += [(60, None), (61, ""), (61, "repeat"), (62, "nothing like it")]
    data = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for n, text in texts:
        for i, item in items:
            a, b = decontaminate.normal(item), decontaminate.normal(text)
            if a and (e := edits(a, b)) <= min(int(len(a) * 0.1), len(a) - 1):
                want[(n, i)] = e
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(data, bench).collect()}
    assert {k: r.n_edits for k, r in got.items()} == want and len(want) > 20
    for (n, i), r in got.items():
        span = dict(texts)[n][r.start_char : r.end_char]
        assert edits(decontaminate.normal(dict(items)[i]), decontaminate.normal(span)) <= r.n_edits
    flags = {r.doc_id: r.leaks for r in decontaminate.holds_any(data.where("doc_id < 60"), bench).collect()}
    assert {n for n, x in flags.items() if x} == {n for n, _ in want if n < 60}
    assert decontaminate.matches(none, bench).count() == 0
    assert decontaminate.matches(data, bench.limit(0)).count() == 0


def test_decontamination_of_an_item_that_repeats_itself():
    """The first intact piece also stands at a shifted place, whose stretch begins too late for the passage."""
    item = "ha " * 15 + "bcdefg ijklmno"
    assert len(item) == 59
    asked = decontaminate.Items([(1, item)])
    for a in range(0, 24):
        for b in range(a + 1, 24):
            text = list(item)
            text[a], text[b] = "x", "x"
            text = decontaminate.normal("".join(text))
            assert edits(item, text) <= 5
            assert [m[:2] for m in asked.matches(text)] == [(1, edits(item, text))], (a, b)


def test_decontamination_of_letters_that_grow():
    """One letter that is two when lower-cased shifts no place after it."""
    text = "\u0130\u0130 x\u0130y, the quick brown fox jumps over it"
    asked = decontaminate.Items([(1, "quick brown fox jumps")])
    [(_, edits_, a, b)] = asked.matches(decontaminate.normal(text))
    [(start, end)] = decontaminate.in_text(text, [(a, b)])
    assert edits_ == 0 and text[start:end] == "quick brown fox jumps"


def test_columns_that_clash(spark):
    """Columns that have a result's name give way to it; others, whatever their names, stay as they are."""
    docs = spark.createDataFrame([(1, "a b c", 0.25, 7, True, 3)], "doc_id long, text string, score double, predicted int, leaks boolean, rest int")
    labels, bench = spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), spark.createDataFrame([(1, "no such thing")], "item_id long, text string")
    [r] = toxicity.toxicity(docs, labels, F.lit(True)).collect()
    assert sorted(r.asDict()) == sorted(docs.columns) and (r.predicted, r.leaks, r.rest) == (0, True, 3) and r.score != 0.25
    [r] = decontaminate.holds_any(docs, bench).collect()
    assert sorted(r.asDict()) == sorted(docs.columns) and (r.leaks, r.score, r.rest) == (False, 0.25, 3)
    pieces = spark.createDataFrame([(1, 0, 5, 9, 9, 4, 6)], "doc_id long, start long, length long, sequence_id long, offset long, group_0 int, _group int")
    [r] = packing.place(pieces, 1).collect()
    assert sorted(r.asDict()) == sorted(pieces.columns) and (r.sequence_id, r.offset, r.group_0, r._group) == (0, 0, 4, 6)
    more = docs.selectExpr("*", "1 AS row", "2 AS kid", "3 AS h1", "4 AS part", "5 AS block", "6 AS size", "7 AS shard", "8 AS lang", "9 AS n_lines")
    [r] = line_dedup.dedup_lines(more).collect()
    assert (r.n_lines, r.n_dropped, r.row, r.h1) == (1, 0, 1, 3) and len(r) == len(more.columns) + 1
    for name, out in (("shards", sharding.kd_shards(more, 2)), ("scan", licenses.scan(more)), ("pack", packing.pack(more)), ("lm", lm_scoring.lm_scores(more)), ("next", fingerprints.with_next(more, {})), ("matches", decontaminate.matches(more, bench))):
        assert out.count() == (0 if name == "matches" else 1), name


def test_toxicity_takes_one_text_for_an_id(spark, monkeypatch):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).unionByName(spark.createDataFrame([(2, "other")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    texts, y = toxicity.labelled(docs, labels, F.lit(True))
    assert len(texts) == 2 and y == [1, 0]
    monkeypatch.setattr(toxicity, "MAX_BYTES", 6)
    assert toxicity.labelled(docs, labels, F.lit(True)) == (["other"], [0])
