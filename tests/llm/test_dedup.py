"""Suffix dedup, line dedup and the Jaccard join against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from spantile.llm import jaccard_join, line_dedup, suffix_dedup


def removed(texts, length=200):
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        change = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                change[i] += 1
                change[i + length] -= 1
        out.append(np.cumsum(change)[:-1] > 0)
    return out


def test_suffix_dedup(docs, rows, none, monkeypatch):
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, t, gone in zip(rows, texts, removed(texts), strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[(r[0], len(t), int(gone.sum()), spans, kept)] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans) // 2, bytes(r.kept)) for r in suffix_dedup.repeats(docs, 4).collect())
    assert got == want
    assert suffix_dedup.repeats(none).count() == 0


def test_suffix_merge():
    runs = [sorted(bytes(x) for x in np.random.default_rng(i).integers(97, 99, (n, 6)).astype(np.uint8)) for i, n in enumerate((0, 1, 9, 30, 17))]
    merged = list(suffix_dedup.merge([suffix_dedup.front_coded(r) for r in runs]))
    assert [m[3] for m in merged] == sorted(x for r in runs for x in r)
    for before, after in zip(merged, merged[1:], strict=False):
        assert after[0] == suffix_dedup.shared_prefix(before[3], after[3])


def test_line_dedup(docs, rows, none):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(str.maketrans(line_dedup.lower_ascii.__globals__["UPPER"], line_dedup.lower_ascii.__globals__["LOWER"]))
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(r[0])
    common = {k: max(i for i in v if i is not None) for k, v in holders.items() if len(v) >= 3}
    want = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if key(x) not in common or common[key(x)] == r[0]]
        want[(r[0], len(lines), len(lines) - len(kept), "\n".join(kept), r[5])] += 1
    assert len(common) >= 1
    got = line_dedup.dedup_lines(docs)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text, r.rest) for r in got.collect()) == want
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_index_is_reversible(docs):
    known = docs.where("doc_id IS NOT NULL AND doc_id < 30")
    more = docs.where("doc_id >= 30 AND doc_id < 60")
    index = line_dedup.LineIndex.build(known)
    rows = lambda x: sorted(map(tuple, x.common.select("h1", "h2", "n_docs", "last").collect()))
    both = index.insert(more)
    whole = line_dedup.LineIndex.build(known.unionByName(more))
    assert rows(both) == rows(whole) != rows(index)
    back = both.delete(more.select("doc_id"))
    assert rows(back) == rows(index) and back.refs.count() == index.refs.count()
    drops = lambda x, docs: sorted((r.doc_id, r.row, sorted(r.drop)) for r in x.drops(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).collect())
    assert drops(both, more) == drops(whole, more) and drops(back, known) == drops(index, known)


def test_line_index_leaves_untouched_shards(spark, monkeypatch):
    """Only shards with keys that cross the limit get a new filter, and by the filter's own insertion and deletion."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 5)
    line = lambda k: F.concat(F.lit("a line that is long enough, number "), F.lit(k).cast("string"))
    docs = spark.range(4).select(F.col("id").alias("doc_id"), F.concat_ws("\n", *[line(k) for k in range(60)]).alias("text"))
    index = line_dedup.LineIndex.build(docs)
    assert index.shards == 12

    def never(keys):
        raise AssertionError("a filter is built from its keys")

    monkeypatch.setattr(line_dedup, "_building", lambda version: never)
    more = spark.range(10, 13).select(F.col("id").alias("doc_id"), line(1000).alias("text"))
    grown = index.insert(more)
    filters = lambda x: {r.shard: (r.version, bytes(r.held)) for r in x.filters.collect()}
    before, after = filters(index), filters(grown)
    changed = {s for s in before if before[s] != after[s]}
    assert len(changed) == 1 and {after[s][0] for s in changed} == {1} and all(after[s][0] == 0 for s in before if s not in changed)
    asked = more.select("doc_id", "text")
    assert {r.doc_id for r in grown.drops(asked).collect()} == {10, 11} and index.drops(asked).count() == 0
    back = grown.delete(more.select("doc_id"))
    [shard] = changed
    first, last = (line_dedup.CuckooFilter.from_bytes(x[shard][1]) for x in (before, filters(back)))
    assert (np.sort(first.table, 1) == np.sort(last.table, 1)).all() and first.stash == last.stash
    assert back.drops(asked).count() == 0 and back.drops(docs).count() == 3


def test_line_filters_are_asked_in_slices(docs, rows, monkeypatch):
    want = sorted(map(str, line_dedup.dedup_lines(docs).collect()))
    monkeypatch.setattr(line_dedup, "SLICE_LINES", 7)
    monkeypatch.setattr(line_dedup, "ROW_LINES", 3)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    assert sorted(map(str, line_dedup.dedup_lines(docs).collect())) == want


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 3000, dtype=np.int64).view(np.uint64)
    held = line_dedup.CuckooFilter(2500)
    held.insert(keys)
    held = line_dedup.CuckooFilter.from_bytes(held.to_bytes())
    assert held.contains(keys).all()
    held.delete(keys[:1500])
    assert held.contains(keys[1500:]).all()
    assert held.contains(rng.integers(0, 2**63, 5000, dtype=np.int64).view(np.uint64)).mean() < 0.02


def brute_components(rows, k, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def test_jaccard_join(docs, rows, none, monkeypatch):
    for k, percent in ((4, 85), (2, 60)):
        got = jaccard_join.jaccard_components(docs, k, percent)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, k, percent)
    assert jaccard_join.jaccard_components(none).count() == 0


def test_jaccard_lists_in_blocks(docs, rows, monkeypatch):
    """Lists are split by size and in blocks, and no link is lost."""
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "boundary", lambda sizes, percent: 0)
    got = jaccard_join.jaccard_components(docs, 3, 70)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, 3, 70)


def test_jaccard_first_of_each_component(docs, rows):
    """One row of each component is first, or several that are equal: the smallest doc_id, null last."""
    found = jaccard_join.row_components(docs, 3, 70).collect()
    groups = defaultdict(set)
    for r in found:
        if r.first:
            groups[r.component_id if r.n_shingles else (r.doc_id, r.row)].add((r.doc_id, r.row))
    assert all(len(x) == 1 for x in groups.values())
    assert all(r.doc_id == r.component_id for r in found if r.first)


def test_jaccard_of_rows_without_ids(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, text), (None, text), (None, "x " + text), (5, None), (None, None)], "doc_id long, text string")
    got = jaccard_join.row_components(docs, 2, 60).collect()
    assert [r.component_id for r in got if r.n_shingles] == [None] * 3 and len({r.row for r in got if r.n_shingles and r.first}) == 1


def test_counters_grow_without_wrapping():
    assert jaccard_join.coded(np.array([0, 1, 2**20, 2**40])).tolist() == [0, 8, 161, 255]


def test_subsets_and_prefixes_are_enough():
    for n in range(1, 40):
        for m in range(n, 60):
            for both in range(n + 1):
                if jaccard_join.links(both, n, m, 85):
                    assert both >= jaccard_join.least_overlap(n, m, 85) and (n, m) in jaccard_join.size_pairs(n, 85)
                    assert n - both < jaccard_join.prefix(n, 85) and m - both < jaccard_join.prefix(m, 85)


def test_digests(docs, rows):
    got = suffix_dedup.repeats(docs).select("doc_id", F.sha2("kept", 256).alias("h"), "kept").where("doc_id = 90").first()
    assert got.h == hashlib.sha256(b"").hexdigest()
