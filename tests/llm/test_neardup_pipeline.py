"""Operator 10 and the pipeline against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from lexmill.llm import mixing, neardup, quality
from lexmill.llm.queries import BLOCK_ROWS, SHARES
from tests.llm.conftest import words


def brute(rows, size, num, den):
    """doc_id -> (n_shingles, component)."""
    sets = {}
    for i, text in rows:
        if i is None:
            continue
        found = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
        n = min(size, len(found))
        sets[i] = {tuple(found[k : k + n]) for k in range(len(found) - n + 1)} if found else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        common = Counter(j for x in s for j in where[x] if j < i)
        for j, both in common.items():
            if den * both >= num * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(df, size, num, den):
    got = neardup.near_duplicates(df, size, num, den).collect()
    want = brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], size, num, den)
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in df.select("doc_id").collect())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    return got


def test_table_and_edges(spark, sf, docs, edge, empty):
    check(docs, 3, 85, 100)
    check(docs, 5, 80, 100)
    check(edge, 3, 85, 100)
    assert neardup.near_duplicates(empty, 3, 85, 100).count() == 0
    mid = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    check(mid, 3, 85, 100)


def edited(rng, base, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = words(rng, 1)[0] + "x"
    return out


def test_crowded_regions(spark):
    """A large group of copies edited to different degrees, a chain, and many exact copies."""
    rng = random.Random(11)
    base = words(rng, 150)
    data = [(i, " ".join(edited(rng, base, rng.randint(0, 6)))) for i in range(500)]
    chain = words(rng, 120)
    for i in range(60):
        chain = edited(rng, chain, 1)
        data.append((1000 + i, " ".join(chain)))
    data += [(2000 + i, "the very same text again and again") for i in range(400)]
    data += [(3000 + i, " ".join(words(rng, 60))) for i in range(100)]
    rng.shuffle(data)
    got = check(spark.createDataFrame(data, "doc_id bigint, text string"), 3, 85, 100)
    assert len({r["component_id"] for r in got if 2000 <= r["doc_id"] < 3000}) == 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 80)] + [(200, x) for x in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["comp"] for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)
    assert neardup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_pipeline_stages(spark, sf, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "mix_sources", "byte_bpe"]
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    kept = {r["doc_id"] for r in quality.quality_verdicts(docs).where("kept").collect()}
    assert {r["doc_id"] for r in first.collect()} == kept and first.schema == docs.schema
    second = corpus_pipeline.STAGES[1][1](spark, first, sf)
    classes = brute([(r["doc_id"], r["text"]) for r in first.collect()], 5, 80, 100)
    want = {i for i, (_, c) in classes.items() if i == c}
    assert {r["doc_id"] for r in second.collect()} == want and second.schema == docs.schema
    third = corpus_pipeline.STAGES[2][1](spark, second, sf)
    assert sorted(third.collect(), key=str) == sorted(second.collect(), key=str) and third.schema == docs.schema
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} == want and all(r["round_trip"] for r in out)


def test_stages_handle_edges(spark, sf, edge, empty):
    for source in (edge, empty):
        df = source
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, sf)
            assert df.schema == source.schema
        corpus_pipeline.STAGES[-1][1](spark, df, sf).collect()


def test_crowded_region_without_prevailing_component(spark):
    """1200 nodes of one template, in pairs just over the threshold, all else just under it."""
    rng = random.Random(17)
    fresh = iter(f"w{i}" for i in range(10**6))
    template = [next(fresh) for _ in range(200)]

    def edit(base, n):
        out = list(base)
        for at in rng.sample(range(len(out)), n):
            out[at] = next(fresh)
        return out

    data = []
    for i in range(600):
        base = edit(template, 17)
        data += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edit(base, 20)))]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string"), 1, 80, 100).collect()}
    want = {i: i for i, _ in data}
    with np.errstate(over="ignore"):
        sets = [neardup.shingle_set(t, 1) for _, t in data]
        top = np.stack([neardup.signature(x) for x in sets]).reshape(len(data), neardup.TREES, neardup.DEPTH)[:, :, : neardup.MIN_DEPTH]
    for i in range(0, len(data), 2):
        assert len(np.intersect1d(sets[i], sets[i + 1])) == 180
        if (top[i] == top[i + 1]).all(1).any():  # in a region together; else no forest sees the pair
            want[i + 1] = i
    assert len(set(want.values())) <= 602 and np.unique(top[:, 0], axis=0, return_counts=True)[1].max() > neardup.REGION
    assert got == want


def test_mix_order_reaches_the_rows_of_run(spark, sf, docs):
    df = docs
    for _, stage in corpus_pipeline.STAGES[:2]:
        df = stage(spark, df, sf)
    plan = mixing.schedule(df, SHARES, BLOCK_ROWS).collect()
    want = [r["doc_id"] for r in sorted(plan, key=lambda r: (r["slot"], r["place"]))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        out = corpus_pipeline.run(spark, sf).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["position"] for r in out) == list(range(len(want)))
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["position"])] == want
