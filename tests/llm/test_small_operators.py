"""Operators 1, 3, 4, 5, 7, 8, 9 against brute force and planted cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.llm import html_text, licenses, mixing, quality, sharding, topk, warc
from lexmill.llm.html_text import main_text
from lexmill.llm.queries import BLOCK_ROWS, SHARES, op3_exact_top_k, op7_warc_archive, op8_main_text


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- sharding


def check_shards(df, source, n_shards):
    got = rows(df)
    texts = [r["text"] for r in source.select("text").collect()]
    assert len(got) == len(texts)
    assert Counter((r["size"], r["text_crc32"]) for r in got) == Counter((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(n_shards))
    home = defaultdict(set)
    for r in got:
        home[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in home.values())
    return got


def test_sharding(docs, edge, empty):
    got = check_shards(sharding.shard_documents(docs, 8), docs, 8)
    check_optimum(got, docs, 8)
    got = check_shards(sharding.shard_documents(docs, 40), docs, 40)
    check_optimum(got, docs, 40)
    check_shards(sharding.shard_documents(edge, 5), edge, 5)
    assert sharding.shard_documents(empty, 5).count() == 0


def check_optimum(got, source, n_shards):
    """The largest shard of contiguous cuts is the least possible: all capacities, one group at a time."""
    groups = Counter()
    for r in source.select("text").collect():
        groups[hashlib.sha256((r["text"] or "").encode()).hexdigest()] += len((r["text"] or "").encode()) + 16
    total = sum(groups.values())
    giants = [v for v in groups.values() if v * n_shards > total]
    line = [v for _, v in sorted(groups.items()) if v * n_shards <= total]

    def needed(capacity):
        n, fill = 1, 0
        for v in line:
            if fill + v > capacity:
                n, fill = n + 1, 0
            fill += v
        return n

    low, high = max(line), sum(line)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needed(mid) <= n_shards - len(giants) else (mid + 1, high)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    rest = Counter(sizes.values()) - Counter(giants)
    assert sum(rest.values()) == len(sizes) - len(giants) and max(rest) == low


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10**6), st.sampled_from([1, 3, 9]))
def test_cells_hold_the_cuts_of_groups(shards, seed, spread):
    """Splitting the cells that ``open_cells`` names, again and again, ends at the optimum of single groups."""
    rng = random.Random(seed)
    keys = sorted({rng.randrange(1 << 12) for _ in range(rng.randint(1, 200))})
    groups = [(k, rng.randint(1, 10**spread)) for k in keys]

    def made(bits, part, step):
        out = Counter()
        n = Counter()
        for k, v in part:
            out[k >> (12 - bits - step)] += v
            n[k >> (12 - bits - step)] += 1
        return [sharding.Cell(x, bits + step, out[x], n[x]) for x in out]

    line = made(0, groups, 4)
    line.sort(key=lambda c: c.prefix << (12 - c.bits))
    while True:
        high, found = sharding.open_cells(line, shards)
        found = {i for i in found if line[i].bits < 12}
        if not found:
            break
        finer = [x for i in found for x in made(line[i].bits, [(k, v) for k, v in groups if k >> (12 - line[i].bits) == line[i].prefix], 4)]
        line = sorted([c for i, c in enumerate(line) if i not in found] + finer, key=lambda c: c.prefix << (12 - c.bits))
    sizes = [v for _, v in groups]
    cuts = sharding.minimax_cuts(sizes, shards)
    assert high == max(sum(sizes[a:b]) for a, b in zip([0, *cuts], cuts, strict=False))


def test_giant_group_stands_alone(spark):
    data = spark.createDataFrame([(i, "hot text " * 20) for i in range(50)] + [(100 + i, f"text {i} " * 9) for i in range(100)], "doc_id bigint, text string")
    got = check_shards(sharding.shard_documents(data, 10), data, 10)
    hot = {r["shard"] for r in got if r["doc_id"] < 50}
    rest = Counter(r["shard"] for r in got if r["doc_id"] >= 100)
    assert len(hot) == 1 and not hot & set(rest) and max(rest.values()) - min(rest.values()) <= 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(1, 4))
def test_minimax_is_least(sizes, shards):
    def best(items, k):
        if k == 1 or len(items) <= 1:
            return sum(items)
        return min(max(sum(items[:i]), best(items[i:], k - 1)) for i in range(1, len(items) + 1))

    cuts = sharding.minimax_cuts(sizes, shards)
    parts = [sum(sizes[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)]
    assert cuts[-1] == len(sizes) and len(cuts) <= shards and max(parts) == best(sizes, shards)


# ---- quality


def brute_counts(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(found, found[1:], found[2:], strict=False))
    covered = {i + k for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for k in range(3)}
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, edge, empty, spark, sf):
    for source in (docs, edge):
        got = rows(quality.quality_verdicts(source))
        want = Counter((r["doc_id"], *brute_counts(r["text"])) for r in source.collect())
        assert Counter((r["doc_id"], *(r[c] for c in quality.BASE[:5])) for r in got) == want
        for r in got:
            failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
            assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality.quality_verdicts(empty).count() == 0
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = rows(quality.quality_verdicts(docs))
    good = [r for r in got if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    bad = [r for r in got if labels.get(r["doc_id"]) == 0]
    assert all(r["kept"] for r in good)
    assert sum(r["kept"] for r in bad) <= 0.25 * len(bad)


def test_quality_sketch_is_close_and_mergeable(spark):
    rng = random.Random(3)
    values = [int(rng.paretovariate(1.2) * 50) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").select(quality.bin_of(F.col("v")).alias("b"), "v")
    for r in df.collect():
        assert r["b"] <= r["v"] <= r["b"] * (1 + 1 / 64) + 1e-9


def test_quality_filter_keeps_columns(edge, docs):
    kept = quality.quality_filter(edge)
    assert kept.columns == edge.columns and kept.schema == edge.schema
    verdict = quality.quality_verdicts(docs)
    assert Counter(r["doc_id"] for r in quality.quality_filter(docs).collect()) == Counter(r["doc_id"] for r in verdict.where("kept").collect())


# ---- mixing


def pfair(shares):
    k, total, had, run = list(shares.values()), sum(shares.values()), [0] * len(shares), []
    for t in range(total):
        ready = [(-(-(h + 1) * total // w), i) for i, (h, w) in enumerate(zip(had, k, strict=True)) if h * total // w <= t]
        pick = min(ready)[1]
        had[pick] += 1
        run.append(pick)
    return run


def test_period_is_earliest_deadline_first(spark):
    for shares in ({"a": 5, "b": 3, "c": 2, None: 1}, {"x": 1, None: 1}, dict(SHARES)):
        got = [r["share_no"] for r in mixing.period(spark, shares).orderBy("slot").collect()]
        assert got == pfair(shares)
        total, had = len(got), [0] * len(shares)
        for t, s in enumerate(got, 1):
            had[s] += 1
            assert all(abs(h - t * w / total) < 1 for h, w in zip(had, shares.values(), strict=True))


def test_schedule(docs, edge, empty):
    for source, block in ((docs, 4), (edge, 2)):
        got = rows(mixing.schedule(source, {"src0": 3, "src1": 2}, block))
        assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in source.collect())
        assert len({(r["slot"], r["place"]) for r in got}) == len(got)
        group = lambda s: s if s in ("src0", "src1") else None
        by_slot = defaultdict(set)
        for r in got:
            by_slot[r["slot"]].add((group(r["source"]), r["block"]))
            assert r["released"] <= r["slot"] < r["deadline"] and 0 <= r["place"] < block
        assert all(len(v) == 1 for v in by_slot.values())
    assert mixing.schedule(empty, {"src0": 3}, 4).count() == 0
    out = mixing.mixed(edge, {"src0": 3, "src1": 2}, 2)
    assert out.schema == edge.schema and sorted(map(str, out.collect())) == sorted(map(str, edge.collect()))


def test_mix_order_has_bounded_deviation(docs):
    shares = {"src0": 1, "src1": 1, "src2": 2}
    ordered = [r["source"] for r in mixing.mixed(docs.where(F.col("source").isin(list(shares))), shares, 1).collect()]
    counts = Counter(ordered)
    had = Counter()
    total = sum(shares.values()) + 1
    for s in ordered:
        had[s] += 1
        if any(had[x] >= counts[x] for x in shares):
            break
        t = max(had[x] * total / w for x, w in shares.items())
        assert all(had[x] >= t * w / total - 2 for x, w in shares.items())
    assert BLOCK_ROWS > 1


# ---- top-k


def brute_top(vectors, k, every):
    ok = [(i, [int(np.floor(64.0 * float(x))) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return Counter(out)


def test_top_k(spark, sf):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in op3_exact_top_k(spark, sf).collect()) == brute_top(vectors, 20, 20)


def test_top_k_edges(spark):
    rng = random.Random(2)
    data = [(i, [float(rng.choice([-1, 0, 0.5])) for _ in range(4)]) for i in range(60)]
    data += [(100, None), (120, [None, 1.0, 1.0, 1.0]), (140, [float("nan"), 0.0, 0.0, 0.0]), (160, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in data], "vec_id bigint, embedding array<float>, score string")
    want = brute_top(data, 7, 20)
    for slab, block, chunk in ((8192, 16, 4096), (2, 2, 10)):
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, 7, 64.0, slab, block, chunk)
        assert Counter(tuple(r) for r in got.collect()) == want
    few = topk.top_k(df.where("vec_id < 3"), F.col("vec_id") % 20 == 0, 7)
    assert few.count() == 2
    assert topk.top_k(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0, 7).count() == 0
    huge = spark.createDataFrame([(0, [3.0e15, 1.0]), (1, [2.0e15, 1.0]), (2, [2.0e15, 2.0])], "vec_id bigint, embedding array<double>")
    got = [(r["vec_id"]) for r in topk.top_k(huge, F.col("vec_id") == 0, 2).orderBy("rank").collect()]
    assert got == [1, 2] or got == [2, 1]


def test_top_k_of_vectors_of_many_lengths(spark):
    rng = random.Random(4)
    data = [(i, [float(rng.randint(-2, 2)) for _ in range(rng.choice([0, 1, 3, 4, 9]))]) for i in range(80)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    want = []
    for q, a in data[::20]:
        scored = sorted((-sum(int(64 * x) * int(64 * y) for x, y in zip(a, b)), i) for i, b in data if i != q)[:6]  # noqa: B905
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    for chunk in (7, 4096):
        assert Counter(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, 6, 64.0, 3, 2, chunk).collect())) == Counter(want)


def test_bounded_search_equals_full_scan():
    rng = np.random.default_rng(4)
    c, q = rng.integers(-9, 9, (64, 500)).astype(float), rng.integers(-9, 9, (5, 64)).astype(float)
    ids = np.arange(500)
    for i, (got, score) in enumerate(topk.bounded_search(q, np.array([0, 1, 2, 3, 4]), c, ids, 10)):
        full = q[i] @ c
        want = sorted((-s, j) for j, s in enumerate(full) if j != i)[:10]
        assert [(-s, j) for s, j in zip(score, got, strict=True)] == want


# ---- licences


def test_classifier_holds_out():
    model = licenses.fit([])
    lines, labels = licenses.training_lines(seed=99, copies=15)
    p = model.probabilities(lines)
    guess = [model.families[i] if x[i] >= model.least else licenses.UNKNOWN for x, i in zip(p, p.argmax(1), strict=True)]
    assert np.mean([g == w for g, w in zip(guess, labels, strict=True)]) > 0.95
    unknown = [g for g, w in zip(guess, labels, strict=True) if w == licenses.UNKNOWN]
    assert np.mean([g == licenses.UNKNOWN for g in unknown]) > 0.98


PLANTED = {
    "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "All rights reserved.": "proprietary",
}


def test_license_scan(docs, empty):
    got = {r["doc_id"]: r for r in rows(licenses.scan_licenses(docs))}
    for r in docs.collect():
        want = [PLANTED[x] for x in r["text"].split("\n") if x in PLANTED]
        assert got[r["doc_id"]]["families"] == sorted(set(want))
    assert licenses.scan_licenses(empty).count() == 0


def brute_scan(model, text):
    """Every run of sentences scored by plain loops: (first line, family, confirmed) of what doesn't overlap."""
    mask = (1 << 64) - 1
    code = lambda w: xxhash.xxh3_64_intdigest(w)
    units, paragraph = [], 0
    for n, line in enumerate((text or "").split("\n")):
        parts = [licenses.words_of(x) for x in re.split(r"[.!?] ", line)]
        paragraph += not any(parts)
        units += [(w, n, paragraph) for w in parts if w]
    found = []
    for n in licenses.RUNS:
        for at in range(len(units) - n + 1):
            part = units[at : at + n]
            if part[0][2] != part[-1][2]:
                continue
            total, size = np.zeros(len(model.families)), 0
            for words, _, _ in part:
                for w in words:
                    total += model.weights[code(w) >> 50]
                for x, y in zip(words, words[1:], strict=False):
                    total += model.weights[((code(x) * 0x9E3779B97F4A7C15 + code(y) * 0xC2B2AE3D27D4EB4F) & mask) >> 50]
                size += 2 * len(words) - 1
            z = (total / size**0.5 + model.bias) / model.temperature
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            best = int(p[:-1].argmax())
            if p[best] >= model.least and p[best] > p[-1]:
                words = [w for u, _, _ in part for w in u]
                share = 0.0
                for t in map(licenses.words_of, licenses.TEMPLATES[model.families[best]]):
                    k = min(5, len(t))
                    runs = lambda x, k=k: {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
                    share = max(share, len(runs(t) & runs(words)) / len(runs(t)))
                sure = share >= 0.8
                found.append(((not sure, -share if sure else 0, n if sure else 0, -p[best], at), range(at, at + n), part[0][1], model.families[best], sure))
    taken, out = set(), []
    for _, span, line, family, sure in sorted(found, key=lambda x: x[0]):
        if not taken.intersection(span):
            taken.update(span)
            out.append((line, family, sure, span[0]))
    return [x[:3] for x in sorted(out, key=lambda x: x[3])]


def test_license_scan_by_brute_force(spark, docs, edge):
    wrapped = ["Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal\nin the Software without restriction, and so on", "x\n\nReleased under\n\nthe MIT License.", "Released under\nthe MIT License. " + "More words. " * 3000]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(wrapped)], "doc_id bigint, text string")
    some = docs.where("length(text) < 3000").orderBy("doc_id").limit(25).select("doc_id", "text").unionByName(extra).unionByName(edge.where("length(text) < 60000 or text is null").select("doc_id", "text"))
    model = licenses.train(some)
    again = licenses.train(some.repartition(7))
    assert (model.weights == again.weights).all() and model.least == again.least
    got = Counter((r["doc_id"], tuple((h["paragraph"], h["family"], h["confirmed"]) for h in r["hits"])) for r in rows(licenses.scan_licenses(some)))
    assert got == Counter((r["doc_id"], tuple(brute_scan(model, r["text"]))) for r in some.collect())
    by_id = {r["doc_id"]: r["families"] for r in rows(licenses.scan_licenses(some))}
    assert by_id[1000] == ["mit"] and by_id[1001] == [] and by_id[1002] == ["mit"]


def test_license_wordings():
    model = licenses.fit([])
    templates = [[licenses._shingles(licenses.words_of(t)) for t in licenses.TEMPLATES.get(f, [])] for f in model.families]
    for text, want in {"# SPDX-License-Identifier: MIT": "mit", "Copyright 2020 Someone. All rights reserved.": "proprietary", "Words here. This package is licensed under the MIT License. And more words.": "mit", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:": "bsd-3-clause", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": "gpl-3.0"}.items():
        units, _, group, _ = licenses.units_of(text)
        found = licenses.chosen(model, units, licenses.predictions(model, units, np.array(group)), templates)
        assert [model.families[f] for _, f, _, s in found if s >= 0.8] == [want], text


# ---- WARC


def test_warc(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in rows(op7_warc_archive(spark, sf))}
    most = {}
    for r in pages.collect():
        most[r["html"]] = max(most.get(r["html"], -1), r["page_id"])
    for r in pages.collect():
        raw = (r["html"] or "").encode()
        revisit = len(raw) >= 1000 and most[r["html"]] != r["page_id"]
        assert got[r["page_id"]] == {"page_id": r["page_id"], "payload_bytes": len(raw), "payload_digest": hashlib.sha1(raw).hexdigest(), "record_type": "revisit" if revisit else "response", "refers_to": most[r["html"]] if revisit else None}


def test_warc_edges(spark, tmp_path):
    big = "x" * 1000
    data = [(1, "http://a", big), (5, None, big), (5, None, big), (2, "u\r\nWARC-Type: fake", "small"), (3, "v", "small"), (7, "w", None), (None, "n", big), (8, "é", "é" * 499)]
    df = spark.createDataFrame([(*r, "x") for r in data], "page_id bigint, url string, html string, address string")
    path = warc.write_archive(df, f"file://{tmp_path}/w")
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows(warc.read_index(spark, path)))
    assert got == Counter({(1, "revisit", 5, 1000): 1, (5, "response", None, 1000): 2, (None, "revisit", 5, 1000): 1, (2, "response", None, 5): 1, (3, "response", None, 5): 1, (7, "response", None, 0): 1, (8, "response", None, 998): 1})
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    for r in rows(warc.reconstruct(spark, path)):
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert body == (bytes(r["payload"]) if b"WARC-Type: response" in head else b"") + b"\r\n\r\n" and len(body) == length + 4
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_warc_of_long_and_much_shared_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "HEAVY", 10)
    long = "<p>é</p>" * 700_000
    data = [(i, f"u{i}", "shared " * 200) for i in range(95)] + [(200 + i, f"v{i}", f"own {i} " * 200) for i in range(10)] + [(300, "w", long), (301, "w", long)]
    got = Counter((r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in rows(warc.archive_round_trip(spark.createDataFrame(data, "page_id bigint, url string, html string"))))
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = Counter({("revisit", 94, 1400, sha("shared " * 200)): 94, ("response", None, 1400, sha("shared " * 200)): 1, ("revisit", 301, 6_300_000, sha(long)): 1, ("response", None, 6_300_000, sha(long)): 1})
    want.update(("response", None, len(f"own {i} " * 200), sha(f"own {i} " * 200)) for i in range(10))
    assert got == want


# ---- HTML


def test_main_text_of_made_pages():
    article = "<h1>Tit&eacute;l</h1><p>First  para\n with <a href='/x'>a link</a> inside.</p><p>Second &amp; longer paragraph of the text, with many words in it.</p><p>End.</p>"
    want = "Titél\nFirst para with a link inside.\nSecond & longer paragraph of the text, with many words in it.\nEnd."
    furniture = ["<nav><ul><li><a href='/a'>A</a></li></ul></nav>", "<header><h2>Site name</h2></header>", "<div class='cookie-notice'>We use cookies. " + "blah " * 60 + "</div>", "<div id='sidebar'><p>" + "side " * 80 + "</p></div>", "<form><label>Name</label><input name=q><button>Go</button></form>", "<script>var a='<p>no</p>';</script>", "<style>p{}</style>"]
    after = ["<section class='comments'><p>" + "comment words " * 50 + "</p></section>", "<aside>other</aside>", "<footer>Copyright</footer>", "<div class=\"ad\">Buy</div>"]
    for wrap in ("<article>%s</article>", "<main><div>%s</div></main>", "<div class='content'>%s</div>"):
        page = "<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(furniture) + wrap % article + "".join(after) + "</body></html>"
        assert main_text(page) == want
    assert main_text(None) == "" and main_text("") == "" and main_text("plain  text") == "plain text"
    assert main_text("<p>unclosed <b>bold<p>next<script>x") == "unclosed bold\nnext"


def test_names_of_boxes():
    text = "<p>Some words of the article, many of them.</p>"
    for name in ("site-nav", "mainMenu", "post-comments", "article-footer", "content-ad", "cookie_banner", "entry-related"):
        assert main_text(f"<body><div class='{name}'><p>{'not this ' * 40}</p></div><div class='text'>{text}</div></body>") == "Some words of the article, many of them."
    for name in ("has-sidebar", "single comments-open", "post-header", "no-menu"):
        assert main_text(f"<body class='{name}'><div class='{name}'>{text}</div></body>") == "Some words of the article, many of them."
    assert main_text(f"<div id='sidebar'>{text}</div>") == "Some words of the article, many of them."
    assert main_text(f"<article>{text}<section id='comments'><p>{'reader ' * 90}</p></section></article>") == "Some words of the article, many of them."


def test_main_text_of_table(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = rows(op8_main_text(spark, sf))
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        from html import unescape

        want = "\n".join(x for x in (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner)) if x)
        assert r["text"] == want and r["n_chars"] == len(want)


def test_spans_reach_back_to_the_last_empty_window():
    assert html_text.body_spans([200] * 10 + [2000] * 3) == [(0, 13)]
    assert html_text.body_spans([40, 20, 60, 900, 900, 900]) == [(0, 6)]
    assert html_text.body_spans([900] * 4 + [0] * 3 + [40, 900, 900, 900]) == [(0, 4), (5, 11)]
    lines = ["Heading", "By line", "Short first paragraph.", *("word " * n + "end." for n in (20, 30, 600, 700, 800))]
    assert main_text("<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>") == "\n".join(lines)
