"""Merkle manifest, vector codes and language identification against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import codes, langid, merkle
from lexmill.llm.queries import QUERIES


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """The root and each node's (place, run) on its way up."""
    paths = [[] for _ in nodes]
    at, now = list(range(len(nodes))), nodes
    while len(now) > 1:
        for i, a in enumerate(at):
            paths[i].append((a % 8, now[a - a % 8 : a - a % 8 + 8]))
            at[i] = a // 8
        now = [sha(*now[i : i + 8]) for i in range(0, len(now), 8)]
    return now[0], paths


def plain_manifest(rows) -> list[tuple]:
    leaf = lambda r, text: sha(*map(enc, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    trees: dict = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, lower(r["text"])), r["doc_id"]))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: climb([t[2] for t in sorted(trees[x], key=lambda t: t[:4])]) for x in langs}
    root, tops = climb([built[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops, strict=True):
        for (_, _, own, changed, doc_id), path in zip(sorted(trees[x], key=lambda t: t[:4]), built[x][1], strict=True):
            steps = [*path, *top]
            siblings = [s for a, run in steps for i, s in enumerate(run) if i != a]
            now = changed if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else own
            for a, run in steps:
                now = sha(*run[:a], now, *run[a + 1 :])
            out.append((doc_id, own, built[x][0], root, sha(*siblings), now, now == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_of_hostile_rows(edge):
    clash = edge.withColumns({"tree": F.lit("t"), "digest": F.lit("d"), "idx": F.lit(1), "proof": F.lit("p"), "tampered": F.lit("x")})
    got = merkle.tamper_check(clash).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_manifest(edge.collect()), key=str)


@pytest.mark.parametrize("n", [1, 8, 9, 70])
def test_manifest_sizes(spark, n):
    rows = [(i * 7 % n, f"Text {i}", None if i % 5 == 0 else f"l{i % 3}" if i % 2 else "é", "s", i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = merkle.tamper_check(docs).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_manifest(docs.collect()), key=str)


def test_many_groups_of_one_row(spark):
    docs = spark.createDataFrame([(i, "T", f"{i:03d}", "s", 1) for i in range(100)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = merkle.tamper_check(docs).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_manifest(docs.collect()), key=str)


def test_wrong_sibling_or_place_fails(spark):
    rows = spark.createDataFrame([(i, "en", sha(str(i))) for i in range(30)], "k int, g string, digest string")
    proved = merkle.manifest(rows, "g", "k")
    first = F.col("proof")[0]
    forged = F.concat(F.array(F.struct(((first["at"] + 1) % 6).alias("at"), first["siblings"].alias("siblings"))), F.slice("proof", 2, 9))
    got = proved.select((merkle.folded(F.col("digest"), F.col("proof")) == F.col("root")).alias("good"), (merkle.folded(F.col("digest"), forged) == F.col("root")).alias("bad")).distinct().collect()
    assert [tuple(r) for r in got] == [(True, False)]


def plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, lab, [int(np.floor(scale * float(x))) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max((len(v) for _, _, v in kept), default=0)
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    kept = [(i, lab, v + [0] * (dims - len(v))) for i, lab, v in kept]
    cut = [(dims * p // parts, dims * (p + 1) // parts) for p in range(parts)]
    books = [[(v + [0] * (dims - len(v)))[a:z] for _, _, v in first] for a, z in cut]
    near = lambda x, b: min((sum((s - t) ** 2 for s, t in zip(x, e, strict=True)), j) for j, e in enumerate(b))
    for _ in range(rounds):
        for p, (a, z) in enumerate(cut):
            members: dict = {}
            for _, _, v in kept:
                members.setdefault(near(v[a:z], books[p])[1], []).append(v[a:z])
            for j, m in members.items():
                books[p][j] = [sum(c) // len(m) for c in zip(*m, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for i, lab, v in kept:
        found = [near(v[a:z], books[p]) for p, (a, z) in enumerate(cut)]
        out.append((i, lab, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
        sums[lab] = sums.get(lab, 0) + out[-1][3]
    return [(i, code, e, sums[lab], digest) for i, lab, code, e in out]


VECTORS = "vec_id bigint, embedding array<float>, label int, code string, error int, deal int"


def vector_rows():
    rng = random.Random(3)
    rows = [(i, [round(rng.uniform(-1, 1), 2) for _ in range(8)], i % 3 if i % 5 else None) for i in range(60)]
    rows += [(60, rows[3][1], 1), (61, rows[3][1], 1), (61, rows[4][1], 2), (None, rows[5][1], None), (62, None, 1), (63, [1.0, None] * 4, 1), (64, [float("nan")] * 8, 1), (65, [float("inf")] * 8, 2)]
    rows += [(66, [0.5, 0.25, 1.0], 0), (67, [], 0), (68, [-3000.0] * 8, 1), (69, [2.0**20] * 8, 1)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]


def test_codes_of_hostile_rows(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "c", 5, 6) for r in rows], VECTORS).repartition(3)
    got = codes.code_vectors(df, entries=16).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_codes(rows, entries=16), key=str)
    assert codes.code_vectors(df.limit(0)).count() == 0


def test_partial_distances_lose_nothing():
    rng = np.random.default_rng(1)
    for dims, top, n in ((16, 30, 400), (1, 3, 50), (7, 2, 300), (5, 1 << 40, 40), (0, 1, 5)):
        points, book = rng.integers(-top, top + 1, (n, dims)), rng.integers(-top, top + 1, (37, dims))
        book[20:25] = book[3:8]  # ties
        index, distance = codes.nearest(points, book)
        for i, p in enumerate(points):
            want = min((sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)), j) for j, e in enumerate(book))
            assert (int(distance[i]), int(index[i])) == want


def test_codes_decode_to_codebook_entries(spark, sf):
    whole = codes.whole_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"), 1024.0, ())
    books = codes.train_codebooks(whole, entries=32, rounds=1)
    coded = codes.encode(whole, books)
    back = codes.decode(coded, books).withColumnRenamed("v", "d")
    gap = F.aggregate(F.zip_with("v", "d", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    assert coded.join(whole, "vec_id").join(back, "vec_id").where(gap != F.col("error")).count() == 0


def test_languages_of_held_out_documents(spark, docs):
    got = QUERIES["op12_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("crc"))
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == truth.count() and all(r["held_out"] == (r["crc"] % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.99 * len(held) > 200
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_hostile_rows(spark, edge):
    clash = edge.withColumns({"h": F.lit(1), "n": F.lit("n"), "buckets": F.lit("b"), "score": F.lit("s"), "r": F.lit("r")})
    got = langid.predicted_languages(clash).collect()
    texts = [r["text"] for r in edge.collect()]
    blank = sum(t is None or not any(c.isalpha() for c in t) for t in texts)
    assert len(got) == len(texts) and sum(r["lang_pred"] == "und" for r in got) == blank
    assert {r["lang_pred"] for r in got} <= {"und", "en", "de"}
    nothing = langid.predicted_languages(edge.where("lang is null")).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    assert langid.predicted_languages(edge.limit(0)).count() == 0


def test_prediction_is_the_nearest_centroid(spark, docs):
    texts = docs.select("text", "lang")
    model = langid.train(texts, sample=30, k=3)
    again = langid.train(texts.repartition(7), sample=30, k=3)
    assert model.langs == again.langs and np.array_equal(model.centroids, again.centroids) and np.array_equal(model.idf, again.idf)
    assert len(model.langs) == 12 and (model.radius < 1).any()
    for r in langid.identify(docs.limit(40), model, ("text",)).collect():
        b, c = langid.gram_counts(r["text"])
        full = np.zeros(len(model.idf))
        full[b] = np.log1p(c) * model.idf[b]
        cosines = full @ model.centroids / np.linalg.norm(full)
        assert model.langs[int(cosines.argmax())] == r["lang_pred"] and abs(cosines.max() - r["score"]) < 1e-6
        assert r["rejected"] == (1 - r["score"] > model.radius[int(cosines.argmax())])


def test_texts_of_another_script_are_rejected(spark, docs):
    model = langid.train(docs.select("text", "lang"))
    far = spark.createDataFrame([("и это совсем другой язык, которого не было в образцах " * 20,), ("1234 !!",)], "text string")
    got = [(r["lang_pred"], r["rejected"]) for r in langid.identify(far, model, ("text",)).collect()]
    assert got[0][1] is True and got[1] == ("und", True)


def test_clusters_keep_two_ways_of_writing_apart():
    rng = np.random.default_rng(2)
    a, b = np.abs(rng.normal(0, 0.05, (20, 30))), np.abs(rng.normal(0, 0.05, (20, 30)))
    a[:, :3] += 1
    b[:, 10:13] += 1
    x = np.concatenate([a, b])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres, own = langid.clusters(x, 2)
    assert len(set(own[:20])) == len(set(own[20:])) == 1 and own[0] != own[20]
    assert np.allclose(np.linalg.norm(centres, axis=1), 1)


def test_counts_are_of_letters_only():
    one, two = langid.gram_counts("Ab, ab!! 12 AB"), langid.gram_counts("ab ab ab")
    assert np.array_equal(one[0], two[0]) and np.array_equal(one[1], two[1])
    assert len(langid.gram_counts(None)[0]) == len(langid.gram_counts("12 ́")[0]) == 0
