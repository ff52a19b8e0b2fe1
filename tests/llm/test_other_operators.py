"""SimHash, embeddings, WARC, mixing and the pipeline against plain versions."""

import base64
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hornlake.llm import embed, mixing, simhash, warc
from hornlake.llm.common import scratch
from hornlake.llm.components import components

from .conftest import rows


def _groups(ids, linked):
    """{position: smallest id reachable}; ids may hold None."""
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(ids)), 2):
        if linked(a, b):
            up[find(b)] = find(a)
    least = {}
    for k, i in enumerate(ids):
        root = find(k)
        if i is not None:
            least[root] = min(least.get(root, i), i)
    return [least.get(find(k)) for k in range(len(ids))]


def _fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(odd, sample, none):
    for docs in (odd, sample):
        all_rows = docs.collect()
        prints = [_fingerprint(r["text"]) for r in all_rows]
        want = _groups([r["doc_id"] for r in all_rows], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
        got = simhash.near_duplicates(docs).collect()
        expect = [(r["doc_id"], p - (1 << 64) if p >> 63 else p, w) for r, p, w in zip(all_rows, prints, want, strict=True)]
        assert sorted(map(tuple, got), key=str) == sorted(expect, key=str)
    assert simhash.near_duplicates(none).count() == 0


def _ball(seed, n, spread):
    """n fingerprints of which many lie near a few centres."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(3)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randrange(spread)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("seed,n,spread,block", [(1, 300, 7, 16), (2, 300, 12, 2048), (3, 150, 5, 1), (4, 2, 2, 4)])
def test_links_connect_as_all_pairs_do(spark, seed, n, spread, block):
    prints = _ball(seed, n, spread)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    tree = {r["node"]: r["root"] for r in components(simhash.links(df, block=block)).collect()}
    signed = [simhash._signed(p) for p in prints]
    want = _groups(signed, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert [tree.get(s, s) for s in signed] == want


def test_plan_allocates_the_whole_radius():
    rng = np.random.default_rng(0)
    for total in (100, 10**6, 10**10):
        plan = simhash.choose_plan(rng.integers(0, 2**63, 500, dtype=np.uint64), total)
        assert sum(t + 1 for t in plan.limits) == simhash.RADIUS + 1
        assert sorted(b for p in plan.parts for b in p) == list(range(64))
    assert len(simhash.choose_plan(rng.integers(0, 2**63, 500, dtype=np.uint64), 10**10).parts) < 4  # wider partitions for more rows


@pytest.mark.parametrize("limits", [(0, 0, 0, 0), (1, 1), (1, 0, 0), (0, 1, 0), (0, 0, 0, 0, -1)])
def test_every_allocation_finds_all_links(spark, monkeypatch, limits):
    prints = _ball(5, 200, 9)
    m = len(limits)
    plan = simhash.Plan(tuple(tuple(range(i, 64, m)) for i in range(m)), limits)
    monkeypatch.setattr(simhash, "choose_plan", lambda *_: plan)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    tree = {r["node"]: r["root"] for r in components(simhash.links(df, block=32)).collect()}
    signed = [simhash._signed(p) for p in prints]
    assert [tree.get(s, s) for s in signed] == _groups(signed, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)


def test_components(spark):
    rng = random.Random(3)
    cases = [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] * 2]
    for edges in cases:
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
        pairs = {frozenset(e) for e in edges}
        assert got == dict(zip(nodes, _groups(nodes, lambda a, b: frozenset((nodes[a], nodes[b])) in pairs), strict=True))


def _vectors():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 16))
    out = [(i, (base[i % 12] * (1 + i % 3) + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.35])).tolist()) for i in range(240)]
    out += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [1.0, None] + [0.5] * 14), (305, [1.0, 2.0]), (306, [float("inf")] + [1.0] * 15)]
    out += [(0, out[0][1]), (None, out[5][1]), (None, None), (310, out[7][1]), (310, out[7][1])]
    return out


@pytest.mark.parametrize("recall,block", [(1.0, 2048), (1.0, 8), (0.95, 8)])
def test_embeddings(spark, monkeypatch, recall, block):
    monkeypatch.setattr(embed, "PER_CELL", 8)
    data = _vectors()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in data], "vec_id long, embedding array<double>, data string, node long").repartition(3)
    got = embed.near_duplicates(df, target_recall=recall, block=block).collect()
    good = [v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in data]
    unit = [np.array(v) / np.linalg.norm(v) if g else None for (_, v), g in zip(data, good, strict=True)]
    link = lambda a, b: good[a] and good[b] and float(unit[a] @ unit[b]) >= 0.9
    want = _groups([i for i, _ in data], link)
    links = [sum(link(a, b) for b in range(len(data)) if b != a) for a in range(len(data))]
    if recall == 1.0:
        assert sorted(map(tuple, got), key=str) == sorted(((i, n, c, i == c) for (i, _), n, c in zip(data, links, want, strict=True)), key=str)
    else:
        assert sum(r.n_links for r in got) >= 0.9 * sum(links) and sum(r.n_links for r in got) <= sum(links)
    assert embed.near_duplicates(df.limit(0)).count() == 0


def test_embedding_sample(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = vectors.collect()
    unit = np.array([r["embedding"] for r in data], float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = (unit @ unit.T >= 0.9).sum() - len(data)
    assert sum(r.n_links for r in embed.near_duplicates(vectors).collect()) >= 0.9 * near


def _pages():
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    htmls = ["<p>one</p>", "<p>one</p>", "", None, fake, "x" + fake * 3 + "y", "WARC/1.1\r\n", "\r\n\r\n", "a\r\n", "\r\nWARC/1.1\r\nContent-Length: 9999\r\n\r\n", "é漢😀" * 50, "WARC/1.1\r\n\r\n", "z" * 30_000, "<p>one</p>\r\n\r\nWARC/1.1", fake]
    return [(i, None if i % 5 == 0 else f"http://h/{i}\r\nX: y", h) for i, h in enumerate(htmls)]


def _want_pages(pages, least):
    first = {}
    for i, _, h in pages:
        first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in pages:
        data = (h or "").encode()
        again = len(data) >= least and first[h or ""] != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out)


@pytest.mark.parametrize("compression,least,split", [("none", 0, 64), ("none", 11, 1000), ("gzip", 0, 1 << 20)])
def test_warc(spark, compression, least, split):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = spark.createDataFrame(_pages(), "page_id long, url string, html string").withColumn("hex", F.lit(1)).coalesce(2)
        got = warc.round_trip(df, compression=compression, min_revisit=least).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == _want_pages(_pages(), least)


def test_warc_edges(spark):
    ddl = "page_id long, url string, html string"
    assert warc.round_trip(spark.createDataFrame([], ddl)).count() == 0
    got = warc.round_trip(spark.createDataFrame([(None, "u", "same"), (None, "v", "other"), (2, "w", "same"), (2, "w", "same")], ddl)).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [("2", "response", None), ("2", "response", None), ("None", "response", None), ("None", "revisit", 2)]


def _plain_mix(docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = {}
    for _, t, s in docs:
        sums[s] = sums.get(s, 0) + size(t)
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    budget, capped = 1.5 * sum(sums.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = budget - sum(2 * sums[s] for s in capped)
        target = {s: 2.0 * sums[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 2 * sums[s]]
        if not over:
            return sums, target
        capped |= set(over)


def test_mixing(odd, sample, none):
    for docs in (odd, sample):
        data = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        sums, target = _plain_mix(data)
        got = mixing.mix_report(docs.withColumn("skey", F.lit("clash"))).collect()
        assert len(got) == len(data)
        by_source = {}
        source_of = {(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))): s for i, t, s in data}
        for r in got:
            s = source_of[r.doc_id, r["size"]]
            assert r.source_size == sums[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
            assert r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
            by_source.setdefault(s, []).append(r)
        for s, own in by_source.items():
            assert abs(sum(r.taken for r in own) - target[s]) <= max(r["size"] for r in own)
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_report(docs.repartition(5)).collect()), key=str)
        taken = {}
        for r in got:
            taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
        mixed = mixing.mix(docs)
        assert mixed.columns == docs.columns
        words = {}
        for r in mixed.select("doc_id", mixing.word_count(F.col("text")).alias("n")).collect():
            words[r.doc_id] = words.get(r.doc_id, 0) + r.n
        assert {k: v for k, v in words.items() if v} == {k: v for k, v in taken.items() if v}
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    from hornlake.llm import lines

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("text", F.when(F.col("doc_id") == 3, None).when(F.col("doc_id") == 5, "12 34").otherwise(F.col("text")))
    after = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, after[-1], sf)
        path = scratch(spark, "test-pipeline")
        out.write.parquet(path)
        after.append(spark.read.parquet(path))
        if len(after) <= len(corpus_pipeline.STAGES):
            assert after[-1].columns == docs.columns
    ids = [sorted(r.doc_id for r in df.select("doc_id").collect()) for df in after]
    assert ids[1] == [i for i in ids[0] if i not in (3, 5)]
    kept = {r["row"]["doc_id"]: bytes(r["kept"]).decode() for r in lines.dedup_lines(after[1]).collect()}
    assert {r.doc_id: r.text for r in after[2].collect()} == {i: t for i, t in kept.items() if t.strip(" \t\n\x0b\x0c\r")}
    prints = {r.doc_id: _fingerprint(r.text) for r in after[2].collect()}
    order = sorted(prints)
    groups = _groups(order, lambda a, b: (prints[order[a]] ^ prints[order[b]]).bit_count() <= 3)
    assert ids[3] == [i for i, g in zip(order, groups, strict=True) if i == g]
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].count(i) for i in set(ids[4])) <= 2
    assert ids[5] == ids[4]
    texts = {r.doc_id: r.text for r in after[4].collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids) for r in after[5].collect())


def test_operators_import_nothing_back():
    import subprocess

    found = subprocess.run(["grep", "-rln", "hornlake.llm\\|from .llm\\|from ..llm\\|corpus_pipeline", "hornlake", "bench.py"], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).parents[2])).stdout.split()
    assert [f for f in found if not f.startswith("hornlake/llm/") and f.endswith(".py")] == []


def test_rows_cover_the_edges():
    assert any(r[0] is None for r in rows()) and any(r[1] is None for r in rows())


def _shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _jaccard_groups(docs):
    """Groups of the rows of docs by plain comparison of all pairs."""
    sets = [_shingle_set(r["text"]) for r in docs]
    return _groups(list(range(len(docs))), lambda a, b: sets[a] == sets[b] or bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)


def test_shingles_find_all_similar_pairs(spark, odd, sample, none):
    from hornlake.llm import simhash

    rng = random.Random(3)
    made = []
    for i in range(120):
        words = [f"w{(i % 10) * 1000 + k}" for k in range(rng.choice([100, 140, 200]))]
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        made.append((i, " ".join(words)))
    made = spark.createDataFrame(made, "doc_id long, text string")
    for docs, more in ((odd, {}), (sample, {}), (made, {}), (made, {"block": 7})):
        keyed = [(k, r["doc_id"], r["text"]) for k, r in enumerate(docs.collect())]
        df = spark.createDataFrame(keyed, "key long, doc_id long, text string").repartition(3)
        got = {r.key: r.group for r in simhash.similar_documents(df, key_col="key", **more).collect()}
        want = _jaccard_groups([{"text": t} for _, _, t in keyed])
        assert len(got) == len(want) and len({(got[k], w) for k, w in enumerate(want)}) == len(set(got.values())) == len(set(want))
    assert simhash.similar_documents(none).count() == 0


def test_sketches_rule_out_no_similar_pair():
    from hornlake.llm import shingles

    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 40, 300, 5000):
        for share in (0.75, 0.8, 0.81, 0.9, 1.0):
            both = rng.integers(0, 2**63, n).astype(np.uint64)
            apart = rng.integers(0, 2**63, round(n * (1 / share - 1))).astype(np.uint64)
            cut = rng.integers(0, len(apart) + 1)
            a, b = np.unique(np.append(both, apart[:cut])), np.unique(np.append(both, apart[cut:]))
            ends = [shingles.sketch(x) for x in (a, b)]
            for width in (64, min(map(len, ends))):
                x, y = (shingles._sketches([shingles.folded(end, width)]) for end in ends)
                assert shingles.possible(x, len(a), y, len(b), 0.8)[0] or not shingles.similar(a, b, 0.8)
    far = [np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64)) for _ in range(2)]
    assert not shingles.possible(*[x for f in far for x in (shingles._sketches([shingles.sketch(f)]), 3000)], 0.8)[0]


def test_tiles_hold_every_pair_of_a_bucket_once(spark):
    from hornlake.llm import shingles

    rows = spark.range(50).selectExpr("7L shingle", "1 size", "id node", "id root")
    tiled = shingles._tiled(rows, spark.createDataFrame([(7, 50)], "shingle long, rows long"), 8).collect()
    seen = Counter()
    for at in {(r.low, r.high) for r in tiled}:
        own = sorted((r.node, r.block) for r in tiled if (r.low, r.high) == at)
        seen.update((a, b) for i, (a, x) in enumerate(own) for b, y in own[i + 1 :] if at[0] == at[1] or x != y)
    assert len(seen) == 50 * 49 // 2 and set(seen.values()) == {1}


def test_pipeline_drops_similar_documents(spark):
    import corpus_pipeline

    words = [f"word{i}" for i in range(200)]
    near = list(words)
    near[50], near[120], near[160] = "other", "words", "here"  # similarity 181 / 211
    far = [w if i % 30 else "far" for i, w in enumerate(words)]  # similarity below 0.8
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_embedding_recall_beside_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(embed, "PER_CELL", 8)
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    beside = lambda x, cos: cos * x + math.sqrt(1 - cos * cos) * unit((lambda y: y - (y * x).sum(axis=-1, keepdims=True) * x)(rng.normal(size=x.shape)))
    one = unit(rng.normal(size=(1000, 64)))
    hot = beside(np.repeat(unit(rng.normal(size=(1, 64))), 1000, axis=0), math.sqrt(0.999))
    data = np.concatenate([one, beside(one, 0.91), hot])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data.tolist())], "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: r.n_links for r in embed.near_duplicates(df).collect()}
    want = (unit(data) @ unit(data).T >= 0.9).sum(axis=1) - 1
    assert np.mean([min(1.0, got[i] / n) for i, n in enumerate(want) if n and i < 2000]) >= 0.995


def test_pipeline_keeps_one_row_of_repeated_and_null_ids(spark):
    import corpus_pipeline

    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = spark.createDataFrame([(1, one), (1, one), (2, one), (None, one), (None, two), (None, two), (3, two), (None, three), (None, three)], "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, one), (3, two), (None, three)], key=str)
