"""Line dedup, chunks, secrets, media, language and BPE against plain versions."""

import hashlib
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from hornlake.llm import bpe, chunks, langid, lines, media, secrets
from hornlake.llm.common import scratch
from pyspark.sql import functions as F

from .conftest import rows

LAST = 1 << 63


def _plain_lines(docs):
    """(id, n_lines, n_dropped, kept) by the contract."""
    space = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(space))
    owner = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            k = key(line)
            owner[k] = min(owner.get(k, LAST), LAST - 1 if i is None else i)
    out = []
    for i, text in docs:
        mine = LAST - 1 if i is None else i
        parts = (text or "").split("\n")
        kept = [x for x in parts if len(key(x)) < 10 or owner[key(x)] >= mine]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_lines_odd(odd, batches, fanout):
    got = lines.dedup_lines(odd, batches=batches, fanout=fanout).select("row.doc_id", "n_lines", "n_dropped", F.col("kept").cast("string")).collect()
    assert sorted(map(tuple, got), key=str) == _plain_lines([(r[0], r[1]) for r in rows()])


def test_runs_merge_without_shuffle_or_sort(spark):
    store = lines.RunStore(spark, fanout=2, buckets=3)
    made = lambda low: spark.range(low, low + 50).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("h"), F.col("id").alias("owner"))
    try:
        for k in range(3):
            store.add(made(100 * k))
        assert [len(x) for x in store.levels] == [1, 1] and sum(r.count() for r in store.runs()) == 150
        names = [name for level in store.levels for name in level]
        plan = store.merged(names)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        store.add(made(300))
        assert [len(x) for x in store.levels] == [0, 0, 1] and store.runs()[0].count() == 200
    finally:
        store.close()
    assert spark.conf.get(store.IN_ORDER) == "false"


def test_lines_sample(sample):
    got = lines.dedup_lines(sample).select("row.doc_id", "n_lines", "n_dropped", F.col("kept").cast("string")).collect()
    assert sorted(map(tuple, got), key=str) == _plain_lines([(r["doc_id"], r["text"]) for r in sample.collect()])


def test_empty_tables(none):
    assert lines.dedup_lines(none).count() == 0
    assert chunks.repeats_by_document(none).count() == 0
    assert secrets.scan_once(none).count() == 0
    assert media.read_media(media.store_media(none)).count() == 0
    assert langid.identify(none, langid.train(none)).count() == 0
    assert bpe.encode(none, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_boundaries_cover_and_resist_shifts():
    data = bytes(zlib.crc32(bytes([i % 251, i // 251 % 256, 7])) % 256 for i in range(20_000))
    for text in (b"", b"a", data[:16], data[:17], data):
        ends = chunks.boundaries(text)
        assert (ends[-1] if ends else 0) == len(text)
        sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
        assert all(chunks.LEAST <= s <= chunks.MOST for s in sizes[:-1])
    cut = lambda t: {t[a:b] for a, b in zip([0, *chunks.boundaries(t)], chunks.boundaries(t), strict=False)}
    assert len(cut(data) - cut(data[:9000] + b"inserted" + data[9000:])) <= 4


def test_gear_hash_is_windowed():
    import numpy as np

    data = np.arange(100, dtype=np.uint8)
    slow = [sum(int(chunks.GEAR[data[i - k]]) << k for k in range(min(16, i + 1))) % 2**32 for i in range(100)]
    assert chunks.gear_hashes(data).tolist() == slow


def test_passages(spark, odd):
    words = [f"w{i}x{i * 7 % 13}" for i in range(400)]
    passage = " ".join(words[:60])
    docs = [(1, "alpha beta " + passage + " gamma"), (2, " ".join(words[100:200])), (3, "zz " + passage), (4, passage + " tail end here"), (5, " ".join(words[200:230]) + " " + " ".join(words[200:230]))]
    got = {r.doc_id: r for r in chunks.repeats_by_document(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) == {1, 3, 4}
    assert all(r.first_doc_id == 1 and r.repeated_bytes >= 200 for r in got.values())
    assert {r.doc_id for r in chunks.repeats_by_document(odd, min_passage=40).collect()} >= {1, 7}


def test_passages_sample(sample):
    docs = [(r["doc_id"], r["text"] or "") for r in sample.collect()]
    seen = defaultdict(set)
    for i, text in docs:
        w = text.split()
        for k in range(len(w) - 50):
            seen[tuple(w[k : k + 51])].add(i)
    sharing = set().union(*(v for v in seen.values() if len(v) > 1))
    flagged = {r.doc_id for r in chunks.repeats_by_document(sample).collect()}
    assert sharing <= flagged
    short = defaultdict(set)
    for i, text in docs:
        w = text.split()
        for k in range(len(w) - 11):
            short[tuple(w[k : k + 12])].add(i)
    assert flagged <= set().union(*(v for v in short.values() if len(v) > 1))


KEYS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"


def _plain_secrets(text):
    found = []
    for k, (kind, pattern, group, least) in enumerate([("assign", f"({KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [x[2] for x in sorted(found)]


def test_secrets(odd, sample):
    for docs in (odd, sample):
        want = sorted(((r["doc_id"], _plain_secrets(r["text"])) for r in docs.collect()), key=str)
        got = [(r.doc_id, [f"{f.kind}:{f.start}:{f.end}" for f in r.findings if f.kind in secrets.BASE]) for r in secrets.scan_once(docs).collect()]
        assert sorted(got, key=str) == want
    assert sum(len(_plain_secrets(r[1])) for r in rows()) == 4


def test_secret_keywords_are_ascii():
    assert secrets._assign("paſſword=abcdefg") == [] and secrets._assign("toKen: abcdefg") == []
    assert secrets._assign("Token : \"abcdef") == [(0, 15)]


def test_ledger_scans_each_blob_once(spark, odd, monkeypatch):
    ledger = scratch(spark, "test-ledger")
    first = sorted(map(str, secrets.scan(odd, ledger).collect()))
    n = secrets.read_ledger(spark, ledger).count()
    blobs = len({r[1] or "" for r in rows()})
    assert n == blobs * len(secrets.RULES)
    assert sorted(map(str, secrets.scan(odd, ledger).collect())) == first
    assert secrets.read_ledger(spark, ledger).count() == n
    newer = (*secrets.RULES[1:], secrets.Rule("assign", 2, secrets._assign))
    secrets.scan(odd, ledger, rules=newer)
    assert secrets.read_ledger(spark, ledger).count() == n + blobs


def test_media_round_trip(odd):
    got = media.read_media(media.store_media(odd)).collect()
    assert len(got) == len(rows())
    by_text = {hashlib.sha256(media.pad((r[1] or "").encode())).hexdigest(): (r[1] or "").encode() for r in rows()}
    for r in got:
        data = by_text[r.payload_sha256]
        padded = media.pad(data)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(padded), zlib.crc32(padded[-32:]))
        stored = media.wrap(padded)
        assert r.media_sha256 == hashlib.sha256(stored).hexdigest()
        # The feature by plain arithmetic: keyframes are every eighth sample behind the place where the payload lies.
        first, n = len(stored) - len(padded), len(padded) // 576
        assert stored[first:] == padded and r.feature == f"raw8:{n}/25:{n}:" + ",".join(f"{first + 576 * k}+576" for k in range(0, n, 8))
        (track,) = r.tracks
        assert (track.codec, track.duration, track.timescale, track.samples, [k.start for k in track.keyframes]) == ("raw8", n, 25, n, [first + 576 * k for k in range(0, n, 8)])


def test_media_tables_and_damage():
    for n in (1, 8, 9, 16, 17, 40):
        payload = bytes(i % 251 for i in range(n * media.SAMPLE))
        data = media.wrap(payload)
        (track,), ((at, stop),) = media.walk(data)
        assert data[at:stop] == payload
        assert (track.codec, track.duration, track.sizes[1]) == ("raw8", n, n)
        ranges = track.keyframe_ranges()
        assert [data[a : a + s] for a, s in ranges] == [payload[k * 576 : (k + 1) * 576] for k in range(0, n, media.GOP)]
        for cut in range(0, len(data), 97):
            media.walk(data[:cut])  # must not raise


def test_media_varied_sizes_and_small_offsets():
    table = media._box(b"stbl", media._full(b"stsd", media._u32s((1,)), media._box(b"mp4a", bytes(8))), media._full(b"stsc", media._u32s((1, 1, 2, 1))), media._full(b"stsz", media._u32s((0, 3, 5, 6, 7))), media._full(b"stco", media._u32s((2, 100, 200))))
    (track,), _ = media.walk(media._box(b"moov", media._box(b"trak", media._box(b"mdia", media._box(b"minf", table)))))
    assert track.places() == [(100, 5), (105, 6), (200, 7)] and track.keyframe_ranges() == track.places() and track.codec == "mp4a"


def test_media_time_tables_and_compact_sizes():
    box, full, u32s = media._box, media._full, media._u32s
    table = box(
        b"stbl", full(b"stsd", u32s((1,)), box(b"avc1", bytes(8))), full(b"stts", u32s((2, 2, 10, 1, 30))), full(b"ctts", u32s((1, 3, 5))), full(b"stss", u32s((2, 1, 3))),
        full(b"stsc", u32s((1, 1, 3, 1))), full(b"stz2", bytes([0, 0, 0, 4]), u32s((3,)), bytes([0x57, 0x90])), full(b"stco", u32s((1, 40))),
    )
    head = full(b"mdhd", u32s((0, 0, 90, 7)), bytes(4))
    track = box(b"trak", full(b"tkhd", u32s((0, 0, 6)), bytes(12)), box(b"edts", full(b"elst", u32s((1, 50, 0xFFFFFFFF, 0x10000)))), box(b"mdia", head, box(b"minf", table)))
    (t,), _ = media.walk(box(b"moov", track))
    assert (t.id, t.duration, t.stated, t.edits, t.presentation()) == (6, 50, 7, [(50, -1)], [5, 15, 25])
    assert t.places() == [(40, 5), (45, 7), (52, 9)] and t.keyframe_ranges() == [(40, 5), (52, 9)]
    other = box(b"moov", track.replace(u32s((2, 2, 10, 1, 30)), u32s((2, 2, 11, 1, 30))))
    assert media.walk(other)[0][0].duration == 52


def test_media_fragments():
    box, full, u32s = media._box, media._full, media._u32s
    table = box(b"stbl", full(b"stsd", u32s((1,)), box(b"vp09", bytes(8))), full(b"stts", u32s((0,))), full(b"stsc", u32s((0,))), full(b"stsz", u32s((0, 0))), full(b"stco", u32s((0,))))
    track = box(b"trak", full(b"tkhd", u32s((0, 0, 2)), bytes(12)), box(b"mdia", full(b"mdhd", u32s((0, 0, 10, 0)), bytes(4)), box(b"minf", table)))
    start = box(b"moov", track, box(b"mvex", full(b"trex", u32s((2, 1, 5, 100, media.NO_KEYFRAME)))))
    one = full(b"trun", u32s((2,)) + u32s((64, 0)), flags=0x1 | 0x4)  # two samples of defaults, the first a keyframe
    two = full(b"trun", u32s((2, 7, 30, 0, 8, 40, media.NO_KEYFRAME)), flags=0x100 | 0x200 | 0x400)  # goes on behind
    moof = box(b"moof", full(b"mfhd", u32s((1,))), box(b"traf", full(b"tfhd", u32s((2,)), flags=0x20000), one, two))
    unknown = box(b"moof", box(b"traf", full(b"tfhd", u32s((9,))), one))
    data = start + moof + box(b"mdat", bytes(270)) + unknown
    (t,), ((at, stop),) = media.walk(data)
    first = len(start) + 64
    assert t.places() == [(first, 100), (first + 100, 100), (first + 200, 30), (first + 230, 40)]
    assert t.keyframe_ranges() == [(first, 100), (first + 200, 30)] and (t.duration, t.samples, stop - at) == (5 + 5 + 7 + 8, 4, 270)
    for cut in range(len(data)):
        media.walk(data[:cut])  # must not raise


def test_automaton_knows_exactly_the_substrings():
    text = [0, 1, 0, 0, 1, 2, 0, 1]
    table = langid.automaton(text, 4)
    subs = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}

    def reads(word):
        state = 0
        for c in word:
            state = table[state, c]
            if state < 0:
                return False
        return True

    import itertools

    for n in range(1, 5):
        for word in itertools.product(range(4), repeat=n):
            assert reads(word) == (word in subs)


def _plain_phrases(samples, text):
    """Greedy parse of a whole folded text over the folded sample texts; characters that none has count as two phrases."""
    text, n, i = langid._fold(text), 0, 0
    corpus = [langid._fold(t) for t in samples]
    while i < len(text):
        j = i + 1
        known = any(text[i] in t for t in corpus)
        while known and j < len(text) and any(text[i : j + 1] in t for t in corpus):
            j += 1
        n, i = n + 2 - known, j
    return n


@pytest.mark.parametrize("window", [512, 7, 1])
def test_phrases_against_plain_parse(sample, monkeypatch, window):
    monkeypatch.setattr(langid, "WINDOW", window)
    rows_ = [r for r in sample.where("lang IS NOT NULL").limit(40).collect()]
    samples = defaultdict(list)
    for r in rows_[:20]:
        samples[r["lang"]].append(r["text"][:300])
    samples["aa"] = ["ab" * 400]  # phrases far longer than a window
    model = langid.build(samples)
    texts = [r["text"][:1500] for r in rows_[20:30]] + ["", "a", "ab" * 1000, "x" + "ba" * 300 + "\u4e00\u4e01\u4e01 ab", "\u4e00"]
    found, sizes = model.phrases(texts)
    for i, t in enumerate(texts):
        assert sizes[i] == len(langid._fold(t))
        assert [int(n) for n in found[i]] == [_plain_phrases(samples[lang], t) for lang in model.langs]


def test_language_ties_and_empty_training(spark, none):
    model = langid.build({"b": ["same text here"], "a": ["same text here"]})
    assert model.predict(["same text"]) == [("a", 0.0, 9.0)]
    docs = spark.createDataFrame([(None, "wort fur wort", "de"), (None, "wort fur wort", "de"), (None, "parola per parola", "it"), (3, None, "fr")], "doc_id long, text string, lang string")
    assert langid.train(docs).langs in (["de", "it"], [])  # null ids hash alike, so they are learned from or held out together
    assert langid.train(none).langs == [] and langid.train(none).predict(["text"]) == [("und", 0.0, 0.0)]


def test_language_accuracy_and_edges(odd, sample):
    model = langid.train(sample)
    got = langid.identify(sample, model).select("row.lang", "lang_pred", langid.held_out(F.col("row.doc_id")).alias("held")).where("held").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.95
    edge = langid.identify(odd, model).select("row.doc_id", "text", "lang_pred", "score").collect()
    assert len(edge) == len(rows())
    for r in edge:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))


def test_bpe_like_tiktoken(odd, sample):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for docs in (odd, sample):
        got = bpe.encode(docs, path, public_tokenizers.PATTERN).select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids", "ids_sha256", "decoded").collect()
        want = [(r["doc_id"], own.encode_ordinary(r["text"] or ""), r["text"] or "") for r in docs.collect()]
        assert sorted(((r.doc_id, r.ids) for r in got), key=str) == sorted(((i, ids) for i, ids, _ in want), key=str)
        assert sorted(bytes(r.decoded) for r in got) == sorted(t.encode() for _, _, t in want)
        assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in got)


def test_bpe_shared_words_are_read_in_place():
    """A worker holds a shared word once: nothing is built beside the broadcast bytes."""
    n = 200_000
    word = pa.array([b" word%d" % i for i in range(n)], pa.binary())
    table = pa.table({"hash": pa.array(bpe._hashes(word).view(np.int64)), "word": word, "ids": pa.array([[i, 7] for i in range(n)], pa.list_(pa.int32()))})
    data = bpe._packed(table)
    assert len(data) < 48 * n
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    hashes, words, ids = bpe._unpacked(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n and pa.total_allocated_bytes() - before < n
    asked = pa.array([b" word0", b"none", b" word199999"], pa.binary())
    at = bpe._found(asked, words, hashes)
    assert words.take(at).to_pylist() == [b" word0", None, b" word199999"] and ids.take(at).to_pylist() == [[0, 7], None, [199999, 7]]
    hashes, words, _ = bpe._unpacked(bpe._packed(table.slice(0, 0)))
    assert bpe._found(asked, words, hashes).null_count == 3


def test_bpe_long_words():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    for word in ("a", "ab" * 3000, "strasse" * 400 + "é" * 50, "x" * 5000, "aaabdaaabac" * 100):
        assert codec.encode_long(word.encode()) == own.encode_ordinary(word)


def test_passages_reach_the_ends_of_every_repeat(spark):
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 5)))
    docs, planted = [], []
    for k in range(150):  # passages of 120 bytes; upper case around them, so that nothing goes on alike
        passage = ("row row row your boat " * 6 if k == 0 else "lorem " * 30 if k == 1 else " ".join(word() for _ in range(60)))[:120].strip()
        passage += "z" * (120 - len(passage))
        for i in (2 * k, 2 * k + 1):
            before, after = ("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n)) for n in (20 + rng.randrange(300), 300))
            before, after = before + "!?"[i % 2], "!?"[i % 2] + after
            planted.append((i, len(before), len(before) + 120, 2 * k))
            docs.append((i, before + passage + after))
    got = chunks.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == planted


def test_passages_are_of_a_rows_own_text(spark):
    one, two = (" ".join(f"{k}word{i}" for i in range(40)) for k in "ab")
    docs = [(1, one), (2, "q " + one), (2, "some other text before it " * 3 + two + " end"), (3, two), (None, one), (None, "x " + two), (4, "éé " + one + " éé")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text.encode())
    got = chunks.repeated_passages(docs).collect()
    assert len(got) == 7
    for r in got:
        assert any(t[r.start : r.stop] in (one.encode(), two.encode()) or t[r.start : r.stop].strip(b" ") in (one.encode(), two.encode()) for t in texts[r.doc_id])
    kept = {(r.doc_id, bytes(r.kept).decode()): r.n_cut for r in chunks.without_repeats(docs).select("row.doc_id", "kept", "n_cut").collect()}
    whole = {k for k, cut in kept.items() if not cut}
    assert len(kept) == 7 and (1, one) in whole and any(i == 2 and two in t for i, t in whole)
    assert all(cut >= 200 for (i, t), cut in kept.items() if (i, t) not in whole) and len(whole) == 2


def test_boundaries_of_periodic_text_do_not_follow_the_start():
    for unit in (b"lorem ", b"row row row your boat ", b"a"):
        text = unit * 200
        cut = lambda t: {t[max(0, a - 16) : b] for a, b in zip([0, *chunks.boundaries(t)], chunks.boundaries(t), strict=False)}
        assert all(cut(b"Q" * n + text) & cut(b"P" * 3 + text) for n in range(1, 130))


def test_languages_of_large_and_many_alphabets(spark):
    import random

    rng = random.Random(2)
    scripts = {f"l{k:02d}": [chr(0x4E00 + 400 * k + i) for i in range(400)] for k in range(40)}  # 16,000 characters, no blanks
    text = lambda lang: "".join(rng.choice(scripts[lang]) for _ in range(300))
    docs = spark.createDataFrame([(i, text(f"l{i % 40:02d}"), f"l{i % 40:02d}") for i in range(1200)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == sorted(scripts)
    want = sorted(scripts) * 3
    assert [p[0] for p in model.predict([text(x) for x in want])] == want
