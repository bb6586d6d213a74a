"""Encoding, similarity, matching and scoring against brute force, and the edge cases of their inputs."""

import hashlib
import random
from collections import Counter

import pytest

from flightlake.llm import bpe, decontamination, licenses, simhash, toxicity
from flightlake.llm._common import components

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
EDGE = [(1, None, "x"), (2, "", "x"), (3, "one two", "x"), (3, "one two", "x"), (None, "one two three four", "x"), (4, "Word " * 4000, "x")]
EDGE_SCHEMA = "doc_id long, text string, score string"  # a column whose name clashes with an output


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(EDGE, EDGE_SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


# ---- BPE -------------------------------------------------------------------------------------------


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(VOCABULARY), bpe.Vocabulary(bpe.read_vocabulary(VOCABULARY))
    rng = random.Random(1)
    signs = ["a", "é", "²", "½", "\x1c", "\x85", " ", "Ⅷ", "中", "😀", "\n", "'s", "'re", "1", "٣", "_", "...", "<|endoftext|>", "́", "ª", " the", "\xa0"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(600)] + ["", "a" * 5000, "ab" * 1500, " " * 400]
    for text, packed in zip(texts, own.encode(texts)):
        ids = [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_one_tree_equals_many_trees():
    own, rng = bpe.Vocabulary(bpe.read_vocabulary(VOCABULARY)), random.Random(2)
    words = [bytes(rng.choice(b"etaoin shr") for _ in range(rng.randint(1, 64))) for _ in range(500)]
    for w, packed in zip(words, own.encode_words(words)):
        assert packed == b"".join(i.to_bytes(4, "little") for i in own.encode_word(w))


def test_bpe_rows(spark, odd, nothing):
    got = bpe.encode(odd, "doc_id", "text", VOCABULARY, with_ids=True).collect()
    assert len(got) == len(EDGE) and bpe.encode(nothing, "doc_id", "text", VOCABULARY).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == 0 and by[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[4].decoded == "Word " * 4000


# ---- SimHash ---------------------------------------------------------------------------------------


def print_of(text, shingle=3):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [words] if len(words) < shingle else [words[i : i + shingle] for i in range(len(words) - shingle + 1)]
    h = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints: dict, distance: int) -> dict:
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_equals_all_pairs(spark):
    rng, texts = random.Random(4), {}
    words = [f"w{i}" for i in range(300)]
    for i in range(0, 240, 4):
        base = [rng.choice(words) for _ in range(rng.randint(1, 300))]
        texts[i] = " ".join(base)
        for k in range(1, 4):
            other = list(base)
            for _ in range(rng.randint(0, 2)):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts[i + k] = " ".join(other).upper() if k == 1 else "\t".join(other)
    texts |= {300: "", 301: " \n", 302: "One", 303: "one", 304: "a b"}
    prints = {i: print_of(t) for i, t in texts.items()}
    want = classes(prints, 3)
    got = simhash.simhash_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text").collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: format(p, "016x") for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    assert len({c for c in want.values()}) < len(want) - 60


@pytest.mark.parametrize("split_at", [8, 10_000])
def test_dense_bucket_is_whole(spark, split_at, monkeypatch):
    """All fingerprints share 40 bits, so they meet in large buckets, which are dealt part against part."""
    rng = random.Random(5)
    prints = {0: rng.getrandbits(64)}
    for i in range(1, 300):
        p = prints[rng.randrange(len(prints))]
        for _ in range(rng.randint(1, 4)):
            p ^= 1 << rng.randrange(24)
        prints[i] = p
    want = classes(prints, 3)
    monkeypatch.setattr(simhash, "SPLIT_AT", split_at)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    nodes = spark.createDataFrame([(i, signed(p)) for i, p in prints.items()], "node long, w0 long")
    nodes = nodes.dropDuplicates(["w0"])
    links = simhash.fingerprint_links(nodes, ["w0"], simhash.pigeonhole_masks(64, 6, 3), 3)
    found = {r.node: r.component for r in components(links).collect()}
    ids = sorted(r.node for r in nodes.collect())
    label = {i: found.get(i, i) for i in ids}
    assert all((label[i] == label[j]) == (want[i] == want[j]) for i in ids for j in ids)


def test_masks_hold_every_close_pair():
    rng = random.Random(6)
    masks = simhash.pigeonhole_masks(64, 6, 3)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for _ in range(3):
            b ^= 1 << rng.randrange(64)
        assert any(a & m == b & m for m in masks)


def test_simhash_edge_cases(spark, odd, nothing):
    got = simhash.simhash_groups(odd, "doc_id", "text").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(EDGE) and by[1].fingerprint == "0" * 16 and by[2].component_id == 1 and by[None].component_id is None
    assert simhash.simhash_groups(nothing, "doc_id", "text").count() == 0


def test_near_duplicates_by_wide_prints(spark):
    rng = random.Random(7)
    words = [f"word{i}" for i in range(5000)]
    texts, pairs = [], []
    for i in range(60):
        base = [rng.choice(words) for _ in range(300)]
        other = list(base)
        for _ in range(3):  # about 0.9 of the five-word runs stay
            other[rng.randrange(300)] = rng.choice(words)
        far = base[:150] + [rng.choice(words) for _ in range(150)]
        texts += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(other)), (3 * i + 2, " ".join(far))]
        pairs.append((3 * i, 3 * i + 1))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", **simhash.NEAR).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)
    assert all(got[3 * i + 2] == 3 * i + 2 for i in range(60))


def test_links_are_checked_exactly(spark):
    from pyspark.sql import functions as F

    texts = spark.createDataFrame([(k, " ".join(map(str, range(a, a + 100)))) for k, a in ((1, 0), (2, 5), (3, 20), (3, 20))], "doc_id long, text string")
    texts = texts.withColumn("text_hash", F.xxhash64("text")).select("doc_id", "text_hash", "text")
    nodes = simhash.shingle_sets(texts.distinct(), 5, 0.8, ([], [], [])).withColumn("node", F.col("doc_id")).withColumn("first", F.struct("doc_id", "text_hash"))
    links = spark.createDataFrame([(2, 1), (1, 2), (3, 1), (2, 3)], "u long, v long")
    # 91 of 101 five-word runs are shared by 1 and 2, 81 of 111 by 2 and 3, 76 of 116 by 1 and 3
    assert [tuple(r) for r in simhash.verified(links, nodes, texts, 5, 0.8).collect()] == [(1, 2)]


def jaccard_classes(texts: dict) -> dict:
    sets = {i: set(simhash._hashes(t, 5).tolist()) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in texts:
        for j in texts:
            shared = len(sets[i] & sets[j])
            if i < j and 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def exact_groups(spark, texts: dict) -> dict:
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(df, "doc_id", "text", **simhash.NEAR).collect()}


def test_a_repeated_line_makes_no_near_duplicates(spark):
    """Texts of equal fingerprints (a line of seven words, repeated) that share next to nothing else stay apart."""
    rng = random.Random(12)
    line = "one very common line of seven words " * 150
    texts = {i: line + " ".join(f"w{rng.randrange(10**9)}" for _ in range(1000)) for i in range(4)}
    texts[9] = texts[0] + " " + line  # the same set but for the seam
    got = exact_groups(spark, texts)
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 9: 0}


@pytest.mark.parametrize("small, bucket", [(12, 2048), (4, 2048), (4, 8)])
def test_families_equal_all_pairs(spark, small, bucket, monkeypatch):
    """Templates whose copies lie on both sides of the threshold: no failed link hides a true one."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng, texts = random.Random(13), {}
    for family in range(3):
        base = [f"f{family}x{k}" for k in range(120)]
        for _ in range(40):
            other = list(base)
            for _ in range(rng.randint(1, 6)):
                other[rng.randrange(120)] = f"y{rng.randrange(40)}"
            texts[len(texts)] = " ".join(other)
    want = jaccard_classes(texts)
    assert 6 < len(set(want.values())) < 110 and exact_groups(spark, texts) == want


def test_frequent_shingles_are_all_marked(spark, monkeypatch):
    """Every shingle that more than 12 documents hold, whichever tasks hold them; of the others next to none, whatever one document repeats."""
    monkeypatch.setattr(simhash, "COUNTED", 3000)
    rng, texts = random.Random(14), ["", None, "again " * 400]
    lines = [" ".join(f"l{k}w{i}" for i in range(12)) for k in range(40)]
    for i in range(300):
        mine = [lines[k] for k in range(40) if i < k]  # line k is in k documents
        texts.append(" ".join([*mine, *(f"u{rng.randrange(10**9)}" for _ in range(60))]))
    held = Counter(h for t in texts for h in set(simhash._hashes(t, 5).tolist()))
    table = simhash.frequent_shingles(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), 5, 12)
    slots = {h: h >> (48 - simhash.PART_BITS) for h in held}
    marked = {h for h, s in slots.items() if table[s >> 3] >> (s & 7) & 1}
    often = {h for h, n in held.items() if n > 12}
    assert len(often) > 100 and often <= marked and len(marked - often) < 0.001 * len(held)


def test_shingles_that_a_sample_misses_come_last(spark, monkeypatch):
    """Lines of 30 documents each, of which a sample of one document in 60 sees next to nothing, make no large buckets where texts hold enough of their own."""
    monkeypatch.setattr(simhash, "ORDER_SAMPLE", 10)
    real, large = simhash.bucket_pairs, []

    def watched(keyed, least):
        large.append(real(keyed, least).where("v IS NULL").count())
        return real(keyed, least)

    monkeypatch.setattr(simhash, "bucket_pairs", watched)
    rng, texts = random.Random(15), {}
    for i in range(600):
        line = [f"line{i // 30}w{k}" for k in range(60)]
        texts[i] = " ".join(line + [f"u{rng.randrange(10**9)}" for _ in range(60)])
    for i in range(5):
        texts[600 + i] = texts[100 * i] + f" end{i}"
    got = exact_groups(spark, texts)
    assert got == {**{i: i for i in range(600)}, **{600 + i: 100 * i for i in range(5)}}
    assert large == [0]


def test_no_pair_at_the_threshold_is_missed(spark):
    """Isolated pairs of 100 shingles a text with 0.8 to 0.85 of their union shared, each found."""
    texts = {}
    for i in range(80):
        words = [f"p{i}w{k}" for k in range(120)]
        shift = 11 if i % 2 else 9  # of 104 shingles 93 or 95 are shared: 93 / 115 = 0.809 and 95 / 113 = 0.841
        texts[2 * i], texts[2 * i + 1] = " ".join(words[:108]), " ".join(words[shift : 108 + shift])
    texts[1000], texts[1001] = "a b c d e f g h", "b c d e f g h"  # 3 of 4
    texts[1002], texts[1003] = "q b c d e f g h i", "b c d e f g h i"  # 4 of 5: exactly 0.8
    got = exact_groups(spark, texts)
    assert all(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(80))
    assert got[1001] == 1001 and got[1003] == 1002


# ---- decontamination -------------------------------------------------------------------------------


def test_short_items_match_whole_words_only():
    m = decontamination.Matcher([(1, "yes"), (2, "a"), (3, "the answer is forty two"), (4, "Is it so, yes or no?")])
    assert not m.matches(decontamination.normalise("yesterday a yes"))
    assert m.matches(decontamination.normalise("See: the answer is forty-two!")) == {3: (0, 27)}
    assert not m.matches(decontamination.normalise("bathe answer is forty two")) and not m.matches(decontamination.normalise("the answer is forty twofold"))
    assert m.matches("is it so yes or no") == {} and m.matches("is it so yes or no " * 2) == {}


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_matcher_equals_edit_matrix():
    rng = random.Random(8)
    source = "the quick brown fox jumps over some lazy dogs while thirteen wizards vex bold jukebox pharaohs again"
    for _ in range(150):
        item = decontamination.normalise(source[rng.randrange(20) :][: rng.randint(20, 80)])
        text = list(item)
        for _ in range(rng.randint(0, 9)):
            at, kind = rng.randrange(len(text)), rng.random()
            text[at : at + (kind < 0.7)] = [rng.choice("abc ")] if kind > 0.3 else []
            text = text or ["a"]
        text = decontamination.normalise("xx " * rng.randint(0, 8) + "".join(text) + " yy" * rng.randint(0, 8))
        best, most = edits(item, text), decontamination.budget(item)
        found = decontamination.Matcher([(1, item)]).matches(text)
        assert (1 in found) == (best <= most), (item, text, best, most)
        assert not found or found[1][0] == best


def test_leaks(spark, odd, nothing, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    docs = spark.createDataFrame([(1, "before " + items[0].upper() + " after"), (2, "clean text"), (3, items[1] + " " + items[2]), (None, items[3]), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == {(1, 0, 0), (3, 1, 0), (3, 2, 0), (None, 3, 0)}
    assert [r.doc_id for r in decontamination.without_leaks(docs, bench).collect()] == [2, 4]
    assert decontamination.find_leaks(odd, bench).count() == decontamination.find_leaks(nothing, bench).count() == 0
    assert decontamination.find_leaks(docs, bench.limit(0)).count() == 0


def test_a_very_long_item_is_found(spark):
    rng = random.Random(15)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(800))
    text = list(item)
    for _ in range(60):
        at = rng.randrange(len(text))
        text[at : at + 1] = rng.choice(["", "x", "zz"])
    docs = spark.createDataFrame([(1, "before " + "".join(text) + " after"), (2, item[: len(item) // 2]), (3, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r.distance for r in decontamination.find_leaks(docs, bench).collect()}
    assert set(got) == {1, 3} and got[3] == 0 and 0 < got[1] <= 120


def test_blocks_find_the_same(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {tuple(r) for r in decontamination.find_leaks(docs, bench).collect()}
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 3000)
    assert {tuple(r) for r in decontamination.find_leaks(docs, bench).collect()} == whole and whole


# ---- licences --------------------------------------------------------------------------------------


def dice(a, b):
    a, b = Counter(licenses.bigrams(a)), Counter(licenses.bigrams(b))
    return 2 * sum((a & b).values()) / max(1, a.total() + b.total())


def all_windows(s, text):
    """Every occurrence by brute force: all windows of all templates, the best first, those that overlap no better one."""
    ws = licenses.words(text)
    grams = licenses.bigrams(ws)
    hits = []
    for name, number, want, m, _, _ in s.templates:
        for a in range(len(grams)):
            for b in range(a + 1, min(len(grams), a + 2 * m + 2) + 1):
                both = Counter(grams[a:b])
                x = 2 * sum(min(n, want[g]) for g, n in both.items()) / (m + b - a)
                if x >= s.t:
                    hits.append((-x, a, name, number, b + 1))
    out, taken = [], set()
    for x, a, name, number, b in sorted(hits):
        if not taken & set(range(a, b)):
            taken |= set(range(a, b))
            out.append((name, number, -x, a, b - a))
    return sorted(out)


@pytest.mark.parametrize("long", [0, 64])
def test_licences_equal_all_windows(long, monkeypatch):
    """With windows counted one by one, and by spans from the first bigram on."""
    monkeypatch.setattr(licenses, "LONG", long)
    rng = random.Random(9)
    filler = "lorem ipsum dolor the license of a version under sit amet".split()
    for _ in range(60):
        notices = [" ".join(rng.choice(filler) for _ in range(rng.randint(3, 14))) for _ in range(3)]
        s = licenses.Scanner({f"L{i}": [n] for i, n in enumerate(notices)})
        text = []
        for _ in range(rng.randint(1, 4)):
            notice = rng.choice(notices).split()
            for _ in range(rng.randint(0, 2)):
                notice[rng.randrange(len(notice))] = rng.choice(filler)
            text += [rng.choice(filler) for _ in range(rng.randint(0, 5))] + notice
        assert s.scan(" ".join(text)) == all_windows(s, " ".join(text)), (notices, text)


def test_a_full_text_is_scanned_in_linear_time():
    import time

    rng = random.Random(3)
    full = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(5600))
    s = licenses.Scanner({"Full": [full]})
    began = time.perf_counter()
    assert s.scan("before " + full + " after") == [("Full", 0, 1.0, 1, 5600)]
    assert time.perf_counter() - began < 1.0


def test_licence_rows(spark, odd, nothing):
    df = spark.createDataFrame([(7, "Text.\nReleased under the MIT License.\nMore.\nLicensed under the Apache License, Version 2.0.")], "doc_id long, text string")
    assert [(r.license, r.dice) for r in licenses.scan(df, "doc_id", "text").orderBy("license").collect()] == [("Apache-2.0", 1.0), ("MIT", 1.0)]
    assert licenses.scan(odd, "doc_id", "text").count() == licenses.scan(nothing, "doc_id", "text").count() == 0


def test_templates_from_a_table(spark):
    full = "You may do what you like with it . " * 2 + " ".join(f"clause{i} holds" for i in range(120))
    table = spark.createDataFrame([("Own-1.0", full, 1), ("Own-1.0", full, 2), (None, "x y", 3), ("Null", None, 4)], "license string, text string, score int")
    got = licenses.templates_of(table)
    assert got == {"Own-1.0": [full]} and licenses.templates_of(table.limit(0)) == {}
    docs = spark.createDataFrame([(1, "Before. " + full.upper() + " After. " + full), (2, "clause1 holds")], "doc_id long, text string")
    n = len(licenses.words(full))
    assert [(r.doc_id, r.license, r.dice, r.first_word, r.n_words) for r in licenses.scan(docs, "doc_id", "text", got).collect()] == [(1, "Own-1.0", 1.0, 1, n), (1, "Own-1.0", 1.0, n + 2, n)]


def test_repeated_notices_are_all_found():
    s, notice = licenses.Scanner(), "Licensed under the Apache License, Version 2.0. "
    assert s.scan(notice * 1000) == [("Apache-2.0", 0, 1.0, 7 * i, 7) for i in range(1000)]
    # the whole GPL notice wins over the shorter one that overlaps it; the copies on both sides of it stay
    short, long = "Licensed under the GNU General Public License version 3. ", "This work is licensed under the GNU General Public License, version 3. "
    assert [(x[1], x[3]) for x in sorted(s.scan(short + long + short), key=lambda x: x[3])] == [(1, 0), (0, 9), (1, 21)]


def test_licences_at_exactly_the_threshold():
    s = licenses.Scanner()
    assert s.scan("Licensed under the Apache License") == [("Apache-2.0", 0, 0.8, 0, 5)]  # 4 bigrams of 6: the lower bound
    for m in range(1, 60):
        notice = [f"w{i}" for i in range(m + 1)]
        one = licenses.Scanner({"X": [" ".join(notice)]})
        low, high = -(-2 * m // 3), 3 * m // 2  # 4/5 m / (6/5) and m (6/5) / (4/5)
        assert one.templates[0][4:] == (low, high)
        if m % 3 == 0:
            assert one.scan(" ".join(notice[: low + 1])) == [("X", 0, 0.8, 0, low + 1)]
    # 4 bigrams of the notice in a window of 6, the upper bound
    wide = licenses.Scanner({"X": ["a b c d e"]})
    assert [x[2:] for x in wide.scan("a b c q c d e")] == [(0.8, 0, 7)]


# ---- toxicity --------------------------------------------------------------------------------------


def test_segments_equal_definition():
    """Left to right: the best-scoring run, then the same in what lies before and after it."""

    def split(w, at):
        best = None
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                s = sum(w[i:j])
                if s > 0 and (best is None or s > best[0] or (s == best[0] and j - i < best[2] - best[1])):
                    best = (s, i, j)
        if best is None:
            return []
        s, i, j = best
        return split(w[:i], at) + [(at + i, at + j, s)] + split(w[j:], at + j)

    rng = random.Random(10)
    for _ in range(200):
        w = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() / 7 for _ in range(rng.randint(0, 14))]
        got, want = toxicity.maximal_segments(w), split(w, 0)
        assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want))


def test_weights_equal_brute_force(spark):
    """Counts by text, shares drawn from prefix to word, and the odds that count, told again without tables."""
    import math
    import re

    rng = random.Random(14)
    words = [f"{p}{q}" for p in ("harmless", "harmony", "nast", "nastier", "vile", "x") for q in ("", "y", "ily", "ness", "ing")]
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, " ".join(rng.choice(words[10:25] if rng.random() < (0.6 if toxic else 0.02) else words[:10] + words[25:]) for _ in range(rng.randint(3, 40))), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, "true")
    used = {r.doc_id for r in labels.selectExpr("doc_id", "pmod(xxhash64(doc_id), 5) AS h").where("h <> 0").collect()}

    def keys(word):
        return [f"{n}:{word[:n]}" for n in (4, 5, 6) if len(word) > n] + [f"w:{word}"]

    count = {}
    for i, text, toxic in rows:
        if i in used:
            for k in {k for w in re.findall(r"\w+", text) for k in keys(w)}:
                count.setdefault(k, [0, 0])[toxic] += 1
    t, c = sum(v[1] for v in count.values()), sum(v[0] for v in count.values())
    base = (t + 1) / (t + c + 10)
    assert abs(model.base - base) < 1e-9
    told = 0
    for w in [*words, "unseen"]:
        share = base
        for k in keys(w):
            n, y = count.get(k, (0, 0))
            prior = share
            share = (y + 6 * prior) / (n + y + 6)
        odds = math.log(share / (1 - share)) - math.log(base / (1 - base))
        deviation = math.sqrt(1 / (y + 6 * prior) + 1 / (n + 6 * (1 - prior)))
        want = (odds if abs(odds) >= 1.5 and abs(odds) >= 2.5 * deviation else 0.0) - 0.04
        assert abs(model.weight(w) - want) < 1e-6, w
        told += want > 1
    assert told >= 3  # some words do count
    for _, text, _ in rows[:60]:
        weights = [model.weight(w) for w in text.split()]
        sums = [s for _, _, s in toxicity.maximal_segments(weights)]
        logs = [model.rate * s - math.log(model.k * len(weights)) for s in sums]
        a = min(60.0, max(logs)) if logs else -math.log(model.k * len(weights)) - 1
        b = math.log1p(max(0.0, sum(x for x in logs if x > -math.log(0.05))))
        z = model.logistic[0] + model.logistic[1] * a + model.logistic[2] * b
        assert abs(model.score(text) - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def test_extreme_value_law_is_found_again():
    """Best sums drawn from a known law give its rate and K."""
    import numpy as np

    rng = np.random.default_rng(1)
    n = rng.integers(20, 2000, 20_000)
    rate, k = 0.7, 0.2
    best = (np.log(k * n) + rng.gumbel(size=len(n))) / rate
    got = toxicity.extreme_value_law(best, n.astype(float))
    assert abs(got[0] - rate) < 0.02 and abs(got[1] - k) < 0.02


def test_toxicity_ranks_held_out_texts(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in toxicity.op4_toxicity(spark, d).collect() if r.held_out and r.doc_id in labels]
    good, bad = ([r.score for r in rows if labels[r.doc_id] == y] for y in (0, 1))
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad))
    hits = sum(s >= 0.5 for s in bad)
    assert wins > 0.97 and hits >= 0.85 * len(bad) and sum(s >= 0.5 for s in good) <= 0.02 * len(good)


def test_toxicity_edge_cases(spark, odd, nothing):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels.limit(0), "true")
    got = toxicity.score(odd, model, with_passages=True)
    assert got.count() == len(EDGE) and got.where(F.col("score").between(0, 1)).count() == len(EDGE)
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.score(odd, toxicity.fit(odd, labels, "true")).count() == len(EDGE)


def test_stages_send_each_text_once_in_small_batches(spark):
    """What a task holds of its texts at once: one column of them, worked on in parts, with the rows and their order unchanged."""
    import pyarrow as pa

    from flightlake.llm import _common

    rows = [(i, f"word{i} some text " * (i % 7), "en", "web", i) for i in range(3 * _common.SLICE_ROWS + 1)]
    batch = pa.RecordBatch.from_pylist([{"doc_id": r[0], "text": r[1]} for r in rows])
    parts = list(_common.slices([batch, batch.slice(0, 0)]))
    assert max(p.num_rows for p in parts) == _common.SLICE_ROWS and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()

    carry = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1)
    model = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), "true")
    got = toxicity.score(docs, model, carry=carry)
    assert [tuple(r)[:5] for r in got.collect()] == rows
    assert [r.score for r in got.collect()] == [r.score for r in toxicity.score(docs, model).collect()] == [model.score(r[1]) for r in rows]
    sent = got._jdf.queryExecution().optimizedPlan().children().apply(0).output()
    assert sent.size() == len(carry)
