"""Media, archives, chats, URL filters, shards and the pipeline."""

import base64
import gzip
import hashlib
import io
import random
import zipfile
import zlib

import pytest
from oracle import same
from pyspark.sql import functions as F

from flightlake.llm import chat, media, registry, sharding, urls, warc

# ---- media -----------------------------------------------------------------------------------------


def png(width=2):
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes([0, 0, 0, width, 0, 0, 0, 1, 8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(b"\0" * (width + 1))) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x03x\xff\xda\0\x03xab\xff\0cd\xff\xd9"


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "b" * 100)
    return out.getvalue()


def flac(frames=3, total=None):
    """Frames of 192 samples, eight bits, one channel, each sample as it is."""

    def crc(data, table, bits):
        x = 0
        for v in data:
            x = ((x << 8) & ((1 << bits) - 1)) ^ table[(x >> (bits - 8)) ^ v]
        return x.to_bytes(bits // 8, "big")

    rng, out = random.Random(1), b""
    for k in range(frames):
        head = bytes([0xFF, 0xF8, 0x19, 0x02, k])  # 192 samples at 44.1 kHz
        head += crc(head, media._CRC8, 8)
        body = head + b"\x02" + rng.randbytes(192)
        out += body + crc(body, media._CRC16, 16)
    total = 192 * frames if total is None else total
    info = (192).to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | 7 << 36 | total).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80\0\0\x22".replace(b"\x80", b"\0") + info + b"\x81\0\0\x02ab" + out


def ogg(streams=(1,), pages=3):
    page = lambda kind, stream, body: b"OggS\0" + bytes([kind]) + bytes(8) + stream.to_bytes(4, "little") + bytes(8) + bytes([1, len(body)]) + body
    return b"".join(page(2 if k == 0 else 4 if k == pages - 1 else 0, s, b"x" * (k + 3)) for k in range(pages) for s in streams)


def webp(body=b"abcde"):
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def pdf(updates=0, inner=b""):
    """A document with a cross-reference table, as often updated; ``inner`` is kept as it is in its first part."""
    out = b"%PDF-1.4\n1 0 obj\n" + inner + b"\nendobj\n"
    for _ in range(updates + 1):
        at = len(out)
        out += b"xref\n0 1\ntrailer\nstartxref\n%d\n%%%%EOF" % at
        out += b"\n" if _ < updates else b""
    return out


SAMPLES = {"audio/flac": flac(), "audio/ogg": ogg((1, 2)), "image/webp": webp(), "image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "application/zip": archive(), "application/gzip": gzip.compress(b"hello" * 50), "audio/wav": media.wav_bytes(b"abc"), "application/pdf": pdf()}


@pytest.mark.parametrize("kind", sorted(SAMPLES))
def test_carving(kind):
    s, body = media.Sniffer(), SAMPLES[kind]
    found, _ = s.carve(b"some text " + body + b" more text")
    assert [(m[0], m[1], m[2]) for m in found] == [(kind, 10, 10 + len(body))]
    broken = body[: len(body) // 2]
    assert not s.carve(b"x" + broken)[0]


def stored(inner: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("inner.zip", inner)
        z.writestr("more", "x" * 50)
    return out.getvalue()


def test_lengths_of_nested_and_updated_media():
    s = media.Sniffer()
    whole = lambda b: [(m[0], m[1], m[2]) for m in s.carve(b)[0]]
    for n in range(4):
        assert whole(b"x" + pdf(n) + b" tail") == [("application/pdf", 1, 1 + len(pdf(n)))]
    assert whole(pdf() + b"\n" + pdf()) == [("application/pdf", 0, len(pdf())), ("application/pdf", len(pdf()) + 1, 2 * len(pdf()) + 1)]
    assert whole(pdf(1, pdf(1))) == [("application/pdf", 0, len(pdf(1, pdf(1))))]
    assert whole(b"a %PDF- header is not " + pdf()) == [("application/pdf", 22, 22 + len(pdf()))]
    nested = stored(stored(archive()))
    assert whole(b"ab" + nested + GIF) == [("application/zip", 2, 2 + len(nested)), ("image/gif", 2 + len(nested), 2 + len(nested) + len(GIF))]
    for sound in (flac(), flac(1), flac(5), flac(2, 0), ogg(), webp(b"ab")):
        got = whole(b"x" + sound + GIF)
        assert [m[1:] for m in got] == [(1, 1 + len(sound)), (1 + len(sound), 1 + len(sound) + len(GIF))]
    assert whole(flac(3, 192 * 4)) == []  # a frame is missing


@pytest.mark.parametrize("mark", [m[0] for m in media.MAGIC])
def test_false_signatures_cost_no_more_than_their_bytes(mark):
    import time

    s, took = media.Sniffer(), []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        s.carve(mark * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.2


def ogg_page(kind, stream, body=b"x"):
    return b"OggS\0" + bytes([kind]) + bytes(8) + stream.to_bytes(4, "little") + bytes(8) + b"\x01" + bytes([len(body)]) + body


def one_ogg(b, at):
    """The end of the medium that begins here, page by page."""
    p, streams = at, set()
    while p + 27 <= len(b) and b[p : p + 5] == b"OggS\0":
        n, kind, stream = b[p + 26], b[p + 5], b[p + 14 : p + 18]
        stop = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if stop > len(b) or (p == at and not kind & 2):
            return None
        streams |= {stream} if kind & 2 else set()
        p = stop
        if kind & 4:
            streams.discard(stream)
            if not streams:
                return p
    return None


def test_ogg_media_equal_a_walk_from_every_page():
    rng = random.Random(12)
    for _ in range(300):
        b = b"".join(ogg_page(rng.choice([0, 2, 2, 4, 4, 6]), rng.randrange(3), bytes(rng.randrange(4))) + rng.choice([b""] * 9 + [b"-"]) for _ in range(rng.randrange(1, 16)))
        b = b[: len(b) - rng.choice([0, 0, 1, 9])]
        ends = media._Oggs(b)
        at = b.find(b"OggS")
        while at >= 0:
            assert ends[at] == one_ogg(b, at), (b, at)
            at = b.find(b"OggS", at + 1)


@pytest.mark.parametrize(
    "part", [ogg_page(2, 1), ogg_page(2, 1) + ogg_page(0, 1), b"\x89PNG\r\n\x1a\n" + (200_000).to_bytes(4, "big") + b"IHDR" + bytes(30), b"".join(ogg_page(2, k) for k in range(40))]
)
def test_chains_of_false_media_take_linear_time(part):
    import time

    s, took = media.Sniffer(), []
    for n in (400_000, 1_600_000):
        b = part * (n // len(part))
        began = time.perf_counter()
        s.carve(b)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.2


def test_types_are_corrected(spark):
    rows = [(1, png(), "image/jpeg", "x"), (2, b"GIF89a is only text", "text/plain", "x"), (3, None, None, "x"), (4, png() + GIF, "image/png", "x"), (4, png() + GIF, "image/png", "x")]
    df = spark.createDataFrame(rows, "id long, content binary, declared string, type string")
    got = media.sniff(df, "content", "declared", ["id"]).collect()
    by = {r.id: r for r in got}
    assert len(got) == 5 and (by[1].type, by[1].corrected) == ("image/png", True) and (by[2].type, by[2].corrected, by[2].rejected) == ("text/plain", False, 1)
    assert by[3].type == "application/octet-stream" and [m.type for m in by[4].media] == ["image/png", "image/gif"]
    assert media.sniff(df.limit(0), "content", "declared", ["id"]).count() == 0


def test_stored_texts_come_back(spark):
    texts = [None, "", "é" * 32, "x" * 64, "x" * 65, "RIFF GIF89a %PDF- PK\x03\x04" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "x")], "doc_id long, text string").withColumn("media", F.lit("clash"))
    stored = media.store_texts(df, "doc_id", "text")
    got = {r.doc_id: r for r in media.read_back(stored).collect()}
    for r in stored.collect():
        raw = ("x" if r.doc_id is None else texts[r.doc_id] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        g = got[r.doc_id]
        assert bytes(r.media) == media.wav_bytes(payload) and g.media_sha256 == hashlib.sha256(media.wav_bytes(payload)).hexdigest()
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[5].feature.split(";")[1:3] == ["inside=", "rejected=12000"]
    assert media.read_back(media.store_texts(df.limit(0), "doc_id", "text")).count() == 0
    # what is stored can hold media itself: they are found inside the payload
    inner = spark.createDataFrame([(1, len(GIF), bytearray(media.wav_bytes(b"ab" + GIF + png())))], "doc_id long, n_bytes long, media binary")
    assert media.read_back(inner).first().feature.split(";")[1] == f"inside=image/gif:2+{len(GIF)},image/png:{2 + len(GIF)}+{len(png())}"


# ---- archives --------------------------------------------------------------------------------------


def test_loser_tree():
    rng = random.Random(1)
    for k in range(0, 9):
        slices = [sorted((rng.randrange(20), (j, i)) for i in range(rng.randrange(6))) for j in range(k)]
        assert [x[1] for x in sorted((key, j, v) for j, s in enumerate(slices) for key, v in s)] == [j for j, _ in warc.LoserTree(slices)]


def test_url_keys(spark):
    df = spark.createDataFrame([("HTTP://www.Example.com:80/A?b=C#d",), ("https://m.example.net",), (None,), ("nonsense",)], "u string")
    assert [r[0] for r in df.select(warc.url_key(F.col("u"))).collect()] == ["com,example)/a?b=c", "net,example,m)/", ")/", "nonsense)/"]


def test_history(spark):
    rng = random.Random(2)
    rows = [(i, f"http://{rng.choice('abc')}.org/{rng.randrange(4)}", rng.choice(["same", "same\r\n\r\nWARC/1.1\r\n\r\n", f"own {i}", "", None])) for i in range(300)]
    rows += [(None, None, "same"), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    stamp = F.timestamp_seconds(F.lit(1704067200) + F.coalesce("page_id", F.lit(0)) % 50)
    path = warc.scratch(spark, "warc")
    warc.write_archives(warc.mark_revisits(df).repartition(3), path, stamp, archive_bytes=8000)
    runs = warc.read_runs(spark, path)
    got = warc.merge_runs(runs, range_rows=64).collect()
    assert len(got) == len(rows) and len({r.range for r in got}) > 3 and len({r.archive for r in got}) > 3
    assert {r.run for r in runs.collect()} < {r.archive for r in got}  # a run holds several archives
    for f in spark.read.format("binaryFile").load(path).collect():
        content = bytes(f.content)
        mine = sorted((r.record_offset, r.record_length) for r in got if f.path.endswith(r.archive))
        # closed at the first record past the limit; any gzip reader reads it, and each record by its offset
        assert len(content) < 8000 + 1000 and gzip.decompress(content).count(b"WARC-Record-ID") == len(mine)
        for at, length in mine:
            assert warc.parsed(gzip.decompress(content[at : at + length]))[0]["WARC-Type"] in ("response", "revisit")
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    text = {r[0]: r[2] or "" for r in rows}
    for r in got:
        body = text[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        head = first[text[r.page_id]]
        assert (r.record_type, r.refers_to) == (("response", None) if head == r.page_id else ("revisit", head))
    order = [(r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in sorted(got, key=lambda r: (r.range, r.place))]
    assert order == sorted(order)
    assert warc.capture_history(df.limit(0), stamp).count() == 0


# ---- chats -----------------------------------------------------------------------------------------


def test_best_paths(spark):
    rng = random.Random(3)
    rows = []
    for tree in range(12):
        base = tree * 100
        rows.append((base, None, rng.random()))
        rows += [(base + i, base + rng.randrange(i), rng.random()) for i in range(1, rng.randint(2, 30))]
    chain = [(5000 + i, 5000 + i - 1 if i else None, 1.0) for i in range(130)]
    rows += [*chain, (9000, 777777, 0.5), (9100, 9101, 1.0), (9101, 9100, 1.0), (9000, 777777, 0.5)]
    parent, score = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    kids = set(parent.values())

    def up(x):
        out = [x]
        while parent[x] is not None and parent[x] in parent and len(out) < 500:
            x = parent[x]
            out.append(x)
        return out[::-1]

    want = {}
    for leaf in (i for i in parent if i not in kids):
        p = up(leaf)
        key = (-sum(score[i] for i in p), leaf)
        if p[0] not in want or key < want[p[0]][0]:
            want[p[0]] = (key, p)
    df = spark.createDataFrame(rows, "id long, parent long, score double")
    got = {}
    for r in chat.reply_paths(df).orderBy("tree", "place").collect():
        got.setdefault(r.tree, []).append(r.id)
    assert got == {t: p for t, (_, p) in want.items()}
    two = chat.reply_paths(df, per_tree=2).select("tree", "rank").distinct().groupBy("tree").count().collect()
    assert max(r["count"] for r in two) == 2
    assert chat.reply_paths(df.limit(0)).count() == 0


def test_control_strings_survive(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "<\\|x <|| <\\\\|", "", None, "plain < text |>"]
    rows = [(i + 1, i or None, 1.0, "assistant" if i % 2 else "user<|im_end|>", t) for i, t in enumerate(said)]
    df = spark.createDataFrame(rows, "id long, parent long, score double, role string, text string")
    one = chat.format_paths(chat.reply_paths(df), df).first()
    assert chat.read_turns(one.formatted) == [(r[3], r[4] or "") for r in rows]
    loss = [chat.unescape_text(one.formatted[s.start : s.end]) for s in one.spans]
    assert loss == [t or "" for i, t in enumerate(said) if i % 2]
    assert one.formatted.count(chat.START) == len(rows)


def expected_chats(rows):
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256) by brute force, the added conversation with them."""
    last = lambda x: (x is not None, x if x is not None else 0)  # noqa: E731  nulls first
    word = lambda x: (x is not None, x or "")
    said = chat.STOP + chat.START + "assistant ok"
    threads = {}
    for conv, turn, role, text in rows:
        threads.setdefault((False, conv), []).append((turn, role, text))
    threads[True, -1] = [(0, "user", said), (1, "assistant", said)]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = []
    for (_, conv), turns in threads.items():
        turns = [(r or "", t or "") for _, r, t in sorted(turns, key=lambda x: (last(x[0]), word(x[1]), word(x[2])))]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss)))
    return sorted(out, key=str)


def test_conversations_come_back(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = chat.op5_chat_format(spark, sf).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected_chats(rows)


def test_odd_conversations_come_back(spark, tmp_path):
    """Ids at the ends of their range, null and -1; null, equal and negative turns; roles with line feeds; a very long text; extra columns."""
    ids = [2**40, 2**63 - 1, -(2**63), None, -1, 0]
    rows = [(i, t, ("user", "assistant")[t % 2], f"{i} said {t}") for i in ids for t in range(3)]
    rows += [(0, None, "assistant", None), (0, -5, None, "<|im_end|>"), (5, 1, "assistant", "b"), (5, 1, "assistant", "a"), (5, 1, "assistant", "a"), (6, 0, "user\nx<|lf|>", "long " * 50_000), (None, None, None, None)]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([(*r, 1, True) for r in rows], schema + ", n int, added boolean").write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op5_chat_format(spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected_chats(rows)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [tuple(r)[:5] for r in chat.op5_chat_format(spark, f"{tmp_path}/none").collect()] == expected_chats([])


def test_a_very_long_thread_comes_back(spark, tmp_path):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(100_000)] + [(2, 0, "assistant", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op5_chat_format(spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected_chats(rows)


# ---- URLs ------------------------------------------------------------------------------------------


def test_rules_and_parts(spark):
    cases = [("https://A.Example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"), ("http://x.net", "x.net", "", None, None), ("http://x.net/a#b", "x.net", "/a", "net/", "block"), ("http://de.example.com/de/", "de.example.com", "/de/", "example.com/de/", "block"), ("http://notexample.com/de/", "notexample.com", "/de/", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("http://a.org/fr/x://y", "a.org", "/fr/x://y", "org/fr/", "allow")]
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)] + [(0, cases[0][0], "clash")], "page_id long, url string, verdict string")
    got = urls.judge(df, "page_id").collect()
    assert len(got) == len(cases) + 1
    for r in got:
        _, host, path, rule, verdict = cases[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert urls.judge(df.limit(0), "page_id").count() == 0


def test_trees_learn_labelled_urls(spark):
    rng = random.Random(4)
    good = [f"https://site{rng.randrange(50)}.example.com/page/{rng.choice('abcdef')}" for _ in range(300)]
    bad = [f"http://x{rng.randrange(10**9)}-cheap.example.biz/{rng.randrange(10**6)}?a={rng.randrange(10**6)}&b=1&c=2" for _ in range(300)]
    labelled = spark.createDataFrame([(u, 0) for u in good[:200]] + [(u, 1) for u in bad[:200]], "url string, blocked int")
    test = spark.createDataFrame([(i, u) for i, u in enumerate(good[200:] + bad[200:])], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(test, "page_id", labelled=labelled).collect()}
    assert sum(got[i] == ("allow" if i < 100 else "block") for i in got) >= 195


def test_features_equal_brute_force(spark):
    import math
    from collections import Counter

    rng = random.Random(7)
    cases = ["", None, "http://", "nonsense?a=1", "HTTP://A-b.c1.Example.com:80/x//y-z/?a=1&&b#f?g=1", "x://é.ö/ü?ß", "http://" + "long-label1." * 3000 + "com/" + "p/" * 5000]
    cases += ["".join(rng.choice("ab1./?&=#-:é") for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["http://" + "".join(rng.choice("ab1./?&=#-") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(cases)), "i long, url string")
    host, path = urls.host_and_path(F.col("url"))
    got = {r.i: r for r in urls.lexical(df.withColumns({"host": host, "path": path})).collect()}
    share = lambda s: sum(c in "0123456789" for c in s) / max(1, len(s))
    for i, raw in enumerate(cases):
        u = raw or ""
        at = u.find("://")
        rest = u[at + 3 :] if at >= 0 else ""
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))] if at >= 0 else ""
        before = u.split("#", 1)[0]
        query = before.split("?", 1)[1] if "?" in before else ""
        labels = host.split(".")
        r = got[i]
        assert (r.host, r.path) == (host, path)
        assert (r.length, r.host_length, r.depth, r.labels) == (len(u), len(host), len([x for x in path.split("/") if x]), len(labels))
        assert (r.params, r.hyphens, r.longest_label) == (len([x for x in query.split("&") if x]), u.count("-"), max(map(len, labels)))
        assert abs(r.digit_ratio - share(u)) < 1e-12 and abs(r.host_digit_ratio - share(host)) < 1e-12
        assert abs(r.entropy - sum(-n / len(u) * math.log2(n / len(u)) for n in Counter(u).values())) < 1e-9
        assert r.suffix == ".".join(labels[-2:])


def test_verdicts_on_held_out_urls(spark):
    """Trees fitted on the rules' verdicts of four fifths of the given pages, held against the rules on the last fifth (not asked there).

    Those rules name paths by language, of which the lexical features say little: the trees must do better than the larger class.
    """
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    host, path = urls.host_and_path(F.col("url"))
    ruled = pages.withColumn("r", urls.rule_for(host, path)["verdict"]).where("r IS NOT NULL")
    train, test = ruled.where("pmod(xxhash64(url), 5) <> 0"), ruled.where("pmod(xxhash64(url), 5) = 0")
    got = urls.judge(test.select("page_id", "url"), "page_id", rules=[("nowhere.invalid", "/", "block")], labelled=train.select("url", (F.col("r") == "block").cast("int").alias("blocked")))
    both = got.join(test.select("page_id", "r"), "page_id").select("verdict", "r").collect()
    larger = max(sum(x.r == v for x in both) for v in ("allow", "block"))
    assert len(both) > 50 and sum(x.verdict == x.r for x in both) > larger


def test_entropy(spark):
    df = spark.createDataFrame([("aabb",), ("",), ("abcd",)], "s string")
    assert [round(r[0], 6) for r in df.select(urls.entropy(F.col("s"))).collect()] == [1.0, 0.0, 2.0]


# ---- shards ----------------------------------------------------------------------------------------


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 8, 100, 3000])
def test_jump(spark, n):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *[random.Random(n).getrandbits(63) for _ in range(200)]]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_shards(F.col("k"), n).alias("s")).collect()
    assert all((r.s.shard, r.s.grown) == (jump(r.k, n), jump(r.k, n + 1)) for r in got)


def test_shard_rows(spark):
    df = spark.createDataFrame([(i % 90, "é" * i if i % 7 else None, 5) for i in range(200)] + [(None, "x", 5)], "doc_id long, text string, shard int")
    got = sharding.shard(df, "doc_id", "text", 8).collect()
    assert len(got) == 201
    for s in {r.shard for r in got}:
        slots = sorted((r.slot, -1 if r.doc_id is None else r.doc_id) for r in got if r.shard == s)
        assert [x[0] for x in slots] == list(range(len(slots))) and [x[1] for x in slots] == sorted(x[1] for x in slots)
    assert all(r.grown_shard in (r.shard, 8) for r in got) and {r.size for r in got if r.doc_id is None} == {2}
    assert sharding.shard(df.limit(0), "doc_id", "text", 8).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    where = "/root/testdata/sf0.01"
    same(registry.QUERIES[name](spark, where), registry.ORACLE_SQL[name], where)


# ---- components ------------------------------------------------------------------------------------


def test_components(spark):
    from flightlake.llm import _common

    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 500) if i % 50] + [(rng.randrange(1000, 2000), rng.randrange(1000, 2000)) for _ in range(700)] + [(3000, i) for i in range(3001, 3300)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in _common.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


# ---- pipeline --------------------------------------------------------------------------------------


def test_pipeline_on_odd_rows(spark, tmp_path, sf):
    """Null and repeated ids, rows that are equal, null and empty and very long texts, columns beyond those of documents: each row by its own text."""
    import corpus_pipeline

    long = " ".join(f"w{i % 9973}x{i}" for i in range(60_000))
    one, two, three = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    rows = [(1, one), (1, one), (1, two), (None, three), (None, None), (None, three + " "), (7, three), (8, ""), (9, None), (10, long), (11, long + " end"), (12, "one word"), (None, "lonely text")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra", 1.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string, score double")
    docs = docs.withColumn("n_chars", F.col("n_chars").cast(dict(spark.read.parquet(f"{sf}/documents.parquet").dtypes)["n_chars"]))
    where = str(tmp_path / "odd")
    docs.write.parquet(f"{where}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{where}/{t}.parquet")
    near = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, where)
    assert near.columns == corpus_pipeline.COLUMNS
    got = sorted(((r.doc_id, r.text) for r in near.collect()), key=str)
    assert got == sorted([(1, one), (1, two), (7, three), (8, ""), (10, long), (12, "one word"), (None, "lonely text")], key=str)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, where).count() == (7 if name == "near_duplicates" else len(rows)), name
    assert corpus_pipeline.run(spark, where).count() == 7


def test_pipeline_on_planted_rows(spark, tmp_path, sf):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").limit(2).collect()]
    rng = random.Random(6)
    words = [f"planted{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(250)]
    near = list(base)
    near[100] = "changed"
    rude = " ".join(rng.choice(["idiot", "moron", "stupid", "trash", "loser", rng.choice(words)]) for _ in range(80))
    clean = " ".join(rng.choice(words) for _ in range(120))
    rows = [(900001, " ".join(base)), (900002, " ".join(base)), (900003, " ".join(near)), (900004, rude), (900005, "so " + bench[0] + " and on"), (900006, clean), (900007, None), (900008, "")]
    planted = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    where = str(tmp_path / "in")
    docs.unionByName(planted).write.parquet(f"{where}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").write.parquet(f"{where}/{t}.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, where).collect() if r.doc_id >= 900000}
    assert kept == {900001, 900006, 900007}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), where).columns == corpus_pipeline.COLUMNS, name
