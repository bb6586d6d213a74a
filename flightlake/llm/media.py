"""Media columns: signature sniffing.

An Aho-Corasick automaton over magic bytes finds every place where a medium may begin; a validator
for each format then checks its structure and gives its exact length.  That corrects declared types
(a payload is what its validated bytes say) and carves media embedded in other bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table

# Magic bytes of the formats and how far into the medium they stand.
MAGIC = [
    (b"RIFF", 0, "riff"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"OggS\x00", 0, "audio/ogg"),
    (b"fLaC\x00\x00\x00\x22", 0, "audio/flac"),
]

WAV_HEADER = 44


def wav_bytes(samples: bytes, rate: int = 8000) -> bytes:
    """One channel of unsigned 8-bit samples as a WAV file (an odd number of them is padded, as RIFF has it)."""
    n = len(samples)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + samples + b"\0" * (n % 2)


def _wav(b: bytes, at: int):
    """(type, end, payload start, payload end) of a RIFF file, with every chunk inside it."""
    if len(b) < at + 12:
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b) or end < at + 12:
        return None
    form, p, data = b[at + 8 : at + 12], at + 12, None
    kinds = set()
    while p + 8 <= end:
        kind, n = b[p : p + 4], int.from_bytes(b[p + 4 : p + 8], "little")
        if p + 8 + n > end:
            return None
        kinds.add(kind)
        if kind == b"data":
            data = (p + 8, p + 8 + n)
        p += 8 + n + n % 2
    if p != end:
        return None
    if form == b"WAVE" and b"fmt " in kinds and data:
        return "audio/wav", end, *data
    if form == b"WEBP" and kinds & {b"VP8 ", b"VP8L", b"VP8X"}:
        return "image/webp", end, at, end
    return None


def _png(b: bytes, at: int):
    p, first = at + 8, True
    while p + 12 <= len(b):
        n = int.from_bytes(b[p : p + 4], "big")
        if p + 12 + n > len(b):
            return None
        kind = b[p + 4 : p + 8]
        # the header has one length, so a false one costs a few bytes and not the rest
        if first and (kind != b"IHDR" or n != 13) or zlib.crc32(b[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return None
        first = False
        p += 12 + n
        if kind == b"IEND":
            return "image/png", p, at, p
    return None


def _gif(b: bytes, at: int):
    def blocks(p):
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1 if p < len(b) else None

    if len(b) < at + 13:
        return None
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    images = 0
    while p is not None and p < len(b):
        if b[p] == 0x3B:
            return ("image/gif", p + 1, at, p + 1) if images else None
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            p, images = blocks(p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0)), images + 1
        else:
            return None
    return None


def _jpeg(b: bytes, at: int):
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xFF:
            p += 1
            continue
        if kind == 0xD9:
            return ("image/jpeg", p + 2, at, p + 2) if frame else None
        n = int.from_bytes(b[p + 2 : p + 4], "big")
        if n < 2 or p + 2 + n > len(b):
            return None
        p += 2 + n
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        if kind == 0xDA:  # entropy-coded data runs to the next marker that is no restart or stuffing
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0 or p + 1 >= len(b):
                return None
            if b[p + 1] == 0xD9:
                return ("image/jpeg", p + 2, at, p + 2) if frame else None
    return None


#: How many documents may lie open inside one another when a cross-reference is given to the one it belongs to.
NESTED = 8
_CROSS_REFERENCE = re.compile(rb"startxref\s+(\d{1,19})\s+%%EOF")
_SECTION = re.compile(rb"\s*(?:xref|\d+ \d+ obj)")


def _pdfs(b: bytes) -> dict[int, int]:
    """{start: end} of all PDF documents: the last cross-reference that points back into a document, counted from its header, ends it.

    An update appended to a document follows its end mark with objects or a cross-reference table, and ends in a further one.
    """
    marks = [(m.start(), None) for m in re.finditer(rb"%PDF-", b)]
    if not marks:
        return {}
    marks += [(m.start(), m) for m in _CROSS_REFERENCE.finditer(b)]
    ends: dict[int, int] = {}
    heads: list[int] = []
    for at, m in sorted(marks, key=lambda x: x[0]):
        if m is None:
            heads.append(at)
            continue
        offset = int(m[1])
        for k in range(len(heads) - 1, max(-1, len(heads) - 1 - NESTED), -1):
            head = heads[k]
            # a first part of a linearised document gives 0
            if (not offset or head + offset < at and _SECTION.match(b, head + offset)) and (head not in ends or _SECTION.match(b, ends[head])):
                ends[head] = m.end()
                del heads[k + 1 :]
                break
    return ends


def _zips(b: bytes) -> dict[int, int]:
    """{start: end} of all ZIP archives: the end record tells where its directory, and so the archive, begins."""
    found: dict[int, int] = {}
    p = b.find(b"PK\x05\x06")
    while 0 <= p <= len(b) - 22:
        entries, size, start, comment = struct.unpack("<HIIH", b[p + 10 : p + 22])
        at, stop = p - size - start, p + 22 + comment
        if at >= 0 and stop <= len(b) and (b[p - size : p - size + 4] == b"PK\x01\x02" if entries else not size):
            found.setdefault(at, stop)
        p = b.find(b"PK\x05\x06", p + 4)
    return found


class _Zeros:
    """The first zero byte from a place on, for places that never fall: bytes are passed over once."""

    def __init__(self, b: bytes):
        self.b, self.at = b, -1

    def __getitem__(self, p: int) -> int:
        if self.at < p:
            at = self.b.find(0, p)
            self.at = at if at >= 0 else len(self.b)
        return self.at


def _gzip(b: bytes, at: int, zeros: _Zeros):
    """Header fields, deflated data, then the checksum and length of what they hold."""
    if len(b) < at + 18 or (flags := b[at + 3]) & 0xE0:
        return None
    p = at + 10
    if flags & 4:
        p += 2 + int.from_bytes(b[p : p + 2], "little")
    for text in (8, 16):  # name, comment
        if flags & text:
            p = zeros[p] + 1
    p += 2 if flags & 2 else 0
    d, crc, size, whole = zlib.decompressobj(-15), 0, 0, memoryview(b)
    try:
        while p < len(b) and not d.eof:  # in pieces: only length and checksum are wanted
            out, left = d.decompress(whole[p : p + 65536], 1 << 20), d.unconsumed_tail
            p += 65536
            while out or left:
                crc, size = zlib.crc32(out, crc), size + len(out)
                if d.eof or not left:
                    break
                out, left = d.decompress(left, 1 << 20), d.unconsumed_tail
    except zlib.error:
        return None
    if not d.eof:
        return None
    end = min(p, len(b)) - len(d.unused_data)
    good = b[end : end + 8] == struct.pack("<II", crc, size & 0xFFFFFFFF)
    return ("application/gzip", end + 8, at, end + 8) if good else None


class _Oggs(dict):
    """{start: end} of Ogg media, None where none begins: pages that follow one another are walked once, from the first of them that is asked for.

    The first page begins a stream, and the last page of the last open stream ends the medium.
    """

    def __init__(self, b: bytes):
        super().__init__()
        self.b = b

    def __missing__(self, at: int):
        b, pages, p = self.b, [], at
        while p + 27 <= len(b) and b[p : p + 5] == b"OggS\0":
            n = b[p + 26]
            stop = p + 27 + n + sum(b[p + 27 : p + 27 + n])
            if stop > len(b) or not pages and not b[p + 5] & 2:
                break
            pages.append((p, stop, b[p + 5], b[p + 14 : p + 18]))
            p = stop
        # from the last page back: where each stream that begins is closed together with all that begin before it is
        last: list[int | None] = [None] * len(pages)
        begin: list[int | None] = [None] * (len(pages) + 1)  # the first page from here on that begins a stream
        closing: dict[bytes, int] = {}
        for i in range(len(pages) - 1, -1, -1):
            start, _, kind, stream = pages[i]
            if kind & 4:
                closing[stream] = i
            begin[i] = i if kind & 2 else begin[i + 1]
            if kind & 2 and (j := closing.get(stream)) is not None:
                t = begin[i + 1]
                while j is not None and t is not None and t <= j:
                    inner = last[t]
                    j = None if inner is None else max(j, inner)
                    t = None if inner is None else begin[inner + 1]
                last[i] = j
            self[start] = None if last[i] is None else pages[last[i]][1]
        return self.setdefault(at, None)


def _crc_table(bits: int, polynomial: int) -> list[int]:
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1) ^ (polynomial if x >> (bits - 1) else 0)
            x &= (1 << bits) - 1
        out.append(x)
    return out


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _flac_frame(b: bytes, p: int):
    """(length of the header, samples) of a FLAC frame that begins here, its header's checksum confirmed."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8 or b[p + 3] & 1:
        return None
    size, rate = b[p + 2] >> 4, b[p + 2] & 15
    lead = b[p + 4]
    n = 1 if lead < 0x80 else next((k for k in range(2, 8) if lead >> (7 - k) & 1 == 0), 0)
    if not size or rate == 15 or not n or 0x80 <= lead < 0xC0:
        return None
    q = p + 4 + n
    more = {6: 1, 7: 2}.get(size, 0)
    samples = int.from_bytes(b[q : q + more], "big") + 1 if more else 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    q += more + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for x in b[p:q]:
        crc = _CRC8[crc ^ x]
    return (q + 1 - p, samples) if q < len(b) and b[q] == crc else None


def _flac(b: bytes, at: int):
    """Metadata blocks, then frames: each ends where its checksum holds and the next one begins, or the announced samples are complete."""
    p, last = at + 4, False
    info = b[at + 8 : at + 42]
    while not last:
        if p + 4 > len(b):
            return None
        last, n = b[p] >> 7, int.from_bytes(b[p + 1 : p + 4], "big")
        p += 4 + n
        if p > len(b):
            return None
    if len(info) < 34:
        return None
    least, most, total = int.from_bytes(info[4:7], "big"), int.from_bytes(info[7:10], "big"), int.from_bytes(info[13:18], "big") & 0xFFFFFFFFF
    done, ended = 0, False
    while not ended and (frame := _flac_frame(b, p)):
        done += frame[1]
        crc, q, likely = 0, p, 0
        first, stop = p + max(least, frame[0] + 2), min(len(b), p + most if most else len(b))
        while q < stop:
            crc = ((crc << 8) & 0xFFFF) ^ _CRC16[(crc >> 8) ^ b[q]]
            q += 1
            if not crc and q >= first:
                ended = bool(total) and done >= total
                if ended or _flac_frame(b, q):
                    break
                likely = likely or q
        else:  # without a next frame only a stream of unknown length can be complete
            if total or not likely:
                return None
            q, ended = likely, True
        p = q
    return ("audio/flac", p, at, p) if done and done >= total else None


def _listed(kind: str):
    """A validator that looks a start up in a table made once for all of the bytes."""

    def check(b: bytes, at: int, ends: dict[int, int]):
        end = ends[at] if at in ends or isinstance(ends, _Oggs) else None
        return None if end is None else (kind, end, at, end)

    return check


#: Formats whose end marks are searched once for all starts, so that many false starts cost no more than the bytes.
TABLES = {"application/pdf": _pdfs, "application/zip": _zips, "application/gzip": _Zeros, "audio/ogg": _Oggs}
VALIDATORS = {
    "riff": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "application/pdf": _listed("application/pdf"),
    "application/zip": _listed("application/zip"), "application/gzip": _gzip, "audio/ogg": _listed("audio/ogg"), "audio/flac": _flac,
}


class Sniffer:
    """The automaton over all magic bytes; bytes are searched as Latin-1 characters."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for magic, offset, kind in MAGIC:
            self.automaton.add_word(magic.decode("latin-1"), (len(magic), offset, kind))
        self.automaton.make_automaton()

    def carve(self, b: bytes) -> tuple[list[tuple[str, int, int, int, int]], int]:
        """Validated media (type, start, end, payload start, payload end) from left to right, and the number of rejected signatures.

        A medium inside another one's bytes is part of that one; the search goes on behind it.
        """
        found, rejected, free = [], 0, 0
        tables: dict = {}
        for last, (length, offset, kind) in self.automaton.iter(b.decode("latin-1")):
            at = last + 1 - length - offset
            if at < free:
                continue
            if kind in TABLES:
                if kind not in tables:
                    tables[kind] = TABLES[kind](b)
                hit = VALIDATORS[kind](b, at, tables[kind])
            else:
                hit = VALIDATORS[kind](b, at)
            if hit:
                found.append((hit[0], at, *hit[1:]))
                free = hit[1]
            else:
                rejected += 1
        return found, rejected


SNIFFED = "array<struct<type: string, start: long, end: long, sha256: string>>"


def sniff(df: DataFrame, content: str, declared: str, keys: list[str]) -> DataFrame:
    """``keys`` with (type, corrected, media, rejected) for every row's binary ``content``.

    type: that of a validated medium which fills the content, else ``declared``, else
    application/octet-stream; corrected: whether that differs from what was declared; media: every
    medium carved from the content.  Null content counts as empty (nothing found); repeated rows come out
    repeated; other columns are not read.
    """
    import pandas as pd

    cols = df.select(*keys, df[content].alias("_content"), df[declared].alias("_declared"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def run(batches):
        s = Sniffer()
        for pdf in batches:
            out = []
            for b, said in zip(pdf["_content"], pdf["_declared"]):
                b = bytes(b) if b is not None else b""
                media, rejected = s.carve(b)
                whole = next((m[0] for m in media if m[1] == 0 and m[2] == len(b)), None)
                kind = whole or said or "application/octet-stream"
                out.append((kind, kind != (said or ""), [{"type": m[0], "start": m[1], "end": m[2], "sha256": hashlib.sha256(b[m[1] : m[2]]).hexdigest()} for m in media], rejected))
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(out, columns=["type", "corrected", "media", "rejected"])], axis=1)

    return cols.mapInPandas(run, f"{schema}, type string, corrected boolean, media {SNIFFED}, rejected int")


def _little(v: str) -> str:
    """SQL: the four bytes of a length, lowest first."""
    h = f"lpad(hex(cast({v} as bigint)), 8, '0')"
    return f"unhex(concat(substr({h}, 7, 2), substr({h}, 5, 2), substr({h}, 3, 2), substr({h}, 1, 2)))"


def store_texts(df: DataFrame, doc_id: str, text: str, rate: int = 8000) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text in UTF-8, padded with zero bytes to a positive multiple of 64, as an 8-bit WAV file.

    Made of DataFrame functions alone.  A null text counts as empty.
    """
    fixed = struct.pack("<8sIHHIIHH4s", b"WAVEfmt ", 16, 1, 1, rate, rate, 1, 8, b"data").hex()
    raw = df.select(df[doc_id].cast("long").alias("doc_id"), F.coalesce(df[text], F.lit("")).cast("binary").alias("_raw"))
    raw = raw.withColumn("n_bytes", F.octet_length("_raw").cast("long"))
    raw = raw.withColumn("_n", F.expr("greatest(64, cast(ceil(n_bytes / 64) as int) * 64)"))
    media = f"concat(unhex('52494646'), {_little('_n + 36')}, unhex('{fixed}'), {_little('_n')}, rpad(_raw, _n, unhex('00')))"
    return raw.select("doc_id", "n_bytes", F.expr(media).alias("media"))


def read_back(stored: DataFrame) -> DataFrame:
    """Sniff the stored bytes of (doc_id, n_bytes, media) and read payload and features from the carved medium.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).
    The feature gives the sniffed type and payload bounds, what the same search finds inside the payload (types of
    carved media with their bounds, and the number of rejected signatures), and the mean (in thousandths) and peak of
    the samples.  Null text counts as empty (a payload of 64 zero bytes);
    equal texts give equal rows; repeated rows come out repeated; a null doc_id stays null.  A stored
    medium that is not carved whole is an error.
    """
    import pandas as pd

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        import numpy as np

        s = Sniffer()
        for pdf in batches:
            out = []
            for b in pdf["media"]:
                media, _ = s.carve(b)
                kind, start, end, first, last = media[0]
                if (start, end) != (0, len(b)):
                    raise ValueError("a stored medium was not carved whole")
                payload = b[first:last]
                inside, rejected = s.carve(payload)
                held = ",".join(f"{m[0]}:{m[1]}+{m[2] - m[1]}" for m in inside)
                x = np.frombuffer(payload, np.uint8)
                feature = f"{kind}:{first}+{last - first};inside={held};rejected={rejected};mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};peak={int(x.max())}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(b), hashlib.sha256(b).hexdigest(), feature))
            out = pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            out.insert(0, "doc_id", pdf["doc_id"].array)
            out.insert(1, "n_bytes", pdf["n_bytes"].array)
            yield out

    return stored.mapInPandas(run, schema)


def op1_media_sniffing(spark, sf_dir) -> DataFrame:
    return read_back(store_texts(table(spark, sf_dir, "documents"), "doc_id", "text"))


#: Texts whose payload holds no whole medium, as those of the given tables: every signature inside is a rejected one.
OP1_SQL = """
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [0,0,0,0,0,0,0,0]::BIGINT[]),
           lambda a, x: CASE WHEN a % 2 = 1 THEN xor(3988292384::BIGINT, a // 2) ELSE a // 2 END) AS c
    FROM range(256) r(i))
), raw AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n FROM documents),
sized AS (SELECT *, greatest(64, ((n + 63) // 64) * 64) AS m FROM raw),
hexed AS (SELECT *, hex(encode(text)) || repeat('00', (m - n)::INTEGER) AS h FROM sized),
bytes AS (SELECT *, list_transform(range(m), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b,
  list_transform([m + 36, m], lambda v: array_to_string(list_transform(range(4), lambda i: lpad(hex((v >> (8 * i)) & 255), 2, '0')), '')) AS le FROM hexed),
stored AS (SELECT *, '52494646' || le[1] || '57415645666D7420' || '10000000' || '01000100' || '401F0000' || '401F0000' || '01000800' || '64617461' || le[2] || h AS w FROM bytes)
SELECT doc_id, n::BIGINT AS n_bytes, m::BIGINT AS payload_bytes, sha256(unhex(h)) AS payload_sha256,
  xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b[m - 63:m]), lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1]))) AS tail_crc32,
  (m + 44)::BIGINT AS media_bytes, sha256(unhex(w)) AS media_sha256,
  'audio/wav:44+' || m || ';inside=;rejected=' || list_sum(list_transform(['RIFF', 'GIF87a', 'GIF89a', '%PDF-', 'PK' || chr(3) || chr(4)], lambda x: (length(text) - length(replace(text, x, ''))) // length(x)))::BIGINT
    || ';mean=' || (list_sum(b)::BIGINT * 1000 // m) || ';peak=' || list_max(b) AS feature
FROM stored CROSS JOIN crc_table
"""
