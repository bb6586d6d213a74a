"""Alignment of two tokenizers, and corpus-wide counts of linked id pairs by external spill counting.

Both tokenizers cut the same bytes.  Offsets where tokens of both end cut a text into groups; every token
of the one side is linked to every token of the other in its group.  A task that encodes texts closes a run
after a number of characters: its pair-document records, sorted by first id and second id, are dealt by
the first id's residue (the radix) into parts, each a zstd block of distinct pairs with their number of
documents, beside a block of postings.  Only the blocks of pairs are merged.  A k-way heap merge walks the
parts of one radix first id by first id, so that all pairs of an id are counted before the next id begins:
its maximum is known there, and each pair's count streams back to the runs it came from.  At most FAN_IN
parts meet in a task; more are merged in levels, up to the totals and down again.  Frequent ids are no hot
keys: within a run each pair is counted already, and an id has no more partners than the other
vocabulary has ids.  Postings meet their totals run by run.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, table
from .bpe import PATTERN, byte_alphabet, read_vocabulary

#: Parts that each run's records are dealt into, by first id.
RADIX = 64
#: Parts that one merge takes, about.
FAN_IN = 32
#: Characters and rows after which a run is closed; a longer text is a run of its own.
RUN_CHARS = 4_000_000
RUN_ROWS = 50_000
#: Words a worker remembers, and their most characters; neither changes a result.
MEMO_WORDS = 300_000
MEMO_CHARS = 48
#: Bits of an id in the key of a pair.
ID_BITS = 17
#: Groups with more links than this are taken as distinct ids with counts.
WIDE_GROUP = 4096

_ODD = re.compile(r"^ |\s |\s$")


def segments(text: str) -> list[str]:
    """Cuts of a space and ``text``, each without its first space, at places that neither tokenizer's tokens cross.

    These are before every space that follows no white space, unless nothing but white space is left.
    """
    parts = text.split(" ")
    if not _ODD.search(text):
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        if out[-1] and not out[-1][-1].isspace():
            out.append(p)
        else:
            out[-1] += " " + p
    if len(out) > 1 and not out[-1].strip():
        last = out.pop()
        out[-1] += " " + last
    return out


class Pair:
    """A byte-level BPE file (A) and a sentencepiece model (B): ids of texts, bytes of ids."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        import json
        import os

        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        alphabet = byte_alphabet()
        model = json.loads(byte_level)["model"]
        vocab = model["vocab"]
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for word, i in vocab.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in word) if all(c in alphabet for c in word) else word.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << ID_BITS:
            raise ValueError(f"ids take more than {ID_BITS} bits")
        self.size_a = np.array([*map(len, self.bytes_a)], np.int64)
        self.size_b = np.array([*map(len, self.bytes_b)], np.int64)
        # what the group texts are joined of: an id before a comma, and before the mark that ends its side of a group
        self.texts = np.array([f"{i}{m}" for m in ",|;" for i in range(1 << ID_BITS)], object)
        self.fast = self._by_ranks(model)
        # texts may be cut at spaces only if no piece holds a space after something else and the model leaves spaces as they are
        self.cut = not any(re.search("[^▁]▁", p) for p in names) and self.b.normalize("a  b ") == "▁a▁▁b▁"
        self.memo: dict[str, tuple[bytes, bytes] | None] = {}

    def _by_ranks(self, model: dict):
        """The same vocabulary in the form of ranks, which takes less time a word, if the file's ids are in the order of its merges."""
        import tiktoken

        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or sorted(map(len, self.bytes_a[:256])) != [1] * 256:
            return None
        ranks = {x: i for i, x in enumerate(self.bytes_a[: 256 + len(merges)])}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, words: list[str]) -> list[tuple[bytes, bytes] | None]:
        if self.fast:
            xs = [self.fast.encode_ordinary(" " + w) for w in words]
        else:
            xs = [e.ids for e in self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
        ys = self.b.encode(words, num_threads=1)
        out = list(zip(_packed(xs), _packed(ys)))
        raw = "".join([" " + w for w in words]).encode()
        flat = (b"".join(map(of.__getitem__, chain.from_iterable(ids))) for of, ids in ((self.bytes_a, xs), (self.bytes_b, ys)))
        if any(x != raw for x in flat):  # some word is not kept: find which
            for i, (w, x, y) in enumerate(zip(words, xs, ys)):
                if not b"".join(map(self.bytes_a.__getitem__, x)) == f" {w}".encode() == b"".join(map(self.bytes_b.__getitem__, y)):
                    out[i] = None
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of both sides for each text as little-endian 32-bit integers; empty where a text has no tokens."""
        cuts = [(segments(t) if self.cut else [t]) if t else [] for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        miss = list(set().union(*cuts) - memo.keys())
        memo.update(zip(miss, self._encode(miss)))
        out = []
        for words in cuts:
            found = [*map(memo.__getitem__, words)]
            xs, ys = zip(*found) if found and None not in found else ((), ())
            out.append((b"".join(xs), b"".join(ys)))
        for w in miss:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return out


def _packed(lists: list[list[int]]) -> list[bytes]:
    """Each list as little-endian 32-bit integers."""
    import numpy as np

    ends = (4 * np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))).tolist()
    raw = np.fromiter(chain.from_iterable(lists), "<u4").tobytes()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _loaded(byte_level: bytes, pieces: bytes) -> Pair:
    """One pair of tokenizers for each worker process and pair of files."""
    kept = sys.modules[__name__].__dict__.setdefault("_pairs", {})
    key = hashlib.sha1(hashlib.sha1(byte_level).digest() + pieces).digest()
    if key not in kept:
        kept[key] = Pair(byte_level, pieces)
    return kept[key]


def _spans(starts, sizes):
    """The integers start, start + 1, ... of every span, one after the other."""
    import numpy as np

    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Groups:
    """Groups and links of texts that were encoded together; all arrays run over the texts in order."""

    def __init__(self, pair: Pair, encoded: list[tuple[bytes, bytes]]):
        import numpy as np

        self.pair, n = pair, len(encoded)
        self.a = np.frombuffer(b"".join(x for x, _ in encoded), "<u4").astype(np.int64)
        self.b = np.frombuffer(b"".join(y for _, y in encoded), "<u4").astype(np.int64)
        self.n_a = np.array([len(x) // 4 for x, _ in encoded], np.int64)
        self.n_b = np.array([len(y) // 4 for _, y in encoded], np.int64)
        # both sides hold the same bytes, so ends counted over all texts agree at the ends of texts too
        ends_a, ends_b = np.cumsum(pair.size_a[self.a]), np.cumsum(pair.size_b[self.b])
        both = np.zeros(1 + (int(ends_a[-1]) if len(ends_a) else 0), np.uint8)
        both[ends_a] = 1
        both[ends_b] += 1
        last_a, last_b = np.flatnonzero(both[ends_a] == 2), np.flatnonzero(both[ends_b] == 2)
        self.in_a, self.in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        self.from_a, self.from_b = last_a + 1 - self.in_a, last_b + 1 - self.in_b
        self.doc = np.repeat(np.arange(n), self.n_a)[last_a]
        self.n_groups = np.bincount(self.doc, minlength=n).astype(np.int64)
        self.links = self.in_a * self.in_b
        self.n_links = np.zeros(n, np.int64)
        np.add.at(self.n_links, self.doc, self.links)

    def texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        import numpy as np

        size = 1 << ID_BITS
        side_a, side_b = self.a.copy(), self.b.copy()
        side_a[self.from_a + self.in_a - 1] += size
        side_b[self.from_b + self.in_b - 1] += 2 * size
        total = len(side_a) + len(side_b)
        # a group's ids of A stand after all earlier ids of both sides
        merged, at = np.empty(total, np.int64), np.cumsum(self.in_a + self.in_b) - (self.in_a + self.in_b)
        merged[_spans(at, self.in_a)] = side_a
        merged[_spans(at + self.in_a, self.in_b)] = side_b
        pieces = self.pair.texts[merged].tolist()
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(pieces[x:y])[:-1] for x, y in zip([0, *ends], ends)]

    def records(self):
        """(pair, document, times) sorted by pair and document; a pair is the first id, then ID_BITS of the second."""
        import numpy as np

        plain = np.flatnonzero(self.links <= WIDE_GROUP)
        times_b = np.repeat(self.in_b[plain], self.in_a[plain])
        a = np.repeat(self.a[_spans(self.from_a[plain], self.in_a[plain])], times_b)
        b = self.b[_spans(np.repeat(self.from_b[plain], self.in_a[plain]), times_b)]
        doc = np.repeat(self.doc[plain], self.links[plain])
        keys = [(((a << ID_BITS) | b) << 24) | doc]
        weights = [np.ones(len(a), np.int64)]
        for g in np.flatnonzero(self.links > WIDE_GROUP):
            x, nx = np.unique(self.a[self.from_a[g] : self.from_a[g] + self.in_a[g]], return_counts=True)
            y, ny = np.unique(self.b[self.from_b[g] : self.from_b[g] + self.in_b[g]], return_counts=True)
            keys.append(((((x[:, None] << ID_BITS) | y).ravel()) << 24) | self.doc[g])
            weights.append((nx[:, None] * ny).ravel())
        if len(keys) == 1:
            key, times = np.unique(keys[0], return_counts=True)
        else:
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            times = np.zeros(len(key), np.int64)
            np.add.at(times, inverse, np.concatenate(weights))
        return key >> 24, key & ((1 << 24) - 1), times


def _pack(*columns) -> bytes:
    """Integer columns of equal length as one zstd block; the first is stored as differences."""
    import numpy as np
    import zstandard

    raw = b"".join(np.asarray(c, "<i8").tobytes() for c in (np.diff(columns[0], prepend=0), *columns[1:]))
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(block: bytes, columns: int):
    import numpy as np
    import zstandard

    out = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), "<i8").reshape(columns, -1)
    return [np.cumsum(out[0]), *out[1:]]


def merge(runs: list):
    """k-way heap merge of runs (pairs, documents), each sorted by pair, in the order of the first ids.

    Yields for every first id the pairs, their counts over all runs, and the slices [(run, start, stop, places of its pairs)].
    """
    import numpy as np

    heads = []
    for pairs, _ in runs:
        first, at = np.unique(pairs >> ID_BITS, return_index=True)
        heads.append((first.tolist(), [*at.tolist(), len(pairs)]))
    heap = [(h[0][0], k, 0) for k, h in enumerate(heads) if h[0]]
    heapq.heapify(heap)
    while heap:
        first, slices = heap[0][0], []
        while heap and heap[0][0] == first:
            _, k, i = heap[0]
            ids, at = heads[k]
            slices.append((k, at[i], at[i + 1]))
            if i + 1 < len(ids):
                heapq.heapreplace(heap, (ids[i + 1], k, i + 1))
            else:
                heapq.heappop(heap)
        if len(slices) == 1:
            k, x, y = slices[0]
            yield runs[k][0][x:y], runs[k][1][x:y], [(k, x, y, slice(None))]
            continue
        pairs, places = np.unique(np.concatenate([runs[k][0][x:y] for k, x, y in slices]), return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, places, np.concatenate([runs[k][1][x:y] for k, x, y in slices]))
        ends = np.cumsum([y - x for _, x, y in slices]).tolist()
        yield pairs, counts, [(k, x, y, places[p:q]) for (k, x, y), p, q in zip(slices, [0, *ends], ends)]


def _totals_of_radix(table):
    """The last level: (run, radix, totals), each pair's count and whether it is its first id's highest."""
    import numpy as np
    import pyarrow as pa

    runs = [_unpack(x, 2) for x in table.column("pairs").to_pylist()]
    out = [np.empty((2, len(p)), np.int64) for p, _ in runs]
    for _, counts, slices in merge(runs):
        best = counts == counts.max()
        for k, x, y, places in slices:
            out[k][0, x:y], out[k][1, x:y] = counts[places], best[places]
    blocks = pa.array([_pack(*x) for x in out], pa.binary())
    return pa.table({"run": table.column("run"), "radix": table.column("radix"), "totals": blocks})


def _summed_run(key, table):
    """One run of the next level up: the pairs of its parts with their counts."""
    import numpy as np
    import pyarrow as pa

    found = [(p, c) for p, c, _ in merge([_unpack(x, 2) for x in table.column("pairs").to_pylist()])]
    block = _pack(np.concatenate([p for p, _ in found]), np.concatenate([c for _, c in found]))
    return pa.table({"run": pa.array([key[1].as_py()], pa.int64()), "radix": pa.array([key[0].as_py()], pa.int32()), "pairs": pa.array([block], pa.binary())})


def _handed_down(parts, above):
    """Totals of a level's parts, looked up in those of the run that they were merged to."""
    import numpy as np
    import pyarrow as pa

    pairs, _ = _unpack(above.column("pairs")[0].as_py(), 2)
    counts, best = _unpack(above.column("totals")[0].as_py(), 2)
    blocks = []
    for x in parts.column("pairs").to_pylist():
        at = np.searchsorted(pairs, _unpack(x, 2)[0])
        blocks.append(_pack(counts[at], best[at]))
    return pa.table({"run": parts.column("run"), "radix": parts.column("radix"), "totals": pa.array(blocks, pa.binary())})


TOTALS = "run long, radix int, totals binary"


def pair_totals(parts: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(run, radix, totals) for parts (run long, radix int, pairs binary): levels of merges, each of about ``fan_in`` parts."""
    runs = parts.select("run").distinct().count()
    if runs <= 2 * fan_in:
        return parts.groupBy("radix").applyInArrow(_totals_of_radix, TOTALS)
    grouped = parts.withColumn("above", F.pmod(F.xxhash64("run"), F.lit(-(-runs // fan_in))))
    upper = materialize(grouped.groupBy("radix", "above").applyInArrow(_summed_run, "run long, radix int, pairs binary"), "runs")
    known = upper.join(pair_totals(upper, fan_in), ["run", "radix"]).withColumnRenamed("run", "above")
    return grouped.groupBy("radix", "above").cogroup(known.groupBy("radix", "above")).applyInArrow(_handed_down, TOTALS)


PER_TEXT = ["n_a", "n_b", "n_groups", "n_links"]
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
SPILLED = "run long, radix int, pairs binary, postings binary, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in PER_TEXT) + ", groups_sha256 array<string>"


def _spilled(df: DataFrame, byte_level: bytes, pieces: bytes, run_chars: int, radix: int) -> DataFrame:
    """Runs of ``df`` (doc_id, text): a row for each part, and one of radix -1 with what is known of the texts themselves."""
    import pyarrow as pa
    from pyspark import TaskContext

    sent = df.sparkSession.sparkContext.broadcast((byte_level, pieces))
    names = [c.split()[0] for c in SPILLED.split(", ")]
    longs, binary, texts = pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string())
    kinds = [pa.int64(), pa.int32(), binary, binary, longs, *[longs] * len(PER_TEXT), texts]

    def closed(run, ids, encoded):
        import numpy as np

        g = Groups(_loaded(*sent.value), encoded)
        digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in g.texts()]
        none = [None] * (len(kinds) - 4)
        rows = [[run, -1, None, None, ids, *(getattr(g, c).tolist() for c in PER_TEXT), digests]]
        if len(g.links):
            pairs, doc, times = g.records()
            part = (pairs >> ID_BITS) % radix
            order = np.argsort(part, kind="stable")
            pairs, doc, times = pairs[order], doc[order], times[order]
            cuts = np.searchsorted(part[order], np.arange(radix + 1)).tolist()
            for r, (x, y) in enumerate(zip(cuts, cuts[1:])):
                if y > x:
                    distinct, n = np.unique(pairs[x:y], return_counts=True)
                    rows.append([run, r, _pack(distinct, n), _pack(doc[x:y], times[x:y]), *none])
        for at in range(0, len(rows), 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 16]), kinds)], names)

    def run(batches):
        pair = _loaded(*sent.value)
        number, held, ids, encoded = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            part, chars = [], 0
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                t = t or ""
                if ids and (held + len(t) > run_chars or len(ids) >= RUN_ROWS):
                    encoded += pair.encode(part)
                    yield from closed(number, ids, encoded)
                    number, held, ids, encoded, part, chars = number + 1, 0, [], [], [], 0
                ids.append(i)
                part.append(t)
                held, chars = held + len(t), chars + len(t)
                if chars > 1_000_000:
                    encoded, part, chars = encoded + pair.encode(part), [], 0
            encoded += pair.encode(part)
        if ids:
            yield from closed(number, ids, encoded)

    return df.mapInArrow(run, SPILLED)


def _contributions(parts, totals):
    """Rows of the texts of one run: its postings with the totals of their pairs."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    head = parts.filter(pc.equal(parts.column("radix"), -1))
    known = dict(zip(totals.column("radix").to_pylist(), totals.column("totals").to_pylist()))
    ids = head.column("doc_id").combine_chunks().flatten()
    best, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for r, pairs, postings in zip(*(parts.column(c).to_pylist() for c in ("radix", "pairs", "postings"))):
        if r >= 0:
            _, n = _unpack(pairs, 2)
            doc, times = _unpack(postings, 2)
            count, highest = _unpack(known[r], 2)
            np.add.at(best, doc, times * np.repeat(highest, n))
            np.add.at(total, doc, times * np.repeat(count, n))
    out = {"doc_id": ids} | {c: head.column(c).combine_chunks().flatten() for c in PER_TEXT}
    out |= {"n_best": pa.array(best), "count_sum": pa.array(total), "groups_sha256": head.column("groups_sha256").combine_chunks().flatten()}
    return pa.table(out)


def align(df: DataFrame, doc_id: str, text: str, byte_level: str, pieces: str, run_chars: int = RUN_CHARS, radix: int = RADIX, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``df``: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    ``byte_level`` and ``pieces`` are paths of a byte-level BPE file (A) and of a sentencepiece model (B); A encodes a space
    and the text, B the text, to which it adds the space.  Special strings inside texts are plain text.  A text that is
    null or empty, or whose tokens of a side joined differ from the space and the text, has no tokens: zeros and an
    empty string.  A pair's count is the number of rows that hold it linked, so repeated rows count each; n_best
    counts links whose pair has the highest count of its A id, ties too; count_sum adds up the counts of all links.
    A null doc_id stays null; an empty table gives an empty result; other columns are not read.  Texts are taken whole.
    """
    rows = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    spilled = materialize(_spilled(rows, read_vocabulary(byte_level), read_vocabulary(pieces), run_chars, radix), "spilled")
    totals = pair_totals(spilled.where("radix >= 0").select("run", "radix", "pairs"), fan_in)
    return spilled.groupBy("run").cogroup(totals.groupBy("run")).applyInArrow(_contributions, RESULT)


def op11_alignment(spark, sf_dir) -> DataFrame:
    """``align`` of all ``documents`` with the two public vocabularies; nulls, empty texts and repeated rows as stated there."""
    import public_tokenizers as given

    return align(table(spark, sf_dir, "documents"), "doc_id", "text", given.path("byte_bpe_50k.json"), given.path("piece_bpe_32k.model"))
