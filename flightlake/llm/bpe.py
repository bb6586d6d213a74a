"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

The tree's leaves hold, for every symbol of a word, the rank of the merge with its right neighbour;
the root is the lowest rank, and of equal ranks the leftmost.  A merge updates three leaves, each in
logarithmic time, so a word of n bytes takes O(n log n) steps however long it is.  Spark deals the
texts out; each task keeps a bounded memo of words it has met.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys

from pyspark.sql import DataFrame

from ._common import table

#: Words a worker remembers; at the bound the memo is emptied, which changes no result.
MEMO_WORDS = 300_000
#: Longer words are encoded anew each time, so that the memo's size in bytes is bounded too.
MEMO_BYTES = 64
#: Largest vocabulary file that is sent to the executors.
MAX_VOCABULARY_BYTES = 64 << 20

#: Words up to 2 ** WIDEST_BITS bytes are encoded side by side, so many at once.
WIDEST_BITS = 6
SIDE_BY_SIDE = 20_000
#: Stands for no merge; above every rank.
NO_RANK = 1 << 30
#: Characters of texts that are cut into words before their new words are encoded.
CHUNK_CHARS = 1_000_000

# The pre-tokenizer pattern of the public byte-level vocabulary, in \p classes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts in which Python's own classes agree with the \p classes (see _NOT_PLAIN).
_PATTERN_PLAIN = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# Outside these ranges, or at signs that are numbers but no digits, or at separators that only Python
# calls white space, the classes may differ; such texts take the \p pattern.
_NOT_PLAIN = re.compile("[^\x00-\x1b\x20-ɏ‐-‧€]|[\x85\xb2\xb3\xb9\xbc-\xbe]")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, mapped to the byte."""
    keep = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file: merge ranks, ids, and the bytes of every id."""

    def __init__(self, content: bytes):
        import numpy as np
        import regex

        j = json.loads(content)
        ids, alphabet = j["model"]["vocab"], byte_alphabet()
        merges = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        self.rank = {(ids[a] << 20) | ids[b]: i for i, (a, b) in reversed(list(enumerate(merges)))}
        self.merged = [ids[a + b] for a, b in merges]
        self.of_byte = [0] * 256
        for ch, b in alphabet.items():
            self.of_byte[b] = ids[ch]
        special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        size = max([*ids.values(), *special.values()]) + 1
        self.bytes_of = [b""] * size
        for word, i in ids.items():
            known = all(ch in alphabet for ch in word)
            self.bytes_of[i] = bytes(alphabet[ch] for ch in word) if known else word.encode()
        for word, i in special.items():
            self.bytes_of[i] = word.encode()
        self.special = special
        self.split_special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.slow = regex.compile(PATTERN)
        self.memo: dict[str, bytes] = {}
        order = sorted(self.rank)
        self.keys = np.array(order or [-1], np.int64)
        self.key_ranks = np.array([self.rank[k] for k in order] or [0], np.int64)

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token, merge by merge from the root of the segment tree."""
        ids = [self.of_byte[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        rank, merged = self.rank.get, self.merged
        bits = (n - 1).bit_length()
        size = 1 << bits
        none = 1 << 60
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = rank((ids[i] << 20) | ids[i + 1])
            if r is not None:
                tree[size + i] = (r << bits) | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        root = tree[1]
        while root != none:
            i = root & (size - 1)
            j = right[i]
            ids[i] = new = merged[root >> bits]
            ids[j] = -1
            after, before = right[j], left[i]
            right[i] = after
            # three point updates: the merged pair, the pair that starts at j, and the pair before
            r = None
            if after < n:
                left[after] = i
                r = rank((new << 20) | ids[after])
            changes = [(i, none if r is None else (r << bits) | i)]
            if tree[size + j] != none:
                changes.append((j, none))
            if before >= 0:
                r = rank((ids[before] << 20) | new)
                v = none if r is None else (r << bits) | before
                if tree[size + before] != v:
                    changes.append((before, v))
            for k, v in changes:
                k += size
                tree[k] = v
                while k > 1:
                    a, b = tree[k], tree[k ^ 1]
                    k >>= 1
                    v = a if a < b else b
                    if tree[k] == v:
                        break
                    tree[k] = v
            root = tree[1]
        return [x for x in ids if x >= 0]

    def ranks(self, a, b):
        """Vectorised: the rank of each pair, or NO_RANK."""
        import numpy as np

        q = (a.astype(np.int64) << 20) | b
        at = np.minimum(np.searchsorted(self.keys, q), len(self.keys) - 1)
        return np.where(self.keys[at] == q, self.key_ranks[at], NO_RANK)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """``encode_word`` for many pre-tokens at once: one segment tree for each, updated side by side."""
        out: list[bytes] = [b""] * len(words)
        by_bits: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            bits = (len(w) - 1).bit_length() if w else 0
            if bits > WIDEST_BITS:
                out[k] = b"".join(i.to_bytes(4, "little") for i in self.encode_word(w))
            else:
                by_bits.setdefault(max(bits, 1), []).append(k)
        for bits, where in by_bits.items():
            for at in range(0, len(where), SIDE_BY_SIDE):
                part = where[at : at + SIDE_BY_SIDE]
                for k, x in zip(part, self._encode_wide([words[k] for k in part], bits)):
                    out[k] = x
        return out

    def _encode_wide(self, words: list[bytes], bits: int) -> list[bytes]:
        import numpy as np

        size, n = 1 << bits, len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size)
        ids = np.asarray(self.of_byte, np.int32)[raw]
        right = np.tile(np.arange(1, size + 1, dtype=np.int32), (n, 1))
        left = np.tile(np.arange(-1, size - 1, dtype=np.int32), (n, 1))
        spot = np.arange(size, dtype=np.int64)
        tree = np.full((n, 2 * size), NO_RANK << bits, np.int64)
        pairs = (self.ranks(ids[:, :-1], ids[:, 1:]) << bits) | spot[:-1]
        tree[:, size:-1] = np.where((spot[1:] < length[:, None]) & (pairs < NO_RANK << bits), pairs, NO_RANK << bits)
        h = size // 2
        while h:
            tree[:, h : 2 * h] = np.minimum(tree[:, 2 * h : 4 * h : 2], tree[:, 2 * h + 1 : 4 * h : 2])
            h //= 2
        merged, none = np.asarray(self.merged, np.int32), NO_RANK << bits
        live = np.flatnonzero(tree[:, 1] != none)
        while len(live):
            root = tree[live, 1]
            i = root & (size - 1)
            j = right[live, i].astype(np.int64)
            new = merged[root >> bits]
            after, before = right[live, j].astype(np.int64), left[live, i].astype(np.int64)
            ids[live, i], ids[live, j] = new, -1
            right[live, i] = after
            has = after < length[live]
            left[live[has], after[has]] = i[has]
            r = self.ranks(new, ids[live, np.minimum(after, size - 1)])
            tree[live, size + i] = np.where(has & (r < NO_RANK), (r << bits) | i, none)
            tree[live, size + j] = none
            has = before >= 0
            before = np.where(has, before, i)
            r = self.ranks(ids[live, before], new)
            v = np.where(r < NO_RANK, (r << bits) | before, none)
            tree[live[has], size + before[has]] = v[has]
            for spots in ((size + i), (size + j), (size + before)):
                for _ in range(bits):
                    spots = spots >> 1
                    tree[live, spots] = np.minimum(tree[live, 2 * spots], tree[live, 2 * spots + 1])
            live = live[tree[live, 1] != none]
        keep = (ids >= 0) & (spot < length[:, None])
        packed, ends = ids[keep].astype("<u4").tobytes(), (4 * np.cumsum(keep.sum(1))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def words(self, text: str) -> list[str]:
        return self.slow.findall(text) if _NOT_PLAIN.search(text) else _PATTERN_PLAIN.findall(text)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens, with special strings of the file as pieces of their own."""
        if self.split_special is None or not self.split_special.search(text):
            return self.words(text)
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += self.words(text[at : m.start()])
            out.append(_Special(m.group()))
            at = m.end()
        return out + self.words(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        # a special string is a piece that equals no pre-token: its key is marked
        miss = list(set().union(*cut) - memo.keys())
        raw = [w.encode("utf-8", "surrogatepass") for w in miss]
        found = self.encode_words(raw)
        memo.update((w, x) for w, x in zip(miss, found))
        for w in miss:
            if type(w) is _Special:
                memo[w] = self.special[w.word].to_bytes(4, "little")
        out = [b"".join(map(memo.__getitem__, ws)) for ws in cut]
        for w, r in zip(miss, raw):
            if len(r) > MEMO_BYTES:
                del memo[w]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


class _Special(str):
    """A special string of the vocabulary; unlike any pre-token, also where the texts agree."""

    __slots__ = ("word",)

    def __new__(cls, word: str):
        self = super().__new__(cls, "\0special " + word + " \0")
        self.word = word
        return self


def _loaded(content: bytes) -> Vocabulary:
    """One vocabulary for each worker process and file."""
    kept = sys.modules[__name__].__dict__.setdefault("_vocabularies", {})
    key = hashlib.sha1(content).digest()
    if key not in kept:
        kept[key] = Vocabulary(content)
    return kept[key]


def read_vocabulary(path: str) -> bytes:
    """The file's bytes; its size is checked, as it is sent to every executor."""
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: over {MAX_VOCABULARY_BYTES} bytes")
    return content


def chunks(texts: list[str]):
    """Runs of texts of about CHUNK_CHARS characters; a longer text is a run of its own."""
    part, chars = [], 0
    for t in texts:
        if part and chars + len(t) > CHUNK_CHARS:
            yield part
            part, chars = [], 0
        part.append(t)
        chars += len(t)
    if part:
        yield part


def encode(df: DataFrame, doc_id: str, text: str, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """One row per row of ``df``: (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]).

    ``vocabulary`` is the path of a byte-level BPE file.  Special strings of the file become their ids.
    Null text counts as empty (no ids); an empty text has no ids; repeated rows give repeated rows; a
    null doc_id stays null; an empty table gives an empty table; other columns are not read.
    Texts are encoded whole.
    """
    import pandas as pd

    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if with_ids else ""

    def run(batches):
        import numpy as np

        v = _loaded(sent.value)
        sha = hashlib.sha256
        names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
        for pdf in batches:
            rows, texts = [], [t or "" for t in pdf["text"]]
            for part in chunks(texts):
                for packed in v.encode(part):
                    ids = np.frombuffer(packed, "<u4").tolist()
                    back = v.decode(ids)
                    row = (len(ids), sha(packed).hexdigest(), sha(back.encode()).hexdigest())
                    rows.append((*row, ids, back) if with_ids else row)
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", pdf["doc_id"].array)
            yield out
        v.memo.clear()  # the worker and its vocabulary outlive the stage

    cols = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    return cols.mapInPandas(run, schema)


def op8_bpe(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
