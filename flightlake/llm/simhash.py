"""SimHash near-duplicates: pigeonhole blocks propose pairs, Hamming distances decide.

A fingerprint of ``bits`` bits is cut into blocks.  Two fingerprints that differ in at most k bits
agree on all but k blocks, so a table for every choice of (blocks - k) blocks has the pair in one
bucket.  Buckets are joined by sorting on the block key; inside a bucket all Hamming distances are
taken, but only a spanning forest of the links leaves the task, so a large group of near copies
never turns into all its pairs.  Components over the forests are those over all links.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, materialize, table

SEED = 42
#: Buckets above this many different fingerprints are dealt part against part.
SPLIT_AT = 4096
#: Fixed odd multipliers that spread one 64-bit shingle hash into further words (wide fingerprints).
SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def pigeonhole_masks(bits: int, blocks: int, distance: int) -> list[int]:
    """A mask for every choice of (blocks - distance) of ``blocks`` even blocks: no pair within ``distance`` is lost."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in itertools.combinations(block, blocks - distance)]


def _hashes(text: str | None, shingle: int):
    """XXH64 (seed 42) of every word shingle, repeats included, as unsigned 64-bit numbers."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    n = len(words) - shingle + 1
    cuts = map(joined.__getitem__, map(slice, (end - length)[:n].tolist(), end[shingle - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, cuts, itertools.repeat(SEED)), np.uint64, n)


def _votes(h, words: int):
    """The ``words`` 64-bit words of a fingerprint: a bit is 1 if it is set in over half the hashes."""
    import numpy as np

    out = []
    for k in range(words):
        if k:  # one multiply and one fold give each further word bits of its own
            g = h * np.uint64(SPREAD[(k - 1) % 4] + 2 * (k - 1) // 4)
            g = (g ^ (g >> np.uint64(32))) * np.uint64(SPREAD[k % 4])
            g ^= g >> np.uint64(29)
        else:
            g = h
        count = np.zeros(64, np.int64)
        for at in range(0, len(g), 1 << 16):
            part = np.ascontiguousarray(g[at : at + (1 << 16)])
            count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(np.packbits(2 * count > len(g), bitorder="little").view(np.int64)[0] if len(g) else 0)
    return out


def fingerprints(df: DataFrame, doc_id: str, text: str, shingle: int = 3, bits: int = 64) -> DataFrame:
    """(doc_id, w0, w1, ...): the fingerprint of every whole text, in signed 64-bit words."""
    n = bits // 64
    names = [f"w{k}" for k in range(n)]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [_votes(_hashes(t, shingle), n) for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=names, dtype="int64")
            out.insert(0, "doc_id", pdf["doc_id"].array)
            yield out

    cols = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    return cols.mapInPandas(run, "doc_id long, " + ", ".join(f"{w} long" for w in names))


def _forest(fp, distance: int) -> list[tuple[int, int]]:
    """Links of a minimum spanning forest of one bucket, grown member by member (Prim); fp: (m, words) unsigned.

    Its links at any smaller distance join the same members as all links at that distance do.
    Memory is a few numbers for each member.
    """
    import numpy as np

    apart = lambda k, rest: np.bitwise_count(fp[rest] ^ fp[k]).sum(1, dtype=np.int64)
    rest = np.arange(1, len(fp))
    best, near, links = apart(0, rest), np.zeros(len(rest), np.int64), []
    for n in range(len(rest), 0, -1):
        k = int(np.argmin(best[:n]))
        new = int(rest[k])
        if best[k] <= distance:
            links.append((int(near[k]), new))
        for x in (rest, best, near):
            x[k] = x[n - 1]
        d = apart(new, rest[: n - 1])
        closer = d < best[: n - 1]
        best[: n - 1][closer] = d[closer]
        near[: n - 1][closer] = new
    return links


def _whole_buckets(batches, names: list[str], blobs: tuple[str, ...] = ()):
    """(starts, ends, column, ...) of whole buckets, from batches of rows sorted by ``key``; blobs: binary columns of even length, as rows of 64-bit words."""
    import numpy as np

    def columns(pdf):
        words = [np.frombuffer(b"".join(pdf[c]), np.uint64).reshape(len(pdf), -1) for c in blobs]
        return [pdf["key"].to_numpy(np.int64), *(pdf[c].to_numpy(np.int64) for c in names), *words]

    held: list = []  # the parts of one bucket, the last one so far
    for pdf in itertools.chain(batches, [None]):
        done = held
        if pdf is not None:
            if not len(pdf):
                continue
            now = columns(pdf)
            cut = np.flatnonzero(np.diff(now[0])) + 1
            last = int(cut[-1]) if len(cut) else 0
            if not last and held and held[0][0][0] == now[0][0]:
                held.append(now)
                continue
            if last:
                done = [*held, [x[:last] for x in now]]
            held = [[x[last:] for x in now]]
        if done:
            key, *rest = (np.concatenate(x) for x in zip(*done))
            edges = np.flatnonzero(np.diff(key)) + 1
            yield np.concatenate([[0], edges]).astype(np.int64), np.concatenate([edges, [len(key)]]).astype(np.int64), key, *rest


def dealt(keyed: DataFrame, large: DataFrame, most: int) -> DataFrame:
    """The rows of the ``large`` (key, m) buckets under new keys, one for each two parts of a bucket, parts of about ``most`` rows.

    Every two rows of a bucket meet under one of its new keys, and no task holds more than two parts.
    """
    parts = F.ceil(F.col("m") / F.lit(most))
    mine, other = F.pmod(F.xxhash64(F.lit("part"), F.col("node")), F.col("_parts")), F.col("_other")
    rows = keyed.join(large.select("key", "m"), "key").withColumn("_parts", parts)
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    return rows.select(F.xxhash64("key", F.least(mine, other), F.greatest(mine, other)).alias("key"), *[c for c in keyed.columns if c != "key"])


def bucket_links(keyed: DataFrame, words: int, distance: int, most: int | None) -> DataFrame:
    """(key, u, v): spanning forests (u, v) of the links inside each bucket; keyed: (key, node, w0, ...), sorted by key in a partition.

    A bucket of more than ``most`` rows gives one row (key, its number of rows, null) instead.
    """
    names = [f"w{k}" for k in range(words)]

    def run(batches):
        import numpy as np
        import pandas as pd

        for starts, ends, key, node, *w in _whole_buckets(batches, ["node", *names]):
            fp, edges, large = np.stack(w, 1).view(np.uint64), [], []
            two = starts[ends - starts == 2]
            near = np.bitwise_count(fp[two] ^ fp[two + 1]).sum(1, dtype=np.int64) <= distance
            out = [np.stack([node[two[near]], node[two[near] + 1]], 1)]
            for a, b in zip(starts.tolist(), ends.tolist()):
                if most and b - a > most:
                    large.append((int(key[a]), b - a))
                elif b - a > 2:
                    edges += [(int(node[a + p]), int(node[a + q])) for p, q in _forest(fp[a:b], distance)]
            out.append(np.array(edges, np.int64).reshape(-1, 2))
            found = np.unique(np.concatenate(out), axis=0)
            out = pd.DataFrame({"key": pd.array([None] * len(found), "Int64"), "u": found[:, 0], "v": pd.array(found[:, 1], "Int64")})
            more = pd.DataFrame(large, columns=["key", "u"], dtype="int64")
            more["v"] = pd.array([None] * len(more), "Int64")
            yield out
            yield more

    return keyed.mapInPandas(run, "key long, u long, v long")


def fingerprint_links(nodes: DataFrame, names: list[str], masks: list[int], distance: int) -> DataFrame:
    """Links (u, v) that join all ``nodes`` (node, names...) whose fingerprints are within ``distance``, through others or not.

    Nodes share a bucket for each mask on which they agree.  Buckets above SPLIT_AT are dealt part against part.
    """
    full = (1 << 64) - 1

    def key(t: int, mask: int):
        parts = [(mask >> (64 * k)) & full for k in range(len(names))]
        signed = [p - (1 << 64) if p >> 63 else p for p in parts]
        return F.xxhash64(F.lit(t), *(F.col(w).bitwiseAND(F.lit(p).cast("long")) for w, p in zip(names, signed) if p))

    keys = F.explode(F.array(*(key(t, m) for t, m in enumerate(masks))))
    keyed = nodes.select(keys.alias("key"), "node", *[F.col(c).alias(f"w{k}") for k, c in enumerate(names)])
    found = materialize(bucket_links(keyed.repartition("key").sortWithinPartitions("key"), len(names), distance, SPLIT_AT), "links")
    links = found.where("key IS NULL").select("u", "v")
    large = found.where("key IS NOT NULL").select("key", F.col("u").alias("m"))
    if large.limit(1).count():
        again = dealt(keyed, large, SPLIT_AT // 2).repartition("key").sortWithinPartitions("key")
        links = links.unionByName(bucket_links(again, len(names), distance, None).select("u", "v"))
    return links


def simhash_groups(df: DataFrame, doc_id: str, text: str, shingle: int = 3, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(doc_id, fingerprint, component_id): 64-bit SimHash classes at ``distance`` or fewer differing bits.

    Words are runs of bytes other than space and 0x09-0x0D after lower-casing A-Z.  Null and empty texts and
    texts without words have fingerprint 0 and are linked like any other; a text of fewer words
    than a shingle is one shingle.  component_id is the smallest doc_id reachable.  Repeated rows come out
    repeated; rows whose doc_id is null make no links of their own but get the class of an equal
    fingerprint, else null.  Other columns are not read; an empty table gives an empty result.
    Equal fingerprints are one node from the start, so copies cost nothing further.
    """
    prints = materialize(fingerprints(df, doc_id, text, shingle, 64), "simhash")
    nodes = materialize(prints.groupBy("w0").agg(F.min("doc_id").alias("node")), "nodes")
    links = fingerprint_links(nodes.where("node IS NOT NULL"), ["w0"], pigeonhole_masks(64, blocks, distance), distance)
    named = nodes.join(components(links), "node", "left").select("w0", F.coalesce("component", "node").alias("component_id"))
    out = prints.join(named, "w0")
    return out.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


# ---- documents that share most of their word shingles --------------------------------------------------

#: The form of the pipeline: pairs at a Jaccard similarity of 0.8 or more on sets of five-word shingles.
NEAR = {"shingle": 5, "least": 0.8}
#: Documents that the order of the commonest shingles is taken from, and shingles that it names: they set the work, never the result.
ORDER_SAMPLE, ORDER_NAMED = 10_000, 1 << 17
#: Shingles of all documents are counted by the upper PART_BITS + 10 + 16 bits of their hashes, in a part for each value of the first; a task
#: hands on COUNTED members at a time.  What is in more than SMALL documents is marked in a table of PART_BITS + 16 bits (8 MiB).
PART_BITS, COUNTED = 10, 1 << 21
#: Buckets of up to SMALL sets are compared by sizes and places alone, larger ones by sketches, those above BUCKET part against part.
SMALL, BUCKET = 12, 512
#: Bits of the least parity sketch, and bits of a sketch for each member of a set.
SKETCH, SPREAD_BITS = 1024, 4


def common_shingles(docs: DataFrame, shingle: int, hot: int, share: int):
    """(sorted hashes, ranks, whether more than ``hot`` documents are likely to hold it) of the shingles that most documents of a sample, one of ``share``, hold."""
    import numpy as np

    def run(batches):
        import pandas as pd

        for pdf in batches:
            h = [np.unique(_hashes(t, shingle)) for t in pdf["text"]]
            yield pd.DataFrame({"h": (np.concatenate(h) if h else np.zeros(0, np.uint64)).view(np.int64)})

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(share)) == 0).select("text").mapInPandas(run, "h long")
    rows = some.groupBy("h").count().where("count > 3").orderBy(F.desc("count"), "h").limit(ORDER_NAMED).collect()
    h, count = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], count[order], count[order] * share > hot


def frequent_shingles(docs: DataFrame, shingle: int, above: int):
    """A table of bits by the upper bits of a shingle's hash: 1 for every shingle that more than ``above`` of all documents hold, and for few others.

    A sample does not see what a few dozen of very many documents hold.  All documents are counted here: what is
    shuffled are sorted 36-bit hashes in two bytes each and counts of their upper bits, and each part is counted by itself.
    """
    import numpy as np

    parts = 1 << PART_BITS

    def cut(held):
        import pandas as pd

        x = np.sort(np.concatenate(held) >> np.uint64(64 - PART_BITS - 26))
        keep = np.ones(len(x), bool)  # of equal ones no more than decide
        keep[above + 1 :] = x[above + 1 :] != x[: -above - 1]
        x = x[keep]
        edges = np.searchsorted(x, np.arange(parts + 1, dtype=np.uint64) << np.uint64(26))
        upper = np.bincount((x >> np.uint64(16)).astype(np.int64), minlength=parts << 10).astype(np.uint32).reshape(parts, -1)
        lower = (x & np.uint64(0xFFFF)).astype(np.uint16)
        some = np.flatnonzero(np.diff(edges))
        blobs = [lower[a:b].tobytes() for a, b in zip(edges[some].tolist(), edges[some + 1].tolist())]
        return pd.DataFrame({"part": some, "upper": [upper[k].tobytes() for k in some], "lower": blobs})

    def deal(batches):
        held, size = [], 0
        for pdf in batches:
            for t in pdf["text"]:
                held.append(np.unique(_hashes(t, shingle)))
                size += len(held[-1])
                if size >= COUNTED:
                    yield cut(held)
                    held, size = [], 0
        if size:
            yield cut(held)

    def count(pdf):
        import pandas as pd

        upper = np.arange(1 << 10, dtype=np.uint32) << np.uint32(16)
        x = [np.repeat(upper, np.frombuffer(a, np.uint32)) | np.frombuffer(b, np.uint16) for a, b in zip(pdf["upper"], pdf["lower"])]
        x = np.sort(np.concatenate(x))
        bits = np.zeros(1 << 16, np.uint8)
        bits[x[above:][x[above:] == x[:-above]] >> np.uint32(10)] = 1
        return pd.DataFrame({"part": pdf["part"].iloc[:1].to_numpy(), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    dealt_out = docs.select("text").mapInPandas(deal, "part long, upper binary, lower binary")
    bits = np.zeros((parts, 1 << 13), np.uint8)
    for part, found in dealt_out.groupBy("part").applyInPandas(count, "part long, bits binary").collect():
        bits[part] = np.frombuffer(found, np.uint8)
    return bits.ravel()


def shingle_sets(docs: DataFrame, shingle: int, least: float, last, frequent=None) -> DataFrame:
    """(doc_id, text_hash, d0, d1, n, f, small, sketch, prefix, cold) of every text's set of word shingles.

    d0, d1: digest; n: size; f: 64-bit SimHash of the set; sketch: bit b is the parity of the members that hash to b, of
    a power of two of bits (small: folded to SKETCH bits; sketch is null if that is all).  prefix: the first
    n - ceil(least n) + 1 members in an order by frequency, rarest first: those not marked in the table ``frequent``, those
    marked, those of ``last`` by their ranks; sets of which one holds at
    least the share ``least`` of the other's members have one of them in common.  cold: members of the prefix
    that are not known to be in very many sets.
    """
    named, ranks, hot = last

    def run(batches):
        import math

        import numpy as np
        import pandas as pd

        known, place, very = np.array(named, np.uint64), np.array(ranks, np.int64), np.array(hot, bool)
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                h = np.unique(_hashes(t, shingle))
                n = len(h)
                d = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), np.int64)
                bits = max(SKETCH, 1 << (SPREAD_BITS * n - 1).bit_length()) if n else SKETCH
                odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                whole = np.packbits(odd.astype(np.uint8), bitorder="little")
                small = _fold(whole.view(np.uint64), SKETCH // 64)
                rank, cold = np.zeros(n, np.int64), n
                if frequent is not None:
                    slot = (h >> np.uint64(48 - PART_BITS)).astype(np.int64)
                    rank = (frequent[slot >> 3] >> (slot & 7)).astype(np.int64) & 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    hit = known[at] == h
                    rank = np.where(hit, place[at], rank)
                    cold = int(n - (hit & very[at]).sum())
                order = h[np.argsort(rank, kind="stable")]
                k = n - math.ceil(least * n - 1e-9) + 1 if n else 0
                first = order[:k].view(np.int64)
                # a copy: a view would keep the whole set
                rows.append((*d.tolist(), n, _votes(h, 1)[0], small.tobytes(), whole.tobytes() if bits > SKETCH else None, first.copy(), min(cold, k)))
            out = pd.DataFrame(rows, columns=["d0", "d1", "n", "f", "small", "sketch", "prefix", "cold"])
            out.insert(0, "doc_id", pdf["doc_id"].array)
            out.insert(1, "text_hash", pdf["text_hash"].array)
            yield out

    kinds = "doc_id long, text_hash long, d0 long, d1 long, n long, f long, small binary, sketch binary, prefix array<long>, cold int"
    return docs.mapInPandas(run, kinds)


def _fold(words, length: int):
    """A sketch of fewer bits: position modulo the smaller length, parities added."""
    while len(words) > length:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def _may_match(n, m, apart, least: float):
    """Whether sets of n and m members whose sketches differ in ``apart`` bits can be similar (a sketch differs in no more bits than the sets in members)."""
    import numpy as np

    return (np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9) & (apart * (1 + least) <= (1 - least) * (n + m) + 1e-9)


def bucket_pairs(keyed: DataFrame, least: float) -> DataFrame:
    """(key, u, v, at): pairs (u, v) of nodes of small buckets that may match, and the rows (key, node, null, at) of larger ones.

    keyed: (key, node, n, at), sorted by key in a partition.  A pair that has too few members behind its places in the
    order is left out: similar sets pass in the bucket of their first common member.
    """

    def run(batches):
        import numpy as np
        import pandas as pd

        none = lambda k: pd.array([None] * k, "Int64")
        for starts, ends, key, node, n, at in _whole_buckets(batches, ["node", "n", "at"]):
            sizes, found, rest = ends - starts, [np.zeros((0, 2), np.int64)], n - at
            for size in range(2, SMALL + 1):
                i, j = np.triu_indices(size, 1)
                first = starts[sizes == size][:, None]
                for part in np.array_split(first, len(first) * len(i) // 500_000 + 1):
                    a, b = (part + i).ravel(), (part + j).ravel()
                    ok = np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-9
                    ok &= np.minimum(rest[a], rest[b]) * (1 + least) >= least * (n[a] + n[b]) - 1e-9
                    found.append(np.stack([np.minimum(node[a[ok]], node[b[ok]]), np.maximum(node[a[ok]], node[b[ok]])], 1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pd.DataFrame({"key": none(len(pairs)), "u": pairs[:, 0], "v": pairs[:, 1], "at": none(len(pairs))})
            large = np.flatnonzero(np.repeat(sizes > SMALL, sizes))
            for x in range(0, len(large), 10_000):
                rows = large[x : x + 10_000]
                yield pd.DataFrame({"key": key[rows], "u": node[rows], "v": none(len(rows)), "at": at[rows]})

    return keyed.mapInPandas(run, "key long, u long, v long, at long")


def pairs_between(keyed: DataFrame, least: float, stars: bool) -> DataFrame:
    """(u, v): pairs of one bucket that may match and are of different components c; keyed: (key, node, c, n, at, small), sorted by key.

    All of them, or with ``stars`` only those of a greedy cover: a member and all that may match it, then the same among the others.
    """

    def run(batches):
        import numpy as np
        import pandas as pd

        for starts, ends, _, node, c, n, at, sketch in _whole_buckets(batches, ["node", "c", "n", "at"], ("small",)):
            found, held, left = [], 0, n - at

            def matches(x, y):
                y = y[c[y] != c[x]]
                y = y[(np.minimum(n[x], n[y]) >= least * np.maximum(n[x], n[y]) - 1e-9) & (np.minimum(left[x], left[y]) * (1 + least) >= least * (n[x] + n[y]) - 1e-9)]
                return y[_may_match(n[x], n[y], np.bitwise_count(sketch[y] ^ sketch[x]).sum(1, dtype=np.int64), least)]

            for a, b in zip(starts.tolist(), ends.tolist()):
                # members of small components first: what is left in the end is one component
                _, which, count = np.unique(c[a:b], return_inverse=True, return_counts=True)
                rest = a + np.lexsort((which, count[which]))
                while len(rest) > 1 and c[rest[0]] != c[rest[-1]]:
                    y = matches(rest[0], rest[1:])
                    if len(y):
                        found.append(np.stack([np.minimum(node[rest[0]], node[y]), np.maximum(node[rest[0]], node[y])], 1))
                        held += len(y)
                    # with stars the leader's whole component is covered too: its members are joined already
                    rest = rest[1:][~np.isin(rest[1:], y) & (c[rest[1:]] != c[rest[0]])] if stars else rest[1:]
                    if held > 200_000:
                        yield pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["u", "v"])
                        found, held = [], 0
            if found:
                yield pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["u", "v"])

    return keyed.mapInPandas(run, "u long, v long")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """The distinct pairs (u, v) of nodes whose sets have a Jaccard similarity of at least ``least``: by sizes and whole sketches, then on the texts."""

    def likely(batches):
        import numpy as np

        for pdf in batches:
            apart = []
            for *small, a, b in zip(pdf["au"], pdf["av"], pdf["bu"], pdf["bv"]):
                a, b = np.frombuffer(a or small[0], np.uint64), np.frombuffer(b or small[1], np.uint64)
                length = min(len(a), len(b))
                apart.append(int(np.bitwise_count(_fold(a, length) ^ _fold(b, length)).sum()))
            yield pdf.loc[_may_match(pdf["nu"].to_numpy(), pdf["nv"].to_numpy(), np.array(apart, np.int64), least), ["u", "v"]]

    def exact(batches):
        for pdf in batches:
            keep = []
            for a, b in zip(pdf["a"], pdf["b"]):
                x, y = set(_hashes(a, shingle).tolist()), set(_hashes(b, shingle).tolist())
                shared = len(x & y)
                keep.append(shared >= least * (len(x) + len(y) - shared) - 1e-9)
            yield pdf.loc[keep, ["u", "v"]]

    ordered = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("small").alias(f"a{x}"), F.col("sketch").alias(f"b{x}"))
    both = ordered.join(side("u"), "u").join(side("v"), "v")
    links = materialize(both.mapInPandas(likely, "u long, v long"), "likely")
    used = links.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes, "node")
    used = used.select("node", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("text_hash"))
    same = docs["doc_id"].eqNullSafe(used["_id"]) & (docs["text_hash"] == used["text_hash"])
    text = docs.join(used, same).groupBy("node").agg(F.first("text").alias("text"))  # repeated rows are one
    both = links.join(text.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    both = both.join(text.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    return materialize(both.mapInPandas(exact, "u long, v long"), "similar")


def near_duplicate_classes(df: DataFrame, doc_id: str, text: str, shingle: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): the digest of every row's set of word shingles, and the class of every distinct set.

    rows: (doc_id, text_hash, d0, d1), one for each row.  sets: (d0, d1, first, class): first (no_id, doc_id, text_hash) is the row with the
    smallest doc_id (null last), class a number without further meaning, the same for sets linked at a Jaccard similarity of ``least``.
    Pairs are proposed in three ways, and linked only if their whole texts are similar:
    1. SimHash: 64-bit fingerprints that share three of six blocks and differ in at most three bits.  That joins most copies.
    2. Three bits are too few for a similarity of 0.8 (about ten bits), so the rest is found exactly: similar sets share a
       member of their prefixes (``shingle_sets``).  A small bucket of sets with a common member gives all pairs that sizes and
       places allow, a larger one a star for each set that no star covers yet.
    3. Once these are checked and joined, all pairs of a larger bucket that are still in different components.
    """
    docs = df.select(df[doc_id].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(df[text], F.lit(""))).alias("text_hash"), df[text].alias("text"))
    share = max(1, docs.count() // ORDER_SAMPLE)
    frequent = frequent_shingles(docs, shingle, SMALL) if share > 1 else None  # else the sample is all
    rows = materialize(shingle_sets(docs, shingle, least, common_shingles(docs, shingle, BUCKET, share), frequent), "sets")
    # copies meet first, so each set's prefix is dealt once
    one = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    kept = ["n", "f", "small", "sketch", "prefix", "cold"]
    nodes = rows.groupBy("d0", "d1").agg(F.min(one).alias("first"), F.first(F.struct(*kept)).alias("x"))
    # numbers are given out once: they are written before they are used
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "d0", "d1", "first", "x.*"), "nodes")
    # 1.
    same = nodes.groupBy("f").agg(F.min("node").alias("lead"))
    pairs = fingerprint_links(same.withColumnRenamed("lead", "node"), ["f"], pigeonhole_masks(64, 6, 3), 3)
    pairs = pairs.unionByName(nodes.join(same, "f").where("node <> lead").select(F.col("lead").alias("u"), F.col("node").alias("v")))
    # 2.
    keyed = nodes.select("node", "n", F.posexplode(F.slice("prefix", F.lit(1), F.col("cold"))).alias("at", "key"))
    keyed = keyed.select("key", "node", "n", F.col("at").cast("long").alias("at")).repartition("key").sortWithinPartitions("key")
    found = materialize(bucket_pairs(keyed, least), "pairs")
    pairs = pairs.unionByName(found.where("v IS NOT NULL").select("u", "v"))
    hot = nodes.where(F.size("prefix") > F.col("cold")).select("node", "cold", F.posexplode("prefix").alias("at", "key")).where("at >= cold")
    large = found.where("v IS NULL").select("key", F.col("u").alias("node"), "at").unionByName(hot.select("key", "node", F.col("at").cast("long").alias("at")))
    info = nodes.select("node", "n", "small")

    def larger(c, stars: bool) -> DataFrame | None:
        """Pairs of the larger buckets; c: the component of each node by a frame (node, component), or none yet."""
        mine = large.withColumn("c", F.col("node")) if c is None else large.join(c, "node", "left").select("key", "node", "at", F.coalesce("component", "node").alias("c"))
        mixed = mine.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("key", "m")
        mixed = materialize(mixed, "mixed")
        if not mixed.limit(1).count():
            return None
        members = mine.join(mixed.select("key"), "key", "left_semi").join(info, "node")
        return pairs_between(dealt(members, mixed, BUCKET).repartition("key").sortWithinPartitions("key"), least, stars)

    more = larger(None, True)
    links = verified(pairs if more is None else pairs.unionByName(more), nodes, docs, shingle, least)
    found = components(links)
    # 3.
    more = larger(found, False) if more is not None else None
    if more is not None:
        found = components(links.unionByName(verified(more, nodes, docs, shingle, least)))
    sets = nodes.join(found, "node", "left").select("d0", "d1", "first", F.coalesce("component", "node").alias("class"))
    return rows.select("doc_id", "text_hash", "d0", "d1"), sets


def near_duplicate_groups(df: DataFrame, doc_id: str, text: str, shingle: int, least: float) -> DataFrame:
    """(doc_id, text_hash, component_id) for every row: classes of ``near_duplicate_classes``, by their smallest doc_id.

    Null and empty texts and texts without words have the empty set and are copies of one another; shorter texts
    than a shingle are one shingle.  A class without any doc_id has a null component_id.  Repeated rows
    come out repeated; other columns are not read; an empty table gives an empty result.
    """
    rows, sets = near_duplicate_classes(df, doc_id, text, shingle, least)
    ids = sets.groupBy("class").agg(F.min("first").alias("x")).select("class", F.col("x.doc_id").alias("component_id"))
    return rows.join(sets.join(ids, "class").select("d0", "d1", "component_id"), ["d0", "d1"]).select("doc_id", "text_hash", "component_id")


def near_duplicate_leaders(df: DataFrame, doc_id: str, text: str, shingle: int, least: float) -> DataFrame:
    """(doc_id, text_hash): of each class the row with the smallest doc_id (null last; of equal ids the smallest text_hash)."""
    _, sets = near_duplicate_classes(df, doc_id, text, shingle, least)
    return sets.groupBy("class").agg(F.min("first").alias("x")).select("x.doc_id", "x.text_hash")


def op6_simhash(spark, sf_dir) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), "doc_id", "text")
