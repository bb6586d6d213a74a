"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur in a document with up to k = max(1, ERROR_RATE * m) edits.
It is split into k + 1 pieces: whatever the edits, one piece occurs unchanged.  An automaton over
the pieces of all items finds their exact hits in one pass over a text, and Myers' bit-parallel
distance, run over windows around a hit, tells whether the whole item is there.  The windows grow:
pieces are leaves of a binary tree whose nodes over p pieces may hold p - 1 edits, so an item within
its budget has a leaf all of whose ancestors are within theirs, and a chance hit ends at a short window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, table

#: Edits allowed for each character of an item.
ERROR_RATE = 0.08
#: Items shorter than this after normalising are matched without edits (their pieces would be too short to mean anything), from word to word.
SHORT = 40
#: Items shorter than this after normalising are not looked for: such words stand in any text.
LEAST = 20
#: Characters of items that one pass over the documents looks for; more items take more passes.
BLOCK_CHARS = 4_000_000


_WORDS = re.compile(r"[^\W_]+")
#: The same rule for the characters up to U+00FF, as a byte table.
_LATIN = bytes(b if _WORDS.match(chr(b)) else 32 for b in range(256))


def normalise(text: str | None) -> str:
    """Lower case, with every run of other than letters and digits as one space."""
    low = (text or "").lower()
    try:
        return " ".join(low.encode("latin-1").translate(_LATIN).decode("latin-1").split())
    except UnicodeEncodeError:
        return " ".join(_WORDS.findall(low))


def budget(item: str) -> int:
    """Edits that an item of this (normalised) text may have undergone."""
    return max(1, int(ERROR_RATE * len(item))) if len(item) >= SHORT else 0


def pieces(item: str) -> list[tuple[int, str]]:
    """The item in budget + 1 pieces of even length, with their offsets."""
    n = budget(item) + 1
    cuts = [round(i * len(item) / n) for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def ancestors(cuts: list[tuple[int, str]]) -> list[list[tuple[int, int, int]]]:
    """For each piece the (start, end, edits) of the tree's nodes above it, smallest first."""
    above: list[list[tuple[int, int, int]]] = [[] for _ in cuts]

    def node(a: int, b: int) -> None:
        if b - a == 1:
            return
        mid = (a + b) // 2
        node(a, mid)
        node(mid, b)
        last, text = cuts[b - 1]
        for k in range(a, b):
            above[k].append((cuts[a][0], last + len(text), b - a - 1))

    node(0, len(cuts))
    return above


def neighbour(cuts: list[tuple[int, str]], k: int) -> tuple | None:
    """The other half of piece k's two-piece node: (lies after it, its near half, its far half), if there is one."""
    pair = [0, len(cuts)]
    while pair[1] - pair[0] > 2:
        mid = sum(pair) // 2
        pair = [pair[0], mid] if k < mid else [mid, pair[1]]
    if pair[1] - pair[0] < 2:
        return None
    other = cuts[pair[0] if k != pair[0] else pair[0] + 1][1]
    half = len(other) // 2
    return (True, other[:half], other[half:]) if k == pair[0] else (False, other[half:], other[:half])


def beside(text: str, start: int, end: int, other: tuple) -> bool:
    """Whether the neighbour of an exact piece at [start, end) can be there with one edit: half of it is unchanged."""
    after, near, far = other
    if after:
        at = end + len(near)
        return text.startswith(near, end) or text.startswith(far, at) or text.startswith(far, at + 1) or text.startswith(far, at - 1)
    at = start - len(near)
    if at >= 0 and text.startswith(near, at):
        return True
    at -= len(far)
    return any(x >= 0 and text.startswith(far, x) for x in (at, at + 1, at - 1))


def character_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, ch in enumerate(item):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    return masks


def best_match(masks: dict[str, int], m: int, text: str, most: int, any_match: bool = False) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of an item anywhere in ``text``, within ``most`` edits (or of the first one).

    Myers' algorithm: the column of the edit matrix is kept as two bit vectors of m bits.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    best = None
    for at, ch in enumerate(text):
        eq = masks.get(ch, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        horizontal_up = down | (full & ~(d0 | up))
        horizontal_down = up & d0
        if horizontal_up & top:
            distance += 1
        elif horizontal_down & top:
            distance -= 1
        # an occurrence may start anywhere: the first row of the matrix is all zero
        horizontal_up = (horizontal_up << 1) & full
        horizontal_down = (horizontal_down << 1) & full
        up = horizontal_down | (full & ~(d0 | horizontal_up))
        down = horizontal_up & d0
        if distance <= most and (best is None or distance < best[0]):
            best = (distance, at + 1)
            if any_match or not distance:
                break
    return best


class Matcher:
    """Automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = []
        owners: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            text = normalise(raw)
            if len(text) < LEAST:
                continue
            k = len(self.items)
            masks = character_masks(text)
            self.items.append((item_id, len(text), budget(text), masks, text))
            cuts = pieces(text)
            nodes: dict[tuple[int, int, int], tuple] = {}
            for at, ((offset, piece), above) in enumerate(zip(cuts, ancestors(cuts))):
                chain = []
                for x in above[:-1]:  # the root is the whole item
                    if x not in nodes:
                        nodes[x] = (*x, character_masks(text[x[0] : x[1]]))
                    chain.append(nodes[x])
                owners.setdefault(piece, []).append((k, offset, neighbour(cuts, at), chain))
        self.automaton = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        if owners:
            self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, tuple[int, int]]:
        """{item_id: (distance, end in the normalised text)} of the items that occur in a text."""
        if not self.items:
            return {}
        found: dict[int, tuple[int, int]] = {}
        windows: dict[int, list[list[int]]] = {}
        exact: dict[int, int] = {}

        def at_root(k: int, start: int) -> None:
            m, most = self.items[k][1:3]
            a, b = max(0, start - most), min(len(text), start + m + most)
            spans = windows.setdefault(k, [])
            if spans and a <= spans[-1][1] and spans[-1][0] <= b and spans[-1][1] - spans[-1][0] < 4 * m:
                spans[-1] = [min(a, spans[-1][0]), max(b, spans[-1][1])]
            else:
                spans.append([a, b])

        for end, (length, own) in self.automaton.iter(text):
            for k, offset, other, chain in own:
                if k in exact or other and not beside(text, end + 1 - length, end + 1, other):
                    continue
                start = end + 1 - length - offset
                if not self.items[k][2]:
                    # a short item is one piece; it may begin and end words, but not lie inside them
                    if (not start or text[start - 1] == " ") and text[end + 1 : end + 2] in ("", " "):
                        exact[k] = end + 1
                    continue
                if start >= 0 and text.startswith(self.items[k][4], start):
                    exact[k] = start + self.items[k][1]  # hits come in the order of the text: the first is the best
                    continue
                for x, y, most, masks in chain:
                    if not best_match(masks, y - x, text[max(0, start + x - most) : start + y + most], most, True):
                        break
                else:
                    at_root(k, start)
        for k, end in exact.items():
            item_id = self.items[k][0]
            found[item_id] = min(found.get(item_id, (0, end)), (0, end))
        for k, spans in windows.items():
            item_id, m, most, masks = self.items[k][:4]
            for a, b in spans if k not in exact else ():
                hit = best_match(masks, m, text[a:b], most)
                if hit and (item_id not in found or (hit[0], a + hit[1]) < found[item_id]):
                    found[item_id] = (hit[0], a + hit[1])
        return found


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, end): every item that occurs in a document within its edit budget.

    One row for each pair of a document row and an item; the best occurrence, of equal ones the
    first; ``end`` counts characters of the normalised text.  Items below SHORT characters match whole words without edits, those
    below LEAST match nothing.  Items are looked for in blocks of at most
    BLOCK_CHARS characters, each block in one pass over all documents; no document text is
    shuffled.  Null or empty texts and items match nothing; a null doc_id or item_id stays null
    in the pairs; repeated document rows give repeated pairs, repeated items one pair; other columns are not read.
    """
    import pandas as pd

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    schema = "doc_id long, item_id long, distance int, end long"

    def searching(block):
        def run(batches):
            m = Matcher(block.value)
            for pdf in batches:
                out = []
                for doc, text in zip(pdf["doc_id"], pdf["text"]):
                    out += [(doc, i, d, e) for i, (d, e) in sorted(m.matches(normalise(text)).items(), key=lambda x: (x[0] is None, x[0]))]
                out = pd.DataFrame(out, columns=["doc_id", "item_id", "distance", "end"])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

        return rows.mapInPandas(run, schema)

    found = [searching(block) for block in item_blocks(benchmark)]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)


def item_blocks(benchmark: DataFrame) -> Iterator:
    """Broadcast blocks of distinct (item_id, text), of about BLOCK_CHARS characters each, by a hash of the item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    items = items.where("length(text) > 0").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-chars // BLOCK_CHARS)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield benchmark.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in part.collect()])


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text, ...) in which no item of ``benchmark`` occurs within its edit budget, all columns kept.

    Each block of items takes one pass over what the blocks before it left; nothing is shuffled.
    """
    import pyarrow as pa

    def clean(block):
        def run(batches):
            m = Matcher(block.value)
            for batch in slices(batches):
                yield batch.filter(pa.array([not m.matches(normalise(t)) for t in batch.column("text").to_pylist()], pa.bool_()))

        return run

    for block in item_blocks(benchmark):
        docs = docs.mapInArrow(clean(block), docs.schema)
    return docs


def op10_decontamination(spark, sf_dir) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
