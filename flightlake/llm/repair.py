"""Repair of conversation structure as shortest paths over an integer-cost lattice, by the auction algorithm.

A node is a place between the messages of a conversation and what the roles so far allow: nothing yet, a system message, a
user's or an assistant's.  Arcs are edits: keep a message, give it the role that is due, delete it, insert the message
that is due.  The auction algorithm extends a path along the cheapest arc by price, and contracts it where a node's price
is below its arcs', which raises the price.  Origins are taken from the last place to the first; a path that meets a node
whose price has converged ends there, and first prices come from the place after, so n messages take O(n) steps.  Converged prices are the
costs to the end; arcs that they leave no slack are tight, and the least letters along tight arcs spell the edits.

Rows of a conversation are dealt to one task and pass it in order, a batch at a time.  For prices a task holds one byte and four
numbers for each message of the conversation at hand, never its texts; these pass a second time, with the edits known.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, table

# Costs, roles that are due after nothing, a system message, a user's, an assistant's, and the states these lead to.
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
DUE = ("user", "user", "assistant", "user")
NEXT = (2, 2, 3, 2)
#: States in which a kept message with the initial s, u or a may follow, and the state it leads to.
KEPT = {1: ((0,), 1), 2: ((0, 1, 3), 2), 3: ((2,), 3)}
INITIALS = {"s": 1, "u": 2, "a": 3}
ENDS = (0, 3)
WHITE = "\t\n\x0b\f\r "
#: Bits of a message's code above its initial's number.
MUST_GO, CUT_OFF = 4, 8


def arcs(codes: bytes, node: int) -> list[tuple[str, int, int]]:
    """(letter, cost, node) of the arcs from a node, letters ascending; nodes are numbered 4 * place + state."""
    place, state = divmod(node, 4)
    insert = ("I", COSTS["I"], node - state + NEXT[state])
    if place == len(codes):
        return [insert]
    code = codes[place]
    out = [("D", COSTS["D"], node + 4), insert]
    if not code & MUST_GO:
        more = TRUNCATED if code & CUT_OFF else 0
        before, after = KEPT.get(code & 3, ((), 0))
        if state in before:
            out.append(("K", COSTS["K"] + more, node + 4 - state + after))
        out.append(("R", COSTS["R"] + more, node + 4 - state + NEXT[state]))
    return out


def converged_prices(codes: bytes):
    """Cost from each node to the end, by the auction algorithm.

    A place's nodes start at the least price of the next place: no arc costs less than nothing, so no arc is overpriced.
    """
    from array import array

    n = len(codes)
    prices, settled = array("q", bytes(32 * (n + 1))), bytearray(4 * (n + 1))
    for state in ENDS:
        settled[4 * n + state] = 1
    for place in range(n, -1, -1):
        if place < n:
            prices[4 * place : 4 * place + 4] = array("q", [min(prices[4 * place + 4 : 4 * place + 8])] * 4)
        for origin in range(4 * place, 4 * place + 4):
            if settled[origin]:
                continue
            path = [origin]
            while not settled[path[-1]]:
                last = path[-1]
                least, to = min((cost + prices[to], to) for _, cost, to in arcs(codes, last))
                if prices[last] < least:
                    prices[last] = least
                    if last != origin:
                        path.pop()
                else:
                    path.append(to)
            for node in path:
                settled[node] = 1
    return prices


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """The least cost and, of the cheapest edits, the ASCII-least letters."""
    prices, node, letters = converged_prices(codes), 0, []
    last = 4 * len(codes)
    while not (node >= last and node - last in ENDS):
        letter, node = next((x, to) for x, cost, to in arcs(codes, node) if cost + prices[to] == prices[node])
        letters.append(letter)
    return prices[0], "".join(letters)


def _digest() -> Column:
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))


AUDIT = "conv_id long, messages long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Conversation:
    """Counts and codes of the messages seen so far."""

    def __init__(self, conv_id):
        self.conv_id, self.codes = conv_id, bytearray()
        self.first = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None

    def add(self, turn, initial, blank, again, cut):
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.turn
            self.turn = turn
        fault = 0
        if blank:
            self.blank, fault = self.blank + 1, MUST_GO
        elif again:
            self.duplicate, fault = self.duplicate + 1, MUST_GO
        elif cut:
            self.truncated, fault = self.truncated + 1, CUT_OFF
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.codes.append(INITIALS.get(initial, 0) | fault)

    def row(self):
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.turns
        return (self.conv_id, len(self.codes), gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest_edits(bytes(self.codes)))


def audits(messages: DataFrame) -> DataFrame:
    """One row of AUDIT for each conversation of ``messages`` (conv_id, turn, role, text).

    Texts do not travel: what counts of them is told before.  Messages go by turn, those without one first, equal turns by
    a digest of role and text; all without conv_id are one conversation.  Null roles and texts count as one space.
    """
    import pyarrow as pa

    m = _plain(messages)
    kept = F.rtrim("text", F.lit(WHITE))
    facts = m.select(
        "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), (kept == "").alias("blank"), _digest().alias("digest"),
        F.coalesce(~F.substring(kept, -1, 1).isin(".", "!", "?"), F.lit(False)).alias("cut"),
    )
    again = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    facts = facts.repartition("conv_id").withColumn("again", again).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest", "again")
    names = [c.split()[0] for c in AUDIT.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in AUDIT.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        now = None
        for b in batches:
            done = []
            for conv_id, *rest in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "blank", "again", "cut"))):
                if now is None or now.conv_id != conv_id:
                    done += [now.row()] if now else []
                    now = _Conversation(conv_id)
                now.add(*rest)
            if done:
                yield batch(done)
        if now:
            yield batch([now.row()])

    return facts.mapInArrow(run, AUDIT)


def _plain(messages: DataFrame) -> DataFrame:
    space = F.lit(" ")
    return messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


EDITED = "conv_id long, place long, edit string, role string, text string"


def edited(messages: DataFrame, found: DataFrame) -> DataFrame:
    """The edits of ``found`` (of ``audits``) done on ``messages``: EDITED, one row for each letter, deleted messages too.

    Rows of a conversation follow one another in one partition, in the order of place.
    """
    import pyarrow as pa

    m = _plain(messages).withColumn("digest", _digest())
    heads = found.select("conv_id", F.col("audit"), *(F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("digest", "string"), ("role", "string"), ("text", "string"))))
    rows = m.withColumn("audit", F.lit(None).cast("string")).unionByName(heads).repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "digest")
    names = [c.split()[0] for c in EDITED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        conv_id, letters, place, state = None, "", 0, 0

        def inserted():
            nonlocal place, state
            while place < len(letters) and letters[place] == "I":
                yield conv_id, place, "I", DUE[state], ""
                place, state = place + 1, NEXT[state]

        for b in batches:
            out = []
            for key, audit, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
                if audit is not None:
                    out += inserted()
                    conv_id, letters, place, state = key, audit, 0, 0
                    continue
                out += inserted()
                letter = letters[place]
                after = state
                if letter == "K":
                    after = KEPT[INITIALS[role[:1]]][1]
                elif letter == "R":
                    role, after = DUE[state], NEXT[state]
                out.append((conv_id, place, letter, role, text))
                place, state = place + 1, after
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        if out := [*inserted()]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(run, EDITED)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the rows of ``edited`` as they come: SHA-256 of ``role:text``, joined by line feeds."""
    import pyarrow as pa

    def run(batches):
        conv_id, sha, any_yet, started = None, None, False, False

        def batch(done):
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([y for _, y in done], pa.string())], ["conv_id", "repaired_sha256"])

        for b in batches:
            done = []
            for key, place, edit, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "place", "edit", "role", "text"))):
                if place == 0:
                    done += [(conv_id, sha.hexdigest())] if started else []
                    conv_id, sha, any_yet, started = key, hashlib.sha256(), False, True
                if edit != "D":
                    sha.update(f"{chr(10) if any_yet else ''}{role}:{text}".encode())
                    any_yet = True
            if done:
                yield batch(done)
        if started:
            yield batch([(conv_id, sha.hexdigest())])

    return rows.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits, edited rows) of ``messages`` (conv_id, turn, role, text): structure faults, and the cheapest edits to a sound structure.

    Sound roles are an optional system message, then user and assistant in turns, at least once, or nothing at all.  A blank
    message or one seen earlier in its conversation must go; one cut off costs more to hold.  Order, nulls and repeated rows as
    in ``audits``.  An empty table gives empty results; other columns are not read.
    """
    found = materialize(audits(messages), "audits")
    return found, edited(messages, found)


def damaged(messages: DataFrame) -> DataFrame:
    """``messages`` with the faults that the CRC of ``conv_id:turn`` picks: dropped, emptied, cut off, repeated, or given to the user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    m = messages.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("h"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text")
    twice = m.where("h <> 0").select("conv_id", "turn", role, text, F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy"))
    return twice.drop("copy")


NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def op12_repair(spark, sf_dir) -> DataFrame:
    """One row for each conv_id of ``conversations``, null too; one without messages after the damage has zeros, no edits and the hash of nothing."""
    given = table(spark, sf_dir, "conversations")
    found, rows = repair(damaged(given))
    ids = given.select(F.col("conv_id").cast("long").alias("id")).distinct()
    known = found.withColumnRenamed("conv_id", "_a").join(digests(rows).withColumnRenamed("conv_id", "_b"), F.col("_a").eqNullSafe(F.col("_b")), "left")
    # a conversation without messages has no row on this side; a null conv_id may have one
    out = ids.join(known, F.col("id").eqNullSafe(F.col("_a")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in NUMBERS]
    nothing = hashlib.sha256().hexdigest()
    return out.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


OP12_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [0,0,0,0,0,0,0,0]::BIGINT[]),
           lambda a, x: CASE WHEN a % 2 = 1 THEN xor(3988292384::BIGINT, a // 2) ELSE a // 2 END) AS c
    FROM range(256) r(i))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), hashed AS (
  SELECT conv_id, turn, role, text, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(key)), lambda i: ascii(substr(key, i + 1, 1))::BIGINT)),
    lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1]))) % 20 AS h
  FROM keyed CROSS JOIN crc_table
), ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST) AS c FROM (SELECT DISTINCT conv_id FROM conversations)
), damaged AS (
  SELECT c, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed JOIN ids ON hashed.conv_id IS NOT DISTINCT FROM ids.conv_id
), told AS (
  SELECT c, turn, role, text, left(role, 1) AS initial, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS trimmed,
    row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) - 1 AS n FROM damaged
), seen AS (SELECT *, n > min(n) OVER (PARTITION BY c, role, text) AS again FROM told
), m AS (
  SELECT c, n, turn, role, text, initial, trimmed = '' AS blank, trimmed <> '' AND again AS duplicate, trimmed = '' OR again AS must,
    trimmed <> '' AND NOT again AND right(trimmed, 1) NOT IN ('.', '!', '?') AS cut, CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS k,
    lag(initial) OVER (PARTITION BY c ORDER BY n) AS before FROM seen
), counts AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (cut) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY c
), ahead(c, i, v) AS (
  SELECT c, n, [0, 6, 3, 0]::BIGINT[] FROM counts
  UNION ALL
  SELECT c, n, [least(b[1], 3 + b[3], 6 + b[4]), least(b[2], 3 + b[3], 6 + b[4]), least(b[3], 3 + b[4], 6 + b[3]), least(b[4], 3 + b[3], 6 + b[4])]
  FROM (SELECT m.c, m.n, list_transform([1, 2, 3, 4], lambda q: least(4 + v[q],
      CASE WHEN must THEN 1000000000000 ELSE 3 + (CASE WHEN cut THEN 3 ELSE 0 END) + v[[3, 3, 4, 3][q]] END,
      CASE WHEN must OR NOT ((k = 1 AND q = 1) OR (k = 2 AND q <> 3) OR (k = 3 AND q = 3)) THEN 1000000000000 ELSE (CASE WHEN cut THEN 3 ELSE 0 END) + v[k + 1] END)) AS b
    FROM ahead JOIN m ON m.c = ahead.c AND m.n = ahead.i - 1)
), traced(c, i, q, audit, lines) AS (
  SELECT c, 0::BIGINT, 1, '', []::VARCHAR[] FROM counts
  UNION ALL
  SELECT c, CASE WHEN letter = 'I' THEN i ELSE i + 1 END, CASE letter WHEN 'D' THEN q WHEN 'K' THEN k + 1 ELSE [3, 3, 4, 3][q] END, audit || letter,
    CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
      ELSE list_append(lines, (CASE WHEN q = 3 THEN 'assistant' ELSE 'user' END) || ':' || (CASE WHEN letter = 'I' THEN '' ELSE text END)) END
  FROM (SELECT t.*, m.role, m.text, m.k, CASE
      WHEN m.n IS NOT NULL AND 4 + w.v[q] = u.v[q] THEN 'D'
      WHEN 3 + u.v[[3, 3, 4, 3][q]] = u.v[q] THEN 'I'
      WHEN NOT must AND ((k = 1 AND q = 1) OR (k = 2 AND q <> 3) OR (k = 3 AND q = 3)) AND (CASE WHEN cut THEN 3 ELSE 0 END) + w.v[k + 1] = u.v[q] THEN 'K'
      ELSE 'R' END AS letter
    FROM traced t JOIN ahead u ON u.c = t.c AND u.i = t.i LEFT JOIN ahead w ON w.c = t.c AND w.i = t.i + 1 LEFT JOIN m ON m.c = t.c AND m.n = t.i
    WHERE m.n IS NOT NULL OR q IN (2, 3))
), ended AS (SELECT traced.c, audit, lines FROM traced JOIN counts ON counts.c = traced.c AND i = n WHERE q IN (1, 4))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counts USING (c) LEFT JOIN ended USING (c) LEFT JOIN (SELECT c, v FROM ahead WHERE i = 0) USING (c)
"""
