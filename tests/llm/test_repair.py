"""Repair of conversations against every string of edits, and the query against plain loops and its SQL."""

import hashlib
import itertools
import random
import re
import zlib

from oracle import same

from flightlake.llm import repair

SOUND = re.compile(r"(s?(ua)+)?")


def every_repair(rows, most_inserts=3):
    """(cost, letters, lines) of the cheapest edits of (role, text) rows, by trying all of them."""
    seen, must, cut = set(), [], []
    for r in rows:
        kept = r[1].strip("\t\n\x0b\f\r ")
        must.append(not kept or r in seen)
        cut.append(not must[-1] and kept[-1] not in ".!?")
        seen.add(r)
    best = None
    for inserts in range(most_inserts + 1):
        for spots in itertools.combinations_with_replacement(range(len(rows) + 1), inserts):
            options = []
            for i in range(len(rows) + 1):
                options += [[("I", x) for x in ("user", "assistant")]] * spots.count(i)
                if i < len(rows):
                    options.append([("D", i)] + ([] if must[i] else [("K", i), ("user", i), ("assistant", i)]))
            for pick in itertools.product(*options):
                cost, roles, letters, lines = 0, "", "", []
                for kind, x in pick:
                    if kind == "D":
                        cost, letters = cost + 4, letters + "D"
                    elif kind == "I":
                        cost, letters, roles = cost + 3, letters + "I", roles + x[0]
                        lines.append(f"{x}:")
                    else:
                        role = rows[x][0] if kind == "K" else kind
                        cost += (0 if kind == "K" else 3) + 3 * cut[x]
                        letters, roles = letters + ("K" if kind == "K" else "R"), roles + (role[:1] or "-")
                        lines.append(f"{role}:{rows[x][1]}")
                if SOUND.fullmatch(roles) and (best is None or (cost, letters) < best[:2]):
                    best = (cost, letters, lines)
    return best


def codes(rows):
    seen, out = set(), bytearray()
    for role, text in rows:
        kept = text.strip("\t\n\x0b\f\r ")
        must = not kept or (role, text) in seen
        seen.add((role, text))
        out.append(repair.INITIALS.get(role[:1], 0) | (repair.MUST_GO if must else 0) | (repair.CUT_OFF if not must and kept[-1] not in ".!?" else 0))
    return bytes(out)


def made(rng, n):
    return [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), rng.choice(["Yes.", "No!", "cut off", " \n", "Why? ", "a."])) for _ in range(n)]


def test_auction_equals_every_string_of_edits():
    rng = random.Random(4)
    for n in (0, 1, 1, 2, 2, 2, 3, 3, 3, 3, 4, 4):
        for _ in range(4):
            rows = made(rng, n)
            assert repair.cheapest_edits(codes(rows)) == every_repair(rows, 3 if n < 4 else 2)[:2], rows


def test_prices_equal_a_sweep_from_the_end():
    rng = random.Random(6)
    for n in (0, 1, 5, 40, 300):
        line = codes(made(rng, n))
        want = [10**9] * (4 * n + 4)
        for place in range(n, -1, -1):
            at = range(4 * place, 4 * place + 4)
            if place == n:
                want[4 * n], want[4 * n + 3] = 0, 0
            for _ in range(4):
                for node in at:
                    want[node] = min([want[node]] + [cost + want[to] for _, cost, to in repair.arcs(line, node)])
        assert repair.converged_prices(line).tolist() == want


def test_long_conversations_take_linear_time(monkeypatch):
    calls = []
    plain = repair.arcs
    monkeypatch.setattr(repair, "arcs", lambda c, node: calls.append(0) or plain(c, node))
    for n in (1000, 2000):
        calls.clear()
        cost, letters = repair.cheapest_edits(codes(made(random.Random(1), n)))
        assert len(calls) < 40 * n and len(letters) >= n


def by_hand(data):
    """Rows of op12 for (conv_id, turn, role, text) rows with distinct turns, by plain loops over short conversations."""
    out = {}
    for c in {r[0] for r in data}:
        rows = []
        for _, turn, role, text in sorted((r for r in data if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0)):
            role, text = role if role is not None else " ", text if text is not None else " "
            h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if h:
                row = (turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
                rows += [row] * (2 if h == 3 else 1)
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [r[1:] for r in rows]
        line = codes(pairs)
        blank = sum(not t.strip("\t\n\x0b\f\r ") for _, t in pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        cost, letters, lines = every_repair(pairs) if len(pairs) < 4 else (*repair.cheapest_edits(line), None)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest() if lines is not None else None
        out[c] = (gaps, blank, sum(bool(x & repair.MUST_GO) for x in line) - blank, sum(bool(x & repair.CUT_OFF) for x in line), illegal, cost, letters, sha)
    return out


SCHEMA = "conv_id long, turn long, role string, text string, audit string"


def of(spark, data, tmp_path):
    spark.createDataFrame([(*r, "x") for r in data], SCHEMA).repartition(2).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return repair.op12_repair(spark, str(tmp_path))


def test_query_with_nulls_empties_and_other_roles(spark, tmp_path):
    rng = random.Random(9)
    data = [(c, t, *x) for c in range(60) for t, x in enumerate(made(rng, rng.randint(1, 3)))]
    gone = next(c for c in range(200, 400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    data += [(gone, 0, "user", "Hello."), (None, 1, "user", "Hello."), (None, None, "assistant", None), (100, None, None, "x."), (101, 5, "user", "Long. " * 30_000), (101, 9, "assistant", "ok."), (1 << 60, 1, "system", "é😀.")]
    got = {r.conv_id: tuple(r)[1:] for r in of(spark, data, tmp_path).collect()}
    want = by_hand(data)
    assert got.keys() == want.keys()
    for c, w in want.items():
        assert got[c][:7] == w[:7] and (w[7] is None or got[c][7] == w[7]), (c, got[c], w)
    assert want[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_query_equals_sql_on_odd_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(10)
    data = [(c, t * 2, *x) for c in range(50) for t, x in enumerate(made(rng, rng.randint(1, 9)))]
    data += [(None, None, None, None), (70, None, "user", "\x0b"), (70, 3, "user", "ü?\t")]
    df = of(spark, data, tmp_path)
    import oracle

    monkeypatch.setattr(oracle, "TABLES", ["conversations"])
    same(df, repair.OP12_SQL, str(tmp_path))


def test_repeated_rows_and_tables_without_rows(spark, tmp_path):
    rows = [(1, 2, "user", "Again."), (1, 2, "user", "Again."), (1, 3, "assistant", "Ok.")]
    found, edited = repair.repair(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    assert [(r.duplicate, r.audit, r.cost, r.gaps) for r in found.collect()] == [(1, "KDK", 4, 0)]
    assert [(r.place, r.edit, r.role, r.text) for r in edited.collect()] == [(0, "K", "user", "Again."), (1, "D", "user", "Again."), (2, "K", "assistant", "Ok.")]
    assert of(spark, [], tmp_path).count() == 0


def test_the_first_of_equal_messages_stays(spark):
    """Many messages repeated in the same turn: the later copy is the duplicate, whatever order the rows come in."""
    rows = [(c, t, role, f"{t} {role} {c}.") for c in range(80) for t, role in enumerate(["user", "assistant"] * 3) for _ in range(3)]
    random.Random(5).shuffle(rows)
    found, _ = repair.repair(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(7))
    assert {(r.audit, r.cost, r.duplicate) for r in found.collect()} == {("KDD" * 6, 48, 12)}


def test_one_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(c, t, *x, "x") for c in (1, 2) for t, x in enumerate(made(random.Random(c), 40))]
        found, edited = repair.repair(spark.createDataFrame(rows, SCHEMA))
        letters = {r.conv_id: r.audit for r in found.collect()}
        seen: dict = {}
        for r in sorted(edited.collect(), key=lambda r: (r.conv_id, r.place)):
            seen[r.conv_id] = seen.get(r.conv_id, "") + r.edit
        assert seen == letters == {c: repair.cheapest_edits(codes([r[2:4] for r in rows if r[0] == c]))[1] for c in (1, 2)}
        assert repair.digests(edited).count() == 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query_equals_sql(spark, sf):
    same(repair.op12_repair(spark, sf), repair.OP12_SQL, sf)


def test_sound_conversations_stay():
    assert repair.cheapest_edits(codes([("user", "A."), ("assistant", "B.")])) == (0, "KK")
    assert repair.cheapest_edits(codes([("system", "S."), ("user", "A."), ("assistant", "B.")])) == (0, "KKK")
