"""Alignment of two tokenizers against one text at a time, and merges in levels against one level."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from flightlake.llm import alignment
from flightlake.llm.bpe import byte_alphabet

given = pytest.importorskip("public_tokenizers")
A, B = given.path("byte_bpe_50k.json"), given.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n b", "a\n  b ", "\ta\t\tb  ", "one two  three", "<|endoftext|> x", "<s> </s>", "a▁b", "▁ a", "x\xa0 y", "x\x1c y",
    "a\r\n b", "é́ ü", "naïve — “quoted” 中文 字", "😀😀 👩‍👩‍👧", "a\0b \0", "def f(x):\n    return x\n", "A" * 300, "中" * 200, "don't we'll 123 4567", "٣ ½ ²",
]


def by_hand(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text, with plain loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = byte_alphabet()

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    rows, documents, best = [], Counter(), Counter()
    for text in texts:
        groups = []
        if text:
            x = a.encode(" " + text, add_special_tokens=False).ids
            y = b.encode(text)
            bytes_x = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in x]
            bytes_y = [piece(i) for i in y]
            if b"".join(bytes_x) == b"".join(bytes_y) == b" " + text.encode():
                i = j = end_x = end_y = 0
                group = ([], [])
                while i < len(x) or j < len(y):
                    if end_x <= end_y:
                        group[0].append(x[i])
                        end_x += len(bytes_x[i])
                        i += 1
                    else:
                        group[1].append(y[j])
                        end_y += len(bytes_y[j])
                        j += 1
                    if end_x == end_y:
                        groups.append(group)
                        group = ([], [])
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        documents.update(set(links))
        rows.append((groups, links))
    for (p, _), n in documents.items():
        best[p] = max(best[p], n)
    out = []
    for groups, links in rows:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        n_best = sum(documents[x] == best[x[0]] for x in links)
        out.append(
            (sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links), n_best, sum(documents[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else "")
        )
    return out


def made_texts(n, seed=5):
    rng = random.Random(seed)
    words = ["the", "cat", "sat", "Straße", "naïve", "\n", " ", "", "\t", "12", "x=y;", "中文", "😀", "ing", "Über", "don't", "...", "\xa0", "a\nb", "token", "ization"]
    return [rng.choice([" ", "", "  "]).join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def rows_of(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.parametrize("sizes", [{}, {"run_chars": 150, "radix": 3, "fan_in": 2}, {"run_chars": 1, "radix": 1, "fan_in": 3}])
def test_alignment_equals_loops(spark, sizes):
    texts = ODD + made_texts(120)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = Counter((i, *x) for i, x in enumerate(by_hand(texts)))
    assert rows_of(alignment.align(df, "doc_id", "text", A, B, **sizes)) == want


def test_query_equals_loops(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(alignment.op11_alignment(spark, sf)) == Counter((i, *x) for (i, _), x in zip(docs, by_hand([t for _, t in docs])))


def test_nulls_repeats_and_clashing_columns(spark):
    schema = "run long, n_a string, doc_id long, text string"
    data = [(1, "x", 7, None), (1, "x", 7, ""), (2, "y", None, "one two"), (2, "y", 3, "one two"), (2, "y", 3, "one two"), (3, "z", 9, "word " * 30_000), ((1 << 60) + 1, "z", (1 << 60) + 1, "")]
    got = rows_of(alignment.align(spark.createDataFrame(data, schema), "doc_id", "text", A, B))
    assert got == Counter((r[2], *x) for r, x in zip(data, by_hand([r[3] for r in data])))
    assert alignment.align(spark.createDataFrame([], schema), "doc_id", "text", A, B).count() == 0


def test_wide_groups_are_counted_not_expanded():
    import numpy as np

    pair = alignment.Pair(open(A, "rb").read(), open(B, "rb").read())
    # 200 single bytes of one side against 100 pairs of bytes of the other, joined by one last token across an odd place
    a = [pair.bytes_a.index(b"a")] * 201
    b = [pair.bytes_b.index(b"aa")] * 100 + [pair.bytes_b.index(b"a", 259)]
    g = alignment.Groups(pair, [(np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes())])
    links = defaultdict(int)
    for i in range(len(g.links)):
        for p in range(g.from_a[i], g.from_a[i] + g.in_a[i]):
            for q in range(g.from_b[i], g.from_b[i] + g.in_b[i]):
                links[int(g.a[p]) << alignment.ID_BITS | int(g.b[q])] += 1
    for most in (alignment.WIDE_GROUP, 1):
        before, alignment.WIDE_GROUP = alignment.WIDE_GROUP, most
        try:
            pairs, doc, times = g.records()
        finally:
            alignment.WIDE_GROUP = before
        assert dict(zip(pairs.tolist(), times.tolist())) == links and not doc.any()


def test_merge_walks_first_ids_in_order():
    import numpy as np

    rng = random.Random(3)
    runs, want = [], Counter()
    for _ in range(9):
        pairs = sorted(rng.sample(range(6), rng.randint(0, 6)))
        keys = np.array([(p % 3) << alignment.ID_BITS | p for p in pairs], np.int64)
        keys.sort()
        n = np.array([rng.randint(1, 5) for _ in pairs], np.int64)
        runs.append((keys, n))
        want.update(dict(zip(keys.tolist(), n.tolist())))
    found = [(int(p), int(c)) for pairs, counts, _ in alignment.merge(runs) for p, c in zip(pairs, counts)]
    assert found == sorted(want.items())
