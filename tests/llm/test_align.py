import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from locations import SF_SMALL
from textaudit.llm import align as A
from textaudit.llm.frames import documents

PATH_A, PATH_B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]


@pytest.fixture(scope="module")
def tokens():
    """Ids and bytes of both libraries, each by itself."""
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    letters = {c: bytes([i]) for i, c in enumerate(A._byte_letters())}
    b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)

    def spelled(piece):
        if len(piece) == 6 and piece.startswith("<0x"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def run(text):
        if not text:
            return [], []
        whole = (" " + text).encode()
        ea = a.encode(" " + text, add_special_tokens=False)
        pa = [(i, b"".join(letters[c] for c in t)) for i, t in zip(ea.ids, ea.tokens)]
        pb = [(i, spelled(b.id_to_piece(i))) for i in b.encode(text)]
        return (pa, pb) if all(b"".join(x for _, x in p) == whole for p in (pa, pb)) else ([], [])

    return run


def brute(rows, tokens):
    """Links by comparing every two tokens' groups and byte ranges."""
    held, docs = Counter(), []
    for doc, text in rows:
        spans = []
        for side in tokens(text):
            at, out = 0, []
            for i, raw in side:
                out.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        group = lambda t: next(k for k, e in enumerate(ends) if t[2] <= e)
        ga, gb = ([group(t) for t in s] for s in spans)
        links = [(x[0], y[0]) for x, g in zip(spans[0], ga) for y, k in zip(spans[1], gb) if g == k]
        overlaps = sum(x[1] < y[2] and y[1] < x[2] for x in spans[0] for y in spans[1])
        text_groups = [",".join(str(t[0]) for t, g in zip(spans[0], ga) if g == k) + "|" + ",".join(str(t[0]) for t, g in zip(spans[1], gb) if g == k) for k in range(len(ends))]
        held.update(set(links))
        docs.append((doc, len(spans[0]), len(spans[1]), len(ends), links, overlaps, ";".join(text_groups)))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return sorted(((d, na, nb, ng, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(g.encode()).hexdigest() if na else "", over) for d, na, nb, ng, links, over, g in docs), key=str)


def run(df):
    return sorted(map(tuple, A.align(df, ["doc_id"], PATH_A, PATH_B).select(*COLUMNS).collect()), key=str)


def test_sparse_products_equal_dense_ones(monkeypatch):
    rng = np.random.default_rng(5)
    for strip in (1, 7, 1 << 20):
        monkeypatch.setattr(A, "EXPANDED", strip)
        for _ in range(40):
            n, k, m = rng.integers(1, 9, 3)
            x, y = rng.integers(0, 3, (n, k)), rng.integers(0, 3, (k, m))
            left, right = (A.gathered(*np.nonzero(d), *d.shape, d[np.nonzero(d)]) for d in (x, y))
            dense = np.zeros((n, m), np.int64)
            for first, rows in A.product(left, right):
                dense[rows.of() + first, rows.index] = rows.data
            assert (dense == x @ y).all()
            back = right.transposed()
            turned = np.zeros((m, k), np.int64)
            turned[back.of(), back.index] = back.data
            assert (turned == y.T).all()


def test_links_by_occurrence_and_by_id_agree():
    a, b = A.Vocabulary(PATH_A), A.Vocabulary(PATH_B)
    one = A.Aligned(["the unbelievable cats", None, "", "naïve café 漢字 \n\n x", "aaaaaaaaaaaaa bbbbb"], a, b)
    by_id = Counter()
    for doc, left, right, times in one.links():
        for d, x, y, t in zip(doc, left, right, times):
            by_id[int(d), int(x), int(y)] += int(t)
    by_token = Counter()
    for left, right in one.token_links():
        for x, y in zip(left, right):
            by_token[int(one.doc[0][x]), int(one.ids[0][x]), int(one.ids[1][y])] += 1
    assert by_id == by_token
    # tokens that share bytes share a group
    shared = {(int(x), int(y)) for i, j in one.token_links() for x, y in zip(i, j)}
    assert {(int(x), int(y)) for i, j, _ in one.overlaps() for x, y in zip(i, j)} <= shared


def test_random_texts_equal_brute_force(table, tokens, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_BYTES", 200)
    monkeypatch.setattr(A, "EXPANDED", 50)
    rnd = random.Random(2)
    bits = ["the ", "un", "believ", "able ", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "▁", "  ", "\n", "\t", "é", "é", "漢", "😀", "\x00", "ﬁ", " ", "aaaa", "=-", "1234", " a"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "the the"), (202, "the the"), (202, "the the"), (203, " "), (204, "ab" * 300), (205, "x" + "ab" * 40)]
    assert run(table(rows, "doc_id bigint, text string")) == brute(rows, tokens)


def test_whole_table_equals_brute_force(spark, tokens):
    docs = documents(spark, SF_SMALL).where("length(text) < 3000")
    assert run(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], tokens)


def test_chunks_join_to_the_text_and_tokens_do_not_cross_them():
    assert A.chunks("a bc  d\n e ") == ["a", "bc", " d\n e "] and A.chunks("x ") == ["x "] and A.chunks(" x") == [" x"]
    rnd = random.Random(9)
    a, b = A.Vocabulary(PATH_A), A.Vocabulary(PATH_B)
    for _ in range(400):
        text = "".join(rnd.choice(["the", "un", " ", " ", "  ", "\n", "\t", "é", ",", "'s", "1", "\u2003", "\x1c", "漢", "=="]) for _ in range(rnd.randint(1, 20)))
        cut = A.chunks(text)
        assert " ".join(cut) == text
        for v in (a, b):
            whole, parts = v.encode([text])[0].tolist(), v.encode(cut)[0].tolist()
            assert whole == parts, (text, cut)


def test_chunks_are_forgotten_when_there_are_many(monkeypatch):
    monkeypatch.setattr(A, "REMEMBERED", 50)
    monkeypatch.setattr(A, "SLICE_BYTES", 30)
    known = A.Chunks(A.Vocabulary(PATH_A), A.Vocabulary(PATH_B))
    texts = [f"word{i} again and again naïve{i}" for i in range(40)]
    whole = A.Chunks(known.a, known.b).aligned(texts)
    parts = [known.aligned(texts[i:i + 5]) for i in range(0, 40, 5)]
    for c in ("n_a", "n_links", "n_overlaps", "pairs", "times"):
        assert np.concatenate([p[c] for p in parts]).tolist() == whole[c].tolist()
    assert sum((p["groups_sha256"] for p in parts), []) == whole["groups_sha256"]
    one = A.Aligned(texts[:5], known.a, known.b)  # the texts uncut
    assert [hashlib.sha256(t).hexdigest() for t in one.written()] == whole["groups_sha256"][:5]
    assert sum(len(x) for x, _, _ in one.overlaps()) == whole["n_overlaps"][:5].sum()


def test_empty_table_and_clashing_columns(table, tokens):
    assert run(table([], "doc_id bigint, text string")) == []
    df = table([(1, "a cat", "x", 7), (2, "a dog", "y", 8)], "doc_id bigint, text string, TEXT string, N_A int")
    got = A.align(df, ["doc_id", "TEXT", "N_A"], PATH_A, PATH_B)
    assert "N_A" not in got.columns and got.columns.count("TEXT") == 1
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=str) == brute([(1, "a cat"), (2, "a dog")], tokens)


def test_a_long_group_of_repeats_costs_its_distinct_ids():
    a, b = A.Vocabulary(PATH_A), A.Vocabulary(PATH_B)
    one = A.Aligned(["x" + "ab" * 20_000], a, b)
    entries = sum(len(t) for *_, t in one.links())
    assert entries < 1000
    sizes = np.bincount(one.group[0]), np.bincount(one.group[1])
    assert sum(int(t.sum()) for *_, t in one.links()) == int((sizes[0] * sizes[1]).sum())
