"""Vectors, tries and alignments against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import align, caps, trie
from assaylake.llm.queries import rebuilt, tokenizer_path

BYTE, PIECE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def reached(n, pairs):
    """Smallest node reachable from each."""
    top = list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# ------------------------------------------------------------------------------------------ vectors


def near(seed, base, cosine):
    rng = np.random.default_rng(seed)
    g = rng.standard_normal(len(base))
    base = base / np.linalg.norm(base)
    g -= g @ base * base
    return cosine * base + np.sqrt(1 - cosine * cosine) * g / np.linalg.norm(g)


@pytest.fixture(scope="module")
def vectors():
    """(id, vector): scattered ones, pairs, a chain, a large tight group, a wide group, copies and odd ones."""
    rng = np.random.default_rng(9)
    rows = [rng.standard_normal(24) for _ in range(300)]
    rows += [near(k, rows[k], 0.95) for k in range(40)]
    link = rows[50]
    for k in range(12):
        link = near(1000 + k, link, 0.93)
        rows.append(link)
    rows += [near(2000 + k, rows[60], 0.99) for k in range(150)]
    rows += [near(3000 + k, rows[61], 0.955) for k in range(60)]
    rows += [rows[62]] * 30 + [rows[63] * 5.0, rows[64] * 1e-30]
    return rows


def test_vectors_link_as_brute_force(spark, vectors):
    x = np.array(vectors)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near_pairs = np.argwhere(np.triu(x @ x.T >= 0.9, 1))
    n = len(vectors)
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0]]
    data = [(100 + i, [float(v) for v in row]) for i, row in enumerate(vectors)] + [(5000 + i, v) for i, v in enumerate(odd)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("own")).repartition(5)
    got = {r.vec_id: r for r in caps.groups(frame).collect()}
    assert len(got) == len(data) and all(r.n_links == "own" for r in got.values())
    links = Counter(near_pairs.ravel().tolist())
    component = reached(n, near_pairs.tolist())
    assert [got[100 + i].caps.n_links for i in range(n)] == [links[i] for i in range(n)]
    assert [got[100 + i].caps.component_id for i in range(n)] == [100 + c for c in component]
    assert all(r.caps.kept == (r.caps.component_id == r.vec_id) for r in got.values())
    assert all(got[5000 + i].caps.asDict() == {"n_links": 0, "component_id": 5000 + i, "kept": True} for i in range(len(odd)))


def test_vectors_repeated_and_null_ids(spark):
    v, w = [1.0, 0.0, 0.2], [0.0, 1.0, 0.1]
    rows = [(1, v), (1, v), (None, v), (None, w), (2, w), (3, None)]
    got = sorted(caps.groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect(), key=str)
    assert sorted((r.vec_id or 0, r.caps.n_links, r.caps.component_id, r.caps.kept) for r in got) == [
        (0, 1, 2, False), (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 2, True), (3, 0, 3, True)
    ]
    assert caps.groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("dim,rows", [(8, 3000), (64, 50_000), (64, 10_000_000)])
def test_filters_find_pairs_at_the_limit(dim, rows):
    rng = np.random.default_rng(1)
    code = caps.code_for(dim, rows, 0.9)
    x = rng.standard_normal((600, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.stack([near(i, v, 0.9001) for i, v in enumerate(x)])
    (r, f, lean), (s, g, _) = code.filters(x), code.filters(y)
    assert (lean >= code.lean).all()
    share = set(zip(r.tolist(), f.tolist())) & set(zip(s.tolist(), g.tolist()))
    assert len({i for i, _ in share}) / len(x) > 0.93
    # The list of filters is whole: every direction that a vector leans to is decoded.
    size = len(code.words[0][0])
    for table, (signs, words) in enumerate(zip(code.signs, code.words)):
        if len(words) != 2 or table > 2:
            break
        z = (x[:20] * signs) @ code.turn
        cut = words[0].shape[1]
        every = (z[:, :cut] @ words[0].T)[:, :, None] + (z[:, cut:] @ words[1].T)[:, None, :]
        want = {(i, table * size * size + a * size + b) for i, a, b in np.argwhere(every >= code.lean + 1e-12).tolist()}
        assert want <= set(zip(r.tolist(), f.tolist()))


# ------------------------------------------------------------------------------------------ tries


def plain_trie(rows):
    """The nodes of the rebuilt conversations, walked one by one."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), role, text[:trie.TIE_CHARACTERS], digest, text))
    own = {c: [(r, t) for _, r, _, _, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c / 5) * 5
        whole[c] = own.get(c - base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for seq, convs in members.items():
        below = [s for s in members if s[:len(seq)] == seq]
        children = [s for s in below if len(s) == len(seq) + 1]
        leaves = [s for s in below if not any(len(x) == len(s) + 1 and x[:len(s)] == s for x in members)]
        saved = sum((len(members[s]) - 1) * len(s[-1][1].encode()) for s in below if s)
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(seq))
        out.append((
            min(convs), len(seq), min(members[seq[:-1]]) if seq else None, len(convs), len(children), len(leaves), saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def found_trie(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("own")).repartition(4)
    names = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    return sorted((tuple(r[c] for c in names) for r in trie.nodes(*rebuilt(frame)).collect()), key=str)


def test_trie_of_small_families(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(-7, 24), 40, 43, 1001]:
        for t in range(rng.choice([1, 2, 3, 9, 12])):
            rows.append((c, rng.choice([None, t, t]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", None, "xy" * 50])))
    rows += [(None, 1, "user", "lost"), rows[3], rows[3]]
    assert found_trie(spark, rows) == plain_trie(rows)


def test_trie_of_one_long_chain_and_a_wide_root(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_TURNS", 7)
    monkeypatch.setattr(trie, "IDS_AT_ONCE", 10)
    rows = [(5, t, "user", f"t{t % 3}") for t in range(90)] + [(c, 0, "user", f"only {c % 4}") for c in range(100, 180)]
    assert found_trie(spark, rows) == plain_trie(rows)


def test_empty_trie(spark):
    assert found_trie(spark, []) == []


def test_totals_of_a_random_forest(spark):
    rng = random.Random(2)
    parent = [None if i in (0, 1) else rng.choice([i - 1, max(0, i - 2), rng.randrange(i)]) for i in range(300)]
    value = [rng.randrange(100) for _ in parent]
    total = value[:]
    for i in reversed(range(300)):
        if parent[i] is not None:
            total[parent[i]] += total[i]
    rows = [(i, p, v, 1) for i, (p, v) in enumerate(zip(parent, value))]
    got = trie.subtree_totals(spark.createDataFrame(rows, "node long, parent long, x long, y long"), ["x", "y"]).collect()
    assert {r.node: r.x for r in got} == dict(enumerate(total)) and len(got) == 300


# ------------------------------------------------------------------------------------------ alignments


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(tokenizer_path(BYTE))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE))


def plain_tokens(libraries, text):
    """(id, first byte, end) of both tokenizers over a space and the text, or None."""
    if not text:
        return None
    first, second = libraries
    letters = align._letter_bytes()
    a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in first.encode(f" {text}", add_special_tokens=False).ids]
    b = [
        (i, bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode())
        for i in second.encode(text)
    ]
    if any(b"".join(x for _, x in side) != f" {text}".encode() for side in (a, b)):
        return None
    out = []
    for side in (a, b):
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def plain_alignment(tokens):
    if tokens is None:
        return 0, 0, 0, "", Counter()
    a, b = tokens
    links = Counter((i, j) for i, x, y in a for j, u, v in b if max(x, u) < min(y, v))
    groups, low = [], 0
    for cut in sorted({y for _, _, y in a} & {v for _, _, v in b}):
        sides = [",".join(str(i) for i, x, y in side if low <= x and y <= cut) for side in (a, b)]
        groups.append("|".join(sides))
        low = cut
    return len(a), len(b), len(groups), ";".join(groups), links


BITS = [
    "a", "b", "the", "ing", " ", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "'", "don't", "1", "23", "é", "Ü", "文", "😀", "\xa0",
    "\x1c", "\x85", "　", "²", "Ⅷ", "_", "<|endoftext|>", "<s>", "<0x0A>", "\x00", "́", "://", "#", "*", "\r", "\x0b", "ñ", "​",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    return [None, "", " ", "▁", "x▁y", "\n", *["".join(rng.choice(BITS) for _ in range(rng.randint(1, 25))) for _ in range(600)]]


@pytest.mark.parametrize("steps", [1, 5, 1 << 16])
def test_merge_in_pieces(texts, libraries, steps):
    pair = align.Pair(tokenizer_path(BYTE), tokenizer_path(PIECE), cache=200)
    got = list(align.aligned(list(pair.tokens([t or "" for t in texts])), steps))
    assert len(got) == len(texts)
    for text, (n_a, n_b, n_groups, n_links, groups, pairs, times) in zip(texts, got):
        a, b, n, shown, links = plain_alignment(plain_tokens(libraries, text))
        assert (n_a, n_b, n_groups, n_links, groups.decode()) == (a, b, n, sum(links.values()), shown), repr(text)
        assert dict(zip(pairs.tolist(), times.tolist())) == {(i << align.LOW_BITS) | j: k for (i, j), k in links.items()}


@pytest.mark.parametrize("frequent", [0, 40, 500_000])
def test_counts_over_all_documents(spark, texts, libraries, words, monkeypatch, frequent):
    monkeypatch.setattr(align, "FREQUENT_PAIRS", frequent)
    every = [*texts[:60], *texts[:20], words(3, 400), words(3, 400)]
    plain = [plain_alignment(plain_tokens(libraries, t)) for t in every]
    count = Counter(p for x in plain for p in x[4])
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    rows = [(i if i % 7 else None, i, t) for i, t in enumerate(every)]
    frame = spark.createDataFrame(rows, "doc_id long, times long, text string").repartition(4)
    got = align.align(frame, tokenizer_path(BYTE), tokenizer_path(PIECE), column="x").collect()
    assert len(got) == len(every)
    for r in got:
        assert r.doc_id == (r.times if r.times % 7 else None)
        n_a, n_b, n_groups, shown, links = plain[r.times]
        assert (r.x.n_a, r.x.n_b, r.x.n_groups, r.x.n_links, r.x.groups) == (n_a, n_b, n_groups, sum(links.values()), shown)
        assert r.x.groups_sha256 == (hashlib.sha256(shown.encode()).hexdigest() if n_a else "")
        assert r.x.n_best == sum(k for p, k in links.items() if count[p] == best[p[0]])
        assert r.x.count_sum == sum(k * count[p] for p, k in links.items())


def test_alignment_of_an_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(frame, tokenizer_path(BYTE), tokenizer_path(PIECE)).count() == 0
