"""What grows with the input: rows of large groups, copies of texts on disk, plans of rounds."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from assaylake import session
from assaylake.llm import jaccard, mixing, quality, trie


@pytest.fixture
def written(monkeypatch):
    """(purpose, frame) of all that the operators write on their way."""
    frames = []

    def watched(df, purpose):
        frames.append((purpose, out := session.materialise(df, purpose)))
        out.joins = df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        return out

    for module in (jaccard, mixing, quality, trie):
        monkeypatch.setattr(module, "materialise", watched)
    return frames


def shingles(text, k):
    w = tuple(text.encode().lower().split())
    return frozenset(w[i:i + k] for i in range(len(w) - k + 1))


@pytest.mark.parametrize("k,percent,members", [(4, 85, 16), (5, 80, 7), (4, 85, 500), (1, 100, 128)])
def test_a_group_of_near_copies_makes_no_rows_for_its_pairs(spark, words, written, monkeypatch, k, percent, members):
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    rng, base, n = random.Random(k), words(5, 150, 3000).split(), 150
    texts = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randint(1, 5)):
            text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(text))
    rows = [*enumerate(texts), *((500 + i, words(900 + i, 80, 3000)) for i in range(30)), (600, texts[3]), (None, texts[4])]
    found = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), jaccard.Rule(k, percent)).collect()
    sets = [shingles(t, k) for t in texts]
    linked = [(i, j) for i in range(n) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    assert percent == 100 or 0 < len(linked) < n * (n - 1) / 3
    links, label = Counter(x for pair in linked for x in pair), list(range(n))
    for i, j in linked:
        a, b = sorted((label[i], label[j]))
        label = [a if x == b else x for x in label]
    got = {r.doc_id: r.near for r in found}
    assert len(found) == len(rows)
    assert [(got[i].component_id, got[i].links) for i in range(n)] == [(label[i], links[i]) for i in range(n)]
    assert (got[600].component_id, got[None].links) == (label[3], links[4])
    # Balls, not members, are paired; members are sent once for each block that theirs meets.
    counts = {purpose: frame.count() for purpose, frame in written if purpose in ("open-pairs", "block-pairs", "block-links")}
    if percent < 100:
        assert counts["open-pairs"] < 2 * n
        if members == 500:
            assert counts["block-links"] < 10 * n


def test_members_of_many_open_balls_are_sent_once_to_a_meeting(spark, words, written):
    rng, base, n_balls = random.Random(3), words(8, 60, 3000).split(), 40
    texts = []
    for _ in range(3 * n_balls):
        text = list(base)
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(60)] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(text))
    docs = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "_llm_file long, _llm_row long, text string")
    members = spark.createDataFrame(
        [(i, 57, 0, i, i // 3, (0, 0)) for i in range(len(texts))],
        "node long, n long, file long, row long, ball long, block struct<ring: int, part: int>",
    )
    # Some pairs are settled, and so not to be counted.
    pairs = [(a, b) for b in range(n_balls) for a in range(b + 1) if (a + b) % 5 and (a != b or a % 2)]
    open_ = spark.createDataFrame(
        [(a, (0, 0), b, (0, 0)) for a, b in pairs],
        "a long, block_a struct<ring: int, part: int>, b long, block_b struct<ring: int, part: int>",
    )
    rows = jaccard._compare_blocks(open_, members, docs, jaccard.Rule(4, 85)).collect()
    sets, asked = [shingles(t, 4) for t in texts], {*pairs, *((b, a) for a, b in pairs)}
    linked = [
        (i, j) for i, x in enumerate(sets) for j, y in enumerate(sets)
        if i != j and (i // 3, j // 3) in asked and 100 * len(x & y) >= 85 * len(x | y)
    ]
    counts = Counter()
    for r in rows:
        counts.update({r.node: r.links} if r.node is not None else {})
    assert counts == Counter(i for i, _ in linked) and 0 < len(linked) < len(texts) ** 2 / 2
    assert {(r.a, r.b) for r in rows if r.a is not None} <= set(linked)
    # Rows for each pair of blocks would be 6 times as many as pairs.
    assert dict(written)["block-members"].count() == len(texts) < len(pairs)


def test_forests_tie_what_links_tie():
    rng = random.Random(1)
    label, tied, n = np.arange(60), [], 60
    pairs = [(i, j) for i in range(n) for j in range(i) if i % 4 == j % 4 and rng.random() < 0.5]
    for at in range(0, len(pairs), 50):
        label, new = jaccard._forest(label, *np.array(pairs[at:at + 50]).T)
        tied += [tuple(x) for part in new for x in part.tolist()]
    assert label.tolist() == [i % 4 for i in range(n)]
    assert len(tied) == n - 4 and set(tied) <= set(pairs)


def test_texts_are_not_kept_on_disk(stored, written):
    """Before, all texts were written once more, to stay there, by the rules and by the mix."""
    assert quality.judge(stored).count() == mixing.copies(stored, column="mixed").count() == stored.count()
    purposes = [purpose for purpose, _ in written]
    assert "quality" in purposes and "mix-sizes" in purposes

    def leaves(kind, name=""):
        if isinstance(kind, T.StructType):
            return {x for f in kind.fields for x in leaves(f.dataType, f.name)}
        return {name}

    assert all("text" not in leaves(frame.schema) for _, frame in written)
    carried = quality.judge(stored, carry=["doc_id"]).select("doc_id", "quality.*")
    assert sorted(map(str, carried.collect())) == sorted(map(str, quality.judge(stored).select("doc_id", "quality.*").collect()))
    carried = mixing.copies(stored, column="mixed", carry=["doc_id"]).select("doc_id", "mixed.*")
    assert sorted(map(str, carried.collect())) == sorted(
        map(str, mixing.copies(stored, column="mixed").select("doc_id", "mixed.*").collect())
    )


def test_plans_of_rounds_stay_small(spark, written):
    """Before, a round held its joins six times, and the way back a union of all rounds."""
    n = 40
    rows = [(i, i - 1 if i else None, 1) for i in range(n)] + [(n + i, i, 2) for i in range(n)]
    got = dict(trie.subtree_totals(spark.createDataFrame(rows, "node long, parent long, x long"), ["x"]).collect())
    assert [got[i] for i in range(n)] == [3 * (n - i) for i in range(n)]
    assert max(frame.joins for _, frame in written) <= 2
