"""Frames that are no plain tables, and rules that overrule one of them."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assaylake.llm import dedup, jaccard, quality, repeats
from assaylake.llm.common import located


@pytest.fixture(scope="module")
def table(spark, words, tmp_path_factory):
    texts = ["same text", "same text", words(5, 200), words(5, 200) + " more", words(6, 30), None]
    path = str(tmp_path_factory.mktemp("frames") / "documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def shapes(table):
    twice = table.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    other = table.select(F.col("doc_id").alias("other"))
    return {
        "table": table, "some columns": table.select("text", "doc_id"), "filtered": table.where("doc_id <> 4"), "exploded": twice,
        "joined": table.join(other, (F.col("doc_id") + F.col("other")) % 2 == 0), "union": table.unionByName(table),
        "computed": table.select("doc_id", F.concat("text", F.lit(" x")).alias("text")),
    }


@pytest.mark.parametrize("shape", ["table", "some columns", "filtered", "exploded", "joined", "union", "computed"])
def test_no_row_is_multiplied(table, shape):
    frame = shapes(table)[shape]
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    assert located(frame, "shape").select("_llm_file", "_llm_row").distinct().count() == len(rows)
    by_text = defaultdict(list)
    for i, t in rows:
        by_text[dedup.SPACE_CLASS and " ".join((t or "").split(" "))].append(i)
    found = dedup.groups(frame).select("text", "dedup.*").collect()
    assert len(found) == len(rows) and sum(r.kept for r in found) == len(by_text)
    assert all((r.keep_id, r.group_size) == (min(by_text[r.text or ""]), len(by_text[r.text or ""])) for r in found)
    near = jaccard.groups(frame, jaccard.Rule(words=3, percent=80)).select("near.*").collect()
    assert len(near) == len(rows)
    assert Counter(r.component_id for r in near) == Counter({
        k: n for k, n in Counter(_component(i, t, rows) for i, t in rows).items()})
    gone = repeats.remove(frame, length=40).select("doc_id", "repeats.n_removed").collect()
    assert len(gone) == len(rows)
    many = Counter(t for _, t in rows)
    assert all(r.n_removed == len(t.encode()) for r in gone for t in [next(t for i, t in rows if i == r.doc_id)]
               if t and many[t] > 1 and len(t) >= 40)


def _component(doc_id, text, rows):
    """The two long texts are linked, equal texts too, and no others."""
    start = (text or "")[:40]
    if not start:
        return doc_id
    return min(i for i, t in rows if t and t[:40] == start)


def good_text(rng, n=120):
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    return [rng.choice(vocabulary) for _ in range(n)]


def test_one_reject_vote_does_not_decide(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(good_text(rng))) for i in range(300)]
    # Faulty texts show it to several rules; one clean text has a list that repeats a line.
    rows += [(1000 + i, " ".join(w + "#$%" for w in good_text(rng))) for i in range(60)]
    lines = [" ".join(good_text(rng, 30)) for _ in range(5)]
    rows.append((2000, "\n".join([*lines, *["yes"] * 4])))
    for column in ("quality", "n_words"):
        frame = quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), column=column)
        found = {r.doc_id: r[column] for r in frame.collect()}
        assert not any(f.base_failed for f in found.values())
        assert [i for i, f in found.items() if f.kept != (i < 1000 or i == 2000)] == []
    votes = frame.where("doc_id = 2000").select(*quality.votes(quality.RULES, "n_words")).first()
    assert list(votes).count(-1) == 1
