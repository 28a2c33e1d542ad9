import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import dedup, jaccard, langid, mixing, passages, pieces, quality, queries, repeats, sharding, tokenfile, urlfilter
from assaylake.llm.queries import URL_RULES, tokenizer_path

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# ---------------------------------------------------------------- 1


def dedup_brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub(" ", r["text"] or "")].append(r["doc_id"])
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("digest", [dedup.sha256, lambda text: F.substring(dedup.sha256(text), 1, 1)])
def test_dedup_brute_force(stored, digest):
    found = rows_of(dedup.groups(stored, digest=digest))
    want = dedup_brute(found)
    assert len(found) == 13
    for r in found:
        body = SPACE.sub(" ", r["text"] or "")
        d = r["dedup"]
        assert (d["keep_id"], d["group_size"]) == want[body]
        assert d["text_sha256"] == hashlib.sha256(body.encode()).hexdigest()
    assert Counter(SPACE.sub(" ", r["text"] or "") for r in found if r["dedup"]["kept"]) == dict.fromkeys(want, 1)


def test_dedup_empty_and_unstored(empty, awkward):
    assert dedup.groups(empty).count() == 0
    assert dedup.groups(awkward, carry=["doc_id"]).where("dedup.kept").count() == len(dedup_brute(rows_of(awkward)))


def test_dedup_state_goes_on(spark, tmp_path):
    feed, state, out = (str(tmp_path / x) for x in ("feed", "state", "out"))
    row = lambda d, i: spark.createDataFrame([(d, (False, i, 0, i))], "digest string, entry struct<no_id:boolean,id:long,file:long,row:long>")
    row("a", 5).unionByName(row("b", 6)).write.parquet(feed)
    dedup.run_state(spark, feed, state, out)
    row("a", 3).write.mode("append").parquet(feed)
    # The second run starts from the stored state and reads the new file only.
    dedup.run_state(spark, feed, state, out)
    assert [(r.digest, r.kept.id, r.seen) for r in dedup.latest(spark, out).collect()] == [("a", 3, 2)]


# ---------------------------------------------------------------- 2


def repeats_brute(texts, length, keep_first):
    seen, first = Counter(), {}
    for key, t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] += 1
            first.setdefault(t[i:i + length], (key, i))
    out = {}
    for key, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = t[i:i + length]
            if seen[w] > 1 and not (keep_first and first[w] == (key, i)):
                gone[i:i + length] = b"\1" * length
        out[key] = bytes(b for b, g in zip(t, gone) if not g)
    return out


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("most", [20_000, 1])
def test_repeats_brute_force(spark, words, keep_first, most):
    rng = random.Random(7)
    shared = [words(100 + k, 20, 500) for k in range(4)]
    texts = []
    for i in range(40):
        parts = [words(1000 + i, rng.randint(0, 30), 400)]
        for s in rng.sample(shared, rng.randint(0, 3)):
            parts += [s[rng.randint(0, 10):len(s) - rng.randint(0, 10)], words(2000 + i, rng.randint(0, 3))]
        texts.append((i, "".join(parts)))
    texts += [(40, "x" * 150), (41, texts[3][1]), (42, texts[5][1][:-1] + "é"), (43, shared[0][:49]), (44, shared[0][:50])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = repeats.remove(docs, 50, keep_first, most=most)
    want = repeats_brute([(i, t.encode()) for i, t in texts], 50, keep_first)
    for r in rows_of(found):
        got = r["repeats"]
        assert bytes(got["kept"]) == want[r["doc_id"]], r["doc_id"]
        assert got["n_removed"] == got["n_bytes"] - len(got["kept"]) == sum(s["end"] - s["start"] for s in got["spans"])


def shared_brute(texts, words):
    """Per text the number of its words in windows that another text has."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for i, w in enumerate(split):
        for k in range(len(w) - words + 1):
            seen.setdefault(tuple(w[k:k + words]), set()).add(i)
    out = []
    for w in split:
        inside = set()
        for k in range(len(w) - words + 1):
            if len(seen[tuple(w[k:k + words])]) > 1:
                inside.update(range(k, k + words))
        out.append(len(inside))
    return out


@pytest.mark.parametrize("most, size", [(4_000, 51), (1, 9)])
def test_shared_words_brute_force(spark, words, monkeypatch, most, size):
    if most == 1:
        monkeypatch.setattr(passages, "PIECE", 300)
    rng = random.Random(size)
    shared = [words(100 + k, 2 * size, 500).split() for k in range(4)]
    texts = []
    for i in range(40):
        parts = [words(1000 + i, rng.randint(0, 60), 400)]
        for s in rng.sample(shared, rng.randint(0, 3)):
            # Other white space and other ends; some parts are too short by a word.
            at = rng.randint(0, size)
            parts += [rng.choice([" ", "\n", "\t  "]).join(s[at:at + size + rng.randint(-1, 9)]), words(2000 + i, rng.randint(0, 3))]
        texts.append(" ".join(parts))
    own = words(9, size, 500)
    texts += [None, "", " \n", f"{own} x {own} y", "the " * 200, "the " * (size - 1), texts[3], texts[5] + "é", "the " * 90, "ä " + texts[7]]
    docs = spark.createDataFrame([(i % 45, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("at", F.monotonically_increasing_id())
    found = repeats.remove(docs.coalesce(1), 400, most=most, passage=size)
    got = {r["at"]: r["repeats"] for r in rows_of(found)}
    assert len(got) == len(texts)
    assert [got[k]["n_shared"] for k in sorted(got)] == shared_brute(texts, size)
    plain = {r["at"]: r["repeats"] for r in rows_of(repeats.remove(docs.coalesce(1), 400))}
    assert all(plain[k][c] == got[k][c] for k in plain for c in ("n_bytes", "n_removed", "spans", "kept"))


def test_passages_under_400_bytes_are_counted(spark, words, tmp_path):
    passage = words(3, 55, 300)
    assert len(passage.encode()) < 400
    texts = [words(4, 90) + " " + passage, passage.replace(" ", "\n") + " " + words(5, 90), words(6, 90), None]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in queries.QUERIES["op2_suffix_repeats"](spark, str(tmp_path)).collect()}
    assert [found[i]["n_removed"] for i in range(4)] == [0] * 4
    assert [found[i]["n_shared_words"] for i in range(4)] == [55, 55, 0, 0]


def test_repeats_awkward(stored, empty):
    found = rows_of(repeats.remove(stored, 400))
    assert len(found) == 13
    gone = {r["doc_id"]: r["repeats"]["n_removed"] for r in found}
    text = {r["doc_id"]: r["text"] for r in found}
    assert gone[7] == gone[8] == len(text[7]) and gone[9] == len(text[7]) and gone[4] == 0 and gone[5] == 0
    assert repeats.remove(empty, 400).count() == 0


def test_repeats_cut_into_pieces(monkeypatch, words):
    data = words(5, 400).encode()
    whole = {(s + i, p, int(h)) for s, n, p, h in zip(*repeats.runs_of(data, 100)[0]) for i in range(n)}
    monkeypatch.setattr(repeats, "PIECE", 300)
    cut = {(s + i, p, int(h)) for part in repeats.runs_of(data, 100) for s, n, p, h in zip(*part) for i in range(n)}
    assert whole == cut and len(whole) == len(data) - 99


def test_previous_factors_brute_force():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 300).astype(np.uint8)

    def match(i, j, length):
        return next((k for k in range(length) if data[i + k] != data[j + k]), length)

    for length in (8, 9, 16, 21, 40):
        starts = np.arange(len(data) - length + 1)
        windows = [data[s:s + length].tobytes() for s in starts]
        ranks = repeats.prefix_ranks(data, length)
        classes = repeats.suffix_classes(ranks, starts, length)
        by_bytes = {w: k for k, w in enumerate(sorted(set(windows)))}
        assert [by_bytes[w] for w in windows] == classes.tolist()
        order = np.lexsort((starts, classes))
        previous = repeats.longest_factors(ranks, data, starts, order, starts, length)
        later = repeats.longest_factors(ranks, data, starts, order, -starts, length)
        assert previous.tolist() == [max([match(i, j, length) for j in range(i)], default=0) for i in starts]
        assert later.tolist() == [max([match(i, j, length) for j in range(i + 1, len(starts))], default=0) for i in starts]


def test_nearest_smaller_brute_force():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 64, 257):
        for x in (rng.integers(-5, 5, n), rng.permutation(n), np.arange(n), np.arange(n)[::-1], np.zeros(n, np.int64)):
            want = [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(n)]
            assert repeats.nearest_smaller(x).tolist() == want


# ---------------------------------------------------------------- 3


def counts_brute(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    seen = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + j for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for j in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_distinct": len(set(words)),
    }


def test_quality_counts(spark, stored, words):
    texts = ["a b c a b c", "a b c d", "x x x x x", "l\nl\n\nm", "#* a|b\n \n# #", words(3, 400, 8), words(4, 5000, 40)]
    docs = stored.select("doc_id", "text").unionByName(
        spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    )
    for r in rows_of(quality.with_counts(docs, "q")):
        want = counts_brute(r["text"])
        assert {k: r["q"][k] for k in want} == want, r["doc_id"]


def test_quality_em_finds_the_faults():
    rng = random.Random(3)
    patterns = Counter()
    truth = {}
    for _ in range(3000):
        good = rng.random() < 0.85
        # Three rules, each of which knows one fault and now and then is wrong.
        fault = None if good else rng.randrange(3)
        votes = tuple(
            0 if rng.random() < 0.1 else -1 if (k == fault or rng.random() < 0.01) else 1 for k in range(3)
        )
        patterns[votes] += 1
        truth.setdefault(votes, Counter())[good] += 1
    # Votes alone cannot name such faults, so what is known of the rules weighs as much as the texts.
    known = (("keep_good", 0.9), ("keep_bad", 0.8), ("reject_good", 0.01), ("reject_bad", 0.2))
    model = quality.fit(sorted(patterns.items()), 3, prior=quality.Prior(0.7, known, 3000.0))
    start, odds = model.weights()
    right = sum(
        truth[v][start + sum(o[0] if x > 0 else o[1] if x < 0 else 0 for x, o in zip(v, odds)) > 0] for v in patterns
    )
    assert right > 2800 and 0.6 < model.good < 0.9
    assert all(r["reject_good"] < 0.05 < r["reject_bad"] for r in model.rates)


def test_quality_awkward(stored, empty):
    found = rows_of(quality.judge(stored))
    assert len(found) == 13 and all(r["quality"]["base_failed"] for r in found if not r["text"])
    assert quality.judge(empty).count() == 0
    with pytest.raises(ValueError):
        quality.judge(stored, column="size")


# ---------------------------------------------------------------- 4


def url_brute(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org", "http://example.org/es/x", "https://a.b.Example.ORG/en/1?x#y",
    "http://xexample.org/es/", "http://m.example.com/fr/7", "http://com/de/", "http://a.com/de", "ftp://é.org/", "x://a://b.org/",
    "http://org?x", "http://.org/a", "http://example.org/en/2", "http://example.org/en/1", "http://example.org/en/1",
]


@pytest.mark.parametrize("max_bytes", [urlfilter.MAX_CASCADE_BYTES, 1])
def test_urls(spark, max_bytes):
    pages = spark.createDataFrame([(i, u, "k", 1) for i, u in enumerate(URLS)], "page_id long, url string, key string, block int")
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    for r in rows_of(urlfilter.judge(pages, rules, max_bytes=max_bytes)):
        j = r["judged"]
        assert (j["host"], j["path"], j["rule"], j["verdict"]) == url_brute(r["url"], URL_RULES), r["url"]
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
    none = urlfilter.judge(pages, rules.limit(0))
    assert none.where("judged.verdict = 'allow' AND judged.rule IS NULL").count() == len(URLS)


def test_cascade_is_exact_on_its_keys(spark):
    keys = spark.range(4000).select(
        F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit("second")).alias("h2"), (F.col("id") % 7 == 0).alias("listed")
    )
    cascade = urlfilter.build(keys)
    data = keys.toPandas()
    got = cascade.listed(*(data[c].to_numpy().view(np.uint64) for c in ("h1", "h2")))
    assert (got == data.listed.to_numpy()).all() and len(cascade.levels) > 1


# ---------------------------------------------------------------- 5


def test_language(spark, stored, empty):
    rng = random.Random(1)
    speak = {"aa": "abcde", "zz": "uvwxyz"}
    text = lambda lang: " ".join("".join(rng.choice(speak[lang]) for _ in range(5)) for _ in range(rng.randint(3, 300)))
    data = [(i, text(lang), lang) for i in range(200) for lang in [("aa", "zz")[i % 3 == 0]]]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    cuts = langid.sample(docs.where("doc_id < 150").select("lang", "text"))
    net = langid.train([t.encode() for _, t in cuts], [lang for lang, _ in cuts])
    held = langid.predict(docs.where("doc_id >= 150"), net)
    assert held.where("language.lang_pred = lang AND language.score > 0.5").count() == 50
    found = rows_of(langid.predict(stored, net))
    assert {r["language"]["lang_pred"] for r in found if not (r["text"] or "").strip()} == {"und"}
    assert all(0 <= r["language"]["score"] <= 1 for r in found) and len(found) == 13
    assert langid.predict(empty, net).count() == 0
    assert langid.sample(empty.select("lang", "text")) == []
    assert langid.predict(stored, None).where("language.lang_pred = 'und'").count() == 13


def test_language_sample_keeps_rare_languages(spark):
    data = [(lang, f"{lang} {i}") for lang, n in (("aa", 9000), ("bb", 9000), ("cc", 9000), ("rare", 30)) for i in range(n)]
    docs = spark.createDataFrame(data + [("cc", "cc again")] * 500, "lang string, text string")
    found = Counter(lang for lang, _ in langid.sample(docs, rows=200))
    each = {lang: n / langid.TRAIN_WINDOWS for lang, n in found.items()}
    assert sum(each.values()) == 200 and each["rare"] == 30 and all(50 <= each[x] <= 60 for x in ("aa", "bb", "cc"))


def test_language_windows_cover_the_text_and_tables_agree():
    net = langid.Network.fresh(["a", "b"])
    text = bytes(range(33, 127)) * 20
    cut = langid.windows(text)
    assert cut.tobytes().rstrip() == text and langid.windows(b"").shape == (1, langid.WINDOW)
    want = []
    for row in cut:
        want.append(np.concatenate([
            np.maximum(max(
                (sum(f[j][row[i + j]] for j in range(w)) for i in range(langid.WINDOW - w + 1)), key=lambda v: v[0]
            )[:1], 0) for w, f in net.filters.items()
        ]))
    assert np.allclose(net.features(cut)[:, ::langid.FILTERS], want, atol=1e-5)


# ---------------------------------------------------------------- 6


TEXTS = [
    "", " ", "a ", "  a  b ", "\n\n", "a\n b", "▁a", "a▁ b▁", "日本語 x", "👩‍👩‍👧 🇩🇪", "\x00 \x01", "<s> </s> <unk>", "x\ty\r\nz",
    "ＡＢ①", "é é", "\n\n\nfoo  \n  bar", "the quick brown fox", "   ", "▁\n▁",
]


def test_pieces_against_the_library(spark, words):
    path = tokenizer_path("piece_bpe_32k.model")
    own = pieces.Encoder(path)
    for text in [*TEXTS, words(9, 2000)]:
        n, digits, ids, first, end, decoded = own.encode(text)
        want = own.library.encode(text, return_type="proto")
        assert ids.tolist() == [p.id for p in want.pieces] and n == len(ids)
        assert digits == ",".join(map(str, ids)) and decoded == own.library.decode(ids.tolist())
        for p, a, b in zip(want.pieces, first.tolist(), end.tolist()):
            assert own.library.is_byte(p.id) or (p.begin, p.end) == (a, b)
    docs = spark.createDataFrame(list(enumerate([*TEXTS, None])), "doc_id long, text string")
    for r in rows_of(pieces.encode(docs, path, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"))):
        p, ids = r["pieces"], own.library.encode(r["text"] or "")
        assert p["ids"] == ids and p["n_tokens"] == len(ids) and p["decoded"] == own.library.decode(ids)
        assert p["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_pieces_awkward(stored, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    assert pieces.encode(stored, path).count() == 13 and pieces.encode(empty, path).count() == 0


def test_character_map_longest_prefix_and_alignment():
    """A map compiled by hand: "a" to "x", "ab" to "yz" and "c" to nothing."""
    keys = [(b"a", 0), (b"ab", 2), (b"c", 5)]
    texts = b"x\0yz\0\0"
    units = [0] * 1024
    # Every inner node gets a block of 256 units of its own; a unit's offset leads from its place to its children.
    blocks = {b"": 256}
    units[0] = 256 << 10
    place = lambda prefix, byte: blocks[prefix] ^ byte
    for n, prefix in enumerate(sorted({k[:i] for k, _ in keys for i in range(1, len(k) + 1)}), 2):
        blocks[prefix] = 256 * n if 256 * n < 1024 else 768
    blocks[b"c"] = 512 | 128
    for prefix in sorted(blocks, key=len)[1:]:
        at = place(prefix[:-1], prefix[-1])
        leaf = any(k == prefix for k, _ in keys)
        units[at] = (blocks[prefix] ^ at) << 10 | leaf << 8 | prefix[-1]
    for key, value in keys:
        units[blocks[key]] = 1 << 31 | value
    compiled = (4 * len(units)).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + texts
    table = pieces.CharacterMap(compiled)
    assert table.longest(b"aab", 0) == (1, b"x") and table.longest(b"ab", 0) == (2, b"yz")
    assert table.longest(b"cc", 0) == (1, b"") and table.longest(b"b", 0) is None
    model = pieces.Model(b"")
    model.map = table
    normal, source = model.normalise("  ab  c aé ")
    assert normal == "▁yz▁xé"
    assert source.tolist() == [2, 2, 2, 2, 2, 4, 4, 4, 8, 9, 9, 11]


# ---------------------------------------------------------------- 7


@pytest.mark.parametrize("bits", [1, 4, 10, 16, 31, 60, 64])
def test_simple8b_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 59, 60, 61, 1000):
        ids = rng.integers(0, 1 << 63, n, dtype=np.uint64) >> np.uint64(max(63 - bits, 0))
        if bits == 64 and n:
            ids[rng.random(n) < 0.1] = np.uint64((1 << 64) - 1)
        words, escapes, offsets = tokenfile.pack(ids)
        assert (tokenfile.unpack(words, escapes, offsets, n) == ids).all()
        if bits == 10 and n == 1000:
            assert len(words) <= 1000 / 6 + 1


def test_token_files(spark, stored, empty, words, tmp_path):
    from tokenizers import Tokenizer

    model = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(model)
    encode = tokenfile.word_encoder(model, 1)
    nasty = ["á b ́c", "ΑΣ ΣΑΣ.", "x y z\x1cq\x85w", "<|endoftext|> a<|startoftext|>b", "İ ǅ ß ﬁ", "it's we'll 'S 12 3.4", "ÉÀ×÷ªº¹", "가 ᄀ ᅡ"]
    docs = stored.select("doc_id", "text").unionByName(
        spark.createDataFrame([(50 + i, t) for i, t in enumerate([*nasty, *TEXTS])], "doc_id long, text string")
    )
    path = str(tmp_path / "ids")
    tokenfile.write(docs, path, encode, parts=4, block_ids=500)
    want = sorted(
        ((r.doc_id is not None, r.doc_id or 0, r.text or ""), library.encode(r.text or "", add_special_tokens=False).ids + [1])
        for r in docs.collect()
    )
    read = sorted(tokenfile.read(spark, path).collect(), key=lambda r: (r.part, r.block, r.place))
    assert [r.ids for r in read] == [ids for _, ids in want]
    start = 0
    for r, (_, ids) in zip(sorted(tokenfile.digests(spark, path).collect(), key=lambda r: r.start), want):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    tokenfile.write(empty, str(tmp_path / "none"), encode)
    assert tokenfile.digests(spark, str(tmp_path / "none")).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("id "), F.col("doc_id").cast("string")))
    tokenfile.write(named, str(tmp_path / "named"), encode, parts=3)
    key = lambda r: (r.doc_id is not None, r.doc_id or "", r.n_tokens, r.ids_crc32)
    found = tokenfile.digests(spark, str(tmp_path / "named")).collect()
    assert sorted(map(key, found)) == sorted(
        (i, i and f"id {k}" or "", len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        for (i, k, _), ids in want
    )
    assert {r.doc_id for r in tokenfile.read(spark, str(tmp_path / "named")).collect()} == {r.doc_id for r in found}


# ---------------------------------------------------------------- 8


def fill(sizes, weights, most):
    """Targets by handing the excess out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = dict.fromkeys(names, 0.0), set(), float(sum(sizes.values()))
    while left > 1e-9:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in open_:
            target[s] += share[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                full.add(s)
    return target


def test_mix(spark, words):
    rng = random.Random(5)
    rows = [(i, words(i, rng.randint(0, 60)), rng.choice(["a", "b", "b", "b", "b", "b", "b", "b", "c", None]), "t") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(7)
    found = rows_of(mixing.copies(docs, block=16))
    again = rows_of(mixing.copies(docs.repartition(3), block=16))
    key = lambda r: r["doc_id"]
    assert [r["copies"]["copies"] for r in sorted(found, key=key)] == [r["copies"]["copies"] for r in sorted(again, key=key)]
    sizes, taken = Counter(), Counter()
    for r in found:
        c = r["copies"]
        assert c["size"] == len((r["text"] or "").split()) and 0 <= c["copies"] <= 3
        sizes[r["source"]] += c["size"]
        taken[r["source"]] += c["size"] * c["copies"]
    want = fill(sizes, mixing.WEIGHTS, mixing.MOST)
    for r in found:
        assert r["copies"]["source_size"] == sizes[r["source"]]
        assert abs(r["copies"]["target"] - want[r["source"]]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 30
    assert any(abs(want[s] - 3 * sizes[s]) < 1e-6 for s in sizes)


def test_mix_spreads_a_repeated_id(spark):
    docs = spark.createDataFrame([(7, "one two", "a")] * 40 + [(8, "one", "a")], "doc_id long, text string, source string")
    seen = docs.select(F.col("doc_id").cast("string").alias("key"), F.monotonically_increasing_id().alias("at"))
    keys = Counter(r["key"] for r in mixing._own_keys(seen).collect())
    assert len(keys) == 41 and "8" in keys
    found = rows_of(mixing.copies(docs, block=4))
    assert len(found) == 41
    taken = sum(r["copies"]["size"] * r["copies"]["copies"] for r in found)
    assert abs(taken - found[0]["copies"]["target"]) <= 2


def test_mix_awkward(stored, empty):
    found = rows_of(mixing.copies(stored))
    assert len(found) == 13 and found[0]["target"] == 2.0
    assert mixing.copies(empty).count() == 0


# ---------------------------------------------------------------- 9


def test_shards(spark, stored, empty):
    tree = sharding.uniform_tree(2, 2, 4)
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    found = sharding.shard(docs, tree, sharding.grown(tree)).toPandas()
    assert set(found["shard"]) == set(range(16))
    moved = found[found["shard"] != found["grown_shard"]]
    assert set(moved["grown_shard"]) == {16} and 900 < len(moved) < 1450
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part))) and 1050 < len(part) < 1450
    awkward = rows_of(sharding.shard(stored, tree))
    assert len(awkward) == 13 and {(r["size"], r["text_crc32"]) for r in awkward if r["doc_id"] == 1} == {(1, 0)}
    assert sharding.shard(empty, tree).count() == 0


def test_shard_slots_of_any_ids(spark):
    """Ids far apart, ids as texts, and one id on a third of all rows: slots are gapless and in order."""
    tree = sharding.uniform_tree(2, 2, 4)
    base = spark.range(3000).select(F.xxhash64("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"))
    hot = spark.range(1500).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 2).alias("text"))
    nulls = spark.range(3).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    numbers = base.unionByName(hot).unionByName(nulls)
    for docs in (numbers, numbers.withColumn("doc_id", F.concat(F.lit("id-"), F.col("doc_id").cast("string")))):
        found = sharding.shard(docs, tree).collect()
        assert len(found) == 4503
        rank = lambda r: (r.doc_id is not None, r.doc_id or 0 if r.doc_id is None else r.doc_id, r.text_crc32, r.size)
        for number in range(16):
            rows = sorted((r for r in found if r.shard == number), key=lambda r: r.slot)
            assert [r.slot for r in rows] == list(range(len(rows)))
            assert [rank(r) for r in rows] == sorted(rank(r) for r in rows)


def test_weights_move_rows_only_into_their_subtree(spark):
    """A heavier rack takes rows from elsewhere and gives none away."""
    leaf = lambda n, w=1.0: sharding.Node(f"s{n}", shard=n, leaf_weight=w)
    tree = lambda w: sharding.Node("root", (
        sharding.Node("g0", (sharding.Node("r0", (leaf(0), leaf(1))), sharding.Node("r1", (leaf(2), leaf(3, w))))),
        sharding.Node("g1", (sharding.Node("r0", (leaf(4), leaf(5))),)),
    ))
    key = F.col("id")
    pairs = spark.range(5000).select(sharding.shard_of(key, tree(1.0)), sharding.shard_of(key, tree(3.0))).collect()
    group = {0: "g0r0", 1: "g0r0", 2: "g0r1", 3: "g0r1", 4: "g1", 5: "g1"}
    for a, b in pairs:
        # Between other racks of one region, and inside untouched racks, nothing moves.
        assert a == b or group[b].startswith("g0")
        assert not (a in (0, 1) and b in (0, 1) and a != b)


# ---------------------------------------------------------------- 10


def near_brute(rows, k, percent):
    def shingles(text):
        w = tuple((text or "").encode().lower().split())
        return frozenset(w[i:i + k] for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([w] if w else [])

    found = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(found[i] & found[j])
            if shared and 100 * shared >= percent * len(found[i] | found[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        least[x] = i if x not in least else min((y for y in (least[x], i) if y is not None), default=None)
    return [(len(s), least[x]) for s, x in zip(found, label)]


def families(words, seed, n_families=12, copies=12):
    rng = random.Random(seed)
    out = []
    for f in range(n_families):
        base = words(seed * 100 + f, rng.randint(3, 150), 300).split()
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(["new", "other", "third"])
            out.append(" ".join(text) + (" The End of it all and more" if rng.random() < 0.3 else ""))
    rng.shuffle(out)
    return [*enumerate(out, 100), (1, None), (2, " "), (3, "one"), (4, "ONE"), (5, "one one"), (6, "one"), (None, "one")]


@pytest.mark.parametrize("seed,k,percent", [(1, 4, 85), (2, 5, 80), (3, 1, 60)])
def test_near_brute_force(spark, words, seed, k, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rows = families(words, seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = rows_of(jaccard.groups(docs, jaccard.Rule(k, percent)))
    want = {r: w for r, w in zip(rows, near_brute(rows, k, percent))}
    for r in found:
        assert (r["near"]["n_shingles"], r["near"]["component_id"]) == want[r["doc_id"], r["text"]], r
    assert len(found) == len(rows)
    with_words = [r for r in found if r["near"]["n_shingles"]]
    assert Counter(r["near"]["component_id"] for r in with_words if r["near"]["kept"]) == dict.fromkeys(
        {r["near"]["component_id"] for r in with_words}, 1
    )


@pytest.mark.parametrize("k,percent,n", [(1, 60, 40), (2, 80, 30)])
def test_near_links_brute_force(spark, words, k, percent, n):
    base = words(77, 60, 300).split()
    rng = random.Random(n)
    rows = [*families(words, 4, 6)]
    for i in range(n):
        text = list(base)
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(len(text))] = f"w{rng.randrange(40)}"
        rows += [(1000 + i, " ".join(text))] * rng.choice([1, 1, 2])
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def shingles(text):
        w = tuple((text or "").encode().lower().split())
        return frozenset(w[i:i + k] for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([w] if w else [])

    found = {shingles(t) for _, t in rows} - {frozenset()}
    want = {s: sum(s != o and 100 * len(s & o) >= percent * len(s | o) for o in found) for s in found}
    assert max(want.values()) >= 10
    for r in rows_of(jaccard.groups(docs, jaccard.Rule(k, percent))):
        assert r["near"]["links"] == want.get(shingles(r["text"]), 0), r


def test_parities_bound_the_difference():
    rng = np.random.default_rng(2)
    for n, m, both in ((10, 9, 8), (500, 480, 430), (3000, 900, 500)):
        pool = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
        a, b = pool[:n], np.concatenate([pool[:both], pool[n:n + m - both]])
        assert jaccard._least_difference(jaccard._parities(a), jaccard._parities(b)) <= n + m - 2 * both


def test_common_tokens_are_bounded(spark, monkeypatch):
    described = spark.createDataFrame([(t, 10 + t) for t in range(50)] + [(49, 5), (None, None)], "token long, seen long")
    assert jaccard._common(described, 1).tolist() == list(range(50))
    monkeypatch.setattr(jaccard, "MOST_COMMON", 3)
    assert jaccard._common(described, 1).tolist() == [47, 48, 49]
    assert len(jaccard._common(described.limit(0), 1)) == 0


def test_near_awkward(stored, empty):
    found = rows_of(jaccard.groups(stored))
    ids = {r["doc_id"]: r["near"]["component_id"] for r in found}
    assert len(found) == 13 and ids[7] == ids[8] == ids[9] == 7 and ids[1] == 1 and ids[6] == ids[5] == 5
    assert jaccard.groups(empty).count() == 0


# ---------------------------------------------------------------- the pipeline


def test_pipeline_stages(spark, words, tmp_path, empty):
    import corpus_pipeline

    good = words(1, 200)
    rows = [(i, words(10 + i, 150), "en", f"s{i % 2}", 0) for i in range(20)] + [
        (30, good, "en", "s0", 0), (31, good.replace(" ", "  "), "en", "s0", 0), (32, good + " more", "en", "s0", 0),
        (33, "spam " * 100, "en", "s1", 0), (34, None, "en", None, 0), (35, words(50, 120).replace(" ", "*** "), "en", "s1", 0),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "encode pieces":
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            kept[name] = Counter(r.doc_id for r in docs.collect())
    assert set(kept["quality rules"]) == {*range(20), 30, 31, 32}
    assert set(kept["exact dedup"]) == {*range(20), 30, 32}
    assert set(kept["near dedup"]) == {*range(20), 30}
    assert set(kept["mix sources"]) <= {*range(20), 30}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sum(kept["mix sources"].values())
