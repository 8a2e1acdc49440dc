"""Ranked search, collocations and toxicity against plain versions; columns without a hash; wide vocabularies; hot keys."""

import json
import math
import random
import re
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placeweave.llm import collocations, mixing, ngram_join, queries, ranked_search, sharding, toxicity, url_filter, wavelet
from placeweave.llm.shared import join_hot, new_path, row_hash

LOWER = {c: c + 32 for c in range(65, 91)}
AWKWARD = [None, "", "   ", "...", "É É Ünï é1", "a" * 300_000, "x y " * 60_000, "\u0000\u0001", "Same Text", "Same Text", "same text", "日本 語 日本"]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_search(docs, query, k):
    held = {n: Counter(terms(t)) for n, (_, t) in enumerate(docs)}
    sizes = {n: sum(c.values()) for n, c in held.items()}
    total, count = sum(sizes.values()), sum(s > 0 for s in sizes.values())
    scores = Counter()
    for t in set(terms(query)):
        df = sum(t in c for c in held.values())
        w = math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1))) if df else 0
        for n, c in held.items():
            if c[t]:
                scores[n] += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * (100 - 50 + (50 * sizes[n] * count) // total)))
    best = sorted((-s, docs[n][0] is None, docs[n][0] or 0) for n, s in scores.items() if s > 0)[:k]
    return [(r + 1, None if no else i, -s) for r, (s, no, i) in enumerate(best)]


def texts(n, seed=1):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.7)) % 500}" for _ in range(40_000)]
    return [" ".join(words[(a := rnd.randrange(39_000)) : a + rnd.randrange(1, 120)]) + rnd.choice([".", "!", ""]) for _ in range(n)]


def found(spark, docs, asked, k):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(asked, "item_id long, text string")
    out = {}
    for r in ranked_search.search_documents(d, q, k).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    return out


def test_ranked_search_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "RANGE_BYTES", 20_000)  # some ranges a partition
    body = texts(700)
    docs = [(i, t) for i, t in enumerate(body)] + [(1000 + i, body[5]) for i in range(120)] + [(2000 + i, t) for i, t in enumerate(AWKWARD)] + [(None, body[5]), (7, body[7]), (7, body[7])]
    asked = [(1, body[5]), (2, body[9] + " w1 w1 zzz"), (3, "W1"), (4, "unknownterm"), (5, None), (6, ""), (7, "é1 日本"), (8, "same text"), (9, "a" * 300_000)]
    got = found(spark, docs, asked, 10)
    for i, q in asked:
        assert got.get(i, []) == plain_search(docs, q, 10), i


def test_ranked_search_of_little(spark):
    assert found(spark, [], [(1, "a b")], 5) == {} and found(spark, [(1, None), (2, "!")], [(1, "a b")], 5) == {}
    assert found(spark, [(1, "a b"), (2, "c")], [], 5) == {}


def test_a_range_is_searched_best_first_and_stops(monkeypatch):
    """A search opens few leaves where one document is far ahead, and all that tie with the last."""
    docs = [f"common filler w{i % 7}" for i in range(4000)] + ["rare needle words here"]
    batch = pa.concat_tables([pa.Table.from_batches(list(ranked_search._index_range(0, pa.array(range(len(docs)), pa.int64()), [t.encode() for t in docs], len(docs), 3 * 4000 + 4)))])
    there, opened = ranked_search._Range(batch, len(docs), 3 * 4000 + 4), []
    scores = there._scores
    monkeypatch.setattr(there, "_scores", lambda row, w, leaves: opened.append(len(leaves)) or scores(row, w, leaves))
    assert [d for _, d in there.best(["rare", "needle", "common"], [9000, 9000, 1], 1, 0)] == [4000]
    assert sum(opened) <= ranked_search.WAVE
    tied = there.best(["common"], [5], 3, 0)
    assert len(tied) == 4000 and len({s for s, _ in tied}) == 1


def plain_phrases(rows, top, least=30):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    cands = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    gone = set()
    for (lang, g), a in cands.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                if 100 * a >= 80 * f[lang, g[i : i + k]]:
                    gone.add((lang, g[i : i + k]))
    out = []
    for (lang, g), a in cands.items():
        if (lang, g) not in gone:
            score, _, left, right = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
            out.append((lang, -score, -a, " ".join(g).encode(), left, right))
    ranked, at = [], Counter()
    for lang, s, a, g, left, right in sorted(out):
        at[lang] += 1
        if at[lang] <= top:
            ranked.append((lang, at[lang], g.decode(), -a, left, right, n[lang], -s))
    return sorted(ranked)


def phrases(spark, rows, top):
    df = spark.createDataFrame(rows, "lang string, text string, score string, rank string, phrase string").repartition(3)
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r[c] for c in cols) for r in collocations.collocations(df, top).collect())


def test_collocations_equal_a_plain_count(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_BYTES", 60_000)
    monkeypatch.setattr(collocations, "BRANCH", 700)  # words in several branches
    rnd = random.Random(3)
    rows = []
    for i, t in enumerate(texts(900, 5)):
        t = t + rnd.choice([" New York City is, big; ha ha ha ha ha\tha", " of the\nof the", " É é Ab c d"])
        rows.append((["en", None, "und", ""][i % 4] if i % 3 else "en", t))
    rows += [("en", "one text repeated very often here!")] * 400 + [("xx", t) for t in AWKWARD]
    wide = [(lang, t, "s", "r", "p") for lang, t in rows]
    assert phrases(spark, wide, 50) == plain_phrases(rows, 50)


def test_collocations_of_little(spark):
    assert phrases(spark, [("en", t, "", "", "") for t in AWKWARD[:5]], 10) == []
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty, 10).count() == 0


def test_bitmaps_shift_across_bytes():
    numbers = np.array([0, 1, -1, 0, 1, 1, 0, 1, 0, 1, -1, 1, 0], np.int32)
    maps = collocations.Bitmaps(numbers, 2)
    seen = Counter()
    for word, block, bits in maps.branches():
        p, w, _, both = maps.extend(word, block, bits)
        for a, b, n in zip(p.tolist(), w.tolist(), np.bitwise_count(both).tolist(), strict=True):
            seen[a, b] += n
    want = Counter((a, b) for a, b in zip(numbers[:-1].tolist(), numbers[1:].tolist(), strict=True) if a >= 0 and b >= 0)
    assert seen == want


def toxic_rows(n, seed):
    rnd = random.Random(seed)
    clean = [f"t{k}" for k in range(400)]
    rows = []
    for i in range(n):
        words = [rnd.choice(clean) for _ in range(rnd.randrange(5, 80))]
        bad = i % 6 == 0
        if bad:
            for w in rnd.sample(["vile", "scorn", "hateful", "nasty"], 2):
                words.insert(rnd.randrange(len(words)), w)
        rows.append((i, " ".join(words).title(), int(bad)))
    return rows


def test_toxicity_on_held_out_texts(spark):
    rows = toxic_rows(2400, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.where("doc_id < 1800").select("doc_id", "toxic"))
    got = df.where("doc_id >= 1800").select("toxic", toxicity.score(model, F.col("text")).alias("s")).collect()
    hit = [(r["toxic"], r["s"] >= 0.5) for r in got]
    assert sum(t and p for t, p in hit) >= 0.95 * sum(t for t, _ in hit) and sum(p and not t for t, p in hit) <= 0.01 * len(hit)
    assert len(model.features) < 300  # L1 leaves a short list
    again = toxicity.fit(df.select("doc_id", "text").repartition(5), df.where("doc_id < 1800").select("doc_id", "toxic"))
    assert np.array_equal(model.features, again.features) and np.allclose(model.weights, again.weights)
    few = toxicity.sample_labels(df, "doc_id", "toxic", 100)
    assert few.count() == 100


def test_toxicity_of_awkward_rows(spark):
    rows = toxic_rows(600, 4) + [(10_000 + i, t, i % 2) for i, t in enumerate(AWKWARD)] + [(None, "vile", 1), (3, "vile scorn", None), (3, "vile scorn", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("label", F.lit("x")).withColumn("turn", F.lit("y"))
    model = toxicity.fit(df, df)
    scores = [r["s"] for r in df.select(toxicity.score(model, F.col("text")).alias("s")).collect()]
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)
    none = df.where("doc_id < 0")
    for labels, want in ((none, 0.5), (df.where("toxic = 1"), 1.0), (df.where("toxic = 0"), 0.0)):
        only = toxicity.fit(df, labels.select("doc_id", "toxic"))
        assert abs(df.select(toxicity.score(only, F.col("text")).alias("s")).first()["s"] - want) < 1e-9
    assert none.select(toxicity.score(model, F.col("text"))).count() == 0


def test_op13_on_the_smallest_tables(spark):
    import zlib

    rows = queries.QUERIES["op13_toxicity"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


@pytest.fixture(scope="module")
def with_maps(spark):
    rows = [(i % 6, f"word{i % 4} " * 30, "en", f"s{i % 2}", f"http://a{i}.net/en/", {"k": str(i % 4)}, [{"d": str(i)}]) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string, tags map<string,string>, deep array<map<string,string>>")
    return df.withColumn("v", F.parse_json(F.lit('{"a": 1}')))


def test_columns_without_a_hash_pass_through(spark, with_maps):
    import corpus_pipeline

    assert with_maps.select(row_hash(with_maps).alias("h")).distinct().count() == 24
    n = with_maps.count()
    assert sharding.assign_shards(with_maps, n_shards=3).count() == n
    assert mixing.mix_sources(with_maps, F.lit("d"), F.col("lang"), F.col("source"), {}, 50).count() == n
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    assert url_filter.filter_urls(with_maps, rules).where("verdict = 'block'").count() == n
    assert ngram_join.one_of_each(with_maps).columns == with_maps.columns
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, with_maps, "")
        assert out.columns == with_maps.columns and out.where("tags is not null and v is not null").count() == out.count() > 0, name


def test_hot_keys_are_joined_once(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 5000).alias("k"), F.col("id").alias("v"))
    keyed = spark.range(0, 5000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x")).unionByName(spark.createDataFrame([(7, 1)], "k long, x long"))
    for how in ("inner", "left"):
        got, want = join_hot(rows, keyed, "k", how), rows.join(keyed, "k", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    assert "Exchange" in join_hot(rows, keyed, "k")._jdf.queryExecution().executedPlan().toString()


def test_wide_vocabularies_keep_their_ids(spark, tmp_path):
    """Ids beyond 65,535 are stored whole, and ids that do not fit are refused."""
    ids = np.array([0, 65_535, 65_536, 69_999, 2], np.int64)
    shard = wavelet.Shard(wavelet.build(ids, np.array([5]), np.array([5]), 17))
    assert shard.tokens().tolist() == ids.tolist()
    with pytest.raises(ValueError, match="do not fit"):
        wavelet.build(ids, np.array([5]), np.array([5]), 16)
    vocab = {f"w{k}": k for k in range(70_000)} | {"[UNK]": 70_000}
    path = tmp_path / "wide.json"
    path.write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": vocab, "unk_token": "[UNK]"}}))
    assert wavelet.plane_count(path.read_text(), 2) == 17
    df = spark.createDataFrame([(1, "w69999 w5"), (2, "w65536"), (3, None)], "doc_id long, text string")
    folder = new_path(spark, "wide")
    wavelet.write_token_shards(df, folder, str(path))
    image = spark.read.parquet(folder).orderBy("shard").first()["image"]
    assert wavelet.Shard(bytes(image)).tokens().tolist()[:2] == [69_999, 5]
    assert [r["n_tokens"] for r in wavelet.read_token_shards(spark, folder).orderBy("doc_id").collect()] == [3, 2, 1]


def test_very_long_texts_and_urls(spark):
    long = "word " * 150_000
    df = spark.createDataFrame([(1, long, "s"), (2, long, "s"), (3, "x", "t")], "doc_id long, text string, source string")
    assert sharding.assign_shards(df, n_shards=2).groupBy("shard").count().count() == 2
    assert mixing.mix_sources(df, F.lit("d"), F.lit("en"), F.col("source"), {}, 100).agg(F.sum("mix_tokens")).first()[0] == 300_001
    pages = spark.createDataFrame([(1, "http://" + "a." * 50 + "net/" + "p" * 500_000)], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    assert url_filter.filter_urls(pages, rules).first()["verdict"] == "block"
    path = new_path(spark, "long")
    wavelet.write_token_shards(df, path, queries.tokenizer_path("word_bpe_49k.json"))
    assert [r["n_tokens"] for r in wavelet.read_token_shards(spark, path).orderBy("doc_id").collect()][:2] == [150_001, 150_001]
    from placeweave.llm import repeats

    want = brute.repeats([long[:5000], long[:5000] + "tail"])
    got = repeats.remove_repeats(spark.createDataFrame([(1, long[:5000]), (2, long[:5000] + "tail")], "doc_id long, text string")).orderBy("id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got] == [w[:3] for w in want]


def test_written_shards_hold_all_rows_in_slot_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}", f"s{i % 3}") for i in range(500)], "doc_id long, text string, source string")
    sharding.write_shards(df, str(tmp_path / "shards"), n_shards=4)
    read = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r["shard"], r["slot"]) for r in read.collect()) == [(s, k) for s in range(4) for k in range(125)]
    at = [r["slot"] for r in read.where("shard = 2").select("slot", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")).orderBy("f", "n").collect()]
    assert sum(b < a for a, b in zip(at[:-1], at[1:], strict=True)) <= 3  # in order within each file
