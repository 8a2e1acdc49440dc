"""Operators against plain versions, libraries and SQL, on small fixtures with all kinds of odd rows."""

import hashlib
import os
import random
import uuid
import zlib
from collections import Counter

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from placeweave.llm import components, mixing, ngram_join, order_minhash, personal_data, quality, queries, repeats, sentence_pieces, sharding, shared, url_filter, wavelet
from placeweave.llm.shared import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind string, key long, path string"
DATA = "/root/testdata/sf0.001"


def passage(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


ODD = [
    None, "", "   \n\t ", "one", "one two three", "Mail A.B@x-y.org, or a@b.c@d.ef and +1 (487) 555-7209 now.",
    "card 4111 1111 1111 1111 and 4111111111111112 ip 10.0.0.255 1.2.3.4.5.6.7.8 300.1.1.1 0010.2.3.4", "a" * 5000, "7" * 3000, "é中😀 " * 90,
    "Home | About | Contact\nReal words stand here in a line that goes on and ends well.", "x\n" * 50, passage(1), passage(1), passage(1) + " tail",
    passage(1, 58) + " other end here", passage(2) + "\n" + passage(3), passage(3) + "\n" + passage(4), "ab" * 400, "ab" * 333, passage(5, 900),
    "token = deadbeef99 token = deadbeef99", "<s> \u2581 \u2581\u2581x\x00\x1c\x85y <|endoftext|>", "same same same same same same same same same same",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ["en", "de", None][i % 3], None if i % 7 == 3 else f"src{i % 4}", len(t or ""), "k", i, "p") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_personal_data_base_spans(odd):
    found = personal_data.find_personal_data(odd).withColumn("s", personal_data.spans_text(F.col("base")))
    assert {r["id"]: r["s"] for r in found.collect()} == {i: ",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(t)) for i, t in enumerate(ODD)}


@pytest.mark.parametrize("seed", range(40))
def test_fixed_patterns_on_noise(seed):
    r = random.Random(seed)
    text = "".join(r.choice("ab1290.@+- ()%\n_é") for _ in range(400)) + "+49 30 1234567890 " + "4111111111111111"
    assert [(personal_data.KINDS[k], a, b) for a, b, k in personal_data.fixed_spans(text)] == brute.personal(text)


def test_personal_data_discovers_by_context(spark):
    rows = [(i, f"please write to user{i}@example.org today") for i in range(20)] + [(100, "please write to user77(at)example today"), (101, "there were 123456 of them")]
    found = {r["id"]: r["spans"] for r in personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["start"], s["end"], s["kind"]) for s in found[100]] == [(16, 33, 0)] and found[101] == []
    text = personal_data.redact(F.col("text"), F.col("spans"))
    joined = personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).join(spark.createDataFrame(rows, "id long, text string"), "id")
    assert joined.where("id = 100").select(text).first()[0] == "please write to [EMAIL] today"


def planted_contexts(seed=5, n=600):
    """Texts with identifiers the fixed patterns know and others that they do not, all in telling contexts, and numbers elsewhere.

    Gives (id, text) and the hidden identifiers as (id, start, end, kind).
    """
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    card = lambda: next(c for c in iter(lambda: digits(16), None) if brute.luhn(c))
    broken = lambda: next(c for c in iter(lambda: digits(16), None) if not brute.luhn(c))
    groups = lambda c: " ".join(c[i : i + 4] for i in range(0, 16, 4))
    kinds = [
        (["please write to {} today", "mail came from {} last"], lambda: f"{name()}@{name()}.org", [lambda: f"{name()} at {name()} dot org", lambda: f"{name()}(at){name()}(dot)com", lambda: f"{name()}@{name()}"]),
        (["the server address {} was", "login from host {} at"], lambda: f"10.{r.randrange(256)}.{r.randrange(256)}.7", [lambda: f"host-{digits(3)}.lan", lambda: f"fe80::{digits(4)}:{digits(4)}"]),
        (["charged card number {} for", "paid by account {} and"], card, [lambda: groups(broken()), lambda: f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}"]),
        (["call me on {} after", "my new phone {} rings"], lambda: f"+1 ({digits(3)}) 555-{digits(4)}", [lambda: f"020 {digits(4)} {digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"]),
    ]
    rows, hidden = [], set()
    for i in range(n):
        k = r.randrange(4)
        places, seen, unseen = kinds[k]
        find = i % 4 == 0
        value = r.choice(unseen)() if find else seen()
        before, after = r.choice(places).split("{}")
        lead = f"{passage(i, 12)} there were {digits(6)} of them in room {digits(7)} on {digits(4)}-{digits(2)}-{digits(2)} when "
        if find:
            hidden.add((i, len(lead + before), len(lead + before + value), k))
        rows.append((i, f"{lead}{before}{value}{after} {passage(i + n, 9)}"))
    return rows, hidden


def test_discovery_on_a_planted_corpus(spark):
    """Precision and recall of what the patterns add, over identifiers that no fixed pattern knows."""
    rows, hidden = planted_contexts()
    out = personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {(r["id"], s["start"], s["end"], s["kind"]) for r in out for s in r["spans"] if s not in r["base"]}
    assert len(hidden) == 150 and len(added & hidden) / len(added) >= 0.98 and len(added & hidden) / len(hidden) >= 0.95, (len(added), len(added & hidden), sorted(hidden - added)[:5])


def test_candidates_and_contexts():
    at = lambda text: [text[a:b] for a, b in personal_data.candidates(text, personal_data.fixed_spans(text))]
    assert at("tel. 020 7946 0958, or (555) 123-4567.") == ["020 7946 0958", "(555) 123-4567"]
    assert at("ask bob at example dot org or x1(at)y.com") == ["bob at example dot org", "x1(at)y.com"]
    assert at("IBAN DE89 3704 0044 0532 0130 00 a@b.org") == ["DE89 3704 0044 0532 0130 00"]
    assert at(" ".join(["12"] * 9) + "\n" + "a" * 100_000 + "1") == ["a" * 100_000 + "1"]
    assert personal_data.contexts("one two 123456 three", 8, 14) == ["one two _", "two _ three"]
    assert personal_data.contexts("w" * 500 + " 123456 " + "v" * 500, 501, 507) == []


def test_personal_data_of_hot_rows_contexts_and_instances(spark, monkeypatch):
    """A third of all rows are one text, and one candidate stands in most others: results as without hot keys."""
    rows = [(i, f"please write to user{i}@example.org today") for i in range(20)] + [(None, "please write to user77(at)example today")] * 60 + [(100 + i, f"row {i} says please write to root(at)example today") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, personal_data.find_personal_data(df).collect()))
    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    got = sorted(map(str, personal_data.find_personal_data(df).collect()))
    assert got == want and sum("end=33" in x for x in got) >= 60


def test_empty_tables(spark, empty):
    assert personal_data.find_personal_data(empty).count() == 0
    assert quality.quality_rules(empty).count() == 0
    assert sharding.assign_shards(empty).count() == 0
    assert mixing.mix_sources(empty, F.lit("d"), F.col("lang"), F.col("source"), {"d": 1}, 50).count() == 0
    assert order_minhash.compare_edited(empty).count() == 0
    assert ngram_join.jaccard_components(empty).count() == 0
    assert repeats.remove_repeats(empty).count() == 0
    path = new_path(spark, "none")
    wavelet.write_token_shards(empty, path, queries.tokenizer_path("word_bpe_49k.json"))
    assert wavelet.read_token_shards(spark, path).count() == 0
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.filter_urls(pages, rules).first()["verdict"] == "allow"


def test_quality(odd):
    got = by_id(quality.quality_rules(odd))
    for i, text in enumerate(ODD):
        w = brute.words(text)
        seen = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        covered = {p for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for p in range(j, j + 8)}
        lines = [x for x in (text or "").split("\n") if brute.words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r["n_symbols"] == sum((text or "").count(c) for c in "#*$%&|<>")
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert got[10]["clean_text"] == ODD[10].split("\n")[1] and got[20]["kept"] and got[9]["kind"] == "k"


def test_sentence_pieces_equal_the_library(spark, odd):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    encode, decode, both = sentence_pieces.piece_functions(spark, path)
    r = random.Random(3)
    parts = ["a", "the", " ", "  ", "▁", "é", "\n", "中", "😀", "\x00", "ing", "12", "aaaa", "abab", "s", "er", "<s>", "\u0301", "        "]
    noise = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(500)] + ["a" * 300, " " * 40]
    df = odd.select("text").unionByName(spark.createDataFrame([(t,) for t in noise], "text string"))
    for row in df.select("text", encode(F.col("text")).alias("ids"), both(F.col("text")).alias("both")).withColumn("back", decode(F.col("ids"))).collect():
        want = lib.encode(row["text"] or "")
        assert row["ids"] == want and row["back"] == lib.decode(want)
        assert row["both"]["ids"] == want and row["both"]["decoded"] == row["back"]


def test_shards(odd):
    twice = odd.unionByName(odd)
    got = sharding.assign_shards(twice, n_shards=5).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == 2 * len(ODD) and max(sizes.values()) - min(sizes.values()) <= 1 and sorted(sizes) == list(range(5))
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    for source in {r["source"] for r in got}:
        each = Counter(r["shard"] for r in got if r["source"] == source)
        assert max(each[s] for s in sizes) - min(each[s] for s in sizes) <= 2


def test_shards_match_a_plain_version(spark):
    rows = [(i, f"s{i % 3 if i % 2 else 0}") for i in range(500)]
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, source string"), n_shards=7, seed=5).collect()}
    key = {i: hashlib.md5(f"5:{i}".encode()).hexdigest() for i, _ in rows}
    places = []
    for s in {s for _, s in rows}:
        mine = sorted((key[i], i) for i, t in rows if t == s)
        places += [((2 * k + 1) / (2 * len(mine)), s, h, i) for k, (h, i) in enumerate(mine)]
    for place, (_, _, _, i) in enumerate(sorted(places)):
        shard = place * 7 // 500
        assert got[i] == (shard, place - -(-shard * 500 // 7))


def test_mixing_keeps_budget_and_redistributes(spark):
    rows = [(i, "en" if i % 3 else "de", "small" if i < 10 else f"big{i % 2}", 10) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n long")
    got = mixing.mix_sources(df, F.lit("d"), F.col("lang"), F.col("source"), {"d/en/small": 50, "d/de/big0": 0}, 50, n_tokens=F.col("n")).collect()
    taken = Counter()
    for r in got:
        taken[r["lang"], r["source"]] += r["epochs"] * r["n"]
    assert taken["en", "small"] == sum(10 for i, la, s, _ in rows if (la, s) == ("en", "small"))  # all of it: its share is larger
    assert taken["de", "big0"] == 0 and 1960 <= sum(taken.values()) <= 2000
    assert len(got) == 400
    again = mixing.mix_sources(df.unionByName(df), F.lit("d"), F.col("lang"), F.col("source"), {}, 50, n_tokens=F.col("n")).groupBy("doc_id").agg(F.countDistinct("epochs").alias("k"))
    assert again.where("k <> 1").count() == 0


def test_order_minhash(odd):
    got = by_id(order_minhash.compare_edited(odd).withColumns({"f": order_minhash.fingerprint(F.col("sig")), "e": order_minhash.likeness(F.col("sig"), F.col("edited_sig")), "x": order_minhash.likeness(F.col("sig"), F.col("next_sig"))}))
    texts = [t or "" for t in ODD]
    for i, t in enumerate(texts):
        half = len(t) // 2
        assert got[i]["edited_text"] == t[: len(t) - half] + texts[(i + 1) % len(texts)][:half]
        assert got[i]["n_chars"] == len(t) and 0 <= got[i]["e"] <= 1
    assert got[12]["f"] == got[13]["f"] and got[12]["x"] == 1.0 and got[0]["x"] == 1.0


def test_order_minhash_matches_a_plain_version(spark):
    import xxhash

    def h(values, seed=42):
        for v in values:
            seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else (v % (1 << 64)).to_bytes(len_of(v), "little"), seed)
        return seed - (1 << 64) if seed >= 1 << 63 else seed

    len_of = lambda v: 8
    texts = [passage(7, 300), "a b c d " * 30, "a b", passage(8, 6)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", order_minhash.signature(F.col("text")).alias("s")).collect()
    for r in rows:
        w = [x.encode() for x in brute.words(texts[r["doc_id"]])]
        one = [h([x]) for x in w]
        grams = [h(one[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [h(w)]
        seen, numbered = Counter(), []
        for g in grams:
            n, seen[g] = seen[g], seen[g] + 1
            # the occurrence is an int: four bytes, hashed after the k-mer
            numbered.append(g if n == 0 else _with_int(xxhash, h([g]), n))
        # Component b: the two k-mers that come first on the ring after its point, in text order.
        mask, want = (1 << 30) - 1, []
        ring = sorted((x & ~mask) | i for i, x in enumerate(numbered))
        for b in range(64):
            point = (b << 58) - (1 << 63)
            after = [p for p in ring if p > point | mask] + ring
            order = sorted({p & mask for p in after[: min(2, len(ring))]})
            want.append(h([numbered[i] for i in order]) >> 32)
        assert r["s"] == want


def _with_int(xxhash, seed, n):
    """Spark hashes an int by its own four-byte round, which equals XXH64 of four bytes."""
    v = xxhash.xxh64_intdigest(n.to_bytes(4, "little"), seed % (1 << 64))
    return v - (1 << 64) if v >= 1 << 63 else v


def test_jaccard_components(odd):
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(odd).collect()}
    assert got == brute.components(list(enumerate(ODD)))


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_components_of_small_and_long_lists(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIGHT", 3)
    r = random.Random(seed)
    base = [passage(k, r.choice([5, 6, 7, 8, 9, 10, 12, 15, 40, 90])) for k in range(14)]
    rows = []
    for i in range(170):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([["zz"], [], ["qq", "rr"], [w[at].upper()]])
        rows.append((i, " ".join(w + base[0].split() * (i % 9 == 0))))
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.components(rows)


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_components_of_hot_shingles_and_open_lists(spark, seed, monkeypatch):
    """Texts put together from common passages: long lists that no component joins, split and compared in blocks."""
    monkeypatch.setattr(ngram_join, "LIGHT", 3)
    monkeypatch.setattr(ngram_join, "LONG", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    for module in (ngram_join, shared):
        monkeypatch.setattr(module, "HOT_ROWS", 10)
    monkeypatch.setattr(components, "FEW", 0)
    r = random.Random(seed)
    pool = [passage(k, r.choice([20, 30, 40])) for k in range(8)]
    rows = [(i, " ".join([*r.sample(pool, 3), passage(100 + i, r.choice([0, 3, 8, 20]))])) for i in range(150)]
    rows += [(200 + i, pool[0] + " same") for i in range(40)] + [(300 + i, rows[i][1] + " x") for i in range(20)]
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.components(rows)


def test_small_sets_meet_by_subsets_where_lists_cost_more(spark):
    """Many near copies of short texts: lists are long, so subsets are cheaper and the boundary rises above zero."""
    r = random.Random(4)
    rows = []
    for i in range(300):
        w = passage(i % 3, 12).split()
        w[r.choice([0, 11])] = f"w{i}"
        rows.append((i, " ".join(w)))
    seen = []
    real = ngram_join._small_links
    ngram_join._small_links = lambda sets, boundary: seen.append(boundary) or real(sets, boundary)
    try:
        got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        ngram_join._small_links = real
    assert got == brute.components(rows) and seen and seen[0] >= 8


def test_one_of_each_keeps_one_row_of_a_component(spark):
    text = passage(1)
    rows = [(None, text, "a"), (7, text, "b"), (7, text, "c"), (7, passage(2), "d"), (None, text + " tail", "e"), (None, "", "f"), (3, None, "g"), (9, passage(2), "h"), (None, passage(3), "i"), (None, passage(3), "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").withColumns({"h": F.lit(1), "row": F.lit(2), "tie": F.lit(3), "group": F.lit(4)})
    got = ngram_join.one_of_each(df)
    assert got.columns == df.columns
    kept = sorted((str(r["doc_id"]), r["id"]) for r in got.collect())
    assert [k for k in kept if k[1] in "dfghi"] == [("3", "g"), ("7", "d"), ("None", "f"), ("None", "i")] and len(kept) == 5 and {k[1] for k in kept} & {"b", "c"}


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("b.example.net", "/en/x", "block"), ("org", "/fr/", "allow"), ("org", "/f", "block")]
    hosts = ["net", "example.net", "b.example.net", "c.b.example.net", "xexample.net", "Org", "a.org", "com", "network", ""]
    rows = [(i, u) for i, u in enumerate([f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en/x?/fr/", "/fr/#a", "/f", "?q")] + [None, "no scheme", "a://b://c/d", "x"])] * 2
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(rows)
    for r in got:
        rest = r["url"].split("://", 1)[1] if r["url"] and "://" in r["url"] else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best[2], best[3])


def test_wavelet_files(spark, odd, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 700)
    path, file = new_path(spark, "wavelet"), queries.tokenizer_path("word_bpe_49k.json")
    wavelet.write_token_shards(odd, path, file)
    got = by_id(wavelet.read_token_shards(spark, path))
    lib, start, flat = Tokenizer.from_file(file), 0, []
    for i, t in enumerate(ODD):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), crc)
        start += len(ids)
        flat.append(ids)
    shard = wavelet.read_shard(spark, path, 20)
    own = [x for i in shard.doc_ids.tolist() for x in flat[i]]
    assert 20 in shard.doc_ids.tolist() and shard.tokens().tolist() == own
    for token in {*own[:50], 2, 7, 49407}:
        where = [i for i, x in enumerate(own) if x == token]
        assert shard.count(token) == len(where) and [shard.find(token, k) for k in range(len(where) + 1)] == [*where, None]
    assert [shard.access(i) for i in range(0, len(own), 17)] == own[::17]


def test_wavelet_rows_equal_in_id_and_text_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # a shard for every two rows
    try:
        df = spark.createDataFrame([(None, None)] * 7 + [(5, passage(1))] * 9 + [(6, "one two")], "doc_id long, text string")
        path = new_path(spark, "wavelet")
        wavelet.write_token_shards(df, path, queries.tokenizer_path("word_bpe_49k.json"))
        got = sorted(wavelet.read_token_shards(spark, path).collect(), key=lambda r: r["start"])
        assert spark.read.parquet(path).count() >= 8
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["doc_id"] for r in got] == [None] * 7 + [5] * 9 + [6]
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]


def test_repeats(odd):
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in repeats.remove_repeats(odd).collect()}
    assert got == dict(enumerate(brute.repeats(ODD)))


@pytest.mark.parametrize("seed", range(3))
def test_repeats_in_noise(spark, seed):
    r = random.Random(seed)
    pool = ["".join(r.choice("ab ") for _ in range(r.choice([150, 199, 200, 201, 260, 600]))) for _ in range(12)] + ["a" * 700, "abc" * 200, "\u00e9x" * 150]
    texts = ["".join(r.choice([*pool, "Q", "zz", str(r.random())]) for _ in range(r.randint(1, 5))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(bytes(x["kept"])).hexdigest()) for x in repeats.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute.repeats(texts)))


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_a_common_minimizer_meet_in_no_single_task(spark, seed, monkeypatch):
    r = random.Random(seed)
    common = passage(7, 70)
    pool = [passage(20 + i, 50) for i in range(6)] + ["a" * 700, "abc" * 200, "\u00e9x" * 150]
    texts = [f"{r.choice(pool)} {r.random()} {common} {r.random()} {r.choice(pool)}" + "Q" * r.randint(0, 3) + r.choice(["", common[:230], common[40:90]]) for _ in range(60)]
    # Stretches of up to 2000 bytes a minimizer are compared in one task; no task may be given more of one than that.
    monkeypatch.setattr(repeats, "BATCH_BYTES", 2000)
    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    compared, seen = repeats._compare, new_path(spark, "largest")
    os.makedirs(seen)

    def watched(batches):
        for batch in batches:
            sizes = Counter()
            for key, part in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                sizes[key] += len(part)
            with open(f"{seen}/{uuid.uuid4()}", "w") as f:
                f.write(str(max(sizes.values(), default=0)))
            yield from compared(iter([batch]))

    monkeypatch.setattr(repeats, "_compare", watched)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(bytes(x["kept"])).hexdigest()) for x in repeats.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute.repeats(texts)))
    assert max((int(open(f"{seen}/{n}").read()) for n in os.listdir(seen)), default=0) <= 2000


@pytest.mark.parametrize("large", [0, 1 << 20])
def test_repeats_compared_apart_or_together(spark, large, monkeypatch):
    monkeypatch.setattr(repeats, "BATCH_BYTES", large)
    texts = [*ODD, *(passage(1, 40 + i) + f" {i} " + passage(2, 30 + i) for i in range(12))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(bytes(x["kept"])).hexdigest()) for x in repeats.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute.repeats(texts)))


def test_null_and_repeated_ids(spark):
    rows = [(None, passage(1)), (5, passage(1)), (5, passage(1)), (5, passage(9)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for out in (personal_data.find_personal_data(df), ngram_join.jaccard_components(df), repeats.remove_repeats(df), order_minhash.compare_edited(df)):
        assert out.count() == 5
    assert quality.quality_rules(df).count() == 5
    path = new_path(spark, "wavelet")
    wavelet.write_token_shards(df, path, queries.tokenizer_path("word_bpe_49k.json"))
    assert wavelet.read_token_shards(spark, path).count() == 5


def test_registered_queries_on_the_smallest_tables(spark):
    from placeweave.llm import oracles

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in oracles.SQL.items():
        df = queries.QUERIES[name](spark, DATA)
        want = con.sql(sql)
        cols = sorted(want.columns)
        assert cols == sorted(df.columns)
        rows = lambda rs: sorted(map(str, rs))
        assert rows([tuple(r[c] for c in cols) for r in df.collect()]) == rows([tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()]), name
