"""The registered queries against plain versions, and defined results at the edges: clashing names, nulls, one id, long texts."""

import hashlib
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from placeweave.llm import mixing, ngram_join, order_minhash, personal_data, quality, queries, repeats, sentence_pieces, sharding, url_filter, wavelet
from placeweave.llm.shared import new_path

DATA = "/root/testdata/sf0.001"
#: Every name that an operator or the pipeline uses for itself.
CLASHES = [
    "id", "tie", "row", "h", "s", "f", "n", "at", "task", "number", "place", "seq", "before", "held", "of", "first", "start", "shard", "slot", "key", "range",
    "ghost", "to", "host", "path", "rule", "verdict", "salt", "best", "r", "kept", "clean_text", "n_words", "base_failed", "spans", "base", "digest", "group",
    "component_id", "document", "new_text", "row_hash", "mix_tokens", "epochs", "m_domain", "tokens", "part", "parts", "text_digest_1", "text_digest_2", "doc", "_id", "_row", "_q", "_b", "_n", "a.b",
]
OWN = {"sharding": {"shard", "slot"}, "mixing": {"mix_tokens", "epochs", "m_domain"}, "quality": {"kept", "clean_text", "n_words", "base_failed"}, "url": {"host", "path", "rule", "verdict"}}


def words_of(k, n):
    return " ".join(f"w{(k * 37 + j * 11) % 401}x{j % 7}" for j in range(n))


@pytest.fixture(scope="module")
def clashing(spark):
    texts = [words_of(1, 40) + ".", words_of(1, 40) + ".", words_of(2, 60), None, "", "mail a@b.org now " + words_of(3, 30), words_of(4, 300)]
    rows = [(None if i == 3 else i % 5, t, "en", None if i % 2 else "", f"http://a{i}.net/en/") for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string")
    return df.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce("text", F.lit("null"))).alias(c) for c in CLASHES])


def passed_through(got, df, own=frozenset()):
    """Every row of got has its columns of df's as they were."""
    keep = [c for c in df.columns if c not in own]
    pick = lambda d: sorted(map(str, d.select(*[F.col(f"`{c}`") for c in keep]).collect()))
    assert set(keep) <= set(got.columns)
    assert pick(got) == pick(df)


def test_operators_keep_columns_that_clash_with_their_own(spark, clashing):
    passed_through(sharding.assign_shards(clashing, n_shards=3), clashing, OWN["sharding"])
    passed_through(mixing.mix_sources(clashing, F.lit("d"), F.col("lang"), F.col("source"), {}, 50), clashing, OWN["mixing"])
    passed_through(quality.quality_rules(clashing), clashing, OWN["quality"])
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    judged = url_filter.filter_urls(clashing, rules)
    passed_through(judged, clashing, OWN["url"])
    assert {r["rule"] for r in judged.select("rule").collect()} == {"net/"}


def test_operators_with_results_of_their_own_take_any_columns(spark, clashing):
    n = clashing.count()
    for out in (personal_data.find_personal_data(clashing), ngram_join.jaccard_components(clashing), order_minhash.compare_edited(clashing), repeats.remove_repeats(clashing)):
        assert out.count() == n
    one = ngram_join.one_of_each(clashing)
    assert one.columns == clashing.columns and one.where("text is not null and text <> ''").count() == 4
    path = new_path(spark, "wavelet")
    wavelet.write_token_shards(clashing, path, queries.tokenizer_path("word_bpe_49k.json"))
    assert wavelet.read_token_shards(spark, path).count() == n


def test_pipeline_stages_keep_columns_that_clash(spark, clashing):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, "")
        assert out.columns == clashing.columns, name
        rows = out.select("`a.b`", "spans", "epochs", "document").collect()
        assert rows and all(r["spans"].startswith("spans-") and r["epochs"].startswith("epochs-") for r in rows), name


def test_tables_of_one_id(spark):
    df = spark.createDataFrame([(None if i % 2 else 1, words_of(i % 9, 30), "s") for i in range(200)], "doc_id long, text string, source string")
    got = sharding.assign_shards(df, n_shards=4).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(4) for k in range(50)]
    mixed = mixing.mix_sources(df, F.lit("d"), F.lit("en"), F.col("source"), {}, 50)
    assert 0 < mixed.where("epochs > 0").count() <= 100
    assert order_minhash.compare_edited(df).count() == 200
    near = {r["id"]: r["component_id"] for r in ngram_join.jaccard_components(df).collect()}
    assert near == {1: 1, None: 1}


def test_null_and_empty_sources_are_two(spark):
    df = spark.createDataFrame([(i, [None, ""][i % 2]) for i in range(40)], "doc_id long, source string")
    for r in sharding.assign_shards(df, n_shards=4).groupBy("shard", "source").count().collect():
        assert r["count"] == 5


def test_very_long_texts(spark):
    import sentencepiece

    long = words_of(5, 120_000)  # 0.8 MB
    rows = [(1, long), (2, long + " tail"), (3, "a" * 300_000), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["id"]: r["component_id"] for r in ngram_join.jaccard_components(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r["doc_id"]: r["n_words"] for r in quality.quality_rules(df).collect()} == {1: 120_000, 2: 120_001, 3: 1, 4: 1}
    assert personal_data.find_personal_data(df).where("size(base) > 0").count() == 0
    assert [r["n_chars"] for r in order_minhash.compare_edited(df).orderBy("doc_id").select("n_chars").collect()] == [len(t) for _, t in rows]
    path = queries.tokenizer_path("piece_bpe_32k.model")
    encode = sentence_pieces.piece_functions(spark, path)[0]
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r["ids"] for r in df.select("doc_id", encode(F.col("text")).alias("ids")).collect()}
    assert got == {i: lib.encode(t) for i, t in rows}


def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def rows_of(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, DATA).collect()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_op1_on_the_smallest_tables(spark):
    got = rows_of(spark, "op1_personal_data")
    for i, t in documents(spark):
        base = brute.personal(t)
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert got[i]["base_sha256"] == brute.personal_digest(t) and {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans)
        assert [got[i][f"n_{k}"] for k in personal_data.KINDS] == [sum(s.startswith(f"{k}:") for s in spans) for k in personal_data.KINDS] and got[i]["n_spans"] == len(spans)


def test_op3_and_op9_on_the_smallest_tables(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    pieces = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    lib, start = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json")), 0
    three, nine = rows_of(spark, "op3_sentence_pieces"), rows_of(spark, "op9_wavelet")
    for i, t in documents(spark):
        ids = pieces.encode(t)
        assert (three[i]["n_tokens"], three[i]["ids_sha256"], three[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(pieces.decode(ids)))
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        assert (nine[i]["start"], nine[i]["n_tokens"], nine[i]["ids_crc32"]) == (start, len(ids), crc)
        start += len(ids)


def test_op4_on_the_smallest_tables(spark):
    got, docs = rows_of(spark, "op4_sharding"), documents(spark)
    assert len(got) == len(docs)
    for i, t in docs:
        r = got[i]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None)
    slots = sorted((r["shard"], r["slot"]) for r in got.values())
    counts = [sum(s == k for s, _ in slots) for k in range(16)]
    assert max(counts) - min(counts) <= 1 and slots == [(k, j) for k in range(16) for j in range(counts[k])]


def test_op6_on_the_smallest_tables(spark):
    got, docs = rows_of(spark, "op6_order_minhash"), documents(spark)
    for k, (i, t) in enumerate(docs):
        half, other = len(t) // 2, docs[(k + 1) % len(docs)]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(t[: len(t) - half] + other[1][:half]))
        pairs = [(r["fingerprint"][j : j + 8], got[other[0]]["fingerprint"][j : j + 8]) for j in range(0, 512, 8)]
        filled = [(a, b) for a, b in pairs if (a, b) != ("--------", "--------")]
        assert r["near_next"] == (sum(a == b for a, b in filled) / len(filled) if filled else 1.0)
        assert 0 <= r["near_edited"] <= 1


def test_op10_on_the_smallest_tables(spark):
    got, docs = rows_of(spark, "op10_repeats"), documents(spark)
    want = brute.repeats([t for _, t in docs])
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == {i: w for (i, _), w in zip(docs, want, strict=True)}


def test_order_minhash_tells_moved_text_from_the_same_words(spark):
    """Likeness falls with edits, and moving sentences of a short text lowers it where a plain MinHash would not."""
    base = [words_of(k, 8) for k in range(6)]  # 48 words
    moved, edited = [*base[3:], *base[:3]], [*base[:5], words_of(90, 8)]
    rows = [(" ".join(x),) for x in (base, moved, edited, [words_of(200 + k, 8) for k in range(6)])]
    sigs = [r["s"] for r in spark.createDataFrame(rows, "text string").select(order_minhash.signature(F.col("text")).alias("s")).collect()]
    like = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / 64
    assert all(x is not None for s in sigs for x in s)  # every component is filled, however short the text
    assert like(sigs[0], sigs[2]) > 0.4 and 0.2 < like(sigs[0], sigs[1]) < 0.9 and like(sigs[0], sigs[3]) < 0.1
