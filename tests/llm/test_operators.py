import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from modelweave.llm import common, crosspolytope, graph, langid, minhash, nndescent, packing, pieces, quality, queries, repair, substrings, warc
from modelweave.llm.tokens import BLANK_WORDS, WORDS, ChunkEncoder

WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, score string, kept string"


def _texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = line(90), line(120).split()
    out = [None, "", "  \n\t ", "one", "One two THREE four", line(9000), passage, f"{line(20)} {passage} {line(30)}", f"{line(40)}\n{passage}", "x" * 3000, "ab " * 900, "日本語 😀 text", "a\x1cb\xa0c", "0 1 2 !!"]
    out += [" ".join(base)] * 3
    for k in range(12):
        own = list(base)
        own[rng.randrange(120)] = f"new{k}"
        if k % 2:
            own[rng.randrange(120)] = "again"
        out.append(" ".join(own))
    return out + [line(rng.randint(3, 80)) for _ in range(30)]


@pytest.fixture(scope="module")
def rows():
    own = [(k, t, "en" if k % 3 else None, f"s{k % 2}" if k % 5 else None) for k, t in enumerate(_texts())]
    own += [own[7], own[7], (3, "other text of an id that repeats", "en", "s1")]
    return [(i, t, lang, s, len(t or ""), "k", 1, "x", "y") for i, t, lang, s in own]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# tokens


@pytest.mark.parametrize("path, pattern", [(WORD, WORDS), (BYTE, BLANK_WORDS)])
def test_chunks_give_the_librarys_ids(path, pattern):
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = [t or "" for t in _texts()] + ["".join(rng.choice("aB'st ll.,\n\t \xa0\x85\x1c1２é́İΣ<|endoftext|>") for _ in range(40)) for _ in range(400)]
    texts += ["<|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>  b", "<|startoftext|>x", "it's they'LL", "   "]
    own = ChunkEncoder(path, pattern, cache=500)
    for t, e, got in zip(texts, library.encode_batch(texts, add_special_tokens=False), own.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == e.ids, t


def test_packing(docs, rows, none):
    library = Tokenizer.from_file(WORD)
    got = packing.pack_documents(docs, WORD).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            own = ids[s : s + 2048]
            want[i, k, s, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1 + -(-sum(r.length for r in got) // 2048)
    assert packing.pack_documents(none, WORD).count() == 0
    ids = packing.pack_documents(docs, WORD, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in ids) and len(ids) == len(got)


def test_best_fit_closes_the_fullest():
    own = packing.BestFit(10, 2)
    assert [own.put(n) for n in (8, 6, 7, 2, 4, 3)] == [(0, 0), (1, 0), (2, 0), (2, 7), (1, 6), (3, 0)]


def test_best_fit_is_tightest():
    rng = random.Random(1)
    own, free = packing.BestFit(50, 10**6), []
    for _ in range(500):
        n = rng.randint(1, 50)
        fits = [f for f in free if f >= n]
        bin_, offset = own.put(n)
        if fits:
            assert 50 - offset == min(fits)
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            assert offset == 0
            free.append(50 - n)


def test_token_shards(docs, rows, none):
    library = Tokenizer.from_file(BYTE)
    got = sorted(repair.token_shards(docs, BYTE).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    want = Counter()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    assert repair.token_shards(none, BYTE).count() == 0


def test_null_ids_are_packed_and_written(spark):
    rows = [(None, f"text {k} " * (k + 1), "x") for k in range(9)] + [(1, None, "x"), (1, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    shards = sorted(repair.token_shards(df, BYTE).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in shards] == [None] * 9 + [1, 1]
    assert Counter(r.doc_id for r in packing.pack_documents(df, WORD).collect()) == {None: 9, 1: 2}
    got = _sorted(substrings.remove_repeats(df, 120).select("doc_id", "n_bytes"))
    assert got == sorted(((i, len(t or "")) for i, t, _ in rows), key=str)


@pytest.mark.parametrize("first", [50_257, 65_000, 70_001, 1 << 20])
def test_grammar_of_large_vocabularies(first, tmp_path):
    rng = np.random.default_rng(4)
    docs = [np.append(rng.choice([first - 1, 5, first // 2, 9, min(first - 1, 65_536)], 300), 0).astype("<u4") for _ in range(40)]
    raw = repair.pack_shard([*range(40)], [d.tobytes() for d in docs], first)
    (tmp_path / "x.rp").write_bytes(raw)
    with repair.open_shard(f"file://{tmp_path}/x.rp") as shard:
        assert len(shard.rules) and len(raw) < 4 * sum(map(len, docs))
        assert all((shard.ids(k) == d).all() for k, d in enumerate(docs))
    with pytest.raises(ValueError):
        repair.compress(np.array([first], "<u4"), first)


def test_a_document_is_read_without_the_others():
    docs = [np.append(np.arange(1, 3000) + 3000 * k, 0).astype("<u4") for k in range(10)]
    raw = repair.pack_shard([*range(10)], [d.tobytes() for d in docs], 50_257)
    asked = []
    shard = repair.Shard(lambda at, n: asked.append(n) or raw[at : at + n])
    assert (shard.ids(7) == docs[7]).all() and asked[-1] < len(raw) / 9 and len(asked) == 3


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    docs = [np.append(rng.zipf(1.3, rng.integers(0, 900)) % 500 + 1, 0).astype("<u4") for _ in range(60)]
    docs.append(np.append(np.ones(5000, "<u4") * 7, 0).astype("<u4"))
    raw = repair.pack_shard(list(range(60)) + [None], [d.tobytes() for d in docs], 50257)
    shard = repair.Shard(raw)
    assert shard.doc_ids == [*range(60), None] and len(shard.rules) > 0
    assert len(raw) < 2 * sum(map(len, docs))
    for k, d in enumerate(docs):
        assert (shard.ids(k) == d).all()
        if len(d) > 9:
            assert (shard.window(k, 3, len(d) - 2) == d[3:-2]).all()
    assert [x.tolist() for x in shard.all_ids()] == [d.tolist() for d in docs]


def test_a_word_with_a_mark_is_cut_without_the_pattern():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = ChunkEncoder(path, BLANK_WORDS), Tokenizer.from_file(path)
    marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()]
    texts = [f"{a}{word}{mark}" for a in ("", "go ") for word in ("Hello", "zqxvk", "s", "don't", "été") for mark in marks]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    asked: list[str] = []
    encoder.split = lambda chunk: asked.append(chunk) or regex.findall(r"\p{L}+|\P{L}+", chunk)
    encoder.encode(["words, other things; and more.", "Simple texts: here!"])
    assert not asked


def test_all_documents_of_a_file_are_those_read_alone():
    rng = np.random.default_rng(9)
    phrase = rng.integers(1, 300, 40)
    ids = [np.append(np.tile(phrase, k % 5), 0).astype("<u4").tobytes() for k in range(200)]
    for own in (ids, ids[:1], []):
        shard = repair.Shard(repair.pack_shard(list(range(len(own))), own, 50_257))
        assert [x.astype("<u4").tobytes() for x in shard.all_ids()] == own == [shard.ids(k).astype("<u4").tobytes() for k in range(len(own))]


def test_grammar_goes_on_while_pairs_repeat():
    rng = np.random.default_rng(1)
    doc = np.append(rng.integers(1, 50257, 500), 0).astype("<u4")
    symbols, rules, lengths = repair.compress(np.tile(doc, 400), 50257)
    assert len(symbols) <= 3 * 400 and lengths.max() > 100
    pairs = Counter(zip(symbols[:-1].tolist(), symbols[1:].tolist()))
    assert max(n for p, n in pairs.items() if 0 not in p) < repair.LEAST if any(0 not in p for p in pairs) else True
    assert (repair.expand(symbols, rules, 50257) == np.tile(doc, 400)).all()


def test_sentencepiece(docs, rows, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    own = pieces.PieceModel(PIECE)
    rng = random.Random(2)
    texts = [r[1] or "" for r in rows] + ["".join(rng.choice("abß thin  \n▁.,日😀01\x00") for _ in range(rng.randint(1, 50))) for _ in range(500)]
    for t in texts:
        ids = library.encode(t, add_eos=True)
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids)
        assert own.digest(t) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), 1, 2, 0]) for _ in range(6)]
        assert own.decode(ids) == library.decode(ids)
    got = {r.doc_id: r.n_tokens for r in pieces.round_trip_digests(docs, PIECE).collect() if r.doc_id != 3}
    assert got == {r[0]: len(library.encode(r[1] or "")) + 1 for r in rows if r[0] != 3}
    back = pieces.decode_documents(pieces.encode_documents(docs, PIECE), PIECE)
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r[0], library.decode(library.encode(r[1] or ""))) for r in rows}
    assert pieces.round_trip_digests(none, PIECE).count() == 0


# WARC


def test_warc(spark):
    big, small = "<p>é</p>" * 200, "<p>"
    rows = [(1, "http://www.a.example/x", big), (9, "https://b.example/", big), (5, "http://a.example:80/y?q=1", big), (2, None, None), (3, "", small), (4, "no url\tat all", small),
            (6, "http://www.a.example/x", small), (9, "https://b.example/", big), (7, "http://a.example/" + "z" * 5000, "y" * 200_000), (None, "http://n.example", "n")]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, key string, size int")
    got = Counter(tuple(r)[:5] for r in warc.round_trip(pages).collect())
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        again = html == big and i != 9
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 9 if again else None] += 1
    assert got == want
    captures, index = warc.archive(pages)
    one = spark.createDataFrame([(warc.capture_key("http://www.a.example/x"),), ("none",), (None,)], "key string")
    found = warc.read_records(warc.look_up(one, index), with_payload=True).collect()
    assert sorted((r.page_id, bytes(r.payload or b"")) for r in found) == [(1, b""), (6, small.encode())]
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert warc.capture_key("HTTPS://M.b.Example:8080/p?q") == "example,b,m)/p?q"


def test_index_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [(f"k{i // 7:03d}", i, "p", i, 1) for i in range(100)]
    index = warc.write_index(spark.createDataFrame(rows, "key string, page_id long, path string, offset long, size long").coalesce(1), f"file://{tmp_path}/i")
    got = warc.look_up(spark.createDataFrame([(f"k{k:03d}",) for k in range(20)], "key string"), index)
    assert sorted(r.page_id for r in got.collect()) == list(range(100))


# language and quality


def test_longest_matches():
    table = langid.suffix_automaton(np.array([1, 2, 1, 3]), 5)
    state = 1
    for c in (2, 1, 3):
        state = table[state, c]
    assert state and not table[1, 4] and not table[table[1, 3], 1]


def _phrases(text, reference):
    """Greedy parsing by search."""
    n = 0
    for a in range(0, len(text), langid.STRETCH):
        own, at, size = text[a : a + langid.STRETCH], 0, 0
        n += 1
        for c in own:
            if own[at : at + size] + c in reference:
                size += 1
            else:  # a letter that the reference lacks is the end of a phrase
                n, at, size = (n + 1, at + size, 1) if c in reference else (n + 1, at + size + 1, 0)
    return n


def test_phrases_against_search():
    rng = random.Random(4)
    reference = "".join(rng.choice("abc ") for _ in range(300)).strip()
    model = langid.fit({"x": [reference]})
    ref = " ".join(reference.split())
    for n in (1, 50, 256, 700):
        text = " ".join("".join(rng.choice("abc ") for _ in range(n)).split()) or "a"
        bits, has = model.bits([text])
        assert has[0] == any(c.isalpha() for c in text)
        assert round(bits[0, 0] * len(text) / model.cost[0]) == _phrases(text, ref)


def _bits(model, samples, text):
    """Bits a symbol by each language, by search in its reference."""
    own = "".join(map(chr, model.symbols(text)))
    out = []
    for name, cost in zip(model.languages, model.cost):
        reference = "".join(map(chr, model.symbols(" ".join(dict.fromkeys(samples[name])))[: langid.SYMBOLS]))
        out.append(_phrases(own, reference) * cost / max(1, len(own)))
    return out


def test_language_against_brute_force(spark):
    rng = random.Random(9)
    speech = {"xx": "abcd ", "yy": "cdef ", "zz": "abcd "}  # xx and zz are alike
    text = lambda lang, n: "".join(rng.choice(speech[lang]) for _ in range(n))
    rows = [(k, text(lang, rng.choice([1, 9, 300, 900])), lang if k % 5 else None) for k, lang in enumerate(["xx", "yy", "zz"] * 12)] + [(50, None, "xx"), (51, "12", "yy"), (52, "QQ é", None), (53, "abc", None), (53, "abc", None)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string")
    samples = langid.sample(df.where(~langid.held_out(F.col("doc_id"))))
    model = langid.fit(samples)
    want = []
    for i, t, _ in rows:
        bits = np.array(_bits(model, samples, t or ""))
        known = any(c.isalpha() for c in t or "")
        share = 1 / sum(2 ** (-langid.SHARPNESS * (bits - bits.min()))) if known else 0.0
        want.append((i, model.languages[int(bits.argmin())] if known else "und", round(float(share), 9)))
    assert sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(df).collect()) == sorted(want)
    assert len({w[1] for w in want}) >= 3


def test_language(spark, docs, rows, none):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} == {"en", "und"}
    texts = {r[0]: r[1] for r in rows if r[0] != 3}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id in texts:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or "")) and 0 <= r.score <= 1
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.known_language(docs)
    assert kept.columns == docs.columns and kept.where("text IS NULL").count() == 0


def test_language_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(table).where("held_out").join(table.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


def test_quality(spark, docs, none):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, test = (labels.where(F.pmod("doc_id", F.lit(2)) == k) for k in (0, 1))
    got = quality.score(table, train)
    assert got.count() == table.count()
    right = got.select("doc_id", "kept").join(test, "doc_id").where(F.col("kept") == (F.col("quality") == 1)).count()
    assert right >= 0.97 * test.join(table, "doc_id").count()
    edge = quality.score(docs, labels.withColumn("quality", F.when(F.col("doc_id") % 3 > 0, F.col("quality"))))
    assert edge.count() == docs.count() and edge.where("quality IS NULL OR NOT quality BETWEEN 0 AND 1").count() == 0
    assert quality.score(docs, labels.limit(0)).where("evidence <> 0.5").count() == 0
    assert quality.score(none, labels).count() == 0
    assert quality.good(table, labels).columns == table.columns


def _quality(spark, rows, labels, most, site=lambda r: (r.source, r.lang)):
    """(evidence, host posterior, path posterior, quality) of each row, by plain sums."""
    odds, bias, weights = quality.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), most)
    evidence = [1 / (1 + np.exp(-np.clip(bias + np.dot(weights, quality.features(r.text, odds)), -12, 12))) for r in rows]
    mean = float(np.mean(evidence))

    def strength(groups):  # of (n, sum, mean of the level above)
        n, s, m = np.array(groups, float).T
        if len(n) < 2:
            return quality.MOST_STRENGTH
        spread = (n * m * (1 - m)).sum() / n.sum()
        share = ((n * (s / n - m) ** 2).sum() - (len(n) - 1) * spread) / ((n.sum() - (n * n).sum() / n.sum()) * spread)
        return float(np.clip(1 / share - 1, quality.LEAST_STRENGTH, quality.MOST_STRENGTH)) if share > 0 else quality.MOST_STRENGTH

    def sums(key):
        out = defaultdict(lambda: [0, 0.0])
        for r, e in zip(rows, evidence):
            out[key(r)][0] += 1
            out[key(r)][1] += e
        return out

    hosts, paths = sums(lambda r: site(r)[0]), sums(site)
    k_host = strength([(n, s, mean) for n, s in hosts.values()])
    host = {h: (k_host * mean + s) / (k_host + n) for h, (n, s) in hosts.items()}
    k_path = strength([(n, s, host[h]) for (h, _), (n, s) in paths.items()])
    logit = lambda p: np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    out = []
    for r, e in zip(rows, evidence):
        n, s = paths[site(r)]
        prior = min(max((k_path * host[site(r)[0]] + s - e) / (k_path + n - 1), 0), 1)
        out.append((e, host[site(r)[0]], prior, 1 / (1 + np.exp(-(logit(e) + logit(prior) - logit(mean))))))
    return out


def test_quality_against_brute_force(spark, docs):
    rows = docs.collect()
    labels = [(k, int(k % 3 == 0), 0) for k in range(30)]
    want = Counter((r.doc_id, *(round(float(x), 6) for x in q)) for r, q in zip(rows, _quality(spark, rows, labels, 25)))
    got = quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), fit_rows=25).collect()
    assert Counter((r.doc_id, *(round(x, 6) for x in (r.evidence, r.host_posterior, r.path_posterior, r.quality))) for r in got) == want
    assert len({r.host_posterior for r in got}) == 3 and len({r.quality for r in got}) > 20


def test_odds_of_slots():
    words, grams = quality.slots("The the cat")
    assert len(words) == 2 and 6 <= len(grams) <= 8
    counts = np.zeros((2, quality.SLOTS, 2))
    counts[0, 5], counts[1, 7] = (0, 9), (9, 1)
    odds = quality.log_odds(counts, 10, 10)
    assert odds[0, 5] > 2 and odds[1, 7] < -1 and odds[0, 0] == 0


def test_sites_of_urls(spark):
    rows = [(1, "https://Ex.org/a/b?c"), (2, "http://ex.org/a/"), (3, "http://ex.org/x"), (4, None), (5, "no url")]
    df = spark.createDataFrame(rows, "doc_id long, url string")
    host, path = quality.site(df, None, None)
    assert [tuple(r) for r in df.orderBy("doc_id").select(host, path).collect()] == [("ex.org", "a"), ("ex.org", "a"), ("ex.org", None), (None, None), (None, None)]


def test_sparse_sites_shrink(spark):
    groups = spark.createDataFrame([("a", 90.0, 100, 0.5), ("b", 10.0, 100, 0.5)], "host string, s double, n long, mean double")
    even = spark.createDataFrame([("a", 50.0, 100, 0.5), ("b", 50.0, 100, 0.5)], "host string, s double, n long, mean double")
    assert quality._strength(groups, "mean") < 10 and quality._strength(even, "mean") == quality.MOST_STRENGTH


def test_lowest_hashes(spark):
    rows = [(float(k % 2), [float(k)], (k % 5 - 2) * 2**60 + k) for k in range(200)] + [(1.0, [0.0], 2**62)] * 200
    df = spark.createDataFrame(rows, "y double, f array<double>, h long").repartition(7)
    for most in (1, 10, 150, 500):
        assert [r.h for r in quality._lowest(df, most)] == sorted(h for _, _, h in rows)[:most]
    assert quality._lowest(df.limit(0), 10) == []


# near-duplicates


def _shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset([tuple(words)] if 0 < len(words) < 5 else zip(*(words[k:] for k in range(5))))


def _roots(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if (low[a], low[b]) != (m, m):
                low[a] = low[b] = m
                changed = True
    return low


def _brute(rows, percent):
    sets = [(i, _shingles(t)) for i, t in rows]
    links = [(i, j) for a, (i, s) in enumerate(sets) for j, t in sets[a + 1 :] if s and t and i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t)]
    low = _roots({i for i, _ in rows if i is not None}, links)
    return sorted(((i, len(s), low.get(i), i is None or i == low[i]) for i, s in sets), key=str)


def test_minhash(spark, docs, rows, none):
    assert _sorted(minhash.near_duplicates(docs)) == _brute([r[:2] for r in rows], 85)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.one_of_each(docs, 80)
    assert kept.columns == docs.columns


def test_minhash_loose_group(spark, monkeypatch):
    """Many near copies, most of which aren't linked to the smallest one."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    own = []
    for k in range(70):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        own.append((k, " ".join(words)))
    own.append((None, " ".join(base)))
    df = spark.createDataFrame(own, "doc_id long, text string")
    assert _sorted(minhash.near_duplicates(df)) == _brute(own, 85)


def test_minhash_ids_with_several_texts(spark):
    rng = random.Random(13)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    own = []
    for k in range(8):
        a, b, c = text(), text(), text()
        own += [(k, a), (k, b), (100 + 3 * k, a + " end"), (101 + 3 * k, b + " end"), (101 + 3 * k, c), (102 + 3 * k, c + " end")]
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(4)
    assert _sorted(minhash.near_duplicates(df)) == _brute(own, 85)


def test_one_row_of_each_group_is_left(spark):
    """A repeated row, copies without ids and an id with two texts, after near-dedup and removal of repeats."""
    rng = random.Random(12)
    text = lambda k: " ".join(f"w{k}x{rng.randrange(10**6)}" for _ in range(60))
    twice, nameless, first, other, mixed, plain = map(text, range(6))
    near = first + " end"
    own = [(7, twice, "a"), (7, twice, "b"), (7, twice, "a"), (None, nameless, "a"), (None, nameless, "a"), (None, nameless + " end", "a"), (1, first, "a"), (5, near, "a"), (5, other, "a"), (None, mixed, "a"), (9, mixed, "a"), (8, plain, "a"), (None, None, "a"), (10, "", "a"), (10, "", "a")]
    df = spark.createDataFrame(own, "doc_id long, text string, kind string").repartition(3)
    kept = common.durable(minhash.one_of_each(df, 80), "kept")
    assert kept.columns == df.columns
    after = Counter((r.doc_id, r.text) for r in substrings.cleaned(kept, 240).collect())
    nameless_kept = [t for i, t in after if i is None and t]
    assert len(nameless_kept) == 1 and nameless_kept[0] in (nameless, nameless + " end")
    want = Counter([(7, twice), (None, nameless_kept[0]), (1, first), (5, other), (9, mixed), (8, plain), (None, None), (10, ""), (10, "")])
    assert after == want


def test_blocks_find_every_component():
    rng = random.Random(9)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(40)], np.int64)) for _ in range(60)]
    links = [(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))]
    assert _roots(range(60), minhash.block_links([(0, i, i, s) for i, s in enumerate(sets)], 60)) == _roots(range(60), links)


def test_components(spark):
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, k) for k in range(501, 540)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = _roots({x for e in links for x in e}, links)
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in links)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _removed(rows, size):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + size] for _, t in texts for k in range(len(t) - size + 1))
    out = []
    for i, t in texts:
        mark = bytearray(len(t))
        for k in range(len(t) - size + 1):
            if seen[t[k : k + size]] > 1:
                mark[k : k + size] = b"\1" * size
        kept = bytes(c for c, m in zip(t, mark) if not m)
        out.append((i, len(t), sum(mark), sum(1 for x in bytes(mark).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [400, 120])
def test_substrings(docs, rows, none, size):
    got = substrings.remove_repeats(docs, size)
    assert _sorted(got.drop("text")) == _removed([r[:2] for r in rows], size)
    for r in got.collect():
        assert r.n_removed and not r.text.isascii() or hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256
    if size == 400:
        assert substrings.remove_repeats(none, size).count() == 0
        clean = substrings.cleaned(docs, size)
        assert clean.columns == docs.columns and clean.where("text IS NULL").count() == 1


def test_substrings_of_a_single_periodic_text(spark):
    rows = [(1, "x" * 3000), (2, "short")]
    assert _sorted(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("text")) == _removed(rows, 400)


@pytest.mark.parametrize("size", [400, 120])
def test_substrings_of_repetitive_texts(spark, size):
    """Powers of a few words, Thue-Morse texts, long runs, and texts that differ by single letters."""
    rng, rows = random.Random(6), []
    turn = lambda t: t.translate(str.maketrans("ab", "ba"))
    morse = "a"
    for _ in range(11):
        morse += turn(morse)
    base = "".join(rng.choice("ACGT") for _ in range(1500))
    texts = [morse, turn(morse), "a" * 700, "ab" * 500, base, base * 2, base[:399] + "x" + base[400:], "é" * 450, (base[:130] + " ") * 9]
    for _ in range(12):
        own = list(base)
        for _ in range(rng.randint(1, 6)):
            own[rng.randrange(len(own))] = rng.choice("ACGT")
        texts.append("".join(own))
    rows = [(k, t) for k, t in enumerate(texts)]
    assert _sorted(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), size).drop("text")) == _removed(rows, size)


def test_substrings_where_a_text_ends_with_a_phrase(spark):
    """Of a text that ends where a phrase does, another goes on: the last window of both is one, in unlike groups."""
    rng, rows = random.Random(8), []
    for _ in range(60):
        base = "".join(rng.choice("ACGT ") for _ in range(900))
        ends = substrings.phrase_ends(base.encode(), 400)
        stop = int(ends[ends >= 500][0]) if (ends >= 500).any() else 900
        rows += [(len(rows), base[:stop]), (len(rows) + 1, base[:stop] + "".join(rng.choice("acgt ") for _ in range(300)))]
    assert _sorted(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("text")) == _removed(rows, 400)


@pytest.mark.parametrize("few", [50_000, 0])
def test_pipeline_removes_passages_of_short_words(spark, monkeypatch, few):
    import corpus_pipeline

    monkeypatch.setattr(common, "BROADCAST_ROWS", few)
    monkeypatch.setattr(substrings, "HELD", 3)

    rng = random.Random(14)
    passage = " ".join(f"{rng.choice('abcde')}{rng.choice('xyz')}" for _ in range(51))
    under = " ".join(f"{rng.choice('fgh')}{rng.choice('xyz')}" for _ in range(50))
    own = lambda k, n=30: " ".join(f"w{k}x{rng.randrange(10**6)}" for _ in range(n))
    fill = [own(k) for k in range(6)]
    twice = " ".join(f"{rng.choice('mno')}{rng.choice('xyz')}" for _ in range(55))
    rows = [(1, f"{fill[0]} {passage} {fill[1]}"), (2, f"{fill[2]}\n{passage}"), (3, f"{fill[3]} {under} {fill[4]}"), (4, under), (5, passage), (6, twice), (7, twice), (None, fill[5])]
    got = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert len(passage) < 240 and got == {1: f"{fill[0]}  {fill[1]}", 2: f"{fill[2]}\n", 3: rows[2][1], 4: under, None: fill[5]}


# vectors


def _vectors(n=400, d=24):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(n, d))
    for k in range(0, 60):
        v[k] = v[k % 4] + 0.02 * rng.normal(size=d) * (k % 3 + 1)
    rows = [(k, v[k].astype(np.float32).tolist(), k % 2 if k % 11 else None) for k in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * d, 1), (n + 2, [float("nan")] * d, 1), (n + 3, [1.0] * (d - 1) + [None], 0), (n + 4, [1.0, 2.0], 0), (n + 5, [], 1), (n + 6, [float("inf")] * d, 0)]
    return rows + [rows[2], rows[2], (n + 20, rows[3][1], rows[3][2])]


def test_embedding_duplicates(spark, monkeypatch):
    monkeypatch.setattr(crosspolytope, "BLOCK", 7)
    rows = _vectors()
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, label int, c string, keys int")
    unit = []
    for _, v, label in rows:
        x = np.array(v if v and None not in v else [0], np.float32).astype(float)
        unit.append(x / np.linalg.norm(x) if label is not None and np.isfinite(x).all() and x.any() else None)
    count, links = Counter(), []
    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                count[a] += 1
                count[b] += 1
                links.append((rows[a][0], rows[b][0]))
    low = _roots({r[0] for r in rows}, links)
    assert _sorted(crosspolytope.near_duplicates(df)) == sorted(((r[0], count[k], low[r[0]], r[0] == low[r[0]]) for k, r in enumerate(rows)), key=str)
    assert len(links) > 200 and crosspolytope.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [1, 2, 3])
def test_embedding_duplicates_of_few_components(spark, width):
    turn = np.arange(60) * 2 * np.pi / 60
    v = np.stack([np.cos(turn), np.sin(turn), np.full(60, 0.3)], 1)[:, :width]
    rows = [(k, v[k].tolist(), k % 2 if width == 1 else 0) for k in range(60)] + [(100 + k, v[k].tolist(), 200 + k) for k in range(60)]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:60]])
    close = (unit @ unit.T >= 0.98) & (label[:, None] == label) & ~np.eye(60, dtype=bool)
    got = {r.vec_id: r.n_links for r in crosspolytope.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[k] for k in range(60)] == close.sum(1).tolist()
    assert not any(got[100 + k] for k in range(60))


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "BLOCK", 64)
    monkeypatch.setattr(nndescent, "ITERATIONS", 2)
    rows = _vectors(1500, 16)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, label int, p string, s int")
    good = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if v and None not in v and len(v) == 16 and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    got = defaultdict(list)
    for r in nndescent.nearest(df).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in good if i % 20 == 0}
    hits = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in [i for _, i, _ in own]
        s = x @ good[q]
        assert all(abs(score - good[i] @ good[q]) < 1e-12 for _, i, score in own) and own == sorted(own, key=lambda r: (-r[2], r[1]))
        s[ids == q] = -np.inf
        hits += len({i for _, i, _ in own} & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(got)
    few = nndescent.nearest(df.where("vec_id < 5")).collect()
    assert [(r.query_id, r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 2), (0, 3), (0, 4)]
    assert nndescent.nearest(df.limit(0)).count() == 0


def _recall(spark, x, ids):
    got = defaultdict(list)
    for r in nndescent.nearest(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")).collect():
        got[r.query_id].append((r["rank"], r.vec_id))
    x, ids = x.astype(np.float32).astype(float), np.array(ids)
    s = x @ x[ids % 20 == 0].T
    hits = 0
    for k, q in enumerate(ids[ids % 20 == 0].tolist()):
        own = np.where(ids == q, -np.inf, np.round(s[:, k], 9))
        assert sorted(r for r, _ in got[q]) == list(range(1, 21)), q
        hits += len({i for _, i in got[q]} & set(ids[np.lexsort((ids, -own))[:20]].tolist()))
    return hits / (20 * len(got))


def test_nearest_of_thousands_of_copies(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    x[rng.permutation(3000)[:2000]] = x[0]
    assert _recall(spark, x, range(3000)) >= 0.97


def test_nearest_in_large_blocks_and_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "BLOCK", 32)
    monkeypatch.setattr(nndescent, "LARGE", 2)
    monkeypatch.setattr(nndescent, "PART", 64)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(30, 12))[rng.integers(0, 30, 1500)] + 0.3 * rng.normal(size=(1500, 12))
    v[:700] = v[0] + 0.01 * rng.normal(size=(700, 12))  # blocks that are far larger than others
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(None, v[0].tolist()), (20, v[21].tolist())], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in nndescent.nearest(df).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 1500, 20):
        own = min(v[20].tolist(), v[21].tolist()) if q == 20 else v[q]
        s = v @ np.asarray(own)
        s[20] = np.asarray(min(v[20].tolist(), v[21].tolist())) @ np.asarray(own)
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert hits >= 0.9 * 20 * 75 and None not in got


def test_nearest_with_a_large_vector(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    x[7, 3] = 4000.0
    assert _recall(spark, x, range(1500)) >= 0.95


# the rest


def _marked(texts, size, words):
    """Texts without the strings of ``size`` bytes, or of ``words`` words, that start twice."""
    raws = [(t or "").encode() for t in texts]
    places = [[(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\r\v\f]+", r)] for r in raws]
    strings = [[(k, k + size) for k in range(len(r) - size + 1)] + [(p[k][0], p[k + words - 1][1]) for k in range(len(p) - words + 1) if p[k + words - 1][1] - p[k][0] < size] for r, p in zip(raws, places)]
    seen = Counter(r[a:b] for r, own in zip(raws, strings) for a, b in own)
    out = []
    for r, own in zip(raws, strings):
        mark = bytearray(len(r))
        for a, b in own:
            if seen[r[a:b]] > 1:
                mark[a:b] = b"\1" * (b - a)
        out.append((bytes(c for c, m in zip(r, mark) if not m).decode("utf-8", "ignore"), any(mark)))
    return out


def test_each_pipeline_stage_against_brute_force(spark, rows, tmp_path):
    import corpus_pipeline

    table = [*rows, (None, "text of no id " * 9, "en", "s0", 1, "k", 1, "x", "y"), (90, "!! 12 ##", "en", "s0", 1, "k", 1, "x", "y")]
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, k % 2, 0) for k in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = common.table(spark, str(tmp_path), "documents")
    library = Tokenizer.from_file(WORD)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = common.durable(stage(spark, docs, str(tmp_path)), "stage")
        after = docs.collect()
        if stage is not corpus_pipeline.pack:
            assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", "), name
        if stage is corpus_pipeline.language:
            samples = langid.sample(spark.createDataFrame([r for r in before if zlib.crc32(str(r.doc_id).encode()) % 4 != 2], SCHEMA))
            model = langid.fit(samples)
            bits = [min(_bits(model, samples, r.text or "")) for r in before]
            assert Counter(after) == Counter(r for r, n in zip(before, bits) if any(c.isalpha() for c in r.text or "") and n <= langid.MOST_BITS)
            assert len(after) < len(before)
        elif stage is corpus_pipeline.good:
            want = _quality(spark, before, labels, 20_000)
            assert Counter(after) == Counter(r for r, (*_, q) in zip(before, want) if q >= quality.THRESHOLD)
        elif stage is corpus_pipeline.near_duplicates:
            sets = [_shingles(r.text) for r in before]
            links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            low = _roots(range(len(sets)), links)
            groups = defaultdict(list)
            for k, r in enumerate(before):
                groups[low[k]].append(r)
            left = Counter(after)
            assert len(after) == len(groups) and not left - Counter(before)
            for own in groups.values():
                ids = [r.doc_id for r in own if r.doc_id is not None]
                assert sum(left[r] > 0 and r.doc_id == (min(ids) if ids else None) for r in set(own)) == 1
        elif stage is corpus_pipeline.repeats:
            cut = _marked([r.text for r in before], corpus_pipeline.REPEAT_BYTES, corpus_pipeline.REPEAT_WORDS)
            want = Counter((r.doc_id, t if hit else r.text, len(t) if hit else r.n_chars) for r, (t, hit) in zip(before, cut) if t or not hit)
            assert Counter((r.doc_id, r.text, r.n_chars) for r in after) == want and any(hit for _, hit in cut)
        else:
            want = Counter()
            for r in before:
                ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
                for k, at in enumerate(range(0, len(ids), 2048)):
                    want[r.doc_id, k, at, zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())] += 1
            assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in after) == want
            full = Counter()
            for r in after:
                full[r.sequence_id] += r.length
            assert max(full.values()) <= 2048
    assert after


def test_pipeline_of_nothing_and_of_clashing_names(spark, tmp_path):
    import corpus_pipeline

    for place, own in (("none", []), ("some", [(k, f"some text number {k} of a table with other names, {k * 7}", "en", "s", 9, "k", 1, "r") for k in range(8)])):
        folder = f"{tmp_path}/{place}"
        spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars int, k string, c0 int, rest string").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(0, 1, 0), (1, 0, 0)][: len(own)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder)
        assert got.columns[:3] == ["doc_id", "piece", "start"] and (got.count() > 0) == bool(own)


def test_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.queries()}) == list(range(1, 11))
