"""Every operator against brute force, a round trip or held-out rows, and on awkward tables."""

import base64
import hashlib
import random
import io
import math
import time
import wave

import numpy as np
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import bpe, chroma, decontam, htmlmain, langid, licenses, nearcopies, queries, simhash, suffix, superkmer, toxicity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key string, k1 string, fp string, hits string"
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS * 30)
PASSAGE = " ".join(WORDS[:60])


def table(spark, texts, ids=None):
    rows = [(i, t, "en" if t else None, None, None, "clash", "clash", "clash", "clash", "clash") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = ["", None, "a", "a", "   \n ", PASSAGE, f"x {PASSAGE} y", "é" * 500, LONG, LONG, "12 34 !!"]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_language_id_held_out_and_odd_texts(spark):
    found = queries.op1_language_id(spark, DATA)
    rows = found.join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    model = langid.train(table(spark, ["the cat and the dog", "le chat et le chien"]).withColumn("lang", F.when(F.col("doc_id") == 0, "en").otherwise("fr")))
    out = by_id(langid.identify(table(spark, ODD), model), "lang_pred", "score")
    assert len(out) == len(ODD) and [out[i][0] for i in (0, 1, 4, 10)] == ["und"] * 4 and out[2] == out[3] and out[8] == out[9]
    assert langid.train(table(spark, [])) is None and langid.identify(table(spark, []), None).count() == 0
    assert by_id(langid.identify(table(spark, ["abc"]), None), "lang_pred")[0] == ("und",)


def test_codewords_are_apart():
    for n in (1, 2, 5, 9, 20):
        code = langid.codewords(n)
        assert len(np.unique(code, axis=0)) == n


def test_suffix_dedup(spark):
    texts = [*ODD, None, "z" * 450]
    out = by_id(suffix.remove_repeats(table(spark, texts)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert out == dict(enumerate(suffix.brute_force(texts)))
    small = ["abcabcabcx", "xabcab", "ab", None, "cabcabc"]
    assert by_id(suffix.remove_repeats(table(spark, small), length=4), "n_bytes", "n_removed", "n_spans", "kept_sha256") == dict(enumerate(suffix.brute_force(small, 4)))
    assert suffix.remove_repeats(table(spark, [])).count() == 0
    assert suffix.remove_repeats(table(spark, ["a", "a"], [None, 5])).count() == 2


def test_superkmer_dedup(spark):
    out = by_id(superkmer.remove_repeats(table(spark, ODD)), "n_words", "n_removed", "kept_sha256")
    assert out == dict(enumerate(superkmer.brute_force(ODD)))
    small = ["a b c d a b c", "x a b c", "b c d e", None, "a a a a a a a a"]
    assert by_id(superkmer.remove_repeats(table(spark, small), k=3, m=2), "n_words", "n_removed", "kept_sha256") == dict(enumerate(superkmer.brute_force(small, 3)))
    assert superkmer.remove_repeats(table(spark, [])).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Merges(bpe.load_ranks(queries.rank_path())))


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.rank_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n'st é1", max_size=80)))
@settings(max_examples=200, deadline=None)
def test_bpe_is_as_tiktoken(encoder, reference, text):
    assert encoder.encode(text).tolist() == reference.encode_ordinary(text)


def test_bpe_of_long_pieces_is_as_tiktoken(encoder, reference):
    draw = random.Random(5)
    texts = ["".join(draw.choices(letters, k=n)) for letters in ("ab", "the", "éaö", "=-", "日本語", " \n", "012", "a'st ") for n in (63, 64, 65, 128, 700, 5_000)]
    assert [ids.tolist() for ids in encoder.encode_all(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_bpe_documents_round_trip(spark, encoder, reference):
    out = by_id(bpe.encode_documents(table(spark, [*ODD, "a" * 3_000]), queries.rank_path(), with_ids=True), "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "ids", "decoded")
    for i, t in enumerate([*ODD, "a" * 3_000]):
        ids = reference.encode_ordinary(t or "")
        assert out[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True, ids, t or "")
    assert bpe.encode_documents(table(spark, []), queries.rank_path()).count() == 0


@given(st.binary(max_size=40), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_utf8_machine_ignores_where_chunks_end(data, n):
    machine = bpe.Utf8Stream()
    assert "".join([machine.feed(data[i : i + n]) for i in range(0, len(data), n)] + [machine.feed(b"", last=True)]) == data.decode("utf-8", "replace")


def test_html_text(spark):
    page = (
        "<html><head><title>T</title><style>x{}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class='ad'>Buy now</div><header>Site</header><article><h1>A &amp; B</h1>"
        "<p>Some  text\nwith <b>bold</b> words.<p>Second<script>no()</script> part</p><form>Name</form><aside>Side</aside></article><div id='comments'><p>I disagree entirely</p></div><footer>&copy; us</footer></body></html>"
    )
    rows = spark.createDataFrame([(1, "u", page, "c"), (2, None, None, "c"), (3, "u", "", "c"), (4, "u", "<p>broken <b", "c")], "page_id bigint, url string, html string, text string")
    out = {r["page_id"]: (r["text"], r["n_chars"]) for r in htmlmain.extract(rows).collect()}
    want = "A & B\n\nSome text with bold words.\n\nSecond part"
    assert out[1] == (want, len(want)) and out[2] == out[3] == ("", 0) and len(out) == 4
    assert htmlmain.extract(rows.limit(0)).count() == 0


def wav(samples, rate=8_000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(samples.astype("<i2").tobytes())
    return out.getvalue()


def test_chroma_aligns_recordings(spark):
    rng = np.random.default_rng(1)
    tune = np.concatenate([3_000 * np.sin(2 * np.pi * 220 * 2 ** (n / 12) * np.arange(2_000) / 8_000) for n in rng.integers(0, 12, 60)])
    other = np.concatenate([3_000 * np.sin(2 * np.pi * 220 * 2 ** (n / 12) * np.arange(2_000) / 8_000) for n in rng.integers(0, 12, 60)])
    hop = 4096 // 3 if round(np.log2(8_000 * 0.37)) == 12 else 2048 // 3
    late = np.concatenate([np.zeros(hop * 10), tune])
    data = [(50, wav(tune)), (1, wav(late + rng.normal(0, 30, len(late)))), (2, wav(other)), (3, wav(tune)), (4, None), (5, b""), (6, b"junk"), (100, wav(np.zeros(50_000)))]
    rows = spark.createDataFrame(data, "doc_id bigint, audio binary")
    out = chroma.align(chroma.fingerprints(rows, "doc_id", "audio"), F.col("id") % 50 == 0).collect()
    assert {r["id"] for r in out} == {i for i, _ in data}
    assert {r["id"]: r["class_id"] for r in out if r["id"] in (3, 50)} == {3: 3, 50: 3}
    assert {(r["id"], r["match_class"], r["offset"]) for r in out if r["match_class"] is not None} == {(3, 1, -10)}
    assert chroma.align(chroma.fingerprints(rows.limit(0), "doc_id", "audio"), F.lit(True)).count() == 0


def test_chroma_recall_against_every_offset(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 64))
    vectors = np.concatenate([base, base[:20] + rng.normal(0, 0.05, (20, 64))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, v array<double>")
    got = {(r["id"], r["match_class"]) for r in chroma.align(chroma.fingerprints(rows, "id", "v", chroma.melody), F.lit(True)).collect() if r["match_class"] is not None}
    prints = [chroma.fingerprint(*chroma.melody(v.tolist())) for v in vectors]
    want = {(a, b) for a in range(60) for b in range(60) if a != b and any(n >= 56 and e <= 0.15 for n, e in (chroma.bit_error(prints[a], prints[b], o) for o in range(-56, 57)))}
    assert want and len(want & got) >= 0.9 * len(want) and got <= want


def test_chroma_pairs_tried_stay_in_their_task(spark):
    """Recordings of one scale share many keys, so nearly all pairs are tried; what is shuffled follows the recordings all the same."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=64) + rng.normal(0, 1.0, (300, 64))
    prints = chroma.fingerprints(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, v array<double>"), "id", "v", chroma.melody)
    size = prints.agg(F.sum(F.length("packed"))).first()[0]

    def written():
        time.sleep(1)
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = written()
    assert chroma.align(prints, F.lit(True)).count() >= 300
    assert written() - before < 4 * size


def test_chroma_blocks_of_queries_and_votes(spark, monkeypatch):
    """Blocks of any size, also ones without a query, find what one block finds; so do few votes at a time."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 64))
    vectors = np.concatenate([base, base + rng.normal(0, 0.05, (20, 64))])
    rows = spark.createDataFrame([*enumerate(v.tolist() for v in vectors), (None, vectors[0].tolist()), (99, None)], "id bigint, v array<double>")
    prints = chroma.fingerprints(rows, "id", "v", chroma.melody)
    whole = sorted(chroma.align(prints, F.col("id") % 4 == 0).collect(), key=str)
    assert len(whole) >= len(vectors) + 2 and sum(r["match_class"] is not None for r in whole) >= 10
    monkeypatch.setattr(chroma, "BLOCK_BYTES", 1_000)
    assert sorted(chroma.align(prints, F.col("id") % 4 == 0).collect(), key=str) == whole
    packed = [chroma.fingerprint(*chroma.melody(v.tolist())) for v in vectors] + [np.zeros(n, np.uint32) for n in (0, 1, 9, 300)]
    names = [str(i) for i in range(len(packed))]
    block = chroma.Block(names, packed)
    found = [x.tolist() for x in block.align(names, packed, 0.4, 0.5, 8)]
    monkeypatch.setattr(chroma, "AT_ONCE", 50)
    assert [x.tolist() for x in block.align(names, packed, 0.4, 0.5, 8)] == found
    assert len(found[0]) > 40 and all((n, e) == chroma.bit_error(packed[q], packed[r], o) and e <= 0.4 and q != r for r, q, o, n, e in zip(*found, strict=True))


def test_decontamination(spark):
    item = " ".join(f"q{i}" for i in range(40))
    changed = " ".join("zzz" if i in (7, 19, 31) else f"q{i}" for i in range(40))
    docs = table(spark, [*ODD, f"before {item} after", f"lead {changed}", " ".join(f"q{i}" for i in range(12)), f"before {item} after"])
    bench = spark.createDataFrame([(1, item, "c"), (2, None, "c"), (3, "too short", "c"), (1, item, "c")], "item_id bigint, text string, id string")
    n = len(ODD)
    found = {(r["doc_id"], r["item_id"], r["n_matched"]) for r in decontam.contaminated(docs, bench).collect()}
    assert found == {(n, 1, 40), (n + 1, 1, 37), (n + 3, 1, 40)}
    assert sorted(r["doc_id"] for r in decontam.clean(docs, bench).select("doc_id").collect()) == [*range(n), n + 2]
    assert decontam.contaminated(table(spark, []), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def brute_alignments(text, item, stretch=20, agree=0.8):
    """Matched words and shift of the best alignment that counts, or None."""
    own, words = [regex.findall(r"[\p{L}\p{N}]+", (t or "").lower()) for t in (text, item)]
    n, best = len(words), None
    if n < decontam.LEAST:
        return None
    for shift in range(-n + 1, len(own)):
        same = [0 <= shift + i < len(own) and own[shift + i] == w for i, w in enumerate(words)]
        width = min(stretch, n)
        if (n >= decontam.SPAN or all(same)) and max(sum(same[s : s + width]) for s in range(n - width + 1)) >= math.ceil(width * agree):
            best = max(best or (-1, 0), (sum(same), -shift))
    return best


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_decontamination_of_items_of_any_length(spark, monkeypatch, limit):
    """Against every alignment, with the seeds broadcast and with all joins shuffled."""
    monkeypatch.setattr(decontam, "MAX_BROADCAST_SEEDS", limit)
    draw = random.Random(9)
    items = [" ".join(f"q{n}x{i}" for i in range(n)) for n in (3, 5, 8, 9, 10, 11, 12, 14, 20, 33)]
    texts = [None, ""]
    for item in items:
        for wrong in range(5):
            words = item.split()
            for i in draw.sample(range(len(words)), min(wrong, len(words))):
                words[i] = "other"
            texts.append(" ".join(["lead", *words, "tail"]))
        texts += [item, item[: len(item) // 2]]
    bench = spark.createDataFrame([*enumerate(items), (0, items[0])], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): (r["n_matched"], -r["doc_word"]) for r in decontam.contaminated(table(spark, texts), bench).collect()}
    assert found == {(i, k): best for i, t in enumerate(texts) for k, item in enumerate(items) if (best := brute_alignments(t, item))}


def toxic_model(spark):
    rng = np.random.default_rng(5)
    plain = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    texts, labels = [], []
    for i in range(400):
        ws = rng.choice(plain, 12).tolist()
        if i % 5 == 0:
            ws[3] = "grumble" if i % 2 else f"snarf{'abcdefgh'[i % 8]}x"
        texts.append(" ".join(ws))
        labels.append(int(i % 5 == 0))
    known = table(spark, texts).join(spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, label int"), "doc_id")
    return toxicity.train(known, known)


def test_toxicity(spark):
    tests = ["wordaa grumble wordbc", "wordaa grumb1e worde", "say g r u m b l e now", "grummmble it", "wordaa wordbb", "", None, "wordaa g r ü m p f l wordab"]
    out = by_id(toxicity.score(table(spark, tests), toxic_model(spark)), "score")
    assert [out[i][0] > 0.5 for i in range(7)] == [True] * 4 + [False] * 3 and out[5] == out[6]
    none = toxicity.train(table(spark, []), table(spark, []).withColumn("label", F.lit(1)))
    assert by_id(toxicity.score(table(spark, ODD), none), "score")[0] == (0.5,) and toxicity.score(table(spark, []), none).count() == 0


def test_toxicity_of_a_form_that_no_label_holds(spark):
    out = by_id(toxicity.score(table(spark, ["wordab snarfzzz"]), toxic_model(spark)), "score")
    assert out[0][0] > 0.5


def test_licenses(spark):
    texts = ["prose\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0.", licenses._APACHE.replace("License", "Licence", 1), *ODD, LONG + "\nAll rights reserved."]
    out = {(r["doc_id"], r["license"], r["status"]) for r in licenses.scan(table(spark, texts)).collect()}
    assert out == {(0, "MIT", "exact"), (1, "CC-BY-NC-4.0", "exact"), (2, "Apache-2.0", "variant"), (len(texts) - 1, "Proprietary", "exact")}
    assert licenses.scan(table(spark, [])).count() == 0


def test_licenses_side_by_side_and_at_cuts(spark):
    mit, apache = licenses._MIT, licenses._APACHE
    texts = [
        "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", "either of Apache License, Version 2.0 or MIT license, at your option", "// SPDX-License-Identifier: MPL-2.0",
        f"{licenses._ZLIB}\nDistributed under the Boost Software License, Version 1.0.", "word " * 80 + "Released under the MIT License." + " prose" * 100, "y " * 5_000 + mit + " z" * 5_000,
        f"{mit}\n\n{apache}\n\n{licenses._ISC}", f"{mit} " * 20, f"{mit}\n{mit}",
    ]
    rows = licenses.scan(table(spark, texts)).orderBy("doc_id", "start").collect()
    found = {i: [r["license"] for r in rows if r["doc_id"] == i] for i in range(len(texts))}
    assert found == {0: ["MIT", "Apache-2.0"], 1: ["Apache-2.0", "MIT"], 2: ["MPL-2.0"], 3: ["Zlib", "BSL-1.0"], 4: ["MIT"], 5: ["MIT"], 6: ["MIT", "Apache-2.0", "ISC"], 7: ["MIT"] * 20, 8: ["MIT"] * 2}
    assert {r["status"] for r in rows} == {"exact"} and [texts[5][r["start"] : r["start"] + r["n_chars"]] for r in rows if r["doc_id"] == 5] == [mit[:-1]]


def test_html_names_of_several_parts():
    page = (
        "<body><header class='site-header'>Site</header><article><header class='entry-header'><h1>Title</h1></header><p class='share-price'>The price rose by a tenth in a day.</p>"
        "<section id='search-for-life'><p>They looked for life on the moon.</p></section><div class='cookie_notice'>Accept</div><div class='related-posts'>More</div></article></body>"
    )
    assert htmlmain.main_text(page) == "Title\n\nThe price rose by a tenth in a day.\n\nThey looked for life on the moon."


def fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark):
    rng = np.random.default_rng(3)
    texts = [*ODD, *[" ".join(rng.choice(WORDS, 60)) for _ in range(30)]]
    texts += [t + " tail" for t in texts[-10:]]
    prints = np.array([fingerprint(t) for t in texts], np.uint64)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if int(prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    out = by_id(simhash.near_duplicates(table(spark, texts)), "fp", "component")
    assert {i: int(np.uint64(f % (1 << 64))) for i, (f, _) in out.items()} == dict(enumerate(prints.tolist()))
    assert {i: c for i, (_, c) in out.items()} == dict(enumerate(root))
    assert sorted(r["doc_id"] for r in simhash.one_of_each(table(spark, texts)).collect()) == sorted(set(root))
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    assert simhash.one_of_each(table(spark, ["a", "a", "b"], [None, None, 1])).count() == 2


def five_word_sets(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_dup_stage_finds_copies_of_similarity_080(spark):
    """The stage's links against every pair's exact Jaccard similarity; 3 bits of three-word fingerprints miss most of these."""
    import corpus_pipeline as P

    rng = np.random.default_rng(6)
    texts = [*ODD]
    for i in range(30):
        words = [f"v{n}" for n in rng.integers(0, 5_000, 200)]
        texts.append(" ".join(words))
        for n in (1, 2, 3, 4, 5):  # from about 0.95 to 0.78, and chains of them
            words = list(words)
            for at in rng.choice(200, n, replace=False):
                words[at] = "changed" + str(rng.integers(1 << 30))
            texts.append(" ".join(words))
    sets = [five_word_sets(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if root[i] != root[j] and (not union or len(sets[i] & sets[j]) >= 0.8 * union):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    docs = table(spark, texts)
    got = sorted(r["doc_id"] for r in P.near_duplicates(spark, docs, DATA).collect())
    assert got == sorted(set(root)) and len(got) < len(simhash.one_of_each(docs).collect())


def test_near_dup_stage_deals_large_buckets_in_blocks(spark, monkeypatch):
    """A family of texts of similarity 0.5 to 0.9 that all meet, in one block and in many: the same rows stay, those of the exact groups."""
    rng = np.random.default_rng(9)
    base = [f"v{n}" for n in range(200)]
    texts = []
    for _ in range(60):
        words = list(base)
        for at in rng.choice(200, rng.integers(1, 12), replace=False):
            words[at] = "changed" + str(rng.integers(1 << 30))
        texts.append(" ".join(words))
    sets = [five_word_sets(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert 3 < len(set(root)) < len(root) - 3
    docs = table(spark, texts)
    for tile in (nearcopies.TILE, 4_000):
        monkeypatch.setattr(nearcopies, "TILE", tile)
        assert sorted(r["doc_id"] for r in nearcopies.one_of_each(docs).collect()) == sorted(set(root))


def test_rows_without_an_id_or_of_one_id_stay_apart(spark):
    import corpus_pipeline as P

    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(WORDS, 60)) for _ in range(6)]
    docs = table(spark, [*texts, texts[0], texts[4], texts[1]], [None, None, None, 7, 7, 8, None, 9, 3])
    want = sorted((i, t) for i, t in [(-1, texts[0]), (3, texts[1]), (-1, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[5])])
    for out in (simhash.one_of_each(docs), P.near_duplicates(spark, docs, DATA)):
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in out.collect()) == want
    item = " ".join(f"q{i}" for i in range(40))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = table(spark, [item, texts[0], None, f"x {item}", texts[1]], [None, None, None, 7, 7])
    assert {r["text"] for r in decontam.clean(docs, bench).collect()} == {texts[0], None, texts[1]} and decontam.contaminated(docs, bench).count() == 2


def test_pivots_discard_no_link():
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    near = centre ^ np.uint64(1) ^ np.uint64(1 << 40)
    every = np.concatenate([centre, near])
    a, b = simhash._spanning(every, 3)
    assert {frozenset(x) for x in zip(a.tolist(), b.tolist(), strict=True)} == {frozenset(x) for x in zip(centre.tolist(), near.tolist(), strict=True)}


def test_pipeline_stages_without_labels_and_with_any_names(spark):
    """No language to learn from, columns called like what operators make, repeated rows."""
    import corpus_pipeline as P

    names = ["score", "lang_pred", "runner_up", "ambiguous", "_id", "_kept_id", "_key", "_row", "k2", "kept_text", "n_words", "bucket", "node", "_bad_id", "ids", "best"]
    docs = spark.createDataFrame([(i, t, None, "s", 1, *names) for i, t in enumerate([PASSAGE, PASSAGE, "abc def", None, "12 34", f"y {PASSAGE}"])], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names))
    labelled = docs.withColumn("lang", F.when(F.col("doc_id") == 0, "en"))
    assert sorted(r["doc_id"] for r in P.language(spark, docs, DATA).collect()) == [0, 1, 2, 5]
    assert {r["doc_id"]: r["lang"] for r in P.language(spark, labelled, DATA).collect()} == dict.fromkeys([0, 1, 2, 5], "en")
    for name, stage in P.STAGES[:-1]:
        for rows in (docs, labelled.unionByName(labelled)):
            out = stage(spark, rows, DATA)
            assert out.columns == docs.columns and {r["score"] for r in out.collect()} == {"score"}, name


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    bench = " ".join(f"q{i}" for i in range(40))
    texts = [*ODD, f"before {bench} after all of it", " ".join(WORDS[100:300]), " ".join(WORDS[100:300]) + " end"]
    table(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        if name != "tokens":
            assert empty.columns == docs.columns
    out = {r["doc_id"] for r in P.run(spark, str(tmp_path)).collect()}
    assert out <= set(range(len(texts))) and not out & {0, 1, 4, 10, 3, 9, len(ODD)} and {2, 8, len(ODD) + 1} <= out
