"""Codecs, counts, scans, decontamination and models against libraries and plain versions."""

import hashlib
import itertools
import random
import re
import shutil
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.llm import language_id, quality, token_store
from tidelake.llm.decontaminate import ItemIndex, contaminated
from tidelake.llm.license_scan import license_scan
from tidelake.llm.piece_codec import PieceCodec
from tidelake.llm.piece_ops import decoded, encoded, round_trip
from tidelake.llm.token_counts import length_histogram, quantile, token_lengths, truncated_total
from tidelake.llm.tokenizers_io import WordEncoder

tokenizers = pytest.importorskip("public_tokenizers")
WORDS, PIECES = tokenizers.path("word_bpe_49k.json"), tokenizers.path("piece_bpe_32k.model")
ALPHABET = [*"  \t\n  abcthe▁éñüß日本語😀\x00́ １AB.,!'", "<|endoftext|>", "<s>", "<unk>", "the ", "ing", "   ", "\r\n", "ﬁ", "Σ", "\x1c", "\x85", "12", "'s", "it's"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_pieces_are_the_librarys():
    import sentencepiece

    sp, c = sentencepiece.SentencePieceProcessor(model_file=PIECES), PieceCodec(PIECES, cache=500)
    for text in [*random_texts(1500), "a" * 3000, " " * 999 + "x", "the " * 2000]:
        ids = array("I", c.encode(text)).tolist()
        assert ids == sp.encode(text), text
        assert c.decode([1, *ids, 2]) == sp.decode([1, *ids, 2])


def test_new_words_are_encoded_together(docs, monkeypatch):
    import sentencepiece

    sp, c = sentencepiece.SentencePieceProcessor(model_file=PIECES), PieceCodec(PIECES, cache=3000)
    texts = [*random_texts(1500, 2), "a" * 3000, " " * 999 + "x", "x" * 64 + " " + "x" * 65, "", "\n", *(r.text or "" for r in docs.limit(100).collect())]
    alone, word_bytes = [], PieceCodec.word_bytes
    monkeypatch.setattr(PieceCodec, "word_bytes", lambda self, word: alone.append(word) or word_bytes(self, word))
    monkeypatch.setattr("tidelake.llm.piece_codec.TEXTS_AT_ONCE", 20_000)
    monkeypatch.setattr("tidelake.llm.piece_codec.AT_ONCE", 5000)
    for text, x in zip(texts, c.encode_all(texts), strict=True):
        assert array("I", x).tolist() == sp.encode(text), text
    # those encoded one by one are long or hold several space marks together
    assert alone and all(len(word) > 64 or "▁▁" in word for word in alone)


def test_round_trip_encodes_few_words_one_by_one(docs, monkeypatch):
    c = PieceCodec(PIECES)
    monkeypatch.setattr("tidelake.llm.piece_ops.codec", lambda path: c)
    monkeypatch.setattr("tidelake.llm.piece_ops.map_texts", lambda docs, i, t, rows, schema: _Mapped(docs, rows))
    alone, word_ids = [], PieceCodec.word_ids
    monkeypatch.setattr(PieceCodec, "word_ids", lambda self, word: alone.append(word) or word_ids(self, word))
    round_trip(docs.limit(100), PIECES)
    assert len(c.words) > 5000 and len(alone) < len(c.words) // 50


class _Mapped:
    """What round_trip's function makes of all rows, in this process."""

    def __init__(self, docs, rows):
        found = docs.collect()
        self.out = rows()([r.doc_id for r in found], [(r.text or "").encode() for r in found])

    def withColumnRenamed(self, *_):  # noqa: N802
        return self.out


def test_words_are_the_librarys():
    e = WordEncoder(WORDS, cache=300)
    for text in random_texts(1500, 2):
        assert array("I", e.ids(text.encode())).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_words_of_several_texts_are_learned_together(monkeypatch):
    e, calls, learn = WordEncoder(WORDS, cache=400), [], WordEncoder._learn
    monkeypatch.setattr(WordEncoder, "_learn", lambda self, words: calls.append(len(words)) or learn(self, words))
    texts = [*random_texts(1500, 3), "", " ", "The the THE the, Straße, naïve..", "word " * 500]
    for text, x in zip(texts, e.all_ids([t.encode() for t in texts]), strict=True):
        assert array("I", x).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert len(calls) == 1
    monkeypatch.setattr("tidelake.llm.tokenizers_io.TEXTS_AT_ONCE", 2000)
    f = WordEncoder(WORDS, cache=400)
    again = f.all_ids([t.encode() for t in texts])
    assert len(calls) > 2 and again == [f.ids(t.encode()) for t in texts]


def test_words_in_capitals_are_learned_once(monkeypatch):
    e, learned, learn = WordEncoder(WORDS), [], WordEncoder._learn
    monkeypatch.setattr(WordEncoder, "_learn", lambda self, words: learned.extend(words) or learn(self, words))
    assert e.ids(b"The THE the tHe") == 4 * e.ids(b"the") and learned == [b"the"]
    # what is no special token in capitals, and letters that have an accented form in lower case only
    odd = ["<|ENDOFTEXT|>", "x<|EndOfText|> A", "<|endoftext|>B", "W\u030a w\u030a", "T\u0308 H\u0331 I\u0307 \u0130", " \x0b\x0cA\x1cB\x85C \n", "ΑΣ AΣ", "\u212aK"]
    for text, x in zip(odd, e.all_ids([t.encode() for t in odd]), strict=True):
        assert array("I", x).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_crc_joins_with_few_maps():
    rng, join = random.Random(4), token_store.CrcJoin()
    for _ in range(40):
        parts = [rng.randbytes(4 * rng.randint(17, 8192)) for _ in range(rng.randint(1, 12))] + [b"\0" * 512]
        assert join.joined([(zlib.crc32(x), len(x)) for x in parts]) == zlib.crc32(b"".join(parts))
    assert len(join.shifts) < 200


def test_round_trip(odd_docs, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = round_trip(odd_docs, PIECES).collect()
    assert len(got) == odd_docs.count() and round_trip(no_docs, PIECES).collect() == []
    texts = {r.doc_id: r.text or "" for r in odd_docs.select("doc_id", "text").collect()}
    for r in got:
        ids = [1, *sp.encode(texts[r.doc_id]), 2]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded == texts[r.doc_id]
    back = decoded(encoded(odd_docs, PIECES), PIECES).collect()
    assert {r.doc_id: r.text for r in back} == texts


def test_histogram_answers_every_limit(odd_docs, docs, no_docs):
    for frame in (odd_docs, docs):
        lengths = token_lengths(frame, WORDS)
        values = sorted(r.n_tokens for r in lengths.collect())
        h = length_histogram(lengths).cache()
        rows = h.orderBy("n_tokens").collect()
        assert sum(r.n_docs for r in rows) == len(values)
        for r in rows:
            assert r.truncated_total == sum(min(v, r.n_tokens) for v in values)
            assert r.docs_longer == sum(v > r.n_tokens for v in values) and r.tokens_longer == sum(v for v in values if v > r.n_tokens)
        assert truncated_total(h, 100) == sum(min(v, 100) for v in values)
        assert quantile(h, 0.5) == values[(len(values) + 1) // 2 - 1]
    assert length_histogram(token_lengths(no_docs, WORDS)).collect() == []


def test_token_store(spark, odd_docs, docs, no_docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    for k, frame in enumerate((docs, odd_docs, no_docs)):
        folder = f"{tmp_path}/store{k}"
        token_store.write_store(frame, folder, WORDS, end_id=2)
        rows = sorted(((r.doc_id, r.text or "") for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        got = token_store.verified(spark, folder).orderBy("start").collect()
        ids = {r.start: list(r.ids) for r in token_store.read_ids(spark, folder).collect()}
        at = 0
        assert len(got) == len(rows)
        for r, (i, text) in zip(got, rows, strict=True):
            want = [*t.encode(text, add_special_tokens=False).ids, 2]
            assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(want)) and ids[at] == want
            assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
            at += len(want)
        chunks = spark.read.parquet(f"{folder}/chunks")
        assert chunks.count() == chunks.select("digest").distinct().count()
        tops = {r.kind: r.n_ids for r in spark.read.parquet(f"{folder}/manifest").where("part = -1").collect()}
        assert tops.get("recipes", 0) == at


def test_token_store_misses_what_was_lost_or_changed(spark, docs, tmp_path):
    folder = f"{tmp_path}/store"
    token_store.write_store(docs.limit(40), folder, WORDS, end_id=2)
    first = spark.read.parquet(f"{folder}/recipes").orderBy("start").first()
    name = bytes(first.chunks[0]).hex()
    later = "CASE WHEN start = 0 THEN {} ELSE {} END"
    damages = {
        "recipes": [
            lambda t: t.where("start > 0"),
            lambda t: t.withColumn("doc_id", F.expr(later.format("doc_id + 100000", "doc_id"))),
            lambda t: t.withColumn("start", F.expr(later.format("-1", "start"))),
        ],
        "chunks": [lambda t: t.where(f"lower(hex(digest)) <> '{name}'")],
        "manifest": [lambda t: t.where("part >= 0"), lambda t: t.withColumn("n_ids", F.expr("n_ids + 1"))],
    }
    for table, changes in damages.items():
        for k, change in enumerate(changes):
            broken = f"{tmp_path}/{table}{k}"
            shutil.copytree(folder, broken)
            shutil.rmtree(f"{broken}/{table}")
            change(spark.read.parquet(f"{folder}/{table}")).write.parquet(f"{broken}/{table}")
            for read in (token_store.verified, token_store.read_ids):
                with pytest.raises(Exception, match="match|missing"):
                    read(spark, broken).collect()
    # a recipe without its chunks raises by itself too
    shutil.rmtree(f"{tmp_path}/chunks0/manifest")
    token_store._manifest(spark, f"{tmp_path}/chunks0").write.parquet(f"{tmp_path}/chunks0/manifest")
    for read in (token_store.verified, token_store.read_ids):
        with pytest.raises(Exception, match="missing"):
            read(spark, f"{tmp_path}/chunks0").collect()
    assert token_store.verified(spark, folder).count() == 40


def test_crc_joins():
    rng, join = random.Random(4), token_store.CrcJoin()
    for _ in range(50):
        parts = [rng.randbytes(rng.randint(0, 300)) for _ in range(rng.randint(0, 6))]
        assert join.joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 49000, 60_000).astype("<u4")
    b = np.concatenate([rng.integers(0, 49000, 777).astype("<u4"), a])
    names = lambda x: {x[s:e].tobytes() for s, e in zip([0, *token_store.cuts(x)], token_store.cuts(x), strict=False)}
    assert len(names(a) & names(b)) > 0.7 * len(names(a)) and token_store.cuts(a)[-1] == len(a)


def plain_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [
        (k, label)
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
        for k in range(len(words))
        if words[k : k + len(phrase.split())] == phrase.split()
    ]
    places = [k for k, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_license_scan(spark, odd_docs, docs, no_docs):
    cases = [
        (1, "Released under the MIT License. Apache-License; a mit, LICENSE"),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "mitlicense mit xlicense ünïmit license"),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, "redistribution of forms in source, permitted"),
        (6, None),
    ]
    for frame in (spark.createDataFrame(cases, "doc_id long, text string"), odd_docs, docs):
        texts = {r.doc_id: r.text for r in frame.collect()}
        for r in license_scan(frame).collect():
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licenses(texts[r.doc_id])
            assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    got = {r.doc_id: r.labels for r in license_scan(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert got[2] == "gpl,gpl-3.0" and got[4] == "cc-by-nc-4.0" and got[5] == "" and "mit-notice" in got[1]
    assert license_scan(no_docs).collect() == []


def test_decontamination_finds_all_windows(spark, docs, sf, no_docs, odd_docs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    index = ItemIndex([(r.item_id, r.text.encode()) for r in bench.collect()], 0.8)
    want = set()
    for r in docs.select("doc_id", "text").collect():
        words = index_words(r.text)
        known = {s for x in index.shingles for s in x}
        near = [k for k, s in enumerate(index._shingles(words)) if s in known]
        for n, (item, own) in enumerate(index.items):
            starts = {s for k in near for s in range(k - len(own), k + 1)}
            if any(index.similar(words, s, n) >= 0.8 for s in starts):
                want.add((r.doc_id, item))
    assert want and got == want
    assert contaminated(no_docs, bench).collect() == [] and contaminated(docs, bench.limit(0)).collect() == []
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "The quick brown fox jumps over the lazy dog!")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(odd_docs, odd).collect()} == {(1, 3), (2, 3)}


def index_words(text):
    from tidelake.llm.common import WORDS_ONLY

    return (text or "").encode().translate(WORDS_ONLY).split()


def test_decontamination_survives_an_edit_at_the_rim():
    item = " ".join("item%d" % i for i in range(40))
    edited = item.replace("item1 ", "changed ")
    index = ItemIndex([(1, item.encode())], 0.8)
    texts = [("junk " * 50 + edited + " more" * 50).encode(), ("junk " * 500).encode(), b""]
    assert [sorted(x) for x in index.search(texts)] == [[0], [], []]


def test_quality(spark, odd_docs, no_docs, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = labels.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2) & (F.col("quality") == 1))
    model = quality.fit(docs, train, docs)
    assert 0.5 < model.prior < 0.99
    held = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    rows = quality.scored(docs, model).join(held, "doc_id").collect()
    right = sum((r.score >= 0.7) == (r.quality == 1) for r in rows)
    assert right / len(rows) > 0.93
    odd = quality.scored(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.scored(no_docs, model).collect() == []
    unfitted = quality.fit(no_docs, no_docs, no_docs)
    assert {r.score for r in quality.scored(odd_docs, unfitted).collect()} == {0.5}


def test_language(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language_id.fit(docs.where(~held), max_docs=80, per_label=700)
    rows = language_id.predicted(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.95
    odd = language_id.predicted(odd_docs, model).collect()
    assert len(odd) == odd_docs.count()
    assert {r.lang_pred for r in odd if r.doc_id in (3, 4, 5, 9)} == {"und"} and all(0 <= r.score <= 1 for r in odd)
    assert language_id.predicted(no_docs, model).collect() == []
    assert language_id.fit(no_docs).labels == ["und"]


def test_gru_gradient():
    rng = np.random.default_rng(0)
    g = language_id.Gru(3, rng)
    data, weight = rng.integers(0, 5, (6, 4)).astype(np.uint8), rng.normal(size=(6, 4, 3)).astype(np.float32)
    loss = lambda: float((g.forward(data)[0] * weight).sum())
    _, tape = g.forward(data, True)
    grads = g.backward(data, tape, weight)
    for name in g.p:
        at = (1, 1)
        kept, step = g.p[name][at], 1e-2
        g.p[name][at] = kept + step
        up = loss()
        g.p[name][at] = kept - step
        down = loss()
        g.p[name][at] = kept
        assert abs((up - down) / (2 * step) - grads[name][at]) < 0.05


def edits_of(words, places):
    """The words with every kind of edit at the places: another word, a word more, a word less."""
    for kinds in itertools.product("cid", repeat=len(places)):
        out = list(words)
        for at, kind in sorted(zip(places, kinds, strict=True), reverse=True):
            out[at : at + (kind != "i")] = [] if kind == "d" else [b"new%d" % at]
        yield out


def test_decontamination_finds_every_edit_that_stays_similar():
    for n in [1, 4, 5, *range(13, 46, 3), 16, 22, 37, 90]:
        words = [b"w%dx" % i for i in range(n)]
        index = ItemIndex([(1, b" ".join(words))], 0.8)
        texts = []
        spots = [(a,) for a in range(n)] + [(a, b) for a in range(n) for b in range(a + 1, n) if (a * 7 + b) % 29 == 0 or (a < 3 and b > n - 4)]
        for places in spots:
            texts += [[b"junk"] * 9 + x + [b"more"] * 9 for x in edits_of(words, places)]
        if n > 40:  # words in a row that move the rest by more than a few places
            texts += [[b"junk"] * 9 + words[:at] + [b"in"] * k + words[at:] for at in range(n) for k in (3, 5, 7)]
        want = [any(index.similar(x, s, 0) >= 0.8 for s in range(60)) for x in texts]
        got = [0 in x for x in index.search([b" ".join(x) for x in texts])]
        assert got == want, n
        assert any(want) or n < 13


def test_decontamination_weighs_shingles_over_the_whole_benchmark(spark, monkeypatch):
    prompt = "answer the following question in a few words of your own choice please "
    tails = [" ".join("tail%dof%d" % (k, i) for k in range(14)) for i in range(30)]
    bench = spark.createDataFrame([(i, prompt + t) for i, t in enumerate(tails)], "item_id long, text string").coalesce(1)
    texts = [(i, prompt + t.rsplit(" ", k)[0] + " other" * k) for i, t in enumerate(tails) for k in (1, 2, 3)]
    texts += [(i, "give one " + prompt[7:] + t) for i, t in enumerate(tails)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    whole = sorted(contaminated(frame, bench).collect())
    monkeypatch.setattr("tidelake.llm.decontaminate.BLOCK", 4)
    assert whole and sorted(contaminated(frame, bench).collect()) == whole


def test_letters():
    assert not any(language_id.has_letter(x.encode()) for x in ("", "12 ½ ² ①", "_ 。", "\U0001f600"))
    assert all(language_id.has_letter(x.encode()) for x in ("a", "1é", "日", "_ß"))


def test_every_key_phrase_finds_its_template():
    from tidelake.llm.license_scan import TEMPLATES, RareIndex, vocabulary

    for counts in ({}, {w: len(w) * 7 for w in vocabulary()}, {w: 100 - len(w) for w in vocabulary()}):
        index = RareIndex(1000, counts)
        for label, _, phrases in TEMPLATES:
            for p in phrases:
                assert label in index.scan(b"some words before".split() + p.encode().split() + b"and after".split())[0], (label, p)
