"""Mixing, licences, languages, token files and piece encoding."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from odd_tables import ROWS, rows_of
from pyspark.sql import functions as F
from skillgrid.llm import language, license_scan, mixing, piece_encoding, token_files
from skillgrid.llm.queries import tokenizer_file
from skillgrid.session import scratch_path


# --- mixing

def test_targets_are_reshared_below_the_cap(spark):
    sizes = {"a": 10, "b": 1000, "c": 1000, "d": 5, None: 100}
    rows = spark.createDataFrame([(k, s, f"={k}" if k else "") for k, s in sizes.items()],
                                 "_source string, _size bigint, _k string")
    got = {r["_k"]: r["target"] for r in mixing.source_targets(rows, mixing.MixSettings()).collect()}
    weights = {"=a": 5, "=b": 2, "=c": 1, "=d": 5, "": 2}
    total, fixed = 2115.0, {}
    while True:  # cap, reshare, again until none is above
        rest = total - sum(fixed.values())
        open_w = sum(w for k, w in weights.items() if k not in fixed)
        plan = {k: rest * w / open_w for k, w in weights.items() if k not in fixed}
        most = {f"={k}" if k else "": 3.0 * s for k, s in sizes.items()}
        above = {k: most[k] for k, t in plan.items() if t > most[k]}
        if not above:
            break
        fixed |= above
    assert got == pytest.approx(fixed | plan)


def test_mix_comes_near_its_targets(sample_docs):
    got = mixing.mix(sample_docs, mixing.MixSettings(piece=16, reserve=8)).collect()
    assert len(got) == sample_docs.count()
    assert all(r.taken == r.copies * r["size"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r)
    for (_, target), rows in by.items():
        assert abs(sum(r.taken for r in rows) - target) <= max(r["size"] for r in rows)
    again = mixing.mix(sample_docs.repartition(7), mixing.MixSettings(piece=16, reserve=8))
    assert sorted((r.doc_id, r.taken) for r in again.collect()) == sorted((r.doc_id, r.taken) for r in got)


def test_flight_keeps_totals_and_chances():
    rng = np.random.default_rng(3)
    sizes, chances = rng.integers(1, 50, 300).tolist(), [0.3] * 300
    p, left = mixing.fly(list(range(300)), sizes, chances, 1)
    assert len(left) <= 2 and sum(p) == pytest.approx(90)
    assert sum(s * x for s, x in zip(sizes, p)) == pytest.approx(0.3 * sum(sizes))
    assert all(x in (0.0, 1.0) for i, x in enumerate(p) if i not in left)
    mean = np.mean([mixing.fly(list(range(60)), sizes[:60], chances[:60], seed)[0] for seed in range(300)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.13


def _one_source(sizes, seed, **settings):
    chance = 0.64
    frame = pd.DataFrame({"_id": range(len(sizes)), "_k": "=a", "_size": sizes, "source_size": sum(sizes), "target": 0.0,
                          "_whole": 0, "_p": chance, "_most": len(sizes), "_pieces": 1, "_piece": 0})
    done = mixing._flight(mixing.MixSettings(seed=seed, **settings))(frame)
    assert done["_p"].isin([0.0, 1.0]).all()
    taken = dict(zip(done["_id"], done["_p"]))
    return taken, sum(s * taken[i] for i, s in enumerate(sizes)) - chance * sum(sizes)


@pytest.mark.parametrize("others", ["mixed", "equal", "two sizes"])
def test_a_very_long_document_is_drawn_and_made_good(others):
    rng = np.random.default_rng(5)
    small = {"mixed": (np.exp(rng.normal(4.5, 1.2, 900)).astype(int) + 1).tolist(), "equal": [100] * 900,
             "two sizes": [101, 100] * 450}[others]
    drawn = []
    for seed in range(60):
        taken, off = _one_source([20_020, *small], seed)
        assert abs(off) <= 100
        drawn.append(taken[0])
    assert 0.45 < np.mean(drawn) < 0.83  # 0.64, three standard errors


def test_two_very_long_documents(spark):
    texts = ["w " * 20_000, "v " * 19_000] + [f"a{i} " * (1 + i * 37 % 400) for i in range(800)]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    by = {}
    for r in mixing.mix(docs).collect():
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert len(by) == 2 and all(abs(sum(taken) - target) <= max(100, target / 1000) for (_, target), taken in by.items())


def test_mix_on_odd_tables(odd_docs, no_docs, clashing_docs):
    got = mixing.mix(odd_docs)
    assert got.count() == len(ROWS)
    assert got.where("doc_id IN (3, 4, 5) AND taken <> 0").count() == 0
    assert mixing.mix(no_docs).count() == 0
    rows = mixing.mixed_rows(clashing_docs)
    assert rows.columns == clashing_docs.columns
    assert rows_of(mixing.mix(clashing_docs)) == rows_of(got)


# --- licences

def brute_places(words):
    return [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(words))
            if words[i:i + len(phrase.split())] == phrase.encode().split()]


def test_license_base_equals_brute_force(spark, sample_docs):
    made = ["gnu general public license gnu general public license", "the MIT license, cc by, CC-BY 4", "cc cc by by",
            "apache apache license license", "general public license", "", None, "Ünï mit license ÿ"]
    docs = sample_docs.select("doc_id", "text").unionByName(
        spark.createDataFrame([(10 ** 6 + i, t) for i, t in enumerate(made)], "doc_id bigint, text string"))
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    for doc_id, text in docs.collect():
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
        places, r = brute_places(words), got[doc_id]
        starts = [p for p, _ in places]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_matching_statistics_equal_brute_force():
    rng = np.random.default_rng(5)
    notices = [(" ".join(rng.choice(list("abc"), 12)), f"t{i}") for i in range(4)]
    scan = license_scan.LicenseAutomaton((), notices, license_scan.ScanSettings(min_match=3))
    runs = {tuple(t.encode().split()[i:j]) for t, _ in notices for i in range(12) for j in range(i + 1, 13)}
    for _ in range(20):
        words = [w.encode() for w in rng.choice(list("abcd"), 60)]
        longest = [max((n for n in range(13) if n <= i + 1 and tuple(words[i + 1 - n:i + 1]) in runs), default=0)
                   for i in range(60)]
        want = {(i, n) for i, n in enumerate(longest) if n >= 3 and (i == 59 or longest[i + 1] <= n)}
        assert {(end, n) for end, n, _, _ in scan.scan(words)[1]} == want


def test_license_spans(spark):
    text = ("intro words Permission is hereby granted, free of charge, to any person obtaining a copy of the software and "
            "associated documentation files (the Software), to deal in the Software without restriction. outro")
    docs = spark.createDataFrame([(1, text), (2, "permission is hereby denied to any person"),
                                  (3, "Redistribution and use in source and binary forms, with or without modification, "
                                      "are permitted provided that the following conditions are met")],
                                 "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert got[1].labels == "mit" and got[1].spans[0].first_word == 2 and got[1].score > 0.8
    assert got[2].labels == "" and got[2].spans == [] and got[2].score == 0
    assert (got[3].labels, got[3].base_labels, got[3].score) == ("bsd", "", 1.0)


def test_license_templates_do_not_hide_each_other():
    rng = np.random.default_rng(6)
    for _ in range(30):
        long = list(rng.choice(list("abcd"), 14))
        notices = [(" ".join(t), f"t{i}") for i, t in enumerate(
            (long, long[:5], long[3:9], long[3:6], long[-4:], list(rng.choice(list("abcd"), 10))))]
        known = license_scan.LicenseAutomaton((), notices)
        words = [w.encode() for w in [*rng.choice(list("abcde"), 20), *long, *rng.choice(list("abcd"), 20), *long[2:11]]]
        got = known.scan(words, per_template=True)[1]
        spans = []
        for i, (notice, label) in enumerate(notices):
            template = notice.encode().split()
            runs = [max(n for n in range(min(len(template), at + 1) + 1) if n == 0 or any(
                template[j:j + n] == words[at + 1 - n:at + 1] for j in range(len(template)))) for at in range(len(words))]
            want = [(at, n, j + n - 1) for at, n in enumerate(runs) if n >= 3 and [*runs, 0][at + 1] <= n
                    for j in range(len(template) - n + 1) if template[j:j + n] == words[at + 1 - n:at + 1]]
            assert [(at, n, place) for at, n, t, place in got if t == i] == want
            spans += license_scan.LicenseAutomaton((), [(notice, label)]).spans([(a, n, 0, p) for a, n, p in want])
        assert known.spans(got) == sorted(spans, key=lambda s: (s[1], s[2], s[0]))


def test_license_notice_inside_a_longer_one(spark):
    header = dict((label, text) for text, label in license_scan.NOTICES)["apache"]
    docs = spark.createDataFrame([(1, header), (2, "Licensed under the Apache License, Version 2.0.")],
                                 "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert got[1].labels == got[2].labels == "apache,apache-2.0"
    assert {(s.label, s.first_word, s.coverage) for s in got[1].spans} == {("apache", 0, 1.0), ("apache-2.0", 0, 1.0)}


def test_license_on_odd_tables(odd_docs, no_docs, clashing_docs):
    assert license_scan.scan_licenses(no_docs).count() == 0
    assert license_scan.scan_licenses(clashing_docs).count() == license_scan.scan_licenses(odd_docs).count() == len(ROWS)


# --- languages

def brute_profile(texts, size):
    counts = Counter()
    for t in texts:
        letters = "".join(c if c.isalpha() else " " for c in t.lower())
        for w in letters.split():
            padded = f" {w} "
            counts.update(w)
        joined = " " + " ".join(letters.split()) + " "
        counts.update(a + b for a, b in zip(joined, joined[1:]))
        counts.update(a + b + c for a, b, c in zip(joined, joined[1:], joined[2:]) if b != " ")
    key = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return [key(g) for g, _ in sorted(counts.items(), key=lambda e: (-e[1], key(e[0])))[:size]]


def test_profiles_and_distance_equal_brute_force(sample_docs):
    profiles = language.train_profiles(sample_docs)
    texts = {}
    for r in sample_docs.collect():
        texts.setdefault(r.lang, []).append(r.text)
    want = {lang: brute_profile(t, language.PROFILE_SIZE) for lang, t in texts.items()}
    got = {}
    for r in profiles.orderBy("rank").collect():
        got.setdefault(r.lang, []).append(r.gram)
    assert got == want
    known = language.ProfileSet(got, language.PROFILE_SIZE)
    for r in sample_docs.limit(30).collect():
        own = brute_profile([r.text], language.PROFILE_SIZE)
        apart = {lang: sum(abs(i - p.index(g)) if g in p else language.PROFILE_SIZE for i, g in enumerate(own))
                 for lang, p in want.items()}
        best = min(sorted(apart), key=apart.get)
        found, score = known.nearest(r.text)
        assert found == best and score == pytest.approx(1 - apart[best] / (language.PROFILE_SIZE * len(own)))


def test_language_held_out_accuracy(spark, sample_docs):
    got = language.identify(sample_docs).join(sample_docs, "doc_id")
    assert got.where("held_out AND lang_pred = lang").count() >= 0.95 * got.where("held_out").count() > 0
    for r in got.select("doc_id", "held_out").collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_language_on_odd_tables(odd_docs, no_docs, clashing_docs):
    got = {(r.doc_id): r for r in language.identify(odd_docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5, 6))
    assert got[9].lang_pred == "fr" and 0 < got[9].score <= 1
    assert language.identify(no_docs).count() == 0
    kept = language.with_known_language(clashing_docs)
    assert kept.columns == clashing_docs.columns and kept.count() == len(ROWS) - 4
    unlabelled = odd_docs.withColumn("lang", odd_docs["source"].substr(9, 1).cast("string"))
    assert language.identify(unlabelled.where("lang IS NULL")).where("lang_pred <> 'und'").count() == 0


def test_known_language_without_labels(spark, odd_docs):
    docs = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.with_known_language(docs).count() == len(ROWS) - 4
    assert language.with_known_language(odd_docs.withColumn("lang", F.lit("und"))).count() == len(ROWS) - 4
    assert language.identify(docs).where("lang_pred <> 'und' OR score <> 0").count() == 0


# --- token files

def test_wavelet_matrix_answers_like_the_plain_list():
    rng = np.random.default_rng(2)
    for n, bits in ((0, 4), (1, 16), (9000, 16), (5000, 20)):
        ids = rng.integers(0, min(1 << bits, 500), n).astype("<u4")
        m = token_files.WaveletMatrix.build(ids, bits)
        assert (m.decode() == ids).all()
        for i in rng.integers(0, n, 20) if n else []:
            assert m[int(i)] == ids[i]
            assert m.count(int(ids[i]), int(i)) == (ids[:i] == ids[i]).sum()
            assert (m.places(int(ids[i])) == np.flatnonzero(ids == ids[i])).all()
        assert m.count(499 if bits > 8 else 15) == (ids == (499 if bits > 8 else 15)).sum()


def plain_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_special_tokens_in_other_letters_are_plain_text():
    from tokenizers import Tokenizer

    path = str(tokenizer_file("word_bpe_49k.json"))
    tokenizer, encode = Tokenizer.from_file(path), token_files.word_encoder(path, 2)
    texts = ["Some <|ENDOFTEXT|> Text", "<|EndOfText|>", "a<|endoftext|>B, C.", "É <|StartOfText|> ÜB", "Plain Text."]
    for text, raw in zip(texts, encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def test_units_with_marks_share_what_is_learned(monkeypatch):
    import tokenizers

    path, real, asked = str(tokenizer_file("word_bpe_49k.json")), tokenizers.Tokenizer, []

    class Counting:
        def __init__(self, inner):
            self.__dict__["inner"] = inner

        @classmethod
        def from_file(cls, name):
            return cls(real.from_file(name))

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def __setattr__(self, name, value):
            setattr(self.inner, name, value)

        def encode_batch_fast(self, texts, **kwargs):
            asked.extend(texts)
            return self.inner.encode_batch_fast(texts, **kwargs)

    words, marks = ["alpha", "Über", "straße", "ÿz", "ends"], ["", ".", ",", "%%%", "!!", "'", "_", "<|", "\\`", "$^~|"]
    texts = [" ".join(w + m for w in words) for m in marks]
    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    got = list(token_files.word_encoder.__wrapped__(path, 2)(texts))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == plain_ids(texts)
    # Once per distinct word and mark, not per pair of them.
    assert sum(len(t.split()) for t in asked) <= len(words) + len(marks)


def test_encoding_in_small_chunks_with_small_memos(monkeypatch):
    path = str(tokenizer_file("word_bpe_49k.json"))
    texts = [None, "", " ", "a\x0bb\x0cc\r\nd\x1ce\x85f\u3000g", "x" * 300, "Kelvin \u212a, \u212bngström's", "e\u0301t\u00e9. e \u0301",
             "a<|endoftext|>B <|endoftext|>. <|EndOfText|>,", "ab-cd, 12.5% don't 'tis DON'T!", "\u0130stanbul \u1e9e \u00b5m \u00aa",
             *(f"{chr(c)}a{chr(c)} a{chr(c)}" for c in range(0x250))]
    monkeypatch.setattr(token_files, "_CHUNK", 40)
    monkeypatch.setattr(token_files, "_MEMO", 400)
    got = list(token_files.word_encoder.__wrapped__(path, 2)(texts))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == plain_ids(texts)


def test_token_files_equal_the_library(spark, sample_docs):
    odd = ["don't STOP e.g. a@b.co ... 12,5", "naïve Äpfel ß, œuvre.", " wide space x́", "日本 text!!?.", "ª² ½",
           None, "", "WORD word. word, word.,"]
    docs = sample_docs.select("doc_id", "text").unionByName(
        spark.createDataFrame([(10 ** 6 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string"))
    path = scratch_path(spark, "token_files")
    token_files.write_token_files(docs, path, tokenizer_file("word_bpe_49k.json"), 2, 16, shards=3, block_tokens=5000)
    blocks = token_files.read_token_files(spark, path)
    listed = docs.orderBy("doc_id").collect()
    ids = plain_ids([r.text for r in listed])
    starts = np.cumsum([0] + [len(i) for i in ids])
    want = [(r.doc_id, int(s), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i, s in zip(listed, ids, starts)]
    assert sorted(map(tuple, token_files.decoded_documents(blocks).collect())) == want
    flat = np.concatenate([np.array(i) for i in ids])
    assert token_files.token_counts(blocks, 2).agg({"n": "sum"}).first()[0] == (flat == 2).sum()
    rare = int(flat[17])
    assert sorted(r.place for r in token_files.token_places(blocks, rare).collect()) == np.flatnonzero(flat == rare).tolist()


def test_token_files_of_odd_tables(spark, no_docs, clashing_docs):
    for docs, n in ((no_docs, 0), (clashing_docs, len(ROWS))):
        path = scratch_path(spark, "token_files")
        token_files.write_token_files(docs, path, tokenizer_file("word_bpe_49k.json"), 2, 16, shards=2)
        assert token_files.decoded_documents(token_files.read_token_files(spark, path)).count() == n


# --- pieces

@pytest.fixture(scope="module")
def model():
    return piece_encoding.PieceModel.from_file(tokenizer_file("piece_bpe_32k.model"))


@pytest.mark.parametrize("share", [1e-9, 0.5])  # all units through the lattice, and none
def test_piece_encoding_equals_the_library(spark, model, share, sample_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    odd = ["  a  b\n c", "\ttab", " x", "ﬁ é", "", None, "  ", "a\n\nb", "😀 ok\x00z", "a ", "<s>x</s>", "a" * 300,
           "aaaa" * 20 + "\r\n\r\nbb  cc", "日本語テキスト mixed", "x\x0b\x0cy"]
    docs = sample_docs.limit(20).select("doc_id", "text").unionByName(
        spark.createDataFrame([(10 ** 6 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string"))
    coded = piece_encoding.encode_documents(docs, model, share=share)
    back = {r.doc_id: r for r in piece_encoding.decode_documents(coded, model).collect()}
    for doc_id, text in docs.collect():
        assert back[doc_id].ids == library.encode(text or "")
        assert back[doc_id].text == (text or "")


def test_text_encoder_equals_the_library_on_odd_spacing(model):
    """Spaces, line breaks, controls and marks in every order; short and long merges agree."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    encode, rng = piece_encoding.text_encoder({}, model), random.Random(3)
    texts = ["", " ", "\n", "\nabc", "a\n\nb", "a \nb", "a\n b", "a  b", "\t", "a" * 500 + " b", "\u2581a b"]
    texts += ["".join(rng.choices("ab \n\t\x0b.,1é\u2581日", k=rng.randint(0, 40))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(encode(text), np.int32).tolist() == library.encode(text)
        assert model._looped(text) == model._queued(text)


def test_viterbi_fold_equals_brute_force(spark):
    scores = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -4.0, "aba": -4.2, "bb": -6.0}
    pieces = spark.createDataFrame([(p, s, i) for i, (p, s) in enumerate(scores.items())], "piece string, score double, id int")
    ids = {p: i for i, p in enumerate(scores)}
    words = ["a", "ab", "aba", "abab", "babab", "bbaabb", "abxab"]

    def best(w):
        if not w:
            return 0.0, []
        options = [(s + best(w[len(p):])[0], [ids[p], *best(w[len(p):])[1]]) for p, s in scores.items() if w.startswith(p)]
        options.append((-1e6 + best(w[1:])[0], [1000 + ord(w[0]), *best(w[1:])[1]]))
        return max(options, key=lambda o: o[0])

    table = spark.createDataFrame([(w,) for w in words], "word string")
    edges = piece_encoding.lattice(table, pieces, 3)
    got = {r.word: r.ids for r in piece_encoding.fold_viterbi(edges, tuple(range(1000, 1256))).collect()}
    value = lambda w, found: sum(list(scores.values())[i] if i < 1000 else -1e6 for i in found)
    assert all(value(w, got[w]) == pytest.approx(best(w)[0]) for w in words)


def test_piece_encoding_of_odd_tables(no_docs, clashing_docs, model):
    assert piece_encoding.encode_documents(no_docs, model).count() == 0
    coded = piece_encoding.encode_documents(clashing_docs, model, keep=("n_chars",))
    assert coded.columns == ["doc_id", "ids", "n_chars"] and coded.count() == len(ROWS)


def test_units_are_counted_as_the_pattern_cuts_them(spark, sample_docs):
    model = piece_encoding.PieceModel.from_file(tokenizer_file("piece_bpe_32k.model"))
    odd = ["a  b", " a", "a\nb", "a \nb\n\n c\n", "\n", " ", "", None, "a\tb c", "x▁y ▁", "a b", "a\n b  ", "\n\na"]
    texts = odd + [r["text"] for r in sample_docs.select("text").collect()]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    want = Counter(u for t in texts if t for u in re.findall(model.unit_pattern, piece_encoding.prepared(t)))
    rows = piece_encoding.unit_counts(docs, model, "text").collect()
    assert len(rows) == len(want) and {r["word"]: r["n"] for r in rows} == want


def test_round_trip_is_encoding_then_decoding(sample_docs, no_docs):
    model = piece_encoding.PieceModel.from_file(tokenizer_file("piece_bpe_32k.model"))
    for docs in (sample_docs, no_docs):
        apart = piece_encoding.decode_documents(piece_encoding.encode_documents(docs, model, keep=("source",)), model, ("source",))
        both = piece_encoding.round_trip_documents(docs, model, keep=("source",))
        assert both.columns == apart.columns == ["doc_id", "ids", "text", "source"]
        assert rows_of(both) == rows_of(apart)
