"""Each operator against a plain version of its definition, and the shared
edge cases: nulls, empty and very long texts, repeated rows, empty tables and
extra columns with clashing names."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, rep string, grp int"


def words(rng, n, vocabulary=300):
    return " ".join(f"w{int(k)}x" for k in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    passage, line = words(rng, 60), words(rng, 25)
    out = {k: words(rng, int(rng.integers(3, 120))) for k in range(60)}
    out[60] = out[3]                                            # exact copies
    out[61] = out[3]
    out[62] = out[5] + " tail"
    for k in (63, 64, 65, 66):                                  # a shared passage
        out[k] = f"{words(rng, 9)} {passage} {words(rng, 7)}"
    out[67], out[68], out[69] = line, line + "\n" + line, ""
    out[70] = "For " * 3000                                     # periodic, and long
    out[71] = "a" * 700
    out[72] = "é" * 90 + "ñandú ß " * 20
    out[73] = words(rng, 9000, 40_000)
    out[74], out[75] = None, None
    out[76] = " \t\n "
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en", "s", 1, "x", "y", 3) for k, t in texts.items()]
    rows += [(3, texts[3], "en", "s", 1, "x", "y", 3), (None, texts[5], None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- suffix arrays
def test_suffix_array_and_prefixes_match_sorting():
    from flowsentry.llm.suffix_array import permuted_common_prefixes, suffix_array
    rng = np.random.default_rng(1)
    for k in range(400):
        raw = bytes(rng.integers(97, 97 + int(rng.integers(1, 5)), int(rng.integers(1, 70))).astype(np.uint8))
        raw = raw[:7] * 6 if k % 3 == 0 else raw
        data = np.frombuffer(raw, np.uint8)
        wanted = np.flatnonzero(rng.random(len(raw)) < 0.5) if k % 2 else None
        places = range(len(raw)) if wanted is None else wanted.tolist()
        sa = suffix_array(data, wanted)
        assert sa.tolist() == sorted(places, key=lambda i: raw[i:])
        prefix = permuted_common_prefixes(data, sa)
        for a, b in zip(sa, sa[1:]):
            x, y, n = raw[a:], raw[b:], 0
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
            assert prefix[b] == n


def brute_repeats(rows, length):
    first = {}
    big = 1 << 62
    for i, t in sorted(((big if i is None else i), (t or "").encode()) for i, t in rows):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k:k + length], i)
    out = []
    for i, t in rows:
        raw, own = (t or "").encode(), big if i is None else i
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k:k + length]] < own:
                gone[k:k + length] = b"\1" * length
        spans = sum(1 for k in range(len(raw)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [{}, dict(chunk_bytes=3000, bucket_hashes=200, shard_bytes=5000, split_over=3)])
def test_repeats_match_brute_force(docs, small):
    from flowsentry.llm.suffix_dedup import remove_repeats
    got = remove_repeats(docs, **small)
    assert set(docs.columns) - {"text"} <= set(got.columns)
    rows = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.collect()), key=str)
    assert rows == brute_repeats([(r.doc_id, r.text) for r in docs.collect()], 50)
    assert any(r[2] for r in rows)


def test_slices_without_rivals_stay_out_of_the_suffix_array(monkeypatch):
    """A slice whose anchor no other distinct slice has goes without an array;
    every window's smallest source is still found."""
    import pandas as pd

    from flowsentry.llm import suffix_dedup as S
    rng = np.random.default_rng(17)
    passage, other, length = words(rng, 200, 5000), words(rng, 9), 50
    raw = [f"{words(rng, 40)} {passage} {words(rng, 40)}".encode() for _ in range(6)]
    raw += [raw[2], f"{passage[:333]}{other} {passage[400:]}".encode(), b"ab" * 300]
    data = [np.frombuffer(t, np.uint8) for t in raw]
    of = [S.Slices(d, np.array([len(d)]), length) for d in data]
    frame = pd.DataFrame({"chunk": range(len(raw)), "shard": 0, "windows": [s.windows.astype(np.uint8).tobytes() for s in of],
                          "source": [np.full(len(s.begin), 100 + i, np.int64).tobytes() for i, s in enumerate(of)],
                          "data": [b"".join(t[b:b + w + length - 1] for b, w in zip(s.begin, s.windows)) for t, s in zip(raw, of)]})
    seen, arrays = [], S.smaller_sources
    monkeypatch.setattr(S, "smaller_sources", lambda text, *a: seen.append(len(text)) or arrays(text, *a))
    hits = S._match(length)(frame)["hits"]
    least = {}
    for i, t in enumerate(raw):
        for k in range(len(t) - length + 1):
            least.setdefault(t[k:k + length], i)
    for i, (t, s) in enumerate(zip(raw, of)):
        places = np.concatenate([b + np.arange(w) for b, w in zip(s.begin, s.windows)])
        want = [least[t[k:k + length]] < i for k in places]
        assert np.unpackbits(np.frombuffer(hits[i], np.uint8))[:len(want)].tolist() == want
    distinct = {t[b:b + w + length - 1] for t, s in zip(raw, of) for b, w in zip(s.begin, s.windows)}
    assert 0 < sum(seen) < 0.5 * sum(map(len, distinct))


# ---------------------------------------------------------------- SimHash
def plain_fingerprint(text, shingle=3):
    import xxhash
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    parts = [b" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))


def plain_components(codes: dict, bound=2):
    parent = {i: i for i in codes}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = sorted(codes)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if (codes[a] ^ codes[b]).bit_count() <= bound:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_cuts_keep_replacement_characters_of_the_text(spark):
    from corpus_pipeline import cut_repeats
    rng = np.random.default_rng(12)
    passage = words(rng, 30)
    # é and ã are C3 A9 and C3 A3: the first byte is shared, the second not; so are the last bytes of é and ©
    rows = [(1, f"one é{passage}é first"), (2, f"tw\ufffdo ©{passage}ã second \ufffd"), (3, passage), (4, "all \ufffd"), (5, None)]
    docs = spark.createDataFrame([(k, t, len(t or "")) for k, t in rows], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in cut_repeats(spark, docs, "").collect()}
    assert {k: r.text for k, r in got.items()} == {1: rows[0][1], 2: "tw\ufffdo  second \ufffd", 4: "all \ufffd", 5: None}
    assert all(r.n_chars == len(r.text or "") for r in got.values())


def test_near_duplicates_match_brute_force(docs, texts):
    from flowsentry.llm.simhash import near_duplicates, representatives
    got = near_duplicates(docs).collect()
    codes = {k: plain_fingerprint(t) for k, t in texts.items()}
    for r in got:
        if r.doc_id is not None:
            assert r.fp % (1 << 64) == codes[r.doc_id]
    component = plain_components(codes)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == component
    assert len(got) == docs.count()
    kept = representatives(docs)
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(component.values()))
    assert kept.columns == docs.columns


def test_links_of_dense_and_chained_codes(spark):
    """Codes within a few bits of each other, chains, and distances just over
    the bound, in small groups."""
    from flowsentry.llm.components import connected_components
    from flowsentry.llm.simhash import near_links
    rnd = random.Random(3)
    codes = set()
    for _ in range(6):
        base = rnd.getrandbits(64)
        for _ in range(60):
            codes.add(base ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4))))
    chain = rnd.getrandbits(64)
    for k in range(0, 40, 2):
        chain ^= 3 << k
        codes.add(chain)
    codes |= {rnd.getrandbits(64) for _ in range(200)}
    rows = [(c - (1 << 64) if c >> 63 else c, i) for i, c in enumerate(sorted({c % (1 << 64) for c in codes}))]
    frame = spark.createDataFrame(rows, "fp long, rep long")
    expected = plain_components({i: c % (1 << 64) for c, i in rows})
    for size in (16, 4096):
        found = {r.node: r.component for r in connected_components(near_links(frame, 2, group_size=size)).collect()}
        assert {i: found.get(i, i) for i in expected} == expected


# ---------------------------------------------------------------- packing and token counts
def test_packing_is_exact_and_tight(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    from flowsentry.llm.packing import pack_documents
    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    got = pack_documents(docs, path, capacity=256, shard_items=64).collect()
    expected = []
    for r in docs.collect():
        ids = np.array(model.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for p, s in enumerate(range(0, len(ids), 256)):
            expected.append((r.doc_id, p, s, len(ids[s:s + 256]), zlib.crc32(ids[s:s + 256].tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(expected, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256
    bound = math.ceil(sum(r.length for r in got) / 256)
    assert len(bins) <= 1.05 * bound + 2


def test_tokenizer_on_odd_texts():
    import public_tokenizers

    from flowsentry.llm.packing import WordTokenizer
    model = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["x <|endoftext|> y", "Å ﬁ Σας", "áb", "İstanbul ª² ½x don't we'll", "it's\x85a\xa0b c", "", "''s _x_ 12", "ÀÉ ß ŉ Ǆ",
           "\x1ca b\x00", "<|", "1234.5,6", "日本語 text", "a\tb\rc\n\nd", "İ I ı"]
    assert [i.tolist() for i in model.ids(odd)] == [model.whole.encode(t, add_special_tokens=False).ids for t in odd]


def test_genetic_steps_keep_every_piece_once():
    from flowsentry.llm import packing
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 100, 300)
    population = packing.first_population(lengths, 100, 4, rng)
    for child in (*population, packing.crossover(population[0], population[1], lengths, 100, rng),
                  packing.mutate(population[2], lengths, 100, rng)):
        assert len(child) == 300 and child.min() == 0
        assert np.bincount(child, weights=lengths).max() <= 100
    best = packing.evolve(population, lengths, 100, 10, 4, rng)
    assert packing.fitness(best[0], lengths, 100) >= max(packing.fitness(p, lengths, 100) for p in population)


def test_token_counts_and_cache(spark, docs, texts, tmp_path):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    from flowsentry.llm.token_counts import token_counts
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    cache = str(tmp_path / "cache")
    for _ in range(2):                                          # the second run answers from the cache
        got = token_counts(docs, path, cache, limit=100).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=str) == sorted((
            (r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 100) for r in docs.collect()), key=str)
        distinct = len({t or "" for t in texts.values()})
        assert spark.read.parquet(cache).count() == distinct
    odd = ["a  b", "  a", " a", "a ", "a\nb", "▁x ▁", "", "   ", "x▁ y", "​ 　q"]
    from flowsentry.llm.token_counts import PieceCounter
    assert PieceCounter(path).count(odd) == [len(model.encode(t)) for t in odd]


# ---------------------------------------------------------------- chat formatting
def test_chat_round_trip(spark):
    from flowsentry.llm.chat_format import DEFAULT_TEMPLATE, escape, format_conversations, read_back, unescape
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|end|>\\<|turn|>"), (2, 0, "assistant", "\\"), (2, 1, "user", None),
             (3, 0, "system", ""), (3, 1, "user", "<" * 5 + "|" * 3), (3, 2, "assistant", "é\n"), (None, None, None, None),
             (4, 0, "user", "a"), (4, 0, "user", "a"), (5, 0, "user", "x" * 100_000), (5, 1, "assistant", "<|" * 9999)]
    frame = spark.createDataFrame([t + ("z",) for t in turns], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in read_back(format_conversations(frame)).collect()}
    by = {}
    for c, _, role, text in turns:
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: True, None: False, 4: False, 5: True}
    for t in ("\\", "<|", "\\<|x", "<\\|", "a\\\n"):
        assert unescape(escape(t)) == t and DEFAULT_TEMPLATE.turn_close not in escape(t)
    assert format_conversations(frame.limit(0)).count() == read_back(format_conversations(frame.limit(0))).count() == 0


# ---------------------------------------------------------------- decontamination
def test_decontamination_finds_planted_passages(spark):
    from flowsentry.llm.decontaminate import clean_documents, contaminated_pairs
    rng = np.random.default_rng(8)
    items = {k: words(rng, 30 + k, 5000).split() for k in range(6)}
    items[6] = words(rng, 7, 5000).split()
    benchmark = spark.createDataFrame([(k, " ".join(w), "q") for k, w in items.items()] + [(7, None, "q"), (8, "two words", "q")],
                                      "item_id long, text string, doc_id string")

    def around(w):
        return f"{words(rng, 40, 5000)} {' '.join(w)}, {words(rng, 30, 5000)}"
    changed = list(items[2])
    changed[6] = changed[18] = changed[25] = "other"
    rows = {0: around(items[0]), 1: around(items[1]).upper(), 2: around(changed), 3: around(items[3][5:20]), 4: around(items[6]),
            5: words(rng, 300, 5000), 6: around(items[4][:8]), 7: None, 8: "", 9: " ".join(items[5])}
    docs = spark.createDataFrame([(k, t, "z") for k, t in rows.items()], "doc_id long, text string, item_id string")
    pairs = {(r.doc_id, r.item_id) for r in contaminated_pairs(docs, benchmark).collect()}
    assert pairs == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 6), (9, 5)}
    assert {(r.doc_id, r.item_id) for r in contaminated_pairs(docs, benchmark, block_tokens=40).collect()} == pairs
    clean = clean_documents(docs, benchmark)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [5, 6, 7, 8]
    assert contaminated_pairs(docs, benchmark.limit(0)).count() == 0
    assert clean_documents(docs, benchmark.limit(0)).count() == 10


def test_decontamination_equals_the_rule_for_every_substitution(spark):
    from itertools import combinations

    from flowsentry.llm.decontaminate import contaminated_pairs
    items = {n: [f"i{n}t{k}" for k in range(n)] for n in (*range(4, 14), 16)}
    texts = {}
    for n, item in items.items():
        for subs in range(4):
            for places in combinations(range(min(n, 13)), subs):
                texts[len(texts)] = ["before", "it", *(f"x{k}" if k in places else t for k, t in enumerate(item[:13])), "after"]

    def agrees(doc, item):
        w = min(13, len(item))
        return len(item) >= 5 and any(
            sum(a == b for a, b in zip(doc[i:i + w], item[j:j + w])) >= 0.8 * w - 1e-9
            for i in range(len(doc) - w + 1) for j in range(len(item) - w + 1))
    expected = {(d, n) for d, doc in texts.items() for n, item in items.items() if agrees(doc, item)}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string").repartition(4)
    benchmark = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in contaminated_pairs(docs, benchmark).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


# ---------------------------------------------------------------- learnt scores
def test_toxicity_learns_and_locates(spark):
    from pyspark.sql import functions as F

    from flowsentry.llm.toxicity import clean_documents, learn, offending_sentences, score_documents
    rng = np.random.default_rng(4)
    bad = ["blarg", "snerk", "vorp"]
    rows, labels = [], []
    for k in range(900):
        sentences = [words(rng, 12, 400) for _ in range(int(rng.integers(2, 9)))]
        toxic = k % 6 == 0
        if toxic:
            sentences[0] += f" {bad[k % 3]}, {bad[k // 6 % 3]}"
        rows.append((k, ". ".join(sentences), "en", 9))
        labels.append((k, 0, int(toxic)))
    rows += [(1000, None, None, 9), (1001, "", None, 9), (None, "blarg blarg", None, 9), (1002, words(rng, 30_000, 400), None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score long")
    label = spark.createDataFrame(labels + [(None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    model = learn(docs, label)
    got = {r.doc_id: r for r in score_documents(docs, model).collect()}
    held = [k for k in range(900) if got[k].held_out]
    assert held and all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in range(900))
    right = sum(got[k].predicted == (k % 6 == 0) for k in held)
    assert right >= 0.97 * len(held)
    assert all(got[k].predicted == 0 and 0 <= got[k].score < 0.1 for k in (1000, 1001, 1002))
    found = offending_sentences(docs.where(F.col("doc_id") < 900), model).collect()
    assert all(any(w in r.sentence for w in bad) for r in found) and len({r.doc_id for r in found}) >= 140
    assert clean_documents(docs, model).columns == docs.columns
    one = learn(docs, label.where("toxic = 0"))
    assert {r.predicted for r in score_documents(docs, one).collect()} == {0}
    assert score_documents(docs.limit(0), learn(docs.limit(0), label.limit(0))).count() == 0


def test_words_beyond_ascii(spark):
    from flowsentry.llm.decontaminate import contaminated_pairs
    from flowsentry.llm.toxicity import ToxicityModel, offending_sentences, score_documents
    from flowsentry.llm.wordtable import NOT_ALNUM, Words, word_bytes

    def split(text):
        w = Words([word_bytes(text)], NOT_ALNUM)
        return [w.word(k).decode() for k in range(len(w.hash))]
    assert split("“One”—two\u2026three\u00a0four\u3000don’t «пять» ni\u00adño") == ["one", "two", "three", "four", "don", "t", "пять", "niño"]
    assert split("这是abc。हिन्दी भाषा।") == ["这", "是", "abc", "हिन्दी", "भाषा"]
    item = [f"t{k}" for k in range(14)]
    chinese = "春眠不觉晓处处闻啼鸟夜来风雨"
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, chinese)], "item_id long, text string")
    typeset = "“" + "” “".join(item[:5]) + "”\u2014" + "\u00a0".join(item[5:9]) + "…" + "\u2013".join(item[9:]) + "’s"
    docs = spark.createDataFrame([(1, typeset), (2, f"他说{chinese}声。"), (3, "春天来了")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated_pairs(docs, benchmark).collect()} == {(1, 1), (2, 2)}

    model = ToxicityModel(Words([b"blarg"], NOT_ALNUM).hash, np.array([6.0]), -2.0, 0.01)
    texts = ["a blarg b", "a “blarg” b", "so—blarg—he", "a\u00a0blarg…", "这blarg是", "a blargs b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.predicted for r in score_documents(docs, model).orderBy("doc_id").collect()] == [1, 1, 1, 1, 1, 0]
    text = "Größe “ok”。这是 İ… Bad «Blarg»！ End. blarg"
    found = offending_sentences(spark.createDataFrame([(7, "Fine. Text."), (8, text)], "doc_id long, text string"), model).collect()
    assert [(r.doc_id, r.start_byte, r.sentence) for r in found] == [
        (8, len(text.lower()[:text.lower().index(" bad")].encode()), "bad «blarg»！"), (8, len(text.lower()[:-6].encode()), "blarg")]


def test_forward_sums_all_segmentations():
    from flowsentry.llm.language_id import MARK, UNKNOWN, Lattice, forward
    pieces = [MARK, MARK + "a", "a", "b", "ab", "bc", "abc"]
    p = np.array([[.1], [.2], [.3], [.05], [.15], [.1], [.1], [UNKNOWN]])

    def total(text):
        if not text:
            return 1.0
        out = 0.0
        for k in range(1, len(text) + 1):
            if text[:k] in pieces:
                out += p[pieces.index(text[:k]), 0] * total(text[k:])
            elif k == 1:
                out += UNKNOWN * total(text[k:])
        return out
    words_ = ["abc", "a", "", "abab", "cab", "zé"]
    n, edges = Lattice(pieces).edges(words_)
    alpha = forward(n, edges, p)
    assert np.allclose(alpha[n, np.arange(len(n)), 0], [total(MARK + w) for w in words_], rtol=1e-12)


def test_language_id_on_held_out_rows(spark):
    import public_tokenizers

    from flowsentry.llm.language_id import learn, predict_languages, vocabulary
    rng = np.random.default_rng(6)
    syllables = {"aa": ["the", "ing", "ed", "er", "th"], "bb": ["que", "eau", "le", "ment", "é"], "cc": ["sch", "ung", "der", "ein", "ü"]}
    rows = []
    for k in range(600):
        lang = list(syllables)[k % 3]
        text = " ".join("".join(rng.choice(syllables[lang], int(rng.integers(1, 4)))) for _ in range(12))
        rows.append((k, text, lang if k % 7 else None, "x"))
    rows += [(1000, None, "aa", "x"), (1001, "", "aa", "x"), (1002, "123 .!", "aa", "x"), (None, "theing", "aa", "x"),
             (1003, "queeau " * 20_000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    pieces = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in predict_languages(docs, learn(docs, pieces)).collect()}
    assert sum(got[k].lang_pred == list(syllables)[k % 3] for k in range(600)) >= 590
    assert [got[k].lang_pred for k in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert learn(docs.limit(0), pieces) is None and predict_languages(docs, None).first().lang_pred == "und"


# ---------------------------------------------------------------- pages and vectors
def test_html_main_text(spark):
    from flowsentry.llm.html_extract import Weights, extract, extract_pages
    page = ("<html><head><title>t</title><script>var t='</p>';</script></head><body><header>Site name</header><nav><ul><li><a href=x>"
            "Home</a><li><a href=y>All</a></ul></nav><div class='cookie-notice'>We use cookies a lot here</div><article><h1>A &amp; B</h1>"
            "<p>First  para <b>with\nbold.<br>More<p>Second &eacute;t&eacute;.</p><div class=\"ad\">Buy now, buy it all</div><form>Name: <input>"
            "</form><p>Third.</p></article><section id=comments><p>Nice one, reader here</p></section><footer>&copy; 2020</footer>")
    expected = "A & B\n\nFirst para with bold. More\n\nSecond été.\n\nThird."
    assert extract(page, Weights({})) == expected
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>" + "long words " * 30_000), (1, "u", page), (None, "u", "plain text"),
            (5, "u", "<nav><a>one</a></nav>"), (6, "u", "<<<a <b <!-- x"), (7, "u", page.replace("</article>", ""))]
    frame = spark.createDataFrame([r + ("clash",) for r in rows], "page_id long, url string, html string, text string")
    got = extract_pages(frame).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == expected and by[2] == by[3] == by[5] == "" and by[None] == "plain text"
    assert len(by[4]) == len("long words " * 30_000) - 1
    assert extract_pages(frame.limit(0)).count() == 0


def test_html_names_say_nothing_about_the_content():
    from flowsentry.llm.html_extract import Weights, extract
    one, two = "The first paragraph says a thing or two.", "And so does the second one, here."
    body, both = f"<p>{one}</p><p>{two}</p>", f"{one}\n\n{two}"
    pages = {
        f'<html class="no-js has-banner"><body class="single no-sidebar"><article>{body}</article></body></html>': both,
        f'<body><main id="search-content">{body}</main><footer>foot</footer></body>': both,
        f'<article class="post has-comments">{body}</article>': both,
        f'<div class="sidebar"><article>{body}</article></div>': both,
        f'<div class="page-with-sidebar">{body}</div><div class="my-sidebar">some links</div>': both,
        f'<form id="all">{body}</form>': both,
        f'<article><div class="entry-header"><h1>Headline</h1></div><div class="header">By me</div>{body}</article>': f"Headline\n\nBy me\n\n{both}",
        f'<article>{body}<div class="tools share">Tweet</div><div id="comments">Nice</div><div class=ad>Buy</div><p class="ad-free">End</p></article>': both + "\n\nEnd",
        f'<article><div class="overflow-hidden"><p aria-hidden="false" title="a hidden b">{one}</p></div><p>{two}</p></article>': both,
        f'<article>{body}<p hidden>gone</p><p hidden="">gone</p><p style="color:red; display: none">gone</p></article>': both,
        f'<article><svg width="1"/><svg-icon x=1></svg-icon><p>{one}</p><svg><text>gone</text></svg><p>{two}</p></article>': both,
        f'<article><math/><p>{one}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p></article>': f"{one}\n\nLet x=2 hold.",
        f'<div class="post">{body}</div><div class="related"><article><p>Teaser.</p></article></div>': both,
        f'<article><p>{one}</p><div id="comments"><p>{"talk " * 40}</p></div></article>': one,
    }
    for page, text in pages.items():
        assert extract(page, Weights({})) == text, page


def test_ann_recall_order_and_odd_vectors(spark):
    from pyspark.sql import functions as F

    from flowsentry.llm.ann import search
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 16))
    x[700:1000] = x[3]                                          # one vector many times
    rows = [(i, [float(v) for v in row], "z") for i, row in enumerate(x)]
    rows += [(2000, None, "z"), (2020, [0.0] * 16, "z"), (2040, [float("nan")] + [1.0] * 15, "z"), (2060, [1.0, None] + [0.0] * 14, "z"),
             (2080, [1.0] * 3, "z"), (None, [1.0] * 16, "z")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf string")
    got = {}
    for r in search(table, F.col("vec_id") % 20 == 0, k=20, block_rows=100, leaf_rows=30).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        assert all(abs(f[2] - float(x[f[1]] @ x[q])) < 1e-9 for f in found)
        score = x @ x[q]
        score[q] = -np.inf
        hits += sum(f[2] >= np.sort(score)[-20] - 1e-9 for f in found)
    assert hits >= 0.9 * 20 * len(got)
    # cells of one leaf or of many, queries in parts or together: the same rows
    for block_rows, part_queries in ((100, 7), (5000, 5000)):
        again = search(table, F.col("vec_id") % 20 == 0, k=20, block_rows=block_rows, part_queries=part_queries, leaf_rows=30).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in again) == [(q, *f) for q in sorted(got) for f in got[q]]
    few = search(table.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert [r["rank"] for r in few] == [1, 2, 3, 4]
    assert search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_cells_hold_neighbouring_leaves():
    from flowsentry.llm.ann import cells_of
    assert cells_of(np.array([3, 4, 5, 0, 20, 0, 1, 9, 1]), 10).tolist() == [0, 0, 1, 1, 2, 3, 3, 3, 4]
    assert cells_of(np.array([0]), 10).tolist() == [0]


def test_floor_is_reached_by_k_rows():
    from flowsentry.llm.ann import inner_products, kth_best
    rng = np.random.default_rng(3)
    x, leaf, ids = rng.normal(size=(300, 8)), rng.integers(0, 10, 300), np.arange(300)
    for query in range(0, 300, 20):
        leaves = np.unique(rng.integers(0, 10, 4))
        there = np.isin(leaf, leaves) & (ids != query)
        best = np.sort(inner_products(x[there], x[query]))[::-1]
        floor = kth_best(query, x[query], leaves, (ids, x, leaf), 5)
        assert floor <= best[4] < floor + 1e-6 and (best >= floor).sum() >= 5
    assert kth_best(0, x[0], np.array([99]), (ids, x, leaf), 5) == -np.inf
    assert kth_best(-1, x[0] * 1e300, np.arange(10), (ids, x * 1e300, leaf), 5) == -np.inf


# ---------------------------------------------------------------- empty tables
def test_empty_documents(spark, nothing, tmp_path):
    import public_tokenizers

    from flowsentry.llm.packing import pack_documents
    from flowsentry.llm.simhash import near_duplicates
    from flowsentry.llm.suffix_dedup import remove_repeats
    from flowsentry.llm.token_counts import token_counts
    assert near_duplicates(nothing).count() == 0
    assert remove_repeats(nothing).count() == 0
    assert pack_documents(nothing, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert token_counts(nothing, public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "c")).count() == 0
