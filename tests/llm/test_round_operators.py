"""Ranked search, tokenizer alignment and fingerprints against brute force, the
mended parts of language ID, SimHash and toxicity, and the pipeline as a whole."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def some_texts(seed=1, n=60):
    rnd = random.Random(seed)
    vocabulary = ["alpha", "Beta", "GAMMA", "été", "日本", "x1", "the", "of", "a", "Ünder", "'s", "naïve"]
    out = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))) + rnd.choice(["", ".", "\n", "!?"]) for _ in range(n)]
    return out + ["", "   ", "...", None, out[3], out[3], "the " * 5000]


def frame(spark, texts, start=0):
    rows = [(start + i, t, "clash", 7) for i, t in enumerate(texts)] + [(None, "alpha beta of the gamma", "clash", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, term string, part int").repartition(5)


# ---------------------------------------------------------------- ranked search
def plain_ranking(docs, items, k):
    terms = [Counter(WORD.findall((t or "").translate(ASCII))) for _, t in docs]
    n_docs, total = sum(bool(t) for t in terms), sum(sum(t.values()) for t in terms)
    df = Counter(w for t in terms for w in t)
    out = {}
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(WORD.findall((text or "").translate(ASCII)))
    for item, wanted in asked.items():
        found = []
        for (doc, _), t in zip(docs, terms):
            m = 75 + (25 * sum(t.values()) * n_docs) // max(total, 1)
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10 ** 9 * t[w]) // (1000 * t[w] + 12 * m))
                        for w, c in wanted.items() if w in t)
            if score > 0:
                found.append((-score, doc is None, doc))
        out[item] = [(r, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


@pytest.mark.parametrize("bucket_rows, block_terms", [(4, 6), (2048, 10 ** 6)])
def test_ranked_search_matches_brute_force(spark, bucket_rows, block_terms):
    from flowsentry.llm.lexical import rank_documents
    docs = frame(spark, some_texts())
    items = [(1, "Alpha beta beta 日本"), (2, None), (3, "nowhere"), (4, "été x1 the the of"), (4, "gamma"), (None, "naïve"), (5, "")]
    got: dict = {}
    for r in rank_documents(docs, spark.createDataFrame(items, "item_id long, text string"), 7, bucket_rows, 1, block_terms).collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    want = plain_ranking([(r.doc_id, r.text) for r in docs.collect()], items, 7)
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}
    assert rank_documents(docs.limit(0), docs.select(F_long("doc_id"), "text")).count() == 0


def F_long(c):
    from pyspark.sql import functions as F
    return F.col(c).alias("item_id")


# ---------------------------------------------------------------- alignment
def plain_alignment(texts):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    from flowsentry.llm.alignment import byte_alphabet
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    alphabet, name = byte_alphabet(), {i: t for t, i in a.get_vocab().items()}
    spell_a = lambda i: bytes(alphabet[c] for c in name[i]) if all(c in alphabet for c in name[i]) else name[i].encode()
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows, held = [], Counter()
    for text in texts:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bx, by = [spell_a(i) for i in x], [spell_b(i) for i in y]
        if not text or b"".join(bx) != (" " + text).encode() or b"".join(by) != (" " + text).encode():
            rows.append(None)
            continue
        ex, ey = list(itertools.accumulate(map(len, bx))), list(itertools.accumulate(map(len, by)))
        groups, low = [], 0
        for cut in sorted(set(ex) & set(ey)):
            groups.append(([i for i, e in zip(x, ex) if low < e <= cut], [j for j, e in zip(y, ey) if low < e <= cut]))
            low = cut
        links = [(i, j) for s, t in groups for i in s for j in t]
        held.update(set(links))
        rows.append((len(x), len(y), groups, links))
    most: dict = {}
    for (i, _), n in held.items():
        most[i] = max(most.get(i, 0), n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        spelt = ";".join(",".join(map(str, s)) + "|" + ",".join(map(str, t)) for s, t in row[2])
        out.append((row[0], row[1], len(row[2]), len(row[3]), sum(held[x] == most[x[0]] for x in row[3]), sum(held[x] for x in row[3]),
                    hashlib.sha256(spelt.encode()).hexdigest()))
    return out


def test_alignment_matches_brute_force(spark):
    import public_tokenizers as P

    from flowsentry.llm.alignment import align_documents
    rnd = random.Random(4)
    signs = ["a", "the", " ", "  ", "\n", "\t", "é", "日本", "𝒳", " ", "　", "▁", "<0x41>", "<|endoftext|>", "<s>", "🙂👍🏽", "́", "'s", "9", "\x00",
             "¿", "«", "\u0085", "ﬁ", ".", "ا", "क्षि", "﻿"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 20))) for _ in range(300)] + [None, "", " ", "x" * 3000, "日" * 800, " a ", "a "]
    rows = [(i, t, 1, [2]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, pairs array<int>").repartition(6)
    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = dict(enumerate(plain_alignment(texts)))
    for block_pairs in (200, 10 ** 6):
        got = {r.doc_id: tuple(r[c] for c in names) for r in align_documents(docs, *paths, block_pairs=block_pairs).collect()}
        assert got == want
    assert align_documents(docs.limit(0), *paths).count() == 0
    # counts are over rows: two equal rows hold a pair twice
    twice = align_documents(docs.where("doc_id = 303").unionByName(docs.where("doc_id = 303")), *paths).collect()
    assert len(twice) == 2 and all(r.count_sum == 2 * r.n_links for r in twice)


# ---------------------------------------------------------------- fingerprints
def weighted_terms(text):
    found = WORD.findall(text or "")
    return Counter(w.lower() for w in found) if found else Counter(["\x00" + (text or "")])


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def test_fingerprints_estimate_generalised_jaccard(spark):
    from flowsentry.llm.fingerprints import fingerprints, likeness, neighbour_fingerprints
    rnd = random.Random(7)
    # many words, as texts that share few words share their draws' errors too
    texts = some_texts(7, 40) + [" ".join(f"word{int(rnd.paretovariate(0.7))}" for _ in range(rnd.randint(5, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(i * 3 - 100, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, bucket int, seq int").repartition(7)
    got = {r.doc_id: r for r in neighbour_fingerprints(docs, samples=64, bucket_rows=5).collect()}
    order = sorted(((i * 3 - 100, t or "") for i, t in enumerate(texts)), reverse=True)
    errors, by_text = [], {}
    for k, (doc, text) in enumerate(order):
        following, half = order[(k + 1) % len(order)][1], len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        r = got[doc]
        assert (r.n_chars, r.edited_text) == (len(text), edited)
        errors += [r.near_edited - jaccard(weighted_terms(text), weighted_terms(edited)), r.near_next - jaccard(weighted_terms(text), weighted_terms(following))]
        for t, f in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert by_text.setdefault(t, f) == f                      # equal texts, equal fingerprints
    assert len({f for f in by_text.values()}) > 0.9 * len({tuple(sorted(weighted_terms(t).items())) for t in by_text})
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.075
    alone = {r.doc_id: r.fingerprint for r in fingerprints(docs, bucket_rows=50).collect()}
    assert alone == {k: r.fingerprint for k, r in got.items()}
    pair = spark.createDataFrame([(got[-100].fingerprint, got[-100].edited_fingerprint)], "a string, b string")
    assert pair.select(likeness(pair.a, pair.b).alias("x")).first().x == pytest.approx(got[-100].near_edited)


def test_fingerprints_of_few_null_and_repeated_rows(spark):
    from flowsentry.llm.fingerprints import neighbour_fingerprints
    schema = "doc_id long, text string"
    one = neighbour_fingerprints(spark.createDataFrame([(5, "a b c d")], schema)).collect()
    assert len(one) == 1 and one[0].edited_text == "a b a b" [:4] + "a b"
    assert neighbour_fingerprints(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, f"text {k}") for k in range(40)] + [(3, "same words")] * 40 + [(3, None), (9, ""), (-(1 << 63), "least"), ((1 << 63) - 1, "most")]
    got = neighbour_fingerprints(spark.createDataFrame(rows, schema).repartition(4), bucket_rows=3).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((d is None, d or 0) for d, _ in rows)
    assert len({r.fingerprint for r in got if r.doc_id == 3}) == 2 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    last = [r for r in got if r.doc_id is None and r.edited_text.endswith("mos")]
    assert len(last) == 1                                             # after the last row comes the first


def test_fingerprints_run_no_python(spark):
    from flowsentry.llm.fingerprints import neighbour_fingerprints
    plan = neighbour_fingerprints(frame(spark, some_texts()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "CartesianProduct" not in plan


def test_fingerprint_tasks_hold_a_few_buckets_each(spark):
    """More rows make more tasks, not larger ones."""
    from pyspark.sql import functions as F

    from flowsentry.llm.fingerprints import TASK_BUCKETS, with_next
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    small, large = (with_next(docs.limit(n), bucket_rows=10) for n in (300, 3000))
    assert large.rdd.getNumPartitions() >= 300 / TASK_BUCKETS > small.rdd.getNumPartitions()
    held = large.groupBy(F.spark_partition_id()).agg(F.count_distinct("bucket").alias("n")).agg(F.max("n")).first()[0]
    assert held <= 8 * TASK_BUCKETS and large.where("not guest").count() == 3000


# ---------------------------------------------------------------- mended operators
def test_long_words_sum_all_segmentations():
    import public_tokenizers

    from flowsentry.llm.language_id import MARK, SHORT, UNKNOWN, Lattice, LanguageModel, vocabulary
    pieces = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert max(map(len, pieces)) > 12
    rng = np.random.default_rng(2)
    p = np.vstack([rng.dirichlet(np.ones(len(pieces)), 2).T, np.full(2, UNKNOWN)])
    number = {x: k for k, x in enumerate(pieces)}

    def total(text, lang):
        sums = [1.0]
        for end in range(1, len(text) + 1):
            sums.append(sum(sums[start] * (p[number[text[start:end]], lang] if text[start:end] in number else UNKNOWN)
                            for start in range(end) if text[start:end] in number or end - start == 1))
        return sums[-1]
    rnd = random.Random(1)
    names = ["".join(rnd.choice("abcdefghinorstéß日") for _ in range(n)) for n in (9, 16, 25, SHORT, SHORT + 1, 45, 60)] + ["international" * 3]
    model = LanguageModel(["x", "y"], np.zeros(2), pieces, p)
    got = model.log_scores(model.scorer(), [w.encode() for w in names])
    assert np.allclose(got, [[math.log(total(MARK + w, lang)) for lang in (0, 1)] for w in names], rtol=1e-5)
    lattice = Lattice(pieces)
    # a long word's expected uses cover each of its characters once
    uses = Counter()
    for piece, use in lattice.log_uses(names[-1], np.log(p[:, 0])):
        uses[piece] += use
    assert sum(use * (len(pieces[k]) if k >= 0 else 1) for k, use in uses.items()) == pytest.approx(len(names[-1]) + 1)
    n, blocks, rows = lattice.places(names[-2], block=7)
    assert len(blocks) > 5 and [r for at in blocks for r in rows(at)] == lattice.places(names[-2])[2](0)


def test_representatives_keep_rows_that_differ(spark):
    from flowsentry.llm.simhash import near_duplicates, representatives
    c, d, e = "one two three four", "red green blue grey black", "quite another text it is"
    rows = [(5, c, 1, "p"), (5, d, 1, "q"), (7, c, 1, "r"), (8, d, 1, "s"), (None, e, 1, "t"), (None, e, 1, "t"), (None, c, 1, "u"), (9, None, 1, "v"), (9, "", 1, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, ROW string")
    got = near_duplicates(docs).collect()
    named = {(r.doc_id, r.component_id) for r in got}
    assert len(got) == len(rows) and named == {(5, 5), (7, 5), (8, 5), (None, None), (None, 5), (9, 9)}
    assert len({r.fp for r in got}) == 4
    kept = representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(5, c), (5, d), (0, e), (9, "")])


def test_noisy_or_matches_its_definition():
    from flowsentry.llm.toxicity import fit_noisy_or
    rng = np.random.default_rng(3)
    n_docs, n_features = 200, 6
    doc, sentence, feature, y = [], [], [], (rng.random(n_docs) < 0.4).astype(float)
    for k in range(n_docs):
        for s in range(3):
            doc.append(k)
            if rng.random() < 0.8:
                sentence.append(len(doc) - 1)
                feature.append(int(rng.integers(0, 3)) + 3 * int(y[k] and s == 1))
    doc, sentence, feature = map(np.array, (doc, sentence, feature))
    w, bias, rate = fit_noisy_or(doc, sentence, feature, y, n_features)
    clean = np.full(n_docs, 1 - rate)
    for s, d in enumerate(doc):                                       # one minus the product of what each sentence lets pass
        clean[d] *= 1 - 1 / (1 + math.exp(-(bias + sum(w[f] for f in feature[sentence == s]))))
    found = 1 - clean
    assert w[3:].min() > w[:3].max() and found[y == 1].mean() > found[y == 0].mean() + 0.4


def test_pipeline_runs_whole(spark, tmp_path):
    import corpus_pipeline
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{int(k)}" for k in rng.integers(0, 4000, n))
    shared, probe = text(60), text(30)
    rows = [(k, text(80), "en", "s", 1, True) for k in range(40)]
    rows += [(50, rows[3][1], "en", "s", 1, True), (51, "start " + shared + " " + text(30), None, None, None, None), (52, text(30) + " " + shared, "en", "s", 1, True),
             (53, text(20) + " " + probe + " " + text(20), "en", "s", 1, True), (None, text(40), "en", "s", 1, True), (54, None, "en", "s", 0, None), (7, text(50), "en", "s", 1, False)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `null_text` boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k % 9 == 0)) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, probe), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = Counter(r.doc_id for r in got)
    assert 50 not in ids and 53 not in ids and {51, 52, None} <= set(ids) and ids[7] == 2
    by_sequence: dict = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    empty = tmp_path / "none"
    for name, columns in (("documents", schema), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], columns).write.parquet(str(empty / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


# ---------------------------------------------------------------- pages
def test_best_run_matches_all_runs():
    from flowsentry.llm.html_extract import best_run
    rnd = random.Random(8)
    for _ in range(300):
        scores = [rnd.choice([-3.0, -1.0, -0.5, 0.0, 1.0, 2.5]) for _ in range(rnd.randint(0, 14))]
        every = [sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        found = best_run(scores)
        if not every or max(every) <= 0:
            assert found is None
        else:
            assert sum(scores[slice(*found)]) == max(every)


@pytest.mark.parametrize("piece", ["<b>x ", "<div>", "</p>", "<div></p>", '<a href="x', "<svg a='", "<script ", "<i a='>", "<i a=\"'>", "<p>x<b>", "<!-- ", "<li>y"])
def test_broken_pages_take_linear_time(piece):
    import time

    from flowsentry.llm.html_extract import Weights, extract
    weights = Weights({})
    for end in ("", ">"):
        took = []
        for n in (8_000, 64_000):
            started = time.process_time()
            extract(piece * n + end, weights)
            took.append(time.process_time() - started)
        assert took[1] < 8 * 4 * max(took[0], 0.05)                    # eight times the page; a quadratic reader takes 64 times as long


def test_blocks_after_the_best_run_stay_where_they_share_its_element():
    from flowsentry.llm.html_extract import Weights, extract
    body = "<h1>Head line</h1><p>" + "long words here " * 30 + "</p><ul><li>one</li></ul><table><tr><td>cell</td></tr></table><p>End.</p>"
    got = extract(f"<body><div class='menu'><a>Home</a></div><div>{body}</div><div class='footer'>Foot</div></body>", Weights({}))
    assert got.split("\n\n")[0] == "Head line" and got.endswith("one\n\ncell\n\nEnd.") and "Foot" not in got and "Home" not in got
    # an unclosed script or comment at the end swallows the rest
    for tail in ("<script>never closed", "<!-- never > closed", "<!-- never closed", "<script >a < b"):
        assert extract(f"<article><p>{'some words ' * 9}</p></article>{tail}", Weights({})) == ("some words " * 9).strip()
