"""The registered queries against their contracts, on the smallest tables."""

import hashlib
import re

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name):
    from flowsentry.llm.queries import QUERIES
    return QUERIES[name](spark, SF)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op2_digests_what_is_left(spark, texts):
    got = {r.doc_id: r for r in rows(spark, "op2_suffix_dedup").collect()}
    seen, want = set(), {}
    for doc in sorted(texts):
        data = texts[doc].encode()
        gone = bytearray(len(data))
        strings = [data[k:k + 50] for k in range(len(data) - 49)]
        for k, s in enumerate(strings):
            if s in seen:
                gone[k:k + 50] = b"\x01" * 50
        seen.update(strings)
        left = bytes(b for b, g in zip(data, gone) if not g)
        want[doc] = (len(data), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(left).hexdigest())
    assert {k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for k, r in got.items()} == want


def test_op5_names_components_and_spells_fingerprints(spark, texts):
    got = {r.doc_id: r for r in rows(spark, "op5_simhash_near_dedup").collect()}
    assert set(got) == set(texts) and all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in got.values())
    codes = {k: int(r.fingerprint, 16) for k, r in got.items()}
    component = {k: k for k in codes}
    changed = True
    while changed:
        changed = False
        for a in codes:
            least = min(component[b] for b in codes if (codes[a] ^ codes[b]).bit_count() <= 2)
            changed, component[a] = changed or least < component[a], min(component[a], least)
    assert {k: r.component_id for k, r in got.items()} == component


def test_op9_counts_whole_texts(spark, texts):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows(spark, "op9_token_counts").collect():
        n = len(model.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_op10_reads_back_the_added_conversation_and_all_others(spark):
    from flowsentry.llm.queries import PLANTED_TURN
    turns: dict = {-7: [("user", PLANTED_TURN), ("assistant", PLANTED_TURN)]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in rows(spark, "op10_chat_format").collect()}
    assert set(got) == set(turns) and got[-7].n_turns == 2
    assert got[-7].turns_sha256 == digest("".join(f"{role}\n{text}\n" for role, text in turns[-7]))
    assert (got[-7].loss_chars, got[-7].loss_sha256) == (len(PLANTED_TURN), digest(PLANTED_TURN))


def test_op11_ranks_are_whole(spark, texts):
    got = rows(spark, "op11_lexical_search").collect()
    by_item: dict = {}
    for r in got:
        by_item.setdefault(r.item_id, []).append((r["rank"], -r.score, r.doc_id))
    for hits in by_item.values():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, len(hits) + 1)) and len(hits) <= 20 and hits == sorted(hits, key=lambda h: h[1:])


def test_op12_and_op13_answer_every_document(spark, texts):
    aligned = {r.doc_id: r for r in rows(spark, "op12_tokenizer_alignment").collect()}
    assert set(aligned) == set(texts) and all((r.n_a == 0) == (r.groups_sha256 == "") for r in aligned.values())
    prints = {r.doc_id: r for r in rows(spark, "op13_fingerprints").collect()}
    order = sorted(texts, reverse=True)
    for k, doc in enumerate(order):
        text, following = texts[doc], texts[order[(k + 1) % len(order)]]
        half = len(text) // 2
        assert prints[doc].n_chars == len(text) and prints[doc].edited_sha256 == digest(text[:len(text) - half] + following[:half])
