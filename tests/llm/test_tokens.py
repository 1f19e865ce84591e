from __future__ import annotations

import random
import zlib
from collections import Counter as Tally

import numpy as np
import pytest

from changeflow.llm import pieces, repair, sampling
from changeflow.llm.common import tokenizer_file
from changeflow.llm.token_counts import Counter, token_counts

PIECES, BYTES = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  a  b ", "x\n\ny \n z", "héllo ▁ wörld", "日本語 テスト", "aaaaaaaaaaaaaaaa aaaa", "\x00tab\tq", "no" * 300, "😀 ok",
    " lead", "trail  ", "▁", "▁▁ a", "it's o'k 12 3", "x  y", "a <|endoftext|> b", "the tion er in ing",
]


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(PIECES)


@pytest.fixture(scope="module")
def unigram():
    import sentencepiece
    from tokenizers import Tokenizer, models

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]
    return Tokenizer(models.Unigram(table, unk_id=0, byte_fallback=True))


def sample_texts(n=150):
    made = random.Random(6)
    letters = "etaoinshr eee  dlu\n.,é日▁"
    return TEXTS + ["".join(made.choice(letters) for _ in range(made.randint(1, 80))) for _ in range(n)]


def test_counts_equal_the_unigram_tokenizer(unigram):
    texts = sample_texts()
    got = Counter(PIECES).count(texts)
    for text, (_, n, _) in zip(texts, got, strict=True):
        if "<" in text:
            continue  # that library also matches byte pieces' names
        written = "▁" + text.replace("▁", "￾").replace(" ", "▁") if text else ""
        assert n == len(unigram.encode(written).ids), text


def test_matches_equal_those_of_another_automaton(vocab):
    import ahocorasick
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    other = ahocorasick.Automaton()
    for i in np.flatnonzero(vocab.lengths):
        other.add_word(model.id_to_piece(int(i)), int(i))
    other.make_automaton()
    for name in ["then", "日本語テスト", "xyzzy", "é▁", "internationalization"]:
        lat = pieces.lattice([name], vocab)
        got = sorted((int(e), int(p)) for e, p in zip(lat.end, lat.piece, strict=True) if p >= 0)
        assert got == sorted((e + 1, p) for e, p in other.iter("▁" + name))


def test_counts_of_odd_and_no_rows(spark, odd_documents, no_documents):
    got = token_counts(odd_documents, PIECES).collect()
    assert len(got) == odd_documents.count()
    assert {(r.n_pieces, r.score) for r in got if r.n_chars == 0} == {(0, 0.0)}
    assert token_counts(no_documents, PIECES).count() == 0


def test_samples_decode_and_depend_on_the_row_alone(vocab):
    texts = sample_texts()
    keys = np.arange(len(texts)) * 7
    got = sampling.sampled_pieces(texts, keys, vocab, 1, 1.0)
    assert [sampling.decoded(p, vocab) for p in got] == [t.encode() for t in texts]
    some = [20, 3, 90]
    again = sampling.sampled_pieces([texts[k] for k in some], keys[some], vocab, 1, 1.0)
    assert all((a == got[k]).all() for a, k in zip(again, some, strict=True))
    other = sampling.sampled_pieces(texts, keys, vocab, 2, 1.0)
    assert any(len(a) != len(b) or (a != b).any() for a, b in zip(got, other, strict=True))


def test_samples_follow_the_path_probabilities(vocab):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = {model.id_to_piece(int(i)): int(i) for i in np.flatnonzero(vocab.lengths)}

    def paths(rest):
        if not rest:
            yield (), 1.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in ids:
                i = ids[rest[:k]]
                for tail, p in paths(rest[k:]):
                    yield (i, *tail), p / (1 + min(-vocab.scores[i], len(vocab.scores)))

    exact = dict(paths("▁then"))
    whole, n = sum(exact.values()), 20_000
    got = Tally(tuple(p.tolist()) for p in sampling.sampled_pieces(["then"] * n, np.arange(n), vocab, 3, 1.0))
    assert set(got) <= set(exact)
    for path, p in exact.items():
        q = p / whole
        assert abs(got[path] - n * q) <= 5 * (n * q * (1 - q)) ** 0.5 + 1


def test_sampled_rows_round_trip(spark, odd_documents, no_documents):
    encoded = sampling.encode_sampled(odd_documents, PIECES)
    back = sampling.decode_pieces(encoded, PIECES).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in back) == sorted(
        (r.doc_id is None, r.doc_id or 0, r.text or "") for r in odd_documents.collect()
    )
    digests = sampling.sampled_digests(odd_documents.repartition(5), PIECES).collect()
    by_id = {r.doc_id: list(r.pieces) for r in encoded.collect() if r.doc_id is not None}
    for r in digests:
        assert r.lossless
        if r.doc_id is not None:
            assert r.pieces_crc32 == zlib.crc32(np.array(by_id[r.doc_id], "<u4").tobytes()) and r.n_pieces == len(by_id[r.doc_id])
    assert sampling.encode_sampled(no_documents, PIECES).count() == 0


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(BYTES).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_parts_encode_like_whole_texts(monkeypatch):
    texts = sample_texts()
    work = repair.Encoder(BYTES)
    assert [x.tolist() for x in work.encode(texts)] == library_ids(texts)
    monkeypatch.setattr(repair, "KEPT", 3)
    small = repair.Encoder(BYTES)
    assert [x.tolist() for _ in range(2) for x in small.encode(texts)] == library_ids(texts) * 2


def test_a_word_is_asked_for_once_whatever_signs_follow(monkeypatch):
    work, asked = repair.Encoder(BYTES), []
    ids = work._ids
    monkeypatch.setattr(work, "_ids", lambda texts: asked.extend(texts) or ids(texts))
    text = " ".join(["so", *(f"internationally{s}" for s in ("", ",", ".", ";", "!***", "?\nThen"))])
    assert [x.tolist() for x in work.encode([text, text])] == library_ids([text, text])
    assert "".join(asked).count("internationally") == 1


def test_pieces_around_signs_and_line_ends_encode_like_whole_texts():
    made = random.Random(7)
    some = [*"aBéßĳ×÷'.,*-_`12²½ǅ日\t\x85\xa0\x1f\u2028", "'s", "'ll", "e\u0301", "\n", "\n\n", "\n\n\n", "\r\n", "\n\t", "\nThen", "<|", "<|endoftext|>", "word", *"      ", "  "]
    texts = ["".join(made.choices(some, k=made.randint(0, 25))) for _ in range(4000)]
    work = repair.Encoder(BYTES)
    for at in range(0, len(texts), 1500):
        assert [x.tolist() for x in work.encode(texts[at : at + 1500])] == library_ids(texts[at : at + 1500])
    assert work.encode([]) == [] and [x.tolist() for x in work.encode([None, "", "x" * 99])] == library_ids([None, "", "x" * 99])


def test_wide_keys_are_grouped_alike():
    key = np.random.default_rng(8).integers(0, 50, 3000).astype(np.uint64)
    for a, b in zip(repair._grouped(key, 6), repair._grouped(key, 64), strict=True):
        assert (a == b).all()
    assert [len(x) for x in repair._grouped(key[:0], 64)] == [0, 0, 0]


def test_long_rules_expand_one_at_a_time():
    rules = np.array([(5, 6), *((repair.FIRST_RULE + k, 7) for k in range(999))])
    assert repair.symbol_sizes(rules)[repair.FIRST_RULE :].sum() > 4 * repair.FIRST_RULE
    assert repair.expand(np.array([3, repair.FIRST_RULE + 999]), rules).tolist() == [3, 5, 6] + [7] * 999


def test_grammars_expand_to_the_ids():
    made = np.random.default_rng(4)
    for ids in (np.empty(0, int), np.array([5]), np.full(1000, 7), np.tile([3, 4, 5, 2], 400), made.integers(0, 12, 5000), made.zipf(1.5, 5000) % 50_000):
        rules, lengths, symbols = repair.compress(ids.astype(np.uint16))
        assert (repair.expand(symbols, rules) == ids).all()
        assert [len(repair.expand(np.array([repair.FIRST_RULE + k]), rules)) for k in range(len(rules))] == lengths.tolist()
        assert not any((repair.expand(np.array([x]), rules)[:-1] == repair.END).any() for x in rules[:, 0])
        row = {"rules": rules.tobytes(), "lengths": lengths.tobytes(), "symbols": symbols.tobytes()}
        for low in range(0, max(1, len(ids) - 40), 97):
            assert (repair.ids_between(row, low, min(low + 40, len(ids))) == ids[low : low + 40]).all()
    assert len(repair.compress(np.tile([3, 4], 500))[2]) < 300


def pairs_twice(symbols, rules):
    """Pairs that occur twice or more without overlap and don't go on past a document's end."""
    seen, last = Tally(), {}
    for k, pair in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True)):
        if repair.expand(np.array(pair[:1]), rules)[-1] != repair.END and last.get(pair, -2) < k - 1:
            seen[pair] += 1
            last[pair] = k
    return {pair for pair, n in seen.items() if n > 1}


def test_grammars_leave_no_pair_twice():
    made = np.random.default_rng(5)
    assert sum(map(len, repair.compress(np.tile([3, 4], 500))[::2])) <= 2 * np.log2(1000)
    passage, rest = made.integers(3, 50_000, 50), made.integers(3, 50_000, (200, 7))
    rules, lengths, symbols = repair.compress(np.concatenate([np.r_[passage, r] for r in rest]).astype(np.uint16))
    assert max(lengths) >= 50 and len(symbols) <= 200 * 8
    for ids in (np.full(1001, 7), passage[[0, 1, 2, 9, 0, 1, 2]], np.tile(np.r_[5, 6, 7, repair.END], 300), made.integers(0, 12, 3000), made.zipf(1.3, 3000) % 500):
        rules, _, symbols = repair.compress(ids.astype(np.uint16))
        assert (repair.expand(symbols, rules) == ids).all()
        assert not pairs_twice(symbols, rules) and len({tuple(r) for r in rules.tolist()}) == len(rules)
        assert not any((repair.expand(np.array([x]), rules) == repair.END).any() for x in rules[:, 0])


def test_files_hold_all_documents_in_order(spark, odd_documents, no_documents, folder, monkeypatch):
    got = repair.token_files(odd_documents, BYTES, f"{folder}/ids").collect()
    rows = sorted(((r.doc_id, r.text) for r in odd_documents.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [x + [repair.END] for x in library_ids([t for _, t in rows])]
    assert sorted(r.n_tokens for r in got) == sorted(map(len, ids))
    want = {}
    at = 0
    for (doc_id, _), x in zip(rows, ids, strict=True):
        want.setdefault(doc_id, set()).add((at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert all((r.start, r.n_tokens, r.ids_crc32) in want[r.doc_id] for r in got if r.doc_id is not None)
    assert sorted(r.start for r in got)[0] == 0
    assert repair.token_files(no_documents, BYTES, f"{folder}/none").count() == 0
