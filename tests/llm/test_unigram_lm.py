import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from waymark.llm import unigram_lm as U
from waymark.llm.queries import op10_unigram_lm

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(s, pieces):
    if not s:
        yield 0.0
    for p, w in pieces.items():
        if s.startswith(p):
            for rest in segmentations(s[len(p) :], pieces):
                yield w + rest


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab"]
    weights = [math.log(x) for x in (0.2, 0.1, 0.15, 0.05, 0.2, 0.1, 0.1, 0.1)]
    t = U.Lattice(pieces, weights)
    for word in ("a", "ab", "ababa", "bbaab"):
        every = [*segmentations("▁" + word, dict(zip(pieces, weights, strict=True)))]
        assert math.isclose(t.log_probabilities(["b", word, "abab"])[1], math.log(sum(map(math.exp, every))), rel_tol=1e-12)


def plain_weights():
    """The stated rule, written anew: 1 / (10 - score) for pieces, the least of them for bytes."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    own = {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i))}
    least = min(own.values())
    raw = {p: 1 / (10 - (least if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else x)) for p, x in own.items()}
    return {p: x / sum(raw.values()) for p, x in raw.items()}


def plain(word, weights):
    """log10 of the sum over all segmentations of a word, by a recursion over its letters in plain probabilities."""
    s, whole = "▁" + word, [1.0]
    for j in range(1, len(s) + 1):
        total = sum(whole[i] * weights.get(s[i:j], 0.0) for i in range(max(0, j - 20), j))
        total += whole[j - 1] * math.prod(weights[f"<0x{b:02X}>"] for b in s[j - 1].encode())
        whole.append(total)
    return math.log10(whole[-1])


def test_weights_are_those_of_the_file():
    pieces, logs = U.vocabulary(PATH)
    want = plain_weights()
    assert all(math.isclose(math.exp(x), want[p], rel_tol=1e-9) for p, x in zip(pieces, logs, strict=True)) and len(want) == len(pieces)


def test_unknown_letters_and_long_words():
    t = U.Lattice(*U.vocabulary(PATH))
    for word in ("\U0001f9ff", "\x00", "x" * 20_000):
        p = t.log_probabilities(["a", word])[1]
        assert math.isfinite(p) and p < 0
    text = "".join("the cat é\U0001f9ffsatonx"[i * i % 15] for i in range(3 * U._LONG + 5)).replace(" ", "_")
    for n in (1, 30, U._LONG - 1, U._LONG, U._LONG + 1, 2 * U._LONG - 1, 2 * U._LONG, len(text)):
        codes = np.zeros((1, n + 1 + t.longest), np.uint32)
        codes[0, : n + 1] = np.frombuffer(("▁" + text[:n]).encode("utf-32-le"), np.uint32)
        assert math.isclose(t._long(text[:n]), t._forward(t._edges(codes, n + 1), n + 1)[0, n + 1], rel_tol=1e-9)


def rows():
    texts = ["the cat sat on the mat", "The dog sat", "", None, "unseen wordless zyx", "a b c " * 50, "the the the"]
    return [(i, texts[i % 7]) for i in range(60)] + [(None, "the cat"), (7, "the the the"), (7, "the the the")]


def test_base_score_equals_brute_force(spark, folder):
    train, own = Counter(), []
    for d, t in rows():
        w = [x.decode() for x in (t or "").encode().lower().split()]
        held = zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
        own.append((d, held, w))
        if not held:
            train.update([*w, None])
    n, v = sum(train.values()), len(train)
    want = sorted((d or -1, h, len(w) + 1, sum(train[x] > 0 for x in [*w, None]), n, round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in [*w, None]), 6)) for d, h, w in own)
    for heavy in (100_000, 3, 0):
        got = U.score(spark.read.parquet(f"{folder(rows())}/documents.parquet"), PATH, heavy=heavy).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_score_equals_a_plain_version(spark, folder):
    d = folder(rows())
    train = Counter()
    for i, t in rows():
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            train.update([*((t or "").lower().split()), None])
    share = (train[None] + 1) / (sum(train.values()) + 2)
    weights = {p: x * (1 - share) for p, x in plain_weights().items()}
    want = sorted(round(math.log10(share) + sum(plain(w, weights) for w in (t or "").lower().split()), 6) for _, t in rows())
    assert sorted(round(r.score, 6) for r in op10_unigram_lm(spark, d).collect()) == want


def test_score_is_a_product_over_words(spark, docs_of):
    got = {r.doc_id: r.score for r in U.score(docs_of([(1, "cat"), (2, "cat dog"), (3, "dog"), (4, None)]), PATH).collect()}
    assert got[2] - got[4] == pytest.approx((got[1] - got[4]) + (got[3] - got[4]))
    assert U.score(docs_of([]), PATH).count() == 0


def test_words_too_long_to_broadcast_and_clashing_names(docs_of):
    long = "ab" * 5000
    d = docs_of([(i, f"{long} cat") for i in range(3)] + [(9, "x" * 100_000)])
    for c in ("rid", "word", "held", "head", "c", "lattice", "n_tokens", "copies"):
        d = d.withColumn(c, d.doc_id)
    got = U.score(d, PATH).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(0, 3), (1, 3), (2, 3), (9, 2)] and all(math.isfinite(r.score) for r in got)


def divided(s, pieces):
    """(log weight, pieces) of each segmentation."""
    if not s:
        yield 0.0, []
    for p, w in pieces.items():
        if s.startswith(p):
            for rest, own in divided(s[len(p) :], pieces):
                yield w + rest, [p, *own]


def test_expected_pieces_equal_all_segmentations(monkeypatch):
    pieces = {p: math.log(x) for p, x in zip(["▁", "a", "b", "ab", "ba", "aba", "▁a", "<0x61>"], (0.2, 0.1, 0.15, 0.05, 0.2, 0.1, 0.15, 0.05), strict=True)}
    words, want = {"a": 3, "ab": 1, "ababa": 5, "bbaab": 2}, Counter()
    for word, c in words.items():
        # The byte is another way to write an a.
        full = []
        for w, own in divided("▁" + word, {p: w for p, w in pieces.items() if p != "<0x61>"}):
            for n in range(own.count("a") + 1):
                full.append((w + n * (pieces["<0x61>"] - pieces["a"]) + math.log(math.comb(own.count("a"), n)), own, n))
        whole = sum(math.exp(w) for w, _, _ in full)
        for w, own, n in full:
            p = c * math.exp(w) / whole
            for x in own:
                want[x] += p
            want["a"] -= n * p
            want["<0x61>"] += n * p
    t = U.Lattice([*pieces], [*pieces.values()])
    for long in (U._LONG, 3):
        monkeypatch.setattr(U, "_LONG", long)
        got = dict(zip(pieces, t.expected([*words], [*words.values()]), strict=True))
        assert all(math.isclose(got[p], want[p], rel_tol=1e-9, abs_tol=1e-12) for p in pieces)


def test_held_out_texts_are_no_worse_than_learnt_words_allow(spark):
    """With the file's weights alone their scores were 2.1 times base_score."""
    got = op10_unigram_lm(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert got and all(math.isfinite(r.score) for r in got)
    assert sum(r.score for r in got) > 1.5 * sum(r.base_score for r in got)
