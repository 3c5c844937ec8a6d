import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from waymark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    r = random.Random(3)
    spaces = ["\x1c", "\x1d", "\x1f", "\x85", " ", " ", "​", "﻿", "᠎", "\t", "\n", "\r\n", " ", "  ", "   ", "　", "\x00"]
    parts = ["a", "I'll", "can't", "'S", "日本語", "é", "²", "Ⅷ", "١٢", "🙂", "👩‍👩‍👧", "<|endoftext|>", "<|endoftext", "_", "--", "ab12", "ß", "ͅ", "ǅ", *spaces]
    out = ["", " ", "\n\n", "<|endoftext|>", " <|endoftext|> x", "a" * 3000, "ab" * 700 + " " * 900, "x" * 257, "é" * 300, "don't  stop"]
    return out + ["".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(3000)]


def test_agrees_with_the_tokenizers_library():
    t, own = Tokenizer.from_file(PATH), bpe.ByteBpe(open(PATH, encoding="utf-8").read())
    for x in texts():
        ids = t.encode(x, add_special_tokens=False).ids
        assert own.encode(x) == ids, ascii(x)
        assert own.decode(ids) == t.decode(ids, skip_special_tokens=False), ascii(x)


def test_every_assigned_code_point():
    import unicodedata

    t, own = Tokenizer.from_file(PATH), bpe.ByteBpe(open(PATH, encoding="utf-8").read())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    wrong = []
    for i in range(0, len(points), 400):
        x = "".join(f"a{c} {c}1{c} " for c in points[i : i + 400])
        if own.encode(x) != t.encode(x, add_special_tokens=False).ids:
            wrong += [c for c in points[i : i + 400] if own.encode(f"a{c} {c}1{c} ") != t.encode(f"a{c} {c}1{c} ", add_special_tokens=False).ids]
    assert not wrong, [hex(ord(c)) for c in wrong[:50]]


def test_bytes_that_are_not_text():
    t, own = Tokenizer.from_file(PATH), bpe.ByteBpe(open(PATH, encoding="utf-8").read())
    r = random.Random(5)
    for _ in range(500):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 12))]
        assert own.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_query_on_nulls_repeats_and_empty_tables(spark, docs_of):
    rows = bpe.digest(docs_of([(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b")]), PATH).collect()
    empty = hashlib.sha256(b"").hexdigest()
    got = sorted(((r.doc_id or 0), r.n_tokens, r.decoded_sha256) for r in rows)
    same = hashlib.sha256(b"a b").hexdigest()
    assert got == [(0, 2, same), (1, 0, empty), (2, 0, empty), (3, 2, same), (3, 2, same)]
    assert bpe.digest(docs_of([]), PATH).count() == 0
    back = bpe.decode(bpe.encode(docs_of([(1, "Hello <|endoftext|> wörld"), (2, None)]), PATH), PATH)
    assert {r["doc_id"]: r["__decoded"] for r in back.collect()} == {1: "Hello <|endoftext|> wörld", 2: ""}
