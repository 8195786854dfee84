"""Alignment of two tokenizers beside the libraries on whole texts, with nulls, odd white space, long texts, repeats and clashing columns."""
import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers

from recollect.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, block string, n_links string, groups string"


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(libraries, rows):
    """doc_id -> (n_a, n_b, n_groups, n_links, n_best, count_sum, sha256, groups), token by token over whole texts."""
    a, b = libraries
    signs = {c: x for c, x in zip(map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), [*range(33, 127), *range(161, 173), *range(174, 256)], strict=True)}
    sides, links = {}, {}
    for k, (_, text) in enumerate(rows):
        sides[k], links[k] = ([], [], []), []
        if not text:
            continue
        tokens_a, pieces = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
        if b"".join(bytes_b) != (" " + text).encode():
            continue
        ends_a, ends_b, at = [], [], 0
        for t in tokens_a.tokens:
            at += len(t)  # a sign of the vocabulary is a byte
            ends_a.append(at)
        assert at == len((" " + text).encode()) and (all(c in signs or ord(c) >= 256 for t in tokens_a.tokens for c in t))
        at = 0
        for p in bytes_b:
            at += len(p)
            ends_b.append(at)
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, e in zip(tokens_a.ids, ends_a) if low < e <= c) + "|" + ",".join(str(i) for i, e in zip(pieces, ends_b) if low < e <= c))
            low = c
        by_end = dict(zip(ends_b, pieces, strict=True))
        links[k] = [(i, by_end[e]) for i, e in zip(tokens_a.ids, ends_a) if e in by_end]
        sides[k] = (tokens_a.ids, pieces, groups)
    count = Counter(x for ls in links.values() for x in ls)
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = []
    for k, (i, _) in enumerate(rows):
        ids, pieces, groups = sides[k]
        text = ";".join(groups)
        out.append((i, len(ids), len(pieces), len(groups), len(links[k]), sum(count[x] == most[x[1]] for x in links[k]), sum(count[x] for x in links[k]), hashlib.sha256(text.encode()).hexdigest() if text else "", text))
    return sorted(out, key=repr)


def aligned(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], DOCS).repartition(3)
    return sorted((tuple(r) for r in alignment.align(df, A, B, with_groups=True, **more).collect()), key=repr)


def test_alignment_meets_the_libraries(spark, libraries):
    rng = random.Random(11)
    bits = ["a", "The", "word", " ", "  ", "\n", "\t", " \n ", ".", ",", "'s", "123", "é", "ß", "日本", "😀", "　", " ", " ", " ", "​", "\x1c", "\x00", "<s>", "<0x41>", "<|endoftext|>", "ﬁ", "Ｗ", "é", "؜", "unbelievable"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "  "), (1004, "word "), (1005, "word  "), (1006, "\n"), (1007, "▁"), (1008, "has ▁ inside"), (1009, "x" * 3000), (1010, "the same text here"), (1010, "the same text here"), (None, "the same"), (1011, "plain words " * 2000), (1012, "trailing\n ")]
    want = plain(libraries, rows)
    assert aligned(spark, rows) == want
    assert aligned(spark, rows, block_bytes=1 << 30) == want


def test_nothing_to_align(spark):
    assert aligned(spark, []) == []
    assert aligned(spark, [(1, None), (2, "▁")]) == [(1, 0, 0, 0, 0, 0, 0, "", ""), (2, 0, 0, 0, 0, 0, 0, "", "")]


def test_units_stand_for_themselves_only_if_no_piece_reaches_over_a_space():
    both = alignment.Tokenizers(open(A, "rb").read(), open(B, "rb").read())
    with pytest.raises(ValueError, match="give back"):
        both.units(["▁"])


def test_pair_counts_say_the_best_of_each_b(spark):
    units = spark.createDataFrame([(2, [1, 1], [5, 6]), (3, [2], [5]), (2, [3, 3], [5, 6]), (1, [3], [5])], "n long, a array<int>, b array<int>")
    got = {(r.a, r.b): (r["count"], r.best) for r in alignment.pair_counts(units).collect()}
    assert got == {(1, 5): (2, 0), (2, 5): (3, 1), (3, 5): (3, 1), (1, 6): (2, 1), (3, 6): (2, 1)}
