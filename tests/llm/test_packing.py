"""Packing against the tokenizer itself, and what bins must hold."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from vicinal.llm import packing

DOCS = "doc_id long, text string, length string, ids string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_tokenizer())


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def odd_text(draw):
    """Words of letters, marks and combining characters whose composing, lowering or splitting may interfere."""
    pool = [chr(c) for c in [*range(33, 0x250), *range(0x300, 0x345)]] + list("\u0130\u0131WTJHYaei" * 6) + list(".,;:!?'" * 12) + [" "] * 40
    pool += ["\u00a0", "\u2028", "<|endoftext|>", "<|", "'s", "'S", "\t", "\n", "\u03a3", "\u01c4", "\ufb01", "\u4e2d", "\u093c"]
    return "".join(draw.choices(pool, k=draw.randint(1, 14)))


def test_words_have_the_tokenizers_ids(tokenizer):
    draw = random.Random(7)
    texts = [odd_text(draw) for _ in range(20_000)] + ["TRT\u0130.", "AL\u0130,", "W\u030a x", "T\u0308,", "J\u030c", "H\u0331!", "Y\u030a"]
    wrong = [t for t in texts if packing.text_ids(t.encode(), packing.default_tokenizer()) != np.array(ids(tokenizer, t), "<u4").tobytes()]
    assert not wrong, wrong[:5]


def test_pieces_and_sequences(spark, tokenizer):
    draw = random.Random(2)
    texts = [None, "", " \n", "one", "one", "same words here", "same words here", "z" * 30_000] + [" ".join(odd_text(draw) for _ in range(n)) for n in (5, 40, 300, 900, 2000)] + ["word " * n for n in (2046, 2047, 2048, 4095, 4096, 9000)]
    rows = [(k, t, "x", "y") for k, t in enumerate(texts)] + [(3, "one", "x", "y"), (None, "no id", "x", "y"), (5, "another text", "x", "y")]
    got = packing.pack_with_ids(spark.createDataFrame(rows, DOCS), group_pieces=8).collect()
    want = Counter()
    for doc, text, *_ in rows:
        whole = ids(tokenizer, text)
        for k, at in enumerate(range(0, len(whole), 2048)):
            part = tuple(whole[at : at + 2048])
            want[doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    assert len({r["row"] for r in got}) == len(got)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert [a for a, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) <= packing.CAPACITY
    plain = packing.pack_documents(spark.createDataFrame(rows, DOCS))
    assert plain.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in plain.collect()) == Counter({k[:5]: n for k, n in want.items()})


def test_best_two_fit_replaces_the_smallest():
    bins = packing.best_two_fit([60, 30, 21, 19], 100)
    assert sorted(map(sorted, bins)) == [[0, 2, 3], [1]]


def test_ties_are_taken_in_order_and_few_bins_are_left():
    assert packing.best_two_fit([50] * 4, 100) == packing.best_two_fit([50] * 4, 100) == [[0, 1], [2, 3]]
    draw = np.random.default_rng(1)
    lengths = draw.integers(1, 900, 5000).tolist()
    bins = packing.best_two_fit(lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(5000))
    assert len(bins) <= -(-sum(lengths) // 2048) + 1


def test_nothing_to_pack(spark):
    none = spark.createDataFrame([], DOCS)
    assert packing.pack_documents(none).count() == packing.pack_with_ids(none).count() == 0
