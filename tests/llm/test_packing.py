"""Packing against whole-text tokenisation: an exact round trip."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillmill.llm import packing, prefix
from tests.llm.helpers import documents, frame, prose

FILE = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(FILE)


def ids_of(binary):
    return np.frombuffer(bytes(binary), "<u4").tolist()


def odd_texts():
    r = random.Random(3)
    pieces = ["word", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", " ", "\x1c", "\x0b", "\x85", "'s", "'ll ", "12", "é", "漢字", "😀", ".", "...", "<|endoftext|>", " <|endoftext|> ", "<|end", "A", "'", "​", "ß "]
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, 60))) for _ in range(600)]


def test_ranks_give_the_ids_of_the_tokenizer():
    texts = odd_texts() + ["", "x" * 5000, "漢" * 3000, prose(4, 3000)]
    encoder = packing.Encoder(packing.Settings(FILE))
    assert encoder.ranks is not None
    for text, ids in zip(texts, encoder.ids(texts)):
        assert ids.tolist() == WHOLE.encode(text, add_special_tokens=False).ids, text


def test_long_runs_have_the_ids_of_the_tokenizer():
    texts = [" " * 1_200_000 + "a", "\n" * 1_200_000, "x" * 1_000_000, "." * 500_000, "漢字" * 200_000, "ab \n\t" * 100_000]
    for text, ids in zip(texts, packing.Encoder(packing.Settings(FILE)).ids(texts)):
        assert ids.tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_ranks_give_the_ids_of_whole_tables():
    import duckdb

    texts = [r[0] or "" for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    for ids, want in zip(packing.Encoder(packing.Settings(FILE)).ids(texts), WHOLE.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == want.ids


def test_other_tokenizers_run_by_themselves():
    s = packing.Settings(public_tokenizers.path("word_bpe_49k.json"))
    encoder, other = packing.Encoder(s), Tokenizer.from_file(s.tokenizer)
    assert encoder.ranks is None
    texts = ["one two  Three", "", "naïve x\ny"]
    assert [x.tolist() for x in encoder.ids(texts)] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def check(found, rows, s):
    """found: pieces; rows: (doc_id, text), a document's ids in exactly one row of pieces."""
    want = defaultdict(list)
    for doc_id, text in rows:
        want[doc_id].append([*WHOLE.encode(text or "", add_special_tokens=False).ids, s.end_id])
    slots, parts = {}, defaultdict(list)
    for r in found:
        ids = ids_of(r["ids"])
        assert len(ids) == r["length"] >= 1 and r["offset"] + r["length"] <= s.length
        for k, x in enumerate(ids):
            place = r["sequence_id"] * s.length + r["offset"] + k
            assert place not in slots
            slots[place] = x
        parts[r["doc_id"]].append((r["sequence_id"] * s.length + r["offset"], r["start"], r["doc_tokens"], ids))
    total = sum(len(x) for v in want.values() for x in v)
    assert sorted(slots) == list(range(total))  # no gap: padding in the last sequence only
    for doc_id, documents_ in want.items():
        got, left = [], sorted(parts[doc_id])
        while left:
            _, start, size, ids = left.pop(0)
            assert start == 0
            while len(ids) < size:
                _, start, more, next_ids = left.pop(0)
                assert start == len(ids) and more == size
                ids = ids + next_ids
            got.append(ids)
        assert sorted(got) == sorted(documents_)
    return slots


@pytest.mark.parametrize(("length", "segment"), [(2048, 32_768), (64, 100), (7, 5)])
def test_packing(spark, length, segment):
    rows = documents() + [(500 + k, t, "o") for k, t in enumerate(odd_texts()[:40])]
    s = packing.Settings(FILE, length=length, segment=segment)
    found = packing.pack(frame(spark, rows), s).collect()
    slots = check(found, [r[:2] for r in rows], s)
    assert len(slots) == sum(r["length"] for r in found)


def test_whole_sequences(spark):
    s = packing.Settings(FILE, length=64, segment=1000)
    rows = documents()
    got = {r["sequence_id"]: ids_of(r["ids"]) for r in packing.sequences(frame(spark, rows), s).collect()}
    assert sorted(got) == list(range(len(got))) and all(len(got[k]) == 64 for k in range(len(got) - 1))
    stream = [x for k in sorted(got) for x in got[k]]
    want = sorted([*WHOLE.encode(t or "", add_special_tokens=False).ids, 1] for _, t, _ in rows)
    docs, at = [], 0
    for k, x in enumerate(stream):
        if x == 1 and any(stream[at : k + 1] == w for w in want):
            docs.append(stream[at : k + 1])
            at = k + 1
    assert at == len(stream) and sorted(docs) == want


def test_empty_tables(spark):
    s = packing.Settings(FILE)
    assert packing.pack(frame(spark, []), s).count() == 0 and packing.sequences(frame(spark, []), s).count() == 0


def test_sums_before_and_places(spark):
    from pyspark.sql import functions as F

    r = random.Random(5)
    totals = [(k, r.randint(0, 9)) for k in r.sample(range(5000), 3000)]
    got = {x["part"]: x["base"] for x in prefix.before(spark.createDataFrame(totals, "part long, n long")).collect()}
    want, run = {}, 0
    for k, n in sorted(totals):
        want[k], run = run, run + n
    assert got == want
    values = [(r.randint(0, 50), k) for k in range(2000)]
    rows = spark.createDataFrame(values, "x long, k long").repartition(5)
    placed = prefix.numbered(rows, [F.desc("x"), F.asc("k")], "n").collect()
    assert [(x["x"], x["k"]) for x in sorted(placed, key=lambda x: x["n"])] == sorted(values, key=lambda v: (-v[0], v[1]))
    assert sorted(x["n"] for x in placed) == list(range(1, 2001))
