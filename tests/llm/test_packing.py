import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folio.llm import packing as P
from folio.llm.tokens import Encoder
from llm_helpers import frame, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, got, capacity):
    """Every document whole and in order, cut as the rule says, sequences full from 0 without gaps."""
    want = sorted((str(d), s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()), k)
                  for d, t in rows for ids in [ids_of(t)] for k, (s, n) in enumerate(P.cuts(len(ids), capacity)))
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.piece) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("text", [
    "", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb \n c", "tab\tand space", "nbsp here", "don't we'll I'm 'quoted'",
    "x<|endoftext|>y", "12 345,678.9", "中文字 кириллица Ελληνικά", "emoji 👩‍👩‍👧 ​ zero", "\x1c\x1d odd\x85line", "  lead", "trail  ",
    "a" * 5000, "é combining", "\r\n windows \r\n"])
def test_ids_are_the_tokenizers(text):
    got = np.frombuffer(Encoder(PATH).encode([text])[0], "<u4").tolist()
    assert got == ids_of(text)[:-1]


def test_ids_of_real_texts(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    tokenizer = Tokenizer.from_file(PATH)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = Encoder(PATH)
    for _ in range(2):  # from the tokenizer, then from memory
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == want


def test_new_words_of_letters_are_not_asked_of_the_tokenizer():
    """They are merged together: the tokenizer's model is not called once a word."""
    texts = [" ".join("".join(filter(str.isalpha, w)) + "élñßя"[i % 5] * (k % 4) + "." * (k % 9 == 8)
                      for k, w in enumerate(prose(i, 60).split())) for i in range(40)]
    texts = [t.replace(". ", ".\n") for t in texts]
    encoder, asked = Encoder(PATH), []
    model = encoder.model
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    class Model:
        def tokenize(self, word):
            asked.append(word)
            return model.tokenize(word)

    encoder.model = Model()
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == want
    assert asked == [] and len({w for t in texts for w in t.split()}) > 500


@pytest.mark.parametrize("remembered", [50, 250_000])
def test_ids_of_odd_words_together(monkeypatch, remembered):
    """Words with marks, line ends, digits and many scripts, in one call and with little remembered."""
    monkeypatch.setattr("folio.llm.tokens.CACHE_WORDS", remembered)
    rng = random.Random(3)
    parts = ["a", "thing", "ing", "é", "ß", "中", "я", "'", "'s", "n't", "...", ",", "!", "#", "1", "23", "²", "½", "_", "(", "x" * 40,
             "😀", "①", "\t", *[" "] * 5, "\n", "\n\n", "\n\n\n", "  ", " \n", "\n "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += [t.replace("\t", "").replace("\n ", "\n").replace(" \n", "\n").replace("  ", " ").strip(" ") for t in texts]
    encoder = Encoder(PATH)
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for at in range(0, len(texts), 100):
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts[at:at + 100])]
        assert got == want[at:at + 100]
    assert encoder.encode([]) == []


def test_cuts():
    assert P.cuts(5, 10) == [(0, 5)] and P.cuts(10, 10) == [(0, 10)]
    assert P.cuts(25, 10) == [(0, 5), (5, 10), (15, 10)] and P.cuts(30, 10) == [(0, 10), (10, 10), (20, 10)]


def test_documents(spark):
    rng = random.Random(2)
    rows = [(i, prose(i, rng.choice([3, 30, 100, 200, 400]))) for i in range(60)]
    check(rows, P.pack(frame(spark, rows), PATH, capacity=256).collect(), 256)


def test_odd_rows(spark, odd, empty):
    df, rows = odd
    got = P.pack(df, PATH, with_ids=True).collect()
    check([(r[0], r[1]) for r in rows], got, 1024)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert P.pack(empty, PATH).collect() == []


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            g = min(fit)
            gaps.remove(g)
            gaps.append(g - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


@pytest.mark.parametrize("rows_a_task", [50, 200_000])
@pytest.mark.parametrize("name", ["even", "small", "thirds", "one_size", "large"])
def test_few_sequences(spark, monkeypatch, name, rows_a_task):
    """About as few as best fit decreasing, one piece after the other, needs - in one range partition and in many."""
    rng = random.Random(7)
    sizes = {"even": [rng.randrange(1, 1024) for _ in range(1500)], "small": [rng.randrange(1, 120) for _ in range(1500)],
             "thirds": [rng.randrange(320, 420) for _ in range(900)], "one_size": [300] * 900 + [100] * 400,
             "large": [rng.randrange(500, 1024) for _ in range(800)]}[name]
    monkeypatch.setattr(P, "ROWS_A_TASK", rows_a_task)
    placed = P.place(spark.createDataFrame(list(enumerate(sizes)), "id bigint, size bigint")).collect()
    assert sorted((r.id, r.size) for r in placed) == list(enumerate(sizes))
    used = defaultdict(int)
    for r in placed:
        used[r.bin] += r.size
    assert max(used.values()) <= 1024
    assert len(used) <= 1.03 * best_fit_decreasing(sizes, 1024) + 2


def test_texts_with_nul():
    """NUL marks keys of the word cache: 'foo' at the start of a text is remembered first."""
    texts = ["foo bar", "a \0foo", "a \0", "\0", "\0foo bar", "x \0\0foo\n \0 bar \0", "foo\0 bar"]
    tokenizer = Tokenizer.from_file(PATH)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = Encoder(PATH)
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == want


@pytest.mark.parametrize("size,n,want", [(512, 500, 250), (300, 1000, 334), (300, 1200, 400)])
def test_pieces_of_one_size_share_sequences(spark, size, n, want):
    placed = P.place(spark.createDataFrame([(i, size) for i in range(n)], "id bigint, size bigint")).collect()
    assert len({r.bin for r in placed}) <= want + 1 and len(placed) == n
