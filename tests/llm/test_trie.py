import hashlib
import random
import zlib

import pytest

from folio.llm import trie
from folio.llm.queries import QUERIES, rebuilt
from folio.session import cut_lineage

TURNS = "conv_id bigint, turn bigint, role string, text string"


def table(spark, rows, clash=False):
    if clash:
        return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], TURNS + ", depth int, p1 int, pos int, n int")
    return spark.createDataFrame(rows, TURNS)


def sequences(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(s)] for c, s in out.items()}


def rebuild(seqs):
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = c % 5 if c >= 0 else -(-c % 5)
        out[c] = seqs.get(c - rest, [])[:h] + own[h:]
    return out


def brute(seqs):
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), from all prefixes."""
    members, ends = {}, {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
        ends.setdefault(tuple(s), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        todo, found = [p], []
        while todo:
            found.append(todo.pop())
            todo += kids.get(found[-1], [])
        return found

    out = []
    for p, who in members.items():
        sub = below(p)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in sub if q)
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(kids.get(p, [])),
                    sum(q not in kids for q in sub), saved, hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def made(seed, convs, turns, kinds):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        n = rng.randint(1, turns)
        rows += [(c * 3 - 20, i if rng.random() < 0.9 else None, rng.choice(["user", None]), rng.choice(["", "é", "text " * 3, None, "b"][:kinds]))
                 for i in range(n)]
    return rows


@pytest.mark.parametrize("seed,convs,turns,kinds,segment,container", [
    (1, 40, 6, 2, 64, 20_000), (2, 60, 9, 2, 2, 4), (3, 60, 14, 1, 3, 3), (4, 80, 5, 5, 4, 8), (5, 30, 20, 2, 5, 12)])
def test_against_brute_force(spark, seed, convs, turns, kinds, segment, container):
    rows = made(seed, convs, turns, kinds)
    random.Random(seed).shuffle(rows)
    got = trie.conversation_trie(table(spark, rows, clash=True), segment=segment, container=container)
    assert result(got) == brute(sequences(rows))


def test_deep_conversations_and_copies(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(12) for t in range(150 + (c == 7))]
    rows += [(100, t, "user", f"turn {t}" if t < 130 else "other") for t in range(140)]
    rows += [(200 + c, 0, "system", "hello") for c in range(500)]
    got = trie.conversation_trie(table(spark, rows), segment=16, container=64)
    assert result(got) == brute(sequences(rows))


def test_odd_rows(spark):
    rows = [(None, 1, "user", "no conversation"), (1, None, None, None), (1, None, None, None), (1, 2, "", ""), (2, None, "", ""),
            (3, 5, "user", "x" * 300_000), (4, 5, "user", "x" * 300_000), (5, 1, "a", "bc"), (6, 1, "ab", "c"), (-7, 1, "a", "bc"),
            (9_000_000_000, 1, "a", "bc"), (70_000, 1, "a", "bc"), (5, 1, "a", "b"), (5, 1, "a", "bc")]
    assert result(trie.conversation_trie(table(spark, rows, clash=True))) == brute(sequences(rows))


def test_empty_tables_and_turnless_conversations(spark):
    empty = table(spark, [], clash=True)
    assert result(trie.conversation_trie(empty)) == []
    rows = cut_lineage(trie.numbered(table(spark, [(1, 0, "u", "ab"), (2, 0, "u", "ab")])))
    members = spark.createDataFrame([(1,), (2,), (3,)], "conv_id bigint")
    want = brute({1: [("u", "ab")], 2: [("u", "ab")], 3: []})
    assert result(trie.prefix_trie(rows, members)) == want
    assert result(trie.prefix_trie(rows.where("pos < 0"), members)) == brute({1: [], 2: [], 3: []})


def test_rebuilt(spark):
    rows = made(9, 50, 12, 3) + [(1001, 0, "u", "own"), (5, None, None, None)]
    got, members = rebuilt(cut_lineage(trie.numbered(table(spark, rows))))
    assert result(trie.prefix_trie(got, members, segment=4, container=10)) == brute(rebuild(sequences(rows)))


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op11_prefix_trie"](spark, sf)) == brute(rebuild(sequences(rows)))
