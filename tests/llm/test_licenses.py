import random
import re

from pyspark.sql import functions as F

from folio.llm import licenses as L
from folio.llm.decontam import words_of
from folio.llm.queries import QUERIES
from llm_helpers import frame, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [tuple(w[i:i + 3]) for i in range(max(len(w) - 2, min(len(w), 1)))]


def brute(text, notices, min_share=.8):
    """Licenses with a notice of which some place of the text has the share of shingles asked for."""
    s, found = shingles(text), set()
    for name, notice in notices:
        own = set(shingles(notice))
        n = len(shingles(notice))
        for p in range(0, max(len(s) - 6 + 3, 0) + 1, 4):
            near = s[max(p - n, 0):p + 6 + n]
            if own & set(s[p:p + 6]) and len(own & set(near)) >= min_share * len(own):
                found.add(name)
    return sorted(found)


def names(spark, rows, notices=L.NOTICES):
    table = spark.createDataFrame(notices, "license string, notice string")
    return {r.doc_id: r.licenses for r in L.scan(frame(spark, rows), table).collect()}


def test_notices_anywhere_are_found(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(300):
        w = prose(i, 60).split(" ")
        name, notice = rng.choice(L.NOTICES)
        w.insert(rng.randrange(len(w)), notice.upper() if i % 3 == 0 else notice)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(i, 80)) for i in range(50)]
    want = {i: brute(t, L.NOTICES) for i, t in rows}
    assert names(spark, rows) == want
    assert all(want[i] for i in range(300)) and not any(want[1000 + i] for i in range(50))


def test_changed_words_and_parts(spark):
    apache = L.NOTICES[2][1].split(" ")
    one = [*apache[:10], "CHANGED", *apache[11:]]
    half = apache[:len(apache) // 2]
    rows = [(1, " ".join(one)), (2, " ".join(half)), (3, "Licensed under the"), (4, "Released under the MIT License")]
    assert names(spark, rows) == {i: brute(t, L.NOTICES) for i, t in rows} == {1: ["Apache-2.0"], 2: [], 3: [], 4: ["MIT"]}


def test_odd_rows(spark, odd, empty):
    df, rows = odd
    table = spark.createDataFrame([("a", prose(1)[:80]), ("b", None), (None, "one"), ("c", "кириллица 中文 words"), ("d", "")],
                                  "license string, notice string")
    got = sorted((str(r.doc_id), r.licenses) for r in L.scan(df, table).collect())
    hit = {i for i, r in enumerate(rows) if r[1] == prose(1)}
    want = sorted((str(r[0]), ["a"] if i in hit else ["c"] if r[0] == 8 else []) for i, r in enumerate(rows))
    assert got == want
    assert L.scan(empty, table).collect() == []
    assert all(not r.licenses for r in L.scan(df, table.where("false")).collect())


def test_no_python_in_the_plan(spark):
    table = spark.createDataFrame(L.NOTICES, "license string, notice string")
    plan = L.scan(frame(spark, [(1, "x")]), table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_near_notices_are_told_apart(spark):
    """Each notice within a text gives its own license alone; both notices give both."""
    notices = L.TEMPLATES
    rows = [(i, prose(i, 40) + " " + notice + " " + prose(900 + i, 40)) for i, (_, notice) in enumerate(notices)]
    two, three = (next(t for n, t in notices if n == x) for x in ("GPL-2.0", "GPL-3.0"))
    rows += [(100, two + " " + prose(5, 60) + " " + three), (101, "Released " + three[10:]), (102, three.replace("3", "9"))]
    table = spark.createDataFrame(notices, "license string, notice string")
    got = {r.doc_id: r.licenses for r in L.scan(frame(spark, rows), table, apart=True).collect()}
    assert {i: got[i] for i in range(len(notices))} == {i: [name] for i, (name, _) in enumerate(notices)}
    assert got[100] == ["GPL-2.0", "GPL-3.0"] and got[101] == ["GPL-3.0"] and got[102] == []


def test_a_notice_in_every_version_is_itself_alone_in_the_query(spark, tmp_path):
    rows = [(i, prose(i, 30) + " " + notice) for i, (_, notice) in enumerate(L.TEMPLATES)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.licenses for r in QUERIES["op4_licenses"](spark, str(tmp_path)).collect()}
    assert got == {i: name for i, (name, _) in enumerate(L.TEMPLATES)}


def test_templates_in_blocks(spark, monkeypatch):
    rows = [(i, prose(i, 30) + " " + notice) for i, (_, notice) in enumerate(L.TEMPLATES)]
    table = spark.createDataFrame(L.TEMPLATES, "license string, notice string")
    monkeypatch.setattr(L, "MAX_BAND_ROWS", 4000)
    got = {r.doc_id: r.licenses for r in L.scan(frame(spark, rows), table, apart=True).collect()}
    assert got == {i: [name] for i, (name, _) in enumerate(L.TEMPLATES)}


def test_windows_are_made_only_round_shingles_of_notices(spark):
    """A text without any gives a row a shingle, and none a window and band."""
    rows = [(i, prose(i, 300)) for i in range(40)]
    table = spark.createDataFrame(L.NOTICES[:2], "license string, notice string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = L.matches(frame(spark, rows), table)
        assert found.collect() == []
        todo, made = [found._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName().startswith("Generate"):
                made += node.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < made <= sum(len(shingles(t)) for _, t in rows) + 40 * (L.BANDS + 1)


def test_windows_meet_as_their_least_hashes_do(spark):
    """The same windows and notices as by comparing every window's MinHash in every band."""
    rows = [(i, " ".join([prose(i, i), n[:len(n) * (i % 4 + 1) // 4], prose(50 + i, 9), *n.split(" ")[i % 7:]]))
            for i, (_, n) in enumerate(L.TEMPLATES)] + [(90, "one"), (91, "Licensed under"), (92, "")]
    cut = [df.withColumn("shingles", L._shingles("words")) for df in (
        spark.createDataFrame(rows, "k1 int, text string").select("k1", F.lit(0).alias("k2"), words_of(F.col("text")).alias("words")),
        spark.createDataFrame([*L.TEMPLATES, ("c", "one")], "license string, notice string").select("license", words_of(F.col("notice")).alias("words")))]

    def windows(df, stride):
        last = F.greatest(F.size("shingles") - 6 + stride - 1, F.lit(0))
        df = df.withColumn("p", F.explode(F.sequence(F.lit(0), last, F.lit(stride)))).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(16))))
        return df.withColumn("least", F.array_min(F.transform(F.slice("shingles", F.col("p") + 1, 6), lambda s: F.xxhash64(s, "b")))) \
            .where("least is not null")

    want = windows(cut[0], 4).join(windows(cut[1], 1).select("license", "b", "least").distinct(), ["b", "least"])
    got = L._met(cut[0].drop("words"), L._chosen(cut[1], 16).select("shingle", "b", "license").distinct())
    key = ["k1", "p", "b", "license"]
    want, got = ({tuple(r) for r in df.select(*key).collect()} for df in (want, got))
    assert got == want and len(want) > 1000
