import random

#: Names that operators use inside, as further columns of the input.
CLASH = ["fp", "k1", "k2", "words", "id", "gone", "gone_id", "h", "g", "p", "anchor", "family", "key", "n", "hi", "lo",
         "line", "mark", "at", "kept", "band", "size", "bin", "x", "label", "score", "text_", "i", "r", "t"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows, clash=False):
    """Rows (doc_id, text[, lang[, source]]) as a documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None)
            for r in rows]
    if clash:
        return spark.createDataFrame([(*r, *range(len(CLASH))) for r in full],
                                     DOCS + "".join(f", {c} int" for c in CLASH))
    return spark.createDataFrame(full, DOCS)


def prose(seed, words=120, vocabulary=4000):
    """Made-up sentences in lines."""
    rng = random.Random(seed)
    out = []
    for i in range(words):
        w = "w" + "".join(rng.choice("abcdefghij") for _ in range(5))
        out.append(w.capitalize() if i % 9 == 0 else w + ("." if i % 9 == 8 else ""))
        if i % 27 == 26:
            out.append("\n")
    return " ".join(out).replace(" \n ", "\n").strip()
