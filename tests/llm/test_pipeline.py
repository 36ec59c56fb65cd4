"""The pipeline against a brute-force version of what its stages decide, and odd tables."""

import re

import corpus_pipeline
from sondeo.llm import decontam, lang_id, pii
from sondeo.llm.queries import pii_key

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def agrees(text, item, window=20, identity=0.8):
    """Whether on some diagonal a stretch of ``window`` tokens agrees, by trying them all."""
    need = min(window, len(item))
    for d in range(-len(item) + need, len(text) - need + 1):
        a, z = max(0, d), min(len(text), d + len(item))
        same = [text[i] == item[i - d] for i in range(a, z)]
        if any(sum(same[i : i + need]) >= identity * need for i in range(len(same) - need + 1)):
            return True
    return False


def test_pipeline_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lang_id.fit(docs)
    rows = {r.doc_id: r.text for r in docs.collect() if model.predict((r.text or "").encode())[2]}
    sets, top = {d: shingles(t) for d, t in rows.items()}, {d: d for d in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                both = len(sets[a] & sets[b])
                if both and top[a] != top[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    top[a] = top[b] = min(top[a], top[b])
                    changed = True
    split = lambda t: re.sub(r"[^a-z0-9\x80-\U0010ffff]", " ", (t or "").lower()).split()
    items = [x for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(x := split(r.text)) >= 8]
    # an overlap of four fifths of a window shares a run of four tokens at least
    grams = lambda x: {tuple(x[i : i + 4]) for i in range(len(x) - 3)}
    held = [(x, grams(x)) for x in items]
    kept = set()
    for d in rows:
        t = split(rows[d])
        g = grams(t)
        if top[d] == d and not any(g & h and agrees(t, x) for x, h in held):
            kept.add(d)
    mask = pii.pseudonymise(docs.filter(docs.doc_id.isin(sorted(kept))), pii_key(spark))
    want = {r.doc_id: r.text for r in mask.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.decoded == r.text and r.piece_ids for r in got)


NAMES = "accepted score lang_pred node place _key key _hit _html html piece_ids decoded pii_email c0 c5 start _metadata".split()
ENGLISH = "the men of the house were on the way to the sea and it was not there for all of them at that time"


def odd_table(spark, texts):
    """Rows of (doc_id, text) with languages and columns that the stages use themselves."""
    rows = [(d, t, lang, *(f"{n}{i}" for n in NAMES)) for i, (d, t, lang) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in NAMES))


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def test_stages_keep_odd_columns_and_rows(spark):
    bench = " ".join(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(1).collect())
    near = " ".join(f"w{i}" for i in range(200))
    texts = [
        (1, ENGLISH, "en"), (1, ENGLISH, "en"), (2, ENGLISH, "en"), (2, "another clean text with an id that is not its own " + ENGLISH[:40], "en"), (3, bench, "en"), (3, "clean " + ENGLISH[30:], "en"),
        (None, ENGLISH, None), (None, "a text without an id, in one row", "en"), (None, "a text without an id, in two rows", "en"), (None, "a text without an id, in two rows", "en"),
        (4, near, "en"), (4, near + " end", "en"), (5, None, None), (5, None, "en"), (6, "", "en"), (6, "", "en"), (7, "mail ana@x.org now", "en"), (8, "word " * 60_000, "en"),
    ]
    odd = odd_table(spark, texts)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert out.columns[:3] == ["doc_id", "text", "lang"] and stage(spark, odd.limit(0), SF).count() == 0
        same = odd.columns if name != "sentencepiece" else [c for c in odd.columns if c not in ("piece_ids", "decoded")]
        assert out.columns == same + (["piece_ids", "decoded"] if name == "sentencepiece" else [])
        got, all_rows = key(out.select(*(f"`{c}`" for c in same)).collect()), key(odd.select(*(f"`{c}`" for c in same)).collect())
        if name == "near_dedup":
            held = sorted((str(r[0]), r[1] or "") for r in got)
            assert len(got) == len(all_rows) - 5 and set(got) <= set(all_rows)
            assert held.count(("1", ENGLISH)) == 1 and ("2", ENGLISH) not in held and ("None", ENGLISH) not in held and held.count(("None", texts[8][1])) == 1
            assert sum(d == "4" for d, _ in held) == 1 and sum(d == "5" for d, _ in held) == 2 and sum(d == "6" for d, _ in held) == 2
        elif name == "decontamination":
            assert got == [r for r in all_rows if r[1] != bench]
        elif name == "pii":
            assert [r for r in got if "@" not in (r[1] or "")] == [r for r in all_rows if "@" not in (r[1] or "")] and not any("ana@" in (r[1] or "") for r in got)
        elif name == "sentencepiece":
            assert got == all_rows and all(r.decoded == r.text for r in out.select("text", "decoded").collect())
        else:
            assert all(r in all_rows for r in got) and sum(r[1] == ENGLISH for r in got) == 4 and not any(not r[1] for r in got)


def test_token_rule():
    assert [len(x) for x in decontam.tokens([b"A-b c", b"", "ñandú x".encode()])] == [3, 0, 2]
