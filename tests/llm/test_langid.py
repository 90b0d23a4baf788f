"""Operator 3 against a plain Python version, and on held-out documents."""

import zlib
from collections import Counter

from conftest import SF_SMALL
from tessera.llm import langid as L


def grams(text):
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    out = Counter()
    for w in low.split():
        p = f" {w} "
        for n in (1, 2, 3):
            out.update(g for g in (p[i:i + n] for i in range(len(p) - n + 1)) if g.strip())
    return out


def ranked(count, top=300):
    pad = lambda g: (len(g), [0 if c == " " else ord(c) for c in g])
    return sorted(count, key=lambda g: (-count[g], pad(g)))[:top]


def test_query_equals_plain_version(sp):
    docs = [tuple(r) for r in sp.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]
    held = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d, _, _ in docs}
    total = {}
    for d, t, lang in docs:
        if not held[d] and lang:
            total.setdefault(lang, Counter()).update(grams(t))
    profile = {lang: {g: i for i, g in enumerate(ranked(total[lang]))} for lang in sorted(total)}
    got = {r.doc_id: r for r in L.query(sp, SF_SMALL).collect()}
    assert len(got) == len(docs)
    for d, t, _ in docs:
        own = ranked(grams(t))
        far = {lang: sum(abs(p[g] - i) if g in p else 300 for i, g in enumerate(own)) for lang, p in profile.items()}
        r = got[d]
        assert r.held_out == held[d]
        if own:
            best = min(far, key=far.get)
            assert r.lang_pred == best and abs(r.score - (1 - far[best] / (300 * len(own)))) < 1e-12
        else:
            assert r.lang_pred == "und" and r.score == 0
    test = [(got[d].lang_pred, lang) for d, _, lang in docs if held[d]]
    assert sum(a == b for a, b in test) >= 0.97 * len(test)


def test_odd_rows(sp, odd, none):
    got = L.language_id(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[0] == by[1] == by[2] == "und" and by[5] != "und"
    assert L.language_id(none).collect() == []
    assert {r.lang_pred for r in L.language_id(odd.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_many_alphabets(sp):
    texts = ["Ωμέγα αλφα", "日本語 テキスト", "𝔘𝔫𝔦 𝕔𝕠𝕕𝕖", "ǅ İstanbul ß", "1234 !!"]
    df = sp.createDataFrame([(k, t, f"l{k}") for k, t in enumerate(texts * 2)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.predict(df, L.profiles(df)).collect()}
    assert [got[k].lang_pred for k in range(4)] == ["l0", "l1", "l2", "l3"] and got[4].lang_pred == "und"
