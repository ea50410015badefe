"""n-grams against slices, FTRL against a plain loop, accuracy and calibration on held-out documents."""

import math
from collections import Counter
from dataclasses import replace

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import langid, registry

P = langid.Params()


def plain(text):
    out = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    return f" {' '.join(out.split())} " if out.split() else ""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab Éß\n1.İ日\U00020000_"), max_size=40)), max_size=6), st.sampled_from([3, 7, 250_000]))
def test_grams(texts, stretch):
    p = replace(P, stretch=stretch)
    code = lambda g: next(f for f, at in reversed(list(langid.hashed(np.array([ord(c) for c in g], np.uint32), p))) if True)[0]
    got = Counter()
    for feature, text in langid.grams(texts, p):
        got.update(zip(text.tolist(), feature.tolist(), strict=True))
    want = Counter()
    for i, t in enumerate(texts):
        s = plain(t or "")
        want.update((i, code(s[a : a + n])) for n in range(1, p.orders + 1) for a in range(len(s) - n + 1) if s[a : a + n] != " ")
    assert got == want


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(1)
    p = langid.Params(alpha=0.3, l1=0.4, l2=0.2)
    f = langid.Ftrl(12, 3, p)
    z, n = [[0.0] * 3 for _ in range(12)], [[0.0] * 3 for _ in range(12)]

    def weight(i, k):
        if abs(z[i][k]) <= p.l1:
            return 0.0
        return -(z[i][k] - math.copysign(p.l1, z[i][k])) / ((p.beta + math.sqrt(n[i][k])) / p.alpha + p.l2)

    for _ in range(200):
        at = np.sort(rng.choice(12, 4, replace=False))
        x, y = rng.random(4), int(at[0] % 3)
        f.learn(at, x, y)
        w = {(i, k): weight(i, k) for i in at for k in range(3)}
        dot = [sum(v * w[i, k] for i, v in zip(at, x, strict=True)) for k in range(3)]
        e = [math.exp(d) for d in dot]
        for i, v in zip(at, x, strict=True):
            for k in range(3):
                g = v * (e[k] / sum(e) - (k == y))
                z[i][k] += g - (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / p.alpha * w[i, k]
                n[i][k] += g * g
    assert np.allclose(f.weights(slice(None)), [[weight(i, k) for k in range(3)] for i in range(12)])


def test_temperature_finds_the_scale():
    rng = np.random.default_rng(2)
    z = rng.standard_normal((20_000, 4)) * 2
    label = np.array([rng.choice(4, p=s) for s in langid.softmax(z)])
    assert abs(langid.temperature(3 * z, label) - 3) < 0.15
    assert langid.temperature(z[:0], label[:0]) == 1.0


def test_odd_rows(spark, odd_docs):
    model = langid.fit(odd_docs)
    out = langid.predict(odd_docs, model).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        letter = any(c.isalpha() for c in r["text"] or "")
        assert r["lang_pred"] == ("en" if letter else "und") and 0 <= r["score"] <= 1 and (letter or r["score"] == 0)
    none = langid.fit(odd_docs.limit(0))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(odd_docs, none).collect()} == {("und", 0.0)}
    assert langid.predict(odd_docs.limit(0), model).count() == 0


def test_a_text_is_read_whole(spark):
    """A text's language is that of most of it, wherever that stands; stretches change nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    en, de = (next(r["text"] for r in docs.filter(f"lang = '{k}' AND n_chars > 1500").orderBy("doc_id").collect()) for k in ("en", "de"))
    assert model.predict([en * 2 + de * 30, de * 2 + en * 30, en])[0] == ["de", "en", "en"]
    short = replace(model, params=replace(P, stretch=777))
    assert np.allclose(model.logits([en * 2 + de * 30, None, de])[0], short.logits([en * 2 + de * 30, None, de])[0])


def test_held_out_accuracy_calibration_and_sparsity(spark, monkeypatch):
    fitted, fit = [], langid.fit
    monkeypatch.setattr(langid, "fit", lambda *a: fitted.append(fit(*a)) or fitted[0])
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang")
    rows = registry.op11_language_id(spark, "/root/testdata/sf0.1").join(docs, "doc_id").filter("held_out").collect()
    right = np.array([r["lang"] == r["lang_pred"] for r in rows])
    assert right.mean() > 0.995
    score = np.array([r["score"] for r in rows])
    assert abs(right.mean() - score.mean()) < 0.01
    assert (fitted[0].weights != 0).mean() < 0.5 and set(fitted[0].languages) == {"de", "en", "es", "fr"}
