"""Neighbours against all pairs, pages with known articles, licences against DuckDB and planted notices."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses, mih, pages, registry
from tessera.plans import catalogue  # noqa: F401  (the library stands without this subpackage)

SF = "/root/testdata/sf0.01"


def recall(spark, rows, p=mih.Params()):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id int")
    got = {}
    for r in mih.search(df.filter("vec_id % 5 = 0"), df, p).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ids = np.array([r[0] for r in rows if r[0] is not None and r[1] is not None and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])])
    x = np.array([next(r[1] for r in rows if r[0] == i) for i in ids], np.float32).astype(float)
    hit = total = 0
    for q in ids[ids % 5 == 0]:
        v = x[ids == q][0]
        cos = x @ v / (np.linalg.norm(x, axis=1) * np.linalg.norm(v))
        best = [i for i in ids[np.lexsort((ids, -np.round(cos, 12)))] if i != q][: p.k]
        assert len(got[q]) == min(p.k, len(ids) - 1)
        assert all(abs(s - cos[ids == i][0]) < 1e-12 for i, s in got[q])
        assert [(-round(s, 12), i) for i, s in got[q]] == sorted((-round(s, 12), i) for i, s in got[q])
        hit += len({i for i, _ in got[q]} & set(best))
        total += len(best)
    assert set(got) == set(ids[ids % 5 == 0].tolist())
    return hit / total


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16)).round(3)
    x[1:40] = x[0]  # equal vectors: ties go by id
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows[50], rows[55], rows[60], rows[65], rows[70] = (50, None, 0), (55, [0.0] * 16, 0), (60, [float("nan")] + [1.0] * 15, 0), (65, [None] + [1.0] * 15, 0), (70, [1.0] * 3, 0)
    rows.append((None, [1.0] * 16, 0))
    assert recall(spark, rows) >= 0.95
    assert recall(spark, rows, mih.Params(block=64, queries=16, bucket=8, sample=200)) >= 0.9
    assert recall(spark, [(i, v.tolist(), 0) for i, v in enumerate(x[100:104])]) == 1
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert mih.search(empty, empty).count() == 0


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_on_tables(spark, sf, monkeypatch):
    fitted, fit = [], mih.fit
    monkeypatch.setattr(mih, "fit", lambda *a: fitted.append(fit(*a)) or fitted[0])
    e = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in e], float)
    asked = [r for r in e if r["vec_id"] % 50 == 0]
    hit = 0
    got = registry.op1_multi_index_hashing(spark, f"/root/testdata/sf{sf}").collect()
    for r in asked:
        cos = x @ np.array(r["embedding"], float)
        best = {e[i]["vec_id"] for i in np.argsort(-cos)[1:6]}
        hit += len(best & {g["vec_id"] for g in got if g["query_id"] == r["vec_id"]})
    assert len(got) == 5 * len(asked) and hit >= 0.9 * 5 * len(asked)
    assert 0 < fitted[0].share < 0.7  # pairs that meet in a bucket


def test_retrieval_is_whole_within_the_radius(spark):
    rng = np.random.default_rng(8)
    p = mih.Params(bits=64)
    x = rng.standard_normal((400, 16))
    x = np.concatenate([x, x[:100] + 0.3 * rng.standard_normal((100, 16))])
    model = mih.Model(mih.quantiser(x, p), 13, 20, mih.reaches(13, 5))
    rows = spark.createDataFrame([(i.to_bytes(16, "big"), v.tolist()) for i, v in enumerate(x)], "node binary, embedding array<double>")
    index = mih.coded(rows, model)
    bits = model.bits(x)
    apart = (bits[:, None, :] ^ bits[None, :50, :]).sum(axis=2)
    for bucket in (4_096, 2):  # all buckets whole, and nearly all split
        got = {(int.from_bytes(r["q"], "big"), int.from_bytes(r["node"], "big")) for r in mih.retrieved(index, index.limit(50), model, mih.Params(bits=64, bucket=bucket)).collect()}
        want = {(j, i) for i, j in zip(*np.nonzero(apart <= 13), strict=True)}
        assert want <= got and all(apart[i, j] <= 20 for j, i in got) and len(want) > 100


def test_articles(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in registry.op7_site_style_tree(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows[:40]:
        text = got[r["page_id"]]["text"]
        assert text and "<" not in text.replace("&lt;", "") and "©" not in text and "track(" not in text
        assert got[r["page_id"]]["n_chars"] == len(text)
        assert text.split("\n\n")[0][:20] in r["html"].replace("&amp;", "&")


CASES = [
    ("<p>a  &amp;\n b<br>c</p><p>d", "a & b c\n\nd"),
    ("<nav>x</nav><div class='side-bar sidebar'>x</div><div>t <b>u</b>v</div><footer>x", "t uv"),
    ("<article>in<aside>x</aside><div id=comments><p>x</div><p>more</article>out", "in\n\nmore"),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p title='a>b'>yes", "yes"),
    ("<form><p>x</p><input></form><ul><li>1<li>2</ul><table><tr><td>q<td>r</table>", "1\n\n2\n\nq\n\nr"),
    ("<p>1 < 2 &lt; 3 &#233; &unknown;", "1 < 2 < 3 é &unknown;"),
    ("<p>a<p>b</i></div></p>c", "a\n\nb\n\nc"),
    ("", ""), (None, ""), ("no markup", "no markup"),
]


def test_markup():
    for html, want in CASES:
        assert pages.main_text(html, set(), 8) == want, html
    assert pages.main_text("<div>" * 5000 + "deep", set(), 8) == "deep"
    began = time.monotonic()
    for open_, end in (("<div>", "</div>"), ("<p><div>", "</p>"), ("<b>", "</i>"), ("<ul><li>", "</li>"), ("<i><p>", "</b>")):
        deep = "<nav>menu" + open_ * 60_000 + "x" + end * 60_000 + "</nav><p>text"
        assert pages.main_text(deep, set(), 8) in ("text", "")  # in time, whatever is left open
    assert time.monotonic() - began < 60


def test_style_tree_drops_what_a_site_repeats(spark):
    site = [(i, f"http://S.example/{i}", f"<div class=top>Same words on top</div><div class=body><p>Story {i} is told here</div>", "k") for i in range(12)]
    odd = [(100, None, "<div class=top>Same words on top</div>", "k"), (101, "http://s.example/n", None, "k"), (3, "http://s.example/3", site[3][2], "k")]
    df = spark.createDataFrame([*site, *odd], "page_id long, url string, html string, text string")
    got = {(r["page_id"], r["url"]): r["text"] for r in pages.extract(df).collect()}
    assert got[5, "http://S.example/5"] == "Story 5 is told here" and got[100, None] == "Same words on top" and got[101, "http://s.example/n"] == ""
    assert pages.extract(df).count() == 15 and pages.extract(df.limit(0)).count() == 0
    shuffled = pages.extract(df, pages.Params(broadcast_rows=-1))
    assert {(r["page_id"], r["url"]): r["text"] for r in shuffled.collect()} == got


def test_style_tree_judges_articles_too(spark):
    inside = [(i, f"http://a.example/{i}", f"<article><p>Story {i} begins here</p><div class=app>Get our app</div><p>Read more of this paper</p><p>and story {i} ends</p></article><p>By {i}") for i in range(12)]
    cards = [(20 + i, f"http://b.example/{i}", f"<article>Card {i}</article><div class=body><p>The body of page {i} is long and told in a plain division</div><div class=end>Same end") for i in range(12)]
    copies = [(40 + i, "http://c.example/x", "<article>Only one text</article>out") for i in range(8)]
    few = [(60, "http://d.example/x", "<article>in</article><div>out"), (61, None, "<article>in</article><div>out")]
    df = spark.createDataFrame([*inside, *cards, *copies, *few], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.extract(df).collect()}
    for i in range(12):
        assert got[i] == f"Story {i} begins here\n\nand story {i} ends"
        assert got[20 + i] == f"Card {i}\n\nThe body of page {i} is long and told in a plain division"
    assert {got[40 + i] for i in range(8)} == {"Only one text"} and got[60] == got[61] == "in"
    shuffled = pages.extract(df, pages.Params(broadcast_rows=-1))
    assert {r["page_id"]: r["text"] for r in shuffled.collect()} == got


NAMED = [
    ("<div id=page class='no-sidebar'><p>all", "all"), ("<div class='hasSidebar'>x <div class=sidebar>y</div>text of it", "x\n\ntext of it"),
    ("<article><div class='entry-header'>Title</div><p>body</p><div class='share'>s</div></article>", "Title\n\nbody"),
    ("<div class=notice><main>in</main>a</div>a longer text outside", "in"), ("<div class=banner><article>in</article></div>longer text", "in"),
    ("<div class=response>most of the text</div><p>little", "most of the text\n\nlittle"), ("<div class='cookie-banner'>c</div><p>text", "text"),
    ("<article>the story</article><div class=comments><article>I say</article></div>", "the story"), ("<p>some <span class=ad>x</span> text", "some\n\ntext"),
]


def test_named_parts(spark):
    for html, want in NAMED:
        assert pages.main_text(html, set(), 8) == want, html
    half = "<div class=top>The very same long introduction on all of the pages of this site</div>"
    body = [(i, f"http://e.example/{i}", f"{half}<div class=notice>Notice {i} tells the news of today</div><div class=ad>Ad {i}</div>") for i in range(12)]
    df = spark.createDataFrame(body, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in pages.extract(df).collect()} == {i: f"Notice {i} tells the news of today" for i in range(12)}


def test_licences(spark, odd_docs):
    notes = dict((name, text) for name, _, text in licenses.TEMPLATES)
    long = notes["mit"].split()
    planted = [
        (1, "x y z " + notes["mit-line"].upper() + " tail", {"mit-line"}),
        (2, " ".join([*["w"] * 50, *long[:60], "oops", *long[61:]]), {"mit"}),
        (3, " ".join(long[: len(long) // 2]), set()),
        (4, (notes["gpl-3-line"] + " and ") * 3, {"gpl-3-line"}),
        (5, notes["apache-header"], {"apache-header", "apache-line"}),
        (6, None, set()), (7, "", set()), (8, "Released under the", set()),
    ]
    df = spark.createDataFrame([(i, t) for i, t, _ in planted], "doc_id long, text string")
    rows = licenses.scan(df).collect()
    for i, _, want in planted:
        assert {r["template"] for r in rows if r["doc_id"] == i} == want, i
    assert sorted(r["first_word"] for r in rows if r["doc_id"] == 4) == [0, 13, 26]
    documents = df.unionByName(odd_docs.select("doc_id", "text")).toPandas()  # noqa: F841  (DuckDB reads it)
    want = duckdb.sql(licenses.oracle()).fetchall()
    got = licenses.scan(df.unionByName(odd_docs.select("doc_id", "text"))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert licenses.scan(odd_docs.limit(0)).count() == 0


def test_long_templates_come_through_windows_of_sixteen(spark):
    """Full texts of hundreds of words, copied with an edit every 40 words and with parts left out; a shuffled index finds
    the same."""
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    texts = [rng.choice(vocabulary, n).tolist() for n in (400, 900, 2500)]
    known = licenses.template_table(spark, [(f"full-{i}", "X", " ".join(w)) for i, w in enumerate(texts)])
    docs, want = [], set()
    for i, w in enumerate(texts):
        edited = [x if k % 40 else "edited" for k, x in enumerate(w)]  # 5 of 40 shingles differ
        docs += [(10 * i, "before " + " ".join(edited) + " after"), (10 * i + 1, " ".join(w[: len(w) // 2])), (10 * i + 2, " ".join(w[: int(0.9 * len(w))]))]
        want |= {(10 * i, f"full-{i}"), (10 * i + 2, f"full-{i}")}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    p = licenses.Params()
    assert {r[0] for r in known.select(licenses.template_width(F.size(licenses.shingles(F.col("text"), p)), p)).collect()} == {16}
    rows = licenses.scan(df, known)
    assert {(r["doc_id"], r["template"]) for r in rows.collect()} == want
    again = licenses.scan(df, known, licenses.Params(broadcast_keys=0))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))


def test_bands_of_all_widths(spark):
    """Registers by halves against minima over whole windows; copies of a template's part collide wherever they begin."""
    p = licenses.Params()
    rng = np.random.default_rng(2)
    rows = [(n, rng.integers(-(2**63), 2**63, n).tolist()) for n in (0, 1, 2, 3, 4, 5, 11, 23, 31, 32, 33, 47, 48, 100)]
    df = spark.createDataFrame(rows, "n int, h array<long>")
    xor = lambda x, m: (x ^ m)
    for r in df.select("n", "h", licenses._given(F.col("h"), lambda a: licenses.text_keys(a, p.widths, p)).alias("keys")).collect():
        want = set()
        for w in p.widths[1:]:
            for at in range(0, r["n"] - w + 1, w // 2):
                want |= {xor(min(xor(x, licenses._mask(j)) for x in r["h"][at : at + w]), licenses._mask(1_000 * w + j)) for j in range(p.bands_of(w))}
        assert set(r["keys"]) == want, r["n"]
    for n in (5, 11, 22, 23, 47):
        h = rng.integers(-(2**63), 2**63, n).tolist()
        texts = [(k, rng.integers(-(2**63), 2**63, k).tolist() + h + [1, 2, 3]) for k in range(34)]
        one = spark.createDataFrame([(h,)], "h array<long>")
        width = one.select(licenses.template_width(F.size("h"), p)).first()[0]
        mine = set(one.select(licenses.template_keys(F.col("h"), width, p)).first()[0])
        got = spark.createDataFrame(texts, "k int, h array<long>").select("k", licenses._given(F.col("h"), lambda a: licenses.text_keys(a, [width], p)).alias("keys")).collect()
        assert width > 1 and all(len(mine & set(r["keys"])) >= p.bands_of(width) for r in got)


def test_bands_are_compiled(spark, monkeypatch):
    """Bands of blocks, a row each, are those of whole texts; nothing interpreted takes minima, and one number joins."""
    p, plans, write = licenses.Params(), [], licenses.materialize

    def kept(df, name):
        plans.extend([df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))] if name == "found" else [])
        return write(df, name)

    monkeypatch.setattr(licenses, "materialize", kept)
    long = " ".join(f"w{i}" for i in range(40))
    known = [(f"t{n}", "X", " ".join(long.split()[:n])) for n in (6, 12, 40)]  # of all widths
    docs = spark.createDataFrame([(n, "x " * (n % 9) + " ".join(long.split()[:n])) for n in range(44)], "doc_id long, text string")
    rows = licenses.scan(docs, licenses.template_table(spark, known)).collect()
    assert {(r["doc_id"], r["template"]) for r in rows if r["containment"] == 1.0} == {(n, t) for n in range(44) for t, _, w in known if n >= len(w.split())}
    assert " ^ " in plans[0] and not any("lambdafunction" in line and " ^ " in line for line in plans[0].splitlines())
    assert "HashJoin" in plans[0] and "Left keys [1]" in plans[0]
    h = list(range(1000, 1037))
    x = [F.lit(v) for v in h[8 : 8 + licenses.block(p.widths)[1]]]
    mine = spark.range(1).select(F.array(*[k for _, k in licenses.block_keys(x, p.widths, p)]).alias("k")).first()["k"]
    whole = spark.createDataFrame([(h,)], "h array<long>").select(licenses.text_keys(F.col("h"), p.widths, p).alias("k")).first()["k"]
    assert set(mine) <= set(whole)
