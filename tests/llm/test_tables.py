"""Manifest, whitening and main texts against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulens.llm.html_blocks import read
from tabulens.llm.lookup import look_up
from tabulens.llm.main_text import choose, extract, main_texts
from tabulens.llm.merkle import prove
from tabulens.llm.whitening import jacobi_davidson, minres, whiten

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    parts = []
    for value in (row.doc_id, row.source, row.lang, row.n_chars, text):
        own = None if value is None else str(value)
        parts.append("-" if own is None else f"{len(own.encode())}:{own}")
    return digest(*parts)


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def up(level, at, fold):
    """Next level, place, folded digest and siblings of the node at a place."""
    start = at // 16 * 16
    run = level[start : start + 16]
    changed = [*run[: at - start], fold, *run[at - start + 1 :]]
    above = [digest(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return above, at // 16, digest(*changed), run[: at - start] + run[at - start + 1 :]


def plain_proofs(rows):
    """(id, leaf, subroot, root, proof, folded, verified) of every row, in no order."""
    of_source = defaultdict(list)
    for row in rows:
        of_source[row.source].append((row.doc_id is not None, row.doc_id, leaf(row, row.text), row))
    tops, ways = [], []
    sources = sorted(of_source, key=lambda s: (s is not None, (s or "").encode()))
    for number, source in enumerate(sources):
        own = sorted(of_source[source], key=lambda x: (x[0], x[1] or 0, x[2]))
        for at, (_, id_, hashed, row) in enumerate(own):
            crc = 1 if id_ is None else zlib.crc32(str(id_).encode())
            fold = leaf(row, lower(row.text)) if crc % 5 == 0 else hashed
            level, place, beside = [x[2] for x in own], at, []
            while len(level) > 1:
                level, place, fold, more = up(level, place, fold)
                beside += more
            ways.append((id_, hashed, level[0], number, fold, beside))
        tops.append(level[0])
    out = []
    for id_, hashed, subroot, place, fold, beside in ways:
        level = tops
        while len(level) > 1:
            level, place, fold, more = up(level, place, fold)
            beside = beside + more
        out.append((id_, hashed, subroot, level[0], digest(*beside), fold, fold == level[0]))
    return out


def proofs(df):
    return [tuple(r) for r in prove(df).collect()]


def order(rows):
    return sorted(rows, key=str)


def test_proofs(spark):
    draw = random.Random(3)
    sizes = {None: 3, "": 1, "a": 700, "b": 17, "ä": 16, "z": 260, "A": 33}
    rows, number = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            number += draw.randrange(1, 4)
            text = draw.choice(["Some Text", "no capitals", "", "ÄÖ Ü", None, "X" * 50])
            rows.append((number, text, draw.choice(["en", None]), source, draw.choice([None, 5])))
    df = spark.createDataFrame(rows, DOCS)
    expected = plain_proofs(df.collect())
    got = proofs(df.repartition(7))
    assert order(got) == order(expected)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("size", [0, 1, 2, 16, 17])
def test_proofs_of_one_source(spark, size):
    df = spark.createDataFrame([(i, f"Text {i}", "en", "s", 1) for i in range(size)], DOCS)
    assert order(proofs(df)) == order(plain_proofs(df.collect()))


def test_proofs_of_many_sources(spark):
    df = spark.createDataFrame([(i, f"T {i}", "en", f"s{i}", 1) for i in range(300)], DOCS)
    assert order(proofs(df)) == order(plain_proofs(df.collect()))


def test_proofs_of_odd_rows(spark, odd_rows):
    rows = odd_rows.collect()
    assert order(proofs(odd_rows)) == order(plain_proofs(rows))
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    prove(odd_rows)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


@pytest.mark.parametrize(
    "matrix",
    [
        np.eye(5),
        np.diag([4.0] * 3 + [1.0] * 20),
        np.diag(10.0 ** -np.arange(12)),
        np.zeros((6, 6)),
        np.array([[2.0]]),
        (lambda a: a.T @ a)(np.random.default_rng(0).standard_normal((200, 60))),
        (lambda a: a.T @ a)(np.random.default_rng(1).standard_normal((3, 40))),
    ],
)
def test_jacobi_davidson(matrix):
    values, vectors = jacobi_davidson(lambda v: matrix @ v, len(matrix), 4)
    expected = np.linalg.eigvalsh(matrix)[::-1][:4]
    top = max(expected[0], 1e-300)
    assert np.abs(values - expected).max() <= 1e-13 * top
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-12 * top
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_minres_solves():
    draw = np.random.default_rng(2)
    a = draw.standard_normal((12, 12))
    a = a + a.T
    beside = np.linalg.qr(draw.standard_normal((12, 2)))[0]
    shifts, right = np.array([0.3, -1.0]), draw.standard_normal((12, 2))
    right -= beside @ (beside.T @ right)
    x = minres(lambda v: a @ v, shifts, right, beside, 10)
    left = a @ x - shifts * x
    left -= beside @ (beside.T @ left)
    assert np.abs(left - right).max() < 1e-8


def plain_whitening(vectors, k):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    c = x - sums / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return ((n * x - sums) ** 2).sum(axis=1), c @ axes / np.sqrt(values), values / c.var(axis=0).sum()


def test_whitening(spark):
    draw = np.random.default_rng(5)
    vectors = (draw.standard_normal((400, 12)) * np.linspace(0.05, 1, 12)).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = whiten(df.repartition(6)).toPandas()
    deviation, white, explained = plain_whitening(vectors, 8)
    assert len(got) == 400 * 8 and set(got.n) == {400}
    assert got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    wide = got.pivot(index="id", columns="component", values="whitened").to_numpy()
    signs = np.sign((wide * white).sum(axis=0))
    assert np.abs(wide * signs - white).max() < 1e-8
    first = got.drop_duplicates("id").set_index("id").sort_index()
    assert first.deviation.tolist() == deviation.tolist()
    shares = got.groupby("component").explained.first().to_numpy()
    assert np.abs(shares / explained - 1).max() < 1e-10


def test_whitening_of_odd_vectors(spark):
    good = [(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (None, [0.0, 2.0], None), (4, [3.0, 1.0], "x")]
    bad = [
        (5, None, "x"), (6, [], "x"), (7, [1.0, None], "x"), (8, [float("nan"), 1.0], "x"),
        (9, [float("inf"), 1.0], "x"), (10, [1e300, 1.0], "x"), (11, [1.0, 2.0, 3.0], "x"),
    ]
    schema = "vec_id long, embedding array<double>, n string"
    df = spark.createDataFrame(good + bad, schema)
    got = whiten(df).collect()
    assert sorted(str(r.id) for r in got) == ["1", "1", "1", "1", "4", "4", "None", "None"]
    expected = plain_whitening([v for _, v, _ in good], 2)
    assert {r.deviation for r in got if r.id == 4} == {expected[0][3]}
    assert whiten(df.where("false")).collect() == []
    assert whiten(df.where("vec_id = 4")).collect() == []
    assert whiten(df.where("vec_id > 4 AND vec_id < 11")).collect() == []
    same = spark.createDataFrame([(i, [1.0, float(i), 5.0], "") for i in range(9)], schema)
    assert {r.component for r in whiten(same).collect()} == {1}
    # sums of squares beyond a long: exact until then, null after
    far = spark.createDataFrame([(i, [i * 1e9, 0.0], "") for i in range(4)], schema)
    off = [1024 * 10**9 * i + 100_000 for i in range(4)]
    for row in whiten(far).collect():
        d = (4 * off[row.id] - sum(off)) ** 2
        assert row.deviation == (d if d < 2**63 else None)


RICH = """<html><body class="no-sidebar comments-open"><header><h1>Site</h1></header><nav>menu</nav>
<div class="layout has-sidebar"><aside>side</aside><main><article class="post post-12">
<header><h1>Title</h1><p>By me</p></header><p>One <a href=x>two</a><br>three &amp; four</p>bare
 text<ul><li>a<li>b</ul><div class="ad-slot">Buy</div><form>Name <input></form>
<section class="comments"><article>c1</article></section><footer>foot</footer></article></main></div>
<div class="cookie-notice">We use</div><script>var x="</p>";</script><footer>(c)</footer></body></html>"""

CASES = {
    RICH: "Title\nOne two three & four\nbare text\na\nb",
    "": "",
    "plain  text": "plain text",
    "<p>a<p>b": "a\nb",
    "<p><b>a.<br><p>b &lt;i&gt;</b>": "a.\nb <i>",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc",
    "<script>never": "",
    "<!-- never": "",
    "x < y and <3": "x < y and <3",
    '<p title="a>b">c</p>': "c",
    "<form><p>only a form</p></form>": "",
    "<form id=page><h1>T</h1><p>whole</p></form>": "T\nwhole",
    "<div hidden>x</div><p style='display: none'>y</p><p>z</p>": "z",
    "<textarea>t</textarea><p>a&nbsp;b&eacute;&#8364;</p></div></p>c": "a bé€\nc",
    "<div class=adventure><p>no advert</p></div>": "no advert",
}


@pytest.mark.parametrize("html", CASES)
def test_extract(html):
    assert extract(html) == CASES[html]


def test_odd_pages_take_linear_time():
    for html in ("<div>" * 50_000 + "x", "<p><b>" * 30_000 + "x", "<a <a " * 50_000, '<b "' * 50_000):
        extract(html)


def test_paths():
    page = read('<body><div class="b a12 a7"><div id=q><p>x</p></div></div>')
    assert page.path_name(page.paths[choose(page)]) == "div.a#.b>div"
    assert page.path_number("div.a#.b>div") and page.path_number("div.c") is None


def test_hosts_agree(spark):
    """A short text in the usual place is read as the other pages of its host are."""
    text = "word " * 60
    rows = [
        (i, f"http://a.example/{i}", f"<div class=x{i}>short one</div><div class=y>{text}</div>")
        for i in range(10)
    ]
    short = "<div class=x3>this box is longer than the text below it</div><div class=y>Of.</div>"
    other = f"<section class=z><p>{text}</p></section>"
    rows += [(10, "http://A.example/q", short), (11, "http://a.example/r", other)]
    rows += [(12, "http://b.example/", short), (13, None, other), (14, "::", None), (None, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r.text for r in main_texts(df.repartition(5)).collect()}
    assert len(got) == 16
    assert got[3] == text.strip() and got[10] == "Of." and got[11] == text.strip()
    assert got[12].startswith("this box") and got[13] == text.strip()
    assert (got[14], got[None]) == ("", "")
    assert all(r.n_chars == len(r.text) for r in main_texts(df).collect())


def test_pages_odd(spark, odd_rows):
    df = odd_rows.withColumn("url", F.col("lang"))
    got = main_texts(df, "doc_id", "url", "text").collect()
    assert len(got) == 12 and {len(r.text) for r in got if r.id == 8} == {200_000}
    assert main_texts(df.where("false"), "doc_id", "url", "text").collect() == []


def test_lookup_without_broadcast(spark, monkeypatch):
    big = spark.range(300).select((F.col("id") % 3).cast("string").alias("k"), "id")
    small = spark.createDataFrame([("0", 5), ("1", 6)], "k string, v int")
    near = sorted(map(str, look_up(big, small, "k", F.lit(10), F.col("id")).collect()))
    monkeypatch.setattr("tabulens.llm.lookup.BROADCAST_BYTES", 0)
    far = look_up(big, small, "k", F.lit(10), F.col("id"))
    assert sorted(map(str, far.select("k", "id", "v").collect())) == near
