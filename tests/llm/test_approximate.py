"""Neighbours, near copies, decontamination, classifiers and pages against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest

from trackmill.llm import decontaminate, mixing, near_dups, neighbours, pages, toxicity

SF = "/root/testdata/sf0.01"


def test_neighbours_recall_and_order(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id id", "embedding v")
    rows = neighbours.nearest(df, df.filter("id % 100 = 0"), least_rows=0).collect()
    data = df.toPandas()
    x, ids = np.array(data.v.tolist(), dtype=np.float64), data.id.to_numpy()
    found = defaultdict(dict)
    for r in rows:
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hit = 0
    for q, got in found.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        hit += len(set(best) & {v for v, _ in got.values()})
        assert [got[k] for k in sorted(got)] == sorted(got.values(), key=lambda p: (p[1], p[0])) and len(got) == 10
    assert len(found) == 20 and hit >= 0.9 * 200


def test_neighbours_odd_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(100, None), (101, [0.0, 0.0]), (102, [1.0, None]), (103, [float("nan"), 1.0]), (104, [float("inf"), 1.0]), (105, [1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (200, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(df, df.filter("id % 100 = 0"), k=3).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, 0.0), (200, 1, 0, 5**0.5), (200, 2, 1, 5**0.5), (200, 3, 2, 5**0.5)]
    assert neighbours.nearest(df.limit(0), df).count() == 0
    few = df.filter("id in (3, 200)")
    assert neighbours.nearest(few, few).count() == 2


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], (last + 1 if x == y else max(row[j], row[j - 1]))
    return row[-1]


def test_alignment():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.randrange(30) for _ in range(rng.randrange(1, 60))]
        b = [x for x in a if rng.random() > 0.05]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(30))
        m = lcs(a, b)
        want = m / (len(a) + len(b) - m)
        got = near_dups.similarity(a, b, 0.8)
        assert (got >= 0.8) == (want >= 0.8)
        if want >= 0.8:
            assert got == pytest.approx(want)


def test_near_copies(make_docs, odd_docs):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = [(10, " ".join(base)), (20, " ".join(base).upper() + "!")]
    for i in range(30):  # one or two words changed
        copy = list(base)
        for _ in range(1 + i % 2):
            copy[rng.randrange(200)] = f"new{i}"
        rows.append((30 + i, " ".join(copy)))
    rows += [(100 + i, " ".join(f"u{i}x{rng.randrange(10**6)}" for _ in range(150))) for i in range(30)]  # unrelated
    rows += [(200 + i, " ".join(base[:60]) + " " + " ".join(f"v{i}x{k}" for k in range(60))) for i in range(30)]  # one passage
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_dups(make_docs(*rows)).collect()}
    assert all(got[i] == 10 for i in [10, 20, *range(30, 60)])
    assert all(got[i] == i for i in [*range(100, 130), *range(200, 230)])
    odd = defaultdict(set)
    for r in near_dups.near_dups(odd_docs).collect():
        odd[r["doc_id"]].add(r["class_id"])
    assert odd == {1: {1}, 2: {2}, 3: {3}, 4: {4}, 5: {5}, 6: {5}, 7: {4}, None: {None}, 8: {8}, 9: {9}, -3: {-3}}
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in near_dups.keep_first(odd_docs).collect())
    assert kept == [(False, i) for i in (-3, 1, 2, 3, 4, 5, 8, 9)] + [(True, 0)] * 2
    assert near_dups.near_dups(make_docs()).count() == 0


@pytest.mark.parametrize(("every", "scattered", "most"), [(9, True, 0.002), (9, False, 0.02), (15, True, 0.001), (15, False, 0.001)])
def test_sketches_of_pairs_at_the_threshold(every, scattered, most):
    """Lone pairs with one word in nine or fifteen replaced share a sketch, whether edits are random or evenly spread."""
    rng, texts = random.Random(3), []
    for _ in range(1000):
        a = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        b = list(a)
        for k in rng.sample(range(200), 200 // every) if scattered else range(rng.randrange(every), 200, every):
            b[k] = f"z{rng.randrange(10**6)}"
        texts += [" ".join(a).encode(), " ".join(b).encode()]
    prints, before = near_dups.shingles(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), near_dups.SHINGLE)
    keys = near_dups.sketches(prints, before)
    assert (~(keys[0::2] == keys[1::2]).any(axis=1)).mean() <= most


def test_chain_of_copies(make_docs):
    """Links a-b and b-c make one class even if a and c are not alike."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 120])) for i in range(15)]
    got = {r["class_id"] for r in near_dups.near_dups(make_docs(*rows)).collect()}
    assert got == {0}


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_least_edits():
    rng = random.Random(2)
    for _ in range(500):
        p, t = ([rng.randrange(3) for _ in range(rng.randrange(lo, 12))] for lo in (1, 0))
        assert decontaminate.least_edits(p, t) == edits(p, t)


def test_decontamination(spark, make_docs, odd_docs):
    rng = random.Random(9)
    items = [[f"q{k}w{rng.randrange(40)}" for _ in range(rng.randrange(6, 40))] for k in range(20)]
    bench = spark.createDataFrame([*((k, " ".join(w)) for k, w in enumerate(items)), (90, None), (91, ""), (92, "too short"), (7, " ".join(items[0]))], "item_id long, text string")
    rows, want = [], {}
    for i in range(120):
        k, filler = i % 20, [f"f{rng.randrange(300)}" for _ in range(50)]
        item = list(items[k])
        for _ in range(rng.randrange(0, int(len(item) * 0.3) + 2)):
            at = rng.randrange(len(item))
            item[at : at + 1] = rng.choice([[], ["other"], [item[at], "more"]])
        words = filler[:25] + item + filler[25:]
        rows.append((i, ", ".join(words).upper()))
        want[i] = sorted({j for j, w in enumerate(items) if edits(w, words) <= int(len(w) * 0.2)} | ({7} if edits(items[0], words) <= int(len(items[0]) * 0.2) else set()))
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contamination(make_docs(*rows), bench).collect()}
    assert got == want and any(want.values()) and not all(want.values())
    assert {r["contaminated"] for r in decontaminate.contamination(odd_docs, bench).collect()} == {0}
    assert decontaminate.contamination(make_docs(*rows), bench.limit(0)).filter("contaminated = 1").count() == 0
    named = make_docs(*rows).withColumn("item_ids", decontaminate.F.lit("kept"))
    kept = decontaminate.drop_contaminated(named, bench)
    assert kept.columns == named.columns and kept.count() == sum(not v for v in want.values())


def test_toxicity(spark, odd_docs, make_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").toPandas()
    assert docs.count() == toxicity.toxicity(docs, labels).count()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    test = got[got.held_out]
    rank, pos = test.score.rank(), test.toxic == 1
    assert (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum()) > 0.97
    assert toxicity.toxicity(odd_docs, labels.limit(0)).filter("score != 0 or predicted != 0").count() == 0
    one = spark.createDataFrame([(4, 0), (7, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd_docs, one).count() == odd_docs.count()
    named = docs.withColumn("score", toxicity.F.lit("mine")).withColumn("toxic_score", toxicity.F.lit(1))
    assert toxicity.keep_clean(named, labels).columns == named.columns
    assert toxicity.toxicity(make_docs(), labels).count() == 0


def test_mixing(spark, odd_docs, make_docs):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mixing(docs, labels).toPandas()
    p, n, x = np.array(got.posterior.tolist()), got.n_tokens.to_numpy(), got.rate.to_numpy()
    assert np.allclose(p.sum(1), 1) and (x >= 0).all()
    assert n.tolist() == [len((t or "").split()) for t in docs.toPandas().set_index("doc_id").loc[got.doc_id, "text"]]
    assert np.allclose((n * x) @ p / n.sum(), [0.05, 0.95], atol=1e-6)
    # a plain projected gradient on the same posteriors ends at the same totals, and an infeasible target is approached
    mix = mixing.fit(docs, mixing.quality_domains(labels), {0: 0.0, 1: 1.0}, most=1.0)
    y = np.ones(len(n))
    a = p * n[:, None] / n.sum()
    inverse = np.linalg.pinv((p * n[:, None]).T @ p / n.sum() + 1e-12 * np.eye(2))
    for _ in range(mixing.STEPS):
        y = np.clip(y - p @ (inverse @ (a.T @ y - np.array([0.0, 1.0]))), 0, 1)
    assert np.allclose(mix.totals, a.T @ y, atol=1e-6)
    kept = mixing.draw(docs, mix)
    assert kept.columns == docs.columns and kept.select("doc_id").distinct().count() == kept.count() < docs.count()
    assert {r["rate"] for r in mixing.mixing(odd_docs, labels.limit(0)).collect()} == {1.0}
    assert mixing.mixing(odd_docs, labels).count() == odd_docs.count()
    assert mixing.mixing(make_docs(), labels).count() == 0


def test_feasible_mix(spark, make_docs):
    """Without repeats, 60 % high-quality tokens are drawn with so few others that the weights hold."""
    rows = [(i, f"word{i} " * 10 if i % 5 < 3 else f"# x{i} ! " * 3 + "y") for i in range(4000)]
    docs, labels = make_docs(*rows), spark.createDataFrame([(i, int(i % 5 < 3)) for i in range(4000)], "doc_id long, domain int")
    mix = mixing.fit(docs, labels, most=1.0, feasible=True)
    assert mix.residual < 1e-3
    n = {i: len(t.split()) for i, t in rows}
    drawn = [r["doc_id"] for r in mixing.draw(docs, mix).select("doc_id").collect()]
    low = sum(n[i] for i in drawn if i % 5 >= 3) / sum(n[i] for i in drawn)
    assert abs(low - 0.05) < 0.01 and len(drawn) == len(set(drawn)) and {i for i in n if i % 5 < 3} <= set(drawn)


def test_pages(spark):
    page = (
        "<title>t</title><p>a <b>b</b>\n c<p>d<br>e<ul><li>x<li>y<ul><li>z</ul><li>w</ul><ol start=3><li>q<li>r</ol>"
        "<table><caption>C</caption><tr><td>1<td>long cell<tr><th colspan=2>hh<td>k</table><pre>\n a  b\n c</pre>"
        "<div hidden>no</div><div style='Display : none'>no</div>tail &amp; &lt;x</div></b><script>var x='</p>'</script>end"
    )
    want = "a b c\n\nd\ne\n\n- x\n- y\n  - z\n- w\n\n3. q\n4. r\n\nC\n1   long cell\nhh             k\n\n a  b\n c\n\ntail & <xend"
    df = spark.createDataFrame([(1, page, "kept"), (1, page, "kept"), (2, None, None), (3, "", ""), (4, "<", "z"), (5, "<div>" * 30_000 + "deep", "")], "page_id long, html string, text string")
    got = sorted(((r["page_id"], r["text"]) for r in pages.extract(df).collect()), key=str)
    assert got == [(1, want), (1, want), (2, None), (3, ""), (4, "<"), (5, "deep")]
    assert pages.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(("page", "want"), [
    ("<p>let <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>tex</annotation></math> be", "let x+1 be"),
    ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><metadata>no</metadata><text>one</text><text>two</text></svg> end", "one two end"),
    ("<div>a<svg/>b<math />c<svg width='1'><path d='x'/><g/><text>t</text></svg>d</div>e", "abc t d\ne"),
    ("<svg><g><title/><path d=a/><text>in</text><p>after</p>tail", "in\n\nafter\n\ntail"),
    ("<svg><foreignObject><p>x<br/>y</p></foreignObject><text><![CDATA[a > b]]></text></svg>", "x\ny\n\na > b"),
    ("<desc>shown</desc>", "shown"),
    ("<head><title>no</title>\n text of the page", "text of the page"),
])
def test_pages_foreign(page, want):
    assert pages.text_of(page) == want


def test_pages_words(spark):
    """Every visible word of the pages appears, in order; none of scripts and styles does."""
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").limit(60).collect():
        page = re.sub(r"(?is)<!--.*?-->|<head\b.*?</head>|<(script|style)\b.*?</\1>", " ", r["html"])
        import html

        words = html.unescape(re.sub(r"<[^>]*>", " ", page)).split()
        assert [w for w in pages.text_of(r["html"]).split() if w != "-"] == [w for w in words if w != "-"]
