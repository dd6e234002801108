"""The training-data operators: against brute force, and on null, empty, long, tied, repeated and clashing rows."""

import re
import hashlib
import math
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[1]))
import brute
from bidlattice.llm import components, exact, exponion, hilbert, htmltext, langid, lines, minhash, mixing, personal, pieces, prefixes, quality, queries, urls
from oracle import differences

SF = "/root/testdata/sf0.001"
MODEL = queries.tokenizer_path()
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0):
    rows = [(first + i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, white space, one word, repeated and very long texts."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [None, "", " \t\n", "word", "word", "a b", "A  B", "x y z", long, long + " end", "é ü\n\nß 7", "z" * 50_000]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_on_empty_tables(spark, tmp_path, name):
    for t in ("documents", "labels", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


# --- 1 ---


def near_texts(seed, n=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.7:
            words = rng.choice(out).split()
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice("abcdefgh") * rng.randint(1, 3)
        else:
            words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randint(3, 90))]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("width, percent, seed", [(3, 85, 1), (5, 80, 2), (3, 85, 3)])
def test_near_duplicates(spark, width, percent, seed, odd):
    texts = near_texts(seed) + odd
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, texts), width, percent).collect()}
    assert got == brute.components(list(enumerate(texts)), width, percent)


@pytest.mark.parametrize("seed, pivots", [(9, 8), (10, 1), (11, 0.01)])
def test_near_duplicates_in_blocks(spark, monkeypatch, seed, pivots):
    """Posting lists and cells beyond one block are linked in their blocks, then by the rows outside the largest part."""
    monkeypatch.setattr(minhash, "LIST_BLOCK", 3)
    monkeypatch.setattr(minhash, "CELL_ROWS", 4)
    monkeypatch.setattr(minhash, "PIVOTS", pivots)
    texts = near_texts(seed, 50)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, texts).repartition(7), 3, 85).collect()}
    assert got == brute.components(list(enumerate(texts)), 3, 85)


@pytest.mark.parametrize("n", [400, 1600])
def test_a_group_of_near_copies_costs_about_its_rows(spark, monkeypatch, n):
    """All rows of one cell are linked; the rows dealt to groups of sets grow as n, whatever the number of blocks."""
    monkeypatch.setattr(minhash, "CELL_ROWS", 40)
    dealt = []
    for name in ("_first_groups", "_second_groups"):
        own = getattr(minhash, name)
        monkeypatch.setattr(minhash, name, lambda rows, own=own: dealt.append(own(rows)) or dealt[-1])
    texts = [" ".join([*(f"w{i}" for i in range(60)), f"x{i}"]) for i in range(n)]
    got = minhash.near_duplicates(docs(spark, texts), 3, 85)
    assert {r.component_id for r in got.collect()} == {0}
    assert sum(g.count() for g in dealt if "shingles" in g.columns) <= 2 * n


def test_bridges_join_what_all_links_join():
    rng = random.Random(5)
    for _ in range(50):
        n = rng.randint(1, 12)
        part, guest = np.array([rng.randrange(4) for _ in range(n)]), np.array([rng.random() < 0.4 for _ in range(n)])
        near = {(x, y) for x in range(n) for y in range(n) if rng.random() < 0.3}

        def joined(links, part=part):
            name = {p: p for p in part.tolist()}
            for x, y in links:
                old, new = name[part[x]], name[part[y]]
                name = {p: new if q == old else q for p, q in name.items()}
            return {frozenset(p for p, q in name.items() if q == r) for r in name.values()}

        links = minhash._bridges(part, guest, lambda x, rest, near=near: np.array([(x, y) in near for y in rest.tolist()]))
        links = [(x, y) for x, y, _ in links]
        assert set(links) <= near and len(links) < 4
        assert joined(links) == joined([(x, y) for x, y in near if guest[x] and not guest[y]])


def test_near_duplicates_ignore_other_columns(spark):
    d = docs(spark, ["a b c d", "a b c d"], 5).withColumn("component_id", F.lit("x")).withColumn("sig", F.lit(1))
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(d).collect()} == {(5, 5, True), (6, 5, False)}


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_collisions_needed():
    need = minhash.collisions_needed(0.85, 32, 1e-4)
    miss = lambda t: sum(math.comb(32, k) * 0.85**k * 0.15 ** (32 - k) for k in range(t))
    assert miss(need) <= 1e-4 < miss(need + 1)


def test_near_duplicates_with_null_and_repeated_ids(spark):
    """A null doc_id is linked with nothing and stays; repeated rows share their result."""
    d = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(d).collect()), key=str)
    assert got == sorted([(-1, 2, None, True), (-1, 0, None, True), (3, 2, 3, True), (3, 2, 3, True), (7, 2, 3, False)], key=str)


# --- 2 ---


def test_language_scores_against_plain_python(spark):
    """Probabilities of a fitted model, n-gram by n-gram, and those of a long text read in parts."""
    d = docs(spark, ["the cat and the dog " * 3, "über die größe der häuser " * 3] * 60).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    m = langid.train(d)
    text = "Die Katze and the Häuser"
    folded, mask = f" {text.lower()} ", (1 << 64) - 1
    total, n = np.zeros(len(m.languages)), 0
    for i in range(len(folded)):
        rolled = 0
        for k in range(3):
            if i + k < len(folded):
                rolled = (rolled + ord(folded[i + k])) * int(langid._MIX[k]) & mask
                bucket = ((rolled ^ (rolled >> 29)) * int(langid._MIX[0]) & mask) >> (64 - langid.BITS)
                total += m.weights[:, bucket] * m.idf[bucket]
            n += 1
    z = (100 * total / n + m.bias) / m.temperature
    want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert np.abs(langid.probabilities(m, [text])[0] - want).max() < 1e-9
    long = "the größe of a cat " * 60_000
    assert np.abs(langid.probabilities(m, [long]) - langid.probabilities(m, [long, ""])[:1]).max() < 1e-9


def test_ftrl_against_plain_python():
    """Weights after single steps, coordinate by coordinate."""
    rng = np.random.default_rng(1)
    bags = [(int(rng.integers(2)), np.array(sorted(set(rng.integers(1, 9, 3).tolist()))), None) for _ in range(20)]
    bags = [(y, x, rng.random(len(x))) for y, x, _ in bags]
    w, bias = langid.fit_ftrl(bags, 2, epochs=2)
    z, n, b, bn = Counter(), Counter(), [0.0, 0.0], [1.0, 1.0]
    solve = lambda k: 0.0 if abs(z[k]) <= 1e-5 else -(z[k] - math.copysign(1e-5, z[k])) / ((1 + math.sqrt(n[k])) / 0.5 + 1e-4)
    order = np.random.Generator(np.random.PCG64(11))
    for _ in range(2):
        for i in order.permutation(20).tolist():
            y, x, v = bags[i]
            old = {(c, j): solve((c, j)) for c in (0, 1) for j in x.tolist()}
            s = [sum(old[c, j] * q for j, q in zip(x.tolist(), v, strict=True)) + b[c] for c in (0, 1)]
            e = [math.exp(a - max(s)) for a in s]
            for c in (0, 1):
                g = e[c] / sum(e) - (c == y)
                bn[c] += g * g
                b[c] -= 0.1 * g / math.sqrt(bn[c])
                for j, q in zip(x.tolist(), v, strict=True):
                    step = g * q
                    z[c, j] += step - (math.sqrt(n[c, j] + step * step) - math.sqrt(n[c, j])) / 0.5 * old[c, j]
                    n[c, j] += step * step
    assert all(abs(w[c, j] - solve((c, j))) < 1e-9 for c in (0, 1) for j in range(1, 9)) and np.abs(bias - b).max() < 1e-9


def test_language_is_learned_and_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.limit(50).collect())


def test_language_edges(spark, odd):
    train = docs(spark, ["the cat and the dog"] * 40).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("xx")).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("über größe"))
    model = langid.train(train.withColumn("score", F.lit("clash")))
    got = {r.doc_id: r for r in langid.identify(docs(spark, odd), model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and got[3].lang_pred in ("en", "xx")
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(odd)
    assert {r.lang_pred for r in langid.identify(docs(spark, odd), langid.train(docs(spark, [None]))).collect()} == {"und"}


def test_temperature_restores_confidence():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    y = np.array([rng.choice(3, p=p) for p in langid._softmax(logits)])
    assert abs(langid.fit_temperature(logits * 4, y) - 4) < 0.5


# --- 3 ---


@pytest.fixture(scope="module")
def field():
    return htmltext.train(htmltext.sample_pages())


def test_main_text_of_unseen_layouts(field):
    right = total = 0
    for page, labels in htmltext.sample_pages(150, seed=77):
        got = htmltext.viterbi(field, htmltext.block_features(htmltext.leaf_blocks(page)))
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right >= 0.97 * total


SENTENCE = "The quick brown fox jumps over the lazy dog and runs away from the big bear."
SIDE = "Something beside that is long enough to be prose, with a few words more."


def page_of(main):
    return f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav>{main}<footer>&copy; x</footer></body></html>"


@pytest.mark.parametrize("body", [
    "<div>{0}</div><div>{0}</div><div>{0}</div>", "<p>{0}</p><div>{0}</div><p>{0}</p>", "<p>{0}</p><div class='note'>{0}</div><p>{0}</p>", "<section><div><div>{0}</div></div></section><p>{0}</p><section>{0}</section>",
])
def test_paragraphs_of_any_element_are_main_text(field, body):
    assert htmltext.main_text(field, page_of(f"<article><h1>Title here</h1>{body.format(SENTENCE)}</article>")) == "\n\n".join(["Title here"] + [SENTENCE] * 3)


@pytest.mark.parametrize("part", [
    "<aside><p>{}</p></aside>", "<form><p>{}</p></form>", "<div class='cookie-notice'><p>{}</p></div>", "<div role=navigation><p>{}</p></div>", "<dialog><p>{}</p></dialog>", "<div class=ad>{}</div>",
    "<ol class='commentlist'><li><p>{0}</p></li><li>{0}</li></ol>", "<section id='comments'><p>{}</p></section>", "<div hidden><p>{}</p></div>", "<ul class=menu><li>one<li>two</ul>",
])
@pytest.mark.parametrize("place", [0, 1, 2])
def test_parts_inside_and_behind_the_article_go(field, part, place):
    at = [part.format(SIDE) if i == place else "" for i in range(3)]
    page = page_of(f"<article><h1>Title here</h1><p>{SENTENCE}</p>{at[0]}<p>{SENTENCE}</p>{at[1]}</article>{at[2]}")
    assert htmltext.main_text(field, page) == "\n\n".join(["Title here", SENTENCE, SENTENCE])


def test_depth_changes_no_text(field):
    article = f"<article><h1>Title here</h1><div>{SENTENCE}</div><aside><p>{SIDE}</p></aside></article>"
    got = {htmltext.main_text(field, page_of("<div class=w>" * n + article + "</div>" * n)) for n in (1, 300, 100_000)}
    assert got == {f"Title here\n\n{SENTENCE}"}
    deep = "<dl><dt>a" + "<span>" * 5000 + "<dd>b"  # a start tag closes an element any number of levels up
    assert [b.leaf for b in htmltext.leaf_blocks(deep)] == ["dt", "dd"]


def test_given_pages_are_their_articles(spark, field):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        article = "<article>" + r.html.split("<article>")[1].split("</article>")[0] + "</article>"
        assert htmltext.main_text(field, r.html) == "\n\n".join(b.text for b in htmltext.leaf_blocks(article))


def test_gradient_of_the_likelihood(field):
    """One step of fitting against differences of the likelihood, taken by enumeration of all label sequences."""
    from itertools import product

    f, y = [["bias", "a"], ["bias"], ["bias", "b"]], [1, 0, 1]
    free = {"bias": 0.0, "a": 0.0, "b": 0.0}

    def likelihood(w, steps):
        of = lambda ys: sum((w[x] if v else -w[x]) for v, x_ in zip(ys, f, strict=True) for x in x_) + sum(steps[p][q] for p, q in zip(ys[:-1], ys[1:], strict=True))
        return of(y) - math.log(sum(math.exp(of(ys)) for ys in product((0, 1), repeat=3)))

    zero = ((0.0, 0.0), (0.0, 0.0))
    got = htmltext.fit([(f, y)], epochs=1, rate=1e-4, l2=0.0)
    # AdaGrad divides a first step by sqrt(1 + g^2); each feature of a page steps as often as it occurs, so take those that occur once
    for x in ("a", "b"):
        g = (likelihood(free | {x: 1e-5}, zero) - likelihood(free | {x: -1e-5}, zero)) / 2e-5
        assert abs(got.weights[x] - 1e-4 * g / math.sqrt(1 + g * g)) < 1e-8
    for a, b in product((0, 1), repeat=2):
        plus = [[1e-5 * ((i, j) == (a, b)) for j in (0, 1)] for i in (0, 1)]
        minus = [[-v for v in row] for row in plus]
        g = (likelihood(free, plus) - likelihood(free, minus)) / 2e-5
        assert abs(got.steps[a][b] - 1e-4 * g / math.sqrt(1 + g * g)) < 1e-7


def test_main_text_details(field):
    page = (
        '<html><head><title>no</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><article><h1>T &amp; U</h1><p>a <b>b</b>c\n\t d<p>e&nbsp;f'
        '<script>var t="</p><p>x";</script></article><footer>&copy; me</footer></body></html>'
    )
    assert htmltext.main_text(field, page) == "T & U\n\na bc d\n\ne f"
    assert htmltext.main_text(field, None) == "" == htmltext.main_text(field, "")
    assert [b.text for b in htmltext.leaf_blocks("<p>1 < 2 <b class='x>y'>z</b><!-- <p>no</p> -->")] == ["1 < 2 z"]


@pytest.mark.parametrize("page, want", [
    ("<p>a<svg-icon name=x></svg-icon> b</p><title-bar>c</title-bar><p>d</p>", ["a", "b", "c", "d"]),
    ("<p>a <svg width='1'/> b</p><svg/><p>c <svg><path d=''/>no</svg> d</p>", ["a b", "c d"]),
    ("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> be</p><p>a <math/> b</p>", ["let x=1 be", "a b"]),
    ("<p>a</p><select><p>b</p><object data=x><p>c</p>", ["a", "b", "c"]),
    ("<p>a</p><script>let b = '<p>b</p>'", ["a"]), ("<p>a</p><title/>b</title><STYLE >p {}</style><p>c</p>", ["a", "c"]),
])
def test_raw_elements(page, want):
    assert [b.text for b in htmltext.leaf_blocks(page)] == want


def test_viterbi_against_enumeration(field):
    """The best of all label sequences, for short pages."""
    from itertools import product

    for page, _ in htmltext.sample_pages(40, seed=5):
        f = htmltext.block_features(htmltext.leaf_blocks(page)[:9])
        s = htmltext._scores(field.weights, f)
        of = lambda ys: sum(v if y else -v for v, y in zip(s, ys, strict=True)) + sum(field.steps[a][b] for a, b in zip(ys[:-1], ys[1:], strict=True))  # noqa: E731, B023
        assert abs(of(htmltext.viterbi(field, f)) - max(map(of, product((0, 1), repeat=len(f))))) < 1e-9


@pytest.mark.parametrize("part", ["<a ", '<a x="', "<div>", "<div>a", "<svg>", "</p>", "<li class=b>c", "<!--", "<x y='\"", '>" <b "', "<ul><b><dd>", "<dl><dt><ul><i><dd></dd>", "<div class=a%d>"])
@pytest.mark.parametrize("end", ["", ">"])
def test_malformed_pages_take_linear_time(field, part, end):
    import time

    many = (1 << 20) // len(part)
    page, begin = ("".join(part % i for i in range(many)) if "%d" in part else part * many) + end, time.process_time()
    htmltext.block_features(htmltext.leaf_blocks(page, field.weights))
    assert time.process_time() - begin < 10


def test_text_of_formulas_and_objects_stays():
    page = "<p>let <math><mi>x</mi></math> be <object data=y><p>shown instead</p></object> &amp; <a href='>'>so</a> on</p><p>1 < 2<br>3</p>"
    assert " ".join(b.text for b in htmltext.leaf_blocks(page)) == "let x be shown instead & so on 1 < 2 3"


def test_pages(spark, field):
    d = spark.createDataFrame([(1, None, None, "c"), (2, "u", "", "c"), (2, "u", "<article><p>Hallo du da</p></article>" * 2000, "c")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.n_chars, len(r.text)) for r in htmltext.extract_main_text(d, field).collect())
    assert got == [(1, 0, 0), (2, 0, 0), (2, 2000 * 13 - 2, 2000 * 13 - 2)]


# --- 4 ---


def test_hilbert_curve_moves_by_one():
    g = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    key = hilbert.hilbert_keys(g, 3)
    assert sorted(key.tolist()) == list(range(512)) and np.abs(np.diff(g[np.argsort(key)], axis=0)).sum(axis=1).max() == 1


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_nearest_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    got = hilbert.nearest(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 50 == 0)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    found, rows = Counter(), got.collect()
    for r in rows:
        assert abs(r.score - u[r.query_id] @ u[r.vec_id]) < 1e-12 and r.vec_id != r.query_id
        found[r.query_id] += 1
    want = {(q, i) for q in range(0, 3000, 50) for i in [j for j in np.argsort(-(u @ u[q])) if j != q][:5]}
    assert set(found.values()) == {5} and len({(r.query_id, r.vec_id) for r in rows} & want) >= 0.9 * len(want)


def test_nearest_ties_and_bad_vectors(spark):
    same = [(i, [1.0, 0.0]) for i in range(0, 200)]
    bad = [(300, None), (301, [0.0, 0.0]), (302, [float("nan"), 1.0]), (303, [float("inf"), 1.0]), (304, [None, 1.0]), (305, [1.0]), (306, [])]
    got = hilbert.nearest(vectors(spark, [*same, *bad, (400, [0.0, 1.0])]), F.col("vec_id") % 50 == 0).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50, 400, 300)}
    assert by == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 400: [0, 1, 2, 3, 4], 300: []}
    few = hilbert.nearest(vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])]), F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r["rank"]) for r in few] == [(1, 1)]


def test_nearest_doubles_scaled_copies_and_clashes(spark):
    """Double vectors, directions that tie, repeated rows and clashing names."""
    rows = [(i, [float(i % 7 + 1), 0.0]) for i in range(60)] + [(100, [1e-300, 1e-300]), (101, [0.0, -1.0]), (101, [0.0, -1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("mine") for c in ("id", "asked", "n", "curve")})
    got = hilbert.nearest(d, F.col("vec_id") % 50 == 0).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50, 100)}
    assert by == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4]}


# --- 5 ---


def test_line_dedup(spark):
    boiler, varied = "Subscribe to our news letter", "Page {} of 30 at the end of it"
    own = "red blue green pink brown black white grey cyan teal gold lime".split()
    body = [f"{own[i]} unique {own[i - 1]} words\n{boiler}\n{varied.format(i)}\nab" for i in range(12)]
    out = {r.doc_id: r for r in lines.drop_recurring_lines(docs(spark, body), min_docs=10).collect()}
    assert out[0].text == body[0] and out[0].n_dropped == 0
    assert all(out[i].n_dropped == 2 and boiler not in out[i].text and "unique" in out[i].text and out[i].text.endswith("ab") for i in range(1, 12))


def test_line_dedup_general_form(spark):
    """Lines that agree in most tokens, where the others vary, are one template."""
    body = [f"the meeting of room {w} was moved to later today" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()]
    out = lines.drop_recurring_lines(docs(spark, body), min_docs=10).collect()
    assert sorted(r.n_dropped for r in out) == [0] + [1] * 9


def test_line_dedup_edges(spark, odd):
    d = docs(spark, odd).withColumn("n_lines", F.lit("x")).withColumns({c: F.lit("mine") for c in ("drop", "doc", "own", "leaf", "first")})
    rows = lines.drop_recurring_lines(d.unionByName(d.limit(1)), min_docs=2)
    assert rows.columns == [*[c for c in d.columns if c != "n_lines"], "n_lines", "n_dropped"] and rows.where("doc <> 'mine' or drop <> 'mine' or own <> 'mine'").count() == 0
    out = {r.doc_id: r for r in rows.collect()}
    assert out[0].text is None and out[0].n_lines == 0 and out[1].n_lines == 1 and out[10].n_lines == 3
    assert all(out[i].text == odd[i] for i in (1, 2, 3, 9, 11))


def test_whole_line_dedup(spark):
    """Long lines go from the second document on, short ones at min_docs; blank lines and lone numbers stay."""
    passage, thai = " ".join(f"w{chr(97 + i % 26)}{i // 26 * 'x'}" for i in range(50)), "ก" * 50
    body = [f"own text {chr(97 + i)} here\nShare\nPage {i}\n{i}\n" for i in range(12)]
    body[3] += f"\n{passage}\n{thai}"
    body[7] += f"\n {passage.replace(' ', '  ')}\n{thai}"
    body[8] += "\n" + passage.rsplit(" ", 1)[0] + "\n" + thai[1:]
    body[9] += "\n" + passage.rsplit(" ", 1)[0] + "\n" + thai[1:]
    out = {r.doc_id: r for r in lines.drop_recurring_lines(docs(spark, body), min_docs=10, whole=True).collect()}
    assert out[0].text == body[0] and passage in out[3].text and thai in out[3].text
    assert [out[i].n_dropped for i in range(12)] == [0] + [2] * 6 + [4] + [2] * 4
    assert all(out[i].text.split("\n")[:3] == [f"own text {chr(97 + i)} here", str(i), ""] for i in range(1, 12))
    assert all(passage.rsplit(" ", 1)[0] in out[i].text and thai[1:] in out[i].text for i in (8, 9))


def test_line_tokens(spark):
    seen = ["", " \t\x0b\f\r", " a1b  c\t2 ", "\u3000 x9", "x" * 300_000 + " 7", "7" + "x" * 300_000, "a\u00a01 b"]
    rows = spark.createDataFrame(list(enumerate(seen)), "i int, line string")
    got = {r.i: r.t for r in lines._fields(rows, "i", whole=False).select("i", "t").collect()}
    for i, line in enumerate(seen):
        words = re.split(r"[ \t\x0b\f\r]+", line.strip(" \t\x0b\f\r"))
        assert got[i] == ["<*>" if re.search("[0-9]", w) else w for w in words]


def test_whole_line_dedup_several_templates(spark):
    """Three templates of one leaf, and one amid more ordinary lines, are each found whatever else the leaf holds."""
    word = lambda i: "".join(chr(97 + int(d)) for d in str(1000 + i))
    kinds = "{} sent by post to the old office in town", "{} held back until all the fees have been paid", "{} moved from here under seal and with two keys"
    body = ["the order was " + kinds[i % 3].format(word(i)) for i in range(60)]
    body += [f"a note of {word(i)} has come from our friends" for i in range(12)]
    body += ["a note of " + " ".join(word(100 + 10 * i + k) for k in range(6)) for i in range(40)]
    found = {w: {r.doc_id: r.n_dropped for r in lines.drop_recurring_lines(docs(spark, body), whole=w).collect()} for w in (False, True)}
    assert sum(found[False].values()) == 0
    assert found[True] == {i: int(3 <= i < 60 or 60 < i < 72) for i in range(len(body))}


# --- 6 ---


def test_quality_on_held_out_labels(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(d, lab.where("doc_id % 4 <> 0"))
    got = quality.grade_documents(d.select("doc_id", "text"), model).join(lab.where("doc_id % 4 = 0"), "doc_id")
    rate = {(r.quality, r.toxic): r.a for r in got.groupBy("quality", "toxic").agg(F.avg(F.col("accepted").cast("int")).alias("a")).collect()}
    assert rate[(1, 0)] > 0.97 and rate[(1, 1)] < 0.15 and rate[(0, 0)] < 0.3


def test_quality_edges(spark, odd):
    lab = spark.createDataFrame([(3, 1, 0), (5, 0, 0), (7, 1, 1), (0, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    d = docs(spark, odd).withColumn("accepted", F.lit("clash"))
    got = quality.grade_documents(d, quality.train(d, lab)).collect()
    assert len(got) == len(odd) and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    assert got[0].asDict().keys() >= {"lang", "source", "n_chars"}
    assert all(r.accepted for r in quality.grade_documents(d, quality.train(d, lab.limit(0))).collect())


def test_quality_scores_against_plain_python():
    """Features found word by word, and the probabilities that follow; a long text in parts scores as in one."""
    import pyarrow as pa
    from bidlattice.llm import common

    rng = np.random.default_rng(2)
    m = quality.Model(rng.normal(size=(1 << quality.BITS) + quality.SHAPES).astype(np.float32) / 9, np.array([-1.0, 0.5]))
    text = "The *cat* sat!! THE Cat"
    h = lambda b: int(common.span_hashes(common.byte_sums(np.frombuffer(b, np.uint8)), np.array([0]), np.array([len(b)]))[0])
    want = set()
    for w in text.lower().split():
        bare = w.strip("*!").encode()
        want.add(h(bare) >> (64 - quality.BITS))
        want |= {(h(bare[:k]) + k) % (1 << 64) >> (64 - quality.BITS) for k in quality.STARTS if len(bare) > k}
    flat, at = quality.features(pa.array([text, None, ""]))
    words = [x for x in flat[: at[1]].tolist() if x < 1 << quality.BITS]
    assert sorted(words) == sorted(want) and all(np.diff(at) > 0)
    z = m.weights[flat[: at[1]]].sum(dtype=np.float64)
    assert np.abs(quality.probabilities(m, pa.array([text]))[0] - [1 / (1 + math.exp(t - z)) for t in m.thresholds]).max() < 1e-5
    long = "good words and some $$$ marks!! " * 60_000
    assert np.abs(quality.probabilities(m, pa.array([long])) - quality.probabilities(m, pa.array([long, ""]))[:1]).max() < 1e-9


def test_thresholds_are_ordered():
    rng = random.Random(0)
    rows = [(g, np.array(sorted({g * 10 + rng.randrange(5), 100 + rng.randrange(50)}))) for g in (0, 1, 2) for _ in range(60)]
    m = quality.fit(rows)
    assert (np.diff(m.thresholds) >= 0).all() and m.weights[21] > m.weights[11] > m.weights[1]


# --- 7 ---


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://www.example.com/en/701?x", ("www.example.com", "/en/701", "example.com/en/7", "allow")), ("HTTP://A.COM/en/", ("a.com", "/en/", "com/en/", "block")), ("http://a.com/en", ("a.com", "/en", None, "allow")),
        ("http://xcom/en/1", ("xcom", "/en/1", None, "allow")), ("http://b.example.net/de/8", ("b.example.net", "/de/8", "example.net/de/8", "block")), ("http://notexample.net/de/8", ("notexample.net", "/de/8", "net/de/", "allow")),
        ("http://org/es/#a", ("org", "/es/", "org/es/", "block")), ("no scheme", ("", "", None, "allow")), (None, ("", "", None, "allow")), ("", ("", "", None, "allow")), ("x://?q", ("", "", None, "allow")), ("a://b://c", ("b:", "//c", None, "allow")),
    ],
)
def test_urls(spark, url, want):
    r = urls.judge_urls(spark.createDataFrame([(1, url, "clash")], "page_id long, url string, rule string")).first()
    assert (r.host, r.path, r.rule, r.verdict) == want


def test_block_wins_for_the_same_entry():
    trie = urls.build_trie([urls.Rule("block", "a.b", "/x"), urls.Rule("allow", "a.b", "/x"), urls.Rule("allow", "b", "")])
    assert urls.longest_match(trie, "q.a.b", "/xy")[1] == "block" and urls.longest_match(trie, "c.b", "/")[0] == "b"


# --- 8 ---


def test_rake_against_plain_python(spark):
    rng = random.Random(2)
    cells = {(a, b, c): rng.randint(1, 900) for a in "pqr" for b in "xy" for c in "mn" if rng.random() < 0.9}
    targets = [{"p": 0.5, "q": 0.3, "r": 0.2}, {"x": 0.6, "y": 0.4}, {"m": 0.5, "n": 0.5}]
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "a string, b string, c string, tokens long")
    tables = {d: spark.createDataFrame(list(t.items()), f"{d} string, target double") for d, t in zip("abc", targets, strict=True)}
    got = {(r.a, r.b, r.c): r.weight for r in mixing.rake(df, tables).collect()}
    want = brute.rake(cells, targets)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_mixing(spark, odd):
    rng = random.Random(5)
    texts = [" ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(5, 300))) + (" | x" if i % 5 == 0 else "") for i in range(600)]
    d = docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 3 == 0, "de").otherwise("en"))
    out = mixing.mix_sources(d.withColumn("weight", F.lit("clash")), fraction=0.4).collect()
    tokens = sum(r.tokens for r in out)
    assert len(out) == 600 and abs(sum(r.probability * r.tokens for r in out) - 0.4 * tokens) < 1e-3 * tokens
    assert abs(sum(r.tokens for r in out if r.sampled) - 0.4 * tokens) < 0.1 * tokens
    again = {r.doc_id: r.sampled for r in mixing.mix_sources(d.repartition(9), fraction=0.4).collect()}
    assert again == {r.doc_id: r.sampled for r in out}
    edges = {r.doc_id: r for r in mixing.mix_sources(docs(spark, odd).withColumn("source", F.lit(None).cast("string"))).collect()}
    assert [(edges[i].tokens, edges[i].probability, edges[i].sampled) for i in range(3)] == [(0, 0.0, False)] * 3 and edges[8].tokens == 60_000


def test_mixing_against_plain_python(spark):
    """Probabilities and draws from brute-force weights; columns by the names of internal keys pass through."""
    rng = random.Random(8)
    texts = ["w " * rng.randint(3, 200) + (" | x" if i % 4 == 0 else "") for i in range(300)] + [None, "", " \n"]
    d = docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "de").otherwise("en")).withColumns({f"k_{c}": F.lit("mine") for c in mixing.DIMS})
    got = {r.doc_id: r for r in mixing.mix_sources(d, fraction=0.5).collect()}
    assert len(got) == len(texts) and all(r.k_source == r.k_lang == r.k_topic == "mine" for r in got.values())
    cells = Counter()
    for i, t in enumerate(texts):
        n = len(brute.WORD.findall(t or ""))
        assert got[i].tokens == n
        if n:
            cells[got[i].source, got[i].lang, got[i].topic] += n
    targets = []
    for k, power in enumerate((0.5, 0.7, 0.7)):
        share = Counter()
        for key, n in cells.items():
            share[key[k]] += n
        x = {v: n**power for v, n in share.items()}
        targets.append({v: y / sum(x.values()) for v, y in x.items()})
    w, budget = brute.rake(cells, targets), 0.5 * sum(cells.values())
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(1, mid * w[c] / n) * n for c, n in cells.items()) < budget else (low, mid)
    for i in range(300):
        c = got[i].source, got[i].lang, got[i].topic
        p = min(1.0, low * w[c] / cells[c])
        u = int(hashlib.md5(f"{i}:17".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert abs(got[i].probability - p) < 1e-4 and got[i].sampled == (u < got[i].probability)


def test_a_rake_without_solution_says_so(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 4)
    df = spark.createDataFrame([("p", "x", 5), ("q", "y", 5)], "a string, b string, tokens long")
    tables = {"a": spark.createDataFrame([("p", 0.9), ("q", 0.1)], "a string, target double"), "b": spark.createDataFrame([("x", 0.5), ("y", 0.5)], "b string, target double")}
    with pytest.warns(UserWarning, match="not settled"):
        assert mixing.rake(df, tables).count() == 2


def test_probability_is_at_most_one(spark):
    out = mixing.mix_sources(docs(spark, ["a b c"] * 9 + ["d e f " * 500]), fraction=1.0).collect()
    assert all(r.probability == 1.0 and r.sampled for r in out)


# --- 9 ---


def test_exact_duplicates(spark, odd):
    texts = odd + ["hot text"] * 300 + ["ho\ttte xt "] + [f"u{i}" for i in range(50)]
    for counters in (1, 4, 256):
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_duplicates(docs(spark, texts).repartition(5).withColumn("digest", F.lit(0)), counters).collect()}
        assert got == brute.exact(list(enumerate(texts)))
    r = exact.exact_duplicates(docs(spark, [None, "é x"])).orderBy("doc_id").collect()
    assert r[0].text_sha256 == hashlib.sha256(b"").hexdigest() and r[1].text_sha256 == hashlib.sha256("éx".encode()).hexdigest()


def test_misra_gries_keeps_every_frequent_digest():
    rng = random.Random(1)
    stream = ["h"] * 400 + [f"x{rng.randrange(5000)}" for _ in range(600)]
    rng.shuffle(stream)
    held = {}
    for a in range(0, 1000, 50):
        for k, v in Counter(stream[a : a + 50]).items():
            held[k] = held.get(k, 0) + v
        held = exact._pruned(held, 2)
        assert len(held) <= 2
    assert "h" in held


def test_exact_duplicates_of_repeated_rows_and_null_ids(spark):
    d = spark.createDataFrame([(4, "a b"), (4, "a b"), (None, "ab"), (9, "a  b")], "doc_id long, text string").withColumn("size", F.lit("mine"))
    got = sorted(((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(d).collect()), key=str)
    assert got == sorted([(4, 9, 4, False), (4, 9, 4, False), (-1, 9, 4, False), (9, 9, 4, True)], key=str)


# --- 10 ---


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(MODEL)


def paths(units, kind):
    """All segmentations of a unit with their log probabilities."""
    done, left = [], [(int(units.base[kind]), 0.0, ())]
    while left:
        node, lp, ids = left.pop()
        for e in range(int(units.edge[node]), int(units.edge[node + 1])):
            to, step = int(units.to[e]), (lp + float(units.log_q[e]), (*ids, int(units.piece[e])))
            if to < 0:
                done.append(step)
            else:
                left.append((to, *step))
    return done


def all_segmentations(v, text):
    units = pieces._Units(v, [text])
    done = [(0.0, ())]
    for k in units.kind.tolist():
        done = [(a + b, x + y) for a, x in done for b, y in paths(units, k)]
    return {ids: lp for lp, ids in done}


def test_samples_are_distinct_and_round_trip(vocabulary):
    texts = ["Hello world", " a  b\nc\t d", "日本語 x", "", None, "▁x▁ y", "\U0001f600z \x00", "q" * 3000, "a"]
    for t, drawn in zip(texts, pieces.sample_texts(vocabulary, texts, np.arange(9), 5, 1), strict=True):
        assert all(vocabulary.decode(s[2]) == t for s in drawn) and len({tuple(s[2]) for s in drawn}) == len(drawn)
        assert [s[0] for s in drawn] == sorted((s[0] for s in drawn), reverse=True) and len(drawn) == (0 if t is None else min(5, 1 if t == "" else 5, len(drawn)))


def test_every_segmentation_comes_up_once(vocabulary):
    every = all_segmentations(vocabulary, "cat")
    assert abs(sum(math.exp(lp) for lp in every.values()) - 1) < 1e-9
    drawn = pieces.sample_texts(vocabulary, ["cat"], np.array([4]), len(every) + 3, 2)[0]
    assert {tuple(s[2].tolist()) for s in drawn} == set(every)
    assert all(abs(every[tuple(s[2].tolist())] - s[1]) < 1e-9 for s in drawn)


def test_sampling_follows_the_law_without_replacement(vocabulary):
    every = all_segmentations(vocabulary, "the cat")
    p = {k: math.exp(lp) for k, lp in every.items()}
    n = 6000
    drawn = pieces.sample_texts(vocabulary, ["the cat"] * n, np.arange(n), 2, 3)
    for place in (0, 1):
        seen = Counter(tuple(d[place][2].tolist()) for d in drawn)
        for k in sorted(p, key=p.get)[-3:]:
            want = p[k] if not place else sum(q * p[k] / (1 - q) for j, q in p.items() if j != k)
            assert abs(seen[k] / n - want) < 4 * math.sqrt(want * (1 - want) / n) + 1e-3


def test_others_are_drawn_by_their_share(vocabulary):
    every = all_segmentations(vocabulary, "thecat")
    units = pieces._Units(vocabulary, ["thecat"])
    taken = [max(every, key=every.get)]
    rest = units.rest(0, taken)
    assert abs(rest - (1 - math.exp(every[taken[0]]))) < 1e-9
    seen = Counter(units.draw_other(0, np.uint64(i * 7919), taken)[1] for i in range(4000))
    assert taken[0] not in seen
    for k in sorted(every, key=every.get)[-4:-1]:
        want = math.exp(every[k]) / rest
        assert abs(seen[k] / 4000 - want) < 0.04


def test_samples_do_not_depend_on_partitions(spark):
    d = docs(spark, near_texts(4, 30) + [None, ""]).withColumn("rank", F.lit("clash"))
    a, b = (pieces.encode_samples(x, MODEL) for x in (d.coalesce(1), d.repartition(6)))
    key = lambda df: sorted((r.doc_id, r["rank"], r.score, tuple(r.ids)) for r in df.collect())
    assert key(a) == key(b)
    back = pieces.decode_samples(a, MODEL).join(d.select("doc_id", F.col("text").alias("was")), "doc_id")
    assert back.count() == 61 and back.where("text <> was").count() == 0
    assert pieces.encode_samples(d, MODEL, digest=True).where("not round_trip").count() == 0
