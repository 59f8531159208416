import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexarium.functions import distance as D
from lexarium.functions import strings as S
from lexarium.operators import evaluation as E
from lexarium.operators import learning as L
from lexarium.operators import matrix as M
from lexarium.operators import mining
from lexarium.operators import retrieval as R
from lexarium.operators import string_search as P
from lexarium.sources import readers, sinks


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("x")).first().x


@pytest.mark.parametrize(("f", "value", "want"), [
    (S.mask_numbers, "a 1,234.56 b 7", "a <N4_2> b <N1>"), (S.normalize_spaces, " a \n\t b ", "a b"), (S.normalize_punctuation, "a--b, c", "a b c"), (S.decode_entities, "&lt;a&gt; &amp;&nbsp;&apos;", "<a> &'"),
    (S.separate_hangul, "abc한글def", "abc 한글 def"), (S.separate_brackets, "a(b)c", "a ( b ) c"), (S.tidy_word, "---", ""), (S.tidy_word, "Don't!", "dont"), (S.strip_parens, "a (b) c", "a c"), (S.null_markers, " NULL", None),
    (S.strip_wiki, "'''A''' [[b|c]] {{x}}<ref>y</ref> == H ==", "A c H"), (S.escape_regex, "a[b]", r"a\[b\]"), (lambda c: S.tagged(c, 1), "a/N b/c/V", ["N", "V"]), (lambda c: S.tagged(c, 0), "a/N b/c/V", ["a", "b/c"]),
    (lambda c: S.segments(c, 3), "abcdefgh", ["ab", "cde", "fgh"]), (lambda c: S.organization_name(c, {"Univ": "University"}), "Foo Univ., Co., Ltd.", "Foo University Co., Ltd."),
])
def test_strings(spark, f, value, want):
    assert one(spark, f, value) == want


def test_organization_parts(spark):
    got = one(spark, S.organization_parts, "Dept of Physics, School of Science, Some University, Seoul")
    assert [(g.kind, g.text) for g in got] == [("university", "Some University"), ("school", "School of Science"), ("department", "Dept of Physics")]


def test_distances():
    assert D.damerau("CA", "ABC") == 2 and D.damerau("abcd", "acbd") == 1
    assert D.smith_waterman("MCCOHN", "COHEN") == 7 and D.smith_waterman_similarity("MCCOHN", "COHEN") == 0.7
    assert D.needleman_wunsch("MCCOHN", "COHEN") == -3 and D.smith_waterman("ABCDE", "FABCGG") == 6
    assert D.substring_distance("om", "beca") == 2 and D.substring_distance("ot", "yoytu") == 1
    assert D.align("MCCOHN", "COHEN") == ("COH#N", "COHEN", "MMMUM")
    assert D.affine_gap("abc", "abc") == 6 and D.affine_gap("abc", "abxxc") == 3
    assert D.smith_waterman([1, 2, 3], [2, 3]) == 4


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_damerau_is_a_metric_below_levenshtein(a, b):
    assert D.damerau(a, b) == D.damerau(b, a)
    assert (D.damerau(a, b) == 0) == (a == b)
    assert abs(len(a) - len(b)) <= D.damerau(a, b) <= max(len(a), len(b))


def test_similarity_search(spark):
    strings = ["imyouteca", "ubuntucom", "utubbecou", "youtbecom", "yoytubeca", "", "a", "ab", "yotubecom"]
    s = spark.createDataFrame(list(enumerate(strings)), "sid long, s string")
    q = spark.createDataFrame([(0, "yotubecom"), (1, ""), (2, "b")], "qid long, q string")
    got = {(r.qid, strings[r.sid], r.distance) for r in P.search(q, s, 2, 2).collect()}
    assert got == {(0, "youtbecom", 2), (0, "yotubecom", 0), (1, "", 0), (1, "a", 1), (1, "ab", 2), (2, "", 1), (2, "a", 1), (2, "ab", 1)}


def test_metrics(spark):
    rels = [3, 2, 3, 0, 1, 2]
    run = spark.createDataFrame([("q", f"d{i}", i + 1) for i in range(6)], "qid string, doc string, rank int")
    qrels = spark.createDataFrame([("q", f"d{i}", r) for i, r in enumerate(rels)], "qid string, doc string, rel int")
    m = E.per_query(run, qrels, 6).first()
    dcg = lambda x: sum((2**r - 1) / math.log2(i + 2) for i, r in enumerate(x))
    assert math.isclose(m.ndcg, dcg(rels) / dcg(sorted(rels, reverse=True)))
    assert math.isclose(m.ndcg, 0.948810749, abs_tol=1e-8)
    ranks = {1: 3, 2: 2, 5: 1, 11: 1, 17: 1}
    run = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 21)], "qid string, doc string, rank int")
    qrels = spark.createDataFrame([("q", f"d{i}", r) for i, r in ranks.items()], "qid string, doc string, rel int")
    m = E.per_query(run, qrels, 5).first()
    assert (m.precision, round(m.ap, 9)) == (0.6, 0.866666667) and abs(m.ndcg - 0.987953882) < 1e-6
    ranks = {1: 1, 2: 1, 6: 1, 11: 1, 17: 1}
    qrels = spark.createDataFrame([("q", f"d{i}", r) for i, r in ranks.items()], "qid string, doc string, rel int")
    assert abs(E.per_query(run, qrels, 20).first().rbp - 0.452640336) < 1e-8


def test_sequences_of_the_toy_rows(spark):
    data = ["A B C D E", "A B", "C D", "A B C", "C D E"]
    df = spark.createDataFrame([(i, x.split()) for i, x in enumerate(data)], "sid int, items array<string>")
    got = {("".join(r.pattern), r.n) for r in mining.frequent_sequences(df, 3).collect()}
    assert got == {("A", 3), ("B", 3), ("C", 4), ("D", 3), ("AB", 3), ("CD", 3)}


def test_abbreviations():
    text = "The World Health Organization (WHO) and magnetic resonance imaging (MRI); see (2) and heat shock protein (HSP, old)."
    assert list(mining.abbreviation_pairs(text)) == [("WHO", "World Health Organization"), ("MRI", "magnetic resonance imaging"), ("HSP", "heat shock protein")]


def test_matrices(spark):
    a = np.array([[2.0, 1, 0], [1, 3, 1], [0, 1, 4]])
    m = M.rows(spark, a)
    assert math.isclose(M.determinant(m), np.linalg.det(a)) and M.rank(m) == 3
    assert np.allclose(M.dense(M.product(m, M.inverse(m))), np.eye(3)) and np.allclose(M.dense(M.power(m, 3)), a @ a @ a)
    low, up = M.lu(m)
    assert np.allclose(M.dense(low) @ M.dense(up), a) and np.allclose(M.solve(m, [1, 2, 3]), np.linalg.solve(a, [1, 2, 3]))
    q, r = M.qr(m)
    assert np.allclose(M.dense(q) @ M.dense(r), a) and np.allclose(M.eigenvalues(m), sorted(np.linalg.eigvalsh(a), reverse=True))


def test_random_walk_sums_to_one(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 1.0)], "src string, dst string, w double")
    got = {r.node: r.score for r in R.random_walk(edges, 8).collect()}
    assert math.isclose(sum(got.values()), 1) and got["c"] > got["b"] > got["a"]


def test_mixed_collections_are_a_distribution(spark):
    docs = spark.createDataFrame([(i, f"alpha beta {'gamma' if i % 2 else 'delta'} w{i}", i % 2) for i in range(12)], "doc_id long, text string, c int")
    model = R.query_model(spark.createDataFrame([(1, "alpha gamma"), (2, "delta")], "qid long, text string"))
    got = R.collections_model([R.Index(docs.where("c = 0")), R.Index(docs.where("c = 1"))], model, 3, 5).groupBy("qid").agg(F.sum("p").alias("s")).collect()
    assert {r.qid for r in got} == {1, 2} and all(math.isclose(r.s, 1) for r in got)


def test_learners_fit_their_data(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "label", F.col("embedding").alias("v"))
    for f in (L.svm, L.network):
        hit = f(e, "vec_id").join(e, "vec_id").agg(F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()[0]
        assert hit > 0.3


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert [r.lines for r in readers.blocks(spark, put("b", "a\nb\n\nc\n")).collect()] == [["a", "b"], ["c"]]
    t = readers.tagged(spark, put("t", ".I 1\n.B\nold man\n.W\nneeds x\n.I 2\n.W\ny\nz\n")).collect()
    assert [(r.id, r.fields) for r in t] == [("1", {"B": "old man", "W": "needs x"}), ("2", {"W": "y\nz"})]
    assert [tuple(r) for r in readers.judgments(spark, put("q", "1 0 d1 2\n1 0 d2 0\n")).collect()] == [("1", "d1", 2.0), ("1", "d2", 0.0)]
    assert [tuple(r) for r in readers.judgments(spark, put("j", "1 u1 7 d d d\n1 u2 8 d p\n"), "judged").collect()] == [("1", "7", 2.0)]
    assert [tuple(r) for r in readers.judgments(spark, put("l", "# x\n1 d1 a b RELEVANT\n1 d2 a b NOT\n"), "labelled").collect()] == [("1", "d1", 1.0), ("1", "d2", 0.0)]
    assert readers.tsv(spark, put("s", "a\tnull\tx<NL>y\n"), "p", "q", "r").first() == ("a", None, "x\ny")
    assert readers.fixed_width_topics(spark, put("f", "101 some text\n")).first() == ("101", "some text")
    x = readers.topics(spark, put("x.xml", '<topics><topic number="1" type="d"><description>D</description><summary>S</summary></topic></topics>')).first()
    assert (x.qid, x.type, x.description, x.summary, x.diagnosis) == ("1", "d", "D", "S", None)
    w = readers.wiki_pages(spark, put("w.xml", "<m><page><title>A</title><revision><text>#REDIRECT [[B]]</text></revision></page></m>")).first()
    assert (w.title, w.redirect) == ("A", "B")
    assert readers.sgml_documents(spark, put("g", "<DOC><DOCNO> N1 </DOCNO><TEXT>a <b>c</b></TEXT></DOC>\n<DOC><DOCNO>N2</DOCNO>z</DOC>\n")).collect() == [("N1", "a c"), ("N2", "z")]
    c = readers.crawl_dump(spark, put("c", "#UID:u1\n#DATE:d\n#URL:http://x\n#CONTENT:<p>hi</p>\n#EOR\n")).first()
    assert tuple(c) == ("u1", "d", "http://x", "hi")
    svm = sinks.svm_lines(spark.createDataFrame([(1, [0.0, 0.5])], "label int, v array<double>")).first().value
    assert svm == "1 2:0.500000"


def test_entry_point_registers_everything():
    import __spark_entry__ as entry

    assert len(entry.queries()) > 100 and set(entry.oracle_sql()) <= set(entry.queries())


def test_porter_stems():
    from lexarium.functions.stemming import porter

    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "digitizer": "digit", "vietnamization": "vietnam", "hopefulness": "hope", "sensibiliti": "sensibl", "formalize": "formal", "electrical": "electr", "revival": "reviv", "replacement": "replac", "adoption": "adopt", "communism": "commun", "rate": "rate", "cease": "ceas", "controll": "control", "is": "is"}
    assert {w: porter(w) for w in want} == want


def test_optimal_pivots_equal_all_choices():
    import itertools
    import random

    from lexarium.operators.gram_models import best_pivots

    rng = random.Random(1)
    for _ in range(200):
        starts, q, k = [rng.randrange(12) for _ in range(rng.randint(0, 9))], rng.randint(1, 3), rng.randint(1, 3)
        w = [rng.random() for _ in starts]
        sets = [c for c in itertools.combinations(range(len(starts)), k) if all(abs(starts[a] - starts[b]) >= q for a, b in itertools.combinations(c, 2))]
        got = best_pivots(starts, w, q, k)
        if sets:
            assert abs(sum(w[i] for i in got) - min(sum(w[i] for i in c) for c in sets)) < 1e-9
        else:
            assert got == []


def test_huffman_codes_are_prefix_free_and_optimal():
    from lexarium.operators.gram_models import huffman

    counts = [5, 9, 12, 13, 16, 45]
    codes, points = huffman(counts)
    assert sum(c * len(x) for c, x in zip(counts, codes, strict=True)) == 224
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)
    assert [len(p) for p in points] == [len(c) for c in codes] and all(p[0] == len(counts) - 2 for p in points)


def test_weighted_alignment_and_respacing():
    from lexarium.operators.gram_models import respaced, weighted_local

    assert weighted_local("abc", "abc", {}) == 6 and weighted_local("abc", "xyz", {}) == 0
    assert abs(weighted_local("ab", "ab", {"a": 1.0}) - (2 * 2.718281828459045 + 2)) < 1e-9
    assert abs(weighted_local("axb", "ab", {"x": 0.0}) - 3) < 1e-9
    assert respaced("ab", {("a", " "): 0.9, ("a", "b"): 0.1}) == "a b" and respaced("ab", {}) == "ab"


def test_online_centroids_mend_a_mistake():
    import numpy as np

    from lexarium.operators.gram_models import updated_centroids

    x, y = np.array([[1.0, 0.2], [0.9, 0.1], [0.1, 1.0]]), np.array([0, 0, 1])
    start = np.array([[0.0, 1.0], [1.0, 0.0]])
    c = updated_centroids(x, y, start, rate=0.5, rounds=10)
    s = x @ c.T / np.linalg.norm(c, axis=1)
    assert (s.argmax(1) == y).all()


def test_settings_of_a_run_name():
    from lexarium.operators.records import Settings

    s = Settings.parse("cbeem_100_10_5_25_1500.0_0.4_true")
    assert (s.top_k, s.fb_iters, s.fb_docs, s.fb_words, s.mu, s.mix_coll, s.doc_prior, s.mix_fb) == (100, 10, 5, 25, 1500.0, 0.4, True, 0.5)


def test_index_opens_again(spark, tmp_path):
    from lexarium.operators.retrieval import Index

    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None), (1, "c")], "doc_id long, text string")
    Index(docs, path=f"{tmp_path}/index")
    i = Index.load(spark, f"{tmp_path}/index")
    assert sorted(tuple(r) for r in i.post.collect()) == [(1, "a", 2, 4, 3), (1, "b", 1, 4, 3), (1, "c", 1, 4, 3), (2, "b", 1, 1, 1)]
    assert tuple(i.total.first()) == (2, 5, 4)


def test_clusters_of_copies_and_pairs(spark):
    from lexarium.operators.mining import centroid_clusters

    rows = [(i, [1.0, 0.0]) for i in range(5)] + [(10, [0.96, 0.28]), (20, [0.0, 1.0]), (21, [0.0, 1.0])]
    got = dict(tuple(r) for r in centroid_clusters(spark.createDataFrame(rows, "id long, v array<double>"), 0.9).collect())
    assert {got[i] for i in (0, 1, 2, 3, 4, 10)} == {0} and got[20] == got[21] == 20


def test_file_operations(spark, tmp_path):
    from lexarium.sources import files

    root = f"file://{tmp_path}"
    assert files.make(spark, f"{root}/a/b")
    (tmp_path / "a/b/x.txt").write_text("12345")
    assert files.copy(spark, f"{root}/a/b/x.txt", f"{root}/a/y.txt") and files.move(spark, f"{root}/a/y.txt", f"{root}/z.txt")
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in files.listing(spark, root).collect() if r.path.endswith(".txt")] == [("x.txt", 5), ("z.txt", 5)]
    assert files.remove(spark, f"{root}/a") and not files.remove(spark, f"{root}/a")


def test_cbow_puts_words_of_one_context_together(spark):
    import random

    import numpy as np

    from lexarium.operators.learning import cbow

    rng = random.Random(2)
    groups = [["sun", "sea", "sand", "beach"], ["bank", "loan", "rate", "bond"]]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(groups[i % 2], k=12))) for i in range(200)], "doc_id long, text string")
    v = {r.word: np.array(r.vector) for r in cbow(docs, size=12, rounds=4, rate=0.2).collect()}
    cos = lambda a, b: v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])
    assert cos("sun", "sea") > cos("sun", "loan") and cos("bank", "bond") > cos("bank", "sand")
    assert cbow(docs.limit(0)).count() == 0
