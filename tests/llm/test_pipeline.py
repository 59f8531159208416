import random

from tests.llm.test_jaccard_join import shingles
from tests.llm.test_suffix_dedup import brute as repeats


def fixture():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(2000)]
    passage = " ".join(rng.choices(words, k=60))
    rows = []
    for i in range(60):
        rows.append([i, "\n".join(" ".join(rng.choices(words, k=15)) for _ in range(6)), "en", f"src{i % 4}"])
    for i in range(60, 70):  # near copies of a document
        w = rows[i % 3][1].split(" ")
        w[rng.randrange(len(w))] = "new"
        rows.append([i, " ".join(w), "en", "src0"])
    for i in (20, 30, 40):
        rows[i][1] += "\n" + passage
    rows.append([70, "too short", "en", "src1"])
    rows.append([71, "again and again " * 40, "en", "src1"])
    return [(*r, len(r[1])) for r in rows], passage


def test_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    rows, passage = fixture()
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = p.rules(spark, docs, str(tmp_path))
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == set(range(70))
    ones = p.near_duplicates(spark, kept, str(tmp_path))
    left = {r.doc_id: r.text for r in ones.collect()}
    sets = {r.doc_id: shingles(r.text, 5) for r in kept.collect()}
    parent = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = parent[i], parent[j]
                parent = {k: min(a, b) if v in (a, b) else v for k, v in parent.items()}
    assert set(left) == {i for i, c in parent.items() if i == c}
    assert set(range(60)) <= set(left)  # clean documents stay
    clean = p.repeated_passages(spark, ones, str(tmp_path))
    found = {r.doc_id: r.text for r in clean.collect()}
    order = sorted(left)
    want = dict(zip(order, repeats([left[i].encode() for i in order], p.REPEAT_BYTES), strict=True))
    assert all(len(found[i].encode()) == want[i][0] - want[i][1] for i in order)
    assert not any(passage in t for t in found.values()) and found[1] == left[1]
    mixed = p.mixture(spark, clean, str(tmp_path))
    assert mixed.columns == columns and sorted(map(tuple, mixed.collect())) == sorted(map(tuple, clean.collect()))
    out = p.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(left)
    fill = {}
    for r in out:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 1200)
    assert [n for n, _ in p.STAGES] == ["quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "pfair_mixing", "best_fit_packing"]


def test_stages_with_odd_rows_and_clashing_columns(spark):
    import corpus_pipeline as p

    extra = {c: 1 for c in ("_text", "_ka", "row", "_slot", "_spans", "u", "component_id", "kept", "0")}
    rows = [(1, "words " * 30, "s"), (1, "words " * 30, "s"), (None, " ".join(f"n{i}" for i in range(40)), None), (2, None, "s"), (3, "", ""), (4, " ".join(f"long{i}" for i in range(30000)), "s")]
    schema = "doc_id long, text string, source string, lang string, " + ", ".join(f"`{c}` int" for c in extra)
    docs = spark.createDataFrame([(*r, None, *extra.values()) for r in rows], schema)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        got = sorted(str(r.doc_id) for r in out.collect())
        assert got == (["4", "None"] if name == "quality_rules" else sorted(str(r[0]) for r in rows)), name
        assert stage(spark, docs.limit(0), "").count() == 0
    assert {r.doc_id for r in p.packed(spark, docs, "").collect()} == {1, 2, 3, 4, None}


def test_packed_sequences_follow_the_mixture(spark):
    import corpus_pipeline as p
    from lexarium.llm import packing

    share = {"src0": 0.2, "src1": 0.1, "src2": 0.35, "src3": 0.35}
    rng = random.Random(8)
    rows = [(s, 10 * k + rng.randint(3, 9)) for k, (s, w) in enumerate(share.items()) for _ in range(int(w * 6400))]  # lengths tell the source
    docs = spark.createDataFrame([(i, "word " * n, s) for i, (s, n) in enumerate(rows)], "doc_id long, text string, source string")
    out = sorted(p.packed(spark, docs, "").collect(), key=lambda r: (r.sequence_id, r.offset))
    assert sorted(r.doc_id for r in out) == list(range(6400)) and {r.sequence_id for r in out} == set(range(out[-1].sequence_id + 1))
    ends, done = {}, dict.fromkeys(share, 0)
    for k, r in enumerate(out, 1):
        assert r.offset == ends.get(r.sequence_id, 0) and r.offset + r.length <= 2048
        ends[r.sequence_id] = r.offset + r.length
        done[rows[r.doc_id][0]] += 1
        assert all(abs(done[s] - w * k) < 64 * packing.WINDOW for s, w in share.items())
        if k % (64 * packing.WINDOW) == 0:  # a window is whole
            assert all(abs(done[s] - w * k) < 64 for s, w in share.items())


def test_odd_rows_and_an_empty_table(spark, tmp_path):
    import corpus_pipeline as p

    rows, _ = fixture()
    odd = [(None, rows[1][1] + " no id", "en", "src0", None), (100, None, None, None, 0), (101, "", "en", "", 0), (102, rows[2][1], None, None, 1), (102, rows[2][1], None, None, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    spark.createDataFrame(rows + odd, schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    out = p.run(spark, f"{tmp_path}/a")
    ids = {r.doc_id for r in out.collect()}
    assert None in ids and 100 not in ids and 101 not in ids and 102 not in ids and 2 in ids
    empty = p.run(spark, f"{tmp_path}/b")
    assert empty.columns == out.columns and empty.count() == 0
