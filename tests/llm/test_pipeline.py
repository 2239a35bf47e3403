"""Every stage against plain Python over the same documents."""

import re

import corpus_pipeline as C
from lexmill.llm import language_id, packing, secret_scan
from tests.llm.test_operators import _brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if name != "pack":
            assert docs.columns == columns
        ids = [r.doc_id for r in after]
        if name == "language_id":
            assert sorted(ids) == sorted(r.doc_id for r in before if r.text and any(c.isalpha() for c in r.text))
        elif name == "near_duplicates":
            of = _brute_components([(r.doc_id, r.text) for r in before])
            assert sorted(ids) == sorted(i for i, c in of.items() if i == c)
        elif name == "secret_scan":
            assert {r.doc_id: r.text for r in after} == {r.doc_id: secret_scan.redacted_text(r.text) for r in before}
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "mix":
            size = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)
            assert len(set(ids)) == len(ids) < len(before) and size(after) <= 0.9 * size(before)
        else:
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            assert sum(r.length for r in after) == sum({r.doc_id: r.doc_tokens for r in after}.values())
            assert max(r.offset + r.length for r in after) <= packing.CAPACITY
        before = after


def test_stages_keep_nulls_out_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    nothing = docs.limit(0)
    for _, stage in C.STAGES[:4]:
        assert stage(spark, nothing, SF).count() == 0
    assert C.STAGES[4][1](spark, nothing, SF).count() == 0
    unlabelled = docs.limit(3).selectExpr("doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars")
    assert language_id.UNKNOWN == "und" and C.STAGES[0][1](spark, unlabelled, SF).count() == 0


def test_shared_ids_and_clashing_columns(spark):
    names = ["_id", "_copies", "_copy", "_row", "score", "lang_pred", "Lang_Pred_", "component_id", "keys"]
    text = lambda k, n=60: " ".join(f"word{k}x{j} the" for j in range(n))
    rows = [(1, text(1)), (1, text(2)), (2, text(1)), (3, text(3)), (3, text(3)), (None, text(4)), (None, text(4)), (5, text(5)), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "src1", 0, *[f"own {n}" for n in names]) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for _, stage in C.STAGES[:2]:
        docs = stage(spark, docs, SF)
    kept = sorted((str(r.doc_id), r.text.split("x")[0]) for r in docs.collect())
    assert kept == sorted([("2", "word1"), ("1", "word2"), ("3", "word3"), ("None", "word4"), ("5", "word5")])
    for _, stage in C.STAGES[2:4]:
        docs = stage(spark, docs, SF)
    assert docs.columns[5:] == names and all(r[f] == f"own {f}" for r in docs.collect() for f in names)
    assert C.STAGES[4][1](spark, docs, SF).count() > 0
