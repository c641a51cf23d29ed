"""Each stage of the pipeline against plain Python, on its own input."""

import re
from hashlib import sha256

import numpy as np
import pytest

import corpus_pipeline as P
from barloom.llm import langid

from . import test_minhash, test_pack_and_clean, test_repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of each stage, written and read again, on a small fixture with planted cases."""
    home = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*P.COLUMNS)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    item = bench.orderBy("item_id").first().text
    rows = [(9001, None, "en", "x", None), (9002, "12 34 !!", "en", None, 8), (9003, "", None, None, 0), (9004, "Something clean before it. " + item + " and after", None, "x", 99)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    bench.write.parquet(f"{home}/benchmark.parquet")
    out = {}
    for name, f in P.STAGES:
        before = docs
        f(spark, docs, str(home)).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        out[name] = before.collect(), docs.collect()
    return out, bench.collect()


def test_columns_and_language(stages, spark):
    out, _ = stages
    for name, (_, after) in list(out.items())[:-1]:
        assert after and tuple(after[0].asDict()) == P.COLUMNS, name
    before, after = out["language_id"]
    kept = {r.doc_id: r for r in after}
    assert {9001, 9002, 9003} & set(kept) == set()
    lettered = [r for r in before if any(c.isalpha() for c in r.text or "")]
    assert set(kept) == {r.doc_id for r in lettered}
    # the label is the classifier's: a wrong one is put right, a missing one filled in
    told = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(before, DOCS), langid.sample(spark.createDataFrame(before, DOCS).where(~langid.held_out()))).collect()}
    assert all(tuple(kept[r.doc_id]) == (r.doc_id, r.text, told[r.doc_id], r.source, r.n_chars) for r in lettered)


def test_wrong_label_is_put_right(spark):
    rows = [(i, f"the {w} of the house was on the table and the door", "en", None, None) for i, w in enumerate("cat dog boy key book ball shoe cup".split())]
    rows += [(20 + i, f"der {w} von dem Haus war auf dem Tisch und die Tür", "de", None, None) for i, w in enumerate("Hund Mann Ball Schuh Topf Baum Ring Stein".split())]
    rows += [(97, "und die Tür von dem Haus war auf dem Tisch", "en", None, None), (95, "der Baum und die Tür", None, None, None)]
    got = {r.doc_id: r.lang for r in P.language_id(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert got == {**{i: "en" for i in range(8)}, **{20 + i: "de" for i in range(8)}, 95: "de", 97: "de"}


def test_near_dedup(stages):
    before, after = stages[0]["near_dedup"]
    want = test_minhash.brute([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(after) == sorted(r for r in before if want[r.doc_id][2])


def test_substring_dedup(stages):
    before, after = stages[0]["substring_dedup"]
    want = test_repeats.brute_words(sorted((r.doc_id, r.text) for r in before), 20)
    old = {r.doc_id: r for r in before}
    assert len(after) == len(before)
    for r in after:
        assert sha256(" ".join(WORD.findall(r.text)).encode()).hexdigest() == want[r.doc_id][2]
        if not want[r.doc_id][1]:
            assert r == old[r.doc_id]
        else:
            assert r.n_chars == len(r.text)


def test_decontamination(stages):
    before, after = stages[0]["decontamination"]
    kept = {r.doc_id for r in after}
    assert 9004 not in kept and all(r in before for r in after)
    some = [(r.doc_id, r.text) for r in before][:40] + [(r.doc_id, r.text) for r in before if r.doc_id == 9004]
    bad = {d for d, _ in test_pack_and_clean.brute(some, [(r.item_id, r.text) for r in stages[1]])}
    assert {d for d, _ in some} - kept == bad


def test_token_ids(stages):
    before, after = stages[0]["token_ids"]
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.n_tokens and sha256(r.ids).hexdigest() == r.ids_sha256
        assert sha256((texts[r.doc_id] or "").encode()).hexdigest() == r.decoded_sha256


def test_run(spark):
    got = P.run(spark, "/root/testdata/sf0.001")
    assert got.columns[0] == "doc_id" and got.count() > 50


def test_stages_take_empty_tables_and_nulls(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    for name, f in P.STAGES:
        assert f(spark, empty, "/root/testdata/sf0.001").count() == 0, name
    rows = spark.createDataFrame([(None, "no id but words", None, None, None), (1, None, None, None, None), (2, "words again", "en", None, None)], schema)
    for name, f in P.STAGES[1:]:
        assert f(spark, rows, "/root/testdata/sf0.001").count() == 3, name
    assert {r.doc_id for r in P.language_id(spark, rows, "").collect()} == {None, 2}
