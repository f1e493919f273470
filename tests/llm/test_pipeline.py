import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from quirefold.session import materialize
from tests.llm import cases
from tests.llm.test_mixing import fill
from tests.llm.test_near import plain_components
from tests.llm.test_tokens import check_packing, whole

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def write(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    cases.labels(spark).write.parquet(f"{folder}/labels.parquet")


def test_stages_against_plain_loops(spark, tmp_path):
    """The near-duplicate, mixing and packing stages on what the stages before them kept."""
    folder = str(tmp_path)
    write(spark, folder, cases.documents(spark).where("doc_id <> 71 and doc_id is not null"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, folder))
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    before = {r.doc_id: r.text for r in seen["quality"]}
    assert {r.doc_id for r in seen["near_duplicates"]} == {i for i, (_, c) in plain_components(before).items() if c == i}
    assert {r.doc_id for r in seen["pii"]} == {r.doc_id for r in seen["near_duplicates"]}
    assert not any("@" in (r.text or "") for r in seen["pii"])
    sizes, of = Counter(), {}
    for r in seen["pii"]:
        n = len(WORD.findall(r.text or ""))
        sizes[r.source] += n
        of[r.doc_id] = n
    taken, uses = Counter(), Counter()
    for r in seen["mixing"]:
        taken[r.source] += len(WORD.findall(r.text))
        uses[r.doc_id] += 1
        assert len(r.text) == r.n_chars
    for source, target in fill(dict(sizes)).items():
        assert abs(taken[source] - target) <= 1
    assert max(uses.values()) <= 3 and all(of[i] for i in uses)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [i + [2] for i in whole(tokenizer, [r.text or "" for r in seen["mixing"]])]
    check_packing(seen["packing"], ids, 4096)


def test_odd_and_empty_tables(spark, tmp_path):
    write(spark, f"{tmp_path}/odd", cases.documents(spark))
    assert cp.run(spark, f"{tmp_path}/odd").count() > 0
    write(spark, f"{tmp_path}/none", cases.empty(spark))
    assert cp.run(spark, f"{tmp_path}/none").count() == 0


def test_repeated_rows_become_one(spark, tmp_path):
    d = cases.documents(spark).where("doc_id = 71 or doc_id is null")
    kept = cp.near_duplicates(spark, d, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in kept) == {71: 2, None: 2}
