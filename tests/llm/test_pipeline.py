"""The pipeline against plain versions of its stages."""

import base64

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from indicata.llm import bpe, queries, secret_scan, simhash, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_columns_and_count_down(spark, documents):
    docs, sizes = documents, [documents.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        sizes.append(docs.count())
        if name != "tokens":
            assert docs.columns == COLUMNS
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] // 2
    assert docs.columns == ["doc_id", "n_tokens", "ids"]


def test_run_equals_its_stages(spark, documents):
    docs = documents
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in toxicity.score(docs, model).where("score < 0.7").collect()}
    docs = documents.where(documents.doc_id.isin(*kept))
    groups = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    kept = {i for i, c in groups.items() if i == c}
    from indicata.llm import decontamination

    bad = {r.doc_id for r in decontamination.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r.contaminated}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == kept - bad
    # masked texts and token ids, by the tokenizer's own library
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    scanner = secret_scan.Scanner(secret_scan.rank_file(public_tokenizers.path(secret_scan.VOCABULARY)))
    for r in documents.collect():
        if r.doc_id in got:
            text, last = r.text or "", len(r.text or "") + 1
            groups = []
            for a, b, _ in scanner.spans(text.encode())[1]:
                if groups and a < groups[-1][1]:
                    groups[-1] = groups[-1][0], max(b, groups[-1][1])
                else:
                    groups.append((a, b))
            for a, b in reversed(groups):
                assert b <= last
                text, last = text[:a] + "[SECRET]" + text[b:], a
            assert got[r.doc_id] == " ".join(map(str, encoding.encode_ordinary(text)))


def test_odd_documents(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "some words of a text", "en", "s", 3), (4, "x" * 50_000, "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    got = {r.doc_id: r.n_tokens for r in docs.collect()}
    assert got[1] == 0 and set(got) == {None, 1, 4}
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


@pytest.mark.parametrize("name", list(queries.queries()))
def test_queries_run(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.count() > 0
