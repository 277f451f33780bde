"""The pipeline against a plain version of each stage on what the stage before kept."""

import re

import corpus_pipeline
from panelforge.llm import mixing, toxicity
from panelforge.llm.queries import vocabulary

from tests.llm import fixtures
from tests.llm.test_python import brute_links

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_jaccard", "source_mix", "bpe"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
        given = before.collect()
        ids = sorted(r.doc_id for r in kept[name])
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            scores = toxicity.score(before, model).collect()
            assert ids == sorted(r.doc_id for r in scores if r.score < 0.5) and len(ids) > 0.7 * len(given)
        elif name == "exact_dedup":
            first = {}
            for r in given:
                n = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
                first[n] = min(first.get(n, r.doc_id), r.doc_id)
            assert ids == sorted(first.values())
        elif name == "ngram_jaccard":
            assert ids == sorted(i for i, c, *_ in brute_links([(r.doc_id, r.text) for r in given]) if i == c)
        elif name == "source_mix":
            plan = {r.doc_id: r.copies for r in mixing.mix_sources(before).collect()}
            assert ids == sorted(i for i, n in plan.items() for _ in range(n))
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(vocabulary())
            assert len(kept[name]) == len(given)
            assert all(list(r.token_ids) == library.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.token_ids) for r in kept[name])


def test_run_gives_the_last_stages_rows(spark):
    a, b = (sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert a == b and len(a) > 0


def test_stages_take_awkward_rows_and_empty_tables(spark):
    """Clashing names keep their values, whatever a stage calls its own columns."""
    given = fixtures.docs(spark)
    for empty, docs in ((False, given), (True, given.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            rows = out.collect()
            assert set(docs.columns) <= set(out.columns) and bool(rows) != empty
            own = {"token_ids", "n_tokens", "decoded"} if name == "bpe" else set()
            assert all(r[n] == "z" for r in rows for n in given.columns[5:] if n not in own)
            docs = out.select(*docs.columns) if name != "bpe" else docs
