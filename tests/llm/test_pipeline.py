"""The stages one after the other on a small table."""

import pytest

import corpus_pipeline
from thalweg.llm import linededup, packing

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        count = docs.count()
        assert 0 < count <= before or name == "pack", name
        before = count
    assert {r[0] for r in docs.select("bin_size").distinct().collect()} <= set(packing.CAPACITIES)


def test_oracle_is_declared():
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "line_dedup", "near_dedup", "decontaminate", "pack"]


WORDS = "the river carries water from the hills to the sea and turns the mill on its way past fields where people work until dusk".split()
PROSE = " ".join(f"{WORDS[k * 7 % len(WORDS)]} {WORDS[k * 5 % len(WORDS)]}" for k in range(120)) + "."
ODD = [
    (1, PROSE), (1, PROSE), (2, None), (3, ""), (4, " \n "), (None, PROSE + " one more"), (None, "another text without an id, quite unlike the others"), (5, "line\n" * 40_000),
    (6, "short"), (2**53 + 1, PROSE.replace("river", "brook")),
]


def odd_table(spark, rows):
    names = ["_runs", "_mark", "score", "fp", "key", "node"]
    return spark.createDataFrame([(i, t, "en", None, None, *names) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_stages_on_odd_tables(spark, tmp_path, rows):
    docs = odd_table(spark, rows).coalesce(2)
    ids = {i for i, _ in rows}
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert name == "pack" or out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(str(tmp_path / name))
        got[name] = spark.read.parquet(str(tmp_path / name)).collect()
        assert {r["doc_id"] for r in got[name]} <= ids
    if not rows:
        assert not any(got.values())
        return
    assert len(got["line_dedup"]) == len(rows) and len(got["decontaminate"]) == len(rows)
    assert sum(r["text"] is None for r in got["line_dedup"]) == 1
    near = got["near_dedup"]
    assert sorted(str(r["doc_id"]) for r in near) == sorted(["1", "2", "5", "6", "None", *([] if len(near) == 5 else [str(2**53 + 1)])])
    assert {r["doc_id"] for r in got["pack"]} == ids and sum(r["n_tokens"] for r in got["pack"]) == sum(len((t or "").split()) + 1 for _, t in rows)


def test_a_stage_leaves_the_tables_of_others(spark, tmp_path):
    docs = odd_table(spark, ODD)
    waiting = linededup.line_dedup(docs)  # not written yet: its scratch tables must outlive the stages
    corpus_pipeline.STAGES[1][1](spark, docs, DATA).write.parquet(str(tmp_path / "a"))
    corpus_pipeline.STAGES[4][1](spark, docs, DATA).write.parquet(str(tmp_path / "b"))
    assert waiting.count() == len(ODD)
