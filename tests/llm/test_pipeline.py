import corpus_pipeline
from tessaline.llm.common import table
from tessaline.llm.queries import vocabulary
from tests.llm import cases
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_minhash import plain as plain_groups
from tests.llm.test_packing import hold


def rows_of(df):
    return {r["doc_id"]: tuple(r) for r in df.collect()}


def test_stages(spark, sf_dir, tmp_path):
    """Each stage against a plain version, on what its predecessor kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "lines", "near_duplicates", "packing"]
    docs, kept = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
    first, language, toxic, lines, near = (rows_of(d) for d in (table(spark, sf_dir, "documents"), *kept[:4]))
    assert all(d.columns == corpus_pipeline.COLUMNS for d in kept[:4])
    assert language == {i: r for i, r in first.items() if any(c.isalpha() for c in r[1] or "")}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf_dir, "labels").collect()}
    gone = language.keys() - toxic.keys()
    assert toxic == {i: language[i] for i in toxic} and gone
    assert sum(labels.get(i) == 0 for i in gone) <= 0.1 * sum(v == 0 for v in labels.values())
    assert sum(labels.get(i) == 1 for i in gone) >= 0.9 * sum(v == 1 and i in language for i, v in labels.items())
    assert {i: r[1] for i, r in lines.items()} == {i: t for i, _, _, t in plain_lines([(i, r[1]) for i, r in toxic.items()])}
    assert all(r[4] == len(r[1]) or r[1] == toxic[i][1] and r[4] == toxic[i][4] for i, r in lines.items())
    want = plain_groups([(i, r[1]) for i, r in lines.items()], 5, 80)
    assert near == {i: lines[i] for i, (_, c) in want.items() if c == i}
    hold(cases.fetch(kept[4], "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"), {i: r[1] for i, r in near.items()})


def test_odd_rows(spark, sf_dir):
    for docs in (cases.docs(spark, extra=True), cases.empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.count() <= 10 * len(cases.TEXTS)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and vocabulary("byte_bpe_50k.json").endswith(".json")
