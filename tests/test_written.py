"""What is shuffled and written where texts and answers grow."""

import numpy as np

from ratemill.operators import hooks as H


def test_a_block_asks_for_a_word_once_and_sums_are_those_of_all_its_texts(spark):
    """Before, every word of every text was a row to join, and its vector a row to shuffle."""
    rng = np.random.default_rng(3)
    texts = [(f"t{i}", [str(w) for w in rng.choice([f"w{k}" for k in range(30)], 12, replace=False)]) for i in range(90)] + [("own", ["nowhere"])]
    df = spark.createDataFrame(texts, "_text string, _words array<string>").repartition(2)
    units = {f"w{k}": [int(u) for u in rng.integers(-9, 9, 3)] for k in range(28)}
    table = spark.createDataFrame(list(units.items()), "word string, units array<long>")
    wanted = {t: list(map(int, sum((np.array(units.get(w, [0, 0, 0])) for w in words), np.zeros(3, int)))) for t, words in texts}
    for most in (1, 50, 100_000):
        blocks = H.word_blocks(df, most).localCheckpoint()
        rows = blocks.collect()
        assert all(len(set(r["words"])) == len(r["words"]) and len(r["starts"]) == len(r["texts"]) + 1 for r in rows)
        assert len({r["block"] for r in rows}) == len(rows) and sum(len(r["columns"]) for r in rows) == 90 * 12 + 1
        found = H.block_sums(blocks, table, 3).collect()
        assert len(found) == 91 and {r["_text"]: r["_sums"] for r in found} == wanted
    assert sum(len(r["words"]) for r in rows) <= 2 * 31


def test_raw_outputs_are_written_packed(spark, tmp_path, monkeypatch):
    """Before, plain text: about 260 bytes an answer."""
    from workload import texts

    line = "id AS l_orderkey, 1 AS l_linenumber, CAST(id % 50 AS DOUBLE) AS l_quantity, 0.01D AS l_tax"
    spark.range(2000).selectExpr(*line.split(", ")).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(texts, "scratch_path", lambda spark, name: str(tmp_path / name))
    found = {(r["bootstrap_id"], r["fold"]): r["n"] for r in texts.read_outputs(spark, str(tmp_path)).collect()}
    assert found == {(b, f): 400 for b in range(2) for f in range(5)}
    files = [f for f in (tmp_path / "outputs").iterdir() if f.name.startswith("part")]
    assert files and all(f.name.endswith(".gz") for f in files) and sum(f.stat().st_size for f in files) < 4000 * 26
