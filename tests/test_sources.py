"""Text formats and tables, written and read again; and the incremental counts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quern.sources import files, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_graphs(spark, tmp_path):
    root = tmp_path / "in"
    put(root / "a_cfg_graph_indicator.txt", "1\n1\n2\n")
    put(root / "a_cfg_node_attributes.txt", "push rbp\nret\nnop\n")
    put(root / "a_cfg_A.txt", "1,2\n2,1\n3,3\n")
    put(root / "a_cfg_graph_labels.txt", "first_name\nsecond\n")
    put(root / "raw_a_cfg_graph_labels.txt", "x\ny\n")
    put(root / "a_inst.txt", "push rbp\tret\t\nnop\t\n")
    g = files.graphs(spark, str(root))
    nodes = {(r["node_id"], r["graph_id"], r["text"]) for r in g.nodes.collect()}
    assert nodes == {(1, 1, "push rbp"), (2, 1, "ret"), (3, 2, "nop")}
    assert {(r["graph_id"], r["src"], r["dst"]) for r in g.edges.collect()} == {(1, 1, 2), (1, 2, 1), (2, 3, 3)}
    assert {(r["graph_id"], r["label"]) for r in g.labels.collect()} == {(1, "first_name"), (2, "second")}
    assert {(r["graph_id"], r["pos"], r["text"]) for r in g.instructions.collect()} == {(1, 0, "push rbp"), (1, 1, "ret"), (2, 0, "nop")}
    sinks.write_graphs(g, str(tmp_path / "out"), "a")
    line = lambda end: [r["value"] for r in spark.read.text(f"{tmp_path}/out/a{end}").collect()]
    assert line(files.INDICATOR) == ["1", "1", "2"] and line(files.EDGES) == ["1,2", "2,1", "3,3"] and line(files.INSTRUCTIONS) == ["push rbp\tret", "nop"]
    put(root / "a_cfg_graph_labels.txt", "only\n")
    with pytest.raises(ValueError, match="labels"):
        files.graphs(spark, str(root))


def test_numbered_graphs(spark):
    nodes = spark.createDataFrame([(7, 10, "a"), (7, 20, "b"), (9, 5, "c"), (9, 6, "d")], "graph_id long, node long, text string")
    edges = spark.createDataFrame([(7, 10, 20), (9, 6, 5)], "graph_id long, src long, dst long")
    labels = spark.createDataFrame([(7, "f"), (9, "g")], "graph_id long, label string")
    g = sinks.numbered_graphs(nodes, edges, labels)
    assert {(r["graph_id"], r["node_id"], r["text"]) for r in g.nodes.collect()} == {(1, 1, "a"), (1, 2, "b"), (2, 3, "c"), (2, 4, "d")}
    assert {(r["src"], r["dst"]) for r in g.edges.collect()} == {(1, 2), (2, 1), (4, 3), (3, 4)}
    assert {(r["graph_id"], r["label"]) for r in g.labels.collect()} == {(1, "f"), (2, "g")}


def test_records_pairs_and_lexicons(spark, tmp_path):
    put(tmp_path / "p" / "x_single_cfg_train.txt", "f;a\tb;b\tc\nf;z\tz;z\tz\ng;only\tone\n")
    got = [(r["name"], r["pairs"]) for r in files.pair_records(spark, str(tmp_path / "p")).collect()]
    assert got == [("f", ["a\tb", "b\tc"])]
    corpus = str(tmp_path / "corpus")
    rows = spark.createDataFrame([(["a\tb", "x"],)], "pairs array<string>")
    sinks.append_pairs(rows, corpus)
    sinks.append_pairs(rows, corpus)
    assert sorted((r["left"], r["right"]) for r in files.pair_corpus(spark, corpus).collect()) == [("a", "b")] * 2
    words = spark.createDataFrame([("null", 2.0), ("NA", 3.0), ('q"x', 1.0)], "word string, weight double")
    sinks.write_lexicon(words, str(tmp_path / "lex"))
    assert {(r["word"], r["weight"]) for r in files.lexicon(spark, str(tmp_path / "lex")).collect()} == {("null", 2.0), ("NA", 3.0), ('q"x', 1.0)}
    assert spark.range(1).select(sinks.pair_line(F.lit("f"), F.lit(["a\tb", "b\tc"]))).first()[0] == "f;a\tb;b\tc"


def test_discovery_lists_and_clusters(spark, tmp_path):
    put(tmp_path / "d" / "u" / "a_cfg_x.txt", "1\n")
    put(tmp_path / "d" / "b_dfg_x.txt", "22\n")
    put(tmp_path / "d" / "u" / "bin.so", "\x7fELF")
    found = [r["path"].rsplit("/", 1)[-1] for r in files.paths(spark, str(tmp_path / "d"), "*_cfg_*").collect()]
    assert found == ["a_cfg_x.txt"]
    kinds = {r["path"].rsplit("/", 1)[-1]: r["kind"] for r in files.candidates(spark, str(tmp_path / "d"), ("_dfg_x.txt",), {"elf": b"\x7fELF"}).collect()}
    assert kinds == {"b_dfg_x.txt": "_dfg_x.txt", "bin.so": "elf"}
    put(tmp_path / "list.txt", "p1\np2\n\np3\n")
    listed = files.listed(spark, str(tmp_path / "list.txt"))
    assert {r["path"] for r in listed.collect()} == {"p1", "p2", "p3"} and files.half(listed, "path").count() == 1
    put(tmp_path / "c.json", json.dumps({"get": ["1", "2"], "set": []}))
    assert {r["word"]: r["clusters"] for r in files.clusters(spark, str(tmp_path / "c.json")).collect()} == {"get": ["1", "2"], "set": []}
    put(tmp_path / "words" / "w.txt", "One_two 3\n")
    assert [r["line"] for r in files.word_lines(spark, str(tmp_path / "words")).collect()] == ["One_two 3"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(["a", "<eos>"], ["b"])], "target array<string>, guess array<string>")
    sinks.write_predictions(rows, str(tmp_path / "pred"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "pred")).collect()] == ["- expected: a", "- got: b", ""]
    sinks.write_related(spark.createDataFrame([("k", ["x", "y"]), ("l", [])], "word string, related array<string>"), str(tmp_path / "rel"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "rel")).collect()] == ["k\tx y "]
    sinks.save_table(rows.withColumn("opt", F.lit("O0")), str(tmp_path / "t"), "opt")
    assert sinks.load_table(spark, str(tmp_path / "t")).count() == 1
    log = sinks.logger(str(tmp_path / "x.log"), echo=False)
    log.info("hello")
    assert (tmp_path / "x.log").read_text() == "hello\n"


def test_incremental_counts(spark, tmp_path):
    from quern.streaming import counts

    put(tmp_path / "s" / "1.txt", "a b\na\n")
    run = lambda: counts.count_into(counts.word_stream(spark.readStream.text(str(tmp_path / "s")), F.col("value")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    put(tmp_path / "s" / "2.txt", "b\tc\n")
    run()
    assert {r["w"]: r["cnt"] for r in counts.counted(spark, str(tmp_path / "out")).collect()} == {"a": 2, "b": 2, "c": 1}
